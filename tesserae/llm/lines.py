"""Line dedup by overlapping windows of three lines.

Each document's lines are hashed; every three consecutive ones form a window. A window that stands at several places of the corpus keeps its first place (lowest doc_id, then position); at all later places the lines that it covers go. Windows overlap, so what they cover merges into longer passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 3


BLANKS = " \t\n\x0b\x0c\r"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(rid, doc_id, pos, hash, at) of every window; at: which lines it covers, counted from 0. Blank lines are passed over. Lines are compared without white space at either end."""
    marked = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("i"), stripped(x).alias("x")))
    rows = docs.select("rid", "doc_id", F.transform(F.filter(marked, lambda s: s["x"] != ""), lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["x"]).alias("h"))).alias("line"))
    rows = rows.where(F.size("line") >= width)
    at = F.sequence(F.lit(0), F.size("line") - width)
    found = F.transform(at, lambda p: F.struct(F.xxhash64(*[F.get(F.col("line"), p + k)["h"] for k in range(width)]).alias("hash"), F.array(*[F.get(F.col("line"), p + k)["i"] for k in range(width)]).alias("at")))
    return rows.select("rid", "doc_id", F.posexplode(found).alias("pos", "w")).select("rid", "doc_id", "pos", "w.hash", "w.at")


def named(docs: DataFrame) -> Column:
    """A row's name: 60 bits of a digest of its number and text; null for a null text. Rows that agree in both share it."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), docs["text"])), 1, 15), 16, 10).cast("bigint")


def covered(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(rid, gone): positions of the lines to remove, of those documents that have any. docs: rid, doc_id, text.

    The first place of each window comes from an aggregation with partial minima, which a window of any frequency passes; the join that follows has one row a repeated window on one side, so adaptive execution can split a frequent one on the other. Of rows repeated in full the first alone is meant.
    """
    all_windows = windows(docs, width)
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "rid", "pos")
    first = all_windows.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select(F.col("hash").alias("h"), F.col("a.rid").alias("first_rid"), F.col("a.pos").alias("first_pos"))
    later = all_windows.join(first, F.col("hash") == F.col("h")).where("rid <> first_rid or pos <> first_pos")
    return later.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("gone"))


def deduplicated(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """All columns of docs with text cleaned, and n_lines (non-blank ones before) and n_removed.

    docs: doc_id and text at least; other columns stay, whatever their names but for n_lines, n_removed and those that begin with ``tess_``. One row for each row. A null text stays null and has no lines; documents with fewer lines than a window lose none. Null ids count as higher than all others; rows of one id follow one another by a digest of id and text. Of rows that agree in doc_id and text one is the first, and the others lose what windows cover, like any later place. A text is looked at whole by one task.
    """
    rows = docs.select("doc_id", "text")
    gone = covered(rows.withColumn("rid", named(rows)), width).select(F.col("rid").alias("tess_rid"), F.col("gone").alias("tess_gone"))
    # null texts have no windows: they only need to be spread
    out = docs.withColumn("tess_id", F.coalesce(named(docs), -1 - F.abs(F.xxhash64("doc_id") % 2**40)))
    out = out.withColumn("tess_n", F.row_number().over(Window.partitionBy("tess_id").orderBy("tess_id")))
    out = out.join(gone, F.col("tess_id") == F.col("tess_rid"), "left").withColumn("tess_lines", lines_of(F.col("text")))
    filled = F.filter(F.sequence(F.lit(0), F.size("tess_lines") - 1), lambda i: stripped(F.get(F.col("tess_lines"), i)) != "")
    out = out.withColumn("tess_gone", F.when((F.col("tess_n") > 1) & F.col("text").isNotNull(), F.when(F.size(filled) >= width, filled)).otherwise(F.col("tess_gone")))
    n = F.size(F.filter(F.col("tess_lines"), lambda x: stripped(x) != ""))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n)).withColumn("n_removed", F.coalesce(F.size("tess_gone"), F.lit(0)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("tess_lines") - 1), F.col("tess_gone"))
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col("tess_lines"), i)), "\n")
    return out.withColumn("text", F.when(F.col("tess_gone").isNull(), F.col("text")).otherwise(text)).drop("tess_id", "tess_n", "tess_rid", "tess_gone", "tess_lines")


def without_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with cleaned texts, n_chars counted anew where it is a column, and without the documents all of whose lines went."""
    out = deduplicated(docs, width).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
