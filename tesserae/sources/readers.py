"""Sources: projects and dumps of SQL files, delimited text, JSON and XML documents, JDBC, dictionaries, table functions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.catalog.sql_text import parsed_scripts, read_scripts


def load_dump(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """The statements of one dump or of a folder of dumps."""
    return parsed_scripts(read_scripts(spark, path), delimiter)


def load_project(spark: SparkSession, root: str, schemas: Sequence[str] | None = None) -> DataFrame:
    """A project split by schema: root/SCHEMA/<schema>/<kind>/<object>.sql. Folders of other schemas are not read at all."""
    paths = [f"{root}/SCHEMA/{s}" for s in schemas] if schemas is not None else [f"{root}/SCHEMA"]
    if not paths:
        return parsed_scripts(spark.createDataFrame([], "file string, sql string"))
    rows = spark.read.text(paths, wholetext=True, pathGlobFilter="*.sql", recursiveFileLookup=True)
    return parsed_scripts(rows.selectExpr("_metadata.file_path AS file", "value AS sql"))


def load_flat_project(spark: SparkSession, root: str, schemas: Sequence[str] | None = None) -> DataFrame:
    """A project of files named <schema>.<object>.sql; schemas choose by the prefix of the name."""
    names = F.regexp_extract("file", r"([^/]+)$", 1)
    rows = read_scripts(spark, root)
    if schemas is not None:
        rows = rows.where(F.split_part(names, F.lit("."), F.lit(1)).isin(list(schemas)))
    return parsed_scripts(rows)


def library_kind(source: str) -> str:
    """jdbc, url or local."""
    if source.startswith("jdbc:"):
        return "jdbc"
    scheme = urlparse(source).scheme
    return "url" if len(scheme) > 1 else "local"


def load_libraries(spark: SparkSession, sources: Iterable[str]) -> DataFrame:
    """Objects of several libraries in order (lib_ord), each source once."""
    out: DataFrame | None = None
    for i, path in enumerate(dict.fromkeys(sources)):
        rows = load_dump(spark, path).withColumn("lib_ord", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return parsed_scripts(spark.createDataFrame([], "file string, sql string")).withColumn("lib_ord", F.lit(0))
    return out


def library_list(spark: SparkSession, path: str) -> DataFrame:
    """Libraries from an XML list: path, owner, nested, ignore_privileges."""
    schema = "_path string, _owner string, _nested boolean, _ignorePrivileges boolean"
    rows = spark.read.schema(schema).option("rowTag", "library").format("xml").load(path)
    return rows.select(F.col("_path").alias("path"), F.col("_owner").alias("owner"), F.coalesce("_nested", F.lit(False)).alias("nested"), F.coalesce("_ignorePrivileges", F.lit(False)).alias("ignore_privileges"))


def read_jdbc(spark: SparkSession, url: str, queries: dict[str, str], driver: str | None = None, **options: str) -> dict[str, DataFrame]:
    """One frame a catalog query. Each query is its own connection: there is no snapshot over all of them."""
    out = {}
    for name, query in queries.items():
        reader = spark.read.format("jdbc").option("url", url).option("query", query)
        if driver:
            reader = reader.option("driver", driver)
        out[name] = reader.options(**options).load()
    return out


def restricted(catalog: DataFrame, schemas: Sequence[str]) -> DataFrame:
    """Rows of these schemas only; the filter goes to the source, and no schema means no query."""
    return catalog.where(F.col("schema").isin(list(schemas))) if schemas else catalog.limit(0)


def copy_from(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False, null: str = "", quote: str = '"', escape: str = "\\", where: str | None = None) -> DataFrame:
    """COPY ... FROM: delimited text with the usual options and WHERE on load."""
    rows = spark.read.schema(schema).options(sep=sep, header=header, nullValue=null, quote=quote, escape=escape, mode="FAILFAST").csv(path)
    return rows.where(where) if where else rows


def copy_to(rows: DataFrame, path: str, sep: str = ",", header: bool = False, null: str = "") -> None:
    """COPY (query) TO."""
    rows.write.mode("overwrite").options(sep=sep, header=header, nullValue=null).csv(path)


def open_json(rows: DataFrame, column: str, schema: str, path: str = "rows") -> DataFrame:
    """OPENJSON ... WITH: the objects of an array as rows of the declared columns."""
    found = F.from_json(column, f"{path} array<struct<{schema}>>")
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode(found[path]).alias("_r")).select(*others, "_r.*")


def open_xml(rows: DataFrame, column: str, row: str, columns: dict[str, str]) -> DataFrame:
    """OPENXML: the elements at a path (root/.../element) as rows, each column from a path relative to them: child elements, last an attribute as ``@name``. What an element lacks is null."""
    tree: dict = {}
    for path in columns.values():
        at = tree
        for step in path.split("/"):
            at = at.setdefault("_" + step[1:] if step.startswith("@") else step, {})
    ddl = lambda x: "struct<" + ", ".join(f"`{k}`: {ddl(v) if v else 'string'}" for k, v in x.items()) + ">"
    steps = row.strip("/").split("/")[1:]
    kind = f"array<{ddl(tree)}>"
    for k, step in enumerate(reversed(steps)):
        kind = f"`{step}` {kind}" if k == len(steps) - 1 else f"struct<`{step}`: {kind}>"
    found = F.from_xml(F.col(column), kind)
    for step in steps:
        found = found[step]
    others = [c for c in rows.columns if c != column]

    def value(path: str):
        out = F.col("_r")
        for step in path.split("/"):
            out = out["_" + step[1:] if step.startswith("@") else step]
        return out

    return rows.select(*others, F.explode(found).alias("_r")).select(*others, *[value(p).alias(n) for n, p in columns.items()])


def numbers(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """numbers(n)."""
    return spark.range(start, start + n).withColumnRenamed("id", "number")


def dictionary(rows: DataFrame, table: DataFrame, key: str, attributes: dict[str, object], layout_bytes: int = 10 << 20) -> DataFrame:
    """dictGet with defaults: attributes of the first table row of each key. Broadcast only if the plan's estimate stays within layout_bytes; else an ordinary join."""
    one = table.groupBy(key).agg(F.min(F.struct(*attributes)).alias("_d"))
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    one = F.broadcast(one) if size <= layout_bytes else one
    out = rows.join(one, key, "left")
    return out.select(*rows.columns, *[F.coalesce(F.col("_d")[a], F.lit(d)).alias(a) for a, d in attributes.items()])


def range_dictionary(rows: DataFrame, table: DataFrame, key: str, at: str, low: str, high: str, value: str) -> DataFrame:
    """A dictionary with RANGE: the value whose range holds the date; of several that of the latest start. One row for each row."""
    t = table.select(F.col(key).alias("_k"), F.col(low).alias("_lo"), F.col(high).alias("_hi"), F.col(value).alias("_v"))
    asked = rows.select(F.col(key).alias("_key"), F.col(at).alias("_at")).distinct()
    hit = asked.join(t, (F.col("_key") == F.col("_k")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") <= F.col("_hi")))
    found = hit.groupBy("_key", "_at").agg(F.max_by("_v", "_lo").alias(value))
    return rows.join(found, (F.col(key) == F.col("_key")) & (F.col(at) == F.col("_at")), "left").select(*rows.columns, value)


def declared(spark: SparkSession, name: str, columns: Sequence[tuple[str, str]], location: str, fmt: str = "csv", **options: str) -> DataFrame:
    """An external table: columns, location, format and options."""
    cols = ", ".join(f"`{c}` {k}" for c, k in columns)
    opts = ", ".join(f"'{k}' '{v}'" for k, v in options.items())
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(f"CREATE TABLE `{name}` ({cols}) USING {fmt} {f'OPTIONS ({opts})' if opts else ''} LOCATION '{location}'")
    return spark.table(name)


def spark_type(text: str) -> T.DataType:
    """The Spark type of a PostgreSQL, T-SQL or ClickHouse type name; string where none is closer."""
    import re

    t = " ".join(text.lower().split())
    if t.endswith("[]"):
        return T.ArrayType(spark_type(t[:-2]))
    if m := re.fullmatch(r"(nullable|lowcardinality|low_cardinality)\((.*)\)", t):
        return spark_type(m[2])
    if m := re.fullmatch(r"array\((.*)\)", t):
        return T.ArrayType(spark_type(m[1]))
    if m := re.fullmatch(r"map\(([^,]+),(.*)\)", t):
        return T.MapType(spark_type(m[1]), spark_type(m[2]))
    if m := re.match(r"(?:numeric|decimal|dec)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", t):
        return T.DecimalType(min(38, int(m[1])), int(m[2] or 0))
    base = re.sub(r"\(.*?\)", "", t).strip()
    #: Type names by the Spark type that holds them.
    families = {
        T.BooleanType(): "bool boolean bit",
        T.ByteType(): "int8 tinyint",
        T.ShortType(): "smallint int2 int16 smallserial uint8",
        T.IntegerType(): "int integer int4 int32 serial uint16",
        T.LongType(): "bigint int64 bigserial uint32",
        T.DecimalType(20, 0): "uint64",
        T.DecimalType(38, 0): "int128 int256 uint128 uint256",
        T.FloatType(): "real float4 float32",
        T.DoubleType(): "double float float8 float64 money smallmoney",
        T.DecimalType(38, 18): "numeric decimal dec",
        T.BinaryType(): "bytea blob binary varbinary image",
        T.DateType(): "date date32",
        T.TimestampNTZType(): "timestamp datetime datetime2 smalldatetime",
        T.TimestampType(): "timestamptz datetimeoffset datetime64",
    }
    if base == "double precision":
        return T.DoubleType()
    if base in ("timestamp with time zone", "timestamp without time zone"):
        return T.TimestampType() if "with time" in base else T.TimestampNTZType()
    for kind, names in families.items():
        if base in names.split():
            return kind
    return T.StringType()
