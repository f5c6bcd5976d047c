from __future__ import annotations

import random

import duckdb
import pyarrow as pa

from tesserae.llm import lines
from tesserae.llm.queries import ORACLE_SQL, op1_line_dedup

SCHEMA = "doc_id bigint, text string, pos int, hash string, n_chars int"


def clean(spark, rows):
    return {r["doc_id"]: r for r in lines.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}


def test_overlapping_windows_merge_and_the_first_place_stays(spark):
    got = clean(spark, [(3, "x\n a \nb\n\nc\nd\ny", 0, "", 0), (1, "a\nb\nc\nd", 0, "", 0), (2, "a\nb\nq\nc\nd", 0, "", 0), (5, "a\nb", 0, "", 0), (6, "a\nb", 0, "", 0)])
    assert got[1]["text"] == "a\nb\nc\nd" and got[1]["n_removed"] == 0
    assert got[3]["text"] == "x\n\ny" and (got[3]["n_lines"], got[3]["n_removed"]) == (6, 4)
    assert got[2]["n_removed"] == got[5]["n_removed"] == got[6]["n_removed"] == 0


def test_repeats_within_a_document(spark):
    got = clean(spark, [(1, "a\nb\nc\na\nb\nc\nz", 0, "", 0), (2, "l\nl\nl\nl\nl", 0, "", 0)])
    assert got[1]["text"] == "a\nb\nc\nz"
    assert got[2]["text"] == "l" and got[2]["n_removed"] == 4


def test_nulls_empty_long_repeated_rows_and_empty_table(spark):
    long = "\n".join(f"line {i}" for i in range(30000))
    rows = [(1, None, 1, "", 1), (2, "", 1, "", 1), (3, " \n\t", 1, "", 1), (None, "p\nq\nr", 1, "", 1), (9, "p\nq\nr", 1, "", 1), (4, long, 1, "", 1), (5, long, 1, "", 1), (7, "u\nv\nw", 1, "", 1), (7, "u\nv\nw", 1, "", 1)]
    out = lines.deduplicated(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "pos", "hash", "n_chars", "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[1]["n_lines"] == 0
    assert by[2]["n_lines"] == by[3]["n_lines"] == 0 and by[3]["text"] == " \n\t"
    assert by[4]["n_removed"] == 0 and by[5]["n_removed"] == 30000 and by[5]["text"] == ""
    assert by[None]["n_removed"] == 3 and by[9]["n_removed"] == 0
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 7) == [0, 3]
    assert lines.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_as_by_sql_with_repeated_rows_ids_and_nulls(spark, tmp_path):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["a", " b", "c\t", "", "d", "e"]) for _ in range(rng.randint(0, 12))) for _ in range(120)] + [None, ""]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), "", "s", 0) for _ in range(200)]
    rows += rng.choices(rows, k=60)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op1_line_dedup(spark, str(tmp_path)).collect()]
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    with duckdb.connect() as db:
        db.register("documents", documents)
        want = db.execute(ORACLE_SQL["op1_line_dedup"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(got) == 260 and sum(r[2] for r in got) > 100
