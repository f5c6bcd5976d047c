"""Sinks: catalog exports, partial and all-or-nothing updates, table layouts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_catalog(objects: DataFrame, path: str) -> None:
    """One text per object under schema and kind: (schema, kind, object, ddl)."""
    objects.select("schema", "kind", F.col("ddl").alias("value")).write.mode("overwrite").partitionBy("schema", "kind").text(path)


def export_changed(objects: DataFrame, changed: DataFrame, path: str) -> None:
    """Only the folders of containers with changes (schema, kind) are written anew."""
    spark = objects.sparkSession
    rows = objects.join(changed.select("schema", "kind").distinct(), ["schema", "kind"], "left_semi")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        export_catalog(rows, path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Write beside, then rename: on failure the old folder stays as it was."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        write(new)
    except Exception:
        fs.delete(Path(new), True)
        raise
    had = fs.exists(Path(path))
    if had and not fs.rename(Path(path), Path(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(Path(new), Path(path)):
        if had:
            fs.rename(Path(old), Path(path))
        raise OSError(f"{path} cannot be replaced")
    if had:
        fs.delete(Path(old), True)


def create_layout(rows: DataFrame, name: str, partition: Sequence[str] = (), buckets: tuple[int, str] | None = None, order: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """A table (managed, or with its files at path) laid out by partition, bucket and sort keys, so that later joins on the bucket key need no shuffle."""
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    w = rows.write.mode("overwrite").format("parquet")
    if path:
        w = w.option("path", path)
    if partition:
        w = w.partitionBy(*partition)
    if buckets:
        w = w.bucketBy(buckets[0], buckets[1])
        w = w.sortBy(*order) if order else w
    w.saveAsTable(name)
    return spark.table(name)


def display(df: DataFrame, rows: int = 20) -> list[str]:
    """A result as text: first ``name type`` of each column, then rows."""
    return [", ".join(f"{n} {t}" for n, t in df.dtypes), *(", ".join("" if v is None else str(v) for v in r) for r in df.limit(rows).collect())]


def run_script(spark: SparkSession, sql: str, delimiter: str | None = None) -> DataFrame | None:
    """The statements of a script in order; the last one's result."""
    from tesserae.catalog.sql_text import statements

    out = None
    for _, text in statements(sql, delimiter):
        parts = [s for _, s in statements(text)] if delimiter else [text]
        for part in parts:
            out = spark.sql(part)
    return out
