"""A small registry: a query function and the SQL that it is held against, declared in one place."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.session import shared_dir, table


NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The driver tables as attributes: t.lineitem reads lineitem on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the driver tables; those that the text names become views."""
        for name in NAMES:
            if re.search(rf"\b{name}\b", text):
                table(self.spark, self.sf_dir, name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def create(self, rows: DataFrame, **layout) -> str:
        """Write rows as a table of a new name, its files in the shared folder; returns the name."""
        from tesserae.sources.writers import create_layout

        name = f"tesserae_{uuid.uuid4().hex}"
        create_layout(rows, name, path=f"{shared_dir(self.spark)}/{name}", **layout)
        return name

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE_SQL: dict[str, str] = {}

    def both(self, name: str, sql: str, spark: str | None = None) -> None:
        """Register SQL that both engines understand, or one text for each."""
        self.query(sql, name)(lambda t: t.sql(spark or sql))

    def query(self, sql: str | None = None, name: str | None = None):
        """Register a function of Tables under its own name, with its SQL if it has one."""

        def add(f: Callable[[Tables], DataFrame]):
            key = name or f.__name__
            if key in self.QUERIES:
                raise ValueError(f"query {key} is registered twice")
            self.QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.ORACLE_SQL[key] = sql
            return f

        return add
