"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import TABLES, load

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Tables of a folder as attributes, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)


class Suite:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query in Spark SQL with tables in braces; the oracle is the same text unless given."""
        names = sorted(set(re.findall(r"\{(\w+)\}", text)))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return spark.sql(text, **{n: load(spark, sf_dir, n) for n in names})

        self.queries[name] = run
        self.oracles[name] = (oracle or text).replace("{", "").replace("}", "") if oracle is None else oracle

    def op(self, name: str, function: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
        """A query made of operators, over the folder's tables."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(Tables(spark, sf_dir))

        self.queries[name] = run
        if oracle is not None:
            self.oracles[name] = oracle
