"""Catalog operations: tables, column changes, views, materialised views, explain, statistics, ageing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.registry import spark_type


def create_table(df: DataFrame, name: str, partition_by: list[str] | None = None, bucket_by: tuple[int, str] | None = None) -> None:
    """Save as Parquet; bucketing on the join key spares later joins a shuffle."""
    writer = df.write.format("parquet").mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(*bucket_by).sortBy(bucket_by[1])
    writer.saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def add_column(df: DataFrame, name: str, type_name: str, default: object = None) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return df.withColumn(name, F.lit(default).cast(spark_type(type_name)))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return df.drop(name)


def change_type(df: DataFrame, name: str, type_name: str) -> DataFrame:
    """Values that don't convert become null."""
    return df.withColumn(name, F.col(name).try_cast(spark_type(type_name)))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


class Views:
    """Named queries: plain views, and materialised ones saved as Parquet and refreshed in order of their dependence."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.made: dict[str, tuple[Callable[[Views], DataFrame], tuple[str, ...]]] = {}
        self.version: dict[str, int] = {}
        self.stale: set[str] = set()

    def define(self, name: str, query: Callable[[Views], DataFrame], needs: tuple[str, ...] = ()) -> None:
        self.made[name] = (query, needs)
        self.stale.add(name)

    def order(self) -> list[str]:
        out: list[str] = []

        def visit(n: str, above: tuple[str, ...]) -> None:
            if n in above:
                raise ValueError(f"views depend on each other: {n}")
            for m in self.made[n][1]:
                visit(m, (*above, n))
            if n not in out:
                out.append(n)

        for n in self.made:
            visit(n, ())
        return out

    def changed(self, name: str) -> None:
        """Mark a view and all that need it as stale."""
        self.stale.add(name)
        for n in self.order():
            if any(m in self.stale for m in self.made[n][1]):
                self.stale.add(n)

    def refresh(self) -> list[str]:
        done = []
        for n in self.order():
            if n in self.stale:
                v = self.version.get(n, 0) + 1
                self.made[n][0](self).write.mode("overwrite").parquet(f"{self.folder}/{n}/{v}")
                self.version[n] = v
                done.append(n)
        self.stale.clear()
        return done

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self.version[name]}")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def analyse(df: DataFrame) -> DataFrame:
    """(column, rows, nulls, distinct, least, largest); distinct counts are approximate."""
    cols = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    stats = F.array(*(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("largest")) for c in cols))
    return df.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def temperature(accesses: Column, age_days: Column, half_life: float = 30.0) -> Column:
    """0..1: recent and frequent access is hot."""
    return F.least(F.lit(1.0), F.log1p(accesses) / 5.0) * 0.5 + 0.5 * F.pow(F.lit(0.5), age_days / half_life)


def age_class(heat: Column) -> Column:
    return F.when(heat >= 0.7, "HOT").when(heat >= 0.3, "WARM").otherwise("COLD")


def age_action(heat: Column) -> Column:
    return F.when(heat < 0.1, "delete").when(heat < 0.2, "archive").otherwise("keep")
