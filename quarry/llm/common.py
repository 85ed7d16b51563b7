"""Shared building blocks: tables in the folder all executors share, global order, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPREAD = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
_ROWS = 250_000  # of slim rows to a file
_FOLDER: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDER:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            base = tempfile.mkdtemp(prefix="quarry-")
            spark.sparkContext.setCheckpointDir(base)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tables-{app}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _FOLDER[app] = path.toString()
    return _FOLDER[app]


def materialise(df: DataFrame, codec: str = "snappy", slim: bool = False, rows: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: it cuts lineage, survives the loss of
    executors, and frees the shuffle files that were needed to make it. Tables of texts take less room by zstd.

    On local file systems Hadoop starts two processes (chmod) for each file, and one that is just being started
    counts with all of its executor's memory. So ``slim`` tables, of few cheap columns, are written by tasks of the
    advisory size instead of as many tasks as there are cores, and tables of at most ``rows`` slim rows, where
    a bound is known, by a task for each 250,000 of them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(1 + rows // _ROWS)
    before = {_CLEANUP: spark.conf.get(_CLEANUP, "false"), _SPREAD: spark.conf.get(_SPREAD, "true")}
    try:
        spark.conf.set(_CLEANUP, "true")
        if slim:
            spark.conf.set(_SPREAD, "false")
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later step reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Release the tables that are materialised inside when it ends, but those handed to the yielded function."""
    kept: list[DataFrame] = []
    _SCOPES.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        made = _SCOPES.pop()
        release(*(x for x in made if not any(x is k for k in kept)))
        if _SCOPES:
            _SCOPES[-1] += kept


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for actions inside: rows of megabytes must not meet in thousands."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(rows: DataFrame, order: list[Column], sums: list[str], group: list[str] | None = None) -> DataFrame:
    """Add ``pos`` (rows before this one) and ``before_<c>`` (their sum of c) in one global order, or one per group.

    Rows are range-partitioned by group and order, so a group with a third of all rows spans many
    partitions; sums run inside each partition and per-partition totals carry them over. Only the totals
    (a row for each partition and group in it) are ordered in one place. Group columns must not be null.
    """
    group = group or []
    keys = [F.col(g) for g in group]
    rows = materialise(rows)  # the sampling pass of the range partitioning then reads slim rows only
    part = materialise(rows.repartitionByRange(partitions(rows.sparkSession), *keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = part.withColumns({"pos": F.count(F.lit(1)).over(inside)} | {f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    total = part.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_t_{c}") for c in sums))
    if not group:
        total = total.repartition(1)
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(*group, "_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_o"), *(F.coalesce(F.sum(f"_t_{c}").over(over), F.lit(0)).alias(f"_o_{c}") for c in sums))
    out = local.join(carried, ["_part", *group])
    return out.withColumns({"pos": F.col("pos") + F.col("_o")} | {f"before_{c}": F.col(f"before_{c}") + F.col(f"_o_{c}") for c in sums}).drop("_part", "_o", *(f"_o_{c}" for c in sums))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until the edges stop
    changing. Each round is written to the shared folder, by few tasks if its edges, at most twice those before,
    are few; nothing is collected but a count and a hash.
    Any orderable type serves as node. Null ends and loops are ignored.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), slim=True)
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        after = materialise(small, rows=2 * mark[0])
        release(edges)
        edges = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
