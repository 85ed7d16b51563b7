"""Bounded runs of streaming queries: everything that is there now, then stop."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import load


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file (or folder) as a stream."""
    schema = load(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def shared(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="quarry-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over what is there now; the rows it has emitted, in complete mode its last state.

    With ``each``, batches go to that function and nothing is returned.
    """
    spark = stream.sparkSession
    folder = shared(spark)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(each or save).start()
    query.awaitTermination()
    if each:
        return None
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
