"""Contiguous shards of nearly equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, running_totals


def assign_shards(rows: DataFrame, size: str, order: list[Column], shards: int) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (place within the shard, from 0).

    Rows are ordered by ``order``; per-partition totals give each row the bytes before it, and the row
    goes to the shard whose equal share of all bytes holds its middle. A row larger than a share leaves
    the shards it covers empty. Ties of ``order`` are broken by nothing else, so let it name every column
    that tells rows apart; equal rows are interchangeable. An empty table gives an empty result. Sizes
    must be positive.
    """
    placed = running_totals(rows, order, [size])
    total = rows.agg(F.sum(size)).first()[0] or 1
    placed = materialise(placed.withColumn("shard", F.expr(f"cast((2 * before_{size} + {size}) * {shards} div (2 * {total}L) as int)")).drop(f"before_{size}"))
    first = placed.groupBy("shard").agg(F.min("pos").alias("_first"))  # at most `shards` rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("pos") - F.col("_first")).drop("pos", "_first")


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows with ``shard`` and ``slot`` to one folder per shard, in order of their slots."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Place documents by doc_id (nulls first; repeated ids by checksum, then size). Size is the UTF-8 bytes
    of the text (null: none) plus 16. The text itself is never shuffled."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    placed = assign_shards(slim, "size", order, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
