"""Mixing sources to target weights: Sainte-Lague seats for equal-token blocks, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, running_totals, scratch

WEIGHTS = (5, 2, 1)
SHARDS = 64
LEAST_BLOCKS = 256  # a source of fewer common blocks is cut into so many of its own, or into its tokens


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, place, source_size, weight, target) from the (source, source_size) of every source.

    Sources come by code point, null last, with the weights in turn. All share ``share`` times the total;
    a target stops at ``most`` times its source's size and the excess goes to the others by weight: with
    sources by cap over weight, the capped ones are a prefix, so running sums give the water level.
    One row per source is all that is ordered in one place.
    """
    one = sizes.repartition(1)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(0))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = one.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", turn).withColumn("cap", most * F.col("source_size"))
    in_turn = whole.orderBy(F.col("cap") / F.col("weight"), "place")
    by_level = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_level), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    level = ranked.withColumn("_level", left / rest).withColumn("_turn", F.row_number().over(in_turn)).withColumn("_open", F.col("cap") > F.col("_level") * F.col("weight"))
    water = F.min(F.when(F.col("_open"), F.struct("_turn", "_level"))).over(whole)["_level"]  # of the first that stays below its cap
    return level.withColumn("_water", water).select("source", "place", "source_size", "weight", F.when(F.col("_water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_water") * F.col("weight"))).alias("target"))


def seats(targets: DataFrame, shards: int = SHARDS, blocks: int = 65536, per_source: int = 64) -> DataFrame:
    """(place, shard, seats): Sainte-Lague quotas by highest quotients target / (2 j + 1).

    The number of blocks is ``blocks`` or ``per_source`` for each source, whichever is more, and splits
    evenly into shards: shard k takes the quotients of ranks k n to (k + 1) n, and as the method is
    house-monotone the quotas of any first shards are themselves an apportionment. The ranking orders a
    bounded table (blocks + a few for each source), never documents.
    """
    whole = Window.partitionBy(F.lit(0))
    named = targets.withColumn("_m", F.count(F.lit(1)).over(whole)).withColumn("_all", F.sum("target").over(whole))
    per = F.ceil(F.greatest(F.lit(blocks), F.col("_m") * per_source) / F.lit(shards)).cast("long")
    named = named.withColumn("_per", per).where("target > 0")
    # A source's quotients above half the mean divisor's level cover its seats and spare ones.
    high = F.ceil(F.col("target") / F.col("_all") * F.col("_per") * shards * 1.05 + 4).cast("long")
    quotients = named.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), high))).withColumn("_q", F.col("target") / (2 * F.col("_j") + 1))
    ranked = quotients.withColumn("_rank", F.row_number().over(whole.orderBy(F.col("_q").desc(), "place")) - 1).where(f"_rank < _per * {shards}")
    return ranked.groupBy("place", F.floor(F.col("_rank") / F.col("_per")).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("seats"))


def mix(rows: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Choose what a mixture takes of each row of (key, source, size): adds source_size, target, epochs, picks, taken, shards.

    ``key`` tells rows apart and, with the seed, orders a source's rows; equal keys of one source stand in
    any order and must be equal rows. A source's tokens, laid out in that order, are cut into equal blocks.
    The quotas of the shards, in turn, take a source's blocks in the order of a seeded hash, whole epochs before
    a part of one; seats beyond ``most`` epochs lapse. The common block grows with the corpus: a source of fewer
    than ``LEAST_BLOCKS`` of them has blocks of its own instead, takes the number nearest to its target, and deals
    them evenly to the shards. ``epochs`` counts whole copies, ``picks`` lists the further token ranges
    [start, stop) of the row, and ``shards`` the shards that take any of its tokens. A source without tokens has
    target 0; an empty table gives an empty result.
    """
    with scratch() as keep:
        rows = materialise(rows)
        targets = materialise(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, float(most)))
        by_shard = materialise(seats(targets))
        quotas = by_shard.groupBy("place").agg(F.sum("seats").alias("seats"))
        plan = targets.join(quotas, "place", "left").fillna(0, ["seats"])
        granted = F.greatest(F.lit(1), F.sum("seats").over(Window.partitionBy(F.lit(0))))
        mean = share * F.sum("source_size").over(Window.partitionBy(F.lit(0))) / granted  # tokens a seat pays for
        plan = plan.withColumn("n_blocks", F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.round(F.col("source_size") / F.greatest(mean, F.lit(1e-9))))).otherwise(0).cast("long"))
        small = (F.col("source_size") > 0) & (F.col("n_blocks") < LEAST_BLOCKS)
        own = F.least(F.col("source_size"), F.lit(LEAST_BLOCKS)).cast("long")
        plan = plan.withColumn("small", small).withColumn("seats", F.when(small, F.round(F.col("target") / F.col("source_size") * own).cast("long")).otherwise(F.col("seats"))).withColumn("n_blocks", F.when(F.col("small"), own).otherwise(F.col("n_blocks")))
        # Within a source the blocks are equal to a token: the k-th ends at (k + 1) * source_size div n_blocks.
        plan = plan.withColumn("paid", F.least("seats", most * F.col("n_blocks"))).withColumn("epochs", F.expr("case when n_blocks > 0 then paid div n_blocks else 0 end"))
        plan = materialise(plan.withColumn("extra", F.col("paid") - F.col("epochs") * F.col("n_blocks")))

        # Seat t of a source pays for the block that is t-th, modulo their number, by seeded hash; and it is of the
        # shard whose quota covers t. Blocks are few beside rows, and no window orders a source's in one place.
        numbered = plan.where("paid > 0").select("place", "n_blocks", "paid", "seats", "small", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("b"))
        ranked = running_totals(numbered.withColumn("_x", F.xxhash64(F.lit(seed), "place", "b")), [F.col("_x"), F.col("b")], [], ["place"])
        seated = ranked.where("pos < paid").withColumn("epoch", F.explode(F.expr("sequence(0L, (paid - 1 - pos) div n_blocks)"))).withColumn("t", F.col("epoch") * F.col("n_blocks") + F.col("pos"))
        up_to = Window.partitionBy("place").orderBy("shard")
        held = by_shard.withColumn("_end", F.sum("seats").over(up_to)).select("place", "shard", F.explode(F.expr("sequence(_end - seats, _end - 1)")).alias("t"))
        seated = seated.join(held, ["place", "t"], "left").select("place", "b", "epoch", F.when(F.col("small"), F.expr(f"cast(t * {SHARDS} div seats as int)")).otherwise(F.col("shard")).alias("shard"))
        seated = materialise(seated)

        # Sources are few beside rows, but unbounded: Spark picks the join by their size.
        named = rows.join(plan.select(F.col("source").alias("_s"), "place"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        slim = named.select("place", "key", "size", F.md5(F.concat_ws("|", F.lit(seed), F.col("key").cast("string"))).alias("_h"))
        laid = running_totals(slim, [F.col("_h"), F.col("key"), F.col("size")], ["size"], ["place"]).drop("_h", "pos")
        laid = laid.join(plan.select("place", "source", "source_size", "target", "epochs", "paid", "n_blocks"), "place")
        laid = materialise(laid.withColumn("_id", F.monotonically_increasing_id()))
        # Block of token t: the b with b * S div n <= t < (b + 1) * S div n, that is ((t + 1) * n - 1) div S.
        spans = laid.where("paid > 0 and size > 0").select("_id", "place", "before_size", "size", "source_size", "n_blocks", "epochs", F.explode(F.expr("sequence(((before_size + 1) * n_blocks - 1) div source_size, ((before_size + size) * n_blocks - 1) div source_size)")).alias("b"))
        spans = spans.join(seated, ["place", "b"])
        cut = spans.select("_id", "shard", F.expr("greatest(b * source_size div n_blocks - before_size, 0L)").alias("start"), F.expr("least((b + 1) * source_size div n_blocks - before_size, size)").alias("stop"), (F.col("epoch") == F.col("epochs")).alias("part")).where("start < stop")
        picked = F.when(F.col("part"), F.struct("start", "stop"))
        cuts = cut.groupBy("_id").agg(F.coalesce(F.sum(F.when(F.col("part"), F.col("stop") - F.col("start"))), F.lit(0)).alias("_part"), F.sort_array(F.collect_list(picked)).alias("picks"), F.sort_array(F.collect_set("shard")).alias("shards"))
        cuts = cuts.withColumn("picks", F.when(F.size("picks") > 0, F.col("picks")))
        taken = (F.col("epochs") * F.col("size") + F.coalesce("_part", F.lit(0))).cast("long")
        out = laid.join(cuts, "_id", "left").select("key", "source", "size", "source_size", "target", F.col("epochs").cast("int").alias("epochs"), "picks", taken.alias("taken"), "shards")
        return keep(materialise(out))


def word_count(text):
    """Number of [^\\x20\\x09-\\x0D]+ in the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Mix all documents; a document's size is its number of words. Rows that repeat a doc_id are taken each
    on their own; a null doc_id is one more key. ``shards`` lists the shards that take words of a document."""
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "source", word_count(F.col("text")).alias("size"))
    return mix(rows).select(F.col("key.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mixture itself, with the columns of docs: a row for each whole copy, and one for the picked words
    of a document where only part of it is taken (its words then stand a space apart). n_chars follows the text."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "source", F.col("text").alias("whole"))
    plan = mix(keyed.select("key", "source", word_count(F.col("whole")).alias("size"))).where("taken > 0").select(F.col("key").alias("_key"), F.col("source").alias("_src"), "size", "epochs", "picks")
    # Equal keys of one source are equal rows: number both sides so that each row meets a choice of its own.
    left = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("key", "source").orderBy("key")))
    right = plan.withColumn("_m", F.row_number().over(Window.partitionBy("_key", "_src").orderBy("epochs", F.size("picks"))))
    joined = left.join(right, (F.col("key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("_n") == F.col("_m")))
    part = F.when(F.col("picks").isNotNull(), F.when((F.size("picks") == 1) & (F.col("picks")[0]["start"] == 0) & (F.col("picks")[0]["stop"] == F.col("size")), F.col("whole")).otherwise(F.expr(r"array_join(flatten(transform(picks, p -> slice(filter(split(whole, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), cast(p.start as int) + 1, cast(p.stop - p.start as int)))), ' ')")))
    texts = F.when(F.col("epochs") > 0, F.array_repeat("whole", F.col("epochs"))).otherwise(F.array().cast("array<string>"))
    out = joined.withColumn("_t", F.explode(F.concat(texts, F.when(part.isNotNull(), F.array(part)).otherwise(F.array().cast("array<string>")))))
    new = {"text": F.col("_t"), "n_chars": F.length("_t").cast("long")}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
