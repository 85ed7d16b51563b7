"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, DataFrame operations only.

A document is a set of digests of its paragraphs, which are cut further after words whose hash says so: an edit moves
no cut but those next to it. A sketch has three parts of c cells, c being the least power of two that is no less than
a quarter of the number of digests, so that versions can be told apart up to about half of them; each digest goes to one cell of each part, and a cell holds a count, the XOR of its digests and
the XOR of their checks. This sketch is the fingerprint. As a digest's cell is its hash modulo c, a sketch folds to
any smaller power of two, so sketches of two versions subtract cell by cell at the smaller one's size, which cancels
what they share. A cell left with count 1 or -1 whose check fits names a digest that one version alone has; taking it
out of its other cells frees further ones. If cells remain, the pair is sketched again at four times the size and by
other hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, partitions, running_totals, scratch

CUT = 16  # one word in so many ends a piece
LEAST = 4  # cells in each part of the smallest sketch
GROWTH = 4  # of a sketch that couldn't be peeled
CHECK = 99
ROUNDS = 4  # rounds of peeling in one stage
LOOPS = 2  # such stages before a pair is left to a larger sketch
SHARES = 2  # of all pairs, sketched and peeled one after the other: so much less room is taken at a time


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text that isn't null; none for the empty text. Inside of a run of characters
    without spaces, as scripts without spaces have, each one that is 16 or more from its ends is a word."""
    apart = F.when(text.rlike(r"\S{33}"), F.regexp_replace(text, r"(?<=\S{16})(?=\S{16})", " ")).otherwise(text)
    words = F.transform(F.split(apart, " "), lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(CUT)) == 0, F.concat(w, F.lit("\n"))).otherwise(w))
    pieces = F.transform(F.split(F.array_join(words, " "), r"\n+"), lambda x: F.trim(x))
    return F.array_distinct(F.transform(F.filter(pieces, lambda x: x != ""), lambda x: F.xxhash64(x)))


def cells_for(n: Column) -> Column:
    """Cells in each part of the sketch of n digests: the least power of two from n / 4 on."""
    return F.greatest(F.lit(LEAST), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))) - 2)).cast("long")


def _at(x: Column, part: int, c: Column, seed: int) -> Column:
    return part * c + F.pmod(F.xxhash64(x, F.lit(3 * seed + part)), c)


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(CHECK)).bitwiseAND(F.lit((1 << 32) - 1))


def _cells(x: Column, kind: int, c: Column, sign: int, seed: int) -> list[Column]:
    return [F.struct(F.lit(kind).alias("kind"), c.alias("c"), _at(x, p, c, seed).alias("pos"), F.lit(sign).cast("long").alias("count")) for p in range(3)]


def _summed(cells: DataFrame) -> DataFrame:
    out = cells.groupBy("rid", "kind", "c", "pos", "found").agg(F.sum("count").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    return out.where("pos < 0 or count <> 0 or key <> 0 or check <> 0")


def peel(cells: DataFrame, seed: int, rounds: int = ROUNDS, name: bool = True) -> DataFrame:
    """Recover digests from subtracted cells (rid, kind, c, pos, found, count, key, check).

    Each round takes the single-digest cells of one part, so no digest is met twice in it. Such a cell goes to pos -1
    (the first version alone has the digest) or -2 (the second), which count digests, or name them in ``found`` if
    asked to; and minus the digest goes to its other two cells. All rounds run where a pair's cells are.
    """
    for r in range(rounds):
        part, (p, q) = r % 3, [x for x in range(3) if x != r % 3]
        c, key = F.col("c"), F.col("key")
        pure = (F.col("pos") >= 0) & (F.abs("count") == 1) & (F.col("pos") == _at(key, part, c, seed)) & (F.col("check") == _check(key))
        same = F.struct("pos", "found", "count", "key", "check")

        def less(at: int, c: Column = c, key: Column = key) -> Column:
            return F.struct(_at(key, at, c, seed).alias("pos"), F.lit(0).cast("long").alias("found"), (-F.col("count")).alias("count"), key.alias("key"), F.col("check").alias("check"))

        zero = F.lit(0).cast("long")
        got = F.struct(F.when(F.col("count") > 0, -1).otherwise(-2).cast("long").alias("pos"), (key if name else zero).alias("found"), F.lit(1).cast("long").alias("count"), zero.alias("key"), zero.alias("check"))
        cells = _summed(cells.select("rid", "kind", "c", F.explode(F.when(pure, F.array(got, less(p), less(q))).otherwise(F.array(same))).alias("e")).select("rid", "kind", "c", "e.*"))
    return cells


def _peeled(cells: DataFrame, seed: int, name: bool) -> tuple[DataFrame, DataFrame]:
    """What peeling finds (rid, kind, pos, found, count) and the (rid, kind) it doesn't finish in ``LOOPS`` stages, of
    which the later ones see only pairs that have cells left."""
    spark, found = cells.sparkSession, None
    for loop in range(LOOPS):
        cells = materialise(peel(cells, seed, name=name))
        own = cells.where("pos < 0").select("rid", "kind", "pos", "found", "count")
        found = own if found is None else found.union(own)
        left = cells.where("pos >= 0")
        if loop + 1 < LOOPS:
            if left.isEmpty():
                break
            cells = left.repartition(partitions(spark), "rid")
    return found, left.select("rid", "kind").distinct()


def _sketched(pairs: DataFrame, seed: int, scale: float) -> DataFrame:
    """Subtracted cells of (a, b) (kind 2) and (a, n) (kind 3), by rid; a pair whose b or n is null isn't asked for.
    Rows are dealt by rid first, so that nothing else is shuffled."""
    size = lambda x: F.greatest(F.lit(1), F.floor(scale * GROWTH**seed * F.least(cells_for(F.size("a")), cells_for(F.size(x)))).cast("long"))
    sized = pairs.withColumns({"cb": F.when(F.col("b").isNotNull(), size("b")), "cn": F.when(F.col("n").isNotNull(), size("n"))}).repartition(partitions(pairs.sparkSession), "rid")
    side = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(x).alias("xs")) for i, x in enumerate("abn"))))
    each = sized.select("rid", "cb", "cn", side.alias("s")).select("rid", "cb", "cn", "s.side", F.explode("s.xs").alias("x"))
    x, cb, cn, side = F.col("x"), F.col("cb"), F.col("cn"), F.col("side")
    cells = each.select("rid", "x", F.explode(F.concat(*(F.when(needed, F.array(*_cells(x, kind, c, sign, seed))).otherwise(F.expr("array()")) for needed, kind, c, sign in ((cb.isNotNull() & (side == 0), 2, cb, 1), (cn.isNotNull() & (side == 0), 3, cn, 1), (side == 1, 2, cb, -1), (side == 2, 3, cn, -1))))).alias("e"))
    return _summed(cells.select("rid", "e.*", F.lit(0).cast("long").alias("found"), F.col("x").alias("key"), _check(F.col("x")).alias("check")))


def sketch_texts(pairs: DataFrame) -> DataFrame:
    """(rid, fa, fb): the sketches of the sets a and b of pairs as text, "digests;cells;pos:count:key:check,..."."""
    side = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(x).alias("xs")) for i, x in enumerate("ab"))))
    each = pairs.select("rid", side.alias("s")).select("rid", "s.kind", cells_for(F.size("s.xs")).alias("c"), F.explode("s.xs").alias("key"))
    at = F.array(*(_at(F.col("key"), p, F.col("c"), 0) for p in range(3)))
    cells = each.select("rid", "kind", "c", "key", _check(F.col("key")).alias("check"), F.explode(at).alias("pos")).groupBy("rid", "kind", "pos").agg(F.count(F.lit(1)).alias("count"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
    text = lambda kind: F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "count", "key", "check")))), lambda e: F.concat_ws(":", e["pos"], e["count"], F.hex(e["key"]), F.hex(e["check"]))))
    return cells.groupBy("rid").agg(text(0).alias("fa"), text(1).alias("fb"))


def _differences(pairs: DataFrame, scale: float, retries: int, name: bool) -> DataFrame:
    """(rid, kind, pos, found, count) of rows (rid, a, b, n), by sketches that grow until they can be peeled."""
    done = None
    for seed in range(retries):
        found, failed = _peeled(_sketched(pairs, seed, scale), seed, name)
        failed = materialise(failed)
        own = found.join(failed, ["rid", "kind"], "left_anti")
        done = own if done is None else done.unionByName(own)
        if failed.isEmpty():
            return done
        again = failed.groupBy("rid").agg(F.max(F.col("kind") == 2).alias("_b"), F.max(F.col("kind") == 3).alias("_n"))
        pairs = pairs.join(again, "rid").select("rid", "a", F.when(F.col("_b"), F.col("b")).alias("b"), F.when(F.col("_n"), F.col("n")).alias("n"))
    sides = [(2, -1, "a", "b"), (2, -2, "b", "a"), (3, -1, "a", "n"), (3, -2, "n", "a")]
    rest = pairs.select("rid", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).cast("long").alias("pos"), F.array_except(x, y).alias("xs")) for k, p, x, y in sides))).alias("e")).select("rid", "e.kind", "e.pos", F.explode("e.xs").alias("found"))
    return done.unionByName(rest.select("rid", "kind", "pos", "found", F.lit(1).cast("long").alias("count")))


def compare(pairs: DataFrame, scale: float = 1.0, retries: int = 6) -> DataFrame:
    """For rows (rid, a, b, n) of digest sets: what each side of (a, b) and (a, n) has alone.

    Returns (rid, a_b, b_a, a_n, n_a): a_b counts the digests of a that b lacks, and so on; rows of which nothing
    differs aren't returned. The first sketches are the fingerprints of both, folded to the smaller one's size;
    ``scale`` makes them smaller than that. A failed pair is tried again with more cells and other hashes, and
    one that fails every time (its chance is far below one in all documents) is settled from the sets.
    """
    alone = lambda kind, pos: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("pos") == pos), F.col("count"))), F.lit(0)).cast("long")
    return _differences(pairs, scale, retries, False).groupBy("rid").agg(alone(2, -1).alias("a_b"), alone(2, -2).alias("b_a"), alone(3, -1).alias("a_n"), alone(3, -2).alias("n_a"))


def differing_digests(pairs: DataFrame, scale: float = 1.0, retries: int = 6) -> DataFrame:
    """(rid, digest, side) for rows (rid, a, b): the digests that one version alone has (side 1: a, -1: b).
    A pair whose sketch can't be peeled is sketched again, larger; the last resort is the sets themselves."""
    found = _differences(pairs.select("rid", "a", "b", F.lit(None).cast("array<long>").alias("n")), scale, retries, True)
    return found.select("rid", F.col("found").alias("digest"), F.when(F.col("pos") == -1, 1).otherwise(-1).alias("side"))


def likeness(n_x: Column, n_y: Column, only_x: Column, only_y: Column) -> Column:
    """Shared digests over all of both sets; 1 for two empty sets."""
    return F.when(n_x + n_y == 0, 1.0).otherwise((n_x - only_x) / F.greatest(n_x + only_y, F.lit(1)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last quarter is the start of the next document.

    The next document is the next distinct (doc_id, text) by doc_id, null first, then by the text's hash; after
    the last comes the first. Rows that repeat doc_id and text each get the same result. A null text is empty.
    An empty table gives an empty result. Texts are shuffled once, heads of texts once more.
    """
    with scratch() as keep:
        text = F.coalesce("text", F.lit(""))
        own = F.col("doc_id").cast("long")
        # An id as two columns that are never null, so that grouping and joins share one partitioning.
        keyed = docs.select(F.coalesce(own, F.lit(0)).alias("k"), own.isNotNull().alias("some"), text.alias("text"), F.xxhash64(text).alias("h"))
        slim = keyed.select("some", "k", "h", F.length("text").cast("long").alias("n")).distinct()
        placed = materialise(running_totals(slim, [F.col("some"), F.col("k"), F.col("h"), F.col("n")], []))
        total = placed.count()
        owner = placed.select(F.col("some").alias("o_some"), F.col("k").alias("o_k"), F.col("h").alias("o_h"), "n", F.expr(f"(pos + 1) % {max(total, 1)}L").alias("pos"))
        wanted = materialise(placed.select("some", "k", "h", "pos").join(owner, "pos").drop("pos"))
        heads = keyed.join(wanted, ["k", "some", "h"]).select(F.col("o_k").alias("k"), F.col("o_some").alias("some"), F.col("o_h").alias("h"), "n", F.expr("substring(text, 1, cast(n div 4 as int))").alias("head"), digests(F.col("text")).alias("next"))
        both = keyed.join(heads.dropDuplicates(["k", "some", "h"]), ["k", "some", "h"])
        both = both.select(F.when(F.col("some"), F.col("k")).alias("doc_id"), "n", "text", "next", F.concat(F.expr("substring(text, 1, cast(n - n div 4 as int))"), "head").alias("edited"))
        known = both.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("n").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), F.col("next").alias("n"))
        known = materialise(known)
        zero = lambda x: F.coalesce(x, F.lit(0))
        shown = lambda n, cells: F.concat_ws(";", F.col(n).cast("string"), cells_for(F.col(n)).cast("string"), F.coalesce(cells, F.lit("")))
        near = lambda x, y: likeness(F.col(x), F.col(y), zero(f"{x}_{y}"), zero(f"{y}_{x}"))
        out = None
        for share in range(SHARES):
            own = known.where(F.pmod("rid", F.lit(SHARES)) == share)
            with scratch() as hold:
                counts = hold(materialise(compare(own.select("rid", "a", "b", "n"))))
            sizes = own.select("rid", "doc_id", "n_chars", "edited_sha256", *(F.size(x).alias(x) for x in "abn"))
            texts = sketch_texts(own.select("rid", "a", "b").repartition(partitions(docs.sparkSession), "rid"))
            full = sizes.join(counts, "rid", "left").join(texts, "rid", "left")
            full = full.select("doc_id", "n_chars", "edited_sha256", shown("a", "fa").alias("fingerprint"), shown("b", "fb").alias("edited_fingerprint"), near("a", "b").alias("near_edited"), near("a", "n").alias("near_next"))
            out = full if out is None else out.union(full)
            keep(counts)
        keep(known)
        return out
