"""Exact n-gram Jaccard self-join: equal-part signatures deal sets out, signature trees join them."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batches_of, connected_components, materialise, release, running_totals, scratch
from quarry.llm.line_dedup import possible

PASSES = 4  # over the signatures, a share of them each: so much less room is taken at a time
BATCH = 256  # rows in an Arrow batch of texts or token sets
WIDEST = 1 << 15  # bits of a token bitmap; what exceeds its distinct bits is counted as excess

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> S33)) * M1
    x = (x ^ (x >> S33)) * M2
    return x ^ (x >> S33)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(word) > 64:
            return xxhash.xxh3_64_intdigest(word)
        if len(self) > 100_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z lower-cased, words [^\\x20\\x09-\\x0D]+.
    Fewer than k words make one shingle, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out + h[i : len(h) - n + 1 + i])
    return np.unique(out)


class Threshold:
    """Jaccard of at least num / den, with what follows from it for signatures.

    Sizes fall into intervals such that partners lie in the same or the next one. Scheme i serves the sets
    of intervals i and i + 1: partners differ by at most d_i elements, so of d_i + 1 + e parts (by hash) at
    least 1 + e are equal. e is chosen so that next to no set has more than e empty parts: then some equal
    part isn't empty. A set with more empty parts also signs those, so no pair is lost.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.starts, self.ends = [1], [den // num]
        self.schemes: dict[int, tuple[int, int]] = {}

    def similar(self, inter: int, a: int, b: int) -> bool:
        return self.den * inter >= self.num * (a + b - inter)

    def interval(self, n: int) -> int:
        while self.ends[-1] < n:
            self.starts.append(self.ends[-1] + 1)
            self.ends.append(max(self.starts[-1], self.starts[-1] * self.den // self.num))
        return bisect_right(self.starts, n) - 1

    def scheme(self, i: int) -> tuple[int, int]:
        """(parts, e) of scheme i."""
        if i not in self.schemes:
            self.schemes[i] = self._scheme(i)
        return self.schemes[i]

    def _scheme(self, i: int) -> tuple[int, int]:
        while len(self.ends) <= i:
            self.interval(self.ends[-1] + 1)
        low, high = self.starts[i], self.ends[i]
        d = (high + high * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if d == 0:
            return 1, 0

        def more(e: int) -> float:
            """Chance that the smallest set has more than e empty parts (Poisson)."""
            lam = (d + 1 + e) * math.exp(-low / (d + 1 + e))
            term = total = math.exp(-lam)
            for j in range(1, e + 1):
                term *= lam / j
                total += term
            return max(0.0, 1 - total)

        best = min(range(13 + d // 8), key=lambda e: (max(more(e), 1e-6), e))
        return d + 1 + best, best

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        out, at = [], self.interval(max(len(tokens), 1))
        for i in (at, at - 1):
            if i < 0 or not len(tokens):
                continue
            parts, e = self.scheme(i)
            p = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # grows with the token: parts are runs
            first = np.flatnonzero(np.diff(p, prepend=np.uint64(parts)))
            sums = np.add.reduceat(mixed(tokens + np.uint64(0x9E3779B9)), first)
            full = p[first]
            if parts - len(full) > e:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), full)
                full, sums = np.concatenate([full, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
            out.append(mixed(mixed(sums + full) + np.uint64(i)))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


class Node:
    """A node of a signature tree: the OR of its sets' token bitmaps, their range of sizes, and the most tokens
    that a set of it has beyond its distinct bits."""

    __slots__ = ("bits", "low", "high", "excess", "parts", "label")

    def __init__(self, bits: np.ndarray, low: int, high: int, excess: int, parts: list, label: int | None) -> None:
        self.bits, self.low, self.high, self.excess, self.parts, self.label = bits, low, high, excess, parts, label

    @staticmethod
    def of(nodes: list[Node]) -> Node:
        labels = {n.label for n in nodes}
        return Node(np.bitwise_or.reduce([n.bits for n in nodes]), min(n.low for n in nodes), max(n.high for n in nodes), max(n.excess for n in nodes), nodes, labels.pop() if len(labels) == 1 else None)


def tree(sets: list[np.ndarray], labels: list[int], width: int, fan: int = 8) -> Node:
    """Sets of the same label, and among them of alike least tokens, are neighbours. A leaf's parts is its place."""
    order = sorted(range(len(sets)), key=lambda i: (labels[i], int(sets[i][0]), len(sets[i])))
    level = []
    for i in order:
        bits = np.zeros(width // 8, np.uint8)
        at = (sets[i] % np.uint64(width)).astype(np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        bits = bits.view(np.uint64)
        level.append(Node(bits, len(sets[i]), len(sets[i]), len(sets[i]) - int(np.bitwise_count(bits).sum()), i, labels[i]))
    while len(level) > 1:
        level = [Node.of(level[a : a + fan]) for a in range(0, len(level), fan)]
    return level[0]


def may_link(x: Node, y: Node, t: Threshold) -> bool:
    """Whether the largest possible overlap of two sets below x and y reaches the threshold: their common
    tokens set bits in both ORs, and no more than `excess` tokens share a bit with another."""
    low, high = max(x.low, y.low), min(x.high, y.high)
    if t.den * high < t.num * low:
        return False
    most = min(high, int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.excess, y.excess))
    return t.similar(most, max(x.low, most), max(y.low, most))


def tree_links(sets: list[np.ndarray], labels: list[int], t: Threshold, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join sets of different labels into groups, by dual traversal of their signature tree(s).

    Labels name groups known to be connected. Pairs that are, or have just become, connected are skipped, so
    a large group of copies costs its spanning links alone; every other pair whose bound holds is compared.
    With sides (0 or 1), only pairs across the sides are.
    """
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    width = min(WIDEST, 1 << max(6, (2 * max(map(len, sets))).bit_length()))
    if sides is None:
        top = tree(sets, labels, width)
        stack = [(top, top)]
    else:
        two = [[i for i, s in enumerate(sides) if s == side] for side in (0, 1)]
        tops = []
        for own in two:
            top = tree([sets[i] for i in own], [labels[i] for i in own], width)
            todo = [top]
            while todo:
                node = todo.pop()
                if isinstance(node.parts, int):
                    node.parts = own[node.parts]
                else:
                    todo += node.parts
            tops.append(top)
        stack = [(tops[0], tops[1])]
    links = []
    while stack:
        x, y = stack.pop()
        if x.label is not None and y.label is not None and root(x.label) == root(y.label):
            continue
        if x is y:
            stack += [(a, b) for i, a in enumerate(x.parts) for b in x.parts[i:] if not (a is b and isinstance(a.parts, int))]
        elif may_link(x, y, t):
            if isinstance(x.parts, int) and isinstance(y.parts, int):
                a, b = sets[x.parts], sets[y.parts]
                if t.similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)):
                    links.append((x.parts, y.parts))
                    parent[root(x.label)] = root(y.label)
            elif isinstance(y.parts, int) or (not isinstance(x.parts, int) and x.high - x.low >= y.high - y.low):
                stack += [(a, y) for a in x.parts]
            else:
                stack += [(x, b) for b in y.parts]
    return links


def parities(tokens: np.ndarray) -> np.ndarray:
    """For each residue of the tokens by a power of two near their number: whether an odd number of them has it, as bits."""
    width = min(WIDEST, 1 << max(6, (len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, h, n, tokens) of (id, h, text)."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(x, k) for x in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "h": frame["h"], "n": [len(x) for x in sets], "tokens": [x.view(np.int64) for x in sets]})

    return docs.mapInPandas(make, "id long, h long, n long, tokens array<long>")


def _signed(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(id, h, n, odd, sigs) of (id, h, text)."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(x, k) for x in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "h": frame["h"], "n": [len(x) for x in sets], "odd": [parities(x) for x in sets], "sigs": [t.signatures(x).view(np.int64) for x in sets]})

    return docs.mapInPandas(make, "id long, h long, n long, odd array<long>, sigs array<long>")


def _may_link(t: Threshold) -> str:
    """Whether two sets of na and nb tokens, with parities oa and ob, can link: their sizes allow it, and each
    residue of different parity costs a token that one set has and the other hasn't. Wider parities are folded."""
    half = lambda o, at: f"slice({o}, {at}, size({o}) div 2)"
    folded = lambda o, other: f"if(size({o}) = 2 * size({other}), zip_with({half(o, 1)}, {half(o, f'size({o}) div 2 + 1')}, (u, v) -> u ^ v), {o})"
    apart = f"aggregate(zip_with({folded('oa', 'ob')}, {folded('ob', 'oa')}, (u, v) -> bit_count(u ^ v)), 0, (s, c) -> s + c)"
    return f"{t.den} * na >= {t.num} * nb and {t.den} * nb >= {t.num} * na and {t.den + t.num} * coalesce({apart}, 0) <= {t.den - t.num} * (na + nb)"


def similar_groups(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, chunk: int = 500_000, direct: int = 64) -> DataFrame:
    """(doc_id, h, n_shingles, component_id) for every row of (doc_id, text); h is xxhash64 of the text.

    Two documents link when den * intersection >= num * union of their sets of k-word shingles; component_id
    is the smallest doc_id reachable by links. Without words a document links with nothing. A null text has no
    words; a null doc_id takes no part and has a null component. Rows that repeat a doc_id are one node, with the
    links of all their texts. An empty table gives an empty result. Exact for all sizes; there is no cap on
    partners or groups.

    Equal texts are first put under their smallest id. Texts then sign equal parts of their sets (Threshold), so
    texts that link share a signature. Each member of a signature is compared with its least id, which settles groups
    of copies in linear work. What is left are signatures whose members are in several verified groups: all pairs of
    different groups are compared for those of at most ``direct`` members; the members of others are laid out in chunks
    of about ``chunk`` tokens, and chunks, and pairs of chunks that hold different groups of one signature, are joined
    by signature trees. Token sets are only sent to pairs whose sizes and parities allow a link (_may_link).
    """
    t = Threshold(num, den)
    with scratch() as keep, batches_of(docs.sparkSession, BATCH):
        text = F.coalesce("text", F.lit(""))
        keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
        slim = keyed.select("id", "h", F.xxhash64(F.lit(7), "text").alias("h2"))
        least = slim.groupBy("h", "h2").agg(F.min("id").alias("rep"))
        member = materialise(slim.join(least, ["h", "h2"]).select("id", "h", "rep"))
        first = member.where("id = rep").select("id", "h").distinct()
        signed = materialise(_signed(keyed.join(first, ["id", "h"], "left_semi"), k, t))

        met = None
        for share in range(PASSES):
            signs = signed.select("id", F.explode("sigs").alias("sig")).where(F.pmod("sig", F.lit(PASSES)) == share)
            stars = signs.groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("sig", "a")
            own = materialise(signs.join(stars, "sig").select("sig", "id", "a"))
            met = own if met is None else met.union(own)
        sketch = materialise(signed.select("id", "h", "n", "odd"))
        release(signed)
        left, right = (sketch.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}")) for c in "ab")

        def token_sets(ids: DataFrame) -> DataFrame:
            alive = materialise(ids.distinct(), slim=True)
            return materialise(_sets(possible(keyed, "id", alive).join(alive, "id", "left_semi").join(first, ["id", "h"], "left_semi"), k))

        def linked(pairs: DataFrame) -> DataFrame:
            """Those of the pairs (a, b) that link."""
            sets = token_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")))
            x, y = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}")) for c in "ab")
            inter = F.size(F.array_intersect("ta", "tb"))
            out = materialise(pairs.join(y, "b").join(x, "a").where(den * inter >= num * (F.col("na") + F.col("nb") - inter)).select("a", "b").distinct())
            release(sets)
            return out

        edges = met.where("id <> a").select("a", F.col("id").alias("b")).distinct()
        verified = linked(materialise(edges.join(right, "b").join(left, "a").where(_may_link(t)).select("a", "b").distinct()))
        # Rows of one doc_id that stand under different ids are one node.
        spread = member.groupBy("id").agg(F.min("rep").alias("_a"), F.max("rep").alias("_z")).where("_a < _z").select("id")
        nodes = materialise(member.join(spread, "id").select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())
        groups = materialise(connected_components(verified.union(nodes)))

        named = met.select("sig", "id").join(groups.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", F.coalesce("component", "id").alias("label"))
        mixed = named.groupBy("sig").agg(F.min("label").alias("_a"), F.max("label").alias("_z"), F.count(F.lit(1)).alias("members")).where("_a < _z").select("sig", "members")
        open_ = materialise(named.join(mixed, "sig").join(sketch, "id"))
        x, y = (open_.where(f"members <= {direct}").select("sig", F.col("id").alias(c), F.col("label").alias(f"l{c}"), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}")) for c in "ab")
        verified = verified.union(linked(materialise(x.join(y, "sig").where(f"a < b and la <> lb and {_may_link(t)}").select("a", "b").distinct())))

        loose = open_.where(f"members > {direct}").select(F.col("sig").alias("near"), "label", "n", "id", "h").distinct().withColumn("room", F.col("n") + 64)
        sets = token_sets(loose.select("id"))
        laid = materialise(running_totals(loose, [F.col("near"), F.col("label"), F.col("n"), F.col("id"), F.col("h")], ["room"]).withColumn("chunk", F.expr(f"before_room div {chunk}")))
        parts = laid.groupBy("near", "chunk").agg(F.min("label").alias("la"), F.max("label").alias("lz"), F.min("n").alias("low"), F.max("n").alias("high"))
        last = parts.groupBy("near").agg(F.max("chunk").alias("last"))
        later = parts.join(last, "near").where("chunk < last").withColumn("other", F.explode(F.expr("sequence(chunk + 1, last)")))
        also = parts.select("near", F.col("chunk").alias("other"), F.col("la").alias("oa"), F.col("lz").alias("oz"), F.col("low").alias("olow"), F.col("high").alias("ohigh"))
        cross = later.join(also, ["near", "other"]).where(f"not (la = lz and oa = oz and la = oa) and {den} * high >= {num} * olow and {den} * ohigh >= {num} * low")
        tasks = cross.select("near", F.col("chunk").alias("i"), F.col("other").alias("j")).select("near", "i", "j", F.explode(F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("j").alias("chunk"), F.lit(1).alias("side")))).alias("e")).select("near", "i", "j", "e.*")
        rows = laid.select("near", "chunk", "label", "id", "h")
        inside = rows.select("*", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.lit(0).alias("side"))
        across = rows.join(tasks, ["near", "chunk"]).select("near", "chunk", "label", "id", "h", "i", "j", "side")
        work = inside.union(across).join(sets.select("id", "h", "tokens"), ["id", "h"])

        def search(frame: pd.DataFrame) -> pd.DataFrame:
            out = []
            within = frame["i"].iloc[0] == frame["j"].iloc[0]
            for _, own in frame.groupby("near"):
                found = [np.asarray(x, np.int64).view(np.uint64) for x in own["tokens"]]
                ids = own["id"].to_numpy()
                out += [(ids[x], ids[y]) for x, y in tree_links(found, own["label"].tolist(), t, None if within else own["side"].tolist())]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        joined = materialise(work.groupBy("i", "j").applyInPandas(search, "a long, b long"))
        final = connected_components(verified.union(nodes).union(joined))
        count = sketch.groupBy("id", "h").agg(F.max("n").alias("n_shingles")).withColumnRenamed("id", "rep")
        named = member.join(count, (member["rep"] == count["rep"]) & (member["h"] == count["h"]), "left").select(member["id"], member["h"], member["rep"], F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"))
        # An id is a node of its own where its rows stand under several ids, else it stands under its representative.
        homes = named.join(final, F.col("rep") == F.col("node"), "left").drop("node")
        alone = (F.col("n_shingles") == 0) | F.col("id").isNull()
        out = homes.select(F.col("id").alias("doc_id"), "h", "n_shingles", F.when(alone, F.col("id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
        several = out.groupBy("doc_id").agg(F.min("component_id").alias("_low"), F.max("component_id").alias("_high")).where("_low < _high").select("doc_id", "_low")
        return keep(materialise(out.join(several, "doc_id", "left").select("doc_id", "h", "n_shingles", F.coalesce("_low", "component_id").alias("component_id"))))


def one_of_each_group(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents whose doc_id is the smallest of their group, rows without doc_id as well. Of rows that repeat
    such a doc_id, which are one node, the one whose text has the least hash is kept, once."""
    groups = similar_groups(docs, k, num, den)
    keep = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.min("h").alias("_h"))
    kept = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit("")))).join(keep, ["doc_id", "_h"], "left_semi").drop("_h").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)
