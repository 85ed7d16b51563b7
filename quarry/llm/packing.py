"""Best-fit-decreasing packing of token sequences into windows."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, partitions

WINDOW = 4096


class CapacityTree:
    """Segment tree over remaining capacities 0..size: finds the tightest open one that fits."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.held = [False] * (2 * self.leaves)

    def set(self, at: int, held: bool) -> None:
        i = at + self.leaves
        self.held[i] = held
        while i > 1:
            i //= 2
            self.held[i] = self.held[2 * i] or self.held[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest held capacity of at least `least`."""
        i = least + self.leaves
        if self.held[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.held[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.held[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Pack counts[n] pieces of each length n, longest first, each into the tightest open window.

    Pieces of one length are interchangeable, so windows of one remaining capacity are kept as id ranges and
    filled a run at a time: a window that takes a piece stays the tightest until no further piece fits.
    Returns runs (length, first rank, pieces, first window, pieces per window, offset): the i-th piece of the
    run lies in window first + i // per at offset + i % per * length. The work follows the number of distinct
    lengths (at most `window`), not of pieces.
    """
    tree, runs, opened = CapacityTree(window), [], 0
    held: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: ranges (first window, windows)

    def keep(free: int, first: int, k: int) -> None:
        if k and free:
            held.setdefault(free, []).append((first, k))
            tree.set(free, True)

    for n in sorted(counts, reverse=True):
        left, rank = counts[n], 0
        while left:
            room = tree.tightest(n)
            if room is None:
                room, first, there = window, opened, -(-left // (window // n))
                opened += there
            else:
                first, there = held[room].pop()
                tree.set(room, bool(held[room]))
            per = room // n
            pieces = min(left, per * there)
            full, rest = divmod(pieces, per)
            runs.append((n, rank, pieces, first, per, window - room))
            keep(room - per * n, first, full)
            keep(room - rest * n, first + full, bool(rest))
            keep(room, first + full + bool(rest), there - full - bool(rest))
            left, rank = left - pieces, rank + pieces
    return runs



def place(pieces: DataFrame, order: list[Column], window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to ``window`` tokens (column ``length``).

    The packing itself needs only how many pieces there are of each length (at most ``window`` numbers, the
    one thing that reaches the driver). Ranks within a length come from per-bucket counts, so a length that a
    third of all pieces share is ranked by many tasks. Equal rows may swap places.
    """
    spark = pieces.sparkSession
    buckets = 4 * partitions(spark)
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64(*pieces.columns), F.lit(buckets)))
    counts = materialise(dealt.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")))
    before = counts.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_b").orderBy(*order)
    ranked = dealt.withColumn("_i", F.row_number().over(inside) - 1).join(before, ["length", "_b"]).withColumn("_rank", F.col("_i") + F.col("_o"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = best_fit_decreasing(histogram, window)
    # A table of runs has some rows for each length whatever the number of pieces; runs of a length are sorted
    # into one array, found by a rank's position among their first ranks.
    table = pd.DataFrame(runs, columns=["length", "first", "n", "seq", "per", "at"], dtype="int64")
    rows = spark.createDataFrame(table, "length long, first long, n long, seq long, per long, at long")
    runs_of = rows.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "seq", "per", "at"))).alias("_runs"))
    found = ranked.join(F.broadcast(runs_of), "length").withColumn("_r", F.expr("element_at(filter(_runs, r -> r.first <= _rank and _rank < r.first + r.n), 1)"))
    step = F.col("_rank") - F.col("_r.first")
    return found.withColumns({"sequence_id": F.expr("_r.seq + (_rank - _r.first) div _r.per"), "offset": F.col("_r.at") + step % F.col("_r.per") * F.col("length")}).drop("_b", "_i", "_o", "_rank", "_runs", "_r")


class _Ids:
    """Ids of chunks of text without spaces, kept in two generations of bounded size: chunks that come up again
    move to the younger one, and the older one goes when that is full."""

    def __init__(self, path: str, room: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters: dict[str, str] = {}
        self.model = self.tokenizer.model
        self.signs = dict(zip(".,", self.encoded([".", ","]), strict=True))

    def word(self, c: str) -> bytes | None:
        """Ids of a lower-case word of plain letters, with a full stop or comma behind it at most.

        Letters are one piece and normal as they stand, so the model can take them at once; None for all else.
        """
        tail = b""
        if c[-1:] in (".", ","):
            c, tail = c[:-1], self.signs[c[-1]]
        if not c.isalpha():
            return None
        if tail and (ids := self.young.get(c) or self.old.get(c)):
            return ids + tail
        if not c.isascii():
            if max(c) >= "\u0250":
                return None
            c = "".join(map(self.letter, c))
        return array("I", [t.id for t in self.model.tokenize(c)]).tobytes() + tail

    def letter(self, c: str) -> str:
        """How the model's vocabulary writes a letter's bytes."""
        if c not in self.letters:
            self.letters[c] = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
        return self.letters[c]

    def encoded(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def learn(self, chunks: set[str], lowered: bool) -> None:
        """Put the chunks into the younger generation."""
        new, old, young = [], self.old, self.young
        for c in chunks:
            if c in young:
                continue
            if (ids := old.get(c)) is None and lowered:
                ids = self.word(c)
            if ids is None:
                new.append(c)
            else:
                young[c] = ids
        young.update(zip(new, self.encoded(new), strict=True))

    def of(self, text: str) -> bytes:
        """The tokenizer drops white space and never joins across it, so a text's ids are those of its
        space-separated chunks in turn. It lower-cases, so capitals need no entries where lower case is plain."""
        if lowered := text.isascii() or max(text) < "\u0250":
            text = text.lower()
        chunks = text.replace("\n", " ").split(" ")
        if len(self.young) > self.room:
            self.young, self.old = {}, self.young
        try:
            return b"".join(map(self.young.__getitem__, chunks))
        except KeyError:
            self.learn(set(chunks), lowered)
            return b"".join(map(self.young.__getitem__, chunks))


_CACHE: dict[str, _Ids] = {}


def token_ids(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    ids = _CACHE.get(path) or _CACHE.setdefault(path, _Ids(path))
    for text in texts:
        yield ids.of(text)


def tokenised_pieces(docs: DataFrame, path: Callable[[], str], end: int = 2, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for the pieces of every document, ids and ``end`` last.

    A null text is empty: a single piece with ``end`` alone. Rows that repeat a doc_id are cut each on their own.
    """

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, ids in zip(frame["doc_id"], token_ids([t or "" for t in frame["text"]], path()), strict=True):
                ids += np.array([end], "<u4").tobytes()
                n = len(ids) // 4
                for a in range(0, n, window):
                    part = ids[4 * a : 4 * (a + window)]
                    out.append((doc_id, a, len(part) // 4, zlib.crc32(part), n))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: Callable[[], str] = tokenizer_path, window: int = WINDOW) -> DataFrame:
    """Cut all documents into full windows and a rest, and pack the pieces by best fit, longest first.

    An empty table gives an empty result.
    """
    pieces = materialise(tokenised_pieces(docs, path, window=window))
    order = [F.col("doc_id").asc_nulls_first(), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")]
    return place(pieces, order, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def packed_windows(spark: SparkSession, placed: DataFrame) -> DataFrame:
    """One row per sequence with its pieces in order of their offsets."""
    return placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces"), F.sum("length").alias("used"))
