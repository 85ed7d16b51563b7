"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import batches_of, materialise, running_totals

EXACT = 1 << 53  # integers below are exact as doubles
LONG = (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a with rows of b, exact: by doubles where no sum can leave their
    exact range, else by Python's integers, held within 64 bits."""
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def bucket_search(query: np.ndarray, norm: float, theta: float, units: np.ndarray, norms: np.ndarray, focus: int) -> np.ndarray:
    """Rows of a bucket (lengths descending) that may score at least theta with the query.

    With a local cosine threshold t = theta / (norm * longest) above 1 the bucket holds none. A small t
    prunes by length: rows shorter than theta / norm end the scan. A large t prunes by coordinates: on each of
    the query's largest coordinates q, a unit row with a cosine of at least t lies in [q t - s, q t + s],
    s = sqrt((1 - t^2)(1 - q^2)); from q >= t on the upper end is 1, and from q <= -t on the lower end is -1.
    """
    if not len(norms) or theta <= 0 or norm == 0:
        return np.arange(len(norms)) if theta <= 0 else np.arange(0)
    slack = 1e-9
    t = theta / (norm * norms[0]) if norms[0] else np.inf
    if t > 1 + slack:
        return np.arange(0)
    end = int(np.searchsorted(-norms, -theta / norm * (1 - slack), side="right"))
    if t < 0.5:
        return np.arange(end)
    t = min(t, 1.0)
    unit = query / norm
    keep = np.arange(end)
    for f in np.argsort(-np.abs(unit))[:focus]:
        s = np.sqrt(max(0.0, (1 - t * t) * (1 - unit[f] ** 2))) + slack
        x = units[keep, f]
        low = -np.inf if unit[f] <= -t else unit[f] * t - s
        high = np.inf if unit[f] >= t else unit[f] * t + s
        keep = keep[(x >= low) & (x <= high)]
    return keep


class _Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[i], scores]), np.concatenate([self.ids[i], ids])
        best = np.lexsort((ids, ~scores))[: self.k]
        self.scores[i], self.ids[i] = scores[best], ids[best]

    def threshold(self, i: int) -> float:
        return float(self.scores[i][-1]) if len(self.scores[i]) == self.k else -np.inf


def _unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, "<i8")
    return ids, np.frombuffer(row.data, "<f8").reshape(len(ids), row.dim)


def _search(best: _Best, q_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, vectors: np.ndarray, focus: int) -> None:
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        norms = np.sqrt((vectors**2).sum(1))
        order = np.argsort(-norms, kind="stable")
        row_ids, vectors, norms = row_ids[order], vectors[order], norms[order]
        units = np.nan_to_num(vectors / norms[:, None])
        lengths = np.sqrt((queries**2).sum(1))
        for i, q in enumerate(queries):
            keep = bucket_search(q, lengths[i], best.threshold(i), units, norms, focus)
            keep = keep[row_ids[keep] != q_ids[i]]
            if len(keep):
                best.add(i, products(q[None], vectors[keep])[0], row_ids[keep])


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, bucket: int = 4096, block: int = 1024, focus: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, its own row left out.

    ``vectors`` has (vec_id, embedding); each component x counts as floor(1024 x). Vectors that are null, or
    hold null or non-finite components, take no part, nor do rows without vec_id. Ties go to smaller ids. Rows
    that repeat a vec_id all take part, but a query meets no row of its own id; equal query rows ask once. Vectors of different
    dimensions don't meet. Fewer candidates than k give fewer rows; an empty table gives none.

    Vectors are put in order of length and cut into buckets, queries into blocks, both of bounded size and
    packed as one binary row each. Every block first meets the longest bucket of its dimension; each query's
    k-th score there is its threshold. A block then goes to those buckets alone whose longest vector can still
    reach the lowest threshold of its queries; inside, queries prune by length or by coordinates and verify
    what is left. Blocks against buckets is the work of a stated query set; no all-pairs join is made.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    clean = clean.where("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    clean = clean.withColumns({"dim": F.size("v"), "norm": F.expr("sqrt(aggregate(v, 0d, (s, x) -> s + x * x))"), "h": F.xxhash64("v")})
    order = [F.col("norm").desc(), F.col("vec_id"), F.col("h")]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        data = np.floor(1024 * np.array(frame["v"].tolist(), "<f8").reshape(len(frame), -1))
        longest = float(np.sqrt((data**2).sum(1)).max())
        return pd.DataFrame([(frame["dim"].iloc[0], frame["part"].iloc[0], longest, frame["vec_id"].to_numpy("<i8").tobytes(), data.tobytes())], columns=["dim", "part", "longest", "ids", "data"])

    packed = "dim int, part long, longest double, ids binary, data binary"
    placed = materialise(running_totals(clean, order, [], ["dim"]))
    buckets = materialise(placed.withColumn("part", F.expr(f"pos div {bucket}")).groupBy("dim", "part").applyInPandas(pack, packed))
    queries = running_totals(placed.where("q").drop("pos").dropDuplicates(["vec_id", "h"]), order, [], ["dim"])
    blocks = materialise(queries.withColumn("part", F.expr(f"pos div {block}")).groupBy("dim", "part").applyInPandas(pack, packed))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q_ids, q = _unpack(row)
                best = _Best(len(q_ids), k)
                _search(best, q_ids, q, np.frombuffer(row.b_ids, "<i8"), np.frombuffer(row.b_data, "<f8").reshape(-1, row.dim) if row.dim else np.zeros((len(row.b_ids) // 8, 0)), focus)
                theta = np.array([best.threshold(i) for i in range(len(q_ids))])
                norms = np.sqrt((q**2).sum(1))
                level = np.where((theta > 0) & (norms > 0), theta / np.where(norms > 0, norms, 1), -np.inf)
                yield pd.DataFrame([(row.dim, row.part, float(level.min()), row.ids, row.data, theta.tobytes())], columns=["dim", "part", "level", "ids", "data", "theta"])

    seeds = buckets.where("part = 0").select("dim", F.col("ids").alias("b_ids"), F.col("data").alias("b_data"))
    with batches_of(spark, 4):
        started = materialise(blocks.join(seeds, "dim").mapInPandas(first, "dim int, part long, level double, ids binary, data binary, theta binary"))
    longest = buckets.groupBy("dim").agg(F.collect_list(F.struct("part", "longest")).alias("all"))
    met = started.select("dim", F.col("part").alias("block"), "level").join(longest, "dim").select("dim", "block", F.explode(F.expr("filter(all, b -> b.longest >= level * (1 - 1e-9))")).alias("b")).select("dim", "block", F.col("b.part").alias("part"))

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, best, q_ids = None, None, np.empty(0)

        def out() -> Iterator[pd.DataFrame]:
            if key is not None:
                n = [len(x) for x in best.ids]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, n), "vec_id": np.concatenate(best.ids), "score": np.concatenate(best.scores)})

        for frame in frames:
            for row in frame.itertuples():
                if key != (row.dim, row.block, row.span):
                    yield from out()
                    key = (row.dim, row.block, row.span)
                    q_ids = np.frombuffer(row.q_ids, "<i8")
                    queries = np.frombuffer(row.q_data, "<f8").reshape(len(q_ids), row.dim)
                    theta, best = np.frombuffer(row.theta, "<f8"), _Best(len(q_ids), k)
                    # A seed's threshold is beaten or matched by k rows in all buckets together.
                    best.threshold = lambda i, own=best.threshold, theta=theta: max(own(i), theta[i])
                _search(best, q_ids, queries, *_unpack(row), focus)
        yield from out()

    pairs = met.withColumn("span", F.expr("part div 4")).join(started.select("dim", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "theta"), ["dim", "block"]).join(buckets.select("dim", "part", "ids", "data"), ["dim", "part"])
    pairs = pairs.repartition("dim", "block", "span").sortWithinPartitions("dim", "block", "span", "part")
    with batches_of(spark, 4):
        found = materialise(pairs.mapInPandas(rest, "query_id long, vec_id long, score long"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
