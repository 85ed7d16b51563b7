"""Vector distances, exact and approximate nearest neighbours, quantised codes and rerankers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """'l2', 'l2_squared', 'cosine' (1 where a length is zero), 'ip' (negated inner product) or 'hamming' of longs."""
    if metric == "cosine":
        n = norm(a) * norm(b)
        return F.when(n == 0, 1.0).otherwise(1 - dot(a, b) / F.nullif(n, F.lit(0.0)))
    if metric == "hamming":
        return F.bit_count(a.bitwiseXOR(b))
    return {"l2": lambda: F.sqrt(l2_squared(a, b)), "l2_squared": lambda: l2_squared(a, b), "ip": lambda: -dot(a, b)}[metric]()


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def knn(df: DataFrame, key: str, query: list[float], k: int = 10, metric: str = "l2", condition: Column | None = None, vector: str = "embedding", offset: int = 0) -> DataFrame:
    """Exact nearest neighbours of one vector, filtered first: (key, distance, rank), ties to smaller keys. Each
    partition keeps its k best."""
    rows = df if condition is None else df.where(condition)
    best = rows.select(key, distance(F.col(vector), literal(query), metric).alias("distance")).orderBy("distance", key).limit(k + offset)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", key))).where(F.col("rank") > offset)


def within_radius(df: DataFrame, key: str, query: list[float], radius: float, metric: str = "l2", vector: str = "embedding") -> DataFrame:
    return df.select(key, distance(F.col(vector), literal(query), metric).alias("distance")).where(F.col("distance") <= radius)


def least_hashed(df: DataFrame, vector: str, sample: int) -> DataFrame:
    """The rows (vector) of the ``sample`` least hashes, in their order.

    A sort with a limit would send so many vectors of every partition to one task. So rows beyond a bound of the hash,
    which rises until it covers the sample, are left out before, and equal vectors are counted.
    """
    hashed = df.select(F.xxhash64(vector).alias("_h"), F.col(vector).alias(vector))
    n = df.count()
    share = (1.1 * sample + 100) / max(n, 1)
    while True:
        low = hashed if share >= 1 else hashed.where(F.col("_h") <= int(-(2**63) + share * 2**64))
        some = low.groupBy("_h").agg(F.min(vector).alias(vector), F.count(F.lit(1)).alias("_n"))
        if share >= 1 or (low.count() >= sample):
            break
        share *= 2
    copies = F.array_repeat(vector, F.least("_n", F.lit(sample)).cast("int"))
    return some.orderBy("_h").limit(sample).select(F.explode(copies).alias(vector)).limit(sample)


def centroids(df: DataFrame, lists: int, vector: str = "embedding", seed: int = 42, sample: int = 20000) -> np.ndarray:
    """k-means centres, fitted on a bounded sample of rows: those of the least hashes, in their order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = least_hashed(df, vector, sample).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return np.array(KMeans(k=lists, seed=seed, maxIter=15).fit(rows).clusterCenters())


def nearest_list(vector: Column, centres: np.ndarray) -> Column:
    """Number of the nearest centre, by a vectorised UDF over Arrow batches."""

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.empty((0, centres.shape[1]))
        return pd.Series(((centres**2).sum(1) - 2 * m @ centres.T).argmin(1))

    return nearest(vector)


def ivf_index(df: DataFrame, lists: int, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Every row with its list; write it partitioned by ``list`` so that searches read the probed lists only."""
    centres = centroids(df, lists, vector)
    return df.withColumn("list", nearest_list(F.col(vector), centres)), centres


def ivf_search(index: DataFrame, centres: np.ndarray, key: str, query: list[float], k: int, probes: int, vector: str = "embedding") -> DataFrame:
    near = ((centres - np.array(query)) ** 2).sum(1).argsort()[:probes]
    return knn(index, key, query, k, "l2", F.col("list").isin([int(x) for x in near]), vector)


def choose_index(n: int, memory_mb: int = 0, recall: float = 0.9) -> tuple[str, int, int]:
    """(kind, lists, probes): exact below 10,000 rows, IVF beyond, with 4 sqrt(n) lists in 64..4096 and 5 % probed
    (20 % where a recall above 0.95 is asked for)."""
    if n < 10_000:
        return "exact", 0, 0
    lists = min(max(int(4 * n**0.5), 64), 4096)
    return "ivf", lists, max(1, int(lists * (0.2 if recall > 0.95 else 0.05)))


def hyperplane_bits(vector: Column, dims: int, bits: int = 64, seed: int = 7) -> Column:
    """Signs of random projections as one long, for Hamming distance."""
    planes = np.random.default_rng(seed).normal(size=(dims, bits))

    @F.pandas_udf("long")
    def code(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float) @ planes > 0 if len(x) else np.empty((0, bits), bool)
        return pd.Series((m.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64))

    return code(vector)


def lsh_search(df: DataFrame, key: str, query: list[float], k: int, buckets: float = 1.0, tables: int = 8, vector: str = "embedding") -> DataFrame:
    """Approximate neighbours by random-projection buckets."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=buckets, numHashTables=tables, seed=3).fit(rows)
    return model.approxNearestNeighbors(rows, Vectors.dense(query), k, "distance").select(key, "distance")


def scalar_quantised(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, float, float]:
    """Rows with ``codes`` (0..255 over the corpus's range), and that range."""
    low, high = df.agg(F.min(F.array_min(vector)), F.max(F.array_max(vector))).first()
    low, high = float(low or 0), float(high or 0)
    step = (high - low) / 255 or 1.0
    return df.withColumn("codes", F.transform(vector, lambda x: F.round((x.cast("double") - low) / step).cast("short"))), low, step


def dequantised(codes: Column, low: float, step: float) -> Column:
    return F.transform(codes, lambda c: low + c * step)


def product_quantiser(df: DataFrame, parts: int, codes: int, dims: int, vector: str = "embedding") -> list[np.ndarray]:
    """Centres of each sub-space."""
    width = dims // parts
    return [centroids(df.select(F.slice(F.col(vector), i * width + 1, width).alias("v")), codes, "v") for i in range(parts)]


def product_codes(vector: Column, centres: list[np.ndarray]) -> Column:
    width = centres[0].shape[1]
    return F.array(*(nearest_list(F.slice(vector, i * width + 1, width), c) for i, c in enumerate(centres)))


def product_search(df: DataFrame, centres: list[np.ndarray], key: str, query: list[float], k: int, codes: str = "codes") -> DataFrame:
    """Asymmetric distances: the query's table of distances to each part's centres, summed over a row's codes."""
    width = centres[0].shape[1]
    q = np.array(query)
    tables = [((c - q[i * width : (i + 1) * width]) ** 2).sum(1) for i, c in enumerate(centres)]
    total = F.lit(0.0)
    for i, t in enumerate(tables):
        total = total + F.element_at(literal(t), F.col(codes)[i] + 1)
    return df.select(key, F.sqrt(total).alias("distance")).orderBy("distance", key).limit(k)


def two_stage(df: DataFrame, key: str, query: list[float], k: int, coarse: int, centres: list[np.ndarray], vector: str = "embedding") -> DataFrame:
    """Coarse candidates by product codes, then exact distances."""
    near = product_search(df, centres, key, query, coarse).select(key)
    return knn(df.join(near, key, "left_semi"), key, query, k, vector=vector)


def multi_metric(candidates: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of min-max scaled distance columns over the candidates (0.5 where all are equal), ascending."""
    w = Window.partitionBy(F.lit(0))
    total = F.lit(0.0)
    for c, x in weights.items():
        low, high = F.min(c).over(w), F.max(c).over(w)
        total = total + x * F.when(high > low, (F.col(c) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)
    return candidates.withColumn("score", total).orderBy("score", key)


def mmr(candidates: DataFrame, key: str, query_key: str, k: int, trade: float = 0.5, distance_column: str = "distance", vector: str = "embedding") -> DataFrame:
    """Maximal marginal relevance per query over its candidates (query_key, key, distance, vector).

    Picks k in turn by trade / (1 + distance) + (1 - trade) * least distance to those picked (0 for the first),
    ties to smaller keys: (query_key, key, rank).
    """
    types = dict(candidates.dtypes)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        x = np.stack(frame[vector].to_numpy()).astype(float)
        relevance, far, left, out = trade / (1 + frame[distance_column].to_numpy(float)), np.zeros(len(frame)), np.ones(len(frame), bool), []
        for _ in range(min(k, len(frame))):
            i = int(np.argmax(np.where(left, relevance + (1 - trade) * far, -np.inf)))
            gap = np.sqrt(((x - x[i]) ** 2).sum(1))
            far = gap if not out else np.minimum(far, gap)
            left[i] = False
            out.append(i)
        return pd.DataFrame({query_key: frame[query_key].iloc[0], key: frame[key].to_numpy()[out], "rank": np.arange(1, len(out) + 1, dtype=np.int32)})

    return candidates.groupBy(query_key).applyInPandas(pick, f"{query_key} {types[query_key]}, {key} {types[key]}, rank int")


def live(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows that aren't soft-deleted."""
    return df.join(tombstones.select(key), key, "left_anti")


def merged_delta(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """A base table under buffered additions, which replace rows of the same key."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta)
