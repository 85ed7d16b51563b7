"""Tokens, postings, BM25 ranking, phrases, highlighting and rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column, least: int = 1, most: int | None = None, stopwords: list[str] | None = None, kind: str = "standard") -> Column:
    """Array of lower-case tokens: maximal runs of ASCII letters and digits ('standard'), runs without white space
    ('whitespace'), letters only ('simple'), the whole text ('keyword'), or runs of letters of any script with each
    CJK character on its own ('cjk')."""
    low = F.lower(text)
    out = {
        "standard": lambda: F.split(low, "[^a-z0-9]+"),
        "whitespace": lambda: F.split(low, r"\s+"),
        "simple": lambda: F.split(low, "[^a-z]+"),
        "keyword": lambda: F.array(low),
        "cjk": lambda: F.regexp_extract_all(low, F.lit(r"([㐀-鿿぀-ヿ]|[\p{L}\p{N}&&[^㐀-鿿぀-ヿ]]+)"), F.lit(1)),
    }[kind]()
    out = F.filter(out, lambda t: (F.length(t) >= max(least, 1)) & ((F.length(t) <= most) if most else F.lit(True)))
    return F.filter(out, lambda t: ~t.isin(stopwords)) if stopwords else out


def stem(token: Column) -> Column:
    """A light English stem: plural and -ing, -ed, -ly endings off words that keep three letters."""
    return F.regexp_replace(F.regexp_replace(token, r"(?<=[a-z]{3})(ing|edly|ed|ly)$", ""), r"(?<=[a-z]{2}[^s])s$", "")


def ngrams(array: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(array) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(array, i, n), " "))


def postings(docs: DataFrame, key: str, array: Column) -> DataFrame:
    """(key, term, tf, positions): one row for each term of each document."""
    return docs.select(key, F.posexplode(array).alias("pos", "term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def _occurrences(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term))


def _idf(n: Column, df: Column, kind: str) -> Column:
    if kind == "pipeline":
        return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0))
    return F.when(df == 0, F.log(n + 1)).otherwise(F.log((n - df + 0.5) / (df + 0.5) + 1))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75, delta: float = 0.0, kind: str = "standard", least: int = 1) -> DataFrame:
    """(key, score) of the documents that hold a query term; repeated terms count once.

    ``delta`` above 0 gives BM25+. Only query terms are exploded, each (document, term) once, and the corpus
    statistics are one row: the plan never groups the whole vocabulary.
    """
    terms = sorted(set(query))
    toks = docs.select(key, tokens(F.col(text), least).alias("toks")).withColumn("len", F.size("toks"))
    stats = toks.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.array_contains("toks", t)).alias(f"df{i}") for i, t in enumerate(terms))).first()
    if not terms or not stats["n"]:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    average = float(int(stats["avg"])) if kind == "pipeline" else float(stats["avg"])
    parts = []
    for i, t in enumerate(terms):
        tf = _occurrences("toks", t)
        idf = _idf(F.lit(float(stats["n"])), F.lit(float(stats[f"df{i}"])), kind)
        gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / max(average, 1e-9)))
        parts.append(F.when(tf > 0, idf * (gain + delta)).otherwise(0.0))
    held = reduce(Column.__or__, (F.array_contains("toks", t) for t in terms))
    return toks.where(held).select(key, reduce(Column.__add__, parts).alias("score"))


def bm25_fields(docs: DataFrame, key: str, fields: dict[str, float], query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25F: term frequencies of the fields add up by weight, each normalised by its field's average length."""
    terms = sorted(set(query))
    toks = docs.select(key, *(tokens(F.coalesce(f, F.lit(""))).alias(f"t_{f}") for f in fields))
    anywhere = lambda t: reduce(Column.__or__, (F.array_contains(f"t_{f}", t) for f in fields))
    stats = toks.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.size(f"t_{f}")).alias(f"a_{f}") for f in fields), *(F.count_if(anywhere(t)).alias(f"df{i}") for i, t in enumerate(terms))).first()
    parts = []
    for i, t in enumerate(terms):
        tf = reduce(Column.__add__, (w * _occurrences(f"t_{f}", t) / (1 - b + b * F.size(f"t_{f}") / max(float(stats[f"a_{f}"] or 0), 1e-9)) for f, w in fields.items()))
        parts.append(F.when(tf > 0, _idf(F.lit(float(stats["n"])), F.lit(float(stats[f"df{i}"])), "standard") * tf * (k1 + 1) / (tf + k1)).otherwise(0.0))
    return toks.where(reduce(Column.__or__, map(anywhere, terms))).select(key, reduce(Column.__add__, parts).alias("score"))


def match(text: Column, query: str, min_match: int = 1) -> Column:
    """Whether at least min_match of the query's terms occur."""
    toks = tokens(text)
    terms = sorted({t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    return reduce(Column.__add__, (F.array_contains(toks, t).cast("int") for t in terms), F.lit(0)) >= min_match


def fuzzy_match(text: Column, term: str, edits: int = 1) -> Column:
    return F.exists(tokens(text), lambda t: F.levenshtein(t, F.lit(term)) <= edits)


def phrase(text: Column, words: list[str]) -> Column:
    """Whether the words occur next to each other, in order."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))


def highlight(text: Column, terms: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with whole-word occurrences of the terms between markers, in any case."""
    words = "|".join(t for t in terms if t.isalnum())
    return F.regexp_replace(text, rf"(?i)\b({words})\b", f"{before}$1{after}") if words else text


def expand(query: list[str], synonyms: dict[str, list[str]]) -> list[str]:
    return list(dict.fromkeys(x for t in query for x in (t, *synonyms.get(t, []))))


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """Feature-hashed token counts with signs, of unit length (zeros for no tokens)."""
    cells = F.transform(tokens(text), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dims)).cast("int").alias("i"), F.when(F.xxhash64(t, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(cells, lambda c: c["i"] == d), F.lit(0.0), lambda a, c: a + c["s"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def top(scored: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best with ranks from 1, ties to smaller keys."""
    best = scored.orderBy(F.col(score).desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), key)))


def rrf(lists: list[DataFrame], key: str, k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank): sum of weight / (k + rank)."""
    parts = [x.select(key, (F.lit(w) / (k + F.col("rank"))).alias("part")) for x, w in zip(lists, weights or [1.0] * len(lists), strict=True)]
    return reduce(DataFrame.union, parts).groupBy(key).agg(F.sum("part").alias("score"))


def weighted_fusion(a: DataFrame, b: DataFrame, key: str, weight: float) -> DataFrame:
    """weight * a + (1 - weight) * b of two score lists; a missing score is 0."""
    both = a.select(key, F.col("score").alias("_a")).join(b.select(key, F.col("score").alias("_b")), key, "full")
    return both.select(key, (weight * F.coalesce("_a", F.lit(0.0)) + (1 - weight) * F.coalesce("_b", F.lit(0.0))).alias("score"))


def min_max(scored: DataFrame, score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 over all rows; 0.5 where all are equal."""
    low, high = scored.agg(F.min(score), F.max(score)).first()
    scaled = (F.col(score) - low) / (high - low) if low is not None and high > low else F.lit(0.5)
    return scored.withColumn(score, scaled)
