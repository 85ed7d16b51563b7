"""Retrieval data processing: chunkers, content hashes, reranking, metrics, extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ", "")  # paragraph, line, sentence, phrase, word, character


def fixed_chunks(text: str, size: int = 500, overlap: int = 50) -> list[tuple[int, int]]:
    """(start, end) spans of at most size characters that back up to white space and overlap; blank ones are left out."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            space = max(text.rfind(" ", start + 1, end), text.rfind("\n", start + 1, end))
            end = space if space > start else end
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def recursive_chunks(text: str, size: int = 500, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """Spans split at the coarsest separator that gives pieces of at most size, small neighbours joined."""

    def split(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if b - a <= size:
            return [(a, b)]
        sep = separators[level]
        if not sep:
            return [(i, min(i + size, b)) for i in range(a, b, size)]
        cuts, at = [], a
        while (i := text.find(sep, at, b)) >= 0:
            cuts.append(i + len(sep))
            at = i + len(sep)
        out: list[tuple[int, int]] = []
        for x, y in zip([a, *cuts], [*cuts, b], strict=True):
            for p, q in split(x, y, level + 1) if y - x > size else [(x, y)]:
                if out and q - out[-1][0] <= size:
                    out[-1] = (out[-1][0], q)
                elif q > p:
                    out.append((p, q))
        return out

    return [(a, b) for a, b in split(0, len(text), 0) if text[a:b].strip()]


def sentence_chunks(text: str, size: int = 500, similar: float = 0.1) -> list[tuple[int, int]]:
    """Sentences joined while they share words (Jaccard) with the chunk so far and fit."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^.!?\n]+[.!?]*\s*", text) if m[0].strip()]
    out: list[tuple[int, int]] = []
    words: set[str] = set()
    for a, b in spans:
        own = set(re.findall(r"\w+", text[a:b].lower()))
        if out and b - out[-1][0] <= size and len(own & words) >= similar * max(len(own | words), 1):
            out[-1] = (out[-1][0], b)
            words |= own
        else:
            out.append((a, b))
            words = own
    return out


_DEFINITION = re.compile(r"^(?:\s*(?:def|class|async def|func|function|fn|public|private|static|interface|struct|impl)\b)", re.M)


def code_chunks(text: str, size: int = 1500) -> list[tuple[int, int]]:
    """Spans from one definition to the next; longer ones are cut at lines."""
    starts = sorted({0, *(m.start() for m in _DEFINITION.finditer(text))})
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)], strict=True):
        out += [(a + x, a + y) for x, y in recursive_chunks(text[a:b], size, ("\n", ""))]
    return out


CHUNKERS = {"fixed": fixed_chunks, "recursive": recursive_chunks, "semantic": sentence_chunks, "code": code_chunks}


_CHARS = 1 << 20  # characters of chunks that leave together


def cut(batches: Iterator[pa.RecordBatch], chunker: Callable[..., list[tuple[int, int]]], options: dict) -> Iterator[pa.RecordBatch]:
    """Chunks of the texts of batches (key, text), in batches of about ``_CHARS`` characters or a text's chunks."""
    names = ["chunk_index", "start_char", "end_char", "content"]
    for batch in batches:
        keys, texts, rows, held, last = batch.column(0), batch.column(1), [], 0, batch.num_rows - 1
        for place in range(batch.num_rows):
            text = texts[place].as_py()
            if text:
                spans = chunker(text, **options)
                rows += [(place, i, a, b, text[a:b]) for i, (a, b) in enumerate(spans)]
                held += sum(b - a for a, b in spans)
            if rows and (held >= _CHARS or place == last):
                at, *columns = zip(*rows, strict=True)
                types = (pa.int32(), pa.int32(), pa.int32(), texts.type)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [batch.schema.names[0], *names])
                rows, held = [], 0


def chunk(docs: DataFrame, key: str, text: str, kind: str = "fixed", **options) -> DataFrame:
    """(key, chunk_index, start_char, end_char, content); null texts have no chunks. Python holds one text and about a
    megabyte of chunks beside the batch that Spark sends."""
    chunker = CHUNKERS[kind]
    return docs.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInArrow(lambda batches: cut(batches, chunker, options), f"{key} {dict(docs.dtypes)[key]}, chunk_index int, start_char int, end_char int, content string")


def table_markdown(rows: list[list[str]]) -> str:
    """Markdown of a table whose first row is its header."""
    width = max(map(len, rows), default=0)
    full = [[*r, *[""] * (width - len(r))] for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [*full[:1], ["---"] * width, *full[1:]]) if full else ""


def content_hash(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def changed_chunks(old: DataFrame, new: DataFrame, hash_column: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(added, removed) chunks by content hash."""
    return new.join(old.select(hash_column), hash_column, "left_anti"), old.join(new.select(hash_column), hash_column, "left_anti")


def token_jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def lightweight_rerank(query: list[str], content: Column, bm25: Column, vector: Column, chunk_index: Column, keyword: float = 0.4, text_weight: float = 0.3, vector_weight: float = 0.3, bonus: float = 0.05) -> Column:
    """Keyword coverage (the share of the query's words that the content holds as substrings; +0.2 where the content
    begins with the whole query, in any case) + BM25 + vector score + a bonus for first chunks - 0.02 for contents
    under 100 or over 2,000 bytes, held in 0..1."""
    low = F.lower(content)
    held = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in query), F.lit(0))
    coverage = held / max(len(query), 1)
    prefix = F.when(F.startswith(low, F.lit(" ".join(query).lower())), 0.2).otherwise(0.0) if query else F.lit(0.0)
    size = F.octet_length(content)
    score = keyword * (coverage + prefix) + text_weight * bm25 + vector_weight * vector + F.when(chunk_index == 0, bonus).otherwise(0.0) - F.when((size < 100) | (size > 2000), 0.02).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def multimodal_fusion(lists: dict[str, tuple[DataFrame, float]], key: str) -> DataFrame:
    """0.5 * weight / (60 + rank) + 0.5 * score, summed over the modalities' lists (key, rank, score)."""
    parts = None
    for df, w in lists.values():
        own = df.select(key, (0.5 * w / (60 + F.col("rank")) + 0.5 * F.col("score")).alias("part"))
        parts = own if parts is None else parts.union(own)
    return parts.groupBy(key).agg(F.sum("part").alias("score"))


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query_id of ``relevant`` (query_id, id): precision, recall, hit, reciprocal rank and nDCG at k of ``results``
    (query_id, id, rank from 1)."""
    hits = results.where(F.col("rank") <= k).join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    both = total.join(hits, "query_id", "left").fillna(0, ["hits"])
    return both.select("query_id", (F.col("hits") / k).alias("precision"), (F.col("hits") / F.col("n")).alias("recall"), (F.col("hits") > 0).cast("int").alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def answer_score(faithfulness: Column, relevance: Column, context: Column) -> Column:
    return 0.3 * faithfulness + 0.4 * relevance + 0.3 * context


# Patterns of the entity kinds.
ENTITIES = {
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
    "url": r"(https?://[^\s<>\"]+)",
    "date": r"(\d{4}-\d{2}-\d{2})",
    "phone": r"(\+?\d[\d\- ]{7,14}\d)",
    "name": r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b",
}


def entities(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, entity) found by the patterns, once each per document."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entity")))

    found = F.flatten(F.array(*(of(k, p) for k, p in ENTITIES.items())))
    return docs.select(key, F.explode(F.array_distinct(found)).alias("e")).select(key, "e.*")


def relations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, subject, verb, object) of sentences such as "X is Y", between capitalised names."""
    pattern = r"\b([A-Z]\w+)\s+(is|has|uses|contains|belongs to|works for)\s+(\w+)"
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("subject"), F.regexp_extract(m, pattern, 2).alias("verb"), F.regexp_extract(m, pattern, 3).alias("object")))
    return docs.select(key, F.explode(found).alias("r")).select(key, "r.*")


def merged_entities(found: DataFrame, key: str) -> DataFrame:
    """Entities that differ in case or white space alone, with their documents counted."""
    name = F.regexp_replace(F.lower(F.trim("entity")), r"\s+", " ")
    return found.groupBy("kind", name.alias("entity")).agg(F.count_distinct(key).alias("documents"))


def context_window(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", size: int = 3) -> DataFrame:
    """Each turn with the texts of the ``size`` turns before it, oldest first."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(-size, -1)
    return turns.withColumn("context", F.array_join(F.collect_list(text).over(w), "\n"))


def for_tenant(df: DataFrame, tenant, quota: int | None = None, order: str | None = None) -> DataFrame:
    rows = df.where(F.col("tenant_id") == F.lit(tenant))
    return rows if quota is None else rows.orderBy(*([order] if order else [])).limit(quota)
