"""COPY in and out: CSV, text, JSON lines, binary and SQL formats, with an option parser."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"QCOPY1\n\0"
DEFAULTS = {"format": "csv", "delimiter": ",", "quote": '"', "escape": '"', "null": "\\N", "header": True}


def options(text: str) -> dict:
    """Options of "WITH (FORMAT csv, DELIMITER '|', HEADER true)"; unknown names are errors."""
    m = re.fullmatch(r"\s*(?:WITH\s*)?\((.*)\)\s*", text, re.I | re.S)
    if not m:
        raise ValueError("expected WITH (...)")
    out = dict(DEFAULTS)
    for name, quoted, bare in re.findall(r"(\w+)\s*(?:'((?:[^']|'')*)'|([^\s,]+))?\s*(?:,|$)", m[1]):
        key = name.lower()
        if key not in out:
            raise ValueError(f"unknown COPY option {name!r}")
        value = quoted.replace("''", "'").replace("\\t", "\t") if not bare else bare
        out[key] = value.lower() in ("", "true", "on", "1") if key == "header" else value.lower() if key == "format" else value
    if out["format"] == "text" and "delimiter" not in text.lower():
        out["delimiter"] = "\t"
    return out


def write(df: DataFrame, path: str, **given) -> None:
    """Write one folder of part files in the format asked for."""
    o = DEFAULTS | given
    if o["format"] == "csv":
        df.write.mode("overwrite").csv(path, sep=o["delimiter"], quote=o["quote"], escape=o["escape"], nullValue=o["null"], emptyValue='""', header=o["header"])
    elif o["format"] == "text":
        cells = [F.coalesce(F.col(c).cast("string"), F.lit(o["null"])) for c in df.columns]
        df.select(F.concat_ws(given.get("delimiter", "\t"), *cells)).write.mode("overwrite").text(path)
    elif o["format"] == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    elif o["format"] == "sql":
        df.select(insert_statement(df, given.get("table", "t"))).write.mode("overwrite").text(path)
    elif o["format"] == "binary":
        to_binary(df).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {o['format']!r}")


def read(spark: SparkSession, path: str, schema: str, **given) -> DataFrame:
    o = DEFAULTS | given
    if o["format"] == "csv":
        return spark.read.schema(schema).csv(path, sep=o["delimiter"], quote=o["quote"], escape=o["escape"], nullValue=o["null"], header=o["header"], multiLine=True)
    if o["format"] == "text":
        fields = spark.createDataFrame([], schema).schema.fields
        cells = F.split("value", re.escape(given.get("delimiter", "\t")), -1)
        return spark.read.text(path).select(*(F.nullif(cells[i], F.lit(o["null"])).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))
    if o["format"] == "json":
        return spark.read.schema(schema).json(path)
    if o["format"] == "binary":
        return from_binary(spark.read.parquet(path), schema)
    raise ValueError(f"format {o['format']!r} can't be read")


def insert_statement(df: DataFrame, table: str):
    """INSERT text of each row; strings in quotes, doubled inside."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    numeric = {c for c, t in df.dtypes if re.match(r"(tiny|small|big)?int|double|float|decimal|boolean", t)}
    values = F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string") if c in numeric else quoted(c), F.lit("NULL")) for c in df.columns))
    return F.concat(F.lit(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");"))


_BLOCK = 1 << 20  # bytes from which a block ends


def pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``rows`` rows and of about a megabyte, each on its own."""
    for batch in batches:
        out, n = bytearray(MAGIC), 0
        for place, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
            out += struct.pack(">h", len(row))
            for v in row:
                b = None if v is None else v.encode("utf-8")
                out += struct.pack(">i", -1) if b is None else struct.pack(">i", len(b)) + b
            n += 1
            if n >= rows or len(out) >= _BLOCK or place == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], ["block"])
                out, n = bytearray(MAGIC), 0


def unpack(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each block, on their own."""
    for batch in batches:
        for place in range(batch.num_rows):
            block = batch.column(0)[place].as_py()
            if not block.startswith(MAGIC):
                raise ValueError("not a COPY block")
            at, columns = len(MAGIC), [[] for _ in names]
            while at < len(block):
                (n,) = struct.unpack_from(">h", block, at)
                if n != len(names):
                    raise ValueError(f"a row of {n} fields for {len(names)} columns")
                at += 2
                for column in columns:
                    (size,) = struct.unpack_from(">i", block, at)
                    at += 4
                    column.append(None if size < 0 else block[at : at + size].decode("utf-8"))
                    at += max(size, 0)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names)


def to_binary(df: DataFrame, rows: int = 10000) -> DataFrame:
    """Binary blocks of at most ``rows`` rows: magic, then rows of a 16-bit field count and fields of a 32-bit length
    (-1: null) and UTF-8 bytes, in network order."""
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).mapInArrow(lambda batches: pack(batches, rows), "block binary")


def from_binary(blocks: DataFrame, schema: str) -> DataFrame:
    """Rows of the blocks; Python holds the rows of one block beside the batch that Spark sends."""
    fields = blocks.sparkSession.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]
    text = blocks.mapInArrow(lambda batches: unpack(batches, names), ", ".join(f"`{n}` string" for n in names))
    return text.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))


def parse_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content) of text, markdown and HTML files; HTML loses its tags."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("raw"))
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    plain = F.regexp_replace(F.regexp_replace("raw", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return files.select("path", kind.alias("kind"), F.when(kind.isin("html", "htm"), F.trim(F.regexp_replace(plain, r"\s+", " "))).otherwise(F.col("raw")).alias("content"))
