"""Cuts memory content into chunks on Markdown boundaries.

Sizes are bytes of UTF-8. A text up to max_bytes is one chunk. A longer one is parted before lines that start with
`#` and before a blank line that follows another; neighbouring parts are joined up to target_bytes; what is still over
max_bytes is parted between lines. A line is never cut. Line numbers count from 1 in the trimmed text; a chunk of
joined parts ends as many lines after its start as it has line ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import SPACE, trim_space
from palimpsest.shipping import ship

TARGET_BYTES, MAX_BYTES = 400, 600

CHUNK = T.StructType(
    [
        T.StructField("seq", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ]
)
_ARROW_CHUNKS = pa.list_(pa.struct([("seq", pa.int32()), ("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))


def fill(sizes: list[int], gap: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours, each as long as its sizes with gaps between them stay within limit; one at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + gap + size > limit:
            yield start, i
            start, held = i, size
        else:
            held += size + (gap if i > start else 0)
    if sizes:
        yield start, len(sizes)


def _parts(lines: list[str]) -> list[tuple[str, int]]:
    """(text, first line) between the boundaries, without blank ones."""
    bare = [line.strip(SPACE) for line in lines]
    cuts = [i for i in range(1, len(lines)) if bare[i].startswith("#") or not (bare[i] or bare[i - 1])]
    edges = [0, *cuts, len(lines)]
    parts = (("\n".join(lines[a:b]).strip(SPACE), a + 1) for a, b in zip(edges, edges[1:], strict=False))
    return [p for p in parts if p[0]]


def chunk_text(content: str | None, target_bytes: int = TARGET_BYTES, max_bytes: int = MAX_BYTES) -> list[tuple[str, int, int]]:
    """(text, start_line, end_line) of each chunk."""
    size = lambda s: len(s.encode())
    text = (content or "").strip(SPACE)
    if not text:
        return []
    if size(text) <= max_bytes:
        return [(text, 1, 1 + text.count("\n"))]
    chunks: list[tuple[str, int, int]] = []
    parts = _parts(text.split("\n"))
    for a, b in fill([size(p) for p, _ in parts], 2, target_bytes):
        whole, first = "\n\n".join(p for p, _ in parts[a:b]), parts[a][1]
        if size(whole) <= max_bytes:
            chunks.append((whole, first, first + whole.count("\n")))
            continue
        lines = whole.split("\n")
        for i, j in fill([size(x) for x in lines], 1, target_bytes):
            if piece := "\n".join(lines[i:j]).strip(SPACE):
                chunks.append((piece, first + i, first + j - 1))
    return chunks


def with_chunks(rows: DataFrame, content: str = "content", target_bytes: int = TARGET_BYTES, max_bytes: int = MAX_BYTES, keep: bool = True) -> DataFrame:
    """rows with chunks: array<struct<seq, text, start_line, end_line>>. Only texts over max_bytes leave the JVM; they come back unless keep is off,
    with which rows have no content any more."""
    ship(rows.sparkSession)
    bare = trim_space(F.coalesce(content, F.lit("")))
    short = F.octet_length(bare) <= max_bytes
    one = F.struct(F.lit(0).alias("seq"), bare.alias("text"), F.lit(1).alias("start_line"), F.size(F.split(bare, "\n")).alias("end_line"))
    none = F.array().cast(T.ArrayType(CHUNK))
    brief = rows.filter(short).withColumn("chunks", F.when(bare == "", none).otherwise(F.array(one).cast(T.ArrayType(CHUNK))))
    names = [c for c in rows.columns if keep or c != content]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("chunks", T.ArrayType(CHUNK))])

    def run(batches):
        for batch in batches:
            found = [chunk_text(text, target_bytes, max_bytes) for text in batch.column(content).to_pylist()]
            ends = list(accumulate(map(len, found), initial=0))
            each = [(i, *chunk) for chunks in found for i, chunk in enumerate(chunks)]
            columns = zip(*each, strict=True) if each else [()] * len(CHUNK)
            held = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW_CHUNKS.value_type, strict=True)], fields=list(_ARROW_CHUNKS.value_type))
            chunks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], chunks], names=[*names, "chunks"])

    return brief.select(*names, "chunks").unionByName(rows.filter(~short).mapInArrow(run, schema))


def chunk_rows(memories: DataFrame, target_bytes: int = TARGET_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row (id, memory_id, seq, text, start_line, end_line) for each chunk of memories (id, content)."""
    rows = with_chunks(memories.select(F.col("id").alias("memory_id"), "content"), "content", target_bytes, max_bytes)
    rows = rows.select("memory_id", F.inline("chunks"))
    return rows.select(F.concat_ws("#", "memory_id", F.col("seq").cast("string")).alias("id"), "memory_id", "seq", "text", "start_line", "end_line")
