"""Search by a stored index of segments: postings of terms and of byte trigrams, in blocks of neighbouring memories.

A segment numbers its memories by ref; a block is BLOCK of them. A row of postings is a term in a block, with the largest term
frequency, the least chunk length and the best priority and time in it. From these follows a bound of the score of whatever the
block holds, so that a ranked search under a limit opens the blocks of the best bounds first and then only those whose bound
reaches the last score so found: the rows are those of a full search. A row of grams is a trigram of folded bytes in a block,
with the memories whose content, key or chunks have it. A substring search intersects its rarest trigrams and reads the texts
of candidates alone, the newest first, until there are enough.

What is brought to the driver is bounded by the terms of a query, by a limit or by LITERAL blocks; where there are more blocks, they
are joined instead of being written into the scan's filter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import add, or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import LOWER, UPPER, as_timestamp, fold_ascii, is_odd, julian_day, like_substring, plain_tokens, query_terms, tokens
from palimpsest.operators import search
from palimpsest.operators.chunking import chunk_text
from palimpsest.operators.filters import visible
from palimpsest.shipping import ship

#: Memories of a block.
BLOCK = 128
#: Rows of trigrams or postings that a task gives back at once.
GRAM_ROWS = 20_000
#: Bytes of texts of which a task makes postings at once, in whole blocks; characters whose tokens are found at once.
RUN_BYTES, RUN_CHARS = 8 << 20, 2 << 20
#: In postings that were made by whole blocks, the term that all chunks of a block have; no token is empty.
EVERY = ""
#: Blocks that are written into a filter, blocks that a ranked search opens first, and memories whose texts a substring
#: search reads first (twice as many each time, up to the last number).
LITERAL, SEEDS, FIRST_READ, MOST_READ = 512, 32, 64, 4096
#: Trigrams of a query that are intersected.
RAREST = 6

Blocks = dict[str, list[int]]


class Index(NamedTuple):
    """The index of the live segments, each row with its batch, the name of the segment.

    postings: schema.POSTINGS; grams: schema.GRAMS; lengths: schema.LENGTHS (None if it was asked for without); gone: (batch, memory_id) of memories that were deleted for
    good and are still in their segment, or None; chunks and tokens count those of all segments, and of gone ones.
    rows(blocks) and texts(blocks) are the memory and chunk rows of some blocks (None: of all).
    """

    postings: DataFrame | None
    grams: DataFrame | None
    lengths: DataFrame | None
    gone: DataFrame | None
    chunks: int
    tokens: int
    rows: Callable[[Blocks | None], DataFrame]
    texts: Callable[[Blocks | None], DataFrame]


# making it


def weight(priority: Column) -> Column:
    return F.coalesce(*[F.when(priority == p, F.lit(w)) for p, w in search.SEARCH_PRIORITY.items()], F.lit(1.0))


def postings_of(chunks: DataFrame) -> DataFrame:
    """The postings of chunks (ref, seq, text, weight, created): a row for each term and block."""
    # a chunk's terms are counted in place; only its distinct ones are shuffled
    words = chunks.select("ref", "seq", "weight", "created", tokens(F.col("text")).alias("words"))
    counts = F.inline(search.term_counts(F.col("words")))
    counted = words.select("ref", "seq", "weight", "created", F.size("words").alias("dl"), counts).withColumn("tf", F.col("tf").cast("int"))
    entry = F.struct((F.col("ref") % BLOCK).cast("int").alias("ref"), "seq", "tf", "dl")
    rows = counted.groupBy("term", F.floor(F.col("ref") / BLOCK).cast("long").alias("block")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("tf").alias("max_tf"),
        F.min("dl").alias("min_dl"),
        F.max("weight").alias("max_weight"),
        F.max("created").alias("max_created"),
        F.array_sort(F.collect_list(entry)).alias("entries"),
    )
    return rows


#: What an entry of a posting has.
_ENTRY = ["ref", "seq", "tf", "dl"]


def packed(postings: DataFrame) -> DataFrame:
    """postings_of() as they are stored."""
    ship(postings.sparkSession)

    def run(batches):
        for batch in batches:
            held = batch.column("entries")
            each = np.stack([held.flatten().field(c).to_numpy() for c in _ENTRY], axis=1)
            sizes = pc.list_value_length(held).to_numpy()
            yield batch.set_column(batch.schema.get_field_index("entries"), "entries", _as_binary(each, np.append(0, np.cumsum(sizes))))

    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "entries" else f for f in postings.schema])
    return postings.mapInArrow(run, schema)


def _as_binary(entries: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The rows between the ends, each as one value (schema.POSTINGS)."""
    width = 2 if entries.max(initial=0) < 1 << 16 else 4
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * len(_ENTRY) * width).astype(np.int32)), pa.py_buffer(entries.astype(f"<u{width}").tobytes())])


def _whole_blocks(batches: Iterable[pa.RecordBatch], least: int = 0):
    """The same rows, which are in the order of ref, as tables of whole blocks, of `least` bytes if there are so many."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("ref").to_numpy() // BLOCK
        last = int(np.searchsorted(blocks, blocks[-1]))
        size += batch.nbytes
        if size >= least and (last or held and held[-1].column("ref")[-1].as_py() // BLOCK != blocks[-1]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, size = [], 0
        elif last:
            held.append(batch.slice(0, last))
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _by_blocks(rows: DataFrame, order: list[str], made: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str, least: int = 0) -> DataFrame:
    """What `made` gives of whole blocks: the rows are shuffled by block, what is made of them is not."""
    ship(rows.sparkSession)
    dealt = rows.repartition(block_of(F.col("ref"))).sortWithinPartitions(*order)

    def run(batches):
        for table in _whole_blocks(batches, least):
            yield from made(table)

    return dealt.mapInArrow(run, schema)


def _parts(arrays: list[pa.Array], names: list[str]):
    for a in range(0, len(arrays[0]), GRAM_ROWS):
        yield pa.RecordBatch.from_arrays([x[a : a + GRAM_ROWS] for x in arrays], names)


def _chunk_words(table: pa.Table):
    """Of chunks as _posted() has them, in order: ref, seq, weight, created and the number of tokens of each; then of each token its chunk; and all tokens."""
    whole, seq = table.column("text").to_pylist(), table.column("seq").to_pylist()
    row, seqs, texts, odd = [], [], [], []
    for i, text in enumerate(whole):
        if text is None:
            odd.append(i)
            continue
        cut = [text] if seq[i] is not None else [c for c, *_ in chunk_text(text)]
        row += [i] * len(cut)
        seqs += range(len(cut)) if seq[i] is None else [seq[i]]
        texts += cut
    words, dl, a, size = [], [], 0, 0
    for b, text in enumerate(texts):
        size += len(text) + 1
        if size >= RUN_CHARS or b + 1 == len(texts):
            found, n = plain_tokens(texts[a : b + 1])
            words.append(found)
            dl.append(n)
            a, size = b + 1, 0
    if odd:
        found = table.column("words").take(pa.array(odd)).combine_chunks()
        words.append(found.flatten())
        dl.append(pc.list_value_length(found).to_numpy())
    row, seqs = np.array(row + odd, np.int64), np.array(seqs + [seq[i] for i in odd], np.int64)
    dl = np.concatenate([np.empty(0, np.int64), *dl]).astype(np.int64)
    refs, weights, created = (table.column(c).to_numpy()[row] for c in ("ref", "weight", "created"))
    order = np.lexsort((seqs, refs))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [x[order] for x in (refs, seqs, weights, created, dl)], place.repeat(dl), pa.concat_arrays([pa.array([], pa.string()), *words])


def _block_postings(table: pa.Table):
    """Rows of schema.POSTINGS of whole blocks, in the order of terms and blocks; one for EVERY term too."""
    (refs, seq, weights, created, dl), row, words = _chunk_words(table)
    n = len(refs)
    if not n:
        return
    coded = pc.dictionary_encode(words)
    order = pc.sort_indices(coded.dictionary)
    terms = pa.concat_arrays([pa.array([EVERY]), coded.dictionary.take(order)])
    code = np.empty(len(order), np.int64)
    code[order.to_numpy()] = np.arange(1, len(order) + 1)
    blocks, block = np.unique(refs // BLOCK, return_inverse=True)
    keys, tf = np.unique((code[coded.indices.to_numpy()] * len(blocks) + block[row]) * n + row, return_counts=True)
    keys, tf = np.append(block * n + np.arange(n), keys), np.append(np.zeros(n, np.int64), tf)
    row, group = keys % n, keys // n
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    group = group[starts]
    least = lambda f, x: pa.array(f.reduceat(x, starts))
    entries = np.stack([refs[row] % BLOCK, seq[row], tf, dl[row]], axis=1)
    yield from _parts(
        [
            terms.take(pa.array(group // len(blocks))),
            pa.array(blocks[group % len(blocks)]),
            pa.array(np.diff(starts, append=len(keys))),
            least(np.maximum, tf.astype(np.int32)),
            least(np.minimum, dl[row].astype(np.int32)),
            least(np.maximum, weights[row]),
            least(np.maximum, created[row]),
            _as_binary(entries, np.append(starts, len(keys))),
        ],
        ["term", "block", "n", "max_tf", "min_dl", "max_weight", "max_created", "entries"],
    )


def _posted(rows: DataFrame) -> DataFrame:
    """The postings of rows (ref, seq, weight, created, text, words): chunks, of which those without text have their words; a text without seq is
    one that is to be cut. They are in order by runs of RUN_BYTES of text."""
    schema = "term string, block long, n long, max_tf int, min_dl int, max_weight double, max_created double, entries binary"
    return _by_blocks(rows, ["ref", "seq"], _block_postings, schema, RUN_BYTES)


def block_postings(chunks: DataFrame) -> DataFrame:
    """What packed(postings_of()) gives, by tasks that hold whole blocks, so that texts are shuffled and postings aren't; and a row of each
    block for EVERY term, which lists its chunks, those without tokens too."""
    odd = is_odd(F.col("text"))
    return _posted(chunks.select("ref", "seq", "weight", "created", F.when(~odd, F.col("text")).alias("text"), F.when(odd, tokens(F.col("text"))).alias("words")))


def memory_postings(rows: DataFrame, chunked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same of memories (ref, content, priority, created_at), which are cut where their postings are made; odd ones
    by chunked() before."""
    text = F.coalesce("content", F.lit(""))
    plain = rows.filter(~is_odd(text)).select(
        "ref", F.lit(None).cast("int").alias("seq"), weight(F.col("priority")).alias("weight"), julian_day(F.col("created_at")).alias("created"), text.alias("text"), F.lit(None).cast("array<string>").alias("words")
    )
    odd = chunked(rows.filter(is_odd(text)))
    return _posted(plain.unionByName(odd.select("ref", "seq", "weight", "created", F.lit(None).cast("string").alias("text"), tokens(F.col("text")).alias("words"))))


def lengths_of(postings: DataFrame, rows: DataFrame) -> DataFrame:
    """schema.LENGTHS by block_postings() and rows (ref, id)."""
    each = _inlined(postings.filter(F.col("term") == EVERY))
    each = each.groupBy("ref").agg(F.count(F.lit(1)).alias("chunks"), F.sum("dl").alias("tokens"))
    return each.join(rows.select("ref", F.col("id").alias("memory_id")), "ref")


#: A-Z folded, byte by byte.
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def block_grams(rows: DataFrame) -> DataFrame:
    """The trigrams of memories (ref, content, key) by tasks that hold whole blocks. Chunks have no others but such with a line end
    (what joins their parts), by which query_grams() doesn't look."""
    texts = rows.select("ref", F.explode(F.array("content", "key")).alias("text")).filter("octet_length(text) >= 3")
    return _by_blocks(texts, ["ref"], lambda table: _grams(table.column("ref").to_numpy(), table.column("text").combine_chunks()), "gram int, block long, refs array<int>")


def _grams(refs: np.ndarray, texts: pa.Array):
    """(gram, block, refs) of a batch of texts: the distinct trigrams of their bytes, each as a number, with the memories of a block that have it."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = np.diff(offsets)
    held = _FOLDED[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].astype(np.int64) if size.sum() else np.empty(0, np.int64)
    if len(held) < 3:
        return
    row = np.repeat(np.arange(len(size)), size)
    # those of one text alone
    at = np.flatnonzero(row[:-2] == row[2:])
    blocks, block = np.unique(refs // BLOCK, return_inverse=True)
    gram = (held[at] << 16) | (held[at + 1] << 8) | held[at + 2]
    keys = np.unique((block[row[at]] << 31) | (gram << 7) | (refs[row[at]] % BLOCK))
    starts = np.flatnonzero(np.append(True, np.diff(keys >> 7) != 0)) if len(keys) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), pa.array((keys & (BLOCK - 1)).astype(np.int32)))
    gram, block = ((keys[starts] >> 7) & 0xFFFFFF).astype(np.int32), blocks[keys[starts] >> 31]
    yield from _parts([pa.array(gram), pa.array(block), lists], ["gram", "block", "refs"])


def grams_of(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The trigrams of memories (ref, content, key) and of their chunks (ref, text), A-Z folded: a row for each and each block. A batch of
    texts, which are in the order of refs, gives one row for each trigram and block."""
    ship(rows.sparkSession)
    texts = rows.select("ref", F.explode(F.array("content", "key")).alias("text")).unionByName(chunks.select("ref", "text"))
    texts = texts.filter("octet_length(text) >= 3").select("ref", fold_ascii(F.col("text")).alias("text"))

    def run(batches):
        for batch in batches:
            yield from _grams(batch.column("ref").to_numpy(), batch.column("text"))

    each = texts.mapInArrow(run, "gram int, block long, refs array<int>")
    return each.groupBy("gram", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))


# reading some of it


def block_of(ref: Column) -> Column:
    return F.floor(ref / BLOCK).cast("long")


def in_blocks(ref: Column, blocks: Iterable[int]) -> Column:
    """Whether the ref is in one of the blocks, as ranges that a scan of rows in the order of ref can skip by."""
    ranges: list[list[int]] = []
    for b in sorted(blocks):
        if ranges and ranges[-1][1] == b:
            ranges[-1][1] = b + 1
        else:
            ranges.append([b, b + 1])
    return reduce(or_, [(ref >= a * BLOCK) & (ref < b * BLOCK) for a, b in ranges], F.lit(False))


def _literal(rows: DataFrame) -> Blocks | None:
    """(batch, block) rows as a value, unless there are more than LITERAL."""
    some = rows.select("batch", "block").distinct().limit(LITERAL + 1).collect()
    if len(some) > LITERAL:
        return None
    out: Blocks = {}
    for r in some:
        out.setdefault(r["batch"], []).append(r["block"])
    return out


def _only(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """Rows with batch and block, of the blocks alone."""
    return rows.filter(reduce(or_, [(F.col("batch") == s) & F.col("block").isin(b) for s, b in blocks.items()], F.lit(False)))


def _inlined(postings: DataFrame, *keep: str) -> DataFrame:
    """A row (keep, ref, seq, tf, dl) for each entry."""
    ship(postings.sparkSession)
    held = postings.select(*keep, "block", "n", "entries")

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            widths = pc.binary_length(batch.column("entries")).to_numpy() // (n * len(_ENTRY))
            for width, a in ((w, a) for w in (2, 4) for a in range(0, batch.num_rows, BLOCK)):
                rows = a + np.flatnonzero(widths[a : a + BLOCK] == width)
                each = np.frombuffer(b"".join(batch.column("entries").take(pa.array(rows)).to_pylist()), f"<u{width}").reshape(-1, len(_ENTRY)).astype(np.int32)
                rows = rows.repeat(n[rows])
                refs = batch.column("block").to_numpy()[rows] * BLOCK + each[:, 0]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in keep], pa.array(refs), *[pa.array(each[:, i]) for i in (1, 2, 3)]], [*keep, "ref", *_ENTRY[1:]])

    schema = T.StructType([*[held.schema[c] for c in keep], T.StructField("ref", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in _ENTRY[1:]]])
    return held.mapInArrow(run, schema)


def _entries(postings: DataFrame) -> DataFrame:
    rows = _inlined(postings, "batch", "term")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("tf", "dl")})


def _statistics(index: Index, terms: list[str]) -> tuple[float, float, dict[str, float]]:
    """The chunks, their mean length, and those that hold each term; what is gone doesn't count."""
    rows = index.postings.filter(F.col("term").isin(terms))
    df = {t: 0 for t in terms} | {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, words = index.chunks, index.tokens
    if index.gone is not None:
        gone = index.lengths.join(index.gone, ["batch", "memory_id"], "left_semi")
        less = gone.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
        n, words = n - less["chunks"], words - less["tokens"]
        blocks = gone.select("batch", block_of(F.col("ref")).alias("block")).distinct()
        held = _entries(rows.join(blocks, ["batch", "block"], "left_semi")).join(gone, ["batch", "ref"], "left_semi")
        for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect():
            df[r["term"]] -= r["n"]
    return float(n), words / n if n else 0.0, {t: float(v) for t, v in df.items()}


def _part(tf: Column, dl: Column, n: float, avgdl: float, df: float) -> Column:
    return search._bm25_part(tf, F.lit(df), F.lit(n), dl, F.lit(avgdl))


def _scored(postings: DataFrame, terms: list[str], n: float, avgdl: float, df: dict[str, float]) -> DataFrame:
    """(batch, ref, seq, bm25) of the chunks that hold all terms."""
    tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = _entries(postings).groupBy("batch", "ref", "seq", "dl").agg(*tf).filter(" AND ".join(f"tf{i} IS NOT NULL" for i in range(len(terms))))
    total = reduce(add, [_part(F.col(f"tf{i}"), F.col("dl"), n, avgdl, df[t]) for i, t in enumerate(terms)])
    return rows.select("batch", "ref", "seq", total.alias("bm25"))


def bm25_by_index(index: Index, query: str) -> DataFrame:
    """What search.bm25() gives, from the postings of the query's terms."""
    terms = query_terms(query)
    alive = index.lengths if index.gone is None else index.lengths.join(index.gone, ["batch", "memory_id"], "left_anti")
    if not terms:
        return alive.select(F.col("memory_id").alias("chunk_id"), "memory_id", F.lit(0.0).alias("bm25")).limit(0)
    found = _scored(index.postings.filter(F.col("term").isin(terms)), terms, *_statistics(index, terms)).join(alive, ["batch", "ref"])
    return found.select(F.concat_ws("#", "memory_id", F.col("seq").cast("string")).alias("chunk_id"), "memory_id", "bm25")


# ranked, under a limit


def search_score(rank: Column, as_of) -> Column:
    return weight(F.col("priority")) * search.PRIORITY + julian_day(F.col("created_at")) / julian_day(as_timestamp(as_of)) * search.RECENCY + rank * search.RANK


def block_bounds(index: Index, terms: list[str], as_of, n: float, avgdl: float, df: dict[str, float]) -> DataFrame:
    """(batch, block, bound): of blocks that have all terms, no score in it is higher than the bound."""
    part = reduce(lambda x, y: F.coalesce(x, y), [F.when(F.col("term") == t, _part(F.col("max_tf").cast("double"), F.col("min_dl").cast("double"), n, avgdl, df[t])) for t in terms])
    rows = index.postings.filter(F.col("term").isin(terms)).select("batch", "block", part.alias("part"), "max_weight", "max_created")
    each = rows.groupBy("batch", "block").agg(F.count(F.lit(1)).alias("terms"), F.sum("part").alias("part"), F.min("max_weight").alias("weight"), F.min("max_created").alias("created"))
    bound = F.col("weight") * search.PRIORITY + F.col("created") / julian_day(as_timestamp(as_of)) * search.RECENCY + F.col("part") * search.RANK
    # sums of the same parts in another order differ in the last digits
    return each.filter(F.col("terms") == len(terms)).select("batch", "block", (bound + F.abs(bound) * 1e-12).alias("bound"))


class Found(NamedTuple):
    """(batch, ref) of hits in order; how many blocks had all terms, and how many of these were opened."""

    refs: list[tuple[str, int]]
    blocks: int
    opened: int


def ranked_top(index: Index, query: str, as_of, ns: str | None = None, kind: str | None = None, limit: int = search.SEARCH_LIMIT) -> Found:
    """The first `limit` of what search.search_fts() finds."""
    terms = query_terms(query)
    if not terms or limit <= 0:
        return Found([], 0, 0)
    n, avgdl, df = _statistics(index, terms)
    if n == 0 or min(df.values()) <= 0:
        return Found([], 0, 0)
    bounds = block_bounds(index, terms, as_of, n, avgdl, df)
    seeds = bounds.orderBy(F.desc("bound"), "batch", "block").limit(SEEDS).collect()
    best: list = []

    def opened(blocks: Blocks | None, chosen: DataFrame | None) -> list:
        postings = index.postings.filter(F.col("term").isin(terms))
        postings = _only(postings, blocks) if blocks is not None else postings.join(chosen.select("batch", "block"), ["batch", "block"], "left_semi")
        hits = _scored(postings, terms, n, avgdl, df).groupBy("batch", "ref").agg(F.max("bm25").alias("rank"))
        rows = visible(index.rows(blocks), as_of, ns, kind).join(hits, ["batch", "ref"])
        top = rows.select("batch", "ref", "id", search_score(F.col("rank"), as_of).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
        return [(-r["score"], r["id"], r["batch"], r["ref"]) for r in top.collect()]

    first: Blocks = {}
    for r in seeds:
        first.setdefault(r["batch"], []).append(r["block"])
    best = opened(first, None) if seeds else []
    if len(seeds) < SEEDS:
        return Found([(b, ref) for *_, b, ref in sorted(best)], len(seeds), len(seeds))
    least = -sorted(best)[limit - 1][0] if len(best) >= limit else None
    rest = bounds.join(index.postings.sparkSession.createDataFrame([(r["batch"], r["block"]) for r in seeds], "batch string, block long"), ["batch", "block"], "left_anti")
    chosen = rest if least is None else rest.filter(F.col("bound") >= least)
    counts = rest.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lit(True) if least is None else F.col("bound") >= least).alias("opened")).first()
    if counts["opened"]:
        best += opened(_literal(chosen) if counts["opened"] <= LITERAL else None, chosen)
    return Found([(b, ref) for *_, b, ref in sorted(best)[:limit]], len(seeds) + counts["n"], len(seeds) + counts["opened"])


# substrings


def query_grams(query: str) -> list[int]:
    """The trigrams that every memory with the query has: those of its pieces between wildcards, without those with a line end, which a
    chunk may have where its content has none."""
    folded = query.translate(str.maketrans(UPPER, LOWER))
    pieces = [p.encode() for p in re.split("[%_\n]+", folded)]
    return sorted({int.from_bytes(p[i : i + 3], "big") for p in pieces for i in range(len(p) - 2)})


def candidates(index: Index, query: str) -> DataFrame | None:
    """(batch, ref) of the memories that have the query's rarest trigrams; None if it has none."""
    grams = query_grams(query)
    if not grams:
        return None
    rows = index.grams.filter(F.col("gram").isin(grams))
    counts = {r["gram"]: r["n"] for r in rows.groupBy("gram").agg(F.sum(F.size("refs")).alias("n")).collect()}
    rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    if any(g not in counts for g in grams):
        rows = rows.limit(0)
    held = rows.filter(F.col("gram").isin(rarest)).groupBy("batch", "block").agg(F.collect_list("refs").alias("all"))
    both = held.filter(F.size("all") == len(rarest)).select("batch", "block", F.reduce(F.slice("all", 2, RAREST), F.col("all")[0], lambda a, b: F.array_intersect(a, b)).alias("refs"))
    each = both.select("batch", "block", F.explode("refs").alias("ref"))
    return each.select("batch", (F.col("block") * BLOCK + F.col("ref")).alias("ref"))


def _matches(index: Index, query: str, blocks: Blocks | None, chosen: DataFrame) -> DataFrame:
    """Those of chosen (batch, ref, ...) whose content, key or chunks hold the query."""
    own = index.rows(blocks).join(chosen, ["batch", "ref"], "left_semi").filter(like_substring(F.col("content"), query) | like_substring(F.col("key"), query))
    if blocks is None and not re.search("[%_\n]", query):
        # what is on one line of a chunk is in its content
        return chosen.join(own.select("batch", "ref"), ["batch", "ref"], "left_semi")
    held = index.texts(blocks).join(chosen, ["batch", "ref"], "left_semi").filter(like_substring(F.col("text"), query))
    return chosen.join(own.select("batch", "ref").unionByName(held.select("batch", "ref")), ["batch", "ref"], "left_semi")


def search_like(index: Index, query: str, as_of, ns: str | None = None, kind: str | None = None) -> DataFrame:
    """All that search.search_like() finds, as (batch, ref, id, created_at), by candidates if the query has trigrams."""
    some = candidates(index, query)
    rows = visible(index.rows(None), as_of, ns, kind).select("batch", "ref", "id", "created_at")
    return _matches(index, query, None, rows if some is None else rows.join(some, ["batch", "ref"], "left_semi"))


def like_top(index: Index, query: str, as_of, ns: str | None = None, kind: str | None = None, limit: int = search.SEARCH_LIMIT) -> list[tuple[str, int]]:
    """(batch, ref) of the first `limit` of search_like(), the newest first. Texts are read of candidates alone, and only of as many as it takes."""
    order = [F.desc("created_at"), F.asc("id")]
    place = lambda rows: [(r["batch"], r["ref"]) for r in rows.orderBy(*order).limit(limit).collect()]
    if limit <= 0:
        return []
    some = candidates(index, query)
    if some is None:
        return place(search_like(index, query, as_of, ns, kind))
    blocks = _literal(some.withColumn("block", block_of(F.col("ref"))))
    rows = visible(index.rows(blocks), as_of, ns, kind).join(some, ["batch", "ref"], "left_semi").select("batch", "ref", "id", "created_at")
    spark, found, size, last = index.grams.sparkSession, [], FIRST_READ, None
    while len(found) < limit:
        # the next ones in order
        after = rows if last is None else rows.filter((F.col("created_at") < last["created_at"]) | ((F.col("created_at") == last["created_at"]) & (F.col("id") > last["id"])))
        part = after.orderBy(*order).limit(size).collect()
        if part:
            chosen = spark.createDataFrame(part, rows.schema)
            own: Blocks = {}
            for r in part:
                own.setdefault(r["batch"], []).append(r["ref"] // BLOCK)
            wanted = _matches(index, query, {s: sorted(set(b)) for s, b in own.items()}, F.broadcast(chosen))
            found += place(wanted)
        if len(part) < size:
            break
        last, size = part[-1], min(2 * size, MOST_READ)
    return found[:limit]


def keywords_top(index: Index, query: str, as_of, ns: str | None = None, kind: str | None = None, limit: int = search.SEARCH_LIMIT) -> list[tuple[str, int, int]]:
    """(batch, ref, place) of what search.search_keywords() finds. Texts aren't looked at if ranked hits fill the limit."""
    limit = limit if limit > 0 else search.SEARCH_LIMIT
    ranked = ranked_top(index, query, as_of, ns, kind, limit).refs
    like = like_top(index, query, as_of, ns, kind, limit - len(ranked))
    return [(b, r, i + 1) for i, (b, r) in enumerate(ranked)] + [(b, r, limit + i + 1) for i, (b, r) in enumerate(like) if (b, r) not in set(ranked)]


def rows_of(index: Index, hits: list[tuple[str, int, int]]) -> DataFrame:
    """The memory rows of hits (batch, ref, place), with place; of no other blocks."""
    blocks: Blocks = {}
    for batch, ref, _ in hits:
        blocks.setdefault(batch, []).append(ref // BLOCK)
    rows = index.rows({s: sorted(set(b)) for s, b in blocks.items()})
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(hits, "batch string, ref long, place int")), ["batch", "ref"])


def all_ranked(index: Index, query: str, as_of, ns: str | None = None, kind: str | None = None) -> DataFrame:
    """All that search.search_fts() finds, with score, by the postings."""
    best = bm25_by_index(index, query).groupBy("memory_id").agg(F.max("bm25").alias("rank"))
    rows = visible(index.rows(None), as_of, ns, kind).join(best, F.col("id") == F.col("memory_id"))
    return rows.withColumn("score", search_score(F.col("rank"), as_of))


def placed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.orderBy("place")))
