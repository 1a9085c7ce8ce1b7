"""Operator 8: benchmark passages in documents, by a generalised suffix automaton of the benchmark's words.

The words of a document are streamed through the automaton, which tracks the length of the longest benchmark passage
that ends at each of them. Passages of WINDOW words or more, and whole items of fewer words, are hits. Cleaning takes
their spans out of the text and gives up a document of which they cover more than a limit.

The benchmark is a stated query set: it goes through the documents in blocks of about BLOCK_WORDS words. A worker holds
the automaton of one block at a time and walks the blocks for some HELD_BYTES of documents at once, so that neither its
memory nor the number of workers grows with the benchmark. No rows are shuffled.

Nulls have no words, in documents as in items; items without an id count as "". Items with the same id are one item.
Repeated documents are treated alike; very long texts are streamed like others. Extra columns pass through unless they
bear the name of a result. An empty benchmark leaves all documents as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import pickle
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ship, table

WINDOW = 10
#: Share of a document's words above which it isn't worth cleaning.
MAX_COVERAGE = 0.5
#: Words of the benchmark that one automaton takes.
BLOCK_WORDS = 200_000
#: Bytes of documents that a worker takes through all blocks together, if there are several.
HELD_BYTES = 64 << 20

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
#: Lower-cases A-Z and turns every byte that is no part of a word into a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_spans", T.ArrayType(_SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """All word sequences of the items, with the items that hold each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.short: dict[int, dict[tuple[int, ...], set[str]]] = {}
        ends: list[tuple[int, str]] = []
        for item, words in items:
            coded = [self.ids.setdefault(w, len(self.ids)) for w in words]
            if 0 < len(coded) < window:
                self.short.setdefault(len(coded), {}).setdefault(tuple(coded), set()).add(item)
            last = 0
            for c in coded:
                last = self._extend(last, c)
                ends.append((last, item))
        self.shortest = min([window, *self.short])
        # the state that stands for the last `window` words of what a state stands for
        self.of_window = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[s] >= window:
                self.of_window[s] = s if self.length[self.link[s]] < window else self.of_window[self.link[s]]
        self.items: dict[int, set[str]] = {}
        for s, item in ends:
            if self.of_window[s] >= 0:
                self.items.setdefault(self.of_window[s], set()).add(item)

    def _extend(self, last: int, c: int) -> int:
        at = self.next[last].get(c)
        if at is not None:
            return at if self.length[at] == self.length[last] + 1 else self._split(last, c, at)
        new = self._state({}, -1, self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            at = self.next[p][c]
            self.link[new] = at if self.length[at] == self.length[p] + 1 else self._split(p, c, at)
        return new

    def _split(self, p: int, c: int, at: int) -> int:
        copy = self._state(dict(self.next[at]), self.link[at], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == at:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[at] = copy
        return copy

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (start, end) that hits cover, apart and in order; and the items that were hit."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        ids = np.fromiter(map(self.ids.get, words, itertools.repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                self._stream(ids[a:b].tolist(), a, spans, items)
        return spans, items

    def _stream(self, ids: list[int], base: int, spans: list, items: set[str]) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = run = 0
        for i, c in enumerate(ids):
            while state and c not in following[state]:
                state = link[state]
                run = length[state]
            if c in following[state]:
                state = following[state][c]
                run += 1
            if run < self.shortest:
                continue
            start = i + 1
            if run >= window:
                start = i + 1 - run
                items |= self.items.get(self.of_window[state if length[link[state]] < run else link[state]], set())
            for n, known in self.short.items():
                if run >= n and (found := known.get(tuple(ids[i + 1 - n : i + 1]))):
                    items |= found
                    start = min(start, i + 1 - n)
            if start <= i:
                _cover(spans, base + start, base + i + 1)


def _cover(spans: list[tuple[int, int]], start: int, end: int) -> None:
    while spans and start <= spans[-1][1]:
        a, b = spans.pop()
        start, end = min(start, a), max(end, b)
    spans.append((start, end))


def _blocks(benchmark: DataFrame, block_words: int):
    """The items in blocks, each of which the driver holds alone."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    words = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = -(-words // block_words)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r["id"], words_of(r["text"])) for r in part.toLocalIterator()]


_built: dict[str, SuffixAutomaton] = {}


class _Block:
    """A broadcast block, compressed, with a number that workers can remember its automaton by."""

    def __init__(self, sc, items: list, window: int) -> None:
        self.sent = sc.broadcast(zlib.compress(pickle.dumps((items, window)), 1))
        self.bid = uuid.uuid4().hex

    def automaton(self) -> SuffixAutomaton:
        """This block's automaton; that of the block before is forgotten first."""
        if self.bid not in _built:
            _built.clear()
            _built[self.bid] = SuffixAutomaton(*pickle.loads(zlib.decompress(self.sent.value)))
        return _built[self.bid]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, word_spans (of words that hits cover, end exclusive) and items (ids, sorted as strings)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_words", "word_spans", "items")
    blocks = [_Block(spark.sparkContext, items, window) for items in _blocks(benchmark, block_words)]
    return docs.mapInArrow(_through(blocks or [_Block(spark.sparkContext, [], window)]), T.StructType([*docs.schema.fields, *_FOUND]))


def _through(blocks: list[_Block]):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        order = list(blocks)
        for held in _held(batches, HELD_BYTES if len(blocks) > 1 else 0):
            texts = [t for batch in held for t in batch.column("text").to_pylist()]
            found: list[tuple[list, set]] = [([], set()) for _ in texts]
            counts = [0] * len(texts)
            for block in order:
                automaton = block.automaton()
                for i, text in enumerate(texts):
                    words = words_of(text)
                    spans, items = automaton.find(words)
                    counts[i] = len(words)
                    found[i][0].extend(spans)
                    found[i][1].update(items)
            # the next documents begin with the block whose automaton is at hand
            order.reverse()
            at = 0
            for batch in held:
                part = slice(at, at + len(batch))
                at += len(batch)
                spans = [[{"start": a, "end": b} for a, b in _merged(x)] for x, _ in found[part]]
                new = [pa.array(counts[part], pa.int64()), pa.array(spans, span), pa.array([sorted(x) for _, x in found[part]], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(f.name for f in _FOUND)])

    return run


def _held(batches, n_bytes: int):
    """Lists of neighbouring batches, each list ended by the batch with which it reaches n_bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= n_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for s in sorted(spans):
        _cover(merged, *s)
    return merged


def _without(text: str, spans: list[dict]) -> str:
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return "".join([*kept, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs with hits cut out of text, and n_words, word_spans and items of the text before; without those documents
    of which hits cover more than max_coverage."""
    found = find_benchmark(docs, benchmark, window)
    n_hit = F.aggregate("word_spans", F.lit(0), lambda t, s: t + s["end"] - s["start"])
    found = found.filter(n_hit <= max_coverage * F.col("n_words"))
    at = found.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [_without(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("word_spans").to_pylist(), strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Expressions hits (a row for each covered word) and sizes (n_words) of the documents of {docs}.
HITS_SQL = f"""
    dw AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM {{docs}}),
    iw AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
    ig AS (SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(CASE WHEN len(w) > 0 THEN list_transform(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1), lambda i: array_to_string(w[i : i + {WINDOW - 1}], ' ')) ELSE [] END) AS g FROM iw),
    sizes_of AS (SELECT DISTINCT n FROM ig),
    pos AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM dw, sizes_of),
    dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM pos),
    matched AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN ig ON dg.g = ig.g AND dg.n = ig.n),
    hits AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM matched)
"""
ORACLE = f"""
WITH {HITS_SQL.format(docs="documents")},
    h AS (SELECT doc_id, count(*) AS n_hit FROM hits GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM matched) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
