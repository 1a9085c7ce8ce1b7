"""Operator 13: token ids of documents packed into windows of a fixed size, with little padding.

A document's ids, with an end id, are first cut into full windows. What is left of documents is packed by best-fit
decreasing: longest first, each into the tightest open window that holds it, which a segment tree indexed by remaining
capacity finds. Where that leaves more than PADDING free in windows (say, many copies of one length just over a half),
pieces of the emptiest ones are cut to fill the others. The one window that then is left over is cut into powers of two, which aren't padded.

Documents are packed as they are tokenized, in groups of at most GROUP_DOCS documents or about GROUP_BYTES of ids, so no rows
are shuffled, a task's memory is bounded, and a task that is run again gives the same pieces. A sequence's number holds that of its partition.

The tokenizer encodes white-space separated strings apart, each distinct one once for a worker: no token and no special
string goes over white space. Plain words are encoded many at a time. A tokenizer file of another make encodes whole texts.

Nulls count as empty texts, of which there is only the end id. Repeated rows are packed each. Extra columns are given with each
piece unless they bear the name of a result; the text isn't. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ship, table
from palimpsest.llm.token_counts import tokenizer

WINDOW, END_ID = 2048, 1
#: Tokens that a window may lack before others' pieces are cut for it.
PADDING = 16
GROUP_DOCS, GROUP_BYTES = 8192, 32 << 20
#: Distinct strings whose ids a worker remembers, and bytes of ids in one batch of results.
REMEMBERED, BATCH_BYTES = 800_000, 16 << 20

# ASCII and Latin letters that are as they are in NFC and have one lower-case letter, then punctuation: two tokens' worth of text that no rule of the
# tokenizer joins. The apostrophe isn't in it, as "'s" is a word.
_PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")


@functools.lru_cache(maxsize=4)
def _end_of_word(path: str) -> np.ndarray | None:
    """Whether an id ends a word, for a file whose tokenizer takes words apart as is assumed here; None for any other."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    steps = [n["type"] for n in (known.get("normalizer") or {}).get("normalizers", ())]
    before = (known.get("pre_tokenizer") or {}).get("pretokenizers", ())
    words = len(before) == 2 and before[0]["type"] == "Split" and before[0]["behavior"] == "Removed" and before[0]["invert"] and before[0]["pattern"] == {"Regex": _WORDS} and before[1]["type"] == "ByteLevel" and not before[1]["add_prefix_space"]
    model = known["model"]
    # no special string is part of what _PLAIN takes
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) or _PLAIN.fullmatch("a" + t["content"]) for t in known.get("added_tokens", ()))
    if steps != ["NFC", "Replace", "Lowercase"] or not words or not plain or model["type"] != "BPE" or not model.get("end_of_word_suffix") or known.get("truncation") or known.get("padding"):
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
    return ends


#: Fixed value: how the known tokenizer splits words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Numbers(dict):
    """Numbers strings as they come; fresh are those since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, string):
        self[string] = n = len(self)
        self.fresh.append(string)
        return n


class _Slices:
    """Slices of an array of ids, by number."""

    def __init__(self) -> None:
        self.first, self.size, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def add(self, first: np.ndarray, size: np.ndarray) -> None:
        end = self.n + len(first)
        if end > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros(max(len(x), end), np.int64)]) for x in (self.first, self.size))
        self.first[self.n : end], self.size[self.n : end], self.n = first, size, end


class Ids:
    """Ids of texts, by those of their white-space separated strings; these by those of a word and what follows it."""

    def __init__(self, path: str) -> None:
        self.tok, self.ends = tokenizer(path), _end_of_word(path)
        self._forget()

    def _forget(self) -> None:
        self.strings, self.parts, self.of_strings, self.of_parts = _Numbers(), _Numbers(), _Slices(), _Slices()
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.ends is None:
            return [np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        if len(self.strings) > REMEMBERED:
            self._forget()
        strings = [t.encode().split() for t in texts]
        counts = np.fromiter(map(len, strings), np.int64, len(strings))
        each = np.fromiter(map(self.strings.__getitem__, itertools.chain.from_iterable(strings)), np.int64, int(counts.sum()))
        self._learn()
        ids, ends = self._gather(self.of_strings.first[each], self.of_strings.size[each])
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:b] for a, b in itertools.pairwise(edges.tolist())]

    def _gather(self, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slices one after another, and where each ends."""
        ends = np.cumsum(size)
        return self.flat[np.arange(int(size.sum())) + np.repeat(first - (ends - size), size)], ends

    def _keep(self, ids: np.ndarray) -> int:
        """Where ids begin, once they are kept."""
        first, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[first : self.used] = ids
        return first

    def _learn(self) -> None:
        fresh, number = self.strings.fresh, self.parts.__getitem__
        pairs = np.full((len(fresh), 2), -1, np.int64)
        for i, s in enumerate(fresh):
            string = s.decode()
            m = _PLAIN.fullmatch(string)
            pairs[i, 0] = number(m[1].lower() if m else string)
            if m and m[2]:
                pairs[i, 1] = number(m[2])
        fresh.clear()
        self._learn_parts()
        first, size = self.of_parts.first[pairs], np.where(pairs < 0, 0, self.of_parts.size[pairs])
        # a string of two parts gets their ids next to each other
        two = np.flatnonzero(pairs[:, 1] >= 0)
        ids, _ = self._gather(first[two].ravel(), size[two].ravel())
        total = size.sum(axis=1)
        at = self._keep(ids)
        first[two, 0] = at + np.cumsum(total[two]) - total[two]
        self.of_strings.add(first[:, 0], total)

    def _learn_parts(self) -> None:
        fresh = self.parts.fresh
        word = np.fromiter(((m := _PLAIN.fullmatch(s)) is not None and not m[2] for s in fresh), bool, len(fresh))
        first, size = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        places = np.flatnonzero(word)
        for k in range(0, len(places), 2000):
            # many words at a time; each ends with the id of a word's end
            some = places[k : k + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join([fresh[i] for i in some])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer takes words apart in another way than its file says")
            starts = np.concatenate([[0], ends[:-1]])
            first[some], size[some] = self._keep(ids) + starts, ends - starts
        places = np.flatnonzero(~word)
        for k in range(0, len(places), 4096):
            some = places[k : k + 4096]
            found = [e.ids for e in self.tok.encode_batch_fast([fresh[i] for i in some], add_special_tokens=False)]
            size[some] = n = np.fromiter(map(len, found), np.int64, len(found))
            first[some] = self._keep(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(n.sum()))) + np.cumsum(n) - n
        fresh.clear()
        self.of_parts.add(first, size)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities, of which each leaf has its windows."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._change(capacity, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of least capacity that is at least `need`; the window is open no more."""
        i, count = need + self.leaves, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._change(capacity, -1)
        return capacity, self.windows[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1


#: A piece: (item, start in it, length).
Piece = tuple[int, int, int]


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[Piece]]:
    """Windows of whole items (each at most a window long) by best-fit decreasing."""
    still, made = OpenWindows(window), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        capacity, at = still.take_tightest(n) or (window, len(made))
        if at == len(made):
            made.append([])
        made[at].append((item, 0, n))
        if capacity > n:
            still.add(capacity - n, at)
    return made


def filled(windows: list[list[Piece]], window: int = WINDOW, padding: int = PADDING) -> list[list[Piece]]:
    """The same ids in windows of which each lacks at most `padding`, or is a power of two long."""
    fill = [sum(n for *_, n in w) for w in windows]
    tight = lambda n: window - n <= padding or n & (n - 1) == 0
    out = [w for w, n in zip(windows, fill, strict=True) if tight(n)]
    loose = sorted((i for i, n in enumerate(fill) if not tight(n)), key=fill.__getitem__)
    low, high = 0, len(loose) - 1
    while low < high:
        giver, taker = windows[loose[low]], windows[loose[high]]
        gap = window - fill[loose[high]]
        while gap and giver:
            item, start, n = giver.pop()
            moved = min(gap, n)
            if moved < n:
                giver.append((item, start, n - moved))
            taker.append((item, start + n - moved, moved))
            gap -= moved
            fill[loose[low]] -= moved
        fill[loose[high]] = window - gap
        if not giver:
            low += 1
        if not gap:
            out.append(taker)
            high -= 1
    if low == high and fill[loose[low]]:
        out += [windows[loose[low]]] if tight(fill[loose[low]]) else _by_powers(windows[loose[low]], fill[loose[low]])
    return out


def _by_powers(pieces: list[Piece], total: int) -> list[list[Piece]]:
    out, rest = [], pieces[::-1]
    while total:
        left = 1 << (total.bit_length() - 1)
        total -= left
        out.append([])
        while left:
            item, start, n = rest.pop()
            part = min(left, n)
            if part < n:
                rest.append((item, start + part, n - part))
            out[-1].append((item, start, part))
            left -= part
    return out


def packed(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, padding: int = PADDING, text: str = "text", group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row for each piece: the columns of docs but the text; start, length and ids (little-endian unsigned 32-bit
    integers) of the piece in its document, of doc_tokens ids with the end id; sequence_id and offset, its place."""
    ship(docs.sparkSession)
    names = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    docs = docs.drop(*[n for n, _ in names])
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(n, kind) for n, kind in names]])

    def run(batches):
        ids_of, at = Ids(tokenizer_file), TaskContext.get().partitionId() << 33
        others, ids, held = [], [], 0

        def flush():
            nonlocal at, others, ids, held
            rows = pa.Table.from_batches(others)
            sequences = [[(i, k, window)] for i, x in enumerate(ids) for k in range(0, len(x) - window + 1, window)]
            left = [(i, len(x) // window * window, len(x) % window) for i, x in enumerate(ids) if len(x) % window]
            for w in filled(best_fit([n for *_, n in left], window), window, padding):
                sequences.append([(left[j][0], left[j][1] + start, n) for j, start, n in w])
            pieces = []
            for sequence in sequences:
                offset = 0
                for i, start, n in sequence:
                    pieces.append((i, start, n, at, offset))
                    offset += n
                at += 1
            some = max(1, BATCH_BYTES // (4 * window))
            for k in range(0, len(pieces), some):
                part = pieces[k : k + some]
                of = [p[0] for p in part]
                cut = [ids[i][start : start + n].astype("<u4").tobytes() for i, start, n, _, _ in part]
                columns = [
                    pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2] for p in part], pa.int64()),
                    pa.array(cut, pa.binary()),
                    pa.array([len(ids[i]) for i in of], pa.int64()),
                    pa.array([p[3] for p in part], pa.int64()),
                    pa.array([p[4] for p in part], pa.int64()),
                ]
                mine = rows.take(pa.array(of, pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays([*[c.chunk(0) for c in mine.columns[: len(kept)]], *columns], names=[*kept, *[n for n, _ in names]])
            others, ids, held = [], [], 0

        for batch in batches:
            texts = batch.column(text).to_pylist()
            for k in range(0, len(texts), 100):
                some = ids_of.of([t or "" for t in texts[k : k + 100]])
                ids += [np.append(x, np.uint32(end_id)) for x in some]
                others.append(batch.slice(k, 100).select([c for c in batch.schema.names if c != text]) if kept else batch.slice(k, 100))
                held += sum(4 * len(x) for x in some)
                if len(ids) >= group_docs or held >= GROUP_BYTES:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(*kept, text).mapInArrow(run, schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
