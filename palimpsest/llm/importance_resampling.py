"""Operator 11: importance resampling of documents towards the distribution of a target corpus.

Features are the runs of 1 to 3 consecutive words, counted in BUCKETS buckets by CRC-32. A bucket's gain compares its
share in the target with its share in the documents; a document's weight is the sum of its features' gains, and its score
the weight plus Gumbel noise of its id, so that the highest scores are a sample without replacement.

The vocabulary has a head and a tail. Every document is counted for the head: its tasks keep bounded counts of words and
word pairs, which are summed over tasks. The most frequent words are broadcast with their CRC states, and the most
frequent pairs with their states and buckets, both bounded. What isn't in the head takes its CRC directly: words over their
bytes, longer features by continuing the state of the words before with a space and the next word. Both give the same,
exact buckets, so the head decides about time alone. Totals of buckets are exact sums over all texts.

Nulls and texts without a word have no features and weight 0. A null id counts as an empty one in the noise. Repeated rows
each have a rank of their own; of rows with equal score and id, which of the ranks is whose isn't defined. Very long texts are taken in
pieces that share two words. Extra columns pass through unless they bear the name of a result. An empty target or table of documents has no
features; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ship, table, written
from palimpsest.llm.decontamination import words_of

BUCKETS = 10_000
#: Words and pairs of the head; those that a task reports for it, and the counts that it keeps of either.
HEAD_WORDS, HEAD_PAIRS = 1 << 15, 1 << 16
TASK_WORDS, TASK_PAIRS, TASK_COUNTS = 1 << 12, 1 << 13, 1 << 18
#: Characters of a text that are taken apart at once, and words whose features are made at once.
PIECE_CHARS, RUN_WORDS = 1 << 20, 1 << 17
#: Words of more bytes are continued one by one.
SHIFTED = 63
SLOTS = 1 << 18
_BREAK = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


def _shifts() -> np.ndarray:
    """By number of bytes, byte of a CRC state and its value: what the state becomes when so many zero bytes follow."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= step[0]
    made = np.empty((SHIFTED + 2, 4, 256), np.uint32)
    made[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(1, SHIFTED + 2):
        made[k] = step[made[k - 1] & 255] ^ (made[k - 1] >> 8)
    return made.ravel()


class Head(NamedTuple):
    """What is broadcast: the frequent words and, as numbers of words, the frequent pairs."""

    words: list[bytes]
    pairs: list[tuple[int, int]]


class Features:
    """The CRC states of the features that end at each word of a run."""

    def __init__(self, head: Head) -> None:
        self.shifts = _shifts()
        self.size = len(head.words)
        self.number = {w: i for i, w in enumerate(head.words)}
        self.words = self._states(head.words)
        self.pair_key, self.pair_state = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.uint32)
        self.pair_bucket = np.zeros(SLOTS, np.int64)
        # of two pairs with one place the more frequent, the last that is set, stays
        a, b = np.array(head.pairs[::-1], np.int64).reshape(-1, 2).T
        key = a * self.size + b
        state = np.fromiter((zlib.crc32(b" " + head.words[j], zlib.crc32(head.words[i])) for i, j in head.pairs[::-1]), np.uint32, len(key))
        at = self._slot(key)
        self.pair_key[at], self.pair_state[at], self.pair_bucket[at] = key, state, state % BUCKETS

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B1 >> 13) & (SLOTS - 1)

    @staticmethod
    def _states(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words: their states, those of a space and the word, and their bytes."""
        n = len(words)
        return (
            np.fromiter(map(zlib.crc32, words), np.uint32, n),
            np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, n),
            np.fromiter(map(len, words), np.int64, n),
        )

    def buckets(self, words: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The buckets of the 1 to 3 words that end at each word; place counts the words before it in its text, of which
        a longer feature needs some: where there are fewer, its bucket means nothing."""
        tail: dict[bytes, int] = {}
        known, size = self.number, self.size
        ids = np.fromiter((known[w] if w in known else size + tail.setdefault(w, len(tail)) for w in words), np.int64, len(words))
        rest = list(tail)
        state, spaced, length = (np.concatenate(x) for x in zip(self.words, self._states(rest), strict=True))
        one = state[ids]
        key = ids[:-1] * size + ids[1:]
        at = self._slot(key)
        frequent = (self.pair_key[at] == key) & (ids[:-1] < size) & (ids[1:] < size)
        two, two_bucket = one.copy(), np.zeros(len(ids), np.int64)
        two[1:][frequent], two_bucket[1:][frequent] = self.pair_state[at][frequent], self.pair_bucket[at][frequent]
        unseen = 1 + np.flatnonzero(~frequent & (place[1:] >= 1))
        two[unseen] = self._continued(one[unseen - 1], ids[unseen], spaced, length, words, unseen)
        two_bucket[unseen] = two[unseen] % BUCKETS
        three = one.copy()
        ends = np.flatnonzero(place >= 2)
        three[ends] = self._continued(two[ends - 1], ids[ends], spaced, length, words, ends)
        return (one % BUCKETS).astype(np.int64), two_bucket, (three % BUCKETS).astype(np.int64)

    def _continued(self, state: np.ndarray, ids: np.ndarray, spaced: np.ndarray, length: np.ndarray, words: list[bytes], at: np.ndarray) -> np.ndarray:
        """The states after a space and the next word."""
        n = length[ids]
        base, z = (np.minimum(n, SHIFTED) + 1) * 1024, self.shifts
        out = z[base + (state & 255)] ^ z[base + 256 + (state >> 8 & 255)] ^ z[base + 512 + (state >> 16 & 255)] ^ z[base + 768 + (state >> 24)] ^ spaced[ids]
        for i in np.flatnonzero(n > SHIFTED).tolist():
            out[i] = zlib.crc32(b" " + words[at[i]], int(state[i]))
        return out


def _pieces(text: str | None):
    """(words, how many of the first ones are of the piece before): two for the pieces of a very long text, but for its first."""
    if text is None or len(text) <= PIECE_CHARS:
        yield words_of(text), 0
        return
    start, before = 0, []
    while start < len(text):
        cut = _BREAK.search(text, start + PIECE_CHARS)
        end = cut.start() if cut else len(text)
        words = before + words_of(text[start:end])
        yield words, len(before)
        start, before = end, words[-2:]


def _runs(texts: list[str | None]):
    """(words, place of each in its piece, whether it is new, first word of each piece, text of each piece): pieces of about RUN_WORDS words."""
    held: list[tuple[int, list[bytes], int]] = []
    n = 0

    def run():
        words = [w for _, ws, _ in held for w in ws]
        sizes = np.fromiter((len(ws) for _, ws, _ in held), np.int64, len(held))
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(words)) - np.repeat(first, sizes)
        new = place >= np.repeat(np.fromiter((c for *_, c in held), np.int64, len(held)), sizes)
        return words, place, new, first, np.fromiter((i for i, *_ in held), np.int64, len(held))

    for i, text in enumerate(texts):
        for words, carried in _pieces(text):
            if len(words) > carried:
                held.append((i, words, carried))
                n += len(words)
            if n >= RUN_WORDS:
                yield run()
                held, n = [], 0
    if held:
        yield run()


def _bounded(counts: Counter) -> Counter:
    """The counts without the least ones, if there are too many."""
    least = 1
    while len(counts) > TASK_COUNTS:
        counts, least = Counter({k: v for k, v in counts.items() if v > least}), least * 2
    return counts


def head_of(docs: DataFrame, text: str = "text", n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The head of the documents' vocabulary, from counts over all of them. Counts are lower bounds, as a task drops its
    rare entries."""
    ship(docs.sparkSession)

    def count(batches):
        words, pairs = Counter(), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for ws, carried in _pieces(t):
                    words.update(ws[carried:])
                    pairs.update(zip(ws[max(carried - 1, 0) :], ws[max(carried - 1, 0) + 1 :], strict=False))
                    words, pairs = _bounded(words), _bounded(pairs)
        rows = [(w, None, n) for w, n in words.most_common(TASK_WORDS)] + [(a, b, n) for (a, b), n in pairs.most_common(TASK_PAIRS)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "n"])

    counts = written(docs.select(text).mapInArrow(count, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "head")
    top = lambda rows, n: rows.orderBy(F.desc("n"), "a", "b").limit(n).collect()
    words = [bytes(r["a"]) for r in top(counts.filter("b IS NULL"), n_words)]
    number = {w: i for i, w in enumerate(words)}
    pairs = [(number.get(bytes(r["a"])), number.get(bytes(r["b"]))) for r in top(counts.filter("b IS NOT NULL"), n_pairs)]
    return Head(words, [p for p in pairs if None not in p])


def bucket_totals(docs: DataFrame, head: Head, text: str = "text") -> np.ndarray:
    """The features in each bucket, over all documents: BUCKETS exact sums."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(head))

    def count(batches):
        features, total = Features(pickle.loads(shared.value)), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words, place, new, _, _ in _runs(batch.column(0).to_pylist()):
                for k, bucket in enumerate(features.buckets(words, place)):
                    total += np.bincount(bucket[new & (place >= k)], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    total = np.zeros(BUCKETS, np.int64)
    for r in docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: 1000 times the logarithm of its smoothed share in the target over that in the source, rounded down."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, head: Head, gain: np.ndarray, text: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight."""
    ship(docs.sparkSession)
    names = ["n_words", "n_features", "weight"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((head, gain)))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches):
        head, gain = pickle.loads(shared.value)
        features = Features(head)
        for batch in batches:
            n_words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for words, place, new, first, of in _runs(batch.column(text).to_pylist()):
                each = sum(np.where(new & (place >= k), gain[bucket], 0) for k, bucket in enumerate(features.buckets(words, place)))
                np.add.at(weight, of, np.add.reduceat(each, first))
                np.add.at(n_words, of, np.add.reduceat(new.astype(np.int64), first))
            n_features = n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(n_features), pa.array(weight)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def noise(key: Column, seed: int = 42) -> Column:
    """Gumbel noise of a row's id in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, key: str = "doc_id", least_words: int = 20, percent: int = 5) -> DataFrame:
    """scored with rank: 1, 2, ... for the highest scores, `percent` of the rows of at least so many words; null for others.

    Rows are dealt by ranges of score, key and a number of the row, sorted within, and numbered by the counts of the ranges
    before, so that no task holds more than a range. They are shuffled whole: give it the columns that are wanted.
    """
    out = [c for c in scored.columns if c != "rank"]
    rows = written(scored.select(*out, F.monotonically_increasing_id().alias("__row")), "scored")
    fit = rows.filter(F.col("n_words") >= least_words)
    order = [F.desc("score"), F.asc(key), F.asc("__row")]
    n_ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(fit.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("__range", F.shiftright("__at", 33))
    # one row for each range
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", F.sum("__n").over(W.orderBy("__range")).alias("__to"), "__n").select("__range", (F.col("__to") - F.col("__n")).alias("__before"))
    wanted = fit.count() * percent // 100
    ranked = placed.join(F.broadcast(before), "__range").withColumn("rank", (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).cast("long"))
    ranked = ranked.select(*out, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    unfit = rows.filter(F.col("n_words") < least_words)
    return ranked.unionByName(unfit.select(*out, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 20, percent: int = 5, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, or all) with n_words, n_features, weight, score, and rank where a row is drawn."""
    head = head_of(docs, text)
    gain = gains(bucket_totals(docs, head, text), bucket_totals(target, head, text))
    scored = weighted(docs.drop("score", "rank"), head, gain, text).withColumn("score", F.col("weight") + noise(F.col(key)))
    columns = keep if keep is not None else [c for c in docs.columns if c not in ("n_words", "n_features", "weight", "score", "rank")]
    return drawn(scored.select(*columns, "n_words", "n_features", "weight", "score"), key, least_words, percent)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = resampled(docs, table(spark, sf_dir, "benchmark").select("text"), keep=["doc_id"])
    return done.select("doc_id", "n_features", "weight", "score", "rank")
