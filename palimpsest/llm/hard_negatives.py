"""Operator 12: hard negatives of anchors, by exact integer scores from a residue-number-system matrix product.

Components are made integers by floor(SCALE * x). A score is the inner product of two vectors. It is computed modulo several small
primes, each product in float32, where sums of so many residues below 2**24 are exact, and put together by Chinese
remaindering; the primes are as many as the longest vector's square needs, counted over all rows. Vectors of other lengths
count as filled up with zeros.

Anchors are a stated query set. They go against all rows in broadcast blocks of at most BLOCK_BYTES, one after another: a task
keeps, for each anchor of a block, the best rows of its own, and window functions choose among the tasks' bests. First come
the positives, then, with the positives' scores broadcast too, the negatives within each positive's window of scores. Nothing but those bests is shuffled.

Rows with a null label, a null vector, or a null or non-finite component take no part; an empty vector has score 0 with all. Repeated rows are rows of
their own, each other's positives too. A null id isn't an anchor and comes last among equal scores. Scores that 64 bits can't hold are
an error, as in Spark's arithmetic. Extra columns play no part. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import ship, table, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Of a block of anchors, as 64-bit integers; rows and anchors that are multiplied at once.
BLOCK_BYTES = 32 << 20
TILE_ROWS, TILE_ANCHORS = 2048, 512
#: The largest primes below 1024, whose residues about 0 are at most 510: 64 products of two are below 2**24.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
#: Components that one float32 product takes.
DEPTH = 64
_NONE = np.iinfo(np.int64).min


class Residues:
    """Exact integer matrix products, for results of at most `largest` in size."""

    def __init__(self, largest: int) -> None:
        n = next((n for n in range(1, len(PRIMES) + 1) if math.prod(PRIMES[:n]) > 2 * largest), None)
        if n is None:
            raise ValueError("the scores don't fit in 64 bits")
        self.primes, self.product = PRIMES[:n], math.prod(PRIMES[:n])
        self.inverse = [pow(self.product // p, -1, p) for p in self.primes]

    def of(self, rows: np.ndarray) -> list[np.ndarray]:
        """rows modulo each prime, about 0, in float32."""
        out = []
        for p in self.primes:
            r = np.mod(rows, p)
            out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return out

    def products(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """The rows of a times those of b, of which the shorter ones decide how many components count."""
        depth = min(a[0].shape[1], b[0].shape[1])
        total = np.zeros((len(a[0]), len(b[0])), np.int64)
        for p, inverse, x, y in zip(self.primes, self.inverse, a, b, strict=True):
            r = np.zeros(total.shape, np.int64)
            for k in range(0, depth, DEPTH):
                r += (x[:, k : min(k + DEPTH, depth)] @ y[:, k : min(k + DEPTH, depth)].T).astype(np.int64)
            total += r % p * inverse % p * (self.product // p)
        total %= self.product
        return np.where(total > self.product // 2, total - self.product, total)


def prepared(rows: DataFrame, key: str, label: Column, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, id, label, q) of the rows that take part, written; q are the integer components, row a number of each row."""
    v = F.col(vector)
    fit = rows.filter(v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))))
    fit = fit.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(scale * x.cast("double"))).alias("q"), F.transform(v, lambda x: scale * x.cast("double")).alias("d"))
    fit = fit.filter("label IS NOT NULL").withColumn("size", F.aggregate("d", F.lit(0.0), lambda t, x: t + (F.abs(x) + 1) * (F.abs(x) + 1))).drop("d")
    return written(fit.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled up with zeros."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    width = int(n.max(initial=0))
    if len(n) and (n == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(n), width).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = flat[offsets[0] : offsets[-1]]
    return out


def _tiles(batches):
    """(row, id, label, matrix) of about TILE_ROWS rows, by id: the first of equal scores is that of the smallest id."""
    held: list = []

    def tile():
        t = pa.Table.from_batches(held).combine_chunks().sort_by([("id", "ascending"), ("row", "ascending")])
        return t["row"].to_numpy(), t["id"], t["label"].to_numpy(), _matrix(t["q"].combine_chunks())

    for batch in batches:
        for k in range(0, batch.num_rows, TILE_ROWS):
            held.append(batch.slice(k, TILE_ROWS))
            if sum(map(len, held)) >= TILE_ROWS:
                yield tile()
                held = []
    if held:
        yield tile()


class _Bests:
    """For each of n lists, the k best rows so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id, self.null = np.full((n, k), _NONE), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def offer(self, lists: slice, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """scores: a row for each list, _NONE where a row is no candidate, in the order of ids; they are changed."""
        k, every = self.score.shape[1], np.arange(len(scores))
        new_score, new_id, new_null = (np.empty((len(scores), k), x) for x in (np.int64, np.int64, bool))
        for j in range(k):
            best = scores.argmax(axis=1)
            new_score[:, j], new_id[:, j], new_null[:, j] = scores[every, best], ids[best], nulls[best]
            scores[every, best] = _NONE
        score, id_, null = (np.concatenate(x, axis=1) for x in ((self.score[lists], new_score), (self.id[lists], new_id), (self.null[lists], new_null)))
        order = np.lexsort((id_, null, ~score), axis=1)[:, :k]
        for mine, both in ((self.score, score), (self.id, id_), (self.null, null)):
            mine[lists] = np.take_along_axis(both, order, axis=1)

    def rows(self, **columns: np.ndarray):
        """Batches of what was found; columns give each list's."""
        for a in range(0, len(self.score), TILE_ROWS):
            at, k = np.nonzero(self.score[a : a + TILE_ROWS] > _NONE)
            found = {name: pa.array(v[a : a + TILE_ROWS][at]) for name, v in columns.items()}
            null, ids = self.null[a : a + TILE_ROWS][at, k], self.id[a : a + TILE_ROWS][at, k]
            found |= {"id": pa.array(ids, mask=null), "score": pa.array(self.score[a : a + TILE_ROWS][at, k])}
            yield pa.RecordBatch.from_pydict(found)


def _positives(rows: DataFrame, shared, n: int) -> DataFrame:
    """(anchor, id, score): for each anchor of a block (a row's number), the best n of a task's other rows with its label."""

    def run(batches):
        anchor, label, q, largest = pickle.loads(shared.value)
        system = Residues(largest)
        residues, bests = system.of(q), _Bests(len(anchor), n)
        order = np.argsort(label, kind="stable")
        anchor, label, residues = anchor[order], label[order], [r[order] for r in residues]
        for row, ids, labels, matrix in _tiles(batches):
            id_, null = _ids(ids)
            for value in np.unique(labels):
                a, b = np.searchsorted(label, value, "left"), np.searchsorted(label, value, "right")
                mine = np.flatnonzero(labels == value)
                theirs = system.of(matrix[mine]) if b > a else None
                for k in range(a, b, TILE_ANCHORS):
                    part = slice(k, min(k + TILE_ANCHORS, b))
                    scores = system.products([r[part] for r in residues], theirs)
                    scores[anchor[part, None] == row[mine][None, :]] = _NONE
                    bests.offer(part, scores, id_[mine], null[mine])
        yield from bests.rows(anchor=anchor)

    return rows.select("row", "id", "label", "q").mapInArrow(run, "anchor long, id long, score long")


def _negatives(rows: DataFrame, shared, n: int, low: int, high: int) -> DataFrame:
    """(pair, id, score): for each anchor and positive of a block (a number of it), the best n of a task's rows with
    another label and a score in the window."""

    def run(batches):
        label, q, largest, anchor_of, positive = pickle.loads(shared.value)
        system = Residues(largest)
        residues, bests = system.of(q), _Bests(len(positive), n)
        # the window in whole scores
        least, most = -(-low * positive // 100), high * positive // 100
        starts = np.searchsorted(anchor_of, np.arange(len(label) + 1))
        for _, ids, labels, matrix in _tiles(batches):
            id_, null = _ids(ids)
            theirs = system.of(matrix)
            for k in range(0, len(label), TILE_ANCHORS):
                part = slice(k, min(k + TILE_ANCHORS, len(label)))
                scores = system.products([r[part] for r in residues], theirs)
                scores[label[part, None] == labels[None, :]] = _NONE
                pairs = slice(starts[part.start], starts[part.stop])
                for a in range(pairs.start, pairs.stop, TILE_ANCHORS):
                    some = slice(a, min(a + TILE_ANCHORS, pairs.stop))
                    own = scores[anchor_of[some] - k]
                    own[(own < least[some, None]) | (own > most[some, None])] = _NONE
                    bests.offer(some, own, id_, null)
        yield from bests.rows(pair=np.arange(len(positive)))

    return rows.select("row", "id", "label", "q").mapInArrow(run, "pair long, id long, score long")


def _ids(ids) -> tuple[np.ndarray, np.ndarray]:
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)


def _first(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The best n of each key, with place."""
    order = W.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def hard_negatives(rows: DataFrame, key: str = "vec_id", label: Column | None = None, anchors: Column | None = None, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row of which `anchors` (a condition on id; all rows by default) holds: its first `positives` other rows of the same label,
    and for each of these the first `negatives` rows of other labels with low * p <= 100 * score <= high * p, p being the positive's score.
    """
    spark = rows.sparkSession
    ship(spark)
    held = prepared(rows, key, F.col("label") if label is None else label, vector)
    queries = held.filter("id IS NOT NULL").filter(F.lit(True) if anchors is None else anchors)
    largest, width, n = (held.agg(F.max("size")).first()[0] or 0.0), held.agg(F.max(F.size("q"))).first()[0] or 1, queries.count()
    if largest * 100 >= 2.0**62:
        raise ValueError("the scores don't fit in 64 bits")
    n_blocks = max(1, -(-n * 8 * max(1, width) // block_bytes))
    found = []
    for k in range(n_blocks if n else 0):
        block = queries.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == k).select("row", "id", "label", "q").orderBy("row").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        anchor, label_of, q = block["row"].to_numpy(), block["label"].to_numpy(), _matrix(block["q"].combine_chunks())
        shared = spark.sparkContext.broadcast(pickle.dumps((anchor, label_of, q, int(largest) + 1)))
        # at most `positives` rows for each anchor of the block
        best = _first(_positives(held, shared, positives), "anchor", positives).orderBy("anchor", "place").select("anchor", "id", "score").toArrow()
        shared.unpersist()
        at, score = np.searchsorted(anchor, best["anchor"].to_numpy()), best["score"].to_numpy()
        shared = spark.sparkContext.broadcast(pickle.dumps((label_of, q, int(largest) + 1, at, score)))
        pairs = spark.createDataFrame(pa.table({"pair": np.arange(len(at)), "anchor_id": block["id"].take(pa.array(at)), "positive_id": best["id"], "positive_score": best["score"]}))
        chosen = _first(_negatives(held, shared, negatives, low, high), "pair", negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score", "place": "rank"})
        found.append(written(chosen.join(F.broadcast(pairs), "pair").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives"))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id", label, F.expr("id % 50 = 0"))


ORACLE = """
WITH rows AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, a.label AS own, b.n AS other, b.vec_id AS id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM rows a JOIN rows b ON a.n <> b.n WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor, anchor_id, own, other AS positive, id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
), negatives AS (
  SELECT p.anchor, p.positive, p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON s.anchor = p.anchor AND s.label <> p.own
  WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
