"""Vector search for a set of queries, which compares a query with those vectors alone that can be similar enough.

Every vector belongs to the pivot that it has the least angle with. Angles obey the triangle inequality, so a vector whose angle with its
pivot differs from the query's by more than the angle of the threshold can't reach it. The result is that of comparing all pairs; the
pivots, a bounded sample, decide about time alone.

Vectors of a length that no pivot has belong to none and are compared with all queries of their length. Null vectors, and those that are empty or without length, have
similarity 0 with all, as those of another length have, and so are found only by a threshold of 0 or less, for which all pairs are compared.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import search
from palimpsest.scratch import written
from palimpsest.shipping import ship

#: Pivots, and the vectors that they are chosen from.
PIVOTS, SAMPLE = 32, 2000
#: Angles differ by so much from what they should be, at most.
SLACK = 1e-6
#: Queries that a batch is multiplied with at once.
TILE = 2048


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)


def pivots_of(vectors: DataFrame, n: int = PIVOTS, sample: int = SAMPLE) -> list[list[float]]:
    """At most n of a sample of the vectors v, each as far as can be from those before it; those of the commonest length."""
    some = [r["v"] for r in vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()]
    width = max({len(v) for v in some}, key=[len(v) for v in some].count, default=0)
    units = [[x / norm for x in v] for v in some if len(v) == width and (norm := math.sqrt(sum(x * x for x in v))) > 0]
    chosen, nearest = [], [-2.0] * len(units)
    while units and len(chosen) < min(n, len(units)):
        chosen.append(units[min(range(len(units)), key=nearest.__getitem__)])
        nearest = [max(c, sum(map(float.__mul__, u, chosen[-1]))) for c, u in zip(nearest, units, strict=True)]
    return chosen


def with_norm(rows: DataFrame, vector: str, *columns: str) -> DataFrame:
    """(columns, v, norm) of the rows that can be similar to any."""
    rows = rows.filter(F.col(vector).isNotNull()).select(*columns, F.col(vector).alias("v")).withColumn("norm", F.sqrt(_dot(F.col("v"), F.col("v"))))
    return rows.filter("norm > 0")


def _angles(pivots: list[list[float]]) -> Column:
    """The angles of v with the pivots, if it is as long as they are."""
    held = F.array(*[F.array(*map(F.lit, p)) for p in pivots])
    cosine = lambda p: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(p, F.col("v")) / F.col("norm")))
    return F.when(F.size("v") == len(pivots[0]), F.transform(held, lambda p: F.acos(cosine(p))))


def clustered(rows: DataFrame, pivots: list[list[float]]) -> DataFrame:
    """rows (v, norm) with pivot, the number of the nearest, and angle with it; pivot -1 if there is none."""
    if not pivots:
        return rows.withColumns({"pivot": F.lit(-1), "angle": F.lit(0.0)})
    rows = rows.withColumn("angles", _angles(pivots))
    least = F.array_min("angles")
    return rows.withColumns({"pivot": F.coalesce(F.array_position("angles", least).cast("int") - 1, F.lit(-1)), "angle": F.coalesce(least, F.lit(0.0))}).drop("angles")


def pairs(held: DataFrame, queries: DataFrame, pivots: list[list[float]], least: float) -> DataFrame:
    """(query_id, memory_id, similarity) of all pairs of held (memory_id, v, norm, pivot, angle) and queries (query_id, v, norm)
    that pass the inequality; queries are broadcast."""
    reach = math.acos(max(-1.0, min(1.0, least))) + SLACK
    asked = queries.withColumn("angles", _angles(pivots)) if pivots else queries.withColumn("angles", F.lit(None).cast("array<double>"))
    of_pivot = asked.select("query_id", F.col("v").alias("q"), F.col("norm").alias("q_norm"), F.posexplode("angles").alias("pivot", "q_angle"))
    of_none = asked.select("query_id", F.col("v").alias("q"), F.col("norm").alias("q_norm"), F.lit(-1).alias("pivot"), F.lit(None).cast("double").alias("q_angle"))
    near = F.col("q_angle").isNull() | F.col("angle").between(F.col("q_angle") - reach, F.col("q_angle") + reach)
    compared = held.join(F.broadcast(of_pivot.unionByName(of_none)), "pivot").filter(near & (F.size("v") == F.size("q")))
    return compared.select("query_id", "memory_id", (_dot(F.col("v"), F.col("q")) / (F.col("norm") * F.col("q_norm"))).alias("similarity"))


def _of_width(asked: pa.Table, n_pivots: int) -> dict[int, tuple]:
    """Queries (v, norm, angles) by the length of their vectors: their numbers, vectors, norms, and angles with the pivots if they have any."""
    found: dict[int, list[int]] = {}
    for i, n in enumerate(pc.list_value_length(asked["v"]).to_pylist()):
        found.setdefault(n, []).append(i)
    out = {}
    for width, at in found.items():
        part = asked.take(at).combine_chunks()
        angles = part["angles"].combine_chunks()
        flat = angles.flatten().to_numpy(zero_copy_only=False).reshape(len(at), n_pivots) if n_pivots and not angles.null_count else None
        v = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
        out[width] = (np.array(at), v, part["norm"].to_numpy(), flat)
    return out


def near(held: DataFrame, shared, least: float) -> DataFrame:
    """(number, memory_id, similarity) of what pairs() gives for a broadcast block of queries, by products of matrices: the best of a
    memory's vectors in a batch, if it is about `least` or more. Rows of a pivot go against the queries within reach of any of them."""
    reach = math.acos(max(-1.0, min(1.0, least))) + SLACK
    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("memory_id", held.schema["memory_id"].dataType), T.StructField("similarity", T.DoubleType())])

    def run(batches):
        by_width = pickle.loads(shared.value)
        for batch in batches:
            ids, vectors = batch.column("memory_id"), batch.column("v")
            width = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            memory = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            norm, pivot, angle = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("norm", "pivot", "angle"))
            order = np.lexsort((memory, pivot, width))
            cuts = np.flatnonzero((np.diff(width[order]) != 0) | (np.diff(pivot[order]) != 0)) + 1
            for at in np.split(order, cuts) if len(order) else ():
                asked = by_width.get(int(width[at[0]]))
                if asked is None:
                    continue
                number, q, q_norm, q_angles = asked
                p = int(pivot[at[0]])
                if p >= 0:
                    if q_angles is None:
                        continue
                    some = np.flatnonzero((q_angles[:, p] >= angle[at].min() - reach) & (q_angles[:, p] <= angle[at].max() + reach))
                    number, q, q_norm = number[some], q[some], q_norm[some]
                v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
                starts = np.flatnonzero(np.append(True, np.diff(memory[at]) != 0))
                for k in range(0, len(number), TILE):
                    tile = slice(k, k + TILE)
                    best = np.maximum.reduceat((v @ q[tile].T) / (norm[at][:, None] * q_norm[tile][None, :]), starts, axis=0)
                    # the sum's order may matter in the last digits; what isn't a number is the largest, as in Spark
                    g, j = np.nonzero(~(best < least - SLACK))
                    yield pa.RecordBatch.from_arrays([pa.array(number[tile][j]), ids.take(pa.array(at[starts[g]])), pa.array(best[g, j])], ["number", "memory_id", "similarity"])

    return held.select("memory_id", "v", "norm", "pivot", "angle").mapInArrow(run, schema)


def search_vectors(chunks: DataFrame, queries: DataFrame, least: float = search.MIN_SIMILARITY, block: int = search.QUERY_BLOCK, n_pivots: int = PIVOTS) -> DataFrame:
    """What search.search_vectors() finds. The queries go against all chunks in blocks of about `block`, one after another;
    what a block finds is written. No pivots: all pairs of the same length are compared."""
    if least <= 0:
        return search.all_pairs(chunks, queries, least, block)
    spark = chunks.sparkSession
    ship(spark)
    vectors = with_norm(chunks, "embedding", "memory_id")
    pivots = pivots_of(vectors, n_pivots) if n_pivots else []
    held = written(clustered(vectors, pivots).sortWithinPartitions("pivot", "angle"), "vectors")
    asked = with_norm(queries, "embedding", "query_id")
    asked = written(asked.withColumn("angles", _angles(pivots) if pivots else F.lit(None).cast("array<double>")), "queries")
    n, found = max(1, -(-asked.count() // block)), []
    for k in range(n):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k).toArrow()
        shared = spark.sparkContext.broadcast(pickle.dumps(_of_width(part, len(pivots))))
        names = spark.createDataFrame(part.select(["query_id"]).append_column("number", pa.array(range(len(part)), pa.int64())), T.StructType([asked.schema["query_id"], T.StructField("number", T.LongType())]))
        # the best of a task's batches before they are named
        best = near(held, shared, least).groupBy("number", "memory_id").agg(F.max("similarity").alias("similarity")).join(F.broadcast(names), "number")
        best = best.groupBy("query_id", "memory_id").agg(F.max("similarity").alias("similarity"))
        found.append(written(search.above_threshold(best, least), "near"))
    return reduce(DataFrame.unionByName, found)


def compared_share(chunks: DataFrame, queries: DataFrame, least: float = search.MIN_SIMILARITY, n_pivots: int = PIVOTS) -> float:
    """The share of pairs that search_vectors() compares."""
    vectors = with_norm(chunks, "embedding", "memory_id")
    pivots = pivots_of(vectors, n_pivots)
    asked = with_norm(queries, "embedding", "query_id")
    return pairs(clustered(vectors, pivots), asked, pivots, least).count() / max(1, vectors.count() * asked.count())
