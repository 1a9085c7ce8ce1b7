"""Scoring of search hits and packing them into a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import as_timestamp, micros, round_half_away

BUDGET, BYTES_PER_TOKEN = 4000, 4
CANDIDATES = 50
#: Bytes that must be left for an excerpt.
LEAST_EXCERPT = 100
RELEVANCE, RECENCY, IMPORTANCE, ACCESS = 0.4, 0.2, 0.2, 0.2
DECAY_PER_DAY = 0.1
#: What a priority counts in a context.
IMPORTANCE_OF = {"critical": 1.0, "high": 0.75, "normal": 0.5, "low": 0.25}


def context_score(as_of) -> Column:
    """Of a memory row: relevance (1 for every hit), recency, importance and use."""
    age = (micros(as_timestamp(as_of)) - micros(F.col("created_at"))) / 8.64e10
    importance = F.coalesce(*[F.when(F.col("priority") == p, F.lit(w)) for p, w in IMPORTANCE_OF.items()], F.lit(0.5))
    used = F.when(F.col("access_count") > 0, F.least(F.lit(1.0), F.log(F.col("access_count") + 1.0) / F.log(F.lit(100.0)))).otherwise(F.lit(0.0))
    return F.lit(RELEVANCE) + F.exp(-DECAY_PER_DAY * age) * RECENCY + importance * IMPORTANCE + used * ACCESS


def pack(candidates: DataFrame, budget: int = BUDGET, by: tuple[str, ...] = ()) -> DataFrame:
    """candidates (id, ns, key, kind, content, score) in score order until the budget (in tokens of 4 bytes) is full.

    What first overflows is cut to the bytes left, if there are LEAST_EXCERPT of them, and ends the packing. The
    candidates should be few, since a running sum in one order needs them in one place.
    """
    budget = budget if budget > 0 else BUDGET
    room = budget * BYTES_PER_TOKEN
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    size = F.octet_length(F.coalesce("content", F.lit(""))).cast("long")
    rows = candidates.withColumn("upto", F.sum(size).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.col("upto") - size)
    # sizes aren't negative, so the rows that fit come first and one at most overflows from within the budget
    whole = F.col("upto") <= room
    # of rows without content several may stand at the same place, of which the first comes
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*by, "before", F.col("upto") > room).orderBy(F.desc("score"), "id")))
    cut = (F.col("before") <= room) & (room - F.col("before") >= LEAST_EXCERPT) & (F.col("nth") == 1)
    rows = rows.withColumns({"excerpt": ~whole, "left": room - F.col("before")}).filter(whole | cut)
    content = F.when(F.col("excerpt"), F.concat(F.expr("CAST(substring(CAST(content AS BINARY), 1, CAST(left AS INT)) AS STRING)"), F.lit("..."))).otherwise(F.col("content"))
    taken = F.when(F.col("excerpt"), F.col("left") + 3).otherwise(size)
    rows = rows.withColumns({"bytes": taken, "packed": content})
    used = rows.withColumn("all_bytes", F.sum("bytes").over(W.partitionBy(*by)))
    return used.select(
        *by,
        F.lit(budget).alias("budget"),
        F.expr("CAST(all_bytes DIV 4 AS INT)").alias("used"),
        F.row_number().over(order).alias("place"),
        "id",
        "ns",
        "key",
        "kind",
        F.col("packed").alias("content"),
        round_half_away(F.col("score"), 2).alias("score"),
        "excerpt",
        "bytes",
    )


def assemble_context(hits: DataFrame, as_of, budget: int = BUDGET) -> DataFrame:
    """The packed rows of at most CANDIDATES search hits."""
    scored = hits.withColumn("score", context_score(as_of)).orderBy(F.desc("score"), "id").limit(CANDIDATES)
    return pack(scored, budget)


def context_result(packed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row (budget, used, memories), also if nothing was packed."""
    memory = F.struct("place", "ns", "key", "kind", "content", "score", "excerpt")
    row = packed.agg(F.coalesce(F.max("used"), F.lit(0)).alias("used"), F.array_sort(F.collect_list(memory)).alias("memories"))
    memories = F.transform("memories", lambda m: m.dropFields("place"))
    return row.select(F.lit(budget if budget > 0 else BUDGET).alias("budget"), "used", memories.alias("memories"))
