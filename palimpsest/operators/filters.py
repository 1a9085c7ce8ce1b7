"""Predicates on memory rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions.text import as_timestamp


def live() -> Column:
    return F.col("deleted_at").isNull()


def unexpired(as_of) -> Column:
    """Strict: a row that expires at as_of is gone."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > as_timestamp(as_of))


def matching(memories: DataFrame, ns: str | None = None, kind: str | None = None, tags: Iterable[str] = (), key: str | None = None) -> DataFrame:
    """Rows of the namespace, kind and key, with all of the tags; an empty value is no filter."""
    for name, value in (("ns", ns), ("kind", kind), ("key", key)):
        if value:
            memories = memories.filter(F.col(name) == value)
    for tag in tags:
        memories = memories.filter(F.array_contains("tags", tag))
    return memories


def latest(memories: DataFrame) -> DataFrame:
    """The live row of the highest version of each key, expired or not: an expired top version hides its key. Rows of a
    store know by `covered` whether a live row supersedes them, so that nothing is ranked."""
    if "covered" in memories.columns:
        return memories.filter(live() & ~F.col("covered"))
    top = W.partitionBy("ns", "key").orderBy(F.desc("version"), "id")
    return memories.filter(live()).withColumn("__rank", F.row_number().over(top)).filter("__rank = 1").drop("__rank")


def visible(memories: DataFrame, as_of, ns: str | None = None, kind: str | None = None, tags: Iterable[str] = ()) -> DataFrame:
    """The latest rows that haven't expired. Only the namespace is chosen first, as it is part of the key."""
    return matching(latest(matching(memories, ns=ns)).filter(unexpired(as_of)), kind=kind, tags=tags)
