"""Point lookup, listing, export, counts and links."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import rfc3339
from palimpsest.operators.filters import live, matching, unexpired, visible
from palimpsest.schema import MEMORY_COLS

LIST_LIMIT = 20


def history(memories: DataFrame) -> DataFrame:
    """All live versions, expired ones too, newest first within a key."""
    return memories.filter(live()).select(MEMORY_COLS).orderBy("ns", "key", F.desc("version"), "id")


def versions_at(memories: DataFrame, version: int, as_of) -> DataFrame:
    """The live, unexpired rows of one version number."""
    return memories.filter(live() & unexpired(as_of) & (F.col("version") == version)).select(MEMORY_COLS)


def newest(memories: DataFrame, as_of) -> DataFrame:
    """The highest version of each key among unexpired rows: an older version stands in for an expired one."""
    top = W.partitionBy("ns", "key").orderBy(F.desc("version"), "id")
    return memories.filter(live() & unexpired(as_of)).withColumn("__rank", F.row_number().over(top)).filter("__rank = 1").select(MEMORY_COLS)


def get(memories: DataFrame, ns: str, key: str, as_of, version: int = 0, all_versions: bool = False) -> DataFrame:
    """The rows of one key; history comes before a version, a version of 0 or less means the newest."""
    rows = memories.filter((F.col("ns") == ns) & (F.col("key") == key))
    if all_versions:
        return history(rows)
    return versions_at(rows, version, as_of) if version > 0 else newest(rows, as_of)


def list_memories(memories: DataFrame, as_of, ns: str | None = None, kind: str | None = None, tags: Iterable[str] = (), limit: int | None = LIST_LIMIT) -> DataFrame:
    """Latest rows, newest first; limit 0 or less means LIST_LIMIT, None means all."""
    rows = visible(memories, as_of, ns, kind, tags).select(MEMORY_COLS).orderBy(F.desc("created_at"), "id")
    return rows if limit is None else rows.limit(limit if limit > 0 else LIST_LIMIT)


def keys_only(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("/", "ns", "key").alias("path"))


def export_all(memories: DataFrame, ns: str | None = None) -> DataFrame:
    """All live versions, expired ones too."""
    return matching(memories.filter(live()), ns=ns).select(MEMORY_COLS).orderBy("ns", "key", "version", "id")


def json_row() -> Column:
    """A row as JSON, times as RFC 3339; nulls are left out."""
    stamps = {f: rfc3339(F.col(f)).alias(f) for f in ("created_at", "deleted_at", "last_accessed_at", "expires_at")}
    return F.to_json(F.struct(*[stamps.get(c, F.col(c)) for c in MEMORY_COLS]))


def stats_totals(memories: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: total (deleted too), active (not deleted, expired too) and chunks."""
    counts = memories.agg(F.count(F.lit(1)).alias("total"), F.count_if(live()).alias("active"))
    return counts.withColumn("chunks", chunks.agg(F.count(F.lit(1))).scalar())


def ns_stats(memories: DataFrame) -> DataFrame:
    """Live rows and distinct keys of each namespace, the largest first."""
    counts = memories.filter(live()).groupBy("ns").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("key").alias("keys"))
    return counts.orderBy(F.desc("count"), "ns")


def links_of(links: DataFrame, memory_id: str) -> DataFrame:
    return links.filter((F.col("from_id") == memory_id) | (F.col("to_id") == memory_id))


def links_each(links: DataFrame) -> DataFrame:
    """(id, from_id, to_id, rel) for either end of every link: links_of() for all memories at once."""
    ends = F.array_distinct(F.array("from_id", "to_id"))
    return links.select(F.explode(ends).alias("id"), "from_id", "to_id", "rel")
