"""Writes as DataFrame transformations: what a batch of changes makes of a state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import after_seconds, as_timestamp, ttl_seconds
from palimpsest.operators.filters import latest, live
from palimpsest.schema import MEMORY_COLS


def put_versions(memories: DataFrame, puts: DataFrame, as_of, batch: str = "") -> DataFrame:
    """The rows that puts (ordered by seq within a key) append. A key's next version is the highest live one, expired
    or not, plus 1, so a number that was deleted is given again. Unset kinds and priorities get their defaults."""
    top = memories.filter(live()).groupBy("ns", "key").agg(F.max("version").alias("top"), F.max_by("id", F.struct("version", "id")).alias("top_id"))
    of_key = W.partitionBy("ns", "key").orderBy("seq")
    rows = puts.withColumn("nth", F.row_number().over(of_key)).join(top, ["ns", "key"], "left")
    rows = rows.withColumn("version", (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("int"))
    rows = rows.withColumn("id", F.sha2(F.concat_ws("\x1f", "ns", "key", F.col("version").cast("string"), F.lit(batch)), 256))
    created = as_timestamp(as_of)
    filled = lambda name, default: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))
    return rows.select(
        "id",
        "ns",
        "key",
        "content",
        filled("kind", "semantic").alias("kind"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
        "version",
        F.coalesce(F.lag("id").over(of_key), "top_id").alias("supersedes"),
        F.date_trunc("second", created).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
        filled("priority", "normal").alias("priority"),
        F.lit(0).alias("access_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_accessed_at"),
        "meta",
        F.when(F.col("ttl") != "", F.date_trunc("second", after_seconds(created, ttl_seconds(F.col("ttl")))).cast("timestamp_ntz")).alias("expires_at"),
    ).select(MEMORY_COLS)


def soft_delete(memories: DataFrame, keys: DataFrame, as_of, all_versions: bool = False) -> DataFrame:
    """memories with the latest live row, or all live rows, of the keys (ns, key) marked as deleted."""
    hit = (memories.filter(live()) if all_versions else latest(memories)).join(keys.select("ns", "key").distinct(), ["ns", "key"], "left_semi")
    gone = hit.select("id", F.lit(True).alias("__gone"))
    return memories.join(gone, "id", "left").withColumn("deleted_at", F.when(F.col("__gone"), as_timestamp(as_of)).otherwise(F.col("deleted_at"))).drop("__gone").select(MEMORY_COLS)


def hard_delete(memories: DataFrame, keys: DataFrame, all_versions: bool = False) -> DataFrame:
    """memories without the latest live row, or any row, of the keys."""
    keys = keys.select("ns", "key").distinct()
    if all_versions:
        return memories.join(keys, ["ns", "key"], "left_anti").select(MEMORY_COLS)
    return memories.join(latest(memories).join(keys, ["ns", "key"], "left_semi").select("id"), "id", "left_anti").select(MEMORY_COLS)


def refused(memories: DataFrame, links: DataFrame, keys: DataFrame, all_versions: bool = False) -> DataFrame:
    """The (ns, key) of keys whose hard delete would take rows that have links."""
    hit = (memories if all_versions else latest(memories)).join(keys.select("ns", "key").distinct(), ["ns", "key"], "left_semi")
    return linked(hit, links).select("ns", "key").distinct()


def linked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (with an id) that are an end of a link."""
    return rows.join(links.select(F.explode(F.array("from_id", "to_id")).alias("id")), "id", "left_semi")


def record_access(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """memories with the accesses (id, ts) counted, and the last one's time."""
    seen = accesses.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__last"))
    return memories.join(seen, "id", "left").withColumns(
        {"access_count": (F.col("access_count") + F.coalesce("__n", F.lit(0))).cast("int"), "last_accessed_at": F.greatest("last_accessed_at", "__last")}
    ).select(MEMORY_COLS)


def resolve(memories: DataFrame, keys: DataFrame) -> DataFrame:
    """keys with id: that of the latest live row, expired or not; null where there is none."""
    return keys.join(latest(memories).select("ns", "key", "id"), ["ns", "key"], "left")


def fold_links(log: DataFrame) -> DataFrame:
    """(from_id, to_id, rel, created_at) after a log (op_seq, op, id, to_id, rel, ts): a link keeps the time
    of the first of its link operations after its last unlink."""
    ends = ["id", "to_id", "rel"]
    last = W.partitionBy(*ends)
    rows = log.filter(F.col("op").isin("link", "unlink")).withColumn("__cut", F.max(F.when(F.col("op") == "unlink", F.col("op_seq"))).over(last))
    kept = rows.filter((F.col("op") == "link") & (F.col("__cut").isNull() | (F.col("op_seq") > F.col("__cut"))))
    return kept.groupBy(*ends).agg(F.min_by("ts", "op_seq").alias("created_at")).withColumnRenamed("id", "from_id")


def fold_changes(changes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """schema.STATE: what changes (schema.CHANGES) come to, after those that `before` (STATE) has folded."""
    is_ = lambda *ops: F.col("op").isin(*ops)
    rows = changes.select(
        "batch",
        "id",
        F.when(is_("soft_delete"), F.col("ts")).alias("soft"),
        is_("hard_delete").alias("hard"),
        F.when(is_("cover", "uncover"), is_("cover")).alias("covers"),
        F.when(is_("access"), 1).otherwise(0).cast("long").alias("n"),
        F.when(is_("access"), F.col("ts")).alias("last"),
        "op_seq",
    )
    if before is not None:
        rows = rows.unionByName(before.withColumn("op_seq", F.lit(0).cast("long")))
    covers = F.max_by("covers", F.when(F.col("covers").isNotNull(), F.col("op_seq")))
    return rows.groupBy("batch", "id").agg(F.min("soft").alias("soft"), F.bool_or("hard").alias("hard"), covers.alias("covers"), F.sum("n").alias("n"), F.max("last").alias("last"))


def fold_memories(memories: DataFrame, state: DataFrame) -> DataFrame:
    """Stored rows (with batch and covered) as schema.STATE leaves them; without those that were deleted for good."""
    rows = memories.join(state, ["batch", "id"], "left").filter("hard IS NULL OR NOT hard")
    return rows.withColumns(
        {
            "deleted_at": F.coalesce("deleted_at", "soft"),
            "access_count": (F.col("access_count") + F.coalesce("n", F.lit(0))).cast("int"),
            "last_accessed_at": F.greatest("last_accessed_at", "last"),
            "covered": F.coalesce("covers", "covered"),
        }
    ).select(memories.columns)


def import_puts(exported: DataFrame) -> DataFrame:
    """Exported rows as puts, in the order of an export. Versions, times, ids and expiry aren't taken over."""
    order = W.partitionBy("ns", "key").orderBy("version", "id")
    return exported.select(F.row_number().over(order).cast("long").alias("seq"), "ns", "key", "content", "kind", "tags", "priority", "meta", F.lit(None).cast("string").alias("ttl"))
