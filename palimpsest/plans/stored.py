"""Queries over a store that is made of the given documents by puts in several segments, second versions, deletions of both kinds and a merge:
each goes through the stored index and must equal what SQL finds in the documents themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import round_half_away
from palimpsest.operators import indexed, search
from palimpsest.plans import registry, views
from palimpsest.plans.registry import _query
from palimpsest.scratch import new_path
from palimpsest.sources.store import Store

AS_OF = "2024-02-01 00:00:00"
_PRIORITIES = ["low", "normal", "high", "critical", "other"]
_stores: dict[tuple[str, str], Store] = {}


def doc_store(spark: SparkSession, sf_dir: str) -> Store:
    """Eight puts of an eighth of the documents each, a day apart; then a second version of every tenth. Of each seven documents one is
    deleted, and one for good, its latest version only. Made once for a session."""
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _stores:
        store = Store(spark, new_path(spark, "store"))
        docs = views.read(spark, sf_dir, "documents")
        priority = F.element_at(F.array(*map(F.lit, _PRIORITIES)), (F.col("doc_id") % 5 + 1).cast("int"))
        null = F.lit(None).cast("string")
        puts = docs.select(F.col("doc_id").alias("seq"), F.col("source").alias("ns"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"), null.alias("kind"), F.array("lang").alias("tags"), priority.alias("priority"), null.alias("meta"), null.alias("ttl"))
        for k in range(8):
            store.put_many(puts.filter(F.col("seq") % 8 == k), f"2024-01-0{k + 1} 00:00:00")
        store.put_many(puts.filter("seq % 10 = 0").withColumn("content", F.concat(F.lit("That is with it. "), "content")), "2024-01-10 00:00:00")
        keys = lambda rest: puts.filter(f"seq % 7 = {rest}").select("ns", "key")
        store.rm_many(keys(3), as_of="2024-01-11 00:00:00")
        store.rm_many(keys(5), hard=True, as_of="2024-01-12 00:00:00")
        _stores[made] = store
    return _stores[made]


_ROWS = f"""written AS (
  SELECT doc_id, source AS ns, 1 AS version, text, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 8 AS INTEGER)) AS created_at FROM documents
  UNION ALL SELECT doc_id, source, 2, 'That is with it. ' || text, TIMESTAMP '2024-01-10 00:00:00' FROM documents WHERE doc_id % 10 = 0),
topped AS (SELECT *, version = max(version) OVER (PARTITION BY doc_id) AS top FROM written),
kept AS (SELECT doc_id, ns, version, text, created_at, doc_id % 7 = 3 AND top AS deleted, {_PRIORITIES}[doc_id % 5 + 1] AS priority FROM topped WHERE NOT (doc_id % 7 = 5 AND top)),
latest AS (SELECT * FROM kept WHERE NOT deleted QUALIFY version = max(version) OVER (PARTITION BY doc_id))"""


def _chunks_sql() -> str:
    """The chunks of kept rows, by the SQL of chunk_all over them as documents."""
    cut = registry.ORACLES["chunk_all"].replace("FROM documents", "FROM (SELECT doc_id * 10 + version AS doc_id, text FROM kept)")
    return f"chunks AS ({cut})"


def _ranked_sql() -> str:
    return f"""WITH {_ROWS}, {_chunks_sql()},
words AS (SELECT memory_id, {registry._TOKENS} AS w FROM chunks),
counted AS (SELECT memory_id, CAST(len(w) AS DOUBLE) AS dl, CAST(len(list_filter(w, lambda t: t = 'with')) AS DOUBLE) AS tf0, CAST(len(list_filter(w, lambda t: t = 'that')) AS DOUBLE) AS tf1 FROM words),
counts AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, CAST(count(*) FILTER (tf0 > 0) AS DOUBLE) AS df0, CAST(count(*) FILTER (tf1 > 0) AS DOUBLE) AS df1 FROM counted),
weighed AS (SELECT *, CASE WHEN n - df0 <= df0 THEN 0.000001 ELSE ln((n - df0 + 0.5) / (df0 + 0.5)) END AS idf0, CASE WHEN n - df1 <= df1 THEN 0.000001 ELSE ln((n - df1 + 0.5) / (df1 + 0.5)) END AS idf1 FROM counts),
best AS (SELECT CAST(memory_id AS BIGINT) AS row_id, max(idf0 * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + idf1 * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM counted, weighed WHERE tf0 > 0 AND tf1 > 0 GROUP BY memory_id),
ranked AS (SELECT l.*, CASE priority WHEN 'critical' THEN 4.0 WHEN 'high' THEN 3.0 WHEN 'normal' THEN 2.0 ELSE 1.0 END * 0.2
   + (epoch_us(created_at) / 8.64e10 + 2440587.5) / (epoch_us(TIMESTAMP '{AS_OF}') / 8.64e10 + 2440587.5) * 0.3 + rank * 0.5 AS score FROM latest l JOIN best ON row_id = doc_id * 10 + version)"""


_KEYED = "ns, CAST(doc_id AS VARCHAR) AS key, CAST(version AS INTEGER) AS version"


@_query(f"WITH {_ROWS} SELECT {_KEYED}, deleted FROM kept")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the store."""
    return doc_store(spark, sf_dir).memories().select("ns", "key", "version", F.col("deleted_at").isNotNull().alias("deleted"))


@_query(f"WITH {_ROWS} SELECT {_KEYED}, created_at FROM latest")
def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed: latest rows, by their being covered or not."""
    return doc_store(spark, sf_dir).list(limit=None, as_of=AS_OF).select("ns", "key", "version", "created_at")


@_query(_ranked_sql() + f" SELECT {_KEYED}, round(score * 1000000) / 1000000 AS score FROM ranked")
def store_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ranked hits by the stored postings."""
    found = indexed.all_ranked(doc_store(spark, sf_dir).index(kinds=["postings"]), "with that", AS_OF)
    return found.select("ns", "key", "version", round_half_away(F.col("score"), 6).alias("score"))


@_query(_ranked_sql() + ", first AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS place FROM ranked QUALIFY place <= 20) SELECT CAST(place AS INTEGER) AS place, round(score * 1000000) / 1000000 AS score FROM first")
def store_search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hits, for which only the blocks are opened whose bound reaches the last of them."""
    index = doc_store(spark, sf_dir).index(kinds=["postings"])
    hits = indexed.ranked_top(index, "With THAT", AS_OF, limit=20).refs
    rows = indexed.rows_of(index, [(b, r, i + 1) for i, (b, r) in enumerate(hits)])
    best = search.bm25_by_index(index, "with that").groupBy("memory_id").agg(F.max("bm25").alias("rank"))
    scored = rows.join(best, F.col("id") == F.col("memory_id"))
    return scored.select("place", round_half_away(indexed.search_score(F.col("rank"), AS_OF), 6).alias("score"))


_LIKE = f"SELECT * FROM latest WHERE contains({registry._FOLDED.format('text')}, '{{0}}')"


@_query(f"WITH {_ROWS}, hits AS ({_LIKE.format('that with')}) SELECT {_KEYED} FROM hits")
def store_search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All substring hits by the stored trigrams."""
    index = doc_store(spark, sf_dir).index(kinds=["grams"])
    found = indexed.search_like(index, "That WITH", AS_OF).select("batch", "ref")
    return index.rows(None).join(found, ["batch", "ref"], "left_semi").select("ns", "key", "version")


@_query(f"WITH {_ROWS} SELECT {_KEYED} FROM latest WHERE {registry._FOLDED.format('text')} LIKE '%the%that_w%'")
def store_search_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with wildcards, between which the pieces have trigrams."""
    index = doc_store(spark, sf_dir).index(kinds=["grams"])
    found = indexed.search_like(index, "the%that_w", AS_OF).select("batch", "ref")
    return index.rows(None).join(found, ["batch", "ref"], "left_semi").select("ns", "key", "version")


@_query(f"WITH {_ROWS}, hits AS ({_LIKE.format('that with')}), first AS (SELECT created_at, row_number() OVER (ORDER BY created_at DESC) AS place FROM hits QUALIFY place <= 20) SELECT CAST(place AS INTEGER) AS place, created_at FROM first")
def store_like_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest substring hits, for which the texts of candidates alone are read."""
    index = doc_store(spark, sf_dir).index(kinds=["grams"])
    hits = indexed.like_top(index, "that with", AS_OF, limit=20)
    return indexed.rows_of(index, [(b, r, i + 1) for i, (b, r) in enumerate(hits)]).select("place", "created_at")


@_query(f"WITH {_ROWS} SELECT (SELECT count(*) FROM kept) AS total, (SELECT count(*) FROM kept WHERE NOT deleted) AS active, count(DISTINCT ns || '/' || doc_id) AS keys FROM kept WHERE NOT deleted")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = doc_store(spark, sf_dir)
    keys = store.namespaces().agg(F.coalesce(F.sum("keys"), F.lit(0)).cast("long").alias("keys"))
    # two rows of scalars
    return store.stats().select("total", "active").join(F.broadcast(keys))
