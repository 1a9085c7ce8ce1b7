"""More queries over the given tables, on rows that put the finer rules to the test: memories of several chunks and mixed
priorities, headings, orders under a limit, contexts with an excerpt, refused deletions. Each has the SQL it must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import round_half_away, split_tags, tokens
from palimpsest.operators import chunking, context, many, reads, search, vectors, writes
from palimpsest.plans import registry, views
from palimpsest.plans.registry import _query
from palimpsest.plans.views import AS_OF, MEM_EVENTS_SQL
from palimpsest.scratch import written

_PRIORITIES = ["low", "normal", "high", "critical", "other"]


def mem_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories of all priorities, and of one that isn't known."""
    priority = F.element_at(F.array(*map(F.lit, _PRIORITIES)), (F.col("key").cast("long") % 5 + 1).cast("int"))
    return views.mem_docs(spark, sf_dir).withColumn("priority", priority)


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document that isn't empty as a chunk of its memory."""
    memory = F.col("doc_id").cast("string").alias("memory_id")
    lines = views.read(spark, sf_dir, "documents").select(memory, F.posexplode(F.split("text", "\n")).alias("seq", "text")).filter("text <> ''")
    return lines.select(F.concat_ws("#", "memory_id", F.col("seq").cast("string")).alias("id"), "memory_id", "seq", "text")


_NOTES = f"""mem_notes AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS ns, CAST(doc_id AS VARCHAR) AS key, text AS content, {_PRIORITIES}[doc_id % 5 + 1] AS priority,
         CASE lang WHEN 'en' THEN 'semantic' WHEN 'de' THEN 'episodic' ELSE 'procedural' END AS kind, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM documents),
lines AS (SELECT CAST(doc_id AS VARCHAR) AS memory_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
chunks AS (SELECT memory_id || '#' || seq AS id, memory_id, text FROM lines WHERE text <> '')"""
_COUNTED = f"""words AS (SELECT id AS chunk_id, memory_id, {registry._TOKENS} AS w FROM chunks),
counted AS (SELECT chunk_id, memory_id, CAST(len(w) AS DOUBLE) AS dl, CAST(len(list_filter(w, lambda t: t = 'with')) AS DOUBLE) AS tf0, CAST(len(list_filter(w, lambda t: t = 'that')) AS DOUBLE) AS tf1 FROM words),
counts AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, CAST(count(*) FILTER (tf0 > 0) AS DOUBLE) AS df0, CAST(count(*) FILTER (tf1 > 0) AS DOUBLE) AS df1 FROM counted),
weighed AS (SELECT *, CASE WHEN n - df0 <= df0 THEN 0.000001 ELSE ln((n - df0 + 0.5) / (df0 + 0.5)) END AS idf0, CASE WHEN n - df1 <= df1 THEN 0.000001 ELSE ln((n - df1 + 0.5) / (df1 + 0.5)) END AS idf1 FROM counts),
bm25 AS (SELECT chunk_id, memory_id, idf0 * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * dl / avgdl)) + idf1 * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS bm25 FROM counted, weighed WHERE tf0 > 0 AND tf1 > 0)"""
_FOUND = f"""WITH {_NOTES}, {_COUNTED},
best AS (SELECT memory_id, max(bm25) AS rank FROM bm25 GROUP BY memory_id),
found AS (SELECT m.*, CASE priority WHEN 'critical' THEN 4.0 WHEN 'high' THEN 3.0 WHEN 'normal' THEN 2.0 ELSE 1.0 END * 0.2
   + (epoch_us(created_at) / 8.64e10 + 2440587.5) / (epoch_us(TIMESTAMP '{AS_OF}') / 8.64e10 + 2440587.5) * 0.3 + rank * 0.5 AS score FROM mem_notes m JOIN best ON id = memory_id)"""


@_query(f"WITH {_NOTES}, {_COUNTED} SELECT chunk_id, memory_id, round(bm25 * 1000000) / 1000000 AS bm25 FROM bm25")
def fts_same_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both terms in one of a memory's chunks; in two of them they don't count."""
    return search.bm25(line_chunks(spark, sf_dir), "with that").select("chunk_id", "memory_id", round_half_away(F.col("bm25"), 6).alias("bm25"))


@_query(_FOUND + " SELECT id, priority, round(score * 1000000) / 1000000 AS score FROM found")
def search_fts_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory counts by its best chunk and its priority."""
    found = search.search_fts(mem_notes(spark, sf_dir), line_chunks(spark, sf_dir), "with that", AS_OF, limit=None)
    return found.select("id", "priority", round_half_away(F.col("score"), 6).alias("score"))


@_query(_FOUND + " SELECT id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place FROM found QUALIFY place <= 10")
def search_fts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_fts(mem_notes(spark, sf_dir), line_chunks(spark, sf_dir), "with that", AS_OF, limit=10)
    return found.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("place"))


@_query(f"WITH {_NOTES} SELECT DISTINCT m.id, m.created_at FROM mem_notes m JOIN chunks c ON m.id = c.memory_id WHERE contains({registry._FOLDED.format('c.text')}, ' in the ')")
def search_like_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of which a chunk has the query, however many; here content is the first line alone."""
    memories = mem_notes(spark, sf_dir).withColumn("content", F.substring_index("content", "\n", 1))
    return search.search_like(memories, line_chunks(spark, sf_dir), " IN the ", AS_OF, limit=None).select("id", "created_at")


@_query(
    _FOUND
    + f""", scored AS (SELECT *, 0.4 + exp(-0.1 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 8.64e10) * 0.2
      + (CASE priority WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'low' THEN 0.25 ELSE 0.5 END) * 0.2 AS points FROM found WHERE kind = 'semantic'),
    top AS (SELECT *, row_number() OVER (ORDER BY points DESC, id) AS place FROM scored QUALIFY place <= 50),
    summed AS (SELECT *, CAST(sum(strlen(content)) OVER (ORDER BY place) AS BIGINT) AS upto, strlen(content) AS size FROM top),
    packed AS (SELECT *, upto > 6000 AS excerpt, 6000 - (upto - size) AS rest FROM summed WHERE upto <= 6000 OR (upto - size <= 6000 AND 6000 - (upto - size) >= 100))
    SELECT 1500 AS budget, CAST(sum(CASE WHEN excerpt THEN rest + 3 ELSE size END) OVER () // 4 AS INTEGER) AS used, CAST(place AS INTEGER) AS place, ns, key, kind,
           CASE WHEN excerpt THEN substr(hex(content), 1, CAST(rest AS INTEGER) * 2) || hex('...') ELSE hex(content) END AS content, round(points * 100) / 100 AS score, excerpt FROM packed"""
)
def context_of_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that a search's hits fill, the last of them cut. The contents are compared as bytes, as a cut may part
    those of a character."""
    found = search.search_fts(mem_notes(spark, sf_dir), line_chunks(spark, sf_dir), "with that", AS_OF, kind="semantic", limit=None)
    packed = context.assemble_context(found, AS_OF, 1500)
    rows = context.context_result(packed, 1500).select("budget", "used", F.posexplode("memories").alias("place", "m"))
    return rows.select("budget", "used", (F.col("place") + 1).alias("place"), "m.*").withColumn("content", F.hex("content"))


#: Every fiftieth document's first three words are a query against all lines.
_MANY = f"""WITH {_NOTES}, words AS (SELECT id AS chunk_id, memory_id, {registry._TOKENS} AS w FROM chunks),
queries AS (SELECT doc_id AS query_id, list_distinct(({registry._TOKENS})[1:3]) AS terms FROM documents WHERE doc_id % 50 = 0),
wanted AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM queries),
posted AS (SELECT chunk_id, memory_id, term, CAST(dl AS DOUBLE) AS dl, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT chunk_id, memory_id, len(w) AS dl, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
dfs AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM posted GROUP BY term),
counts AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM words),
parts AS (SELECT query_id, chunk_id, memory_id, n_terms, (CASE WHEN n - df <= df THEN 0.000001 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS part
  FROM wanted JOIN posted USING (term) JOIN dfs USING (term), counts),
best AS (SELECT query_id, memory_id, max(bm25) AS rank FROM (SELECT query_id, chunk_id, memory_id, sum(part) AS bm25 FROM parts GROUP BY query_id, chunk_id, memory_id, n_terms HAVING count(*) = n_terms) GROUP BY ALL)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(tokens(F.col("text")), 1, 3)
    return views.read(spark, sf_dir, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(words, " ").alias("query"))


@_query(
    _MANY
    + f""", found AS (SELECT query_id, m.id, CASE priority WHEN 'critical' THEN 4.0 WHEN 'high' THEN 3.0 WHEN 'normal' THEN 2.0 ELSE 1.0 END * 0.2
   + (epoch_us(created_at) / 8.64e10 + 2440587.5) / (epoch_us(TIMESTAMP '{AS_OF}') / 8.64e10 + 2440587.5) * 0.3 + rank * 0.5 AS score FROM mem_notes m JOIN best ON id = memory_id)
   SELECT query_id, CAST(place AS INTEGER) AS place, round(score * 1000000) / 1000000 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM found) WHERE place <= 10"""
)
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked keyword searches for a set of queries. The ids are left to context_queries, as sums that differ in their last
    digit may part ties here."""
    found = many.search_fts_many(mem_notes(spark, sf_dir), line_chunks(spark, sf_dir), _queries(spark, sf_dir), AS_OF, limit=10)
    return found.select("query_id", "place", round_half_away(F.col("score"), 6).alias("score"))


@_query(
    _MANY
    + f""", scored AS (SELECT query_id, m.*, 0.4 + exp(-0.1 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 8.64e10) * 0.2
      + (CASE priority WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'low' THEN 0.25 ELSE 0.5 END) * 0.2 AS points FROM mem_notes m JOIN best ON id = memory_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, id) AS place FROM scored QUALIFY place <= 50),
    summed AS (SELECT *, CAST(sum(strlen(content)) OVER (PARTITION BY query_id ORDER BY place) AS BIGINT) AS upto, strlen(content) AS size FROM top),
    packed AS (SELECT *, upto > 6000 AS excerpt, 6000 - (upto - size) AS rest FROM summed WHERE upto <= 6000 OR (upto - size <= 6000 AND 6000 - (upto - size) >= 100))
    SELECT query_id, CAST(sum(CASE WHEN excerpt THEN rest + 3 ELSE size END) OVER (PARTITION BY query_id) // 4 AS INTEGER) AS used, CAST(place AS INTEGER) AS place, id,
           CASE WHEN excerpt THEN substr(hex(content), 1, CAST(rest AS INTEGER) * 2) || hex('...') ELSE hex(content) END AS content, round(points * 100) / 100 AS score, excerpt FROM packed"""
)
def context_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context for each of a set of queries, contents as bytes."""
    packed = many.contexts(mem_notes(spark, sf_dir), line_chunks(spark, sf_dir), _queries(spark, sf_dir), AS_OF, 1500)
    return packed.select("query_id", "used", "place", "id", F.hex("content").alias("content"), "score", "excerpt")


_NEAR = registry._BEST + ", timed AS (SELECT memory_id AS id, similarity, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(memory_id AS INTEGER)) AS created_at FROM near)"


@_query(_NEAR + " SELECT id, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, id) AS INTEGER) AS place FROM timed QUALIFY place <= 3")
def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_vector(views.mem_labels(spark, sf_dir), views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), AS_OF, limit=3)
    return found.select("id", "similarity", F.row_number().over(W.orderBy(F.desc("similarity"), "id")).alias("place"))


@_query(
    _NEAR
    + """, hits AS (SELECT DISTINCT CAST(label AS VARCHAR) AS id, 0.0::DOUBLE AS similarity, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(label) AS created_at FROM embeddings WHERE CAST(label AS VARCHAR) LIKE '%1%' OR label IN (3, 5)),
    merged AS (SELECT * FROM hits UNION ALL SELECT id, similarity, created_at FROM timed WHERE id NOT IN (SELECT id FROM hits))
    SELECT id, similarity, CAST(row_number() OVER (ORDER BY similarity DESC, created_at DESC, id) AS INTEGER) AS place FROM merged QUALIFY place <= 6"""
)
def hybrid_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged order under a limit: vector hits by similarity, then keyword hits, the newest first."""
    memories = views.mem_labels(spark, sf_dir)
    keyword = memories.filter("contains(id, '1') OR id IN ('3', '5')")
    near = search.search_vector(memories, views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), AS_OF, limit=None)
    place = F.row_number().over(W.orderBy(F.desc("similarity"), F.desc("created_at"), "id"))
    return search.merge_hybrid(keyword, near, limit=6).select("id", "similarity", place.alias("place"))


@_query(
    f"""WITH sims AS (SELECT q.vec_id AS query_id, CAST(e.label AS VARCHAR) AS memory_id, {registry._DOT.format('e.embedding', 'q.embedding')} / (sqrt({registry._DOT.format('e.embedding', 'e.embedding')}) * sqrt({registry._DOT.format('q.embedding', 'q.embedding')})) AS s
      FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
    best AS (SELECT query_id, memory_id, max(s) AS similarity FROM sims GROUP BY ALL)
    SELECT query_id, memory_id, round(similarity * 1000) / 1000 AS similarity FROM best WHERE similarity >= 0.3"""
)
def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose number is divisible by 50, each searched for among all."""
    chunks = views.vectors(spark, sf_dir)
    return search.search_vectors(chunks, chunks.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@_query(registry.ORACLES["vector_queries"])
def vector_queries_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by pivots: pairs that can't be similar enough aren't compared."""
    chunks = views.vectors(spark, sf_dir)
    return vectors.search_vectors(chunks, chunks.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@_query(
    f"""WITH e AS (SELECT vec_id, label, CASE WHEN vec_id % 13 = 0 THEN embedding[1:32] ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 11 <> 0),
    sims AS (SELECT q.vec_id AS query_id, CAST(e.label AS VARCHAR) AS memory_id, {registry._DOT.format('e.embedding', 'q.embedding')} / (sqrt({registry._DOT.format('e.embedding', 'e.embedding')}) * sqrt({registry._DOT.format('q.embedding', 'q.embedding')})) AS s
      FROM e q, e WHERE q.vec_id % 50 = 0 AND len(q.embedding) = len(e.embedding)),
    best AS (SELECT query_id, memory_id, max(s) AS similarity FROM sims GROUP BY ALL)
    SELECT query_id, memory_id, round(similarity * 1000) / 1000 AS similarity FROM best WHERE similarity >= 0.3"""
)
def vector_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eleventh vector is missing and every thirteenth is half as long: both are similar to none of another length."""
    cut = F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    chunks = views.vectors(spark, sf_dir).withColumn("embedding", F.when(F.col("vec_id") % 11 != 0, cut))
    return vectors.search_vectors(chunks, chunks.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))


@_query(
    _FOUND
    + f""", scored AS (SELECT *, 0.4 + exp(-0.1 * (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 8.64e10) * 0.2
      + (CASE priority WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'low' THEN 0.25 ELSE 0.5 END) * 0.2 AS points FROM found),
    top AS (SELECT *, row_number() OVER (ORDER BY points DESC, id) AS place FROM scored QUALIFY place <= 50),
    budgets AS (SELECT unnest([1500, 1501, 1502, 1503, 2200, 2201, 2202, 2203, 3001, 4000]) AS budget),
    summed AS (SELECT budget, 4 * budget AS room, top.*, CAST(sum(strlen(content)) OVER (PARTITION BY budget ORDER BY place) AS BIGINT) AS upto, strlen(content) AS size FROM top, budgets),
    packed AS (SELECT *, upto > room AS excerpt, room - (upto - size) AS rest FROM summed WHERE upto <= room OR (upto - size <= room AND room - (upto - size) >= 100))
    SELECT budget, CAST(sum(CASE WHEN excerpt THEN rest + 3 ELSE size END) OVER (PARTITION BY budget) // 4 AS INTEGER) AS used, CAST(place AS INTEGER) AS place, key,
           CASE WHEN excerpt THEN substr(hex(encode(content)), 1, CAST(2 * rest AS INTEGER)) || '2E2E2E' ELSE hex(encode(content)) END AS bytes, excerpt FROM packed"""
)
def context_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of ten budgets over texts in all languages, as bytes: an excerpt may end within a character."""
    found = search.search_fts(mem_notes(spark, sf_dir), line_chunks(spark, sf_dir), "with that", AS_OF, limit=None)
    scored = found.withColumn("score", context.context_score(AS_OF)).orderBy(F.desc("score"), "id").limit(context.CANDIDATES)
    top, parts = written(scored, "candidates"), []
    for budget in (1500, 1501, 1502, 1503, 2200, 2201, 2202, 2203, 3001, 4000):
        parts.append(context.pack(top, budget).select("budget", "used", "place", "key", F.hex(F.col("content").cast("binary")).alias("bytes"), "excerpt"))
    return reduce(DataFrame.unionByName, parts)


_PLACED = "SELECT {0}, CAST(row_number() OVER (ORDER BY {1}) AS INTEGER) AS place FROM live QUALIFY place <= 40"


@_query(f"WITH {MEM_EVENTS_SQL} " + _PLACED.format("id, version", "ns, key, version DESC, id"))
def history_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 rows of all histories in their order."""
    rows = reads.history(views.mem_events(spark, sf_dir)).limit(40)
    return rows.select("id", "version", F.row_number().over(W.orderBy("ns", "key", F.desc("version"), "id")).alias("place"))


@_query(f"WITH {MEM_EVENTS_SQL} " + _PLACED.format("id, version", "ns, key, version, id"))
def export_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 rows of an export in their order."""
    rows = reads.export_all(views.mem_events(spark, sf_dir)).limit(40)
    return rows.select("id", "version", F.row_number().over(W.orderBy("ns", "key", "version", "id")).alias("place"))


@_query(
    f"""WITH {MEM_EVENTS_SQL} SELECT id, content, kind, CAST(version AS VARCHAR) AS version, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') AS expires_at,
    expires_at IS NOT NULL AS has_expiry FROM live"""
)
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export's JSON taken apart again: times are RFC 3339, nulls are left out."""
    rows = reads.export_all(views.mem_events(spark, sf_dir)).select(reads.json_row().alias("value"))
    fields = ["id", "content", "kind", "version", "created_at", "expires_at"]
    return rows.select(*[F.get_json_object("value", f"$.{f}").alias(f) for f in fields], F.contains("value", F.lit('"expires_at"')).alias("has_expiry"))


@_query("SELECT doc_id, lang || '|' || source || '|' || lang AS tags FROM documents")
def tags_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(",", F.concat(F.lit(" "), F.col("lang")), F.concat("source", F.lit("\t")), F.lit("  "), F.lit(""), F.col("lang"))
    return views.read(spark, sf_dir, "documents").select("doc_id", F.array_join(split_tags(text), "|").alias("tags"))


@_query(f"WITH {MEM_EVENTS_SQL}, keys AS (SELECT DISTINCT event_type AS ns, CAST(user_id * 2 AS VARCHAR) AS key FROM events) SELECT k.ns, k.key, l.id FROM keys k LEFT JOIN latest l ON k.ns = l.ns AND k.key = l.key")
def resolve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of the latest version of each key, expired or not; null for keys that there aren't."""
    keys = views.read(spark, sf_dir, "events").select(F.col("event_type").alias("ns"), (F.col("user_id") * 2).cast("string").alias("key")).distinct()
    return writes.resolve(views.mem_events(spark, sf_dir), keys).select("ns", "key", "id")


@_query(
    registry._TURNS
    + """, ends AS (SELECT CAST(unnest([conv_id * 1000 + turn, conv_id * 1000 + turn - 1]) AS VARCHAR) AS id FROM conversations WHERE turn > 0 AND conv_id % 3 <> 0)
    SELECT DISTINCT m.ns, m.key FROM mem_turns m JOIN top t USING (ns, key, version) JOIN ends e ON e.id = m.id"""
)
def rm_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of which a hard delete of the latest version is refused, as it has links."""
    memories = views.mem_turns(spark, sf_dir)
    return writes.refused(memories, writes.fold_links(views.link_log(spark, sf_dir)), memories.select("ns", "key"))


@_query(
    registry._TURNS
    + """, made AS (SELECT m.ns, m.key, CAST(m.version + t.version AS INTEGER) AS version FROM mem_turns m JOIN top t USING (ns, key))
    SELECT ns, key, version, sha256(ns || chr(31) || key || chr(31) || version || chr(31) || 'b1') AS id FROM made"""
)
def put_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = views.mem_turns(spark, sf_dir)
    puts = memories.select(F.col("version").cast("long").alias("seq"), "ns", "key", "content", "kind", "tags", "priority", "meta", F.lit("").alias("ttl"))
    return writes.put_versions(memories, puts, AS_OF, "b1").select("ns", "key", "version", "id")


@_query(
    f"""WITH RECURSIVE turns AS (SELECT conv_id, '# ' || role AS head, regexp_replace(replace(text, chr(10), ' '), {registry._SPACES}, '', 'g') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    parts AS (SELECT conv_id, k, head, body, head || chr(10) || body AS part, 2 * k - 1 AS first, strlen(head || chr(10) || body) AS size FROM turns),
    wholes AS (SELECT conv_id, string_agg(part, chr(10) ORDER BY k) AS t, count(*) AS n, list(size ORDER BY k) AS sizes FROM parts GROUP BY conv_id),
    walk AS (
      SELECT conv_id, sizes, n, 1 AS k, 1 AS g, sizes[1] AS held FROM wholes WHERE strlen(t) > 600
      UNION ALL
      SELECT conv_id, sizes, n, k + 1, CASE WHEN held + 2 + sizes[k + 1] > 400 THEN k + 1 ELSE g END,
             CASE WHEN held + 2 + sizes[k + 1] > 400 THEN sizes[k + 1] ELSE held + 2 + sizes[k + 1] END
      FROM walk WHERE k < n),
    joined AS (SELECT w.conv_id, w.g, string_agg(p.part, chr(10) || chr(10) ORDER BY p.k) AS t, min(p.first) AS first, count(*) AS n FROM walk w JOIN parts p USING (conv_id, k) GROUP BY w.conv_id, w.g)
    SELECT CAST(conv_id AS VARCHAR) AS memory_id, 1 AS start_line, CAST(2 * n AS INTEGER) AS end_line, t AS text FROM wholes WHERE strlen(t) <= 600
    UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(first AS INTEGER), CAST(first + 3 * n - 2 AS INTEGER), t FROM joined WHERE strlen(t) <= 600
    UNION ALL SELECT CAST(p.conv_id AS VARCHAR), CAST(p.first AS INTEGER), CAST(p.first AS INTEGER), p.head FROM joined j JOIN parts p ON p.conv_id = j.conv_id AND p.k = j.g WHERE strlen(j.t) > 600
    UNION ALL SELECT CAST(p.conv_id AS VARCHAR), CAST(p.first + 1 AS INTEGER), CAST(p.first + 1 AS INTEGER), p.body FROM joined j JOIN parts p ON p.conv_id = j.conv_id AND p.k = j.g WHERE strlen(j.t) > 600"""
)
def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a heading for each turn: parted before headings, small parts joined, large ones cut by lines."""
    rows = views.read(spark, sf_dir, "conversations")
    part = F.concat(F.lit("# "), F.col("role"), F.lit("\n"), chunking.trim_space(F.replace("text", F.lit("\n"), F.lit(" "))))
    turns = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    memories = rows.groupBy("conv_id").agg(turns.alias("turns")).select(F.col("conv_id").cast("string").alias("id"), F.array_join(F.transform("turns", lambda t: t["part"]), "\n").alias("content"))
    return chunking.chunk_rows(memories).select("memory_id", "start_line", "end_line", "text")
