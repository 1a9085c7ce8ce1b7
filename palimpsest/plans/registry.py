"""Queries of the engine over the given tables, and the DuckDB SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import ACCENTED, PLAIN, round_half_away, ttl_seconds
from palimpsest.operators import chunking, context, reads, search, writes
from palimpsest.operators.filters import visible
from palimpsest.plans import views
from palimpsest.plans.views import AS_OF, MEM_DOCS_SQL, MEM_EVENTS_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_ROW = "id, ns, key, kind, version, priority, access_count, created_at, expires_at"
_COLS = _ROW.split(", ")
_EVENTS = f"WITH {MEM_EVENTS_SQL}"
_DOCS = f"WITH {MEM_DOCS_SQL}"


@_query(f"{_EVENTS} SELECT {_ROW} FROM visible")
def list_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_memories(views.mem_events(spark, sf_dir), AS_OF, limit=None).select(_COLS)


@_query(f"{_EVENTS} SELECT {_ROW} FROM visible ORDER BY created_at DESC, id LIMIT 20")
def list_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_memories(views.mem_events(spark, sf_dir), AS_OF).select(_COLS)


@_query(f"{_EVENTS} SELECT {_ROW} FROM visible WHERE kind = 'episodic'")
def list_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_memories(views.mem_events(spark, sf_dir), AS_OF, kind="episodic", limit=None).select(_COLS)


@_query(f"{_EVENTS} SELECT {_ROW} FROM visible WHERE ns = (SELECT min(event_type) FROM events)")
def list_by_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = views.mem_events(spark, sf_dir)
    ns = views.read(spark, sf_dir, "events").agg(F.min("event_type")).scalar()
    return visible(memories.filter(F.col("ns") == ns), AS_OF).select(_COLS)


@_query(f"{_DOCS} SELECT id, ns, kind FROM mem_docs WHERE list_contains(tags, 'en') AND list_contains(tags, 'src1')")
def list_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.list_memories(views.mem_docs(spark, sf_dir), AS_OF, tags=["en", "src1"], limit=None).select("id", "ns", "kind")


@_query(f"{_EVENTS} SELECT ns || '/' || key AS path FROM visible")
def keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.keys_only(reads.list_memories(views.mem_events(spark, sf_dir), AS_OF, limit=None))


_NEWEST = f"""{_EVENTS}, newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ns, key ORDER BY version DESC, id) AS r
                 FROM live WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31 00:00:00') WHERE r = 1)"""


@_query(f"{_NEWEST} SELECT {_ROW} FROM newest")
def get_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.newest(views.mem_events(spark, sf_dir), AS_OF).select(_COLS)


@_query(f"{_EVENTS} SELECT {_ROW} FROM live WHERE version = 2 AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31 00:00:00')")
def get_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.versions_at(views.mem_events(spark, sf_dir), 2, AS_OF).select(_COLS)


@_query(f"{_EVENTS} SELECT {_ROW} FROM live")
def get_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.history(views.mem_events(spark, sf_dir)).select(_COLS)


@_query(f"{_NEWEST} SELECT n.ns, n.key, n.version FROM newest n ANTI JOIN visible v ON n.ns = v.ns AND n.key = v.key")
def get_vs_list_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that get finds and list doesn't, as their top version has expired."""
    memories = views.mem_events(spark, sf_dir)
    return reads.newest(memories, AS_OF).join(visible(memories, AS_OF), ["ns", "key"], "left_anti").select("ns", "key", "version")


@_query(f"{_EVENTS} SELECT count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS active, (SELECT count(*) FROM documents) AS chunks FROM mem_events")
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.stats_totals(views.mem_events(spark, sf_dir), views.doc_chunks(spark, sf_dir))


@_query(f'{_EVENTS} SELECT ns, count(*) AS "count", count(DISTINCT key) AS keys FROM live GROUP BY ns')
def ns_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.ns_stats(views.mem_events(spark, sf_dir))


@_query(f"{_EVENTS} SELECT {_ROW}, content FROM live")
def export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.export_all(views.mem_events(spark, sf_dir)).select(*_COLS, "content")


_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(f"{_DOCS} SELECT id, ns, key, created_at FROM mem_docs WHERE contains({_FOLDED.format('content')}, 'that with') OR contains(key, 'that with')")
def search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_like(views.mem_docs(spark, sf_dir), views.doc_chunks(spark, sf_dir), "That WITH", AS_OF_DOCS, limit=None).select("id", "ns", "key", "created_at")


@_query(f"{_DOCS} SELECT id, ns, key, created_at FROM mem_docs WHERE ns = 'src3' AND {_FOLDED.format('content')} LIKE '%the%that_w%'")
def search_like_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_like(views.mem_docs(spark, sf_dir), views.doc_chunks(spark, sf_dir), "the%that_w", AS_OF_DOCS, ns="src3", limit=None).select("id", "ns", "key", "created_at")


#: No memory of documents has been made later at any scale.
AS_OF_DOCS = "2100-01-01 00:00:00"

_TOKENS = f"list_filter(regexp_split_to_array(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_POSTINGS = f"WITH words AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_TOKENS} AS w FROM documents), postings AS (SELECT term, chunk_id, count(*) AS tf, CAST(max(dl) AS BIGINT) AS dl FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY term, chunk_id)"


@_query(f"{_POSTINGS} SELECT term, chunk_id, tf, dl FROM postings")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(views.doc_chunks(spark, sf_dir)).select("term", "chunk_id", "tf", "dl")


@_query(f"{_POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM postings GROUP BY term")
def fts_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(views.doc_chunks(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def _bm25_sql(*terms: str) -> str:
    tf = ", ".join(f"CAST(len(list_filter(w, lambda t: t = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i in range(len(terms)))
    idf = "CASE WHEN n - df{0} + 0.5 <= df{0} + 0.5 THEN 0.000001 ELSE ln((n - df{0} + 0.5) / (df{0} + 0.5)) END"
    part = f"({idf}) * tf{{0}} * 2.2 / (tf{{0}} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""WITH words AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_TOKENS} AS w FROM documents),
    counted AS (SELECT chunk_id, CAST(len(w) AS DOUBLE) AS dl, {tf} FROM words),
    counts AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl, {df} FROM counted),
    bm25 AS (SELECT chunk_id, {" + ".join(part.format(i) for i in range(len(terms)))} AS bm25 FROM counted, counts WHERE {every})"""


@_query(_bm25_sql("bleble", "that") + " SELECT chunk_id FROM counted WHERE tf0 > 0 AND tf1 > 0")
def fts_match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(views.doc_chunks(spark, sf_dir), "Bleble that").select("chunk_id")


@_query(_bm25_sql("with", "that") + " SELECT chunk_id, round(bm25 * 1000000) / 1000000 AS bm25 FROM bm25")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(views.doc_chunks(spark, sf_dir), "with that").select("chunk_id", round_half_away(F.col("bm25"), 6).alias("bm25"))


_RANKED = (
    _bm25_sql("bleble", "that")
    + f""", {MEM_DOCS_SQL}, ranked AS (SELECT id, created_at, 2 * 0.2 + (epoch_us(created_at) / 8.64e10 + 2440587.5) / (epoch_us(TIMESTAMP '2100-01-01 00:00:00') / 8.64e10 + 2440587.5) * 0.3 + bm25 * 0.5 AS score
    FROM mem_docs JOIN bm25 ON id = chunk_id)"""
)


@_query(_RANKED + " SELECT id, round(score * 1000000) / 1000000 AS score FROM ranked")
def search_fts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_fts(views.mem_docs(spark, sf_dir), views.doc_chunks(spark, sf_dir), "bleble that", AS_OF_DOCS, limit=None)
    return found.select("id", round_half_away(F.col("score"), 6).alias("score"))


@_query(
    _RANKED
    + f""", top AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM ranked QUALIFY place <= 20),
    alike AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS place FROM mem_docs WHERE contains({_FOLDED.format('content')}, 'bleble that') QUALIFY place <= 20),
    room AS (SELECT 20 - count(*) AS n FROM top)
    SELECT id, CAST(place AS INTEGER) AS place FROM top UNION ALL
    SELECT id, CAST(place + 20 AS INTEGER) FROM alike, room WHERE place <= n AND id NOT IN (SELECT id FROM top)"""
)
def search_hybrid_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits, then substring hits."""
    return search.search_keywords(views.mem_docs(spark, sf_dir), views.doc_chunks(spark, sf_dir), "bleble that", AS_OF_DOCS).select("id", "place")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_BEST = f"""WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1),
    sims AS (SELECT CAST(label AS VARCHAR) AS memory_id, {_DOT.format('embedding', 'v')} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format('v', 'v')})) AS s FROM embeddings, q),
    best AS (SELECT memory_id, max(s) AS similarity FROM sims GROUP BY memory_id),
    near AS (SELECT memory_id, round(similarity * 1000) / 1000 AS similarity FROM best WHERE similarity >= 0.3)"""


@_query(_BEST + " SELECT memory_id, round(similarity * 1000000) / 1000000 AS similarity FROM best")
def vector_best_per_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.best_similarity(views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir))
    return best.select("memory_id", round_half_away(F.col("similarity"), 6).alias("similarity"))


@_query(_BEST + " SELECT memory_id, similarity FROM near")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.above_threshold(search.best_similarity(views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir)))


@_query(_BEST + " SELECT memory_id AS id, similarity FROM near")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_vector(views.mem_labels(spark, sf_dir), views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), AS_OF, limit=None)
    return found.select("id", "similarity")


@_query(
    _BEST
    + """, hits AS (SELECT DISTINCT CAST(label AS VARCHAR) AS id FROM embeddings WHERE CAST(label AS VARCHAR) LIKE '%1%')
    SELECT id, 0.0::DOUBLE AS similarity FROM hits UNION ALL SELECT memory_id, similarity FROM near WHERE memory_id NOT IN (SELECT id FROM hits)"""
)
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits count as of similarity 0."""
    memories, chunks = views.mem_labels(spark, sf_dir), views.vectors(spark, sf_dir)
    words = views.mem_labels(spark, sf_dir).select("id", F.col("id").alias("memory_id"), F.col("content").alias("text"))
    keyword = search.search_like(memories, words, "1", AS_OF, limit=None)
    near = search.search_vector(memories, chunks, views.query_vector(spark, sf_dir), AS_OF, limit=None)
    return search.merge_hybrid(keyword, near, limit=None).select("id", "similarity")


_SCORE = """0.4 + exp(-0.1 * (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(created_at)) / 8.64e10) * 0.2
    + (CASE priority WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'low' THEN 0.25 ELSE 0.5 END) * 0.2
    + (CASE WHEN access_count > 0 THEN least(1.0, ln(access_count + 1.0) / ln(100.0)) ELSE 0.0 END) * 0.2"""


@_query(f"{_EVENTS} SELECT id, round(CAST({_SCORE} AS DOUBLE) * 1000000) / 1000000 AS score FROM visible")
def context_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visible(views.mem_events(spark, sf_dir), AS_OF)
    return rows.select("id", round_half_away(context.context_score(AS_OF), 6).alias("score"))


_PACK = f"""{_EVENTS}, scored AS (SELECT *, round(CAST({_SCORE} AS DOUBLE) * 1000000) / 1000000 AS score FROM visible),
    top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM scored QUALIFY place <= 50),
    summed AS (SELECT *, CAST(sum(strlen(content)) OVER (ORDER BY place) AS BIGINT) AS upto, strlen(content) AS size FROM top),
    packed AS (SELECT *, upto > 400 AS excerpt FROM summed WHERE upto <= 400 OR (upto - size <= 400 AND 400 - (upto - size) >= 100))"""


@_query(
    _PACK
    + """ SELECT id, CAST(place AS INTEGER) AS place, excerpt, CAST(CASE WHEN excerpt THEN 400 - (upto - size) + 3 ELSE size END AS BIGINT) AS bytes,
    CASE WHEN excerpt THEN substr(content, 1, CAST(400 - (upto - size) AS INTEGER)) || '...' ELSE content END AS content, round(score * 100) / 100 AS score,
    CAST(sum(CASE WHEN excerpt THEN 400 - (upto - size) + 3 ELSE size END) OVER () // 4 AS INTEGER) AS used FROM packed"""
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 memories packed into 100 tokens."""
    rows = visible(views.mem_events(spark, sf_dir), AS_OF).withColumn("score", round_half_away(context.context_score(AS_OF), 6))
    packed = context.pack(rows.orderBy(F.desc("score"), "id").limit(context.CANDIDATES), 100)
    return packed.select("id", "place", "excerpt", "bytes", "content", "score", "used")


_SPACES = r"'^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$'"
_BARE = f"bare AS (SELECT CAST(doc_id AS VARCHAR) AS memory_id, regexp_replace(coalesce(text, ''), {_SPACES}, '', 'g') AS t FROM documents)"


@_query(f"WITH {_BARE} SELECT memory_id, t AS text, CAST(1 + len(t) - len(replace(t, chr(10), '')) AS INTEGER) AS end_line FROM bare WHERE t <> '' AND strlen(t) <= 600")
def chunk_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.mem_docs(spark, sf_dir).filter(F.octet_length(chunking.trim_space(F.coalesce("content", F.lit("")))) <= chunking.MAX_BYTES)
    return chunking.chunk_rows(docs).select("memory_id", "text", "end_line")


@_query(
    f"""WITH RECURSIVE {_BARE},
    long AS (SELECT memory_id, string_split(t, chr(10)) AS lines FROM bare WHERE strlen(t) > 600),
    walk AS (
      SELECT memory_id, lines, 1 AS i, 0 AS seq, 1 AS first, strlen(lines[1]) + 1 AS held FROM long
      UNION ALL
      SELECT memory_id, lines, i + 1,
             CASE WHEN held + strlen(lines[i + 1]) > 400 THEN seq + 1 ELSE seq END,
             CASE WHEN held + strlen(lines[i + 1]) > 400 THEN i + 1 ELSE first END,
             CASE WHEN held + strlen(lines[i + 1]) > 400 THEN 0 ELSE held END + strlen(lines[i + 1]) + 1
      FROM walk WHERE i < len(lines)),
    pieces AS (SELECT memory_id, first, max(i) AS last, any_value(lines) AS lines FROM walk GROUP BY memory_id, seq, first),
    cut AS (SELECT memory_id, first, last, regexp_replace(array_to_string(lines[first:last], chr(10)), {_SPACES}, '', 'g') AS text FROM pieces),
    whole AS (SELECT memory_id, 1 AS first, 1 + len(t) - len(replace(t, chr(10), '')) AS last, t AS text FROM bare WHERE t <> '' AND strlen(t) <= 600)
    SELECT memory_id, CAST(first AS INTEGER) AS start_line, CAST(last AS INTEGER) AS end_line, text FROM cut WHERE text <> ''
    UNION ALL SELECT memory_id, CAST(first AS INTEGER), CAST(last AS INTEGER), text FROM whole"""
)
def chunk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in chunks. The SQL has no headings and no blank lines after one another, of which the
    documents have none; tests cover these."""
    return chunking.chunk_rows(views.mem_docs(spark, sf_dir)).select("memory_id", "start_line", "end_line", "text")


_LINKED = """WITH turns AS (SELECT conv_id, conv_id * 1000 + turn AS t, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS created_at FROM conversations WHERE turn > 0),
    links AS (SELECT CAST(t AS VARCHAR) AS from_id, CAST(t - 1 AS VARCHAR) AS to_id, 'refines' AS rel, created_at, conv_id FROM turns)"""


@_query(_LINKED + " SELECT from_id, to_id, rel, created_at FROM links")
def links_create_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link is made twice; the first one stays."""
    return writes.fold_links(views.link_log(spark, sf_dir).filter("op = 'link'")).select("from_id", "to_id", "rel", "created_at")


@_query(_LINKED + " SELECT from_id, to_id, rel, created_at FROM links WHERE conv_id % 3 <> 0")
def links_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.fold_links(views.link_log(spark, sf_dir)).select("from_id", "to_id", "rel", "created_at")


@_query(_LINKED + " SELECT unnest([from_id, to_id]) AS id, from_id, to_id, rel FROM links WHERE conv_id % 3 <> 0")
def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.links_each(writes.fold_links(views.link_log(spark, sf_dir)))


_TURNS = """WITH mem_turns AS (SELECT CAST(conv_id * 1000 + turn AS VARCHAR) AS id, role AS ns, CAST(conv_id AS VARCHAR) AS key, text AS content, turn,
    CAST(row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) AS INTEGER) AS version FROM conversations),
    top AS (SELECT ns, key, max(version) AS version FROM mem_turns GROUP BY ns, key)"""


def _keys(memories: DataFrame) -> DataFrame:
    """The keys of user turns."""
    return memories.filter("ns = 'user'").select("ns", "key").distinct()


@_query(
    _TURNS
    + """ SELECT m.ns, m.key, m.content, t.version + m.version AS version, CASE WHEN m.version = 1 THEN o.id END AS replaced
    FROM mem_turns m JOIN top t USING (ns, key) JOIN mem_turns o ON o.ns = t.ns AND o.key = t.key AND o.version = t.version"""
)
def put_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn put once more: versions go on after those that are there."""
    memories = views.mem_turns(spark, sf_dir)
    puts = memories.select(F.col("version").cast("long").alias("seq"), "ns", "key", "content", "kind", "tags", "priority", "meta", F.lit("7d").alias("ttl"))
    rows = writes.put_versions(memories, puts, AS_OF)
    made = F.length("supersedes") == 64
    return rows.select("ns", "key", "content", "version", F.when(~made, F.col("supersedes")).alias("replaced"))


@_query(_TURNS + " SELECT m.id, m.ns = 'user' AND m.version = t.version AS deleted FROM mem_turns m JOIN top t USING (ns, key)")
def rm_soft_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = views.mem_turns(spark, sf_dir)
    return writes.soft_delete(memories, _keys(memories), AS_OF).select("id", F.col("deleted_at").isNotNull().alias("deleted"))


@_query(_TURNS + " SELECT id, ns = 'user' AS deleted FROM mem_turns")
def rm_soft_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = views.mem_turns(spark, sf_dir)
    return writes.soft_delete(memories, _keys(memories), AS_OF, all_versions=True).select("id", F.col("deleted_at").isNotNull().alias("deleted"))


@_query(_TURNS + " SELECT m.id, m.version FROM mem_turns m JOIN top t USING (ns, key) WHERE NOT (m.ns = 'user' AND m.version = t.version)")
def rm_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = views.mem_turns(spark, sf_dir)
    return writes.hard_delete(memories, _keys(memories)).select("id", "version")


@_query(_TURNS + " SELECT id, version FROM mem_turns WHERE ns <> 'user'")
def rm_hard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = views.mem_turns(spark, sf_dir)
    return writes.hard_delete(memories, _keys(memories), all_versions=True).select("id", "version")


@_query(
    """WITH seen AS (SELECT conv_id * 1000 AS id, count(*) AS n, max(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn)) AS last_at FROM conversations GROUP BY conv_id)
    SELECT CAST(c.conv_id * 1000 + c.turn AS VARCHAR) AS id, CAST(coalesce(n, 0) AS INTEGER) AS access_count, last_at AS last_accessed_at
    FROM conversations c LEFT JOIN seen ON seen.id = c.conv_id * 1000 + c.turn"""
)
def access_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn counts as a use of its conversation's first turn."""
    memories = views.mem_turns(spark, sf_dir)
    turns = views.read(spark, sf_dir, "conversations")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))
    uses = turns.select((F.col("conv_id") * 1000).cast("string").alias("id"), at.alias("ts"))
    return writes.record_access(memories, uses).select("id", "access_count", "last_accessed_at")


@_query(_TURNS + " SELECT m.ns, m.key, m.content, CAST(m.version + t.version AS INTEGER) AS version FROM mem_turns m JOIN top t USING (ns, key)")
def import_resequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export imported again: nothing is skipped, versions, times and ids are new."""
    memories = views.mem_turns(spark, sf_dir)
    return writes.put_versions(memories, writes.import_puts(reads.export_all(memories)), AS_OF, "import").select("ns", "key", "content", "version")


@_query(
    """WITH t AS (SELECT event_id, CAST(event_id % 1000 AS VARCHAR) || ['d', 'h', 'm', 's', 'x'][event_id % 5 + 1] AS ttl FROM events)
    SELECT event_id, ttl, CASE right(ttl, 1) WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 WHEN 's' THEN 1 END * CAST(left(ttl, length(ttl) - 1) AS BIGINT) AS seconds FROM t"""
)
def ttl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in "dhmsx"]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = views.read(spark, sf_dir, "events").select("event_id", F.concat((F.col("event_id") % 1000).cast("string"), unit).alias("ttl"))
    return rows.select("event_id", "ttl", ttl_seconds(F.col("ttl")).alias("seconds"))


from palimpsest.plans import cases as cases  # noqa: E402  adds its queries to these
from palimpsest.plans import stored as stored  # noqa: E402
