"""The given tables as memories, chunks and links; the same derivations as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.schema import MEMORY_COLS

AS_OF = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _memories(rows: DataFrame) -> DataFrame:
    defaults = {
        "kind": F.lit("semantic"),
        "tags": F.lit(None).cast("array<string>"),
        "version": F.lit(1),
        "supersedes": F.lit(None).cast("string"),
        "deleted_at": F.lit(None).cast("timestamp_ntz"),
        "priority": F.lit("normal"),
        "access_count": F.lit(0),
        "last_accessed_at": F.lit(None).cast("timestamp_ntz"),
        "meta": F.lit(None).cast("string"),
        "expires_at": F.lit(None).cast("timestamp_ntz"),
    }
    return rows.withColumns({c: x for c, x in defaults.items() if c not in rows.columns}).select(MEMORY_COLS)


def mem_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a version of the memory of its user in the namespace of its type; some have expired or are deleted."""
    of_key = W.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = read(spark, sf_dir, "events").withColumns({"k": k, "version": F.row_number().over(of_key)})
    kind = F.element_at(F.array(*[F.lit(x) for x in ("semantic", "episodic", "procedural")]), F.col("k") % 3 + 1)
    priority = F.element_at(F.array(*[F.lit(x) for x in ("low", "normal", "high", "critical")]), F.col("k") % 4 + 1)
    return _memories(
        rows.select(
            F.col("event_id").cast("string").alias("id"),
            F.col("event_type").alias("ns"),
            F.col("user_id").cast("string").alias("key"),
            F.col("props").alias("content"),
            kind.alias("kind"),
            "version",
            F.col("ts").cast("timestamp_ntz").alias("created_at"),
            F.when(F.col("event_id") % 10 == 0, F.col("ts").cast("timestamp_ntz")).alias("deleted_at"),
            priority.alias("priority"),
            F.col("k").alias("access_count"),
            F.when(F.col("k") % 3 == 0, F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(F.col("k") % 30)).alias("expires_at"),
        )
    )


def mem_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "semantic").when(F.col("lang") == "de", "episodic").otherwise("procedural")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
    return _memories(
        rows.select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("source").alias("ns"),
            F.col("doc_id").cast("string").alias("key"),
            F.col("text").alias("content"),
            kind.alias("kind"),
            F.array("lang", "source").alias("tags"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("created_at"),
        )
    )


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk of its memory."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("memory_id"), F.lit(0).alias("seq"), "text", F.lit(1).alias("start_line"), F.lit(1).alias("end_line")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a chunk of the memory of its label."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("memory_id"), "vec_id", "embedding")


def mem_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory for each label of the vectors."""
    rows = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("first"))
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("label").cast("int"))
    name = F.col("label").cast("string")
    return _memories(rows.select(name.alias("id"), F.lit("labels").alias("ns"), name.alias("key"), F.concat(F.lit("label "), name).alias("content"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("created_at")))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first vector, as the vector of a query."""
    return read(spark, sf_dir, "embeddings").agg(F.min_by("embedding", "vec_id").alias("v")).first()["v"]


def mem_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is a version of its role's memory of the conversation."""
    of_key = W.partitionBy("role", "conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("version", F.row_number().over(of_key))
    turn = F.col("conv_id") * 1000 + F.col("turn")
    return _memories(
        rows.select(
            turn.cast("string").alias("id"),
            F.col("role").alias("ns"),
            F.col("conv_id").cast("string").alias("key"),
            F.col("text").alias("content"),
            "version",
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("turn").cast("int"))).alias("created_at"),
        )
    )


def link_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that links every turn to the one before it, links each once more, and then unlinks those of every third
    conversation."""
    rows = read(spark, sf_dir, "conversations").filter("turn > 0")
    turn = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda step: start + F.make_dt_interval(F.lit(step), F.lit(0), F.col("turn").cast("int"))
    base = 10_000_000_000_000
    line = lambda step, op: rows.select((turn + step * base).alias("op_seq"), F.lit(op).alias("op"), turn.cast("string").alias("id"), at(step).alias("ts"), (turn - 1).cast("string").alias("to_id"), F.lit("refines").alias("rel"), "conv_id")
    gone = line(2, "unlink").filter("conv_id % 3 = 0")
    return line(0, "link").unionByName(line(1, "link")).unionByName(gone).drop("conv_id")


MEM_EVENTS_SQL = """
mem_events AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_type AS ns, CAST(user_id AS VARCHAR) AS key, props AS content,
         ['semantic', 'episodic', 'procedural'][k % 3 + 1] AS kind, version, ts AS created_at,
         CASE WHEN event_id % 10 = 0 THEN ts END AS deleted_at,
         ['low', 'normal', 'high', 'critical'][k % 4 + 1] AS priority, k AS access_count,
         CASE WHEN k % 3 = 0 THEN ts + to_days(k % 30) END AS expires_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS INTEGER) AS version FROM events)),
live AS (SELECT * FROM mem_events WHERE deleted_at IS NULL),
latest AS (SELECT m.* FROM live m JOIN (SELECT ns, key, max(version) AS version FROM live GROUP BY ns, key) USING (ns, key, version)),
visible AS (SELECT * FROM latest WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-31 00:00:00')
"""
MEM_DOCS_SQL = """
mem_docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS ns, CAST(doc_id AS VARCHAR) AS key, text AS content,
         CASE lang WHEN 'en' THEN 'semantic' WHEN 'de' THEN 'episodic' ELSE 'procedural' END AS kind, [lang, source] AS tags,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at
  FROM documents)
"""
