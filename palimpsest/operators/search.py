"""Substring search, ranked keyword search, vector search, and their merging."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import as_timestamp, fold_token, julian_day, let, like_substring, query_terms, round_half_away, tokens
from palimpsest.operators.filters import visible
from palimpsest.schema import MEMORY_COLS

SEARCH_LIMIT = 20
MIN_SIMILARITY = 0.3
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Weights of a search score.
PRIORITY, RECENCY, RANK = 0.2, 0.3, 0.5
#: What a priority counts in search.
SEARCH_PRIORITY = {"critical": 4.0, "high": 3.0, "normal": 2.0}


def _limit(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit if limit > 0 else SEARCH_LIMIT)


def search_like(memories: DataFrame, chunks: DataFrame, query: str, as_of, ns: str | None = None, kind: str | None = None, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """Latest rows with the query in content, key or a chunk, newest first. A memory comes once however many of its
    chunks hold the query."""
    rows = visible(memories, as_of, ns, kind)
    own = rows.filter(like_substring(F.col("content"), query) | like_substring(F.col("key"), query))
    held = chunks.filter(like_substring(F.col("text"), query)).select(F.col("memory_id").alias("id")).distinct()
    other = rows.join(held, "id", "left_semi")
    found = own.select(MEMORY_COLS).unionByName(other.select(MEMORY_COLS)).dropDuplicates(["id"])
    return _limit(found.orderBy(F.desc("created_at"), "id"), limit)


def term_counts(words: Column) -> Column:
    """(term, tf) of an array of words: how often each is in it, by the places where the sorted words change."""
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w, at: F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("long").alias("tf")))
    counted = let(F.sort_array(words), lambda w: let(starts(w), lambda at: runs(w, at)))
    return F.when(F.size(words) > 0, counted)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, memory_id, tf, dl): how often each token is in each chunk, and the chunk's tokens in all. A chunk is
    counted by itself, without a shuffle; only ids that come twice, which are looked for first, have their counts put together."""
    words = chunks.select(F.col("id").alias("chunk_id"), "memory_id", tokens(F.col("text")).alias("words"))
    each = words.select("chunk_id", "memory_id", F.size("words").cast("long").alias("dl"), F.inline(term_counts(F.col("words")))).select("term", "chunk_id", "memory_id", "tf", "dl")
    twice = chunks.groupBy(F.xxhash64("id").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    if twice.isEmpty():
        return each
    once = each.join(twice, F.xxhash64("chunk_id") == F.col("h"), "left_anti")
    more = each.join(twice, F.xxhash64("chunk_id") == F.col("h"), "left_semi").groupBy("term", "chunk_id", "memory_id", "dl").agg(F.sum("tf").alias("tf"))
    return once.unionByName(more)


def bm25_by_index(index, query: str) -> DataFrame:
    """What bm25() gives, by a stored index (operators/indexed.py)."""
    from palimpsest.operators import indexed

    return indexed.bm25_by_index(index, query)


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """(chunk_id, memory_id, bm25) of the chunks that hold all terms of the query; higher is better. The statistics are
    those of all chunks, of old and deleted memories too. A query without terms finds nothing."""
    terms = query_terms(query)
    if not terms:
        return chunks.select(F.col("id").alias("chunk_id"), "memory_id", F.lit(0.0).alias("bm25")).limit(0)
    tf = [f"tf{i}" for i in range(len(terms))]
    every = _term_counts(chunks, terms)
    counts = every.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(x) > 0).cast("double").alias(x.replace("tf", "df")) for x in tf])
    # a chunk without a term's letters isn't taken apart
    likely = chunks
    for term in terms:
        likely = likely.filter(F.contains(fold_token(F.col("text")), F.lit(term)))
    # one row of scalars
    scored = _term_counts(likely, terms).filter(" AND ".join(f"{x} > 0" for x in tf)).join(F.broadcast(counts))
    total = reduce(add, [_bm25_part(F.col(f"tf{i}"), F.col(f"df{i}")) for i in range(len(terms))])
    return scored.select("chunk_id", "memory_id", total.alias("bm25"))


def _term_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id, memory_id, dl, tf0, tf1...): the tokens of each chunk, and those that are the terms."""
    words = chunks.select(F.col("id").alias("chunk_id"), "memory_id", tokens(F.col("text")).alias("words"))
    n, others = F.size("words"), lambda term: F.size(F.array_remove("words", term))
    return words.select("chunk_id", "memory_id", n.cast("double").alias("dl"), *[(n - others(t)).cast("double").alias(f"tf{i}") for i, t in enumerate(terms)])


def _bm25_part(tf: Column, df: Column, n: Column | None = None, dl: Column | None = None, avgdl: Column | None = None) -> Column:
    """A term's part; the columns n, dl and avgdl are those of these names unless they are given."""
    n, dl, avgdl = (F.col(name) if given is None else given for name, given in (("n", n), ("dl", dl), ("avgdl", avgdl)))
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search_score(as_of) -> Column:
    """Of a memory row with rank: priority, recency and the rank of its best chunk."""
    weight = F.coalesce(*[F.when(F.col("priority") == p, F.lit(w)) for p, w in SEARCH_PRIORITY.items()], F.lit(1.0))
    return weight * PRIORITY + julian_day(F.col("created_at")) / julian_day(as_timestamp(as_of)) * RECENCY + F.col("rank") * RANK


def search_fts(memories: DataFrame, chunks: DataFrame, query: str, as_of, ns: str | None = None, kind: str | None = None, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    """Latest rows with all terms of the query in one chunk, with score: priority, recency and the best chunk's rank."""
    best = bm25(chunks, query).groupBy("memory_id").agg(F.max("bm25").alias("rank"))
    rows = visible(memories, as_of, ns, kind).join(best, F.col("id") == F.col("memory_id"))
    return _limit(rows.select(*MEMORY_COLS, search_score(as_of).alias("score")).orderBy(F.desc("score"), "id"), limit)


def search_keywords(memories: DataFrame, chunks: DataFrame, query: str, as_of, ns: str | None = None, kind: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Ranked hits first, then substring hits; the latter are as many as the former leave room for, counted before those
    that come twice are left out. place orders the rows."""
    from pyspark.sql import Window as W

    limit = limit if limit > 0 else SEARCH_LIMIT
    ranked = search_fts(memories, chunks, query, as_of, ns, kind, limit)
    like = search_like(memories, chunks, query, as_of, ns, kind, limit)
    # both sides have at most `limit` rows
    ranked = ranked.withColumn("place", F.row_number().over(W.orderBy(F.desc("score"), "id"))).drop("score")
    like = like.withColumn("place", F.row_number().over(W.orderBy(F.desc("created_at"), "id")))
    room = limit - ranked.agg(F.count(F.lit(1))).scalar()
    like = like.filter(F.col("place") <= room).join(ranked.select("id"), "id", "left_anti").withColumn("place", (F.col("place") + limit).cast("int"))
    return ranked.unionByName(like).orderBy("place")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if the lengths differ, or if one is empty or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def best_similarity(chunks: DataFrame, query: list[float]) -> DataFrame:
    """(memory_id, similarity): the best of each memory's chunks that have an embedding."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    return chunks.filter("embedding IS NOT NULL").groupBy("memory_id").agg(F.max(cosine(F.col("embedding"), vector)).alias("similarity"))


def above_threshold(best: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """Those of at least that similarity, which is rounded only then."""
    return best.filter(F.col("similarity") >= least).withColumn("similarity", round_half_away(F.col("similarity"), 3))


def search_vector(memories: DataFrame, chunks: DataFrame, query: list[float], as_of, ns: str | None = None, kind: str | None = None, limit: int | None = SEARCH_LIMIT) -> DataFrame:
    rows = visible(memories, as_of, ns, kind)
    held = chunks.join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    best = above_threshold(best_similarity(held, query))
    found = rows.join(best, rows["id"] == best["memory_id"]).select(*MEMORY_COLS, "similarity")
    return _limit(found.orderBy(F.desc("similarity"), "id"), limit)


#: Query vectors that are compared with all rows at once.
QUERY_BLOCK = 8192


def search_vectors(chunks: DataFrame, queries: DataFrame, least: float = MIN_SIMILARITY, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, memory_id, similarity) of at least that similarity, for each of queries (query_id, embedding): the best
    of a memory's chunks. The queries go against all chunks in blocks of about `block`, as products of matrices."""
    from palimpsest.operators import vectors

    return vectors.search_vectors(chunks, queries, least, block, n_pivots=0)


def all_pairs(chunks: DataFrame, queries: DataFrame, least: float = MIN_SIMILARITY, block: int = QUERY_BLOCK) -> DataFrame:
    """The same by Spark's columns, pair by pair, for a similarity of 0 or less too, which vectors have that can't be compared."""
    n = max(1, -(-queries.count() // block))
    held = chunks.filter("embedding IS NOT NULL").select("memory_id", F.col("embedding").alias("v"))
    parts = [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)]
    # those below the threshold can't be the best that counts, and so aren't shuffled
    near = [held.crossJoin(F.broadcast(part)).select("query_id", "memory_id", cosine(F.col("v"), F.col("embedding")).alias("similarity")).filter(F.col("similarity") >= least) for part in parts]
    found = [pairs.groupBy("query_id", "memory_id").agg(F.max("similarity").alias("similarity")) for pairs in near]
    return above_threshold(reduce(DataFrame.unionByName, found), least)


def merge_hybrid(keyword: DataFrame, vector: DataFrame, limit: int | None = SEARCH_LIMIT, attach_similarity: bool = False) -> DataFrame:
    """Keyword hits and the vector hits that are none, by similarity and then the newest. Keyword hits count as of
    similarity 0 unless attach_similarity is set, and so come after all others."""
    if attach_similarity:
        keyword = keyword.join(vector.select("id", "similarity"), "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    else:
        keyword = keyword.withColumn("similarity", F.lit(0.0))
    merged = keyword.unionByName(vector.join(keyword.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return _limit(merged.orderBy(F.desc("similarity"), F.desc("created_at"), "id"), limit)


def search(memories: DataFrame, chunks: DataFrame, query: str, as_of, ns: str | None = None, kind: str | None = None, limit: int = SEARCH_LIMIT, embedder=None) -> DataFrame:
    """Keyword search; with an embedder and vector hits, the hybrid order. A query that can't be embedded, or
    finds no vector, leaves the keyword order."""
    return with_vectors(search_keywords(memories, chunks, query, as_of, ns, kind, limit), memories, chunks, query, as_of, ns, kind, limit, embedder)


def with_vectors(found: DataFrame, memories: DataFrame, chunks: DataFrame, query: str, as_of, ns: str | None = None, kind: str | None = None, limit: int = SEARCH_LIMIT, embedder=None) -> DataFrame:
    """Keyword hits (with place) and, with an embedder, vector hits in the hybrid order."""
    vector = embedder.embed_batch([query])[0] if embedder is not None else None
    if vector is None:
        return found.withColumn("similarity", F.lit(0.0)).select(*MEMORY_COLS, "similarity", "place")
    near = search_vector(memories, chunks, vector, as_of, ns, kind, limit)
    if near.isEmpty():
        return found.withColumn("similarity", F.lit(0.0)).select(*MEMORY_COLS, "similarity", "place")
    from pyspark.sql import Window as W

    merged = merge_hybrid(found.select(MEMORY_COLS), near, limit)
    order = W.orderBy(F.desc("similarity"), F.desc("created_at"), "id")
    return merged.withColumn("place", F.row_number().over(order)).select(*MEMORY_COLS, "similarity", "place")
