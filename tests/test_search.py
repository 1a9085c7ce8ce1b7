import math

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import context, many, search
from palimpsest.schema import MEMORIES

AT = "2024-02-01 00:00:00"


def memories(spark, *rows):
    """rows: (id, ns, key, content, created, and what else is set)"""
    made = []
    for id_, ns, key, content, created, *more in rows:
        x = {"id": id_, "ns": ns, "key": key, "content": content, "kind": "semantic", "version": 1, "created_at": created, "priority": "normal", "access_count": 0} | (more[0] if more else {})
        made.append(tuple(x.get(f.name) for f in MEMORIES.fields))
    text = ", ".join(f"{f.name} {'string' if f.dataType.simpleString() == 'timestamp_ntz' else f.dataType.simpleString()}" for f in MEMORIES.fields)
    return spark.createDataFrame(made, text).select([F.col(f.name).cast(f.dataType) for f in MEMORIES.fields])


def chunked(rows):
    return rows.select("id", F.col("id").alias("memory_id"), F.col("content").alias("text"))


@pytest.fixture(scope="module")
def languages(spark):
    return memories(
        spark,
        ("1", "test", "golang", "Go is a compiled language with goroutines", "2024-01-01 00:00:00"),
        ("2", "test", "python", "Python is an interpreted language", "2024-01-02 00:00:00"),
        ("3", "other", "rust", "Rust has a borrow checker", "2024-01-03 00:00:00"),
        ("4", "test", "gone", "this language should not appear", "2024-01-04 00:00:00", {"deleted_at": "2024-01-05 00:00:00"}),
    )


@pytest.mark.parametrize(("query", "ns", "ids"), [("language", "", {"1", "2"}), ("language", "test", {"1", "2"}), ("golang", "", {"1"}), ("javascript", "", set()), ("language goroutines", "", {"1"})])
def test_keywords(languages, query, ns, ids):
    assert {r["id"] for r in search.search_keywords(languages, chunked(languages), query, AT, ns).collect()} == ids


def test_bm25_against_formula(languages):
    found = {r["memory_id"]: r["bm25"] for r in search.bm25(chunked(languages), "compiled").collect()}
    idf = math.log((4 - 1 + 0.5) / 1.5)
    assert found == {"1": pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 7 / 5.5)))}
    common = {r["memory_id"]: r["bm25"] for r in search.bm25(chunked(languages), "language").collect()}
    assert all(0 < x < 1e-5 for x in common.values()) and len(common) == 3  # more than half of the chunks have it


def test_substring_room(spark):
    rows = memories(spark, *[(str(i), "n", f"k{i}", "alpha beta" if i < 2 else "xalphax", f"2024-01-0{i + 1} 00:00:00") for i in range(6)])
    found = [r["id"] for r in search.search_keywords(rows, chunked(rows), "alpha", AT, limit=4).orderBy("place").collect()]
    assert found == ["1", "0", "5", "4"]


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [([1, 0], [1, 0], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1), ([1, 1], [1, 0], 0.7071), ([], [], 0), ([1], [1, 2], 0), ([0, 0], [1, 1], 0)],
)
def test_cosine(spark, a, b, expected):
    rows = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert rows.select(search.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected, abs=1e-4)


def test_vector_threshold_and_hybrid_order(spark, languages):
    angle = lambda s: [float(s), math.sqrt(1 - s * s)]
    chunks = spark.createDataFrame([("1", "1", angle(0.2996)), ("2", "2", angle(0.31)), ("3", "2", angle(0.1)), ("4", "4", angle(0.9)), ("5", "3", None)], "id string, memory_id string, embedding array<float>")
    near = search.search_vector(languages, chunks, [1.0, 0.0], AT)
    assert [(r["id"], r["similarity"]) for r in near.collect()] == [("2", 0.31)]
    keyword = search.search_like(languages, chunked(languages), "Rust", AT)
    assert [r["id"] for r in search.merge_hybrid(keyword, near).collect()] == ["2", "3"]
    both = search.search_like(languages, chunked(languages), "language", AT)
    assert [(r["id"], r["similarity"]) for r in search.merge_hybrid(both, near).collect()] == [("2", 0.0), ("1", 0.0)]
    assert [(r["id"], r["similarity"]) for r in search.merge_hybrid(both, near, attach_similarity=True).collect()] == [("2", 0.31), ("1", 0.0)]


def sized(spark, *sizes, scores=None):
    rows = [(f"{i:02d}", "n", f"k{i}", "x" * s, "semantic", float((scores or {}).get(i, -i))) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, "id string, ns string, key string, content string, kind string, score double")


def test_pack_excerpt(spark):
    rows = context.pack(sized(spark, 50, 120, 500, 1), 75).orderBy("place").collect()
    assert [(len(r["content"]), r["excerpt"]) for r in rows] == [(50, False), (120, False), (133, True)]
    assert rows[2]["content"].endswith("...") and {r["used"] for r in rows} == {75}


def test_pack_short_tail_and_empty(spark):
    assert [len(r["content"]) for r in context.pack(sized(spark, 201, 500, 1), 75).orderBy("place").collect()] == [201]
    empty = context.context_result(context.pack(sized(spark, 1).limit(0), 75), 75).first()
    assert (empty["budget"], empty["used"], empty["memories"]) == (75, 0, [])


@pytest.mark.parametrize("sizes", [[400], [300, 0, 0, 1], [100, 101, 100, 0, 5], [0, 0, 301], [150, 300, 400]])
def test_pack_equals_loop(spark, sizes):
    used, expected = 0, []
    for s in sizes:
        if used + s <= 300:
            expected.append(s)
            used += s
            continue
        if 300 - used >= 100:
            expected.append(300 - used + 3)
        break
    assert [len(r["content"]) for r in context.pack(sized(spark, *sizes), 75).orderBy("place").collect()] == expected


def test_context_priority(spark):
    rows = memories(
        spark,
        ("1", "test", "low-pri", "coding tips", "2024-01-31 00:00:00", {"priority": "low"}),
        ("2", "test", "critical-pri", "coding rules", "2024-01-31 00:00:00", {"priority": "critical"}),
    )
    found = context.context_result(context.assemble_context(search.search_keywords(rows, chunked(rows), "coding", AT), AT)).first()
    assert [m["key"] for m in found["memories"]] == ["critical-pri", "low-pri"]
    assert found["memories"][0]["score"] == pytest.approx(round(0.4 + 0.2 * math.exp(-0.1) + 0.2, 2))


def test_pruned_vectors(spark):
    """Pivots leave out pairs, and none that counts; odd vectors are similar to none."""
    import random

    from palimpsest.operators import vectors

    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(str(i % 90), [x + r.gauss(0, 0.15) for x in centres[i % 6]]) for i in range(400)] + [("odd", None), ("odd", []), ("zero", [0.0] * 12), ("short", [1.0, 2.0]), ("short", [-1.0, 2.0]), ("null", None)]
    chunks = spark.createDataFrame(rows, "memory_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows) if i % 20 == 0 or i > 398], "query_id long, embedding array<double>")
    found = lambda df: sorted(tuple(x) for x in df.select("query_id", "memory_id", "similarity").collect())
    for least in (0.3, 0.9, 0.0):
        assert found(vectors.search_vectors(chunks, queries, least, block=9)) == found(search.search_vectors(chunks, queries, least, block=9))
    assert vectors.compared_share(chunks, queries, 0.9) < 0.5
    assert vectors.search_vectors(chunks.limit(0), queries).count() == vectors.search_vectors(chunks, queries.limit(0)).count() == 0


def test_many_queries(spark):
    """Each query has what it has alone; the same terms in another order are the same, and odd queries find nothing."""
    texts = ["red green blue", "green green tea", "red tea", "blue sky over red tea and green fields", "", "sky"]
    rows = memories(spark, *[(str(i), "n", f"k{i}", t, f"2024-01-0{i + 1} 00:00:00", {"priority": ["high", "low", "normal"][i % 3]}) for i, t in enumerate(texts)])
    asked = {1: "green", 2: "Red tea", 3: "tea red tea", 4: "nowhere red", 5: "", 6: None, 7: "sky", 8: "-"}
    queries = spark.createDataFrame([*asked.items(), (7, "sky")], "query_id long, query string")
    found = {}
    for x in many.search_fts_many(rows, chunked(rows), queries, AT).collect():
        found.setdefault(x["query_id"], []).append((x["place"], x["id"], round(x["score"], 9)))
    packed = {}
    for x in many.contexts(rows, chunked(rows), queries, AT, 10).collect():
        packed.setdefault(x["query_id"], []).append((x["place"], x["id"], x["used"], x["content"]))
    assert set(found) == set(packed) == {1, 2, 3, 7}
    for query_id in found:
        hits = search.search_fts(rows, chunked(rows), asked[query_id], AT)
        assert sorted(found[query_id]) == [(k + 1, x["id"], round(x["score"], 9)) for k, x in enumerate(hits.collect())]
        alone = context.assemble_context(hits.drop("score"), AT, 10).collect()
        assert sorted(packed[query_id]) == sorted((x["place"], x["id"], x["used"], x["content"]) for x in alone)
    for none in (queries.limit(0), queries.filter("query_id = 4")):
        assert many.contexts(rows, chunked(rows), none, AT).count() == 0 and many.search_fts_many(rows, chunked(rows), none, AT).count() == 0
    assert many.search_fts_many(rows.limit(0), chunked(rows.limit(0)), queries, AT).count() == 0


def shuffled(spark, run):
    """The records that `run` shuffles."""
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before, small = total(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # as for tables that aren't small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    return total() - before


def test_many_queries_shuffle_no_pairs(spark):
    """Frequent terms: what is shuffled grows with chunks and with queries, not with their pairs; the rows are those of each query alone."""
    words = [f"w{i}" for i in range(10)]
    rows = memories(spark, *[(str(i), "n", f"k{i}", " ".join(words[j] for j in range(10) if (i + j) % 9) + " and" * (i % 7), f"2024-01-{i % 28 + 1:02d} 00:00:00") for i in range(300)])
    asked = [f"{a} {b}" for i, a in enumerate(words) for b in words[:i]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = []
    assert shuffled(spark, lambda: found.extend(many.search_fts_many(rows, chunked(rows), queries, AT, limit=5).collect())) < 300 * len(asked)
    for k in (0, 17, 44):
        alone = search.search_fts(rows, chunked(rows), asked[k], AT, limit=5).collect()
        assert sorted((x["place"], x["id"], round(x["score"], 9)) for x in found if x["query_id"] == k) == [(i + 1, x["id"], round(x["score"], 9)) for i, x in enumerate(alone)]


@pytest.mark.parametrize("shift", range(3))
def test_excerpt_in_a_character(spark, shift):
    """A cut takes bytes, of a character too."""
    content = "x" * shift + "€" * 400
    rows = memories(spark, ("1", "n", "k", content, "2024-01-01 00:00:00"))
    [x] = context.assemble_context(rows, AT, 101).select(F.hex("content").alias("h"), "excerpt", "used").collect()
    assert bytes.fromhex(x["h"]) == content.encode()[:404] + b"..." and x["excerpt"] and x["used"] == 101


def test_postings_shuffle_no_words(spark):
    """A chunk's tokens are counted in place, the same ids together, and empty or null texts have none."""
    texts = [(str(i), "m", " ".join(f"w{i * j % 13}" for j in range(40))) for i in range(50)] + [("x", "m", "a b"), ("x", "m", "b c"), ("y", "m", ""), ("z", "m", None), (None, "m", "a b"), (None, "m", "b c")]
    rows = spark.createDataFrame(texts, "id string, memory_id string, text string")
    expected = {}
    for id_, _, text in texts:
        words = (text or "").split()
        for w in words:
            expected[w, id_, len(words)] = expected.get((w, id_, len(words)), 0) + 1
    assert {(r["term"], r["chunk_id"], r["dl"]): r["tf"] for r in search.postings(rows).collect()} == expected
    once = rows.filter("id < 'x'")
    assert shuffled(spark, lambda: search.postings(once).collect()) <= 4 * 50


def test_vectors_by_matrices(spark):
    """No pair of vectors is compared by itself in an expression, and the rows are those of all pairs."""
    import random

    from palimpsest.operators import vectors

    r = random.Random(5)
    rows = [(str(i % 7), [r.gauss(0, 1) for _ in range(8 if i % 5 else 4)]) for i in range(300)]
    chunks = spark.createDataFrame(rows, "memory_id string, embedding array<float>")
    queries = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows) if i % 9 == 0], "query_id long, embedding array<float>")
    found = lambda df: sorted(tuple(x) for x in df.select("query_id", "memory_id", "similarity").collect())
    expected = found(search.all_pairs(chunks, queries, 0.3))
    for module in (search, vectors):
        df = module.search_vectors(chunks, queries, 0.3, block=10)
        assert found(df) == expected and len(expected) > 50
        assert "zip_with" not in df._jdf.queryExecution().toString()


def test_index_of_a_segment(spark):
    """Terms and trigrams by blocks, as counted one by one; a chunk's terms are counted before anything is shuffled."""
    from palimpsest.operators import indexed

    made = [(100 + i, f"Ab{i % 3} xyz ab{i % 3}é", f"k{i}") for i in range(60)] + [(5, None, "Z"), (6, "ab", "KEY")]
    rows = spark.createDataFrame(made, "ref long, content string, key string")
    chunks = rows.select("ref", F.lit(0).alias("seq"), F.col("content").alias("text"), F.lit(1.0).alias("weight"), F.lit(2.0).alias("created"))
    grams, terms = {}, {}
    for ref, content, key in made:
        for text in (content or "", key):
            b = "".join(c.lower() if c.isascii() else c for c in text).encode()
            for i in range(len(b) - 2):
                grams.setdefault((int.from_bytes(b[i : i + 3], "big"), ref // 128), set()).add(ref % 128)
        words = (content or "").lower().replace("é", "e").split()
        for w in set(words):
            terms.setdefault((w, ref // 128), []).append((ref % 128, 0, words.count(w), len(words)))
    assert {(r["gram"], r["block"]): r["refs"] for r in indexed.grams_of(rows, chunks).collect()} == {k: sorted(v) for k, v in grams.items()}
    postings = indexed.postings_of(chunks)
    assert {(r["term"], r["block"]): [tuple(e) for e in r["entries"]] for r in postings.collect()} == {k: sorted(v) for k, v in terms.items()}
    assert postings._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
