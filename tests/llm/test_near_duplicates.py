import itertools
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ngram_join
from palimpsest.llm.common import join_unevenly


def words_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """doc_id -> (set size, smallest id that links reach)"""
    sets = {i: words_set(t) for i, t in docs}
    low = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    before = None
    while low != before:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {i: (len(sets[i]), low[i]) for i in sets}


def corpus(seed, n_groups=6, copies=7):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(40))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(n_groups):
        base = [word() for _ in range(r.choice([4, 6, 12, 60, 150]))] + (passage if r.random() < 0.5 else [])
        for _ in range(copies):
            copy = list(base)
            for _ in range(r.randrange(6)):
                copy[r.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts += [texts[-1], texts[-1].upper() + " \n"]
    r.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    rows = ngram_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs)


def test_large_group_of_near_copies(spark):
    """One class, and far fewer candidates than pairs."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(f"e{i}_{k}" if k == r.randrange(200) else w for k, w in enumerate(base)) + f" tail{i}") for i in range(120)]
    rows = ngram_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    expected = brute(docs)
    assert {x["doc_id"]: x["component_id"] for x in rows} == {i: low for i, (_, low) in expected.items()}


@pytest.mark.parametrize("met, block", [(3, 4), (250, 500)])
def test_blocks(spark, monkeypatch, met, block):
    """Documents with many partners and shingles of many classes go through blocks, with the same links; candidates of a
    class of near copies grow with its members, not with their pairs."""
    monkeypatch.setattr(ngram_join, "MET", met)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    r = random.Random(9)
    base, verified = [f"w{i}" for i in range(60)], []
    docs = [(i, " ".join(base + [f"tail{i}"])) for i in range(80)]
    # a passage that makes up most of what 60 documents of different classes index
    passage = [f"p{i}" for i in range(14)]
    docs += [(200 + i, " ".join(passage + [f"x{r.randrange(9)}" for _ in range(4)])) for i in range(60)]
    plain = ngram_join._verified

    def counted(pairs, some):
        verified.append(pairs.count())
        return plain(pairs, some)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    rows = ngram_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in rows} == {i: low for i, (_, low) in brute(docs).items()}
    assert verified[0] <= len(docs)


def test_suffix_filter():
    """No linking pair is filtered out, whatever the sizes; unrelated long texts are."""
    r = random.Random(11)
    for n in (1, 7, 300, 1279, 1281, 5000, 40_000):
        base = [f"w{r.randrange(10**9)}" for _ in range(n + 4)]
        near = base[: len(base) - n // 9] + [f"x{i}" for i in range(n // 20)]
        a, b, c = (ngram_join.shingles(" ".join(x)) for x in (base, near, [f"y{i}" for i in range(n + 4)]))
        both = len(set(a.tolist()) & set(b.tolist()))
        assert 100 * both >= 75 * (len(a) + len(b) - both) and ngram_join._may_overlap(ngram_join._parts(a), ngram_join._parts(b))
        assert n < 300 or not ngram_join._may_overlap(ngram_join._parts(a), ngram_join._parts(c))


def test_repeated_ids_of_other_texts(spark):
    """Rows that share a doc_id are one document, linked by any of its texts."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    docs = [(1, text("a")), (1, text("b")), (2, text("a") + " x"), (3, text("b") + " x"), (4, text("c"))]
    rows = ngram_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_odd(odd):
    rows = ngram_join.jaccard_classes(odd).collect()
    assert len(rows) == 9
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert found[2] == (0, 2) and found[3] == (0, 3) and found[4] == (0, 4) and found[1] == (6, 1) and found[6] == (1, 6)
    assert found[None][1] is None


def test_empty(none):
    assert ngram_join.jaccard_classes(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 100)]
    links = spark.createDataFrame([(min(x), max(x)) for x in chain], "a long, b long")
    found = {r["id"]: r["component"] for r in ngram_join.components(links).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def test_join_unevenly(spark, monkeypatch):
    from palimpsest.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 1)
    left = spark.range(100).select("id", F.when(F.col("id") < 70, 1).when(F.col("id") < 90, 2).when(F.col("id") < 95, 3).cast("long").alias("k"))
    right = spark.createDataFrame([(1, 70, "a"), (2, 20, "b")], "k long, n long, v string")
    found = [(r["id"], r["v"]) for r in join_unevenly(left, right, "k", "n", F.col("id")).orderBy("id").collect()]
    assert found == [(i, "a" if i < 70 else "b" if i < 90 else None) for i in range(100)]


@pytest.mark.parametrize("seed", [1])
def test_shuffled_joins(spark, monkeypatch, seed):
    """What the operators find doesn't depend on which sides are small enough for a broadcast."""
    from palimpsest.llm import common
    from palimpsest.llm.line_dedup import line_dedup
    from palimpsest.llm.quality_rules import quality_rules

    r = random.Random(seed)
    common_lines = [f"all pages say this line {i}" for i in range(4)]
    of_site = lambda i: f"s{r.choice([0, 0, 0, *range(12)])}"
    rows = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(20, 60))) + "\n" + "\n".join(r.sample(common_lines, 3)), "en", of_site(i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    def found():
        lines = {x["doc_id"]: (x["text"], x["n_dropped"]) for x in line_dedup(docs).collect()}
        rules = {x["doc_id"]: (round(x["distance"], 6), x["kept"]) for x in quality_rules(docs).collect()}
        return lines, rules

    by_broadcast = found()
    assert sum(n > 0 for _, n in by_broadcast[0].values()) > 150
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    assert found() == by_broadcast


@pytest.mark.parametrize("hot", [1, -1, None])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_join_unevenly_deals_out_hot_keys(spark, hot, kind):
    """Hot keys that the right side has, that it hasn't, and nulls: no partition gets much more than its share."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        as_kind = lambda c: c.cast("long") if kind == "long" else c.cast("string").cast("binary")
        left = spark.range(20_000).select("id", as_kind(F.when(F.col("id") < 18_000, F.lit(hot)).otherwise(F.col("id"))).alias("k"))
        right = spark.range(0, 20_000, 3).union(spark.range(1, 2)).distinct().select(as_kind(F.col("id")).alias("k"), F.lit(1).alias("n"), F.col("id").alias("v"))
        out = join_unevenly(left, right, "k", "n", F.col("id"))
        assert out.columns == ["id", "k", "v"]
        assert max(r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("v")).collect()) < 2_500
        found = {r["id"]: r["v"] for r in out.collect()}
        assert found == {i: (1 if hot == 1 else None) if i < 18_000 else i if i % 3 == 0 else None for i in range(20_000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
