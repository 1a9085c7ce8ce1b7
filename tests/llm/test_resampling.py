import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import importance_resampling as ir

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXT = st.text(st.sampled_from("ab Z9.,é中\n"), max_size=120)


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def expected(docs, target, least_words=20, percent=5):
    """By the definition, feature by feature."""
    s, t = ([0] * ir.BUCKETS for _ in "st")
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[zlib.crc32(f) % ir.BUCKETS] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for key, text in docs:
        words, fs = features(text)
        weight = sum(gain[zlib.crc32(f) % ir.BUCKETS] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fit = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] if r[0] is not None else -1))
    for i, r in enumerate(fit):
        r.append(i + 1 if i < len(fit) * percent // 100 else None)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=6), st.data())
def test_buckets(texts, data):
    """Whatever is in the head, each feature has the bucket of its CRC, long texts in pieces too."""
    words = sorted({w.encode() for t in texts for w in features(t)[0]})
    head = data.draw(st.lists(st.sampled_from(words), unique=True)) if words else []
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(head) - 1), st.integers(0, len(head) - 1)), unique=True, max_size=8)) if head else []
    made = ir.Features(ir.Head(head, pairs))
    size, ir.PIECE_CHARS = ir.PIECE_CHARS, 10
    try:
        found = []
        for ws, place, new, first, of in ir._runs(texts):
            for k, bucket in enumerate(made.buckets(ws, place)):
                found += bucket[new & (place >= k)].tolist()
            assert len(first) == len(of)
    finally:
        ir.PIECE_CHARS = size
    assert sorted(found) == sorted(zlib.crc32(f) % ir.BUCKETS for t in texts for f in features(t)[1])


def test_long_words():
    words = [b"x" * 200, b"y" * 64, b"z", "é".encode() * 40, b"x" * 200]
    one, two, three = ir.Features(ir.Head([b"z"], [])).buckets(words, np.arange(5))
    assert one.tolist() == [zlib.crc32(w) % ir.BUCKETS for w in words]
    assert two[1:].tolist() == [zlib.crc32(b" ".join(words[i : i + 2])) % ir.BUCKETS for i in range(4)]
    assert three[2:].tolist() == [zlib.crc32(b" ".join(words[i : i + 3])) % ir.BUCKETS for i in range(3)]


def test_bounded_counts(monkeypatch):
    monkeypatch.setattr(ir, "TASK_COUNTS", 3)
    assert ir._bounded(ir.Counter("aaaabbbccde")) == {"a": 4, "b": 3, "c": 2}


def test_odd_rows(spark, odd):
    target = spark.createDataFrame([("seven eight one two three",), (None,)], "text string")
    rows = ir.resampled(odd, target, least_words=3, percent=40).collect()
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows), key=str) == expected(docs, ["seven eight one two three"], 3, 40)
    assert rows[0]["line"] == 14 and rows[0]["text"] is None or len(rows) == 9


def test_empty(spark, none, odd):
    target = spark.createDataFrame([("a b",)], "text string")
    assert ir.resampled(none, target).count() == 0
    assert {r["weight"] for r in ir.resampled(odd, target.limit(0)).collect()} > {0}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in ir.op11_importance_resampling(spark, d).collect()), key=str) == expected(docs, target)


def test_drawn_over_ranges(spark):
    """Ranks go on over ranges; of many equal scores none is lost or comes twice."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "30L AS n_words", "CASE WHEN id % 3 = 0 THEN 500 ELSE id % 50 END AS score")
    found = ir.drawn(rows, percent=50).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(1, 1501))
    order = [(-r["score"], r["doc_id"]) for r in found]
    assert order == sorted(order)
