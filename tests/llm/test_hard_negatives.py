import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives as hn


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.integers(1, 150), st.integers(0, 14), st.integers(0, 2**32 - 1))
def test_products_are_exact(n, depth, bits, seed):
    random_ = np.random.default_rng(seed)
    a, b = (random_.integers(-(2**bits), 2**bits + 1, (k, depth)) for k in (n, 3))
    system = hn.Residues(int(max((a.astype(object) ** 2).sum(axis=1).max(initial=0), (b.astype(object) ** 2).sum(axis=1).max(initial=0))) + 1)
    assert (system.products(system.of(a), system.of(b)) == a @ b.T).all()


def test_too_large():
    with pytest.raises(ValueError):
        hn.Residues(2**62)


def expected(rows, every, positives=5, negatives=3):
    """By the definition, pair by pair."""
    rows = [(k, label, [int(np.floor(256 * float(x))) for x in v]) for k, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (key, label, q) in enumerate(rows):
        if key is None or key % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, r, strict=False)), k, own) for j, (k, own, r) in enumerate(rows) if j != i]
        for p, positive, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            near = sorted((s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:negatives]
            out += [(key, positive, rank + 1, negative, p, n) for rank, (n, negative, _) in enumerate(near)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_odd_rows(spark, monkeypatch):
    """Nulls, infinities, other lengths, ties, repeated rows; several tiles, blocks and tasks."""
    monkeypatch.setattr(hn, "TILE_ROWS", 16)
    monkeypatch.setattr(hn, "TILE_ANCHORS", 3)
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(6)], r.randrange(3)) for i in range(90)]
    rows += [(7, [1.0] * 6, 1)] * 5 + [(0, [1.0] * 6, 0)] * 2 + [(10, None, 1), (20, [1.0, None], 1), (30, [float("nan")] * 6, 0), (40, [float("inf")] * 6, 0), (50, [1.0] * 6, None), (60, [], 0), (None, [1.0] * 6, 1), (None, [0.9] * 6, 2), (70, [2.0, 1.0], 0), (80, [0.5] * 9, 2), (90, [-1.0] * 6, 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("id", "row", "q", "size", "score")})
    found = hn.hard_negatives(df, anchors=F.expr("id % 10 = 0"), block_bytes=8 * 9 * 5)
    assert rows_of(found) == expected([(k, label, v) for k, v, label in rows], 10)


def test_large_components(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-3000, 3000) for _ in range(70)], r.randrange(2)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    exact = [(x["vec_id"], x["label"], x["embedding"]) for x in df.collect()]
    assert rows_of(hn.hard_negatives(df, anchors=F.expr("id % 5 = 0"))) == expected(exact, 5)
    with pytest.raises(ValueError):
        hn.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], SCHEMA))


def test_empty(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], SCHEMA), anchors=F.expr("id % 50 = 0")).count() == 0


def test_query(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    columns = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score"
    assert rows_of(hn.op12_hard_negatives(spark, d)) == sorted(con.execute(f"SELECT {columns} FROM ({hn.ORACLE})").fetchall(), key=str)
