import threading
import time

import pytest
from pyspark.sql import functions as F

from palimpsest import shipping
from palimpsest.functions import text as t


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ttl(spark):
    assert [t.parse_ttl(x) for x in ("7d", "24h", "30m", "60s", "0s")] == [604800, 86400, 1800, 60, 0]
    for bad in ("invalid", "", "7x", " 7d", "7d ", "-1d"):
        with pytest.raises(ValueError):
            t.parse_ttl(bad)
    rows = spark.createDataFrame([("7d",), ("24h",), ("30m",), ("60s",), ("invalid",), ("",), ("7x",), (None,)], "x string")
    assert [r[0] for r in rows.select(t.ttl_seconds(F.col("x"))).collect()] == [604800, 86400, 1800, 60, None, None, None, None]


def test_like(spark):
    rows = spark.createDataFrame([("Abc",), ("a\\b",), ("100% sure",), ("ÀB",), ("axc",)], "x string")
    found = lambda q: [r["x"] for r in rows.filter(t.like_substring(F.col("x"), q)).collect()]
    assert found("A_C") == ["Abc", "axc"]
    assert found("a\\b") == ["a\\b"]
    assert found("0%s") == ["100% sure"]
    assert found("àb") == [] and found("Àb") == ["ÀB"]
    assert len(found("")) == 5


def test_rounding_trim_tokens(spark):
    assert value(spark, t.round_half_away(F.lit(1.005), 2)) == 1.0
    assert value(spark, t.round_half_away(F.lit(0.125), 2)) == 0.13
    assert value(spark, t.trim_space(F.lit(" \n x y\t　"))) == "x y"
    assert value(spark, t.tokens(F.lit("Crème, brûlée-2!"))) == ["creme", "brulee", "2"]
    assert t.query_terms("Crème CREME brûlée") == ["creme", "brulee"]
    assert value(spark, t.split_tags(F.lit(" a, ,b,"))) == ["a", "b"]


def test_times(spark):
    at = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    assert value(spark, t.julian_day(at)) == 2460311.0
    assert value(spark, t.rfc3339(at)) == "2024-01-01T12:00:00Z"


def test_plain_tokens(spark):
    """By the table of code points the same as by Spark's columns, for every character that isn't odd."""
    points = [c for c in range(0x2070) if c < 0x250 and c != 0x130 or c >= 0x2000]
    texts = ["".join(map(chr, points)), *[f"aB{chr(c)}9É{chr(c)}" for c in points], "", " ", "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert rows.filter(t.is_odd(F.col("t"))).isEmpty()
    words, counts = t.plain_tokens(texts)
    ends = counts.cumsum()
    expected = {r["i"]: r["w"] for r in rows.select("i", t.tokens(F.col("t")).alias("w")).collect()}
    assert [words[e - n : e].to_pylist() for n, e in zip(counts, ends, strict=True)] == [expected[i] for i in range(len(texts))]
    odd = spark.createDataFrame([("İ",), ("a中",), ("ɐ",), ("Σ",), ("𝟘",)], "t string")
    assert odd.filter(t.is_odd(F.col("t"))).count() == 5
    assert spark.sql("SELECT CAST(x'61ff' AS STRING) AS t").filter(t.is_odd(F.col("t"))).count() == 1


def test_code_is_sent_once(spark, monkeypatch):
    """Threads that need it at once send it once, and go on when it is there."""
    sent = []
    monkeypatch.setattr(shipping, "_shipped", set())
    monkeypatch.setattr(shipping, "_send", lambda _: (time.sleep(0.2), sent.append(1)))
    threads = [threading.Thread(target=shipping.ship, args=(spark,)) for _ in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sent == [1]
