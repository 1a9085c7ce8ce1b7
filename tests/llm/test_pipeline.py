import corpus_pipeline
import duckdb
import pytest

from palimpsest.llm.queries import ORACLES, QUERIES


def test_stages(spark, tmp_path):
    own = lambda k: " ".join(f"{a}{k}" for a in "many words of its own that make this document differ from all the others here today".split()) + "."
    item = "what is the answer to the question that nobody has asked us yet"
    rows = [(i, own(i) + "\n" + own(-i - 1) + "\n" + own(f"z{i}"), "en", f"s{i % 4}", 0) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s1", 0), (101, rows[4][1] + "\n" + item, "en", "s1", 0), (102, "too short", "en", "s1", 0), (103, None, None, None, None)]
    rows += [(104, own("q") + " \n" + item + "\n" + own("r") + own("s"), "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "tokens" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept["quality"] == set(range(30)) | {100, 101, 104}
    assert kept["lines"] == kept["quality"]
    # 101 has 41 of 54 shingles in common with 4
    assert kept["near_duplicates"] == kept["decontamination"] == kept["tokens"] == set(range(30)) | {104}
    assert docs.filter("NOT round_trip").count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/decontamination").collect()}
    assert all(item not in t for t in texts.values()) and texts[5] == rows[5][1]
    assert texts[104] == own("q") + " \n\n" + own("r") + own("s")


def test_odd_rows(spark, tmp_path):
    """Rows without doc_id and rows that share one are judged each by itself; extra columns stay, whatever their names."""
    own = lambda k: " ".join(f"{a}{k}" for a in "many words of its own that make this document differ from all the others here today and more".split())
    rows = [(i, own(i) + "\n" + own(f"z{i}"), "en", "s1", 5, "x", 1) for i in range(20)]
    rows += [(None, "too short", "en", "s1", 0, "x", 1), (None, own("n") + "\n" + own("m"), "en", "s1", 5, "y", 2), (None, own("n") + "\n" + own("m"), "en", "s1", 5, "y", 2)]
    rows += [(3, "too short", "en", "s1", 0, "x", 1), (4, rows[4][1], "en", "s1", 5, "z", 3), (50, own("n") + "\n" + own("m"), "en", "s1", 5, "w", 1), (51, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, items string, n_words int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing that any document has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(map(tuple, docs.collect()), key=key)
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes
    assert kept["quality"] == kept["lines"] == sorted([*rows[:20], rows[21], rows[22], rows[24], rows[25]], key=key)
    left = kept["near_duplicates"]
    assert [r[0] for r in left] == [*range(20), 50] and left[-1] == rows[25]
    assert kept["decontamination"] == left


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r) for r in found.select(columns).collect()), key=key) == sorted(expected, key=key)
