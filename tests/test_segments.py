"""The store's segments, log and index: what many writes leave, what a search reads, writers side by side."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import indexed, reads, search
from palimpsest.schema import MEMORY_COLS, PUTS
from palimpsest.sources import store as st
from palimpsest.sources.files import Files
from palimpsest.sources.store import ConcurrentWrite, Store

T1, T2, T3, T9 = "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00", "2024-02-01 00:00:00"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def puts_of(spark, rows):
    return spark.createDataFrame([(i, ns, key, content, None, None, priority, None, None) for i, (ns, key, content, priority) in enumerate(rows)], PUTS)


def state_of(store):
    return sorted((r["ns"], r["key"], r["version"], r["content"], r["deleted_at"] is None, r["access_count"]) for r in store.memories().collect())


def scanned(df):
    """The rows that the scans of a plan gave, by the columns read."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec":
            found.append((node.output().mkString(","), node.metrics().apply("numOutputRows").value()))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    """A store of 1,360 notes in four puts, of which three are merged, some put again, some deleted."""
    r, fanout = random.Random(5), st.FANOUT
    st.FANOUT = 3
    store = Store(spark, f"file://{tmp_path_factory.mktemp('notes')}/s")
    text = lambda: " ".join(r.choices(WORDS, [2 ** -min(i, 9) for i in range(12)], k=r.randrange(3, 60)))
    for k in range(4):
        rows = [(f"n{r.randrange(3)}", f"k{k * 340 + i}", text() + (f" mark{i}x" if i % 50 == 0 else ""), r.choice(["low", "normal", "high", "critical", "?"])) for i in range(340)]
        store.put_many(puts_of(spark, rows), f"2024-01-0{k + 1} 00:00:00")
    keys = store.memories().select("ns", "key", F.substring("key", 2, 9).cast("int").alias("i"))
    again = keys.filter("i % 9 = 0").select("ns", "key").collect()
    store.put_many(puts_of(spark, [(k["ns"], k["key"], "beta lambda mu " + text(), "normal") for k in again]), "2024-01-11 00:00:00")
    store.rm_many(keys.filter("i % 7 = 0").select("ns", "key").distinct(), as_of="2024-01-12 00:00:00")
    store.rm_many(keys.filter("i % 11 = 0").select("ns", "key").distinct(), hard=True, as_of="2024-01-12 00:00:00")
    st.FANOUT = fanout
    return store


def test_merged_by_size(notes):
    state = notes._state()
    assert sorted(s["rows"] for s in state.segments.values()) == [152, 340, 1020]
    assert notes._rows(state).count() < 152 + 340 + 1020


def test_covered_is_latest(notes):
    """Rows know whether they are the latest: the same as by ranking all versions, and with no shuffle by key."""
    listed = notes.list(limit=None, as_of=T9)
    ranked = reads.list_memories(notes.memories(), T9, limit=None)
    assert sorted(r["id"] for r in listed.collect()) == sorted(r["id"] for r in ranked.collect())
    plan = notes.list(limit=None, as_of=T9)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(ns" not in plan


@pytest.mark.parametrize("query", ["alpha", "beta lambda", "mark50x", "nothing"])
def test_ranked_top(notes, query):
    """As many as there are, or the best ones, in the order of the full search over texts."""
    full = search.search_fts(notes.memories(), notes.chunks(), query, T9, limit=None).collect()
    every = indexed.all_ranked(notes.index(), query, T9).collect()
    assert sorted((r["id"], round(r["score"], 9)) for r in every) == sorted((r["id"], round(r["score"], 9)) for r in full)
    for ns, limit in ((None, 20), ("n1", 5)) if query == "alpha" else (("n2", 7),):
        found = indexed.ranked_top(notes.index(), query, T9, ns, limit=limit)
        want = sorted((-r["score"], r["id"]) for r in every if ns in (None, r["ns"]))[:limit]
        rows = indexed.rows_of(notes.index(), [(b, ref, i) for i, (b, ref) in enumerate(found.refs)]).collect()
        assert [r["id"] for r in sorted(rows, key=lambda r: r["place"])] == [i for _, i in want]


def test_blocks_are_skipped(notes, monkeypatch):
    monkeypatch.setattr(indexed, "SEEDS", 4)
    before = [indexed.ranked_top(notes.index(), q, T9, limit=5) for q in ("alpha", "beta alpha")]
    monkeypatch.setattr(indexed, "SEEDS", 1000)
    after = [indexed.ranked_top(notes.index(), q, T9, limit=5) for q in ("alpha", "beta alpha")]
    assert [f.refs for f in before] == [f.refs for f in after]
    assert all(f.opened < f.blocks and f.blocks == g.blocks == g.opened for f, g in zip(before, after, strict=True))


@pytest.mark.parametrize("query", ["Mark100X", "rk5%x", "mu", "beta_lamb", "no such"])
def test_like(notes, query):
    full = [(r["id"]) for r in search.search_like(notes.memories(), notes.chunks(), query, T9, limit=None).collect()]
    assert [r["id"] for r in indexed.search_like(notes.index(), query, T9).orderBy(F.desc("created_at"), "id").collect()] == full
    hits = indexed.like_top(notes.index(), query, T9, limit=7)
    rows = indexed.rows_of(notes.index(), [(b, ref, i) for i, (b, ref) in enumerate(hits)]).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["place"])] == full[:7]


def test_whole_search(notes):
    for query, limit in (("mark100x", 20), ("alpha beta", 5), ("mark50", 20)):
        full = search.search_keywords(notes.memories(), notes.chunks(), query, T9, limit=limit).collect()
        found = notes.search(query, limit=limit, as_of=T9).collect()
        assert sorted((r["place"], r["id"]) for r in found) == sorted((r["place"], r["id"]) for r in full)


def test_texts_of_candidates_alone(notes):
    """Of the texts, a search reads the pages of its candidates; none if ranked hits fill its limit."""
    index, read = notes.index(), []
    counted = index._replace(rows=lambda b: read.append(("rows", b)) or index.rows(b), texts=lambda b: read.append(("texts", b)) or index.texts(b))
    hits = indexed.like_top(counted, "mark100x", T9)
    assert 0 < len(hits) <= 4
    blocks = {(s, b) for _, of in read for s, bs in of.items() for b in bs}
    assert len(blocks) <= 4 and {"rows", "texts"} == {what for what, _ in read}
    # rows that the scans give: at most the pages of those blocks
    text = [n for cols, n in scanned(index.texts({s: [b] for s, b in sorted(blocks)[:1]}).select("text"))]
    assert 0 < sum(text) <= 4 * indexed.BLOCK
    read.clear()
    assert len(indexed.keywords_top(counted, "alpha", T9, limit=5)) == 5 and all(what == "rows" for what, _ in read)


def test_reader_during_merge(spark, tmp_path, monkeypatch):
    """A reader keeps its rows through a merge; afterwards files are as few as the segments need."""
    store = Store(spark, f"file://{tmp_path}/s")
    monkeypatch.setattr(st, "FANOUT", 4)
    for i in range(st.FANOUT - 1):
        store.put_many(puts_of(spark, [("n", f"k{i}", f"text {i}", None)]), T1)
    store.rm("n", "k0", hard=True)
    reader, before = store.memories(), store._state()
    store.put_many(puts_of(spark, [("n", "k2", "again", None)]), T2)
    assert [len(before.segments), len(store._state().segments)] == [st.FANOUT - 1, 1]
    assert sorted((r["key"], r["version"]) for r in reader.collect()) == [(f"k{i}", 1) for i in range(1, st.FANOUT - 1)]
    files = lambda: sum(len(Files(spark).names(f"{store.path}/g0/{t}")) for t in st.TABLES)
    assert files() == 5 * (st.FANOUT + 1) and store.vacuum(0) >= 5 * st.FANOUT and files() == 5
    assert [(r["key"], r["version"]) for r in store.list(ns="n", as_of=T3).orderBy("key").collect()] == [("k1", 1), ("k2", 2), *[(f"k{i}", 1) for i in range(3, st.FANOUT - 1)]]


def test_history_of_changes(spark, tmp_path, monkeypatch):
    """Many changes with snapshots, merges and listed changes come to what a plain record of them does."""
    monkeypatch.setattr(st, "TAIL", 5)
    monkeypatch.setattr(st, "FANOUT", 3)
    monkeypatch.setattr(st, "INLINE", 2)
    store, r = Store(spark, f"file://{tmp_path}/s"), random.Random(9)
    rows: list[dict] = []  # in the order of writing
    live = lambda key: [x for x in rows if x["key"] == key and x["live"]]
    for step in range(12):
        what = r.choice(["put", "put", "put", "rm", "rm", "hard", "get", "rm_all", "hard_all"])
        keys = sorted({f"k{r.randrange(4)}" for _ in range(r.choice([1, 1, 4]))})
        if what == "put":
            store.put_many(puts_of(spark, [("n", k, f"text {step}", None) for k in keys]), T1)
            rows += [{"key": k, "version": len(live(k)) + 1, "text": f"text {step}", "live": True, "n": 0} for k in keys]
        elif what == "get":
            if live(keys[0]):
                store.get("n", keys[0], as_of=T2)
                live(keys[0])[-1]["n"] += 1
        else:
            hard, every = what.startswith("hard"), what.endswith("all")
            hit = [x for k in keys for x in (([y for y in rows if y["key"] == k] if hard else live(k)) if every else live(k)[-1:])]
            assert store.rm_many(spark.createDataFrame([("n", k) for k in keys], "ns string, key string"), hard, every, T2) == len(hit)
            for x in hit:
                x["live"] = False
            if hard:
                rows = [x for x in rows if not any(x is y for y in hit)]
        if step % 6 == 5:
            assert state_of(store) == sorted(("n", x["key"], x["version"], x["text"], x["live"], x["n"]) for x in rows)
            assert sorted((m["key"], m["content"]) for m in store.list(as_of=T3).collect()) == sorted((k, live(k)[-1]["text"]) for k in ("k0", "k1", "k2", "k3") if live(k))
    state = store._state()
    assert state.snapshot and len(state.tail) <= 7
    before = state_of(store)
    store.vacuum(0)
    assert state_of(Store(spark, store.path)) == before
    query = "text"
    ranks = lambda df: sorted((x["chunk_id"], round(x["bm25"], 9)) for x in df.collect())
    assert ranks(search.bm25_by_index(store.index(), query)) == ranks(search.bm25(store.chunks(), query))


def test_links_over_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "TAIL", 2)
    store = Store(spark, f"file://{tmp_path}/s")
    a, b = store.put("n", "a", "x", as_of=T1), store.put("n", "b", "y", as_of=T1)
    assert store._state().snapshot["seq"] == 2
    store.link(("n", "a"), ("n", "b"), "refines", as_of=T1)
    store.link(("n", "a"), ("n", "b"), "refines", as_of=T2)
    store.link(("n", "b"), ("n", "a"), "refines", as_of=T3)
    assert sorted((x["from_id"], str(x["created_at"])) for x in store.links().collect()) == sorted([(a["id"], T1), (b["id"], T3)])
    store.link(("n", "a"), ("n", "b"), "refines", remove=True)
    store.compact()
    assert [(x["from_id"], x["to_id"]) for x in store.links().collect()] == [(b["id"], a["id"])]
    assert store.put_many(puts_of(spark, [("n", "c", "z", None)]), T1, mark="m").count() == 1
    store.compact()
    assert store.put_many(puts_of(spark, [("n", "c", "z", None)]), T1, mark="m").count() == 0


def test_created_once(spark, tmp_path):
    files, made = Files(spark), []
    threads = [threading.Thread(target=lambda i=i: made.append(files.create(f"file://{tmp_path}/x/one", str(i)))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(made) == [False] * 7 + [True] and list(files.names(f"file://{tmp_path}/x")) == ["one"]


def test_writers_side_by_side(spark, tmp_path):
    """Versions of a key are consecutive whoever puts them, and nothing is lost; writes of other keys don't start anew."""
    path, failed = f"file://{tmp_path}/s", []
    Store(spark, path)

    def write(name):
        try:
            store = Store(spark, path)
            for i in range(2):
                store.put_many(puts_of(spark, [("n", "shared", f"{name}{i}", None), ("n", f"{name}{i}", "own", None)]), T1)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(name,)) for name in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    rows = Store(spark, path).memories().collect()
    assert sorted(r["version"] for r in rows if r["key"] == "shared") == list(range(1, 5))
    assert sorted(r["content"] for r in rows if r["key"] == "shared") == [f"{name}{i}" for name in "ab" for i in range(2)]
    assert len(rows) == 8 and set(MEMORY_COLS) == set(rows[0].asDict())


def test_conflicts(spark, tmp_path):
    """Another key isn't in the way; the same key, a replaced segment and a closed generation are."""
    store = Store(spark, f"file://{tmp_path}/s")
    store.put("n", "a", "x", as_of=T1)
    old = store._state()
    store.put("n", "b", "y", as_of=T1)
    commit = {"op": "access", "ts": T1}
    assert store._append_log(old, commit, {"n\x1fc"}) == 3
    with pytest.raises(st.Conflict):
        store._append_log(old, commit, {"n\x1fb"})
    with pytest.raises(st.Conflict):
        store._append_log(old, commit, spark.createDataFrame([("n", "b")], "ns string, key string"))
    state = store._state()
    store._merge(state, list(state.segments))
    with pytest.raises(st.Conflict):
        store._append_log(old, commit, frozenset(), old.segments)
    last = store._state()
    store.compact()
    with pytest.raises(st.Conflict):
        store._append_log(last, commit)
    assert issubclass(st.Conflict, ConcurrentWrite) and store.list(as_of=T2).count() == 2


def test_compaction_that_closed_but_did_not_turn(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put("n", "a", "x", as_of=T1)
    with monkeypatch.context() as m:
        m.setattr(Store, "_point_to", lambda *_: (_ for _ in ()).throw(OSError()))
        with pytest.raises(OSError):
            store.compact()
    assert [r["content"] for r in store.list(as_of=T2).collect()] == ["x"] and store._current() == "g0"
    assert store.put("n", "a", "z", as_of=T2)["version"] == 2
    assert store._current() != "g0" and [r["content"] for r in store.list(as_of=T3).collect()] == ["z"]


def test_index_made_when_needed(spark, tmp_path, monkeypatch):
    """Puts of many keys and their merge write memories alone; the first search makes the index of its kind, once, and it finds what the texts hold."""
    monkeypatch.setattr(st, "INLINE", 2)
    monkeypatch.setattr(st, "FANOUT", 3)
    store, r = Store(spark, f"file://{tmp_path}/s"), random.Random(3)
    text = lambda i: "" if i % 40 == 0 else "\n\n\n".join(" ".join(r.choices(WORDS, k=r.randrange(3, 90))) for _ in range(r.randrange(1, 4)))
    tables = lambda: {name for name in [*st.TABLES, "made"] if Files(spark).names(f"{store.path}/g0/{name}")}
    for k in range(3):
        store.put_many(puts_of(spark, [("n", f"k{k}x{i}", text(i), "high") for i in range(110)]), T1)
    store.rm_many(spark.createDataFrame([("n", f"k1x{i}") for i in range(1, 9)], "ns string, key string"), hard=True)
    assert tables() == {"memories"} and len(store._state().segments) == 1
    index = store.index(kinds=["postings"])
    assert index.grams is None and len(Files(spark).names(f"{store.path}/g0/made")) == 1
    ranks = lambda df: sorted((x["chunk_id"], round(x["bm25"], 9)) for x in df.collect())
    assert ranks(search.bm25_by_index(index, "alpha mu")) == ranks(search.bm25(store.chunks(), "alpha mu")) != []
    assert index.postings.groupBy("term", "block").count().filter("count > 1").isEmpty()
    for query in ("alpha beta", "mu\n\nalpha", "eta%\n\n_amma", "mu_alpha"):
        full = [x["id"] for x in search.search_like(store.memories(), store.chunks(), query, T9, limit=None).collect()]
        index = store.index()
        assert sorted(x["id"] for x in indexed.search_like(index, query, T9).collect()) == sorted(full)
        rows = indexed.rows_of(index, [(b, ref, i) for i, (b, ref) in enumerate(indexed.like_top(index, query, T9, limit=7))]).collect()
        assert [x["id"] for x in sorted(rows, key=lambda x: x["place"])] == full[:7]
    state = store._state()
    assert sorted(state.segments.popitem()[1]["made"]) == ["grams", "postings"] and len(Files(spark).names(f"{store.path}/g0/made")) == 2
    store.vacuum(0)
    assert len(Files(spark).names(f"{store.path}/g0/made")) == 2
    store.compact()
    assert ranks(search.bm25_by_index(store.index(), "alpha mu")) == ranks(search.bm25(store.chunks(), "alpha mu")) != []


def test_postings_of_memories(spark, tmp_path, monkeypatch):
    """Texts of any characters, cut and counted by tasks that hold whole blocks, have the postings that their chunks have; they are in order by runs, so
    that only texts are sorted, and no postings."""
    monkeypatch.setattr(st, "INLINE", 2)
    store, r = Store(spark, f"file://{tmp_path}/s"), random.Random(5)
    words = [*WORDS, "Éa", "straße", "x’y", "中文", "İz", "Σας", "²3", "ǅ"]
    text = lambda i: "" if i % 40 == 0 else "\n\n".join(" ".join(r.choices(words if i % 5 else WORDS, k=r.randrange(3, 150))) for _ in range(r.randrange(1, 5)))
    puts = [("n", f"k{i:03d}", text(i), ["high", "low"][i % 2]) for i in range(300)]
    store.put_many(puts_of(spark, [*puts, ("n", "long", "mu " * 70_000, "low"), ("n", "none", None, "low")]), T1)
    found = store.index(kinds=["postings"]).postings
    rows = spark.read.parquet(f"{store.path}/g0/memories")
    chunks = store._chunked(rows, None)
    names = ["term", "block", "n", "max_tf", "min_dl", "max_weight", "max_created"]
    plain = lambda row: (*[row[c] for c in names], sorted(tuple(e) for e in row["entries"]))
    held = indexed._inlined(found, "term").filter("term <> ''").groupBy("term", F.floor(F.col("ref") / indexed.BLOCK).alias("block"))
    entries = {(x["term"], x["block"]): x["entries"] for x in held.agg(F.collect_list(F.struct((F.col("ref") % indexed.BLOCK).alias("ref"), "seq", "tf", "dl")).alias("entries")).collect()}
    stored = [plain(x.asDict() | {"entries": entries[x["term"], x["block"]]}) for x in found.filter("term <> ''").collect()]
    assert sorted(stored) == sorted(map(plain, indexed.postings_of(chunks).collect()))
    assert any(x[3] == 70_000 for x in stored) and {"straße", "中文"} <= {x[0] for x in stored}
    again = indexed.packed(indexed.postings_of(chunks))
    assert sorted(map(tuple, indexed._inlined(again, "term").collect())) == sorted(map(tuple, indexed._inlined(found.filter("term <> ''"), "term").collect()))
    made = indexed.memory_postings(rows.drop("batch"), lambda odd: store._chunked(odd, None))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.index("MapInArrow") < plan.index("Sort [")
    # one run and so one order for each task
    each = made.withColumn("task", F.spark_partition_id()).collect()
    assert each == sorted(each, key=lambda x: (x["task"], x["term"].encode(), x["block"]))
