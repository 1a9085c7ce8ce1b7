import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import packing as pk
from palimpsest.llm.token_counts import tokenizer

JSON = P.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from("ab Zé1\n\t\x0b\x0c\x1c\x85\xa0\u2028'sl.,!? ̈ıİßΣς中😀  <|endoftext|>&$"), max_size=200)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_ids_are_the_librarys(texts):
    tok, ids = tokenizer(JSON), pk.Ids(JSON)
    texts += ["It's <|endoftext|> don't <|startoftext|>, word<|endoftext|> Hello, World!! café&&& A.b 12,3 don'T"]
    assert ids.ends is not None and [x.tolist() for x in ids.of(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_documents(spark, monkeypatch):
    monkeypatch.setattr(pk, "REMEMBERED", 500)
    tok, ids = tokenizer(JSON), pk.Ids(JSON)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for k in range(0, len(texts), 40):
        some = texts[k : k + 40]
        assert [x.tolist() for x in ids.of(some)] == [e.ids for e in tok.encode_batch(some, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(lengths):
    """As with a search through all open windows."""
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [w for w, left in enumerate(free) if left >= n]
        if fit:
            free[min(fit, key=lambda w: free[w])] -= n
        else:
            free.append(64 - n)
    made = pk.best_fit(lengths, 64)
    assert sorted(64 - sum(n for *_, n in w) for w in made) == sorted(free)
    assert sorted(i for w in made for i, *_ in w) == list(range(len(lengths)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(0, 8))
def test_filled(lengths, padding):
    made = pk.filled(pk.best_fit(lengths, 64), 64, padding)
    for w in made:
        n = sum(n for *_, n in w)
        assert 0 < n <= 64 and (64 - n <= padding or n & (n - 1) == 0)
    ids = sorted((i, k) for w in made for i, start, n in w for k in range(start, start + n))
    assert ids == [(i, k) for i, n in enumerate(lengths) for k in range(n)]


def check(rows, texts):
    """rows (key, start, ids, doc_tokens, sequence_id, offset) hold the texts' ids, each once, gaplessly; the share of padding."""
    tok, sequences, docs = tokenizer(JSON), {}, {}
    for key, start, ids, total, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, len(ids)))
        docs.setdefault(key, []).append((start, ids, total))
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end and n > 0
            end += n
        assert end <= pk.WINDOW
        padding += 0 if end & (end - 1) == 0 else pk.WINDOW - end
    for key, text in texts.items():
        want, got = [*tok.encode(text or "", add_special_tokens=False).ids, 1], []
        for start, ids, total in sorted(docs[key], key=lambda x: x[0]):
            assert start == len(got) and total == len(want)
            got += ids
        assert got == want
    return padding / sum(len(r[2]) for r in rows)


def test_packed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = pk.packed(docs, JSON, group_docs=70).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in rows], texts) < 0.01
    query = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pk.op13_packing(spark, "/root/testdata/sf0.001").collect()}
    for r in pk.packed(docs, JSON).collect():
        assert query[r["doc_id"], r["start"]] == (len(r["ids"]) // 4, zlib.crc32(r["ids"]), r["doc_tokens"])


def test_many_of_one_length(spark):
    """Copies of a length just over a half would leave the other half empty."""
    rows = [(i, "word " * 1100) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = pk.packed(docs, JSON).collect()
    assert check([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in found], dict(rows)) < 0.005


def test_odd_rows(odd, none):
    rows = pk.packed(odd.coalesce(1), JSON).collect()
    numbered = {}
    for r in rows:
        assert r["n_lines"] == 14 or "n_lines" in r.asDict()
        numbered.setdefault(r["doc_id"], []).append(r)
    assert {k: sum(r["length"] for r in v) // (2 if k == 1 else 1) for k, v in numbered.items()} == {k: v[0]["doc_tokens"] for k, v in numbered.items()}
    assert numbered[2][0]["doc_tokens"] == numbered[3][0]["doc_tokens"] == 1
    assert len(numbered[5]) > 20 and pk.packed(none, JSON).count() == 0
    assert pk.packed(odd.select("text").coalesce(1), JSON).count() == len(rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizer(name):
    text = "It's  two\n\nlines <|endoftext|> x"
    assert pk.Ids(P.path(name)).of([text])[0].tolist() == tokenizer(P.path(name)).encode(text, add_special_tokens=False).ids
