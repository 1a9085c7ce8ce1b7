import hashlib
import random
import struct

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe
from palimpsest.llm import token_counts as tc

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
TEXT = st.text(st.sampled_from("ab Zé1\n\t'sl.,!? 中😀  <|endoftext|>"), max_size=300)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_pieces_encode_as_the_whole(text, size):
    enc = bpe.encoding(RANKS, P.PATTERN)
    pieces = list(bpe.safe_pieces(text, size))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_roundtrip(odd):
    enc = bpe.encoding(RANKS, P.PATTERN)
    rows = bpe.bpe_roundtrip(odd, RANKS, P.PATTERN).collect()
    assert len(rows) == 9
    for r in rows:
        text = r["text"] or ""
        ids = enc.encode_ordinary(text)
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and bytes(r["decoded"]) == text.encode()


def test_empty(none):
    assert bpe.bpe_roundtrip(none, RANKS, P.PATTERN).count() == 0
    assert tc.token_counts(none, JSON).count() == 0


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(4, 60), st.integers(1, 20))
def test_chunks_count_as_the_whole(text, chunk, overlap):
    tok = tc.tokenizer(JSON)
    assert tc.count_by_chunks(text, tok, chunk, overlap) == len(tok.encode(text, add_special_tokens=False))


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_pieces_count_as_the_whole(texts):
    import re

    tok = tc.tokenizer(JSON)
    regular = [t for t in texts if not re.search(r"[\x01\t\x0b\f\r\x1c-\x1f\x85\xa0 ]|[ \n][ \n]", t)]
    expected = [len(tok.encode(t, add_special_tokens=False)) for t in regular]
    assert tc.PieceCounts(tok)(pa.array(regular, pa.string())).tolist() == expected


def test_counts(odd):
    tok = tc.tokenizer(JSON)
    rows = tc.token_counts(odd, JSON).collect()
    assert len(rows) == 9
    for r in rows:
        text = r["text"] or ""
        n = len(tok.encode(text, add_special_tokens=False))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 512)


def test_unbroken_text():
    """No boundary anywhere: overlaps widen, then the chunk does."""
    tok, letters = tc.tokenizer(JSON), "".join(random.Random(1).choices("abcdefgh", k=3000))
    assert tc.count_by_chunks(letters, tok, 100, 10) == len(tok.encode(letters, add_special_tokens=False))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_query_digests(spark, tmp_path, n):
    spark.createDataFrame([(i, "text " * i) for i in range(n)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = bpe.op10_bpe_roundtrip(spark, str(tmp_path)).collect()
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256(b"text " * r["doc_id"]).hexdigest()
    assert len(rows) == n


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab Zé1\n\t\x0b\x1c\x85\u00a0\u3000'sl.,!? 中😀²Ⅷ"), st.characters(codec="utf-8")), max_size=200), st.integers(1, 30))
def test_walked_matches_encode_as_the_whole(text, size):
    assert bpe.encode(text, RANKS, P.PATTERN, size, size) == bpe.encoding(RANKS, P.PATTERN).encode_ordinary(text)


@pytest.mark.parametrize("run", [" ", "\n", "\u3000", " \n", "a", "1", "-", "語"])
def test_a_million_characters_without_boundary(run):
    text = "start " + run * (1_000_000 // len(run)) + "end"
    ids = bpe.encode(text, RANKS, P.PATTERN)
    assert bpe.encoding(RANKS, P.PATTERN).decode_bytes(ids) == text.encode()


def test_another_pattern():
    """Patterns whose safe boundaries aren't known aren't cut at those of the usual one."""
    text, pattern = "one two 33three, " * 40, r"[a-z]+ [a-z]+|\d+[a-z]+|[\s\S]"
    assert bpe.encode(text, RANKS, pattern, 50, 60) == bpe.encoding(RANKS, pattern).encode_ordinary(text)


def test_query_ids(spark, tmp_path):
    texts = {1: "Some text, 12 words.\n\n  and more", 2: "é" * 10, 3: None, 4: " " * 300_000 + "x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    enc = bpe.encoding(RANKS, P.PATTERN)
    for r in bpe.op10_bpe_roundtrip(spark, str(tmp_path)).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


def test_count_query(spark, tmp_path):
    texts = {1: "Some text, 12 words.\n\n  and more", 2: "<|endoftext|>é" * 10, 3: None, 4: "many words and more, " * 4000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tok = tc.tokenizer(JSON)
    for r in tc.op3_token_counts(spark, str(tmp_path)).collect():
        text = texts[r["doc_id"]] or ""
        n = len(tok.encode(text, add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_other_tokenizers(spark, tmp_path):
    """Files whose tokens may go over the boundaries are noticed, and texts are encoded whole."""
    import json

    path = P.path("word_bpe_49k.json")
    assert tc.splits_as_known(JSON) and not tc.splits_as_known(path)
    known = json.loads(open(JSON, encoding="utf-8").read())
    known["added_tokens"].append({"id": 50257, "content": "two words", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    (tmp_path / "added.json").write_text(json.dumps(known), encoding="utf-8")
    assert not tc.splits_as_known(str(tmp_path / "added.json"))
    tok, text = tc.tokenizer(path), "Some two words, and <|endoftext|> others.\n" * 2000
    (row,) = tc.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).collect()
    assert row["n_tokens"] == len(tok.encode(text, add_special_tokens=False))
