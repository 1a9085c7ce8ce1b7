import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.operators.chunking import chunk_rows, chunk_text, fill


def texts(*args, **kw):
    return [c[0] for c in chunk_text(*args, **kw)]


def test_short_and_empty():
    assert chunk_text("") == chunk_text(None) == chunk_text(" \n ") == []
    assert chunk_text("This is a short memory.") == [("This is a short memory.", 1, 1)]
    assert chunk_text("a\nb") == [("a\nb", 1, 2)]


def test_headings():
    part = "word " * 67
    found = texts(f"# Section One\n{part}\n# Section Two\n{part}\n# Section Three\n{part}")
    assert len(found) == 3 and "Section One" in found[0]
    assert texts("# A\nsmall\n# B\nsmall") == ["# A\nsmall\n# B\nsmall"]
    assert len(texts("a" * 350 + "\n#tag " + "b" * 350)) == 2


def test_blank_lines():
    a, b = "x" * 500, "y" * 500
    # one blank line doesn't part blocks, so the cut is made between lines; two do, and then each is a block of its own
    assert chunk_text(f"{a}\n\n{b}") == [(a, 1, 1), (b, 3, 3)]
    assert texts(f"{a[:300]}\n\n{b[:300]}") == [a[:300], b[:300]]
    assert chunk_text(f"{a}\n\n\n{b}") == [(a, 1, 1), (b, 3, 3)]


def test_long_lines_and_middle_blocks():
    assert texts("z" * 6300) == ["z" * 6300]
    middle = "\n".join(["m" * 100] * 5)
    assert texts(f"{middle}\n# next\n{'n' * 300}")[0] == middle  # 504 bytes: over the target, under the maximum


def test_bytes_decide():
    text = "é" * 295 + " e"  # 592 bytes
    assert len(chunk_text(text)) == 1
    assert len(chunk_text("é" * 200 + "\n" + "é" * 150)) == 2  # 351 characters, 701 bytes


def test_lines():
    found = chunk_text("\n".join(f"This is line number {i:02d} with some more words to fill it." for i in range(20)), 200, 300)
    assert len(found) >= 2 and found[0][1] == 1 and found[-1][2] == 20


@given(st.lists(st.integers(0, 50), max_size=30), st.integers(0, 3), st.integers(1, 60))
def test_fill_covers_everything_once(sizes, gap, limit):
    ranges = list(fill(sizes, gap, limit))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(sizes)))
    for a, b in ranges:
        assert b - a == 1 or sum(sizes[a:b]) + gap * (b - a - 1) <= limit


@settings(max_examples=100)
@given(st.text("ab #\né", max_size=400), st.integers(5, 40), st.integers(0, 40))
def test_words_survive(text, target, more):
    found = chunk_text(text, target, target + more)
    assert "".join("".join(c[0].split()) for c in found) == "".join(text.split())
    assert all(c[0].strip() == c[0] and c[1] <= c[2] + 1 for c in found)


def test_rows(spark):
    rows = spark.createDataFrame([("1", "short"), ("2", "x" * 500 + "\n" + "y" * 500), ("3", None), ("4", "  ")], "id string, content string")
    found = sorted((r["memory_id"], r["seq"], r["text"][:5], r["start_line"], r["end_line"]) for r in chunk_rows(rows).collect())
    assert found == [("1", 0, "short", 1, 1), ("2", 0, "xxxxx", 1, 1), ("2", 1, "yyyyy", 2, 2)]


@pytest.mark.parametrize("text", ["a\n\n\n\nb" * 200, "# h\n" * 300, "\r\n".join(["w" * 90] * 20)])
def test_sizes(text):
    assert all(len(c[0].encode()) <= 600 for c in chunk_text(text))
