import gzip
import hashlib
import zlib

import pytest

from palimpsest.llm import warc

PAGE = "<html>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</html>"


def written(spark, rows, path):
    spark.createDataFrame(rows, "page_id long, url string, html string, page int").coalesce(2).write.parquet(f"{path}/pages.parquet")


def test_round_trip(spark, tmp_path):
    rows = [
        (5, "http://a.example/x?y", PAGE, 1),
        (3, "http://b.example", PAGE, 1),
        (7, None, PAGE, 1),
        (1, "http://c.example/\r\nX: y", "small", 1),
        (2, "http://d.example/", "small", 1),
        (8, "http://e.example/", None, 1),
        (9, "", "é" * 60, 1),
        (10, "", "é" * 60, 1),
    ]
    written(spark, rows, tmp_path)
    found = {r["page_id"]: r for r in warc.op5_warc(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        assert (found[page_id]["payload_bytes"], found[page_id]["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    assert {i: r["refers_to"] for i, r in found.items() if r["record_type"] == "revisit"} == {5: 3, 7: 3, 10: 9}


def test_records_and_captures(spark, tmp_path):
    written(spark, [(1, "http://a.example/p#f", PAGE, 0), (2, "http://a.example/q", PAGE, 0)], tmp_path)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    records = warc.read_records(spark, path)
    assert sorted(r["warc_type"] for r in records.filter("warc_type <> 'warcinfo'").collect()) == ["metadata", "metadata", "request", "request", "response", "revisit"]
    rows = {r["response"]["warc_type"]: r for r in warc.assemble(records).collect()}
    assert bytes(rows["response"]["response"]["block"]).endswith(PAGE.encode())
    assert bytes(rows["response"]["request"]["block"]).startswith(b"GET /p HTTP/1.1\r\nHost: a.example")
    assert rows["revisit"]["response"]["refers_to"] == rows["response"]["response"]["record_id"]
    assert warc.assemble(records.filter("warc_type <> 'request'")).filter("request IS NULL").count() == 2


def test_odd_ids_and_empty(spark, tmp_path):
    written(spark, [(None, "u", PAGE, 0), (4, "u", PAGE, 0), (4, "u", PAGE, 0)], tmp_path / "a")
    rows = warc.op5_warc(spark, str(tmp_path / "a")).collect()
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in rows) == [("response", 0), ("revisit", 4), ("revisit", 4)]
    written(spark, [], tmp_path / "b")
    assert warc.op5_warc(spark, str(tmp_path / "b")).count() == 0


def test_parser():
    record = lambda n: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % n + b"z" * n + b"\r\n\r\n"
    members = b"".join(gzip.compress(record(n)) for n in (0, 5, 3_000_000, 1))
    assert [len(b) for _, b in warc._parse(members)] == [0, 5, 3_000_000, 1]
    with pytest.raises(ValueError):
        list(warc._parse(gzip.compress(record(9)[:-6])))


def test_equal_pages_without_id(spark, tmp_path):
    written(spark, [(None, "u", PAGE, 0), (None, "u", PAGE, 0), (None, None, None, 0)], tmp_path)
    rows = warc.op5_warc(spark, str(tmp_path)).collect()
    assert sorted((r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows) == [("response", None, 0), ("response", None, len(PAGE)), ("revisit", None, len(PAGE))]


def test_sizes(spark, tmp_path, monkeypatch):
    """Large pages stand in archives of their own; repeated ones are written once."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 200_000)
    text = lambda i, n: "".join(chr(97 + (i * k * k) % 26) for k in range(n))
    rows = [(i, f"http://a.example/{i}", text(i, n), 0) for i, n in enumerate([1_000_000] * 3 + [50_000] * 5 + [500] * 40)]
    rows += [(100 + i, "", text(0, 1_000_000), 0) for i in range(5)]
    written(spark, rows, tmp_path)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    most = [max(len(b) for _, b in warc._parse(f.read_bytes())) for f in (tmp_path / "warc").glob("*.warc.gz")]
    assert sum(n > 500_000 for n in most) == 3
    found = {r["page_id"]: r for r in warc.digests(warc.assemble(warc.read_records(spark, path))).collect()}
    assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in found.items()} == {i: (len(h), hashlib.sha256(h.encode()).hexdigest()) for i, _, h, _ in rows}
    assert {i for i, r in found.items() if r["refers_to"] == 0} == set(range(100, 105))


def test_rows_without_files(spark):
    """Keys of rows that no file holds are written, and so stay the same."""
    pages = spark.createDataFrame([(i, "u", PAGE) for i in range(20)], "page_id long, url string, html string").repartition(3)
    planned = warc.plan_revisits(pages).collect()
    assert len({r["capture"] for r in planned}) == 20 and {r["refers_to"] for r in planned} - {None} == {r["capture"] for r in planned if r["page_id"] == 0}


def test_assembly_without_blocks(spark, tmp_path):
    """Blocks that aren't asked for aren't shuffled."""
    written(spark, [(1, "u", PAGE, 0)], tmp_path)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    records = warc.read_records(spark, path)
    plan = lambda fields: warc.assemble(records, fields)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert "block#" in plan(warc.FIELDS) and "block#" not in plan(("head", "payload_sha256"))


@pytest.mark.parametrize("n", [1, 40])
def test_long_heads(n):
    """The payload begins where the header of the message ends, however long that is."""
    header = "HTTP/1.1 200 OK\r\n" + "".join(f"X-Field-{i}: {'y' * 100}\r\n" for i in range(n))
    head, size, digest, _ = warc._fields({"content-type": "application/http; msgtype=response"}, (header + "\r\nbody\r\n\r\nmore").encode())
    assert (head, size, digest) == (header[:-2], 12, hashlib.sha256(b"body\r\n\r\nmore").hexdigest())


def members(content):
    """(offset, bytes) of each gzip member."""
    at = 0
    while at < len(content):
        inflater = zlib.decompressobj(31)
        data = inflater.decompress(content[at:])
        assert inflater.eof
        yield at, data
        at = len(content) - len(inflater.unused_data)


def test_every_record_is_a_member(spark, tmp_path):
    """Each record can be read alone from its offset, also after one of 16 MB or more; an archive begins with a warcinfo."""
    rows = [(i, f"http://a.example/{i}", PAGE + str(i), 0) for i in range(20)] + [(30, "u", "é" * 9_000_000, 0), (31, None, None, 0)]
    written(spark, rows, tmp_path)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("*.warc.gz")]
    assert files and not list((tmp_path / "warc").glob("part-*.txt"))
    kinds = []
    for content in files:
        each = list(members(content))
        sizes = [b - a for (a, _), (b, _) in zip(each, [*each[1:], (len(content), None)], strict=True)]
        for k, (offset, data) in enumerate(each):
            [(head, _)] = warc._parse(content[offset : offset + sizes[k]])
            assert data.endswith(b"\r\n\r\n") and (k > 0 or head["warc-type"] == "warcinfo")
            kinds.append(head["warc-type"])
    assert sorted(k for k in kinds if k != "warcinfo") == sorted(["request", "response", "metadata"] * 22)
    found = {r["page_id"]: r["payload_digest"] for r in warc.digests(warc.assemble(warc.read_records(spark, path))).collect()}
    assert found == {i: hashlib.sha256((h or "").encode()).hexdigest() for i, _, h, _ in rows}


@pytest.mark.parametrize("last", [b"", b"z" * (17 << 20)])
def test_archives_end_in_zero(last):
    """Also where the last record is so large that its size's highest byte isn't 0."""
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(last) + last
    [content] = warc._archives([record], 1 << 30)
    assert content[-1] == 0 and [h["warc-type"] for h, _ in warc._parse(content)][:2] == ["warcinfo", "response"]
    assert [len(list(warc._parse(a))) for a in warc._archives([record] * 3, 10)][:2] == [2 + bool(last)] * 2


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type:response\r\nwarc-record-id:<urn:a>\r\nWARC-Target-URI: http://x/\xff\r\nContent-Type:application/http;\r\n msgtype=response\r\nCONTENT-LENGTH :  23\r\n\r\n"
    b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: request\r\nX: no length\r\n\r\nGET / HTTP/1.1\r\n\r\nmore\r\n\r\n"
    b"\r\nnot a record\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: none\r\n\r\n"
    b"WARC/1.0\nWARC-Type: metadata\nWARC-Concurrent-To: <urn:a>\nWARC-Record-ID: <urn:m>\nContent-Length: 2\n\nok\r\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:b>\r\nContent-Length: 1\r\n\r\nx"
)


@pytest.mark.parametrize("form", ["plain", "stream", "padded"])
def test_foreign_archives(spark, tmp_path, form):
    """Odd headers are read, records without a length skipped and counted; as one stream, plain, or with padding between."""
    content = {"plain": FOREIGN, "stream": gzip.compress(FOREIGN), "padded": gzip.compress(FOREIGN) + b"\0" * 9}[form]
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(content)
    records = warc.read_records(spark, f"file://{tmp_path}")
    rows = records.collect()
    assert [r["warc_type"] for r in rows] == ["response", None, None, "metadata", "response"]
    assert rows[0]["target_uri"] == "http://x/\ufffd" and rows[0]["payload_bytes"] == 4 and rows[0]["head"] == "HTTP/1.1 200 OK"
    captures = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(captures) == {"<urn:a>", "<urn:b>"} and captures["<urn:a>"]["metadata"]["record_id"] == "<urn:m>"


@pytest.mark.parametrize("size", range(1, 40))
def test_records_across_pieces(monkeypatch, size):
    """However the bytes come in pieces, the records are the same."""
    whole = list(warc._parse(FOREIGN))
    monkeypatch.setattr(warc, "_inflated", lambda content: (content[i : i + size] for i in range(0, len(content), size)))
    assert list(warc._parse(FOREIGN)) == whole
