"""Operator 5: WARC archives of captures, written and read back, and assembled into one nested row a capture.

A capture is three records: request, response (or revisit) and metadata; request and metadata name the response in
WARC-Concurrent-To. Of captures with equal payloads of at least MIN_REVISIT bytes, that with the smallest page_id is
the response, the others revisit it and hold headers only.

Archives are .warc.gz files in the shared folder: a warcinfo record, then the records, each of them a gzip member of
its own, so that it can be read by its offset. A task gathers up to ARCHIVE_BYTES of records, or one that is larger, to
an archive; Spark's text writer writes each as the one row of a file, and commits the files of tasks that succeeded.
The driver gives them their names, a rename each.

Reading takes archives of others too, compressed by record, as one stream or not at all. Names of fields are of either
case, blanks around values don't matter, continued lines are joined, and bytes that aren't UTF-8 are replaced. What
isn't a record or lacks a length is skipped up to the next record, and is a row with null warc_type, which assembling
leaves out. An archive that breaks off is an error.

Only narrow columns are shuffled, but for payloads with more repeated digests than a broadcast takes: which captures
are revisits follows from digests, and assembling carries the fields of a record that are asked for.

Nulls: a null html is an empty payload, a null url gives records without a target URI, captures with null page_id are
kept and sort after all others. Repeated rows are captures of their own; of those with the smallest page_id, the first
by key is the response. Line ends in a url are percent-encoded. Very long payloads are read back whole, a record at a
time. Other columns than page_id, url and html aren't archived. Empty tables give an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import join_by_size, new_path, ship, table, written

MIN_REVISIT = 100
#: Bytes of an archive's records, before compression, if it has more than one.
ARCHIVE_BYTES = 64 << 20
CRLF = "\r\n"
RECORD_END = b"\r\n\r\n"
_NOT_BLANK, _HEAD_END, _NEXT = re.compile(rb"[^\r\n]"), re.compile(rb"\r?\n\r?\n"), re.compile(rb"\n\r?\nWARC/")
#: Fixed, as the pages bear no time.
WARC_DATE = "2024-01-01T00:00:00Z"

#: head is the text before the payload of an HTTP message, or all of a block of fields; in other records, all is payload.
_RECORD = T.StructType(
    [
        T.StructField("warc_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("head", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("block", T.BinaryType()),
    ]
)
#: Fields of a part of a capture.
FIELDS = tuple(f for f in _RECORD.fieldNames() if f != "concurrent_to")


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, url and html of pages with key, which stays the same however often the rows are read: the file and the
    place of a row of Parquet files, or else a number that is written with the rows."""
    columns = ["page_id", F.col("url").cast("string").alias("url"), "html"]
    try:
        return pages.select(*columns, F.concat_ws(".", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string")).alias("key"))
    except AnalysisException:  # no files behind these rows
        return written(pages.select(*columns, F.monotonically_increasing_id().cast("string").alias("key")), "pages")


def plan_revisits(pages: DataFrame) -> DataFrame:
    """pages with capture (unique), payload, payload_bytes, digest and refers_to (capture of the response, or null)."""
    html = F.coalesce("html", F.lit(""))
    pages = keyed(pages).select(
        "page_id",
        "url",
        F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit("."), "key").alias("capture"),
        html.alias("payload"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("digest"),
    )
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "capture")
    # of payloads under MIN_REVISIT none is looked for
    pages = pages.withColumn("repeated", F.when(F.col("payload_bytes") >= MIN_REVISIT, F.col("digest")))
    equal = pages.filter("repeated IS NOT NULL").groupBy("repeated").agg(F.count(F.lit(1)).alias("n"), F.min(rank)["capture"].alias("first"))
    pages = join_by_size(pages, written(equal.filter("n > 1"), "equal"), "repeated", "n", F.col("capture"))
    return pages.withColumn("refers_to", F.when(F.col("first") != F.col("capture"), F.col("first"))).drop("first", "repeated")


def _record(kind: Column, record_id: Column, headers: list[Column], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {WARC_DATE}"), *headers]
    return F.concat_ws(CRLF, *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit(""), block)


def _urn(capture: Column, part: str) -> Column:
    return F.concat(F.lit("<urn:capture:"), capture, F.lit(f":{part}>"))


def warc_records(captures: DataFrame) -> DataFrame:
    """One row `value` for each record; needs the columns of plan_revisits()."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    response = _urn(F.col("capture"), "response")
    revisit = F.col("refers_to").isNotNull()
    target = F.concat(F.lit("WARC-Target-URI: "), url)
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), response)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    answer = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        response,
        [
            target,
            F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to"), "response")),
            F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
            F.lit("Content-Type: application/http; msgtype=response"),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract(url, r"^[a-zA-Z]+://([^/]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    request = _record(F.lit("request"), _urn(F.col("capture"), "request"), [target, concurrent, F.lit("Content-Type: application/http; msgtype=request")], asked)
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), _urn(F.col("capture"), "metadata"), [target, concurrent, F.lit("Content-Type: application/warc-fields")], fields)
    return captures.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def _member(record: bytes) -> bytes:
    deflater = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflater.compress(record + RECORD_END) + deflater.flush()


def _archives(records, most: int):
    """The records in archives of up to `most` bytes each. The last byte of an archive is 0: a gzip member ends in its
    size, the highest byte last, and after a larger one (16 MB) a small record follows."""
    info = f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:%s>{CRLF}WARC-Date: {WARC_DATE}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: 18{CRLF * 2}format: WARC/1.1{CRLF}"
    begin = lambda: [_member((info % uuid.uuid4()).encode())]
    members, held = begin(), 0
    for record in records:
        if held and held + len(record) > most:
            yield b"".join(members if members[-1][-1] == 0 else members + begin())
            members, held = begin(), 0
        members.append(_member(record))
        held += len(record)
    if held:
        yield b"".join(members if members[-1][-1] == 0 else members + begin())


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of the pages in a new folder, path."""
    spark, most = pages.sparkSession, ARCHIVE_BYTES
    ship(spark)

    def run(batches):
        for archive in _archives((value.as_py() for batch in batches for value in batch.column("value")), most):
            yield pa.RecordBatch.from_arrays([pa.array([archive[:-1]], pa.binary())], names=["value"])

    archives = warc_records(plan_revisits(pages)).select(F.col("value").cast("binary")).mapInArrow(run, "value binary")
    # the writer ends a row with a line separator: the byte that was taken off
    archives.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and status.getLen() and not files.rename(status.getPath(), folder.suffix("/" + name.removesuffix(".txt") + ".warc.gz")):
            raise OSError(f"can't rename {status.getPath()}")


def _inflated(content: bytes):
    """The bytes of an archive, gzip of one or many members or plain, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i : i + (1 << 22)] for i in range(0, len(content), 1 << 22))
        return
    inflater, at = zlib.decompressobj(31), 0
    while at < len(content) or inflater.unconsumed_tail:
        data = inflater.unconsumed_tail or content[at : at + (1 << 16)]
        if not inflater.unconsumed_tail:
            at += len(data)
        got = inflater.decompress(data, 1 << 22)
        if inflater.eof:
            at -= len(inflater.unused_data)
            while content[at : at + 1] == b"\0":  # padding between members
                at += 1
            inflater = zlib.decompressobj(31)
        if got:
            yield got


def _head(lines: list[str]) -> dict[str, str]:
    """The fields of a header, by names in lower case; a line that begins with a blank continues that before."""
    head: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            head[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            head[name] = value.strip()
    return head


def _parse(content: bytes):
    """(header, block) of each record of an archive; header is None for what isn't a record. Buffers are only cut when
    more is needed, so that many small records cost no more than their bytes."""
    pieces, held, start = _inflated(content), bytearray(), 0

    def more() -> bool:
        nonlocal start
        del held[:start]
        start = 0
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while not (begins := _NOT_BLANK.search(held, start)):
            start = len(held)
            if not more():
                return
        start = begins.start()
        looked = start
        while not (ends := _HEAD_END.search(held, looked)):
            looked = max(0, len(held) - start - 3)
            if not more():
                raise ValueError("a WARC record breaks off in its header")
        lines = re.split("\r?\n", held[start : ends.start()].decode("utf-8", "replace"))
        head = _head(lines[1:])
        if not lines[0].startswith("WARC/") or not head.get("content-length", "").isdecimal():
            skipped = bytes(held[start : ends.start()])
            start = ends.start()
            while not (following := _NEXT.search(held, start)):
                start = max(start, len(held) - 8)
                if not more():
                    start = len(held)
                    break
            else:
                start = following.end() - 5
            yield None, skipped
            continue
        size = int(head["content-length"])
        start = ends.end()
        while len(held) < start + size:
            if not more():
                raise ValueError("a WARC record breaks off in its block")
        yield head, bytes(held[start : start + size])
        start += size


def _fields(head: dict[str, str], block: bytes) -> tuple:
    """The fields of _RECORD from head on."""
    text, payload = None, block
    kind = head.get("content-type", "")
    if kind.startswith("application/http"):
        message, _, payload = block.partition(b"\r\n\r\n")
        text = message.decode("iso-8859-1")
    elif kind == "application/warc-fields":
        text, payload = block.decode("utf-8", "replace"), b""
    return text, len(payload), hashlib.sha256(payload).hexdigest(), block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives (*.warc and *.warc.gz) in path."""
    ship(spark)
    kinds = {"block": pa.binary(), "payload_bytes": pa.int64()}
    schema = pa.schema([(f.name, kinds.get(f.name, pa.string())) for f in _RECORD.fields])
    named = ["warc-type", "warc-record-id", "warc-concurrent-to", "warc-target-uri", "warc-refers-to", "warc-payload-digest"]

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for head, block in _parse(content.as_py()):
                    rows.append((*map((head or {}).get, named), *_fields(head or {}, block)))
                    held += len(block)
                    if held > 1 << 24:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


def assemble(records: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One nested row a capture: request, response and metadata, joined through the identifiers they are concurrent to.

    A record that is concurrent to nothing stands for its capture; parts that are missing are null. Of several records
    of one kind in a capture that with the smallest record_id is taken. Parts have the named fields; others (as the
    blocks, where their digests will do) aren't shuffled.
    """
    kinds = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}
    fields = ("record_id", *[f for f in fields if f != "record_id"])
    of = lambda part: F.when(F.col("warc_type").isin(kinds[part]), F.col("record_id"))
    each = [F.min_by(f, of(part)).alias(f"{part}_{f}") for part in kinds for f in fields]
    parts = records.filter(F.col("warc_type").isin(*[k for types in kinds.values() for k in types]))
    rows = parts.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(*each)
    nested = lambda part: F.when(F.col(f"{part}_record_id").isNotNull(), F.struct(*[F.col(f"{part}_{f}").alias(f) for f in fields]))
    return rows.select("capture_id", *[nested(part).alias(part) for part in kinds])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return digests(assemble(read_records(spark, path), tuple(f for f in FIELDS if f != "block")))


def digests(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of assembled captures, archives of this
    module: a revisit's size and digest are those that its headers state."""
    own = F.col("response.warc_type") == "response"
    page_id = lambda text, pattern: F.regexp_extract(text, pattern, 1).try_cast("long")
    return captures.select(
        page_id("metadata.head", r"page-id: (-?\d*)").alias("page_id"),
        F.when(own, F.col("response.payload_bytes")).otherwise(F.regexp_extract("response.head", r"Content-Length: (\d+)", 1).try_cast("long")).alias("payload_bytes"),
        F.when(own, F.col("response.payload_sha256")).otherwise(F.replace(F.col("response.payload_digest"), F.lit("sha256:"), F.lit(""))).alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        page_id("response.refers_to", r"<urn:capture:(-?\d+)\.").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
     r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM r
"""
