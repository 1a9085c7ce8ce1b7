"""Operator 1: documents linked by the Jaccard similarity of their word shingles, and the classes that links form.

Prefix filtering: a document's shingles are put in one global order, rare ones first, and of n of them only the first
n - ceil(0.75 n) + 1 are indexed; two documents that link share one of these. The order follows the counts of all
documents' shingles in 2**SKETCH_BITS buckets by hash, so what the workers are sent has a fixed size; any order gives
the same links. Pairs of one indexed shingle pass the length filter and the positional filter, then, once for each
pair, the suffix filter (a bound on the overlap by counts in parts of the hash range), and are verified.

Links are needed for classes only, so pairs within a class already known are left out, which keeps large groups of
near copies from being compared pair by pair:
1. documents with the same set are one node, for which the smallest doc_id stands;
2. in each indexed shingle's rows, the node in which fewest rarer shingles come first is the pivot; every node is
   verified against the pivot with which it shares most;
3. in the rows of each shingle that still span classes, nodes outside the largest class are paired with all nodes of
   other classes. That is exact: every link has both ends in one class in the end.

No shingle, document or class meets in one task: rows of frequent shingles are taken as shared without being brought
together, the pairs of a shingle with many rows are made block by block of both sides, the pairs of a document with many
partners are dealt over blocks to each of which its text is sent once, and joins on classes split the large ones.

Words are lower-cased (A-Z) and parted by ASCII white space; shingles are told apart by 64-bit hashes, sets by 128 bits
and, before they link, by their shingles. A document of fewer than SHINGLE words has one shingle, all of its words.
Null and empty texts have none, and no links. Rows that share a doc_id are one document; a row without doc_id takes
part in no link and has no component. Very long texts are read whole. Other columns than doc_id and text aren't used
and aren't returned. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import broadcast_if_small, join_by_size, join_unevenly, ship, table, written

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
SKETCH_BITS = 18
#: Sets whose rows a worker has just made: copies close to each other are indexed once.
REMEMBERED = 100_000
#: A bucket is hot if it has more than this share of the documents and this many times the mean of buckets.
HOT_SHARE, HOT_TIMES = 0.01, 4
#: Rows of a shingle on a side of a block of pairs, and pairs of a document that meet.
BLOCK, MET = 500, 250
#: Parts of the hash range in the suffix filter, at least and at most; between, one for each IN_PART shingles: with many
#: more in a part, chance alone makes the counts of long texts alike.
PARTS, IN_PART = (256, 1 << 14), 5

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        mixed = sum(hashes[i : i + n] * _MIX[i] for i in range(SHINGLE))
    elif len(words):
        mixed = np.array([(hashes * _MIX[: len(words)]).sum() + np.uint64(len(words))], np.uint64)
    else:
        return hashes
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[1]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _identity(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _sets(docs: DataFrame) -> DataFrame:
    """A row (doc_id, n_shingles, sig, node) for each document, and rows (bucket, n) of shingle counts."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            sigs = [_identity(x) if len(x) else None for x in found]
            if found and sum(map(len, found)):
                counts += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            nodes = [None if s is None else int.from_bytes(s[:8], "little", signed=True) for s in sigs]
            none = pa.nulls(len(found), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, found), pa.int64()), pa.array(sigs, pa.binary()), pa.array(nodes, pa.int64()), none, none.cast(pa.int64())],
                names=["doc_id", "n_shingles", "sig", "node", "bucket", "n"],
            )
        used = np.flatnonzero(counts)
        for part in np.array_split(used, 1 + len(used) // 50_000):
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(part), pa.binary()), none, pa.array(part, pa.int32()), pa.array(counts[part])], names=["doc_id", "n_shingles", "sig", "node", "bucket", "n"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig binary, node long, bucket int, n long")


def _index(docs: DataFrame, counts: np.ndarray, often: float) -> DataFrame:
    """(token, node, size, pos, hot) of the indexed shingles; node stands for a set, and may come more than once. Hot are
    the shingles of buckets with a count of more than `often`."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        rank = sent.value
        seen: set[bytes] = set()
        for batch in batches:
            tokens, nodes, sizes, places, hot = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text)
                n = len(found)
                if not n or (sig := _identity(found)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(sig)
                prefix = n - (PERCENT * n + 99) // 100 + 1
                of = rank[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((found, of))[:prefix]
                tokens.append(found[order])
                nodes.append(np.full(prefix, int.from_bytes(sig[:8], "little", signed=True), np.int64))
                sizes.append(np.full(prefix, n, np.int32))
                places.append(np.arange(prefix, dtype=np.int32))
                hot.append(of[order] > often)
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (nodes, sizes, places, hot))], names=["token", "node", "size", "pos", "hot"]
                )

    return docs.mapInArrow(run, "token long, node long, size int, pos int, hot boolean")


def _may_link(a: str, b: str) -> Column:
    """The length filter and the positional filter, at the first shingle that both have in common."""
    sa, sb = F.col(f"{a}.size"), F.col(f"{b}.size")
    least = F.ceil((sa + sb) * PERCENT / (100 + PERCENT))
    most = 1 + F.least(sa - F.col(f"{a}.pos"), sb - F.col(f"{b}.pos")) - 1
    return (100 * F.least(sa, sb) >= PERCENT * F.greatest(sa, sb)) & (most >= least)


def _parts(found: np.ndarray) -> bytes:
    """Counts of shingles in equal parts of the hash range, as 16-bit integers; empty if they are too large for that."""
    bits = min(max(len(found) // IN_PART, PARTS[0]), PARTS[1]).bit_length() - 1
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint16).tobytes() if counts.max() < 1 << 16 else b""


def _may_overlap(x: bytes, y: bytes) -> bool:
    """The suffix filter: whether the counts leave room for the overlap of a link."""
    if not x or not y:
        return True
    a, b = (np.frombuffer(v, np.uint16).astype(np.int64) for v in (x, y))
    n = min(len(a), len(b))
    a, b = a.reshape(n, -1).sum(1), b.reshape(n, -1).sum(1)
    return (100 + PERCENT) * int(np.minimum(a, b).sum()) >= PERCENT * int(a.sum() + b.sum())


def _dealt(pairs: DataFrame, texts: DataFrame, end: str, by: str) -> tuple[DataFrame, DataFrame]:
    """pairs with {end}_block, and (end, {end}_block, text): the text of an end for each of its blocks, which have MET of
    its pairs or so."""
    name, blocks = f"{end}_block", F.coalesce("blocks", F.lit(1))
    many = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > MET).select(end, F.ceil(F.col("k") / MET).cast("int").alias("blocks"))
    many = written(many, "many")
    pairs = join_by_size(pairs, many, end, None, F.col(by)).withColumn(name, F.pmod(F.hash(by), blocks)).drop("blocks")
    copies = texts.select(F.col("doc_id").alias(end), "text").join(broadcast_if_small(many), end, "left")
    return pairs, copies.select(end, F.explode(F.sequence(F.lit(0), blocks - 1)).alias(name), "text")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table of doc_ids, that link: the suffix filter, then the shingles themselves. a should
    be the end that has more pairs."""
    needed = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "needed")

    def summarise(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_parts(shingles(t)) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "text", "parts"])

    texts = written(docs.select("doc_id", "text").join(broadcast_if_small(needed), "doc_id", "left_semi").mapInArrow(summarise, "doc_id long, text string, parts binary"), "texts")
    # rows that share a doc_id are one document, which links by any of its texts
    once = texts.count() == needed.count()
    parts = texts.select("doc_id", F.array("parts").alias("parts")) if once else written(texts.groupBy("doc_id").agg(F.collect_set("parts").alias("parts")), "parts")

    def suffixes(batches):
        for batch in batches:
            both = zip(*(batch.column(c).to_pylist() for c in ("parts_a", "parts_b")), strict=True)
            keep = [any(_may_overlap(x, y) for x in a for y in b) for a, b in both]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def exact(batches):
        hub, held, sets = None, [], []
        for batch in batches:
            found = ([], [])
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                if b is None:  # a text of the document whose partners follow
                    if a != hub:
                        hub, held, sets = a, [], []
                    if text not in held:
                        held.append(text)
                    continue
                sets = sets if len(sets) == len(held) else [shingles(t) for t in held]
                other = shingles(text)
                both = (len(np.intersect1d(s, other, assume_unique=True)) for s in sets)
                if any(100 * n >= PERCENT * (len(s) + len(other) - n) for n, s in zip(both, sets, strict=True)):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    both = join_unevenly(pairs.select("a", "b"), parts.select(F.col("doc_id").alias("a"), F.col("parts").alias("parts_a")), "a", None, F.col("b"))
    both = join_unevenly(both, parts.select(F.col("doc_id").alias("b"), F.col("parts").alias("parts_b")), "b", None, F.col("a"))
    left = written(both.mapInArrow(suffixes, "a long, b long"), "suffixes")

    of = lambda end: texts.join(broadcast_if_small(written(left.select(F.col(end).alias("doc_id")).distinct(), "ends")), "doc_id", "left_semi")
    dealt, others = _dealt(left, of("b"), "b", "a")
    dealt, hubs = _dealt(dealt, of("a"), "a", "b")
    others = dealt.join(others, ["b", "b_block"]).select("a", "a_block", "b", "text")
    rows = others.unionByName(hubs.withColumn("b", F.lit(None).cast("long")))
    rows = rows.repartition("a", "a_block").sortWithinPartitions("a", "a_block", F.asc_nulls_first("b"))
    return written(rows.select("a", "b", "text").mapInArrow(exact, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each end of a link (a, b), the smallest id that links reach. Contracts the graph until no
    link is left; each round at least halves the nodes of a class."""
    labels = None
    while True:
        both = links.select("a", "b").union(links.select("b", "a"))
        parent = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        # in all of these joins few parents may stand for most nodes
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = written(join_by_size(parent, up, "p", None, F.col("a")).select("a", F.coalesce("pp", "p").alias("p")), "parents")
        if labels is None:
            labels = parent.select(F.col("a").alias("id"), F.col("p").alias("component"))
        else:
            up = parent.withColumnRenamed("a", "component")
            labels = written(join_by_size(labels, up, "component", None, F.col("id")).select("id", F.coalesce("p", "component").alias("component")), "labels")
        ends = join_by_size(links, parent.withColumnRenamed("p", "pa"), "a", None, F.col("b"))
        ends = join_by_size(ends, parent.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b", None, F.col("a"))
        links = written(ends.filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "contracted")
        if links.isEmpty():
            return labels


def _first(groups: DataFrame, index: DataFrame) -> DataFrame:
    """The indexed rows of shingles that several nodes share: (token, id, size, pos), id the node's smallest doc_id. Hot
    shingles are taken as shared, and their rows dealt out."""
    same = W.partitionBy("token", "deal")
    dealt = index.withColumn("deal", F.when(F.col("hot"), F.xxhash64("node")))
    shared = dealt.withColumns({"lo": F.min("node").over(same), "hi": F.max("node").over(same)}).filter("hot OR lo <> hi").select("token", "deal", "node", "size", "pos").distinct()
    return written(shared.join(groups.select("node", F.col("first").alias("id")), "node").select("token", "id", "size", "pos"), "shared")


def _star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each node b with the pivot a with which it shares most indexed shingles; a pair comes once."""
    nearness = F.shiftleft(F.col("pos").cast("long"), 32) + F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    pivots = shared.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", nearness).alias("pivot"), F.min_by("size", nearness).alias("psize"), F.min_by("pos", nearness).alias("ppos"))
    pairs = join_unevenly(shared, written(pivots.filter("n > 1"), "pivots"), "token", "n", F.col("id")).filter("id <> pivot")
    pairs = pairs.select(F.struct("size", "pos").alias("x"), F.struct(F.col("psize").alias("size"), F.col("ppos").alias("pos")).alias("y"), "id", "pivot").filter(_may_link("x", "y"))
    votes = pairs.groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.max_by("pivot", F.shiftleft("n", 32) + F.pmod(F.xxhash64("pivot"), F.lit(1 << 32))).alias("pivot"))
    once = best.groupBy(F.least("id", "pivot").alias("lo"), F.greatest("id", "pivot").alias("hi")).agg(F.min("pivot").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def _crossing_pairs(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of a shingle's nodes in different classes."""
    rows = shared.join(broadcast_if_small(labels), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    classes = rows.groupBy("token", "class").agg(F.count(F.lit(1)).alias("n"))
    mixed = classes.groupBy("token").agg(F.max_by("class", F.shiftleft("n", 32) + F.pmod(F.xxhash64("class"), F.lit(1 << 32))).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    mixed = written(mixed.filter("k > 1").select("token", "main", blocks), "spanning")
    mixed = written(join_unevenly(rows, mixed, "token", None, F.col("id")).filter("main IS NOT NULL"), "mixed")
    # block i of the rows outside meets block j of all, for every i and j
    own, each = F.pmod(F.hash("id"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    row = ["token", "id", "size", "pos", "class"]
    x = mixed.filter(F.col("class") != F.col("main")).select(*row, own.alias("i"), each.alias("j")).alias("x")
    y = mixed.select(*row, own.alias("j"), each.alias("i")).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("token", "i", "j")]
    pairs = x.join(y, same[0] & same[1] & same[2] & (F.col("x.class") != F.col("y.class")) & _may_link("x", "y"))
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(_sets(docs), "sets")
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in sets.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"]] = min(r["n"], 0xFFFFFFFF)
    rows = sets.filter("bucket IS NULL").select("doc_id", "n_shingles", "sig", "node")
    groups = written(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig", "node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    often = max(HOT_SHARE * rows.count(), HOT_TIMES * float(counts.mean()))

    shared = _first(groups, _index(docs, counts, often))
    tried = written(_star_pairs(shared), "pairs")
    links = _verified(tried, docs)
    labels = written(components(links), "classes")
    # those of the stars that cross classes are known not to link
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossing = _crossing_pairs(shared, labels).join(broadcast_if_small(tried), ["a", "b"], "left_anti")
    crossing = _verified(written(crossing, "pairs"), docs)
    if not crossing.isEmpty():
        labels = written(components(links.union(crossing)), "classes")

    known = groups.join(broadcast_if_small(labels), F.col("first") == F.col("id"), "left").withColumn("component", F.coalesce("component", "first"))
    known = known.filter((F.col("n") > 1) | (F.col("component") != F.col("first"))).select("sig", "n", "component")
    linked = join_unevenly(rows.filter("n_shingles > 0"), written(known, "known"), "sig", "n", F.col("doc_id"))
    alone = rows.filter("n_shingles = 0").withColumn("component", F.lit(None).cast("long"))
    done = linked.unionByName(alone)
    return done.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    c AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
