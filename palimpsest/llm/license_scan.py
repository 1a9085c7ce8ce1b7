"""Operator 7: licence texts in documents, by winnowed fingerprints and banded alignment.

The templates are a stated, fixed set. Their K-word fingerprints, winnowed over WINDOW of them, stand in an inverted
index; a shared passage of WINDOW + K - 1 words always holds one. Fingerprints that a document shares with a template on
near diagonals make a candidate, for which the template is aligned with that part of the document in a band, by edit
distance. Candidates of which at least LEAST of the template's words are matched are reported, with the
share matched and the span; of overlapping ones that with most matched words stays. Elsewhere, passages of a template
with MATCHED matched words or more are reported likewise, by local alignment.

Templates under SHORT words are indexed by all pairs of words, and need one of the words that no other licence's
templates have, if there is one: other words of a notice can be replaced, but not the name of the licence.

Words are runs of ASCII letters and digits and of other characters above ASCII, in lower case. Nulls and empty texts
match nothing; very long texts are read whole. Repeated rows are scanned alike. Extra columns pass through unless they
are called matches. Of two templates that match equally many words of one passage the first counts. An empty table gives
an empty result. The given templates are licences' texts or the notices that refer to them; others can be passed.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ship, table
from palimpsest.llm.decontamination import WORD, words_of
from palimpsest.llm.license_templates import TEMPLATES

K, WINDOW = 3, 3
#: Share of a template's words that must be matched, and half the width of the band as a share of the template's words.
LEAST, BAND = 0.8, 0.15
#: Words of a passage that is reported though it is less than LEAST of the template; words from which one is winnowed.
MATCHED, SHORT = 20, 12

MATCH = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("matched", T.IntegerType()),
    ]
)


def winnow(hashes: list[int], window: int) -> set[int]:
    """Places of the rightmost least hash of every window."""
    if not hashes:
        return set()
    starts = range(max(1, len(hashes) - window + 1))
    return {min(range(s, min(s + window, len(hashes))), key=lambda i: (hashes[i], -i)) for s in starts}


class Templates:
    def __init__(self, templates: list[tuple[str, str]]) -> None:
        import xxhash

        self.names = [name for name, _ in templates]
        self.vocabulary: dict[bytes, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)] for _, text in templates]
        self.index: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            k = 2 if len(words) < SHORT else K
            grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            for i in range(len(grams)) if k < K else winnow([xxhash.xxh64_intdigest(repr(g)) for g in grams], WINDOW):
                self.index[grams[i]].append((t, i))
        others = [{w for name, words in zip(self.names, self.words, strict=True) if name != own for w in words} for own in self.names]
        self.naming = [sorted(set(words) - rest) if len(words) < SHORT else [] for words, rest in zip(self.words, others, strict=True)]

    def find(self, text: str | None) -> list[dict]:
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, itertools.repeat(-1)), np.int64, len(words))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            run = ids[a:b].tolist()
            for k in (2, K):
                for i in range(len(run) - k + 1):
                    for t, at in self.index.get(tuple(run[i : i + k]), ()):
                        hits[t].append((a + i - at, a + i))
        if not hits:
            return []
        found = [x for t, places in hits.items() for x in self._aligned(t, places, ids)]
        found.sort(key=lambda x: (x[2] < LEAST * len(self.words[x[3]]), -x[2], x[0], x[3]))
        kept: list[tuple] = []
        for x in found:
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        if not kept:
            return []
        spots = [m.span() for m in WORD.finditer(text)]
        return [
            {"license": self.names[t], "start": spots[a][0], "end": spots[b - 1][1], "coverage": n / len(self.words[t]), "matched": n} for a, b, n, t in sorted(kept)
        ]

    def _aligned(self, t: int, places: list[tuple[int, int]], ids: np.ndarray):
        """(start, end, matched words, template) of each cluster of diagonals of the template."""
        template = self.words[t]
        band = 2 + int(BAND * len(template))
        places.sort()
        cluster: list[int] = []
        for diagonal, _ in [*places, (1 << 60, 0)]:
            if cluster and diagonal - cluster[0] > band:
                done = align(template, ids, cluster[len(cluster) // 2], band)
                if done and done[2] >= LEAST * len(template):
                    if not self.naming[t] or np.isin(ids[done[0] : done[1]], self.naming[t]).any():
                        yield (*done, t)
                elif len(template) > MATCHED:
                    for part in passages(template, ids, cluster[len(cluster) // 2], band):
                        yield (*part, t)
                cluster = []
            cluster.append(diagonal)


def align(template: list[int], ids: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int] | None:
    """(start, end, matched words) of the alignment of the whole template to words of ids near the diagonal, by least
    edit distance and then most matches; the words before and after it are free."""
    low = max(0, diagonal - band)
    words = ids[low : diagonal + len(template) + band].tolist()
    n = len(words)
    # a cell is (edits, -matched, start); rows are the template's words, columns the document's
    off = diagonal - low
    row = {j: (0, 0, j) for j in range(max(0, off - band), min(n, off + band) + 1)}
    for i, w in enumerate(template, 1):
        new: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, off + i - band), min(n, off + i + band) + 1):
            best = None
            if (up := row.get(j)) is not None:
                best = (up[0] + 1, up[1], up[2])
            if j and (across := row.get(j - 1)) is not None:
                same = words[j - 1] == w
                cell = (across[0] + (not same), across[1] - same, across[2])
                best = cell if best is None or cell < best else best
            if (left := new.get(j - 1)) is not None:
                cell = (left[0] + 1, left[1], left[2])
                best = cell if best is None or cell < best else best
            if best is not None:
                new[j] = best
        row = new
    if not row:
        return None
    end, (_, matched, start) = min(row.items(), key=lambda x: (x[1], x[0]))
    return (low + start, low + end, -matched) if end > start else None


def passages(template: list[int], ids: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int, int]]:
    """(start, end, matched words) of the local alignments near the diagonal of MATCHED matched words or more, best first;
    a match counts 1, and an edit -1."""
    low = max(0, diagonal - band)
    words = ids[low : diagonal + len(template) + band].tolist()
    off, found = diagonal - low, []
    while True:
        # a cell is (score, matched, -start)
        best, row = (0, 0, 0, 0), {}
        for i, w in enumerate(template, 1):
            new: dict[int, tuple[int, int, int]] = {}
            for j in range(max(1, off + i - band), min(len(words), off + i + band) + 1):
                score, matched, start = row.get(j - 1, (0, 0, 1 - j))
                same = words[j - 1] == w
                cell = (score + 1, matched + 1, start) if same else (score - 1, matched, start)
                for near in (row.get(j), new.get(j - 1)):
                    if near is not None and (near[0] - 1, *near[1:]) > cell:
                        cell = (near[0] - 1, *near[1:])
                if cell[0] > 0:
                    new[j] = cell
                    if (*cell, -j) > best:
                        best = (*cell, -j)
            row = new
        if best[1] < MATCHED:
            return found
        start, end = -best[2], -best[3]
        found.append((low + start, low + end, best[1]))
        words[start:end] = [-2] * (end - start)


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text") -> DataFrame:
    """docs with matches, by start: array<struct<license, start, end, coverage, matched>>; code points, end exclusive."""
    ship(docs.sparkSession)
    docs = docs.drop("matches")
    schema = T.StructType([*docs.schema.fields, T.StructField("matches", T.ArrayType(MATCH))])
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64()), ("matched", pa.int32())]))

    def run(batches):
        known = Templates(templates)
        for batch in batches:
            found = [known.find(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "matches"])

    return docs.mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.transform("matches", span), ",").alias("spans"),
        F.array_max(F.transform("matches", lambda x: x["coverage"])).alias("coverage"),
    )
