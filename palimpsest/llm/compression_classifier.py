"""Operator 6: text quality by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from texts labelled good and bad. A text is compressed in pieces with either; the
difference of the sizes over their sum, which is above 0 for a text nearer to the good ones, becomes a score by
logistic calibration on labelled texts that the dictionaries have not seen.

Labels are read from the rows that fit() is given, of which it takes a bounded sample: fit_docs documents a class for
the dictionaries and as many for the calibration, in the order of a hash of the doc_id, and of these `pieces` pieces a
class. Scoring reads whole texts, very long ones piece by piece.

Null and empty texts are scored as empty ones: nothing tells them apart but their length, and the calibration is fed
with the empty texts among the labelled ones. Without labels of both classes every score is 0.5. Repeated
rows are scored alike, and a document whose labels differ counts for both; of rows that share a labelled doc_id as many
are used as the sample holds. A score of just 0.5 predicts 1. Extra columns pass through unless they bear the name of a
result. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ship, table

FIT_DOCS, PIECES = 6000, 4000
#: Characters of a piece for fitting, bytes of one for scoring, bytes of a dictionary, and zstandard's level.
FIT_CHARS, PIECE_BYTES, DICT_BYTES, LEVEL = 2000, 4096, 112_640, 3


class Model:
    """The dictionaries (good, bad) and the calibration: score = 1 / (1 + exp(-weights . (1, x...)))."""

    def __init__(self, dictionaries: tuple[bytes, bytes], weights: list[float] | None = None) -> None:
        self.dictionaries, self.weights = dictionaries, weights or [0.0] * 3


@functools.lru_cache(maxsize=2)
def _compressors(dictionaries: tuple[bytes, bytes]):
    import zstandard

    made = []
    for raw in dictionaries:
        held = zstandard.ZstdCompressionDict(raw)
        held.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def features(text: str | None, dictionaries: tuple[bytes, bytes]) -> tuple[float, float]:
    """The normalised difference of the compressed sizes, and how far the good dictionary compresses the text."""
    raw = (text or "").encode()
    good, bad = (sum(len(c.compress(raw[i : i + PIECE_BYTES])) for i in range(0, len(raw), PIECE_BYTES)) for c in _compressors(dictionaries))
    return (bad - good) / max(1, bad + good), good / (len(raw) + 20)


def _train(pieces: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, pieces)) // 4)), pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"".join(pieces)[-DICT_BYTES:] or b"\n"


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights by Newton's method, with a slight pull towards 0."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (y - p) - 0.1 * w)
    return [float(w[0] - (w[1:] * mean / scale).sum()), *(w[1:] / scale).tolist()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_docs: int = FIT_DOCS, pieces: int = PIECES) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id and a label of 0 or 1); None without both classes."""
    ship(docs.sparkSession)
    of_hash = F.xxhash64(F.lit("fit"), "doc_id")
    classes = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").distinct()
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    parts = [classes.filter((F.col("y") == y) & (half == h)).withColumn("half", F.lit(h)).orderBy(of_hash, "doc_id").limit(fit_docs) for y in (0, 1) for h in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # at most 4 * fit_docs rows of two integers
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(FIT_CHARS)))
    cut = texts.filter("half = 0 AND text <> ''").select("y", "text", start.alias("at")).select("y", F.expr(f"substring(text, at, {FIT_CHARS})").alias("piece"))
    by_class = {y: [r["piece"].encode() for r in cut.filter(F.col("y") == y).orderBy(F.xxhash64("piece"), "piece").limit(pieces).collect()] for y in (0, 1)}
    if not by_class[0] or not by_class[1]:
        return None
    model = Model((_train(by_class[1]), _train(by_class[0])))
    half = texts.filter("half = 1").select("y", "text")
    rows = [r for y in (0, 1) for r in _measured(half.filter(F.col("y") == y).orderBy(F.xxhash64("text"), "text").limit(fit_docs), model).select("y", F.col("__x").alias("x")).collect()]
    x, y = np.array([r["x"] for r in rows]).reshape(-1, 2), np.array([r["y"] for r in rows], float)
    if 0 < y.sum() < len(y):
        model.weights = _logistic(x, y)
    return model


def _measured(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField("__x", T.ArrayType(T.DoubleType()))])
    dictionaries = docs.sparkSession.sparkContext.broadcast(model.dictionaries)

    def run(batches):
        for batch in batches:
            x = [features(t, dictionaries.value) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], names=[*batch.schema.names, "__x"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score (0 to 1, higher: the label 1 is likelier) and predicted (1 from 0.5 on)."""
    docs = docs.drop("score", "predicted")
    ship(docs.sparkSession)
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})
    w = model.weights
    out = _measured(docs, model).withColumn("score", 1 / (1 + F.exp(-(F.lit(w[0]) + w[1] * F.col("__x")[0] + w[2] * F.col("__x")[1]))))
    return out.drop("__x").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder != 1)
    done = score(docs, fit(docs, labels))
    return done.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")
