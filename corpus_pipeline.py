"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage works on all that the one before it kept, as a written table. All but the last return the columns of docs,
extra ones too, whatever their names; n_chars follows the text where a stage changes it. Stages work on rows: where
documents go, rows are told apart by a number that is written with them, so that rows without doc_id and rows that share
one are each judged by themselves. Null, empty and very long texts and ties are what each stage says; an empty table
stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import bpe_roundtrip
from palimpsest.llm.common import broadcast_if_small, join_by_size, table, written
from palimpsest.llm.decontamination import decontaminate
from palimpsest.llm.line_dedup import line_dedup
from palimpsest.llm.ngram_join import jaccard_classes
from palimpsest.llm.quality_rules import quality_rules

#: The number of a row.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ROW, written: a number that isn't written could be another when it is read again."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (numbered) without the rows of the numbers in gone, and without the numbers."""
    return docs.join(broadcast_if_small(written(gone.select(ROW), "gone")), ROW, "left_anti").drop(ROW)


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator uses, and all of them in one, so that none bears the name of a result."""
    return docs.select(*used, F.struct(*docs.columns).alias("__whole"))


def _whole(done: DataFrame, docs: DataFrame, changed) -> DataFrame:
    """The columns of docs with the text of done; n_chars, if there is one, counts it anew where it has changed."""
    old = lambda c: F.col("__whole").getField(c)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(old("n_chars"))
    return done.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts are rejected; repeated rows are judged alike."""
    docs = _numbered(docs)
    return _without(docs, quality_rules(docs.select(ROW, "text", "lang", "source")).filter(~F.col("kept")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, from all but the first document that has them; a document of which nothing is left goes.
    Documents without doc_id keep their lines, and texts without lines to drop stay as they are, empty ones too."""
    done = line_dedup(_apart(docs, "doc_id", "text", "source")).filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _whole(done, docs, F.col("n_dropped") > 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that of the smallest doc_id, rows without one last; of several such
    rows any. Rows without words are in no class and stay."""
    docs = _numbered(docs)
    classes = jaccard_classes(docs.select(F.col(ROW).alias("doc_id"), "text")).filter("n_shingles > 0")
    classes = written(classes.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("component")), "rows")
    # rows of classes of their own need no doc_id
    several = classes.filter(F.col(ROW) != F.col("component")).select("component").distinct()
    several = written(join_by_size(classes, written(several.withColumn("several", F.lit(True)), "several"), "component", None, F.col(ROW)).filter("several"), "several")
    ids = docs.select(ROW, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW).alias("rank"))
    rows = written(ids.join(broadcast_if_small(several.select(ROW, "component")), ROW), "ranked")
    best = written(rows.groupBy("component").agg(F.min("rank").alias("best")), "best")
    gone = join_by_size(rows, best, "component", None, F.col(ROW)).filter(F.col(ROW) != F.col("best").getField(ROW))
    return _without(docs, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist of them for the most part go. Texts without hits, null and
    empty ones too, stay as they are."""
    done = decontaminate(_apart(docs, "text"), table(spark, sf_dir, "benchmark"))
    return _whole(done, docs, F.size("word_spans") > 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, packed as little-endian unsigned 32-bit integers, whose bytes decode to the text. Null
    texts count as empty, which have no tokens."""
    done = bpe_roundtrip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The robust outliers, the link classes and the byte-pair merges aren't for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
