"""Operator 4: removal of lines that stand on many sites. DataFrame functions only.

A line counts by its text without surrounding white space, if it has a word. HyperLogLog sketches of the sites of each
line merge by aggregation. Where an estimate is near the threshold, the distinct sites are counted exactly. A line on
min_sites sites or more is boilerplate, a line of under min_words words only from SHORT times as many on, as short lines
of prose (a greeting, a heading) come again on many sites by themselves. Boilerplate stays in the document of the
smallest doc_id that has it, and goes from every other one, so that no text is lost altogether.

Lines are told apart by 64-bit hashes: for a wrong removal a line has to collide with a boilerplate line, of which
there are few. Nulls: a null text stays null and has no lines, a null source is no site, a document without doc_id
keeps its lines. Repeated rows of a doc_id are one document and treated alike. The work on a text grows with its length
alone, whatever goes from it. Extra columns pass through unless they bear the name of a result. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import join_by_size, let, table, written

#: Sites that make a line boilerplate, if it has so many words; a shorter line needs SHORT times as many sites.
MIN_SITES, MIN_WORDS, SHORT = 8, 4, 2
#: The sketch has 2**LG_K registers; its relative standard error is 1.04 / sqrt(2**LG_K).
LG_K = 12
_SPACE = " \t\n\x0b\f\r"


def _line_key(line: Column, min_words: int) -> Column:
    """The hash of a line with a word, even for one of min_words words or more and odd for a shorter one; else null."""
    bare = F.btrim(line, F.lit(_SPACE))
    long = F.size(F.split(bare, r"[\x20\x09-\x0D]+", min_words)) >= min_words
    return F.when(bare != "", F.shiftleft(F.xxhash64(bare), 1) + F.when(long, 0).otherwise(1))


def _keys(text: Column, min_words: int) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: _line_key(x, min_words))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """(line, first, n, n_sites) of every line on min_sites sites or more (a short line: on SHORT times as many);
    first is the smallest doc_id that has it."""
    lines = written(
        docs.select("doc_id", F.xxhash64(F.col(site).cast("string")).alias("site"), F.col(site).isNotNull().alias("sited"), F.explode(F.array_distinct(_keys(F.col("text"), min_words))).alias("line")).filter("line IS NOT NULL"),
        "lines",
    )
    least = F.when(F.col("line").bitwiseAND(F.lit(1).cast("long")) == 0, min_sites).otherwise(SHORT * min_sites)
    # a line with fewer rows than that, or on one site, needs no sketch
    common = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.min("site").alias("a"), F.max("site").alias("b"))
    common = written(common.filter((F.col("n") >= least) & ((F.col("a") != F.col("b")) | F.lit(min_sites <= 1))).select("line", "n", "first"), "common")
    among = lambda some: join_by_size(lines.filter("sited"), some.select("line", "n", F.lit(True).alias("among")), "line", "n", F.col("doc_id")).filter("among")
    guess = among(common).groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n_sites"))
    guess = written(common.select("line", "n").join(guess, "line"), "sketched")
    near = F.abs(F.col("n_sites") - least) <= F.greatest(F.lit(1.0), 4 * 1.04 / 2 ** (LG_K / 2) * least)
    exact = among(guess.filter(near)).select("line", "site").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n_sites"))
    sites = guess.filter(~near).select("line", "n_sites").unionByName(exact).filter(F.col("n_sites") >= least)
    return common.join(sites, "line")


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with boilerplate lines taken out of text, with n_lines (before) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    spread = written(boilerplate(docs, site, min_sites, min_words).select("line", "n", "first"), "spread")
    # rows of one doc_id may differ in their texts, where places mean other lines
    whose = ["__doc", "__text"]
    docs = docs.withColumns({"__doc": F.col("doc_id"), "__text": F.xxhash64("text")})
    lines = docs.filter("doc_id IS NOT NULL").select(*whose, F.posexplode(_keys(F.col("text"), min_words)).alias("place", "line")).filter("line IS NOT NULL")
    drops = join_by_size(lines, spread, "line", "n", F.hash("__doc", "place")).filter(F.col("__doc") != F.col("first"))
    drops = drops.groupBy(*whose).agg(F.collect_set("place").alias("__drop"))
    lines = F.split("text", "\n")
    # both by hashing, so that many lines with many to drop are no more work for each
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    some = F.col("__drop").isNotNull()
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = docs.join(drops, whose, "left").withColumns(
        {
            "__kept": F.when(some, let(lines, lambda x: F.array_join(F.transform(kept, lambda i: F.get(x, i)), "\n"))).otherwise(F.col("text")),
            "n_lines": n_lines,
            "n_dropped": F.when(some, F.size("__drop")).otherwise(0).cast("long"),
        }
    )
    return out.select(*[F.col("__kept").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in whose], "n_lines", "n_dropped")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


_BARE = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
#: A table expression of cleaned documents, from those of the table or expression {docs}.
CLEANED_SQL = f"""
    lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {{docs}}),
    bared AS (SELECT *, {_BARE} AS bare FROM lines),
    keyed AS (SELECT *, len(regexp_extract_all(bare, '[^\\x20\\x09-\\x0D]+')) AS n_words FROM bared),
    spread AS (SELECT bare, min(doc_id) AS first FROM keyed WHERE n_words > 0 GROUP BY bare HAVING count(DISTINCT source) >= CASE WHEN any_value(n_words) >= {MIN_WORDS} THEN {MIN_SITES} ELSE {SHORT * MIN_SITES} END),
    marked AS (SELECT k.*, s.first IS NOT NULL AND s.first <> k.doc_id AS gone FROM keyed k LEFT JOIN spread s ON k.n_words > 0 AND k.bare = s.bare),
    cleaned AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
"""
ORACLE = f"""
WITH {CLEANED_SQL.format(docs="documents")}
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped, sha256(coalesce(c.text, '')) AS text_sha256
FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""
