"""Operator 9: rules of quality on statistics of a text, and robust multivariate outliers. DataFrame functions only.

Minimum-covariance-determinant estimates per language and source: from several starts, concentration steps take the
nearer half of a group's documents and compute their mean and covariance again until its determinant falls no more; the
start of the least determinant counts. From the documents near it by that estimate, the mean and the covariance are
computed once more (the usual reweighting), as half of a small group varies much by chance. A document is rejected if its statistics, transformed, are further away than
CUTOFF by the squared Mahalanobis distance. Documents of groups with too few are judged by the estimate over all
documents of their language, or over all there are. (outliers() by default takes a fixed number of steps from one start
on three quarters; quality_rules(), and so the query and the pipeline, takes the reweighted least determinant.)

Every statistic has a least scale, which bounds its variance below, so that a group in which it never varies still has
an invertible covariance.

Null and empty texts have no words, and fail the base rules; null languages and sources count as empty ones. Repeated
rows are judged alike and count as often as they come. Very long texts are read whole; the arrays of their words are the
largest things held. Extra columns pass through, but for the text and those that bear the name of a result. An empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import join_by_size, let, table, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Share of a group that the estimate rests on, concentration steps, and documents that a group needs.
SHARE, STEPS, LEAST = 0.75, 2, 60
#: 0.75 / P(chi2 with 6 df <= its 0.75 quantile with 4 df): makes the covariance of that share one of the whole.
CONSISTENCY = 1.486
#: The chi-squared quantile for 4 degrees of freedom at 0.9999.
CUTOFF = 23.51
#: Share of a group that the least-determinant estimate rests on, 0.5 / P(chi2 with 6 df <= its 0.5 quantile with 4 df),
#: and the part by which a determinant must fall to go on; below it are the errors of the approximate quantiles.
HALF, HALF_CONSISTENCY, FALLS = 0.5, 2.109, 1e-3
#: The chi-squared quantile for 4 degrees of freedom at 0.975, within which rows count again, and its consistency factor.
NEAR, NEAR_CONSISTENCY = 11.143, 1.0648
#: What distances are too large by in groups of n rows, times n: measured on normal rows, for either estimate.
HALF_SMALL, NEAR_SMALL = 9, 20
#: The transformed statistics, and the least scale of each.
FEATURES = {"x_length": 0.08, "x_symbols": 0.12, "x_lines": 0.12, "x_repeats": 0.12}
#: What text_statistics() adds.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SPACE = " \t\n\x0b\f\r"


def _n_repeat_words(words: Column) -> Column:
    """Words in WINDOW-word windows that come twice or more in the array."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
    places = lambda s: F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(same(s, i, i - 1) | same(s, i, i + 1), x["i"])), lambda p: p.isNotNull()))
    covered = lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda t, x: t + x)
    some = lambda h: let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(places(s), covered))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(count)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines and n_repeat_words, which take the place of
    columns of these names."""
    docs = docs.drop(*STATISTICS)
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(whole, F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _n_repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.withColumns(
        {
            "__w": of_words,
            "__l": of_lines,
            "word_chars": F.length(F.translate(whole, _SPACE, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        }
    ).select(*docs.columns, "__w.n_words", "word_chars", "n_symbols", "__l.n_lines", "__l.n_dup_lines", "__w.n_repeat_words")


def _features() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "x_length": F.log((F.col("word_chars") + 100) / (n + 20)),
        "x_symbols": F.sqrt(F.col("n_symbols") / (n + 20)),
        "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 2)),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / (n + 40)),
    }


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _distance(params: str) -> Column:
    """The squared Mahalanobis distance of a row, by forward substitution in the Cholesky factor held in params."""
    solved: list[Column] = []
    for i, x in enumerate(FEATURES):
        rest = [F.col(f"{params}.l{i}{j}") * solved[j] for j in range(i)]
        solved.append((F.col(x) - F.col(f"{params}.m{i}") - (_sum(rest) if rest else F.lit(0.0))) / F.col(f"{params}.l{i}{i}"))
    return _sum([y * y for y in solved])


def _moments(rows: DataFrame, factor: float | None = None) -> DataFrame:
    """grp, n (rows) and est: the mean and the Cholesky factor of the covariance of each group.

    The squares of the least scales are added to the variances; with a factor, they are lower bounds of the variances,
    given the statistics before, of the covariance times the factor."""
    names = list(FEATURES)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(names)], *[F.avg(F.col(names[i]) * F.col(names[j])).alias(f"s{i}{j}") for i, j in pairs])
    for i, j in pairs:
        floor = FEATURES[names[i]] ** 2 if i == j else 0.0
        cov = F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        # rounding can leave a variance just below zero
        cov = F.greatest(cov, F.lit(0.0)) if i == j else cov
        sums = sums.withColumn(f"c{i}{j}", cov + floor if factor is None else cov * factor)
    for i, j in pairs:
        rest = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
        value = F.col(f"c{i}{j}") - (_sum(rest) if rest else F.lit(0.0))
        sums = sums.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-9 if factor is None else FEATURES[names[i]] ** 2))) if i == j else value / F.col(f"l{j}{j}"))
    return sums.select("grp", "n", F.struct(*[f"m{i}" for i in range(len(names))], *[f"l{i}{j}" for i, j in pairs]).alias("est"))


def _grouped(rows: DataFrame) -> DataFrame:
    """rows with grp, the level that judges a row: its language and source, its language, or all rows; and levels, those
    of the three that judge any row. A level's estimate is over every row of the level, whatever judges that row."""
    lang = F.coalesce("lang", F.lit(""))
    # prefixes keep the levels apart
    key = F.concat(F.lit("s"), F.concat_ws("\x1f", lang, F.coalesce("source", F.lit(""))))
    n = rows.groupBy(F.concat(F.lit("l"), lang).alias("lang_"), key.alias("key_")).agg(F.count(F.lit(1)).alias("n"))
    by_lang = n.groupBy("lang_").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least_"))
    whole = by_lang.agg(F.min("n_lang").alias("least_lang"))
    own, of_lang = F.col("n") >= LEAST, F.col("n_lang") >= LEAST
    grp = F.when(own, F.col("key_")).when(of_lang, F.col("lang_")).otherwise(F.lit("a"))
    judging = [F.when(own, F.col("key_")), F.when(of_lang & (F.col("least_") < LEAST), F.col("lang_")), F.when(F.col("least_lang") < LEAST, F.lit("a"))]
    groups = n.join(by_lang, "lang_").crossJoin(F.broadcast(whole)).select("key_", "n", grp.alias("grp"), F.array_compact(F.array(*judging)).alias("levels"))
    return join_by_size(rows.withColumn("key_", key), written(groups, "groups"), "key_", "n", _spread()).drop("key_")


def _two_steps(members: DataFrame) -> DataFrame:
    """grp, n and est after STEPS concentration steps on SHARE of a group, from its medians and quartiles."""
    names, size = list(FEATURES), F.count(F.lit(1)).alias("n")
    quartiles = members.groupBy("grp").agg(size, *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(x) for x in names])
    start = [F.col(x)[1].alias(f"m{i}") for i, x in enumerate(names)]
    for i, x in enumerate(names):
        scale = F.sqrt(F.pow((F.col(x)[2] - F.col(x)[0]) / 1.349, 2) + FEATURES[x] ** 2)
        start += [(scale if i == j else F.lit(0.0)).alias(f"l{i}{j}") for j in range(i + 1)]
    est = written(quartiles.select("grp", "n", F.struct(*start).alias("est")), "estimate")
    for _ in range(STEPS):
        near = _with_values(members, est).withColumn("d", _distance("est"))
        limit = written(near.groupBy("grp").agg(size, F.percentile_approx("d", SHARE, 1000).alias("limit")), "limit")
        est = written(_moments(_with_values(near.drop("est"), limit).filter("d <= limit")), "estimate")
    return est


def least_determinant(members: DataFrame) -> DataFrame:
    """grp, n and est: the minimum-covariance-determinant estimate on HALF of a group.

    The starts are the three quartiles, with the quartiles' scales, and the moments of all rows. From each, concentration
    steps go on until the determinant falls no more; the start of the least determinant stays."""
    names, size = list(FEATURES), F.count(F.lit(1)).alias("n")
    quartiles = members.groupBy("grp").agg(size, *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(x) for x in names])
    scales = [F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(FEATURES[x])) for x in names]
    factor = [(scales[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(len(names)) for j in range(i + 1)]
    centred = lambda q: F.struct(*[F.col(x)[q].alias(f"m{i}") for i, x in enumerate(names)], *factor)
    starts = quartiles.select("grp", "n", F.posexplode(F.array(*[centred(q) for q in range(3)])).alias("start", "est"))
    starts = starts.unionByName(_moments(members, 1.0).withColumn("start", F.lit(3)))
    # a candidate is a group and a start; from here on it takes the place of the group
    candidate = lambda df: df.withColumn("of", F.col("grp")).withColumn("grp", F.concat_ws("\x1e", "grp", F.col("start").cast("string")))
    going = written(candidate(starts).select("of", "grp", "n", "est", F.lit(float("inf")).alias("det")), "candidates")
    rows = written(candidate(members.withColumn("start", F.explode(F.array(*map(F.lit, range(4)))))).drop("start", "of"), "members")
    ended = [going.filter("false").select("of", "n", "det", "est")]
    while not going.isEmpty():
        near = _with_values(rows, going.select("grp", "n", "est")).filter("est IS NOT NULL").withColumn("d", _distance("est")).drop("est")
        near = written(near, "distances")
        limit = written(near.groupBy("grp").agg(size, F.percentile_approx("d", HALF, 1000).alias("limit")), "limit")
        done = _moments(_with_values(near, limit).filter("d <= limit"), HALF_CONSISTENCY).drop("n")
        det = reduce(lambda a, b: a * b, [F.pow(F.col(f"new.l{i}{i}"), 2) for i in range(len(names))])
        step = going.join(done.withColumnRenamed("est", "new"), "grp").withColumn("new_det", det).withColumn("falls", F.col("new_det") < F.col("det") * (1 - FALLS))
        step = written(step, "step")
        ended.append(step.filter("NOT falls").select("of", "n", "det", "est"))
        going = step.filter("falls").select("of", "grp", "n", F.col("new").alias("est"), F.col("new_det").alias("det"))
    return written(reduce(DataFrame.unionByName, ended).groupBy(F.col("of").alias("grp")).agg(F.min_by(F.struct("n", "est"), "det").alias("v")).select("grp", "v.n", "v.est"), "estimate")


def reweighted(members: DataFrame) -> DataFrame:
    """grp, n and est: the mean and covariance of the rows that are near by the least-determinant estimate."""
    raw = least_determinant(members)
    rows = _with_values(members, raw.select("grp", "n", F.struct("est", "n").alias("by")))
    near = rows.withColumn("est", F.col("by.est")).filter(_distance("est") <= NEAR * (1 + HALF_SMALL / F.col("by.n")))
    done = _moments(near.select("grp", *FEATURES), NEAR_CONSISTENCY).drop("n").join(raw.select("grp", "n"), "grp")
    grown = F.sqrt(1 + NEAR_SMALL / F.col("n"))
    scale = [(F.col(f"est.{c}") * (grown if c.startswith("l") else 1)).alias(c) for c in done.schema["est"].dataType.fieldNames()]
    return written(done.select("grp", "n", F.struct(*scale).alias("est")), "estimate")


def _with_values(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows with the values of their grp."""
    return join_by_size(rows, values, "grp", "n", _spread())


def _spread() -> Column:
    """What deals out rows, of written tables: their places, as equal rows have equal values."""
    return F.monotonically_increasing_id()


def outliers(rows: DataFrame, cutoff: float = CUTOFF, estimate=_two_steps, consistency: float = CONSISTENCY) -> DataFrame:
    """rows (statistics with lang and source) with distance, and outlier (distance > cutoff).

    estimate gives the means and Cholesky factors, by whose distances divided by consistency rows are judged."""
    keep = [c for c in rows.columns if c not in ("distance", "outlier")]
    # what a row came with stays apart, whatever the names of its columns
    rows = rows.select(F.struct(*keep).alias("row_"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), *[x.alias(name) for name, x in _features().items()])
    rows = written(_grouped(written(rows, "features")), "grouped")
    est = estimate(rows.select(F.explode("levels").alias("grp"), *FEATURES))
    judged = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    est = written(judged.join(est.drop("n"), "grp"), "judging")
    rows = join_by_size(rows, est, "grp", "n", _spread()).withColumn("distance", _distance("est") / consistency)
    return rows.withColumn("outlier", F.col("distance") > cutoff).select(*[F.col("row_").getField(c).alias(c) for c in keep], "distance", "outlier")


def _with_base(docs: DataFrame) -> DataFrame:
    rows = text_statistics(docs.drop("base_failed", "distance", "outlier", "kept")).drop("text")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs without the text, with the statistics, base_failed, distance and kept."""
    rows = written(_with_base(docs), "statistics")
    judged = outliers(rows.filter(~F.col("base_failed")), CUTOFF, reweighted, 1.0).withColumn("kept", ~F.col("outlier"))
    failed = rows.filter("base_failed").withColumns({"distance": F.lit(None).cast("double"), "kept": F.lit(False)})
    return judged.drop("outlier").unionByName(failed)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


BASE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_quality_rules but for the verdict, which SQL can express."""
    return _with_base(table(spark, sf_dir, "documents").select("doc_id", "text")).select(BASE_COLUMNS)


BASE_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    grams AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 0) + 1)) AS i FROM d)),
    twice AS (SELECT doc_id, i FROM grams JOIN (SELECT doc_id, g FROM grams GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
    covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
    s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
"""
