"""Operator 2: secrets in texts, by patterns and by a battery of randomness tests. DataFrame functions only.

Patterns give spans of the kinds assign, access and hex. Besides, every run of 20 or more characters of a base-64
alphabet, of which one is a letter or digit, is tested: its encoding is inferred, the one of the least alphabet that
holds its characters (decimal, hex of one case or mixed, single-case letters, base32, base36, letters, base62, base64;
a random run of a larger alphabet that happens to lack some characters is random over the smaller). By how far it is
from independent and uniform characters of that alphabet, six p values are computed: chi-squared over the alphabet and,
as most symbols are expected less than once in a short run, over cells of symbols that are common, middling and rare in
text; the number of runs above and below the middle, of one kind of symbol, and of vowels and others; and serial
correlation. The least of them, times six, is the run's score.

What is controlled is the share of text among the spans that are reported. Runs of equal encoding and similar length
form a family. The hypothesis for a run is that it is text: words joined as identifiers are (or dates and counters,
where the alphabet has digits alone, or text in hex). DECOYS such strings of the family's lengths, made by a rule from
common words, go through the same tests; a run's p value under the hypothesis is the share of decoys that look as random
as it does. Below the decoys' lowest tenth the share is that of a power law, whose exponent is estimated from that tenth
(Hill's estimator, less its standard error, and at most STEEPEST): a lower tail of a sum of positive parts falls faster
than that. So p values go on below 1 / DECOYS, and a few random runs are found among many of text. The
Benjamini-Hochberg procedure rejects the hypothesis within a family at a false-discovery rate of FDR, and the runs
for which it is rejected are spans of kind random, unless their score is MOST or more, which of random runs about one in
a hundred has: these are neither like text nor random. So a short run, which the tests can hardly tell from text, is
reported only where runs as random as it are many among those of its length. The rate holds for text that the decoys
are like; hashes and other random identifiers are random, and reported. The procedure works on counts of scores in fixed
bins, of which there are at most 61 for each of some 110 families.

Positions are code points, ends exclusive. Null and empty texts have no spans; the time on very long ones grows with
their length and little more. Repeated rows are scanned alike, each of them counting in its family. Extra columns pass
through unless they bear the name of a result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.common import let, table, written

#: Pattern, group and least length of that group.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # only runs that are long enough, which are the same as those left of all
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FDR = 0.05
#: Bins of scores, in decades of p values, and bins to a decade; the last takes all higher scores.
BINS, PER_DECADE = 60, 4
#: The score, in decades, from which a run isn't taken for random.
MOST = 8
#: What the tests count for: cells most, and the whole alphabet least, as most symbols are expected less than once.
WEIGHTS = {"alphabet": 0.5, "cells": 2.0, "middle": 1.0, "kinds": 1.0, "vowels": 1.0, "serial": 1.0}
#: Decoys of a family, those of them that the tail is estimated from, and the greatest exponent of a tail.
DECOYS, TAIL, STEEPEST = 500, 50, 12.0
#: Bands of lengths to a doubling, and the last band, of 2**(LAST_BAND / PER_DOUBLING) characters or more.
PER_DOUBLING, LAST_BAND = 4, 28
#: Matches whose places are summed up together.
SPAN_BLOCK = 256
#: The alphabets, in the order of their codes.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "mixedhex": "0123456789abcdef",
    "base26": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: What the runs of an encoding match, the least alphabet first; all others are base64.
ENCODINGS = {
    "decimal": "^[0-9]+$",
    "hex": "^([0-9a-f]+|[0-9A-F]+)$",
    "mixedhex": "^[0-9A-Fa-f]+$",
    "base26": "^([a-z]+|[A-Z]+)$",
    "base32": "^([A-Z2-7]+|[a-z2-7]+)$",
    "base36": "^([0-9a-z]+|[0-9A-Z]+)$",
    "base52": "^[A-Za-z]+$",
    "base62": "^[A-Za-z0-9]+$",
}

#: Cells of letters by how common they are in text; the rest are digits, symbols and, in alphabets of both
#: cases, upper-case letters.
CELLS = {"c": "etaoinsr", "m": "hldcumfpgwyb", "r": "vkjxqz"}
VOWELS = "aeiou"
#: Common words of some languages, of which decoys are made.
WORDS = """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one
you were all her she there would their we him been has when who will no more if out so said what up its about into than them can
only other time new some could these two may first then do any like my now over such our man me even most made after also did many
must before back see through way where get much go well your know should down work year because come people just say each those take
market report climate house water school world news data user file page name list home test image server client config session
und der die das nicht von auf eine ist dem wird auch nach bei haus zeit jahr les des est pas pour dans que une avec sur plus monde
los las del por con una para como pero ciudad""".split()


def _spans(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """array<struct<start, end, kind, found>>: the leftmost matches that don't overlap, whose group is long enough."""
    regex = F.lit(pattern)
    matches, groups, gaps = F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(group)), F.split(text, pattern, -1)
    each = F.arrays_zip(matches.alias("m"), groups.alias("g"), F.transform(F.slice(gaps, 1, F.size(gaps) - 1), F.length).alias("gap"))
    kinds = "array<struct<start:int,end:int,kind:string,found:string>>"

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("found")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    # places are running sums, and appending copies an array: blocks keep the arrays that grow small
    def placed(e: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(e) - 1) / SPAN_BLOCK).cast("int"))
        of = lambda b: F.slice(e, b * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK))
        lengths = F.transform(blocks, lambda b: F.aggregate(of(b), F.lit(0), lambda t, x: t + x["gap"] + F.length(x["m"])))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(lengths, first, lambda d, n: F.struct((d["at"] + n).alias("at"), F.concat(d["starts"], F.array(d["at"])).alias("starts")))["starts"]
        begin = lambda at: F.struct(at.alias("at"), F.array().cast(kinds).alias("spans"))
        return let(starts, lambda at: F.flatten(F.transform(blocks, lambda b: F.aggregate(of(b), begin(F.get(at, b)), step)["spans"])))

    return F.when(text.rlike(pattern), let(each, placed)).otherwise(F.array().cast(kinds))


def _upper_tail(z: Column) -> Column:
    """P(normal > z), to some percent of itself, which the bins need."""
    tail = lambda x: 0.5 * F.exp(-0.717 * x - 0.416 * x * x)
    return F.when(z >= 0, tail(z)).otherwise(1 - tail(-z))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _by_encoding(encoding: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), encoding)


def _kind(symbol: str) -> str:
    return "u" if symbol.isupper() else "l" if symbol.islower() else "d" if symbol.isdigit() else "s"


def _cell(symbol: str) -> str:
    """Of a symbol in an alphabet of one case or both, where upper-case letters are a cell of their own."""
    return "u" if symbol.isupper() else _cell_of_letters(symbol)


def _cell_of_letters(symbol: str) -> str:
    return next((c for c, letters in CELLS.items() if symbol.lower() in letters), _kind(symbol))


#: What the symbols of base64, and so of all alphabets, are translated to for a count of runs or of cells.
#: base32 has upper-case letters only, which are told apart.
_KINDS, _CELLS, _LETTERS, _VOWELS = ("".join(map(f, ALPHABETS["base64"])) for f in (_kind, _cell, _cell_of_letters, lambda c: "v" if c.lower() in VOWELS else "x"))
_MIDDLE = {name: "".join("h" if i * 2 >= len(a) else "l" for i in range(len(a))) for name, a in ALPHABETS.items()}


def _shares(of: str, name: str, power: int) -> float:
    """The sum of powers of the shares of an alphabet that the values of a translation have."""
    to = dict(zip(ALPHABETS["base64"], of, strict=True))
    values = [to[c] for c in ALPHABETS[name]]
    return sum((values.count(v) / len(values)) ** power for v in set(values))


def _runs(text: Column, n: Column, encoding: Column, of: str) -> Column:
    """The p value of the number of places where the translation of a symbol isn't that of the next."""
    changes = F.length(F.regexp_replace(F.translate(text, ALPHABETS["base64"], of), r"(.)\1+", "$1")) - 1
    same, same3 = (_by_encoding(encoding, {name: _shares(of, name, p) for name in ALPHABETS}) for p in (2, 3))
    variance = (n - 1) * (same - same * same) + 2 * (n - 2) * (same3 - same * same)
    return F.when(variance <= 1e-9, F.lit(1.0)).otherwise(_two_sided((changes - (n - 1) * (1 - same)) / F.sqrt(variance)))


def _cell_chi(text: Column, n: Column, encoding: Column) -> Column:
    def of(symbols: str, names: list[str]) -> Column:
        cells, to, total = F.translate(text, ALPHABETS["base64"], symbols), dict(zip(ALPHABETS["base64"], symbols, strict=True)), F.lit(0.0)
        share = {name: {c: sum(to[x] == c for x in ALPHABETS[name]) / len(ALPHABETS[name]) for c in sorted(set(symbols))} for name in names}
        for c in sorted(set(symbols)):
            expected = n * _by_encoding(encoding, {name: share[name][c] for name in names})
            count = n - F.length(F.replace(cells, F.lit(c), F.lit("")))
            total = total + F.when(expected > 0, F.pow(count - expected, 2) / expected).otherwise(0.0)
        df = _by_encoding(encoding, {name: float(sum(v > 0 for v in share[name].values()) - 1) for name in names})
        return F.when(df > 0, _chi_tail(total, F.greatest(df, F.lit(1.0)))).otherwise(F.lit(1.0))

    return F.when(encoding == "base32", of(_LETTERS, ["base32"])).otherwise(of(_CELLS, [a for a in ALPHABETS if a != "base32"]))


def _chi_tail(value: Column, df: Column) -> Column:
    """P(chi-squared > value), by the cube-root approximation."""
    spread = 2 / (9 * df)
    return _upper_tail((F.pow(F.greatest(value, F.lit(0.0)) / df, 1 / 3) - (1 - spread)) / F.sqrt(spread))


def _score(plain: Column, encoding: Column) -> Column:
    """Of a run, given in the symbols of its encoding's alphabet: the weighted sum of -log10 of the six p values."""
    alphabet = _by_encoding(encoding, ALPHABETS)
    n, k = F.length(plain).cast("double"), F.length(alphabet).cast("double")
    counts = F.transform(F.split(alphabet, ""), lambda c: n - F.length(F.replace(plain, c, F.lit(""))))
    chi = _chi_tail(F.aggregate(counts, F.lit(0.0), lambda t, c: t + c * c) * k / n - n, k - 1)

    halves = F.call_function("translate", plain, alphabet, _by_encoding(encoding, _MIDDLE))
    high = n - F.length(F.replace(halves, F.lit("h"), F.lit("")))
    runs = F.length(F.regexp_replace(halves, r"(.)\1+", "$1"))
    expected = 2 * high * (n - high) / n + 1
    deviation = F.sqrt((expected - 1) * (expected - 2) / (n - 1))
    middle = F.when((high == 0) | (high == n) | (deviation <= 0), _two_sided(F.sqrt(n))).otherwise(_two_sided((runs - expected) / deviation))

    codes = F.transform(F.split(plain, ""), lambda c: F.position(c, alphabet).cast("double") - 1)
    about = lambda c, mean: F.aggregate(c, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean))
    following = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    along = lambda c, mean: F.aggregate(following(c), F.lit(0.0), lambda t, p: t + (p["x"] - mean) * (p["y"] - mean))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x) / n
    serial = let(codes, lambda c: let(mean(c), lambda m: F.when(about(c, m) > 0, _two_sided(along(c, m) / about(c, m) * F.sqrt(n))).otherwise(F.lit(0.0))))
    p = {"alphabet": chi, "cells": _cell_chi(plain, n, encoding), "middle": middle, "kinds": _runs(plain, n, encoding, _KINDS), "vowels": _runs(plain, n, encoding, _VOWELS), "serial": serial}
    return sum((-F.log10(F.least(F.lit(1.0), F.greatest(p[name], F.lit(1e-12)))) * weight for name, weight in WEIGHTS.items()), F.lit(0.0))


def _bin(plain: Column, encoding: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(_score(plain, encoding) * PER_DECADE)).cast("int")


def _plain(bare: Column, encoding: Column) -> Column:
    """A run in the symbols of its encoding's alphabet."""
    of_case = F.when(encoding == "base32", F.upper(bare)).when(encoding.isin("hex", "mixedhex", "base26", "base36"), F.lower(bare))
    return F.coalesce(of_case, F.translate(bare, "-_", "+/"))


def _tested(candidates: Column) -> Column:
    """array<struct<start, end, kind, family, bin>> of the candidates that have a letter or digit."""

    def one(x: Column) -> Column:
        bare = F.rtrim(x["found"], F.lit("="))
        encoding = F.coalesce(*[F.when(bare.rlike(pattern), F.lit(name)) for name, pattern in ENCODINGS.items()], F.lit("base64"))
        band = F.least(F.lit(LAST_BAND), F.floor(F.log2(F.length(bare)) * PER_DOUBLING)).cast("string")
        row = lambda e, bin_: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("random").alias("kind"), F.concat(e, F.lit(":"), band).alias("family"), bin_.alias("bin"))
        return let(encoding, lambda e: row(e, let(_plain(bare, e), lambda plain: _bin(plain, e))))

    return F.transform(F.filter(candidates, lambda x: x["found"].rlike("[0-9A-Za-z]")), one)


def decoys(spark: SparkSession, families: list[str]) -> DataFrame:
    """(family, plain): DECOYS strings as text would be in each family, by a rule from WORDS and the row's number."""
    n = len(families)
    rows = spark.range(DECOYS * n).withColumn("family", F.element_at(F.array(*map(F.lit, families)), (F.col("id") % n + 1).cast("int")))
    h = lambda *of: F.xxhash64("id", *[x if isinstance(x, Column) else F.lit(x) for x in of])
    pick = lambda least, n, *of: F.pmod(h(*of), F.lit(n)) + least
    each = lambda f: F.transform(F.sequence(F.lit(1), F.lit(50)), f)
    word = lambda j: F.element_at(F.array(*map(F.lit, WORDS)), pick(1, len(WORDS), "word", j).cast("int"))
    number = lambda j: F.when(pick(0, 2, "year", j) == 0, pick(1990, 40, "of", j)).otherwise(pick(0, 1000, "of", j)).cast("string")
    mixed = lambda case: each(lambda j: F.when(pick(0, 5, "number", j) == 0, number(j)).otherwise(case(word(j))))
    two = lambda least, n, *of: F.lpad(pick(least, n, *of).cast("string"), 2, "0")
    date = lambda j: F.concat(pick(1990, 40, "y", j).cast("string"), two(1, 12, "m", j), two(1, 28, "d", j))
    counter = lambda j: F.lpad(pick(0, 10_000, "n", j).cast("string"), 6, "0")
    mark = F.element_at(F.array(F.lit("+"), F.lit("/")), pick(1, 2, "mark").cast("int"))
    hexed = F.lower(F.hex(F.array_join(each(word), " ")))
    as_is = lambda x: x
    made = {
        "decimal": F.array_join(each(lambda j: F.when(pick(0, 2, "date", j) == 0, date(j)).otherwise(counter(j))), ""),
        "hex": hexed,
        "mixedhex": hexed,
        "base26": F.array_join(each(word), ""),
        "base32": F.translate(F.upper(F.array_join(mixed(as_is), "")), "0189", "2345"),
        "base36": F.array_join(mixed(as_is), ""),
        "base52": F.array_join(each(lambda j: F.initcap(word(j))), ""),
        "base62": F.array_join(mixed(F.initcap), ""),
        "base64": F.replace(F.when(pick(0, 2, "case") == 0, F.array_join(mixed(as_is), "+")).otherwise(F.array_join(mixed(F.initcap), "+")), F.lit("+"), mark),
    }
    encoding, band = F.substring_index("family", ":", 1), F.substring_index("family", ":", -1).cast("int")
    low, high = F.greatest(F.lit(20), F.ceil(F.pow(2.0, band / PER_DOUBLING))), F.ceil(F.pow(2.0, (band + 1) / PER_DOUBLING))
    text = F.coalesce(*[F.when(encoding == name, x) for name, x in made.items()])
    length = (low + F.pmod(h("length"), high - low)).cast("int")
    return rows.select("family", F.substring(text, F.lit(1), length).alias("plain"))


def _as_random(scores: Column, s: Column) -> Column:
    """The p value of a score below s: the share of decoys (scores, sorted) below s, and in their lowest part a power law."""
    below = F.size(F.filter(scores, lambda x: x < s))
    bound = F.greatest(F.element_at(scores, TAIL + 1), F.lit(1 / PER_DECADE))
    depth = F.aggregate(F.slice(scores, 1, TAIL), F.lit(0.0), lambda t, x: t + F.log(bound / F.greatest(x, F.lit(0.01)))) / TAIL
    exponent = F.least(F.lit(STEEPEST), (1 - 1 / TAIL**0.5) / F.greatest(depth, F.lit(1e-9)))
    tail = F.greatest(TAIL / DECOYS * F.pow(s / bound, exponent), below / DECOYS)
    return F.when(s < bound, tail).otherwise((below + 1) / (DECOYS + 1))


def reported_to(tested: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """By family: the last bin whose runs are reported. tested has a row (family, bin) for each run."""
    counts = written(tested.groupBy("family", "bin").agg(F.count(F.lit(1)).alias("n")), "bins")
    families = sorted(r["family"] for r in counts.select("family").distinct().collect())
    if not families:
        return {}
    spark = tested.sparkSession
    scores = decoys(spark, families).select("family", _score(F.col("plain"), F.substring_index("family", ":", 1)).alias("s"))
    made = scores.groupBy("family").agg(F.array_sort(F.collect_list("s")).alias("scores"))
    family = W.partitionBy("family")
    upto = F.sum("n").over(family.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    rows = counts.select("family", "bin", upto.alias("upto"), F.sum("n").over(family).alias("m")).join(F.broadcast(made), "family")
    p = _as_random(F.col("scores"), (F.col("bin") + 1) / PER_DECADE)
    found = rows.filter((p * F.col("m") <= fdr * F.col("upto")) & (F.col("bin") < MOST * PER_DECADE)).groupBy("family").agg(F.max("bin").alias("bin"))
    return {r["family"]: r["bin"] for r in found.collect()}


def _base(whole: Column) -> Column:
    """The spans of all patterns, in order."""
    return F.array_sort(F.concat(*[_ordered(_spans(whole, *KINDS[kind], kind), i) for i, kind in enumerate(KINDS)]))


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (without the text) with base: the spans that patterns give, by start and then kind."""
    others = [c for c in docs.columns if c not in (text, "base")]
    return docs.select(*others, _base(F.coalesce(F.col(text), F.lit(""))).alias("base"))


def find_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """docs (without the text) with base and random: arrays of spans, each by start and then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    others = [c for c in docs.columns if c not in (text, "base", "random")]
    candidates = _spans(whole, CANDIDATE, 0, 20, "random")
    rows = written(docs.select(*others, _base(whole).alias("base"), _tested(candidates).alias("__tested")), "secrets")
    to_bin = reported_to(rows.select(F.explode("__tested").alias("t")).select("t.family", "t.bin"), fdr)
    limits = F.create_map(*[F.lit(v) for pair in to_bin.items() for v in pair]) if to_bin else F.create_map().cast("map<string,int>")
    stands = F.filter("__tested", lambda x: x["bin"] <= F.coalesce(F.element_at(limits, x["family"]), F.lit(-1)))
    return rows.select(*others, "base", _ordered(stands, len(KINDS)).alias("random"))


def _ordered(spans: Column, order: int) -> Column:
    """The spans in a form that sorts by start and then by order."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _base_columns(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.withColumns({"n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex"), "base_sha256": F.sha2(_joined(F.col("base")), 256)})


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _base_columns(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _joined(F.array_sort(F.concat("base", "random"))).alias("spans"))


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2_secret_scan that patterns alone give, which SQL can express."""
    return _base_columns(find_base(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _spans_sql(kind: str, order: int) -> str:
    pattern, group, least = KINDS[kind]
    regex = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, len(g) AS size, CAST(list_sum(list_transform(gaps[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: len(x))), 0) AS BIGINT) AS start, len(m) AS n, {least} AS least
    FROM (SELECT doc_id, found, gaps, unnest(found) AS m, unnest(groups) AS g, generate_subscripts(found, 1) AS k
          FROM (SELECT doc_id, regexp_extract_all(t, {regex}, 0) AS found, regexp_extract_all(t, {regex}, {group}) AS groups, regexp_split_to_array(t, {regex}) AS gaps FROM d))"""


BASE_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({" UNION ALL ".join(_spans_sql(kind, i) for i, kind in enumerate(KINDS))}),
    kept AS (SELECT doc_id, kind, kind || ':' || start || ':' || (start + n) AS s, start, ord FROM spans WHERE size >= least),
    joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY start, ord) AS s FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN joined USING (doc_id)
"""
