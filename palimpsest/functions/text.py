"""Column functions on text, time and durations."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that is trimmed from text.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Accented Latin letters and what they are searched as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: What parts the tokens of a text.
BETWEEN_TOKENS = r"[^\p{L}\p{N}]+"
#: What a text must not have for plain_tokens(): characters beyond Latin letters and common punctuation, and one that is two in lower case. (One class
#: of both, or of what isn't odd, takes up to ten times as long.)
ODD, TWO = r"[\x{250}-\x{1FFF}\x{2070}-\x{10FFFF}]", "İ"
_SECONDS = {"d": 86_400, "h": 3_600, "m": 60, "s": 1}


def as_timestamp(value: str | dt.datetime | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def fold_ascii(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def trim_space(text: Column) -> Column:
    """Without white space around it, Unicode's included."""
    return F.btrim(text, F.lit(SPACE))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: lambda bodies would otherwise evaluate it for every element."""
    return F.transform(F.array(value), body)[0]


def fold_token(text: Column) -> Column:
    """Lower case, without accents; ASCII texts, which have none, aren't gone through for them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(F.lower(text), ACCENTED, PLAIN))


def tokens(text: Column) -> Column:
    """The search tokens of a text, in order: letters and digits in lower case, without accents."""
    return F.array_remove(F.split(fold_token(text), BETWEEN_TOKENS), "")


def _token_point(c: int) -> int:
    """What tokens() makes of a code point; 0 if it parts tokens."""
    folded = chr(c).lower().translate(str.maketrans(ACCENTED, PLAIN))
    return ord(folded) if len(folded) == 1 and unicodedata.category(folded)[0] in "LN" else 0


_POINTS = np.array([_token_point(c) if c < 0x250 else 0 for c in range(0x2070)], np.uint16)


def plain_tokens(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """What tokens() gives of texts without ODD characters, by a table of code points: the tokens of all texts in order, and how many each has."""
    points = _POINTS[np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)]
    held = points > 0
    edges = np.flatnonzero(np.diff(held, prepend=False, append=False))
    starts, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    letters, offsets = points[held], np.append(0, np.cumsum(size))
    if len(letters) and letters.max() >= 0x80:
        # their places in UTF-8
        offsets = offsets + sum(np.searchsorted(np.flatnonzero(letters >= least), offsets) for least in (0x80, 0x800))
        data = letters.astype("<u2").tobytes().decode("utf-16-le").encode()
    else:
        data = letters.astype(np.uint8).tobytes()
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)), counts


def is_odd(text: Column) -> Column:
    """Whether plain_tokens() can't take a text."""
    return ~F.is_valid_utf8(text) | (F.octet_length(text) != F.length(text)) & (text.contains(TWO) | text.rlike(ODD))


def query_terms(query: str) -> list[str]:
    """The distinct search tokens of a query, in order, and as tokens() makes them."""
    folded = query.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", folded) if t))


def like_substring(text: Column, query: str) -> Column:
    """text LIKE %query%, where case doesn't count for A-Z, % and _ are wildcards and a backslash is itself."""
    folded = query.translate(str.maketrans(UPPER, LOWER))
    if "%" in folded or "_" in folded:
        return fold_ascii(text).like("%" + folded.replace("\\", "\\\\") + "%")
    return F.contains(fold_ascii(text), F.lit(folded))


def split_tags(text: Column) -> Column:
    """Comma-separated tags, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), trim_space), lambda t: t != "")


def ttl_seconds(ttl: Column) -> Column:
    """Seconds of a duration such as 7d, 24h, 30m or 60s; null for anything else."""
    unit = F.regexp_extract(ttl, "^[0-9]+([dhms])$", 1)
    scale = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in _SECONDS.items()])
    return (F.regexp_extract(ttl, "^([0-9]+)[dhms]$", 1).try_cast("long") * scale).cast("long")


def parse_ttl(ttl: str) -> int:
    """The same for one value; raises ValueError."""
    found = re.fullmatch("([0-9]+)([dhms])", ttl)
    if found is None:
        raise ValueError(f"a TTL is a number and one of d, h, m and s, not {ttl!r}")
    return int(found[1]) * _SECONDS[found[2]]


def after_seconds(at: Column, seconds: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def micros(at: Column) -> Column:
    """Microseconds from 1970 on."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def julian_day(at: Column) -> Column:
    return micros(at) / 8.64e10 + 2440587.5


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def round_half_away(x: Column, places: int) -> Column:
    """Rounds the product with a power of ten, as binary floating point has it, not the decimal value."""
    scale = 10.0**places
    return F.round(x * scale, 0) / scale
