"""Operator 3: token counts of whole texts as the tokenizers library gives them.

Huge documents are encoded in overlapping chunks with offsets. Two neighbours are spliced at a token end that both
have in their overlap and that is a boundary whatever stands around it: a white-space character after another
character. No token of a byte-level vocabulary goes over such a place, and no special string holds white space.
Where an overlap has no such place it is widened, up to the rest of the text.

Other documents are taken apart at the same kind of boundary, so that a piece that comes again (most do) is encoded
once for each worker. Texts with white space that this doesn't cover are encoded whole.

Nulls count as empty texts, which have no tokens. Repeated rows give repeated results; extra columns pass through
unless they bear the name of a result. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ship, table

#: Documents of more characters are encoded in chunks of so many, which share OVERLAP characters at first.
CHUNK_CHARS, OVERLAP = 32_768, 512
#: Pieces whose counts a worker remembers.
REMEMBERED = 400_000

# White space that the pieces don't cover: two in a row, or other than a space or line end; and the mark used to cut.
_IRREGULAR = r"[\x01]|[\t\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[ \n][ \n]"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def splits_as_known(path: str) -> bool:
    """Whether no token of the file's tokenizer goes over the boundaries that are used here."""
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    pre = known.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and known["model"]["type"] == "BPE"
    whole = not (known.get("normalizer") or known.get("truncation") or known.get("padding"))
    plain = lambda t: not (t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s|[^\W\d_][.,;:!?]|\x01", t["content"]))
    return bool(byte_level) and whole and all(map(plain, known.get("added_tokens", ())))


def _boundary(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] in " \n" and not text[at - 1].isspace()


def count_by_chunks(text: str, tok, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> int:
    """Tokens of text, encoded in chunks that overlap; equal to encoding it whole."""
    ends = lambda a, b: np.fromiter((e for _, e in tok.encode(text[a:b], add_special_tokens=False).offsets), np.int64) + a
    start, total = 0, 0
    here, stop = ends(0, chunk), min(chunk, len(text))
    while stop < len(text):
        width = overlap
        while True:
            begin = max(start, stop - width)
            following = ends(begin, begin + chunk + width)
            common = [p for p in np.intersect1d(here, following)[::-1].tolist() if begin < p < stop and _boundary(text, p)]
            if common or begin == start:
                break
            width *= 2
        if common:
            # the lowest agreement leaves most of the overlap as evidence that both have come into step
            at = common[len(common) // 2]
            total += int((here <= at).sum())
            start, here = at, following[following > at]
            stop = min(begin + chunk + width, len(text))
        else:
            chunk *= 2
            here, stop = ends(start, start + chunk), min(start + chunk, len(text))
    return total + len(here)


class PieceCounts:
    """Counts of pieces, remembered; forgotten together when there are too many."""

    def __init__(self, tok) -> None:
        self.tok, self.known = tok, {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text, all of which have regular white space and no nulls."""
        cut = pc.replace_substring(texts, "\n", "\x01\n\x01")
        cut = pc.replace_substring(cut, " ", "\x01 ")
        cut = pc.replace_substring_regex(cut, r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,;:!?])", "\\1\x01\\2")
        lists = pc.split_pattern(cut, "\x01")
        flat = lists.flatten().dictionary_encode()
        pieces = flat.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [p for p in pieces if p not in known]
        known.update(zip(new, (len(e) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        each = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))[flat.indices.to_numpy(zero_copy_only=False)]
        sums = np.concatenate([[0], np.cumsum(each)])
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        return sums[offsets[1:]] - sums[offsets[:-1]]


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    ship(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])

    def run(batches):
        tok = tokenizer(tokenizer_file)
        pieces, known = PieceCounts(tok), splits_as_known(tokenizer_file)
        for batch in batches:
            texts = pc.fill_null(batch.column(text), "")
            counts = np.zeros(len(texts), np.int64)
            huge = pc.greater(pc.utf8_length(texts), CHUNK_CHARS).to_numpy(zero_copy_only=False)
            irregular = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
            if not known:
                huge, irregular = np.zeros(len(texts), bool), np.ones(len(texts), bool)
            plain = np.flatnonzero(~huge & ~irregular)
            counts[plain] = pieces(texts.take(pa.array(plain)))
            for i in np.flatnonzero(huge):
                counts[i] = count_by_chunks(texts[i].as_py(), tok)
            whole = np.flatnonzero(irregular & ~huge)
            counts[whole] = [len(e) for e in tok.encode_batch_fast(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*batch.schema.names, "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.mapInArrow(run, schema).withColumns({"n_bytes": n_bytes, "over_limit": F.col("n_tokens") > limit})


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_bytes", "n_tokens", "over_limit")
