"""Operator 10: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Nulls count as empty texts; an empty text has no tokens. Repeated rows give repeated results. Extra columns pass
through unless they bear the name of a result. An empty table gives an empty result.

Very long texts are cut where a match of the splitting pattern must end, so that every piece is encoded as it is in the
whole text. Where a text has no such place for long (a run of white space, a script without spaces), or the pattern is
one whose safe boundaries aren't known, its matches are walked and each is encoded by itself.
"""

from __future__ import annotations

import base64
import functools
import sys
from array import array

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import ship, table

#: Characters of a text that are encoded at once, and those from which on the library's own splitting isn't used: it
#: recurses over a run of white space and ends the process on one of a million characters.
PIECE_CHARS, WALKED_CHARS = 1 << 16, 1 << 17

# A match of public_tokenizers.PATTERN holds no white space after another character and never mixes letters with digits, so a match
# ends at each of these places whatever stands around them.
_SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@])")


def safe_pieces(text: str, size: int = PIECE_CHARS):
    """text in pieces of about size characters, cut only at safe boundaries; one piece where there is none."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, rank_file: str, pattern: str, piece_chars: int = PIECE_CHARS, walked_chars: int = WALKED_CHARS) -> list[int]:
    """The ids of the text by the ranks of a file, each match of the pattern encoded separately."""
    enc = encoding(rank_file, pattern)
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, piece_chars) if pattern == public_tokenizers.PATTERN else [text]:
        if len(piece) <= walked_chars:
            ids += enc.encode_ordinary(piece)
        else:
            # an encoding that doesn't split
            whole = encoding(rank_file, "(?s:.+)")
            for match in regex.finditer(pattern, piece):
                ids += whole.encode_ordinary(match[0])
    return ids


def bpe_roundtrip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids and decoded, both binary: the text's token ids as little-endian unsigned 32-bit integers, the
    form in which training loaders map them, and the bytes that they decode to."""
    ship(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids, decoded = [], []
            for t in batch.column(text).to_pylist():
                tokens = encode(t or "", rank_file, pattern)
                packed = array("I", tokens)
                if sys.byteorder == "big":
                    packed.byteswap()
                ids.append(packed.tobytes())
                decoded.append(enc.decode_bytes(tokens))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=[*batch.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
