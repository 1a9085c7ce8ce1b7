"""Providers of embeddings, and their use on a DataFrame. Without a provider embeddings are null."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.request
from collections.abc import Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.shipping import ship

TIMEOUT_S = 30


class Embedder(Protocol):
    dims: int

    def embed_batch(self, texts: list[str]) -> list[list[float] | None]:
        """A vector for each text; None where there was a failure."""


class HashEmbedder:
    """Needs no model: signs of hashed words. For tests, and where any stable vector will do."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed_batch(self, texts: list[str]) -> list[list[float] | None]:
        return [self._embed(t) for t in texts]

    def _embed(self, text: str) -> list[float]:
        vector = [0.0] * self.dims
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            vector[h % self.dims] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        return [x / norm for x in vector]


class HttpEmbedder:
    """A server that takes one text and returns one vector: prompt style (url/api/embeddings) or, with a key, the
    input style of OpenAI-compatible servers (url/embeddings)."""

    def __init__(self, url: str, model: str, dims: int, key: str | None = None, input_style: bool = False) -> None:
        self.url, self.model, self.dims, self.key, self.input_style = url.rstrip("/"), model, dims, key, input_style or key is not None

    def request(self, text: str) -> tuple[str, dict, dict]:
        if not self.input_style:
            return f"{self.url}/api/embeddings", {"model": self.model, "prompt": text}, {}
        return f"{self.url}/embeddings", {"model": self.model, "input": text}, {"Authorization": f"Bearer {self.key}"} if self.key else {}

    def embed_batch(self, texts: list[str]) -> list[list[float] | None]:
        return [self._embed(t) for t in texts]

    def _embed(self, text: str) -> list[float] | None:
        url, body, headers = self.request(text)
        call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(call, timeout=TIMEOUT_S) as reply:
                found = json.load(reply)
            return found["data"][0]["embedding"] if self.input_style else found["embedding"]
        except (OSError, ValueError, KeyError, IndexError):
            return None


#: The dimensions of models that are known by name.
DIMS = {"all-minilm": 384, "nomic-embed-text": 768, "text-embedding-3-small": 1536}


def from_config(config: Mapping[str, str]) -> Embedder | None:
    """By config["provider"]: "" or "none" (no embeddings), hash, local or openai."""
    provider = config.get("provider", "")
    if provider in ("", "none"):
        return None
    if provider == "hash":
        return HashEmbedder(int(config.get("dims", "64")))
    if provider == "local":
        model = config.get("model", "nomic-embed-text")
        return HttpEmbedder(config.get("url", "http://localhost:11434"), model, DIMS.get(model, 768))
    if provider == "openai":
        model = config.get("model", "text-embedding-3-small")
        return HttpEmbedder(config.get("url", "https://api.openai.com/v1"), model, DIMS.get(model, 1536), config.get("key"), True)
    raise ValueError(f"no embedding provider {provider!r}")


def with_embedding(chunks: DataFrame, embedder: Embedder | None, text: str = "text") -> DataFrame:
    """chunks with embedding; null without a provider and where it fails."""
    chunks = chunks.drop("embedding")
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    if embedder is None:
        from pyspark.sql import functions as F

        return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    ship(chunks.sparkSession)

    def run(batches):
        for batch in batches:
            found = embedder.embed_batch([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return chunks.mapInArrow(run, schema)
