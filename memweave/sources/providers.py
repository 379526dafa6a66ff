"""The two external models as pluggable providers, with deterministic stand-ins for tests and offline use."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType


class Extractor(Protocol):
    """Text and the candidates' JSON to the extraction record's JSON. Must be picklable; called on executors."""

    def extract(self, text: str, candidates: str) -> str: ...


class Embedder(Protocol):
    """Texts to vectors of one dimension, a batch at a time; no text, no call."""

    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class SentenceExtractor:
    """A stand-in, not a model: every sentence is a claim that cites itself."""

    def extract(self, text: str, candidates: str) -> str:
        claims, evidence = [], []
        for i, m in enumerate(re.finditer(r"[^.!?\n]*[^.!?\s][^.!?\n]*[.!?]?", text)):
            span = m.group().strip()
            # offsets count UTF-16 code units
            start = len(text[: m.start() + len(m.group()) - len(m.group().lstrip())].encode("utf-16-le")) // 2
            claims.append({"tempId": f"c{i}", "content": span, "kind": "fact", "confidence": 1.0, "categories": []})
            evidence.append({"claimTempId": f"c{i}", "startOffset": start, "endOffset": start + len(span.encode("utf-16-le")) // 2, "excerpt": span})
        return json.dumps({"claims": claims, "memoryRelationships": [], "entityRelationships": [], "mutations": [], "evidence": evidence})


class HashEmbedder:
    """A stand-in, not a model: a unit vector drawn from the text's hash."""

    def __init__(self, dimension: int = 768):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(self.dimension)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


def with_extraction(prompted: DataFrame, extractor: Extractor) -> DataFrame:
    """prompted (episode_id, raw_text, candidates) -> episode_id, response."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"episode_id": b["episode_id"], "response": [extractor.extract(t or "", c) for t, c in zip(b["raw_text"], b["candidates"], strict=True)]})

    return prompted.mapInPandas(task, "episode_id string, response string")


def with_embedding(rows: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """The rows and ``embedding`` of a text column; a provider's vector of the wrong length is an error."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = embedder.embed([t or "" for t in b[text]]) if len(b) else []
            if any(len(v) != embedder.dimension for v in vectors):
                raise ValueError("the provider returned no vector of its dimension")
            yield b.assign(embedding=vectors)

    return rows.mapInPandas(task, schema)


def precomputed_embedding(rows: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """The rows with ``embedding`` joined from a table of vectors by entity_id."""
    return rows.join(vectors.select(F.col("entity_id").alias(key), "embedding"), key, "left")
