"""Embeddings of nodes: which, of what text, by which model, in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import embedding_text
from weftgraph.model import CODE_KINDS, EMBED_KINDS, SKIP_KINDS

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(size: int = 384) -> Encoder:
    """A deterministic encoder without a model: signed hashed token counts, L2-normalised."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for k, text in enumerate(texts):
            for token in re.findall(r"[^\W_]+", text.lower()):
                h = zlib.crc32(token.encode())
                out[k, h % size] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


_MADE: dict[str, Encoder] = {}


def cached(name: str, make: Callable[[], Encoder]) -> Encoder:
    """An encoder that is made when a process first uses it, and once: for models that are costly to load on workers."""

    def encode(texts: list[str]) -> np.ndarray:
        if name not in _MADE:
            _MADE[name] = make()
        return _MADE[name](texts)

    return encode


class QueryVectors:
    """Vectors of queries, one encoder call each; the oldest of more than ``kept`` goes."""

    def __init__(self, encoders: dict[str, Encoder], models: dict[str, str], kept: int = 256):
        self.encoders, self.models, self.kept = encoders, models, kept
        self._found: OrderedDict[tuple[str, str], list[float]] = OrderedDict()

    def __call__(self, query: str, model_type: str = "text") -> list[float]:
        key = (model_type, query)
        if key not in self._found:
            text = f"query: {query}" if "e5" in self.models[model_type].lower() else query
            self._found[key] = unit(self.encoders[model_type]([text]))[0].tolist()
            while len(self._found) > self.kept:
                self._found.popitem(last=False)
        return self._found[key]

    def both(self, query: str) -> dict[str, list[float]]:
        return {kind: self(query, kind) for kind in self.encoders}

    def clear(self) -> None:
        self._found.clear()


def prefixed(text, model: str, use: str):
    """E5 models want their use in front of the text."""
    return F.concat(F.lit(f"{use}: "), text) if "e5" in model.lower() else text


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, so that a dot product is the cosine; rows without length stay."""
    rows = np.asarray(vectors, float)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def _batched(encode: Encoder, size: int):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [encode(texts.iloc[k : k + size].tolist()) for k in range(0, len(texts), size)]
            yield pd.Series([row for part in parts for row in unit(part).tolist()])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def model_type(kind: Column) -> Column:
    """Kinds of code go to the code model, others (of those that are embedded: sections) to the text model."""
    return F.when(F.lower(kind).isin(CODE_KINDS), "code").otherwise("text")


def embed_all(nodes: DataFrame, encode: Encoder | None = None, model: str = "hashing", batch: int = 64) -> DataFrame:
    """node_id, vector, model, model_type (_all) of every node, by one model, without prefix or filter."""
    text = embedding_text(F.col("label"), F.col("signature"), F.col("docstring"), F.col("source_snippet"))
    vector = F.pandas_udf(_batched(encode or hashing_encoder(), batch), "array<double>")(text)
    return nodes.select(F.col("id").alias("node_id"), vector.alias("vector"), F.lit(model).alias("model"), F.lit("_all").alias("model_type"))


def embed(nodes: DataFrame, existing: DataFrame | None = None, encoders: dict[str, Encoder] | None = None, models: dict[str, str] | None = None, batch: int = 64) -> DataFrame:
    """node_id, vector, model, model_type of embeddable nodes with some text that aren't in ``existing`` (node_id).

    Kinds of code go to the code model, sections to the text model.
    """
    encoders = encoders or {"code": hashing_encoder(), "text": hashing_encoder()}
    models = models or {"code": "hashing", "text": "hashing"}
    kind = F.lower("kind")
    text = embedding_text(F.col("label"), F.col("signature"), F.col("docstring"), F.col("source_snippet"))
    rows = nodes.filter(kind.isin(EMBED_KINDS) & ~kind.isin(SKIP_KINDS)).select(F.col("id").alias("node_id"), model_type(F.col("kind")).alias("model_type"), text.alias("text")).filter("trim(text) <> ''")
    if existing is not None:
        rows = rows.join(existing.select("node_id").distinct(), "node_id", "left_anti")
    out = None
    for kind_of_model, encode in encoders.items():
        model = models.get(kind_of_model, kind_of_model)
        vector = F.pandas_udf(_batched(encode, batch), "array<double>")(prefixed(F.col("text"), model, "passage"))
        part = rows.filter(F.col("model_type") == kind_of_model).select("node_id", vector.alias("vector"), F.lit(model).alias("model"), "model_type")
        out = part if out is None else out.unionByName(part)
    return out
