"""Embedding as a column: pluggable, with a hashing embedder that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes texts, gives one vector each.
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int) -> Embedder:
    """Unit vectors of signed word counts; no semantic model, for tests and for corpora without one."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    return embed


def with_vectors(rows: DataFrame, embedder: Embedder, text: str = "text", vector: str = "vector") -> DataFrame:
    """Rows with vectors where they had none; only those go to the embedder."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder(texts.fillna("").tolist())))

    if vector not in rows.columns:
        return rows.withColumn(vector, embed(text))
    have, lack = rows.where(F.col(vector).isNotNull()), rows.where(F.col(vector).isNull())
    return have.unionByName(lack.withColumn(vector, embed(text)))
