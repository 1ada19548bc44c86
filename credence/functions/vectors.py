"""Vector functions on arrays, within the JVM."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def hashing_embedder(dimensions: int = 64):
    """A deterministic stand-in for an embedding model: signed hashed tokens, unit length. Any Arrow UDF of text can take its place."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        def one(t):
            v = np.zeros(dimensions)
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimensions] += 1 if h >> 63 else -1
            n = float(np.sqrt((v * v).sum()))
            return (v / n if n else v).tolist()

        return text.map(lambda t: one(t if isinstance(t, str) else ""))

    return embed


def embed_once(texts, text_col: str, embedder) -> "DataFrame":  # noqa: F821
    """texts with `vector`: each distinct text is embedded once and joined back."""
    vectors = texts.select(text_col).distinct().withColumn("vector", embedder(F.col(text_col)))
    return texts.join(vectors, text_col, "left")
