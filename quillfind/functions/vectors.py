"""Vector functions: exact cosine in the JVM, hashed embeddings and codecs in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero; null where the lengths differ."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, 0.0).otherwise(dot(a, b) / F.when(size != 0, size)))


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of maps from term to weight."""
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x)
    shared = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(a, k) * F.try_element_at(b, k), F.lit(0.0)))
    size = F.sqrt(total(a)) * F.sqrt(total(b))
    return F.when(size == 0, 0.0).otherwise(shared / F.when(size != 0, size))


def round3(c: Column) -> Column:
    return F.round(c, 3)


#: The offset basis and the prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = FNV_BASIS
    for byte in data:
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def hashed_vectors(texts: list, dims: int) -> np.ndarray:
    """(text, dimension): tokens by FNV-1a: the remainder gives the dimension, bit 32 the sign; length one, or zero without a token.

    Each distinct token is hashed once.
    """
    at: dict[str, int] = {}
    owner, token = [], []
    for i, text in enumerate(texts):
        for w in re.findall(r"[^\W_]+", (text or "").lower()):
            owner.append(i)
            token.append(at.setdefault(w, len(at)))
    hashes = np.fromiter((fnv1a(w.encode("utf-8", "replace")) for w in at), np.uint64, len(at))
    place, sign = (hashes % np.uint64(dims)).astype(np.int64), 1.0 - 2.0 * ((hashes >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    owner, token = np.array(owner, np.int64), np.array(token, np.int64)
    v = np.bincount(owner * dims + place[token], sign[token], len(texts) * dims).reshape(len(texts), dims) if len(owner) else np.zeros((len(texts), dims))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def hashed_vector(text: str | None, dims: int) -> np.ndarray:
    return hashed_vectors([text], dims)[0]


def hashed_embedding(c: Column, dims: int = 256) -> Column:
    """The hashed embedding of a text, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        # a few texts at a time: the vectors of a batch are dense
        return pd.Series([v for at in range(0, len(texts), 1024) for v in hashed_vectors(list(texts.iloc[at : at + 1024]), dims).astype(np.float32)], dtype=object)

    return F.pandas_udf(run, "array<float>")(c)


def pack(c: Column) -> Column:
    """A vector as little-endian float32."""

    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors])

    return F.pandas_udf(run, "binary")(c)


def unpack(c: Column) -> Column:
    """The vector of little-endian float32 bytes."""

    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, "<f4") for b in blobs])

    return F.pandas_udf(run, "array<float>")(c)


def quantized(c: Column) -> Column:
    """Eight bits a dimension, scaled by the largest magnitude."""
    most = F.array_max(F.transform(c, lambda x: F.abs(x)))
    return F.transform(c, lambda x: F.when(most == 0, F.lit(0)).otherwise(F.round(x / F.when(most != 0, most) * 127)).cast("tinyint"))
