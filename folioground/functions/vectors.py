"""Embedding and similarity over array columns."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from folioground import constants as C

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


@functools.lru_cache(maxsize=1 << 16)
def _token_bytes(token: str) -> bytes:
    """First eight digest bytes of a token."""
    return hashlib.sha256(token.encode("utf-8")).digest()[:8]


#: Characters of text that are hashed together; the arrays of a stripe are some 40 times its size.
STRIPE_CHARS = 1 << 19


def _hash_stripe(texts: list[str], dim: int) -> np.ndarray:
    """Feature-hash some texts: a token is digested once while it is remembered, the rest is one weighted bincount over (row, slot)."""
    tokenised = [t.strip().lower().split() for t in texts]
    lengths = np.array([len(t) for t in tokenised])
    flat = [tok for toks in tokenised for tok in toks]
    if not flat:
        return np.zeros((len(texts), dim), np.float32)
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    digest = np.frombuffer(b"".join(map(_token_bytes, uniques)), np.uint8).reshape(-1, 8).astype(np.int64)[codes]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    slot = (digest * 31 + (place * 7)[:, None]) % dim
    weight = ((digest >> 4) - 7.5) / 10.0
    row = np.repeat(np.arange(len(tokenised)), lengths)
    key = (row[:, None] * dim + slot).ravel()
    out = np.bincount(key, weights=weight.ravel(), minlength=len(tokenised) * dim).reshape(len(tokenised), dim)
    norm = np.sqrt((out * out).sum(axis=1))
    unit = norm > 0
    out[unit] = np.round(out[unit] / norm[unit][:, None], 6)
    out[~unit & np.array([bool(t.strip()) for t in texts]), 0] = 1.0
    return out.astype(np.float32)


def _stripes(texts: pd.Series, dim: int) -> Iterator[np.ndarray]:
    """Feature-hash a batch in stripes of whole texts, so memory follows a stripe, not the batch."""
    texts = [t or "" for t in texts]
    start = chars = 0
    for end, t in enumerate(texts, 1):
        chars += len(t)
        # Rows of a stripe take ``dim`` doubles each however short they are.
        if chars >= STRIPE_CHARS or end - start == 256 or end == len(texts):
            yield _hash_stripe(texts[start:end], dim)
            start, chars = end, 0


def _hash_batch(texts: pd.Series | list[str], dim: int) -> np.ndarray:
    out, at = np.zeros((len(texts), dim), np.float32), 0
    for made in _stripes(texts, dim):
        out[at: at + len(made)] = made
        at += len(made)
    return out


def hash_texts(texts: list[str]) -> np.ndarray:
    """What the default embedder makes of some texts, a row each."""
    return _hash_batch(texts, C.EMBEDDING_DIM)


def hashing_embedder(dim: int = C.EMBEDDING_DIM) -> Callable[[Column], Column]:
    """Default embedder: text column to unit vector column, no shuffle."""

    @F.pandas_udf(VECTOR)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for made in _stripes(texts, dim):  # a stripe is given back before the next is made
                yield pd.Series(list(made))

    return embed


def _as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; zero for missing, empty, unequal or zero-length vectors."""
    comparable = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.size(a) == F.size(b))
    length = norm(a) * norm(b)
    raw = F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
    return F.when(comparable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).otherwise(F.lit(0.0))
