"""Text encoders. A model is the caller's; the hashing encoder stands in where there is none."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from marginalia.functions import text as T

Encode = Callable[[list[str]], np.ndarray]


def hashing_encoder(size: int = 64) -> Encode:
    """Signed counts of hashed words, of length one; it tells texts apart by their words and knows no meaning."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = xxhash.xxh3_64_intdigest(w)
                row[h % size] += 1 if h >> 63 else -1
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))

    return encode


def embed(encode: Encode, batch: int = 32) -> Callable[[Column], Column]:
    """A column function that encodes cleaned and truncated texts in batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        return pd.Series([v.tolist() for i in range(0, len(rows), batch) for v in encode(rows[i : i + batch])], dtype=object)

    return lambda c: run(T.truncated(T.clean_for_encoder(c)))


def embedded(notes: DataFrame, encode: Encode) -> DataFrame:
    return notes.withColumn("embedding", embed(encode)(F.col("content")))
