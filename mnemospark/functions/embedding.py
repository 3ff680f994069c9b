"""Embedders: anything that makes vectors of texts; a word-hash one needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark import params as P

Embedder = Callable[[list[str]], np.ndarray]


def word_hashes(texts: list[str], dims: int = P.DIMS) -> np.ndarray:
    """Each word adds one to the buckets of the first eight bytes of its MD5; the vector has length 1, or is 0 for no words."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, text in enumerate(texts):
        for word in re.split(r"\W+", text.lower()):
            if word:
                for b in hashlib.md5(word.encode()).digest()[:8]:
                    out[i, b * dims // 256] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(rows: DataFrame, text: str, make: Callable[[], Embedder] = lambda: word_hashes, clip: int = P.EMBED_CLIP, batch: int = P.EMBED_BATCH) -> DataFrame:
    """row_id and embedding of rows; make is called once a worker, to load a model there. Null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make()
        for s in batches:
            texts = [(t or "")[:clip] for t in s]
            parts = [embedder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series([v for p in parts for v in p])

    return rows.select("row_id", run(F.col(text)).alias("embedding"))


def prepared(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id and embedding of queries (query_id, query) from vectors (key, embedding) made before.

    The key is the start of the hash of the query's text. A query without a vector is an error, as a search without it
    would look like one without results.
    """
    keyed = queries.select("query_id", F.substring(F.sha2("query", 256), 1, 16).alias("key"))
    missing = keyed.join(vectors, "key", "left_anti").orderBy("query_id").first()
    if missing:
        raise KeyError(f"no vector for query {missing['query_id']}")
    return keyed.join(vectors, "key").select("query_id", "embedding")
