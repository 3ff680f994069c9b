"""Exact nearest vectors of a stated set of queries by blocked products.

Every task reads its share of the vectors once and keeps the k best for each query; only those, k times the number of
tasks a query at most, are shuffled and ranked. Queries are written once where they are more than a block of bounded
size; each block goes with the tasks of one pass over the vectors, and all passes are one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.storage import materialize

#: Queries of one pass: their vectors take this many times 8 bytes a dimension in every task.
QUERIES_A_PASS = 8192
#: Vectors that are compared with all queries of a pass at once.
STEP = 512


def matrix(column: pa.Array, keys: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, float64 rows of length 1) of the vectors that have dims finite numbers, not all 0."""
    good = np.asarray(pc.equal(pc.list_value_length(column), dims).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
    rows = column.filter(pa.array(good))
    flat = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", flat, flat))
    keep = np.isfinite(norm) & (norm > 0)
    return keys.filter(pa.array(good)).to_numpy(zero_copy_only=False)[keep], flat[keep] / norm[keep][:, None]


def _blocks(queries: DataFrame, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query_ids, rows of length 1) of at most QUERIES_A_PASS queries each, give or take those of a hash."""
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    # One more than a block tells that there are more; only then are the queries written and counted.
    rows = queries.limit(QUERIES_A_PASS + 1).toArrow()
    passes = 1
    if rows.num_rows > QUERIES_A_PASS:
        queries = materialize(queries, "queries")
        passes = -(-queries.count() // QUERIES_A_PASS)
    for i in range(passes):
        part = rows if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow()
        if part.num_rows:
            ids, q = matrix(pa.concat_arrays(part["embedding"].chunks), pa.concat_arrays(part["query_id"].chunks), dims)
            yield ids.astype(np.int64), q


def within(vectors: DataFrame, queries: DataFrame, floor: float, dims: int = P.DIMS, digits: int = 9) -> DataFrame:
    """query_id, row_id, similarity of every row of vectors as similar to a query as floor or more, the query's own included."""
    out = None
    for ids, q in _blocks(queries, dims):
        blob = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], blob=blob) -> Iterator[pa.RecordBatch]:
            ids, q = blob.value
            for batch in batches:
                keys, v = matrix(batch.column("embedding"), batch.column("row_id"), dims)
                for a in range(0, len(keys), STEP):
                    s = np.round(q @ v[a : a + STEP].T, digits)
                    x, y = np.nonzero(s >= floor)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(keys[a : a + STEP].astype(np.int64)[y]), pa.array(s[x, y])], names=["query_id", "row_id", "similarity"])

        found = vectors.select(F.col("row_id").cast("long").alias("row_id"), "embedding").mapInArrow(run, "query_id long, row_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, row_id long, similarity double") if out is None else out


def knn(vectors: DataFrame, queries: DataFrame, k: int, dims: int = P.DIMS, digits: int = 9) -> DataFrame:
    """query_id, row_id, similarity, rank: the k rows of vectors (row_id, embedding) nearest each query (query_id, embedding).

    Cosine similarity rounded to digits, ties to the smaller row_id. Vectors and queries that are null, of another
    length, not finite or all zero take no part. A query that is also a row finds itself.
    """
    spark = vectors.sparkSession
    out = None
    for ids, q in _blocks(queries, dims):
        blob = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], blob=blob) -> Iterator[pa.RecordBatch]:
            ids, q = blob.value
            n = len(ids)
            query, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            worst = np.full(n, -np.inf)  # of the k best of each query so far
            for batch in batches:
                keys, v = matrix(batch.column("embedding"), batch.column("row_id"), dims)
                for a in range(0, len(keys), STEP):
                    s = np.round(q @ v[a : a + STEP].T, digits)
                    floor = worst
                    if s.shape[1] > k and np.isneginf(worst).any():
                        floor = np.maximum(worst, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                    # Only what is as good as the worst of the best so far can change them; ties go by row_id.
                    x, y = np.nonzero(s >= floor[:, None])
                    if not len(x):
                        continue
                    query = np.concatenate((query, x))
                    row = np.concatenate((row, keys[a : a + STEP].astype(np.int64)[y]))
                    score = np.concatenate((score, s[x, y]))
                    order = np.lexsort((row, -score, query))
                    first = np.searchsorted(query[order], np.arange(n))
                    place = np.arange(len(order)) - first[query[order]]
                    order, place = order[place < k], place[place < k]
                    query, row, score = query[order], row[order], score[order]
                    full = place == k - 1
                    worst[query[full]] = score[full]
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(row), pa.array(score)], names=["query_id", "row_id", "similarity"])

        found = vectors.select(F.col("row_id").cast("long").alias("row_id"), "embedding").mapInArrow(run, "query_id long, row_id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, row_id long, similarity double, rank long")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
