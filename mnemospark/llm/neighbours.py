"""The most similar vectors of every vector by a permutation index (problem 3).

Pivots are a bounded sample of the vectors, so they lie densest where the vectors do. A vector is represented by its
nearest pivots in order and posted in the inverted file of each. Two vectors meet in the files of the pivots they
share; the pair is taken in one of them only. Within a file the pairs above the floor are found by blocked products,
ordered by the footrule distance of the permutations and ranked again by the exact cosine. Files that the sample
shows to be large are cut into blocks, and every pair of blocks is a task of its own, so a file's size bounds no task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log10, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.storage import materialize

#: Pivots: so many times the root of the number of vectors, within these bounds; the sample that fits the index is at most MAX_SAMPLE vectors.
PIVOTS_A_ROOT, MIN_PIVOTS, MAX_PIVOTS, MAX_SAMPLE = 1.2, 32, 16_384, 32_768
#: Nearest pivots in a vector's representation, to each of which it is posted: LENGTH up to LENGTH_ROWS vectors, one
#: more for every tenfold number, as pivots that lie denser part more neighbours.
LENGTH, LENGTH_ROWS = 5, 30_000
#: Vectors that a block of an inverted file should hold, and rows whose postings are packed together.
BLOCK, PACK = 6_000, 10_000
#: Products held at once, and pairs of a file that are held before only the best of each row are kept.
PRODUCTS, PAIRS = 1 << 21, 1 << 20
#: Bytes of postings that a task hands over at once.
HANDED = 8_000_000
#: Rows dropped by the caller go with the tasks up to this number, beyond it by a join on both sides.
MAX_BROADCAST_ROWS = 2_000_000


@dataclass
class Pivots:
    units: np.ndarray  # float32, a row each
    blocks: np.ndarray  # blocks of each pivot's inverted file
    length: int  # of a vector's permutation


def valid(values: np.ndarray) -> np.ndarray:
    """Which rows have a finite, positive length."""
    with np.errstate(all="ignore"):
        norm = np.einsum("ij,ij->i", values, values, dtype=np.float64)
    return np.isfinite(norm) & (norm > 0)


def units(values: np.ndarray) -> np.ndarray:
    """Rows of length 1, in blocks to bound memory."""
    out = np.empty_like(values)
    for i in range(0, len(values), 1024):
        wide = values[i : i + 1024].astype(np.float64)
        out[i : i + 1024] = wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]
    return out


def permutation(u: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first."""
    out = np.empty((len(u), min(length, len(pivots))), np.int16)
    step = _step(2048, len(pivots))
    for i in range(0, len(u), step):
        s = u[i : i + step] @ pivots.T
        near = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        order = np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable")
        out[i : i + step] = np.take_along_axis(near, order, 1)
    return out


def _step(most: int, columns: int) -> int:
    """Rows whose products with so many columns are held at once."""
    return max(16, min(most, PRODUCTS // max(1, columns)))


def footrule(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Induced footrule distance of truncated permutations, a row each: a pivot that one lacks counts as one place past its end."""
    length = a.shape[1]
    same = a[:, :, None] == b[:, None, :]
    places = np.arange(length)
    apart = np.abs(places[:, None] - places[None, :])
    both = (same * apart).sum((1, 2))
    only_a = ((~same.any(2)) * (length - places)).sum(1)
    only_b = ((~same.any(1)) * (length - places)).sum(1)
    return both + only_a + only_b


def _matrix(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row_ids, vectors) of the rows of a batch that have dims numbers, all finite and not all 0."""
    column, ids = batch.column("embedding"), batch.column("row_id")
    good = np.asarray(pc.equal(pc.list_value_length(column), dims).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
    good &= np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    rows = column.filter(pa.array(good))
    values = rows.flatten().cast(pa.float32())
    flat = values.to_numpy(zero_copy_only=False).reshape(len(rows), dims).astype(np.float32, copy=False)
    keep = valid(flat)
    return ids.filter(pa.array(good)).to_numpy(zero_copy_only=False).astype(np.int64)[keep], flat[keep]


def _hashes(values: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each row; 0.0 and -0.0 are the same."""
    out = np.empty(len(values), np.uint64)
    with np.errstate(over="ignore"):
        mult = (np.arange(1, values.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for i in range(0, len(values), 1024):
            raw = (values[i : i + 1024] + np.float32(0)).view(np.uint32).astype(np.uint64)
            h = ((raw * np.uint64(0xBF58476D1CE4E5B9)) ^ (raw >> np.uint64(13))) * mult
            out[i : i + 1024] = (h ^ (h >> np.uint64(29))).sum(1, dtype=np.uint64)
    return out


def _first_copies(ids: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest ids of every hash."""
    order = np.lexsort((ids, hashes))
    h = hashes[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    place = np.arange(len(h)) - np.repeat(start, np.diff(np.concatenate((start, [len(h)]))))
    return order[place < n]


class Packer:
    """Rows of vectors as compressed bytes; nothing is lost.

    Where the numbers have few bits, as in half precision or whole steps, every number is the place of its upper half in
    a table of at most 256; otherwise bytes of equal place lie next to each other.
    """

    def __init__(self, values: np.ndarray):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=1)
        raw = np.ascontiguousarray(values).view(np.uint32)
        self.table, self.rows = b"", raw
        if not (raw & np.uint32(0xFFFF)).any():
            high = (raw >> np.uint32(16)).astype(np.uint16)
            used = np.flatnonzero(np.bincount(high.ravel(), minlength=1 << 16))
            if len(used) <= 256:
                place = np.zeros(1 << 16, np.uint8)
                place[used] = np.arange(len(used))
                self.table, self.rows = used.astype(np.uint16).tobytes(), place[high]

    def rows_of(self, members: np.ndarray) -> bytes:
        part = self.rows[members]
        body = part.tobytes() if self.table else part.view(np.uint8).reshape(-1, 4).T.tobytes()
        return len(self.table).to_bytes(2, "little") + self.table + self.zip.compress(body)


def _unpack(raw: bytes, rows: int) -> np.ndarray:
    import zstandard

    size = int.from_bytes(raw[:2], "little")
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[2 + size :]), np.uint8)
    if size:
        return (np.frombuffer(raw[2 : 2 + size], np.uint16)[body].astype(np.uint32) << np.uint32(16)).view(np.float32).reshape(rows, -1)
    return np.ascontiguousarray(body.reshape(4, -1).T).view(np.float32).reshape(rows, -1)


def permutation_length(rows: int) -> int:
    """How many pivots represent each of so many vectors."""
    return LENGTH + max(0, ceil(log10(max(1, rows) / LENGTH_ROWS) - 0.5))


def fit(vectors: DataFrame, dims: int, rows: int, pivots_a_root: float = PIVOTS_A_ROOT, length: int | None = None) -> Pivots:
    """Pivots and the sizes of their inverted files, from the vectors with the smallest hashes of row_id."""
    count = int(min(MAX_PIVOTS, max(MIN_PIVOTS, pivots_a_root * sqrt(rows))))
    wanted, length = min(MAX_SAMPLE, 4 * count), length or permutation_length(rows)
    h = F.xxhash64("row_id")
    chosen = vectors.where(F.size("embedding") == dims).select("row_id", "embedding", h.alias("h"))
    if rows > 2 * wanted:
        chosen = chosen.where(F.col("h") < F.lit(int(-(2**63) + 2**64 * (2 * wanted / rows))))
    sample = chosen.orderBy("h", "row_id").limit(wanted).select("row_id", "embedding").toArrow()
    if not sample.num_rows:
        return Pivots(np.zeros((0, dims), np.float32), np.zeros(0, np.int64), length)
    _, values = _matrix(sample.combine_chunks().to_batches()[0], dims)
    if not len(values):
        return Pivots(np.zeros((0, dims), np.float32), np.zeros(0, np.int64), length)
    u = units(values)
    _, first = np.unique(_hashes(values), return_index=True)
    distinct = u[np.sort(first)]
    pivots = distinct[:count]
    posted = np.bincount(permutation(u, pivots, length).ravel(), minlength=len(pivots)) * (rows / len(u))
    return Pivots(pivots, np.maximum(1, np.ceil(posted / BLOCK)).astype(np.int64), length)


def _postings(vectors: DataFrame, pivots: Pivots, dims: int, copies: int) -> DataFrame:
    """pivot, low, high, block, n and packed ids, permutations and vectors, a row for each pack and pair of blocks."""
    blob = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = pa.schema([("pivot", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("perms", pa.binary()), ("body", pa.binary())])

    def pack(ids: np.ndarray, values: np.ndarray, index: Pivots) -> Iterator[pa.RecordBatch]:
        keep = _first_copies(ids, _hashes(values), copies)
        ids, values = ids[keep], values[keep]
        perms = permutation(units(values), index.units, index.length)
        packer, length = Packer(values), perms.shape[1]
        owner, pivot = np.repeat(np.arange(len(ids)), length), perms.ravel().astype(np.int64)
        blocks = index.blocks[pivot]
        block = (ids[owner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % blocks
        order = np.lexsort((owner, block, pivot))
        edges = np.flatnonzero(np.concatenate(([True], (np.diff(pivot[order]) != 0) | (np.diff(block[order]) != 0), [True])))
        rows, size = [], 0
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            members = owner[order[a:b]]
            p, k = int(pivot[order[a]]), int(block[order[a]])
            parts = (ids[members].tobytes(), perms[members].tobytes(), packer.rows_of(members))
            for other in range(int(index.blocks[p])):
                rows.append((p, min(k, other), max(k, other), k, len(members), *parts))
                size += sum(map(len, parts))
                if size >= HANDED:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = blob.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            ids, values = _matrix(batch, dims)
            held.append((ids, values))
            size += len(ids)
            if size >= PACK:
                yield from pack(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), index)
                held, size = [], 0
        if size:
            yield from pack(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), index)

    return vectors.select("row_id", "embedding").mapInArrow(run, "pivot int, low int, high int, block int, n int, ids binary, perms binary, body binary")


def _best(row: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row: greater similarity, then smaller id."""
    order = np.lexsort((other, -sim, row))
    r = row[order]
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.concatenate((start, [len(r)]))))
    return order[place < k]


def _best_of_all(u: np.ndarray, ids: np.ndarray, block: np.ndarray, perms: np.ndarray, values: np.ndarray, across: bool, k: int, candidates: int | None, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, similarity): the k best of each row, however far they are."""
    n = len(u)
    norm = np.sqrt(np.einsum("ij,ij->i", values, values, dtype=np.float64))
    rows, others, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    # The k-th of the greatest of groups is no more than the k-th of all.
    wide = max(1, min(16, n // (4 * k)))
    step = _step(512, n)
    for i in range(0, n, step):
        s = u[i : i + step] @ u.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        if across:
            s[block[i : i + step, None] == block[None, :]] = -np.inf
        low = np.full(len(s), -2, np.float32)
        if candidates is None and n // wide > k:
            most = s[:, : n // wide * wide].reshape(len(s), wide, -1).max(1)
            low = np.maximum(low, np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k] - np.float32(1e-5))
        a, b = np.nonzero(s >= low[:, None])
        a += i
        if candidates is not None and len(a):
            few = _best(a, b, -footrule(perms[a], perms[b]).astype(np.float64), candidates)
            a, b = a[few], b[few]
        sim = np.empty(len(a))
        for j in range(0, len(a), 4096):
            x, y = a[j : j + 4096], b[j : j + 4096]
            sim[j : j + 4096] = np.einsum("ij,ij->i", values[x], values[y], dtype=np.float64) / (norm[x] * norm[y])
        sim = np.round(sim, digits)
        best = _best(a, ids[b], sim, k)
        rows.append(ids[a[best]])
        others.append(ids[b[best]])
        sims.append(sim[best])
    return np.concatenate(rows), np.concatenate(others), np.concatenate(sims)


def compare(ids: np.ndarray, block: np.ndarray, perms: np.ndarray, values: np.ndarray, pivot: int, across: bool, k: int, floor: float | None, candidates: int | None, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, similarity): for each row of a file its k best among the rows it meets here.

    Without a floor a pair may be given in each file that it meets in.
    """
    u = units(values)
    if floor is None:
        return _best_of_all(u, ids, block, perms, values, across, k, candidates, digits)
    n, norm = len(ids), np.sqrt(np.einsum("ij,ij->i", values, values, dtype=np.float64))

    def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sim = np.empty(len(a))
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096], b[i : i + 4096]
            sim[i : i + 4096] = np.einsum("ij,ij->i", values[x], values[y], dtype=np.float64) / (norm[x] * norm[y])
        return np.round(sim, digits)

    # Every pair is looked at, but only the best of each row so far are held, however many pairs a file has.
    best = _Best(n, k, ids, floor)
    later, earlier = (_Best(n, candidates or 0, np.arange(n), -np.inf) for _ in range(2))
    step = _step(512, n)
    for i in range(0, n, step):
        s = u[i : i + step] @ u[i:].T
        a, b = np.nonzero(s >= floor - 1e-5)
        keep = b > a
        if candidates is None:
            near = s[a, b] + np.float32(1e-5)
            keep &= (near >= best.low[a + i]) | (near >= best.low[b + i])
        a, b = a[keep] + i, b[keep] + i
        if across:
            keep = block[a] != block[b]
            a, b = a[keep], b[keep]
        # A pair is taken in the file of the smallest pivot that both share.
        shared = np.full(len(a), 1 << 15, np.int32)
        for x in range(perms.shape[1]):
            px = perms[a, x].astype(np.int32)
            hit = np.zeros(len(a), bool)
            for y in range(perms.shape[1]):
                hit |= px == perms[b, y]
            shared = np.where(hit, np.minimum(shared, px), shared)
        keep = shared == pivot
        a, b = a[keep], b[keep]
        for j in range(0, len(a), PAIRS):
            x, y = a[j : j + PAIRS], b[j : j + PAIRS]
            if candidates is None:
                best.add_both(x, y, cosine(x, y))
            else:
                apart = -footrules(perms, x, y).astype(np.float64)
                later.add(x, y, apart)
                earlier.add(y, x, apart)
    if candidates is not None:
        (a, b, _), (d, c, _) = later.all(), earlier.all()
        both = np.unique(np.concatenate((a * n + b, c * n + d)))
        for j in range(0, len(both), PAIRS):
            x, y = both[j : j + PAIRS] // n, both[j : j + PAIRS] % n
            best.add_both(x, y, cosine(x, y))
    row, other, sim = best.all()
    return ids[row], ids[other], sim


def footrules(perms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """footrule of the rows a and b of perms, in blocks to bound memory."""
    parts = [footrule(perms[a[i : i + 16384]], perms[b[i : i + 16384]]) for i in range(0, len(a), 16384)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class _Best:
    """The k pairs of each of n rows with the greatest scores from least on; ties go to the smaller name of the other row."""

    def __init__(self, n: int, k: int, names: np.ndarray, least: float):
        self.k, self.names, self.low = k, names, np.full(n, least)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, row: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.low[row]
        self.new.append((row[keep], other[keep], score[keep]))
        self.size += int(keep.sum())
        if self.size >= PAIRS:
            self._reduce()

    def add_both(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        self.add(a, b, score)
        self.add(b, a, score)

    def _reduce(self) -> None:
        row, other, score = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
        self.new, self.size = [], 0
        at = _best(row, self.names[other], score, self.k)
        row, other, score = self.kept = row[at], other[at], score[at]
        # A row's places are in order, so a row with k of them has the least at its last.
        full = np.flatnonzero(row[self.k - 1 :] == row[: max(0, len(row) - self.k + 1)]) + self.k - 1
        self.low[row[full]] = score[full]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._reduce()
        return self.kept


def nearest(vectors: DataFrame, k: int = 10, dims: int = 384, floor: float | None = 0.6, skip: DataFrame | None = None, candidates: int | None = None, digits: int = 9, pivots_a_root: float = PIVOTS_A_ROOT, length: int | None = None) -> DataFrame:
    """row_id, other and similarity: the k most similar vectors of every vector of vectors (row_id, embedding).

    Similarity is the cosine, rounded to digits; ties go to the smaller row_id. Rows of skip, null vectors, vectors of
    another length, with nulls or numbers that aren't finite, and all zeros take no part; no usable vectors give no
    rows. Neighbours below floor aren't given; None gives the k most similar however far they are. candidates, if set, keeps only so many of each row's candidates of a
    file, those with the smallest footrule distance; by default all are ranked by the exact cosine.

    Of equal vectors only the k + 1 with the smallest row_id are posted: each further copy has the first k as its
    neighbours and is nobody's, so a third of all rows may be copies. Some neighbours are missed where two vectors
    share none of their nearest pivots; see the README for the measured share.
    """
    spark = vectors.sparkSession
    if skip is not None:
        few = skip.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
        vectors = vectors.join(F.broadcast(skip) if few else skip, "row_id", "left_anti")
    pivots = fit(vectors, dims, vectors.count(), pivots_a_root, length)
    if not len(pivots.units):
        return spark.createDataFrame([], "row_id long, other long, similarity double")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in group["ids"]])
        perms = np.concatenate([np.frombuffer(x, np.int16).reshape(n, -1) for x, n in zip(group["perms"], group["n"], strict=True)])
        values = np.concatenate([_unpack(x, n) for x, n in zip(group["body"], group["n"], strict=True)])
        block = np.repeat(group["block"].to_numpy(), group["n"].to_numpy())
        keep = np.sort(_first_copies(ids, _hashes(values), k + 1))
        ids, block, perms, values = ids[keep], block[keep], perms[keep], values[keep]
        row, other, sim = compare(ids, block, perms, values, key[0], key[1] != key[2], k, floor, candidates, digits)
        return pd.DataFrame({"row_id": row, "other": other, "similarity": sim})

    posts = _postings(vectors, pivots, dims, k + 1)
    # There are far more files than tasks; by default shuffle partitions may be too few for the memory of one.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(pivots.blocks.sum() / 32))
    found = posts.repartition(parts, "pivot", "low", "high").groupBy("pivot", "low", "high").applyInPandas(run, "row_id long, other long, similarity double")
    best = Window.partitionBy("row_id").orderBy(F.desc("similarity"), "other")
    # Without a floor a pair may come from several files; the copies share a rank.
    top = found.withColumn("place", (F.row_number() if floor is not None else F.dense_rank()).over(best)).where(F.col("place") <= k).drop("place")
    if floor is None:
        top = top.dropDuplicates(["row_id", "other"])
    # Copies beyond the posted ones. The numbers are looked at only where many vectors are equal.
    same = vectors.where(F.size("embedding") == dims).select("row_id", "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    many = materialize(same.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h1", "h2"), "copies")
    if many.isEmpty():
        return top
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    copies = same.join(many, ["h1", "h2"], "left_semi").where(finite).select("row_id", "h1", "h2")
    place = Window.partitionBy("h1", "h2").orderBy("row_id")
    firsts = materialize(copies.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1), "first-copies")
    later = copies.join(firsts.select("row_id"), "row_id", "left_anti")
    rest = later.join(firsts.where(F.col("place") <= k).select("h1", "h2", F.col("row_id").alias("other")), ["h1", "h2"])
    return top.unionByName(rest.select("row_id", "other", F.lit(1.0).alias("similarity")))
