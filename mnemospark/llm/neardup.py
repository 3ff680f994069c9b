"""Near-duplicate records by bottom-k sketches (problem 7).

Every text is the set of its word shingles, hashed by one function; its sketch is the SKETCH smallest hashes. Two sets
that are similar enough share so many values of their sketches that it is enough to retain some of each: the rarest,
by counters of all texts, as many as guarantee a shared one. Inverted lists of the retained values give candidates;
bounds from the places of the shared value and from a bitmap of each set drop most of them in the join. The union of
two sketches estimates the overlap of a pair, the sets themselves verify it. Sets no greater than their sketch are
known whole, so that nothing is left to chance; beyond, a pair is lost once in 10**9 (SIGMAS). Texts with the same set
are one class, and only classes are compared. No list is capped: a long one is cut into blocks, and every two blocks
are joined by themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, floor, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.conversations import pointer_jump
from mnemospark.llm.prose import WORD
from mnemospark.storage import materialize, release

#: There are 2**COUNTER_BITS counters, whatever the input, kept as logarithms in SCALE steps a nat: however full they
#: are, what many texts hold stands out. Collisions cost time, never a pair.
COUNTER_BITS, CHUNKS, SCALE = 22, 32, 1500
#: Bits of a shingle's hash: two sets of a thousand shingles have a false match in one of 10**8 pairs.
HASH_BITS = 48
#: Values of a bottom-k sketch, and standard deviations below the threshold at which a pair is left.
SKETCH, SIGMAS = 2_048, 6.0
#: Values of a block of an inverted list, and posts a task of the join should get.
LIST, POSTS_A_TASK = 2_000, 1_000_000
#: All pairs among the first so many copies of one set; each further copy is paired with the first.
COPIES = 32


class WordHashes(dict):
    """The hash of each word, worked out once."""

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        h = self[word] = zlib.crc32(raw) | (zlib.crc32(raw, 0x9E3779B9) ^ len(raw)) << 32
        return h


class Shingler:
    """Sets of hashed shingles of texts; hashes of words are kept between texts."""

    LIMIT = 1_000_000

    def __init__(self, size: int, seed: int = 0, bits: int = 64):
        self.size, self.seed, self.bits, self.known = size, seed, bits, WordHashes()

    def words(self, text: str) -> np.ndarray:
        found = WORD.findall(text.lower())
        if len(self.known) > self.LIMIT:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """The hash of every run of size words, in order."""
        n = len(words) - self.size + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = np.full(n, (self.seed * 2 + 1) & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for k in range(self.size):
                h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            return h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)


def shingle_sets(texts: DataFrame, size: int, min_words: int) -> DataFrame:
    """tbl, id, cls, n, grams of texts (tbl, id, content) with at least min_words words.

    grams holds the distinct hashes, sorted, as 8 bytes each; cls is the hash of the set. Null, empty and shorter texts
    are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shinglers: dict[str, Shingler] = {}
        for batch in batches:
            rows = []
            for tbl, id_, text in zip(batch["tbl"], batch["id"], batch["content"], strict=True):
                s = shinglers.get(tbl)
                if s is None:
                    s = shinglers[tbl] = Shingler(size, zlib.crc32(tbl.encode()), HASH_BITS)
                words = s.words(text)
                if len(words) >= max(min_words, size):
                    grams = np.unique(s.shingles(words))
                    raw = grams.tobytes()
                    cls = (zlib.crc32(raw) | (zlib.crc32(raw, 7) ^ zlib.adler32(raw)) << 32) & 0xFFFFFFFFFFFFFFFF
                    with np.errstate(over="ignore"):
                        cls ^= int(np.bitwise_xor.reduce(grams * np.uint64(0xBF58476D1CE4E5B9)))
                    rows.append((tbl, id_, cls - (1 << 64) if cls >> 63 else cls, len(grams), raw))
            yield pd.DataFrame(rows, columns=["tbl", "id", "cls", "n", "grams"])

    return texts.where("id IS NOT NULL AND content IS NOT NULL").select("tbl", "id", "content").mapInPandas(run, "tbl string, id string, cls long, n int, grams binary")


def count_values(sets: DataFrame, bits: int = COUNTER_BITS, sketch: int = SKETCH) -> np.ndarray:
    """About how many sketches hold a value, at least as many as do, by its lowest bits: logarithms of counters."""
    size = 1 << bits
    step = size // CHUNKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            if len(batch):
                values = np.frombuffer(b"".join(g[: 8 * sketch] for g in batch["grams"]), np.uint64)
                total += np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint32)
        parts = [(i, total[i * step : (i + 1) * step]) for i in range(CHUNKS)]
        yield pd.DataFrame([(i, zlib.compress(p.tobytes(), 1)) for i, p in parts if p.any()], columns=["chunk", "counts"])

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.float64)
        for raw in group["counts"]:
            total += np.frombuffer(zlib.decompress(raw), np.uint32)
        logs = np.minimum(np.ceil(np.log1p(total) * SCALE), 65535).astype(np.uint16)
        return pd.DataFrame([(key[0], zlib.compress(logs.tobytes(), 1))], columns=["chunk", "counts"])

    parts = sets.select("grams").mapInPandas(count, "chunk int, counts binary")
    rows = parts.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    out = np.zeros(size, np.uint16)
    for chunk, raw in rows:
        out[chunk * step : (chunk + 1) * step] = np.frombuffer(zlib.decompress(raw), np.uint16)
    return out


def shared_at_least(n: np.ndarray, threshold: float, sketch: int = SKETCH) -> np.ndarray:
    """How many values the sketch of a set of n at least shares with that of any set that is similar enough.

    If all values of both fit a sketch, the threshold's share of n; else what SKETCH values of the union have in common
    but for SIGMAS deviations.
    """
    whole = np.ceil(threshold * n - 1e-9)
    drawn = floor(threshold * sketch - SIGMAS * sqrt(threshold * (1 - threshold) * sketch))
    return np.where(n <= threshold * sketch, whole, np.minimum(whole, max(1, drawn))).astype(np.int64)


def _bitmaps(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Two numbers of 64 bits for each set, with the bit of every hash set."""
    bits = (grams >> np.uint64(HASH_BITS - 7)).astype(np.int64)
    flags = np.zeros((n, 128), np.uint8)
    flags[owner, bits] = 1
    return np.packbits(flags, axis=1).view(np.int64)


def retained(sets: DataFrame, counts: np.ndarray, threshold: float, sketch: int = SKETCH, block_size: int = LIST) -> DataFrame:
    """gram, block, cls, n, place, map1, map2 for every value that a text retains and another may hold.

    place is that of the value in the sketch, rarest first. A long list is cut into blocks by the class; a value then
    stands once for every two blocks that its own meets, with a gram for each two, and block is its own, or -1 where
    all of its list is to be compared.
    """
    noise = float(np.expm1(counts / SCALE).mean())
    blob = sets.sparkSession.sparkContext.broadcast(zlib.compress(counts.tobytes(), 1))
    mask, single = np.uint64(len(counts) - 1), int(np.ceil(np.log1p(1) * SCALE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.frombuffer(zlib.decompress(blob.value), np.uint16)
        for batch in batches:
            if not len(batch):
                continue
            n = batch["n"].to_numpy().astype(np.int64)
            size = np.minimum(n, sketch)
            values = np.frombuffer(b"".join(g[: 8 * sketch] for g in batch["grams"]), np.uint64)
            owner = np.repeat(np.arange(len(n)), size)
            often = seen[(values & mask).astype(np.int64)]
            order = np.lexsort((values, often, owner))
            place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            keep = size - shared_at_least(n, threshold, sketch) + 1
            order, place = order[place < keep[owner]], place[place < keep[owner]]
            order, place = order[often[order] > single], place[often[order] > single]
            of = owner[order]
            cls = batch["cls"].to_numpy()[of]
            # Both sides of a pair read the same counter, so they cut its list alike.
            blocks = np.maximum(1, np.ceil((np.expm1(often[order] / SCALE) - noise) / block_size)).astype(np.int64)
            block = (cls.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
            again = np.repeat(np.arange(len(order)), blocks)
            other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            maps = _bitmaps(np.frombuffer(b"".join(batch["grams"]), np.uint64), np.repeat(np.arange(len(n)), n), len(n))
            low, high = np.minimum(block[again], other).astype(np.uint64), np.maximum(block[again], other).astype(np.uint64)
            with np.errstate(over="ignore"):
                gram = values[order][again] ^ ((low << np.uint64(20) | high) * np.uint64(0xBF58476D1CE4E5B9))
            yield pd.DataFrame(
                {
                    "gram": gram.view(np.int64),
                    "block": np.where(low == high, -1, block[again]).astype(np.int32),
                    "cls": cls[again],
                    "n": n[of][again].astype(np.int32),
                    "place": place[again].astype(np.int32),
                    "map1": maps[of, 0][again],
                    "map2": maps[of, 1][again],
                }
            )

    return sets.select("cls", "n", "grams").mapInPandas(run, "gram long, block int, cls long, n int, place int, map1 long, map2 long")


def estimate(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> float:
    """Jaccard similarity of two sorted sets by the union of their sketches; exact where the union fits a sketch."""
    a, b = a[:sketch], b[:sketch]
    same = np.intersect1d(a, b, assume_unique=True)
    size = len(a) + len(b) - len(same)
    if size <= sketch:
        return len(same) / size
    # The last value of the union's sketch; what both hold up to it is in all three sketches.
    last = np.partition(np.concatenate((a, np.setdiff1d(b, same, assume_unique=True))), sketch - 1)[sketch - 1]
    return int(np.searchsorted(same, last, side="right")) / sketch


def overlap(a: np.ndarray, b: np.ndarray, threshold: float, sketch: int = SKETCH) -> float:
    """Jaccard similarity of two sorted sets; 0 if the estimate is so far below the threshold that it can't be reached."""
    about = estimate(a, b, sketch)
    if about < threshold - SIGMAS * sqrt(threshold * (1 - threshold) / sketch):
        return 0.0
    if max(len(a), len(b)) <= sketch and (len(a) + len(b)) / (1 + about) <= sketch:  # the union fits
        return about
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def similar_classes(sets: DataFrame, threshold: float, sketch: int = SKETCH, block_size: int = LIST) -> DataFrame:
    """cls_a < cls_b and similarity of every two different sets that overlap by the threshold. sets must be written."""
    spark = sets.sparkSession
    most = sets.agg(F.sum(F.least(F.ceil((1 - threshold) * F.col("n")) + 1, F.lit(sketch)))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(most / POSTS_A_TASK))
    posts = retained(sets, count_values(sets, sketch=sketch), threshold, sketch, block_size).repartition(parts, "gram")
    a, b = posts.alias("a"), posts.alias("b")
    sizes = F.col("a.n") + F.col("b.n")
    # The overlap that the threshold asks for, and what of it the sketches share at least; what the places after the
    # shared value, and bits that only one set has, leave of it.
    least = F.ceil(F.lit(threshold / (1 + threshold)) * sizes - 1e-9)
    drawn = max(1, floor(threshold * sketch - SIGMAS * sqrt(threshold * (1 - threshold) * sketch)))
    common = F.when(F.greatest("a.n", "b.n") <= sketch, least).otherwise(F.least(least, F.lit(drawn)))
    apart = F.bit_count(F.col("a.map1").bitwiseXOR(F.col("b.map1"))) + F.bit_count(F.col("a.map2").bitwiseXOR(F.col("b.map2")))
    left = [F.least(F.col(f"{x}.n"), F.lit(sketch)) - F.col(f"{x}.place") for x in "ab"]
    fits = (left[0] >= common) & (left[1] >= common) & (sizes - apart >= 2 * least)
    once = (F.col("a.block") == -1) | (F.col("a.block") != F.col("b.block"))
    joined = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.cls") < F.col("b.cls")) & once & fits)
    pairs = materialize(joined.select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")).distinct(), "candidates")
    del joined, posts, a, b
    release(spark)
    # Only the sets that some candidate needs are moved, each once.
    needed = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    bodies = sets.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min("grams").alias("grams"))
    bodies = materialize(bodies, "sets-compared")
    release(spark)
    both = pairs.join(bodies.select(F.col("cls").alias("cls_a"), F.col("grams").alias("grams_a")), "cls_a").join(
        bodies.select(F.col("cls").alias("cls_b"), F.col("grams").alias("grams_b")), "cls_b"
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            found = [overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold, sketch) for x, y in zip(batch["grams_a"], batch["grams_b"], strict=True)]
            out = batch[["cls_a", "cls_b"]].assign(similarity=found)
            yield out[out["similarity"] >= threshold - 1e-12]

    return both.select("cls_a", "cls_b", "grams_a", "grams_b").mapInPandas(verify, "cls_a long, cls_b long, similarity double")


def near_duplicates(texts: DataFrame, size: int = 5, threshold: float = 0.8, min_words: int = 0, sketch: int = SKETCH, block_size: int = LIST) -> tuple[DataFrame, DataFrame]:
    """(members, links): tbl, id, cls of every text that takes part, and the similar classes.

    Repeated rows of an id count once. Texts of different tables aren't compared. Both results are written.
    """
    sets = materialize(shingle_sets(texts, size, min_words), "shingles")
    links = materialize(similar_classes(sets, threshold, sketch, block_size), "similar")
    return sets.select("tbl", "id", "cls").distinct(), links


def similar_pairs(texts: DataFrame, size: int = 5, threshold: float = 0.8, min_words: int = 0, copies: int | None = COPIES, sketch: int = SKETCH, block_size: int = LIST) -> DataFrame:
    """tbl, id_a < id_b of texts whose sets overlap by the threshold.

    Copies of one set are paired with each other among the first copies by id, every further copy with the first, and
    the first copies stand for a class in its links to others. So no link between different texts is lost, and a class
    that holds a third of all texts gives as many rows as it has members. None gives every pair of texts, however many
    those are.
    """
    members, links = near_duplicates(texts, size, threshold, min_words, sketch, block_size)
    members = materialize(members, "members")
    faces = members.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy("id")))
    faces = faces if copies is None else faces.where(F.col("place") <= copies)
    faces = materialize(faces, "faces")
    a = faces.select("tbl", F.col("cls").alias("cls_a"), F.col("id").alias("x"))
    b = faces.select(F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    across = links.join(a, "cls_a").join(b, "cls_b").select("tbl", "x", "y")
    within = a.join(b, F.col("cls_a") == F.col("cls_b")).where("x < y").select("tbl", "x", "y")
    first = faces.where("place = 1").select("cls", F.col("id").alias("x"))
    later = members.join(faces.select("tbl", "id"), ["tbl", "id"], "left_anti").join(first, "cls").select("tbl", "x", F.col("id").alias("y"))
    rows = across.unionByName(within).unionByName(later)
    return rows.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) of the nodes of edges (a, b).

    Every round each node is hooked to the smallest label around it and pointers are jumped to their roots, so the
    number of rounds grows with the logarithm of the longest path; edges within a component leave the work.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = materialize(nodes.select("node", F.col("node").alias("component")), "labels-0")
    live = edges.select("a", "b").where("a <> b").distinct()
    for turn in range(1, max_rounds + 1):
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).where("low < a").select(F.col("a").alias("id"), F.col("low").alias("parent"))
        if low.isEmpty():
            break
        roots = live.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(low, "id", "left").select("id", "parent", F.lit(1).alias("weight"))
        up = materialize(pointer_jump(roots).select(F.col("id").alias("was"), F.col("root").alias("now")), f"hooks-{turn}")
        label = materialize(
            label.join(up, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component")), f"labels-{turn}"
        )
        moved = live.join(up.select(F.col("was").alias("a"), F.col("now").alias("a2")), "a").join(up.select(F.col("was").alias("b"), F.col("now").alias("b2")), "b")
        live = materialize(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), f"edges-{turn}")
    return label


def duplicate_groups(texts: DataFrame, size: int = 5, threshold: float = 0.8, min_words: int = 0, sketch: int = SKETCH, block_size: int = LIST) -> DataFrame:
    """tbl, id, cls, links, group_id for every text that takes part: its class, the number of other classes that are
    similar, and the class that names its group (the smallest of all that links connect)."""
    members, links = near_duplicates(texts, size, threshold, min_words, sketch, block_size)
    joined = components(links.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))).select(F.col("node").alias("cls"), "component")
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    return (
        members.join(degree, "cls", "left")
        .join(joined, "cls", "left")
        .select("tbl", "id", "cls", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("group_id"))
    )
