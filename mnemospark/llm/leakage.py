"""Evaluation passages inside documents (problem 8).

Passages and documents are cut into windows of an item's size, one at every word, and every window gets a SimHash of
its weighted shingles. The fingerprints of the items are indexed by RADIUS + 1 blocks of bits: two fingerprints that
differ in at most RADIUS bits agree in a whole block, so the index misses none of them. An edited word moves a
fingerprint further than that, so every window that could reach the threshold is also looked up by its shingles. What
is found is verified on the windows themselves: word for word, and by the weighted overlap of their shingles.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.neardup import Shingler

#: Bits in which fingerprints may differ; with 64 bits this makes blocks of 16 bits, which index an array directly.
RADIUS = 3
#: Items are taken in blocks of at most so many passages; each block is one pass over the documents, so what goes with the tasks is bounded.
ITEMS_A_PASS = 20_000
#: Words handled at once: bounds the memory of the bit counts, 64 numbers a word.
WORDS_AT_ONCE = 60_000
#: Weights of shingles are whole numbers, so that sums don't depend on the order of addition.
MAX_WEIGHT = 8
#: Windows of a document compared with one item at once: bounds memory.
WINDOWS_AT_ONCE = 256


@dataclass
class Index:
    window: int
    size: int
    items: list[str]
    words: np.ndarray  # a row of word hashes for each window
    item: np.ndarray  # the item of each window
    prints: np.ndarray
    starts: np.ndarray  # for each block, where the windows of each value of its 16 bits start in order
    order: np.ndarray
    keys: np.ndarray  # shingles of the items, sorted, and their weights
    weights: np.ndarray
    grams: list[np.ndarray] = field(default_factory=list)  # the shingles of each item with windows
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the first window of each of them
    post_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # for each key, where its postings start
    posts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # places in grams of the items with the key


def _weigh(grams: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(grams), MAX_WEIGHT, np.int32)
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    return np.where(keys[at] == grams, weights[at], MAX_WEIGHT).astype(np.int32)


def fingerprints(grams: np.ndarray, weights: np.ndarray, run: int) -> np.ndarray:
    """The SimHash of every run of so many shingles in a row."""
    n = len(grams) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1).view(bool)
    w = weights.astype(np.int16)[:, None]
    # Running sums may pass the ends of 16 bits; what a run adds up to doesn't, so differences are right.
    total = np.zeros((len(grams) + 1, 64), np.int16)
    np.cumsum(np.where(bits, w, -w), axis=0, dtype=np.int16, out=total[1:])
    return np.packbits(total[run:] - total[:-run] > 0, axis=1).view(np.uint64).ravel()


def build(items: list[tuple[str, str]], window: int, size: int) -> Index:
    """Index the passages of items (id, passage). A shorter passage than a window has no windows."""
    shingler = Shingler(size)
    words = [(i, shingler.words(p)) for i, p in items if p]
    df: Counter = Counter()
    grams_of = []
    for _, w in words:
        grams = shingler.shingles(w)
        grams_of.append(grams)
        df.update(set(grams.tolist()))
    keys = np.asarray(sorted(df), dtype=np.uint64)
    top = log(1 + len(words)) or 1.0
    weights = np.asarray([max(1, round(MAX_WEIGHT * log(1 + len(words) / df[k]) / (top * 1.0001))) for k in keys.tolist()], dtype=np.int32)
    run = window - size + 1
    rows, item, prints = [], [], []
    for k, ((_, w), grams) in enumerate(zip(words, grams_of, strict=True)):
        fp = fingerprints(grams, _weigh(grams, keys, weights), run)
        if len(fp):
            rows.append(np.lib.stride_tricks.sliding_window_view(w, window))
            item.append(np.full(len(fp), k, np.int32))
            prints.append(fp)
    held = [g for g in grams_of if len(g) >= run]
    names = [i for i, _ in words]
    if not rows:
        z = np.zeros(0, np.uint64)
        return Index(window, size, names, np.zeros((0, window), np.uint64), z.astype(np.int32), z, np.zeros((RADIUS + 1, 65537), np.int64), np.zeros((RADIUS + 1, 0), np.int64), keys, weights)
    fp = np.concatenate(prints)
    starts, order = [], []
    for b in range(RADIUS + 1):
        value = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        order.append(np.argsort(value, kind="stable"))
        starts.append(np.searchsorted(value[order[-1]], np.arange(65537)))
    first = np.cumsum([0, *(len(g) - run + 1 for g in held)])[:-1]
    key = np.concatenate([np.searchsorted(keys, np.unique(g)) for g in held])
    of = np.repeat(np.arange(len(held)), [len(np.unique(g)) for g in held])
    by = np.argsort(key, kind="stable")
    return Index(window, size, names, np.concatenate(rows), np.concatenate(item), fp, np.stack(starts), np.stack(order), keys, weights, held, first, np.searchsorted(key[by], np.arange(len(keys) + 1)), of[by])


def near(index: Index, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, indexed window) of all fingerprints within RADIUS bits of each other, each pair once."""
    found = []
    for b in range(RADIUS + 1):
        value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
        low, high = index.starts[b][value], index.starts[b][value + 1]
        n = high - low
        hit = np.flatnonzero(n)
        if not len(hit):
            continue
        query = np.repeat(hit, n[hit])
        first = np.cumsum(n[hit]) - n[hit]
        other = index.order[b][np.repeat(low[hit], n[hit]) + np.arange(len(query)) - np.repeat(first, n[hit])]
        close = np.bitwise_count(prints[query] ^ index.prints[other]) <= RADIUS
        found.append(query[close].astype(np.int64) << 32 | other[close])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(found))
    return pairs >> 32, pairs & 0xFFFFFFFF


def located(index: Index, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the shingles stand among those of the items, and whether they are there."""
    if not len(index.keys):
        return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
    at = np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)
    return at, index.keys[at] == grams


def alike(index: Index, grams: np.ndarray, inside: np.ndarray, threshold: float, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle, indexed window) of all windows whose weighted overlap may reach the threshold; none that does is missed.

    inside has the first shingles of windows that lie in one text; at and known are those of located(). The overlap is at most the weight of the shingles
    that are found in the other window, over the weight of the heavier window.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(inside) or not len(index.keys) or not len(index.grams):
        return none
    run = index.window - index.size + 1
    w = np.where(known, index.weights[at], MAX_WEIGHT).astype(np.int64)
    total, shared = np.concatenate(([0], np.cumsum(w))), np.concatenate(([0], np.cumsum(w * known)))
    weight = total[inside + run] - total[inside]
    # Shingles of no item are in no item's window.
    live = shared[inside + run] - shared[inside] >= threshold * weight - 1e-9
    inside, weight = inside[live], weight[live]
    left, right = [], []
    for a in range(0, len(inside), WINDOWS_AT_ONCE):
        first, heavy = inside[a : a + WINDOWS_AT_ONCE], weight[a : a + WINDOWS_AT_ONCE]
        places = first[:, None] + np.arange(run)
        window, place = np.nonzero(known[places])
        key = at[places[window, place]]
        n = index.post_starts[key + 1] - index.post_starts[key]
        owner = index.posts[np.repeat(index.post_starts[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pair, inverse = np.unique(np.repeat(window, n) * len(index.grams) + owner, return_inverse=True)
        common = np.bincount(inverse, weights=np.repeat(index.weights[key], n))
        pair = pair[common >= threshold * heavy[pair // len(index.grams)] - 1e-9]
        for item in np.unique(pair % len(index.grams)).tolist():
            mine = pair[pair % len(index.grams) == item] // len(index.grams)
            have = index.grams[item]
            distinct, number = np.unique(have, return_inverse=True)
            windows = np.lib.stride_tricks.sliding_window_view(number, run)
            holds = np.zeros((len(distinct) + 1, len(windows)), bool)
            holds[windows.T, np.arange(len(windows))] = True
            asked = grams[places[mine]]
            where = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
            where = np.where(distinct[where] == asked, where, len(distinct))
            most = np.zeros((len(mine), len(windows)), np.int64)
            for k in range(run):
                most += w[places[mine, k]][:, None] * holds[where[:, k]]
            own = _weigh(have, index.keys, index.weights).astype(np.int64)
            own = np.lib.stride_tricks.sliding_window_view(own, run).sum(1)
            x, y = np.nonzero(most >= threshold * np.maximum(heavy[mine][:, None], own[None, :]) - 1e-9)
            left.append(first[mine[x]])
            right.append(index.owner[item] + y)
    return (np.concatenate(left), np.concatenate(right)) if left else none


def _similarity(shingler: Shingler, a: np.ndarray, b: np.ndarray, index: Index) -> float:
    """Weighted overlap of the shingles of two windows, with their multiplicity."""
    x, y = Counter(shingler.shingles(a).tolist()), Counter(shingler.shingles(b).tolist())
    keys = np.asarray(list(x | y), dtype=np.uint64)
    w = _weigh(keys, index.keys, index.weights)
    least = sum(int(v) * min(x[k], y[k]) for k, v in zip(keys.tolist(), w, strict=True))
    most = sum(int(v) * max(x[k], y[k]) for k, v in zip(keys.tolist(), w, strict=True))
    return least / most if most else 0.0


def scan(texts: list[str], index: Index, shingler: Shingler, threshold: float) -> list[tuple[int, int, int, float, int]]:
    """(text, item, windows word for word, best similarity, first word) for every text and item that share a window."""
    out: dict[tuple[int, int], list] = {}
    if not len(index.prints):
        return []
    run = index.window - index.size + 1
    lengths: list[int] = []
    held: list[np.ndarray] = []
    first = 0

    def flush() -> None:
        nonlocal first
        if not held:
            return
        words = np.concatenate(held)
        grams = shingler.shingles(words)
        ends = np.cumsum(lengths)
        begins = ends - np.asarray(lengths)
        at, known = located(index, grams)
        windows = max(0, len(grams) - run + 1)
        owner = np.searchsorted(ends, np.arange(windows), side="right")
        # A window without a shingle of any item is like no item's window, whatever its fingerprint.
        count = np.concatenate(([0], np.cumsum(known)))
        inside = np.flatnonzero((np.arange(windows) + index.window <= ends[np.minimum(owner, len(ends) - 1)]) & (count[run:] > count[:windows]) if windows else [])
        edges = np.bincount(inside, minlength=len(grams) + 1)[: len(grams) + 1] - np.bincount(inside + run, minlength=len(grams) + 1)[: len(grams) + 1]
        needed = np.cumsum(edges)[: len(grams)] > 0
        fp = fingerprints(grams[needed], np.where(known, index.weights[at], MAX_WEIGHT)[needed].astype(np.int32), run) if len(inside) else np.zeros(0, np.uint64)
        query, other = near(index, fp[(np.cumsum(needed) - 1)[inside]] if len(inside) else fp)
        more, windows = alike(index, grams, inside, threshold, at, known)
        pairs = np.unique(np.concatenate((inside[query] << 32 | other, more << 32 | windows)))
        query, other = pairs >> 32, pairs & 0xFFFFFFFF
        if len(query):
            rows = words[query[:, None] + np.arange(index.window)]
            same = (rows == index.words[other]).all(1)
            for q, o, equal in zip(query.tolist(), other.tolist(), same.tolist(), strict=True):
                key = (first + int(owner[q]), int(index.item[o]))
                old = out.get(key)
                score = 1.0 if equal else (0.0 if old and old[1] >= 1.0 else _similarity(shingler, words[q : q + index.window], index.words[o], index))
                if score < threshold:
                    continue
                place = q - int(begins[owner[q]])
                if old:
                    old[0] += equal
                    old[1] = max(old[1], score)
                    old[2] = min(old[2], place)
                else:
                    out[key] = [int(equal), score, place]
        first += len(held)
        held.clear()
        lengths.clear()

    size = 0
    for text in texts:
        words = shingler.words(text or "")
        if size and size + len(words) > WORDS_AT_ONCE:
            flush()
            size = 0
        held.append(words)
        lengths.append(len(words))
        size += len(words)
    flush()
    return [(t, i, v[0], v[1], v[2]) for (t, i), v in sorted(out.items())]


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 24, size: int = 5, threshold: float = 0.8, key: str = "doc_id") -> DataFrame:
    """key, case_id, exact_windows, similarity and first_word for every document that holds a window of an item.

    items has id and passage. exact_windows counts the pairs of windows that are equal word for word, similarity is the
    best weighted overlap of two windows, threshold at least. Null and short texts and passages give nothing, repeated
    items count once. Documents are read once for each ITEMS_A_PASS items and never shuffled.
    """
    spark = documents.sparkSession
    rows = items.where("id IS NOT NULL AND passage IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.col("passage").cast("string").alias("passage")).distinct()
    passes = max(1, -(-rows.count() // ITEMS_A_PASS))
    name = documents.schema[key]
    out = None
    for k in range(passes):
        part = rows.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k).collect()
        blob = spark.sparkContext.broadcast(pickle.dumps(build(sorted((r[0], r[1]) for r in part), window, size)))

        def run(batches: Iterator[pd.DataFrame], blob=blob) -> Iterator[pd.DataFrame]:
            index, shingler = pickle.loads(blob.value), Shingler(size)
            for batch in batches:
                found = scan(batch["__text"].tolist(), index, shingler, threshold)
                if not found:
                    continue
                yield pd.DataFrame(
                    {
                        key: batch[key].iloc[[f[0] for f in found]].tolist(),
                        "case_id": [index.items[f[1]] for f in found],
                        "exact_windows": [f[2] for f in found],
                        "similarity": [f[3] for f in found],
                        "first_word": [f[4] for f in found],
                    }
                )

        found = documents.select(key, F.col("text").cast("string").alias("__text")).mapInPandas(
            run, f"`{key}` {name.dataType.simpleString()}, case_id string, exact_windows long, similarity double, first_word int"
        )
        out = found if out is None else out.unionByName(found)
    return out
