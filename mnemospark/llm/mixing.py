"""Mixing sources to target weights (problem 9), with sizes in tokens of a public tokenizer.

Weights come from shares raised to an exponent. The exponent is bisected: towards a wanted entropy, or until no source
has to repeat a document more often than allowed. The weights become token budgets; a budget is met by whole passes over
a source and a part of one more, taken in the order of a permutation of blocks, so that only sums of blocks are ordered
and no source is ever sorted as a whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.secrets import SPLIT, VOCABULARY
from mnemospark.storage import materialize

#: Documents a block holds on average.
BLOCK = 1_000
#: Steps of a bisection: the exponent is then exact to twelve digits.
STEPS = 60


def source_name(source: Column) -> Column:
    """A source in one spelling: lower case, words joined by underscores; null if blank."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_-]+", "_")
    return F.when(plain != "", plain)


def count_tokens(documents: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents with tokens, the number of tokens of text; null and empty texts have 0. Whole texts are counted."""
    with open(vocabulary, "rb") as f:
        blob = documents.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.value.splitlines() if line)}
        encoding = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch])

    return documents.withColumn("tokens", count(F.col(text)))


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and made to add up to 1; sources without a share stay without one."""
    raised = {k: s**exponent for k, s in shares.items() if s > 0}
    total = sum(raised.values())
    return {k: raised.get(k, 0.0) / total if total else 0.0 for k in shares}


def entropy(shares: dict[str, float]) -> float:
    return -sum(s * log(s) for s in shares.values() if s > 0)


def for_entropy(shares: dict[str, float], wanted: float) -> dict[str, float]:
    """The tempered shares whose entropy is the wanted one, or the nearest that an exponent from 0 to 1 gives."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(tempered(shares, middle)) > wanted else (low, middle)
    return tempered(shares, (low + high) / 2)


def for_repeats(target: dict[str, float], room: dict[str, float], total: float) -> dict[str, float]:
    """Weights that need no more than room tokens of any source: the target, bent as little as the total asks for.

    room is the size of a source times its allowed repeats. At exponent 1 the weights are the target, at 0 they are
    proportional to room; between them they are target**e * room**(1-e). If even 0 is too much, the total is too large.
    """
    usable = {k: s for k, s in target.items() if s > 0 and room.get(k, 0) > 0}
    all_room = sum(room[k] for k in usable)

    def at(e: float) -> dict[str, float]:
        raised = {k: s**e * (room[k] / all_room) ** (1 - e) for k, s in usable.items()}
        whole = sum(raised.values())
        return {k: v / whole for k, v in raised.items()}

    def fits(w: dict[str, float]) -> bool:
        return all(w[k] * total <= room[k] * (1 + 1e-12) for k in w)

    if not usable or fits(at(1.0)):
        return at(1.0) if usable else {}
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(at(middle)) else (low, middle)
    return at(low)


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, wanted_entropy: float | str | None = None, stretch: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): doc_id, source, tokens and repeats of the chosen documents; and what each source got.

    targets has source, target_share and max_repeats; one row a source, rows without a source or a positive share are
    left out, max_repeats of null counts as 1. Shares of sources that have no tokens can't be met and are spread over the others in
    proportion. total is the number of tokens wanted; by default the most that meets all targets exactly. A larger total
    bends the targets by for_repeats; more than all sources allow is cut to that. A budget is undercut by less than
    one document. Sources are few by definition: their totals come to the driver, one row a target.

    With wanted_entropy the targets' own shares are set aside: the sources' shares of all tokens are tempered to that
    entropy, or with "targets" to the entropy that the targets have. stretch multiplies the default total, so that from
    1 on small sources reach their allowed repeats and the exponent of for_repeats is bisected as well.
    """
    wanted = targets.where("source IS NOT NULL AND target_share > 0").groupBy(source_name(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    sized = count_tokens(documents.select("doc_id", source_name(F.col("source")).alias("source"), "text"), "text").drop("text")
    sized = materialize(sized.join(F.broadcast(wanted.select("source")) if wanted.limit(10_001).count() <= 10_000 else wanted.select("source"), "source", "left_semi"), "tokens")
    sums = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}
    goals = {r[0]: (float(r[1]), int(r[2])) for r in wanted.collect()}
    have = {k: float(sums.get(k, (0, 0))[0] or 0) for k in goals}
    whole = sum(s for k, (s, _) in goals.items() if have[k] > 0)
    target = {k: s / whole if have[k] > 0 and whole else 0.0 for k, (s, _) in goals.items()}
    if wanted_entropy is not None:
        held = sum(have.values())
        target = for_entropy({k: v / held if held else 0.0 for k, v in have.items()}, entropy(target) if wanted_entropy == "targets" else float(wanted_entropy))
    room = {k: have[k] * max(0, goals[k][1]) for k in goals}
    most = min((room[k] / s for k, s in target.items() if s > 0), default=0.0)
    total = min(most * stretch if total is None else float(total), sum(room.values()))
    weights = for_repeats(target, room, total)
    plan = [(k, int(weights.get(k, 0.0) * total), int(have[k]), sums.get(k, (0, 0))[1] or 0, goals[k][0] if wanted_entropy is None else target[k], goals[k][1]) for k in sorted(goals)]
    spark = documents.sparkSession
    plans = spark.createDataFrame(plan, "source string, budget long, held long, documents long, target_share double, max_repeats int")
    plans = plans.withColumn("passes", F.when(F.col("held") > 0, F.floor(F.col("budget") / F.col("held"))).otherwise(F.lit(0)).cast("int")).withColumn(
        "rest", F.col("budget") - F.col("passes") * F.col("held")
    )
    # A document's block is a hash; the hash of a block is its place in the permutation.
    blocked = sized.join(F.broadcast(plans.select("source", "passes", "rest", F.greatest(F.lit(1), F.floor(F.col("documents") / BLOCK)).alias("blocks"))), "source")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    by_block = blocked.groupBy("source", "block", "rest").agg(F.sum("tokens").alias("size")).withColumn("order", F.xxhash64(F.lit(seed + 1), "source", "block"))
    before = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_block.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.select("source", "block", (F.col("before") + F.col("size") <= F.col("rest")).alias("taken"), (F.col("rest") - F.col("before")).alias("left"))
    inside = blocked.join(placed, ["source", "block"])
    # Only the block in which a budget ends is ordered by document.
    edge = inside.where("NOT taken AND left > 0")
    running = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), "doc_id")
    edge = edge.withColumn("once_more", F.sum("tokens").over(running) <= F.col("left"))
    rest = inside.where("taken OR left <= 0").withColumn("once_more", F.col("taken"))
    chosen = edge.unionByName(rest).select("doc_id", "source", "tokens", (F.col("passes") + F.col("once_more").cast("int")).alias("repeats"))
    chosen = materialize(chosen.where("repeats > 0 AND tokens > 0"), "mixture")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("chosen"), F.max("repeats").alias("most_repeats"))
    used = got.agg(F.sum("tokens")).first()[0] or 0
    shares = plans.join(got, "source", "left").select(
        "source",
        "target_share",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(used) or 1.0)).alias("actual_share"),
        F.coalesce("chosen", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "max_repeats",
        "budget",
    )
    return chosen, shares
