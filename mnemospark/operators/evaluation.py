"""Quality of search from ranked lists.

results has case_id, rank (from 1), turn_id, session_id, score; cases has case_id, expected_turn_ids,
expected_session_ids, forbidden_turn_ids. A case without results counts as a miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.storage import materialize


def judged(cases: DataFrame, results: DataFrame) -> DataFrame:
    """results with hit and forbidden: an item is a hit if its turn or its session is expected."""
    rows = results.join(cases.select("case_id", "expected_turn_ids", "expected_session_ids", "forbidden_turn_ids"), "case_id")
    has = lambda c, x: F.coalesce(F.array_contains(F.col(c), F.col(x)), F.lit(False))
    return rows.select(
        "case_id", "rank", "turn_id", "session_id", "score", (has("expected_turn_ids", "turn_id") | has("expected_session_ids", "session_id")).alias("hit"), has("forbidden_turn_ids", "turn_id").alias("forbidden")
    )


def first_hits(cases: DataFrame, items: DataFrame) -> DataFrame:
    """case_id and first: the rank of the first hit, or null."""
    first = items.groupBy("case_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return cases.select("case_id").join(first, "case_id", "left")


def hit_at(cases: DataFrame, items: DataFrame, ks: list[int]) -> DataFrame:
    """k and hit_rate: the share of cases with a hit among the first k."""
    share = lambda k: F.avg(F.coalesce(F.col("first") <= k, F.lit(False)).cast("double"))
    one = first_hits(cases, items).agg(*(F.coalesce(share(k), F.lit(0.0)).alias(str(k)) for k in ks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(str(k)).alias("hit_rate")) for k in ks))).alias("r")).select("r.*")


def mean_reciprocal_rank(cases: DataFrame, items: DataFrame) -> DataFrame:
    return first_hits(cases, items).agg(F.coalesce(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("mrr"), F.count("*").alias("cases"))


def sweep(cases: DataFrame, items: DataFrame, thresholds: list[float], limit: int) -> DataFrame:
    """One row for each threshold: what of the first limit items from that score on would be shown, and how good it is.

    The items are read once: an item counts for every threshold up to its score. As scores may not fall with the rank
    after penalties, the place among the items above a threshold is counted for each threshold.
    """
    steps = cases.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    rows = items.withColumn("threshold", F.explode(F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: t <= F.col("score"))))
    w = Window.partitionBy("threshold", "case_id").orderBy("rank")
    shown = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    by_case = shown.groupBy("threshold", "case_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("h"), F.count_if("forbidden").alias("f"))
    total = by_case.groupBy("threshold").agg(F.count("*").alias("showing"), F.count_if(F.col("h") > 0).alias("with_hit"), F.sum("n").alias("injected"), F.sum("h").alias("hits"), F.sum("f").alias("bad"))
    full = steps.join(total, "threshold", "left").na.fill(0).withColumn("cases", F.lit(max(1, cases.count())))
    precision = F.when(F.col("injected") > 0, F.col("hits") / F.col("injected")).otherwise(F.lit(1.0))
    found = F.col("with_hit") / F.col("cases")
    full = full.withColumns({"precision": precision, "case_hit_rate": found})
    below = F.lit(P.F_BETA2) * F.col("precision") + F.col("case_hit_rate")
    return full.select(
        "threshold",
        (F.col("showing") / F.col("cases")).alias("injection_rate"),
        (1 - F.col("showing") / F.col("cases")).alias("miss_rate"),
        "precision",
        (1 - F.col("precision")).alias("noise_rate"),
        F.when(F.col("injected") > 0, F.col("bad") / F.col("injected")).otherwise(F.lit(0.0)).alias("forbidden_rate"),
        "case_hit_rate",
        F.when(below > 0, (1 + P.F_BETA2) * F.col("precision") * F.col("case_hit_rate") / below).otherwise(F.lit(0.0)).alias("f05"),
        F.col("injected").cast("long").alias("injected"),
        F.col("hits").cast("long").alias("hits"),
    )


#: The thresholds of a sweep.
THRESHOLDS = [i / 100 for i in range(50, 96)]


def best(rows: DataFrame) -> DataFrame:
    """The row with the greatest f05, the lowest threshold among equals."""
    return rows.orderBy(F.desc(F.round("f05", 12)), "threshold").limit(1)


def histogram(items: DataFrame) -> DataFrame:
    """Ten buckets of scores from 0.5, clamped at both ends, with hits and misses; empty ones are kept."""
    spark = items.sparkSession
    number = F.greatest(F.lit(0), F.least(F.lit(9), F.floor((F.col("score") - 0.5) / 0.05))).cast("long")
    counts = items.groupBy(number.alias("number")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    name = F.format_string("%.2f-%.2f", 0.5 + F.col("number") * 0.05, 0.55 + F.col("number") * 0.05)
    return spark.range(10).withColumnRenamed("id", "number").join(counts, "number", "left").na.fill(0).select(name.alias("bucket"), "hits", "misses")


def failures(cases: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """Cases without a hit in the first k, with what was found instead, in order."""
    late = first_hits(cases, items).where(F.col("first").isNull() | (F.col("first") > k))
    got = items.where(F.col("rank") <= k).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("rank", "session_id"))).alias("got"))
    return late.join(got, "case_id", "left").select("case_id", F.coalesce(F.array_join(F.transform("got", lambda x: F.coalesce(x["session_id"], F.lit(""))), ","), F.lit("")).alias("got"))


def ordinal_ids(turns: DataFrame, prefix: str = "fx") -> DataFrame:
    """row_id and id of turns of a fixture: prefix, session and the turn's number in it, from 1 by arrival.

    Sessions of any size: turns are counted in ranges of (session, row_id), and the ranges of a session added up.
    """
    rows = turns.where("session_id IS NOT NULL").select("row_id", "session_id")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(parts, "session_id", "row_id").withColumn("range", F.spark_partition_id()), "fixture-ranges")
    sizes = placed.groupBy("session_id", "range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("session_id", "range").orderBy("row_id"))
    out = placed.withColumn("place", place).join(before.where("before > 0").select("session_id", "range", "before"), ["session_id", "range"], "left")
    number = (F.col("place") + F.coalesce("before", F.lit(0))).cast("string")
    return out.select("row_id", F.concat_ws(":", F.lit(prefix), F.col("session_id"), number).alias("id"))


def sample(turns: DataFrame, n: int, seed: int = 0, low: int = P.SEED_MIN, high: int = P.SEED_MAX) -> DataFrame:
    """n of the user's turns of a fitting length, to make cases of: those with the smallest hashes, the same whenever asked."""
    rows = turns.where((F.col("role") == "user") & F.length("content").between(low, high))
    return rows.orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(n)


def expected_ids(cases: DataFrame) -> DataFrame:
    """case_id and ids: the sessions and turns that a case expects, each once in order."""
    none = F.array().cast("array<string>")
    return cases.select("case_id", F.array_distinct(F.concat(F.coalesce("expected_session_ids", none), F.coalesce("expected_turn_ids", none))).alias("ids"))


def write_lines(rows: DataFrame, path: str, append: bool = True) -> None:
    """Labels, candidates or cases as lines of JSON below path; a null value is left out."""
    rows.write.mode("append" if append else "overwrite").json(path)


def report(cases: DataFrame, items: DataFrame, queries: DataFrame | None = None, point: tuple[float, int] = (P.HOOK_MIN_SCORE, P.HOOK_LIMIT)) -> dict:
    """All measures of a run as plain values: a fixed number of them, besides the failures, which cases bound.

    queries (case_id, query) give the failures their text.
    """
    items = materialize(items, "judged")
    at = sweep(cases, items, [point[0]], point[1]).first().asDict()
    best_row = best(sweep(cases, items, THRESHOLDS, point[1])).first().asDict()
    lost = failures(cases, items)
    lost = lost.join(queries, "case_id", "left") if queries is not None else lost.withColumn("query", F.lit(""))
    return {
        "cases": cases.count(),
        **{f"hit_at_{r['k']}": r["hit_rate"] for r in hit_at(cases, items, [1, 3, 5]).collect()},
        "mrr": mean_reciprocal_rank(cases, items).first()["mrr"],
        "point": at,
        "recommended": best_row,
        "histogram": [r.asDict() for r in histogram(items).orderBy("bucket").collect()],
        "failures": [r.asDict() for r in lost.orderBy("case_id").collect()],
    }


def render(found: dict, markdown: bool = False) -> str:
    """A report as plain text or Markdown."""
    measures = {f"hit@{k}": f"{found[f'hit_at_{k}']:.1%}" for k in (1, 3, 5)} | {"MRR": f"{found['mrr']:.3f}"}
    measures |= {name: f"{found['point'][key]:.1%}" for name, key in (("precision", "precision"), ("noise rate", "noise_rate"), ("injection rate", "injection_rate"), ("case hit rate", "case_hit_rate"))}
    title, section = ("## ", "### ") if markdown else ("", "")
    if markdown:
        table = ["| measure | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in measures.items())]
    else:
        table = [f"{k:<18}{v}" for k, v in measures.items()]
    r = found["recommended"]
    choice = f"recommended minimum score: {r['threshold']:.2f} (precision {r['precision']:.1%}, case hit rate {r['case_hit_rate']:.1%}, injection rate {r['injection_rate']:.1%})"
    bars = [f"  {b['bucket']}  {b['hits'] * '#'} {b['hits']} / {b['misses']}" for b in found["histogram"] if b["hits"] or b["misses"]]
    lost = [f"  [{x['case_id']}] {(x['query'] or '')[:70]!r} got {x['got'] or 'nothing'}" for x in found["failures"]]
    out = [f"{title}Evaluation of {found['cases']} cases", "", *table, "", choice, "", f"{section}scores (hits / misses)", *bars]
    return "\n".join([*out, "", f"{section}no hit among the first 3", *lost] if lost else out)
