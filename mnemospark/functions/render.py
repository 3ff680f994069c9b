"""Results as text: a list, a prompt's context, a spoken answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark import params as P
from mnemospark.functions.rules import clip, spoken
from mnemospark.operators.retrieval import within_budget


def pieces(rows: DataFrame, chars: int = P.HOOK_SNIPPET) -> DataFrame:
    """rows (query_id, position, source, text, score, project, ts, kind, via) with piece, a line of a prompt's context."""
    place = F.concat(F.substring(F.coalesce("ts", F.lit("")), 1, 10), F.coalesce(F.concat(F.lit(" · "), F.col("project")), F.lit("")))
    by = F.coalesce(F.concat(F.lit(" · via "), F.col("via")), F.lit(""))
    fact = F.when(F.col("source") == "fact", F.concat(F.lit("📌 ["), F.coalesce("kind", F.lit("")), by, F.lit("] "))).otherwise("")
    return rows.withColumn("piece", F.concat(F.lit("- "), fact, F.lit("("), place, F.lit(", "), F.format_string("%.2f", "score"), F.lit(") "), clip(F.col("text"), chars, True), F.lit("\n")))


def context(rows: DataFrame, budget: int = P.HOOK_CHARS) -> DataFrame:
    """query_id and context: the pieces in order until the first that overflows the budget."""
    kept = within_budget(pieces(rows), "piece", budget)
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("context"))


def snippet_list(rows: DataFrame) -> DataFrame:
    """query_id and markdown: the results of each query (position, role, ts, project, score, text) as a numbered list."""
    day = F.coalesce(F.substring("ts", 1, 10), F.lit("unknown date"))
    where = F.coalesce(F.concat(F.lit(" · "), F.col("project")), F.lit(""))
    head = F.concat(F.lit("### "), F.col("position").cast("string"), F.lit(". "), F.coalesce("role", F.lit("")), F.lit(" ("), day, where, F.lit(", score "), F.format_string("%.2f", "score"), F.lit(")\n"))
    piece = F.struct("position", F.concat(head, F.coalesce("text", F.lit(""))).alias("piece"))
    by = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return by.select("query_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("markdown"))


def answer(rows: DataFrame, budget: int = 600, pieces_at_most: int = 2, least_room: int = 80) -> DataFrame:
    """query_id and answer: at most two results as sentences without marks, cut where the budget ends."""
    day = F.coalesce(F.date_format(F.substring("ts", 1, 10).try_cast("date"), "MMMM d"), F.lit("an earlier session"))
    where = F.coalesce(F.concat(F.lit(" in "), F.col("project")), F.lit(""))
    said = rows.withColumn("piece", F.concat(F.lit("From "), day, where, F.lit(": "), spoken(F.col("text"))))
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("piece") + 1).over(w) - 1, F.lit(0))
    kept = said.where(F.col("position") <= pieces_at_most).withColumn("room", F.lit(budget) - used).where(F.col("room") > least_room)
    kept = kept.withColumn("piece", F.expr("substring(piece, 1, room)"))
    return kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "piece"))).alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["piece"]), " ... ").alias("answer"))
