"""Tables as the queries of the store's own operators read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.storage import table

#: The name of the search tool that texts may speak about.
TOOL = "lorekeep"
#: What is put into every fifth turn, so that rules on the search tool have something to find.
INJECT = f"(CASE WHEN row_id % 5 = 0 THEN ' {TOOL.capitalize()} found it, {TOOL} was right, so {TOOL} it.' ELSE '' END)"
#: Every hundredth row is a query of the searches over whole tables.
QUERY_STEP = 100


def stored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as an insert-or-ignore store holds them: of each id the row that arrived first."""
    return first_rows(table(spark, sf_dir, "turns"))


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(table(spark, sf_dir, "facts"))


def first_rows(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("row_id")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


TURNS_SQL = "t AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1)"
FACTS_SQL = "f AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id) = 1)"


def vectors_sql(table_name: str, alias: str) -> str:
    """Usable vectors as DOUBLE lists: 384 finite numbers, not all 0."""
    return (
        f"{alias} AS (SELECT row_id, v FROM (SELECT row_id, embedding::DOUBLE[] AS v, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n "
        f"FROM {table_name} WHERE len(embedding) = 384) WHERE isfinite(n) AND n > 0)"
    )


def knn_sql(vectors: str, queries: str, k: int, name: str = "k") -> str:
    """query_id, row_id, similarity, rank over CTEs vectors (row_id, v) and queries (query_id, v)."""
    return (
        f"{name} AS (SELECT query_id, row_id, similarity, rank FROM (SELECT query_id, row_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM "
        f"(SELECT q.query_id, x.row_id, round(list_cosine_similarity(q.v, x.v), 9) AS similarity FROM {queries} q CROSS JOIN {vectors} x)) WHERE rank <= {k})"
    )
