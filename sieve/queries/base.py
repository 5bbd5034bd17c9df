"""Base tables of the queries: scored messages from orders, message rows from documents, and SQL for the same.

Scores are whole numbers divided by 10 000, computed from keys, so that both engines have the same doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.ship import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Y = "CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END"
SCORE_COLUMNS = {
    "msg_id": "o_orderkey",
    "source": "concat('n', CAST(c_nationkey AS VARCHAR(10)))",
    "y": Y,
    "sent": "o_orderdate",
    "score": f"CAST((o_orderkey * 7919 + o_custkey * 104729) % 6500 + ({Y}) * ((o_orderkey * 31 + o_custkey * 17) % 3500) AS DOUBLE) / 10000",
    "ham": f"CAST((o_orderkey * 6007 + o_custkey * 9973) % 7000 + (1 - ({Y})) * ((o_orderkey * 37 + o_custkey * 11) % 3000) AS DOUBLE) / 10000",
    "agree": f"CAST((o_orderkey * 13 + o_custkey * 29) % 7 + ({Y}) * ((o_orderkey + o_custkey) % 4) AS INT)",
    "base_flag": f"(o_orderkey * 13 + o_custkey * 7) % 23 < 1 + ({Y}) * 6",
    "rscore": "CAST((o_orderkey * 211 + o_custkey * 31) % 1400 - 400 AS DOUBLE) / 100",
    "fold": "CAST(o_orderkey % 5 AS INT)",
    **{f"p{k}": f"CAST((o_orderkey * {97 + 40 * k} + o_custkey * {13 + 6 * k}) % 5000 + ({Y}) * ((o_orderkey * {k + 2} + o_custkey) % 5000) AS DOUBLE) / 10000" for k in range(1, 7)},
}
#: A common table expression for the oracle: the same columns in DuckDB's SQL.
SCORES_SQL = "scores AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in SCORE_COLUMNS.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey)"


def scores(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    names = columns or tuple(SCORE_COLUMNS)
    return rows.selectExpr(*(f"{SCORE_COLUMNS[c]} AS {c}" for c in names))


#: The large twin: line items, without a unique key; scores are coarse, so ties are heavy.
ITEM_COLUMNS = {
    "source": "concat('n', CAST(s_nationkey AS VARCHAR(10)))",
    "y": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "score": "CAST((l_orderkey * 7919 + l_partkey * 31) % 700 + (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * (l_partkey % 300) AS DOUBLE) / 1000",
    "base_flag": "(l_orderkey + l_partkey) % 29 = 0",
    "fold": "CAST(l_orderkey % 5 AS INT)",
    "supplier": "CAST(l_suppkey AS VARCHAR(20))",
    "part": "CAST(l_partkey AS VARCHAR(20))",
}
ITEMS_SQL = "items AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in ITEM_COLUMNS.items()) + " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    li, names = table(spark, sf_dir, "lineitem"), columns or tuple(ITEM_COLUMNS)
    if "source" in names:
        li = li.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.selectExpr(*(f"{ITEM_COLUMNS[c]} AS {c}" for c in names))


#: Labelled documents as messages: y is toxic.
MESSAGES_SQL = "messages AS (SELECT d.doc_id, d.text, d.lang, d.source, l.toxic AS y FROM documents d JOIN labels l USING (doc_id))"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")


def r6(*names: str):
    """Named columns rounded to six places."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]
