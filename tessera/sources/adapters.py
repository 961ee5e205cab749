"""Evaluation tables as views of the driver's star schema.

``ROWS`` is the same view as DuckDB SQL, for oracles: one row a (model, question,
format) evaluation with naturally repeated keys, ordered by ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dealing import dealt
from tessera.operators.dedupe import last_wins

#: Formats by l_linenumber, difficulties and sources by remainder.
FORMATS = ("text_only", "table_image", "bar_chart", "heatmap", "scatter_plot", "node_link", "adjacency_matrix")
DIFFICULTIES = ("1-hop", "2-hop", "3-hop", "counterfactual")
TASKS = ("aggregation", "comparison", "connectivity", "ranking", "trend_analysis")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The index-th of ``values``, counted from 0."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, question_id, object_id, modality, source, viz_type, difficulty, task, question, answer, prediction, exact_match, latency, ord_a .. ord_c."""
    return _evaluated(spark, sf_dir, _lines(spark, sf_dir)).drop("order_key")


def modality_of(status: str) -> Column:
    return F.when(F.col(status) == "F", "tabular").when(F.col(status) == "O", "timeseries").otherwise("graph")


def _evaluated(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    key = F.col("l_orderkey")
    modality = modality_of("o_orderstatus")
    difficulty = pick(DIFFICULTIES, key % 4)
    answer = (F.col("o_custkey") % 40).cast("string")
    right = F.col("l_quantity") > 25
    return rows.select(
        F.col("l_returnflag").alias("model"),
        F.concat(modality, F.lit("_"), F.lpad(key.cast("string"), 9, "0"), F.lit("::difficulty="), difficulty).alias("question_id"),
        F.col("o_custkey").alias("object_id"),
        modality.alias("modality"),
        F.when(key % 3 == 0, "ett").otherwise("synthetic").alias("source"),
        pick(FORMATS, F.col("l_linenumber") - 1).alias("viz_type"),
        difficulty.alias("difficulty"),
        pick(TASKS, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("task"),
        F.concat(F.lit("What is the value of item "), (key % 97).cast("string"), F.lit("?")).alias("question"),
        answer.alias("answer"),
        F.when(right, answer).when(F.col("l_quantity") < 4, "[ERROR]").otherwise(((F.col("o_custkey") + F.col("l_suppkey")) % 40 + 40).cast("string")).alias("prediction"),
        F.when(right, 1.0).otherwise(0.0).alias("exact_match"),
        F.col("l_extendedprice").alias("latency"),
        F.col("l_partkey").alias("ord_a"),
        F.col("l_suppkey").alias("ord_b"),
        F.col("l_extendedprice").alias("ord_c"),
        F.col("l_quantity").alias("ord_d"),
        key.alias("order_key"),
    )


ROWS = """aer AS (
  SELECT l_returnflag AS model,
    (CASE o_orderstatus WHEN 'F' THEN 'tabular' WHEN 'O' THEN 'timeseries' ELSE 'graph' END) || '_' || lpad(l_orderkey::VARCHAR, 9, '0') || '::difficulty=' || (['1-hop','2-hop','3-hop','counterfactual'])[l_orderkey % 4 + 1] AS question_id,
    o_custkey AS object_id,
    CASE o_orderstatus WHEN 'F' THEN 'tabular' WHEN 'O' THEN 'timeseries' ELSE 'graph' END AS modality,
    CASE WHEN l_orderkey % 3 = 0 THEN 'ett' ELSE 'synthetic' END AS source,
    (['text_only','table_image','bar_chart','heatmap','scatter_plot','node_link','adjacency_matrix'])[l_linenumber] AS viz_type,
    (['1-hop','2-hop','3-hop','counterfactual'])[l_orderkey % 4 + 1] AS difficulty,
    (['aggregation','comparison','connectivity','ranking','trend_analysis'])[left(o_orderpriority, 1)::INT] AS task,
    'What is the value of item ' || (l_orderkey % 97)::VARCHAR || '?' AS question,
    (o_custkey % 40)::VARCHAR AS answer,
    CASE WHEN l_quantity > 25 THEN (o_custkey % 40)::VARCHAR WHEN l_quantity < 4 THEN '[ERROR]' ELSE ((o_custkey + l_suppkey) % 40 + 40)::VARCHAR END AS prediction,
    CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact_match,
    l_extendedprice AS latency, l_partkey AS ord_a, l_suppkey AS ord_b, l_extendedprice AS ord_c, l_quantity AS ord_d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

#: The last row of each key wins.
FACTS = (
    ROWS
    + """, facts AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model, question_id, viz_type ORDER BY ord_a DESC, ord_b DESC, ord_c DESC, ord_d DESC) AS rn FROM aer) WHERE rn = 1)"""
)
ORDER = ("ord_a", "ord_b", "ord_c", "ord_d")
KEY = ("model", "question_id", "viz_type")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each (model, question_id, viz_type) the last evaluation.

    Flag, order and line number name that key, so the last row is found before the join and
    before the key's strings are made, in the partitioning by order that the join also uses.
    """
    return facts_by_order(spark, sf_dir).drop("order_key")


def facts_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``facts`` with ``order_key``, which names the question: what is grouped by it stays in its task, of bounded rows, and needs no text."""
    lines = _lines(spark, sf_dir)
    lines = dealt(lines, lines.count(), "l_orderkey")  # the count is read from the files' footers
    last = last_wins(lines, ["l_returnflag", "l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return _evaluated(spark, sf_dir, last)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data_id, t, value: each user's events as an index series from 0."""
    from pyspark.sql import Window

    events = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("data_id"), (F.row_number().over(order) - 1).cast("long").alias("t"), F.col("value").cast("double").alias("value"))


SERIES = """ts AS (SELECT user_id AS data_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value::DOUBLE AS value FROM events)"""


def graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(data_id, node) and (data_id, src, dst), src < dst: seven graphs over the nations, an edge where a hash of the pair is small."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    years = spark.range(1, 8).withColumnRenamed("id", "data_id")
    nodes = years.crossJoin(nations)  # 7 x 25: fixed
    pairs = nodes.withColumnRenamed("node", "src").join(nodes.withColumnRenamed("node", "dst"), "data_id").filter("src < dst")
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", "data_id", "src", "dst")), 1, 4), 16, 10).cast("long")
    return nodes.select("data_id", "node"), pairs.filter(bucket < F.col("data_id") * 1800).select("data_id", "src", "dst")


GRAPHS = """nodes AS (SELECT y AS data_id, n_nationkey::BIGINT AS node FROM range(1, 8) r(y), nation),
edges AS (SELECT a.data_id, a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON a.data_id = b.data_id AND a.node < b.node
  WHERE ('0x' || substr(md5(a.data_id::VARCHAR || ':' || a.node::VARCHAR || ':' || b.node::VARCHAR), 1, 4))::BIGINT < a.data_id * 1800),
sym AS (SELECT data_id, src AS u, dst AS v FROM edges UNION ALL SELECT data_id, dst, src FROM edges)"""
