"""Queries of expansion, rendering manifests and event windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import dedupe
from tessera.plans.registry import query
from tessera.sources.adapters import ROWS, evaluation_rows, read
from tessera.streaming import incremental

W = "WITH "


@query("event_windows", """SELECT time_bucket(INTERVAL 1 hour, ts) AS start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    return incremental.windowed_counts(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("event_sessions", """WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 minute AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    return incremental.sessions(read(spark, sf_dir, "events"))


@query("render_expansion", W + ROWS + """, i AS (SELECT DISTINCT question_id, modality FROM aer) SELECT question_id, unnest(CASE modality WHEN 'tabular' THEN ['text_only','table_image','bar_chart','heatmap','scatter_plot'] WHEN 'timeseries' THEN ['text_only','line_plot','heatmap','gaf','recurrence_plot'] ELSE ['text_only','node_link','circular_layout','adjacency_matrix'] END) AS viz_type FROM i""")
def render_expansion(spark, sf_dir):
    """Each item in all formats of its modality."""
    forms = {"tabular": "text_only table_image bar_chart heatmap scatter_plot", "timeseries": "text_only line_plot heatmap gaf recurrence_plot", "graph": "text_only node_link circular_layout adjacency_matrix"}
    every = None
    for modality, names in forms.items():
        array = F.array(*map(F.lit, names.split()))
        every = F.when(F.col("modality") == modality, array) if every is None else every.when(F.col("modality") == modality, array)
    items = evaluation_rows(spark, sf_dir).select("question_id", "modality").distinct()
    return items.select("question_id", F.explode(every).alias("viz_type"))


@query("export_images", W + ROWS + """, i AS (SELECT DISTINCT question_id, unnest(['text_only','bar_chart','heatmap']) AS viz_type FROM aer), m AS (SELECT DISTINCT question_id, viz_type, true AS here FROM aer WHERE exact_match = 1) SELECT viz_type, count(*) AS n, sum((here IS NULL)::INT)::BIGINT AS missing FROM i LEFT JOIN m USING (question_id, viz_type) GROUP BY viz_type""")
def export_images(spark, sf_dir):
    """Items in their formats beside the images that are there."""
    rows = evaluation_rows(spark, sf_dir)
    wanted = rows.select("question_id").distinct().select("question_id", F.explode(F.array(*map(F.lit, ("text_only", "bar_chart", "heatmap")))).alias("viz_type"))
    here = rows.filter("exact_match = 1").select("question_id", "viz_type", F.lit(True).alias("here")).distinct()
    return wanted.join(here, ["question_id", "viz_type"], "left").groupBy("viz_type").agg(F.count("*").alias("n"), F.count_if(F.col("here").isNull()).alias("missing"))


@query("manifest_difference", W + ROWS + """, v AS (SELECT question_id, viz_type, max(CASE WHEN model = 'N' THEN md5(prediction) END) AS a, max(CASE WHEN model = 'R' THEN md5(prediction) END) AS b FROM aer WHERE model IN ('N','R') GROUP BY ALL) SELECT CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM v GROUP BY ALL""")
def manifest_difference(spark, sf_dir):
    """Two manifests by key: what was added, removed, changed by digest, or is the same."""
    v = evaluation_rows(spark, sf_dir).filter(F.col("model").isin("N", "R")).groupBy("question_id", "viz_type").agg(*[F.max(F.when(F.col("model") == m, F.md5("prediction"))).alias(c) for m, c in (("N", "a"), ("R", "b"))])
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return v.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("qualitative_examples", W + ROWS + """, g AS (SELECT model, question_id, viz_type, exact_match, latency, row_number() OVER (PARTITION BY model, question_id, exact_match ORDER BY latency DESC, viz_type, ord_a, ord_b) AS rn FROM aer), p AS (SELECT a.model, a.question_id, a.viz_type AS good, b.viz_type AS bad, a.latency + b.latency AS score FROM g a JOIN g b ON a.model = b.model AND a.question_id = b.question_id AND a.exact_match = 1 AND b.exact_match = 0 AND a.rn = 1 AND b.rn = 1), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, question_id) AS place FROM p)
SELECT model, place::INT AS place, question_id, good, bad, round(score, 4) AS score FROM r WHERE place <= 3""")
def qualitative_examples(spark, sf_dir):
    """A question's best right and best wrong row, the three best such pairs a model."""
    rows = evaluation_rows(spark, sf_dir)
    order = F.struct((-F.col("latency")).alias("l"), "viz_type", "ord_a", "ord_b")
    side = lambda e: F.min_by(F.struct("viz_type", "latency"), F.when(F.col("exact_match") == e, order))
    p = rows.groupBy("model", "question_id").agg(side(1).alias("g"), side(0).alias("b"), F.min("exact_match").alias("lo"), F.max("exact_match").alias("hi")).filter("lo < hi")
    p = p.withColumn("score", F.col("g.latency") + F.col("b.latency"))
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("score"), "question_id"))
    return p.withColumn("place", place).filter("place <= 3").select("model", "place", "question_id", F.col("g.viz_type").alias("good"), F.col("b.viz_type").alias("bad"), F.round("score", 4).alias("score"))


@query("round_robin_package", W + ROWS + """, i AS (SELECT DISTINCT modality, question_id FROM aer), r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY md5(question_id), question_id) AS rn FROM i) SELECT modality, question_id, (['text_only','bar_chart','heatmap','node_link'])[(rn - 1) % 4 + 1] AS viz_type FROM r WHERE rn <= CASE modality WHEN 'tabular' THEN 34 ELSE 33 END""")
def round_robin_package(spark, sf_dir):
    """34, 33 and 33 items by modality, in formats by turns."""
    i = evaluation_rows(spark, sf_dir).select("modality", "question_id").distinct()
    r = i.withColumn("rn", F.row_number().over(Window.partitionBy("modality").orderBy(F.md5("question_id"), "question_id")))
    form = F.element_at(F.array(*map(F.lit, ("text_only", "bar_chart", "heatmap", "node_link"))), ((F.col("rn") - 1) % 4 + 1).cast("int"))
    return r.filter(F.col("rn") <= F.when(F.col("modality") == "tabular", 34).otherwise(33)).select("modality", "question_id", form.alias("viz_type"))


@query("distinct_problems", W + ROWS + " SELECT modality, count(DISTINCT (question, answer)) AS problems, count(DISTINCT object_id) AS objects FROM aer GROUP BY modality")
def distinct_problems(spark, sf_dir):
    return evaluation_rows(spark, sf_dir).groupBy("modality").agg(F.countDistinct("question", "answer").alias("problems"), F.countDistinct("object_id").alias("objects"))


@query("error_rates", W + ROWS + " SELECT model, viz_type, avg((prediction = '[ERROR]')::INT) AS rate FROM aer GROUP BY ALL")
def error_rates(spark, sf_dir):
    return evaluation_rows(spark, sf_dir).groupBy("model", "viz_type").agg(F.avg(dedupe.is_error().cast("int")).alias("rate"))


@query("claims_first_wins", """SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""")
def claims_first_wins(spark, sf_dir):
    return dedupe.first_wins(read(spark, sf_dir, "part"), ["p_brand", "p_type"], ["p_partkey"]).select("p_brand", "p_partkey", "p_name")
