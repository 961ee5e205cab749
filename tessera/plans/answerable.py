"""Queries of answerability: what a picture of a series or graph lets a reader see."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.sources.adapters import FACTS, GRAPHS, SERIES, facts, graphs, series

W = "WITH "
#: Tasks whose answer no data changes; tasks read off a line plot (the others are derived from it); tasks a heatmap hides; tasks that field plots show; tasks that need exact values, always or if the answer is a number.
CONSTANT = ("pattern_label_lookup", "counterfactual_scale_peak", "counterfactual_sign_flip", "pattern_classification")
LINE_VISIBLE = ("value_lookup", "range_query", "mean_shift_magnitude", "forecasting", "threshold_count", "median_mean_relation", "normalized_amplitude", "local_peak_median_relation", "oscillation_count")
LINE_DERIVED = ("peak_identification", "seasonality_detection", "change_point", "volatility", "mean_half_comparison", "endpoint_comparison", "change_volatility", "anomaly_detection", "split_trend_consistency", "peak_trough_order", "half_change_intensity", "counterfactual_half_shift")
HEAT_ABSENT = ("value_lookup", "range_query", "mean_shift_magnitude", "forecasting", "threshold_count", "median_mean_relation", "normalized_amplitude", "local_peak_median_relation", "counterfactual_half_shift")
FIELD_DERIVED = ("seasonality_detection", "change_point")
PRECISE = ("value_lookup", "range_query", "threshold_count", "mean_shift_magnitude", "forecasting")
PRECISE_IF_NUMERIC = ("median_mean_relation", "anomaly_detection")
#: Points and edges a text view shows; nodes below which circles are labelled; nodes up to which a matrix has ticks.
TEXT_POINTS, TEXT_EDGES, LABELLED_BELOW, TICKS_UP_TO = 43, 43, 30, 24
#: Graph tasks that name nodes, and tasks about the whole graph.
NODE_TASKS = ("degree_query", "shortest_path", "centrality", "connectivity", "counterfactual")
WHOLE_TASKS = ("edge_count", "clustering", "bipartite_check", "cycle_detection", "community", "diameter")

SERIES_VIEWS = ("line_plot", "heatmap", "gaf", "recurrence_plot", "text_only")
GRAPH_VIEWS = ("node_link", "circular_layout", "adjacency_matrix", "text_only", "text_degrees")


def among(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(map(repr, values))})"


#: An item a series and task; a lookup asks for the first value of series with even ids, else for the last; answers of odd ids are numbers.
SERIES_ITEMS = SERIES + f""", n AS (SELECT data_id, count(*) AS n FROM ts GROUP BY ALL), items AS (SELECT *, data_id % 2 = 0 AS first, data_id % 2 = 1 AS numeric FROM n, (SELECT unnest({list(CONSTANT + LINE_VISIBLE + LINE_DERIVED)}) AS task)),
l AS (SELECT *, CASE WHEN {among('task', CONSTANT)} THEN 'C' WHEN {among('task', LINE_VISIBLE)} THEN 'V' ELSE 'D' END AS line FROM items),
c AS (SELECT data_id, n, task, numeric, viz_type, CASE WHEN line = 'C' THEN 'C' WHEN viz_type = 'line_plot' THEN line WHEN viz_type = 'heatmap' THEN CASE WHEN {among('task', HEAT_ABSENT)} THEN 'A' ELSE 'D' END
  WHEN viz_type IN ('gaf', 'recurrence_plot') THEN CASE WHEN {among('task', FIELD_DERIVED)} THEN 'D' ELSE 'A' END WHEN n <= {TEXT_POINTS} THEN line WHEN task = 'value_lookup' AND first THEN 'V' ELSE 'A' END AS cat, line FROM l, (SELECT unnest({list(SERIES_VIEWS)}) AS viz_type)),
s AS (SELECT * REPLACE (CASE WHEN viz_type = 'text_only' THEN line ELSE cat END AS cat) FROM c),
x AS (SELECT * REPLACE (CASE WHEN viz_type <> 'text_only' AND cat IN ('V', 'D') AND ({among('task', PRECISE)} OR {among('task', PRECISE_IF_NUMERIC)} AND numeric) THEN 'A' ELSE cat END AS cat) FROM s)"""
COUNTS = "sum((cat = 'V')::INT)::BIGINT AS visible, sum((cat = 'D')::INT)::BIGINT AS derivable, sum((cat = 'A')::INT)::BIGINT AS absent, sum((cat = 'C')::INT)::BIGINT AS constant"


def counted(c):
    return [F.count_if(F.col("cat") == k).alias(a) for k, a in (("V", "visible"), ("D", "derivable"), ("A", "absent"), ("C", "constant"))]


def series_categories(spark, sf_dir, rules: str = "first"):
    """(data_id, n, task, viz_type, cat); rules: first, corrected (the text lists every point) or strict (drawings tell no exact values)."""
    n = series(spark, sf_dir).groupBy("data_id").agg(F.count("*").alias("n"))
    items = n.withColumn("task", F.explode(F.array(*map(F.lit, CONSTANT + LINE_VISIBLE + LINE_DERIVED)))).withColumn("viz_type", F.explode(F.array(*map(F.lit, SERIES_VIEWS))))
    task, viz, even = F.col("task"), F.col("viz_type"), F.col("data_id") % 2 == 0
    line = F.when(task.isin(*CONSTANT), "C").when(task.isin(*LINE_VISIBLE), "V").otherwise("D")
    text = F.when(F.lit(rules != "first") | (F.col("n") <= TEXT_POINTS), line).when((task == "value_lookup") & even, "V").otherwise("A")
    seen = F.when(line == "C", "C").when(viz == "line_plot", line).when(viz == "heatmap", F.when(task.isin(*HEAT_ABSENT), "A").otherwise("D"))
    seen = seen.when(viz.isin("gaf", "recurrence_plot"), F.when(task.isin(*FIELD_DERIVED), "D").otherwise("A")).otherwise(text)
    out = items.withColumn("cat", seen)
    if rules == "strict":
        exact = task.isin(*PRECISE) | (task.isin(*PRECISE_IF_NUMERIC) & ~even)
        out = out.withColumn("cat", F.when((viz != "text_only") & F.col("cat").isin("V", "D") & exact, "A").otherwise(F.col("cat")))
    return out


@query("series_answerability", W + SERIES_ITEMS + f" SELECT viz_type, {COUNTS}, (SELECT count(*) FROM (SELECT data_id, task FROM c GROUP BY ALL HAVING bool_and(cat IN ('V', 'D')))) AS fully FROM c GROUP BY viz_type")
def series_answerability(spark, sf_dir):
    c = series_categories(spark, sf_dir)
    fully = c.groupBy("data_id", "task").agg(F.bool_and(F.col("cat").isin("V", "D")).alias("ok")).agg(F.count_if("ok").alias("fully"))
    return c.groupBy("viz_type").agg(*counted(c)).crossJoin(F.broadcast(fully))  # one row


@query("corrected_answerability", W + SERIES_ITEMS + f" SELECT 'corrected' AS rules, viz_type, {COUNTS} FROM s GROUP BY viz_type UNION ALL SELECT 'strict', viz_type, {COUNTS} FROM x GROUP BY viz_type")
def corrected_answerability(spark, sf_dir):
    """Series under the corrected rules, and under those that ask for exact values."""
    both = [series_categories(spark, sf_dir, rules).groupBy("viz_type").agg(*counted(None)).withColumn("rules", F.lit(rules)) for rules in ("corrected", "strict")]
    return both[0].unionByName(both[1])


@query("rule_branches", W + SERIES_ITEMS + f", b AS (SELECT CASE WHEN line = 'C' THEN 'constant ' || task WHEN n <= {TEXT_POINTS} THEN 'text lists all' WHEN task = 'value_lookup' THEN 'text, lookup' ELSE 'text, other task' END AS branch FROM l) SELECT branch, count(*) AS n FROM b GROUP BY ALL")
def rule_branches(spark, sf_dir):
    """How often each branch of the series rules is taken."""
    c = series_categories(spark, sf_dir).filter("viz_type = 'line_plot'")
    branch = F.when(F.col("cat") == "C", F.concat(F.lit("constant "), F.col("task"))).when(F.col("n") <= TEXT_POINTS, "text lists all").when(F.col("task") == "value_lookup", "text, lookup").otherwise("text, other task")
    return c.groupBy(branch.alias("branch")).agg(F.count("*").alias("n"))


#: Edges as a graph walks them: by the lesser node, then in the order in which neighbours were met, which for sorted edges is that of the greater node.
FIRST_EDGES = f"SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY src, dst) AS k FROM edges QUALIFY k <= {TEXT_EDGES}"


@query("first_edges", W + GRAPHS + f", f AS ({FIRST_EDGES}) SELECT data_id, count(*) AS n, string_agg(src || '-' || dst, ' ' ORDER BY k) AS edges FROM f GROUP BY data_id")
def first_edges(spark, sf_dir):
    """The edges that a text view shows."""
    f = _first(graphs(spark, sf_dir)[1])
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "src", "dst"))), lambda e: F.concat_ws("-", e["src"], e["dst"]))
    return f.groupBy("data_id").agg(F.count("*").alias("n"), F.array_join(listed, " ").alias("edges"))


def _first(edges):
    return edges.withColumn("k", F.row_number().over(Window.partitionBy("data_id").orderBy("src", "dst"))).filter(F.col("k") <= TEXT_EDGES)


GRAPH_ITEMS = GRAPHS + f""", f AS ({FIRST_EDGES}), seen AS (SELECT DISTINCT data_id, unnest([src, dst]) AS node FROM f), m AS (SELECT data_id, count(*) AS ne FROM edges GROUP BY ALL), z AS (SELECT nodes.data_id, count(*) AS nn, coalesce(any_value(ne), 0) AS ne FROM nodes LEFT JOIN m USING (data_id) GROUP BY nodes.data_id),
items AS (SELECT *, (SELECT count(*) > 0 FROM seen WHERE seen.data_id = z.data_id AND seen.node = 24) AS shown FROM z, (SELECT unnest({list(NODE_TASKS + WHOLE_TASKS)}) AS task)),
c AS (SELECT data_id, task, viz_type, CASE WHEN task = 'connectivity' THEN 'C' WHEN viz_type IN ('node_link', 'circular_layout') THEN CASE WHEN {among('task', NODE_TASKS)} AND nn >= {LABELLED_BELOW} THEN 'A' ELSE 'D' END
  WHEN viz_type = 'adjacency_matrix' THEN CASE WHEN {among('task', NODE_TASKS)} AND nn > {TICKS_UP_TO} THEN 'A' ELSE 'D' END WHEN ne <= {TEXT_EDGES} THEN CASE WHEN task = 'degree_query' THEN 'V' ELSE 'D' END WHEN task = 'degree_query' AND shown THEN 'V' ELSE 'A' END AS cat FROM items, (SELECT unnest({list(GRAPH_VIEWS[:4])}) AS viz_type)),
s AS (SELECT task, viz_type, CASE WHEN task = 'connectivity' THEN 'C' WHEN task = 'degree_query' AND viz_type = 'text_degrees' THEN 'V' ELSE 'D' END AS cat FROM items, (SELECT unnest({list(GRAPH_VIEWS)}) AS viz_type))"""


@query("graph_answerability", W + GRAPH_ITEMS + f" SELECT 'first' AS rules, viz_type, {COUNTS} FROM c GROUP BY viz_type UNION ALL SELECT 'corrected', viz_type, {COUNTS} FROM s GROUP BY viz_type")
def graph_answerability(spark, sf_dir):
    """Graph tasks under the first and the corrected rules; degrees are asked of node 24."""
    nodes, edges = graphs(spark, sf_dir)
    shown = _first(edges).select("data_id", F.explode(F.array("src", "dst")).alias("node")).filter("node = 24").select("data_id").distinct().withColumn("shown", F.lit(True))
    sizes = nodes.groupBy("data_id").agg(F.count("*").alias("nn")).join(edges.groupBy("data_id").agg(F.count("*").alias("ne")), "data_id", "left").join(shown, "data_id", "left")
    items = sizes.withColumn("task", F.explode(F.array(*map(F.lit, NODE_TASKS + WHOLE_TASKS)))).withColumn("viz_type", F.explode(F.array(*map(F.lit, GRAPH_VIEWS))))
    task, viz = F.col("task"), F.col("viz_type")
    named, degree = task.isin(*NODE_TASKS), task == "degree_query"
    picture = F.when(viz.isin("node_link", "circular_layout"), F.when(named & (F.col("nn") >= LABELLED_BELOW), "A").otherwise("D"))
    picture = picture.when(viz == "adjacency_matrix", F.when(named & (F.col("nn") > TICKS_UP_TO), "A").otherwise("D"))
    picture = picture.when(F.coalesce("ne", F.lit(0)) <= TEXT_EDGES, F.when(degree, "V").otherwise("D")).when(degree & F.coalesce("shown", F.lit(False)), "V").otherwise("A")
    first = items.filter("viz_type <> 'text_degrees'").withColumn("cat", F.when(task == "connectivity", "C").otherwise(picture)).groupBy("viz_type").agg(*counted(None)).withColumn("rules", F.lit("first"))
    corrected = items.withColumn("cat", F.when(task == "connectivity", "C").when(degree & (viz == "text_degrees"), "V").otherwise("D")).groupBy("viz_type").agg(*counted(None)).withColumn("rules", F.lit("corrected"))
    return first.unionByName(corrected)


#: A stand-in for categories of evaluation rows: by task and format.
CATS = FACTS + """, k AS (SELECT *, CASE WHEN task = 'connectivity' THEN 'C' WHEN viz_type IN ('scatter_plot', 'node_link') AND task <> 'comparison' THEN 'A' WHEN viz_type = 'text_only' THEN 'V' ELSE 'D' END AS cat FROM facts)"""


def categories(spark, sf_dir):
    task, viz = F.col("task"), F.col("viz_type")
    return facts(spark, sf_dir).withColumn("cat", F.when(task == "connectivity", "C").when(viz.isin("scatter_plot", "node_link") & (task != "comparison"), "A").when(viz == "text_only", "V").otherwise("D"))


@query("means_by_category", W + CATS + " SELECT model, modality, viz_type, CASE WHEN cat IN ('V', 'D') THEN 'VD' ELSE cat END AS bucket, round(avg(exact_match), 9) AS em, count(*) AS n FROM k GROUP BY ALL")
def means_by_category(spark, sf_dir):
    bucket = F.when(F.col("cat").isin("V", "D"), "VD").otherwise(F.col("cat")).alias("bucket")
    return categories(spark, sf_dir).groupBy("model", "modality", "viz_type", bucket).agg(F.round(F.avg("exact_match"), 9).alias("em"), F.count("*").alias("n"))


ENDS = CATS + """, g AS (SELECT model, modality, viz_type, avg(exact_match) AS em FROM k GROUP BY ALL), e AS (SELECT model, modality, arg_max(viz_type, (em, viz_type)) AS best, arg_min(viz_type, (em, viz_type)) AS worst, round(max(em) - min(em), 9) AS gap_full FROM g GROUP BY ALL),
p AS (SELECT model, modality, question_id, any_value(best) AS best, any_value(worst) AS worst, any_value(gap_full) AS gap_full, max(CASE WHEN viz_type = best AND cat IN ('V', 'D') THEN exact_match END) AS b, max(CASE WHEN viz_type = worst AND cat IN ('V', 'D') THEN exact_match END) AS w FROM k JOIN e USING (model, modality) GROUP BY ALL)"""


@query("both_answerable", W + ENDS + " SELECT model, modality, best, worst, gap_full, count(*) AS n, round(avg(b) - avg(w), 9) AS gap_subset FROM p WHERE b IS NOT NULL AND w IS NOT NULL GROUP BY ALL")
def both_answerable(spark, sf_dir):
    """The gap between the whole sample's best and worst formats where both let a question be answered."""
    k = categories(spark, sf_dir)
    g = k.groupBy("model", "modality", "viz_type").agg(F.avg("exact_match").alias("em"))
    order = F.struct("em", "viz_type")
    ends = g.groupBy("model", "modality").agg(F.max_by("viz_type", order).alias("best"), F.min_by("viz_type", order).alias("worst"), F.round(F.max("em") - F.min("em"), 9).alias("gap_full"))
    at = lambda c: F.max(F.when((F.col("viz_type") == F.col(c)) & F.col("cat").isin("V", "D"), F.col("exact_match")))
    pairs = k.join(F.broadcast(ends), ["model", "modality"]).groupBy("model", "modality", "best", "worst", "gap_full", "question_id").agg(at("best").alias("b"), at("worst").alias("w")).filter("b is not null and w is not null")
    return pairs.groupBy("model", "modality", "best", "worst", "gap_full").agg(F.count("*").alias("n"), F.round(F.avg("b") - F.avg("w"), 9).alias("gap_subset"))
