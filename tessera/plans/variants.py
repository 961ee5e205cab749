"""Queries that widen others: all scores, further thresholds, templates over graphs, more folds and draws, merged and chosen items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import formats, scoring
from tessera.operators import aggregate, dedupe, graph
from tessera.operators import statistics as st
from tessera.plans.registry import ORACLES, query
from tessera.plans.solvers import PART, all_t, by_t, parts, series_changes, series_extremes
from tessera.plans.statistics import HASH, RATERS, ensemble_accuracy, ensemble_sql, prior_accuracy, prior_sql, raters
from tessera.plans.templates import COMPONENT, DEGREES, series_counterfactuals, series_graph_context
from tessera.sources.adapters import FACTS, GRAPHS, ROWS, SERIES, evaluation_rows, facts, graphs, read, series

W = "WITH "
METRICS = ("exact_match", "token_f1", "numeric")
SCORED = FACTS + """, sc AS (SELECT * EXCLUDE (exact_match), (prediction = answer)::INT::DOUBLE AS exact_match, (prediction = answer)::INT::DOUBLE AS token_f1,
coalesce((abs(try_cast(prediction AS DOUBLE) - answer::DOUBLE) <= 0.05 OR abs(try_cast(prediction AS DOUBLE) - answer::DOUBLE) <= 0.01 * greatest(abs(try_cast(prediction AS DOUBLE)), abs(answer::DOUBLE)))::INT, 0)::DOUBLE AS numeric FROM facts)"""


def scored(spark, sf_dir):
    """Facts with the three scores of their predictions."""
    p, a = F.col("prediction"), F.col("answer")
    rows = facts(spark, sf_dir)
    return rows.withColumns({"exact_match": scoring.exact_match(p, a), "token_f1": scoring.token_f1(p, a), "numeric": scoring.numeric_accuracy(p, a)})


@query("score_means", W + SCORED + " SELECT model, coalesce(modality, 'all') AS modality, coalesce(difficulty, 'all') AS difficulty, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in METRICS) + ", count(*) AS n FROM sc GROUP BY GROUPING SETS ((model), (model, modality), (model, difficulty))")
def score_means(spark, sf_dir):
    """Means of all scores overall, by modality and by difficulty, in one pass."""
    out = scored(spark, sf_dir).groupingSets([["model"], ["model", "modality"], ["model", "difficulty"]], "model", "modality", "difficulty").agg(*[F.round(F.avg(m), 9).alias(m) for m in METRICS], F.count("*").alias("n"))
    return out.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("modality", "difficulty")})


@query("removal_by_score", W + SCORED + ", u AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, viz_type, sum({m}) AS s, count(*) AS n FROM sc GROUP BY viz_type" for m in METRICS) + "), t AS (SELECT metric, sum(s) AS ts, sum(n) AS tn FROM u GROUP BY metric) SELECT metric, viz_type, round(ts / tn, 9) AS baseline, round((ts - s) / (tn - n), 9) AS ablated, round((ts - s) / (tn - n) - ts / tn, 9) AS delta FROM u JOIN t USING (metric)")
def removal_by_score(spark, sf_dir):
    """Each format removed, under each score: totals less the format's."""
    sums = scored(spark, sf_dir).groupBy("viz_type").agg(*[F.sum(m).alias(m) for m in METRICS], F.count("*").alias("n"))
    long = sums.select("viz_type", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("s")) for m in METRICS])).alias("x")).select("viz_type", "n", "x.*")
    totals = long.groupBy("metric").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    base, rest = F.col("ts") / F.col("tn"), (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    return long.join(totals, "metric").select("metric", "viz_type", F.round(base, 9).alias("baseline"), F.round(rest, 9).alias("ablated"), F.round(rest - base, 9).alias("delta"))


@query("pivot_source_group", W + FACTS + " SELECT model, avg(CASE WHEN source = 'synthetic' THEN exact_match END) AS synthetic, avg(CASE WHEN source <> 'synthetic' THEN exact_match END) AS real_world FROM facts GROUP BY model")
def pivot_source_group(spark, sf_dir):
    group = F.when(F.col("source") == "synthetic", "synthetic").otherwise("real_world")
    return aggregate.pivot_means(facts(spark, sf_dir).withColumn("source_group", group), ["model"], "source_group", ("synthetic", "real_world"))


@query("visual_only_groups", W + FACTS + """, g AS (SELECT model, modality, viz_type, avg(exact_match) AS em FROM facts GROUP BY ALL) SELECT model, modality, max(CASE WHEN viz_type = 'text_only' THEN em END) AS text_em, round(avg(CASE WHEN viz_type <> 'text_only' THEN em END), 9) AS visual_em,
round(stddev_pop(CASE WHEN viz_type <> 'text_only' THEN em END), 9) AS visual_std, max(CASE WHEN viz_type <> 'text_only' THEN em END) - min(CASE WHEN viz_type <> 'text_only' THEN em END) AS visual_gap FROM g GROUP BY ALL""")
def visual_only_groups(spark, sf_dir):
    """Formats other than text, by model and modality."""
    g = facts(spark, sf_dir).groupBy("model", "modality", "viz_type").agg(F.avg("exact_match").alias("em"))
    em = F.when(F.col("viz_type") != "text_only", F.col("em"))
    return g.groupBy("model", "modality").agg(F.max(F.when(F.col("viz_type") == "text_only", F.col("em"))).alias("text_em"), F.round(F.avg(em), 9).alias("visual_em"), F.round(F.stddev_pop(em), 9).alias("visual_std"), (F.max(em) - F.min(em)).alias("visual_gap"))


@query("baseline_overall", W + ROWS + """, i AS (SELECT DISTINCT question_id, modality, task, answer FROM aer), c AS (SELECT modality, task, answer, count(*) AS k FROM i GROUP BY ALL), b AS (SELECT modality, task, sum(k) AS n, max(k) AS top, count(*) AS answers FROM c GROUP BY ALL)
SELECT coalesce(modality, 'all') AS modality, sum(n)::BIGINT AS n, round(sum(top) / sum(n), 9) AS majority, round(sum(n / answers) / sum(n), 9) AS random FROM b GROUP BY GROUPING SETS ((), (modality))""")
def baseline_overall(spark, sf_dir):
    """Majority and random baselines weighted by the questions of each task."""
    items = evaluation_rows(spark, sf_dir).select("question_id", "modality", "task", "answer").distinct()
    tasks = items.groupBy("modality", "task", "answer").agg(F.count("*").alias("k")).groupBy("modality", "task").agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.count("*").alias("answers"))
    n = F.sum("n")
    out = tasks.groupingSets([[], ["modality"]], "modality").agg(n.alias("n"), F.round(F.sum("top") / n, 9).alias("majority"), F.round(F.sum(F.col("n") / F.col("answers")) / n, 9).alias("random"))
    return out.withColumn("modality", F.coalesce("modality", F.lit("all")))


@query("human_gap_groups", W + RATERS + """, m AS (SELECT doc_id, lang, long, avg(quality) AS h FROM r GROUP BY ALL), o AS (SELECT o_custkey AS doc_id, avg((o_totalprice > 100000)::INT) AS x FROM orders GROUP BY ALL)
SELECT coalesce(lang, 'all') AS lang, coalesce(long::VARCHAR, 'all') AS kind, count(*) AS n, round(avg(h - x), 9) AS gap FROM m JOIN o USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (long))""")
def human_gap_groups(spark, sf_dir):
    """Raters less models on common keys: overall and by either group."""
    h = raters(spark, sf_dir).groupBy("doc_id", "lang", "long").agg(F.avg("quality").alias("h"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.avg((F.col("o_totalprice") > 100000).cast("int")).alias("x"))
    out = h.join(o, "doc_id").groupingSets([[], ["lang"], ["long"]], "lang", "long").agg(F.count("*").alias("n"), F.round(F.avg(F.col("h") - F.col("x")), 9).alias("gap"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce(F.col("long").cast("string"), F.lit("all")).alias("kind"), "n", "gap")


@query("gap_change", W + FACTS + """, t AS (SELECT * FROM facts WHERE modality = 'tabular' AND model IN ('N', 'A')), f AS (SELECT model, viz_type, avg(exact_match) AS em FROM t GROUP BY ALL),
b AS (SELECT model, arg_max(viz_type, (em, viz_type)) AS best, arg_min(viz_type, (em, viz_type)) AS worst FROM f GROUP BY model),
g AS (SELECT model, question_id, max(CASE WHEN viz_type = best THEN exact_match END) - max(CASE WHEN viz_type = worst THEN exact_match END) AS gap FROM t JOIN b USING (model) GROUP BY ALL HAVING gap IS NOT NULL)
SELECT count(*) AS n, round(avg(x.gap), 9) AS gap_before, round(avg(y.gap), 9) AS gap_after, round(avg(y.gap - x.gap), 9) AS change FROM g x JOIN g y USING (question_id) WHERE x.model = 'N' AND y.model = 'A'""")
def gap_change(spark, sf_dir):
    """Each model's own best less worst format over the questions that both models have in all four."""
    t = facts(spark, sf_dir).filter("modality = 'tabular' and model in ('N', 'A')").select("model", "question_id", "viz_type", "exact_match")
    per = t.groupBy("model", "viz_type").agg(F.avg("exact_match").alias("em"))
    ends = per.groupBy("model").agg(F.max(F.struct("em", "viz_type"))["viz_type"].alias("best"), F.min(F.struct("em", "viz_type"))["viz_type"].alias("worst"))
    at = lambda c: F.max(F.when(F.col("viz_type") == F.col(c), F.col("exact_match")))
    g = t.join(F.broadcast(ends), "model").groupBy("question_id", "model").agg((at("best") - at("worst")).alias("gap"))  # a row a model
    both = g.groupBy("question_id").agg(*[F.max(F.when(F.col("model") == m, F.col("gap"))).alias(a) for m, a in (("N", "x"), ("A", "y"))]).filter("x is not null and y is not null")
    return both.agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("gap_before"), F.round(F.avg("y"), 9).alias("gap_after"), F.round(F.avg(F.col("y") - F.col("x")), 9).alias("change"))


@query("prior_twenty_seeds", prior_sql(20))
def prior_twenty_seeds(spark, sf_dir):
    return prior_accuracy(spark, sf_dir, 20)


@query("ensemble_curve_wide", ensemble_sql(5, 12))
def ensemble_curve_wide(spark, sf_dir):
    """Up to five formats, twelve draws."""
    return ensemble_accuracy(spark, sf_dir, 5, 12)


@query("items_merged", "WITH u AS (SELECT item_id::VARCHAR AS id, text, 'synthetic' AS source, 'base_items' AS source_file, 0 AS place FROM benchmark UNION ALL SELECT doc_id::VARCHAR, text, coalesce(source, 'real_world'), 'realworld_test', 1 FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, text) AS rn FROM u) SELECT id, source, source_file, length(text) AS size FROM r WHERE rn = 1")
def items_merged(spark, sf_dir):
    """Two item tables as one: of an id in both the first table's stays; a missing source is the table's own."""
    base = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.lit("synthetic").alias("source"), F.lit("base_items").alias("source_file"), F.lit(0).alias("place"))
    real = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("source", F.lit("real_world")).alias("source"), F.lit("realworld_test").alias("source_file"), F.lit(1).alias("place"))
    rows = base.unionByName(real).withColumn("size", F.length("text").cast("long"))
    return dedupe.first_wins(rows, ["id"], ["place", "text"]).select("id", "source", "source_file", "size")


@query("listed_items", W + ROWS + ", q AS (SELECT DISTINCT question_id, object_id, question, answer FROM aer WHERE modality = 'tabular') SELECT question_id, question, answer FROM q WHERE object_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def listed_items(spark, sf_dir):
    """Items of one modality and of listed objects, without internal fields."""
    items = evaluation_rows(spark, sf_dir).filter("modality = 'tabular'").select("question_id", "object_id", "question", "answer", "modality", "difficulty").distinct()
    listed = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("object_id"))
    return formats.public(items.join(listed, "object_id", "left_semi").drop("object_id"), formats.INTERNAL)


@query("reading_sample", W + ROWS + ", q AS (SELECT DISTINCT question_id, modality FROM aer) SELECT question_id, modality FROM q ORDER BY " + HASH.format("'42:' || question_id") + ", question_id LIMIT 500")
def reading_sample(spark, sf_dir):
    """Five hundred questions by hash, for a costly baseline."""
    items = evaluation_rows(spark, sf_dir).select("question_id", "modality").distinct()
    return items.orderBy(st.hashed(F.lit(42), F.col("question_id")), "question_id").limit(500)


@query("placeholder_answers", r"""SELECT doc_id, 'From the given context, what is the key insight for ' || coalesce(lang, '') || '?' AS question, coalesce(nullif(left(split_part(regexp_replace(coalesce(text, ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g'), '.', 1), 140), ''), 'structured sample') AS answer FROM documents""")
def placeholder_answers(spark, sf_dir):
    """A text's first sentence, 140 characters at most, as the answer of a fixed question."""
    question = F.concat(F.lit("From the given context, what is the key insight for "), F.coalesce("lang", F.lit("")), F.lit("?"))
    return read(spark, sf_dir, "documents").select("doc_id", question.alias("question"), formats.placeholder(F.col("text")).alias("answer"))


@query("table_variants", W + PART + """, s AS (SELECT data_id, round(quantile_cont(size, 0.45), 2) AS a, round(quantile_cont(size, 0.6), 2) AS b FROM part_rows GROUP BY ALL)
SELECT data_id, sum((size > a)::INT)::BIGINT AS above_low, sum((size > b)::INT)::BIGINT AS above_high, avg(size) * 1.1 > avg(price) AS raised, (avg(size) > avg(price)) = (avg(size) * 1.2 > avg(price)) AS survives_rise, (avg(size) > avg(price)) = (avg(size) * 0.85 > avg(price)) AS survives_drop FROM part_rows JOIN s USING (data_id) GROUP BY data_id""")
def table_variants(spark, sf_dir):
    """Both thresholds of the counting questions, all factors of the counterfactual ones."""
    p = parts(spark, sf_dir)
    at = lambda q: F.round(F.percentile("size", F.lit(q)), 2)
    a, b = F.avg("size"), F.avg("price")
    above = lambda c: F.count_if(F.col("size") > F.col(c))
    return p.join(p.groupBy("data_id").agg(at(0.45).alias("a"), at(0.6).alias("b")), "data_id").groupBy("data_id").agg(
        above("a").alias("above_low"), above("b").alias("above_high"), (a * 1.1 > b).alias("raised"), ((a > b) == (a * 1.2 > b)).alias("survives_rise"), ((a > b) == (a * 0.85 > b)).alias("survives_drop"),
    )


@query("series_structure", W + SERIES + """, a AS (SELECT *, count(*) OVER (PARTITION BY data_id) // 2 AS half, value - lag(value) OVER w AS d, value > lag(value) OVER w AND value > lead(value) OVER w AS peak FROM ts WINDOW w AS (PARTITION BY data_id ORDER BY t)),
s AS (SELECT data_id, avg(value) AS mean, median(value) AS median, max(value) - min(value) AS span, arg_max(t, (value, -t)) > arg_min(t, (value, t)) AS late, median(CASE WHEN peak THEN value END) AS tops, round(coalesce(avg(CASE WHEN t < half THEN abs(d) END), 0), 6) AS c1, round(coalesce(avg(CASE WHEN t > half THEN abs(d) END), 0), 6) AS c2,
max(CASE WHEN t = half - 1 THEN value END) - max(CASE WHEN t = 0 THEN value END) AS s1, arg_max(value, t) - max(CASE WHEN t = half THEN value END) AS s2 FROM a GROUP BY data_id)
SELECT data_id, CASE WHEN median > mean THEN 'above' ELSE 'below' END AS median_relation, CASE WHEN c1 >= c2 THEN 'first half' ELSE 'second half' END AS stronger_change, CASE WHEN s1 * s2 >= 0 THEN 'yes' ELSE 'no' END AS same_direction, CASE WHEN late THEN 'yes' ELSE 'no' END AS peak_after_trough,
CASE WHEN span / greatest(abs(mean), 1e-8) > 1 THEN 'yes' ELSE 'no' END AS wide, CASE WHEN tops > median THEN 'yes' ELSE 'no' END AS high_maxima FROM s""")
def series_structure(spark, sf_dir):
    """Questions of two and three steps: halves, order of extremes, amplitude, local maxima."""
    v, t, half = F.col("value"), F.col("t"), F.col("half")
    before, after = F.lag("value").over(by_t()), F.lead("value").over(by_t())
    a = series(spark, sf_dir).withColumn("half", F.floor(F.count("*").over(all_t()) / 2)).withColumn("d", v - before).withColumn("peak", (v > before) & (v > after))
    at = lambda k: F.max(F.when(t == k, v))
    change = lambda side: F.round(F.coalesce(F.avg(F.when(side, F.abs("d"))), F.lit(0.0)), 6)
    s = a.groupBy("data_id").agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), (F.max(v) - F.min(v)).alias("span"), (F.max_by("t", F.struct(v, -t)) > F.min_by("t", F.struct(v, t))).alias("late"), F.median(F.when(F.col("peak"), v)).alias("tops"),
        change(t < half).alias("c1"), change(t > half).alias("c2"), (at(half - 1) - at(F.lit(0))).alias("s1"), (F.max_by("value", "t") - at(half)).alias("s2"),
    )
    says = lambda c, yes="yes", no="no": F.when(F.expr(c), yes).otherwise(no)
    return s.select("data_id", says("median > mean", "above", "below").alias("median_relation"), says("c1 >= c2", "first half", "second half").alias("stronger_change"), says("s1 * s2 >= 0").alias("same_direction"), says("late").alias("peak_after_trough"), says("span / greatest(abs(mean), 1e-8D) > 1").alias("wide"), says("tops > median").alias("high_maxima"))


YES = "CASE WHEN {} THEN 'yes' ELSE 'no' END"
NUMBER = "CAST(CAST({} AS DECIMAL(18, 3)) AS VARCHAR(40))"
#: The questions' conditions, in SQL that both engines read.
TABLE_GRAPH = {
    "same_top_node": YES.format("same_top"),
    "degrees_above_median": "CAST(above AS VARCHAR(20))",
    "density_over_spread": YES.format("density > std / 100"),
    "degree_less_mean": NUMBER.format("abs(mean_degree - mean)"),
    "components_over_mean": YES.format("components > mean / 10"),
    "gap_over_spread": YES.format("gap > std"),
    "density_or_mean": "CASE WHEN density * 100 > mean THEN 'graph_density_scaled' ELSE 'table_mean' END",
    "size_over_mean": YES.format("n_edges + n_nodes > whole_mean"),
    "denser_over_mean": YES.format("denser > mean / 100"),
    "smaller_gap_over_degree": YES.format("gap * 0.8 > mean_degree"),
}
SERIES_GRAPH = {
    "components_over_anomalies": YES.format("components > anomalies"),
    "degree_over_spread": YES.format("top > std"),
    "dense_and_volatile": YES.format("density > 0.1 AND volatility > 1"),
    "degree_less_mean": NUMBER.format("abs(mean_degree - mean / 10)"),
    "diameter_over_anomalies": YES.format("diameter > anomalies"),
    "peak_or_edges": "CASE WHEN most > n_edges THEN 'series_peak' ELSE 'graph_edges' END",
    "density_over_volatility": YES.format("density * 10 > volatility"),
    "size_over_median": YES.format("n_nodes + components > whole_median"),
    "denser_over_mean": YES.format("denser > mean / 100"),
    "more_anomalies": YES.format("anomalies + 1 > components"),
}
SHAPE = COMPONENT + """, gs AS (SELECT d.data_id AS graph_id, count(*) AS n_nodes, sum(degree)::BIGINT // 2 AS n_edges, round(avg(degree), 6) AS mean_degree, any_value(k.components) AS components FROM d JOIN k USING (data_id) GROUP BY ALL),
sh AS (SELECT *, 2 * n_edges / greatest(n_nodes * (n_nodes - 1), 1)::DOUBLE AS density, least(1, 2 * (n_edges + 1) / greatest(n_nodes * (n_nodes - 1), 1)::DOUBLE) AS denser FROM gs)"""


def shapes(nodes, edges):
    """graph_id, n_nodes, n_edges, mean_degree, components, density, and denser: the density with one more edge, at most 1."""
    degrees = graph.degrees(nodes, edges).groupBy("data_id").agg(F.count("*").alias("n_nodes"), F.floor(F.sum("degree") / 2).alias("n_edges"), F.round(F.avg("degree"), 6).alias("mean_degree"))
    components = graph.labels(nodes, edges).groupBy("data_id").agg(F.countDistinct("component").alias("components"))
    most = F.greatest(F.col("n_nodes") * (F.col("n_nodes") - 1), F.lit(1))
    out = degrees.join(components, "data_id").withColumnRenamed("data_id", "graph_id")
    return out.withColumn("density", 2 * F.col("n_edges") / most).withColumn("denser", F.least(F.lit(1.0), 2 * (F.col("n_edges") + 1) / most))


def asked(contexts, keys, templates):
    """A row a context and template."""
    every = F.array(*[F.struct(F.lit(k).alias("task"), F.expr(sql).alias("answer")) for k, sql in templates.items()])
    return contexts.select(*keys, F.explode(every).alias("q")).select(*keys, "q.*")


def asked_sql(keys, templates):
    return " UNION ALL ".join(f"SELECT {keys}, '{k}' AS task, {sql} AS answer FROM c" for k, sql in templates.items())


@query("table_graph_templates", "WITH RECURSIVE " + PART + ", " + GRAPHS + DEGREES + SHAPE + """, tab AS (SELECT data_id AS table_id, count(*) AS n, avg(size) AS mean, median(size) AS median, round(stddev_pop(size), 9) AS std FROM part_rows GROUP BY ALL),
v AS (SELECT table_id, d.data_id AS graph_id, node, degree, size AS v, median FROM d CROSS JOIN tab JOIN part_rows p ON p.data_id = table_id AND p.row_idx = node % n),
t AS (SELECT table_id, graph_id, arg_max(node, (degree, -node)) = arg_max(node, (v, -node)) AS same_top, sum((degree > median)::INT)::BIGINT AS above FROM v GROUP BY ALL),
e AS (SELECT a.table_id, a.graph_id, max(abs(a.v - b.v)) AS gap FROM edges JOIN v a ON a.graph_id = edges.data_id AND a.node = src JOIN v b ON b.graph_id = edges.data_id AND b.node = dst AND b.table_id = a.table_id GROUP BY ALL),
c AS (SELECT t.*, coalesce(gap, 0) AS gap, mean, std, round_even(mean, 0) AS whole_mean, n_nodes, n_edges, mean_degree, components, density, denser FROM t JOIN tab USING (table_id) JOIN sh USING (graph_id) LEFT JOIN e USING (table_id, graph_id)) """ + asked_sql("table_id, graph_id", TABLE_GRAPH))
def table_graph_templates(spark, sf_dir):
    """Ten questions over every table laid on every graph."""
    nodes, edges = graphs(spark, sf_dir)
    rows = parts(spark, sf_dir).select(F.col("data_id").alias("table_id"), "row_idx", F.col("size").alias("v"))
    tables = rows.groupBy("table_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.round(F.stddev_pop("v"), 9).alias("std"))
    laid = graph.degrees(nodes, edges).withColumnRenamed("data_id", "graph_id").crossJoin(tables.select("table_id", "n", "median"))  # 7 x 25 nodes for each table
    values = laid.withColumn("row_idx", F.pmod("node", "n")).join(rows, ["table_id", "row_idx"])
    tops = values.groupBy("table_id", "graph_id").agg((F.max_by("node", F.struct("degree", -F.col("node"))) == F.max_by("node", F.struct("v", -F.col("node")))).alias("same_top"), F.count_if(F.col("degree") > F.col("median")).alias("above"))
    at = lambda c, a: values.select("table_id", "graph_id", F.col("node").alias(c), F.col("v").alias(a))
    ends = edges.withColumnRenamed("data_id", "graph_id").join(at("src", "a"), ["graph_id", "src"]).join(at("dst", "b"), ["table_id", "graph_id", "dst"])
    gaps = ends.groupBy("table_id", "graph_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("gap"))
    both = tops.join(tables.withColumn("whole_mean", F.bround("mean")), "table_id").join(F.broadcast(shapes(nodes, edges)), "graph_id").join(gaps, ["table_id", "graph_id"], "left")  # seven graphs
    return asked(both.withColumn("gap", F.coalesce("gap", F.lit(0.0))), ["table_id", "graph_id"], TABLE_GRAPH)


@query("series_graph_templates", "WITH RECURSIVE " + SERIES + ", " + GRAPHS + DEGREES + SHAPE + ", x AS (" + ORACLES["series_graph_context"] + """), s AS (SELECT data_id AS series_id, avg(value) AS mean, max(value) AS most, round_even(median(value), 0) AS whole_median, round(stddev_pop(value), 9) AS std FROM ts GROUP BY ALL),
c AS (SELECT series_id, graph_id, volatility, anomalies, diameter, top, mean, most, whole_median, std, n_nodes, n_edges, sh.mean_degree, components, density, denser FROM x JOIN s USING (series_id) JOIN sh USING (graph_id)) """ + asked_sql("series_id, graph_id", SERIES_GRAPH))
def series_graph_templates(spark, sf_dir):
    """Ten questions over each series beside a graph."""
    x = series_graph_context(spark, sf_dir).drop("mean_degree", "median", "side")
    s = series(spark, sf_dir).groupBy(F.col("data_id").alias("series_id")).agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.bround(F.median("value")).alias("whole_median"), F.round(F.stddev_pop("value"), 9).alias("std"))
    both = x.join(s, "series_id").join(F.broadcast(shapes(*graphs(spark, sf_dir))), "graph_id")  # seven graphs
    return asked(both, ["series_id", "graph_id"], SERIES_GRAPH)


#: Difficulty, task and answer of each question of a series, in pool order.
SERIES_ITEMS = (
    *(("1-hop", task, f"CAST({task} AS VARCHAR(20))") for task in ("peak", "trough", "n", "trend")),
    *(("2-hop", task, f"CAST({task} AS VARCHAR(20))") for task in ("sign_changes", "local_maxima", "median_relation")),
    *(("3-hop", task, task) for task in ("same_direction", "peak_after_trough", "wide", "stronger_change", "high_maxima")),
    *(("counterfactual", task, task) for task in ("scale_peak", "half_shift", "sign_flip", "translation", "scaled_trend")),
)
#: Of each five of twenty series, the items of each difficulty; and the items of a series.
PLAN = ((8, 8, 6, 3), (7, 7, 7, 4), (7, 8, 6, 4), (8, 7, 6, 4))
ITEMS_EACH = 25
LEVELS = ("1-hop", "2-hop", "3-hop", "counterfactual")
PLACED = [(p + 1, LEVELS.index(d) + 1, sum(e[0] == d for e in SERIES_ITEMS[: p + 1]), d, task, sql) for p, (d, task, sql) in enumerate(SERIES_ITEMS)]


@query("series_items", W + ", ".join(f"{a} AS ({ORACLES[n]})" for a, n in (("e", "series_extremes"), ("g", "series_changes"), ("f", "series_counterfactuals"))) + ", s AS (" + ORACLES["series_structure"] + "), x AS (SELECT * FROM e JOIN g USING (data_id) JOIN f USING (data_id) JOIN s USING (data_id)), pool AS ("
       + " UNION ALL ".join(f"SELECT data_id, {p} AS place, {lv} AS level, {k} AS k, '{d}' AS difficulty, '{task}' AS task, {sql} AS answer FROM x" for p, lv, k, d, task, sql in PLACED)
       + f"), c AS (SELECT *, 0 AS turn FROM pool WHERE k <= ({[list(q) for q in PLAN]})[data_id % 20 // 5 + 1][level]), a AS (SELECT * FROM c UNION ALL SELECT pool.*, 1 FROM pool JOIN (SELECT data_id, count(*) AS had FROM c GROUP BY ALL) USING (data_id) WHERE place <= {ITEMS_EACH} - had)"
       + " SELECT data_id, row_number() OVER (PARTITION BY data_id ORDER BY turn, place)::INT AS item, difficulty, task, answer FROM a")
def series_items(spark, sf_dir):
    """Items of each series: of each difficulty the plan's first ones, then the pool from its start until there are enough."""
    x = series_extremes(spark, sf_dir).join(series_changes(spark, sf_dir), "data_id").join(series_counterfactuals(spark, sf_dir), "data_id").join(series_structure(spark, sf_dir), "data_id")
    quota = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, q)) for q in PLAN]), (F.floor(F.col("data_id") % 20 / 5) + 1).cast("int")), F.col("level"))
    every = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(lv).alias("level"), F.lit(k).alias("k"), F.lit(d).alias("difficulty"), F.lit(task).alias("task"), F.expr(sql).alias("answer")) for p, lv, k, d, task, sql in PLACED])
    pool = x.select("data_id", F.explode(every).alias("q")).select("data_id", "q.*").withColumn("own", F.col("k") <= quota)
    had = F.count_if("own").over(Window.partitionBy("data_id"))  # a pool is a few rows a series
    turns = F.array_compact(F.array(F.when(F.col("own"), 0), F.when(F.col("place") <= ITEMS_EACH - F.col("had"), 1)))
    taken = pool.withColumn("had", had).withColumn("turn", F.explode(turns))
    return taken.select("data_id", F.row_number().over(Window.partitionBy("data_id").orderBy("turn", "place")).alias("item"), "difficulty", "task", "answer")
