"""Queries of question templates: series labels and counterfactuals, graph edits, mixed contexts; views of tables and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.statistics import hashed
from tessera.plans.registry import query
from tessera.plans.solvers import PART, all_t, by_t, parts
from tessera.plans.statistics import HASH
from tessera.sources.adapters import GRAPHS, SERIES, graphs, pick, read, series

W = "WITH "
#: Patterns of generated series, by remainder of their ids, and those that have a season.
PATTERNS = ("linear_trend", "seasonal", "trend_seasonal", "random_walk", "step_function", "spike_anomaly", "gradual_drift", "multimodal")
SEASONAL = ("seasonal", "trend_seasonal")
Z = SERIES + ", z AS (SELECT *, round(abs(value - avg(value) OVER p) / greatest(stddev_pop(value) OVER p, 1e-8), 6) AS z, count(*) OVER p AS n FROM ts WINDOW p AS (PARTITION BY data_id))"


def deviations(spark, sf_dir):
    """Series with each point's distance from the mean in standard deviations."""
    v = F.col("value")
    return series(spark, sf_dir).withColumn("z", F.round(F.abs(v - F.avg(v).over(all_t())) / F.greatest(F.stddev_pop(v).over(all_t()), F.lit(1e-8)), 6)).withColumn("n", F.count("*").over(all_t()))


@query("series_labels", W + Z + f" SELECT data_id, any_value(({list(PATTERNS)})[data_id % 8 + 1]) AS pattern, CASE WHEN any_value(({list(PATTERNS)})[data_id % 8 + 1]) IN {SEASONAL} THEN 'yes' ELSE 'no' END AS seasonal, coalesce(min(CASE WHEN z > 2 THEN t END)::VARCHAR, 'none') AS change_point, sum((z > 2)::INT)::BIGINT AS anomalies FROM z GROUP BY data_id")
def series_labels(spark, sf_dir):
    """Seasonality from the pattern's name; the first known anomaly, or none."""
    pattern = pick(PATTERNS, F.col("data_id") % 8)
    rows = deviations(spark, sf_dir).groupBy("data_id").agg(F.min(F.when(F.col("z") > 2, F.col("t"))).alias("first"), F.count_if(F.col("z") > 2).alias("anomalies"))
    return rows.select("data_id", pattern.alias("pattern"), F.when(pattern.isin(*SEASONAL), "yes").otherwise("no").alias("seasonal"), F.coalesce(F.col("first").cast("string"), F.lit("none")).alias("change_point"), "anomalies")


@query("series_counterfactuals", W + SERIES + """, h AS (SELECT *, t < count(*) OVER (PARTITION BY data_id) // 2 AS early FROM ts), s AS (SELECT data_id, round(avg(value) FILTER (WHERE early), 6) AS a, round(avg(value) FILTER (WHERE NOT early), 6) AS b, arg_max(t, (value, -t)) AS peak, arg_min(t, (value, t)) AS trough, arg_max(t, (value * 1.1, -t)) AS scaled_peak, arg_max(t, (-value, -t)) AS flipped_peak, arg_min(value, t) AS first, arg_max(value, t) AS last FROM h GROUP BY data_id)
SELECT data_id, CASE WHEN scaled_peak <> peak THEN 'yes' ELSE 'no' END AS scale_peak, CASE WHEN b + 5 > a THEN 'yes' ELSE 'no' END AS half_shift, CASE WHEN flipped_peak = trough THEN 'yes' ELSE 'no' END AS sign_flip, CASE WHEN (last + 2 > first + 2) <> (last > first) THEN 'yes' ELSE 'no' END AS translation, CASE WHEN last * 1.1 > first * 1.1 THEN 'upward' ELSE 'downward' END AS scaled_trend FROM s""")
def series_counterfactuals(spark, sf_dir):
    """A tenth more, five more in the second half, the sign turned, two more everywhere: computed on the changed series."""
    h = series(spark, sf_dir).withColumn("early", F.col("t") < F.floor(F.count("*").over(all_t()) / 2))
    v, back = F.col("value"), (-F.col("t")).alias("t")
    peak = lambda x: F.max_by("t", F.struct(x.alias("v"), back))
    half = lambda e: F.round(F.avg(F.when(F.col("early") == e, v)), 6)
    s = h.groupBy("data_id").agg(half(True).alias("a"), half(False).alias("b"), peak(v).alias("peak"), F.min_by("t", F.struct("value", "t")).alias("trough"), peak(v * 1.1).alias("scaled"), peak(-v).alias("flipped"), F.min_by("value", "t").alias("first"), F.max_by("value", "t").alias("last"))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    first, last = F.col("first"), F.col("last")
    return s.select("data_id", yes(F.col("scaled") != F.col("peak")).alias("scale_peak"), yes(F.col("b") + 5 > F.col("a")).alias("half_shift"), yes(F.col("flipped") == F.col("trough")).alias("sign_flip"), yes((last + 2 > first + 2) != (last > first)).alias("translation"), F.when(last * 1.1 > first * 1.1, "upward").otherwise("downward").alias("scaled_trend"))


DEGREES = ", d AS (SELECT n.data_id, node, count(v) AS degree FROM nodes n LEFT JOIN sym ON n.data_id = sym.data_id AND node = u GROUP BY ALL)"
COMPONENT = ", r(data_id, a, b) AS (SELECT data_id, node, node FROM nodes UNION SELECT r.data_id, r.a, sym.v FROM r JOIN sym ON r.data_id = sym.data_id AND r.b = sym.u), k AS (SELECT data_id, count(DISTINCT c) AS components FROM (SELECT data_id, a, min(b) AS c FROM r GROUP BY ALL) GROUP BY ALL)"


@query("graph_counts", "WITH RECURSIVE " + GRAPHS + DEGREES + COMPONENT + """, e AS (SELECT data_id, sum(degree)::BIGINT // 2 AS m, count(*) AS n, median(degree) AS med, arg_max(node, (degree, -node)) AS top FROM d GROUP BY ALL)
SELECT e.data_id, n, m, components, components = 1 AS connected, round(2.0 * m / (n * (n - 1)), 9) AS density, round(least(1.0, 2.0 * (m + 1) / (n * (n - 1))), 9) AS density_with_edge, top, (SELECT count(*) FROM d WHERE d.data_id = e.data_id AND degree > med) AS above_median FROM e JOIN k USING (data_id)""")
def graph_counts(spark, sf_dir):
    """Nodes, edges, components, density as it is and with an edge more, nodes of more than the median degree."""
    nodes, edges = graphs(spark, sf_dir)
    d = graph.degrees(nodes, edges)
    e = d.groupBy("data_id").agg(F.floor(F.sum("degree") / 2).alias("m"), F.count("*").alias("n"), F.median("degree").alias("med"), F.max_by("node", F.struct(F.col("degree"), -F.col("node"))).alias("top"))
    above = d.join(F.broadcast(e.select("data_id", "med")), "data_id").groupBy("data_id").agg(F.count_if(F.col("degree") > F.col("med")).alias("above_median"))  # a row a graph
    components = graph.labels(nodes, edges).groupBy("data_id").agg(F.count_distinct("component").alias("components"))
    pairs = F.col("n") * (F.col("n") - 1)
    return e.join(components, "data_id").join(above, "data_id").select("data_id", "n", "m", "components", (F.col("components") == 1).alias("connected"), F.round(2.0 * F.col("m") / pairs, 9).alias("density"), F.round(F.least(F.lit(1.0), 2.0 * (F.col("m") + 1) / pairs), 9).alias("density_with_edge"), "top", "above_median")


ADDED = """, p AS (SELECT a.data_id, a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON a.data_id = b.data_id AND a.node < b.node LEFT JOIN edges e ON e.data_id = a.data_id AND e.src = a.node AND e.dst = b.node WHERE e.src IS NULL), f AS (SELECT data_id, min((u, v)) AS f FROM p GROUP BY ALL)"""


@query("graph_added_edges", "WITH RECURSIVE " + GRAPHS + ADDED + COMPONENT + ", l AS (SELECT data_id, a, min(b) AS c FROM r GROUP BY ALL), m AS (SELECT data_id, count(*) AS m FROM edges GROUP BY ALL) SELECT f.data_id, f[1] AS u, f[2] AS v, 'yes' AS connected, components - (x.c <> y.c)::INT AS components, coalesce(m, 0) + 1 AS edges, coalesce(m, 0) - 1 AS edges_less FROM f JOIN l x ON x.data_id = f.data_id AND x.a = f[1] JOIN l y ON y.data_id = f.data_id AND y.a = f[2] JOIN k ON k.data_id = f.data_id LEFT JOIN m ON m.data_id = f.data_id")
def graph_added_edges(spark, sf_dir):
    """The first pair without an edge: with one it is connected, and components that it joins are one fewer."""
    nodes, edges = graphs(spark, sf_dir)
    pairs = nodes.withColumnRenamed("node", "u").join(nodes.withColumnRenamed("node", "v"), "data_id").filter("u < v")  # 25 nodes a graph
    lacking = pairs.join(edges.withColumnsRenamed({"src": "u", "dst": "v"}), ["data_id", "u", "v"], "left_anti")
    first = lacking.groupBy("data_id").agg(F.min(F.struct("u", "v")).alias("f")).select("data_id", "f.u", "f.v")
    labels = graph.labels(nodes, edges)
    side = lambda c, a: labels.select("data_id", F.col("node").alias(c), F.col("component").alias(a))
    sizes = labels.groupBy("data_id").agg(F.count_distinct("component").alias("k")).join(edges.groupBy("data_id").agg(F.count("*").alias("m")), "data_id", "left")
    both = first.join(side("u", "x"), ["data_id", "u"]).join(side("v", "y"), ["data_id", "v"]).join(sizes, "data_id")
    m = F.coalesce("m", F.lit(0))
    return both.select("data_id", "u", "v", F.lit("yes").alias("connected"), (F.col("k") - (F.col("x") != F.col("y")).cast("int")).alias("components"), (m + 1).alias("edges"), (m - 1).alias("edges_less"))


@query("graph_widths", W + GRAPHS + DEGREES + ", x AS (SELECT data_id, max(degree) AS most FROM d GROUP BY ALL) SELECT e.data_id, src, dst, round(0.5 + 2.5 * (a.degree + b.degree) / (2.0 * most), 6) AS width FROM edges e JOIN d a ON a.data_id = e.data_id AND a.node = src JOIN d b ON b.data_id = e.data_id AND b.node = dst JOIN x ON x.data_id = e.data_id")
def graph_widths(spark, sf_dir):
    """Edges as wide as their ends' degrees are great."""
    nodes, edges = graphs(spark, sf_dir)
    d = graph.degrees(nodes, edges)
    end = lambda c, a: d.select("data_id", F.col("node").alias(c), F.col("degree").alias(a))
    both = edges.join(end("src", "a"), ["data_id", "src"]).join(end("dst", "b"), ["data_id", "dst"]).join(d.groupBy("data_id").agg(F.max("degree").alias("most")), "data_id")
    return both.select("data_id", "src", "dst", F.round(0.5 + 2.5 * (F.col("a") + F.col("b")) / (2.0 * F.col("most")), 6).alias("width"))


@query("graph_footers", W + GRAPHS + DEGREES + " SELECT data_id, coalesce(string_agg(node::VARCHAR, ', ' ORDER BY node) FILTER (WHERE degree = 0), 'none') AS isolated, string_agg(node || ':' || degree, ' ' ORDER BY node) AS degrees FROM d GROUP BY data_id")
def graph_footers(spark, sf_dir):
    """Nodes without an edge, and all nodes' degrees."""
    d = graph.degrees(*graphs(spark, sf_dir))
    listed = F.sort_array(F.collect_list(F.struct("node", "degree")))
    alone = F.array_join(F.transform(F.filter(listed, lambda x: x["degree"] == 0), lambda x: x["node"].cast("string")), ", ")
    return d.groupBy("data_id").agg(F.when(alone == "", "none").otherwise(alone).alias("isolated"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["node"], x["degree"])), " ").alias("degrees"))


CONTEXT = PART + ", " + SERIES + """, tab AS (SELECT data_id, row_number() OVER (ORDER BY data_id) - 1 AS k, count(*) AS n, avg(size) AS mean, max(size) AS most, round(stddev_pop(size), 9) AS std, max(size) - min(size) AS span, arg_min(size, row_idx) AS first, arg_max(size, row_idx) AS last FROM part_rows GROUP BY data_id),
s AS (SELECT data_id AS k, count(*) AS n, avg(value) AS mean, max(value) AS most, round(stddev_pop(value), 9) AS std, max(value) - min(value) AS span, arg_min(value, t) AS first, arg_max(value, t) AS last FROM ts GROUP BY data_id),
g AS (SELECT tab.data_id AS left_id, s.k AS right_id, row_idx, size, row_idx * (s.n - 1) / greatest(tab.n - 1, 1)::DOUBLE AS x, tab.mean AS tmean FROM tab JOIN s ON tab.k = s.k JOIN part_rows p ON p.data_id = tab.data_id),
i AS (SELECT left_id, right_id, g.size, tmean, a.value + (x - floor(x)) * (b.value - a.value) AS v FROM g JOIN ts a ON a.data_id = right_id AND a.t = floor(x)::BIGINT JOIN ts b ON b.data_id = right_id AND b.t = ceil(x)::BIGINT),
r AS (SELECT left_id, right_id, CASE WHEN stddev_pop(size) <= 1e-12 OR stddev_pop(v) <= 1e-12 THEN 0 ELSE round(corr(size, v), 6) END AS r, sum((size > tmean)::INT)::BIGINT AS above FROM i GROUP BY ALL),
c AS (SELECT r.*, tab.mean AS tmean, s.mean AS smean, tab.most AS tmost, s.most AS smost, tab.std AS tstd, s.std AS sstd, tab.span AS tspan, s.span AS sspan, tab.last >= tab.first AS trise, s.last >= s.first AS srise FROM r JOIN tab ON tab.data_id = left_id JOIN s ON s.k = right_id)"""


def context(spark, sf_dir):
    """The n-th table beside the n-th series: statistics of both, and Pearson's r after the series is laid on the table's rows."""
    p, ts = parts(spark, sf_dir), series(spark, sf_dir)

    def described(rows, value, order, prefix):
        v = F.col(value)
        return rows.groupBy("data_id").agg(F.count("*").alias(prefix + "n"), F.avg(v).alias(prefix + "mean"), F.max(v).alias(prefix + "most"), F.round(F.stddev_pop(v), 9).alias(prefix + "std"), (F.max(v) - F.min(v)).alias(prefix + "span"), (F.max_by(value, order) >= F.min_by(value, order)).alias(prefix + "rise"))

    tables = described(p, "size", "row_idx", "t").withColumn("k", F.row_number().over(Window.orderBy("data_id")) - 1).withColumnRenamed("data_id", "left_id")  # a row a brand
    both = tables.join(described(ts, "value", "t", "s").withColumnRenamed("data_id", "right_id"), F.col("k") == F.col("right_id"))
    x = F.col("row_idx") * (F.col("sn") - 1) / F.greatest(F.col("tn") - 1, F.lit(1)).cast("double")
    rows = both.select("left_id", "right_id", "tn", "sn", "tmean").join(p.withColumnRenamed("data_id", "left_id"), "left_id").withColumn("x", x).withColumn("lo", F.floor("x")).withColumn("hi", F.ceil("x"))
    at = lambda c, a: ts.select(F.col("data_id").alias("right_id"), F.col("t").alias(c), F.col("value").alias(a))
    laid = rows.join(at("lo", "a"), ["right_id", "lo"]).join(at("hi", "b"), ["right_id", "hi"]).withColumn("v", F.col("a") + (F.col("x") - F.col("lo")) * (F.col("b") - F.col("a")))
    flat = (F.stddev_pop("size") <= 1e-12) | (F.stddev_pop("v") <= 1e-12)
    r = laid.groupBy("left_id", "right_id").agg(F.when(flat, 0.0).otherwise(F.round(F.corr("size", "v"), 6)).alias("r"), F.count_if(F.col("size") > F.col("tmean")).alias("above"))
    return both.join(r, ["left_id", "right_id"])


@query("mixed_context", W + CONTEXT + " SELECT left_id, right_id, r, above, round(tmean, 6) AS table_mean, round(smean, 6) AS series_mean, tstd AS table_std, sstd AS series_std, tspan AS table_span, round(sspan, 6) AS series_span, trise AS table_rises, srise AS series_rises FROM c")
def mixed_context(spark, sf_dir):
    return context(spark, sf_dir).select("left_id", "right_id", "r", "above", F.round("tmean", 6).alias("table_mean"), F.round("smean", 6).alias("series_mean"), F.col("tstd").alias("table_std"), F.col("sstd").alias("series_std"), F.col("tspan").alias("table_span"), F.round("sspan", 6).alias("series_span"), F.col("trise").alias("table_rises"), F.col("srise").alias("series_rises"))


#: Questions over a table beside a series: difficulty and answer, as a condition (yes or no), a choice or a number, in SQL that both engines read.
TEMPLATES = {
    "mean_greater": ("1-hop", "CASE WHEN tmean > smean THEN 'yes' ELSE 'no' END"),
    "peak_greater": ("1-hop", "CASE WHEN tmost > smost THEN 'yes' ELSE 'no' END"),
    "spread_greater": ("2-hop", "CASE WHEN tstd > sstd THEN 'yes' ELSE 'no' END"),
    "range_side": ("2-hop", "CASE WHEN tspan >= sspan THEN 'table' ELSE 'series' END"),
    "same_trend": ("2-hop", "CASE WHEN trise = srise THEN 'yes' ELSE 'no' END"),
    "rows_above": ("2-hop", "CAST(above AS VARCHAR(20))"),
    "positive_relation": ("3-hop", "CASE WHEN r > 0 THEN 'yes' ELSE 'no' END"),
    "strong_relation": ("3-hop", "CASE WHEN abs(r) > 0.5 THEN 'yes' ELSE 'no' END"),
    "doubled_mean": ("counterfactual", "CASE WHEN 2 * tmean > smean THEN 'yes' ELSE 'no' END"),
    "raised_peak": ("counterfactual", "CASE WHEN tmost + 10 > smost THEN 'yes' ELSE 'no' END"),
}


@query("mixed_templates", W + CONTEXT + ", q AS (" + " UNION ALL ".join(f"SELECT left_id, right_id, '{k}' AS task, '{d}' AS difficulty, {sql} AS answer FROM c" for k, (d, sql) in TEMPLATES.items()) + f"), o AS (SELECT *, row_number() OVER (PARTITION BY left_id, difficulty ORDER BY {HASH.format(chr(39) + '5:' + chr(39) + ' || left_id || task')}, task) AS k FROM q) SELECT 'mixed-' || left_id || '-' || difficulty || '-' || k AS item_id, right_id, task, difficulty, answer FROM o WHERE k <= 3")
def mixed_templates(spark, sf_dir):
    """Templates over each context, of each difficulty three by hash order, numbered."""
    c = context(spark, sf_dir)
    every = F.array(*[F.struct(F.lit(k).alias("task"), F.lit(d).alias("difficulty"), F.expr(sql).alias("answer")) for k, (d, sql) in TEMPLATES.items()])
    q = c.select("left_id", "right_id", F.explode(every).alias("q")).select("left_id", "right_id", "q.*")
    place = Window.partitionBy("left_id", "difficulty").orderBy(hashed(F.lit(5), F.concat("left_id", "task")), "task")
    kept = q.withColumn("k", F.row_number().over(place)).filter("k <= 3")
    return kept.select(F.concat_ws("-", F.lit("mixed"), "left_id", "difficulty", "k").alias("item_id"), "right_id", "task", "difficulty", "answer")


@query("series_graph_context", "WITH RECURSIVE " + Z + ", " + GRAPHS + DEGREES + """, v AS (SELECT data_id, z, value, value - lag(value) OVER (PARTITION BY data_id ORDER BY t) AS d FROM z), s AS (SELECT data_id, round(stddev_pop(d), 6) AS volatility, sum((z > 2)::INT)::BIGINT AS anomalies, round(median(value), 6) AS median FROM v GROUP BY ALL),
b(data_id, s, node, d) AS (SELECT data_id, node, node, 0 FROM nodes UNION SELECT b.data_id, b.s, sym.v, b.d + 1 FROM b JOIN sym ON b.data_id = sym.data_id AND b.node = sym.u WHERE b.d < 24), l AS (SELECT data_id, s, node, min(d) AS d FROM b GROUP BY ALL), c AS (SELECT data_id, s, count(*) AS size, max(d) AS ecc, min(node) AS part FROM l GROUP BY ALL),
w AS (SELECT data_id, arg_max(part, (size, -part)) AS part FROM c GROUP BY ALL), m AS (SELECT c.data_id, max(ecc) AS diameter FROM c JOIN w USING (data_id, part) GROUP BY ALL), e AS (SELECT data_id, max(degree) AS top, avg(degree) AS mean FROM d GROUP BY ALL)
SELECT s.data_id AS series_id, e.data_id AS graph_id, volatility, anomalies, median, diameter::BIGINT AS diameter, top, round(mean, 6) AS mean_degree, CASE WHEN anomalies > diameter THEN 'series' ELSE 'graph' END AS side FROM s JOIN e ON e.data_id = s.data_id % 7 + 1 JOIN m ON m.data_id = e.data_id""")
def series_graph_context(spark, sf_dir):
    """Each series beside a graph: spread of changes, points beyond two deviations; diameter of the largest component, degrees."""
    v = deviations(spark, sf_dir).withColumn("d", F.col("value") - F.lag("value").over(by_t()))
    s = v.groupBy("data_id").agg(F.round(F.stddev_pop("d"), 6).alias("volatility"), F.count_if(F.col("z") > 2).alias("anomalies"), F.round(F.median("value"), 6).alias("median"))
    nodes, edges = graphs(spark, sf_dir)
    labels = graph.labels(nodes, edges)
    sizes = labels.groupBy("data_id", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("data_id").agg(F.max_by("component", F.struct(F.col("size"), -F.col("component"))).alias("component"))
    inside = labels.join(largest, ["data_id", "component"]).select("data_id", "node")
    own = edges.join(inside.withColumnRenamed("node", "src"), ["data_id", "src"], "left_semi").select("data_id", "src", "dst")
    diameter = graph.summaries(inside, own).select("data_id", F.col("diameter").cast("long").alias("diameter"))
    degrees = graph.degrees(nodes, edges).groupBy("data_id").agg(F.max("degree").alias("top"), F.round(F.avg("degree"), 6).alias("mean_degree"))
    graphs_ = degrees.join(diameter, "data_id").withColumnRenamed("data_id", "graph_id")
    both = s.withColumn("graph_id", F.col("data_id") % 7 + 1).join(F.broadcast(graphs_), "graph_id")  # seven graphs
    return both.select(F.col("data_id").alias("series_id"), "graph_id", "volatility", "anomalies", "median", "diameter", "top", "mean_degree", F.when(F.col("anomalies") > F.col("diameter"), "series").otherwise("graph").alias("side"))


@query("assist_tables", W + PART + " SELECT data_id, row_idx::VARCHAR AS row_name, round(size, 3) AS size, round(price, 3) AS price FROM part_rows UNION ALL SELECT data_id, 'mean', round(avg(size), 3), round(avg(price), 3) FROM part_rows GROUP BY data_id")
def assist_tables(spark, sf_dir):
    """All rows of a table, and a row of means."""
    p = parts(spark, sf_dir)
    rows = p.select("data_id", F.col("row_idx").cast("string").alias("row_name"), F.round("size", 3).alias("size"), F.round("price", 3).alias("price"))
    return rows.unionByName(p.groupBy("data_id").agg(F.lit("mean").alias("row_name"), F.round(F.avg("size"), 3).alias("size"), F.round(F.avg("price"), 3).alias("price")))


NUMBERS = "u AS (SELECT p_brand AS data_id, p_size::DOUBLE AS size, p_retailprice AS price, (p_partkey % 13)::DOUBLE AS code FROM part)"


@query("scatter_pairs", W + NUMBERS + ", p AS (SELECT data_id, 'code' AS x, 'price' AS y, abs(round(corr(code, price), 6)) AS r FROM u GROUP BY ALL UNION ALL SELECT data_id, 'code', 'size', abs(round(corr(code, size), 6)) FROM u GROUP BY ALL UNION ALL SELECT data_id, 'price', 'size', abs(round(corr(price, size), 6)) FROM u GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY r DESC, x, y) AS k FROM p) SELECT data_id, x, y, r, k FROM k WHERE k <= 2")
def scatter_pairs(spark, sf_dir):
    """Pairs of columns by the strength of their relation, the first two a table."""
    u = read(spark, sf_dir, "part").select(F.col("p_brand").alias("data_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 13).cast("double").alias("code"))
    pairs = (("code", "price"), ("code", "size"), ("price", "size"))
    wide = u.groupBy("data_id").agg(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.abs(F.round(F.corr(x, y), 6)).alias("r")) for x, y in pairs]).alias("p"))
    long = wide.select("data_id", F.explode("p").alias("p")).select("data_id", "p.*")
    return long.withColumn("k", F.row_number().over(Window.partitionBy("data_id").orderBy(F.desc("r"), "x", "y"))).filter("k <= 2")
