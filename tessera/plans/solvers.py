"""Answer solvers over tables, series and graphs, and what their pictures show."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph, pairs
from tessera.plans.registry import query
from tessera.sources.adapters import GRAPHS, SERIES, graphs, read, series

W = "WITH "


def by_t():
    """A series in order."""
    return Window.partitionBy("data_id").orderBy("t")


def all_t():
    return Window.partitionBy("data_id")


def least_t(value):
    """The index of the greatest ``value``, the first on a tie."""
    return F.max_by("t", F.struct(value.alias("v"), (-F.col("t")).alias("t")))


@query("series_extremes", W + SERIES + """, m AS (SELECT *, avg(value) OVER (PARTITION BY data_id) AS mu FROM ts)
SELECT data_id, count(*) AS n, arg_max(t, (value, -t)) AS peak, arg_min(t, (value, t)) AS trough, max(value) - min(value) AS span, arg_min(value, t) AS first, arg_max(value, t) AS last, CASE WHEN arg_max(value, t) > arg_min(value, t) THEN 'upward' ELSE 'downward' END AS trend FROM m GROUP BY data_id""")
def series_extremes(spark, sf_dir):
    s = series(spark, sf_dir)
    v = F.col("value")
    first, last = F.min_by("value", "t"), F.max_by("value", "t")
    return s.groupBy("data_id").agg(F.count("*").alias("n"), least_t(v).alias("peak"), F.min_by("t", F.struct("value", "t")).alias("trough"), (F.max(v) - F.min(v)).alias("span"), first.alias("first"), last.alias("last"), F.when(last > first, "upward").otherwise("downward").alias("trend"))


@query("series_anomaly", W + SERIES + """, m AS (SELECT *, round(abs(value - avg(value) OVER (PARTITION BY data_id)), 6) AS d FROM ts) SELECT data_id, arg_max(t, (d, -t)) AS anomaly, round(max(d), 4) AS distance FROM m GROUP BY data_id HAVING count(*) >= 5""")
def series_anomaly(spark, sf_dir):
    m = series(spark, sf_dir).withColumn("d", F.round(F.abs(F.col("value") - F.avg("value").over(all_t())), 6))
    return m.groupBy("data_id").agg(least_t(F.col("d")).alias("anomaly"), F.round(F.max("d"), 4).alias("distance"), F.count("*").alias("n")).filter("n >= 5").drop("n")


@query("series_forecast", W + SERIES + """, r AS (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY t DESC) AS k FROM ts) SELECT data_id, round(2 * max(CASE WHEN k = 1 THEN value END) - max(CASE WHEN k = 2 THEN value END), 6) AS forecast FROM r GROUP BY data_id HAVING count(*) >= 4""")
def series_forecast(spark, sf_dir):
    r = series(spark, sf_dir).withColumn("before", F.lag("value").over(by_t())).groupBy("data_id").agg(F.max_by("value", "t").alias("x"), F.max_by("before", "t").alias("y"), F.count("*").alias("n"))
    return r.filter("n >= 4").select("data_id", F.round(2 * F.col("x") - F.col("y"), 6).alias("forecast"))


@query("series_halves", W + SERIES + """, h AS (SELECT *, t < count(*) OVER (PARTITION BY data_id) // 2 AS early FROM ts), s AS (SELECT data_id, round(stddev_pop(value) FILTER (WHERE early), 9) AS a, round(stddev_pop(value) FILTER (WHERE NOT early), 9) AS b, avg(value) FILTER (WHERE early) AS ma, avg(value) FILTER (WHERE NOT early) AS mb FROM h GROUP BY data_id)
SELECT data_id, CASE WHEN abs(a - b) < 1e-9 THEN 'equal' WHEN a > b THEN 'first half' ELSE 'second half' END AS volatility, round(mb - ma, 6) AS mean_shift, CASE WHEN round(mb - ma, 6) > 0 THEN 'higher' ELSE 'lower' END AS direction FROM s""")
def series_halves(spark, sf_dir):
    h = series(spark, sf_dir).withColumn("early", F.col("t") < F.floor(F.count("*").over(all_t()) / 2))
    side = lambda f, e: f(F.when(F.col("early") == e, F.col("value")))
    s = h.groupBy("data_id").agg(F.round(side(F.stddev_pop, True), 9).alias("a"), F.round(side(F.stddev_pop, False), 9).alias("b"), F.round(side(F.avg, False) - side(F.avg, True), 6).alias("mean_shift"))
    volatility = F.when(F.abs(F.col("a") - F.col("b")) < 1e-9, "equal").when(F.col("a") > F.col("b"), "first half").otherwise("second half")
    return s.select("data_id", volatility.alias("volatility"), "mean_shift", F.when(F.col("mean_shift") > 0, "higher").otherwise("lower").alias("direction"))


@query("series_changes", W + SERIES + """, d AS (SELECT *, value - lag(value) OVER w AS d, lag(value) OVER w AS p, lead(value) OVER w AS q FROM ts WINDOW w AS (PARTITION BY data_id ORDER BY t)), e AS (SELECT *, lag(d) OVER (PARTITION BY data_id ORDER BY t) AS pd FROM d)
SELECT data_id, round(avg(abs(d)), 6) AS mean_change, coalesce(sum((sign(d) * sign(pd) < 0)::INT), 0)::BIGINT AS sign_changes, coalesce(sum((value > p AND value > q)::INT), 0)::BIGINT AS local_maxima, round(stddev_pop(d), 6) AS change_std FROM e GROUP BY data_id""")
def series_changes(spark, sf_dir):
    d = series(spark, sf_dir).withColumn("p", F.lag("value").over(by_t())).withColumn("q", F.lead("value").over(by_t())).withColumn("d", F.col("value") - F.col("p"))
    e = d.withColumn("turn", F.signum("d") * F.signum(F.lag("d").over(by_t())) < 0)
    peak = (F.col("value") > F.col("p")) & (F.col("value") > F.col("q"))
    return e.groupBy("data_id").agg(F.round(F.avg(F.abs("d")), 6).alias("mean_change"), F.count_if("turn").alias("sign_changes"), F.count_if(peak).alias("local_maxima"), F.round(F.stddev_pop("d"), 6).alias("change_std"))


@query("series_threshold", W + SERIES + """, m AS (SELECT data_id, value, round(avg(value) OVER (PARTITION BY data_id) + stddev_pop(value) OVER (PARTITION BY data_id), 6) AS lim, avg(value) OVER (PARTITION BY data_id) AS mu FROM ts)
SELECT data_id, sum((value > lim)::INT)::BIGINT AS above, CASE WHEN median(value) > any_value(round(mu, 9)) THEN 'median' ELSE 'mean' END AS greater, coalesce((max(value) - min(value)) / nullif(abs(any_value(round(mu, 9))), 0) > 1, false) AS wide FROM m GROUP BY data_id""")
def series_threshold(spark, sf_dir):
    m = series(spark, sf_dir).withColumn("lim", F.round(F.avg("value").over(all_t()) + F.stddev_pop("value").over(all_t()), 6)).withColumn("mu", F.round(F.avg("value").over(all_t()), 9))
    wide = F.coalesce(F.try_divide(F.max("value") - F.min("value"), F.abs(F.first("mu"))) > 1, F.lit(False))
    return m.groupBy("data_id").agg(F.count_if(F.col("value") > F.col("lim")).alias("above"), F.when(F.median("value") > F.first("mu"), "median").otherwise("mean").alias("greater"), wide.alias("wide"))


@query("series_windows", W + SERIES + """ SELECT data_id, t // 20 AS win, count(*) AS n, min(value) AS lo, max(value) AS hi, arg_max(value, t) AS last FROM ts GROUP BY ALL""")
def series_windows(spark, sf_dir):
    return series(spark, sf_dir).groupBy("data_id", F.floor(F.col("t") / 20).alias("win")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max_by("value", "t").alias("last"))


@query("series_cumulative", W + SERIES + """ SELECT data_id, t, round(sum(value) OVER (PARTITION BY data_id ORDER BY t), 4) AS total FROM ts""")
def series_cumulative(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.select("data_id", "t", F.round(F.sum("value").over(by_t().rowsBetween(Window.unboundedPreceding, 0)), 4).alias("total"))


@query("series_interpolated", W + SERIES + """, n AS (SELECT data_id, count(*) AS n FROM ts GROUP BY ALL), g AS (SELECT data_id, i, i * (n - 1) / 9.0::DOUBLE AS x FROM n, range(10) r(i) WHERE n >= 2)
SELECT g.data_id, i, round(a.value + (x - floor(x)) * (b.value - a.value), 6) AS value FROM g JOIN ts a ON a.data_id = g.data_id AND a.t = floor(x)::BIGINT JOIN ts b ON b.data_id = g.data_id AND b.t = ceil(x)::BIGINT""")
def series_interpolated(spark, sf_dir):
    """Each series on ten evenly spaced places, linear between points."""
    s = series(spark, sf_dir)
    grid = s.groupBy("data_id").agg(F.count("*").alias("n")).filter("n >= 2").select("data_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("i"))
    grid = grid.withColumn("x", F.col("i") * (F.col("n") - 1) / F.lit(9.0)).withColumn("lo", F.floor("x")).withColumn("hi", F.ceil("x"))
    a, b = s.select("data_id", F.col("t").alias("lo"), F.col("value").alias("a")), s.select("data_id", F.col("t").alias("hi"), F.col("value").alias("b"))
    both = grid.join(a, ["data_id", "lo"]).join(b, ["data_id", "hi"])
    return both.select("data_id", "i", F.round(F.col("a") + (F.col("x") - F.col("lo")) * (F.col("b") - F.col("a")), 6).alias("value"))


@query("series_recurrence", W + SERIES + """, p AS (SELECT a.data_id, a.t AS i, b.t AS j, abs(a.value - b.value) AS d FROM ts a JOIN ts b ON a.data_id = b.data_id), q AS (SELECT data_id, quantile_cont(d, 0.2) AS lim FROM p GROUP BY ALL)
SELECT data_id, sum((d <= lim)::INT)::BIGINT AS recurrent, count(*) AS cells FROM p JOIN q USING (data_id) GROUP BY data_id""")
def series_recurrence(spark, sf_dir):
    """All pairs of one picture's points, none of which is made: distances are counted over the sorted values."""
    s = series(spark, sf_dir).groupBy("data_id").agg(F.sort_array(F.collect_list("value")).alias("v"), F.count("*").alias("n"))
    return s.select("data_id", pairs.recurrent(F.col("v"), 0.2).alias("recurrent"), (F.col("n") * F.col("n")).alias("cells"))


@query("series_angular_field", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: 2 * (x::DOUBLE - list_min(embedding)) / (list_max(embedding)::DOUBLE - list_min(embedding)) - 1) AS s FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(s, lambda x: 2 * x * x - 1)), 4) AS trace, len(s) AS n FROM v""")
def series_angular_field(spark, sf_dir):
    """Gramian angular field: entries xi*xj - sqrt(1-xi^2)*sqrt(1-xj^2) of values scaled to [-1, 1]; its trace."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    lo, hi = F.array_min(v), F.array_max(v)
    scaled = F.transform(v, lambda x: F.lit(2.0) * (x - lo) / (hi - lo) - 1)
    cell = lambda a, b: a * b - F.sqrt(F.greatest(F.lit(0.0), 1 - a * a)) * F.sqrt(F.greatest(F.lit(0.0), 1 - b * b))
    return read(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("s")).select("vec_id", F.round(F.aggregate("s", F.lit(0.0), lambda t, x: t + cell(x, x)), 4).alias("trace"), F.size("s").alias("n"))


PART = "part_rows AS (SELECT p_brand AS data_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_idx, p_name AS label, p_size::DOUBLE AS size, p_retailprice AS price FROM part)"


def parts(spark, sf_dir):
    """One table a brand: rows in key order, a label and two numeric columns."""
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("data_id"), (F.row_number().over(order) - 1).alias("row_idx"), F.col("p_name").alias("label"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


@query("table_answers", W + PART + """, s AS (SELECT data_id, round(quantile_cont(size, 0.6), 2) AS lim FROM part_rows GROUP BY ALL)
SELECT data_id, count(*) AS n, sum(size) AS total, avg(size) AS mean, median(size) AS median, CASE WHEN arg_max(size, row_idx) > arg_min(size, row_idx) THEN 'increasing' ELSE 'decreasing' END AS trend, arg_max(label, (size, -row_idx)) AS highest, arg_min(label, (size, row_idx)) AS lowest,
sum((size > lim)::INT)::BIGINT AS above, CASE WHEN avg(size) > avg(price) THEN 'size' ELSE 'price' END AS greater, (avg(size) > avg(price)) = (avg(size) * 1.2 > avg(price)) AS survives FROM part_rows JOIN s USING (data_id) GROUP BY data_id""")
def table_answers(spark, sf_dir):
    p = parts(spark, sf_dir)
    lim = p.groupBy("data_id").agg(F.round(F.percentile("size", F.lit(0.6)), 2).alias("lim"))
    a, b = F.avg("size"), F.avg("price")
    trend = F.when(F.max_by("size", "row_idx") > F.min_by("size", "row_idx"), "increasing").otherwise("decreasing")
    return p.join(lim, "data_id").groupBy("data_id").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), a.alias("mean"), F.median("size").alias("median"), trend.alias("trend"),
        F.max_by("label", F.struct("size", -F.col("row_idx"))).alias("highest"), F.min_by("label", F.struct("size", "row_idx")).alias("lowest"),
        F.count_if(F.col("size") > F.col("lim")).alias("above"), F.when(a > b, "size").otherwise("price").alias("greater"), ((a > b) == (a * 1.2 > b)).alias("survives"),
    )


@query("table_outlier", W + PART + """, m AS (SELECT *, round(abs(price - avg(price) OVER (PARTITION BY data_id)), 6) AS d FROM part_rows) SELECT data_id, arg_max(label, (d, -row_idx)) AS outlier, round(max(d), 4) AS distance FROM m GROUP BY data_id""")
def table_outlier(spark, sf_dir):
    m = parts(spark, sf_dir).withColumn("d", F.round(F.abs(F.col("price") - F.avg("price").over(Window.partitionBy("data_id"))), 6))
    return m.groupBy("data_id").agg(F.max_by("label", F.struct("d", -F.col("row_idx"))).alias("outlier"), F.round(F.max("d"), 4).alias("distance"))


@query("table_correlation", W + PART + """ SELECT data_id, round(corr(size, price), 6) AS r, CASE WHEN corr(size, price) >= 0 THEN 'positive' ELSE 'negative' END AS sign, round(regr_slope(price, size), 4) AS slope, round(regr_intercept(price, size), 3) AS intercept FROM part_rows GROUP BY data_id HAVING count(*) >= 3 AND count(DISTINCT size) >= 2""")
def table_correlation(spark, sf_dir):
    r = F.corr("size", "price")
    out = parts(spark, sf_dir).groupBy("data_id").agg(F.round(r, 6).alias("r"), F.when(r >= 0, "positive").otherwise("negative").alias("sign"), F.round(F.regr_slope("price", "size"), 4).alias("slope"), F.round(F.regr_intercept("price", "size"), 3).alias("intercept"), F.count("*").alias("n"), F.countDistinct("size").alias("k"))
    return out.filter("n >= 3 and k >= 2").drop("n", "k")


@query("table_extraction", W + PART + """ SELECT data_id, c AS col_name, v AS value FROM (SELECT data_id, unnest(['label','size','price']) AS c, unnest([label, size::BIGINT::VARCHAR, round(price * 100)::BIGINT::VARCHAR]) AS v FROM part_rows WHERE row_idx = 0)""")
def table_extraction(spark, sf_dir):
    first = parts(spark, sf_dir).filter("row_idx = 0").select("data_id", "label", F.col("size").cast("long").cast("string").alias("size"), F.round(F.col("price") * 100).cast("long").cast("string").alias("price"))
    return first.unpivot(["data_id"], ["label", "size", "price"], "col_name", "value")


@query("visible_rows", W + PART + """ SELECT data_id, count(*) AS n, least(count(*), 12) AS table_image, least(count(*), 14) AS text_only, least(count(*), 20) AS heatmap, count(*) <= 12 AS complete FROM part_rows GROUP BY data_id""")
def visible_rows(spark, sf_dir):
    """Rows that each picture of a table shows."""
    shown = lambda k: F.count_if(F.col("row_idx") < k)
    return parts(spark, sf_dir).groupBy("data_id").agg(F.count("*").alias("n"), shown(12).alias("table_image"), shown(14).alias("text_only"), shown(20).alias("heatmap"), (F.count("*") <= 12).alias("complete"))


@query("bar_order", W + PART + """, u AS (SELECT data_id, 'size' AS col, avg(size) AS m FROM part_rows GROUP BY ALL UNION ALL SELECT data_id, 'price', avg(price) FROM part_rows GROUP BY ALL) SELECT data_id, list(col ORDER BY m, col) AS bars FROM u GROUP BY data_id""")
def bar_order(spark, sf_dir):
    means = parts(spark, sf_dir).groupBy("data_id").agg(F.avg("size").alias("size"), F.avg("price").alias("price")).unpivot(["data_id"], ["size", "price"], "col", "m")
    return means.groupBy("data_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("m", "col"))), lambda x: x["col"]).alias("bars"))


@query("answerability", W + PART + """, n AS (SELECT data_id, count(*) AS n FROM part_rows GROUP BY ALL), c AS (SELECT data_id, v AS viz_type, CASE WHEN v = 'bar_chart' THEN CASE WHEN n <= 12 THEN 'V' ELSE 'D' END WHEN v = 'heatmap' THEN CASE WHEN n <= 20 THEN 'V' ELSE 'A' END WHEN v = 'table_image' THEN CASE WHEN n <= 12 THEN 'V' ELSE 'A' END ELSE CASE WHEN n <= 14 THEN 'V' ELSE 'A' END END AS cat FROM n, (SELECT unnest(['bar_chart','heatmap','table_image','text_only']) AS v))
SELECT viz_type, sum((cat = 'V')::INT)::BIGINT AS visible, sum((cat = 'D')::INT)::BIGINT AS derivable, sum((cat = 'A')::INT)::BIGINT AS absent, (SELECT count(*) FROM (SELECT data_id FROM c GROUP BY data_id HAVING bool_and(cat IN ('V','D')))) AS fully FROM c GROUP BY viz_type""")
def answerability(spark, sf_dir):
    """Whether a table's values are visible, derivable or absent in each picture."""
    n = parts(spark, sf_dir).groupBy("data_id").agg(F.count("*").alias("n"))
    seen = lambda k, other: F.when(F.col("n") <= k, "V").otherwise(other)
    c = n.select("data_id", seen(12, "D").alias("bar_chart"), seen(20, "A").alias("heatmap"), seen(12, "A").alias("table_image"), seen(14, "A").alias("text_only")).unpivot(["data_id"], ["bar_chart", "heatmap", "table_image", "text_only"], "viz_type", "cat")
    fully = c.groupBy("data_id").agg(F.bool_and(F.col("cat").isin("V", "D")).alias("ok")).agg(F.count_if("ok").alias("fully"))
    counts = c.groupBy("viz_type").agg(*[F.count_if(F.col("cat") == k).alias(a) for k, a in (("V", "visible"), ("D", "derivable"), ("A", "absent"))])
    return counts.crossJoin(F.broadcast(fully))  # one row


@query("graph_degrees", W + GRAPHS + """, d AS (SELECT n.data_id, node, count(v) AS degree FROM nodes n LEFT JOIN sym ON n.data_id = sym.data_id AND node = u GROUP BY ALL)
SELECT data_id, arg_max(node, (degree, -node)) AS hub, max(degree) AS top_degree, sum((degree = 1)::INT)::BIGINT AS leaves, sum((degree = 0)::INT)::BIGINT AS isolated, avg(degree) AS mean_degree, sum(degree)::DOUBLE / (count(*) * (count(*) - 1)) AS density FROM d GROUP BY data_id""")
def graph_degrees(spark, sf_dir):
    d = graph.degrees(*graphs(spark, sf_dir))
    n = F.count("*")
    return d.groupBy("data_id").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"), F.max("degree").alias("top_degree"), F.count_if(F.col("degree") == 1).alias("leaves"), F.count_if(F.col("degree") == 0).alias("isolated"), F.avg("degree").alias("mean_degree"), (F.sum("degree") / (n * (n - 1))).alias("density"))


@query("graph_top_neighbours", W + GRAPHS + """, d AS (SELECT n.data_id, node, count(v) AS degree FROM nodes n LEFT JOIN sym ON n.data_id = sym.data_id AND node = u GROUP BY ALL) SELECT data_id, node, degree, rank FROM (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY degree DESC, node)::INT AS rank FROM d) WHERE rank <= 6""")
def graph_top_neighbours(spark, sf_dir):
    d = graph.degrees(*graphs(spark, sf_dir))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("data_id").orderBy(F.desc("degree"), "node"))).filter("rank <= 6")


@query("graph_clustering", W + GRAPHS + """, d AS (SELECT n.data_id, node, count(v) AS k FROM nodes n LEFT JOIN sym ON n.data_id = sym.data_id AND node = u GROUP BY ALL), t AS (SELECT a.data_id, a.u AS node, count(*) / 2 AS tri FROM sym a JOIN sym b ON a.data_id = b.data_id AND a.v = b.u JOIN sym c ON c.data_id = a.data_id AND c.u = b.v AND c.v = a.u GROUP BY ALL)
SELECT d.data_id, round(avg(CASE WHEN k < 2 THEN 0 ELSE coalesce(tri, 0) / (k * (k - 1) / 2) END), 9) AS clustering FROM d LEFT JOIN t USING (data_id, node) GROUP BY d.data_id""")
def graph_clustering(spark, sf_dir):
    return graph.clustering(*graphs(spark, sf_dir)).groupBy("data_id").agg(F.round(F.avg("clustering"), 9).alias("clustering"))


COMPONENTS = GRAPHS + """, r(data_id, a, b) AS (SELECT data_id, node, node FROM nodes UNION SELECT r.data_id, r.a, sym.v FROM r JOIN sym ON r.data_id = sym.data_id AND r.b = sym.u), comp AS (SELECT data_id, a AS node, min(b) AS component FROM r GROUP BY ALL)"""


@query("graph_components", "WITH RECURSIVE " + COMPONENTS + """, z AS (SELECT data_id, component, count(*) AS size FROM comp GROUP BY ALL), e AS (SELECT data_id, count(*) AS m FROM edges GROUP BY ALL) SELECT data_id, count(*) AS components, max(size) AS largest, max(size) / sum(size) AS fraction, coalesce(any_value(m), 0) > sum(size) - count(*) AS cyclic FROM z LEFT JOIN e USING (data_id) GROUP BY data_id""")
def graph_components(spark, sf_dir):
    nodes, edges = graphs(spark, sf_dir)
    z = graph.labels(nodes, edges).groupBy("data_id", "component").agg(F.count("*").alias("size"))
    e = edges.groupBy("data_id").agg(F.count("*").alias("m"))
    return z.join(e, "data_id", "left").groupBy("data_id").agg(F.count("*").alias("components"), F.max("size").alias("largest"), (F.max("size") / F.sum("size")).alias("fraction"), (F.coalesce(F.first("m"), F.lit(0)) > F.sum("size") - F.count("*")).alias("cyclic"))


@query("graph_paths", "WITH RECURSIVE " + GRAPHS + """, b(data_id, node, d) AS (SELECT data_id, node, 0 FROM nodes WHERE node = 0 UNION SELECT b.data_id, sym.v, b.d + 1 FROM b JOIN sym ON b.data_id = sym.data_id AND b.node = sym.u WHERE b.d < 25) SELECT data_id, node, min(d)::BIGINT AS distance FROM b GROUP BY ALL""")
def graph_paths(spark, sf_dir):
    return graph.distances(*graphs(spark, sf_dir), source=0)


@query("graph_summaries", "WITH RECURSIVE " + GRAPHS + """, b(data_id, s, node, d) AS (SELECT data_id, node, node, 0 FROM nodes UNION SELECT b.data_id, s, sym.v, d + 1 FROM b JOIN sym ON b.data_id = sym.data_id AND b.node = sym.u WHERE d < 25),
dist AS (SELECT data_id, s, node, min(d)::BIGINT AS d FROM b GROUP BY ALL),
p(data_id, s, node, d) AS (SELECT data_id, node, node, 0::BIGINT FROM nodes UNION ALL SELECT p.data_id, p.s, sym.v, p.d + 1 FROM p JOIN sym ON p.data_id = sym.data_id AND p.node = sym.u JOIN dist ON dist.data_id = p.data_id AND dist.s = p.s AND dist.node = sym.v AND dist.d = p.d + 1),
q AS (SELECT data_id, s, node, count(*) AS paths, any_value(d) AS d FROM p GROUP BY ALL),
f AS (SELECT x.data_id, x.node, sum(x.paths * y.paths / z.paths) AS share FROM q x JOIN q y ON x.data_id = y.data_id AND x.node = y.s JOIN q z ON z.data_id = x.data_id AND z.s = x.s AND z.node = y.node AND z.d = x.d + y.d WHERE x.s <> x.node AND y.node <> x.node GROUP BY ALL),
c AS (SELECT data_id, arg_max(node, (round(coalesce(share, 0), 9), -node)) AS central FROM nodes LEFT JOIN f USING (data_id, node) GROUP BY data_id),
o AS (SELECT data_id, s, min(node) AS component, max(d) AS far, count(*) AS size FROM dist GROUP BY ALL),
k AS (SELECT data_id, component, max(far) AS far, any_value(size) AS size FROM o GROUP BY ALL),
g AS (SELECT data_id, sum(size)::BIGINT AS nodes, count(*) AS components, max(size) AS largest, arg_max(far, (size, -component)) AS diameter FROM k GROUP BY data_id),
r AS (SELECT dist.data_id, dist.node, d % 2 AS side FROM dist JOIN o ON dist.data_id = o.data_id AND dist.s = o.s AND o.component = o.s),
m AS (SELECT e.data_id, count(*) AS edges, bool_and(a.side <> b.side) AS bipartite FROM edges e JOIN r a ON a.data_id = e.data_id AND a.node = e.src JOIN r b ON b.data_id = e.data_id AND b.node = e.dst GROUP BY e.data_id)
SELECT g.data_id, nodes, coalesce(edges, 0) AS edges, components, largest, diameter, coalesce(bipartite, true) AS bipartite, coalesce(edges, 0) > nodes - components AS cyclic, central FROM g JOIN c USING (data_id) LEFT JOIN m USING (data_id)""")
def graph_summaries(spark, sf_dir):
    """Diameter, two-colouring and betweenness, all pairs level by level."""
    return graph.summaries(*graphs(spark, sf_dir))


@query("graph_communities")
def graph_communities(spark, sf_dir):
    """Groups of nodes by modularity, tested against a plain version."""
    return graph.communities(*graphs(spark, sf_dir))


@query("part_projection", """WITH m AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS m FROM lineitem) SELECT x.m AS a, y.m AS b, count(*) AS weight FROM m x JOIN m y ON x.e = y.e AND x.m < y.m GROUP BY ALL""")
def part_projection(spark, sf_dir):
    """Parts as a graph: an edge where two are in one order, weighted by the number of such orders."""
    return graph.projected(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("graph_bridges", "WITH RECURSIVE " + GRAPHS + """, e AS (SELECT data_id, src, dst FROM edges), r(data_id, s, t, a) AS (SELECT data_id, src, dst, src FROM e UNION SELECT r.data_id, r.s, r.t, sym.v FROM r JOIN sym ON r.data_id = sym.data_id AND r.a = sym.u AND NOT (sym.u = r.s AND sym.v = r.t) AND NOT (sym.u = r.t AND sym.v = r.s)), x AS (SELECT data_id, s, t, bool_or(a = t) AS still FROM r GROUP BY ALL) SELECT data_id, s AS src, t AS dst FROM x WHERE NOT still""")
def graph_bridges(spark, sf_dir):
    """Edges whose removal adds a component, from one spanning forest."""
    return graph.bridges(*graphs(spark, sf_dir))


@query("graph_adjacency", W + GRAPHS + """, m AS (SELECT a.data_id, a.node AS u, b.node AS v FROM nodes a JOIN nodes b USING (data_id)) SELECT m.data_id, m.u, list((sym.v IS NOT NULL)::INT ORDER BY m.v) AS cells FROM m LEFT JOIN sym ON m.data_id = sym.data_id AND m.u = sym.u AND m.v = sym.v GROUP BY ALL""")
def graph_adjacency(spark, sf_dir):
    """Rows of the adjacency matrix: each node's neighbour set against the graph's node list, no cell is a row."""
    nodes, edges = graphs(spark, sf_dir)
    every = nodes.groupBy("data_id").agg(F.sort_array(F.collect_list("node")).alias("every"))
    near = graph.symmetric(edges).groupBy("data_id", "u").agg(F.collect_set("v").alias("near"))
    rows = nodes.withColumnRenamed("node", "u").join(near, ["data_id", "u"], "left").join(every, "data_id")
    return rows.select("data_id", "u", F.transform("every", lambda v: F.coalesce(F.array_contains("near", v).cast("int"), F.lit(0))).alias("cells"))


@query("mixed_table_series", W + PART + ", " + SERIES + """, a AS (SELECT row_number() OVER (ORDER BY data_id) - 1 AS k, data_id, avg(size) AS mean, max(size) AS most, stddev_pop(size) AS std FROM part_rows GROUP BY data_id), b AS (SELECT data_id AS k, avg(value) AS mean, max(value) AS most, max(value) - min(value) AS span FROM ts GROUP BY data_id)
SELECT a.data_id AS left_id, b.k AS right_id, a.mean > b.mean AS table_greater, a.most > b.most AS table_peak_greater, round(a.std, 6) AS table_std, round(b.span, 6) AS series_span, CASE WHEN a.mean >= b.mean THEN 'left' ELSE 'right' END AS side FROM a JOIN b ON a.k = b.k""")
def mixed_table_series(spark, sf_dir):
    """The n-th table beside the n-th series."""
    a = parts(spark, sf_dir).groupBy("data_id").agg(F.avg("size").alias("am"), F.max("size").alias("ax"), F.stddev_pop("size").alias("sd"))
    a = a.withColumn("k", F.row_number().over(Window.orderBy("data_id")) - 1)  # one row a table: the brands
    b = series(spark, sf_dir).groupBy("data_id").agg(F.avg("value").alias("bm"), F.max("value").alias("bx"), (F.max("value") - F.min("value")).alias("span")).withColumnRenamed("data_id", "right_id")
    j = a.join(b, F.col("k") == F.col("right_id"))
    return j.select(F.col("data_id").alias("left_id"), "right_id", (F.col("am") > F.col("bm")).alias("table_greater"), (F.col("ax") > F.col("bx")).alias("table_peak_greater"), F.round("sd", 6).alias("table_std"), F.round("span", 6).alias("series_span"), F.when(F.col("am") >= F.col("bm"), "left").otherwise("right").alias("side"))


@query("mixed_graph_values", W + GRAPHS + """, p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_size AS v FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)), n AS (SELECT count(*) AS n FROM p), v AS (SELECT data_id, node, v FROM nodes, n JOIN p ON i = node % n)
SELECT e.data_id, avg(abs(a.v - b.v)) AS mean_gap, max(abs(a.v - b.v))::BIGINT AS top_gap FROM edges e JOIN v a ON a.data_id = e.data_id AND a.node = e.src JOIN v b ON b.data_id = e.data_id AND b.node = e.dst GROUP BY e.data_id""")
def mixed_graph_values(spark, sf_dir):
    """A table's values laid cyclically over a graph's nodes, and their gaps along edges."""
    nodes, edges = graphs(spark, sf_dir)
    part = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    least = part.agg(F.min("p_brand").alias("least"))
    own = part.join(F.broadcast(least), F.col("p_brand") == F.col("least"))  # one row
    own = own.select((F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i"), F.col("p_size").alias("v"), F.count("*").over(Window.partitionBy("p_brand")).alias("n"))
    values = nodes.crossJoin(F.broadcast(own.select("n").limit(1))).withColumn("i", F.pmod("node", "n").cast("int")).join(own.select("i", "v"), "i")
    at = lambda c, a: values.select("data_id", F.col("node").alias(c), F.col("v").alias(a))
    gaps = edges.join(at("src", "a"), ["data_id", "src"]).join(at("dst", "b"), ["data_id", "dst"]).withColumn("gap", F.abs(F.col("a") - F.col("b")))
    return gaps.groupBy("data_id").agg(F.avg("gap").alias("mean_gap"), F.max("gap").cast("long").alias("top_gap"))


@query("mixed_table_graph", W + PART + ", " + GRAPHS + """, k AS (SELECT data_id, count(*) AS n FROM part_rows GROUP BY data_id),
v AS (SELECT k.data_id AS table_id, nodes.data_id AS graph_id, node, size AS v FROM nodes CROSS JOIN k JOIN part_rows p ON p.data_id = k.data_id AND p.row_idx = node % n),
g AS (SELECT a.table_id, a.graph_id, avg(abs(a.v - b.v)) AS mean_gap, max(abs(a.v - b.v))::BIGINT AS top_gap FROM edges e JOIN v a ON a.graph_id = e.data_id AND a.node = e.src JOIN v b ON b.graph_id = e.data_id AND b.node = e.dst AND b.table_id = a.table_id GROUP BY ALL),
d AS (SELECT n.data_id AS graph_id, node, count(v) AS degree FROM nodes n LEFT JOIN sym ON n.data_id = sym.data_id AND node = u GROUP BY ALL)
SELECT v.table_id, v.graph_id, any_value(mean_gap) AS mean_gap, any_value(top_gap) AS top_gap, arg_max(node, (degree, -node)) AS top_degree_node, arg_max(v, (degree, -node))::BIGINT AS top_degree_value, arg_max(node, (v, -node)) AS top_value_node, sum(degree)::DOUBLE / (count(*) * (count(*) - 1)) AS density FROM v JOIN d USING (graph_id, node) LEFT JOIN g ON g.table_id = v.table_id AND g.graph_id = v.graph_id GROUP BY v.table_id, v.graph_id""")
def mixed_table_graph(spark, sf_dir):
    """Every table's values laid cyclically over every graph's nodes: gaps along edges, the top node by degree and by value, density."""
    nodes, edges = graphs(spark, sf_dir)
    rows = parts(spark, sf_dir).select(F.col("data_id").alias("table_id"), "row_idx", F.col("size").alias("v"))
    tables = rows.groupBy("table_id").agg(F.count("*").alias("n"))
    laid = graph.degrees(nodes, edges).withColumnRenamed("data_id", "graph_id").crossJoin(tables)  # 7 x 25 nodes for each table
    values = laid.withColumn("row_idx", F.pmod("node", "n")).join(rows, ["table_id", "row_idx"])
    at = lambda c, a: values.select("table_id", "graph_id", F.col("node").alias(c), F.col("v").alias(a))
    ends = edges.withColumnRenamed("data_id", "graph_id").join(at("src", "a"), ["graph_id", "src"]).join(at("dst", "b"), ["table_id", "graph_id", "dst"])
    gap = F.abs(F.col("a") - F.col("b"))
    gaps = ends.groupBy("table_id", "graph_id").agg(F.avg(gap).alias("mean_gap"), F.max(gap).cast("long").alias("top_gap"))
    n, top = F.count("*"), F.struct("degree", -F.col("node"))
    tops = values.groupBy("table_id", "graph_id").agg(F.max_by("node", top).alias("top_degree_node"), F.max_by("v", top).cast("long").alias("top_degree_value"), F.max_by("node", F.struct("v", -F.col("node"))).alias("top_value_node"), (F.sum("degree") / (n * (n - 1))).alias("density"))
    return tops.join(gaps, ["table_id", "graph_id"], "left")
