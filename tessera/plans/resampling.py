"""Queries of bootstrap intervals, paired tests and contrasts of resampled evaluations.

Items are the questions (``question_id``), each with a weight of its own in every replicate.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import resampling as rs
from tessera.operators import statistics as st
from tessera.plans.registry import query
from tessera.plans.statistics import DIFFS, HASH, RATERS, differences, raters
from tessera.sources.adapters import FACTS, facts

W = "WITH "
B = rs.DRAWS
ITEMS = FACTS + """, items AS (SELECT model, question_id, max(exact_match) - min(exact_match) AS gap, (max(exact_match) > min(exact_match))::INT AS flip FROM facts GROUP BY ALL)"""
INTERVAL = "list_sort(list(v))[floor(round(0.025 * count(v), 9))::INT + 1] AS low, list_sort(list(v))[least(count(v), floor(round(0.975 * count(v), 9)) + 1)::INT] AS high"
P = "least(1.0, 2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT)))"


def paired_sql(items: str, group: str) -> str:
    return rs.replicated_sql(items, group, "question_id", "diff") + f""", i AS (SELECT {group}, {INTERVAL}, {P} AS p FROM v GROUP BY ALL), x AS (SELECT {group}, count(*) AS n, round(avg(diff), 9) AS diff, CASE WHEN round(stddev_pop(diff), 12) <> 0 THEN round(avg(diff) / round(stddev_pop(diff), 12), 9) END AS d FROM {items} GROUP BY ALL)"""


def gaps(spark, sf_dir):
    best, worst = F.max("exact_match"), F.min("exact_match")
    return facts(spark, sf_dir).groupBy("model", "question_id").agg((best - worst).alias("gap"), (best > worst).cast("int").alias("flip"))


@query("gap_bootstrap", W + ITEMS + rs.replicated_sql("items", "model", "question_id", "gap") + f", k AS (SELECT model, round(avg(gap), 9) AS mean_gap FROM items GROUP BY ALL) SELECT model, {INTERVAL}, any_value(mean_gap) AS mean_gap FROM v JOIN k USING (model) GROUP BY model")
def gap_bootstrap(spark, sf_dir):
    """The mean gap between a question's best and worst format, with the interval of order statistics."""
    items = gaps(spark, sf_dir)
    stats = rs.replicated(items, ["model"], "question_id", "gap", B)
    return rs.ordered_interval(stats, ["model"]).join(items.groupBy("model").agg(F.round(F.avg("gap"), 9).alias("mean_gap")), "model")


@query("sensitivity_interval", W + ITEMS + rs.replicated_sql("items", "model", "question_id", "gap") + f", s AS (SELECT model, avg(flip) AS flip_rate, 1 - avg(flip) AS consistency, list_sort(list(round(gap, 9)))[(count(*) // 2 + 1)::INT] AS median_gap FROM items GROUP BY ALL) SELECT s.*, low, high FROM s JOIN (SELECT model, {INTERVAL} FROM v GROUP BY model) USING (model)")
def sensitivity_interval(spark, sf_dir):
    """Flip rate, consistency, the upper median of the gaps (from counts of their few values) and the mean gap's interval."""
    items = gaps(spark, sf_dir)
    own = items.groupBy("model").agg(F.avg("flip").alias("flip_rate"), (1 - F.avg("flip")).alias("consistency"))
    values = items.groupBy("model", F.round("gap", 9).alias("gap")).agg(F.count("*").alias("k"))
    sofar, all_ = F.sum("k").over(Window.partitionBy("model").orderBy("gap")), F.sum("k").over(Window.partitionBy("model"))
    medians = values.select("model", "gap", (sofar > F.floor(all_ / 2)).alias("behind")).filter("behind").groupBy("model").agg(F.min("gap").alias("median_gap"))
    return own.join(medians, "model").join(rs.ordered_interval(rs.replicated(items, ["model"], "question_id", "gap", B), ["model"]), "model")


PAIRS = FACTS + ", items AS (SELECT modality, question_id, avg(CASE WHEN model = 'A' THEN exact_match END) - avg(CASE WHEN model = 'R' THEN exact_match END) AS diff FROM facts WHERE model IN ('A', 'R') GROUP BY ALL HAVING diff IS NOT NULL)"


def model_pairs(spark, sf_dir, *group: str):
    em = lambda m: F.avg(F.when(F.col("model") == m, F.col("exact_match")))
    return facts(spark, sf_dir).filter(F.col("model").isin("A", "R")).groupBy(*group, "question_id").agg((em("A") - em("R")).alias("diff")).filter("diff is not null")


@query("paired_bootstrap", W + PAIRS + paired_sql("items", "modality") + " SELECT x.*, low, high, p FROM x JOIN i USING (modality)")
def paired_bootstrap(spark, sf_dir):
    """Two models' difference by question: interval, two-sided p and effect size."""
    return rs.paired(model_pairs(spark, sf_dir, "modality"), ["modality"], "question_id", "diff", B)


BEST = FACTS + """, g AS (SELECT modality, viz_type, avg(exact_match) AS em FROM facts WHERE viz_type <> 'text_only' GROUP BY ALL), e AS (SELECT modality, arg_max(viz_type, (em, viz_type)) AS best, arg_min(viz_type, (em, viz_type)) AS worst FROM g GROUP BY ALL),
items AS (SELECT modality, question_id, avg(CASE WHEN viz_type = best THEN exact_match END) - avg(CASE WHEN viz_type = worst THEN exact_match END) AS diff FROM facts JOIN e USING (modality) GROUP BY ALL HAVING diff IS NOT NULL)"""


@query("best_worst_bootstrap", W + BEST + paired_sql("items", "modality") + " SELECT x.*, low, high, p, best, worst FROM x JOIN i USING (modality) JOIN e USING (modality)")
def best_worst_bootstrap(spark, sf_dir):
    """Each modality's best against its worst format, the text format left out."""
    rows = facts(spark, sf_dir)
    g = rows.filter("viz_type <> 'text_only'").groupBy("modality", "viz_type").agg(F.avg("exact_match").alias("em"))
    order = F.struct("em", "viz_type")
    ends = g.groupBy("modality").agg(F.max_by("viz_type", order).alias("best"), F.min_by("viz_type", order).alias("worst"))
    em = lambda c: F.avg(F.when(F.col("viz_type") == F.col(c), F.col("exact_match")))
    items = rows.join(F.broadcast(ends), "modality").groupBy("modality", "question_id").agg((em("best") - em("worst")).alias("diff")).filter("diff is not null")
    return rs.paired(items, ["modality"], "question_id", "diff", B).join(ends, "modality")


@query("prediction_sets", W + PAIRS.replace("SELECT modality, question_id", "SELECT 'all' AS g, question_id") + rs.replicated_sql("items", "g", "question_id", "diff") + f" SELECT round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, {P} AS p, (SELECT round(avg(diff), 9) FROM items) AS diff FROM v")
def prediction_sets(spark, sf_dir):
    """Two sets of predictions, overall, with an interval of interpolated percentiles."""
    items = model_pairs(spark, sf_dir).withColumn("g", F.lit("all"))
    stats = rs.replicated(items, ["g"], "question_id", "diff", B)
    bounds = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    interval = stats.groupBy("g").agg(F.round(bounds[0], 9).alias("low"), F.round(bounds[1], 9).alias("high"))
    return interval.join(rs.two_sided(stats, ["g"]), "g").join(items.groupBy("g").agg(F.round(F.avg("diff"), 9).alias("diff")), "g").drop("g")


CELLS = FACTS + """, cells AS (SELECT question_id, m.name, m.value, sum(exact_match) AS s, count(*) AS n FROM facts, LATERAL (SELECT unnest([{'name': 'overall', 'value': 'all'}, {'name': 'modality', 'value': modality}, {'name': 'difficulty', 'value': difficulty}, {'name': 'format', 'value': viz_type}]) AS m) GROUP BY ALL)"""


@query("simultaneous_bootstrap", W + CELLS + rs.replicated_sql("cells", "name, value", "question_id", "s", "n") + f""", z AS (SELECT 'gap' AS name, 'format' AS value, b, round(max(v) - min(v), 9) AS v FROM v WHERE name = 'format' GROUP BY b UNION ALL SELECT name, value, b, v FROM v) SELECT name, value, {INTERVAL} FROM z GROUP BY ALL""")
def simultaneous_bootstrap(spark, sf_dir):
    """Overall, by modality, difficulty and format, and the gap between formats, all from the same weights of questions."""
    rows = facts(spark, sf_dir)
    names = {"overall": F.lit("all"), "modality": F.col("modality"), "difficulty": F.col("difficulty"), "format": F.col("viz_type")}
    cells = rows.select("question_id", "exact_match", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in names.items()])).alias("m"))
    cells = cells.groupBy("question_id", "m.name", "m.value").agg(F.sum("exact_match").alias("s"), F.count("*").alias("n"))
    stats = rs.replicated(cells, ["name", "value"], "question_id", "s", B, "n")
    gap = stats.filter("name = 'format'").groupBy("rep").agg(F.lit("gap").alias("name"), F.lit("format").alias("value"), F.round(F.max("v") - F.min("v"), 9).alias("v"))
    return rs.ordered_interval(stats.unionByName(gap), ["name", "value"])


@query("question_bootstrap", W + FACTS + ", items AS (SELECT model, question_id, avg(exact_match) AS m FROM facts GROUP BY ALL)" + rs.replicated_sql("items", "model", "question_id", "m") + f", k AS (SELECT model, round(avg(m), 9) AS mean FROM items GROUP BY ALL) SELECT model, {INTERVAL}, any_value(mean) AS mean FROM v JOIN k USING (model) GROUP BY model")
def question_bootstrap(spark, sf_dir):
    """The mean of questions' means, questions weighted as clusters."""
    items = facts(spark, sf_dir).groupBy("model", "question_id").agg(F.avg("exact_match").alias("m"))
    stats = rs.replicated(items, ["model"], "question_id", "m", B)
    return rs.ordered_interval(stats, ["model"]).join(items.groupBy("model").agg(F.round(F.avg("m"), 9).alias("mean")), "model")


@query("paired_sign_flip", W + PAIRS + rs.signed_sql("items", "modality", "question_id", "diff") + " SELECT * FROM sign_p")
def paired_sign_flip(spark, sf_dir):
    """Random signs of the questions' paired differences."""
    return rs.sign_test(model_pairs(spark, sf_dir, "modality"), ["modality"], "question_id", "diff", B)


@query("bonferroni", W + DIFFS + ", z AS (SELECT modality, round(exp(-abs(sum(diff)) / sqrt(count(*))), 9) AS p FROM d GROUP BY ALL) SELECT modality, p, round(least(1.0, p * count(*) OVER ()), 9) AS adjusted, least(1.0, p * count(*) OVER ()) < 0.05 AS reject FROM z")
def bonferroni(spark, sf_dir):
    z = differences(spark, sf_dir).groupBy("modality").agg(F.round(F.exp(-F.abs(F.sum("diff")) / F.sqrt(F.count("*"))), 9).alias("p"))
    scaled = F.least(F.lit(1.0), F.col("p") * F.count("*").over(Window.partitionBy()))  # a row a modality
    return z.select("modality", "p", F.round(scaled, 9).alias("adjusted"), (scaled < 0.05).alias("reject"))


BINARY = RATERS + ", u AS (SELECT doc_id, lang, unnest(CASE WHEN doc_id % 3 = 0 THEN [quality, toxic] ELSE [quality, toxic, long] END) AS v FROM r), i AS (SELECT doc_id, any_value(lang) AS lang, count(*) AS k, sum(v) AS y FROM u GROUP BY ALL HAVING count(*) >= 2)"


def judged(spark, sf_dir):
    """Two or three ratings a document."""
    rows = raters(spark, sf_dir)
    given = F.when(F.col("doc_id") % 3 == 0, F.array("quality", "toxic")).otherwise(F.array("quality", "toxic", "long"))
    return rows.select("doc_id", "lang", F.explode(given).alias("v")).groupBy("doc_id").agg(F.first("lang").alias("lang"), F.count("*").alias("k"), F.sum("v").alias("y")).filter("k >= 2")


@query("fleiss_binary", W + BINARY + ", s AS (SELECT lang, count(*) AS items, avg((y * (y - 1) + (k - y) * (k - y - 1)) / (k * (k - 1))) AS po, sum(y) / sum(k) AS q FROM i GROUP BY ALL) SELECT lang, items, CASE WHEN q * q + (1 - q) * (1 - q) >= 1 THEN 1.0 ELSE round((po - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 9) END AS kappa FROM s")
def fleiss_binary(spark, sf_dir):
    """Binary ratings of two raters or more, as many as each item has."""
    y, k = F.col("y"), F.col("k")
    s = judged(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("items"), F.avg((y * (y - 1) + (k - y) * (k - y - 1)) / (k * (k - 1))).alias("po"), (F.sum("y") / F.sum("k")).alias("q"))
    pe = F.col("q") * F.col("q") + (1 - F.col("q")) * (1 - F.col("q"))
    return s.select("lang", "items", F.when(pe >= 1, 1.0).otherwise(F.round((F.col("po") - pe) / (1 - pe), 9)).alias("kappa"))


@query("agreement_dispatch", W + BINARY + """, m AS (SELECT lang, max(k) AS raters FROM i GROUP BY ALL), f AS (SELECT lang, avg((y * (y - 1) + (k - y) * (k - y - 1)) / (k * (k - 1))) AS po, sum(y) / sum(k) AS q FROM i GROUP BY ALL), c AS (SELECT lang, avg((quality = toxic)::INT) AS po, avg(quality) AS a, avg(toxic) AS b FROM r GROUP BY ALL)
SELECT lang, raters, CASE WHEN raters = 2 THEN 'cohen' ELSE 'fleiss' END AS method, round(CASE WHEN raters = 2 THEN (c.po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))) ELSE (f.po - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))) END, 9) AS kappa FROM m JOIN f USING (lang) JOIN c USING (lang)""")
def agreement_dispatch(spark, sf_dir):
    """Cohen's kappa where a group has two raters, Fleiss' where it has more."""
    many = judged(spark, sf_dir).groupBy("lang").agg(F.max("k").alias("raters"))
    fleiss = fleiss_binary(spark, sf_dir).select("lang", F.col("kappa").alias("fleiss"))
    cohen = st.cohen_kappa(raters(spark, sf_dir), ["lang"], "quality", "toxic").select("lang", F.col("kappa").alias("cohen"))
    two = F.col("raters") == 2
    return many.join(fleiss, "lang").join(cohen, "lang").select("lang", "raters", F.when(two, "cohen").otherwise("fleiss").alias("method"), F.round(F.when(two, F.col("cohen")).otherwise(F.col("fleiss")), 9).alias("kappa"))


@query("split_half", W + FACTS + f""", h AS (SELECT *, {HASH.format("question")} % 2 AS half FROM facts), g AS (SELECT modality, viz_type, avg(exact_match) AS em FROM h WHERE half = 0 GROUP BY ALL), e AS (SELECT modality, arg_max(viz_type, (em, viz_type)) AS best, arg_min(viz_type, (em, viz_type)) AS worst, max(em) - min(em) AS chosen FROM g GROUP BY ALL)
SELECT modality, any_value(best) AS best, any_value(worst) AS worst, any_value(round(chosen, 9)) AS selection_gap, round(avg(CASE WHEN viz_type = best THEN exact_match END) - avg(CASE WHEN viz_type = worst THEN exact_match END), 9) AS test_gap FROM h JOIN e USING (modality) WHERE half = 1 GROUP BY modality""")
def split_half(spark, sf_dir):
    """Formats chosen on one half of the questions, their gap on the other."""
    rows = facts(spark, sf_dir).withColumn("half", F.pmod(st.hashed(F.col("question")), F.lit(2)))
    g = rows.filter("half = 0").groupBy("modality", "viz_type").agg(F.avg("exact_match").alias("em"))
    order = F.struct("em", "viz_type")
    ends = g.groupBy("modality").agg(F.max_by("viz_type", order).alias("best"), F.min_by("viz_type", order).alias("worst"), F.round(F.max("em") - F.min("em"), 9).alias("selection_gap"))
    em = lambda c: F.avg(F.when(F.col("viz_type") == F.col(c), F.col("exact_match")))
    return rows.filter("half = 1").join(F.broadcast(ends), "modality").groupBy("modality", "best", "worst", "selection_gap").agg(F.round(em("best") - em("worst"), 9).alias("test_gap"))


@query("visual_contrasts", W + FACTS + """ SELECT model, modality, round(avg(CASE WHEN viz_type <> 'text_only' THEN exact_match END) - avg(CASE WHEN viz_type = 'text_only' THEN exact_match END), 9) AS visual_minus_text, round(avg(CASE WHEN viz_type NOT IN ('text_only', 'node_link') THEN exact_match END) - avg(CASE WHEN viz_type = 'text_only' AND task <> 'connectivity' THEN exact_match END), 9) AS without_degree FROM facts GROUP BY ALL""")
def visual_contrasts(spark, sf_dir):
    """Pictures against text, and the same without what degrees give away."""
    em = lambda c: F.avg(F.when(c, F.col("exact_match")))
    viz = F.col("viz_type")
    return facts(spark, sf_dir).groupBy("model", "modality").agg(
        F.round(em(viz != "text_only") - em(viz == "text_only"), 9).alias("visual_minus_text"),
        F.round(em(~viz.isin("text_only", "node_link")) - em((viz == "text_only") & (F.col("task") != "connectivity")), 9).alias("without_degree"),
    )


STYLES = FACTS + ", styles AS (SELECT model, question, task, avg(exact_match) AS em FROM facts GROUP BY ALL), whole AS (SELECT *, count(*) OVER (PARTITION BY model, question) AS k FROM styles), s AS (SELECT model, task, avg(em) AS em FROM whole WHERE k = 5 GROUP BY ALL)"


@query("style_contrast", W + STYLES + " SELECT model, round(max(CASE WHEN task = 'trend_analysis' THEN em END) - max(CASE WHEN task <> 'trend_analysis' THEN em END), 9) AS contrast, arg_max(task, (round(em, 9), task)) FILTER (WHERE task <> 'trend_analysis') AS best_other FROM s GROUP BY model")
def style_contrast(spark, sf_dir):
    """One prompt style against the best of the others, on questions that all styles have."""
    em = facts(spark, sf_dir).groupBy("model", "question", "task").agg(F.avg("exact_match").alias("em"))
    common = em.withColumn("k", F.count("*").over(Window.partitionBy("model", "question"))).filter("k = 5").groupBy("model", "task").agg(F.avg("em").alias("em"))
    own = F.col("task") == "trend_analysis"
    other = F.when(~own, F.struct(F.round("em", 9).alias("em"), F.col("task")))
    return common.groupBy("model").agg(F.round(F.max(F.when(own, F.col("em"))) - F.max(F.when(~own, F.col("em"))), 9).alias("contrast"), F.max(other)["task"].alias("best_other"))


ADAPTED = FACTS + """, s AS (SELECT model, question_id, max(exact_match) - min(exact_match) AS gap, stddev_pop(exact_match) AS std FROM facts WHERE model IN ('A', 'R') GROUP BY ALL),
items AS (SELECT question_id, max(CASE WHEN model = 'A' THEN gap END) - max(CASE WHEN model = 'R' THEN gap END) AS gap, max(CASE WHEN model = 'A' THEN std END) - max(CASE WHEN model = 'R' THEN std END) AS std FROM s GROUP BY ALL HAVING gap IS NOT NULL),
measures AS (SELECT 'gap' AS measure, question_id, gap AS x FROM items UNION ALL SELECT 'std', question_id, std FROM items)"""


@query("adapted_bootstrap", W + ADAPTED + rs.replicated_sql("measures", "measure", "question_id", "x") + " SELECT measure, " + INTERVAL + ", avg((v >= 0)::INT) AS p FROM v GROUP BY ALL")
def adapted_bootstrap(spark, sf_dir):
    """Changes of gap and spread between a base and an adapted model, with one-sided p, from the same weights."""
    em = facts(spark, sf_dir).filter(F.col("model").isin("A", "R"))
    s = em.groupBy("model", "question_id").agg((F.max("exact_match") - F.min("exact_match")).alias("gap"), F.stddev_pop("exact_match").alias("std"))
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    items = s.groupBy("question_id").agg(*[(of("A", c) - of("R", c)).alias(c) for c in ("gap", "std")]).filter("gap is not null")
    measures = items.unpivot(["question_id"], ["gap", "std"], "measure", "x")
    stats = rs.replicated(measures, ["measure"], "question_id", "x", B)
    return rs.ordered_interval(stats, ["measure"]).join(stats.groupBy("measure").agg(F.avg((F.col("v") >= 0).cast("int")).alias("p")), "measure")


#: Names of checks, what they measure, and what is expected within a tolerance; no expectation skips the check.
CHECKS = {"rows": ("count(*)::DOUBLE", 1000.0, 1e9), "accuracy": ("avg(exact_match)", 0.5, 0.05), "errors": ("avg((prediction = '[ERROR]')::INT)", 0.5, 0.01), "models": ("count(DISTINCT model)::DOUBLE", 3.0, 0.0), "latency": ("avg(latency)::DOUBLE", None, 1.0)}


@query("checks", W + FACTS + ", m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, {sql} AS value, {'NULL' if want is None else want}::DOUBLE AS expected, {tol}::DOUBLE AS tolerance FROM facts" for k, (sql, want, tol) in CHECKS.items()) + ") SELECT name, round(value, 6) AS value, expected, CASE WHEN expected IS NULL THEN 'SKIP' WHEN abs(value - expected) <= tolerance THEN 'PASS' ELSE 'FAIL' END AS status FROM m")
def checks(spark, sf_dir):
    """Stated numbers against recomputed ones."""
    value = {"rows": F.count("*").cast("double"), "accuracy": F.avg("exact_match"), "errors": F.avg((F.col("prediction") == "[ERROR]").cast("int")), "models": F.count_distinct("model").cast("double"), "latency": F.avg("latency").cast("double")}
    one = facts(spark, sf_dir).agg(*[v.alias(k) for k, v in value.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value"), F.lit(want).cast("double").alias("expected"), F.lit(tol).alias("tolerance")) for k, (_, want, tol) in CHECKS.items()])).alias("c")).select("c.*")
    near = F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance")
    return rows.select("name", F.round("value", 6).alias("value"), "expected", F.when(F.col("expected").isNull(), "SKIP").when(near, "PASS").otherwise("FAIL").alias("status"))
