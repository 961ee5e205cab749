"""Queries of selectors by rule, calibration, other scorers; generated series, graphs and tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import statistics as st
from tessera.plans.registry import query
from tessera.plans.statistics import HASH
from tessera.sources import generators
from tessera.sources.adapters import FACTS, facts

W = "WITH "
HALF = FACTS + f""", h AS (SELECT *, {HASH.format("object_id::VARCHAR")} % 2 AS half, CASE WHEN modality = 'tabular' THEN CASE WHEN task IN ('comparison', 'aggregation') THEN 'bar_chart' ELSE 'table_image' END ELSE 'text_only' END AS rule FROM facts),
g AS (SELECT modality, viz_type, avg(exact_match) AS em FROM h WHERE half = 0 GROUP BY ALL), f AS (SELECT modality, arg_max(viz_type, (round(em, 9), viz_type)) AS fixed FROM g GROUP BY ALL), t AS (SELECT modality, task, viz_type, avg(exact_match) AS em FROM h WHERE half = 0 GROUP BY ALL), l AS (SELECT modality, task, arg_max(viz_type, (round(em, 9), viz_type)) AS learned FROM t GROUP BY ALL),
q AS (SELECT model, question_id, modality, task, any_value(rule) AS rule, avg(exact_match) AS mean FROM h WHERE half = 1 GROUP BY ALL),
v AS (SELECT q.*, coalesce(a.exact_match, mean) AS by_rule, coalesce(b.exact_match, mean) AS by_fixed, coalesce(c.exact_match, mean) AS by_learned, a.exact_match IS NULL AS missing FROM q JOIN f USING (modality) JOIN l USING (modality, task)
  LEFT JOIN h a ON a.model = q.model AND a.question_id = q.question_id AND a.viz_type = q.rule LEFT JOIN h b ON b.model = q.model AND b.question_id = q.question_id AND b.viz_type = fixed LEFT JOIN h c ON c.model = q.model AND c.question_id = q.question_id AND c.viz_type = learned)"""


@query("rule_selector", W + HALF + " SELECT model, count(*) AS n, round(avg(mean), 9) AS random, round(avg(by_fixed), 9) AS fixed, round(avg(by_rule), 9) AS rule, round(avg(by_learned), 9) AS learned, round(avg(by_learned - by_rule), 9) AS learned_minus_rule, sum(missing::INT)::BIGINT AS rule_missing FROM v GROUP BY model")
def rule_selector(spark, sf_dir):
    """On held-out objects: a random, a fixed, a rule's and a learned format; where a question lacks the format, its mean."""
    rows = facts(spark, sf_dir).withColumn("half", F.pmod(st.hashed(F.col("object_id")), F.lit(2)))
    rule = F.when(F.col("modality") == "tabular", F.when(F.col("task").isin("comparison", "aggregation"), "bar_chart").otherwise("table_image")).otherwise("text_only")
    train = rows.filter("half = 0")

    def best(by, name):
        means = train.groupBy(*by, "viz_type").agg(F.round(F.avg("exact_match"), 9).alias("em"))
        return F.broadcast(means.groupBy(*by).agg(F.max_by("viz_type", F.struct("em", "viz_type")).alias(name)))  # a row a modality and task

    found = F.map_from_entries(F.collect_list(F.struct("viz_type", "exact_match"))).alias("all")
    q = rows.filter("half = 1").withColumn("rule", rule).groupBy("model", "question_id", "modality", "task", "rule").agg(found, F.avg("exact_match").alias("mean"))
    q = q.join(best(["modality"], "fixed"), "modality").join(best(["modality", "task"], "learned"), ["modality", "task"])
    at = lambda c: F.coalesce(F.try_element_at("all", F.col(c)), F.col("mean"))
    mean = lambda x: F.round(F.avg(x), 9)
    return q.groupBy("model").agg(F.count("*").alias("n"), mean("mean").alias("random"), mean(at("fixed")).alias("fixed"), mean(at("rule")).alias("rule"), mean(at("learned")).alias("learned"), mean(at("learned") - at("rule")).alias("learned_minus_rule"), F.count_if(F.try_element_at("all", F.col("rule")).isNull()).alias("rule_missing"))


LEVEL = "CASE {} WHEN '1-hop' THEN 1 WHEN '2-hop' THEN 2 WHEN '3-hop' THEN 3 ELSE 4 END"


@query("calibration_report", W + FACTS + f""", q AS (SELECT question_id, {LEVEL.format('any_value(difficulty)')} AS assigned, round(avg(exact_match), 9) AS p FROM facts GROUP BY question_id), e AS (SELECT *, CASE WHEN p >= 0.75 THEN 1 WHEN p >= 0.5 THEN 2 WHEN p >= 0.25 THEN 3 ELSE 4 END AS empirical FROM q)
SELECT assigned, count(*) AS n, round(avg(p), 9) AS mean, round(avg((assigned = empirical)::INT), 9) AS alignment, round(avg(-ln(greatest(0.01, least(0.99, p)) / (1 - greatest(0.01, least(0.99, p))))), 9) AS logit, sum((empirical > assigned)::INT)::BIGINT AS harder, sum((empirical < assigned)::INT)::BIGINT AS easier FROM e GROUP BY assigned""")
def calibration_report(spark, sf_dir):
    """Assigned against empirical difficulty: alignment, the one-parameter logit, and how many are harder or easier than they say."""
    level = F.when(F.col("difficulty") == "1-hop", 1).when(F.col("difficulty") == "2-hop", 2).when(F.col("difficulty") == "3-hop", 3).otherwise(4)
    q = facts(spark, sf_dir).groupBy("question_id").agg(F.any_value(level).alias("assigned"), F.round(F.avg("exact_match"), 9).alias("p"))
    p = F.col("p")
    e = q.withColumn("empirical", F.when(p >= 0.75, 1).when(p >= 0.5, 2).when(p >= 0.25, 3).otherwise(4))
    held = F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))
    return e.groupBy("assigned").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean"), F.round(F.avg((F.col("assigned") == F.col("empirical")).cast("int")), 9).alias("alignment"), F.round(F.avg(-F.ln(held / (1 - held))), 9).alias("logit"), F.count_if(F.col("empirical") > F.col("assigned")).alias("harder"), F.count_if(F.col("empirical") < F.col("assigned")).alias("easier"))


SCORERS = FACTS + ", s AS (SELECT *, (prediction = answer)::INT AS strict, (abs(TRY_CAST(prediction AS DOUBLE) - TRY_CAST(answer AS DOUBLE)) <= greatest(1.0, 0.05 * abs(TRY_CAST(answer AS DOUBLE))))::INT AS tolerant, (contains(prediction, answer))::INT AS lenient FROM facts)"


@query("scorers", W + SCORERS + " SELECT model, modality, round(avg(strict), 9) AS strict, round(avg(coalesce(tolerant, 0)), 9) AS tolerant, round(avg(lenient), 9) AS lenient, sum((lenient = 1 AND strict = 0)::INT)::BIGINT AS credited, sum((coalesce(tolerant, 0) = 1 AND strict = 0)::INT)::BIGINT AS near, count(*) AS n FROM s GROUP BY ALL")
def scorers(spark, sf_dir):
    """Three scorers of the same predictions, and what the two others credit beyond the strict one."""
    rows = facts(spark, sf_dir)
    number = lambda c: F.try_to_number(F.when(F.col(c).rlike(r"^[0-9]+$"), F.col(c)), F.lit("9999999999")).cast("double")
    a = number("answer")
    strict = (F.col("prediction") == F.col("answer")).cast("int")
    near = F.coalesce((F.abs(number("prediction") - a) <= F.greatest(F.lit(1.0), 0.05 * F.abs(a))).cast("int"), F.lit(0))
    lenient = F.contains(F.col("prediction"), F.col("answer")).cast("int")
    s = rows.select("model", "modality", strict.alias("strict"), near.alias("near"), lenient.alias("lenient"))
    mean = lambda c: F.round(F.avg(c), 9)
    return s.groupBy("model", "modality").agg(mean("strict").alias("strict"), mean("near").alias("tolerant"), mean("lenient").alias("lenient"), F.count_if((F.col("lenient") == 1) & (F.col("strict") == 0)).alias("credited"), F.count_if((F.col("near") == 1) & (F.col("strict") == 0)).alias("near"), F.count("*").alias("n"))


FILTERED = FACTS + """, x AS (SELECT *, length(question) > 32 AS cut FROM facts), g AS (SELECT model, modality, viz_type, avg(exact_match) AS a, avg(CASE WHEN NOT cut THEN exact_match END) AS b FROM x GROUP BY ALL)"""


@query("filtered_gaps", W + FILTERED + " SELECT model, modality, round(max(a) - min(a), 9) AS gap, round(max(b) - min(b), 9) AS gap_filtered, round((max(a) - min(a)) - (max(b) - min(b)), 9) AS change FROM g GROUP BY ALL")
def filtered_gaps(spark, sf_dir):
    """Gaps between formats over all questions, and without those that a view would cut."""
    rows = facts(spark, sf_dir)
    whole = F.when(F.length("question") <= 32, F.col("exact_match"))
    g = rows.groupBy("model", "modality", "viz_type").agg(F.avg("exact_match").alias("a"), F.avg(whole).alias("b"))
    gap = lambda c: F.max(c) - F.min(c)
    return g.groupBy("model", "modality").agg(F.round(gap("a"), 9).alias("gap"), F.round(gap("b"), 9).alias("gap_filtered"), F.round(gap("a") - gap("b"), 9).alias("change"))


U = HASH.format("{}") + " / 4294967296.0::DOUBLE"


@query("generated_series", f"""WITH n AS (SELECT i AS data_id, 50 + {HASH.format("'42:n:' || i")} % 151 AS n, (['linear_trend','seasonal','trend_seasonal','random_walk','step_function','spike_anomaly','gradual_drift','multimodal'])[i % 8 + 1] AS pattern FROM range(16) r(i)),
p AS (SELECT data_id, pattern, n, unnest(range(n)) AS t FROM n), u AS (SELECT *, {U.format("'42:' || data_id || ':' || t")} - 0.5 AS e FROM p),
v AS (SELECT *, CASE pattern WHEN 'linear_trend' THEN 10 + 0.5 * t + e WHEN 'seasonal' THEN 10 * sin(2 * pi() * t / 12) + e WHEN 'trend_seasonal' THEN 0.3 * t + 10 * sin(2 * pi() * t / 12) + e WHEN 'random_walk' THEN sum(e) OVER (PARTITION BY data_id ORDER BY t) WHEN 'step_function' THEN CASE WHEN t < n // 3 THEN 5 WHEN t < 2 * n // 3 THEN 15 ELSE 8 END + e WHEN 'spike_anomaly' THEN e + CASE WHEN t IN (n // 4, n // 2, 3 * n // 4) THEN 20 ELSE 0 END WHEN 'gradual_drift' THEN 0.01 * t * t / 10 + e ELSE CASE WHEN e < 0 THEN 5 ELSE 15 END + e END AS x FROM u) SELECT data_id, pattern, t, round(x, 3) AS value FROM v""")
def generated_series(spark, sf_dir):
    """Sixteen series of eight patterns from seeded hashes."""
    return generators.series(spark, 16, 42)


@query("generated_graphs", f"""WITH g AS (SELECT i AS data_id, 12 + i % 5 AS n, (['star','grid','tree','ring','random','bipartite','community'])[i % 7 + 1] AS kind FROM range(21) r(i)), p AS (SELECT data_id, n, kind, a AS src, b AS dst, {U.format("'42:' || data_id || ':' || a || ':' || b")} AS u FROM g, range(16) x(a), range(16) y(b) WHERE a < b AND b < n)
SELECT data_id, kind, src, dst FROM p WHERE CASE kind WHEN 'star' THEN src = 0 WHEN 'grid' THEN dst = src + 4 OR dst = src + 1 AND dst % 4 <> 0 WHEN 'tree' THEN src = (dst - 1) // 2 WHEN 'ring' THEN dst = src + 1 OR src = 0 AND dst = n - 1 WHEN 'random' THEN u < 0.25 WHEN 'bipartite' THEN src < n // 2 AND dst >= n // 2 AND u < 0.4 ELSE CASE WHEN (src < n // 2) = (dst < n // 2) THEN u < 0.6 ELSE u < 0.05 END END""")
def generated_graphs(spark, sf_dir):
    """Twenty-one graphs of seven kinds from seeded hashes."""
    return generators.graphs(spark, 21, 42)


@query("generated_tables", f"""WITH d AS (SELECT i AS data_id, 16 + {HASH.format("'42:t:' || i")} % 20 AS n FROM range(20) r(i)), p AS (SELECT data_id, unnest(range(n)) AS row_idx FROM d) SELECT data_id, row_idx, 'item ' || chr((65 + row_idx % 26)::INT) AS label, round(100 * {U.format("'42:a:' || data_id || ':' || row_idx")}, 2) AS amount, {HASH.format("'42:b:' || data_id || ':' || row_idx")} % 50 AS units, round(20 + 60 * {U.format("'42:c:' || data_id || ':' || row_idx")}, 1) AS rate FROM p""")
def generated_tables(spark, sf_dir):
    """Twenty tables of 16 to 35 rows from seeded hashes."""
    return generators.tables(spark, 20, 42)
