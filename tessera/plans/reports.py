"""Queries of reports, joins with fallbacks, samples by quota, formats of values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import formats
from tessera.operators import sampling
from tessera.operators import statistics as st
from tessera.plans.registry import query
from tessera.plans.solvers import PART, parts
from tessera.plans.statistics import HASH, RATERS, raters
from tessera.sources.adapters import FACTS, GRAPHS, ROWS, SERIES, evaluation_rows, facts, graphs, read, series

W = "WITH "
QUESTIONS = ROWS + ", q AS (SELECT question_id, any_value(modality) AS modality, any_value(difficulty) AS difficulty, any_value(source) AS source, any_value(object_id) AS object_id FROM aer GROUP BY question_id)"


def questions(spark, sf_dir):
    first = [F.any_value(c).alias(c) for c in ("modality", "difficulty", "source", "object_id")]
    return evaluation_rows(spark, sf_dir).groupBy("question_id").agg(*first)


@query("binary_open_split", W + FACTS + " SELECT model, avg(CASE WHEN answer IN ('0', '1') THEN exact_match END) AS binary_em, avg(CASE WHEN answer NOT IN ('0', '1') THEN exact_match END) AS open_em, sum((answer IN ('0', '1'))::INT)::BIGINT AS n_binary FROM facts GROUP BY model")
def binary_open_split(spark, sf_dir):
    """Answers of two values against open ones."""
    binary = F.col("answer").isin("0", "1")
    return facts(spark, sf_dir).groupBy("model").agg(F.avg(F.when(binary, F.col("exact_match"))).alias("binary_em"), F.avg(F.when(~binary, F.col("exact_match"))).alias("open_em"), F.count_if(binary).alias("n_binary"))


MODALITIES = ("tabular", "timeseries", "graph")


@query("prompt_summary", W + FACTS + " SELECT model, task AS style, avg(exact_match) AS overall, " + ", ".join(f"avg(CASE WHEN modality = '{m}' THEN exact_match END) AS {m}" for m in MODALITIES) + ", count(*) AS n FROM facts GROUP BY ALL")
def prompt_summary(spark, sf_dir):
    """Prompt styles, for which tasks stand, by model and modality."""
    by = [F.avg(F.when(F.col("modality") == m, F.col("exact_match"))).alias(m) for m in MODALITIES]
    return facts(spark, sf_dir).groupBy("model", F.col("task").alias("style")).agg(F.avg("exact_match").alias("overall"), *by, F.count("*").alias("n"))


@query("mixed_summary", W + FACTS + """, m AS (SELECT *, modality || '+' || (CASE WHEN question LIKE '%1%' THEN 'graph' ELSE 'series' END) AS combo FROM facts WHERE source = 'ett'), s AS (SELECT model, avg(exact_match) AS single FROM facts WHERE source <> 'ett' GROUP BY ALL)
SELECT model, kind, value, round(avg(exact_match), 9) AS em, count(*) AS n, round(avg(exact_match) - any_value(single), 9) AS delta FROM m JOIN s USING (model), LATERAL (SELECT unnest([{'kind': 'overall', 'value': 'all'}, {'kind': 'combo', 'value': combo}, {'kind': 'difficulty', 'value': difficulty}], recursive := true)) GROUP BY ALL""")
def mixed_summary(spark, sf_dir):
    """Mixed items, for which one source stands, overall, by combination and difficulty, and their distance from single items."""
    rows = facts(spark, sf_dir)
    combo = F.concat(F.col("modality"), F.lit("+"), F.when(F.col("question").contains("1"), "graph").otherwise("series"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("overall", F.lit("all")), ("combo", combo), ("difficulty", F.col("difficulty")))])
    mixed = rows.filter("source = 'ett'").select("model", "exact_match", F.explode(kinds).alias("k")).groupBy("model", "k.kind", "k.value").agg(F.avg("exact_match").alias("em"), F.count("*").alias("n"))
    single = rows.filter("source <> 'ett'").groupBy("model").agg(F.avg("exact_match").alias("single"))
    return mixed.join(single, "model").select("model", "kind", "value", F.round("em", 9).alias("em"), "n", F.round(F.col("em") - F.col("single"), 9).alias("delta"))


@query("baseline_mixed", W + FACTS + " SELECT model, a.em AS baseline, b.em AS mixed, round(b.em - a.em, 9) AS delta FROM (SELECT model, avg(exact_match) AS em FROM facts WHERE source <> 'ett' GROUP BY ALL) a JOIN (SELECT model, avg(exact_match) AS em FROM facts WHERE source = 'ett' GROUP BY ALL) b USING (model)")
def baseline_mixed(spark, sf_dir):
    rows = facts(spark, sf_dir)
    of = lambda condition, name: rows.filter(condition).groupBy("model").agg(F.avg("exact_match").alias(name))
    return of("source <> 'ett'", "baseline").join(of("source = 'ett'", "mixed"), "model").withColumn("delta", F.round(F.col("mixed") - F.col("baseline"), 9))


@query("generation_summary", W + QUESTIONS + " SELECT coalesce(modality, 'all') AS modality, coalesce(difficulty, 'all') AS difficulty, count(*) AS n FROM q GROUP BY GROUPING SETS ((), (modality), (difficulty), (modality, difficulty))")
def generation_summary(spark, sf_dir):
    out = questions(spark, sf_dir).groupingSets([[], ["modality"], ["difficulty"], ["modality", "difficulty"]], "modality", "difficulty").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("modality", F.lit("all")).alias("modality"), F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "n")


HUMAN = RATERS + ", i AS (SELECT doc_id, lang, list_aggregate([quality, toxic, long]::DOUBLE[], 'stddev_pop') AS std, quality + toxic + long AS y FROM r)"


def rated(spark, sf_dir):
    values = F.array(*[F.col(c).cast("double") for c in ("quality", "toxic", "long")])
    y = F.col("quality") + F.col("toxic") + F.col("long")
    spread = F.sqrt(y / 3 - (y / 3) * (y / 3))
    return raters(spark, sf_dir).select("doc_id", "lang", spread.alias("std"), y.alias("y"), F.size(values).alias("k"))


@query("human_sensitivity", W + HUMAN + " SELECT lang, round(avg(std), 9) AS mean_std, sum(y * (3 - y)) / sum(3) AS flip_rate, count(*) AS n FROM i GROUP BY lang")
def human_sensitivity(spark, sf_dir):
    """Spread of three views' ratings of an item, and the share of differing pairs of all pairs."""
    return rated(spark, sf_dir).groupBy("lang").agg(F.round(F.avg("std"), 9).alias("mean_std"), (F.sum(F.col("y") * (3 - F.col("y"))) / F.sum("k")).alias("flip_rate"), F.count("*").alias("n"))


@query("human_report", W + HUMAN + " SELECT 'accuracy' AS measure, lang, round(avg(quality), 9) AS value FROM r GROUP BY lang UNION ALL SELECT 'sensitivity', lang, round(avg(std), 9) FROM i GROUP BY lang UNION ALL SELECT 'flip_rate', lang, round(sum(y * (3 - y)) / sum(3), 9) FROM i GROUP BY lang UNION ALL SELECT 'agreement', lang, round(avg((quality = long)::INT), 9) FROM r GROUP BY lang")
def human_report(spark, sf_dir):
    """All measures of human ratings, one row each."""
    rows = raters(spark, sf_dir)
    sensitivity = human_sensitivity(spark, sf_dir)
    agree = st.cohen_kappa(rows, ["lang"], "quality", "long")
    parts_ = [(rows.groupBy("lang").agg(F.avg("quality").alias("v")), "accuracy"), (sensitivity.select("lang", F.col("mean_std").alias("v")), "sensitivity"), (sensitivity.select("lang", F.col("flip_rate").alias("v")), "flip_rate"), (agree.select("lang", F.col("agreement").alias("v")), "agreement")]
    out = [frame.select(F.lit(name).alias("measure"), "lang", F.round("v", 9).alias("value")) for frame, name in parts_]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("objects_looked_up", W + FACTS + " SELECT coalesce(n_name, 'own ' || object_id % 10) AS meta, count(*) AS n, round(avg(exact_match), 9) AS em FROM facts LEFT JOIN (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0) ON object_id = c_custkey GROUP BY ALL")
def objects_looked_up(spark, sf_dir):
    """Facts beside a dimension that lacks some objects: those stand by themselves."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    known = read(spark, sf_dir, "customer").filter("c_custkey % 7 <> 0").join(F.broadcast(nations), "c_nationkey").select(F.col("c_custkey").alias("object_id"), "n_name")  # 25 nations
    meta = F.coalesce("n_name", F.concat(F.lit("own "), (F.col("object_id") % 10).cast("string")))
    return facts(spark, sf_dir).join(known, "object_id", "left").groupBy(meta.alias("meta")).agg(F.count("*").alias("n"), F.round(F.avg("exact_match"), 9).alias("em"))


EASY = "difficulty = '1-hop' AND exact_match = 0"
HARD = "difficulty = '3-hop' AND exact_match = 1"


@query("easy_hard_pairs", W + FACTS + f""", e AS (SELECT model, modality, viz_type, question_id AS easy, row_number() OVER (PARTITION BY model, modality, viz_type ORDER BY question_id) AS i FROM facts WHERE {EASY} QUALIFY i <= 3), h AS (SELECT model, modality, viz_type, question_id AS hard, row_number() OVER (PARTITION BY model, modality, viz_type ORDER BY question_id) AS j FROM facts WHERE {HARD} QUALIFY j <= 3) SELECT model, modality, viz_type, easy, hard FROM e JOIN h USING (model, modality, viz_type)""")
def easy_hard_pairs(spark, sf_dir):
    """Easy questions that failed beside hard ones that didn't: three of each side a group, chosen before they are paired."""
    rows = facts(spark, sf_dir)
    group = ["model", "modality", "viz_type"]
    own = Window.partitionBy(*group).orderBy("question_id")
    side = lambda condition, name: rows.filter(condition).withColumn("i", F.row_number().over(own)).filter("i <= 3").select(*group, F.col("question_id").alias(name))
    return side(EASY, "easy").join(side(HARD, "hard"), group)


@query("chance_adjusted", W + FACTS + """, c AS (SELECT modality, task, answer, count(*) AS k FROM facts GROUP BY ALL), b AS (SELECT modality, task, max(k) / sum(k) AS base FROM c GROUP BY ALL), m AS (SELECT model, modality, task, avg(exact_match) AS em FROM facts GROUP BY ALL) SELECT model, modality, task, round(CASE WHEN base >= 1 THEN 0 ELSE greatest(0, (em - base) / (1 - base)) END, 9) AS adjusted FROM m JOIN b USING (modality, task)""")
def chance_adjusted(spark, sf_dir):
    """What is reached of the way from the majority's share to 1."""
    rows = facts(spark, sf_dir)
    base = rows.groupBy("modality", "task", "answer").agg(F.count("*").alias("k")).groupBy("modality", "task").agg((F.max("k") / F.sum("k")).alias("base"))
    means = rows.groupBy("model", "modality", "task").agg(F.avg("exact_match").alias("em")).join(base, ["modality", "task"])
    return means.select("model", "modality", "task", F.round(formats.chance_adjusted(F.col("em"), F.col("base")), 9).alias("adjusted"))


FIRST_TOKEN = r"""regexp_replace(regexp_replace(split_part(regexp_replace(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(13))), '\s+', ' ', 'g'), ' ', 1), '[.,;:!?)\]"'']+$', ''), '^[(\["'']+', '')"""


@query("lenient_tokens", f"WITH t AS (SELECT {FIRST_TOKEN} AS t FROM documents WHERE text IS NOT NULL) SELECT CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in formats.SYNONYMS.items()) + " ELSE t END AS token, count(*) AS n FROM t GROUP BY ALL")
def lenient_tokens(spark, sf_dir):
    """The first token of a text without its punctuation, synonyms as one."""
    return read(spark, sf_dir, "documents").filter("text is not null").groupBy(formats.lenient(F.col("text")).alias("token")).agg(F.count("*").alias("n"))


@query("safe_names", W + ROWS + " SELECT DISTINCT regexp_replace(question_id, '::.*$', '') AS base_id, regexp_replace(question_id, '[^A-Za-z0-9._-]+', '_', 'g') AS file_name FROM aer")
def safe_names(spark, sf_dir):
    rows = evaluation_rows(spark, sf_dir).select("question_id").distinct()
    return rows.select(formats.base_id(F.col("question_id")).alias("base_id"), formats.safe_name(F.col("question_id")).alias("file_name")).distinct()


@query("serialised_series", W + SERIES + r" SELECT data_id, md5(string_agg('t=' || t || ': ' || format('{:.4f}', value), chr(10) ORDER BY t)) AS digest FROM ts GROUP BY data_id")
def serialised_series(spark, sf_dir):
    """One line a point."""
    line = F.concat(F.lit("t="), F.col("t"), F.lit(": "), F.format_string("%.4f", F.col("value")))
    return series(spark, sf_dir).groupBy("data_id").agg(F.md5(formats.lines(F.col("t"), line)).alias("digest"))


@query("serialised_graphs", W + GRAPHS + ", n AS (SELECT data_id, max(node) AS most FROM nodes GROUP BY ALL) SELECT n.data_id, 'nodes: 0..' || any_value(most) || chr(10) || string_agg(src || ' -- ' || dst, chr(10) ORDER BY src, dst) AS text FROM n JOIN edges USING (data_id) GROUP BY n.data_id")
def serialised_graphs(spark, sf_dir):
    nodes, edges = graphs(spark, sf_dir)
    head = nodes.groupBy("data_id").agg(F.concat(F.lit("nodes: 0.."), F.max("node")).alias("head"))
    listed = edges.groupBy("data_id").agg(formats.lines(F.struct("src", "dst"), F.concat_ws(" -- ", "src", "dst")).alias("listed"))
    return head.join(listed, "data_id").select("data_id", F.concat_ws("\n", "head", "listed").alias("text"))


@query("serialised_tables", W + PART + " SELECT data_id, md5('row,label,size' || chr(10) || string_agg(row_idx || ',' || CASE WHEN label LIKE '%,%' THEN '\"' || label || '\"' ELSE label END || ',' || size::BIGINT, chr(10) ORDER BY row_idx)) AS digest FROM part_rows GROUP BY data_id")
def serialised_tables(spark, sf_dir):
    """Comma-separated rows with their index."""
    line = F.concat_ws(",", "row_idx", formats.quoted_cell(F.col("label")), F.col("size").cast("long"))
    return parts(spark, sf_dir).groupBy("data_id").agg(F.md5(F.concat(F.lit("row,label,size\n"), formats.lines(F.col("row_idx"), line))).alias("digest"))


@query("formatted_values", W + PART + r""" SELECT data_id, row_idx, format('{:.3f}', price) AS cell, CASE WHEN price = floor(price) AND abs(price) < 1e15 THEN price::BIGINT::VARCHAR ELSE rtrim(rtrim(format('{:.3f}', price), '0'), '.') END AS value, row_idx || ': ' || CASE WHEN length(label) > 12 THEN left(label, 11) || '~' ELSE label END AS row_label, regexp_extract_all('Of ''size'' the row ''' || row_idx || ''' is?', '''([^'']*)''', 1) AS quoted FROM part_rows""")
def formatted_values(spark, sf_dir):
    """Cells with three places, values without idle zeros, row labels cut to twelve characters, and what a question quotes."""
    question = F.concat(F.lit("Of 'size' the row '"), F.col("row_idx"), F.lit("' is?"))
    return parts(spark, sf_dir).select("data_id", "row_idx", formats.cell(F.col("price")).alias("cell"), formats.value(F.col("price")).alias("value"), formats.row_label(F.col("row_idx"), F.col("label")).alias("row_label"), formats.quoted(question).alias("quoted"))


@query("prompt_digests", "SELECT item_id, sha256(text) AS digest, left(split_part(trim(text), '.', 1), 140) AS placeholder FROM benchmark WHERE text IS NOT NULL")
def prompt_digests(spark, sf_dir):
    """SHA-256 of a prompt, and its first sentence, of at most 140 characters, as a placeholder answer."""
    return read(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", F.sha2("text", 256).alias("digest"), formats.placeholder(F.col("text")).alias("placeholder"))


@query("visual_tokens", "WITH d AS (SELECT p_partkey, greatest(28, round(p_size * 20 / 28.0) * 28)::BIGINT AS w, greatest(28, round(p_retailprice / 28.0) * 28)::BIGINT AS h FROM part) SELECT p_partkey, w, h, (w // 28) * (h // 28) AS tokens FROM d")
def visual_tokens(spark, sf_dir):
    """Sides rounded to patches of 28 pixels, one token a patch."""
    side = lambda x: F.greatest(F.lit(28), F.round(x / 28.0) * 28).cast("long")
    d = read(spark, sf_dir, "part").select("p_partkey", side(F.col("p_size") * 20).alias("w"), side(F.col("p_retailprice")).alias("h"))
    return d.withColumn("tokens", F.floor(F.col("w") / 28) * F.floor(F.col("h") / 28))


@query("rating_canon", W + RATERS + ", x AS (SELECT doc_id, CASE WHEN toxic = 1 THEN ' I ' WHEN quality = 1 THEN 'c' ELSE 'Ambiguous' END AS raw FROM r) SELECT doc_id, CASE lower(left(trim(raw), 1)) WHEN 'c' THEN 'C' WHEN 'a' THEN 'A' WHEN 'i' THEN 'I' END AS rating FROM x")
def rating_canon(spark, sf_dir):
    """Ratings as C, A or I; any other fails."""
    raw = F.when(F.col("toxic") == 1, " I ").when(F.col("quality") == 1, "c").otherwise("Ambiguous")
    return raters(spark, sf_dir).select("doc_id", formats.rating(raw).alias("rating"))


@query("flat_taken", W + QUESTIONS + ", o AS (SELECT question_id, modality, row_number() OVER (ORDER BY CASE modality WHEN 'tabular' THEN 0 WHEN 'timeseries' THEN 1 ELSE 2 END DESC, question_id) AS k FROM q) SELECT question_id, modality FROM o WHERE k <= 200")
def flat_taken(spark, sf_dir):
    """Groups one after another, the first 200 of all."""
    place = F.when(F.col("modality") == "tabular", 0).when(F.col("modality") == "timeseries", 1).otherwise(2)
    return questions(spark, sf_dir).select("question_id", "modality", place.alias("g")).orderBy(F.desc("g"), "question_id").limit(200).drop("g")


#: Quotas by difficulty of the datasets in turn.
PLANS = ((8, 8, 6, 3), (7, 7, 7, 4), (7, 8, 6, 4), (8, 7, 6, 4))
LEVELS = ("1-hop", "2-hop", "3-hop", "counterfactual")


@query("quota_selected", W + QUESTIONS + f""", p AS (SELECT question_id, object_id % 20 AS data_id, difficulty, row_number() OVER (PARTITION BY object_id % 20, difficulty ORDER BY question_id) AS k FROM q) SELECT question_id, data_id, difficulty FROM p WHERE k <= ({[list(x) for x in PLANS]})[data_id % 4 + 1][list_position({list(LEVELS)}, difficulty)]""")
def quota_selected(spark, sf_dir):
    """Of each dataset's candidates so many of each difficulty, by a plan that datasets take in turn."""
    pool = questions(spark, sf_dir).select("question_id", (F.col("object_id") % 20).alias("data_id"), "difficulty")
    plans = F.array(*[F.array(*map(F.lit, x)) for x in PLANS])
    quota = F.element_at(F.element_at(plans, (F.col("data_id") % 4 + 1).cast("int")), F.array_position(F.array(*map(F.lit, LEVELS)), F.col("difficulty")).cast("int"))
    return sampling.first_of_each(pool, ["data_id", "difficulty"], [F.col("question_id")], quota)


PLACE = HASH.format("'7:' || question_id")


@query("bucket_fill", W + QUESTIONS + f""", b AS (SELECT question_id, modality, difficulty, {PLACE} AS h, row_number() OVER (PARTITION BY modality, difficulty ORDER BY {PLACE}, question_id) AS k FROM q), n AS (SELECT greatest(1, 100 // count(DISTINCT (modality, difficulty))) AS per FROM q), t AS (SELECT *, (k <= per) AS own FROM b, n), o AS (SELECT *, row_number() OVER (ORDER BY own DESC, h, question_id) AS r FROM t) SELECT question_id, modality, difficulty FROM o WHERE r <= 100""")
def bucket_fill(spark, sf_dir):
    """As many of each bucket, the rest from what is left."""
    return sampling.bucket_fill(questions(spark, sf_dir).select("question_id", "modality", "difficulty"), ["modality", "difficulty"], "question_id", 100, 7)


@query("source_mix", W + QUESTIONS + f""", s AS (SELECT question_id, modality, source, row_number() OVER (PARTITION BY modality, source ORDER BY {PLACE}, question_id) AS k FROM q), c AS (SELECT modality, sum((source = 'synthetic')::INT) AS a, sum((source <> 'synthetic')::INT) AS b, 30 + CASE modality WHEN 'tabular' THEN 1 ELSE 0 END AS t FROM q GROUP BY ALL),
w AS (SELECT modality, least(a, t // 2 + greatest(0, t - t // 2 - b)) AS synthetic, least(b, t - t // 2 + greatest(0, t // 2 - a)) AS other FROM c) SELECT question_id, modality, source FROM s JOIN w USING (modality) WHERE k <= CASE WHEN source = 'synthetic' THEN synthetic ELSE other END""")
def source_mix(spark, sf_dir):
    """91 items: a third a modality, the first of which has the odd one; half of each from either source, as far as it reaches."""
    return sampling.source_mix(questions(spark, sf_dir).select("question_id", "modality", "source"), 91, MODALITIES, "question_id", 7)


@query("deficit_sample")
def deficit_sample(spark, sf_dir):
    """100 items: even strata, what is missing by weighed deficits."""
    items = questions(spark, sf_dir).withColumn("source", F.when(F.col("source") == "synthetic", "synthetic").otherwise("real_world"))
    strata = {"modality": MODALITIES, "difficulty": LEVELS, "source": ("synthetic", "real_world")}
    return sampling.deficit_sample(items.select("question_id", *strata), strata, "question_id", 100, 7)


@query("comparison_pairs", W + FACTS + ", p AS (SELECT model, question_id, any_value(question) AS question, min(CASE WHEN exact_match >= 1 THEN viz_type END) AS viz_a, min(CASE WHEN exact_match <= 0 THEN viz_type END) AS viz_b FROM facts GROUP BY ALL) SELECT * FROM p WHERE viz_a IS NOT NULL AND viz_b IS NOT NULL")
def comparison_pairs(spark, sf_dir):
    """A format that led to the right answer beside one that didn't, the first of each by name; internal columns dropped."""
    first = lambda c: F.min(F.when(c, F.col("viz_type")))
    p = facts(spark, sf_dir).groupBy("model", "question_id").agg(F.any_value("question").alias("question"), first(F.col("exact_match") >= 1).alias("viz_a"), first(F.col("exact_match") <= 0).alias("viz_b"), F.count("*").alias("_n"))
    return formats.public(p.filter("viz_a is not null and viz_b is not null"))
