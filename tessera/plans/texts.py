"""Queries of free-text scoring, extraction, parsing and item text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import parsing, paraphrase, scoring
from tessera.plans.registry import query
from tessera.sources.adapters import pick, read

#: Shapes of answers by orderkey; %s is the gold value.
SHAPES = (
    "%s",
    "The answer is %s. It can be read off the chart above without any doubt.",
    "Looking at the plotted values over the whole range. Therefore, %s and the model agrees with that",
    "I compared the first and the last of all points of the series.\nResult: %s",
    "After adding up everything that the table shows we obtain \\boxed{%s} in the end.",
    "The values were compared one by one, which took a while to do.\n**%s**",
    "All of the rows were checked and none was left out here. %s.",
    "The chart has several bars and a legend, each with a label!\n  %s  ",
    " %s.0 ",
    "%s units",
    "Sorry, that cannot be determined from this picture at all by me",
    "[ERROR]",
)
SQL_SHAPES = "['" + "', '".join(s.replace("'", "''") for s in SHAPES) + "']"
TEXTS = f"""p AS (SELECT o_orderkey AS id, (floor(o_totalprice)::BIGINT % 5000)::VARCHAR AS answer, replace(({SQL_SHAPES})[o_orderkey % 12 + 1], '%s', CASE WHEN o_custkey % 4 = 0 THEN ((floor(o_totalprice)::BIGINT + 1) % 5000)::VARCHAR ELSE (floor(o_totalprice)::BIGINT % 5000)::VARCHAR END) AS prediction FROM orders)"""


def texts(spark, sf_dir):
    """id, answer, prediction: twelve shapes of model output around a value, one in four wrong by one."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cents = F.floor("o_totalprice").cast("long")
    value = F.when(F.col("o_custkey") % 4 == 0, (cents + 1) % 5000).otherwise(cents % 5000).cast("string")
    return o.select(F.col("o_orderkey").alias("id"), (cents % 5000).cast("string").alias("answer"), F.replace(pick(SHAPES, F.col("o_orderkey") % 12), F.lit("%s"), value).alias("prediction"))


NORMAL = r"""CASE WHEN regexp_full_match({0}, '[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?') THEN CASE WHEN NOT contains({0}, '.') AND {0}::DOUBLE = floor({0}::DOUBLE) THEN {0}::DOUBLE::BIGINT::VARCHAR ELSE printf('%g', {0}::DOUBLE) END ELSE {0} END"""
N = lambda c: NORMAL.format(f"lower(trim({c}, ' ' || chr(10)))")
EM = f"({N('prediction')} = {N('answer')})::INT::DOUBLE"


@query("exact_match", "WITH " + TEXTS + f" SELECT id, {EM} AS exact_match FROM p")
def exact_match(spark, sf_dir):
    return texts(spark, sf_dir).select("id", scoring.exact_match(F.col("prediction"), F.col("answer")).alias("exact_match"))


@query("token_f1", "WITH " + TEXTS + r""", t AS (SELECT id, list_filter(string_split_regex(lower(regexp_replace(prediction, '[[:punct:]]', '', 'g')), '\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(lower(regexp_replace(answer, '[[:punct:]]', '', 'g')), '\s+'), lambda x: x <> '') AS b FROM p),
c AS (SELECT id, len(a) AS na, len(b) AS nb, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w))))) AS k FROM t)
SELECT id, CASE WHEN na = 0 AND nb = 0 THEN 1.0 WHEN na = 0 OR nb = 0 OR k = 0 THEN 0.0 ELSE round(2 * (k / na) * (k / nb) / ((k / na) + (k / nb)), 9) END AS f1 FROM c""")
def token_f1(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.round(scoring.token_f1(F.col("prediction"), F.col("answer")), 9).alias("f1"))


@query("numeric_accuracy", "WITH " + TEXTS + """, n AS (SELECT id, try_cast(trim(prediction) AS DOUBLE) AS x, answer::DOUBLE AS y FROM p) SELECT id, coalesce((abs(x - y) <= 0.05 OR (greatest(abs(x), abs(y)) > 0 AND abs(x - y) / greatest(abs(x), abs(y)) <= 0.01))::INT, 0)::DOUBLE AS numeric FROM n""")
def numeric_accuracy(spark, sf_dir):
    return texts(spark, sf_dir).select("id", scoring.numeric_accuracy(F.col("prediction"), F.col("answer")).alias("numeric"))


EXTRACTED = r"""CASE WHEN length(t) <= 40 THEN t
 WHEN m1 <> '' THEN m1 WHEN m2 <> '' THEN m2 WHEN m3 <> '' THEN m3 WHEN m4 <> '' THEN m4 WHEN m5 <> '' THEN m5
 WHEN regexp_full_match(lt, '[+-]?\d+(\.\d+)?') THEN lt
 WHEN regexp_full_match(last, '[+-]?\d+(\.\d+)?') THEN last WHEN regexp_full_match(last, '[^.!?]{1,60}') THEN last ELSE t END"""


TOKENS = r"([A-Za-z0-9][A-Za-z0-9._\-]*(?:\s+[A-Za-z0-9][A-Za-z0-9._\-:]*)?)"
STOPS = "['" + "','".join(scoring.CONTINUATIONS) + "']"
CANDIDATE = r"""list_transform([string_split_regex(rtrim({0}, '.,!?;:'), '\s+')], lambda w: CASE WHEN len(w) < 2 OR list_contains(""" + STOPS + r""", lower(w[2])) THEN w[1] ELSE w[1] || ' ' || w[2] END)[1]"""


@query("extracted_answers", "WITH " + TEXTS + r""", s AS (SELECT id, answer, trim(prediction, ' ' || chr(10)) AS t FROM p), r AS (SELECT *, regexp_extract(t, '(?i)answer\s*(?:is|=|:)\s*""" + TOKENS + r"""', 1) AS r1, regexp_extract(t, '(?i)(?:therefore|thus|hence|so)\s*[,:]\s*""" + TOKENS + r"""', 1) AS r2, regexp_extract(t, '(?i)(?:result|output)\s*[:=]\s*""" + TOKENS + r"""', 1) AS r3, regexp_extract(t, '\\boxed\{([^{}]+)\}', 1) AS m4, regexp_extract(t, '\*\*([A-Za-z0-9]+)\*\*$', 1) AS m5,
regexp_extract(t, '[.!?]\s+([A-Za-z0-9][A-Za-z0-9._\-]*)\s*\.?\s*$', 1) AS lt0, trim(split_part(t, chr(10), -1)) AS last FROM s), y AS (SELECT *, """ + ", ".join(f"{CANDIDATE.format(f'r{i}')} AS m{i}" for i in (1, 2, 3)) + """, rtrim(lt0, '.') AS lt FROM r) SELECT id, """ + EXTRACTED + " AS extracted FROM y")
def extracted_answers(spark, sf_dir):
    return texts(spark, sf_dir).select("id", scoring.extracted(F.col("prediction")).alias("extracted"))


@query("extraction_flips", "WITH " + TEXTS + f""" SELECT count(*) AS n, sum({EM}) AS before FROM p""")
def extraction_flips(spark, sf_dir):
    """How many rows exact match finds as they are."""
    return texts(spark, sf_dir).select(scoring.exact_match(F.col("prediction"), F.col("answer")).alias("e")).agg(F.count("*").alias("n"), F.sum("e").alias("before"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


EDGED = f"trim({{0}}, {_quoted(parsing.EDGES)})"
UNMARKED = EDGED.format(r"regexp_replace(regexp_replace(regexp_replace(prediction, '`{1,3}([^`]*)`{1,3}', '\1', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '\s+', ' ', 'g')")
SHORT = "whole"
for opening in parsing.OPENINGS:
    SHORT = f"trim(regexp_replace({SHORT}, {_quoted(opening)}, ''))"
SQL_YES_NO = r"""CASE WHEN regexp_matches({0}, '(?i)^yes\b') THEN 'yes' WHEN regexp_matches({0}, '(?i)^no\b') THEN 'no' WHEN regexp_matches({0}, '(?i)\b(yes|true)\b') THEN 'yes'
 WHEN regexp_matches({0}, '(?i)\b(no|false|not connected|not directly|cannot|wouldn''t|would not)\b') THEN 'no' WHEN {0} = '0' THEN 'no' WHEN {0} = '1' THEN 'yes' END"""
SQL_NUMBER = r"""CASE WHEN regexp_full_match(short, '[-+]?\d*\.?\d+') THEN short WHEN regexp_matches(short, '(is|=|:)\s*[-+]?\d*\.?\d+\s*[.!]?\s*$') THEN regexp_extract(short, '(is|=|:)\s*([-+]?\d*\.?\d+)\s*[.!]?\s*$', 2)
 ELSE list_last(regexp_extract_all(short, '[-+]?\d*\.?\d+')) END"""
SQL_DIRECTION = "CASE " + " ".join(f"WHEN contains(lower(short), '{word}') THEN '{word}'" for _, word in parsing.DIRECTIONS) + " END"
SUBJECT = EDGED.format(r"regexp_split_to_array(short, '\b(has|have|is|are|was|were|the|with|which|that)\b')[1]")
SQL_LABEL = f"""CASE WHEN regexp_matches(short, '[''"][^''"]+[''"]') THEN trim(regexp_extract(short, '[''"]([^''"]+)[''"]', 1)) WHEN length({SUBJECT}) BETWEEN 1 AND 79 THEN {SUBJECT} ELSE short END"""


def _in_kind(kind: str) -> str:
    names = ", ".join(_quoted(name) for name in parsing.KINDS[kind])
    return "(" + " OR ".join([f"task IN ({names})", *(f"contains(task, {_quoted(hint)})" for hint in parsing.HINTS.get(kind, ()))]) + ")"


@query("parsed_answers", "WITH " + TEXTS + f""", k AS (SELECT id, prediction, ([{', '.join(_quoted(t) for t in parsing.ALL_TASKS)}])[id % {len(parsing.ALL_TASKS)} + 1] AS task FROM p),
w AS (SELECT id, task, {UNMARKED} AS whole FROM k), s AS (SELECT *, {EDGED.format(SHORT)} AS short FROM w),
r AS (SELECT *, {SQL_YES_NO.format('whole')} AS yes_whole, {SQL_YES_NO.format('short')} AS yes_short, {SQL_NUMBER} AS num, {SQL_DIRECTION} AS dir, {SQL_LABEL} AS label, len(list_filter(string_split(short, ' '), lambda x: x <> '')) AS n FROM s)
SELECT id, task, CASE WHEN {' OR '.join(f'regexp_matches(short, {_quoted(p)})' for p in parsing.REFUSALS)} THEN coalesce(num, '[REFUSED]')
 WHEN {_in_kind('yes_no')} AND coalesce(yes_whole, yes_short) IS NOT NULL THEN coalesce(yes_whole, yes_short) WHEN {_in_kind('number')} AND num IS NOT NULL THEN num WHEN {_in_kind('direction')} AND dir IS NOT NULL THEN dir
 WHEN task = 'change_point' AND regexp_matches(short, '(?i)\\b(none|no significant|no clear|no change)\\b') THEN 'none' WHEN task = 'change_point' AND num IS NOT NULL THEN num WHEN {_in_kind('label')} THEN label
 WHEN n <= 3 THEN lower(short) WHEN n <= 6 AND yes_short IS NOT NULL THEN yes_short WHEN n > 5 AND num IS NOT NULL THEN num ELSE coalesce(dir, lower(short)) END AS parsed FROM r""")
def parsed_answers(spark, sf_dir):
    """Responses parsed by their tasks, of every kind and of none."""
    rows = texts(spark, sf_dir).withColumn("task", pick(parsing.ALL_TASKS, F.col("id") % len(parsing.ALL_TASKS)))
    return rows.select("id", "task", parsing.parsed(F.col("prediction"), F.col("task")).alias("parsed"))


@query("tolerant_matches", "WITH " + TEXTS + """, n AS (SELECT try_cast(trim(prediction) AS DOUBLE) AS x, answer::DOUBLE AS y FROM p) SELECT sum(coalesce((abs(x - y) <= 0.05 OR (abs(y) > 0 AND abs(x - y) <= 0.01 * abs(y)))::INT, 0))::BIGINT AS by_gold, sum(coalesce((abs(x - y) <= 0.05 OR (greatest(abs(x), abs(y)) > 0 AND abs(x - y) / greatest(abs(x), abs(y)) <= 0.01))::INT, 0))::BIGINT AS by_greater FROM n""")
def tolerant_matches(spark, sf_dir):
    p, a = F.col("prediction"), F.col("answer")
    return texts(spark, sf_dir).agg(F.count_if(scoring.tolerant(p, a, denominator="gold")).alias("by_gold"), F.count_if(scoring.tolerant(p, a)).alias("by_greater"))


@query("vote_keys", "WITH " + TEXTS + r""" SELECT id, CASE WHEN regexp_extract(replace(prediction, ',', ''), '[-+]?\d*\.?\d+') <> '' THEN regexp_extract(replace(prediction, ',', ''), '[-+]?\d*\.?\d+') ELSE lower(trim(prediction, ' ' || chr(10))) END AS vote FROM p""")
def vote_keys(spark, sf_dir):
    return texts(spark, sf_dir).select("id", scoring.vote(F.col("prediction")).alias("vote"))


@query("claims_coerced", r"""WITH c AS (SELECT p_partkey, (['[BOLD] ' || p_size || ',234.5%', p_size || ' 000', '[ITALIC]' || p_name, '-', p_retailprice::BIGINT::VARCHAR])[p_partkey % 5 + 1] AS raw FROM part), k AS (SELECT *, replace(replace(replace(replace(replace(raw, '[BOLD]', ''), '[ITALIC]', ''), ' ', ''), ',', ''), '%', '') AS t FROM c) SELECT p_partkey, try_cast(CASE WHEN regexp_full_match(t, '[+-]?(\d+(\.\d*)?|\.\d+)') THEN t END AS DOUBLE) AS value FROM k""")
def claims_coerced(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_retailprice")
    size = F.col("p_size").cast("string")
    raw = F.element_at(F.array(F.concat(F.lit("[BOLD] "), size, F.lit(",234.5%")), F.concat(size, F.lit(" 000")), F.concat(F.lit("[ITALIC]"), F.col("p_name")), F.lit("-"), F.round("p_retailprice").cast("long").cast("string")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", paraphrase.coerced(raw).alias("value"))


@query("paraphrases", r"""WITH q AS (SELECT p_partkey AS id, 'What is the average value of ' || p_name || '?' AS question FROM part), v AS (SELECT id, question, [replace(question, 'What is', 'Determine'), replace(question, 'What is', 'Find'), replace(question, 'What is', 'Calculate'), replace(question, 'What is', 'Identify')] AS vs FROM q)
SELECT id::VARCHAR AS question_id, question FROM q UNION ALL SELECT id || '_para' || (i - 1), vs[i] FROM v, range(1, 3) r(i)""")
def paraphrases(spark, sf_dir):
    """Each question and its first two variants."""
    q = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("question_id"), F.concat(F.lit("What is the average value of "), F.col("p_name"), F.lit("?")).alias("question"))
    return paraphrase.with_variants(q, 2).select("question_id", "question")


@query("assist_questions", r"""WITH q AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'What is the average of ''' || p_name || '''?' ELSE 'What is the total of ''average ' || p_name || '''?' END AS question, CASE WHEN p_partkey % 5 = 0 THEN 'comparison' ELSE 'aggregation' END AS task FROM part) SELECT id FROM q WHERE task = 'comparison' OR task = 'aggregation' AND contains(lower(regexp_replace(question, '''[^'']*''', ' ', 'g')), 'average')""")
def assist_questions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    question = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("What is the average of '"), F.col("p_name"), F.lit("'?"))).otherwise(F.concat(F.lit("What is the total of 'average "), F.col("p_name"), F.lit("'?")))
    q = p.select(F.col("p_partkey").alias("id"), question.alias("question"), F.when(F.col("p_partkey") % 5 == 0, "comparison").otherwise("aggregation").alias("task"))
    return q.filter(paraphrase.needs_means(F.col("task"), F.col("question"))).select("id")


@query("question_difficulty", """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'counterfactual' WHEN p_partkey % 4 >= 3 THEN '3-hop' WHEN p_partkey % 4 = 2 OR p_partkey % 2 = 1 THEN '2-hop' ELSE '1-hop' END AS difficulty FROM part""")
def question_difficulty(spark, sf_dir):
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("id"), paraphrase.difficulty(k % 4, k % 2 == 1, k % 7 == 0).alias("difficulty"))
