"""Question text: paraphrases, difficulty, assistance, and cell coercion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Openings that stand for each other, by group.
STARTERS = (
    ("What is", "Determine", "Find", "Calculate", "Identify"),
    ("What are", "List", "Enumerate", "Find all", "Identify all"),
    ("How many", "Count the number of", "What is the count of"),
    ("Which", "What", "Identify which"),
)
#: Phrases and what they may be replaced by.
SYNONYMS = {
    "maximum": ("highest", "largest", "greatest", "peak"),
    "minimum": ("lowest", "smallest", "least"),
    "average": ("mean", "arithmetic mean"),
    "total": ("sum", "aggregate", "combined"),
    "value": ("amount", "quantity", "figure"),
    "between": ("from", "connecting"),
    "adjacent": ("neighboring", "directly connected"),
    "connected to": ("linked to", "joined to"),
    "path": ("route", "trail"),
    "shortest path": ("minimum-length path", "shortest route"),
    "node": ("vertex",),
    "edge": ("link", "connection"),
    "degree": ("number of connections",),
    "weight": ("cost", "distance"),
}
#: Whole questions as orders or the other way round.
REWORDINGS = ((r"(?i)^What is (.+)\?$", "Report $1."), (r"(?i)^What is (.+)\?$", "State $1."), (r"(?i)^What is (.+)\?$", "$1 is?"), (r"(?i)^How many (.+)\?$", "Count $1."), (r"(?i)^Which (.+)\?$", "Identify $1."))


def _starts(question: Column, opening: str) -> Column:
    return F.lower(F.substring(question, 1, len(opening))) == opening.lower()


def variants(question: Column, seed: int = 42) -> Column:
    """Different paraphrases in order: other openings of the first group that fits, one synonym a phrase by hash, rewordings."""
    trimmed = F.ltrim(question)
    openings = None
    for group in STARTERS:
        for opening in group:
            rest = F.substring(trimmed, F.lit(len(opening) + 1), F.length(trimmed))
            others = F.array(*[F.concat(F.lit(o), rest) for o in group if o.lower() != opening.lower()])
            openings = F.when(_starts(trimmed, opening), others) if openings is None else openings.when(_starts(trimmed, opening), others)
    parts = [F.coalesce(openings, F.array().cast("array<string>"))]
    for phrase, words in SYNONYMS.items():
        at = F.pmod(F.xxhash64(question, F.lit(phrase), F.lit(seed)), F.lit(len(words))).cast("int")
        chosen = F.element_at(F.array(*map(F.lit, words)), at + 1)
        place = F.locate(phrase, F.lower(question))
        upper = F.substring(question, place, F.lit(1)).rlike("^[A-Z]")
        word = F.when(upper, F.concat(F.upper(F.substring(chosen, 1, 1)), F.substring(chosen, 2, 100))).otherwise(chosen)
        changed = F.concat(F.substring(question, F.lit(1), place - 1), word, F.substring(question, place + len(phrase), F.length(question)))
        parts.append(F.when(place > 0, F.array(changed)).otherwise(F.array().cast("array<string>")))
    for pattern, form in REWORDINGS:
        parts.append(F.when(F.trim(question).rlike(pattern), F.array(F.regexp_replace(F.trim(question), pattern, form))).otherwise(F.array().cast("array<string>")))
    every = F.transform(F.concat(*parts), F.trim)
    return F.filter(F.array_distinct(every), lambda v: (v != "") & (v != F.trim(question)))


def with_variants(items: DataFrame, n: int = 2, seed: int = 42) -> DataFrame:
    """Items and their first ``n`` variants, numbered ``_para0`` on, with ``paraphrase_of``; empty questions have none."""
    own = items.withColumn("paraphrase_of", F.lit(None).cast("string"))
    more = items.filter("question <> ''").select("*", F.posexplode(F.slice(variants(F.col("question"), seed), 1, n)).alias("__i", "__v"))
    more = more.withColumn("paraphrase_of", F.col("question_id")).withColumn("question_id", F.concat("question_id", F.lit("_para"), F.col("__i").cast("string"))).withColumn("question", F.col("__v")).drop("__i", "__v")
    return own.unionByName(more)


def needs_means(task: Column, question: Column) -> Column:
    """Questions that a row of means helps: comparisons, and aggregations that ask for an average outside quotes."""
    bare = F.lower(F.regexp_replace(question, "'[^']*'", " "))
    return (task == "comparison") | ((task == "aggregation") & F.contains(bare, F.lit("average")))


def difficulty(steps: Column, arithmetic: Column, counterfactual: Column) -> Column:
    return F.when(counterfactual, "counterfactual").when((steps <= 1) & ~arithmetic, "1-hop").when(steps <= 2, "2-hop").otherwise("3-hop")


def cell_text(raw: Column) -> Column:
    """Without style tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"\[(BOLD|ITALIC)\]", ""), r"\s+", " "))


def coerced(raw: Column) -> Column:
    """The number that a table cell holds: blanks, thousands commas and a per cent sign dropped; null for text."""
    compact = F.regexp_replace(cell_text(raw), " ", "")
    plain = F.regexp_replace(F.regexp_replace(compact, ",", ""), "%$", "")
    return F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), plain.try_cast("double"))


def literal_pattern(words: list[str]) -> str:
    """An alternation of literal words, longest first."""
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
