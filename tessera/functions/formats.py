"""Column expressions that format, serialise and canonicalise values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that count as one.
SYNONYMS = {"positively": "positive", "negatively": "negative", "increases": "increasing", "rising": "increasing", "decreases": "decreasing", "falling": "decreasing"}
#: Ratings by their first letter.
RATINGS = {"c": "C", "a": "A", "i": "I"}


def lenient(text: Column) -> Column:
    """The first token in lower case without punctuation around it, synonyms as one."""
    first = F.split_part(F.regexp_replace(F.lower(F.trim(text, F.lit(" \t\n\r"))), r"\s+", " "), F.lit(" "), F.lit(1))
    bare = F.regexp_replace(F.regexp_replace(first, r"""[.,;:!?)\]"']+$""", ""), r"""^[(\["']+""", "")
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, bare), bare)


def chance_adjusted(score: Column, base: Column) -> Column:
    """What ``score`` reaches of the way from ``base`` to 1, at least 0; 0 where the base is 1."""
    return F.when(base >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), (score - base) / (1 - base)))


def base_id(question_id: Column) -> Column:
    return F.regexp_replace(question_id, "::.*$", "")


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_")


def lines(order: Column, line: Column) -> Column:
    """An aggregate: lines in order, joined by newlines."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")


def quoted_cell(text: Column) -> Column:
    """A cell of comma-separated values; null as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def cell(x: Column) -> Column:
    return F.format_string("%.3f", x)


def value(x: Column) -> Column:
    """Whole numbers as such, others with at most three places and no idle zeros."""
    short = F.regexp_replace(F.regexp_replace(cell(x), "0+$", ""), r"\.$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).when(short.isin("-0", ""), "0").otherwise(short)


def row_label(index: Column, text: Column, most: int = 12) -> Column:
    """Index and text, cut to ``most`` characters of which the last is a tilde."""
    return F.concat(index.cast("string"), F.lit(": "), F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("~"))).otherwise(text))


def quoted(text: Column) -> Column:
    """What stands between single quotes."""
    return F.regexp_extract_all(text, F.lit("'([^']*)'"), F.lit(1))


def placeholder(context: Column, most: int = 140) -> Column:
    """A text's first sentence, of at most ``most`` characters; null and empty ones have a fixed name."""
    stripped = F.regexp_replace(F.coalesce(context, F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    first = F.substring(F.split_part(stripped, F.lit("."), F.lit(1)), 1, most)
    return F.when(first == "", "structured sample").otherwise(first)


def rating(raw: Column) -> Column:
    """C, A or I by the first letter; fails on any other."""
    table = F.create_map(*[F.lit(x) for pair in RATINGS.items() for x in pair])
    found = F.try_element_at(table, F.lower(F.substring(F.trim(raw), 1, 1)))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown rating: "), F.coalesce(raw, F.lit("null")))).cast("string"))


#: Fields that items given to raters don't carry.
INTERNAL = ("source_type", "modality", "difficulty")


def public(rows: DataFrame, internal: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` without internal columns: those named, and those whose names begin with an underscore."""
    return rows.drop(*internal, *[c for c in rows.columns if c.startswith("_")])
