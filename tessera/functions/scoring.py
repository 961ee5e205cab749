"""Scoring of free-text predictions as column expressions.

Everything stays in the JVM. Numbers are read as Python's float() reads them:
digits may be grouped by single underscores, a d or f suffix is text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What reads as a number, in lower case and without outer white space.
NUMBER = r"^[+-]?((\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)(e[+-]?\d(_?\d)*)?|inf|infinity|nan)$"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def number(s: Column) -> Column:
    """The double that a text spells, or null."""
    t = F.lower(stripped(s))
    return F.when(t.rlike(NUMBER), F.regexp_replace(t, "_", "").try_cast("double"))


def general(x: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g has them."""
    sci = F.format_string("%.5e", F.abs(x))
    digits = F.concat(F.substring(sci, 1, 1), F.substring(sci, 3, 5))
    exp = F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int")
    fixed = F.when(exp >= 0, F.concat(F.substring(digits, F.lit(1), exp + 1), F.lit("."), F.substring(digits, exp + 2, F.lit(6)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
    tidy = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(tidy(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.lit("e"), F.when(exp < 0, "-").otherwise("+"), F.lpad(F.abs(exp).cast("string"), 2, "0"))
    text = F.when((exp >= -4) & (exp < 6), tidy(fixed)).otherwise(scientific)
    signed = F.concat(F.when((x < 0) | (F.signum(x).cast("string") == "-0.0"), "-").otherwise(""), text)
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(x == 0, F.when(F.signum(x).cast("string") == "-0.0", "-0").otherwise("0")).otherwise(signed)


def normalized_number(s: Column) -> Column:
    """Integral texts without a point as integers, other numbers by ``general``, else the text stripped and lower."""
    t = F.lower(stripped(s))
    x = number(s)
    integral = (F.abs(x) < 1e37) & (x == F.rint(x)) & ~t.contains(".")
    whole = F.when(F.abs(x) < 9e15, x.cast("long").cast("string")).otherwise(F.when(F.abs(x) < 1e37, x.cast("decimal(38,0)")).cast("string"))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), t).when(integral, whole).otherwise(general(x))


def exact_match(prediction: Column, answer: Column) -> Column:
    """1.0 if the normalised texts agree; infinities compare as text."""
    return (normalized_number(prediction) == normalized_number(answer)).cast("double")


def normalized_text(s: Column) -> Column:
    return stripped(F.regexp_replace(F.translate(F.lower(s), PUNCTUATION, ""), r"(?U)\s+", " "))


def tokens(s: Column) -> Column:
    return F.filter(F.split(normalized_text(s), " "), lambda t: t != "")


def token_f1(prediction: Column, answer: Column) -> Column:
    """F1 of the multisets of tokens; both empty: 1, one empty: 0.

    Tokens are made once a row and bound by a transform, as what a lambda names by its expression would be made
    for each of them anew. Where no token repeats, common ones need no count.
    """
    def scored(t: Column) -> Column:
        p, a = t["p"], t["a"]
        count = lambda own, w: F.size(F.filter(own, lambda x: x == w))
        shared = F.array_intersect(p, a)
        once = (F.size(F.array_distinct(p)) == F.size(p)) | (F.size(F.array_distinct(a)) == F.size(a))
        common = F.when(once, F.size(shared)).otherwise(F.aggregate(shared, F.lit(0), lambda acc, w: acc + F.least(count(p, w), count(a, w))))
        return F.struct(F.size(p).alias("p"), F.size(a).alias("a"), common.alias("common"))

    sizes = F.transform(F.array(F.struct(tokens(prediction).alias("p"), tokens(answer).alias("a"))), scored)

    def f1(n: Column) -> Column:
        precision, recall = n["common"] / n["p"], n["common"] / n["a"]
        return F.when((n["p"] == 0) & (n["a"] == 0), 1.0).when((n["p"] == 0) | (n["a"] == 0) | (n["common"] == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))

    return F.element_at(F.transform(sizes, f1), 1)


def tolerant(prediction: Column, answer: Column, absolute: float = 0.05, relative: float = 0.01, denominator: str = "max", either: bool = True, substring: bool = False, strip_dot: bool = False) -> Column:
    """True if two texts' numbers are close.

    ``denominator``: of the relative difference, max (of both) or gold (the
    answer). ``either``: one tolerance is enough, else the larger bound counts,
    which is the same test. With ``substring`` a text answer may lie in the
    prediction; with ``strip_dot`` a last full stop is dropped first.
    """
    p, a = (F.regexp_replace(stripped(c), r"\.$", "") if strip_dot else c for c in (prediction, answer))
    x, y = number(p), number(a)
    gap = F.abs(x - y)
    base = F.greatest(F.abs(x), F.abs(y)) if denominator == "max" else F.abs(y)
    close = (gap <= absolute) | ((base > 0) & (gap <= relative * base) if denominator == "gold" else (base > 0) & (F.try_divide(gap, base) <= relative))
    close = F.coalesce(close, F.lit(False))
    text = F.lower(stripped(p)) == F.lower(stripped(a))
    if substring:
        text = text | F.contains(F.lower(p), F.lower(stripped(a)))
    return close | (F.coalesce(text, F.lit(False)) if substring or strip_dot else F.lit(False))


def numeric_accuracy(prediction: Column, answer: Column, absolute: float = 0.05, relative: float = 0.01) -> Column:
    return tolerant(prediction, answer, absolute, relative).cast("double")


def scores(prediction: Column, answer: Column, extract: bool = False) -> Column:
    """struct(exact, f1, numeric)."""
    p = extracted(prediction) if extract else prediction
    return F.struct(exact_match(p, answer).alias("exact"), token_f1(p, answer).alias("f1"), numeric_accuracy(p, answer).alias("numeric"))


def numeric_like(s: Column) -> Column:
    return F.coalesce(stripped(s).rlike(r"^[+-]?\d+(\.\d+)?$"), F.lit(False))


def tolerant_score(prediction: Column, answer: Column) -> Column:
    """The greater of exact match and numeric accuracy where the answer is a number."""
    return F.when(numeric_like(answer), F.greatest(exact_match(prediction, answer), numeric_accuracy(prediction, answer))).otherwise(exact_match(prediction, answer))


def vote(s: Column) -> Column:
    """What votes are counted by: the first number in a text, commas dropped, else the text in lower case."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), ",", "")
    first = F.regexp_extract(t, r"[-+]?\d*\.?\d+", 0)
    return F.when(first != "", first).otherwise(F.lower(stripped(F.coalesce(s, F.lit("")))))


#: Markers before an answer of one or two tokens, in order.
TOKENS = r"([A-Za-z0-9][A-Za-z0-9._\-]*(?:\s+[A-Za-z0-9][A-Za-z0-9._\-:]*)?)"
MARKERS = (
    r"(?i)(?:the\s+)?(?:final\s+)?answer\s*(?:is|=|:)\s*['\"]?" + TOKENS,
    r"(?i)(?:therefore|thus|hence|so)\s*[,:]\s*['\"]?" + TOKENS,
    r"(?i)(?:result|output)\s*[:=]\s*['\"]?" + TOKENS,
    r"(?i)\\boxed\{([^{}]+?)\}",
    r"(?m)\*\*([A-Za-z0-9][A-Za-z0-9._\-\s]{0,30}?)\*\*\s*\.?\s*$",
)
#: Second tokens that go on a sentence.
CONTINUATIONS = "and or but with in on at by for of to from the a an is was were are be been tokens trend result value model based showing indicates indicating significantly approximately above below shown data table chart across throughout".split()
#: Answers that may end a text.
COMMON = "yes no none true false increasing decreasing stable positive negative".split()
LAST_TOKEN = r"[.!?]\s+([A-Za-z0-9][A-Za-z0-9._\-]*)\s*\.?\s*$"
LONE_NUMBER = r"^\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*$"


def _candidate(text: Column) -> Column:
    """At most two tokens, the second only if it doesn't go on a sentence."""
    parts = F.filter(F.split(F.regexp_replace(stripped(text), r"[.,!?;:]+$", ""), r"\s+"), lambda t: t != "")
    first, second = F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.get(parts, F.lit(1))
    return F.when(second.isNull() | F.lower(second).isin(CONTINUATIONS), first).otherwise(F.concat(first, F.lit(" "), second))


def extracted(prediction: Column) -> Column:
    """The short final answer of a long text, by the first rule that finds one."""
    text = stripped(prediction)
    rules = F.when(F.length(text) <= 40, text)
    for marker in MARKERS:
        found = F.regexp_extract(text, marker, 1)
        rules = rules.when((found != "") & (_candidate(found) != ""), _candidate(found))
    last_token = F.regexp_replace(F.regexp_extract(text, LAST_TOKEN, 1), r"\.+$", "")
    rules = rules.when((last_token != "") & (F.lower(last_token).isin(COMMON) | last_token.rlike(LONE_NUMBER)), last_token)
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), stripped), lambda t: t != "")
    last = F.element_at(lines, -1)
    rules = rules.when(last.rlike(LONE_NUMBER), F.regexp_extract(last, LONE_NUMBER, 1)).when(last.rlike(r"^[^.!?]{1,60}$"), last)
    tail = F.regexp_replace(stripped(F.substring_index(text, ". ", -1)), r"\.+$", "")
    return rules.when((F.size(lines) == 1) & F.contains(text, F.lit(". ")) & (F.length(tail) <= 40), tail).otherwise(text)
