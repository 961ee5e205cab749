"""Chat formatting into budgeted windows with a loss mask.

A conversation's turns, in order, are cut into windows of at most ``budget``
tokens at turn ends. Prefix sums of turn tokens choose the spans: a turn that lies
within one stride of the prefix sum belongs to that stride's span, one that
crosses into the next is a span by itself, so no span depends on how the ones
before it were filled. Every window starts with the system turn (where the
conversation opens with one) and repeats up to ``history`` turns before its span
as far as ``history_tokens`` allow. The loss mask marks the text of assistant turns
of the span; what is repeated, system turn and history, is masked.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Inside roles
and texts a backslash before a backslash, before the bar of ``<|`` and, in roles,
before a newline makes control strings inert; unescaping drops it.

Prefix sums are taken in two levels, within runs of ``RUN`` turn numbers and over
the runs' sums, so a long conversation is not one window-function group. Turns are
ordered by (turn, role, text), nulls first; repeated rows are turns of their own.
Null roles and texts count as empty; null conversation ids are one conversation; a
single turn beyond the budget is a window of its own, whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed, partitions, whole

#: The template.
START, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers a run of the first level of prefix sums has.
RUN = 64
#: Tokens that the template adds to a turn.
FRAME_TOKENS = 5


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def turn_tokens(text: Column) -> Column:
    """An estimate from the characters; a tokenizer's counts may be given as a column instead."""
    return F.ceil(F.length(text) / 4).cast("long") + FRAME_TOKENS


WINDOW = "conv_id, window, n_tokens, n_repeated, text, loss"


def windows(conversations: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 192, tokens_col: str | None = None) -> DataFrame:
    """conv_id, window, n_tokens, n_repeated, text, loss (array of start, end in code points of text).

    n_repeated: how many of the window's first turns are repeated. Windows of a
    conversation are in order of ``window``, whose values have gaps.
    """
    tokens = F.col(tokens_col).cast("long") if tokens_col else turn_tokens(whole("text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), whole("role").alias("role"), whole("text").alias("raw"), tokens.alias("tokens"))
    turns = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        "conv_id",
        "turn",
        "role",
        "tokens",
        "raw",
        F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(2**62))).alias("run"),
    )
    inner = Window.partitionBy("conv", "run").orderBy("turn", "role", "raw").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("in_tokens", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).withColumn("in_rows", F.count("*").over(inner))
    turns = checkpointed(turns)
    sums = turns.groupBy("conv", "run").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    outer = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("conv", "run", F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base_rows"))
    turns = turns.join(bases, ["conv", "run"]).select("conv", "conv_id", "role", "raw", "tokens", (F.col("base_rows") + F.col("in_rows")).alias("idx"), (F.col("base") + F.col("in_tokens")).alias("before"))
    turns = turns.withColumn("rendered", F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), escaped(F.col("raw")), F.lit(END + "\n")))
    turns = turns.withColumn("content", F.length(escaped(F.col("raw")))).drop("raw")
    # a system turn first: its tokens come off every window's budget and out of the prefix sums
    system = turns.filter("idx = 0 and role = 'system'").select("conv", F.col("tokens").alias("sys_tokens"), F.col("rendered").alias("sys_rendered"))
    turns = turns.join(system.select("conv", "sys_tokens"), "conv", "left").withColumn("sys_tokens", F.coalesce("sys_tokens", F.lit(0)))
    stride = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.col("sys_tokens"))
    at = F.col("before") - F.col("sys_tokens")
    last = at + F.col("tokens") - 1
    window = F.when((F.col("idx") == 0) & (F.col("sys_tokens") > 0), F.lit(0)).otherwise(2 * F.floor(at / stride) + (F.floor(last / stride) > F.floor(at / stride)).cast("long"))
    turns = checkpointed(turns.withColumn("window", window))
    # where the system turn stands alone in window 0 because the next one crosses a stride, it is still window 0's
    spans = turns.groupBy("conv", "window").agg(F.min("idx").alias("first"), F.min("before").alias("first_before"))
    past = turns.filter("idx > 0 or sys_tokens = 0").select("conv", F.col("window").alias("of"), "idx", "before", "tokens", "rendered", F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + history)).alias("first"))
    repeated = past.join(spans, ["conv", "first"]).filter((F.col("first_before") - F.col("before") <= history_tokens) & (F.col("of") < F.col("window")))
    kept_system = system.join(spans.filter("first > 0"), "conv").select("conv", "window", F.lit(0).cast("long").alias("idx"), F.col("sys_tokens").alias("tokens"), F.col("sys_rendered").alias("rendered"))
    own = turns.select("conv", "window", "idx", "tokens", "rendered", F.lit(0).alias("again"), F.when(F.col("role") == "assistant", F.col("content")).alias("target"))
    again = repeated.select("conv", "window", "idx", "tokens", "rendered").union(kept_system).select("*", F.lit(1).alias("again"), F.lit(None).cast("int").alias("target"))
    parts = own.union(again).groupBy("conv", "window").agg(
        F.sum("tokens").alias("n_tokens"),
        F.sum("again").alias("n_repeated"),
        F.sort_array(F.collect_list(F.struct("idx", "rendered", "target"))).alias("parts"),
    )
    ends = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["rendered"])).alias("at"),
            # the text of a turn ends before the end mark and newline
            F.when(p["target"].isNull(), acc["loss"])
            .otherwise(F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(p["rendered"]) - F.lit(len(END) + 1) - p["target"]).alias("start"), (acc["at"] + F.length(p["rendered"]) - F.lit(len(END) + 1)).alias("end")))))
            .alias("loss"),
        ),
    )["loss"]
    conv_id = F.when(F.col("conv") == "", F.lit(None)).otherwise(F.col("conv")).cast("long")
    return parts.select(conv_id.alias("conv_id"), "window", "n_tokens", "n_repeated", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("text"), ends.alias("loss"))


ESCAPE = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<\|im_start\|>((?:\\.|[^\\\n])*)\n(.*?)<\|im_end\|>\n", re.S)


def unescaped(text: str) -> str:
    return ESCAPE.sub(r"\1", text)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window: escapes leave no control string in a text."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in TURN.finditer(text)]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns that aren't repeats, and the text under the loss mask.

    A digest runs over a conversation's windows in order; windows are streamed
    sorted through a task, which holds one at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def done():
            return (*key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

        for frame in frames:
            rows = []
            for conv, again, text, loss in zip(frame["conv"], frame["n_repeated"], frame["text"], frame["loss"], strict=True):
                if key != (conv,):
                    if key is not None:
                        rows.append(done())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, content in parsed(text)[int(again) :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                for span in loss:
                    target = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            yield _frame(rows)
        if key is not None:
            yield _frame([done()])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])
        out["conv_id"] = pd.array([int(c) if c else None for c in out["conv_id"]], dtype="Int64")
        return out

    n = partitions(formatted.sparkSession)
    rows = formatted.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "window", "n_repeated", "text", "loss")
    return rows.repartition(n, "conv").sortWithinPartitions("conv", "window").select("conv", "n_repeated", "text", "loss").mapInPandas(run, DIGEST)
