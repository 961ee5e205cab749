"""Models as injected callables, answered in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from inspect import signature
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    """Answers a prompt; a batch by default one by one."""

    def answer(self, prompt: str) -> str: ...


def answer_batch(model: Model, prompts: list[str]) -> list[str]:
    own = getattr(model, "answer_batch", None)
    return own(prompts) if own else [model.answer(p) for p in prompts]


REGISTRY: dict[str, Callable[..., Model]] = {}


def register(name: str) -> Callable[[Callable[..., Model]], Callable[..., Model]]:
    def add(maker: Callable[..., Model]) -> Callable[..., Model]:
        REGISTRY[name] = maker
        return maker

    return add


def make(config: Mapping[str, object]) -> Model:
    """The registered model ``config["name"]``, made with those other entries that its maker takes."""
    if config.get("name") not in REGISTRY:
        raise KeyError(f"no model of that name: {config.get('name')}")
    maker = REGISTRY[config["name"]]
    taken = signature(maker).parameters
    return maker(**{k: v for k, v in config.items() if k in taken and k != "name"})


@register("echo")
class Echo:
    """A stub: the last word of the prompt."""

    def __init__(self, prefix: str = ""):
        self.prefix = prefix

    def answer(self, prompt: str) -> str:
        words = prompt.split()
        return self.prefix + (words[-1] if words else "")


def predicted(items: DataFrame, config: Mapping[str, object], prompt: str = "question", batch: int = 64) -> DataFrame:
    """``items`` with ``prediction``: a task makes the model once and asks it in batches; an exception is an error row, a null prompt empty.

    A column named prediction is replaced.
    """
    settings = dict(config)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make(settings)
        for prompts in frames:
            out: list[str] = []
            for start in range(0, len(prompts), batch):
                some = prompts.iloc[start : start + batch].tolist()
                try:
                    out += answer_batch(model, some)
                except Exception:  # one bad prompt doesn't take its batch along
                    for p in some:
                        try:
                            out.append(model.answer(p))
                        except Exception:
                            out.append("[ERROR]")
            yield pd.Series(out)

    ask = F.pandas_udf(run, "string")
    return items.drop("prediction").withColumn("prediction", ask(F.coalesce(F.col(prompt), F.lit(""))))
