"""The seam to language models: prompts are columns, a model is a function that is passed in.

A model takes a list of prompts and returns a list of replies. The default echoes, so
that every query is deterministic; a real one opens its connection once per task.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Sequence[str]], Sequence[str]]


def echo(prompts: Sequence[str]) -> list[str]:
    """A stand-in model: its reply is the prompt's last line."""
    return [p.rsplit("\n", 1)[-1] for p in prompts]


def delay(attempt: int, base: float = 1.0, most: float = 60.0, jitter: float = 0.25) -> float:
    """Seconds to wait before a try: doubling, capped, with some chance."""
    return min(most, base * 2**attempt) * (1 + jitter * (2 * random.random() - 1))


def fallback(*models: Model) -> Model:
    """The first model that does not raise."""

    def call(prompts: Sequence[str]) -> Sequence[str]:
        last: Exception | None = None
        for m in models:
            try:
                return m(prompts)
            except Exception as e:  # the next model takes over
                last = e
        raise last or ValueError("no models")

    return call


def apply(rows: DataFrame, prompt: Column, model: Model = echo, reply: str = "reply", tries: int = 3, base: float = 0.5, batch: int = 64) -> DataFrame:
    """``rows`` with the model's reply; null where every try failed. Concurrency is the number of tasks.

    The model is asked for ``batch`` prompts at a time; a failure concerns these alone.
    """

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            every, out = list(prompts), []
            for at in range(0, len(every), batch):
                asked = every[at : at + batch]
                for k in range(tries):
                    try:
                        out += model(asked)
                        break
                    except Exception:  # a failed batch is tried again, then left null
                        if k + 1 < tries:
                            time.sleep(delay(k, base))
                else:
                    out += [None] * len(asked)
            yield pd.Series(out, dtype=object)

    return rows.withColumn(reply, ask(prompt).alias(reply))


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """A template with {names} replaced literally; a text without {chunk} goes below the template."""
    out = F.lit(template if "{chunk}" in template or "chunk" not in fields else template + "\n\nContent:\n{chunk}")
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def classify(chunks: DataFrame, models: Mapping[str, Model], prompt: Column, key: str = "chunk_id", category: str = "category") -> DataFrame:
    """chunk_id, classifier, category, value and confidence of several models' replies, for the voting operators."""
    out = None
    for name, model in models.items():
        one = apply(chunks, prompt, model).select(F.col(key).alias("chunk_id"), F.lit(name).alias("classifier"), F.lit(category).alias("category"), F.col("reply").alias("value"), F.when(F.col("reply").isNull(), 0.0).otherwise(1.0).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out
