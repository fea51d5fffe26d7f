"""Calls of outside services: each distinct prompt once, with retries, failures as null."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render(template: str, **columns: str):
    """Column of the template with `{name}` put in; null values are empty."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return out


def call(df: DataFrame, prompt: str, provider: Callable[[str], str], retries: int = 3, first_wait: float = 1.0, longest_wait: float = 60.0) -> DataFrame:
    """df with content and tokens; equal prompts share one call, a null prompt or a call that keeps failing gives null."""
    import pandas as pd

    def run(frames):
        for f in frames:
            out = []
            for p in f["prompt"]:
                got, wait = None, first_wait
                for left in range(retries, -1, -1):
                    try:
                        got = provider(p)
                        break
                    except Exception:  # noqa: BLE001
                        if left:
                            time.sleep(wait)
                            wait = min(2 * wait, longest_wait)
                out.append(got)
            yield pd.DataFrame({"prompt": f["prompt"], "content": out})

    asked = df.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("prompt")).distinct()
    answers = asked.mapInPandas(run, "prompt string, content string").withColumnRenamed("prompt", prompt)
    return df.join(answers, prompt, "left").withColumn("tokens", (F.length("content") / 4).cast("long"))
