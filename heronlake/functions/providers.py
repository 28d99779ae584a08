"""Places where a model is plugged in, with deterministic stand-ins. Nothing here calls a network.

A provider is a function of pandas series that runs in Arrow batches, or a replay table that is joined by key; what goes
before and after it is ordinary DataFrame code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TextModel(Protocol):
    """Prompts to answers, batch by batch; raises to have a batch tried again."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def echo(prompts: list[str]) -> list[str]:
    """A stand-in: yes or no by the length of the prompt."""
    return ["yes" if len(p) % 2 == 0 else "no" for p in prompts]


def answered(df: DataFrame, prompt: str, model: TextModel, out: str = "answer", retries: int = 3, wait_s: float = 0.0) -> DataFrame:
    """``df`` with the model's answers; a failing batch is tried again with doubled waits, then has null answers."""
    import time

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[str | None] = [None] * len(pdf)
            for k in range(retries):
                try:
                    found = list(model(pdf[prompt].tolist()))
                    break
                except Exception:  # noqa: BLE001  whatever a model's client raises
                    time.sleep(wait_s * 2**k)
            yield pdf.assign(**{out: found})

    return df.mapInPandas(run, schema)


class Client:
    """A model behind a call for one prompt: a call that raises is repeated after doubled waits, and gives null in the end."""

    def __init__(self, call: Callable[[str], str], attempts: int = 3, wait_s: float = 0.0):
        self.call, self.attempts, self.wait_s = call, attempts, wait_s

    def __call__(self, prompts: list[str]) -> list[str | None]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str | None:
        import time

        for k in range(self.attempts):
            try:
                return self.call(prompt)
            except Exception:  # noqa: BLE001  whatever a client raises
                time.sleep(self.wait_s * 2**k)
        return None


class Unsteady:
    """A stand-in for a service: fails once for prompts whose length is divisible by 3, always for those by 5."""

    def __init__(self):
        self.seen: set[str] = set()

    def __call__(self, prompt: str) -> str:
        first = prompt not in self.seen
        self.seen.add(prompt)
        if len(prompt) % 5 == 0 or (first and len(prompt) % 3 == 0):
            raise ConnectionError("busy")
        return echo([prompt])[0]


def graded(prompts: list[str]) -> list[str]:
    """A stand-in judge: a rating by the prompt's length, and nothing for every fourth length."""
    return ["" if len(p) % 4 == 0 else f"The answer fits.\nRating: [[{len(p) % 10 + 1}]]" for p in prompts]


def long_words(prompts: list[str]) -> list[str]:
    """A stand-in for a keyword model: the prompt's words of eight ASCII letters or more."""
    import re

    return [", ".join(re.findall("[a-z]{8,}", p)) for p in prompts]


def rewriter(prompts: list[str]) -> list[str]:
    """A stand-in for a rewriting model: by the prompt's length nothing, the last turn, or that with two words more; with keywords
    the last turn, behind the first of them if the length is even."""
    out = []
    for p in prompts:
        turns, _, words = p.partition("\nKeywords: ")
        last = turns.rpartition("\n")[2].partition("] ")[2]
        if words:
            out.append(last if len(p) % 2 else f"{words.split(', ')[0]} {last}")
        else:
            out.append(["", last, f"{last} in detail"][len(p) % 3])
    return out


def resumed(df: DataFrame, key: str, prompt: str, stored: DataFrame, model: TextModel, out: str = "answer", retries: int = 3) -> DataFrame:
    """``df`` with stored answers (key, out) where these aren't blank; only the other rows go to the model."""
    j = replayed(df, key, stored, out)
    done = F.coalesce(F.trim(out), F.lit("")) != ""
    return j.where(done).unionByName(answered(j.where(~done).drop(out), prompt, model, out, retries))


def replayed(df: DataFrame, key: str, table: DataFrame, out: str = "answer") -> DataFrame:
    """``df`` with stored answers (key, out)."""
    return df.join(table.select(key, out), key, "left")


def hashed_vectors(words: list[str], size: int = 16):
    """A stand-in for a contextual encoder: a fixed unit vector for each word."""
    import hashlib

    import numpy as np

    out = np.stack([np.frombuffer(hashlib.sha512(w.encode()).digest()[: size * 2], dtype="<i2").astype(float) for w in words])
    return out / np.sqrt((out**2).sum(1, keepdims=True))


def bert_score(a: Column, b: Column, encoder: Callable = hashed_vectors) -> Column:
    """precision, recall, f1 by greedy matching of token vectors; nulls without tokens."""
    import re

    words = re.compile(r"\w+")

    @F.pandas_udf("struct<precision: double, recall: double, f1: double>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for p, t in zip(x, y):
            p, t = words.findall((p or "").lower()), words.findall((t or "").lower())
            if not p or not t:
                rows.append((None, None, None))
                continue
            s = encoder(p) @ encoder(t).T
            pr, re_ = float(s.max(1).mean()), float(s.max(0).mean())
            rows.append((pr, re_, 2 * pr * re_ / (pr + re_) if pr + re_ else 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    return run(a, b)


def p_yes(yes: Column, no: Column) -> Column:
    """Probability of yes from arrays of logits of the words that mean yes and no: softmax of their log-sum-exps."""
    lse = lambda c: F.array_max(c) + F.log(F.aggregate(F.transform(c, lambda x: F.exp(x - F.array_max(c))), F.lit(0.0), lambda s, x: s + x))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(lse(no) - lse(yes)))
