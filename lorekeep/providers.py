"""Verdict and embedding providers: model calls as tables.

A verdict provider maps a DataFrame of questions to the same rows with a ``verdict`` column.  ``Recorded`` joins recorded
answers, ``HashVerdicts`` derives them from a hash of the question (for tests and offline runs), ``Callback`` wraps any
function on pandas batches, for instance a remote model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import request_key


def hash_choice(choices: list[str], *parts: Column) -> Column:
    """A choice by the last hex digit of the sha256 of the parts; the same in every engine."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    digit = F.conv(F.substring(h, 64, 1), 16, 10).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in choices]), F.pmod(digit, F.lit(len(choices))) + 1)


@dataclass
class HashVerdicts:
    choices: list[str]
    keys: tuple[str, ...] = ("id_a", "id_b")

    def ask(self, questions: DataFrame) -> DataFrame:
        return questions.withColumn("verdict", hash_choice(self.choices, *[F.col(k) for k in self.keys]))


@dataclass
class Recorded:
    """Answers recorded under ``request_key(parts)``; questions without a recording have a null verdict."""

    answers: DataFrame  # key, verdict
    keys: tuple[str, ...] = ("id_a", "id_b")

    def ask(self, questions: DataFrame) -> DataFrame:
        q = questions.withColumn("key", request_key(*[F.col(k).cast("string") for k in self.keys]))
        return q.join(self.answers.select("key", "verdict"), "key", "left").drop("key")


@dataclass
class Callback:
    """``f`` gets a pandas batch of questions and returns their verdicts; batches hold at most ``chunk`` rows."""

    f: Callable[[pd.DataFrame], list]
    chunk: int = 12

    def ask(self, questions: DataFrame) -> DataFrame:
        f, chunk = self.f, self.chunk

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for s in range(0, len(pdf), chunk):
                    part = pdf.iloc[s : s + chunk].copy()
                    part["verdict"] = list(f(part))
                    yield part

        return questions.mapInPandas(run, questions.schema.simpleString()[7:-1] + ",verdict:string")


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A unit vector seeded by the text's hash: equal texts have equal vectors, others are unrelated."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        import hashlib

        def one(t):
            if t is None:
                return None
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(dims)
            return (v / np.linalg.norm(v)).astype(np.float32)

        return texts.map(one)

    return embed(text)
