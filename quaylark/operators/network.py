"""A small neural network on row arrays: layers as columns, gradients as grouped sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.operators.vectors import argmax


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def one_hot(label: Column, classes: int) -> Column:
    return F.array(*[(label == c).cast("double") for c in range(classes)])


def most_likely(a: Column) -> Column:
    return argmax(a)


def accuracy(df: DataFrame, scores: str, label: str) -> DataFrame:
    return df.agg(F.avg((argmax(F.col(scores)) == F.col(label)).cast("double")).alias("accuracy"))


def forward(x: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = x @ w[0] + w[1]
    a = np.maximum(z, 0)
    s = a @ w[2] + w[3]
    e = np.exp(s - s.max(1, keepdims=True))
    return z, a, e / e.sum(1, keepdims=True)


def gradient_descent(df: DataFrame, features: str, label: str, hidden: int, classes: int, rounds: int, rate: float, seed: int = 0) -> list[np.ndarray]:
    """Weights after rounds of full-batch steps; each round sums gradients by task, of the weights' size."""
    width = df.select(F.size(features)).first()[0]
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, classes)), np.zeros(classes)]
    rows = df.select(F.col(features).alias("x"), F.col(label).alias("y"))
    for _ in range(rounds):

        def f(frames, w=w):
            total, n = [np.zeros_like(x) for x in w], 0
            for p in frames:
                if not len(p):
                    continue
                x, y = np.stack(p["x"].to_numpy()).astype(float), np.eye(classes)[p["y"].to_numpy()]
                z, a, s = forward(x, w)
                d2 = s - y
                d1 = (d2 @ w[2].T) * (z > 0)
                for t, g in zip(total, (x.T @ d1, d1.sum(0), a.T @ d2, d2.sum(0)), strict=True):
                    t += g
                n += len(x)
            yield pd.DataFrame({"n": [n], "g": [np.concatenate([t.ravel() for t in total]).tolist()]})

        parts = rows.mapInPandas(f, "n long, g array<double>")
        sums = parts.select("n", F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
        g, at = np.array([r["v"] / r["n"] for r in sums]), 0
        new = []
        for x in w:
            new.append(x - rate * g[at : at + x.size].reshape(x.shape))
            at += x.size
        w = new
    return w
