"""Quality classifier: a document's own evidence, shifted by the posterior of its site.

A logistic regression over shape features gives each document's evidence. Sites are a host and a path
below it. Each path's rate of good documents, from labelled outcomes and from the evidence of all other
documents at a lesser weight, gets a beta prior at its host's posterior mean, the host's at the overall
rate; the prior's weight is fitted at either level by moments, so sparse sites stay near their parents as far
as sites are alike. A document's log-odds move by what its path's posterior, without the document itself,
differs from the overall rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import join_checked, staged

#: At most so many labelled rows, by hash order of the id, fit the document classifier.
TRAIN_ROWS = 20_000
FEATURES = ("exclaim", "symbols", "upper", "pipes", "distinct", "distinct_lines", "word_length", "digits", "log_words", "repeats")


def features(text: Column) -> dict[str, Column]:
    """Shape features of a text, each bounded; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda chars: F.length(F.translate(t, chars, ""))
    words = F.split(t, " ")
    count = F.size(words).cast("double")
    lines = F.split(t, "\n")
    return {
        "exclaim": (F.length(t) - without("!")) / count,
        "symbols": (F.length(t) - without("#$%&*@^~=+<>{}[]")) / count,
        "upper": (F.length(t) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n,
        "pipes": (F.length(t) - without("|")) / count,
        "distinct": F.size(F.array_distinct(words)) / count,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "word_length": F.least(n / count, F.lit(20.0)) / 10,
        "digits": (F.length(t) - without("0123456789")) / n,
        "log_words": F.log1p(count) / 10,
        "repeats": F.size(F.array_distinct(words)) / F.sqrt(count) / 10,
    }


def expand(x: np.ndarray) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.abs(x)), x * x, np.ones((len(x), 1))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, halved while they don't lower the loss; of no use
    without both labels."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * len(y) * (w @ w) / 2)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        while (after := loss(w - step)) > now and np.abs(step).max() > 1e-8:
            step /= 2
        w, now = w - step, after
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def prior_weight(levels: DataFrame, parent: str) -> float:
    """The weight of a parent's mean, in labelled documents: what the rates s / n of groups of n of two or more
    vary around it beyond binomial noise."""
    p, n, s = F.col(parent), F.col("n"), F.col("s")
    r = levels.where("n >= 2").agg(F.sum(F.pow(s / n - p, 2) * n).alias("spread"), F.sum(p * (1 - p)).alias("noise"), F.sum(p * (1 - p) * (n - 1)).alias("more")).first()
    if not r["more"]:
        return 10.0
    rho = (r["spread"] - r["noise"]) / r["more"]
    return float(min(max(1 / rho - 1 if rho > 0 else 1000.0, 1.0), 1000.0))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", soft: float = 0.2, site_weight: float = 0.5) -> DataFrame:
    """(doc_id, evidence, site_mean, score, good int) for each row of docs with an id.

    labels has id_col and label_col (1 good, 0 bad). soft is the weight of an unlabelled document, site_weight
    how far sites shift a score. site_mean is the path's posterior mean without the row's own label or evidence.
    Null and empty texts are scored by their features like any other; a null host or path is a site of its
    own. Rows with a null id are dropped; rows that repeat stay. Without both labels evidence is 0.5.
    Other columns are ignored. good is 1 if score is at least 0.5."""
    cols = features(F.col(f"`{text_col}`").cast("string"))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("\x00")).alias("host"), F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("\x00")).alias("path"), *[cols[k].alias(k) for k in FEATURES])
    base = staged(base.where("doc_id is not null"))
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    marked = base.join(marks, "doc_id", "left")
    sample = np.array([tuple(r) for r in marked.where("y is not null").orderBy(F.xxhash64("doc_id"), *FEATURES).limit(TRAIN_ROWS).select("y", *FEATURES).collect()], float).reshape(-1, 1 + len(FEATURES))
    width = 3 * len(FEATURES) + 1
    w = fit_logistic(expand(sample[:, 1:]), sample[:, 0]) if len(set(sample[:, 0])) == 2 else np.zeros(width)
    z = F.lit(float(w[-1]))
    for i, k in enumerate(FEATURES):
        c = F.col(k)
        z = z + float(w[i]) * c + float(w[len(FEATURES) + i]) * F.sqrt(F.abs(c)) + float(w[2 * len(FEATURES) + i]) * c * c
    evidence = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    marked = marked.select("doc_id", "host", "path", "y", evidence.alias("evidence"))
    weight = F.when(F.col("y").isNull(), soft).otherwise(1.0)
    marked = marked.withColumn("own_n", weight).withColumn("own_s", weight * F.coalesce("y", "evidence"))
    paths = staged(marked.groupBy("host", "path").agg(F.sum("own_n").alias("n"), F.sum("own_s").alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = min(max(((total["s"] or 0) + 1) / ((total["n"] or 0) + 2), 1e-3), 1 - 1e-3)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("parent", F.lit(overall))
    by_host = prior_weight(hosts, "parent")
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = paths.join(hosts, "host")
    shrunk = lambda s, n, mean, w: (s + w * mean) / (n + w)
    by_path = prior_weight(sites.withColumn("parent", shrunk(F.col("host_s"), F.col("host_n"), F.lit(overall), by_host)), "parent")
    out = join_checked(marked.drop("y"), sites, ["host", "path"])
    host_mean = shrunk(F.col("host_s") - F.col("own_s"), F.col("host_n") - F.col("own_n"), F.lit(overall), by_host)
    out = out.withColumn("site_mean", shrunk(F.col("s") - F.col("own_s"), F.col("n") - F.col("own_n"), host_mean, by_path))
    clip = lambda p: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    moved = _logit(clip(F.col("evidence"))) + site_weight * (_logit(clip(F.col("site_mean"))) - float(np.log(overall / (1 - overall))))
    score = 1 / (1 + F.exp(-moved))
    return out.select("doc_id", "evidence", "site_mean", score.alias("score")).withColumn("good", (F.col("score") >= 0.5).cast("int"))
