"""Layers, towers, the split of losses over them, and the loss report."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaylark.functions.layers import SPLITS
from quaylark.operators.grouping import ordered, running


@dataclass(frozen=True)
class Sublayer:
    """The occurrence or the aggregate terms of a layer."""

    limit: float | None
    retention: float | None
    over: str
    kind: str


@dataclass(frozen=True)
class Layer:
    """Terms of a layer. Types are retention, franchise or reverse_franchise. Of the terms that don't
    bear on the split only those with a meaning here are fields; others go in extra."""

    occ_limit: float | None = None
    occ_retention: float | None = None
    agg_limit: float | None = None
    agg_retention: float | None = None
    occ_type: str = "retention"
    agg_type: str = "retention"
    share: float = 1.0
    name: str | None = None
    reinstatement: tuple[float, ...] | None = None
    currency: str | None = None
    basic_premium: float | None = None
    reinstatement_premium: float | None = None
    commission: float | None = None
    brokerage: float | None = None
    tax: float | None = None
    extra: tuple[tuple[str, object], ...] = ()

    @property
    def first_limit(self) -> float:
        return next((x for x in (self.occ_limit, self.agg_limit) if x is not None), math.inf)

    @property
    def auto_name(self) -> str:
        if self.occ_limit is not None or self.occ_retention is not None:
            return f"{_shown(self.occ_limit)} xs {_shown(self.occ_retention or 0.0)}"
        if self.agg_limit is not None or self.agg_retention is not None:
            return f"{_shown(self.agg_limit)} xs {_shown(self.agg_retention or 0.0)} agg"
        return "Unlimited Layer"

    @property
    def cap(self) -> float:
        """The largest loss that bears on the occurrence terms."""
        if self.occ_limit is None:
            return math.inf
        return {"retention": self.occ_limit + (self.occ_retention or 0.0), "franchise": self.occ_limit, "reverse_franchise": math.nan}[self.occ_type]

    @property
    def occ_layer(self) -> Sublayer:
        return Sublayer(self.occ_limit, self.occ_retention, "occurrence", self.occ_type)

    @property
    def agg_layer(self) -> Sublayer:
        return Sublayer(self.agg_limit, self.agg_retention, "aggregate", self.agg_type)

    def shown(self, term: str) -> str | None:
        """A term as text, None where it isn't set."""
        x = getattr(self, term)
        return None if x is None else str(x)

    def scaled(self, by: float) -> Layer:
        times = lambda x: None if x is None else x * by
        return replace(self, occ_limit=times(self.occ_limit), occ_retention=times(self.occ_retention), agg_limit=times(self.agg_limit), agg_retention=times(self.agg_retention))


def _shown(x: float | None) -> str:
    return "Unlimited" if x is None else f"{x:g}"


@dataclass(frozen=True)
class Tower:
    layers: tuple[Layer, ...]
    name: str | None = None
    subject_premium: float | None = None

    @staticmethod
    def from_retention(retention: float, limits: list[float]) -> Tower:
        """Layers stacked on the retention."""
        at, out = retention, []
        for x in limits:
            out.append(Layer(occ_limit=x, occ_retention=at))
            at += x
        return Tower(tuple(out))

    @staticmethod
    def single_shot(retention: float, limits: list[float]) -> Tower:
        """As from_retention, but the limit is for the year."""
        return Tower(tuple(Layer(occ_retention=x.occ_retention, agg_limit=x.occ_limit) for x in Tower.from_retention(retention, limits).layers))

    @staticmethod
    def one_at_100(retention: float, limits: list[float]) -> Tower:
        """One reinstatement at full premium: twice the limit for the year."""
        return Tower(tuple(replace(x, agg_limit=2 * x.occ_limit, reinstatement=(1.0,)) for x in Tower.from_retention(retention, limits).layers))

    def scaled(self, by: float) -> Tower:
        return Tower(tuple(x.scaled(by) for x in self.layers), self.name, None if self.subject_premium is None else self.subject_premium * by)

    def show(self) -> str:
        """An aligned table of the terms that any layer has."""
        used = [f.name for f in fields(Layer) if any(getattr(x, f.name) not in (None, ()) for x in self.layers)]
        rows = [["layer", *used], *([x.name or x.auto_name, *("" if getattr(x, k) is None else str(getattr(x, k)) for k in used)] for x in self.layers)]
        widths = [max(map(len, c)) for c in zip(*rows, strict=True)]
        return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def split(events: DataFrame, tower: Tower) -> DataFrame:
    """events with ceded_0, ceded_1, ... by layer, ceded and retained.

    Each layer sees the gross losses: its occurrence terms on each, its aggregate terms and share on
    the running sum within the iteration in order of (day, seq), and the difference back to events.
    All layers share one window, so there is one shuffle and one sort however many there are."""
    w, wr = ordered(), running()
    out, n = events, len(tower.layers)
    occ = {f"__occ_{k}": SPLITS[x.occ_type](F.col("amount"), x.occ_limit, x.occ_retention) for k, x in enumerate(tower.layers)}
    out = out.withColumns(occ)
    out = out.withColumns({f"__cum_{k}": F.sum(f"__occ_{k}").over(wr) for k in range(n)})
    out = out.withColumns({f"__agg_{k}": SPLITS[x.agg_type](F.col(f"__cum_{k}"), x.agg_limit, x.agg_retention) * x.share for k, x in enumerate(tower.layers)})
    out = out.withColumns({f"ceded_{k}": F.col(f"__agg_{k}") - F.coalesce(F.lag(f"__agg_{k}").over(w), F.lit(0.0)) for k in range(n)})
    ceded = sum((F.col(f"ceded_{k}") for k in range(n)), F.lit(0.0))
    return out.withColumn("ceded", ceded).withColumn("retained", F.col("amount") - F.col("ceded")).drop(*[f"__{a}_{k}" for a in ("occ", "cum", "agg") for k in range(n)])


def layer_totals(split_events: DataFrame, tower: Tower, n: int) -> DataFrame:
    """(iteration, total_0, ...): each layer's ceded amount by iteration 1 to n, zeros included."""
    k = range(len(tower.layers))
    by = split_events.groupBy("iteration").agg(*[F.sum(f"ceded_{i}").alias(f"total_{i}") for i in k])
    keys = split_events.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("iteration"))
    return keys.join(by, "iteration", "left").na.fill(0.0)


def loss_report(split_events: DataFrame, tower: Tower, n: int, denominator: str | float = "first_limit") -> DataFrame:
    """(layer, name, limit, el, std_dev, attach_prob, exhaust_prob) for each layer.

    el and std_dev are of the yearly ceded amounts over the denominator (first_limit, agg_limit or a
    number); an infinite one gives 0. A layer is exhausted within 0.01 of its aggregate limit, after
    its share. One pass over the amounts of the years with events gives all figures; the others are zeros,
    known by their number."""
    ks = range(len(tower.layers))
    by = split_events.where(F.col("iteration").between(1, n)).groupBy("iteration").agg(*[F.sum(f"ceded_{i}").alias(f"total_{i}") for i in ks])
    structs = []
    for k, x in enumerate(tower.layers):
        over = x.first_limit if denominator == "first_limit" else (x.agg_limit if x.agg_limit is not None else math.inf) if denominator == "agg_limit" else float(denominator)
        t = F.col(f"total_{k}")
        hit = F.count(F.when(t > x.agg_limit - 0.01, 1)) if x.agg_limit is not None else F.lit(0)
        m, own = F.count(t), F.coalesce(F.avg(t), F.lit(0.0))
        mean = F.coalesce(F.sum(t), F.lit(0.0)) / n
        square = (m * (F.coalesce(F.var_pop(t), F.lit(0.0)) + F.pow(own - mean, F.lit(2))) + (n - m) * F.pow(mean, F.lit(2))) / n
        structs.append(F.struct(F.lit(k).alias("layer"), F.lit(x.name or x.auto_name).alias("name"), F.lit(float(over)).alias("limit"), (mean / over).alias("el"), (F.sqrt(square) / over).alias("std_dev"), (F.count(F.when(t > 0, 1)) / n).alias("attach_prob"), (hit / n).alias("exhaust_prob")))
    return by.agg(F.array(*structs).alias("r")).select(F.inline("r"))


def attachment_probability(report: DataFrame) -> DataFrame:
    return report.select("layer", "attach_prob")


def exhaustion_probability(report: DataFrame) -> DataFrame:
    return report.select("layer", "exhaust_prob")


__all__ = ["Layer", "Tower", "Window", "layer_totals", "loss_report", "split"]
