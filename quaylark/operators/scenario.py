"""Operators on loss events (iteration, day, seq, id, amount) and their scenario's terms."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


EVENTS = "iteration int, day int, seq long, id long, amount double"


@dataclass(frozen=True)
class Scenario:
    """Events and what is the same for all of them."""

    events: DataFrame
    iterations: int
    threshold: float = 0.0
    day1: date = date(2019, 1, 1)
    name: str = ""

    def ordered(self) -> DataFrame:
        return self.events.orderBy("iteration", "day", "seq")

    def first_iterations(self, n: int) -> Scenario:
        if not 0 < n <= self.iterations:
            raise ValueError("n must be positive and at most the scenario's iterations")
        return replace(self, events=self.events.where(F.col("iteration") <= n), iterations=n)

    def iteration(self, number: int) -> Scenario:
        return replace(self, events=self.events.where(F.col("iteration") == number))

    def scaled(self, by: float) -> Scenario:
        return replace(self, events=self.events.withColumn("amount", F.col("amount") * by), threshold=self.threshold * by)

    def above(self, threshold: float) -> Scenario:
        """Amounts strictly above a threshold that is higher than the present one."""
        if threshold <= self.threshold:
            raise ValueError("the threshold must rise")
        return replace(self, events=self.events.where(F.col("amount") > threshold), threshold=threshold)

    def claim_date(self) -> Column:
        return F.date_add(F.lit(self.day1), F.col("day") - 1)

    def with_dates(self) -> DataFrame:
        d = self.claim_date()
        return self.events.withColumn("claim_date", d).withColumn("month", F.month(d)).withColumn("year", F.year(d))

    def until(self, last: date) -> Scenario:
        return replace(self, events=self.events.where(self.claim_date() <= F.lit(last)))

    def since(self, first: date) -> Scenario:
        return replace(self, events=self.events.where(self.claim_date() >= F.lit(first)))

    def moved_to(self, day1: date) -> Scenario:
        shift = (day1 - self.day1).days
        return replace(self, events=self.events.withColumn("day", (F.pmod(F.col("day") - shift - 1, F.lit(365)) + 1).cast("int")), day1=day1)

    def period(self) -> DataFrame:
        return self.events.agg(F.date_add(F.lit(self.day1), F.min("day") - 1).alias("first_date"), F.date_add(F.lit(self.day1), F.max("day") - 1).alias("last_date"))

    def seasons(self) -> DataFrame:
        return self.events.agg(F.ceil(F.max("day") / 365.0).alias("seasons"))

    def has_events(self) -> bool:
        return self.events.limit(1).count() > 0

    def rows(self) -> DataFrame:
        return self.events.select("iteration", "day", "amount", "id")

    def seasonality(self) -> DataFrame:
        """(year, month, share) of the total amount."""
        by = self.with_dates().groupBy("year", "month").agg(F.sum("amount").alias("amount"))
        return by.crossJoin(F.broadcast(self.events.agg(F.sum("amount").alias("total")))).select("year", "month", (F.col("amount") / F.col("total")).alias("share"))


def empty(spark: SparkSession) -> Scenario:
    """The identity of combine: no events, no iterations."""
    return Scenario(spark.createDataFrame([], EVENTS), 0, name="empty")


def sample(spark: SparkSession, n: int = 15, seed: int = 0) -> Scenario:
    """n random events over 10 iterations, a year's days and amounts from 100 to 1100."""
    whole = lambda i, most: (F.floor(F.rand(seed + i) * most) + 1).cast("int")
    e = spark.range(n).select(whole(1, 10).alias("iteration"), whole(2, 365).alias("day"), F.col("id").alias("seq"), F.xxhash64("id", F.lit(seed)).alias("id"), (F.rand(seed + 3) * 1000 + 100).alias("amount"))
    return Scenario(e, 10, name="sample")


def with_ids(events: DataFrame, seed: int = 0) -> DataFrame:
    """Ids from the row's own values, so that equal input gives equal ids."""
    return events.withColumn("id", F.xxhash64("iteration", "day", "seq", "amount", F.lit(seed)))


def combine(*scenarios: Scenario) -> Scenario:
    """The union: amounts of equal ids are summed, days count from the earliest day1, thresholds add up
    and only amounts above their sum stay. Ids must agree on iteration and day. Without events a
    scenario changes nothing."""
    full = [s for s in scenarios if s.has_events()]
    if len(full) < 2:
        return full[0] if full else scenarios[0]
    if len({s.iterations for s in full}) > 1:
        raise ValueError("scenarios differ in their iterations")
    day1, threshold = min(s.day1 for s in full), sum(s.threshold for s in full)
    parts = [s.events.select("iteration", (F.col("day") + (s.day1 - day1).days).cast("int").alias("day"), "seq", "id", "amount") for s in full]
    events = functools.reduce(DataFrame.unionByName, parts)
    both = events.groupBy("id").agg(F.min("iteration").alias("iteration"), F.max("iteration").alias("i2"), F.min("day").alias("day"), F.max("day").alias("d2"), F.min("seq").alias("seq"), F.sum("amount").alias("amount"))
    agree = (F.col("iteration") == F.col("i2")) & (F.col("day") == F.col("d2"))
    amount = F.when(agree, F.col("amount")).otherwise(F.raise_error(F.lit("events of one id differ in iteration or day")).cast("double"))
    out = both.select("iteration", "day", "seq", "id", amount.alias("amount")).where(F.col("amount") > threshold)
    return Scenario(out, full[0].iterations, threshold, day1, "concat: [" + " + ".join(s.name for s in full) + "]")
