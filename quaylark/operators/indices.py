"""Index factors per period or calendar year, and on-levelling."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PeriodIndex:
    """indices[k] brings a value from period k + 1 before now to period k before."""

    indices: tuple[float, ...]

    @staticmethod
    def from_rate_changes(percents: list[float]) -> PeriodIndex:
        return PeriodIndex(tuple(1 + p / 100 for p in percents))

    @staticmethod
    def constant(n: int, factor: float) -> PeriodIndex:
        return PeriodIndex((factor,) * n)

    def index_at(self, period: int) -> float:
        return self.indices[period]

    def factor(self, period: int) -> float:
        """The product of the first period indices; none for 0 and less, all beyond the last."""
        return math.prod(self.indices[: max(0, min(period, self.num_periods))], start=1.0)

    @property
    def num_periods(self) -> int:
        return len(self.indices)

    def factors(self, k: int) -> list[float]:
        return [self.factor(i) for i in range(k)]

    def on_level(self, df: DataFrame, value: str = "amount", period: str = "period") -> DataFrame:
        """df with on_level: value times its period's factor."""
        return df.withColumn("on_level", F.col(value) * self.factor_of(F.col(period)))

    def factor_of(self, period: Column) -> Column:
        """The factor of a column of periods, looked up in a literal of as many factors as there are periods."""
        at = F.greatest(F.lit(0), F.least(period, F.lit(self.num_periods))).cast("int")
        return F.get(F.array(*[F.lit(x) for x in self.factors(self.num_periods + 1)]), at)


@dataclass(frozen=True)
class YearIndex:
    """Years descending from the latest, with their indices."""

    years: tuple[int, ...]
    indices: tuple[float, ...]
    current_year: int

    @staticmethod
    def constant(first: int, last: int, factor: float) -> YearIndex:
        years = tuple(range(last, first - 1, -1))
        return YearIndex(years, (factor,) * len(years), last)

    @staticmethod
    def from_rate_changes(years: list[int], percents: list[float]) -> YearIndex:
        return YearIndex(tuple(years), tuple(1 + p / 100 for p in percents), max(years))

    @property
    def num_years(self) -> int:
        return len(self.years)

    @property
    def earliest(self) -> int:
        return min(self.years)

    @property
    def latest(self) -> int:
        return max(self.years)

    def _periods(self) -> PeriodIndex:
        return PeriodIndex(self.indices)

    def index_at(self, year: int) -> float:
        return dict(zip(self.years, self.indices, strict=True))[year]

    def factor(self, year: int) -> float:
        return self._periods().factor(self.current_year - year)

    def on_level(self, df: DataFrame, value: str = "amount", year: str = "year") -> DataFrame:
        return df.withColumn("on_level", F.col(value) * self._periods().factor_of(F.lit(self.current_year) - F.col(year)))

    def new_threshold(self, threshold: float) -> float:
        return threshold * self.factor(self.latest)
