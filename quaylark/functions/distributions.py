"""Count and severity distributions, and Poisson and negative-binomial trends.

Data are reduced by a grouped count before they reach the driver: as many rows as there are values.
"""

from __future__ import annotations

import bisect
import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str) -> list[tuple[int, int]]:
    """(value, count) of whole numbers, in order."""
    return [(r[0], r[1]) for r in df.groupBy(value).agg(F.count(F.lit(1)).alias("c")).orderBy(value).collect()]


class _Counts:
    def probability_of(self, k: int) -> float:
        return math.exp(self.log_probability_of(k)) if k >= 0 else 0.0

    def cdf(self, k: int) -> float:
        return min(1.0, math.fsum(self.probability_of(i) for i in range(k + 1)))

    def probability(self, x: int, y: int) -> float:
        """P(x < X <= y)."""
        return self.cdf(y) - self.cdf(x)

    def draw(self, rng: random.Random) -> int:
        u, k, done = rng.random(), 0, self.probability_of(0)
        while done < u and k < 10**7:
            k += 1
            done += self.probability_of(k)
        return k

    def goodness_of_fit(self, counts: list[tuple[int, int]], fitted: int = 1) -> tuple[float, int, float]:
        """Statistic, degrees of freedom and p of the chi-squared test on cells of five expected or more."""
        n, observed = sum(c for _, c in counts), dict(counts)
        cells, seen, due, k, left = [], 0.0, 0.0, 0, 1.0
        while left * n > 5 and k < 10**6:
            seen, due, left = seen + observed.get(k, 0), due + n * self.probability_of(k), left - self.probability_of(k)
            if due >= 5:
                cells.append((seen, due))
                seen = due = 0.0
            k += 1
        cells.append((n - sum(s for s, _ in cells), n - sum(d for _, d in cells)))
        statistic = sum((s - d) ** 2 / d for s, d in cells if d > 0)
        df = max(len(cells) - 1 - fitted, 1)
        return statistic, df, upper_gamma(df / 2, statistic / 2)


@dataclass(frozen=True)
class Poisson(_Counts):
    rate: float

    @property
    def mean(self) -> float:
        return self.rate

    @property
    def variance(self) -> float:
        return self.rate

    def log_probability_of(self, k: int) -> float:
        return k * math.log(self.rate) - self.rate - math.lgamma(k + 1) if k >= 0 else -math.inf

    @staticmethod
    def mle(counts: list[tuple[int, int]]) -> tuple[Poisson, bool]:
        return Poisson(sum(k * c for k, c in counts) / sum(c for _, c in counts)), True

    @staticmethod
    def volume_weighted_mle(pairs: list[tuple[float, float]]) -> Poisson:
        return Poisson(sum(n for n, _ in pairs) / sum(v for _, v in pairs))


@dataclass(frozen=True)
class NegativeBinomial(_Counts):
    """Mean a b, variance a b (1 + b)."""

    a: float
    b: float

    @property
    def mean(self) -> float:
        return self.a * self.b

    @property
    def variance(self) -> float:
        return self.a * self.b * (1 + self.b)

    def log_probability_of(self, k: int) -> float:
        if k < 0:
            return -math.inf
        if self.b < 1e-9:
            return Poisson(self.mean).log_probability_of(k)
        return math.lgamma(self.a + k) - math.lgamma(self.a) - math.lgamma(k + 1) + k * math.log(self.b / (1 + self.b)) - self.a * math.log1p(self.b)

    @staticmethod
    def mle(counts: list[tuple[int, int]], rounds: int = 500, tolerance: float = 1e-10) -> tuple[NegativeBinomial | Poisson, bool]:
        """By golden section on log a, with b = mean / a; a Poisson where the variance isn't above the mean."""
        n = sum(c for _, c in counts)
        m = sum(k * c for k, c in counts) / n
        v = sum(c * (k - m) ** 2 for k, c in counts) / max(n - 1, 1)
        if v <= m:
            return Poisson(m), True

        def fit(log_a: float) -> float:
            d = NegativeBinomial(math.exp(log_a), m / math.exp(log_a))
            return -sum(c * d.log_probability_of(k) for k, c in counts)

        lo, hi, g = -12.0, 18.0, (math.sqrt(5) - 1) / 2
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        fx, fy = fit(x), fit(y)
        for _ in range(rounds):
            if hi - lo < tolerance:
                break
            if fx < fy:
                hi, y, fy = y, x, fx
                x = hi - g * (hi - lo)
                fx = fit(x)
            else:
                lo, x, fx = x, y, fy
                y = lo + g * (hi - lo)
                fy = fit(y)
        a = math.exp((lo + hi) / 2)
        return NegativeBinomial(a, m / a), hi - lo < max(tolerance, 1e-8)


    @staticmethod
    def volume_weighted_mle(rows: list[tuple[int, float, int]], rounds: int = 200, tolerance: float = 1e-8) -> tuple[NegativeBinomial | Poisson, bool]:
        """The fit to (count, volume, how often): a count of volume v has parameters a and b v. For each a the b
        that solves the likelihood's equation; a by golden section. A Poisson where counts aren't overdispersed."""
        k, v, c = (np.array(x, float) for x in zip(*rows, strict=True))
        rate = float((k * c).sum() / (v * c).sum())
        if (c * ((k - rate * v) ** 2 - k)).sum() <= 0:
            return Poisson(rate), True
        values, place = np.unique(k, return_inverse=True)

        def scale(a: float) -> float:
            lo, hi = rate / a * 1e-3, rate / a * 1e3
            for _ in range(100):
                b = math.sqrt(lo * hi)
                lo, hi = (b, hi) if (c * (k / b - (a + k) * v / (1 + b * v))).sum() > 0 else (lo, b)
            return b

        def fit(log_a: float) -> float:
            a = math.exp(log_a)
            b = scale(a)
            rising = np.array([math.lgamma(a + x) - math.lgamma(a) for x in values])
            return -float((c * (rising[place] + k * np.log(b * v / (1 + b * v)) - a * np.log1p(b * v))).sum())

        lo, hi, g = -12.0, 18.0, (math.sqrt(5) - 1) / 2
        for _ in range(rounds):
            if hi - lo < tolerance:
                break
            x, y = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, y) if fit(x) < fit(y) else (x, hi)
        a = math.exp((lo + hi) / 2)
        return NegativeBinomial(a, scale(a)), hi - lo < max(tolerance, 1e-6)


@dataclass(frozen=True)
class Pareto:
    scale: float
    shape: float

    def cdf(self, x: float) -> float:
        return 0.0 if x < self.scale else 1 - (self.scale / x) ** self.shape

    def inverse_cdf(self, p: float) -> float:
        return self.scale * (1 - p) ** (-1 / self.shape) if p < 1 else math.inf

    @property
    def mean(self) -> float:
        return self.shape * self.scale / (self.shape - 1) if self.shape > 1 else math.inf

    @property
    def second_moment(self) -> float:
        return self.shape * self.scale**2 / (self.shape - 2) if self.shape > 2 else math.inf


class Empirical:
    """Weighted points; equal values are one."""

    def __init__(self, values: list[float], weights: list[float] | None = None):
        weights = [1.0] * len(values) if weights is None else weights
        if not values or len(values) != len(weights) or any(not w > 0 for w in weights) or any(math.isnan(v) for v in values):
            raise ValueError("values must be some, without NaN, with positive weights")
        by: dict[float, float] = {}
        for v, w in zip(values, weights, strict=True):
            by[v] = by.get(v, 0.0) + w
        self.points = sorted(by)
        self.total = math.fsum(by.values())
        self.weights = [by[x] for x in self.points]
        self.up = np.cumsum(self.weights).tolist()

    @staticmethod
    def of(df: DataFrame, value: str, weight: str | None = None) -> Empirical:
        rows = df.groupBy(value).agg(F.sum(weight if weight else F.lit(1.0)).alias("w")).collect()
        return Empirical([r[0] for r in rows], [r[1] for r in rows])

    def cdf(self, x: float) -> float:
        i = bisect.bisect_right(self.points, x)
        return self.up[i - 1] / self.total if i else 0.0

    def inverse_cdf(self, p: float) -> float:
        """The least point with a cdf of p or more."""
        i = bisect.bisect_left(self.up, p * self.total * (1 - 1e-15))
        return self.points[min(i, len(self.points) - 1)]

    def probability_of(self, x: float) -> float:
        i = bisect.bisect_left(self.points, x)
        return self.weights[i] / self.total if i < len(self.points) and self.points[i] == x else 0.0

    def probability(self, x: float, y: float) -> float:
        return self.cdf(y) - self.cdf(x)

    @property
    def mean(self) -> float:
        return sum(x * w for x, w in zip(self.points, self.weights, strict=True)) / self.total

    @property
    def variance(self) -> float:
        m = self.mean
        return sum(w * (x - m) ** 2 for x, w in zip(self.points, self.weights, strict=True)) / self.total

    def draw(self, rng: random.Random) -> float:
        return self.inverse_cdf(rng.random())


class Mixed:
    """Empirical below the mixing point, Pareto from there on."""

    def __init__(self, values: list[float], mixing_point: float, shape: float, weights: list[float] | None = None):
        if not mixing_point > 0 or not shape > 0:
            raise ValueError("mixing point and shape must be positive")
        self.empirical, self.at, self.tail = Empirical(values, weights), mixing_point, Pareto(mixing_point, shape)
        below = [w for x, w in zip(self.empirical.points, self.empirical.weights, strict=True) if x < mixing_point]
        self.body = math.fsum(below) / self.empirical.total

    def cdf(self, x: float) -> float:
        return self.empirical.cdf(x) if x < self.at else self.body + (1 - self.body) * self.tail.cdf(x)

    def inverse_cdf(self, p: float) -> float:
        if p <= self.body:
            return self.empirical.inverse_cdf(p)
        return self.tail.inverse_cdf((p - self.body) / (1 - self.body))

    def probability(self, x: float, y: float) -> float:
        return self.cdf(y) - self.cdf(x)

    def _moment(self, k: int, tail: float) -> float:
        e = self.empirical
        return sum(x**k * w for x, w in zip(e.points, e.weights, strict=True) if x < self.at) / e.total + (1 - self.body) * tail

    @property
    def mean(self) -> float:
        return self._moment(1, self.tail.mean)

    @property
    def variance(self) -> float:
        return self._moment(2, self.tail.second_moment) - self.mean**2

    def draw(self, rng: random.Random) -> float:
        return self.inverse_cdf(rng.random())


def upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_ratio(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_ratio(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + n * d), 1 + n / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_ratio(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


@dataclass(frozen=True)
class Trend:
    """log mean = intercept + slope * year."""

    intercept: float
    slope: float
    se_intercept: float
    se_slope: float
    p_intercept: float
    p_slope: float
    null_deviance: float
    deviance: float
    dispersion: float
    f: float
    f_p: float
    log_likelihood: float
    aic: float
    df: int
    #: Of the intercept at the centre year and the slope: centre, variance, covariance, variance.
    centred: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)

    def significant(self, alpha: float = 0.05) -> bool:
        return self.p_slope < alpha

    def summary(self) -> str:
        stars = lambda p: next((s for at, s in ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, ".")) if p < at), "")
        rows = [(k, b, s, b / s, p) for k, b, s, p in (("intercept", self.intercept, self.se_intercept, self.p_intercept), ("year", self.slope, self.se_slope, self.p_slope))]
        lines = [f"{'':10} {'estimate':>12} {'std error':>10} {'z':>8} {'p':>8}"] + [f"{k:10} {b:12.5f} {s:10.5f} {z:8.3f} {p:8.4f} {stars(p)}" for k, b, s, z, p in rows]
        return "\n".join([*lines, f"null deviance {self.null_deviance:.3f}, deviance {self.deviance:.3f} on {self.df} degrees of freedom", f"AIC {self.aic:.3f}, F {self.f:.4f} (p {self.f_p:.4f})"])


def fit_trend(years: list[int], counts: list[int], theta: float | None = None, rounds: int = 25) -> Trend:
    """Poisson, or negative binomial of size theta, by iterated weighted least squares."""
    if len(years) != len(counts) or len(years) < 3:
        raise ValueError("three years or more are needed, with a count each")
    y, n = np.array(counts, float), len(years)
    centre = float(np.mean(years))
    x = np.column_stack((np.ones(n), np.array(years, float) - centre))
    beta = np.array([math.log(max(y.mean(), 0.1)), 0.0])
    spread = lambda mu: mu if theta is None else mu + mu * mu / theta

    def deviance(mu: np.ndarray) -> float:
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(y > 0, y * np.log(y / mu), 0.0)
        if theta is None:
            return 2 * float((own - (y - mu)).sum())
        return 2 * float((own - (y + theta) * np.log((y + theta) / (mu + theta))).sum())

    for _ in range(rounds):
        mu = np.exp(x @ beta)
        w = mu * mu / spread(mu)
        beta = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ (x @ beta + (y - mu) / mu))
    mu = np.exp(x @ beta)
    w = mu * mu / spread(mu)
    back = np.array([[1.0, -centre], [0.0, 1.0]])
    own_cov = np.linalg.inv((x * w[:, None]).T @ x)
    cov = back @ own_cov @ back.T
    beta = back @ beta
    se = np.sqrt(np.diag(cov))
    null, own = deviance(np.full(n, y.mean())), deviance(mu)
    dispersion = float(((y - mu) ** 2 / spread(mu)).sum()) / (n - 2)
    f = (null - own) / (1.0 if theta is None else dispersion)
    d = [Poisson(m) if theta is None else NegativeBinomial(theta, m / theta) for m in mu]
    ll = math.fsum(a.log_probability_of(int(k)) for a, k in zip(d, counts, strict=True))
    p = [normal_p(b / s) for b, s in zip(beta, se, strict=True)]
    return Trend(float(beta[0]), float(beta[1]), float(se[0]), float(se[1]), p[0], p[1], null, own, dispersion, f, f_p(f, 1, n - 2), ll, 4 - 2 * ll, n - 2, (centre, float(own_cov[0, 0]), float(own_cov[0, 1]), float(own_cov[1, 1])))
