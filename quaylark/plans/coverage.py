"""Further registered queries, each with its SQL: what the catalog's first part leaves out."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.functions import layers as lf
from quaylark.functions.distributions import NegativeBinomial, Pareto, Poisson, histogram
from quaylark.operators import indices, linalg, network, plots, tail
from quaylark.operators import matrices as mx
from quaylark.operators import scenario as sc
from quaylark.operators import vectors as v
from quaylark.operators.tower import Layer, Tower
from quaylark.operators.tower import loss_report as report
from quaylark.operators.tower import split
from quaylark.plans import catalog as c
from quaylark.plans.catalog import CUBE, GRID, ROWS, L, N
from quaylark.plans.registry import query
from quaylark.sources import delimited
from quaylark.sources.tables import load, losses

SINGLE = Tower.single_shot(100_000, [100_000, 200_000])
SCALED = Tower.from_retention(100_000, [100_000, 100_000]).scaled(1.25)
CAPPED = Tower((Layer(occ_limit=100_000, occ_retention=50_000, agg_limit=400_000, share=0.5),))


def rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({x: F.round(x, places) + 0.0 for x in names})


# ---- towers and layers


@query("tower_single_shot", c._split_sql(SINGLE, c._split_tail(SINGLE)))
def tower_single_shot(spark: SparkSession, d: str) -> DataFrame:
    return c._split_rows(losses(spark, d), SINGLE)


@query("tower_scaled", c._split_sql(SCALED, c._split_tail(SCALED)))
def tower_scaled(spark: SparkSession, d: str) -> DataFrame:
    return c._split_rows(losses(spark, d), SCALED)


def _over(tower: Tower, over: float) -> str:
    x = tower.layers[0]
    return f", {GRID}, t AS (SELECT g.iteration, coalesce(sum(ceded_0), 0) AS t0 FROM g LEFT JOIN s ON g.iteration = s.iteration GROUP BY g.iteration) SELECT 0 AS layer, '{x.auto_name}' AS name, {over}::DOUBLE AS \"limit\", round(avg(t0) / {over}, 8) AS el, round(stddev_pop(t0) / {over}, 8) AS std_dev, count(*) FILTER (t0 > 0) / {N}.0::DOUBLE AS attach_prob, count(*) FILTER (t0 > {x.agg_limit} - 0.01) / {N}.0::DOUBLE AS exhaust_prob FROM t"


@query("loss_report_agg_limit", c._split_sql(CAPPED, _over(CAPPED, 400_000)))
def loss_report_agg_limit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report(split(losses(spark, d), CAPPED), CAPPED, N, "agg_limit"), 8, "el", "std_dev")


@query("loss_report_custom", c._split_sql(CAPPED, _over(CAPPED, 12345)))
def loss_report_custom(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report(split(losses(spark, d), CAPPED), CAPPED, N, 12345.0), 8, "el", "std_dev")


@query("layer_caps", "SELECT * FROM (VALUES (0, 150000.0::DOUBLE, 100000.0::DOUBLE, '100000 xs 50000', 400000.0::DOUBLE), (1, 125000.0::DOUBLE, 125000.0::DOUBLE, '125000 xs 0', NULL), (2, 'inf'::DOUBLE, 'inf'::DOUBLE, 'Unlimited Layer', NULL)) t(layer, cap, first_limit, name, agg_limit)")
def layer_caps(spark: SparkSession, d: str) -> DataFrame:
    """Caps, first limits, names and aggregate sublayers of a few layers."""
    some = [CAPPED.layers[0], Layer(occ_limit=125_000.0, occ_type="franchise"), Layer()]
    rows = [(i, float(x.cap), float(x.first_limit), x.auto_name, None if x.agg_layer.limit is None else float(x.agg_layer.limit)) for i, x in enumerate(some)]
    return spark.createDataFrame(rows, "layer int, cap double, first_limit double, name string, agg_limit double")


@query("matrix_reinsurance", f'WITH {ROWS} SELECT vec_id AS "row", idx AS col, round(least(greatest(value * 100 - 1.5, 0), 8) * 0.5, 8) AS ceded, CASE WHEN value * 100 < 1.5 THEN 0.0 ELSE least(value * 100, 9.5) END AS franchised FROM w')
def matrix_reinsurance(spark: SparkSession, d: str) -> DataFrame:
    m = mx.mapped(mx.from_arrays(load(spark, d, "embeddings"), "embedding", "vec_id"), lambda x: x * 100)
    a = mx.mapped(m, lambda x: lf.reinsurance(x, 8.0, 1.5, 0.5)).withColumnRenamed("value", "ceded")
    b = mx.mapped(m, lambda x: lf.franchise(x, 8.0, 1.5)).withColumnRenamed("value", "franchised")
    return rounded(a.join(b, ["mat_id", "row", "col"]).select("row", "col", "ceded", "franchised"), 8, "ceded")


# ---- scenarios


@query("events_sorted", f"WITH {L}, o AS (SELECT iteration, day, seq, row_number() OVER (ORDER BY iteration, day, seq) AS place FROM l) SELECT iteration, day, seq, place FROM o WHERE place <= 500")
def events_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The first 500 of the sorted events, with their places."""
    from pyspark.sql.window import Window

    first = c._scenario(spark, d).ordered().limit(500)
    return first.select("iteration", "day", "seq", F.row_number().over(Window.orderBy("iteration", "day", "seq")).cast("long").alias("place"))


@query("has_events", f"WITH {L} SELECT count(*) FILTER (iteration = 7) > 0 AS seventh, count(*) FILTER (amount > 1e12) > 0 AS huge FROM l")
def has_events(spark: SparkSession, d: str) -> DataFrame:
    s = c._scenario(spark, d)
    return spark.createDataFrame([(s.iteration(7).has_events(), s.above(1e12).has_events())], "seventh boolean, huge boolean")


@query("generated_ids", f"WITH {L} SELECT iteration, count(*) AS n, count(DISTINCT seq) AS ids FROM l GROUP BY iteration")
def generated_ids(spark: SparkSession, d: str) -> DataFrame:
    """New ids are as many as the events, and alike on each run."""
    e = losses(spark, d)
    a, b = sc.with_ids(e, 3), sc.with_ids(e.repartition(3), 3).select("seq", F.col("id").alias("again"))
    return a.join(b, "seq").where("id = again").groupBy("iteration").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("sample_scenario", "SELECT 1000::BIGINT AS n, 1 AS low, 10 AS high, true AS days, true AS amounts, 1000::BIGINT AS ids")
def sample_scenario(spark: SparkSession, d: str) -> DataFrame:
    e = sc.sample(spark, 1000, 7).events
    return e.agg(F.count(F.lit(1)).alias("n"), F.min("iteration").alias("low"), F.max("iteration").alias("high"), ((F.min("day") >= 1) & (F.max("day") <= 365)).alias("days"), ((F.min("amount") >= 100) & (F.max("amount") < 1100)).alias("amounts"), F.countDistinct("id").alias("ids"))


@query("combine_with_empty", f"WITH {L} SELECT count(*) AS n, round(sum(amount), 2) AS total FROM l")
def combine_with_empty(spark: SparkSession, d: str) -> DataFrame:
    s = sc.combine(sc.empty(spark), c._scenario(spark, d), sc.empty(spark))
    return s.events.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@query("combine_associates", f"WITH {L}, u AS (SELECT * FROM l UNION ALL SELECT iteration, day, seq, id, amount * 0.5 FROM l UNION ALL SELECT iteration, day, seq, id, amount * 0.25 FROM l WHERE iteration <= 10) SELECT id, round(sum(amount), 4) AS one, round(sum(amount), 4) AS other FROM u GROUP BY id")
def combine_associates(spark: SparkSession, d: str) -> DataFrame:
    """(x + y) + z beside z + (y + x)."""
    x = c._scenario(spark, d)
    y, z = x.scaled(0.5), sc.Scenario(x.events.where("iteration <= 10").withColumn("amount", F.col("amount") * 0.25), x.iterations)
    one, other = sc.combine(sc.combine(x, y), z).events, sc.combine(z, sc.combine(y, x)).events
    return one.select("id", F.round("amount", 4).alias("one")).join(other.select("id", F.round("amount", 4).alias("other")), "id")


@query("attach_and_exhaust", c._split_sql(c.ONE, f", {GRID}, t AS (SELECT g.iteration, " + ", ".join(f"coalesce(sum(ceded_{k}), 0) AS t{k}" for k in range(2)) + " FROM g LEFT JOIN s ON g.iteration = s.iteration GROUP BY g.iteration) " + " UNION ALL ".join(f"SELECT {k} AS layer, count(*) FILTER (t{k} > 0) / 100.0::DOUBLE AS attach_prob, count(*) FILTER (t{k} > 200000 - 0.01) / 100.0::DOUBLE AS exhaust_prob FROM t" for k in range(2))))
def attach_and_exhaust(spark: SparkSession, d: str) -> DataFrame:
    from quaylark.operators.tower import attachment_probability, exhaustion_probability

    r = report(split(losses(spark, d), c.ONE), c.ONE, N)
    return attachment_probability(r).join(exhaustion_probability(r), "layer")


# ---- indices


@query("index_factors", "SELECT * FROM (VALUES (0, 1.0::DOUBLE, 1.05::DOUBLE, 1.0::DOUBLE), (1, 1.05, 1.03, 1.02), (2, 1.0815, 1.02, 1.0404), (3, 1.10313, 1.04, 1.061208), (4, 1.1472552, NULL, 1.061208)) t(period, factor, idx, constant)")
def index_factors(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative factors and indices of one made from rate changes, and of a constant one of three periods."""
    p, same = indices.PeriodIndex.from_rate_changes([5, 3, 2, 4]), indices.PeriodIndex.constant(3, 1.02)
    rows = [(i, f, p.index_at(i) if i < p.num_periods else None, same.factor(i)) for i, f in enumerate(p.factors(5))]
    return rounded(spark.createDataFrame(rows, "period int, factor double, idx double, constant double"), 10, "factor", "idx", "constant")


@query("year_index", "SELECT * FROM (VALUES (2024, 1.05::DOUBLE, 1.0::DOUBLE, 1050.0::DOUBLE), (2023, 1.03, 1.05, 1050.0), (2022, 1.02, 1.0815, 1050.0)) t(year, idx, factor, threshold)")
def year_index(spark: SparkSession, d: str) -> DataFrame:
    """Indices and factors by calendar year, and the threshold brought from the latest year to 2025."""
    y = indices.YearIndex.from_rate_changes([2024, 2023, 2022], [5, 3, 2])
    later = indices.YearIndex(y.years, y.indices, 2025)
    rows = [(x, y.index_at(x), y.factor(x), later.new_threshold(1000.0)) for x in range(y.earliest, y.earliest + y.num_years)]
    return rounded(spark.createDataFrame(rows, "year int, idx double, factor double, threshold double"), 10, "idx", "factor", "threshold")


@query("plot_index", "SELECT * FROM (VALUES (2024, 1.05::DOUBLE, 1.0::DOUBLE, 1000.0::DOUBLE), (2023, 1.03, round(1 / 1.05, 8), round(1000 / 1.05, 8)), (2022, 1.02, round(1 / 1.0815, 8), round(1000 / 1.0815, 8))) t(year, idx, relative, threshold)")
def plot_index(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plots.index_rows(spark, indices.YearIndex((2024, 2023, 2022), (1.05, 1.03, 1.02), 2024), 1000.0), 8, "idx", "relative", "threshold")


# ---- tails


def _stable(kind: str, x: str, window: int, bound: float, positive: bool) -> str:
    s = f"s AS (SELECT k, max(k) OVER w AS k_end, count(*) FILTER (isfinite({x})) OVER w AS c, avg({x}) OVER w AS mean, stddev_pop({x}) OVER w AS sd FROM {kind} WINDOW w AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)), b AS (SELECT * FROM s WHERE c = {window} AND mean <> 0 AND sd / abs(mean) < {bound} ORDER BY sd / abs(mean), k LIMIT 1)"
    return s + (" SELECT k AS k_start, k_end, round(mean, 6) AS gamma, round(1 / mean, 6) AS alpha FROM b WHERE mean > 0" if positive else " SELECT k AS k_start, k_end, round(mean, 6) AS mean FROM b")


@query("hill_stable_region", f"WITH {L}, {c._TOP}, h AS (SELECT k, sum(ln(x)) OVER (ORDER BY k) AS logs, lead(x) OVER (ORDER BY k) AS nx FROM t), p AS (SELECT k::INTEGER AS k, k / (logs - k * ln(nx)) AS estimate FROM h WHERE k BETWEEN 2 AND 100), " + _stable("p", "estimate", 10, 0.1, False))
def hill_stable_region(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tail.stable_region(tail.hill_plot(losses(spark, d), "amount", "id", 2, 100)), 6, "mean")


@query("pickands_stable_region", f"WITH {L}, {c._TOP}, q AS (SELECT a.k, a.x - b.x AS u, b.x - c.x AS v FROM t a JOIN t b ON b.k = 2 * a.k JOIN t c ON c.k = 4 * a.k WHERE a.k <= 100), p AS (SELECT k::INTEGER AS k, CASE WHEN u > 0 AND v > 0 THEN log2(u / v) ELSE 'nan'::DOUBLE END AS gamma FROM q), " + _stable("p", "gamma", 5, 0.5, True))
def pickands_stable_region(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tail.pickands_stable_region(tail.pickands_plot(losses(spark, d), "amount", "id", 1, 100), 5, 0.5), 6, "gamma", "alpha")


@query("log_log_survival", f"WITH {L}, r AS (SELECT amount AS x, row_number() OVER (ORDER BY amount, id) AS rank, count(*) OVER () AS n FROM l) SELECT x, (n - rank + 0.5) / n AS survival FROM r")
def log_log_survival(spark: SparkSession, d: str) -> DataFrame:
    return plots.log_log_survival(losses(spark, d), "amount", "id")


@query("model_survival", "WITH p AS (SELECT range::INTEGER AS i, exp(ln(2.0) + range * (ln(50.0) - ln(2.0)) / 199) AS x FROM range(200)) SELECT round(x, 8) AS x, round(pow(2.0 / x, 1.5), 8) AS survival FROM p")
def model_survival(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plots.model_survival(spark, Pareto(2.0, 1.5), 2.0, 50.0), 8, "x", "survival")


# ---- distributions

_FIT = f"{GRID}, e AS (SELECT g.iteration, count(l.seq) AS events FROM g LEFT JOIN l ON g.iteration = l.iteration GROUP BY g.iteration), m AS (SELECT avg(events) AS m, max(events) AS top FROM e)"
_MASS = "p AS (SELECT k::INTEGER AS k, exp(k * ln(m) - m - lgamma(k + 1)) AS p, coalesce(n, 0) AS observed FROM m, LATERAL (SELECT unnest(range(0, {top} + 1)) AS k) LEFT JOIN (SELECT events, count(*) AS n FROM e GROUP BY events) ON events = k)"


def _near(top: str) -> str:
    return f"WITH {L}, {_FIT}, " + _MASS.format(top=top)


def _poisson(spark: SparkSession, d: str) -> tuple[DataFrame, Poisson]:
    counts = c._counts(spark, d)
    return counts, Poisson.mle(histogram(counts, "events"))[0]


_THREE, _FOUR = "ceil(m + 3 * sqrt(m))::BIGINT", "greatest(ceil(m + 4 * sqrt(m)), top)::BIGINT"


@query("rootogram", _near(_THREE) + " SELECT k, round(sqrt(p * 100), 6) AS expected, round(sqrt(observed), 6) AS observed, round(sqrt(p * 100) - sqrt(observed), 6) + 0.0 AS hanging FROM p")
def rootogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plots.rootogram(_poisson(spark, d)[0], "events", _poisson(spark, d)[1]), 6, "expected", "observed", "hanging")


@query("ecdf_vs_cdf", _near(_FOUR) + " SELECT k, round(sum(observed) OVER (ORDER BY k) / 100.0, 6)::DOUBLE AS ecdf, round(sum(p) OVER (ORDER BY k), 6) AS cdf FROM p")
def ecdf_vs_cdf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plots.ecdf_vs_cdf(_poisson(spark, d)[0], "events", _poisson(spark, d)[1]), 6, "ecdf", "cdf")


@query("pearson_residuals", _near(_THREE) + " SELECT k, round((observed - p * 100) / sqrt(p * 100), 6) + 0.0 AS residual FROM p WHERE p * 100 > 0.001")
def pearson_residuals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(plots.pearson_residuals(_poisson(spark, d)[0], "events", _poisson(spark, d)[1]), 6, "residual")


@query("negative_binomial", "SELECT k::INTEGER AS k, round(exp(lgamma(2.5 + k) - lgamma(2.5) - lgamma(k + 1) + k * ln(0.8 / 1.8) - 2.5 * ln(1.8)), 9) AS p, round(sum(exp(lgamma(2.5 + k) - lgamma(2.5) - lgamma(k + 1) + k * ln(0.8 / 1.8) - 2.5 * ln(1.8))) OVER (ORDER BY k), 9) AS cdf FROM (SELECT unnest(range(0, 30)) AS k)")
def negative_binomial(spark: SparkSession, d: str) -> DataFrame:
    n = NegativeBinomial(2.5, 0.8)
    return rounded(spark.createDataFrame([(k, n.probability_of(k), n.cdf(k)) for k in range(30)], "k int, p double, cdf double"), 9, "p", "cdf")


@query("pareto", "SELECT round(x, 6)::DOUBLE AS x, CASE WHEN x < 3 THEN 0.0 ELSE round(1 - pow(3 / x, 2.5), 9) END AS cdf FROM (SELECT 1 + range * 0.5 AS x FROM range(40))")
def pareto(spark: SparkSession, d: str) -> DataFrame:
    p = Pareto(3.0, 2.5)
    return rounded(spark.createDataFrame([(1 + i * 0.5, p.cdf(1 + i * 0.5)) for i in range(40)], "x double, cdf double"), 9, "x", "cdf")


@query("poisson_volume_weighted", "SELECT round(sum(n)::DOUBLE / sum(v), 9) AS rate FROM (SELECT count(*) AS n, sum(o_totalprice) / 1e6 AS v FROM orders GROUP BY year(o_orderdate))")
def poisson_volume_weighted(spark: SparkSession, d: str) -> DataFrame:
    by = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), (F.sum("o_totalprice") / 1e6).alias("v")).collect()
    return rounded(spark.createDataFrame([(Poisson.volume_weighted_mle([(r["n"], r["v"]) for r in by]).rate,)], "rate double"), 9, "rate")


# ---- vectors, matrices, arrays

_UNARY = {"abs": "abs(x)", "acos": "acos(x)", "asin": "asin(x)", "atan": "atan(x)", "cbrt": "cbrt(x)", "cos": "cos(x)", "cosh": "(exp(x) + exp(-x)) / 2", "exp": "exp(x)", "expm1": "exp(x) - 1", "log": "ln(y)", "log10": "log10(y)", "log1p": "ln(1 + y)", "sqrt": "sqrt(y)", "sin": "sin(x)", "sinh": "(exp(x) - exp(-x)) / 2", "tan": "tan(x)", "tanh": "(exp(x) - exp(-x)) / (exp(x) + exp(-x))", "neg": "-x", "sigmoid": "1 / (1 + exp(-x))"}
_POSITIVE = {"log", "log10", "log1p", "sqrt"}


@query("unary_maths", f"WITH {ROWS}, z AS (SELECT vec_id, value / 2 AS x, abs(value) + 0.25 AS y FROM w) SELECT vec_id, " + ", ".join(f"round(sum({f}), 6) + 0.0 AS f_{k}" for k, f in _UNARY.items()) + " FROM z GROUP BY vec_id")
def unary_maths(spark: SparkSession, d: str) -> DataFrame:
    """The sum over each vector of every unary function, at x / 2 or, for those of positive numbers, |x| + 1/4."""
    half = F.transform("a", lambda x: x / 2)
    above = F.transform("a", lambda x: F.abs(x) + 0.25)
    total = lambda k: F.round(v.total(v.each(above if k in _POSITIVE else half, k)), 6) + 0.0
    return c._arrays(spark, d).select("vec_id", *[total(k).alias(f"f_{k}") for k in _UNARY])


@query("reductions_of_arrays", f"WITH {ROWS}, z AS (SELECT vec_id, idx, value FROM w) SELECT vec_id, round(product(1 + value / 10), 6) AS product, round(ln(sum(exp(value))), 6) AS log_sum_exp, round(var_samp(value), 8) AS variance, arg_max(idx, value)::INTEGER AS largest, arg_min(idx, value)::INTEGER AS smallest, round(sum(value * value), 6) AS squares, min(value) AS low, max(value) AS high FROM z GROUP BY vec_id")
def reductions_of_arrays(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    r = lambda x, n, k: F.round(x, k).alias(n)
    return c._arrays(spark, d).select("vec_id", r(v.product(F.transform(a, lambda x: 1 + x / 10)), "product", 6), r(v.log_sum_exp(a), "log_sum_exp", 6), r(v.variance(a, True), "variance", 8), v.argmax(a).alias("largest"), v.argmin(a).alias("smallest"), r(v.dot(a, a), "squares", 6), F.array_min(a).alias("low"), F.array_max(a).alias("high"))


@query("array_masks", f"WITH {ROWS} SELECT vec_id, idx, CASE WHEN value > 0 THEN value ELSE -value END AS chosen, CASE WHEN value > 0 THEN 0.0 ELSE value END AS zeroed, NOT value > 0 AS negated, value > -0.1 AND value < 0.1 AS both FROM w")
def array_masks(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    up = v.compared(a, ">", 0.0)
    both = v.both(v.compared(a, ">", -0.1), v.compared(a, "<", 0.1))
    z = F.arrays_zip(v.where(up, a, F.transform(a, lambda x: -x)).alias("chosen"), v.zero_where(a, up).alias("zeroed"), v.negated(up).alias("negated"), both.alias("both"))
    return c._arrays(spark, d).select("vec_id", F.posexplode(z).alias("idx", "z")).select("vec_id", "idx", "z.*")


@query("masked_values", f"WITH {ROWS} SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY idx) - 1)::INTEGER AS place, value FROM w WHERE value >= 0.05")
def masked_values(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return c._arrays(spark, d).select("vec_id", F.posexplode(v.masked(a, v.compared(a, ">=", 0.05))).alias("place", "value"))


@query("product_except_self", f"WITH {ROWS}, z AS (SELECT vec_id, idx, round(value * 4) AS x FROM w WHERE idx < 6), s AS (SELECT a.vec_id, a.idx, product(b.x) AS others FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.idx <> b.idx GROUP BY 1, 2) SELECT vec_id, idx, round(others, 6) + 0.0 AS others FROM s")
def product_except_self(spark: SparkSession, d: str) -> DataFrame:
    z = c._rows(spark, d).where("idx < 6").withColumn("value", F.round(F.col("value") * 4))
    return rounded(v.product_except_self(z).select("vec_id", "idx", "others"), 6, "others")


@query("outer_trace", f"WITH {ROWS} SELECT vec_id, round(sum(value * value), 6) AS trace, count(*) AS n FROM w GROUP BY vec_id")
def outer_trace(spark: SparkSession, d: str) -> DataFrame:
    a = c._arrays(spark, d).select("vec_id", v.outer(F.col("a"), F.col("a")).alias("o"))
    t = F.aggregate(F.transform("o", lambda r, i: F.get(r, i)), F.lit(0.0), lambda s, x: s + x)
    return a.select("vec_id", F.round(t, 6).alias("trace"), F.size("o").cast("long").alias("n"))


@query("linspace", "SELECT range::INTEGER AS idx, round(1 + range * 0.25, 9)::DOUBLE AS value FROM range(13)")
def linspace(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spark.range(1).select(F.posexplode(v.linspace(1.0, 4.0, 13)).alias("idx", "value")), 9, "value")


def _blocks(spark: SparkSession, d: str, n: int) -> DataFrame:
    r = c._rows(spark, d).where(F.col("idx") < n * n)
    return r.select(F.col("vec_id").alias("mat_id"), F.floor(F.col("idx") / n).cast("int").alias("row"), (F.col("idx") % n).cast("int").alias("col"), "value")


_TWO = f"WITH {ROWS}, m AS (SELECT vec_id, max(value) FILTER (idx = 0) + 2 AS a, max(value) FILTER (idx = 1) AS b, max(value) FILTER (idx = 2) AS c, max(value) FILTER (idx = 3) + 2 AS d FROM w WHERE idx < 4 GROUP BY vec_id), x AS (SELECT *, a * d - b * c AS t FROM m) "


def _two(spark: SparkSession, d: str) -> DataFrame:
    """Well-conditioned 2 x 2 matrices of the vectors' first values."""
    return _blocks(spark, d, 2).withColumn("value", F.col("value") + F.when(F.col("row") == F.col("col"), 2.0).otherwise(0.0))


def _cells(*values: str) -> str:
    return _TWO + " UNION ALL ".join(f'SELECT vec_id AS mat_id, {i // 2} AS "row", {i % 2} AS col, round({x}, 8) + 0.0 AS value FROM x' for i, x in enumerate(values))


@query("matrix_inverse", _cells("d / t", "-b / t", "-c / t", "a / t"))
def matrix_inverse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linalg.by_matrix(_two(spark, d), "inv"), 8, "value")


@query("matrix_adjugate", _cells("d", "-b", "-c", "a"))
def matrix_adjugate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linalg.by_matrix(_two(spark, d), "adj"), 8, "value")


@query("matrix_pinv", _cells("d / t", "-b / t", "-c / t", "a / t"))
def matrix_pinv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linalg.by_matrix(_two(spark, d), "pinv"), 8, "value")


@query("matrix_lu", _cells("a", "b", "c / a", "d - c / a * b"))
def matrix_lu(spark: SparkSession, d: str) -> DataFrame:
    """L and U in one; these matrices need no swaps."""
    return rounded(linalg.by_matrix(_two(spark, d), "lu"), 8, "value")


@query("determinants", _TWO + "SELECT vec_id AS mat_id, round(t, 8) AS value FROM x")
def determinants(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linalg.by_matrix(_two(spark, d), "det").select("mat_id", "value"), 8, "value")


@query("matrix_rank", _TWO + "SELECT vec_id AS mat_id, 2.0::DOUBLE AS value FROM x")
def matrix_rank(spark: SparkSession, d: str) -> DataFrame:
    return linalg.by_matrix(_two(spark, d), "rank").select("mat_id", "value")


@query("solve", _TWO + "SELECT vec_id AS mat_id, 0 AS idx, round((d - 2 * b) / t, 8) AS value FROM x UNION ALL SELECT vec_id, 1, round((2 * a - c) / t, 8) FROM x")
def solve(spark: SparkSession, d: str) -> DataFrame:
    m = _two(spark, d)
    right = m.select("mat_id", F.col("row").alias("idx")).distinct().withColumn("value", F.col("idx") + 1.0)
    return rounded(linalg.solved(m, right), 8, "value")


@query("singular_values", _TWO.rstrip() + ", s AS (SELECT vec_id, a * a + b * b + c * c + d * d AS s, t FROM x) SELECT vec_id AS mat_id, 0 AS \"row\", round(sqrt((s + sqrt(greatest(s * s - 4 * t * t, 0))) / 2), 6) AS value FROM s UNION ALL SELECT vec_id, 1, round(sqrt((s - sqrt(greatest(s * s - 4 * t * t, 0))) / 2), 6) FROM s")
def singular_values(spark: SparkSession, d: str) -> DataFrame:
    return rounded(linalg.by_matrix(_two(spark, d), "s").select("mat_id", "row", "value"), 6, "value")


def _rebuilt(m: np.ndarray) -> np.ndarray:
    """Whether each decomposition multiplies back to the matrix, or to its square form."""
    u, s, vt = np.linalg.svd(m)
    q, r = linalg.MATRIX["q"](m), linalg.MATRIX["r"](m)
    low, swaps = linalg.lu(m)
    order = list(range(len(m)))
    for i, p in enumerate(swaps):
        order[i], order[p] = order[p], order[i]
    lower, upper = np.tril(low, -1) + np.eye(len(m)), np.triu(low)
    spd = m @ m.T + np.eye(len(m))
    chol = linalg.cholesky(spd)
    values = linalg.eigen(m)
    near = lambda x, y: float(np.allclose(x, y, atol=1e-8))
    return np.array([[near(lower @ upper, m[order]), near(q @ r, m), near(q.T @ q, np.eye(len(m))), near(u @ np.diag(s) @ vt, m), near(chol @ chol.T, spd), near(values[:, 0].sum(), np.trace(m)), near(linalg.inverse(m) @ m, np.eye(len(m)))]])


@query("decompositions", "SELECT vec_id AS mat_id, range::INTEGER AS col, 1.0::DOUBLE AS value FROM embeddings, range(7)")
def decompositions(spark: SparkSession, d: str) -> DataFrame:
    """For the 8 x 8 matrix of each vector: LU, QR, orthogonality, SVD, Cholesky, trace of the eigenvalues, inverse."""
    return linalg.by_matrix(_blocks(spark, d, 8), _rebuilt).select("mat_id", "col", "value")


_M = f'{ROWS}, m AS (SELECT vec_id, idx, value FROM w)'


@query("axis_reductions", f"WITH {_M} SELECT vec_id AS \"row\", round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(sqrt(sum(value * value)), 6) AS norm, arg_max(idx, value)::INTEGER AS largest FROM m GROUP BY vec_id")
def axis_reductions(spark: SparkSession, d: str) -> DataFrame:
    m = mx.from_arrays(load(spark, d, "embeddings"), "embedding", "vec_id")
    out = None
    for how, name in (("sum", "total"), ("mean", "mean"), ("min", "low"), ("max", "high"), ("norm", "norm"), ("argmax", "largest")):
        one = mx.reduced(m, "rows", how).select("row", F.col("value").alias(name))
        out = one if out is None else out.join(one, "row")
    return rounded(out, 6, "total", "mean", "norm").withColumn("largest", F.col("largest").cast("int"))


@query("kronecker", _TWO + 'SELECT vec_id AS mat_id, i AS "row", j AS col, round(CASE WHEN i % 2 = j % 2 THEN CASE WHEN i // 2 = 0 THEN CASE WHEN j // 2 = 0 THEN a ELSE b END ELSE CASE WHEN j // 2 = 0 THEN c ELSE d END END ELSE 0 END, 8) + 0.0 AS value FROM x, (SELECT unnest(range(4))::INTEGER AS i), (SELECT unnest(range(4))::INTEGER AS j)')
def kronecker(spark: SparkSession, d: str) -> DataFrame:
    m = _two(spark, d)
    eye = mx.eye(spark, 2).select("row", "col", "value").crossJoin(F.broadcast(load(spark, d, "embeddings").select(F.col("vec_id").alias("mat_id"))))
    return rounded(mx.kronecker(m, eye.select("mat_id", "row", "col", "value"), 2, 2), 8, "value")


@query("hadamard_diagonal", _TWO + "SELECT vec_id AS mat_id, 0 AS idx, round(a * a, 8) AS value FROM x UNION ALL SELECT vec_id, 1, round(d * d, 8) FROM x")
def hadamard_diagonal(spark: SparkSession, d: str) -> DataFrame:
    m = _two(spark, d)
    return rounded(mx.diagonal(mx.hadamard(m, m)), 8, "value")


@query("stacked_matrices", _TWO.rstrip() + ', y(i, j) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) SELECT vec_id AS mat_id, i + 2 * p AS "row", j + 2 * q AS col, round(CASE WHEN i = 0 AND j = 0 THEN a WHEN i = 0 THEN b WHEN j = 0 THEN c ELSE d END, 8) AS value FROM x, y, (SELECT unnest([0, 0, 1]) AS p, unnest([0, 1, 0]) AS q)')
def stacked_matrices(spark: SparkSession, d: str) -> DataFrame:
    """The matrix beside itself, and below."""
    m = _two(spark, d)
    return rounded(mx.vertcat(mx.horzcat(m, m, 2), m, 2), 8, "value")


@query("submatrix", f'WITH {ROWS}, t("to", col) AS (VALUES (0, 5), (1, 5), (2, 1)) SELECT vec_id AS "row", "to" AS col, value FROM w JOIN t ON idx = t.col')
def submatrix(spark: SparkSession, d: str) -> DataFrame:
    m = mx.from_arrays(load(spark, d, "embeddings"), "embedding", "vec_id")
    return mx.submatrix(m, None, [5, 5, 1]).select("row", "col", "value")


@query("random_ints", "SELECT 600::BIGINT AS n, true AS inside, true AS whole, true AS again")
def random_ints(spark: SparkSession, d: str) -> DataFrame:
    a, b = (mx.random_ints(spark, 20, 30, -3, 9, 5) for _ in range(2))
    both = a.join(b.select("row", "col", F.col("value").alias("other")), ["row", "col"])
    x = F.col("value")
    return both.agg(F.count(F.lit(1)).alias("n"), ((F.min(x) >= -3) & (F.max(x) < 9)).alias("inside"), F.bool_and(x == F.floor(x)).alias("whole"), F.bool_and(x == F.col("other")).alias("again"))


@query("tiled_and_updated", 'SELECT (r + 2 * p)::INTEGER AS "row", (c + 2 * q)::INTEGER AS col, CASE WHEN r = c THEN 9.0 ELSE 0.0 END::DOUBLE AS value FROM range(2) a(r), range(2) b(c), range(3) e(p), range(2) f(q)')
def tiled_and_updated(spark: SparkSession, d: str) -> DataFrame:
    return mx.updated(mx.tiled(mx.eye(spark, 2), 2, 2, 3, 2), F.col("value") == 1, 9.0).select("row", "col", "value")


@query("nd_scalar_left", f"WITH {CUBE} SELECT i0, i1, i2, round(1000000 - value, 2) AS value FROM q")
def nd_scalar_left(spark: SparkSession, d: str) -> DataFrame:
    one = mx.NDArray(spark.createDataFrame([(1_000_000.0,)], "value double"), ())
    return rounded(one.combine(c._cube(spark, d), lambda x, y: x - y).rows.select("i0", "i1", "i2", "value"), 2, "value")


@query("nd_cumsum", f"WITH {CUBE} SELECT i0, i1, i2, round(sum(value) OVER (PARTITION BY i0, i2 ORDER BY i1), 2) AS value FROM q")
def nd_cumsum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c._cube(spark, d).cumsum(1).rows.select("i0", "i1", "i2", "value"), 2, "value")


@query("nd_argmax", f"WITH {CUBE} SELECT i0, i2 AS i1, arg_max(i1, value)::INTEGER AS value FROM q GROUP BY i0, i2")
def nd_argmax(spark: SparkSession, d: str) -> DataFrame:
    return c._cube(spark, d).argmax(1).rows.select("i0", "i1", "value")


@query("nd_shapes", f"WITH {CUBE} SELECT (i0 + 7 * i1 + 84 * i2)::INTEGER AS i0, round(value, 2) AS value FROM q")
def nd_shapes(spark: SparkSession, d: str) -> DataFrame:
    """An axis of one put in and taken out, then all flattened in column-major order."""
    return rounded(c._cube(spark, d).unsqueeze(1).squeeze().flatten().rows.select("i0", "value"), 2, "value")


# ---- the network


@query("relu_one_hot", f"WITH {ROWS} SELECT w.vec_id, idx, greatest(value, 0.0) AS relu, CASE WHEN label = idx THEN 1.0 ELSE 0.0 END::DOUBLE AS hot FROM w JOIN embeddings e ON e.vec_id = w.vec_id WHERE idx < 10")
def relu_one_hot(spark: SparkSession, d: str) -> DataFrame:
    a = c._arrays(spark, d)
    z = F.arrays_zip(F.slice(network.relu(F.col("a")), 1, 10).alias("relu"), network.one_hot(F.col("label"), 10).alias("hot"))
    return a.select("vec_id", F.posexplode(z).alias("idx", "z")).select("vec_id", "idx", "z.relu", "z.hot")


@query("accuracy", f"WITH {ROWS}, b AS (SELECT vec_id, arg_max(idx, value) AS best FROM w GROUP BY vec_id) SELECT round(avg(CASE WHEN best = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM b JOIN embeddings USING (vec_id)")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(network.accuracy(c._arrays(spark, d), "a", "label"), 9, "accuracy")


@query("gradient_descent", "SELECT true AS learns, 4::BIGINT AS weights")
def gradient_descent(spark: SparkSession, d: str) -> DataFrame:
    """Whether forward passes after twelve steps lose less than before."""
    a = c._arrays(spark, d)
    rows = a.select("a", "label").where("vec_id < 200").collect()
    x, y = np.array([r["a"] for r in rows]), np.array([r["label"] for r in rows])

    def loss(w: list[np.ndarray]) -> float:
        return -float(np.log(network.forward(x, w)[2][np.arange(len(y)), y] + 1e-12).mean())

    before, after = (network.gradient_descent(a, "a", "label", 16, 10, n, 0.5, 1) for n in (0, 12))
    return spark.createDataFrame([(loss(after) < loss(before), len(after))], "learns boolean, weights long")


# ---- text


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quaylark-")
    return f"{base.rstrip('/')}/text-{uuid.uuid4().hex}"


def _order(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"), (F.col("o_custkey") % 100).cast("double").alias("y"))
    return o.where("k <= 2000").select((F.col("k") - 1).cast("int").alias("row"), F.posexplode(F.array("x", "y", F.col("k").cast("double"))).alias("col", "value"))


_ORDERS = "o AS (SELECT o_orderkey - min(o_orderkey) OVER () AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, o_orderkey, o_totalprice, (o_custkey % 100)::DOUBLE AS y FROM orders WHERE o_orderkey <= 2000), t AS (SELECT r, 0 AS col, o_totalprice AS value FROM o UNION ALL SELECT r, 1, y FROM o UNION ALL SELECT r, 2, o_orderkey::DOUBLE FROM o)"


@query("matrix_text", f'WITH {_ORDERS} SELECT r::INTEGER AS "row", col, value FROM t')
def matrix_text(spark: SparkSession, d: str) -> DataFrame:
    """A matrix written as text, a line for a row, and read again."""
    path = _folder(spark)
    delimited.write_matrix(_order(spark, d), path, ";")
    return delimited.load_matrix(spark, path, ";")


@query("array_text", f"WITH {_ORDERS} SELECT 3 * r + col AS idx, value FROM t")
def array_text(spark: SparkSession, d: str) -> DataFrame:
    """The same text read as one array."""
    path = _folder(spark)
    delimited.write_matrix(_order(spark, d), path)
    return delimited.load_array(spark, path).select(F.col("idx").cast("long").alias("idx"), "value")


@query("losses_csv", f"WITH {L} SELECT iteration AS year, day, amount FROM l WHERE seq <= 500")
def losses_csv(spark: SparkSession, d: str) -> DataFrame:
    """Losses from text with a header and spaces before the cells."""
    path = _folder(spark)
    rows = losses(spark, d).where("seq <= 500").select(F.concat_ws(", ", "iteration", "day", "amount").alias("line"))
    head = spark.createDataFrame([("year, day, amount",)], "line string")
    head.unionByName(rows).coalesce(1).write.text(path)
    return delimited.load_table(spark, path, "year int, day int, amount double")
