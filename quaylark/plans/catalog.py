"""Registered queries over the test tables, each with its SQL.

Losses are orders: iteration = o_custkey % 100 + 1, day = day of the year, amount = o_totalprice, ties by
o_orderkey. Figures from running sums are rounded alike on both sides, as engines add in other orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.functions import layers as lf
from quaylark.functions import numeric
from quaylark.functions.distributions import Poisson, fit_trend, histogram
from quaylark.operators import grouping as g
from quaylark.operators import indices, linalg, network, plots, tail
from quaylark.operators import matrices as mx
from quaylark.operators import vectors as v
from quaylark.operators.scenario import Scenario, combine
from quaylark.operators.tower import Layer, Tower, split
from quaylark.operators.tower import loss_report as report
from quaylark.plans.registry import query
from quaylark.sources.tables import load, losses
from quaylark.streaming.losses import windowed_losses

N = 100
L = "l AS (SELECT (o_custkey % 100 + 1)::INTEGER AS iteration, dayofyear(o_orderdate)::INTEGER AS day, o_orderkey AS seq, o_orderkey AS id, o_totalprice AS amount FROM orders)"
TOWER = Tower.from_retention(100_000, [100_000, 100_000, 200_000])
ONE = Tower.one_at_100(100_000, [100_000, 100_000])
FRANCHISE = Tower((Layer(occ_limit=150_000, occ_retention=100_000, occ_type="franchise", share=0.5), Layer(occ_limit=50_000, occ_retention=80_000, occ_type="reverse_franchise"), Layer(occ_limit=100_000, occ_retention=50_000, agg_limit=300_000, agg_retention=100_000)))
GRID = "g AS (SELECT range::INTEGER AS iteration FROM range(1, 101))"
ORDERED = "(PARTITION BY iteration ORDER BY day, seq)"
RUN = "(PARTITION BY iteration ORDER BY day, seq ROWS UNBOUNDED PRECEDING)"


def _scenario(spark: SparkSession, d: str) -> Scenario:
    return Scenario(losses(spark, d), N, name="orders")


def _occ(x: Layer) -> str:
    a, lim, ret = "amount", x.occ_limit, x.occ_retention
    if x.occ_type == "franchise":
        return f"CASE WHEN {a} > {ret} THEN least({a}, {lim}) ELSE 0 END"
    if x.occ_type == "reverse_franchise":
        return f"least(CASE WHEN {a} <= {ret} THEN {a} ELSE 0 END, {lim})"
    return f"least(greatest({a} - {ret}, 0), {'1e300' if lim is None else lim})"


def _split_sql(tower: Tower, tail_sql: str) -> str:
    agg = lambda k, x: f"(least(greatest(c{k} - {x.agg_retention or 0}, 0), {x.agg_limit if x.agg_limit is not None else 1e300}) * {x.share})"
    n = range(len(tower.layers))
    return (
        f"WITH {L}, o AS (SELECT *, " + ", ".join(f"({_occ(x)})::DOUBLE AS o{k}" for k, x in enumerate(tower.layers)) + " FROM l), "
        "c AS (SELECT *, " + ", ".join(f"sum(o{k}) OVER {RUN} AS c{k}" for k in n) + " FROM o), "
        "s AS (SELECT *, " + ", ".join(f"{agg(k, x)} - coalesce(lag({agg(k, x)}) OVER {ORDERED}, 0) AS ceded_{k}" for k, x in enumerate(tower.layers)) + f" FROM c) {tail_sql}"
    )


def _split_rows(df: DataFrame, tower: Tower) -> DataFrame:
    out = split(df, tower)
    names = [f"ceded_{k}" for k in range(len(tower.layers))] + ["ceded", "retained"]
    return out.select("iteration", "day", "seq", *[(F.round(c, 4) + 0.0).alias(c) for c in names])


def _split_tail(tower: Tower) -> str:
    ks = [f"ceded_{k}" for k in range(len(tower.layers))]
    total = " + ".join(ks)
    return "SELECT iteration, day, seq, " + ", ".join(f"round({k}, 4) + 0.0 AS {k}" for k in ks) + f", round({total}, 4) + 0.0 AS ceded, round(amount - ({total}), 4) + 0.0 AS retained FROM s"


def _report_tail(tower: Tower) -> str:
    parts = []
    for k, x in enumerate(tower.layers):
        hit = f"count(*) FILTER (t{k} > {x.agg_limit} - 0.01)" if x.agg_limit is not None else "0"
        parts.append(f"SELECT {k} AS layer, '{x.auto_name}' AS name, {x.first_limit}::DOUBLE AS \"limit\", round(avg(t{k}) / {x.first_limit}, 8) AS el, round(stddev_pop(t{k}) / {x.first_limit}, 8) AS std_dev, count(*) FILTER (t{k} > 0) / {N}.0::DOUBLE AS attach_prob, {hit} / {N}.0::DOUBLE AS exhaust_prob FROM t")
    totals = ", ".join(f"coalesce(sum(ceded_{k}), 0) AS t{k}" for k in range(len(tower.layers)))
    return f", {GRID}, t AS (SELECT g.iteration, {totals} FROM g LEFT JOIN s ON g.iteration = s.iteration GROUP BY g.iteration) " + " UNION ALL ".join(parts)


def _report(df: DataFrame, tower: Tower) -> DataFrame:
    return report(split(df, tower), tower, N).withColumn("el", F.round("el", 8)).withColumn("std_dev", F.round("std_dev", 8))


@query("tower_split", _split_sql(TOWER, _split_tail(TOWER)))
def tower_split(spark: SparkSession, d: str) -> DataFrame:
    return _split_rows(losses(spark, d), TOWER)


@query("tower_one_at_100", _split_sql(ONE, _split_tail(ONE)))
def tower_one_at_100(spark: SparkSession, d: str) -> DataFrame:
    return _split_rows(losses(spark, d), ONE)


@query("tower_franchise", _split_sql(FRANCHISE, _split_tail(FRANCHISE)))
def tower_franchise(spark: SparkSession, d: str) -> DataFrame:
    return _split_rows(losses(spark, d), FRANCHISE)


@query("loss_report", _split_sql(TOWER, _report_tail(TOWER)))
def loss_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(losses(spark, d), TOWER)


@query("loss_report_one_at_100", _split_sql(ONE, _report_tail(ONE)))
def loss_report_one(spark: SparkSession, d: str) -> DataFrame:
    return _report(losses(spark, d), ONE)


@query("group_sum", f"WITH {L}, {GRID} SELECT g.iteration, round(coalesce(sum(amount), 0), 4) AS total FROM g LEFT JOIN l ON g.iteration = l.iteration GROUP BY g.iteration")
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return g.group_sum(losses(spark, d), N).withColumn("total", F.round("total", 4))


@query("group_count", f"WITH {L}, {GRID} SELECT g.iteration, count(l.seq) AS events FROM g LEFT JOIN l ON g.iteration = l.iteration GROUP BY g.iteration")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return g.group_count(losses(spark, d), N)


@query("group_max", f"WITH {L}, {GRID} SELECT g.iteration, coalesce(max(amount), '-inf'::DOUBLE) AS largest FROM g LEFT JOIN l ON g.iteration = l.iteration GROUP BY g.iteration")
def group_max(spark: SparkSession, d: str) -> DataFrame:
    return g.group_max(losses(spark, d), N)


@query("group_cumsum", f"WITH {L} SELECT iteration, seq, round(sum(amount) OVER {RUN}, 4) AS cumulative FROM l")
def group_cumsum(spark: SparkSession, d: str) -> DataFrame:
    return g.group_cumsum(losses(spark, d)).select("iteration", "seq", F.round("cumulative", 4).alias("cumulative"))


@query("group_diff", f"WITH {L} SELECT iteration, seq, round(amount - coalesce(lag(amount) OVER {ORDERED}, 0), 6) AS difference FROM l")
def group_diff(spark: SparkSession, d: str) -> DataFrame:
    return g.group_diff(losses(spark, d)).select("iteration", "seq", F.round("difference", 6).alias("difference"))


@query("frequency_stats", f"WITH {L}, {GRID}, t AS (SELECT g.iteration, count(l.seq) AS events, coalesce(sum(amount), 0) AS total FROM g LEFT JOIN l ON g.iteration = l.iteration GROUP BY g.iteration) SELECT round(avg(events), 8) AS mean_freq, round(sum(total) / 100, 4) AS mean_loss, round((var_samp(events) - avg(events)) / pow(avg(events), 2), 8) AS cluster_coeff, round(var_samp(events) / avg(events), 8) AS variance_mean_ratio FROM t")
def frequency_stats(spark: SparkSession, d: str) -> DataFrame:
    s = g.frequency_stats(losses(spark, d), N)
    return s.select(F.round("mean_freq", 8).alias("mean_freq"), F.round("mean_loss", 4).alias("mean_loss"), F.round("cluster_coeff", 8).alias("cluster_coeff"), F.round("variance_mean_ratio", 8).alias("variance_mean_ratio"))


@query("aep", f"WITH {L}, {GRID}, t AS (SELECT g.iteration, coalesce(sum(amount), 0) AS amount FROM g LEFT JOIN l ON g.iteration = l.iteration GROUP BY g.iteration) SELECT iteration, round(amount, 4) AS amount, 100.0::DOUBLE / row_number() OVER (ORDER BY amount DESC, iteration) AS return_period FROM t")
def aep(spark: SparkSession, d: str) -> DataFrame:
    return g.aep(losses(spark, d), N).withColumn("amount", F.round("amount", 4))


@query("oep", f"WITH {L}, {GRID}, t AS (SELECT g.iteration, coalesce(max(amount), '-inf'::DOUBLE) AS amount FROM g LEFT JOIN l ON g.iteration = l.iteration GROUP BY g.iteration) SELECT iteration, amount, 100.0::DOUBLE / row_number() OVER (ORDER BY amount DESC, iteration) AS return_period FROM t")
def oep(spark: SparkSession, d: str) -> DataFrame:
    return g.oep(losses(spark, d), N)


@query("threshold", f"WITH {L} SELECT iteration, day, amount, id FROM l WHERE amount > 250000")
def threshold(spark: SparkSession, d: str) -> DataFrame:
    return _scenario(spark, d).above(250_000).rows()


@query("scale", f"WITH {L} SELECT iteration, day, amount * 1.5 AS amount, id FROM l")
def scale(spark: SparkSession, d: str) -> DataFrame:
    return _scenario(spark, d).scaled(1.5).rows()


@query("first_iterations", f"WITH {L} SELECT iteration, day, amount, id FROM l WHERE iteration <= 10")
def first_iterations(spark: SparkSession, d: str) -> DataFrame:
    return _scenario(spark, d).first_iterations(10).rows()


@query("one_iteration", f"WITH {L} SELECT iteration, day, amount, id FROM l WHERE iteration = 7")
def one_iteration(spark: SparkSession, d: str) -> DataFrame:
    return _scenario(spark, d).iteration(7).rows()


@query("shift_day", f"WITH {L} SELECT iteration, ((day - 45 - 1) % 365 + 365) % 365 + 1 AS day, amount, id FROM l")
def shift_day(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date

    return _scenario(spark, d).moved_to(date(2019, 2, 15)).rows()


@query("claim_dates", f"WITH {L} SELECT id, (DATE '2019-01-01' + (day - 1)) AS claim_date, month(DATE '2019-01-01' + (day - 1))::INTEGER AS month, year(DATE '2019-01-01' + (day - 1))::INTEGER AS year FROM l")
def claim_dates(spark: SparkSession, d: str) -> DataFrame:
    return _scenario(spark, d).with_dates().select("id", "claim_date", "month", "year")


@query("claims_between", f"WITH {L} SELECT iteration, day, amount, id FROM l WHERE DATE '2019-01-01' + (day - 1) BETWEEN DATE '2019-03-01' AND DATE '2019-06-30'")
def claims_between(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date

    return _scenario(spark, d).since(date(2019, 3, 1)).until(date(2019, 6, 30)).rows()


@query("period", f"WITH {L} SELECT DATE '2019-01-01' + (min(day) - 1) AS first_date, DATE '2019-01-01' + (max(day) - 1) AS last_date FROM l")
def period(spark: SparkSession, d: str) -> DataFrame:
    return _scenario(spark, d).period()


@query("seasons", f"WITH {L} SELECT ceil(max(day) / 365.0)::BIGINT AS seasons FROM l")
def seasons(spark: SparkSession, d: str) -> DataFrame:
    return _scenario(spark, d).seasons()


@query("seasonality", f"WITH {L}, m AS (SELECT year(DATE '2019-01-01' + (day - 1))::INTEGER AS year, month(DATE '2019-01-01' + (day - 1))::INTEGER AS month, sum(amount) AS amount FROM l GROUP BY 1, 2) SELECT year, month, round(amount / sum(amount) OVER (), 8) AS share FROM m")
def seasonality(spark: SparkSession, d: str) -> DataFrame:
    return _scenario(spark, d).seasonality().withColumn("share", F.round("share", 8))


@query("combine", f"WITH {L}, u AS (SELECT * FROM l WHERE amount > 100000 UNION ALL SELECT iteration, day, seq, id, amount * 0.5 FROM l WHERE amount > 200000) SELECT id, min(iteration)::INTEGER AS iteration, min(day)::INTEGER AS day, round(sum(amount), 6) AS amount FROM u GROUP BY id HAVING sum(amount) > 200000")
def combined(spark: SparkSession, d: str) -> DataFrame:
    s = _scenario(spark, d)
    return combine(s.above(100_000), s.above(200_000).scaled(0.5)).events.select("id", "iteration", "day", F.round("amount", 6).alias("amount"))


@query("layer_functions", f"WITH {L} SELECT id, least(greatest(amount - 50000.0, 0.0), 100000.0) AS reinsured, least(greatest(amount - 50000.0, 0.0), 100000.0) * 0.25 AS shared, CASE WHEN amount < 50000 THEN 0.0 ELSE least(amount, 150000.0) END AS franchised FROM l")
def layer_functions(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("amount")
    return losses(spark, d).select("id", lf.reinsurance(a, 100_000, 50_000).alias("reinsured"), lf.reinsurance(a, 100_000, 50_000, 0.25).alias("shared"), lf.franchise(a, 100_000, 50_000).alias("franchised"))


INDEX = indices.PeriodIndex((1.05, 1.03, 1.02, 1.04))


@query("on_level", f"WITH {L}, f(p, f) AS (VALUES (0, 1.0::DOUBLE), (1, 1.05::DOUBLE), (2, 1.05::DOUBLE * 1.03::DOUBLE), (3, 1.05::DOUBLE * 1.03::DOUBLE * 1.02::DOUBLE), (4, 1.05::DOUBLE * 1.03::DOUBLE * 1.02::DOUBLE * 1.04::DOUBLE)) SELECT id, amount * f AS on_level FROM l JOIN f ON p = least(iteration % 7, 4)")
def on_level(spark: SparkSession, d: str) -> DataFrame:
    return INDEX.on_level(losses(spark, d).withColumn("period", F.col("iteration") % 7)).select("id", "on_level")


@query("on_level_years", "WITH f(y, f) AS (VALUES (2001, 1.0::DOUBLE), (2000, 1.02::DOUBLE), (1999, 1.02::DOUBLE * 1.02::DOUBLE), (1998, 1.02::DOUBLE * 1.02::DOUBLE * 1.02::DOUBLE)) SELECT o_orderkey AS id, o_totalprice * f AS on_level FROM orders JOIN f ON y = greatest(year(o_orderdate), 1998)")
def on_level_years(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.year("o_orderdate").alias("year"))
    return indices.YearIndex((2001, 2000, 1999), (1.02, 1.02, 1.02), 2001).on_level(o).select("id", "on_level")


_RANK = "r AS (SELECT amount, row_number() OVER (ORDER BY amount, id) AS rank, count(*) OVER () AS n FROM l)"


@query("tvar_batch", f"WITH {L}, {_RANK}, a(cl, alpha) AS (VALUES (0.1, 0.9), (0.05, 0.95), (0.01, 0.99)), k AS (SELECT *, floor(n * (1 - alpha) + 1e-11) AS k FROM r, a) SELECT round(cl, 6)::DOUBLE AS cl, max(amount) FILTER (rank = greatest(k, 1)) AS var, round(avg(amount) FILTER (rank <= k), 6) AS tvar FROM k GROUP BY cl")
def tvar_batch(spark: SparkSession, d: str) -> DataFrame:
    t = tail.var_tvar(losses(spark, d), [0.9, 0.95, 0.99], "amount", "id")
    return t.select(F.round("cl", 6).alias("cl"), "var", F.round("tvar", 6).alias("tvar"))


@query("tail_mask", f"WITH {L}, r AS (SELECT id, row_number() OVER (ORDER BY amount, id) AS rank, count(*) OVER () AS n FROM l) SELECT id, rank <= floor(n * (1 - 0.95) + 1e-11) AS in_tail FROM r")
def tail_mask(spark: SparkSession, d: str) -> DataFrame:
    return tail.tail_mask(losses(spark, d), 0.95, "amount", "id").select("id", "in_tail")


@query("qdep", f"WITH {L}, r AS (SELECT row_number() OVER (ORDER BY amount DESC, id) AS a, row_number() OVER (ORDER BY day DESC, id) AS b, count(*) OVER () AS n FROM l) SELECT round(count(*) FILTER (a <= floor(n * 0.25) AND b <= floor(n * 0.25)) / (max(n) * 0.25), 8)::DOUBLE AS qdep FROM r")
def qdep(spark: SparkSession, d: str) -> DataFrame:
    return tail.quantile_dependence(losses(spark, d), 0.75, "amount", "day", "id").select(F.round("qdep", 8).alias("qdep"))


_TOP = "t AS (SELECT amount AS x, row_number() OVER (ORDER BY amount DESC, id) AS k FROM l)"


@query("hill_plot", f"WITH {L}, {_TOP}, s AS (SELECT k, sum(ln(x)) OVER (ORDER BY k) AS logs, lead(x) OVER (ORDER BY k) AS nx FROM t) SELECT k::INTEGER AS k, round(k / (logs - k * ln(nx)), 6) AS estimate FROM s WHERE k BETWEEN 2 AND 100")
def hill_plot(spark: SparkSession, d: str) -> DataFrame:
    return tail.hill_plot(losses(spark, d), "amount", "id", 2, 100).select("k", F.round("estimate", 6).alias("estimate"))


@query("pickands_plot", f"WITH {L}, {_TOP}, p AS (SELECT a.k, a.x - b.x AS u, b.x - c.x AS v FROM t a JOIN t b ON b.k = 2 * a.k JOIN t c ON c.k = 4 * a.k WHERE a.k <= 100), g AS (SELECT k, CASE WHEN u > 0 AND v > 0 THEN log2(u / v) ELSE 'nan'::DOUBLE END AS gamma FROM p) SELECT k::INTEGER AS k, round(gamma, 6) AS gamma, CASE WHEN NOT isnan(gamma) AND gamma > 0 THEN round(1 / gamma, 6) ELSE 'nan'::DOUBLE END AS alpha FROM g")
def pickands_plot(spark: SparkSession, d: str) -> DataFrame:
    p = tail.pickands_plot(losses(spark, d), "amount", "id", 1, 100)
    return p.select("k", F.round("gamma", 6).alias("gamma"), F.round("alpha", 6).alias("alpha"))


E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)"
ROWS = "w AS (SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS idx, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return v.as_rows(load(spark, d, "embeddings"), "vec_id", "embedding")


@query("vector_math", f"WITH {E} SELECT vec_id, round(list_sum(list_transform(a, lambda x: exp(x))), 6) AS exp_sum, round(list_sum(list_transform(a, lambda x: sin(x) * cos(x))), 6) AS sin_cos, round(list_sum(list_transform(a, lambda x: 1 / (1 + exp(-x)))), 6) AS sigmoid_sum, round(list_sum(list_transform(a, lambda x: least(greatest(x, -0.1), 0.1))), 6) AS clamped, round(list_sum(list_transform(a, lambda x: x * 2 + 1)), 6) AS fma, round(list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a))))), 6) AS lse FROM e")
def vector_math(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    r = lambda x, n: F.round(x, 6).alias(n)
    return _arrays(spark, d).select("vec_id", r(v.total(v.each(a, "exp")), "exp_sum"), r(v.total(v.multiply(v.each(a, "sin"), v.each(a, "cos"))), "sin_cos"), r(v.total(v.each(a, numeric.sigmoid)), "sigmoid_sum"), r(v.total(v.clamp(a, -0.1, 0.1)), "clamped"), r(v.total(v.fma(a, 2.0, 1.0)), "fma"), r(v.log_sum_exp(a), "lse"))


@query("vector_masks", f"WITH {E} SELECT vec_id, len(list_filter(a, lambda x: x > 0.1))::INTEGER AS above, len(list_filter(a, lambda x: x > 0.1 OR x < -0.1))::INTEGER AS either, len(list_filter(a, lambda x: x > -5)) = len(a) AS all_above, round(coalesce(list_sum(list_filter(a, lambda x: x > 0.1)), 0), 6) AS masked, (list_position(a, list_max(a)) - 1)::INTEGER AS argmax, (list_position(a, list_min(a)) - 1)::INTEGER AS argmin FROM e")
def vector_masks(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    above = v.compared(a, ">", 0.1)
    return _arrays(spark, d).select("vec_id", v.count_true(above).alias("above"), v.count_true(v.either(above, v.compared(a, "<", -0.1))).alias("either"), v.all_true(v.compared(a, ">", -5.0)).alias("all_above"), F.round(v.total(F.filter(a, lambda x: x > 0.1)), 6).alias("masked"), v.argmax(a).alias("argmax"), v.argmin(a).alias("argmin"))


@query("vector_reductions", f"WITH {ROWS} SELECT vec_id, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, min(value) AS smallest, max(value) AS largest, round(var_pop(value), 6) AS variance, round(var_samp(value), 6) AS sample_variance, round(sqrt(sum(value * value)), 6) AS norm FROM w GROUP BY vec_id")
def vector_reductions(spark: SparkSession, d: str) -> DataFrame:
    r = v.reductions(_rows(spark, d))
    return r.select("vec_id", "n", *[F.round(c, 6).alias(c) for c in ("total", "mean")], "smallest", "largest", *[F.round(c, 6).alias(c) for c in ("variance", "sample_variance", "norm")])


@query("vector_scans", f"WITH {ROWS} SELECT vec_id, idx, round(sum(value) OVER (PARTITION BY vec_id ORDER BY idx), 6) AS cumsum, round(value - coalesce(lag(value) OVER (PARTITION BY vec_id ORDER BY idx), 0), 6) AS increment FROM w")
def vector_scans(spark: SparkSession, d: str) -> DataFrame:
    return v.scanned(_rows(spark, d)).select("vec_id", "idx", F.round("cumsum", 6).alias("cumsum"), F.round("increment", 6).alias("increment"))


@query("element_ranks", f"WITH {ROWS} SELECT vec_id, idx, rank() OVER (PARTITION BY vec_id ORDER BY value) + (count(*) OVER (PARTITION BY vec_id, value) - 1) / 2.0::DOUBLE AS rank FROM w")
def element_ranks(spark: SparkSession, d: str) -> DataFrame:
    return v.element_ranks(_rows(spark, d)).select("vec_id", "idx", "rank")


@query("argsort", f"WITH {ROWS} SELECT vec_id, idx, (row_number() OVER (PARTITION BY vec_id ORDER BY value, idx) - 1)::INTEGER AS place FROM w")
def argsort(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("vec_id", F.posexplode(v.argsort(F.col("a"))).alias("place", "idx"))


@query("unique_values", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def unique_values(spark: SparkSession, d: str) -> DataFrame:
    by = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("a"))
    return by.select("o_custkey", F.size(v.unique(F.col("a"))).cast("long").alias("n"))


@query("cosine_to_label", f"WITH {ROWS}, c AS (SELECT label, idx, avg(value) AS c FROM w JOIN embeddings USING (vec_id) GROUP BY label, idx) SELECT w.vec_id, round(sum(value * c) / (sqrt(sum(value * value)) * sqrt(sum(c * c))), 6) AS cosine FROM w JOIN embeddings e ON e.vec_id = w.vec_id JOIN c ON c.label = e.label AND c.idx = w.idx GROUP BY w.vec_id")
def cosine_to_label(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the mean of its label; as many means as labels."""
    a = _arrays(spark, d)
    means = a.select("label", F.posexplode("a").alias("idx", "x")).groupBy("label", "idx").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"]).alias("c"))
    return a.join(means, "label").select("vec_id", F.round(v.cosine(F.col("a"), F.col("c")), 6).alias("cosine"))


@query("pair_stats", f"WITH {L} SELECT round(covar_samp(amount, day), 4) AS covariance, round(corr(amount, day), 8) AS pearson FROM l")
def pair_stats(spark: SparkSession, d: str) -> DataFrame:
    return v.pair_stats(losses(spark, d), "amount", "day").select(F.round("covariance", 4).alias("covariance"), F.round("pearson", 8).alias("pearson"))


@query("spearman", f"WITH {L}, r AS (SELECT iteration, rank() OVER (PARTITION BY iteration ORDER BY amount) + (count(*) OVER (PARTITION BY iteration, amount) - 1) / 2.0 AS a, rank() OVER (PARTITION BY iteration ORDER BY day) + (count(*) OVER (PARTITION BY iteration, day) - 1) / 2.0 AS b FROM l) SELECT iteration, round(corr(a, b), 6) AS spearman FROM r GROUP BY iteration")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return v.spearman(losses(spark, d), "amount", "day", "iteration").select("iteration", F.round("spearman", 6).alias("spearman"))


@query("gram_matrix", f'WITH {ROWS} SELECT x.idx AS "row", y.idx AS col, round(sum(x.value * y.value), 6) AS value FROM w x JOIN w y ON x.vec_id = y.vec_id GROUP BY 1, 2')
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = mx.from_arrays(load(spark, d, "embeddings"), "embedding", "vec_id")
    return mx.matmul(mx.transpose(m), m).select("row", "col", F.round("value", 6).alias("value"))


@query("matrix_vector", f"WITH {ROWS} SELECT vec_id AS idx, round(sum(value * (idx + 1)), 6) AS value FROM w GROUP BY vec_id")
def matrix_vector(spark: SparkSession, d: str) -> DataFrame:
    m = mx.from_arrays(load(spark, d, "embeddings"), "embedding", "vec_id")
    x = spark.range(64).select(F.col("id").cast("int").alias("idx"), (F.col("id") + 1).cast("double").alias("value"))
    return mx.matvec(m, x).select("idx", F.round("value", 6).alias("value"))


@query("axis_sums", f"WITH {ROWS} SELECT idx AS col, round(sum(value), 6) AS value FROM w GROUP BY idx")
def axis_sums(spark: SparkSession, d: str) -> DataFrame:
    return mx.reduced(mx.from_arrays(load(spark, d, "embeddings"), "embedding", "vec_id"), "cols").select("col", F.round("value", 6).alias("value"))


def _cube(spark: SparkSession, d: str) -> mx.NDArray:
    o = load(spark, d, "orders")
    rows = o.groupBy((F.year("o_orderdate") - 1995).alias("i0"), (F.month("o_orderdate") - 1).alias("i1"), (F.col("o_custkey") % 4).cast("int").alias("i2")).agg(F.sum("o_totalprice").alias("value"))
    return mx.NDArray(rows, (7, 12, 4))


CUBE = "q AS (SELECT (year(o_orderdate) - 1995)::INTEGER AS i0, (month(o_orderdate) - 1)::INTEGER AS i1, (o_custkey % 4)::INTEGER AS i2, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3)"


@query("nd_slice_sum", f"WITH {CUBE} SELECT i2 AS i0, round(sum(value), 2) AS value FROM q WHERE i0 >= 1 AND i0 < 5 GROUP BY i2")
def nd_slice_sum(spark: SparkSession, d: str) -> DataFrame:
    out = _cube(spark, d).slice(0, 1, 5).reduce(0).reduce(0)
    return out.rows.select("i0", F.round("value", 2).alias("value"))


@query("nd_permute_reshape", f"WITH {CUBE} SELECT (i2 + 4 * i0)::INTEGER AS i0, i1, round(value, 2) AS value FROM q")
def nd_permute_reshape(spark: SparkSession, d: str) -> DataFrame:
    return _cube(spark, d).permute([2, 0, 1]).reshape((28, 12)).rows.select("i0", "i1", F.round("value", 2).alias("value"))


@query("nd_broadcast_add", f"WITH {CUBE}, m AS (SELECT i2, avg(value) AS m FROM q GROUP BY i2) SELECT i0, i1, q.i2, round(value - m, 2) AS value FROM q JOIN m ON m.i2 = q.i2")
def nd_broadcast_add(spark: SparkSession, d: str) -> DataFrame:
    a = _cube(spark, d)
    means = a.rows.groupBy(F.col("i2").alias("i0")).agg(F.avg("value").alias("value"))
    out = a.combine(mx.NDArray(means, (4,)).broadcast_to(a.shape), lambda x, y: x - y)
    return out.rows.select("i0", "i1", "i2", F.round("value", 2).alias("value"))


@query("softmax", f"WITH {E}, x AS (SELECT vec_id, a, list_sum(list_transform(a, lambda x: exp(x))) AS s FROM e) SELECT vec_id, round(list_max(list_transform(a, lambda x: exp(x) / s)), 8) AS largest, (list_position(a, list_max(a)) - 1)::INTEGER AS likely FROM x")
def softmax(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("a")
    return _arrays(spark, d).select("vec_id", F.round(F.array_max(network.softmax(a)), 8).alias("largest"), network.most_likely(a).alias("likely"))


@query("windowed_losses", "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, (user_id % 100 + 1)::INTEGER AS iteration, count(*) AS events, round(sum(value * 1000), 4) AS total FROM events GROUP BY 1, 2")
def windowed(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_losses(load(spark, d, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "iteration", "events", F.round("total", 4).alias("total"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return g.group_count(losses(spark, d), N)


@query("poisson_trend")
def poisson_trend(spark: SparkSession, d: str) -> DataFrame:
    by = load(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).count().orderBy("year").collect()
    t = fit_trend([r["year"] for r in by], [r["count"] for r in by])
    return plots.trend_rows(spark, t, by[0]["year"], by[-1]["year"])
