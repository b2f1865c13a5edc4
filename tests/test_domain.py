import math

import pytest
from pyspark.sql import functions as F

from quaylark.functions.distributions import Empirical, Mixed, NegativeBinomial, Poisson, fit_trend
from quaylark.operators import grouping as g
from quaylark.operators import linalg, tail
from quaylark.operators import matrices as mx
from quaylark.operators import vectors as v
from quaylark.operators.indices import PeriodIndex, YearIndex
from quaylark.operators.scenario import Scenario, combine
from quaylark.operators.tower import Layer, Tower, loss_report, split

EVENTS = "iteration int, day int, seq long, id long, amount double"


def events(spark, rows):
    return spark.createDataFrame([(i, n + 1, n, n, float(a)) for n, (i, a) in enumerate(rows)], EVENTS)


def ceded(spark, tower, rows):
    got = split(events(spark, rows), tower).orderBy("seq").collect()
    for r in got:
        assert r["ceded"] + r["retained"] == pytest.approx(r["amount"])
        assert sum(r[f"ceded_{k}"] for k in range(len(tower.layers))) == pytest.approx(r["ceded"])
    return [[r[f"ceded_{k}"] for r in got] for k in range(len(tower.layers))]


@pytest.mark.parametrize(
    ("layer", "rows", "want"),
    [
        (Layer(occ_retention=10), [(1, 12)], [2]),
        (Layer(occ_limit=5, occ_retention=10, share=0.5), [(1, 9), (2, 14), (2, 12), (3, 9), (3, 15)], [0, 2, 1, 0, 2.5]),
        (Layer(occ_retention=10, occ_type="franchise", share=0.5), [(1, 9), (2, 14), (2, 12), (3, 9), (3, 15)], [0, 7, 6, 0, 7.5]),
        (Layer(occ_limit=3, occ_retention=10, agg_limit=3, agg_retention=1.5), [(1, 12), (2, 14), (2, 12), (3, 11.5), (3, 10.5)], [0.5, 1.5, 1.5, 0, 0.5]),
    ],
)
def test_split(spark, layer, rows, want):
    assert ceded(spark, Tower((layer,)), rows)[0] == pytest.approx(want)


def test_towers(spark):
    assert ceded(spark, Tower.from_retention(5, [5, 5, 5]), [(1, 7), (1, 14), (2, 21), (3, 4)]) == [[2, 5, 5, 0], [0, 4, 5, 0], [0, 0, 5, 0]]
    assert ceded(spark, Tower.one_at_100(5, [5, 5, 5]), [(1, 12), (1, 9), (1, 16), (2, 7)]) == [[5, 4, 1, 2], [2, 0, 5, 0], [0, 0, 1, 0]]
    assert [x.occ_retention for x in Tower.from_retention(5, [6, 7, 8]).layers] == [5, 11, 18]
    assert "5 xs 5" in Tower.from_retention(5, [5]).show()


def test_report(spark):
    df = events(spark, [(1, 5), (1, 5), (3, 20), (4, 5), (5, 10), (5, 5)])
    tower = Tower((Layer(occ_limit=100),))
    r = loss_report(split(df, tower), tower, 5).first()
    assert (r["el"], r["attach_prob"]) == (pytest.approx(0.1), pytest.approx(0.8))
    capped = Tower((Layer(occ_limit=100, agg_limit=10),))
    assert loss_report(split(df, capped), capped, 5).first()["exhaust_prob"] == pytest.approx(0.6)


def test_groups(spark):
    df = events(spark, [(1, 2), (1, 3), (2, 5), (4, 10), (4, 20)])
    by = lambda d, c: [r[c] for r in d.orderBy("iteration").collect()]
    assert by(g.group_sum(df, 4), "total") == [5, 5, 0, 30]
    assert by(g.group_count(df, 4), "events") == [2, 1, 0, 2]
    assert by(g.group_max(df, 4), "largest") == [3, 5, -math.inf, 20]
    s = g.frequency_stats(events(spark, [(1, 15), (4, 25), (4, 1), (4, 1), (4, 1)]), 5).first()
    assert (s["mean_freq"], s["cluster_coeff"], s["variance_mean_ratio"]) == pytest.approx((1, 2, 3))


def test_combine(spark):
    a = Scenario(events(spark, [(1, 10), (2, 20)]), 5, name="a")
    b = Scenario(events(spark, [(1, 5)]), 5, name="b")
    total = {r["id"]: r["amount"] for r in combine(a, b).events.collect()}
    assert total == {0: 15, 1: 20} == {r["id"]: r["amount"] for r in combine(b, a).events.collect()}
    empty = Scenario(events(spark, [(1, 1)]).limit(0), 5)
    assert combine(a, empty) is a
    with pytest.raises(ValueError):
        a.above(-1)
    clash = Scenario(events(spark, [(2, 5)]), 5)
    with pytest.raises(Exception, match="differ"):
        combine(a, clash).events.collect()


def test_indices():
    p = PeriodIndex((1.05, 1.03, 1.02))
    assert p.factors(4) == pytest.approx([1, 1.05, 1.0815, 1.10313])
    assert PeriodIndex((1.05, 1.03)).factor(5) == pytest.approx(1.0815)
    assert YearIndex((2024, 2023, 2022), (1.05, 1.03, 1.02), 2024).factor(2022) == pytest.approx(1.0815)


def test_tail(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("x"))
    r = tail.var_tvar(df, [0.95], "x", "id").first()
    assert (r["var"], r["tvar"]) == (4, 2)
    assert tail.quantile_dependence(df.withColumn("y", F.col("x") * 2), 0.95, "x", "y", "id").first()[0] == pytest.approx(1)
    h = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 4, 8, 16])], "id long, x double")
    assert tail.hill(h, "x", "id", 2).first()["estimate"] == pytest.approx(2 / (3 * math.log(2)))
    q = spark.range(1, 10).select("id", F.col("id").cast("double").alias("x"))
    assert tail.pickands_plot(q, "x", "id", 2, 2).first()["gamma"] == pytest.approx(-1)


def test_distributions():
    e = Empirical([3, 1, 2, 2])
    assert [e.cdf(x) for x in (0.5, 1, 1.5, 2)] == [0, 0.25, 0.25, 0.75]
    assert [e.inverse_cdf(p) for p in (0, 0.25, 0.2500001, 0.75, 1)] == [1, 1, 2, 2, 3]
    w = Empirical([1, 10], [3, 1])
    assert (w.mean, w.probability(1, 10)) == (3.25, 0.25)
    with pytest.raises(ValueError):
        Empirical([])
    assert Mixed([1, 2, 3, 4, 5], 4, 2).cdf(4) == pytest.approx(0.6)
    n = NegativeBinomial(0.5, 2)
    assert (n.mean, n.variance, sum(n.probability_of(k) for k in range(200))) == (1, 3, pytest.approx(1))
    assert isinstance(NegativeBinomial.mle([(1, 5), (2, 5)])[0], Poisson)


def test_trend():
    counts = [1, 0, 0, 0, 1, 0, 0, 0, 2, 1, 1, 2, 3, 0, 0, 1, 2, 1, 0, 1, 2, 3, 1, 2, 1, 0, 1]
    t = fit_trend(list(range(1999, 2026)), counts)
    assert t.intercept == pytest.approx(-82.0576, abs=1e-3)
    assert (t.slope, t.se_slope) == (pytest.approx(0.0407, abs=1e-4), pytest.approx(0.026, abs=1e-3))
    assert (t.p_slope, t.log_likelihood, t.deviance, t.df) == (pytest.approx(0.116, abs=1e-3), pytest.approx(-32.760, abs=1e-3), pytest.approx(26.468, abs=1e-3), 25)
    assert not t.significant()


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0, 3.0, 6.0, 1.0, 5.0])], "id long, a array<double>")
    a = F.col("a")
    r = df.select(v.cumsum(a), v.increments(a), v.argsort(a), v.unique(a), v.argmax(a), v.variance(a)).first()
    assert r[0] == [1, 6, 9, 15, 16, 21] and r[1] == [1, 4, -2, 3, -5, 4] and r[2] == [0, 4, 2, 1, 5, 3] and r[3] == [1, 3, 5, 6] and r[4] == 3
    ranks = v.element_ranks(v.as_rows(df, "id", "a")).orderBy("idx")
    assert [x["rank"] for x in ranks.collect()] == [1.5, 4.5, 3, 6, 1.5, 4.5]
    others = v.product_except_self(v.as_rows(spark.createDataFrame([(0, [2.0, 0.0, 3.0])], "id long, a array<double>"), "id", "a")).orderBy("idx")
    assert [x["others"] for x in others.collect()] == [0, 6, 0]


def test_matrices(spark):
    m = spark.createDataFrame([(0, 0, 0, 2.0), (0, 0, 1, 1.0), (0, 1, 0, 1.0), (0, 1, 1, 3.0)], "mat_id long, row int, col int, value double")
    got = {(r["row"], r["col"]): r["value"] for r in mx.matmul(m, linalg.by_matrix(m, "inv")).collect()}
    assert got == {(0, 0): pytest.approx(1), (0, 1): pytest.approx(0, abs=1e-12), (1, 0): pytest.approx(0, abs=1e-12), (1, 1): pytest.approx(1)}
    assert linalg.by_matrix(m, "det").first()["value"] == pytest.approx(5)
    b = spark.createDataFrame([(0, 0, 3.0), (0, 1, 4.0)], "mat_id long, idx int, value double")
    assert [r["value"] for r in linalg.solved(m, b).orderBy("idx").collect()] == pytest.approx([1, 1])
    assert mx.broadcast_shape((3, 1), (4,)) == (3, 4)
    with pytest.raises(mx.ShapeMismatch):
        mx.broadcast_shape((3,), (4,))


def test_one_shuffle(spark):
    plan = split(events(spark, [(1, 1)]), Tower.from_retention(5, [5, 5, 5]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_delimited(spark, tmp_path):
    from quaylark.sources import delimited as d

    path = str(tmp_path / "m")
    m = spark.createDataFrame([(r, c, float(4 * r + c)) for r in range(3) for c in range(4)], "row int, col int, value double")
    d.write_matrix(m, path)
    assert sorted(map(tuple, d.load_matrix(spark, path).collect())) == sorted(map(tuple, m.collect()))
    assert [r["value"] for r in d.load_array(spark, path).orderBy("idx").collect()] == [float(x) for x in range(12)]
    (tmp_path / "bad").write_text("1,2\n3\n")
    with pytest.raises(ValueError):
        d.load_matrix(spark, str(tmp_path / "bad"))


def test_on_level(spark):
    p = PeriodIndex.from_rate_changes([5, 3, 2])
    df = spark.createDataFrame([(0, 100.0), (1, 200.0), (2, 300.0), (9, 100.0), (-1, 100.0)], "period int, amount double")
    got = {r["period"]: r["on_level"] for r in p.on_level(df).collect()}
    assert got == {0: 100, 1: pytest.approx(210), 2: pytest.approx(324.45), 9: pytest.approx(110.313), -1: 100}
    y = YearIndex((2024, 2023, 2022), p.indices, 2024)
    df = spark.createDataFrame([(2024, 100.0), (2022, 300.0)], "year int, amount double")
    assert [r["on_level"] for r in y.on_level(df).orderBy("year").collect()] == pytest.approx([324.45, 100])
    assert (y.num_years, y.earliest, y.latest, p.num_periods, PeriodIndex(()).factor(3)) == (3, 2022, 2024, 3, 1.0)


def test_stable_region(spark):
    """Windows with a gap don't count; of equal windows the first."""
    nan = math.nan
    rows = [(1, 0.5), (2, nan), (3, 0.5), (4, nan), (5, 0.5), (6, 0.5), (7, 0.6), (8, 0.5), (9, 0.5), (10, 0.5)]
    plot = spark.createDataFrame(rows, "k int, gamma double")
    assert tuple(tail.pickands_stable_region(plot, 3).first()) == pytest.approx((8, 10, 0.5, 2.0))
    assert tail.stable_region(plot, "gamma", 7).count() == 0
    below = spark.createDataFrame([(k, -0.5) for k in range(5)], "k int, gamma double")
    assert tail.pickands_stable_region(below, 3).count() == 0


def test_trend_bounds(spark):
    """Bounds by the whole covariance: the variance of intercept + slope * year."""
    from quaylark.operators.plots import trend_rows

    years, counts = list(range(2000, 2012)), [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8]
    t = fit_trend(years, counts)
    centre, a, b, c = t.centred
    assert a + 2 * b * -centre + c * centre**2 == pytest.approx(t.se_intercept**2, rel=1e-6) and c == pytest.approx(t.se_slope**2)
    for r in trend_rows(spark, t, 2000, 2011).collect():
        x = r["year"] - centre
        half = 1.96 * math.sqrt(a + 2 * b * x + c * x * x)
        assert math.log(r["high"] / r["fit"]) == pytest.approx(half) == pytest.approx(math.log(r["fit"] / r["low"]))
        assert half > 0.1


def test_volume_weighted():
    """The fit undoes the volumes: expected counts of the true distributions give its parameters back."""
    rows = [(k, v, round(1e7 * NegativeBinomial(3.2, 0.8 * v).probability_of(k))) for v in (0.5, 2.0) for k in range(60)]
    n, done = NegativeBinomial.volume_weighted_mle([r for r in rows if r[2]])
    assert done and (n.a, n.b) == (pytest.approx(3.2, abs=0.01), pytest.approx(0.8, abs=0.01))
    same, _ = NegativeBinomial.volume_weighted_mle([(k, 2.0, 10) for k in (1, 2, 3)])
    assert isinstance(same, Poisson) and same.rate == pytest.approx(1)


def test_solve_without_matrix(spark):
    m = spark.createDataFrame([(0, 0, 0, 2.0)], "mat_id long, row int, col int, value double")
    b = spark.createDataFrame([(1, 0, 3.0)], "mat_id long, idx int, value double")
    with pytest.raises(Exception, match="no matrix"):
        linalg.solved(m, b).collect()


def test_streamed_losses(spark, tmp_path):
    """The windowed losses of a stream are those of the batch."""
    from quaylark.streaming.losses import windowed_losses

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_losses(stream).writeStream.outputMode("complete").format("memory").queryName("losses").trigger(availableNow=True).start()
    q.awaitTermination(60)
    same = lambda df: sorted((r["start"], r["iteration"], r["events"], round(r["total"], 4)) for r in df.collect())
    assert same(spark.table("losses")) == same(windowed_losses(rows))


def test_text_order(spark, tmp_path):
    """Rows follow the order of the files' names; an array goes on from file to file; blank lines don't count."""
    from quaylark.sources import delimited as d

    for i in (2, 0, 1):
        (tmp_path / f"part-{i}").write_text("".join(f"{10 * i + j},{10 * i + j + 0.5}\n\n" for j in range(4)))
    want = [x for i in range(3) for j in range(4) for x in (10 * i + j, 10 * i + j + 0.5)]
    assert [r["value"] for r in d.load_array(spark, str(tmp_path)).orderBy("idx").collect()] == want
    assert [r["value"] for r in d.load_array(spark, str(tmp_path), drop_rows=5).orderBy("idx").collect()] == want[10:]
    assert [r["value"] for r in d.load_matrix(spark, str(tmp_path)).where("col = 0").orderBy("row").collect()] == want[::2]
