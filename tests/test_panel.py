import datetime as dt
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkiln import queries as Q
from panelkiln.functions import quantiles as quantiles_
from panelkiln.sources import scratch
from panelkiln.operators import audit, prune, scorecard, validation
from panelkiln.plans import library
from panelkiln.plans.compile import Plan, evaluate, to_sql
from panelkiln.plans.expr import adv, field, indneutralize, num, parse, rank, scale, timed, where, winsorize, zscore
from panelkiln.sources import panel as P

SF = "/root/testdata/sf0.001"
T = pd.Timestamp("2020-01-01")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_panel(spark, seed=0, names=12, days=40):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(names):
        for d in range(days):
            x, y = (None if rng.random() < 0.08 else float(v) for v in (rng.integers(0, 6), rng.normal()))
            rows.append((p, d // 15, dt.date(2020, 1, 1) + dt.timedelta(d), x, y, float(rng.integers(1, 4)), None if p == 0 else p % 3))
    schema = "permno long, segment_id int, date date, x double, y double, z double, sic2 int"
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def values(spark_df, name="v"):
    return {(r.permno, r.date): r[name] for r in spark_df.collect()}


def close_to(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        if w is None or (isinstance(w, float) and math.isnan(w)):
            assert g is None, (k, g)
        else:
            assert g is not None and g == pytest.approx(w, abs=1e-8), (k, g, w)


def trailing(pdf, f, d):
    out = {}
    for _, g in pdf.groupby(["permno", "segment_id"]):
        g = g.sort_values("date")
        for i in range(len(g)):
            w = g.iloc[max(0, i - d + 1) : i + 1]
            v = f(w) if len(w) == d else None
            out[(int(g.permno.iloc[i]), g.date.iloc[i])] = v
    return out


def guarded(cols, f):
    return lambda w: None if w[cols].isna().any().any() else f(w)


def corr(w):
    x, y = w.x.to_numpy(), w.z.to_numpy()
    return None if x.std() < 1e-12 or y.std() < 1e-12 else float(np.corrcoef(x, y)[0, 1])


@pytest.mark.parametrize(
    "node, cols, f",
    [
        ("sum(x, 4)", ["x"], lambda w: w.x.sum()),
        ("ts_mean(x, 4)", ["x"], lambda w: w.x.mean()),
        ("ts_min(x, 4)", ["x"], lambda w: w.x.min()),
        ("ts_max(x, 4)", ["x"], lambda w: w.x.max()),
        ("stddev(x, 4)", ["x"], lambda w: w.x.std(ddof=1)),
        ("product(x, 4)", ["x"], lambda w: w.x.prod()),
        ("ts_rank(x, 4)", ["x"], lambda w: (w.x <= w.x.iloc[-1]).mean()),
        ("ts_argmax(x, 4)", ["x"], lambda w: float(3 - np.argmax(w.x.to_numpy()))),
        ("ts_argmin(x, 4)", ["x"], lambda w: float(3 - np.argmin(w.x.to_numpy()))),
        ("decay_linear(x, 4)", ["x"], lambda w: np.average(w.x, weights=[1, 2, 3, 4])),
        ("covariance(x, z, 4)", ["x", "z"], lambda w: np.cov(w.x, w.z)[0, 1]),
        ("correlation(x, z, 4)", ["x", "z"], corr),
    ],
)
def test_time_operators(spark, node, cols, f):
    df, pdf = random_panel(spark)
    close_to(values(evaluate(df, {"v": parse(node)})), trailing(pdf, guarded(cols, f), 4))


def test_delay_and_delta(spark):
    df, pdf = random_panel(spark)
    pdf = pdf.sort_values(["permno", "date"])
    lag = pdf.groupby(["permno", "segment_id"]).x.shift(3)
    close_to(values(evaluate(df, {"v": parse("delay(x, 3)")})), dict(zip(zip(pdf.permno, pdf.date), lag)))
    close_to(values(evaluate(df, {"v": parse("delta(x, 3)")})), dict(zip(zip(pdf.permno, pdf.date), pdf.x - lag)))


def test_cross_section_operators(spark):
    df, pdf = random_panel(spark)
    by = pdf.groupby("date")
    key = list(zip(pdf.permno, pdf.date))
    cases = {
        "rank": (rank(field("x")), by.x.rank(pct=True)),
        "scale": (scale(field("y"), 2), pdf.y / by.y.transform(lambda s: s.abs().sum()) * 2),
        "zscore": (zscore(field("y")), (pdf.y - by.y.transform("mean")) / by.y.transform("std")),
        "winsorize": (winsorize(field("y"), (0.1, 0.9)), by.y.transform(lambda s: s.clip(s.quantile(0.1), s.quantile(0.9)))),
        "indneutralize": (indneutralize(field("y")), (pdf.y - pdf.groupby(["date", "sic2"]).y.transform("mean")).where(pdf.sic2.notna())),
    }
    out = evaluate(df, {k: n for k, (n, _) in cases.items()}).collect()
    for k, (_, want) in cases.items():
        close_to({(r.permno, r.date): r[k] for r in out}, dict(zip(key, want)))


def test_missing_value_rules(spark):
    df = frame(spark, [(1, 0, dt.date(2020, 1, d), a, b) for d, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, None), (None, 0.0), (4.0, 2.0)], 1)], "permno long, segment_id int, date date, a double, b double")
    out = {r.date.day: r for r in evaluate(df, {"div": parse("a / b"), "log": parse("log(a)"), "pow": parse("a ^ b"), "lt": parse("a < b"), "tern": parse("a < b ? 1 : 2"), "mx": parse("max(a, b)"), "neg": parse("(a < b) * -1")}).collect()}
    assert [out[d].div for d in range(1, 7)] == [math.inf, -math.inf, None, None, None, 2.0]
    assert [out[d].log for d in (1, 2, 3, 5)] == [0.0, None, -math.inf, None]
    assert [out[d]["pow"] for d in range(1, 7)] == [1.0, 1.0, 1.0, 1.0, 1.0, 16.0]
    assert [out[d]["lt"] for d in range(1, 7)] == [0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert [out[d].tern for d in (2, 4)] == [1.0, 2.0]
    assert [out[d].mx for d in (4, 5, 6)] == [None, None, 4.0]


def test_infinities_are_ranked(spark):
    df = frame(spark, [(i, 0, dt.date(2020, 1, 1), float(i % 3), 0.0 if i > 3 else 1.0) for i in range(6)], "permno long, segment_id int, date date, a double, b double")
    got = {r.permno: r.v for r in evaluate(df, {"v": rank(field("a") / field("b"))}).collect()}
    assert got[3] == pytest.approx(1.5 / 6) and got[4] == pytest.approx(5.5 / 6) and got[5] == pytest.approx(5.5 / 6)


def test_no_look_ahead_and_no_bleed(spark):
    df, pdf = random_panel(spark, 3)
    node = parse("ts_rank(correlation(rank(x), rank(z), 4), 3)")
    whole = values(evaluate(df, {"v": node}))
    cut = values(evaluate(df.where("date <= '2020-01-25'"), {"v": node}))
    assert all(whole[k] == v for k, v in cut.items())


def test_kernels_agree_with_windows(spark, monkeypatch):
    """All operators, with nulls, infinities, ties and groups across batches."""
    from panelkiln.plans import kernels

    monkeypatch.setattr(kernels, "ROWS", 50), monkeypatch.setattr(kernels, "CELLS", 64)
    df, _ = random_panel(spark, 8, names=9, days=31)
    formulas = ["sum(x, 3)", "ts_mean(y, 3)", "ts_min(x, 3)", "ts_max(y, 3)", "stddev(x, 3)", "product(y, 3)", "ts_rank(x, 4)", "ts_argmax(x, 4)", "ts_argmin(x, 4)", "decay_linear(y, 3)", "covariance(x, y, 4)", "correlation(x, z, 4)", "delay(x, 2)", "delta(y, 2)"]
    formulas += ["rank(x)", "rank(y / (x - 2))", "scale(y)", "indneutralize(y, IndClass.industry)", "log(x)", "x ^ y", "signedpower(y, 0.5)", "max(x, y)", "min(x, z)", "sign(y)", "abs(y)", "sqrt(x)", "nonzero(x)", "finite(y / x)", "x < y ? x : y", "(x == 2 || y < 0) * -1", "z + 1", "x"]
    formulas += ["ts_max(rank(correlation(rank(x), rank(z), 3)), 3)", "rank(delta(log(x), 1))", "ts_rank(rank(ts_sum_of) , 2)".replace("ts_sum_of", "sum(y, 2)")]
    nodes = {f"f{i}": parse(f) for i, f in enumerate(formulas)} | {"zs": zscore(field("y")), "wi": winsorize(field("y"), (0.2, 0.8))}
    a, b = (evaluate(df, nodes, kernels=k).collect() for k in (False, True))
    a, b = ({(r.permno, r.date): r for r in x} for x in (a, b))
    for name in nodes:
        close_to({k: r[name] for k, r in b.items()}, {k: r[name] for k, r in a.items()})


def test_expressions_are_interned_and_levelled():
    assert parse("rank(volume) + 1") is parse("rank(volume)+1")
    assert adv(20) is parse("adv20")
    with pytest.raises(ValueError):
        timed("ts_sum", field("x"), 0.5)
    with pytest.raises(ValueError):
        parse("rank(volume")
    with pytest.raises(ValueError):
        parse("nosuch(volume)")
    plan = Plan(library.alpha_features())
    assert len(library.alpha_features()) == 90 and max(p for p, _ in plan.steps) == 5


def test_one_exchange_for_each_phase(spark):
    df, _ = random_panel(spark)
    plan = evaluate(df, {f"v{i}": parse(f"correlation(rank(x), rank(y), {i})") for i in (3, 4, 5)}, kernels=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_each_phase_goes_to_the_cheaper_executor(spark, monkeypatch):
    from pyspark.sql import functions as F

    from panelkiln.plans import costs

    def phases(df, nodes, **k):
        plan = evaluate(df, nodes, **k)._jdf.queryExecution().executedPlan().toString()
        return plan.count("MapInArrow"), plan.count("Window [")

    df, _ = random_panel(spark, 3, names=6, days=30)
    df = df.repartition(2)
    cheap = {"v": parse("ts_mean(x, 3)")}
    wide = {f"v{i}": parse(f"ts_rank(rank(x + {i}), 14)") for i in range(6)}
    assert phases(df, cheap)[0] == 0
    assert phases(df, wide) == (2, 0)
    assert phases(df, {"v": parse("delay(rank(x), 2)"), **{f"r{i}": rank(field("y") + i) for i in range(6)}})[0] == 1  # ranks pay, the lag doesn't
    a, b, c = ({(r.permno, r.date): tuple(r) for r in evaluate(df, wide, kernels=k, at_most=n).collect()} for k, n in ((None, None), (False, None), (None, costs.GROUP_ROWS + 1)))
    assert a == b == c and len(a) == df.count()
    assert phases(df, wide, at_most=costs.GROUP_ROWS + 1)[0] == 0 and phases(df, wide, at_most=30)[0] == 2
    assert phases(df.withColumn("x", F.col("x").cast("decimal(10, 2)")), wide)[0] == 0
    assert phases(df.withColumn("permno", F.when(F.col("permno") > 2, F.col("permno"))), wide)[0] == 0  # null keys
    assert costs.counting(df) == costs.STORED and costs.counting(df.groupBy("permno", "date").count()) == costs.DERIVED
    monkeypatch.setattr(costs, "GROUP_ROWS", 10)  # dates of 6 names fit, histories of 30 days don't
    found = phases(df, wide)
    assert found[0] == 1 and found[1] >= 1
    assert {(r.permno, r.date): tuple(r) for r in evaluate(df, wide).collect()} == b
    assert evaluate(df.where("false"), wide).count() == 0


def test_reentries(spark):
    from panelkiln.operators import audit

    df = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, 0), (3, None), (3, 0), (None, 0), (None, 1)], "permno long, segment_id int")
    assert sorted((r.permno or 0, r.n_segments) for r in audit.reentries(df).collect()) == [(0, 2), (1, 2)]
    assert audit.reentries(df.where("false")).count() == 0


def test_segments_labels_and_gaps(spark):
    days = [1, 2, 12, 23]  # gaps of 1, 10 and 11 days
    df = frame(spark, [(1, dt.date(2020, 1, d), float(d), 1.0, 1.0) for d in days], "permno long, date date, close double, high double, low double")
    got = {r.date.day: (r.segment_id, r.fwd_ret_1d) for r in P.prepare(df, horizons=(1,)).collect()}
    assert [got[d][0] for d in days] == [0, 0, 0, 1]
    assert [got[d][1] for d in days] == [1.0, 5.0, None, None]


def test_load_panel(spark, tmp_path):
    row = dict(permno=1, ticker="A", ret=0.1, turnover=1.0, sic2=1, volume=1.0, open=1.0, high=1.0, low=1.0, shrout=1.0)
    rows = [row | dict(date=f"{y}-06-01", mcap=m, close=c, permno=p) for y in (2018, 2019, 2020) for p, m, c in ((1, 5.0, 1.0), (2, 5.0, 2.0), (3, 9.0, float("nan")), (4, 1.0, 1.0))]
    spark.createDataFrame(pd.DataFrame(rows)).write.parquet(str(tmp_path / "p"))
    got = P.load_panel(spark, str(tmp_path / "p"), top_n=1, lookback_years=2).collect()
    assert sorted((r.permno, r.date.year) for r in got) == [(1, 2019), (1, 2020)]
    spark.createDataFrame([(1,)], "permno long").write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError, match="lacks columns"):
        P.load_panel(spark, str(tmp_path / "q"))


def test_sinks(spark, tmp_path):
    df = frame(spark, [(1, dt.date(2020, 1, 1), 1.5), (1, dt.date(2021, 1, 1), 2.5)], "permno long, date date, v double")
    P.write_by_year(df, str(tmp_path / "y"), single=True)
    assert dict(spark.read.parquet(str(tmp_path / "y")).dtypes)["v"] == "float"
    df.write.parquet(str(tmp_path / "a_b__5d__preds.parquet"))
    got = P.read_runs(spark, str(tmp_path / "*__preds.parquet")).first()
    assert (got["config"], got["horizon"]) == ("a_b", 5)
    P.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_saved_runs(spark, tmp_path):
    df = frame(spark, [("a", "rank", 2020), ("a", "standardize", 2020), ("b", "rank", 2021), ("b", "standardize", 2020)], "config string, scheme string, test_year int")
    assert P.saved_runs(df, ["a"], ["rank", "standardize"]).count() == 2
    with pytest.raises(ValueError, match="disagree"):
        P.saved_runs(df, ["b"], ["rank", "standardize"])
    with pytest.raises(FileNotFoundError):
        P.saved_runs(df, ["c"], ["rank"])
    with pytest.raises(FileNotFoundError):
        P.load_panel(spark, str(tmp_path / "none"))
    P.write_csv(df, str(tmp_path / "r"))
    assert P.read_csv(spark, str(tmp_path / "r"), "config string, scheme string, test_year int", ["scheme", "test_year"]).columns == ["scheme", "test_year"]


def preds_frame(spark, seed=1, names=23, days=12):
    rng = np.random.default_rng(seed)
    rows = [(2020 + d // 6, dt.date(2020 + d // 6, 1, 1 + d % 6), p, float(rng.normal()), float(rng.integers(0, 9)) if d != 3 else 1.0) for d in range(days) for p in range(names)]
    schema = "test_year int, date date, permno long, y double, yhat double"
    return spark.createDataFrame(rows, schema), pd.DataFrame(rows, columns=["test_year", "date", "permno", "y", "yhat"])


def test_daily_ic(spark):
    df, pdf = preds_frame(spark)
    got = {r.date: r.ic for r in scorecard.daily_ic(df).collect()}
    for d, g in pdf.groupby("date"):
        want = g.y.rank().corr(g.yhat.rank()) if g.yhat.nunique() > 1 else None
        assert got[d] is None if want is None else got[d] == pytest.approx(want)


@pytest.mark.parametrize("n", [9, 10, 11, 23, 91])
def test_deciles(spark, n):
    df, pdf = preds_frame(spark, names=n, days=6)
    got = {r.date: r for r in scorecard.decile_portfolio(df, horizon=2).collect()}
    want = {}
    for i, (d, g) in enumerate(pdf.groupby("date")):
        if i % 2 == 0 and n >= 10 and g.yhat.nunique() > 1:
            g = g.sort_values(["yhat", "permno"]).reset_index(drop=True)
            cut = np.maximum(1, np.ceil(np.arange(n) * 10 / (n - 1)))
            want[d] = g.y.groupby(cut).mean()
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert [got[d][f"decile_{k}"] for k in range(1, 11)] == pytest.approx(list(w))
        assert got[d].long_short == pytest.approx(w[10] - w[1])
    with pytest.raises(ValueError):
        scorecard.decile_portfolio(df, horizon=2, offset=2)


def test_empty_predictions(spark):
    df, _ = preds_frame(spark)
    none = df.where("false")
    assert scorecard.decile_portfolio(none).columns[-1] == "long_short" and scorecard.decile_portfolio(none).count() == 0
    assert scorecard.ic_by_year(none).count() == 0
    assert scorecard.scorecard({"a": (none, 1)}).first().n_active_years == 0


def test_stress_windows_have_explicit_rows(spark):
    ic = frame(spark, [(2020, 0.1), (2021, None)], "test_year int, ic double")
    sh = frame(spark, [(2020, 1.0)], "test_year int, sharpe double")
    got = {r.window: r for r in scorecard.stress_windows(spark, ic, sh, {"a": (2019, 2020), "b": (2021, 2021), "c": (2008, 2008)}).collect()}
    assert (got["a"].years_covered, got["a"].mean_gross_sharpe) == ([2020], 1.0)
    assert (got["b"].n_years, got["b"].mean_ic) == (1, None) and got["c"].n_years == 0


def test_ablation_needs_the_same_years(spark):
    d = frame(spark, [("c", "rank", 2020, 0.1, 0.2, 3), ("c", "standardize", 2021, 0.1, 0.2, 0)], "config string, scheme string, test_year int, pearson_ic double, daily_spearman_ic double, n_nonzero_coefs long")
    with pytest.raises(ValueError):
        scorecard.ablation_summary(d)


def test_mean_daily_spearman_and_greedy(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(6):
        for p in range(40 if d else 5):
            a = float(rng.normal())
            rows.append((dt.date(2020, 1, 1 + d), p, a, None if rng.random() < 0.1 else a + float(rng.normal()) * 0.1, float(rng.integers(0, 3))))
    pdf = pd.DataFrame(rows, columns=["date", "permno", "a", "b", "c"])
    df = spark.createDataFrame(rows, "date date, permno long, a double, b double, c double")
    got = {(r.f1, r.f2): r.rho for r in prune.mean_daily_spearman(df, ["a", "b", "c"]).collect()}
    want = sum(g[["a", "b", "c"]].rank().corr() for _, g in pdf.groupby("date") if len(g) >= 30) / 5
    for i in "abc":
        for j in "abc":
            assert got[i, j] == pytest.approx(want.loc[i, j])
    m = np.array([[1, 0.9, 0.5], [0.9, 1, 0.1], [0.5, 0.1, 1]])
    assert prune.greedy_drop(m, ["a", "b", "c"], 0.7) == (["b", "c"], [{"feature": "a", "rho": 0.9, "with": "b"}])
    assert prune.greedy_drop(np.array([[1, 0.8], [0.8, 1]]), ["a", "b"], 0.7)[0] == ["a"]
    assert prune.greedy_drop(np.array([[1, np.nextafter(0.8, 0)], [0.8, 1]]), ["b", "a"], 0.7)[0] == ["a"]
    config = prune.prune(df, ["a", "b", "c"])
    assert config["n_keep"] == 2 and config["low_coverage_dropped"] == []


def test_coverage(spark):
    df = frame(spark, [(1.0, None), (None, None), (float("inf"), None), (2.0, 1.0)], "a double, b double")
    assert {r.feature: r.coverage for r in prune.coverage(df, ["a", "b"]).collect()} == {"a": 0.5, "b": 0.25}


def test_split_table_purges(spark):
    days = pd.bdate_range("2015-01-01", "2020-12-31")
    df = spark.createDataFrame(pd.DataFrame({"date": days.date}))
    splits = validation.split_table(df, min_test_year=2019, val_years=2)
    validation.check_disjoint(splits)
    with pytest.raises(ValueError, match="overlap"):
        validation.check_disjoint(splits.unionByName(splits.where("role = 'test'").withColumn("role", F.lit("val"))))
    got = splits.toPandas()
    assert set(got.test_year) == {2019, 2020}
    one = got[got.test_year == 2019]
    train, val, test = (set(one[one.role == r].date) for r in ("train", "val", "test"))
    assert not train & val and not val & test
    before = sorted(d for d in days.date if d.year < 2017)
    assert train == set(before[:-5]) and len([d for d in days.date if d.year in (2017, 2018)]) - len(val) == 5


def synthetic(spark):
    rng = np.random.default_rng(0)
    days = pd.bdate_range("2015-01-01", "2022-12-31")
    x = rng.normal(size=(len(days), 3))
    pdf = pd.DataFrame({"date": days.date, "permno": 1, "x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], "y": 2 * x[:, 0] + rng.normal(size=len(days)) * 0.5})
    return spark.createDataFrame(pdf), pdf


def test_walk_forward_finds_the_signal(spark):
    df, _ = synthetic(spark)
    run = validation.walk_forward(df, ["x1", "x2", "x3"], "y", min_test_year=2019, max_test_year=2022)
    assert sorted(run.fits) == [2019, 2020, 2021, 2022]
    assert all(f.coef[0] == pytest.approx(2, abs=0.1) and abs(f.coef[1]) < 0.1 for f in run.fits.values())
    assert all(r.ic > 0.9 for r in scorecard.pooled_pearson_by_year(run.preds).collect())
    assert run.coefs.count() == 12 and run.params.count() == 4
    std = validation.walk_forward(df, ["x1", "x2", "x3"], "y", min_test_year=2022, max_test_year=2022, normalize="standardize")
    assert scorecard.pooled_pearson_by_year(std.preds).first().ic > 0.9
    with pytest.raises(ValueError):
        validation.walk_forward(df, list(library.INTERACTIONS), "y", min_test_year=2022, max_test_year=2022, normalize="standardize")


def test_folds_follow_the_data(spark, tmp_path):
    """Every year with years for both blocks before it is tested, whenever the bars begin."""
    from panelkiln.operators.queries import QUERIES

    df, _ = synthetic(spark)
    assert sorted(validation.walk_forward(df, ["x1", "x2", "x3"], "y", n_alphas=2).fits) == list(range(2017, 2023))
    assert not validation.walk_forward(df.where("false"), ["x1"], "y", n_alphas=2).fits
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_shipdate", F.col("l_shipdate") - F.expr("interval 10 years")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SF}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    years = {r.test_year for r in QUERIES["elastic_net_coefficients"][0](spark, str(tmp_path)).collect()}
    assert years == set(range(1987, 1992))


def test_elastic_net_against_the_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df, pdf = synthetic(spark)
    x, y = pdf[["x1", "x2", "x3"]].to_numpy(), pdf.y.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    alpha, l1 = 0.3, 0.6
    g, c = xc.T @ xc / len(x), xc.T @ yc / len(x)
    b = validation.elastic_net(g, c, alpha, l1, np.zeros(3))
    slope = c - g @ b - alpha * (1 - l1) * b  # the optimality conditions of the objective
    assert all(s == pytest.approx(alpha * l1 * np.sign(v), abs=1e-9) if v else abs(s) <= alpha * l1 for s, v in zip(slope, b))
    reg = alpha * l1 + alpha * (1 - l1) * y.std(ddof=1)
    model = LinearRegression(labelCol="y", regParam=reg, elasticNetParam=alpha * l1 / reg, standardization=False, tol=1e-12, maxIter=500).fit(VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(df))
    assert b == pytest.approx(list(model.coefficients), rel=2 / len(x))  # it scales by the sample's deviation


def test_alpha_grid_starts_at_the_null_model():
    rng = np.random.default_rng(1)
    g = np.eye(3)
    c = rng.normal(size=3)
    grid = validation.alpha_grid(c, 0.5)
    assert not validation.elastic_net(g, c, grid[0] * 1.0001, 0.5, np.zeros(3)).any()
    assert len(grid) == 30 and grid[-1] == pytest.approx(grid[0] * 1e-4)


def test_feature_configs():
    base = [*library.BASELINE, *library.INTERACTIONS]
    got = validation.feature_configs(base, ["p", "q"], ["q"])
    assert got["a_baseline"] == list(library.BASELINE) and got["c_pruned"] == ["q"]
    with pytest.raises(ValueError):
        validation.feature_configs(base, ["p"], ["q"])


def test_model_frame_and_suite(spark, tmp_path):
    panel = P.forward_returns(P.bars_from_lines(spark, SF))
    df, base, pool = validation.model_frame(panel, numbers=[41, 101], min_coverage=0.5)
    assert "alpha_101" in pool and "mom_12_1" in base
    out = str(tmp_path / "runs")
    runs = validation.run_suite(df, {"two": ["alpha_101", "oc_ret"], "one": ["oc_ret", "rev_1d_x_rev_5d"]}, horizons=(1,), min_test_year=1999, max_test_year=1999, n_alphas=3, out=out)
    assert runs["two__1d"].preds.count() > 0
    saved = {k: spark.read.parquet(f"{out}/{k}") for k in ("preds", "coefs", "params")}
    assert {(r.config, r.horizon) for r in saved["preds"].select("config", "horizon").distinct().collect()} == {("two", 1), ("one", 1)}
    assert saved["coefs"].count() == 4 and saved["params"].count() == 2


def written_panel(spark, tmp_path, years=(2015, 2019), names=35, seed=3):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range(f"{years[0]}-01-01", f"{years[1]}-12-31")[::4]
    parts = []
    for p in range(names):
        close = 20 * np.exp(np.cumsum(rng.normal(size=len(days)) * 0.02))
        parts.append(pd.DataFrame({"permno": p, "ticker": f"T{p}", "date": days.date, "ret": np.append(np.nan, close[1:] / close[:-1] - 1), "mcap": close * (p + 1), "turnover": 1.0, "sic2": p % 3, "volume": rng.integers(1, 9, len(days)) * 1e3, "open": close * 0.99, "high": close * 1.02, "low": close * 0.98, "close": close, "shrout": p + 1.0}))
    path = str(tmp_path / "panel")
    spark.createDataFrame(pd.concat(parts)).write.parquet(path)
    return path


def test_frames_by_year(spark, tmp_path, monkeypatch):
    """Years made one by one equal the whole, but for what a longer past would show; what is there is not made again."""
    path, out = written_panel(spark, tmp_path), str(tmp_path / "frames")
    args = dict(start_year=2016, end_year=2017, warmup_years=1, numbers=[12, 101], min_coverage=0.0)
    got, base, pool = validation.model_frame_by_year(spark, path, out, **args)
    whole, _, _ = validation.model_frame(P.prepare(P.load_panel(spark, path, end_year=2017), horizons=(1, 5)), numbers=[12, 101], min_coverage=0.0)
    columns = ["segment_id", "fwd_ret_1d", "rev_5d", "alpha_012", "alpha_101", "ret_21d"]
    a, b = (t.where("year(date) >= 2016").select("permno", "date", *columns).toPandas().sort_values(["permno", "date"]).reset_index(drop=True) for t in (got, whole))
    assert len(a) == len(b) > 3000 and dict(got.dtypes)["alpha_101"] == "float"
    for c in columns:
        assert np.allclose(a[c].astype(float), b[c].astype(float), atol=1e-5, equal_nan=True), c
    few = validation.model_frame_by_year(spark, path, out, **args, top_n=8)[0]  # other parameters, other frames
    assert few.groupBy("date").count().agg(F.max("count")).first()[0] == 8 and validation.model_frame_by_year(spark, path, out, **args, horizons=(1,))[0].columns.count("fwd_ret_5d") == 0
    loader, n = P.load_panel, got.count()
    monkeypatch.setattr(validation, "load_panel", None)
    assert validation.model_frame_by_year(spark, path, out, **args)[0].count() == n
    # a write that was killed: no mark, a rest of a file
    monkeypatch.setattr(validation, "load_panel", loader)
    year = next(p for p in (tmp_path / "frames").rglob("year=2017*") if "fwd_ret_5d" in spark.read.parquet(str(p)).columns and spark.read.parquet(str(p)).count() > 1500)
    rows = spark.read.parquet(str(year)).count()
    for f in year.iterdir():
        f.unlink()
    (year / "_temporary").mkdir()
    assert validation.model_frame_by_year(spark, path, out, **args)[0].count() == n and spark.read.parquet(str(year)).count() == rows


def test_scratch_is_empty_after_its_scope(spark):
    with scratch.scope(spark) as own:
        df = scratch.settled(spark.range(5), "five")
        assert df.count() == 5 and scratch.exists(spark, own)
    assert not scratch.exists(spark, own)
    with pytest.raises(ZeroDivisionError), scratch.scope(spark) as own:
        scratch.settled(spark.range(5))
        raise ZeroDivisionError
    assert not scratch.exists(spark, own)


def test_run_prune(spark, tmp_path):
    path, out = written_panel(spark, tmp_path, (2015, 2015)), str(tmp_path / "c.json")
    config = prune.run_prune(spark, path, out, start_year=2015, end_year=2015, top_n=32, numbers=[9, 12, 41, 101])
    assert config["top_n"] == 32 and config["never_val_test_years"] == [2015] and config["keep"] == sorted(config["keep"]) == prune.load_keep(out)
    assert config["n_rows"] == 32 * len(pd.bdate_range("2015-01-01", "2015-12-31")[::4])


def test_greedy_drop_leaves_no_close_pair():
    rng = np.random.default_rng(7)
    for k in range(30):
        x = rng.normal(size=(40, 12)) + rng.normal(size=(40, 1)) * rng.uniform(0, 2, 12)
        m = np.corrcoef(x.T)
        m[0, 5] = m[5, 0] = np.nan
        names = [f"f{i:02d}" for i in rng.permutation(12)]
        kept, gone = prune.greedy_drop(m, names, 0.5)
        at = [names.index(f) for f in kept]
        left = np.abs(m[np.ix_(at, at)])[np.triu_indices(len(at), 1)]
        assert not (left >= 0.5).any() and len(kept) + len(gone) == 12
        assert [g["rho"] for g in gone] == sorted((g["rho"] for g in gone), reverse=True)
        alive = set(names)
        for g in gone:  # each was closer on average to all that were left
            a, b = names.index(g["feature"]), names.index(g["with"])
            mean = [np.nanmean([abs(m[f, names.index(o)]) for o in alive if names.index(o) != f]) for f in (a, b)]
            assert mean[0] > mean[1] - 1e-12 and {g["feature"], g["with"]} <= alive
            alive.remove(g["feature"])


def test_heatmap_orders_like_features():
    m = np.array([[1, 0.1, 0.9], [0.1, 1, 0.2], [0.9, 0.2, 1]])
    cells = prune.heatmap(m, ["a", "b", "c"])
    assert len(cells) == 9 and abs([f for r, _, f, _, _ in cells if r < 9].index("a") - [f for r, _, f, _, _ in cells].index("c")) == 3


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.integers(0, 3, 3000).astype(float), "c": np.where(rng.random(3000) < 0.9, 7.0, rng.normal(size=3000)), "d": np.nan})
    df = spark.createDataFrame(pdf).select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf)).repartition(3)
    probs = (0.0, 0.005, 0.3, 0.5, 0.995, 1.0)
    got = quantiles_.quantiles(df, list(pdf), probs)
    for c in "abc":
        assert got[c] == pytest.approx(list(np.quantile(pdf[c], probs))), c
    assert got["d"] == [None] * len(probs)
    d = audit.differences(spark.createDataFrame(pd.DataFrame({"x": pdf.a})), {"x": (F.col("x"), F.lit(0.0))}).first()
    assert (d.median_abs, d.p99_abs) == pytest.approx(tuple(np.quantile(np.abs(pdf.a), (0.5, 0.99))))


def dense(x, y):
    z = np.column_stack([np.ones(len(x)), x, y])
    return validation.Stats(z.T @ z)


def test_standardized_folds_by_hand(spark):
    """Limits and moments of labelled, purged training rows for the search, of both blocks for the refit and the test."""
    rng = np.random.default_rng(4)
    days = pd.bdate_range("2016-01-01", "2019-12-31")[::2]
    pdf = pd.DataFrame({"date": np.repeat(days.date, 4), "permno": np.tile(range(4), len(days))})
    n = len(pdf)
    pdf["a"], pdf["b"] = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n) * 3 + 5), rng.standard_t(2, size=n)
    pdf["y"] = np.where(rng.random(n) < 0.1, np.nan, 0.3 * np.nan_to_num(pdf.a, nan=5.0) - 0.2 * pdf.b + rng.normal(size=n))
    df = spark.createDataFrame(pdf).select("date", "permno", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in "aby"))
    run = validation.walk_forward(df, ["a", "b"], "y", min_test_year=2018, normalize="standardize", n_alphas=6)
    assert sorted(run.fits) == [2018, 2019]
    preds = {(r.test_year, r.date, r.permno): r.yhat for r in run.preds.collect()}
    rows = pdf[pdf.y.notna()]
    year = pd.to_datetime(rows.date).dt.year
    assert len(preds) == (year >= 2018).sum()
    for t in (2018, 2019):
        purged = []
        for own in (year < t - 1, year == t - 1):
            last = sorted(rows.date[own].unique())[-5:]
            purged.append(own & ~rows.date.isin(last))
        train, val = purged

        def scaled(fitted, used):
            x = rows.loc[fitted, ["a", "b"]].to_numpy()
            lo, hi = np.nanpercentile(x, 0.5, axis=0), np.nanpercentile(x, 99.5, axis=0)
            c = np.clip(x, lo, hi)
            return np.nan_to_num((np.clip(rows.loc[used, ["a", "b"]].to_numpy(), lo, hi) - np.nanmean(c, 0)) / np.nanstd(c, 0))

        fit = validation.fit_fold(dense(scaled(train, train), rows.y[train]), dense(scaled(train, val), rows.y[val]), refit=dense(scaled(train | val, train | val), rows.y[train | val]), n_alphas=6)
        assert (run.fits[t].alpha, run.fits[t].l1_ratio) == pytest.approx((fit.alpha, fit.l1_ratio)) and run.fits[t].coef == pytest.approx(fit.coef)
        test = year == t
        want = fit.intercept + scaled(train | val, test) @ fit.coef
        assert [preds[t, d, p] for d, p in zip(rows.date[test], rows.permno[test])] == pytest.approx(list(want))


def test_any_model_in_yearly_folds(spark):
    df, _ = synthetic(spark)
    run = validation.yearly_folds(df, validation.toy_fit, ["x1", "x2"], "y", min_test_year=2021, strengths=(0.001, 0.1))
    assert all(r.ic > 0.9 for r in scorecard.pooled_pearson_by_year(run.preds).collect()) and run.preds.select("test_year").distinct().count() == 2
    coef = {(r.test_year, r.feature): r.coef for r in run.coefs.collect()}
    assert coef[2022, "x1"] == pytest.approx(2, abs=0.1) and abs(coef[2022, "x2"]) < 0.1
    own = validation.walk_forward(df, ["x1"], "y", min_test_year=2022, fit=lambda train, val, refit=None: validation.Fit(np.array([3.0]), 1.0, 0.0, 0.0, 0.0))
    r = own.preds.join(df, ["date", "permno"]).first()
    assert r.yhat == pytest.approx(1 + 3 * r.x1)


def test_reports_over_years_without_runs(spark):
    df, _ = preds_frame(spark)
    one = scorecard.run_summary(df, years=range(2019, 2023)).first()
    two = scorecard.run_summary(df).first()
    assert one.mean_ic_active == pytest.approx(two.mean_ic_active) and one.mean_ic_all_years == pytest.approx(two.mean_ic_all_years / 2)
    coefs = frame(spark, [(2020, "a", 1.0), (2020, "b", 0.0), (2021, "a", 0.0)], "test_year int, feature string, coef double")
    params = frame(spark, [(2020, 0.1, 0.5, 1.0), (2021, 0.2, 1.0, 2.0)], "test_year int, alpha double, l1_ratio double, val_mse double")
    got = {r.test_year: (r.l1_ratio, r.n_nonzero) for r in scorecard.tuning_complexity(params, coefs, range(2019, 2022)).collect()}
    assert got == {2019: (None, None), 2020: (0.5, 1), 2021: (1.0, 0)}
    assert {r.test_year: r.n_nonzero for r in scorecard.nonzero_by_year(coefs, [2019, 2020]).collect()} == {2019: 0, 2020: 1}
    assert scorecard.coefficient_stability(coefs, 1, [2020, 2021, 2022]).count() == 3
    curves = scorecard.run_curves({"x": (df, 1), "y": (df, 1)})
    assert [t.columns[0] for t in curves] == ["run"] * 3 and curves[0].count() == 4 and curves[2].count() == 20
    wide = scorecard.stress_pivot(frame(spark, [("c", 1, 2020, 0.1, 1.0), ("c", 1, 2021, 0.2, None)], "config string, horizon int, test_year int, ic double, gross_sharpe double"), [2020, 2021]).first()
    assert (wide["2020_ic"], wide["2021_ic"], wide["2021_gross_sharpe"]) == (0.1, 0.2, None)


@pytest.mark.parametrize("kernels", [False, True])
@pytest.mark.parametrize("size", [1e-12, 1e12])
def test_small_and_large_values(spark, size, kernels):
    """No operator loses digits, whatever the magnitude."""
    _, pdf = random_panel(spark, 5, names=6, days=20)
    pdf["x"], pdf["y"] = (pdf.x + 1) * size, pdf.y * size
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "permno long, segment_id int, date date, x double, y double, z double, sic2 double")
    by, key = pdf.groupby("date"), list(zip(pdf.permno, pdf.date))
    rolling = {"sum(y, 4)": lambda w: w.y.sum(), "ts_mean(y, 4)": lambda w: w.y.mean(), "stddev(y, 4)": lambda w: w.y.std(ddof=1), "product(x, 4)": lambda w: w.x.prod(), "decay_linear(y, 4)": lambda w: np.average(w.y, weights=[1, 2, 3, 4]), "covariance(x, y, 4)": lambda w: np.cov(w.x, w.y)[0, 1], "correlation(x, y, 4)": lambda w: np.corrcoef(w.x, w.y)[0, 1] if w.x.std() > 0 else None}
    want = {f: trailing(pdf, guarded(["x"] if "product" in f else ["x", "y"] if "(x, y" in f else ["y"], g), 4) for f, g in rolling.items()}
    nodes = {f: parse(f) for f in rolling} | {"mean": zscore(field("y")), "ind": indneutralize(field("y"))}
    want["mean"] = dict(zip(key, (pdf.y - by.y.transform("mean")) / by.y.transform("std")))
    want["ind"] = dict(zip(key, (pdf.y - pdf.groupby(["date", "sic2"]).y.transform("mean")).where(pdf.sic2.notna())))
    out = evaluate(df, {f"v{i}": n for i, n in enumerate(nodes.values())}, kernels=kernels).collect()
    for i, f in enumerate(nodes):
        for r in out:
            w, g = want[f][r.permno, r.date], r[f"v{i}"]
            if w is None or math.isnan(w):
                assert g is None, f
            else:
                assert g == pytest.approx(w, rel=1e-6, abs=(1e-9 if f == "ind" else 1e-8) * size ** (4 if "product" in f else 2 if "cov" in f else 0 if f in ("mean", "correlation(x, y, 4)") else 1)), (f, g, w)


def test_illiquidity_at_real_volumes(spark):
    """Mean of |return| over dollar volume: 1e-10 and less."""
    rng = np.random.default_rng(9)
    for dollars in (1e6, 1e8, 1e11):
        pdf = pd.DataFrame({"permno": 1, "segment_id": 0, "date": pd.bdate_range("2020-01-01", periods=60).date, "ret": rng.normal(size=60) * 0.02, "close": 10.0, "volume": dollars / 10 * rng.uniform(0.5, 2, 60)})
        want = (pdf.ret.abs() / (pdf.close * pdf.volume)).rolling(21).mean()
        got = {r.date: r.v for r in evaluate(spark.createDataFrame(pdf), {"v": library.classic_features()["amihud_21d"]}).collect()}
        for d, w in zip(pdf.date, want):
            assert got[d] is None if math.isnan(w) else got[d] == pytest.approx(w, rel=1e-8)


# The formulas by another evaluator: Python reads them, pandas computes them ----------------------------------------------


def to_python(text):
    """The published notation as a Python expression: ternaries become calls, ^ and || Python's signs."""

    def split(s, at):
        depth, parts, last = 0, [], 0
        for i, c in enumerate(s):
            depth += (c in "(") - (c in ")")
            if depth == 0 and c == at:
                parts.append(s[last:i])
                last = i + 1
        return [*parts, s[last:]]

    def inner(s):
        out, i = "", 0
        while i < len(s):
            if s[i] == "(":
                depth, j = 1, i + 1
                while depth:
                    depth += (s[j] == "(") - (s[j] == ")")
                    j += 1
                out += "(" + ", ".join(map(ternary, split(s[i + 1 : j - 1], ","))) + ")"
                i = j
            else:
                out += s[i]
                i += 1
        return out

    def ternary(s):
        head = split(s, "?")
        if len(head) == 1:
            return inner(s)
        a, b = split(s[len(head[0]) + 1 :], ":")
        return f"where({inner(head[0])}, {ternary(a)}, {ternary(b)})"

    return ternary(text.lower().replace("||", "|").replace("indclass.industry", "sic2")).replace("^", "**").strip()


def wide_functions(data):
    """The operators on tables of days by names."""
    like = next(iter(data.values()))
    table = lambda x: x.astype(float) if isinstance(x, pd.DataFrame) else like * 0 + x

    def rolled(f, *xs, d):
        d, out = int(d), like * np.nan
        for c in like:
            cols = [table(x)[c].to_numpy() for x in xs]
            for i in range(d - 1, len(like)):
                w = [x[i - d + 1 : i + 1] for x in cols]
                if not any(np.isnan(x).any() for x in w):
                    out.loc[out.index[i], c] = f(*w)
        return out

    def even(v, of=None):
        """v to ten digits of the magnitude it was formed from, so that ties don't hang on the last bit."""
        size = abs(v) if of is None else np.abs(of).max()
        return round(v / (step := 10.0 ** (np.floor(np.log10(size)) - 10))) * step if 0 < size < np.inf and np.isfinite(v) else v

    def corr(x, y):
        x, y = x - x.mean(), y - y.mean()
        sx, sy = np.sqrt((x * x).sum()), np.sqrt((y * y).sum())
        return round(float((x * y).sum() / (sx * sy)), 8) if sx > 1e-9 and sy > 1e-9 else np.nan

    lag = lambda x, d: table(x).shift(int(d))

    def neutral(x, by):
        x = table(x)
        return x - x.T.groupby(by.iloc[0]).transform("mean").T

    return {
        "rank": lambda x: table(x).rank(axis=1, pct=True),
        "scale": lambda x: table(x).div(table(x).abs().sum(axis=1), axis=0),
        "delay": lag, "delta": lambda x, d: table(x) - lag(x, d), "indneutralize": neutral,
        "sum": lambda x, d: rolled(lambda w: even(w.sum(), w), x, d=d), "product": lambda x, d: rolled(lambda w: even(w.prod()), x, d=d),
        "ts_mean": lambda x, d: rolled(lambda w: even(w.mean(), w), x, d=d), "stddev": lambda x, d: rolled(lambda w: even(w.std(ddof=1), w), x, d=d),
        "ts_min": lambda x, d: rolled(np.min, x, d=d), "ts_max": lambda x, d: rolled(np.max, x, d=d),
        "ts_rank": lambda x, d: rolled(lambda w: (w <= w[-1]).mean(), x, d=d),
        "ts_argmax": lambda x, d: rolled(lambda w: len(w) - 1 - np.argmax(w), x, d=d), "ts_argmin": lambda x, d: rolled(lambda w: len(w) - 1 - np.argmin(w), x, d=d),
        "decay_linear": lambda x, d: rolled(lambda w: even(np.average(w, weights=np.arange(1, len(w) + 1)), w), x, d=d),
        "correlation": lambda x, y, d: rolled(corr, x, y, d=d), "covariance": lambda x, y, d: rolled(lambda a, b: even(np.cov(a, b)[0, 1], np.abs(a).max() * b), x, y, d=d),
        "signedpower": lambda x, e: np.sign(x) * np.abs(x) ** e, "where": lambda c, a, b: table(a).where(c, table(b)),
        "max": lambda a, b: np.maximum(table(a), table(b)), "min": lambda a, b: np.minimum(table(a), table(b)),
        "abs": np.abs, "sign": np.sign, "sqrt": np.sqrt, "log": lambda x: np.log(x).map(even),
        "finite": lambda x: x.where(np.isfinite(x)), "nonzero": lambda x: x.where(x != 0),
    }


def test_every_formula_by_another_evaluator(spark):
    """Each but alpha_096 with some dozens of known values at least: that one needs a dozen windows of three days in a row without a constant rank."""
    rng = np.random.default_rng(12)
    days, names = 290, 8
    close = 30 * np.exp(np.cumsum(rng.normal(size=(days, names)) * 0.03, axis=0))
    wide = {"close": close, "open": close * np.exp(rng.normal(size=close.shape) * 0.01), "volume": rng.integers(100, 5000, close.shape).astype(float)}
    wide["high"], wide["low"] = (f(wide["open"], close) * np.exp(s * rng.uniform(0.001, 0.02, close.shape)) for f, s in ((np.maximum, 1), (np.minimum, -1)))
    wide["ret"] = np.vstack([np.full((1, names), np.nan), close[1:] / close[:-1] - 1])
    wide["mcap"], wide["vwap"] = close * np.arange(1, names + 1), (wide["high"] + wide["low"] + close) / 3
    wide["sic2"] = np.tile(np.arange(names) % 2, (days, 1)).astype(float)
    dates = pd.bdate_range("2020-01-01", periods=days).date
    long = pd.DataFrame({"permno": np.tile(np.arange(names), days), "date": np.repeat(dates, names), "segment_id": 0, **{k: v.ravel() for k, v in wide.items()}})
    df = spark.createDataFrame(long).withColumn("ret", F.when(~F.isnan("ret"), F.col("ret"))).withColumn("sic2", F.col("sic2").cast("int"))
    nodes = library.alpha_features() | library.classic_features()
    got = evaluate(df, nodes, kernels=True).toPandas().set_index(["date", "permno"]).sort_index()
    data = {k: pd.DataFrame(v) for k, v in wide.items()}
    own = wide_functions(data)
    scope = own | data | {"returns": data["ret"], "cap": data["mcap"]} | {f"adv{d}": own["ts_mean"](data["volume"] * data["close"], d) for d in (5, 10, 15, 20, 21, 30, 40, 50, 60, 81, 120, 180)}
    wrong = {}
    with np.errstate(all="ignore"):
        for name, formula in {**{f"alpha_{n:03d}": f for n, f in library.ALPHAS.items()}, **library.CLASSIC}.items():
            want = eval(to_python(formula), {"__builtins__": {}}, scope).astype(float).to_numpy().ravel()  # noqa: S307
            have = got[name].to_numpy().astype(float)
            same = np.isclose(have, want, rtol=1e-6, atol=1e-7) | (np.isnan(have) & np.isnan(want))
            known = int((~np.isnan(want)).sum())
            if known < 40 and name != "alpha_096" or (~same).sum() > 0.01 * known:  # a tie of values that differ in the tenth digit may fall either way
                wrong[name] = (known, int((~same).sum()))
    assert wrong == {}


HAND = {  # written by hand, not by the emitter
    "ts_delay": "SELECT permno, segment_id, date, lag(close, 3) OVER (PARTITION BY permno, segment_id ORDER BY date) AS x FROM panel",
    "oc_ret": "SELECT permno, segment_id, date, close / open - 1 AS oc_ret FROM panel",
    "rev_5": "SELECT permno, segment_id, date, -(close / lag(close, 5) OVER (PARTITION BY permno, segment_id ORDER BY date) - 1) AS rev_5 FROM panel",
    "alpha_012": "SELECT permno, segment_id, date, sign(volume - lag(volume) OVER w) * -(close - lag(close) OVER w) AS alpha_012 FROM panel WINDOW w AS (PARTITION BY permno, segment_id ORDER BY date)",
    "alpha_101": "SELECT permno, segment_id, date, (close - open) / (high - low + 0.001) AS alpha_101 FROM panel",
    "alpha_009": "WITH d AS (SELECT *, close - lag(close) OVER w AS d1 FROM panel WINDOW w AS (PARTITION BY permno, segment_id ORDER BY date)), m AS (SELECT *, CASE WHEN count(d1) OVER w = 5 THEN min(d1) OVER w END AS lo, CASE WHEN count(d1) OVER w = 5 THEN max(d1) OVER w END AS hi FROM d WINDOW w AS (PARTITION BY permno, segment_id ORDER BY date ROWS 4 PRECEDING)) SELECT permno, segment_id, date, CASE WHEN lo > 0 THEN d1 WHEN hi < 0 THEN d1 ELSE -d1 END AS alpha_009 FROM m",
    "alpha_042": "WITH r AS (SELECT *, vwap - close AS a, vwap + close AS b FROM panel), k AS (SELECT *, (SELECT (count(*) FILTER (x.a < r.a) + count(*) FILTER (x.a <= r.a) + 1) / 2.0 / count(*) FROM r x WHERE x.date = r.date) AS ra, (SELECT (count(*) FILTER (x.b < r.b) + count(*) FILTER (x.b <= r.b) + 1) / 2.0 / count(*) FROM r x WHERE x.date = r.date) AS rb FROM r) SELECT permno, segment_id, date, ra / rb AS alpha_042 FROM k",
    "alpha_053": "WITH q AS (SELECT *, ((close - low) - (high - close)) / (close - low + 0.01) AS v FROM panel) SELECT permno, segment_id, date, -(v - lag(v, 9) OVER (PARTITION BY permno, segment_id ORDER BY date)) AS alpha_053 FROM q",
    "alpha_041": "SELECT permno, segment_id, date, sqrt(high * low) - vwap AS alpha_041 FROM panel",
    "ret_21d": "SELECT permno, segment_id, date, close / lag(close, 21) OVER (PARTITION BY permno, segment_id ORDER BY date) - 1 AS ret_21d FROM panel",
}


@pytest.mark.parametrize("name", HAND)
def test_hand_written_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "supplier"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    node = {"rev_5": parse("-1 * (close / delay(close, 5) - 1)")}.get(name) or next(iter(Q.signals()[name].values()))
    col = "x" if name == "ts_delay" else name
    got = {(r.permno, r.date): r.v for r in evaluate(P.bars_from_lines(spark, SF), {"v": node}).collect()}
    sql = HAND[name]
    sql = P.BARS_SQL + (", " + sql[5:] if sql.startswith("WITH ") else " " + sql)
    want = {(p, d): v for p, _, d, v in db.sql(sql).fetchall()}
    close_to(got, want)


@pytest.mark.parametrize("name", ["daily_bars", "prepare_panel", "alpha_029", "alpha_098", "daily_ic", "decile_portfolio", "split_table", "gram_by_year", "greedy_prune", "predictions_of_given_coefficients", "return_identity"])
def test_registered_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "supplier"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    cols = sorted(rel.columns)
    key = lambda r: tuple(str(v) for v in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    assert a == b


def test_entry(spark):
    import __spark_entry__ as E

    if os.path.isdir(SF):
        assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_empty_panel(spark):
    df, _ = random_panel(spark)
    assert evaluate(df.where("false"), {"v": parse("ts_rank(rank(x), 3)")}).count() == 0
    assert where(field("x") < 1, num(1), num(2)) is not None
    assert "s0" in to_sql("WITH panel AS (SELECT 1)", {"v": parse("rank(x)")})


def test_prefix_product_over_years(spark):
    """Negative and zero factors, years that come after them, and runs apart from each other."""
    days = pd.bdate_range("2019-11-01", "2022-02-28")[::7]
    rng = np.random.default_rng(5)
    r = rng.normal(size=(len(days), 2)) * 0.4
    r[10, 0], r[25, 0], r[40, 1] = -2.5, -1.75, -1.0
    pdf = pd.DataFrame({"run": np.repeat(["a", "b"], len(days)), "date": np.tile(days.date, 2), "long_short": r.T.ravel()})
    got = scorecard.cumulative_long_short(spark.createDataFrame(pdf).repartition(4), by=("run",)).toPandas().sort_values(["run", "date"])
    assert got.cumulative.to_numpy() == pytest.approx(np.cumprod(1 + r, axis=0).T.ravel(), rel=1e-9, abs=1e-12)
    one = scorecard.cumulative_long_short(spark.createDataFrame(pdf[pdf.run == "b"])).toPandas().sort_values("date")
    assert one.cumulative.to_numpy() == pytest.approx(np.cumprod(1 + r[:, 1]), rel=1e-9, abs=1e-12)


def exchanges(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("Window ["), plan.count("HashAggregate("), plan.count("Join")


def test_runs_and_offsets_share_a_plan(spark):
    df, _ = preds_frame(spark)
    every = scorecard.decile_portfolio(df, horizon=3, offset=None).collect()
    for o in range(3):
        assert sorted(r.date for r in every if r.offset == o) == sorted(r.date for r in scorecard.decile_portfolio(df, horizon=3, offset=o).collect())
    assert exchanges(scorecard.offset_sensitivity(df, horizon=2)) == exchanges(scorecard.offset_sensitivity(df, horizon=9))
    two, six = ({f"r{k}": (df, 1 + k % 2) for k in range(n)} for n in (2, 6))
    assert exchanges(scorecard.scorecard(two)) == exchanges(scorecard.scorecard(six))
    alone = scorecard.scorecard({"r0": (df, 1)}).first()
    assert alone == next(r for r in scorecard.scorecard(two).collect() if r.run == "r0")


def test_matrices_add_up_over_tasks(spark):
    """Gram matrices and rank correlations don't depend on how the rows lie, and a fit of many runs is that of each by itself."""
    df, pdf = synthetic(spark)
    one, many = ({(r.year, r.late, r.i, r.j): r.value for r in validation.gram_cells(t, ["x1", "x2"], "y").collect()} for t in (df.coalesce(1), df.repartition(6)))
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in one.items())
    runs = validation.walk_forwards(df, {"a": (["x3", "x1"], "y"), "b": (["x2"], "y")}, min_test_year=2021)
    alone = validation.walk_forward(df, ["x3", "x1"], "y", min_test_year=2021)
    for t, f in alone.fits.items():
        assert runs["a"].fits[t].coef == pytest.approx(f.coef, abs=1e-10) and runs["b"].fits[t].alpha > 0
    assert {r.feature for r in runs["a"].coefs.collect()} == {"x1", "x3"}


def test_late_operators_let_fields_travel(spark):
    from panelkiln.plans.compile import _last_use, carried_of

    nodes = library.alpha_features()
    width = {}
    for late in (False, True):
        plan = Plan(nodes, late)
        width[late] = sum(carried_of(plan, _last_use(plan, Q.KEYS), plan.fields()).values())
    assert width[True] < 0.55 * width[False]
    df, _ = random_panel(spark)
    nodes = {"a": parse("correlation(rank(x), rank(y), 3)"), "b": rank(parse("delay(x, 2)")), "c": parse("delay(y, 1) - x")}
    one = {(r.permno, r.date): (r.a, r.b, r.c) for r in evaluate(df, nodes, kernels=False).collect()}
    duck = duckdb.connect()
    duck.register("given", df.toPandas())
    sql = to_sql("WITH panel AS (SELECT permno, segment_id, date::DATE AS date, CASE WHEN NOT isnan(x) THEN x END AS x, CASE WHEN NOT isnan(y) THEN y END AS y FROM given)", nodes)
    want = {(r[0], r[2]): r[3:] for r in duck.execute(sql).fetchall()}
    assert one.keys() == want.keys() and all(g == pytest.approx(w, abs=1e-8) if None not in g else [v is None for v in g] == [v is None for v in w] for g, w in ((one[k], want[k]) for k in want))


def test_tasks_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(P, "SMALL", 0)
    monkeypatch.setattr(P, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    n = lines.count()
    assert P.input_rows(lines) == n and P.input_rows(spark.createDataFrame([(1,)], "x int")) == 0
    assert P.bars_from_lines(spark, SF).rdd.getNumPartitions() == -(-n // 500)
    n += spark.read.parquet(f"{SF}/supplier.parquet").count()
    for kernels in (False, True):
        assert evaluate(P.bars_from_lines(spark, SF), {"v": rank(parse("delay(close, 1)"))}, kernels=kernels, laid=True).rdd.getNumPartitions() == -(-n // 500)


def test_one_exchange_makes_bars_and_trailing_windows(spark):
    for kernels in (False, True):
        plan = evaluate(P.bars_from_lines(spark, SF), {"v": parse("ts_mean(close, 5)")}, kernels=kernels, laid=True)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def test_long_windows_leave_the_jvm(spark):
    shape = lambda name: Q.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert all("MapInArrow" in shape(name) for name in ("alpha_032", "alpha_037", "alpha_071", "classic_library")) and "MapInArrow" not in shape("alpha_011")


def test_pool_ranks_in_one_sort_and_features_once(spark, monkeypatch):
    df, _ = random_panel(spark)
    wide = df.select("permno", "date", *(F.col("x").alias(f"x{i}") for i in range(9)))
    names = [f"x{i}" for i in range(9)]
    ranks = validation.rank_normalized(wide, names, ["permno", "date"])
    assert ranks._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0
    want = {(r.permno, r.date): r.x0 for r in validation.rank_normalized(wide, ["x0"], ["permno", "date"]).collect()}
    assert {(r.permno, r.date): r.x8 for r in ranks.collect()} == want
    made = []
    monkeypatch.setattr(validation, "settled", lambda frame: made.append(frame) or scratch.settled(frame))
    with scratch.scope(spark):
        frame, _, _ = validation.model_frame(P.bars_from_lines(spark, SF), targets=(), numbers=[12, 41])
        assert len(made) == 1 and "Window" not in frame._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(prune, "coverage", lambda *a: pytest.fail("coverage was counted"))
    assert prune.drop_low_coverage(df, ["x", "y"], 0.0)[1:] == (["x", "y"], [])


def test_of_lines_alike_the_first_of_the_file_counts(spark, tmp_path):
    duck = duckdb.connect()
    for first, second in ((10, 20), (20, 10)):
        sf = tmp_path / f"{first}"
        sf.mkdir()
        duck.execute(f"COPY (SELECT 1::BIGINT AS l_orderkey, 1::BIGINT AS l_suppkey, 1::INTEGER AS l_linenumber, 1e0 AS l_quantity, px::DOUBLE AS l_extendedprice, TIMESTAMP '2000-01-01' AS l_shipdate FROM (VALUES ({first}), ({second})) t(px)) TO '{sf}/lineitem.parquet'")
        duck.execute(f"COPY (SELECT 1::BIGINT AS s_suppkey, 1::INTEGER AS s_nationkey, 1e0 AS s_acctbal) TO '{sf}/supplier.parquet'")
        got = P.bars_from_lines(spark, str(sf)).first()
        duck.execute(f"CREATE OR REPLACE VIEW lineitem AS FROM '{sf}/lineitem.parquet'; CREATE OR REPLACE VIEW supplier AS FROM '{sf}/supplier.parquet'")
        want = duck.execute(f"{P.BARS_SQL} SELECT open, close FROM panel").fetchone()
        assert (got.open, got.close) == (first, first) == want


@pytest.mark.parametrize("name", ["ablation_summary", "normalization_ablation"])
def test_ablation_makes_its_predictions_once(spark, name):
    """What the measures read again is settled: no order line is left in the plan."""
    from panelkiln.operators.queries import QUERIES

    with scratch.scope(spark):
        found = QUERIES[name][0](spark, SF)
        assert found.inputFiles() and not any("lineitem" in f for f in found.inputFiles())
        assert found.count()


def test_ranks_of_predictions_have_tasks_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "SMALL", 0)
    rows = [(1990, dt.date(1990, 1, 1) + dt.timedelta(d), k, float((k * 7 + d) % 11), float(k)) for d in range(40) for k in range(20)]
    with scratch.scope(spark):
        preds = scratch.settled(frame(spark, rows, "test_year int, date date, permno long, y double, yhat double"))
        want = {tuple(r) for r in scorecard.daily_ic(preds).collect()}
        monkeypatch.setattr(P, "TASK_ROWS", 50)
        found = scorecard.daily_ic(preds)
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString() and {tuple(r) for r in found.collect()} == want


def moved(df) -> list[int]:
    """Columns at each exchange of a plan."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Repartition"):
            found.append(node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


@pytest.mark.parametrize("digits", [None, 7])
def test_securities_keep_what_dates_do_not_need(spark, monkeypatch, digits):
    """Both sides' packed trips give what whole rows give, to the last bit."""
    from panelkiln.plans import kernels

    monkeypatch.setattr(kernels, "ROWS", 50)
    df, _ = random_panel(spark, seed=5)
    df = df.withColumn("v", F.rint(F.col("y") * 100) / 100)
    x, y, z, v = (field(c) for c in "xyzv")
    r, s, i = rank(y), rank(x * y), indneutralize(v)
    c = timed("ts_corr", r, 4, s)
    nodes = {"a": rank(c) * timed("ts_rank", y, 3), "b": timed("ts_mean", rank(c) + timed("delta", v, 1), 3), "d": -1 * rank(timed("decay_linear", i, 3)), "e": where(rank(timed("delay", y, 1)) < rank(c), x, num(1)), "f": timed("ts_max", rank(timed("ts_corr", s, 3, v)), 2) / z, "g": scale(timed("ts_sum", r, 2)), "h": timed("delay", where(rank(c) < s, num(1), num(2)), 1), "k": z}
    plain, apart = (evaluate(df, nodes, kernels=True, laid=True, digits=digits, settle=settle) for settle in (lambda f: f, None))
    assert len(Plan(nodes, late=True).steps) > 3 and max(moved(apart)) < max(moved(plain))
    want, got = ({(q.permno, q.date): tuple(q) for q in f.collect()} for f in (plain, apart.select(plain.columns)))
    assert got == want and any(q[-1] is None for q in map(lambda t: t[:4], want.values()))


def test_the_whole_library_travels_packed(spark):
    assert max(moved(Q.all_alphas(spark, SF))) < 20


def test_packed_rows_are_what_they_were():
    from panelkiln.plans.kernels import Packed

    date = np.repeat([0, 1], 5)
    r = np.array([1, 2.5, 2.5, 4, np.nan, 1, 2, 3, 4, 5]) / np.repeat([4, 5], 5)
    have = {"p": np.array([-0.0, np.inf, np.nan, 1e284, 5e-324, 1, 2, 3, 4, 1 / 3]), "c": np.array([0.12345678, -1, np.nan, 1, 0, 0.5, 0.1, -0.3, 0.7, 1e-8]), "r": r, "o": np.array([1.23456785, -7e300, np.inf, -np.inf, np.nan, -0.0, -2.5e-8, 429.4967296, -1e9, 1e10])}
    packed = Packed(["p"], ["c"], ["r"], set(), ["o"], 7)
    from panelkiln.plans import kernels

    got = packed.unpack(packed.pack(have, date))
    with np.errstate(all="ignore"):
        want = have | {"o": kernels.decimals(have["o"], 7)}
    for c in have:
        assert np.array_equal(got[c], want[c], equal_nan=True) and np.array_equal(np.signbit(got[c]), np.signbit(want[c])), c
    again = packed.unpack(packed.pack(got))  # without dates: their numbers came along
    assert np.array_equal(again["r"], r, equal_nan=True) and np.array_equal(again["o"], got["o"], equal_nan=True)


def test_correlations_of_rounded_values_travel_packed(spark, monkeypatch):
    """The same correlations, in as many tasks as the rows need."""
    monkeypatch.setattr(P, "SMALL", 0), monkeypatch.setattr(P, "TASK_ROWS", 100)
    rng = np.random.default_rng(1)
    rows = [(dt.date(1990, 1, 1) + dt.timedelta(d), *(None if rng.random() < 0.1 else float("inf") if rng.random() < 0.02 else round(float(v), 2) for v in rng.normal(size=3))) for d in range(30) for _ in range(25)]
    with scratch.scope(spark):
        df = scratch.settled(frame(spark, rows, "date date, a double, b double, c double"))
        plain, packed = (prune.mean_daily_spearman(df, ["a", "b", "c"], min_names=5, digits=digits) for digits in (None, 7))
        assert max(moved(packed)) < max(moved(plain)) and "REPARTITION_BY_NUM" in packed._jdf.queryExecution().executedPlan().toString()
        round_ = lambda f: {(r.f1, r.f2): round(r.rho, 12) for r in f.collect()}  # noqa: E731  (sums of dates by task)
        assert len(round_(plain)) == 9 and round_(packed) == round_(plain)


def test_choice_of_kernels_travels_packed(spark):
    """Where all phases go by kernels by choice, what travels is packed as in a batch that is all kernels."""
    assert max(moved(Q.queries()["first_alphas"](spark, SF))) < 12


@pytest.mark.parametrize("task_rows", [None, 100])
def test_blocks_bring_what_was_sent(spark, monkeypatch, task_rows):
    """Few or many buckets, several flushes of a task and a missing date: the values of windows."""
    from panelkiln.plans import kernels

    monkeypatch.setattr(kernels, "ROWS", 60), monkeypatch.setattr(kernels, "HELD", 2000)
    if task_rows:
        monkeypatch.setattr(P, "SMALL", 0), monkeypatch.setattr(P, "TASK_ROWS", task_rows)
    df, _ = random_panel(spark, seed=8)
    df = df.withColumn("date", F.when((F.col("permno") != 3) | (F.col("date") != "2020-01-01"), F.col("date")))
    nodes = {"a": timed("ts_mean", rank(timed("delta", field("y"), 2)), 3), "b": rank(timed("ts_corr", rank(field("y")), 4, field("z"))), "c": timed("delay", indneutralize(field("x")), 1)}
    with scratch.scope(spark):
        df = scratch.settled(df.repartition("permno"))
        df = df.repartition(5, "permno")
        got, want = ({(r.permno, r.date): tuple(r)[3:] for r in evaluate(df, nodes, kernels=k, laid=True).collect()} for k in (True, False))
    assert got.keys() == want.keys() and len(got) == 480
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9) if None not in w else [v is None for v in got[k]] == [v is None for v in w], k


def test_blocks_and_buckets(spark):
    from panelkiln.plans import kernels

    keys = np.array([0, 7, 12345678901, -3, 7, 99] * 50)
    want = [r.b for r in spark.createDataFrame([(i, int(k)) for i, k in enumerate(keys)], "i int, k long").select("i", (F.crc32(F.col("k").cast("string")) % 5).alias("b")).orderBy("i").collect()]
    assert kernels.buckets(keys, 5).tolist() == want
    rows = np.concatenate([keys.view(np.uint8).reshape(-1, 8), np.tile(np.arange(11, dtype=np.uint8), (len(keys), 1))], 1)
    sent = kernels.blocks_of(rows, keys, 5)
    assert sum(map(len, sent.column(1).to_pylist())) < rows.size / 5
    for bucket, b in zip(*(c.to_pylist() for c in sent.columns), strict=True):
        assert np.array_equal(kernels.unblock([b], rows.shape[1]), rows[np.array(want) == bucket])


def test_own_rows_keep_types_and_gaps(spark):
    """Fields travel in blocks as what they were, NaN beside NULL; where one can't, whole rows travel."""
    import pyarrow as pa

    from panelkiln.plans import kernels

    t = pa.table({"permno": pa.array([2, 1, 2], pa.int32()), "date": pa.array([None, dt.date(2020, 1, 1), dt.date(1960, 5, 5)]), "x": pa.array([None, math.nan, -0.0]), "n": pa.array([2**62, None, -1]), "on": pa.array([True, None, False]), "day": pa.array([dt.date(2000, 1, 1), None, dt.date(1, 1, 1)]), "f": pa.array([0.1, None, 3.0], pa.float32())})
    stored = kernels.Stored({"permno": "int", "date": "date", "x": "double", "n": "bigint", "on": "boolean", "day": "date", "f": "float"}, 4)
    rows = stored.rows(t.to_batches()[0])
    got = stored.table(kernels.unblock([kernels.block(rows)], stored.width))
    assert rows.shape[1] == stored.width and got.schema.types == t.schema.types and str(got.to_pydict()) == str(t.to_pydict())

    df, _ = random_panel(spark, seed=9)
    node = {"a": timed("ts_mean", rank(timed("delta", field("y"), 2)), 3)}
    plain = evaluate(df, node, kernels=True, laid=True, keep=("permno", "date", "sic2"))
    named = evaluate(df.withColumn("ticker", F.lit("a")), node, kernels=True, laid=True, keep=("permno", "date", "sic2", "ticker"))
    assert {tuple(r) for r in plain.collect()} == {tuple(r)[:3] + tuple(r)[4:] for r in named.collect()} and dict(plain.dtypes)["sic2"] == "int"


def test_the_model_frame_is_rounded_before_it_travels(spark, monkeypatch):
    """What only the result reads comes back from the dates as whole numbers, and is rounded once."""
    from panelkiln.operators.queries import QUERIES
    from panelkiln.plans import kernels

    seen, init = [], kernels.Packed.__init__
    monkeypatch.setattr(kernels.Packed, "__init__", lambda self, plain, corr=(), ranks=(), flags=frozenset(), rounded=(), digits=0: seen.append((len(rounded), digits)) or init(self, plain, corr, ranks, flags, rounded, digits))
    QUERIES["model_frame"][0](spark, SF)
    assert max(seen)[0] > 30 and max(seen)[1] == 7


def test_ranks_of_many_features_travel_in_blocks(spark, monkeypatch):
    """A single phase of dates: the same ranks, whatever keys are missing, and one packed column on the way."""
    df, _ = random_panel(spark, seed=4)
    df = df.withColumn("permno", F.when(F.col("permno") != 2, F.col("permno"))).withColumn("date", F.when(F.dayofmonth("date") != 9, F.col("date")))
    wide = df.select("permno", "date", "sic2", *((F.col("y") * i).alias(f"x{i}") for i in range(9)))
    names = [f"x{i}" for i in range(9)]
    with scratch.scope(spark):
        wide = scratch.settled(wide)
        blocks = validation.rank_normalized(wide, names, ["permno", "date", "sic2"])
        assert max(moved(blocks)) == 2
        windows = evaluate(wide, {c: library.centred(field(c)) for c in names}, keep=("permno", "date", "sic2"), kernels=False)
        key = lambda f: sorted(map(str, f.collect()))
        assert key(blocks) == key(windows)
