"""Registered queries of the pruning, validation, scoring and audit operators, with SQL for DuckDB where it can express them.

Predictions are stand-ins that any engine can form: the 5-day reversal predicts the next day's return."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import library
from ..plans.compile import evaluate, to_sql
from ..plans.expr import parse
from ..sources.panel import BARS_SQL, bars_from_lines, forward_returns
from ..sources.scratch import settled
from . import audit, prune, scorecard, validation

FEATURES = {"f_rev": parse("-1 * (close / delay(close, 1) - 1)"), "f_vol": parse("volume / ts_mean(volume, 5) - 1"), "f_range": parse("(high - low) / close"), "f_loc": parse("(close - low) / (high - low + 0.01)")}
WINDOWS = {"1996": (1996, 1996), "late": (1999, 2000), "none": (2020, 2021)}
MIN_NAMES = 10


def snap(df: DataFrame, digits: int = 8, only: tuple[str, ...] = ()) -> DataFrame:
    scale = 10.0**digits
    return df.select(*(((F.rint(F.col(c) * scale) / scale) + 0.0).alias(c) if k == "double" and (not only or c in only) else F.col(c) for c, k in df.dtypes))


def sql_snap(*cols: str, digits: int = 8) -> str:
    return ", ".join(f"(round_even({c} * 1E{digits}, 0) / 1E{digits} + 0E0) AS {c.split('.')[-1]}" for c in cols)


# Predictions ------------------------------------------------------------------------------------------------------


def predictions(spark, sf_dir) -> DataFrame:
    bars = forward_returns(bars_from_lines(spark, sf_dir))
    rev = evaluate(bars, {"yhat": parse("-1 * (close / delay(close, 5) - 1)")}, keep=("permno", "date", "fwd_ret_1d"))
    both = rev.where("yhat is not null and fwd_ret_1d is not null")
    return snap(both.select(F.year("date").alias("test_year"), "date", "permno", F.col("fwd_ret_1d").alias("y"), "yhat"), 10)


PRED = (
    BARS_SQL
    + """, q AS (
  SELECT permno, date, lead(close, 1) OVER w / close - 1 AS y0, -1E0 * (close / lag(close, 5) OVER w - 1) AS h0 FROM panel WINDOW w AS (PARTITION BY permno, segment_id ORDER BY date)
), pred AS (
  SELECT CAST(year(date) AS INTEGER) AS test_year, date, permno, round_even(y0 * 1E10, 0) / 1E10 + 0E0 AS y, round_even(h0 * 1E10, 0) / 1E10 + 0E0 AS yhat FROM q WHERE y0 IS NOT NULL AND h0 IS NOT NULL
)"""
)


def sql_rank(c: str, keys: str) -> str:
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {c}) + count(*) OVER (PARTITION BY {keys} ORDER BY {c} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2E0"


def sql_corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_samp({x}) > 1E-15 AND stddev_samp({y}) > 1E-15 THEN covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END"


IC = PRED + f""", rk AS (SELECT test_year, date, {sql_rank('y', 'date')} AS ry, {sql_rank('yhat', 'date')} AS rh FROM pred
), ic AS (SELECT test_year, date, CASE WHEN count(*) >= 3 THEN {sql_corr('ry', 'rh')} END AS ic FROM rk GROUP BY test_year, date
), icy AS (SELECT test_year, avg(ic) AS ic FROM ic GROUP BY test_year)"""


def dec_sql(horizon: int = 1, offset: int = 0) -> str:
    means = ", ".join(f"avg(CASE WHEN d = {k} THEN y END) AS decile_{k}" for k in range(1, 11))
    return f"""fd{offset} AS (SELECT test_year, date FROM (SELECT test_year, date, dense_rank() OVER (PARTITION BY test_year ORDER BY date) - 1 AS p FROM (SELECT DISTINCT test_year, date FROM pred)) WHERE p % {horizon} = {offset} AND p >= {offset}
), rr{offset} AS (SELECT pred.*, row_number() OVER (PARTITION BY test_year, date ORDER BY yhat, permno) AS r, count(*) OVER (PARTITION BY test_year, date) AS n, min(yhat) OVER (PARTITION BY test_year, date) AS lo, max(yhat) OVER (PARTITION BY test_year, date) AS hi FROM pred JOIN fd{offset} USING (test_year, date)
), dd{offset} AS (SELECT *, greatest(1, ceil((r - 1) * 10 / (n - 1))) AS d FROM rr{offset} WHERE n >= 10 AND lo < hi
), dw{offset} AS (SELECT test_year, date, {means} FROM dd{offset} GROUP BY test_year, date
), dp{offset} AS (SELECT *, decile_10 - decile_1 AS long_short FROM dw{offset})"""


DEC = PRED + ", " + dec_sql()
SHARPE = "CASE WHEN count({r}) >= 2 AND stddev_samp({r}) > 0 THEN avg({r}) / stddev_samp({r}) * sqrt(252E0 / {h}) END"
DECILES = [f"decile_{k}" for k in range(1, 11)]


def deciles(spark, sf_dir, **k):
    return scorecard.decile_portfolio(predictions(spark, sf_dir), **k)


def _offsets_sql() -> str:
    parts = ", ".join(dec_sql(5, o) for o in range(5))
    return PRED + ", " + parts + " " + " UNION ALL ".join(f"SELECT {o} AS \"offset\", round_even({SHARPE.format(r='(0.5 * long_short)', h=5)} * 1E8, 0) / 1E8 + 0E0 AS gross_sharpe, count(*) AS n_formations FROM dp{o}" for o in range(5))


def stress(spark, sf_dir):
    p = predictions(spark, sf_dir)
    t = scorecard.stress_windows(spark, scorecard.ic_by_year(p), scorecard.sharpe_by_year(scorecard.decile_portfolio(p)), WINDOWS)
    return snap(t.withColumn("years_covered", F.concat_ws(",", "years_covered")))


def stress_sql(horizon: int = 1) -> str:
    return IC + ", " + dec_sql(horizon) + f""", sh AS (SELECT test_year, {SHARPE.format(r='long_short', h=horizon)} AS sharpe FROM dp0 GROUP BY test_year
), w AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {a}, {b})" for k, (a, b) in WINDOWS.items())}) AS v(win, a, b)
), t AS (SELECT win AS "window", coalesce(string_agg(CAST(test_year AS VARCHAR), ',' ORDER BY test_year), '') AS years_covered, count(test_year) AS n_years, avg(ic) AS mean_ic, avg(sharpe) AS mean_gross_sharpe
FROM w LEFT JOIN (icy LEFT JOIN sh USING (test_year)) ON test_year BETWEEN a AND b GROUP BY win)
SELECT "window", years_covered, n_years, {sql_snap('mean_ic', 'mean_gross_sharpe')} FROM t"""


STRESS = stress_sql()


# Stand-in coefficients and two schemes ------------------------------------------------------------------------------


def coefs(spark, sf_dir) -> DataFrame:
    """(test_year, feature, coef): yearly averages stand in for coefficients; one is zero by design."""
    f = evaluate(bars_from_lines(spark, sf_dir), FEATURES, keep=("date",))
    by = f.groupBy(F.year("date").alias("test_year")).agg(*(F.avg(c).alias(c) for c in FEATURES))
    long = by.unpivot("test_year", list(FEATURES), "feature", "coef")
    return snap(long.withColumn("coef", F.when(F.col("feature") == "f_loc", 0.0).otherwise(F.col("coef"))), 10)


COEFS = to_sql(BARS_SQL, FEATURES, keep=("date",)).rsplit("\nSELECT ", 1)
COEFS = (
    COEFS[0]
    + f",\nft AS (SELECT {COEFS[1]}), "
    + "cy AS ("
    + " UNION ALL ".join(f"SELECT CAST(year(date) AS INTEGER) AS test_year, '{c}' AS feature, {'0E0' if c == 'f_loc' else f'round_even(avg({c}) * 1E10, 0) / 1E10 + 0E0'} AS coef FROM ft GROUP BY ALL" for c in FEATURES)
    + ")"
)


def schemes(spark, sf_dir):
    """Predictions and coefficients of two schemes; both are made once, as every measure reads them again."""
    p = settled(predictions(spark, sf_dir), "predictions")
    both = p.withColumn("scheme", F.lit("rank")).unionByName(p.withColumn("yhat", F.when(F.col("test_year") == 1997, 0.0).otherwise(F.col("yhat") * F.abs("yhat"))).withColumn("scheme", F.lit("standardize")))
    c = settled(coefs(spark, sf_dir), "coefs")
    z = c.withColumn("scheme", F.lit("rank")).unionByName(c.withColumn("coef", F.when(F.col("test_year") == 1997, 0.0).otherwise(F.col("coef"))).withColumn("scheme", F.lit("standardize")))
    years = p.select("test_year").distinct()
    return both.withColumn("config", F.lit("c")), z.join(years, "test_year", "left_semi").withColumn("config", F.lit("c"))


def ablation(spark, sf_dir):
    return snap(scorecard.ablation_detail(*schemes(spark, sf_dir)))


PAIR = (
    PRED
    + ", "
    + COEFS.split("panel AS (", 1)[1].split("\n)", 1)[1].lstrip(",\n ")
    + """, arms AS (SELECT 'c' AS config, 'rank' AS scheme, * FROM pred UNION ALL SELECT 'c', 'standardize', test_year, date, permno, y, CASE WHEN test_year = 1997 THEN 0E0 ELSE yhat * abs(yhat) END FROM pred
), cz AS (SELECT 'c' AS config, 'rank' AS scheme, * FROM cy UNION ALL SELECT 'c', 'standardize', test_year, feature, CASE WHEN test_year = 1997 THEN 0E0 ELSE coef END FROM cy
), pe AS (SELECT config, scheme, test_year, """
    + sql_corr("y", "yhat")
    + " AS pearson_ic FROM arms GROUP BY ALL), br AS (SELECT config, scheme, test_year, date, "
    + sql_rank("y", "scheme, date")
    + " AS ry, "
    + sql_rank("yhat", "scheme, date")
    + " AS rh FROM arms), bd AS (SELECT config, scheme, test_year, date, "
    + sql_corr("ry", "rh")
    + " AS ic FROM br GROUP BY ALL), bs AS (SELECT config, scheme, test_year, avg(ic) AS daily_spearman_ic FROM bd GROUP BY ALL), bz AS (SELECT config, scheme, test_year, CAST(sum(CASE WHEN abs(coef) > 1E-8 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero_coefs FROM cz GROUP BY ALL), det AS (SELECT * FROM pe JOIN bs USING (config, scheme, test_year) JOIN bz USING (config, scheme, test_year))"
)


# Features and folds ---------------------------------------------------------------------------------------------------


def features(spark, sf_dir) -> DataFrame:
    return snap(evaluate(bars_from_lines(spark, sf_dir), FEATURES, keep=("permno", "date")), 10)


FEAT = to_sql(BARS_SQL, FEATURES, keep=("permno", "date"), digits=10).rsplit("\nSELECT ", 1)
FEAT = FEAT[0] + f",\nft AS (SELECT {FEAT[1]})"


def spearman(spark, sf_dir):
    return snap(prune.mean_daily_spearman(features(spark, sf_dir), list(FEATURES), min_names=MIN_NAMES))


def _pair_sql(a: str, b: str) -> str:
    if a == b:
        return f"SELECT '{a}' AS f1, '{b}' AS f2, 1E0 AS rho"
    return f"SELECT '{a}' AS f1, '{b}' AS f2, avg(rho) AS rho FROM (SELECT date, {sql_corr(f'r_{a}', f'r_{b}')} AS rho FROM rks WHERE r_{a} IS NOT NULL AND r_{b} IS NOT NULL GROUP BY date)"


def _null_rank(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + count({c}) OVER (PARTITION BY date ORDER BY {c} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2E0 END AS r_{c}"


SPEARMAN = FEAT + f", big AS (SELECT * FROM ft WHERE date IN (SELECT date FROM ft GROUP BY date HAVING count(*) >= {MIN_NAMES})), rks AS (SELECT date, {', '.join(map(_null_rank, FEATURES))} FROM big), prs AS (" + " UNION ALL ".join(_pair_sql(a, b) for a in FEATURES for b in FEATURES) + f") SELECT f1, f2, {sql_snap('rho')} FROM prs"


#: The candidate pool but alpha_084, which reaches 1e284: its decimals no two engines share.
POOL_NUMBERS = [n for n in library.ALPHAS if n != 84]


def pool_spearman(spark, sf_dir):
    """Mean daily rank correlations of the whole pool, as pruning sees them: both orders of each pair."""
    pool = library.pool(POOL_NUMBERS)
    return snap(prune.mean_daily_spearman(evaluate(bars_from_lines(spark, sf_dir), pool, keep=("permno", "date"), digits=7, kernels=True, laid=True), list(pool), min_names=MIN_NAMES, digits=7))


def _pool_spearman_sql() -> str:
    pool = list(library.pool(POOL_NUMBERS))
    values = to_sql(BARS_SQL, library.pool(POOL_NUMBERS), keep=("permno", "date"), digits=7).rsplit("\nSELECT ", 1)
    pairs = {f"p{i}_{j}": (pool[i], pool[j]) for i in range(len(pool)) for j in range(i, len(pool))}
    return values[0] + f""",
ft AS (SELECT {values[1]}), big AS (SELECT date, {', '.join(f'CASE WHEN NOT isinf({c}) THEN {c} END AS {c}' for c in pool)} FROM ft WHERE date IN (SELECT date FROM ft GROUP BY date HAVING count(*) >= {MIN_NAMES})
), rks AS (SELECT date, {', '.join(map(_null_rank, pool))} FROM big
), day AS (SELECT date, {', '.join(f'corr(r_{a}, r_{b}) AS {k}' for k, (a, b) in pairs.items())} FROM rks GROUP BY date
), mean AS (SELECT {', '.join(f'avg(CASE WHEN NOT isnan({k}) THEN {k} END) AS {k}' for k in pairs)} FROM day
), lng AS (UNPIVOT mean ON COLUMNS(*) INTO NAME pair VALUE rho
), nm(pair, f1, f2) AS (VALUES {', '.join(f"('{k}', '{a}', '{b}')" for k, (a, b) in pairs.items())}
), one AS (SELECT f1, f2, CASE WHEN f1 = f2 THEN 1E0 ELSE rho END AS rho FROM lng JOIN nm USING (pair))
SELECT f1, f2, {sql_snap('rho')} FROM one UNION ALL SELECT f2 AS f1, f1 AS f2, {sql_snap('rho')} FROM one WHERE f1 <> f2"""


def model_frame(spark, sf_dir):
    """The frame that models are fitted on, with every feature kept: baseline features and pool, infinities gone."""
    frame, _, _ = validation.model_frame(bars_from_lines(spark, sf_dir), targets=(), min_coverage=0.0, numbers=POOL_NUMBERS, digits=7, laid=True)
    return frame


def _model_frame_sql() -> str:
    features = library.baseline_features() | library.pool(POOL_NUMBERS)
    values = to_sql(BARS_SQL, features, digits=7).rsplit("\nSELECT ", 1)
    return values[0] + f",\nft AS (SELECT {values[1]})\nSELECT permno, segment_id, date, {', '.join(f'CASE WHEN NOT isinf({c}) THEN {c} END AS {c}' for c in features)} FROM ft"


CLOSE = 0.2


def greedy(spark, sf_dir):
    f = features(spark, sf_dir)
    config = prune.prune(f, list(FEATURES), threshold=CLOSE, min_names=MIN_NAMES)
    return spark.createDataFrame([(k, k in config["keep"]) for k in FEATURES], "feature string, kept boolean")


def _greedy_sql() -> str:
    """One step for each close pair, the closest first; the state is what is left."""
    names = ", ".join(f"('{c}', {i})" for i, c in enumerate(FEATURES))
    crowding = "(SELECT avg(r) FROM ab WHERE ab.f1 = {0} AND ab.f2 <> {0} AND list_contains(st.lft, ab.f2))".format
    return SPEARMAN.rsplit(" SELECT f1, f2,", 1)[0].replace("WITH ", "WITH RECURSIVE ", 1) + f""", nm(f, i) AS (VALUES {names}
), ab AS (SELECT f1, f2, round_even(abs(rho) * 1E8, 0) / 1E8 AS r FROM prs
), cl AS (SELECT f1, f2, row_number() OVER (ORDER BY r DESC, x.i, z.i) AS k FROM ab JOIN nm x ON x.f = f1 JOIN nm z ON z.f = f2 WHERE x.i < z.i AND r >= {CLOSE}
), st(k, lft) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list(f) FROM nm)
  UNION ALL
  SELECT k + 1, CASE WHEN NOT (list_contains(lft, f1) AND list_contains(lft, f2)) THEN lft ELSE list_filter(lft, lambda f: f <> CASE WHEN a > b OR (a = b AND f1 > f2) THEN f1 ELSE f2 END) END
  FROM (SELECT st.k, st.lft, cl.f1, cl.f2, {crowding('cl.f1')} AS a, {crowding('cl.f2')} AS b FROM st JOIN cl ON cl.k = st.k + 1)
)
SELECT nm.f AS feature, list_contains(s.lft, nm.f) AS kept FROM nm, (SELECT lft FROM st ORDER BY k DESC LIMIT 1) AS s"""


def tuning(spark, sf_dir):
    run = _enet(spark, sf_dir)
    return snap(scorecard.tuning_complexity(run.params, run.coefs, range(1995, 2003)))


def stress_runs(spark, sf_dir):
    p = predictions(spark, sf_dir)
    t = scorecard.stress_over_runs(spark, two_runs(p), WINDOWS)
    return snap(t.withColumn("years_covered", F.concat_ws(",", "years_covered")))


def two_runs(p: DataFrame) -> dict[str, tuple[DataFrame, int]]:
    """The reversal, and its opposite formed every five days."""
    return {"reversal": (p, 1), "momentum": (p.withColumn("yhat", -F.col("yhat") + 0.0), 5)}


#: The second run's predictions.
OPPOSITE = ("round_even(h0 * 1E10, 0) / 1E10 + 0E0 AS yhat", "0E0 - round_even(h0 * 1E10, 0) / 1E10 AS yhat")


def offsets_summary(spark, sf_dir):
    o = scorecard.offset_sensitivity(predictions(spark, sf_dir)).withColumns({"config": F.lit("c"), "horizon": F.lit(5)})
    return snap(scorecard.offset_summary(o))


def _offset_summary_sql() -> str:
    parts = ", ".join(dec_sql(5, o) for o in range(5))
    one = " UNION ALL ".join(f"SELECT {SHARPE.format(r='(0.5 * long_short)', h=5)} AS sr, avg(0.5 * long_short) * 10000 AS bps FROM dp{o}" for o in range(5))
    return PRED + ", " + parts + f", os AS ({one}), t AS (SELECT min(sr) AS min_sr, quantile_cont(sr, 0.5) AS median_sr, max(sr) AS max_sr, min(bps) AS min_spread, max(bps) AS max_spread FROM os) SELECT 'c' AS config, 5 AS horizon, {sql_snap('min_sr', 'median_sr', 'max_sr', 'min_spread', 'max_spread')} FROM t"


def splits(spark, sf_dir):
    return validation.split_table(bars_from_lines(spark, sf_dir), min_test_year=1999, max_test_year=2000, val_years=2)


SPLITS = BARS_SQL + """, dt AS (SELECT DISTINCT date, year(date) AS y FROM panel), fo AS (SELECT date, y, unnest([1999, 2000]) AS t FROM dt
), ro AS (SELECT date, t, CASE WHEN y = t THEN 'test' WHEN y < t AND y >= t - 2 THEN 'val' WHEN y < t - 2 THEN 'train' END AS role FROM fo
), la AS (SELECT *, row_number() OVER (PARTITION BY t, role ORDER BY date DESC) AS late FROM ro WHERE role IS NOT NULL)
SELECT CAST(t AS INTEGER) AS test_year, date, role FROM la WHERE role = 'test' OR late > 5"""


def model_rows(spark, sf_dir):
    bars = forward_returns(bars_from_lines(spark, sf_dir))
    raw = evaluate(bars, FEATURES, keep=("permno", "date", "fwd_ret_1d"))
    return snap(validation.rank_normalized(raw, list(FEATURES), ["permno", "date", "fwd_ret_1d"]), 10)


def gram(spark, sf_dir):
    t = validation.gram_cells(model_rows(spark, sf_dir), list(FEATURES), "fwd_ret_1d")
    return snap(t, 4)


_G = ["1E0", *(f"coalesce({c}, 0E0)" for c in FEATURES), "y"]
GRAM = (
    to_sql(BARS_SQL, {c: e for c, e in FEATURES.items()}, keep=("permno", "segment_id", "date", "close")).rsplit("\nSELECT ", 1)
)
GRAM = (
    GRAM[0]
    + f",\nft AS (SELECT {GRAM[1]}), lb AS (SELECT *, round_even((lead(close, 1) OVER (PARTITION BY permno, segment_id ORDER BY date) / close - 1) * 1E10, 0) / 1E10 AS y, "
    + ", ".join(f"2E0 * (CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + count({c}) OVER (PARTITION BY date ORDER BY {c} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2E0 / count({c}) OVER (PARTITION BY date) END) - 1E0 AS z_{c}" for c in FEATURES)
    + " FROM ft), lr AS (SELECT date, y, "
    + ", ".join(f"round_even(z_{c} * 1E10, 0) / 1E10 AS {c}" for c in FEATURES)
    + " FROM lb WHERE y IS NOT NULL), ld AS (SELECT date, CASE WHEN row_number() OVER (PARTITION BY year(date) ORDER BY date DESC) <= 5 THEN 1 ELSE 0 END AS late FROM (SELECT DISTINCT date FROM lr)), lx AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(late AS INTEGER) AS late, * EXCLUDE (date, late) FROM lr JOIN ld USING (date)) "
    + " UNION ALL ".join(f"SELECT year, late, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, round_even(sum({_G[i]} * {_G[j]}) * 1E4, 0) / 1E4 + 0E0 AS value FROM lx GROUP BY year, late" for i in range(len(_G)) for j in range(i, len(_G)))
)


def enet(spark, sf_dir):
    return snap(_enet(spark, sf_dir).preds)


def enet_coefs(spark, sf_dir):
    run = _enet(spark, sf_dir)
    return snap(run.coefs.join(run.params, "test_year"), 8)


def _enet(spark, sf_dir):
    """All test years that the bars allow, the whole grid."""
    return validation.walk_forward(model_rows(spark, sf_dir), list(FEATURES), "fwd_ret_1d")


def raw_rows(spark, sf_dir):
    return evaluate(forward_returns(bars_from_lines(spark, sf_dir)), FEATURES, keep=("permno", "date", "fwd_ret_1d"))


def standardized(spark, sf_dir):
    """All test years that the bars allow, the whole grid."""
    return snap(validation.walk_forward(raw_rows(spark, sf_dir), list(FEATURES), "fwd_ret_1d", normalize="standardize").preds)


def scalings(spark, sf_dir):
    """Clipping limits and moments of the training and validation block of every fold."""
    rows = settled(raw_rows(spark, sf_dir).where("fwd_ret_1d is not null"))
    first, last = rows.agg(F.year(F.min("date")), F.year(F.max("date"))).first()
    _, scales = validation.scaled_blocks(rows, list(FEATURES), "fwd_ret_1d", list(range(first + 2, last + 1)), first, val_years=1, purge_days=5)
    flat = [(t, c, s.low[k], s.high[k], s.mean[k], s.deviation[k]) for t, s in scales.items() for k, c in enumerate(FEATURES)]
    return snap(spark.createDataFrame(flat, "test_year int, feature string, low double, high double, mean double, deviation double"))


def _scalings_sql() -> str:
    """The same from whole blocks, each sorted by itself."""
    one = "SELECT t AS test_year, '{0}' AS feature, quantile_cont({0}, 0.005) AS low, quantile_cont({0}, 0.995) AS high FROM bk GROUP BY t"
    cut = " UNION ALL ".join(one.format(c) for c in FEATURES)
    own = "SELECT test_year, feature, low, high, least(greatest({0}, low), high) AS x FROM bk JOIN ql ON ql.test_year = bk.t AND ql.feature = '{0}' WHERE {0} IS NOT NULL"
    return GRAM.split(", lr AS (", 1)[0] + f""", lr AS (SELECT date, CAST(year(date) AS INTEGER) AS year, {', '.join(FEATURES)} FROM lb WHERE y IS NOT NULL
), ld AS (SELECT date, row_number() OVER (PARTITION BY year(date) ORDER BY date DESC) <= 5 AS late FROM (SELECT DISTINCT date FROM lr)
), fo AS (SELECT DISTINCT year AS t FROM lr WHERE year >= (SELECT min(year) FROM lr) + 2
), bk AS (SELECT t, lr.* FROM fo JOIN lr ON lr.year < t JOIN ld USING (date) WHERE NOT (late AND lr.year >= t - 2)
), ql AS ({cut}
), cl AS ({' UNION ALL '.join(own.format(c) for c in FEATURES)}
), t AS (SELECT test_year, feature, any_value(low) AS low, any_value(high) AS high, avg(x) AS mean, stddev_pop(x) AS deviation FROM cl GROUP BY test_year, feature)
SELECT test_year, feature, {sql_snap('low', 'high', 'mean', 'deviation')} FROM t"""


def pool_suite(spark, sf_dir):
    """All runs of the whole pool: four configurations and two horizons, ranked, every fit of every fold in one job."""
    frame, base, pool = validation.model_frame(forward_returns(bars_from_lines(spark, sf_dir)), laid=True)
    kept = pool[::2]
    runs = validation.run_suite(frame, validation.feature_configs(base, pool, kept))
    rows = None
    for name, run in runs.items():
        one = run.coefs.join(run.params, "test_year").select(F.lit(name).alias("run"), "test_year", "feature", "coef", "alpha", "l1_ratio", "val_mse")
        rows = one if rows is None else rows.unionAll(one)
    return snap(rows)


#: Coefficients and scales that any engine can be given: intercept, then for each feature b, low, high, mean, deviation.
GIVEN = {1997: (0.001, [(0.5, -0.9, 0.9, 0.0, 0.5), (-0.25, -0.5, 0.5, 0.1, 0.25), (0.125, -1.0, 1.0, 0.0, 1.0), (1.0, -0.25, 0.75, -0.1, 2.0)]), 1998: (-0.002, [(-1.0, -0.8, 0.9, 0.2, 0.5), (0.75, -0.7, 0.6, -0.1, 0.5), (0.0, -1.0, 1.0, 0.0, 1.0), (0.5, -0.5, 0.5, 0.05, 0.25)])}


def given(spark, sf_dir):
    """Predictions of folds with these coefficients on clipped and scaled features."""
    fits = {t: validation.Fit(np.array([x[0] for x in terms]), a, 0.0, 0.0, 0.0) for t, (a, terms) in GIVEN.items()}
    scales = {t: validation.Scaling(*(list(x) for x in list(zip(*terms, strict=True))[1:])) for t, (_, terms) in GIVEN.items()}
    return snap(validation.predicted(model_rows(spark, sf_dir), list(FEATURES), "fwd_ret_1d", fits, scales))


def _given_sql() -> str:
    term = "coalesce({b}::DOUBLE * (greatest(least({c}, {high}::DOUBLE), {low}::DOUBLE) - {mean}::DOUBLE) / {deviation}::DOUBLE, 0E0)"
    scored = " UNION ALL ".join(
        f"SELECT {t} AS test_year, date, permno, y, {a}::DOUBLE + " + " + ".join(f"CASE WHEN {c} IS NULL THEN 0E0 ELSE {term.format(c=c, b=b, low=low, high=high, mean=mean, deviation=deviation)} END" for c, (b, low, high, mean, deviation) in zip(FEATURES, terms, strict=True)) + f" AS yhat FROM lp WHERE year(date) = {t}"
        for t, (a, terms) in GIVEN.items()
    )
    rows = ", ".join(f"round_even(z_{c} * 1E10, 0) / 1E10 AS {c}" for c in FEATURES)
    return GRAM.split(", lr AS (", 1)[0] + f", lp AS (SELECT date, permno, y, {rows} FROM lb WHERE y IS NOT NULL), sc AS ({scored}) SELECT CAST(test_year AS INTEGER) AS test_year, date, permno, {sql_snap('y', 'yhat')} FROM sc"


# Audit --------------------------------------------------------------------------------------------------------------


def labelled(spark, sf_dir):
    return forward_returns(bars_from_lines(spark, sf_dir))


LAB = BARS_SQL + """, lab AS (SELECT *, lead(close, 1) OVER w / close - 1 AS fwd_ret_1d, lead(close, 5) OVER w / close - 1 AS fwd_ret_5d,
  CASE WHEN lag(segment_id) OVER v = segment_id THEN close / lag(close) OVER v - 1 END AS back, CASE WHEN lead(segment_id) OVER v = segment_id THEN lead(ret) OVER v END AS next,
  CASE WHEN lead(segment_id) OVER v = segment_id THEN lead(close) OVER v / close - 1 END AS px1, CASE WHEN lead(segment_id, 5) OVER v = segment_id THEN lead(close, 5) OVER v / close - 1 END AS px5
  FROM panel WINDOW w AS (PARTITION BY permno, segment_id ORDER BY date), v AS (PARTITION BY permno ORDER BY date))"""


def _diff_sql(name: str, a: str, b: str) -> str:
    return f"SELECT '{name}' AS \"check\", count(d) AS n, round_even(quantile_cont(d, 0.5) * 1E8, 0) / 1E8 + 0E0 AS median_abs, round_even(quantile_cont(d, 0.99) * 1E8, 0) / 1E8 + 0E0 AS p99_abs, round_even(avg(CASE WHEN d < 1E-8 THEN 1E0 ELSE 0E0 END) * 1E8, 0) / 1E8 + 0E0 AS share_lt_1e8, round_even(avg(CASE WHEN d < 1E-4 THEN 1E0 ELSE 0E0 END) * 1E8, 0) / 1E8 + 0E0 AS share_lt_1e4 FROM (SELECT abs({a} - {b}) AS d FROM lab) WHERE d IS NOT NULL"


SHARES = ("ret", "fwd_ret_1d", "fwd_ret_5d", "volume")
A7 = library.alpha_features([7])
A7_SQL = to_sql(BARS_SQL, A7, keep=("permno", "date"), digits=10).rsplit("\nSELECT ", 1)
A7_SQL = A7_SQL[0] + f",\na7 AS (SELECT {A7_SQL[1]})"


def degeneracy(spark, sf_dir):
    a7 = evaluate(bars_from_lines(spark, sf_dir), A7, keep=("permno", "date"), digits=10, kernels=False)
    return snap(audit.degeneracy(a7, "alpha_007"))


def score_sql(run: str, horizon: int) -> str:
    return f"{IC}, {dec_sql(horizon)}, a AS (SELECT avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, count(ic) AS n_active_years FROM icy), b AS (SELECT avg(sharpe) AS mean_gross_sharpe FROM (SELECT {SHARPE.format(r='long_short', h=horizon)} AS sharpe FROM dp0 GROUP BY test_year)), m AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in DECILES)} FROM dp0), u AS (SELECT *, mean_ic / ic_std AS ir, mean_ic / ic_std * sqrt(n_active_years) AS t_stat, coalesce({' AND '.join(f'{y} >= {x}' for x, y in zip(DECILES[:-1], DECILES[1:], strict=True))}, false) AS decile_monotonic FROM a, b, m) SELECT '{run}' AS run, {sql_snap('mean_ic', 'ic_std', 'ir', 't_stat')}, n_active_years, {sql_snap('mean_gross_sharpe')}, decile_monotonic FROM u"


def _scored(f):
    return lambda spark, sf_dir: snap(f(predictions(spark, sf_dir)))


#: name -> (query, SQL or None).
QUERIES = {
    "daily_ic": (_scored(lambda p: scorecard.daily_ic(p)), f"{IC} SELECT date, {sql_snap('ic')} FROM ic"),
    "ic_by_year": (_scored(scorecard.ic_by_year), f"{IC} SELECT test_year, {sql_snap('ic')} FROM icy"),
    "pooled_ic": (_scored(scorecard.pooled_pearson_by_year), f"{PRED}, t AS (SELECT test_year, {sql_corr('y', 'yhat')} AS ic FROM pred GROUP BY test_year) SELECT test_year, {sql_snap('ic')} FROM t"),
    "mean_daily_ic": (_scored(scorecard.mean_daily_spearman_by_year), f"{IC}, t AS (SELECT test_year, avg(ic) AS ic FROM (SELECT test_year, date, {sql_corr('ry', 'rh')} AS ic FROM rk GROUP BY ALL) GROUP BY test_year) SELECT test_year, {sql_snap('ic')} FROM t"),
    "ic_summary": (_scored(lambda p: scorecard.ic_stats(scorecard.ic_by_year(p))), f"{IC}, t AS (SELECT avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, count(ic) AS n_active_years FROM icy), u AS (SELECT *, mean_ic / ic_std AS ir, mean_ic / ic_std * sqrt(n_active_years) AS t_stat FROM t) SELECT {sql_snap('mean_ic', 'ic_std', 'ir', 't_stat')}, n_active_years FROM u"),
    "decile_portfolio": (lambda s, d: snap(deciles(s, d)), f"{DEC} SELECT test_year, date, {sql_snap(*DECILES, 'long_short')} FROM dp0"),
    "decile_monotonicity": (lambda s, d: snap(scorecard.decile_means(deciles(s, d))), f"{DEC}, m AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in DECILES)} FROM dp0) SELECT {sql_snap(*DECILES)}, coalesce({' AND '.join(f'{b} >= {a}' for a, b in zip(DECILES[:-1], DECILES[1:], strict=True))}, false) AS decile_monotonic FROM m"),
    "gross_sharpe_by_year": (lambda s, d: snap(scorecard.sharpe_by_year(deciles(s, d))), f"{DEC}, t AS (SELECT test_year, {SHARPE.format(r='long_short', h=1)} AS sharpe FROM dp0 GROUP BY test_year) SELECT test_year, {sql_snap('sharpe')} FROM t"),
    "pooled_sharpe": (lambda s, d: snap(scorecard.pooled_sharpe(deciles(s, d))), f"{DEC}, t AS (SELECT {SHARPE.format(r='(0.5 * long_short)', h=1)} AS gross_sharpe, avg(0.5 * long_short) * 10000 AS long_short_bps, count(*) AS n_formations FROM dp0) SELECT {sql_snap('gross_sharpe', 'long_short_bps')}, n_formations FROM t"),
    "cumulative_long_short": (lambda s, d: snap(scorecard.cumulative_long_short(deciles(s, d, horizon=5)).select("date", F.log("cumulative").alias("log_cumulative")), 6), f"{PRED}, {dec_sql(5)}, t AS (SELECT date, ln(product(1 + long_short) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS log_cumulative FROM dp0 WHERE long_short IS NOT NULL) SELECT date, {sql_snap('log_cumulative', digits=6)} FROM t"),
    "stress_windows": (stress, STRESS),
    "stress_over_runs": (stress_runs, f"SELECT 'reversal' AS run, * FROM ({STRESS}) UNION ALL SELECT 'momentum' AS run, * FROM ({stress_sql(5).replace(*OPPOSITE)})"),
    "offset_summary": (offsets_summary, _offset_summary_sql()),
    "tuning_complexity": (tuning, None),
    "offset_sensitivity": (_scored(lambda p: scorecard.offset_sensitivity(p).drop("long_short_bps")), _offsets_sql()),
    "decile_profile": (lambda s, d: snap(scorecard.decile_profile(deciles(s, d))), f"{DEC}, yr AS (SELECT test_year, {', '.join(f'avg({c}) AS {c}' for c in DECILES)} FROM dp0 GROUP BY test_year), lg AS ({' UNION ALL '.join(f'SELECT {k} AS decile, decile_{k} AS r FROM yr' for k in range(1, 11))}), t AS (SELECT decile, avg(r) AS mean_return, stddev_samp(r) / sqrt(count(r)) AS se_across_years, count(r) AS n_years FROM lg GROUP BY decile) SELECT decile, {sql_snap('mean_return', 'se_across_years')}, n_years FROM t"),
    "scorecard_table": (lambda s, d: snap(scorecard.scorecard(two_runs(predictions(s, d)))), f"SELECT * FROM ({score_sql('reversal', 1)}) UNION ALL SELECT * FROM ({score_sql('momentum', 5).replace(*OPPOSITE)})"),
    "run_summary": (_scored(lambda p: scorecard.run_summary(p)), f"{IC}, {dec_sql()}, iy AS (SELECT test_year, avg(ic) AS ic FROM (SELECT test_year, date, {sql_corr('ry', 'rh')} AS ic FROM rk GROUP BY ALL) GROUP BY test_year), a AS (SELECT avg(ic) AS mean_ic_active, stddev_samp(ic) AS ic_std_active, count(ic) AS n_active_years, avg(coalesce(ic, 0E0)) AS mean_ic_all_years, CAST(sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_ic_years FROM iy), b AS (SELECT {SHARPE.format(r='(0.5 * long_short)', h=1)} AS gross_sharpe, avg(0.5 * long_short) * 10000 AS long_short_bps, count(*) AS n_formations FROM dp0), m AS (SELECT avg(y) AS mean_test_return FROM pred) SELECT {sql_snap('mean_ic_active', 'ic_std_active')}, n_active_years, {sql_snap('mean_ic_all_years')}, positive_ic_years, {sql_snap('gross_sharpe', 'long_short_bps')}, n_formations, {sql_snap('mean_test_return')} FROM a, b, m"),
    "nonzero_by_year": (lambda s, d: scorecard.nonzero_by_year(coefs(s, d)), f"{COEFS} SELECT test_year, CAST(sum(CASE WHEN abs(coef) > 1E-8 THEN 1 ELSE 0 END) AS BIGINT) AS n_nonzero FROM cy GROUP BY test_year"),
    "coefficient_comparison": (lambda s, d: snap(scorecard.coefficient_comparison(coefs(s, d), ["f_rev", "f_loc"])), f"{COEFS}, t AS (SELECT feature, feature IN ('f_rev', 'f_loc') AS kept_by_correlation_filter, max(abs(coef)) > 1E-8 AS kept_by_elastic_net_any_fold, avg(abs(coef)) AS mean_abs_coef FROM cy GROUP BY feature) SELECT feature, kept_by_correlation_filter, kept_by_elastic_net_any_fold, {sql_snap('mean_abs_coef')} FROM t"),
    "agreement_rate": (lambda s, d: scorecard.agreement_rate(scorecard.coefficient_comparison(coefs(s, d), ["f_rev", "f_loc"])), f"{COEFS}, t AS (SELECT feature IN ('f_rev', 'f_loc') AS a, max(abs(coef)) > 1E-8 AS b FROM cy GROUP BY feature) SELECT avg(CASE WHEN a = b THEN 1E0 ELSE 0E0 END) AS agreement FROM t"),
    "coefficient_stability": (lambda s, d: scorecard.coefficient_stability(coefs(s, d), 2), f"{COEFS} SELECT test_year, feature, coef FROM cy WHERE feature IN (SELECT feature FROM cy GROUP BY feature ORDER BY avg(abs(coef)) DESC, feature LIMIT 2)"),
    "reproduction_gap": (lambda s, d: snap(scorecard.reproduction_gap(coefs(s, d), coefs(s, d).where("test_year <> 1998 or feature <> 'f_vol'").withColumn("coef", F.col("coef") * 0.75))), f"{COEFS} SELECT round_even(max(CASE WHEN test_year = 1998 AND feature = 'f_vol' THEN abs(coef) ELSE abs(coef - coef * 0.75E0) END) * 1E8, 0) / 1E8 + 0E0 AS max_abs_diff FROM cy"),
    "normalization_ablation": (ablation, f"{PAIR} SELECT config, scheme, test_year, {sql_snap('pearson_ic', 'daily_spearman_ic')}, n_nonzero_coefs FROM det"),
    "ablation_summary": (lambda s, d: snap(scorecard.ablation_summary(scorecard.ablation_detail(*schemes(s, d))).select("config", "pearson_ic__paired_rank", "pearson_ic__paired_standardize", "pearson_ic__paired_delta", "pearson_ic__n_paired_years")), f"{PAIR}, a AS (SELECT config, test_year, pearson_ic AS r FROM det WHERE scheme = 'rank'), b AS (SELECT config, test_year, pearson_ic AS s FROM det WHERE scheme = 'standardize'), t AS (SELECT config, avg(r) AS pearson_ic__paired_rank, avg(s) AS pearson_ic__paired_standardize, avg(s - r) AS pearson_ic__paired_delta, count(*) AS pearson_ic__n_paired_years FROM a JOIN b USING (config, test_year) WHERE r IS NOT NULL AND s IS NOT NULL GROUP BY config) SELECT config, {sql_snap('pearson_ic__paired_rank', 'pearson_ic__paired_standardize', 'pearson_ic__paired_delta')}, pearson_ic__n_paired_years FROM t"),
    "feature_coverage": (lambda s, d: snap(prune.coverage(features(s, d), list(FEATURES))), f"{FEAT}, t AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NOT NULL THEN 1E0 ELSE 0E0 END) AS coverage FROM ft''' for c in FEATURES)}) SELECT feature, {sql_snap('coverage')} FROM t"),
    "mean_daily_spearman": (spearman, SPEARMAN),
    "pool_spearman": (pool_spearman, _pool_spearman_sql()),
    "model_frame": (model_frame, _model_frame_sql()),
    "greedy_prune": (greedy, _greedy_sql()),
    "split_table": (splits, SPLITS),
    "gram_by_year": (gram, GRAM),
    "walk_forward_elastic_net": (enet, None),
    "elastic_net_coefficients": (enet_coefs, None),
    "walk_forward_standardized": (standardized, None),
    "standardized_scalings": (scalings, _scalings_sql()),
    "pool_suite_coefficients": (pool_suite, None),
    "predictions_of_given_coefficients": (given, _given_sql()),
    "panel_counts": (lambda s, d: audit.counts(bars_from_lines(s, d)), f"{BARS_SQL} SELECT count(*) AS n_rows, count(DISTINCT permno) AS n_permno, count(DISTINCT date) AS n_dates, CAST(min(date) AS VARCHAR) AS date_min, CAST(max(date) AS VARCHAR) AS date_max FROM panel"),
    "names_per_day": (lambda s, d: audit.names_per_day(bars_from_lines(s, d)), f"{BARS_SQL} SELECT min(n) AS names_min, quantile_cont(CAST(n AS DOUBLE), 0.5) AS names_median, max(n) AS names_max FROM (SELECT count(DISTINCT permno) AS n FROM panel GROUP BY date)"),
    "missing_share": (lambda s, d: snap(audit.missing_share(labelled(s, d), list(SHARES))), f"{LAB}, t AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1E0 ELSE 0E0 END) AS share FROM lab''' for c in SHARES)}) SELECT feature, {sql_snap('share')} FROM t"),
    "target_missing": (lambda s, d: snap(audit.missing_share(labelled(s, d), ["fwd_ret_1d", "fwd_ret_5d"])), f"{LAB}, t AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1E0 ELSE 0E0 END) AS share FROM lab''' for c in ('fwd_ret_1d', 'fwd_ret_5d'))}) SELECT feature, {sql_snap('share')} FROM t"),
    "duplicate_keys": (lambda s, d: audit.duplicate_keys(bars_from_lines(s, d)), f"{BARS_SQL} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS dup_permno_date FROM (SELECT count(*) AS n FROM panel GROUP BY permno, date)"),
    "ohlc_sanity": (lambda s, d: snap(audit.ohlc_sanity(bars_from_lines(s, d))), f"{BARS_SQL} SELECT avg(CASE WHEN high < greatest(open, close) THEN 1E0 ELSE 0E0 END) AS high_lt_body, avg(CASE WHEN low > least(open, close) THEN 1E0 ELSE 0E0 END) AS low_gt_body, avg(CASE WHEN close <= 0 THEN 1E0 ELSE 0E0 END) AS nonpos_close, avg(CASE WHEN volume < 0 THEN 1E0 ELSE 0E0 END) AS neg_volume FROM panel"),
    "gap_histogram": (lambda s, d: audit.gap_histogram(bars_from_lines(s, d)), f"{BARS_SQL} SELECT CAST(least(g, 60) AS INTEGER) AS gap_days, count(*) AS n FROM (SELECT date_diff('day', lag(date) OVER (PARTITION BY permno ORDER BY date), date) AS g FROM panel) WHERE g IS NOT NULL GROUP BY ALL ORDER BY gap_days LIMIT 15"),
    "segment_counts": (lambda s, d: audit.segment_counts(bars_from_lines(s, d), max_gap_days=30), f"{BARS_SQL} SELECT (SELECT CAST(sum(m) AS BIGINT) FROM (SELECT max(segment_id) + 1 AS m FROM panel GROUP BY permno)) AS n_segments, (SELECT count(*) FROM gap WHERE g = 1) AS n_long_gaps"),
    "reentries": (lambda s, d: audit.reentries(bars_from_lines(s, d)), f"{BARS_SQL} SELECT permno, count(DISTINCT segment_id) AS n_segments FROM panel GROUP BY permno HAVING count(DISTINCT segment_id) > 1"),
    "return_identity": (lambda s, d: snap(audit.return_identity(labelled(s, d))), f"{LAB} " + " UNION ALL ".join(_diff_sql(*x) for x in (("ret_vs_price", "ret", "back"), ("fwd1_vs_next_ret", "fwd_ret_1d", "next"), ("fwd1_vs_price", "fwd_ret_1d", "px1"), ("fwd5_vs_price", "fwd_ret_5d", "px5")))),
    "alpha_007_degeneracy": (degeneracy, f"{A7_SQL} SELECT (SELECT round_even(avg(CASE WHEN alpha_007 = -1 THEN 1E0 ELSE 0E0 END) * 1E8, 0) / 1E8 FROM a7) AS share_eq, (SELECT count(DISTINCT alpha_007) FROM a7) AS n_distinct, (SELECT round_even(avg(CASE WHEN n = 1 THEN 1E0 ELSE 0E0 END) * 1E8, 0) / 1E8 FROM (SELECT count(DISTINCT alpha_007) AS n FROM a7 GROUP BY date)) AS share_dates_constant, (SELECT min(n) FROM (SELECT count(DISTINCT alpha_007) AS n FROM a7 GROUP BY year(date))) AS by_year_min, (SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) FROM (SELECT count(DISTINCT alpha_007) AS n FROM a7 GROUP BY year(date))) AS by_year_median"),
}
