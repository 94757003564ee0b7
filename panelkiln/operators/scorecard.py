"""Scoring of predictions (test_year, date, permno, y, yhat): information coefficients, decile portfolios, Sharpe ratios.

Most functions take `by`: further key columns, so that many runs are scored by one plan, as rows of one table (see stacked)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.panel import input_rows, spread
from ..sources.scratch import settled

TRADING_DAYS = 252
#: Years of market stress.
STRESS = {"2008_gfc": (2008, 2008), "2020_covid": (2020, 2020), "2022_rate_hikes": (2022, 2022), "2025_tariffs": (2025, 2025)}
ZERO_TOL = 1e-8


def average_rank(c: str, *keys: str) -> Column:
    """Rank with ties averaged, of non-null values within keys."""
    w = Window.partitionBy(*keys).orderBy(F.col(c).asc_nulls_last())
    return F.when(F.col(c).isNotNull(), (F.rank().over(w) + F.count(c).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0)


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; null where a side is constant."""
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    return F.when((sx > 1e-15) & (sy > 1e-15), F.covar_samp(x, y) / (sx * sy))


def daily_ic(preds: DataFrame, *, keys=("date",), least: int = 3) -> DataFrame:
    """keys and ic: Spearman correlation of y and yhat of each date; null with fewer than `least` rows, or with a constant yhat or y.
    The variants of the reports differ in these guards only. Ranks of each side are sorted within the date, one exchange in all, sized by the input."""
    # pairwise complete, as y or yhat may be null
    both = preds.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
    if "date" in keys:  # tasks grow in number with the input, not in size
        both = spread(both, input_rows(both), "date", always=False)
    rows = preds.groupBy(*keys).agg(F.count("*").alias("rows"))
    ranked = both.select(*keys, average_rank("y", *keys).alias("ry"), average_rank("yhat", *keys).alias("rh"), "y", "yhat")
    ic = ranked.groupBy(*keys).agg(pearson("ry", "rh").alias("ic"))
    joined = rows.join(ic, list(keys), "left")
    return joined.select(*keys, F.when(F.col("rows") >= least, F.col("ic")).alias("ic")) if least > 1 else joined.select(*keys, "ic")


def ic_by_year(preds: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """test_year, ic: mean of the daily coefficients, null dates left out."""
    return daily_ic(preds, keys=(*by, "test_year", "date")).groupBy(*by, "test_year").agg(F.avg("ic").alias("ic"))


def mean_daily_spearman_by_year(preds: DataFrame) -> DataFrame:
    """The variant without a least number of rows."""
    return daily_ic(preds, keys=("test_year", "date"), least=1).groupBy("test_year").agg(F.avg("ic").alias("ic"))


def pooled_pearson_by_year(preds: DataFrame) -> DataFrame:
    return preds.where("y is not null and yhat is not null").groupBy("test_year").agg(pearson("y", "yhat").alias("ic"))


def ic_stats(by_year: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """mean_ic, ic_std, ir, t_stat, n_active_years over years with a coefficient."""
    t = by_year.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("n_active_years"))
    ir = F.when(F.col("ic_std") > 0, F.col("mean_ic") / F.col("ic_std"))
    return t.select(*by, "mean_ic", "ic_std", ir.alias("ir"), (ir * F.sqrt("n_active_years")).alias("t_stat"), "n_active_years")


def decile_portfolio(preds: DataFrame, *, horizon: int | str = 1, offset: int | None = 0, n: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """test_year, date, decile_1 .. decile_n, long_short: mean y of equal groups by yhat (ties to the smaller permno), on every
    horizon-th date of each test year from `offset` on; dates with fewer than n rows or a constant yhat are left out.

    horizon: a number, or the column of `by` that holds it. offset: None forms all of them, each date under its own (column offset), in the
    same sort."""
    if offset is not None and (offset < 0 or not isinstance(horizon, str) and offset >= horizon):
        raise ValueError(f"offset must lie in [0, {horizon}), not {offset}")
    step = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    dates = preds.select(*by, "test_year", "date").distinct()
    place = F.dense_rank().over(Window.partitionBy(*by, "test_year").orderBy("date")) - 1
    placed = dates.withColumn("offset", (place % step).cast("int"))
    keys = [*by, "test_year", "date"]
    chosen = placed if offset is None else placed.where(F.col("offset") == offset).drop("offset")
    day = Window.partitionBy(*keys)
    known = preds.where(F.col("yhat").isNotNull()).select(*keys, "permno", "y", "yhat")
    rows = known.join(chosen, keys)
    kept = [*keys, *(["offset"] if offset is None else [])]
    rows = rows.withColumns({"r": F.row_number().over(day.orderBy("yhat", "permno")), "n": F.count("*").over(day), "lo": F.min("yhat").over(day), "hi": F.max("yhat").over(day)})
    cut = rows.where((F.col("n") >= n) & (F.col("lo") < F.col("hi"))).withColumn("d", F.greatest(F.lit(1), F.ceil((F.col("r") - 1) * n / (F.col("n") - 1))).cast("int"))
    wide = cut.groupBy(*kept).pivot("d", list(range(1, n + 1))).agg(F.avg("y"))
    wide = wide.select(*kept, *(F.col(str(k)).alias(f"decile_{k}") for k in range(1, n + 1)))
    return wide.withColumn("long_short", F.col(f"decile_{n}") - F.col("decile_1"))


def decile_means(deciles: DataFrame, n: int = 10, *, by: tuple[str, ...] = ()) -> DataFrame:
    """decile_1 .. decile_n averaged over dates, and whether they never fall."""
    means = deciles.groupBy(*by).agg(*(F.avg(f"decile_{k}").alias(f"decile_{k}") for k in range(1, n + 1)))
    rising = F.lit(True)
    for k in range(1, n):
        rising = rising & (F.col(f"decile_{k + 1}") >= F.col(f"decile_{k}"))
    return means.withColumn("decile_monotonic", F.coalesce(rising, F.lit(False)))


def _sharpe(r: Column, horizon: int | str) -> Column:
    s = F.stddev_samp(r)
    scale = F.sqrt(TRADING_DAYS / F.first(horizon)) if isinstance(horizon, str) else F.lit((TRADING_DAYS / horizon) ** 0.5)
    return F.when((F.count(r) >= 2) & (s > 0), F.avg(r) / s * scale)


def sharpe_by_year(deciles: DataFrame, *, horizon: int | str = 1, by: tuple[str, ...] = ()) -> DataFrame:
    return deciles.groupBy(*by, "test_year").agg(_sharpe(F.col("long_short"), horizon).alias("sharpe"))


def pooled_sharpe(deciles: DataFrame, *, horizon: int | str = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """The other convention: one ratio of half the long-short return over all formation dates."""
    r = F.col("long_short") * 0.5
    return deciles.groupBy(*by).agg(_sharpe(r, horizon).alias("gross_sharpe"), (F.avg(r) * 10_000).alias("long_short_bps"), F.count("*").alias("n_formations"))


def cumulative_long_short(deciles: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """date, cumulative: running product of 1 + long_short by date, of each `by`.

    A scan in two levels: within a calendar year in a window of its own, and the product of the years before from a table of years. A
    product is kept as its sum of logarithms, its number of negative factors and of zeros, which all add up."""
    x = 1 + F.col("long_short")
    size = {"log": F.coalesce(F.log(F.abs(F.when(x != 0, x))), F.lit(0.0)), "minus": (x < 0).cast("int"), "zero": (x == 0).cast("int")}
    rows = deciles.where("long_short is not null").select(*by, "date", F.year("date").alias("year"), *(c.alias(k) for k, c in size.items()))
    years = rows.groupBy(*by, "year").agg(*(F.sum(k).alias(k) for k in size))
    seen, past = years.select(*by, "year"), years.withColumnRenamed("year", "past")
    own = past.withColumnsRenamed({c: f"own_{c}" for c in by})
    earlier = F.col("past") < F.col("year")
    for c in by:
        earlier = earlier & (F.col(c) == F.col(f"own_{c}"))
    before = seen.join(own, earlier).groupBy(*by, "year").agg(*(F.sum(k).alias(f"{k}_before") for k in size))
    w = Window.partitionBy(*by, "year").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select(*by, "year", "date", *(F.sum(k).over(w).alias(k) for k in size)).join(before, [*by, "year"], "left")
    total = {k: F.col(k) + F.coalesce(F.col(f"{k}_before"), F.lit(0)) for k in size}
    sign = F.when(total["minus"] % 2 == 1, -1.0).otherwise(1.0)
    return within.select(*by, "date", F.when(total["zero"] > 0, 0.0).otherwise(sign * F.exp(total["log"])).alias("cumulative"))


def stress_windows(spark, ic: DataFrame, sharpe: DataFrame, windows: dict = STRESS, *, runs: list[str] | None = None) -> DataFrame:
    """window, years_covered, n_years, mean_ic, mean_gross_sharpe; a window without data has a row of its own. runs: of each of these, told by
    the column run."""
    by = ["run"] if runs is not None else []
    w = spark.createDataFrame([(r, k, a, b) for r in (runs or [""]) for k, (a, b) in windows.items()], "run string, window string, a int, b int")
    w = w if by else w.drop("run")
    years = ic.join(sharpe, [*by, "test_year"], "left").withColumnsRenamed({c: f"own_{c}" for c in by})
    held = F.col("test_year").between(F.col("a"), F.col("b"))
    joined = F.broadcast(w).join(years, held & (F.col("run") == F.col("own_run")) if by else held, "left")  # runs by windows
    return joined.groupBy(*by, "window").agg(F.sort_array(F.collect_list("test_year")).alias("years_covered"), F.count("test_year").alias("n_years"), F.avg("ic").alias("mean_ic"), F.avg("sharpe").alias("mean_gross_sharpe"))


def decile_profile(deciles: DataFrame, n: int = 10, *, by: tuple[str, ...] = ()) -> DataFrame:
    """decile, mean_return, se_across_years, n_years: over yearly means."""
    yearly = deciles.groupBy(*by, "test_year").agg(*(F.avg(f"decile_{k}").alias(str(k)) for k in range(1, n + 1)))
    long = yearly.unpivot([*by, "test_year"], [str(k) for k in range(1, n + 1)], "decile", "r")
    return long.groupBy(*by, F.col("decile").cast("int").alias("decile")).agg(F.avg("r").alias("mean_return"), (F.stddev_samp("r") / F.sqrt(F.count("r"))).alias("se_across_years"), F.count("r").alias("n_years"))


def spine(by_year: DataFrame, years) -> DataFrame:
    """by_year with a row for each of these years and no other; what a year lacks is null."""
    every = by_year.sparkSession.createDataFrame([(int(y),) for y in years], "test_year int")
    return every.join(by_year, "test_year", "left")


def run_summary(preds: DataFrame, *, horizon: int = 1, years=None) -> DataFrame:
    """One row: active and null-as-zero mean IC, years, pooled Sharpe, formations, mean return. years: those that null-as-zero counts, with
    predictions or not; by default those with predictions."""
    by_year = daily_ic(preds, keys=("test_year", "date"), least=1).groupBy("test_year").agg(F.avg("ic").alias("ic"))
    by_year = by_year if years is None else spine(by_year, years)
    ic = by_year.agg(F.avg("ic").alias("mean_ic_active"), F.stddev_samp("ic").alias("ic_std_active"), F.count("ic").alias("n_active_years"), F.avg(F.coalesce("ic", F.lit(0.0))).alias("mean_ic_all_years"), F.coalesce(F.sum((F.col("ic") > 0).cast("int")), F.lit(0)).alias("positive_ic_years"))
    return ic.join(pooled_sharpe(decile_portfolio(preds, horizon=horizon), horizon=horizon)).join(preds.agg(F.avg("y").alias("mean_test_return")))  # one row each


def offset_sensitivity(preds: DataFrame, *, horizon: int = 5) -> DataFrame:
    """offset and pooled Sharpe of each start of the formation cadence, all formed in one sort: a date is formed by one start only."""
    found = pooled_sharpe(decile_portfolio(preds, horizon=horizon, offset=None), horizon=horizon, by=("offset",))
    every = preds.sparkSession.range(horizon).select(F.col("id").cast("int").alias("offset"))
    return every.join(found, "offset", "left").withColumn("n_formations", F.coalesce("n_formations", F.lit(0)))


def stacked(runs: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Predictions of all runs (predictions, horizon) as rows: run, horizon, test_year, date, permno, y, yhat."""
    rows = None
    for name, (preds, horizon) in runs.items():
        r = preds.select(F.lit(name).alias("run"), F.lit(horizon).alias("horizon"), "test_year", "date", "permno", "y", "yhat")
        rows = r if rows is None else rows.unionAll(r)
    return rows


RUN = ("run", "horizon")


def scorecard(runs: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """A row for each run (predictions, horizon), best mean IC first: run, IC statistics, mean of yearly Sharpe ratios, monotonicity. The run
    is a key, so the plan has the exchanges of one run's, however many there are."""
    preds = stacked(runs)
    deciles = decile_portfolio(preds, horizon="horizon", by=RUN)
    sharpe = sharpe_by_year(deciles, horizon="horizon", by=RUN).groupBy("run").agg(F.avg("sharpe").alias("mean_gross_sharpe"))
    parts = (ic_stats(ic_by_year(preds, by=("run",)), by=("run",)), sharpe, decile_means(deciles, by=("run",)).select("run", "decile_monotonic"))
    rows = preds.sparkSession.createDataFrame([(name,) for name in runs], "run string")
    for part in parts:
        rows = rows.join(part, "run", "left")
    rows = rows.select("run", "mean_ic", "ic_std", "ir", "t_stat", F.coalesce("n_active_years", F.lit(0)).alias("n_active_years"), "mean_gross_sharpe", F.coalesce("decile_monotonic", F.lit(False)).alias("decile_monotonic"))
    return rows.orderBy(F.desc_nulls_last("mean_ic"))


def stress_over_runs(spark, runs: dict[str, tuple[DataFrame, int]], windows: dict = STRESS) -> DataFrame:
    """stress_windows of every run (predictions, horizon), with its name."""
    preds = stacked(runs)
    sharpe = sharpe_by_year(decile_portfolio(preds, horizon="horizon", by=RUN), horizon="horizon", by=RUN).drop("horizon")
    return stress_windows(spark, ic_by_year(preds, by=("run",)), sharpe, windows, runs=list(runs))


def run_curves(runs: dict[str, tuple[DataFrame, int]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the scorecard's plots show: run and IC by year; run and long-short return cumulated by date; run and mean return by decile."""
    preds, by = stacked(runs), ("run",)
    deciles = decile_portfolio(preds, horizon="horizon", by=RUN)
    return ic_by_year(preds, by=by), cumulative_long_short(deciles, by=by), decile_profile(deciles, by=by)


def nonzero_by_year(coefs: DataFrame, years=None) -> DataFrame:
    """test_year, n_nonzero from (test_year, feature, coef); with years also those without coefficients, as 0."""
    found = coefs.groupBy("test_year").agg(F.sum((F.abs("coef") > ZERO_TOL).cast("long")).alias("n_nonzero"))
    return found if years is None else spine(found, years).fillna(0, ["n_nonzero"])


def tuning_complexity(params: DataFrame, coefs: DataFrame, years=None) -> DataFrame:
    """test_year, alpha, l1_ratio, val_mse, n_nonzero: what each fold chose, and how many coefficients it left; nulls for years without."""
    found = params.join(nonzero_by_year(coefs), "test_year", "left").select("test_year", "alpha", "l1_ratio", "val_mse", "n_nonzero")
    return found if years is None else spine(found, years)


def offset_summary(offsets: DataFrame) -> DataFrame:
    """Per config and horizon least, median and greatest Sharpe ratio over the offsets, and least and greatest mean return (a row for each
    offset comes in: config, horizon, offset, gross_sharpe, long_short_bps)."""
    return offsets.groupBy("config", "horizon").agg(F.min("gross_sharpe").alias("min_sr"), F.percentile("gross_sharpe", F.lit(0.5)).alias("median_sr"), F.max("gross_sharpe").alias("max_sr"), F.min("long_short_bps").alias("min_spread"), F.max("long_short_bps").alias("max_spread"))


def stress_pivot(by_year: DataFrame, years) -> DataFrame:
    """Per config and horizon the IC and the Sharpe ratio of each year side by side, from (config, horizon, test_year, ic, gross_sharpe)."""
    return by_year.groupBy("config", "horizon").pivot("test_year", [int(y) for y in years]).agg(F.avg("ic").alias("ic"), F.avg("gross_sharpe").alias("gross_sharpe"))


def coefficient_comparison(coefs: DataFrame, kept: list[str]) -> DataFrame:
    """feature, whether the correlation filter and whether any fold's elastic net kept it, mean absolute coefficient."""
    t = coefs.groupBy("feature").agg((F.max(F.abs("coef")) > ZERO_TOL).alias("kept_by_elastic_net_any_fold"), F.avg(F.abs("coef")).alias("mean_abs_coef"))
    return t.select("feature", F.col("feature").isin(kept).alias("kept_by_correlation_filter"), "kept_by_elastic_net_any_fold", "mean_abs_coef")


def agreement_rate(comparison: DataFrame) -> DataFrame:
    return comparison.agg(F.avg((F.col("kept_by_correlation_filter") == F.col("kept_by_elastic_net_any_fold")).cast("double")).alias("agreement"))


def coefficient_stability(coefs: DataFrame, top: int = 12, years=None) -> DataFrame:
    """Coefficients by year of the features of largest mean absolute coefficient. years: all of these, 0 where a fold has no coefficient."""
    if years is not None:
        every = coefs.select("feature").distinct().crossJoin(coefs.sparkSession.createDataFrame([(int(y),) for y in years], "test_year int"))  # names by years
        coefs = every.join(coefs, ["test_year", "feature"], "left").select("test_year", "feature", F.coalesce("coef", F.lit(0.0)).alias("coef"))
    best = coefs.groupBy("feature").agg(F.avg(F.abs("coef")).alias("m")).orderBy(F.desc("m"), "feature").limit(top)
    return coefs.join(F.broadcast(best.select("feature")), "feature", "left_semi")  # `top` rows


def ablation_detail(preds: DataFrame, coefs: DataFrame) -> DataFrame:
    """config, scheme, test_year, pearson_ic, daily_spearman_ic, n_nonzero_coefs from tables with config and scheme."""
    keys = ["config", "scheme", "test_year"]
    p = preds.where("y is not null and yhat is not null").groupBy(*keys).agg(pearson("y", "yhat").alias("pearson_ic"))
    s = daily_ic(preds, keys=(*keys, "date"), least=1).groupBy(*keys).agg(F.avg("ic").alias("daily_spearman_ic"))
    z = coefs.groupBy(*keys).agg(F.sum((F.abs("coef") > ZERO_TOL).cast("long")).alias("n_nonzero_coefs"))
    return p.join(s, keys).join(z, keys)


def ablation_summary(detail: DataFrame, schemes=("rank", "standardize")) -> DataFrame:
    """Per config: means by scheme, folds, and paired means and difference over years where both schemes have a value. The detail, a row for each
    run and year, is settled first, as it is read several times."""
    detail = settled(detail, "detail")
    sets = detail.groupBy("config", "scheme").agg(F.sort_array(F.collect_set("test_year")).alias("y")).select("y").distinct()
    if sets.count() > 1:
        raise ValueError("runs disagree on their test years")
    flat = detail.groupBy("config").pivot("scheme", list(schemes)).agg(F.avg("pearson_ic").alias("pearson_ic"), F.avg("daily_spearman_ic").alias("daily_spearman_ic"), F.sum((F.col("n_nonzero_coefs") == 0).cast("int")).alias("n_null_folds"), F.count("pearson_ic").alias("n_active_folds"), F.count(F.lit(1)).alias("n_folds"))
    for metric in ("pearson_ic", "daily_spearman_ic"):
        a, b = schemes
        wide = detail.groupBy("config", "test_year").pivot("scheme", [a, b]).agg(F.first(metric)).dropna(subset=[a, b])
        paired = wide.groupBy("config").agg(F.avg(a).alias(f"{metric}__paired_{a}"), F.avg(b).alias(f"{metric}__paired_{b}"), F.avg(F.col(b) - F.col(a)).alias(f"{metric}__paired_delta"), F.count("*").alias(f"{metric}__n_paired_years"))
        flat = flat.join(paired, "config", "left")
    return flat


def reproduction_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of two coefficient tables."""
    x, y = a.select("test_year", "feature", F.col("coef").alias("a")), b.select("test_year", "feature", F.col("coef").alias("b"))
    return x.join(y, ["test_year", "feature"], "full").agg(F.max(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("max_abs_diff"))
