"""Data-quality audit of a panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..sources.scratch import settled


def counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("permno").alias("n_permno"), F.countDistinct("date").alias("n_dates"), F.min("date").cast("string").alias("date_min"), F.max("date").cast("string").alias("date_max"))


def names_per_day(df: DataFrame) -> DataFrame:
    by = df.groupBy("date").agg(F.countDistinct("permno").alias("n"))
    return by.agg(F.min("n").alias("names_min"), F.percentile("n", F.lit(0.5)).alias("names_median"), F.max("n").alias("names_max"))


def missing_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """feature, share: of nulls; all columns in one aggregate."""
    columns = columns or df.columns
    return df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).unpivot([], columns, "feature", "share")


def duplicate_keys(df: DataFrame) -> DataFrame:
    by = df.groupBy("permno", "date").agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup_permno_date"))


def ohlc_sanity(df: DataFrame) -> DataFrame:
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return df.agg(
        share(whole & (F.col("high") < F.greatest("open", "close"))).alias("high_lt_body"), share(whole & (F.col("low") > F.least("open", "close"))).alias("low_gt_body"), share(F.col("close") <= 0).alias("nonpos_close"), share(F.col("volume") < 0).alias("neg_volume")
    )


def _gap() -> Column:
    return F.datediff("date", F.lag("date").over(Window.partitionBy("permno").orderBy("date")))


def gap_histogram(df: DataFrame, *, clip: int = 60, head: int = 15) -> DataFrame:
    """gap_days, n: the first bars of the clipped histogram (a report of `head` rows)."""
    return df.select(F.least(_gap(), F.lit(clip)).alias("gap_days")).where("gap_days is not null").groupBy("gap_days").agg(F.count("*").alias("n")).orderBy("gap_days").limit(head)


def segment_counts(df: DataFrame, *, max_gap_days: int) -> DataFrame:
    by = df.groupBy("permno").agg((F.max("segment_id") + 1).alias("n"))
    long = df.select(_gap().alias("g")).agg(F.coalesce(F.sum((F.col("g") > max_gap_days).cast("long")), F.lit(0)).alias("n_long_gaps"))
    return by.agg(F.sum("n").alias("n_segments")).join(long)  # one row each


def reentries(df: DataFrame) -> DataFrame:
    """permno, n_segments: the names that came back after a gap. Rows without a segment count for none."""
    return df.groupBy("permno").agg(F.countDistinct("segment_id").alias("n_segments")).where("n_segments > 1")


def differences(df: DataFrame, parts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """check, n, median_abs, p99_abs, share_lt_1e8, share_lt_1e4 of |a - b| of each check. All are columns of one frame that is settled, their
    quantiles asked for together."""
    rows = settled(df.select(*(F.abs(a - b).alias(name) for name, (a, b) in parts.items())))
    cuts = quantiles(rows, list(parts), (0.5, 0.99))
    d = F.col("d")
    long = rows.unpivot([], list(parts), "check", "d").where("d is not null")
    seen = long.groupBy("check").agg(F.count("*").alias("n"), F.avg((d < 1e-8).cast("double")).alias("share_lt_1e8"), F.avg((d < 1e-4).cast("double")).alias("share_lt_1e4"))
    told = df.sparkSession.createDataFrame([(name, *cuts[name]) for name in parts], "check string, median_abs double, p99_abs double")
    out = told.join(seen, "check", "left")
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), "median_abs", "p99_abs", "share_lt_1e8", "share_lt_1e4", "check")


def return_identity(df: DataFrame) -> DataFrame:
    """check and difference statistics: returns against price ratios, labels against the next return and price ratio."""
    w = Window.partitionBy("permno").orderBy("date")
    seg = F.col("segment_id")
    rows = df.withColumns({
        "_back": F.when(F.lag("segment_id").over(w) == seg, F.col("close") / F.lag("close").over(w) - 1),
        "_next": F.when(F.lead("segment_id").over(w) == seg, F.lead("ret").over(w)),
        "_px1": F.when(F.lead("segment_id").over(w) == seg, F.lead("close").over(w) / F.col("close") - 1),
        "_px5": F.when(F.lead("segment_id", 5).over(w) == seg, F.lead("close", 5).over(w) / F.col("close") - 1),
    })
    parts = [("ret_vs_price", "ret", "_back"), ("fwd1_vs_next_ret", "fwd_ret_1d", "_next"), ("fwd1_vs_price", "fwd_ret_1d", "_px1"), ("fwd5_vs_price", "fwd_ret_5d", "_px5")]
    return differences(rows, {name: (F.col(a), F.col(b)) for name, a, b in parts})


def degeneracy(signal: DataFrame, name: str, value: float = -1.0) -> DataFrame:
    """Of one signal: share equal to a value, distinct values in all and by year, share of dates with a constant cross-section."""
    x = F.col(name)
    whole = signal.agg(F.avg(F.coalesce(x == value, F.lit(False)).cast("double")).alias("share_eq"), F.countDistinct(x).alias("n_distinct"))
    days = signal.groupBy("date").agg(F.countDistinct(x).alias("n")).agg(F.avg((F.col("n") == 1).cast("double")).alias("share_dates_constant"))
    years = signal.groupBy(F.year("date").alias("y")).agg(F.countDistinct(x).alias("n")).agg(F.min("n").alias("by_year_min"), F.percentile("n", F.lit(0.5)).alias("by_year_median"))
    return whole.join(days).join(years)  # one row each
