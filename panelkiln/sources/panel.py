"""Panels of daily bars: loading, validation, segments, labels; bars from order lines; sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

#: The columns every panel has.
REQUIRED = ("permno", "ticker", "date", "ret", "mcap", "turnover", "sic2", "volume", "open", "high", "low", "close", "shrout")
MAX_GAP_DAYS = 10
#: Rows of a task at an exchange, on average: a larger input has more tasks, not larger ones. Files of fewer bytes than SMALL aren't counted.
TASK_ROWS, SMALL = 128_000, 8_000_000


def input_rows(df: DataFrame) -> int:
    """Rows of the parquet files that df reads, from their footers; 0 where they are small or there are none."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    if sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) < SMALL:
        return 0
    files = [f for f in df.inputFiles() if f.endswith(".parquet")]
    return df.sparkSession.read.parquet(*files).count() if files else 0


def spread(df: DataFrame, rows: int, key: str, *, always: bool = True) -> DataFrame:
    """df by key, in as many tasks as so many rows need; where the session's number will do, that is left to it (always=False: so is the exchange)."""
    tasks = -(-rows // TASK_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(tasks, key)
    return df.repartition(key) if always else df


def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks that so many rows need; of few, as many as the session has, but not for fewer than an eighth of TASK_ROWS. The session's number where rows are not known (0)."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // TASK_ROWS), min(usual, -(-rows // max(TASK_ROWS // 8, 1)))) if rows else usual


def dealt(df: DataFrame, rows: int, bucket: str) -> DataFrame:
    """As spread(), by a bucket below task_count(): each is a task, but where rows are not known, so that Spark may join them."""
    return df.repartitionById(task_count(df.sparkSession, rows), F.col(bucket)) if rows else df.repartition(bucket)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN in double and float columns becomes NULL, once and for all."""
    kinds = dict(df.dtypes)
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))


def validate(df: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"panel lacks columns {missing}")
    return df


def year_range(df: DataFrame, start_year: int | None, end_year: int | None) -> DataFrame:
    """Both years included, as ranges of dates, which reach the parquet scan."""
    if start_year is not None:
        df = df.where(F.col("date") >= F.lit(f"{start_year:04d}-01-01").cast("date"))
    if end_year is not None:
        df = df.where(F.col("date") < F.lit(f"{end_year + 1:04d}-01-01").cast("date"))
    return df


def top_per_date(df: DataFrame, n: int, by: str = "mcap") -> DataFrame:
    """The n rows of largest `by` of each date; ties to the smaller permno."""
    w = Window.partitionBy("date").orderBy(F.col(by).desc_nulls_last(), "permno")
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def load_panel(spark: SparkSession, path: str, *, top_n: int | None = None, start_year: int | None = None, end_year: int | None = None, lookback_years: int | None = None, require_price_data: bool = True) -> DataFrame:
    """A panel from parquet: validated, dates as dates, NaN as NULL, without rows that lack mcap or close, of the years asked for.
    lookback_years counts back from the last year of the data; an explicit start_year wins."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    df = no_nan(validate(df))
    if dict(df.dtypes)["date"] != "date":
        df = df.withColumn("date", F.to_date("date"))
    if require_price_data:
        df = df.dropna(subset=["mcap", "close"])
    if lookback_years is not None and start_year is None:
        last = df.agg(F.max(F.year("date"))).first()[0]
        start_year = last - lookback_years + 1 if last is not None else None
    df = year_range(df, start_year, end_year)
    return top_per_date(df, top_n) if top_n is not None else df


def segment_id(*, max_gap_days: int = MAX_GAP_DAYS) -> Column:
    """Running number of gaps of over max_gap_days calendar days of a permno, from 0."""
    w = Window.partitionBy("permno").orderBy("date")
    gap = F.coalesce((F.datediff("date", F.lag("date").over(w)) > max_gap_days).cast("int"), F.lit(0))
    return F.sum(gap).over(w)


def forward_returns(df: DataFrame, horizons=(1, 5), *, price: str = "close") -> DataFrame:
    """fwd_ret_{h}d: price h rows on, within the segment, over the price, less 1. Needs segment_id."""
    w = Window.partitionBy("permno", "segment_id").orderBy("date")
    return df.withColumns({f"fwd_ret_{h}d": F.lead(price, h).over(w) / F.nullif(F.col(price), F.lit(0.0)) - 1 for h in horizons})


def prepare(df: DataFrame, *, max_gap_days: int = MAX_GAP_DAYS, horizons=()) -> DataFrame:
    """df with segment_id, vwap (typical price) and labels. One exchange by permno serves all of it."""
    df = df.withColumn("segment_id", segment_id(max_gap_days=max_gap_days)).withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    return forward_returns(df, horizons) if horizons else df


def first_segments(df: DataFrame, *, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """permno, year, first_segment: the segment that each name's first row of a year lies in, counted from its first row of all."""
    rows = df.select("permno", "date").withColumn("segment", segment_id(max_gap_days=max_gap_days))
    return rows.groupBy("permno", F.year("date").alias("year")).agg(F.min("segment").alias("first_segment"))


def bars_from_lines(spark: SparkSession, sf_dir: str, *, max_gap_days: int = 30) -> DataFrame:
    """A panel from order lines: a supplier is a security, its day's unit prices make the bar. Hardly two lines share a bar, so lines
    travel by permno before they are added up, and this one exchange serves bars and segments: each task holds whole securities. Of lines with
    the same order key and number the first in the file opens and closes, as in a scan from its start."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("qty"), F.col("_metadata.row_index").alias("at")
    )
    lines = spread(lines, input_rows(lines), "permno")
    bars = lines.groupBy("permno", "date").agg(F.min_by("px", F.struct("seq", "at", "px")).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", F.struct("seq", -F.col("at"), -F.col("px"))).alias("close"), F.sum("qty").alias("volume"))
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("permno"), F.col("s_nationkey").alias("sic2"), (F.abs("s_acctbal") + 1).alias("shrout"))
    df = bars.join(names, "permno").withColumn("segment_id", segment_id(max_gap_days=max_gap_days))
    w = Window.partitionBy("permno", "segment_id").orderBy("date")
    return df.select(
        "permno", F.concat(F.lit("S"), F.col("permno").cast("string")).alias("ticker"), "date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret"), (F.col("close") * F.col("shrout")).alias("mcap"),
        (F.col("volume") / F.col("shrout")).alias("turnover"), "sic2", "volume", "open", "high", "low", "close", "shrout", "segment_id", ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("vwap"),
    )


def most_rows(spark: SparkSession, sf_dir: str) -> int | None:
    """What no security and no date of bars_from_lines() exceeds: the days from the first line to the last, and the suppliers. None (unknown) where
    a line has no date."""
    day = F.to_date("l_shipdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg((F.datediff(F.max(day), F.min(day)) + 1).alias("days"), F.max(day.isNull()).alias("unknown")).first()
    return None if lines.unknown else max(lines.days or 0, spark.read.parquet(f"{sf_dir}/supplier.parquet").count())


#: The same for DuckDB: a WITH clause that defines `panel`.
BARS_SQL = """
WITH line AS (
  SELECT l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_orderkey * 8 + l_linenumber AS seq, l_quantity AS qty FROM lineitem
), bar AS (
  SELECT permno, date, arg_min(px, seq) AS open, max(px) AS high, min(px) AS low, arg_max(px, seq) AS close, sum(qty) AS volume FROM line GROUP BY permno, date
), named AS (
  SELECT bar.*, s_nationkey AS sic2, abs(s_acctbal) + 1 AS shrout FROM bar JOIN supplier ON permno = s_suppkey
), gap AS (
  SELECT *, CASE WHEN date_diff('day', lag(date) OVER (PARTITION BY permno ORDER BY date), date) > 30 THEN 1 ELSE 0 END AS g FROM named
), seg AS (
  SELECT * EXCLUDE (g), CAST(sum(g) OVER (PARTITION BY permno ORDER BY date) AS BIGINT) AS segment_id FROM gap
), panel AS (
  SELECT permno, 'S' || CAST(permno AS VARCHAR) AS ticker, date, close / lag(close) OVER (PARTITION BY permno, segment_id ORDER BY date) - 1 AS ret, close * shrout AS mcap, volume / shrout AS turnover,
    sic2, volume, open, high, low, close, shrout, segment_id, (high + low + close) / 3 AS vwap FROM seg
)"""


def write_by_year(df: DataFrame, path: str, *, single: bool = False) -> None:
    """Parquet by year of date; a rerun replaces only the years it holds. single: doubles as floats."""
    if single:
        df = df.select(*(F.col(c).cast("float").alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))
    df.withColumn("year", F.year("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def write_runs(df: DataFrame, path: str) -> None:
    """Predictions, coefficients or parameters with columns config and horizon, as a partitioned table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config", "horizon").parquet(path)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Persisted predictions named {config}__{h}d__preds.parquet under a glob, with config and horizon from the name."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)__(\d+)d__preds\.parquet", 0)
    df = spark.read.parquet(pattern)
    part = lambda i: F.regexp_extract(name, r"([^/]+)__(\d+)d__preds\.parquet", i)
    return df.select("*", part(1).alias("config"), part(2).cast("int").alias("horizon"))


def saved_runs(df: DataFrame, configs: list[str], schemes: list[str]) -> DataFrame:
    """Persisted predictions or coefficients (config, scheme, test_year, ...) of exactly these runs: every one must be there, and all must
    hold the same test years. Further runs are left out."""
    years = df.groupBy("config", "scheme").agg(F.sort_array(F.collect_set("test_year")).alias("years")).collect()  # a row for each run
    have = {(r["config"], r["scheme"]): tuple(r["years"]) for r in years}
    wanted = [(c, s) for c in configs for s in schemes]
    missing = [w for w in wanted if w not in have]
    if missing:
        raise FileNotFoundError(f"no saved runs {missing}")
    if len({have[w] for w in wanted}) > 1:
        raise ValueError(f"saved runs disagree on their test years: { {w: have[w] for w in wanted} }")
    return df.where(F.col("config").isin(configs) & F.col("scheme").isin(schemes))


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Some columns of a report table."""
    return spark.read.csv(path, header=True, schema=schema).select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    """A small report table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
