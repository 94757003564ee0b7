"""Registered queries over the bars made of order lines, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import library
from .plans.compile import evaluate, saving, to_sql
from .plans.expr import Node, adv, field, indneutralize, make, num, one, parse, rank, scale, where, winsorize, zscore
from .sources.panel import BARS_SQL, bars_from_lines, forward_returns, most_rows, top_per_date

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("permno", "segment_id", "date")


def signals() -> dict[str, dict[str, Node]]:
    """Query name -> its columns, for all that is an expression."""
    close, volume, ret, high = field("close"), field("volume"), field("ret"), field("high")
    p = parse
    out: dict[str, dict[str, Node]] = {
        "ts_delay": {"x": p("delay(close, 3)")},
        "ts_delta": {"x": p("delta(close, 4)")},
        "ts_sum": {"x": p("sum(volume, 5)")},
        "ts_mean": {"x": p("ts_mean(close, 8)")},
        "ts_min": {"x": p("ts_min(low, 12)")},
        "ts_max": {"x": p("ts_max(high, 12)")},
        "ts_stddev": {"x": p("stddev(returns, 20)")},
        "ts_product": {"x": p("product(1 + returns, 6)")},
        "ts_rank": {"x": p("ts_rank(volume, 10)")},
        "ts_argmax": {"x": p("ts_argmax(volume, 10)")},
        "ts_argmin": {"x": p("ts_argmin(volume, 10)")},
        "ts_decay_linear": {"x": p("decay_linear(close, 7)")},
        "ts_cov": {"x": p("covariance(close, volume, 9)")},
        "ts_corr": {"x": p("correlation(close, volume, 10)")},
        "xs_rank": {"x": rank(volume)},
        "xs_scale": {"x": scale(close, 2.0)},
        "xs_zscore": {"x": zscore(close)},
        "xs_winsorize": {"x": winsorize(ret)},
        "xs_indneutralize": {"x": indneutralize(close)},
        "xs_rank_normalize": {"x": library.centred(ret), "y": library.centred(volume)},
        "signedpower": {"x": p("signedpower(returns, 0.5)"), "y": p("signedpower(returns, delta(close, 1) / close)")},
        "where_ternary": {"x": where(ret < 0, num(-1), where(close < high, num(0), num(1))), "y": p("delay(close, 3) < close ? 1 : 2")},
        "safe_div": {"x": p("(close - low) / (high - low)"), "y": p("(low - close) / (high - low)")},
        "safe_log": {"x": p("log(high - low)"), "y": p("log(returns)")},
        "safe_pow": {"x": p("1 ^ returns"), "y": p("rank(close) ^ delay(close, 2)")},
        "adv_20": {"x": adv(20)},
        "baseline_features": library.baseline_features(),
    }
    out["max_min"] = {"x": make("max", close, parse("delay(close, 1)")), "y": make("min", close, parse("delay(close, 1)"))}
    for name, node in library.classic_features().items():
        out[name] = {name: node}
    for name, node in library.alpha_features().items():
        out[name] = {name: node}
    # powers up to 1e284, whose decimals no two engines share: compared as sign(x) * log(1 + |x|)
    x = out.pop("alpha_084")["alpha_084"]
    out["alpha_084"] = {"alpha_084_log": one("sign", x) * one("log", 1 + one("abs", x))}
    return out


#: Queries whose values are large; their eighth decimal is noise.
COARSE = {"ts_cov": 4, "adv_20": 4}
#: Core-microseconds a row that kernels must save before a single signal leaves its windows.
GAIN = 40.0


def _signal(columns: dict[str, Node], digits: int = 8) -> Query:
    """By windows, or where kernels save much (long windows, many ranks) by choice."""
    return lambda spark, sf_dir: _by_choice(spark, sf_dir, columns, digits, GAIN)


def _by_choice(spark, sf_dir: str, columns: dict[str, Node], digits: int, gain: float = 0.0) -> DataFrame:
    at_most = most_rows(spark, sf_dir) if saving(columns) >= max(gain, 1.0) else None
    return evaluate(bars_from_lines(spark, sf_dir), columns, digits=digits, kernels=None if at_most is not None else False, at_most=at_most, gain=gain, laid=True)


def alpha_library() -> dict[str, Node]:
    return {c: n for name, columns in signals().items() if name.startswith("alpha_") for c, n in columns.items()}


def all_alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 90 signals at once, by array kernels."""
    return evaluate(bars_from_lines(spark, sf_dir), alpha_library(), digits=7, kernels=True, laid=True)


def chosen(columns: Callable[[], dict[str, Node]]) -> Query:
    """A batch of signals whose phases go to the executor that the estimates prefer."""
    return lambda spark, sf_dir: _by_choice(spark, sf_dir, columns(), 7)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alpha_003: both partitionings, ranks within trailing correlations."""
    return _signal({"alpha_003": parse(library.ALPHAS[3])})(spark, sf_dir)


def _rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(((F.rint(F.col(c) * 10.0**digits) / 10.0**digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def daily_bars(spark, sf_dir):
    return _rounded(bars_from_lines(spark, sf_dir).select("permno", "date", "open", "high", "low", "close", "volume", "sic2"))


def segments(spark, sf_dir):
    return bars_from_lines(spark, sf_dir).select("permno", "date", F.col("segment_id").cast("long").alias("segment_id"))


def labels(spark, sf_dir):
    return _rounded(forward_returns(bars_from_lines(spark, sf_dir)).select("permno", "date", "fwd_ret_1d", "fwd_ret_5d"))


def prepared(spark, sf_dir):
    return _rounded(bars_from_lines(spark, sf_dir).select("permno", F.col("segment_id").cast("long").alias("segment_id"), "date", "ret", "mcap", "turnover", "vwap"))


def top_n(spark, sf_dir):
    return _rounded(top_per_date(bars_from_lines(spark, sf_dir), 5).select("permno", "date", "mcap"))


R = "(round_even({0} * 1E8, 0) / 1E8 + 0E0) AS {0}"


def _r(*cols: str) -> str:
    return ", ".join(R.format(c) for c in cols)


PANEL = {
    "daily_bars": (daily_bars, f"{BARS_SQL} SELECT permno, date, {_r('open', 'high', 'low', 'close', 'volume')}, sic2 FROM panel"),
    "segment_id": (segments, f"{BARS_SQL} SELECT permno, date, segment_id FROM panel"),
    "forward_returns": (labels, f"{BARS_SQL}, f AS (SELECT permno, date, lead(close, 1) OVER w / close - 1 AS fwd_ret_1d, lead(close, 5) OVER w / close - 1 AS fwd_ret_5d FROM panel WINDOW w AS (PARTITION BY permno, segment_id ORDER BY date)) SELECT permno, date, {_r('fwd_ret_1d', 'fwd_ret_5d')} FROM f"),
    "prepare_panel": (prepared, f"{BARS_SQL} SELECT permno, segment_id, date, {_r('ret', 'mcap', 'turnover', 'vwap')} FROM panel"),
    "top_n_per_date": (top_n, f"{BARS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mcap DESC NULLS LAST, permno) AS r FROM panel) SELECT permno, date, {_r('mcap')} FROM t WHERE r <= 5"),
}


BATCHES = {"classic_library": library.classic_features, "first_alphas": lambda: library.alpha_features(list(library.ALPHAS)[:15])}


def queries() -> dict[str, Query]:
    from .operators.queries import QUERIES

    return {k: f for k, (f, _) in PANEL.items()} | {"alpha_library": all_alphas} | {k: chosen(f) for k, f in BATCHES.items()} | {k: _signal(v, COARSE.get(k, 8)) for k, v in signals().items()} | {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .operators.queries import QUERIES

    out = {k: s for k, (_, s) in PANEL.items()}
    out["alpha_library"] = to_sql(BARS_SQL, alpha_library(), digits=7)
    out |= {k: to_sql(BARS_SQL, f(), digits=7) for k, f in BATCHES.items()}
    out |= {k: to_sql(BARS_SQL, v, digits=COARSE.get(k, 8)) for k, v in signals().items()}
    return out | {k: s for k, (_, s) in QUERIES.items() if s}
