"""Which executor a phase gets: window functions or array kernels.

Costs are core-microseconds a row, measured at sf0.1 (0.53 million rows, 8 cores). What both have alike, the exchange and the sort, is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expr import CROSS, TIME, Node

#: Rows of a security or a date that a worker holds at once; with more, windows run, as they spill.
GROUP_ROWS = 2_000_000
#: What counting the rows of the groups costs, a row: of a stored panel, of one that is derived.
STORED, DERIVED = 6.0, 40.0
NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean", "date")
#: Window functions: a lag; a sliding call, for each row of its window (sums and extremes, moments, gathered lists); a sort by another column.
LAG, CALL, SLIDE, MOMENT, LIST, SORT = 0.5, 0.5, 0.026, 0.1, 0.4, 8.0
#: Kernels: the trip of a row, of a column of it; an operator, for each row of its window; ordering a date.
TRIP, COLUMN, KERNEL, CELL, ORDER = 4.0, 0.3, 0.4, 0.01, 1.0
UNROLL = 12


def by_windows(node: Node) -> float:
    op, n = node.op, node.param
    if op in ("delay", "delta"):
        return LAG
    if op == "decay_linear":
        return n * LAG + 2 * (CALL + n * SLIDE)
    if op in TIME:
        each = CALL + n * SLIDE
        if op in ("ts_cov", "ts_corr"):
            return 3 * each + (3 if op == "ts_corr" else 1) * (CALL + n * MOMENT)
        if op == "ts_stddev":
            return 2 * each + CALL + n * MOMENT
        if op in ("ts_rank", "ts_argmax", "ts_argmin", "ts_product"):
            return each + (n * LAG if n <= UNROLL else n * LIST)
        return 2 * each if op in ("ts_min", "ts_max") else 3 * each
    if op == "rank":
        return SORT + 3 * CALL
    return 2 * CALL + (SORT if op in ("indneutralize", "xs_quantile") else 0) if op in CROSS else 0.0


def by_kernels(node: Node) -> float:
    op, n = node.op, node.param
    if op in TIME:
        return KERNEL + n * CELL * (3 if op == "ts_corr" else 2 if op in ("ts_cov", "ts_stddev") else 1)
    return ORDER + KERNEL if op in ("rank", "xs_quantile", "indneutralize") else KERNEL


def estimates(plan, carried: dict[int, int]) -> dict[int, tuple[float, float]]:
    """Phase -> costs by windows and by kernels. Phase 0 has neither: its scalars need no order."""
    out = {}
    for p in sorted({p for p, _ in plan.steps} - {0}):
        nodes = [n for k, step in plan.steps.items() if k[0] == p for n in step]
        out[p] = (sum(map(by_windows, nodes)), TRIP + COLUMN * carried[p] + sum(map(by_kernels, nodes)))
    return out


def counting(panel: DataFrame) -> float:
    """What counting the groups costs: stored keys are read, a derived panel is derived once more."""
    shape = panel._jdf.queryExecution().optimizedPlan().toString()
    return DERIVED if any(w in shape for w in ("Join", "Aggregate", "Window")) else STORED


def fitting(panel: DataFrame, group_rows: int) -> dict[int, bool]:
    """Parity of a phase -> whether each of its groups can be gathered in a worker, by one pass over the keys. Null keys, which are one group for
    windows only, rule both out."""
    keys = [c for c in ("permno", "date") if c in panel.columns]
    null = F.max(sum(F.col(c).isNull().cast("int") for c in (*keys, *({"segment_id"} & set(panel.columns)))))
    seen = panel.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.xxhash64(c).alias("value")) for c in keys))).alias("key"), *{*keys, *({"segment_id"} & set(panel.columns))})
    groups = seen.groupBy("key").agg(F.count("*").alias("n"), null.alias("unknown")).groupBy("key.name").agg(F.max("n").alias("n"), F.max("unknown").alias("unknown")).collect()  # two rows at most
    known = not any(r["unknown"] for r in groups)
    most = {r["name"]: r["n"] for r in groups}
    return {odd: known and most.get(name, 0) <= group_rows for odd, name in ((1, "permno"), (0, "date"))}


def choose(panel: DataFrame, plan, carried: dict[int, int], at_most: int | None = None, gain: float = 0.0) -> set[int]:
    """Phases to run as kernels. at_most: rows of a security or date at most, where the caller knows; else they are counted, but only where the
    phases would save more than that costs. gain: what the phases must save at least, a row. An empty panel fits; null keys, or fields that are no numbers, flags or dates, leave all to windows."""
    found = {p: w - k for p, (w, k) in estimates(plan, carried).items() if k < w}
    read = plan.fields()
    if not found or sum(found.values()) < gain or any(c in read and not k.startswith(NUMBERS) for c, k in panel.dtypes):
        return set()
    if at_most is not None:
        return set(found) if at_most <= GROUP_ROWS else set()
    if sum(found.values()) <= counting(panel):
        return set()
    within = fitting(panel, GROUP_ROWS)
    return {p for p in found if within[p % 2]}
