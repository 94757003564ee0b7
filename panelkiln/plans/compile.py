"""From expressions to a staged plan.

Operators along time need rows by (permno, segment_id), operators across names rows by date: every switch between the two moves the data.
So all expressions of a query are levelled together: phase 0 is scalar, odd phases hold all time operators, even ones all cross-section
operators. Data that lie by permno satisfy (permno, segment_id), so a query has one exchange for each phase, however many signals it has.
Within a phase, steps of projections add what depends on the step before. One emitter writes the steps for Spark and, as a chain of
common table expressions, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import semantics as S
from ..sources.panel import dealt, input_rows, spread, task_count
from .costs import choose, estimates
from .expr import BOOLEAN, CROSS, TIME, Node

TIME_KEYS = "PARTITION BY permno, segment_id ORDER BY date"
#: Operators that name an operand more than once; their operands become columns first.
REPEATING = {"div", "pow", "log", "signedpower", "max", "min", "nn", "finite"} | TIME | CROSS


class Plan:
    def __init__(self, outputs: dict[str, Node], late: bool = False):
        """late: operators in the last phase that will do instead of the first, and whole outputs as columns, so that fields travel and not what
        could be made of them later."""
        self.outputs = outputs
        self.named: set[int] = set()
        self.place: dict[int, tuple[int, int]] = {}
        self.column: dict[int, str] = {}
        self.steps: dict[tuple[int, int], list[Node]] = {}
        self._seen: set[int] = set()
        for node in outputs.values():
            self._need(node)
        for node in outputs.values():
            self._place(node)
        if late:
            self._delay()

    def _delay(self) -> None:
        """Places all nodes anew: an operator in the last phase of its kind before those that read it, a scalar where its last operand is made."""
        end = max((p for p, _ in self.place.values()), default=0)
        below: list[Node] = []  # operands first
        seen: set[int] = set()

        def walk(n: Node) -> None:
            if id(n) not in seen:
                seen.add(id(n))
                for a in n.args:
                    walk(a)
                below.append(n)

        for n in self.outputs.values():
            walk(n)
            if n.op not in ("field", "num"):
                self.named.add(id(n))
        until: dict[int, int] = dict.fromkeys(seen, end)
        for n in reversed(below):
            if n.op in TIME | CROSS:
                until[id(n)] -= (until[id(n)] + (n.op in TIME)) % 2
            for a in n.args:
                until[id(a)] = min(until[id(a)], until[id(n)])
        self.place, self.column, self.steps = {}, {}, {}
        for n in below:
            own = [self.place[id(a)] for a in n.args]
            phase = max((p for p, _ in own), default=0)
            if n.op in TIME | CROSS or (not phase and id(n) in self.named):
                phase = until[id(n)]
            self._settle(n, phase, max((s for p, s in own if p == phase), default=0))

    def _need(self, node: Node) -> None:
        """Which nodes become columns: operators over time or names, and operands that are named twice."""
        if id(node) in self._seen:
            return
        self._seen.add(id(node))
        if node.op in TIME | CROSS:
            self.named.add(id(node))
        for a in node.args:
            if node.op in REPEATING and a.op not in ("field", "num"):
                self.named.add(id(a))
            self._need(a)

    def _place(self, node: Node) -> tuple[int, int]:
        """(phase, step) from which the node's value is at hand."""
        if id(node) in self.place:
            return self.place[id(node)]
        below = [self._place(a) for a in node.args]
        phase = max((p for p, _ in below), default=0)
        if node.op in TIME and phase % 2 == 0:
            phase += 1
        elif node.op in CROSS and (phase % 2 or not phase):
            phase += 1 if phase else 2
        return self._settle(node, phase, max((s for p, s in below if p == phase), default=0))

    def _settle(self, node: Node, phase: int, step: int) -> tuple[int, int]:
        if id(node) in self.named:
            step += 1
            self.column[id(node)] = f"n{len(self.column)}"
            self.steps.setdefault((phase, step), []).append(node)
        self.place[id(node)] = (phase, step)
        return phase, step

    def name(self, node: Node, d: str) -> str:
        if id(node) in self.column:
            return self.column[id(node)]
        return self.text(node, d)

    def text(self, node: Node, d: str, over=str) -> str:
        """The node's SQL, its operands by name. over: what to write for a window function, its SQL by default."""
        op, a, p = node.op, [self.name(x, d) for x in node.args], node.param
        if op == "field":
            return str(p)
        if op == "num":
            return S.number(p) if p >= 0 else f"({S.number(p)})"
        if op in ("add", "sub", "mul"):
            return f"({a[0]} {dict(add='+', sub='-', mul='*')[op]} {a[1]})"
        if op == "div":
            return f"({a[0]} / {a[1]})" if node.args[1].op == "num" else S.sdiv(d, *a)
        if op == "pow":
            return S.spow(d, *a)
        if op == "signedpower":
            return S.signedpower(d, *a)
        if op in ("lt", "gt", "eq"):
            return S.compare(d, dict(lt="<", gt=">", eq="=")[op], *a)
        if op == "or":
            return f"({a[0]} OR {a[1]})"
        if op == "where":
            return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
        if op in ("max", "min"):
            return S.extreme(d, "greatest" if op == "max" else "least", *a)
        if op == "abs":
            return f"abs({a[0]})"
        if op == "sqrt":
            return f"sqrt({a[0]})"
        if op == "sign":
            return S.sign(d, a[0])
        return {"log": S.slog, "nn": S.number_or_null, "finite": S.finite_or_null, "nonzero": S.nonzero, "float": S.indicator}[op](d, a[0]) if op not in TIME | CROSS else (over_time if op in TIME else over_names)(d, op, a, p, over)

    def fields(self) -> set[str]:
        """Columns of the panel that expressions read."""
        seen: set[int] = set()
        found: set[str] = {"permno", "segment_id", "date"}
        todo = list(self.outputs.values())
        while todo:
            n = todo.pop()
            if id(n) in seen:
                continue
            seen.add(id(n))
            todo += n.args
            if n.op in ("field", "indneutralize"):
                found.add(n.param)
        return found

    def ordered(self):
        return [self.steps[k] for k in sorted(self.steps)]

    def result(self, name: str, node: Node, d: str, digits: int | None) -> str:
        x = self.name(node, d)
        return f"{S.decimals(d, x, digits) if digits is not None else x} AS {name}"


#: Windows up to which order statistics and products are written out as comparisons of lags; longer ones gather a list for each row.
UNROLL = 12


def over_time(d: str, op: str, a: list[str], n: int, over=str) -> str:
    """Sums and what is made of them are snapped by the greatest magnitude in the window."""
    x = a[0]
    w = f"OVER ({TIME_KEYS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    lag = lambda k: x if not k else over(f"lag({x}, {k}) OVER ({TIME_KEYS})")
    call = lambda f: over(f"{f} {w}")
    size = lambda v: call(f"max(abs({v}))")
    if op == "delay":
        return lag(n)
    if op == "delta":
        return f"({x} - {lag(n)})"
    full = f"{call(f'count({x})')} = {n}"
    if op == "decay_linear":
        whole = " + ".join(f"{S.number(n - k)} * {lag(k)}" for k in range(n))
        return S.snapped(d, f"(({whole}) / {S.number(n * (n + 1) / 2)})", size(x))
    items = f"{'collect_list' if d == 'spark' else 'list'}({x}) {w}"
    unrolled = d == "spark" and n <= UNROLL
    if op in ("ts_sum", "ts_mean", "ts_min", "ts_max"):
        value = call(f"{dict(ts_sum='sum', ts_mean='avg', ts_min='min', ts_max='max')[op]}({x})")
        value = S.snapped(d, value, size(x)) if op in ("ts_sum", "ts_mean") else value
    elif op == "ts_stddev":
        value = S.snapped(d, call(f"stddev_samp({x})"), size(x))
    elif op == "ts_product":
        value = "(" + " * ".join(lag(k) for k in range(n - 1, -1, -1)) + ")" if unrolled else f"aggregate({over(items)}, {S.number(1)}, (p, v) -> p * v)" if d == "spark" else f"product({x}) {w}"
        value = S.snapped(d, value, f"abs({value})")
    elif op == "ts_rank":
        below = "(1 + " + " + ".join(["0", *(f"CASE WHEN {lag(k)} <= {x} THEN 1 ELSE 0 END" for k in range(1, n))]) + ")"
        below = below if unrolled else f"size(filter({over(items)}, v -> v <= {x}))" if d == "spark" else f"len(list_filter({items}, lambda v: v <= {x}))"
        value = f"({below} / {S.number(n)})"
    elif op in ("ts_argmax", "ts_argmin"):
        best = op[-3:]
        if unrolled:  # the oldest of equals
            most = call(f"{best}({x})")
            value = "CAST(CASE " + " ".join(f"WHEN {lag(k)} = {most} THEN {k}" for k in range(n - 1, 0, -1)) + " ELSE 0 END AS DOUBLE)" if n > 1 else S.number(0)
        else:
            place = f"array_position({over(items)}, array_{best}({over(items)}))" if d == "spark" else f"list_position({items}, list_{best}({items}))"
            value = f"CAST({n} - {place} AS DOUBLE)"
    else:
        y = a[1]
        full = call(f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END)") + f" = {n}"
        cov = call(f"covar_samp({x}, {y})")
        if op == "ts_cov":
            value = S.snapped(d, cov, f"({size(x)} * {size(y)})")
        else:
            sx, sy = call(f"stddev_samp({x})"), call(f"stddev_samp({y})")
            full += f" AND {sx} > 1E-12 * {size(x)} AND {sy} > 1E-12 * {size(y)}"
            value = S.decimals(d, f"({cov} / ({sx} * {sy}))", 8)
    return f"(CASE WHEN {full} THEN {value} END)"


def over_names(d: str, op: str, a: list[str], p, over=str) -> str:
    x, w = a[0], "OVER (PARTITION BY date)"
    call = lambda f, own=w: over(f"{f} {own}")
    size = call(f"max(abs({x}))")
    if op == "rank":  # average rank of ties over the count of values; one partitioning by date
        o = f"PARTITION BY date ORDER BY {x} ASC NULLS LAST"
        upto = call(f"count({x})", f"OVER ({o} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
        return f"(CASE WHEN {x} IS NOT NULL THEN ({call('rank()', f'OVER ({o})')} + {upto}) / 2E0 / {call(f'count({x})')} END)"
    if op == "scale":
        whole = call(f"sum(abs({x}))")
        part = f"{x} / ({whole})"
        return f"(CASE WHEN {whole} > 0 THEN {S.snapped(d, part, f'abs({part})')} * {S.number(p)} END)"
    if op == "xs_mean":
        return S.snapped(d, call(f"avg({x})"), size)
    if op == "xs_std":
        return S.snapped(d, call(f"stddev_samp({x})"), size)
    if op == "xs_quantile":
        return call(f"{'percentile' if d == 'spark' else 'quantile_cont'}({x}, {p})")
    own = f"OVER (PARTITION BY date, {p})"
    mean = call(f"avg({x})", own)
    return f"(CASE WHEN {p} IS NOT NULL THEN {S.snapped(d, f'({x} - {mean})', call(f'max(abs({x}))', own))} END)"


def step_of(frame: DataFrame, plan: Plan, nodes: list[Node]) -> DataFrame:
    """frame with the nodes' columns. Each window function of the step is computed once, however often and by however many nodes it is named:
    Catalyst would evaluate each mention."""
    calls: dict[str, str] = {}
    columns = frame.columns
    name = plan.column[id(nodes[0])]  # names of the step's window functions are built on that of its first node
    texts = [f"{plan.text(n, 'spark', lambda t: calls.setdefault(t, f'{name}_w{len(calls)}'))} AS {plan.column[id(n)]}" for n in nodes]
    if calls:
        frame = frame.selectExpr("*", *(f"{t} AS {c}" for t, c in calls.items()))
    return frame.selectExpr(*columns, *texts)


def evaluate(panel: DataFrame, signals: dict[str, Node], *, keep: tuple[str, ...] = ("permno", "segment_id", "date"), digits: int | None = None, settle=None, kernels: bool | None = None, at_most: int | None = None, gain: float = 0.0, laid: bool = False) -> DataFrame:
    """keep and one double column for each signal. settle: what to do with the frame between phases (say, write and reread).
    kernels: the phases as array kernels on Arrow batches (True) or as window functions (False); by default what costs.choose() finds cheaper for
    each phase, and windows, which spill, wherever a group has more rows than a worker should hold. at_most: rows of a security or a date at most, where
    known; else they may be counted first. gain: core-microseconds a row that kernels must save. laid: each task of the panel holds whole securities, and
    a security has one row for a date. Kernels then leave with the securities what only these need (_two_sides).

    Operators run as late as they can, so that what travels between phases is fields and what can't be made of them later. The tasks of a phase
    grow in number with the panel's input, not in size."""
    plan = Plan(signals, late=True)
    phases = sorted({p for p, _ in plan.steps})
    last_use = _last_use(plan, keep)
    if kernels is None:
        by_kernels = choose(panel, plan, carried_of(plan, last_use, panel.columns), at_most, gain)
    else:
        by_kernels = {p for p in phases if p and kernels}
    flags = {plan.column[id(n)] for nodes in plan.steps.values() for n in nodes if n.op in BOOLEAN}
    if laid and not settle and _storable(panel, last_use) and phases[-1:] and phases[-1] % 2 and {p for p in phases if p} == by_kernels >= set(range(2, phases[-1], 2)):
        frame = _two_sides(panel, plan, keep, flags, input_rows(panel), digits)
        return frame.selectExpr(*keep, *(plan.result(name, node, "spark", digits) for name, node in signals.items()))
    frame = panel.select(*(c for c in panel.columns if c in last_use))
    rows = input_rows(panel) if phases and phases[-1] else 0
    if phases == [2] and by_kernels == {2} and _storable(frame, last_use):
        frame = _by_dates(frame, plan, last_use, flags, rows)
        return frame.selectExpr(*keep, *(plan.result(name, node, "spark", digits) for name, node in signals.items()))
    for i, p in enumerate(phases):
        steps = [plan.steps[k] for k in sorted(plan.steps) if k[0] == p]
        if settle and i and phases[i - 1]:
            frame = settle(frame)
        if p in by_kernels:
            frame = _kernel_phase(frame, plan, p, steps, last_use, flags, rows, laid and p == 1)
            continue
        if p:
            frame = frame.select(*(c for c in frame.columns if last_use.get(c, 0) >= p))
            frame = frame if laid and p == 1 else spread(frame, rows, "permno" if p % 2 else "date", always=False)
        for nodes in steps:
            frame = step_of(frame, plan, nodes)
    return frame.selectExpr(*keep, *(plan.result(name, node, "spark", digits) for name, node in signals.items()))


def _storable(panel: DataFrame, fields) -> bool:
    """Securities are whole numbers, dates are dates, and fields of types that blocks can carry."""
    from .kernels import STORED

    kinds = dict(panel.dtypes)
    return "int" in kinds.get("permno", "") and kinds.get("date") == "date" and all(kinds[c] in STORED for c in fields if c in kinds)


def _last_use(plan: Plan, keep) -> dict[str, int]:
    """The last phase that reads a column or field; 99 for what the result reads."""
    last: dict[str, int] = {}

    def own(x: Node) -> str | None:
        return plan.column.get(id(x), x.param if x.op == "field" else None)

    def uses(node: Node, phase: int) -> None:
        for x in node.args:
            name = own(x)
            if name is not None:
                last[name] = max(last.get(name, 0), phase)
            if id(x) not in plan.column:
                uses(x, phase)
        if node.op == "indneutralize":
            last[node.param] = max(last.get(node.param, 0), phase)

    for (p, _), nodes in plan.steps.items():
        for n in nodes:
            uses(n, p)
    for n in plan.outputs.values():
        name = own(n)
        if name is not None:
            last[name] = END
        if id(n) not in plan.column:
            uses(n, END)
    return last | dict.fromkeys(("permno", "segment_id", "date", *keep), END)


END = 99


def carried_of(plan: Plan, last_use: dict[str, int], columns) -> dict[int, int]:
    """Phase -> columns that leave it."""
    out, have = {}, list(columns)
    for p in sorted({p for p, _ in plan.steps}):
        have = [c for c in [*have, *(plan.column[id(n)] for k in sorted(plan.steps) if k[0] == p for n in plan.steps[k])] if last_use.get(c, 0) > p]
        out[p] = len(have)
    return out


def saving(signals: dict[str, Node], keep: tuple[str, ...] = ("permno", "segment_id", "date")) -> float:
    """Core-microseconds a row that kernels would save, by the estimates."""
    plan = Plan(signals, late=True)
    return sum(max(w - k, 0.0) for w, k in estimates(plan, carried_of(plan, _last_use(plan, keep), plan.fields())).values())


def _kernel_phase(frame: DataFrame, plan: Plan, p: int, steps, last_use: dict[str, int], flags: set[str], rows: int, laid: bool) -> DataFrame:
    from .kernels import Phase

    made = [plan.column[id(n)] for step in steps for n in step]
    carried = [c for c in [*frame.columns, *made] if last_use.get(c, 0) > p]
    key = "permno" if p % 2 else "date"
    types = dict(frame.dtypes)
    schema = ", ".join(f"{c} {types.get(c) or ('boolean' if c in flags else 'double')}" for c in carried)
    work = Phase(steps, dict(plan.column), p % 2 == 1, carried, flags)
    frame = frame.select(*(c for c in frame.columns if last_use.get(c, 0) >= p))
    frame = frame if laid else spread(frame, rows, key)
    return frame.sortWithinPartitions(key, "date").mapInArrow(_Run(work, key), schema)


def _reads(plan: Plan, node: Node) -> set[str]:
    """Columns and fields that a node's operands are made of."""
    found = {node.param} if node.op == "indneutralize" else set()
    for x in node.args:
        found |= {plan.column[id(x)]} if id(x) in plan.column else {x.param} if x.op == "field" else _reads(plan, x)
    return found


def _trips(plan: Plan, keep) -> dict[int, tuple[set[str], set[str], set[str]]]:
    """Phase -> columns that it makes, that come to it from the other side, that leave it. A phase of securities makes anew what earlier ones made
    of fields, so of these only what the dates read goes there, and only what was made there comes back."""
    phase = {plan.column[id(n)]: p for (p, _), nodes in plan.steps.items() for n in nodes}
    node = {plan.column[id(n)]: n for nodes in plan.steps.values() for n in nodes}
    end = max(phase.values())
    leaves = set(keep) | {"permno", "segment_id", "date"}
    for n in plan.outputs.values():
        leaves |= {plan.column[id(n)]} if id(n) in plan.column else {n.param} if n.op == "field" else _reads(plan, n)
    out = {}
    for p in range(end, 0, -1):
        made: set[str] = set()
        comes: set[str] = set()
        todo = [*leaves, *(c for c in phase if phase[c] == p)] if p % 2 == 0 else [*leaves]
        while todo:
            c = todo.pop()
            if c in made or c in comes:
                continue
            if phase.get(c) == p or (p % 2 and c in phase and (phase[c] % 2 or not phase[c])):
                made.add(c)
                todo += _reads(plan, node[c])
            else:
                comes.add(c)
        out[p] = (made, comes, leaves)
        leaves = {c for c in comes if c in phase} if p % 2 else comes - {"permno", "date"}
    return out


def _two_sides(panel: DataFrame, plan: Plan, keep, flags: set[str], rows: int, digits: int | None) -> DataFrame:
    """All phases as kernels. What dates need goes there packed; what is made there comes back and meets the panel's rows again, which are derived anew, so
    that fields and what only securities need make no trip to the dates and back. What only the result reads, and rounds, comes back rounded. All travel
    as compressed blocks, one for each task that sends and each bucket (of dates or securities) that gets them."""
    from .kernels import BUCKET, OWN, PACKED, Packed, Sided, Stored

    trips = _trips(plan, keep)
    end, types = max(trips), dict(panel.dtypes)
    op = {plan.column[id(n)]: n.op for nodes in plan.steps.values() for n in nodes}
    schema, to = f"{BUCKET} int, {PACKED} binary", task_count(panel.sparkSession, rows)
    outs = {plan.column[id(n)] for n in plan.outputs.values() if id(n) in plan.column} - set().union(*(_reads(plan, n) for nodes in plan.steps.values() for n in nodes))
    outs -= flags | set().union(*(_reads(plan, n) for n in plan.outputs.values() if id(n) not in plan.column))
    frame, arrives = None, None
    for p in range(1, end + 1):
        made, comes, leaves = trips[p]
        own = [[n for n in plan.steps[k] if plan.column[id(n)] in made] for k in sorted(plan.steps) if k[0] <= p]
        carried, packs = [], None
        if p == end:
            carried = [*(c for c in panel.columns if c in leaves), *sorted(c for c in leaves if c not in types)]
        else:
            corr, ranks = sorted(c for c in leaves if op.get(c) == "ts_corr"), sorted(c for c in leaves if op.get(c) == "rank")
            rounded = sorted(leaves & outs - {*corr, *ranks}) if digits is not None else []
            packs = Packed(sorted(leaves - {*corr, *ranks, *rounded}), corr, ranks, flags, rounded, digits or 0)
        fields = panel.select(*(c for c in panel.columns if c in comes | {"permno", "segment_id", "date"})) if p % 2 else None
        stored = Stored({c: types[c] for c in fields.columns}, to) if p % 2 and p > 1 else None
        run = _Run(Sided([s for s in own if s], dict(plan.column), p % 2 == 1, carried, flags, arrives, packs, stored, to), "permno" if p % 2 else "date")
        made_of = schema if p < end else ", ".join(f"{c} {types.get(c) or ('boolean' if c in flags else 'double')}" for c in carried)
        if frame is None:
            frame = fields.sortWithinPartitions("permno", "date").mapInArrow(run, made_of)
        else:
            frame = fields.mapInArrow(stored, f"{BUCKET} int, {OWN} binary").unionByName(frame, allowMissingColumns=True) if stored else frame
            frame = dealt(frame, rows, BUCKET).sortWithinPartitions(BUCKET).mapInArrow(run, made_of)
        arrives = packs
    return frame


def _by_dates(frame: DataFrame, plan: Plan, last_use: dict[str, int], flags: set[str], rows: int) -> DataFrame:
    """A single phase of dates as kernels: the panel's rows go to it in compressed blocks."""
    from .kernels import BUCKET, OWN, Sided, Stored

    types, steps = dict(frame.dtypes), [plan.steps[k] for k in sorted(plan.steps)]
    carried = [c for c in [*types, *(plan.column[id(n)] for step in steps for n in step)] if last_use.get(c, 0) > 2]
    schema = ", ".join(f"{c} {types.get(c) or ('boolean' if c in flags else 'double')}" for c in carried)
    to = task_count(frame.sparkSession, rows)
    stored = Stored(types, to, "date")
    run = _Run(Sided(steps, dict(plan.column), False, carried, flags, own=stored, to=to), "date")
    return dealt(frame.mapInArrow(stored, f"{BUCKET} int, {OWN} binary"), rows, BUCKET).sortWithinPartitions(BUCKET).mapInArrow(run, schema)


class _Run:
    """A phase for mapInArrow. Nodes travel with the phase, so their names are kept by their place in it."""

    def __init__(self, work, key: str):
        self.work, self.key = work, key
        self.nodes = []
        seen = set()

        def walk(n: Node) -> None:
            if id(n) not in seen:
                seen.add(id(n))
                self.nodes.append(n)
                for x in n.args:
                    walk(x)

        for step in work.steps:
            for n in step:
                walk(n)
        self.labels = [work.names.get(id(n)) for n in self.nodes]

    def __call__(self, batches):
        # after the trip to a worker the nodes are other objects with the same structure
        self.work.names = {id(n): label for n, label in zip(self.nodes, self.labels, strict=True) if label}
        yield from self.work.batches(batches, self.key)


def to_sql(panel_sql: str, signals: dict[str, Node], *, keep: tuple[str, ...] = ("permno", "segment_id", "date"), digits: int | None = None) -> str:
    """The same for DuckDB: panel_sql is a WITH clause that defines `panel`."""
    plan = Plan(signals)
    last, ctes = "panel", [panel_sql]
    for i, step in enumerate(plan.ordered()):
        ctes.append(f"s{i} AS (SELECT *, " + ", ".join(f"{plan.text(n, 'duckdb')} AS {plan.column[id(n)]}" for n in step) + f" FROM {last})")
        last = f"s{i}"
    return ",\n".join(ctes) + "\nSELECT " + ", ".join([*keep, *(plan.result(name, node, "duckdb", digits) for name, node in signals.items())]) + f" FROM {last}"
