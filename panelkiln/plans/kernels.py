"""The operators of a phase as array kernels, for wide batches of signals.

A phase's rows come hash-partitioned and sorted by its key, as Arrow batches. Whole groups (a security's history, a date's cross-section) are
gathered up to ROWS rows and evaluated at once, NaN standing for NULL; a window never looks across a segment. Results equal those
of the SQL emitter, sums snapped alike."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view

from ..functions.semantics import PLACES
from .expr import BOOLEAN, TIME, Node

#: Rows evaluated at once, but for a single larger group; cells of windows copied at once.
ROWS, CELLS = 40_000, 4_000_000


def decimals(x, digits: int):
    scale = 10.0**digits
    return np.rint(x * scale) / scale + 0.0


def snapped(x, of):
    """As in SQL: to a grid PLACES binary places finer than the magnitude `of`."""
    with np.errstate(all="ignore"):
        step = np.exp2(np.floor(np.log2(of)) - PLACES)
        return np.where((of > 1e-290) & (of < 1e290), np.rint(x / step) * step + 0.0, x)


def size(w):
    return np.abs(w).max(1)


def starts(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows: the first row of each row's group."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


class Time:
    """Trailing windows of rows sorted by (permno, date)."""

    def __init__(self, columns: dict):
        self.place = np.arange(len(columns["permno"])) - starts(columns["permno"], columns["segment_id"])

    def lag(self, x, k):
        out = np.full(len(x), np.nan)
        if k < len(x):
            out[k:] = x[: len(x) - k]
        out[self.place < k] = np.nan
        return out

    def windows(self, d: int, f, *xs):
        """f of the windows of d rows (arrays of shape (rows, d)), where they lie in one segment without a missing value."""
        n = len(xs[0])
        out = np.full(n, np.nan)
        if n < d:
            return out
        bad = sum(np.isnan(x).astype(np.int64) for x in xs)
        seen = np.concatenate([[0], np.cumsum(bad)])
        full = np.flatnonzero((self.place[d - 1 :] >= d - 1) & (seen[d:] == seen[:-d]))
        views = [sliding_window_view(x, d) for x in xs]
        step = max(1, CELLS // d)
        for a in range(0, len(full), step):
            at = full[a : a + step]
            out[at + d - 1] = f(*(v[at] for v in views))
        return out

    def apply(self, op: str, a: list[np.ndarray], d: int):
        x = a[0]
        if op == "delay":
            return self.lag(x, d)
        if op == "delta":
            return x - self.lag(x, d)
        if op == "decay_linear":
            whole = sum(float(d - k) * (self.lag(x, k) if k else x) for k in range(d))
            return snapped(whole / (d * (d + 1) / 2), self.windows(d, size, x))
        return self.windows(d, _WINDOW[op], *a)


def _moments(w):
    """Windows less their first value, which makes constant ones exactly 0; their sums."""
    c = w - w[:, :1]
    return c, c.sum(1)


def _variance(c, s):
    d = c.shape[1]
    return np.maximum((c * c).sum(1) - s * s / d, 0) / (d - 1)


def _std(w):
    c = w - w[:, :1]
    c = c - c.mean(1, keepdims=True)
    return np.sqrt((c * c).sum(1) / (c.shape[1] - 1))


def _cov(x, y):
    (a, s), (b, t) = _moments(x), _moments(y)
    d = x.shape[1]
    return ((a - s[:, None] / d) * (b - t[:, None] / d)).sum(1) / (d - 1)


def _corr(x, y):
    sx, sy = _std(x), _std(y)
    with np.errstate(all="ignore"):
        return np.where((sx > 1e-12 * size(x)) & (sy > 1e-12 * size(y)), decimals(_cov(x, y) / (sx * sy), 8), np.nan)


_WINDOW = {
    "ts_sum": lambda w: snapped(w.sum(1), size(w)),
    "ts_mean": lambda w: snapped(w.sum(1) / w.shape[1], size(w)),
    "ts_min": lambda w: w.min(1),
    "ts_max": lambda w: w.max(1),
    "ts_stddev": lambda w: snapped(_std(w), size(w)) if w.shape[1] > 1 else np.full(len(w), np.nan),
    "ts_product": lambda w: snapped(w.prod(1), np.abs(w.prod(1))),
    "ts_rank": lambda w: (w <= w[:, -1:]).sum(1) / w.shape[1],
    "ts_argmax": lambda w: (w.shape[1] - 1 - w.argmax(1)).astype(float),
    "ts_argmin": lambda w: (w.shape[1] - 1 - w.argmin(1)).astype(float),
    "ts_cov": lambda x, y: snapped(_cov(x, y), size(x) * size(y)) if x.shape[1] > 1 else np.full(len(x), np.nan),
    "ts_corr": _corr,
}


class Names:
    """Cross-sections of rows sorted by date."""

    def __init__(self, columns: dict):
        self.columns = columns
        self.date = np.unique(starts(columns["date"]), return_inverse=True)[1]

    def total(self, x, group):
        return np.bincount(group, np.where(np.isnan(x), 0.0, x), minlength=group.max(initial=-1) + 1)

    def mean(self, x, group):
        with np.errstate(all="ignore"):
            return (self.total(x, group) / np.bincount(group, ~np.isnan(x), minlength=group.max(initial=-1) + 1))[group]

    def size(self, x, group):
        """Greatest magnitude of each row's group."""
        out = np.zeros(group.max(initial=-1) + 1)
        np.maximum.at(out, group, np.where(np.isnan(x), 0.0, np.abs(x)))
        return out[group]

    def sorted(self, x):
        """Rows with a value in order of (date, value); where each date's begin."""
        known = np.flatnonzero(~np.isnan(x))
        order = known[np.lexsort([x[known], self.date[known]])]
        g = self.date[order]
        return order, g, np.searchsorted(g, np.arange(self.date.max(initial=-1) + 2))

    def apply(self, op: str, a: list[np.ndarray], p):
        x, g = a[0], self.date
        if op == "rank":
            out = np.full(len(x), np.nan)
            order, by, edge = self.sorted(x)
            if len(order):
                v = x[order]
                new = np.concatenate([[True], (v[1:] != v[:-1]) | (by[1:] != by[:-1])])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(v))
                tie = np.cumsum(new) - 1
                first = edge[by]
                out[order] = ((head[tie] - first + 1) + (tail[tie] - first)) / 2.0 / (edge[by + 1] - first)
            return out
        if op == "scale":
            whole = self.total(np.abs(x), g)[g]
            with np.errstate(all="ignore"):
                return np.where(whole > 0, snapped(x / whole, np.abs(x / whole)) * p, np.nan)
        if op == "xs_mean":
            return snapped(self.mean(x, g), self.size(x, g))
        if op == "xs_std":
            c = x - self.mean(x, g)
            n = np.bincount(g, ~np.isnan(x), minlength=g.max(initial=-1) + 1)
            with np.errstate(all="ignore"):
                return snapped(np.where(n > 1, np.sqrt(self.total(c * c, g) / (n - 1)), np.nan)[g], self.size(x, g))
        if op == "xs_quantile":
            order, _, edge = self.sorted(x)
            v, n = x[order], np.diff(edge)
            at = edge[:-1] + p * np.maximum(n - 1, 0)
            low = np.minimum(np.floor(at).astype(int), max(len(v) - 1, 0))
            high = np.minimum(low + 1, edge[1:] - 1).clip(0)
            q = np.where(n > 0, v[low] + (v[high] - v[low]) * (at - low), np.nan) if len(v) else np.full(len(n), np.nan)
            return q[g]
        of = self.columns[p]
        known = ~np.isnan(of)
        pair = np.unique(np.stack([g.astype(float), np.where(known, of, -1.0)]), axis=1, return_inverse=True)[1].ravel()
        return np.where(known, snapped(x - self.mean(x, pair), self.size(x, pair)), np.nan)


def scalar(op: str, a: list[np.ndarray], node: Node) -> np.ndarray:
    with np.errstate(all="ignore"):
        if op in ("add", "sub", "mul"):
            return {"add": np.add, "sub": np.subtract, "mul": np.multiply}[op](*a)
        if op == "div":
            return a[0] / (a[1] + 0.0)
        if op == "pow":
            return np.power(*a)
        if op == "signedpower":
            return np.sign(a[0]) * np.power(np.abs(a[0]), a[1])
        if op in BOOLEAN:
            return {"lt": np.less, "gt": np.greater, "eq": np.equal, "or": np.logical_or}[op](*a)
        if op == "where":
            return np.where(*a)
        if op == "log":
            return np.where(a[0] >= 0, snapped(np.log(a[0]), np.abs(np.log(a[0]))), np.nan)
        if op == "finite":
            return np.where(np.isinf(a[0]), np.nan, a[0])
        if op == "nonzero":
            return np.where(a[0] == 0, np.nan, a[0])
        if op == "float":
            return a[0].astype(float)
        if op == "nn":
            return a[0]
        return {"max": np.maximum, "min": np.minimum, "abs": np.abs, "sign": np.sign, "sqrt": np.sqrt}[op](*a)


#: The column of packed rows; what stands for a missing correlation or date; bytes of an Arrow array of them.
PACKED, MISSING, CHUNK = "packed", -(2**31), 2**30
#: The columns of a block's bucket and of blocks of the panel's own rows; bytes of rows that a task holds before it sends them; how hard blocks are compressed.
BUCKET, OWN, HELD, LEVEL = "bucket", "own", 64_000_000, 3


class Packed:
    """A row's columns as one string of bytes, for their trip between two phases. Correlations, which have 8 decimals, are whole numbers of 4 bytes;
    ranks are twice the rank and the number of values, alike in all rows of a date; what the result rounds to `digits` is rounded here, as whole numbers with
    the sign last; the rest are doubles. Like bytes of ranks and rounded values lie together, so that compression finds them. What is
    unpacked equals what was packed, or its rounded value, to the last bit."""

    def __init__(self, plain: list[str], correlations: list[str] = (), ranks: list[str] = (), flags: set[str] = frozenset(), rounded: list[str] = (), digits: int = 0):
        self.plain, self.correlations, self.ranks, self.flags, self.rounded, self.digits = plain, correlations, ranks, flags, rounded, digits
        #: Columns, type, whether their like bytes lie together.
        self.parts = [(len(plain), "<f8", False), (len(correlations), "<i4", False), (len(ranks), "<u4", True), (len(ranks), "<u4", True), (len(rounded), "u1", True), (len(rounded), "<u8", True)]

    def whole(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounded values as whole numbers, the sign last; 0 for what is one, 1 for what isn't (its bits), 2 for NaN."""
        with np.errstate(all="ignore"):
            x = decimals(x, self.digits)
            k = np.rint(x * 10.0**self.digits)
            fits = (np.abs(k) < 2.0**52) & (k / 10.0**self.digits + 0.0 == x)
        n = np.where(fits, k, 0).astype(np.int64)
        kind = np.where(np.isnan(x), 2, np.where(fits, 0, 1)).astype(np.uint8)
        return kind, np.where(kind == 0, ((n << 1) ^ (n >> 63)).view(np.uint64), np.where(kind == 1, np.ascontiguousarray(x).view(np.uint64), np.uint64(0)))

    def values(self, kind: np.ndarray, u: np.ndarray) -> np.ndarray:
        n = (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)
        return np.where(kind == 0, n / 10.0**self.digits + 0.0, np.where(kind == 1, u.view(np.float64), np.nan))

    @property
    def width(self) -> int:
        return sum(k * np.dtype(kind).itemsize for k, kind, _ in self.parts)

    def rows(self, have: dict[str, np.ndarray], date: np.ndarray | None = None) -> np.ndarray:
        """Bytes by row. date: each row's cross-section, numbered from 0. Without it ranks must have come packed, as their numbers of values are not at hand."""
        n = len(next(iter(have.values())))
        table = lambda names: np.stack([have[c] for c in names], 1).astype(float) if names else np.empty((n, 0))
        corr, rank = table(self.correlations), table(self.ranks)
        of = np.zeros(rank.shape)
        for k in range(len(self.ranks)):
            of[:, k] = have[self.ranks[k], "of"] if date is None else np.bincount(date, ~np.isnan(rank[:, k]), minlength=date.max(initial=-1) + 1)[date]
        parts = [table(self.plain), np.where(np.isnan(corr), MISSING, np.rint(corr * 1e8)), np.where(np.isnan(rank), 0, np.rint(rank * 2 * of)), of, *self.whole(table(self.rounded))]
        bytes_of = []
        for x, (k, kind, together) in zip(parts, self.parts, strict=True):
            b = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(n, k, np.dtype(kind).itemsize)
            bytes_of.append((b.transpose(0, 2, 1) if together else b).reshape(n, k * b.shape[2]))
        return np.concatenate(bytes_of, 1)

    def pack(self, have: dict[str, np.ndarray], date: np.ndarray | None = None) -> pa.ChunkedArray:
        """rows() as a column."""
        rows = self.rows(have, date)
        n, width = rows.shape
        step = CHUNK // max(width, 1)
        arrow = lambda own: pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(own))])
        return pa.chunked_array([arrow(rows[a : a + step]) for a in range(0, n, step)], pa.binary())

    def unpack(self, column: pa.ChunkedArray) -> dict[str, np.ndarray]:
        n, width = len(column), self.width
        rows = [np.frombuffer(c.buffers()[2], np.uint8, len(c) * width, int.from_bytes(c.buffers()[1][4 * c.offset : 4 * c.offset + 4], "little")).reshape(-1, width) for c in column.chunks if len(c) and width]
        return self.columns(np.concatenate(rows) if rows else np.empty((n, width), np.uint8))

    def columns(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of what rows() gave."""
        n = len(rows)
        found, at = [], 0
        for k, kind, together in self.parts:
            size = np.dtype(kind).itemsize
            own = rows[:, at : at + k * size]
            own = own.reshape(n, size, k).transpose(2, 0, 1) if together else own.reshape(n, k, size).transpose(1, 0, 2)
            found.append(np.ascontiguousarray(own).view(kind).reshape(k, n))
            at += k * size
        plain, whole, twice, of, kinds, numbers = found
        have = dict(zip(self.plain, plain, strict=True))
        have |= {c: have[c] != 0 for c in self.flags & set(self.plain)}
        have |= {c: np.where(x == MISSING, np.nan, x / 1e8 + 0.0) for c, x in zip(self.correlations, whole, strict=True)}
        have |= {(c, "of"): v for c, v in zip(self.ranks, of, strict=True)}
        have |= {c: self.values(k, u) for c, k, u in zip(self.rounded, kinds, numbers, strict=True)}
        with np.errstate(all="ignore"):
            return have | {c: np.where(t > 0, t / 2.0 / v, np.nan) for c, t, v in zip(self.ranks, twice, of, strict=True)}


class Phase:
    """Evaluates the steps of one phase on a table of whole groups and appends their columns."""

    def __init__(self, steps: list[list[Node]], names: dict[int, str], time: bool, carried: list[str], flags: set[str]):
        self.steps, self.names, self.time, self.carried, self.flags = steps, names, time, carried, flags

    def values(self, node: Node, have: dict) -> np.ndarray:
        name = self.names.get(id(node))
        if name in have:
            return have[name]
        if node.op == "field":
            return have[node.param]
        if node.op == "num":
            return np.float64(node.param)
        return self.compute(node, have)

    def compute(self, node: Node, have: dict) -> np.ndarray:
        a = [self.values(x, have) for x in node.args]
        n = len(have["date"])
        if node.op in TIME or node.op in ("rank", "scale", "xs_mean", "xs_std", "xs_quantile", "indneutralize"):
            return self.over.apply(node.op, [np.broadcast_to(x, n) for x in a], node.param)
        return scalar(node.op, a, node)

    def read(self, t: pa.Table) -> dict[str, np.ndarray]:
        have = {}
        for c in t.column_names:
            col = t[c]
            if pa.types.is_date(col.type):
                have[c] = col.cast(pa.int32()).to_numpy()
            elif c in ("permno", "segment_id"):
                have[c] = col.to_numpy()
            elif pa.types.is_boolean(col.type):
                have[c] = col.to_numpy(zero_copy_only=False)
            elif pa.types.is_floating(col.type) or pa.types.is_integer(col.type):
                have[c] = col.to_numpy().astype(float)
        return have

    def evaluated(self, have: dict) -> dict:
        """have with the columns of all steps."""
        self.over = Time(have) if self.time else Names(have)
        for step in self.steps:
            for node in step:
                have[self.names[id(node)]] = np.broadcast_to(self.compute(node, have), len(have["date"]))
        return have

    def result(self, t: pa.Table, have: dict) -> pa.Table:
        array = lambda x: pa.array(x) if x.dtype == bool else pa.array(x.astype(float), pa.float64(), from_pandas=True)
        return pa.table([t[c] if c in t.column_names else array(have[c]) for c in self.carried], names=self.carried)

    def batches(self, source: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(source, key):
            yield from self.result(t, self.evaluated(self.read(t))).to_batches()


def whole_groups(source: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by key as tables of whole groups, of about ROWS rows."""
    held, rows = [], 0
    for b in source:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = t[key].cast(pa.int32()).to_numpy() if pa.types.is_date(t[key].type) else t[key].to_numpy()
        last = int(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[-1])  # the last group may go on
        if last:
            yield t.slice(0, last)
        rest = t.slice(last)
        held, rows = rest.to_batches(), rest.num_rows if last else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# Blocks -----------------------------------------------------------------------------------------------------------------


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Each whole number's bucket of n: the CRC of its decimals, which Spark gives alike."""
    own, at = np.unique(keys, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % k) % n for k in own.tolist()], np.int32)[at]


def block(rows: np.ndarray) -> bytes:
    """Rows of bytes as one string: their number, then byte by byte of a row those of all rows, compressed."""
    return len(rows).to_bytes(4, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(np.ascontiguousarray(rows.T), asbytes=True)


def unblock(blocks: list[bytes], width: int) -> np.ndarray:
    """The rows of some blocks."""
    codec = pa.Codec("zstd")
    size_of = [int.from_bytes(b[:4], "little") for b in blocks]
    out = np.empty((sum(size_of), width), np.uint8)
    at = 0
    for b, n in zip(blocks, size_of, strict=True):
        out[at : at + n] = np.frombuffer(codec.decompress(b[4:], n * width, asbytes=True), np.uint8).reshape(width, n).T
        at += n
    return out


def blocks_of(rows: np.ndarray, keys: np.ndarray, to: int, name: str = PACKED) -> pa.RecordBatch:
    """Rows of bytes as a block for each bucket of their keys."""
    of = buckets(keys, to)
    order = np.argsort(of, kind="stable")
    edge = [*np.flatnonzero(np.diff(of[order], prepend=-1)).tolist(), len(order)]
    blocks = [block(rows[order[a:z]]) for a, z in zip(edge[:-1], edge[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(of[order[edge[:-1]]], pa.int32()), pa.array(blocks, pa.binary())], [BUCKET, name])


def in_blocks(parts: Iterator[np.ndarray], kind: np.dtype, key: str | None, to: int, name: str = PACKED) -> Iterator[pa.RecordBatch]:
    """Rows of bytes, which start with their keys, as blocks by bucket; HELD bytes of them are gathered first."""
    held, size = [], 0

    def sent() -> pa.RecordBatch:
        rows = np.concatenate(held)
        keys = keys_of(rows, kind)
        return blocks_of(rows, keys[key] if key else keys, to, name)

    for rows in parts:
        held.append(rows)
        size += rows.size
        if size >= HELD:
            yield sent()
            held, size = [], 0
    if size:
        yield sent()


def keys_of(rows: np.ndarray, kind: np.dtype) -> np.ndarray:
    """What stands at the start of rows of bytes."""
    return np.ascontiguousarray(rows[:, : kind.itemsize]).view(kind).ravel()


#: A row's keys, before its packed columns.
KEYS = np.dtype([("permno", "<i8"), ("date", "<i4")])


#: Types of fields that blocks can carry.
STORED = {"double": "<f8", "float": "<f4", "bigint": "<i8", "int": "<i4", "smallint": "<i2", "tinyint": "i1", "date": "<i4", "boolean": "u1"}


class Stored:
    """The panel's own rows as bytes: keys, fields of these types, and which of them are missing. They go to the buckets of `key`."""

    def __init__(self, kinds: dict[str, str], to: int, key: str = "permno"):
        self.kinds, self.to, self.key = kinds, to, key
        self.fields = [c for c in kinds if c not in KEYS.names]

    @property
    def width(self) -> int:
        return KEYS.itemsize + 1 + sum(np.dtype(STORED[self.kinds[c]]).itemsize + 1 for c in self.fields)

    def rows(self, t: pa.RecordBatch) -> np.ndarray:
        keys = np.empty(t.num_rows, KEYS)
        keys["permno"], keys["date"] = pc.fill_null(t["permno"], 0).to_numpy(), pc.fill_null(t["date"].cast(pa.int32()), MISSING).to_numpy()
        parts = [keys, t["permno"].is_null().to_numpy(zero_copy_only=False).astype("u1")]
        for c in self.fields:
            x, kind = t[c], STORED[self.kinds[c]]
            x = x.cast(pa.int32()) if self.kinds[c] == "date" else x.cast(pa.uint8()) if self.kinds[c] == "boolean" else x
            parts += [pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(kind), x.is_null().to_numpy(zero_copy_only=False).astype("u1")]
        return np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(t.num_rows, -1) for x in parts], 1)

    def table(self, rows: np.ndarray) -> pa.Table:
        keys, at, found = keys_of(rows, KEYS), KEYS.itemsize + 1, {}
        found["permno"] = pa.array(keys["permno"], mask=rows[:, at - 1] != 0).cast(pa.from_numpy_dtype(np.dtype(STORED[self.kinds["permno"]])))
        found["date"] = pa.array(keys["date"], mask=keys["date"] == MISSING).cast(pa.date32())
        for c in self.fields:
            kind = np.dtype(STORED[self.kinds[c]])
            x, gone = keys_of(rows[:, at:], kind), rows[:, at + kind.itemsize] != 0
            at += kind.itemsize + 1
            x = pa.array(x, mask=gone)
            found[c] = x.cast(pa.date32()) if self.kinds[c] == "date" else x.cast(pa.bool_()) if self.kinds[c] == "boolean" else x
        return pa.table({c: found[c] for c in self.kinds})

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_blocks((self.rows(b) for b in batches if b.num_rows), KEYS, self.key, self.to, OWN)


class Sided(Phase):
    """A phase whose columns come or go packed (arrives, leaves), as blocks of the rows that a task sends to one of `to` buckets. Where a phase of securities is not
    the first, and where one of dates is, the panel's own rows come in blocks as well (own)."""

    def __init__(self, steps, names, time: bool, carried: list[str], flags: set[str], arrives: Packed | None = None, leaves: Packed | None = None, own: Stored | None = None, to: int = 1):
        super().__init__(steps, names, time, carried, flags)
        self.arrives, self.leaves, self.own, self.to = arrives, leaves, own, to

    def batches(self, source: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
        if self.leaves is not None:
            yield from in_blocks((self.left(self.evaluated(have)) for _, have in self.groups(source)), KEYS, "date" if self.time else "permno", self.to)
            return
        for t, have in self.groups(source):
            yield from self.result(t, self.evaluated(have)).to_batches()

    def left(self, have: dict) -> np.ndarray:
        """Keys and packed columns."""
        keys = np.empty(len(have["date"]), KEYS)
        keys["permno"], keys["date"] = have["permno"], have["date"]
        return np.concatenate([keys.view(np.uint8).reshape(len(keys), -1), self.leaves.rows(have, None if self.time else self.over.date)], 1)

    def sorted(self, blocks: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by the phase's key and the other one, and their keys."""
        rows = unblock(blocks, width)
        keys = keys_of(rows, KEYS)
        order = np.lexsort((keys["date"], keys["permno"]) if self.time else (keys["permno"], keys["date"]))
        return rows[order], keys[order]

    def groups(self, source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, dict]]:
        """Whole groups: the panel's own rows, where they come here, and columns."""
        if self.arrives is None and self.own is None:
            yield from ((t, self.known(t)) for t in whole_groups(source, "permno"))
            return
        key = "permno" if self.time else "date"
        for _, slices in groupby(by_bucket(source), lambda x: x[0]):
            blocks: dict[str, list[bytes]] = ({PACKED: []} if self.arrives else {}) | ({OWN: []} if self.own else {})
            for _, b in slices:
                for c, found in blocks.items():
                    found += b[c].drop_null().to_pylist()
            if self.arrives:
                packed, keys = self.sorted(blocks.pop(PACKED), KEYS.itemsize + self.arrives.width)
            if self.own:
                panel, same = self.sorted(blocks.pop(OWN), self.own.width)
                if self.arrives and not np.array_equal(keys, same):
                    raise ValueError("the panel has several rows of a security and date, or is not the same each time it is derived")
                keys = same
            edge = np.append(np.flatnonzero(keys[key][1:] != keys[key][:-1]) + 1, len(keys))  # ends of groups
            a = 0
            while a < len(keys):
                z = int(edge[min(np.searchsorted(edge, a + ROWS), len(edge) - 1)])
                t = self.own.table(panel[a:z]) if self.own else None
                have = self.known(t) if self.own else {c: keys[c][a:z] for c in KEYS.names}
                yield t, have | (self.arrives.columns(packed[a:z, KEYS.itemsize :]) if self.arrives else {})
                a = z

    def known(self, t: pa.Table) -> dict[str, np.ndarray]:
        """Columns of the panel's own rows; no date is one."""
        return self.read(t) | {"date": pc.fill_null(t["date"].cast(pa.int32()), MISSING).to_numpy()}


def by_bucket(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of one bucket each."""
    for b in source:
        bucket = b[BUCKET].to_numpy()
        edge = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            yield int(bucket[a]), b.slice(a, z - a)
