"""5. and 8. Exact repeated-substring removal over bytes and over words: what both share.

A window (100 bytes, 50 words) is repeated if its symbols also start at an earlier place. Sorting every suffix of the corpus would
move many times the input, so suffixes are ordered by most significant digits that are chosen by content:

first digit   each window has a canonical anchor: the run of K symbols of least hash in it, leftmost if equal. Equal windows have equal
              anchors at equal places, and a stretch of windows in a row shares one. Stretches are dealt out by their anchor.
second digit  the stretch with all its symbols (128 hash bits). Stretches equal in it are repeated as a whole: they collapse here, as copies
              must before anything is gathered. The earliest stays for the next pass, and only if its anchor has another stretch; an
              anchor alone ends here, as its windows are unique.
last digits   the stretches that are left travel with their symbols, and the symbols decide: bytes by most-significant-digit passes to
              full depth (suffixes.py), words by backward search in an FM-index (fmindex.py).

An anchor with many stretches, in one task or in all, would gather in one place: its windows are dealt singly, by the hash of the
window, and are decided in the same way."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Stretches that a task gathers before it sends; stretches of one anchor in these from which the anchor is spread; input bytes
#: for each bucket and the least number of buckets; place bits in an anchor's sort key (symbols of the longest text).
GATHER, SPREAD, BUCKET_BYTES, LEAST_BUCKETS, PLACE_BITS = 600_000, 32, 2 << 20, 160, 30
NO_ID = -(1 << 63)
PLAIN, SPREAD_OUT, MARKER, KNOWN = 0, 1, 2, 3
#: Distinct stretches of one anchor from which its windows are dealt singly.
MOST = 4096
SCHEMA = "bucket int, blob binary"


@dataclass(frozen=True)
class Kind:
    """Bytes or words; a window's and an anchor's size; whether an earlier place in the same document counts."""

    words: bool
    window: int
    anchor: int
    within: bool


BYTES = Kind(False, 100, 50, True)
WORDS = Kind(True, 50, 25, False)


# Packed columns ----------------------------------------------------------------------------------------------------


def pack(cols: list[np.ndarray], raw: bytes = b"") -> bytes:
    """64-bit columns, differences where small, byte planes together, then zstd."""
    n = len(cols[0]) if cols else 0
    planes = [n.to_bytes(8, "little")]
    for c in cols:
        c = np.ascontiguousarray(c).astype("<i8", copy=False)
        d = np.diff(c, prepend=np.int64(0))
        near = n > 0 and np.abs(d[1:]).max(initial=0) < 1 << 40
        planes += [b"\1" if near else b"\0", (d if near else c).view(np.uint8).reshape(n, 8).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes) + raw)


def unpack(blob: bytes, n_cols: int) -> tuple[list[np.ndarray], bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, cols = int.from_bytes(data[:8], "little"), 8, []
    for _ in range(n_cols):
        c = np.frombuffer(data, np.uint8, 8 * n, at + 1).reshape(8, n).T.copy().view("<i8")[:, 0]
        cols.append(np.cumsum(c) if data[at] else c)
        at += 1 + 8 * n
    return cols, data[at:]


def stacked(blobs, n_cols: int) -> list[np.ndarray]:
    parts = [unpack(b.as_buffer() if hasattr(b, "as_buffer") else b, n_cols)[0] for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * n_cols


def dealt(bucket: np.ndarray, cols: list[np.ndarray]):
    """(bucket, blob) rows of a batch: the rows of each bucket together, in their order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
    out_b, out = [], []
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        out_b.append(int(b[a]))
        out.append(pack([c[order[a:z]] for c in cols]))
    yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], ["bucket", "blob"])


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets from the upper bits of a hash."""
    return (((h.view(np.uint64) >> np.uint64(33)) * np.uint64(n)) >> np.uint64(31)).astype(np.int64)


def anchor_bucket(kh: np.ndarray, n: int) -> np.ndarray:
    """Anchors are hashes that are least among many, so their own upper bits are mostly 0: hashed again."""
    return spread(common.mix(kh.view(np.uint64) ^ common.C2), n)


def doc_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return spread(common.mix(doc.astype(np.int64).view(np.uint64) * common.C1), n)


# Symbols and anchors -----------------------------------------------------------------------------------------------


def symbols(data: np.ndarray, off: np.ndarray, kind: Kind):
    """Symbols of concatenated texts as 64-bit numbers, and where each text's begin; for words also their bounds in bytes."""
    if not kind.words:
        return data.astype(np.uint64) + np.uint64(1), off, None
    from .quality import word_hashes

    start, end, of = common.word_bounds(data, off)
    return word_hashes(data, start, end), np.searchsorted(of, np.arange(len(off))), (start, end)


def rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k symbols, by doubling."""
    n, base, m = len(x), int(common.C1) | 1, 1 << 64
    cur, size, power = x, 1, base
    for bit in bin(k)[3:]:
        cur = cur[: len(cur) - size] * np.uint64(power) + cur[size:]
        size, power = 2 * size, power * power % m
        if bit == "1":
            cur = cur[: n - size] * np.uint64(base) + x[size:]
            size, power = size + 1, power * base % m
    return common.mix(cur)


def least(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w entries, by doubling."""
    cur, size = a, 1
    while 2 * size <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    n = len(a) - w + 1
    return np.minimum(cur[:n], cur[w - size : w - size + n]) if size < w else cur


def stretches(x: np.ndarray, off: np.ndarray, kind: Kind):
    """text, first window, last window, anchor hash, stretch hash of each stretch (windows by their start, in the chunk)."""
    n_windows = len(x) - kind.window + 1
    if n_windows <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    h = rolled(x, kind.anchor)
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    at = (least(key, kind.window - kind.anchor + 1) & low).astype(np.int64)[:n_windows]
    sizes = np.diff(off)
    fits = np.repeat(off[1:] - kind.window, sizes)[:n_windows] >= np.arange(n_windows)
    s = np.flatnonzero(fits)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    a = at[s]
    new = np.ones(len(s), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, p = s[first], s[np.append(first[1:], len(s)) - 1], a[first]
    text = np.searchsorted(off, lo, "right") - 1
    whole = common.Spans(x, common.C2).of(lo, hi + kind.window)
    whole = common.mix(whole ^ ((p - lo).astype(np.uint64) * common.C1))
    return text, lo, hi, h[p].view(np.int64), whole.view(np.int64)


def repeated(group: np.ndarray, doc: np.ndarray, lo: np.ndarray, kind: Kind) -> np.ndarray:
    """Of rows sorted by group, doc and lo: whether an earlier place of the group counts against the row."""
    if not len(group):
        return np.zeros(0, bool)
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(head, len(group)))
    d, p = np.repeat(doc[head], size), np.repeat(lo[head], size)
    return (doc > d) | ((lo > p) & kind.within)


def grouped(*keys: np.ndarray) -> np.ndarray:
    """Group numbers of rows that are sorted by keys."""
    n = len(keys[0])
    new = np.zeros(n, np.int64)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def sort_by(cols: list[np.ndarray], *keys: int) -> list[np.ndarray]:
    order = np.lexsort([cols[k] for k in reversed(keys)])
    return [c[order] for c in cols]


# Passes ------------------------------------------------------------------------------------------------------------


def first_pass(kind: Kind, n: int) -> Callable:
    """From (doc, text): stretches (anchor, stretch, doc, lo, hi - lo | flag << 32) by bucket."""

    def send(parts):
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]  # anchor, stretch, doc, lo, length
        cols = sort_by(cols, 0, 1, 2, 3)
        kh, ctx, doc, lo, size = cols
        known = repeated(grouped(kh, ctx), doc, lo, kind)
        flag = np.where(known, KNOWN, PLAIN)
        # anchors with many stretches here
        open_ = ~known
        anchor = grouped(kh)
        many = np.bincount(anchor[open_], minlength=anchor[-1] + 1)[anchor] >= SPREAD
        flag[open_ & many] = SPREAD_OUT
        bucket = np.where(flag == KNOWN, doc_bucket(doc, n), np.where(flag == SPREAD_OUT, spread(common.mix(ctx.view(np.uint64) ^ common.mix(kh.view(np.uint64))), n), anchor_bucket(kh, n)))
        kh, ctx = np.where(known, 0, kh), np.where(known, 0, ctx)
        marks = np.unique(kh[flag == SPREAD_OUT])
        none = np.zeros(len(marks), np.int64)
        cols = [np.concatenate([a, b]) for a, b in ((kh, marks), (ctx, none), (doc, none), (lo, none), (size | flag << 32, none | MARKER << 32), (bucket, anchor_bucket(marks, n)))]
        cols = sort_by(cols, 2, 3)
        yield from dealt(cols[5], cols[:5])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for a, z, data, off in common.text_chunks(b):
                x, at, _ = symbols(data, off, kind)
                text, lo, hi, kh, ctx = stretches(x, at, kind)
                if len(lo):
                    parts.append((kh, ctx, ids[a + text], lo - at[text], hi - lo))
                    held += len(lo)
                if held > GATHER:
                    yield from send(parts)
                    parts, held = [], 0
        if held:
            yield from send(parts)

    return run


def second_pass(kind: Kind, n: int, most: int) -> Callable:
    """A bucket's stretches: (doc, lo, hi, state) by the documents' buckets. state 0: all its windows are repeated;
    1: windows to compare singly, dealt by window; 2: dealt by anchor. Of one anchor all stretches have one state."""

    def run(table: pa.Table) -> pa.Table:
        kh, ctx, doc, lo, meta = sort_by(stacked(table["blob"], 5), 0, 1, 2, 3)
        flag, size = meta >> 32, meta & 0xFFFFFFFF
        known = flag == KNOWN
        out = [[doc[known], lo[known], lo[known] + size[known], np.zeros(known.sum(), np.int64)]]
        marked = np.unique(kh[flag == MARKER])
        live = (flag == PLAIN) | (flag == SPREAD_OUT)
        kh, ctx, doc, lo, size, flag = (c[live] for c in (kh, ctx, doc, lo, size, flag))
        if len(kh):
            group = grouped(kh, ctx)
            again = repeated(group, doc, lo, kind)
            anchor = grouped(kh)
            head = np.concatenate([[True], group[1:] != group[:-1]])
            distinct = np.bincount(anchor[head], minlength=anchor[-1] + 1)[anchor]
            rest = ~again
            apart = np.isin(kh, marked)
            elsewhere = (flag == SPREAD_OUT) | apart
            by_window = elsewhere | (np.bincount(anchor[rest], minlength=anchor[-1] + 1)[anchor] > most)
            need = rest & ((distinct > 1) | elsewhere)
            out.append([doc[again], lo[again], (lo + size)[again], np.zeros(again.sum(), np.int64)])
            out.append([doc[need], lo[need], (lo + size)[need], np.where(by_window[need], 1, 2)])
        cols = sort_by([np.concatenate(c) for c in zip(*out, strict=True)], 0, 1)
        return pa.Table.from_batches(list(dealt(doc_bucket(cols[0], n), cols)), pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

    return run


def text_blobs(n: int) -> Callable:
    """(doc, text) rows as (bucket, blob): the texts of a bucket together, compressed."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            bucket = doc_bucket(ids, n)
            order = np.argsort(bucket, kind="stable")
            key = bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for i in range(0, len(cut) - 1, 64):
                out_b, out = [], []
                for a, z in zip(cut[:-1][i : i + 64], cut[1:][i : i + 64], strict=True):
                    own = order[a:z]
                    raw = [t.as_buffer() for t in (texts[int(j)] for j in own)]
                    out_b.append(int(key[a]))
                    out.append(pack([ids[own], np.array([len(r) for r in raw], np.int64)], b"".join(raw)))
                yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], ["bucket", "blob"])

    return run


def texts_of(blobs):
    """(ids, bytes, offsets) of a bucket's texts in chunks."""
    for blob in blobs:
        (ids, size), data = unpack(blob.as_buffer(), 2)
        yield ids, np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(size)])


def rows_of(ids: np.ndarray, doc: np.ndarray):
    """Of rows sorted by doc: (text number, row) pairs for texts with these ids."""
    a, z = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
    text = np.repeat(np.arange(len(ids)), z - a)
    row = np.arange(len(text)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + np.repeat(a, z - a)
    return text, row


def runs_of(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first .. first + size - 1 of each, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def with_symbols(bucket, doc, lo, at, size, x):
    """Stretches (doc, lo, size) with their symbols, x from `at` on, as rows of their buckets. Of size 0: settled already."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
    out_b, out = [], []
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        own = order[i:j]
        out_b.append(int(b[i]))
        out.append(pack([doc[own], lo[own], size[own]], x[runs_of(at[own], size[own])].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out, pa.binary())], ["bucket", "blob"])


def window_pass(kind: Kind, n: int) -> Callable:
    """Texts and what is to be compared in them, with its symbols: stretches by their anchor, or single windows by their hash."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = []
        doc, lo, hi, state = stacked(right["blob"], 4)
        need = state > 0
        if need.any():
            doc, lo, hi, state = sort_by([c[need] for c in (doc, lo, hi, state)], 0, 1)
            for ids, data, off in texts_of(left["blob"]):
                has = np.flatnonzero(np.isin(ids, doc))
                if not len(has):
                    continue
                ids = ids[has]
                data = np.concatenate([data[off[i] : off[i + 1]] for i in has])
                off = np.concatenate([[0], np.cumsum(np.diff(off)[has])])
                x, at, _ = symbols(data, off, kind)
                sent = x if kind.words else data
                text, row = rows_of(ids, doc)
                single = state[row] == 1
                t, r = text[single], row[single]
                count = hi[r] - lo[r] + 1
                of, start = np.repeat(t, count), runs_of(at[t] + lo[r], count)
                one, two = (common.Spans(x, c).of(start, start + kind.window).view(np.int64) for c in (common.C2, common.C1))
                one, two, d, place = sort_by([one, two, ids[of], start], 0, 1, 2, 3)
                again = repeated(grouped(one, two), d, place, kind)  # copies within a task collapse before they are sent
                own = np.searchsorted(at, place, "right") - 1
                batches += with_symbols(spread(one, n), d, place - at[own], place, np.where(again, 0, kind.window), sent)
                t, r = text[~single], row[~single]
                if len(t):
                    # the anchor lies where the least hash of every window of the stretch lies; its own hash deals the stretch out
                    h = rolled(x, kind.anchor)
                    low = np.uint64((1 << PLACE_BITS) - 1)
                    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
                    first = at[t] + lo[r]
                    kh = h[(least(key, kind.window - kind.anchor + 1)[first] & low).astype(np.int64)].view(np.int64)
                    batches += with_symbols(anchor_bucket(kh, n), ids[t], lo[r], first, hi[r] - lo[r] + kind.window, sent)
        return pa.Table.from_batches(batches, pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

    return run


def last_pass(kind: Kind, n: int, search: Callable) -> Callable:
    """Repeated windows of a bucket, as (doc, lo, hi, 0) by the documents' buckets. search: of stretches (doc, lo, size, symbols, kind)
    the windows (doc, lo) that also start earlier."""

    def run(table: pa.Table) -> pa.Table:
        cols, raw = zip(*(unpack(b.as_buffer(), 3) for b in table["blob"]), strict=True)
        doc, lo, size = (np.concatenate(c) for c in zip(*cols, strict=True))
        x = np.frombuffer(b"".join(raw), np.uint64 if kind.words else np.uint8)
        known = size == 0
        found = [(doc[known], lo[known])]
        if not known.all():
            found.append(search(doc[~known], lo[~known], size[~known], x, kind))
        doc, lo = (np.concatenate(c) for c in zip(*found, strict=True))
        doc, lo, hi = runs(doc, lo, lo)
        return pa.Table.from_batches(list(dealt(doc_bucket(doc, n), [doc, lo, hi, np.zeros(len(lo), np.int64)])), pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))

    return run


def runs(doc, lo, hi):
    """Windows lo .. hi of documents, joined where they follow on each other."""
    if not len(doc):
        return doc, lo, hi
    doc, lo, hi = sort_by([doc, lo, hi], 0, 1)
    group = grouped(doc)
    # hi so far within the document: documents are set apart by an offset larger than any place
    reach = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], lo[first], reach[np.append(first[1:], len(doc)) - 1]


def removal_pass(kind: Kind) -> Callable:
    """Texts and their repeated windows: doc_id, n (symbols), spans of symbols removed, kept bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        doc, lo, hi, state = stacked(right["blob"], 4)
        gone = state == 0
        doc, lo, hi = runs(*(c[gone] for c in (doc, lo, hi)))
        for ids, data, off in texts_of(left["blob"]):
            raw = data.tobytes()
            words = None
            if kind.words:
                start, end, of = common.word_bounds(data, off)
                first = np.searchsorted(of, np.arange(len(off)))
                words = (start, end, first)
            a, z = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
            n, spans, kept = [], [], []
            for i in range(len(ids)):
                size = int(off[i + 1] - off[i]) if words is None else int(words[2][i + 1] - words[2][i])
                cut: list[list[int]] = []
                for x, y in zip(lo[a[i] : z[i]].tolist(), hi[a[i] : z[i]].tolist(), strict=True):
                    x, y = min(x, size), min(y + kind.window, size)
                    if cut and x <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], y)
                    elif x < y:
                        cut.append([x, y])
                edges = [0, *(e for c in cut for e in c), size]
                if words is None:
                    o = int(off[i])
                    kept.append(b"".join(raw[o + s : o + e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                else:
                    f = int(words[2][i])
                    kept.append(b" ".join(raw[words[0][w] : words[1][w]] for s, e in zip(edges[::2], edges[1::2], strict=True) for w in range(f + s, f + e)))
                n.append(size)
                spans.append([{"start": s, "end": e} for s, e in cut])
            out.append(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n", "spans", "kept"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]))

    return run


def spans_pass(kind: Kind) -> Callable:
    """doc and its removed spans, without the texts."""

    def run(table: pa.Table) -> pa.Table:
        doc, lo, hi, state = stacked(table["blob"], 4)
        gone = state == 0
        doc, lo, hi = runs(*(c[gone] for c in (doc, lo, hi)))
        # windows of neighbouring runs may overlap: spans join where they touch
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + kind.window)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc))[: len(first)] - 1
        doc, lo, hi = doc[first], lo[first], hi[last] + kind.window
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(doc)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["start", "end"]))
        return pa.table({"doc": pa.array(doc[head]), "spans": lists})

    return run


def keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) rows, and what the keys stand for. A row's key is its id (null: the least). Only where an id comes with several texts are
    (id, text) pairs numbered in order, of one id by the text's hash: doc, doc_id, text_hash."""
    rows = common.keyed_text(docs, key, text).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    hashed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"))
    several = hashed.groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a <> b")
    if several.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "text"), None
    order = ["doc_id", "text_hash"]
    names = hashed.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())
    names = common.settle(names, "names")
    return rows.withColumn("text_hash", F.xxhash64("text")).join(names, order).select("doc", "text"), names


def _passes(rows: DataFrame, docs: DataFrame, kind: Kind, text: str, search: Callable, most: int):
    n = max(LEAST_BUCKETS, common.input_bytes(docs, text) // BUCKET_BYTES)
    rows = rows.select("doc", F.col("text").cast("binary").alias("text"))
    name = "words" if kind.words else "bytes"
    sent = rows.mapInArrow(first_pass(kind, n), SCHEMA)
    compared = common.settle(sent.groupBy("bucket").applyInArrow(second_pass(kind, n, most), SCHEMA), f"{name}-stretches")
    texts = rows.mapInArrow(text_blobs(n), SCHEMA)
    windows = texts.groupBy("bucket").cogroup(compared.groupBy("bucket")).applyInArrow(window_pass(kind, n), SCHEMA)
    found = common.settle(windows.groupBy("bucket").applyInArrow(last_pass(kind, n, search), SCHEMA), f"{name}-windows")
    return texts, compared.unionAll(found)


def remove_repeats(docs: DataFrame, kind: Kind, search: Callable, *, key: str, text: str, most: int = MOST) -> DataFrame:
    """doc_id, n, spans, kept for each row; see first_pass and on."""
    rows, names = keyed(docs, key, text)
    texts, gone = _passes(rows, docs, kind, text, search, most)
    found = texts.groupBy("bucket").cogroup(gone.groupBy("bucket")).applyInArrow(removal_pass(kind), "doc_id long, n long, spans array<struct<start: long, end: long>>, kept binary")
    if names is not None:
        found = found.withColumnRenamed("doc_id", "doc").join(names.select("doc", "doc_id"), "doc").drop("doc")
    return found.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n", "spans", "kept")


def cut_repeats(docs: DataFrame, kind: Kind, search: Callable, name: str, *, key: str, text: str, most: int = MOST) -> DataFrame:
    """docs with a column of this name: the removed spans of the row's text, null where there are none. Spans join the rows by their key, so
    texts are moved only where Spark finds no smaller way."""
    rows, names = keyed(docs, key, text)
    _, gone = _passes(rows, docs, kind, text, search, most)
    doc, doc_id, text_hash = (common.fresh([*docs.columns, name], c) for c in ("doc", "doc_id", "text_hash"))
    spans = gone.groupBy("bucket").applyInArrow(spans_pass(kind), "doc long, spans array<struct<start: long, end: long>>")
    own = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)) == F.col(doc_id)
    if names is not None:
        spans = spans.join(names, "doc").select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash), F.col("spans").alias(name))
        own = own & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(text_hash))
    else:
        spans = spans.select(F.col("doc").alias(doc_id), F.col("spans").alias(name))
    return docs.join(spans, own, "left").select(*(docs[c] for c in docs.columns), name)
