"""11. Periodic run detection: every lag compared in vectorised form, documents and ranges of lags dealt over the tasks."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Lags that one task row takes at most; bytes of text above which a text's lags are dealt as ranges (a word takes two bytes at least, and
#: a lag goes up to a quarter of the words or more); words past a hit of the grid that are looked at before its stretch is.
LAGS, PROBE = 1 << 18, 24
RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all texts, equal within a text where the words are equal and never equal across texts; where each text begins."""
    off = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    codes = pa.array(chain.from_iterable(texts), pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes * len(texts) + np.repeat(np.arange(len(texts)), np.diff(off)), off


def root_period(x: np.ndarray, q: int) -> int:
    """The smallest divisor of q that is a period of x (which has period q and at least 2 q words)."""
    block = x[: 2 * q]
    for p in range(1, q // 2 + 1):
        if q % p == 0 and (block[p : p + q] == block[:q]).all():
            return p
    return q


def scan(x: np.ndarray, off: np.ndarray, low: int, high: int, exponent: int, least: int) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of the runs that lags low <= q < high show in concatenated texts, the longest first.

    A run of period q and exponent e is a stretch of (e - 1) q places or more where the words equal those q further. Such a stretch holds
    e - 1 successive multiples of q, so a lag is compared at every q-th word first, and word for word where these all agree. What a lag
    shows may have a smaller period: then that is what is reported, and places within a run are passed over at the multiples of its period,
    which can't show another run there."""
    n = len(x)
    sizes = np.diff(off)
    end, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # of the last run found over each word
    found: dict[tuple[int, int, int], int] = {}
    steps = exponent - 1
    for q in range(low, min(high, int(sizes.max(initial=0)) // exponent + 1)):
        z = int(off[np.searchsorted(-sizes, -exponent * q, "right")])  # texts with room for such a run: the longest come first
        grid = x[:z:q]
        same = grid[1:] == grid[:-1]
        for k in range(1, steps):
            same = same[:-1] & (grid[1 + k :] == grid[k:-1])[: len(same) - 1]
        at = np.flatnonzero(same) * q
        at = at[(q % period[at] != 0) | (at + steps * q >= end[at])] if len(at) else at
        # the next words, as far as the stretch must go
        for t in range(1, min((steps - 1) * q, PROBE) + 1):
            if not len(at):
                break
            at = at[x[at + t] == x[at + t + q]]
        done = -1
        for p in at.tolist():
            if p < done:
                continue
            text = int(np.searchsorted(off, p, "right")) - 1
            a, b = int(off[text]), int(off[text + 1])
            # whole text at this lag: the maximal stretches of equal places, by run lengths
            equal = np.zeros(b - a - q + 2, bool)
            equal[1:-1] = x[a : b - q] == x[a + q : b]
            edge = np.flatnonzero(equal[1:] != equal[:-1])
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= steps * q and e - s + q >= least:
                    s, e = a + s, a + e + q
                    own = root_period(x[s:e], q)
                    found[s, e, own] = text
                    end[s:e], period[s:e] = e, own
            done = b
    return [(t, s - int(off[t]), e - s, p) for (s, e, p), t in found.items()]


def runs_of(texts: list[list[bytes]], low: int, high: int, exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    x, off = word_ids([texts[i] for i in order])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, s, length, p in scan(x, off, low, high, exponent, least):
        out[order[t]].append((s, length, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs) -> bytes:
    """The words outside of runs and the first period of each run, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        gone[s + p] += 1
        gone[s + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist())


Words = list[bytes]


def pieces(ids, texts: list[str | None], edit: Callable[[int | None, Words], Words] | None):
    """Runs of whole texts of about CHUNK_BYTES, as (first, last + 1, words of each); bytes.split() parts at the same six characters."""
    a, size, words = 0, 0, []
    for i, (own, t) in enumerate(zip(ids, texts, strict=True)):
        if words and size + len(t or "") > common.CHUNK_BYTES:
            yield a, i, words
            a, size, words = i, 0, []
        words.append(word_list(own, t, edit))
        size += len(t or "")
    if words:
        yield a, len(texts), words


def word_list(own, text: str | None, edit) -> Words:
    words = (text or "").encode().split()
    return edit(own, words) if edit else words


def find_runs(docs: DataFrame, *, exponent: int = 4, least: int = 6, edit: Callable[[int | None, Words], Words] | None = None, lags: int = LAGS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words; by start, then period), collapsed (the words that stay, joined by one space)
    for each row. A run is a stretch of words of smallest period q, of at least `least` words and `exponent` (2 or more, whole) times q,
    that no neighbouring word extends. Runs may overlap or lie in one another; of each the words after its first q go. edit(id, words): the
    words to take for a text's, as many as these.

    Texts are scanned where they are read, without a shuffle; a text whose lags may be more than `lags` is dealt as rows of a range of lags
    each, and what the ranges find is gathered for each text (a text of n words has fewer than n runs).

    Null or empty text, or one without words: no words, no runs, an empty text. Long texts: whole, in ranges of lags. Ties can't be: equal
    stretches are one run of the smallest period. Null id: a row like any other. Repeated rows: each returned. Empty table: no rows.
    Other columns are not read."""
    if exponent < 2 or int(exponent) != exponent:
        raise ValueError("exponent must be a whole number from 2")
    whole = common.keyed_text(docs, key, text)
    many = (F.octet_length("text") + 1) / (2 * exponent) > lags

    def at_once(batches):
        for b in batches:
            for a, z, words in pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), edit):
                runs = runs_of(words, 1, 1 << 62, exponent, least)
                yield answer(b.column(0).slice(a, z - a), words, runs)

    def ranged(batches):
        for b in batches:
            for own, one, t, low in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = runs_of([word_list(one, t, edit)], low, low + lags, exponent, least)[0]
                cols = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], ["row", "start", "length", "period"])

    def finish(batches):
        for b in batches:
            for a, z, words in pieces(b.column(0).to_pylist(), b.column(1).to_pylist(), edit):
                runs = [[(r["start"], r["length"], r["period"]) for r in rs or []] for rs in b.column(2).slice(a, z - a).to_pylist()]
                yield answer(b.column(0).slice(a, z - a), words, runs)

    schema = f"doc_id long, n_words long, runs {RUNS}, collapsed string"
    short = whole.where(~many).mapInArrow(at_once, schema)
    if whole.where(many).isEmpty():
        return short
    long = common.settle(whole.where(many).withColumn("row", F.monotonically_increasing_id()), "long_texts")
    first = F.sequence(F.lit(1).cast("long"), F.floor((F.octet_length("text") + 1) / (2 * exponent)) + 1, F.lit(lags).cast("long"))
    dealt = long.select("row", "doc_id", "text", F.explode(first).alias("low"))
    found = dealt.repartition("row", "low").mapInArrow(ranged, "row long, start long, length long, period long").distinct()
    listed = common.settle(found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs")), "runs")
    listed = listed.select("row", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))
    return short.unionAll(long.join(listed, "row", "left").select("doc_id", "text", "runs").mapInArrow(finish, schema))


def answer(ids, words: list[list[bytes]], runs) -> pa.RecordBatch:
    flat = [r for rs in runs for r in rs]
    parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
    kept = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in words], pa.int64()), listed, kept], ["doc_id", "n_words", "runs", "collapsed"])


def repeated_tail(own: int | None, words: Words) -> Words:
    """Words that repeat a part of themselves to their end, for about a tenth of the ids: with h = crc32 of the decimal id, h % 10 = 0, g = h div
    10 and n words, each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). Null id, no words: as they are."""
    h = zlib.crc32(str(own).encode()) if own is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]
