"""4. URL filters: prefix rules, then a character language-model ratio."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path), as contracted.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Longest context in bytes; entries of the count tables that a chunk of URLs is cut to (a chunk has its own, of all that it asks for;
#: only a longer single URL makes them larger); strength of the smoothing; part of the ruled URLs that is kept for the threshold;
#: steps of that threshold.
ORDER, SLOTS, STRENGTH, HELD, STEP = 5, 1 << 18, 4.0, 5, 1 / 256


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # a longer rule is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def keys(data: np.ndarray, off: np.ndarray):
    """For each order 0 .. ORDER and each byte: the key of its context, and of its context with it: order, bytes and byte (256: none) in
    52 bits, so different ones never share a key. A context ends at the text's start, so a byte's place caps its order; there the
    shorter context is used again."""
    n = len(data)
    place = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    x = data.astype(np.int64)
    context = np.zeros(n, np.int64)
    for order in range(ORDER + 1):
        if order:
            at = np.flatnonzero(place >= order)
            context[at] |= x[at - order] << (8 * (order - 1))  # order bytes before, nearest first
        key = (context | (order << (8 * ORDER))) << 9
        yield key | 256, key | x, place >= order


def distinct(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all contexts, and of all contexts with a byte, of some texts."""
    found = [(context[fit], both[fit]) for context, both, fit in keys(data, off)]
    return np.unique(np.concatenate([c for c, _ in found])), np.unique(np.concatenate([b for _, b in found]))


def grams(data: np.ndarray, off: np.ndarray):
    """As keys(), by their places in distinct(); 0 where a byte has no context of that order."""
    contexts, pairs = distinct(data, off)
    for context, both, fit in keys(data, off):
        yield np.where(fit, np.searchsorted(contexts, context), 0), np.where(fit, np.searchsorted(pairs, both), 0), fit


def tally(batches):
    """key, n0, n1: how often each context, and context and byte, stands in (site, kind) of either kind, by chunk of what is read."""
    for b in batches:
        kind = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
        for a, z, data, off in common.text_chunks(b, 0, SLOTS):
            of = np.repeat(kind[a:z], np.diff(off))
            for context, both, fit in keys(data, off):
                for k in (context, both):
                    for c in range(2):
                        key, n = np.unique(k[fit & (of == c)], return_counts=True)
                        none = np.zeros(len(key), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(none if c else n), pa.array(n if c else none)], ["key", "n0", "n1"])


@dataclass
class Model:
    """Two variable-order Markov models over bytes, as far as some texts need them. Each order's estimate is smoothed towards the next
    shorter one's. sums: by place in distinct() of those texts, 2 c for contexts and 2 c + 1 for context and byte, of class c."""

    sums: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, off: np.ndarray, key: np.ndarray, counts) -> Model:
        """From the counts of both classes by key; a key that isn't among them was never seen."""
        asked = distinct(data, off)
        sums = np.zeros((4, max(map(len, asked))))
        for which, own in enumerate(asked):
            is_own = (key & 256 == 0) == bool(which)
            for c in range(2):
                sums[2 * c + which, np.searchsorted(own, key[is_own])] = counts[c][is_own]
        return cls(sums)

    def ratios(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log-likelihood of the accepted model less that of the rejected one, by byte of the text; 0 for an empty text."""
        sizes = np.diff(off)
        if not len(data):
            return np.zeros(len(sizes))
        p = [np.full(len(data), 1 / 256) for _ in range(2)]
        for context, both, fit in grams(data, off):
            for c in range(2):
                new = (self.sums[2 * c + 1][both] + STRENGTH * p[c]) / (self.sums[2 * c][context] + STRENGTH)
                p[c] = np.where(fit, new, p[c])
        # whole numbers of 2 ** -24, so that a sum doesn't depend on how texts lie together in a chunk
        gain = np.rint((np.log(p[0]) - np.log(p[1])) * 2**24).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(gain)])
        return (sums[off[1:]] - sums[off[:-1]]) / 2**24 / np.maximum(sizes, 1)


def score(rows: DataFrame) -> DataFrame:
    """rows (page_id, host, path, rule, ruled) with ratio and held: models counted over all ruled URLs but the held-out fifth.

    Counts are an exact distributed table of each context, and context and byte, of each order. URLs are cut to chunks, a chunk asks once
    for each of its keys, so a frequent key meets a row for a chunk and not for an URL, and what it is told comes to its URLs."""
    held = F.pmod(F.xxhash64("host", "path"), F.lit(HELD)) == 0  # repeated URLs are all on one side

    def number(batches):
        i = 0
        for b in batches:
            for a, z, _, _ in common.text_chunks(b, 5, SLOTS // (ORDER + 1)):
                chunk = (TaskContext.get().partitionId() << 33) + i
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(a, z - a) for k in range(6)), pa.array(np.full(z - a, chunk))], ["page_id", "host", "path", "rule", "ruled", "site", "chunk"])
                i += 1

    fields = "page_id long, host string, path string, rule string, ruled string"
    sites = rows.select("page_id", "host", "path", "rule", "ruled", F.concat("host", "path").alias("site"))
    sites = common.settle(sites.mapInArrow(number, fields + ", site string, chunk long"), "sites")
    ruled = sites.where(F.col("ruled").isNotNull() & ~held).select("site", F.when(F.col("ruled") == "allow", 0).otherwise(1).alias("kind"))
    counts = ruled.mapInArrow(tally, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def ask(batches):
        for b in batches:
            chunk = b.column(1).to_numpy()
            for a, z in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]), strict=True):
                for _, _, data, off in common.text_chunks(b.slice(a, z - a), 0):
                    key = np.concatenate(distinct(data, off))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk[a])), pa.array(key)], ["chunk", "key"])

    # by exchange always: Spark takes what the chunks ask for to be as small as the compressed URLs, and would send it through the driver
    told = sites.select("site", "chunk").mapInArrow(ask, "chunk long, key long").hint("merge").join(counts, "key").select("chunk", "key", "n0", "n1")

    def ratios(own: pa.Table, told: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        key, *n = (told.column(c).to_numpy() for c in ("key", "n0", "n1"))
        out = [np.zeros(0)]
        for b in own.select(["site"]).to_batches():
            for _, _, data, off in common.text_chunks(b, 0):
                asked = np.isin(key, np.concatenate(distinct(data, off)))
                out.append(Model.of(data, off, key[asked], [c[asked] for c in n]).ratios(data, off))
        return own.select(["page_id", "host", "path", "rule", "ruled"]).append_column("ratio", pa.array(np.concatenate(out)))

    scored = sites.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(ratios, fields + ", ratio double")
    return common.settle(scored.withColumn("held", held), "scored")


def threshold(scored: DataFrame) -> float:
    """The held-out fifth of the different ruled URLs sets it, each row of them counted."""
    step = F.greatest(F.lit(-2048), F.least(F.lit(2048), F.rint(F.col("ratio") / STEP))).cast("int")
    ruled = scored.where(F.col("ruled").isNotNull() & F.col("held"))
    seen = ruled.groupBy(step.alias("step"), F.when(F.col("ruled") == "allow", 0).otherwise(1).alias("kind")).count().collect()  # 4097 * 2 rows at most
    by = np.zeros((2, 4097))
    for r in seen:
        by[r["kind"], r["step"] + 2048] += r["count"]
    if not (by[0].sum() and by[1].sum()):
        return 0.0
    # accept from a step on: hits of the accepted at or above it, of the rejected below it
    right = np.cumsum(by[0][::-1])[::-1] / by[0].sum() + np.concatenate([[0], np.cumsum(by[1])[:-1]]) / by[1].sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return (int(best[np.argmin(np.abs(best - 2048))]) - 2048 - 0.5) * STEP


def filter_urls(pages: DataFrame, *, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, ratio for each row.

    Where no rule fits, the verdict is the model's: allow if the length-normalised log-likelihood difference of host and path
    reaches the calibrated threshold. Null or odd url: empty host and path, judged by the model as ratio 0. With no ruled URL of
    one kind the threshold is 0. Very long URLs: whole. Null id: returned as null. Repeated rows: each returned. Empty table: no rows. Other columns are
    not read."""
    u = F.col(url)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    scored = score(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")))
    said = F.when(F.col("ratio") >= threshold(scored), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "ratio")
