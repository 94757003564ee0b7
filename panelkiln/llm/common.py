"""What the corpus operators share: loading, shared-folder checkpoints, worker caches, hashing."""

from __future__ import annotations

import gc
import re
import unicodedata
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch are gathered into chunks of about so many bytes of text; only a longer single text makes a larger one.
CHUNK_BYTES = 1_000_000

_CACHE: dict = {}

#: From the first code point that no table assigns.
_PAST_LATIN = re.compile("[\u0378-\U0010ffff]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) only, so that no other column can clash; a null text is empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among these, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def once(key, build: Callable):
    """build() once in each Python worker."""
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A default is set only where none is configured, and only on one machine: on a cluster
    a machine's own folder would lose what others write."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or "file:///tmp/panelkiln-checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, so lost executors cost no recomputation
    of what is above, and the shuffle files above can be freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared(spark: SparkSession, value):
    """Broadcast of a value whose size the caller bounds."""
    return spark.sparkContext.broadcast(value)


def input_bytes(df: DataFrame, text: str) -> int:
    """About the bytes of the input's files: Catalyst's estimate of a scan; where it has none, half of the texts' bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:
        size = (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 2
    return size


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _unassigned() -> re.Pattern:
    runs: list[list[int]] = []
    for c in range(128, 0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


def newer_than_tables(text: str) -> bool:
    """Whether text has a code point that this Python's Unicode tables lack: there regex engines may disagree on letters."""
    return _PAST_LATIN.search(text) is not None and once("unassigned", _unassigned).search(text) is not None


# Arrow -------------------------------------------------------------------------------------------------------------


def text_chunks(batch: pa.RecordBatch, at: int = 1, limit: int = CHUNK_BYTES):
    """(first row, last row + 1, bytes as uint8, offsets) of runs of whole rows of about limit bytes."""
    col = batch.column(at)
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


# Hashing -----------------------------------------------------------------------------------------------------------

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_M = 1 << 64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n) modulo 2 ** 64, kept for the worker's life."""
    have = _CACHE.get(("powers", base))
    if have is None or len(have) <= n:
        p = np.full(max(n + 1, 1 << 20), base % _M, np.uint64)
        p[0] = 1
        have = _CACHE[("powers", base)] = np.cumprod(p)
    return have[: n + 1]


class Spans:
    """Hashes of any spans of one symbol sequence in constant time each: prefix sums of symbol * base ** position,
    brought to position 0 by the inverse power."""

    def __init__(self, x: np.ndarray, base: np.uint64):
        b = int(base) | 1
        self.inverse = powers(pow(b, -1, _M), len(x))
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * powers(b, len(x))[:-1] if len(x) else x, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * C1)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of concatenated texts, and each word's text number.
    Works on bytes: no byte of a longer UTF-8 character is a white-space byte; a text's end ends a word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = SPACE[data]
    inside = ~gap
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = gap[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = gap[1:]
    tails = off[1:] - 1
    last[tails[tails >= 0]] = True
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1
