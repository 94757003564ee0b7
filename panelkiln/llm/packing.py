"""10. Packing: deficit round-robin over source queues into fixed-length sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: Tokens of a window at least, in all and for each queue: large beside a document, so that whole documents keep to the mixture.
WINDOW, QUEUE_WINDOW = 64 * 1024, 16 * 1024


class Encoder:
    """Ids as the vocabulary's own library gives them, packed as unsigned integers of 16 bits (32 for larger vocabularies). Where both agree, the same merges run
    through the rank file, which is several times faster; the library itself takes texts with code points newer than its tables;
    special strings follow its default."""

    def __init__(self, vocabulary: bytes, ranks: bytes, pattern: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        from .bpe import read_ranks

        self.library = Tokenizer.from_str(vocabulary.decode())
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.type = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> bytes:
        if not text.isascii() and common.newer_than_tables(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        elif "<|" in text and self.split and self.split.search(text):
            ids = [i for p in self.split.split(text) for i in ([self.special[p]] if p in self.special else self.fast.encode_ordinary(p))]
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, self.type).tobytes()


def encode_queues(docs: DataFrame, *, tokenizer_path: str, ranks_path: str, pattern: str, end_id: int, key: str, text: str, source: str) -> DataFrame:
    """part, queue, doc_id, start (tokens before it in its part of its queue), n, ids: every text tokenised once."""
    sent = common.shared(docs.sparkSession, (common.file_bytes(tokenizer_path), common.file_bytes(ranks_path)))
    queue = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")) if source else F.lit("")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), queue.alias("queue"))

    def run(batches):
        own = common.once(("packing", tokenizer_path, ranks_path), lambda: Encoder(*sent.value, pattern))
        part, ends, end = TaskContext.get().partitionId(), {}, np.array([end_id], own.type).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                few = b.slice(at, 500)
                ids, starts, sizes = [], [], []
                for t, q in zip(few.column(1), few.column(2).to_pylist(), strict=True):
                    x = own.encode(t.as_py()) + end
                    ids.append(x)
                    starts.append(ends.get(q, 0))
                    sizes.append(len(x) // len(end))
                    ends[q] = starts[-1] + sizes[-1]
                yield pa.RecordBatch.from_arrays([pa.array([part] * few.num_rows, pa.int32()), few.column(2), few.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["part", "queue", "doc_id", "start", "n", "ids"])

    return rows.mapInArrow(run, "part int, queue string, doc_id long, start long, n long, ids binary")


def weighted(queues: DataFrame, shares: dict[str, float] | None, temper: float) -> DataFrame:
    """queue, phase, weight from queue, tokens. Sources that shares leaves out, or gives 0, come after all others (phase 1)."""
    if not shares:
        return queues.select("queue", F.lit(0).alias("phase"), F.pow(F.col("tokens").cast("double"), F.lit(float(temper))).alias("weight"))
    if any(w < 0 for w in shares.values()):
        raise ValueError(f"shares can't be negative: {shares}")
    named = queues.sparkSession.createDataFrame([(f"={k}", float(w)) for k, w in shares.items() if w], "queue string, w double")
    return queues.join(named, "queue", "left").select("queue", F.col("w").isNull().cast("int").alias("phase"), F.coalesce("w", F.col("tokens").cast("double")).alias("weight"))


def turns(begin: Column, n: Column, weight: Column, whole: Column, window: int) -> Column:
    """The window that sends a document which ends a queue's first begin + n tokens. Every window adds window * weight / whole to the queue's
    credit, and the queue sends the documents that its credit covers whole; the rest of the credit, its deficit, is carried on."""
    return F.greatest(F.lit(1), F.ceil((begin + n) / (F.lit(float(window)) * weight / whole))).cast("long")


def run_starts(groups: DataFrame, order: list[str]) -> DataFrame:
    """groups with `place`: the tokens of all groups before, in that order. Each task sums its range; the ranges' totals (a number for
    each of Spark's partitions) give where it begins."""
    ranged = groups.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [f.name for f in groups.schema]

    def run(batches):
        total, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column(names.index("tokens")).to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n)], [*names, "range", "within"])
            total = int(ends[-1]) if len(n) else total

    local = common.settle(ranged.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in groups.schema)}, range int, within long"), "groups")
    sums = sorted(local.groupBy("range").agg(F.sum("tokens").alias("tokens")).collect())  # a row for each partition
    starts, total = {}, 0
    for r in sums:
        starts[r["range"]], total = total, total + r["tokens"]
    if not starts:
        return local.withColumn("place", F.col("within")).drop("range", "within")
    table = groups.sparkSession.createDataFrame(list(starts.items()), "range int, first long")
    return local.join(F.broadcast(table), "range").withColumn("place", F.col("first") + F.col("within")).drop("range", "within", "first")


def schedule(encoded: DataFrame, *, window: int | None = None, shares: dict[str, float] | None = None, temper: float = 1.0) -> DataFrame:
    """encoded with turn (phase and window) and place (tokens before the document in the packed stream). Nothing is gathered: a queue's
    credit says which window sends a document, and prefix sums over windows and queues say where that window's turn begins."""
    parts = encoded.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part and queue
    base = parts.select("queue", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    queues = weighted(parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")), shares, temper)
    wholes = queues.groupBy("phase").agg(F.sum("weight").alias("whole"), F.count("*").alias("queues"))
    plan = common.settle(base.join(queues.join(F.broadcast(wholes), "phase"), "queue"), "plan")  # two rows at most
    n_queues = plan.agg(F.max("queues")).first()[0] or 0
    size = window or max(WINDOW, QUEUE_WINDOW * n_queues)
    begin = F.col("base") + F.col("start")
    dealt = encoded.join(plan, ["queue", "part"]).withColumn("begin", begin).withColumn("turn", turns(F.col("begin"), F.col("n"), F.col("weight"), F.col("whole"), size))
    order = ["phase", "turn", "queue"]
    groups = run_starts(dealt.groupBy(*order).agg(F.sum("n").alias("tokens"), F.min("begin").alias("group_first")), order)
    placed = dealt.join(groups.drop("tokens"), order)
    return placed.select("doc_id", "queue", "phase", "turn", "n", "ids", (F.col("place") + F.col("begin") - F.col("group_first")).alias("place"))


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str,
    ranks_path: str,
    pattern: str,
    end_id: int = 0,
    length: int = 1024,
    window: int | None = None,
    shares: dict[str, float] | None = None,
    temper: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, pad (and ids, if kept).

    Window by window every source queue sends whole documents against its credit (schedule()), so until a queue is empty each window has
    the target mixture but for a document at each queue's end. shares: weights by source; else a source's weight is its tokens to the
    power of temper, so 1 is the corpus's own mixture, and less gives small sources more. The stream is cut every `length` tokens; only the
    last sequence can be short, and is padded unless its length is a power of two. Null text: only the end id. Null source: a queue of
    its own, after the others if shares are given. Very long texts: whole. Null id: returned as null. Repeated rows: each packed. Empty table: no rows. Other
    columns are not read. The order of documents within a source is that of their parts of the input."""
    encoded = common.settle(encode_queues(docs, tokenizer_path=tokenizer_path, ranks_path=ranks_path, pattern=pattern, end_id=end_id, key=key, text=text, source=source), "packing")
    placed = schedule(encoded, window=window, shares=shares, temper=temper).select("doc_id", "n", "place", "ids")
    whole = encoded.agg(F.sum("n")).first()[0] or 0
    rest = whole % length
    pad = 0 if rest & (rest - 1) == 0 else length - rest

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            bits = []
            for d, n, place, raw in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                raw = raw.as_buffer()
                ids = np.frombuffer(raw, f"<u{raw.size // n}").astype("<u4").tobytes()
                at = 0
                while at < n:
                    s, offset = divmod(place + at, length)
                    size = min(n - at, length - offset)
                    piece = ids[4 * at : 4 * (at + size)]
                    for col, v in zip(out, (d, at, size, zlib.crc32(piece), n, s, offset, pad if (s + 1) * length > whole else 0), strict=True):
                        col.append(v)
                    if keep_ids:
                        bits.append(piece)
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out] + ([pa.array(bits, pa.binary())] if keep_ids else []), ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "pad", *(["ids"] if keep_ids else [])])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, pad long" + ", ids binary" * keep_ids
    return placed.mapInArrow(run, schema)
