"""3. Exact top-k search by inner product: three phases with a uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: Vectors in a block of rows; queries that a task scores at once; bytes of the queries that are broadcast at once; part of the
#: blocks whose lists give the cutoff.
ROWS, QUERIES, TURN_BYTES, FIRST = 4096, 512, 8 << 20, 16


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """vec_id, q: floor(scale * x) as whole numbers; rows without an id or with a null or non-finite component take no part."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = df.where(fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("q"))
    return rows.groupBy("vec_id").agg(F.min("q").alias("q"))


def blocks(rows: DataFrame, n: int, width: int) -> DataFrame:
    """block, first (whether its lists give the cutoff), ids, data (16-bit where the values fit, else 64-bit; short vectors end in zeros).

    Rows alike in the signs of their first components share blocks, about ROWS to each, so that a block's bounds are tight. A pattern of
    signs that many rows have is cut by their ids, so no block grows with the hottest one."""
    bits = min(width, max(0, (n // ROWS).bit_length() - 1), 16)
    sign = F.lit(0).cast("long")
    for i in range(bits):
        sign = F.shiftleft(sign, 1).bitwiseOR((F.coalesce(F.get("q", F.lit(i)), F.lit(0)) < 0).cast("long"))
    signed = rows.withColumn("sign", sign)
    many = signed.groupBy("sign").agg(F.ceil(F.count("*") / ROWS).alias("parts"))  # 2 ** 16 rows at most
    dealt = signed.join(F.broadcast(many), "sign").withColumn("block", F.xxhash64("sign", F.pmod(F.xxhash64("vec_id"), F.col("parts"))))

    def pack(t: pa.Table) -> pa.Table:
        q = pa.concat_arrays(t["q"].chunks)
        ids, sizes = t["vec_id"].to_numpy(), np.diff(q.offsets.to_numpy())
        data = np.zeros((len(ids), width), np.int64)
        data[np.arange(width)[None, :] < sizes[:, None]] = q.flatten().to_numpy()
        order = np.argsort(ids, kind="stable")
        small = np.abs(data).max(initial=0) < 1 << 15
        return pa.table({"block": pa.array([t["block"][0].as_py()]), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "data": pa.array([data[order].astype("<i2" if small else "<i8").tobytes()], pa.binary())})

    return dealt.select("block", "vec_id", "q").groupBy("block").applyInArrow(pack, "block long, ids binary, data binary")


def opened(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, f"<i{len(data) // (len(i) * width)}" if len(i) and width else "<i8").reshape(len(i), width).astype(np.int64)


def scores(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Products in floating point, and by how much they may be off: not at all where all sums are whole numbers it holds."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if most < 2**24 else np.float64
    off = 0.0 if most < 2**53 else most * q.shape[1] * 2.0**-52
    return q.astype(kind) @ x.astype(kind).T, off


def bound(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each query what no row of a block exceeds: from the least and greatest value of each component."""
    most = np.maximum(q, 0).astype(float) @ x.max(0).astype(float) + np.minimum(q, 0).astype(float) @ x.min(0).astype(float)
    return most + np.abs(q).sum(1) * float(np.abs(x).max(initial=0)) * 2.0**-40  # rounding


def kth(p: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row; -inf where there are fewer."""
    return -np.partition(-p, k - 1, axis=1)[:, k - 1].astype(float) if p.shape[1] >= k else np.full(len(p), -np.inf)


def best_of_block(qi, q, vi, x, k: int, cut: np.ndarray):
    """(query, row, exact score) of a block's rows that reach the query's cutoff, the k best of each at most (ties to the lesser id).
    Without a cutoff the block's own k-th best score is one, or what is surely below it."""
    p, off = scores(q, x)
    p = np.where(qi[:, None] == vi[None, :], -np.inf, p)
    free = ~np.isfinite(cut)
    cut = cut.copy()
    cut[free] = kth(p[free], k) - off if free.any() else cut[free]
    a, v = np.nonzero((p >= (cut - off)[:, None]) & np.isfinite(p))
    exact = np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 100_000]], x[v[i : i + 100_000]]) for i in range(0, len(a), 100_000)] or [np.zeros(0, np.int64)])
    fit = exact >= cut[a]
    a, v, exact = a[fit], v[fit], exact[fit]
    order = np.lexsort((vi[v], -exact, a))
    a, v, exact = a[order], v[order], exact[order]
    few = np.arange(len(a)) - np.searchsorted(a, a, "left") < k
    return qi[a[few]], vi[v[few]], exact[few]


def some(n: int):
    return (slice(i, min(n, i + QUERIES)) for i in range(0, n, QUERIES))


SCHEMA = "query_id long, vec_id long, score long"


def search(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores over all other rows, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by `every`. They are broadcast in turns of TURN_BYTES to the blocks of rows, which stay where
    they are. In each turn:
    1. One block in FIRST gives its own list, the k best rows of each query. The k-th best of these lists together is the query's cutoff:
       no lesser score can be among the k best of all.
    2. The cutoffs, two numbers to a query, are broadcast. A block whose bound lies under all of them is skipped; of the others the
       entries that reach the cutoff are collected, k of a query at most.
    3. What floating point can't hold exactly is resolved in whole numbers before it is compared with the cutoff.

    Null vectors, null or non-finite components, null ids: no part. Vectors of unlike length: missing components are 0. Repeated
    rows: an id counts once, with its least vector. Empty table: no rows. Other columns are not read."""
    spark = vectors.sparkSession
    rows = common.settle(quantised(vectors, key, vector, scale), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    asked = rows.where(F.col("vec_id") % every == 0)
    turns = max(1, -(-asked.count() * max(1, width) * 8 // TURN_BYTES))
    row_blocks = common.settle(blocks(rows, n, width), "rows")
    first_blocks = row_blocks.where(F.pmod(F.xxhash64("block"), F.lit(FIRST)) == 0)
    found = None
    for turn in range(turns):
        own = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(turns)) == turn).orderBy("vec_id").toArrow()  # about TURN_BYTES
        qi = own["vec_id"].to_numpy().astype(np.int64)
        q = np.zeros((len(qi), width), np.int64)
        for i, x in enumerate(own["q"]):
            q[i, : len(x)] = x.values.to_numpy()
        if not len(qi):
            continue
        sent = common.shared(spark, (qi, q))

        def lists(batches, sent=sent):
            qi, q = sent.value
            for b in batches:
                for ids, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    vi, x = opened(ids, data, width)
                    for part in some(len(qi)):
                        p, off = scores(q[part], x)
                        p = np.where(qi[part, None] == vi[None, :], -np.inf, p - off)
                        few = min(k, p.shape[1])
                        top = -np.partition(-p, few - 1, axis=1)[:, :few].astype(float).ravel()
                        at, real = np.repeat(np.arange(part.start, part.stop), few), np.isfinite(top)
                        yield pa.RecordBatch.from_arrays([pa.array(at[real]), pa.array(np.floor(top[real]).astype(np.int64))], ["query", "score"])

        best = Window.partitionBy("query").orderBy(F.desc("score"))
        listed = first_blocks.select("ids", "data").mapInArrow(lists, "query long, score long").withColumn("rank", F.row_number().over(best))
        cuts = np.full(len(qi), -np.inf)
        for r in listed.where(F.col("rank") == k).select("query", "score").toArrow().to_batches():  # a number for each query of the turn
            cuts[r.column(0).to_numpy()] = r.column(1).to_numpy()
        sent_cuts = common.shared(spark, cuts)

        def collect(batches, sent=sent, sent_cuts=sent_cuts):
            (qi, q), cut = sent.value, sent_cuts.value
            for b in batches:
                for ids, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    vi, x = opened(ids, data, width)
                    for part in some(len(qi)):
                        may = part.start + np.flatnonzero(bound(q[part], x) >= cut[part])
                        if len(may):
                            cols = best_of_block(qi[may], q[may], vi, x, k, cut[may])
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

        one = row_blocks.select("ids", "data").mapInArrow(collect, SCHEMA)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = spark.createDataFrame([], SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
