"""Connected components as a distributed iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, root from links a, b (long): root is the least node that can be reached; nodes without a link are not listed.

    Large-star and small-star rounds: every node's greater neighbours are linked to its least neighbour, then its lesser ones,
    until only stars are left; the number of rounds grows with the logarithm of the longest path. A node's least neighbour is an
    aggregate with a partial step, so a hub is never gathered in one place. Every round is written to the shared folder."""

    def summary(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    now = common.settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = summary(now)
    while seen[0]:
        # links are kept as (greater, lesser): a node's least neighbour is its least b, or itself where it has none
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        # large star: every greater neighbour a of b goes to b's least neighbour. A hub's links are the left side of a left join,
        # which adaptive execution can split
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # small star: a's lesser neighbours, and a itself, to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        now = common.settle(small, name)
        then, seen = seen, summary(now)
        if then == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
