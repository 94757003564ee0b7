"""13. Merkle dataset manifest: a hash tree over each group of rows and one over the groups, level by level as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def field_text(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count of the decimal or text, `:`, and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hashed(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(field_text(c) for c in fields)), 256)


def group_key(group: Column) -> Column:
    """A string that is never null and orders as the group's UTF-8 bytes, null first."""
    text = group.cast("string")
    return F.when(text.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), text))


def parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """df with part and i, the row's place from 0 in the order within its part and group; and a table (part, group, before, total): the rows
    of the group in earlier parts, and in all. i + before is the row's place in its group.

    The rows are range-partitioned by group and order and written with the number of their part, and the window numbers a group within a
    part only. So a group with most of the rows is numbered by many tasks."""
    spark = df.sparkSession
    ranged = common.settle(df.repartitionByRange(parts(spark), group, *order).withColumn("part", F.spark_partition_id()), name)
    counts = common.settle(ranged.groupBy("part", group).agg(F.count("*").alias("here")), f"{name}_parts")
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(group).agg(F.sum("here").alias("total"))
    placed = counts.select("part", group, F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before")).join(totals, group)
    within = F.row_number().over(Window.partitionBy("part", group).orderBy(*order))
    return ranged.withColumn("i", within.cast("long") - 1), placed


def runs(nodes: DataFrame, fanout: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (tree, i, total, digest, carried...) as (tree, i, total, kids): runs of fanout consecutive nodes, by their parent's place."""
    kids = F.sort_array(F.collect_list(F.struct("i", "digest", *carried))).alias("kids")
    return nodes.groupBy("tree", F.floor(F.col("i") / fanout).cast("long").alias("up")).agg(F.first("total").alias("total"), kids).withColumnRenamed("up", "i")


def joined(kids: str = "kids") -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def others(text: Column, at: Column) -> Column:
    """The digests of a run without that at place `at`."""
    return F.concat(F.substring(text, F.lit(1), 64 * at), F.substring(text, 64 * at + 65, F.length(text)))


def with_own(siblings: Column, at: Column, own: Column) -> Column:
    """The digest of a run of these siblings with `own` at place `at`."""
    return F.sha2(F.concat(F.substring(siblings, F.lit(1), 64 * at), own, F.substring(siblings, 64 * at + 1, F.length(siblings))), 256)


@dataclass
class Tree:
    """levels[n]: runs of the nodes at level n; roots: (tree, total, top, digest), top the level at which one node is left."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int


def build(nodes: DataFrame, largest: int, fanout: int, name: str, carried: tuple[str, ...] = ()) -> Tree:
    """Level after level until the largest tree has one node. A lone leaf is its own root; every other run, of one node even, is hashed."""
    levels, roots, now = [], [], nodes
    while True:
        own = common.settle(runs(now, fanout, () if levels else carried), f"{name}_{len(levels)}")
        levels.append(own)
        n = len(levels)
        digest = F.when(F.col("total") == 1, F.element_at("kids", 1)["digest"]).otherwise(F.sha2(joined(), 256))
        up = own.select("tree", "total", "i", digest.alias("digest"))
        last = F.col("total") <= fanout**n
        roots.append(up.where(last).select("tree", "total", F.lit(n).alias("top"), "digest"))
        if largest <= fanout**n:
            break
        now = up.where(~last)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionAll(r)
    return Tree(levels, out, fanout)


def paths(tree: Tree, starts: DataFrame, name: str) -> DataFrame:
    """The leaves' runs (tree, total, kids, ...) with the path above them, from starts (tree, top, path, ...). A path is an array of (at,
    others): upwards, the place in the run and the digests of its others. Each level's runs take the path of their node above, and each
    node in them gets its siblings put before it."""
    more = [c for c in starts.columns if c not in ("tree", "top")]

    def start(k: int) -> DataFrame:
        return starts.where(F.col("top") == k).select("tree", F.lit(0).cast("long").alias("i"), *more)

    now = start(len(tree.levels))
    for k in range(len(tree.levels) - 1, 0, -1):
        run = tree.levels[k].select("tree", "i", F.size("kids").alias("size"), joined().alias("text")).join(now, ["tree", "i"])
        each = run.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"))
        step = F.array(F.struct("at", others(F.col("text"), F.col("at")).alias("others")))
        place = (F.col("i") * tree.fanout + F.col("at")).alias("i")
        now = common.settle(each.select("tree", place, *(F.concat(step, "path").alias("path") if c == "path" else F.col(c) for c in more)).unionAll(start(k)), f"{name}_{k}")
    return tree.levels[0].join(now, ["tree", "i"])


#: No step yet.
NO_PATH = "cast(array() AS array<struct<at:int,others:string>>)"


def manifest(docs: DataFrame, fields: list[str], *, group: str, altered: dict[str, Column] | None = None, fanout: int = 16, key: str = "doc_id") -> DataFrame:
    """doc_id, leaf, subroot, root, proof, folded_root, verified for each row.

    leaf: sha256 of the fields, each `-` if null, else byte count, `:`, decimal or text. In each group the leaves ascend by key; every
    fanout consecutive nodes become a parent's digest until one is left, the subroot; the subroots, by group (null first, UTF-8 bytewise),
    become the root in the same way. proof: the siblings' digests, joined, from the leaf's run up to the root. folded_root: the root that
    the row's leaf and proof give, where `altered` has a value of a field, with that value; verified: whether this is the root.

    Null key: first in its group. Null group: a group of its own. Equal keys: by their leaves. Repeated rows: a leaf each. Empty and very
    long texts: hashed whole. One group or leaf only: it is the root, its proof is empty. Empty table: no rows. Further columns are not read."""
    spark = docs.sparkSession
    altered = altered or {}
    leaf = hashed([F.col(f) for f in fields])
    other = F.when(F.coalesce(*altered.values()).isNotNull(), hashed([F.coalesce(altered[f], F.col(f)) if f in altered else F.col(f) for f in fields])) if altered else F.lit(None).cast("string")
    leaves = docs.select(F.col(key).alias("doc_id"), group_key(F.col(group)).alias("group"), leaf.alias("digest"), other.alias("altered"))
    rows, placed = numbered(leaves, "group", ["doc_id", "digest"], "leaves")

    groups = common.settle(placed.groupBy("group").agg(F.first("total").alias("size")), "groups").withColumn("all", F.lit(0))
    most, many = groups.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    named, spots = numbered(groups, "all", ["group"], "ordered_groups")
    named = common.settle(named.join(spots, ["part", "all"]).select("group", (F.col("i") + F.col("before")).alias("tree")), "trees")

    nodes = rows.join(placed.join(named, "group"), ["part", "group"]).select("tree", (F.col("i") + F.col("before")).alias("i"), "total", "digest", "altered", "doc_id")
    inner = build(nodes, most, fanout, "runs", ("altered", "doc_id"))
    subroots = common.settle(inner.roots, "subroots")
    outer = build(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.lit(many).cast("long").alias("total"), "digest"), many, fanout, "group_runs")

    starts = outer.roots.select("tree", "top", F.expr(NO_PATH).alias("path"), F.col("digest").alias("root"))
    tops = paths(outer, starts, "group_paths").select("total", "path", "root", joined().alias("text"), F.posexplode("kids").alias("at", "kid"))
    step = F.array(F.struct("at", others(F.col("text"), F.col("at")).alias("others")))
    above = tops.select(F.col("kid.i").alias("tree"), F.when(F.col("total") == 1, F.col("path")).otherwise(F.concat(step, "path")).alias("path"), "root", F.col("kid.digest").alias("subroot"))
    starts = common.settle(subroots.select("tree", "top").join(above, "tree"), "group_starts")

    each = paths(inner, starts, "paths").select("total", "path", "subroot", "root", joined().alias("text"), F.posexplode("kids").alias("at", "kid"))
    each = each.withColumn("siblings", others(F.col("text"), F.col("at")))
    own = F.coalesce("kid.altered", "kid.digest")
    first = F.when(F.col("total") == 1, own).otherwise(with_own(F.col("siblings"), F.col("at"), own))
    folded = F.aggregate("path", first, lambda d, s: with_own(s["others"], s["at"], d))
    proof = F.concat("siblings", F.array_join(F.transform("path", lambda s: s["others"]), ""))
    out = each.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.digest").alias("leaf"), "subroot", "root", proof.alias("proof"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 7, group_levels: int = 5) -> str:
    """The same for DuckDB, for up to 16 ** levels rows of a source and 16 ** group_levels sources; crc32 is spelled out bit by bit."""
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({0} AS VARCHAR))), ':', {0}) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    bytes_ = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], {bytes_}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), {bit})))"
    out = [f"WITH d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS altered FROM documents)"]
    out.append("g AS (SELECT source, count(*) AS total, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM d GROUP BY source)")
    out.append("n0 AS (SELECT g.tree, g.total, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS digest, doc_id, altered FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)")

    def tree(n: str, r: str, deep: int) -> None:
        for k in range(deep):
            some = "" if not k else f" WHERE total > {16**k}"
            out.append(f"{r}{k} AS (SELECT tree, total, i // 16 AS i, list(digest ORDER BY i) AS kids FROM {n}{k}{some} GROUP BY tree, total, i // 16)")
            out.append(f"{n}{k + 1} AS (SELECT tree, total, i, CASE WHEN total = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS digest FROM {r}{k})")

    tree("n", "r", levels)
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM n{k} WHERE total <= {16**k} AND (total > {16 ** (k - 1)} OR {k} = 1)" for k in range(1, levels + 1))
    out.append(f"s AS ({tops})")
    out.append("m0 AS (SELECT 0 AS tree, (SELECT count(*) FROM g) AS total, tree AS i, digest FROM s)")
    tree("m", "q", group_levels)
    roots = " UNION ALL ".join(f"SELECT digest FROM m{k} WHERE total <= {16**k} AND (total > {16 ** (k - 1)} OR {k} = 1)" for k in range(1, group_levels + 1))
    out.append(f"root AS ({roots})")

    def climb(name: str, r: str, last: str, key: str, deep: int, total: str) -> str:
        """Level by level: the siblings of the row's node, and the fold of its own digest."""
        for k in range(deep):
            at, up = f"x.{key} // {16**k} % 16", f"x.{key} // {16 ** (k + 1)}"
            tree_ = "x.tree" if r == "r" else "0"
            cut = f"list_concat(list_concat(r.kids[:{at}], [x.folded]), r.kids[{at} + 2:])"
            sib = f"array_to_string(list_concat(r.kids[:{at}], r.kids[{at} + 2:]), '')"
            lone = f"r.kids IS NULL OR x.{total} = 1"
            out.append(f"{name}{k} AS (SELECT x.* EXCLUDE (proof, folded), CASE WHEN {lone} THEN x.proof ELSE concat(x.proof, {sib}) END AS proof, CASE WHEN {lone} THEN x.folded ELSE sha256(array_to_string({cut}, '')) END AS folded FROM {last} x LEFT JOIN {r}{k} r ON r.tree = {tree_} AND r.i = {up})")
            last = f"{name}{k}"
        return last

    out.append("x AS (SELECT n0.*, (SELECT count(*) FROM g) AS trees, '' AS proof, coalesce(altered, digest) AS folded FROM n0)")
    last = climb("y", "r", "x", "i", levels, "total")
    last = climb("z", "q", last, "tree", group_levels, "trees")
    final = f"SELECT x.doc_id, x.digest AS leaf, s.digest AS subroot, root.digest AS root, sha256(x.proof) AS proof_sha256, x.folded AS folded_root, x.folded = root.digest AS verified FROM {last} x JOIN s ON s.tree = x.tree CROSS JOIN root"
    return ",\n".join(out) + "\n" + final


SQL = _sql()
