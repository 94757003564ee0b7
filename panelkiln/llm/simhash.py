"""7. SimHash near-dedup: links between fingerprints found with pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common, graph

#: Reference fingerprints of the distance tables; parts a fingerprint is cut into (links of at most BITS differing bits leave
#: PARTS - BITS parts alike); fingerprints of a bucket above which its parts are cut again; rows of a block, two of which a task
#: compares with each other.
PIVOTS, PARTS, BITS, SPLIT, BLOCK = 24, 5, 3, 2048, 1024


def fingerprints(data: np.ndarray, off: np.ndarray, shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints of concatenated texts, A-Z lowered: a bit is 1 if set in over half of the shingles' XXH64."""
    n = len(off) - 1
    out = np.zeros(n, np.uint64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, of = common.word_bounds(low, off)
    if not len(start):
        return out
    # words joined by one space: the bytes of words and the one after each
    keep = np.zeros(len(low) + 1, bool)
    keep[:-1] = ~common.SPACE[low]
    size = end - start
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    new = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    joined[np.repeat(new - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(int(size.sum()))] = low[keep[:-1]]
    first = np.searchsorted(of, np.arange(n + 1))
    words = np.diff(first)
    a = np.flatnonzero((np.arange(len(of)) + shingle <= first[1:][of]) | ((words[of] < shingle) & (np.arange(len(of)) == first[:-1][of])))
    z = np.minimum(a + shingle, first[1:][of[a]]) - 1
    raw = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[s:e], seed) for s, e in zip(new[a].tolist(), (new[z] + size[z]).tolist(), strict=True)), np.uint64, len(a))
    own = np.bincount(of[a], minlength=n)
    has = np.flatnonzero(own)
    heads = np.concatenate([[0], np.cumsum(own[has])])[:-1]
    for at in range(0, len(has), 4096):
        some = has[at : at + 4096]
        lo = heads[at]
        hi = heads[at] + int(own[some].sum())
        bits = np.unpackbits(h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, heads[at : at + 4096] - lo, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > own[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint_rows(docs: DataFrame, shingle: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for b in batches:
            for a, z, data, off in common.text_chunks(b):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(fingerprints(data, off, shingle).view(np.int64))], ["doc_id", "fp"])

    return common.keyed_text(docs, key, text).mapInArrow(run, "doc_id long, fp long")


def widths(parts: int) -> list[tuple[int, int]]:
    cuts = [64 * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def pivots(n: int = PIVOTS) -> np.ndarray:
    return common.mix(np.arange(1, n + 1, dtype=np.uint64) * common.C2)


def distances(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The table: Hamming distance of every fingerprint to every pivot, pivots first."""
    return np.bitwise_count(refs[:, None] ^ fp[None, :]).astype(np.int8)


class Forest:
    """Joins nodes of one bucket's fingerprints; keeps only which are connected, never the pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def cells(members: DataFrame) -> DataFrame:
    """members (bucket, count, node, ...) as (cell, side, node, ...): a bucket of up to BLOCK rows is a cell; a larger one is cut to blocks, and
    pairs of blocks are cells, so no task holds a whole hot bucket. side: -1, or a number where only rows of unlike sides meet.

    With a column root only rows of unlike roots need to meet. The root with most rows of a bucket doesn't meet itself: its blocks meet those
    of the other rows only, so a bucket of which little is left unjoined sends its rows about once."""
    kept = [c for c in members.columns if c not in ("bucket", "count")]
    small = members.where(F.col("count") <= BLOCK).select(F.col("bucket").alias("cell"), F.lit(-1).alias("side"), *kept)
    large = members.where(F.col("count") > BLOCK)
    if "root" in kept:
        sizes = large.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", "count").alias("most"), F.max("count").alias("own"))
        large = large.join(sizes, "bucket")
        inner, own = F.col("root") == F.col("most"), F.col("own")
    else:
        inner, own = F.lit(False), F.lit(0)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    cut = large.withColumns({"_in": inner, "_n": blocks(own), "_m": blocks(F.col("count") - own)})
    cut = cut.withColumn("_b", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("_in"), F.col("_n")).otherwise(F.col("_m"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() AS array<int>)"))
    across = F.transform(upto(F.when(F.col("_in"), F.col("_m")).otherwise(F.col("_n"))), lambda o: F.struct(F.lit(0).alias("kind"), F.when(F.col("_in"), F.col("_b")).otherwise(o).alias("x"), F.when(F.col("_in"), o).otherwise(F.col("_b")).alias("y"), F.col("_in").cast("int").alias("side")))
    among = F.transform(upto(F.when(F.col("_in"), 0).otherwise(F.col("_m"))), lambda o: F.struct(F.lit(1).alias("kind"), F.least("_b", o).alias("x"), F.greatest("_b", o).alias("y"), F.when(F.col("_b") == o, -1).otherwise(F.col("_b")).alias("side")))
    dealt = cut.withColumn("_c", F.explode(F.concat(across, among)))
    return small.unionByName(dealt.select(F.xxhash64("bucket", "_c.kind", "_c.x", "_c.y").alias("cell"), F.col("_c.side").alias("side"), *kept))


def shared_buckets(members: DataFrame) -> DataFrame:
    """members (bucket, ...) of buckets with two rows or more, with count. Counts have a partial step, and the join is one that adaptive
    execution can split, so a hot bucket is not gathered."""
    return members.join(members.groupBy("bucket").count().where("count > 1"), "bucket")


def met(cell: np.ndarray, side: np.ndarray):
    """Pairs i, j of rows that share a cell (rows of one lie together), by shifting the arrays: never more at once than there are rows."""
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    end = np.repeat(edge[1:], np.diff(edge))
    live = np.arange(len(cell))
    for shift in range(1, int(np.diff(edge).max(initial=0))):
        live = live[live + shift < end[live]]
        i = live[(side[live] < 0) | (side[live] != side[live + shift])]
        yield i, i + shift


def links_within(fp: np.ndarray, cell: np.ndarray, side: np.ndarray, bits: int, refs: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """The root's position for each fingerprint: pairs of a cell at most `bits` apart are linked. Pivot tables discard first, the exact
    distance verifies the survivors. known: equal numbers for rows that are joined already, which are not compared."""
    forest, table = Forest(len(fp)), distances(fp, refs)
    if known is not None:
        _, first, number = np.unique(known, return_index=True, return_inverse=True)
        forest.root = first[number]
    for i, j in met(cell, side):
        apart = forest.root[i] != forest.root[j]
        i, j = i[apart], j[apart]
        for row in table:
            near = np.abs(row[i] - row[j]) <= bits
            i, j = i[near], j[near]
            if not len(i):
                break
        if len(i):
            hit = np.bitwise_count(fp[i] ^ fp[j]) <= bits
            forest.link(i[hit], j[hit])
    return forest.root


def by_bucket(batches, at: int, solve):
    """solve() of the rows of whole buckets, as batches sorted by column `at` come in."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(at).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
        if last:
            yield solve([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield solve(held)


def part(fp: str, a: int, z: int):
    return F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1))


def links(fps: DataFrame, bits: int = BITS, parts: int = PARTS) -> DataFrame:
    """a, b: enough links between nodes (least ids of distinct fingerprints: node, fp) to connect all that are at most `bits` apart.

    Each fingerprint goes to a bucket for every choice of the parts - bits parts that a link must leave alike; in a bucket the
    pivots decide. A bucket of over SPLIT is cut again by the bits + 1 parts of which two that link have one alike; each of these is held against
    representatives first, and what is left apart is cut to pairs of blocks. A cell gives at most a link for each of its fingerprints."""
    keys = []
    for chosen in combinations(range(parts), parts - bits):
        value = F.lit(0).cast("long")
        for p in chosen:
            a, z = widths(parts)[p]
            value = F.shiftleft(value, z - a).bitwiseOR(part("fp", a, z))
        keys.append(F.xxhash64(value, F.lit(len(keys))))
    dealt = shared_buckets(fps.select("node", "fp", F.explode(F.array(*keys)).alias("bucket")))
    again = F.explode(F.array(*(F.xxhash64("bucket", F.lit(k), part("fp", a, z)) for k, (a, z) in enumerate(widths(bits + 1)))))
    large = common.settle(shared_buckets(dealt.where(F.col("count") > SPLIT).select("node", "fp", again.alias("bucket"))), "large")
    found, roots = None, None
    for turn in range(0 if large.isEmpty() else ROUNDS):
        near = lambda first: F.bit_count(F.col("fp").bitwiseXOR(first["fp"])) <= bits
        more = common.settle(representatives(unlike(large.select("bucket", "node", "fp"), roots), turn, near), "near")
        found = more if found is None else found.unionAll(more)
        roots = graph.components(found)
    left = unlike(large, roots)
    apart = left.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    left = left.join(apart, "bucket").unionByName(dealt.where(F.col("count") <= SPLIT).withColumn("root", F.col("node")))
    every = cells(left.select("bucket", "count", "node", "fp", "root")).repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        refs = pivots()

        def solve(rows):
            t = pa.concat_tables([pa.Table.from_batches([r]) for r in rows])
            node, fp, cell, side, known = (np.array(t.column(c)) for c in ("node", "fp", "cell", "side", "root"))
            root = links_within(fp.view(np.uint64), cell, side, bits, refs, known)
            own = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])

        yield from by_bucket(batches, 0, solve)

    within = every.mapInArrow(run, "a long, b long")
    return within if found is None else found.unionAll(within)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long), component_id (least id reached over links of at most `bits` differing bits, its own included).

    Texts with fewer words than a shingle are one shingle; without words the fingerprint is 0, linked like any other. Null text:
    empty. Null id: returned with its fingerprint and a null component unless linked to a row with an id. Repeated rows: each
    returned. Very long texts: whole. Empty table: no rows. Other columns are not read."""
    rows = common.settle(fingerprint_rows(docs, shingle, key, text), "fingerprints")
    fps = common.settle(rows.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "distinct")
    roots = graph.components(links(fps, bits))
    by_fp = fps.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return rows.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id")


# Links by shingle similarity ----------------------------------------------------------------------------------------

#: Bands of minima and minima in a band, which find most links at little cost; part of a text's shingles by which its prefix is longer
#: than it must be (more rows, fewer candidates); bits of a set's fingerprint, and reference fingerprints of its distance tables.
BANDS, MINIMA, SLACK, WIDTH, REFS = 16, 4, 0.2, 1024, 8


def least_shared(number, similarity: float):
    """Shingles that a set of this size must share at least with one of that similarity."""
    return np.ceil(similarity * number - 1e-9).astype(np.int64)


def lower_words(data: np.ndarray, off: np.ndarray):
    """Of concatenated texts, A-Z lowered: the words' hashes, each one's text, where each text's begin, and two hashes of all its words."""
    from .quality import word_hashes

    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, end, of = common.word_bounds(low, off)
    words = word_hashes(low, start, end)
    first = np.searchsorted(of, np.arange(len(off)))
    return words, of, first, [common.Spans(words, c).of(first[:-1], first[1:]).view(np.int64) for c in (common.C1, common.C2)]


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int):
    """Two identity hashes of each text's words; the distinct shingle hashes, sorted within each text; where each text's begin. A text of
    fewer words is one shingle."""
    n = len(off) - 1
    words, of, first, whole = lower_words(data, off)
    if not len(words):
        return *whole, np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    i = np.arange(len(of))
    a = np.flatnonzero((i + shingle <= first[1:][of]) | ((np.diff(first)[of] < shingle) & (i == first[:-1][of])))
    h = common.Spans(words, common.C1).of(a, np.minimum(a + shingle, first[1:][of[a]]))
    text = of[a]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return *whole, h[new], np.searchsorted(text[new], np.arange(n + 1))


def parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A set's fingerprint: for each of WIDTH slots whether an odd number of its hashes fall there. Shingles in both sets cancel, so two
    fingerprints differ in no more bits than their sets in shingles: a bound for any pair, however long, where SimHash gives an estimate."""
    n = len(at) - 1
    out = np.zeros((n, WIDTH // 8), np.uint8)
    slot = (common.mix(h + common.C2) >> np.uint64(8)).astype(np.int64) % WIDTH
    for a in range(0, n, 2048):
        z = min(n, a + 2048)
        text = np.repeat(np.arange(z - a), np.diff(at[a : z + 1]))
        odd = np.bincount(text * WIDTH + slot[at[a] : at[z]], minlength=(z - a) * WIDTH) & 1
        out[a:z] = np.packbits(odd.astype(np.uint8).reshape(z - a, WIDTH), axis=1)
    return out


def outlines(data: np.ndarray, off: np.ndarray, shingle: int, similarity: float):
    """Of concatenated texts: identity hashes, number of distinct shingles, bands (0: none), prefix (offsets and the least hashes) and fingerprint.

    Sets of n and m shingles with that similarity share at least least_shared(n). So the prefixes of the n - least_shared(n) + 1 +
    SLACK least_shared(n) least hashes share at least 1 + SLACK least_shared of the smaller."""
    one, two, h, at = shingle_sets(data, off, shingle)
    number = np.diff(at)
    n = len(number)
    bands = np.zeros((n, BANDS), np.uint64)
    has = np.flatnonzero(number)
    for band in range(BANDS if len(has) else 0):
        key = np.full(len(has), band + 1, np.uint64)
        for m in range(MINIMA):
            turn = np.uint64(int(common.mix(np.array([band * MINIMA + m + 1], np.uint64))[0]) | 1)
            key = common.mix(key * common.C1 + np.minimum.reduceat((h ^ (h >> np.uint64(31))) * turn >> np.uint64(8), at[has]))
        bands[has, band] = key | np.uint64(1)
    needed = least_shared(number, similarity)
    size = np.minimum(number, number - needed + 1 + np.floor(SLACK * needed).astype(np.int64)) * (number > 0)
    first = np.concatenate([[0], np.cumsum(size)])
    own = np.arange(int(first[-1])) - np.repeat(first[:-1] - at[:-1], size)
    return one, two, number, bands, first, h[own], parities(h, at)


def candidates(number, fp, cell, side, similarity: float, group=None):
    """Pairs i, j of rows of a cell that may have that similarity, by what no such pair can exceed: the sizes of the sets, and (a part of
    both sizes together) the differing bits of the fingerprints, first in their distances to reference fingerprints and then exactly.
    group: only pairs of unlike groups, all of them; without it enough pairs to connect all that survive."""
    words = np.ascontiguousarray(fp).view(np.uint64)
    apart = (1 - similarity) / (1 + similarity) + 1e-9
    refs = words[np.linspace(0, len(words) - 1, REFS).astype(int)]
    table = np.stack([np.bitwise_count(words ^ r).sum(1, dtype=np.int32) for r in refs])
    forest = Forest(len(number))
    for i, j in met(cell, side):
        few = (group[i] != group[j]) if group is not None else (forest.root[i] != forest.root[j])
        i, j = i[few], j[few]
        fit = np.minimum(number[i], number[j]) >= similarity * np.maximum(number[i], number[j]) - 1e-9
        i, j = i[fit], j[fit]
        most = apart * (number[i] + number[j])
        near = (np.abs(table[:, i] - table[:, j]).max(0) <= most) if len(i) else np.zeros(0, bool)
        i, j, most = i[near], j[near], most[near]
        for a in range(0, len(i), 65_536):
            x, y = i[a : a + 65_536], j[a : a + 65_536]
            hit = np.bitwise_count(words[x] ^ words[y]).sum(1, dtype=np.int32) <= most[a : a + 65_536]
            x, y = x[hit], y[hit]
            if group is None:
                forest.link(x, y)
            if len(x):
                yield x, y


def survivors(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: distinct pairs of nodes from members (bucket, count, node, number, fp and perhaps root) that survive candidates()."""
    grouped = "root" in members.columns
    dealt = cells(members).repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        def solve(rows):
            t = pa.concat_tables([pa.Table.from_batches([r]) for r in rows])
            node, number, cell, side = (np.array(t.column(c)) for c in ("node", "number", "cell", "side"))
            fp = np.frombuffer(b"".join(x.as_buffer() for x in t.column("fp")), np.uint8).reshape(len(node), WIDTH // 8)
            found = list(candidates(number, fp, cell, side, similarity, np.array(t.column("root")) if grouped else None))
            i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        yield from by_bucket(batches, 0, solve)

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, sets_of, alike) -> DataFrame:
    """The pairs whose whole sets are alike(number in both, number of a, number of b). sets_of(data, offsets): the identities, hashes and
    offsets of the sets of concatenated texts. Sets are made of the texts in the pairs only; those of b travel, those of a stay, so a should
    be what many have in common."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    wanted = common.settle(wanted.select("node", "least", "one", "two"), "wanted")

    def sets(batches):
        for b in batches:
            for a, z, data, off in common.text_chunks(b, 0):
                one, two, h, at = sets_of(data, off)
                own = [h[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(own, pa.binary())], ["one", "two", "shingles"])

    texts = rows.join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    made = texts.mapInArrow(sets, "one long, two long, shingles binary").join(wanted.select("node", "one", "two"), ["one", "two"])
    made = common.settle(made.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")  # rows repeated in full
    left, right = (made.select(F.col("node").alias(c), F.col("shingles").alias(f"s_{c}")) for c in ("a", "b"))

    def compare(batches):
        for b in batches:
            fit = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                fit.append(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long")


def plausible(pairs: DataFrame, looks: DataFrame, similarity: float) -> DataFrame:
    """The pairs that may have that similarity by the sizes and fingerprints of their sets, looks (node, number, fp)."""

    def run(batches):
        for b in batches:
            x, y = (np.array(b.column(k)) for k in (2, 4))
            fx, fy = (np.frombuffer(b"".join(v.as_buffer() for v in b.column(k)), np.uint64).reshape(len(x), WIDTH // 64) for k in (3, 5))
            fit = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9
            fit &= np.bitwise_count(fx ^ fy).sum(1, dtype=np.int64) <= ((1 - similarity) / (1 + similarity) + 1e-9) * (x + y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(fit))

    sides = [looks.select(F.col("node").alias(c), F.col("number").alias(f"number_{c}"), F.col("fp").alias(f"fp_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "number_a", "fp_a", "number_b", "fp_b")
    return both.mapInArrow(run, "a long, b long")


#: Rounds in which buckets are held against a representative before what is left is compared in pairs.
ROUNDS = 2


def representatives(members: DataFrame, turn: int, near=lambda first: F.lit(True)) -> DataFrame:
    """a, b: from members (bucket, node, root, ...) of each bucket that still holds unlike roots a member, drawn by hash, with every member of
    another root that is near() it. Aggregates with a partial step choose, so a hot bucket is not gathered."""
    drawn = F.min_by(F.struct(*(c for c in members.columns if c != "bucket")), F.xxhash64("node", F.lit(turn))).alias("first")
    heads = members.groupBy("bucket").agg(drawn, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    met = members.join(heads.select("bucket", "first"), "bucket").where((F.col("root") != F.col("first.root")) & near(F.col("first")))
    return met.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()


def unlike(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """members (bucket, node, ...) with root (the node itself where roots has none)."""
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def distinct_buckets(members: DataFrame) -> DataFrame:
    """Of members (bucket, node) the buckets with two nodes or more, those with the same members once (told by their number and two hashes)."""
    told = members.groupBy("bucket").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in (1, 2))).where("n > 1")
    return members.join(told.groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket").select("bucket", "node")


def linked(members: DataFrame, looks: DataFrame, similarity: float, verify) -> DataFrame:
    """a, b: links that connect all nodes which share a bucket of members (bucket, node) and are links by verify(pairs).

    First every bucket is held against one member; what that joins needs no pairs of its own. What still lies apart after ROUNDS of this
    is compared in pairs of unlike groups: discarded by looks (node, number, fp) and verified. No pair is verified twice."""
    kept = common.settle(distinct_buckets(members), "buckets")
    tried = found = roots = None
    for turn in range(ROUNDS):
        pairs = representatives(unlike(kept, roots), turn)
        if tried is not None:
            pairs = pairs.join(tried, (pairs["a"] == tried["b"]) & (pairs["b"] == tried["a"]), "left_anti").join(tried, ["a", "b"], "left_anti")
        pairs = common.settle(plausible(pairs, looks, similarity), "pairs")
        more = common.settle(verify(pairs), "verified")
        tried, found = (pairs, more) if tried is None else (tried.unionAll(pairs), found.unionAll(more))
        roots = graph.components(found)
    rest = unlike(kept, roots)
    apart = rest.groupBy("bucket").agg(F.count("*").alias("count"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high and count > 2").select("bucket", "count")
    last = survivors(rest.join(apart, "bucket").join(looks, "node"), similarity)
    for ends in (["a", "b"], ["b", "a"]):
        last = last.join(tried.select(F.col("a").alias(ends[0]), F.col("b").alias(ends[1])), ["a", "b"], "left_anti")
    return common.settle(found.unionAll(verify(common.settle(last, "last"))), "links_found")


def similar(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash (XXH64 of the text), component_id for each row: the least id reached over links between texts whose sets of word
    shingles have at least that Jaccard similarity. No link is missed and none is estimated.

    Texts of the same words are one node. Pairs that share a band of minima are looked at first, which joins most groups. Then every pair
    of unlike groups is found that may be similar: of each text's prefix the shingles that few other prefixes hold, as many as must
    include one that a similar text has too, rarest first, so that common lines come last. Set sizes and pivot distance tables discard,
    and the whole shingle sets verify each survivor once.

    Texts without words are copies of each other. Null text: no words. Null id: returned with a null component, links nothing. Repeated
    rows: each returned; an id with several texts is a node for each. Very long texts: whole. Empty table: no rows. Other columns are not read."""
    whole = common.keyed_text(docs, key, text)

    def identify(batches):
        for b in batches:
            for a, z, data, off in common.text_chunks(b):
                one, two = lower_words(data, off)[3]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(2).slice(a, z - a), pa.array(one), pa.array(two)], ["doc_id", "text_hash", "one", "two"])

    def outline(batches):
        for b in batches:
            for a, z, data, off in common.text_chunks(b, 0):
                one, two, number, bands, first, prefix, fp = outlines(data, off, shingle, similarity)
                banded = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (z - a) + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
                listed = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(prefix.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(number), banded, listed, pa.array([x.tobytes() for x in fp], pa.binary())], ["one", "two", "number", "bands", "prefix", "fp"])

    rows = common.settle(whole.withColumn("text_hash", F.xxhash64("text")).mapInArrow(identify, "doc_id long, text_hash long, one long, two long"), "rows")
    # a node stands for all texts of the same words; copies collapse in each task, before anything is sent
    distinct = whole.where("doc_id is not null").select("text").mapInArrow(outline, "one long, two long, number long, bands array<long>, prefix array<long>, fp binary").dropDuplicates(["one", "two"])
    heads = common.settle(distinct.withColumn("node", F.monotonically_increasing_id()), "outlines")
    least_id = rows.where("doc_id is not null").groupBy("one", "two").agg(F.min("doc_id").alias("least"))
    nodes = common.settle(heads.select("node", "one", "two").join(least_id, ["one", "two"]), "nodes")
    looks = heads.select("node", "number", "fp")

    def verify(pairs):
        return verified(pairs, nodes, whole, lambda data, off: shingle_sets(data, off, shingle), lambda both, x, y: both >= similarity * (x + y - both) - 1e-9)

    found = linked(heads.select("node", F.explode("bands").alias("bucket")).where("bucket <> 0"), looks, similarity, verify)
    roots = graph.components(found)

    tokens = heads.select("node", "number", F.explode("prefix").alias("bucket"))
    held = shared_buckets(tokens).withColumnRenamed("count", "df")
    needed = F.ceil(F.col("number") * similarity - 1e-9)
    by_node = Window.partitionBy("node")
    rare = held.select("node", "bucket", F.row_number().over(by_node.orderBy("df", "bucket")).alias("place"), F.count("*").over(by_node).alias("shares"), (1 + F.floor(needed * SLACK)).alias("must"))
    rare = rare.where(F.col("place") <= F.col("shares") - F.col("must") + 1).select("node", "bucket").join(roots, "node", "left")
    rare = common.settle(rare.select("node", "bucket", F.coalesce("root", "node").alias("root")), "rare")
    across = rare.groupBy("bucket").agg(F.count("*").alias("count"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket", "count")
    far = common.settle(survivors(rare.join(across, "bucket").join(looks, "node"), similarity), "far")
    more = verify(far)
    roots = graph.components(common.settle(found.unionAll(more), "linked"))

    grouped = nodes.join(roots, "node", "left").select("one", "two", "least", F.coalesce("root", "node").alias("group"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    by_text = grouped.join(least, "group").select("one", "two", "component_id")
    return rows.join(by_text, ["one", "two"], "left").select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, groups: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of similar(): that of the least id, of two texts with that id the one of lesser hash, of rows that
    repeat both any one. Rows without an id stay. Null, empty and very long texts: told by the whole text's hash, null as empty. All columns
    stay, whatever their names. Empty table: no rows."""
    own, hashed, n = (common.fresh(docs.columns, c) for c in ("own", "hashed", "n"))
    first = groups.where("component_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    counted = groups.where("component_id is not null").groupBy("component_id", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    told = counted.join(first, "component_id").select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed), F.when((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash")), F.col("n")).otherwise(0).alias(n))
    ids = [F.col(key).cast("long") == F.col(own), F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(hashed)]
    kept = docs.join(told.where(F.col(n) == 0).drop(n), ids, "left_anti")
    twice = told.where(F.col(n) > 1).drop(n)
    if twice.isEmpty():
        return kept
    own_rows = kept.join(twice, ids, "left_semi").dropDuplicates([key, text])
    return kept.join(twice, ids, "left_anti").unionByName(own_rows)
