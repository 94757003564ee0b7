"""12. MinHash near-dedup: SuperMinHash signatures with early stopping, bands, exact verification, union-find groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, simhash

#: Components of a signature, and those of a band. A pair of similarity 0.85 shares no band with a probability of 6e-11.
SLOTS, ROWS = 128, 4


def signatures(h: np.ndarray, at: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of sets of distinct hashes (each text's lie together): every element walks a random permutation of the slots, and offers
    its j-th slot the value j + r, r random in [0, 1). The slot keeps the least. So a text's elements are spread over its slots more evenly
    than by independent hashes. All elements take step j together; a text stops as soon as all its slots hold values under j + 1, which no
    later step can beat: at once for long texts, after `slots` steps at most."""
    n = len(at) - 1
    sig = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    of, live, walk = np.repeat(np.arange(n), np.diff(at)), np.asarray(h, np.uint64), None
    for j in range(slots):
        if not len(live):
            break
        u = common.mix(live + np.uint64((j + 1) * int(common.C1) % (1 << 64)))
        k = j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        own = np.arange(len(live))
        place = k if walk is None else walk[own, k].astype(np.int64)
        np.minimum.at(sig, of * slots + place, (np.uint64(j) << np.uint64(32)) | (u >> np.uint64(32)))
        some = np.unique(of)
        more = some[sig.reshape(n, slots)[some].max(1) >= np.uint64((j + 1) << 32)]
        stays = np.isin(of, more)
        if walk is None:
            walk = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (int(stays.sum()), 1))
            walk[np.arange(len(walk)), k[stays]] = 0
        else:
            walk[own, k] = walk[:, j]
            walk = walk[stays]
        live, of = live[stays], of[stays]
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of a signature, with the band's number."""
    bands = sig.shape[1] // rows
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        key = common.mix(key * common.C1 + sig[:, r::rows])
    return key


def set_identities(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each whole set."""
    out = []
    for seed in (common.C1, common.C2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(common.mix(h ^ seed), dtype=np.uint64)])
        out.append(common.mix((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(np.uint64) * seed).view(np.int64))
    return out


def sets_of(shingle: int):
    """For verified(): identities, hashes and offsets of the sets of concatenated texts."""

    def run(data, off):
        _, _, h, at = simhash.shingle_sets(data, off, shingle)
        return *set_identities(h, at), h, at

    return run


def alike(percent: int):
    """For verified(): whether sets of x and y elements that share some have that similarity, in whole numbers."""
    return lambda both, x, y: 100 * both >= percent * (x + y - both)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of the set of word shingles, A-Z lowered), component_id (the least id reached over links of texts whose sets
    share at least that part, its own included) for each row. Every link is confirmed on whole sets.

    Texts of equal sets are one node. Nodes that share a band of their SuperMinHash signatures are candidates; bands with the same members
    are one bucket. A bucket is first held against a representative, and only what no round of these has joined is compared in pairs
    (simhash.linked), so a bucket of near copies costs its members, not their pairs. Set sizes and set fingerprints discard candidates
    that can't be links; what is left is verified; links are joined by union-find rounds.

    Fewer words than a shingle: the whole sequence is one shingle. Null or empty text, or one without words: no shingles, linked with
    nothing. Long texts: whole. Null id: returned with a null component, links nothing. Repeated rows: each returned; an id with several
    texts is a node for each. Empty table: no rows. Other columns are not read."""
    whole = common.keyed_text(docs, key, text)
    made = sets_of(shingle)

    def outline(batches):
        for b in batches:
            for a, z, data, off in common.text_chunks(b):
                one, two, h, at = made(data, off)
                keys = band_keys(signatures(h, at))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                prints = pa.array([x.tobytes() for x in simhash.parities(h, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.diff(at)), pa.array(one), pa.array(two), bands, prints], ["doc_id", "number", "one", "two", "bands", "fp"])

    rows = common.settle(whole.mapInArrow(outline, "doc_id long, number long, one long, two long, bands array<long>, fp binary"), "rows")
    distinct = rows.where("doc_id is not null and number > 0").groupBy("one", "two").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("number", "bands", "fp")))
    nodes = common.settle(distinct.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))

    def verify(pairs):
        return simhash.verified(pairs, nodes.select("node", "least", "one", "two"), whole, made, alike(percent))

    found = simhash.linked(members, nodes.select("node", "number", "fp"), percent / 100, verify)
    grouped = nodes.select("node", "one", "two", "least").join(graph.components(found), "node", "left").withColumn("group", F.coalesce("root", "node"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    by_set = grouped.join(least, "group").select("one", "two", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "number", "one", "two").join(by_set, ["one", "two"], "left").select("doc_id", F.col("number").alias("n_shingles"), own.alias("component_id"))


#: Shingles are lists, so no joining can make two of them equal; a set of no shingles is in no pair.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
k AS (SELECT g, row_number() OVER () AS k FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
t AS (SELECT s.doc_id, k.k FROM s JOIN k USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS up FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.up)
SELECT n.doc_id, n.n AS n_shingles, min(r.up) AS component_id, n.doc_id = min(r.up) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
