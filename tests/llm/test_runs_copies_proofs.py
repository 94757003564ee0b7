"""Periodic runs, MinHash near copies and Merkle proofs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkiln.llm import merkle, minhash, periodic, pii, quality, queries, simhash

from .test_llm import DOC, corpus

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return corpus(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With further columns, one row twice, and a null id."""
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, i % 5 or None, "x", 1, 2.0) for i, t in rows]
    return spark.createDataFrame([*out, out[5], (None, "na ba " * 9, None, None, None, None, None, None)], DOC + ", digest string, n_words int, kids double").repartition(5)


# 11


def brute_runs(w, exponent=4, least=6):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                part = w[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(300):
        e, texts = rng.choice([2, 3, 4, 4, 5]), []
        for _ in range(rng.randint(1, 5)):
            w = [bytes([97 + rng.randrange(rng.choice([1, 2, 3, 9]))]) for _ in range(rng.randint(0, 50))]
            if w and rng.random() < 0.6:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // (3 + rng.randrange(8))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            texts.append(w)
        cut = rng.randint(1, 6)
        parts = [periodic.runs_of(texts, k, k + cut, e, 6) for k in range(1, 30, cut)]
        for k, w in enumerate(texts):
            want = brute_runs(w, e)
            assert periodic.runs_of(texts, 1, 1 << 62, e, 6)[k] == want
            assert sorted({r for p in parts for r in p[k]}, key=lambda r: (r[0], r[2])) == want  # ranges of lags find the same


@pytest.mark.parametrize("lags", [1 << 18, 7])
def test_periodic_runs(spark, docs, rows, lags):
    """In one piece, and with texts dealt as ranges of 7 lags."""
    found = periodic.find_runs(docs, lags=lags).collect()
    assert len(found) == len(rows) + 2
    want = {**{i: t for i, t in rows}, None: "na ba " * 9}
    for r in found:
        w = SPLIT.findall(want[r.doc_id] or "")
        runs = brute_runs(w)
        assert r.n_words == len(w) and [(x.start, x.length, x.period) for x in r.runs] == runs
        assert r.collapsed == brute_collapsed(w, runs)
    if lags > 7:
        assert periodic.find_runs(docs.where("false")).count() == 0
        with pytest.raises(ValueError):
            periodic.find_runs(docs, exponent=1)


def test_a_very_long_text_of_runs(spark):
    text = "a b c " * 60_000 + "x " * 150_000 + "end"
    r = periodic.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), lags=1 << 14).first()
    assert [(x.start, x.length, x.period) for x in r.runs] == [(0, 180_000, 3), (180_000, 150_000, 1)] and r.collapsed == "a b c x end"


def test_repeated_tails():
    for own in [*range(200), None]:
        words = [b"%d" % i for i in range(own or 5)]
        h = zlib.crc32(str(own).encode())
        want = list(words)
        if own is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert periodic.repeated_tail(own, words) == want


def test_periodic_digests(spark, tmp_path):
    rows = [(i, " ".join(f"w{k % 9}" for k in range(i))) for i in range(0, 90, 3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect():
        w = [x.decode() for x in periodic.repeated_tail(r.doc_id, dict(rows)[r.doc_id].encode().split())]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()


# 12


def shingles(text, k=3):
    w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_components(items, percent=85):
    """items: (name, least id or None, set)."""
    root = {n: n for n, _, _ in items}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, (a, ia, x) in enumerate(items):
        for b, ib, y in items[:i]:
            if ia is not None and ib is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(a)] = top(b)
    least = {}
    for n, i, _ in items:
        if i is not None:
            least[top(n)] = min(least.get(top(n), i), i)
    return {n: least.get(top(n)) if i is not None else None for n, i, _ in items}


def test_minhash_components(spark, docs, rows):
    found = minhash.near_duplicates(docs).collect()
    want = brute_components([(i, i, shingles(t)) for i, t in rows])
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(shingles(dict(rows)[r.doc_id])), want[r.doc_id])
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_minhash_on_a_cloud_of_near_copies(spark, monkeypatch):
    """Copies of a template with edits around the threshold, in buckets cut to blocks of 16."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > rng.choice([0.0, 0.02, 0.05]) else f"e{rng.randrange(999)}" for w in base) for _ in range(90)]
    texts += [" ".join(f"{k}x{i}" for i in range(4)) for k in range(5)] + ["a b", "A  b", "", None]
    items = list(enumerate(texts))
    want = brute_components([(i, i, shingles(t)) for i, t in items])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(items, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and len(set(want.values())) > 8


def test_one_id_on_unlike_texts(spark):
    """A node for each text: the id joins nothing by itself."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (3, b), (3, b), (9, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(3, 3), (3, 3), (5, 3), (5, 5), (9, 5)]


def test_signatures():
    """Slots agree as often as sets do, with less variance than independent hashes have; equal sets have equal signatures."""
    rng = np.random.default_rng(0)
    for n in (4, 40, 400):
        same = []
        for _ in range(120):
            x = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[: n * 3 // 4], rng.integers(1, 1 << 63, n - n * 3 // 4, dtype=np.uint64)])
            sig = minhash.signatures(np.concatenate([x, y, rng.permutation(x)]), np.array([0, n, 2 * n, 3 * n]))
            assert (sig[0] == sig[2]).all() and (sig < np.iinfo(np.uint64).max).all()
            same.append((sig[0] == sig[1]).mean())
        j = (n * 3 // 4) / (2 * n - n * 3 // 4)
        assert np.mean(same) == pytest.approx(j, abs=0.02) and np.std(same) < 1.1 * (j * (1 - j) / minhash.SLOTS) ** 0.5
    assert not len(minhash.signatures(np.zeros(0, np.uint64), np.array([0])))
    once = minhash.signatures(np.array([5], np.uint64), np.array([0, 0, 1]))
    assert (once[0] == np.iinfo(np.uint64).max).all() and len(set((once[1] >> np.uint64(32)).tolist())) == minhash.SLOTS  # one element fills every slot, each in another step


def test_buckets_are_held_against_representatives(spark):
    """2,000 members of one bucket that are all alike cost their number, not their pairs."""
    n = 2000
    members = spark.range(n).select((F.col("id") % 3).alias("bucket"), F.col("id").alias("node")).unionAll(spark.range(n).select(F.lit(9).cast("long"), "id"))
    kept = simhash.distinct_buckets(members)
    assert kept.select("bucket").distinct().count() == 4
    pairs = simhash.representatives(simhash.unlike(kept, None), 0)
    assert pairs.count() <= 2 * n
    roots = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
    assert simhash.representatives(simhash.unlike(kept, roots), 1).count() == 0
    rest = simhash.unlike(kept, roots.where("node < 1990")).withColumn("count", F.lit(n).cast("long")).where("bucket = 9")
    cells = simhash.cells(rest.select("bucket", "count", "node", "root"))
    assert cells.count() <= 3 * n  # ten rows left unjoined meet the others once


# 13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def brute_manifest(rows, fanout):
    """[(id, leaf, subroot, root, proof, tampered leaf)] of rows (doc_id, text, lang, source, n_chars)."""

    def climb(nodes, at):
        proof = []
        while len(nodes) > 1:
            run = nodes[at // fanout * fanout : (at // fanout + 1) * fanout]
            proof += [x for k, x in enumerate(run) if k != at % fanout]
            nodes, at = [H(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)], at // fanout
        return nodes[0], proof

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    subs = [climb([x[2] for x in groups[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        root, above = climb(subs, k)
        for i, (_, _, leaf, r) in enumerate(groups[s]):
            below = climb([x[2] for x in groups[s]], i)[1]
            out.append((r[0], leaf, subs[k], root, "".join(below + above)))
    return out


@pytest.mark.parametrize("fanout", [16, 2])
def test_manifest(spark, docs, fanout):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    changed = F.when(F.col("doc_id") % 2 == 0, F.upper("text"))
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], group="source", altered={"text": changed}, fanout=fanout).collect()
    got = Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in found)
    assert got == Counter(brute_manifest(rows, fanout))
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        same = r.doc_id is None or r.doc_id % 2 or texts[r.doc_id] is None or texts[r.doc_id].upper() == texts[r.doc_id]
        assert r.verified == bool(same) == (r.folded_root == r.root)


def test_manifest_of_few(spark):
    one = spark.createDataFrame([(7, "t", "en", "s", 1)], DOC)
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    r = merkle.manifest(one, fields, group="source").first()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf_of((7, "t", "en", "s", 1), "t") and r.proof == "" and r.verified
    assert merkle.manifest(one.where("false"), fields, group="source").count() == 0


def test_tampering_is_seen(spark, tmp_path):
    rows = [(i, "Some TEXT" if i % 2 else "small", None, ["é", "z", None, "Z"][i % 4], i) for i in range(300)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_merkle(spark, str(tmp_path)).collect()
    want = {r[0]: r for r in brute_manifest(rows, 16)}
    for r in found:
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (*want[r.doc_id][1:4], hashlib.sha256(want[r.doc_id][4].encode()).hexdigest())
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id % 2))


# 6, 7 and 9: hot and long inputs


def labelled_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(len(texts))], pa.int32()), pa.array([i % 4 for i in range(len(texts))], pa.int32()), pa.array(range(len(texts)), pa.int64())], ["text", "label", "fold", "rank"])


def test_long_labelled_texts_are_fitted_by_all_features():
    text = " ".join(f"w{i}" for i in range(30_000))
    row = next(quality._rows_of_features([labelled_batch([text])])).to_pylist()[0]
    slots = np.frombuffer(row["slots"], "<i4")
    assert all((slots // quality.SLOTS == k).sum() > 8_192 for k in (0, 1))
    data = np.frombuffer(text.encode(), np.uint8)
    off = np.array([0, len(data)])
    first = next(iter(quality.features(data, off, quality.chunk_words(data, off))))[0]
    assert set(slots[slots < quality.SLOTS].tolist()) == set(first.tolist())  # the slots that scoring reads


def test_fit_in_bounded_parts(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["good", "fine", "dull", "spam"][i % 2 :: 2]) + str(rng.randrange(9)) for _ in range(40)) for i in range(60)]
    rows = [r for b in quality._rows_of_features([labelled_batch(texts)]) for r in b.to_pylist()]
    whole = quality.solve(list(rows))
    monkeypatch.setattr(quality, "UNPACKED", 500)
    parts = quality.solve(list(rows))
    assert np.abs(whole.weights - parts.weights).max() <= 2 and parts.bias == pytest.approx(whole.bias) and (parts.slope, parts.shift) == pytest.approx((whole.slope, whole.shift), rel=1e-4)


def test_items_of_the_same_documents_are_one(spark):
    posts = spark.createDataFrame([(r, i) for i in range(50) for r in range(3)] + [(r, 99) for r in range(2)] + [(r, 70 + r) for r in range(3)], "row long, item long")
    got = {r.item: (r.same, r.n) for r in pii.alike(posts, "item").collect()}
    assert all(got[i] == (0, 3) for i in range(50)) and got[99] == (99, 2) and [got[70 + r] for r in range(3)] == [(70 + r, 1) for r in range(3)]


def test_a_copied_directory_page(spark):
    """Entities and terms that stand in the same documents: all are marked, and one pair is counted."""
    page = " ".join(f"u{i}@h{i}.example.org name{i}x" for i in range(300))
    rows = [(i, page) for i in range(3)] + [(10 + i, f"plain words number {i} of no one") for i in range(20)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(len(found[i].terms) == 300 and found[i].n_email == 300 for i in range(3)) and not any(found[10 + i].terms for i in range(20))
