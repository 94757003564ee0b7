"""Each corpus operator against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from panelkiln.llm import bpe, common, fmindex, graph, packing, pii, quality, queries, simhash, substrings, suffixes, tokens, topk, urls

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pry", "é", "straße", "x") for b in ("n", "sto", "vel", "qua", "dé", "ring")]
DOC = "doc_id long, text string, lang string, source string, n_chars long"
P = public_tokenizers.path


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=0):
    """(id, text): prose, copies, near copies, shared passages, odd texts."""
    rng = random.Random(seed)
    shared = prose(rng, 70)
    line = "Licensed under the terms of a licence, version 2.0 of a year.\n"
    texts = [prose(rng, rng.randint(1, 160)) for _ in range(30)]
    texts += [f"{prose(rng, 20)} {shared} {prose(rng, 20)}" for _ in range(4)]
    texts += [texts[3], texts[3], shared + "\n" + shared]
    texts += [re.sub(r"\S+", lambda m: m[0] if rng.random() > 0.02 else "edit", texts[5]) for _ in range(4)]
    texts += [line + prose(rng, 12) + "\n" + line + prose(rng, 9) for _ in range(5)]
    texts += ["", " \n\t ", None, "a", "a b", "aaaa" * 90, ("na " * 300).strip(), "Ünï  çödé\u00a0\u2003 x\r\n\x0b y\x1c z 中文字 🙂🙂 \u0378 don't we'll I'M 12345", "A, B | C | D # $ % & < > * " * 9]
    texts += ["<|endoftext|> and <|startoftext|>x<|endoftext|>", "mail jo.do@a-b.example.com, ++1 (555) 010-9999 ok 10.1.2.3 999.1.1.1 1.2.3.4.5 4111 1111 1111 1111 4111111111111112 +12-34"]
    texts.append(" ".join(prose(rng, 400) for _ in range(12)))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With clashing and further columns, and one row twice."""
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None, "x", 1, 2.0) for i, t in rows]
    return spark.createDataFrame([*out, out[5]], DOC + ", fp string, n_tokens int, bucket double").repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1


def test_token_counts(spark, docs, none, rows):
    from tokenizers import Tokenizer

    path = P("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = tokens.count_tokens(docs, tokenizer_path=path, max_tokens=100)
    assert got.count() == len(rows) + 1
    got = by_id(got)
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
    assert tokens.count_tokens(none, tokenizer_path=path).count() == 0


def test_token_counts_over_code_points():
    from tokenizers import Tokenizer

    path = P("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.Counter2(common.file_bytes(path), None)
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x600, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30))
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids)


# 2


def reference_codec(name):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(common.file_bytes(P(name))), special_tokens={})


def test_byte_bpe(spark, docs, none, rows):
    args = {"ranks_path": P("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    library = reference_codec("byte_bpe_multi_50k.tiktoken")
    got, ids = by_id(bpe.round_trip(docs, **args)), by_id(bpe.encode(docs, **args))
    back = by_id(bpe.decode(bpe.encode(docs, **args), **args))
    for i, t in rows:
        want = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(ids[i].ids) == want and bytes(back[i].data) == (t or "").encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(none, **args).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(1000)]
    own = bpe.PerfectHash(keys)
    assert sorted(own.key_at) == list(range(1000))
    codec = bpe.Codec({k: i for i, k in enumerate(keys)}, own.shift, own.key_at, ".+")
    assert all(codec.whole(k) == i.to_bytes(4, "little") for i, k in enumerate(keys)) and codec.whole(b"no") is None


def test_merges_of_random_bytes():
    codec, library = bpe.codec(common.file_bytes(P("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN), reference_codec("byte_bpe_50k.tiktoken")
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice("abcdeorst ngé.\n") for _ in range(rng.randint(0, 200)))
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == library.encode_ordinary(t)


# 3


def brute_top(vectors, k):
    out = []
    for a, x in vectors.items():
        if a % 50 == 0:
            best = sorted((-int(np.dot(x, y)), b) for b, y in vectors.items() if b != a)[:k]
            out += [(a, r, b, -s) for r, (s, b) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("n, scale", [(1, 1), (4, 1), (300, 1), (300, 3e5), (900, 1)])
def test_top_k(spark, monkeypatch, n, scale):
    """Several turns, blocks and chunks; scores that floating point can't hold; ties; clustered vectors."""
    monkeypatch.setattr(topk, "ROWS", 16), monkeypatch.setattr(topk, "QUERIES", 3), monkeypatch.setattr(topk, "TURN_BYTES", 300), monkeypatch.setattr(topk, "FIRST", 4)
    rng = np.random.default_rng(n)
    x = np.float32(rng.normal(size=(n, 7)) * scale)
    if n == 900:
        x = np.float32(rng.normal(size=(9, 7))[rng.integers(0, 9, n)] * 3 + x * 0.05)
    x[n // 2 :] = np.round(x[n // 2 :])  # ties
    data = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(50_000, None, 1), (50_050, [1.0, None], 1), (50_100, [float("nan")] * 7, 1), (None, [1.0] * 7, 1), data[0]]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df).collect())
    assert got == brute_top({i: np.floor(np.float64(np.float32(v)) * 256).astype(int) for i, v, _ in data}, 5)


def test_blocks_are_skipped():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-9, 9, (20, 6)), rng.integers(0, 90, (50, 6))
    assert (topk.bound(q, x) >= (q @ x.T).max(1)).all() and (topk.bound(-np.abs(q), x) < 1).all()
    got = topk.best_of_block(np.arange(20), q, np.arange(100, 150), x, 3, np.full(20, -np.inf))
    cut = np.full(20, 10.0**6)
    assert len(got[0]) == 60 and not len(topk.best_of_block(np.arange(20), q, np.arange(100, 150), x, 3, cut)[0])


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert topk.search(df).count() == 0


# 4


def test_url_rules(spark):
    cases = {
        "http://A.Example.ORG/en/7": ("a.example.org", "/en/7", "org/", "allow"),
        "x://example.org/en/12?q": ("example.org", "/en/12", "example.org/en/1", "block"),
        "x://b.example.org/es/#t": ("b.example.org", "/es/", "example.org/es/", "block"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://org": ("org", "", None, None),
        "x://q.com/fr/a?b://c": ("q.com", "/fr/a", "com/fr/", "allow"),
        "x://q.com/de/\n/y": ("q.com", "/de/\n/y", "com/de/", "block"),
        "q.com/de/": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule) == want[:3]
        assert got[i].verdict == want[3] if want[3] else got[i].verdict in ("allow", "block")
    assert urls.filter_urls(df.where("false")).count() == 0


def test_url_model(spark):
    """Hosts of rejected pages look unlike those of accepted ones; pages no rule fits are told apart by that."""
    rng = random.Random(4)
    name = {"good": lambda: "".join(rng.choice("aeiou") + rng.choice("lmnr") for _ in range(4)), "bad": lambda: "".join(rng.choice("qxzjkwvh") for _ in range(9))}
    data = [(i, f"http://{name[k]()}.com/{'fr' if k == 'good' else 'de'}/{i}", k) for i in range(600) for k in ("good", "bad")]
    data += [(10_000 + i, f"http://{name[k]()}.net/{i}", k) for i in range(100) for k in ("good", "bad")]
    data = [(i, u, k) for i, (_, u, k) in enumerate(data)]
    df = spark.createDataFrame([(i, u) for i, u, _ in data], "page_id long, url string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    right = [(got[i].verdict == "allow") == (k == "good") for i, u, k in data if ".net/" in u]
    assert np.mean(right) > 0.95


def test_url_ratio_by_hand():
    sums = np.zeros((4, urls.SLOTS))
    model = urls.Model(sums)
    data = np.frombuffer(b"abab", np.uint8)
    assert model.ratios(data, np.array([0, 4])).tolist() == [0.0]
    slots = [(c.copy(), b.copy()) for c, b, _ in urls.grams(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))]
    sums[0, slots[0][0][0]], sums[1, slots[0][1][0]] = 10, 10  # order 0: ten times a, in the accepted model
    p = (10 + 4 / 256) / 14, (4 / 256) / 14
    assert urls.Model(sums).ratios(np.frombuffer(b"a", np.uint8), np.array([0, 1]))[0] == pytest.approx(np.log(p[0] * 256), abs=1e-6)


def test_url_counts_are_exact(spark):
    """Far more contexts than any fixed table of slots would hold: ratios as from dictionaries of all of them."""
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(60))
    data = [(i, f"{name()}.com", f"/{'fr' if i % 2 else 'de'}/{i}" if i < 3600 else f"/{i}") for i in range(4000)]
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in data], "page_id long, url string")
    got = by_id(urls.filter_urls(df.select(urls.F.col("page_id"), "url")).withColumnRenamed("page_id", "doc_id"))
    held = {r.page_id for r in spark.createDataFrame(data, "page_id long, host string, path string").where("pmod(xxhash64(host, path), 5) = 0").collect()}
    counts = [Counter(), Counter()]
    for i, h, p in data[:3600]:
        site = h + p
        if i not in held:
            for j in range(len(site)):
                for k in range(min(j, urls.ORDER) + 1):
                    counts[1 - i % 2].update([site[j - k : j], (site[j - k : j], site[j])])
    assert sum(isinstance(k, str) for k in counts[0]) > urls.SLOTS // 2
    for i, h, p in data[::40] + data[3600::9]:
        site, total = h + p, 0.0
        for j in range(len(site)):
            est = [1 / 256, 1 / 256]
            for k in range(min(j, urls.ORDER) + 1):
                c = site[j - k : j]
                est = [(n[c, site[j]] + urls.STRENGTH * e) / (n[c] + urls.STRENGTH) for n, e in zip(counts, est, strict=True)]
            total += np.log(est[0] / est[1])
        assert got[i].ratio == pytest.approx(total / len(site), abs=1e-6)


def test_what_urls_ask_for_is_not_broadcast(spark):
    """The keys that chunks ask for are many times the URLs' files, whose size Spark goes by: no table may go through the driver, however small it seems."""
    df = spark.createDataFrame([(i, f"http://h{i % 7}.com/{'fr' if i % 2 else 'de'}/{i}") for i in range(60)], "page_id long, url string")
    plans, settle = [], urls.common.settle
    with pytest.MonkeyPatch.context() as m:
        m.setattr(urls.common, "settle", lambda rows, name: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or settle(rows, name))
        assert urls.score(df.select("page_id", urls.host_of(urls.F.col("url")).alias("host"), urls.path_of(urls.F.col("url")).alias("path"), urls.F.lit("r").alias("rule"), urls.F.lit("allow").alias("ruled"))).count() == 60
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in plans[-1]


def test_repeated_urls_are_all_held_out_or_none(spark):
    kinds = [("net.com", "/fr/a"), ("xq.com", "/de/b")] + [(f"h{i}.com", f"/{'fr' if i % 2 else 'de'}/{i}") for i in range(40)]
    rows = [(i, *kinds[i % len(kinds)], "allow" if "/fr/" in kinds[i % len(kinds)][1] else "block") for i in range(420)]
    df = spark.createDataFrame([(i, h, p, p[:4], v) for i, h, p, v in rows], "page_id long, host string, path string, rule string, ruled string")
    sides = {}
    for r in urls.score(df).collect():
        sides.setdefault((r.host, r.path), set()).add(r.held)
    assert len(sides) == len(kinds) and all(len(s) == 1 for s in sides.values())
    assert 0 < sum(s == {True} for s in sides.values()) < len(kinds)


# 5 and 8


def brute_bytes(rows, size=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - size + 1):
            if t[s : s + size] in seen:
                gone[s : s + size] = True
            seen.add(t[s : s + size])
        out[i] = (len(t), int(gone.sum()), len(re.findall(b"\1+", gone.tobytes())), bytes(c for c, g in zip(t, gone) if not g))
    return out


def brute_words(rows, size=50):
    first, split = {}, {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i, w in sorted(split.items()):
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), i)
    out = {}
    for i, w in split.items():
        gone = {p for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < i for p in range(s, s + size)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone).encode())
    return out


def removed(spans):
    return sum(s.end - s.start for s in spans)


@pytest.mark.parametrize("spread", [1, 32])
def test_suffix_dedup(spark, docs, none, rows, monkeypatch, spread):
    monkeypatch.setattr(substrings, "SPREAD", spread), monkeypatch.setattr(common, "CHUNK_BYTES", 3000)
    found = suffixes.remove_repeated_bytes(docs)
    assert found.count() == len(rows) + 1
    got = by_id(found)
    for i, want in brute_bytes(rows).items():
        assert (got[i].n, removed(got[i].spans), len(got[i].spans), bytes(got[i].kept)) == want, i
    assert suffixes.remove_repeated_bytes(none).count() == 0


def test_digits_order_suffixes():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    at = np.arange(0, len(data) - 29)
    live, group = suffixes.ordered(data, at, 30)
    raw, by = data.tobytes(), defaultdict(list)
    for p in at:
        by[raw[p : p + 30]].append(p)
    assert sorted(map(sorted, (live[group == g].tolist() for g in set(group.tolist())))) == sorted(v for v in by.values() if len(v) > 1)


def test_cut_keeps_rows_and_columns(spark, docs, rows):
    docs = docs.withColumnsRenamed({"fp": "cut", "bucket": "doc"})
    cut = suffixes.cut_repeated_bytes(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows) + 1
    got, want = by_id(cut), brute_bytes(rows)
    for i, t in rows:
        assert got[i].text == (None if t is None else want[i][3].decode(errors="ignore"))


@pytest.mark.parametrize("most, spread", [(0, 32), (4096, 1), (4096, 32)])
def test_substring_dedup(spark, docs, none, rows, monkeypatch, most, spread):
    monkeypatch.setattr(substrings, "SPREAD", spread)
    found = fmindex.remove_repeated_words(docs, most=most)
    assert found.count() == len(rows) + 1
    got = by_id(found)
    for i, want in brute_words(rows).items():
        assert (got[i].n, removed(got[i].spans), bytes(got[i].kept)) == want, i
    if most and spread > 1:
        assert fmindex.remove_repeated_words(none).count() == 0


@pytest.mark.parametrize("most", [0, 4096])
def test_the_index_decides(spark, docs, rows, monkeypatch, most):
    """Without what the backward search and the last digits find, passages shared in part stay, however windows are dealt."""
    nothing = lambda doc, lo, size, x, kind: (doc[:0], lo[:0])
    for kind, brute in ((substrings.WORDS, brute_words), (substrings.BYTES, brute_bytes)):
        got = by_id(substrings.remove_repeats(docs, kind, nothing, key="doc_id", text="text", most=most))
        want = brute(rows)
        assert sum(removed(r.spans) for r in got.values()) < sum(w[1] for w in want.values())


def test_spans_of_one_id_on_several_texts(spark):
    """What is found in one text of an id isn't cut from another."""
    rng = random.Random(20)
    a, b = prose(rng, 80), prose(rng, 80)
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (None, b[:50])], "doc_id long, text string")
    for found in (suffixes.remove_repeated_bytes(df), fmindex.remove_repeated_words(df)):
        got = Counter((r.doc_id, bytes(r.kept).decode()) for r in found.collect())
        assert got == {(1, a): 1, (2, ""): 1, (2, b): 2, (None, b[:50]): 1}
    got = Counter((r.doc_id, r.text) for r in suffixes.cut_repeated_bytes(df).collect())
    assert got == {(1, a): 1, (2, ""): 1, (2, b): 2, (None, b[:50]): 1}


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 4, 120), 0) for _ in range(5)])
    text[300:340] = text[10:50]
    index = fmindex.Index(text, 4, 6)
    s = "".join(map(str, text))
    suffixes_ = sorted(range(len(s)), key=lambda i: s[i:])
    assert index.locate(np.arange(1, index.n)).tolist() == suffixes_ and index.locate(np.array([0])).tolist() == [len(s)]
    for _ in range(200):
        at = int(rng.integers(0, len(text) - 6))
        pattern = text[at : at + 6]
        if (pattern == 0).any():
            continue
        a, z = np.array([0]), np.array([index.n])
        for c in pattern[::-1]:
            a, z = index.back(np.array([c]), a, z)
        assert z[0] - a[0] == len(re.findall(f"(?={''.join(map(str, pattern))})", s))
        a, z = index.shorter(a)
        assert z[0] - a[0] == len(re.findall(f"(?={''.join(map(str, pattern[:-1]))})", s))


def test_fm_index_sorts_copies_once(monkeypatch):
    """What an index sorts doesn't grow with the length of copied passages, only with that of its parts; the order stays that of whole suffixes."""
    rng = np.random.default_rng(4)
    text = np.tile(np.concatenate([np.append(rng.integers(1, 200, 40), 0) for _ in range(60)]), 2)
    handled, unique, argsort = [], np.unique, np.argsort
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (handled.append(len(x)), unique(x, *a, **k))[1])
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (handled.append(len(x)), argsort(x, *a, **k))[1])
    index = fmindex.Index(text, 200, 50)
    assert sum(handled) < 8 * len(text)
    s = text.tolist()
    assert index.locate(np.arange(1, index.n)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_packed_columns():
    rng = np.random.default_rng(0)
    cols = [rng.integers(-(1 << 62), 1 << 62, 50), np.arange(50), np.full(50, -5)]
    got, raw = substrings.unpack(substrings.pack(cols, b"tail"), 3)
    assert all((a == b).all() for a, b in zip(cols, got)) and bytes(raw) == b"tail"


# 6


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {p for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(cover)


def test_quality_base_counts(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, 1, None) for i, _ in rows], "doc_id long, quality int, toxic int")
    found = quality.judge(docs, labels)
    assert found.count() == len(rows) + 1
    got = by_id(found)
    for i, t in rows:
        want, r = brute_quality(t), got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)  # labels of one kind: only the counted rules reject
    assert quality.judge(none, labels).count() == 0


def test_features_are_of_whole_characters():
    texts = ["é中文字🙂ab", "ab", "éé中🙂", ""]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    slot, a, b = list(quality.features(data, off, quality.chunk_words(data, off)))[2]
    by, seen = {}, set()
    for t, lo, hi in zip(texts, a, b, strict=True):
        runs = [t[i : i + 4] for i in range(len(t) - 3)]
        assert hi - lo == len(runs)
        for r, s in zip(runs, slot[lo:hi], strict=True):
            assert by.setdefault(r, s) == s
            seen.add(s)
    assert len(seen) == len(by)


def test_labels_of_repeated_ids(spark):
    """An id with several texts, and labels repeated, fit once; any column name passes through."""
    rng = random.Random(22)
    data = [(i % 100, prose(rng, 30) if i % 2 else "$$ %% " * 30) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, whole int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] * 2, "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {1}
    r = quality.measure(quality.judge(docs.dropDuplicates(["doc_id"]), labels), labels).first()
    assert r.kept_good > 5 and r.lost_bad > 5 and r.kept_bad == r.lost_good == 0


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    junk = lambda: " | ".join(rng.choice(WORDS) + rng.choice(["$$$", "%%%", "&&&"]) for _ in range(60))
    data = [(i, prose(rng, 60) if i % 3 else junk(), int(i % 3 > 0)) for i in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data if i < 250], "doc_id long, quality int")
    got = by_id(quality.judge(docs, labels))
    assert np.mean([got[i].kept == bool(q) for i, _, q in data if i >= 250]) > 0.98
    kept = {r.doc_id for r in quality.keep_good(docs.withColumn("kept", docs.doc_id), labels).collect()}
    assert kept == {i for i, r in got.items() if r.kept}


# 7


def brute_fingerprint(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def union(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, none, rows):
    found = simhash.near_duplicates(docs)
    assert found.count() == len(rows) + 1
    got = by_id(found)
    fp = {i: brute_fingerprint(t) for i, t in rows}
    roots = union(fp, ((a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3))
    for i in fp:
        assert (got[i].fp & (1 << 64) - 1, got[i].component_id) == (fp[i], roots[i]), i
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("split, block", [(2, 1024), (2, 3), (2048, 4)])
def test_links_between_random_fingerprints(spark, monkeypatch, split, block):
    """Clusters of fingerprints a few bits apart, with chains across them; buckets that are cut again, and cut to blocks."""
    monkeypatch.setattr(simhash, "SPLIT", split), monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    fps = []
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.append(x)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
    fps = sorted(set(fps))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    want = union(range(len(fps)), ((a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3))
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert graph.components(df.where("false")).count() == 0


def brute_similar(rows, k=5, least=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1)))
    return union(sets, ((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])))


def test_similar_and_keep_one(spark, docs, none, rows):
    found = simhash.similar(docs)
    got, want = by_id(found), brute_similar(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.keep_one(docs, found)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)
    assert simhash.similar(none).count() == 0


def variants(rng, n, share, tag):
    """Two texts of n words of which a run of the second is new, so that their sets differ in about that share."""
    a = [f"{tag}{rng.randint(0, 10**9)}" for _ in range(n)]
    cut = int(n * share)
    return " ".join(a), " ".join(a[: n - cut] + [f"n{tag}{rng.randint(0, 10**9)}" for _ in range(cut)])


def test_similar_is_exact_at_the_threshold(spark, monkeypatch):
    """Pairs on either side of 0.8, from single words to texts of thousands of shingles, all with a common line; small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 2)
    rng = random.Random(15)
    line, rows = "licensed under the terms of a licence version two of some year ", []
    for k in range(90):
        n = rng.choice([6, 9, 20, 60, 150, 600, 1500, 4000] if k % 9 == 0 else [6, 9, 20, 60, 150])
        for t in variants(rng, n, rng.uniform(0.05, 0.16), f"k{k}x"):
            rows.append((len(rows), line * (k % 2) + t))
    rows += [(1000 + i, line + f"u{i} v{i}") for i in range(40)] + [(2000 + i, line * 2 + f"w{i}") for i in range(12)]
    got = by_id(simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    want = brute_similar(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert 10 < sum(want[2 * k] == want[2 * k + 1] for k in range(90)) < 80


def test_similar_without_bands(spark, monkeypatch):
    """The prefixes alone find every link: bands that never meet change nothing."""
    monkeypatch.setattr(simhash, "BANDS", 1), monkeypatch.setattr(simhash, "MINIMA", 60)
    rng = random.Random(16)
    rows = [(2 * k + i, t) for k in range(40) for i, t in enumerate(variants(rng, 120, rng.uniform(0.02, 0.14), f"k{k}x"))]
    got = by_id(simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == brute_similar(rows)


def test_one_id_on_several_texts(spark):
    """Each text of an id has its own links; columns may have any name."""
    rng = random.Random(17)
    a, b, c = prose(rng, 60), prose(rng, 300), prose(rng, 80)
    rows = [(5, a), (5, b), (9, b + " end"), (12, c), (12, c), (12, a), (3, a + " end"), (None, c), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, own int, hashed int, n int")
    found = simhash.similar(df)
    by = Counter((r.doc_id, r.component_id) for r in found.collect())
    assert by == {(5, 3): 1, (5, 5): 1, (9, 5): 1, (12, 12): 2, (12, 3): 1, (3, 3): 1, (None, None): 2}
    kept = simhash.keep_one(df, found)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a + " end"), (5, b), (12, c), (None, c), (None, None)])


def test_similar_whatever_is_repeated(spark):
    """Copies that differ only in how often a line is repeated: fingerprints of all shingles would differ in over 24 bits for a third."""
    rng = random.Random(14)
    rows = []
    for i in range(40):
        body, line = (" ".join(f"{c}{i}x{rng.randint(0, 10**9)}" for _ in range(n)) for c, n in (("b", 400), ("l", 10)))
        rows += [(2 * i, f"{body} {line}"), (2 * i + 1, f"{body} " + f"{line} " * 30)]
    got = by_id(simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == brute_similar(rows) == {i: i - i % 2 for i, _ in rows}


# 9

RAW = {"email": pii.EMAIL, "ip": pii.IP, "card": pii.CARD, "phone": pii.PHONE}


def brute_spans(t):
    found = []
    for k, (kind, pattern) in enumerate(RAW.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


def test_base_spans(spark, docs, none, rows):
    found = pii.find(docs)
    assert found.count() == len(rows) + 1
    got = by_id(found)
    for i, t in rows:
        want = brute_spans(t)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in want) for k in RAW)
    assert sum(r.n_email for r in got.values()) == 1 and pii.find(none).count() == 0


def test_emails_as_the_pattern_finds_them():
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-_ é+") for _ in range(rng.randint(0, 25)))
        assert [(a, b) for a, b, _ in pii.emails(t)] == [m.span() for m in re.finditer(pii.EMAIL, t)]


def test_disclosing_terms(spark):
    rng = random.Random(10)
    filler = lambda n: " ".join(f"w{rng.randint(0, 40):02d}q" for _ in range(n))
    data = [(i, f"{filler(30)} Zorblatt wrote from zed@x.example.com {filler(30)}") for i in range(5)] + [(100 + i, filler(60)) for i in range(60)]
    data += [(200, "Zorblatt alone " + filler(20)), (201, None), (202, "")]
    df = spark.createDataFrame([(i, t, "u") for i, t in data], "doc_id long, text string, terms string")
    got = by_id(pii.find(df).select("doc_id", pii.span_string(pii.F.col("base"), pii.F.col("terms")).alias("spans")))
    for i, t in data[:5]:
        a, b = t.index("Zorblatt"), t.index("zed@")
        assert f"term:{a}:{a + 8}" in got[i].spans.split(",") and f"email:{b}:{b + 17}" in got[i].spans.split(",")
        assert all(t[int(x.split(":")[1]) : int(x.split(":")[2])] in ("Zorblatt", "wrote", "from") for x in got[i].spans.split(",") if x.startswith("term"))
    assert all(got[i].spans == "" for i in (*range(100, 160), 200, 201, 202))
    clean = by_id(pii.redact(df))
    assert "[TERM]" in clean[0].text and "[EMAIL]" in clean[0].text and "zed@" not in clean[0].text
    assert clean[100].text == dict(data)[100] and clean[201].text is None and clean[200].text == dict(data)[200]
    assert pii.redact(df).columns == df.columns


def test_disclosing_terms_anywhere_in_the_document(spark):
    """A name far from the address is a candidate, every place of it is marked, and counts take whole documents."""
    rng = random.Random(13)
    filler = lambda n: " ".join(f"w{rng.randint(0, 40):02d}q" for _ in range(n))
    data = [(i, f"Quimby, {filler(20)} Quimby {filler(30)} q.m@x.example.com {filler(25)} (quimby)") for i in range(4)] + [(100 + i, filler(60)) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = by_id(pii.find(df))
    for i, t in data[:4]:
        assert [(s.start, s.end) for s in got[i].terms] == [m.span() for m in re.finditer("(?i)quimby", t)]
    assert all(not got[i].terms for i, _ in data[4:])
    assert not any("quimby" in r.text.lower() for r in pii.redact(df).collect())


def test_disclosing_terms_split_as_counted(spark):
    """A word with a no-break space in it is one term, as a candidate and in the corpus count."""
    data = [(i, f"Jean\u00a0Quimby q.m@x.example.com n{i}") for i in range(4)] + [(100 + i, f"other words {i}") for i in range(60)]
    got = by_id(pii.find(spark.createDataFrame(data, "doc_id long, text string")))
    assert all([(s.start, s.end) for s in got[i].terms] == [(0, 11)] for i in range(4))


def test_a_text_of_many_addresses(spark):
    """Work grows with the text, not with the square of its spans."""
    import time

    t = " ".join(f"u{i}@x{i % 50}.example.com said{i % 9}" for i in range(100_000))
    df = spark.createDataFrame([(1, t, 5, 6)], "doc_id long, text string, base int, terms int")
    start = time.time()
    spans = pii.base_spans(t)
    assert len(spans) == 100_000 and sum(1 for _ in pii.words_of(t, spans)) == 100_000
    clean = pii.generalised(t, [{"start": a, "kind": k, "end": z} for a, k, z, _ in spans], [])
    assert time.time() - start < 5 and clean == " ".join(f"[EMAIL] said{i % 9}" for i in range(100_000))
    got = pii.redact(df)
    assert got.columns == df.columns and got.first().text == clean


# 10


def pack_args():
    return {"tokenizer_path": P("byte_bpe_50k.json"), "ranks_path": P("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@pytest.mark.parametrize("shares, temper", [(None, 1.0), (None, 0.5), ({"s0": 5, "s1": 1}, 1.0)])
def test_packing(spark, docs, none, rows, shares, temper):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P("byte_bpe_50k.json"))
    want = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in rows}
    got = packing.pack(docs, **pack_args(), length=64, window=640, shares=shares, temper=temper, keep_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r), sequences[r.sequence_id].append((r.offset, r.length, r.pad))
    assert pieces.keys() == want.keys()
    twice = [i for i, own in pieces.items() if sum(r.length for r in own) > len(want[i])]
    assert twice == [rows[5][0]]  # the repeated row is packed twice
    for i, own in pieces.items():
        if i not in twice:
            own.sort(key=lambda r: r.start)
            assert np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in own]).tolist() == want[i].tolist()
            assert len(own) <= 2 + len(want[i]) // 64  # cut at the ends of sequences only
        assert all(r.ids_crc32 == zlib.crc32(want[i][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[i]) for r in own)
    fill = []
    for _, parts in sorted(sequences.items()):
        end = 0
        for o, n, _ in sorted(parts):
            assert o == end
            end = o + n
        fill.append(end)
    assert sorted(sequences) == list(range(len(fill))) and all(n == 64 for n in fill[:-1]) and 0 < fill[-1] <= 64
    last = {p for _, _, p in sequences[len(fill) - 1]}
    assert last == {0 if fill[-1] & (fill[-1] - 1) == 0 else 64 - fill[-1]} and all(p == 0 for k in range(len(fill) - 1) for _, _, p in sequences[k])
    assert packing.pack(none, **pack_args()).count() == 0


def queued(spark, sizes):
    """Encoded rows of queues in parts, as encode_queues() gives them."""
    rows = []
    for q, own in sizes.items():
        ends = Counter()
        for i, n in enumerate(own):
            rows.append((i % 3, q, len(rows), ends[i % 3], n, None))
            ends[i % 3] += n
    return spark.createDataFrame(rows, "part int, queue string, doc_id long, start long, n long, ids binary").repartition(4)


@pytest.mark.parametrize("shares", [None, {"a": 3, "b": 2, "c": 1}])
def test_schedule_keeps_the_mixture(spark, shares):
    """Places are gapless, and while no queue is empty what each has sent differs from its share by less than a document."""
    rng = random.Random(21)
    sizes = {f"={q}": [rng.randint(1, 400) for _ in range(n)] for q, n in (("a", 900), ("b", 500), ("c", 90))} | {"": [7] * 5}
    got = sorted(packing.schedule(queued(spark, sizes), window=5000, shares=shares).collect(), key=lambda r: r.place)
    end = 0
    for r in got:
        assert r.place == end
        end += r.n
    assert end == sum(map(sum, sizes.values()))
    weights = {f"={k}": v for k, v in shares.items()} if shares else {q: sum(own) for q, own in sizes.items()}
    whole = sum(weights.values())
    full = min(int(sum(sizes[q]) * whole / w / 5000) for q, w in weights.items())  # windows before the first queue is empty
    assert full > 10
    for t in range(1, full + 1):
        for q, w in weights.items():
            sent = sum(r.n for r in got if r.queue == q and r.turn <= t)
            assert 0 <= t * 5000 * w / whole - sent + 1e-6 < 401
    if shares:
        assert {r.phase for r in got if r.queue == ""} == {1}


def test_many_sources_do_not_tear_documents(spark):
    sizes = {f"={q}": [1000] for q in range(700)}
    got = packing.schedule(queued(spark, sizes)).collect()
    assert sorted(r.place for r in got) == list(range(0, 700_000, 1000))
    with pytest.raises(ValueError):
        packing.schedule(queued(spark, {"=a": [1]}), shares={"a": -1})


def test_packing_code_points():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P("byte_bpe_50k.json"))
    own = packing.Encoder(common.file_bytes(P("byte_bpe_50k.json")), common.file_bytes(P("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(9, 127), rng.randrange(160, 0x600), rng.randrange(0x600, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(30))
        assert np.frombuffer(own.encode(t), own.type).tolist() == library.encode(t, add_special_tokens=False).ids


# All


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "one two three four", None, None, None), (2, None, None, None, None)], DOC)
    labels = spark.createDataFrame([(None, None), (2, 1)], "doc_id long, quality int")
    for found in (tokens.count_tokens(df, tokenizer_path=P("word_bpe_49k.json")), suffixes.remove_repeated_bytes(df), fmindex.remove_repeated_words(df), quality.judge(df, labels), simhash.near_duplicates(df), simhash.similar(df), pii.find(df), packing.pack(df, **pack_args())):
        assert {r.doc_id for r in found.collect()} == {None, 2}


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.sql(queries.oracle_sql()[name]), queries.queries()[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [sorted(tuple(r[c] for c in cols) for r in got.collect()), sorted(tuple(dict(zip(want.columns, r, strict=True))[c] for c in cols) for r in want.fetchall())]
    assert rows[0] == rows[1]


def test_registered_digests(spark):
    """The columns that the queries derive from the operators' results."""
    docs = {r.doc_id: r.text for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()}
    fps, spans = by_id(queries.op7_simhash(spark, SF)), by_id(queries.op9_personal_data(spark, SF))
    for i, t in docs.items():
        assert fps[i].fingerprint == f"{brute_fingerprint(t):016x}"
        base = brute_spans(t)
        assert spans[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(spans[i].spans.split(","))
    assert len(fps) == len(spans) == len(docs)


def test_registered():
    got = queries.queries()
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in got] == list(range(1, 11)) and set(queries.oracle_sql()) <= set(got)
