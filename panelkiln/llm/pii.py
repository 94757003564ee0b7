"""9. Personal data: patterns, then terms that reveal the entities found, by corpus co-occurrence."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The contracted patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Documents that must hold both an entity and a term; part of the entity's information that a term may disclose at most; bits of the
#: filters that spare work on terms that can't matter; counts a task holds before it hands them on.
SUPPORT, DISCLOSED, FILTER_BITS, HOLD = 3, 0.9, 1 << 24, 500_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL, _IP, _CARD, _PHONE = (re.compile(p) for p in (EMAIL, IP, CARD, PHONE))
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER = re.compile(r"[^\W\d_]")
_EDGE = ".,;:!?()[]{}<>\"'`*#|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str):
    """As the pattern's leftmost matches without overlap: a match can only begin where the run of local characters before its
    @ begins, so nothing else is tried."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end(), m[0].lower()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, normalised value), by start and kind, of the contracted kinds."""
    found = []
    if "@" in text:
        found += [(a, 0, b, v) for a, b, v in emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                found.append((m.start(), 3, m.end(), digits))
    found.sort()
    return found


def term_of(word: str) -> str | None:
    """A word as a term: without punctuation around it, in small letters; at least three characters, one a letter."""
    t = word.strip(_EDGE).lower()
    return t if len(t) > 2 and _LETTER.search(t) else None


def hashed(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 9)
    return h - (1 << 64) if h >> 63 else h


def entity_of(kind: int, value: str) -> int:
    return hashed(f"{kind}:{value}")


def words_of(text: str, spans):
    """(start, end) of the words that no entity overlaps."""
    i, reach = 0, 0
    for m in _WORD.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach = max(reach, spans[i][2])
            i += 1
        if reach <= m.start():
            yield m.start(), m.end()


def occurrences(text: str, spans, wanted) -> list[tuple[int, int, int]]:
    """(term, start, end) for every place of every term with wanted(term)."""
    out = []
    for s, e in words_of(text, spans):
        if (t := term_of(text[s:e])) and wanted(h := hashed(t)):
            lead = e - s - len(text[s:e].lstrip(_EDGE))
            out.append((h, s + lead, s + lead + len(text[s:e].strip(_EDGE))))
    return out


def _scan(batches):
    kinds = range(len(KINDS))
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            few = b.slice(at, 1000)
            counts, shas, base, entities, terms = [[] for _ in kinds], [], [], [], []
            for t in few.column(1).to_pylist():
                spans = base_spans(t)
                said = [f"{KINDS[k]}:{a}:{e}" for a, k, e, _ in spans]
                for k in kinds:
                    counts[k].append(sum(s[1] == k for s in spans))
                shas.append(hashlib.sha256(",".join(said).encode()).hexdigest())
                base.append([{"start": a, "kind": k, "end": e} for a, k, e, _ in spans])
                entities.append(sorted({entity_of(k, v) for _, k, _, v in spans}))
                terms.append(sorted({hashed(w) for w in {term_of(t[a:z]) for a, z in words_of(t, spans)} if w}) if spans else [])
            yield pa.RecordBatch.from_arrays(
                [few.column(0), few.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(base, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64()))],
                ["doc_id", "rk", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "entities", "words"],
            )


SCAN = "doc_id long, rk long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start: long, kind: int, end: long>>, entities array<long>, words array<long>"


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Base spans, the entities in them and, where there are any, the text's distinct terms, a row for each row; row numbers them, rk tells
    rows of one id apart by their text."""
    rows = common.keyed_text(docs, key, text)
    return common.settle(rows.select("doc_id", "text", F.xxhash64("text").alias("rk")).mapInArrow(_scan, SCAN).withColumn("row", F.monotonically_increasing_id()), "pii")


def bit_table(keys: DataFrame) -> np.ndarray:
    """A bit for each key (its one column, long), of a fixed number: it skips what can't matter, a join afterwards is exact."""
    bits = keys.select(F.pmod(keys.columns[0], F.lit(FILTER_BITS)).alias("bit")).distinct()

    def words(batches):
        out = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            i = b.column(0).to_numpy()
            np.bitwise_or.at(out, i >> 3, np.left_shift(1, i & 7).astype(np.uint8))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at].astype(np.int32))], ["byte", "value"])

    table = np.zeros(FILTER_BITS // 8, np.uint8)
    got = bits.mapInArrow(words, "byte long, value int").groupBy("byte").agg(F.bit_or("value").alias("value")).toArrow()  # FILTER_BITS / 8 rows at most
    table[got["byte"].to_numpy()] = got["value"].to_numpy()
    return table


def has_bit(table: np.ndarray, key: int) -> bool:
    key %= FILTER_BITS
    return bool(table[key >> 3] >> (key & 7) & 1)


def handed_on(sums: dict, names: list[str]):
    keys = zip(*sums, strict=True) if sums else [()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(sums.values(), pa.int64())], names)


def alike(posts: DataFrame, item: str) -> DataFrame:
    """Of posts (row, item): item, same (the least item that stands in just the same rows, told by their number and two sums of hashes), n (of
    rows). What many items have in common is then counted once."""
    halves = [F.pmod(F.xxhash64("row", F.lit(k)), F.lit(1 << 31)) for k in (1, 2)]
    told = posts.groupBy(item).agg(F.count("*").alias("n"), *(F.sum(h).alias(f"s{k}") for k, h in enumerate(halves)))
    first = told.groupBy("n", "s0", "s1").agg(F.min(item).alias("same"))
    return told.join(first, ["n", "s0", "s1"]).select(item, "same", "n")


def revealing(rows: DataFrame, found: DataFrame, *, support: int, disclosed: float) -> DataFrame:
    """row, term: the terms of a row that disclose an entity of it.

    With p(e) the part of documents that hold an entity and p(e|t) its part among those that hold the term, the term discloses
    PMI(e, t) / -log p(e) = 1 - log p(e|t) / log p(e) of the entity's information. Counts are of documents, over all of them, wherever
    in the document the term stands.

    Entities that stand in just the same documents are counted as one, and so are such terms: a page of k addresses and m words that is
    copied has one pair to count, not k x m. A term of more documents than holding ** disclosed * n ** (1 - disclosed) discloses no entity
    that `holding` documents hold, so frequent terms go before they are paired."""
    spark = rows.sparkSession
    n = max(2, rows.count())
    none = spark.createDataFrame([], "row long, term long")
    own = found.where(F.size("entities") > 0)
    posts = own.select("row", F.explode("entities").alias("entity"))
    entities = common.settle(alike(posts, "entity").where((F.col("n") >= support) & (F.col("n") * 2 <= n)), "entities")
    most = entities.agg(F.max("n")).first()[0]
    if most is None:
        return none
    held = common.settle(posts.join(entities, "entity").select("row", F.col("same").alias("e"), F.col("n").alias("holding")).distinct(), "held")
    room = lambda holding: F.pow(holding, F.lit(disclosed)) * float(n) ** (1 - disclosed) + 1e-6
    words = own.join(held.select("row").distinct(), "row", "left_semi").select("row", F.explode("words").alias("term"))
    terms = common.settle(alike(words, "term").where((F.col("n") >= support) & (F.col("n") <= room(F.lit(most)))), "terms")
    said = common.settle(words.join(terms, "term").select("row", "term", F.col("same").alias("t"), "n"), "said")
    met = held.join(said.select("row", "t", "n").distinct(), "row").where(F.col("n") <= room(F.col("holding")))
    both = met.groupBy("e", "t").agg(F.count("*").alias("both"), F.first("holding").alias("holding")).where(F.col("both") >= support)
    both = common.settle(both, "pairs")
    chosen = common.settle(terms.join(both.select(F.col("t").alias("same")).distinct(), "same", "left_semi").select("term", F.col("same").alias("t")), "chosen")
    table = bit_table(chosen.select("term"))
    if not table.any():
        return none
    sent_terms = common.shared(spark, table)

    def count(batches):
        bit, memo, sums = sent_terms.value, {}, {}

        def key_of(word: str) -> int:
            t = term_of(word)
            h = hashed(t) if t else None
            return h if h is not None and has_bit(bit, h) else 0

        for b in batches:
            for t in b.column(0):
                own = set()
                for w in set(_WORD.findall(t.as_py())):
                    h = memo.get(w)
                    if h is None:
                        h = key_of(w)
                        if len(memo) < 200_000:
                            memo[w] = h
                    if h:
                        own.add(h)
                for h in own:
                    sums[h,] = sums.get((h,), 0) + 1
            if len(sums) > HOLD:
                yield handed_on(sums, ["term", "n"])
                sums = {}
        yield handed_on(sums, ["term", "n"])

    with_term = rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("with_term")).join(chosen, "term")
    told = 1 - F.log(F.least(F.lit(1.0), F.col("both") / F.greatest("with_term", "both"))) / F.log(F.least(F.col("holding") / F.lit(float(n)), F.lit(1 - 1e-9)))
    pairs = common.settle(both.join(with_term, "t").where(told >= disclosed).select("e", "term"), "revealing")
    marked = said.join(pairs, "term").join(held, ["row", "e"], "left_semi")
    return common.settle(marked.select("row", "term").distinct(), "marked")


def marks(rows: DataFrame, found: DataFrame, terms: DataFrame) -> DataFrame:
    """m_doc, m_rk, terms: every place of the terms (row, term) in their documents."""
    sent = common.shared(rows.sparkSession, bit_table(terms.select("term")))

    def run(batches):
        of_term = sent.value
        for b in batches:
            if not of_term.any():
                continue
            doc, rk = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                spans = base_spans(t)
                got = occurrences(t, spans, lambda w: has_bit(of_term, w)) if spans else []
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([doc[i]] * len(got), pa.int64()), pa.array([rk[i]] * len(got), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*got, strict=True))], ["p_doc", "p_rk", "p_term", "start", "end"])

    seen = rows.select("doc_id", "text", F.xxhash64("text").alias("rk")).mapInArrow(run, "p_doc long, p_rk long, p_term long, start long, end long")
    own = found.select("row", F.col("doc_id").alias("m_doc"), F.col("rk").alias("m_rk")).join(terms, "row").select("m_doc", "m_rk", "term").distinct()
    here = (F.col("p_rk") == F.col("m_rk")) & (F.col("p_term") == F.col("term")) & F.col("p_doc").eqNullSafe(F.col("m_doc"))
    return seen.join(own, here, "left_semi").groupBy(F.col("p_doc").alias("m_doc"), F.col("p_rk").alias("m_rk")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))


def find(docs: DataFrame, *, support: int = SUPPORT, disclosed: float = DISCLOSED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, rk, n_email, n_ip, n_card, n_phone, base_sha256, base, terms: for each row the contracted spans and, as the method
    finds, every place of the terms that disclose an entity of the document.

    An entity that over half of all documents hold discloses nothing. Null text: empty, no spans. Null id: returned as null.
    Very long texts: whole. Repeated rows: each returned, and each counts as a document. Empty table: no rows. Other columns are not read."""
    rows = common.keyed_text(docs, key, text)
    found = scan(docs, key, text)
    terms = marks(rows, found, revealing(rows, found, support=support, disclosed=disclosed))
    joined = found.drop("entities", "words", "row").join(terms, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("rk") == F.col("m_rk")), "left")
    empty = F.array().cast("array<struct<start: long, end: long>>")
    return joined.withColumn("terms", F.coalesce("terms", empty)).drop("m_doc", "m_rk")


def span_string(base, terms):
    """kind:start:end by start, then kind as listed (terms last), comma-joined."""
    kind = F.array(*(F.lit(k) for k in (*KINDS, TERM)))
    every = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.transform(terms, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def generalised(text: str, base, terms) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap are replaced together, by the first one's kind."""
    marks = sorted([(m["start"], m["kind"], m["end"]) for m in base] + [(m["start"], len(KINDS), m["end"]) for m in terms])
    out, at = [], 0
    for a, k, z in marks:
        if a >= at:
            out += [text[at:a], f"[{(*KINDS, TERM)[k].upper()}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, support: int = SUPPORT, disclosed: float = DISCLOSED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets: entities and disclosing terms alike are generalised. A null text
    stays null, an empty one empty; very long texts are read whole. Rows without an id and repeated rows are treated alike. All columns and
    rows stay, whatever the columns' names; an empty table stays empty."""
    found = find(docs, support=support, disclosed=disclosed, key=key, text=text)
    doc, rk, base, terms = (common.fresh(docs.columns, c) for c in ("doc", "rk", "base", "terms"))
    spans = found.where((F.size("base") > 0) | (F.size("terms") > 0)).select(F.col("doc_id").alias(doc), F.col("rk").alias(rk), F.col("base").alias(base), F.col("terms").alias(terms)).dropDuplicates([doc, rk])
    own = F.col(key).cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(rk))
    joined = docs.join(spans, own, "left").select(*(docs[c] for c in docs.columns), base, terms)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            texts, bases = b.column(at).to_pylist(), b.column(b.num_columns - 2)
            for i in np.flatnonzero(bases.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if texts[i] is not None:
                    texts[i] = generalised(texts[i], bases[i].as_py(), b.column(b.num_columns - 1)[i].as_py())
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-2])

    return joined.mapInArrow(run, docs.schema)
