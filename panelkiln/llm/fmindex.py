"""8. Substring dedup over words: an FM-index per shard, searched backward over a wavelet matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import substrings

#: Every so-manieth place of an indexed text is kept; from the others the search steps back to one.
SAMPLE = 16
#: The k lowest bits of a word, for k from 0 to 63.
LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & LOW[i & 63])

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).view(np.uint64)) & np.uint64(1) == 1

    def both(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at places i, and the ones before."""
        w, k = i >> 6, i & 63
        word = self.words[w]
        return (word >> k.view(np.uint64)) & np.uint64(1) == 1, self.before[w] + np.bitwise_count(word & LOW[k])

    def place(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th one (from 0) stands."""
        w = np.searchsorted(self.before, k, "right") - 1
        word, k, place = self.words[w], k - self.before[w], np.zeros(len(w), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = k >= low
            k, place = np.where(up, k - low, k), place + half * up
            word = np.where(up, word >> np.uint64(half), word)
        return 64 * w + place


class Wavelet:
    """A wavelet matrix over small whole numbers: a bit vector for each bit of a symbol, the uppermost first."""

    def __init__(self, x: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (x >> level) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int((bit == 0).sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        self.start = self._down(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.ones(i)
            i = np.where((c >> (self.depth - 1 - k)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before place i."""
        return self._down(c, i) - self.start[c]

    def symbol(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places i, and how often each stands before its place."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.both(i)
            c, i = c << 1 | one, np.where(one, zeros + ones, i - ones)
        return c, i - self.start[c]


def suffixes(first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a text in order, and their ranks by the first `depth` symbols (a power of two), equal ones alike. The last symbol is 0 and
    stands nowhere else.

    By doubling, from as many symbols as fit a word; those that already differ from all others are not sorted again."""
    n, bits, step = len(first), int(first.max()).bit_length(), 1
    key = first
    while 2 * step * bits <= 63 and 2 * step <= depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = key[step:]
        key, step = key << (step * bits) | after, 2 * step
    order = np.argsort(key)
    new = np.ones(n, bool)  # where suffixes change in so many symbols
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank, at = np.empty(n, np.int64), np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    ranks = rank if step < depth else rank.copy()
    while True:
        alone = new[at] & np.append(new[at[1:]], True)
        at = at[~alone]
        if not len(at):
            return order, ranks
        own = order[at]
        key = rank[own] * n + rank[own + step]  # what holds the last symbol stands alone, so none of these ends here
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[at] = own
        new[at[1:]] = key[1:] != key[:-1]
        rank[own] = np.maximum.accumulate(np.where(new[at], at, 0))
        step *= 2
        if step == depth:
            ranks = rank.copy()


def in_parts(text: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A text's symbols with the parting ones told apart, in the order of what follows them: suffixes keep their order, and differ by the end of a
    part, so sorting them is a matter of the longest part. Parts are sorted first, then the text as one of parts."""
    end = np.append(np.flatnonzero(parts) + 1, len(text))
    wide = text.astype(">i8").tobytes()
    own = [wide[8 * a : 8 * z] for a, z in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
    name = {p: k for k, p in enumerate(sorted(set(own)))}
    order, _ = suffixes(np.array([name[p] for p in own]), 1)
    follows = np.empty(len(own), np.int64)
    follows[order] = np.arange(len(own))
    out = np.where(text > 1, text + len(own), 0)
    out[parts] = follows[1:] + 1
    return out


class Index:
    """FM-index of a text of symbols 0 .. size - 1, of which 0 parts it; an end of its own comes after, below all. Kept are the symbols before the sorted suffixes, as a wavelet
    matrix; how many symbols are lesser than each; a bit where suffixes change within their first window - 1 symbols; and every
    SAMPLE-th place of the text and the first of each part, with a bit for the suffixes that start there. Neither the text nor its suffix array is kept."""

    def __init__(self, text: np.ndarray, size: int, window: int):
        text, size = np.append(text.astype(np.int64) + 1, 0), size + 1
        n = self.n = len(text)
        run = 1 << (window - 1).bit_length() - 1
        parts = text == 1
        order, ranks = suffixes(in_parts(text, parts), run)
        kept = (order % SAMPLE == 0) | parts[order - 1]
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.last = Wavelet(text[order - 1], size)
        self.sampled = Bits(kept)
        self.places = order[kept].astype(np.uint32)
        # alike in window - 1 symbols: two overlapping runs of a power of two
        a, b = ranks[order], ranks[np.minimum(order + window - 1 - run, n - 1)]
        new = np.ones(n + 1, bool)  # and one past the end
        new[1:n] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.changes = Bits(new)

    def back(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """The suffixes that begin with c and go on as those between lo and hi."""
        c = c + 1
        found = self.count[np.concatenate([c, c])] + self.last.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return found[: len(c)], found[len(c) :]

    def shorter(self, lo: np.ndarray):
        """The suffixes alike in window - 1 symbols with that at lo."""
        k = self.changes.ones(lo + 1)
        return self.changes.place(k - 1), self.changes.place(k)

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Where in the text the i-th suffixes start: steps back to a place that is kept."""
        out, steps, at = np.zeros(len(i), np.int64), 0, np.arange(len(i))
        while len(i):
            here = self.sampled.at(i)
            out[at[here]] = self.places[self.sampled.ones(i[here])].astype(np.int64) + steps
            i, at = i[~here], at[~here]
            c, before = self.last.symbol(i)
            i, steps = self.count[c] + before, steps + 1
        return out

    def first(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where in the text the first of the suffixes between lo and hi starts."""
        lo, which, back = np.unique(lo, return_index=True, return_inverse=True)
        many = hi[which] - lo
        places = self.locate(substrings.runs_of(lo, many))
        return np.minimum.reduceat(places, np.cumsum(many) - many)[back]


def search(doc, lo, size, words, kind: substrings.Kind):
    """(doc, lo) of the windows of a shard's stretches that also start in a document of smaller id.

    All stretches are indexed, in order of their documents, and then streamed from their right ends, in step: a window first, then one
    symbol at a time to the left. Where the match would grow longer than a window, the interval widens to that of one symbol less. So
    each place has the interval of its longest match, up to a window; where that is reached and the interval holds another place,
    the first place it holds decides. It is looked up where the matches change; while they all go on together, it moves left with them."""
    order = np.lexsort((lo, doc))
    words = words[substrings.runs_of((np.cumsum(size) - size)[order], size[order])]
    doc, lo, size = doc[order], lo[order], size[order]
    names, code = np.unique(words, return_inverse=True)
    part = np.arange(len(size))
    text = np.zeros(len(code) + len(size), np.int64)
    text[np.arange(len(code)) + np.repeat(part, size)] = code + 1  # a 0 after each stretch
    start = np.cumsum(size) - size + part
    w = kind.window
    index = Index(text, len(names) + 1, w)
    found_doc, found_lo = [], []
    live, at = part, start + size - 1  # the symbol to add next
    a, z = np.zeros(len(size), np.int64), np.full(len(size), index.n)
    first = np.full(len(size), -1)  # where the earliest match of a whole window starts; -1: to be looked up
    for step in range(int(size.max())):
        if step >= w:
            n = z - a
            a, z = index.shorter(a)
            first[z - a > n] = -1
        n = z - a
        a, z = index.back(text[at], a, z)
        if step >= w - 1:
            first = np.where((z - a == n) & (first >= 0), first - 1, -1)
            ask = np.flatnonzero((first < 0) & (z - a > 1))
            if len(ask):
                first[ask] = index.first(a[ask], z[ask])
            several = np.flatnonzero(z - a > 1)
            hit = several[doc[np.searchsorted(start, first[several], "right") - 1] < doc[live[several]]]
            found_doc.append(doc[live[hit]])
            found_lo.append((lo[live] + at - start[live])[hit])
        on = at > start[live]
        live, at, a, z, first = live[on], at[on] - 1, a[on], z[on], first[on]
        if not len(live):
            break
    return np.concatenate(found_doc), np.concatenate(found_lo)


def remove_repeated_words(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = substrings.MOST) -> DataFrame:
    """doc_id, n (words), spans (removed words, maximal), kept (the other words, joined by one space, UTF-8) for each row.

    A word goes if a window of 50 words that covers it also starts in a document of smaller id. Matches lie within documents and are
    judged on the input. Null text: no words. Null id: taken as smaller than any. Repeated rows (id and text): judged as one document,
    each returned. An id with several texts: a document for each, in order of the texts' hashes. Texts under 50 words: kept whole. Very long texts: whole, too. Empty
    table: no rows. Other columns are not read. Words are compared by 64 hash bits."""
    return substrings.remove_repeats(docs, substrings.WORDS, search, key=key, text=text, most=most)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS k FROM s
), m AS (
  SELECT k, min(doc_id) AS first FROM h GROUP BY k
), g AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM h JOIN m USING (k) WHERE doc_id > first
), r AS (
  SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id
), x AS (
  SELECT d.doc_id, d.w, coalesce(r.ps, []) AS ps FROM d LEFT JOIN r USING (doc_id)
), t AS (
  SELECT doc_id, unnest(generate_series(1, len(w))) AS p, w FROM d WHERE len(w) > 0
), u AS (
  SELECT t.doc_id, array_to_string(list(t.w[t.p] ORDER BY t.p), ' ') AS kept FROM t LEFT JOIN g USING (doc_id, p) WHERE g.p IS NULL GROUP BY t.doc_id
)
SELECT x.doc_id, CAST(len(x.w) AS BIGINT) AS n_words, CAST(len(x.ps) AS BIGINT) AS n_removed, sha256(coalesce(u.kept, '')) AS kept_sha256
FROM x LEFT JOIN u USING (doc_id)
"""
