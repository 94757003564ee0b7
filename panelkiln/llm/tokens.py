"""1. Token counts: a map-side two-tier lookup, without any shuffle of pre-tokens."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The split of the word vocabulary's tokenizer file, after its normalizer; and the same on lower-case ASCII.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_SPLIT = r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+"

#: Bounds of the two tiers: entries broadcast; documents that seed the broadcast table (it only saves time, counts don't
#: depend on it); entries of a worker's cache; longest pre-token that is cached.
TABLE_ENTRIES, SEED_DOCS, CACHE_ENTRIES, CACHE_CHARS = 65_536, 2_000, 400_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(keep)]
    letters = [""] * 256
    for b in keep:
        letters[b] = chr(b)
    for i, b in enumerate(other):
        letters[b] = chr(256 + i)
    return letters


class Lengths(dict):
    """Token counts by pre-token. Misses are encoded by the library's model and kept, up to a bound."""

    def __init__(self, known: dict, model):
        super().__init__(known)
        self.base, self.model, self.letters = len(known), model, byte_letters()

    def __missing__(self, word: str) -> int:
        n = len(self.model.tokenize("".join(map(self.letters.__getitem__, word.encode()))))
        if len(word) <= CACHE_CHARS and len(self) < self.base + CACHE_ENTRIES:
            self[word] = n
        return n


class Counter2:
    """A worker's counter of a text's tokens."""

    def __init__(self, vocabulary: bytes, table: bytes | None):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        known: dict = {}
        if table:
            cut = int.from_bytes(table[:8], "little")
            words, sizes = table[8 : 8 + cut].decode().split("\n"), np.frombuffer(table, np.uint16, offset=8 + cut)
            known = dict(zip(words, sizes.tolist(), strict=True))
        self.lengths = Lengths(known, self.library.model)
        self.wide, self.narrow = regex.compile(SPLIT), re.compile(ASCII_SPLIT, re.A)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.narrow.findall(text.lower())
        return self.wide.findall(self.library.normalizer.normalize_str(text))

    def count(self, text: str) -> int:
        if not text.isascii() and common.newer_than_tables(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if "<|" not in text or not self.special or not self.special.search(text):
            return sum(map(self.lengths.__getitem__, self.pre_tokens(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.lengths.__getitem__, self.pre_tokens(p))) for p in parts)


def frequent_table(texts: list[str], vocabulary: bytes, entries: int = TABLE_ENTRIES) -> bytes:
    """The compact table: the commonest pre-tokens joined by line feeds (no pre-token holds one), then 16-bit lengths."""
    own = Counter2(vocabulary, None)
    seen = Counter(w for t in texts if not common.newer_than_tables(t) for w in own.pre_tokens(t))
    top = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries] if len(w) <= CACHE_CHARS]
    if not top:
        return b""
    sizes = np.array([own.lengths[w] for w in top], np.uint16)
    words = "\n".join(top).encode()
    return len(words).to_bytes(8, "little") + words + sizes.tobytes()


def count_tokens(docs: DataFrame, *, tokenizer_path: str, max_tokens: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row, as the library counts it without added special tokens.

    Null text: empty, 0 tokens. Very long texts: whole. Null id: returned as null. Repeated rows: each returned. Empty table: no rows. Other columns
    are not read. Special strings in a text are one token each, as in the library's default."""
    spark = docs.sparkSession
    rows = common.keyed_text(docs, key, text)
    vocabulary = common.file_bytes(tokenizer_path)
    seed = [r.text for r in rows.select(F.substring("text", 1, 20_000).alias("text")).limit(SEED_DOCS).collect()]
    sent = common.shared(spark, (vocabulary, frequent_table(seed, vocabulary)))

    def run(batches):
        own = common.once(("tokens", tokenizer_path, sent.value[1]), lambda: Counter2(*sent.value))
        for b in batches:
            texts = b.column(1).to_pylist()
            n = np.fromiter(map(own.count, texts), np.int64, len(texts))
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > max_tokens)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
