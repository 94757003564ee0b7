"""2. Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import common

#: The split on ASCII text, where no Unicode tables are needed.
ASCII_SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

#: Bounds of a worker's cache of what was encoded before.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64

_MASK = (1 << 64) - 1


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _slot(h: int, d: int, n: int) -> int:
    h = ((h ^ (d * 0x9E3779B97F4A7C15 & _MASK)) * 0xD6E8FEB86659FD93) & _MASK
    return (h ^ h >> 32) % n


class PerfectHash:
    """A minimal perfect hash of n keys onto n slots by hash and displace: a bucket's displacement sends all its keys to
    free slots, the largest buckets first; a bucket of one key names its slot, as -slot - 1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // per_bucket)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) < n:
            raise ValueError("two keys share a 64-bit hash")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(n, -1, np.int64)
        free = bytearray(b"\1") * n
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[b]
            if len(own) < 2:
                break
            d = 1
            while True:
                slots = [_slot(hashes[i], d, n) for i in own]
                if len(set(slots)) == len(slots) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(own, slots, strict=True):
                self.key_at[s], free[s] = i, 0
        left = iter([s for s in range(n) if free[s]])
        for b in range(self.buckets):
            if len(members[b]) == 1:
                s = next(left)
                self.shift[b] = -s - 1
                self.key_at[s] = members[b][0]


class Codec(dict):
    """Pre-token -> packed little-endian ids; a bounded memo over the two tiers."""

    def __init__(self, ranks: dict[bytes, int], shift: np.ndarray, key_at: np.ndarray, pattern: str):
        import regex

        super().__init__()
        self.ranks = ranks
        keys = list(ranks)
        self.n, self.buckets, self.shift = len(keys), len(shift), shift.tolist()
        self.words = [keys[i] for i in key_at]
        self.ids = [ranks[w].to_bytes(4, "little") for w in self.words]
        self.vocabulary = [b""] * (max(ranks.values(), default=-1) + 1)
        for w, i in ranks.items():
            self.vocabulary[i] = w
        self.wide, self.narrow = regex.compile(pattern), re.compile(ASCII_SPLIT, re.A)

    def whole(self, piece: bytes) -> bytes | None:
        """First tier."""
        h = xxhash.xxh3_64_intdigest(piece)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else _slot(h, d, self.n)
        return self.ids[s] if self.words[s] == piece else None

    def merged(self, piece: bytes) -> bytes:
        """Second tier: the pair of least rank, leftmost first, is joined until none is left."""
        n, ranks = len(piece), self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has been joined meanwhile
            parts[i] += parts[j]
            parts[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return b"".join(ranks[p].to_bytes(4, "little") for p in parts if p is not None)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        found = self.whole(data) or self.merged(data)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, (self.narrow if text.isascii() else self.wide).findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(vocabulary: bytes, pattern: str) -> Codec:
    ranks = read_ranks(vocabulary)
    own = PerfectHash(list(ranks))
    return Codec(ranks, own.shift, own.key_at, pattern)


def _shared_codec(spark, ranks_path: str, pattern: str):
    vocabulary = common.file_bytes(ranks_path)
    own = PerfectHash(list(read_ranks(vocabulary)))
    sent = common.shared(spark, (vocabulary, own.shift, own.key_at))  # bounded by the vocabulary file
    return lambda: common.once(("bpe", ranks_path, pattern), lambda: Codec(read_ranks(sent.value[0]), *sent.value[1:], pattern))


def encode(docs: DataFrame, *, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) for each row.

    Null text: empty, no ids. Very long texts: whole. Null id: returned as null. Repeated rows: each returned. Empty table: no rows. Other columns are
    not read. No special tokens: their strings are ordinary text."""
    get = _shared_codec(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        own = get()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(own.encode, part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return common.keyed_text(docs, key, text).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, *, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary) from doc_id, ids. Null ids: empty."""
    get = _shared_codec(encoded.sparkSession, ranks_path, pattern)

    def run(batches):
        own = get()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array((own.decode(x or b"") for x in part.column(1).to_pylist()), pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, *, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, in one pass that keeps neither.

    Null text: empty, no ids. Very long texts: whole. Null id: returned as null. Repeated rows: each returned. Empty table: no rows. Other
    columns are not read."""
    get = _shared_codec(docs.sparkSession, ranks_path, pattern)

    def run(batches):
        own = get()
        for b in batches:
            n, ids_sha, data_sha = [], [], []
            for t in b.column(1):
                ids = own.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                data_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.keyed_text(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
