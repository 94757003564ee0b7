"""5. Suffix-array dedup: bytes of repeated 100-byte strings, by depth-limited most-significant-digit sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, substrings

#: Bytes of a digit.
DIGIT = 4


def ordered(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the suffixes of data that start in `at` share their first `depth` bytes with another, by group, and the groups.

    Most-significant-digit passes: each group is sorted by the next digit and cut where it changes; a suffix alone is done. What is left
    after the last digit is equal in all bytes."""
    digits = np.ndarray((len(data) - DIGIT + 1,), f">u{DIGIT}", data, strides=(1,))
    live, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for d in [*range(0, depth - DIGIT, DIGIT), depth - DIGIT]:
        key = group << 8 * DIGIT | digits[at[live] + d]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])
        alone = new[1:] & new[:-1]
        live, group = live[order][~alone], np.cumsum(new[:-1])[~alone]
        if not len(live):
            break
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    return live, group


def search(doc, lo, size, data, kind: substrings.Kind):
    """(doc, lo) of the windows of these stretches that also start earlier."""
    count = size - kind.window + 1
    at = substrings.runs_of(np.cumsum(size) - size, count)
    doc, lo = np.repeat(doc, count), substrings.runs_of(lo, count)
    live, group = ordered(data, at, kind.window)
    order = live[np.lexsort((lo[live], doc[live], group))]
    again = order[substrings.repeated(group, doc[order], lo[order], kind)]
    return doc[again], lo[again]


def remove_repeated_bytes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = substrings.MOST) -> DataFrame:
    """doc_id, n (bytes), spans (removed bytes, maximal), kept (bytes) for each row.

    A byte goes if a 100-byte string that covers it also starts earlier: in a document of smaller id, or earlier in its own. Matches
    lie within documents and are judged on the input. Null text: empty. Null id: taken as smaller than any. Repeated rows (id and
    text): judged as one document, each returned. An id with several texts: a document for each, in order of the texts' hashes. Texts
    under 100 bytes: kept whole. Texts of up to 2 ** 30 bytes (PLACE_BITS); Arrow batches end at twice that. Empty table: no rows. Other columns are not read. Runs of windows that are equal as a whole are told
    by 128 hash bits, all other strings by their bytes."""
    return substrings.remove_repeats(docs, substrings.BYTES, search, key=key, text=text, most=most)


def cut_repeated_bytes(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes gone from the text, and with them what is left of a character that lost one. A null text stays
    null, an empty one empty. Very long texts: whole. All rows and columns stay, whatever the columns' names; an empty table stays empty."""
    cut = common.fresh(docs.columns, "cut")
    joined = substrings.cut_repeats(docs, substrings.BYTES, search, cut, key=key, text=text)
    edges = F.flatten(F.transform(cut, lambda s: F.array(s["start"], s["end"])))
    joined = joined.withColumn(cut, edges)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            cuts = b.column(b.num_columns - 1)
            texts = b.column(at).to_pylist()
            for i in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                if texts[i]:
                    raw = texts[i].encode()
                    edges = [0, *cuts[i].as_py(), len(raw)]
                    texts[i] = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)).decode(errors="ignore")
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


#: Bytes as pairs of hexadecimal digits.
SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), s AS (
  SELECT doc_id, unnest(range(CAST(length(x) // 2 - 99 AS BIGINT))) AS i, x FROM d WHERE length(x) >= 200
), h AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS k FROM s
), g AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM h) WHERE r > 1
), e AS (
  SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 0 ELSE 1 END AS new FROM g
), f AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e
), c AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 100 AS z FROM f GROUP BY doc_id, span
), q AS (
  SELECT c.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY c.doc_id ORDER BY a), 0) AS before, substr(d.x, 2 * coalesce(lag(z) OVER (PARTITION BY c.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(z) OVER (PARTITION BY c.doc_id ORDER BY a), 0))) AS part FROM c JOIN d USING (doc_id)
), t AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(part, '' ORDER BY a) AS parts FROM q GROUP BY doc_id
)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(parts, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
