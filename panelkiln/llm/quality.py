"""6. Quality rules: counted rules, then a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the classifier is fitted on at most (those of least hash of the id), and the part of them held out for
#: calibration; slots of each feature family (words, word pairs, runs of four characters); rounds and rate of the fit; least
#: probability (see measure()); entries of rows that a step of the fit unpacks together.
MAX_LABELLED, HELD, SLOTS, ROUNDS, RATE, KEEP_FROM, UNPACKED = 3_000, 4, 1 << 16, 80, 0.5, 0.25, 1 << 22
FAMILIES, SCALE, FIXED = 3, 30.0, 1 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WORD_SEED = np.uint64(0x51ED270B1F3A2C4D)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return common.Spans(data.astype(np.uint64) + np.uint64(1), WORD_SEED).of(start, end) if len(start) else np.zeros(0, np.uint64)


def features(data: np.ndarray, off: np.ndarray, words):
    """For each family: the slot of each occurrence, and where each text's occurrences begin and end."""
    start, end, of, hashes = words
    first = np.searchsorted(of, np.arange(len(off)))  # a text's words
    cut = np.uint64(64 - 16)
    yield (hashes >> cut).astype(np.int64), first[:-1], first[1:]
    pair = common.mix(hashes[:-1] * common.C1 + hashes[1:]) if len(hashes) > 1 else hashes[:0]
    yield (pair >> cut).astype(np.int64), first[:-1], np.maximum(first[1:] - 1, first[:-1])
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
    before = np.searchsorted(heads, off)
    runs = common.Spans(data.astype(np.uint64) + np.uint64(1), common.C2).of(heads[:-3], np.append(heads[4:], len(data))) if len(heads) > 3 else hashes[:0]
    yield (runs >> cut).astype(np.int64), np.minimum(before[:-1], len(runs)), np.minimum(np.maximum(before[1:] - 3, before[:-1]), len(runs))


def between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[b] - sums[a]


def base_counts(data: np.ndarray, off: np.ndarray, words) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_repeat_words of each text."""
    start, end, of, hashes = words
    n = len(off) - 1
    n_words = np.bincount(of, minlength=n)
    chars = between(((data & 0xC0) != 0x80) & ~common.SPACE[data], off[:-1], off[1:])
    symbols = between(SYMBOLS[data], off[:-1], off[1:])
    repeat = np.zeros(n, np.int64)
    if len(start) >= 8:
        at = np.flatnonzero(of[:-7] == of[7:])
        h = common.mix(common.Spans(hashes, common.C2).of(at, at + 8) ^ common.mix(of[at].astype(np.uint64) + common.C1))
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edge = np.zeros(len(start) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + 8, -1)
        repeat = np.bincount(of[np.cumsum(edge[:-1]) > 0], minlength=n)
    return n_words, chars, symbols, repeat


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def chunk_words(data: np.ndarray, off: np.ndarray):
    start, end, of = common.word_bounds(data, off)
    return start, end, of, word_hashes(data, start, end)


@dataclass
class Classifier:
    """Probability of good quality: sigmoid(slope * score + shift) of a score that is linear in relative frequencies.
    Weights are whole numbers of 1 / FIXED, so that a text's score doesn't depend on the texts around it."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, data, off, words) -> np.ndarray:
        out = np.full(len(off) - 1, self.bias)
        for k, (slot, a, b) in enumerate(features(data, off, words)):
            out += SCALE * between(self.weights[k][slot], a, b) / FIXED / np.maximum(b - a, 1)
        return out

    def probability(self, score):
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


def _rows_of_features(batches):
    """label, fold, slots and relative frequencies of each labelled text: FAMILIES * SLOTS entries at most."""
    for b in batches:
        for a, z, data, off in common.text_chunks(b, 0):
            words = chunk_words(data, off)
            per = list(features(data, off, words))
            slots, values = [], []
            for i in range(z - a):
                s, v = [], []
                for k, (slot, lo, hi) in enumerate(per):
                    u, c = np.unique(slot[lo[i] : hi[i]], return_counts=True)
                    s.append(u + k * SLOTS)
                    v.append(SCALE * c / max(1, hi[i] - lo[i]))
                slots.append(np.concatenate(s).astype("<i4").tobytes())
                values.append(np.concatenate(v).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, z - a) for i in (1, 2, 3)), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["label", "fold", "rank", "slots", "values"])


def solve(got: list[dict]) -> Classifier:
    """Logistic regression by Adagrad on three quarters of these labelled rows, Platt's calibration on the rest. Without both labels the
    classifier keeps everything."""
    got.sort(key=lambda r: (r["rank"], r["slots"]))
    weights = np.zeros(FAMILIES * SLOTS)
    y = np.array([r["label"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return Classifier(np.zeros((FAMILIES, SLOTS), np.int64), 50.0)
    slot = [np.frombuffer(r["slots"], "<i4") for r in got]
    value = [np.frombuffer(r["values"], "<f4") for r in got]
    fold = np.array([r["fold"] for r in got])

    def unpacked(which):
        """Slots, values and rows' places of runs of whole rows, a bounded part at a time: each round streams over the rows as they came."""
        size = np.array([len(slot[i]) for i in which])
        part = np.cumsum(size) // UNPACKED
        for k in np.unique(part):
            own = np.flatnonzero(part == k)
            yield np.concatenate([slot[which[i]] for i in own]), np.concatenate([value[which[i]] for i in own]).astype(float), np.repeat(own, size[own])

    def margins(which):
        return sum(np.bincount(of, v * weights[s], len(which)) for s, v, of in unpacked(which))

    learn, held = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0)
    if len(set(y[learn].tolist())) < 2:
        learn = np.arange(len(y))
    t = y[learn]
    weight = np.where(t == 1, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / len(t)  # both labels count alike
    bias, past, past_bias = 0.0, np.full(FAMILIES * SLOTS, 1e-8), 1e-8
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(margins(learn) + bias, -50, 50)))
        gap = (p - t) * weight
        slope = sum(np.bincount(s, v * gap[of], FAMILIES * SLOTS) for s, v, of in unpacked(learn)) + 1e-6 * weights
        past += slope**2
        weights -= RATE * 0.1 * slope / np.sqrt(past)
        past_bias += gap.sum() ** 2
        bias -= RATE * 0.1 * gap.sum() / np.sqrt(past_bias)
    own = Classifier(np.rint(weights * FIXED).astype(np.int64).reshape(FAMILIES, SLOTS), float(bias))
    if len(held) >= 20 and len(set(y[held].tolist())) == 2:
        x, t = margins(held) + bias, y[held]
        hit = (t * (t.sum() + 1) / (t.sum() + 2) + (1 - t) / ((1 - t).sum() + 2))  # Platt's targets
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton's steps, damped
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
            r = p * (1 - p) + 1e-9
            g = np.array([((p - hit) * x).sum() + 1e-3 * (a - 1), (p - hit).sum()])
            h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum()]])
            step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
            step *= min(1, 2 / max(1e-9, np.abs(step).max()))
            a, b = a - step[0], b - step[1]
        if a > 0:
            own.slope, own.shift = float(a), float(b)
    return own


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, label: str = "quality") -> Classifier:
    """solve() of at most max_labelled labelled rows, by all of their features, in one task: a row holds an entry for each distinct slot of its
    text, so FAMILIES * SLOTS at most. Only the weights come to the driver."""
    rank = F.xxhash64("doc_id")
    used = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    used = used.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(rank, "doc_id").limit(max_labelled)
    used = used.select("doc_id", "label", F.pmod(rank, F.lit(HELD)).cast("int").alias("fold"), rank.alias("rank"))
    # max_labelled rows at most; an id that stands for several texts counts once, with the one of least hash
    rows = common.keyed_text(docs).join(F.broadcast(used), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "label", "fold", "rank"), F.xxhash64("text")).alias("x")).select("x.*")
    made = rows.mapInArrow(_rows_of_features, "label int, fold int, rank long, slots binary, values binary")

    def run(t: pa.Table) -> pa.Table:
        own = solve(t.to_pylist())
        return pa.table({"weights": pa.array([own.weights.astype("<i4").tobytes()], pa.binary()), "bias": [own.bias], "slope": [own.slope], "shift": [own.shift]})

    own = made.withColumn("model", F.lit(1)).groupBy("model").applyInArrow(run, "weights binary, bias double, slope double, shift double").first()
    if own is None:
        return solve([])
    return Classifier(np.frombuffer(bytes(own["weights"]), "<i4").astype(np.int64).reshape(FAMILIES, SLOTS), own["bias"], own["slope"], own["shift"])


def judge(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, keep_from: float = KEEP_FROM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability for each row.

    kept is false where a counted rule fails, else whether the calibrated probability of good quality reaches keep_from. Null
    text: no words, so the counted rule fails. Very long texts: whole. Null id: returned as null. Repeated rows: each returned; a label counts once for an
    id, the lower if they differ. Empty tables: no rows; without labels of both kinds only the counted rules reject. Other columns
    are not read."""
    rows = common.keyed_text(docs, key, text)
    model = fit(rows, labels, max_labelled=max_labelled)
    sent = common.shared(docs.sparkSession, (model.weights.astype(np.int32), model.bias, model.slope, model.shift))  # FAMILIES * SLOTS entries

    def run(batches):
        own = Classifier(*sent.value)
        for b in batches:
            for a, z, data, off in common.text_chunks(b):
                words = chunk_words(data, off)
                n_words, chars, symbols, repeat = base_counts(data, off, words)
                failed = (n_words < 20) | (100 * repeat > 30 * n_words)
                p = own.probability(own.scores(data, off, words))
                lines = np.fromiter((repeated_lines(t.as_py()) for t in b.column(1).slice(a, z - a)), np.int64, z - a)
                cols = [pa.array(np.asarray(c, np.int64)) for c in (n_words, chars, symbols, lines, repeat)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), *cols, pa.array(failed), pa.array(~failed & (p >= keep_from)), pa.array(p)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, keep_from: float = KEEP_FROM, text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, in one pass.

    Null, empty and very long texts: as in judge(), so a null text goes. Rows without an id and repeated rows: each by its text. All columns
    stay, whatever their names. Empty table: no rows."""
    model = fit(common.keyed_text(docs, text=text), labels, max_labelled=max_labelled)
    sent = common.shared(docs.sparkSession, (model.weights.astype(np.int32), model.bias, model.slope, model.shift))

    def run(batches):
        own = Classifier(*sent.value)
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column(b.num_columns - 1)], ["t"])
            for a, z, data, off in common.text_chunks(texts, 0):
                words = chunk_words(data, off)
                n_words, _, _, repeat = base_counts(data, off, words)
                good = (n_words >= 20) & (100 * repeat <= 30 * n_words) & (own.probability(own.scores(data, off, words)) >= keep_from)
                yield b.slice(a, z - a).filter(pa.array(good))

    plain = docs.withColumn(common.fresh(docs.columns, "whole"), F.coalesce(F.col(text), F.lit("")))
    return plain.mapInArrow(run, plain.schema).select(*docs.columns)


def measure(judged: DataFrame, labels: DataFrame, *, label: str = "quality") -> DataFrame:
    """kept_good, kept_bad, lost_good, lost_bad: rows of judge() by their labels, over the fold whose labels didn't fit the weights
    (its two calibration numbers aside). Precision and recall follow."""
    held = labels.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(HELD)) == 0)).groupBy("doc_id").agg(F.min(label).alias("label"))
    rows = judged.join(held, "doc_id")
    many = lambda kept, good: F.coalesce(F.sum(((F.col("kept") == kept) & (F.col("label") == good)).cast("long")), F.lit(0))
    return rows.agg(many(True, 1).alias("kept_good"), many(True, 0).alias("kept_bad"), many(False, 1).alias("lost_good"), many(False, 0).alias("lost_bad"))
