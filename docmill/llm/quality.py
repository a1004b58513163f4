"""Quality rules: document statistics and a calibrated n-gram classifier.

The classifier is a logistic regression on hashed word and character n-grams
(shares of a text, so long and short texts compare), fitted in numpy by one task
on a bounded sample of labelled rows and calibrated on rows it was not fitted on.
Its weights, a fixed-size array, travel with the scoring function; texts are
scored in Arrow batches against a fixed threshold. The sample holds both
classes alike where labels are many, so the calibration is moved back to the
odds of all labels: a verdict does not hang on how many labels there are.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm.tasks import arrow_task, bounded_batches
from docmill.llm.textkernel import IS_SPACE, LOWER, column_bytes, mix, prefix_hashes, row_slices, word_hashes, word_spans

SLICE_BYTES = 1 << 20
BITS = 16  # of each hashed family: words and word pairs; character n-grams
CHAR_N = 4
MAX_LABELLED = 4000  # labelled rows the classifier may see; the only bounded sample here
STEPS, RATE, DECAY = 150, 0.3, 1e-5
PART = 500_000  # features that a step looks at together
CALIBRATION_SHARE = 5  # one labelled row of so many is kept for calibration
THRESHOLD = 0.2  # kept: the calibrated probability of good quality is at least this
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_NEWLINE = np.zeros(256, bool)
_IS_NEWLINE[10] = True
_STARTS_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
_COUNTED = _STARTS_CODE_POINT & ~IS_SPACE


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in a group of two or more, not the first of a group in sorted order), in the order of keys."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    many, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    many[order[1:]] |= same
    many[order[:-1]] |= same
    return many, later


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a slice."""
    rows = len(offsets) - 1
    sums = prefix_hashes(data)
    starts, ends, bounds = word_spans(data, offsets)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    words = word_hashes(data, starts, ends, sums)

    covered = np.zeros(len(words) + 1, np.int64)
    w = REPEAT_WINDOW
    if len(words) >= w:
        at = np.flatnonzero(row[w - 1 :] == row[: len(row) - w + 1])
        key = row[at].astype(np.uint64)
        for k in range(w):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + words[at + k])
        many, _ = _repeated(key)
        np.add.at(covered, at[many], 1)
        np.add.at(covered, at[many] + w, -1)
    covered = np.cumsum(covered)[:-1] > 0

    line_starts, line_ends, line_bounds = word_spans(data, offsets, _IS_NEWLINE)
    with_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_row = np.repeat(np.arange(rows), np.diff(line_bounds))
    keys = mix(mix(line_row.astype(np.uint64)) + word_hashes(data, line_starts, line_ends, sums))
    repeats = np.zeros(len(keys), bool)
    repeats[with_word] = _repeated(keys[with_word])[1]
    return {
        "n_words": np.diff(bounds),
        "word_chars": _per_row(_COUNTED[data], offsets),
        "n_symbols": _per_row(_IS_SYMBOL[data], offsets),
        "n_dup_lines": _per_row(repeats, line_bounds),
        "n_repeat_words": _per_row(covered, bounds),
    }


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the buckets of a slice's n-grams and their bounds by text."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    down = np.uint64(64 - BITS)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) else words
    if len(pairs):
        cut = bounds[1:-1] - 1  # the last word of a text has no pair in it: its word counts twice instead
        cut = cut[(cut >= 0) & (cut < len(pairs))]
        pairs[cut] = words[cut]
    both = np.empty(2 * len(words), np.uint64)
    both[0::2] = words
    if len(words):
        both[1::2] = np.append(pairs, words[-1:])
    grams = np.zeros(len(low), np.uint64)
    for k in range(CHAR_N):  # a text's last grams run into what follows; they are masked below
        grams[: len(low) - k] += low[k:].astype(np.uint64) << np.uint64(8 * k)
    full = np.maximum(offsets[1:] - (CHAR_N - 1), offsets[:-1])
    inside = np.zeros(len(low) + 1, np.int64)
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, full, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    chars = (grams[at] * np.uint64(0x9E3779B97F4A7C15)) >> down
    return [((both >> down).astype(np.int64), 2 * bounds), (chars.astype(np.int64) + (1 << BITS), np.searchsorted(at, offsets))]


@dataclass
class Classifier:
    """Weights of both families, bias, and the calibration p = 1 / (1 + exp(-(a * margin + b)))."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        margin = np.full(len(offsets) - 1, self.bias)
        for buckets, bounds in ngram_buckets(data, offsets):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(self.weights[buckets], out=sums[1:])
            margin += (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -50, 50)))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one label, 0 or 1, of each labelled id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).dropna()
    return known.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))


def prior_shift(labels: DataFrame, max_labelled: int) -> float:
    """log of (good : bad among all labels) over (good : bad in the sample)."""
    n = {r.label: r.n for r in known_labels(labels).groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(n) < 2:
        return 0.0
    half = max_labelled // 2
    return float(np.log(n[1] / n[0]) - np.log(min(n[1], half) / min(n[0], half)))


def labelled_features(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """At most max_labelled rows (label, buckets, shares), chosen by a hash of the id and drawn alike from both classes."""
    known = known_labels(labels)
    picked = known.filter("label = 0").orderBy(F.xxhash64("doc_id")).limit(max_labelled // 2).union(known.filter("label = 1").orderBy(F.xxhash64("doc_id")).limit(max_labelled // 2))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            for a, b in row_slices(offsets, SLICE_BYTES):
                rows = []
                for i in range(a, b):
                    own = data[offsets[i] : offsets[i + 1]]
                    idx, val = [], []
                    for buckets, _ in ngram_buckets(own, np.array([0, len(own)])):
                        u, n = np.unique(buckets, return_counts=True)
                        idx.append(u.astype(np.int32))
                        val.append((n / max(len(buckets), 1)).astype(np.float32))
                    rows.append((np.concatenate(idx).tobytes(), np.concatenate(val).tobytes()))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "label", "buckets", "shares"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text")  # at most max_labelled ids
    made = joined.mapInArrow(arrow_task(features), "doc_id long, label int, buckets binary, shares binary")
    # Of rows with one id one is seen, else the sample would grow with them.
    return made.groupBy("doc_id").agg(F.min(F.struct("label", "buckets", "shares")).alias("row")).select("doc_id", "row.*")


def _descend(index: np.ndarray, value: np.ndarray, row: np.ndarray, y: np.ndarray, weigh: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam steps on the whole (bounded) sample."""
    w, bias = np.zeros(size), 0.0
    parts = [slice(a, a + PART) for a in range(0, len(index), PART)]  # so that what a step makes stays small
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        margin = sum((np.bincount(row[p], weights=w[index[p]] * value[p], minlength=len(y)) for p in parts), np.zeros(len(y))) + bias
        err = weigh * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y)
        g, gb = DECAY * w, err.sum()
        for p in parts:
            g += np.bincount(index[p], weights=err[row[p]] * value[p], minlength=size)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-10)
        bias -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
    return w, bias


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with softened targets."""
    good, bad = y.sum(), len(y) - y.sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    t = np.array([0.1, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        t -= np.clip(np.linalg.solve(hessian, x.T @ (p - target)), -1, 1)
    return (float(t[0]), float(t[1])) if t[0] > 0 else (1.0, 0.0)


class _Features:
    """Features of rows one after another, in files of the task's own: memory doesn't grow with the texts."""

    def __init__(self) -> None:
        self.files = [tempfile.TemporaryFile() for _ in range(3)]
        self.y: list[int] = []

    def add(self, label: int, buckets: pa.Buffer, shares: pa.Buffer) -> None:
        row = np.full(buckets.size // 4, len(self.y), np.int32)
        for f, x in zip(self.files, (buckets, shares, row), strict=True):
            f.write(x)
        self.y.append(label)

    def arrays(self) -> list[np.ndarray]:
        """(index, value, row) of every feature."""
        for f in self.files:
            f.flush()
        kinds = (np.int32, np.float32, np.int32)
        return [np.memmap(f, k, "r") if f.tell() else np.zeros(0, k) for f, k in zip(self.files, kinds, strict=True)]

    def close(self) -> None:
        for f in self.files:
            f.close()


def _fitted(batches: Iterator[pa.RecordBatch]) -> Classifier | None:
    """The classifier of the sample's rows (in the order of their ids), calibrated to the sample's odds; None without both classes."""
    use, held = _Features(), _Features()
    try:
        n = 0
        for batch in batches:
            for label, buckets, shares in zip(*(batch.column(c) for c in (1, 2, 3)), strict=True):
                (use if n % CALIBRATION_SHARE else held).add(label.as_py(), buckets.as_buffer(), shares.as_buffer())
                n += 1
        y, size = np.array(use.y, float), 2 << BITS
        if len({*use.y, *held.y}) < 2:
            return None
        weigh = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
        w, bias = _descend(*use.arrays(), y, weigh, size)
        index, value, row = held.arrays()
        margin = np.full(len(held.y), bias)
        for at in range(0, len(index), PART):
            p = slice(at, at + PART)
            margin += np.bincount(row[p], weights=w[index[p]] * value[p], minlength=len(margin))
        return Classifier(w.astype(np.float32), bias, *_calibrate(margin, np.array(held.y, float)))
    finally:
        use.close()
        held.close()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fit on at most max_labelled rows of labels (doc_id, quality). Without rows of both classes everything is good.

    The bounded sample is fitted in a task; the driver gets the weights alone.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _fitted(batches)
        if m is not None:
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (m.bias, m.a, m.b))], ["weights", "bias", "a", "b"])

    sample = labelled_features(docs, labels, max_labelled).repartition(1).sortWithinPartitions("doc_id")  # at most max_labelled rows
    found = sample.mapInArrow(arrow_task(train), "weights binary, bias double, a double, b double").collect()  # one row
    if not found:
        return Classifier(np.zeros(2 << BITS, np.float32), 20.0)
    r = found[0]
    return Classifier(np.frombuffer(bytes(r.weights), np.float32), r.bias, r.a, r.b + prior_shift(labels, max_labelled))


def quality(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept for each row.

    With keep_columns the rows of docs with a boolean _kept instead (in the
    place of a column of that name). A null
    or empty text has no words, fails the rules and is not kept. Rows with
    one id are judged one by one; null ids are judged and stay null; labels
    with nulls or without a document are ignored; an empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    model = fit(docs, labels, max_labelled)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
            for a, b in row_slices(offsets, SLICE_BYTES):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                s = text_statistics(own, at)
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                p = model.probability(own, at)
                kept = ~failed & (p >= threshold)
                if keep_columns:
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(kept)], [*columns, "_kept"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(s[n]) for n in names), pa.array(failed), pa.array(p), pa.array(kept)], ["doc_id", *names, "base_failed", "probability", "kept"])

    if keep_columns:
        docs = docs.drop("_kept")
        columns = docs.columns
        return docs.mapInArrow(arrow_task(score), docs.selectExpr("*", "true as _kept").schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(arrow_task(score), "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, probability double, kept boolean")
