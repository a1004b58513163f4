"""Language-model scores from a causal self-attention model on subword ids.

The model predicts the next subword in two steps: its class, from the previous
subword and an attention over the subwords of the context (frequent ones with
an embedding of their own, others with one for their class), then the subword
within its class, from the previous subword. Counts (subwords, pairs, words) come from all
training documents; the attention part is trained in numpy, started on a few
documents on the driver and then on all windows of every training document,
partition by partition, with averaged parameters. Scoring cuts texts into
overlapping windows in which each subword is a target exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm.perfecthash import PerfectHash
from docmill.llm.tasks import arrow_task, bounded_batches
from docmill.llm.textkernel import LOWER, column_bytes, row_slices, word_hashes, word_spans
from docmill.llm.tokens import encoder, word_ids
from docmill.llm.workspace import materialise

SLICE_BYTES = 2 << 20
TOKENS = ["row", "doc_id", "held_out", "ids", "n_tokens", "n_known", "base_score", "rest"]
CLASSES, WIDTH = 64, 16
OWN_INPUTS = 192  # the most frequent subwords have an embedding of their own, others one for their class
INPUTS = OWN_INPUTS + CLASSES
LENGTH, STRIDE = 32, 16  # of a window, and how many targets it has
START_DOCUMENTS = 600  # documents that the driver starts the attention on
START_STEPS, STEP_WINDOWS = 700, 512
SCORE_WINDOWS, BLOCK_WINDOWS = 4096, 256
RATE = 0.004
PAIRS = 1_000_000  # pair counts that travel with the scoring function; the rest is joined
HOT_WORDS = 1_000_000  # word counts that travel with the scoring function; the rest is joined
FEATURES = 160  # frequent neighbours that tell classes apart
PAIR_PRIOR, CLASS_PRIOR = 10.0, 4.0
DENSE_CELLS = 16_000_000  # of a table over the ids in use; with more ids in use pairs are looked up instead

DEFAULT_HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 7 = 2"


# --- the model -------------------------------------------------------------


@dataclass
class Attention:
    """Trained parameters. Context subwords have an embedding each (Tables.input_of); the last one is padding and gets no attention."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    distance: np.ndarray

    @classmethod
    def start(cls, inputs: int = INPUTS, classes: int = CLASSES, width: int = WIDTH) -> Attention:
        rng = np.random.default_rng(7)
        make = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(make(inputs + 1, width), make(inputs + 1, width), make(inputs + 1, width), 0.1 * make(width, classes), np.zeros(classes, np.float32), np.zeros((STRIDE, LENGTH), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.query, self.key, self.value, self.out, self.bias, self.distance]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def filled(self, flat: np.ndarray) -> Attention:
        at, new = 0, []
        for x in self.arrays():
            new.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Attention(*new)


_CAUSAL = np.arange(LENGTH)[None, :] <= np.arange(LENGTH - STRIDE, LENGTH)[:, None]


class Ready:
    """What windows are read with, of one set of parameters: exp of query times key is a table over pairs of embeddings.

    Values have a last column of ones, so that a context's last entry is the
    sum of its weights, and, divided by it, the 1 that the bias is added by.
    """

    def __init__(self, m: Attention):
        self.size = len(m.query)
        self.pairs = (m.query * np.float32(WIDTH**-0.5)) @ m.key.T
        self.pairs[:, -1] = -np.inf  # padding
        self.distance = np.where(_CAUSAL, m.distance, np.float32(-np.inf))
        # exp might overflow beyond this bound; most often nothing is to be done
        self.plain = _longest(m.query) * _longest(m.key) * WIDTH**-0.5 + np.abs(m.distance).max() <= 60
        if self.plain:
            np.exp(self.pairs, out=self.pairs)
            np.exp(self.distance, out=self.distance)
        self.value = np.concatenate([m.value, np.ones((self.size, 1), np.float32)], 1)
        self.out = np.concatenate([m.out, m.bias[None]])
        # Contexts are means of values, and log-odds don't exceed theirs.
        self.bound = _longest(m.value) * _longest(m.out.T) + float(np.abs(m.bias).max())

    def places(self, inputs: np.ndarray) -> np.ndarray:
        """Where windows' pairs of query and key stand in the table."""
        return (inputs[:, -STRIDE:] * self.size)[:, :, None] + inputs[:, None, :]

    def weights(self, places: np.ndarray) -> np.ndarray:
        """exp of the attention's logits up to a factor a row; what is later or padding has weight 0."""
        w = np.take(self.pairs, places, mode="clip")
        if self.plain:
            w *= self.distance
        else:
            w += self.distance
            w -= w.max(-1, keepdims=True)
            np.exp(w, out=w)
        return w

    def context(self, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mean values with a 1 at the end, 1 / sums of weights)."""
        context = w @ v
        scale = 1 / np.maximum(context[:, :, -1:], np.float32(1e-30))
        context *= scale
        return context, scale

    def logits(self, context: np.ndarray, prior: np.ndarray, top: float) -> np.ndarray:
        """Class logits of targets, level if exp might overflow; top is the largest of the prior."""
        logits = context.reshape(-1, WIDTH + 1) @ self.out
        logits += prior.reshape(logits.shape)
        if self.bound + top > 60:
            logits -= logits.max(-1, keepdims=True)
        return logits


def _longest(rows: np.ndarray) -> float:
    return float(np.sqrt((rows * rows).sum(1).max()))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept as an axis."""
    return x @ np.ones((x.shape[-1], 1), np.float32)


def _prior_rows(prior: np.ndarray, before: np.ndarray | None, own: slice) -> np.ndarray:
    return prior[own] if before is None else np.take(prior, before[own], axis=0, mode="wrap")


def attend(m: Attention, inputs: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of the class logits (windows, STRIDE, classes), still to be divided by their sum; contexts).

    inputs: (windows, LENGTH) embedding numbers; prior: log-odds from the previous subword.
    """
    ready = Ready(m)
    context, _ = ready.context(ready.weights(ready.places(inputs)), np.take(ready.value, inputs, axis=0))
    return np.exp(ready.logits(context, prior, float(prior.max()))).reshape(prior.shape), context


def gradients(m: Attention, inputs: np.ndarray, target: np.ndarray, live: np.ndarray, prior: np.ndarray, before: np.ndarray | None = None) -> list[np.ndarray]:
    """Gradients of the mean loss over live targets, in the order of Attention.arrays().

    prior has a row for each target, or, with before (ids), one for each id.
    Blocks of windows that caches hold are worked through in turn.
    """
    ready, n, top = Ready(m), len(inputs), float(prior.max()) if before is None else 0.0  # rows by id are logs of probabilities
    share = (live / max(live.sum(), 1)).astype(np.float32)
    back = np.ascontiguousarray(ready.out[:-1].T)
    places = ready.places(inputs)
    d_out = np.zeros_like(ready.out)
    d_s, d_v = np.empty((n, STRIDE, LENGTH), np.float32), np.empty((n, LENGTH, WIDTH), np.float32)
    for a in range(0, n, BLOCK_WINDOWS):
        own = slice(a, a + BLOCK_WINDOWS)
        v = np.take(ready.value, inputs[own], axis=0)
        w = ready.weights(places[own])
        context, scale = ready.context(w, v)
        p = ready.logits(context, _prior_rows(prior, before, own), top)
        np.exp(p, out=p)
        sums = _sums(p)
        p.reshape(-1)[np.arange(len(p)) * p.shape[1] + target[own].ravel()] -= sums[:, 0]
        factor = (share[own].reshape(sums.shape) / sums).reshape(scale.shape)
        few = (-1, STRIDE * (8 if len(w) % 8 == 0 else 1))  # products of small matrices are faster than one over all targets
        d_out += ((context * factor).reshape(*few, WIDTH + 1).transpose(0, 2, 1) @ p.reshape(*few, p.shape[1])).sum(0)
        d_context = np.empty_like(context)
        inner = d_context[:, :, :WIDTH]
        np.multiply((p @ back).reshape(inner.shape), factor * scale, out=inner)
        # With the values' ones, this takes from each weight's gradient what the sum of weights takes.
        d_context[:, :, WIDTH] = -np.einsum("ijk,ijk->ij", inner, context[:, :, :WIDTH])
        np.matmul(d_context, np.ascontiguousarray(v.transpose(0, 2, 1)), out=d_s[own])
        d_s[own] *= w
        np.matmul(w.transpose(0, 2, 1), inner, out=d_v[own])
    d_distance = np.ones(n, np.float32) @ d_s.reshape(n, -1)
    d_pairs = np.bincount(places.ravel(), weights=d_s.ravel(), minlength=ready.size**2).reshape(ready.size, ready.size)
    d_pairs = d_pairs.astype(np.float32) * np.float32(WIDTH**-0.5)
    return [d_pairs @ m.key, d_pairs.T @ m.query, _by_embedding(inputs, d_v, ready.size), d_out[:-1], d_out[-1], d_distance.reshape(m.distance.shape)]


def _by_embedding(inputs: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by embedding; those of padding are 0, so that it may fall together with another."""
    small = inputs.ravel().astype(np.uint8 if size <= 257 else np.int16)
    order = np.argsort(small, kind="stable")
    stops = np.cumsum(np.bincount(small, minlength=size)).tolist()
    rows, out = np.take(rows.reshape(-1, rows.shape[2]), order, axis=0), np.zeros((size, rows.shape[2]), np.float32)
    ones = np.ones(len(order), np.float32)
    for i, (a, b) in enumerate(zip([0, *stops], stops)):
        if a < b:
            np.dot(ones[a:b], rows[a:b], out=out[i])
    return out


@dataclass
class Adam:
    """Steps of Adam over a list of arrays, with a decreasing rate."""

    size: int
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)
    t: int = 0

    def __post_init__(self) -> None:
        self.m, self.v = np.zeros(self.size, np.float32), np.zeros(self.size, np.float32)

    def step(self, grads: list[np.ndarray], rate: float) -> np.ndarray:
        g = np.concatenate([x.ravel() for x in grads])
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        return rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


# --- windows ---------------------------------------------------------------


def windows(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, live, owner) of the sequences' windows.

    inputs (n, LENGTH) are ids shifted by one (the end id comes first), -1
    pads; targets (n, STRIDE) follow the last STRIDE inputs; live marks real
    ones; owner tells the sequence.
    """
    lead, parts, starts, owner, at = LENGTH - STRIDE, [], [], [], 0
    for i, s in enumerate(sequences):
        n = -(-(len(s) + 1) // STRIDE)
        block = np.full(lead + n * STRIDE + 1, -1, np.int64)
        block[lead] = end
        block[lead + 1 : lead + 1 + len(s)] = s
        block[lead + 1 + len(s)] = end
        parts.append(block)
        starts.append(at + np.arange(n) * STRIDE)
        owner.append(np.full(n, i))
        at += len(block)
    flat, starts = np.concatenate(parts), np.concatenate(starts)
    x = flat[starts[:, None] + np.arange(LENGTH)]
    y = flat[starts[:, None] + np.arange(lead + 1, LENGTH + 1)]
    return x, y, y >= 0, np.concatenate(owner)


# --- counts and tables -----------------------------------------------------


@dataclass
class Tables:
    """Class map and count tables; all bounded by the vocabulary, CLASSES and PAIRS.

    Class map, prior, within and pair_class are of all pairs, pair_count of
    the kept ones; what the others add to a score is joined (rare_pairs).
    """

    end: int
    class_of: np.ndarray  # by id; the last entry (index -1) is the padding class
    input_of: np.ndarray  # the embedding of each id in a context: own ones for the most frequent, one a class for others; the last entry is padding
    prior: np.ndarray  # log p(class | previous id), (ids, CLASSES)
    within: np.ndarray  # p(id | its class)
    pair_keys: PerfectHash
    pair_check: np.ndarray
    pair_count: np.ndarray
    pair_class: np.ndarray  # counts of (previous id, class)

    dense: np.ndarray | None = None  # log10 p(id | its class, previous id) over the ids in use
    rank: np.ndarray | None = None  # of the ids in use; -1 for others

    def emission(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """log10 p(id | its class, previous id)."""
        if self.dense is None:
            return self._looked_up(before, now)
        i, j = self.rank[before], self.rank[now]
        out = np.take(self.dense, i * len(self.dense) + j, mode="clip").astype(np.float64)
        rare = np.flatnonzero((i < 0) | (j < 0))
        if len(rare):
            out[rare] = self._looked_up(before[rare], now[rare])
        return out

    def kept(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are in the table, and their places."""
        at = self.pair_keys.positions(key.astype(np.uint64))
        return (at >= 0) & (self.pair_check[at] == key), at

    def _looked_up(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        found, at = self.kept(before * len(self.within) + now)
        count = np.where(found, self.pair_count[at], 0.0)
        return np.log10((count + PAIR_PRIOR * self.within[now]) / (self.pair_class[before, self.class_of[now]] + PAIR_PRIOR))

    def fill(self, previous: np.ndarray, now: np.ndarray, n: np.ndarray) -> None:
        """Make the dense table if the ids in use are few enough."""
        used = np.union1d(previous, now)
        if not len(used) or len(used) ** 2 > DENSE_CELLS:
            return
        self.rank = np.full(len(self.within), -1, np.int64)
        self.rank[used] = np.arange(len(used))
        counts = np.broadcast_to((PAIR_PRIOR * self.within[used]).astype(np.float32), (len(used), len(used))).copy()
        counts[self.rank[previous], self.rank[now]] += n
        counts /= self.pair_class[used][:, self.class_of[used]] + np.float32(PAIR_PRIOR)
        self.dense = np.log10(counts)


def pair_counts(tokens: DataFrame, end: int, vocabulary: int) -> DataFrame:
    """(pair, n): how often an id follows another in the training documents; pair is previous * vocabulary + id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for ids in batch.column(0):
                s = np.frombuffer(ids.as_buffer(), np.uint16)
                held += [s, np.array([end], np.uint16)]
                size += len(s) + 1
                if size > 2_000_000:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        s = np.concatenate([np.array([end], np.uint16), *parts])
        used = np.unique(s) if len(s) < 1 << 16 else np.flatnonzero(np.bincount(s))
        small = np.zeros(vocabulary, np.int64)
        small[used] = np.arange(len(used))
        x = small[s]
        keys = x[:-1] * len(used) + x[1:]
        if len(used) <= 3000:
            cells = np.bincount(keys, minlength=0)
            u = np.flatnonzero(cells)
            n = cells[u]
        else:
            u, n = np.unique(keys, return_counts=True)
        pairs = used[u // len(used)].astype(np.int64) * vocabulary + used[u % len(used)]
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    return tokens.select("ids").mapInArrow(arrow_task(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def top_by_count(counts: DataFrame, key: str, most: int) -> tuple[pa.Table, int]:
    """The rows whose count is at least the least threshold that leaves `most` rows or fewer, and the threshold."""
    # Distinct counts below the bound: a table of small numbers, one row per power of 2^(1/8).
    bucket = F.floor(8 * F.log2("n")).cast("long")
    sizes = sorted(((r.b, r.k) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for b, k in sizes:
        if total + k > most:
            break
        total, least = total + k, b
    if least is None:
        return pa.table({key: pa.array([], pa.int64()), "n": pa.array([], pa.int64())}), 1 << 62
    threshold = int(np.ceil(2 ** (least / 8) - 1e-9))
    return counts.filter(bucket >= least).select(key, "n").toArrow(), threshold  # at most `most` rows


@dataclass
class Totals:
    """What all pairs add up to; bounded by the vocabulary and CLASSES."""

    class_of: np.ndarray
    now: np.ndarray  # occurrences by id
    pair_class: np.ndarray  # by previous id and class


def frequent_ids(total: np.ndarray) -> np.ndarray:
    return np.argsort(-total, kind="stable")[:FEATURES]


def cluster(total: np.ndarray, active: np.ndarray, after: np.ndarray, before: np.ndarray, classes: int = CLASSES, rounds: int = 15) -> np.ndarray:
    """Classes of ids by the frequent ids that stand beside them: weighted k-means.

    after and before (active ids, FEATURES + 1) count the frequent ids, and
    all others in the last column, that follow and precede.
    """
    vocabulary, width = len(total), FEATURES + 1
    x = np.sqrt(np.concatenate([after, before], 1) / np.maximum(total[active], 1)[:, None]).astype(np.float32)
    weight = np.sqrt(total[active]).astype(np.float32) + 1e-3
    centre = x[np.argsort(-total[active], kind="stable")[:classes]].copy()
    if len(centre) < classes:
        centre = np.concatenate([centre, np.full((classes - len(centre), 2 * width), 9, np.float32)])
    for _ in range(rounds):
        label = ((centre**2).sum(1)[None] - 2 * x @ centre.T).argmin(1)
        for c in np.unique(label):
            own = label == c
            centre[c] = weight[own] @ x[own] / weight[own].sum()
    out = np.full(vocabulary + 1, classes - 1, np.int64)
    out[active] = label if len(active) else 0
    out[-1] = classes
    return out


def inputs_of(class_of: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Embedding numbers by id, the padding's last."""
    out = OWN_INPUTS + class_of
    own = np.argsort(-total, kind="stable")[:OWN_INPUTS]
    out[own] = np.arange(len(own))
    return out  # class CLASSES is padding and becomes INPUTS


def totals_of(previous: np.ndarray, now: np.ndarray, n: np.ndarray, vocabulary: int) -> Totals:
    """Totals where all pairs are at hand."""
    total = np.bincount(now, weights=n, minlength=vocabulary)
    active = np.flatnonzero(total + np.bincount(previous, weights=n, minlength=vocabulary) > 0)
    feature = np.full(vocabulary, FEATURES)
    frequent = frequent_ids(total)
    feature[frequent] = np.arange(len(frequent))
    small = np.zeros(vocabulary, np.int64)
    small[active] = np.arange(len(active))
    width = FEATURES + 1
    after = np.bincount(small[previous] * width + feature[now], weights=n, minlength=len(active) * width).reshape(-1, width)
    before = np.bincount(small[now] * width + feature[previous], weights=n, minlength=len(active) * width).reshape(-1, width)
    class_of = cluster(total, active, after, before)
    pair_class = np.bincount(previous * CLASSES + class_of[now], weights=n, minlength=vocabulary * CLASSES).reshape(vocabulary, CLASSES)
    return Totals(class_of, total, pair_class)


def corpus_totals(counts: DataFrame, vocabulary: int) -> Totals:
    """Totals of a table of pair counts that the driver doesn't hold; what comes to it is bounded by the vocabulary."""
    spark = counts.sparkSession
    split = counts.selectExpr(f"pair div {vocabulary} AS previous", f"pair % {vocabulary} AS now", "n")

    def summed(df: DataFrame, *keys: str) -> list[np.ndarray]:
        return [c.to_numpy() for c in df.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, "n").toArrow().columns]

    def mapped(key: str, ids: np.ndarray, to: np.ndarray) -> DataFrame:
        names = spark.createDataFrame(pa.table({key: ids.astype(np.int64), "to": to.astype(np.int64)}))
        return split.join(F.broadcast(names), key, "left")  # at most vocabulary rows

    total, leads = np.zeros(vocabulary), np.zeros(vocabulary)
    for key, out in (("now", total), ("previous", leads)):
        ids, n = summed(split, key)
        out[ids] = n
    active = np.flatnonzero(total + leads > 0)
    frequent = frequent_ids(total)
    beside = []
    for own, other in (("previous", "now"), ("now", "previous")):
        ids, to, n = summed(mapped(other, frequent, np.arange(len(frequent))).fillna(FEATURES, ["to"]), own, "to")
        cells = np.zeros((len(active), FEATURES + 1))
        cells[np.searchsorted(active, ids), to] = n
        beside.append(cells)
    class_of = cluster(total, active, *beside)
    pair_class = np.zeros((vocabulary, CLASSES))
    ids, to, n = summed(mapped("now", active, class_of[active]), "previous", "to")
    pair_class[ids, to] = n
    return Totals(class_of, total, pair_class)


def build_tables(pairs: pa.Table, end: int, vocabulary: int, totals: Totals | None = None) -> Tables:
    """Tables with the counts of pairs; totals are of all pairs, of which these are some (all, where None)."""
    key, n = pairs.column(0).to_numpy().astype(np.int64), pairs.column(1).to_numpy().astype(np.float64)
    previous, now = key // vocabulary, key % vocabulary
    t = totals or totals_of(previous, now, n, vocabulary)
    class_of, pair_class = t.class_of, t.pair_class
    total = t.now + 0.1
    within = total / np.bincount(class_of[:-1], weights=total, minlength=CLASSES)[class_of[:-1]]
    share = np.bincount(class_of[:-1], weights=total, minlength=CLASSES) / total.sum()
    share = (share + 1e-9) / (share + 1e-9).sum()
    prior = np.log((pair_class + CLASS_PRIOR * share) / (pair_class.sum(1, keepdims=True) + CLASS_PRIOR))
    hash_ = PerfectHash.build(key.astype(np.uint64))
    at = hash_.positions(key.astype(np.uint64))
    check, count = np.full(max(len(key), 1), -1, np.int64), np.zeros(max(len(key), 1))
    check[at], count[at] = key, n
    tables = Tables(end, class_of, inputs_of(class_of, t.now), prior.astype(np.float32), within, hash_, check, count, pair_class.astype(np.float32))
    tables.fill(previous, now, n)
    return tables


# --- training and scoring --------------------------------------------------


def train(m: Attention, tables: Tables, x: np.ndarray, y: np.ndarray, live: np.ndarray, adam: Adam, rate: float) -> Attention:
    """One step on a batch of windows of ids."""
    grads = gradients(m, tables.input_of[x], tables.class_of[y] * live, live, tables.prior, x[:, -STRIDE:])
    return m.filled(m.flat() - adam.step(grads, rate))


def start_training(tables: Tables, sequences: list[np.ndarray], steps: int = START_STEPS) -> Attention:
    m = Attention.start()
    if not sequences:
        return m
    x, y, live, _ = windows(sequences, tables.end)
    rng, adam = np.random.default_rng(3), Adam(m.flat().size)
    for step in range(steps):
        at = rng.integers(0, len(x), STEP_WINDOWS)
        m = train(m, tables, x[at], y[at], live[at], adam, 5 * RATE * (1 - 0.8 * step / steps))
    return m


def log10_classes(m: Attention, inputs: np.ndarray, prior: np.ndarray, target: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probabilities that attend() gives the target classes; prior and before as in gradients()."""
    ready, top = Ready(m), float(prior.max()) if before is None else 0.0
    out = np.empty(target.shape)
    for a in range(0, len(inputs), BLOCK_WINDOWS):
        own = slice(a, a + BLOCK_WINDOWS)
        context, _ = ready.context(ready.weights(ready.places(inputs[own])), np.take(ready.value, inputs[own], axis=0))
        logits = ready.logits(context, _prior_rows(prior, before, own), top)
        picked = np.take(logits, np.arange(len(logits)) * logits.shape[1] + target[own].ravel())
        np.exp(logits, out=logits)
        out[own] = ((picked - np.log(_sums(logits)[:, 0])) / np.log(10)).reshape(target[own].shape)
    return out


def rare_pairs(tables: Tables, sequence: np.ndarray) -> np.ndarray:
    """The pairs of a sequence, its end included, that are not in the table."""
    s = np.concatenate([[tables.end], sequence, [tables.end]]).astype(np.int64)
    key = s[:-1] * len(tables.within) + s[1:]
    return key[~tables.kept(key)[0]]


def log10_probabilities(m: Attention, tables: Tables, sequences: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of each sequence, its end included; pairs that are not in the table count as never seen."""
    out = np.zeros(len(sequences))
    x, y, live, owner = windows(sequences, tables.end)
    for a in range(0, len(x), SCORE_WINDOWS):
        own, target, ok = x[a : a + SCORE_WINDOWS], y[a : a + SCORE_WINDOWS], live[a : a + SCORE_WINDOWS]
        classes = log10_classes(m, tables.input_of[own], tables.prior, tables.class_of[target] * ok, own[:, -STRIDE:])
        logs = (classes + tables.emission((own[:, -STRIDE:] * ok).ravel(), (target * ok).ravel()).reshape(ok.shape)) * ok
        out += np.bincount(owner[a : a + SCORE_WINDOWS], weights=logs.sum(1), minlength=len(sequences))
    return out


def train_everywhere(tokens: DataFrame, tables, start: Attention) -> Attention:
    """Train from `start` on all windows of all training documents, by partition, and average by targets."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, t = start, tables.value
        adam, seen, step = Adam(m.flat().size), 0, 0
        held: list[np.ndarray] = []
        rows = 0

        def learn() -> None:
            nonlocal m, seen, step
            x, y, live, _ = windows(held, t.end)
            order = np.random.default_rng(step).permutation(len(x))
            for a in range(0, len(x), STEP_WINDOWS):
                at = order[a : a + STEP_WINDOWS]
                m = train(m, t, x[at], y[at], live[at], adam, RATE / (1 + step / 200))
                seen, step = seen + int(live[at].sum()), step + 1

        for batch in batches:
            for ids in batch.column(0):
                held.append(np.frombuffer(ids.as_buffer(), np.uint16))
                rows += -(-(len(held[-1]) + 1) // STRIDE)
                if rows >= 64 * STEP_WINDOWS:
                    learn()
                    held, rows = [], 0
        if held:
            learn()
        if seen:
            flat = m.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * seen), pa.array(np.full(len(flat), seen, np.float64))], ["i", "wv", "w"])

    parts = tokens.select("ids").mapInArrow(arrow_task(local), "i long, wv double, w double").groupBy("i").agg((F.sum("wv") / F.sum("w")).alias("v"))
    rows = parts.toArrow()  # one row per parameter
    if not rows.num_rows:
        return start
    flat = np.zeros(start.flat().size)
    flat[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return start.filled(flat)


def encode_documents(docs: DataFrame, tokenizer: str, baseline: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """(row, doc_id, held_out, ids, n_tokens, n_known, base_score, rest), ids as 16-bit numbers; baseline gives the last four of texts' word hashes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        whole = encoder(tokenizer, "ids") if words is None else None
        for batch in batches:
            data, offsets = column_bytes(batch.column(3))
            for a, b in row_slices(offsets, SLICE_BYTES):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if words is None:
                    hashes, bounds = _word_hashes(own, at)
                    texts = whole.texts([own[x:y].tobytes() for x, y in zip(at, at[1:])])
                    ids = pa.array([np.frombuffer(b"".join(parts), np.uint32).astype(np.uint16).tobytes() for parts in texts], pa.binary())
                else:
                    flat, begins, hashes, bounds = words.batch(own, at)
                    ids = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((2 * begins).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:3], ids, *baseline(hashes, bounds)], TOKENS)

    schema = "row string, doc_id long, held_out boolean, ids binary, n_tokens long, n_known long, base_score double, rest array<long>"
    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(arrow_task(encode), schema)


# --- the word baseline -----------------------------------------------------


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets)
    return word_hashes(low, starts, ends).view(np.int64), bounds


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n): occurrences of each word (its 64-bit hash) in all training texts, without ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for a, b in row_slices(offsets, SLICE_BYTES):
                held.append(_word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0])
                size += len(held[-1])
                if size > 6_000_000:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], ["word", "n"])

    return training.select("text").mapInArrow(arrow_task(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class WordCounts:
    """Add-one counts of words: those of the HOT_WORDS most frequent travel with functions, the other words of texts meet theirs in a join."""

    counts: DataFrame
    ends: int  # training documents
    n_all: int
    low: float
    least: int  # count of the words that travel
    shared: object

    @classmethod
    def of(cls, counts: DataFrame, ends: int) -> WordCounts:
        total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        n_all, distinct = (total.n or 0) + ends, total.v + (ends > 0)
        low = float(np.log10(n_all + distinct + 1))
        hot, _ = top_by_count(counts, "word", HOT_WORDS)
        keys = hot.column(0).to_numpy().astype(np.int64)
        hash_ = PerfectHash.build(keys.view(np.uint64))
        at = hash_.positions(keys.view(np.uint64))
        check, logs = np.zeros(max(len(keys), 1), np.int64), np.zeros(max(len(keys), 1))
        check[at], logs[at] = keys, np.log10(hot.column(1).to_numpy() + 1.0) - low
        least = int(hot.column(1).to_numpy().min()) if len(keys) else 1 << 62
        shared = counts.sparkSession.sparkContext.broadcast((hash_, check, logs, len(keys)))  # at most HOT_WORDS entries
        return cls(counts, ends, n_all, low, least, shared)

    def baseline(self) -> Callable[[np.ndarray, np.ndarray], list[pa.Array]]:
        """A function to n_tokens, n_known, base_score and the words that are still to be joined, of texts' word hashes."""
        shared, ends, end_log = self.shared, self.ends, float(np.log10(self.ends + 1) - self.low)

        def score(hashes: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
            hash_, check, logs, size = shared.value
            words = hashes.view(np.int64)
            at = hash_.positions(words.view(np.uint64)) if size else np.full(len(words), -1)
            found = (at >= 0) & (check[at] == words)
            sums = np.zeros(len(words) + 1)
            np.cumsum(np.where(found, logs[at], 0), out=sums[1:])
            known = np.zeros(len(words) + 1, np.int64)
            np.cumsum(found, out=known[1:])
            missing = np.flatnonzero(~found)
            return [
                pa.array(np.diff(bounds) + 1),
                pa.array(known[bounds[1:]] - known[bounds[:-1]] + (ends > 0)),
                pa.array(sums[bounds[1:]] - sums[bounds[:-1]] + end_log),
                pa.ListArray.from_arrays(np.searchsorted(missing, bounds).astype(np.int32), pa.array(words[missing])),
            ]

        return score

    def joined(self, first: DataFrame) -> DataFrame:
        """(row, n_tokens, n_known, base_score): first with what the joined words add."""
        low = self.low
        rare = self.counts.filter(F.col("n") < self.least) if self.least < 1 << 62 else self.counts
        missing = first.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("k"))
        met = missing.join(rare, "word", "left").select("row", "k", F.coalesce("n", F.lit(0)).alias("n"))
        extra = met.groupBy("row").agg(F.sum(F.col("k") * (F.log10(F.col("n") + 1.0) - low)).alias("_base"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("_known"))
        # Equal rows share a name, so what the join adds up for them is divided among them.
        named = first.groupBy("row").agg(F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"), F.max("base_score").alias("base_score"), F.count("*").alias("_rows"))
        return named.join(extra, "row", "left").select(
            "row",
            "n_tokens",
            (F.col("n_known") + F.coalesce(F.expr("_known div _rows"), F.lit(0))).alias("n_known"),
            (F.col("base_score") + F.coalesce(F.col("_base") / F.col("_rows"), F.lit(0.0))).alias("base_score"),
        )


# --- pairs beyond the table ---------------------------------------------------


def rare_gain(first: DataFrame, counts: DataFrame, pairs: pa.Table, tables: Tables) -> DataFrame:
    """(row, _gain): what the counts of the pairs in `rest` add to a row's score.

    A pair's count n changes log10((0 + a) / b) into log10((n + a) / b) with
    a = PAIR_PRIOR * within, so it adds log10(1 + n / a).
    """
    spark, vocabulary = first.sparkSession, len(tables.within)
    rare = counts.filter(F.col("n") < int(pairs.column(1).to_numpy().min())) if pairs.num_rows else counts
    met = first.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("k")).join(rare, "pair")
    within = spark.createDataFrame(pa.table({"now": np.arange(vocabulary), "a": PAIR_PRIOR * tables.within}))
    met = met.withColumn("now", F.col("pair") % vocabulary).join(F.broadcast(within), "now")  # vocabulary rows
    # Equal rows share a name, so what the join adds up for them is divided among them.
    copies = first.groupBy("row").agg(F.count("*").alias("_rows"))
    gains = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(1 + F.col("n") / F.col("a"))).alias("_sum"))
    return gains.join(copies, "row").select("row", (F.col("_sum") / F.col("_rows")).alias("_gain"))


# --- the operator ----------------------------------------------------------


def lm_scores(docs: DataFrame, tokenizer: str, *, held_out: str = DEFAULT_HELD_OUT, end: int = 49407, vocabulary: int = 49408) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    A null text is empty: one token, its end. Rows of one id are scored and
    counted one by one; a row without an id is scored and not learned from. An
    empty table gives an empty result. Other columns of docs are not read.
    Texts of any length are scored and learned from whole. Ids must fit 16
    bits. Parameters are trained by partition and averaged, so scores (not the
    base's) differ a little with how the table is split.
    """
    if not 0 <= end < vocabulary <= 1 << 16:
        raise ValueError("ids are kept as 16-bit numbers: vocabulary must not exceed 65536")
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(True)))
    # Rows are named by id and content, so that different rows of one id keep apart.
    rows = rows.withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string")))

    counts = materialise(word_counts(rows.filter("NOT held_out")), "words")
    known = WordCounts.of(counts, rows.filter("NOT held_out").count())
    tokens = materialise(encode_documents(rows, tokenizer, known.baseline()), "tokens")
    learned = tokens.filter("NOT held_out")
    base = known.joined(tokens)

    all_pairs = materialise(pair_counts(learned, end, vocabulary), "pairs")
    pairs, _ = top_by_count(all_pairs, "pair", PAIRS)
    whole = pairs.num_rows == all_pairs.count()
    tables = build_tables(pairs, end, vocabulary, None if whole else corpus_totals(all_pairs, vocabulary))
    sample = learned.select("doc_id", "ids").orderBy(F.xxhash64("doc_id"), "doc_id").limit(START_DOCUMENTS).collect()  # at most START_DOCUMENTS rows
    start = start_training(tables, [np.frombuffer(bytes(r.ids), np.uint16) for r in sample])
    shared = spark.sparkContext.broadcast(tables)  # bounded by vocabulary, CLASSES and PAIRS
    model = train_everywhere(learned, shared, start)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(s.as_buffer(), np.uint16) for s in batch.column(3)]
            for a in range(0, len(sequences), 100):
                own = sequences[a : a + 100]
                columns = [*batch.slice(a, 100).columns[:3], pa.array(log10_probabilities(model, shared.value, own))]
                if not whole:
                    columns.append(pa.array([rare_pairs(shared.value, s) for s in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "score", "rest"][: len(columns)])

    encoded = tokens.select("row", "doc_id", "held_out", "ids")
    schema = "row string, doc_id long, held_out boolean, score double"
    if whole:
        scores = encoded.mapInArrow(arrow_task(score), schema)
    else:
        first = materialise(encoded.mapInArrow(arrow_task(score), schema + ", rest array<long>"), "scores")
        scores = first.drop("rest").join(rare_gain(first, all_pairs, pairs, tables), "row", "left")
        scores = scores.withColumn("score", F.col("score") + F.coalesce("_gain", F.lit(0.0))).drop("_gain")
    out = scores.join(base, "row")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.n_all).cast("long").alias("train_tokens"), "base_score", "score")
