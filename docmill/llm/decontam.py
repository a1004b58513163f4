"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items (over word numbers) is small and
bounded; every training text streams through it, which gives at each word the
longest match that ends there. No shuffle: texts are read once, where they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docmill.llm.tasks import arrow_task, bounded_batches, free_name
from docmill.llm.tokens import text_batches
from docmill.llm.workspace import materialise

WINDOW = 10
MAX_COVERAGE = 0.8  # a document with a larger share of matched words goes as a whole
AUTOMATON_WORDS = 500_000  # of items in one automaton; more items make more automata, passed one after the other

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_built: dict[str, "Automaton"] = {}

Finish = Callable[[pa.RecordBatch, list[bytes], list[int], list[list[tuple[int, int]]], list[list[str]]], pa.RecordBatch]


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII bytes."""
    return text.translate(_NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items_of: dict[tuple, set[str]] = {}
        short = []
        for item, words in items:
            if not words:
                continue
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            last = 0
            for x in ids:
                last = self._extend(last, x)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                self.items_of.setdefault(tuple(ids[i : i + size]), set()).add(item)
            if len(ids) < window:
                short.append(ids)
        # The whole short items that are suffixes of what a state matches.
        own: dict[int, set[int]] = {}
        for ids in short:
            s = 0
            for x in ids:
                s = self.next[s][x]
            own.setdefault(s, set()).add(len(ids))
        self.short: list[tuple[int, ...]] = [()] * len(self.next)
        if own:
            for s in sorted(range(len(self.next)), key=self.length.__getitem__):
                above = self.short[self.link[s]] if s else ()
                self.short[s] = tuple(sorted({*above, *own[s]})) if s in own else above
        self.least = min([window, *map(len, short)])

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, x: int) -> int:
        """The state of the longest string of p followed by x, cut off from longer ones if need be."""
        q = self.next[p][x]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            return self._split(last, x)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, x)
        return state

    def track(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (first, end) ranges of matched words of one text, and the items matched."""
        following, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        ids = list(map(self.number.get, words))
        state = matched = 0
        for i, x in enumerate(ids):
            if x is None:
                state = matched = 0
                continue
            step = following[state].get(x)
            if step is None:
                while state and step is None:
                    state = link[state]
                    step = following[state].get(x)
                matched = length[state]
                if step is None:
                    state = matched = 0
                    continue
            state = step
            matched += 1
            if matched >= window or short[state]:
                sizes = [m for m in short[state] if m <= matched]
                if matched >= window:
                    sizes.append(window)
                for m in sizes:
                    items |= self.items_of[tuple(ids[i - m + 1 : i + 1])]
                if sizes:
                    start = i + 1 - max(sizes)
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items


def item_groups(items: DataFrame, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' words in groups of about `most` words, one after the other: the driver holds this one and the next at most."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    words = rows.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    groups = -(-words // most)
    if groups > 1:
        rows = materialise(rows.withColumn("_group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))), "items")
    for k in range(groups):
        own = rows.filter(F.col("_group") == k) if groups > 1 else rows
        group = [(r.item_id, words) for r in own.select("item_id", "text").collect() if (words := normal_words(r.text.encode()))]
        if group:
            yield group


def track_matches(docs: DataFrame, items: DataFrame, finish: Finish, schema: str | T.StructType, *, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """What `finish` makes of each batch of docs, given its texts and their word counts, matched word ranges and items.

    A null text has no words. An item of fewer words than the window is one
    window; null or wordless items match nothing; equal items all count.
    Empty tables, repeated rows and null ids need nothing special: every row
    is judged by itself, and all columns of docs reach `finish`.
    """
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    names = docs.columns
    groups = item_groups(items, automaton_words)
    group, following = next(groups, []), next(groups, None)
    rows, extra, several = docs, (free_name(docs, "_spans"), free_name(docs, "_items")), following is not None
    if several:
        rows = docs.withColumns({extra[0]: F.array().cast("array<long>"), extra[1]: F.array().cast("array<string>")})
    while True:
        last = following is None
        shared = context.broadcast((uuid.uuid4().hex, group, window))  # about automaton_words words

        def track(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            key, group, window = shared.value
            if key not in _built:
                _built.clear()
                _built[key] = Automaton(group, window)
            automaton = _built[key]
            for batch in batches:
                before = [batch.column(batch.schema.get_field_index(c)) if several else None for c in extra]
                for a, b, texts in text_batches(batch, "text"):
                    counts, all_spans, all_items = [], [], []
                    for i, text in enumerate(texts):
                        words = normal_words(text)
                        spans, found = automaton.track(words) if len(words) >= automaton.least else ((), ())
                        if before[0] is not None:
                            spans = merge_spans(before[0][a + i].as_py() + [x for s in spans for x in s])
                            found = {*before[1][a + i].as_py(), *found}
                        counts.append(len(words))
                        all_spans.append(spans)
                        all_items.append(sorted(found))
                    own = pa.RecordBatch.from_arrays(batch.slice(a, b - a).columns[: len(names)], names)
                    if last:
                        yield finish(own, texts, counts, all_spans, all_items)
                    else:
                        flat = pa.array([[x for s in spans for x in s] for spans in all_spans], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([*own.columns, flat, pa.array(all_items, pa.list_(pa.string()))], [*names, *extra])

        if last:
            return rows.mapInArrow(arrow_task(track), schema)
        rows = materialise(rows.mapInArrow(arrow_task(track), rows.schema), "tracked")
        shared.unpersist()
        group, following = following, next(groups, None)


def merge_spans(flat: list[int]) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges from (first, end, first, end, ...)."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside matched windows), items (ids, sorted as strings) of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def told(own: pa.RecordBatch, texts: list[bytes], counts: list[int], spans: list, items: list) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in s) for s in spans]
        return pa.RecordBatch.from_arrays([own.column(0), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return track_matches(rows, items, told, "doc_id long, n_words long, n_hit long, items array<string>", window=window)


def remove_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, done = [], 0
    for first, end in spans:
        out.append(text[done : at[first][0]])
        done = at[end - 1][1]
    return b"".join([*out, text[done:]])


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The rows of docs with matched spans cut out of text; rows matched by more than max_coverage of their words go."""

    def cut(own: pa.RecordBatch, texts: list[bytes], counts: list[int], spans: list, items: list) -> pa.RecordBatch:
        at = own.schema.get_field_index("text")
        keep = [not s or sum(b - a for a, b in s) <= max_coverage * n for s, n in zip(spans, counts, strict=True)]
        new = own.column(at)
        if any(spans):
            old = new.to_pylist()
            new = pa.array([remove_words(t, s).decode() if s else o for t, s, o in zip(texts, spans, old, strict=True)], new.type)
        columns = [new if c == at else own.column(c) for c in range(own.num_columns)]
        return pa.RecordBatch.from_arrays(columns, own.schema.names).filter(pa.array(keep, pa.bool_()))

    return track_matches(docs, items, cut, docs.schema, window=window)
