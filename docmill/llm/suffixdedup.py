"""Removal of repeated byte strings with suffix arrays.

Every string of SPAN bytes has an anchor, the smallest hash among its
GRAM-byte substrings, and equal strings have equal anchors. Texts are packed
into blocks. A block asks each shard of anchors which of its anchors several
documents hold; only around those, texts are cut into segments (all strings of
one anchor in a row). A block sends each distinct segment once, whole, so
equality is that of bytes. Where segments of one anchor differ, suffix arrays
over what they may share bring equal strings together; the smallest document
of each string goes back to the blocks, which cut their texts.

What is sent for one anchor is at most its distinct segments of each block. An
anchor of very many segments is given up for finer ones: each of its strings
becomes a segment with the string's own hash as anchor, which spreads strings
that differ over all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from docmill.llm.gsaca import suffix_array
from docmill.llm.tasks import arrow_task, bounded_batches
from docmill.llm.textkernel import column_bytes, mix, prefix_hashes, row_slices, span_hashes
from docmill.llm.workspace import discard, materialise

SPAN = 50
GRAM = 24
SLICE_BYTES = 1 << 18  # of text in one row of the packed table; longer texts are split into overlapping parts
SLICE_ROWS = 60_000
BLOCKS = 512  # about so many blocks, as long as they stay within the next two sizes
LEAST_BLOCK, MOST_BLOCK = 1 << 20, 32 << 20
SHARD_BYTES = 24 << 20  # of text behind a shard of anchors, and 1/SEGMENT_SHARDS of it behind one of segments
SEGMENT_SHARDS = 2
TASK_BYTES = 16 << 20  # of text in a task
MOST_TASKS = 20_000
HOT = 4000  # segments of an anchor beyond which its strings go by their own hashes
CHUNK_BYTES = 1 << 20  # of segments whose strings are looked at together
SORT_BYTES = 1 << 14  # of strings in one suffix array; a larger group of one anchor stands alone


# --- packed texts ------------------------------------------------------------


class Slice:
    """Texts of one row of the packed table: `ids` and `valid` by row, bytes of row i at offsets[i]:offsets[i + 1]; packed compresses data."""

    def __init__(self, part: int, parts: int, ids: bytes, valid: bytes, offsets: bytes, data: bytes):
        self.part, self.parts = part, parts
        self.ids, self.valid = np.frombuffer(ids, np.int64), np.frombuffer(valid, bool)
        self.offsets = np.frombuffer(offsets, np.int64)
        self.data = np.frombuffer(pa.decompress(data, int(self.offsets[-1]), "zstd", asbytes=True), np.uint8)


SLICE = ("part", "parts", "ids", "valid", "offsets", "data")
_SLICE_SCHEMA = "part int, parts int, ids binary, valid binary, offsets binary, data binary"


def pack(docs: DataFrame, block_bytes: int, span: int) -> DataFrame:
    """(block, slice, *SLICE): the rows of docs (doc_id, text) in slices, a block being some slices in a row.

    A text longer than a slice is a run of slices of one block, each with the
    first span - 1 bytes of the next.
    """

    def parts_of(data: np.ndarray) -> list[np.ndarray]:
        starts = range(0, max(1, len(data) - span + 1), SLICE_BYTES)
        return [data[s : s + SLICE_BYTES + span - 1] for s in starts]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        number = 0
        for batch in batches:
            valid = np.array(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            data, offsets = column_bytes(batch.column(1))
            for a, b in row_slices(offsets, SLICE_BYTES):
                for x in range(a, b, SLICE_ROWS):
                    y = min(b, x + SLICE_ROWS)
                    own = data[offsets[x] : offsets[y]]
                    parts = parts_of(own) if len(own) > SLICE_BYTES + span and y == x + 1 else [own]
                    for k, part in enumerate(parts):
                        at = offsets[x : y + 1] - offsets[x] if len(parts) == 1 else np.array([0, len(part)])
                        row = (block, number, k, len(parts), ids[x:y].tobytes(), valid[x:y].tobytes(), at.astype(np.int64).tobytes(), pa.compress(part.tobytes(), "zstd", asbytes=True))
                        number += 1
                        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("block", "slice", *SLICE), row, strict=True)}, packed_schema)
                    size += len(own)
                    if size >= block_bytes:
                        block, size = block + 1, 0

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    packed_schema = pa.schema(list(zip(("block", "slice", *SLICE), kinds, strict=True)))
    return docs.mapInArrow(arrow_task(packed), f"block long, slice int, {_SLICE_SCHEMA}")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, binary values as buffers."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: (v.as_buffer() if v.is_valid else None) if pa.types.is_binary(v.type) else v.as_py() for n, v in zip(batch.schema.names, (c[i] for c in batch.columns), strict=True)}


def _slice(row: dict) -> Slice:
    return Slice(*(row[n] for n in SLICE))


def _batch(columns: dict[str, tuple[list | np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


# --- segments ----------------------------------------------------------------


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    out, k = h, 1
    while 2 * k <= width:
        out = np.minimum(out[: len(out) - k], out[k:])
        k *= 2
    if k < width:
        n = len(h) - width + 1
        out = np.minimum(out[:n], out[width - k : width - k + n])
    return out


def segments(s: Slice, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, row, start, end, sums) of maximal runs of span-byte strings of one anchor; data[start:end] is the segment.

    Rows without an id have none. sums are the prefix hashes of the data.
    """
    empty = np.zeros(0, np.int64)
    if len(s.data) < span:
        return empty.astype(np.uint64), empty, empty, empty, empty
    sums = prefix_hashes(s.data)
    at = np.arange(len(s.data) - gram + 1)
    anchor = _least(span_hashes(sums, at, at + gram), span - gram + 1)
    row = np.repeat(np.arange(len(s.ids)), np.diff(s.offsets))
    string = np.flatnonzero((row[: len(anchor)] == row[span - 1 :]) & s.valid[row[: len(anchor)]])
    if not len(string):
        return empty.astype(np.uint64), empty, empty, empty, sums
    a, r = anchor[string], row[string]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (r[1:] != r[:-1])])
    last = np.r_[new[1:], len(string)] - 1
    return mix(a[new]), r[new], string[new], string[last] + span, sums


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; shards are ranges of keys."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _edges(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the length."""
    return np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)


# --- which anchors do several documents hold? -----------------------------------


def send_anchors(blocks: DataFrame, shards: int, span: int, gram: int) -> DataFrame:
    """(shard, block, keys, first, n): a block's distinct anchors for a shard, as packed arrays.

    first is the smallest document, n the number of segments, negative if
    they are of several documents.
    """

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, low, high, n = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(key)
        at = _edges(key[order])[:-1]
        if not len(at):
            return key, low, high, n
        return key[order][at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), np.add.reduceat(n[order], at)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groupby(_rows(batches), lambda r: r["block"]):
            parts = []
            for r in rows:
                s = _slice(r)
                key, row, *_ = segments(s, span, gram)
                doc = s.ids[row]
                parts.append(summed([(key, doc, doc, np.ones(len(key), np.int64))]))
            key, low, high, n = summed(parts) if len(parts) > 1 else parts[0]
            n = np.where(low < high, -n, n).clip(-(1 << 31), (1 << 31) - 1).astype(np.int32)
            to = _shard(key, shards)
            at = _edges(to)
            yield _batch(
                {
                    "shard": (to[at[:-1]], pa.int64()),
                    "block": ([block] * (len(at) - 1), pa.int64()),
                    **{name: ([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()) for name, x in (("keys", key), ("first", low), ("n", n))},
                }
            )

    return blocks.select("block", *SLICE).mapInArrow(arrow_task(send), "shard long, block long, keys binary, first binary, n binary")


def repeated_anchors(sent: DataFrame, tasks: int, hot: int) -> DataFrame:
    """(block, keys, hot): the anchors of a block that several documents hold, as packed arrays."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), lambda r: r["shard"]):
            parts = [(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["first"], np.int64), np.frombuffer(r["n"], np.int32), r["block"]) for r in rows]
            key, first, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
            block = np.repeat(np.array([p[3] for p in parts]), [len(p[0]) for p in parts])
            order = np.argsort(key)
            at = _edges(key[order])
            f, m = first[order], n[order].astype(np.int64)
            shared = (np.minimum.reduceat(f, at[:-1]) < np.maximum.reduceat(f, at[:-1])) | (np.minimum.reduceat(m, at[:-1]) < 0)
            many = np.add.reduceat(np.abs(m), at[:-1]) > hot
            size = np.diff(at)
            keep = order[np.repeat(shared, size)]
            is_hot = np.repeat(many, size)[np.repeat(shared, size)]
            by_block = np.argsort(block[keep], kind="stable")
            keep, is_hot = keep[by_block], is_hot[by_block]
            at = _edges(block[keep])
            ranges = list(zip(at[:-1], at[1:]))
            yield _batch(
                {
                    "block": (block[keep][at[:-1]], pa.int64()),
                    "keys": ([key[keep[a:b]].tobytes() for a, b in ranges], pa.binary()),
                    "hot": ([is_hot[a:b].tobytes() for a, b in ranges], pa.binary()),
                }
            )

    return sent.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(arrow_task(find), "block long, keys binary, hot binary")


# --- segments of those anchors ----------------------------------------------------

_SENT = {"shard": pa.int64(), "block": pa.int64(), "slice": pa.int32(), **{n: pa.binary() for n in ("numbers", "keys", "low", "high", "sizes", "data")}}
_SENT_SCHEMA = "shard long, block long, slice int, numbers binary, keys binary, low binary, high binary, sizes binary, data binary"


def cut_segments(blocks: DataFrame, shared: DataFrame, shards: int, tasks: int, span: int, gram: int) -> DataFrame:
    """Rows of two kinds: distinct segments of a block for a shard, and where a slice has them.

    Segments have a number in their block, an anchor, the smallest document
    that holds them in the block, the largest one's distance from it, their
    size and (compressed) bytes. A row without a shard says which segments a slice has: numbers, keys (its row)
    and sizes (where it starts) as packed arrays.
    """

    class Distinct:
        def __init__(self) -> None:
            self.number: dict[bytes, int] = {}
            self.key, self.low, self.high = (np.zeros(1024, t) for t in (np.uint64, np.int64, np.int64))

        def add(self, texts: list[bytes], key: np.ndarray, doc: np.ndarray) -> np.ndarray:
            before = len(self.number)
            number = np.array([self.number.setdefault(t, len(self.number)) for t in texts], np.int64)
            n = len(self.number)
            if n > len(self.key):
                self.key, self.low, self.high = (np.concatenate([x, np.zeros(n, x.dtype)]) for x in (self.key, self.low, self.high))
            self.low[before:n], self.high[before:n] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
            self.key[number] = key
            np.minimum.at(self.low, number, doc)
            np.maximum.at(self.high, number, doc)
            return number

        def send(self, block: int) -> pa.RecordBatch:
            n = len(self.number)
            order = np.argsort(self.key[:n])
            texts = list(self.number)
            to = _shard(self.key[order], shards)
            at = _edges(to)
            rows = []
            for a, b in zip(at[:-1], at[1:]):
                own = order[a:b]
                taken = [texts[i] for i in own.tolist()]
                sizes = np.array([len(t) for t in taken], np.int32)
                low = self.low[own]
                rows.append((own.astype(np.int32).tobytes(), self.key[own].tobytes(), low.tobytes(), (self.high[own] - low).tobytes(), sizes.tobytes(), pa.compress(b"".join(taken), "zstd", asbytes=True)))
            columns = list(zip(*rows)) or [[]] * 6
            head = [to[at[:-1]], [block] * len(rows), [None] * len(rows)]
            return _batch(dict(zip(_SENT, zip([*head, *columns], _SENT.values(), strict=True), strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in groupby(_rows(batches), lambda r: r["block"]):
            asked: list[tuple] = []
            known = is_hot = None
            distinct = Distinct()
            for r in rows:
                if r["slice"] < 0:
                    asked.append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["hot"], bool)))
                    continue
                if not asked:
                    continue
                if known is None:
                    known, is_hot = (np.concatenate(c) for c in zip(*asked))
                    order = np.argsort(known)
                    known, is_hot = known[order], is_hot[order]
                s = _slice(r)
                key, row, start, end, sums = segments(s, span, gram)
                if not len(key):
                    continue
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                match = known[at] == key
                plain, hot = np.flatnonzero(match & ~is_hot[at]), np.flatnonzero(match & is_hot[at])
                key, row, start, end, hot_row, hot_start, hot_end = key[plain], row[plain], start[plain], end[plain], row[hot], start[hot], end[hot]
                if len(hot):  # each string by itself
                    n = hot_end - hot_start - span + 1
                    string = np.repeat(hot_start - np.cumsum(n) + n, n) + np.arange(n.sum())
                    key, row = np.r_[key, mix(span_hashes(sums, string, string + span))], np.r_[row, np.repeat(hot_row, n)]
                    start, end = np.r_[start, string], np.r_[end, string + span]
                raw = s.data.tobytes()
                number = distinct.add([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], key, s.ids[row])
                places = [x.astype(np.int32).tobytes() for x in (number, row, start)]
                yield _batch(dict(zip(_SENT, zip([[None], [block], [r["slice"]], [places[0]], [places[1]], [None], [None], [places[2]], [None]], _SENT.values(), strict=True), strict=True)))
            if distinct.number:
                yield distinct.send(block)

    replies = shared.selectExpr("block", "-1 AS slice", *(f"CAST(NULL AS {t}) AS {n}" for n, t in (x.split() for x in _SLICE_SCHEMA.split(", "))), "keys", "hot")
    texts = blocks.selectExpr("block", "slice", *SLICE, "CAST(NULL AS BINARY) AS keys", "CAST(NULL AS BINARY) AS hot")
    met = replies.union(texts).repartition(tasks, "block").sortWithinPartitions("block", "slice")
    return met.mapInArrow(arrow_task(cut), _SENT_SCHEMA)


# --- equal strings -----------------------------------------------------------------


def smallest_holders(texts: list[bytes], docs: list[int], span: int) -> list[np.ndarray]:
    """For each text the smallest document that holds each of its span-byte strings, by one suffix array over all texts.

    docs[i] is the smallest document that holds texts[i].
    """
    joined = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    firsts = np.cumsum(lengths) - lengths
    symbols = joined.astype(np.int64) + 2  # 1 parts the texts, 0 ends them
    symbols[firsts + lengths - 1] = 1
    order = np.array(suffix_array([*symbols.tolist(), 0]))[1:]
    owner = np.repeat(np.arange(len(texts)), lengths)
    whole = np.arange(len(joined)) + span < (firsts + lengths)[owner]
    order = order[whole[order]]
    strings = joined[order[:, None] + np.arange(span)]
    new = np.r_[True, (strings[1:] != strings[:-1]).any(1)]
    smallest = np.minimum.reduceat(np.array(docs)[owner[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(len(joined), np.int64)
    out[order] = smallest
    return [out[a : a + n - span] for a, n in zip(firsts, lengths, strict=True)]


def _sorted_runs(runs: list[bytes], keys: list[int], least: list[int], span: int) -> list[np.ndarray]:
    """smallest_holders of distinct runs; those of one key are sorted together, and small groups share an array."""
    out: list[np.ndarray | None] = [None] * len(runs)
    order = sorted(range(len(runs)), key=keys.__getitem__)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            for i, values in zip(held, smallest_holders([runs[i] for i in held], [least[i] for i in held], span), strict=True):
                out[i] = values
        held.clear()
        size = 0

    for _, group in groupby(order, keys.__getitem__):
        own = list(group)
        if len(own) == 1:  # one text: its strings are held where it is
            (i,) = own
            out[i] = np.full(len(runs[i]) - span + 1, least[i])
            continue
        if size > SORT_BYTES:
            flush()
        held += own
        size += sum(len(runs[i]) for i in own)
    flush()
    return out


def holders(texts: list[bytes], keys: np.ndarray, least: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, values): the smallest document of each string of each text; texts of a key come in a row.

    Only strings whose hash another string of these texts has can have equal
    ones; the runs of such strings, each different one once, are sorted.
    """
    lengths = np.array([len(t) for t in texts])
    n = lengths - span + 1
    bounds = np.r_[0, np.cumsum(n)]
    owner = np.repeat(np.arange(len(texts)), n)
    values = least[owner]
    data = np.frombuffer(b"".join(texts), np.uint8)
    firsts = np.cumsum(lengths) - lengths
    start = np.arange(len(owner)) + (firsts - bounds[:-1])[owner]
    h = span_hashes(prefix_hashes(data), start, start + span)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    partnered = np.zeros(len(h), bool)
    partnered[order] = np.r_[False, same] | np.r_[same, False]
    edge = np.zeros(len(h) + 1, bool)
    edge[bounds] = True
    opens = np.flatnonzero(partnered & (edge[:-1] | ~np.r_[False, partnered[:-1]]))
    closes = np.flatnonzero(partnered & (edge[1:] | ~np.r_[partnered[1:], False])) + 1
    if not len(opens):
        return bounds, values
    raw = data.tobytes()
    number: dict[bytes, int] = {}
    runs = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(start[opens].tolist(), (start[closes - 1] + span).tolist())])
    first = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(first, runs, least[owner[opens]])
    key = np.zeros(len(number), np.uint64)
    key[runs] = keys[owner[opens]]
    found = _sorted_runs(list(number), key.tolist(), first.tolist(), span)
    values[partnered] = np.concatenate([found[i] for i in runs.tolist()])
    return bounds, values


def find_holders(sent: DataFrame, tasks: int, span: int) -> DataFrame:
    """(block, numbers, starts, ends, docs): smallest documents of strings starts to ends of a block's segments, as packed arrays.

    Strings whose smallest document is no smaller than any of the block's own holders are left out.
    """

    def found(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        number, key, low, high, size = (np.concatenate([np.frombuffer(r[n], t) for r in rows]) for n, t in (("numbers", np.int32), ("keys", np.uint64), ("low", np.int64), ("high", np.int64), ("sizes", np.int32)))
        high = low + high
        block = np.repeat(np.array([r["block"] for r in rows]), [len(r["numbers"]) // 4 for r in rows])
        raw = b"".join(pa.decompress(r["data"], int(np.frombuffer(r["sizes"], np.int32).sum()), "zstd", asbytes=True) for r in rows)
        ends = np.cumsum(size, dtype=np.int64)
        seen: dict[bytes, int] = {}
        text = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip((ends - size).tolist(), ends.tolist())])
        texts = list(seen)
        least, text_key = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), np.uint64)
        np.minimum.at(least, text, low)
        text_key[text] = key
        order = np.argsort(text_key)
        at = _edges(text_key[order])
        alone = np.diff(at) == 1

        # Runs of strings of one smallest document: (text, start, end, document).
        single = order[at[:-1][alone]]
        length = np.array([len(t) for t in texts]) - span + 1
        runs = [(single, np.zeros(len(single), np.int64), length[single], least[single])]
        several = order[np.repeat(~alone, np.diff(at))]
        sizes = np.cumsum(length[several] + span - 1)
        group = np.cumsum(np.r_[False, text_key[several][1:] != text_key[several][:-1]]) if len(several) else several
        a = 0
        while a < len(several):  # some groups, about CHUNK_BYTES together
            b = int(np.searchsorted(sizes, sizes[a] + CHUNK_BYTES, "right"))
            b = int(np.searchsorted(group, group[min(b, len(several)) - 1], "right"))
            own = several[a:b]
            bounds, values = holders([texts[i] for i in own.tolist()], text_key[own], least[own], span)
            edge = np.zeros(len(values), bool)
            edge[bounds[:-1]] = True
            edge[1:] |= values[1:] != values[:-1]
            opens = np.flatnonzero(edge)
            owner = np.searchsorted(bounds, opens, "right") - 1
            runs.append((own[owner], opens - bounds[owner], np.r_[opens[1:], len(values)] - bounds[owner], values[opens]))
            a = b
        run_text, start, end, doc = (np.concatenate(c) for c in zip(*runs))
        by_text = np.argsort(run_text, kind="stable")
        first = np.searchsorted(run_text[by_text], np.arange(len(texts) + 1))

        # Every segment sent gets the runs of its text.
        count = np.diff(first)[text]
        segment = np.repeat(np.arange(len(text)), count)
        run = by_text[np.repeat(first[text] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        useful = doc[run] < high[segment]
        segment, run = segment[useful], run[useful]
        by_block = np.argsort(block[segment], kind="stable")
        segment, run = segment[by_block], run[by_block]
        at = _edges(block[segment])
        ranges = list(zip(at[:-1], at[1:]))
        packed = {"numbers": number[segment], "starts": start[run].astype(np.int32), "ends": end[run].astype(np.int32), "docs": doc[run]}
        yield _batch({"block": (block[segment][at[:-1]], pa.int64()), **{n: ([x[a:b].tobytes() for a, b in ranges], pa.binary()) for n, x in packed.items()}})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), lambda r: r["shard"]):
            yield from found(list(rows))

    met = sent.repartition(tasks, "shard").sortWithinPartitions("shard")
    return met.mapInArrow(arrow_task(find), "block long, numbers binary, starts binary, ends binary, docs binary")


# --- cutting -----------------------------------------------------------------------

KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _told(s: Slice, gone: np.ndarray) -> pa.RecordBatch:
    """The rows of a slice without the bytes marked in gone."""
    removed = np.r_[0, np.cumsum(gone)]
    opens = gone & ~np.r_[False, gone[:-1]]
    opens[s.offsets[:-1][s.offsets[:-1] < len(gone)]] |= gone[s.offsets[:-1][s.offsets[:-1] < len(gone)]]
    spans = np.r_[0, np.cumsum(opens)]
    rest = s.data[~gone].tobytes()
    bounds = s.offsets - removed[s.offsets]
    kept = [rest[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return _batch(
        {
            "doc_id": (pa.array(s.ids, mask=~s.valid), pa.int64()),
            "kept": (kept, pa.binary()),
            "n_bytes": (np.diff(s.offsets), pa.int64()),
            "n_removed": (np.diff(removed[s.offsets]), pa.int64()),
            "n_spans": (np.diff(spans[s.offsets]), pa.int64()),
            "kept_sha256": ([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
    )


def cut_texts(blocks: DataFrame, places: DataFrame, replies: DataFrame, tasks: int, span: int) -> DataFrame:
    """One row per packed row: KEPT."""

    def marks(s: Slice, places: tuple[np.ndarray, ...], replies: tuple[np.ndarray, ...]) -> np.ndarray:
        (number, row, start), (r_number, r_start, r_end, r_doc) = places, replies
        first, last = np.searchsorted(r_number, number), np.searchsorted(r_number, number, "right")
        n = last - first
        place = np.repeat(np.arange(len(number)), n)
        reply = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit = r_doc[reply] < s.ids[row[place]]
        place, reply = place[hit], reply[hit]
        depth = np.bincount(start[place] + r_start[reply], minlength=len(s.data) + 1) - np.bincount(start[place] + r_end[reply] + span - 1, minlength=len(s.data) + 1)
        return np.cumsum(depth[:-1]) > 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), lambda r: r["block"]):
            heard: list[tuple] = []
            replies = None
            places = None
            parts: list[tuple[Slice, np.ndarray]] = []
            for r in rows:
                if r["slice"] < 0:
                    heard.append(tuple(np.frombuffer(r[n], t) for n, t in (("numbers", np.int32), ("starts", np.int32), ("ends", np.int32), ("docs", np.int64))))
                    continue
                if r["data"] is None:
                    places = (r["slice"], tuple(np.frombuffer(r[n], np.int32) for n in ("numbers", "starts", "ends")))
                    continue
                if replies is None and heard:
                    replies = tuple(np.concatenate(c) for c in zip(*heard))
                    order = np.argsort(replies[0], kind="stable")
                    replies = tuple(x[order] for x in replies)
                s = _slice(r)
                gone = marks(s, places[1], replies) if replies is not None and places and places[0] == r["slice"] else np.zeros(len(s.data), bool)
                if s.parts == 1:
                    yield _told(s, gone)
                    continue
                parts.append((s, gone))
                if s.part == s.parts - 1:  # a whole long text
                    at = SLICE_BYTES * np.arange(len(parts))
                    size = int(at[-1]) + len(s.data)
                    data, all_gone = np.zeros(size, np.uint8), np.zeros(size, bool)
                    for a, (p, g) in zip(at.tolist(), parts, strict=True):
                        data[a : a + len(g)] = p.data
                        all_gone[a : a + len(g)] |= g
                    yield _told(Slice(0, 1, s.ids.tobytes(), s.valid.tobytes(), np.array([0, size]).tobytes(), pa.compress(data.tobytes(), "zstd", asbytes=True)), all_gone)
                    parts = []

    packed = ("numbers", "starts", "ends", "docs")
    nothing = [f"CAST(NULL AS {t}) AS {n}" for n, t in (x.split() for x in _SLICE_SCHEMA.split(", "))]
    none = [f"CAST(NULL AS BINARY) AS {n}" for n in packed]
    heard = replies.selectExpr("block", "-1 AS slice", "0 AS kind", *nothing, *packed)
    where = places.selectExpr("block", "slice", "0 AS kind", *nothing, "numbers", "keys AS starts", "sizes AS ends", "CAST(NULL AS BINARY) AS docs")
    texts = blocks.selectExpr("block", "slice", "1 AS kind", *SLICE, *none)
    met = heard.union(where).union(texts).repartition(tasks, "block").sortWithinPartitions("block", "slice", "kind")
    return met.mapInArrow(arrow_task(cut), KEPT)


def drop_repeats(docs: DataFrame, *, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, kept (bytes), n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a span-byte string over it also starts in a document with
    a smaller id; strings are those of the whole texts given, however long. A
    null text is empty. Rows of one id are one document: they never cut each
    other, and each is cut by what smaller documents hold, also where their
    texts differ. A row without an id is neither cut nor held against others.
    Other columns are not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, -(-total // TASK_BYTES)))
    shards = max(1, -(-total // SHARD_BYTES))
    blocks = materialise(pack(rows, min(max(total // BLOCKS, LEAST_BLOCK), MOST_BLOCK), span), "blocks")
    shared = materialise(repeated_anchors(send_anchors(blocks, shards, span, gram), min(MOST_TASKS, shards), hot), "shared-anchors")
    cuts = materialise(cut_segments(blocks, shared, SEGMENT_SHARDS * shards, tasks, span, gram), "segments", compression="zstd")
    discard(shared)
    sent, places = cuts.filter("shard IS NOT NULL"), cuts.filter("shard IS NULL")
    replies = materialise(find_holders(sent, min(MOST_TASKS, SEGMENT_SHARDS * shards), span), "holders", compression="zstd")
    return cut_texts(blocks, places.select("block", "slice", "numbers", "keys", "sizes"), replies, tasks, span)
