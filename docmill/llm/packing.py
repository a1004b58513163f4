"""Packing token pieces into full training sequences by minimum bin slack.

How pieces can be combined depends only on how many there are of each length,
and there are at most `capacity` lengths, so the plan is made from that
histogram whatever the size of the corpus. Spark cuts the documents, counts
the lengths, numbers the pieces of a length and looks each number up in the
plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docmill.llm.tasks import arrow_task, bounded_batches
from docmill.llm.tokens import encoder, text_batches
from docmill.llm.workspace import materialise

CAPACITY = 2048
END_ID = 0
PIECES_PER_GROUP = 2_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills most of `room`.

    A bitset holds the reachable sums; counts enter in powers of two.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            part = min(part, left)
            grown = reach | (reach << (length * part)) & mask
            if grown != reach:
                steps.append((length, part, reach))
                reach = grown
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, copies in each)]) for all pieces.

    Every bin takes the longest piece left and the fullest combination beside
    it. A combination is repeated while its lengths last, so the number of
    entries follows the number of lengths, not of pieces.
    """
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        pattern = fullest(rest, capacity - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[length] // copies for length, copies in pattern.items())
        for length, copies in pattern.items():
            left[length] -= times * copies
            if not left[length]:
                del left[length]
        plan.append((times, sorted(pattern.items(), reverse=True)))
    return plan


def slot_table(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows of (first number, first sequence, copies in each, offset of the first copy)."""
    used: dict[int, int] = {}
    table: dict[int, list] = {}
    sequence = 0
    for times, pattern in plan:
        offset = 0
        for length, copies in pattern:
            table.setdefault(length, []).append((used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return {k: np.array(v, np.int64) for k, v in table.items()}


def cut_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids] of all documents' pieces (columns doc_id and text of docs)."""
    bounded_batches(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, "ids")
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for a, _, texts in text_batches(batch, "text"):
                rows = []
                for i, parts in enumerate(words.texts(texts)):
                    ids = b"".join(parts) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((ids_of[a + i], k, at // 4, len(piece) // 4, zlib.crc32(piece), *[piece] * keep_ids))
                kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(arrow_task(cut), schema)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset [, ids].

    Pieces of one sequence_id follow each other without gaps from offset 0.
    A null or empty text is one piece holding the end id. Rows with one id
    (or a null one) are pieces of their own, an empty table gives no rows and
    further columns of docs are not read.
    """
    pieces = materialise(cut_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, keep_ids=keep_ids), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = slot_table(plan_bins(histogram, capacity))

    # Numbers within a length come from groups of bounded size, so no length, however common, meets in one task.
    groups = -(-max(histogram.values(), default=1) // PIECES_PER_GROUP)
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = salted.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_i", F.row_number().over(inside) - 1).join(firsts, ["length", "_group"])
    numbered = numbered.select(*pieces.columns, (F.col("_i") + F.col("_first")).alias("_number"))

    columns = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "_number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for each in np.unique(length):
                at = np.flatnonzero(length == each)
                table = slots[int(each)]
                row = table[np.searchsorted(table[:, 0], number[at], "right") - 1]
                bin_, copy = np.divmod(number[at] - row[:, 0], row[:, 2])
                sequence[at], offset[at] = row[:, 1] + bin_, row[:, 3] + copy * each
            keep = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id bigint, offset bigint"
    out = numbered.mapInArrow(arrow_task(place), schema)
    first = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return out.select(*first, *[c for c in pieces.columns if c not in first])
