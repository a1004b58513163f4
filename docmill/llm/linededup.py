"""Line dedup by probing sharded minimal perfect hash tables.

Lines are 128-bit hashes. Those found in several documents go into shards;
a shard is a minimal perfect hash function over its hashes with a fingerprint
array, a document-count array and a first-document array. Documents' hashes
stream past the arrays of their shard; lines themselves never move.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docmill.llm.perfecthash import PerfectHash
from docmill.llm.tasks import arrow_task, bounded_batches, free_name
from docmill.llm.textkernel import SPACES
from docmill.llm.tokens import text_batches
from docmill.llm.workspace import materialise

MIN_CHARS = 10
KEYS_PER_SHARD = 100_000
REPLICAS = 16  # copies of a shard's arrays, so that a line which many documents hold is probed in many tasks


def line_key(line: bytes) -> bytes:
    """The line stripped of ASCII white space, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_hash(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    h = xxhash.xxh3_128_intdigest(key)
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


class Shard:
    """Arrays of one shard, by perfect hash position; keys the function can't place stand in a small list."""

    def __init__(self, hash_: PerfectHash, fingerprint: np.ndarray, count: np.ndarray, first: np.ndarray, listed: dict[tuple[int, int], tuple[int, int]]):
        self.hash, self.fingerprint, self.count, self.first, self.listed = hash_, fingerprint, count, first, listed

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, count: np.ndarray, first: np.ndarray) -> Shard:
        keys = hi.view(np.uint64)
        hash_ = PerfectHash.build(keys)
        at = hash_.positions(keys)
        placed = at >= 0
        arrays = [np.zeros(int(placed.sum()), x.dtype) for x in (lo, count, first)]
        for new, old in zip(arrays, (lo, count, first), strict=True):
            new[at[placed]] = old[placed]
        listed = {(int(hi[i]), int(lo[i])): (int(count[i]), int(first[i])) for i in np.flatnonzero(~placed)}
        return cls(hash_, *arrays, listed)

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, first document) of each hash; count 0 where it isn't held."""
        at = self.hash.positions(hi.view(np.uint64))
        count, first = np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        maybe = np.flatnonzero(at >= 0)
        held = maybe[self.fingerprint[at[maybe]] == lo[maybe]]
        count[held], first[held] = self.count[at[held]], self.first[at[held]]
        if self.listed:
            for i in np.flatnonzero(count == 0):
                count[i], first[i] = self.listed.get((int(hi[i]), int(lo[i])), (0, 0))
        return count, first

    def dump(self) -> bytes:
        out = io.BytesIO()
        listed = np.array([(*k, *v) for k, v in self.listed.items()], np.int64).reshape(-1, 4)
        levels = {f"level{i}": np.packbits(x) for i, x in enumerate(self.hash.levels)}
        sizes = np.array([len(x) for x in self.hash.levels], np.int64)
        np.savez(out, sizes=sizes, fingerprint=self.fingerprint, count=self.count, first=self.first, listed=listed, rest=self.hash.rest, **levels)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        x = np.load(io.BytesIO(raw))
        levels = [np.unpackbits(x[f"level{i}"], count=int(n)).astype(bool) for i, n in enumerate(x["sizes"])]
        listed = {(a, b): (c, d) for a, b, c, d in x["listed"].tolist()}
        return cls(PerfectHash(levels, x["rest"]), x["fingerprint"], x["count"], x["first"], listed)


def document_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, hi, lo): the distinct hashes of a row's lines that are long enough. Rows without an id hold none."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, _, texts in text_batches(batch, "text"):
                rows = [(ids[a + i], *h) for i, t in enumerate(texts) for h in {line_hash(k) for k in map(line_key, t.split(b"\n")) if _counts(k, min_chars)}]
                columns = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "hi", "lo"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(arrow_task(hashes), "doc_id long, hi long, lo long")


def build_shards(lines: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """((shard, arrays), number of shards) of the hashes that several documents hold."""
    counts = lines.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    repeated = materialise(counts.filter("first < last").drop("last"), "repeated-lines")
    shards = max(1, -(-repeated.count() // keys_per_shard))

    def build(table: pa.Table) -> pa.Table:
        hi, lo, first, n = (table.column(c).to_numpy() for c in ("hi", "lo", "first", "n"))
        return pa.table({"shard": table.column("shard").slice(0, 1), "arrays": pa.array([Shard.build(hi, lo, n, first).dump()], pa.binary())})

    sharded = repeated.withColumn("shard", F.pmod("hi", F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(build, "shard long, arrays binary"), shards


def lines_to_drop(docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """(doc_id, hi, lo) of lines that a document with a smaller id holds too, by probing the shards."""
    lines = materialise(document_lines(docs, min_chars), "lines")
    tables, shards = build_shards(lines, keys_per_shard)
    tables = materialise(tables, "shards")
    copies = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(REPLICAS - 1)))).selectExpr("shard", "salt", "0 AS probe", "CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS BIGINT) AS hi", "CAST(NULL AS BIGINT) AS lo", "arrays")
    probes = lines.select(F.pmod("hi", F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(REPLICAS)).cast("int").alias("salt"), F.lit(1).alias("probe"), "doc_id", "hi", "lo", F.lit(None).cast("binary").alias("arrays"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, None
        for batch in batches:
            shard, salt, kind = (batch.column(c).to_numpy() for c in ("shard", "salt", "probe"))
            starts = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)])
            for a, b in zip(starts, np.r_[starts[1:], len(shard)], strict=True):
                if not kind[a]:
                    at, table = (shard[a], salt[a]), Shard.load(batch.column("arrays")[int(a)].as_py())
                elif at == (shard[a], salt[a]):
                    doc, hi, lo = (batch.column(c).slice(a, b - a).to_numpy() for c in ("doc_id", "hi", "lo"))
                    count, first = table.probe(hi, lo)
                    hit = (count > 1) & (first < doc)
                    yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (doc, hi, lo)], ["doc_id", "hi", "lo"])

    # Within a task the arrays of a shard come just before its probes, which are streamed.
    met = copies.union(probes).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "probe")
    return met.mapInArrow(arrow_task(probe), "doc_id long, hi long, lo long")


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """The rows of docs with text shortened, plus _n_lines (before) and _n_dropped.

    A line goes if its key (stripped, lower-cased) has min_chars code points
    or more and a document with a smaller doc_id holds it; all lines of that
    key in the row go. Rows of one id are one document, so they never shorten
    each other; a row without an id neither shortens others nor is shortened.
    A null or empty text is one empty line (null stays null). Other columns
    pass through (columns named like the two new ones are replaced); an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("_n_lines", "_n_dropped")
    doc_name, drop_name = free_name(docs, "_doc"), free_name(docs, "_drop")
    drops = lines_to_drop(docs, min_chars, keys_per_shard)
    by_doc = drops.groupBy(F.col("doc_id").alias(doc_name)).agg(F.collect_set(F.struct("hi", "lo")).alias(drop_name))  # at most a document's own lines
    joined = docs.join(by_doc, docs["doc_id"].cast("long") == by_doc[doc_name], "left").drop(doc_name)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, n_lines, n_dropped = batch.column(at).to_pylist(), [], []
            for i, drop in enumerate(batch.column(batch.schema.get_field_index(drop_name)).to_pylist()):
                lines = (texts[i] or "").encode().split(b"\n") if drop else None
                n_lines.append(len(lines) if drop else (texts[i] or "").count("\n") + 1)
                n_dropped.append(0)
                if drop:
                    gone = {(x["hi"], x["lo"]) for x in drop}
                    kept = [x for x in lines if not (_counts(k := line_key(x), min_chars) and line_hash(k) in gone)]
                    n_dropped[-1] = len(lines) - len(kept)
                    texts[i] = b"\n".join(kept).decode()
            columns = [pa.array(texts, batch.column(at).type) if c == at else batch.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "_n_lines", "_n_dropped"])

    return joined.mapInArrow(arrow_task(cut), docs.selectExpr("*", "0L AS _n_lines", "0L AS _n_dropped").schema)
