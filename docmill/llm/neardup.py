"""Near-duplicate documents by MinHash, without all pairs of a group.

Equal shingle sets are one class, represented by its smallest document, so
copies cost nothing further. Minima of many universal hashes are banded; a
bucket links its members to one centre, links are confirmed on full sets, and
connected components come from alternating large-star and small-star. Buckets
that still hold several components are then searched in blocks of bounded
size: pairs of different components whose signatures agree enough are
confirmed on full sets, so no link between components is lost and only
confirmed links are ever emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docmill.llm.tasks import arrow_task, bounded_batches, free_name
from docmill.llm.textkernel import LOWER, column_bytes, mix, row_slices, shingle_hashes, word_hashes, word_spans
from docmill.llm.workspace import materialise

SLICE_BYTES = 1 << 20
BANDS = 40
MISS = 1.5e-7  # most that a link right at the threshold may be missed with
BLOCK = 256  # members of a bucket that meet in one task, twice
SIGMAS = 6  # standard deviations that a linked pair's signature agreement may stay behind
MAX_ROUNDS = 60


@dataclass(frozen=True)
class Plan:
    """Shingle size, similarity in percent, and what follows from them."""

    shingle: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        """Minima in a band: as many as keep the risk of missing a link below MISS."""
        s, r = self.percent / 100, 1
        while (1 - s ** (r + 1)) ** BANDS <= MISS:
            r += 1
        return r

    @property
    def hashes(self) -> int:
        return BANDS * self.rows

    @property
    def agreement(self) -> int:
        """Signature positions that a linked pair has in common, all but surely."""
        s = self.percent / 100
        return int(self.hashes * s - SIGMAS * (self.hashes * s * (1 - s)) ** 0.5)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(85).integers(1, 1 << 63, (2, n), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(shingle_hashes(words[a:b], size))


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every hash (a * x + b) >> 32 over the shingles."""
    least = np.full(len(a), 1 << 32, np.uint64)
    for k in range(0, len(shingles), 512):
        h = a[:, None] * shingles[None, k : k + 512]
        h += b[:, None]
        np.minimum(least, h.min(1) >> np.uint64(32), out=least)
    return least


def sketches(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit identity, band keys and signature (low bytes of the minima)."""
    size, rows_in_band = plan.shingle, plan.rows
    a, b = _coefficients(plan.hashes)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for x, y in row_slices(offsets, SLICE_BYTES):
                rows = []
                for s in shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], size):
                    least = minima(s, a, b)
                    band = np.arange(BANDS, dtype=np.uint64)
                    for column in least.reshape(BANDS, rows_in_band).T:
                        band = mix(band * np.uint64(0xD6E8FEB86659FD93) + column)
                    rows.append((len(s), *np.array([s.sum(), mix(s).sum()], np.uint64).view(np.int64).tolist(), band.view(np.int64), least.astype(np.uint8).tobytes()))
                n, low, high, bands, signature = zip(*rows)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip((n, low, high, bands, signature), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *columns], ["doc_id", "n_shingles", "set_low", "set_high", "bands", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(arrow_task(sketch), "doc_id long, n_shingles long, set_low long, set_high long, bands array<long>, signature binary")


def full_sets(docs: DataFrame, ids: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, shingles): the sorted shingle hashes of the documents in ids, as bytes."""
    size = plan.shingle

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for x, y in row_slices(offsets, SLICE_BYTES):
                sets = [s.tobytes() for s in shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(ids.select("doc_id"), "doc_id", "left_semi").mapInArrow(arrow_task(build), "doc_id long, shingles binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirm(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    percent = plan.percent

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(arrow_task(check), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node reachable.

    Large-star hangs each node's larger neighbours on its smallest one,
    small-star the smaller ones and the node itself, until nothing changes.
    """
    current = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", "m"))
        current = materialise(small.distinct(), "edges")
        new = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())


def bucket_members(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, band, doc_id, copies) of class representatives that share a bucket with another."""
    known = sketch.join(classes.select(F.col("rep").alias("doc_id"), "set_low", "set_high", "copies"), ["doc_id", "set_low", "set_high"])
    rows = known.select("doc_id", "copies", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.min("doc_id").alias("_x"), F.max("doc_id").alias("_y")).filter("_x < _y").select("bucket")
    return rows.join(shared, "bucket").select("bucket", "band", "doc_id", "copies")


def blocks_of(members: DataFrame) -> DataFrame:
    """members with the block of each: (home, block), of about BLOCK members of the bucket.

    A component of more than BLOCK members in a bucket is home to blocks of
    its own; the others are dealt out whole, by hash. Counts come from partial
    sums, so no task sees a whole bucket.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("_n"))
    rest = sizes.groupBy("bucket").agg(F.sum(F.when(F.col("_n") <= BLOCK, F.col("_n")).otherwise(0)).alias("_rest"))
    sizes = sizes.join(rest, "bucket")
    big = F.col("_n") > BLOCK
    dealt = F.pmod(F.xxhash64(F.when(big, F.col("doc_id")).otherwise(F.col("component"))), F.ceil(F.when(big, F.col("_n")).otherwise(F.col("_rest")) / BLOCK))
    home = F.when(big, F.col("component"))
    return members.join(sizes, ["bucket", "component"]).select(*members.columns, home.alias("home"), F.concat_ws(":", home.cast("string"), F.lit(""), dealt.cast("string")).alias("block"))


def links_in_blocks(members: DataFrame, sketch: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Confirmed links (a, b) between different components of a bucket.

    members: (bucket, band, doc_id, component). Blocks of a bucket meet in
    pairs, except two blocks of the same component: first with signatures
    alone, then with the full sets of those members that have a candidate. A
    pair is looked at in its first common band only.
    """
    percent, agreement = plan.percent, plan.agreement
    cut = materialise(blocks_of(members), "blocks")
    blocks = cut.select("bucket", "block", "home").distinct()
    one, two = blocks.select("bucket", F.col("block").alias("i"), "home"), blocks.select("bucket", F.col("block").alias("j"), F.col("home").alias("home2"))
    meets = one.join(two, "bucket").filter("i <= j AND NOT coalesce(home = home2, false)").select("bucket", "i", "j")  # pairs of blocks, not of members
    placed = meets.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).join(cut.drop("home"), ["bucket", "block"])
    signed = sketch.select("doc_id", "n_shingles", "bands", "signature")

    def candidates(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Members of block i, each with those of block j that may be linked with it."""
        doc, component, n = (table.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
        block = np.array(table.column("block").to_pylist())
        bands = np.array(table.column("bands").to_pylist(), np.int64)[:, : table.column("band")[0].as_py()]
        signature = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("signature").chunk(0)])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        for x in np.flatnonzero(block == i):
            later = np.flatnonzero((block == j) & (component != component[x]) & ((doc > doc[x]) if i == j else True))
            later = later[100 * np.minimum(n[later], n[x]) >= percent * np.maximum(n[later], n[x])]
            later = later[(signature[later] == signature[x]).sum(1) >= agreement]
            if len(later) and bands.shape[1]:
                later = later[~(bands[later] == bands[x]).any(1)]
            if len(later):
                yield x, later

    def with_candidates(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = np.zeros(table.num_rows, bool)
        for x, later in candidates(table):
            found[x] = True
            found[later] = True
        return table.select(["bucket", "i", "j", "block", "band", "doc_id", "component"]).filter(pa.array(found))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, group = table.column("doc_id").to_numpy(), table.column("component").to_numpy().copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles").chunk(0)]
        found = []
        for x, later in candidates(table):
            for y in later:
                if group[x] != group[y] and linked(sets[x], sets[y], percent):
                    found.append((doc[x], doc[y]))
                    group[group == group[y]] = group[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    schema = "bucket long, i string, j string, block string, band int, doc_id long, component long"
    survivors = materialise(placed.join(signed, "doc_id").groupBy("bucket", "i", "j").applyInArrow(with_candidates, schema), "candidates")
    full = survivors.join(signed.join(survivors.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").join(sets, "doc_id")
    return full.groupBy("bucket", "i", "j").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id, component_id, kept.

    class_id is the smallest id with the same shingle set, component_id the
    smallest reachable over links of percent similarity or more, kept says
    that the row's id is its component's. A null, empty or blank text has no
    shingles and no links. Rows of one id are one node of the graph; a row
    without an id is linked with nothing, its component is null and it is
    kept. Other columns are not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    plan = Plan(shingle, percent)
    sketch = materialise(sketches(docs, plan), "sketches")
    usable = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(usable.groupBy("set_low", "set_high").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = materialise(bucket_members(usable, classes), "members")
    sets = materialise(full_sets(docs, members.select("doc_id").distinct(), plan), "sets")

    # The centre of a bucket is the class with most copies: near copies mostly stem from what was copied most.
    centres = members.groupBy("bucket").agg(F.max_by("doc_id", F.struct("copies", -F.col("doc_id"))).alias("b"))
    stars = members.join(centres, "bucket").select(F.col("doc_id").alias("a"), "b").filter("a <> b").distinct()
    links = materialise(confirm(stars, sets, plan), "links")
    first = components(links)

    nodes = members.join(first, members["doc_id"] == first["node"], "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = nodes.groupBy("bucket").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x < _y").select("bucket")
    open_ = materialise(nodes.join(mixed, "bucket"), "open-buckets")
    more = links_in_blocks(open_, usable.join(open_.select("doc_id").distinct(), "doc_id", "left_semi"), sets, plan)
    final = materialise(components(links.union(more)), "components")

    classed = sketch.join(classes.drop("copies"), ["set_low", "set_high"], "left")
    rep = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    named = classed.select("doc_id", "n_shingles", rep.alias("class_id"))
    out = named.join(final, named["class_id"] == final["node"], "left")
    component = F.coalesce("component", "class_id")
    return out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is the one its component keeps."""
    name = free_name(docs, "_gone")
    gone = near_duplicates(docs, shingle=shingle, percent=percent).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
