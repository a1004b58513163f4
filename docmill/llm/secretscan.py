"""Secret scans over a ledger of content-addressed texts.

A table of paths names every version of every document; equal texts are one
blob, named by its SHA-256. The ledger says which (blob, rule version) pairs
have been scanned, only the others are, each once, and findings are joined
back to every path of their blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docmill.llm.tasks import arrow_task, bounded_batches
from docmill.llm.textkernel import column_bytes
from docmill.llm.workspace import materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `hint`: an RE2 pattern that every text with a finding matches."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("prefixed_token", 1, r"\b(?:gh[pousr]_|glpat-|xox[abpr]-)[A-Za-z0-9_-]{16,}", r"gh[pousr]_|glpat-|xox[abpr]-"),
)
RULES = BASE_RULES + MORE_RULES


def blob_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob): the content address of every row's text; null is the empty text."""
    return docs.select(F.col(id_col).alias("path"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("blob"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings (blob, kind, version, start, end) of the texts (blob, due, text); code points, end exclusive.

    Bit i of due says that rule i has yet to be run on the text.
    """
    compiled = [(r, re.compile(r.pattern)) for r in rules]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, due, texts = batch.columns
            rows: list[tuple] = []
            for k, (rule, pattern) in enumerate(compiled):
                own = pc.indices_nonzero(pc.bit_wise_and(due, 1 << k))
                hinted = pc.match_substring_regex(texts.take(own), rule.hint)
                for i in own.filter(hinted).to_pylist():
                    name = names[i].as_py()
                    rows += [(name, rule.kind, rule.version, *m.span()) for m in pattern.finditer(texts[i].as_py()) if len(m[rule.group]) >= rule.least]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["blob", "kind", "version", "start", "end"])

    return blobs.select("blob", "due", "text").mapInArrow(arrow_task(find), "blob string, kind string, version int, start long, end long")


def due_pairs(paths: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(blob, path, due): the blobs that some rule version hasn't scanned, one path of each, and those rules as bits."""
    # One row of docs stands for a blob: texts move once, spread by id and not by blob, so copies meet nowhere.
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        return blobs.withColumn("due", F.lit((1 << len(rules)) - 1).cast("long"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("_seen"))
    bits = [F.when(F.coalesce(F.array_contains("_seen", f"{r.kind}:{r.version}"), F.lit(False)), 0).otherwise(1 << k) for k, r in enumerate(rules)]
    return blobs.join(seen, "blob", "left").select("blob", "path", sum(bits, F.lit(0)).cast("long").alias("due")).filter("due > 0")


def secret_findings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, ledger: DataFrame | None = None, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, ledger) after scanning what the ledger does not hold.

    paths: (path, blob), one row per row of docs. findings: (blob, kind,
    version, start, end) by the rules given, those of `known` (an earlier
    run's findings) included where a rule still has their version. ledger:
    (blob, kind, version) scanned so far. Only pairs of a blob and a rule
    version that the ledger lacks are scanned. A null text is the empty blob;
    rows of one id are its versions; an empty table adds nothing; other
    columns are not read.
    """
    bounded_batches(docs.sparkSession)
    paths = materialise(blob_ids(docs, id_col, text_col), "paths")
    due = materialise(due_pairs(paths, rules, ledger), "due")
    texts = docs.select(F.col(id_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.sha2("text", 256))
    first = due.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"), "due")
    chosen = texts.join(first, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob")))
    found = scan(chosen, rules)
    if known is not None:
        current = F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules])
        found = found.unionByName(known.filter(current).select(*found.columns))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(1 << k).alias("bit")) for k, r in enumerate(rules)])
    scanned = due.select("blob", "due", F.inline(wanted)).filter(F.col("due").bitwiseAND(F.col("bit")) > 0).select("blob", "kind", "version")
    if ledger is not None:
        scanned = ledger.select("blob", "kind", "version").union(scanned)
    return paths, materialise(found.distinct(), "findings"), materialise(scanned, "ledger")


def findings_by_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, found): each path's findings as an array of (start, rank of the kind, end, kind), sorted; empty if none."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    by_blob = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))).alias("found"))
    joined = paths.join(by_blob, "blob", "left")
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return joined.select("path", F.coalesce("found", empty).alias("found"))
