"""Pipelines over unbounded tables: row-by-row stages, and groups of time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmill.errors import DocumentError
from docmill.functions.accumulators import compile_accumulator
from docmill.functions.expressions import compile_expression
from docmill.functions.paths import Scope
from docmill.operators.stages import Context, run_pipeline, stage_of

ROW_STAGES = {"$match", "$addFields", "$set", "$unset", "$project", "$replaceRoot", "$replaceWith", "$unwind", "$redact"}


def stream_pipeline(stream: DataFrame, pipeline: list[dict], context: Context | None = None) -> DataFrame:
    """Stages that need no other rows, on a stream."""
    for item in pipeline:
        name, _ = stage_of(item)
        if name not in ROW_STAGES:
            raise DocumentError(238, f"{name} over a stream without a window")
    return run_pipeline(stream, pipeline, context or Context(stream.sparkSession))


def windowed_group(stream: DataFrame, time: str, size: str, spec: dict, *, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """$group within tumbling or sliding windows of event time; rows later than `late` are dropped."""
    marked = stream.withWatermark(time, late)
    scope = Scope(marked)
    by = spec.get("_id")
    keys = [] if by is None else [compile_expression(by, scope).alias("_id")]
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return marked.groupBy(window, *keys).agg(*[compile_accumulator(x, scope).alias(k) for k, x in spec.items() if k != "_id"])


def session_group(stream: DataFrame, time: str, gap: str, spec: dict, *, late: str = "10 minutes") -> DataFrame:
    """$group within sessions: rows of a key that follow each other within `gap`."""
    marked = stream.withWatermark(time, late)
    scope = Scope(marked)
    return marked.groupBy(F.session_window(time, gap), compile_expression(spec["_id"], scope).alias("_id")).agg(*[compile_accumulator(x, scope).alias(k) for k, x in spec.items() if k != "_id"])


def distinct_events(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, as long as it comes again within `late`."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
