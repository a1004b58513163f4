"""$setWindowFields, $fill and $densify."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from docmill.errors import DocumentError, bad_value
from docmill.functions import values as V
from docmill.functions.accumulators import compile_accumulator, merged_objects, picked, sort_order
from docmill.functions.expressions import compile_expression, kind_of
from docmill.functions.paths import Scope, quoted, resolve

#: Milliseconds of the time units of frames and rates.
UNIT_MILLIS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}

SPREAD = 1e100  # of the weights within a block of a moving average
ENDS = 7  # blocks back: what older ones leave is below the smallest double


def _unit(name: str) -> int:
    if name not in UNIT_MILLIS:
        raise bad_value(f"unknown time unit of a window: {name!r}")
    return UNIT_MILLIS[name]


def _position(scope: Scope, path: str) -> Column:
    """A sort value as a number: milliseconds for dates."""
    column, kind = resolve(scope, path)
    return F.unix_millis(column.cast("timestamp")) if V.value_class(kind) == "date" else column


def _bound(value: object, unit: int) -> int:
    if value == "current":
        return Window.currentRow
    if value == "unbounded":
        return Window.unboundedPreceding
    return int(value * unit)


class Frame:
    """Partition, order and bounds of one output field."""

    def __init__(self, scope: Scope, stage: dict, window: dict | None):
        self.scope, self.window = scope, window or {}
        by = stage.get("partitionBy")
        self.by = [compile_expression(by, scope)] if by is not None else []
        self.sort = stage.get("sortBy") or {}
        order = sort_order(self.sort, scope)
        self.order = order
        self.ordered = Window.partitionBy(*self.by).orderBy(*[V.descending_last(c, d) for c, d in order]) if order else Window.partitionBy(*self.by)
        self.spec = self._bounded()

    def _bounded(self) -> WindowSpec:
        if "documents" in self.window:
            lo, hi = self.window["documents"]
            if not self.order:
                if (lo, hi) == ("unbounded", "unbounded"):
                    return Window.partitionBy(*self.by)
                raise DocumentError(5339901, "document-based bounds need a sortBy")
            return self.ordered.rowsBetween(_bound(lo, 1), Window.unboundedFollowing if hi == "unbounded" else _bound(hi, 1))
        if "range" in self.window:
            if len(self.sort) != 1:
                raise DocumentError(5339902, "range-based bounds need a sortBy of one field")
            unit = _unit(self.window["unit"]) if "unit" in self.window else 1
            lo, hi = self.window["range"]
            position = _position(self.scope, next(iter(self.sort)))
            spec = Window.partitionBy(*self.by).orderBy(position.asc_nulls_first())
            return spec.rangeBetween(_bound(lo, unit), Window.unboundedFollowing if hi == "unbounded" else _bound(hi, unit))
        return Window.partitionBy(*self.by)

    def position(self) -> Column:
        if len(self.sort) != 1:
            raise DocumentError(5339902, "the operator needs a sortBy of one field")
        return _position(self.scope, next(iter(self.sort)))


def _shift(f: Frame, a: dict) -> Column:
    value, by = compile_expression(a["output"], f.scope), a["by"]
    default = a.get("default")
    return F.lead(value, by, default).over(f.ordered) if by >= 0 else F.lag(value, -by, default).over(f.ordered)


def _moving_average(df: DataFrame, f: Frame, a: dict, name: str) -> tuple[DataFrame, Column]:
    """v * alpha + previous * (1 - alpha), from the first value on; df gets the columns that the result is made of.

    Values are weighted by powers of 1 / (1 - alpha) and summed in blocks, so short that the weights stay within
    SPREAD; blocks before one's own add what is left of their ends. A null leaves the average as it was; after
    an infinite or NaN value it stays so.
    """
    alpha = 2 / (a["N"] + 1) if "N" in a else a["alpha"]
    if not 0 < alpha < 1 and "alpha" in a:
        raise DocumentError(5433601, "alpha must be between 0 and 1")
    keep = 1 - alpha
    block = 1 + int(math.log(SPREAD) / -math.log(keep)) if keep else 1
    at, own, end = (f"{name}_{x}" for x in ("at", "own", "end"))
    so_far = f.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = compile_expression(a["input"], f.scope).cast("double")
    number, place = F.floor((F.col(at) - 1) / block), (F.col(at) - 1) % block
    term = value * F.when(F.col(at) == 1, 1.0).otherwise(alpha) * F.pow(F.lit(keep), -place if keep else F.lit(0))
    within = Window.partitionBy(*f.by, number).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(at, F.count(value).over(so_far))
    df = df.withColumn(own, F.sum(term).over(within) * F.pow(F.lit(keep), place))
    df = df.withColumn(end, F.when(place == block - 1, F.col(own)))
    earlier = Window.partitionBy(*f.by).orderBy(number)
    carry = F.lit(0.0)
    for back in range(ENDS, 0, -1):
        carry = F.coalesce(F.max(end).over(earlier.rangeBetween(-back, -back)), F.lit(0.0)) + carry * keep**block
    lasting = F.sum(F.when(value.isin(float("inf"), float("-inf"), float("nan")), value)).over(so_far)
    return df, F.when(F.col(at) > 0, F.coalesce(lasting, F.col(own) + F.pow(F.lit(keep), place + 1) * carry))


def _derivative(f: Frame, a: dict) -> Column:
    unit = _unit(a["unit"]) if "unit" in a else 1
    value, at = compile_expression(a["input"], f.scope).cast("double"), f.position().cast("double")
    change = F.last(value).over(f.spec) - F.first(value).over(f.spec)
    time = (F.last(at).over(f.spec) - F.first(at).over(f.spec)) / unit
    return F.try_divide(change, time)


def _integral(f: Frame, a: dict) -> Column:
    """Trapezoids between neighbours that both lie in the frame."""
    unit = _unit(a["unit"]) if "unit" in a else 1
    points = F.collect_list(F.struct(f.position().cast("double").alias("t"), compile_expression(a["input"], f.scope).cast("double").alias("v"))).over(f.spec)
    n = F.size(points)
    steps = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    area = lambda i: (F.get(points, i)["v"] + F.get(points, i - 1)["v"]) / 2 * (F.get(points, i)["t"] - F.get(points, i - 1)["t"]) / unit
    return F.aggregate(steps, F.lit(0.0), lambda s, i: s + area(i))


def _covariance(f: Frame, operand: list, sample: bool) -> Column:
    x, y = (compile_expression(o, f.scope).cast("double") for o in operand)
    return (F.covar_samp if sample else F.covar_pop)(x, y).over(f.spec)


def _locf(f: Frame, operand: object) -> Column:
    return F.last(compile_expression(operand, f.scope), ignorenulls=True).over(f.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _linear(f: Frame, operand: object) -> Column:
    """Between the known values on both sides, by position; null where one is lacking."""
    value, at = compile_expression(operand, f.scope).cast("double"), f.position().cast("double")
    back, ahead = f.ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow), f.ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(value.isNotNull(), F.struct(at.alias("t"), value.alias("v")))
    a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    return F.coalesce(value, a["v"] + (b["v"] - a["v"]) * F.try_divide(at - a["t"], b["t"] - a["t"]))


_OPERATORS: dict[str, Callable[[Frame, object], Column]] = {
    "$rank": lambda f, a: F.rank().over(f.ordered),
    "$denseRank": lambda f, a: F.dense_rank().over(f.ordered),
    "$documentNumber": lambda f, a: F.row_number().over(f.ordered),
    "$shift": _shift,
    "$derivative": _derivative,
    "$integral": _integral,
    "$covariancePop": lambda f, a: _covariance(f, a, False),
    "$covarianceSamp": lambda f, a: _covariance(f, a, True),
    "$locf": _locf,
    "$linearFill": _linear,
}
_PICKED = {"$top", "$bottom", "$topN", "$bottomN"}
_NEED_ORDER = {"$rank", "$denseRank", "$documentNumber", "$shift", "$expMovingAvg", "$derivative", "$integral", "$locf", "$linearFill"}


def window_operator_names() -> list[str]:
    return sorted([*_OPERATORS, "$expMovingAvg"])


def window_output(spec: dict, scope: Scope, stage: dict, place: Column | None = None) -> Column:
    names = [k for k in spec if k != "window"]
    if len(names) != 1:
        raise DocumentError(9, "a window field needs exactly one operator")
    frame = Frame(scope, stage, spec.get("window"))
    name = names[0]
    if name in _OPERATORS:
        if name in _NEED_ORDER and not frame.order:
            raise DocumentError(5371602, f"{name} needs a sortBy")
        return _OPERATORS[name](frame, spec[name])
    return _over(compile_accumulator({name: spec[name]}, scope), frame, name, spec[name], place)


def _over(column: Column, frame: Frame, name: str, operand: object, place: Column | None) -> Column:
    """Group accumulators over a frame; those made of several aggregates are built on the frame's values.

    place: the number of a document within its partition, which tells documents apart that an operator's own order doesn't.
    """
    scope = frame.scope
    if name == "$sum":
        if operand == 1 and not isinstance(operand, bool):
            return F.count(F.lit(1)).over(frame.spec)
        kind = kind_of(operand, scope)
        value = compile_expression(operand, scope)
        return F.coalesce(F.sum(value.cast("long") if isinstance(kind, V.WHOLE) else value).over(frame.spec), F.lit(0))
    if name in ("$first", "$last"):
        return (F.first if name == "$first" else F.last)(compile_expression(operand, scope)).over(frame.spec)
    if name in ("$firstN", "$lastN", "$minN", "$maxN"):
        values, n = F.collect_list(compile_expression(operand["input"], scope)).over(frame.spec), operand["n"]
        if name in ("$minN", "$maxN"):
            values = F.sort_array(values, name == "$minN")
        return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), F.lit(n)) if name == "$lastN" else F.slice(values, 1, n)
    if name in _PICKED:
        return picked(name, operand, scope, lambda aggregate: aggregate.over(frame.spec), place)
    if name == "$mergeObjects":
        return merged_objects(operand, scope, [], lambda aggregate: aggregate.over(frame.spec))
    return column.over(frame.spec)


def set_window_fields(df: DataFrame, stage: dict, scope_of: Callable[[DataFrame], Scope]) -> DataFrame:
    if not isinstance(stage, dict) or "output" not in stage:
        raise DocumentError(40414, "$setWindowFields needs an output")
    from docmill.operators.shaping import put

    scope, columns = scope_of(df), df.columns
    new, place = {}, None
    if stage.get("sortBy") and any(name in _PICKED for spec in stage["output"].values() for name in spec):
        at = "_place" + "_" * max(map(len, columns), default=0)
        df, place = df.withColumn(at, F.row_number().over(Frame(scope, stage, None).ordered)), F.col(at)
    for k, (path, spec) in enumerate(stage["output"].items()):
        if [x for x in spec if x != "window"] == ["$expMovingAvg"]:
            frame = Frame(scope, stage, spec.get("window"))
            if not frame.order:
                raise DocumentError(5371602, "$expMovingAvg needs a sortBy")
            df, new[path] = _moving_average(df, frame, spec["$expMovingAvg"], f"_average{k}" + "_" * max(map(len, columns), default=0))
        else:
            new[path] = window_output(spec, scope, stage, place)
    return put(df, new).drop(*[c for c in df.columns if c not in columns])


def fill(df: DataFrame, stage: dict, scope_of: Callable[[DataFrame], Scope]) -> DataFrame:
    """Nulls of the output fields by a value, the last known one, or a line between known ones."""
    from docmill.operators.shaping import put

    scope, by = scope_of(df), stage.get("partitionBy")
    if by is None and stage.get("partitionByFields"):
        by = {f: f"${f}" for f in stage["partitionByFields"]}
    frame = {"partitionBy": by, "sortBy": stage.get("sortBy")}
    new = {}
    for path, how in stage["output"].items():
        if "value" in how:
            new[path] = F.coalesce(resolve(scope, path)[0], compile_expression(how["value"], scope))
        elif how.get("method") in ("locf", "linear"):
            new[path] = window_output({"$locf" if how["method"] == "locf" else "$linearFill": f"${path}"}, scope, frame)
        else:
            raise DocumentError(6050202, "method must be linear or locf")
    return put(df, new)


def densify(df: DataFrame, stage: dict, scope_of: Callable[[DataFrame], Scope]) -> DataFrame:
    """Rows for the missing steps of a field; bounds are full, partition or [low, high), made up rows have only the field and partition."""
    field, rng = stage["field"], stage["range"]
    scope = scope_of(df)
    column, kind = resolve(scope, field)
    parts = stage.get("partitionByFields", [])
    step, date = rng["step"], V.value_class(kind) == "date"
    if not isinstance(step, (int, float)) or step <= 0:
        raise DocumentError(5733401, "the step must be greater than 0")
    if date:
        by = F.make_dt_interval(secs=F.lit(step * _unit(rng["unit"]) / 1000))
    else:
        by = F.lit(step).cast(kind)
    bounds = rng["bounds"]
    keys = [quoted(p) for p in parts]
    if bounds == "partition":
        lows = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    elif bounds == "full":
        lows = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
        lows = lows.join(df.select(*keys).distinct()) if keys else lows  # one row beside the partitions
    else:
        lo, hi = (F.lit(b).cast(kind) for b in bounds)
        lows = (df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()).select(*keys, lo.alias("_lo"), (hi - by).alias("_hi"))
    steps = lows.filter("_lo <= _hi").select(*keys, F.explode(F.sequence("_lo", "_hi", by)).alias(field))
    on = [*parts, field]
    missing = steps.join(df.select(*on).distinct(), on, "left_anti")
    return df.unionByName(missing, allowMissingColumns=True)
