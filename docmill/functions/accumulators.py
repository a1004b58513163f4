"""Accumulators of $group and of window frames as aggregate Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from docmill.errors import DocumentError
from docmill.functions import values as V
from docmill.functions.expressions import compile_expression, needs_whole, typed
from docmill.functions.paths import Scope, resolve

Order = list[tuple[Column, int]]
Builder = Callable[[Scope, object, Order], Column]
Over = Callable[[Column], Column]
_ACCUMULATORS: dict[str, Builder] = {}


def accumulator(*names: str) -> Callable[[Builder], Builder]:
    def keep(f: Builder) -> Builder:
        for n in names:
            _ACCUMULATORS[n] = f
        return f

    return keep


def accumulator_names() -> list[str]:
    return sorted(_ACCUMULATORS)


def compile_accumulator(spec: object, scope: Scope, order: Order | None = None) -> Column:
    """{"$name": operand} over a group. `order` is the order in which documents come in, where it matters."""
    if not isinstance(spec, dict):
        raise DocumentError(40234, "The field must be an accumulator object")
    if len(spec) != 1:
        raise DocumentError(40238, "The field must specify one accumulator")
    ((name, operand),) = spec.items()
    if name not in _ACCUMULATORS:
        raise DocumentError(15952, f"unknown group operator '{name}'")
    if isinstance(operand, (list, tuple)):
        raise DocumentError(40237, f"The {name} accumulator is a unary operator")
    return _ACCUMULATORS[name](scope, operand, order or [])


def order_key(order: Order) -> Column | None:
    """The keys of a sort order as one comparable value."""
    if not order:
        return None
    return F.struct(*[c.alias(f"k{i}") for i, (c, _) in enumerate(order)])


def _directions(order: Order) -> set[int]:
    return {d for _, d in order}


def sort_order(spec: dict, scope: Scope) -> Order:
    return [(V.sort_value(*resolve(scope, k), V.sort_direction(v)), V.sort_direction(v)) for k, v in spec.items()]


def _compare_by(order_size: int, directions: list[int]) -> Callable[[Column, Column], Column]:
    def cmp(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(order_size)):
            x, y = a["key"][f"k{i}"], b["key"][f"k{i}"]
            less = F.coalesce(x < y, x.isNull() & y.isNotNull())
            more = F.coalesce(x > y, x.isNotNull() & y.isNull())
            out = F.when(less, -directions[i]).when(more, directions[i]).otherwise(out)
        return out

    return cmp


def _group(aggregate: Column) -> Column:
    """An aggregate over the group; window frames put their own function in this place."""
    return aggregate


def _ordered(value: Column, order: Order, over: Over = _group) -> Column:
    """All values of the group as an array in the given order."""
    if not order:
        return over(F.collect_list(F.struct(value.alias("v"))))
    pairs = over(F.collect_list(F.struct(order_key(order).alias("key"), value.alias("v"))))
    return F.array_sort(pairs, _compare_by(len(order), [d for _, d in order]))


def _values(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["v"])


def _edge(value: Column, order: Order, last: bool, over: Over = _group, place: Column | None = None) -> Column:
    """First or last value: min_by/max_by where the keys all go one way, which needs no sorting of the group.

    place: the number of a document in the order in which they come in; of equal keys the first to come is taken.
    """
    if not order:
        return over(F.last(value) if last else F.first(value))
    if len(_directions(order)) == 1:
        greatest = (order[0][1] > 0) == last
        f, key = F.max_by if greatest else F.min_by, order
        if place is not None:
            key = [*order, (-place if greatest else place, 1)]
        return over(f(F.struct(value.alias("v")), order_key(key)))["v"]
    if place is not None:
        order = [*((c, -d if last else d) for c, d in order), (place, 1)]
    pairs = _ordered(value, order, over)
    return (F.try_element_at(pairs, F.lit(-1)) if last and place is None else F.get(pairs, F.lit(0)))["v"]


@accumulator("$sum")
def _sum(scope, operand, order):
    if isinstance(operand, (int, float)) and not isinstance(operand, bool):
        return F.count(F.lit(1)) if operand == 1 else F.coalesce(F.sum(V.literal(operand)), F.lit(0))
    column, kind = typed(operand, scope)
    if isinstance(kind, T.VariantType):
        column, kind = F.try_variant_get(column, "$", "double"), T.DoubleType()
    if not V.is_number(kind):
        return F.coalesce(F.sum(F.lit(0)), F.lit(0)).cast("long")
    if isinstance(kind, V.WHOLE):
        total = F.sum(column.cast("decimal(38,0)"))  # can't overflow on the way
        return F.coalesce(total, F.lit(0)).try_cast("bigint")
    return F.coalesce(F.sum(column), F.lit(0).cast(kind))


@accumulator("$avg")
def _avg(scope, operand, order):
    column, kind = typed(operand, scope)
    if isinstance(kind, T.VariantType):
        column, kind = F.try_variant_get(column, "$", "double"), T.DoubleType()
    return F.avg(column) if V.is_number(kind) else F.max(F.lit(None).cast("double"))


@accumulator("$count")
def _count(scope, operand, order):
    if operand != {}:
        raise DocumentError(14, "$count takes no arguments")
    return F.count(F.lit(1))


@accumulator("$min")
def _min(scope, operand, order):
    return F.min(compile_expression(operand, scope))


@accumulator("$max")
def _max(scope, operand, order):
    return F.max(compile_expression(operand, scope))


@accumulator("$first")
def _first(scope, operand, order):
    return _edge(compile_expression(operand, scope), order, False)


@accumulator("$last")
def _last(scope, operand, order):
    return _edge(compile_expression(operand, scope), order, True)


def _n_parts(name: str, operand: object, needs: tuple[str, ...]) -> dict:
    if not isinstance(operand, dict) or set(operand) != set(needs):
        raise DocumentError(5787801, f"{name} takes a document of {', '.join(needs)}")
    return operand


def _number(operand: dict, name: str) -> int:
    return needs_whole(operand["n"], name, 1)


@accumulator("$firstN")
def _first_n(scope, operand, order):
    p = _n_parts("$firstN", operand, ("input", "n"))
    return F.slice(_values(_ordered(compile_expression(p["input"], scope), order)), 1, _number(p, "$firstN"))


@accumulator("$lastN")
def _last_n(scope, operand, order):
    p = _n_parts("$lastN", operand, ("input", "n"))
    all_, n = _values(_ordered(compile_expression(p["input"], scope), order)), _number(p, "$lastN")
    return F.slice(all_, F.greatest(F.size(all_) - n + 1, F.lit(1)), F.lit(n))


def picked(name: str, operand: object, scope: Scope, over: Over = _group, place: Column | None = None) -> Column:
    """$top, $bottom, $topN and $bottomN of a group or a window frame; place: a document's number in the frame's order."""
    one = name in ("$top", "$bottom")
    p = _n_parts(name, operand, ("sortBy", "output") if one else ("sortBy", "output", "n"))
    value, order = compile_expression(p["output"], scope), sort_order(p["sortBy"], scope)
    if one:
        return _edge(value, order, name == "$bottom", over, place)
    order = order if place is None else [*order, (place if name == "$topN" else -place, 1)]
    all_, n = _values(_ordered(value, order, over)), _number(p, name)
    return F.slice(all_, 1, n) if name == "$topN" else F.slice(all_, F.greatest(F.size(all_) - n + 1, F.lit(1)), F.lit(n))


for _name in ("$top", "$bottom", "$topN", "$bottomN"):
    _ACCUMULATORS[_name] = lambda scope, operand, order, name=_name: picked(name, operand, scope)


@accumulator("$minN")
def _min_n(scope, operand, order):
    p = _n_parts("$minN", operand, ("input", "n"))
    return F.slice(F.sort_array(F.collect_list(compile_expression(p["input"], scope))), 1, _number(p, "$minN"))


@accumulator("$maxN")
def _max_n(scope, operand, order):
    p = _n_parts("$maxN", operand, ("input", "n"))
    return F.slice(F.sort_array(F.collect_list(compile_expression(p["input"], scope)), False), 1, _number(p, "$maxN"))


@accumulator("$push")
def _push(scope, operand, order):
    value = compile_expression(operand, scope)
    return _values(_ordered(value, order)) if order else F.collect_list(value)


@accumulator("$addToSet")
def _add_to_set(scope, operand, order):
    return F.collect_set(compile_expression(operand, scope))


def merged_objects(operand: object, scope: Scope, order: Order, over: Over = _group) -> Column:
    column, kind = typed(operand, scope)
    if not isinstance(kind, T.StructType):
        raise DocumentError(40400, "$mergeObjects requires object inputs")
    key = order_key(order)
    parts = []
    for f in kind.fields:
        value = column.getField(f.name)
        parts.append(over(F.max_by(value, F.when(value.isNotNull(), key)) if key is not None else F.last(value, ignorenulls=True)).alias(f.name))
    return F.struct(*parts)


@accumulator("$mergeObjects")
def _merge_objects(scope, operand, order):
    return merged_objects(operand, scope, order)


@accumulator("$stdDevPop")
def _std_pop(scope, operand, order):
    return F.stddev_pop(compile_expression(operand, scope))


@accumulator("$stdDevSamp")
def _std_samp(scope, operand, order):
    return F.stddev_samp(compile_expression(operand, scope))


@accumulator("$percentile")
def _percentile(scope, operand, order):
    """`method` exact interpolates between neighbours; approximate uses a bounded sketch."""
    p = _n_parts("$percentile", operand, ("input", "p", "method"))
    column = compile_expression(p["input"], scope).cast("double")
    if p["method"] == "approximate":
        return F.percentile_approx(column, [float(x) for x in p["p"]], 10000)
    return F.percentile(column, F.array(*[F.lit(float(x)) for x in p["p"]]))


@accumulator("$median")
def _median(scope, operand, order):
    p = _n_parts("$median", operand, ("input", "method"))
    column = compile_expression(p["input"], scope).cast("double")
    return F.percentile_approx(column, 0.5, 10000) if p["method"] == "approximate" else F.percentile(column, 0.5)
