"""Aggregation expressions compiled to native Columns.

An operator is a function from (scope, operands) to a Column, registered with
the number of operands it takes. Types are asked of Spark only where an
operator's meaning depends on them.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from docmill.errors import DocumentError, bad_value
from docmill.functions import values as V
from docmill.functions.paths import Scope, assigned, dropped, follow, resolve, split_path, step

Operator = Callable[[Scope, list], Column]
_OPERATORS: dict[str, tuple[Operator, int, int]] = {}
_WITH_DOCUMENT: dict[str, Callable[[Scope, object], Column]] = {}


def operator(name: str, least: int = 1, most: int | None = None) -> Callable[[Operator], Operator]:
    def keep(f: Operator) -> Operator:
        _OPERATORS[name] = (f, least, least if most is None else most)
        return f

    return keep


def with_document(name: str) -> Callable:
    """An operator whose operand is a document of named arguments."""

    def keep(f: Callable[[Scope, object], Column]) -> Callable:
        _WITH_DOCUMENT[name] = f
        return f

    return keep


def register_expression(name: str, build: Callable[..., Column], least: int = 1, most: int | None = None) -> None:
    """Add an operator of one's own: build gets its operands as Columns (a pandas UDF will do)."""
    if not name.startswith("$"):
        raise bad_value("an operator's name begins with $")
    _OPERATORS[name] = (lambda s, a: build(*[compile_expression(x, s) for x in a]), least, most if most is not None else least)


def operator_names() -> list[str]:
    return sorted({*_OPERATORS, *_WITH_DOCUMENT})


def compile_expression(expr: object, scope: Scope) -> Column:
    if isinstance(expr, Column):
        return expr
    if isinstance(expr, str) and expr.startswith("$"):
        return reference(expr, scope)[0]
    if isinstance(expr, dict):
        names = [k for k in expr if k.startswith("$")]
        if names:
            if len(expr) != 1:
                raise DocumentError(15983, f"An object representing an expression must have exactly one field: {expr}")
            return apply(names[0], expr[names[0]], scope)
        return F.struct(*[compile_expression(v, scope).alias(k) for k, v in expr.items()])
    if isinstance(expr, (list, tuple)):
        return F.array(*[compile_expression(x, scope) for x in expr])
    return V.literal(expr)


def apply(name: str, operand: object, scope: Scope) -> Column:
    if name in _WITH_DOCUMENT:
        return _WITH_DOCUMENT[name](scope, operand)
    if name not in _OPERATORS:
        raise DocumentError(168, f"Unrecognized expression '{name}'")
    build, least, most = _OPERATORS[name]
    operands = list(operand) if isinstance(operand, (list, tuple)) else [operand]
    if not least <= len(operands) <= most:
        wants = f"exactly {least}" if least == most else f"at least {least} and at most {most}"
        raise DocumentError(16020, f"Expression {name} takes {wants} arguments. {len(operands)} were passed in.")
    return build(scope, operands)


def reference(path: str, scope: Scope) -> tuple[Column, T.DataType]:
    """$path, $$variable and $$variable.path."""
    if path == "$":
        raise DocumentError(16872, "'$' by itself is not a valid FieldPath")
    if not path.startswith("$$"):
        if path[1:].split(".")[0].startswith("$"):
            raise DocumentError(16410, "FieldPath field names may not start with '$'.")
        return resolve(scope, path[1:])
    if path in ("$$", "$$$") or path[2:3] == "$":
        raise DocumentError(9, "empty or invalid variable name")
    name, *rest = path[2:].split(".")
    if name in scope.vars:
        return follow(*scope.vars[name], rest)
    if name in ("ROOT", "CURRENT"):
        return resolve(scope, ".".join(rest)) if rest else scope.root()
    if name == "NOW":
        return F.current_timestamp(), T.TimestampType()
    if name == "REMOVE":
        return F.lit(None), T.NullType()
    raise DocumentError(17276, f"Use of undefined variable: {name}")


def kind_of(expr: object, scope: Scope) -> T.DataType:
    if isinstance(expr, str) and expr.startswith("$"):
        return reference(expr, scope)[1]
    return scope.type_of(lambda s: compile_expression(expr, s))


def typed(expr: object, scope: Scope) -> tuple[Column, T.DataType]:
    return compile_expression(expr, scope), kind_of(expr, scope)


def truth(expr: object, scope: Scope) -> Column:
    return V.truthy(*typed(expr, scope))


def _all(scope: Scope, operands: list) -> list[Column]:
    return [compile_expression(x, scope) for x in operands]


def _fields(name: str, operand: object, needs: tuple[str, ...], may: tuple[str, ...] = ()) -> dict:
    if not isinstance(operand, dict):
        raise DocumentError(9, f"{name} only supports an object as its argument")
    unknown = [k for k in operand if k not in needs + may]
    missing = [k for k in needs if k not in operand]
    if unknown or missing:
        raise DocumentError(9, f"{name}: " + (f"unknown argument {unknown[0]}" if unknown else f"missing argument {missing[0]}"))
    return operand


# --- arithmetic ---


def _simple(name: str, f: Callable[..., Column], n: int = 1) -> None:
    _OPERATORS[name] = (lambda s, a: f(*_all(s, a)), n, n)


def _toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


@operator("$add", 0, 1000)
def _add(scope, operands):
    kinds = [kind_of(x, scope) for x in operands]
    dates = [i for i, k in enumerate(kinds) if V.value_class(k) == "date"]
    columns = _all(scope, operands)
    if len(dates) > 1:
        raise DocumentError(16612, "only one date allowed in an $add expression")
    if dates:
        millis = F.lit(0).cast("long")
        for i, c in enumerate(columns):
            if i != dates[0]:
                millis = millis + c.cast("long")
        return F.timestamp_add("MILLISECOND", millis, columns[dates[0]].cast("timestamp"))
    return _folded(columns, kinds, lambda a, b: a + b, 0)


def _folded(columns: list[Column], kinds: list[T.DataType], f: Callable, start: int) -> Column:
    """Whole numbers widen to long before they are combined, so that int overflow can't abort a query."""
    out = None
    for c, k in zip(columns, kinds, strict=True):
        c = c.cast("long") if isinstance(k, V.WHOLE) else c
        out = c if out is None else f(out, c)
    return F.lit(start) if out is None else out


@operator("$multiply", 0, 1000)
def _multiply(scope, operands):
    return _folded(_all(scope, operands), [kind_of(x, scope) for x in operands], lambda a, b: a * b, 1)


@operator("$subtract", 2)
def _subtract(scope, operands):
    (a, ka), (b, kb) = typed(operands[0], scope), typed(operands[1], scope)
    if V.value_class(ka) == "date":
        if V.value_class(kb) == "date":
            return F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))
        return F.timestamp_add("MILLISECOND", -b.cast("long"), a.cast("timestamp"))
    return _folded([a, b], [ka, kb], lambda x, y: x - y, 0)


@operator("$divide", 2)
def _divide(scope, operands):
    a, b = _all(scope, operands)
    return F.try_divide(a.cast("double"), b.cast("double"))


@operator("$mod", 2)
def _mod(scope, operands):
    a, b = _all(scope, operands)
    return F.try_mod(a, b)


@operator("$round", 1, 2)
def _round(scope, operands):
    """Ties go to the even neighbour."""
    return F.bround(compile_expression(operands[0], scope), _whole(operands[1:], 0))


def _whole(operands: list, default: int) -> int:
    value = operands[0] if operands else default
    if isinstance(value, bool) or not isinstance(value, int):
        raise DocumentError(51081, "precision must be a whole number")
    return value


@operator("$trunc", 1, 2)
def _trunc(scope, operands):
    place = _whole(operands[1:], 0)
    x = compile_expression(operands[0], scope)
    return _toward_zero(x) if not place else _toward_zero(x * 10.0**place) / 10.0**place


@operator("$log", 2)
def _log(scope, operands):
    x, base = _all(scope, operands)
    return F.ln(x) / F.ln(base)


@operator("$sum", 0, 1000)
def _sum(scope, operands):
    """Numbers among the operands, and inside those that are arrays; everything else counts as nothing."""
    return _numbers(scope, operands, lambda total, n: total[0])


@operator("$avg", 0, 1000)
def _avg(scope, operands):
    return _numbers(scope, operands, lambda total, n: F.try_divide(total[0].cast("double"), total[1].cast("double")))


def _numbers(scope, operands, finish):
    total, count = F.lit(0).cast("long"), F.lit(0).cast("long")
    for x in operands:
        column, kind = typed(x, scope)
        if V.is_number(kind):
            wide = "long" if isinstance(kind, V.WHOLE) else "double"
            total = total + F.coalesce(column.cast(wide), F.lit(0).cast(wide))
            count = count + F.when(column.isNotNull(), 1).otherwise(0)
        elif isinstance(kind, T.ArrayType) and V.is_number(kind.elementType):
            wide = "long" if isinstance(kind.elementType, V.WHOLE) else "double"
            inner = F.aggregate(column, F.lit(0).cast(wide), lambda a, e: a + F.coalesce(e.cast(wide), F.lit(0).cast(wide)))
            total = total + F.coalesce(inner, F.lit(0).cast(wide))
            count = count + F.coalesce(F.size(F.filter(column, lambda e: e.isNotNull())), F.lit(0))
    return finish((total, count), len(operands))


@operator("$min", 1, 1000)
def _min(scope, operands):
    return _extreme(scope, operands, F.least, F.array_min)


@operator("$max", 1, 1000)
def _max(scope, operands):
    return _extreme(scope, operands, F.greatest, F.array_max)


def _extreme(scope, operands, among, inside):
    if len(operands) == 1:
        column, kind = typed(operands[0], scope)
        return inside(column) if isinstance(kind, T.ArrayType) else column
    return among(*_all(scope, operands))


for _name, _f in {
    "$abs": F.abs,
    "$ceil": F.ceil,
    "$floor": F.floor,
    "$exp": F.exp,
    "$ln": F.ln,
    "$log10": F.log10,
    "$sqrt": F.sqrt,
    "$sin": F.sin,
    "$cos": F.cos,
    "$tan": F.tan,
    "$asin": F.asin,
    "$acos": F.acos,
    "$atan": F.atan,
    "$sinh": F.sinh,
    "$cosh": F.cosh,
    "$tanh": F.tanh,
    "$asinh": F.asinh,
    "$acosh": F.acosh,
    "$atanh": F.atanh,
    "$degreesToRadians": F.radians,
    "$radiansToDegrees": F.degrees,
}.items():
    _simple(_name, _f)
_simple("$pow", F.pow, 2)
_simple("$atan2", F.atan2, 2)


@with_document("$rand")
def _rand(scope, operand):
    return F.rand()


@operator("$sampleRate")
def _sample_rate(scope, operands):
    return F.rand() < F.lit(float(operands[0]))


# --- booleans and comparisons ---


@operator("$and", 0, 1000)
def _and(scope, operands):
    return V.all_of(truth(x, scope) for x in operands)


@operator("$or", 0, 1000)
def _or(scope, operands):
    return V.any_of(truth(x, scope) for x in operands)


@operator("$not")
def _not(scope, operands):
    return ~truth(operands[0], scope)


def _rank(kind: T.DataType) -> int:
    cls = V.value_class(kind)
    return V.CLASS_ORDER.index(cls) if cls in V.CLASS_ORDER else len(V.CLASS_ORDER)


def _compared(scope, operands, op: str) -> Column:
    """Values of different classes compare by class, null is lowest and equals missing."""
    (a, ka), (b, kb) = typed(operands[0], scope), typed(operands[1], scope)
    if isinstance(ka, T.VariantType) != isinstance(kb, T.VariantType):
        if isinstance(ka, T.VariantType):
            a = F.try_variant_get(a, "$", kb.simpleString())
        else:
            b = F.try_variant_get(b, "$", ka.simpleString())
        ka = kb = kb if isinstance(ka, T.VariantType) else ka
    below, same = {"eq": (False, True), "gt": (False, False), "gte": (False, True), "lt": (True, False), "lte": (True, True)}[op]
    if V.value_class(ka) == V.value_class(kb):
        if op == "eq":
            return a.eqNullSafe(b)
        both = V.compare(a, op, b)
        left_null, right_null = a.isNull(), b.isNull()
        return F.when(left_null & right_null, same).when(left_null, below).when(right_null, not below).otherwise(both)
    if op == "eq":
        return a.isNull() & b.isNull()
    by_class = (_rank(ka) < _rank(kb)) == below
    return F.when(a.isNull() & b.isNull(), same).when(a.isNull(), below).when(b.isNull(), not below).otherwise(by_class)


for _op in ("eq", "gt", "gte", "lt", "lte"):
    _OPERATORS[f"${_op}"] = (lambda s, a, op=_op: _compared(s, a, op), 2, 2)
_OPERATORS["$ne"] = (lambda s, a: ~_compared(s, a, "eq"), 2, 2)


@operator("$cmp", 2)
def _cmp(scope, operands):
    return F.when(_compared(scope, operands, "lt"), -1).when(_compared(scope, operands, "gt"), 1).otherwise(0)


# --- conditions, variables, literals ---


@with_document("$cond")
def _cond(scope, operand):
    if isinstance(operand, dict):
        parts = _fields("$cond", operand, ("if", "then", "else"))
        operand = [parts["if"], parts["then"], parts["else"]]
    if not isinstance(operand, (list, tuple)) or len(operand) != 3:
        raise DocumentError(16020, "Expression $cond takes exactly 3 arguments.")
    return F.when(truth(operand[0], scope), compile_expression(operand[1], scope)).otherwise(compile_expression(operand[2], scope))


@operator("$ifNull", 2, 1000)
def _if_null(scope, operands):
    return F.coalesce(*_all(scope, operands))


@with_document("$switch")
def _switch(scope, operand):
    parts = _fields("$switch", operand, ("branches",), ("default",))
    if not parts["branches"]:
        raise DocumentError(40068, "$switch requires at least one branch.")
    out = None
    for b in parts["branches"]:
        b = _fields("$switch", b, ("case", "then"))
        then = compile_expression(b["then"], scope)
        out = F.when(truth(b["case"], scope), then) if out is None else out.when(truth(b["case"], scope), then)
    return out.otherwise(compile_expression(parts["default"], scope)) if "default" in parts else out


@with_document("$let")
def _let(scope, operand):
    parts = _fields("$let", operand, ("vars", "in"))
    return compile_expression(parts["in"], scope.bind(**{k: typed(v, scope) for k, v in parts["vars"].items()}))


@with_document("$literal")
def _literal(scope, operand):
    return V.literal(operand)


@with_document("$getField")
def _get_field(scope, operand):
    parts = operand if isinstance(operand, dict) and "field" in operand else {"field": operand}
    name = parts["field"]["$literal"] if isinstance(parts["field"], dict) else parts["field"]
    column, kind = typed(parts["input"], scope) if "input" in parts else scope.root()
    return (step(column, kind, name) or (F.lit(None), None))[0]


@with_document("$setField")
def _set_field(scope, operand):
    parts = _fields("$setField", operand, ("field", "input", "value"))
    column, kind = typed(parts["input"], scope)
    if parts["value"] == "$$REMOVE":
        return dropped(column, kind, [parts["field"]])
    return assigned(column, kind, [parts["field"]], compile_expression(parts["value"], scope))


@with_document("$unsetField")
def _unset_field(scope, operand):
    parts = _fields("$unsetField", operand, ("field", "input"))
    return dropped(*typed(parts["input"], scope), [parts["field"]])


@operator("$meta")
def _meta(scope, operands):
    names = {"textScore": "_score", "searchScore": "_score", "vectorSearchScore": "_score"}
    if operands[0] not in names:
        raise bad_value(f"unsupported $meta {operands[0]!r}")
    return F.col(names[operands[0]])


# --- arrays ---


def _lambda(name: str, parts: dict, scope: Scope, body: object, to_bool: bool = False) -> Callable[[Column], Column]:
    kind = kind_of(parts["input"], scope)
    element = kind.elementType if isinstance(kind, T.ArrayType) else T.NullType()
    as_ = parts.get("as", "this")

    def inside(e: Column) -> Column:
        inner = scope.bind(**{as_: (e, element)})
        return truth(body, inner) if to_bool else compile_expression(body, inner)

    return inside


@with_document("$map")
def _map(scope, operand):
    parts = _fields("$map", operand, ("input", "in"), ("as",))
    return F.transform(compile_expression(parts["input"], scope), _lambda("$map", parts, scope, parts["in"]))


@with_document("$filter")
def _filter(scope, operand):
    parts = _fields("$filter", operand, ("input", "cond"), ("as", "limit"))
    kept = F.filter(compile_expression(parts["input"], scope), _lambda("$filter", parts, scope, parts["cond"], True))
    return F.slice(kept, 1, compile_expression(parts["limit"], scope)) if parts.get("limit") is not None else kept


@with_document("$reduce")
def _reduce(scope, operand):
    parts = _fields("$reduce", operand, ("input", "initialValue", "in"))
    array, kind = typed(parts["input"], scope)
    start, start_kind = typed(parts["initialValue"], scope)
    element = kind.elementType
    # The accumulator takes the type that one step gives.
    step_kind = scope.bind(this=(F.lit(None), element), value=(F.lit(None), start_kind)).type_of(lambda s: compile_expression(parts["in"], s))
    wide = T.LongType() if isinstance(step_kind, V.WHOLE) else step_kind
    return F.aggregate(array, start.cast(wide), lambda a, e: compile_expression(parts["in"], scope.bind(value=(a, wide), this=(e, element))).cast(wide))


@operator("$arrayElemAt", 2)
def _array_elem_at(scope, operands):
    array, at = _all(scope, operands)
    return F.get(array, F.when(at < 0, F.size(array) + at).otherwise(at).cast("int"))


@operator("$first")
def _first(scope, operands):
    return F.get(compile_expression(operands[0], scope), F.lit(0))


@operator("$last")
def _last(scope, operands):
    return F.try_element_at(compile_expression(operands[0], scope), F.lit(-1))


@with_document("$firstN")
def _first_n(scope, operand):
    parts = _fields("$firstN", operand, ("input", "n"))
    return F.slice(compile_expression(parts["input"], scope), F.lit(1), compile_expression(parts["n"], scope).cast("int"))


@with_document("$lastN")
def _last_n(scope, operand):
    parts = _fields("$lastN", operand, ("input", "n"))
    array, n = compile_expression(parts["input"], scope), compile_expression(parts["n"], scope).cast("int")
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


@with_document("$minN")
def _min_n(scope, operand):
    parts = _fields("$minN", operand, ("input", "n"))
    return F.slice(F.array_compact(F.sort_array(compile_expression(parts["input"], scope))), F.lit(1), compile_expression(parts["n"], scope).cast("int"))


@with_document("$maxN")
def _max_n(scope, operand):
    parts = _fields("$maxN", operand, ("input", "n"))
    return F.slice(F.array_compact(F.sort_array(compile_expression(parts["input"], scope), False)), F.lit(1), compile_expression(parts["n"], scope).cast("int"))


@operator("$in", 2)
def _in(scope, operands):
    value, array = _all(scope, operands)
    return F.coalesce(F.exists(array, lambda e: e.eqNullSafe(value)), F.lit(False))


@operator("$indexOfArray", 2, 4)
def _index_of_array(scope, operands):
    array, value, *bounds = _all(scope, operands)
    start = bounds[0] if bounds else F.lit(0)
    end = bounds[1] if len(bounds) > 1 else F.size(array)
    part = F.slice(array, start + 1, F.greatest(end - start, F.lit(0)))
    at = F.array_position(part, value)
    return F.when(array.isNull(), F.lit(None)).when(at > 0, at - 1 + start).otherwise(F.lit(-1)).cast("int")


@operator("$isArray")
def _is_array(scope, operands):
    return F.lit(isinstance(kind_of(operands[0], scope), T.ArrayType)) & compile_expression(operands[0], scope).isNotNull()


@operator("$size")
def _size(scope, operands):
    column, kind = typed(operands[0], scope)
    if not isinstance(kind, T.ArrayType):
        raise DocumentError(17124, "The argument to $size must be an array.")
    return F.when(column.isNotNull(), F.size(column)).otherwise(F.raise_error(F.lit("The argument to $size must be an array, but was missing")).cast("int"))


@operator("$concatArrays", 0, 1000)
def _concat_arrays(scope, operands):
    return F.concat(*_all(scope, operands)) if operands else F.array()


@operator("$reverseArray")
def _reverse_array(scope, operands):
    return F.reverse(compile_expression(operands[0], scope))


@operator("$range", 2, 3)
def _range(scope, operands):
    start, end, *rest = (c.cast("long") for c in _all(scope, operands))
    by = rest[0] if rest else F.lit(1).cast("long")
    none = F.array().cast("array<bigint>")
    empty = ((by > 0) & (start >= end)) | ((by < 0) & (start <= end))
    return F.when(empty, none).otherwise(F.sequence(start, F.when(empty, start).otherwise(end - F.signum(by).cast("long")), F.when(empty, F.lit(0).cast("long")).otherwise(by)))


@operator("$slice", 2, 3)
def _slice(scope, operands):
    array, a, *rest = _all(scope, operands)
    size = F.size(array)
    if rest:
        start = F.when(a < 0, F.greatest(size + a, F.lit(0))).otherwise(a)
        return F.slice(array, (start + 1).cast("int"), rest[0].cast("int"))
    return F.when(a >= 0, F.slice(array, F.lit(1), F.greatest(a, F.lit(0)).cast("int"))).otherwise(F.slice(array, F.greatest(size + a, F.lit(0)).cast("int") + 1, F.abs(a).cast("int")))


@with_document("$sortArray")
def _sort_array(scope, operand):
    parts = _fields("$sortArray", operand, ("input", "sortBy"))
    array, kind = typed(parts["input"], scope)
    return sorted_array(array, kind, parts["sortBy"])


def sorted_array(array: Column, kind: T.DataType, by: object) -> Column:
    """Elements in the order of 1, -1 or a document of paths; equal ones stay together by value."""
    if not isinstance(by, dict):
        return F.sort_array(array, V.sort_direction(by) > 0)
    keys = [(split_path(k), V.sort_direction(v)) for k, v in by.items()]
    element = kind.elementType

    def order(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for names, direction in reversed(keys):
            x, y = follow(a, element, names)[0], follow(b, element, names)[0]
            less = F.coalesce(x < y, x.isNull() & y.isNotNull())
            more = F.coalesce(x > y, x.isNotNull() & y.isNull())
            out = F.when(less, -direction).when(more, direction).otherwise(out)
        return out

    return F.array_sort(array, order)


@with_document("$zip")
def _zip(scope, operand):
    parts = _fields("$zip", operand, ("inputs",), ("useLongestLength", "defaults"))
    arrays = [compile_expression(x, scope) for x in parts["inputs"]]
    sizes = [F.size(a) for a in arrays]
    pick = F.greatest if parts.get("useLongestLength") else F.least
    n = pick(*sizes) if len(sizes) > 1 else sizes[0]
    defaults = [V.literal(x) for x in parts.get("defaults", [None] * len(arrays))]
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array(*[F.when(i < F.size(a), F.get(a, i)).otherwise(d) for a, d in zip(arrays, defaults, strict=True)]))


@operator("$allElementsTrue")
def _all_true(scope, operands):
    array, kind = typed(operands[0], scope)
    return F.forall(array, lambda e: V.truthy(e, kind.elementType))


@operator("$anyElementTrue")
def _any_true(scope, operands):
    array, kind = typed(operands[0], scope)
    return F.exists(array, lambda e: V.truthy(e, kind.elementType))


@operator("$arrayToObject")
def _array_to_object(scope, operands):
    array, kind = typed(operands[0], scope)
    if isinstance(kind.elementType, T.ArrayType):
        array = F.transform(array, lambda e: F.struct(F.get(e, F.lit(0)).alias("k"), F.get(e, F.lit(1)).alias("v")))
    return F.map_from_entries(array)


# --- sets ---

_simple("$setDifference", F.array_except, 2)


@operator("$setEquals", 2, 1000)
def _set_equals(scope, operands):
    first, *rest = (F.sort_array(F.array_distinct(c)) for c in _all(scope, operands))
    return V.all_of(first == r for r in rest)


@operator("$setIntersection", 0, 1000)
def _set_intersection(scope, operands):
    first, *rest = _all(scope, operands)
    out = F.array_distinct(first)
    for r in rest:
        out = F.array_intersect(out, r)
    return out


@operator("$setUnion", 0, 1000)
def _set_union(scope, operands):
    first, *rest = _all(scope, operands)
    out = F.array_distinct(first)
    for r in rest:
        out = F.array_union(out, r)
    return out


@operator("$setIsSubset", 2)
def _set_is_subset(scope, operands):
    a, b = _all(scope, operands)
    return F.size(F.array_except(a, b)) == 0


# --- documents ---


@operator("$mergeObjects", 0, 1000)
def _merge_objects(scope, operands):
    fields: dict[str, Column] = {}
    for x in operands:
        column, kind = typed(x, scope)
        if isinstance(kind, T.MapType):
            raise DocumentError(238, "$mergeObjects of maps beside documents")
        for f in kind.fields if isinstance(kind, T.StructType) else []:
            new = column.getField(f.name)
            fields[f.name] = F.coalesce(new, fields[f.name]) if f.name in fields else new
    return F.struct(*[c.alias(k) for k, c in fields.items()]) if fields else F.struct()


@operator("$objectToArray")
def _object_to_array(scope, operands):
    column, kind = typed(operands[0], scope)
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    kinds = {f.dataType for f in kind.fields}
    as_ = kind.fields[0].dataType if len(kinds) == 1 else (T.DoubleType() if all(V.is_number(k) for k in kinds) else T.StringType())
    return F.when(column.isNotNull(), F.array(*[F.struct(F.lit(f.name).alias("k"), column.getField(f.name).cast(as_).alias("v")) for f in kind.fields]))


# --- strings ---

_simple("$toLower", F.lower)
_simple("$toUpper", F.upper)
_simple("$strLenBytes", F.octet_length)
_simple("$strLenCP", F.char_length)
_simple("$binarySize", F.octet_length)


@operator("$concat", 0, 1000)
def _concat(scope, operands):
    return F.concat(*_all(scope, operands)) if operands else F.lit("")


@operator("$substrCP", 3)
def _substr_cp(scope, operands):
    text, start, n = _all(scope, operands)
    return F.substring(F.coalesce(text.cast("string"), F.lit("")), (start + 1).cast("int"), F.when(n < 0, F.lit(2**31 - 1)).otherwise(n).cast("int"))


@operator("$substrBytes", 3)
def _substr_bytes(scope, operands):
    text, start, n = _all(scope, operands)
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    return F.substring(raw, (start + 1).cast("int"), F.when(n < 0, F.lit(2**31 - 1)).otherwise(n).cast("int")).cast("string")


_OPERATORS["$substr"] = _OPERATORS["$substrBytes"]


def _index_of(scope, operands, size: Callable[[Column], Column]) -> Column:
    """Position of a substring from a start to an end, in the units that `size` counts."""
    text, part, *bounds = _all(scope, operands)
    start = bounds[0] if bounds else F.lit(0)
    found = F.call_function("locate", part, text, start + 1)
    at = F.when(found > 0, size(F.substring(text, F.lit(1), found - 1))).otherwise(F.lit(-1))
    if len(bounds) > 1:
        at = F.when(at < bounds[1], at).otherwise(F.lit(-1))
    return F.when(text.isNotNull(), at)


@operator("$indexOfCP", 2, 4)
def _index_of_cp(scope, operands):
    return _index_of(scope, operands, F.char_length)


@operator("$indexOfBytes", 2, 4)
def _index_of_bytes(scope, operands):
    return _index_of(scope, operands, F.octet_length)


def _trimmed(f: Callable) -> Callable:
    def build(scope, operand):
        parts = _fields("$trim", operand, ("input",), ("chars",))
        text = compile_expression(parts["input"], scope)
        return f(text, compile_expression(parts["chars"], scope) if "chars" in parts else F.lit(" \t\n\r\x0b\x0c\0 "))

    return build


for _name, _f in {"$trim": F.btrim, "$ltrim": F.ltrim, "$rtrim": F.rtrim}.items():
    _WITH_DOCUMENT[_name] = _trimmed(_f)


@operator("$split", 2)
def _split(scope, operands):
    text, by = _all(scope, operands)
    return F.split(text, F.concat(F.lit("\\Q"), F.replace(by, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)


@operator("$strcasecmp", 2)
def _strcasecmp(scope, operands):
    a, b = (F.lower(F.coalesce(c.cast("string"), F.lit(""))) for c in _all(scope, operands))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


@with_document("$replaceAll")
def _replace_all(scope, operand):
    parts = _fields("$replaceAll", operand, ("input", "find", "replacement"))
    return F.replace(*[compile_expression(parts[k], scope) for k in ("input", "find", "replacement")])


@with_document("$replaceOne")
def _replace_one(scope, operand):
    parts = _fields("$replaceOne", operand, ("input", "find", "replacement"))
    text, find, new = (compile_expression(parts[k], scope) for k in ("input", "find", "replacement"))
    at = F.call_function("locate", find, text)
    changed = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.char_length(find), F.lit(2**31 - 1)))
    return F.when(text.isNull() | find.isNull() | new.isNull(), F.lit(None).cast("string")).when(at > 0, changed).otherwise(text)


def regex_text(pattern: object, options: str = "") -> str:
    """The pattern with its options as an inline prefix; unknown options and broken patterns are errors."""
    if isinstance(pattern, re.Pattern):
        flags = "".join(c for c, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & f)
        pattern, options = pattern.pattern, flags + options
    if not isinstance(pattern, str):
        raise bad_value("$regex has to be a string")
    if set(options) - set("imsx"):
        raise DocumentError(51108, f"invalid flag in regex options: {options}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise DocumentError(51091, f"Regular expression is invalid: {e}") from None
    return (f"(?{''.join(sorted(set(options)))})" if options else "") + pattern


def _regex_parts(name: str, scope: Scope, operand: object) -> tuple[Column, Column]:
    parts = _fields(name, operand, ("input", "regex"), ("options",))
    return compile_expression(parts["input"], scope), F.lit(regex_text(parts["regex"], parts.get("options", "")))


@with_document("$regexMatch")
def _regex_match(scope, operand):
    text, pattern = _regex_parts("$regexMatch", scope, operand)
    return F.coalesce(F.rlike(text, pattern), F.lit(False))


@with_document("$regexFind")
def _regex_find(scope, operand):
    text, pattern = _regex_parts("$regexFind", scope, operand)
    groups = re.compile(re.sub(r"^\(\?[imsx]+\)", "", regex_text(operand["regex"]))).groups
    found = F.regexp_instr(text, pattern)
    captures = F.array(*[F.regexp_extract(text, regex_text(operand["regex"], operand.get("options", "")), i + 1) for i in range(groups)]).cast("array<string>")
    return F.when(found > 0, F.struct(F.regexp_substr(text, pattern).alias("match"), (found - 1).alias("idx"), captures.alias("captures")))


@with_document("$regexFindAll")
def _regex_find_all(scope, operand):
    """Matches with their positions, by cutting the text at each match in turn."""
    text, pattern = _regex_parts("$regexFindAll", scope, operand)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    folded = F.aggregate(
        matches,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,idx:int>>").alias("found")),
        lambda a, m: _next_match(text, a, m),
    )
    return F.coalesce(folded["found"], F.array().cast("array<struct<match:string,idx:int>>"))


def _next_match(text: Column, a: Column, m: Column) -> Column:
    at = F.call_function("locate", m, text, a["at"] + 1) - 1
    return F.struct((at + F.greatest(F.char_length(m), F.lit(1))).alias("at"), F.concat(a["found"], F.array(F.struct(m.alias("match"), at.alias("idx")))).alias("found"))


# --- dates ---


def _date(expr: object, scope: Scope) -> Column:
    parts = expr if isinstance(expr, dict) and "date" in expr else {"date": expr}
    column = compile_expression(parts["date"], scope).cast("timestamp")
    zone = parts.get("timezone")
    return F.from_utc_timestamp(column, compile_expression(zone, scope)) if zone is not None else column


def _date_part(name: str, f: Callable[[Column], Column]) -> None:
    def build(scope: Scope, operand: object) -> Column:
        if isinstance(operand, (list, tuple)):
            if len(operand) != 1:
                raise DocumentError(40536, f"{name} accepts exactly one argument if given an array")
            operand = operand[0]
        return f(_date(operand, scope))

    _WITH_DOCUMENT[name] = build


def _sunday_week(d: Column) -> Column:
    """Weeks begin on Sunday; the days before the first one are week 0."""
    return F.floor((F.dayofyear(d) + 6 - (F.dayofweek(d) - 1)) / 7).cast("int")


for _name, _f in {
    "$year": F.year,
    "$month": F.month,
    "$dayOfMonth": F.dayofmonth,
    "$dayOfYear": F.dayofyear,
    "$dayOfWeek": F.dayofweek,
    "$isoDayOfWeek": lambda d: F.weekday(d) + 1,
    "$isoWeek": F.weekofyear,
    "$isoWeekYear": lambda d: F.extract(F.lit("YEAROFWEEK"), d),
    "$week": _sunday_week,
    "$hour": F.hour,
    "$minute": F.minute,
    "$second": F.second,
    "$millisecond": lambda d: F.pmod(F.unix_millis(d), F.lit(1000)).cast("int"),
}.items():
    _date_part(_name, _f)

UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond")


def _unit(value: object) -> str:
    if value not in UNITS:
        raise DocumentError(9, f"unknown time unit value: {value!r}")
    return value


@with_document("$dateAdd")
def _date_add(scope, operand):
    parts = _fields("$dateAdd", operand, ("startDate", "unit", "amount"), ("timezone",))
    return F.timestamp_add(_unit(parts["unit"]).upper(), compile_expression(parts["amount"], scope).cast("int"), compile_expression(parts["startDate"], scope).cast("timestamp"))


@with_document("$dateSubtract")
def _date_subtract(scope, operand):
    parts = _fields("$dateSubtract", operand, ("startDate", "unit", "amount"), ("timezone",))
    return F.timestamp_add(_unit(parts["unit"]).upper(), -compile_expression(parts["amount"], scope).cast("int"), compile_expression(parts["startDate"], scope).cast("timestamp"))


@with_document("$dateDiff")
def _date_diff(scope, operand):
    """Boundaries of the unit that lie between the dates."""
    parts = _fields("$dateDiff", operand, ("startDate", "endDate", "unit"), ("timezone", "startOfWeek"))
    unit = _unit(parts["unit"])
    a, b = (F.date_trunc(unit, compile_expression(parts[k], scope).cast("timestamp")) for k in ("startDate", "endDate"))
    return F.timestamp_diff(unit.upper(), a, b)


@with_document("$dateTrunc")
def _date_trunc(scope, operand):
    parts = _fields("$dateTrunc", operand, ("date", "unit"), ("binSize", "timezone", "startOfWeek"))
    unit, size = _unit(parts["unit"]), parts.get("binSize", 1)
    date = compile_expression(parts["date"], scope).cast("timestamp")
    if size == 1:
        return F.date_trunc(unit, date)
    # Bins are counted from the start of 2000.
    origin = F.lit(dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc))
    n = F.floor(F.timestamp_diff(unit.upper(), origin, F.date_trunc(unit, date)) / size) * size
    return F.timestamp_add(unit.upper(), n.cast("int"), origin)


@with_document("$dateFromParts")
def _date_from_parts(scope, operand):
    names = ("year", "month", "day", "hour", "minute", "second", "millisecond")
    parts = _fields("$dateFromParts", operand, ("year",), (*names[1:], "timezone"))
    get = lambda k, d: compile_expression(parts[k], scope) if k in parts else F.lit(d)
    whole = F.make_timestamp(get("year", 1), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    for name, unit, first in (("month", "MONTH", 1), ("day", "DAY", 1), ("hour", "HOUR", 0), ("minute", "MINUTE", 0), ("second", "SECOND", 0), ("millisecond", "MILLISECOND", 0)):
        if name in parts:  # parts out of range carry over
            whole = F.timestamp_add(unit, (get(name, first) - first).cast("int"), whole)
    return whole


@with_document("$dateToParts")
def _date_to_parts(scope, operand):
    d = _date(operand, scope)
    parts = {"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "hour": F.hour(d), "minute": F.minute(d), "second": F.second(d), "millisecond": F.pmod(F.unix_millis(d), F.lit(1000)).cast("int")}
    return F.when(d.isNotNull(), F.struct(*[c.alias(k) for k, c in parts.items()]))


#: Date format specifiers and the pattern letters for them.
FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%z": "xx", "%%": "'%'"}


def date_pattern(form: str) -> str:
    out = []
    for token in re.findall(r"%.|[^%]+", form):
        if token.startswith("%"):
            if token not in FORMATS:
                raise DocumentError(18536, f"Invalid format character '{token}' in format string")
            out.append(FORMATS[token])
        else:
            out.append("'" + token.replace("'", "''") + "'" if re.search("[A-Za-z']", token) else token)
    return "".join(out)


@with_document("$dateToString")
def _date_to_string(scope, operand):
    parts = _fields("$dateToString", operand, ("date",), ("format", "timezone", "onNull"))
    text = F.date_format(_date(parts, scope), date_pattern(parts.get("format", "%Y-%m-%dT%H:%M:%S.%LZ")))
    return F.coalesce(text, compile_expression(parts["onNull"], scope)) if "onNull" in parts else text


@with_document("$dateFromString")
def _date_from_string(scope, operand):
    parts = _fields("$dateFromString", operand, ("dateString",), ("format", "timezone", "onError", "onNull"))
    text = compile_expression(parts["dateString"], scope)
    date = F.try_to_timestamp(text, F.lit(date_pattern(parts["format"]))) if "format" in parts else F.try_to_timestamp(text)
    if "onError" in parts:
        date = F.when(text.isNotNull() & date.isNull(), compile_expression(parts["onError"], scope)).otherwise(date)
    else:
        date = F.when(text.isNotNull() & date.isNull(), F.raise_error(F.lit("Error parsing date string")).cast("timestamp")).otherwise(date)
    return F.coalesce(date, compile_expression(parts["onNull"], scope)) if "onNull" in parts else date


@operator("$tsSecond")
def _ts_second(scope, operands):
    return compile_expression(operands[0], scope)["t"]


@operator("$tsIncrement")
def _ts_increment(scope, operands):
    return compile_expression(operands[0], scope)["i"]


# --- conversion and types ---


def converted(column: Column, kind: T.DataType, to: str, strict: bool) -> Column:
    """A value as another type; what can't be converted is null, or an error if strict."""
    cls = V.value_class(kind)
    number = cls == "number"
    if to == "bool":
        out = V.truthy(column, kind) if number or cls == "bool" else F.lit(True)
    elif to == "string":
        out = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if cls == "date" else F.lower(column.cast("string")) if cls == "bool" else column.try_cast("string")
    elif to == "date":
        out = F.timestamp_millis(column.cast("long")) if number else F.try_to_timestamp(column) if cls == "string" else column.cast("timestamp")
    elif to in ("int", "long"):
        base = F.unix_millis(column.cast("timestamp")) if cls == "date" else column
        base = _toward_zero(base) if number and not isinstance(kind, V.WHOLE) else base
        out = base.try_cast("int" if to == "int" else "bigint")
    elif to == "double":
        out = F.unix_millis(column.cast("timestamp")).cast("double") if cls == "date" else column.try_cast("double")
    elif to == "decimal":
        out = column.try_cast("decimal(38,18)")
    elif to == "objectId":
        out = F.when(F.length(column) == 24, F.try_to_binary(column, F.lit("hex")))
    else:
        raise bad_value(f"unknown type name: {to}")
    if strict and to not in ("bool",):
        out = F.when(column.isNotNull() & out.isNull(), F.raise_error(F.lit(f"Failed to convert to {to}")).cast(kind if to == "any" else {"int": "int", "long": "bigint", "double": "double", "decimal": "decimal(38,18)", "date": "timestamp", "string": "string", "objectId": "binary"}[to])).otherwise(out)
    return F.when(column.isNotNull(), out)


for _name, _to in {"$toBool": "bool", "$toString": "string", "$toDate": "date", "$toInt": "int", "$toLong": "long", "$toDouble": "double", "$toDecimal": "decimal", "$toObjectId": "objectId"}.items():
    _OPERATORS[_name] = (lambda s, a, to=_to: converted(*typed(a[0], s), to, True), 1, 1)


@with_document("$convert")
def _convert(scope, operand):
    parts = _fields("$convert", operand, ("input", "to"), ("onError", "onNull"))
    column, kind = typed(parts["input"], scope)
    to = {v: k for k, v in V.TYPE_CODES.items()}.get(parts["to"], parts["to"])
    out = converted(column, kind, to, "onError" not in parts)
    if "onError" in parts:
        out = F.when(column.isNotNull() & out.isNull(), compile_expression(parts["onError"], scope)).otherwise(out)
    return F.when(column.isNull(), compile_expression(parts["onNull"], scope)).otherwise(out) if "onNull" in parts else out


@operator("$type")
def _type(scope, operands):
    """The type's alias; null values say null, fields no document has say missing."""
    column, kind = typed(operands[0], scope)
    if isinstance(kind, T.NullType):
        return F.lit("missing" if isinstance(operands[0], str) else "null")
    if isinstance(kind, T.VariantType):
        return variant_alias(column)
    return F.when(column.isNull(), F.lit("null")).otherwise(F.lit(V.alias_of(kind)))


def variant_alias(column: Column) -> Column:
    """The alias of a dynamic value's own type."""
    s = F.schema_of_variant(column)
    out = F.when(column.isNull(), "missing").when(s == "VOID", "null").when(s == "BOOLEAN", "bool").when(s == "STRING", "string")
    out = out.when(s.rlike("^(DOUBLE|FLOAT)$"), "double").when(s.rlike("^DECIMAL"), "decimal").when(s.rlike("^(BIGINT|INT|SMALLINT|TINYINT)$"), "long")
    return out.when(s.rlike("^OBJECT"), "object").when(s.rlike("^ARRAY"), "array").when(s.rlike("^(DATE|TIMESTAMP)"), "date").otherwise("binData")


@operator("$isNumber")
def _is_number(scope, operands):
    column, kind = typed(operands[0], scope)
    if isinstance(kind, T.VariantType):
        return variant_alias(column).isin("double", "decimal", "long", "int")
    return F.lit(V.is_number(kind)) & column.isNotNull()


@operator("$bsonSize")
def _bson_size(scope, operands):
    """Bytes of the document's encoding: sizes of names and values by type."""
    return document_size(*typed(operands[0], scope))


def document_size(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        total = F.lit(5)
        for f in kind.fields:
            inner = column.getField(f.name)
            total = total + len(f.name.encode()) + 2 + F.when(inner.isNull(), 0).otherwise(document_size(inner, f.dataType))
        return F.when(column.isNotNull(), total)
    if isinstance(kind, T.ArrayType):
        entries = F.transform(column, lambda e, i: F.length(i.cast("string")) + 2 + F.coalesce(document_size(e, kind.elementType), F.lit(0)))
        return F.aggregate(entries, F.lit(5), lambda a, e: a + e)
    cls = V.value_class(kind)
    if cls == "string":
        return F.octet_length(column) + 5
    if cls == "binary":
        return F.octet_length(column) + 5
    if isinstance(kind, T.DecimalType):
        return F.lit(16)
    return F.lit({"bool": 1, "date": 8}.get(cls, 4 if V.alias_of(kind) == "int" else 8))


def needs_whole(value: object, name: str, least: int) -> int:
    """A whole number of at least `least`; 5.0 counts as 5."""
    if isinstance(value, bool) or not isinstance(value, (int, float, decimal.Decimal)) or value != int(value):
        raise DocumentError(5107201, f"invalid argument to {name}: expected an integer, got {value!r}")
    if value < least or value >= 2**63:
        raise DocumentError(15958 if name == "$limit" else 5107200, f"invalid argument to {name}: {value!r} is out of range")
    return int(value)
