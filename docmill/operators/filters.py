"""Filter documents compiled to boolean Columns.

A predicate may be null where it is not true, which a filter treats alike and
which leaves comparisons bare, so that they reach the scan. Under a negation
it is made definite first: `$ne` and its like keep rows without the field.
"""

from __future__ import annotations

import decimal
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

from docmill.errors import DocumentError, bad_value
from docmill.functions import values as V
from docmill.functions.expressions import regex_text, truth, variant_alias
from docmill.functions.paths import Scope, split_path, step, top_level

Test = Callable[[Column, T.DataType], Column | None]


def definite(predicate: Column) -> Column:
    """The predicate with null as false."""
    return F.coalesce(predicate, F.lit(False))


def compile_filter(query: object, scope: Scope) -> Column:
    """A filter document as a predicate; null and missing are the same for it."""
    if not isinstance(query, dict):
        raise bad_value("the filter has to be a document")
    parts = []
    for key, operand in query.items():
        if key in _LOGIC:
            parts.append(_LOGIC[key](operand, scope))
        elif key == "$expr":
            parts.append(truth(operand, scope))
        elif key == "$comment":
            continue
        elif key == "$jsonSchema":
            parts.append(json_schema(operand, scope))
        elif key == "$text":
            from docmill.operators.search import text_match

            parts.append(text_match(operand, scope))
        elif key == "$sampleRate":
            if isinstance(operand, bool) or not isinstance(operand, (int, float)) or not 0 <= operand <= 1:
                raise bad_value(f"$sampleRate needs a number between 0 and 1, got {operand!r}")
            parts.append(F.rand() < F.lit(float(operand)))
        elif key == "$where":
            raise bad_value("$where is not supported")
        elif key.startswith("$"):
            raise bad_value(f"unknown top level operator: {key}")
        else:
            parts.append(_field(key, operand, scope))
    return V.all_of(parts)


def _list(name: str, operand: object, scope: Scope) -> list[Column]:
    if not isinstance(operand, (list, tuple)):
        raise bad_value(f"{name} must be an array")
    if not operand:
        raise bad_value(f"{name} must be a nonempty array")
    return [compile_filter(q, scope) for q in operand]


_LOGIC: dict[str, Callable[[object, Scope], Column]] = {
    "$and": lambda o, s: V.all_of(_list("$and", o, s)),
    "$or": lambda o, s: V.any_of(_list("$or", o, s)),
    "$nor": lambda o, s: ~definite(V.any_of(_list("$nor", o, s))),
}


def _field(path: str, operand: object, scope: Scope) -> Column:
    names = split_path(path)
    if any(n.startswith("$") for n in names):
        raise bad_value(f"field names may not start with $: {path}")
    found = top_level(scope, path) or top_level(scope, names[0])
    rest = [] if top_level(scope, path) else names[1:]
    value, kind = found or (F.lit(None), T.NullType())
    return conditions(value, kind, rest, operand)


def conditions(value: Column, kind: T.DataType, names: list[str], operand: object) -> Column:
    """All that an operand asks of the path below a value."""
    if isinstance(operand, dict) and any(k.startswith("$") for k in operand):
        parts = []
        for op, arg in operand.items():
            if op == "$options":
                if "$regex" not in operand:
                    raise bad_value("$options needs a $regex")
                continue
            if op == "$comment":
                continue
            parts.append(_condition(value, kind, names, op, arg, operand))
        return V.all_of(parts)
    if isinstance(operand, re.Pattern):
        return reach(value, kind, names, _regex_test(operand, ""))
    return reach(value, kind, names, _equal_test(operand), whole=True, null=operand is None)


def reach(value: Column, kind: T.DataType, names: list[str], test: Test, *, whole: bool = False, null: bool = False) -> Column:
    """Whether the test holds for any value that the path reaches.

    Arrays are entered, on the way and at the end; `whole` tries an array at
    the end itself too; `null` also accepts paths that reach nothing.
    """
    if names:
        if isinstance(kind, T.ArrayType):
            element = kind.elementType
            inner = F.exists(value, lambda e: reach(e, element, names, test, whole=whole, null=null))
            if names[0].isdigit():
                at = F.get(value, F.lit(int(names[0])))
                return inner | reach(at, element, names[1:], test, whole=whole, null=null)
            return inner | value.isNull() if null else inner
        found = step(value, kind, names[0])
        return reach(*found, names[1:], test, whole=whole, null=null) if found else F.lit(null)
    parts = []
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        parts.append(F.exists(value, lambda e: reach(e, element, [], test, null=null)))
        if whole:
            parts.append(test(value, kind))
    else:
        parts.append(test(value, kind))
    if null:
        parts.append(value.isNull())
    return V.any_of(p for p in parts if p is not None)


def _equal_test(operand: object) -> Test:
    return lambda value, kind: None if operand is None else V.equal(value, kind, operand)


def _order_test(op: str, operand: object) -> Test:
    """Only values of the operand's class compare; null is only as great as null."""
    cls = V.literal_class(operand)

    def test(value: Column, kind: T.DataType) -> Column | None:
        if V.value_class(kind) == "any":
            return V.variant_compare(value, op, operand)
        return V.compare(value, op, V.literal(operand)) if V.value_class(kind) == cls else None

    return test


def _regex_test(pattern: object, options: str) -> Test:
    text = regex_text(pattern, options)
    return lambda value, kind: F.rlike(value if isinstance(kind, T.StringType) else F.try_variant_get(value, "$", "string"), F.lit(text)) if V.value_class(kind) in ("string", "any") else None


def _condition(value: Column, kind: T.DataType, names: list[str], op: str, arg: object, siblings: dict) -> Column:
    if op == "$eq":
        return reach(value, kind, names, _equal_test(arg), whole=True, null=arg is None)
    if op == "$ne":
        if isinstance(arg, re.Pattern):
            raise bad_value("Can't have regex as arg to $ne.")
        return ~definite(_condition(value, kind, names, "$eq", arg, siblings))
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if arg is None:
            return _condition(value, kind, names, "$eq", None, siblings) if op in ("$gte", "$lte") else F.lit(False)
        return reach(value, kind, names, _order_test(op[1:], arg), whole=isinstance(arg, (list, tuple)))
    if op == "$in":
        return _in(value, kind, names, arg)
    if op == "$nin":
        return ~definite(_in(value, kind, names, arg))
    if op == "$not":
        if not isinstance(arg, (dict, re.Pattern)) or arg == {}:
            raise bad_value("$not needs a regex or a document")
        return ~definite(conditions(value, kind, names, arg))
    if op == "$exists":
        there = reach(value, kind, names, lambda v, _: v.isNotNull(), whole=True)
        return there if arg is not False and arg != 0 and arg is not None else ~definite(there)
    if op == "$type":
        return reach(value, kind, names, _type_test(arg), whole=True, null=_names_null(arg))
    if op == "$mod":
        return reach(value, kind, names, _mod_test(arg))
    if op == "$regex":
        return reach(value, kind, names, _regex_test(arg, siblings.get("$options", "")))
    if op == "$all":
        if not isinstance(arg, (list, tuple)):
            raise bad_value("$all needs an array")
        if not arg:
            return F.lit(False)
        return V.all_of(conditions(value, kind, names, x if isinstance(x, dict) and "$elemMatch" in x else x) for x in arg)
    if op == "$elemMatch":
        return reach_arrays(value, kind, names, lambda v, k: F.exists(v, lambda e: element_match(e, k.elementType, arg)))
    if op == "$size":
        n = _size_argument(arg)
        return reach_arrays(value, kind, names, lambda v, k: F.size(v) == n)
    if op in _BITS:
        return reach(value, kind, names, _bit_test(op, arg))
    if op in ("$geoWithin", "$geoIntersects", "$near", "$nearSphere"):
        from docmill.operators.search import geo_condition

        return geo_condition(value, kind, names, op, arg)
    raise bad_value(f"unknown operator: {op}")


def _in(value: Column, kind: T.DataType, names: list[str], arg: object) -> Column:
    if not isinstance(arg, (list, tuple)):
        raise bad_value("$in needs an array")
    plain = [x for x in arg if not isinstance(x, (re.Pattern, dict, list, tuple)) and x is not None]
    cls = V.value_class(kind)
    if not names and plain and cls in ("number", "string", "bool", "date"):
        # One isin on the bare column reaches the scan.
        own = [int(x) if isinstance(kind, V.WHOLE) and isinstance(x, float) and x.is_integer() else x for x in plain if V.literal_class(x) == cls and not (isinstance(kind, V.WHOLE) and isinstance(x, float) and not x.is_integer())]
        parts = [value.isin(own)] if own else []
        rest = [x for x in arg if x is None or isinstance(x, (re.Pattern, dict, list, tuple))]
    else:
        parts, rest = [], list(arg)
    for x in rest:
        parts.append(reach(value, kind, names, _regex_test(x, "")) if isinstance(x, re.Pattern) else reach(value, kind, names, _equal_test(x), whole=True, null=x is None))
    return V.any_of(parts)


def reach_arrays(value: Column, kind: T.DataType, names: list[str], test: Test) -> Column:
    """Whether the path reaches an array for which the test holds; arrays at the end aren't entered."""
    if names:
        if isinstance(kind, T.ArrayType):
            element = kind.elementType
            out = F.coalesce(F.exists(value, lambda e: reach_arrays(e, element, names, test)), F.lit(False))
            return out | reach_arrays(F.get(value, F.lit(int(names[0]))), element, names[1:], test) if names[0].isdigit() else out
        found = step(value, kind, names[0])
        return reach_arrays(*found, names[1:], test) if found else F.lit(False)
    return F.coalesce(test(value, kind), F.lit(False)) if isinstance(kind, T.ArrayType) else F.lit(False)


def element_match(element: Column, kind: T.DataType, query: object) -> Column:
    """One element against $elemMatch: operators on the element itself, or a filter on its fields."""
    if not isinstance(query, dict):
        raise bad_value("$elemMatch needs an Object")
    if "$where" in query:
        raise bad_value("$elemMatch cannot contain $where expression")
    if query and all(k.startswith("$") for k in query) and not set(query) & set(_LOGIC):
        return conditions(element, kind, [], query)
    parts = []
    for key, operand in query.items():
        if key in _LOGIC:
            inner = [element_match(element, kind, q) for q in operand]
            parts.append(V.all_of(inner) if key == "$and" else V.any_of(inner) if key == "$or" else ~definite(V.any_of(inner)))
        else:
            parts.append(conditions(element, kind, split_path(key), operand))
    return V.all_of(parts)


def _type_list(arg: object) -> list[str]:
    codes = {v: k for k, v in V.TYPE_CODES.items()}
    out = []
    for x in arg if isinstance(arg, (list, tuple)) else [arg]:
        if isinstance(x, bool) or not isinstance(x, (str, int, float)):
            raise DocumentError(14, "type must be represented as a number or a string")
        if isinstance(x, (int, float)):
            if x not in codes:
                raise bad_value(f"Invalid numerical type code: {x}")
            x = codes[x]
        if x != "number" and x not in V.TYPE_CODES:
            raise bad_value(f"Unknown type name alias: {x}")
        out += ["int", "long", "double", "decimal"] if x == "number" else [x]
    return out


def _names_null(arg: object) -> bool:
    return "null" in _type_list(arg)


def _type_test(arg: object) -> Test:
    wanted = _type_list(arg)

    def test(value: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, T.VariantType):
            return variant_alias(value).isin(wanted)
        return value.isNotNull() if V.alias_of(kind) in wanted else None

    return test


def _mod_test(arg: object) -> Test:
    if not isinstance(arg, (list, tuple)) or len(arg) != 2 or any(isinstance(x, bool) or not isinstance(x, (int, float, decimal.Decimal)) for x in arg):
        raise bad_value("malformed mod, needs to be an array of two numbers")
    divisor, remainder = (int(x) for x in arg)
    if divisor == 0:
        raise bad_value("divisor cannot be 0")
    return lambda value, kind: (F.when(value.isNotNull(), value.cast("long")) % divisor == remainder) if V.is_number(kind) else None


def _size_argument(arg: object) -> int:
    if isinstance(arg, bool) or not isinstance(arg, (int, float)):
        raise bad_value("Failed to parse $size. Expected a number")
    if arg != int(arg):
        raise bad_value(f"Failed to parse $size. Expected an integer: {arg}")
    if arg < 0:
        raise bad_value(f"Failed to parse $size. Expected a non-negative number: {arg}")
    return int(arg)


_BITS: dict[str, Callable[[Column, int], Column]] = {
    "$bitsAllClear": lambda x, m: x.bitwiseAND(F.lit(m)) == 0,
    "$bitsAllSet": lambda x, m: x.bitwiseAND(F.lit(m)) == m,
    "$bitsAnyClear": lambda x, m: x.bitwiseAND(F.lit(m)) != m,
    "$bitsAnySet": lambda x, m: x.bitwiseAND(F.lit(m)) != 0,
}


def bit_mask(arg: object) -> int:
    if isinstance(arg, (bytes, bytearray)):
        mask = int.from_bytes(arg, "little")
    elif isinstance(arg, (list, tuple)):
        if any(isinstance(p, bool) or not isinstance(p, int) or p < 0 for p in arg):
            raise bad_value("bit positions must be whole numbers of 0 or more")
        mask = sum(1 << min(p, 63) for p in set(arg))
    elif isinstance(arg, (int, float)) and not isinstance(arg, bool) and arg == int(arg) and arg >= 0:
        mask = int(arg)
    else:
        raise bad_value(f"cannot use {arg!r} as a bit mask")
    return mask - (1 << 64) if mask >> 63 else mask


def _bit_test(op: str, arg: object) -> Test:
    mask = bit_mask(arg)

    def test(value: Column, kind: T.DataType) -> Column | None:
        if not V.is_number(kind):
            return None
        whole = value if isinstance(kind, V.WHOLE) else F.when(value == F.floor(value), value)
        return _BITS[op](whole.try_cast("bigint"), mask)

    return test


def json_schema(schema: object, scope: Scope) -> Column:
    """The checks of a JSON schema for documents; types are told by the columns."""
    value, kind = scope.root()
    return _schema(schema, value, kind, top=True)


def _schema(schema: object, value: Column, kind: T.DataType, top: bool = False) -> Column:
    if not isinstance(schema, dict):
        raise DocumentError(14, "$jsonSchema must be an object")
    parts = []
    for key, arg in schema.items():
        if key in ("bsonType", "type"):
            names = ["number" if x == "integer" else "bool" if x == "boolean" else x for x in ([arg] if isinstance(arg, str) else arg)]
            parts.append(F.lit(True) if top and "object" in names else F.coalesce(_type_test(names)(value, kind), F.lit(False)) if _type_test(names)(value, kind) is not None else value.isNull())
        elif key == "required":
            parts += [step(value, kind, n)[0].isNotNull() if step(value, kind, n) else F.lit(False) for n in arg]
        elif key == "properties":
            for n, inner in arg.items():
                found = step(value, kind, n)
                if found:
                    parts.append(found[0].isNull() | _schema(inner, *found))
        elif key in ("minimum", "maximum"):
            if V.is_number(kind):
                strict = schema.get("exclusive" + key.capitalize())
                parts.append(V.compare(value, ("gt" if strict else "gte") if key == "minimum" else ("lt" if strict else "lte"), V.literal(arg)))
        elif key in ("minLength", "maxLength"):
            if V.value_class(kind) == "string":
                parts.append(F.char_length(value) >= arg if key == "minLength" else F.char_length(value) <= arg)
        elif key in ("minItems", "maxItems"):
            if isinstance(kind, T.ArrayType):
                parts.append(F.size(value) >= arg if key == "minItems" else F.size(value) <= arg)
        elif key == "uniqueItems":
            if arg and isinstance(kind, T.ArrayType):
                parts.append(F.size(F.array_distinct(value)) == F.size(value))
        elif key == "items":
            if isinstance(kind, T.ArrayType):
                element = kind.elementType
                parts.append(F.forall(value, lambda e: _schema(arg, e, element)))
        elif key == "enum":
            parts.append(V.any_of(p for p in (V.equal(value, kind, x) for x in arg if x is not None) if p is not None))
        elif key == "pattern":
            if V.value_class(kind) == "string":
                parts.append(F.rlike(value, F.lit(regex_text(arg))))
        elif key in ("allOf", "anyOf"):
            inner = [_schema(s, value, kind, top) for s in arg]
            parts.append(V.all_of(inner) if key == "allOf" else V.any_of(inner))
        elif key == "oneOf":
            hits = [F.when(_schema(s, value, kind, top), 1).otherwise(0) for s in arg]
            parts.append(sum(hits[1:], hits[0]) == 1)
        elif key == "not":
            parts.append(~definite(_schema(arg, value, kind, top)))
        elif key not in ("title", "description", "exclusiveMinimum", "exclusiveMaximum", "additionalProperties"):
            raise DocumentError(9, f"Unknown $jsonSchema keyword: {key}")
    return F.coalesce(V.all_of(parts), F.lit(False))
