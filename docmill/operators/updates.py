"""Update documents as rewrites of a table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmill.errors import DocumentError, bad_value
from docmill.functions import values as V
from docmill.functions.accumulators import sort_order
from docmill.functions.expressions import sorted_array
from docmill.functions.paths import Scope, assigned, follow, quoted, resolve, split_path, step, top_level
from docmill.operators import shaping
from docmill.operators.filters import compile_filter, definite, element_match

NAMES = ("$set", "$unset", "$inc", "$mul", "$min", "$max", "$rename", "$currentDate", "$setOnInsert", "$bit", "$push", "$addToSet", "$pop", "$pull", "$pullAll")


def marked_one(df: DataFrame, hit: Column, sort: dict | None) -> DataFrame:
    """df with _one on a single matching row: the first by sort, else by its values.

    The row is found by a top-1 over the matches, not by ordering the table.
    Of rows equal in every column one is marked: they are counted, and come
    back as one with the mark and the rest without.
    """
    keys = sort_order(sort, Scope(df)) if sort else []
    order = [V.descending_last(c, d) for c, d in keys] + [quoted(f.name).asc_nulls_first() for f in df.schema.fields if V.value_class(f.dataType) not in ("any",) and not isinstance(f.dataType, T.MapType)]
    plain = [quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]
    mark = F.xxhash64(*plain)
    one = df.filter(hit).orderBy(*order).limit(1).select(mark.alias("_mark"), F.struct(*plain).alias("_top"))
    joined = df.withColumn("_mark", mark).join(F.broadcast(one.withColumnRenamed("_mark", "_hash")), F.col("_mark") == F.col("_hash"), "left")  # one row
    same = F.coalesce(F.struct(*plain).eqNullSafe(F.col("_top")) & F.col("_hash").isNotNull(), F.lit(False)) & definite(hit)
    columns = [quoted(c) for c in df.columns]
    equal = joined.filter(same).agg(F.first(F.struct(*columns)).alias("_row"), F.count("*").alias("_n")).filter("_n > 0")
    equal = equal.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).select(*columns, (F.col("_i") == 1).alias("_one"))
    return joined.filter(~same).select(*columns, F.lit(False).alias("_one")).unionByName(equal)


def update(df: DataFrame, query: dict, change: dict | list, context, *, multi: bool, upsert: bool, sort: dict | None, array_filters: list[dict]) -> DataFrame:
    hit = definite(compile_filter(query, Scope(df)))
    replacement = isinstance(change, dict) and not any(k.startswith("$") for k in change)
    if replacement and multi:
        raise DocumentError(9, "multi update is not supported for replacement-style update")
    marked = df.withColumn("_one", hit) if multi else marked_one(df, hit, sort)
    out = changed(marked, F.col("_one"), change, context, array_filters, query)
    if upsert:
        out = with_upsert(out, df.filter(hit), query, change, context)
    return out.drop("_one")


def changed(marked: DataFrame, hit: Column, change: dict | list, context, array_filters: list[dict], query: dict | None = None) -> DataFrame:
    """The rows, those that are hit changed. Columns that the change makes are null elsewhere."""
    base = marked.drop("_one")
    if isinstance(change, (list, tuple)):
        from docmill.operators.stages import run_pipeline

        if any(next(iter(s)) not in ("$set", "$addFields", "$unset", "$project", "$replaceRoot", "$replaceWith") for s in change):
            raise DocumentError(72, "stage not allowed in an update pipeline")
        done = run_pipeline(marked.filter(hit), [*change, {"$set": {"_one": True}}], context)
        return marked.filter(~hit).unionByName(done, allowMissingColumns=True)
    if not any(k.startswith("$") for k in change):
        new = {k: V.literal(v) for k, v in change.items()}
        kinds = {f.name: f.dataType for f in base.schema.fields}
        columns = []
        for name, kind in kinds.items():
            if name == "_id" and "_id" not in new:
                columns.append(quoted(name))
            else:
                columns.append(F.when(hit, new[name].cast(kind) if name in new else F.lit(None).cast(kind)).otherwise(quoted(name)).alias(name))
        extra = [F.when(hit, c).alias(k) for k, c in new.items() if k not in kinds]
        return marked.select(*columns, *extra, "_one")
    _validate(change)
    out = marked
    for op, fields in change.items():
        if op == "$setOnInsert":
            continue
        for path, operand in fields.items():
            out = _apply(out, F.col("_one"), op, path, operand, array_filters, query or {})
    return out


def _validate(change: dict) -> None:
    seen: list[str] = []
    for op, fields in change.items():
        if op not in NAMES:
            raise DocumentError(9, f"Unknown modifier: {op}")
        if not isinstance(fields, dict):
            raise DocumentError(9, f"Modifiers operate on fields but we found type {V.literal_class(fields)} instead for {op}")
        for path in fields:
            split_path(path)
            for other in seen:
                if path == other or path.startswith(other + ".") or other.startswith(path + "."):
                    raise DocumentError(40, f"Updating the path '{path}' would create a conflict at '{other}'")
            seen.append(path)


def _apply(df: DataFrame, hit: Column, op: str, path: str, operand: object, array_filters: list[dict], query: dict) -> DataFrame:
    scope = Scope(df)
    if op == "$unset":
        return _set(df, hit, path, None, remove=True)
    if op == "$rename":
        if not isinstance(operand, str) or operand == path:
            raise bad_value("The 'to' field for $rename must be another field's name")
        value, _ = resolve(scope, path)
        moved = _set(df, hit & value.isNotNull(), operand, value)
        return _set(moved, hit, path, None, remove=True)
    if re.search(r"\.\$(\[\w*\])?(\.|$)", path):
        return _positional(df, hit, op, path, operand, array_filters, query)
    value, kind = resolve(scope, path)
    return _set(df, hit, path, new_value(op, value, kind, operand))


def _set(df: DataFrame, hit: Column, path: str, value: Column | None, *, remove: bool = False) -> DataFrame:
    """Put a value at a path of the rows that are hit; a removed field is null in them."""
    names = split_path(path)
    found = top_level(Scope(df), names[0])
    if remove:
        if not found:
            return df
        new = F.lit(None).cast(found[1]) if len(names) == 1 else _nulled(*found, names[1:])
    else:
        new = assigned(found[0] if found else None, found[1] if found else None, names[1:], value)
    if not found:
        return df.withColumn(names[0], F.when(hit, new))
    if len(names) > 1 and not remove:
        kind = df.select(new.alias("x")).schema[0].dataType
        if kind.simpleString() != found[1].simpleString():  # the document gets a new field, or another type for one
            before, _ = follow(*found, names[1:])
            old = assigned(*found, names[1:], before.cast(_at(kind, names[1:])))
            return df.withColumn(names[0], F.when(hit, new).otherwise(F.when(found[0].isNotNull(), old)))
    return df.withColumn(names[0], F.when(hit, new).otherwise(found[0]))


def _at(kind: T.DataType, names: list[str]) -> T.DataType:
    for n in names:
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        kind = kind[n].dataType
    return kind


def _nulled(value: Column, kind: T.DataType, names: list[str]) -> Column:
    inner = step(value, kind, names[0])
    if inner is None:
        return value
    return value.withField("`" + names[0] + "`", F.lit(None).cast(inner[1]) if len(names) == 1 else _nulled(*inner, names[1:]))


def _number_operand(op: str, operand: object) -> Column:
    if isinstance(operand, bool) or not isinstance(operand, (int, float)):
        raise DocumentError(14, f"Cannot {op[1:]} with non-numeric argument: {operand!r}")
    return V.literal(operand)


def new_value(op: str, value: Column, kind: T.DataType, operand: object) -> Column:
    """What an operator makes of a field's value."""
    none = isinstance(kind, T.NullType)
    if op == "$set":
        new = V.literal(operand)
        return new if none or V.value_class(kind) in ("object", "array") or V.literal_class(operand) != V.value_class(kind) else new.cast(kind) if not (isinstance(kind, V.WHOLE) and isinstance(operand, float)) else new
    if op in ("$inc", "$mul"):
        if not none and not V.is_number(kind):
            raise DocumentError(14, f"Cannot apply {op} to a value of non-numeric type")
        n = _number_operand(op, operand)
        old = F.coalesce(value, F.lit(0)) if not none else F.lit(0)
        wide = old.cast("long") if isinstance(kind, V.WHOLE) and isinstance(operand, int) else old
        return wide + n if op == "$inc" else wide * n
    if op in ("$min", "$max"):
        new = V.literal(operand)
        return new if none else (F.least if op == "$min" else F.greatest)(value, new)
    if op == "$currentDate":
        if operand is not True and operand not in ({"$type": "date"}, {"$type": "timestamp"}):
            raise bad_value("$currentDate needs true or a $type of date or timestamp")
        return F.current_timestamp()
    if op == "$bit":
        out = F.coalesce(value, F.lit(0)) if not none else F.lit(0)
        for name, n in operand.items():
            if name not in ("and", "or", "xor") or isinstance(n, bool) or not isinstance(n, int):
                raise bad_value("$bit needs and, or or xor of a whole number")
            out = {"and": out.bitwiseAND, "or": out.bitwiseOR, "xor": out.bitwiseXOR}[name](F.lit(n))
        return out
    return _array_value(op, value, kind, operand)


def _array_value(op: str, value: Column, kind: T.DataType, operand: object) -> Column:
    if not isinstance(kind, (T.ArrayType, T.NullType)):
        raise bad_value(f"The field must be an array for {op}")
    element = kind.elementType if isinstance(kind, T.ArrayType) else None
    many = isinstance(operand, dict) and "$each" in operand
    items = operand["$each"] if many else [operand]
    given = F.array(*[V.literal(x).cast(element) if element is not None else V.literal(x) for x in items]) if op in ("$push", "$addToSet") and items else None
    old = F.coalesce(value, F.array().cast(kind)) if element is not None else (F.array() if given is None else F.slice(given, 1, 0))
    if op == "$push":
        at = operand.get("$position") if many else None
        new = given if given is not None else F.slice(old, 1, 0)
        if at is None:
            out = F.concat(old, new)
        else:
            start = F.least(F.lit(at), F.size(old)) if at >= 0 else F.greatest(F.size(old) + at, F.lit(0))
            out = F.concat(F.slice(old, F.lit(1), start), new, F.slice(old, start + 1, F.size(old)))
        if many and "$sort" in operand:
            out = sorted_array(out, kind, operand["$sort"])
        if many and "$slice" in operand:
            n = operand["$slice"]
            out = F.slice(out, 1, n) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n, F.lit(0)) + 1, F.lit(-n))
        return out
    if op == "$addToSet":
        fresh = F.filter(F.array_distinct(given), lambda e: ~F.coalesce(F.exists(old, lambda o: o.eqNullSafe(e)), F.lit(False)))
        return F.concat(old, fresh)
    if element is None:
        return F.lit(None)
    if op == "$pop":
        if operand not in (1, -1) or isinstance(operand, bool):
            raise DocumentError(9, f"$pop expects 1 or -1, found: {operand!r}")
        return F.slice(value, F.lit(1 if operand == 1 else 2), F.greatest(F.size(value) - 1, F.lit(0)))
    if op == "$pull":
        query = operand if isinstance(operand, dict) else {"$eq": operand}
        return F.filter(value, lambda e: ~definite(element_match(e, element, query)))
    if op == "$pullAll":
        if not isinstance(operand, (list, tuple)):
            raise bad_value("$pullAll requires an array argument")
        return F.filter(value, lambda e: ~F.coalesce(V.any_of(e.eqNullSafe(V.literal(x)) for x in operand), F.lit(False)))
    raise DocumentError(9, f"Unknown modifier: {op}")


def _positional(df: DataFrame, hit: Column, op: str, path: str, operand: object, array_filters: list[dict], query: dict) -> DataFrame:
    """$ (first element the query matched), $[] (all) and $[name] (those of its array filter)."""
    names = path.split(".")
    at = next(i for i, n in enumerate(names) if n.startswith("$"))
    array_path, mark, rest = ".".join(names[:at]), names[at], names[at + 1 :]
    value, kind = resolve(Scope(df), array_path)
    if not isinstance(kind, T.ArrayType):
        raise bad_value(f"The path '{array_path}' must be an array")
    element = kind.elementType

    def changed_element(e: Column) -> Column:
        inner, inner_kind = (e, element)
        for n in rest:
            inner, inner_kind = step(inner, inner_kind, n) or (F.lit(None), T.NullType())
        new = new_value(op, inner, inner_kind, operand) if op != "$unset" else F.lit(None)
        return assigned(e, element, rest, new).cast(element)

    if mark == "$[]":
        new = F.transform(value, changed_element)
    elif mark == "$":
        condition = query.get(array_path) or next((v for k, v in query.items() if k.startswith(array_path + ".")), None)
        if condition is None:
            raise bad_value("The positional operator did not find the match needed from the query.")
        inner_path = next((k[len(array_path) + 1 :] for k in query if k.startswith(array_path + ".")), None)
        test = {inner_path: condition} if inner_path else condition["$elemMatch"] if isinstance(condition, dict) and "$elemMatch" in condition else condition if isinstance(condition, dict) else {"$eq": condition}
        hits = F.transform(value, lambda e: element_match(e, element, test))
        first = F.array_position(hits, F.lit(True))
        new = F.transform(value, lambda e, i: F.when(i + 1 == first, changed_element(e)).otherwise(e))
    else:
        name = mark[2:-1]
        test = next((f for f in array_filters if all(k.split(".")[0] == name for k in f)), None)
        if test is None:
            raise bad_value(f"No array filter found for identifier '{name}' in path '{path}'")

        def meets(e: Column) -> Column:
            return V.all_of(element_match(e, element, v if isinstance(v, dict) and any(x.startswith("$") for x in v) else {"$eq": v}) if k == name else element_match(e, element, {k[len(name) + 1 :]: v}) for k, v in test.items())

        new = F.transform(value, lambda e: F.when(meets(e), changed_element(e)).otherwise(e))
    return _set(df, hit, array_path, new)


def with_upsert(done: DataFrame, matches: DataFrame, query: dict, change: dict | list, context) -> DataFrame:
    """One more row if nothing matched: equality conditions of the query, then the change."""
    seed = {k: v["$eq"] if isinstance(v, dict) and "$eq" in v else v for k, v in query.items() if not k.startswith("$") and (not isinstance(v, dict) or "$eq" in v)}
    none = matches.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
    kinds = {f.name: f.dataType for f in done.schema.fields}
    row = none.select(*[F.lit(None).cast(k).alias(n) for n, k in kinds.items() if n != "_one"])
    for k, v in seed.items():
        row = shaping.put(row, {k: V.literal(v).cast(kinds[k]) if k in kinds else V.literal(v)})
    row = row.withColumn("_one", F.lit(True))
    row = changed(row, F.col("_one"), change, context, [])
    if isinstance(change, dict):
        for path, v in change.get("$setOnInsert", {}).items():
            row = _set(row, F.lit(True), path, V.literal(v).cast(kinds[path]) if path in kinds else V.literal(v))
    return done.unionByName(row, allowMissingColumns=True)
