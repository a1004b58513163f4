"""Projection, added and removed fields, documents promoted to the top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmill.errors import DocumentError
from docmill.functions.expressions import compile_expression, typed
from docmill.functions.paths import Scope, assigned, dropped, quoted, split_path, top_level


def put(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with the paths set; several below one field are set in turn."""
    scope = Scope(df)
    whole: dict[str, Column] = {}
    for path, value in new.items():
        names = split_path(path)
        found = top_level(scope, names[0])
        if len(names) == 1:
            whole[names[0]] = value
            continue
        base, kind = (whole[names[0]], df.select(whole[names[0]].alias("x")).schema[0].dataType) if names[0] in whole else found or (None, None)
        whole[names[0]] = assigned(base, kind, names[1:], value)
    return df.withColumns(whole)


def add_fields(df: DataFrame, spec: dict, scope: Scope) -> DataFrame:
    if not isinstance(spec, dict) or not spec:
        raise DocumentError(40272, "$addFields specification stage must be an object")
    gone = [k for k, v in spec.items() if isinstance(v, str) and v == "$$REMOVE"]
    out = put(df, {k: value for path, x in spec.items() if path not in gone for k, value in flat_assignments(path, x, scope)})
    return unset(out, gone) if gone else out


def flat_assignments(path: str, value: object, scope: Scope) -> list[tuple[str, Column]]:
    """Nested documents without operators set their fields one by one, keeping what else the path holds."""
    if isinstance(value, dict) and value and not any(k.startswith("$") for k in value):
        return [x for k, v in value.items() for x in flat_assignments(f"{path}.{k}", v, scope)]
    return [(path, compile_expression(value, scope))]


def unset(df: DataFrame, paths: object) -> DataFrame:
    """df without the paths; a path inside another one is an error."""
    paths = [paths] if isinstance(paths, str) else paths
    if not isinstance(paths, (list, tuple)) or not paths or not all(isinstance(p, str) for p in paths):
        raise DocumentError(31002, "$unset specification must be a string or an array of strings")
    for p in paths:
        if p.startswith("$"):
            raise DocumentError(16410, "FieldPath field names may not start with '$'.")
        if any(q != p and q.startswith(p + ".") for q in paths) or list(paths).count(p) > 1:
            raise DocumentError(31249, f"Path collision at {p}")
    for p in paths:
        names = split_path(p)
        found = top_level(Scope(df), names[0])
        if found:
            df = df.drop(quoted(names[0])) if len(names) == 1 else df.withColumn(names[0], dropped(*found, names[1:]))
    return df


def _flag(value: object) -> bool | None:
    """True for inclusion, False for exclusion, None for a computed field."""
    if isinstance(value, bool) or (isinstance(value, (int, float)) and not isinstance(value, bool)):
        return bool(value)
    return None


def _leaves(spec: dict, at: str = "") -> list[tuple[str, object]]:
    out = []
    for k, v in spec.items():
        if k == "" or (not at and not spec):
            raise DocumentError(40352, "FieldPath cannot be constructed with empty string")
        path = f"{at}.{k}" if at else k
        if isinstance(v, dict) and not any(x.startswith("$") for x in v):
            if not v:
                raise DocumentError(51270, "An empty sub-projection is not a valid value")
            out += _leaves(v, path)
        else:
            out.append((path, v))
    return out


def project(df: DataFrame, spec: object, scope: Scope, *, find: bool = False) -> DataFrame:
    """Inclusion, exclusion and computed fields. _id stays unless it is excluded."""
    if not isinstance(spec, dict):
        raise DocumentError(15969, "$project specification must be an object")
    if not spec:
        if find:
            return df
        raise DocumentError(51272, "Invalid $project :: caused by :: projection specification must have at least one field")
    leaves = _leaves(spec)
    for path, _ in leaves:
        if path.endswith(".$"):
            raise DocumentError(31324, "positional projection is only for find")
        if path.startswith("$"):
            raise DocumentError(16410, "FieldPath field names may not start with '$'.")
    flags = {_flag(v) for p, v in leaves if p != "_id"}
    id_flag = next((_flag(v) for p, v in leaves if p == "_id"), None)
    if False in flags and (True in flags or None in flags):
        raise DocumentError(31254 if True in flags else 31252, "Cannot do exclusion in inclusion projection")
    if flags == {False} or (not flags and id_flag is False):
        return unset(df, [p for p, v in leaves if _flag(v) is False])
    return _included(df, leaves, scope, id_flag)


def _included(df: DataFrame, leaves: list[tuple[str, object]], scope: Scope, id_flag: bool | None) -> DataFrame:
    tree: dict = {}
    names = [p for p, _ in leaves]
    if "_id" in df.columns and id_flag is not False and "_id" not in names:
        tree["_id"] = True
    for path, value in leaves:
        if path == "_id" and _flag(value) is False:
            continue
        node, parts = tree, split_path(path)
        for part in parts[:-1]:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise DocumentError(31249, f"Path collision at {path}")
        if parts[-1] in node:
            raise DocumentError(31250, f"Path collision at {path}")
        node[parts[-1]] = True if _flag(value) else (value,)
    out = []
    order = [c for c in df.columns if c in tree] + [k for k in tree if k not in df.columns]
    for name in order:
        node = tree[name]
        found = top_level(scope, name)
        if node is True:
            if found:
                out.append(quoted(name))
        elif isinstance(node, tuple):
            if node[0] != "$$REMOVE":
                out.append(compile_expression(node[0], scope).alias(name))
        else:
            out.append(_subtree(node, *(found or (F.lit(None), T.NullType())), scope).alias(name))
    return df.select(*out)


def _subtree(node: dict, value: Column, kind: T.DataType, scope: Scope) -> Column:
    """The chosen fields of a document, or of each document of an array."""
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        return F.transform(value, lambda e: _subtree(node, e, element, scope))
    fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    parts = []
    for name, inner in node.items():
        if inner is True:
            if name in fields:
                parts.append(value.getField(name).alias(name))
        elif isinstance(inner, tuple):
            parts.append(compile_expression(inner[0], scope).alias(name))
        else:
            parts.append(_subtree(inner, value.getField(name) if name in fields else F.lit(None), fields.get(name, T.NullType()), scope).alias(name))
    made = F.struct(*parts) if parts else F.struct()
    computed = any(isinstance(x, tuple) for x in node.values())
    return made if computed or isinstance(kind, T.NullType) else F.when(value.isNotNull(), made)


def replace_root(df: DataFrame, expr: object, scope: Scope) -> DataFrame:
    column, kind = typed(expr, scope)
    if not isinstance(kind, T.StructType):
        raise DocumentError(40228, "'newRoot' expression must evaluate to an object")
    return df.select(column.alias("_root")).select(*[F.col("_root").getField(f.name).alias(f.name) for f in kind.fields])


def redact(df: DataFrame, expr: object, scope: Scope) -> DataFrame:
    """$$KEEP, $$PRUNE or $$DESCEND at each level of documents, by the schema."""
    marks = {k: (F.lit(k.lower()), T.StringType()) for k in ("DESCEND", "PRUNE", "KEEP")}

    def level(fields: list[tuple[str, Column, T.DataType]]) -> tuple[Column, Column]:
        """(decision, document) of one level, whose fields are what $paths mean."""
        inner = Scope(df.sparkSession.createDataFrame([], T.StructType([T.StructField(n, k) for n, _, k in fields])), scope.vars).bind(**marks)
        decision = _with_fields(compile_expression, expr, inner, {n: c for n, c, _ in fields})
        parts = []
        for name, column, kind in fields:
            if isinstance(kind, T.StructType):
                verdict, document = level([(f.name, column.getField(f.name), f.dataType) for f in kind.fields])
                column = F.when(verdict == "prune", F.lit(None)).when(verdict == "keep", column).otherwise(document)
            parts.append(column.alias(name))
        return decision, F.struct(*parts)

    fields = [(f.name, quoted(f.name), f.dataType) for f in df.schema.fields]
    decision, document = level(fields)
    whole = F.struct(*[c.alias(n) for n, c, _ in fields])
    kept = df.select(decision.alias("_d"), whole.alias("_whole"), document.alias("_doc")).filter("_d <> 'prune'")
    return kept.select(*[F.when(F.col("_d") == "keep", F.col("_whole").getField(n)).otherwise(F.col("_doc").getField(n)).alias(n) for n, _, _ in fields])


def _with_fields(compile_, expr: object, inner: Scope, columns: dict[str, Column]) -> Column:
    """Compile an expression whose paths mean the given columns, by binding them as variables."""

    def rebound(e: object) -> object:
        if isinstance(e, str) and e.startswith("$") and not e.startswith("$$"):
            name = e[1:].split(".")[0]
            return "$$f_" + e[1:] if name in columns else {"$literal": None}
        if isinstance(e, dict):
            return {k: rebound(v) for k, v in e.items()}
        return [rebound(x) for x in e] if isinstance(e, (list, tuple)) else e

    kinds = {f.name: f.dataType for f in inner.df.schema.fields}
    return compile_(rebound(expr), inner.bind(**{f"f_{n}": (c, kinds[n]) for n, c in columns.items()}))


def positional(df: DataFrame, path: str, query: dict, scope: Scope) -> Column:
    """The first element of an array that meets the filter's condition on it."""
    from docmill.operators.filters import element_match

    found = top_level(scope, path)
    if not found or not isinstance(found[1], T.ArrayType):
        raise DocumentError(51246, f"positional operator '.$' couldn't find a matching element in {path}")
    condition = query.get(path)
    if condition is None:
        raise DocumentError(51246, "the positional operator needs a condition on its array in the filter")
    if isinstance(condition, dict) and "$elemMatch" in condition:
        condition = condition["$elemMatch"]
    elif not (isinstance(condition, dict) and any(k.startswith("$") for k in condition)):
        condition = {"$eq": condition}
    element = found[1].elementType
    return F.slice(F.filter(found[0], lambda e: element_match(e, element, condition)), 1, 1)


