"""Pipeline stages as DataFrame transformations."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from docmill.errors import DocumentError, bad_value
from docmill.functions import values as V
from docmill.functions.accumulators import compile_accumulator
from docmill.functions.expressions import compile_expression, needs_whole, typed
from docmill.functions.paths import Scope, quoted, resolve, split_path
from docmill.operators import shaping, windows
from docmill.operators.filters import compile_filter
from docmill.sources.shared import materialise

BINS = 1000  # ranges in which running totals are made


@dataclass(frozen=True)
class Context:
    """What a pipeline may refer to: other collections, variables, and the order it has been sorted in."""

    spark: SparkSession
    collections: Callable[[str], DataFrame] = field(default=lambda name: _unknown(name))
    vars: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)
    order: tuple[tuple[str, int], ...] = ()
    flatten_id: bool = False

    def scope(self, df: DataFrame) -> Scope:
        return Scope(df, self.vars)


def _unknown(name: str) -> DataFrame:
    raise DocumentError(73, f"no collection named {name!r}")


Stage = Callable[[DataFrame, object, Context], DataFrame]
_STAGES: dict[str, Stage] = {}
#: Stages after which rows are still in the order of the last $sort.
_KEEP_ORDER = {"$match", "$addFields", "$set", "$project", "$unset", "$limit", "$skip", "$unwind", "$redact"}


def stage(*names: str) -> Callable[[Stage], Stage]:
    def keep(f: Stage) -> Stage:
        for n in names:
            _STAGES[n] = f
        return f

    return keep


def stage_names() -> list[str]:
    return sorted(_STAGES)


def run_pipeline(df: DataFrame, pipeline: list[dict], context: Context) -> DataFrame:
    from docmill.plans.rewrite import rewrite

    if not isinstance(pipeline, (list, tuple)):
        raise DocumentError(14, "'pipeline' option must be specified as an array")
    for item in rewrite(list(pipeline)):
        name, spec = stage_of(item)
        df = _STAGES[name](df, spec, context)
        if name == "$sort":
            context = replace(context, order=tuple((k, V.sort_direction(v)) for k, v in spec.items()))
        elif name not in _KEEP_ORDER:
            context = replace(context, order=())
    return df


def stage_of(item: object) -> tuple[str, object]:
    if not isinstance(item, dict) or len(item) != 1:
        raise DocumentError(40323, "A pipeline stage specification object must contain exactly one field.")
    ((name, spec),) = item.items()
    if name not in _STAGES:
        raise DocumentError(40324, f"Unrecognized pipeline stage name: '{name}'")
    return name, spec


# --- row by row ---


@stage("$match")
def match(df, spec, context):
    if not isinstance(spec, dict):
        raise DocumentError(15959, "the match filter must be an expression in an object")
    if "$text" in spec:
        from docmill.operators.search import with_text_score

        df = with_text_score(df, spec["$text"])
    return df.filter(compile_filter(spec, context.scope(df)))


@stage("$addFields", "$set")
def add_fields(df, spec, context):
    return shaping.add_fields(df, spec, context.scope(df))


@stage("$unset")
def unset(df, spec, context):
    return shaping.unset(df, spec)


@stage("$project")
def project(df, spec, context):
    return shaping.project(df, spec, context.scope(df))


@stage("$replaceRoot")
def replace_root(df, spec, context):
    return shaping.replace_root(df, spec["newRoot"], context.scope(df))


@stage("$replaceWith")
def replace_with(df, spec, context):
    return shaping.replace_root(df, spec, context.scope(df))


@stage("$redact")
def redact(df, spec, context):
    return shaping.redact(df, spec, context.scope(df))


@stage("$unwind")
def unwind(df, spec, context):
    parts = {"path": spec} if isinstance(spec, str) else spec
    if not isinstance(parts, dict) or not isinstance(parts.get("path"), str):
        raise DocumentError(15981, "expected either a string or an object as specification for $unwind stage")
    path = parts["path"]
    if not path.startswith("$"):
        raise DocumentError(28818, f"path option to $unwind stage should be prefixed with a '$': {path}")
    names = split_path(path[1:])
    scope = context.scope(df)
    column, kind = resolve(scope, path[1:])
    keep, index = parts.get("preserveNullAndEmptyArrays", False), parts.get("includeArrayIndex")
    if not isinstance(kind, T.ArrayType):
        out = df if keep else df.filter(column.isNotNull())
        return out.withColumn(index, F.lit(None).cast("long")) if index else out
    made = (F.posexplode_outer if keep else F.posexplode)(column)
    rows = df.select("*", made.alias("_pos", "_item"))
    if len(names) == 1:
        out = rows.select(*[F.col("_item").alias(c) if c == names[0] else quoted(c) for c in df.columns], "_pos")
    else:
        out = shaping.put(rows, {path[1:]: F.col("_item")}).drop("_item")
    out = out.withColumn(index, F.col("_pos").cast("long")) if index else out
    return out.drop("_pos")


# --- order and number ---


@stage("$sort")
def sort(df, spec, context):
    if not isinstance(spec, dict) or not spec:
        raise DocumentError(15976, "$sort stage must have at least one sort key")
    return df.orderBy(*sort_keys(df, spec, context))


def sort_keys(df: DataFrame, spec: dict, context: Context) -> list[Column]:
    scope, keys = context.scope(df), []
    for path, how in spec.items():
        if isinstance(how, dict) and how.get("$meta") == "textScore":
            keys.append(F.col("_score").desc())
            continue
        direction = V.sort_direction(how)
        keys.append(V.descending_last(V.sort_value(*resolve(scope, path), direction), direction))
    return keys


@stage("$limit")
def limit(df, spec, context):
    return df.limit(min(needs_whole(spec, "$limit", 1), 2**31 - 1))


@stage("$skip")
def skip(df, spec, context):
    return df.offset(min(needs_whole(spec, "$skip", 0), 2**31 - 1))


@stage("$sample")
def sample(df, spec, context):
    return df.orderBy(F.rand()).limit(needs_whole(spec["size"], "$sample", 1))


@stage("$count")
def count(df, spec, context):
    if not isinstance(spec, str) or not spec or spec.startswith("$") or "." in spec:
        raise DocumentError(40156, "the count field must be a non-empty string without $ and .")
    return df.agg(F.count(F.lit(1)).alias(spec)).filter(quoted(spec) > 0)


# --- groups ---


@stage("$group")
def group(df, spec, context):
    if not isinstance(spec, dict) or "_id" not in spec:
        raise DocumentError(15955, "a group specification must include an _id")
    scope = context.scope(df)
    for name in spec:
        if "." in name:
            raise DocumentError(40235, f"The field name '{name}' cannot contain '.'")
        if name.startswith("$"):
            raise DocumentError(40236, f"The field name '{name}' cannot be an operator name")
    order = [(V.sort_value(*resolve(scope, k), d), d) for k, d in context.order]
    aggregates = [compile_accumulator(x, scope, order).alias(name) for name, x in spec.items() if name != "_id"]
    by = spec["_id"]
    keys, rebuilt = group_keys(by, scope)
    if not keys:
        constant = compile_expression(by, scope) if by is not None else F.lit(None)
        out = df.groupBy().agg(F.count(F.lit(1)).alias("_n"), *aggregates).filter("_n > 0").drop("_n")
        return out.select(constant.alias("_id"), *[quoted(n) for n in spec if n != "_id"])
    grouped = df.groupBy(*[c.alias(n) for n, c in keys])
    out = grouped.agg(*aggregates) if aggregates else grouped.agg(F.lit(1).alias("_n")).drop("_n")
    if context.flatten_id:
        return out.select(*[F.col(n).alias(n.removeprefix("_k_")) for n, _ in keys], *[quoted(n) for n in spec if n != "_id"])
    return out.select(rebuilt.alias("_id"), *[quoted(n) for n in spec if n != "_id"])


def group_keys(by: object, scope: Scope) -> tuple[list[tuple[str, Column]], Column]:
    """Flat grouping columns of an _id expression, and the _id made of them again."""
    if isinstance(by, dict) and by and not any(k.startswith("$") for k in by):
        keys, parts = [], []
        for k, v in by.items():
            inner, rebuilt = group_keys(v, scope) if isinstance(v, dict) and not any(x.startswith("$") for x in v) else ([(k, compile_expression(v, scope))], None)
            named = [(f"_k_{k}" if rebuilt is None else f"_k_{k}_{n.removeprefix('_k_')}", c) for n, c in inner]
            keys += named
            parts.append((F.col(named[0][0]) if rebuilt is None else F.struct(*[F.col(n).alias(n.removeprefix(f"_k_{k}_")) for n, _ in named])).alias(k))
        return keys, F.struct(*parts)
    if by is None or not isinstance(by, (str, dict)) or (isinstance(by, str) and not by.startswith("$")):
        return [], F.lit(None)
    return [("_k__id", compile_expression(by, scope))], F.col("_k__id")


@stage("$sortByCount")
def sort_by_count(df, spec, context):
    return sort(group(df, {"_id": spec, "count": {"$sum": 1}}, replace(context, flatten_id=False)), {"count": -1}, context)


@stage("$bucket")
def bucket(df, spec, context):
    bounds = spec["boundaries"]
    if len(bounds) < 2 or any(not a < b for a, b in zip(bounds, bounds[1:])):
        raise DocumentError(40194, "the 'boundaries' option to $bucket must be sorted in ascending order")
    scope = context.scope(df)
    value, _ = typed(spec["groupBy"], scope)
    id_ = None
    for a, b in zip(bounds, bounds[1:]):
        inside = (value >= V.literal(a)) & (value < V.literal(b))
        id_ = F.when(inside, V.literal(a)) if id_ is None else id_.when(inside, V.literal(a))
    if "default" in spec:
        id_ = id_.otherwise(V.literal(spec["default"]))
    else:
        id_ = F.coalesce(id_, F.raise_error(F.lit("$bucket found a value outside of all boundaries and has no default")).cast("int"))
    marked = df.withColumn("_bucket", id_)
    output = spec.get("output", {"count": {"$sum": 1}})
    out = group(marked, {"_id": "$_bucket", **output}, replace(context, flatten_id=False))
    return out.orderBy("_id")


def running_totals(counts: DataFrame, value: str, n: str) -> DataFrame:
    """counts plus _before: the sum of n over all smaller values, without one task seeing all rows."""
    edges = counts.agg(F.percentile_approx(value, [i / BINS for i in range(1, BINS)], BINS * 10).alias("e")).first().e or []
    edges = sorted(set(edges))  # BINS - 1 numbers at most
    bin_ = F.lit(0)
    if edges:
        bin_ = F.size(F.filter(F.lit(edges), lambda e: e < F.col(value)))
    binned = counts.withColumn("_bin", bin_)
    sums = binned.groupBy("_bin").agg(F.sum(n).alias("_sum"))  # BINS rows at most
    ahead = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_bin", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(offsets, "_bin").withColumn("_before", F.col("_offset") + F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return out.drop("_bin", "_offset")


@stage("$bucketAuto")
def bucket_auto(df, spec, context):
    """n buckets of about equal size; equal values share one. A bucket's max is the next one's min."""
    n = needs_whole(spec["buckets"], "$bucketAuto", 1)
    if "granularity" in spec:
        raise DocumentError(238, "$bucketAuto granularity")
    scope = context.scope(df)
    valued = df.withColumn("_v", compile_expression(spec["groupBy"], scope))
    counts = running_totals(valued.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")), "_v", "_n")
    totals = counts.agg(F.sum("_n").alias("t")).first().t or 0
    # A value goes where its first occurrence falls.
    placed = counts.select("_v", F.floor(F.col("_before") * n / F.lit(max(totals, 1))).cast("int").alias("_b"))
    joined = valued.join(placed, valued["_v"].eqNullSafe(placed["_v"])).drop(placed["_v"])
    output = spec.get("output", {"count": {"$sum": 1}})
    inner = context.scope(joined)
    aggregates = [compile_accumulator(x, inner).alias(k) for k, x in output.items()]
    out = joined.groupBy("_b").agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), *aggregates)  # n rows at most
    ahead = Window.orderBy("_b")
    return out.select(F.struct(F.col("_min").alias("min"), F.coalesce(F.lead("_min").over(ahead), F.col("_max")).alias("max")).alias("_id"), *[quoted(k) for k in output]).orderBy("_id")


@stage("$facet")
def facet(df, spec, context):
    """One row with an array for each sub-pipeline."""
    out = None
    for name, pipeline in spec.items():
        rows = run_pipeline(df, pipeline, context)
        one = rows.agg(F.collect_list(F.struct(*[quoted(c) for c in rows.columns])).alias(name))
        out = one if out is None else out.join(one)  # one row each
    return out


# --- windows ---


@stage("$setWindowFields")
def set_window_fields(df, spec, context):
    return windows.set_window_fields(df, spec, context.scope)


@stage("$fill")
def fill(df, spec, context):
    return windows.fill(df, spec, context.scope)


@stage("$densify")
def densify(df, spec, context):
    return windows.densify(df, spec, context.scope)


# --- several collections ---


def _document(df: DataFrame) -> Column:
    return F.struct(*[quoted(c) for c in df.columns])


def _other(name: object, context: Context) -> DataFrame:
    return name if isinstance(name, DataFrame) else context.collections(name)


@stage("$lookup")
def lookup(df, spec, context):
    """Matches of another collection as an array; left outer."""
    as_ = spec["as"]
    if "pipeline" in spec:
        return _lookup_pipeline(df, spec, context)
    other = _other(spec["from"], context)
    local, kind = resolve(context.scope(df), spec["localField"])
    foreign, fkind = resolve(Scope(other), spec["foreignField"])
    docs = other.select(foreign.alias("_fk"), _document(other).alias("_doc"), F.monotonically_increasing_id().alias("_number"))
    if isinstance(fkind, T.ArrayType):
        docs = docs.select(F.explode_outer(F.array_distinct("_fk")).alias("_fk"), "_doc", "_number")
    lists = docs.groupBy("_fk").agg(F.collect_list("_doc").alias("_docs"))
    empty = F.array().cast(T.ArrayType(other.schema))
    if not isinstance(kind, T.ArrayType):
        keyed = df.withColumn("_lk", local)
        out = keyed.join(lists, keyed["_lk"].eqNullSafe(lists["_fk"]), "left").drop("_lk", "_fk")
        return _placed(out, df, as_, F.coalesce("_docs", empty)).drop("_docs")
    # What is found depends on the array alone, so arrays stand for their rows; a foreign row counts once for each.
    keyed = df.withColumn("_keys", local)
    keys = keyed.select("_keys").distinct().select("_keys", F.explode(F.array_distinct("_keys")).alias("_lk"))
    met = keys.join(docs, keys["_lk"].eqNullSafe(docs["_fk"])).dropDuplicates(["_keys", "_number"])
    found = met.groupBy(F.col("_keys").alias("_found")).agg(F.collect_list("_doc").alias("_docs"))
    out = keyed.join(found, F.col("_keys").eqNullSafe(F.col("_found")), "left")
    return _placed(out, df, as_, F.coalesce("_docs", empty)).drop("_docs", "_keys", "_found")


def _placed(out: DataFrame, df: DataFrame, as_: str, value: Column) -> DataFrame:
    return shaping.put(out, {as_: value}) if "." in as_ else out.withColumn(as_, value)


def _lookup_pipeline(df, spec, context):
    """let variables are the outer document's; leading $match stages become the join condition."""
    scope, as_ = context.scope(df), spec["as"]
    pipeline = list(spec["pipeline"])
    other = _other(spec["from"], context)
    rows, names = df, {k: typed(v, scope) for k, v in spec.get("let", {}).items()}
    for k, (c, _) in names.items():
        rows = rows.withColumn(f"_let_{k}", c)
    # What is found depends on the variables alone, so their values stand for their rows.
    standing = [F.col(f"_let_{k}") for k in names] + ([resolve(scope, spec["localField"])[0]] if "localField" in spec else [])
    numbered = any(isinstance(t, T.MapType | T.VariantType) for _, t in names.values())
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered") if numbered else rows.withColumn("_row", F.struct(*standing) if standing else F.lit(0))
    conditions = []
    while pipeline and "$match" in pipeline[0]:
        conditions.append(pipeline.pop(0)["$match"])
    inner = replace(context, vars={**context.vars, **{k: (F.col(f"_let_{k}"), t) for k, (_, t) in names.items()}}, order=())
    if not standing:  # every row gets the same documents
        found = run_pipeline(other, list(spec["pipeline"]), replace(context, order=()))
        one = found.agg(F.collect_list(_document(found)).alias("_docs"))
        return _placed(rows.join(one), df, as_, F.col("_docs")).drop("_docs", "_row")
    side = other.select(*[quoted(c).alias(f"_f_{c}") for c in other.columns])
    on = F.lit(True)
    for query in conditions:
        on = on & compile_filter(_prefixed(query), Scope(side.select("*", *[F.lit(None).cast(t).alias(f"_let_{k}") for k, (_, t) in names.items()]), inner.vars))
    if "localField" in spec:
        on = on & resolve(scope, spec["localField"])[0].eqNullSafe(quoted(f"_f_{spec['foreignField']}"))
    met = rows.select("_row", *[f"_let_{k}" for k in names], *([quoted(spec["localField"])] if "localField" in spec else []))
    met = (met if numbered else met.distinct()).join(side, on)
    back = met.select("_row", *[f"_let_{k}" for k in names], *[quoted(f"_f_{c}").alias(c) for c in other.columns])
    kept = ["_row", *[f"_let_{k}" for k in names]]
    shaped = _within_rows(back, pipeline, kept, inner)
    doc = F.struct(*[quoted(c) for c in shaped.columns if c not in (*kept, "_at")])
    kind = shaped.select(doc.alias("d")).schema[0].dataType
    docs = F.collect_list(doc)
    if "_at" in shaped.columns:
        docs = F.transform(F.array_sort(F.collect_list(F.struct("_at", doc.alias("d"))), lambda a, b: a["_at"] - b["_at"]), lambda x: x["d"])
    found = shaped.groupBy(F.col("_row").alias("_found")).agg(docs.alias("_docs"))
    out = rows.join(found, F.col("_row").eqNullSafe(F.col("_found")), "left").drop("_found", *[f"_let_{k}" for k in names])
    return _placed(out, df, as_, F.coalesce("_docs", F.array().cast(T.ArrayType(kind)))).drop("_docs", "_row")


#: Stages of a correlated pipeline that look at one document at a time.
_ONE_BY_ONE = {"$match", "$addFields", "$set", "$unset", "$project", "$unwind", "$redact"}


def _within_rows(df: DataFrame, pipeline: list[dict], kept: list[str], context: Context) -> DataFrame:
    """Stages on the documents that each _row met: order, number and groups are made within a row.

    After a $sort or $limit the column _at has the documents' places.
    """
    stages = []
    for item in pipeline:
        name, spec = stage_of(item)
        if name == "$sortByCount":
            stages += [("$group", {"_id": spec, "count": {"$sum": 1}}), ("$sort", {"count": -1})]
        elif name == "$count":
            stages += [("$group", {"_id": None, spec: {"$sum": 1}}), ("$unset", "_id")]
        else:
            stages.append((name, spec))
    for name, spec in stages:
        hidden = [*kept, *(["_at"] if "_at" in df.columns else [])]
        document = F.struct(*[quoted(c) for c in df.columns if c not in hidden])
        root = (document, T.StructType([f for f in df.schema.fields if f.name not in hidden]))
        inner = replace(context, vars={**context.vars, "ROOT": root, "CURRENT": root}, order=(("_at", 1),) if "_at" in df.columns else (), flatten_id=False)
        within = Window.partitionBy("_row")
        if name == "$sort":
            df = df.withColumn("_at", F.row_number().over(within.orderBy(*sort_keys(df, spec, inner))))
        elif name in ("$limit", "$skip"):
            n = needs_whole(spec, name, 1 if name == "$limit" else 0)
            df = df.withColumn("_at", F.row_number().over(within.orderBy("_at" if "_at" in df.columns else F.lit(0))))
            df = df.filter(F.col("_at") <= n if name == "$limit" else F.col("_at") > n)
        elif name == "$group":
            by = {"row": "$_row"} if spec.get("_id") is None else {"row": "$_row", "id": spec["_id"]}
            df = group(df, {**spec, "_id": by, **{k: {"$first": f"${k}"} for k in kept[1:]}}, inner)
            df = df.withColumn("_row", F.col("_id.row")).withColumn("_id", F.col("_id.id") if "id" in by else F.lit(None))
        elif name in ("$replaceRoot", "$replaceWith"):
            made = compile_expression(spec["newRoot"] if name == "$replaceRoot" else spec, inner.scope(df))
            df = df.select(*hidden, made.alias("_made")).select(*hidden, "_made.*")
        elif name in _ONE_BY_ONE:
            df = run_pipeline(df, [_keeping({name: spec}, hidden)], inner)
        else:
            raise DocumentError(238, f"{name} in a $lookup pipeline with variables")
    return df


def _keeping(item: dict, names: list[str]) -> dict:
    """An inclusive $project that also keeps the bookkeeping columns."""
    if "$project" in item:
        spec = item["$project"]
        flags = [v for k, v in spec.items() if k != "_id"]
        if not flags or any(v not in (0, False) for v in flags):
            return {"$project": {**{n: 1 for n in names}, **spec}}
    return item


def _prefixed(query: object) -> object:
    """A filter whose field names and $paths have the foreign side's prefix."""

    def expression(e: object) -> object:
        if isinstance(e, str) and e.startswith("$") and not e.startswith("$$"):
            return "$_f_" + e[1:]
        if isinstance(e, dict):
            return {k: (v if k == "$literal" else expression(v)) for k, v in e.items()}
        return [expression(x) for x in e] if isinstance(e, (list, tuple)) else e

    if not isinstance(query, dict):
        return query
    out = {}
    for k, v in query.items():
        if k == "$expr":
            out[k] = expression(v)
        elif k in ("$and", "$or", "$nor"):
            out[k] = [_prefixed(q) for q in v]
        else:
            out[k if k.startswith("$") else f"_f_{k}"] = v
    return out


@stage("$joined")
def joined(df, spec, context):
    """Made by a rewrite: $lookup with $unwind of its array is a plain join."""
    other = _other(spec["from"], context)
    local, _ = resolve(context.scope(df), spec["localField"])
    foreign, _ = resolve(Scope(other), spec["foreignField"])
    keyed = df.withColumn("_lk", local)
    docs = other.select(foreign.alias("_fk"), _document(other).alias("_doc"))
    out = keyed.join(docs, keyed["_lk"].eqNullSafe(docs["_fk"]), "left" if spec["outer"] else "inner").drop("_lk", "_fk")
    return out.withColumnRenamed("_doc", spec["as"]) if spec["as"] not in df.columns else out.withColumn(spec["as"], F.col("_doc")).drop("_doc")


@stage("$matched")
def matched(df, spec, context):
    """Made by a rewrite: $lookup of which only emptiness is asked is a semi or anti join."""
    other = _other(spec["from"], context)
    keyed = df.withColumn("_lk", resolve(context.scope(df), spec["localField"])[0])
    keys = other.select(resolve(Scope(other), spec["foreignField"])[0].alias("_fk"))
    return keyed.join(keys, keyed["_lk"].eqNullSafe(keys["_fk"]), "left_semi" if spec["some"] else "left_anti").drop("_lk")


def _cut(df):
    """df computed once, written and reread: plans of many steps would double with each."""
    return materialise(df, "steps")


@stage("$graphLookup")
def graph_lookup(df, spec, context):
    """Documents reachable from startWith, step by step; each once, with its least depth if asked for."""
    other = _other(spec["from"], context)
    depth_field, most = spec.get("depthField"), spec.get("maxDepth")
    start, kind = typed(spec["startWith"], context.scope(df))
    rows = df.withColumn("_row", start)  # what is found depends on the start alone, so starts stand for their rows
    values = F.explode(start) if isinstance(kind, T.ArrayType) else start
    if "restrictSearchWithMatch" in spec:
        other = other.filter(compile_filter(spec["restrictSearchWithMatch"], Scope(other)))
    target, _ = resolve(Scope(other), spec["connectToField"])
    origin, origin_kind = resolve(Scope(other), spec["connectFromField"])
    nodes = other.select(target.alias("_to"), origin.alias("_from"), _document(other).alias("_doc"))
    frontier = rows.select("_row", values.alias("_value")).distinct().filter("_value IS NOT NULL")
    found = None
    # Without maxDepth until nothing new is met: each step adds a document or is the last.
    for depth in itertools.count() if most is None else range(most + 1):
        step = frontier.join(nodes, frontier["_value"] == nodes["_to"]).select("_row", "_from", "_doc")
        step = step.withColumn("_depth", F.lit(depth).cast("long"))
        if found is not None:
            step = step.join(found.select("_row", "_doc"), ["_row", "_doc"], "left_anti").select("_row", "_from", "_doc", "_depth")
        step = _cut(step.dropDuplicates(["_row", "_doc"]))
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        if depth % 16 == 15:  # one table again, so that joins with it stay small
            found = _cut(found.coalesce(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        next_ = F.explode("_from") if isinstance(origin_kind, T.ArrayType) else F.col("_from")
        frontier = step.select("_row", next_.alias("_value")).filter("_value IS NOT NULL").distinct()
    fields = [F.col("_doc").getField(c).alias(c) for c in other.columns]
    as_doc = F.struct(*fields, *([F.col("_depth").alias(depth_field)] if depth_field else []))
    if found is None:
        return rows.drop("_row").withColumn(spec["as"], F.array().cast(T.ArrayType(other.schema)))
    lists = found.groupBy("_row").agg(F.collect_list(as_doc).alias("_docs"))
    out = rows.join(lists.withColumnRenamed("_row", "_start"), F.col("_row").eqNullSafe(F.col("_start")), "left").drop("_row", "_start")
    return out.withColumn(spec["as"], F.coalesce("_docs", F.array().cast(out.schema["_docs"].dataType))).drop("_docs")


@stage("$unionWith")
def union_with(df, spec, context):
    spec = {"coll": spec} if isinstance(spec, (str, DataFrame)) else spec
    other = run_pipeline(_other(spec["coll"], context), spec.get("pipeline", []), replace(context, order=()))
    return df.unionByName(other, allowMissingColumns=True)


# --- sources and sinks ---


@stage("$documents")
def documents(df, spec, context):
    from docmill.sources.documents import from_documents

    return from_documents(context.spark, spec)


@stage("$collStats")
def coll_stats(df, spec, context):
    """Counts, and sizes as Spark's plan estimates them, scaled and floored."""
    out = [F.count(F.lit(1)).cast("long").alias("count")]
    if "storageStats" in spec:
        scale = (spec["storageStats"] or {}).get("scale", 1)
        if isinstance(scale, bool) or not isinstance(scale, (int, float)) or scale < 1:
            raise bad_value(f"scale has to be a number >= 1: {scale!r}")
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        out.append(F.lit(size // int(scale)).alias("size"))
        out.append(F.lit(int(scale)).alias("scaleFactor"))
    return df.agg(*out)


@stage("$indexStats")
def index_stats(df, spec, context):
    return context.spark.createDataFrame([("_id_", "_id", 0)], "name string, key string, accesses long")


@stage("$currentOp")
def current_op(df, spec, context):
    tracker = context.spark.sparkContext.statusTracker()
    return context.spark.createDataFrame([(int(j), "active") for j in tracker.getActiveJobsIds()], "opid long, state string")


@stage("$merge")
def merge(df, spec, context):
    from docmill.sources.sinks import merged

    spec = {"into": spec} if isinstance(spec, (str, DataFrame)) else spec
    return merged(_other(spec["into"], context), df, spec, context)


@stage("$out")
def out(df, spec, context):
    from docmill.sources.sinks import write_collection

    write_collection(df, spec if isinstance(spec, str) else spec["coll"])
    return df


@stage("$search")
def search_stage(df, spec, context):
    from docmill.operators.search import search

    return search(df, spec, context.scope(df))


@stage("$geoNear")
def geo_near(df, spec, context):
    from docmill.operators.search import near

    return near(df, spec, context.scope(df))
