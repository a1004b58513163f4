"""$merge and $out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from docmill.errors import bad_value
from docmill.functions.paths import quoted


def write_collection(df: DataFrame, target: str, form: str = "parquet") -> None:
    """Replace a collection: a path (with a slash) or a table."""
    writer = df.write.mode("overwrite").format(form)
    writer.save(target) if "/" in target else writer.saveAsTable(target)


def merged(target: DataFrame, source: DataFrame, spec: dict, context) -> DataFrame:
    """The target after a keyed merge: a full outer join on the `on` fields.

    whenMatched: merge (default), replace, keepExisting, fail or a pipeline;
    whenNotMatched: insert (default), discard or fail.
    """
    on = spec.get("on", "_id")
    on = [on] if isinstance(on, str) else list(on)
    matched, missing = spec.get("whenMatched", "merge"), spec.get("whenNotMatched", "insert")
    if missing not in ("insert", "discard", "fail"):
        raise bad_value(f"unknown whenNotMatched: {missing!r}")
    old = target.select(F.struct(*[quoted(c) for c in target.columns]).alias("t"), F.lit(True).alias("_t"), *[quoted(k).alias(f"_kt{i}") for i, k in enumerate(on)])
    new = source.select(F.struct(*[quoted(c) for c in source.columns]).alias("s"), F.lit(True).alias("_s"), *[quoted(k).alias(f"_ks{i}") for i, k in enumerate(on)])
    joined = old.join(new, [F.col(f"_kt{i}").eqNullSafe(F.col(f"_ks{i}")) for i in range(len(on))], "full_outer")
    if missing == "discard":
        joined = joined.filter("_t")
    both = F.col("_t") & F.col("_s")
    columns = [*target.columns, *[c for c in source.columns if c not in target.columns]]
    side = lambda s, df, c: F.col(s).getField(c) if c in df.columns else F.lit(None)
    if isinstance(matched, (list, tuple)):
        return _with_pipeline(joined, target, source, columns, matched, context)
    if matched not in ("merge", "replace", "keepExisting", "fail"):
        raise bad_value(f"unknown whenMatched: {matched!r}")

    def value(c: str) -> Column:
        t, s = side("t", target, c), side("s", source, c)
        if matched == "keepExisting":
            hit = t
        elif matched == "replace":
            hit = s
        elif matched == "merge":
            hit = F.coalesce(s, t) if c in source.columns else t
        else:
            hit = F.raise_error(F.lit("DuplicateKey (11000): $merge with whenMatched: fail found an existing document"))
        lone = F.when(F.col("_t"), t).otherwise(s) if missing != "fail" else F.when(F.col("_t"), t).otherwise(F.raise_error(F.lit("13113: $merge could not find a matching document")))
        return F.when(both, hit).otherwise(lone).alias(c)

    return joined.select(*[value(c) for c in columns])


def _with_pipeline(joined: DataFrame, target: DataFrame, source: DataFrame, columns: list[str], pipeline, context) -> DataFrame:
    """Matched documents by a pipeline over the target document, with $$new as the source document."""
    from docmill.operators.stages import run_pipeline

    hit = joined.filter("_t AND _s").select(*[F.col("t").getField(c).alias(c) for c in target.columns], F.col("s").alias("_new"))
    inner = replace(context, vars={**context.vars, "new": (F.col("_new"), source.schema)}, order=())
    done = run_pipeline(hit, list(pipeline), inner)
    if "_new" in done.columns:
        done = done.drop("_new")
    rest = joined.filter("NOT coalesce(_t AND _s, false)").select(*[F.coalesce(*[F.col(s).getField(c) for s, df in (("t", target), ("s", source)) if c in df.columns]).alias(c) for c in columns])
    return rest.unionByName(done, allowMissingColumns=True)
