"""Dotted field paths against a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmill.errors import DocumentError


def split_path(path: str) -> list[str]:
    """The segments of a.b.c; empty ones are errors."""
    if path == "":
        raise DocumentError(40352, "FieldPath cannot be constructed with empty string")
    parts = path.split(".")
    if "" in parts:
        raise DocumentError(15998, "FieldPath field names may not be empty strings.")
    return parts


@dataclass(frozen=True)
class Scope:
    """What names mean: the table's columns and bound variables.

    vars hold (Column, type). Lambda variables only mean something inside
    their lambda; `typing` swaps them for typed nulls, so that any
    expression's type can be asked of Spark.
    """

    df: DataFrame
    vars: dict[str, tuple[Column, T.DataType]] = field(default_factory=dict)

    def bind(self, **names: tuple[Column, T.DataType]) -> Scope:
        return replace(self, vars={**self.vars, **names})

    def typing(self) -> Scope:
        return replace(self, vars={k: (F.lit(None).cast(t) if not isinstance(t, T.NullType) else F.lit(None), t) for k, (_, t) in self.vars.items()})

    def type_of(self, build: Callable[[Scope], Column]) -> T.DataType:
        return self.df.select(build(self.typing()).alias("x")).schema[0].dataType

    def root(self) -> tuple[Column, T.DataType]:
        return F.struct(*[quoted(c) for c in self.df.columns]), self.df.schema


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def top_level(scope: Scope, name: str) -> tuple[Column, T.DataType] | None:
    for f in scope.df.schema.fields:
        if f.name == name:
            return quoted(name), f.dataType
    return None


def step(column: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType] | None:
    """A field of a document value; None if there can be none."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            if f.name == name:
                return column.getField(name), f.dataType
        return None
    if isinstance(kind, T.MapType):
        return F.try_element_at(column, F.lit(name)), kind.valueType
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(column, f"$['{name}']" if not name.isidentifier() else f"$.{name}", "variant"), kind
    return None


def follow(column: Column, kind: T.DataType, names: list[str]) -> tuple[Column, T.DataType]:
    """An expression's path: arrays on the way are mapped over; a missing field is null."""
    for i, name in enumerate(names):
        if isinstance(kind, T.ArrayType):
            rest, element = names[i:], kind.elementType
            _, inner = follow(F.lit(None).cast(element), element, rest)
            if isinstance(inner, T.NullType):
                return F.array(), T.ArrayType(T.NullType())
            return F.transform(column, lambda e: follow(e, element, rest)[0]), T.ArrayType(inner)
        found = step(column, kind, name)
        if found is None:
            return F.lit(None), T.NullType()
        column, kind = found
    return column, kind


def resolve(scope: Scope, path: str) -> tuple[Column, T.DataType]:
    """The value of a dotted path of the current document."""
    names = split_path(path)
    found = top_level(scope, path) if "." in path else None  # a column may itself have dots in its name
    if found:
        return found
    found = top_level(scope, names[0])
    return follow(*found, names[1:]) if found else (F.lit(None), T.NullType())


def assigned(column: Column | None, kind: T.DataType | None, names: list[str], value: Column) -> Column:
    """The value of a top-level field after value was put at the path below it."""
    if not names:
        return value
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        return F.transform(column, lambda e: assigned(e, element, names, value))
    if not isinstance(kind, T.StructType):
        return F.struct(assigned(None, None, names[1:], value).alias(names[0]))
    inner = step(column, kind, names[0]) or (None, None)
    new = assigned(inner[0], inner[1], names[1:], value)
    filled = F.coalesce(column, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields]))
    return filled.withField("`" + names[0] + "`", new)


def dropped(column: Column, kind: T.DataType, names: list[str]) -> Column:
    """The value of a field without the path below it; missing paths change nothing."""
    if isinstance(kind, T.ArrayType):
        element = kind.elementType
        return F.transform(column, lambda e: dropped(e, element, names))
    if not isinstance(kind, T.StructType):
        return column
    inner = step(column, kind, names[0])
    if inner is None:
        return column
    if len(names) == 1:
        left = [f for f in kind.fields if f.name != names[0]]
        if not left:
            return F.when(column.isNotNull(), F.struct())
        return column.dropFields("`" + names[0] + "`")
    return column.withField("`" + names[0] + "`", dropped(*inner, names[1:]))
