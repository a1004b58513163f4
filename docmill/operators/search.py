"""Text, vector and geospatial search."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmill.errors import DocumentError, bad_value
from docmill.functions import values as V
from docmill.functions.paths import Scope, resolve

#: Words that a text search leaves out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")
EARTH_METRES = 6_378_100.0


# --- text ---


def text_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def stem(token: Column) -> Column:
    """A light English stem: plural and common verb endings go from words of four letters or more."""
    return F.when(F.char_length(token) > 3, F.regexp_replace(token, "(ing|ies|es|ed|s)$", "")).otherwise(token)


def _stem_word(word: str) -> str:
    return re.sub("(ing|ies|es|ed|s)$", "", word) if len(word) > 3 else word


def _query(spec: object) -> tuple[list[str], list[str], list[str]]:
    """(terms, phrases, excluded terms) of a $text operand."""
    if not isinstance(spec, dict) or not isinstance(spec.get("$search"), str):
        raise bad_value("$text needs a $search string")
    text = spec["$search"].lower()
    phrases = re.findall(r'"([^"]*)"', text)
    rest = re.sub(r'"[^"]*"', " ", text).split()
    excluded = [_stem_word(w[1:]) for w in rest if w.startswith("-") and len(w) > 1]
    words = [w for r in [*[w for w in rest if not w.startswith("-")], *phrases] for w in re.findall(r"\w+", r)]
    return [_stem_word(w) for w in dict.fromkeys(words) if w not in STOP_WORDS], phrases, excluded


def _text_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _stems(df: DataFrame) -> Column:
    return F.transform(F.concat(*[text_tokens(F.coalesce(c, F.lit(""))) for c in _text_columns(df)]), stem)


def with_text_score(df: DataFrame, spec: dict) -> DataFrame:
    """df with _score: how often the terms occur in its string fields."""
    terms, _, _ = _query(spec)
    return df.withColumn("_score", F.size(F.filter(_stems(df), lambda t: t.isin(terms))).cast("double")) if terms else df.withColumn("_score", F.lit(0.0))


def text_match(spec: dict, scope: Scope) -> Column:
    """Any term, every quoted phrase, no excluded term."""
    terms, phrases, excluded = _query(spec)
    df = scope.df.drop("_score") if "_score" in scope.df.columns else scope.df
    stems, whole = _stems(df), F.lower(F.concat_ws(" ", *_text_columns(df)))
    # A word begins with its stem: texts that hold no stem as a part needn't be split.
    parts = [V.any_of([F.contains(whole, F.lit(t)) for t in terms]) & F.arrays_overlap(stems, F.array(*[F.lit(t) for t in terms])) if terms else F.lit(False)]
    parts += [F.contains(whole, F.lit(p)) for p in phrases]
    parts += [~F.array_contains(stems, t) for t in excluded]
    return F.coalesce(V.all_of(parts), F.lit(False))


# --- vectors ---


def check_vector_index(options: dict) -> None:
    limits = {"dimensions": (2, 16000), "m": (2, 100), "efConstruction": (4, 1000), "numLists": (1, 32768), "efSearch": (1, 1000)}
    for name, (lo, hi) in limits.items():
        if name in options and not lo <= options[name] <= hi:
            raise bad_value(f"{name} must be between {lo} and {hi}")
    if options.get("similarity", "COS") not in ("COS", "L2", "IP"):
        raise bad_value("similarity must be COS, L2 or IP")


def similarity(column: Column, vector: list[float], kind: str) -> Column:
    """COS and IP: greater is nearer. L2: the distance."""
    other = F.array(*[F.lit(float(x)) for x in vector])
    doubles = F.transform(column, lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    if kind == "IP":
        return dot(doubles, other)
    if kind == "COS":
        return F.try_divide(dot(doubles, other), F.sqrt(dot(doubles, doubles)) * math.sqrt(sum(float(x) ** 2 for x in vector)))
    if kind == "L2":
        return F.sqrt(F.aggregate(F.zip_with(doubles, other, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    raise bad_value(f"unknown similarity {kind!r}")


def search(df: DataFrame, spec: dict, scope: Scope) -> DataFrame:
    """The k nearest documents to a vector, exactly, with the score in _score. Each task keeps its k best."""
    if "cosmosSearch" not in spec:
        raise DocumentError(238, "$search other than cosmosSearch")
    s = spec["cosmosSearch"]
    k, vector = s["k"], s["vector"]
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise bad_value("k must be a whole number of 1 or more")
    column, kind = resolve(scope, s["path"])
    if not isinstance(kind, T.ArrayType):
        raise bad_value(f"{s['path']} has no vectors")
    how = s.get("similarity", "COS")
    score = F.when(F.size(column) == len(vector), similarity(column, vector, how))
    out = df.filter(s["filter"]) if isinstance(s.get("filter"), Column) else df
    if isinstance(s.get("filter"), dict):
        from docmill.operators.filters import compile_filter

        out = df.filter(compile_filter(s["filter"], scope))
    ranked = out.withColumn("_score", score).filter("_score IS NOT NULL")
    return ranked.orderBy(F.col("_score").asc() if how == "L2" else F.col("_score").desc()).limit(k)


# --- geography ---


def _point(value: Column, kind: T.DataType) -> tuple[Column, Column] | None:
    """(lon, lat) in degrees of a GeoJSON point, a pair or a {lon, lat} document."""
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields]
        if "coordinates" in names:
            return _point(value.getField("coordinates"), kind["coordinates"].dataType)
        if len(names) >= 2:
            return value.getField(names[0]).cast("double"), value.getField(names[1]).cast("double")
    if isinstance(kind, T.ArrayType) and V.is_number(kind.elementType):
        return F.get(value, F.lit(0)).cast("double"), F.get(value, F.lit(1)).cast("double")
    return None


def arc(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Radians along the great circle."""
    a = F.sin((F.radians(lat) - math.radians(lat0)) / 2) ** 2 + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.sin((F.radians(lon) - math.radians(lon0)) / 2) ** 2
    return 2 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _inside_ring(x: Column, y: Column, ring: list) -> Column:
    """Ray casting; the ring closes itself."""
    crossings = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            between = (y >= min(y1, y2)) & (y < max(y1, y2))
            crossings.append(F.when(between & (x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1))), 1).otherwise(0))
    return sum(crossings[1:], crossings[0]) % 2 == 1 if crossings else F.lit(False)


def within(lon: Column, lat: Column, shape: dict) -> Column:
    if "$centerSphere" in shape:
        (lon0, lat0), radius = shape["$centerSphere"]
        return arc(lon, lat, lon0, lat0) <= radius
    if "$center" in shape:
        (x0, y0), radius = shape["$center"]
        return (lon - x0) ** 2 + (lat - y0) ** 2 <= radius**2
    if "$box" in shape:
        (x1, y1), (x2, y2) = shape["$box"]
        return lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2))
    if "$polygon" in shape:
        return _inside_ring(lon, lat, shape["$polygon"])
    if "$geometry" in shape:
        g = shape["$geometry"]
        polygons = [g["coordinates"]] if g.get("type") == "Polygon" else g["coordinates"] if g.get("type") == "MultiPolygon" else None
        if g.get("type") == "Point":
            return (lon == float(g["coordinates"][0])) & (lat == float(g["coordinates"][1]))
        if polygons is None:
            raise bad_value(f"unsupported geometry {g.get('type')!r}")
        return V.any_of(_inside_ring(lon, lat, rings[0]) & ~V.any_of(_inside_ring(lon, lat, hole) for hole in rings[1:]) for rings in polygons)
    raise bad_value("unknown geo specifier")


def geo_condition(value: Column, kind: T.DataType, names: list[str], op: str, arg: dict) -> Column:
    from docmill.functions.paths import follow

    point = _point(*follow(value, kind, names))
    if point is None:
        return F.lit(False)
    if op in ("$near", "$nearSphere"):
        g = arg.get("$geometry", {"coordinates": arg} if isinstance(arg, list) else arg)
        metres = arc(*point, *g["coordinates"]) * EARTH_METRES
        return F.coalesce((metres <= arg.get("$maxDistance", float("inf"))) & (metres >= arg.get("$minDistance", 0)), F.lit(False))
    return F.coalesce(within(*point, arg), F.lit(False))


def near(df: DataFrame, spec: dict, scope: Scope) -> DataFrame:
    """$geoNear: distance in metres from a point, nearest first."""
    point = _point(*resolve(scope, spec["key"]))
    if point is None:
        raise bad_value("$geoNear needs a key with points")
    target = spec["near"]["coordinates"] if isinstance(spec["near"], dict) else spec["near"]
    metres = arc(*point, *target) * EARTH_METRES * spec.get("distanceMultiplier", 1)
    if spec.get("query"):
        from docmill.operators.filters import compile_filter

        df = df.filter(compile_filter(spec["query"], scope))
    out = df.withColumn(spec["distanceField"], metres).filter(F.col(spec["distanceField"]).between(spec.get("minDistance", 0), spec.get("maxDistance", 1e300)))
    return out.orderBy(spec["distanceField"])
