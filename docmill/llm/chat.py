"""Chat formatting with DataFrame functions only.

The fingerprint of a schema, a hash of its nested field paths, selects one of
a few declarative mappings that turn a layout of prompts, instructions or
messages into canonical turns. Turns are then written with control strings
that no text can contain, because texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed values of the template. Every control string begins with < or [, which escaped texts never contain.
ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>", "</s>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("|", "&#124;"))
LEARNED_ROLE = "assistant"

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _turn(n: int, role: Column | str, text: Column) -> Column:
    return F.struct(F.lit(n).cast("long").alias("turn"), (F.lit(role) if isinstance(role, str) else role).alias("role"), text.cast("string").alias("text"))


def _listed(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda x, i: F.struct(i.cast("long").alias("turn"), x[role].cast("string").alias("role"), x[text].cast("string").alias("text")))


def _pair(*turns: tuple[str, str]) -> Callable[[Callable[[str], Column]], Column]:
    def build(field: Callable[[str], Column]) -> Column:
        both = F.array(*[_turn(i, role, field(name)) for i, (role, name) in enumerate(turns)])
        return F.filter(both, lambda t: t["text"].isNotNull())

    return build


@dataclass(frozen=True)
class Layout:
    """Field paths that must be there, paths that may be, and the turns made of them."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column] | None


LAYOUTS = (
    Layout("rows", ("turn", "role", "text"), (), None),
    Layout("messages", ("messages[].role", "messages[].content"), (), lambda f: _listed(f("messages"), "role", "content")),
    Layout("exchanges", ("conversations[].from", "conversations[].value"), (), lambda f: _listed(f("conversations"), "from", "value")),
    Layout("prompt", ("prompt", "response"), ("system",), _pair(("system", "system"), ("user", "prompt"), (LEARNED_ROLE, "response"))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), _pair(("system", "system"), ("user", "instruction"), ("user", "input"), (LEARNED_ROLE, "output"))),
)
KNOWN_PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.needs + layout.may}))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """All leaf paths of a type; [] marks the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def _hash(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(paths).encode()).hexdigest()


def fingerprint(schema: T.StructType) -> str:
    """Hash of those field paths of a schema that some mapping knows; other fields don't matter."""
    return _hash(tuple(sorted({*field_paths(schema)} & {*KNOWN_PATHS})))


def _registry() -> dict[str, Layout]:
    """Fingerprint -> layout, for every choice of a layout's optional paths."""
    return {_hash(tuple(sorted({*layout.needs, *some}))): layout for layout in LAYOUTS for n in range(len(layout.may) + 1) for some in combinations(layout.may, n)}


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns) of a table in any known layout, chosen by its fingerprint.

    Rows of turns are gathered by conv_id in the order of turn, ties by role
    and text; a null id is one conversation, repeated rows are repeated turns,
    a null text or role is empty. Other columns are ignored, unless they
    complete another layout: then the choice is unclear and a ValueError says
    so. An empty table gives an empty result.
    """
    layout = _registry().get(fingerprint(df.schema))
    if layout is None:
        raise ValueError(f"no mapping for the field paths {sorted({*field_paths(df.schema)} & {*KNOWN_PATHS})}")
    if layout.turns is None:
        turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    fields = {*df.columns}
    made = layout.turns(lambda name: F.col(f"`{name}`") if name in fields else F.lit(None).cast("string"))
    return df.select(F.col(id_col).alias("conv_id"), _filled(made).alias("turns"))


def _filled(turns: Column) -> Column:
    filled = F.transform(turns, lambda t: F.struct(t["turn"].alias("turn"), F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return F.coalesce(filled, F.array().cast(TURNS))


#: One schema that holds every layout of JSON records.
JSON_SCHEMA = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, "
    "prompt string, response string, instruction string, input string, output string, system string"
)


def _json_paths(record: Column) -> Column:
    """The sorted known paths that a parsed record has, as an array."""
    flat = [p for p in KNOWN_PATHS if "[]" not in p and p not in LAYOUTS[0].needs]
    listed = [p for p in KNOWN_PATHS if "[]." in p]

    def has(path: str) -> Column:
        if path in flat:
            return record[path].isNotNull()
        items, field = path.split("[].")
        return F.coalesce(F.exists(record[items], lambda x: x[field].isNotNull()), F.lit(False))

    return F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in sorted(flat + listed)]))


def canonical_turns_json(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns) of JSON records of mixed layouts, each row by its own fingerprint.

    Records that no mapping knows (null and broken ones too) have a null
    layout and no turns; none is dropped.
    """
    parsed = df.select(F.col(id_col).alias("conv_id"), F.from_json(F.col(json_col), JSON_SCHEMA).alias("r"))
    marked = parsed.withColumn("print", F.sha2(F.array_join(_json_paths(F.col("r")), "\n"), 256))
    known = F.create_map(*[F.lit(x) for print_, layout in _registry().items() if layout.turns for x in (print_, layout.name)])
    named = marked.withColumn("layout", known[F.col("print")])
    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        if layout.turns:
            turns = F.when(F.col("layout") == layout.name, layout.turns(lambda name: F.col("r")[name])).otherwise(turns)
    return named.select("conv_id", "layout", _filled(turns).alias("turns"))


def _replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    return _replaced(text, escapes)


def unescape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    return _replaced(text, tuple((new, old) for old, new in reversed(escapes)))


def format_chats(turned: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation as one string, and the code point ranges to learn.

    loss_spans has the (start, end) of every assistant text, end exclusive,
    in order. A conversation without turns is the empty string.
    """
    written = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(ROLE_OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(ROLE_CLOSE)).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == LEARNED_ROLE).alias("learned"),
        ),
    )
    spans = F.aggregate(
        F.transform("written", lambda w: F.struct(F.length(w["head"]).alias("head"), F.length(w["body"]).alias("body"), w["learned"].alias("learned"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, w: F.struct(
            (a["at"] + w["head"] + w["body"] + len(TURN_END)).alias("at"),
            F.when(w["learned"], F.concat(a["spans"], F.array(F.struct((a["at"] + w["head"]).alias("start"), (a["at"] + w["head"] + w["body"]).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    formatted = F.array_join(F.transform("written", lambda w: F.concat(w["head"], w["body"], F.lit(TURN_END))), "")
    return turned.withColumn("written", written).select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, turns, learned): turns and learned texts as the strings themselves tell them."""
    pieces = F.split("formatted", TURN_END, -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, r"\|>", 2)
        return F.struct(unescape(F.substring(parts[0], len(ROLE_OPEN) + 1, 2**31 - 1), ROLE_ESCAPES).alias("role"), unescape(parts[1]).alias("text"))

    learned = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumns({"turns": F.transform(whole, turn), "learned": learned})
