r"""Chat formatting: layouts recognised by a fingerprint of their field paths, one canonical turn form.

``turns`` hashes the nested field paths of a table's schema (names that no layout knows are left out) and
looks the hash up in ``LAYOUTS``, a table of declarative mappings. If the schema holds more than one layout,
each row takes the one that reads all known paths with text in it. ``json_turns`` does the same per row for
JSON texts of mixed layouts, by the known paths that are not null. Either gives rows (conv, pos, role, text).
``formatted`` joins the turns of a conversation to one text

    ### role: text</turn>\n

in which control strings inside roles and texts are escaped: ``\`` is written ``\b``, ``</turn>`` ``\t``,
``###`` ``\h`` and, in roles, ``:`` ``\c``. No control string is left in an escaped text and every
backslash begins a code, so ``parsed`` reads the turns back exactly. The loss mask is run-length coded per
turn (skip, take, rest, in code points) and covers the assistant texts.

Edge cases: null roles and texts are empty; turns of equal position are ordered by role, then text (repeated
rows are turns of their own); a null position comes first; a null conversation id is a conversation; an
empty table gives an empty result; extra columns are ignored. Optional fields (``input``) may be null or left
out. Tables that fit no layout raise an error with the paths found, and so does a row with text in known paths
that no single layout reads; JSON rows that fit none, or hold such text, come back with ``layout`` null and no
turns. Rows without text take the layout whose fields are not null, or else the table's.

A conversation becomes one row of text, so its turns meet in one task; nothing else is collected.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>\n"
HEAD = "### "
ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and its turns: ``rows`` (position, role, text fields), ``items`` (array, role
    and text fields) or ``fixed`` (role, fields joined by a blank line)."""

    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(p for p in self.paths if p not in self.optional)


LAYOUTS = {
    "turn_rows": Layout(("role", "text", "turn"), rows=("turn", "role", "text")),
    "messages": Layout(("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    "speakers": Layout(("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    "prompt_completion": Layout(
        ("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))
    ),
    "prompt_response": Layout(("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    "instruction": Layout(
        ("input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",))),
        optional=("input",),
    ),
    "instruction_system": Layout(
        ("input", "instruction", "output", "system"),
        fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        optional=("input",),
    ),
}
KNOWN = {path for layout in LAYOUTS.values() for path in layout.paths}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(layout.paths): name for name, layout in LAYOUTS.items()}


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested leaf paths, ``[]`` marking arrays."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def _inside(known: set[str]) -> list[str]:
    """Names of the layouts whose required paths are all there, the one with the most paths first."""
    names = [n for n, layout in LAYOUTS.items() if known.issuperset(layout.required)]
    return sorted(names, key=lambda n: (len(known.intersection(LAYOUTS[n].paths)), n), reverse=True)


def layout_of(schema: T.StructType) -> str:
    """Name of the layout with the schema's fingerprint; if known fields of other layouts are there as well,
    the layout with the most paths among them."""
    known = KNOWN.intersection(field_paths(schema))
    name = BY_FINGERPRINT.get(fingerprint(known))
    if name is None:
        inside = _inside(known)
        if not inside:
            raise ValueError(f"no layout for the fields {field_paths(schema)}")
        name = inside[0]
    return name


def _text(field: Column) -> Column:
    return F.coalesce(field.cast("string"), F.lit(""))


def _speaker(field: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    return F.coalesce(named[field], _text(field))


def _turn_array(layout: Layout, at) -> Column:
    """Array of (role, text) of a record; ``at(name)`` is its field."""
    if layout.items:
        array, role, text = layout.items
        return F.transform(
            at(array), lambda x: F.struct(_speaker(x[role]).alias("role"), _text(x[text]).alias("text"))
        )

    def joined(fields: tuple[str, ...]) -> Column:
        return F.array_join(F.filter(F.array(*[_text(at(f)) for f in fields]), lambda x: x != ""), "\n\n")

    # a leading system turn without text is left out
    every = [F.struct(F.lit(role).alias("role"), joined(fields).alias("text")) for role, fields in layout.fixed]
    return F.filter(F.array(*every), lambda x: (x["role"] != "system") | (x["text"] != ""))


def _table_turns(layout: Layout, at) -> Column:
    """Array of (pos, role, text) of a row."""
    if layout.rows:
        pos, role, text = layout.rows
        return F.array(F.struct(at(pos).cast("long").alias("pos"), _text(at(role)).alias("role"), _text(at(text)).alias("text")))
    return F.transform(
        _turn_array(layout, at), lambda x, k: F.struct(k.cast("long").alias("pos"), x["role"].alias("role"), x["text"].alias("text"))
    )


def _filled(path: str, at, blank_counts: bool) -> Column:
    """Whether a row has a value at a path; unless ``blank_counts``, empty texts are none."""

    def value(x: Column) -> Column:
        return x.isNotNull() if blank_counts else F.coalesce(x.cast("string") != "", F.lit(False))

    array, _, field = path.partition("[].")
    return F.coalesce(F.exists(at(array), lambda x: value(x[field])), F.lit(False)) if field else value(at(path))


def _chosen(names: list[str], known: list[str], at, blank_counts: bool) -> Column:
    """The first of the layouts that reads all filled paths of a row, with the most of them; null if none is
    filled or none reads all."""
    filled = {p: _filled(p, at, blank_counts) for p in known}
    some = reduce(Column.__or__, filled.values())
    choice = F.lit(None).cast("string")
    # the last condition set decides: the fewest missing paths last
    for missing in range(max(len(LAYOUTS[n].paths) for n in names), -1, -1):
        for name in reversed(names):
            unread = [filled[p] for p in known if p not in LAYOUTS[name].paths]
            lacks = reduce(Column.__add__, [(~filled[p]).cast("int") if p in filled else F.lit(1) for p in LAYOUTS[name].paths])
            fits = some & (lacks == missing)
            for other in unread:
                fits = fits & ~other
            choice = F.when(fits, F.lit(name)).otherwise(choice)
    return choice


def turns(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Canonical turns (``id_col``, pos, role, text) of a table of known layouts."""
    default = layout_of(records.schema)
    layout = LAYOUTS[default]
    known = sorted(KNOWN.intersection(field_paths(records.schema)))
    if layout.rows and set(known) == set(layout.paths):
        pos, role, text = layout.rows
        return records.select(
            F.col(id_col), F.col(pos).cast("long").alias("pos"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text")
        )
    present = {p.partition("[]")[0] for p in known}

    def at(name: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast("string")

    names = _inside(set(known))
    array = _table_turns(layout, at)
    if len(names) > 1 or set(known) - set(layout.paths):
        # a turn number is no text
        texts = [p for p in known if p != "turn"]
        some = reduce(Column.__or__, [_filled(p, at, False) for p in texts])
        unread = F.raise_error(F.lit(f"no layout reads all the texts of a row with the fields {known}")).cast("string")
        name = F.when(some, F.coalesce(_chosen(names, texts, at, False), unread)).otherwise(
            F.coalesce(_chosen(names, known, at, True), F.lit(default))
        )
        records = records.withColumn("_layout", name)
        array = reduce(
            lambda rest, n: F.when(F.col("_layout") == n, _table_turns(LAYOUTS[n], at)).otherwise(rest),
            names,
            F.array().cast("array<struct<pos:bigint,role:string,text:string>>"),
        )
    rows = records.select(F.col(id_col), F.explode(array).alias("_turn"))
    return rows.select(id_col, "_turn.pos", "_turn.role", "_turn.text")


def _nested(value: Column) -> Column:
    """Whether a variant is an object or an array: no text."""
    return F.coalesce(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def json_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(``id_col``, layout, turns): per row, the mapping is chosen by the known paths that are not null in it."""
    nested = {n: layout for n, layout in LAYOUTS.items() if not layout.rows}
    record = F.try_parse_json(json_col)
    fields: dict[str, Column] = {}
    for layout in nested.values():
        if layout.items:
            array, role, text = layout.items
            kinds = F.try_variant_get(record, f"$.{array}", f"array<struct<`{role}`:variant,`{text}`:variant>>")
            plain = ~F.exists(kinds, lambda x: _nested(x[role]) | _nested(x[text]))  # noqa: B023
            fields[array] = F.when(plain, F.try_variant_get(record, f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>"))
        else:
            for p in layout.paths:
                plain = ~_nested(F.try_variant_get(record, f"$.{p}", "variant"))
                fields[p] = F.when(plain, F.try_variant_get(record, f"$.{p}", "string"))
    given = {p: F.try_variant_get(record, f"$.{p}", "variant") for p in fields}
    rows = records.select(
        F.col(id_col).alias("_id"),
        *[field.alias(f"_f_{p}") for p, field in fields.items()],
        *[(given[p].isNotNull() & ~F.is_variant_null(given[p])).alias(f"_g_{p}") for p in fields],
    )

    def at(name: str) -> Column:
        return F.col(f"_f_{name}")

    layout, turn_array = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for name, mapping in nested.items():
        read = {p.partition("[]")[0] for p in mapping.paths}
        needed = {p.partition("[]")[0] for p in mapping.required}
        # a value of another type than the layout's is not read
        fits = reduce(
            Column.__and__,
            [
                *[at(p).isNotNull() for p in needed],
                *[F.col(f"_g_{p}") == at(p).isNotNull() for p in read],
                *[~F.col(f"_g_{p}") for p in fields if p not in read],
            ],
        )
        if mapping.items:
            array, role, text = mapping.items
            spoken = F.transform(at(array), lambda x: F.coalesce(x[role], x[text]).isNotNull())  # noqa: B023
            fits = fits & ~F.array_contains(spoken, False) & (F.size(spoken) > 0)
        fits = F.coalesce(fits, F.lit(False))
        layout = F.when(fits, F.lit(name)).otherwise(layout)
        turn_array = F.when(fits, _turn_array(mapping, at)).otherwise(turn_array)
    return rows.select(F.col("_id").alias(id_col), layout.alias("layout"), turn_array.alias("turns"))


def _replaced(text: Column, pairs) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def escape(text: Column, pairs=ESCAPES) -> Column:
    return _replaced(text, pairs)


def unescape(text: Column) -> Column:
    # the backslash last: what it yields is not read again
    return _replaced(text, [(code, plain) for plain, code in reversed(ROLE_ESCAPES)])


def formatted(turn_rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: ``id_col``, formatted, loss_mask (skip, take, rest per turn)."""
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    body = escape(F.col("text"))
    take = F.when(F.col("role") == TRAINED_ROLE, F.char_length(body)).otherwise(F.lit(0))
    whole = F.char_length(head) + F.char_length(body) + len(END)
    skip = F.when(F.col("role") == TRAINED_ROLE, F.char_length(head)).otherwise(whole)
    pieces = turn_rows.select(
        F.col(id_col),
        F.struct(
            "pos",
            "role",
            "text",
            F.concat(head, body, F.lit(END)).alias("piece"),
            F.struct(skip.alias("skip"), take.alias("take"), (whole - skip - take).alias("rest")).alias("run"),
        ).alias("_turn"),
    )
    grouped = pieces.groupBy(id_col).agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return grouped.select(
        id_col,
        F.array_join(F.transform("_turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform("_turns", lambda t: t["run"]).alias("loss_mask"),
    )


def parsed(texts: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``formatted`` read back: ``id_col``, formatted, turns (role, text), trained (the text under each mask run)."""
    pieces = texts.select("*", F.split("formatted", END).alias("_p"))
    # the text ends with the end mark, so the last piece is empty
    pieces = pieces.withColumn("_p", F.slice("_p", F.lit(1), F.size("_p") - 1))
    role = F.transform("_p", lambda p: F.substring_index(p, ": ", 1))
    pieces = pieces.withColumn("_r", role)
    turns_ = F.zip_with(
        "_p",
        "_r",
        lambda p, r: F.struct(
            unescape(F.substr(r, F.lit(len(HEAD) + 1))).alias("role"),
            unescape(F.substr(p, F.char_length(r) + 3)).alias("text"),
        ),
    )
    masked = F.zip_with("_p", "loss_mask", lambda p, m: unescape(F.substr(p, m["skip"] + 1, m["take"])))
    return pieces.select(id_col, "formatted", turns_.alias("turns"), masked.alias("trained"))
