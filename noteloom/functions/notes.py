"""Parsing drafts, and the tests on their values, as column expressions.

A draft is text that should hold one JSON object. Its note is a map from key to
value in the order of the text; a value is a VARIANT with what the tests ask of
it beside (``typed``). The three states of a field, absent, a gap, and a value of
some type, stay apart.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.rules import DURATION_GAP, GAP_MARKER, GAP_WORDS, Rules
from noteloom.runtime import fresh_name, quoted

NOTE = "map<string,variant>"
#: What every gap word looks like; few texts get as far as the words themselves.
MAYBE_GAP = rf"(?iU)^\s*(?:{'|'.join(re.escape(w) for w in GAP_WORDS if w)})?\s*$"


def strip(c: Column) -> Column:
    """Without outer white space. The pattern would try every place of a text; only one with space at an end is given to it."""
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(F.rlike(ends, F.lit(r"(?U)\s")), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(c)


def drop_think(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<think>")), F.regexp_replace(c, r"(?s)<think>.*?</think>", "")).otherwise(c)


def drop_fence(c: Column) -> Column:
    """Without the first line, and the later lines that start a fence, if the text starts with one."""
    lines = F.split(c, "\n", -1)
    rest = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~F.startswith(strip(x), F.lit("```")))
    return F.when(F.startswith(c, F.lit("```")), F.array_join(rest, "\n")).otherwise(c)


def brace_slice(c: Column) -> Column:
    """From the first { to the last }; null if there is no such stretch."""
    first, last = F.locate("{", c), F.length(c) - F.length(F.substring_index(c, "}", -1))
    return F.when((first > 0) & (F.locate("}", c) > 0) & (last > first), F.substring(c, first, last - first + 1))


def json_text(draft: Column) -> Column:
    """Each step names its text more than once: it gets it under a name, or the expression would grow with every step."""
    for step in (drop_think, strip, drop_fence, brace_slice):
        draft = F.element_at(F.transform(F.array(draft), step), 1)
    return draft


def last_wins(entries: Column) -> Column:
    """A map from entries; of equal keys the first place and the last value hold."""
    keys = F.transform(entries, lambda e: e["key"])
    once = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(once))


def entries_of(json: Column) -> Column:
    """Entries of a JSON object's text; none if it isn't one."""
    return F.map_entries(F.coalesce(F.from_json(json, NOTE), F.from_json(F.lit("{}"), NOTE)))


def looked_at(raw: Column) -> Column:
    return F.struct(F.schema_of_variant(raw).alias("kind"), F.try_variant_get(raw, "$", "string").alias("text"), raw.alias("raw"))


def judged(v: Column) -> Column:
    listy = F.startswith(v["kind"], F.lit("ARRAY"))
    # [] and [null] are both arrays of void; only the first has no items
    empty = F.when(v["kind"] == "ARRAY<VOID>", F.size(F.try_variant_get(v["raw"], "$", "array<variant>")) == 0).otherwise(False)
    gap_ = F.when(v["kind"] == "STRING", is_text_gap(v["text"])).when(v["kind"] == "VOID", True).when(v["kind"] == "BIGINT", v["text"] == str(DURATION_GAP)).otherwise(empty)
    items = F.when(listy, F.try_variant_get(v["raw"], "$", "array<string>"))
    return F.struct(v["kind"].alias("kind"), v["text"].alias("text"), items.alias("items"), empty.alias("empty"), gap_.alias("gap"), v["raw"].alias("raw"))


def typed(raw: Column) -> Column:
    """What the tests ask of a value, once: its kind and text, its items if it is a list, whether it is a gap, and itself."""
    return F.element_at(F.transform(F.array(looked_at(raw)), judged), 1)


def note_of(entries: Column) -> Column:
    """The note: a map from key to a typed value."""
    return F.transform_values(F.transform_values(last_wins(entries), lambda _, raw: looked_at(raw)), lambda _, v: judged(v))


def parse_note(draft: Column) -> Column:
    """The draft's object; an empty map if it has none. (``plans.scoring.parsed`` takes the same steps one by one.)"""
    return note_of(entries_of(json_text(draft)))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row.

    Filters and projections above would otherwise be merged with them, and repeat
    a long expression wherever its column is used; nothing merges with a generator.
    The generator only hands on what a projection below it has made: an expression in
    a generator isn't compiled.
    """
    for name, c in columns.items():
        made = fresh_name(df, "__made")
        df = df.withColumn(made, c).select(*[F.col(quoted(x)) for x in df.columns], F.explode(F.array(made)).alias(name))
    return df


def text_of(v: Column) -> Column:
    """A value as text, as JSON would show it without quotes."""
    return v["text"]


def kind(v: Column) -> Column:
    return v["kind"]


def items_of(v: Column) -> Column:
    return v["items"]


def is_text_gap(s: Column) -> Column:
    return F.when(F.rlike(s, F.lit(MAYBE_GAP)), F.lower(strip(s)).isin(*GAP_WORDS)).when(s.isNotNull(), False)


def is_gap(v: Column) -> Column:
    """For a value that is there: null, a marker, the duration's -1 or an empty list."""
    return F.coalesce(v["gap"], F.lit(False))


Note = Column | dict[str, Column]


def value(note: Note, name: str) -> Column:
    """The value of a field: of a map, or of columns that hold the fields' values (``looked_up``)."""
    return note[name] if isinstance(note, dict) else F.try_element_at(note, F.lit(name))


def has(note: Note, name: str) -> Column:
    return note[name].isNotNull() if isinstance(note, dict) else F.map_contains_key(note, name)


def looked_up(df: DataFrame, note: Column, names) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a column for each name's value, and these columns by name: a key is looked for once, however many tests ask for it."""
    made = {n: fresh_name(df, f"__value_{i}") for i, n in enumerate(names)}
    return df.withColumns({c: value(note, n) for n, c in made.items()}), {n: F.col(c) for n, c in made.items()}


def gap(note: Note, name: str) -> Column:
    """Whether the field is there and a gap."""
    return has(note, name) & is_gap(value(note, name))


def listed(names, test, label: str = "") -> Column:
    """The names for which test(name) holds, in order, behind a label. (``array_compact`` would do, but it and all below it isn't compiled.)"""
    return F.array_except(F.array(*[F.when(test(n), F.lit(label + n)) for n in names]), F.array(F.lit(None).cast("string")))


def none_of(names, test) -> Column:
    """Whether test(name) holds for none of the names; null doesn't hold."""
    return reduce(lambda a, b: a & b, (~F.coalesce(test(n), F.lit(False)) for n in names), F.lit(True))


def note_text(note: Column, without=()) -> Column:
    """Text of the note's strings and lists, gaps left out, a line for each."""

    def lines(e: Column) -> Column:
        v = e["value"]
        t = kind(v)
        none = F.array().cast("array<string>")
        skip = is_gap(v) | (e["key"].isin(*without) if without else F.lit(False))
        return F.when(skip, none).when(t == "STRING", F.array(text_of(v))).when(F.startswith(t, F.lit("ARRAY")), items_of(v)).otherwise(none)

    return F.array_join(F.flatten(F.transform(F.map_entries(note), lines)), "\n")


def key_values(c: Column) -> Column:
    """Lines ``key: value`` (also cut at ;) as a map; keys lower-case, the last of equal keys wins."""
    lines = F.filter(F.split(F.replace(c, F.lit(";"), F.lit("\n")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.lower(strip(F.substring_index(x, ":", 1))).alias("key"), strip(F.substr(x, F.instr(x, ":") + 1)).alias("value"))
    return last_wins(F.transform(lines, pair))


def rendered(note: Column, name: str) -> Column:
    """A field for readers: Yes or No, list items joined, the marker for what is absent or not recorded."""
    v = value(note, name)
    t, s = kind(v), text_of(v)
    marker = F.lit(GAP_MARKER)
    return (
        F.when(~has(note, name) | (t == "VOID"), marker)
        .when(t == "BOOLEAN", F.when(s == "true", "Yes").otherwise("No"))
        .when(F.startswith(t, F.lit("ARRAY")), F.when(v["empty"], marker).otherwise(F.array_join(items_of(v), "; ")))
        .when(s.isin("", GAP_MARKER, "-1") & (t != "STRING") | ((t == "STRING") & s.isin("", GAP_MARKER)), marker)
        .otherwise(s)
    )


def type_ok(v: Column, wanted: str) -> Column:
    """Whether a value, not a gap, has the type that the rules want. Unknown types are fine."""
    t, s = kind(v), text_of(v)
    if wanted == "string":
        return t == "STRING"
    if wanted == "integer":
        return (t == "BIGINT") & F.coalesce(s.try_cast("bigint").between(1, 1440), F.lit(False))
    if wanted == "boolean":
        return t == "BOOLEAN"
    if wanted == "array_of_strings":
        return t == "ARRAY<STRING>"
    if wanted == "date":
        return (t == "STRING") & F.rlike(s, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")) & F.try_to_date(s, "y-M-d").isNotNull()
    return F.lit(True)


def strict_reasons(note: Column, rules: Rules) -> Column:
    """Why a note is not valid under the strict model; empty if it is."""
    out = []
    for name, wanted, required in rules.fields:
        v = value(note, name)
        t = kind(v)
        absent = ~has(note, name) | (t == "VOID")
        if required:
            out.append(F.when(absent, F.lit(f"{name}: missing")))
        out.append(F.when(~absent & ~type_ok(v, wanted), F.lit(f"{name}: type")))
        if wanted == "string":
            out.append(F.when(~absent & (t == "STRING") & (strip(text_of(v)) == ""), F.lit(f"{name}: blank")))
        if wanted == "array_of_strings":
            out.append(F.when(~absent & v["empty"], F.lit(f"{name}: blank")))
        if name in rules.options:
            out.append(F.when(~absent & (t == "STRING") & ~text_of(v).isin(*rules.options[name]), F.lit(f"{name}: option")))
    extra = F.transform(F.array_except(F.map_keys(note), F.array(*map(F.lit, rules.names))), lambda k: F.concat(k, F.lit(": unknown")))
    return F.concat(F.array_compact(F.array(*out)), extra)
