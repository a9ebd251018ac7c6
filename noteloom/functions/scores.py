"""Scores of a note: structure, faithfulness, register, billable evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteloom.functions.notes import Note, gap, has, is_gap, kind, listed, none_of, note_text, strip, text_of, type_ok, value
from noteloom.rules import FILLERS, FIRST_PERSON, GAP_STRATA, GROUNDED, Rules

FIRST_PERSON_WORDS = rf"(?iU)\b(?:{'|'.join(FIRST_PERSON)})\b"
FILLER_WORDS = rf"(?iU)\b(?:{'|'.join(FILLERS)})\b"


def missing(note: Note, rules: Rules) -> Column:
    return listed(rules.required, lambda f: ~has(note, f))


def gaps(note: Note, rules: Rules) -> Column:
    return listed(rules.required, lambda f: gap(note, f))


def present_ok(note: Note, stratum: Column, rules: Rules) -> Column:
    return none_of(rules.required, lambda f: ~has(note, f)) & (F.coalesce(stratum.isin(*GAP_STRATA), F.lit(False)) | none_of(rules.required, lambda f: gap(note, f)))


def order_ok(note: Column, rules: Rules) -> Column:
    order, keys = F.array(*map(F.lit, rules.order)), F.map_keys(note)
    return F.array_intersect(keys, order) == F.array_intersect(order, keys)


def _mistyped(note: Note, rules: Rules):
    kinds = {f[0]: f[1] for f in rules.fields}
    return lambda f: has(note, f) & ~is_gap(value(note, f)) & ~type_ok(value(note, f), kinds[f])


def invalid(note: Note, rules: Rules) -> Column:
    return listed(rules.names, _mistyped(note, rules))


def types_ok(note: Note, rules: Rules) -> Column:
    return none_of(rules.names, _mistyped(note, rules))


def ungrounded_fields(source: Column, note: Note, label: str = "") -> Column:
    """Structured facts that the source text doesn't hold."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return listed(GROUNDED, lambda f: has(note, f) & ~is_gap(value(note, f)) & ~F.contains(low, F.lower(text_of(value(note, f)))), label)


def ungrounded_numbers(source: Column, text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\d{2,}"), 0))
    return F.sort_array(F.filter(found, lambda n: ~F.contains(F.coalesce(source, F.lit("")), n)))


def ungrounded_ids(source: Column, text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?iU)(?:PRT|WKR)[-\w]*"), 0))
    return F.sort_array(F.filter(found, lambda n: ~F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lower(n))))


def findings(source: Column, note: Note, prose: Column | None = None) -> Column:
    """What the source doesn't hold. ``prose`` must be given if the note is looked up."""
    prose = note_text(note, GROUNDED) if prose is None else prose
    label = lambda what: lambda x: F.concat(F.lit(f"{what} "), x)
    return F.concat(
        ungrounded_fields(source, note, "field "),
        F.transform(ungrounded_numbers(source, prose), label("number")),
        F.transform(ungrounded_ids(source, prose), label("identifier")),
    )


def register_checks(text: Column) -> list[Column]:
    return [
        ~F.rlike(text, F.lit(FIRST_PERSON_WORDS)),
        ~F.rlike(text, F.lit(FILLER_WORDS)),
        F.rlike(text, F.lit(r"^\p{Lu}")) & F.endswith(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit(".")),
        F.regexp_count(text, F.lit(r"(?U)\S+")) >= 8,
    ]


def register_score(text: Column) -> Column:
    """A quarter for each: no first person, no fillers, a sentence, eight words."""
    return sum((c.cast("int") for c in register_checks(text)), F.lit(0)) / F.lit(4.0)


def narrative(note: Note) -> Column:
    v = value(note, "narrative_summary")
    return F.when(has(note, "narrative_summary"), F.coalesce(F.when(kind(v) == "VOID", "None").otherwise(text_of(v)), F.lit(""))).otherwise("")


def billable(note: Note) -> Column:
    v = value(note, "billable_evidence")
    return F.coalesce(has(note, "billable_evidence") & ~is_gap(v) & (F.regexp_count(text_of(v), F.lit(r"(?U)\S+")) >= 4), F.lit(False))


def rate(c: Column) -> Column:
    """The share that holds; 1 of none."""
    return F.coalesce(F.avg(c.cast("int")), F.lit(1.0))


def blank(c: Column) -> Column:
    return strip(c) == ""
