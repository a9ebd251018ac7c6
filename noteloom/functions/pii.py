"""Finding and redacting personal data, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.notes import kind, note_text, strip, text_of
from noteloom.rules import BIRTH_DATE, EMAIL, ID_NUMBER, NAME_CUES, NOT_SCANNED, NOT_SCRUBBED, PHONE, PHONE_WIDE, POSTCODE, REDACTED, TITLES

#: In this order, each on the text that the ones before it have left.
STEPS = ((EMAIL, "[EMAIL]"), (ID_NUMBER, "[NDIS_NUM]"), (PHONE_WIDE, "[PHONE]"), (BIRTH_DATE, "[DOB]"), (POSTCODE, "[POSTCODE]"))
SCORED = ((PHONE, "PHONE"), (EMAIL, "EMAIL"), (ID_NUMBER, "NDIS_NUMBER"))
NAME = r"([A-Z][a-z]+(?:\s[A-Z][a-z]+){0,2})"
CUE_NAME = rf"(?U)\b(?:{'|'.join(NAME_CUES)})\b[\s,'’.\-]*{NAME}"
TITLE_NAME = rf"(?U)\b(?:{'|'.join(TITLES)})\.?\s+{NAME}"


#: What every match of a pattern holds, far quicker to look for than the pattern.
HELD = {EMAIL: lambda c: F.contains(c, F.lit("@"))} | dict.fromkeys((PHONE, PHONE_WIDE), lambda c: F.rlike(c, F.lit(r"(?U)\d(?:[ -]?\d){7}"))) | {ID_NUMBER: lambda c: F.rlike(c, F.lit(r"(?U)\d{6}"))}


def may_match(c: Column, pattern: str) -> Column:
    """Whether a text holds what a match of the pattern would hold; null of null."""
    return HELD[pattern](c)


def deidentify(c: Column) -> Column:
    for pattern, label in STEPS:
        c = F.regexp_replace(c, pattern, label)
    return c


def deidentified_types(c: Column) -> Column:
    """The labels of the patterns that hit at their turn, in order."""
    hits = []
    for pattern, label in STEPS:
        hits.append(F.when(F.rlike(c, F.lit(pattern)), F.lit(label)))
        c = F.regexp_replace(c, pattern, label)
    return F.array_compact(F.array(*hits))


def kinds(labels: Column) -> Column:
    """Labels without their brackets: EMAIL, NDIS_NUM, ..."""
    return F.transform(labels, lambda x: F.regexp_replace(x, r"[\[\]]", ""))


def detected_types(c: Column) -> Column:
    """The kinds of personal data that :func:`deidentify` replaces, in order."""
    return kinds(deidentified_types(c))


def with_deidentified(df: DataFrame, column: str, text: str = "text", labels: str = "labels") -> DataFrame:
    """``df`` with what :func:`deidentify` makes of a column, and the labels that it wrote; each replacement is made once."""
    last, hits = F.col(column), []
    for i, (pattern, label) in enumerate(STEPS):
        df = df.withColumn(f"__deid{i}", F.struct(F.rlike(last, F.lit(pattern)).alias("hit"), F.regexp_replace(last, pattern, label).alias("text")))
        last = F.col(f"__deid{i}.text")
        hits.append(F.when(F.col(f"__deid{i}.hit"), F.lit(label)))
    return df.withColumns({text: last, labels: F.array_compact(F.array(*hits))}).drop(*[f"__deid{i}" for i in range(len(STEPS))])


def contact_names(c: Column) -> Column:
    """Names behind a cue or title, once each, the longest first and otherwise as they come."""
    found = F.concat(F.regexp_extract_all(c, F.lit(CUE_NAME), 1), F.regexp_extract_all(c, F.lit(TITLE_NAME), 1))
    names = F.array_distinct(F.transform(found, strip))
    placed = F.transform(names, lambda n, i: F.struct((-F.length(n)).alias("long"), i.alias("at"), n.alias("name")))
    return F.transform(F.array_sort(placed), lambda x: x["name"])


def scrub(c: Column, names: Column) -> Column:
    """Names, then patterns, replaced by the mark of redaction."""
    word = lambda n: F.concat(F.lit(r"(?U)\b\Q"), n, F.lit(r"\E\b"))
    c = F.aggregate(names, c, lambda text, n: F.when(F.contains(text, n), F.regexp_replace(text, word(n), F.lit(REDACTED))).otherwise(text))
    for pattern in (EMAIL, ID_NUMBER, PHONE_WIDE):
        # an own name for each text: an expression that is named twice is made twice where it isn't compiled
        c = F.element_at(F.transform(F.array(c), lambda x: F.when(may_match(x, pattern), F.regexp_replace(x, pattern, REDACTED)).otherwise(x)), 1)  # noqa: B023
    return c


def scrub_note(note: Column, names: Column) -> Column:
    """The note as map<string,variant>, its strings and the strings of its lists scrubbed, but for the fields left alone."""
    text = lambda x: F.try_variant_get(x, "$", "string")
    item = lambda x: F.when(F.schema_of_variant(x) == "STRING", scrub(text(x), names).cast("variant")).otherwise(x)

    def clean(k: Column, v: Column) -> Column:
        whole = F.to_variant_object(F.transform(F.try_variant_get(v["raw"], "$", "array<variant>"), item))
        return F.when(k.isin(*NOT_SCRUBBED), v["raw"]).when(kind(v) == "STRING", scrub(text_of(v), names).cast("variant")).when(F.startswith(kind(v), F.lit("ARRAY")), whole).otherwise(v["raw"])

    return F.transform_values(note, clean)


def changed_fields(note: Column, clean: Column) -> Column:
    return F.filter(F.map_keys(note), lambda k: F.to_json(F.try_element_at(note, k)["raw"]) != F.to_json(F.try_element_at(clean, k)))


def leaks(note: Column, forbidden: Column) -> Column:
    return leaks_in(note_text(note, NOT_SCANNED), forbidden)


def leaks_in(text: Column, forbidden: Column) -> Column:
    """LABEL:match for each pattern's matches, then FORBIDDEN:x for each forbidden string held, once each."""
    label = lambda name: lambda m: F.concat(F.lit(f"{name}:"), m)
    none = F.array().cast("array<string>")
    found = [F.when(may_match(text, p), F.transform(F.regexp_extract_all(text, F.lit(p), 0), label(name))).otherwise(none) for p, name in SCORED]
    held = F.filter(F.coalesce(forbidden, F.array().cast("array<string>")), lambda f: (f != "") & F.contains(F.lower(text), F.lower(f)))
    return F.array_distinct(F.concat(*found, F.transform(held, lambda f: F.concat(F.lit("FORBIDDEN:"), f))))
