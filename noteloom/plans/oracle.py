"""The same semantics in DuckDB's SQL, piece by piece, for the queries' oracles."""

from __future__ import annotations

from noteloom.plans.fixture import DUCK_NOTES
from noteloom.rules import FIELDS, GAP_WORDS, GROUNDED, NAME_CUES, NOT_SCANNED, SERVICE_TYPES, TITLES

NAMES = [f[0] for f in FIELDS]
REQUIRED = [f[0] for f in FIELDS if f[2]]
KINDS = {f[0]: f[1] for f in FIELDS}


def words(xs) -> str:
    return ", ".join("'" + x + "'" for x in xs)


def strip(s: str) -> str:
    return rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"


THINK = "regexp_replace(draft, '<think>.*?</think>', '', 'gs')"
FENCE = f"CASE WHEN starts_with(t, '```') THEN array_to_string(list_filter(string_split(t, chr(10))[2:], lambda x: NOT starts_with({strip('x')}, '```')), chr(10)) ELSE t END"
FIRST, LAST = "position('{' IN u)", "(length(u) - position('}' IN reverse(u)) + 1)"
BRACE = f"CASE WHEN {FIRST} > 0 AND position('}}' IN u) > 0 AND {LAST} > {FIRST} THEN substr(u, {FIRST}, {LAST} - {FIRST} + 1) END"


def gap_of(kind: str, text: str, length: str) -> str:
    return f"coalesce({kind} = 'NULL' OR ({kind} = 'VARCHAR' AND lower({strip(text)}) IN ({words(GAP_WORDS)})) OR ({kind} IN ('BIGINT', 'UBIGINT') AND {text} = '-1') OR ({kind} = 'ARRAY' AND {length} = 0), false)"


def y(f: str) -> str:
    return f"json_type(j, '$.{f}')"


def s(f: str) -> str:
    return f"json_extract_string(j, '$.{f}')"


def there(f: str) -> str:
    return f"({y(f)} IS NOT NULL)"


def gap(f: str) -> str:
    return gap_of(y(f), s(f), f"json_array_length(j, '$.{f}')")


def listed(names, test) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test(n)} THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"


def joined(xs: str, sep: str = ",") -> str:
    return f"coalesce(array_to_string({xs}, '{sep}'), '')"


def type_ok(f: str) -> str:
    return {
        "string": f"{y(f)} = 'VARCHAR'",
        "integer": f"({y(f)} IN ('UBIGINT', 'BIGINT') AND try_cast({s(f)} AS bigint) BETWEEN 1 AND 1440)",
        "boolean": f"{y(f)} = 'BOOLEAN'",
        "array_of_strings": f"({y(f)} = 'ARRAY' AND json_array_length(j, '$.{f}') > 0 AND len(list_filter(json_extract(j, '$.{f}[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0)",
        "date": rf"({y(f)} = 'VARCHAR' AND regexp_matches({s(f)}, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}$') AND try_cast({s(f)} AS date) IS NOT NULL)",
    }[KINDS[f]]


def text_without(names) -> str:
    p = "'$.' || f"
    k, t = f"json_type(j, {p})", f"json_extract_string(j, {p})"
    g = gap_of(k, t, f"json_array_length(j, {p})")
    keys = f"list_filter(json_keys(j), lambda f: f NOT IN ({words(names)}))" if names else "json_keys(j)"
    item = f"CASE WHEN {g} THEN []::varchar[] WHEN {k} = 'VARCHAR' THEN [{t}] WHEN {k} = 'ARRAY' THEN json_extract(j, {p})::varchar[] ELSE []::varchar[] END"
    return f"coalesce(array_to_string(flatten(list_transform({keys}, lambda f: {item})), chr(10)), '')"


EMAIL = r"(?i)\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
IDNO = r"(?i)NDIS[-\s]?\d{6,}"
WIDE = r"\b(?:\+?61[ -]?|\(0\d\)\s?|0)\d(?:[ -]?\d){7,9}\b"
PHONE = r"\b(?:\+?61[ -]?|0)\d(?:[ -]?\d){7,9}\b"
DOB = r"\b(?:0?[1-9]|3[01])(?:0?[1-9]|1[0-2])[/\-](?:19|20)\d{2}\b"
POST = r"\b\d{4}\b"
STEPS = ((EMAIL, "[EMAIL]"), (IDNO, "[NDIS_NUM]"), (WIDE, "[PHONE]"), (DOB, "[DOB]"), (POST, "[POSTCODE]"))
NAME = r"([A-Z][a-z]+(?:\s[A-Z][a-z]+){0,2})"
CUE = (rf"\b(?:{'|'.join(NAME_CUES)})\b[\s,'’.\-]*{NAME}").replace("'", "''")
TITLE = rf"\b(?:{'|'.join(TITLES)})\.?\s+{NAME}"


def deid(text: str) -> str:
    for p, label in STEPS:
        text = f"regexp_replace({text}, '{p}', '{label}', 'g')"
    return text


def deid_types(text: str) -> str:
    out = []
    for p, label in STEPS:
        out.append(f"CASE WHEN regexp_matches({text}, '{p}') THEN '{label}' END")
        text = f"regexp_replace({text}, '{p}', '{label}', 'g')"
    return "list_filter([" + ", ".join(out) + "], lambda x: x IS NOT NULL)"


def once(xs: str) -> str:
    """Distinct items of a list as they first come."""
    return f"list_filter({xs}, lambda x, i: list_position({xs}, x) = i)"


FOUND = f"list_transform(list_concat(regexp_extract_all(input, '{CUE}', 1), regexp_extract_all(input, '{TITLE}', 1)), lambda x: {strip('x')})"
#: Longest first, else as they come: sorted by 1000 - length and place, written in fixed width before the name.
NAMES_SQL = "list_transform(list_sort(list_transform(found, lambda x, i: printf('%04d%04d', 1000 - length(x), i) || x)), lambda x: substr(x, 9))"


def scrub(text: str) -> str:
    t = rf"list_reduce(list_prepend({text}, names), lambda acc, n: regexp_replace(acc, '\b' || regexp_escape(n) || '\b', '[redacted]', 'g'))"
    for p in (EMAIL, IDNO, WIDE):
        t = f"regexp_replace({t}, '{p}', '[redacted]', 'g')"
    return t


LEAKS = once(
    "list_concat("
    + f"list_transform(regexp_extract_all(scan, '{PHONE}'), lambda m: 'PHONE:' || m), list_transform(regexp_extract_all(scan, '{EMAIL}'), lambda m: 'EMAIL:' || m), list_transform(regexp_extract_all(scan, '{IDNO}'), lambda m: 'NDIS_NUMBER:' || m), "
    + "list_transform(list_filter(forbidden_list, lambda f: contains(lower(scan), lower(f))), lambda f: 'FORBIDDEN:' || f))"
)
U_FIELDS = listed(GROUNDED, lambda f: f"{there(f)} AND NOT {gap(f)} AND NOT contains(lower(input), lower({s(f)}))")
U_NUMBERS = r"list_sort(list_filter(list_distinct(regexp_extract_all(prose, '\d{2,}')), lambda x: NOT contains(input, x)))"
U_IDS = r"list_sort(list_filter(list_distinct(regexp_extract_all(prose, '(?i)(?:PRT|WKR)[-\w]*')), lambda x: NOT contains(lower(input), lower(x))))"
EDGE = r"[^\p{L}\p{N}\p{M}_]"


def register_checks(t: str) -> list[str]:
    first = rf"(?i)(^|{EDGE})(i|we|my|our|me|us)($|{EDGE})"
    filler = rf"(?i)(^|{EDGE})((um+|uh+|yeah|gonna|wanna|kinda|okay so|right so)($|{EDGE})|(like,|so,)[\p{{L}}\p{{N}}\p{{M}}_])"
    return [
        f"NOT regexp_matches({t}, '{first}')",
        f"NOT regexp_matches({t}, '{filler}')",
        rf"(regexp_matches({t}, '^\p{{Lu}}') AND regexp_matches({t}, '\.\s*$'))",
        rf"len(regexp_extract_all({t}, '\S+')) >= 8",
    ]


def register_score(t: str) -> str:
    return "((" + " + ".join(f"({c})::int" for c in register_checks(t)) + ") / 4.0::double)"


ORDERED = f"coalesce(list_filter(json_keys(j), lambda f: f IN ({words(NAMES)})) = list_filter([{words(NAMES)}], lambda f: list_contains(json_keys(j), f)), true)"
STRICT = (
    "list_filter(["
    + ", ".join(
        x
        for f in NAMES
        for x in [
            *([f"CASE WHEN coalesce({y(f)}, 'NULL') = 'NULL' THEN '{f}: missing' END"] if f in REQUIRED else []),
            f"CASE WHEN coalesce({y(f)}, 'NULL') <> 'NULL' AND NOT coalesce({type_ok(f) if KINDS[f] != 'array_of_strings' else type_ok(f)}, false) THEN '{f}: type' END",
            *([f"CASE WHEN {y(f)} = 'VARCHAR' AND {strip(s(f))} = '' THEN '{f}: blank' END"] if KINDS[f] == "string" else []),
            *([f"CASE WHEN {y(f)} = 'ARRAY' AND json_array_length(j, '$.{f}') = 0 THEN '{f}: blank' END"] if KINDS[f] == "array_of_strings" else []),
            *([f"CASE WHEN {y(f)} = 'VARCHAR' AND {s(f)} NOT IN ({words(SERVICE_TYPES)}) THEN '{f}: option' END"] if f == "service_type" else []),
        ]
    )
    + f"], lambda x: x IS NOT NULL) || coalesce(list_transform(list_filter(json_keys(j), lambda f: f NOT IN ({words(NAMES)})), lambda f: f || ': unknown'), [])"
)

def notes_ctes(source: str = DUCK_NOTES) -> str:
    return f"""
    n AS ({source}),
    p1 AS (SELECT *, {strip(THINK)} AS t FROM n),
    p2 AS (SELECT *, {FENCE} AS u FROM p1),
    p3 AS (SELECT *, {BRACE} AS w FROM p2),
    p AS (SELECT k, id, stratum, input, forbidden, draft, CASE WHEN json_valid(w) THEN w::json END AS j,
                 list_filter(string_split(forbidden, '|'), lambda x: x <> '') AS forbidden_list FROM p3)
"""


def score_ctes(source: str = DUCK_NOTES) -> str:
    return f"""{notes_ctes(source)},
    q0 AS (SELECT *, {text_without(NOT_SCANNED)} AS scan, {text_without(GROUNDED)} AS prose,
                  CASE WHEN {y('narrative_summary')} = 'NULL' THEN 'None' ELSE coalesce({s('narrative_summary')}, '') END AS narrative FROM p),
    q1 AS (SELECT *, {listed(REQUIRED, lambda f: f'NOT {there(f)}')} AS missing, {listed(REQUIRED, lambda f: f'{there(f)} AND {gap(f)}')} AS gaps,
                  {ORDERED} AS order_ok, {listed(NAMES, lambda f: f'{there(f)} AND NOT {gap(f)} AND NOT coalesce({type_ok(f)}, false)')} AS invalid,
                  {LEAKS} AS leaks, {U_FIELDS} AS u_fields, {U_NUMBERS} AS u_numbers, {U_IDS} AS u_ids, {register_score('narrative')} AS register_score,
                  coalesce({there('billable_evidence')} AND NOT {gap('billable_evidence')} AND len(regexp_extract_all({s('billable_evidence')}, '\\S+')) >= 4, false) AS billable FROM q0),
    q2 AS (SELECT *, len(missing) = 0 AND (stratum IN ('sparse_input', 'adv_missing_field') OR len(gaps) = 0) AS present_ok, len(invalid) = 0 AS types_ok,
                  coalesce(len(leaks), 0) = 0 AS pii_clean, len(u_fields) + len(u_numbers) + len(u_ids) = 0 AS faithful, register_score >= 0.75 AS register,
                  list_concat(list_transform(u_fields, lambda x: 'field ' || x), list_transform(u_numbers, lambda x: 'number ' || x), list_transform(u_ids, lambda x: 'identifier ' || x)) AS findings FROM q1),
    q AS (SELECT *, present_ok AND order_ok AND types_ok AS structural, (present_ok::int + order_ok::int + types_ok::int) / 3.0::double AS structure_score,
                 present_ok AND order_ok AND types_ok AND pii_clean AND faithful AND register AS passed FROM q2)
"""


def over_notes(select: str, source: str = DUCK_NOTES) -> str:
    return f"WITH {notes_ctes(source)} {select}"


def over_scores(select: str, source: str = DUCK_NOTES) -> str:
    return f"WITH {score_ctes(source)} {select}"
