"""The queries over the driver's tables, and the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import notes as N
from noteloom.functions import pii as P
from noteloom.functions import scores as S
from noteloom.operators import drafting, judging, rows, synthesis
from noteloom.operators.chat import to_chat
from noteloom.plans import oracle as O
from noteloom.plans import scoring as C
from noteloom.plans.fixture import DUCK_NOTES, notes, spread, table
from noteloom.rules import FIELDS, GATES, PLAN, STRATA, SUITES, load_rules
from noteloom.runtime import Scratch
from noteloom.sources.jsonl import read_jsonl, write_jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RULES = load_rules()
NAMES = [f[0] for f in FIELDS]


def query(sql: str | None = None):
    """Registers a function by its name, with the SQL it must match."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def join(c, sep: str = ","):
    return F.array_join(c, sep)


def of_notes(column: Callable[[], dict], sql: str):
    """A query of one projection of the parsed notes. The SQL gives the same columns from the CTE that it reads."""

    def register(name: str) -> None:
        QUERIES[name] = lambda spark, sf_dir: C.parsed(notes(spark, sf_dir)).select("id", *[c.alias(n) for n, c in column().items()])
        ORACLE_SQL[name] = sql

    return register


# --- sources and parsing -------------------------------------------------------------------------


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def src_jsonl(spark, sf_dir):
    """Documents written as JSON lines and read again."""
    docs = table(spark, sf_dir, "documents")
    to = Scratch(spark, "jsonl").path + "/documents"
    write_jsonl(docs, to)
    return read_jsonl(spark, to, docs.schema)


@query(f"WITH n AS ({DUCK_NOTES}) SELECT id, {O.THINK} AS text FROM n")
def parse_think(spark, sf_dir):
    return notes(spark, sf_dir).select("id", N.drop_think(F.col("draft")).alias("text"))


@query(f"WITH n AS ({DUCK_NOTES}), p1 AS (SELECT id, draft AS t FROM n) SELECT id, {O.FENCE} AS text FROM p1")
def parse_fence(spark, sf_dir):
    return notes(spark, sf_dir).select("id", N.drop_fence(F.col("draft")).alias("text"))


@query(f"WITH n AS ({DUCK_NOTES}), p1 AS (SELECT id, draft AS u FROM n) SELECT id, {O.BRACE} AS text FROM p1")
def parse_brace(spark, sf_dir):
    return notes(spark, sf_dir).select("id", N.brace_slice(F.col("draft")).alias("text"))


of_notes(lambda: {"n_keys": F.size(F.col("note")), "keys": join(F.map_keys(F.col("note")))}, O.over_notes(f"SELECT id, coalesce(len(json_keys(j)), 0)::int AS n_keys, {O.joined('json_keys(j)')} AS keys FROM p"))("parse_json_note")


def _kv(key: str) -> str:
    """The value of the last line with a key, in SQL."""
    lines = "list_filter(string_split(replace(input, ';', chr(10)), chr(10)), lambda x: contains(x, ':'))"
    mine = f"list_filter({lines}, lambda x: lower({O.strip('split_part(x, chr(58), 1)')}) = '{key}')"
    return f"list_transform({mine}, lambda x: {O.strip('substr(x, position(chr(58) IN x) + 1)')})[-1]"


KEYS = ("worker", "date", "participant", "type", "location", "note", "nothing")


@query(f"WITH n AS ({DUCK_NOTES}) SELECT id, {', '.join(f'{_kv(k)} AS {k}_line' for k in KEYS)} FROM n")
def kv_parse(spark, sf_dir):
    return N.once(notes(spark, sf_dir), kv=N.key_values(F.col("input"))).select("id", *[F.try_element_at("kv", F.lit(k)).alias(f"{k}_line") for k in KEYS])


of_notes(lambda: {"reasons": join(N.strict_reasons(F.col("note"), RULES), "; "), "valid": F.size(N.strict_reasons(F.col("note"), RULES)) == 0}, O.over_notes(f"SELECT id, {O.joined(O.STRICT, '; ')} AS reasons, len({O.STRICT}) = 0 AS valid FROM p"))("strict_valid")

# --- gaps and text -------------------------------------------------------------------------------

of_notes(lambda: {"gaps": join(N.listed(NAMES, lambda f: N.gap(F.col("note"), f)))}, O.over_notes(f"SELECT id, {O.joined(O.listed(NAMES, lambda f: f'{O.there(f)} AND {O.gap(f)}'))} AS gaps FROM p"))("gap_flags")
of_notes(lambda: {"text": N.note_text(F.col("note"))}, O.over_notes(f"SELECT id, {O.text_without(())} AS text FROM p"))("note_text")


def _rendered(f: str) -> str:
    y, s = O.y(f), O.s(f)
    return f"""CASE WHEN {y} IS NULL OR {y} = 'NULL' THEN '[not recorded]' WHEN {y} = 'BOOLEAN' THEN CASE WHEN {s} = 'true' THEN 'Yes' ELSE 'No' END
        WHEN {y} = 'ARRAY' THEN CASE WHEN json_array_length(j, '$.{f}') = 0 THEN '[not recorded]' ELSE array_to_string(json_extract_string(j, '$.{f}[*]'), '; ') END
        WHEN ({y} <> 'VARCHAR' AND {s} = '-1') OR {s} IN ('', '[not recorded]') THEN '[not recorded]' ELSE {s} END"""


of_notes(lambda: {"text": F.concat_ws("\n", *[F.concat(F.lit(f"{f}: "), N.rendered(F.col("note"), f)) for f in NAMES])}, O.over_notes("SELECT id, " + " || chr(10) || ".join(f"'{f}: ' || {_rendered(f)}" for f in NAMES) + " AS text FROM p"))("note_render")

# --- personal data -------------------------------------------------------------------------------


def _texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("text"))
    return docs.unionByName(notes(spark, sf_dir).select("id", F.col("input").alias("text")))


TEXTS = f"WITH t AS (SELECT 'doc-' || doc_id::varchar AS id, text FROM documents UNION ALL SELECT id, input AS text FROM ({DUCK_NOTES}) x)"


@query(f"{TEXTS} SELECT id, {O.deid('text')} AS text FROM t")
def deid_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", P.deidentify(F.col("text")).alias("text"))


@query(f"{TEXTS} SELECT id, {O.joined(O.deid_types('text'))} AS types FROM t")
def deid_types(spark, sf_dir):
    return P.with_deidentified(_texts(spark, sf_dir), "text", "clean", "labels").select("id", join(F.col("labels")).alias("types"))


# written out by hand: what each pattern finds in what the ones before it leave
KINDS = """
    WITH t AS (SELECT 'doc-' || doc_id::varchar AS id, text FROM documents UNION ALL SELECT id, input AS text FROM (NOTES) x),
    a AS (SELECT id, text AS t0, regexp_replace(text, '(?i)\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b', '[EMAIL]', 'g') AS t1 FROM t),
    b AS (SELECT *, regexp_replace(t1, '(?i)NDIS[-\\s]?\\d{6,}', '[NDIS_NUM]', 'g') AS t2 FROM a),
    c AS (SELECT *, regexp_replace(t2, '\\b(?:\\+?61[ -]?|\\(0\\d\\)\\s?|0)\\d(?:[ -]?\\d){7,9}\\b', '[PHONE]', 'g') AS t3 FROM b),
    d AS (SELECT *, regexp_replace(t3, '\\b(?:0?[1-9]|3[01])(?:0?[1-9]|1[0-2])[/\\-](?:19|20)\\d{2}\\b', '[DOB]', 'g') AS t4 FROM c),
    e AS (SELECT *, regexp_replace(t4, '\\b\\d{4}\\b', '[POSTCODE]', 'g') AS t5 FROM d)
    SELECT id, concat_ws(',', CASE WHEN t1 <> t0 THEN 'EMAIL' END, CASE WHEN t2 <> t1 THEN 'NDIS_NUM' END, CASE WHEN t3 <> t2 THEN 'PHONE' END, CASE WHEN t4 <> t3 THEN 'DOB' END, CASE WHEN t5 <> t4 THEN 'POSTCODE' END) AS kinds FROM e
"""


@query(KINDS.replace("NOTES", DUCK_NOTES).replace("\\\\", "\\"))
def deid_kinds(spark, sf_dir):
    """The kinds of personal data found, by name."""
    return P.with_deidentified(_texts(spark, sf_dir), "text", "clean", "labels").select("id", join(P.kinds(F.col("labels"))).alias("kinds"))


FOUND = f"n AS ({DUCK_NOTES}), f1 AS (SELECT *, {O.FOUND} AS many FROM n), f2 AS (SELECT *, {O.once('many')} AS found FROM f1), f AS (SELECT *, {O.NAMES_SQL} AS names FROM f2)"


@query(f"WITH {FOUND} SELECT id, {O.joined('names', '|')} AS names FROM f")
def contact_names(spark, sf_dir):
    return notes(spark, sf_dir).select("id", join(P.contact_names(F.col("input")), "|").alias("names"))


@query(f"WITH {FOUND} SELECT id, {O.scrub('input')} AS text, {O.scrub('input')} <> input AS changed FROM f")
def guard_scrub(spark, sf_dir):
    df = N.once(notes(spark, sf_dir), names=P.contact_names(F.col("input")))
    df = N.once(df, text=P.scrub(F.col("input"), F.col("names")))
    return df.select("id", "text", (F.col("text") != F.col("input")).alias("changed"))


def _guarded(f: str) -> str:
    y, s = O.y(f), O.s(f)
    return f"CASE WHEN {y} = 'VARCHAR' THEN {O.scrub(s)} WHEN {y} = 'ARRAY' THEN array_to_string(list_transform(json_extract_string(j, '$.{f}[*]'), lambda x: {O.scrub('x')}), '; ') ELSE {s} END"


SHOWN = ("participant_id", "narrative_summary", "outcomes_achieved", "date_of_service", "duration_minutes")


def _guarded_notes(spark, sf_dir):
    """Notes with their guarded form, ``clean``. Names are found once for a note, not again for each of its values."""
    named = N.once(notes(spark, sf_dir), names=P.contact_names(F.col("input")))
    return N.once(C.parsed(named), clean=P.scrub_note(F.col("note"), F.col("names")))


@query(
    "WITH "
    + FOUND.replace("n AS (", "n0 AS (", 1).replace("FROM n)", "FROM n0)", 1)
    + f", {O.notes_ctes()}, g AS (SELECT p.*, f.names FROM p JOIN f ON p.id = f.id) SELECT id, {', '.join(f'{_guarded(f) if f not in (chr(100) + "ate_of_service", "duration_minutes") else O.s(f)} AS {f}' for f in SHOWN)} FROM g"
)
def guard_note(spark, sf_dir):
    df = _guarded_notes(spark, sf_dir)

    def shown(f):
        v = N.typed(N.value(F.col("clean"), f))
        return F.when(F.startswith(N.kind(v), F.lit("ARRAY")), F.array_join(N.items_of(v), "; ")).otherwise(N.text_of(v)).alias(f)

    return df.select("id", *[shown(f) for f in SHOWN])


def _changed(f: str) -> str:
    y, s = O.y(f), O.s(f)
    items = f"json_extract_string(j, '$.{f}[*]')"
    return f"CASE WHEN {y} = 'VARCHAR' AND {O.scrub(s)} <> {s} THEN '{f}' WHEN {y} = 'ARRAY' AND len(list_filter({items}, lambda x: {O.scrub('x')} <> x)) > 0 THEN '{f}' END"


@query(
    "WITH "
    + FOUND.replace("n AS (", "n0 AS (", 1).replace("FROM n)", "FROM n0)", 1)
    + f", {O.notes_ctes()}, g AS (SELECT p.*, f.names FROM p JOIN f ON p.id = f.id) SELECT id, concat_ws(',', {', '.join(_changed(f) for f in NAMES if f not in ('date_of_service', 'duration_minutes', 'participant_present', 'follow_up_needed'))}) AS changed FROM g"
)
def guard_changed(spark, sf_dir):
    """Which fields the guard has changed."""
    df = _guarded_notes(spark, sf_dir)
    return df.select("id", join(P.changed_fields(F.col("note"), F.col("clean"))).alias("changed"))


def scores_of(name: str, columns: Callable[[], dict], sql: str) -> None:
    of_notes(columns, O.over_scores(f"SELECT id, {sql} FROM q"))(name)


PROSE = lambda: N.note_text(F.col("note"), O.GROUNDED)
scores_of("pii_score", lambda: {"leaks": join(P.leaks(F.col("note"), F.col("forbidden")), "; "), "clean": F.size(P.leaks(F.col("note"), F.col("forbidden"))) == 0}, f"{O.joined('leaks', '; ')} AS leaks, pii_clean AS clean")
scores_of("pii_forbidden", lambda: {"held": join(F.filter(P.leaks(F.col("note"), F.col("forbidden")), lambda x: F.startswith(x, F.lit("FORBIDDEN:"))), "; ")}, f"{O.joined('list_filter(leaks, lambda x: starts_with(x, chr(70) || chr(79) || chr(82)))', '; ')} AS held")

# --- structure -----------------------------------------------------------------------------------

scores_of("struct_missing", lambda: {"missing": join(S.missing(F.col("note"), RULES))}, f"{O.joined('missing')} AS missing")
scores_of("struct_gaps", lambda: {"gaps": join(S.gaps(F.col("note"), RULES))}, f"{O.joined('gaps')} AS gaps")
scores_of("struct_present", lambda: {"ok": S.present_ok(F.col("note"), F.col("stratum"), RULES)}, "present_ok AS ok")
scores_of("struct_order", lambda: {"ok": S.order_ok(F.col("note"), RULES)}, "order_ok AS ok")
scores_of("struct_types", lambda: {"invalid": join(S.invalid(F.col("note"), RULES))}, f"{O.joined('invalid')} AS invalid")


@query(O.over_scores("SELECT id, structural, round(structure_score, 6) AS score FROM q"))
def struct_pass(spark, sf_dir):
    return C.example_scores(notes(spark, sf_dir), wanted=("structural",)).select("id", "structural", F.round("structure_score", 6).alias("score"))


# --- judged scores -------------------------------------------------------------------------------

scores_of("faith_fields", lambda: {"found": join(S.ungrounded_fields(F.col("input"), F.col("note")))}, f"{O.joined('u_fields')} AS found")
scores_of("faith_numbers", lambda: {"found": join(S.ungrounded_numbers(F.col("input"), PROSE()))}, f"{O.joined('u_numbers')} AS found")
scores_of("faith_ids", lambda: {"found": join(S.ungrounded_ids(F.col("input"), PROSE()))}, f"{O.joined('u_ids')} AS found")
scores_of("faith_pass", lambda: {"faithful": F.size(S.findings(F.col("input"), F.col("note"))) == 0, "findings": join(S.findings(F.col("input"), F.col("note")), "; ")}, f"faithful, {O.joined('findings', '; ')} AS findings")
scores_of("register_score", lambda: {"score": S.register_score(S.narrative(F.col("note")))}, "register_score AS score")
scores_of("billable", lambda: {"billable": S.billable(F.col("note"))}, "billable")


@query(
    f"WITH d AS (SELECT coalesce(lang, '') AS lang, {O.register_score('text')} AS score FROM documents WHERE text IS NOT NULL) "
    "SELECT lang, count(*) AS n, round(avg(score), 6) AS score, round(avg((score >= 0.75)::int), 4) AS meets FROM d GROUP BY lang"
)
def register_by_stratum(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), S.register_score(F.col("text")).alias("score"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score"), F.round(S.rate(F.col("score") >= 0.75), 4).alias("meets"))


SCORE_COLUMNS = ("structural", "pii_clean", "faithful", "register", "billable", "passed")


@query(O.over_scores(f"SELECT id, stratum, {', '.join(SCORE_COLUMNS)} FROM q"))
def example_scores(spark, sf_dir):
    return C.example_scores(notes(spark, sf_dir)).select("id", "stratum", *SCORE_COLUMNS)


# --- aggregates and reports ----------------------------------------------------------------------

RATE = lambda c: f"coalesce(avg({c}::int), 1.0)"


@query(O.over_scores("SELECT count(*) AS n, " + ", ".join(f"round({RATE(c)}, 6) AS {c}" for c in C.RATES) + " FROM q"))
def overall_rates(spark, sf_dir):
    r = C.overall_rates(C.example_scores(notes(spark, sf_dir), wanted=C.RATES))
    return r.select("n", *[F.round(c, 6).alias(c) for c in C.RATES])


@query(O.over_scores("SELECT stratum, count(*) AS n, " + ", ".join(f"round({RATE(c)}, 4) AS {c}" for c in C.RATES) + f", round({RATE('passed')}, 4) AS overall_pass FROM q GROUP BY stratum"))
def per_stratum(spark, sf_dir):
    return C.per_stratum(C.example_scores(notes(spark, sf_dir)))


@query(O.over_scores("SELECT grouping(stratum)::int AS overall, stratum, count(*) AS n, " + ", ".join(f"round({RATE(c)}, 6) AS {c}" for c in C.RATES) + f", round({RATE('passed')}, 6) AS overall_pass FROM q GROUP BY ROLLUP (stratum)"))
def rates_rollup(spark, sf_dir):
    """Overall and per-stratum rates from one pass over the notes."""
    rolled = C.rates_rollup(C.example_scores(notes(spark, sf_dir)))
    return rolled.select("overall", "stratum", "n", *[F.round(c, 6).alias(c) for c in (*C.RATES, "overall_pass")])


# Every note is a case of one of the three suites.
SUITE = "CASE k % 3 WHEN 0 THEN 'fabrication' WHEN 1 THEN 'pii_leakage' ELSE 'missing_element' END"
FIELD = "CASE k % 4 WHEN 0 THEN 'duration_minutes' WHEN 1 THEN 'location' WHEN 2 THEN 'billable_evidence' ELSE 'follow_up_notes' END"
CASES = f"""
    s0 AS (SELECT *, {SUITE} AS suite, {FIELD} AS missing_field FROM q),
    s1 AS (SELECT *, json_type(j, '$.' || missing_field) AS m_kind, json_extract_string(j, '$.' || missing_field) AS m_text, json_array_length(j, '$.' || missing_field) AS m_length FROM s0),
    s2 AS (SELECT *, CASE suite WHEN 'fabrication' THEN CASE WHEN len(findings) > 0 THEN array_to_string(findings, '; ') END
                                WHEN 'pii_leakage' THEN CASE WHEN len(leaks) > 0 THEN array_to_string(leaks, '; ') END
                                ELSE CASE WHEN m_kind IS NULL THEN 'omitted' WHEN NOT {O.gap_of('m_kind', 'm_text', 'm_length')} THEN 'value invented: ' || m_text END END AS reason FROM s1),
    s3 AS (SELECT *, reason IS NULL AS passed_case FROM s2)
"""


def over_cases(select: str) -> str:
    return f"WITH {O.score_ctes()}, {CASES} {select}"


SUITE_RATES = f"SELECT v.suite, count(s3.id) AS total, coalesce(sum(passed_case::int), 0)::bigint AS passed, coalesce(avg(passed_case::int), 1.0) AS pass_rate FROM (VALUES {', '.join(f"('{s}')" for s in SUITES)}) v(suite) LEFT JOIN s3 ON s3.suite = v.suite GROUP BY v.suite"


GATE_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS place, '{name}' AS name, "
    + (f"(SELECT pass_rate FROM r WHERE suite = '{name[6:]}')" if name.startswith("suite_") else f"(SELECT {RATE(c)} FROM q)")
    + f" AS value, {target}::double AS threshold, {str(hard).lower()} AS hard"
    for i, (name, target, hard) in enumerate(GATES)
    for c in [{"structural_compliance": "structural", "professional_register": "register", "strata_faithfulness": "faithful", "strata_pii_clean": "pii_clean", "strata_billable_evidence": "billable"}.get(name, "")]
)


def over_gates(select: str) -> str:
    return f"WITH {O.score_ctes()}, {CASES}, r AS ({SUITE_RATES}), g AS ({GATE_ROWS}) {select}"


def _as_cases(spark, sf_dir):
    suite = F.element_at(F.array(*map(F.lit, SUITES)), (F.col("k") % 3 + 1).cast("int"))
    return notes(spark, sf_dir).withColumn("suite", suite).withColumn("missing_field", F.expr(FIELD))


def _cases(spark, sf_dir):
    return C.suite_cases(_as_cases(spark, sf_dir))


@query(over_cases("SELECT suite, id, passed_case AS passed FROM s3"))
def all_notes_suite_union(spark, sf_dir):
    return _cases(spark, sf_dir).select("suite", "id", "passed")


@query(over_cases("SELECT id, missing_field, passed_case AS passed, coalesce(reason, '') AS reason FROM s3 WHERE suite = 'missing_element'"))
def all_notes_missing_element(spark, sf_dir):
    return _cases(spark, sf_dir).filter("suite = 'missing_element'").select("id", "missing_field", "passed", F.coalesce("reason", F.lit("")).alias("reason"))


@query(over_cases("SELECT suite, id, reason FROM s3 WHERE NOT passed_case"))
def all_notes_suite_failures(spark, sf_dir):
    return _cases(spark, sf_dir).filter("NOT passed").select("suite", "id", "reason")


@query(over_cases(f"SELECT suite, total, passed, round(pass_rate, 6) AS pass_rate FROM ({SUITE_RATES}) r"))
def all_notes_suite_rates(spark, sf_dir):
    return C.suite_results(_cases(spark, sf_dir)).withColumn("pass_rate", F.round("pass_rate", 6))


def _gates(spark, sf_dir):
    return C.gate_rows(C.example_scores(_as_cases(spark, sf_dir), cases=True))


@query(over_gates("SELECT name, round(value, 4) AS value, threshold, hard, value >= threshold AS passed FROM g"))
def all_notes_gates(spark, sf_dir):
    return _gates(spark, sf_dir).select("name", F.round("value", 4).alias("value"), "threshold", "hard", "passed")


@query(over_gates("SELECT coalesce(bool_and(value >= threshold) FILTER (WHERE hard), true) AS release_ok FROM g"))
def all_notes_release_ok(spark, sf_dir):
    return C.release_ok(_gates(spark, sf_dir))


@query(
    "WITH a AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n, avg(value) AS m FROM events GROUP BY event_type) "
    "SELECT event_type, n, round(m, 3) AS mean, round(v[floor(0.5::double * (n - 1))::int + 1], 3) AS p50, round(v[floor(0.95::double * (n - 1))::int + 1], 3) AS p95, round(v[n], 3) AS max FROM a"
)
def latency_stats(spark, sf_dir):
    return C.latency_stats(table(spark, sf_dir, "events"), "value", "event_type")


JUDGED = "SELECT l.doc_id, l.quality = 1 AS human, length(d.text) >= 300 AND regexp_matches(d.text, '^\\p{Lu}') AND NOT contains(d.text, '!!') AS judge FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _judged(spark, sf_dir):
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    text = F.col("text")
    judge = (F.length(text) >= 300) & F.rlike(text, F.lit(r"^\p{Lu}")) & ~F.contains(text, F.lit("!!"))
    return both.select("doc_id", (F.col("quality") == 1).alias("human"), judge.alias("judge"))


@query(
    f"WITH r AS ({JUDGED}), a AS (SELECT count(*) AS n, {RATE('(human = judge)')} AS accuracy, avg(human::int) AS ph, avg(judge::int) AS pj FROM r) "
    "SELECT n, round(accuracy, 6) AS accuracy, round((accuracy - (ph * pj + (1 - ph) * (1 - pj))) / (1 - (ph * pj + (1 - ph) * (1 - pj))), 6) AS kappa, accuracy >= 0.9 AS trusted FROM a"
)
def judge_agreement(spark, sf_dir):
    a = C.agreement(_judged(spark, sf_dir))
    return a.select("n", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"), (F.col("accuracy") >= 0.9).alias("trusted"))


@query(f"SELECT * FROM ({JUDGED}) r WHERE human <> judge")
def judge_disagreements(spark, sf_dir):
    return _judged(spark, sf_dir).filter("human <> judge")


# Human labels of the notes: unfaithful where a number was made up, off register where a sentence is broken, and some slips.
HUMAN = "k % 7 <> 0 AND k % 101 <> 0 AS human_faithful, k % 23 <> 0 OR k % 103 = 0 AS human_register"


def _calibrated(spark, sf_dir):
    faithful, register = (x.rsplit(" AS ", 1)[0] for x in HUMAN.split(", "))
    labelled = notes(spark, sf_dir).withColumn("human_faithful", F.expr(faithful)).withColumn("human_register", F.expr(register))
    return drafting.heuristic_judge(labelled)


def _dimension(name: str, d: str) -> str:
    return f"SELECT '{name}' AS dimension, count(*) AS n, avg((human_{d} = {d})::int) AS accuracy, avg(human_{d}::int) AS ph, avg({d}::int) AS pj FROM l"


@query(
    O.over_scores(
        f"SELECT * FROM (WITH l AS (SELECT faithful, register, {HUMAN} FROM q), a AS ({_dimension('faithfulness', 'faithful')} UNION ALL {_dimension('register', 'register')}) "
        "SELECT dimension, n, round(accuracy, 6) AS accuracy, round((accuracy - (ph * pj + (1 - ph) * (1 - pj))) / (1 - (ph * pj + (1 - ph) * (1 - pj))), 6) AS kappa, min(accuracy) OVER () >= 0.9 AS trusted FROM a) x"
    )
)
def judge_calibration(spark, sf_dir):
    r = judging.calibration(_calibrated(spark, sf_dir))
    return r.select("dimension", "n", F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"), "trusted")


@query(O.over_scores(f"SELECT * FROM (WITH l AS (SELECT id, faithful, register, {HUMAN} FROM q) SELECT id, human_faithful = faithful AS faithful_agree, human_register = register AS register_agree FROM l) x WHERE NOT (faithful_agree AND register_agree)"))
def calibration_disagreements(spark, sf_dir):
    return judging.disagreements(_calibrated(spark, sf_dir)).select("id", "faithful_agree", "register_agree")


# A judge's replies by note: good ones, wrapped ones, and ones that must count against the note.
REPLIES = (
    '{"is_faithful": true, "fabricated_claims": [], "reasoning": "all there"}',
    '{"is_faithful": false, "fabricated_claims": ["45 minutes"]}',
    '<think>{"is_faithful": false}</think> {"is_faithful": true}',
    "```json\n{\"is_faithful\": \"yes\"}\n```",
    "it is faithful",
    '{"is_faithful": true',
    '{"fabricated_claims": []}',
    '{"is_faithful": null}',
    '{"is_faithful": "perhaps"}',
    '{"is_faithful": 1}',
    '{"is_faithful": 2}',
    '{"is_faithful": true, "fabricated_claims": "none"}',
    '{"is_faithful": true, "reasoning": 7}',
)


@query("SELECT o_orderkey AS k, o_orderkey % 13 IN (0, 2, 3, 9) AS faithful FROM orders")
def judge_verdicts(spark, sf_dir):
    reply = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("k") % len(REPLIES) + 1).cast("int"))
    replies = N.once(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), reply=reply)
    return replies.select("k", judging.verdict(F.col("reply"), "faithful").alias("faithful"))


@query("SELECT source AS stratum, greatest(1, round_even(200 / (SELECT count(DISTINCT source) FROM documents)::double, 0))::bigint AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def even_plan(spark, sf_dir):
    """About 200 records, as many for each source that the documents have."""
    return rows.even_plan_rows(table(spark, sf_dir, "documents"), "source", 200)


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 25")
def limit_head(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").orderBy("doc_id").limit(25)


# --- duplicates, splits, coverage ----------------------------------------------------------------

KEY = f"sha1(lower({O.strip('coalesce(text, chr(32))')}))"


@query(f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS r FROM documents) SELECT doc_id, lang, source, n_chars FROM d WHERE r = 1")
def dedup_first(spark, sf_dir):
    return rows.dedup_first(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "lang", "source", "n_chars")


@query(f"SELECT {KEY} AS key, min(doc_id) AS first, count(*) AS size FROM documents GROUP BY 1")
def dedup_groups(spark, sf_dir):
    return rows.dedup_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


SPLIT = """
    WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::varchar || ':42'), doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    s AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.15::double, 0)) WHEN n = 2 THEN 1 ELSE 0 END AS n_test, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.15::double, 0)) ELSE 0 END AS n_val FROM h),
    t AS (SELECT doc_id, lang, CASE WHEN place <= n_test THEN 'test' WHEN place <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM s)
"""


def _split(spark, sf_dir):
    return rows.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(f"{SPLIT} SELECT doc_id, lang, split FROM t")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "lang", "split")


@query(f"{SPLIT} SELECT lang, split, count(*) AS n FROM t GROUP BY lang, split")
def split_counts(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def stratum_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT v.stratum, count(d.doc_id) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')) v(stratum) LEFT JOIN documents d ON d.lang = v.stratum GROUP BY v.stratum")
def coverage(spark, sf_dir):
    return rows.coverage(table(spark, sf_dir, "documents"), "lang", ("en", "fr", "de", "es", "xx"))


@query("SELECT source AS stratum, greatest(1, round_even(count(*) * (300 / (SELECT count(*) FROM documents)::double), 0))::bigint AS n FROM documents GROUP BY source")
def plan_scale(spark, sf_dir):
    """About 300 records in the shares that the sources have among the documents."""
    docs = table(spark, sf_dir, "documents")
    return rows.plan_scale(docs.groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("n")), 300, docs.count())


REASON = "CASE WHEN NOT structural THEN 'structure: ' || array_to_string(list_filter([CASE WHEN len(missing) > 0 THEN 'missing=' || array_to_string(missing, '|') END, CASE WHEN len(gaps) > 0 THEN 'gaps=' || array_to_string(gaps, '|') END, CASE WHEN len(invalid) > 0 THEN 'types=' || array_to_string(invalid, '|') END, CASE WHEN NOT order_ok THEN 'order' END], lambda x: x IS NOT NULL), ', ') WHEN NOT pii_clean THEN 'pii: ' || array_to_string(leaks, '; ') WHEN NOT faithful THEN 'faithfulness: ' || array_to_string(findings[1:2], '; ') ELSE '' END"


@query(O.over_scores("SELECT id, stratum FROM q WHERE structural AND pii_clean AND faithful"))
def verify_filter(spark, sf_dir):
    return C.example_scores(notes(spark, sf_dir), wanted=("structural", "pii_clean", "faithful")).filter("structural AND pii_clean AND faithful").select("id", "stratum")


@query(O.over_scores(f"SELECT id, {REASON} AS reason FROM q"))
def verify_reasons(spark, sf_dir):
    df = C.parsed(notes(spark, sf_dir))
    missing, gaps_, invalid, order = S.missing(F.col("note"), RULES), S.gaps(F.col("note"), RULES), S.invalid(F.col("note"), RULES), S.order_ok(F.col("note"), RULES)
    said = lambda what, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{what}="), join(xs, "|")))
    structure = F.concat_ws(", ", said("missing", missing), said("gaps", gaps_), said("types", invalid), F.when(~order, "order"))
    fine = S.present_ok(F.col("note"), F.col("stratum"), RULES) & order & (F.size(invalid) == 0)
    leaks, found = P.leaks(F.col("note"), F.col("forbidden")), S.findings(F.col("input"), F.col("note"))
    reason = F.when(~fine, F.concat(F.lit("structure: "), structure)).when(F.size(leaks) > 0, F.concat(F.lit("pii: "), join(leaks, "; "))).when(F.size(found) > 0, F.concat(F.lit("faithfulness: "), join(F.slice(found, 1, 2), "; "))).otherwise("")
    return df.select("id", reason.alias("reason"))


# --- models, chat --------------------------------------------------------------------------------

TURNS = "SELECT conv_id, turn, text AS input, lead(text) OVER w AS reply, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"


@query(
    f"WITH t AS (SELECT * FROM ({TURNS}) x WHERE role = 'user' AND next_role = 'assistant'), last AS (SELECT input, arg_max(reply, (conv_id, turn)) AS draft FROM t GROUP BY input) "
    "SELECT c.conv_id, c.turn, coalesce(last.draft, '{}') AS draft FROM conversations c LEFT JOIN last ON c.text = last.input WHERE c.role <> 'assistant'"
)
def golden_lookup(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    nxt = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("draft"))
    pairs = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")).join(nxt, ["conv_id", "turn"])
    asked = conv.filter("role <> 'assistant'").select("conv_id", "turn", F.col("text").alias("input"))
    out = rows.lookup_last(asked, pairs, "input", "draft", ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.coalesce("draft", F.lit("{}")).alias("draft"))


@query(
    f"WITH t AS (SELECT * FROM ({TURNS}) x WHERE role = 'user' AND next_role = 'assistant'), last AS (SELECT input, arg_max(reply, (conv_id, turn)) AS draft FROM t GROUP BY input) "
    "SELECT t.conv_id, t.turn, last.draft FROM t JOIN last ON t.input = last.input"
)
def golden_model(spark, sf_dir):
    """The model that knows the answers, asked for each of them; of equal questions the last answer holds."""
    conv = table(spark, sf_dir, "conversations")
    nxt = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    pairs = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")).join(nxt, ["conv_id", "turn"])
    return drafting.golden(pairs, ["conv_id", "turn"])(pairs.drop("target")).select("conv_id", "turn", "draft")


# The contract of a training example, written out: the keys in their order, then the notes.
ASKED = "Write one JSON object with these keys and no others, in this order: participant_id, date_of_service, duration_minutes, service_type, goal_linkage, location, staff_presented_by, participant_present, narrative_summary, billable_evidence, outcomes_achieved, risk_management, follow_up_needed, follow_up_notes."


@query(f"WITH n AS ({DUCK_NOTES}) SELECT id, 'system,user,assistant' AS roles, '{ASKED}' || chr(10) || 'Notes:' || chr(10) || input AS asked FROM n")
def chat_training(spark, sf_dir):
    made = to_chat(notes(spark, sf_dir), target="draft")
    return made.select("id", join(F.transform("messages", lambda m: m["role"])).alias("roles"), F.col("messages")[1]["content"].alias("asked"))


@query(f"WITH n AS ({DUCK_NOTES}) SELECT id, coalesce({_kv('participant')}, '') AS participant_id, coalesce({_kv('type')}, 'Other') AS service_type, 60::bigint AS duration_minutes, input AS narrative_summary, 14 AS n_keys FROM n")
def naive_draft(spark, sf_dir):
    df = C.parsed(drafting.naive(notes(spark, sf_dir).drop("draft")))
    text = lambda f: N.text_of(N.value(F.col("note"), f)).alias(f)
    return df.select("id", text("participant_id"), text("service_type"), N.text_of(N.value(F.col("note"), "duration_minutes")).cast("long").alias("duration_minutes"), text("narrative_summary"), F.size(F.col("note")).alias("n_keys"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_format(spark, sf_dir):
    from noteloom.operators.chat import chats

    return chats(table(spark, sf_dir, "conversations")).select("conv_id", F.size("messages").cast("long").alias("turns"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("chat"))


# --- synthesis -----------------------------------------------------------------------------------

# A candidate for each customer, numbered by its key.
NUMBERS = "SELECT c_custkey AS n FROM customer WHERE c_custkey IS NOT NULL"
DRAWN = synthesis.records_sql(synthesis.DUCK, NUMBERS)


def _numbers(spark, sf_dir) -> str:
    customers = table(spark, sf_dir, "customer").filter("c_custkey IS NOT NULL").select(F.col("c_custkey").alias("n"))
    spread(spark, customers, f"{sf_dir}/customer.parquet", "n").createOrReplaceTempView("noteloom_numbers")
    return "SELECT n FROM noteloom_numbers"


@query(f"SELECT stratum, seq, service, participant, day, minutes, goal, place, worker, present, outcome, follow_up, risk FROM ({synthesis.facts_sql(synthesis.DUCK, NUMBERS)}) f")
def synth_facts(spark, sf_dir):
    return spark.sql(synthesis.facts_sql(synthesis.SPARK, _numbers(spark, sf_dir))).select("stratum", "seq", "service", "participant", "day", "minutes", "goal", "place", "worker", "present", "outcome", "follow_up", "risk")


@query(f"SELECT stratum, seq, missing FROM ({synthesis.facts_sql(synthesis.DUCK, NUMBERS)}) f")
def synth_missing(spark, sf_dir):
    return spark.sql(synthesis.facts_sql(synthesis.SPARK, _numbers(spark, sf_dir))).select("stratum", "seq", "missing")


@query(f"SELECT id, input FROM ({DRAWN}) r")
def synth_input(spark, sf_dir):
    return synthesis.records(spark, _numbers(spark, sf_dir)).select("id", "input")


@query(f"SELECT id, draft AS target FROM ({DRAWN}) r")
def synth_target(spark, sf_dir):
    return synthesis.records(spark, _numbers(spark, sf_dir)).select("id", F.col("draft").alias("target"))


@query(f"SELECT id, stratum, coalesce(pii_handling, '') AS pii_handling, CASE WHEN stratum IN ('adv_pii_check', 'adv_missing_field') THEN missing ELSE '' END AS missing_fields, forbidden FROM ({DRAWN}) r")
def synth_records(spark, sf_dir):
    kept = F.when(F.col("stratum").isin("adv_pii_check", "adv_missing_field"), F.col("missing")).otherwise("")
    return synthesis.records(spark, _numbers(spark, sf_dir)).select("id", "stratum", F.coalesce("pii_handling", F.lit("")).alias("pii_handling"), kept.alias("missing_fields"), join(F.col("forbidden"), "|").alias("forbidden"))


# The plan: a third of the customers that have a stratum's numbers.
@query(
    f"WITH {O.score_ctes(DRAWN)}, "
    f"v AS (SELECT stratum, greatest(1, round_even(count(*) * (1 / 3::double), 0)) AS n FROM ({DRAWN}) r GROUP BY stratum), "
    f"c AS (SELECT *, row_number() OVER (PARTITION BY sha1(lower({O.strip('input')})) ORDER BY k) AS copy FROM q WHERE structural AND pii_clean AND faithful), "
    "d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k) AS place FROM c WHERE copy = 1) "
    "SELECT 'synth-' || d.stratum || '-' || printf('%04d', place - 1) AS id, d.stratum, input, draft AS target FROM d JOIN v ON d.stratum = v.stratum WHERE place <= v.n"
)
def synth_dataset(spark, sf_dir):
    numbers = _numbers(spark, sf_dir)
    nth = F.element_at(F.array(*[F.lit(s) for s in STRATA]), (F.col("n") % len(STRATA) + 1).cast("int"))
    counts = spark.table("noteloom_numbers").groupBy(nth.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return synthesis.dataset(spark, rows.plan_scale(counts, 1, 3), numbers=numbers)
