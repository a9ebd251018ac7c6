"""Queries that relate rows to rows: texts and patterns, runs, ordered attempts, events; and the SQL that each must match."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteloom.operators import bucketed, contains, judging, stops, timeline, verify
from noteloom.operators import disjoint as D
from noteloom.operators import first_k as K
from noteloom.operators import rows as R
from noteloom.operators.seen import SeenKeys
from noteloom.plans import oracle as O
from noteloom.plans import scoring as C
from noteloom.plans.fixture import DUCK_NOTES, notes, table
from noteloom.plans.queries import KEY, ORACLE_SQL, SPLIT, query
from noteloom.rules import PLAN
from noteloom.runtime import Scratch
from noteloom.streaming import monitor, sessions


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''")
def contamination(spark, sf_dir):
    """Which documents hold which benchmark text."""
    return contains.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry={"doc_id": "doc_id"}, carry_pattern={"item_id": "item_id"})


@query(f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) AS r FROM documents) SELECT doc_id, lang, source FROM d WHERE r = 1")
def dedup_across_runs(spark, sf_dir):
    """Documents that come in three runs, by id, and the second of them twice: what stays is what stays of all at once."""
    docs = table(spark, sf_dir, "documents")
    seen = SeenKeys(spark, Scratch(spark, "runs").path)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    third = [low + (high - low) * k // 3 for k in (1, 2)] if low is not None else [0, 0]
    scratch = Scratch(spark, "kept")
    parts = [docs.filter(F.col("doc_id") <= third[0]), docs.filter((F.col("doc_id") > third[0]) & (F.col("doc_id") <= third[1])), docs.filter(F.col("doc_id") > third[1])]
    kept = {}
    for run in (1, 2, 3, 2):
        kept[run] = scratch.write(seen.new_rows(parts[run - 1], run, "text", "doc_id").select("doc_id", "lang", "source"), f"run{run}")
    return kept[1].unionByName(kept[2]).unionByName(kept[3])


# An attempt is a note; it counts if it passes the compliance gate and its input isn't that of an earlier one that does.
TARGETS = ", ".join(f"('{s}', {4 * n})" for s, n in PLAN.items())
IN_ROW = 9
ATTEMPTS = f"""
    a0 AS (SELECT stratum, k, input, structural AND pii_clean AND faithful AS fine FROM q),
    a AS (SELECT stratum, k, fine AND row_number() OVER (PARTITION BY fine, sha1(lower({O.strip('input')})) ORDER BY k) = 1 AS ok FROM a0),
    v AS (SELECT * FROM (VALUES {TARGETS}) v(stratum, target)),
    b AS (SELECT stratum, k, ok, row_number() OVER w AS upto, sum(ok::int) OVER w AS made FROM a WINDOW w AS (PARTITION BY stratum ORDER BY k)),
    c AS (SELECT *, CASE WHEN ok THEN 0 ELSE upto - coalesce(max(CASE WHEN ok THEN upto END) OVER (PARTITION BY stratum ORDER BY k), 0) END AS failing FROM b),
    d AS (SELECT c.*, target, CASE WHEN made >= target THEN 'made' WHEN failing >= {IN_ROW} THEN 'in_row' WHEN upto >= 20 * target + 30 THEN 'attempts' END AS reason FROM c JOIN v ON c.stratum = v.stratum),
    e AS (SELECT stratum, min(upto) AS stop FROM d WHERE reason IS NOT NULL GROUP BY stratum),
    f AS (SELECT d.*, row_number() OVER (PARTITION BY d.stratum ORDER BY upto DESC) AS back, e.stop FROM d LEFT JOIN e ON d.stratum = e.stratum WHERE e.stop IS NULL OR upto <= e.stop)
"""


def _attempts(spark, sf_dir):
    fine = Scratch(spark, "attempts").write(C.example_scores(notes(spark, sf_dir), wanted=("structural", "pii_clean", "faithful")).select("stratum", "k", "input", F.expr("structural AND pii_clean AND faithful").alias("fine")), "scored")
    first = R.dedup_groups(fine.filter("fine"), "input", "k").select("first")
    return fine.join(first, F.col("k") == F.col("first"), "left").select("stratum", "k", (F.col("fine") & F.col("first").isNotNull()).alias("ok"))


@query(f"WITH {O.score_ctes()}, {ATTEMPTS} SELECT stratum, target, upto AS attempts, made::bigint AS made, failing::bigint AS in_row, coalesce(reason, 'open') AS reason FROM f WHERE back = 1")
def stop_rule(spark, sf_dir):
    """Where the making of records would stop in each stratum, if every note were an attempt."""
    targets = spark.createDataFrame([(s, 4 * n) for s, n in PLAN.items()], "stratum string, target long")
    return stops.stop_points(_attempts(spark, sf_dir), "stratum", "k", "ok", F.expr("k div 4096"), targets, stops.StopRule(in_row=IN_ROW))


# --- events ---------------------------------------------------------------------------------------


@query(
    "SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p "
    "ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts"
)
def last_view(spark, sf_dir):
    """For each purchase the user's last view at or before it."""
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    found = timeline.as_of(left, right, ["user_id"], "ts", {"event_id": "view_id", "value": "view_value"}, tie="event_id")
    return found.select("event_id", "user_id", "view_id", "view_value")


AROUND = 10 * 60 * 1_000_000


@query(
    "SELECT a.event_id, b.event_id AS error_id FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'error' "
    "AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE"
)
def errors_around(spark, sf_dir):
    """Errors of anybody within ten minutes of a purchase."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    t = F.col("t")
    return timeline.overlaps(events.filter("event_type = 'purchase'"), events.filter("event_type = 'error'"), (t - AROUND, t + AROUND, t, t), 2 * AROUND, {"event_id": "event_id"}, {"event_id": "error_id"})


@query("SELECT event_type, event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) e WHERE r <= 5")
def preview_events(spark, sf_dir):
    """The first five events of each type."""
    return K.first_k(table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", "value"), "event_type", "event_id", 5)


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) d WHERE r <= 3")
def preview_sources(spark, sf_dir):
    """The first three documents of each source, whose texts stay behind."""
    return K.first_k(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), "source", "doc_id", 3)


# --- splits ---------------------------------------------------------------------------------------


def _with_splits(spark, sf_dir):
    return R.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lang", "doc_id")


PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))
IN_SPLITS = f"{SPLIT}, x AS (SELECT t.lang, t.split, {KEY} AS key FROM t JOIN documents d ON t.doc_id = d.doc_id)"
_set = lambda a, op, b: f"(SELECT lang, key FROM x WHERE split = '{a}' {op} ALL SELECT lang, key FROM x WHERE split = '{b}')"


@query(f"{IN_SPLITS} " + " UNION ALL ".join(f"SELECT lang, '{a}' AS a, '{b}' AS b, key, count(*) AS n FROM {_set(a, 'INTERSECT', b)} s GROUP BY lang, key" for a, b in PAIRS))
def split_leaks(spark, sf_dir):
    """Texts that two splits of the documents share."""
    return D.shared_texts(_with_splits(spark, sf_dir), "lang", "split", "text").withColumnRenamed("grp", "lang")


@query(
    f"{IN_SPLITS}, c AS ("
    + " UNION ALL ".join(f"SELECT lang, '{a}' AS a, '{b}' AS b, '{what}' AS what FROM {_set(*sides)} s" for a, b in PAIRS for what, sides in (("shared", (a, "INTERSECT", b)), ("only_a", (a, "EXCEPT", b)), ("only_b", (b, "EXCEPT", a))))
    + ") SELECT lang, a, b, count(*) FILTER (what = 'shared') AS shared, count(*) FILTER (what = 'only_a') AS only_a, count(*) FILTER (what = 'only_b') AS only_b FROM c GROUP BY lang, a, b"
)
def split_overlap(spark, sf_dir):
    return D.split_overlap(_with_splits(spark, sf_dir), "lang", "split", "text").withColumnRenamed("grp", "lang")


# --- look-ups and judges ---------------------------------------------------------------------------

BUCKETS = 8


@query(ORACLE_SQL["golden_lookup"])
def golden_bucketed(spark, sf_dir):
    """The look-up of ``golden_lookup``, from tables that were bucketed before."""
    conv = table(spark, sf_dir, "conversations")
    nxt = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("draft"))
    pairs = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")).join(nxt, ["conv_id", "turn"])
    known = bucketed.answers(pairs, "input", "draft", ["conv_id", "turn"], BUCKETS)
    asked = bucketed.Bucketed(conv.filter("role <> 'assistant'").select("conv_id", "turn", F.col("text").alias("input")), "input", BUCKETS)
    return bucketed.look_up(asked, known, "draft").select("conv_id", "turn", F.coalesce("draft", F.lit("{}")).alias("draft"))


# A judge's reply about a note: of all the forms that judges use, sound and unsound.
REPLY = """
    CASE WHEN k % 19 = 0 THEN '<think>{"is_faithful": false}</think> ' WHEN k % 5 = 0 THEN '```json' || chr(10) WHEN k % 23 = 0 THEN 'I think so.' ELSE '' END
    || CASE WHEN k % 23 = 0 AND k % 19 <> 0 AND k % 5 <> 0 THEN '' ELSE
    '{"is_faithful": ' || CASE WHEN k % 7 = 0 THEN 'false' WHEN k % 11 = 0 THEN '"Yes"' WHEN k % 13 = 0 THEN '2' WHEN k % 17 = 0 THEN 'null' WHEN k % 29 = 0 THEN '1' ELSE 'true' END
    || CASE WHEN k % 31 = 0 THEN '' ELSE ', "fabricated_claims": [' || CASE WHEN k % 37 = 0 THEN '7' WHEN k % 7 = 0 THEN '"number ' || cast(k AS string) || '", "kind ' || stratum || '"' ELSE '' END || ']' END
    || CASE WHEN k % 41 = 0 THEN ', "reasoning": 3' WHEN k % 3 = 0 THEN ', "reasoning": "as in ' || id || '"' ELSE '' END
    || CASE WHEN k % 43 = 0 THEN '' ELSE '}' END END
    || CASE WHEN k % 5 = 0 AND k % 19 <> 0 THEN chr(10) || '```' ELSE '' END
"""
_READ = f"""
    r0 AS (SELECT k, j, json_type(j, '$.is_faithful') AS kind, json_extract_string(j, '$.is_faithful') AS word, json_type(j, '$.fabricated_claims') AS list_kind, json_type(j, '$.reasoning') AS why_kind FROM p),
    r1 AS (SELECT *, CASE WHEN kind = 'BOOLEAN' THEN word = 'true' WHEN kind = 'VARCHAR' THEN CASE WHEN lower(word) IN {judging.TRUE} THEN true WHEN lower(word) IN {judging.FALSE} THEN false END
                          WHEN kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CASE word::double WHEN 1 THEN true WHEN 0 THEN false END END AS truth,
                     (list_kind IS NULL OR list_kind = 'ARRAY' AND len(list_filter(json_extract(j, '$.fabricated_claims[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0) AND (why_kind IS NULL OR why_kind = 'VARCHAR') AS fine FROM r0),
    r AS (SELECT k, coalesce(fine AND truth, false) AS faithful, coalesce(fine AND truth IS NOT NULL, false) AS readable, j FROM r1)
"""


@query(
    f"WITH {O.notes_ctes(f'SELECT k, id, stratum, input, forbidden, {REPLY} AS draft FROM ({DUCK_NOTES}) x')}, {_READ} "
    "SELECT k, faithful, readable, CASE WHEN readable THEN coalesce(array_to_string(json_extract_string(j, '$.fabricated_claims[*]'), '|'), '') ELSE '' END AS claims, "
    "coalesce(CASE WHEN readable THEN json_extract_string(j, '$.reasoning') END, '') AS reasoning FROM r"
)
def judge_says(spark, sf_dir):
    """Verdicts, claims and reasons from a reply about every note."""
    replies = notes(spark, sf_dir).select("k", F.expr(REPLY).alias("reply"))
    reply, q = F.col("reply"), "faithful"
    read = replies.select("k", judging.read_verdict(reply, q).alias("truth"), judging.said(reply, q).alias("said"))
    return read.select("k", F.coalesce("truth", F.lit(False)).alias("faithful"), F.col("truth").isNotNull().alias("readable"), F.array_join("said.items", "|").alias("claims"), F.coalesce("said.reasoning", F.lit("")).alias("reasoning"))


def counting_judge(frames):
    """A judge that goes by lengths, and fails on some questions however often it is asked."""
    for pdf in frames:
        draft, asked = pdf["draft"].fillna("").str.len(), pdf["input"].fillna("").str.len()
        reply = [f'{{"is_faithful": {"true" if d % 2 == 0 else "false"}, "fabricated_claims": ["of {d}"]}}' if (a + d) % 7 else "timeout" for a, d in zip(asked, draft)]
        yield pdf.assign(faithful_reply=reply, register_reply='{"meets_register": true, "score": 0.5}', billable_reply='{"present": 1}')


@query(
    "WITH t AS (SELECT conv_id, turn, text AS input, role, lead(text) OVER w AS draft, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), "
    "l AS (SELECT conv_id, turn, length(coalesce(input, '')) AS a, length(coalesce(draft, '')) AS d FROM t WHERE role = 'user' AND next_role = 'assistant') "
    "SELECT conv_id, turn, (a + d) % 7 <> 0 AND d % 2 = 0 AS faithful, CASE WHEN (a + d) % 7 <> 0 THEN 'of ' || d ELSE '' END AS claims, true AS register FROM l"
)
def judged_once(spark, sf_dir):
    """Answers of conversations, judged once for each distinct question and answer."""
    conv = table(spark, sf_dir, "conversations")
    nxt = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("draft"))
    pairs = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input")).join(nxt, ["conv_id", "turn"])
    judged = judging.judge_once(counting_judge, retries=1, with_said=True)(pairs)
    return judged.select("conv_id", "turn", "faithful", F.array_join("faithful_said.items", "|").alias("claims"), "register")


_JUDGED = "(length(input) + length(draft)) % 7 <> 0 AND length(draft) % 2 = 0"


@query(O.over_scores(f"SELECT id, CASE WHEN NOT structural THEN 'structure' WHEN NOT pii_clean THEN 'pii' WHEN {_JUDGED} THEN 'kept' ELSE 'faithfulness' END AS stage FROM q"))
def verify_stages(spark, sf_dir):
    """The first check that each note fails, with a judge that is asked about what the others let pass."""
    drafts = notes(spark, sf_dir).select("id", "stratum", "input", "draft", "forbidden")
    return verify.reasons(drafts, judging.judge_once(counting_judge, retries=1)).select("id", "stage")


@query(
    O.over_scores(
        f"SELECT stratum, count(*) AS n, round(avg(structural::int), 4) AS structural, round(avg(({_JUDGED})::int), 4) AS faithful, round(avg((structural AND pii_clean AND {_JUDGED})::int), 4) AS overall_pass FROM q GROUP BY stratum"
    )
)
def judged_per_stratum(spark, sf_dir):
    """Rates by stratum where faithfulness, register and billable evidence are an asked judge's."""
    scores = verify.judged_scores(notes(spark, sf_dir), judging.judge_once(counting_judge, retries=1, with_said=True))
    return C.per_stratum(scores).select("stratum", "n", "structural", "faithful", "overall_pass")


# --- streams --------------------------------------------------------------------------------------

PARTS = 3
IDLE = 6 * 3600


@query(
    f"WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {IDLE * 1_000_000} THEN 0 ELSE 1 END AS begins FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "b AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM a) "
    "SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, sum(round(value * 100))::bigint AS cents FROM b GROUP BY user_id, nth"
)
def user_sessions(spark, sf_dir):
    """Sessions of users, from a stream of the events that is stopped and started again between its parts."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    measures = [F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(F.round(F.col("value") * 100)).cast("long").alias("cents")]
    made = sessions.run_in_parts(events, "ts", lambda s: sessions.sessions(s, "user_id", "ts", f"{IDLE} seconds", "1 hour", measures), PARTS, "30 DAYS", "sessions")
    return made.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n", "errors", "cents")


@query(
    f"WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = 'purchase' OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > {IDLE * 1_000_000} THEN 1 ELSE 0 END AS begins FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "b AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM a) "
    "SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 THEN 'done' ELSE 'idle' END AS outcome FROM b GROUP BY user_id, nth"
)
def user_visits(spark, sf_dir):
    """Visits of users that end with a purchase or in silence, from a state for each user with a timeout."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return sessions.run_in_parts(events, "ts", lambda s: sessions.visits(s, "user_id", "ts", "event_id", F.col("event_type") == "purchase", IDLE, "1 hour"), PARTS, "30 DAYS", "visits")


MONTH = 30 * 86400


@query(
    O.over_scores(
        f"SELECT (epoch_us(o.o_orderdate::timestamp) // {MONTH * 1_000_000})::bigint AS period, stratum, count(*) AS n, round(avg(structural::int), 6) AS structural, round(avg(pii_clean::int), 6) AS pii_clean, round(avg(passed::int), 6) AS passed "
        "FROM q JOIN orders o ON o.o_orderkey = q.k GROUP BY 1, 2"
    )
)
def window_rates(spark, sf_dir):
    """Rates of notes by windows of thirty days and stratum, scored in a stream as they come by date."""
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    rows = notes(spark, sf_dir).join(dates, "k").select("ts", "id", "stratum", "input", "draft", "forbidden")
    made = sessions.run_in_parts(Scratch(spark, "dated").write(rows, "notes"), "ts", lambda s: monitor.window_rates(s, size="30 days", late="1 day"), PARTS, "90 DAYS", "rates")
    six = lambda c: F.round(c, 6).alias(c)
    return made.select(F.expr(f"unix_seconds(window.start) div {MONTH}").alias("period"), "stratum", "n", six("structural"), six("pii_clean"), six("passed"))
