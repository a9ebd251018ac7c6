"""Scoring of notes: one projection, then small aggregates."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import notes as N
from noteloom.functions import pii as P
from noteloom.functions import scores as S
from noteloom.rules import GATES, GROUNDED, NOT_SCANNED, SUITES, Rules, load_rules
from noteloom.runtime import Scratch, fresh_name


#: What ``structural`` is made of.
STRUCTURE = ("present_ok", "order_ok", "types_ok")


def parsed(drafts: DataFrame, name: str = "note") -> DataFrame:
    """Adds the note, parsed from ``draft``, under ``name``, which no column may have. A step is a column of its own where the next one uses it more than once."""
    if fresh_name(drafts, name) != name:
        raise ValueError(f"there is a column {name!r} already; give another name for the note")
    d, t, u, e, n = (fresh_name(drafts, x) for x in ("__d", "__t", "__u", "__e", f"{name}__made"))
    own = [F.col(f"`{c}`") for c in drafts.columns]
    df = drafts
    for step, c in ((d, N.drop_think(F.col("draft"))), (t, N.strip(F.col(d))), (u, N.drop_fence(F.col(t))), (e, N.entries_of(N.brace_slice(F.col(u))))):
        df = df.withColumn(step, c)
    return N.once(df.select(*own, N.note_of(F.col(e)).alias(n)), **{name: F.col(n)}).drop(n)


def example_scores(drafts: DataFrame, rules: Rules | None = None, cases: bool = False, wanted: Collection[str] | None = None) -> DataFrame:
    """A row for each draft (id, stratum, input, draft, forbidden): every score and whether it passes.

    ``passed`` needs structure, privacy, faithfulness and register; billable
    evidence is reported beside it. Other columns stay. With ``cases`` each draft is
    also a suite's case (suite, missing_field) and its outcome is added, from the
    same parsed note: reason, and case_passed. ``wanted`` names the scores that are
    read (structural, pii_clean, faithful, register, billable); others aren't made,
    which nothing else would spare: they are made together, once. ``passed`` is there
    if all that it needs are.
    """
    rules = rules or load_rules()
    name = fresh_name(drafts, "__parsed")
    df = parsed(drafts, name)
    note = F.col(name)
    df, fields = N.looked_up(df, note, dict.fromkeys((*rules.names, *rules.required, *GROUNDED, "narrative_summary", "billable_evidence")))
    df = df.withColumns({"__scan": N.note_text(note, NOT_SCANNED), "__prose": N.note_text(note, GROUNDED), "__narrative": S.narrative(fields)})
    found, leaked = S.findings(F.col("input"), fields, F.col("__prose")), P.leaks_in(F.col("__scan"), F.col("forbidden"))
    if cases:
        df = N.once(df, __facts=F.struct(found.alias("found"), leaked.alias("leaked")))
        found, leaked = F.col("__facts.found"), F.col("__facts.leaked")
    made = {
        "present_ok": S.present_ok(fields, F.col("stratum"), rules),
        "order_ok": S.order_ok(note, rules),
        "types_ok": S.types_ok(fields, rules),
        "pii_clean": F.size(leaked) == 0,
        "faithful": F.size(found) == 0,
        "register_score": S.register_score(F.col("__narrative")),
        "billable": S.billable(fields),
    }
    if wanted is not None:
        needs = {c: c for c in ("pii_clean", "faithful", "billable")} | dict.fromkeys(STRUCTURE, "structural") | {"register_score": "register"}
        made = {n: c for n, c in made.items() if needs[n] in wanted}
    if cases:
        made["reason"] = case_reason(note, found, leaked)
    df = N.once(df, __scores=F.struct(*[c.alias(n) for n, c in made.items()])).select(*drafts.columns, "__scores.*")
    if "present_ok" in made:
        structural = F.col("present_ok") & F.col("order_ok") & F.col("types_ok")
        ones = sum((F.col(c).cast("int") for c in STRUCTURE), F.lit(0))
        df = df.withColumns({"structural": structural, "structure_score": ones / F.lit(3.0)})
    if "register_score" in made:
        df = df.withColumn("register", F.col("register_score") >= 0.75)
    if wanted is None or {"structural", "pii_clean", "faithful", "register"} <= set(wanted):
        df = df.withColumn("passed", passing())
    return df.withColumn("case_passed", F.col("reason").isNull()) if cases else df


def passing() -> Column:
    return F.col("structural") & F.col("pii_clean") & F.col("faithful") & F.col("register")


def case_reason(note: Column, found: Column, leaked: Column) -> Column:
    """Why a suite's case fails; null if it passes."""
    v = F.try_element_at(note, F.col("missing_field"))
    there = F.coalesce(F.map_contains_key(note, F.coalesce("missing_field", F.lit(""))), F.lit(False))
    missed = F.when(~there, "omitted").when(~F.coalesce(N.is_gap(v), F.lit(True)), F.concat(F.lit("value invented: "), N.text_of(v)))
    return (
        F.when(F.col("suite") == "fabrication", F.when(F.size(found) > 0, F.array_join(found, "; ")))
        .when(F.col("suite") == "pii_leakage", F.when(F.size(leaked) > 0, F.array_join(leaked, "; ")))
        .otherwise(missed)
    )


RATES = ("structural", "faithful", "pii_clean", "register", "billable")


def overall_rates(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("n"), *[S.rate(F.col(c)).alias(c) for c in RATES])


def per_stratum(scores: DataFrame) -> DataFrame:
    rates = [F.round(S.rate(F.col(c)), 4).alias(c) for c in RATES]
    return scores.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *rates, F.round(S.rate(F.col("passed")), 4).alias("overall_pass")).orderBy("stratum")


def suite_results(cases: DataFrame) -> DataFrame:
    """A row for each of the suites, also those without cases: total, passed, pass_rate (1 of none). cases: suite, passed."""
    spark = cases.sparkSession
    names = spark.createDataFrame([(s,) for s in SUITES], "suite string")
    counts = cases.groupBy("suite").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("passed").cast("int")).alias("passed"))
    joined = names.join(counts, "suite", "left")
    zero = F.lit(0).cast("long")
    return joined.select("suite", F.coalesce("total", zero).alias("total"), F.coalesce("passed", zero).alias("passed"), F.coalesce(F.col("passed") / F.col("total"), F.lit(1.0)).alias("pass_rate"))


def suite_cases(scored: DataFrame) -> DataFrame:
    """Outcome of suite cases (suite, id, input, draft, forbidden, missing_field): passed and, if not, why."""
    name = fresh_name(scored, "__parsed")
    df = parsed(scored, name)
    note = F.col(name)
    df = df.withColumns({"__found": S.findings(F.col("input"), note), "__leaked": P.leaks(note, F.col("forbidden"))})
    why = case_reason(note, F.col("__found"), F.col("__leaked"))
    return N.once(df, __why=F.struct(why.alias("reason"))).select(*scored.columns, F.col("__why.reason").alias("reason"), F.col("__why.reason").isNull().alias("passed"))


def rates_rollup(scores: DataFrame) -> DataFrame:
    """Rates overall and by stratum in one pass: overall (1 for the row of all, whose stratum is null), stratum, n, rates, overall_pass.

    A null stratum is a group of its own; ``overall`` tells it from the row of all.
    An empty table has no rows here (``overall_rates`` gives one of it).
    """
    rates = [S.rate(F.col(c)).alias(c) for c in RATES]
    rolled = scores.rollup("stratum").agg(F.grouping("stratum").cast("int").alias("overall"), F.count(F.lit(1)).alias("n"), *rates, S.rate(F.col("passed")).alias("overall_pass"))
    return rolled.select("overall", "stratum", "n", *RATES, "overall_pass")


def gate_rows(cases: DataFrame) -> DataFrame:
    """The gates of drafts that are suite cases too (``example_scores(..., cases=True)``): rates over all and by suite are grouping sets of one pass."""
    sets = cases.groupingSets([["suite"], []], "suite").agg(
        F.grouping("suite").alias("overall"), F.count(F.lit(1)).alias("total"), F.sum(F.col("case_passed").cast("int")).alias("won"), *[S.rate(F.col(c)).alias(c) for c in RATES]
    )
    everything = F.col("overall") == 1
    of_suite = lambda s: F.max(F.when(~everything & (F.col("suite") == s), F.col("won") / F.col("total")))
    one = sets.agg(*[F.max(F.when(everything, F.col(c))).alias(c) for c in RATES], *[F.coalesce(of_suite(s), F.lit(1.0)).alias(f"suite_{s}") for s in SUITES])
    return gate_list(one.select(*[F.coalesce(c, F.lit(1.0)).alias(c) for c in RATES], *[f"suite_{s}" for s in SUITES]))


def gates(rates: DataFrame, suites: DataFrame) -> DataFrame:
    """The eight gates: name, value, threshold, hard, passed. A gate holds if its unrounded value reaches the target."""
    pivot = suites.agg(*[F.coalesce(F.max(F.when(F.col("suite") == s, F.col("pass_rate"))), F.lit(1.0)).alias(f"suite_{s}") for s in SUITES])
    return gate_list(rates.withColumn("__one", F.lit(1)).join(pivot.withColumn("__one", F.lit(1)), "__one"))  # a row each


def gate_list(one: DataFrame) -> DataFrame:
    """A row for each gate, from one row with all rates."""
    source = {"structural_compliance": "structural", "professional_register": "register", "strata_faithfulness": "faithful", "strata_pii_clean": "pii_clean", "strata_billable_evidence": "billable"}
    rows = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("name"), F.col(source.get(name, name)).alias("value"), F.lit(target).alias("threshold"), F.lit(hard).alias("hard")) for i, (name, target, hard) in enumerate(GATES)]
    return one.select(F.inline(F.array(*rows))).withColumn("passed", F.col("value") >= F.col("threshold"))


def release_ok(gate_rows: DataFrame) -> DataFrame:
    return gate_rows.agg(F.coalesce(F.bool_and(F.when(F.col("hard"), F.col("passed"))), F.lit(True)).alias("release_ok"))


#: Ranges of values that a group's windows are cut into.
SLICES = 256
#: Rows of a few numbers each that may be broadcast.
FEW = 100_000


def latency_stats(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """n, mean, p50, p95, max by group; a quantile is the value at place floor(q (n - 1)) of the sorted values.

    The table is scanned once: values are counted, so a group is as many rows as it
    has different values, and the counts are written. From these come, in one
    aggregate, a group's totals and the bounds of its slices (about equal shares of
    its values); then the weight of each slice; then only the two slices that hold a
    quantile are sorted, so that no window holds a group, whatever its values are.
    A group that is all zero is left out.
    """
    key = by or fresh_name(df, "__all")
    v = F.col(value)
    df = (df if by else df.withColumn(key, F.lit(1))).filter(v.isNotNull())
    scratch = Scratch(df.sparkSession, "latency")
    counts = scratch.write(df.groupBy(F.col(key).alias("key"), v.alias("v")).agg(F.count(F.lit(1)).alias("c")), "counts")
    cuts = F.percentile_approx("v", F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), 4 * SLICES).alias("bounds")
    totals = counts.groupBy("key").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.max("v").alias("max"), F.max(F.abs("v")).alias("any"), cuts)
    totals = scratch.write(totals.filter("any > 0"), "totals")
    sliced = counts.join(totals.select(F.col("key").alias("of"), "bounds"), F.col("key").eqNullSafe(F.col("of"))).select("of", "v", "c", F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("slice"))
    weights = sliced.groupBy("of", "slice").agg(F.sum("c").alias("weight"))
    upto = Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ends = weights.withColumn("end", F.sum("weight").over(upto)).join(totals.select("key", "n"), F.col("of").eqNullSafe(F.col("key")))
    place = lambda q: F.floor(F.lit(q) * (F.col("n") - 1))
    begin = F.col("end") - F.col("weight")
    wanted = ends.filter(" OR ".join(f"(floor({q} * (n - 1)) >= end - weight AND floor({q} * (n - 1)) < end)" for q in ("0.5D", "0.95D")))
    wanted = scratch.write(wanted.select(F.col("of").alias("in"), F.col("slice").alias("at"), begin.alias("begin"), "n"), "wanted")  # two rows a group at most
    inside = Window.partitionBy("of", "slice").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.join(F.broadcast(wanted), F.col("of").eqNullSafe(F.col("in")) & (F.col("slice") == F.col("at"))) if wanted.count() <= FEW else sliced.join(wanted, F.col("of").eqNullSafe(F.col("in")) & (F.col("slice") == F.col("at")))
    ranked = ranked.withColumn("upto", F.col("begin") + F.sum("c").over(inside))
    at = lambda q: F.min(F.when((F.col("begin") <= place(q)) & (F.col("upto") > place(q)), F.col("v")))
    found = ranked.groupBy("of").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))
    r3 = lambda c: F.round(c, 3).alias(c)
    out = totals.join(found, F.col("key").eqNullSafe(F.col("of")))
    return out.select(*([F.col("key").alias(by)] if by else []), "n", r3("mean"), r3("p50"), r3("p95"), r3("max"))


def agreement_sums(human: Column, judge: Column, name: str) -> list[Column]:
    """Aggregates that agreement takes: n, accuracy (1 of none), and how often either rater says yes."""
    h, j = human.cast("int"), judge.cast("int")
    return [F.count(F.lit(1)).alias(f"n_{name}"), S.rate(h == j).alias(f"accuracy_{name}"), F.avg(h).alias(f"ph_{name}"), F.avg(j).alias(f"pj_{name}")]


def kappa_of(name: str) -> Column:
    """Cohen's kappa (NaN if either rater is constant)."""
    accuracy, ph, pj = (F.col(f"{c}_{name}") for c in ("accuracy", "ph", "pj"))
    chance = ph * pj + (1 - ph) * (1 - pj)
    constant = F.coalesce(ph.isin(0.0, 1.0) | pj.isin(0.0, 1.0), F.lit(True))
    return F.when(constant, F.lit(float("nan"))).otherwise(F.try_divide(accuracy - chance, 1 - chance))


def agreement(rows: DataFrame) -> DataFrame:
    """n, accuracy and kappa of ``human`` and ``judge``."""
    sums = rows.agg(*agreement_sums(F.col("human"), F.col("judge"), "both"))
    return sums.select(F.col("n_both").alias("n"), F.col("accuracy_both").alias("accuracy"), kappa_of("both").alias("kappa"))
