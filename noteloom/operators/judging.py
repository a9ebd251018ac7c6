"""Verdicts of an opaque judge, read from its replies, and how far they can be trusted.

A judge replies with one JSON object for each question, often with a stretch of
thought or a fence around it. Whatever can't be read as the object asked for is a
verdict against the note: a judge that fails must not let a note pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import notes as N
from noteloom.operators.drafting import Transform, batched
from noteloom.plans.scoring import agreement_sums, kappa_of
from noteloom.runtime import Scratch, fresh_name

#: For each question: the key of the verdict, and of the list of what speaks against the note.
QUESTIONS = {"faithful": ("is_faithful", "fabricated_claims"), "register": ("meets_register", "issues"), "billable": ("present", None)}
# Texts that count as true or false.
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")
#: Share of agreement with human labels from which a judge may gate.
TRUSTED = 0.9


def _truth(raw: Column) -> Column:
    kind, text = F.schema_of_variant(raw), F.lower(F.try_variant_get(raw, "$", "string"))
    number = F.try_variant_get(raw, "$", "double")
    word = F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)
    return F.when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean")).when(kind == "STRING", word).when(kind.isin("BIGINT", "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), F.when(number == 1, True).when(number == 0, False))


def _strings(raw: Column) -> Column:
    """Whether a value is absent or a list of strings."""
    return raw.isNull() | F.schema_of_variant(raw).isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(F.filter(F.try_variant_get(raw, "$", "array<variant>"), lambda x: F.schema_of_variant(x) != "STRING")) == 0)


def read_verdict(reply: Column, question: str) -> Column:
    """Whether a reply says so; null for a reply that isn't what was asked for.

    The object must hold the verdict as a boolean or a word or number for one, its
    list, if there, must hold strings, a score must lie from 0 to 1, and reasoning
    must be a string.
    """
    key, items = QUESTIONS[question]
    note = F.from_json(N.json_text(reply), "map<string,variant>")
    of = lambda k: F.try_element_at(note, F.lit(k))
    fine = of("reasoning").isNull() | (F.schema_of_variant(of("reasoning")) == "STRING")
    if items:
        fine = fine & _strings(of(items))
    if question == "register":
        fine = fine & (of("score").isNull() | F.coalesce(F.try_variant_get(of("score"), "$", "double").between(0, 1), F.lit(False)))
    return F.when(fine, _truth(of(key)))


def verdict(reply: Column, question: str) -> Column:
    """:func:`read_verdict`; false for a reply that can't be read."""
    return F.coalesce(read_verdict(reply, question), F.lit(False))


def said(reply: Column, question: str) -> Column:
    """What a reply says beside its verdict: items (claims that the source doesn't hold, or issues), score, reasoning.

    Of a reply that can't be read the list is empty and the rest null; ``score`` is
    the register's.
    """
    _, items = QUESTIONS[question]
    note = F.from_json(N.json_text(reply), "map<string,variant>")
    of = lambda k, kind: F.try_variant_get(F.try_element_at(note, F.lit(k)), "$", kind)
    none = F.array().cast("array<string>")
    readable = read_verdict(reply, question).isNotNull()
    found = F.coalesce(of(items, "array<string>"), none) if items else none
    return F.struct(
        F.when(readable, found).otherwise(none).alias("items"),
        (F.when(readable, of("score", "double")) if question == "register" else F.lit(None).cast("double")).alias("score"),
        F.when(readable, of("reasoning", "string")).alias("reasoning"),
    )


REPLIES = ", ".join(f"{q}_reply string" for q in QUESTIONS)


def verdicts(df: DataFrame, with_said: bool) -> DataFrame:
    """Verdicts in place of the replies; with ``with_said`` also a struct ``<question>_said`` for each."""
    made = {q: verdict(F.col(f"{q}_reply"), q) for q in QUESTIONS}
    more = {f"{q}_said": said(F.col(f"{q}_reply"), q) for q in QUESTIONS} if with_said else {}
    return df.withColumns(made | more).drop(*[f"{q}_reply" for q in QUESTIONS])


def replies_judge(ask: Callable[[Iterator], Iterator], with_said: bool = False) -> Transform:
    """A judge from a function over batches that adds a column ``<question>_reply`` for each question; adds the verdicts (``verdicts``)."""
    return lambda df: verdicts(batched(ask, REPLIES)(df), with_said)


def judge_once(ask: Callable[[Iterator], Iterator], retries: int = 2, with_said: bool = False) -> Transform:
    """As :func:`replies_judge`, but each distinct (input, draft) is asked about once, however many rows have it.

    A question whose reply can't be read is asked again, up to ``retries`` times, and
    counts against the note after that; others aren't. Replies are written, so that
    no later use of the result asks again (a task that is repeated for a lost executor
    does). Null inputs and drafts are values of their own. Distinct pairs come from a
    map-side aggregate; replies are joined back as a written table, so that a pair
    that many rows share can be split.
    """

    def run(df: DataFrame) -> DataFrame:
        scratch = Scratch(df.sparkSession, "judge")
        pair, key = ["input", "draft"], fresh_name(df, "__pair")
        sized = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in pair]
        keyed = scratch.write(df.withColumn(key, F.sha2(F.concat(*sized), 256)), "drafts")  # read twice
        open_ = scratch.write(keyed.groupBy(F.col(key).alias("key")).agg(*[F.first(c).alias(c) for c in pair]), "asked0")
        replies, readable = [F.col(f"{q}_reply") for q in QUESTIONS], F.lit(True)
        for q in QUESTIONS:
            readable = readable & read_verdict(F.col(f"{q}_reply"), q).isNotNull()
        done = None
        for k in range(retries + 1):
            got = scratch.write(batched(ask, REPLIES)(open_).withColumn("readable", readable), f"replies{k}")
            final = (got if k == retries else got.filter("readable")).select("key", *replies)
            done = final if done is None else done.unionByName(final)
            open_ = got.filter("NOT readable").select("key", *pair)
            if k < retries and open_.isEmpty():
                break
        joined = keyed.join(done.withColumnRenamed("key", key), key).drop(key)
        return verdicts(joined, with_said)

    return run


def calibration(judged: DataFrame) -> DataFrame:
    """A row for each dimension: n, accuracy, kappa, and whether both dimensions agree often enough (``trusted``).

    judged: human_faithful, faithful, human_register, register. Both dimensions are
    counted in one pass.
    """
    sums = judged.agg(*[x for d in ("faithful", "register") for x in agreement_sums(F.col(f"human_{d}"), F.col(d), d)])
    trusted = F.least("accuracy_faithful", "accuracy_register") >= TRUSTED
    rows = [F.struct(F.lit(name).alias("dimension"), F.col(f"n_{d}").alias("n"), F.col(f"accuracy_{d}").alias("accuracy"), kappa_of(d).alias("kappa"), trusted.alias("trusted")) for name, d in (("faithfulness", "faithful"), ("register", "register"))]
    return sums.select(F.inline(F.array(*rows)))


def disagreements(judged: DataFrame) -> DataFrame:
    """Rows on which human and judge differ, with which dimensions agree."""
    agree = {f"{d}_agree": F.col(f"human_{d}") == F.col(d) for d in ("faithful", "register")}
    return judged.withColumns(agree).filter("NOT (faithful_agree AND register_agree)")


def labelled(labels: DataFrame) -> DataFrame:
    """Human labels (id, input, note as an object's text, human) as drafts with human_faithful and human_register."""
    return labels.select("id", "input", F.col("note").alias("draft"), F.col("human.faithful").alias("human_faithful"), F.col("human.meets_register").alias("human_register"))


#: Records of a labels file; ``note`` is kept as text, in the order of its keys.
LABELS = "id string, input string, note string, human struct<faithful:boolean,meets_register:boolean>"
