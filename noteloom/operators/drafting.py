"""Drafting and judging as registered transforms of DataFrames.

A model is a callable from a DataFrame with ``input`` to one with ``draft`` added,
a judge one from a DataFrame with ``input`` and ``draft`` to one with verdicts
added. Built-in ones are expressions; an opaque model or judge (a served language
model) is given as a function over batches and runs by ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.functions import notes as N
from noteloom.functions import pii as P
from noteloom.functions import scores as S
from noteloom.plans.scoring import parsed
from noteloom.rules import GAP_MARKER
from noteloom.runtime import Scratch, fresh_name, numbered

Transform = Callable[[DataFrame], DataFrame]


def naive(df: DataFrame) -> DataFrame:
    """A weak baseline that claims an hour, copies the input as narrative and leaves blanks."""
    kv = N.key_values(F.col("input"))
    got = lambda key, other="": F.coalesce(F.try_element_at(kv, F.lit(key)), F.lit(other))
    none = F.array().cast("array<string>")
    draft = F.to_json(
        F.struct(
            got("participant").alias("participant_id"),
            got("date").alias("date_of_service"),
            F.lit(60).alias("duration_minutes"),
            got("type", "Other").alias("service_type"),
            F.lit("").alias("goal_linkage"),
            got("location").alias("location"),
            got("worker").alias("staff_presented_by"),
            F.lit(True).alias("participant_present"),
            F.col("input").alias("narrative_summary"),
            F.lit("").alias("billable_evidence"),
            none.alias("outcomes_achieved"),
            F.lit(GAP_MARKER).alias("risk_management"),
            F.lit(False).alias("follow_up_needed"),
            F.lit(GAP_MARKER).alias("follow_up_notes"),
        )
    )
    return df.withColumn("draft", draft)


def golden(examples: DataFrame, order: list[str] | None = None) -> Transform:
    """Looks an input up among examples (input, target); an unknown one gets an empty object.

    Of examples with one input the last holds, by the columns ``order`` or, without
    them, as they are read: by file and place there, however a scan is cut.
    """

    def draft(df: DataFrame) -> DataFrame:
        target, at = fresh_name(df, "__target"), fresh_name(examples, "__place")
        known = examples if order else numbered(examples, Scratch(examples.sparkSession, "golden"), at)
        last = known.groupBy("input").agg(F.max_by("target", F.struct(*order) if order else F.col(at)).alias(target))
        return df.join(last, "input", "left").withColumn("draft", F.coalesce(target, F.lit("{}"))).drop(target)

    return draft


def guarded(model: Transform) -> Transform:
    """The model's drafts with personal data scrubbed; drafts without an object pass as they are."""

    def draft(df: DataFrame) -> DataFrame:
        drafts = model(df)
        name = fresh_name(drafts, "__note")
        df = parsed(drafts, name)
        names = fresh_name(df, "__names")
        clean = P.scrub_note(F.col(name), F.col(names))
        df = N.once(df, **{names: P.contact_names(F.col("input"))})
        return df.withColumn("draft", F.when(F.size(name) == 0, F.col("draft")).otherwise(F.to_json(clean))).drop(name, names)

    return draft


def batched(function: Callable[[Iterator], Iterator], added: str) -> Transform:
    """An opaque model or judge: ``function`` maps an iterator of pandas frames to frames with the ``added`` columns."""

    def run(df: DataFrame) -> DataFrame:
        extra = T._parse_datatype_string(added) if isinstance(added, str) else added
        return df.mapInPandas(function, T.StructType([*df.schema.fields, *extra.fields]))

    return run


def heuristic_judge(df: DataFrame) -> DataFrame:
    """Adds faithful, register and billable."""
    name = fresh_name(df, "__note")
    df = parsed(df, name)
    note = F.col(name)
    return df.withColumns(
        {"faithful": F.size(S.findings(F.col("input"), note)) == 0, "register": S.register_score(S.narrative(note)) >= 0.75, "billable": S.billable(note)}
    ).drop(name)


MODELS: dict[str, Transform] = {"naive": naive}
JUDGES: dict[str, Transform] = {"heuristic": heuristic_judge}


def build(registry: dict[str, Transform], kind: str) -> Transform:
    if kind not in registry:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(sorted(registry))}")
    return registry[kind]
