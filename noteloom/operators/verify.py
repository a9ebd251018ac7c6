"""The compliance gate of training records, with any judge, and evaluation by any judge.

Checks that are expressions come first. A judge that is asked (a served model)
sees only the drafts that all of them let pass, and each distinct one once
(``judging.judge_once``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators.drafting import Transform
from noteloom.plans.scoring import example_scores, passing, suite_cases
from noteloom.runtime import Scratch, fresh_name, quoted

#: What a judge decides; the rest of the scores are expressions.
JUDGED = ("faithful", "register", "billable")


def compliant(drafts: DataFrame, judge: Transform | None = None) -> DataFrame:
    """The drafts (id, stratum, input, draft, forbidden) that may be trained on: sound in structure, without personal data, faithful.

    Without a judge faithfulness is found by expressions. With one, it alone says so;
    a null verdict is a no.
    """
    scored = example_scores(drafts, wanted=("structural", "pii_clean", *(() if judge else ("faithful",))))
    if judge is None:
        return scored.filter("structural AND pii_clean AND faithful").select(*drafts.columns)
    passed = scored.filter("structural AND pii_clean").select(*drafts.columns)
    return judge(passed).filter("faithful").select(*drafts.columns)


def reasons(drafts: DataFrame, judge: Transform) -> DataFrame:
    """``drafts`` with ``stage``: the first check that a draft fails (structure, pii, faithfulness), or kept. The judge sees what the others let pass."""
    stage = fresh_name(drafts, "stage")
    own = [quoted(c) for c in drafts.columns]
    scored = example_scores(drafts, wanted=("structural", "pii_clean")).select(*own, F.when(~F.col("structural"), "structure").when(~F.col("pii_clean"), "pii").alias(stage))
    scored = Scratch(drafts.sparkSession, "verify").write(scored, "scored")  # read twice below
    open_ = judge(scored.filter(F.col(stage).isNull()).drop(stage))
    verdict = F.when(F.coalesce(F.col("faithful"), F.lit(False)), "kept").otherwise("faithfulness")
    return scored.filter(F.col(stage).isNotNull()).unionByName(open_.select(*own, verdict.alias(stage)))


def judged_scores(drafts: DataFrame, judge: Transform | None = None) -> DataFrame:
    """``example_scores`` whose faithful, register and billable are the judge's; a null verdict counts against the note.

    A register score that the judge gives takes the place of the expression's; without
    one it is null.
    """
    scores = example_scores(drafts)
    if judge is None:
        return scores
    of = scores.columns
    plain = example_scores(drafts, wanted=("structural", "pii_clean"))  # the rest is the judge's
    judged = judge(plain)
    found = judged.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in JUDGED})
    said = "register_said" in judged.columns
    found = found.withColumn("register_score", F.col("register_said.score") if said else F.lit(None).cast("double"))
    return found.withColumn("passed", passing()).select(*of)


def judged_cases(cases: DataFrame, judge: Transform | None = None) -> DataFrame:
    """``scoring.suite_cases`` where the judge decides the cases of the suite of fabrications, and is asked about these only."""
    if judge is None:
        return suite_cases(cases)
    asked = judge(cases.filter("suite = 'fabrication'"))
    fine = F.coalesce(F.col("faithful"), F.lit(False))
    claims = F.array_join("faithful_said.items", "; ") if "faithful_said" in asked.columns else F.lit("")
    why = F.when(~fine, F.when(claims != "", claims).otherwise("judged unfaithful"))
    own = [quoted(c) for c in cases.columns]
    decided = asked.select(*own, why.alias("reason"), fine.alias("passed"))
    return decided.unionByName(suite_cases(cases.filter("suite IS DISTINCT FROM 'fabrication'")))
