"""Command line: deid, draft, evaluate, generate, calibrate."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from noteloom.functions import pii as P
from noteloom.operators import drafting, judging, rows, served, suites, synthesis, verify
from noteloom.plans import report, scoring
from noteloom.rules import PLAN
from noteloom.runtime import Scratch
from noteloom.sources.jsonl import exists, load_split, read_jsonl, write_jsonl, write_splits

#: Records that ``generate`` shows.
PREVIEW = 5
RECORDS = "id string, stratum string, input string, target string, forbidden array<string>"


def text_of(args) -> str:
    """From the argument, the file or standard input; an empty text is an error."""
    text = args.text if args.text is not None else Path(args.file).read_text(encoding="utf-8") if args.file else sys.stdin.read()
    if not text.strip():
        raise SystemExit("no text given")
    return text.strip()


def model_of(spark: SparkSession, mode: str, examples, endpoint: served.Endpoint | None = None):
    """A model by its name: naive, golden, served (at ``endpoint``) or ``module:function`` over batches that adds ``draft``; with ``guarded-`` before it, scrubbed."""
    guarded, kind = mode.startswith("guarded-"), mode.removeprefix("guarded-")
    kinds = dict(drafting.MODELS, golden=drafting.golden(examples))
    if endpoint:
        kinds["served"] = served.model(endpoint)
    if ":" in kind:
        kinds[kind] = drafting.batched(served.named(kind), "draft string")
    model = drafting.build(kinds, kind)
    return drafting.guarded(model) if guarded else model


def judge_of(kind: str, endpoint: served.Endpoint | None = None):
    """A judge by its name: heuristic, served (at ``endpoint``) or ``module:function`` over batches that adds replies (``judging.judge_once``)."""
    kinds = dict(drafting.JUDGES)
    if endpoint:
        kinds["served"] = served.judge(endpoint)
    if ":" in kind:
        kinds[kind] = judging.judge_once(served.named(kind), with_said=True)
    return drafting.build(kinds, kind)


def endpoint_of(url: str | None, model: str | None) -> served.Endpoint | None:
    return served.Endpoint(url, model or "default") if url else None


def evaluate(spark: SparkSession, data: str, mode: str, split: str = "test", limit: int = 0, judge: str = "heuristic", at: served.Endpoint | None = None, judge_at: served.Endpoint | None = None) -> dict:
    """The scorecard of a model on a split and the suites. Drafts of models that are asked are written, so that no part of it asks twice."""
    examples = load_split(spark, data, split, RECORDS)
    if limit:
        examples = examples.orderBy("id").limit(limit)
    cases = suites.cases(spark)
    model = model_of(spark, mode, examples.select("input", "target").unionByName(cases.select("input", "target")), at)
    decide = None if judge == "heuristic" else judge_of(judge, judge_at)
    opaque = decide is not None or mode.removeprefix("guarded-") not in ("naive", "golden")
    scratch = Scratch(spark, "evaluate") if opaque else None
    kept = lambda df, name: scratch.write(df, name) if opaque else df
    scores = kept(verify.judged_scores(kept(model(examples.drop("target")), "drafts"), decide), "scores")
    outcome = scoring.suite_results(kept(verify.judged_cases(kept(model(cases.drop("target")), "answers"), decide), "outcome"))
    return report.scorecard(scores, outcome, mode, judge, split)


#: About how many records the first evaluation makes where there are none.
FIRST = 60


def first_records(spark: SparkSession, data: str) -> None:
    """Makes and splits a small set of records, in the shares of the usual plan."""
    share = FIRST / sum(PLAN.values())
    made = synthesis.dataset(spark, {s: max(1, round(n * share)) for s, n in PLAN.items()})
    write_splits(rows.stratified_split(made, "stratum", "id"), data)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="noteloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("deid", "draft"):
        p = sub.add_parser(name)
        p.add_argument("text", nargs="?")
        p.add_argument("--file")
        p.add_argument("--mode", default="guarded-naive")
    p = sub.add_parser("generate")
    p.add_argument("out")
    p.add_argument("--count", type=int, help="about so many records, evenly over the strata; without it the usual plan")
    p.add_argument("--judge", default="heuristic", help="heuristic, served, or module:function over batches")
    p.add_argument("--judge-url", help="chat completions endpoint of the judge")
    p.add_argument("--judge-model")
    p.add_argument("--teacher-url", help="chat completions endpoint that writes the targets; without it they are rendered")
    p.add_argument("--teacher-model")
    p = sub.add_parser("evaluate")
    p.add_argument("data")
    p.add_argument("--mode", default="golden", help="naive, golden, served, or module:function over batches; guarded- before it scrubs its drafts")
    p.add_argument("--model-url", help="chat completions endpoint of the model")
    p.add_argument("--model")
    p.add_argument("--judge", default="heuristic", help="heuristic, served, or module:function over batches")
    p.add_argument("--judge-url")
    p.add_argument("--judge-model")
    p.add_argument("--split", default="test")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--json")
    p.add_argument("--html")
    p.add_argument("--fail-on-block", action="store_true")
    p = sub.add_parser("calibrate")
    p.add_argument("labels")
    p.add_argument("--judge", default="heuristic")
    p.add_argument("--judge-url")
    p.add_argument("--judge-model")
    p.add_argument("--export")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("noteloom").getOrCreate()
    if args.command == "deid":
        df = spark.createDataFrame([(text_of(args),)], "text string")
        row = df.select(P.deidentify(F.col("text")).alias("text"), P.detected_types(F.col("text")).alias("types")).first()
        print(row.text)
        print(", ".join(row.types), file=sys.stderr)
    elif args.command == "draft":
        df = spark.createDataFrame([(text_of(args),)], "input string")
        print(model_of(spark, args.mode, spark.createDataFrame([], "input string, target string"))(df).first().draft)
    elif args.command == "generate":
        plan = rows.even_plan(args.count) if args.count is not None else PLAN
        judge = None if args.judge == "heuristic" else judge_of(args.judge, endpoint_of(args.judge_url, args.judge_model))
        teacher = endpoint_of(args.teacher_url, args.teacher_model)
        made = synthesis.dataset(spark, plan, judge=judge, teacher=served.model(teacher) if teacher else None).cache()
        for i, r in enumerate(made.orderBy("id").limit(PREVIEW).collect(), 1):
            print(f"record {i}: {r.stratum}")
        counts = {r.stratum: r["count"] for r in made.groupBy("stratum").count().collect()}  # one row for each stratum
        if (total := sum(counts.values())) > PREVIEW:
            print(f"and {total - PREVIEW} more")
        for stratum, wanted in sorted(plan.items()):
            print(f"  {stratum}: {counts.get(stratum, 0)}")
            if counts.get(stratum, 0) < wanted:
                print(f"warning: {stratum} is {wanted - counts.get(stratum, 0)} short of its plan", file=sys.stderr)
        write_splits(rows.stratified_split(made, "stratum", "id"), args.out).show()
        made.unpersist()
    elif args.command == "calibrate":
        if not exists(spark, args.labels):
            print(f"no labels: {args.labels}", file=sys.stderr)
            return 2
        judge = judge_of(args.judge, endpoint_of(args.judge_url, args.judge_model))
        judged = judge(judging.labelled(read_jsonl(spark, args.labels, judging.LABELS))).cache()
        found = judging.calibration(judged).collect()  # two rows
        for r in found:
            print(f"{r.dimension:<16}{r.accuracy:>8.1%}{r.kappa:>8.3f}  of {r.n}")
        differ = judging.disagreements(judged)
        print("differ:", ", ".join(r.id for r in differ.select("id").orderBy("id").limit(100).collect()) or "none")
        print("may be trusted" if found[0].trusted else "not calibrated")
        if args.export:
            write_jsonl(judged.withColumns({f"{d}_agree": F.col(f"human_{d}") == F.col(d) for d in ("faithful", "register")}), args.export)
        judged.unpersist()
    else:
        if not exists(spark, f"{args.data}/splits"):
            print(f"no records in {args.data}: making about {FIRST}", file=sys.stderr)
            first_records(spark, args.data)
        found = load_split(spark, args.data, args.split, RECORDS)
        if found.isEmpty():
            print(f"no records of split {args.split!r}", file=sys.stderr)
            return 2
        if absent := sorted(r.stratum for r in rows.coverage(found, "stratum").filter("n = 0").collect()):  # of six
            print(f"warning: no examples of {', '.join(absent)}", file=sys.stderr)
        card = evaluate(spark, args.data, args.mode, args.split, args.limit, args.judge, endpoint_of(args.model_url, args.model), endpoint_of(args.judge_url, args.judge_model))
        print(report.to_text(card))
        if args.json:
            report.write_json(card, args.json)
        if args.html:
            Path(args.html).write_text(report.to_html(card), encoding="utf-8")
        return int(args.fail_on_block and not card["release_ok"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
