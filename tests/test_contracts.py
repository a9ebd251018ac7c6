"""Kinds of personal data, last answers, names that clash, judges that fail, calibration, chat, plans, settings, synthesis."""

import json

import pytest
from pyspark.sql import functions as F

from noteloom.cli import main
from noteloom.functions import notes as N
from noteloom.functions import pii as P
from noteloom.functions import scores as S
from noteloom.operators import chat, drafting, judging, rows, suites, synthesis
from noteloom.plans import scoring
from noteloom.rules import FIELDS, PLAN, load_rules, load_settings

RULES = load_rules()


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "kinds"), [("ring mum on 0491 570 006", {"PHONE"}), ("ph 03 5550 4567, mail a.b@post.example, NDIS-430998", {"PHONE", "EMAIL", "NDIS_NUM"}), ("A quiet visit at the centre.", set())])
def test_kinds_have_no_brackets(spark, text, kinds):
    assert set(one(spark, text, P.detected_types)) == kinds
    df = P.with_deidentified(spark.createDataFrame([(text, 1)], "x string, hit int"), "x", "clean", "labels")
    r = df.first()
    assert df.columns == ["x", "hit", "clean", "labels"] and r.clean == one(spark, text, P.deidentify) and r.labels == one(spark, text, P.deidentified_types)
    if not kinds:
        assert r.clean == text


def test_last_answer_holds(spark):
    examples = spark.createDataFrame([("a", "z-first", 1), ("a", "a-last", 2), ("b", "x", 3)], "input string, target string, n int").coalesce(1)
    asked = spark.createDataFrame([("a", "own"), ("c", "own")], "input string, __target string")
    for model in (drafting.golden(examples), drafting.golden(examples, ["n"]), drafting.golden(examples.orderBy(F.desc("n")), ["n"])):
        assert {r.input: (r.draft, r["__target"]) for r in model(asked).collect()} == {"a": ("a-last", "own"), "c": ("{}", "own")}


def test_names_that_clash(spark):
    df = spark.createDataFrame([(i, "s", 7, 8, "old") for i in range(20)], "id long, stratum string, place int, of int, split string")
    out = rows.stratified_split(df, "stratum", "id")
    assert out.columns == df.columns and {(r.place, r.of) for r in out.collect()} == {(7, 8)} and {r.split for r in out.collect()} == {"test", "val", "train"}
    with pytest.raises(ValueError, match="already"):
        rows.placed(df, "stratum", "id", F.lit(0))
    drafts = spark.createDataFrame([("i", "routine_session", "x", json.dumps(suites.ideal_note()), [], "mine", "t")], "id string, stratum string, input string, draft string, forbidden array<string>, note string, __t string")
    scored = scoring.example_scores(drafts).first()
    assert scored.note == "mine" and scored["__t"] == "t" and scored.structural
    assert drafting.guarded(lambda d: d)(drafts).first().note == "mine" and drafting.heuristic_judge(drafts).first().note == "mine"
    with pytest.raises(ValueError, match="already"):
        scoring.parsed(drafts)


@pytest.mark.parametrize(
    ("reply", "question", "want"),
    [
        ('{"is_faithful": true}', "faithful", True),
        ('<think>{"is_faithful": false}</think>```json\n{"is_faithful": "Yes", "fabricated_claims": []}\n```', "faithful", True),
        ('{"is_faithful": false, "fabricated_claims": ["a"]}', "faithful", False),
        ('{"is_faithful": true, "fabricated_claims": [1]}', "faithful", False),
        ('{"is_faithful": true, "reasoning": null}', "faithful", False),
        ("", "faithful", False),
        (None, "faithful", False),
        ("timeout", "faithful", False),
        ('{"meets_register": true, "score": 0.8, "issues": []}', "register", True),
        ('{"meets_register": true, "score": 1.5}', "register", False),
        ('{"present": 1}', "billable", True),
        ('{"present": "maybe"}', "billable", False),
    ],
)
def test_judge_that_fails_lets_nothing_pass(spark, reply, question, want):
    assert one(spark, reply, lambda c: judging.verdict(c, question)) is want


def test_replies_judge(spark):
    def ask(frames):
        for pdf in frames:
            good = pdf.draft.str.len() > 2
            yield pdf.assign(faithful_reply=['{"is_faithful": true}' if g else "no idea" for g in good], register_reply='{"meets_register": true}', billable_reply=None)

    df = spark.createDataFrame([("a", "{}"), ("b", '{"a":1}')], "input string, draft string")
    out = judging.replies_judge(ask)(df)
    assert out.columns == ["input", "draft", "faithful", "register", "billable"]
    assert {r.input: (r.faithful, r.register, r.billable) for r in out.collect()} == {"a": (False, True, False), "b": (True, True, False)}


def test_calibration(spark, tmp_path, capsys):
    good = suites.ideal_note()
    text = suites.said(good, "did: a walk")
    informal = good | {"narrative_summary": "um we went"}
    made_up = good | {"duration_minutes": 77}
    cases = [(good, True, True), (good, True, True), (informal, True, False), (made_up, False, True)] * 3 + [(good, False, True)]
    (tmp_path / "labels.jsonl").write_text("".join(json.dumps({"id": f"l{i:02d}", "input": text, "note": n, "human": {"faithful": f, "meets_register": m}}) + "\n" for i, (n, f, m) in enumerate(cases)))
    assert main(["calibrate", str(tmp_path / "labels.jsonl"), "--export", str(tmp_path / "review")]) == 0
    said = capsys.readouterr().out
    assert "92.3%" in said and "100.0%" in said and "differ: l12" in said and "may be trusted" in said
    assert spark.read.json(str(tmp_path / "review")).filter("NOT faithful_agree").count() == 1
    (tmp_path / "bad.jsonl").write_text("".join(json.dumps({"id": str(i), "input": text, "note": good, "human": {"faithful": i > 2, "meets_register": True}}) + "\n" for i in range(6)))
    assert main(["calibrate", str(tmp_path / "bad.jsonl")]) == 0 and "not calibrated" in capsys.readouterr().out
    assert main(["calibrate", str(tmp_path / "none")]) == 2


def test_generate_evaluate_and_chat(spark, tmp_path, capsys):
    out = str(tmp_path / "d")
    assert main(["generate", out, "--count", "50"]) == 0
    said = capsys.readouterr()
    assert "record 5: " in said.out and "and 43 more" in said.out and said.out.count(": 8\n") == 6 and "short" not in said.err
    assert rows.even_plan(50) == {s: 8 for s in PLAN} and set(rows.even_plan(1).values()) == {1}
    messages = chat.load_chat(spark, out, "train").collect()
    for r in messages:
        system, user, assistant = r.messages
        assert (system.role, user.role, assistant.role) == ("system", "user", "assistant")
        asked = [user.content.index(f) for f, _, _ in FIELDS]
        assert asked == sorted(asked) and list(json.loads(assistant.content)) == [f for f, _, _ in FIELDS]
    with pytest.raises(FileNotFoundError):
        chat.load_chat(spark, str(tmp_path / "none"), "train")
    assert main(["evaluate", out, "--split", "test"]) == 0
    (tmp_path / "few").mkdir()
    one_stratum = spark.createDataFrame([("a", "incident", "x", "{}", "test")], "id string, stratum string, input string, target string, split string")
    from noteloom.sources.jsonl import write_splits

    write_splits(one_stratum, str(tmp_path / "few"))
    capsys.readouterr()
    main(["evaluate", str(tmp_path / "few")])
    assert "no examples of" in capsys.readouterr().err
    assert main(["evaluate", str(tmp_path / "few"), "--split", "val"]) == 2


def test_rules_and_settings_from_files(tmp_path):
    (tmp_path / "r.yaml").write_text("required_fields:\n- {field: b, type: integer, required: true, format: minutes, description: how long}\n- {field: a, type: string, options: [x, y]}\nstructure_order: [b, a]\n")
    rules = load_rules(str(tmp_path / "r.yaml"))
    assert (rules.names, rules.required, rules.order, rules.options, rules.hints) == (["b", "a"], ["b"], ("b", "a"), {"a": ("x", "y")}, {"b": {"format": "minutes", "description": "how long"}})
    (tmp_path / "s.yaml").write_text("training: {batch_size: 4}\nlora: {r: 8}\n")
    made = load_settings(str(tmp_path / "s.yaml"))
    assert (made.training["batch_size"], made.lora["r"], made.lora["alpha"], made.serving["dtype"]) == (4, 8, 32, "float16")
    (tmp_path / "t.yaml").write_text("training: {batchsize: 4}\n")
    with pytest.raises(ValueError, match="batchsize"):
        load_settings(str(tmp_path / "t.yaml"))


def test_synthetic_records(spark):
    """What a record must be, asked of its own text: nothing of the generator is used."""
    made = synthesis.records(spark, 300).collect()
    assert len({r.id for r in made}) == len(made) == 1800
    lines = {"participant_id": "participant:", "date_of_service": "date:", "duration_minutes": "duration ~", "service_type": "type:", "goal_linkage": "goal:", "location": "location:", "staff_presented_by": "worker:", "outcomes_achieved": "outcome:", "billable_evidence": "evidence:"}
    left_out, contacts = set(), set()
    for r in made:
        note = json.loads(r.draft)
        assert list(note) == [f for f, _, _ in FIELDS]
        gone = {f for f in lines if note[f] in ("[not recorded]", -1, [])}
        assert gone == {f for f, key in lines.items() if key not in r.input}
        assert (len(gone) == 1) if r.stratum == "adv_missing_field" else (1 <= len(gone) <= 3) if r.stratum == "sparse_input" else not gone
        left_out |= gone
        text = json.dumps(note)
        assert bool(r.forbidden) == (r.stratum == "adv_pii_check")
        for secret in r.forbidden:
            assert secret in r.input and secret not in text
        contacts |= set(r.forbidden)
        if note["participant_id"] != "[not recorded]":
            assert note["participant_id"] in r.input
        else:
            assert "PRT-" not in r.input and "PRT-" not in text
    assert left_out == set(lines) and len(contacts) >= 25
    again = synthesis.records(spark, 300).repartition(7).collect()
    assert sorted(map(str, again)) == sorted(map(str, made))
    assert sorted(map(str, synthesis.records(spark, 300, seed=7).collect())) != sorted(map(str, made))


def test_synthetic_records_pass_the_gate(spark):
    scored = scoring.example_scores(synthesis.records(spark, 60))
    assert scored.filter("NOT (structural AND pii_clean AND faithful AND register)").count() == 0
    gaps = scoring.parsed(synthesis.records(spark, 60).filter("stratum = 'adv_missing_field'")).select(S.gaps(F.col("note"), RULES).alias("g"), "missing").collect()
    assert all(r.missing == f",{','.join(r.g)}," for r in gaps)


def test_quantiles_of_wide_values(spark):
    """Values of any size: a group's windows hold shares of it, and its quantiles stay exact."""
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.pow(F.lit(1.5), F.col("id") % 90) * 1000).alias("t"))
    got = {r.g: (r.n, r.p50, r.p95, r["max"]) for r in scoring.latency_stats(df, "t", "g").collect()}
    for g in "ab":
        v = sorted(r.t for r in df.filter(F.col("g") == g).collect())
        n = len(v)
        assert got[g] == (n, round(v[int(0.5 * (n - 1))], 3), round(v[int(0.95 * (n - 1))], 3), round(v[-1], 3))


def test_compact(spark):
    assert one(spark, '{ "b" : 1,\n "a": [1, 2] }', chat.compact) == '{"b":1,"a":[1,2]}'
    assert one(spark, "no object", chat.compact) == "no object" and one(spark, None, N.drop_think) is None
