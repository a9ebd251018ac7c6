"""Any model and judge: endpoints, functions by name, what they are asked, the gate, the command line."""

import json
import sys
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from noteloom import cli
from noteloom.operators import drafting, judging, served, synthesis, verify
from noteloom.plans import scoring

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors have no tests


@pytest.fixture
def endpoint():
    """An endpoint that drafts empty notes and judges by the words of a question; it keeps what it was asked, and fails on 'down'."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["messages"][-1]["content"]
            asked.append(body)
            if "down" in text:
                self.send_error(503)
                return
            if "is_faithful" in text:
                reply = {"is_faithful": "nothing of it" not in text, "fabricated_claims": ["nothing of it"] if "nothing of it" in text else []}
            elif "meets_register" in text:
                reply = {"meets_register": True, "score": 0.9}
            elif '"present"' in text:
                reply = {"present": True}
            else:
                reply = {"participant_id": "PRT-0001", "narrative_summary": text.rsplit("Notes:\n")[-1]}
            data = json.dumps({"choices": [{"message": {"content": "<think>well</think>" + json.dumps(reply)}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield served.Endpoint(f"http://127.0.0.1:{server.server_port}/v1/", "m", timeout=20), asked
    server.shutdown()


def test_served_model(spark, endpoint):
    at, asked = endpoint
    df = spark.createDataFrame([("a", "spoke {a} and \"b\"\n日本", 1), ("b", None, 2), ("c", "down", 3)], "id string, input string, place int")
    got = {r.id: r for r in served.model(at)(df).collect()}
    note = json.loads(got["a"].draft.split("</think>")[1])
    assert note["narrative_summary"] == "spoke {a} and \"b\"\n日本" and got["a"].input.startswith("spoke") and got["a"].place == 1
    assert got["c"].draft == "" and got["a"].latency_s > 0 and got["b"].draft
    assert [m["role"] for m in asked[0]["messages"]] == ["system", "user"] and asked[0]["model"] == "m"
    assert sum("down" in m["messages"][1]["content"] for m in asked) == at.tries
    assert served.model(at)(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="messages"):
        served.model(at)(df.withColumn("messages", F.lit(1)))


def test_served_judge(spark, endpoint):
    at, asked = endpoint
    rows = [(1, "x {y}", '{"a": 1}'), (2, "x {y}", '{"a": 1}'), (3, "x", "nothing of it"), (4, "down", "{}"), (5, None, None)]
    got = {r.id: r for r in served.judge(at, retries=0)(spark.createDataFrame(rows, "id int, input string, draft string")).collect()}
    assert [got[i].faithful for i in (1, 2, 3, 4, 5)] == [True, True, False, False, True]
    assert got[3].faithful_said["items"] == ["nothing of it"] and got[1].register_said.score == 0.9 and got[4].faithful_said["items"] == []
    first = Counter(m["messages"][1]["content"] for m in asked if "down" not in m["messages"][1]["content"])
    assert set(first.values()) == {1} and len(first) == 10  # three pairs of three questions, and the register of the fourth, whose question has no input


def deny(frames):
    for pdf in frames:
        yield pdf.assign(faithful_reply='{"is_faithful": false, "fabricated_claims": ["all"]}', register_reply='{"meets_register": true, "score": 1}', billable_reply="no idea")


def plain(frames):
    for pdf in frames:
        yield pdf.assign(draft="{}")


def test_gate_asks_the_judge_last(spark):
    drafts = synthesis.records(spark, 12).select("id", "stratum", "input", "draft", "forbidden")
    broken = drafts.withColumn("draft", F.when(F.col("stratum") == "incident", F.lit("{}")).when(F.col("stratum") == "routine_session", F.replace("draft", F.lit("during the visit"), F.lit("by 0491 570 156"))).otherwise(F.col("draft")))
    seen = spark.sparkContext.accumulator(0)

    def judge(frames):
        for pdf in frames:
            seen.add(len(pdf))
            fine = ~pdf["input"].str.contains("Read aloud")
            yield pdf.assign(faithful_reply=['{"is_faithful": %s}' % str(bool(x)).lower() for x in fine], register_reply='{"meets_register": true}', billable_reply='{"present": true}')

    stages = verify.reasons(broken.withColumn("stage", F.lit("mine")).drop("stage"), judging.judge_once(judge)).cache()
    count = {r["stage"]: r["count"] for r in stages.groupBy("stage").count().collect()}
    assert count["structure"] == 12 and count["pii"] == 12 and stages.count() == 72 and count["kept"] + count["faithfulness"] == 48
    open_ = stages.filter("stage IN ('kept', 'faithfulness')").select("input", "draft").distinct().count()
    assert seen.value == open_
    assert stages.filter("stage = 'faithfulness' AND NOT contains(input, 'Read aloud')").count() == 0 and count["faithfulness"] > 0
    kept = {r.id for r in verify.compliant(broken, judging.judge_once(judge)).collect()}
    assert kept == {r.id for r in stages.filter("stage = 'kept'").collect()} and verify.compliant(broken).columns == broken.columns
    assert verify.reasons(broken.limit(0), judging.judge_once(judge)).count() == 0


def test_scores_by_a_judge(spark):
    drafts = synthesis.records(spark, 4).drop("k")
    got = verify.judged_scores(drafts, judging.replies_judge(deny, with_said=True))
    assert got.columns == scoring.example_scores(drafts).columns
    assert got.filter("faithful OR passed OR billable OR NOT register OR register_score <> 1").count() == 0 and got.count() == 24
    same = verify.judged_scores(drafts, drafting.heuristic_judge).select("id", "faithful", "register", "billable", "passed")
    assert sorted(map(str, same.collect())) == sorted(map(str, scoring.example_scores(drafts).select(same.columns).collect()))


def test_records_of_a_teacher(spark, endpoint):
    at, asked = endpoint
    rendered = synthesis.records(spark, 12).select("input", "draft")
    fenced = drafting.golden(rendered.select("input", F.concat(F.lit("<think>{</think>```json\n"), "draft", F.lit("\n```")).alias("target")), ["target"])
    made = synthesis.dataset(spark, {"incident": 4, "routine_session": 4}, teacher=fenced)
    same = synthesis.dataset(spark, {"incident": 4, "routine_session": 4})
    assert sorted(map(str, made.collect())) == sorted(map(str, same.collect())) and made.count() == 8
    assert synthesis.dataset(spark, {"incident": 2}, teacher=served.model(at)).count() == 0 and asked  # its notes lack fields
    assert synthesis.dataset(spark, {"incident": 2}, judge=judging.judge_once(deny)).count() == 0
    with pytest.raises(ValueError, match="numbers"):
        synthesis.dataset(spark, spark.createDataFrame([("incident", 1)], "stratum string, n long"))


def test_first_run_of_the_command(spark, tmp_path, capsys):
    data, card = str(tmp_path / "d"), tmp_path / "card.json"
    assert cli.main(["evaluate", data, "--json", str(card)]) == 0
    assert "making about 60" in capsys.readouterr().err and json.loads(card.read_text())["release_ok"]
    assert spark.read.json(f"{data}/seed").count() == 58  # the plan's shares of 60, rounded


@pytest.fixture
def split_data(spark, tmp_path):
    rows = [("a", "incident", "x", "{}", "test"), ("b", "sparse_input", "y", "{}", "test")]
    cli.write_splits(spark.createDataFrame(rows, "id string, stratum string, input string, target string, split string"), str(tmp_path / "s"))
    return str(tmp_path / "s")


def test_judge_by_name(spark, tmp_path, split_data):
    card = tmp_path / "card.json"
    assert cli.main(["evaluate", split_data, "--judge", f"{__name__}:deny", "--fail-on-block", "--json", str(card)]) == 1
    told = json.loads(card.read_text())
    assert told["judge"] == f"{__name__}:deny" and {g["name"]: g["value"] for g in told["gates"]}["strata_faithfulness"] == 0
    assert {s["suite"]: s["pass_rate"] for s in told["suites"]} == {"fabrication": 0.0, "pii_leakage": 1.0, "missing_element": 1.0}


def test_served_model_and_judge_of_the_command(spark, tmp_path, split_data, endpoint):
    at, card = endpoint[0], tmp_path / "card.json"
    assert cli.main(["evaluate", split_data, "--mode", "guarded-served", "--model-url", at.url, "--judge", "served", "--judge-url", at.url, "--json", str(card)]) == 0
    told = json.loads(card.read_text())
    assert told["latency_s"]["n"] == told["n_examples"] == 2 and not told["release_ok"]


def test_unknown_judges(spark):
    for wrong in ("nobody", "served", f"{__name__}:none", "no.such.module:f"):
        with pytest.raises(ValueError):
            cli.judge_of(wrong)
    with pytest.raises(ValueError):
        cli.model_of(spark, "served", spark.createDataFrame([], "input string, target string"))
