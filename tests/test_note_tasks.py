"""How the notes come to tasks, and what their scores ask of a row."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from noteloom.functions import notes as N
from noteloom.functions import pii as P
from noteloom.plans import fixture
from noteloom.rules import EMAIL, GAP_WORDS, ID_NUMBER, PHONE, PHONE_WIDE

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_orders_are_dealt_by_key_and_without_texts(spark):
    """Dealt in turn, each task sorted all its notes, texts and all: 6.6 GB of one task at 9 million orders."""
    nodes, found = [fixture.notes(spark, str(DATA))._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("Repartition"):
            found.append(node)
    assert [x.nodeName() for x in found] == ["RepartitionByExpression"]
    columns = {found[0].output().apply(i).name() for i in range(found[0].output().size())}
    assert columns == {"o_orderkey", "o_custkey", "o_orderdate", "c_mktsegment"}


def nodes_of(df):
    nodes, found = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        found.append(node)
    return found


#: Queries that were found to hold all notes of a scan task in its memory.
DEALT = ["chat_training", "faith_fields", "faith_ids", "faith_numbers", "calibration_disagreements", "all_notes_suite_failures", "all_notes_suite_rates", "all_notes_suite_union"]


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", DEALT)
def test_queries_deal_keys_not_notes(spark, name):
    """What is dealt is four short columns of each order, by its key; dealt in turn, notes were sorted whole in each task."""
    import __spark_entry__ as entry

    dealt = [x for x in nodes_of(entry.queries()[name](spark, str(DATA))) if "artition" in x.nodeName()]
    assert [x.nodeName() for x in dealt] == ["RepartitionByExpression"]
    assert {dealt[0].output().apply(i).name() for i in range(dealt[0].output().size())} == {"o_orderkey", "o_custkey", "o_orderdate", "c_mktsegment"}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["struct_pass", "verify_filter", "overall_rates", "per_stratum", "verify_reasons"])
def test_generators_only_hand_on(spark, name):
    """An expression within a generator isn't compiled: every score was made there."""
    import __spark_entry__ as entry

    made = [x.generator().toString() for x in nodes_of(entry.queries()[name](spark, str(DATA))) if x.nodeName() == "Generate"]
    assert made and all(re.fullmatch(r"explode\(array\(\w+#\d+\)\)", x) for x in made)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["guard_note", "guard_changed"])
def test_contact_names_are_found_once_for_a_note(spark, name):
    """They were found again for every value and list item of the note."""
    import __spark_entry__ as entry

    plan = "\n".join(x.simpleString(10_000) for x in nodes_of(entry.queries()[name](spark, str(DATA))))
    assert plan.count("regexp_extract_all(input") == 2


ODD = ["", " ", " n/a ", "  NONE\n", "none.", "miſſing", "[MISSING]", "unKnown", "unk", "[missing] x", "\u0085", None, "a ", "​", "n/a\r\n", "x" * 50 + " "]


def test_strip_and_gap_words_keep_their_meaning(spark):
    """The quick looks before a pattern change no result."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string")
    plain = F.regexp_replace("s", r"(?U)^\s+|\s+$", "")
    got = df.select(N.strip(F.col("s")).alias("a"), plain.alias("b"), N.is_text_gap(F.col("s")).alias("c"), F.lower(plain).isin(*GAP_WORDS).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)


PERSONAL = ["a@b.c", "call 0491 570 737 now", "0491-570-73", "NDIS 430123", "ndis-4301", "+61 4 9157 0737", "١٢٣٤٥٦ NDIS١٢٣٤٥٦", "0١٢٣٤٥٦٧٨٩", "none", "", "(02) 9999 1234 5"]


@pytest.mark.parametrize("pattern", [EMAIL, ID_NUMBER, PHONE, PHONE_WIDE])
def test_what_matches_may_match(spark, pattern):
    df = spark.createDataFrame([(s,) for s in PERSONAL], "s string").select(F.rlike("s", F.lit(pattern)).alias("hit"), P.may_match(F.col("s"), pattern).alias("may"))
    rows = df.collect()
    assert any(r.hit for r in rows) and all(r.may for r in rows if r.hit)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_scores_that_nobody_reads_are_not_made(spark):
    import __spark_entry__ as entry

    plan = "\n".join(x.simpleString(10_000) for x in nodes_of(entry.queries()["struct_pass"](spark, str(DATA))))
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan


def test_text_of_a_reply_is_named_once(spark):
    """Steps that name their text more than once made the expression grow by a factor each."""
    plan = spark.range(1).select(N.json_text(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 5_000
