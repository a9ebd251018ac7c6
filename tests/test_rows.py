"""Places, duplicates, look-ups and rates when the caller's columns have any names."""

import pytest
from pyspark.sql import functions as F

from noteloom.operators import drafting, judging, rows
from noteloom.plans import scoring

HELPERS = ("__bucket", "__inside", "__group", "__b", "__before", "__n", "__first", "__h", "__key", "__place", "__of")


def test_own_columns_come_back(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"), *[F.concat(F.lit(h), F.col("id").cast("string")).alias(h) for h in HELPERS], F.lit("dot").alias("a.b"))
    out = rows.placed(df, "g", "id", F.expr("id div 7")).collect()
    assert all(r[h] == f"{h}{r.id}" for r in out for h in HELPERS)
    assert {r.id: (r.place, r.of) for r in out} == {i: (i // 3 + 1, 14 if i % 3 == 0 else 13) for i in range(40)}
    split = rows.stratified_split(df, "g", "id").collect()
    assert len(split) == 40 and all(r[h] == f"{h}{r.id}" for r in split for h in HELPERS)
    first = rows.dedup_first(df, "g", "id")
    assert sorted(r.id for r in first.collect()) == [0, 1, 2] and first.columns == df.columns


def test_last_answer_of_files(spark, tmp_path):
    """Without an order, the example that stands last in its files holds, however their scan is cut."""
    spark.createDataFrame([(i % 5, f"answer {i}", i) for i in range(1000)], "input long, target string, __place long").coalesce(1).write.parquet(str(tmp_path / "e"))
    examples = spark.read.parquet(str(tmp_path / "e")).withColumn("input", F.col("input").cast("string"))
    asked = spark.createDataFrame([(str(i),) for i in range(6)], "input string")
    spark.conf.set("spark.sql.files.minPartitionNum", 9)
    try:
        got = {r.input: r.draft for r in drafting.golden(examples)(asked).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == {**{str(i): f"answer {995 + i}" for i in range(5)}, "5": "{}"}


@pytest.mark.parametrize("n", [0, 1, 7])
def test_rollup_of_few(spark, n):
    rows_ = [(None if i % 2 else "s", i % 3 == 0, True, True, False, True, i % 2 == 0) for i in range(n)]
    df = spark.createDataFrame(rows_, "stratum string, structural boolean, faithful boolean, pii_clean boolean, register boolean, billable boolean, passed boolean")
    got = {(r.overall, r.stratum): (r.n, r.structural) for r in scoring.rates_rollup(df).collect()}
    groups = {(1, None): rows_, (0, None): [r for r in rows_ if r[0] is None], (0, "s"): [r for r in rows_ if r[0]]}
    want = {k: (len(v), sum(r[1] for r in v) / len(v)) for k, v in groups.items() if v}
    assert got == want


def test_gates_of_no_cases(spark):
    schema = "suite string, case_passed boolean, structural boolean, faithful boolean, pii_clean boolean, register boolean, billable boolean"
    assert all(r.value == 1.0 and r.passed for r in scoring.gate_rows(spark.createDataFrame([], schema)).collect())
    some = spark.createDataFrame([("fabrication", i > 0, True, True, True, True, True) for i in range(4)], schema)
    got = {r["name"]: (r.value, r.passed) for r in scoring.gate_rows(some).collect()}
    assert len(got) == 8 and got["suite_fabrication"] == (0.75, False) and got["suite_pii_leakage"] == (1.0, True)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scan(spark, tmp_path):
    schema = "human_faithful boolean, faithful boolean, human_register boolean, register boolean"
    spark.createDataFrame([(True, False, True, True)] * 9 + [(False, False, False, False)], schema).write.parquet(str(tmp_path / "j"))
    made = judging.calibration(spark.read.parquet(str(tmp_path / "j")))
    assert plan_of(made).count("FileScan") == 1
    assert {r.dimension: (r.n, r.accuracy, r.trusted) for r in made.collect()} == {"faithfulness": (10, 0.1, False), "register": (10, 1.0, False)}


@pytest.mark.parametrize("by", [None, "g"])
def test_latency_of_ties_nulls_and_groups(spark, by):
    df = spark.createDataFrame([("a", 0.0)] * 3 + [("a", 5.0)] * 4 + [("a", None)] + [("zero", 0.0)] * 5 + [(None, 2.5), (None, -1.0)], "g string, v double")
    got = {r[by] if by else "all": (r.n, r.p50, r.p95, r["max"]) for r in scoring.latency_stats(df, "v", by).collect()}
    assert got == ({"a": (7, 5.0, 5.0, 5.0), None: (2, -1.0, -1.0, 2.5)} if by else {"all": (14, 0.0, 5.0, 5.0)})
    assert scoring.latency_stats(df.limit(0), "v", by).count() == 0
