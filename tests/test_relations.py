"""Operators that relate rows to rows, against plain Python: patterns, runs, attempts, times, splits, look-ups, judges."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noteloom.operators import bucketed, contains, disjoint, first_k, judging, seen, stops, timeline


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# --- patterns ---------------------------------------------------------------------------------------

PATTERNS = ["the quick brown fox jumps", "QUICK brown", "quick brown fox", "fox", "x", "日本語の文", "no such words at all here", "", None, "the quick brown fox jumps", "end.", "a\nb line two and more", "é", "  "]
TEXTS = ["Tomcat: The Quick Brown Fox Jumps over", "thequick brown fox jumps", "fox", "FOXES", "これは日本語の文です", None, "", "a\nb LINE two and more words", "the end.", "x" * 5000 + " fox", "É", "the quick brown fox jumped", "the quick brown fox jumps", "the quick brown fox jumps", "a  b"]


def test_contained(spark):
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(TEXTS)], "doc_id long, text string, pattern string")
    patterns = spark.createDataFrame([(i, t) for i, t in enumerate(PATTERNS)], "item_id long, text string")
    got = contains.contained(docs, patterns, carry={"doc_id": "doc_id"}, carry_pattern={"item_id": "item_id"})
    want = Counter((i, k) for i, t in enumerate(TEXTS) for k, p in enumerate(PATTERNS) if t is not None and p and p.lower() in t.lower())
    assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want and len(want) > 20
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    for a, b in ((docs.limit(0), patterns), (docs, patterns.limit(0)), (docs, patterns.filter("text = ''"))):
        assert contains.contained(a, b, carry={"doc_id": "doc_id"}, carry_pattern={"item_id": "item_id"}).count() == 0


def test_a_common_pattern_takes_its_rarest_gram(spark):
    """Patterns that begin alike are tried only on texts with what is rare in them."""
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('common words begin each text and then ', CASE WHEN id % 100 = 7 THEN 'something singular' ELSE concat('plain', id) END, ' ends it') AS text")
    patterns = spark.createDataFrame([(1, "begin each text and then something singular ends")], "item_id long, text string")
    texts = docs.select(F.col("doc_id").alias("uid"), F.lower("text").alias("low"))
    keys = contains.pattern_keys(texts, patterns.select(F.lit("p").alias("pid"), F.col("text").alias("pattern")), contains.Scratch(spark, "test"))
    assert sorted(r.uid for r in keys.collect()) == [7, 107, 207, 307, 407, 507]


def test_random_patterns(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "c-d", "Éa", "zz zz", "q" * 14, "_", "9lives", "日本"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(150)]
    patterns = [t[a : a + rng.randint(1, 40)] for t in texts[:60] for a in [rng.randrange(len(t))]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(patterns)), "item_id long, text string")
    got = contains.contained(docs, items, carry={"doc_id": "doc_id"}, carry_pattern={"item_id": "item_id"}).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter((i, k) for i, t in enumerate(texts) for k, p in enumerate(patterns) if p.lower() in t.lower())


# --- runs -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("expected", [1_000_000, 6])
def test_runs(spark, tmp_path, expected):
    """Three runs keep what one would; a run that is repeated, and a filter that is far too small, change nothing."""
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", " Same ", "same", f"t{rng.randrange(60)}", f"u{i}"]), f"c{i}", "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string, word string")
    want, met = [], set()
    for i, t, *_ in rows:
        k = (t or "").strip().lower()
        if k not in met:
            want.append(i)
        met.add(k)
    store = seen.SeenKeys(spark, str(tmp_path / "seen"), expected)
    cuts = {1: (0, 100), 2: (100, 200), 3: (200, 300)}
    for order in ((1, 2, 3), (2,), (1, 3), (3, 3)):
        for run in order:
            a, b = cuts[run]
            out = store.new_rows(docs.filter(f"doc_id >= {a} AND doc_id < {b}"), run, "text", "doc_id")
            assert out.columns == docs.columns
            assert sorted(r.doc_id for r in out.collect()) == [i for i in want if a <= i < b], (order, run)
    assert store.new_rows(docs, 4, "text", "doc_id").count() == 0
    assert store.new_rows(docs.limit(0), 5, "text", "doc_id").count() == 0
    assert store.new_rows(spark.createDataFrame([(7, "brand new", "a", "b")], docs.schema), 6, "text", "doc_id").count() == 1


def test_the_filter_spares_new_keys(spark, tmp_path):
    """Of keys never kept, few pass the filter; of those kept, all do."""
    keys = spark.range(20_000).select(F.unhex(F.sha1(F.col("id").cast("string"))).alias("key"), "id")
    words = 20_000 // seen.KEYS_A_WORD
    bloom = keys.filter("id < 10000").groupBy(seen.word_of(F.col("key"), words).alias("word")).agg(F.bit_or(seen.bits_of(F.col("key"))).alias("bits"))
    asked = keys.withColumns({"word": seen.word_of(F.col("key"), words), "mine": seen.bits_of(F.col("key"))}).join(bloom, "word", "left")
    maybe = asked.filter(F.col("bits").bitwiseAND(F.col("mine")) == F.col("mine"))
    assert maybe.filter("id < 10000").count() == 10_000 and maybe.filter("id >= 10000").count() < 800


# --- ordered attempts ---------------------------------------------------------------------------------


def stopped(oks, target, rule):
    most, made, row = target * rule.factor + rule.slack, 0, 0
    if target <= 0:
        return 0, 0, 0, "made"
    for n, ok in enumerate(oks, 1):
        made, row = made + bool(ok), 0 if ok else row + 1
        if made >= target:
            return n, made, row, "made"
        if row >= rule.in_row:
            return n, made, row, "in_row"
        if n >= most:
            return n, made, row, "attempts"
    return len(oks), made, row, "open"


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_stop_rule(spark, block):
    rng = random.Random(block)
    rule = stops.StopRule(in_row=6, factor=1, slack=10)
    rows, targets, want = [], [], {}
    for g in range(40):
        share = rng.choice([0.0, 0.1, 0.3, 0.6, 1.0])
        oks = [None if rng.random() < 0.05 else rng.random() < share for _ in range(rng.randrange(0, 120))]
        target = rng.choice([0, 1, 5, 20, 500])
        targets.append((f"g{g}", target))
        want[f"g{g}"] = (target, *stopped(oks, target, rule))
        rows += [(f"g{g}", 3 * i, ok) for i, ok in enumerate(oks)]
    rows += [("no target", i, True) for i in range(9)]
    attempts = spark.createDataFrame(rows, "g string, n long, ok boolean").repartition(5)
    got = stops.stop_points(attempts, "g", "n", "ok", F.expr(f"n div {3 * block}"), spark.createDataFrame(targets, "g string, target long"), rule)
    assert {r.g: (r.target, r.attempts, r.made, r.in_row, r.reason) for r in got.collect()} == want
    assert {w[4] for w in want.values()} == {"made", "in_row", "attempts", "open"}


# --- times --------------------------------------------------------------------------------------------


def test_as_of(spark):
    rng = random.Random(2)
    left = [(i, rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, *range(60)]), "own") for i in range(400)]
    right = [(i, rng.choice([None, "a", "hot"]), rng.choice([None, *range(60)]), f"v{i}" if i % 9 else None) for i in range(200)]
    a = spark.createDataFrame(left, "id long, g string, t long, got string")
    b = spark.createDataFrame(right, "rid long, g string, t long, v string")
    out = timeline.as_of(a, b, ["g"], "t", {"rid": "last", "v": "value"}, tie="rid")
    assert out.columns == [*a.columns, "last", "value"]
    for r in out.collect():
        fit = [(t, i, v) for i, g, t, v in right if None not in (g, t, r.g, r.t) and g == r.g and t <= r.t]
        assert (r["last"], r["value"]) == (max(fit)[1:] if fit else (None, None))
    assert out.count() == 400
    assert timeline.as_of(a.limit(0), b, ["g"], "t", {"v": "value"}).count() == 0
    assert {r.value for r in timeline.as_of(a, b.limit(0), ["g"], "t", {"v": "value"}).collect()} == {None}


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_overlaps(spark, width):
    rng = random.Random(4)

    def some(n):
        return [(i, rng.choice([None, "a", "b"]), s, rng.choice([s, (s or 0) + rng.randrange(40), (s or 0) - 1, None])) for i in range(n) for s in [rng.choice([None, *range(-50, 50)])]]

    left, right = some(120), some(90) + some(3)
    a, b = (spark.createDataFrame(x, "id long, g string, s long, e long") for x in (left, right))
    spans = (F.col("s"), F.col("e"), F.col("s"), F.col("e"))
    fine = lambda x: None not in x[2:] and x[2] <= x[3]
    met = lambda x, y: fine(x) and fine(y) and x[2] <= y[3] and y[2] <= x[3]
    for on in ([], ["g"]):
        got = timeline.overlaps(a, b, spans, width, {"id": "l"}, {"id": "r"}, on)
        want = Counter((x[0], y[0]) for x in left for y in right if met(x, y) and (not on or x[1] is not None and x[1] == y[1]))
        assert Counter((r.l, r.r) for r in got.collect()) == want and want
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


# --- the first of each group ----------------------------------------------------------------------------


@pytest.mark.parametrize("most", [100_000, 50])
def test_first_k(spark, monkeypatch, most):
    monkeypatch.setattr(first_k, "MOST_HELD", most)
    rng = random.Random(5)
    rows = [(rng.choice([None, "é", "a", *(["hot"] * 5), f"g{rng.randrange(30)}"]), n, [n], "x") for n in rng.sample(range(5000), 2000)] + [("a", None, None, "y")]
    df = spark.createDataFrame(rows, "g string, n long, `a.b` array<long>, __group string").repartition(6)
    for k in (1, 3, 10_000):
        got = first_k.first_k(df, "g", "n", k)
        want = Counter()
        for g in {r[0] for r in rows}:
            for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1]))[:k]:
                want[r[0], r[1], r[3]] += 1
        assert got.columns == df.columns
        assert Counter((r[0], r[1], r[3]) for r in got.collect()) == want
    assert first_k.first_k(df, "g", "n", 0).count() == first_k.first_k(df.limit(0), "g", "n", 3).count() == 0
    few = first_k.first_k(df, "g", "n", 2)
    assert "MapInArrow" in plan_of(few) and "WindowGroupLimit" in plan_of(few)


# --- splits ---------------------------------------------------------------------------------------------


def test_disjoint(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "g", "h"]), rng.choice(["train", "val", "test", "other"]), rng.choice([None, "", " A", "a", "b", "c", f"d{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, split string, text string")
    bags = {s: Counter((g, (t or "").strip().lower()) for g, x, t in rows if x == s) for s in ("train", "val", "test")}
    pairs = (("train", "val"), ("train", "test"), ("val", "test"))
    got = disjoint.shared_texts(df, "lang", "split", "text").collect()
    want = Counter({(g, a, b): n for a, b in pairs for g in (None, "g", "h") if (n := sum(m for k, m in (bags[a] & bags[b]).items() if k[0] == g))})
    found = Counter()
    for r in got:
        found[r.grp, r.a, r.b] += r.n
    assert found == want
    counted = {(r.grp, r.a, r.b): (r.shared, r.only_a, r.only_b) for r in disjoint.split_overlap(df, "lang", "split", "text").collect()}
    count = lambda bag, g: sum(n for k, n in bag.items() if k[0] == g)
    assert counted == {(g, a, b): tuple(count(x, g) for x in (bags[a] & bags[b], bags[a] - bags[b], bags[b] - bags[a])) for a, b in pairs for g in (None, "g", "h")}
    apart = spark.createDataFrame([("g", "train", "a"), ("g", "test", "b")], df.schema)
    assert disjoint.shared_texts(apart, "lang", "split", "text").count() == 0


# --- look-ups and judges ----------------------------------------------------------------------------------


def test_bucketed_look_ups(spark):
    pairs = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", None, 1), (None, "of null", 1), ("é" * 5000, "long", 1)], "input string, draft string, n long")
    asked = spark.createDataFrame([(1, "a", "mine"), (2, "b", ""), (3, None, ""), (4, "é" * 5000, ""), (5, "zz", ""), (1, "a", "mine")], "id long, input string, __text string")
    known, table = bucketed.answers(pairs, "input", "draft", ["n"], 4), bucketed.Bucketed(asked, "input", 4)
    got = bucketed.look_up(table, known, "draft")
    assert Counter((r.id, r["__text"], r.draft) for r in got.collect()) == Counter([(1, "mine", "new"), (1, "mine", "new"), (2, "", None), (3, "", None), (4, "", "long"), (5, "", None)])
    for _ in range(2):
        plan = plan_of(bucketed.look_up(table, known, "draft"))
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    with pytest.raises(ValueError, match="buckets"):
        bucketed.look_up(table, bucketed.answers(pairs, "input", "draft", ["n"], 3), "draft")


def test_each_question_is_judged_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def ask(frames):
        import uuid

        for pdf in frames:
            replies = []
            for a, d in zip(pdf["input"], pdf["draft"]):
                (log / uuid.uuid4().hex).write_text(f"{a}|{d}")
                tried = sum(p.read_text() == f"{a}|{d}" for p in log.iterdir())
                good = d != "never" and (d != "second" or tried > 1)
                replies.append('{"is_faithful": true, "fabricated_claims": ["c"], "reasoning": "why"}' if good else "busy")
            yield pdf.assign(faithful_reply=replies, register_reply='{"meets_register": false, "score": 0.25, "issues": ["i", "j"]}', billable_reply='{"present": true}')

    rows = [(i, "q", d, i) for i, d in enumerate(["first"] * 40 + ["second"] * 5 + ["never"] * 3 + [None, None, ""])]
    df = spark.createDataFrame(rows, "id long, input string, draft string, key long").repartition(4)
    out = judging.judge_once(ask, retries=2, with_said=True)(df)
    got = {r.id: r for r in out.collect()}
    out.collect()
    assert Counter(p.read_text() for p in log.iterdir()) == {"q|first": 1, "q|second": 2, "q|never": 3, "q|None": 1, "q|": 1}
    assert len(got) == len(rows) and all(r.key == r.id for r in got.values())
    for i, _, d, _ in rows:
        assert got[i].faithful == (d != "never") and got[i].register is False and got[i].billable is True
        assert (got[i].faithful_said["items"], got[i].faithful_said.reasoning) == ((["c"], "why") if d != "never" else ([], None))
        assert (got[i].register_said["items"], got[i].register_said.score) == (["i", "j"], 0.25)
