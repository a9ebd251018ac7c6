"""Sessions and visits over streams in parts, against plain Python over all rows."""

import random

from pyspark.sql import functions as F

from noteloom.streaming import sessions

SCHEMA = "user long, ts timestamp, id long, kind string, last string"
BASE = 1_700_000_000_000_000
GAP = 600


def events(spark, rows):
    made = spark.createDataFrame(rows, "user long, us long, id long, kind string, last string")
    return made.select("user", F.timestamp_micros("us").alias("ts"), "id", "kind", "last")


def grouped(rows, ends):
    """Runs of each user's rows in order, cut at gaps and, with ``ends``, after a row of kind end."""
    out, users = [], {}
    for u, t, i, kind, _ in rows:
        if t is not None:
            users.setdefault(u, []).append((t, i, kind))
    for u, mine in users.items():
        mine.sort()
        run = []
        for t, i, kind in mine:
            if run and (t - run[-1][0] > GAP * 1_000_000 or (ends and run[-1][2] == "end")):
                out.append((u, run))
                run = []
            run.append((t, i, kind))
        out.append((u, run))
    return sorted(((u, r[0][0], r[-1][0], len(r), ("done" if r[-1][2] == "end" else "idle") if ends else sum(x[2] == "end" for x in r)) for u, r in out), key=str)


def made(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = rng.choice([1, 1, 1, 2, 3, None, 40 + i])  # one of them has a large share
        rows.append((user, BASE + rng.randrange(0, 40_000) * 1_000_000 + rng.choice([0, 0, 1, 999]), i, rng.choice(["a", "b", "end"]), "x"))
    rows += [(2, BASE, 900, "end", None), (2, BASE, 901, "a", None), (2, BASE + GAP * 1_000_000, 902, "a", None), (5, None, 903, "a", None)]
    return rows


def test_parts_give_what_all_rows_give(spark):
    rows = made()
    df = events(spark, rows)
    ends = F.col("kind") == "end"
    visits = sessions.run_in_parts(df, "ts", lambda s: sessions.visits(s, "user", "ts", "id", ends, GAP, "20 minutes"), 3, "30 DAYS")
    got = [(r.user, r["first"], r["last"], r.n, r.outcome) for r in visits.collect()]
    assert sorted(got, key=str) == grouped(rows, True)
    build = lambda s: sessions.sessions(s, "user", "ts", f"{GAP} seconds", "20 minutes", [F.count_if(ends).alias("ends")])
    streamed = sessions.run_in_parts(df.drop("last"), "ts", build, 2, "30 DAYS")
    plain = lambda d: sorted(((r.user, r.a, r.b, r.n, r.ends) for r in d.select("user", F.unix_micros("first").alias("a"), F.unix_micros("last").alias("b"), "n", "ends").collect()), key=str)
    assert plain(streamed) == grouped(rows, False) == plain(build(df))  # the same as a table


def test_rows_out_of_order_and_too_late(spark):
    """Rows wait for those within the lateness; what comes later than that is dropped and counted."""
    t = lambda seconds: BASE + seconds * 1_000_000
    first = [(1, t(5000), 3, "a", ""), (1, t(4900), 2, "a", ""), (2, t(5000), 4, "end", "")]
    second = [(1, t(4950), 5, "end", ""), (1, t(100), 6, "a", ""), (1, t(9000), 7, "a", ""), (3, t(200), 8, "a", "")]
    third = [(1, t(90_000), 9, "a", "")]
    df = events(spark, first + second + third)
    stream = sessions.Parts(spark, df.schema, lambda s: sessions.visits(s, "user", "ts", "id", F.col("kind") == "end", GAP, "1000 seconds"))
    for part in (first, second, third):
        stream.add(events(spark, part))
    got = sorted((r.user, r["first"], r["last"], r.n, r.outcome) for r in stream.result().collect())
    assert got == [(1, t(4900), t(4950), 2, "done"), (1, t(5000), t(5000), 1, "idle"), (1, t(9000), t(9000), 1, "idle"), (2, t(5000), t(5000), 1, "done")]
    assert stream.late == 2


def test_no_rows(spark):
    df = events(spark, made(1)).limit(0)
    assert sessions.run_in_parts(df, "ts", lambda s: sessions.visits(s, "user", "ts", "id", F.lit(False), GAP, "1 hour"), 2, "1 DAY").count() == 0
