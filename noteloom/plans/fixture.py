"""Notes derived from orders, with faults injected by the order key, in SQL that both engines read.

A note for each order: ``k``, ``id``, ``stratum``, ``input`` (key: value lines),
``draft`` (JSON text, some of it wrapped, broken, or with wrong values) and
``forbidden`` (strings that must not appear, joined by |).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.rules import FIELDS, STRATA

#: Value of each field as JSON text; faults where the key divides.
VALUES = {
    "participant_id": """CASE WHEN k % 31 = 0 THEN '"[not recorded]"' ELSE '"' || pid || '"' END""",
    "date_of_service": """CASE WHEN k % 29 = 0 THEN '""' WHEN k % 97 = 0 THEN '"05/04/2025"' ELSE '"' || day || '"' END""",
    "duration_minutes": """CASE WHEN k % 13 = 0 THEN '-1' WHEN k % 17 = 0 THEN '2000' WHEN k % 89 = 0 THEN '45.5' ELSE minutes END""",
    "service_type": """CASE WHEN k % 37 = 0 THEN '"Other support"' ELSE '"' || seg || '"' END""",
    "goal_linkage": """CASE WHEN k % 7 = 1 THEN '"Travel alone"' ELSE '"Cook at home"' END""",
    "location": """CASE WHEN k % 67 = 0 THEN 'null' ELSE '"Community hub"' END""",
    "staff_presented_by": """CASE WHEN k % 71 = 0 THEN '"WKR-X99"' ELSE '"' || worker || '"' END""",
    "participant_present": """CASE WHEN k % 47 = 0 THEN '"yes"' WHEN k % 2 = 0 THEN 'true' ELSE 'false' END""",
    "narrative_summary": """'"' || CASE WHEN k % 23 = 0 THEN 'We worked' ELSE 'Worked' END || ' with ' || pid || ' on ' || seg || ' and set out the next steps together'
        || CASE WHEN k % 7 = 0 THEN ' for 987654 points' ELSE '' END || CASE WHEN k % 19 = 0 THEN ' after a call to 0491 570 737' ELSE '' END
        || CASE WHEN k % 25 = 0 THEN ' with Odile Fern' ELSE '' END || CASE WHEN k % 33 = 0 THEN ' via odile.fern@mail.example' ELSE '' END
        || CASE WHEN k % 23 = 0 THEN '' ELSE '.' END || '"'""",
    "billable_evidence": """CASE WHEN k % 11 = 0 THEN '"[missing]"' WHEN k % 27 = 0 THEN '"Two words"' ELSE '"Support hours confirmed by log"' END""",
    "outcomes_achieved": """CASE WHEN k % 53 = 0 THEN '"single"' WHEN k % 73 = 0 THEN '[]' WHEN k % 107 = 0 THEN '["Met peers",7]' WHEN k % 5 = 0 THEN '["Made a call","Met Odile Fern"]' ELSE '["Practised travel","Met peers"]' END""",
    "risk_management": """CASE WHEN k % 3 = 0 THEN '"No new risks seen"' ELSE '"[not recorded]"' END""",
    "follow_up_needed": """CASE WHEN k % 4 = 0 THEN 'true' ELSE 'false' END""",
    "follow_up_notes": """CASE WHEN k % 4 = 0 THEN '"Call back in May"' WHEN k % 4 = 1 THEN '"n/a"' ELSE 'null' END""",
}


def _object() -> str:
    goal, place = "'\"goal_linkage\":' || j_goal_linkage", "'\"location\":' || j_location"
    parts = []
    for name, _, _ in FIELDS:
        part = f"'\"{name}\":' || j_{name}"
        if name == "goal_linkage":
            part = f"CASE WHEN k % 43 = 0 THEN {place} ELSE {goal} END"
        elif name == "location":
            part = f"CASE WHEN k % 43 = 0 THEN {goal} ELSE {place} END"
        elif name == "billable_evidence":
            part = f"CASE WHEN k % 41 = 0 THEN '\"extra\":1' ELSE {part} END"
        parts.append(part)
    return "'{' || " + " || ',' || ".join(parts) + " || CASE WHEN k % 83 = 0 THEN '' ELSE '}' END"


def notes_sql(day: str, joined: str = "orders JOIN customer ON o_custkey = c_custkey") -> str:
    """The notes as a query over orders and customer. day: an expression for o_orderdate as yyyy-mm-dd. joined: the rows that notes are made from."""
    strata = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STRATA))
    values = ",\n".join(f"{sql} AS j_{name}" for name, sql in VALUES.items())
    return f"""
    SELECT k, id, stratum, input, forbidden,
           CASE WHEN k % 59 = 0 THEN '```json' || chr(10) || body || chr(10) || '```'
                WHEN k % 61 = 0 THEN '<think>a {{ plan }}' || chr(10) || 'or two</think> ' || body
                WHEN k % 79 = 0 THEN 'Here it is: ' || body || ' Done.'
                ELSE body END AS draft
    FROM (
        SELECT k, 'ord-' || cast(k AS string) AS id,
               CASE k % 6 {strata} END AS stratum,
               'worker: ' || worker || chr(10)
                 || CASE WHEN k % 6 = 3 AND k % 4 = 3 THEN '' ELSE 'date: ' || day || chr(10) END
                 || 'participant: ' || pid || chr(10) || 'type: ' || seg || '; location: Community hub' || chr(10)
                 || CASE WHEN k % 13 = 0 THEN '' ELSE 'duration ~' || minutes || ' min' || chr(10) END
                 || CASE WHEN k % 5 = 0 THEN 'note: call mum Odile Fern or Dr Lee on 0491 570 737 or NDIS 4301234' ELSE 'note: done: all' END AS input,
               CASE WHEN k % 5 = 0 THEN 'Odile|0491 570 737' ELSE '' END AS forbidden,
               {_object()} AS body
        FROM (
            SELECT *, {values}
            FROM (
                SELECT o_orderkey AS k, 'PRT-' || lpad(cast(o_custkey % 10000 AS string), 4, '0') AS pid, {day} AS day,
                       cast(30 + o_orderkey % 91 AS string) AS minutes, c_mktsegment AS seg, 'WKR-' || cast(o_orderkey % 40 AS string) AS worker
                FROM {joined}
            ) a
        ) b
    ) c
    """


DUCK_NOTES = notes_sql("strftime(o_orderdate, '%Y-%m-%d')")


#: Bytes of orders or customers that make a task of notes.
BYTES_A_TASK = 1 << 19


def size_of(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, df: DataFrame, path: str, by: str) -> DataFrame:
    """A scan task's worth of keys makes minutes of scoring: deals them to tasks by the size of the table at ``path``, not of the cluster.

    By a key's hash: dealt in turn, a task would first sort all its rows, so that a repeated one deals them alike.
    """
    return df.repartition(max(spark.sparkContext.defaultParallelism, size_of(spark, path) // BYTES_A_TASK), by)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived notes: k, id, stratum, input, forbidden (array), draft. Orders are dealt to tasks before their texts are made: a few numbers each, not a page."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    spread(spark, both, f"{sf_dir}/orders.parquet", "o_orderkey").createOrReplaceTempView("noteloom_note_rows")
    made = spark.sql(notes_sql("date_format(o_orderdate, 'yyyy-MM-dd')", "noteloom_note_rows"))
    return made.withColumn("forbidden", F.filter(F.split("forbidden", r"\|"), lambda x: x != ""))
