"""Some of the registered queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
NAMES = ("parse_json_note", "kv_parse", "deid_types", "guard_scrub", "per_stratum", "all_notes_gates", "latency_stats", "dedup_first", "stratified_split", "golden_lookup", "synth_records")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = db.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v
    rows = lambda df: sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=Path(__file__).parent.parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
