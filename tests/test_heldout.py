"""Trials and replay on a table long enough for all of their rules."""

import pytest
from compare import duck_rows, spark_rows

from kinetrace.plans import oracle, queries

LONGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def longer():
    import duckdb

    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{LONGER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["heldout_smoke", "replay_timeline"])
def test_against_sql(spark, longer, name):
    df = queries.queries()[name](spark, LONGER)
    names, want = duck_rows(longer, oracle.oracle_sql()[name])
    assert sorted(df.columns) == names
    got = spark_rows(df)
    assert got == want
    if name == "replay_timeline":
        demo = [dict(zip(names, r, strict=True)) for r in got if "demo" in r]
        clean = [dict(zip(names, r, strict=True)) for r in got if "clean" in r]
        assert {r["anomaly_type"] for r in demo} - {""} == {"gyro_bias_drift", "accel_freeze", "clipping"}
        assert any(r["alert_active"] and r["anomaly_active"] for r in demo) and not any(r["anomaly_active"] for r in clean)
        assert {(r["sequence_name"], r["threshold"]) for r in demo} <= {(r["sequence_name"], r["threshold"]) for r in clean}
    else:
        found = [dict(zip(names, r, strict=True)) for r in got]
        assert len({r["anomaly_type"] for r in found}) == 15 and {r["severity"] for r in found} == {"small", "medium", "large"}
        assert any(r["event_detected_strict"] for r in found) and not all(r["event_detected_strict"] for r in found)
