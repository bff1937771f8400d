"""Averages whose rounding hangs on the order of adding."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from kinetrace.functions.columns import rounded
from kinetrace.operators import evaluate
from kinetrace.plans import oracle, queries
from kinetrace.sources import files

ROWS, TIE = 640, 0.0390625


def cents(rng, most: int, total: int) -> np.ndarray:
    """ROWS whole numbers from 0 to most with this sum."""
    out = rng.integers(0, most + 1, ROWS)
    while out.sum() != total:
        step = 1 if out.sum() < total else -1
        k = rng.integers(ROWS)
        out[k] = min(most, max(0, out[k] + step))
    return out


def added(values) -> float:
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


@pytest.fixture(scope="module")
def taxes() -> dict[int, list[float]]:
    rng = np.random.default_rng(3)
    return {s: (cents(rng, 8, 2500) / 100).tolist() for s in range(40)}


def test_sums_are_added_in_the_order_of_rows(spark, taxes):
    """On a tie the average is that of one row after the other, wherever the rows lie; others stay as they were."""
    rows = [(s, k, 1.0, 2.0, v, None) for s, vs in taxes.items() for k, v in enumerate(vs)] + [(None, k, 0.5, 1.0, v, 0.5) for k, v in enumerate(taxes[0])] + [(99, 0, 0.25, float("inf"), float("nan"), 0.1)]
    names = "experiment_id int, row int, event_detection_rate double, median_time_to_detect_s double, clean_alerts_per_min double, group_attribution_top1 double"
    folds = spark.createDataFrame(rows, names).repartition(7, F.rand(1))
    got = {r.experiment_id: r for r in evaluate.experiment_means(folds, ["row"]).collect()}
    assert len(got) == len(taxes) + 2
    assert {s: got[s].clean_alerts_per_min for s in taxes} == {s: added(vs) for s, vs in taxes.items()}
    assert got[None].clean_alerts_per_min == added(taxes[0]) and got[None].group_attribution_top1 == 0.5
    assert np.isnan(got[99].clean_alerts_per_min) and got[99].median_time_to_detect_s == float("inf")
    assert got[0].event_detection_rate == 1.0 and got[0].group_attribution_top1 is None


def test_only_averages_near_a_tie_are_added_again(spark):
    values = [(TIE, 640, True), (TIE + 2e-17, 640, True), (0.039062, 640, False), (TIE + 1e-12, 640, False), (TIE + 1e-12, 10**7, True), (float("nan"), 5, False), (None, 0, False)]
    df = spark.createDataFrame([(v, abs(v) if v is not None else None, n, want) for v, n, want in values], "x double, size_x double, n_x long, want boolean")
    assert [r[0] == r[1] for r in df.select(evaluate._order_decides("x", 6), "want").collect()] == [True] * len(values)


def test_leaderboard_equals_its_sql_on_ties(spark, taxes, tmp_path):
    """Suppliers' rows are mixed and lie in three files; the SQL adds them in the order of files and rows."""
    rng = np.random.default_rng(5)
    deal = rng.permutation(np.repeat(np.arange(len(taxes)), ROWS))
    at = {s: iter(vs) for s, vs in taxes.items()}
    tax = [next(at[s]) for s in deal]
    n = np.arange(len(deal))
    items = pd.DataFrame({"l_suppkey": deal, "l_linenumber": (n % 7 + 1).astype("int32"), "l_quantity": n % 50 + 1.0, "l_discount": 0.05, "l_tax": tax})
    (tmp_path / "lineitem.parquet").mkdir()
    for k, part in enumerate(np.array_split(n, 3)):
        items.iloc[part].to_parquet(tmp_path / "lineitem.parquet" / f"part-{k}.parquet", index=False)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    names, want = duck_rows(con, oracle.oracle_sql()["leaderboard"])
    got = queries.leaderboard(spark, str(tmp_path))
    assert sorted(got.columns) == names
    assert spark_rows(got) == want
    assert len({r[names.index("clean_alerts_per_min")] for r in want}) == 2


def test_sums_are_added_by_row_groups(spark, tmp_path, monkeypatch):
    """As engines that read row groups side by side add them: each by itself, whatever splits the session has."""
    monkeypatch.setattr(files, "SPLIT_BYTES", 1 << 14)
    rng, suppliers, half = np.random.default_rng(11), 400, 128_000
    deal = rng.permutation(np.repeat(np.arange(suppliers), ROWS))
    at = [iter((cents(rng, 8, 2500) / 100).tolist()) for _ in range(suppliers)]
    tax = np.array([next(at[s]) for s in deal])
    items = pd.DataFrame({"l_suppkey": deal, "l_linenumber": np.int32(1), "l_quantity": rng.integers(1, 51, len(deal)) * 1.0, "l_discount": 0.05, "l_tax": tax})
    items.to_parquet(tmp_path / "lineitem.parquet", index=False, row_group_size=half)
    rows = [np.flatnonzero(deal == s) for s in range(suppliers)]
    whole = [added(tax[k]) for k in rows]
    one_by_one = lambda x: np.add.accumulate(x)[-1]
    parted = [(one_by_one(tax[k[k < half]]) + one_by_one(tax[k[k >= half]])) / ROWS for k in rows]
    got = {r.experiment_id: r.clean_alerts_per_min for r in queries.leaderboard(spark, str(tmp_path)).collect()}
    want = [np.floor(v * 1e6 + 0.5) / 1e6 for v in parted]
    assert [got[s] for s in range(suppliers)] == want
    assert want != [np.floor(v * 1e6 + 0.5) / 1e6 for v in whole]
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) > 1 << 14


def test_ties_are_rounded_as_in_sql(spark):
    rng = np.random.default_rng(1)
    ties = (2 * np.arange(20_000) + 1) * 5 / 10**7
    values = pd.DataFrame({"x": np.concatenate([ties, -ties, ties + 37, rng.normal(size=1000), rng.normal(size=1000) * 1e12, [0.0, -0.0, -1e-9, 1e300, -1e308, np.inf, -np.inf]])})
    con = duckdb.connect()
    con.register("v", values)
    want = con.execute("SELECT x, round(x, 6) + 0.0 AS r FROM v").df()
    got = rounded(spark.createDataFrame(values).select(F.struct("x").alias("of"), "x")).toPandas()
    pairs = sorted(zip((r["x"] for r in got["of"]), got["x"]))
    assert pairs == sorted(zip(want["x"], want["r"]))
    odd = rounded(spark.createDataFrame([(float("nan"), 1), (None, 2)], "x double, n int")).collect()
    assert np.isnan(odd[0].x) and odd[1].x is None and odd[0].n == 1
