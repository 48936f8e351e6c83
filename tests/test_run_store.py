"""Incidents by run, and stored keys in buckets."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from pressline.operators import run_store, store
from pressline.operators.stored_keys import KeyTable

COLUMNS = "title STRING, summary STRING, date DATE, location STRING, lat DOUBLE, lon DOUBLE, url STRING, federal STRING, type STRING"


def incidents(spark, dated):
    rows = [("t", "s", day, "l", 1.0, 2.0, url, "f", "x") for url, day in dated.items()]
    return store.incident_rows(spark.createDataFrame(rows, COLUMNS))


def day(year):
    return dt.date(year, 5, 1)


def stored(spark, path):
    return sorted(((r["run"], r["year"], r["url"]) for r in run_store.read_runs(spark, path).collect()), key=str)


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "runs")
    run_store.write_run(incidents(spark, {"a": day(2020), "x": None, "y": day(2024)}), path, "2025-07-01")
    run_store.write_run(incidents(spark, {"other": day(2024)}), path, "2025-07-02")
    for _ in range(2):
        run_store.write_run(incidents(spark, {"a": day(2024), "b": day(2025)}), path, "2025-07-01")
        assert stored(spark, path) == [("2025-07-01", 2024, "a"), ("2025-07-01", 2025, "b"), ("2025-07-02", 2024, "other")]
    run_store.write_run(incidents(spark, {}), path, "2025-07-01")
    assert stored(spark, path) == [("2025-07-02", 2024, "other")]


def test_rows_of_runs_since_are_left_out(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert run_store.stored_runs(spark, path) == []
    run_store.write_run(incidents(spark, {"a": day(2024), "n": None}), path, "r1")
    seen = run_store.stored_runs(spark, path)
    run_store.write_run(incidents(spark, {"b": day(2024)}), path, "r2", seen)
    run_store.write_run(incidents(spark, {"b": day(2024), "c": day(2024)}), path, "r3", seen)
    want = [("r1", 2024, "a"), ("r1", None, "n"), ("r2", 2024, "b"), ("r3", 2024, "c")]
    assert stored(spark, path) == sorted(want, key=str)


def test_only_partitions_of_runs_since_are_read(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(4):
        run_store.write_run(incidents(spark, {f"u{i}": day(2024)}), path, f"r{i}", [f"r{j}" for j in range(i)])
    since = run_store.came_since(spark, path, "r9", ["r0", "r1", "r2"])
    plan = since._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [NOT run" in plan.toString().replace("isnotnull(run), ", "")
    assert [r["url"] for r in since.collect()] == ["u3"]
    files = since.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("run=r3" in r["f"] for r in files)


def test_runs_at_the_same_time(spark, tmp_path):
    """Neither saw the other: both rows are there, readers take that of the first run."""
    path = str(tmp_path / "runs")
    for run in ("r1", "r2"):
        run_store.write_run(incidents(spark, {"a": day(2024), run: day(2024)}), path, run, ["r1", "r2"])
    first = run_store.first_of_runs(run_store.read_runs(spark, path))
    assert sorted((r["run"], r["url"]) for r in first.collect()) == [("r1", "a"), ("r1", "r1"), ("r2", "r2")]


@pytest.fixture()
def keys(tmp_path):
    return KeyTable(f"keys_{uuid.uuid4().hex}", str(tmp_path / "keys"), 8)


def urls(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "url STRING, n INT")


def test_keys_are_added_once(spark, keys):
    assert keys.missing(urls(spark, "a", None)).count() == 2
    for batch in (("a", "b", None), ("b", "b", "c"), ()):
        keys.add(urls(spark, *batch))
    assert sorted(r["url"] for r in keys.open(spark).collect()) == ["a", "b", "c"]
    links = urls(spark, "a", "a", "z", None)
    assert sorted(r["n"] for r in keys.missing(links).collect()) == [2, 3]
    assert sorted(r["n"] for r in keys.present(links).collect()) == [0, 1]


def test_the_stored_side_is_not_shuffled(spark, keys):
    keys.add(urls(spark, *map(str, range(100))))
    found = keys.missing(urls(spark, "7", "x"))
    assert [r["url"] for r in found.collect()] == ["x"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.index("FileScan") - 400 :]
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 8 out of 8" in plan
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(url") and "Exchange" not in stored_side.split("Scan ExistingRDD")[-1]


def test_a_new_session_finds_the_buckets(spark, keys):
    keys.add(urls(spark, "a", "b"))
    again = KeyTable(f"keys_{uuid.uuid4().hex}", keys.path, keys.buckets)
    assert [r["url"] for r in again.missing(urls(spark, "a", "c")).collect()] == ["c"]
