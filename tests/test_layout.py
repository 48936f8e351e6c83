"""Incidents along a space-filling curve: what a map query reads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressline.operators import mapview as mv
from pressline.operators.layout import interleaved, write_clustered

SCHEMA = "url STRING, date DATE, lat DOUBLE, lon DOUBLE, federal STRING, approved BOOLEAN"


def rows_of(n):
    """A year of incidents in a grid of sixteen states; every eighth without a state, some without date or point."""
    rng = random.Random(5)
    found = []
    for i in range(n):
        lat, lon = rng.uniform(48, 55), rng.uniform(6, 15)
        state = f"S{int((lat - 48) / 1.75)}{int((lon - 6) / 2.25)}"
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(365))
        found.append((f"u{i}", None if i % 97 == 0 else day, None if i % 89 == 0 else lat, lon, None if i % 8 == 0 else state, i % 3 > 0))
    return found


def scanned(df):
    """Rows that came out of the scan when the table was collected."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def week(table):
    return mv.in_range(mv.by_states(mv.approved_incidents(table), ["S12"]), dt.date(2024, 5, 6), dt.date(2024, 5, 12))


def test_one_state_and_week_reads_few_rows(spark, tmp_path):
    rows = spark.createDataFrame(rows_of(20_000), SCHEMA)
    plain, curve = str(tmp_path / "plain"), str(tmp_path / "curve")
    rows.coalesce(10).write.option("parquet.block.size", 1 << 12).parquet(plain)
    write_clustered(spark.read.parquet(plain), curve, rows_per_file=2000, group_bytes=1 << 12)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tables = {path: week(spark.read.parquet(path)) for path in (plain, curve)}
        want = {r["url"] for r in tables[plain].collect()}
        assert want and {r["url"] for r in tables[curve].collect()} == want
        read = {path: scanned(df) for path, df in tables.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read[plain] > 15_000 and read[curve] < 3_500
    pushed = tables[curve]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in pushed and "EqualTo(fede" in pushed


def test_all_rows_stay(spark, tmp_path):
    rows = spark.createDataFrame([*rows_of(500), ("n", None, float("nan"), None, "", None), ("u1", None, None, None, None, True)], SCHEMA)
    write_clustered(rows, str(tmp_path / "t"), rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.columns == rows.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def test_a_frequent_point_is_divided(spark, tmp_path):
    rows = spark.createDataFrame([(f"u{i}", dt.date(2024, 1, 1), 52.5, 13.4, "B", True) for i in range(1000)], SCHEMA)
    write_clustered(rows, str(tmp_path / "t"), rows_per_file=100)
    sizes = [r["n"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 250


@pytest.mark.parametrize("points", [[], [("u", None, None, None, None, None)]])
def test_nothing_to_lay_out(spark, tmp_path, points):
    write_clustered(spark.createDataFrame(points, SCHEMA), str(tmp_path / "t"))
    assert spark.read.schema(SCHEMA).parquet(str(tmp_path / "t")).count() == len(points)


def test_interleaved(value):
    got = value(interleaved([F.lit(n).cast("long") for n in (0b101, 0b011, 0b110)], 3))
    assert got == 0b101_011_110
