import math
import random

import pytest
from pyspark.sql import functions as F

from pressline.operators.cells import covered
from pressline.operators import classify as cl
from pressline.operators import places as pl


@pytest.mark.parametrize("note, strict, loose", [
    ("Einsatz in Köln-Süd und bei Ulm", "Köln-Süd", "Köln-Süd"),
    ("in Richtung Bonn, bei Höhe Ulm", None, "Richtung"),
    ("in Richtungen", "Richtungen", "Richtungen"),
    ("nahe Richtungsdorf", "Richtungsdorf", "Richtungsdorf"),
    ("In Ulm", None, None),
    ("in Polizeirevier, in Ulm, in Ulm", "Ulm", "Polizeirevier"),
    ("bei Autobahnpolizei", None, "Autobahnpolizei"),
    ("darin Ulm; bei  Äpfelstadt", "Äpfelstadt", "Äpfelstadt"),
    ("in A", None, None),
])
def test_first_place(value, note, strict, loose):
    assert value(pl.first_place(F.lit(note))) == strict
    assert value(pl.first_place(F.lit(note), strict=False)) == loose


def test_candidates_are_distinct(value):
    assert value(pl.place_candidates(F.lit("in Ulm, bei Bonn, in Ulm"))) == ["Ulm", "Bonn"]


def test_location_ladders(value):
    null = F.lit(None).cast("string")
    assert value(pl.location(F.lit("0"), [F.lit("Ulm")])) == "Ulm"
    assert value(pl.location(F.lit(""), [F.lit("Ulm")], null_only=True)) == ""
    assert value(pl.location(null, [F.lit(""), F.lit("Bonn")])) == "Bonn"
    assert value(pl.location(null, [null, F.lit("")])) == ""


GAZ = [("Ulm", 2, 1.0, 1.0), ("ulm ", 1, 48.4, 10.0), ("Bonn", 1, 50.7, 7.1)]


@pytest.mark.parametrize("lat, lon, place, want", [
    ("52.5", "13.4", "Ulm", (52.5, 13.4)), ("0", "13.4", "Ulm", (48.4, 10.0)), (None, None, "ULM", (48.4, 10.0)),
    ("0.0", "1", "nirgends", (None, None)), ("", "13.4", None, (None, 13.4)), ("52.5", "", "", (52.5, None)),
    ("0.0", "7", "", (0.0, 7.0)),
])
def test_complete_coordinates(spark, lat, lon, place, want):
    df = spark.createDataFrame([("u", lat, lon, place)], "url STRING, lat_text STRING, lon_text STRING, location STRING")
    gaz = spark.createDataFrame(GAZ, "name STRING, rank INT, lat DOUBLE, lon DOUBLE")
    assert tuple(pl.complete_coordinates(df, gaz).select("lat", "lon").collect()[0]) == want


STATES = [
    ("concave", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]]),
    ("holed", [[(5.0, 0.0), (9.0, 0.0), (9.0, 4.0), (5.0, 4.0)], [(6.0, 1.0), (8.0, 1.0), (8.0, 3.0), (6.0, 3.0)]]),
    ("twofold", [[(0.0, 5.0), (1.0, 5.0), (1.0, 6.0), (0.0, 6.0)], [(3.0, 5.0), (4.0, 5.0), (4.0, 6.0), (3.0, 6.0), (3.0, 5.0)]]),
    ("south", [[(-4.0, -4.0), (-1.0, -4.0), (-1.0, -1.0)]]),
]


def brute_state(lat, lon):
    for name, rings in sorted(STATES):
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                    odd = not odd
        if odd:
            return name
    return None


@pytest.mark.parametrize("cell", [0.1, 0.37, 3.0])
def test_state_of_point(spark, cell):
    rng = random.Random(3)
    points = [(i, rng.uniform(-5, 7), rng.uniform(-5, 10)) for i in range(500)] + [(1000, None, 1.0), (1001, 2.5, 7.1)]
    states = spark.createDataFrame(STATES, "name STRING, rings ARRAY<ARRAY<STRUCT<lon:DOUBLE,lat:DOUBLE>>>")
    df = spark.createDataFrame(points, "url LONG, lat DOUBLE, lon DOUBLE")
    got = {r["url"]: r["point_state"] for r in pl.state_of_point(df, states, cell=cell).collect()}
    assert got == {i: brute_state(lat, lon) if lat is not None else None for i, lat, lon in points}
    assert len(set(got.values())) == 5


def test_federal_state(value):
    null = F.lit(None).cast("string")
    one, zero = F.lit(1.0), F.lit(0.0)
    assert value(pl.federal_state(F.lit("Hessen"), one, one, F.lit("x"))) == "Hessen"
    assert value(pl.federal_state(F.lit(""), one, one, F.lit("x"))) == "x"
    assert value(pl.federal_state(null, zero, one, F.lit("x"))) is None


def response(content):
    import json

    return json.dumps({"choices": [{"message": {"content": content}}]})


@pytest.mark.parametrize("content, illegal", [
    ('{"illegal": true}', True), ('{"illegal": false}', False), ('{"illegal": "true"}', False), ('{"illegal": 1}', False),
    ('{"ort": "x"}', False), ("keine", False), ("", False), ('{"illegal": null}', False),
])
def test_strict_true(value, content, illegal):
    assert value(cl.is_illegal(cl.decode_answer(F.lit(response(content))))) is illegal


def test_decode_keeps_partial_answers(value):
    got = value(cl.decode_answer(F.lit(response('{"ort": "Ulm", "koord": {"lat": 48.4, "lon": "10.0"}, "illegal": "x"}'))))
    assert (got["ort"], got["koord"]["lat"], got["koord"]["lon"], got["illegal"]) == ("Ulm", "48.4", "10.0", None)
    assert value(cl.decode_answer(F.lit("502"))) is None


def test_types(value):
    assert value(cl.incident_type(F.lit(None).cast("string"))) == "Sonstige"
    assert value(cl.incident_type(F.lit(""))) == ""
    assert [value(cl.canonical_type(F.lit(t))) for t in ("A", "W", "O", "", "Wetten", "x")] == [
        "Automatenspiel", "Wetten", "Online-Spiele", "Sonstige", "Wetten", "x"]


def test_requests(spark):
    import json

    df = spark.createDataFrame([("u", "ä" * 3000)], "url STRING, content_text STRING")
    body = json.loads(cl.classification_requests(df, "m").collect()[0]["request"])
    assert body["model"] == "m" and body["temperature"] == 0.1
    assert body["messages"][0]["content"] == cl.INSTRUCTION + "ä" * 2000
    bare = df.select(cl.request_text(F.col("content_text"), None, pre_cut=1500).alias("t")).collect()[0]["t"]
    assert len(bare) == 1500


def test_points_are_not_shuffled_for_a_small_state_table(spark, tmp_path):
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    states = spark.createDataFrame([("A", ring)], "name STRING, rings ARRAY<ARRAY<STRUCT<lon:DOUBLE,lat:DOUBLE>>>")
    states.write.parquet(str(tmp_path / "states"))
    spark.range(10).selectExpr("id / 20.0D AS lat", "id / 20.0D AS lon", "id").write.parquet(str(tmp_path / "points"))
    found = pl.state_of_point(spark.read.parquet(str(tmp_path / "points")), spark.read.parquet(str(tmp_path / "states")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert found.filter("point_state = 'A'").count() >= 8


STATE_SCHEMA = "name STRING, rings ARRAY<ARRAY<STRUCT<lon:DOUBLE,lat:DOUBLE>>>"


def star(corners, seed):
    """A jagged ring around (10, 50)."""
    rng = random.Random(seed)
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(10 + rng.uniform(1, 3) * math.cos(t), 50 + rng.uniform(1, 2) * math.sin(t)) for t in turns]


def test_cells_of_a_long_border(spark):
    """Many edges, a hole, points on the grid lines; each lookup tests the edges of its cell only."""
    outer, hole = star(2000, 1), [(9.8, 49.8), (10.2, 49.8), (10.2, 50.2), (9.8, 50.2)]
    states = spark.createDataFrame([("A", [outer, hole])], STATE_SCHEMA)
    rng = random.Random(2)
    points = [(rng.uniform(47, 53), rng.uniform(6, 14)) for _ in range(3000)]
    points += [(round(lat, 1), round(lon, 1)) for lat, lon in points[:300]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "url LONG, lat DOUBLE, lon DOUBLE")
    got = {r["url"]: r["point_state"] for r in pl.state_of_point(df, states).collect()}

    def inside(lat, lon):
        odd = False
        for ring in (outer, hole):
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                    odd = not odd
        return "A" if odd else None

    assert got == {i: inside(*p) for i, p in enumerate(points)}
    cells = covered(pl.ring_edges(states)).select("row", "col", F.explode("parts").alias("p"))
    edges = cells.select(F.size("p.edges").alias("n"), "p.corner_inside")
    assert edges.filter("n = 0 AND NOT corner_inside").count() == 0
    assert edges.filter("n = 0").count() > 100
    assert edges.agg(F.max("n")).first()[0] < 60


def test_cells_of_shared_borders_and_level_edges(spark):
    """Rings along the grid lines and two states side by side; open and closed rings, a ring without area."""
    states = [
        ("B", [[(0.0, 0.0), (0.5, 0.0), (0.5, 0.3), (0.0, 0.3), (0.0, 0.0)]]),
        ("C", [[(0.5, 0.0), (1.0, 0.0), (1.0, 0.3), (0.5, 0.3)], [(0.7, 0.1), (0.7, 0.1)]]),
        ("D", []),
    ]
    df = spark.createDataFrame([(x, y) for x in (0.05, 0.45, 0.55, 0.951, -0.05, 1.05) for y in (0.05, 0.15, 0.25, 0.35)], "lon DOUBLE, lat DOUBLE")
    got = {(r["lon"], r["lat"]): r["point_state"] for r in pl.state_of_point(df, spark.createDataFrame(states, STATE_SCHEMA)).collect()}
    assert got == {(x, y): None if y > 0.3 or not 0 < x < 1 else "B" if x < 0.5 else "C" for x, y in got}
