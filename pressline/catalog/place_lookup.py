"""Places, coordinates, states (G operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.operators import places as pl

_FIRST = f"({d.SQL_CANDIDATES})[1]"
_LOOSE = r"regexp_extract(note, '\b(?:in|bei|nahe)\s+([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ-]+)', 1)"


@query("place_from_text_g1", f"""
WITH {d.PLACE_NOTES}
SELECT c_custkey, {_FIRST} AS place, {_LOOSE} AS loose_place,
  array_to_string(list_filter({d.SQL_CANDIDATES}, lambda x, i: list_position({d.SQL_CANDIDATES}, x) = i), '|') AS candidates
FROM place_notes""")
def place_from_text_g1(spark, sf_dir):
    note = F.col("note")
    return d.place_notes(spark, sf_dir).select(
        "c_custkey", pl.first_place(note).alias("place"), pl.first_place(note, strict=False).alias("loose_place"),
        F.array_join(pl.place_candidates(note), "|").alias("candidates"),
    )


_ANSWER = "(CASE c_custkey % 6 WHEN 0 THEN 'Bonn' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN '0' ELSE NULL END)"
_SIDE = "(CASE WHEN c_custkey % 5 = 0 THEN 'Pankow' END)"


def _answer():
    k = F.col("c_custkey") % 6
    return F.when(k == 0, F.lit("Bonn")).when(k == 1, F.lit("")).when(k == 3, F.lit("0"))


def _truthy(c: str) -> str:
    return f"nullif(nullif({c}, ''), '0')"


@query("location_ladder_g2", f"""
WITH {d.PLACE_NOTES}
SELECT c_custkey, coalesce({_truthy(_ANSWER)}, {_FIRST}) AS portal,
  coalesce({_ANSWER}, {_LOOSE}) AS null_only,
  coalesce({_truthy(_ANSWER)}, {_SIDE}, {_FIRST}) AS listed_first,
  coalesce({_truthy(_ANSWER)}, {_FIRST}, {_SIDE}) AS listed_last
FROM place_notes""")
def location_ladder_g2(spark, sf_dir):
    note, side = F.col("note"), F.when(F.col("c_custkey") % 5 == 0, F.lit("Pankow"))
    a = _answer()
    return d.place_notes(spark, sf_dir).select(
        "c_custkey",
        pl.sidecar_location(a, note, None, False).alias("portal"),
        pl.sidecar_location(a, note, None, False, strict=False, null_only=True).alias("null_only"),
        pl.sidecar_location(a, note, side, True).alias("listed_first"),
        pl.sidecar_location(a, note, side, False).alias("listed_last"),
    )


@query("forward_geocode_g3", f"""
WITH {d.PLACE_NOTES}, {d.GAZETTEER},
located AS (SELECT c_custkey, {_FIRST} AS location FROM place_notes)
SELECT c_custkey, location, round(geo_lat, 6) AS geo_lat, round(geo_lon, 6) AS geo_lon
FROM located LEFT JOIN top_places ON lower(location) = place_key""")
def forward_geocode_g3(spark, sf_dir):
    located = d.place_notes(spark, sf_dir).select("c_custkey", pl.first_place(F.col("note")).alias("location"))
    found = pl.geocode(located, d.gazetteer(spark, sf_dir), spread_by="c_custkey")
    return found.select("c_custkey", "location", F.round("geo_lat", 6).alias("geo_lat"), F.round("geo_lon", 6).alias("geo_lon"))


_LAT = "(CASE c_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '0.0' WHEN 2 THEN NULL WHEN 3 THEN '52.5' ELSE '48.1N' END)"
_LON = "(CASE WHEN c_custkey % 8 = 0 THEN '' ELSE '13.4' END)"
_LACKS = f"(c_custkey % 5 IN (0, 1, 2) OR c_custkey % 8 = 0)"
_NUM = "(CASE c_custkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 3 THEN 52.5 WHEN 4 THEN 48.1 END)"
_COMPLETED = f"""
WITH {d.PLACE_NOTES}, {d.GAZETTEER},
located AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE {_FIRST} END AS location FROM place_notes),
completed AS (
  SELECT c_custkey, location,
    CASE WHEN {_LACKS} AND coalesce(location, '') <> '' THEN geo_lat ELSE {_NUM}::DOUBLE END AS lat,
    CASE WHEN {_LACKS} AND coalesce(location, '') <> '' THEN geo_lon WHEN c_custkey % 8 = 0 THEN NULL ELSE 13.4::DOUBLE END AS lon
  FROM located LEFT JOIN top_places ON lower(location) = place_key)"""


def _completed(spark, sf_dir):
    k = F.col("c_custkey")
    lat = F.when(k % 5 == 0, F.lit("0")).when(k % 5 == 1, F.lit("0.0")).when(k % 5 == 3, F.lit("52.5")).when(k % 5 == 4, F.lit("48.1N"))
    rows = d.place_notes(spark, sf_dir).select(
        "c_custkey",
        F.when(k % 7 == 0, F.lit("")).otherwise(pl.first_place(F.col("note"))).alias("location"),
        lat.alias("lat_text"),
        F.when(k % 8 == 0, F.lit("")).otherwise(F.lit("13.4")).alias("lon_text"),
    )
    return pl.complete_coordinates(rows, d.gazetteer(spark, sf_dir), spread_by="c_custkey")


@query("coordinate_completion_g4", _COMPLETED + """
SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon FROM completed""")
def coordinate_completion_g4(spark, sf_dir):
    return _completed(spark, sf_dir).select("c_custkey", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_IN_STATE = """
inside AS (
  SELECT p.id, e.name FROM points p JOIN edges e
    ON (e.lat1 > p.lat) <> (e.lat2 > p.lat) AND p.lon < (e.lon2 - e.lon1) * (p.lat - e.lat1) / (e.lat2 - e.lat1) + e.lon1
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


@query("state_of_point_g5", f"""
WITH {d.INCIDENTS}, {d.STATE_EDGES},
points AS (SELECT event_id AS id, lat, lon FROM incidents), {_IN_STATE}
SELECT p.id AS event_id, i.name AS point_state FROM points p LEFT JOIN inside i ON p.id = i.id""")
def state_of_point_g5(spark, sf_dir):
    points = d.incidents(spark, sf_dir).select("event_id", "lat", "lon")
    return pl.state_of_point(points, d.nation_states(spark, sf_dir)).select("event_id", "point_state")


@query("state_ladder_g6", _COMPLETED + f""", {d.STATE_EDGES},
points AS (SELECT c_custkey AS id, lat, lon FROM completed), {_IN_STATE}
SELECT p.id AS c_custkey,
  CASE WHEN p.id % 3 = 0 THEN 'Hessen' WHEN p.lat <> 0 AND p.lon <> 0 THEN i.name END AS federal
FROM points p LEFT JOIN inside i ON p.id = i.id""")
def state_ladder_g6(spark, sf_dir):
    answer = F.when(F.col("c_custkey") % 3 == 0, F.lit("Hessen")).when(F.col("c_custkey") % 3 == 1, F.lit(""))
    pointed = pl.state_of_point(_completed(spark, sf_dir), d.nation_states(spark, sf_dir))
    state = pl.federal_state(answer, F.col("lat"), F.col("lon"), F.col("point_state"))
    return pointed.select("c_custkey", state.alias("federal"))
