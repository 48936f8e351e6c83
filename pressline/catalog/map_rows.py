"""The map query (Q operators)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.functions.geo import base_angle, point_key
from pressline.functions.text import key_hash
from pressline.operators import mapview as mv
from pressline.operators.layout import write_clustered
from pressline.plans import map_query as plan
from pressline.plans import map_sql
from pressline.session import work_folder

START, END = dt.date(2024, 1, 5), dt.date(2024, 1, 20)


def _shown(spark, sf_dir):
    return plan.shown_incidents(d.incidents(spark, sf_dir), d.SELECTED, START, END)


@query("approved_rows_q1", f"""
WITH {d.INCIDENTS}
SELECT event_id, title, url, federal, strftime(date, '%Y-%m-%d') AS day FROM incidents WHERE approved""")
def approved_rows_q1(spark, sf_dir):
    rows = mv.approved_incidents(d.incidents(spark, sf_dir))
    # Through the JSON form and back: what a reader of the endpoint sees.
    schema = "event_id BIGINT, title STRING, url STRING, federal STRING, date DATE"
    back = mv.as_json_rows(rows).select(F.from_json("row", schema).alias("r"))
    return back.select("r.event_id", "r.title", "r.url", "r.federal", d.text(F.col("r.date")).alias("day"))


@query("state_filter_q2", f"""
WITH {d.INCIDENTS}
SELECT event_id, federal FROM incidents WHERE coalesce(federal, '') = '' OR federal IN ({d.SQL_SELECTED})""")
def state_filter_q2(spark, sf_dir):
    return mv.by_states(d.incidents(spark, sf_dir), d.SELECTED).select("event_id", "federal")


@query("coordinate_validity_q3", """
SELECT event_id,
  CASE event_id % 7 WHEN 0 THEN 52.5 WHEN 1 THEN 52.0 WHEN 2 THEN 50.0 WHEN 5 THEN -0.25 ELSE user_id END::DOUBLE AS lat, (user_id % 10)::DOUBLE AS lon
FROM events WHERE event_id % 7 NOT IN (3, 4)""")
def coordinate_validity_q3(spark, sf_dir):
    k = F.col("event_id") % 7
    raw = (
        F.when(k == 0, F.lit("52.5abc")).when(k == 1, F.lit("\n 52")).when(k == 2, F.lit("5e1"))
        .when(k == 3, F.lit("abc")).when(k == 4, F.lit("")).when(k == 5, F.lit("-.25.5")).otherwise(F.col("user_id").cast("string"))
    )
    rows = d.table(spark, sf_dir, "events").select(
        "event_id", raw.alias("lat"), (F.col("user_id") % 10).cast("double").alias("lon")
    )
    return mv.valid_coordinates(rows)


@query("date_range_q4", f"""
WITH {d.INCIDENTS}
SELECT event_id, 'closed' AS bounds FROM incidents WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
UNION ALL SELECT event_id, 'open' FROM incidents WHERE coalesce(date, DATE '1970-01-01') <= DATE '2024-01-20'
UNION ALL SELECT event_id, 'text' FROM incidents WHERE event_id % 10 = 0 OR date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def date_range_q4(spark, sf_dir):
    rows = d.incidents(spark, sf_dir).select("event_id", "date")
    raw = rows.withColumn("date", F.when(F.col("event_id") % 10 == 0, F.lit("unbekannt")).otherwise(F.col("date").cast("string")))
    parts = {"closed": mv.in_range(rows, START, END), "open": mv.in_range(rows, None, END), "text": mv.in_range(raw, START, END)}
    named = [p.select("event_id", F.lit(name).alias("bounds")) for name, p in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("clustered_map_rows_q4", f"""
WITH {d.INCIDENTS}
SELECT event_id, federal, strftime(date, '%Y-%m-%d') AS day FROM incidents
WHERE approved AND (coalesce(federal, '') = '' OR federal = 'NATION_4') AND date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'""")
def clustered_map_rows_q4(spark, sf_dir):
    """One state and week out of the table laid out along the curve."""
    path = work_folder(spark, "clustered")
    write_clustered(d.incidents(spark, sf_dir), path, rows_per_file=2000)
    week = mv.in_range(mv.by_states(mv.approved_incidents(spark.read.parquet(path)), ["NATION_4"]), dt.date(2024, 1, 8), dt.date(2024, 1, 14))
    return week.select("event_id", "federal", d.text(F.col("date")).alias("day"))


@query("default_range_q5", f"""
WITH {d.INCIDENTS} SELECT count(*) AS shown, count(*) || ' in 366 Tagen' AS label FROM incidents
WHERE date + INTERVAL 1 YEAR >= DATE '2025-01-01' AND date + INTERVAL 1 YEAR <= DATE '2026-01-01'""")
def default_range_q5(spark, sf_dir):
    """Default bounds of a run on 1 January 2026, on the incidents moved one year ahead."""
    start, end = mv.default_range(dt.date(2026, 1, 1))
    rows = d.incidents(spark, sf_dir).withColumn("date", F.add_months("date", 12))
    return mv.range_summary(mv.in_range(rows, start, end), start, end)


@query("range_label_q6", f"""
WITH {d.SHOWN}
SELECT 'closed' AS bounds, count(*) AS shown, count(*) || ' in 16 Tagen' AS label FROM shown
UNION ALL
SELECT 'open', count(*), count(*) || ' bis 20.1.2024' FROM incidents
WHERE approved AND (coalesce(federal, '') = '' OR federal IN ({d.SQL_SELECTED})) AND coalesce(date, DATE '1970-01-01') <= DATE '2024-01-20'""")
def range_label_q6(spark, sf_dir):
    rows = d.incidents(spark, sf_dir)
    closed = plan.map_count(rows, d.SELECTED, START, END).withColumn("bounds", F.lit("closed"))
    return closed.unionByName(plan.map_count(rows, d.SELECTED, None, END).withColumn("bounds", F.lit("open")))


_INDEXED = d.SHOWN + """,
indexed AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY date, md5(url), url) - 1 AS point_index FROM shown)"""
_EVERY = d.INCIDENTS + """,
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY coalesce(date, DATE '1970-01-01'), md5(url), url) - 1 AS point_index
  FROM incidents)"""
_KEY = "(regexp_replace(lat::VARCHAR, '\\.0$', '') || ',' || regexp_replace(lon::VARCHAR, '\\.0$', ''))"
_HASHED = f""",
keys AS (SELECT DISTINCT lat, lon, {_KEY} AS key FROM indexed),
folded AS (
  SELECT lat, lon, key, list_reduce(list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT),
                                    lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT) AS h FROM keys),
hashed AS (SELECT lat, lon, key, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM folded)"""
_ANGLE = "((h % 360 + 360) % 360)"
_MOVED = f""",
moved AS (
  SELECT i.*, {_ANGLE} AS angle,
    CASE WHEN point_index > 0 THEN i.lat + (0.03 + 0.03 * ((point_index - 1) // 10)) * cos(radians({_ANGLE} + (point_index - 1) * 45)) ELSE i.lat END AS shown_lat,
    CASE WHEN point_index > 0 THEN i.lon + (0.03 + 0.03 * ((point_index - 1) // 10)) * sin(radians({_ANGLE} + (point_index - 1) * 45)) ELSE i.lon END AS shown_lon
  FROM indexed i JOIN hashed k ON i.lat = k.lat AND i.lon = k.lon)"""


@query("colocation_index_q7", f"WITH {_INDEXED} SELECT event_id, point_index FROM indexed")
def colocation_index_q7(spark, sf_dir):
    return mv.colocation_index(_shown(spark, sf_dir)).select("event_id", "point_index")


@query("key_hash_q8", f"""
WITH {_EVERY} {_HASHED} SELECT key, h AS hash, {_ANGLE} AS base_angle FROM hashed""")
def key_hash_q8(spark, sf_dir):
    keys = d.incidents(spark, sf_dir).select("lat", "lon").distinct().select(point_key(F.col("lat"), F.col("lon")).alias("key"))
    return keys.select("key", key_hash(F.col("key")).alias("hash"), base_angle(F.col("key")).alias("base_angle"))


@query("ring_displacement_q9", f"""
WITH {_EVERY} {_HASHED} {_MOVED}
SELECT event_id, round(shown_lat, 6) AS shown_lat, round(shown_lon, 6) AS shown_lon FROM moved""")
def ring_displacement_q9(spark, sf_dir):
    moved = mv.spread_markers(mv.colocation_index(d.incidents(spark, sf_dir)))
    return moved.select("event_id", F.round("shown_lat", 6).alias("shown_lat"), F.round("shown_lon", 6).alias("shown_lon"))


_RANK = f"(10000 - floor((epoch(TIMESTAMP '{d.AS_OF}') - epoch(coalesce(date, DATE '1970-01-01')::TIMESTAMP)) / 86400))::BIGINT"


@query("recency_rank_q10", f"WITH {d.INCIDENTS} SELECT event_id, {_RANK} AS rank FROM incidents")
def recency_rank_q10(spark, sf_dir):
    return d.incidents(spark, sf_dir).select("event_id", mv.recency_rank(F.col("date"), d.instant()).alias("rank"))


@query("state_selection_q11", f"""
SELECT n_name AS name, n_name IN ({d.SQL_SELECTED}) AS selected, true AS toggled, false AS toggled_twice FROM nation""")
def state_selection_q11(spark, sf_dir):
    states = d.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    chosen = mv.state_selection(states, d.SELECTED)
    once = mv.toggle_all(chosen)
    twice = mv.toggle_all(once)
    return chosen.join(once.withColumnRenamed("selected", "toggled"), "name").join(
        twice.withColumnRenamed("selected", "toggled_twice"), "name"
    )


@query("marker_view_q12", f"""
WITH {_INDEXED} {_HASHED} {_MOVED}
SELECT title, summary, url, round(shown_lat, 6) AS shown_lat, round(shown_lon, 6) AS shown_lon, {_RANK} AS rank FROM moved""")
def marker_view_q12(spark, sf_dir):
    """The whole map query in one plan."""
    markers = plan.map_markers(d.incidents(spark, sf_dir), d.SELECTED, START, END, d.instant())
    return markers.withColumns({"shown_lat": F.round("shown_lat", 6), "shown_lon": F.round("shown_lon", 6)})


@query("sql_map_q12", f"""
WITH {_INDEXED} {_HASHED} {_MOVED}
SELECT title, summary, url, round(shown_lat, 6) AS shown_lat, round(shown_lon, 6) AS shown_lon, {_RANK} AS rank FROM moved""")
def sql_map_q12(spark, sf_dir):
    """The same rows asked for in SQL, with states and days as arguments."""
    view = f"incidents_{uuid.uuid4().hex}"
    rows = d.incidents(spark, sf_dir).withColumns({"location": F.lit(None).cast("string"), "scraper": F.lit(True)})
    rows.createTempView(view)
    map_sql.register(spark, view)
    states = ", ".join(f"'{s}'" for s in d.SELECTED)
    shown = spark.sql(f"SELECT * FROM shown_incidents(array({states}), DATE '{START}', DATE '{END}')")
    found = map_sql.markers(shown, d.instant())
    return found.withColumns({"shown_lat": F.round("shown_lat", 6), "shown_lon": F.round("shown_lon", 6)})
