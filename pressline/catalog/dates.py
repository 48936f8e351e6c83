"""Dates and age gates (D operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.functions import dates as dt
from pressline.operators import dating
from pressline.plans.map_query import run_instant
from pressline.sources.profiles import default_profiles

_AS_OF = "TIMESTAMP '1997-06-15 12:00:00'"
_DAY = "strftime(day, '%Y-%m-%d')"


def _run():
    return run_instant("1997-06-15 12:00:00")


@query("iso_date_d1", f"""
WITH {d.DATES} SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 3) THEN {_DAY} END AS day FROM dated""")
def iso_date_d1(spark, sf_dir):
    return d.dated_notes(spark, sf_dir).select("o_orderkey", d.text(dt.iso_date(F.col("note"))).alias("day"))


@query("german_date_d2", f"""
WITH {d.DATES}
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN {_DAY} END AS exact,
  CASE WHEN o_orderkey % 5 = 1 THEN {_DAY} END AS prefix, CASE WHEN o_orderkey % 5 = 1 THEN {_DAY} END AS anywhere,
  CASE WHEN o_orderkey % 5 = 1 THEN {_DAY} END AS labelled, CASE WHEN o_orderkey % 5 = 1 THEN {_DAY} END AS clock,
  NULL::VARCHAR AS not_exact FROM dated""")
def german_date_d2(spark, sf_dir):
    note = F.col("note")
    return d.dated_notes(spark, sf_dir).select(
        "o_orderkey",
        d.text(dt.german_date(note, "exact")).alias("exact"),
        d.text(dt.german_date(F.concat(note, F.lit(", 15:35 Uhr")), "prefix")).alias("prefix"),
        d.text(dt.german_date(F.concat(F.lit("Stand: "), note, F.lit(" Uhr")), "anywhere")).alias("anywhere"),
        d.text(dt.german_date(F.concat(F.lit("<i>Artikel  vom "), note, F.lit("</i>")), "after_label")).alias("labelled"),
        d.text(dt.german_date(F.concat(note, F.lit(" 15:44 Uhr")), "with_time")).alias("clock"),
        d.text(dt.german_date(F.concat(note, F.lit(" ")), "exact")).alias("not_exact"),
    )


@query("german_month_date_d3", f"""
WITH {d.DATES} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 2 THEN {_DAY} END AS day FROM dated""")
def german_month_date_d3(spark, sf_dir):
    return d.dated_notes(spark, sf_dir).select("o_orderkey", d.text(dt.german_month_date(F.col("note"))).alias("day"))


@query("rss_date_d4", """
SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d')
    WHEN 2 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') ELSE NULL END AS day FROM orders""")
def rss_date_d4(spark, sf_dir):
    months = F.array(*[F.lit(m) for m in d.ENGLISH_MONTHS])
    day = F.concat_ws(
        " ", F.day("o_orderdate").cast("string"), F.element_at(months, F.month("o_orderdate")), F.year("o_orderdate").cast("string")
    )
    k = F.col("o_orderkey") % 4
    note = (
        F.when(k == 0, F.concat(F.lit("Wed, "), day, F.lit(" 10:30:00 GMT")))
        .when(k == 1, F.concat(day, F.lit(" 00:30 +0100")))
        .when(k == 2, F.concat(F.lit("Mon, "), day, F.lit(" 23:15:59 EST")))
        .otherwise(F.concat(F.lit("am "), day))
    )
    return d.table(spark, sf_dir, "orders").select("o_orderkey", d.text(dt.rss_date(note)).alias("day"))


@query("iso_timestamp_d5", f"""
WITH {d.DATES}
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN epoch(day::TIMESTAMP)::BIGINT
    + (CASE WHEN o_orderkey % 2 = 0 THEN 37800 ELSE 30615 END) END AS seconds FROM dated""")
def iso_timestamp_d5(spark, sf_dir):
    return d.dated_notes(spark, sf_dir).select("o_orderkey", F.unix_seconds(dt.iso_ts(F.col("note"))).alias("seconds"))


_LADDER_SQL = f"""
WITH {d.DATES},
laddered AS (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 IN (0, 3) THEN day
         WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 IN (0, 1, 2) THEN day WHEN o_orderkey % 3 = 1 AND o_orderkey % 5 = 3 THEN day END AS found,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 37801
         WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 3 THEN (CASE WHEN o_orderkey % 2 = 0 THEN 37800 ELSE 30615 END) ELSE 0 END AS seconds
  FROM dated)"""


def _laddered(spark, sf_dir):
    rows = d.dated_notes(spark, sf_dir).withColumn(
        "source", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    )
    note = F.col("note")
    rungs = {
        "attr": lambda: dating._rung(dt.iso_date_text(note), dt.loose_ts(note)),
        "visible": lambda: dating._rung(dt.any_german_date_text(note)),
        "none": lambda: dating._rung(F.lit(None).cast("string")),
    }
    ladders = {"a": ("none", "attr"), "b": ("visible",), "c": ("none",)}
    return dating.with_publication(rows, ladders, _run(), rungs)


@query("publication_ladder_d6", _LADDER_SQL + f"""
SELECT o_orderkey, source, strftime(coalesce(found, DATE '1997-06-15'), '%Y-%m-%d') AS pub_date FROM laddered""")
def publication_ladder_d6(spark, sf_dir):
    return _laddered(spark, sf_dir).select("o_orderkey", "source", d.text(F.col("pub_date")).alias("pub_date"))


# Each source's date facts in the order of its ladder: column, notation of the day, seconds of that day it stands for.
_FACTS = {
    "presseportal": (("dated_time_attr", "{iso} 10:30:01", 37801),),
    "bayern": (("time_attr", "{iso}T10:30+02:00", 30600),),
    "berlin": (("list_date_text", "{german}  09:15 Uhr", 33300), ("dcterms_date", "{iso}T08:00:05+02:00", 28805), ("time_attr", "{iso}T10:30:00+02:00", 30600)),
    "brandenburg": (("time_attr", "{iso}T10:30:00Z", 37800), ("labelled_date_text", "{iso}", 0)),
    "bremen": (("list_date", "{iso}", 0), ("class_time_attr", "{iso}", 0), ("class_time_text", "{german}", 0)),
    "mv": (("dtstart_text", "{german}", 0), ("meta_published", "{iso}T10:00:00Z", 36000)),
    "nrw": (("time_attr", "{iso} 20:00:00", 72000), ("list_date", "{iso}", 0)),
    "sachsen": (("time_attr", "{iso}T07:00:00Z", 25200), ("time_text", "{german}", 0), ("date_class_text", "{iso}", 0)),
    "sachsen-anhalt": (("date_box_text", "am {german}, 15:35", 0), ("time_attr", "{iso}T10:00:00Z", 36000), ("any_date_text", "{iso}", 0)),
    "schleswig-holstein": (("time_attr", "{iso}T10:00:00Z", 0),),
}
_SOURCES = tuple(_FACTS)
_SECONDS = "[" + ", ".join(str([s for _, _, s in facts]) for facts in _FACTS.values()) + "]"


@query("source_ladders_d6", f"""
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, (o_orderkey % 10)::INT AS s, (o_orderkey // 10 % 4)::INT AS rung FROM orders),
f AS (SELECT *, {_SECONDS}[s + 1][rung + 1] AS seconds FROM o)
SELECT o_orderkey, {d._sql_list(_SOURCES)}[s + 1] AS source, strftime(CASE WHEN seconds IS NULL THEN DATE '1997-06-15' ELSE day END, '%Y-%m-%d') AS pub_date,
  epoch((CASE WHEN seconds IS NULL THEN DATE '1997-06-15' ELSE day END)::TIMESTAMP)::BIGINT + coalesce(seconds, 0) AS seconds FROM f""")
def source_ladders_d6(spark, sf_dir):
    """The ladders of the ten sources: facts from one rung down, the later ones with another day; without any the run date."""
    k = F.col("o_orderkey")
    orders = d.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    rows = orders.withColumns({
        "source": F.element_at(F.array(*[F.lit(s) for s in _SOURCES]), (k % 10 + 1).cast("int")), "rung": F.floor(k / 10) % 4,
    })

    def note(pattern, rung):
        shown = F.when(F.col("rung") == rung, F.col("day")).otherwise(F.date_sub("day", 100))
        notation = "{iso}" if "{iso}" in pattern else "{german}"
        before, after = pattern.split(notation)
        text = F.date_format(shown, "yyyy-MM-dd" if notation == "{iso}" else "dd.MM.yyyy")
        return F.when(F.col("rung") <= rung, F.concat(F.lit(before), text, F.lit(after)))

    columns = {c: F.lit(None).cast("string") for c in (
        "time_attr", "dated_time_attr", "time_text", "class_time_attr", "class_time_text", "dtstart_text", "meta_published", "dcterms_date",
        "date_box_text", "date_class_text", "labelled_date_text", "any_date_text", "list_date_text", "list_date")}
    for source, facts in _FACTS.items():
        for rung, (column, pattern, _) in enumerate(facts):
            columns[column] = F.when(F.col("source") == source, note(pattern, rung)).otherwise(columns[column])
    noted = rows.withColumns(columns).withColumn("list_date", F.col("list_date").cast("date"))
    dated = dating.with_publication(noted, {p.source: p.dates for p in default_profiles().values()}, _run())
    return dated.select("o_orderkey", "source", d.text(F.col("pub_date")).alias("pub_date"), F.unix_seconds("pub_ts").alias("seconds"))


@query("run_date_default_d7", f"""
WITH {d.DATES}
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN {_DAY} ELSE '1997-06-15' END AS pub_date FROM dated""")
def run_date_default_d7(spark, sf_dir):
    found = dating.publication_date(dt.german_date_text(F.col("note"), "exact"))
    return d.dated_notes(spark, sf_dir).select("o_orderkey", d.text(dating.or_run_date(found, _run())).alias("pub_date"))


@query("effective_timestamp_d8", _LADDER_SQL + """
SELECT o_orderkey, epoch(coalesce(found, DATE '1997-06-15')::TIMESTAMP)::BIGINT + (CASE WHEN found IS NULL THEN 0 ELSE seconds END) AS seconds
FROM laddered""")
def effective_timestamp_d8(spark, sf_dir):
    return _laddered(spark, sf_dir).select("o_orderkey", F.unix_seconds("pub_ts").alias("seconds"))


@query("age_gate_d9", f"""
SELECT event_id FROM events WHERE epoch(TIMESTAMP '{d.AS_OF}') - floor(epoch(ts)) <= 86400 OR event_id % 50 = 0""")
def age_gate_d9(spark, sf_dir):
    """Every fiftieth event has no instant and passes."""
    events = d.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("pub_ts")
    )
    return dating.fresh_only(events, d.instant()).select("event_id")


@query("early_age_gate_d10", f"""
SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 OR epoch({_AS_OF}) - epoch(o_orderdate::DATE::TIMESTAMP) <= 86400""")
def early_age_gate_d10(spark, sf_dir):
    links = d.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate").cast("date")).alias("list_date")
    )
    return dating.fresh_links(links, _run()).select("o_orderkey")


@query("day_cutoff_d11", """
SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '1997-06-15' - INTERVAL 60 DAY""")
def day_cutoff_d11(spark, sf_dir):
    rows = d.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("pub_date"))
    return dating.within_days(rows, _run(), days=60).select("o_orderkey")
