import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pressline.operators import mapview as mv
from pressline.operators import monitoring, store
from pressline.operators.dating import fresh_only, is_fresh
from pressline.plans import map_query as plan
from pressline.plans.tips import judge_tips, tips
from pressline.sources.schemas import INCIDENTS, SUBMISSIONS

D = dt.date
COLUMNS = [c.split()[0] for c in INCIDENTS.split(", ")]


def incident(n, **over):
    row = dict(title=f"t{n}", summary="s", date=D(2025, 3, 1), location=None, lat=52.5, lon=13.4, url=f"u{n}", federal="Berlin",
               type=None, scraper=True, approved=True)
    row.update(over)
    return tuple(row[c] for c in COLUMNS)


def urls(df):
    return sorted(r["url"] for r in df.select("url").collect())


@pytest.fixture()
def incidents(spark):
    rows = [incident(i) for i in range(12)] + [
        incident("refused", approved=False), incident("open", approved=None),
        incident("nostate", federal=None), incident("emptystate", federal="", date=D(2025, 1, 1)),
        incident("other", federal="Hessen"), incident("nolat", lat=None), incident("nan", lon=float("nan")),
        incident("start", date=D(2025, 1, 1)), incident("end", date=D(2025, 4, 1)), incident("late", date=D(2025, 4, 2)),
        incident("early", date=D(2024, 12, 31)), incident("nodate", date=None),
    ]
    return spark.createDataFrame(rows, INCIDENTS)


def test_shown_rows(incidents):
    kept = set(urls(plan.shown_incidents(incidents, ["Berlin"], D(2025, 1, 1), D(2025, 4, 1))))
    assert kept == {f"u{i}" for i in range(12)} | {"unostate", "uemptystate", "ustart", "uend"}
    open_start = set(urls(plan.shown_incidents(incidents, ["Berlin"], None, D(2025, 4, 1))))
    assert open_start - kept == {"uearly", "unodate"}


def test_cleared_end_is_the_run_instant(incidents):
    kept = urls(mv.in_range(incidents, D(2025, 4, 1), plan.run_instant("2025-04-01 10:00:00")))
    assert kept == ["uend"]


def test_no_state_selected(incidents):
    assert set(urls(mv.by_states(incidents, []))) == {"unostate", "uemptystate"}


def test_text_table(spark):
    raw = spark.createDataFrame([
        ("a", "52.5abc", "13", "2025-02-01"), ("b", "", "13", "2025-02-01"), ("c", " 52", "5e1", "kein Datum"),
        ("d", "x", "1", "2025-02-01"), ("e", "1", "1", None), ("f", "1", "1", "2030-01-01"),
    ], "url STRING, lat STRING, lon STRING, date STRING")
    kept = mv.in_range(mv.valid_coordinates(raw), D(2025, 1, 1), D(2025, 12, 31))
    assert sorted((r["url"], r["lat"], r["lon"]) for r in kept.collect()) == [("a", 52.5, 13.0), ("c", 52.0, 50.0)]


def test_labels(incidents):
    shown = plan.map_count(incidents, ["Berlin"], D(2025, 1, 1), D(2025, 4, 1)).collect()[0]
    assert (shown["shown"], shown["label"]) == (16, "16 in 91 Tagen")
    assert plan.map_count(incidents, ["Berlin"], None, D(2025, 4, 1)).collect()[0]["label"] == "18 bis 1.4.2025"
    assert mv.range_summary(incidents.filter("false"), D(2025, 1, 1), D(2025, 1, 1)).collect()[0]["label"] == "0 in 1 Tagen"
    assert mv.default_range(D(2025, 5, 1)) == (D(2025, 1, 1), D(2025, 5, 1))


def test_rings(incidents):
    """Indices 9 and 10 fall on the places of 1 and 2; index 11 starts the next ring."""
    moved = mv.spread_markers(mv.colocation_index(plan.shown_incidents(incidents, ["Berlin"], D(2025, 3, 1), D(2025, 3, 1))))
    rows = {r["point_index"]: r for r in moved.collect()}
    assert sorted(rows) == list(range(13))
    base = -629648656 % 360
    for index, row in rows.items():
        if index == 0:
            assert (row["shown_lat"], row["shown_lon"]) == (52.5, 13.4)
            continue
        a = math.radians(base + (index - 1) * 45)
        r = 0.03 + 0.03 * ((index - 1) // 10)
        assert row["shown_lat"] == pytest.approx(52.5 + r * math.cos(a), abs=1e-9)
        assert row["shown_lon"] == pytest.approx(13.4 + r * math.sin(a), abs=1e-9)
    assert rows[9]["shown_lat"] == pytest.approx(rows[1]["shown_lat"], abs=1e-9)
    assert rows[11]["shown_lat"] != pytest.approx(rows[3]["shown_lat"], abs=1e-3)


def test_recency(value):
    now = plan.run_instant("2025-03-03 12:00:00")
    assert value(mv.recency_rank(F.lit(D(2025, 3, 3)), now)) == 10000
    assert value(mv.recency_rank(F.lit(D(2025, 3, 2)), now)) == 9999
    assert value(mv.recency_rank(F.lit(D(2025, 3, 4)), now)) == 10001


def test_selection_and_toggle(spark):
    states = spark.createDataFrame([(s,) for s in mv.FEDERAL_STATES], "name STRING")
    some = mv.state_selection(states, ["Bayern"])
    assert [r["name"] for r in some.filter("selected").collect()] == ["Bayern"]
    assert mv.toggle_all(some).filter("selected").count() == 16
    assert mv.toggle_all(mv.state_selection(states, mv.FEDERAL_STATES)).filter("selected").count() == 0


def test_json_rows(incidents):
    import json

    rows = [json.loads(r["row"]) for r in mv.as_json_rows(mv.approved_incidents(incidents)).collect()]
    assert {r["url"] for r in rows} & {"urefused", "uopen"} == set()
    assert rows[0]["location"] is None and len(rows[0]) == 11


@pytest.mark.parametrize("age, kept", [(86399, True), (86400, True), (86401, False), (-500, True)])
def test_age_gate(value, age, kept):
    now = plan.run_instant("2025-03-03 12:00:00")
    ts = F.timestamp_seconds(F.unix_seconds(now) - age)
    assert value(is_fresh(ts, now)) is kept


def test_unknown_instant_passes(spark):
    df = spark.range(1).withColumn("pub_ts", F.lit(None).cast("timestamp"))
    assert fresh_only(df, plan.run_instant("2025-03-03 12:00:00")).count() == 1


CASES = [
    ("GET", "{}", None, None, 405, "Method Not Allowed"),
    (None, "{}", None, None, 405, "Method Not Allowed"),
    ("POST", None, None, None, 400, "Invalid JSON"),
    ("POST", "nope", None, None, 400, "Invalid JSON"),
    ("POST", '"text"', None, None, 400, "Invalid JSON"),
    ("POST", "[]", None, None, 400, "Alle Felder müssen ausgefüllt sein."),
    ("POST", '{"message":"m","source":"s"}', None, None, 400, "Alle Felder müssen ausgefüllt sein."),
    ("POST", '{"message":"m","source":null,"captcha":"c"}', None, None, 400, "Alle Felder müssen ausgefüllt sein."),
    ("POST", '{"message":" \\n","source":"s","captcha":"c"}', None, None, 400, "Ungültige Eingabedaten."),
    ("POST", '{"message":false,"source":"s","captcha":"c"}', None, None, 400, "Ungültige Eingabedaten."),
    ("POST", '{"message":"","source":["s"],"captcha":"c"}', None, None, 500, "Serverfehler"),
    ("POST", '{"message":"m","source":"s","captcha":"c"}', False, 0.9, 403, "Captcha ungültig."),
    ("POST", '{"message":"m","source":"s","captcha":"c"}', None, None, 403, "Captcha ungültig."),
    ("POST", '{"message":"m","source":"s","captcha":"c"}', True, 0.49, 403, "Captcha-Score zu niedrig."),
    ("POST", '{"message":"m","source":"s","captcha":"c"}', True, 0.5, 200, "ok"),
    ("POST", '{"message":" m ","source":5,"captcha":true}', True, None, 200, "ok"),
]


def test_tips(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], SUBMISSIONS)
    got = {r["id"]: (r["status"], r["reason"]) for r in judge_tips(df).collect()}
    assert got == {i: c[4:] for i, c in enumerate(CASES)}
    assert sorted((r["message"], r["source"]) for r in tips(df).collect()) == [("m", "5"), ("m", "s")]


def test_store(spark, tmp_path, incidents):
    path = str(tmp_path / "incidents")
    empty = store.read_incidents(spark, path)
    assert empty.count() == 0
    with pytest.raises(Exception):
        store.read_incidents(spark, path, on_unknown="fail")
    links = spark.createDataFrame([("u1",), ("new",)], "url STRING")
    assert store.not_yet_stored(links, empty).count() == 2
    assert [store.new_links(links, path, policy).count() for policy in ("new", "exist")] == [2, 0]
    store.append_incidents(store.incident_rows(incidents), path)
    stored = store.read_incidents(spark, path)
    assert stored.count() == incidents.count() and stored.filter("approved is not null").count() == 0
    assert urls(store.not_yet_stored(links, stored)) == ["new"]
    assert urls(store.already_stored(links, stored)) == ["u1"]
    assert urls(store.new_links(links, path, "exist")) == ["new"]
    assert store.url_exists(stored, "u1").count() == 1 and store.url_exists(stored, "x").count() == 0
    flagged = {r["url"]: r["stored"] for r in store.flag_stored(links, stored).collect()}
    assert flagged == {"u1": True, "new": False}
    plan_text = mv.in_range(stored, D(2025, 1, 1), D(2025, 4, 1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan_text
    shown = plan.shown_incidents(stored, ["Berlin"], D(2025, 1, 1), D(2025, 4, 1))
    explained = spark._jvm.PythonSQLUtils.explainString(shown._jdf.queryExecution(), "formatted")
    scan = next(line for line in explained.splitlines() if line.startswith("PushedFilters"))
    for pushed in ("EqualTo(approved,true)", "GreaterThanOrEqual(date,2025-01-01)", "LessThanOrEqual(date,2025-04-01)", "In(federal", "IsNotNull(lat)"):
        assert pushed.replace("In(federal", "EqualTo(federal,Berlin)") in scan, scan


def test_first_accepted(spark):
    rows = spark.createDataFrame(
        [("sachsen", "u", 1), ("sachsen-anhalt", "u", 2), ("nrw", "v", 3), ("presseportal", "v", 4)], "source STRING, url STRING, n INT")
    assert {(r["url"], r["n"]) for r in store.dedup_accepted(rows).collect()} == {("u", 2), ("v", 4)}


def test_funnel_and_alerts(spark):
    judged = spark.createDataFrame([("a", None), ("a", "stored"), ("a", "stored"), ("b", "too_old")], "source STRING, reason STRING")
    got = {(r["source"], r["reason"]): r["n"] for r in monitoring.funnel(judged).collect()}
    assert got == {("a", "accepted"): 1, ("a", "stored"): 2, ("a", "total"): 3, ("b", "too_old"): 1, ("b", "total"): 1, ("total", "total"): 4}
    log = spark.createDataFrame([("r", "a", 0, ""), ("r", "b", 1, "x"), ("r", "c", 255, "y")], "run_id STRING, source STRING, exit_code INT, output STRING")
    assert sorted(r["subject"] for r in monitoring.failed_runs(log).collect()) == ["Scraper-Fehler: b (Exit 1)", "Scraper-Fehler: c (Exit 255)"]
    assert monitoring.failed_runs(log).filter("source = 'b'").collect()[0]["body"].endswith("Ausgabe:\nx")
    with pytest.raises(ValueError):
        monitoring.first_reason(odd=F.lit(True))


def test_map_functions_in_sql(spark, tmp_path):
    """The table functions against the DataFrame form; constant arguments reach the scan, columns are pruned."""
    from pressline.plans import map_query, map_sql
    from pressline.sources.schemas import INCIDENTS

    days = [None, dt.date(1970, 1, 1), dt.date(2024, 12, 31), dt.date(2025, 1, 1), dt.date(2025, 2, 3)]
    rows = [
        ("t", "s", day, None, lat, 10.0, f"u{i}{j}{k}", state, "x", True, approved)
        for i, day in enumerate(days) for j, (lat, approved) in enumerate([(50.0, True), (None, True), (float("nan"), True), (50.0, False), (50.0, None)])
        for k, state in enumerate([None, "", "Bayern", "Berlin", "Hessen"])
    ]
    spark.createDataFrame(rows, INCIDENTS).write.parquet(str(tmp_path / "incidents"))
    table = spark.read.parquet(str(tmp_path / "incidents"))
    table.createOrReplaceTempView("stored_incidents")
    map_sql.register(spark, "stored_incidents")
    for selected in ([], ["Bayern"], ["Bayern", "Hessen"]):
        for start in (None, dt.date(1969, 1, 1), dt.date(2025, 1, 1)):
            for end in (dt.date(1969, 6, 1), dt.date(2025, 1, 1)):
                listed = "array(" + ", ".join(f"'{s}'" for s in selected) + ")" if selected else "CAST(array() AS ARRAY<STRING>)"
                call = f"({listed}, {f"DATE '{start}'" if start else 'NULL'}, DATE '{end}')"
                got = spark.sql(f"SELECT url FROM shown_incidents{call}")
                want = map_query.shown_incidents(table, selected, start, end)
                assert sorted(r["url"] for r in got.collect()) == sorted(r["url"] for r in want.select("url").collect()), call
    assert spark.sql("SELECT * FROM shown_count(array('Bayern'), DATE '2025-01-01', DATE '2025-02-03')").collect() == map_query.map_count(
        table, ["Bayern"], dt.date(2025, 1, 1), dt.date(2025, 2, 3)).collect()
    assert spark.sql("SELECT label FROM shown_count(array('Bayern'), NULL, DATE '2025-02-03')").first()["label"].endswith(" bis 3.2.2025")
    plan = spark.sql("SELECT url FROM shown_incidents(array('Bayern'), DATE '2025-01-01', DATE '2025-02-03')")._jdf.queryExecution().executedPlan().toString()
    assert "title" not in plan and "PushedFilters: [" in plan and "approved" in plan.split("PushedFilters: [")[1]

