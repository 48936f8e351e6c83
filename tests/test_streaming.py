import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressline.operators.monitoring import ACCEPTED
from pressline.plans.map_query import run_instant
from pressline.streaming import intake

SCHEMA = "source STRING, url STRING, pub_ts TIMESTAMP, reason STRING, n INT"
NOW = "2025-07-02 12:00:00"


def row(i):
    ts = dt.datetime(2025, 7, 2, 11) - dt.timedelta(hours=i % 40)
    return ("a" if i % 3 else "b", f"u{i % 25}", ts, None if i % 4 else "too_old", i)


@pytest.fixture()
def landing(spark, tmp_path):
    """The same rows in several files, one frequent URL among them."""
    folder = str(tmp_path / "landing")
    rows = [row(i) for i in range(200)] + [("a", "u7", dt.datetime(2025, 7, 2, 11), None, 1000 + i) for i in range(100)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    return intake.stream_pages(spark, folder, SCHEMA, files_per_batch=1)


def drain(df, path, key=None, mode="append"):
    intake.stream_append(df, f"{path}/rows", f"{path}/checkpoint", key, mode).awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/rows")


def urls(df):
    return sorted(r["url"] for r in df.select("url").collect())


def test_all_files_arrive_once(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    first = drain(stream(spark, landing), out)
    assert first.count() == 300 and first.select("batch_id").distinct().count() == 3
    assert drain(stream(spark, landing), out).count() == 300
    spark.createDataFrame([row(5)], SCHEMA).write.mode("append").parquet(landing)
    assert drain(stream(spark, landing), out).count() == 301


def test_fresh_equals_batch(spark, landing, tmp_path):
    from pressline.operators.dating import fresh_only

    now = run_instant(NOW)
    got = drain(intake.stream_fresh(stream(spark, landing), now), str(tmp_path / "out"))
    want = fresh_only(spark.read.parquet(landing), now)
    assert sorted(r["n"] for r in got.collect()) == sorted(r["n"] for r in want.collect())


def test_dedup_keeps_each_url_once(spark, landing, tmp_path):
    rows = stream(spark, landing).withWatermark("pub_ts", "10 days")
    got = urls(drain(intake.stream_dedup(rows), str(tmp_path / "out")))
    assert got == sorted({r["url"] for r in spark.read.parquet(landing).select("url").distinct().collect()})


def test_append_by_key_is_idempotent(spark, landing, tmp_path):
    """A repeated batch gives the same rows: it ignores what its own first attempt wrote."""
    out = str(tmp_path / "out")
    got = drain(stream(spark, landing).select("url", "n"), out, key="url")
    every = sorted({f"u{i}" for i in range(25)})
    assert urls(got) == every
    again = spark.read.parquet(landing).select("url", "n")
    intake.append_batch(f"{out}/rows", "url")(again, 0)
    intake.append_batch(f"{out}/rows", "url")(again, 0)
    assert urls(spark.read.parquet(f"{out}/rows").filter("batch_id = 0")) == every
    intake.append_batch(f"{out}/rows", "url")(again, 9)
    assert spark.read.parquet(f"{out}/rows").filter("batch_id = 9").count() == 0


def test_stored_rows_are_left_out(spark, landing):
    batch = spark.read.parquet(landing)
    stored = spark.createDataFrame([("u7",), ("u8",)], "url STRING")
    left = intake.stream_not_stored(batch, lambda: stored)
    assert set(urls(left)) == {f"u{i}" for i in range(25)} - {"u7", "u8"}


def test_live_counts_equal_batch(spark, landing, tmp_path):
    counts = intake.stream_funnel(stream(spark, landing))
    got = {
        (str(r["day_start"]), r["source"], r["reason"]): r["n"]
        for r in intake.latest_counts(drain(counts, str(tmp_path / "out"), mode="update")).collect()
    }
    want = {
        (str(r["d"]), r["source"], r["reason"]): r["count"]
        for r in spark.read.parquet(landing).groupBy(
            F.date_trunc("day", "pub_ts").alias("d"), "source", F.coalesce("reason", F.lit(ACCEPTED)).alias("reason")).count().collect()
    }
    assert got == want


def test_counts_of_the_writes(spark, landing, tmp_path):
    """Counts per batch add up to the rows, also where a batch is repeated; closed batches are summed."""
    counts = str(tmp_path / "counts")
    write = intake.append_counted(str(tmp_path / "rows"), counts, ["a", "b"])
    for _ in range(2):
        run = stream(spark, landing).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        run.foreachBatch(lambda batch, n: (write(batch, n), write(batch, n))[0]).start().awaitTermination()
    rows = spark.read.parquet(landing)
    want = sorted((r["source"], r["reason"], r["count"]) for r in rows.groupBy(
        "source", F.coalesce("reason", F.lit(ACCEPTED)).alias("reason")).count().collect())
    assert sorted(map(tuple, intake.batch_counts(spark, counts).collect())) == want
    for before in (0, 2, 2, 9):
        assert sorted(map(tuple, intake.compact_counts(spark, counts, str(tmp_path / "closed"), before).collect())) == want
    with pytest.raises(ValueError):
        intake.append_counted(str(tmp_path / "r"), str(tmp_path / "c"), ["a"])(rows, 0)


SEEN = "url STRING, pub_ts TIMESTAMP, n INT"


def seen_rows(spark, tmp_path, batches, stored=()):
    """(batch, url, n) of the rows that count as new."""
    from pressline.streaming import seen

    at = lambda day, hour=0: dt.datetime(2025, 7, day, hour)
    landing = str(tmp_path / "landing")
    for batch in batches:
        rows = [(url, None if when is None else at(*when), n) for url, when, n in batch]
        spark.createDataFrame(rows, SEEN).coalesce(1).write.mode("append").parquet(landing)
    known = spark.createDataFrame([(u, at(*when)) for u, when in stored], "url STRING, pub_ts TIMESTAMP") if stored else None
    rows = seen.stream_unseen(
        intake.stream_pages(spark, landing, SEEN, files_per_batch=1), "pub_ts", dt.timedelta(days=7), "1 day", stored=known, salts=2)
    with seen.state_with_timers(spark):
        running = intake.stream_append(rows, f"{tmp_path}/rows", f"{tmp_path}/checkpoint")
    running.awaitTermination()
    return sorted((r["batch_id"], r["url"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/rows").collect())


def test_seen_urls_are_state(spark, tmp_path):
    """Repeated, late, stored and expired URLs, and one that fills a batch."""
    batches = [
        [("a", (1,), 3), ("a", (1, 1), 2), ("b", (1,), 4), ("s", (1,), 5), (None, (1,), 6), ("x", None, 7), *[("hot", (1, 5), i) for i in range(300, 8, -1)]],
        [("a", (3,), 10), ("hot", (2,), 11), ("c", (3,), 12)],
        [("a", (9,), 13), ("d", (9,), 15)],
        [("late", (1,), 14), ("a", (10,), 17), ("a", (9, 5), 16), ("s", (10,), 18), ("d", (10,), 19)],
    ]
    assert seen_rows(spark, tmp_path, batches, [("s", (1,)), ("never", (1,))]) == [
        (0, "a", 3), (0, "b", 4), (0, "hot", 9), (1, "c", 12), (2, "d", 15), (3, "a", 16), (3, "s", 18)]


def test_no_batch_reads_what_is_stored(spark, monkeypatch, tmp_path):
    def never(*_):
        raise AssertionError("the sink is read")

    monkeypatch.setattr(intake, "_stored_before", never)
    assert seen_rows(spark, tmp_path, [[("a", (1,), 1)], [("a", (1,), 2), ("b", (1,), 3)]]) == [(0, "a", 1), (1, "b", 3)]


def test_links_meet_pages_as_a_batch_would(spark, tmp_path):
    """In time, too late, failed, several copies, no page; links without a page come out once the watermark has passed."""
    from pressline.streaming.pairing import meet_pages

    at = lambda hour, minute=0, day=1: dt.datetime(2025, 7, day, hour, minute)
    links = [("s", f"u{i}", at(8, i), i) for i in range(8)] + [("s", "none", None, 9), ("s", None, at(8), 10)]
    pages = [("s", "u0", at(8, 5), False), ("s", "u1", at(9, 30), False), ("s", "u2", at(8, 9), True), ("s", "u3", at(8, 3), False),
             ("s", "u3", at(8, 40), False), ("t", "u4", at(8, 5), False), ("s", "u5", at(8, 4), False), (None, None, at(8), False)]
    end_link, end_page = [("end", "", at(0, 0, 20), 99)], [("end", "", at(0, 0, 20), False)]
    schemas = "source STRING, url STRING, listed_at TIMESTAMP, n INT", "source STRING, url STRING, fetched_at TIMESTAMP, failed BOOLEAN"
    streams, tables = [], []
    for name, rows, last, schema in (("links", links, end_link, schemas[0]), ("pages", pages, end_page, schemas[1])):
        for part in (rows[::2], rows[1::2], last):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        streams.append(intake.stream_pages(spark, f"{tmp_path}/{name}", schema, files_per_batch=1))
        tables.append(spark.createDataFrame(rows + last, schema))
    got = drain(meet_pages(*streams, within="1 HOUR", delay="30 minutes"), str(tmp_path / "out"))
    columns = ("n", "fetched_at", "reason")
    rows = lambda df: sorted(map(str, df.filter("n < 99").select(*columns).collect()))
    assert rows(got) == rows(meet_pages(*tables, within="1 HOUR", delay="30 minutes"))
    reasons = {r["n"]: r["reason"] for r in got.collect() if r["n"] < 99}
    assert reasons == {0: None, 1: "load_failed", 2: "load_failed", 3: None, 4: "load_failed", 5: "load_failed", 6: "load_failed", 7: "load_failed", 10: "load_failed"}
    assert got.filter("n = 3").count() == 2


def test_streamed_tables_may_be_folders(spark, tmp_path):
    from pressline.catalog import streams

    folder = str(tmp_path)
    spark.createDataFrame([(i, f"u{i}", "x" * i) for i in range(9)], streams.PAGES).repartition(3).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(99, "other", "")], streams.PAGES).write.parquet(f"{folder}/older_pages.parquet")
    at = dt.datetime(2024, 1, 1)
    events = [(i, at, i % 2, "view", 0.0, "") for i in range(6)]
    spark.createDataFrame(events, streams.EVENTS).repartition(2).write.parquet(f"{folder}/events.parquet")
    got = streams.stream_pages_t1(spark, folder).collect()
    assert sorted(tuple(r) for r in got) == [(i, f"u{i}", i) for i in range(9)]
    stored = {(r["url"], r["event_id"]) for r in streams.stream_append_t5(spark, folder).collect()}
    assert stored == {("https://example.org/u/0/view", 0), ("https://example.org/u/1/view", 1)}
