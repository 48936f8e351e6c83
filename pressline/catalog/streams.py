"""Streaming forms (T operators): each reads its table as a stream to the end, then shows the result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.session import work_folder
from pressline.streaming import intake, pairing, seen

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
PAGES = "page_id BIGINT, url STRING, html STRING"


def _table_stream(spark, sf_dir, name, schema):
    """A table as a stream, be it one file or a folder of part files; a streamed path may be a file only where it is a pattern."""
    return intake.stream_pages(spark, f"{sf_dir}/{{{name}.parquet}}", schema)


def _events(spark, sf_dir):
    stream = _table_stream(spark, sf_dir, "events", EVENTS)
    url = F.concat(F.lit("https://example.org/u/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("pub_ts"), url.alias("url"), F.col("event_type").alias("source"))


def _drain(spark, stream, label, key=None, mode="append"):
    path = work_folder(spark, label)
    intake.stream_append(stream, f"{path}/rows", f"{path}/checkpoint", key, mode).awaitTermination()
    return spark.read.parquet(f"{path}/rows")


@query("stream_pages_t1", "SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages")
def stream_pages_t1(spark, sf_dir):
    pages = _table_stream(spark, sf_dir, "pages", PAGES)
    rows = pages.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))
    return _drain(spark, rows, "pages").select("page_id", "url", "n_chars")


@query("stream_fresh_t2", f"""
SELECT event_id FROM events WHERE epoch(TIMESTAMP '{d.AS_OF}') - floor(epoch(ts)) <= 86400""")
def stream_fresh_t2(spark, sf_dir):
    fresh = intake.stream_fresh(_events(spark, sf_dir), d.instant())
    return _drain(spark, fresh.select("event_id"), "fresh").select("event_id")


_URL = "'https://example.org/u/' || user_id || '/' || event_type"


@query("stream_dedup_t3", f"SELECT DISTINCT {_URL} AS url FROM events")
def stream_dedup_t3(spark, sf_dir):
    """The watermark spans the whole table, so every URL stays once."""
    rows = _events(spark, sf_dir).withWatermark("pub_ts", "60 days")
    return _drain(spark, intake.stream_dedup(rows), "dedup").select("url")


@query("stream_not_stored_t4", f"""
SELECT DISTINCT {_URL} AS url FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def stream_not_stored_t4(spark, sf_dir):
    types = F.explode(F.array(*[F.lit(t) for t in ("view", "signup", "click", "purchase", "error")]))
    stored = d.table(spark, sf_dir, "supplier").select("s_suppkey", types.alias("t")).select(
        F.concat(F.lit("https://example.org/u/"), F.col("s_suppkey").cast("string"), F.lit("/"), F.col("t")).alias("url")
    )
    path = work_folder(spark, "not-stored")
    write = intake.append_batch(f"{path}/rows", "url")

    def fresh(batch, batch_id):
        write(intake.stream_not_stored(batch.select("url"), lambda: stored), batch_id)

    running = (
        _events(spark, sf_dir).writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).foreachBatch(fresh).start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("url")


@query("stream_append_t5", f"SELECT {_URL} AS url, min(event_id) AS event_id FROM events GROUP BY 1")
def stream_append_t5(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "url")
    return _drain(spark, rows, "append", key="url").select("url", "event_id")


@query("stream_funnel_t6", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS source,
       CASE WHEN event_id % 4 = 0 THEN 'accepted' WHEN event_id % 4 = 1 THEN 'too_old' ELSE 'no_keyword' END AS reason, count(*) AS n
FROM events GROUP BY 1, 2, 3""")
def stream_funnel_t6(spark, sf_dir):
    k = F.col("event_id") % 4
    reason = F.when(k == 1, F.lit("too_old")).when(k > 1, F.lit("no_keyword"))
    counts = intake.stream_funnel(_events(spark, sf_dir).withColumn("reason", reason))
    updates = _drain(spark, counts, "funnel", mode="update")
    return intake.latest_counts(updates).select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "source", "reason", "n")


@query("stream_counts_t6", """
SELECT event_type AS source, CASE WHEN event_id % 4 = 0 THEN 'accepted' WHEN event_id % 4 = 1 THEN 'too_old' ELSE 'no_keyword' END AS reason, count(*) AS n
FROM events GROUP BY 1, 2""")
def stream_counts_t6(spark, sf_dir):
    """Counts taken by the writes of the batches; the first two batches are closed."""
    events = d.table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    reason = F.when(k == 1, F.lit("too_old")).when(k > 1, F.lit("no_keyword"))
    rows = events.select("event_id", F.col("event_type").alias("source"), reason.alias("reason"))
    sources = sorted(r["source"] for r in rows.select("source").distinct().collect())
    path = work_folder(spark, "counts")
    for part in range(3):
        rows.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{path}/landing")
    stream = intake.stream_pages(spark, f"{path}/landing", rows.schema, files_per_batch=1)
    write = intake.append_counted(f"{path}/rows", f"{path}/counts", sources)
    (
        stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
        .foreachBatch(write).start().awaitTermination()
    )
    return intake.compact_counts(spark, f"{path}/counts", f"{path}/closed", 2)


# Instants are cut to seconds: watermarks count milliseconds.
_LANDED = """
e AS (SELECT event_id, date_trunc('second', ts) AS moment, user_id FROM events),
bounds AS (SELECT date_trunc('day', min(moment)) AS day0 FROM e),
landed AS (
  SELECT event_id, moment, 'https://example.org/u/' || (user_id % 500) AS url,
    CASE WHEN event_id % 50 = 0 THEN 3 ELSE least(3, date_diff('second', day0, moment) // (8 * 86400)) END AS batch FROM e, bounds)"""
_SPAN_DAYS, _DELAY_DAYS, _STORED = 6, 1, 40


def _landed_by_time(spark, rows, path):
    """Writes ``rows(batch, ...)`` as one file a batch, in order; the batches are four."""
    for batch in range(4):
        rows.filter(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


@query("stream_seen_urls_t5", f"""
WITH RECURSIVE {_LANDED},
marks AS (SELECT batch, max(moment) - INTERVAL {_DELAY_DAYS} DAY AS mark FROM landed GROUP BY batch),
behind AS (SELECT b.batch, max(m.mark) AS mark FROM marks b LEFT JOIN marks m ON m.batch < b.batch GROUP BY b.batch),
firsts AS (
  SELECT url, l.batch, min((moment, event_id)) AS f FROM landed l LEFT JOIN behind b ON b.batch = l.batch - 1 WHERE b.mark IS NULL OR moment > b.mark GROUP BY ALL),
urls AS (SELECT DISTINCT url FROM landed),
state(url, batch, kept, shown) AS (
  SELECT url, -1, (CASE WHEN s.url2 IS NOT NULL THEN day0 END), NULL::BIGINT
  FROM urls, bounds LEFT JOIN (SELECT 'https://example.org/u/' || i AS url2 FROM range({_STORED}) t(i)) s ON s.url2 = url
  UNION ALL
  SELECT s.url, s.batch + 1,
    CASE WHEN f IS NOT NULL AND (kept IS NULL OR kept + INTERVAL {_SPAN_DAYS} DAY <= b.mark) THEN f[1] ELSE kept END,
    CASE WHEN f IS NOT NULL AND (kept IS NULL OR kept + INTERVAL {_SPAN_DAYS} DAY <= b.mark) THEN f[2] END
  FROM state s JOIN behind b ON b.batch = s.batch + 1 LEFT JOIN firsts ON firsts.url = s.url AND firsts.batch = b.batch)
SELECT url, shown AS event_id, batch::BIGINT AS batch FROM state WHERE shown IS NOT NULL""")
def stream_seen_urls_t5(spark, sf_dir):
    """URLs as they are seen first, or again after six days, with late rows; some count as stored from the start."""
    events = d.table(spark, sf_dir, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    start = events.agg(F.date_trunc("day", F.min("at"))).first()[0]
    day = F.least(F.lit(3), F.floor((F.unix_seconds("at") - F.unix_seconds(F.lit(start))) / (8 * 86400)))
    rows = events.select(
        "event_id", "at", F.concat(F.lit("https://example.org/u/"), (F.col("user_id") % 500).cast("string")).alias("url"),
        F.when(F.col("event_id") % 50 == 0, 3).otherwise(day).alias("batch"),
    )
    path = work_folder(spark, "seen")
    schema = _landed_by_time(spark, rows, f"{path}/landing")
    stored = spark.range(_STORED).select(
        F.concat(F.lit("https://example.org/u/"), F.col("id").cast("string")).alias("url"), F.lit(start).alias("at")
    )
    stream = intake.stream_pages(spark, f"{path}/landing", schema, files_per_batch=1)
    unseen = seen.stream_unseen(stream, "at", dt.timedelta(days=_SPAN_DAYS), f"{_DELAY_DAYS} days", stored=stored)
    with seen.state_with_timers(spark):
        running = intake.stream_append(unseen, f"{path}/rows", f"{path}/checkpoint")
    running.awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("url", "event_id", F.col("batch_id").cast("bigint").alias("batch"))


# A third of the pages never arrives, a fifth did not load, some come too late for their link.
_MEETING = """
l AS (SELECT event_id, event_type AS source, date_trunc('second', ts) AS listed_at FROM events),
p AS (SELECT event_id, listed_at + to_minutes((event_id % 7) * 10) AS fetched_at FROM l WHERE event_id % 3 <> 0 AND event_id % 5 <> 0)"""


@query("stream_links_meet_pages_t1", f"""
WITH {_MEETING}
SELECT l.event_id, l.source, CASE WHEN p.event_id IS NULL THEN 'load_failed' END AS reason, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched
FROM l LEFT JOIN p ON p.event_id = l.event_id AND fetched_at <= listed_at + INTERVAL 40 MINUTE""")
def stream_links_meet_pages_t1(spark, sf_dir):
    """Links and pages as two streams; a last row far ahead on both sides lets the last links time out."""
    events = d.table(spark, sf_dir, "events").withColumn("listed_at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    k = F.col("event_id")
    links = events.select("event_id", F.col("event_type").alias("source"), k.cast("string").alias("url"), "listed_at")
    fetched = F.col("listed_at") + F.make_dt_interval(mins=(k % 7 * 10).cast("int"))
    pages = links.filter(k % 3 != 0).select("source", "url", fetched.alias("fetched_at"), (k % 5 == 0).alias("failed"))
    end = spark.sql("SELECT TIMESTAMP '9999-01-01 00:00:00' AS at")
    last_link = end.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit("end").alias("source"), F.lit("").alias("url"), F.col("at").alias("listed_at"))
    last_page = end.select(F.lit("end").alias("source"), F.lit("").alias("url"), F.col("at").alias("fetched_at"), F.lit(False).alias("failed"))
    path = work_folder(spark, "meet")
    streams = []
    for name, rows, last in (("links", links, last_link), ("pages", pages, last_page)):
        rows.write.parquet(f"{path}/{name}")
        last.write.mode("append").parquet(f"{path}/{name}")
        streams.append(intake.stream_pages(spark, f"{path}/{name}", rows.schema))
    met = pairing.meet_pages(*streams, within="40 MINUTES", delay="1 hour")
    shown = met.select("event_id", "source", "reason", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched"))
    intake.stream_append(shown, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").filter("event_id >= 0").select("event_id", "source", "reason", "fetched")
