"""Stored rows, submissions, monitoring, and the composed ingestion run (J, R, O operators)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.operators import monitoring, run_store, store
from pressline.operators.stored_keys import KeyTable
from pressline.plans import tips
from pressline.session import work_folder


@query("not_yet_stored_j1", """
SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def not_yet_stored_j1(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "source")
    return store.not_yet_stored(docs, d.table(spark, sf_dir, "labels"), "doc_id")


@query("unknown_store_j2", "SELECT doc_id FROM documents")
def unknown_store_j2(spark, sf_dir):
    """No table yet: every document counts as new."""
    docs = d.table(spark, sf_dir, "documents").select(F.col("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"))
    return store.new_links(docs, work_folder(spark, "no-incidents")).select("doc_id")


@query("unknown_store_policies_j2", """
WITH new_ids AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT 'new' AS policy, 'missing' AS store, doc_id FROM documents
UNION ALL SELECT 'fail', 'missing', -1
UNION ALL SELECT unnest(['new', 'exist', 'fail']), 'readable', doc_id FROM new_ids
UNION ALL SELECT 'of the source', 'unreadable', doc_id FROM documents WHERE source <> 'src7'""")
def unknown_store_policies_j2(spark, sf_dir):
    """New documents under each policy, for a store that is not there, one that is, and one that a run could not read; one source
    counts its links as stored then. A policy that raises shows as -1."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url")
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "source", name)
    labels = d.table(spark, sf_dir, "labels").select(name, F.lit("2024-01-01").cast("date").alias("date"))
    missing, readable = work_folder(spark, "no-incidents"), work_folder(spark, "incidents")
    rest = {c: F.lit(None).cast(t) for c, t in (
        ("title", "string"), ("summary", "string"), ("location", "string"), ("lat", "double"), ("lon", "double"), ("federal", "string"), ("type", "string"))}
    store.append_incidents(store.incident_rows(labels.withColumns(rest)), readable)

    def of(policy, state, path):
        return store.new_links(docs, path, policy).select(F.lit(policy).alias("policy"), F.lit(state).alias("store"), "doc_id")

    found = of("new", "missing", missing).unionByName(of("exist", "missing", missing))
    try:
        found = found.unionByName(of("fail", "missing", missing))
    except AnalysisException:
        found = found.unionByName(spark.sql("SELECT 'fail' AS policy, 'missing' AS store, -1L AS doc_id"))
    for policy in ("new", "exist", "fail"):
        found = found.unionByName(of(policy, "readable", readable))
    flagged = store.flag_stored(docs, None, F.col("source") == "src7").filter("NOT stored")
    return found.unionByName(flagged.select(F.lit("of the source").alias("policy"), F.lit("unreadable").alias("store"), "doc_id"))


_ACCEPTED = """
accepted AS (SELECT source, doc_id, 'https://example.org/' || (doc_id % 300) AS url FROM documents)"""
_WINNERS = _ACCEPTED + """,
winners AS (SELECT url, source, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY (source <> 'src7'), source || '.php', doc_id) AS n FROM accepted) WHERE n = 1)"""


def _accepted(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents")
    return docs.select(
        "source", "doc_id", F.concat(F.lit("https://example.org/"), (F.col("doc_id") % 300).cast("string")).alias("url")
    )


@query("first_accepted_j3", f"WITH {_WINNERS} SELECT url, source FROM winners")
def first_accepted_j3(spark, sf_dir):
    return store.dedup_accepted(_accepted(spark, sf_dir), first="src7").select("url", "source")


@query("incident_append_j4", f"""
WITH {d.INCIDENTS}
SELECT title, summary, strftime(date, '%Y-%m-%d') AS day, lat, lon, url, federal, type, true AS scraper, NULL::BOOLEAN AS approved,
       year(date)::BIGINT AS year FROM incidents""")
def incident_append_j4(spark, sf_dir):
    """Appended in two writes to a new table, then read back."""
    rows = store.incident_rows(d.incidents(spark, sf_dir).withColumn("location", F.lit(None).cast("string")))
    path = work_folder(spark, "incidents")
    store.append_incidents(rows.filter(F.col("date") < "2024-01-10"), path)
    store.append_incidents(rows.filter(F.col("date").isNull() | (F.col("date") >= "2024-01-10")), path)
    back = store.read_incidents(spark, path, on_unknown="fail")
    return back.select(
        "title", "summary", d.text(F.col("date")).alias("day"), "lat", "lon", "url", "federal", "type", "scraper", "approved",
        F.col("year").cast("bigint").alias("year"),
    )


@query("repeated_run_j4", f"""
WITH {d.INCIDENTS} SELECT url, count(*) AS n FROM incidents GROUP BY url""")
def repeated_run_j4(spark, sf_dir):
    """The same rows appended twice, as when a run is repeated after its write: none is stored twice."""
    rows = store.incident_rows(d.incidents(spark, sf_dir).withColumn("location", F.lit(None).cast("string")))
    path = work_folder(spark, "repeated")
    store.append_incidents(rows, path)
    store.append_incidents(rows, path)
    return store.read_incidents(spark, path, on_unknown="fail").groupBy("url").agg(F.count("*").alias("n"))


@query("run_overwrite_j4", f"""
WITH {d.INCIDENTS}
SELECT 'r' || (event_id % 3) AS run, year(date)::BIGINT AS year, url FROM incidents""")
def run_overwrite_j4(spark, sf_dir):
    """Three runs into one table: the first stopped after half its write, in a year it should not have had, and was repeated;
    the second did not see the first, found rows of it again, and was repeated; the third had seen both."""
    rows = d.incidents(spark, sf_dir)
    path = work_folder(spark, "runs")

    def write(run, which, seen=(), shift=0):
        moved = rows.filter(which).withColumn("date", F.add_months("date", shift))
        run_store.write_run(store.incident_rows(moved.withColumn("location", F.lit(None).cast("string"))), path, run, seen)

    k = F.col("event_id")
    write("r0", (k % 3 == 0) & (k % 2 == 0), shift=-12)
    write("r0", k % 3 == 0)
    second = (k % 3 == 1) | ((k % 3 == 0) & (k % 5 == 0))
    write("r1", second)
    write("r1", second)
    write("r2", k % 3 == 2, run_store.stored_runs(spark, path))
    return run_store.read_runs(spark, path).select("run", F.col("year").cast("bigint").alias("year"), "url")


@query("bucketed_lookup_j1", """
SELECT doc_id, source, doc_id IN (SELECT doc_id FROM labels) AS stored FROM documents""")
def bucketed_lookup_j1(spark, sf_dir):
    """Stored keys in buckets, added by two runs that share some; documents are looked up without moving them."""
    labels = d.table(spark, sf_dir, "labels")
    name = uuid.uuid4().hex
    keys = KeyTable(f"stored_{name}", work_folder(spark, "stored-keys"), 16)
    for which in (F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 < 2):
        keys.add(labels.filter(which).select(F.col("doc_id").cast("string").alias("url")))
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("url"))
    new = keys.missing(docs).withColumn("stored", F.lit(False))
    return new.unionByName(keys.present(docs).withColumn("stored", F.lit(True))).select("doc_id", "source", "stored")


@query("existence_probe_j5", f"""
WITH {d.INCIDENTS}
SELECT url, 'one' AS probe FROM incidents WHERE event_id = 77
UNION ALL SELECT url, 'bulk' FROM incidents WHERE event_id IN (SELECT o_orderkey * 5 FROM orders)""")
def existence_probe_j5(spark, sf_dir):
    stored = d.incidents(spark, sf_dir)
    one = store.url_exists(stored, "https://example.org/e/77").withColumn("probe", F.lit("one"))
    wanted = d.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("https://example.org/e/"), (F.col("o_orderkey") * 5).cast("string")).alias("url")
    )
    bulk = store.already_stored(wanted, stored).select("url", F.lit("bulk").alias("probe"))
    return one.unionByName(bulk)


_SUBMISSIONS = f"""
subs AS (
  SELECT conv_id * 100 + turn AS id, 7 AS k, conv_id, turn, role, text, {d.sql_trim('text')} AS trimmed FROM conversations
  UNION ALL SELECT -1 - (conv_id * 100 + turn), (conv_id * 3 + turn) % 7, conv_id, turn, role, text, '' FROM conversations),
triaged AS (
  SELECT *, CASE WHEN turn = 3 THEN 405 WHEN k IN (0, 1) THEN 400 WHEN k IN (2, 3) THEN 400 WHEN k = 4 THEN 500 WHEN k IN (5, 6) THEN 400
                 WHEN trimmed = '' THEN 400 ELSE 200 END AS status,
    CASE WHEN turn = 3 THEN 'Method Not Allowed' WHEN k IN (0, 1) THEN 'Invalid JSON' WHEN k IN (2, 3) THEN 'Alle Felder müssen ausgefüllt sein.'
         WHEN k = 4 THEN 'Serverfehler' WHEN k IN (5, 6) OR trimmed = '' THEN 'Ungültige Eingabedaten.' ELSE 'ok' END AS reason
  FROM subs),
gated AS (
  SELECT id, role, trimmed, CASE WHEN status <> 200 THEN status WHEN conv_id % 4 IN (0, 1) OR conv_id % 5 = 0 THEN 403 ELSE 200 END AS status,
    CASE WHEN status <> 200 THEN reason WHEN conv_id % 4 IN (0, 1) THEN 'Captcha ungültig.'
         WHEN conv_id % 5 = 0 THEN 'Captcha-Score zu niedrig.' ELSE 'ok' END AS reason
  FROM triaged)"""


def _submissions(spark, sf_dir):
    """Conversation turns as tip-offs, and beside each a row that is broken in the way its number says."""
    turns = d.table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 100 + F.col("turn")
    conv = turns.withColumns({"id": number, "k": F.lit(7).cast("long")}).unionByName(
        turns.withColumns({"id": -1 - number, "k": ((F.col("conv_id") * 3 + F.col("turn")) % 7).cast("long")})
    )
    k = F.col("k")
    n = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    full = F.to_json(F.struct(F.concat(F.lit("\n "), "text").alias("message"), F.col("role").alias("source"), F.lit("t").alias("captcha")))
    body = (
        F.when(k == 0, F.lit("{message: oops"))
        .when(k == 1, F.lit("42"))
        .when(k == 2, F.to_json(F.struct(F.col("text").alias("message"), F.lit("t").alias("captcha"))))
        .when(k == 3, F.lit('{"message": "x", "source": null, "captcha": "t"}'))
        .when(k == 4, F.lit('{"message": ["x"], "source": " ", "captcha": "t"}'))
        .when(k == 5, F.lit('{"message": " \\n\\t", "source": "s", "captcha": "t"}'))
        .when(k == 6, F.lit('{"message": "x", "source": "s", "captcha": false}'))
        .otherwise(full)
    )
    c = F.col("conv_id")
    return conv.select(
        "id",
        F.when(F.col("turn") == 3, F.lit("GET")).otherwise(F.lit("POST")).alias("method"),
        body.alias("body"),
        F.when(c % 4 == 0, F.lit(False)).when(c % 4 == 1, F.lit(None)).otherwise(F.lit(True)).alias("captcha_success"),
        F.when(c % 5 == 0, F.lit(0.49)).when(c % 5 == 1, F.lit(0.5)).when(c % 5 == 2, F.lit(None)).otherwise(F.lit(0.9)).alias("captcha_score"),
    )


@query("submission_triage_r1", f"WITH {_SUBMISSIONS} SELECT id, status::BIGINT AS status, reason FROM triaged")
def submission_triage_r1(spark, sf_dir):
    from pressline.operators.submissions import triage

    return triage(_submissions(spark, sf_dir)).select("id", F.col("status").cast("bigint").alias("status"), "reason")


@query("captcha_gate_r2", f"WITH {_SUBMISSIONS} SELECT id, status::BIGINT AS status, reason FROM gated")
def captcha_gate_r2(spark, sf_dir):
    return tips.judge_tips(_submissions(spark, sf_dir)).select("id", F.col("status").cast("bigint").alias("status"), "reason")


@query("accepted_tips_r3", f"WITH {_SUBMISSIONS} SELECT id, trimmed AS message, role AS source FROM gated WHERE status = 200")
def accepted_tips_r3(spark, sf_dir):
    return tips.tips(_submissions(spark, sf_dir))


_FUNNEL = f"""
WITH judged AS (
  SELECT t.source, CASE WHEN l.doc_id IS NOT NULL THEN 'stored' WHEN t.doc_id % 9 = 0 THEN 'load_failed' WHEN length(t.text) < 300 THEN 'no_text'
    WHEN t.doc_id % 7 = 0 THEN 'too_old' WHEN {d.sql_first_keyword(['t.text'])} IS NULL THEN 'no_keyword' ELSE 'accepted' END AS reason
  FROM documents t LEFT JOIN labels l ON t.doc_id = l.doc_id)
SELECT coalesce(source, 'total') AS source, CASE WHEN source IS NULL OR reason IS NULL THEN 'total' ELSE reason END AS reason, count(*) AS n
FROM judged GROUP BY ROLLUP (source, reason)"""


def _judged_documents(spark, sf_dir):
    from pressline.operators.relevance import first_keyword

    labels = d.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("stored", F.lit(True))
    docs = d.table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    reason = monitoring.first_reason(
        no_keyword=first_keyword(F.col("text"), d.KEYWORDS).isNull(),
        too_old=F.col("doc_id") % 7 == 0,
        no_text=F.length("text") < 300,
        load_failed=F.col("doc_id") % 9 == 0,
        stored=F.col("stored").isNotNull(),
    )
    return docs.select("source", reason.alias("reason"))


@query("funnel_o1", _FUNNEL)
def funnel_o1(spark, sf_dir):
    return monitoring.funnel(_judged_documents(spark, sf_dir))


@query("observed_funnel_o1", _FUNNEL)
def observed_funnel_o1(spark, sf_dir):
    """Counted while the judged rows are written; the sources are the configured ones."""
    sources = sorted(r["source"] for r in d.table(spark, sf_dir, "documents").select("source").distinct().collect())
    seen = Observation()
    rows = _judged_documents(spark, sf_dir).observe(seen, *monitoring.counted(sources))
    rows.write.parquet(work_folder(spark, "judged"))
    return monitoring.observed_funnel(spark, monitoring.count_rows(sources, seen.get))


@query("failed_runs_o2", """
SELECT s_suppkey AS run, s_name AS source, (s_suppkey % 4)::BIGINT AS exit_code,
       'Scraper-Fehler: ' || s_name || ' (Exit ' || (s_suppkey % 4) || ')' AS subject,
       'Der Scraper ''' || s_name || ''' hat sich mit Fehlercode ' || (s_suppkey % 4) || ' beendet.' || chr(10) || chr(10) || 'Ausgabe:'
       || chr(10) || coalesce(CASE WHEN s_suppkey % 3 > 0 THEN 'Saldo ' || s_nationkey END, '') AS body FROM supplier WHERE s_suppkey % 4 <> 0""")
def failed_runs_o2(spark, sf_dir):
    log = d.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("run_id"), F.col("s_name").alias("source"),
        (F.col("s_suppkey") % 4).cast("int").alias("exit_code"),
        F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("Saldo "), F.col("s_nationkey").cast("string"))).alias("output"),
    )
    return monitoring.failed_runs(log).select(
        F.col("run_id").alias("run"), "source", F.col("exit_code").cast("bigint").alias("exit_code"), "subject", "body"
    )
