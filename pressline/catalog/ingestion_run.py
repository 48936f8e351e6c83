"""The composed ingestion run over the given pages: incidents and reject reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.plans import ingestion as run
from pressline.session import cut_lineage
from pressline.sources.profiles import ANY_P, Box, LinkRule, ListSpec, Profile, default_profiles

_LADDER = ((Box("div", ("article-text",), first="page"),), (Box("article"),), ANY_P)

PROFILES = {
    "http": Profile("http", "", (ListSpec(""),), ladder=_LADDER, stop=d.STOPS, dates=("time_day",), summary_markers=()),
    "https": Profile(
        "https", "", (ListSpec(""),), ladder=_LADDER, stop=d.STOPS, dates=("time_day",), summary_markers=(),
        summary_ellipsis=False, drop_empty=True,
    ),
}

_LINES = "list_transform(paragraphs, lambda x: " + d.sql_trim("x") + ")"
_CUT = d.sql_cut("t", "(?i)^(?:" + "|".join(d.STOPS) + ")")
_LONG = f"list_filter({_LINES}, lambda x: length(x) > 80)[1]"
_PLACE = f"{d._sql_list(d.PLACES)}[(page_id % 25 + 1)::INT]"

JUDGED = f"""
{d.PARAGRAPHS}, {d.GAZETTEER}, {d.STATE_EDGES},
read_pages AS (
  SELECT page_id, url, split_part(url, '://', 1) AS source, len(paragraphs) AS n,
         CASE WHEN url LIKE 'https:%' THEN list_filter({_LINES}, lambda x: x <> '') ELSE {_LINES} END AS t,
         coalesce(substr({_LONG}, 1, 300) || (CASE WHEN url LIKE 'http:%' AND length({_LONG}) > 300 THEN '...' ELSE '' END), '') AS summary
  FROM paragraphs),
texts AS (SELECT *, coalesce(array_to_string(list_transform({_CUT}, lambda x: x || chr(10)), ''), '') AS body FROM read_pages),
found AS (SELECT *, {d.sql_first_keyword(['body'])} AS keyword FROM texts),
judged AS (
  SELECT * REPLACE (url || '/gone' AS url), 'load_failed' AS reason FROM found
  UNION ALL
  SELECT f.*, CASE WHEN url LIKE '%?page=%' THEN 'stored' WHEN n = 0 THEN 'no_text'
    WHEN keyword IS NULL THEN 'no_keyword' WHEN coalesce(l.quality, 0) <> 1 THEN 'not_illegal' ELSE 'accepted' END AS reason
  FROM found f LEFT JOIN labels l ON l.doc_id = f.page_id)"""

ACCEPTED = JUDGED + f""",
placed AS (
  SELECT page_id, url, summary, CASE WHEN page_id % 3 <> 0 THEN {_PLACE} END AS location,
         CASE WHEN page_id % 2 = 0 THEN 48 + (page_id % 12) * 0.5::DOUBLE END AS a_lat,
         CASE WHEN page_id % 2 = 0 THEN 7 + (page_id % 10) * 0.5::DOUBLE END AS a_lon
  FROM judged WHERE reason = 'accepted'),
located AS (
  SELECT p.*, CASE WHEN a_lat IS NULL AND location IS NOT NULL THEN geo_lat ELSE a_lat END AS lat,
         CASE WHEN a_lon IS NULL AND location IS NOT NULL THEN geo_lon ELSE a_lon END AS lon
  FROM placed p LEFT JOIN top_places g ON lower(p.location) = g.place_key),
inside AS (
  SELECT p.page_id, e.name FROM located p JOIN edges e
    ON (e.lat1 > p.lat) <> (e.lat2 > p.lat) AND p.lon < (e.lon2 - e.lon1) * (p.lat - e.lat1) / (e.lat2 - e.lat1) + e.lon1
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def _run(spark, sf_dir):
    pages = d.table(spark, sf_dir, "pages").withColumn("source", F.substring_index("url", "://", 1))
    k = F.col("page_id")
    null = F.lit(None).cast("string")
    links = pages.select(
        "source", F.lit(0).alias("feed"), F.lit(0).alias("list"), k.alias("page"), F.lit(0).alias("pos"),
        F.concat(F.lit("Meldung "), k.cast("string")).alias("title"), "url", null.alias("list_date_text"),
        null.cast("date").alias("list_date"), null.alias("event_location"), null.alias("list_region"),
    )
    scan = d.table(spark, sf_dir, "pages").withColumn("source", F.substring_index("url", "://", 1))
    # Beside each link one whose page did not load.
    links = links.unionByName(links.withColumns({"pos": F.lit(1), "url": F.concat("url", F.lit("/gone"))}))
    landed = scan.select("source", "url", "html", d.instant().alias("fetched_at"))
    landed = landed.unionByName(landed.select("source", F.concat("url", F.lit("/gone")).alias("url"), F.lit("").alias("html"), "fetched_at"))
    stored = pages.select("url").filter(F.contains("url", F.lit("?page=")))
    found = run.candidates(PROFILES, links, landed, stored, d.KEYWORDS, d.instant())

    names = F.array(*[F.lit(p) for p in d.PLACES])
    place = F.when(k % 3 != 0, F.element_at(names, (k % 25 + 1).cast("int")))
    point = F.when(k % 2 == 0, F.struct(
        (F.lit(48) + (k % 12) * F.lit(0.5)).alias("lat"), (F.lit(7) + (k % 10) * F.lit(0.5)).cast("string").alias("lon")
    ))
    labels = d.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id")
    content = F.to_json(F.struct(
        place.alias("ort"), point.alias("koord"), F.when(k % 4 == 0, F.lit("Hessen")).alias("bundesland"),
        (F.col("quality") == 1).alias("illegal"),
    ))
    message = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    answers = pages.select("page_id", "url").join(labels, "page_id").select("url", F.to_json(message).alias("response"))
    return found, answers


def _accepted(spark, sf_dir, found, answers):
    return run.accept(run.judge(PROFILES, found, answers, d.gazetteer(spark, sf_dir), d.nation_states(spark, sf_dir)))


@query("ingestion_run_e1", f"""
WITH {ACCEPTED}
SELECT p.url, 'Meldung ' || p.page_id AS title, p.summary, strftime(TIMESTAMP '{d.AS_OF}', '%Y-%m-%d') AS day, p.location,
  round(p.lat, 6) AS lat, round(p.lon, 6) AS lon,
  CASE WHEN p.page_id % 4 = 0 THEN 'Hessen' ELSE i.name END AS federal, 'Sonstige' AS type
FROM located p LEFT JOIN inside i ON i.page_id = p.page_id""")
def ingestion_run_e1(spark, sf_dir):
    """Raw pages to incident rows in one plan."""
    found, answers = _run(spark, sf_dir)
    return _accepted(spark, sf_dir, found, answers).select(
        "url", "title", "summary", d.text(F.col("date")).alias("day"), "location",
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "federal", "type",
    )


@query("reject_table_e1", f"WITH {JUDGED} SELECT source, url, reason FROM judged WHERE reason <> 'accepted'")
def reject_table_e1(spark, sf_dir):
    """Every link the run does not store, with its first reason; candidates are written once in between."""
    found, answers = _run(spark, sf_dir)
    found = cut_lineage(found)
    return run.rejected(found, answers, _accepted(spark, sf_dir, found, answers)).select("source", "url", "reason")


def _said(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Ten sources, each a chain of pages: those with an even number end where a page names itself, one at a page that did not load.
_CHAINS = {
    f"s{i}": Profile(f"s{i}", f"https://s{i}.example", (ListSpec(f"https://s{i}.example/0"),), url_rule="slash",
                     link_rules=(LinkRule(href_parts=("/b/",)),), extra={"follow_next": 40}) for i in range(10)
}


@query("followed_links_s9", """
WITH p AS (SELECT page_id, page_id % 10 AS s, page_id // 10 AS n FROM pages),
kept AS (SELECT * FROM p WHERE n < 40 AND (s % 2 = 1 OR n <= 16) AND (s <> 3 OR n < 5)),
linked AS (SELECT *, unnest(['', 'x']) AS tail FROM kept)
SELECT 's' || s AS source, n::BIGINT AS page, 'https://s' || s || '.example/b/' || page_id || tail AS url FROM linked""")
def followed_links_s9(spark, sf_dir):
    """Link collection of sources whose list pages name the next one: the chain from the first page, forty pages at most."""
    k = F.col("page_id")
    s, n = k % 10, F.floor(k / 10)
    ahead = F.when((s % 2 == 0) & (n == 16), n).otherwise(n + 1)
    html = _said('<a href="/b/', k, '">A</a> <a href="/b/', k, 'x">B</a><a rel="next" href="/', ahead, '">weiter</a>')
    pages = d.table(spark, sf_dir, "pages").select(
        _said("s", s).alias("source"), F.lit(0).alias("feed"), F.lit(0).alias("list"), (1000 + k).cast("int").alias("page"),
        _said("https://s", s, ".example/", n).alias("url"), F.when((s != 3) | (n != 5), html).alias("html"),
    )
    links = run.collect_links(_CHAINS, pages)
    return links.select("source", F.col("page").cast("bigint").alias("page"), "url")


@query("collected_links_l10", """
WITH p AS (SELECT page_id AS k FROM pages),
portal AS (SELECT k // 3 AS n, arg_min(k, (k % 2, k // 2)) AS k FROM p GROUP BY 1),
ends AS (SELECT min(k) AS first_k, max(k) AS last_k FROM p)
SELECT 'presseportal' AS source, 'https://www.presseportal.de/blaulicht/pm/' || n AS url, 'Meldung ' || k AS title, (k % 2)::BIGINT AS list, (k // 2)::BIGINT AS page FROM portal
UNION ALL SELECT 'mv', 'https://www.polizei.mvnet.de/mv' || k, 'MV ' || k, 0, k FROM p
UNION ALL SELECT 'sachsen-anhalt', 'https://www.sachsen-anhalt.de/bs/' || k, 'SA ' || k, 0, k FROM p
UNION ALL SELECT 'sachsen', 'https://medienservice.sachsen.de/medien/news-' || k, '(Ohne Titel)', 0, k FROM p
UNION ALL SELECT 'nrw', 'https://polizei.nrw/nrw' || j, CASE WHEN j = first_k THEN 'NRW ' ELSE 'next ' END || j, 0, greatest(j - 1, first_k)
FROM ends, range(first_k, least(last_k + 2, first_k + 100)) t(j)""")
def collected_links_l10(spark, sf_dir):
    """Link collection by the real rules of five sources; one reads feeds up to its target."""
    k = F.col("page_id")
    chosen = {s: default_profiles()[s] for s in ("presseportal", "mv", "sachsen-anhalt", "sachsen", "nrw")}
    lists = {
        "presseportal": (k % 2, F.floor(k / 2), _said('<a href="/blaulicht/pm/', F.floor(k / 3), '">POL-HH: Meldung ', k, '</a><a href="/sport/', k, '">x</a>')),
        "mv": (F.lit(0), k, _said('<div class="teaser dvz-contenttype-presseserviceassistent"><h3><a href="/mv', k, '">POL-NB: MV ', k, '</a></h3><h3><a href="/no">x</a></h3></div>')),
        "sachsen-anhalt": (F.lit(0), k, _said('<div class="tx-rssdisplay-newslist"><h2><a href="bs/', k, '"> SA \n ', k, ' </a></h2></div><h2><a href="/no">x</a></h2>')),
        "sachsen": (F.lit(0), k, _said('<a href="/medien/news-', k, '"> </a><a href="/medien/">x</a><a href="/medien/?search[a]=1">x</a>')),
    }
    pages = d.table(spark, sf_dir, "pages").select("page_id")
    each = F.explode(F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(0).alias("feed"), number.cast("int").alias("list"), page.cast("int").alias("page"),
                 F.lit("l").alias("url"), html.alias("html")) for s, (number, page, html) in lists.items()
    ]))
    list_pages = pages.select(each.alias("r")).select("r.*")
    item = lambda title, j: _said("<item><title>", title, j, "</title><link>/nrw", j, "</link></item>")
    feeds = pages.select(
        F.lit("nrw").alias("source"), F.lit(0).alias("feed"), F.lit(0).alias("list"), k.cast("int").alias("page"),
        F.concat(F.lit("<rss><channel>"), item("NRW ", k), item("next ", k + 1), F.lit("</channel></rss>")).alias("xml"),
    )
    links = run.collect_links(chosen, list_pages, feeds)
    return links.select("source", "url", "title", F.col("list").cast("bigint").alias("list"), F.col("page").cast("bigint").alias("page"))
