"""Sources, listings and links (S and L operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.functions.text import clean_title, default_title, squeeze
from pressline.functions.urls import absolutize, url_host
from pressline.operators import links as lk
from pressline.operators.monitoring import links_per_page
from pressline.sources import feeds as fd
from pressline.sources import sql_functions
from pressline.sources.frontier import frontier
from pressline.sources.html_jobs import extract_links, next_links
from pressline.sources.pages import read_pages, split_loaded
from pressline.sources.pagination import page_chain
from pressline.sources.profiles import Box, LinkRule, ListSpec, Profile


def _str(c):
    return c.cast("string")


@query("frontier_s1", """
WITH lists AS (
  SELECT n_name AS source, 'https://' || lower(n_name) || '.example.org/list' AS base, n_nationkey, 3 + n_regionkey AS n FROM nation)
SELECT source, page,
  CASE WHEN n_nationkey % 2 = 0 THEN base || (CASE WHEN page > 0 THEN '/' || page * 30 ELSE '' END)
       ELSE base || '?page=' || page END AS url
FROM (SELECT source, base, n_nationkey,
             unnest(range((n_nationkey % 2)::BIGINT, (n_nationkey % 2 + n)::BIGINT)) AS page FROM lists)
""")
def frontier_s1(spark, sf_dir):
    n = F.col("n_nationkey")
    base = F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.org/list"))
    lists = d.table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("source"),
        F.when(n % 2 == 0, base).otherwise(F.concat(base, F.lit("?page=1"))).alias("first_url"),
        F.when(n % 2 == 0, F.concat(base, F.lit("/{offset}"))).otherwise(F.concat(base, F.lit("?page={page}"))).alias("template"),
        (n % 2).alias("first"),
        (F.col("n_regionkey") + 3).alias("n_pages"),
        F.lit(30).alias("step"),
    )
    return frontier(lists).select("source", F.col("page").cast("bigint").alias("page"), "url")


@query("raw_page_scan_s2", """
SELECT page_id, coalesce(html, '') IN ('', '0') AS failed,
       CASE WHEN coalesce(html, '') IN ('', '0') THEN 'load_failed' ELSE 'loaded' END AS reason
FROM pages
UNION ALL SELECT -1 - page_id, true, 'load_failed' FROM pages""")
def raw_page_scan_s2(spark, sf_dir):
    pages = read_pages(spark, f"{sf_dir}/pages.parquet", schema="page_id BIGINT, url STRING, html STRING")
    gone = F.when(F.col("page_id") % 2 == 0, F.lit(""))
    landed = pages.unionByName(pages.select((-1 - F.col("page_id")).alias("page_id"), "url", gone.alias("html")))
    loaded, failed = split_loaded(landed)
    return loaded.select("page_id", F.lit(False).alias("failed"), F.lit("loaded").alias("reason")).unionByName(
        failed.select("page_id", F.lit(True).alias("failed"), "reason")
    )


@query("rss_items_s3", f"""
SELECT o_orderkey, pos, title, link,
       strftime(o_orderdate + INTERVAL (CASE WHEN pos = 0 THEN 8 ELSE 0 END) HOUR, '%Y-%m-%d') AS pub_day
FROM (
  SELECT o_orderkey, o_orderdate, 0::BIGINT AS pos, o_orderpriority || ' & mehr' AS title, '/medien/' || o_orderkey AS link
  FROM orders WHERE o_orderkey % 4 <> 3
  UNION ALL
  SELECT o_orderkey, o_orderdate, 2, '', '/video/' || o_orderkey FROM orders WHERE o_orderkey % 4 <> 3)
""")
def rss_items_s3(spark, sf_dir):
    """The given file is one split: its narrow rows are dealt out before feeds are made of them, as landed feeds lie in many files."""
    key = _str(F.col("o_orderkey"))
    months = F.array(*[F.lit(m) for m in d.ENGLISH_MONTHS])
    orders = d.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    orders = orders.repartition(spark.sparkContext.defaultParallelism)
    day = F.concat_ws(
        " ", _str(F.day("o_orderdate")), F.element_at(months, F.month("o_orderdate")), _str(F.year("o_orderdate"))
    )
    xml = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Liste</title><item><title> '),
        F.col("o_orderpriority"), F.lit(" &amp; mehr</title><link> /medien/"), key,
        F.lit("</link><pubDate>Wed, "), day, F.lit(" 08:30:00 +0000</pubDate></item>"),
        F.lit("<item><title>ohne Link</title><link> </link></item><item><link>/video/"), key,
        F.lit("</link><pubDate>"), day, F.lit(" 01:59 +0100</pubDate></item>"),
        F.when(F.col("o_orderkey") % 4 == 3, F.lit("</channel>")).otherwise(F.lit("</channel></rss>")),
    )
    from pressline.functions.dates import rss_date

    items = fd.rss_items(orders.select("o_orderkey", xml.alias("xml")))
    return items.select(
        "o_orderkey", F.col("pos").cast("bigint").alias("pos"), "title", "link", d.text(rss_date(F.col("pub_date"))).alias("pub_day")
    )


@query("embedded_json_items_s4", """
SELECT c_custkey, 0::BIGINT AS pos, '/c/' || c_custkey AS href, c_name AS title FROM customer WHERE c_custkey % 5 <> 4
UNION ALL
SELECT c_custkey, 2, '/d/' || c_custkey, c_mktsegment FROM customer WHERE c_custkey % 5 < 3""")
def embedded_json_items_s4(spark, sf_dir):
    k = F.col("c_custkey")
    first = F.struct(F.concat(F.lit("/c/"), _str(k)).alias("href"), F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("title"))
    empty = F.struct(F.lit("").alias("href"), F.col("c_name").alias("title"))
    last = F.struct(F.concat(F.lit("/d/"), _str(k)).alias("href"), F.when(k % 5 < 3, F.col("c_mktsegment")).otherwise(F.lit("0")).alias("title"))
    rows = F.to_json(F.array(first, empty, last))
    data = F.when(k % 5 == 4, F.lit("null")).otherwise(rows)
    html = F.concat(F.lit("<script>\nwindow.listdata = "), data, F.lit(";\nvar other = [1];</script>"))
    pages = d.table(spark, sf_dir, "customer").select("c_custkey", html.alias("html"))
    items = fd.embedded_json_items(pages, "window.listdata")
    return items.select("c_custkey", F.col("pos").cast("bigint").alias("pos"), "href", "title")


@query("insert_fragments_s5", """
SELECT event_id,
  CASE WHEN event_id % 4 = 3 THEN NULL
       ELSE '<b>' || event_type || '</b>' || chr(10) || (CASE WHEN event_id % 4 = 1 THEN '' ELSE 'u' || user_id || chr(10) END) END AS html
FROM events""")
def insert_fragments_s5(spark, sf_dir):
    k = F.col("event_id")
    command = lambda name, data: F.struct(F.lit(name).alias("command"), data.alias("data"))
    payload = F.to_json(F.array(
        command("settings", F.lit("x")),
        command("insert", F.concat(F.lit("<b>"), "event_type", F.lit("</b>"))),
        command("insert", F.when(k % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("u"), _str(F.col("user_id"))))),
    ))
    rows = d.table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 4 == 3, F.lit("<html>")).otherwise(payload).alias("json")
    )
    return rows.select("event_id", fd.insert_fragments(F.col("json")).alias("html"))


@query("unwrap_html_s6", """
SELECT event_id,
  CASE event_id % 6
    WHEN 0 THEN '<p>' || event_type || '</p>' WHEN 1 THEN event_type WHEN 2 THEN 'n' || user_id
    WHEN 3 THEN ' <i>' || user_id || '</i>' WHEN 4 THEN props ELSE 'z' || user_id END AS html
FROM events""")
def unwrap_html_s6(spark, sf_dir):
    k, u = F.col("event_id") % 6, _str(F.col("user_id"))
    n = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    payload = (
        F.when(k == 0, n('{"data": "no", "html": "<p>', F.col("event_type"), '</p>"}'))
        .when(k == 1, n('\n{"html": 5, "body": "', F.col("event_type"), '"}'))
        .when(k == 2, n('{"x": {"y": 1}, "b": {"data": ["no"], "content": "n', u, '"}, "a": {"html": "late"}}'))
        .when(k == 3, n(" <i>", u, "</i>"))
        .when(k == 4, F.col("props"))
        .otherwise(n('[1, {"k": 1}, {"body": "z', u, '"}]'))
    )
    return d.table(spark, sf_dir, "events").select("event_id", fd.unwrap_html(payload).alias("html"))


@query("plain_links_s7", f"WITH {d.LINKS} SELECT source, page, pos, url, title FROM links")
def plain_links_s7(spark, sf_dir):
    return d.page_links(spark, sf_dir)


@query("selector_links_s7", f"""
WITH {d.LINKS}
SELECT page, pos, url, trim(title) AS title FROM links""")
def selector_links_s7(spark, sf_dir):
    """The profile-driven extraction, with nested boxes and a fallback rule."""
    pages = d.table(spark, sf_dir, "pages")
    listed = pages.select(
        F.lit("press").alias("source"), F.col("page_id").alias("page"), "url", url_host(F.col("url")).alias("host"), "html"
    )
    profile = Profile(
        "press", "", (ListSpec(""),),
        link_rules=(LinkRule((Box("div", ("missing",)),)), LinkRule((Box("nav"), Box("ul"), Box("li")))),
    )
    links = extract_links(listed, {"press": profile})
    return links.select(
        "page", F.col("pos").cast("bigint").alias("pos"),
        F.concat(F.lit("https://"), "host", "url").alias("url"), "title",
    )


@query("sql_links_s7", f"""
WITH {d.LINKS}
SELECT page, pos, url, trim(title) AS title FROM links""")
def sql_links_s7(spark, sf_dir):
    """The same extraction, asked for in SQL with the profile as argument."""
    profile = Profile(
        "press", "", (ListSpec(""),),
        link_rules=(LinkRule((Box("div", ("missing",)),)), LinkRule((Box("nav"), Box("ul"), Box("li")))),
    )
    sql_functions.register(spark, {"press": profile})
    found = spark.sql("""
        SELECT * FROM listing_anchors(
          TABLE(SELECT 'press' AS source, page_id AS page, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, html FROM {pages}),
          profile => 'press')""", pages=d.table(spark, sf_dir, "pages"))
    return sql_functions.links_of(found, profile).select(
        "page", F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("https://"), "host", "url").alias("url"), "title",
    )


@query("next_links_s8", """
SELECT page_id,
  CASE page_id % 5 WHEN 0 THEN 'https://example.org/list/' || (page_id + 1) WHEN 1 THEN 'https://example.org/list/' || (page_id + 2)
                   WHEN 2 THEN NULL WHEN 3 THEN 'https://example.org/a/' || page_id ELSE NULL END AS next_url,
  CASE WHEN page_id % 5 = 2 THEN 'https://example.org/more/' || page_id END AS load_url,
  CASE WHEN page_id % 5 = 4 THEN 'https://example.org/rss' END AS feed_url
FROM pages""")
def next_links_s8(spark, sf_dir):
    k = _str(F.col("page_id"))
    n = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    m = F.col("page_id") % 5
    pager = (
        F.when(m == 0, n('<a href="/x">weiter</a><a class="pager__next-item" href="/list/', _str(F.col("page_id") + 1), '">n</a>'))
        .when(m == 1, n('<a href="list/', _str(F.col("page_id") + 2), '"> Nächste\n Seite</a>'))
        .when(m == 2, n('<button class="button-reload big" data-url="/more/', k, '">mehr</button>'))
        .when(m == 3, n("<a rel=\"next\" href='https://example.org/a/", k, "'>x</a>"))
        .otherwise(n('<meta name="feed" content=" https://example.org/rss "><a rel="next" href="https://example.org/p/', k, '">self</a>'))
    )
    pages = d.table(spark, sf_dir, "pages").select(
        "page_id", n("https://example.org/p/", k).alias("url"), F.concat("html", pager).alias("html")
    )
    return next_links(pages).select("page_id", "next_url", "load_url", "feed_url")


@query("page_chain_s9", """
WITH RECURSIVE edges AS (
  SELECT page_id AS url, CASE WHEN page_id % 60 = 59 THEN page_id WHEN page_id % 60 = 29 THEN page_id - 5 ELSE page_id + 1 END AS nxt FROM pages),
chain(start, pos, url) AS (
  SELECT page_id, 0, page_id FROM pages
  UNION ALL
  SELECT c.start, c.pos + 1, e.nxt FROM chain c JOIN edges e ON c.url = e.url AND e.nxt <> e.url AND c.pos + 1 < 40
  WHERE e.nxt <= (SELECT max(page_id) FROM pages) + 1)
SELECT 'p' || start AS start, pos::BIGINT AS pos, 'p' || url AS url FROM chain""")
def page_chain_s9(spark, sf_dir):
    k = F.col("page_id")
    ahead = F.when(k % 60 == 59, k).when(k % 60 == 29, k - 5).otherwise(k + 1)
    pages = d.table(spark, sf_dir, "pages")
    name = lambda c: F.concat(F.lit("p"), _str(c))
    edges = pages.select(name(k).alias("url"), name(ahead).alias("next_url"))
    starts = pages.select(name(k).alias("start"))
    return page_chain(edges, starts, 40).select("start", F.col("pos").cast("bigint").alias("pos"), "url")


@query("keyword_list_s10", """
SELECT event_id, 0::BIGINT AS pos, event_type AS keyword FROM events
UNION ALL SELECT event_id, 1, 'k' || user_id FROM events""")
def keyword_list_s10(spark, sf_dir):
    """The list of every event; beside each a list that is JSON null or not there, which has no rows."""
    listed = F.to_json(F.array("event_type", F.concat(F.lit("k"), _str(F.col("user_id")))))
    events = d.table(spark, sf_dir, "events")
    without = F.when(F.col("event_id") % 2 == 0, F.lit("null"))
    rows = events.select("event_id", listed.alias("keywords")).unionByName(events.select("event_id", without.alias("keywords")))
    return fd.keyword_rows(rows).select("event_id", F.col("pos").cast("bigint").alias("pos"), "keyword")


@query("absolutize_l1", f"""
WITH {d.LINKS},
hrefs AS (SELECT page, pos, CASE pos % 6 WHEN 0 THEN title WHEN 1 THEN '?q=' || title WHEN 2 THEN '#' || title
                 WHEN 3 THEN 'https://x.org/' || title WHEN 4 THEN '' ELSE '//' || title END AS href FROM links)
SELECT page, pos,
  CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN href LIKE '?%' THEN 'https://b.org/' || href
       WHEN href LIKE '#%' THEN 'https://b.org//' || href WHEN href <> '' THEN 'https://b.org/' || ltrim(href, '/') END AS full_url,
  CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN 'https://b.org' || href
       WHEN href <> '' THEN 'https://b.org/' || href END AS slash_url,
  CASE WHEN href LIKE 'http%' THEN href ELSE 'https://b.org' || href END AS append_url,
  'https://b.org' || href AS prefix_url
FROM hrefs""")
def absolutize_l1(spark, sf_dir):
    t, m = F.col("title"), F.col("pos") % 6
    n = lambda s: F.concat(F.lit(s), t)
    href = (
        F.when(m == 0, t).when(m == 1, n("?q=")).when(m == 2, n("#")).when(m == 3, n("https://x.org/"))
        .when(m == 4, F.lit("")).otherwise(n("//"))
    )
    rows = d.page_links(spark, sf_dir).select("page", "pos", href.alias("href"))
    h = F.col("href")
    return rows.select(
        "page", "pos",
        absolutize(h, "https://b.org/").alias("full_url"),
        absolutize(h, "https://b.org", "slash").alias("slash_url"),
        absolutize(h, "https://b.org", "append").alias("append_url"),
        absolutize(h, "https://b.org", "prefix").alias("prefix_url"),
    )


@query("agency_prefix_l2", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'POL-TOOLONG: ' || c_name END AS title
FROM customer""")
def agency_prefix_l2(spark, sf_dir):
    k = F.col("c_custkey") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit(" POL-MÜK:\u00a0 "), "c_name"))
        .when(k == 1, F.concat(F.lit("POL-HH:"), "c_mktsegment", F.lit("\n")))
        .otherwise(F.concat(F.lit("POL-TOOLONG: "), "c_name"))
    )
    return d.table(spark, sf_dir, "customer").select("c_custkey", clean_title(raw).alias("title"))


@query("squeeze_l3", rf"""
SELECT doc_id, {d.sql_trim(r"regexp_replace(text, '[\s\x0b]+', ' ', 'g')")} AS text FROM documents""")
def squeeze_l3(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", squeeze(F.col("text")).alias("text"))


@query("default_title_l4", """
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' ELSE event_type END AS t FROM events)
SELECT event_id, CASE WHEN t IS NULL OR t IN ('', '0') THEN '(Ohne Titel)' ELSE t END AS strict_title,
       CASE WHEN t IS NULL OR t = '' THEN 'Ohne Titel' ELSE t END AS loose_title FROM t""")
def default_title_l4(spark, sf_dir):
    k = F.col("event_id") % 4
    t = F.when(k == 1, F.lit("")).when(k == 2, F.lit("0")).when(k == 3, F.col("event_type"))
    return d.table(spark, sf_dir, "events").select(
        "event_id",
        default_title(t, "(Ohne Titel)").alias("strict_title"),
        default_title(t, "Ohne Titel", zero_is_empty=False).alias("loose_title"),
    )


@query("link_predicates_l5", """
SELECT page_id, url FROM pages
WHERE url LIKE '%example%' AND url NOT LIKE '%?page=%'
  AND regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/en/[^/?]+')""")
def link_predicates_l5(spark, sf_dir):
    pages = d.table(spark, sf_dir, "pages").select("page_id", "url")
    return lk.link_filter(pages, include=("example",), exclude=("?page=",), path_pattern="/en/[^/?]+")


@query("first_wins_dedup_l6", f"""
WITH {d.LINKS}
SELECT source, url, page, pos, title FROM (
  SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY page, pos) AS n FROM links) WHERE n = 1""")
def first_wins_dedup_l6(spark, sf_dir):
    return lk.dedup_links(d.page_links(spark, sf_dir)).select("source", "url", "page", "pos", "title")


@query("last_region_l7", f"""
WITH {d.LINKS},
r AS (SELECT *, CASE WHEN page % 3 = 0 THEN NULL ELSE 'r' || page || '-' || pos END AS region FROM links),
f AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY page, pos) AS n FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY page DESC, pos DESC) AS n FROM r WHERE region IS NOT NULL)
SELECT f.source, f.url, f.title, f.page, g.region AS list_region
FROM f LEFT JOIN g ON f.source = g.source AND f.url = g.url AND g.n = 1 WHERE f.n = 1""")
def last_region_l7(spark, sf_dir):
    region = F.when(F.col("page") % 3 != 0, F.concat(F.lit("r"), _str(F.col("page")), F.lit("-"), _str(F.col("pos"))))
    links = d.page_links(spark, sf_dir).withColumn("list_region", region)
    return lk.dedup_links_with_region(links).select("source", "url", "title", "page", "list_region")


_RUN_PAGES = f"""
{d.CLEAN_PAGES},
run_pages AS (SELECT source, page_id AS page, (page_id % 7 = 3) AS bad FROM clean_pages)"""


@query("until_first_bad_l8", f"""
WITH {_RUN_PAGES}
SELECT source, page FROM (
  SELECT *, sum(bad::INT) OVER (PARTITION BY source ORDER BY page) AS b FROM run_pages) WHERE b = 0""")
def until_first_bad_l8(spark, sf_dir):
    pages = d.host_pages(spark, sf_dir).select("source", F.col("page_id").alias("page"))
    return lk.until_first_bad(pages, F.col("page") % 7 == 3).select("source", "page")


@query("until_nothing_new_l8", f"""
WITH {d.LINKS},
firsts AS (SELECT source, page, pos, url, row_number() OVER (PARTITION BY source, url ORDER BY page, pos) = 1 AS is_new FROM links),
per_page AS (SELECT source, page, max(is_new::INT) AS adds FROM firsts GROUP BY 1, 2),
all_pages AS (SELECT c.source, c.page_id AS page, coalesce(p.adds, 0) AS adds FROM clean_pages c
              LEFT JOIN per_page p ON p.source = c.source AND p.page = c.page_id),
stops AS (SELECT source, min(page) AS stop FROM all_pages WHERE adds = 0 GROUP BY 1)
SELECT l.source, l.page, l.pos, l.url FROM links l LEFT JOIN stops s ON s.source = l.source
WHERE s.stop IS NULL OR l.page < s.stop""")
def until_nothing_new_l8(spark, sf_dir):
    links = d.page_links(spark, sf_dir)
    pages = d.host_pages(spark, sf_dir).select("source", F.col("page_id").alias("page"))
    return lk.until_nothing_new(links, pages, keys=("source",)).select("source", "page", "pos", "url")


_CAPPED = """
WITH {links}, firsts AS (
  SELECT source, url, page, pos, row_number() OVER (PARTITION BY source, url ORDER BY page, pos) AS n FROM links)
SELECT source, url, page, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, pos) AS k FROM firsts WHERE n = 1) WHERE k <= {cap}"""


@query("target_cap_l9", _CAPPED.format(links=d.LINKS, cap=7))
def target_cap_l9(spark, sf_dir):
    distinct = lk.dedup_links(d.page_links(spark, sf_dir))
    return lk.cap_links(distinct, 7).select("source", "url", "page", "pos")


@query("target_cap_large_l9", _CAPPED.format(links=d.LINKS.replace(
    "SELECT source, page_id AS page", "SELECT 'all' AS source, page_id AS page"), cap=1200))
def target_cap_large_l9(spark, sf_dir):
    """A cap beyond what each task trims: whole pages past it are dropped by their counts first."""
    links = d.page_links(spark, sf_dir).withColumn("source", F.lit("all"))
    return lk.cap_links(lk.dedup_links(links), 1200).select("source", "url", "page", "pos")


_UNION = d.LINKS + """,
fed AS (SELECT *, CASE WHEN page % 2 = 0 THEN 0 ELSE 1 END AS feed FROM links),
united AS (SELECT source, url, feed, page, pos, title FROM (
  SELECT *, row_number() OVER (PARTITION BY source, url ORDER BY feed, page, pos) AS n FROM fed) WHERE n = 1)"""


@query("feed_union_l10", f"WITH {_UNION} SELECT source, url, feed::BIGINT AS feed, page, pos, title FROM united")
def feed_union_l10(spark, sf_dir):
    links = d.page_links(spark, sf_dir)
    both = lk.union_feeds(links.filter(F.col("page") % 2 == 0), links.filter(F.col("page") % 2 == 1))
    return both.select("source", "url", F.col("feed").cast("bigint").alias("feed"), "page", "pos", "title")


@query("fill_to_target_l11", f"""
WITH {_UNION}
SELECT source, url, feed::BIGINT AS feed FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY feed, page, pos) AS k FROM united) WHERE k <= 9""")
def fill_to_target_l11(spark, sf_dir):
    links = d.page_links(spark, sf_dir)
    first, second = links.filter(F.col("page") % 2 == 0), links.filter(F.col("page") % 2 == 1)
    return lk.fill_to_target(first, second, 9).select("source", "url", F.col("feed").cast("bigint").alias("feed"))


@query("run_order_l12", """
SELECT source, row_number() OVER (ORDER BY (source <> 'src7'), source || '.php') AS run_pos
FROM (SELECT DISTINCT source FROM documents)""")
def run_order_l12(spark, sf_dir):
    ordered = lk.run_order(d.table(spark, sf_dir, "documents"), first="src7")
    return ordered.select("source", F.col("run_pos").cast("bigint").alias("run_pos"))


@query("links_per_page_o3", f"""
WITH {d.LINKS},
firsts AS (SELECT source, page, row_number() OVER (PARTITION BY source, url ORDER BY page, pos) = 1 AS is_new FROM links)
SELECT source, page, count(*) AS n_links, sum(is_new::INT)::BIGINT AS n_new FROM firsts GROUP BY 1, 2""")
def links_per_page_o3(spark, sf_dir):
    return links_per_page(d.page_links(spark, sf_dir))
