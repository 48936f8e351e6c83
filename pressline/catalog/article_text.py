"""Article text and relevance (X and K operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.functions.once import computed_once
from pressline.functions.text import event_location
from pressline.operators import articles as art
from pressline.operators.keyword_index import first_keywords
from pressline.operators.relevance import first_keyword, keyword_context
from pressline.sources.html_jobs import article_facts
from pressline.sources.profiles import ANY_P, Box, ListSpec, Profile

_STOP = "^(?:that|den |les )"
_SKIP = "^(?:an|qu)"
_JOINED = "array_to_string({}, '|')"
_LINES = "list_transform(lines, lambda x: " + d.sql_trim("x") + ")"
_SQL_STOP = "(?i)" + _STOP
_SQL_SKIP = "(?i)" + _SKIP


def _docs(spark, sf_dir):
    """Lines of the documents; every third one is blank, so that empty lines occur everywhere."""
    docs = d.doc_lines(spark, sf_dir)
    spaced = F.transform("lines", lambda x, i: F.when(i % 3 == 2, F.lit(" \t ")).otherwise(F.concat(F.lit(" "), x)))
    return docs.withColumn("lines", spaced)


_DOCS = f"""{d.DOC_LINES},
docs AS (SELECT doc_id, lang, text, list_transform(lines, lambda x, i: CASE WHEN i % 3 = 0 THEN ' ' || chr(9) || ' ' ELSE ' ' || x END) AS lines FROM doc_lines)"""


@query("native_paragraphs_x1", f"""
WITH {d.PARAGRAPHS}
SELECT page_id, {_JOINED.format('paragraphs')} AS paragraphs, len(paragraphs)::BIGINT AS n FROM paragraphs""")
def native_paragraphs_x1(spark, sf_dir):
    pages = d.table(spark, sf_dir, "pages")
    found = computed_once(pages, {"p": art.native_paragraphs(F.col("html"))})
    return found.select("page_id", F.array_join("p", "|").alias("paragraphs"), F.size("p").cast("bigint").alias("n"))


def _ladder_profile(**extra):
    boxes = ((Box("div", ("article-text",), first="page"),), (Box("article"),), ANY_P)
    return {"press": Profile("press", "", (ListSpec(""),), ladder=extra.pop("ladder", boxes), **extra)}


@query("paragraph_ladder_x1", f"""
WITH {d.PARAGRAPHS}
SELECT page_id, {_JOINED.format('paragraphs')} AS paragraphs, 2::BIGINT AS rung FROM paragraphs""")
def paragraph_ladder_x1(spark, sf_dir):
    """The profile-driven ladder: the first rung finds nothing on these pages, the second does."""
    pages = d.table(spark, sf_dir, "pages").select(F.lit("press").alias("source"), "page_id", "url", "html")
    facts = article_facts(pages, _ladder_profile())
    return facts.select("page_id", F.array_join("paragraphs", "|").alias("paragraphs"), F.col("rung").cast("bigint").alias("rung"))


@query("anchored_paragraphs_x2", f"""
WITH {d.PARAGRAPHS}
SELECT page_id, CASE WHEN anchored THEN 0 ELSE 2 END::BIGINT AS rung,
  {_JOINED.format("(CASE WHEN anchored THEN list_slice(paragraphs, 2, 61) ELSE paragraphs END)")} AS paragraphs
FROM (SELECT *, regexp_extract(url, '#(.*)$', 1) = 'top' AND len(paragraphs) > 1 AS anchored FROM paragraphs)""")
def anchored_paragraphs_x2(spark, sf_dir):
    """Pages with a ``#top`` address are read after that element, here the first paragraph; if nothing
    follows it, by the ladder."""
    pages = d.table(spark, sf_dir, "pages").select(
        F.lit("press").alias("source"), "page_id", "url", F.regexp_replace("html", "(?s)^(.*?<article>.*?)<p>", '$1<p id="top">').alias("html")
    )
    facts = article_facts(pages, _ladder_profile(anchored=True))
    return facts.select("page_id", F.col("rung").cast("bigint").alias("rung"), F.array_join("paragraphs", "|").alias("paragraphs"))


@query("clean_lines_x3", f"""
WITH {_DOCS}
SELECT doc_id, {_JOINED.format(_LINES)} AS kept, {_JOINED.format(f"list_filter({_LINES}, lambda x: x <> '')")} AS filled FROM docs""")
def clean_lines_x3(spark, sf_dir):
    lines = F.col("lines")
    return _docs(spark, sf_dir).select(
        "doc_id", F.array_join(art.clean_lines(lines), "|").alias("kept"),
        F.array_join(art.clean_lines(lines, True), "|").alias("filled"),
    )


@query("stop_marker_x4", f"""
WITH {_DOCS}, trimmed AS (SELECT doc_id, {_LINES} AS t FROM docs)
SELECT doc_id, {_JOINED.format(d.sql_cut('t', _SQL_STOP))} AS kept FROM trimmed""")
def stop_marker_x4(spark, sf_dir):
    lines = art.take_until(art.clean_lines(F.col("lines")), "(?i)" + _STOP)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(lines, "|").alias("kept"))


@query("skip_lines_x5", f"""
WITH {_DOCS}, trimmed AS (SELECT doc_id, {_LINES} AS t FROM docs)
SELECT doc_id, {_JOINED.format(f"list_filter({d.sql_cut('t', _SQL_STOP)}, lambda x: NOT regexp_matches(x, '{_SQL_SKIP}'))")} AS kept
FROM trimmed""")
def skip_lines_x5(spark, sf_dir):
    lines = art.take_until(art.clean_lines(F.col("lines")), "(?i)" + _STOP)
    return _docs(spark, sf_dir).select("doc_id", F.array_join(art.drop_lines(lines, "(?i)" + _SKIP), "|").alias("kept"))


@query("content_text_x6", f"""
WITH {_DOCS}
SELECT doc_id, array_to_string(list_transform({_LINES}, lambda x: x || chr(10)), '') AS content_text FROM docs""")
def content_text_x6(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", art.content_text(art.clean_lines(F.col("lines"))).alias("content_text"))


_META_VALUE = "'Lage ' || doc_id || ' ' || regexp_replace(text, '[\"&<>'']', '', 'g') || ' \"' || lang || '\" & mehr'"


@query("meta_description_x7", f"""
SELECT doc_id,
  CASE doc_id % 4 WHEN 0 THEN {_META_VALUE} WHEN 1 THEN {_META_VALUE} WHEN 2 THEN 'd' || doc_id ELSE NULL END AS description
FROM documents""")
def meta_description_x7(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    n = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    value = n(" Lage ", k, " ", F.regexp_replace("text", "[\"&<>']", ""), " &quot;", F.col("lang"), "&quot; &amp; mehr ")
    m = F.col("doc_id") % 4
    head = (
        F.when(m == 0, n('<meta content="', value, '" name="description"><meta property="og:description" content="og">'))
        .when(m == 1, n('<meta property="og:description" content="', value, '">'))
        .when(m == 2, n("<meta name='description' content='d", k, "'>"))
        .otherwise(F.lit('<meta name="keywords" content="x">'))
    )
    docs = d.table(spark, sf_dir, "documents").select("doc_id", n("<html><head>", head, "</head></html>").alias("html"))
    return docs.select("doc_id", art.meta_description(F.col("html")).alias("description"))


@query("heading_title_x8", f"""
WITH {d.CLEAN_PAGES},
heads AS (SELECT page_id, regexp_extract(page, '(?is)<h1\\b[^>]*>.*?</h1\\s*>') AS h FROM clean_pages)
SELECT page_id, trim(regexp_replace({d.sql_plain('h')}, '\\s+', ' ', 'g')) AS title FROM heads
UNION ALL SELECT -1 - page_id, CASE WHEN page_id % 2 = 0 THEN 'Liste ' || page_id ELSE '' END FROM pages""")
def heading_title_x8(spark, sf_dir):
    """Every page, and beside each one without a heading or with an empty one."""
    pages = d.table(spark, sf_dir, "pages").select("page_id", "html", F.concat(F.lit("Liste "), F.col("page_id").cast("string")).alias("listed"))
    bare = F.when(F.col("page_id") % 2 == 0, F.lit("<p>kein Titel</p>")).otherwise(F.lit("<h1> </h1>"))
    rows = pages.unionByName(pages.select((-1 - F.col("page_id")).alias("page_id"), bare.alias("html"), "listed"))
    return rows.select("page_id", art.heading_title(art.heading(F.col("html")), F.col("listed")).alias("title"))


@query("event_location_x9", """
SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN c_name WHEN c_custkey % 4 = 2 THEN NULL ELSE 'Ort: ' || c_name END AS place FROM customer""")
def event_location_x9(spark, sf_dir):
    m = F.col("c_custkey") % 4
    label = (
        F.when(m == 0, F.concat(F.lit("Ereignisort: "), "c_name")).when(m == 1, F.concat(F.lit("EREIGNISORT:"), "c_name", F.lit(" ")))
        .when(m == 2, F.lit("Ereignisort: ")).otherwise(F.concat(F.lit("Ort: "), "c_name"))
    )
    return d.table(spark, sf_dir, "customer").select("c_custkey", event_location(label).alias("place"))


def _sql_summary(markers: bool, ellipsis: bool) -> str:
    skip = r" AND NOT regexp_matches(x, '(?i)^(?:the|\d{2}\.\d{2}\.\d{4}|kontakt)')" if markers else ""
    line = f"list_filter({_LINES}, lambda x: length(x) > 80{skip})[1]"
    tail = f" || (CASE WHEN length({line}) > 300 THEN '...' ELSE '' END)" if ellipsis else ""
    return f"coalesce(substr({line}, 1, 300){tail}, '')"


@query("summary_x10", f"""
WITH {_DOCS}
SELECT doc_id, {_sql_summary(True, True)} AS marked, {_sql_summary(False, False)} AS plain, substr(text, 1, 300) AS fallback FROM docs""")
def summary_x10(spark, sf_dir):
    lines = F.col("lines")
    return _docs(spark, sf_dir).select(
        "doc_id",
        art.summary(lines, ("the", r"\d{2}\.\d{2}\.\d{4}", "kontakt")).alias("marked"),
        art.summary(lines, (), ellipsis=False).alias("plain"),
        art.fallback_summary(F.col("text")).alias("fallback"),
    )


@query("first_keyword_k1", f"""
SELECT doc_id, {d.sql_first_keyword(['text'])} AS keyword FROM documents""")
def first_keyword_k1(spark, sf_dir):
    return d.table(spark, sf_dir, "documents").select("doc_id", first_keyword(F.col("text"), d.KEYWORDS).alias("keyword"))


@query("body_or_title_keyword_k2", f"""
WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 1) AS body FROM documents)
SELECT doc_id, {d.sql_first_keyword(['body', 'title'], ('ÜBER', 'äsch', 'QUE', 'éé', 'of'))} AS keyword FROM t""")
def body_or_title_keyword_k2(spark, sf_dir):
    title = F.substring_index("text", "\n", 1)
    docs = d.table(spark, sf_dir, "documents").select(
        "doc_id", title.alias("title"), F.substring(F.col("text"), F.length(title) + 1, F.length("text")).alias("body")
    )
    scope = [F.col("body"), F.col("title")]
    return docs.select("doc_id", first_keyword(scope, ("ÜBER", "äsch", "QUE", "éé", "of"), "unicode").alias("keyword"))


# A long list: the last word of each document, in the order of its hash; every third as a pattern that needs less than the word.
_LONG_LIST = r"""
w AS (SELECT DISTINCT regexp_extract(text, '([A-Za-z]{5,})[^A-Za-z]*$', 1) AS word FROM documents),
k AS (SELECT word, md5(word) AS rank, CASE WHEN substr(md5(word), 1, 1) < '5' THEN substr(word, 1, 3) || '[a-z]?' || substr(word, 5) ELSE word END AS keyword
      FROM w WHERE word <> ''),
hits AS (
  SELECT doc_id, keyword, rank FROM documents JOIN k
  ON CASE WHEN keyword = word THEN contains(lower(text), lower(word))
     ELSE contains(lower(text), lower(substr(word, 1, 3))) AND regexp_matches(text, '(?i)' || keyword) END)"""


@query("long_keyword_list_k1", f"""
WITH {_LONG_LIST} SELECT doc_id, arg_min(keyword, rank) AS keyword FROM hits GROUP BY doc_id""")
def long_keyword_list_k1(spark, sf_dir):
    """Hundreds to thousands of keywords as a table, searched through their trigrams."""
    docs = d.table(spark, sf_dir, "documents").select("doc_id", "text")
    word = F.regexp_extract("text", r"([A-Za-z]{5,})[^A-Za-z]*$", 1)
    listed = docs.select(word.alias("word")).filter("word <> ''").distinct().withColumn("rank", F.md5(F.col("word").cast("binary")))
    shorter = F.concat(F.substring("word", 1, 3), F.lit("[a-z]?"), F.substring("word", 5, 100_000))
    keywords = listed.select("rank", F.when(F.substring("rank", 1, 1) < "5", shorter).otherwise(F.col("word")).alias("keyword"))
    return first_keywords(docs, "doc_id", ["text"], keywords)


@query("keyword_context_k3", f"""
WITH k AS (SELECT doc_id, text, {d.sql_first_keyword(['text'], ('th[ei]', 'TION', 'que'))} AS keyword FROM documents),
p AS (SELECT *, strpos(lower(text), lower(keyword)) AS hit FROM k)
SELECT doc_id, keyword, CASE WHEN hit > 0 THEN substr(text, greatest(hit - 21, 0) + 1, 60) END AS context FROM p""")
def keyword_context_k3(spark, sf_dir):
    """The first keyword is a pattern that never occurs literally, so its context is null."""
    docs = d.table(spark, sf_dir, "documents").select(
        "doc_id", "text", first_keyword(F.col("text"), ("th[ei]", "TION", "que")).alias("keyword")
    )
    return docs.select("doc_id", "keyword", keyword_context(F.col("text"), F.col("keyword")).alias("context"))


_PRESS_LINES = d.sql_cut("t", "(?i)^(?:" + "|".join(d.STOPS) + ")")


@query("press_articles", f"""
WITH {d.PARAGRAPHS},
trimmed AS (SELECT page_id, list_transform(paragraphs, lambda x: {d.sql_trim('x')}) AS t FROM paragraphs WHERE len(paragraphs) > 0),
texts AS (SELECT page_id, t, coalesce(array_to_string(list_transform({_PRESS_LINES}, lambda x: x || chr(10)), ''), '') AS body FROM trimmed),
found AS (SELECT *, {d.sql_first_keyword(['body'])} AS keyword FROM texts)
SELECT page_id, keyword, length(body)::BIGINT AS n_chars,
  coalesce(substr(list_filter(t, lambda x: length(x) > 80)[1], 1, 300)
           || (CASE WHEN length(list_filter(t, lambda x: length(x) > 80)[1]) > 300 THEN '...' ELSE '' END), '') AS summary
FROM found WHERE keyword IS NOT NULL""")
def press_articles(spark, sf_dir):
    """The flagship: raw pages to relevant articles with keyword and summary, all in the JVM."""
    pages = d.table(spark, sf_dir, "pages").select("page_id", "html")
    split = computed_once(pages, {"paragraphs": art.native_paragraphs(F.col("html"))}).filter(F.size("paragraphs") > 0)
    lines = art.take_until(art.clean_lines(F.col("paragraphs")), art.line_start(d.STOPS))
    texts = computed_once(split, {"body": art.content_text(lines)})
    found = computed_once(texts, {"keyword": first_keyword(F.col("body"), d.KEYWORDS)}).filter(F.col("keyword").isNotNull())
    return found.select(
        "page_id", "keyword", F.length("body").cast("bigint").alias("n_chars"),
        art.summary(F.col("paragraphs")).alias("summary"),
    )
