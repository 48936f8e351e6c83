"""Views the queries share, once in Spark and once as SQL common table expressions.

The given tables hold no police texts, so dates, places, incidents and payloads are derived from
their rows by the same rule on both sides. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.urls import url_host
from pressline.sources.pages import extract_plain_links

AS_OF = "2024-01-25 12:00:00"

KEYWORDS = ("keit", "tion", "que", "the")
STOPS = ("th", "es ", "de ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def text(day: Column) -> Column:
    """Dates leave a query as text."""
    return F.date_format(day, "yyyy-MM-dd")


# -- pages and links ---------------------------------------------------------------------------

SCRIPTS = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a\s*>"""

CLEAN_PAGES = f"""
clean_pages AS (
  SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source,
         regexp_replace(html, '{SCRIPTS}', '', 'g') AS page
  FROM pages)"""


def sql_plain(markup: str) -> str:
    out = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


LINKS = CLEAN_PAGES + f""",
anchors AS (
  SELECT page_id, source, unnest(found) AS a, unnest(range(len(found))) AS pos
  FROM (SELECT page_id, source, regexp_extract_all(page, '{ANCHOR}') AS found FROM clean_pages)),
links AS (
  SELECT source, page_id AS page, pos,
         'https://' || source || regexp_extract(a, '{ANCHOR}', 1) AS url,
         {sql_plain(f"regexp_extract(a, '{ANCHOR}', 2)")} AS title
  FROM anchors)"""


def host_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.withColumn("source", url_host(F.col("url")))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain links of all pages: the host is the source, the page number its place in the list."""
    pages = host_pages(spark, sf_dir).select("source", F.col("page_id").alias("page"), "html")
    found = extract_plain_links(pages)
    url = F.concat(F.lit("https://"), "source", "href")
    return found.select("source", "page", F.col("pos").cast("bigint").alias("pos"), url.alias("url"), F.col("text").alias("title"))


# -- paragraphs --------------------------------------------------------------------------------

PARAGRAPHS = CLEAN_PAGES + f""",
blocks AS (
  SELECT page_id, url, CASE WHEN inner_html <> '' THEN inner_html ELSE page END AS block
  FROM (SELECT page_id, url, page, regexp_extract(page, '(?is)<article\\b[^>]*>(.*?)(?:</article\\s*>|\\z)', 1) AS inner_html
        FROM clean_pages)),
paragraphs AS (
  SELECT page_id, url,
         list_transform(list_slice(pieces, 2, len(pieces)),
                        lambda p: {sql_plain("regexp_replace(p, '(?is)</p\\s*>.*$', '')")}) AS paragraphs
  FROM (SELECT page_id, url, regexp_split_to_array(block, '(?i)<p(?:>|[\\s/][^>]*>)') AS pieces FROM blocks))"""

TRIM_SET = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"


def sql_trim(c: str) -> str:
    return f"trim({c}, {TRIM_SET})"


DOC_LINES = f"""
doc_lines AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS lines, text FROM documents)"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.split("text", "\n").alias("lines"), "text")


def sql_cut(lines: str, pattern: str) -> str:
    """Lines before the first that matches."""
    hit = f"list_position(list_transform({lines}, lambda x: regexp_matches(x, '{pattern}')), true)"
    return f"(CASE WHEN {hit} > 0 THEN list_slice({lines}, 1, {hit} - 1) ELSE {lines} END)"


def sql_first_keyword(texts: list[str], keywords: tuple[str, ...] = KEYWORDS) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"regexp_matches({t}, '(?i){k}')" for t in texts) + f" THEN '{k}'" for k in keywords
    )
    return f"CASE {whens} END"


# -- dates -------------------------------------------------------------------------------------

MONTH_NAMES = (
    "Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "DEZEMBER",
)
ENGLISH_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


DATES = f"""
dated AS (
  SELECT o_orderkey, o_orderdate::DATE AS day,
    CASE o_orderkey % 5
      WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:30:01'
      WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y')
      WHEN 2 THEN day(o_orderdate) || '. ' || {_sql_list(MONTH_NAMES)}[month(o_orderdate)] || ' ' || year(o_orderdate)
      WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:30' || (CASE WHEN o_orderkey % 2 = 0 THEN 'Z' ELSE ':15+02:00' END)
      ELSE 'gestern' END AS note
  FROM orders)"""


def dated_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date note per order, in a notation chosen by its key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    k = F.col("o_orderkey")
    month_name = F.element_at(names, F.month("day"))
    note = (
        F.when(k % 5 == 0, F.concat(text(F.col("day")), F.lit(" 10:30:01")))
        .when(k % 5 == 1, F.date_format("day", "dd.MM.yyyy"))
        .when(k % 5 == 2, F.concat_ws(" ", F.concat(F.day("day").cast("string"), F.lit(".")), month_name, F.year("day").cast("string")))
        .when(k % 5 == 3, F.concat(text(F.col("day")), F.lit("T10:30"), F.when(k % 2 == 0, F.lit("Z")).otherwise(F.lit(":15+02:00"))))
        .otherwise(F.lit("gestern"))
    )
    return orders.withColumn("note", note)


# -- places ------------------------------------------------------------------------------------

PLACES = (
    "Bonn", "Köln-Süd", "Ulm", "Richtung Trier", "Höhe Gera", "Polizeirevier", "Hagen", "Jena", "Mainz", "Essen",
    "Halle", "Kiel", "Lübeck", "Görlitz", "Feuerwehrhaus", "Rostock", "Fulda", "Celle", "Zwickau", "Potsdam",
    "Würzburg", "Höhenkirchen", "Aachen", "Bad", "Erfurt",
)

PLACE_NOTES = f"""
place_notes AS (
  SELECT c_custkey, c_nationkey,
         'Kontrolle ' || ['in', 'bei', 'nahe'][(c_custkey % 3 + 1)::INT] || ' ' || {_sql_list(PLACES)}[c_nationkey + 1]
         || ' am Abend' || (CASE WHEN c_custkey % 4 = 0 THEN ', danach in Ulm und bei Ulm' ELSE '' END) AS note
  FROM customer)"""

SQL_CANDIDATES = r"""
list_filter(regexp_extract_all(note, '\b(?:in|bei|nahe)\s+([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ-]+)', 1),
            lambda x: NOT regexp_matches(x, '^(Richtung|Höhe)(-|$)')
                      AND NOT regexp_matches(x, '(?i)Polizei|Kriminalpolizei|Staatsanwaltschaft|Feuerwehr'))"""


def place_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    words = F.array(*[F.lit(w) for w in ("in", "bei", "nahe")])
    names = F.array(*[F.lit(p) for p in PLACES])
    note = F.concat(
        F.lit("Kontrolle "), F.element_at(words, (F.col("c_custkey") % 3 + 1).cast("int")), F.lit(" "),
        F.element_at(names, F.col("c_nationkey") + 1), F.lit(" am Abend"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(", danach in Ulm und bei Ulm")).otherwise(F.lit("")),
    )
    return customer.withColumn("note", note)


# A place no text names: the texts' own third place is one the gazetteer lacks.
UNNAMED_PLACE = "Nirgendwo"

GAZETTEER = f"""
gazetteer AS (
  SELECT CASE WHEN s_nationkey = 2 THEN '{UNNAMED_PLACE}' ELSE {_sql_list(PLACES)}[s_nationkey + 1] END AS name, s_suppkey AS rank,
         47 + (s_suppkey % 70) * 0.1::DOUBLE AS lat, 6 + (s_suppkey % 80) * 0.1::DOUBLE AS lon
  FROM supplier),
top_places AS (
  SELECT lower(name) AS place_key, arg_min(lat, rank) AS geo_lat, arg_min(lon, rank) AS geo_lon
  FROM gazetteer GROUP BY 1)"""


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    names = F.array(*[F.lit(p) for p in PLACES])
    return supplier.select(
        F.when(F.col("s_nationkey") == 2, UNNAMED_PLACE).otherwise(F.element_at(names, F.col("s_nationkey") + 1)).alias("name"),
        F.col("s_suppkey").alias("rank"),
        (F.lit(47) + (F.col("s_suppkey") % 70) * F.lit(0.1)).alias("lat"),
        (F.lit(6) + (F.col("s_suppkey") % 80) * F.lit(0.1)).alias("lon"),
    )


# -- state polygons: one five-cornered field with a notch per nation -----------------------------

STATE_EDGES = """
corners AS (
  SELECT n_name AS name, unnest([0, 1, 2, 3, 4]) AS i,
         unnest([x, x + 1.0, x + 1.0, x + 0.53, x]) AS lon, unnest([y, y, y + 1.2, y + 0.71, y + 1.2]) AS lat
  FROM (SELECT n_name, 6.77 + (n_nationkey % 5) * 1.0 AS x, 47.77 + (n_nationkey // 5) * 1.2 AS y
        FROM (SELECT n_name, n_nationkey::DOUBLE % 5 AS c, n_nationkey FROM nation))),
edges AS (
  SELECT a.name, a.lon::DOUBLE AS lon1, a.lat::DOUBLE AS lat1, b.lon::DOUBLE AS lon2, b.lat::DOUBLE AS lat2
  FROM corners a JOIN corners b ON a.name = b.name AND b.i = (a.i + 1) % 5)"""


def nation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    x = F.lit(6.77) + (n % 5) * F.lit(1.0)
    y = F.lit(47.77) + F.floor(n / 5) * F.lit(1.2)
    corners = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.2), (0.53, 0.71), (0.0, 1.2))
    ring = F.array(*[F.struct((x + dx).alias("lon"), (y + dy).alias("lat")) for dx, dy in corners])
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.array(ring).alias("rings"))


# -- incidents ---------------------------------------------------------------------------------

INCIDENTS = """
incidents AS (
  SELECT event_id, 'Fall ' || event_id AS title, event_type || ' ' || props AS summary,
         (CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts::DATE END) AS date,
         48 + (user_id % 12) * 0.5::DOUBLE AS lat, 7 + (user_id % 10) * 0.5::DOUBLE AS lon,
         'https://example.org/e/' || event_id AS url,
         (CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' ELSE 'NATION_' || (user_id % 25) END) AS federal,
         ['A', 'W', 'O', 'Wetten', '', NULL][(event_id % 6 + 1)::INT] AS type,
         (CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN (CASE WHEN event_id % 2 = 0 THEN false END) END) AS approved
  FROM events)"""

SELECTED = tuple(f"NATION_{i}" for i in range(0, 25, 2))
SQL_SELECTED = ", ".join(f"'{s}'" for s in SELECTED)

SHOWN = INCIDENTS + f""",
shown AS (
  SELECT * FROM incidents
  WHERE approved AND (coalesce(federal, '') = '' OR federal IN ({SQL_SELECTED}))
    AND date >= DATE '2024-01-05' AND date <= DATE '2024-01-20')"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per event; the users' home points repeat, so many incidents share a point."""
    events = table(spark, sf_dir, "events")
    e, u = F.col("event_id"), F.col("user_id")
    types = F.array(*[F.lit(t).cast("string") for t in ("A", "W", "O", "Wetten", "", None)])
    return events.select(
        "event_id",
        F.concat(F.lit("Fall "), e.cast("string")).alias("title"),
        F.concat_ws(" ", "event_type", "props").alias("summary"),
        F.when(e % 97 != 0, F.col("ts").cast("date")).alias("date"),
        (F.lit(48) + (u % 12) * F.lit(0.5)).alias("lat"),
        (F.lit(7) + (u % 10) * F.lit(0.5)).alias("lon"),
        F.concat(F.lit("https://example.org/e/"), e.cast("string")).alias("url"),
        F.when(e % 7 == 0, F.lit(None)).when(e % 7 == 1, F.lit("")).otherwise(
            F.concat(F.lit("NATION_"), (u % 25).cast("string"))
        ).alias("federal"),
        F.element_at(types, (e % 6 + 1).cast("int")).alias("type"),
        F.when(e % 3 < 2, F.lit(True)).when(e % 2 == 0, F.lit(False)).alias("approved"),
    )
