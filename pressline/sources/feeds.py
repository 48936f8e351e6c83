"""RSS feeds, JSON lists inside pages, and JSON payloads that carry HTML."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.once import let
from pressline.functions.text import is_falsy, trimmed

_ITEMS = "ARRAY<STRUCT<title:STRING,link:STRING,pubDate:STRING>>"
RSS_SCHEMA = f"channel STRUCT<item:{_ITEMS}>, item {_ITEMS}, _corrupt_record STRING"

# Fields that may carry HTML in a payload, in order of preference.
HTML_KEYS = ("html", "content", "data", "body")


def _items(parsed: Column) -> Column:
    whole = parsed["_corrupt_record"].isNull()
    return F.when(whole, F.coalesce(parsed["channel"]["item"], parsed["item"]))


def without_items(xml: Column) -> Column:
    """A feed that is not well-formed or lists nothing."""
    parsed = F.from_xml(xml, RSS_SCHEMA, {"mode": "PERMISSIVE"})
    return let(parsed, lambda r: F.coalesce(F.size(_items(r)), F.lit(0)) <= 0)


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per feed item that has a link: ``pos``, ``title``, ``link``, ``pub_date``.

    A feed that is not well-formed yields nothing, like one without items.
    """
    rest = [c for c in feeds.columns if c != xml]
    parsed = feeds.select(*rest, F.from_xml(F.col(xml), RSS_SCHEMA, {"mode": "PERMISSIVE"}).alias("_r"))
    rows = parsed.select(*rest, F.posexplode(_items(F.col("_r"))).alias("pos", "_i"))
    return rows.select(
        *rest,
        "pos",
        F.coalesce(trimmed(F.col("_i.title")), F.lit("")).alias("title"),
        trimmed(F.col("_i.link")).alias("link"),
        trimmed(F.col("_i.pubDate")).alias("pub_date"),
    ).filter(F.coalesce(F.col("link"), F.lit("")) != "")


def embedded_json(html: Column, variable: str) -> Column:
    """JSON array assigned to a script variable of the page, parsed; null where there is none."""
    pattern = rf"(?s){re.escape(variable)}\s*=\s*(\[.+?\]);"
    return F.from_json(F.regexp_extract(html, pattern, 1), "ARRAY<STRUCT<href:STRING,title:STRING>>")


def embedded_json_items(pages: DataFrame, variable: str, html: str = "html") -> DataFrame:
    """One row per list element that has a link and a title."""
    rest = [c for c in pages.columns if c != html]
    rows = pages.select(*rest, F.posexplode(embedded_json(F.col(html), variable)).alias("pos", "_i"))
    kept = rows.filter(~is_falsy(F.col("_i.href")) & ~is_falsy(F.col("_i.title")))
    return kept.select(*rest, "pos", F.col("_i.href").alias("href"), trimmed(F.col("_i.title")).alias("title"))


def insert_fragments(payload: Column) -> Column:
    """HTML of all ``insert`` commands of a payload, each closed by a newline; null where none."""
    commands = F.from_json(payload, "ARRAY<STRUCT<command:STRING,data:STRING>>")
    inserts = F.filter(commands, lambda x: (x["command"] == "insert") & ~is_falsy(x["data"]))
    joined = F.array_join(F.transform(inserts, lambda x: F.concat(x["data"], F.lit("\n"))), "")
    return F.when(joined != "", joined)


def _html_of(v: Column) -> Column:
    """First field of a JSON object that holds text under one of the known names."""
    def text(key: str) -> Column:
        value = F.try_variant_get(v, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))

    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(*[text(k) for k in HTML_KEYS]))


def unwrap_html(payload: Column) -> Column:
    """HTML of a payload that may be JSON.

    JSON: the first known field of the top level, else of the first element that has one. Everything
    else, and JSON without such a field, stays as it is; blank payloads become empty.
    """
    start = F.ltrim(F.regexp_replace(payload, r"^[\t\n\r\u0000\u000b ]+", ""))
    whole = F.try_parse_json(payload)
    fields = F.map_values(F.from_json(payload, "MAP<STRING,VARIANT>"))
    elements = F.from_json(payload, "ARRAY<VARIANT>")

    def first_nested(values: Column) -> Column:
        return F.get(F.filter(F.transform(values, _html_of), lambda x: x.isNotNull()), F.lit(0))

    nested = F.when(F.startswith(start, F.lit("{")), first_nested(fields)).otherwise(first_nested(elements))
    return (
        F.when(start == "", F.lit(""))
        .when(~start.rlike(r"^[\[{]"), payload)
        .otherwise(F.coalesce(_html_of(whole), nested, payload))
    )


def keyword_rows(config: DataFrame, column: str = "keywords") -> DataFrame:
    """Ordered keyword patterns of a JSON list: ``pos``, ``keyword``; no list, no rows."""
    rest = [c for c in config.columns if c != column]
    listed = F.coalesce(F.from_json(F.col(column), "ARRAY<STRING>"), F.array().cast("array<string>"))
    return config.select(*rest, F.posexplode(listed).alias("pos", "keyword"))
