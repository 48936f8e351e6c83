"""Arrow jobs over landed HTML: article facts, listing links, next pages.

Spark partitions the pages; a task reads batch after batch and keeps nothing between pages. The
other columns of a batch pass through as Arrow arrays and are never turned into Python objects.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import urldefrag

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline.functions.dates import any_german_date_text, german_date_text, iso_date_text
from pressline.functions.once import computed_once
from pressline.functions.text import clean_title, default_title, event_location, squeeze, trimmed
from pressline.functions.urls import absolutize
from pressline.operators.links import link_predicate
from pressline.sources import html_nodes, profiles as _profiles
from pressline.sources.html_nodes import Page
from pressline.sources.profiles import Profile

# The helper modules travel with the job, so executors need no installed copy of the package.
for _module in (html_nodes, _profiles, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)

ANCHOR_PARAGRAPHS = 60

FACTS = T.StructType([
    T.StructField("rung", T.IntegerType()),
    T.StructField("paragraphs", T.ArrayType(T.StringType())),
    *[T.StructField(name, T.StringType()) for name in (
        "h1", "time_attr", "dated_time_attr", "time_text", "class_time_attr", "class_time_text",
        "dtstart_text", "meta_published", "dcterms_date", "date_box_text", "meta_text",
    )],
    T.StructField("date_texts", T.ArrayType(T.StringType())),
])

ANCHORS = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("href", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("item_date_text", T.StringType()),
    T.StructField("item_time_attr", T.StringType()),
    T.StructField("item_place", T.StringType()),
    T.StructField("item_region", T.StringType()),
])

NEXT = T.StructType([
    T.StructField("next_href", T.StringType()),
    T.StructField("load_href", T.StringType()),
    T.StructField("feed_href", T.StringType()),
])

_ARROW = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.ArrayType(T.StringType()): pa.list_(pa.string())}


def _page_job(df: DataFrame, html: str, out: T.StructType, read: Callable, many: bool) -> DataFrame:
    """Runs ``read(row, page)`` for each page with content; ``many`` yields any number of rows each."""
    keep = [c for c in df.columns if c != html]
    known = [c for c in ("source", "url") if c in keep]
    arrow = {f.name: _ARROW[f.dataType] for f in out}
    schema = T.StructType([df.schema[c] for c in keep] + list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in known]
            rows: list[int] = []
            values: dict[str, list] = {name: [] for name in arrow}
            for i, markup in enumerate(batch.column(html).to_pylist()):
                row = {c: k[i] for c, k in zip(known, keys)}
                found = read(row, Page(markup)) if markup else None
                for record in (found or []) if many else [found or {}]:
                    rows.append(i)
                    for name in values:
                        values[name].append(record.get(name))
            kept = batch.select(keep).take(pa.array(rows, pa.int64()))
            columns = kept.columns + [pa.array(values[n], t) for n, t in arrow.items()]
            yield pa.RecordBatch.from_arrays(columns, names=keep + list(arrow))

    return df.mapInArrow(run, schema)


def _first(page: Page, nodes: list[int]) -> int | None:
    return nodes[0] if nodes else None


def _article_facts(page: Page, profile: Profile | None, url: str) -> dict:
    facts: dict = {}
    found: list[int] = []
    rung = None
    fragment = urldefrag(url or "").fragment
    if profile and profile.anchored and fragment:
        found, rung = page.after_anchor(fragment, ANCHOR_PARAGRAPHS), 0
    for number, boxes in enumerate(profile.ladder if profile else (_profiles.ANY_P,), 1):
        if found:
            break
        found, rung = page.paragraphs_in(boxes), number
    if found:
        facts["paragraphs"], facts["rung"] = [page.text(i) for i in found], rung

    h1 = _first(page, page.nodes("h1"))
    times = page.nodes("time")
    stamped = _first(page, [i for i in times if page.has(i, "datetime")])
    dated = _first(page, [i for i in times if page.tag[page.parent[i]] == "p" and page.class_has(page.parent[i], "date")])
    classed = _first(page, [i for i in times if page.class_has(i, "date")])
    box = _first(page, [
        i for i in page.nodes("div", "p", "time")
        if page.tag[i] == "time"
        or (page.tag[i] == "p" and page.class_has(i, "date"))
        or (page.tag[i] == "div" and page.class_has(i, "tx-rssdisplay-item-meta-date"))
    ])
    start = _first(page, [i for i in page.nodes("span") if page.class_has(i, "dtstart")])
    wanted = profile is None or "date_class" in profile.dates
    labelled = [i for i in range(1, len(page.tag)) if page.class_has(i, "date", "datum")] if wanted else []
    facts["h1"] = page.text(h1) if h1 else None
    facts["time_attr"] = page.attr(stamped, "datetime") if stamped else None
    facts["dated_time_attr"] = page.attr(dated, "datetime") if dated else None
    facts["time_text"] = page.text(times[0]) if times else None
    facts["class_time_attr"] = page.attr(classed, "datetime") if classed else None
    facts["class_time_text"] = page.text(classed) if classed else None
    facts["dtstart_text"] = page.text(start) if start else None
    facts["date_box_text"] = page.text(box) if box else None
    if labelled:
        facts["date_texts"] = [page.text(i) for i in labelled]

    metas = [(page.attrs(i), i) for i in page.nodes("meta")]

    def content(**wanted: tuple[str, ...]) -> str | None:
        for attrs, _ in metas:
            if "content" in attrs and any(attrs.get(k) in v for k, v in wanted.items()):
                return attrs["content"]
        return None

    facts["meta_published"] = content(
        property=("article:published_time",), name=("date", "publish-date"), itemprop=("datePublished",)
    )
    facts["dcterms_date"] = content(name=("dcterms.date",))
    description = content(name=("description",))
    facts["meta_text"] = description if description is not None else content(property=("og:description",))
    return facts


def article_facts(pages: DataFrame, profiles: Mapping[str, Profile], html: str = "html") -> DataFrame:
    """Paragraphs by the ladder of each source, heading, and every date candidate of a page.

    Dates looked up in the raw page text (``labelled_date_text``, ``any_date_text``) come from JVM
    patterns, for the sources whose ladder has them; so do the texts of elements named after dates, of
    which only the first date is kept (``date_class_text``). The page text itself is dropped.
    """
    profiles = dict(profiles)

    def read(row: dict, page: Page) -> dict:
        return _article_facts(page, profiles.get(row.get("source")), row.get("url"))

    def uses(rung: str):
        named = [s for s, p in profiles.items() if rung in p.dates]
        return F.col("source").isin(*named) if "source" in pages.columns else F.lit(True)

    raw = F.col(html)
    dated = pages.withColumns({
        "labelled_date_text": F.when(uses("after_label"), german_date_text(raw, "after_label")),
        "any_date_text": F.when(uses("anywhere"), german_date_text(raw, "anywhere")),
    })
    facts = _page_job(dated, html, FACTS, read, many=False)
    texts = ("time_text", "class_time_attr", "class_time_text", "dtstart_text", "meta_published", "date_box_text", "meta_text")
    return facts.withColumns({
        "h1": squeeze(F.col("h1")),
        "date_class_text": F.get(F.filter(
            F.transform("date_texts", lambda t: any_german_date_text(trimmed(t))), lambda day: day.isNotNull()
        ), F.lit(0)),
        **{c: trimmed(F.col(c)) for c in texts},
    }).drop("date_texts")


def _item_facts(page: Page, profile: Profile, anchor: int, rule) -> dict:
    """Sidecars of a link: date, place and region of its list entry."""
    facts: dict = {}
    own_time = _first(page, page.nodes("time", below=anchor))
    if own_time:
        facts["item_time_attr"], facts["item_date_text"] = page.attr(own_time, "datetime"), page.text(own_time)
    if not rule.item:
        return facts
    item = page.parent[anchor]
    while item > 0 and not page._fits(item, rule.item):
        item = page.parent[item]
    if item <= 0:
        return facts
    time = _first(page, page.nodes("time", below=item))
    date = _first(page, [i for i in page.nodes("div", below=item) if page.class_has(i, "date")])
    place = _first(page, [i for i in page.nodes("span", below=item) if page.class_has(i, "category")])
    wanted = profile.extra.get("region_href")
    region = _first(page, [
        i for i in page.nodes("a", below=item) if wanted and wanted in page.attr(i, "href") and page.inside(i, "p")
    ])
    if time:
        facts["item_time_attr"] = page.attr(time, "datetime")
    if date:
        facts["item_date_text"] = page.text(date)
    facts["item_place"] = page.text(place) if place else None
    facts["item_region"] = page.text(region) if region else None
    return facts


def listing_anchors(page: Page, profile: Profile) -> list[dict]:
    """Anchors of the first link rule that finds any."""
    for rule in profile.link_rules:
        tops = [(0, 0)]                                   # innermost box, box that gives one link
        for level, box in enumerate(rule.within):
            inner = {}
            for top, owner in tops:
                for i in page.boxes(box, below=top):
                    inner[i] = i if level <= rule.one_per else owner
            tops = sorted(inner.items())
        rows: list[dict] = []
        taken: set[int] = set()
        served: set[int] = set()
        for top, owner in tops:
            for a in page.nodes("a", below=top):
                href = page.attr(a, "href")
                if a in taken or owner in served or not page.class_has(a, rule.anchor_class):
                    continue
                if not all(part in href for part in rule.href_parts):
                    continue
                taken.add(a)
                if rule.one_per >= 0:
                    served.add(owner)
                if any(part in href for part in rule.href_not):
                    continue
                titled = page.nodes(rule.title_tag, below=owner if rule.title_in_box else a) if rule.title_tag else [a]
                text = page.text(titled[0]) if titled else page.text(a) if rule.title_in_box else ""
                rows.append({"href": href, "text": text, **_item_facts(page, profile, a, rule)})
        if rows:
            return [{"pos": n, **row} for n, row in enumerate(rows)]
    return []


def extract_links(list_pages: DataFrame, profiles: Mapping[str, Profile], html: str = "html") -> DataFrame:
    """Links of listing pages by the rules of their source, with sidecars, absolute and filtered.

    Returns the page columns without the page text and URL, then ``pos, title, url, list_date_text,
    list_date, event_location, list_region``.
    """
    profiles = dict(profiles)

    def read(row: dict, page: Page) -> list[dict]:
        profile = profiles.get(row.get("source"))
        return listing_anchors(page, profile) if profile else []

    found = _page_job(list_pages, html, ANCHORS, read, many=True)
    return finish_links(found.withColumnRenamed("text", "title").drop("url"), profiles)


def finish_links(found: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Absolute URL, title rule and sidecars per source, then the link predicates of each source."""
    source, href, raw = F.col("source"), F.col("href"), F.col("title")
    url, title = F.lit(None).cast("string"), trimmed(raw)
    keep = F.lit(True)
    for p in profiles.values():
        mine = source == p.source
        link = href if p.url_rule == "append" or p.url_rule == "prefix" else trimmed(href)
        url = F.when(mine, absolutize(link, p.base, p.url_rule)).otherwise(url)
        named = {"agency": clean_title, "squeeze": squeeze}.get(p.title_rule, trimmed)(raw)
        if p.placeholder:
            named = default_title(named, p.placeholder, zero_is_empty=p.source == "sachsen")
        title = F.when(mine, named).otherwise(title)
    known = {c for c in found.columns}
    text = F.col("item_date_text") if "item_date_text" in known else F.lit(None).cast("string")
    attr = F.col("item_time_attr") if "item_time_attr" in known else F.lit(None).cast("string")
    place = F.col("item_place") if "item_place" in known else F.lit(None).cast("string")
    region = F.col("item_region") if "item_region" in known else F.lit(None).cast("string")
    strict = F.coalesce(
        iso_date_text(F.when(F.length(trimmed(attr)) == 10, trimmed(attr))), german_date_text(trimmed(text), "exact")
    )
    day = F.when(source == "bremen", strict).when(source == "nrw", iso_date_text(attr))
    sidecars = {
        "url": url,
        "title": title,
        "list_date_text": F.when(source == "berlin", trimmed(text)),
        "event_location": event_location(squeeze(place)),
        "list_region": trimmed(region),
    }
    if "list_date" not in known:
        sidecars["list_date"] = F.try_to_date(day, "yyyy-MM-dd")
    rows = computed_once(found, sidecars).drop(
        "href", "item_date_text", "item_time_attr", "item_place", "item_region"
    ).filter(F.col("url").isNotNull())
    for p in profiles.values():
        if p.exclude or p.path_pattern:
            fits = link_predicate(F.col("url"), exclude=p.exclude, path_pattern=p.path_pattern)
            keep = keep & ((source != p.source) | fits)
    return rows.filter(keep)


def _next_links(page: Page) -> dict:
    anchors = page.nodes("a")
    marked = [i for i in anchors if page.attr(i, "rel") == "next" or page.class_has(i, "next")]
    if not marked:
        named = [(i, " ".join(page.text(i).split()).lower()) for i in anchors]
        marked = [i for i, t in named if "weiter" in t or "nächste" in t]
    button = [i for i in page.nodes("button") if page.class_has(i, "button-reload") and page.has(i, "data-url")]
    feed = [i for i in page.nodes("meta") if page.attr(i, "name") == "feed" and page.has(i, "content")]
    return {
        "next_href": page.attr(marked[0], "href") if marked else None,
        "load_href": (page.attr(button[0], "data-url") or None) if button else None,
        "feed_href": page.attr(feed[0], "content").strip() if feed else None,
    }


def next_links(pages: DataFrame, base: str | None = None, html: str = "html") -> DataFrame:
    """Edges of a listing: the following page, the "load more" address and the feed of each page.

    A page that names itself as its successor has none.
    """
    def read(row: dict, page: Page) -> dict:
        return _next_links(page)

    edges = _page_job(pages, html, NEXT, read, many=False)
    root = base if base is not None else F.regexp_extract("url", r"^https?://[^/]+", 0)
    target = absolutize(F.col("next_href"), root, "slash")
    return edges.withColumns({
        "next_url": F.when(target != F.col("url"), target),
        "load_url": absolutize(F.col("load_href"), root, "slash"),
        "feed_url": F.col("feed_href"),
    }).drop("next_href", "load_href", "feed_href")
