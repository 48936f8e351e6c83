"""The ingestion run: landed pages to candidates, answers to incidents.

A run has two halves with the external classifier between them. The first half writes its candidates
to a table, so nothing is read or parsed again once the answers are there.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pressline.functions.dates import midnight, rss_date
from pressline.functions.once import computed_once
from pressline.functions.text import is_falsy
from pressline.operators import articles as art
from pressline.operators import classify, links as lk, monitoring, places, relevance, run_store, store
from pressline.operators.dating import is_fresh, with_publication
from pressline.session import cut_lineage
from pressline.sources import feeds as fd
from pressline.sources.html_jobs import article_facts, extract_links, finish_links, next_links
from pressline.sources.pages import load_failed
from pressline.sources.pagination import page_chain
from pressline.sources.profiles import Profile

SIDECARS = {
    "title": "string", "url": "string", "list_date_text": "string", "list_date": "date",
    "event_location": "string", "list_region": "string",
}
LINK_COLUMNS = ("source", "feed", "list", "page", "pos", *SIDECARS)


def by_source(profiles: Mapping[str, Profile], value: Callable[[Profile], Column], otherwise: Column) -> Column:
    """One expression per source, chosen by the row's source."""
    chosen = otherwise
    for p in profiles.values():
        chosen = F.when(F.col("source") == p.source, value(p)).otherwise(chosen)
    return chosen


def _shaped(links: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in SIDECARS.items() if c not in links.columns}
    return links.withColumns(missing).select(*LINK_COLUMNS) if missing else links.select(*LINK_COLUMNS)


def _listing_links(list_pages: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    ruled = {s: p for s, p in profiles.items() if p.link_rules}
    return _shaped(extract_links(list_pages.filter(F.col("source").isin(*ruled)), ruled))


def _on_chain(links: DataFrame, list_pages: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Links of sources that follow next links: those of pages on the chain from the first page, numbered by their place in it.

    Pages off the chain or behind its bound are left out; a page that did not load ends it. Pages are only read for their
    next links; links and places meet on the keys of a page, without its html. Links of other sources stay as they are.
    """
    bounds = {s: p.extra["follow_next"] for s, p in profiles.items() if p.extra.get("follow_next")}
    key = ("source", "feed", "list", "page")
    places = None
    for bound in sorted(set(bounds.values())):
        sources = [s for s, n in bounds.items() if n == bound]
        mine = list_pages.filter(F.col("source").isin(*sources))
        edges = next_links(mine.select("url", "html")).select("url", "next_url")
        first = [spec.first_url for s in sources for spec in profiles[s].lists]
        starts = mine.filter(F.col("url").isin(*first)).select(F.col("url").alias("start"))
        reached = page_chain(edges, starts, bound).groupBy("url").agg(F.min("pos").alias("_place"))
        found = mine.select(*key, "url").join(reached, "url").groupBy(*key).agg(F.min("_place").alias("_place"))
        places = found if places is None else places.unionByName(found)
    if places is None:
        return links
    placed = links.join(places, list(key), "left").filter(~F.col("source").isin(*bounds) | F.col("_place").isNotNull())
    return placed.withColumn("page", F.coalesce("_place", "page")).select(*links.columns)


def _script_links(list_pages: DataFrame, profiles: Mapping[str, Profile]) -> list[DataFrame]:
    """Sources that list their links in a script; a bad page ends the list where the source says so."""
    found = []
    for source, p in profiles.items():
        variable = p.extra.get("script_variable")
        if not variable:
            continue
        mine = list_pages.filter(F.col("source") == source)
        items = fd.embedded_json_items(mine, variable).drop("url")
        if p.page_rule == "stop":
            size = F.coalesce(F.size(fd.embedded_json(F.col("html"), variable)), F.lit(0))
            bad = load_failed(F.col("html")) | (size <= 0)
            items = lk.until_first_bad(mine, bad, keys=("source", "feed", "list"), rows=items)
        found.append(_shaped(finish_links(items, {source: p})))
    return found


def _feed_links(feeds: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    items = fd.rss_items(feeds).withColumnRenamed("link", "href")
    dated = items.withColumn("list_date", rss_date(F.col("pub_date"))).drop("pub_date")
    links = finish_links(dated, profiles)
    only = [p.source for p in profiles.values() if any("/artikel/" in r.href_parts for r in p.link_rules)]
    return _shaped(links.filter(~F.col("source").isin(*only) | F.contains("url", F.lit("/artikel/"))))


def _payload_links(payloads: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    commands = [p.source for p in profiles.values() if p.cap]
    html = F.when(F.col("source").isin(*commands), fd.insert_fragments(F.col("json"))).otherwise(
        fd.unwrap_html(F.col("json"))
    )
    pages = payloads.withColumn("html", html).withColumn("url", F.lit(None).cast("string")).drop("json")
    return _within_loads(_listing_links(pages, profiles), payloads, profiles)


def _within_loads(links: DataFrame, payloads: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Links of the chunks a source loads: so many from its first one on, and none from a chunk that did not load.

    Sources without a number of loads keep all chunks. The bounds are one row per list of a source.
    """
    loads = {s: p.extra["loads"] for s, p in profiles.items() if p.extra.get("loads")}
    if not loads:
        return links
    run = ("source", "feed", "list")
    most = F.lit(None).cast("int")
    for source, n in loads.items():
        most = F.when(F.col("source") == source, F.lit(n)).otherwise(most)
    bounds = payloads.filter(F.col("source").isin(*loads)).groupBy(*run).agg(
        F.min("page").alias("_first"), F.min(F.when(load_failed(F.col("json")), F.col("page"))).alias("_failed")
    ).select(*run, F.least(F.col("_first") + most, "_failed").alias("_end"))
    return links.join(bounds, list(run), "left").filter(
        F.col("_end").isNull() | (F.col("page") < F.col("_end"))
    ).select(*links.columns)


def _of(table: DataFrame | None, sources: Sequence[str]) -> DataFrame | None:
    return None if table is None else table.filter(F.col("source").isin(*sources))


def _raw_links(
    profiles: Mapping[str, Profile], list_pages: DataFrame, feeds: DataFrame | None, payloads: DataFrame | None
) -> DataFrame:
    """Links as listed, by the inputs of these sources only, so every page is read once."""
    names = list(profiles)
    parts = _script_links(list_pages, profiles)
    if any(p.link_rules for p in profiles.values()):
        parts.append(_on_chain(_listing_links(list_pages, profiles), list_pages, profiles))
    if feeds is not None:
        parts.append(_feed_links(_of(feeds, names), profiles))
    if payloads is not None:
        parts.append(_payload_links(_of(payloads, names), profiles))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def collect_links(
    profiles: Mapping[str, Profile], list_pages: DataFrame,
    feeds: DataFrame | None = None, payloads: DataFrame | None = None,
) -> DataFrame:
    """Distinct links of all sources in collection order, with their sidecars.

    Sources with a target are collected apart: their feeds end at the first page that adds nothing,
    which needs their links twice. Those (links, not pages) go to the shared folder in between.
    """
    open_ended = {s: p for s, p in profiles.items() if not p.cap}
    collected = []
    if open_ended:
        collected.append(lk.dedup_links_with_region(_raw_links(open_ended, list_pages, feeds, payloads)))
    for source, p in profiles.items():
        if not p.cap:
            continue
        listed = _raw_links({source: p}, list_pages, feeds, payloads)
        read = []
        if feeds is not None:
            # A feed that did not load is skipped, and so is a first one without items.
            passed = load_failed(F.col("xml")) | ((F.col("page") == 0) & fd.without_items(F.col("xml")))
            read.append(_of(feeds, [source]).filter(~passed))
        if payloads is not None:
            read.append(_of(payloads, [source]))
        if read:
            runs = [t.select("source", "feed", "page") for t in read]
            every = runs[0] if len(runs) == 1 else runs[0].unionByName(runs[1])
            listed = lk.until_nothing_new(cut_lineage(listed), every)
        collected.append(lk.cap_links(lk.dedup_links_with_region(listed), p.cap))
    links = collected[0]
    for part in collected[1:]:
        links = links.unionByName(part)
    return links


def with_text(facts: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Adds ``content_text`` and ``summary`` from the paragraphs by the rules of each source."""
    raw = F.col("paragraphs")

    def kept(p: Profile) -> Column:
        lines = art.clean_lines(raw, p.drop_empty)
        lines = art.take_until(lines, art.line_start(p.stop) if p.stop else None)
        lines = art.drop_lines(lines, art.line_start(p.skip) if p.skip else None)
        text = art.content_text(lines)
        if p.meta_fallback:
            text = F.coalesce(text, F.when(~is_falsy(F.col("meta_text")), F.col("meta_text")))
        return text

    def short(p: Profile) -> Column:
        text = art.summary(raw, p.summary_markers, p.summary_ellipsis)
        if p.meta_fallback:
            text = F.when(raw.isNull(), art.fallback_summary(F.col("meta_text"))).otherwise(text)
        return text

    none = F.lit(None).cast("string")
    return computed_once(facts, {
        "content_text": by_source(profiles, kept, none), "summary": by_source(profiles, short, none),
    })


# Date candidates of a page that the ladder needs after the join with the links.
DATE_FACTS = (
    "time_attr", "dated_time_attr", "time_text", "class_time_attr", "class_time_text", "dtstart_text",
    "meta_published", "dcterms_date", "date_box_text", "date_class_text", "labelled_date_text", "any_date_text",
)


def wanted_copies(article_pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The landed pages of the wanted ``(source, url)`` rows, the newest copies only.

    Which copy is newest is known from the key columns, so only the pages a run needs enter the page reader. Key tables
    below Spark's own limit are broadcast and no page text is shuffled; a larger one is joined on its keys.
    """
    keys = wanted.select("source", "url").distinct()
    newest = (
        article_pages.select("source", "url", "fetched_at").join(keys, ["source", "url"], "left_semi")
        .groupBy("source", "url").agg(F.max("fetched_at").alias("_newest"))
        .select(F.col("source").alias("_source"), F.col("url").alias("_url"), "_newest")
    )
    same = (
        (F.col("source") == F.col("_source")) & (F.col("url") == F.col("_url"))
        & F.col("fetched_at").eqNullSafe(F.col("_newest"))
    )
    return article_pages.join(newest, same, "left_semi")


def read_articles(profiles: Mapping[str, Profile], article_pages: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """What a run needs of each landed page, one row per source and URL.

    Pages are read where they lie: text, summary, keyword and date candidates come out of the scan, and the text of a
    page without keyword is dropped before the copies of a page meet. Of copies the newest counts, of equally new ones
    one that loaded.
    """
    landed = article_pages.filter(F.col("source").isin(*profiles)).select(
        "source", "url", "fetched_at", load_failed(F.col("html")).alias("failed"), "html"
    )
    texts = with_text(article_facts(landed, profiles), profiles)

    def in_body(p: Profile) -> Column:
        return relevance.first_keyword(F.col("content_text"), keywords, p.fold)

    titled = [p.source for p in profiles.values() if p.match_title]
    found = computed_once(texts, {"body_keyword": by_source(profiles, in_body, F.lit(None).cast("string"))})
    needed = F.col("body_keyword").isNotNull() | F.col("source").isin(*titled)
    facts = found.select(
        "source", "url", "fetched_at", (~F.col("failed")).alias("loaded"), "failed",
        F.col("content_text").isNotNull().alias("has_text"),
        F.when(needed, F.col("content_text")).alias("content_text"), F.when(needed, F.col("summary")).alias("summary"),
        "body_keyword", "h1", *DATE_FACTS,
    )
    rest = [c for c in facts.columns if c not in ("source", "url")]
    newest = facts.groupBy("source", "url").agg(F.max(F.struct(*rest)).alias("_n"))
    return newest.select("source", "url", *[F.col(f"_n.{c}").alias(c) for c in rest if c not in ("fetched_at", "loaded")])


def candidates(
    profiles: Mapping[str, Profile], links: DataFrame, article_pages: DataFrame, incidents: DataFrame | None,
    keywords: Sequence[str], as_of: Column,
) -> DataFrame:
    """All links with texts, dates and keyword; ``reason`` is null for those to classify.

    Links that are stored, or too old by their list date, are settled before any page is read. ``incidents`` is None where
    the store could not be read: then the policy of each source says whether its links count as stored.
    """
    early = by_source(
        profiles,
        lambda p: ~is_fresh(midnight(F.col("list_date")), as_of) if p.early_gate else F.lit(False),
        F.lit(False),
    )
    unknown = by_source(profiles, lambda p: F.lit(p.on_unknown == "exist"), F.lit(False))
    flagged = store.flag_stored(links, incidents, unknown).withColumn("early_old", F.coalesce(early, F.lit(False)))
    unsettled = flagged.filter(~F.col("stored") & ~F.col("early_old"))
    pages = wanted_copies(article_pages, unsettled)
    loaded = flagged.join(read_articles(profiles, pages, keywords), ["source", "url"], "left")
    titled = loaded.withColumn("title", by_source(
        profiles, lambda p: art.heading_title(F.col("h1"), F.col("title")) if p.heading_title else F.col("title"), F.col("title"),
    ))
    dated = with_publication(titled, {s: p.dates for s, p in profiles.items()}, as_of)

    def keyword(p: Profile) -> Column:
        if not p.match_title:
            return F.col("body_keyword")
        return relevance.first_keyword([F.col("content_text"), F.col("title")], keywords, p.fold)

    found = computed_once(dated, {"keyword": by_source(profiles, keyword, F.lit(None).cast("string"))})
    read = ~F.col("stored") & ~F.col("early_old")
    reason = monitoring.first_reason(
        stored=F.col("stored"),
        load_failed=read & F.coalesce("failed", F.lit(True)),
        no_text=read & ~F.coalesce("has_text", F.lit(False)),
        bad_date=read & F.col("bad_date"),
        too_old=F.col("early_old") | ~is_fresh(F.col("pub_ts"), as_of),
        no_keyword=F.col("keyword").isNull(),
    )
    context = relevance.keyword_context(F.col("content_text"), F.col("keyword"))
    return found.withColumns({"reason": reason, "context": context}).select(
        "source", "url", "title", "content_text", "summary", "pub_date", "pub_ts", "keyword", "context",
        "event_location", "list_region", "reason",
    )


def requests(found: DataFrame, model: str, instruction: str | None = classify.INSTRUCTION) -> DataFrame:
    """One classification request per candidate URL."""
    open_rows = found.filter(F.col("reason").isNull())
    once = open_rows.groupBy("url").agg(F.min("content_text").alias("content_text"))
    return classify.classification_requests(once, model, instruction)


def judge(
    profiles: Mapping[str, Profile], found: DataFrame, answers: DataFrame, gazetteer: DataFrame, states: DataFrame
) -> DataFrame:
    """Candidates with their answers resolved to place, point, state and type.

    ``reason`` is null for rows to store. A URL accepted for an earlier source counts as stored for
    the later ones.
    """
    open_rows = classify.with_answers(found.filter(F.col("reason").isNull()), answers)
    refused = monitoring.first_reason(not_illegal=~F.coalesce(classify.is_illegal(F.col("answer")), F.lit(False)))
    answered = open_rows.withColumn("reason", refused)
    a = F.col("answer")

    def place(p: Profile) -> Column:
        sidecar = F.col(p.place_sidecar) if p.place_sidecar else None
        return places.sidecar_location(
            a["ort"], F.col("content_text"), sidecar, p.sidecar_first, p.strict_places, p.null_only_place
        )

    placed = computed_once(answered.filter(F.col("reason").isNull()), {
        "location": by_source(profiles, place, a["ort"]),
        "lat_text": a["koord"]["lat"],
        "lon_text": a["koord"]["lon"],
        "type": classify.incident_type(a["typ"]),
        "date": F.col("pub_date"),
    })
    located = places.complete_coordinates(placed, gazetteer)
    pointed = places.state_of_point(located, states)
    final = pointed.withColumn(
        "federal", places.federal_state(a["bundesland"], F.col("lat"), F.col("lon"), F.col("point_state"))
    ).select("source", "url", "title", "summary", "date", "location", "lat", "lon", "federal", "type")
    return final


def rejected(found: DataFrame, answers: DataFrame, accepted: DataFrame) -> DataFrame:
    """Reject table: every link that is not stored by this run, with its first reason."""
    early = found.filter(F.col("reason").isNotNull()).select("source", "url", "reason")
    asked = classify.with_answers(found.filter(F.col("reason").isNull()).select("source", "url"), answers)
    kept = accepted.select("source", "url", F.lit(True).alias("kept"))
    late = asked.join(kept, ["source", "url"], "left").filter(F.col("kept").isNull())
    reason = F.when(classify.is_illegal(F.col("answer")), F.lit("stored")).otherwise(F.lit("not_illegal"))
    return early.unionByName(late.select("source", "url", reason.alias("reason")))


def accept(judged: DataFrame) -> DataFrame:
    """Rows to store, one per URL."""
    return store.dedup_accepted(judged)


def run_ingestion(
    profiles: Mapping[str, Profile], found: DataFrame, answers: DataFrame, gazetteer: DataFrame,
    states: DataFrame, incidents_path: str, rejects_path: str, accepted_path: str, run: str, seen: Sequence[str] = (),
) -> DataFrame:
    """Second half of a run: writes accepted rows and rejects, stores the incidents of ``run``, returns the funnel.

    ``found`` should be a written table (the first half's output). Accepted rows are written once and
    read back for the store and the rejects; rows are counted while they are written. ``seen`` are the runs that were stored when the links were checked
    (``run_store.stored_runs``). A run that is repeated, from any point, replaces what it wrote before.
    """
    spark, sources = found.sparkSession, list(profiles)
    kept, refused = Observation(), Observation()
    judged = accept(judge(profiles, found, answers, gazetteer, states))
    none = F.lit(None).cast("string")
    judged.observe(kept, *monitoring.counted(sources, none)).write.mode("overwrite").parquet(accepted_path)
    accepted = spark.read.parquet(accepted_path)
    rejects = rejected(found, answers, accepted)
    rejects.observe(refused, *monitoring.counted(sources)).write.mode("overwrite").parquet(rejects_path)
    run_store.write_run(store.incident_rows(accepted), incidents_path, run, seen)
    counts = [row for seen_rows in (kept, refused) for row in monitoring.count_rows(sources, seen_rows.get)]
    return monitoring.observed_funnel(spark, counts)
