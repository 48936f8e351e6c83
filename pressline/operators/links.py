"""Article links: predicates, deduplication, caps, feed union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions.urls import url_path
from pressline.operators.skew import first_per_key, salted_lookup

# Position of a link in a run: feed, list within the feed, page of the list, place on the page.
LINK_ORDER = ("feed", "list", "page", "pos")

# Pages whose link counts are added up together, before the blocks are.
PAGE_BLOCK = 1024


def order_columns(df: DataFrame) -> list[str]:
    return [c for c in LINK_ORDER if c in df.columns]


def link_predicate(
    url: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), path_pattern: str | None = None
) -> Column:
    """True for links that contain every ``include`` text, no ``exclude`` text, and whose path fits."""
    tests = [F.contains(url, F.lit(x)) for x in include] + [~F.contains(url, F.lit(x)) for x in exclude]
    if path_pattern:
        tests.append(F.coalesce(url_path(url), F.lit("")).rlike(path_pattern))
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def link_filter(
    links: DataFrame,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    path_pattern: str | None = None,
    column: str = "url",
) -> DataFrame:
    return links.filter(link_predicate(F.col(column), include, exclude, path_pattern))


def dedup_links(links: DataFrame, keys: Sequence[str] = ("source", "url")) -> DataFrame:
    """First occurrence of each URL in a source, in collection order."""
    return first_per_key(links, list(keys), order_columns(links))


def dedup_links_with_region(links: DataFrame, region: str = "list_region") -> DataFrame:
    """First occurrence of each URL, but with the last region label seen for it.

    One aggregation answers both: the earliest row, and the latest row that has a region.
    """
    order = F.struct(*order_columns(links))
    rest = [c for c in links.columns if c not in ("source", "url", region)]
    picked = links.groupBy("source", "url").agg(
        F.min_by(F.struct(*rest), order).alias("_first"),
        F.max_by(F.col(region), F.when(F.col(region).isNotNull(), order)).alias(region),
    )
    return picked.select(
        *[F.col(c) if c in ("source", "url", region) else F.col(f"_first.{c}").alias(c) for c in links.columns]
    )


def until_first_bad(
    pages: DataFrame, bad: Column, keep_first_page: int | None = None, keys: Sequence[str] = ("source",),
    rows: DataFrame | None = None,
) -> DataFrame:
    """Pages of each list run (``keys``) before its first bad page.

    ``keep_first_page`` names a page number that never ends the run (a failed first page is skipped
    there, not final); a source may hold most pages, so its rows are salted for the join. ``rows`` may hold what was already read from the good pages, so that the page
    texts themselves are not shuffled. The first bad page per run comes from map-side minima, one row
    per run; no page list is gathered in a single task.
    """
    stops = bad if keep_first_page is None else bad & (F.col("page") != keep_first_page)
    first_bad = pages.filter(stops).groupBy(*keys).agg(F.min("page").alias("_first_bad"))
    kept = pages.filter(~F.coalesce(bad, F.lit(False))) if rows is None else rows
    spread = order_columns(kept) or ["page"]
    return (
        salted_lookup(kept, first_bad, keys, spread)
        .filter(F.col("_first_bad").isNull() | (F.col("page") < F.col("_first_bad")))
        .drop("_first_bad")
    )


def until_nothing_new(links: DataFrame, pages: DataFrame, keys: Sequence[str] = ("source", "feed")) -> DataFrame:
    """Links of each run up to the first page that adds no new URL.

    ``pages`` lists every page read; one without links adds nothing either. What a page adds depends
    on earlier pages only, so one pass over first occurrences answers all pages.
    """
    order = order_columns(links)
    page = [*keys, "page"]
    firsts = links.groupBy("source", "url").agg(F.min(F.struct(*order)).alias("_f"))
    adding = firsts.select("source", *[F.col(f"_f.{c}").alias(c) for c in order if c != "source"])
    adding = adding.select(*page).distinct()
    idle = pages.select(*page).distinct().join(adding, page, "left_anti")
    first_idle = idle.groupBy(*keys).agg(F.min("page").alias("_idle"))
    return (
        salted_lookup(links, first_idle, keys, order)
        .filter(F.col("_idle").isNull() | (F.col("page") < F.col("_idle")))
        .drop("_idle")
    )


def cap_links(links: DataFrame, n: int = 100) -> DataFrame:
    """At most ``n`` links per source in collection order; expects distinct links.

    Links are counted by page, and the counts added up within blocks of pages and over the blocks, so that each page knows
    the links before it. Links are then ranked inside their page only; pages at or beyond the cap are not ranked at all.
    """
    order = order_columns(links)
    inner = [c for c in order if c == "pos"]
    outer = [c for c in order if c != "pos"]
    keyed = links.withColumn("_page", F.struct("source", *outer))
    block = F.struct("source", *[F.floor(F.col(c) / PAGE_BLOCK).alias(c) if c == "page" else F.col(c) for c in outer])
    counts = keyed.groupBy("_page").agg(F.count(F.lit(1)).alias("_n")).select("_page", "_n", F.col("_page.*")).withColumn("_block", block)
    in_block = Window.partitionBy("_block").orderBy(*outer).rowsBetween(Window.unboundedPreceding, -1)
    over_blocks = Window.partitionBy("_block.source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_sum")).select(
        "_block", F.coalesce(F.sum("_sum").over(over_blocks), F.lit(0)).alias("_blocks_before")
    )
    pages = counts.withColumn("_pages_before", F.coalesce(F.sum("_n").over(in_block), F.lit(0))).join(blocks, "_block").select(
        "_page", (F.col("_blocks_before") + F.col("_pages_before")).alias("_before")
    )
    rank = F.row_number().over(Window.partitionBy("_page").orderBy(*(inner or ["_page"])))
    ranked = keyed.join(pages.filter(F.col("_before") < n), "_page").withColumn("_n", rank)
    return ranked.filter(F.col("_before") + F.col("_n") <= n).select(*links.columns)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Several link lists into one: later feeds only add URLs the earlier ones lack."""
    ranked = [feed.withColumn("feed", F.lit(rank)) for rank, feed in enumerate(feeds)]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return dedup_links(together)


def fill_to_target(first: DataFrame, second: DataFrame, target: int = 100) -> DataFrame:
    """The second feed contributes only while the first is below the target."""
    return cap_links(union_feeds(first, second), target)


def source_order(source: Column, first: str = "presseportal") -> Column:
    """Sortable key of the order sources run in: one first, the rest by script file name."""
    return F.struct((source != first).alias("later"), F.concat(source, F.lit(".php")).alias("file"))


def run_order(sources: DataFrame, first: str = "presseportal") -> DataFrame:
    """Distinct sources with their 1-based place in the run; one row per configured source."""
    names = sources.select("source").distinct()
    return names.withColumn("run_pos", F.row_number().over(Window.orderBy(source_order(F.col("source"), first))))
