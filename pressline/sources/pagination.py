"""Page chains: follow next-page edges from the start pages, in order, up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressline.session import cut_lineage
from pressline.sources.html_jobs import next_links


def page_chain(edges: DataFrame, starts: DataFrame, limit: int = 40) -> DataFrame:
    """Pages reached from each start: ``start, pos, url`` with ``pos`` from 0 to ``limit - 1``.

    ``edges`` holds ``url, next_url`` (one successor per page; the smallest where several are
    given), ``starts`` holds ``start``. A page that names itself ends its chain; a longer cycle is
    cut only by the bound. Step tables double (1, 2, 4, … pages ahead), so a chain of ``limit`` pages
    takes log2(limit) rounds; pages reached and steps are written together, once per round.
    """
    step = (
        edges.filter(F.col("next_url").isNotNull() & (F.col("next_url") != F.col("url")))
        .groupBy("url").agg(F.min("next_url").alias("ahead"))
    )
    reached = starts.select("start", F.lit(0).alias("pos"), F.col("start").alias("url")).distinct()
    width = 1
    while width < limit:
        further = reached.join(step, "url").select("start", (F.col("pos") + width).alias("pos"), F.col("ahead").alias("url"))
        reached = reached.unionByName(further.filter(F.col("pos") < limit))
        width *= 2
        if width >= limit:
            break
        onward = step.select(F.col("url").alias("ahead"), F.col("ahead").alias("further"))
        step = step.join(onward, "ahead").select("url", F.col("further").alias("ahead"))
        both = cut_lineage(reached.withColumn("ahead", F.lit(None).cast("string")).unionByName(step, allowMissingColumns=True))
        reached, step = both.filter("start IS NOT NULL").drop("ahead"), both.filter("start IS NULL").select("url", "ahead")
    return reached


def number_pages(list_pages: DataFrame, starts: DataFrame, limit: int = 40, edge: str = "next_url") -> DataFrame:
    """Landed listing pages with ``page`` set to their place behind the start page; others are left out.

    ``edge`` is ``next_url`` or ``load_url`` (the "load more" address). A page that did not load has
    no successor, so its chain ends there.
    """
    edges = next_links(list_pages.select("url", "html")).select("url", F.col(edge).alias("next_url"))
    places = page_chain(edges, starts, limit).groupBy("url").agg(F.min("pos").alias("page"))
    return list_pages.drop("page").join(places, "url")
