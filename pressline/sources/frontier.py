"""Crawl frontier: which list pages a run reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frontier(profiles: DataFrame) -> DataFrame:
    """One row per source, list and page with the URL to load.

    The first page has its own URL; the others fill ``{page}`` and ``{offset}`` of the template.
    """
    pages = profiles.withColumn(
        "page", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_pages") - 1))
    )
    offset = (F.col("page") * F.col("step")).cast("string")
    filled = F.replace(
        F.replace(F.col("template"), F.lit("{page}"), F.col("page").cast("string")), F.lit("{offset}"), offset
    )
    url = F.when(F.col("page") == F.col("first"), F.col("first_url")).otherwise(filled)
    keep = [c for c in ("source", "list", "directorate") if c in profiles.columns]
    return pages.select(*keep, "page", url.alias("url"))
