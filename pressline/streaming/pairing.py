"""Links meet their pages as both arrive: an interval join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOAD_FAILED = "load_failed"


def meet_pages(
    links: DataFrame, pages: DataFrame, within: str, delay: str, listed: str = "listed_at", fetched: str = "fetched_at"
) -> DataFrame:
    """Each link with the pages of its source and URL that were fetched ``within`` that time after it was listed.

    ``links(source, url, listed_at, ...)``, ``pages(source, url, fetched_at, failed, ...)``, streams or tables; column names other than
    ``source`` and ``url`` differ. A link none of whose pages loaded in time comes out once with reason ``load_failed`` and
    no page, as soon as the watermark (``delay`` behind the newest instant of the slower side) says that none can come any more;
    over tables at once. Rows later than the watermark are dropped by streams. State holds a link for ``within`` and a
    page until links that could meet it have passed, so pages should be what was read from them, not their html. Links
    without instant meet nothing and are left out.
    """
    left = links.filter(F.col(listed).isNotNull()).withWatermark(listed, delay)
    loaded = pages.filter(~F.col("failed") & F.col(fetched).isNotNull()).drop("failed").withWatermark(fetched, delay)
    right = loaded.withColumnsRenamed({"source": "_source", "url": "_url"})
    same = (F.col("source") == F.col("_source")) & (F.col("url") == F.col("_url"))
    in_time = (F.col(fetched) >= F.col(listed)) & (F.col(fetched) <= F.col(listed) + F.expr(f"INTERVAL {within}"))
    reason = F.when(F.col("_url").isNull(), F.lit(LOAD_FAILED)).alias("reason")
    return left.join(right, same & in_time, "leftOuter").select("*", reason).drop("_source", "_url")
