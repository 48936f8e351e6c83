"""Landed pages: scan, load check, plain links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.functions.once import let
from pressline.operators.articles import SCRIPTS_AND_COMMENTS, plain_text
from pressline.sources.schemas import PAGES

QUOTED_HREF = r'''(?is)^[^>]*?\bhref\s*=\s*"([^"]*)"'''


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = PAGES) -> DataFrame:
    """Landing table of raw pages with a fixed schema (``parquet``, ``json`` or ``orc``)."""
    return spark.read.schema(schema).format(fmt).load(path)


def load_failed(html: Column) -> Column:
    """A page that did not load: no content, or content that counts as empty."""
    return html.isNull() | html.isin("", "0")


def split_loaded(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loaded pages, and the failed ones with their reason."""
    failed = load_failed(F.col("html"))
    return pages.filter(~failed), pages.filter(failed).drop("html").withColumn("reason", F.lit("load_failed"))


def _anchor(piece: Column) -> Column:
    """Link and text of a page piece that starts inside an ``a`` tag."""
    inner = F.regexp_replace(F.regexp_replace(piece, r"^[^>]*>", ""), r"(?is)</a\s*>.*$", "")
    href = F.get(F.regexp_extract_all(piece, F.lit(QUOTED_HREF), F.lit(1)), F.lit(0))
    return F.struct(href.alias("href"), plain_text(inner).alias("text"))


def extract_plain_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every anchor with a quoted link, in page order, without leaving the JVM.

    Adds ``pos`` (from 0), ``href`` and ``text``; the page text itself is dropped. The page is split at
    its anchors, so a new anchor closes an open one and each part of the page is read once.
    """
    pieces = F.split(F.regexp_replace(F.col(html), SCRIPTS_AND_COMMENTS, ""), r"(?i)<a(?=\s)")
    inside = let(pieces, lambda all_: F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0))))
    anchors = F.filter(F.transform(inside, _anchor), lambda a: a["href"].isNotNull())
    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(anchors).alias("pos", "_a")).select(
        *rest, "pos", F.col("_a.href").alias("href"), F.col("_a.text").alias("text")
    )
