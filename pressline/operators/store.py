"""The incident table: known-URL joins, cross-source deduplication, append."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.operators.links import source_order
from pressline.sources.schemas import INCIDENT_COLUMNS, INCIDENTS


# Files a run adds to a year at most.
YEAR_FILES = 16


def is_missing(error: AnalysisException) -> bool:
    """A table that is not there; any other error of a read is a fault, not an empty table."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_incidents(spark: SparkSession, path: str, on_unknown: str = "new") -> DataFrame:
    """The stored incidents.

    ``on_unknown="new"``: a table that is not there yet is empty, so every URL counts as new.
    ``on_unknown="fail"`` raises instead.
    """
    try:
        return spark.read.schema(INCIDENTS).parquet(path)
    except AnalysisException as error:
        if on_unknown != "new" or not is_missing(error):
            raise
        return spark.createDataFrame([], INCIDENTS)


def known_urls(incidents: DataFrame) -> DataFrame:
    """Distinct URLs; copies collapse before the shuffle."""
    return incidents.select("url").filter(F.col("url").isNotNull()).distinct()


def not_yet_stored(links: DataFrame, incidents: DataFrame, on: str = "url") -> DataFrame:
    """Links whose URL is not stored, for the load step that follows."""
    return links.join(incidents.select(on).filter(F.col(on).isNotNull()).distinct(), on, "left_anti")


def new_links(links: DataFrame, path: str, on_unknown: str = "new") -> DataFrame:
    """Links that a table at ``path`` does not hold.

    ``on_unknown`` says what an unreadable table means: all links are ``new`` (the rule of most
    sources), all ``exist``, or ``fail``.
    """
    if on_unknown != "exist":
        return not_yet_stored(links, read_incidents(links.sparkSession, path, on_unknown))
    try:
        return not_yet_stored(links, read_incidents(links.sparkSession, path, "fail"))
    except AnalysisException:
        return links.filter(F.lit(False))


def already_stored(links: DataFrame, incidents: DataFrame, on: str = "url") -> DataFrame:
    """Bulk form of the existence probe."""
    return links.join(incidents.select(on).filter(F.col(on).isNotNull()).distinct(), on, "left_semi")


def flag_stored(links: DataFrame, incidents: DataFrame | None, unknown: Column | None = None) -> DataFrame:
    """All links with ``stored``; one join serves both the run and its reject table.

    Without ``incidents`` (the store could not be read) the column ``unknown`` decides; by default every link is new.
    """
    if incidents is None:
        return links.withColumn("stored", F.lit(False) if unknown is None else unknown)
    known = known_urls(incidents).withColumn("stored", F.lit(True))
    return links.join(known, "url", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def url_exists(incidents: DataFrame, url: str) -> DataFrame:
    """Existence probe of one URL: one row or none."""
    return incidents.filter(F.col("url") == url).select("url").limit(1)


def dedup_accepted(rows: DataFrame, first: str = "presseportal") -> DataFrame:
    """One accepted row per URL: that of the source that runs first. Rejected rows do not block."""
    rest = [c for c in rows.columns if c != "url"]
    picked = rows.groupBy("url").agg(
        F.min_by(F.struct(*rest), source_order(F.col("source"), first)).alias("_first")
    )
    return picked.select(*[F.col("url") if c == "url" else F.col(f"_first.{c}").alias(c) for c in rows.columns])


def incident_rows(accepted: DataFrame) -> DataFrame:
    """The ten columns a run writes; moderation adds its mark elsewhere."""
    return accepted.withColumn("scraper", F.lit(True)).select(*INCIDENT_COLUMNS)


def append_incidents(rows: DataFrame, path: str) -> None:
    """Appends with the fixed schema, one folder per year so that date ranges prune.

    URLs the table holds by now are left out, so a run that is repeated after its write adds nothing. Rows are spread by
    year and a hash of the URL: a year has some files per run, not one per task, and no task holds a whole year.
    """
    new = not_yet_stored(rows, read_incidents(rows.sparkSession, path))
    marked = new.withColumn("approved", F.lit(None).cast("boolean")).withColumn("year", F.year("date"))
    spread = marked.repartition("year", F.pmod(F.xxhash64("url"), F.lit(YEAR_FILES)))
    spread.write.mode("append").partitionBy("year").parquet(path)
