"""Run monitoring: rejection funnel, failed runs, listing health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACCEPTED = "accepted"
TOTAL = "total"

# Fixed precedence of reject reasons.
REASONS = ("stored", "load_failed", "no_text", "bad_date", "too_old", "no_keyword", "not_illegal")


def first_reason(**tests: Column) -> Column:
    """Name of the first true test in the fixed precedence, null where none is."""
    unknown = set(tests) - set(REASONS)
    if unknown:
        raise ValueError(f"unknown reasons: {sorted(unknown)}")
    return F.coalesce(*[F.when(tests[r], F.lit(r)) for r in REASONS if r in tests])


def funnel(judged: DataFrame) -> DataFrame:
    """Rows per source and reason, accepted ones included, with a total per source and overall.

    Rows are counted once; the totals add up the small count table.
    """
    return _with_totals(judged.groupBy("source", F.coalesce("reason", F.lit(ACCEPTED)).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    ))


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.rollup("source", "reason").agg(F.sum("n").alias("n"), F.grouping_id().alias("_level"))
    return totals.select(
        F.when(F.col("_level") == 3, F.lit(TOTAL)).otherwise(F.col("source")).alias("source"),
        F.when(F.col("_level") >= 1, F.lit(TOTAL)).otherwise(F.col("reason")).alias("reason"),
        "n",
    )


def counted(sources: Sequence[str], reason: Column | None = None) -> list[Column]:
    """Aggregates that count rows per configured source and reason while they are written, for ``DataFrame.observe``.

    Put them right below the write, where each row passes once, also when tasks are repeated. ``reason`` is null for accepted
    rows. The number of aggregates is that of sources times reasons; rows of other sources are counted as one.
    """
    why = F.coalesce(F.col("reason") if reason is None else reason, F.lit(ACCEPTED))
    each = [
        F.count_if((F.col("source") == source) & (why == r)).alias(f"{i}:{r}")
        for i, source in enumerate(sources) for r in (*REASONS, ACCEPTED)
    ]
    known = F.coalesce(F.col("source").isin(*sources) & why.isin(*REASONS, ACCEPTED), F.lit(False))
    return [*each, F.count_if(~known).alias("other")]


def count_rows(sources: Sequence[str], observed: Mapping[str, int]) -> list[tuple[str, str, int]]:
    """``(source, reason, n)`` of what was observed; raises where rows had no configured source or known reason."""
    if observed["other"]:
        raise ValueError(f"{observed['other']} rows of no configured source or known reason")
    pairs = ((k.split(":", 1), n) for k, n in observed.items() if k != "other" and n)
    return [(sources[int(i)], reason, n) for (i, reason), n in pairs]


def observed_funnel(spark: SparkSession, counts: Sequence[tuple[str, str, int]]) -> DataFrame:
    """The funnel from counts taken while rows were written; nothing is read back."""
    table = spark.createDataFrame(list(counts), "source STRING, reason STRING, n BIGINT")
    return _with_totals(table.groupBy("source", "reason").agg(F.sum("n").alias("n")))


def failed_runs(run_log: DataFrame) -> DataFrame:
    """Alert rows of runs that ended with a code other than 0; subject and body are fixed texts."""
    failed = run_log.filter(F.col("exit_code") != 0)
    subject = F.format_string("Scraper-Fehler: %s (Exit %d)", "source", "exit_code")
    body = F.format_string(
        "Der Scraper '%s' hat sich mit Fehlercode %d beendet.\n\nAusgabe:\n%s", "source", "exit_code", F.coalesce("output", F.lit(""))
    )
    return failed.select("run_id", "source", "exit_code", subject.alias("subject"), body.alias("body"), "output")


def links_per_page(links: DataFrame) -> DataFrame:
    """Links per list page, and how many of them were new in their source."""
    page = [c for c in ("feed", "list", "page") if c in links.columns]
    winners = links.groupBy("source", "url").agg(F.min(F.struct(*page, "pos")).alias("_first"))
    fresh = winners.groupBy("source", *[F.col(f"_first.{c}").alias(c) for c in page]).agg(
        F.count(F.lit(1)).alias("n_new")
    )
    every = links.groupBy("source", *page).agg(F.count(F.lit(1)).alias("n_links"))
    return every.join(fresh, ["source", *page], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
