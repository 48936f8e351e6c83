"""Incidents by run: every run owns its partitions of the table and replaces them when it is repeated.

Rows lie below ``run=<name>/year=<year>``. A run that is repeated, also after half a write, overwrites the years it writes and
empties those that only an earlier attempt had; other runs write elsewhere, at the same time too. Nothing is joined with the
whole table: what a run's links were checked against is known by the names of the runs stored then, so at the end only the
partitions of runs that came in between are read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressline.operators.store import is_missing, not_yet_stored
from pressline.session import cut_lineage
from pressline.sources.schemas import INCIDENTS

RUN_INCIDENTS = INCIDENTS + ", run STRING, year INT"

# Folder of rows without a date; the name Spark gives to the null partition.
NO_YEAR = "__HIVE_DEFAULT_PARTITION__"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with ``run`` and ``year``; a table that is not there yet is empty."""
    try:
        return spark.read.schema(RUN_INCIDENTS).parquet(path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], RUN_INCIDENTS)


def stored_runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that are stored; only partition values are read."""
    return sorted(r["run"] for r in read_runs(spark, path).select("run").distinct().collect())


def came_since(spark: SparkSession, path: str, run: str, seen: Iterable[str]) -> DataFrame:
    """Rows of runs other than this one and those it has seen: whole partitions, the others are not read."""
    known = [run, *seen]
    return read_runs(spark, path).filter(~F.col("run").isin(*known))


def write_run(rows: DataFrame, path: str, run: str, seen: Iterable[str] = ()) -> None:
    """Stores the rows of one run.

    ``seen`` are the runs that were stored when the links of this run were checked. URLs that others stored since are left out.
    Years are written as many files as their size asks for, by Spark's own rebalancing.
    """
    spark = rows.sparkSession
    own = StructType.fromDDL(INCIDENTS)
    marked = rows.withColumn("approved", F.lit(None).cast("boolean")).select(*own.fieldNames())
    new = cut_lineage(not_yet_stored(marked, came_since(spark, path, run, seen)).select(*own.fieldNames()).withColumns(
        {"run": F.lit(run), "year": F.year("date")}
    ))
    before = _years(read_runs(spark, path).filter(F.col("run") == run))
    now = _years(new)
    (
        new.hint("rebalance", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "year").parquet(path)
    )
    for year in before - now:
        folder = NO_YEAR if year is None else year
        spark.createDataFrame([], own).write.mode("overwrite").parquet(f"{path}/run={run}/year={folder}")


def _years(rows: DataFrame) -> set[int | None]:
    """Distinct years: a handful of numbers."""
    return {r["year"] for r in rows.select("year").distinct().collect()}


def first_of_runs(incidents: DataFrame) -> DataFrame:
    """One row per URL, that of the first run by name: for readers, where runs at the same time stored one URL each."""
    rest = [c for c in incidents.columns if c not in ("url", "run")]
    first = incidents.groupBy("url").agg(F.min_by(F.struct("run", *rest), "run").alias("_first"))
    return first.select(*[F.col("url") if c == "url" else F.col(f"_first.{c}").alias(c) for c in incidents.columns])
