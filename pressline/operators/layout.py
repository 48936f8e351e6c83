"""Incidents laid out along a space-filling curve over day and point, so that map filters skip most of a table.

Files and their row groups hold rows of few days and a small area, and therefore of few states; their statistics let a scan
for some days and states pass over the others. Rows without a state pass every state filter, so they lie apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of the curve: each halves the days, the latitudes and the longitudes once.
LEVELS = 12
ROWS_PER_FILE = 1_000_000
GROUP_BYTES = 16 << 20


def interleaved(numbers: list[Column], levels: int = LEVELS) -> Column:
    """The place on the curve: the bits of the numbers in turn, the highest first; numbers are below 2 ** ``levels``."""
    key = F.lit(0).cast("long")
    for bit in range(levels):
        for k, number in enumerate(numbers):
            one = F.shiftright(number, bit).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(one, bit * len(numbers) + len(numbers) - 1 - k))
    return key


def _step(value: Column, low: float | None, high: float | None, levels: int) -> Column:
    """A value as one of 2 ** ``levels`` equal steps of its range; null and not a number are the first."""
    if low is None or high is None or low == high:
        return F.lit(0).cast("long")
    step = F.floor((value - low) / (high - low) * float((1 << levels) - 1))
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(step).cast("long")


def write_clustered(
    incidents: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, group_bytes: int = GROUP_BYTES, levels: int = LEVELS
) -> None:
    """Writes ``incidents(date, lat, lon, federal, url, ...)`` in files of about ``rows_per_file`` rows along the curve.

    The curve is laid over the range the rows have; one row with their number and bounds reaches the driver. Many rows of one
    day and point are divided by their URL, so that no file grows with them. Rows come from a table that reads the same twice.
    """
    day = F.unix_date("date").cast("double")
    usable = lambda c: F.when(~F.isnan(c), F.col(c))
    bounds = incidents.agg(
        F.count(F.lit(1)).alias("n"), F.min(day).alias("d0"), F.max(day).alias("d1"), F.min(usable("lat")).alias("y0"),
        F.max(usable("lat")).alias("y1"), F.min(usable("lon")).alias("x0"), F.max(usable("lon")).alias("x1"),
    ).first()
    place = interleaved([
        _step(day, bounds["d0"], bounds["d1"], levels), _step(F.col("lat"), bounds["y0"], bounds["y1"], levels),
        _step(F.col("lon"), bounds["x0"], bounds["x1"], levels),
    ], levels)
    stateless = F.coalesce(F.col("federal"), F.lit("")) == ""
    keys = ["_stateless", "_place", "_spread"]
    placed = incidents.withColumns(dict(zip(keys, (stateless, place, F.xxhash64("url")))))
    files = max(1, -(-bounds["n"] // rows_per_file))
    dealt = placed.repartitionByRange(files, *keys).sortWithinPartitions(*keys).drop(*keys)
    dealt.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)
