"""The map query: approved rows, filters, counts, marker positions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressline.functions.dates import DAY_SECONDS, utc_day
from pressline.functions.geo import base_angle, displaced, point_key
from pressline.functions.once import computed_once
from pressline.functions.text import parse_float_prefix
from pressline.operators.skew import running_index

# First day of the default range, and the rank of a marker dated at the run instant.
RANGE_START = dt.date(2025, 1, 1)
TOP_RANK = 10_000

# The sixteen federal states.
FEDERAL_STATES = (
    "Baden-Württemberg", "Bayern", "Berlin", "Brandenburg", "Bremen", "Hamburg", "Hessen",
    "Mecklenburg-Vorpommern", "Niedersachsen", "Nordrhein-Westfalen", "Rheinland-Pfalz", "Saarland",
    "Sachsen", "Sachsen-Anhalt", "Schleswig-Holstein", "Thüringen",
)

EPOCH = dt.date(1970, 1, 1)


def approved_incidents(incidents: DataFrame) -> DataFrame:
    """Rows that moderation approved; open and refused ones are out."""
    return incidents.filter(F.col("approved"))


def as_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))


def by_states(df: DataFrame, selected: Sequence[str], state: str = "federal") -> DataFrame:
    """Rows of the selected states; rows without a state always pass."""
    without = F.col(state).isNull() | (F.col(state) == "")
    return df.filter(without | F.col(state).isin(*selected)) if selected else df.filter(without)


def valid_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows whose coordinates are numbers; text is read by its numeric prefix and becomes numeric."""
    def number(name: str) -> Column:
        c = F.col(name)
        return parse_float_prefix(c) if isinstance(df.schema[name].dataType, T.StringType) else c.cast("double")

    numbers = {name: number(name) for name in (lat, lon)}
    typed = all(isinstance(df.schema[name].dataType, T.DoubleType) for name in (lat, lon))
    numeric = df if typed else computed_once(df, numbers)
    return numeric.filter(
        F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    )


def in_range(
    df: DataFrame, start: dt.date | None, end: dt.date | Column, date: str = "date"
) -> DataFrame:
    """Rows from ``start`` (open when null) to ``end``, both included.

    A null date counts as 1970-01-01; a text that is no date passes. ``end`` is a day, or the run
    instant when the field was cleared.
    """
    raw = F.col(date)
    upper = end if isinstance(end, Column) else F.lit(end)
    if isinstance(df.schema[date].dataType, T.StringType):
        instant = F.coalesce(F.try_to_timestamp(raw), F.when(raw.isNull(), F.lit(EPOCH).cast("timestamp")))
        inside = instant <= upper.cast("timestamp")
        if start is not None:
            inside = inside & (instant >= F.lit(start).cast("timestamp"))
        return df.filter(instant.isNull() | inside)
    # Plain comparisons on the column reach the scan; a null date is before every later start.
    if isinstance(end, Column):
        inside = raw <= utc_day(end)
        late = F.lit(EPOCH) <= utc_day(end)
    else:
        inside = raw <= upper
        late = F.lit(EPOCH <= end)
    if start is not None:
        inside = inside & (raw >= F.lit(start))
    null_passes = late if start is None or start <= EPOCH else F.lit(False)
    kept = df.filter(inside | (raw.isNull() & null_passes))
    if "year" in df.columns and start is not None and start > EPOCH:
        kept = kept.filter(F.col("year") >= start.year)  # prunes the folders of the stored table
        if not isinstance(end, Column):
            kept = kept.filter(F.col("year") <= end.year)
    return kept


def default_range(as_of: dt.date) -> tuple[dt.date, dt.date]:
    return RANGE_START, as_of


def range_summary(df: DataFrame, start: dt.date | None, end: dt.date) -> DataFrame:
    """Count of the shown rows and its label: ``N in D Tagen``, or ``N bis d.M.yyyy`` without a start."""
    counted = df.agg(F.count(F.lit(1)).alias("shown"))
    number = F.col("shown").cast("string")
    if start is None:
        label = F.concat(number, F.lit(f" bis {end.day}.{end.month}.{end.year}"))
    else:
        label = F.concat(number, F.lit(f" in {(end - start).days + 1} Tagen"))
    return counted.withColumn("label", label)


def colocation_index(df: DataFrame, name: str = "point_index") -> DataFrame:
    """0-based index of rows that share the exact point; filter first, then index.

    The reference counts in input order, which it leaves open. Here the order is: date, md5 of the
    URL, URL. It spreads a frequent point over many tasks and is the same on each run.
    """
    return running_index(df, ["lat", "lon"], [F.coalesce("date", F.lit(EPOCH))], F.col("url"), name)


def spread_markers(df: DataFrame, index: str = "point_index") -> DataFrame:
    """Adds ``base_angle, shown_lat, shown_lon``: later markers of a point move on rings around it."""
    lat, lon = F.col("lat"), F.col("lon")
    angled = computed_once(df, {"base_angle": base_angle(point_key(lat, lon))})
    shown_lat, shown_lon = displaced(lat, lon, F.col(index), F.col("base_angle"))
    return angled.withColumns({"shown_lat": shown_lat, "shown_lon": shown_lon})


def recency_rank(date: Column, as_of: Column) -> Column:
    """Newer markers rank higher, one step per full day of age."""
    age = F.unix_seconds(as_of) - F.unix_date(F.coalesce(date, F.lit(EPOCH))).cast("long") * DAY_SECONDS
    return (TOP_RANK - F.floor(age / DAY_SECONDS)).cast("long")


def state_selection(states: DataFrame, selected: Sequence[str], name: str = "name") -> DataFrame:
    chosen = F.col(name).isin(*selected) if selected else F.lit(False)
    return states.select(F.col(name), chosen.alias("selected"))


def toggle_all(selection: DataFrame) -> DataFrame:
    """All states selected: none are afterwards; otherwise all are."""
    every = selection.agg(F.every("selected")).scalar()
    return selection.select("name", (~every).alias("selected"))


def marker_view(shown: DataFrame, as_of: Column) -> DataFrame:
    """What a marker needs: texts, link, shown position, rank."""
    return shown.select(
        "title", "summary", "url", "shown_lat", "shown_lon", recency_rank(F.col("date"), as_of).alias("rank")
    )
