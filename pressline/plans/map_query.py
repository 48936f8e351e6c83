"""The map query as one plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.operators import mapview as mv


def shown_incidents(
    incidents: DataFrame, selected: Sequence[str], start: dt.date | None, end: dt.date | Column
) -> DataFrame:
    """Approved rows of the selected states and dates with usable coordinates."""
    rows = mv.by_states(mv.approved_incidents(incidents), selected)
    return mv.in_range(mv.valid_coordinates(rows), start, end)


def map_markers(
    incidents: DataFrame, selected: Sequence[str], start: dt.date | None, end: dt.date | Column, as_of: Column
) -> DataFrame:
    """Markers in their shown positions: one shuffle of the shown rows, everything else is row-local."""
    shown = shown_incidents(incidents, selected, start, end)
    narrow = shown.select("title", "summary", "url", "date", "lat", "lon")
    return mv.marker_view(mv.spread_markers(mv.colocation_index(narrow)), as_of)


def map_count(
    incidents: DataFrame, selected: Sequence[str], start: dt.date | None, end: dt.date
) -> DataFrame:
    return mv.range_summary(shown_incidents(incidents, selected, start, end), start, end)


def run_instant(as_of: str | dt.datetime) -> Column:
    """The run instant as a column; nothing in this package reads the clock."""
    return F.lit(as_of).cast("timestamp")
