"""The map query from SQL: table functions of the session over a view of the incidents.

    SELECT * FROM shown_incidents(array('Bayern', 'Berlin'), DATE '2025-01-01', DATE '2025-07-02')

The functions are plain SQL, so Spark puts their bodies into the plan of the caller: constant arguments become filters that
reach the scan, and columns nobody asks for are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pressline.operators import mapview as mv
from pressline.sources.schemas import INCIDENTS


def register(spark: SparkSession, view: str = "incidents") -> None:
    """Defines ``shown_incidents(states, first_day, last_day)`` and ``shown_count`` of the same arguments over a view or table.

    ``states`` may be empty: then only rows without a state are shown. A null ``first_day`` leaves the range open; a null date
    counts as 1970-01-01. Both days are included.
    """
    columns = ", ".join(part.split()[0] for part in INCIDENTS.split(", "))
    arguments = "states ARRAY<STRING>, first_day DATE, last_day DATE"
    epoch = "DATE '1970-01-01'"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION shown_incidents({arguments}) RETURNS TABLE ({INCIDENTS})
        RETURN SELECT {columns} FROM {view}
        WHERE approved AND (federal IS NULL OR federal = '' OR array_contains(shown_incidents.states, federal))
          AND lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)
          AND (date <= shown_incidents.last_day OR (date IS NULL AND {epoch} <= shown_incidents.last_day))
          AND (shown_incidents.first_day IS NULL OR date >= shown_incidents.first_day
               OR (date IS NULL AND {epoch} >= shown_incidents.first_day))""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION shown_count({arguments}) RETURNS TABLE (shown BIGINT, label STRING)
        RETURN SELECT shown, CASE WHEN shown_count.first_day IS NULL
            THEN shown || ' bis ' || day(shown_count.last_day) || '.' || month(shown_count.last_day) || '.' || year(shown_count.last_day)
            ELSE shown || ' in ' || (datediff(shown_count.last_day, shown_count.first_day) + 1) || ' Tagen' END
        FROM (SELECT count(*) AS shown FROM shown_incidents(shown_count.states, shown_count.first_day, shown_count.last_day))""")


def markers(shown: DataFrame, as_of: Column) -> DataFrame:
    """The markers of rows of ``shown_incidents``, in their shown positions."""
    narrow = shown.select("title", "summary", "url", "date", "lat", "lon")
    return mv.marker_view(mv.spread_markers(mv.colocation_index(narrow)), as_of)
