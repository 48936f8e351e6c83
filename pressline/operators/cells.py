"""Grid cells that cover polygons: most points are answered by their cell, the others by the few edges in it.

A cell inside a polygon needs no edges. A cell that edges cross keeps these edges and whether its south-east corner is
inside: from a point in the cell one goes east to the cell's side and down to that corner, and every edge crossed on
the way lies in the cell. So a lookup tests the edges of one cell, however many a polygon has.

Grid lines are shifted off round coordinates, rows and columns by different amounts, so that corners of cells do not fall on
borders, which would leave the corner's answer to rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Side of a cell in degrees.
CELL = 0.1
# Edges count for cells this close to them, so rounding never takes an edge out of a cell it crosses.
SLACK = 1e-9

# Shift of the grid lines in degrees.
ROW_SHIFT, COL_SHIFT = 0.01372549019607, 0.00718281828459

EDGE = ("lon1", "lat1", "lon2", "lat2")


def row_of(lat: Column, size: float) -> Column:
    """Number of the row of cells; a point on a grid line belongs to the row north of it."""
    return F.floor((lat - ROW_SHIFT) / size)


def col_of(lon: Column, size: float) -> Column:
    """Number of the column of cells; a point on a grid line belongs to the column east of it."""
    return F.floor((lon - COL_SHIFT) / size)


def _south(row: Column, size: float) -> Column:
    return row * size + ROW_SHIFT


def _east(col: Column, size: float) -> Column:
    return (col + 1) * size + COL_SHIFT


def _lon_at(lat: Column) -> Column:
    """Where an edge that is not level reaches a latitude."""
    return (F.col("lon2") - F.col("lon1")) * (lat - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) + F.col("lon1")


def _rows_of(edges: DataFrame, size: float) -> DataFrame:
    """Edges once per row of cells they touch, with the longitudes they span there."""
    south, north = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    each = edges.withColumn("row", F.explode(F.sequence(row_of(south - SLACK, size), row_of(north + SLACK, size))))
    level = F.col("lat1") == F.col("lat2")
    low, high = F.greatest(south, _south(F.col("row"), size)), F.least(north, _south(F.col("row") + 1, size))
    a = F.when(level, F.col("lon1")).otherwise(_lon_at(low))
    b = F.when(level, F.col("lon2")).otherwise(_lon_at(high))
    return each.withColumns({"west": F.least(a, b) - SLACK, "east": F.greatest(a, b) + SLACK})


def _crossings(edges: Column, keep) -> Column:
    return F.size(F.filter(edges, keep))


def _reaches_east(e: Column, lat: Column, lon: Column) -> Column:
    """Whether a ray to the east from the point crosses the edge."""
    straddles = (e["lat1"] > lat) != (e["lat2"] > lat)
    return straddles & (lon < (e["lon2"] - e["lon1"]) * (lat - e["lat1"]) / (e["lat2"] - e["lat1"]) + e["lon1"])


def polygon_cells(edges: DataFrame, size: float = CELL) -> DataFrame:
    """``(row, col, name, corner_inside, edges)`` from ``edges(name, lon1, lat1, lon2, lat2)``: the cells a polygon touches.

    Cells without edges are inside. The number of rows depends on the polygons alone. Edges are joined on their row of
    cells only where its corners are judged.
    """
    by_row = _rows_of(edges, size)
    crossed = by_row.withColumn("col", F.explode(F.sequence(col_of(F.col("west"), size), col_of(F.col("east"), size))))
    border = crossed.groupBy("name", "row", "col").agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
    rows = by_row.groupBy("name", "row").agg(
        F.collect_list(F.struct(*EDGE)).alias("row_edges"), F.min("west").alias("west"), F.max("east").alias("east")
    )
    span = F.sequence(col_of(F.col("west"), size), col_of(F.col("east"), size))
    corners = rows.withColumn("col", F.explode(span)).select("name", "row", "col", (_crossings(
        F.col("row_edges"), lambda e: _reaches_east(e, _south(F.col("row"), size), _east(F.col("col"), size))
    ) % 2 == 1).alias("corner_inside"))
    cells = corners.join(border, ["name", "row", "col"], "left")
    none = F.array().cast(border.schema["edges"].dataType)
    return cells.filter(F.col("corner_inside") | F.col("edges").isNotNull()).select(
        "row", "col", "name", "corner_inside", F.coalesce("edges", none).alias("edges")
    )


def covered(edges: DataFrame, size: float = CELL) -> DataFrame:
    """``(row, col, parts)``: one row per cell, the polygons in it by name."""
    part = F.struct("name", "corner_inside", "edges")
    return polygon_cells(edges, size).groupBy("row", "col").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def holds(part: Column, lat: Column, lon: Column, row: Column, col: Column, size: float) -> Column:
    """Whether a polygon holds a point of the cell: the corner's answer, turned by every edge crossed on the way to it."""
    east, south = _east(col, size), _south(row, size)
    along = _crossings(part["edges"], lambda e: _reaches_east(e, lat, lon) & ~_reaches_east(e, lat, east))
    down = _crossings(part["edges"], lambda e: _reaches_north(e, south, east) & ~_reaches_north(e, lat, east))
    return part["corner_inside"] != ((along + down) % 2 == 1)


def _reaches_north(e: Column, lat: Column, lon: Column) -> Column:
    """Whether the edge crosses the meridian just east of the point, north of it, by the rule that judges the corners: an end on the
    meridian lies west of it."""
    straddles = (e["lon1"] > lon) != (e["lon2"] > lon)
    return straddles & (lat < (e["lat2"] - e["lat1"]) * (lon - e["lon1"]) / (e["lon2"] - e["lon1"]) + e["lat1"])
