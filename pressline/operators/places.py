"""Places and coordinates: place names in text, gazetteer lookup, state of a point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.text import is_falsy, parse_float_prefix, truthy
from pressline.operators.cells import CELL, col_of, covered, holds, row_of
from pressline.operators.classify import coordinate_text

# What introduces a place name, what is no place, and which names are authorities.
PLACE_PATTERN = r"(?U)\b(?:in|bei|nahe)\s+(?!Richtung\b)(?!Höhe\b)([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ-]+)"
LOOSE_PLACE_PATTERN = r"(?U)\b(?:in|bei|nahe)\s+([A-ZÄÖÜ][a-zäöüßA-ZÄÖÜ-]+)"
AUTHORITY_PATTERN = r"(?i)Polizei|Kriminalpolizei|Staatsanwaltschaft|Feuerwehr"


def place_candidates(text: Column, strict: bool = True) -> Column:
    """Distinct place names in text order."""
    if not strict:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(LOOSE_PLACE_PATTERN), F.lit(1)))
    found = F.regexp_extract_all(text, F.lit(PLACE_PATTERN), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(AUTHORITY_PATTERN)))


def first_place(text: Column, strict: bool = True) -> Column:
    return F.get(place_candidates(text, strict), F.lit(0))


def location(answer_place: Column, fallbacks: Sequence[Column], null_only: bool = False) -> Column:
    """Place of the answer, else the first fallback; ``null_only`` keeps an empty place of the answer."""
    if null_only:
        return F.coalesce(answer_place, *fallbacks)
    *middle, last = [answer_place, *fallbacks]
    return F.coalesce(*[truthy(c) for c in middle], last)


def place_key(c: Column) -> Column:
    """Normalised name for the gazetteer lookup."""
    return F.lower(F.trim(c))


def top_places(gazetteer: DataFrame) -> DataFrame:
    """The best-ranked point per name."""
    return (
        gazetteer.withColumn("place_key", place_key(F.col("name")))
        .groupBy("place_key")
        .agg(F.min_by(F.struct("lat", "lon"), F.struct("rank", "lat", "lon")).alias("_p"))
        .select("place_key", F.col("_p.lat").alias("geo_lat"), F.col("_p.lon").alias("geo_lon"))
    )


def geocode(
    df: DataFrame, gazetteer: DataFrame, place: str = "location", spread_by: str = "url", wanted: Column | None = None
) -> DataFrame:
    """Adds ``geo_lat, geo_lon`` of the place, null where the gazetteer lacks it.

    Rows that are not ``wanted`` or have no place get a key of their own, so they spread evenly and
    match nothing. A gazetteer below Spark's own limit is broadcast; beyond it a frequent place is a
    skewed key of a sort-merge join, which Spark splits.
    """
    own = F.concat(F.lit("\u0000"), F.coalesce(F.col(spread_by).cast("string"), F.lit("")))
    key = place_key(F.col(place))
    if wanted is not None:
        key = F.when(wanted, key)
    keyed = df.withColumn("place_key", F.coalesce(key, own))
    return keyed.join(top_places(gazetteer), "place_key", "left").drop("place_key")


def lacks_coordinates(lat: Column, lon: Column) -> Column:
    """Either coordinate text counts as missing."""
    return is_falsy(coordinate_text(lat)) | is_falsy(coordinate_text(lon))


def complete_coordinates(
    df: DataFrame, gazetteer: DataFrame, lat: str = "lat_text", lon: str = "lon_text",
    place: str = "location", spread_by: str = "url",
) -> DataFrame:
    """Adds numeric ``lat, lon``: those of the answer, or both from the gazetteer where one is missing.

    A place the gazetteer lacks makes both null; without a place the answer stays as it is.
    """
    replace = lacks_coordinates(F.col(lat), F.col(lon)) & ~is_falsy(F.col(place))
    looked_up = geocode(df, gazetteer, place, spread_by, wanted=replace)
    return looked_up.withColumns({
        "lat": F.when(replace, F.col("geo_lat")).otherwise(parse_float_prefix(F.col(lat))),
        "lon": F.when(replace, F.col("geo_lon")).otherwise(parse_float_prefix(F.col(lon))),
    }).drop("geo_lat", "geo_lon")


def ring_edges(states: DataFrame) -> DataFrame:
    """One row per edge of every ring: ``name, lon1, lat1, lon2, lat2``; open rings are closed."""
    rings = states.select("name", F.explode("rings").alias("ring"))
    n = F.size("ring")
    edges = F.transform(
        "ring",
        lambda p, i: F.struct(
            p["lon"].alias("lon1"), p["lat"].alias("lat1"),
            F.element_at("ring", (i + 1) % n + 1)["lon"].alias("lon2"),
            F.element_at("ring", (i + 1) % n + 1)["lat"].alias("lat2"),
        ),
    )
    return rings.select("name", F.explode(edges).alias("e")).select("name", "e.*")


def state_of_point(
    df: DataFrame, states: DataFrame, lat: str = "lat", lon: str = "lon", name: str = "point_state", cell: float = CELL,
) -> DataFrame:
    """Adds the state whose polygon holds the point, null where none does.

    One equality lookup on the grid cell, one row out per row in. Points in a cell inside a state are answered by the cell;
    at a border the edges of that cell alone are tested. The cell table depends on the polygons alone: Spark broadcasts
    it where it is small, and then no point is shuffled; beyond that a frequent cell is a skewed key of a sort-merge join,
    which Spark splits. Points on an edge are undefined.
    """
    row, col, parts = "_row", "_col", "_parts"
    cells = covered(ring_edges(states), cell).select(
        F.col("row").alias(row), F.col("col").alias(col), F.col("parts").alias(parts)
    )
    placed = df.withColumns({row: row_of(F.col(lat), cell), col: col_of(F.col(lon), cell)})
    joined = placed.join(cells, [row, col], "left")
    hits = F.filter(parts, lambda p: holds(p, F.col(lat), F.col(lon), F.col(row), F.col(col), cell))
    return joined.withColumn(name, F.get(hits, F.lit(0))["name"]).drop(row, col, parts)


def federal_state(answer_state: Column, lat: Column, lon: Column, point_state: Column) -> Column:
    """State of the answer, else that of the point when both coordinates are there and not zero."""
    located = lat.isNotNull() & lon.isNotNull() & (lat != 0) & (lon != 0)
    return F.coalesce(truthy(answer_state), F.when(located, point_state))


def sidecar_location(answer_place: Column, text: Column, sidecar: Column | None, sidecar_first: bool,
                     strict: bool = True, null_only: bool = False) -> Column:
    """Location ladder of one source: the listed place before or after the place found in the text."""
    found = first_place(text, strict)
    steps = [found] if sidecar is None else [sidecar, found] if sidecar_first else [found, sidecar]
    return location(answer_place, steps, null_only)

