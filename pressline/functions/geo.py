"""Coordinates: keys of points and marker displacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.text import js_number_text, key_hash

# Displacement of markers that share a point.
RING_STEP_DEGREES = 45
RING_SIZE = 10
RING_RADIUS = 0.03


def point_key(lat: Column, lon: Column) -> Column:
    return F.concat(js_number_text(lat), F.lit(","), js_number_text(lon))


def base_angle(key: Column) -> Column:
    """Angle in whole degrees, 0 to 359, that depends on the point only."""
    return F.pmod(key_hash(key), F.lit(360))


def displaced(lat: Column, lon: Column, index: Column, base: Column) -> tuple[Column, Column]:
    """Shown position of the marker with this running index and base angle; index 0 stays."""
    place = (index - 1).cast("long")
    angle = F.radians(base + place * RING_STEP_DEGREES)
    radius = RING_RADIUS + RING_RADIUS * F.floor(place / RING_SIZE)
    moved = index > 0
    return (
        F.when(moved, lat + radius * F.cos(angle)).otherwise(lat),
        F.when(moved, lon + radius * F.sin(angle)).otherwise(lon),
    )
