"""URL helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def absolutize(href: Column, base: str | Column, rule: str = "full") -> Column:
    """Absolute form of a link.

    ``full``    http(s) links stay, ``?q`` is appended as it is, ``#f`` after a slash, other paths
                after exactly one slash; an empty link is null
    ``slash``   links that start with ``http`` stay, a missing slash is added; an empty link is null
    ``append``  links that start with ``http`` stay, the rest is appended as it is
    ``prefix``  the base always comes first
    """
    base = _text(base)
    bare = F.regexp_replace(base, "/+$", "")
    if rule == "prefix":
        return F.concat(base, href)
    if rule == "append":
        return F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(base, href))
    if rule == "slash":
        return (
            F.when(F.startswith(href, F.lit("http")), href)
            .when(F.startswith(href, F.lit("/")), F.concat(bare, href))
            .when(href != "", F.concat(bare, F.lit("/"), href))
        )
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(F.startswith(href, F.lit("?")), F.concat(base, href))
        .when(F.startswith(href, F.lit("#")), F.concat(base, F.lit("/"), href))
        .when(href != "", F.concat(bare, F.lit("/"), F.regexp_replace(href, "^/+", "")))
    )


def url_host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def url_path(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PATH"))


def url_fragment(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("REF"))
