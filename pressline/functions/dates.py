"""Publication dates in the notations police press pages use.

``*_text`` helpers return the date as ``YYYY-MM-DD`` text without a calendar check, null where the
notation is absent. A ladder stops at the first notation found, so the check comes last
(:func:`checked_date`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400

# How a numeric German date may stand in its text.
GERMAN_DATE_MODES = {
    "exact": r"^(\d{2}\.\d{2}\.\d{4})$",
    "prefix": r"^(\d{2}\.\d{2}\.\d{4})",
    "anywhere": r"(?U)\b(\d{2}\.\d{2}\.\d{4})\b",
    "after_label": r"(?U)Artikel\s+vom\s+(\d{2}\.\d{2}\.\d{4})",
    "with_time": r"^(\d{2}\.\d{2}\.\d{4})\s+\d{2}:\d{2}",
}

# German month names, umlauts written out.
GERMAN_MONTHS = {
    "januar": 1, "februar": 2, "maerz": 3, "april": 4, "mai": 5, "juni": 6,
    "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "dezember": 12,
}

# Zone names of RFC 822.
RFC822_ZONES = {
    "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def _match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, null where there is none; the text is searched once."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(0))


def _reordered(german: Column) -> Column:
    return F.regexp_replace(german, r"^(\d{2})\.(\d{2})\.(\d{4})$", "$3-$2-$1")


def checked_date(text: Column) -> Column:
    """Date of an ISO text, null where the calendar has no such day."""
    return F.try_to_date(text, "yyyy-MM-dd")


def iso_date_text(c: Column) -> Column:
    return _match(c, r"^\d{4}-\d{2}-\d{2}")


def iso_date(c: Column) -> Column:
    return checked_date(iso_date_text(c))


def german_date_text(c: Column, mode: str = "prefix") -> Column:
    return _reordered(_match(c, GERMAN_DATE_MODES[mode], 1))


def german_date(c: Column, mode: str = "prefix") -> Column:
    return checked_date(german_date_text(c, mode))


def german_month_date_text(c: Column) -> Column:
    """``14. August 2025``, any letter case, umlauts plain or written out."""
    note = _match(F.lower(c), r"^\d{1,2}\.\s*[a-zäöü]+\s+\d{4}")
    for umlaut, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        note = F.replace(note, F.lit(umlaut), F.lit(plain))
    for name, number in GERMAN_MONTHS.items():
        note = F.replace(note, F.lit(name), F.lit(f"{number:02d}"))
    numeric = _match(F.regexp_replace(note, r"^(\d)\.", "0$1."), r"^\d{2}\.\s*\d{2}\s+\d{4}$")
    return F.regexp_replace(numeric, r"^(\d{2})\.\s*(\d{2})\s+(\d{4})$", "$3-$2-$1")


def german_month_date(c: Column) -> Column:
    return checked_date(german_month_date_text(c))


def any_german_date_text(c: Column) -> Column:
    """Numeric German, ISO or month-name date at the start of a text, in that order."""
    return F.coalesce(german_date_text(c, "prefix"), iso_date_text(c), german_month_date_text(c))


def utc_day(ts: Column) -> Column:
    """UTC calendar day of an instant, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / DAY_SECONDS).cast("int"))


def midnight(day: Column) -> Column:
    """The instant a day starts in UTC."""
    return F.timestamp_seconds(F.unix_date(day).cast("long") * DAY_SECONDS)


def rss_instant(c: Column) -> Column:
    """Instant of an RFC 822 date; the weekday in front is not checked."""
    pattern = r"^\s*(?:[A-Za-z]{3},\s*)?\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}(?::\d{2})?\s*(?:[+-]\d{4}|[A-Z]{1,3})?\s*$"
    note = F.regexp_replace(_match(c, pattern), r"^\s*(?:[A-Za-z]{3},\s*)?|\s+$", "")
    note = F.regexp_replace(note, r"\s+", " ")
    note = F.regexp_replace(note, r"( \d{2}:\d{2})(?!\d|:)", "$1:00")
    for offset in sorted(set(RFC822_ZONES.values())):
        names = "|".join(name for name, value in RFC822_ZONES.items() if value == offset)
        note = F.regexp_replace(note, rf"(?:{names})$", f" {offset}")
    note = F.regexp_replace(F.regexp_replace(note, r"(:\d{2}:\d{2})$", "$1 +0000"), r"\s*([+-]\d{4})$", " $1")
    return F.try_to_timestamp(note, F.lit("d MMM yyyy HH:mm:ss Z"))


def rss_date(c: Column) -> Column:
    return utc_day(rss_instant(c))


def _completed(note: Column) -> Column:
    """Instant of ``day T clock zone`` where seconds, a zone, or both may be missing (then UTC)."""
    note = F.regexp_replace(note, r"(T\d{2}:\d{2})(?!:|\d)", "$1:00")
    note = F.regexp_replace(note, r"(T\d{2}:\d{2}:\d{2})$", "$1Z")
    return F.try_to_timestamp(note)


def iso_ts(c: Column) -> Column:
    """Strict ISO instant: ``T`` form, seconds and zone optional, fraction only after seconds."""
    pattern = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+\-]\d{2}:\d{2})?$"
    return _completed(F.regexp_replace(_match(c, pattern), r"\.\d+", ""))


def loose_ts(c: Column) -> Column:
    """ISO instant with ``T`` or a blank, or a bare day (its UTC midnight); a missing zone is UTC."""
    pattern = r"^\s*\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+\-]\d{2}:?\d{2})?)?\s*$"
    note = F.regexp_replace(_match(c, pattern), r"^\s+|\s+$|\.\d+", "")
    note = F.regexp_replace(note, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    note = F.regexp_replace(F.regexp_replace(note, r"^(\d{4}-\d{2}-\d{2}) ", "$1T"), r"\s+", "")
    return _completed(F.regexp_replace(note, r"([+\-]\d{2})(\d{2})$", "$1:$2"))


def german_clock_ts(c: Column) -> Column:
    """Instant of ``dd.mm.yyyy hh:mm``, read as UTC."""
    note = _match(c, r"^\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}")
    return F.try_to_timestamp(
        F.regexp_replace(note, r"^(\d{2})\.(\d{2})\.(\d{4})\s+(\d{2}:\d{2})$", "$3-$2-$1T$4:00Z")
    )
