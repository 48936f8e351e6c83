"""Publication date of an article: ladder, run-date default, effective instant, age gates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.dates import (
    DAY_SECONDS, any_german_date_text, checked_date, german_clock_ts, german_date_text,
    iso_date_text, iso_ts, loose_ts, midnight, utc_day,
)
from pressline.functions.once import computed_once

RUNG = "struct<day:string,ts:timestamp>"


def _rung(day: Column, ts: Column | None = None) -> Column:
    stamp = ts if ts is not None else F.lit(None).cast("timestamp")
    return F.when(day.isNotNull(), F.struct(day.alias("day"), stamp.alias("ts")))


def _dcterms() -> Column:
    content = F.col("dcterms_date")
    clock = F.regexp_extract(content, r"^\d{4}-\d{2}-\d{2}[T\s](\d{2}:\d{2}(?::\d{2})?)", 1)
    stamp = loose_ts(F.concat(iso_date_text(content), F.lit(" "), clock))
    return _rung(iso_date_text(content), F.when(clock != "", stamp))


def _full_attribute() -> Column:
    pattern = r"^\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}(?::\d{2})?)?(?:Z|[+\-]\d{2}:\d{2})?$"
    attr = F.col("time_attr")
    return _rung(iso_date_text(F.when(attr.rlike(pattern), attr)), loose_ts(attr))


def _listed() -> Column:
    text = F.regexp_replace("list_date_text", r"\s+", " ")
    return _rung(german_date_text(text, "with_time"), german_clock_ts(text))


def _exact_day(name: str) -> Column:
    return iso_date_text(F.when(F.length(name) == 10, F.col(name)))


# Every way to find a date, by name: the day as text, and the instant if that way has one. The columns
# are those of the article extraction job and of the links.
DATE_RUNGS: dict[str, Callable[[], Column]] = {
    "dated_time": lambda: _rung(iso_date_text(F.col("dated_time_attr")), loose_ts(F.col("dated_time_attr"))),
    "time_strict": lambda: _rung(iso_date_text(F.col("time_attr")), iso_ts(F.col("time_attr"))),
    "time_loose": lambda: _rung(iso_date_text(F.col("time_attr")), loose_ts(F.col("time_attr"))),
    "time_full": _full_attribute,
    "time_day": lambda: _rung(iso_date_text(F.col("time_attr"))),
    "list_clock": _listed,
    "list_day": lambda: _rung(F.col("list_date").cast("string")),
    "dcterms": _dcterms,
    "after_label": lambda: _rung(F.col("labelled_date_text")),
    "class_time_attr": lambda: _rung(_exact_day("class_time_attr")),
    "class_time_text": lambda: _rung(german_date_text(F.col("class_time_text"), "exact")),
    "dtstart": lambda: _rung(german_date_text(F.col("dtstart_text"), "exact")),
    "meta": lambda: _rung(iso_date_text(F.col("meta_published")), loose_ts(F.col("meta_published"))),
    "time_text": lambda: _rung(any_german_date_text(F.col("time_text"))),
    "date_class": lambda: _rung(F.col("date_class_text")),
    "date_box": lambda: _rung(german_date_text(F.col("date_box_text"), "anywhere")),
    "anywhere": lambda: _rung(F.col("any_date_text")),
}


def with_publication(
    articles: DataFrame, ladders: Mapping[str, Sequence[str]], as_of: Column,
    rungs: Mapping[str, Callable[[], Column]] | None = None,
) -> DataFrame:
    """Adds ``pub_date``, ``pub_ts`` and ``bad_date`` by the ladder of each row's source.

    The first rung whose notation occurs decides; without any the run date is taken. A day the
    calendar does not have leaves both null and sets ``bad_date``.
    """
    rungs = DATE_RUNGS if rungs is None else rungs
    choice = F.lit(None).cast(RUNG)
    for source, ladder in ladders.items():
        choice = F.when(F.col("source") == source, F.coalesce(*[rungs[r]() for r in ladder])).otherwise(choice)
    found = computed_once(articles, {"_rung": choice})
    day = F.coalesce(checked_date(F.col("_rung.day")), F.when(F.col("_rung.day").isNull(), utc_day(as_of)))
    dated = found.withColumn("pub_date", day)
    stamp = F.when(F.col("pub_date").isNotNull(), F.col("_rung.ts"))
    return dated.withColumns({
        "pub_ts": effective_ts(stamp, F.col("pub_date")), "bad_date": F.col("pub_date").isNull(),
    }).drop("_rung")


def publication_date(*candidates: Column) -> Column:
    """First date text of a ladder as a date."""
    return checked_date(F.coalesce(*candidates))


def or_run_date(day: Column, as_of: Column) -> Column:
    return F.coalesce(day, utc_day(as_of))


def effective_ts(ts: Column, day: Column) -> Column:
    """The parsed instant, else the start of the day in UTC."""
    return F.coalesce(ts, midnight(day))


def is_fresh(ts: Column, as_of: Column, seconds: int = DAY_SECONDS) -> Column:
    """Not older than ``seconds`` at the run instant; later or unknown instants pass."""
    return ts.isNull() | (F.unix_seconds(as_of) - F.unix_seconds(ts) <= seconds)


def fresh_only(df: DataFrame, as_of: Column, ts: str = "pub_ts", seconds: int = DAY_SECONDS) -> DataFrame:
    return df.filter(is_fresh(F.col(ts), as_of, seconds))


def fresh_links(links: DataFrame, as_of: Column, day: str = "list_date", seconds: int = DAY_SECONDS) -> DataFrame:
    """Age gate on the listing date, ahead of loading the article."""
    return links.filter(is_fresh(midnight(F.col(day)), as_of, seconds))


def within_days(df: DataFrame, as_of: Column, day: str = "pub_date", days: int | None = None) -> DataFrame:
    """Optional cutoff in whole days, off unless ``days`` is given."""
    if days is None:
        return df
    return df.filter(F.col(day) >= F.date_sub(utc_day(as_of), days))
