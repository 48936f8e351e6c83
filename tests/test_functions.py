import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressline.functions import dates, geo, text, urls

C = F.col


@pytest.mark.parametrize("raw, want", [
    ("52.5abc", 52.5), ("", None), ("abc", None), (" 52", 52.0), ("5e1", 50.0), ("-.25", -0.25), ("5.", 5.0),
    ("+3", 3.0), ("Infinity", float("inf")), (None, None), ("e5", None), ("\n\t7", 7.0),
])
def test_parse_float_prefix(value, raw, want):
    assert value(text.parse_float_prefix(C("a")), "a STRING", a=raw) == want


@pytest.mark.parametrize("number, want", [
    (52.0, "52"), (13.4, "13.4"), (0.0001, "0.0001"), (-0.0, "0"), (1e-7, "1e-7"), (1.5e-7, "1.5e-7"),
    (12345678.5, "12345678.5"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.25e22, "1.25e+22"),
    (-0.00012, "-0.00012"), (10000000.0, "10000000"), (8.499999999999998, "8.499999999999998"), (-7.5, "-7.5"),
])
def test_js_number_text(value, number, want):
    assert value(text.js_number_text(C("a")), "a DOUBLE", a=number) == want


def brute_hash(key):
    h = 0
    for ch in key:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


@pytest.mark.parametrize("key", ["52.5,13.4", "48,11.5", "0,0", "-7.25,1e-7", "53.123456,9.987654321"])
def test_key_hash(value, key):
    assert value(text.key_hash(F.lit(key))) == brute_hash(key)
    assert value(geo.base_angle(F.lit(key))) == brute_hash(key) % 360


def test_known_hash(value):
    assert value(text.key_hash(F.lit("52.5,13.4"))) == -629648656


@pytest.mark.parametrize("raw, want", [
    ("POL-MÜK: Kontrolle", "Kontrolle"), ("POL-ABCDEF: x", "POL-ABCDEF: x"), ("pol-HH: x", "pol-HH: x"), (" POL-E:x ", "x"),
])
def test_clean_title(value, raw, want):
    assert value(text.clean_title(F.lit(raw))) == want


def test_trim_and_falsy(value):
    assert value(text.trimmed(F.lit("\t\u000b x  \n"))) == "x  "
    for raw, want in [(None, True), ("", True), ("0", True), ("0.0", False), (" ", False)]:
        assert value(text.is_falsy(C("a")), "a STRING", a=raw) is want


def test_default_title_and_place(value):
    assert value(text.default_title(F.lit("0"), "(Ohne Titel)")) == "(Ohne Titel)"
    assert value(text.default_title(F.lit("0"), "Ohne Titel", zero_is_empty=False)) == "0"
    assert value(text.event_location(F.lit("ereignisort:  Pankow "))) == "Pankow"
    assert value(text.event_location(F.lit("Ereignisort: "))) is None


@pytest.mark.parametrize("href, want", [
    ("https://a.b/c", "https://a.b/c"), ("/x", "https://h/x"), ("x", "https://h/x"), ("//x", "https://h/x"),
    ("?q=1", "https://h?q=1"), ("#top", "https://h/#top"), ("", None), (None, None), ("HTTP://x", "HTTP://x"),
])
def test_absolutize(value, href, want):
    assert value(urls.absolutize(C("a"), "https://h"), "a STRING", a=href) == want


def test_absolutize_rules(value):
    assert value(urls.absolutize(F.lit("x"), "https://h", "append")) == "https://hx"
    assert value(urls.absolutize(F.lit("x"), "https://h", "slash")) == "https://h/x"
    assert value(urls.absolutize(F.lit("http://x"), "https://h", "prefix")) == "https://hhttp://x"


@pytest.mark.parametrize("raw, want", [
    ("14.08.2025", "2025-08-14"), ("14. August 2025", "2025-08-14"), ("3. März 2025", "2025-03-03"),
    ("3. Maerz 2025", "2025-03-03"), ("3.MÄRZ 2025", "2025-03-03"), ("2025-08-14 10:00", "2025-08-14"),
    ("am 14.08.2025", None), ("1. Maiglöckchen 2025", None), ("99.99.2025", "2025-99-99"), ("7. Foo 2025", None),
])
def test_any_german_date_text(value, raw, want):
    assert value(dates.any_german_date_text(F.lit(raw))) == want


def test_impossible_day_is_null(value):
    assert value(dates.iso_date(F.lit("2025-99-99"))) is None
    assert value(dates.german_date(F.lit("31.02.2025"))) is None
    assert value(dates.iso_date(F.lit("2025-02-28T10"))) == dt.date(2025, 2, 28)


@pytest.mark.parametrize("mode, raw, want", [
    ("exact", "14.08.2025", "2025-08-14"), ("exact", "14.08.2025,", None), ("prefix", "14.08.2025, x", "2025-08-14"),
    ("anywhere", "am 14.08.2025 um", "2025-08-14"), ("anywhere", "x14.08.2025", None), ("anywhere", "ä14.08.2025", None),
    ("after_label", "Artikel  vom 14.08.2025", "2025-08-14"), ("after_label", "vom 14.08.2025", None),
    ("with_time", "14.08.2025 15:44 Uhr", "2025-08-14"), ("with_time", "14.08.2025", None),
])
def test_german_date_modes(value, mode, raw, want):
    assert value(dates.german_date_text(F.lit(raw), mode)) == want


def seconds(*args):
    return int(dt.datetime(*args, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("raw, want", [
    ("2025-07-02T10:30:01", seconds(2025, 7, 2, 10, 30, 1)), ("2025-07-02T10:30Z", seconds(2025, 7, 2, 10, 30)),
    ("2025-07-02T10:30:01.123+02:00", seconds(2025, 7, 2, 8, 30, 1)), ("2025-07-02T10:30-05:00", seconds(2025, 7, 2, 15, 30)),
    ("2025-07-02 10:30:01", None), ("2025-07-02T10:30.5", None), ("2025-07-02", None), ("x", None), ("2025-99-99T10:30", None),
])
def test_iso_ts(value, raw, want):
    assert value(F.unix_seconds(dates.iso_ts(F.lit(raw)))) == want


@pytest.mark.parametrize("raw, want", [
    ("2025-07-02 10:30:01", seconds(2025, 7, 2, 10, 30, 1)), ("2025-07-02", seconds(2025, 7, 2)),
    (" 2025-07-02T10:30 +0200 ", seconds(2025, 7, 2, 8, 30)), ("2025-07-02T10:30:00.5Z", seconds(2025, 7, 2, 10, 30)),
    ("gestern", None), ("", None),
])
def test_loose_ts(value, raw, want):
    assert value(F.unix_seconds(dates.loose_ts(F.lit(raw)))) == want


@pytest.mark.parametrize("raw, want", [
    ("Wed, 02 Jul 2025 10:30:00 +0200", dt.date(2025, 7, 2)), ("2 Jul 2025 00:30 +0200", dt.date(2025, 7, 1)),
    ("Wed, 02 Jul 2025 23:30:00 EST", dt.date(2025, 7, 3)), ("02 Jul 2025 10:30:00 GMT", dt.date(2025, 7, 2)),
    ("Xxx, 02 Jul 2025 10:30:00Z", dt.date(2025, 7, 2)), ("02 Jul 2025 10:30:00", dt.date(2025, 7, 2)),
    ("heute", None), ("", None), ("45 Jul 2025 10:30:00 GMT", None),
])
def test_rss_date(value, raw, want):
    assert value(dates.rss_date(F.lit(raw))) == want


def test_german_clock(value):
    assert value(F.unix_seconds(dates.german_clock_ts(F.lit("14.08.2025 15:44 Uhr")))) == seconds(2025, 8, 14, 15, 44)
