"""What a run reads and stores: only needed pages, the right copy, no row twice."""

import datetime as dt
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pressline.operators import store
from pressline.plans import ingestion
from pressline.sources.html_nodes import Page
from pressline.sources.profiles import ANY_P, Box, default_profiles

DAY = dt.datetime(2025, 7, 1, 8)


def landed(spark, rows):
    return spark.createDataFrame(rows, "source STRING, url STRING, html STRING, fetched_at TIMESTAMP")


def test_only_wanted_pages_reach_the_reader(spark):
    pages = landed(spark, [("presseportal", f"u{i}", "<p>x</p>", DAY) for i in range(400)])
    links = spark.createDataFrame([("presseportal", "u7"), ("presseportal", "gone")], "source STRING, url STRING")
    assert [r["url"] for r in ingestion.wanted_copies(pages, links).collect()] == ["u7"]


def test_newest_copy_and_of_equals_one_that_loaded(spark):
    later = DAY + dt.timedelta(hours=1)
    pages = landed(spark, [
        ("presseportal", "a", "<p>old keyword</p>", DAY), ("presseportal", "a", "<p>new keyword</p>", later), ("presseportal", "a", None, later),
        ("presseportal", "b", "", None), ("presseportal", "b", "<p>keyword b</p>", None),
    ])
    links = pages.select("source", "url")
    read = ingestion.read_articles(default_profiles(), ingestion.wanted_copies(pages, links), ["keyword"])
    got = {r["url"]: (r["failed"], r["content_text"]) for r in read.collect()}
    assert got == {"a": (False, "new keyword\n"), "b": (False, "keyword b\n")}


def incidents(spark, urls):
    return store.incident_rows(spark.createDataFrame(
        [("t", "s", dt.date(2024 + i % 2, 1, 1), "l", 1.0, 2.0, u, "f", "x") for i, u in enumerate(urls)],
        "title STRING, summary STRING, date DATE, location STRING, lat DOUBLE, lon DOUBLE, url STRING, federal STRING, type STRING",
    ))


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "incidents")
    for urls in (["a", "b"], ["a", "b"], ["b", "c"]):
        store.append_incidents(incidents(spark, urls), path)
    assert sorted(r["url"] for r in store.read_incidents(spark, path).collect()) == ["a", "b", "c"]


def test_only_a_missing_table_is_empty(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "none")
    assert store.read_incidents(spark, path).count() == 0
    with pytest.raises(AnalysisException):
        store.read_incidents(spark, path, on_unknown="fail")
    monkeypatch.setattr(store, "is_missing", lambda error: False)  # any other analysis error
    with pytest.raises(AnalysisException):
        store.read_incidents(spark, path)


def test_nested_boxes_are_read_once():
    def seconds(n):
        start = time.process_time()
        page = Page("<div class='text'>" * n + "<p>x</p>" + "</div>" * n)
        assert len(page.paragraphs_in((Box("div", ("text",)),))) == 1
        assert len(page.paragraphs_in(ANY_P)) == 1
        return time.process_time() - start

    seconds(100)
    assert seconds(20_000) < 4


def test_inside_follows_the_tree():
    page = Page("<footer><div><p>a</p></div></footer><p>b</p>")
    flags = [page.inside(i, "footer") for i in page.nodes("p")]
    assert flags == [True, False]
