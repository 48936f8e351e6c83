import datetime as dt

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from pressline.operators.dating import with_publication
from pressline.plans import ingestion as run
from pressline.plans.map_query import run_instant
from pressline.sources import schemas as s
from pressline.sources.html_jobs import article_facts, next_links
from pressline.sources.html_nodes import Page
from pressline.sources.profiles import Box, ListSpec, Profile, default_profiles


@pytest.fixture(scope="module")
def tables(spark):
    fetched = dt.datetime(2025, 7, 2, 11)
    bases = {p.base: p.source for p in default_profiles().values()}
    pages = [(next(s for base, s in bases.items() if url.startswith(base)), url, html, fetched) for url, html in fx.ARTICLES]
    pages.append(("presseportal", fx.ARTICLES[0][0], "<p>older copy</p>", dt.datetime(2025, 7, 1)))
    pages.append(("elsewhere", fx.ARTICLES[0][0], "<p>unknown source</p>", dt.datetime(2025, 7, 9)))
    return {
        "list_pages": spark.createDataFrame(fx.LIST_PAGES, s.LIST_PAGES),
        "feeds": spark.createDataFrame(fx.FEEDS, s.FEEDS),
        "payloads": spark.createDataFrame(fx.PAYLOADS, s.PAYLOADS),
        "pages": spark.createDataFrame(pages, s.PAGES),
        "answers": spark.createDataFrame(fx.ANSWERS, s.RESPONSES),
        "gazetteer": spark.createDataFrame(fx.GAZETTEER, s.GAZETTEER),
        "states": spark.createDataFrame(fx.STATES, s.STATES),
        "stored": spark.createDataFrame([(u,) for u in fx.STORED], "url STRING"),
    }


@pytest.fixture(scope="module")
def links(tables):
    return run.collect_links(default_profiles(), tables["list_pages"], tables["feeds"], tables["payloads"])


def test_links_of_all_sources(links):
    got = {r["url"]: r for r in links.collect()}
    assert set(got) == set(fx.ACCEPTED) | set(fx.REJECTED)
    assert got["https://www.presseportal.de/blaulicht/pm/1"]["title"] == "Eins"
    assert got["https://polizei.brandenburg.de/bb1"]["list_region"] == "Barnim"
    assert got["https://polizei.brandenburg.de/bb1"]["title"] == "BB 1"
    assert got["https://www.sachsen-anhalt.de/bs/1"]["title"] == "SA 1"
    assert got["https://www.polizei.bremen.de/news/2"]["list_date"] == dt.date(2025, 5, 1)
    assert got["https://www.berlin.de/polizei/b1"]["event_location"] == "Pankow"
    assert got["https://polizei.nrw/nrw1"]["list_date"] == dt.date(2025, 7, 2)
    assert got["https://polizei.nrw/nrw2"]["feed"] == 1
    assert got["https://www.shz.de/lokales/artikel/4"]["title"] == "SH 4"


def test_run(spark, tables, links, tmp_path):
    profiles = default_profiles()
    found_path, incidents = str(tmp_path / "found"), str(tmp_path / "incidents")
    run.candidates(profiles, links, tables["pages"], tables["stored"], fx.KEYWORDS, run_instant(fx.AS_OF)).write.parquet(found_path)
    found = spark.read.parquet(found_path)
    asked = {r["url"] for r in run.requests(found, "m").collect()}
    assert asked == {u for u, reason in fx.REJECTED.items() if reason == "not_illegal"} | set(fx.ACCEPTED)
    assert all(r["context"] for r in found.filter("reason is null and content_text ilike '%casino%'").collect())

    counts = run.run_ingestion(
        profiles, found, tables["answers"], tables["gazetteer"], tables["states"],
        incidents, str(tmp_path / "rejects"), str(tmp_path / "accepted"), "run-1")
    stored = {r["url"]: r for r in spark.read.parquet(incidents).collect()}
    fields = ("title", "summary", "date", "location", "lat", "lon", "federal", "type")
    assert {u: tuple(r[f] for f in fields) for u, r in stored.items()} == fx.ACCEPTED
    assert all(r["scraper"] and r["approved"] is None for r in stored.values())
    rejects = {r["url"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()}
    assert rejects == fx.REJECTED
    totals = {(r["source"], r["reason"]): r["n"] for r in counts.collect()}
    assert totals["total", "total"] == len(fx.ACCEPTED) + len(fx.REJECTED)
    assert totals["presseportal", "accepted"] == 1 and totals["schleswig-holstein", "stored"] == 1


def test_a_repeated_run_replaces_its_rows(spark, tables, links, tmp_path):
    """Repeated after half its write; a run beside it that stored one of the URLs first keeps it."""
    from pressline.operators import run_store

    profiles, incidents = default_profiles(), str(tmp_path / "incidents")
    found = run.candidates(profiles, links, tables["pages"], tables["stored"], fx.KEYWORDS, run_instant(fx.AS_OF)).cache()

    def repeat(name, answers):
        run.run_ingestion(profiles, found, answers, tables["gazetteer"], tables["states"], incidents, str(tmp_path / "r"), str(tmp_path / "a"), name)
        return {(r["run"], r["url"]) for r in run_store.read_runs(spark, incidents).collect()}

    one = next(iter(fx.ACCEPTED))
    assert repeat("b", tables["answers"].filter(F.col("url") == one)) == {("b", one)}
    half = [u for u in fx.ACCEPTED if u != one][:2]
    assert repeat("a", tables["answers"].filter(F.col("url").isin(*half))) == {("b", one)} | {("a", u) for u in half}
    for _ in range(2):
        assert repeat("a", tables["answers"]) == {("b", one)} | {("a", u) for u in fx.ACCEPTED if u != one}


def test_unreadable_store_by_source(spark, tables, links):
    found = run.candidates(default_profiles(), links, tables["pages"], None, fx.KEYWORDS, run_instant(fx.AS_OF))
    reasons = {(r["source"], r["reason"] == "stored") for r in found.select("source", "reason").distinct().collect()}
    assert ("bayern", True) in reasons and ("bayern", False) not in reasons
    assert not any(stored for source, stored in reasons if source != "bayern")


def berlin_page(n, following):
    start = "https://www.berlin.de/polizei/polizeimeldungen/"
    address = lambda k: start if k == 0 else f"{start}?page={k}"
    ahead = "" if following is None else f'<a rel="next" href="{address(following)}">x</a>'
    return ("berlin", 0, 0, 500 - n, address(n), f'<ul class="list--tablelist"><li><div class="text"><a href="/b{n}">B {n}</a></div></li></ul>{ahead}')


def berlin_links(spark, pages):
    berlin = {"berlin": default_profiles()["berlin"]}
    links = run.collect_links(berlin, spark.createDataFrame(pages, s.LIST_PAGES)).orderBy("page").collect()
    return [(r["page"], r["url"].rsplit("/", 1)[1]) for r in links]


def test_links_follow_the_next_pages(spark):
    """Pages off the chain and past its bound give no links; a page that did not load, or that names itself, ends it."""
    chain = [berlin_page(n, n + 1) for n in range(45)]
    assert berlin_links(spark, chain) == [(n, f"b{n}") for n in range(40)]
    assert berlin_links(spark, [berlin_page(0, 7), berlin_page(7, 3), berlin_page(3, 3), berlin_page(5, 6)]) == [(0, "b0"), (1, "b7"), (2, "b3")]
    failed = (*chain[1][:5], None)
    assert berlin_links(spark, [chain[0], failed, *chain[2:5]]) == [(0, "b0")]
    assert berlin_links(spark, chain[1:4]) == []


def test_second_run_stores_nothing(spark, tables, links):
    known = spark.createDataFrame([(u,) for u in fx.ACCEPTED], "url STRING")
    again = run.candidates(default_profiles(), links, tables["pages"], known, fx.KEYWORDS, run_instant(fx.AS_OF))
    assert {r["reason"] for r in again.filter(F.col("url").isin(*fx.ACCEPTED)).collect()} == {"stored"}


def test_page_texts_are_not_shuffled(tables, links):
    """Only what was read from a page crosses the network, and no text of pages without keyword."""
    facts = run.read_articles(default_profiles(), tables["pages"], fx.KEYWORDS)
    assert "html" not in facts.columns and "paragraphs" not in facts.columns
    kept = {r["url"]: r["content_text"] for r in facts.collect()}
    assert kept["https://www.presseportal.de/blaulicht/pm/3"] is None
    assert kept["https://www.presseportal.de/blaulicht/pm/1"].startswith("Hamburg (ots)\n")
    exchanges = [line for line in facts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert exchanges and not any("html" in line for line in exchanges)


def test_same_url_from_two_sources(spark, tables):
    found = spark.createDataFrame(
        [(source, "u", source, "casino", "", dt.date(2025, 7, 2), None, "casino", None, None, None, None) for source in ("nrw", "presseportal")],
        "source STRING, url STRING, title STRING, content_text STRING, summary STRING, pub_date DATE, pub_ts TIMESTAMP, keyword STRING, "
        "context STRING, event_location STRING, list_region STRING, reason STRING")
    answers = spark.createDataFrame([("u", fx.answer())], s.RESPONSES)
    accepted = run.accept(run.judge(default_profiles(), found, answers, tables["gazetteer"], tables["states"]))
    assert [r["title"] for r in accepted.collect()] == ["presseportal"]
    rejected = run.rejected(found, answers, accepted)
    assert [(r["source"], r["reason"]) for r in rejected.collect()] == [("nrw", "stored")]


def test_impossible_date_is_rejected(spark, tables):
    profile = Profile("p", "", (ListSpec(""),), ladder=((Box(),),), dates=("time_text",))
    links = spark.createDataFrame(
        [("p", 0, 0, 0, i, "t", f"u{i}", None, None, None, None) for i in range(3)],
        "source STRING, feed INT, list INT, page INT, pos INT, title STRING, url STRING, list_date_text STRING, list_date DATE, event_location STRING, list_region STRING")
    pages = spark.createDataFrame(
        [("p", "u0", "<time>31.02.2025</time><p>casino</p>", None), ("p", "u1", "<p>casino</p>", None), ("p", "u2", "<div>casino</div>", None)], s.PAGES)
    found = run.candidates({"p": profile}, links, pages, tables["stored"], ["casino"], run_instant(fx.AS_OF))
    assert {r["url"]: r["reason"] for r in found.collect()} == {"u0": "bad_date", "u1": None, "u2": "no_text"}


@pytest.mark.parametrize("source, columns, want", [
    ("presseportal", {"dated_time_attr": "2025-07-02 10:30:01"}, ("2025-07-02", "2025-07-02 10:30:01")),
    ("presseportal", {"time_attr": "2025-07-01"}, ("2025-07-03", "2025-07-03 00:00:00")),
    ("bayern", {"time_attr": "2025-07-02T10:30+02:00"}, ("2025-07-02", "2025-07-02 08:30:00")),
    ("bayern", {"time_attr": "2025-07-02 10:30"}, ("2025-07-02", "2025-07-02 00:00:00")),
    ("berlin", {"list_date_text": "02.07.2025  09:15 Uhr", "dcterms_date": "2025-01-01"}, ("2025-07-02", "2025-07-02 09:15:00")),
    ("berlin", {"list_date_text": "02.07.2025", "dcterms_date": "2025-06-30T08:00:05+02:00"}, ("2025-06-30", "2025-06-30 08:00:05")),
    ("berlin", {"time_attr": "2025-07-02T10:30:00+02:00"}, ("2025-07-02", "2025-07-02 08:30:00")),
    ("berlin", {"time_attr": "2025-07-02 abends"}, ("2025-07-03", "2025-07-03 00:00:00")),
    ("brandenburg", {"labelled_date_text": "2025-07-01"}, ("2025-07-01", "2025-07-01 00:00:00")),
    ("bremen", {"class_time_attr": "2025-07-01"}, ("2025-07-01", "2025-07-01 00:00:00")),
    ("bremen", {"class_time_attr": "2025-07-01T10:00", "class_time_text": "30.06.2025"}, ("2025-06-30", "2025-06-30 00:00:00")),
    ("mv", {"dtstart_text": "01.07.2025", "meta_published": "2025-06-01T10:00:00Z"}, ("2025-07-01", "2025-07-01 00:00:00")),
    ("mv", {"meta_published": "2025-06-01T10:00:00Z"}, ("2025-06-01", "2025-06-01 10:00:00")),
    ("nrw", {"time_attr": "2025-07-01 20:00:00", "list_date": dt.date(2025, 6, 1)}, ("2025-07-01", "2025-07-01 20:00:00")),
    ("nrw", {"list_date": dt.date(2025, 6, 1)}, ("2025-06-01", "2025-06-01 00:00:00")),
    ("sachsen", {"time_text": "Stand heute", "date_class_text": "2025-03-03"}, ("2025-03-03", "2025-03-03 00:00:00")),
    ("sachsen-anhalt", {"date_box_text": "am 01.07.2025, 15:35", "time_attr": "2025-07-02T10:00:00Z"}, ("2025-07-01", "2025-07-01 00:00:00")),
    ("sachsen-anhalt", {"time_attr": "2025-07-02T10:00:00Z"}, ("2025-07-02", "2025-07-02 10:00:00")),
    ("sachsen-anhalt", {"any_date_text": "2025-06-15"}, ("2025-06-15", "2025-06-15 00:00:00")),
    ("schleswig-holstein", {"time_attr": "2025-07-02T10:00:00Z"}, ("2025-07-02", "2025-07-02 00:00:00")),
])
def test_date_ladders(spark, source, columns, want):
    schema = {
        "time_attr": "STRING", "dated_time_attr": "STRING", "time_text": "STRING", "class_time_attr": "STRING", "class_time_text": "STRING",
        "dtstart_text": "STRING", "meta_published": "STRING", "dcterms_date": "STRING", "date_box_text": "STRING", "date_class_text": "STRING",
        "labelled_date_text": "STRING", "any_date_text": "STRING", "list_date_text": "STRING", "list_date": "DATE"}
    df = spark.createDataFrame(
        [(source, *[columns.get(c) for c in schema])], "source STRING, " + ", ".join(f"{c} {t}" for c, t in schema.items()))
    dated = with_publication(df, {p.source: p.dates for p in default_profiles().values()}, run_instant("2025-07-03 12:00:00"))
    row = dated.select(F.col("pub_date").cast("string"), F.col("pub_ts").cast("string")).collect()[0]
    assert tuple(row) == want


def paragraphs(html, rung):
    page = Page(html)
    return [page.text(i) for i in page.paragraphs_in(rung)]


def test_boxes():
    html = (
        '<div class="text a"><p>1<div class="text"><p>2</p></div></div><footer><p>3</p></footer><div id="content-x"><p>4</p></div>'
        '<main><div class="field body"><p>5</p></div></main><section><div class="w"><p>6</p></div><div class="w"><p>7</p></div></section>'
        '<section><div class="w"><p>8</p></div></section>')
    assert paragraphs(html, (Box(),)) == [str(i) for i in range(1, 9)]
    assert paragraphs(html, (Box("div", ("text",), first="page"),)) == ["1", "2"]
    assert paragraphs(html, (Box("div", ("none",), id_parts=("content",)),)) == ["4"]
    assert paragraphs(html, (Box("div", ("field",), ("body", "text"), inside="main"),)) == ["5"]
    assert paragraphs(html, (Box("div", ("w",), first="sibling"),)) == ["6", "8"]
    assert paragraphs(html, (Box("*", not_inside="footer"),)) == ["1", "2", "4", "5", "6", "7", "8"]


@pytest.mark.parametrize("html, want", [
    ("<p>a<p>b", ["a", "b"]), ("<p><b>a<br><p>b</b> c</p>", ["a", "b c"]), ("<script>'<p>x</p>'</script><p>a &uuml; &#8211;</p>", ["a ü –"]),
    ("<!-- <p>x</p> --><P CLASS='a>b'>c</P>", ["c"]), ("</p><p>a</div></p>", ["a"]), ("<p>x < y</p>", ["x < y"]), ("", []),
    ("<p>a<span>b</p>c</span><p>d", ["ab", "d"]), ('<p title="unclosed>a</p><p>b</p>', ["b"]),
])
def test_broken_markup(html, want):
    assert paragraphs(html, (Box(),)) == want


def test_scan_is_linear():
    import time

    start = time.time()
    Page('<p class="' * 20000)
    Page("<div>" * 20000)
    Page("<" * 200000)
    Page("<!-- " * 50000)
    Page("<script>" * 50000)
    Page("<p>" * 50000 + "</p>" * 50000)
    assert time.time() - start < 10


def test_anchor(spark):
    body = "".join(f"<p>{i}</p>" for i in range(70))
    df = spark.createDataFrame(
        [("b", "http://x/#m", f'<p>a</p><h2 id="m"><p>in</p></h2>{body}'), ("b", "http://x/2#m", '<p>a</p><a id="m"></a><div>no</div>'),
         ("b", "http://x/3#none", "<p>a</p>"), ("b", "http://x/4", '<a id="m"></a><p>a</p>')],
        "source STRING, url STRING, html STRING")
    profile = Profile("b", "", (ListSpec(""),), ladder=((Box(),),), anchored=True)
    got = {r["url"]: (r["rung"], len(r["paragraphs"])) for r in article_facts(df, {"b": profile}).collect()}
    assert got == {"http://x/#m": (0, 60), "http://x/2#m": (1, 1), "http://x/3#none": (1, 1), "http://x/4": (1, 1)}


def test_next_links(spark):
    df = spark.createDataFrame([
        ("https://h/1", '<a href="/9">WEITER lesen</a><a rel="next" href="/2">x</a>'), ("https://h/2", '<a href="3">Nächste</a>'),
        ("https://h/3", '<a rel="next" href="/3">x</a>'), ("https://h/4", None)], "url STRING, html STRING")
    got = {r["url"]: r["next_url"] for r in next_links(df).collect()}
    assert got == {"https://h/1": "https://h/2", "https://h/2": "https://h/3", "https://h/3": None, "https://h/4": None}


def test_target_source_skips_failed_feeds(spark):
    """A feed that did not load or a first one without items is passed over; a page that adds nothing ends it."""
    def rss(*urls):
        return "<rss><channel>" + "".join(f"<item><link>/{u}</link></item>" for u in urls) + "</channel></rss>"

    feeds = spark.createDataFrame(
        [("nrw", 0, 0, 0, rss()), ("nrw", 0, 0, 1, None), ("nrw", 0, 0, 2, rss("a")), ("nrw", 0, 0, 3, rss("a")), ("nrw", 0, 0, 4, rss("b"))], s.FEEDS)
    payloads = spark.createDataFrame([("nrw", 1, 0, 1, None), ("nrw", 1, 0, 2, '[{"command":"insert","data":"<h2 class=field-title><a href=c>c</a></h2>"}]')], s.PAYLOADS)
    nrw = {"nrw": default_profiles()["nrw"]}
    links = run.collect_links(nrw, spark.createDataFrame([], s.LIST_PAGES), feeds, payloads)
    assert [r["url"] for r in links.collect()] == ["https://polizei.nrw/a"]


def test_stream_equals_batch(spark, tables, links, tmp_path):
    from pressline.streaming.ingest import stream_candidates
    from pressline.streaming.intake import stream_pages

    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    pages = tables["pages"].filter("html not like '%older copy%'")
    pages.repartition(2, "url").write.parquet(landing)
    stored = links.filter("false").union(links)
    stream_candidates(
        stream_pages(spark, landing, files_per_batch=1), default_profiles(), lambda: stored, lambda: tables["stored"],
        fx.KEYWORDS, run_instant(fx.AS_OF), out, str(tmp_path / "checkpoint"),
    ).awaitTermination()
    columns = ("url", "title", "content_text", "summary", "pub_date", "keyword", "reason")
    got = spark.read.parquet(out)
    want = run.candidates(default_profiles(), links, pages, tables["stored"], fx.KEYWORDS, run_instant(fx.AS_OF))
    assert got.select("batch_id").distinct().count() == 2
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_date_elements_become_one_day_in_the_scan(spark):
    from pressline.sources.html_jobs import article_facts

    page = '<body class="update-page"><p class="x-datum">x</p><p class="datum">3. März 2025 10 Uhr</p><p>Artikel vom 05.06.2025</p></body>'
    pages = spark.createDataFrame([(s, "u", page) for s in ("sachsen", "brandenburg", "bayern")], "source STRING, url STRING, html STRING")
    facts = article_facts(pages, default_profiles())
    assert "date_texts" not in facts.columns
    got = {r["source"]: (r["date_class_text"], r["labelled_date_text"]) for r in facts.collect()}
    assert got == {"sachsen": ("2025-03-03", None), "brandenburg": (None, "2025-06-05"), "bayern": (None, None)}


def test_chunks_end_at_a_failed_one_and_at_the_number_of_loads(spark):
    """Load-more lists: five chunks at most, none from one that did not load; other sources keep all chunks."""
    source = next(s for s, p in default_profiles().items() if p.extra.get("loads"))
    profile = {source: default_profiles()[source]}

    def chunk(page, name):
        html = f'<div class="article__teaser"><a href="lokales/artikel/{name}">x</a></div>' if name else name
        return (source, 1, 0, page, html)

    def found(chunks):
        payloads = spark.createDataFrame(chunks, s.PAYLOADS)
        links = run.collect_links(profile, spark.createDataFrame([], s.LIST_PAGES), None, payloads).collect()
        return sorted(r["url"].rsplit("/", 1)[1] for r in links)

    assert found([chunk(i, f"c{i}") for i in range(1, 8)]) == ["c1", "c2", "c3", "c4", "c5"]
    assert found([chunk(1, "a"), chunk(2, ""), chunk(3, "b")]) == ["a"]
    assert found([chunk(1, None), chunk(2, "b")]) == []
