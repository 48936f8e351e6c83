import random

import pytest
from pyspark.sql import functions as F

from pressline.operators import links as lk
from pressline.operators.monitoring import links_per_page
from pressline.operators.skew import running_index, salted_lookup
from pressline.sources import feeds as fd
from pressline.sources.pages import extract_plain_links
from pressline.sources.frontier import frontier
from pressline.sources.pagination import number_pages, page_chain
from pressline.sources.profiles import default_profiles, profile_table

SCHEMA = "source STRING, list INT, page INT, pos INT, title STRING, url STRING, list_region STRING"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture()
def links(spark):
    return spark.createDataFrame([
        ("a", 0, 0, 0, "first", "u1", "R1"),
        ("a", 0, 0, 1, "second", "u2", None),
        ("a", 0, 1, 0, "again", "u1", "R2"),
        ("a", 0, 2, 0, "last", "u1", None),
        ("a", 1, 0, 0, "third", "u3", "R3"),
        ("b", 0, 0, 0, "other", "u1", None),
    ], SCHEMA)


def test_first_wins(links):
    assert rows(lk.dedup_links(links), "source", "url", "title") == [
        ("a", "u1", "first"), ("a", "u2", "second"), ("a", "u3", "third"), ("b", "u1", "other")]


def test_region_last_wins(links):
    got = rows(lk.dedup_links_with_region(links).fillna("-"), "source", "url", "title", "list_region")
    assert got == [("a", "u1", "first", "R2"), ("a", "u2", "second", "-"), ("a", "u3", "third", "R3"), ("b", "u1", "other", "-")]


def test_until_first_bad(spark):
    pages = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, None), ("a", 3, "x"), ("b", 1, "x"), ("b", 2, "x"), ("c", 1, None), ("c", 2, "x")],
        "source STRING, page INT, html STRING")
    bad = F.col("html").isNull()
    assert rows(lk.until_first_bad(pages, bad), "source", "page") == [("a", 1), ("b", 1), ("b", 2)]
    assert rows(lk.until_first_bad(pages, bad, keep_first_page=1), "source", "page") == [("a", 1), ("b", 1), ("b", 2), ("c", 2)]


def test_until_nothing_new(spark):
    links = spark.createDataFrame(
        [("n", 0, 0, 0, "u1"), ("n", 0, 1, 0, "u1"), ("n", 0, 2, 0, "u2"), ("n", 1, 0, 0, "u3"), ("n", 1, 1, 0, "u4")],
        "source STRING, feed INT, page INT, pos INT, url STRING")
    pages = links.select("source", "feed", "page").unionByName(
        spark.createDataFrame([("n", 1, 2)], "source STRING, feed INT, page INT"))
    assert rows(lk.until_nothing_new(links, pages), "feed", "page", "url") == [(0, 0, "u1"), (1, 0, "u3"), (1, 1, "u4")]


def brute_cap(items, n):
    kept, counts = [], {}
    for item in sorted(items, key=lambda r: (r[1], r[2], r[3])):
        counts[item[0]] = counts.get(item[0], 0) + 1
        if counts[item[0]] <= n:
            kept.append(item)
    return sorted(kept)


@pytest.mark.parametrize("n", [1, 7, 1001, 1500])
def test_cap_matches_brute_force(spark, n):
    rng = random.Random(1)
    items = [("hot" if rng.random() < 0.9 else f"s{rng.randrange(5)}", 0, i // 40, i % 40) for i in range(2500)]
    df = spark.createDataFrame([(*t, f"u{i}") for i, t in enumerate(items)], "source STRING, list INT, page INT, pos INT, url STRING")
    assert rows(lk.cap_links(df, n), "source", "list", "page", "pos") == brute_cap(items, n)


def test_union_and_fill(links):
    first, second = links.filter("list = 0"), links.filter("source = 'a'")
    assert rows(lk.union_feeds(first, second), "source", "url", "feed") == [("a", "u1", 0), ("a", "u2", 0), ("a", "u3", 1), ("b", "u1", 0)]
    assert rows(lk.fill_to_target(first, second, 2), "source", "url") == [("a", "u1"), ("a", "u2"), ("b", "u1")]


def test_run_order_by_file_name(spark):
    sources = spark.createDataFrame([(s,) for s in ("sachsen", "bayern", "sachsen-anhalt", "presseportal")], "source STRING")
    got = {r["source"]: r["run_pos"] for r in lk.run_order(sources).collect()}
    assert got == {"presseportal": 1, "bayern": 2, "sachsen-anhalt": 3, "sachsen": 4}


def test_link_filter(spark):
    df = spark.createDataFrame([("https://h/medien/a-1?x",), ("https://h/medien/",), ("https://h/medien/?search[x]",), ("https://h/x",)], "url STRING")
    kept = lk.link_filter(df, include=("/medien/",), exclude=("search[",), path_pattern="/medien/[^/?]+")
    assert rows(kept, "url") == [("https://h/medien/a-1?x",)]


def test_links_per_page(links):
    got = rows(links_per_page(links), "source", "list", "page", "n_links", "n_new")
    assert got == [("a", 0, 0, 2, 2), ("a", 0, 1, 1, 0), ("a", 0, 2, 1, 0), ("a", 1, 0, 1, 1), ("b", 0, 0, 1, 1)]


def test_running_index_matches_brute_force(spark):
    """One key holds most rows, on one date: the index is still dense and follows the order."""
    import hashlib

    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(30)}", rng.choice([1, 1, 1, 2, 3]), f"url-{i}") for i in range(3000)]
    df = spark.createDataFrame(data, "k STRING, day INT, url STRING").repartition(7)
    got = {r["url"]: r["i"] for r in running_index(df, ["k"], [F.col("day")], F.col("url"), "i").collect()}
    want, counts = {}, {}
    for key, _, url in sorted(data, key=lambda t: (t[0], t[1], hashlib.md5(t[2].encode()).hexdigest(), t[2])):
        want[url] = counts.get(key, 0)
        counts[key] = want[url] + 1
    assert got == want


def test_salted_lookup_keeps_every_row(spark):
    left = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.when(F.col("id") % 2 == 0, F.lit("cold"))).alias("k"))
    lookup = spark.createDataFrame([("hot", 1), ("x", 2)], "k STRING, v INT")
    got = salted_lookup(left, lookup, "k", ["id"])
    assert got.count() == 1000
    assert got.filter("v = 1").count() == left.filter("k = 'hot'").count()
    assert got.filter("v is not null").count() == got.filter("k = 'hot'").count()


def brute_chain(edges, start, limit):
    out, at = [], start
    for pos in range(limit):
        out.append((start, pos, at))
        nxt = edges.get(at)
        if nxt is None or nxt == at:
            break
        at = nxt
    return out


@pytest.mark.parametrize("limit", [1, 2, 5, 40])
def test_page_chain(spark, limit):
    edges = {f"p{i}": f"p{i + 1}" for i in range(60)} | {"p60": "p60", "c1": "c2", "c2": "c3", "c3": "c1", "z": None, "y": "p30"}
    starts = ["p0", "p58", "c1", "z", "y", "none"]
    got = page_chain(
        spark.createDataFrame(list(edges.items()), "url STRING, next_url STRING"),
        spark.createDataFrame([(s,) for s in starts], "start STRING"), limit)
    assert rows(got, "start", "pos", "url") == sorted(r for s in starts for r in brute_chain(edges, s, limit))


def test_frontier_of_the_default_profiles(spark):
    urls = {(r["source"], r["list"], r["page"]): r["url"] for r in frontier(profile_table(spark)).collect()}
    assert urls["presseportal", 1, 0] == "https://www.presseportal.de/blaulicht"
    assert urls["presseportal", 1, 19] == "https://www.presseportal.de/blaulicht/570"
    assert urls["bayern", 0, 1].endswith("/index.html") and urls["bayern", 0, 20].endswith("/index.html?page=20")
    assert urls["mv", 0, 3].endswith("/?pager.page.nr=3&pager.items.offset=30")
    assert urls["sachsen", 4, 2].endswith("[]=10999&page=2")
    assert urls["brandenburg", 0, 10].endswith("/null/10/1?reset=1")
    per_source = {}
    for source, _, _ in urls:
        per_source[source] = per_source.get(source, 0) + 1
    assert per_source == {
        "presseportal": 40, "bayern": 20, "berlin": 1, "brandenburg": 10, "bremen": 1, "mv": 20, "nrw": 2,
        "sachsen": 10, "sachsen-anhalt": 15, "schleswig-holstein": 1}
    assert len(default_profiles()) == 10


def test_rss(spark):
    good = '<rss version="2.0" xmlns:dc="urn:x"><channel><item><title> A &amp; B</title><link> /x </link><dc:creator>z</dc:creator></item><item><link/></item></channel></rss>'
    rdf = "<rdf><channel><title>t</title></channel><item><link>l</link></item></rdf>"
    df = spark.createDataFrame([(1, good), (2, "<rss><channel><item><link>x</link></item>"), (3, "nope"), (4, rdf), (5, None)], "id INT, xml STRING")
    assert rows(fd.rss_items(df), "id", "pos", "title", "link") == [(1, 0, "A & B", "/x"), (4, 0, "", "l")]


def test_embedded_json(spark):
    html = 'x <script>window.montagedata = [{"href":"/a","title":" T "},{"href":"","title":"x"},{"href":"0","title":"x"},{"title":"x"}];</script>'
    df = spark.createDataFrame([(1, html), (2, "window.montagedata = [broken];"), (3, "none")], "id INT, html STRING")
    assert rows(fd.embedded_json_items(df, "window.montagedata"), "id", "pos", "href", "title") == [(1, 0, "/a", "T")]


@pytest.mark.parametrize("payload, want", [
    ('[{"command":"insert","data":"<a>"},{"command":"x","data":"n"},{"command":"insert","data":""},{"command":"insert","data":"<b>"}]', "<a>\n<b>\n"),
    ('[{"command":"x","data":"n"}]', None), ("<html>", None), ("[]", None),
])
def test_insert_fragments(value, payload, want):
    assert value(fd.insert_fragments(F.lit(payload))) == want


@pytest.mark.parametrize("payload, want", [
    ('{"html":"<p>1</p>","data":"x"}', "<p>1</p>"), ('  {"a":1,"content":"c"}', "c"), ('{"html":5,"body":"b"}', "b"),
    ('{"n":{"x":1},"m":{"body":"deep"}}', "deep"), ('[{"x":1},{"html":"in list"}]', "in list"), ("<p>plain</p>", "<p>plain</p>"),
    ('{"broken', '{"broken'), ('{"a":1}', '{"a":1}'), ("  ", ""), ('[1, 2]', "[1, 2]"), ('{"z":{"html":"first"},"a":{"html":"second"}}', "first"),
])
def test_unwrap_html(value, payload, want):
    assert value(fd.unwrap_html(F.lit(payload))) == want


def test_keyword_rows(spark):
    df = spark.createDataFrame([(1, '["casino","lotto"]'), (2, None), (3, "null"), (4, "oops")], "id INT, keywords STRING")
    assert rows(fd.keyword_rows(df), "id", "pos", "keyword") == [(1, 0, "casino"), (1, 1, "lotto")]


def test_number_pages(spark):
    def page(n, nxt):
        return ("b", f"https://h/{n}", f'<a rel="next" href="/{nxt}">x</a>')

    pages = spark.createDataFrame([page(1, 2), page(2, 7), page(7, 8), ("b", "https://h/8", None), page(9, 1)], "source STRING, url STRING, html STRING")
    starts = spark.createDataFrame([("https://h/1",)], "start STRING")
    assert rows(number_pages(pages, starts, 40), "page", "url") == [(0, "https://h/1"), (1, "https://h/2"), (2, "https://h/7"), (3, "https://h/8")]
    assert rows(number_pages(pages, starts, 2), "page", "url") == [(0, "https://h/1"), (1, "https://h/2")]


def test_passed_feeds(value):
    assert value(fd.without_items(F.lit("<rss><channel></channel></rss>"))) is True
    assert value(fd.without_items(F.lit("<rss>"))) is True
    assert value(fd.without_items(F.lit("<rss><channel><item><link>x</link></item></channel></rss>"))) is False


def test_plain_links(spark):
    html = (
        '<a href="/1">one <b>bold</b></a><script>"<a href=\'x\'>"</script><A class="x" HREF = "/2">two &amp; open<a href="/3">three</a>'
        '<a name="no">no link</a><abbr href="/no">x</abbr><!-- <a href="/c">c</a> --><a href="">empty</a>')
    df = spark.createDataFrame([(1, html), (2, None), (3, "none")], "id INT, html STRING")
    assert rows(extract_plain_links(df), "id", "pos", "href", "text") == [
        (1, 0, "/1", "one bold"), (1, 1, "/2", "two & open"), (1, 2, "/3", "three"), (1, 3, "", "empty")]


def test_plain_links_read_long_pages_once(spark):
    import time

    df = spark.createDataFrame([('<a href="/x">' * 50000 + "<article>" * 50000,)], "html STRING")
    start = time.time()
    assert extract_plain_links(df).count() == 50000
    assert time.time() - start < 30


def test_listing_anchors_from_sql(spark):
    """All sources' fixture pages give in SQL what the DataFrame form gives; wrong arguments are refused before anything runs."""
    import fixtures as fx
    from pyspark.errors import PySparkException

    from pressline.sources import schemas, sql_functions
    from pressline.sources.html_jobs import extract_links
    from pressline.sources.profiles import default_profiles

    profiles = {s: p for s, p in default_profiles().items() if p.link_rules}
    sql_functions.register(spark, profiles)
    pages = spark.createDataFrame(fx.LIST_PAGES, schemas.LIST_PAGES)
    for source, profile in profiles.items():
        mine = pages.filter(F.col("source") == source)
        found = spark.sql(f"SELECT * FROM listing_anchors(TABLE(SELECT * FROM {{t}}), '{source}')", t=mine)
        got, want = sql_functions.links_of(found, profile), extract_links(mine, {source: profile})
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert found.columns[:5] == ["source", "feed", "list", "page", "url"]
    for call in ("listing_anchors(TABLE(SELECT * FROM {t}), 'nowhere')", "listing_anchors(TABLE(SELECT url FROM {t}), 'mv')"):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM {call}", t=pages)
