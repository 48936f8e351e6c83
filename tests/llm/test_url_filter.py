from __future__ import annotations

from helpers import smallest_reachable

from pressline.llm import url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SCHEMA = "page_id long, url string, html string, url_verdict string, url_host int, alias_node string"


def link(href: str) -> str:
    return f'<html><head><LINK rel="canonical" href="{href}"></head>'


def test_rules(spark):
    urls = ["http://EXAMPLE.org/es/1?x#y", "https://a.example.org/en/12", "https://example.org/en/2", "http://x.com/de/1", "http://com/fr/", "http://xcom/de/",
            "no url", None, "", "http://example.org", "a://b://c", "http://h.org?q=/", "x http://EX.com/de/#f"]
    pages = spark.createDataFrame([(i, u, None, "v", 1, "n") for i, u in enumerate(urls)], SCHEMA)
    got = {r["page_id"]: r["_url_verdict"] for r in url_filter.judge(pages, RULES).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/de/", "block"), ("com/fr/", "allow"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/de/", "block")]
    assert (got[0]["host"], got[0]["path"]) == ("example.org", "/es/1")
    assert (got[7]["host"], got[7]["path"]) == ("", "") and (got[11]["host"], got[11]["path"]) == ("h.org", "")
    assert (got[10]["host"], got[10]["path"]) == ("b:", "//c")


def test_aliases_take_the_decision_of_their_group(spark):
    pages = [
        (1, "http://net.net/a", link("http://x.com/de/9")), (2, "http://net.net/b", link("/a#frag")), (3, "http://net.net/c", None),
        (4, "http://NET.net/d", '<meta http-equiv=refresh content="0; URL=\'b\'">'), (5, "http://y.net/", link("https://w.org/x")),
        (6, "http://y.net", "<!--" + link("http://x.com/de/1") + "-->"), (7, "http://z.net/q", "<script>" + link("http://x.com/de/1") + "</script>"),
        (8, "http://y.net/2", link("http://y.net/")), (9, "http://y.net/3", link("http://x.com/de/4") + link("//y.net/2")),
        (10, "http://x.com/de/5", link("http://w.org/x")), (11, "http://m.net/", link("mailto:a@b")), (1, "http://net.net/a", ""),
    ]
    frame = spark.createDataFrame([(*p, "v", 1, "n") for p in pages], SCHEMA)
    got = sorted((r["page_id"], r["_url_verdict"]["verdict"]) for r in url_filter.judge(frame, RULES).collect())
    assert got == [(1, "block"), (1, "block"), (2, "block"), (3, "allow"), (4, "block"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"),
                   (9, "allow"), (10, "block"), (11, "allow")]


def test_redirect_table_against_brute_force(spark):
    urls = [f"http://n{i}.net/" for i in range(30)] + ["http://x.com/de/1", "http://w.org/1"]
    pairs = [(i, (i * 7 + 3) % 30) for i in range(0, 24, 2)] + [(30, 4), (31, 9)]
    want = smallest_reachable(list(range(32)), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    frame = spark.createDataFrame([(i, u, None, "", 1, "") for i, u in enumerate(urls)], SCHEMA)
    redirects = spark.createDataFrame([(urls[a], urls[b]) for a, b in pairs], "source string, target string")
    got = {r["page_id"]: r["_url_verdict"]["verdict"] for r in url_filter.judge(frame, RULES, redirects).collect()}
    for i in range(30):
        group = {j for j in want if want[j] == want[i]}
        assert got[i] == ("allow" if 31 in group or 30 not in group else "block")


def test_resolved(value):
    from pyspark.sql import functions as F

    base = "http://h.net/a/b?x#y"
    for target, want in {"c": "http://h.net/a/c", "/c": "http://h.net/c", "//k.net/c": "http://k.net/c", "?q": "http://h.net/a/b?q", "#f": None, "": None,
                         "HTTPS://k/": "HTTPS://k/", "mailto:x": None, " c ": "http://h.net/a/c"}.items():
        assert value(url_filter.resolved(F.col("t"), F.col("b")), t=target, b=base) == want, target
    assert value(url_filter.resolved(F.col("t"), F.col("b")), t="c", b="http://h.net") == "http://h.net/c"


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "http://a.net/", "", "", 1, "")], SCHEMA)
    plan = url_filter.judge(frame, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_no_rules(spark):
    assert url_filter.judge(spark.createDataFrame([], SCHEMA), RULES).collect() == []
    assert url_filter.judge(spark.createDataFrame([(1, "http://x.com/de/", None, "", 1, "")], SCHEMA), []).first()["_url_verdict"]["verdict"] == "allow"
