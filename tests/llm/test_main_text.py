from __future__ import annotations

import time

from pressline.llm import main_text as M

TEXT = "Some longer sentence that stands in the article, with a comma and words enough to count. " * 3


def test_parts_that_are_no_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>x</p>";</script></head><body class="has-sidebar">
    <header><h1>Site name</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice"><p>{TEXT}</p></div>
    <div id="sidebar-left"><p>{TEXT}</p></div><div class="ad">Buy <b>now</b></div><!-- <p>hidden</p> -->
    <article><header><h1>Title &amp; more</h1></header><p>First &eacute;&nbsp;part <a href="x">a link</a>,<br>after   a break.<p><b>Second. {TEXT}</p>
    <form><p>{TEXT}</p><input></form><ul><li>One<li>Two</ul><table><tr><td>c1<td>c2</table><aside>{TEXT}</aside>
    <div class="comments-area"><p>{TEXT}{TEXT}</p></div><noscript>no</noscript><p hidden>gone</p></article>
    <section id="comments"><p>{TEXT}{TEXT}{TEXT}</p></section><footer>&copy; host &middot; x</footer></body></html>"""
    assert M.main_text(page) == "\n".join(
        ["Title & more", "First é part a link, after a break.", f"Second. {TEXT.strip()}", "One", "Two", "c1", "c2"])


def test_without_article_element():
    page = f"""<body><div class=page><div class=top><a href=/>Home</a> <a href=/b>B</a></div><h1>Head</h1><div class=entry><p>{TEXT}</p><p>short.</p>
    <blockquote>{TEXT}</blockquote></div><div class=links><a href=1>{TEXT}</a><a href=2>{TEXT}</a></div></div></body>"""
    assert M.main_text(page) == "\n".join(["Head", TEXT.strip(), "short.", TEXT.strip()])


def test_sums_and_threshold_decide_beside_an_article():
    part = f"<h2>Part</h2><p>{TEXT}</p><p>short.</p><p>{TEXT}</p>"
    text = ["Part", TEXT.strip(), "short.", TEXT.strip()]
    for kind in ("article", "div"):
        for count in (2, 3):
            assert M.main_text(f"<body><div>{f'<{kind}>{part}</{kind}>' * count}</div></body>") == "\n".join(text * count), (kind, count)
    links = f"<ul>{'<li><a href=1>Another story</a></li>' * 9}</ul>"
    apart = f"<div><article>{part}</article></div><div><article>{part}</article><article>{part}</article></div>"
    assert M.main_text(f"<body><div>{apart}</div>{links}</body>") == "\n".join(text * 3)
    assert M.main_text(f"<body><main><article>{part}</article>{links}</main></body>") == "\n".join(text)
    more = f"<section><p>{TEXT}{TEXT}</p></section>"
    assert M.main_text(f"<body><main><article>{part * 3}</article>{more}{links}</main></body>") == "\n".join([*text * 3, f"{TEXT}{TEXT}".strip()])


def test_articles_that_are_comments_or_teasers():
    comments = "".join(f"<article class=comment id=c{i}><p>{TEXT}</p></article>" for i in range(4))
    teasers = f"<article><h3>Other</h3><p>{TEXT}</p></article>" * 3
    inner = f"<h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p>"
    story = f"<article class='post category-social'>{inner}</article>"
    text = "\n".join(["Head", TEXT.strip(), TEXT.strip()])
    assert M.main_text(f"<body><main>{story}<div id=comments>{comments}</div></main></body>") == text
    assert M.main_text(f"<body><main>{story}<section>{comments}</section></main></body>") == text
    assert M.main_text(f"<body><main>{story}<div class=related>{teasers}</div></main></body>") == text
    assert M.main_text(f"<body><article>{inner}<section><article itemprop=comment><p>{TEXT}</p></article></section></article></body>") == text
    # The article itself may stand in something named, or be named.
    assert M.main_text(f"<body><div class=widget>{story}</div><div class=related>{teasers}</div></body>") == text
    assert M.main_text(f"<body><main>{story.replace('post', 'social-story')}</main></body>") == text
    assert M.main_text(f"<body><div class=overlay><main>{inner}<div class=related>{teasers[: len(teasers) // 3]}</div></main></div></body>") == text


def test_page_in_a_form():
    search, login = "<form action=/s><input><p>Search here</p></form>", f"<form class=login><p>{TEXT}{TEXT}{TEXT}</p></form>"
    form = "<form method=post action=./p.aspx id=form1 runat=server role=form>"
    inner = f"<h1>Head</h1><p>{TEXT}</p><select><option>no</select><p>{TEXT}</p>"
    text = "\n".join(["Head", TEXT.strip(), TEXT.strip()])
    for kind in ("article", "main", "div", "section"):
        page = f"<nav><a href=/>Home</a></nav><{kind}>{inner}{login}</{kind}><div id=comments><p>{TEXT}</p></div><footer>x</footer>"
        assert M.main_text(f"<body>{form}{page}</form></body>") == text, kind
        assert M.main_text(f"<body>{search}{form}<fieldset>{page}</fieldset></form></body>") == text, kind
        assert M.main_text(f"<body>{search}{page}{search}</body>") == text, kind
    assert M.main_text(f"<body><h1>Head</h1><form><p>{TEXT}</p></form></body>") == f"Head\n{TEXT.strip()}"
    for kind in ("dialog", "label"):
        assert M.main_text(f"<body><{kind}><article>{inner}</article></{kind}></body>") == text
        assert M.main_text(f"<body><div>{inner}</div><{kind}><p>{TEXT}{TEXT}{TEXT}</p></{kind}></body>") == text


def test_stray_quotes_in_tags():
    assert M.main_text("<p title=it's>Hello world</p><p>more</p>") == "Hello world\nmore"
    assert M.main_text("<p title=it's>Hello don't</p><p>more</p>") == "Hello don't\nmore"
    assert M.main_text("""<p><a href="x" title="5" screen">link</a> text</p><p>it"s more</p>""") == 'link text\nit"s more'
    assert M.main_text("<p title = 'a > b' x=\"c > d\" y=/?a='>x</p>") == "x"
    assert M.main_text("""<p>a</p><p title="b>c</p><p>d</p>""") == "a\nc\nd"
    assert M.main_text("""<p>a</p><p title="b>c</p><p>d "quoted" words</p>z""") == "a\nz"
    assert M.main_text("""<p>a</p><p title="b>c" d""") == 'a\nc" d'
    assert M.main_text("<p>kept</p><p title=never") == "kept"

    def seconds(n: int) -> float:
        start = time.process_time()
        for part in ("<a b='>'", "<p title=it's>x", '<a b="c>d', "<a b='x\">' c=\"'>\"", "<a =\"'", "<a b= c=\"'>"):
            M.main_text(part * n)
        return time.process_time() - start

    seconds(2000)
    assert seconds(40_000) < 12 * max(seconds(8_000), 0.05)


def test_link_lists_have_low_density():
    page = M.parse(f"<body><div>{TEXT}</div><div><a>{TEXT}</a></div></body>")
    density = M.densities(page, [False] * len(page.name))
    first, second = (i for i, n in enumerate(page.name) if n == "div")
    assert density[first] > 3 * density[second]


def test_layout_names_give_way_to_the_text():
    inner = f"<h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p>"
    text = "\n".join(["Head", TEXT.strip(), TEXT.strip()])
    side = f"<div class=sidebar><p>Short side text.</p><ul><li><a href=1>{TEXT}</a></li></ul></div>"
    rest = "<nav><a href=/>Home</a></nav><footer>x</footer>"
    for around in (
        'class="elementor-widget elementor-widget-theme-post-content"', 'id=wrapper class="right-sidebar"', 'class="page-with-sidebar"', 'class="social-post"', 'id="notice"',
        "role=dialog",
    ):
        for page in (f"<div {around}>{inner}</div>", f"<div {around}>{inner}{side}</div>", f"<div {around}><div class=widget>{inner}</div></div>{side}"):
            assert M.main_text(f"<body>{rest}{page}</body>") == text, (around, page[:60])
    # Names of what is never main text hold; so do all names beside an article, and where the rest weighs as much.
    for around in ("class=comments", "id=cookie-notice", "class='ad widget'", "role=navigation"):
        assert M.main_text(f"<body><div {around}>{inner}</div><p>x y z</p></body>") == "x y z"
    assert M.main_text(f"<body><div>{inner}</div><div class=sidebar><p>{TEXT}</p><p>{TEXT}</p></div></body>") == text
    assert M.main_text(f"<body><article><p>Short.</p></article><div class=widget>{inner}</div></body>") == "Short."


def test_self_closed_svg():
    assert M.main_text("<article><svg/>text</article>") == "text"
    assert M.main_text("<article><svg width=1 />a <svg><title>no</title></svg>b<svg viewBox='0 0 1 1'/></article>") == "a b"


def naive(page):
    """Densities, sums, and the text nodes in the main part, each computed from scratch by its definition; for pages without
    names, forms and articles."""
    from math import e, log

    n = len(page.name)
    kids = [[c for c in range(n) if c and page.parent[c] == i] for i in range(n)]

    def tree(i):
        return [i, *[d for c in kids[i] for d in tree(c)]]

    def in_link(i):
        return i > 0 and (page.name[i] == "a" or in_link(page.parent[i]))

    def chars(i, links):
        mine = set(tree(i))
        return sum(len(" ".join(t.split())) for node, t in page.content if t is not None and node in mine and (not links or in_link(node)))

    body = page.name.index("body")
    share = chars(body, True) / max(chars(body, False), 1)

    def density(i):
        c, lc = chars(i, False), chars(i, True)
        t, lt = max(len(tree(i)) - 1, 1), max(sum(page.name[j] == "a" for j in tree(i)[1:]), 1)
        if not c:
            return 0.0
        return c / t * log(c / max(lc, 1) * t / lt + 1) / log(log(c / max(c - lc, 1) * lc + share * c + e) + 1)

    def total(i):
        return sum(map(density, kids[i])) if kids[i] else density(i)

    def core(top):
        return max(tree(top), key=lambda i: (total(i), -i))

    threshold = density(core(0))
    at = core(0)
    while page.parent[at] > 0:
        at = page.parent[at]
        threshold = min(threshold, density(at))
    inside, tops = set(), [0]
    while tops:
        top = tops.pop()
        at = core(top)
        inside |= set(tree(at))
        while at != top:
            at, below = page.parent[at], at
            tops += [c for c in kids[at] if c != below and density(c) >= threshold > 0]
    return [density(i) for i in range(n)], [total(i) for i in range(n)], inside


def test_against_a_naive_second_form():
    import random

    rng = random.Random(11)

    def some(depth):
        if depth == 0 or rng.random() < 0.2:
            words = " ".join("word" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 4, 30])))
            return f"<a href=x>{words}</a>" if rng.random() < 0.3 else words
        kind = rng.choice(["div", "section", "span", "b", "ul", "div"])
        return f"<{kind}>{''.join(some(depth - 1) for _ in range(rng.randint(0, 3)))}</{kind}>"

    for _ in range(150):
        page = M.parse(f"<html><body>{''.join(some(4) for _ in range(3))}</body></html>")
        gone = M._gone(page)
        density, sums, inside = naive(page)
        got, got_sums, _ = M._sums(page, gone)
        assert not any(gone) and max(abs(a - b) for a, b in zip(got, density)) < 1e-9
        assert max(abs(a - b) for a, b in zip(got_sums, sums)) < 1e-6
        assert {i for i, x in enumerate(M.chosen(page, gone)) if x} == inside


def test_odd_pages():
    assert M.main_text(None) == M.main_text("") == M.main_text("<nav>x</nav>") == ""
    assert M.main_text("plain   text\nonly") == "plain text only"
    assert M.main_text("a < b and c <3 d") == "a < b and c <3 d"
    assert M.main_text("<p>x</p></div></p><p>y") == "x\ny"
    assert M.main_text("<p>kept</p><script>var a = '<p>no") == "kept"
    assert M.main_text("<p>kept</p><!-- no") == "kept"
    assert M.main_text("<p title='a > b'>x</p>") == "x"
    assert M.main_text("<p>a&lt;b&#x41;&amp;amp;</p>") == "a<bA&amp;"


def test_time_grows_with_length():
    def seconds(n: int) -> float:
        start = time.process_time()
        for part in ("<div class='x'>a", "<p>a<b>", "<li><ul>b", "<a <b '", "</p>"):
            M.main_text(part * n)
        return time.process_time() - start

    seconds(2000)
    assert seconds(40_000) < 12 * max(seconds(8_000), 0.05)


def test_rows(spark):
    schema = "page_id long, url string, html string, main_text string, text string"
    frame = spark.createDataFrame([(1, "u", "<p>a</p>", "m", "t"), (None, None, None, None, None), (1, "u", "<p>a</p>", "m", "t")], schema)
    got = M.extract(frame)
    assert got.columns == ["page_id", "url", "main_text", "text", "_main_text"]
    assert sorted(r["_main_text"] for r in got.collect()) == ["", "a", "a"]
    assert M.extract(frame.limit(0)).collect() == []
