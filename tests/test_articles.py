import pytest
from pyspark.sql import functions as F

from pressline.operators import articles as art
from pressline.operators import relevance as rel


def lines(*items):
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def test_native_paragraphs(value):
    html = (
        '<html><script>var t="<p>no</p>";</script><p>outside</p><article class="x"><h1>T</h1><P class="a">one <b>bold</b></p>'
        "<p>two &amp; more<p>three &lt;3<!-- <p>hidden</p> --></article><pre>no</pre></html>"
    )
    assert value(art.native_paragraphs(F.lit(html))) == ["one bold", "two & more", "three <3"]
    assert value(art.native_paragraphs(F.lit("<div><p>only</div>"))) == ["only"]
    assert value(art.native_paragraphs(F.lit("no paragraphs"))) == []
    assert value(art.native_paragraphs(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("items, want", [
    (["a", "Kontakt: x", "b"], ["a"]), (["KONTAKT", "b"], []), (["a", "b"], ["a", "b"]), ([], []), (["x Kontakt"], ["x Kontakt"]),
])
def test_take_until(value, items, want):
    assert value(art.take_until(lines(*items), art.line_start(["kontakt"]))) == want


def test_stop_marker_folds_ascii_only(value):
    pattern = art.line_start(["rückfragen"])
    assert value(art.take_until(lines("RüCKFRAGEN an"), pattern)) == []
    assert value(art.take_until(lines("RÜCKFRAGEN an"), pattern)) == ["RÜCKFRAGEN an"]


def test_clean_skip_and_text(value):
    raw = lines(" a ", "\t", "Zum Inhalt", "b ")
    assert value(art.clean_lines(raw)) == ["a", "", "Zum Inhalt", "b "]
    assert value(art.clean_lines(raw, True)) == ["a", "Zum Inhalt", "b "]
    kept = art.drop_lines(art.clean_lines(raw, True), art.line_start(["zum inhalt"]))
    assert value(art.content_text(kept)) == "a\nb \n"
    assert value(art.content_text(lines())) == ""


@pytest.mark.parametrize("length, want", [(80, 0), (81, 81), (300, 300), (301, 303)])
def test_summary_lengths(value, length, want):
    got = value(art.summary(lines("kurz", "𝄞" * length)))
    assert len(got) == want
    assert got.endswith("...") == (want == 303)


def test_summary_skips_markers_and_variants(value):
    long = "x" * 100
    raw = lines("Original-Content " + long, "01.02.2025 " + long, "ok " + long, "kontakt " + long)
    assert value(art.summary(raw)).startswith("ok")
    assert value(art.summary(raw, (), ellipsis=False)).startswith("Original")
    assert value(art.summary(lines("y" * 400), (), ellipsis=False)) == "y" * 300
    assert value(art.summary(lines("kontakt " + long), art.SKIP_MARKERS + ("kontakt",))) == ""


def test_heading(value):
    assert value(art.heading(F.lit("<h1>\n A  <i>b</i></h1><h1>c</h1>"))) == "A b"
    assert value(art.heading(F.lit("<h1> </h1>"))) == ""
    assert value(art.heading(F.lit("<h2>x</h2>"))) is None
    assert value(art.heading_title(F.lit(""), F.lit("Liste"))) == ""


def test_meta_description(value):
    def of(html):
        return value(art.meta_description(F.lit(html)))

    assert of('<meta property="og:description" content="og"><meta name="description" content=" a &amp; b ">') == "a & b"
    assert of("<meta content='it''s' property='og:description'>") == "it"
    assert of('<meta name="keywords" content="x">') is None


def test_first_keyword_order_and_fold(value):
    body = F.lit("GLÜCKSSPIEL im Casino")
    assert value(rel.first_keyword(body, ["glücksspiel", "casino"])) == "casino"
    assert value(rel.first_keyword(body, ["glücksspiel", "casino"], "unicode")) == "glücksspiel"
    assert value(rel.first_keyword(body, ["lotto", "cas.no"])) == "cas.no"
    assert value(rel.first_keyword(body, [])) is None
    assert value(rel.first_keyword([F.lit("x"), F.lit("Lotto")], ["casino", "lotto"], "unicode")) == "lotto"
    assert value(rel.first_keyword([F.lit(None).cast("string"), F.lit("lotto")], ["lotto"])) == "lotto"


def test_keyword_context(value):
    text = "a" * 30 + "CASINO" + "b" * 60
    got = value(rel.keyword_context(F.lit(text), F.lit("casino")))
    assert got == "a" * 20 + "CASINO" + "b" * 34
    assert value(rel.keyword_context(F.lit("Casino am Ort"), F.lit("casino"))) == "Casino am Ort"
    assert value(rel.keyword_context(F.lit("casino"), F.lit("cas.no"))) is None
