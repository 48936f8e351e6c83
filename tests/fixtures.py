"""Invented listing and article pages for every source, with the rows a run must give."""

from __future__ import annotations

import datetime as dt
import json

AS_OF = "2025-07-02 12:00:00"
KEYWORDS = ["glücksspiel", "casino"]
LONG = "Bei einer Kontrolle im Casino fanden die Beamten mehrere Automaten und stellten Bargeld sicher, wie es weiter hieß."

LIST_PAGES = [
    # source, feed, list, page, url, html
    ("presseportal", 0, 0, 0, "l", '<a href="/blaulicht/pm/1">POL-HH: Eins</a><a href="/sport">x</a><a href="/blaulicht/pm/2">Zwei</a>'),
    ("presseportal", 0, 0, 1, "l", None),
    ("presseportal", 0, 1, 0, "l", '<a href="https://www.presseportal.de/blaulicht/pm/1">Doppelt</a><a href="/blaulicht/pm/3">Drei</a>'),
    ("bayern", 0, 0, 1, "l", '<script>window.montagedata = [{"href":"/a","title":" BY 1 "},{"href":"","title":"x"}];</script>'),
    ("bayern", 0, 0, 2, "l", "<p>leer</p>"),
    ("bayern", 0, 0, 3, "l", '<script>window.montagedata = [{"href":"/zu-spaet","title":"x"}];</script>'),
    ("berlin", 0, 0, 0, "https://www.berlin.de/polizei/polizeimeldungen/", '<ul class="list list--tablelist"><li><div class="cell date">02.07.2025  09:15 Uhr</div><div class="cell text">'
     '<a href="/polizei/b1">Berlin 1</a> <a href="/x">mehr</a><span class="category"><strong>Ereignisort: </strong>Pankow</span></div></li>'
     '<li><div class="date">01.01.2025 09:15 Uhr</div><div class="text"><a href="polizei/b2">Berlin 2</a></div></li></ul>'),
    ("brandenburg", 0, 0, 1, "l", '<div id="pbb-search-result-pager"><ul class="pbb-searchlist"><li><h4><a href="/bb1"> BB\n 1</a></h4>'
     '<p><a href="/suche/typ/Meldungen/landkreis/x">Havelland</a></p></li></ul></div><h4><a href="/no">no</a></h4>'),
    ("brandenburg", 0, 0, 2, "l", '<div id="pbb-search-result-pager"><ul class="pbb-searchlist"><li><h4><a href="/bb1">BB 1 neu</a></h4>'
     '<p><a href="/suche/typ/Meldungen/landkreis/y">Barnim</a></p></li></ul></div>'),
    ("bremen", 0, 0, 0, "l", '<ul class="news_liste"><li><a class="direct" href="news/1#m2"><span>HB 1</span><time datetime="2025-07-02">2.7.</time></a></li>'
     '<li><a class="direct" href="/news/2"><span>HB alt</span><time>01.05.2025</time></a></li><li><a href="/other">x</a></li></ul>'),
    ("mv", 0, 0, 0, "l", '<div class="teaser dvz-contenttype-presseserviceassistent"><h3><a href="/mv1">POL-NB: MV 1</a></h3><h3><a href="/mv-no">x</a></h3></div>'
     '<div class="teaser"><h3><a href="/mv-no2">x</a></h3></div>'),
    ("sachsen", 0, 0, 1, "l", '<a href="/medien/news-1"> </a><a href="/medien/">x</a><a href="/medien/?search[a]=1">x</a>'),
    ("sachsen-anhalt", 0, 0, 1, "l", '<div class="tx-rssdisplay-newslist"><h2><a href="bs/1"> SA \n 1 </a></h2></div><h2><a href="/no">x</a></h2>'),
    ("schleswig-holstein", 0, 0, 0, "l", '<div data-article-id="7"><a href="/lokales/x/artikel/1">link</a><h3> SH Glücksspiel </h3></div>'
     '<div class="big article__teaser"><a href="/lokales/video/artikel/9">v</a></div>'),
]

FEEDS = [
    ("nrw", 0, 0, 0, '<rss><channel><item><title>NRW 1</title><link>/nrw1</link><pubDate>Wed, 02 Jul 2025 08:00:00 +0200</pubDate></item>'
     '<item><title>leer</title><link></link></item></channel></rss>'),
    ("nrw", 0, 0, 1, '<rss><channel><item><title>NRW 1 doppelt</title><link>/nrw1</link></item></channel></rss>'),
    ("schleswig-holstein", 2, 0, 0, '<rss><channel><item><title>SH 2</title><link>https://www.shz.de/artikel/2</link></item>'
     '<item><title>v</title><link>https://www.shz.de/video/artikel/3</link></item><item><title>n</title><link>https://www.shz.de/x</link></item></channel></rss>'),
]

PAYLOADS = [
    ("nrw", 1, 0, 1, json.dumps([
        {"command": "settings", "data": "x"},
        {"command": "insert", "data": '<div class="view-content"><div class="views-row"><div class="fields-wrapper"><h2 class="field-title"><a href="nrw2">NRW 2</a></h2>'
         '<time datetime="2025-07-01T20:00:00Z">1.7.</time></div></div></div>'},
        {"command": "insert", "data": ""}])),
    ("schleswig-holstein", 1, 0, 1, json.dumps({"status": 1, "chunk": {"html": '<div class="article__teaser"><a href="lokales/artikel/4">SH 4</a></div>'}})),
]


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


ARTICLES = [
    # url, html
    ("https://www.presseportal.de/blaulicht/pm/1", page(
        '<p class="date"><time datetime="2025-07-02 10:30:01">2.7.</time></p><div class="article-text"><p>Hamburg (ots)</p>'
        f"<p>{LONG} Tatort war in Hamburg-Mitte.<p>Glücksspiel &amp; mehr</p><script>var x='</p>';</script></div><div class='article-text'><p>nicht</p></div>")),
    ("https://www.presseportal.de/blaulicht/pm/2", page('<p class="date"><time datetime="2025-06-30 10:30:01">x</time></p><p>casino</p>')),
    ("https://www.presseportal.de/blaulicht/pm/3", page("<div class='text'><p>Weitere Meldungen: casino</p></div>")),
    ("https://www.polizei.bayern.de/a", page(f'<time datetime="2025-07-02T08:00Z">x</time><div class="bp-text"><p>{LONG} Es war bei Augsburg.</p></div>')),
    ("https://www.berlin.de/polizei/b1", page(f'<div class="textile"><p>{LONG}</p><p>Kontakt: x</p></div>')),
    ("https://www.berlin.de/polizei/b2", page(f'<div class="textile"><p>{LONG}</p></div>')),
    ("https://polizei.brandenburg.de/bb1", page(
        f'<h1> Titel \n BB </h1><div class="pbb-content"><p>{LONG}</p><p> </p><footer><p>Fuß</p></footer></div>Artikel vom 02.07.2025')),
    ("https://www.polizei.bremen.de/news/1#m2", page(
        f'<p>vorher</p><div id="m2"><p>innen</p></div><p>Zur Navigation</p><p>{LONG}</p><p>in Vegesack</p><p>Impressum</p><p>danach</p>')),
    ("https://www.polizei.bremen.de/news/2", page(f"<p>{LONG}</p>")),
    ("https://www.polizei.mvnet.de/mv1", page(
        f'<span class="dtstart"> 02.07.2025 </span><div class="dvz-contenttype-presseserviceassistent"><p>{LONG}</p><p>Hinweise an</p></div>')),
    ("https://medienservice.sachsen.de/medien/news-1", page(f'<time>2. Juli 2025</time><article><p>{LONG}</p></article>')),
    ("https://www.sachsen-anhalt.de/bs/1", page(f'<div id="content"><p>Zurück zur Übersicht? {LONG}</p><p>Zur  Übersicht</p></div><time datetime="2025-07-02T09:00:00+02:00"></time>')),
    ("https://polizei.nrw/nrw1", page(f'<main><div class="node__content"><p>{LONG}</p></div></main>')),
    ("https://polizei.nrw/nrw2", page(f'<main><div class="field x body"><p>{LONG}</p></div></main><time datetime="2025-06-01">x</time>')),
    ("https://www.shz.de/lokales/x/artikel/1", page("<p>kein Artikelabsatz</p>", '<meta property="og:description" content=" Kurz &amp; knapp ">')),
    ("https://www.shz.de/artikel/2", page("<article><p>GLÜCKSSPIEL in Kiel</p></article>")),
    ("https://www.shz.de/lokales/artikel/4", ""),
]


def answer(illegal=True, **fields):
    content = {"ort": None, "typ": None, "koord": None, "bundesland": None, "illegal": illegal, **fields}
    return json.dumps({"choices": [{"message": {"content": json.dumps(content)}}]})


ANSWERS = [
    ("https://www.presseportal.de/blaulicht/pm/1", answer(typ="Wetten", koord={"lat": 53.55, "lon": "10.0"})),
    ("https://www.polizei.bayern.de/a", answer(ort="", typ="")),
    ("https://www.berlin.de/polizei/b1", answer(koord={"lat": 0, "lon": 13.4})),
    ("https://polizei.brandenburg.de/bb1", answer(bundesland="Brandenburg")),
    ("https://www.polizei.bremen.de/news/1#m2", answer()),
    ("https://www.polizei.mvnet.de/mv1", answer("true")),
    ("https://medienservice.sachsen.de/medien/news-1", answer(ort="Nirgendwo", koord={"lat": 51.0, "lon": 0})),
    ("https://www.sachsen-anhalt.de/bs/1", answer(False)),
    ("https://polizei.nrw/nrw1", answer(ort="Essen", koord={"lat": 51.45, "lon": 7.01})),
    ("https://www.shz.de/lokales/x/artikel/1", answer(ort="Kiel", bundesland="Schleswig-Holstein")),
]

GAZETTEER = [("Pankow", 1, 52.57, 13.4), ("Barnim", 1, 52.8, 13.7), ("Vegesack", 2, 1.0, 1.0), ("vegesack", 1, 53.17, 8.62), ("Kiel", 1, 54.32, 10.14)]

STATES = [
    ("Berlin", [[(13.1, 52.3), (13.8, 52.3), (13.8, 52.7), (13.1, 52.7)]]),
    ("Bremen", [[(8.4, 53.0), (9.0, 53.0), (9.0, 53.3), (8.4, 53.3)]]),
    ("Hamburg", [[(9.7, 53.4), (10.3, 53.4), (10.3, 53.7), (9.7, 53.7)]]),
]

STORED = ["https://www.shz.de/artikel/2"]

DAY = dt.date(2025, 7, 2)
SUMMARY = LONG

# url -> title, summary, date, location, lat, lon, federal, type
ACCEPTED = {
    "https://www.presseportal.de/blaulicht/pm/1": (
        "Eins", LONG + " Tatort war in Hamburg-Mitte.", DAY, "Hamburg-Mitte", 53.55, 10.0, "Hamburg", "Wetten"),
    "https://www.polizei.bayern.de/a": ("BY 1", LONG + " Es war bei Augsburg.", DAY, "", None, None, None, ""),
    "https://www.berlin.de/polizei/b1": ("Berlin 1", LONG, DAY, "Pankow", 52.57, 13.4, "Berlin", "Sonstige"),
    "https://polizei.brandenburg.de/bb1": ("Titel BB", LONG, DAY, "Barnim", 52.8, 13.7, "Brandenburg", "Sonstige"),
    "https://www.polizei.bremen.de/news/1#m2": ("HB 1", LONG, DAY, "Vegesack", 53.17, 8.62, "Bremen", "Sonstige"),
    "https://medienservice.sachsen.de/medien/news-1": ("(Ohne Titel)", LONG, DAY, "Nirgendwo", None, None, None, "Sonstige"),
    "https://polizei.nrw/nrw1": ("NRW 1", LONG, DAY, "Essen", 51.45, 7.01, None, "Sonstige"),
    "https://www.shz.de/lokales/x/artikel/1": (
        "SH Glücksspiel", "Kurz & knapp", DAY, "Kiel", 54.32, 10.14, "Schleswig-Holstein", "Sonstige"),
}

REJECTED = {
    "https://www.presseportal.de/blaulicht/pm/2": "too_old",
    "https://www.presseportal.de/blaulicht/pm/3": "no_keyword",
    "https://www.berlin.de/polizei/b2": "too_old",
    "https://www.polizei.bremen.de/news/2": "too_old",
    "https://www.polizei.mvnet.de/mv1": "not_illegal",
    "https://www.sachsen-anhalt.de/bs/1": "not_illegal",
    "https://polizei.nrw/nrw2": "too_old",
    "https://www.shz.de/artikel/2": "stored",
    "https://www.shz.de/lokales/artikel/4": "load_failed",
}
