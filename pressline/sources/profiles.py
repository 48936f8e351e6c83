"""One profile per press source: lists, link rules, text rules, date ladder.

Everything that differs between sources is data here; the operators are shared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pressline.operators.articles import SKIP_MARKERS


@dataclass(frozen=True)
class Box:
    """Elements of a page: tag, parts of the class, ids, and where they stand."""

    tag: str = "*"
    classes: tuple[str, ...] = ()       # one of these is part of the class
    also: tuple[str, ...] = ()          # and one of these as well
    ids: tuple[str, ...] = ()           # or the id is one of these
    id_parts: tuple[str, ...] = ()      # or one of these is part of the id
    attribute: str = ""                 # or it has this attribute
    first: str = ""                     # "page": only the first; "sibling": only the first per parent
    inside: str = ""                    # below this tag
    not_inside: str = ""                # paragraphs below this tag do not count


@dataclass(frozen=True)
class LinkRule:
    """Anchors of a listing page and the sidecars next to them."""

    within: tuple[Box, ...] = ()        # boxes from outer to inner; the anchor stands in the last
    anchor_class: str = ""
    href_parts: tuple[str, ...] = ()
    href_not: tuple[str, ...] = ()      # a chosen anchor with such a link is passed over
    title_tag: str = ""                 # text of the first such tag inside the anchor is the title
    title_in_box: bool = False          # ... inside the box, else the anchor text
    one_per: int = -1                   # level in ``within`` whose boxes give one link each
    item: Box | None = None             # the list entry that holds the sidecars


@dataclass(frozen=True)
class ListSpec:
    """URLs of one list: the first page, then a template with ``{page}`` and ``{offset}``."""

    first_url: str
    template: str = ""
    first: int = 0
    pages: int = 1
    step: int = 0
    label: str = ""


@dataclass(frozen=True)
class Profile:
    source: str
    base: str
    lists: tuple[ListSpec, ...]
    url_rule: str = "append"
    link_rules: tuple[LinkRule, ...] = ()
    title_rule: str = "trim"            # trim | agency | squeeze
    placeholder: str = ""               # title of links without one
    exclude: tuple[str, ...] = ()
    path_pattern: str = ""
    early_gate: bool = False
    ladder: tuple[tuple[Box, ...], ...] = ()
    anchored: bool = False
    stop: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    drop_empty: bool = False
    meta_fallback: bool = False
    heading_title: bool = False
    dates: tuple[str, ...] = ()
    fold: str = "ascii"
    match_title: bool = False
    summary_markers: tuple[str, ...] = SKIP_MARKERS
    summary_ellipsis: bool = True
    place_sidecar: str = ""             # column that joins the location ladder
    sidecar_first: bool = False         # before the place found in the text
    strict_places: bool = True          # exclude directions and authorities
    null_only_place: bool = False       # only a null place moves on, not an empty one
    page_rule: str = "skip"             # stop: lists end at their first bad page
    cap: int | None = None
    on_unknown: str = "new"             # what links are where the store cannot be read: new | exist
    extra: dict = field(default_factory=dict)


ANY_P = (Box(),)


def offset_list(base: str, pages: int = 20, step: int = 30) -> ListSpec:
    return ListSpec(base, base + "/{offset}", 0, pages, step)


def page_list(base: str, pages: int) -> ListSpec:
    return ListSpec(base + "?page=1", base + "?page={page}", 1, pages)


# Line starts that end an article, shared by several sources.
PORTAL_STOPS = (
    "weitere meldungen", "original-content", "druckversion", "pdf-version",
    "orte in dieser meldung", "themen in dieser meldung", "rückfragen bitte an",
)

# Query of the following pages in one source's paging.
SA_PAGE_QUERY = (
    "?tx_tsarssinclude_pi1%5Baction%5D=list&tx_tsarssinclude_pi1%5Bcontroller%5D=Base"
    "&tx_tsarssinclude_pi1%5Bpage%5D={page}"
)

# List numbers of the five directorates.
SACHSEN_DIRECTORATES = {
    "Chemnitz": 10996, "Dresden": 10997, "Görlitz": 10998, "Leipzig": 10976, "Zwickau": 10999,
}


def default_profiles() -> dict[str, Profile]:
    """The ten sources. URLs, selectors, markers, caps and ladders are fixed values."""
    portal = "https://www.presseportal.de"
    bb = "https://polizei.brandenburg.de/suche/typ/Meldungen/kategorie"
    mv = "https://www.polizei.mvnet.de/Presse/Pressemitteilungen/"
    sa = "https://www.sachsen-anhalt.de/bs/pressemitteilungen/"
    ms = "https://medienservice.sachsen.de"
    shz = "https://www.shz.de"
    rows = [
        Profile(
            "presseportal", portal,
            (offset_list(portal + "/suche/gl%C3%BCcksspiel/blaulicht"), offset_list(portal + "/blaulicht")),
            link_rules=(LinkRule(href_parts=("/blaulicht/pm/",)),), title_rule="agency",
            ladder=((Box("div", ("article-text",), first="page"),), (Box("div", ("text",)),), ANY_P),
            stop=PORTAL_STOPS, dates=("dated_time",),
        ),
        Profile(
            "bayern", "https://www.polizei.bayern.de",
            (ListSpec("https://www.polizei.bayern.de/aktuelles/pressemitteilungen/index.html",
                      "https://www.polizei.bayern.de/aktuelles/pressemitteilungen/index.html?page={page}", 1, 20),),
            url_rule="prefix", page_rule="stop",
            ladder=((Box("div", ("bp-text",)),), ANY_P),
            stop=("weitere meldungen", "original-content", "druckversion", "pdf-version"),
            dates=("time_strict",), summary_markers=(), summary_ellipsis=False,
            strict_places=False, null_only_place=True, on_unknown="exist", extra={"script_variable": "window.montagedata"},
        ),
        Profile(
            "berlin", "https://www.berlin.de", (ListSpec("https://www.berlin.de/polizei/polizeimeldungen/"),),
            url_rule="slash",
            link_rules=(LinkRule((Box("ul", ("list--tablelist",)), Box("li"), Box("div", ("text",), first="page")),
                                 one_per=1, item=Box("li")),),
            ladder=((Box("div", ("textile", "article", "content", "modul-text"), first="page"),),
                    (Box("article"),), ANY_P),
            stop=("kontakt", "rückfragen", "service", "weitere meldungen", "verwandte themen"),
            dates=("list_clock", "dcterms", "time_full"),
            place_sidecar="event_location", sidecar_first=True, extra={"follow_next": 40},
        ),
        Profile(
            "brandenburg", "https://polizei.brandenburg.de",
            (ListSpec(bb + "?reset=1", bb + "/null/{page}/1?reset=1", 1, 10),),
            link_rules=(LinkRule((Box("div", ids=("pbb-search-result-pager",)), Box("ul", ("pbb-searchlist",)), Box("h4")),
                                 item=Box("li")),),
            title_rule="squeeze", heading_title=True,
            ladder=((Box("div", ("pbb-content",), not_inside="footer"),
                     Box("div", ids=("pbb-subcontent",), not_inside="footer")), ANY_P),
            stop=("rückfragen bitte an", "kontakt", "impressum", "datenschutz"), drop_empty=True,
            dates=("time_strict", "after_label"), place_sidecar="list_region",
            extra={"region_href": "/suche/typ/Meldungen/landkreis/"},
        ),
        Profile(
            "bremen", "https://www.polizei.bremen.de",
            (ListSpec("https://www.polizei.bremen.de/news/pressestelle-60902"),), url_rule="slash",
            link_rules=(LinkRule((Box("ul", ("news_liste",)),), anchor_class="direct", title_tag="span"),),
            early_gate=True, anchored=True,
            ladder=((Box("div", ("article",), first="page"),),
                    (Box("div", ("entry-wrapper",), first="sibling"),), ANY_P),
            stop=PORTAL_STOPS + ("kontakt", "impressum", "datenschutzerklärung"),
            skip=(r"zur(?:\s+)?navigation", "zum inhalt", "zur fußzeile", "barrierefreiheit"), drop_empty=True,
            dates=("list_day", "class_time_attr", "class_time_text"),
        ),
        Profile(
            "mv", "https://www.polizei.mvnet.de",
            (ListSpec(mv, mv + "?pager.page.nr={page}&pager.items.offset={offset}", 0, 20, 10),),
            link_rules=(LinkRule((Box("div", ("teaser",), ("dvz-contenttype-presseserviceassistent",)), Box("h3")),
                                 one_per=0),),
            title_rule="agency",
            ladder=((Box("div", ("dvz-contenttype-presseserviceassistent",), first="page"),),
                    (Box("div", ("content", "dvz-contenttype-pagecontent")),), ANY_P),
            stop=PORTAL_STOPS + ("kontakt", "hinweise", "anhang"), dates=("dtstart", "meta"),
            summary_markers=SKIP_MARKERS + ("kontakt",),
        ),
        Profile(
            "nrw", "https://polizei.nrw",
            (ListSpec("https://polizei.nrw/presse/pressemitteilungen/rss/all/all/all/all",
                      "https://polizei.nrw/presse/pressemitteilungen/rss/all/all/all/all?page={page}", 0, 2),),
            url_rule="slash",
            link_rules=(LinkRule((Box("div", ("view-content",)), Box("div", ("views-row",)), Box("h2", ("field-title",))),
                                 item=Box("div", ("fields-wrapper",))),
                        LinkRule((Box("h2", ("field-title",)),), item=Box("div", ("fields-wrapper",)))),
            ladder=((Box("div", ("node__content",), inside="main"),
                     Box("div", ("field",), ("body", "text"), inside="main"), Box("div", ("article",))), ANY_P),
            stop=("hinweise erbeten", "mehr zum thema", "kontakt", "impressum", "datenschutzerkl", "teilen:"),
            dates=("time_loose", "list_day"), summary_markers=SKIP_MARKERS + ("hinweise erbeten",), cap=100,
        ),
        Profile(
            "sachsen", ms,
            tuple(ListSpec(f"{ms}/medien/?search[institution_ids][]={number}&page=1",
                           f"{ms}/medien/?search[institution_ids][]={number}&page={{page}}", 1, 2, label=name)
                  for name, number in SACHSEN_DIRECTORATES.items()),
            url_rule="full", link_rules=(LinkRule(href_parts=("/medien/",)),), placeholder="(Ohne Titel)",
            exclude=("search[",), path_pattern="/medien/[^/?]+",
            ladder=((Box("article"),), (Box("div", ("content", "article", "ms-"), id_parts=("content",)),), ANY_P),
            stop=("rückfragen bitte an", "kontakt", "mehr infos", "original-?content", "druckversion", "pdf-version"),
            drop_empty=True, dates=("time_loose", "time_text", "date_class"),
        ),
        Profile(
            "sachsen-anhalt", "https://www.sachsen-anhalt.de", (ListSpec(sa, sa + SA_PAGE_QUERY, 1, 15),),
            url_rule="slash", link_rules=(LinkRule((Box("div", ("tx-rssdisplay-newslist",)), Box("h2"))),),
            title_rule="squeeze",
            ladder=((Box("div", ids=("content",)),), ANY_P),
            stop=("weiterlesen", "zur.*übersicht", "kontakt", "rückfragen", "mehr zum thema", "pdf-version", "druckversion"),
            drop_empty=True, dates=("date_box", "time_strict", "anywhere"),
        ),
        Profile(
            "schleswig-holstein", shz, (ListSpec(shz + "/lokales/blaulicht-sh"),),
            url_rule="slash",
            link_rules=(LinkRule((Box("*", ("article__teaser",), attribute="data-article-id"),), href_parts=("/artikel/",),
                                 href_not=("/video/",), title_tag="h3", title_in_box=True, one_per=0),
                        LinkRule(href_parts=("/lokales/", "/artikel/"), href_not=("/video/",))),
            placeholder="Ohne Titel", exclude=("/video/",),
            ladder=((Box("div", ("article__detail__content",)),), (Box("div", ("article-detail",)),), (Box("article"),)),
            drop_empty=True, meta_fallback=True, dates=("time_day",), fold="unicode", match_title=True,
            extra={"loads": 5},
        ),
    ]
    return {p.source: p for p in rows}


def profile_table(spark: SparkSession, profiles: dict[str, Profile] | None = None) -> DataFrame:
    """One row per list of every source, the input of the crawl frontier."""
    rows = [
        (p.source, rank, s.first_url, s.template, s.first, s.pages, s.step, s.label or None)
        for p in (profiles or default_profiles()).values()
        for rank, s in enumerate(p.lists)
    ]
    return spark.createDataFrame(
        rows,
        "source STRING, list INT, first_url STRING, template STRING, first INT, n_pages INT, step INT, directorate STRING",
    )
