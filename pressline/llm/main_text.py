"""Main text of web pages by composite text density.

For every node of a page: characters per tag, lowered where they stand in links. A node's density sum is that of its
children; the subtree with the largest sum is the core of the text. The smallest density on the path from it to the body
is the threshold: other subtrees that reach it give their own largest-sum subtree, and so on inside them. An article element
that holds a chosen subtree is taken whole. What names itself a menu, header, footer, sidebar, notice, advert, form or reader
comment has no characters in these sums and none in the text; on a page without an article, names of layout (sidebar, widget,
notice and so on) give way where what they hold has a clearly larger density sum than all the rest.

One page is read in one pass, linear in its length; pages are rows, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field, replace
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from pressline.llm.frames import by_batch, free_name, plus, texts

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption dd dt html body li tbody td tfoot th thead tr summary".split()) | {"li", "dd", "dt"}
CLOSES = {
    "li": ("li", frozenset(("ul", "ol", "menu"))), "dd": ("dd dt", frozenset(("dl",))), "dt": ("dd dt", frozenset(("dl",))),
    "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table"))),
    "option": ("option", frozenset(("select",))),
}
# What is never main text, by element, role and name.
NEVER = frozenset("nav footer aside button select option input menu head audio video map".split())
# Never but around the article; forms not around the largest density sum either.
FORMS = ("form", "fieldset")
WRAPS = (*FORMS, "dialog", "label")
ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert menu menubar toolbar banner form".split())
NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription sidebar rail menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager comment comments respond discussion disqus share sharing social related "
    "recommended recommendations footer login signup toolbar widget skip"
).split()
HEADERS = ("header", "masthead", "topbar")
# Names that layouts, themes and page builders also give to what holds the main text.
LAYOUTS = (
    "sponsor promo promotion banner notice notices notification popup modal overlay sidebar rail social related recommended recommendations "
    "widget toolbar"
).split()
LAYOUT_ROLES = frozenset("complementary dialog alertdialog alert form banner".split())
# A sum this many times that of the rest outweighs such a name.
OUTWEIGHS = 2.0
_NAMED = re.compile(rf"(?:^|[-_ ])(?:{'|'.join(NAMES)})(?:$|[-_ ])")
_HEADED = re.compile(rf"(?:^|[-_ ])(?:{'|'.join(HEADERS)})(?:$|[-_ ])")
_FIXED_NAMES = re.compile(rf"(?:^|[-_ ])(?:{'|'.join(sorted(set(NAMES) - set(LAYOUTS)))})(?:$|[-_ ])")
# What WordPress adds to an article for its topics says nothing about what the element is.
_TOPIC = re.compile(r"^(?:category|tag|post_tag)-")
_LAYOUT = re.compile(r"^(?:has|no|with|without|is|hide|show)[-_]|[-_](?:layout|wrapper|page|content|main)$")

# A quote opens a value only after "="; one that is not closed is a plain character.
_PART = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*)({_PART}*+)>")
_OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_NEXT_PART = re.compile(_PART)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


@dataclass
class Page:
    """Nodes in page order (0 is the root), and what stands in them: text, or None for the edge of a block."""

    name: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    dropped: list[int] = field(default_factory=lambda: [0])
    content: list[tuple[int, str | None]] = field(default_factory=list)
    inside_article: list[bool] = field(default_factory=lambda: [False])
    layout: list[int] = field(default_factory=list)


# How a node is dropped: never, with all below it, unless the article stands below it, or unless that or the core does.
KEPT, GONE, UNLESS_ARTICLE, UNLESS_CORE = 0, 1, 2, 3


def _drop(name: str, attributes: str, in_article: bool) -> int:
    if name in NEVER:
        return GONE
    if name in ("html", "body", "main"):
        return KEPT
    if name == "header":
        return KEPT if in_article else UNLESS_ARTICLE
    plain = KEPT if name not in WRAPS else UNLESS_CORE if name in FORMS else UNLESS_ARTICLE
    if not attributes:
        return plain
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            if name == "article":
                continue
            return GONE
        if key == "itemprop" and value == "comment":
            return UNLESS_ARTICLE
        if key == "role" and value in ROLES and not (in_article and value == "banner" or name == value == "form"):
            return UNLESS_ARTICLE
        if key in ("class", "id"):
            for one in value.split():
                if name == "article" and _TOPIC.search(one):
                    continue
                if not _LAYOUT.search(one) and (_NAMED.search(one) or not in_article and _HEADED.search(one)):
                    return UNLESS_ARTICLE
    return plain


def _is_layout(name: str, attributes: str) -> bool:
    """Whether only names of layout drop this element, so that its text may outweigh them."""
    if name in ("header", "article"):
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or "").strip("\"'").lower()
        if key == "itemprop" and value == "comment" or key == "role" and value in ROLES - LAYOUT_ROLES:
            return False
        if key in ("class", "id"):
            for one in value.split():
                if not _LAYOUT.search(one) and (_FIXED_NAMES.search(one) or _HEADED.search(one)):
                    return False
    return True


def _tag_end(text: str, at: int, endless: set[int]) -> int:
    """The ">" of the tag whose attributes begin at ``at``; the next one at all if quotes hide it, -1 if there is none.

    ``endless`` keeps from where no end was found, so that a page is not read to its end again for each such tag.
    """
    seen, first = [], at
    while at not in endless:
        if text[at : at + 1] == ">":
            return at
        seen.append(at)
        part = _NEXT_PART.match(text, at)
        if part is None:
            break
        at = part.end()
    endless.update(seen)
    return text.find(">", first)


def parse(text: str) -> Page:
    """Reads a page once. End tags that close nothing are passed over; an unclosed comment or script takes the rest.

    A tag that does not close because of its quotes ends at the next ">"; without one it takes the rest.
    """
    page, stack, open_ = Page(), [0], {}
    endless: set[int] = set()
    content = page.content

    def close(depth: int) -> None:
        while len(stack) > depth:
            name = page.name[stack.pop()]
            open_[name] -= 1
            if name in BLOCK:
                content.append((stack[-1], None))

    def close_open(names: str, limit: frozenset) -> None:
        if not any(open_.get(n) for n in names.split()):
            return
        wanted = names.split()
        for depth in range(len(stack) - 1, 0, -1):
            name = page.name[stack[depth]]
            if name in wanted:
                close(depth)
                return
            if name in limit:
                return

    at, size = 0, len(text)
    while at < size:
        lower = text.find("<", at)
        if lower < 0:
            lower = size
        if lower > at:
            content.append((stack[-1], text[at:lower]))
        if lower == size:
            break
        if text.startswith("<!--", lower):
            end = text.find("-->", lower + 4)
            at = size if end < 0 else end + 3
            continue
        follows = text[lower + 1 : lower + 2]
        if follows in ("!", "?") and follows:
            end = text.find(">", lower)
            at = size if end < 0 else end + 1
            continue
        tag = None if endless else _TAG.match(text, lower)
        at, attributes = (tag.end(), tag[3]) if tag else (lower + 1, "")
        if tag is None:
            tag = _OPEN_TAG.match(text, lower)
            if tag is None:
                content.append((stack[-1], "<"))
                continue
            end = _tag_end(text, tag.end(), endless)
            if end < 0:
                break
            at, attributes = end + 1, text[tag.end() : end]
        name = tag[2].lower()
        if tag[1]:
            if open_.get(name):
                depth = len(stack) - 1
                while page.name[stack[depth]] != name:
                    depth -= 1
                close(depth)
            elif name in BLOCK or name == "br":
                content.append((stack[-1], None if name in BLOCK else " "))
            continue
        if name == "svg" and attributes.endswith("/"):
            continue
        if name in RAW:
            end = _ENDS[name].search(text, at)
            at = end.end() if end else size
            continue
        if name == "br":
            content.append((stack[-1], " "))
        if name in CLOSES_P and open_.get("p"):
            close_open("p", frozenset(("button", "table", "td", "th")))
        if name in CLOSES:
            close_open(*CLOSES[name])
        if name in BLOCK:
            content.append((stack[-1], None))
        node, above = len(page.name), stack[-1]
        page.name.append(name)
        page.parent.append(above)
        inside = page.inside_article[above] or name in ("article", "main")
        page.inside_article.append(inside)
        page.dropped.append(_drop(name, attributes, page.inside_article[above]))
        if page.dropped[node] == UNLESS_ARTICLE and _is_layout(name, attributes):
            page.layout.append(node)
        if name not in VOID and not attributes.endswith("/") or name in BLOCK - VOID:
            stack.append(node)
            open_[name] = open_.get(name, 0) + 1
    return page


def _below(page: Page, dropped: list[bool]) -> list[bool]:
    """Whether a node or one above it is dropped."""
    gone = [False] * len(dropped)
    for node in range(1, len(dropped)):
        gone[node] = dropped[node] or gone[page.parent[node]]
    return gone


def _above(page: Page, node: int) -> set[int]:
    """A node and all that hold it."""
    found = set()
    while node >= 0:
        found.add(node)
        node = page.parent[node]
    return found


def _article(page: Page) -> int:
    """The article or main element with the largest density sum in it; 0 if there is none.

    An article that names itself something else counts only where no other is. What such names hold counts for an article in
    it, not for a main element around it.
    """
    n, how = len(page.name), page.dropped
    named = [how[node] == UNLESS_ARTICLE for node in range(n)]
    other = [named[node] and page.name[node] == "article" for node in range(n)]
    gone = _below(page, [how[node] == GONE or other[node] for node in range(n)])
    articles = [node for node in range(n) if page.name[node] == "article" and not gone[node]]
    mains = [node for node in range(n) if page.name[node] == "main" and not gone[node]]
    if not articles:
        gone = _below(page, [how[node] == GONE for node in range(n)])
        articles = [node for node in range(n) if page.name[node] == "article" and not gone[node]]
    found, most = 0, -1.0
    if articles:
        _, sums, best = _sums(page, gone)
        found = max(articles, key=lambda node: sums[best[node]])
        most = sums[best[found]]
    if mains:
        _, sums, best = _sums(page, _below(page, [how[node] == GONE or named[node] and page.inside_article[page.parent[node]] for node in range(n)]))
        main = max(mains, key=lambda node: sums[best[node]])
        if sums[best[main]] > most:
            found = main
    return found


def _gone(page: Page) -> list[bool]:
    """Whether a node is no main text: it or one above it is dropped and does not hold the article, nor, as a form, the core."""
    gone = _below(page, [how != KEPT for how in page.dropped])
    wrapped = any(gone[node] and name in ("article", "main") for node, name in enumerate(page.name))
    if not wrapped and UNLESS_CORE not in page.dropped:
        return gone
    holds = _above(page, _article(page)) if wrapped else set()
    if UNLESS_CORE in page.dropped:
        # What holds both the form and other text has both in its sum, so the form is also held against the page without forms.
        forms = [node for node, how in enumerate(page.dropped) if how == UNLESS_CORE]
        _, sums, best = _sums(page, _below(page, [
            how == GONE or how == UNLESS_ARTICLE and node not in holds for node, how in enumerate(page.dropped)]))
        _, rest, elsewhere = _sums(page, _below(page, [
            how == GONE or how != KEPT and node not in holds for node, how in enumerate(page.dropped)]))
        in_form = best[max(forms, key=lambda node: sums[best[node]])]
        core = in_form if sums[in_form] > rest[elsewhere[0]] else best[0]
        holds |= _above(page, core).intersection(forms)
    return _below(page, [how == GONE or how != KEPT and node not in holds for node, how in enumerate(page.dropped)])


def _outweighing(page: Page, gone: list[bool]) -> set[int]:
    """Nodes of layout that stay after all, with what holds them: those around the text with the largest density sum of the page.

    Each element with a name is weighed by what stands in it but not in another one, without what is no main text by its kind.
    Where an article or main element is left, or the rest of the page weighs enough, none stays.
    """
    if not page.layout or any(not gone[node] and name in ("article", "main") for node, name in enumerate(page.name)):
        return set()
    n = len(page.name)
    apart = list(page.parent)
    for node in range(1, n):
        if page.dropped[node] == UNLESS_ARTICLE:
            apart[node] = n
    split = replace(page, name=[*page.name, ""], parent=[*apart, 0])
    _, sums, best = _sums(split, [*_below(page, [how == GONE for how in page.dropped]), False])
    _, rest, elsewhere = _sums(page, gone)
    heaviest = max(page.layout, key=lambda node: sums[best[node]])
    above = _above(page, heaviest)
    fixed = any(page.dropped[node] == GONE or page.dropped[node] == UNLESS_ARTICLE and node not in page.layout for node in above)
    return set() if fixed or sums[best[heaviest]] <= OUTWEIGHS * rest[elsewhere[0]] else above


def densities(page: Page, gone: list[bool]) -> list[float]:
    """Composite text density of every node: characters per tag, lowered by the links' share of characters and tags."""
    n = len(page.name)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for node in range(1, n):
        in_link[node] = in_link[page.parent[node]] or page.name[node] == "a"
    for node, text in page.content:
        if text is not None and not gone[node]:
            size = len(" ".join(text.split()))
            chars[node] += size
            link_chars[node] += size * in_link[node]
    for node in range(n - 1, 0, -1):
        above = page.parent[node]
        if gone[node]:
            continue
        chars[above] += chars[node]
        link_chars[above] += link_chars[node]
        tags[above] += tags[node] + 1
        link_tags[above] += link_tags[node] + (page.name[node] == "a")
    body = next((i for i, name in enumerate(page.name) if name == "body"), 0)
    share = link_chars[body] / max(chars[body], 1)
    found = [0.0] * n
    for node in range(n):
        c, lc, t, lt = chars[node], link_chars[node], max(tags[node], 1), max(link_tags[node], 1)
        if c:
            base = log(c / max(c - lc, 1) * lc + share * c + e)
            found[node] = c / t * (log(c / max(lc, 1) * t / lt + 1) / log(base + 1))
    return found


def _sums(page: Page, gone: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """Densities, density sums, and the node with the largest sum in the subtree of every node."""
    n = len(page.name)
    density = densities(page, gone)
    sums, best = [0.0] * n, list(range(n))
    for node in range(1, n):
        sums[page.parent[node]] += density[node]
    # A leaf has no children to sum; its own density stands for them.
    has_child = [False] * n
    for node in range(1, n):
        has_child[page.parent[node]] = True
    for node in range(n):
        if not has_child[node]:
            sums[node] = density[node]
    for node in range(n - 1, 0, -1):
        above = page.parent[node]
        if sums[best[node]] > sums[best[above]]:
            best[above] = best[node]
    return density, sums, best


def chosen(page: Page, gone: list[bool]) -> list[bool]:
    """Whether a node is in the main text."""
    n = len(page.name)
    density, _, best = _sums(page, gone)
    core = best[0]
    threshold, at = density[core], page.parent[core]
    while at > 0:
        threshold = min(threshold, density[at])
        at = page.parent[at]
    # A hint only: what is chosen inside an article takes the rest of that article along. A main element decides nothing.
    article, children = [-1] * n, [[] for _ in range(n)]
    for node in range(1, n):
        above = page.parent[node]
        children[above].append(node)
        article[node] = article[above] if article[above] >= 0 or page.name[node] != "article" else node
    roots, tops = set(), [0]
    while tops:
        top = tops.pop()
        at, below = best[top], -1
        roots.add(article[at] if article[at] >= 0 else at)
        while at != top:
            at, below = page.parent[at], at
            tops += [node for node in children[at] if node != below and density[node] >= threshold > 0]
    first = next((i for i, name in enumerate(page.name) if name == "h1" and not gone[i]), None)
    if first is not None and first < min(roots):
        roots.add(first)
    inside = [False] * n
    for node in range(n):
        inside[node] = (node in roots or node > 0 and inside[page.parent[node]]) and not gone[node]
    return inside


def main_text(text: str | None) -> str:
    """The main text of a page: blocks in page order, one per line; empty if there is none."""
    if not text:
        return ""
    page = parse(text)
    gone = _gone(page)
    if stays := _outweighing(page, gone):
        page.dropped = [KEPT if node in stays else how for node, how in enumerate(page.dropped)]
        gone = _gone(page)
    inside = chosen(page, gone)
    blocks, parts = [], []
    for node, part in [*page.content, (0, None)]:
        if part is not None:
            if inside[node]:
                parts.append(html.unescape(part))
        elif parts:
            block = " ".join("".join(parts).split())
            if block:
                blocks.append(block)
            parts = []
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """All columns of ``pages(html, ...)`` but the html, and ``main_text``.

    A null or empty page, or one without main text, gives an empty text. Character references are decoded, white space within
    a block is one space, blocks are joined by one line end. Repeated rows keep one row each; an empty table gives an empty
    table.
    """
    name, place = free_name(pages, "main_text"), pages.columns.index("html")

    @by_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rest = [i for i in range(batch.num_columns) if i != place]
        made = pa.array([main_text(t) for t in texts(batch.column(place))], pa.string())
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], made], [*[batch.schema.names[i] for i in rest], name])

    return pages.mapInArrow(run, plus(pages.drop("html"), (name, StringType())))
