"""Article text: paragraph arrays to content text and summary. No operator here shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.once import let, non_empty
from pressline.functions.text import rx, squeeze, trimmed

SUMMARY_MIN_CHARS = 80
SUMMARY_MAX_CHARS = 300

# Starts of lines a summary skips.
SKIP_MARKERS = (
    "mehr themen", r"\d{2}\.\d{2}\.\d{4}", "rückfragen bitte an", "kreispolizeibehörde",
    "original-content", "pdf-version", "druckversion",
)

SCRIPTS_AND_COMMENTS = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"

# Named entities of plain pages, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def line_start(markers: Sequence[str]) -> str:
    """Pattern of lines that start with one of the markers, ASCII letter case ignored."""
    return rx("^(?:" + "|".join(markers) + ")", "ascii")


def plain_text(markup: Column) -> Column:
    """Text of an HTML fragment: tags removed, common entities decoded."""
    text = F.regexp_replace(markup, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def article_block(html: Column) -> Column:
    """Inner HTML of the first ``article`` element, the whole page where there is none."""
    def block(page: Column) -> Column:
        inner = F.regexp_extract(page, r"(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)", 1)
        return F.coalesce(non_empty(inner), page)

    return let(F.regexp_replace(html, SCRIPTS_AND_COMMENTS, ""), block)


def native_paragraphs(html: Column) -> Column:
    """Paragraphs of a plain page, all in the JVM: a new ``<p>`` closes the open one."""
    pieces = F.split(article_block(html), r"(?i)<p(?:>|[\s/][^>]*>)")
    inner = let(pieces, lambda all_: F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0))))
    return F.transform(inner, lambda p: plain_text(F.regexp_replace(p, r"(?is)</p\s*>.*$", "")))


def heading(html: Column) -> Column:
    """Squeezed text of the first ``h1``: empty for an empty heading, null where there is none."""
    block = F.regexp_extract(F.regexp_replace(html, SCRIPTS_AND_COMMENTS, ""), r"(?is)<h1\b[^>]*>.*?</h1\s*>", 0)
    return squeeze(plain_text(non_empty(block)))


def heading_title(h1: Column, list_title: Column) -> Column:
    """Heading of the article page, else the title of the list; an empty heading still counts."""
    return F.coalesce(h1, list_title)


def clean_lines(lines: Column, drop_empty: bool = False) -> Column:
    """Trimmed lines; ``drop_empty`` removes the empty ones, otherwise they stay as blank lines."""
    kept = F.transform(lines, trimmed)
    return F.filter(kept, lambda x: x != "") if drop_empty else kept


def take_until(lines: Column, pattern: str | None) -> Column:
    """Lines before the first one that matches the pattern."""
    if not pattern:
        return lines
    def cut(all_: Column) -> Column:
        hit = F.array_position(F.transform(all_, lambda x: x.rlike(pattern)), True)
        return let(hit, lambda n: F.slice(all_, F.lit(1), F.when(n > 0, n - 1).otherwise(F.size(all_)).cast("int")))

    return let(lines, cut)


def drop_lines(lines: Column, pattern: str | None) -> Column:
    """Lines that do not match the pattern."""
    return F.filter(lines, lambda x: ~x.rlike(pattern)) if pattern else lines


def content_text(lines: Column) -> Column:
    """All lines, each closed by a newline."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")


def summary(lines: Column, markers: Sequence[str] = SKIP_MARKERS, ellipsis: bool = True) -> Column:
    """Start of the first long line that carries no skip marker, empty text where there is none."""
    skip = line_start(markers) if markers else None

    def usable(x: Column) -> Column:
        long_enough = F.length(x) > SUMMARY_MIN_CHARS
        return long_enough & ~x.rlike(skip) if skip else long_enough

    def shown(line: Column) -> Column:
        cut = F.substring(line, 1, SUMMARY_MAX_CHARS)
        if not ellipsis:
            return cut
        return F.when(F.length(line) > SUMMARY_MAX_CHARS, F.concat(cut, F.lit("..."))).otherwise(cut)

    line = F.get(F.filter(F.transform(lines, trimmed), usable), F.lit(0))
    return F.coalesce(let(line, shown), F.lit(""))


def fallback_summary(text: Column) -> Column:
    """Summary of an article that has only its meta description."""
    return F.substring(text, 1, SUMMARY_MAX_CHARS)


def meta_description(html: Column) -> Column:
    """``description`` of the page head, else its ``og:description``; null where both are missing."""
    def content(attribute: str, name: str) -> Column:
        tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\b{attribute}\s*=\s*["']{name}["'][^>]*>""", 0)
        quoted = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*')""", 1)
        return trimmed(plain_text(let(non_empty(quoted), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))))

    return F.coalesce(content("name", "description"), content("property", "og:description"))
