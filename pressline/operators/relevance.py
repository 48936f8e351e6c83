"""Keyword relevance of article texts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.once import let
from pressline.functions.text import rx

PATTERN_CHARS = frozenset("\\.^$|?*+()[]{}")

CONTEXT_CHARS = 60
CONTEXT_BEFORE = 20


def _may_occur(text: Column, keywords: Sequence[str]) -> Column:
    """Cheap necessary condition for plain keywords: one of them is in the lower-cased text.

    Where letters fold in ASCII only, a match is always also a match of the lower-cased forms.
    """
    def any_in(lowered: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(lowered, F.lower(F.lit(k))) for k in keywords])

    return let(F.lower(text), any_in)


def first_keyword(texts: Column | Sequence[Column], keywords: Sequence[str], fold: str = "ascii") -> Column:
    """First keyword of the ordered list that occurs in one of the texts, null where none does.

    Keywords are pattern fragments. Several texts (body and title) count for one keyword before the
    next keyword is tried. Most texts hold no keyword: plain keywords are looked up as bytes first, and
    only texts that pass are searched with the patterns.
    """
    columns = [texts] if isinstance(texts, Column) else list(texts)
    if not keywords:
        return F.lit(None).cast("string")

    def hit(keyword: str) -> Column:
        found = F.coalesce(columns[0].rlike(rx(keyword, fold)), F.lit(False))
        for other in columns[1:]:
            found = found | F.coalesce(other.rlike(rx(keyword, fold)), F.lit(False))
        return found

    first = F.coalesce(*[F.when(hit(k), F.lit(k)) for k in keywords])
    plain = fold == "ascii" and len(columns) == 1 and not any(c in PATTERN_CHARS for k in keywords for c in k)
    return F.when(_may_occur(columns[0], keywords), first) if plain else first


def keyword_context(text: Column, keyword: Column) -> Column:
    """Text around the first literal occurrence of the keyword, null where it does not occur."""
    at = F.position(F.lower(keyword), F.lower(text))
    start = F.greatest(at - 1 - CONTEXT_BEFORE, F.lit(0)) + 1
    return F.when(at > 0, F.substring(text, start, F.lit(CONTEXT_CHARS)))
