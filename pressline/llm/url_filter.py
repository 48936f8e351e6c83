"""URL filters with redirect equivalence; DataFrame functions only.

Rules decide a URL by its host and path. URLs that redirect to each other or name each other canonical are aliases: a
distributed connected-components job groups them, and a URL without a rule takes the decision of its group. An allow rule
anywhere in the group goes before a block rule.

Only URLs with an edge take part in the graph; the page table itself is joined with the few decided aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.once import computed_once, let
from pressline.llm.components import components
from pressline.llm.frames import free_name, stored

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]
# Rules are literals of the plan; a longer list belongs in a table joined by host.
MOST_RULES = 5000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null.

    A rule ``(verdict, host, path)`` fits its host and all subdomains if the path starts with the rule's. Length is that of
    host and path together; of two equal rules allow wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are literals of a plan")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0] != ALLOW))
    listed = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("verdict", "host", "path"), strict=True)]) for r in order])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(F.concat(first["host"], first["path"]).alias("rule"), first["verdict"].alias("verdict")))


def resolved(target: Column, base: Column) -> Column:
    """An absolute URL without fragment from a link and the URL of its page; null for an empty link or another scheme."""
    trimmed = F.regexp_replace(F.btrim(target, F.lit(" \t\r\n\f")), "#.*$", "")
    scheme, root = F.regexp_extract(base, r"^([^:/?#]+:)//", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    clean = F.regexp_replace(base, "[?#].*$", "")
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*/(?:[^?#]*/)?)", 1)

    def absolute(link: Column) -> Column:
        return (
            F.when(link == "", F.lit(None))
            .when(link.rlike(r"(?i)^https?://"), link)
            .when((root == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(link.startswith("?"), F.concat(clean, link))
            .otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(root, F.lit("/"))), link))
        )

    return let(trimmed, absolute)


def node_of(url: Column) -> Column:
    """The name of a URL among aliases: without fragment, scheme and host lower-cased, an empty path as ``/``."""
    head = lower_ascii(F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^(?:[^:/?#]+://[^/?#]*)?([^#]*)", 1)
    return F.concat(head, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in the text of a tag, with the usual reference of URLs decoded; null if absent or empty."""
    given = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.nullif(F.replace(F.btrim(given, F.lit("\"'")), F.lit("&amp;"), F.lit("&")), F.lit(""))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)`` node names from the canonical links and refresh redirects in the pages' html; comments and scripts are skipped."""
    html = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", " ")
    tags = pages.where(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", F.explode(
        F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    ).alias("tag"))
    tag = F.col("tag")
    kinds = computed_once(tags, {
        "rel": F.lower(_attribute(tag, "rel")), "href": _attribute(tag, "href"),
        "equiv": F.lower(_attribute(tag, "http-equiv")), "content": _attribute(tag, "content"),
    })
    refresh = F.regexp_extract("content", r"""(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?["']?([^"']+)""", 1)
    link = F.when(tag.rlike("(?i)^<link") & F.col("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href")).when(
        tag.rlike("(?i)^<meta") & (F.col("equiv") == "refresh"), refresh
    )
    linked = computed_once(kinds.select("url", link.alias("link")).where("link <> ''"), {"target": resolved(F.col("link"), F.col("url"))})
    return linked.where("target IS NOT NULL").select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))


def alias_decisions(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(node, verdict)`` for the nodes of groups in which a rule fits some node: allow before block."""
    groups = stored(components(edges), "url-groups")
    own = matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    best = groups.select("root", own.alias("verdict")).groupBy("root").agg(F.min("verdict").alias("verdict"))
    return groups.join(best.where("verdict IS NOT NULL"), "root").select("node", "verdict")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = ALLOW) -> DataFrame:
    """All columns of ``pages(url, html, ...)`` and a struct ``url_verdict(host, path, rule, verdict)``.

    ``redirects(source, target)`` are further alias edges, absolute URLs. A URL's own longest rule decides it; without one
    the rules of its aliases do, allow before block; without those ``default``. A null URL, or one without ``://``, has empty
    host and path, no rule and the default. Null html has no edges. Repeated rows keep one row each; an empty table gives
    an empty table.
    """
    edges = alias_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    decided = alias_decisions(edges, rules).select(F.col("node").alias("alias_node"), F.col("verdict").alias("alias_verdict"))
    kept, name = [f"`{c}`" for c in pages.columns], free_name(pages, "url_verdict")
    made = {n: free_name(pages, n) for n in ("url_host", "url_path", "url_own", "url_node")}
    judged = computed_once(pages, {made["url_host"]: host_of(F.col("url")), made["url_path"]: path_of(F.col("url"))})
    host, path = F.col(made["url_host"]), F.col(made["url_path"])
    judged = computed_once(judged, {made["url_own"]: matching_rule(host, path, rules), made["url_node"]: node_of(F.col("url"))})
    own = F.col(made["url_own"])
    joined = judged.join(decided, judged[made["url_node"]] == decided["alias_node"], "left")
    verdict = F.coalesce(own["verdict"], decided["alias_verdict"], F.lit(default))
    return joined.select(*[judged[c] for c in kept], F.struct(
        host.alias("host"), path.alias("path"), own["rule"].alias("rule"), verdict.alias("verdict")
    ).alias(name))
