"""Secret scan: candidates by pattern, judged by how many owners hold the same value.

Everything is column functions and joins. Patterns find candidates text by text; the hash of each value is counted over
distinct repositories and owners of the whole corpus. A value that many owners hold is a copied example (documentation, test
keys); one that a single owner holds looks live. Candidates of the base patterns are always reported, those of the wider
patterns only where they look live. Only hashes of values leave the scan.

A match's place is the sum of the lengths of the pieces and matches before it: splitting a text by the same pattern gives the
pieces. Sums run over the matches of one row, never over a source or a value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from pressline.functions.once import let
from pressline.llm.frames import stored

# A value held by at least so many owners is a copied example.
COPIED_OWNERS = 3


@dataclass(frozen=True)
class Kind:
    """A pattern of candidates. ``value`` is the group of the secret itself, ``least`` its least length; a match with a shorter one
    is dropped but has used up its characters. ``digits`` and ``varied``: least number of digits and of different characters."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    base: bool = True
    digits: int = 0
    varied: int = 0


def _either_case(words: str) -> str:
    """The pattern with a class of both cases for each letter, so that no engine's own folding matters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Fixed patterns of the base kinds, then the wider ones: prefixes of token issuers, web tokens, long runs with many digits.
ASSIGN = rf"""({_either_case("password|passwd|secret|token|api_?key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    Kind("assign", ASSIGN, 2, 6),
    Kind("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", "[0-9a-f]{24,}", 0, 24),
    Kind("issued", "(gh[pousr]_|glpat-|xox[abprs]-|[sr]k_live_|AIza|npm_)[A-Za-z0-9_-]{16,}", 0, 20, False),
    Kind("web", r"eyJ[A-Za-z0-9_-]{8,500}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, False),
    Kind("mixed", "[A-Za-z0-9_-]{24,}", 0, 24, False, digits=4, varied=10),
)
WIDER = [i for i, kind in enumerate(KINDS) if not kind.base]


def _is_candidate(kind: Kind, value: Column) -> Column:
    rules = [F.length(value) >= kind.least]
    if kind.digits:
        rules.append(F.length(F.regexp_replace(value, "[^0-9]", "")) >= kind.digits)
    if kind.varied:
        rules.append(F.size(F.array_distinct(F.split(value, ""))) >= kind.varied)
    wanted = rules[0]
    for rule in rules[1:]:
        wanted = wanted & rule
    return wanted


def _matches(text: Column, kind: Kind) -> Column:
    """Matches of one kind, in order, as ``array<struct<kind, at, step, size, wanted, value_hash>>``: ``step`` is the length of the
    match and the piece before it. Texts without a match are searched once."""
    pattern = F.lit(kind.pattern)

    def rows(found: Column) -> Column:
        values = F.regexp_extract_all(text, pattern, F.lit(kind.value)) if kind.value else found
        pieces = F.slice(F.split(text, kind.pattern, -1), 1, F.size(found))
        zipped = F.arrays_zip(found.alias("said"), values.alias("value"), pieces.alias("piece"))
        return F.transform(zipped, lambda z, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("at"), (F.length(z["piece"]) + F.length(z["said"])).alias("step"),
            F.length(z["said"]).alias("size"), _is_candidate(kind, z["value"]).alias("wanted"),
            F.sha2(z["value"], 256).alias("value_hash"),
        ))

    none = F.array().cast("array<struct<kind: int, at: int, step: int, size: int, wanted: boolean, value_hash: string>>")
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, rows(m)).otherwise(none))


def matches(text: Column) -> Column:
    """The matches of all kinds in a text; none in null."""
    return F.concat(*[_matches(F.coalesce(text, F.lit("")), kind) for kind in KINDS])


def candidates(marked: DataFrame) -> DataFrame:
    """``(row, repository, owner, kind, start, end, value_hash)`` from ``marked(row, repository, owner, m)``.

    Places are in code points, ends exclusive. A match of a wider kind that overlaps one of a kind listed before it is left out.
    """
    each = marked.select("row", "repository", "owner", F.explode("m").alias("m")).select("row", "repository", "owner", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.repartition("row").withColumn("end", F.sum("step").over(so_far)).where("wanted")
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    order = Window.partitionBy("row").orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    hidden = F.lit(False)
    for kind in WIDER:
        lower = F.col("kind") < kind
        reaches = F.max(F.when(lower, F.col("end"))).over(before) > F.col("start")
        reached = F.min(F.when(lower, F.col("start"))).over(after) < F.col("end")
        hidden = F.when(F.col("kind") == kind, F.coalesce(reaches, F.lit(False)) | F.coalesce(reached, F.lit(False))).otherwise(hidden)
    kept = placed.withColumn("hidden", hidden).where("NOT hidden")
    return kept.select("row", "repository", "owner", "kind", "start", "end", "value_hash")


def ownership(found: DataFrame) -> DataFrame:
    """``(value_hash, n_repositories, n_owners)`` from ``found(value_hash, repository, owner)``; null is an owner like any other.
    Repeats within a repository fall together before anything is counted per value."""
    repositories = found.select("value_hash", "owner", "repository", F.lit(1).alias("of")).distinct()
    owners = repositories.select("value_hash", "owner", F.lit(None).cast("string").alias("repository"), F.lit(0).alias("of"))
    return repositories.unionByName(owners.distinct()).groupBy("value_hash").agg(
        F.sum("of").alias("n_repositories"), F.sum(1 - F.col("of")).alias("n_owners")
    )


def scan(docs: DataFrame, repository: Column, owner: Column, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """``(doc_id, spans)`` for each row of ``docs(doc_id, text, ...)``.

    ``spans`` is an array of ``struct<start, kind, end, n_repositories, n_owners, verdict>`` by start and kind (a place in ``KINDS``): all base
    candidates, and those of wider kinds that look live. The verdict is ``copied`` where at least ``copied_owners`` owners hold the
    value, ``live`` where one does, else ``shared``. ``repository`` and ``owner`` are columns of ``docs``. Null and empty texts have no spans;
    a null repository or owner is one like any other. Repeated rows and ids are scanned each. Other columns are not read. An
    empty table gives an empty table.
    """
    # Rows are numbered as they are scanned and written once, so the numbers hold for all that follows.
    marked = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), repository.cast("string").alias("repository"),
        owner.cast("string").alias("owner"), matches(F.col("text")).alias("m"),
    ), "secret-matches")
    found = stored(candidates(marked), "secret-candidates")
    verdict = F.when(F.col("n_owners") >= copied_owners, "copied").when(F.col("n_owners") == 1, "live").otherwise("shared")
    judged = found.join(ownership(found).withColumn("verdict", verdict), "value_hash")
    judged = judged.where(~F.col("kind").isin(WIDER) | (F.col("verdict") == "live"))
    span = F.struct("start", "kind", "end", "n_repositories", "n_owners", "verdict")
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return marked.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def of_kind(spans: Column, name: str) -> Column:
    """The number of spans of one kind."""
    number = [kind.name for kind in KINDS].index(name)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: ~s["kind"].isin(WIDER))


def with_verdict(spans: Column, verdict: str) -> Column:
    """The number of spans with one verdict."""
    return F.size(F.filter(spans, lambda s: s["verdict"] == verdict)).cast("long")
