"""Chat formatting in budgeted windows; DataFrame functions only.

The prefix sum of a conversation's turn tokens says in which stretch of the budget a turn starts; the turns of a stretch are a
window, so spans end between turns. Each window begins with the conversation's system turn and with the last turns before
it, as far as the history budget reaches. Only turns in their own window are under the loss mask; repeated ones never are.

Prefix sums are taken in two steps, within runs of turn numbers and over the runs, so that no task needs all turns of a very
long conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.functions.once import computed_once
from pressline.llm.frames import narrow

# The template's marks, and marks of common templates that are escaped too.
TURN, AGAIN, TEXT, END = "<|turn|>", "<|again|>", "<|text|>", "<|end|>\n"
_CONTROL = r"(<)(?=\||/?s>|</?SYS>>)|(\[)(?=/?INST\])"

STRETCH = 1024
HISTORY = 256
# Turn numbers of one run of the prefix sums.
RUN = 4096
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"


def escaped(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of each control string, which ends every such string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1$2\\\\")


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``: a single backslash there is an added one, all others come in pairs."""
    return F.replace(F.regexp_replace(text, r"([<\[])\\(?!\\)", "$1"), F.lit("\\\\"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """An estimate of a turn's tokens: four for its marks and one for each four bytes of its text."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


def _placed(turns: DataFrame) -> DataFrame:
    """``(conv, idx, at, tokens, role, text)``: place in the conversation, and tokens before the turn.

    ``conv`` is a struct around the id, in which null equals null.
    """
    cleaned = narrow(turns, "conv_id", "turn", "role", "text").select(
        F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"tokens": turn_tokens(F.col("text")), "run": F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / RUN)})
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    within = Window.partitionBy("conv", "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = cleaned.groupBy("conv", "run").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("conv", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                          F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    inside = cleaned.select("*", F.count("*").over(within).alias("n1"), F.sum("tokens").over(within).alias("t1"))
    return inside.join(offsets, ["conv", "run"]).select(
        "conv", (F.col("n0") + F.col("n1") - 1).alias("idx"), (F.col("t0") + F.col("t1") - F.col("tokens")).alias("at"),
        "tokens", "role", "text",
    )


def windows(turns: DataFrame, stretch: int = STRETCH, history: int = HISTORY) -> DataFrame:
    """``(conv_id, window, formatted, loss)`` for the windows of ``turns(conv_id, turn, role, text, ...)``.

    ``formatted``: the turns in the template, repeated ones (system turn, history) first and marked as such. ``loss``: spans of
    code points (from 0, without the end) under the loss mask, the escaped texts of the assistant's turns in their own window.
    A window holds the turns that start within ``stretch`` tokens, so only its last turn can reach beyond; no turn is cut.

    Turns are ordered by number, then role and text; null numbers come first. A null role or text is empty; rows with a null
    ``conv_id`` are one conversation. Repeated rows are turns of their own; an empty table gives no windows.
    """
    placed = _placed(turns).withColumn("window", F.floor(F.col("at") / stretch))
    starts = placed.groupBy("conv", "window").agg(F.min("at").alias("start"))
    order = Window.partitionBy("conv").orderBy("window")
    following = starts.select("conv", "window", F.lead("window").over(order).alias("next"), F.lead("start").over(order).alias("next_start"))
    is_system = (F.col("idx") == 0) & (F.col("role") == SYSTEM_ROLE)
    reaches = F.col("next").isNotNull() & (F.col("next_start") - F.col("at") <= history) & ~is_system
    used = F.when(reaches, F.array(
        F.struct(F.col("window"), F.lit(False).alias("again")), F.struct(F.col("next").alias("window"), F.lit(True).alias("again"))
    )).otherwise(F.array(F.struct(F.col("window"), F.lit(False).alias("again"))))
    shown = placed.join(following, ["conv", "window"]).select("conv", F.inline(used), "idx", "role", "text")
    turn = F.struct("idx", "again", escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"),
                    (~F.col("again") & (F.col("role") == TARGET_ROLE)).alias("target"))
    grouped = shown.groupBy("conv", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = placed.where(is_system).select("conv", F.col("window").alias("own"), F.struct(
        "idx", F.lit(True).alias("again"), escaped(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"),
        F.lit(False).alias("target"),
    ).alias("system"))
    led = grouped.join(first, "conv", "left").select("conv", "window", F.when(
        F.col("system").isNotNull() & (F.col("window") > F.col("own")), F.concat(F.array("system"), "turns")
    ).otherwise(F.col("turns")).alias("turns"))
    return _formatted(led)


def _formatted(led: DataFrame) -> DataFrame:
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.when(t["again"], AGAIN).otherwise(TURN), t["role"], F.lit(TEXT)).alias("head"), t["text"].alias("text"),
        t["target"].alias("target"),
    ))
    made = computed_once(led.select("conv", "window", pieces.alias("pieces")), {
        "sizes": F.transform("pieces", lambda p: F.length(p["head"]) + F.length(p["text"]) + len(END)),
    })
    def span(p: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda total, n: total + n) + F.length(p["head"])
        return F.when(p["target"], F.struct(start.alias("start"), (start + F.length(p["text"])).alias("end")))

    return made.select(
        "conv.conv_id", "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
        F.filter(F.transform("pieces", span), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>``: the turns of a window's text that are not repeated, as they were before."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p.startswith(TURN))
    halves = F.transform(pieces, lambda p: F.split(p, r"<\|text\|>"))
    return F.transform(halves, lambda h: F.struct(
        unescaped(F.substr(F.get(h, F.lit(0)), F.lit(len(TURN) + 1))).alias("role"), unescaped(F.get(h, F.lit(1))).alias("text")
    ))


def read_loss(formatted: Column, loss: Column) -> Column:
    """``array<string>``: the texts under the loss mask, as they were before."""
    return F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))
