"""Reader tip-offs: request checks, captcha gate, accepted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions.once import computed_once
from pressline.functions.text import trimmed

FIELDS = ("message", "source", "captcha")
MIN_SCORE = 0.5

# Answers of the endpoint.
NOT_POST = (405, "Method Not Allowed")
NO_JSON = (400, "Invalid JSON")
MISSING = (400, "Alle Felder müssen ausgefüllt sein.")
EMPTY = (400, "Ungültige Eingabedaten.")
NESTED = (500, "Serverfehler")
CAPTCHA_FAILED = (403, "Captcha ungültig.")
CAPTCHA_LOW = (403, "Captcha-Score zu niedrig.")
OK = (200, "ok")


# A broken rule is kept as its place in this list, null where none is broken.
RULES = (NOT_POST, NO_JSON, MISSING, NESTED, EMPTY, CAPTCHA_FAILED, CAPTCHA_LOW)


def _rule(test: Column, answer: tuple[int, str]) -> Column:
    return F.when(test, F.lit(RULES.index(answer)))


def _answers(rule: Column) -> dict[str, Column]:
    statuses = F.array(*[F.lit(status) for status, _ in RULES])
    reasons = F.array(*[F.lit(reason) for _, reason in RULES])
    return {
        "status": F.coalesce(F.get(statuses, rule), F.lit(OK[0])),
        "reason": F.coalesce(F.get(reasons, rule), F.lit(OK[1])),
    }


def _field(body: Column, name: str) -> Column:
    """Type of a body field (null where missing or null), and its trimmed text."""
    kind = F.nullif(F.schema_of_variant(F.try_variant_get(body, f"$.{name}", "variant")), F.lit("VOID"))
    text = F.try_variant_get(body, f"$.{name}", "string")
    flag = F.when(text == "true", F.lit("1")).otherwise(F.lit(""))
    return F.struct(kind.alias("kind"), trimmed(F.when(kind == "BOOLEAN", flag).otherwise(text)).alias("text"))


def triage(submissions: DataFrame) -> DataFrame:
    """Adds ``status, reason`` of the first rule a submission breaks, its number, and the trimmed fields."""
    parsed = computed_once(submissions, {"_v": F.try_parse_json("body")})
    read = computed_once(parsed, {
        "_shape": F.schema_of_variant("_v"), **{f"_{name}": _field(F.col("_v"), name) for name in FIELDS},
    })
    structured = F.coalesce(F.col("_shape").rlike("^(OBJECT|ARRAY)"), F.lit(False))
    nested, missing, empty = F.lit(False), F.lit(False), F.lit(False)
    for name in FIELDS:
        kind, text = F.col(f"_{name}.kind"), F.col(f"_{name}.text")
        missing = missing | kind.isNull()
        nested = nested | kind.rlike("^(OBJECT|ARRAY)")
        empty = empty | (text == "")
    rule = F.coalesce(
        _rule(F.coalesce(F.col("method"), F.lit("")) != "POST", NOT_POST), _rule(~structured, NO_JSON),
        _rule(missing, MISSING), _rule(nested, NESTED), _rule(empty, EMPTY),
    )
    judged = read.withColumns({"rule": rule, "message": F.col("_message.text"), "tip_source": F.col("_source.text")})
    return judged.withColumns(_answers(F.col("rule"))).drop("_v", "_shape", *[f"_{name}" for name in FIELDS])


def captcha_gate(triaged: DataFrame) -> DataFrame:
    """Refuses tips whose captcha failed or scored low; a result without score passes."""
    failed = ~F.coalesce(F.col("captcha_success"), F.lit(False))
    low = F.coalesce(F.col("captcha_score") < MIN_SCORE, F.lit(False))
    rule = F.coalesce(F.col("rule"), _rule(failed, CAPTCHA_FAILED), _rule(low, CAPTCHA_LOW))
    return triaged.withColumn("rule", rule).withColumns(_answers(F.col("rule")))


def accepted_tips(gated: DataFrame) -> DataFrame:
    """Trimmed message and source of the accepted tips."""
    return gated.filter(F.col("rule").isNull()).select("id", "message", F.col("tip_source").alias("source"))
