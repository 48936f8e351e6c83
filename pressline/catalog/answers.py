"""Classification tables (M operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressline.catalog import query
from pressline.catalog import derived as d
from pressline.functions.once import computed_once
from pressline.operators import classify as cl


def _responses(spark, sf_dir):
    """One model response per label, in every shape a model gives."""
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    n = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    illegal = (
        F.when(k % 7 == 1, F.lit('"true"')).when(k % 7 == 2, F.lit("1")).when(k % 7 == 3, F.lit("null"))
        .when(F.col("toxic") == 1, F.lit("true")).otherwise(F.lit("false"))
    )
    content = (
        F.when(k % 11 == 5, F.lit("keine Antwort"))
        .when(k % 11 == 6, F.lit(""))
        .otherwise(n(
            '{"ort": "Ort ', s, '", "typ": ', F.when(k % 5 == 0, F.lit("null")).otherwise(F.lit('"Wetten"')),
            ', "koord": ', F.when(k % 3 == 0, F.lit("null")).otherwise(n('{"lat": ', s, ', "lon": "', s, '.5"}')),
            ', "bundesland": null, "illegal": ', illegal, "}",
        ))
    )
    message = F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))
    response = F.when(k % 13 == 7, F.lit("502 Bad Gateway")).otherwise(F.to_json(message))
    return d.table(spark, sf_dir, "labels").select(n("d", s).alias("url"), "doc_id", response.alias("response"))


_OK = "(doc_id % 11 NOT IN (5, 6) AND doc_id % 13 <> 7)"
_ILLEGAL = f"({_OK} AND doc_id % 7 NOT IN (1, 2, 3) AND toxic = 1)"


@query("classification_requests_m1", r"""
SELECT doc_id, length(text[1:2000])::BIGINT AS sent, 'Lies: ' || text[1:2000] AS content, 0.1::DOUBLE AS temperature,
       text[1:2000] AS bare, text[1:1500] AS pre_cut FROM documents""")
def classification_requests_m1(spark, sf_dir):
    text = F.col("text")
    body = F.from_json(
        cl.request(text, "model", "Lies: "), "model STRING, messages ARRAY<STRUCT<role:STRING,content:STRING>>, temperature DOUBLE"
    )
    read = computed_once(d.table(spark, sf_dir, "documents").select("doc_id", "text"), {"b": body})
    content = F.get("b.messages", F.lit(0))["content"]
    return read.select(
        "doc_id", (F.length(content) - 6).cast("bigint").alias("sent"), content.alias("content"), F.col("b.temperature").alias("temperature"),
        cl.request_text(text, None).alias("bare"), cl.request_text(text, None, pre_cut=1500).alias("pre_cut"),
    )


@query("answer_decode_m2", f"""
SELECT doc_id, CASE WHEN {_OK} THEN 'Ort ' || doc_id END AS ort, CASE WHEN {_OK} AND doc_id % 5 <> 0 THEN 'Wetten' END AS typ,
  CASE WHEN {_OK} AND doc_id % 3 <> 0 THEN doc_id::VARCHAR END AS lat, CASE WHEN {_OK} AND doc_id % 3 <> 0 THEN doc_id || '.5' END AS lon
FROM labels""")
def answer_decode_m2(spark, sf_dir):
    decoded = cl.decode_answers(_responses(spark, sf_dir))
    a = F.col("answer")
    return decoded.select(
        "doc_id", a["ort"].alias("ort"), a["typ"].alias("typ"), a["koord"]["lat"].alias("lat"), a["koord"]["lon"].alias("lon")
    )


@query("strict_true_gate_m3", f"SELECT doc_id FROM labels WHERE {_ILLEGAL}")
def strict_true_gate_m3(spark, sf_dir):
    return cl.illegal_only(cl.decode_answers(_responses(spark, sf_dir))).select("doc_id")


@query("answer_join_m4", f"""
SELECT t.doc_id, CASE WHEN l.doc_id IS NULL OR NOT {_OK.replace('doc_id', 'l.doc_id')} THEN 'no answer'
    WHEN {_ILLEGAL.replace('doc_id', 'l.doc_id')} THEN 'illegal' ELSE 'not illegal' END AS verdict
FROM documents t LEFT JOIN labels l ON t.doc_id = l.doc_id""")
def answer_join_m4(spark, sf_dir):
    docs = d.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"))
    joined = cl.with_answers(docs, _responses(spark, sf_dir).select("url", "response"))
    verdict = (
        F.when(F.col("answer.ort").isNull(), F.lit("no answer"))
        .when(cl.is_illegal(F.col("answer")), F.lit("illegal")).otherwise(F.lit("not illegal"))
    )
    return joined.select("doc_id", verdict.alias("verdict"))


@query("incident_type_m5", f"""
WITH {d.INCIDENTS}
SELECT event_id, coalesce(type, 'Sonstige') AS stored_type,
  CASE WHEN type IS NULL OR type = '' THEN 'Sonstige' WHEN type = 'A' THEN 'Automatenspiel' WHEN type = 'W' THEN 'Wetten'
       WHEN type = 'O' THEN 'Online-Spiele' ELSE type END AS shown_type FROM incidents""")
def incident_type_m5(spark, sf_dir):
    return d.incidents(spark, sf_dir).select(
        "event_id", cl.incident_type(F.col("type")).alias("stored_type"), cl.canonical_type(F.col("type")).alias("shown_type")
    )
