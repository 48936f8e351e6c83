"""The operators of this folder as queries over the given tables, with equivalent SQL where there is one.

Each query applies its operator with production parameters to its whole table and derives the digest columns the contract
names from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressline.llm import (
    bpe, chat, decontaminate, langid, licenses, main_text, merkle, quality, secrets, simhash, spelling, sql, url_filter, warc,
)
from pressline.llm.frames import table

Runner = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle_words=3, max_distance=2)
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return url_filter.judge(pages, URL_RULES).select("page_id", "url_verdict.*")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.removal_spans(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = found.withColumn("n_hit", decontaminate.n_hit())
    return hit.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    archives = warc.archive_folder(pages)
    records = warc.read(warc.write(pages, archives), archives, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = main_text.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    ).select(*[F.col(c).cast(kind) for c, kind in turns.dtypes])
    made = chat.windows(turns.unionByName(own))
    read = made.select(
        "conv_id", "window", F.length("formatted").alias("chars"), chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("loss"),
    ).select("conv_id", "window", "chars", F.size("turns").alias("n"), "loss", F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    ).alias("said"))
    # A digest needs its conversation whole, so here, and only here, the windows of one meet in a row.
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"),
    ).select("conv_id", "n_turns", "formatted_chars", F.array_join("w.said", "").alias("said"), F.array_join("w.loss", "").alias("loss"))
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predictions(table(spark, folder, "documents"))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.manifest(table(spark, folder, "documents"), merkle.without_line_ends())
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """A source is an owner, its documents in one language a repository."""
    repository = F.to_json(F.struct("source", "lang"))
    found = secrets.scan(table(spark, folder, "documents"), repository, F.col("source"))
    base = secrets.base_only(F.col("spans"))
    return found.select(
        "doc_id", *[secrets.of_kind(base, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
        *[secrets.with_verdict(F.col("spans"), verdict).alias(f"n_{verdict}") for verdict in ("live", "copied")],
    )


QUERIES: dict[str, Runner] = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_urls": op4_urls,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_main_text": op7_main_text,
    "op8_chat": op8_chat,
    "op9_bpe": op9_bpe,
    "op10_language": op10_language,
    "op11_spelling": op11_spelling,
    "op12_merkle": op12_merkle,
    "op13_secrets": op13_secrets,
}

# The others have no SQL: hashes, archives' dictionaries, models and tokenizers are no part of it.
SQL: dict[str, str] = {
    "op2_licenses": sql.licenses_sql(),
    "op3_quality": sql.quality_sql(),
    "op4_urls": sql.urls_sql(URL_RULES),
    "op5_decontaminate": sql.decontaminate_sql(),
    "op6_warc": sql.warc_sql(),
    "op8_chat": sql.chat_sql(),
    "op11_spelling": sql.spelling_sql(),
    "op12_merkle": sql.merkle_sql(),
    "op13_secrets": sql.secrets_sql(),
}
