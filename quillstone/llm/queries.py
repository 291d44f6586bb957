"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import ann, chat, htmltext, langid, mixing, neardup, oracles, packing, pii, quality, secretscan, spelling, urlfilter, whitening
from quillstone.llm.common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = langid.train(documents.where(~held_out), "text", "lang", "doc_id")
    found = langid.predict(documents.select("doc_id", "text", held_out.alias("held_out")), model, "text", ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


def tokenizer_path() -> str:
    """The public vocabulary file that is packed with; the import is here because only the driver needs the package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"), "html", ["page_id"])


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), "text", "doc_id", tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(read(spark, sf_dir, "documents"), "text", "doc_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(read(spark, sf_dir, "documents"), "text", ["doc_id"]).drop("redacted")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"), "url", ["page_id"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    drawn = mixing.mix(documents, "text", "doc_id", "source", "lang")
    return drawn.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__p").alias("p"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(documents, "text", "doc_id", quality.trusted_ids(read(spark, sf_dir, "labels")))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality.judge(documents, "text", model).select(columns)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components_of(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), "text", "doc_id")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.annotate(read(spark, sf_dir, "documents"), "text", ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_html_text, op3_best_fit_packing, op4_jaccard_join, op5_pii, op6_url_filter, op7_mixing, op8_quality_rules, op9_nearest, op10_chat_format, op11_whitening, op12_spelling_variants, op13_secret_scan)
}

ORACLE_SQL: dict[str, str] = {"op7_mixing": oracles.mixing_sql(), "op10_chat_format": oracles.chat_sql()}
