"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretable.llm import oracle
from foretable.llm.common import table
from foretable.llm.exact_dedup import exact_dedup
from foretable.llm.language_id import language_id
from foretable.llm.lexical_search import lexical_search
from foretable.llm.line_dedup import line_dedup
from foretable.llm.mixing import mix_sources
from foretable.llm.near_dedup import near_dedup
from foretable.llm.piece_encoding import piece_encode, public_model
from foretable.llm.quality import quality_rules
from foretable.llm.secret_scan import BASE, secret_scan, written
from foretable.llm.substring_dedup import substring_dedup
from foretable.llm.toxicity import held_out, toxicity
from foretable.llm.url_filter import url_filter
from foretable.llm.whitening import whiten

#: Production parameters of the mixture: no source is repeated more than this.
MAX_REPETITION = 2.0
#: Scores from here on count as toxic.
TOXIC_FROM = 0.7


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_repetition=MAX_REPETITION)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_position")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    counts = [F.expr(f"bigint(size(filter(found, s -> s.kind = {i})))").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_model())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_quality_rules, op3_toxicity, op4_source_mixing, op5_secret_scan, op6_line_dedup, op7_near_dedup, op8_substring_dedup, op9_url_filter, op10_piece_encoding, op11_embedding_whitening, op12_language_id, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(oracle, name.upper()) for name in queries() if hasattr(oracle, name.upper())}
