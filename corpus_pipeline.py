"""From raw documents to token ids: toxic documents go, repeated lines go, one document of each near-duplicate group
stays, sources are mixed, and texts are encoded.

Every stage takes and returns a table with the columns of documents (the last one returns ids instead); between stages
the table is written and read again, so that each begins with a short lineage.

Edge cases are those of the operators. Further: a document that loses all its lines stays, with an empty text; of rows
that repeat id and text, near-duplicate removal keeps one; mixing loses no document and repeats those of small sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretable.llm.common import stored, table
from foretable.llm.line_dedup import line_dedup
from foretable.llm.mixing import mix_sources
from foretable.llm.near_dedup import near_dedup
from foretable.llm.piece_encoding import piece_encode, public_model
from foretable.llm.queries import MAX_REPETITION, TOXIC_FROM
from foretable.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC_FROM."""
    return toxicity(docs, table(spark, sf_dir, "labels")).where(F.col("score") < TOXIC_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has."""
    out = line_dedup(docs).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group."""
    ids = stored(near_dedup(docs).where("kept").groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("rows")), "kept-ids")
    kept = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("of")))
    if not ids.where("rows > 1").isEmpty():
        kept = kept.where("rows = 1").unionByName(kept.where("rows > 1").dropDuplicates(["doc_id", "text"]))
    return kept.select(*COLUMNS)


def mix_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources up to MAX_REPETITION times, all others once."""
    return mix_sources(docs, max_repetition=MAX_REPETITION).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    out = piece_encode(docs, public_model())
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("source mixing", mix_to_target_weights),
    ("SentencePiece encoding", encode_pieces),
]

#: A learned model and a bisection have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
