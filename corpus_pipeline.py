"""A training corpus from raw documents: language, exact copies, near copies, personal data, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``docs``, whatever they are besides doc_id, text and lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from excerpta.llm import exact_dedup, language, near_dedup, packing, pii
from excerpta.llm.common import settle, table
from excerpta.llm.queries import BYTE_BPE


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number that tells rows apart and follows doc_id.

    Where ids tell rows apart it is the id. Elsewhere one row is left of those with one id and one text (up to white
    space), and rows are numbered by id, those without id last; equal rows meet map-side first.
    """
    docs_id = F.col("doc_id").cast("long")
    if docs.groupBy(docs_id.alias("id")).count().where("id is null or count > 1").isEmpty():
        return docs.withColumn("_row", docs_id)
    rows = docs.withColumn("_digest", F.sha2(exact_dedup.normal_text(F.col("text")), 256)).dropDuplicates(["doc_id", "_digest"])
    order = [docs_id.asc_nulls_last(), F.col("_digest")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(placed.withColumn("_row", F.monotonically_increasing_id()).drop("_digest"), "keyed")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the dropped rows, which ``dropped`` calls doc_id. Numbers alone cross the network where they are
    few; Spark decides from their measured size."""
    rows = settle(dropped.select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    return docs.join(rows, F.col("_row") == F.col("_dropped"), "left_anti").drop("_row")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose calibrated confidence is below the model's rejection level."""
    model = language.train(docs)
    found = language.predict(docs, model, lang="_lang_found", score="_lang_score", rejected="_lang_rejected")
    return found.where("not _lang_rejected").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep one row, of the least id; rows without id come last."""
    rows = _keyed(docs)
    return _without(rows, exact_dedup.exact_dedup(rows, key="_row").where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles keep one row, of the least id; rows without id
    come last, and those with one id and different texts are different documents."""
    rows = _keyed(docs)
    return _without(rows, near_dedup.near_dedup(rows, width=5, percent=80, key="_row").where("not kept"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace selected spans by their kind; n_chars, where there is one, follows the text."""
    found = pii.personal_spans(docs, spans="_pii_spans")
    text = pii.redact(F.col("text"), F.col("_pii_spans"))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.size("_pii_spans") > 0, length).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of 2048 tokens."""
    return packing.best_fit_packing(docs, BYTE_BPE)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

# Trained models, signatures and packing are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
