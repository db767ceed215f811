"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and gives documents again; the last
gives packed pieces. Rows that a stage rejects are gone for the stages after it. ``run`` writes every stage's rows as Parquet
in the shared folder and reads them back, so a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.llm import dart_dedup, decontaminate, packing, pii, toxicity
from outcry.llm.common import crc, table, tokenizer_path, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic, as they are."""
    known = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality").cast("int")).alias("poor"), F.col("toxic").cast("int").alias("toxic"))
    chain = toxicity.fit_chain(docs, known, ["poor", "toxic"])
    rows = toxicity.featured(docs.select(*COLUMNS).withColumns({"kept_text": F.col("text"), "text": F.coalesce("text", F.lit(""))}), chain.vocabulary)
    rated = chain.rate(rows)
    return rated.filter(F.col("p_toxic") < toxicity.THRESHOLD).withColumn("text", F.col("kept_text")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    classes = dart_dedup.near_duplicates(docs)
    return dart_dedup.one_of_each(docs.select(*COLUMNS), classes)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages, as they are; the others go."""
    return decontaminate.uncontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def remove_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and revealing terms replaced; n_chars follows the text, a null text stays null."""
    clean = pii.sanitised_rows(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places."""
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", crc(F.col("ids")).alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("private_data", remove_private_data),
    ("packing", pack_sequences),
]

#: No stage can be said in SQL as a whole: a trained model, signatures and a packing order decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
