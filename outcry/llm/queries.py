"""The operators over the test tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.llm import ann, dart_dedup, decontaminate, hard_negatives, html_text, oracles, packing, pii, ranking, secrets, token_count, token_file, toxicity, warc
from outcry.llm.common import crc, table, tokenizer_path, written
from outcry.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_near_duplicates": oracles.NEAR_DUPLICATES, "op5_warc": oracles.WARC, "op6_main_text": oracles.MAIN_TEXT, "op10_decontaminate": oracles.DECONTAMINATION,
    "op11_ranked_search": oracles.RANKED_SEARCH, "op13_hard_negatives": oracles.HARD_NEGATIVES}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), min_bytes=0)
    return warc.read_archives(spark, path).drop("url")


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents"))
    counts = {f"n_{kind}": pii.count_of(kind) for kind in pii.KINDS}
    return found.withColumns(counts).select(
        "doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        F.concat_ws(",", *(F.when(F.size(c) > 0, pii.listed(F.col(c))) for c in ("base", "revealing"))).alias("spans"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", crc(F.col("ids")).alias("ids_crc32"), "sequence_id", "offset")


@query
def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    token_file.write_token_file(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), path)
    read = token_file.read_token_file(spark, path).select("file", "place", "doc_id", "n_tokens", crc(F.col("ids")).alias("ids_crc32"))
    return token_file.with_starts(written(read, "token-digests")).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = {f"n_{kind}": secrets.count_of(kind) for kind in secrets.KINDS[:3]}
    return found.withColumns(counts).select("doc_id", *counts, F.sha2(secrets.listed(secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.listed().alias("spans"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted), every=50, positives=5, negatives=3)
