"""What several operators of this subpackage share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.session import scratch_path

#: Where the tokenizer files lie when the installed package does not say.
TOKENIZER_HOME = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every operator takes a path, this is only the default."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_HOME, name)
    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names, so that further columns of any name do no harm; a null text is an empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join where one key of ``big`` may hold a large part of all rows and ``small`` has a row for each key, which is repeated."""
    left = big.withColumn("salt_", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    right = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "salt_"], how).drop("salt_")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_frames(frames: DataFrame, path: str, separator: str) -> str:
    """Each partition's binary ``frame`` rows, in order, as one file.

    The text writer puts the bytes of a string down unchanged and ``separator`` behind each, through Spark's commit
    protocol: a repeated or lost task leaves no half file, on any file system that Spark reaches.
    """
    frames.select(F.col("frame").cast("string")).write.option("lineSep", separator).text(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (content) for each file that holds anything."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter(F.col("length") > 0).select("path", "content")


def crc(ids: Column) -> Column:
    return F.crc32(ids)
