"""Turning text into vectors through an exchangeable embedder."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.functions.fields import prepare_text
from outcry.operators.vectors import similar_to_vector

Embedder = Callable[[list[str]], list[list[float]]]
DIMS = 256


@lru_cache(maxsize=100_000)
def word_slot(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:2], 16)


def hashed_words(texts: list[str]) -> list[list[float]]:
    """Default embedder: word counts over 256 hashed slots, scaled to length one."""
    out = np.zeros((len(texts), DIMS))
    for row, text in zip(out, texts):
        for word, count in Counter(re.findall(r"[a-z0-9]+", text.lower())).items():
            row[word_slot(word)] += count
    length = np.sqrt((out * out).sum(axis=1))
    return (out / np.where(length == 0, 1.0, length)[:, None]).tolist()


def embed(rows: DataFrame, embedder: Embedder = hashed_words, *, key: str = "id", text: str = "text", batch: int = 50,
          concurrency: int | None = None) -> DataFrame:
    """``(key, embedding, error)`` for every row.

    Empty text is an error of its row and is not sent. A failing call is an error of the rows of its batch and of no
    others. ``concurrency`` sets how many calls run at the same time: it spreads a few large files over the cluster, and
    holds a cluster back from a service that allows only so many. An embedding costs more than moving its text.
    """
    prepared = rows.select(key, prepare_text(F.col(text)).alias("text"))
    if concurrency:
        prepared = prepared.repartition(concurrency)
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType),
                           T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = part.column(1).to_pylist()
                filled = [i for i, t in enumerate(texts) if t]
                vectors, errors = [None] * len(texts), [None if t else "Text cannot be empty" for t in texts]
                try:
                    got = embedder([texts[i] for i in filled]) if filled else []
                    if len(got) != len(filled):
                        raise ValueError(f"{len(filled)} texts gave {len(got)} vectors")
                    for i, v in zip(filled, got):
                        vectors[i] = v
                except Exception as e:  # the batch fails, the job goes on
                    for i in filled:
                        vectors[i], errors[i] = None, str(e)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64())),
                                                  pa.array(errors, pa.string())], names=[key, "embedding", "error"])

    return prepared.mapInArrow(run, schema)


def embed_missing(rows: DataFrame, vectors: DataFrame, embedder: Embedder = hashed_words, *, key: str = "id",
                  text: str = "text", batch: int = 50, concurrency: int | None = None, limit: int | None = None) -> DataFrame:
    """Vectors for the rows that have none yet. Without ``limit`` all of them are embedded."""
    todo = rows.join(vectors.where(F.col("embedding").isNotNull()).select(key), key, "left_anti")
    if limit is not None:
        todo = todo.orderBy(key).limit(limit)
    return embed(todo, embedder, key=key, text=text, batch=batch, concurrency=concurrency)


def embed_one(rows: DataFrame, row_id, embedder: Embedder = hashed_words, *, key: str = "id", text: str = "text") -> DataFrame:
    """The vector of one row; an error when the row does not exist."""
    one = rows.where(F.col(key) == row_id).agg(F.count("*").alias("n"), F.first(text).alias(text))
    kind = rows.schema[key].dataType
    checked = one.select(
        F.when(F.col("n") == 0, F.raise_error(F.lit(f"no row {row_id}")).cast(kind)).otherwise(F.lit(row_id).cast(kind)).alias(key), text)
    return embed(checked, embedder, key=key, text=text)


def embed_report(embedded: DataFrame) -> DataFrame:
    return embedded.agg(F.count("embedding").alias("processed"), F.count("error").alias("errors"))


def search_text(vectors: DataFrame, query: str, k: int = 20, min_similarity: float = 0.0, embedder: Embedder = hashed_words,
                *, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """Rows nearest to a text. The query is one short text, embedded on the driver."""
    return similar_to_vector(vectors, embedder([query])[0], k, min_similarity, id_col=id_col, vec=vec)
