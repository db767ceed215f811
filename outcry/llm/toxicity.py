"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another. Each model is a logistic regression with an absolute penalty, so only telling
terms keep a weight, on the words, word beginnings and runs of signs that a text holds, and on the probabilities of all
categories before it. For training,
those probabilities are out of fold: a row's earlier categories are predicted by models that have not seen the row, so a
later model learns from predictions as good as those it will meet. For prediction they come from models fitted on all folds.
The fits of one category, on all rows and without each fold, do not depend on each other and run FITS at a time.

Fitting takes at most ``max_rows`` labelled rows, those with the smallest hash of their id, and the VOCABULARY most frequent
terms that MIN_TEXTS of them hold; a row without a label for a
category is left out where that category is fitted. A category without two classes gets their share (0 where nothing is
labelled at all), so an empty table of labels rejects nothing. Null and empty texts have no features; texts are read whole.
Repeated rows and ids give a row each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcry.llm import common

MAX_ROWS, FOLDS, VOCABULARY, MIN_TEXTS, PREFIX, THRESHOLD = 20_000, 3, 1 << 16, 3, 4, 0.5
#: Tasks that hold the training rows, which are bounded. Each sends the driver an array as wide as the vocabulary in each round.
TASKS = 2
#: Fits at the same time. Each keeps dozens of arrays as wide as the vocabulary in the driver; raise it where the driver has room.
FITS = 1


def terms(text: Column, prefix: int = PREFIX) -> Column:
    """Distinct words in lower case, their first ``prefix`` characters (marked) where they are longer, runs of other signs, and one term that all texts share."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]++|[^\s\p{L}\p{N}]++"), F.lit(0))
    starts = F.transform(F.filter(words, lambda w: F.length(w) > prefix), lambda w: F.concat(F.lit("^"), F.left(w, F.lit(prefix))))
    return F.array_distinct(F.concat(F.array(F.lit("")), words, starts))


def featured(rows: DataFrame, vocabulary: CountVectorizerModel) -> DataFrame:
    """Adds ``x``, which terms of the vocabulary ``text`` holds; the text goes."""
    return plain(vocabulary.transform(rows.withColumn("terms_", terms(F.col("text")))), "x").drop("text", "terms_")


def plain(rows: DataFrame, name: str) -> DataFrame:
    """The column without its metadata, which names every term and would travel with every task of every round."""
    return rows.withColumn(name, F.col(name).alias(name, metadata={}))


def _appended(rows: DataFrame, inputs: str, size: int, name: str) -> DataFrame:
    """The vector ``inputs`` of ``size`` components with the number ``name`` as one more."""
    sized = VectorSizeHint(inputCol=inputs, size=size, handleInvalid="optimistic").transform(rows)
    longer = VectorAssembler(inputCols=[inputs, name], outputCol="longer_").transform(sized)
    return plain(longer.drop(inputs).withColumnRenamed("longer_", inputs), inputs)


def _probability(model: LogisticRegressionModel | float, rows: DataFrame, name: str) -> DataFrame:
    if isinstance(model, float):
        return rows.withColumn(name, F.lit(model))
    return model.transform(rows).withColumn(name, vector_to_array("p_")[1]).drop("p_")


def _fit(rows: DataFrame, inputs: str, label: str, regularisation: float, rounds: int) -> LogisticRegressionModel | float:
    rows = rows.filter(F.col(label).isNotNull())
    shares = rows.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("share")).first()
    if not shares.n or shares.share in (0.0, 1.0):
        return float(shares.share or 0.0)
    learner = LogisticRegression(
        featuresCol=inputs, labelCol="y_", probabilityCol="p_", predictionCol="", rawPredictionCol="", regParam=regularisation,
        elasticNetParam=1.0, standardization=False, maxIter=rounds, tol=1e-4, aggregationDepth=2)
    # the rounds leave arrays as wide as the vocabulary; the driver would add room for them to what earlier work and other fits left
    collect = rows.sparkSession.sparkContext._jvm.System.gc
    collect()
    model = learner.fit(rows.select(inputs, F.col(label).cast("double").alias("y_")))
    collect()
    return model


def out_of_fold(rows: DataFrame, models: Sequence[LogisticRegressionModel | float], name: str) -> DataFrame:
    """Adds ``name``, each row's probability by the model that was fitted without the row's ``fold``."""
    parts = [_probability(model, rows.filter(F.col("fold") == fold), name) for fold, model in enumerate(models)]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined


@dataclass
class Chain:
    """Models in order of their categories."""

    categories: list[str]
    models: list[LogisticRegressionModel | float]
    vocabulary: CountVectorizerModel
    size: int

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and the probability ``p_<category>`` of each category for every row."""
        return self.rate(featured(common.texts(docs, id_col, text_col), self.vocabulary))

    def rate(self, rows: DataFrame) -> DataFrame:
        """The rows of ``featured`` with a probability ``p_<category>`` for each category instead of their features."""
        for i, (category, model) in enumerate(zip(self.categories, self.models, strict=True)):
            rows = _probability(model, rows if i == 0 else _appended(rows, "x", self.size + i - 1, f"p_{self.categories[i - 1]}"), f"p_{category}")
        return rows.drop("x")


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int = MAX_ROWS, folds: int = FOLDS, vocabulary: int = VOCABULARY,
    regularisation: float = 3e-4, rounds: int = 40, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
) -> Chain:
    """Fits the categories, boolean or 0/1 columns of ``labels``, in the order given."""
    order = F.xxhash64("doc_id")
    chosen = labels.select(F.col(label_id).cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(f"y_{c}") for c in categories))
    chosen = chosen.filter(F.col("doc_id").isNotNull()).orderBy(order, *(f"y_{c}" for c in categories)).limit(max_rows)
    # at most max_rows rows of a few numbers, so the texts need no shuffle
    rows = common.texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    held = common.written(rows.withColumn("terms_", terms(F.col("text"))).drop("text"), "toxicity-terms")
    if held.isEmpty():
        known = CountVectorizerModel.from_vocabulary([""], inputCol="terms_", outputCol="x")
        return Chain(list(categories), [0.0] * len(categories), known, 1)
    known = CountVectorizer(inputCol="terms_", outputCol="x", vocabSize=vocabulary, minDF=MIN_TEXTS, binary=True)
    known = known.setMinDF(min(MIN_TEXTS, held.count())).fit(held)
    rows = plain(known.transform(held), "x").drop("terms_").withColumn("fold", F.pmod(order, F.lit(folds)))
    models: list[LogisticRegressionModel | float] = []
    size = 0
    for i, category in enumerate(categories):
        # the rounds read a table in few tasks, which carry neither the lineage nor the names of the terms
        rows = common.written(rows, "toxicity-rows").coalesce(TASKS)
        size = size or rows.select("x").first().x.size
        samples = [rows, *(rows.filter(F.col("fold") != fold) for fold in range(folds) if i + 1 < len(categories))]
        with ThreadPool(FITS) as pool:
            whole, *without = pool.map(inheritable_thread_target(docs.sparkSession)(lambda some: _fit(some, "x", f"y_{category}", regularisation, rounds)), samples, chunksize=1)  # noqa: B023
        models.append(whole)
        if without:
            rows = _appended(out_of_fold(rows, without, f"p_{category}"), "x", size + i, f"p_{category}").drop(f"p_{category}")
    return Chain(list(categories), models, known, size)


def toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, p_poor, p_toxic and toxic (p_toxic of ``threshold`` or more) of every row.

    The chain predicts first whether a text is poor (quality 0), then whether it is toxic.
    """
    known = labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("poor"), F.col("toxic").cast("int").alias("toxic"))
    chain = fit_chain(docs, known, ["poor", "toxic"], max_rows=max_rows, id_col=id_col, text_col=text_col)
    return chain.predict(docs, id_col, text_col).withColumn("toxic", F.col("p_toxic") >= threshold)
