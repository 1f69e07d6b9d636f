"""Text features, classifiers and their scores on Spark ML."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StandardScaler, VectorAssembler, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmine.functions.predicates import as_col, bounded
from gridmine.operators.features import MIN_DOCUMENTS, TextFeatures, fit_text_features, load_text_features, written_features  # noqa: F401
from gridmine.session import partition_count

# Settings of the feature stages and models.
VOCABULARY_SIZE = 2**31 - 1  # all words; they are held by the driver, see ``features`` for larger vocabularies


def tokenizer(c: str, out: str) -> RegexTokenizer:
    """Lower case, split on blanks."""
    return RegexTokenizer(inputCol=c, outputCol=out)


def tokenize(df: DataFrame, c: str, out: str = "words") -> DataFrame:
    return tokenizer(c, out).transform(df)


def counter(words: str, out: str, size: int = VOCABULARY_SIZE, min_df: float = MIN_DOCUMENTS) -> CountVectorizer:
    return CountVectorizer(inputCol=words, outputCol=out, vocabSize=size, minDF=min_df)


def bag_of_words(df: DataFrame, words: str, out: str = "counts", size: int = VOCABULARY_SIZE, min_df: float = MIN_DOCUMENTS):
    """(fitted vocabulary model, df with sparse counts)."""
    model = counter(words, out, size, min_df).fit(df)
    if len(model.vocabulary) == size:
        warnings.warn(f"the vocabulary is cut at {size} words; rarer words are not counted", stacklevel=2)
    return model, model.transform(df)


def sparse_values(c: str | Column) -> Column:
    """Stored values of a vector column, without making it dense."""
    return F.unwrap_udt(as_col(c))["values"]


def width(c: str | Column) -> Column:
    """Length of a vector column."""
    raw = F.unwrap_udt(as_col(c))
    return F.coalesce(raw["size"], F.size(raw["values"])).cast("long")


@dataclass
class FeatureModel:
    """Fitted ``features``: their vocabularies stay tables."""

    columns: list[str]
    out: str
    counted: TextFeatures

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Adds the vectors; ``keep`` names the columns that stay (all by default)."""
        return self.counted.counted(_with_words(df, self.columns), self.out, list(df.columns if keep is None else keep))

    def save(self, path: str) -> None:
        self.counted.save(path)
        spark = self.counted.vocabularies[0].sparkSession
        names = [(*self.columns, self.out)]
        spark.createDataFrame(names, [f"name_{i}" for i in range(len(names[0]))]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{_NAMES}")


@dataclass
class FeatureCounts:
    """Unfitted ``features``."""

    columns: list[str]
    out: str
    min_df: float

    def fit(self, df: DataFrame) -> FeatureModel:
        least = self.min_df if self.min_df >= 1 else self.min_df * df.count()
        counted = fit_text_features(_with_words(df, self.columns), [f"{c}_words" for c in self.columns], min_df=least)
        if 0 in counted.sizes:
            raise ValueError("a vocabulary is empty")
        return FeatureModel(self.columns, self.out, counted)


#: Folder of the names in a saved ``FeatureModel``.
_NAMES = "names"


def _with_words(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = tokenize(df, c, f"{c}_words")
    return df


def features(columns: Sequence[str], out: str = "features", min_df: float = MIN_DOCUMENTS) -> FeatureCounts:
    """Tokens and counts per text column, assembled to one sparse vector; the driver never holds a word."""
    return FeatureCounts(list(columns), out, min_df)


def model_of(kind: str, inputs: int = 0, seed: int = 0):
    """Untrained classifier: svm, lr, nb, mlp (16 hidden units) or pairs (128 hidden units)."""
    if kind == "svm":
        return LinearSVC(maxIter=10, regParam=0.1)
    if kind == "lr":
        return LogisticRegression(maxIter=50)
    if kind == "nb":
        return NaiveBayes(smoothing=1.0)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[inputs, 16, 2], seed=seed, maxIter=50)
    if kind == "pairs":
        return MultilayerPerceptronClassifier(layers=[inputs, 128, 2], seed=seed, maxIter=20)
    raise ValueError(kind)


def train(df: DataFrame, kind: str, inputs: int = 0, seed: int = 0):
    """Fit on ``features``/``label``; training data are kept on executors while the fit iterates.

    A linear model shuffles a gradient as wide as the vocabulary per partition and iteration, so its rows lie in no
    more partitions than there are cores.
    """
    data = df.select("features", F.col("label").cast("double").alias("label"))
    if kind in ("svm", "lr"):
        data = data.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    data = data.persist()
    try:
        return model_of(kind, inputs, seed).fit(data)
    finally:
        data.unpersist()


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def top_positive(predictions: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Predicted positives by prediction and key; ``n`` shows the first ones only."""
    ranked = predictions.filter(F.col("prediction") == 1).orderBy(F.col("prediction").desc(), key)
    return ranked if n is None else ranked.limit(n)


def at_least_majority(predictions: DataFrame, n: str | None = None) -> Column:
    """Whether the share of right predictions reaches that of the commonest label, for ``agg``.

    ``n`` names a column with how many rows a row stands for.
    """
    if n is not None:
        right = F.sum(F.when(F.col("label").cast("double") == F.col("prediction"), F.col(n)).otherwise(0))
        ones = F.sum(F.when(F.col("label") == 1, F.col(n)).otherwise(0))
        return right >= F.greatest(ones, F.sum(n) - ones)
    right = F.avg((F.col("label").cast("double") == F.col("prediction")).cast("double"))
    ones = F.avg(F.col("label").cast("double"))
    return right >= F.greatest(ones, 1 - ones)


def area_under_pr(predictions: DataFrame, raw: str = "rawPrediction") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=raw, metricName="areaUnderPR").evaluate(predictions)


def threshold(score: str | Column, at: float = 0.5) -> Column:
    return F.when(as_col(score) > at, 1).otherwise(0)


def train_word2vec(
    df: DataFrame,
    words: str,
    size: int = 300,
    window: int = 3,
    min_count: int = 1,
    seed: int = 0,
    iterations: int = 1,
    partitions: int | None = None,
) -> Word2VecModel:
    """Word vectors trained in as many partitions as the session shuffles into.

    The vocabulary and its vectors are held by every task: ``min_count`` bounds them on large corpora.
    """
    return Word2Vec(
        vectorSize=size,
        windowSize=window,
        minCount=min_count,
        inputCol=words,
        outputCol="vector",
        seed=seed,
        maxIter=iterations,
        numPartitions=partitions or partition_count(df.sparkSession),
    ).fit(df)


def word_vectors(model: Word2VecModel) -> DataFrame:
    """(word, vector) of the whole vocabulary, as arrays."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def mean_features(df: DataFrame, vector: str) -> DataFrame:
    """array<double> feature column to an ML vector."""
    return df.withColumn("features", array_to_vector(vector))


def pair_features(
    pairs: DataFrame, columns: Sequence[str] = ("Rx1", "Ry1", "Rx2", "Ry2"), bound: float | None = None
) -> DataFrame:
    """Interval pairs as standardised feature vectors; ``bound`` leaves out those with larger values."""
    kept = pairs if bound is None else pairs.filter(bounded(columns, bound))
    raw = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(kept)
    scaler = StandardScaler(withMean=True, inputCol="_raw", outputCol="features").fit(raw)
    return scaler.transform(raw).drop("_raw")


def save_model(model, path: str) -> None:
    if isinstance(model, FeatureModel):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel | FeatureModel:
    spark = SparkSession.active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_NAMES}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return PipelineModel.load(path)
    *columns, out = spark.read.parquet(f"{path}/{_NAMES}").first()
    return FeatureModel(columns, out, load_text_features(spark, path))
