"""Role classification and forecasts with the library's learners."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.registry import query
from quillstone.shelf import Shelf


class SublinearCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts n of a sparse vector as 1 + ln n."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        for name, value in (("inputCol", inputCol), ("outputCol", outputCol)):
            if value is not None:
                self._set(**{name: value})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        damped = F.udf(lambda v: SparseVector(v.size, v.indices, 1 + np.log(v.values)), VectorUDT())
        return dataset.withColumn(self.getOutputCol(), damped(F.col(self.getInputCol())))


def role_pipeline(features: int = 1 << 14) -> Pipeline:
    """Sublinear TF-IDF of one- to three-word phrases and a logistic regression with balanced class weights."""
    join = SQLTransformer(statement="SELECT *, concat(w1, w2, w3) AS terms FROM __THIS__")
    return Pipeline(stages=[
        StringIndexer(inputCol="role", outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="title", outputCol="w1", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        NGram(n=3, inputCol="w1", outputCol="w3"),
        join,
        HashingTF(numFeatures=features, inputCol="terms", outputCol="counts"),
        SublinearCounts(inputCol="counts", outputCol="tf"),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(regParam=0.01, maxIter=50, weightCol="weight"),
    ])


def fitted_roles(train: DataFrame, shelf: Shelf) -> PipelineModel:
    """role_pipeline() fitted on train; its counts are made once, written, and read by the fits that need them."""
    *counting, idf, classifier = role_pipeline().getStages()
    counted = Pipeline(stages=counting).fit(train)
    counts = shelf.put(counted.transform(train).select("label", "weight", "tf"), "counts")
    weights = idf.fit(counts)
    fitted = classifier.fit(weights.transform(counts))
    shelf.drop("counts")
    return PipelineModel([*counted.stages, weights, fitted])


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with weights that give each class the same total."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    weights = counts.crossJoin(F.broadcast(total)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)  # one row for each class


# Common words by which the rule tells a language where no model is at hand or it is unsure.
COMMON_WORDS = {"de": ("der", "die", "und", "das"), "en": ("the", "and", "of", "that"), "es": ("el", "los", "que", "una"), "fr": ("le", "les", "des", "est")}
#: Share of rows held out, in parts of so many; probability from which the model's word counts.
HELD_PARTS, SURE = 5, 0.5
CHARS = 300


def rule_label(text: Column) -> Column:
    """The label whose common words stand in a text most often, ties by name; null if none does."""
    words = F.split(F.lower(text), "[^\\p{L}]+")
    among = lambda common: F.size(F.filter(words, lambda w: w.isin(*common)))
    counts = [F.struct(among(common).alias("n"), F.lit(-k).alias("k"), F.lit(label).alias("label")) for k, (label, common) in enumerate(sorted(COMMON_WORDS.items()))]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["label"])


def held_out(text: Column, label: Column) -> Column:
    """Whether a row is kept from the fit: about one in HELD_PARTS of each class, by a hash, and equal rows alike."""
    return F.pmod(F.xxhash64(label, text), F.lit(HELD_PARTS)) == 0


def labelled_by(model: PipelineModel | None, rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with predicted and source: the model's label where it is sure, else the rule's, else the model's after all."""
    rule = rule_label(F.col("title"))
    if model is None:
        return rows.withColumns({"predicted": rule, "source": F.lit("rule")})
    told = model.transform(rows.withColumn("weight", F.lit(1.0)))
    own = F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int"))
    sure = F.array_max(vector_to_array("probability")) >= SURE
    picked = F.when(sure | rule.isNull(), own).otherwise(rule)
    return told.select(*rows.columns, picked.alias("predicted"), F.when(sure | rule.isNull(), "model").otherwise("rule").alias("source"))


def load_model(where: str) -> PipelineModel | None:
    """The stored model; None if nothing is stored there."""
    try:
        return PipelineModel.load(where)
    except (Py4JJavaError, AnalysisException):
        return None


def labelled_documents(read) -> DataFrame:
    """doc_id, title (the beginning of each text, which is what the model reads), role (its language)."""
    rows = read("documents").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return rows.select("doc_id", F.substring("text", 1, CHARS).alias("title"), F.col("lang").alias("role"))


@query("role_model")
def role_model(spark, read):
    """What a stored model says of each held-out document; it was fitted on the others, stored, and read back."""
    shelf = Shelf(spark, "model")
    rows = shelf.put(labelled_documents(read), "rows")  # the whole texts are read once
    held = held_out(F.col("title"), F.col("role"))
    train = balanced(rows.filter(~held), "role")
    where = f"{shelf.path}/model"
    fitted = fitted_roles(train, shelf)
    fitted.write().overwrite().save(where)
    model = load_model(where)
    return labelled_by(model, rows.filter(held), fitted.stages[0].labels).select("doc_id", "role", "predicted", "source")


@query("role_accuracy")
def role_accuracy(spark, read):
    """Rows and right answers of the held-out part by class and by who answered."""
    found = role_model(spark, read)
    return found.groupBy("role", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == F.col("predicted")).alias("n_right"))


def daily_features(events: DataFrame) -> DataFrame:
    daily = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("y"), F.avg("value").alias("mean_value"))
    w = Window.orderBy("day")  # one row for each day
    lagged = daily.withColumns({"weekday": F.weekday("day"), "month": F.month("day"), "lag1": F.lag("y", 1).over(w), "lag2": F.lag("y", 2).over(w), "mean1": F.lag("mean_value", 1).over(w)})
    return lagged.withColumn("place", F.percent_rank().over(w)).dropna()


#: Learners by name; trees are fewer than in production use so that a fit takes seconds.
LEARNERS = {
    "engagement_predictor": lambda: GBTRegressor(labelCol="y", maxIter=15, stepSize=0.1, maxDepth=4, seed=1),
    "timing_optimizer": lambda: RandomForestRegressor(labelCol="y", numTrees=20, maxDepth=8, seed=1),
    "content_forecaster": lambda: GBTRegressor(labelCol="y", maxIter=20, stepSize=0.05, maxDepth=5, seed=1),
    "network_predictor": lambda: RandomForestRegressor(labelCol="y", numTrees=20, maxDepth=10, seed=1),
}
#: Shares of the days before each cut; a fold's test part ends at the next cut.
CUTS = (0.4, 0.6, 0.8, 1.01)


def folds(days: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Number, training part and test part of each fold: all days before a cut, and the days from it to the next one."""
    for k, (cut, end) in enumerate(zip(CUTS, CUTS[1:])):
        yield k, days.filter(F.col("place") < cut), days.filter((F.col("place") >= cut) & (F.col("place") < end))


@query("forecast_models")
def forecast_models(spark, read):
    """Errors of four learners of daily counts on the days after each of three cuts, fitted on the days before; features are known the day before."""
    days = Shelf(spark, "days").put(daily_features(read("events")), "days")
    data = VectorAssembler(inputCols=["weekday", "month", "lag1", "lag2", "mean1"], outputCol="features").transform(days)
    parts = []
    for k, train, test in folds(data):
        if train.isEmpty() or test.isEmpty():
            continue
        for name, make in LEARNERS.items():
            parts.append(make().fit(train).transform(test).select(F.lit(name).alias("model"), F.lit(k).alias("fold"), "day", "y", "prediction"))
    none = spark.createDataFrame([], "model string, fold int, day date, y double, prediction double")
    error = F.col("y") - F.col("prediction")
    return reduce(DataFrame.unionByName, parts, none).groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n_test"), F.min("day").alias("first_day"), F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"), F.round(F.avg(F.abs(error)), 4).alias("mae"))
