"""Text classifiers as pyspark.ml pipelines, with splits by hash, group and time."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.operators.asof import running_sum
from threadline.operators.textmatch import word_grams
from threadline.sources.stage import staged


def with_grams(df: DataFrame, text: str, longest: int = 2) -> DataFrame:
    return df.withColumn("grams", word_grams(text, longest))


FEATURES = 1 << 14


def counted(features: int = FEATURES) -> HashingTF:
    """How often a row has each gram, by the gram's hash."""
    return HashingTF(inputCol="grams", outputCol="_tf", numFeatures=features)


def fit_classifier(df: DataFrame, label: str, features: int = FEATURES) -> PipelineModel:
    """TF-IDF of grams into a regularised logistic regression; ``features`` bounds the model. Grams that are counted already are taken as they are."""
    count = [] if "_tf" in df.columns else [counted(features)]
    stages = [StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip"), *count, IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_label", regParam=0.01, maxIter=30)]
    return Pipeline(stages=stages).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with predicted label and margin: the best probability less the next."""
    names = F.array(*map(F.lit, model.stages[0].labels))
    placeholder = df if model.stages[0].getInputCol() in df.columns else df.withColumn(model.stages[0].getInputCol(), F.lit(model.stages[0].labels[0]))
    out = placeholder
    for stage in model.stages[1:]:
        out = stage.transform(out)
    ranked = F.sort_array(vector_to_array("probability"), asc=False)
    margin = ranked[0] - F.coalesce(F.try_element_at(ranked, F.lit(2)), F.lit(0.0))
    return out.withColumns({"predicted": F.element_at(names, F.col("prediction").cast("int") + 1), "margin": margin}).drop("_tf", "_x", "rawPrediction", "probability", "prediction", "_label")


def fold(key: Column, k: int) -> Column:
    """A fold from a hash: equal keys share a fold, so groups are never split."""
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")


def temporal_split(df: DataFrame, time: str, share: float = 0.8) -> DataFrame:
    """is_train: the earlier share of the rows, those whose percent rank by time is below it.

    Rows are counted by time; how many come before a time is summed over ranges of times.
    """
    counts = running_sum(df.groupBy(time).agg(F.count(F.lit(1)).alias("_n")), time, "_n", "_before")
    last = F.greatest(F.lit(df.count() - 1), F.lit(1))
    early = counts.select(F.col(time).alias("_time"), (F.col("_before") / last < share).alias("is_train"))
    return df.join(early, df[time].eqNullSafe(F.col("_time")), "left").drop("_time")


def cross_validated(df: DataFrame, label: str, group: Column, k: int = 5) -> DataFrame:
    """Every row predicted by a model that saw none of its group.

    Grams are made and counted once, and the counts written: they are the same for every fold, and fitting reads them
    several times.
    """
    marked = staged(counted().transform(df.withColumn("fold", fold(group, k))).drop("grams"))
    out = None
    for i in range(k):
        train, test = marked.filter(F.col("fold") != i), marked.filter(F.col("fold") == i)
        part = predict(fit_classifier(train, label), test)
        out = part if out is None else out.unionByName(part)
    return out


def f1_scores(df: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """label, support, precision, recall, F1 of every class in one aggregation."""
    sides = F.array(F.struct(F.col(label).alias("k"), F.lit(1).alias("is_true"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("k"), F.lit(0).alias("is_true"), F.lit(0).alias("hit")))
    long = df.select(F.explode(sides).alias("x")).select("x.*")
    sums = long.groupBy(F.col("k").alias("label")).agg(F.sum("is_true").cast("double").alias("support"), F.sum(1 - F.col("is_true")).cast("double").alias("n_predicted"), F.sum("hit").cast("double").alias("hits"))
    return sums.select("label", "support", F.try_divide("hits", "n_predicted").alias("precision"), F.try_divide("hits", "support").alias("recall"), F.try_divide(2 * F.col("hits"), F.col("support") + F.col("n_predicted")).alias("f1"))
