"""Production classifier with pyspark.ml (U3): word tokens -> hashed term
frequencies -> IDF -> multinomial logistic regression. Several settings are
fitted on most of the train part and judged on the rest of it; the first one
with the best validation accuracy (the A10 rule) predicts the test part.

Parameters: ``num_features`` hash buckets (tokens that share one are not told
apart), ``max_iter`` steps, ``reg`` values to choose from.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodline.functions.text import WORD
from moodline.operators.joins import materialize


NUM_FEATURES = 1 << 18
MAX_ITER = 50
REGS = (0.1, 0.01, 0.001)
#: Share of the train part, by key hash, on which candidates are judged.
VALIDATION = 0.25


def choose_and_predict(train: DataFrame, test: DataFrame, regs: tuple[float, ...] = REGS,
                       num_features: int = NUM_FEATURES,
                       max_iter: int = MAX_ITER) -> tuple[DataFrame, list[float], int]:
    """Predictions for ``test`` (doc_id, text, label), the candidates'
    validation accuracies and the index of the chosen one. ``train`` has
    doc_id, text, label."""
    features = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=WORD + "+", gaps=False, toLowercase=True),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features")])
    rows = train.filter(F.col("text").isNotNull()).select(
        "text", F.col("label").cast("double").alias("label"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(1000)) < int(VALIDATION * 1000)).alias("_judge"))
    fitted = features.fit(rows.filter(~F.col("_judge")))
    # tokenized once for all candidates
    ready = materialize(fitted.transform(rows).select("features", "label", "_judge"))
    # one partition a core, of a small written table too: in every step each
    # partition sends a gradient of all buckets, however few rows it has
    cores = train.sparkSession.sparkContext.defaultParallelism
    parts = ready.rdd.getNumPartitions()
    ready = ready if parts == cores else ready.coalesce(cores) if parts > cores else ready.repartition(cores)
    fit, judge = ready.filter(~F.col("_judge")), ready.filter("_judge")

    def fitted_with(reg: float) -> LogisticRegressionModel:
        return LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=max_iter,
                                  regParam=reg).fit(fit)

    # the candidates side by side: the driver's part of a step of one of them
    # leaves the cores to the others
    with ThreadPoolExecutor(len(regs)) as pool:
        run = inheritable_thread_target(train.sparkSession)(fitted_with)
        models = list(pool.map(run, regs))
    right = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    accuracy = [m.transform(judge).agg(right).first()[0] or 0.0 for m in models]
    best = accuracy.index(max(accuracy)) if max(accuracy) > 0 else len(accuracy) - 1
    out = models[best].transform(fitted.transform(test.filter(F.col("text").isNotNull())))
    p = vector_to_array(F.col("probability"))
    return out.select("doc_id", "label", F.col("prediction").cast("int").alias("predicted_code"),
                      p[0].alias("p_negative"), p[1].alias("p_neutral"), p[2].alias("p_positive")), accuracy, best
