"""Models and scoring (M4-M7), re-aimed as Spark ML jobs.

Training runs on the executors through Spark ML. Scoring is a column
projection of the fitted pipeline's output; a user's own Python model can be
plugged in with :func:`score_with`, which runs it once per Arrow batch in
``mapInPandas`` (the model is loaded once per Python worker).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.functions.numeric import sigmoid
from markspark.session import checkpoint_dir


def train_gbt(df: DataFrame, features: str = "features", label: str = "label", max_iter: int = 500,
              max_depth: int = 7, step: float = 0.05, seed: int = 42):
    """M4: boosted-tree binary classifier (first-order trees; not numerically
    equal to a second-order booster, compare by properties)."""
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                        stepSize=step, seed=seed)
    return gbt.fit(df)


def text_pipeline(text: str = "text", label: str = "label",
                  num_features: int = 1 << 18, reg: float = 0.0, max_iter: int = 100) -> Pipeline:
    """M5: whitespace tokens of the whole text -> hashed term frequencies -> IDF -> logistic
    regression (two logits)."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\s+", toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol=label, regParam=reg, maxIter=max_iter)])


def train_text_classifier(df: DataFrame, text: str = "text", label: str = "label", **kw) -> PipelineModel:
    return text_pipeline(text, label, **kw).fit(df)


def score(model, df: DataFrame, th: float = 0.5, temperature: float | None = None,
          keep: list[str] | None = None) -> DataFrame:
    """M6: (keep..., logit_0, logit_1, prob, pred).

    ``prob`` is the model's class-1 probability, or sigmoid(logit_1 / T) when
    a temperature is given. ``pred`` is the argmax of the logits at th=0.5,
    else ``prob >= th``.
    """
    out = model.transform(df)
    raw = vector_to_array(F.col("rawPrediction"))
    z0, z1 = raw[0], raw[1]
    if temperature is not None:
        z0, z1 = z0 / F.lit(float(temperature)), z1 / F.lit(float(temperature))
        prob = sigmoid(z1)
    else:
        prob = vector_to_array(F.col("probability"))[1]
    pred = (z1 > z0).cast("int") if th == 0.5 else (prob >= F.lit(float(th))).cast("int")
    cols = list(keep or [c for c in df.columns])
    return out.select(*cols, z0.alias("logit_0"), z1.alias("logit_1"), prob.alias("prob"), pred.alias("pred"))


def score_with(df: DataFrame, load_model: Callable[[], Callable], text: str, keep: list[str],
               th: float = 0.5, on_error: str = "raise", batch_chars: int = 1 << 20) -> DataFrame:
    """M6 hook for a user's own model: ``load_model()`` returns
    ``predict(list[str]) -> (logit_0 list, logit_1 list)``; it runs in ``mapInPandas``,
    on at most ``batch_chars`` characters at once (a longer text alone; a null
    text is scored as an empty one). ``prob`` is the sigmoid of logit_1, as :func:`score`
    has it with a temperature of 1. ``on_error='skip'`` keeps failing rows with an
    ``error`` text and null scores instead of failing the job."""
    import pandas as pd

    key_fields = [df.schema[k].simpleString() for k in keep]
    schema = ", ".join(key_fields) + ", logit_0 double, logit_1 double, error string"

    def tried(predict, texts):
        try:
            l0, l1 = predict(texts)
            return list(l0), list(l1), [None] * len(texts)
        except Exception as e:  # noqa: BLE001
            if on_error != "skip":
                raise
            if len(texts) < 2:
                return [None] * len(texts), [None] * len(texts), [f"{type(e).__name__}: {e}"] * len(texts)
        half = len(texts) // 2  # only the failing rows are left without a score
        return tuple(x + y for x, y in zip(tried(predict, texts[:half]), tried(predict, texts[half:]), strict=True))

    def parts(texts):
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > batch_chars:
                yield held
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield held

    def run(batches):
        predict = load_model()
        for b in batches:
            l0, l1, err = [], [], []
            for part in parts(b[text].fillna("").tolist()):
                for whole, new in zip((l0, l1, err), tried(predict, part), strict=True):
                    whole.extend(new)
            out = b[keep].copy()
            out["logit_0"], out["logit_1"], out["error"] = pd.Series(l0, dtype="float64"), pd.Series(l1, dtype="float64"), err
            yield out

    s = df.select(*keep, text).mapInPandas(run, schema)
    prob = sigmoid(F.col("logit_1"))
    pred = (F.col("logit_1") > F.col("logit_0")).cast("int") if th == 0.5 else (prob >= F.lit(th)).cast("int")
    return s.withColumn("prob", prob).withColumn("pred", pred)


def split_importance(model, feature_names: list[str], top: int = 10) -> DataFrame:
    """M7: number of splits per feature ('weight' importance), top ``top``.

    The fitted trees are saved to the shared checkpoint folder and their node
    table is aggregated by Spark: internal nodes grouped by split feature.
    """
    spark = model.sparkSession if hasattr(model, "sparkSession") else None
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    internal = nodes.filter(F.col("nodeData.leftChild") >= 0)
    counts = internal.groupBy(F.col("nodeData.split.featureIndex").alias("feature_index")).agg(
        F.count(F.lit(1)).alias("weight"))
    names = spark.createDataFrame(list(enumerate(feature_names)), "feature_index int, feature string")
    j = counts.join(F.broadcast(names), "feature_index")  # one row per feature: bounded
    return j.orderBy(F.col("weight").desc(), F.col("feature")).limit(top).select("feature", "weight")
