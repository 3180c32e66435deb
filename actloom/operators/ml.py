"""Text models over the corpus with pyspark.ml: features, training, hybrid decision, importances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actloom.functions.text import collapse, flags

#: M01. Regex flags over lower-case text, alike in Java and RE2.
FLAGS = {
    "has_number": "[0-9]",
    "has_deadline": "(дней|срок|days|tage|jours|日)",
    "has_amount": "(руб|eur|€|円|元)",
    "has_reference": "(ст\\.|п\\.|art\\.|sec\\.|abs\\.)",
    "has_question": "[?？]",
}


def meta_features(df: DataFrame, text: str) -> DataFrame:
    """M01. Length, word and flag columns."""
    c = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.select("*", F.length(c).cast("double").alias("f_chars"), F.size(F.split(collapse(c), " ")).cast("double").alias("f_words"), *[f.cast("double") for f in flags(c, FLAGS)])


def text_stages(text: str, label: str, features: int = 1 << 12) -> list:
    """M02. Words and word pairs, hashed; sublinear weights would need the counts, hashing keeps the fit to one pass for IDF."""
    return [
        SQLTransformer(statement=f"SELECT *, coalesce({text}, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        VectorAssembler(inputCols=["_tfidf", "f_chars", "f_words", *FLAGS], outputCol="features"),
        StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc"),
    ]


def classifier(kind: str, seed: int = 42):
    """M03, M11. Boosted trees of many classes and calibrated margins have no counterpart in pyspark.ml."""
    common = {"featuresCol": "features", "labelCol": "_label"}
    return {
        "logistic": lambda: LogisticRegression(maxIter=40, regParam=0.01, **common),
        "svm": lambda: OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), **common),
        "forest": lambda: RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed, **common),
        "complement_nb": lambda: NaiveBayes(modelType="complement", **common),
    }[kind]()


def fit(train: DataFrame, text: str, label: str, kind: str = "logistic", least_rows: int = 12, least_classes: int = 2) -> PipelineModel | None:
    """M05. A fitted pipeline; None where there are too few rows or classes."""
    seen = train.where(F.col(label).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k")).first()
    if seen["n"] < least_rows or seen["k"] < least_classes:
        return None
    return Pipeline(stages=[*text_stages(text, label), classifier(kind)]).fit(meta_features(train, text))


def tuned(train: DataFrame, text: str, label: str, grid: Sequence[float] = (0.001, 0.01, 0.1), folds: int = 3):
    """M04. Cross validation of the regularisation on macro F1."""
    lr = classifier("logistic")
    prepared = Pipeline(stages=text_stages(text, label)).fit(meta_features(train, text)).transform(meta_features(train, text))
    params = ParamGridBuilder().addGrid(lr.regParam, list(grid)).build()
    return CrossValidator(estimator=lr, estimatorParamMaps=params, evaluator=MulticlassClassificationEvaluator(labelCol="_label", metricName="f1"), numFolds=folds, seed=42).fit(prepared)


def predict(model: PipelineModel, df: DataFrame, text: str, label: str) -> DataFrame:
    """M05. df with ml_label and, for models that give any, ml_probability."""
    names = next(s for s in model.stages if hasattr(s, "labels")).labels
    out = model.transform(meta_features(df, text))
    out = IndexToString(inputCol="prediction", outputCol="ml_label", labels=names).transform(out)
    if "probability" in out.columns:
        from pyspark.ml.functions import vector_to_array

        out = out.withColumn("ml_probability", F.array_max(vector_to_array("probability")))
    return out.select(*df.columns, "ml_label", *[c for c in ("ml_probability",) if c in out.columns])


def hybrid(rule: Column, ml: Column, ml_probability: Column, critical: str = "critical", high: Sequence[str] = ("critical", "important"), promote: float = 0.75, low: float = 0.60) -> Column:
    """M08. A critical rule stays; agreement confirms; a sure model promotes or lowers; else the rule."""
    sure = F.coalesce(ml_probability, F.lit(0.0))
    return (
        F.when(rule == critical, rule).when(rule == ml, rule).when(ml.isin(*high) & ~rule.isin(*high) & (sure >= promote), ml).when(rule.isin(*high), rule).when(sure >= low, ml).otherwise(rule)
    )


def importances(model: PipelineModel, n: int = 20) -> list[tuple[str, int, float]]:
    """M06. (class, feature, weight): the n features with the largest weights of each class of a linear model."""
    last, names = model.stages[-1], next(s for s in model.stages if hasattr(s, "labels")).labels
    weights = last.coefficientMatrix.toArray()
    out = []
    for k, row in enumerate(weights):
        order = sorted(range(len(row)), key=lambda j: (-abs(row[j]), j))[:n]
        out += [(names[k] if len(weights) > 1 else names[1], j, float(row[j])) for j in order if not math.isclose(row[j], 0.0)]
    return out
