"""Boosted trees, calibration and a second forecaster, all fitted by Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalspark.functions import scalar as S

SEED = 42


@dataclass
class Fitted:
    """A fitted scorer: turns feature columns into ``p``."""

    names: list[str]
    model: object | None
    constant: float | None = None
    calibrator: object | None = None
    platt: bool = False
    importances: list[tuple[str, float]] = field(default_factory=list)

    def raw(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            return df.withColumn("p_raw", F.lit(self.constant))
        scored = assemble(df, self.names)
        out = self.model.transform(scored)
        score = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
        return out.withColumn("p_raw", score).select(*df.columns, "p_raw")

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.raw(df)
        if self.calibrator is None:
            return scored.withColumnRenamed("p_raw", "p")
        if not self.platt:
            return self.calibrator.transform(scored).drop("p_raw").withColumnRenamed("p_calibrated", "p")
        vector = scored.withColumn("_score", array_to_vector(F.array("p_raw")))
        out = self.calibrator.transform(vector)
        return out.withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")

    def save(self, path: str) -> None:
        stages = [m for m in (self.model, self.calibrator) if m is not None]
        if stages:
            PipelineModel(stages).write().overwrite().save(f"{path}/stages")

    def facts(self) -> dict:
        """What the stages don't hold."""
        return {
            "feature_names": self.names,
            "constant": self.constant,
            "platt": self.platt,
            "importances": self.importances,
        }

    @classmethod
    def load(cls, path: str, facts: dict) -> Fitted:
        """The scorer that ``save`` wrote, with its ``facts``; a constant one has no stages."""
        own = [(name, float(weight)) for name, weight in facts.get("importances", [])]
        names = list(facts["feature_names"])
        if facts["constant"] is not None:
            return cls(names, None, constant=facts["constant"], importances=own)
        model, *rest = PipelineModel.load(f"{path}/stages").stages
        return cls(names, model, calibrator=rest[0] if rest else None, platt=facts["platt"], importances=own)


def assemble(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error").transform(df)


def fit_boosted(df: DataFrame, names: Sequence[str], label: str, task: str, params: dict) -> Fitted:
    """Boosted trees on train rows with early stopping on val rows, then calibration on val scores.

    A training set with one class gives a constant scorer and no calibration.
    """
    names = list(names)
    used = df.where(F.col("split").isin("train", "val"))
    if task == "classification":
        train = df.where(F.col("split") == "train")
        seen = train.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
        if seen["low"] == seen["high"]:
            return Fitted(names, None, constant=0.5 if seen["low"] is None else float(seen["low"]))
    rows = assemble(used, names).withColumn("_held_out", F.col("split") == "val")
    common = dict(
        featuresCol="features",
        labelCol=label,
        validationIndicatorCol="_held_out",
        maxDepth=int(params.get("max_depth", 4)),
        maxIter=int(params.get("n_estimators", 200)),
        stepSize=float(params.get("learning_rate", 0.05)),
        subsamplingRate=float(params.get("subsample", 0.9)),
        featureSubsetStrategy=str(params.get("colsample_bytree", 0.9)),
        seed=SEED,
    )
    learner = GBTClassifier(**common) if task == "classification" else GBTRegressor(**common)
    rows = rows.select("features", F.col(label).cast("double").alias(label), "_held_out").persist()
    try:
        model = learner.fit(rows)
    finally:
        rows.unpersist()
    weights = model.featureImportances.toArray()
    fitted = Fitted(names, model, importances=list(zip(names, map(float, weights), strict=True)))
    method = params.get("calibration", "none")
    if task == "classification" and method in ("isotonic", "platt"):
        val = fitted.raw(df.where(F.col("split") == "val"))
        fitted.calibrator = fit_calibrator(val.select("p_raw", F.col(label).alias("y")), method)
        fitted.platt = method == "platt"
    return fitted


def fit_calibrator(val: DataFrame, method: str):
    """Fitted on distinct scores with weights: the same solution from far fewer rows."""
    y, n = F.col("y"), F.count(F.lit(1))
    if method == "isotonic":
        merged = val.groupBy("p_raw").agg(F.avg("y").alias("y"), n.cast("double").alias("weight"))
        return IsotonicRegression(
            featuresCol="p_raw", labelCol="y", weightCol="weight", predictionCol="p_calibrated"
        ).fit(merged)
    merged = val.groupBy("p_raw", y.cast("double").alias("y")).agg(n.cast("double").alias("weight"))
    merged = merged.withColumn("_score", array_to_vector(F.array("p_raw")))
    rows = max(1, val.count())
    return LogisticRegression(
        featuresCol="_score", labelCol="y", weightCol="weight", regParam=1.0 / rows, standardization=False, tol=1e-14, maxIter=500
    ).fit(merged)


def importance_table(spark, fitted: Fitted, k: int) -> DataFrame:
    """Top features by importance; one row per feature exists in all."""
    ranked = sorted(enumerate(fitted.importances), key=lambda e: (-e[1][1], -e[0]))[:k]
    return spark.createDataFrame([entry for _, entry in ranked], "feature string, importance double")


def flatten_sequences(sequences: DataFrame, prefix: str = "enc_") -> DataFrame:
    """Encoder channels of a sequence set as one vector."""
    reals = [
        f.name
        for f in sequences.schema
        if f.name.startswith(prefix) and f.dataType.simpleString() == "array<double>"
    ]
    parts = [F.transform(c, lambda x: F.when(F.isnan(x), 0.0).otherwise(x)) for c in reals]
    return sequences.withColumn("features", array_to_vector(F.concat(*parts)))


def fit_sequence_model(sequences: DataFrame, task: str, params: dict):
    """Second forecaster on encoder sequences: a small perceptron for classes, a linear model for values."""
    rows = flatten_sequences(sequences).where(F.col("split") == "train").select("features", F.col("y").cast("double"))
    rows = rows.persist()
    try:
        if task == "classification":
            width = len(rows.first()["features"])
            return MultilayerPerceptronClassifier(
                labelCol="y",
                layers=[width, int(params.get("hidden_size", 24)), 2],
                maxIter=int(params.get("max_iter", 30)),
                seed=SEED,
            ).fit(rows)
        return LinearRegression(labelCol="y", regParam=float(params.get("reg", 1e-3))).fit(rows)
    finally:
        rows.unpersist()


def score_sequences(model, sequences: DataFrame, task: str) -> DataFrame:
    out = model.transform(flatten_sequences(sequences))
    if task == "classification":
        return out.withColumn("p", S.link_scores(vector_to_array("probability")[1], "quantile"))
    return out.withColumn("p", F.col("prediction"))
