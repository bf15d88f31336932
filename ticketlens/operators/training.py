"""Feature matrix, boosted trees, baseline, importances and the training run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens import params, schemas
from ticketlens.functions.text import feature_kind
from ticketlens.operators import metrics as M
from ticketlens.operators.calibration import calibrate, fit_calibration
from ticketlens.runtime import checkpoint_base, evened, local_table, pinned
from ticketlens.sources.published import current, publish
from ticketlens.sources.tables import check_splits

_NOT_INPUTS = ("split", "label", "fold")


def drop_non_model(df: DataFrame, columns: Sequence[str] = tuple(params.NON_MODEL_COLUMNS)) -> DataFrame:
    """Drop the label, the texts and other columns no model reads; absent ones are ignored."""
    return df.drop(*columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def with_label(df: DataFrame, label: str = params.LABEL) -> DataFrame:
    """The label as 0/1 integer; a missing label counts as 0."""
    return df.withColumn("label", F.coalesce(F.col(label), F.lit(0)).cast("int"))


def feature_matrix(df: DataFrame, label: str = params.LABEL, carry: Sequence[str] = ("split",)) -> DataFrame:
    """Label, carried columns and the numeric model inputs with 0 for missing.

    The inputs are chosen from the one schema all splits share.
    """
    kept = [c for c in carry if c in df.columns]
    numeric = numeric_columns(drop_non_model(df))
    inputs = [c for c in numeric if c not in (*kept, *_NOT_INPUTS) and not c.endswith(params.CLUSTER_SUFFIX)]  # an id is no quantity
    labelled = with_label(df, label)
    return labelled.select(*kept, "label", *inputs).fillna(0, subset=inputs)


def input_names(matrix: DataFrame, carry: Sequence[str] = ("split",)) -> list[str]:
    return [c for c in numeric_columns(matrix) if c not in (*carry, *_NOT_INPUTS)]


def boosted_trees(
    inputs: Sequence[str],
    trees: int = params.BOOSTING["trees"],
    rate: float = params.BOOSTING["rate"],
    depth: int = params.BOOSTING["depth"],
    seed: int = params.SEED,
    bins: int = 64,
) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features")
    model = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed,
        maxBins=bins, checkpointInterval=10, maxMemoryInMB=512,
    )
    return Pipeline(stages=[assembler, model])


def logistic_baseline(inputs: Sequence[str], iterations: int = 50) -> Pipeline:
    """A plain linear model to hold the trees against."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(inputs), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="label", maxIter=iterations),
        ]
    )


def fit_model(matrix: DataFrame, pipeline: Pipeline, train: str = "train") -> PipelineModel:
    """Fit on the train split, in the partitions the table is stored in."""
    checkpoint_base(matrix.sparkSession)  # boosting cuts its lineage there
    rows = matrix.filter(F.col("split") == train) if "split" in matrix.columns else matrix
    if not rows.take(1):
        raise ValueError("no rows to train on")
    return pipeline.fit(rows)


def predict(model: PipelineModel, matrix: DataFrame, carry: Sequence[str] = ("split",)) -> DataFrame:
    """Scored rows: carried columns, y and the probability p of the positive class."""
    probability = vector_to_array("probability")[1]
    return model.transform(matrix).select(*carry, F.col("label").alias("y"), probability.alias("p"))


def importances(model: PipelineModel, inputs: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance), a row per model input."""
    values = model.stages[-1].featureImportances.toArray()
    return local_table(spark, [(n, float(v)) for n, v in zip(inputs, values)], schemas.IMPORTANCES)


def rank_importances(table: DataFrame, top: int | None = None) -> DataFrame:
    """Features by importance, highest first, equal ones by name. The table has a row per model input."""
    order = Window.orderBy(F.desc("importance"), "feature")
    ranked = table.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def top_importances(table: DataFrame, top: int = 10) -> DataFrame:
    """(feature, importance) of the ``top`` inputs, highest first, equal ones by name."""
    return table.select("feature", "importance").orderBy(F.desc("importance"), "feature").limit(top)


def explain_importances(table: DataFrame, top: int | None = None) -> DataFrame:
    """Ranked importances with the report kind of each feature."""
    return rank_importances(table, top).withColumn("kind", feature_kind("feature"))


@dataclass(frozen=True)
class TrainingRun:
    model: PipelineModel
    inputs: list[str]
    threshold: float
    scored: DataFrame
    metrics: DataFrame
    sweep: DataFrame
    importances: DataFrame
    calibration: IsotonicRegressionModel | None = None


def train(
    features: DataFrame,
    label: str = params.LABEL,
    pipeline=boosted_trees,
    thresholds: Sequence[float] | None = tuple(params.DECISION_THRESHOLDS),
    carry: Sequence[str] = ("split",),
    calibrated: bool = False,
    **settings,
) -> TrainingRun:
    """Fit on train, choose the threshold on validation, evaluate every split.

    ``features`` has a ``split`` column. ``thresholds=None`` switches the choice off and keeps 0.5. ``calibrated`` puts the probabilities
    through an isotonic fit on validation first.
    """
    matrix = evened(pinned(feature_matrix(features, label, carry)))
    check_splits(matrix)
    inputs = input_names(matrix, carry)
    model = fit_model(matrix, pipeline(inputs, **settings))
    scored = pinned(predict(model, matrix, carry))
    isotonic = fit_calibration(scored.filter(F.col("split") == "validation")) if calibrated else None
    scored = pinned(calibrate(isotonic, scored)) if calibrated else scored
    validation = scored.filter(F.col("split") == "validation")
    sweep = M.threshold_sweep(validation, thresholds or [params.FALLBACK_THRESHOLD])
    chosen = M.best_threshold(sweep).first().threshold if thresholds else None
    threshold = params.FALLBACK_THRESHOLD if chosen is None else chosen
    table = M.metrics_table(scored, threshold)
    spark = features.sparkSession
    last = model.stages[-1]
    ranked = (
        importances(model, inputs, spark)
        if hasattr(last, "featureImportances")
        else local_table(spark, [(n, abs(float(v))) for n, v in zip(inputs, last.coefficients)], schemas.IMPORTANCES)
    )
    return TrainingRun(model, inputs, threshold, scored, table, sweep, ranked, isotonic)


def cross_validate(
    matrix: DataFrame, inputs: Sequence[str], folds: int, pipeline=boosted_trees, parallelism: int = 1, **settings
) -> list[float]:
    """Mean ROC AUC over the folds of the ``fold`` column, one value per parameter setting (here one)."""
    checkpoint_base(matrix.sparkSession)
    validator = CrossValidator(
        estimator=pipeline(inputs, **settings),
        estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", numBins=0),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return list(validator.fit(matrix).avgMetrics)


def out_of_fold(
    matrix: DataFrame, inputs: Sequence[str], folds: int, pipeline=boosted_trees, parallelism: int = 1, **settings
) -> DataFrame:
    """(fold, y, p): every row scored by a model fitted on the other folds. ``parallelism`` models are fitted at a time."""
    checkpoint_base(matrix.sparkSession)

    def scored(fold: int) -> DataFrame:
        model = fit_model(matrix.filter(F.col("fold") != fold), pipeline(inputs, **settings))
        return predict(model, matrix.filter(F.col("fold") == fold), ["fold"])

    with ThreadPool(min(parallelism, folds)) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(matrix.sparkSession)(scored), range(folds)))


def evaluate_folds(scored: DataFrame) -> DataFrame:
    """Rows, positives and exact ROC AUC of each fold of ``out_of_fold``; null for a fold of one class."""
    table = M.evaluate(pinned(scored), params.FALLBACK_THRESHOLD, ["fold"])
    positives = F.col("tp") + F.col("fn")
    return table.select("fold", (positives + F.col("fp") + F.col("tn")).alias("rows"), positives.alias("positives"), "auc_roc")


def save_model(model: PipelineModel, path: str) -> int:
    """Publish the model whole, as the next version at ``path``: a save that dies leaves the version before it."""
    return publish(SparkSession.active(), path, model.save)


def load_model(path: str) -> PipelineModel:
    """The last published version, its files compared with their checksums."""
    return PipelineModel.load(current(SparkSession.active(), path))
