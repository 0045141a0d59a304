"""Model fitting on tables: leaderboards, a text classifier, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexerModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import col, dealt, quoted, work_dir
from ..operators.evaluate import (
    class_labels, classification_report, classification_scores, confusion_matrix, evaluate_supervised, regression_scores,
)
from ..operators.prep import PrepConfig, build_preprocessor, make_config, save_pipeline
from ..operators.profile import is_classification_target
from ..operators.quality import drop_missing
from ..operators.split import parts, random_split
from ..operators.textprep import fit_term_vectors
from ..operators.trees import find_cells, fit_trees

# Hyperparameters of the candidates.
TREES, DEPTH, ROUNDS, RATE, SUBSAMPLE, COLUMNS, SEED, ITERATIONS = 300, 30, 400, 0.07, 0.9, 0.9, 42, 400

#: Memory for the statistics of the tree nodes that one job splits.
TREE_MEMORY_MB = 512
#: Training rows of a task, where there are not more tasks than that already.
ROWS_PER_TASK = 50_000
#: Test rows of a task: each goes down all trees of a forest.
SCORED_PER_TASK = 10_000
#: One-against-rest boosters that are fitted side by side.
CLASSES_AT_ONCE = 8


def candidates(
    task: str, rows: int, classes: int = 2, *, trees: int = TREES, depth: int = DEPTH, rounds: int = ROUNDS,
    iterations: int = ITERATIONS, boosted: bool = True,
) -> dict:
    """Estimators to compare, by name, on columns 'features' and 'label'."""
    # the level of a forest is one job if its nodes fit the memory; node ids spare a walk down all trees for every row
    trees_in = {"maxMemoryInMB": TREE_MEMORY_MB, "cacheNodeIds": True, "checkpointInterval": 10, "seed": SEED}
    boosting = {"maxIter": rounds, "stepSize": RATE, "subsamplingRate": SUBSAMPLE, "featureSubsetStrategy": str(COLUMNS), "seed": SEED}
    if task == "classification":
        out = {
            "LogReg": LogisticRegression(maxIter=iterations, regParam=1.0 / max(rows, 1), standardization=False),
            "RandomForest": RandomForestClassifier(numTrees=trees, maxDepth=depth, **trees_in),
        }
        if boosted:
            gbt = GBTClassifier(**boosting)
            out["BoostedTrees"] = gbt if classes <= 2 else OneVsRest(classifier=gbt, parallelism=min(classes, CLASSES_AT_ONCE))
        return out
    out = {
        "Linear": LinearRegression(),
        "RandomForestReg": RandomForestRegressor(numTrees=trees, maxDepth=depth, **trees_in),
    }
    if boosted:
        out["BoostedTreesReg"] = GBTRegressor(**boosting)
    return out


@dataclass(frozen=True)
class Leaderboard:
    """Scores per model (best first), the best model's name, and all fitted pipelines."""

    table: DataFrame
    best: str
    models: dict[str, PipelineModel]
    task: str


def _label_stages(df: DataFrame, target: str, task: str) -> tuple[list, list, list[str]]:
    """(stages making 'label', stages naming the prediction, class labels)."""
    if task == "regression":
        return (
            [SQLTransformer(statement=f"SELECT *, cast({quoted(target)} AS double) AS label FROM __THIS__")], [], [],
        )
    text = SQLTransformer(statement=f"SELECT *, cast({quoted(target)} AS string) AS _target FROM __THIS__")
    labels = class_labels(df.select(col(target).cast("string").alias("t")), "t")
    index = StringIndexerModel.from_labels(labels, inputCol="_target", outputCol="label", handleInvalid="keep")
    name = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)
    return [text, index], [name], labels


def _training_tasks(ready: DataFrame, rows: int) -> DataFrame:
    """The prepared rows in tasks of ROWS_PER_TASK at most.

    A level of a tree is a job, so few rows are kept in one task; many rows are dealt evenly, in as many
    tasks as all cores work through together, since a file's row group is one split however large. Their
    order decides what is drawn for a tree, so it follows from the rows themselves.
    """
    tasks, cores = max(1, -(-rows // ROWS_PER_TASK)), ready.sparkSession.sparkContext.defaultParallelism
    if tasks > 1:
        tasks = -(-tasks // cores) * cores
    return ready.coalesce(1) if tasks == 1 else ready.repartition(tasks).sortWithinPartitions(F.xxhash64("features", "label"))


def run_leaderboard(
    train: DataFrame, test: DataFrame, target: str, *, cfg: PrepConfig | None = None, task: str | None = None, **options
) -> Leaderboard:
    """Fit every candidate on the same prepared training rows and score it on the test rows."""
    train, test = drop_missing(train, [target]), drop_missing(test, [target])
    if task is None:
        task = "classification" if is_classification_target(train, target) else "regression"
    cfg = make_config(target=target) if cfg is None else cfg
    pipeline, _, _ = build_preprocessor(train.drop(target), cfg)
    prepared = pipeline.fit(train)
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # boosting cuts its lineage there
        context.setCheckpointDir(work_dir(train.sparkSession))
    before, after, labels = _label_stages(train, target, task)
    front = PipelineModel([prepared, *before])
    ready = front.transform(train).select("features", (F.col("label") + 0.0).alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    # prepared once for all models; a task that needs it again after a lost executor computes it anew
    seen = PipelineModel([prepared, *before]).transform(dealt(test, SCORED_PER_TASK)).persist(StorageLevel.MEMORY_AND_DISK)
    ready_in = ready
    try:
        rows = ready.count()
        ready_in = _training_tasks(ready, rows).persist(StorageLevel.MEMORY_AND_DISK)
        ready_in.count()
        ready.unpersist()
        cells = find_cells(ready_in, rows, classification=task == "classification")
        scores, models = [], {}
        for name, estimator in candidates(task, rows, len(labels), **options).items():
            fitted = fit_trees(estimator, ready_in, cells)
            models[name] = PipelineModel([prepared, *before, fitted, *after])
            scored = PipelineModel([fitted, *after]).transform(seen)
            if task == "classification":
                got = classification_scores(scored, target, "predicted").first()
                scores.append((name, got["accuracy"], got["f1_weighted"]))
            else:
                got = regression_scores(scored, target, "prediction").first()
                scores.append((name, got["r2"], got["mae"]))
    finally:
        ready.unpersist()
        ready_in.unpersist()
        seen.unpersist()
    names = ("accuracy", "f1_weighted") if task == "classification" else ("r2", "mae")
    table = train.sparkSession.createDataFrame(scores, f"model string, {names[0]} double, {names[1]} double").orderBy(
        F.col(names[0]).desc(), "model"
    )
    best = sorted(scores, key=lambda s: (-(s[1] if s[1] is not None else float("-inf")), s[0]))[0][0]
    return Leaderboard(table, best, models, task)


@dataclass(frozen=True)
class TextClassifier:
    model: PipelineModel
    scores: DataFrame
    confusion: DataFrame
    labels: list[str]


def train_text_classifier(
    df: DataFrame, text: str, target: str, keys: Sequence[str], *, test_share: float = 0.2, max_features: int = 20_000,
    ngram: tuple[int, int] = (1, 2), iterations: int = 100,
) -> TextClassifier:
    """TF-IDF of words and pairs, fitted on the training part, then naive Bayes or a linear SVM."""
    df = drop_missing(df.select(*[col(k) for k in keys], col(text), col(target)), [text, target])
    train, test = parts(random_split(df, keys, test_share, stratify=target))
    vectors = fit_term_vectors(train, text, max_features=max_features, ngram=ngram)
    before, after, labels = _label_stages(train, target, "classification")
    ready = PipelineModel([vectors, *before]).transform(train).select("features", (F.col("label") + 0.0).alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        estimator = NaiveBayes(modelType="multinomial", smoothing=1.0) if len(labels) > 2 else LinearSVC(
            maxIter=iterations, regParam=1.0 / max(ready.count(), 1), standardization=False
        )
        fitted = estimator.fit(ready)
    finally:
        ready.unpersist()
    model = PipelineModel([vectors, *before, fitted, *after])
    scored = model.transform(test)
    return TextClassifier(
        model, classification_scores(scored, target, "predicted"), confusion_matrix(scored, target, "predicted"), labels
    )


def save_model(model: PipelineModel, path: str) -> None:
    save_pipeline(model, path)


def score_table(path_or_model: str | PipelineModel, df: DataFrame) -> DataFrame:
    """Batch scoring: predictions of a saved or fitted model for every row."""
    model = PipelineModel.load(path_or_model) if isinstance(path_or_model, str) else path_or_model
    return model.transform(df)


def evaluate_model(path_or_model: str | PipelineModel, df: DataFrame, target: str) -> DataFrame:
    """Scores of a model on a test table, by the training task rule."""
    scored = score_table(path_or_model, df)
    if is_classification_target(df, target):
        return classification_scores(scored, target, "predicted").select("accuracy", "f1_weighted")
    return regression_scores(scored, target, "prediction").select("r2", "mae")


@dataclass(frozen=True)
class ModelEvaluation:
    scores: DataFrame  # (metric, value)
    confusion: DataFrame | None
    report: DataFrame | None


def full_evaluation(path_or_model: str | PipelineModel, df: DataFrame, target: str) -> ModelEvaluation:
    """All scores that fit the model, with confusion matrix and class report of a classifier.

    A classifier names its classes in the model, so probabilities are read in that order;
    AUC, average precision and log loss are left out where it gives no probabilities.
    """
    model = PipelineModel.load(path_or_model) if isinstance(path_or_model, str) else path_or_model
    scored = model.transform(dealt(df, ROWS_PER_TASK))
    names = next((s.getLabels() for s in model.stages if isinstance(s, IndexToString)), None)
    if names is None:
        return ModelEvaluation(evaluate_supervised(scored, target, "prediction", task="regression"), None, None)
    given = ["probability"] if "probability" in scored.columns else []
    scored = scored.select(col(target).cast("string").alias("y_true"), "predicted", *given)
    scores = evaluate_supervised(scored, "y_true", "predicted", proba=given[0] if given else None, labels=names, task="classification")
    return ModelEvaluation(
        scores, confusion_matrix(scored, "y_true", "predicted"), classification_report(scored, "y_true", "predicted")
    )


__all__ = [
    "Leaderboard", "ModelEvaluation", "TextClassifier", "candidates", "evaluate_model", "full_evaluation",
    "run_leaderboard", "save_model", "score_table", "train_text_classifier",
]
