"""Walk-forward training of a weighted soft-vote ensemble with Spark ML."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from daymark.functions import draws
from daymark.functions import scalars as S
from daymark.operators import foldfit, oversample
from daymark.operators import folds as fd
from daymark.session import materialise, scratch_path, shared_folder

# Learner settings and vote weights.
C, L1_RATIO, LR_ITERATIONS = 0.3, 0.8, 2000
GBM_DEPTH, GBM_RATE, GBM_TREES, GBM_SUBSAMPLE, GBM_LEAF = 3, 0.02, 100, 0.6, 20
RF_TREES, RF_DEPTH, RF_LEAF = 80, 4, 15
SEED = 42
VOTE_WEIGHTS = {"lr": 2.0, "gbm": 1.0, "rf": 1.0}
SMOTE_RATIO = 0.9

MEMBERS = tuple(VOTE_WEIGHTS)

#: Bytes of assembled training vectors per task, at any size of input.
TASK_BYTES = 128 << 20
#: Labelled rows a fit with oversampling sees at most, since its neighbour search is quadratic.
MAX_FIT_ROWS = 50_000


def soft_vote(p_lr: Column, p_gbm: Column, p_rf: Column) -> Column:
    """Weighted mean of the members' P(up)."""
    return vote_of({"lr": p_lr, "gbm": p_gbm, "rf": p_rf})


def vote_of(probabilities: dict[str, Column]) -> Column:
    """Weighted mean of P(up) of the members that are present."""
    total = F.lit(0.0)
    for member, p in probabilities.items():
        total = total + p * VOTE_WEIGHTS[member]
    return total / sum(VOTE_WEIGHTS[m] for m in probabilities)


def voted_class(p_up: Column) -> Column:
    """Class of the larger probability; an exact tie is DOWN."""
    return (p_up > 0.5).cast("int")


def subset_size(n_features: int) -> str:
    """Features tried per split: the square root rounded down, as text for Spark ML."""
    return str(int(math.sqrt(n_features)))


def standardiser(stats: Sequence, columns: Sequence[str]) -> SQLTransformer:
    """A saveable stage that zeroes unusable values and standardises with fixed statistics."""
    known = {row.feature: (row.mean, row.scale) for row in stats}
    terms = []
    for c in columns:
        mean, scale = known[c]
        usable = f"CASE WHEN `{c}` IS NULL OR isnan(`{c}`) OR abs(`{c}`) = double('infinity') THEN 0D ELSE `{c}` END"
        terms.append(f"({usable} - ({mean!r}D)) / {scale!r}D AS `z_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def _named(learner, member: str):
    """Give a learner input and output columns of its own, so that several fit one pipeline."""
    return (
        learner.setFeaturesCol("features")
        .setLabelCol("target")
        .setPredictionCol(f"class_{member}")
        .setProbabilityCol(f"prob_{member}")
        .setRawPredictionCol(f"raw_{member}")
    )


def logistic(n_train: int, tol: float = 1e-6) -> LogisticRegression:
    """Elastic net. The penalty is per observation here, hence 1 / (C n) for balanced weights.

    Every iteration is a pass over the training rows. With strongly correlated lags the last
    digits of the coefficients take thousands of passes and move no prediction, so the default
    stops at a relative improvement of one in a million.
    """
    learner = LogisticRegression(
        regParam=1.0 / (C * n_train),
        elasticNetParam=L1_RATIO,
        maxIter=LR_ITERATIONS,
        tol=tol,
        standardization=False,
        weightCol="weight",
    )
    return _named(learner, "lr")


def boosted_trees(n_features: int) -> GBTClassifier:
    learner = GBTClassifier(
        maxDepth=GBM_DEPTH,
        stepSize=GBM_RATE,
        maxIter=GBM_TREES,
        subsamplingRate=GBM_SUBSAMPLE,
        minInstancesPerNode=GBM_LEAF,
        featureSubsetStrategy=subset_size(n_features),
        seed=SEED,
    )
    return _named(learner, "gbm")


def random_forest(n_features: int) -> RandomForestClassifier:
    learner = RandomForestClassifier(
        numTrees=RF_TREES,
        maxDepth=RF_DEPTH,
        minInstancesPerNode=RF_LEAF,
        featureSubsetStrategy=subset_size(n_features),
        weightCol="weight",
        seed=SEED,
    )
    return _named(learner, "rf")


@dataclass
class FoldData:
    """Model rows with what every fold needs, prepared in one pass for all folds."""

    frame: DataFrame
    columns: list[str]
    years: fd.Years
    folds: list[int]
    stats: dict[int, list] = field(default_factory=dict)
    weights: dict[int, object] = field(default_factory=dict)


def prepare(model_rows: DataFrame, columns: Sequence[str], years: fd.Years) -> FoldData:
    """Materialise the model rows by year and compute the statistics of every fold.

    The rows are dealt and sorted once here; a fold then reads its years without a shuffle. A fold
    whose training years lack a class is an error. What reaches the driver is the list of years, and per fold one number pair per feature and
    one per class.
    """
    keep = [c for c in ("series_id", "date", "target", "year") if c in model_rows.columns]
    slim = model_rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    order = [c for c in ("year", "series_id", "date") if c in slim.columns]
    frame = materialise(slim, "model-rows", partition_by="year", sort_by=order)
    folds = fd.fold_list(frame, years)
    data = FoldData(frame, list(columns), years, folds)
    for row in fd.scaler_stats(frame, columns, folds, years).collect():
        data.stats.setdefault(row.fold_year, []).append(row)
    for row in fd.class_weights(frame, folds, years).collect():
        data.weights[row.fold_year] = row
    lacking = [fold for fold in folds if fold not in data.stats]
    if lacking:
        raise ValueError(f"no training rows before test year(s) {lacking}")
    one_sided = [fold for fold in folds if not (data.weights[fold].n_up and data.weights[fold].n_down)]
    if one_sided:
        raise ValueError(f"training rows of one class only before test year(s) {one_sided}")
    return data


def bounded(rows: DataFrame, weights, limit: int):
    """A repeatable share of both classes, about ``limit`` rows, and its class weights."""
    if weights.n_train <= limit:
        return rows, weights
    share = limit / weights.n_train
    rows = rows.filter(draws.keyed_fraction(F.col("series_id"), F.col("date"), F.lit("fit")) < share)
    n_up, n_down = rows.agg(F.count_if(F.col("target") == 1), F.count_if(F.col("target") == 0)).first()
    n = n_up + n_down
    return rows, Row(n_train=n, n_down=n_down, n_up=n_up, weight_down=n / (2 * n_down), weight_up=n / (2 * n_up))


def fold_rows(
    data: FoldData, fold: int, smote: bool = False, task_bytes: int = TASK_BYTES, max_fit_rows: int = MAX_FIT_ROWS
) -> tuple[DataFrame, int, PipelineModel]:
    """Training vectors of a fold, their number, and the stages that made them.

    Without oversampling nothing is shuffled: the fold's years are read as they were written, and scan
    tasks are put together up to ``task_bytes``. With it at most about ``max_fit_rows`` rows, of both
    classes alike, are used.
    """
    scaler = standardiser(data.stats[fold], data.columns)
    assembler = VectorAssembler(
        inputCols=[f"z_{c}" for c in data.columns], outputCol="features", handleInvalid="error"
    )
    weights = data.weights[fold]
    train = data.frame.filter(fd.train_filter(data.years, fold))
    rows = assembler.transform(scaler.transform(train)).select("series_id", "date", "features", "target")
    if smote:
        rows, weights = bounded(rows, weights, max_fit_rows)
        rows, weights = oversample.balance(rows, weights, SMOTE_RATIO, SEED)
    weight = F.when(F.col("target") == 1, F.lit(weights.weight_up)).otherwise(F.lit(weights.weight_down))
    tasks = max(1, -(-weights.n_train * 8 * (len(data.columns) + 2) // task_bytes))
    if smote:
        rows = rows.repartition(tasks, "series_id", "date").sortWithinPartitions("series_id", "date")
    else:
        rows = rows.coalesce(tasks)
    return rows.select("features", "target", weight.alias("weight")), weights.n_train, PipelineModel([scaler, assembler])


def shippable(model: Model) -> Model:
    """A fitted model without its training summary.

    A summary refers to the session, and a session that has observed a write cannot be serialised, so
    a model that keeps its summary could not be sent to the tasks that score with it.
    """
    model = model.copy()
    if getattr(model, "hasSummary", False):
        jvm = SparkContext._active_spark_context._jvm
        model._java_obj.setSummary(jvm.scala.Option.empty())
    return model


def fit_linear(data: FoldData, folds: Sequence[int] | None = None) -> dict[int, foldfit.Linear]:
    """The logistic member of all folds, fitted side by side in shared passes over the rows."""
    return foldfit.fit_folds(data, folds, C, L1_RATIO)


def fit_fold(
    data: FoldData,
    fold: int,
    members: Sequence[str] = MEMBERS,
    smote: bool = False,
    task_bytes: int = TASK_BYTES,
    max_fit_rows: int = MAX_FIT_ROWS,
    linear: dict[int, foldfit.Linear] | None = None,
) -> PipelineModel:
    """Fit the chosen members for one fold and chain them behind the fold's standardiser.

    ``linear`` holds regressions fitted for several folds at once. Oversampled rows are a fold's own,
    so there the logistic member is fitted by itself.
    """
    shared: dict[str, object] = {}
    if "lr" in members and not smote:
        shared["lr"] = (linear or fit_linear(data, [fold]))[fold].stage(data.columns)
    alone = [m for m in members if m not in shared]
    rows, n_train, prepared = fold_rows(data, fold, smote, task_bytes, max_fit_rows)
    if alone:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        n = len(data.columns)
        learners = {
            "lr": lambda: logistic(n_train),
            "gbm": lambda: boosted_trees(n),
            "rf": lambda: random_forest(n),
        }
        rows.count()
        fit = inheritable_thread_target(rows.sparkSession)(lambda m: shippable(learners[m]().fit(rows)))
        try:
            with ThreadPoolExecutor(max_workers=len(alone)) as pool:
                shared |= dict(zip(alone, pool.map(fit, alone)))
        finally:
            rows.unpersist()
    return PipelineModel([*prepared.stages, *[shared[m] for m in members]])


def score(model: PipelineModel, df: DataFrame, members: Sequence[str] = MEMBERS) -> DataFrame:
    """Add ``p_<member>`` for each member, their weighted vote and its class."""
    scored = model.transform(df)
    # The shared regression gives its probability itself.
    scored = scored.withColumns(
        {f"p_{m}": vector_to_array(F.col(f"prob_{m}"))[1] for m in members if f"p_{m}" not in scored.columns}
    )
    scored = scored.withColumn("probability_up", vote_of({m: F.col(f"p_{m}") for m in members}))
    return scored.withColumn("predicted", voted_class(F.col("probability_up")))


@dataclass
class WalkForward:
    """Out-of-fold predictions and the model of the last fold."""

    predictions: DataFrame
    model: PipelineModel
    columns: list[str]
    folds: list[int]


def use_checkpoints(spark) -> None:
    """Boosting truncates its lineage every few trees when it has a reliable folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def fold_keys(data: FoldData, members: Sequence[str], smote: bool, max_fit_rows: int) -> dict[int, str]:
    """A name for each fold that changes with the settings, the fold's years and the rows in them.

    A new year leaves the names of earlier folds as they are; a corrected row changes those of its own
    year and of all later ones.
    """
    columns = [c for c in ("series_id", "date", "target") if c in data.frame.columns] + data.columns
    # Sums of row hashes do not depend on the order of the rows.
    summed = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    years = {r.year: (r.n, str(r.h)) for r in data.frame.groupBy("year").agg(F.count("*").alias("n"), summed.alias("h")).collect()}
    learners = [C, L1_RATIO, GBM_DEPTH, GBM_RATE, GBM_TREES, GBM_SUBSAMPLE, GBM_LEAF, RF_TREES, RF_DEPTH, RF_LEAF, SEED]
    settings = [list(members), smote, max_fit_rows if smote else 0, data.columns, learners, SMOTE_RATIO]
    keys = {}
    for fold in data.folds:
        y = data.years
        taken = [v for v in sorted(years) if y.train_from <= v <= y.train_to or y.test_from <= v <= min(y.test_to, fold)]
        told = json.dumps([settings, fold, [(v, *years[v]) for v in taken]])
        keys[fold] = f"{fold}-{hashlib.sha256(told.encode()).hexdigest()[:24]}"
    return keys


def finished_folds(spark, folder: str) -> set[str]:
    """Names of the folds whose mark has been written; it is written after everything else."""
    try:
        return {r.value for r in spark.read.text(f"{folder}/*/done").collect()}
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return set()


def walk_forward(
    data: FoldData,
    members: Sequence[str] = MEMBERS,
    smote: bool = False,
    concurrent_folds: int = 4,
    task_bytes: int = TASK_BYTES,
    max_fit_rows: int = MAX_FIT_ROWS,
    resume: str | None = None,
) -> WalkForward:
    """Fit and test every fold.

    Fits on daily data are short jobs, so a few folds run side by side to keep executors busy.
    A fold writes its test rows and its model as soon as it is scored: the result is a table, not the
    union of many live plans. With ``resume``, a shared folder, folds that were finished there with the
    same settings and rows are read instead of fitted.
    """
    spark = data.frame.sparkSession
    use_checkpoints(spark)
    out = resume or scratch_path(spark, "oof")
    keys = fold_keys(data, members, smote, max_fit_rows) if resume else {f: str(f) for f in data.folds}
    done = finished_folds(spark, out) if resume else set()
    missing = [f for f in data.folds if keys[f] not in done]
    linear = fit_linear(data, missing) if "lr" in members and not smote and missing else None

    def run(fold: int) -> PipelineModel:
        model = fit_fold(data, fold, members, smote, task_bytes, max_fit_rows, linear)
        test = data.frame.filter(F.col("year") == fold)
        kept = [c for c in ("series_id", "date") if c in test.columns]
        folder = f"{out}/{keys[fold]}"
        (
            score(model, test, members)
            .select(
                *kept,
                F.col("year").cast("int").alias("year"),
                F.col("target").cast("int").alias("actual"),
                "predicted",
                "probability_up",
                *[f"p_{m}" for m in members],
            )
            .write.mode("overwrite").parquet(f"{folder}/rows")
        )
        if resume:
            model.write().overwrite().save(f"{folder}/model")
            spark.createDataFrame([(keys[fold],)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/done")
        return model

    with ThreadPoolExecutor(max_workers=concurrent_folds) as pool:
        fitted = dict(zip(missing, pool.map(inheritable_thread_target(spark)(run), missing)))
    last = data.folds[-1]
    model = fitted[last] if last in fitted else PipelineModel.load(f"{out}/{keys[last]}/model")
    rows = spark.read.parquet(*[f"{out}/{keys[f]}/rows" for f in data.folds])
    return WalkForward(rows, model, data.columns, data.folds)


def history_report(predictions: DataFrame) -> DataFrame:
    """Out-of-fold predictions with direction labels and a correctness flag."""
    kept = [c for c in ("series_id", "row_id") if c in predictions.columns]
    actual, predicted = F.col("actual"), F.col("predicted")
    return predictions.select(
        *kept,
        "date",
        "year",
        "actual",
        "predicted",
        "probability_up",
        S.direction_label(actual).alias("actual_label"),
        S.direction_label(predicted).alias("predicted_label"),
        S.equal_flag(actual, predicted).alias("correct"),
    )
