"""Model operators on Spark ML (M1–M9), the forecast (C11) and the model
bake-off (C17).

Forests are trained on executors (Spark aggregates split statistics per
partition); the driver holds only fitted trees and the grid of parameter draws.
Folds are contiguous blocks of the rows sorted by ``(entity, period)`` — the
unshuffled 3-fold split of the reference — computed with the distributed row
index of :mod:`perilscope.operators.order`. A search scores its draws in tasks
(:mod:`perilscope.plans.boosting`), and shares fits among them: a draw's depth and
number of trees are cuts of a deeper, larger forest's node table
(:mod:`perilscope.plans.nodes`). The best draw is then fitted on all rows.

Parameter mapping to Spark's learners: ``n_estimators`` → ``numTrees`` /
``maxIter``; ``max_depth`` → ``maxDepth`` (None → 30, Spark's cap);
``min_samples_leaf`` / ``min_child_weight`` → ``minInstancesPerNode``;
``max_features`` / ``colsample_bytree`` → ``featureSubsetStrategy``;
``learning_rate`` → ``stepSize``; ``subsample`` → ``subsamplingRate``;
``gamma`` → ``minInfoGain``. Splits use histogram bins per feature: one for
every eight training rows, between ``MIN_BINS`` and ``MAX_BINS``, and at least the
root of the rows, so that Spark finds the thresholds on all rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (FEATURES_IMPROVED, GRID_BOOSTED, GRID_BOOSTED_HIST,
                      GRID_FOREST_BAKEOFF, GRID_FOREST_FORECAST, SEED, TARGET)
from ..operators.filters import complete_cases
from ..operators.joins import attach_global_stats
from ..operators.order import dense_rank
from . import boosting, nodes

FEATURES_COL = "features"


def assemble_features(df: DataFrame, cols: Sequence[str],
                      target: str | None = TARGET) -> DataFrame:
    """M1: complete cases over features (+ target), then one vector column."""
    need = list(cols) + ([target] if target else [])
    rows = complete_cases(df, need)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in cols})
    return VectorAssembler(inputCols=list(cols), outputCol=FEATURES_COL,
                           handleInvalid="error").transform(rows)


def contiguous_folds(df: DataFrame, order: Sequence[str], k: int = 3,
                     out: str = "fold") -> DataFrame:
    """M5 folds: rows sorted by ``order`` cut into ``k`` contiguous blocks,
    the first ``n mod k`` blocks one row longer (unshuffled k-fold, same as
    ``ntile``). ``order`` must identify rows uniquely."""
    keyed = df.withColumn("_okey", F.struct(*[F.col(c) for c in order]))
    ranked = dense_rank(keyed, "_okey", "_idx", descending=False)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    ranked = attach_global_stats(ranked, n)
    i = F.col("_idx") - 1
    q = F.floor(F.col("_n") / k)
    r = F.col("_n") - q * k
    big = r * (q + 1)
    fold = F.when(i < big, F.floor(F.try_divide(i, q + 1))).otherwise(
        r + F.floor(F.try_divide(i - big, q)))
    return ranked.withColumn(out, fold.cast("int")).drop("_okey", "_idx", "_n")


# -- estimators and parameter draws --------------------------------------------

TRAINING_PARTITIONS = 2
MIN_BINS, MAX_BINS = 32, 256
FITS_AT_ONCE = 4


def bins_for(rows: int) -> int:
    """Histogram bins for a training set: more than a bin per eight rows only
    makes the split statistics larger. Spark's learner finds its thresholds on a
    sample of bins x bins rows, so there are bins enough that these are all rows."""
    return max(MIN_BINS, min(MAX_BINS, rows // 8), math.isqrt(max(rows, 1) - 1) + 1)


def training_rows(df: DataFrame, partitions: int = TRAINING_PARTITIONS) -> DataFrame:
    """Cache ``df`` in a fixed number of partitions.

    The learners sample per partition, so the layout is part of the model: it
    is a parameter, never a count of rows. Rows are dealt by their key, so
    equal input gives an equal layout. For a large training set pass a number
    that keeps a partition in a task's memory.
    """
    keys = [c for c in ("country", "period") if c in df.columns]
    dealt = df.repartition(partitions, *keys) if keys else df.repartition(partitions)
    if keys:
        dealt = dealt.sortWithinPartitions(*keys)
    cached = dealt.persist()
    cached.count()
    return cached


def forest(seed: int = SEED) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol=FEATURES_COL, labelCol=TARGET,
                                 seed=seed, maxBins=MAX_BINS)


def boosted(seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(featuresCol=FEATURES_COL, labelCol=TARGET, seed=seed,
                        maxBins=MAX_BINS)


def _depth(v):
    return 30 if v is None else int(v)


def forest_params(est: RandomForestRegressor, draw: dict) -> dict:
    out = {}
    if "n_estimators" in draw:
        out[est.numTrees] = int(draw["n_estimators"])
    if "max_depth" in draw:
        out[est.maxDepth] = _depth(draw["max_depth"])
    if "min_samples_leaf" in draw:
        out[est.minInstancesPerNode] = int(draw["min_samples_leaf"])
    if "max_features" in draw:
        out[est.featureSubsetStrategy] = str(draw["max_features"])
    return out


def boosted_params(est: GBTRegressor, draw: dict) -> dict:
    out = {}
    if "n_estimators" in draw:
        out[est.maxIter] = int(draw["n_estimators"])
    if "learning_rate" in draw:
        out[est.stepSize] = float(draw["learning_rate"])
    if "max_depth" in draw:
        out[est.maxDepth] = _depth(draw["max_depth"])
    if "min_samples_leaf" in draw:
        out[est.minInstancesPerNode] = int(draw["min_samples_leaf"])
    if "min_child_weight" in draw:
        out[est.minInstancesPerNode] = int(draw["min_child_weight"])
    if "subsample" in draw:
        out[est.subsamplingRate] = float(draw["subsample"])
    if "colsample_bytree" in draw:
        v = float(draw["colsample_bytree"])
        out[est.featureSubsetStrategy] = "all" if v >= 1.0 else str(v)
    if "gamma" in draw:
        out[est.minInfoGain] = float(draw["gamma"])
    return out


def draw_grid(grid: dict, n_iter: int, seed: int = SEED) -> list[dict]:
    """n_iter distinct random points of a finite grid (seeded), or the whole
    grid when it is smaller. The grid is a parameter space, not data."""
    keys = list(grid)
    points = [{}]
    for k in keys:
        points = [dict(p, **{k: v}) for p in points for v in grid[k]]
    if n_iter >= len(points):
        return points
    return random.Random(seed).sample(points, n_iter)


def param_maps(est: Estimator, draws: list[dict]) -> list[dict]:
    mapper = forest_params if isinstance(est, RandomForestRegressor) else boosted_params
    return [mapper(est, d) for d in draws]


@dataclass
class SearchResult:
    """Outcome of a search: the refit best model and the mean CV metric of
    each parameter draw (same attribute names as Spark's CrossValidatorModel)."""
    bestModel: object
    avgMetrics: list
    bestIndex: int


def forest_search(train: DataFrame, est: RandomForestRegressor, draws: list[dict],
                  folds: int, fold_col: str = "fold") -> list[float]:
    """Mean R² over the folds of every draw, from Spark's own forests on all rows:
    one deep, large forest per (leaf size, features per split, fold), whose node
    table is cut to every draw's depth and number of trees. ``train`` is cached and
    has the feature vector, the target and ``fold_col``."""
    features = len(train.select(FEATURES_COL).first()[0])
    groups: dict[tuple, list[int]] = {}
    for i, d in enumerate(draws):
        key = (int(d.get("min_samples_leaf", 1)), boosting.features_per_split(d, features))
        groups.setdefault(key, []).append(i)

    def score(key, members, fold) -> dict[int, float]:
        largest = {"n_estimators": max(_trees(est, draws[i]) for i in members),
                   "max_depth": max(_cut(est, draws[i]) for i in members),
                   "min_samples_leaf": key[0], "max_features": str(key[1])}
        valid = train.where(F.col(fold_col) == fold)
        model = est.copy(forest_params(est, largest)).fit(train.where(F.col(fold_col) != fold))
        cuts = [(_cut(est, draws[i]), _trees(est, draws[i])) for i in members]
        table = nodes.of_model(train.sparkSession, model)
        walked = valid.select(F.col(TARGET).alias("y"), table.sums(
            train.sparkSession, nodes.features_array(FEATURES_COL), cuts).alias("sums"))
        error = {i: F.pow(F.col("y") - F.col("sums")[j] / cuts[j][1], 2)
                 for j, i in enumerate(members)}
        sums = walked.agg((F.var_pop("y") * F.count("y")).alias("all"),
                          *[F.sum(e).alias(f"e{i}") for i, e in error.items()]).first()
        return {i: 1 - sums[f"e{i}"] / sums["all"] if sums["all"] else math.nan
                for i in members}

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        runs = [pool.submit(score, k, m, f) for k, m in groups.items() for f in range(folds)]
        scores = [r.result() for r in runs]
    return [sum(s[i] for s in scores if i in s) / folds for i in range(len(draws))]


def _trees(est: RandomForestRegressor, draw: dict) -> int:
    return int(draw.get("n_estimators", est.getNumTrees()))


def _cut(est: RandomForestRegressor, draw: dict) -> int:
    return _depth(draw["max_depth"]) if "max_depth" in draw else est.getMaxDepth()


def random_search_cv(train: DataFrame, est: RandomForestRegressor, grid: dict, n_iter: int,
                     features: Sequence[str], folds: int = 3,
                     order: Sequence[str] = ("country", "period"),
                     seed: int = SEED, partitions: int = TRAINING_PARTITIONS,
                     sample_rows: int | None = boosting.FIT_ROWS):
    """M5: ``n_iter`` grid draws of a forest, k-fold CV on R² over contiguous
    folds, best draw refit on all rows by Spark's forest. Returns
    ``(search_result, draws)``. Every draw is scored on all rows: up to
    ``sample_rows`` rows by fits in tasks that hold them all
    (:func:`perilscope.plans.boosting.search`), more rows, or any number with
    ``None``, by Spark's forests, whose tasks hold a part (:func:`forest_search`)."""
    draws = draw_grid(grid, n_iter, seed)
    data = training_rows(contiguous_folds(train, list(order), folds), partitions)
    try:
        rows = data.count()
        est = est.copy({est.maxBins: bins_for(rows)})
        if sample_rows is None or rows > sample_rows:
            metrics = forest_search(data, est, draws, folds)
        else:
            table = boosting.training_table(data, features, TARGET, "fold", order)
            metrics = boosting.search(data.sparkSession, table, draws, folds, seed, forest=True)
        best = max(range(len(draws)), key=lambda i: metrics[i])
        model = est.copy(forest_params(est, draws[best])).fit(data)
        return SearchResult(model, metrics, best), draws
    finally:
        data.unpersist()


def search_scores(spark: SparkSession, cv_model, draws: list[dict]) -> DataFrame:
    """M5 report: one row per draw with its mean CV R²."""
    rows = [(i, repr(d), float(m)) for i, (d, m) in
            enumerate(zip(draws, cv_model.avgMetrics))]
    return spark.createDataFrame(rows, "draw int, params string, cv_r2 double")


def predict(model, df: DataFrame, out: str) -> DataFrame:
    """M6: score rows (``df`` must carry the feature vector) with a fitted Spark
    model, or with a boosted ensemble's node table."""
    if isinstance(model, nodes.NodeTable):
        return df.withColumn(out, model.sums(
            df.sparkSession, nodes.features_array(FEATURES_COL))[0])
    return model.transform(df).withColumnRenamed("prediction", out)


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M7: RMSE and R² over rows with both values: ``sqrt(mean(err²))`` and
    ``1 − SSres / SStot`` (null when the labels are constant). The label mean is a one-row frame broadcast
    beside the rows, so it is two aggregates and no window."""
    rows = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
    mean = rows.agg(F.avg(label).alias("_mean"))
    err = F.pow(F.col(label) - F.col(pred), 2)
    return attach_global_stats(rows, mean).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err)).alias("rmse"),
        (1 - F.try_divide(F.sum(err), F.sum(F.pow(F.col(label) - F.col("_mean"), 2))))
        .alias("r2"))


def feature_importance(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """M9: ``(feature, importance)`` sorted descending."""
    imp = model.featureImportances.toArray().tolist()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature").asc())


# Draws of the searches: forecast, and per learner of the bake-off.
FORECAST_DRAWS = 20
BAKEOFF_DRAWS = {"forest": 20, "boosted": 20, "boosted_hist": 50}


# -- C11: forecast ------------------------------------------------------------------

def forecast(spark: SparkSession, features_cli: DataFrame, pred_input: DataFrame,
             cutoff: int, n_iter: int = FORECAST_DRAWS, folds: int = 3,
             grid: dict = GRID_FOREST_FORECAST,
             features: Sequence[str] = FEATURES_IMPROVED,
             period: str = "period"):
    """C11: train on complete train rows, randomized forest search, predict
    the next period for each prediction row. Returns ``(predictions,
    importance, cv_model, draws)``; the prediction does not feed the CLI
    (as in the reference)."""
    train = assemble_features(features_cli.where(F.col(period) <= cutoff),
                              features, TARGET)
    cvm, draws = random_search_cv(train, forest(), grid, n_iter, features, folds)
    best = cvm.bestModel
    scored = predict(best, assemble_features(pred_input, features, None),
                     "predicted_impact_rebased_2026").drop(FEATURES_COL)
    return scored, feature_importance(spark, best, features), cvm, draws


# -- C17: bake-off ---------------------------------------------------------------

def bakeoff_frames(analysis: DataFrame, cutoff: int, with_lag: bool,
                   entity: str = "country", period: str = "period"):
    """C17 preparation: lead target over the whole series (W1), temporal
    split (P8: train ``< cutoff``), train entity mean filled with the train
    mean (A4, J6), and — for the binned set — the lag taken *within* each
    split (W2b), so a test series starts without one."""
    from ..operators import series as S
    df = S.with_series_columns(analysis, entity, period,
                               lambda w: {TARGET: S.lead1("impact_rebased", w)},
                               lookback=0, lookahead=1)
    df = df.withColumn("_split", (F.col(period) >= cutoff).cast("int"))
    train = df.where(F.col("_split") == 0)
    ent = train.groupBy(entity).agg(F.avg("impact_rebased").alias("_cm"))
    glob = train.agg(F.avg("impact_rebased").alias("_gm"))
    df = attach_global_stats(df.join(ent, on=entity, how="left"), glob)
    df = df.withColumn("country_mean_impact", F.coalesce("_cm", "_gm")).drop("_cm", "_gm")
    if with_lag:
        df = S.with_series_columns(df, ["_split", entity], period,
                                   lambda w: {"impact_lag1": S.lag1("impact_rebased", w)},
                                   lookback=1, lookahead=0)
    return (df.where(F.col("_split") == 0).drop("_split"),
            df.where(F.col("_split") == 1).drop("_split"))


def bakeoff(spark: SparkSession, prepared_train: DataFrame,
            prepared_test: DataFrame, features: Sequence[str],
            models: Sequence[str] = ("forest", "boosted", "boosted_hist"),
            n_iter: int | dict[str, int] = BAKEOFF_DRAWS, folds: int = 3,
            partitions: int = TRAINING_PARTITIONS) -> DataFrame:
    """C17: search each learner on train, score test, compare. One row per
    model: draws tried, CV R², best parameters, test R², test RMSE, ordered by
    test R² (best first). The folds are computed once for all learners."""
    folded = contiguous_folds(assemble_features(prepared_train, features, TARGET),
                              ["country", "period"], folds)
    train = training_rows(folded, partitions)
    test = training_rows(assemble_features(prepared_test, features, TARGET), partitions)
    sample = boosting.training_sample(train, features, TARGET, "fold")
    bins = bins_for(train.count())
    draws_of = n_iter if isinstance(n_iter, dict) else {m: n_iter for m in models}
    grids = {"forest": GRID_FOREST_BAKEOFF, "boosted": GRID_BOOSTED,
             "boosted_hist": GRID_BOOSTED_HIST}

    def run(name):
        draws = draw_grid(grids[name], draws_of[name])
        metrics = boosting.search(spark, sample, draws, folds, SEED, name == "forest")
        best = max(range(len(draws)), key=lambda i: metrics[i])
        est = forest().setMaxBins(bins)
        model = (est.copy(forest_params(est, draws[best])).fit(train) if name == "forest"
                 else boosting.fit_one(spark, sample, draws[best], SEED))
        m = regression_metrics(predict(model, test, "_pred"), TARGET, "_pred").first()
        return (name, len(draws), float(metrics[best]), repr(draws[best]),
                None if m["r2"] is None else float(m["r2"]),
                None if m["rmse"] is None else float(m["rmse"]),
                int(m["n"]))

    # The learners are independent searches: run them as concurrent jobs.
    try:
        with ThreadPoolExecutor(len(models)) as pool:
            rows = list(pool.map(run, models))
    finally:
        train.unpersist()
        test.unpersist()
    schema = T.StructType([T.StructField("model", T.StringType()),
                           T.StructField("draws", T.LongType()),
                           T.StructField("cv_r2", T.DoubleType()),
                           T.StructField("best_params", T.StringType()),
                           T.StructField("test_r2", T.DoubleType()),
                           T.StructField("test_rmse", T.DoubleType()),
                           T.StructField("n_test", T.LongType())])
    return spark.createDataFrame(rows, schema).orderBy(
        F.col("test_r2").desc_nulls_last())
