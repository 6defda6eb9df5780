"""Regressors on pyspark.ml: training, search, prediction, saved experiments."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfield.operators.evaluate import errors, require_features
from crossfield.operators.ranking import subsample
from crossfield.operators.select import feature_columns, training_rows
from crossfield.operators.transform import Scaler
from crossfield.operators.weights import add_sample_weights
from crossfield.plans.scale import stored
from crossfield.sources.tables import load_json, save_json

NOT_FEATURES = ["CrossSection", "Uncertainty", "Energy_Uncertainty", "Entry", "MT", "weight", "target", "fold", "draw"]
MAX_DEPTH = 30          # Spark's own limit
# What weights and targets are made of.
RAW_COLUMNS = ["CrossSection", "Uncertainty", "Energy", "Energy_Uncertainty"]
PART_ROWS = 1_000_000
# Rows up to which the models of a search are fitted side by side.
FITS_ROWS = 2_000_000
BOOSTED_DEFAULTS = {
    "maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42,
}


@dataclass
class Model:
    """A fitted pipeline with what is needed to predict and to be saved."""

    pipeline: PipelineModel | None = None
    scaler: Scaler = field(default_factory=Scaler)
    features: list[str] = field(default_factory=list)
    metrics: dict[str, Any] = field(default_factory=dict)

    @property
    def tree(self):
        return self.pipeline.stages[-1]

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Predictions in original units; input columns keep their values."""
        require_features(df, self.features)
        kept = F.struct(*df.columns).alias("__row")
        scaled = self.scaler.transform(df.select("*", kept))
        ready = training_rows(scaled.withColumn("__one", F.lit(1.0)), self.features, "__one")
        out = self.pipeline.transform(ready)
        return out.select("__row.*", F.col("prediction").alias("prediction_log")).withColumn(
            output, self.scaler.inverse_target("prediction_log"))

    def importance(self, spark: SparkSession) -> DataFrame:
        values = self.tree.featureImportances.toArray().tolist()
        rows = list(zip(self.features, values))
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.col("importance").desc(), "feature")


def prepare_training(
    df: DataFrame, scaler: Scaler, weight_mode: str | None = None, missing: str = "median",
    features: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Weighted, transformed, finite rows with a ``target`` column, and the feature list."""
    features = list(features or feature_columns(df, NOT_FEATURES))
    rows = df
    if weight_mode:
        rows = add_sample_weights(
            rows, weight_mode, missing, scaler.config.log_target, scaler.config.log_energy)
    rows = rows.withColumn("target", scaler.target("CrossSection"))
    scaler.fit(df, features)
    exclude = missing == "exclude"
    return training_rows(
        scaler.transform(rows), features, "target", impute=not exclude,
        weight="weight" if weight_mode else None), features


def _pipeline(estimator, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])


def _columns(estimator, weighted: bool):
    estimator = estimator.setFeaturesCol("features").setLabelCol("target")
    return estimator.setWeightCol("weight") if weighted else estimator


def decision_tree(weighted: bool = False, **params):
    if params.get("maxDepth", 5) > MAX_DEPTH:
        raise ValueError(f"maxDepth is at most {MAX_DEPTH}")
    return _columns(DecisionTreeRegressor(**{"seed": 42, **params}), weighted)


def boosted_trees(weighted: bool = False, **params):
    return _columns(GBTRegressor(**{**BOOSTED_DEFAULTS, **params}), weighted)


def _kept_rows(
    df: DataFrame, scaler: Scaler, weight_mode: str | None = None, missing: str = "median", features: Sequence[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Prepared rows, stored: a trainer scans them for its splits, every level and every metric.

    The raw columns are stored first. Their statistics take scans too, and features, scaling and
    filling in one projection are too much code for the JVM to compile.
    """
    features = list(features or feature_columns(df, NOT_FEATURES))
    keys = [c for c in ("fold", "draw") if c in df.columns]
    raw = [c for c in dict.fromkeys([*features, *RAW_COLUMNS, *keys]) if c in df.columns]
    rows, features = prepare_training(stored(df.select(*raw)), scaler, weight_mode, missing, features)
    used = dict.fromkeys([*features, "target", *(["weight"] if weight_mode else []), *keys])
    # The trainers keep a partition as objects in memory. Dealing the rows anew for every scan would
    # leave a copy of them in shuffle files each time.
    return stored(rows.select(*used), part_rows=PART_ROWS), features


def train(
    df: DataFrame, estimator, scaler: Scaler | None = None, weight_mode: str | None = None,
    missing: str = "median", test_fraction: float = 0.2, seed: int = 42, features: Sequence[str] | None = None,
) -> Model:
    """Fit on 80 %, report log and linear metrics on both parts."""
    scaler = scaler or Scaler()
    rows, features = _kept_rows(df, scaler, weight_mode, missing, features)
    return _train(rows, features, estimator, scaler, test_fraction, seed)


def _train(
    rows: DataFrame, features: list[str], estimator, scaler: Scaler, test_fraction: float = 0.2, seed: int = 42,
) -> Model:
    rows = rows.withColumn("__held", _held(features, test_fraction, seed))
    return _measured(_pipeline(estimator, features).fit(rows.filter(~F.col("__held"))), rows, features, scaler)


def _held(features: Sequence[str], test_fraction: float, seed: int) -> Column:
    """Whether a row is held out: a function of its values, so recomputing it gives the same rows."""
    return F.pmod(F.xxhash64(*features, "target", F.lit(seed)), F.lit(10_000)) < F.lit(int(test_fraction * 10_000))


def _measured(fitted: PipelineModel, rows: DataFrame, features: list[str], scaler: Scaler) -> Model:
    """The model with its metrics on the rows it was fitted on and on those held out (``__held``)."""
    model = Model(fitted, scaler, features)
    # Both parts, both spaces and the number of rows from one pass.
    predicted = fitted.transform(rows).select(F.col("__held").alias("held"), "target", "prediction")
    measured = predicted.groupBy("held").agg(
        F.count(F.lit(1)).alias("n"), *errors(F.col("target"), F.col("prediction"), "_log"),
        *errors(scaler.inverse_target("target"), scaler.inverse_target("prediction"), "_barns"))
    sides = {row["held"]: row.asDict() for row in measured.collect()}
    for name, held in (("train", False), ("test", True)):
        for space in ("_log", "_barns"):
            model.metrics |= {f"{name}_{k}{space}": sides.get(held, {}).get(f"{k}{space}") for k in ("mse", "mae", "r2")}
    tree = fitted.stages[-1]
    if hasattr(tree, "depth"):
        leaves = (tree.numNodes + 1) // 2
        model.metrics |= {"depth": tree.depth, "leaves": leaves, "samples_per_leaf": sides.get(False, {}).get("n", 0) / leaves}
    return model


def grid_maps(estimator, grid: dict[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(estimator, name), list(values))
    return builder.build()


def random_maps(estimator, space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n distinct draws from the grid (all of it when smaller)."""
    everything = grid_maps(estimator, space)
    return random.Random(seed).sample(everything, min(n, len(everything)))


# Splits by an integer key: any engine that knows the key knows the split. ``fold`` is the key
# modulo the folds; of the rest, the share ``draw`` in DRAWS grows a sample.
DRAWS = 10_000
HOLDOUT = (70, 85, 100)     # train, validation, test: key modulo 100 below


def with_folds(df: DataFrame, key: Column, folds: int) -> DataFrame:
    """Add ``fold`` and ``draw`` from an integer key; rows without a key fall into fold and draw 0."""
    key = F.coalesce(key.cast("long"), F.lit(0))
    return df.withColumns({
        "fold": F.pmod(key, F.lit(folds)).cast("int"),
        "draw": F.pmod(F.floor(key / folds), F.lit(DRAWS)).cast("int")})


def drawn_folds(df: DataFrame, folds: int, seed: int) -> DataFrame:
    """Add ``fold``, drawn by ``seed``. Stored with the rows, it stays what it was drawn as."""
    return df.withColumn("fold", F.floor(F.rand(seed) * folds).cast("int"))


@dataclass
class _Fits:
    """What the models of a search are fitted on and scored by: stored rows, or the cells of a tree's bins.

    A tree sees a row's bins only, so all it needs of the rows of one cell (equal bins) is their number,
    the mean of their targets and the squared distances from it (``within``). One scan of the rows
    makes the cells; no fit reads, or keeps, the rows again.
    """

    table: DataFrame
    stages: list
    cells: bool
    parallelism: int

    def fit(self, part: Column, estimator, maps: list[dict]) -> list[PipelineModel]:
        """A model of each map. A fit keeps its rows in memory and on disk: of many rows only one goes on at a time."""
        rows = self.table.filter(part)
        n = rows.count()
        if self.cells:
            total = rows.agg(F.sum("rows")).first()[0] or 0
            maps = [_of_weight(estimator, chosen, total) for chosen in maps]
            estimator = estimator.copy({estimator.weightCol: "rows"})
        pipe = Pipeline(stages=[self.stages[-1], estimator])
        with ThreadPool(self.parallelism if n <= FITS_ROWS else 1) as pool:
            fitted = pool.map(inheritable_thread_target(rows.sparkSession)(lambda chosen: pipe.fit(rows, chosen)), maps)
        return [PipelineModel([*self.stages, model.stages[-1]]) for model in fitted]

    def errors(self, part: Column, fitted: list[PipelineModel]) -> list[float]:
        """Mean squared error of every model from one pass."""
        out = self.stages[-1].transform(self.table.filter(part))
        for i, model in enumerate(fitted):
            out = model.stages[-1].copy().setPredictionCol(f"__p{i}").transform(out)
        away = [F.col("target") - F.col(f"__p{i}") for i in range(len(fitted))]
        if self.cells:
            return list(out.agg(*[F.sum(F.col("rows") * d * d + F.col("within")) / F.sum("rows") for d in away]).first())
        return list(out.agg(*[F.avg(d * d) for d in away]).first())


def _of_weight(estimator, chosen: dict, total: int) -> dict:
    """The map with its least number of rows in a node as their least weight, a cell weighing its rows."""
    least, share = ({**estimator.extractParamMap(), **chosen}[p] for p in (estimator.minInstancesPerNode, estimator.minWeightFractionPerNode))
    share = max(share, (least - 0.5) / total) if least > 1 else share
    out = {**chosen, estimator.minInstancesPerNode: 1, estimator.minWeightFractionPerNode: min(share, 0.4999)}
    return {**out, estimator.maxDepth: 0} if share >= 0.5 else out


def _bins(rows: DataFrame, features: Sequence[str], most: int) -> Bucketizer:
    """Bins of every feature: its values if there are few, else between ``most`` quantiles (rank error 1e-4)."""
    steps = [i / most for i in range(1, most)]
    column = {f: F.col(f"`{f}`").cast("double") for f in features}
    found = rows.agg(*[F.struct(
        F.approx_count_distinct(c).alias("kinds"), F.percentile_approx(c, steps, 10_000).alias("at")).alias(f"c{i}")
        for i, c in enumerate(column.values())]).first()
    inner = {f: sorted(set(cell["at"] or [])) for f, cell in zip(features, found, strict=True)}
    few = [f for f, cell in zip(features, found, strict=True) if cell["kinds"] <= 2 * most]
    if few:
        sets = rows.agg(*[F.collect_set(column[f]) for f in few]).first()
        inner |= {f: sorted(set(kinds))[1:] for f, kinds in zip(few, sets, strict=True) if len(kinds) <= most}
    ends = float("inf")
    # A bucketizer asks for two buckets at least.
    return Bucketizer(
        splitsArray=[[-ends, *(v for v in inner[f] or [0.0] if abs(v) < ends), ends] for f in features],
        inputCols=list(features), outputCols=[f"__bin_{f}" for f in features])


def _fits(rows: DataFrame, features: Sequence[str], estimator, maps: list[dict], keys: Sequence[str], parallelism: int) -> _Fits:
    """Cells for a decision tree over unweighted rows, the rows themselves for every other trainer.

    ``keys`` part the rows; no cell has rows of two parts.
    """
    plain = isinstance(estimator, DecisionTreeRegressor) and not estimator.isDefined(estimator.weightCol) and rows.count()
    if not plain or any(estimator.maxBins in m for m in maps):
        return _Fits(rows, [VectorAssembler(inputCols=list(features), outputCol="features")], False, parallelism)
    bins = _bins(rows, features, estimator.getMaxBins())
    names = bins.getOutputCols()
    cells = bins.transform(rows).groupBy(*keys, *names).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("target").alias("target"), (F.var_pop("target") * F.count(F.lit(1))).alias("within"))
    return _Fits(stored(cells), [bins, VectorAssembler(inputCols=names, outputCol="features")], True, parallelism)


def _cross_validated(fits: _Fits, estimator, maps: list[dict], folds: int) -> list[float]:
    """Mean over the folds (column ``fold``) of each map's squared error."""
    fold, scores = F.col("fold"), []
    for i in range(folds):
        if fits.table.filter(fold == i).isEmpty() or fits.table.filter(fold != i).isEmpty():
            raise ValueError(f"fold {i} has no rows to train on or to score")
        scores.append(fits.errors(fold == i, fits.fit(fold != i, estimator, maps)))
    return [sum(s) / folds for s in zip(*scores, strict=True)]


def _held_out(fits: _Fits, estimator, maps: list[dict]) -> tuple[list[float], list[float]]:
    """Validation and test scores of each map, rows split by ``fold`` in 0..99."""
    fold = F.col("fold")
    fitted = fits.fit(fold < HOLDOUT[0], estimator, maps)
    return fits.errors((fold >= HOLDOUT[0]) & (fold < HOLDOUT[1]), fitted), fits.errors(fold >= HOLDOUT[1], fitted)


def search(
    df: DataFrame, estimator, maps: list[dict], scaler: Scaler | None = None, folds: int = 3,
    fraction: float = 1.0, max_rows: int | None = None, validation: str = "cv", parallelism: int = 4, seed: int = 42,
    weight_mode: str | None = None, key: Column | None = None,
) -> tuple[Model, dict[str, Any]]:
    """Grid or random search on all rows (or a subsample, if asked), then a fit of the best on all rows.

    ``validation`` is 'cv' (k folds) or 'holdout' (70 % train, 15 % validation, the last
    15 % only for the reported test metric). With an integer ``key`` the splits follow from it
    (``with_folds``), else they are drawn by ``seed``.
    """
    scaler = scaler or Scaler()
    splits = 100 if validation == "holdout" else folds
    df = drawn_folds(df, splits, seed) if key is None else with_folds(df, key, splits)
    everything, features = _kept_rows(df, scaler, weight_mode)
    if weight_mode:
        estimator = estimator.copy({estimator.weightCol: "weight"})
    everything = everything.withColumn("__held", _held(features, 0.2, seed))
    rows, test = subsample(everything, fraction, max_rows), None
    fits = _fits(rows, features, estimator, maps, ["fold", "__held"], parallelism)
    if validation == "holdout":
        scores, tests = _held_out(fits, estimator, maps)
        test = tests[min(range(len(maps)), key=lambda i: scores[i])]
    else:
        scores = _cross_validated(fits, estimator, maps, folds)
    best = maps[min(range(len(maps)), key=lambda i: scores[i])]
    chosen = {p.name: v for p, v in best.items()}
    if rows is not everything:
        fits = _fits(everything, features, estimator, maps, ["__held"], parallelism)
    model = _measured(fits.fit(~F.col("__held"), estimator, [best])[0], everything, features, scaler)
    return model, {"best": chosen, "score": min(scores), "test_mse": test,
                   "scores": [({p.name: v for p, v in m.items()}, s) for m, s in zip(maps, scores, strict=True)]}


def successive_halving(
    df: DataFrame, estimator, maps: list[dict], scaler: Scaler | None = None, factor: int = 3,
    min_rows: int = 1000, folds: int = 3, seed: int = 42, key: Column | None = None,
) -> tuple[Model, dict[str, Any]]:
    """Keep the best third on a sample that grows threefold, until one is left.

    With an integer ``key``, sample and folds follow from it: a round takes the rows whose ``draw``
    is below its share.
    """
    scaler = scaler or Scaler()
    df = drawn_folds(df, folds, seed) if key is None else with_folds(df, key, folds)
    rows, features = _kept_rows(df, scaler)
    total, size, left, rounds = rows.count(), min_rows, list(maps), []
    while len(left) > 1:
        if key is None:
            part = subsample(rows, 1.0, min(size, total), seed)
        else:
            part = rows.filter(F.col("draw") < F.lit(-(-DRAWS * size // max(total, 1))))
        scores = _cross_validated(_fits(part, features, estimator, left, ["fold"], 1), estimator, left, folds)
        rounds.append([({p.name: v for p, v in m.items()}, s) for m, s in zip(left, scores, strict=True)])
        ranked = sorted(range(len(left)), key=lambda i: scores[i])
        left = [left[i] for i in ranked[: max(1, len(left) // factor)]]
        size *= factor
    return _train(rows, features, estimator.copy(left[0]), scaler), {"best": {p.name: v for p, v in left[0].items()}, "rounds": rounds}


def save_experiment(
    model: Model, spark: SparkSession, path: str, selection: Any = None, holdout: Any = None, **extra: Any
) -> None:
    """Model folder plus one JSON of everything else; an untrained model is refused."""
    if model.pipeline is None:
        raise RuntimeError("train the model before saving it")
    model.pipeline.write().overwrite().save(f"{path}/model")
    tree = model.tree
    save_json(spark, f"{path}/properties", {
        "params": {p.name: v for p, v in tree.extractParamMap().items() if isinstance(v, (int, float, str, bool))},
        "features": model.features, "metrics": model.metrics, "scaler": model.scaler.params(),
        "selection": _plain(selection), "holdout": _plain(holdout), "extra": extra,
    })


def _plain(value: Any) -> Any:
    return asdict(value) if hasattr(value, "__dataclass_fields__") else value


def load_experiment(spark: SparkSession, path: str) -> tuple[Model, dict[str, Any]]:
    properties = load_json(spark, f"{path}/properties")
    model = Model(
        PipelineModel.load(f"{path}/model"), Scaler.from_params(properties["scaler"]),
        properties["features"], properties["metrics"])
    return model, properties
