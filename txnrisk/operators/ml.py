"""Model training, scoring, evaluation and persistence.

The reference used a scikit-learn pipeline (standard scaling, one-hot
encoding, class-balanced L2 logistic regression, liblinear). This is the
same model as a Spark ML ``Pipeline``:

* numeric features: NULL counts as 0 (a row without a user has no user
  average), → ``VectorAssembler`` → ``StandardScaler`` (mean/std);
* categorical features → ``StringIndexer(handleInvalid='keep')`` →
  ``OneHotEncoder(dropLast=True)``: the extra "unseen" index is the dropped
  slot, so an unseen category encodes as all zeros (like
  ``handle_unknown='ignore'``). The same encoding at any number of levels; the
  labels are as many as the model's coefficients, which the solver holds too;
* ``LogisticRegression`` with per-row weights ``n / (2·n_class)`` and
  ``regParam = 1/Σw`` — the same objective as C=1 with balanced classes.

Spark's ``StandardScaler`` uses the sample standard deviation (sklearn the
population one): the factor √((n-1)/n) only rescales the coefficients.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.operators.labels import hash_key60
from txnrisk.operators.ranking import value_at_rank
from txnrisk.schema import CATEGORICAL_FEATURES, NON_FEATURE_COLUMNS, NUMERIC_FEATURES, SEED, SPLIT_TEST_FRACTION
from txnrisk.session import checkpoint_dir

# liblinear's defaults (the reference's solver): tolerance 1e-4, at most 100 iterations
SOLVER_TOL = 1e-4
SOLVER_MAX_ITER = 100
# An iterative solver pays a per-task cost every pass: no task gets fewer rows. A task's gradient is as long as
# the coefficients, which grow with the rows, so tasks stay at a few per core until one would hold MOST_ROWS_PER_TASK.
ROWS_PER_TASK = 50_000
MOST_ROWS_PER_TASK = 2_000_000
TASKS_PER_CORE = 2


# --- P2 / P8 ----------------------------------------------------------------------

def feature_contract(columns: list[str], numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> dict:
    """Compare the engineered columns with the declared feature lists.

    Returns ``missing`` (engineered but undeclared), ``extra`` (declared but not
    engineered) and the lists shrunk to the columns that exist."""
    have = set(columns) - set(NON_FEATURE_COLUMNS)
    declared = set(numeric) | set(categorical)
    return {
        "missing": sorted(have - declared),
        "extra": sorted(declared - have),
        "numeric": [c for c in numeric if c in have],
        "categorical": [c for c in categorical if c in have],
    }


def model_input(engineered: DataFrame) -> DataFrame:
    """The model's input columns (labels and ids removed)."""
    return engineered.drop(*[c for c in NON_FEATURE_COLUMNS if c in engineered.columns])


# --- A9 / M1 ----------------------------------------------------------------------

def with_class_weight(df: DataFrame, label: str = "is_fraud", out: str = "class_weight") -> DataFrame:
    """Balanced class weight ``n / (n_classes · n_class)`` per row. The class
    table has one row per label value, so broadcasting it is bounded."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = counts.select(
        label,
        (F.sum("_nc").over(_whole()) / (F.count(F.lit(1)).over(_whole()) * F.col("_nc"))).alias(out),
    )
    return df.join(F.broadcast(w), label, "left")


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()


def _allocate(counts: dict, n_test: int) -> dict:
    """Per-class test counts: floor of the proportional share, remainder to the
    largest fractional parts (ties: larger class, then smaller label)."""
    n = sum(counts.values())
    share = {c: n_test * k / n for c, k in counts.items()}
    alloc = {c: math.floor(s) for c, s in share.items()}
    rest = n_test - sum(alloc.values())
    order = sorted(counts, key=lambda c: (-(share[c] - alloc[c]), -counts[c], c))
    for c in order[:rest]:
        alloc[c] += 1
    return alloc


def stratified_split(df: DataFrame, label: str = "is_fraud", test_fraction: float = SPLIT_TEST_FRACTION,
                     seed: int = SEED, tid: str = "transaction_id") -> DataFrame:
    """M1: adds ``split`` ('train'/'test'). ``ceil(test_fraction·n)`` rows are
    test, allocated to classes in proportion; inside a class the rows with
    the smallest ``md5(seed:split:id)`` are test. Each class's cut-off is an
    exact order statistic (see ``ranking.value_at_rank``)."""
    h = hash_key60(f"{seed}:split", tid)
    x = df.withColumn("_h", h)
    counts = {r[label]: r["count"] for r in x.groupBy(label).count().collect()}
    n = sum(counts.values())
    alloc = _allocate(counts, math.ceil(test_fraction * n)) if n else {}
    test = F.lit(False)
    for c, t in alloc.items():
        if t <= 0:
            continue
        v = value_at_rank(x.filter(F.col(label) == F.lit(c)), "_h", t - 1)
        test = F.when(F.col(label) == F.lit(c), F.col("_h") <= F.lit(v)).otherwise(test)
    return x.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_h")


# --- M2–M5 ------------------------------------------------------------------------

def standard_scale(df: DataFrame, cols: list[str], suffix: str = "_scaled") -> DataFrame:
    """M2 as columns: ``(x - mean) / std_pop`` per column (sklearn's scaler).

    The statistics are scalar subqueries over ``df``; Spark merges them into
    one aggregate pass and ships the scalars with the tasks (no join)."""
    out = {}
    for c in cols:
        mean = df.select(F.avg(c)).scalar()
        std = df.select(F.stddev_pop(c)).scalar()
        out[f"{c}{suffix}"] = F.when(std == 0, F.lit(0.0)).otherwise((F.col(c) - mean) / std)
    return df.withColumns(out)


class PlainLogisticRegression(LogisticRegression):
    """Spark's solver; the model is written and read back, which leaves out the training summary.

    The summary holds the session, which Spark sends with the scoring function,
    and a session that has observed a metric once can't be sent."""

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        path = f"{checkpoint_dir(dataset.sparkSession).rstrip('/')}/model-{uuid.uuid4().hex}"
        super()._fit(dataset).write().save(path)
        return LogisticRegressionModel.load(path)


def build_pipeline(numeric: list[str], categorical: list[str], label: str = "is_fraud", weight: str = "class_weight",
                   reg_param: float = 0.0, max_iter: int = SOLVER_MAX_ITER, tol: float = SOLVER_TOL) -> Pipeline:
    """M2–M5 as one Spark ML pipeline."""
    filled = ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), 0.0D) AS `_{c}_num`" for c in numeric)
    idx, vec = [f"_{c}_idx" for c in categorical], [f"_{c}_vec" for c in categorical]
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_{c}_num" for c in numeric], outputCol="_num", handleInvalid="error"),
        StandardScaler(inputCol="_num", outputCol="_num_s", withMean=True, withStd=True),
        StringIndexer(inputCols=categorical, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True, handleInvalid="error"),
        VectorAssembler(inputCols=["_num_s", *vec], outputCol="features"),
        PlainLogisticRegression(featuresCol="features", labelCol=label, weightCol=weight,
                                regParam=reg_param, elasticNetParam=0.0, standardization=False,
                                maxIter=max_iter, tol=tol, family="binomial"),
    ])


def solver_tasks(rows: int, cores: int) -> int:
    """The solver's partitions: their number does not grow with the rows between the two bounds on a task's rows."""
    return max(1, min(math.ceil(rows / ROWS_PER_TASK), max(TASKS_PER_CORE * cores, math.ceil(rows / MOST_ROWS_PER_TASK))))


def fit_model(train: DataFrame, label: str = "is_fraud", max_iter: int = SOLVER_MAX_ITER) -> PipelineModel:
    """M5: fit the balanced, L2-regularised pipeline on engineered rows.

    The weighted training set is read by several passes (scaler, indexers,
    every solver iteration): it is persisted once, in ``solver_tasks`` partitions.
    """
    from pyspark import StorageLevel

    contract = feature_contract(train.columns)
    numeric, categorical = contract["numeric"], contract["categorical"]
    weighted = with_class_weight(train, label).withColumn(label, F.col(label).cast(T.DoubleType()))
    n = weighted.count()
    data = weighted.repartition(solver_tasks(n, train.sparkSession.sparkContext.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return build_pipeline(numeric, categorical, label, reg_param=(1.0 / n) if n else 0.0, max_iter=max_iter).fit(data)
    finally:
        data.unpersist()


@dataclass(frozen=True)
class FixedModel:
    """A logistic model given by its coefficients over numeric columns (NULL counts as 0)."""

    intercept: float
    weights: dict[str, float]


def can_score(model, df: DataFrame) -> bool:
    """Whether ``df`` has the columns that the model reads, numeric where it needs numbers."""
    have = {f.name: f.dataType for f in df.schema}
    if isinstance(model, FixedModel):
        return all(isinstance(have.get(c), T.NumericType) for c in model.weights)
    contract = feature_contract(df.columns)
    if contract["extra"]:
        return False
    try:
        model.transform(df)     # analysis only: columns and types
    except AnalysisException:
        return False
    return all(isinstance(have[c], T.NumericType) for c in contract["numeric"])


def fraud_probability(model: PipelineModel | FixedModel, df: DataFrame) -> DataFrame:
    """M6/M7: adds ``prediction`` (0/1) and ``fraud_probability`` (P(class 1))."""
    if isinstance(model, FixedModel):
        z = sum((F.lit(w) * F.coalesce(F.col(c).cast(T.DoubleType()), F.lit(0.0)) for c, w in model.weights.items()), F.lit(model.intercept))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return df.withColumns({"prediction": (p > 0.5).cast(T.IntegerType()), "fraud_probability": p})
    cols = df.columns
    out = model.transform(df)
    return out.select(*cols,
                      F.col("prediction").cast(T.IntegerType()).alias("prediction"),
                      vector_to_array("probability")[1].alias("fraud_probability"))


# --- S10 -------------------------------------------------------------------------------

def save_model(model: PipelineModel, path: str) -> str:
    """Publish ``model`` under ``path``: its files go to a folder of their own,
    and only then one row of the manifest names that folder. A reader gets the
    model before or this one, never half of it; a save that is lost on the way
    leaves a folder that nothing names."""
    spark, version = SparkSession.active(), uuid.uuid4().hex
    model.write().save(f"{path}/versions/{version}")
    number = max((r["number"] for r in _published(path)), default=0) + 1
    spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return path


def _published(path: str) -> list:
    """The manifest's rows, newest first; one per save."""
    try:
        return SparkSession.active().read.schema("number long, version string").parquet(f"{path}/manifest") \
            .orderBy(F.desc("number"), F.desc("version")).collect()
    except AnalysisException:   # nothing published yet
        return []


def load_model_or_none(path: str) -> PipelineModel | None:
    """The newest published pipeline, or None when there is none or it is
    unreadable ("predictions unavailable")."""
    try:
        return PipelineModel.load(f"{path}/versions/{_published(path)[0]['version']}")
    except Exception:  # noqa: BLE001 — any load failure means "no model"
        return None


# --- M9 ------------------------------------------------------------------------------

def score_latest(clean: DataFrame, model: PipelineModel | FixedModel | None, n: int = 10,
                 context: str = "full", **features) -> DataFrame:
    """M9: the ``n`` latest transactions with their fraud probability.

    ``context='full'`` gives them the features they have among all rows: the
    ``n`` rows are taken first, and the windows run over the rows of their (at
    most n) users and organizations, a filter that reaches the scan.
    ``'latest'`` computes features from the ``n`` rows alone, as the reference
    did. Probabilities stay attached to their own row (no positional
    assignment). Without a model, or with one whose inputs are not there,
    ``fraud_probability`` is NULL.
    """
    from txnrisk.operators.dashboard import latest_transactions
    from txnrisk.operators.features import engineer_features

    if context == "full":
        top = latest_transactions(clean, n).select("user_id", "organization_id", "transaction_id").collect()   # n rows
        related = F.lit(False)
        for c in ("user_id", "organization_id", "transaction_id"):
            values = sorted({r[c] for r in top if r[c] is not None})
            related = related | F.coalesce(F.col(c).isin(values), F.lit(False)) if values else related
        latest = latest_transactions(engineer_features(clean.filter(related), keep_date=True, **features), n)
    else:
        latest = engineer_features(latest_transactions(clean, n), keep_date=True, **features)
    if model is None or not can_score(model, latest):
        return latest.withColumn("fraud_probability", F.lit(None).cast(T.DoubleType()))
    return fraud_probability(model, latest).drop("prediction")
