"""Logistic regression whose coefficients are a table, against Spark's solver and by its gradient."""
import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txnrisk.operators import logistic as LG
from txnrisk.operators import ml as ML

NUMERIC, CATEGORICAL = ["a", "b", "flat"], ["kind", "place"]


def rows(spark, n=200, seed=4):
    rnd = random.Random(seed)
    made = []
    for i in range(n):
        a, kind = rnd.gauss(50, 20), rnd.choice(["x", "x", "x", "y", "z", None])
        b = None if i % 17 == 0 else a / 3 + rnd.random()
        y = int(rnd.random() < 1 / (1 + math.exp(-(a - 60) / 12 + (kind == "y"))))
        made.append((i, a, b, 3.0, kind, str(rnd.randrange(20)), y))
    return spark.createDataFrame(made, "id long, a double, b double, flat double, kind string, place string, is_fraud int").repartition(3, "id")


@pytest.fixture(scope="module")
def fitted(spark):
    df = rows(spark)
    return df, LG.fit_table_model(df, numeric=NUMERIC, categorical=CATEGORICAL)


def test_coefficients_equal_the_solver(spark, fitted):
    df, model = fitted
    weighted = ML.with_class_weight(df).withColumn("is_fraud", F.col("is_fraud").cast("double"))
    theirs = ML.build_pipeline(NUMERIC, CATEGORICAL, reg_param=1 / df.count(), max_iter=2000, tol=1e-13).fit(weighted)
    labels = dict(zip(CATEGORICAL, theirs.stages[3].labelsArray, strict=True))
    names = [(c, None) for c in NUMERIC] + [(c, v) for c in CATEGORICAL for v in labels[c]]
    want = dict(zip(names, theirs.stages[-1].coefficients, strict=True)) | {(LG.INTERCEPT, None): theirs.stages[-1].intercept}
    got = {(r["feature"], r["level"]): r["weight"] for r in model.named().collect()}
    want.pop(("flat", None))            # a constant has no entry and so no coefficient
    assert got == pytest.approx(want, abs=1e-4)
    assert model.gradient_norm < 1e-3 and model.iterations < LG.MAX_ITER
    unseen = df.unionByName(df.limit(1).withColumns({"id": F.lit(-1).cast("long"), "kind": F.lit("new"), "a": F.lit(None).cast("double")}))
    ours = {r["id"]: (r["prediction"], r["fraud_probability"]) for r in LG.table_probability(model, unseen).collect()}
    other = {r["id"]: r["p"] for r in theirs.transform(unseen).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert {k: p for k, (_, p) in ours.items()} == pytest.approx(other, abs=1e-4)
    assert all(pred == int(p > 0.5) for pred, p in ours.values())


def test_frequent_places_are_bounded(spark, fitted):
    _, model = fitted
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = model.coefficients.filter("frequent").count()
    assert 0 < frequent <= parts * (len(NUMERIC) + len(CATEGORICAL) + 1) and frequent < model.coefficients.count()


def test_driver_rows_do_not_grow_with_levels(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    seen, plain = [], DataFrame.collect

    def counted(self):
        out = plain(self)
        seen.append(len(out))
        return out

    df = spark.range(30_000).select(F.col("id").cast("string").alias("user"), (F.hash("id") % 7).cast("double").alias("a"),
                                    (F.pmod(F.hash("id", F.lit(1)), F.lit(5)) == 0).cast("int").alias("is_fraud"))
    monkeypatch.setattr(DataFrame, "collect", counted)
    model = LG.fit_table_model(df, numeric=["a"], categorical=["user"], max_iter=1)
    assert seen and max(seen) <= 2
    assert model.dictionary.width == 30_000 and model.coefficients.count() == 30_002


def test_no_rows_and_one_class(spark):
    df = rows(spark, 20)
    empty = LG.fit_table_model(df.limit(0), numeric=NUMERIC, categorical=CATEGORICAL)
    assert empty.named().count() == 0
    assert {r["fraud_probability"] for r in LG.table_probability(empty, df).collect()} == {0.5}
    odd = LG.fit_table_model(df.withColumn("is_fraud", F.when(F.col("id") % 2 == 0, F.lit(1))), numeric=NUMERIC, categorical=CATEGORICAL, max_iter=2)
    assert all(r["fraud_probability"] > 0.5 for r in LG.table_probability(odd, df).collect())


def test_rows_meet_their_residual_in_one_row_each(spark):
    from txnrisk.operators import logistic as LG
    from txnrisk.operators.dictionary import build_dictionary
    df = spark.createDataFrame([(0, "a", 2.0), (1, "b", 4.0), (2, None, None)], "_row long, kind string, x double")
    packed = LG._packed(df, build_dictionary(df, ["kind"]), {"x": (2.0, 2.0)})
    assert packed.count() == 3
    entries = sorted(tuple(r) for r in LG._entries(packed).select("row", "place", "value").collect())
    assert entries == [(0, 0, 1.0), (0, 3, 1.0), (1, 1, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 2, -1.0), (2, 3, 1.0)]
