"""Model pipeline, metrics and persistence."""
import tempfile

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from fixture_dirs import SF_SMALL
from txnrisk.operators import metrics as M
from txnrisk.operators import ml as ML
from txnrisk.operators.features import engineer_features
from txnrisk.sources.fixtures import txn_events
from txnrisk.sources.ingest import clean_processor


@pytest.fixture(scope="module")
def feats(spark):
    return engineer_features(txn_events(spark, SF_SMALL), amount_scale=2).cache()


def test_feature_contract_is_complete(feats):
    c = ML.feature_contract(feats.columns)
    assert c["missing"] == [] and c["extra"] == []
    assert len(c["numeric"]) == 13 and len(c["categorical"]) == 11


def test_class_weights_sum_to_n(feats):
    w = ML.with_class_weight(feats)
    total = w.agg(F.sum("class_weight")).first()[0]
    assert total == pytest.approx(feats.count())


def test_split_is_exact_and_stratified(feats):
    s = ML.stratified_split(feats)
    n = feats.count()
    test = s.filter(F.col("split") == "test")
    assert test.count() == -(-3 * n // 10)
    by_class = {r.is_fraud: r["count"] for r in test.groupBy("is_fraud").count().collect()}
    total = {r.is_fraud: r["count"] for r in feats.groupBy("is_fraud").count().collect()}
    for c, k in total.items():
        assert abs(by_class.get(c, 0) - 0.3 * k) <= 1


def test_fit_score_persist_and_unseen_category(spark, feats):
    split = ML.stratified_split(feats)
    model = ML.fit_model(split.filter("split = 'train'").drop("split"), max_iter=30)
    test = split.filter("split = 'test'").drop("split")
    p = ML.fraud_probability(model, test)
    probs = [r.fraud_probability for r in p.collect()]
    assert all(0.0 <= x <= 1.0 for x in probs)
    path = tempfile.mkdtemp(prefix="txnrisk-model-") + "/m"
    ML.save_model(model, path)
    again = ML.fraud_probability(ML.load_model_or_none(path), test)
    assert sorted(r.fraud_probability for r in again.collect()) == sorted(probs)
    assert ML.load_model_or_none(path + "-absent") is None
    # a category never seen in training scores without error (all-zero one-hot)
    odd = test.limit(3).withColumn("transaction_type", F.lit("never-seen")).withColumn("device_type", F.lit(None).cast("string"))
    assert ML.fraud_probability(model, odd).count() == 3


def test_auc_matches_spark_evaluator(spark, feats):
    scored = feats.select(F.col("is_fraud").cast("double").alias("label"),
                          F.floor(F.col("amount") / 10).cast("double").alias("score"))
    ours = M.roc_auc(scored).first()[0]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    assert ours == pytest.approx(ev.evaluate(scored), abs=1e-12)
    flipped = M.roc_auc(scored.withColumn("score", -F.col("score"))).first()[0]
    assert ours + flipped == pytest.approx(1.0)
    assert 0.0 <= M.pr_auc(scored).first()[0] <= 1.0


def test_auc_undefined_for_one_class(spark):
    df = spark.createDataFrame([(1.0, 0.3), (1.0, 0.7)], "label double, score double")
    assert M.roc_auc(df).first()[0] is None


def test_exact_quantile_matches_interpolation(spark):
    from txnrisk.operators.ranking import exact_quantile, smallest_k
    vals = [float(x) for x in [5, 1, 9, 3, 3, 7, 2, 8]]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    s = sorted(vals)
    pos = (len(s) - 1) * 0.95
    want = s[int(pos)] + (s[int(pos) + 1] - s[int(pos)]) * (pos - int(pos))
    assert exact_quantile(df, "v", 0.95) == pytest.approx(want)
    ids = spark.range(100).withColumn("k", F.col("id") % 10)
    got = sorted(r.id for r in smallest_k(ids, "k", 25, "id").collect())
    assert got == sorted(i for i in range(100) if (i % 10, i) < (2, 50))[:25]


def test_score_latest_without_model(spark):
    from txnrisk.sources.ingest import clean_processor
    out = ML.score_latest(clean_processor(txn_events(spark, SF_SMALL)), None)
    rows = out.collect()
    assert len(rows) == 10 and all(r.fraud_probability is None for r in rows)


def test_renumber_with_a_hot_value(spark):
    from txnrisk.operators.metrics import renumber_by
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id")).cast("long").alias("o"),
        (F.lit(n) - F.col("id")).alias("t"))
    got = {(r.o, r.t): r.row_number for r in renumber_by(df, "o", "t").collect()}
    want = {k: i for i, k in enumerate(sorted(got))}
    assert got == want


def test_coefficient_sign_on_separable_data(spark):
    """Fraud iff amount is large: the fitted amount coefficient is positive and
    the probabilities separate the classes."""
    import datetime as dt

    from txnrisk.schema import TXN_SCHEMA
    rows = []
    for i in range(200):
        fraud = int(i % 4 == 0)
        amount = 900.0 + i if fraud else 10.0 + (i % 50)
        rows.append((i, amount, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 20, i % 5, 1 + i % 19,
                     1 + i % 30, "purchase", "mobile", "USA", fraud))
    f = engineer_features(spark.createDataFrame(rows, TXN_SCHEMA), amount_scale=2)
    model = ML.fit_model(f)
    lr = model.stages[-1]
    assert lr.coefficients[0] > 0          # first numeric input is amount
    p = {r.is_fraud: r.p for r in ML.fraud_probability(model, f).groupBy("is_fraud")
         .agg(F.avg("fraud_probability").alias("p")).collect()}
    assert p[1] > 0.9 and p[0] < 0.1


def test_roc_auc_of_large_counts(spark, monkeypatch):
    """Products of class counts beyond a BIGINT."""
    from pyspark.sql import functions as F
    from txnrisk.operators import metrics as M
    points = spark.createDataFrame([(0.9, 5 * 10**9, 0, 5 * 10**9, 0, 0, 0), (0.1, 0, 5 * 10**9, 5 * 10**9, 5 * 10**9, 5 * 10**9, 0)],
                                   "threshold double, pos long, neg long, tp long, fp long, prev_tp long, prev_fp long")
    points = points.withColumns({"P": F.lit(5 * 10**9), "N": F.lit(5 * 10**9)})
    monkeypatch.setattr(M, "score_points", lambda *a: points)
    assert M.roc_auc(None).first()[0] == 1.0


def test_renumbering_spreads_a_hot_value(spark):
    from pyspark.sql import functions as F
    from txnrisk.operators.metrics import renumber_by
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("t"), (F.col("id") * 7 % 3001).alias("id"))
    got = renumber_by(df, "t", "id").collect()
    assert [r.row_number for r in sorted(got, key=lambda r: (r.t, r.id))] == list(range(3000))


def test_many_levels_nulls_and_unseen_ids_train(spark):
    """More than 10 000 users, rows without a user, and a user that training has not seen."""
    import numpy as np
    from pyspark.sql import functions as F
    f = engineer_features(txn_events(spark, SF_SMALL), amount_scale=2)
    wide = f.crossJoin(spark.range(12).withColumnRenamed("id", "_copy")).withColumns({
        "transaction_id": F.col("transaction_id") * 12 + F.col("_copy"),
        "user_id": F.when(F.col("transaction_id") % 50 != 0, F.col("transaction_id") * 12 + F.col("_copy")),
        "user_avg_amount": F.when(F.col("transaction_id") % 50 != 0, F.col("user_avg_amount"))}).drop("_copy")
    model = ML.fit_model(wide, max_iter=3)
    lr = model.stages[-1]
    assert lr.numFeatures > 10_000 and np.isfinite(lr.coefficients.toArray()).all()
    unseen = wide.limit(1).withColumn("user_id", F.lit(-5))
    width = model.transform(unseen).first()["_user_id_vec"]
    assert width.numNonzeros() == 0


def test_a_model_whose_inputs_are_missing_is_unavailable(spark):
    from txnrisk.operators import dashboard as D
    clean = clean_processor(txn_events(spark, SF_SMALL))
    bad = ML.FixedModel(0.0, {"no_such_feature": 1.0})
    assert ML.score_latest(clean, bad).filter("fraud_probability is not null").count() == 0
    raw = clean.withColumn("row_id", clean.transaction_id)
    doc = D.dashboard_payload(raw, "x", engineered=engineer_features(raw), model=bad).first()[0]
    assert '"available":false' in doc


def test_payload_order_is_the_order_of_latest_rows(spark):
    import json
    from txnrisk.operators import dashboard as D
    rows = [(1, 5.0, "2024-01-02", 1), (2, 5.0, "not-a-date", 1), (3, 5.0, "2024-01-02", 1)]
    raw = spark.createDataFrame(rows, "transaction_id long, amount double, date string, organization_id long")
    raw = raw.withColumn("row_id", raw.transaction_id)
    doc = json.loads(D.dashboard_payload(raw, "x", engineered=engineer_features(clean_processor(raw))).first()[0])
    assert [x["transaction_id"] for x in doc["latest_transactions"]] == [3, 1, 2] == [r.transaction_id for r in D.latest_transactions(raw).collect()]
    assert doc["fraud_by_type"] == [{"transaction.type": "unknown", "is_fraud": 0}]


def test_a_model_scores_in_a_session_that_observed_a_metric(spark):
    import datetime as dt

    from pyspark.sql import Observation
    from txnrisk.schema import TXN_SCHEMA
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    rows = [(i, 900.0 if i % 4 == 0 else 10.0 + i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 5, i % 3, 1, 1, "purchase", "mobile", "USA", int(i % 4 == 0)) for i in range(40)]
    f = engineer_features(spark.createDataFrame(rows, TXN_SCHEMA), amount_scale=2)
    assert len(ML.fraud_probability(ML.fit_model(f, max_iter=3), f).collect()) == 40


def test_the_solvers_tasks_do_not_grow_with_the_rows():
    """Each task's gradient is as long as the coefficients, which grow with the rows too."""
    assert ML.solver_tasks(0, 8) == 1 and ML.solver_tasks(200_000, 8) == 4
    assert ML.solver_tasks(4_200_000, 12) == ML.solver_tasks(25_200_000, 12) == 24
    assert ML.solver_tasks(100_000_000, 12) * ML.MOST_ROWS_PER_TASK >= 100_000_000


def test_standard_scale_scales_every_numeric_column_of_every_row(spark, tmp_path):
    """All 13 numeric columns against numpy: NULL stays NULL and counts in no statistic, a column of one value is 0."""
    import datetime as dt

    import numpy as np
    from txnrisk.plans import catalog
    from txnrisk.schema import NUMERIC_FEATURES
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=5 * i, seconds=i * i), None if i % 10 == 0 else i % 4, "view", 1.25 * (i * 7 % 31 + 1), '{"k": 27}') for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.transaction_id: r for r in catalog.queries()["standard_scale"](spark, str(tmp_path)).collect()}
    feats = {r.transaction_id: r for r in engineer_features(txn_events(spark, str(tmp_path)), amount_scale=2).collect()}
    assert sorted(got) == sorted(feats) == list(range(60))
    for c in NUMERIC_FEATURES:
        x = np.array([feats[i][c] for i in range(60)], dtype=float)     # NULL as NaN
        want = np.zeros(60) if np.nanmin(x) == np.nanmax(x) else (x - np.nanmean(x)) / np.nanstd(x)
        np.testing.assert_allclose(np.array([got[i][f"{c}_scaled"] for i in range(60)], dtype=float), want, atol=1e-6, err_msg=c)
    assert {got[i].user_avg_amount_scaled for i in range(0, 60, 10)} == {None}
    assert {r.org_max_amount_scaled for r in got.values()} == {0.0}
