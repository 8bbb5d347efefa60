"""A hot key (a third of all rows in one organization) stays correct and split."""
import pytest
from pyspark.sql import functions as F

from fixture_dirs import SF_CHECK
from txnrisk.operators import ranked
from txnrisk.operators.features import _US, HOUR_US, emitted, engineer_features
from txnrisk.operators.ranking import in_ranges
from txnrisk.session import materialize
from txnrisk.sources.fixtures import txn_events


def hot(spark):
    t = txn_events(spark, SF_CHECK)
    return t.withColumn("organization_id",
                        F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(F.col("organization_id")))


def test_hot_key_results_equal_direct_windows(spark):
    src = hot(spark)
    share = src.filter("organization_id = 0").count() / src.count()
    assert share > 0.3
    a = engineer_features(src, amount_scale=2).orderBy("transaction_id").collect()
    b = engineer_features(src, amount_scale=2, strategy="window").orderBy("transaction_id").collect()
    assert a == b


def within_one_hour(spark):
    """90 % of the rows of organization 0, most of them of user 1, and all within one hour; ties, days before and after, nulls."""
    n = F.col("id")
    hot = n % 10 != 0
    us = F.when(hot, n * 7919 % 3600 * F.lit(1_000_000) + F.when(n % 3 == 0, n % 1000).otherwise(F.lit(0))) \
        .otherwise(n * 104_729 % 500_000 * F.lit(1_000_000) - F.lit(200_000_000_000))
    return spark.range(4000).select(
        F.when(n % 501 != 7, n).alias("transaction_id"), n.alias("row_id"),
        F.when(n % 97 != 3, (n * 31 % 9973) / F.lit(100)).alias("amount"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + us).alias("date"),
        F.when(n % 83 == 5, None).when(hot & (n % 4 != 0), F.lit(1)).otherwise(n % 13).alias("user_id"),
        F.when(n % 89 == 6, None).when(hot, F.lit(0)).otherwise(n % 7).alias("organization_id"))


@pytest.mark.parametrize("block", [1024, 8])
def test_ranked_features_of_a_hot_hour_equal_direct_windows(spark, monkeypatch, block):
    monkeypatch.setattr(ranked.key_features, "__defaults__", (block,))
    src = materialize(within_one_hour(spark))
    assert src.filter("organization_id = 0").count() / src.count() > 0.85
    a = engineer_features(src, seq="row_id", amount_scale=2, strategy="ranked").orderBy("row_id").collect()
    b = engineer_features(src, seq="row_id", amount_scale=2, strategy="window").orderBy("row_id").collect()
    assert a == b
    assert max(r["rolling_count_24hr_user"] for r in a) > 1000


def test_ranked_units_are_bounded(spark):
    rows = materialize(within_one_hour(spark).select(F.col("row_id").alias("rid"), F.col("organization_id").alias("k"), F.unix_micros("date").alias("us"), F.col("row_id").alias("seq"),
                                                     "amount", F.round(F.col("amount") * 100).cast("long").alias("units"), F.lit(1).cast("long").alias("has_tid")))
    n, parts = rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = in_ranges(rows, [F.col(c) for c in ("k", "us", "seq", "rid")], "_part", "_local")
    assert ranges.groupBy("_part", "k").count().agg(F.max("count")).first()[0] < 2 * n / parts
    x = ranked.in_blocks(ranked.ordered_rows(rows), 64)
    assert x.groupBy("k", "blk").count().agg(F.max("count")).first()[0] == 64
    starts = ranked.frame_starts(x, 64)
    assert starts.filter("blk - a_blk > 1").select("k", "a_blk", "blk").distinct().count() <= 2 * x.select("k", "blk").distinct().count()


def units(src, width_us):
    """Emitted rows and the largest (key, block) unit for the organization key."""
    x = src.withColumn(_US, F.unix_micros("date")).select("organization_id", _US, "transaction_id")
    e = emitted(x, "organization_id", ["organization_id", _US], "_o_", width_us)
    return e.count(), e.groupBy("organization_id", "_o_blk").count().agg(F.max("count")).first()[0]


def test_a_unit_falls_with_the_width_and_rows_are_emitted_thrice(spark):
    src = hot(spark)
    n = src.count()
    sizes = []
    for hours in (8, 4, 2, 1):
        rows, largest = units(src, hours * HOUR_US)
        assert rows <= 3 * n
        sizes.append(largest)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] * 3 < sizes[0]


def test_every_width_gives_the_same_features(spark):
    src = hot(spark)
    want = engineer_features(src, amount_scale=2, strategy="window").orderBy("transaction_id").collect()
    for width in (8 * HOUR_US, HOUR_US // 4):
        assert engineer_features(src, amount_scale=2, block_us=width).orderBy("transaction_id").collect() == want


def test_order_statistics_collect_a_bounded_number_of_rows(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from txnrisk.operators import ranking
    seen, plain = [], DataFrame.collect

    def counted(self):
        rows = plain(self)
        seen.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    monkeypatch.setattr(ranking, "GROUPS", 3)
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021 / 7).alias("x"))
    values = sorted(i * 7919 % 50_021 / 7 for i in range(50_000))
    for k in (0, 1, 777, 49_999):
        assert ranking.value_at_rank(df, "x", k) == values[k]
    assert ranking.exact_quantile(df, "x", 0.95) == values[47499] + (values[47500] - values[47499]) * (49_999 * 0.95 - 47499)
    assert max(seen) <= 16


def test_order_statistics_of_repeated_and_extreme_values(spark):
    from txnrisk.operators.ranking import value_at_rank
    values = sorted([0.0] * 50 + [-1e300, 1e300, 5e-324, 1.5, 1.5] + [2.0] * 50)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    assert [value_at_rank(df, "x", k) for k in (0, 1, 50, 51, 52, 60, 104, 105)] == [values[0], values[1], values[50], values[51], values[52], values[60], values[104], None]


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, float("inf")], [1.0, 2.0, float("nan"), 3.0, None], [-1.7e308, 0.0, 1.0, 1.7e308], [float("-inf")] * 3 + [0.0] * 40 + [float("inf")] * 3,
    [2.0 ** (i - 1000) for i in range(2000)], [7.0] * 3000 + [8.0], [float("nan"), None], [],
], ids=["infinity", "nan", "huge", "masses", "powers", "point", "none", "empty"])
def test_order_statistics_take_two_scans_of_any_column(spark, monkeypatch, values):
    from txnrisk.operators import ranking
    written, plain = [], ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda df: written.append(1) or plain(df))
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    real = sorted(v for v in values if v is not None and v == v)
    for k in {0, len(real) // 2, len(real) - 1}:
        written.clear()
        assert ranking.value_at_rank(df, "x", k) == (real[k] if real else None)
        assert len(written) <= 1     # the bracket's counts, ranged; the sketch is the other scan
    if real:
        at = (len(real) - 1) * 0.95
        low, high, part = real[int(at)], real[min(int(at) + 1, len(real) - 1)], at - int(at)
        assert ranking.exact_quantile(df, "x", 0.95) == (low if low == high or not part else low + (high - low) * part if high - low < float("inf") else low * (1 - part) + high * part)
    else:
        assert ranking.exact_quantile(df, "x", 0.95) is None


def test_a_missed_bracket_is_noticed(spark, monkeypatch):
    from txnrisk.operators import ranking
    plain = ranking._bracket
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    for low, high in ((400.0, 450.0), (-5.0, 100.0), (250.0, 250.0)):
        monkeypatch.setattr(ranking, "_bracket", lambda vals, rank_of, low=low, high=high: (*plain(vals, rank_of)[:2], low, high))
        assert ranking.exact_quantile(df, "x", 0.501) == 0.501 * 499


def test_the_cohort_shuffles_the_rows_once(spark, monkeypatch):
    from txnrisk.operators import labels
    from txnrisk.operators import ranking
    df = spark.createDataFrame([(i % 400, i) for i in range(2000)] + [(None, 1)], "user_id long, transaction_id long")
    sources, plain = [], labels.materialize

    def counted(x):
        sources.append(x._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return plain(x)

    monkeypatch.setattr(labels, "materialize", counted)
    predicate = labels.cohort_predicate(df, frac=0.1)
    assert sources == [1]
    users = {r[0] for r in df.filter(predicate).select("user_id").distinct().collect()}
    assert len(users) == 40 == labels.fraud_cohort(df, frac=0.1).count()
    assert ranking.smallest_k(labels.hashed_keys(df, "user_id", labels.SEED), "_h", 10_000, "user_id").count() == 400


def test_rows_of_hot_keys_are_spread_for_the_join_with_their_facts(spark):
    from txnrisk.operators import features
    src = spark.range(8000).select(F.col("id").alias("transaction_id"), F.when(F.col("id") % 10 < 6, F.lit(1)).when(F.col("id") % 10 < 9, F.lit(2)).when(F.col("id") % 7 > 0, F.col("id")).alias("user_id"),
                                   (F.col("id") % 50 / 2).alias("amount"))
    facts = src.filter("user_id IS NOT NULL").groupBy(F.col("user_id").alias("_key")).agg(F.count("*").alias("_n"), F.max("amount").alias("m"))
    hot = features.hot_keys(facts, "_key", "_n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["_hot"] for r in hot.collect()} == {1, 2} and hot.count() < parts
    units = [r["count"] for r in features.salted(src, "user_id", hot).groupBy("user_id", "_salt").count().collect() if r["user_id"] is not None]
    assert max(units) <= 1.25 * 8000 / parts and sum(units) == src.filter("user_id IS NOT NULL").count()
    got = features.amount_stats(src, "user_id", "user", 2).orderBy("transaction_id").collect()
    rows = src.orderBy("transaction_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r["user_id"], []).append(r["amount"])
    assert [(r["transaction_id"], r["user_max_amount"], r["user_avg_amount"]) for r in got] == [
        (r["transaction_id"], *((max(by[r["user_id"]]), sum(by[r["user_id"]]) / len(by[r["user_id"]])) if r["user_id"] is not None else (None, None))) for r in rows]


def test_a_unit_gets_its_facts_without_a_join(spark, capsys):
    """A join would sort the emitted rows once more, and a task holds every order of its rows."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        engineer_features(hot(spark), amount_scale=2).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    plan = capsys.readouterr().out
    assert "Window" in plan and "Join" not in plan


def test_what_pieces_need_of_other_ranges_is_two_rows_per_range(spark):
    rows = materialize(spark.range(4000).select((F.col("id") % 700).alias("k"), (F.col("id") * 31 % 977).alias("us"), F.col("id").alias("rid"))
                       .withColumn("k", F.when(F.col("rid") % 3 != 0, F.lit(350)).otherwise(F.when(F.col("k") != 5, F.col("k")))))
    ranges = in_ranges(rows, [F.col(c) for c in ("k", "us", "rid")], "_part", "_local")
    found = ranked.edges(ranges, [F.count("*").alias("n")])
    assert found.count() <= 2 * ranges.select("_part").distinct().count()
    got = {r.rid: r.ordinal for r in ranked.before(ranges, {"ordinal": F.lit(1)}).collect()}
    order = sorted(rows.collect(), key=lambda r: (r.k is not None, r.k or 0, r.us, r.rid))
    seen, want = {}, {}
    for r in order:
        want[r.rid] = seen.get(r.k, 0)
        seen[r.k] = want[r.rid] + 1
    assert got == want
