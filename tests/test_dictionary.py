"""The distributed dictionary of categorical levels (M3) and the publication of models."""
import random

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from txnrisk.operators import dictionary as DI
from txnrisk.operators import ml as ML


def test_levels_and_places_by_hand(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["b", "a", "é", "", None, "Z", "10", "9"]), rnd.choice([3, 20, None])) for i in range(300)] + [(300, None, None)]
    df = spark.createDataFrame(rows, "id int, x string, n int").repartition(5)
    d = DI.build_dictionary(df, ["x", "n", "none"][:2])
    want, place = [], 0
    for c, values in (("x", sorted({r[1] for r in rows} - {None}, key=lambda v: v.encode())), ("n", sorted({str(r[2]) for r in rows} - {"None"}))):
        for i, v in enumerate(values):
            want.append((c, v, i, place))
            place += 1
    assert sorted(map(tuple, d.levels.collect()), key=lambda r: r[3]) == want
    assert d.width == place and d.first == {"x": 0, "n": want[-1][3] - 1} and d.size == {"x": 7, "n": 2}
    at = {(c, v): p for c, v, _, p in want}
    unseen = df.unionByName(spark.createDataFrame([(900, "new", 3)], df.schema))
    got = {r["id"]: r["one_hot"] for r in DI.with_places(unseen, d).collect()}
    assert got == {i: [at[k] for k in (("x", x), ("n", str(n))) if k in at] for i, x, n in rows + [(900, "new", 3)]}
    empty = DI.build_dictionary(df.limit(0), ["x", "n"])
    assert empty.levels.collect() == [] and empty.width == 0 and DI.with_places(df.limit(2), empty).first()["one_hot"] == []


def test_a_million_levels_send_a_bounded_number_of_rows_to_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    seen, plain = [], DataFrame.collect

    def counted(self):
        rows = plain(self)
        seen.append(len(rows))
        return rows

    df = spark.range(1_000_000).select(F.col("id").alias("user_id"), (F.col("id") % 3).alias("kind"))
    monkeypatch.setattr(DataFrame, "collect", counted)
    d = DI.build_dictionary(df, ["user_id", "kind"])
    assert seen and max(seen) <= 2
    assert d.size == {"user_id": 1_000_000, "kind": 3} and d.first["kind"] == 1_000_000
    stats = d.levels.filter("feature = 'user_id'").agg(F.min("index"), F.max("index"), F.count_distinct("index")).first()
    assert tuple(stats) == (0, 999_999, 1_000_000)
    ordered = d.levels.filter("feature = 'user_id' AND index IN (0, 1, 2, 999999)").orderBy("index").select("level").collect()
    assert [r[0] for r in ordered] == ["0", "1", "10", "999999"]


def stage(spark, n):
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {n} AS made FROM __THIS__")]).fit(spark.range(1))


def test_a_load_during_a_save_gives_the_old_or_the_new_model(spark, tmp_path, monkeypatch):
    path, df = str(tmp_path / "model"), spark.range(1)

    def made():
        model = ML.load_model_or_none(path)
        return model and model.transform(df).first()["made"]

    assert made() is None
    ML.save_model(stage(spark, 1), path)
    assert made() == 1
    seen, plain = [], ML._published

    def between(p):          # save_model reads the manifest after the new model's files and before its row
        monkeypatch.setattr(ML, "_published", plain)
        seen.append(made())
        return plain(p)

    monkeypatch.setattr(ML, "_published", between)
    ML.save_model(stage(spark, 2), path)
    assert seen == [1] and made() == 2
    stage(spark, 3).write().save(f"{path}/versions/lost")      # a save that ended before its row
    assert made() == 2
