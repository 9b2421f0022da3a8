"""Fitted models: held-out parts, stored and read back, and folds forward in time."""

from pyspark.sql import functions as F

from quillstone.plans import machine_learning as M
from quillstone.shelf import Shelf

WHERE = "/root/testdata/sf0.001"


def test_held_out_parts_are_of_each_class_and_stay_out(spark):
    rows = M.labelled_documents(lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")).withColumn("held", M.held_out(F.col("title"), F.col("role")))
    shares = {r["role"]: r["s"] for r in rows.groupBy("role").agg(F.avg(F.col("held").cast("int")).alias("s")).collect()}
    assert len(shares) == 4 and all(0.05 < s < 0.4 for s in shares.values())
    both = rows.groupBy("title", "role").agg(F.count_distinct("held").alias("n")).filter("n > 1")
    assert both.count() == 0  # copies are on one side


def test_stored_model_says_the_same(spark):
    rows = M.labelled_documents(lambda t: spark.read.parquet(f"{WHERE}/{t}.parquet"))
    held = M.held_out(F.col("title"), F.col("role"))
    fitted = M.role_pipeline(1 << 10).fit(M.balanced(rows.filter(~held), "role"))
    where = f"{Shelf(spark, 'test').path}/model"
    assert M.load_model(where) is None
    fitted.write().save(where)
    names = fitted.stages[0].labels
    said = lambda m: sorted(map(tuple, M.labelled_by(m, rows, names).collect()))
    assert said(fitted) == said(M.load_model(where))
    by_rule = M.labelled_by(None, rows, names).collect()
    assert {r["source"] for r in by_rule} == {"rule"} and any(r["predicted"] for r in by_rule)
    right = M.labelled_by(fitted, rows.filter(held), names).filter("role = predicted").count()
    assert right >= 0.8 * rows.filter(held).count()


def test_rule():
    assert set(M.COMMON_WORDS) == {"de", "en", "es", "fr"}


def test_no_test_day_is_in_its_training_part(spark):
    days = M.daily_features(spark.read.parquet(f"{WHERE}/events.parquet"))
    seen = []
    for _, train, test in M.folds(days):
        a, b = {r["day"] for r in train.collect()}, {r["day"] for r in test.collect()}
        assert a and b and max(a) < min(b)
        seen.append(b)
    assert not (seen[0] & seen[1] or seen[1] & seen[2])


def test_counts_of_the_fit_are_made_once(spark, monkeypatch):
    """The learners read written counts; the model is that of the whole pipeline."""
    put = []
    rows = M.labelled_documents(lambda t: spark.read.parquet(f"{WHERE}/{t}.parquet"))
    train = M.balanced(rows, "role").coalesce(1)
    monkeypatch.setattr(Shelf, "put", lambda self, df, name, f=Shelf.put: put.append(name) or f(self, df, name))
    got = M.fitted_roles(train, Shelf(spark, "test"))
    assert put == ["counts"]
    want = M.role_pipeline().fit(train)
    assert [type(s) for s in got.stages] == [type(s) for s in want.stages] and got.stages[0].labels == want.stages[0].labels
    assert abs(got.stages[-1].coefficientMatrix.toArray() - want.stages[-1].coefficientMatrix.toArray()).max() < 1e-6
