"""Features of the classifiers."""

from pyspark.sql import functions as F

from catalog import models
from gridmine.operators import ml

SF = "/root/testdata/sf0.001"


def test_features_are_written_without_an_attribute_per_word(spark):
    """Spark ML names every word in the column's metadata, which every task of every iteration carried along."""
    rows = models._labelled(spark, SF)
    plain = ml.features(["source", "text"], min_df=2).fit(rows.filter("is_train = 1")).transform(rows)
    got = models._features(spark, SF)
    assert "ml_attr" in plain.schema["features"].metadata and got.schema["features"].metadata == {}
    assert "CountVectorizer" not in got._jdf.queryExecution().toString() and "UDF" not in got._jdf.queryExecution().toString()
    columns = ["doc_id", "label", "is_train", F.col("features").cast("string").alias("features")]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, plain.select(*columns).collect()))
    # the models still find how many classes and inputs there are
    assert ml.train(got.filter("is_train = 1"), "lr").numFeatures == ml.train(plain.filter("is_train = 1"), "lr").numFeatures


def test_a_linear_model_sends_no_more_gradients_than_there_are_cores(spark, monkeypatch):
    rows = models._features(spark, SF).repartition(23)
    partitions, seen = [], []
    model_of = ml.model_of

    class Fit:
        def __init__(self, kind):
            self.kind = kind

        def fit(self, data):
            partitions.append(data.rdd.getNumPartitions())
            seen.append(data.count())
            return model_of(self.kind).fit(data)

    monkeypatch.setattr(ml, "model_of", lambda kind, *a: Fit(kind))
    for kind in ("lr", "svm", "nb"):
        ml.train(rows, kind)
    cores = spark.sparkContext.defaultParallelism
    assert partitions == [cores, cores, 23] and seen == [rows.count()] * 3


def test_vocabularies_of_features_stay_tables(spark, tmp_path):
    """A fitted vocabulary was an array on the driver, and its words were attributes of the column."""
    rows = spark.createDataFrame([(k, f"s{k % 2}", f"the  w{k // 2} The\nw{k // 3}") for k in range(12)], "id int, source string, text string")
    model = ml.features(["source", "text"], min_df=2).fit(rows)
    out = model.transform(rows)
    width = len({"s0", "s1"}) + len({"the"} | {f"w{k}" for k in range(6)})
    assert out.columns == ["id", "source", "text", "features"] or set(out.columns) >= {"id", "source", "text", "features"}
    assert out.schema["features"].metadata == {"ml_attr": {"num_attrs": width}}
    got = {r["id"]: r["features"] for r in out.collect()}
    assert {v.size for v in got.values()} == {width}
    # the commonest word of the texts comes first after the sources
    assert [got[k][2] for k in range(12)] == [2.0] * 12 and all(sum(v.values) == 5.0 - (k // 3 > 5) for k, v in got.items())
    path = str(tmp_path / "model")
    ml.save_model(model, path)
    ml.save_model(model, path)
    again = ml.load_model(path).transform(rows, ["id"])
    assert again.columns == ["id", "features"] and {r["id"]: r["features"] for r in again.collect()} == got


def test_a_saved_pipeline_is_still_loaded(spark, tmp_path):
    from pyspark.ml import Pipeline

    rows = spark.createDataFrame([(1, "a b a")], "id int, text string")
    ml.save_model(Pipeline(stages=[ml.tokenizer("text", "words"), ml.counter("words", "counts", min_df=1)]).fit(rows), str(tmp_path / "m"))
    assert ml.load_model(str(tmp_path / "m")).transform(rows).first()["counts"].size == 2
