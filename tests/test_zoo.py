"""The model zoo finds the medians of a fold once for all its models."""

from terralag.operators import tuning as tune


def test_zoo_finds_medians_once_a_fold(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 17), float(i % 5), float(i), i % 3) for i in range(90)], "a double, b double, y double, fold int")
    calls, before = [], tune.MedianImputer._fit
    monkeypatch.setattr(tune.MedianImputer, "_fit", lambda self, part: calls.append(1) or before(self, part))
    got = tune.model_zoo_report(df, ["a", "b"], "y", 3, {"mean": {}, "linear": {}, "decision_tree": {}}).collect()
    assert len(got) == 3 and len(calls) == 3
