"""Rules meet measurements where they lie."""

from orebed.operators import evidence as V


def test_measurements_of_one_metric_are_not_one_task(spark):
    m = spark.createDataFrame([("A", 1.0), ("A", 9.0), ("A", None), ("B", 2.0), ("C", 3.0)], "metric string, value double")
    rules = spark.createDataFrame([("A", "<=", 5.0, None), ("A", ">", 0.0, None), ("B", ">", None, None)], "metric string, op string, low double, high double")
    got = V.evaluate_rules(m, rules)
    assert sorted((r.metric, r.op, r.status) for r in got.collect()) == sorted([("A", "<=", "NORMAL"), ("A", "<=", "DEVIATION"), ("A", "<=", "UNVERIFIED"), ("A", ">", "NORMAL"), ("A", ">", "NORMAL"), ("A", ">", "UNVERIFIED"), ("B", ">", "UNVERIFIED")])
    # Before, rows met by metric: all of a metric in one task.
    assert "hashpartitioning(metric" not in got._jdf.queryExecution().executedPlan().toString()
