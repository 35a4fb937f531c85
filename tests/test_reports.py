"""What the classifier reports read."""

from tabloom import queries
from tabloom.operators import evaluate


def test_registered_reports_take_the_whole_sample(spark, monkeypatch):
    import inspect

    real, seen = inspect.signature(evaluate.classifier_report), []

    def held(*args, **kwargs):
        bound = real.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments["rows"])

    monkeypatch.setattr(evaluate, "classifier_report", held)
    for name in ("classifier_report", "classifier_report_ensembles"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [5000, 5000]


def test_features_hold_every_value(spark):
    rows = [(i, f"City{i % 70}", ["a", "b"][i % 2], float(i)) for i in range(140)]
    df = spark.createDataFrame(rows, "tid long, city string, y string, x double")
    train, test, width = evaluate.features(df.filter("tid < 70"), df.filter("tid >= 70"), evaluate.Target("y", ("a",)))
    for part in (train, test):
        found = [r.features for r in part.collect()]
        assert width == 71 and all(v.size == 71 for v in found)
        assert len({tuple(v.toArray()[1:]) for v in found}) == 70 and all(v.toArray()[1:].sum() == 1 for v in found)


def test_report_counts_few_rows_in_a_task(spark, monkeypatch):
    """Groups are counted in tasks of bounded size, whatever the partitions of the table."""
    from tabloom.operators import violations
    from tabloom.plans.constraint import DenialConstraint

    seen, real = [], violations.equal_group_pairs
    monkeypatch.setattr(violations, "GROUP_ROWS", 100, raising=False)
    monkeypatch.setattr(violations, "equal_group_pairs", lambda df, items, mode: (seen.append(df.rdd.getNumPartitions()), real(df, items, mode))[1])
    rows = spark.range(1000).selectExpr("id AS tid", "id % 7 AS a", "id % 3 AS b").coalesce(1)
    told = violations.violation_report(rows, [DenialConstraint.parse("t1&t2&EQ(t1.a,t2.a)&IQ(t1.b,t2.b)")]).first()
    assert seen == [10]
    assert told.n_vio == sum(i % 7 == j % 7 and i % 3 != j % 3 for i in range(1000) for j in range(i + 1, 1000))
