from datetime import datetime as T

from evidentia.operators import references as R

REF = "id string, at timestamp, kind string, ref string"


def run(spark, refs, register):
    p = R.reference_periods(spark.createDataFrame(refs, REF), "t", "id", "at")
    reg = R.parents(spark.createDataFrame(register, "id string, seen timestamp, gone timestamp, at string"), "id", "seen", "gone")
    return sorted(tuple(r) for r in R.orphans(p, reg).collect())


def test_kinds(spark):
    reg = [("W1 ", T(2024, 1, 5), None, "x"), ("w1", T(2024, 1, 5), None, "y"), ("w2", T(2023, 1, 1), T(2024, 3, 10), "")]
    refs = [(" w1", T(2024, 1, 4), "", ""), ("W1\t", T(2024, 1, 5), "", ""), ("w2", T(2024, 3, 10), "", ""), ("w2", T(2024, 3, 9), "", ""), ("w9", None, "", ""), ("w9", None, "", ""), ("w1", None, "", ""), (None, T(2024, 1, 1), "", ""), ("nan", T(2024, 1, 1), "", ""), (" ", None, "", "")]
    assert run(spark, refs, reg) == [("t", "w1", "2024-01", "later", 2), ("t", "w2", "2024-03", "deleted", 2), ("t", "w9", "none", "missing", 2)]


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("a", T(2024, 5, 1), "", "")], []) == [("t", "a", "2024-05", "missing", 1)]
    assert run(spark, [], [("a", None, None, "")]) == []


def test_later_and_deleted_in_one_month(spark):
    reg = [("a", T(2024, 5, 10), T(2024, 5, 20), "")]
    refs = [("a", T(2024, 5, 1), "", ""), ("a", T(2024, 5, 25), "", "")]
    assert [r[3] for r in run(spark, refs, reg)] == ["deleted", "later"]
