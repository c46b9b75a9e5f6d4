import pytest

from evidentia.llm import mixing as M


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0, 0) for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string, tokens int, rate int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def run(spark, rows, want, **k):
    c, r = M.mix(docs(spark, rows), targets(spark, want), "doc_id", "text", "source", **k)
    return c, {x.source: x for x in r.collect()}


def test_shares_caps_and_report(spark):
    rows = [("one two three four five", "a")] * 400 + [("six seven eight nine ten", " B-x")] * 100 + [("left out", None)] * 5 + [("other text here", "zzz")] * 9
    copies, rep = run(spark, rows, [("a", 0.5, 1), ("b_x", 0.5, 3), ("absent", 0.2, 4)])
    assert abs(rep["a"].mixed_share - 0.5) < 0.04 and abs(rep["b_x"].mixed_share - 0.5) < 0.04
    assert rep["b_x"].rate == pytest.approx(3) and rep["b_x"].most_copies == 3 and rep["a"].most_copies == 1
    assert rep["absent"].docs == 0 and rep["zzz"].mixed_docs == 0 and rep[None].mixed_docs == 0
    n = copies.groupBy("source").count().collect()
    assert {x.source: x["count"] for x in n} == {s: rep[s].mixed_docs for s in ("a", "b_x")}


def test_copies_do_not_depend_on_partitions(spark):
    rows = [(f"text {i}", "a" if i % 3 else "b") for i in range(300)]
    want = [("a", 0.7, 2), ("b", 0.3, 2)]
    one = {tuple(r) for r in run(spark, rows, want)[0].collect()}
    d = docs(spark, rows).repartition(7)
    two = {tuple(r) for r in M.mix(d, targets(spark, want), "doc_id", "text", "source")[0].collect()}
    assert one == two


def test_rates_by_hand():
    assert M.rates({"a": 100, "b": 100}, {"a": (0.5, 1), "b": (0.5, 2)}) == {"a": 1.0, "b": 1.0}
    r = M.rates({"a": 900, "b": 100}, {"a": (0.5, 4), "b": (0.5, 3)})
    assert r["b"] == 3 and r["a"] == pytest.approx(300 / 900)
    r = M.rates({"a": 900, "b": 100}, {"a": (0.5, 1), "b": (0.5, 3)}, total=1000)
    assert r["b"] == 3 and r["a"] == pytest.approx(700 / 900)
    assert M.rates({}, {"a": (1.0, 1)}) == {} and M.rates({"a": 5}, {"a": (0.0, 1)}) == {}


def test_null_empty_and_long_texts(spark):
    rows = [(None, "a"), ("", "a"), ("word " * 60_000, "a")]
    _, rep = run(spark, rows, [("a", 1.0, 1), (None, None, None), ("a", 0.0, 2)])
    assert rep["a"].docs == 3 and rep["a"].tokens > 50_000 and rep["a"].rate == 1.0
    _, rep = run(spark, [], [("a", 1.0, 1)])
    assert rep["a"].mixed_tokens == 0 and rep["a"].mixed_share == 0.0
    copies, _ = run(spark, rows, [])
    assert copies.count() == 0
