import csv
import io

from pyspark.sql import functions as F

from evidentia.operators.packed import infer_delimiters, split_packed

SCHEMA = "src string, row_no bigint, cell string, pos int, item string"


def run(spark, cells, src="a"):
    rows = [(src, i, c, 9, "clash") for i, c in enumerate(cells)]
    got = split_packed(spark.createDataFrame(rows, SCHEMA).drop("pos", "item"), "cell", "src", ["row_no"])
    out = {}
    for r in got.orderBy("row_no", "pos").collect():
        out.setdefault(r.row_no, []).append((r.pos, r.item))
    return {k: [v for _, v in xs] if [p for p, _ in xs] == list(range(1, len(xs) + 1)) else xs for k, xs in out.items()}


def test_delimiters_and_quotes(spark):
    cells = ["a;b", "a | b|a", "a\tb", "a\nb", "a,b", "['a', 'x; y']", '["a", "say \\"b\\""]', '"x; y", a', 'a;"say ""b"""', ",a", "a;", '; "x; y"', "Author's Reply; a", "a；b", "{a, b}", "['Author''s Reply']", "a", "b"]
    want = [["a", "b"], ["a", "b", "a"], ["a", "b"], ["a", "b"], ["a", "b"], ["a", "x; y"], ["a", 'say "b"'], ["x; y", "a"], ["a", 'say "b"'], ["a"], ["a"], ["x; y"], ["Author's Reply", "a"], ["a", "b"], ["a", "b"], ["Author's Reply"], ["a"], ["b"]]
    got = run(spark, cells)
    assert [got[i] for i in range(len(cells))] == want


def test_pairs(spark):
    cells = ["{'hub': 3, 'isolate': 1}", '{"hub":2}', "hub=2;isolate=4", "hub: 1 | isolate: 2", "hub (2)\nisolate (1)", "hub:1"]
    got = run(spark, cells)
    assert got[0] == ["hub=3", "isolate=1"] and got[1] == ["hub=2"] and got[2] == ["hub=2", "isolate=4"]
    assert got[3] == ["hub=1", "isolate=2"] and got[4] == ["hub=2", "isolate=1"] and got[5] == ["hub=1"]


def test_unusable_empty_and_long(spark):
    cells = [None, "", "  ", "nan", "None", "NULL", "[]", "{}", ";;", "a;" * 200_000, '"' * 5000, "x" * 500_000]
    got = run(spark, cells)
    assert set(got) - {10} == {9, 11}
    assert len(got[9]) == 200_000 and got[11] == ["x" * 500_000]


def test_empty_table_and_null_source(spark):
    assert run(spark, []) == {}
    rows = [(None, 1, "a;b"), (None, 1, "a;b"), ("s", 2, "b;a")]
    got = split_packed(spark.createDataFrame(rows, "src string, row_no bigint, cell string"), "cell", "src", ["row_no"])
    assert got.count() == 6 and got.where("src is null").count() == 4


def test_a_slash_counts_only_with_evidence(spark):
    plain = spark.createDataFrame([("s", c) for c in ("in/out", "and/or", "left/right", "x;y")], "src string, cell string")
    assert "/" not in infer_delimiters(plain, "cell", "src")["s"][0]
    packed = spark.createDataFrame([("s", c) for c in ("a / b", "b / a", "a", "b", "a / a", "b;a")], "src string, cell string")
    assert "/" in infer_delimiters(packed, "cell", "src")["s"][0]


def test_round_trip_against_csv(spark):
    import random

    rnd = random.Random(4)
    words = ["alpha", "beta; gamma", 'say "hi"', "it's", "a | b", "delta"]
    cells, want = [], []
    for _ in range(200):
        row = [rnd.choice(words) for _ in range(rnd.randint(1, 5))]
        buf = io.StringIO()
        csv.writer(buf, delimiter=rnd.choice(";|,"), lineterminator="", quoting=csv.QUOTE_ALL).writerow(row)
        cells.append(buf.getvalue())
        want.append(row)
    got = run(spark, cells)
    assert [got[i] for i in range(len(cells))] == want
    assert F is not None
