import random

from evidentia.llm import components as C

SCHEMA = "a string, b string, v string, n bigint"


def run(spark, pairs):
    df = spark.createDataFrame([(x, y, "clash", 1) for x, y in pairs], SCHEMA)
    return {r.rec_id: r.group_id for r in C.hash_to_min(df, "a", "b").collect()}


def brute(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in list(up)}


def test_random_graph(spark):
    r = random.Random(2)
    pairs = [(f"r{r.randint(0, 400):03d}", f"r{r.randint(0, 400):03d}") for _ in range(330)]
    assert run(spark, pairs) == brute(pairs)


def test_chain_nulls_repeats_and_loops(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)] + [("c000", "c001")] * 5 + [(None, "x"), ("y", None), ("z", "z"), ("q", "p"), ("p", "q")]
    got = run(spark, pairs)
    assert got == brute(pairs) and "x" not in got and "z" not in got


def test_empty(spark):
    assert run(spark, []) == {}


def test_hot_vertices_are_salted_alike(spark, monkeypatch):
    pairs = [("hub", f"m{i:04d}") for i in range(600)] + [(f"m{i:04d}", f"a{i:04d}") for i in range(300)]
    want = brute(pairs)
    monkeypatch.setattr(C, "HOT", 50)
    assert run(spark, pairs) == want
    monkeypatch.setattr(C, "HOT_BROADCAST", 0)
    assert run(spark, pairs) == want
