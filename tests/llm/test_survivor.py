import random

from pyspark.sql import functions as F

from evidentia.llm import survivor as S

SCHEMA = "g string, i string, t int, c int, m double, doi string, cells string, keep0 string"


def run(spark, rows, recency=None):
    df = spark.createDataFrame([(*r[:6], "x", r[6] if len(r) > 6 else "y") for r in rows], SCHEMA)
    return {r.g: (r.keep, r.doi, r.m) for r in S.survivors(df, "g", "i", ["t", "c"], "m", ["doi"], recency).collect()}


def brute(rows, layers=None):
    low = float("-inf")
    out = {}
    for g in {r[0] for r in rows if r[0]}:
        rest = [(r[2] or 0, r[3] or 0, low if r[4] is None else r[4], int(r[6]) if len(r) > 6 else 0, r[1], r[5]) for r in rows if r[0] == g and r[1]]
        order = sorted(rest, key=lambda x: (-x[0], -x[1], -x[2], x[4]))
        best, doi, depth = max(x[2] for x in rest), None, 0
        while rest and doi is None:
            front = [x for x in rest if not any(all(a >= b for a, b in zip(y[:4], x[:4])) and y[:3] != x[:3] for y in rest)]
            known = [x for x in order if x in front and x[5]]
            doi = known[0][5] if known else None
            rest = [x for x in rest if x not in front]
            depth += 1
        if layers is not None and doi:
            layers.append(depth)
        out[g] = (order[0][4], doi, None if best == low else best)
    return out


def test_random_groups(spark):
    r = random.Random(8)
    rows = [(f"g{r.randint(0, 30)}", f"i{n:03d}", r.randint(0, 2), r.randint(0, 2), r.choice([None, 0.0, 1.0, 5.0, 7.5]), r.choice([None, None, f"d{n}"])) for n in range(400)]
    assert run(spark, rows) == brute(rows)


def test_recency_and_later_layers_decide(spark, monkeypatch):
    r = random.Random(3)
    rows = [(f"g{r.randint(0, 25)}", f"i{n:03d}", r.randint(0, 2), r.randint(0, 1), r.choice([None, 1.0, 5.0]), f"d{n}" if r.random() < 0.08 else None, str(r.randint(0, 3))) for n in range(500)]
    layers = []
    want = brute(rows, layers)
    assert {2, 3} <= set(layers)
    assert run(spark, rows, ["keep0"]) == want
    assert any(want[g][1] != x[1] for g, x in brute([x[:6] for x in rows]).items())
    monkeypatch.setattr(S, "PER_COPY", 5)
    assert run(spark, rows, ["keep0"]) == want


def test_a_later_layer_fills_the_field(spark):
    rows = [("g", "a", 2, 1, 9.0, None), ("g", "b", 1, 1, 5.0, None), ("g", "c", 0, 0, 1.0, "d")]
    assert run(spark, rows) == {"g": ("a", "d", 9.0)}


def test_nulls_ties_and_empty(spark):
    rows = [(None, "a", 1, 1, 1.0, "d"), ("g", None, 1, 1, 1.0, "d"), ("h", "b", None, None, None, None), ("h", "a", None, None, None, None)]
    assert run(spark, rows) == {"h": ("a", None, None)}
    assert run(spark, []) == {}


def test_doi_and_last_known(spark):
    got = [r.d for r in spark.createDataFrame([("DOI: https://dx.doi.org/10.1/AB/ ",), ("nan",), ("doi:",), (None,)], "x string").select(S.bare_doi("x").alias("d")).collect()]
    assert got == ["10.1/ab", None, None, None]
    df = spark.createDataFrame([("a", "x", "2024-01-02"), ("a", "y", "2024-01-01"), ("a", None, "2024-01-03"), ("a", "z", None)], "k string, v string, at string").withColumn("at", F.to_timestamp("at"))
    assert df.groupBy("k").agg(S.last_known(df, "k", F.col("v"), "at").alias("v")).first().v == "x"
