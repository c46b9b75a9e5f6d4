import random

import numpy as np
from pyspark.sql import functions as F

from evidentia.operators import hotkeys as H

SCHEMA = "k string, v double, n string, item string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(seed=1, n=4000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = "hot" if r.random() < 0.4 else r.choice("abc") if r.random() < 0.9 else f"k{r.randint(0, 50)}"
        out.append((k, float(r.choice([0, 0, 1, 2, r.randint(0, 10**6), r.random()])), "clash", f"i{r.randint(0, 900):04d}"))
    return out


def test_top_by_key_matches_brute_force(spark):
    rows = rows_of()
    best = {}
    for k, v, _, i in rows:
        best[k, i] = max(v, best.get((k, i), -1))
    want = {}
    for (k, i), v in best.items():
        want.setdefault(k, []).append((-v, i))
    want = {(k, p + 1, i) for k, xs in want.items() for p, (_, i) in enumerate(sorted(xs)[:3])}
    got = {(r.k, r.place, r.item) for r in H.top_by_key(table(spark, rows), "k", "v", "item", 3).collect()}
    assert got == want


def test_quantiles_match_numpy(spark):
    rows = rows_of(2)
    by = {}
    for k, v, *_ in rows:
        by.setdefault(k, []).append(v)
    for r in H.quantiles(table(spark, rows), "k", "v", [0.0, 0.5, 0.9, 1.0]).collect():
        assert abs(r["quantile"] - np.quantile(by[r.k], r.prob)) < 1e-6 * max(1, abs(r["quantile"]))


def test_nulls_ties_empty_and_extremes(spark):
    rows = [(None, 1.0, "", "x"), ("a", None, "", "x"), ("a", 5.0, "", None), ("a", 5.0, "", "z"), ("a", 5.0, "", "y"), ("a", 5.0, "", "y"), ("b", float("inf"), "", "q"), ("b", -1e308, "", "r"), ("b", 1e308, "", "s"), ("b", float("-inf"), "", "t")]
    got = [tuple(r) for r in H.top_by_key(table(spark, rows), "k", "v", "item", 3).orderBy("k", "place").collect()]
    assert got == [("a", 1, "y"), ("a", 2, "z"), ("b", 1, "q"), ("b", 2, "s"), ("b", 3, "r")]
    assert H.top_by_key(table(spark, []), "k", "v", "item", 3).count() == 0
    assert H.quantiles(table(spark, []), "k", "v", [0.5]).count() == 0


def test_one_key_holds_all_rows(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("k"), (F.col("id") % 977).cast("double").alias("v"), F.lit("").alias("n"), F.col("id").cast("string").alias("item"))
    got = [tuple(r) for r in H.top_by_key(df, "k", "v", "item", 2).orderBy("place").collect()]
    best = sorted(str(i) for i in range(50_000) if i % 977 == 976)[:2]
    assert got == [("hot", 1, best[0]), ("hot", 2, best[1])]
