import random
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.operators import graph as G
from evidentia.operators import relational as O


def links(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, w double")


def modularity(rows, comm):
    total = 2 * sum(w for _, _, w in rows)
    share = {}
    for x, y, w in rows:
        share[x] = share.get(x, 0) + w / total
        share[y] = share.get(y, 0) + w / total
    inside = sum(2 * w / total for x, y, w in rows if comm[x] == comm[y])
    by = {}
    for x, k in share.items():
        by[comm[x]] = by.get(comm[x], 0) + k
    return inside - sum(k * k for k in by.values())


@pytest.mark.parametrize("bounded", [100_000, 0])
def test_cliques_are_communities(spark, bounded):
    rows = [(f"{c}{x}", f"{c}{y}", 1.0) for c in "pqrst" for x, y in combinations(range(6), 2)] + [("p0", "q0", 1.0), ("q1", "r1", 1.0), ("p3", "p3", 9.0)]
    got = {r.id: r.community for r in G.communities(links(spark, rows), "a", "b", "w", bounded).collect()}
    assert len(set(got.values())) == 5 and all(len({got[f"{c}{x}"] for x in range(6)}) == 1 for c in "pqrst")
    assert got["p0"] == 0  # equal sizes: the smallest id first


def test_rounds_are_about_as_good_as_one_by_one(spark):
    r = random.Random(4)
    rows = sorted({(f"n{x:03d}", f"n{y:03d}", 1.0) for x, y in ((r.randint(0, 119), r.randint(0, 119)) for _ in range(500)) if x < y and (x // 20 == y // 20 or r.random() < 0.1)})
    whole, rounds = ({x.id: x.community for x in G.communities(links(spark, rows), "a", "b", "w", b).collect()} for b in (100_000, 0))
    assert set(whole) == set(rounds) == {x for row in rows for x in row[:2]}
    assert modularity(rows, rounds) >= 0.9 * modularity(rows, whole) > 0.3


def test_communities_of_nothing(spark):
    assert G.communities(links(spark, []), "a", "b", "w").count() == 0
    assert G.communities(links(spark, [("x", "x", 1.0), (None, "y", 1.0)]), "a", "b").count() == 0


def test_betweenness_of_a_path_and_by_weight(spark):
    path = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)]
    got = {r.id: r.betweenness for r in G.betweenness(links(spark, path), "a", "b", 400).collect()}
    assert got == pytest.approx({"a": 0, "b": 0.5, "c": 4 / 6, "d": 0.5, "e": 0})
    around = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0)]
    assert {r.id: r.betweenness for r in G.betweenness(links(spark, around), "a", "b", 400, "w").collect()} == pytest.approx({"a": 0, "b": 1.0, "c": 0})


def test_rank_to_a_tolerance_is_the_fixed_point(spark):
    r = random.Random(6)
    edges = sorted({(r.randint(0, 29), r.randint(0, 29)) for _ in range(90)})
    out = {x: [b for a, b in edges if a == x] for x in range(30)}
    rank = dict.fromkeys(range(30), 1 / 30)
    for _ in range(400):
        loss = sum(v for x, v in rank.items() if not out[x])
        new = dict.fromkeys(rank, (0.15 + 0.85 * loss) / 30)
        for x, ys in out.items():
            for y in ys:
                new[y] += 0.85 * rank[x] / len(ys)
        rank = new
    got = {x.id: x["rank"] for x in G.page_rank(spark.range(30).select("id"), spark.createDataFrame(edges, "src bigint, dst bigint"), 200, tol=1e-9).collect()}
    assert got == pytest.approx(rank, abs=1e-7)


def test_ranks_and_running_totals_of_few_groups(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 50).alias("v"))
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).alias("k"), F.sum("v").over(Window.orderBy("v", "id")).alias("t"))
    got = O.rank_within(df, F.col("g"), [F.asc("v"), F.asc("id")]).select("id", F.col("rank").alias("k"))
    total = O.running_total(df, [F.asc("v"), F.asc("id")], "v", "t").select("id", "t")
    assert {(r.id, r.k) for r in got.collect()} == {(r.id, r.k) for r in want.collect()}
    assert {(r.id, r.t) for r in total.collect()} == {(r.id, r.t) for r in want.collect()}
    assert O.rank_within(df.limit(0), F.col("g"), [F.asc("v")]).count() == 0


def test_fragments_in_texts(spark):
    f = spark.createDataFrame([("Abcdef",), ("xy",), (None,), ("zzzz",), ("abcdef",)], "f string")
    d = spark.createDataFrame([(3, "an ABCDEF here", "x"), (2, "xxabcdefxy", "y"), (1, None, "z"), (0, "", "")], "i int, t string, f string")
    assert sorted((r.f or "", r.first) for r in O.first_containing(f, "f", d, "t", "i").collect()) == [("", None), ("Abcdef", 2), ("abcdef", 2), ("xy", 2), ("zzzz", None)]
