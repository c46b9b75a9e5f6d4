"""Graph operators over edge DataFrames: degrees, support, projections, and iterative measures."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.common import cut, drop_cut


#: Links between communities that one task finishes.
BOUNDED = 100_000


def project(mentions: DataFrame, work: str, person: str) -> DataFrame:
    """(a, b, w): pairs of persons a < b with the number of works they share. Work is quadratic in the authors of a work, never in rows of a person."""
    m = mentions.select(F.col(work).alias("k"), F.col(person).alias("p")).where("p is not null").distinct()
    x, y = m.select("k", F.col("p").alias("a")), m.select("k", F.col("p").alias("b"))
    return x.join(y, "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("w"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, indeg, outdeg) of the nodes, edges with both ends among them."""
    ids = nodes.select("id")
    inner = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    ends = inner.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    got = ends.groupBy("id").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))
    return ids.join(got, "id", "left").na.fill(0, ["indeg", "outdeg"])


def seed_support(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, direct, coupled, cocited): links to or from seeds; references shared with any seed; citers shared with any seed."""
    s = seeds.select("id").distinct()
    direct = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).unionByName(edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")))
    direct = direct.groupBy("id").agg(F.count("*").alias("direct"))
    refs = edges.join(s.withColumnRenamed("id", "src"), "src", "left_semi").select("dst").distinct()
    coupled = edges.join(refs, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("coupled"))
    citers = edges.join(s.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src").distinct()
    cocited = edges.join(citers, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("cocited"))
    return direct.join(coupled, "id", "full_outer").join(cocited, "id", "full_outer").na.fill(0)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id reachable, ignoring direction. Labels move along edges and then jump to their label's label, so the rounds grow with the
    logarithm of the diameter."""
    e = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x is not null and y is not null").distinct())
    label = cut(e.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("c")))
    while True:
        near = e.join(label.select(F.col("id").alias("y"), "c"), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("m"))
        step = label.join(near, "id").select("id", F.least("c", "m").alias("n"), "c")
        jump = step.join(label.select(F.col("id").alias("n"), F.col("c").alias("up")), "n", "left").select("id", F.least("n", F.coalesce("up", "n")).alias("n"), "c")
        new = cut(jump)
        moved = new.where("n <> c").limit(1).count()
        drop_cut(label)
        label = new.select("id", F.col("n").alias("c"))
        label._cut_path = new._cut_path
        if not moved:
            return label.select("id", F.col("c").alias("component"))


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, weight: str | None = None, teleport: str | None = None, tol: float | None = None) -> DataFrame:
    """(id, rank): power iteration over `rounds` rounds, or until the L1 change is below n * tol. Edge weights and a teleport distribution are optional; the
    mass of nodes without outgoing edges returns by the teleport distribution. Ranks, a row a node, are written each round, so lineage stays short."""
    t = F.col(teleport) if teleport else F.lit(1.0)
    v = nodes.select("id", t.cast("double").alias("t"))
    s = v.agg(F.sum("t"), F.count("*")).first()
    n = s[1]
    if not n:
        return v.select("id", F.lit(0.0).alias("rank"))
    v = cut(v.select("id", (F.col("t") / s[0]).alias("t")))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", w.alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("sw"))
    e = cut(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("sw")).alias("p")))
    rank = v.join(out.withColumnRenamed("src", "id").select("id", F.lit(True).alias("has")), "id", "left").select("id", "t", F.coalesce("has", F.lit(False)).alias("has"), F.lit(1.0 / n).alias("old"), F.lit(1.0 / n).alias("r"))
    rank = cut(rank)
    # the mass of nodes without outgoing edges, and the change of the round, in one pass
    state = lambda x: x.agg(F.coalesce(F.sum(F.when(~F.col("has"), F.col("r"))), F.lit(0.0)), F.sum(F.abs(F.col("r") - F.col("old")))).first()
    loss, _ = state(rank)
    for _ in range(rounds):
        flow = e.join(rank.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("r")).alias("f"))
        back = F.lit(damping * loss + 1 - damping) * F.col("t")
        new = cut(rank.join(flow, "id", "left").select("id", "t", "has", F.col("r").alias("old"), (F.lit(damping) * F.coalesce("f", F.lit(0.0)) + back).alias("r")))
        drop_cut(rank)
        rank = new
        loss, moved = state(rank)
        if tol is not None and moved < n * tol:
            break
    drop_cut(e)
    drop_cut(v)
    return rank.select("id", F.col("r").alias("rank"))


def core_numbers(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(id, core): the k-core number of each node with an edge, direction and loops ignored."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    return _h_fixpoint(cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()))


def in_core_numbers(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(id, core): the largest k, up to `most` if given, for which the node survives repeated removal of nodes with fewer than k incoming edges."""
    ids = nodes.select("id")
    e = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    got = _h_fixpoint(cut(e.select(F.col("dst").alias("x"), F.col("src").alias("y")).distinct()))
    core = F.coalesce("core", F.lit(0))
    return ids.join(got, "id", "left").select("id", (core if most is None else F.least(core, F.lit(most))).alias("core"))


def _h_fixpoint(e: DataFrame) -> DataFrame:
    """(id, core) of edges x to y: each node's value starts at its number of neighbours y and falls to the h-index of their values until nothing changes,
    which is its core number. Values are counted per node, not gathered, so a hub costs as many rows as its neighbours have distinct values."""
    val = cut(e.groupBy(F.col("x").alias("id")).agg(F.count("*").cast("int").alias("h")))
    w = Window.partitionBy("x").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        near = e.join(val.select(F.col("id").alias("y"), "h"), "y", "left").join(val.select(F.col("id").alias("x"), F.col("h").alias("own")), "x")
        counts = near.groupBy("x", "own", F.least(F.coalesce("h", F.lit(0)), "own").alias("k")).agg(F.count("*").alias("n"))
        new = counts.withColumn("at_least", F.sum("n").over(w)).groupBy(F.col("x").alias("id"), "own").agg(F.max(F.least("k", F.col("at_least").cast("int"))).alias("h"))
        new = cut(new)
        moved = new.where("h <> own").limit(1).count()
        drop_cut(val)
        val = new.select("id", "h")
        val._cut_path = new._cut_path
        if not moved:
            drop_cut(e)
            return val.select("id", F.col("h").alias("core"))


def saturate(start: DataFrame, edges: DataFrame, passes: int) -> DataFrame:
    """(id, pass): what is reached from `start` along edges, with the pass that first reached it; ends when a pass adds nothing or at the limit."""
    known = cut(start.select("id").distinct().select("id", F.lit(0).alias("pass")))
    fresh = known.select("id")
    e = edges.select("src", "dst")
    for k in range(1, passes + 1):
        reach = e.join(fresh.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        fresh = cut(reach.join(known, "id", "left_anti"))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh.select("id", F.lit(k).alias("pass"))))
    return known


def betweenness(edges: DataFrame, a: str, b: str, top: int, weight: str | None = None) -> DataFrame:
    """(id, betweenness) on the subgraph of the `top` nodes of highest degree, normalised; by hops, or with `weight` as distance and in the degree. The
    bound on the nodes is the measure's own and makes it one task's work."""
    e = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("a <> b")
    deg = e.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("n")).orderBy(F.desc("n"), "id").limit(top).select("id")
    inner = e.join(deg.withColumnRenamed("id", "a"), "a", "left_semi").join(deg.withColumnRenamed("id", "b"), "b", "left_semi")
    return inner.groupBy().applyInPandas(_brandes, "id string, betweenness double")


def communities(edges: DataFrame, a: str, b: str, weight: str | None = None, bounded: int = BOUNDED) -> DataFrame:
    """(id, community) by greedy modularity on the whole graph; communities are numbered by size, then by smallest id.

    As long as more than `bounded` links between communities are left, every community picks the neighbour whose joining gains most modularity, and
    those that pick each other join, which the pair with the largest gain of all always does. What is left then goes on in one task, pair by pair, the
    largest gain first. Loops do not count, repeated edges add up, null ends do not speak, an empty graph has no communities.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"), w.alias("w")).where("x <> y")
    e = cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")).groupBy("x", "y").agg(F.sum("w").alias("w")))
    total = e.agg(F.sum("w")).first()[0]
    if not total:
        return e.select(F.col("x").alias("id"), F.lit(0).alias("community")).limit(0)
    share = cut(e.groupBy("x").agg((F.sum("w") / total).alias("k")))
    label = share.select(F.col("x").alias("id"), F.col("x").alias("c"))
    while e.count() > 2 * bounded:
        gain = e.join(share, "x").join(share.select(F.col("x").alias("y"), F.col("k").alias("l")), "y").select("x", "y", (F.col("w") / total - F.col("k") * F.col("l")).alias("g")).where("g > 0")
        rank = F.struct("g", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
        best = gain.groupBy("x").agg(F.max_by("y", rank).alias("y"))
        pick = cut(best.join(best.select(F.col("x").alias("y"), F.col("y").alias("x")), ["x", "y"]).where("x < y").select(F.col("y").alias("was"), F.col("x").alias("now")))
        if pick.limit(1).count() == 0:
            break
        moved = lambda df, c: df.join(pick, df[c] == pick["was"], "left").withColumn(c, F.coalesce("now", c)).drop("was", "now")
        label = cut(moved(label, "c"))
        share = cut(moved(share, "x").groupBy("x").agg(F.sum("k").alias("k")))
        new = cut(moved(moved(e, "x"), "y").where("x <> y").groupBy("x", "y").agg(F.sum("w").alias("w")))
        drop_cut(e)
        e = new

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return _greedy_modularity(pdf, total)

    left = e.where("x < y").join(share, "x").join(share.select(F.col("x").alias("y"), F.col("k").alias("l")), "y")
    joined = left.groupBy().applyInPandas(finish, "was string, now string")
    label = cut(label.join(joined, label["c"] == joined["was"], "left").select("id", F.coalesce("now", "c").alias("c")))
    sizes = label.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    from evidentia.operators.relational import global_rank

    numbered = global_rank(sizes, [F.desc("n"), F.asc("first")]).select("c", (F.col("rank") - 1).cast("int").alias("community"))
    return label.join(numbered, "c").select("id", "community")


def _brandes(pdf: pd.DataFrame) -> pd.DataFrame:
    adj: dict = {}
    for x, y, w in zip(pdf["a"], pdf["b"], pdf["w"]):
        adj.setdefault(x, {})[y] = w
        adj.setdefault(y, {})[x] = w
    score = dict.fromkeys(sorted(adj), 0.0)
    for s in score:
        far, paths, order, before, heap = {}, {s: 1.0}, [], {s: []}, [(0.0, s)]
        best = {s: 0.0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in far:
                continue
            far[v] = d
            order.append(v)
            for u, w in adj[v].items():
                n = d + w
                if u not in best or n < best[u] - 1e-12:
                    best[u], paths[u], before[u] = n, paths[v], [v]
                    heapq.heappush(heap, (n, u))
                elif abs(n - best[u]) <= 1e-12 and u not in far:
                    paths[u] += paths[v]
                    before[u].append(v)
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                dep[u] += paths[u] / paths[v] * (1 + dep[v])
            if v != s:
                score[v] += dep[v]
    n = len(score)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return pd.DataFrame({"id": list(score), "betweenness": [v * scale for v in score.values()]})


def _greedy_modularity(pdf: pd.DataFrame, total: float) -> pd.DataFrame:
    """(was, now): communities that join another, pair by pair by the largest gain, equal gains by the smaller names. pdf: x, y, w, and their shares k, l."""
    between: dict[str, dict[str, float]] = {}
    share: dict[str, float] = {}
    for x, y, w, k, m in zip(pdf["x"], pdf["y"], pdf["w"], pdf["k"], pdf["l"]):
        between.setdefault(x, {})[y] = w
        between.setdefault(y, {})[x] = w
        share[x], share[y] = k, m
    gain = lambda x, y: between[x][y] / total - share[x] * share[y]
    heap = [(-gain(x, y), x, y) for x in between for y in between[x] if x < y]
    heapq.heapify(heap)
    now: dict[str, str] = {}
    while heap:
        g, x, y = heapq.heappop(heap)
        if x not in between or y not in between[x] or abs(g + gain(x, y)) > 1e-15:
            continue  # an older state of the pair; the present one is in the heap too
        if -g <= 1e-12:
            break
        for z, w in between.pop(y).items():
            del between[z][y]
            if z != x:
                between[x][z] = between[z][x] = between[x].get(z, 0.0) + w
        share[x] += share.pop(y)
        now[y] = x
        for z in between[x]:
            heapq.heappush(heap, (-gain(x, z), min(x, z), max(x, z)))
    rows = []
    for y in now:
        x = y
        while x in now:
            x = now[x]
        rows.append((y, x))
    return pd.DataFrame(rows, columns=["was", "now"])
