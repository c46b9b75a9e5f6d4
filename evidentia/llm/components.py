"""Consolidating pairwise matches into groups: hash-to-min on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.common import cut, drop_cut

#: Members from which a vertex counts as hot, copies its minimum is spread over, and hot vertices that may be broadcast.
HOT, SALTS, HOT_BROADCAST = 20_000, 16, 50_000


def _with_minimum(c: DataFrame, m: DataFrame) -> DataFrame:
    """c (v, u) with the minimum m of each v. Hot vertices are salted, so no task gets all members of a large group."""
    hot = m.where(F.col("n") > HOT).select("v")
    many = hot.limit(HOT_BROADCAST + 1).count()
    if many == 0:
        return c.join(m.select("v", "m"), "v")
    salt = F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    if many > HOT_BROADCAST:  # too many to mark: salt every vertex
        return c.withColumn("_s", salt).join(m.select("v", "m", spread.alias("_s")), ["v", "_s"]).drop("_s")
    marked = c.join(F.broadcast(hot.withColumn("_h", F.lit(True))), "v", "left").withColumn("_s", F.when(F.col("_h"), salt).otherwise(0)).drop("_h")
    copies = m.select("v", "m", F.explode(F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_s"))
    return marked.join(copies, ["v", "_s"]).drop("_s")


def _settled(j: DataFrame) -> DataFrame:
    """(v, u, m) with `open`, false where the group of m is whole.

    m is the smallest member a vertex holds. A row ties v and u; where every row of the vertices with the same m leads to vertices with that m, they are a
    group of their own and m is its smallest id. Seen from a vertex: all the m that rows bring to it, or that it holds itself, are one.
    """
    t = cut(j.select(F.inline(F.array(F.struct(F.col("u").alias("x"), "m"), F.struct(F.col("v").alias("x"), "m")))).distinct())
    torn = t.groupBy("x").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo < hi").select("x")
    marked = t.join(torn, "x", "left_semi").select("m").distinct().withColumn("open", F.lit(True))
    out = cut(j.join(marked, "m", "left").select("v", "u", "m", F.coalesce("open", F.lit(False)).alias("open")))
    drop_cut(t)
    return out


def hash_to_min(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(rec_id, group_id): every id of a pair with two different non-null ids, and the smallest id it is linked to, directly or through others.

    A vertex v holds the set C(v), kept as rows (v, u), never as an array. In each round v sends C(v) to its smallest member and that member to
    all others, which takes a number of rounds that grows with the logarithm of the longest chain. Groups that are whole leave at once: before the first
    round, and after 1, 3, 5 ... rounds; so what is sent again is only the long chains, and the rounds end when none is left. Pairs repeated, turned
    round or with an id equal to the other are no harm; an empty input gives no rows; ids compare as given, by bytes.
    """
    e = pairs.select(F.col(a).cast("string").alias("v"), F.col(b).cast("string").alias("u")).where("v <> u")
    both = F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u")))
    c = cut(e.distinct().select(both.alias("x")).select("x.v", "x.u").distinct())
    sent = F.inline(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
    found, rounds, look = [], 0, 0
    while True:
        m = cut(c.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")))
        j = _with_minimum(c, m)
        if rounds == look:
            look += 1 if look == 0 else 2
            j = _settled(j)
            found.append(j.where("not open").select("v", "m"))
            j = j.where("open")
            if j.limit(1).count() == 0:
                break
        new = cut(j.select(sent).distinct())
        drop_cut(c)
        drop_cut(m)
        c = new
        rounds += 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select(F.col("v").alias("rec_id"), F.col("m").alias("group_id")).distinct()
