"""Per-key results where a few keys hold most rows: exact selection of ranks by refining histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.common import cut, drop_cut

BINS = 64
SALTS = 16


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n) of the rows in which neither is null. Rows are counted before they are shuffled and the shuffle is on both columns, so a hot key is spread over its values."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))


def select_ranks(counts: DataFrame, ranks: list[Column]) -> DataFrame:
    """(k, i, rank, value): for each key and each of `ranks`, the value of that 1-based rank in ascending order.

    counts: (k, v, n) with distinct (k, v). A rank is a column over (k, total); a null rank or one outside 1..total gives no row.
    Each round holds, for every open (key, rank), an interval of values known to contain it and the count below; the values
    inside are counted into BINS bins, of which one is kept. Bins are merged counts: a row per (key, rank, bin) moves, and
    never a key's values. A bin is cut at its own smallest and largest value, so every round drops at least one value and a
    round usually divides the range by BINS. Intervals are copied SALTS times and each value meets one copy, so no task gets all values of a
    hot key. NaN sorts last, as in Spark; infinities are values.
    """
    base = cut(counts.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")))
    keys = base.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    targets = keys.select("*", F.posexplode(F.array(*[r.cast("long") for r in ranks])).alias("i", "rank")).where("rank between 1 and total")
    open_ = cut(targets.select("k", "i", "rank", "lo", "hi", F.lit(0).cast("long").alias("below")))
    parts: list[DataFrame] = []
    while True:
        parts.append(open_.where("lo <=> hi").select("k", "i", "rank", F.col("lo").alias("value")))
        left = open_.where("not (lo <=> hi)")
        if left.isEmpty():
            break
        salted = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        width = F.col("hi") / BINS - F.col("lo") / BINS
        linear = F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / width), F.lit(0)), F.lit(BINS - 1))
        usual = (F.abs("lo") < F.lit(float("inf"))) & (width > 0) & (width < F.lit(float("inf")))
        at = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), BINS).when(usual, linear)
        at = at.otherwise(F.floor(F.atan("v") * (BINS / 4)) + BINS // 2).cast("int")
        bins = (
            base.join(salted, ["k", "_salt"]).where("v >= lo and v <= hi")
            .groupBy("k", "i", "rank", "below", at.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        )
        cell = F.struct("bin", "n", "lo", "hi")
        # at most BINS + 2 cells a (key, rank)
        rows = bins.groupBy("k", "i", "rank", "below").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
        start = F.struct(F.col("below").alias("below"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))

        def step(a: Column, c: Column) -> Column:
            here = a["below"] + c["n"] >= F.col("rank")
            return F.when(a["done"], a).when(here, F.struct(a["below"].alias("below"), c["lo"].alias("lo"), c["hi"].alias("hi"), F.lit(True).alias("done"))).otherwise(
                F.struct((a["below"] + c["n"]).alias("below"), a["lo"].alias("lo"), a["hi"].alias("hi"), a["done"].alias("done"))
            )

        found = rows.select("k", "i", "rank", F.aggregate("cells", start, step).alias("z"))
        open_ = cut(found.select("k", "i", "rank", F.col("z.lo").alias("lo"), F.col("z.hi").alias("hi"), F.col("z.below").alias("below")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = cut(out)
    drop_cut(base)
    return out


def quantiles(df: DataFrame, key: str, value: str, probs: list[float]) -> DataFrame:
    """(key, prob, quantile) with linear interpolation, exact; keys without values give no row. Rows with a null key or value do not speak."""
    at = [1 + (F.col("total") - 1) * F.lit(p) for p in probs]
    ranks = [f(x) for x in at for f in (F.floor, F.ceil)]
    counts = value_counts(df, key, value)
    got = select_ranks(counts, ranks)
    p = F.array(*[F.lit(float(x)) for x in probs])[F.floor(F.col("i") / 2).cast("int")]
    sides = got.groupBy("k", p.alias("prob")).agg(
        F.max(F.when(F.col("i") % 2 == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("i") % 2 == 1, F.col("value"))).alias("b"), F.max(F.when(F.col("i") % 2 == 0, F.col("rank"))).alias("r")
    )
    totals = counts.groupBy("k").agg(F.sum("n").alias("total"))
    part = (F.col("total") - 1) * F.col("prob") + 1 - F.col("r")
    return sides.join(totals, "k").select(F.col("k").alias(key), "prob", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("quantile"))


def top_by_key(df: DataFrame, key: str, value: str, item: str, k: int) -> DataFrame:
    """(key, place, item) of the k rows with the largest value of each key, equal values ordered by the smaller item.

    One row speaks per (key, item): its largest value. The k-th largest value comes from select_ranks; only rows above it (fewer than k a key)
    and rows equal to it remain, and of the equal ones only the k smallest items of each salt are moved on. Rows with null key, value or item
    do not speak; a key with fewer than k items gives all of them.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull() & F.col(item).isNotNull())
    rows = cut(rows.groupBy(F.col(key).alias("k"), F.col(item).alias("item")).agg(F.max(F.col(value).cast("double")).alias("v")))
    edge = select_ranks(value_counts(rows, "k", "v"), [F.greatest(F.col("total") - (k - 1), F.lit(1))]).select("k", F.col("value").alias("edge"))
    salt = F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")
    salted = edge.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = rows.withColumn("_salt", salt).join(salted, ["k", "_salt"]).where("v >= edge")
    order = F.struct((-F.col("v")).alias("v"), F.col("item").alias("item"))
    cut_k = lambda c: F.slice(F.array_sort(c), 1, k)
    # the first grouping keeps k rows of a salt by a bounded window, the second sees at most k * SALTS rows a key
    w = Window.partitionBy("k", "_salt").orderBy(F.desc("v"), "item")
    few = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    best = few.groupBy("k").agg(cut_k(F.collect_list(order)).alias("best"))
    return best.select(F.col("k").alias(key), F.posexplode("best").alias("_place", "_b")).select(key, (F.col("_place") + 1).cast("int").alias("place"), F.col("_b.item").alias(item))
