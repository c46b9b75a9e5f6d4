"""Joins, aggregates, ranks and set operations that take more than one DataFrame call."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.common import cut, parallelism
from evidentia.functions.scalars import LETTER_WORDS, PAIR_WORDS, ratio_from, signatures


def working_set(base: DataFrame, drop: DataFrame, rescue: DataFrame) -> DataFrame:
    """(base without drop) and rescue, each key once."""
    key = base.columns[0]
    return base.join(drop, key, "left_anti").unionByName(rescue).distinct()


def filled(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, n, pct): non-null values of each column, in one pass."""
    one = df.agg(F.count("*").alias("_all"), *[F.count(c).alias(c) for c in cols])
    parts = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("n"), F.round(100.0 * F.col(c) / F.col("_all"), 1).alias("pct")) for c in cols])
    return one.select(F.inline(parts))


def left_coalesce(left: DataFrame, right: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Left join; the named columns take the right value where there is one."""
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") if c in left.columns else F.col(c) for c in right.columns if c != key])
    j = left.join(r, key, "left")
    return j.select(key, *[F.coalesce(f"_r_{c}", c).alias(c) if c in cols else F.col(c) for c in left.columns if c != key], *[c for c in right.columns if c not in left.columns])


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails if the right key repeats. The check is part of the plan, so nothing runs twice."""
    counted = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in right.columns if c != key])
    checked = counted.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).cast("bigint")).otherwise(F.col("_n")))
    return left.join(checked.where(F.col("_n") == 1).drop("_n"), key, "left")


def lookup(df: DataFrame, key: str, value: str, order: str, wins: str, name: str) -> DataFrame:
    """(key, name): the value of each key's first or last row."""
    pick = F.max_by if wins == "last" else F.min_by
    return df.groupBy(key).agg(pick(value, order).alias(name))


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(u, v): edges between what their ends map to, loops and repeats dropped. mapping: (id, to)."""
    u, v = mapping.select(F.col("id").alias("src"), F.col("to").alias("u")), mapping.select(F.col("id").alias("dst"), F.col("to").alias("v"))
    return edges.join(u, "src").join(v, "dst").where("u <> v").select("u", "v").distinct()


def block_pairs(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(keys, a, b): pairs a < b that agree in all keys."""
    x, y = df.select(*keys, F.col(ident).alias("a")), df.select(*keys, F.col(ident).alias("b"))
    return x.join(y, keys).where("a < b")


def within(a: Column, b: Column, gap: int) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) <= gap)


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether two intervals meet; an unknown end never parts them."""
    return ~(F.coalesce(a2 < b1, F.lit(False)) | F.coalesce(b2 < a1, F.lit(False)))


def blocked_pairs(df: DataFrame, keys: str, ident: str, tokens: str, year: str, shared: int, gap: int, most: int) -> DataFrame:
    """(a, b) that meet in a block of 2 to `most` members, within `gap` years, with `shared` tokens in common. The block limit is the rule's own."""
    k = df.select(F.explode(keys).alias("k"), F.col(ident).alias("i"), F.col(year).alias("y"), F.col(tokens).alias("w")).where("k is not null")
    ok = k.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).select("k")
    k = k.join(ok, "k")
    x, y = k.select("k", F.col("i").alias("a"), F.col("y").alias("y1"), F.col("w").alias("w1")), k.select("k", F.col("i").alias("b"), F.col("y").alias("y2"), F.col("w").alias("w2"))
    return x.join(y, "k").where("a < b").where(within(F.col("y1"), F.col("y2"), gap)).where(F.size(F.array_intersect("w1", "w2")) >= shared).select("a", "b").distinct()


def era_join(df: DataFrame, year: str, eras: list[tuple[str, int, int]], name: str = "era") -> DataFrame:
    """The first era that holds the year; years outside go to the nearest end. Eras are a few literals, so this is a projection."""
    out = F.lit(eras[-1][0])
    for n, _, hi in reversed(eras[:-1]):
        out = F.when(F.col(year) <= hi, n).otherwise(out)
    return df.withColumn(name, out)


def fallback_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], ident: str) -> DataFrame:
    """left with (hit, how): the smallest id that agrees in the first key that finds any."""
    out = left
    for name, key in keys:
        side = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k_{name}")).agg(F.min(ident).alias(f"_h_{name}"))
        out = out.join(side, out[key] == side[f"_k_{name}"], "left")
    how = reduce(lambda a, n: F.when(F.col(f"_h_{n}").isNotNull(), n).otherwise(a), [n for n, _ in reversed(keys)], F.lit(None).cast("string"))
    return out.withColumn("hit", F.coalesce(*[F.col(f"_h_{n}") for n, _ in keys])).withColumn("how", how)


def close_texts(left: DataFrame, right: DataFrame, least: float, gap: int, ends: int = 18) -> DataFrame:
    """(t, year, t2, y2): texts with years within the gap, less those whose letters alone keep their ratio below `least`: a ratio leaves at most (1 - least) of
    both texts' letters over, the differences of length, letters and pairs of letters are bounded by that, and so is the edit distance. Years are part of the
    key; those bounds are bit counts. ends: only texts that begin or end with the same `ends` letters; 0: all texts, whose lengths are part of the key."""
    y, none = F.col("year"), F.lit(-(1 << 40))  # no year is as low
    parts = 2 * parallelism(left.sparkSession)  # signatures and ratios cost far more than moving a text

    def signed(df: DataFrame, t: str, n: str) -> DataFrame:
        texts = df.select(t).repartition(parts, t).distinct().withColumn("g", signatures(F.col(t)))
        return df.join(texts, t).select(*df.columns, F.length(t).alias(f"{n}len"), *[F.col("g")[k].alias(f"{n}{k}") for k in range(LETTER_WORDS + PAIR_WORDS)])

    # of two texts within the bound the longer has at most `most` times the letters; a step is a quarter of that
    most = (1 + (1 - least + 1e-6)) / (1 - (1 - least + 1e-6)) if least > 2e-6 else float("inf")
    step = lambda n, by=0.0: F.floor(4 * F.log(F.greatest(n, F.lit(1))) / math.log(most) + by)
    if ends:
        alike = lambda t: F.array(F.concat(F.lit("p"), F.substring(t, 1, ends)), F.concat(F.lit("s"), F.substring(F.reverse(t), 1, ends)))
        asked, held = alike("t"), alike("t2")
    else:
        asked, held = F.sequence(step(F.col("alen"), -4.001), step(F.col("alen"), 4.001)), F.array(step(F.col("blen")))
    # without a year a text meets any, once; a known year also meets those without
    a = signed(left.select("t", y.cast("int").alias("year")).distinct(), "t", "a").withColumn("k", F.explode(asked))
    a = a.withColumn("ky", F.explode(F.when(y.isNull(), F.array(none - 1)).otherwise(F.concat(F.array(*[y.cast("bigint") + d for d in range(-gap, gap + 1)]), F.array(none)))))
    b = signed(right.select("t2", F.col("y2").cast("int").alias("y2")).distinct(), "t2", "b").withColumn("k", F.explode(held))
    b = b.withColumn("ky", F.explode(F.array(F.coalesce(F.col("y2").cast("bigint"), none), none - 1)))
    room = F.floor((1 - least + 1e-6) * (F.col("alen") + F.col("blen"))).cast("int")
    off = lambda ks: reduce(lambda x, k: x + F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))), ks, F.lit(0))
    near = (F.abs(F.col("alen") - F.col("blen")) <= room) & (off(range(LETTER_WORDS)) <= room) & (off(range(LETTER_WORDS, LETTER_WORDS + PAIR_WORDS)) <= 3 * room)
    pairs = a.join(b, ["k", "ky"]).where(near).where(F.call_function("levenshtein", F.col("t"), F.col("t2"), room) >= 0)
    pairs = pairs.select("t", "year", "t2", "y2").repartition(parts, "t", "year", "t2", "y2")
    return pairs.distinct() if ends else pairs


def fuzzy_titles(left: DataFrame, right: DataFrame, least: float, gap: int, ends: int = 18) -> DataFrame:
    """(seed_row, work_id, ratio): same DOI, or years within the gap and a similarity of at least `least`; ends: as in close_texts, 0 for all titles. The ratio
    runs once for texts and years that many rows share, and only on pairs that can reach it."""
    near = close_texts(left, right, least, gap, ends).withColumn("ratio", ratio_from(F.col("t"), F.col("t2"), least)).where("ratio is not null")
    a, b = left.select("seed_row", "t", F.col("year").cast("int").alias("year")), right.select("work_id", "t2", F.col("y2").cast("int").alias("y2"))
    near = near.join(a, (near["t"] == a["t"]) & near["year"].eqNullSafe(a["year"])).select("seed_row", near["t2"], near["y2"], "ratio")
    near = near.join(b, (near["t2"] == b["t2"]) & near["y2"].eqNullSafe(b["y2"])).select("seed_row", "work_id", "ratio")
    same = left.join(right, left["d1"] == right["d2"]).select("seed_row", "work_id", F.lit(1.0).alias("ratio"))
    return near.unionByName(same).groupBy("seed_row", "work_id").agg(F.max("ratio").alias("ratio"))


def prefix_join(left: DataFrame, a: str, right: DataFrame, b: str, least: int) -> DataFrame:
    """Pairs of which one text begins with the other, both at least `least` long: an equi join on their first characters."""
    x, y = left.where(F.length(a) >= least).withColumn("_p", F.substring(a, 1, least)), right.where(F.length(b) >= least).withColumn("_p", F.substring(b, 1, least))
    return x.join(y, "_p").where(F.col(a).startswith(F.col(b)) | F.col(b).startswith(F.col(a))).drop("_p")


def unique_match(left: DataFrame, right: DataFrame, key: str, ident: str) -> DataFrame:
    """left with hit where exactly one id agrees, else the ids in `ambiguous`."""
    side = right.groupBy(key).agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_list(ident)), ";").alias("_ids"), F.min(ident).alias("_min"))
    return left.join(side, key, "left").withColumn("hit", F.when(F.col("_n") == 1, F.col("_min"))).withColumn("ambiguous", F.when(F.col("_n") > 1, F.col("_ids")))


def first_containing(fragments: DataFrame, frag: str, docs: DataFrame, text: str, ident: str, gram: int = 4) -> DataFrame:
    """fragments with `first`, the smallest id of a text that holds the fragment, ignoring case. Texts meet the fragments whose first `gram` characters they
    hold, in a join, and are then searched for these only. A null fragment is found nowhere."""
    known = fragments.select(F.lower(frag).alias("_f")).where("_f <> ''").distinct().withColumn("_k", F.substring("_f", 1, gram))
    sizes = [r[0] for r in known.select(F.length("_k")).distinct().collect()]  # at most `gram` of them
    t = docs.select(F.col(ident).alias("_i"), F.lower(text).alias("_t")).where("_t is not null")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("_t") - n + 1, F.lit(1))), lambda i: F.substring(F.col("_t"), i, n))
    keyed = t.select("_i", "_t", F.explode(F.array_distinct(F.concat(*[grams(n) for n in sizes]))).alias("_k")) if sizes else t.select("_i", "_t", F.lit(None).cast("string").alias("_k"))
    found = keyed.join(known, "_k").where(F.contains("_t", F.col("_f"))).groupBy("_f").agg(F.min("_i").alias("first"))
    return fragments.join(found, F.lower(frag) == F.col("_f"), "left").drop("_f")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with margins named All."""
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b")).select(F.when(F.col("_a") == 1, "All").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "All").otherwise(F.col(b)).alias(b), "n")


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which must end in a unique column. Spark keeps one row a key and partition before it shuffles."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def outlier_cut(df: DataFrame, value: str) -> DataFrame:
    z = df.agg(F.percentile(F.log1p(value), F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.percentile(value, F.lit(0.95)).alias("p95"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return z.select(F.round(F.greatest(F.ceil(F.round(F.expm1(q3 + 1.5 * (q3 - q1)), 9)).cast("double"), F.col("p95")), 4).alias("cut"))


def mode_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value, the smaller of equals."""
    c = df.groupBy(key, value).agg(F.count("*").alias("_c"))
    return c.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_c"), value)).alias(value))


def threshold_curve(df: DataFrame, value: str, steps: list[int]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(value) >= t).alias(f"t{t}") for t in steps])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"t{t}").alias("n")) for t in steps])))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa): Cohen's kappa, null where chance agreement is certain. The raters' confusion table is all that is shuffled."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(F.struct(F.col("a").alias("k"), F.col("c").alias("x"), zero.alias("y"), F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(zero).alias("o")), F.struct(F.col("b").alias("k"), zero.alias("x"), F.col("c").alias("y"), zero.alias("o")))
    k = c.select(F.inline(sides)).groupBy("k").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("o").alias("o"))
    one = k.agg(F.sum("x").alias("n"), F.sum("o").alias("o"), F.sum(F.col("x").cast("double") * F.col("y")).alias("s"))
    po, pe = F.col("o") / F.col("n"), F.col("s") / (F.col("n").cast("double") * F.col("n"))
    return one.select(F.coalesce("n", zero).alias("n"), F.round(po, 6).alias("agreement"), F.when(pe != 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def distinct_counts(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row with the number of distinct non-null values of each column, by new name: one shuffle of the distinct (column, value) pairs."""
    pairs = F.array(*[F.struct(F.lit(n).alias("c"), F.col(c).cast("string").alias("v")) for c, n in cols.items()])
    n = df.select(F.inline(pairs)).where("v is not null").distinct().groupBy("c").agg(F.count("*").alias("n"))
    return n.agg(*[F.coalesce(F.max(F.when(F.col("c") == x, F.col("n"))), F.lit(0).cast("bigint")).alias(x) for x in cols.values()])


def bins(df: DataFrame, value: str, starts: list[float]) -> DataFrame:
    """df with lo, the largest start not above the value."""
    out = F.lit(starts[0])
    for x in starts[1:]:
        out = F.when(F.col(value) >= x, F.lit(x)).otherwise(out)
    return df.withColumn("lo", out)


def overlap_by(a: DataFrame, b: DataFrame, label: str, ident: str) -> DataFrame:
    """(label, a, b, both_n, jac): how far two sets of ids per label agree."""
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [label, ident], "full_outer")
    got = j.groupBy(label).agg(F.count("_a").alias("a"), F.count("_b").alias("b"), F.count(F.col("_a") + F.col("_b")).alias("both_n"), F.count("*").alias("_u"))
    return got.select(label, "a", "b", "both_n", F.round(F.col("both_n") / F.col("_u"), 6).alias("jac"))


def set_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, both_n, u, jac) of two key sets (column k), nulls left out."""
    one = lambda x, n: x.where("k is not null").distinct().withColumn(n, F.lit(1))
    j = one(a, "_a").join(one(b, "_b"), "k", "full_outer")
    got = j.agg(F.count("_a").alias("a"), F.count("_b").alias("b"), F.count(F.col("_a") + F.col("_b")).alias("both_n"), F.count("*").alias("u"))
    return got.withColumn("jac", F.round(F.col("both_n") / F.col("u"), 6))


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted over range partitions and written once, with _p, the partition, and _i, the place in it."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    s = df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_m"))
    return cut(s.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"))


def _before(sums: DataFrame) -> DataFrame:
    """(_p, _b): the sum of _n over the partitions before. A row per partition, so one task and a broadcast are enough."""
    return F.broadcast(sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b")))


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `rank` 1..n in the given order, without sorting in one task: a range-partitioned sort, then the sizes of the partitions before."""
    s = _ranged(df, order)
    return s.join(_before(s.groupBy("_p").agg(F.count("*").alias("_n"))), "_p").withColumn("rank", F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")


def rank_within(df: DataFrame, group: Column, order: list[Column]) -> DataFrame:
    """df with `rank` 1..n within each group (null is one), however few groups hold all rows: ranks over all rows by group and order, less what is before
    the group. Only the groups' offsets are joined back."""
    r = global_rank(df.withColumn("_g", group), [F.asc_nulls_first("_g"), *order])
    first = r.groupBy(F.col("_g").alias("_h")).agg((F.min("rank") - 1).alias("_f"))
    return r.join(first, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("rank", F.col("rank") - F.col("_f")).drop("_g", "_h", "_f")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with `name`, the sum of `value` up to and with each row in the given order: running sums of each range partition, and those of the partitions before."""
    s = _ranged(df, order)
    here = F.sum(value).over(Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("_here", here).join(_before(s.groupBy("_p").agg(F.sum(value).alias("_n"))), "_p").withColumn(name, F.col("_b") + F.col("_here")).drop("_p", "_i", "_b", "_here")


def percentile_rank(df: DataFrame, value: str, key: str) -> DataFrame:
    """df with pr = i / (n - 1) over (value, key) order; 1 for a single row."""
    r = global_rank(df, [F.asc(value), F.asc(key)])
    n = r.count()
    return r.withColumn("pr", F.lit(1.0) if n == 1 else (F.col("rank") - 1) / F.lit(n - 1)).drop("rank")


def average_rank(df: DataFrame, value: str, within_: str | None = None) -> DataFrame:
    """df with r, the mean rank of its value as a share, within a group or over all. Distinct values are counted and ranked, rows only joined to them."""
    keys = [within_] if within_ else []
    c = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    total = c.groupBy(*keys).agg(F.sum("_c").alias("_t"))
    upto = running_total(c, [F.asc(k) for k in [*keys, value]], "_c", "_u")
    if within_:
        total = total.join(upto.groupBy(within_).agg(F.min(F.col("_u") - F.col("_c")).alias("_f")), within_)
        ranks = upto.join(total, within_).withColumn("_u", F.col("_u") - F.col("_f"))
    else:
        ranks = upto.withColumn("_t", F.lit(total.first()[0]))
    ranks = ranks.select(*keys, value, ((F.col("_u") - (F.col("_c") - 1) / 2.0) / F.col("_t")).alias("r"))
    return df.join(ranks, [*keys, value])


def slot(pos: Column, n: Column) -> Column:
    return F.when(n == 1, "single").when(pos == 1, "first").when(pos == n, "last").otherwise("middle")


def cohorts(df: DataFrame, year: str, least: int) -> DataFrame:
    """(year, cohort): years in order, merged until a cohort has `least` rows; a short tail joins the cohort before. Folds the histogram of years, never rows."""
    h = df.groupBy(F.col(year).alias("y")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("h"))
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<struct<y:int,k:int>>").alias("out"))

    def step(a, x):
        full = a["sum"] >= least
        k, total = F.when(full, a["k"] + 1).otherwise(a["k"]), F.when(full, x["n"]).otherwise(a["sum"] + x["n"])
        return F.struct(k.cast("int").alias("k"), total.alias("sum"), F.concat(a["out"], F.array(F.struct(x["y"].cast("int").alias("y"), k.cast("int").alias("k")))).alias("out"))

    z = h.select(F.aggregate("h", zero, step).alias("z"))
    last = F.when((F.col("z.sum") < least) & (F.col("z.k") > 0), F.col("z.k") - 1).otherwise(F.col("z.k"))
    return z.select(F.explode("z.out").alias("x"), last.alias("last")).select(F.col("x.y").alias("year"), F.least("x.k", "last").alias("cohort"))


def union_first(parts: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Rows of several tables, per key the one of the earliest table."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    return best_row(u, [key], [F.asc("_p"), *order]).drop("_p")


def backfill(a: DataFrame, b: DataFrame, key: str, prefer: list[str]) -> DataFrame:
    """All keys of both; columns of a, filled from b where null; `prefer` columns the other way round."""
    r = b.select(key, *[F.col(c).alias(f"_r_{c}") for c in b.columns if c != key])
    j = a.join(r, key, "full_outer")
    pick = lambda c: F.coalesce(f"_r_{c}", c) if c in prefer else F.coalesce(c, f"_r_{c}")
    return j.select(key, *[pick(c).alias(c) for c in a.columns if c != key])


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """base with the non-null values of `over`; base rows and columns only."""
    r = over.select(key, *[F.col(c).alias(f"_r_{c}") for c in over.columns if c != key])
    return base.join(r, key, "left").select(*[F.coalesce(f"_r_{c}", c).alias(c) if f"_r_{c}" in r.columns else F.col(c) for c in base.columns])


def coalesce_sources(df: DataFrame, cols: list[str], value: str, route: str) -> DataFrame:
    how = reduce(lambda a, c: F.when(F.col(c).isNotNull(), c).otherwise(a), reversed(cols), F.lit(None).cast("string"))
    return df.withColumn(value, F.coalesce(*cols)).withColumn(route, how)


def text_of_index(index: Column) -> Column:
    """The text of an inverted index, a map of words to their places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
