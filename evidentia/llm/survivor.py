"""Best representative of each duplicate group: skyline layers over trust, completeness and a measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.common import cut, usable

#: Records of a group for each copy of its cells, and groups with copies that may be broadcast.
PER_COPY, FEW = 20_000, 50_000


def bare_doi(c: Column | str) -> Column:
    """A usable DOI in lower case, without resolver or doi: prefix and closing slashes; null if nothing is left."""
    x = F.regexp_replace(F.lower(usable(c)), r"^(?:(?:https?://)?(?:dx\.|www\.)?doi\.org/+|doi\s*:?\s*)+", "")
    x = F.regexp_replace(x, r"[\s/]+$", "")
    return F.when(x != "", x)


def last_known(rows: DataFrame, ident: str, value: Column, at: str) -> Column:
    """Aggregate: the last non-null value by time; rows without a time come first, equal times give the larger value."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(F.coalesce(F.col(at), F.lit("0001-01-01").cast("timestamp")), value)))


def survivors(records: DataFrame, group: str, ident: str, levels: list[str], measure: str, fills: list[str], recency: list[str] | None = None) -> DataFrame:
    """(group, keep, *fills, measure): per group the record to keep and the best known value of each field.

    records: one row per (group, ident). levels (trust, completeness and the like, by importance) and recency (say, the month of the last check) are small
    whole numbers, measure is a number or null (below all numbers); more is better in each. A record is dominated if another is at least as good in all
    of them and better in a level or the measure: being older alone does not put a record out, being newer keeps it in. Of the skyline, those that are
    not dominated, the policy keeps the record with the highest levels in their order, then measure, then the smallest id. A field takes the value of the
    first record in that order, among the first dominance layer that knows it: a layer is the skyline of what the earlier ones left. The measure is the
    largest of the group, which a skyline always holds; null where no record has one.

    Dominance needs the largest measure per group and combination of levels only, found with partial aggregates and joined back over copies that follow the
    size of the group. Only groups that still miss a field some later record knows go on to another layer. Null levels are 0. Null groups or ids do not
    speak. An empty table gives no rows.
    """
    low = F.lit(float("-inf"))
    ls, rs = [f"t{k}" for k in range(len(levels))], [f"r{k}" for k in range(len(recency or []))]
    rest = records.where(F.col(group).isNotNull() & F.col(ident).isNotNull()).select(
        F.col(group).alias("g"), F.col(ident).alias("i"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(x) for x, c in zip(ls + rs, levels + (recency or []))],
        F.coalesce(F.col(measure).cast("double"), low).alias("m"), *[F.col(f).alias(f"f{k}") for k, f in enumerate(fills)],
    )
    rest = cut(rest)
    order = F.struct(*[(-F.col(x)).alias(x) for x in ls], (-F.col("m")).alias("m"), F.col("i").alias("i"))

    def beats(x: Column) -> Column:
        as_good, better = x["m"] >= F.col("m"), x["m"] > F.col("m")
        for c in ls:
            as_good, better = as_good & (x[c] >= F.col(c)), better | (x[c] > F.col(c))
        for c in rs:
            as_good = as_good & (x[c] >= F.col(c))
        return as_good & better

    layers = []
    while True:
        cells = rest.groupBy("g", *ls, *rs).agg(F.max("m").alias("m"), F.count("*").alias("n")).groupBy("g").agg(F.collect_list(F.struct(*ls, *rs, "m")).alias("cells"), F.sum("n").alias("n"))
        cells = cut(cells.withColumn("copies", F.least(F.ceil(F.col("n") / PER_COPY), F.lit(1 << 16)).cast("int")))
        most = cells.agg(F.max("copies")).first()[0] or 1
        if most == 1:
            seen = rest.join(cells.select("g", "cells"), "g")
        else:  # groups of many records are spread
            few = cells.where("copies > 1").select("g", "copies")
            copied = cells.select("g", "cells", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("_s"))
            spread = rest.join(F.broadcast(few), "g", "left").withColumn("_s", F.when(F.col("copies") > 1, F.pmod(F.xxhash64("i"), F.col("copies"))).otherwise(0).cast("int")) if few.limit(FEW + 1).count() <= FEW else None
            if spread is None:
                spread = rest.withColumn("_s", F.pmod(F.xxhash64("i"), F.lit(64)).cast("int"))
                copied = cells.select("g", "cells", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_s"))
            seen = spread.join(copied, ["g", "_s"]).drop("_s", "copies")
        seen = seen.withColumn("beaten", F.exists("cells", beats)).drop("cells")
        known = [F.min_by(f"f{k}", F.when(~F.col("beaten") & F.col(f"f{k}").isNotNull(), order)).alias(f"f{k}") for k in range(len(fills))]
        later = [F.max(F.when(F.col("beaten"), F.col(f"f{k}").isNotNull())).alias(f"l{k}") for k in range(len(fills))]
        found = cut(seen.groupBy("g").agg(F.min_by("i", F.when(~F.col("beaten"), order)).alias("keep"), F.max("m").alias("m"), *known, *later))
        layers.append(found.select("g", F.lit(len(layers)).alias("layer"), "keep", "m", *[f"f{k}" for k in range(len(fills))]))
        open_ = F.lit(False)
        for k in range(len(fills)):
            open_ = open_ | (F.col(f"f{k}").isNull() & F.coalesce(F.col(f"l{k}"), F.lit(False)))
        more = found.where(open_).select("g")
        if more.isEmpty():
            break
        rest = cut(seen.where("beaten").drop("beaten").join(more, "g", "left_semi"))
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("layer")))
    out = out.groupBy("g").agg(F.min_by("keep", "layer").alias("keep"), *[first(f"f{k}").alias(f) for k, f in enumerate(fills)], F.max("m").alias("m"))
    return out.select(F.col("g").alias(group), "keep", *fills, F.when(F.col("m") > low, F.col("m")).alias(measure))
