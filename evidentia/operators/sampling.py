"""Deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.relational import rank_within


def stratified(df: DataFrame, stratum: str, ident: str, share: float, seed: int) -> DataFrame:
    """max(1, round(share * N)) rows of each stratum, those with the smallest hash of seed and id: the same rows whatever the partitioning."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")))
    n = df.groupBy(F.col(stratum).alias("_h")).agg(F.greatest(F.lit(1), F.round(F.count("*") * F.lit(share)).cast("int")).alias("_n"))
    ranked = rank_within(df, F.col(stratum), [draw, F.asc(ident)])
    return ranked.join(n, F.col(stratum).eqNullSafe(F.col("_h"))).where("rank <= _n").select(*df.columns)


def audit(df: DataFrame, when: Column, ident: str, one_in: int, seed: int) -> DataFrame:
    """df with `audit`: about one of `one_in` rows for which `when` holds, by hash."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string"))), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("audit", F.coalesce(when, F.lit(False)) & (draw % one_in == 0))
