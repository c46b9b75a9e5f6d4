"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.common import clean_id


def reference_periods(df: DataFrame, name: str, ref: str, at: str) -> DataFrame:
    """(src_table, ref, ref_month, first_at, last_at, n): the references of a table, counted per key and month before they are shuffled. A null time gives the month none."""
    month = F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("none"))
    rows = df.select(F.lit(name).alias("src_table"), clean_id(ref).alias("ref"), month.alias("ref_month"), F.col(at).cast("timestamp").alias("at")).where("ref is not null")
    return rows.groupBy("ref", "src_table", "ref_month").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))


def parents(df: DataFrame, key: str, seen: str, retired: str) -> DataFrame:
    """(ref, seen_at, retired_at): one row per distinct usable key."""
    return df.select(clean_id(key).alias("ref"), F.col(seen).cast("timestamp").alias("s"), F.col(retired).cast("timestamp").alias("r")).where("ref is not null").groupBy("ref").agg(F.min("s").alias("seen_at"), F.max("r").alias("retired_at"))


def orphans(periods: DataFrame, register: DataFrame) -> DataFrame:
    """(src_table, ref, ref_month, kind, n_refs) of references that do not hold.

    missing: the key is not in the register, by a left anti-join of the distinct keys, joined back to their periods.
    later, deleted: some reference of that month is before the key was first seen, or at or after it was retired; both may be true.
    Null, blank and unusable references are no references; a null time can only be missing; a null seen_at or retired_at bounds nothing.
    Each distinct key carries its own periods (months times tables, however often it is referenced), so the join back moves nothing twice
    and a key that holds a tenth of all rows is a handful of rows.
    """
    p = F.struct("src_table", "ref_month", "first_at", "last_at", "n")
    keys = periods.groupBy("ref").agg(F.collect_list(p).alias("p"))
    gone = keys.join(register.select("ref"), "ref", "left_anti").select("ref", F.explode("p").alias("p")).select("ref", "p.*", F.lit("missing").alias("kind"))
    there = keys.join(register, "ref").select("ref", "seen_at", "retired_at", F.explode("p").alias("p")).select("ref", "seen_at", "retired_at", "p.*")
    kinds = F.array_compact(F.array(F.when(F.col("first_at") < F.col("seen_at"), "later"), F.when(F.col("last_at") >= F.col("retired_at"), "deleted")))
    out = there.withColumn("kind", F.explode(kinds))
    cols = ["src_table", "ref", "ref_month", "kind", F.col("n").alias("n_refs")]
    return gone.select(*cols).unionByName(out.select(*cols))
