"""Queries of the general data-quality problems (2, 6, 7) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.common import clean_id, table
from evidentia.operators import hotkeys, packed, references


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    seeds, views = table(spark, d, "manual_seed_works"), table(spark, d, "corpus_integrated_communities")
    cells = [
        seeds.select(F.lit(f).alias("field"), F.col("seed_row").alias("row_no"), F.col(f).alias("cell")) for f in ("roles", "publication_types")
    ] + [views.select(F.lit("citation_roles").alias("field"), "row_no", F.col("citation_roles").alias("cell"))]
    return packed.split_packed(cells[0].unionByName(cells[1]).unionByName(cells[2]), "cell", "field", ["row_no"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "canonical_works").select(F.col("primary_community_id").alias("community_id"), clean_id("work_id").alias("work_id"), "citation_count_work")
    return hotkeys.top_by_key(works, "community_id", "citation_count_work", "work_id", 3)


def _quantiles(df: DataFrame, key: str, value: str) -> DataFrame:
    q = hotkeys.quantiles(df, key, value, [0.5, 0.9, 0.99])
    return q.select(key, F.col("prob").alias("prob"), F.round("quantile", 6).alias("quantile"))


def p6_work_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _quantiles(table(spark, d, "canonical_works").select("primary_community_id", "citation_count_work"), "primary_community_id", "citation_count_work")


def p6_view_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _quantiles(table(spark, d, "corpus_integrated_communities").select("community_id", "works"), "community_id", "works")


#: The tables whose references are checked, with the column that dates a reference.
REFERRING = {"human_review_decisions": "reviewed_at", "pass2_errors": "logged_at", "exploration_disconnected": "noted_at"}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = [references.reference_periods(table(spark, d, t), t, "work_id", at) for t, at in REFERRING.items()]
    register = references.parents(table(spark, d, "canonical_works"), "work_id", "first_seen_at", "retired_at")
    return references.orphans(refs[0].unionByName(refs[1]).unionByName(refs[2]), register)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", F.col("ref").alias("work_id"), "ref_month", "kind")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan keys and the references of those keys, per table, month and kind."""
    return _orphans(spark, d).groupBy("src_table", "ref_month", "kind").agg(F.count("*").alias("n_keys"), F.sum("n_refs").alias("n_refs"))


QUERIES = {"p2_found": p2_found, "p6_found": p6_found, "p6_work_quantiles": p6_work_quantiles, "p6_view_quantiles": p6_view_quantiles, "p7_found": p7_found, "p7_report": p7_report}

_ID = "lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)))"
_USABLE = _ID + " not in ('','nan','none','null')"
_P7 = f"""with reg as (select {_ID.format('work_id')} ref, min(first_seen_at) s, max(retired_at) r from canonical_works where {_USABLE.format('work_id')} group by 1),
refs as (""" + " union all ".join(f"select '{t}' src_table, {_ID.format('work_id')} ref, {at} at_ from {t} where {_USABLE.format('work_id')}" for t, at in REFERRING.items()) + """),
m as (select src_table, refs.ref, coalesce(strftime(at_, '%Y-%m'), 'none') ref_month, at_, reg.ref is null gone, s, r from refs left join reg on refs.ref = reg.ref),
per as (select src_table, ref, ref_month, bool_or(gone) gone, coalesce(bool_or(at_ < s), false) late, coalesce(bool_or(at_ >= r), false) dead, count(*) n from m group by 1, 2, 3),
o as (select *, 'missing' kind from per where gone union all select *, 'later' from per where late union all select *, 'deleted' from per where dead) """
_Q = """with v as (select {k} k, cast({v} as double) v from {t} where {k} is not null and {v} is not null), p as (select unnest([0.5, 0.9, 0.99]) prob)
select k {k}, cast(prob as double) prob, round(case prob when 0.5 then a when 0.9 then b else c end, 6) quantile
from (select k, quantile_cont(v, 0.5) a, quantile_cont(v, 0.9) b, quantile_cont(v, 0.99) c from v group by k), p"""
ORACLES = {
    "p6_found": f"""with w as (select primary_community_id c, {_ID.format('work_id')} w, max(citation_count_work) n from canonical_works
where primary_community_id is not null and citation_count_work is not null and {_USABLE.format('work_id')} group by 1, 2),
r as (select c, w, row_number() over (partition by c order by n desc, w) place from w)
select c community_id, cast(place as integer) place, w work_id from r where place <= 3""",
    "p6_work_quantiles": _Q.format(k="primary_community_id", v="citation_count_work", t="canonical_works"),
    "p6_view_quantiles": _Q.format(k="community_id", v="works", t="corpus_integrated_communities"),
    "p7_found": _P7 + "select src_table, ref work_id, ref_month, kind from o",
    "p7_report": _P7 + "select src_table, ref_month, kind, count(*) n_keys, cast(sum(n) as bigint) n_refs from o group by 1, 2, 3",
}
