"""Queries of the problems tagged llm, over their whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.common import clean_id, table, usable
from evidentia.llm import components, leakage, linkage, mixing, names, reading, survivor

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _linked(spark: SparkSession, d: str, each_once: bool) -> DataFrame:
    q = table(spark, d, "web_search_queue").withColumn("_id", clean_id("work_id"))
    c = table(spark, d, "canonical_works").withColumn("_id", clean_id("work_id"))
    got = linkage.link(linkage.describe(q, "_id", "title", "doi", "year", "authors", 0), linkage.describe(c, "_id", "title", "doi", "year", "authors", 1), each_once=each_once)
    return got.select(F.col("queue_id").alias("queue_work_id"), "work_id", F.round("confidence", 6).alias("confidence"))


@query
def p1_matches(spark: SparkSession, d: str) -> DataFrame:
    """p1_found with the confidence of each match."""
    return _linked(spark, d, False)


@query
def p1_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """The assignment of largest total confidence in which each work also stands once."""
    return _linked(spark, d, True)


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_matches(spark, d).select("queue_work_id", "work_id")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "exploration_duplicates_expanded").select(clean_id("preprint_wid").alias("a"), clean_id("published_wid").alias("b"))
    b = table(spark, d, "dedupe_log").select(clean_id("kept_paper_id").alias("a"), clean_id("merged_paper_id").alias("b"))
    return a.unionByName(b)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.hash_to_min(_pairs(spark, d), "a", "b")


def _works_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per work of a duplicate group, each field the last usable one by checked_at."""
    rows = table(spark, d, "exploration_duplicates_expanded").select(
        clean_id("preprint_wid").alias("a"), clean_id("published_wid").alias("b"), survivor.bare_doi("preprint_doi").alias("da"), survivor.bare_doi("published_doi").alias("db"), "cites_a", "cites_b",
        usable("title").alias("title"), usable(F.col("pub_years").cast("string")).alias("years"), usable("pair_class").alias("pair_class"), "checked_at",
    ).where("a <> b")
    groups = components.hash_to_min(rows, "a", "b")
    side = lambda w, p, doi, n: F.struct(F.col(w).alias("wid"), F.lit(p).alias("published"), F.col(doi).alias("doi"), F.col(n).cast("bigint").alias("cites"))
    more = ["title", "years", "pair_class"]
    sides = rows.select(F.explode(F.array(side("a", 0, "da", "cites_a"), side("b", 1, "db", "cites_b"))).alias("x"), *more, "checked_at").select("x.*", *more, "checked_at")
    last = {c: survivor.last_known(sides, "wid", F.col(c), "checked_at") for c in ["doi", "cites", *more]}
    month = (F.year(F.max("checked_at")) * 12 + F.month(F.max("checked_at"))).alias("month")
    works = sides.groupBy("wid").agg(F.max("published").alias("published"), month, *[v.alias(c) for c, v in last.items()])
    return works.join(groups, works["wid"] == groups["rec_id"]).withColumn("has_doi", F.col("doi").isNotNull().cast("int"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    best = survivor.survivors(_works_of_groups(spark, d), "group_id", "wid", ["published", "has_doi"], "cites", ["doi"], ["month"])
    return best.select("group_id", F.col("keep").alias("keep_wid"), F.coalesce("doi", F.lit("")).alias("keep_doi"), F.col("cites").cast("bigint").alias("keep_cites"))


@query
def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """p4_found with a record built field by field: what the first layer does not know comes from the next that does."""
    best = survivor.survivors(_works_of_groups(spark, d), "group_id", "wid", ["published", "has_doi"], "cites", ["doi", "title", "years", "pair_class"], ["month"])
    return best.select("group_id", "keep", "doi", "title", "years", "pair_class", F.col("cites").cast("bigint").alias("cites"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "manual_seed_works").select(F.explode(F.split("authors", r"[;|]")).alias("name"))
    last = table(spark, d, "label_ultra_core_ranked").select(F.col("last_author").alias("name"))
    return names.same_person(names.spellings([seeds, last]))


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    got = leakage.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return got.select("item_id", "doc_id")


@query
def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lost words to leaks, with what is left of them."""
    got = leakage.scrub(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")
    return got.where("removed_words > 0")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "level_labels"), "grader", "reading_level")


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "reading_level")


@query
def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """How demanding each source's texts are."""
    docs = table(spark, d, "documents").select("doc_id", mixing.source_key("source").alias("source"))
    return _levels(spark, d).join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("docs"), F.avg("reading_level").alias("mean_level"), *[F.count_if(F.col("reading_level") == k).alias(f"level_{k}") for k in range(1, 5)])


@query
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "mix_targets"), "doc_id", "text", "source")
    return report


@query
def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    copies, _ = mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source"), table(spark, d, "mix_targets"), "doc_id", "text", "source")
    return copies


_ID = "lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)))"
_OK = _ID + " not in ('','nan','none','null')"


def _pair_sql(t: str, a: str, b: str) -> str:
    return f"select {_ID.format(a)} a, {_ID.format(b)} b from {t} where {_OK.format(a)} and {_OK.format(b)}"


_P = "with recursive p as (" + _pair_sql("exploration_duplicates_expanded", "preprint_wid", "published_wid")
_REACH = """), e as (select a, b from p where a <> b union select b, a from p where a <> b),
r as (select a s, a t from e union select r.s, e.b from r join e on e.a = r.t), c as (select s id, min(t) grp from r group by s)"""
_DOI = "nullif(regexp_replace(regexp_replace(nullif(nullif(nullif(lower(trim({0})),'nan'),'none'),'null'), '^((https?://)?(dx\\.|www\\.)?doi\\.org/+|doi\\s*:?\\s*)+', ''), '[\\s/]+$', ''), '')"
ORACLES["p3_found"] = _P + " union all " + _pair_sql("dedupe_log", "kept_paper_id", "merged_paper_id") + _REACH + " select id rec_id, grp group_id from c"
ORACLES["p4_found"] = (
    _P + _REACH + f""", s as (select {_ID.format('preprint_wid')} a, {_ID.format('published_wid')} b, {_DOI.format('preprint_doi')} da, {_DOI.format('published_doi')} db, cites_a, cites_b, checked_at
from exploration_duplicates_expanded where {_OK.format('preprint_wid')} and {_OK.format('published_wid')}),
x as (select a w, 0 pub, da doi, cites_a n, checked_at t from s where a <> b union all select b, 1, db, cites_b, checked_at from s where a <> b),
w as (select w, max(pub) pub, arg_max(doi, (coalesce(t, timestamp '0001-01-01'), doi)) filter (doi is not null) doi, arg_max(n, (coalesce(t, timestamp '0001-01-01'), n)) filter (n is not null) n from x group by w),
o as (select grp, w, doi, n, row_number() over (partition by grp order by pub desc, doi is not null desc, n desc nulls last, w) k from w join c on c.id = w.w)
select grp group_id, arg_min(w, k) keep_wid, coalesce(arg_min(doi, k) filter (doi is not null), '') keep_doi, cast(max(n) as bigint) keep_cites from o group by grp"""
)
