"""Views the queries of the evidence-map operators run on, as DataFrames and as SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.common import clean_id, table, usable


class Registry:
    """Queries and oracles of a module: @reg.query(sql) names both after the function; SQL may use the views below."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def keep(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = with_views(sql)
            return f

        return keep


_USABLE = "case when lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))) not in ('','nan','none','null') then trim({0}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) end"


def sql_usable(c: str) -> str:
    return _USABLE.format(c)


VIEWS = {
    # one row per work of the register
    "works": f"""works as (select lower({sql_usable('work_id')}) work_id, max({sql_usable('title')}) title, max({sql_usable('authors')}) authors, max(year) as year, max({sql_usable('venue')}) venue,
max(lower({sql_usable('doi')})) doi, max(citation_count_work) cites, max(primary_community_id) comm, max({sql_usable('source_group')}) source_group, max(member_paper_ids) members,
max({sql_usable('publication_types')}) types, max({sql_usable('abstract')}) abstract, min(first_seen_at) first_seen from canonical_works where {sql_usable('work_id')} is not null group by 1)""",
    # one row per author of a work, in order
    "mentions": """mentions as (select work_id, year, cites, comm, trim(a) author, cast(pos as int) pos, cast(n as int) n from (select work_id, year, cites, comm, unnest(string_split(authors, ';')) a,
unnest(range(1, len(string_split(authors, ';')) + 1)) pos, len(string_split(authors, ';')) n from works where authors is not null))""",
    # a directed citation graph over part keys
    "edges": "edges as (select distinct l_partkey src, cast(l_suppkey * 20 + l_linenumber as bigint) dst from lineitem where l_partkey <> l_suppkey * 20 + l_linenumber)",
    "papers": "papers as (select p_partkey id, cast(1975 + p_size as int) as year, cast(floor(p_retailprice) as int) cites, p_brand brand, p_type ptype, p_name pname, p_size <= 10 core from part)",
    # undirected coauthor pairs with their number of shared works
    "coauthors": "coauthors as (select x.author a, y.author b, count(distinct x.work_id) w from mentions x join mentions y on x.work_id = y.work_id and x.author < y.author group by 1, 2)",
    # decisions of agent and human on the same record
    "reviews": f"""reviews as (select decision_no, lower({sql_usable('work_id')}) work_id, {sql_usable('agent_decision')} agent, {sql_usable('human_decision')} human, {sql_usable('reviewer')} reviewer,
reviewed_at from human_review_decisions)""",
    "seeds": f"""seeds as (select seed_row, lower({sql_usable('work_id')}) work_id, lower({sql_usable('doi')}) doi, {sql_usable('title')} title, {sql_usable('authors')} authors, year, {sql_usable('venue')} venue,
citation_count_work cites, {sql_usable('decision')} decision, {sql_usable('core_gate')} core_gate, confidence, {sql_usable('scale_relationship')} scale, {sql_usable('abstract')} abstract from manual_seed_works)""",
}
_NEEDS = {"mentions": ["works"], "coauthors": ["mentions", "works"]}


def with_views(sql: str) -> str:
    """The SQL with the views it names put before it."""
    import re

    names = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    need: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in need:
                need.append(m)
    ordered = [v for v in VIEWS if v in need]
    if not ordered:
        return sql
    head = ", ".join(VIEWS[v] for v in ordered)
    body = sql.lstrip()
    low = body.lower()
    if low.startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if low.startswith("with ") else f"with {head} {body}"


def works(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "canonical_works")
    text = lambda c: F.max(usable(c))
    return t.withColumn("work_id", clean_id("work_id")).where("work_id is not null").groupBy("work_id").agg(
        text("title").alias("title"), text("authors").alias("authors"), F.max("year").alias("year"), text("venue").alias("venue"), F.max(F.lower(usable("doi"))).alias("doi"), F.max("citation_count_work").alias("cites"),
        F.max("primary_community_id").alias("comm"), text("source_group").alias("source_group"), F.max("member_paper_ids").alias("members"), text("publication_types").alias("types"), text("abstract").alias("abstract"), F.min("first_seen_at").alias("first_seen"),
    )


def mentions(s: SparkSession, d: str) -> DataFrame:
    w = works(s, d).where("authors is not null").withColumn("parts", F.split("authors", ";"))
    return w.select("work_id", "year", "cites", "comm", F.size("parts").alias("n"), F.posexplode("parts").alias("p", "a")).select("work_id", "year", "cites", "comm", F.trim("a").alias("author"), (F.col("p") + 1).alias("pos"), "n")


def edges(s: SparkSession, d: str) -> DataFrame:
    dst = (F.col("l_suppkey") * 20 + F.col("l_linenumber")).cast("bigint")
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), dst.alias("dst")).where("src <> dst").distinct()


def papers(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1975).cast("int").alias("year"), F.floor("p_retailprice").cast("int").alias("cites"), F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"), F.col("p_name").alias("pname"), (F.col("p_size") <= 10).alias("core"))


def coauthors(s: SparkSession, d: str) -> DataFrame:
    from evidentia.operators.graph import project

    return project(mentions(s, d), "work_id", "author")


def reviews(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "human_review_decisions").select("decision_no", clean_id("work_id").alias("work_id"), usable("agent_decision").alias("agent"), usable("human_decision").alias("human"), usable("reviewer").alias("reviewer"), "reviewed_at")


def seeds(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "manual_seed_works")
    return t.select(
        "seed_row", clean_id("work_id").alias("work_id"), F.lower(usable("doi")).alias("doi"), usable("title").alias("title"), usable("authors").alias("authors"), "year", usable("venue").alias("venue"), F.col("citation_count_work").alias("cites"),
        usable("decision").alias("decision"), usable("core_gate").alias("core_gate"), "confidence", usable("scale_relationship").alias("scale"), usable("abstract").alias("abstract"),
    )
