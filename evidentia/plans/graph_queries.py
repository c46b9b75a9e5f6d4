"""Graph, nested-data, source and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.common import clean_id, table, usable
from evidentia.operators import graph as G
from evidentia.operators import relational as O
from evidentia.operators import sampling
from evidentia.plans.base import Registry, coauthors, edges, mentions, papers, reviews, seeds, sql_usable, works
from evidentia.sources import files
from evidentia.streaming import progress

REG = Registry()
q = REG.query
QUERIES, ORACLES = REG.queries, REG.oracles
_CORE = "select id from papers where core"


# --- graph


@q("select p.id, cast((select count(*) from edges e join papers x on x.id = e.src where e.dst = p.id) as bigint) indeg, cast((select count(*) from edges e join papers x on x.id = e.dst where e.src = p.id) as bigint) outdeg from papers p")
def g1_degrees(s, d):
    return G.degrees(edges(s, d), papers(s, d).select("id"))


@q(f"""with sd as ({_CORE}), x as (select dst id, 1 k from edges where src in (select id from sd) union all select src, 1 from edges where dst in (select id from sd)), di as (select id, count(*) direct from x group by 1),
cp as (select src id, count(distinct dst) coupled from edges where dst in (select dst from edges where src in (select id from sd)) group by 1), cc as (select dst id, count(distinct src) cocited from edges where src in (select src from edges where dst in (select id from sd)) group by 1)
select coalesce(di.id, cp.id, cc.id) id, coalesce(direct, 0) direct, coalesce(coupled, 0) coupled, coalesce(cocited, 0) cocited from di full join cp on cp.id = di.id full join cc on cc.id = coalesce(di.id, cp.id)""")
def g2_seed_support(s, d):
    return G.seed_support(edges(s, d), papers(s, d).where("core").select("id"))


@q(f"""with c as ({_CORE}), o as (select src id, count(distinct dst) cites_core from edges where dst in (select id from c) group by 1), i as (select dst id, count(distinct src) cited_by_core from edges where src in (select id from c) group by 1),
k as (select a.src id, count(distinct b.src) coupled from edges a join edges b on a.dst = b.dst and a.src <> b.src where b.src in (select id from c) group by 1)
select p.id, coalesce(cites_core, 0) cites_core, coalesce(cited_by_core, 0) cited_by_core, coalesce(coupled, 0) coupled from papers p left join o on o.id = p.id left join i on i.id = p.id left join k on k.id = p.id""")
def g3_core_proximity(s, d):
    e, c = edges(s, d), papers(s, d).where("core").select("id")
    o = e.join(c.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("cites_core"))
    i = e.join(c.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("cited_by_core"))
    of_core = e.join(c.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("other"), "dst")
    k = e.join(of_core, "dst").where("src <> other").select("src", "other").distinct().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("coupled"))
    return papers(s, d).select("id").join(o, "id", "left").join(i, "id", "left").join(k, "id", "left").na.fill(0)


@q(f"""with c as ({_CORE}) select src id, count(*) filter (where dst in (select id from c)) to_core, count(*) n from edges group by 1""")
def g4_direct_counts(s, d):
    e = edges(s, d).join(papers(s, d).select(F.col("id").alias("dst"), "core"), "dst", "left")
    return e.groupBy(F.col("src").alias("id")).agg(F.count_if("core").alias("to_core"), F.count("*").alias("n"))


@q(f"""with c as ({_CORE}), n as (select src id, count(distinct dst) k from edges where dst in (select id from c) group by 1) select p.id from papers p join n on n.id = p.id where k >= 2 and not core and contains(lower(ptype), 'a')""")
def g5_inherited_provenance(s, d):
    p = papers(s, d)
    n = edges(s, d).join(p.where("core").select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("k")).where("k >= 2")
    return p.where(~F.col("core") & F.lower("ptype").contains("a")).join(n, "id", "left_semi").select("id")


@q("""with x as (select a.id, b.core from edges e join papers a on a.id = e.src join papers b on b.id = e.dst where a.core <> b.core union all select b.id, a.core from edges e join papers a on a.id = e.src join papers b on b.id = e.dst where a.core <> b.core) select id, count(*) support from x group by 1""")
def g6_boundary_support(s, d):
    p = papers(s, d)
    e = edges(s, d).join(p.select(F.col("id").alias("src"), F.col("core").alias("c1")), "src").join(p.select(F.col("id").alias("dst"), F.col("core").alias("c2")), "dst").where("c1 <> c2")
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("support"))


_TOL, _MOST = 1e-6, 24


def _rank_sql(weight: str, teleport: str) -> str:
    """Power iteration unrolled, each round a table of its own; the first round that moved less than the tolerance counts."""
    head = f"""with nd as (select id, {teleport} t from papers), v as materialized (select id, t / (select sum(t) from nd) t from nd), ee as (select e.src, e.dst, {weight} w from edges e join papers a on a.id = e.src join papers b on b.id = e.dst),
sw as materialized (select src, sum(w) s from ee group by 1), p as materialized (select ee.src, ee.dst, w / s p from ee join sw on sw.src = ee.src), r0 as materialized (select id, 1.0 / (select count(*) from v) r from v)"""
    for k in range(1, _MOST + 1):
        head += f""", f{k} as (select p.dst id, sum(p.p * r.r) f from p join r{k - 1} r on r.id = p.src group by 1),
r{k} as materialized (select v.id, 0.85 * (coalesce(f, 0) + v.t * (select coalesce(sum(r), 0) from r{k - 1} where id not in (select src from sw))) + 0.15 * v.t r from v left join f{k} on f{k}.id = v.id)"""
    all_ = " union all ".join(f"select {k} k, a.id, a.r, abs(a.r - b.r) moved from r{k} a join r{k - 1} b on b.id = a.id" for k in range(1, _MOST + 1))
    return head + f", x as materialized ({all_}), d as (select k from x group by k having sum(moved) < {_TOL} * count(*)) select id, round(r, 8) r from x where k = (select coalesce(min(k), {_MOST}) from d)"


@q(_rank_sql("cast(1 as double)", "cast(1 as double)"))
def g7_page_rank(s, d):
    return G.page_rank(papers(s, d).select("id"), edges(s, d), 100, tol=_TOL).select("id", F.round("rank", 8).alias("r"))


@q(_rank_sql("cast(1 + (e.src + e.dst) % 3 as double)", "case when core then cast(5 as double) else 1 end"))
def g8_personalized_rank(s, d):
    e = edges(s, d).withColumn("w", 1 + (F.col("src") + F.col("dst")) % 3)
    n = papers(s, d).select("id", F.when(F.col("core"), 5.0).otherwise(1.0).alias("t"))
    return G.page_rank(n, e, 100, weight="w", teleport="t", tol=_TOL).select("id", F.round("rank", 8).alias("r"))


@q(_rank_sql("1.0 / (1 + abs(a.year - b.year))", "exp(ln(10) / (select max(year) - min(year) from papers) * (year - (select min(year) from papers)))"))
def g9_temporal_rank(s, d):
    from math import log

    p = papers(s, d)
    y = p.agg(F.min("year"), F.max("year")).first()
    years = p.select("id", "year")
    e = edges(s, d).join(years.select(F.col("id").alias("src"), F.col("year").alias("y1")), "src").join(years.select(F.col("id").alias("dst"), F.col("year").alias("y2")), "dst").select("src", "dst", (1.0 / (1 + F.abs(F.col("y1") - F.col("y2")))).alias("w"))
    alpha = log(10) / max(1, (y[1] or 0) - (y[0] or 0))
    n = years.select("id", F.exp(F.lit(alpha) * (F.col("year") - (y[0] or 0))).alias("t"))
    return G.page_rank(n, e, 100, weight="w", teleport="t", tol=_TOL).select("id", F.round("rank", 8).alias("r"))


@q()
def g10_k_core(s, d):
    return G.core_numbers(edges(s, d))


@q()
def g11_k_in_core(s, d):
    return G.in_core_numbers(papers(s, d).select("id"), edges(s, d).join(papers(s, d).select(F.col("id").alias("dst")), "dst", "left_semi"), 80)


@q()
def g12_k_core_in_decade(s, d):
    dec = papers(s, d).select("id", F.floor(F.col("year") / 10).alias("dec"))
    e = edges(s, d).join(dec.select(F.col("id").alias("src"), F.col("dec").alias("d1")), "src").join(dec.select(F.col("id").alias("dst"), F.col("dec").alias("d2")), "dst").where("d1 = d2")
    return G.core_numbers(e)


_COMP = """with recursive e as (select a x, b y from coauthors where w >= 1 union select b, a from coauthors), r as (select distinct x s, x t from e union select r.s, e.y from r join e on e.x = r.t) select s id, min(t) component from r group by 1"""


@q(_COMP)
def g13_components(s, d):
    return G.components(coauthors(s, d), "a", "b")


@q(f"""with recursive p as (select lower({sql_usable('work_id')}) a, lower(trim(canonical_paper_id)) b from canonical_works where {sql_usable('work_id')} is not null and canonical_paper_id is not null), e as (select a x, b y from p union select b, a from p), r as (select distinct x s, x t from e union select r.s, e.y from r join e on e.x = r.t) select s id, min(t) component from r group by 1""")
def g14_linked_ids(s, d):
    p = table(s, d, "canonical_works").select(clean_id("work_id").alias("a"), F.lower(F.trim("canonical_paper_id")).alias("b")).where("a is not null and b is not null")
    return G.components(p, "a", "b")


@q("""with recursive e as (select a x, b y from coauthors union select b, a from coauthors), r as (select distinct x s, x t from e union select r.s, e.y from r join e on e.x = r.t), c as (select s id, min(t) k from r group by 1), sep as (select min(author) a, max(author) b from mentions group by year)
select sep.a, sep.b, coalesce(x.k = y.k, false) violated from sep left join c x on x.id = sep.a left join c y on y.id = sep.b where sep.a is not null""")
def g15_separation_check(s, d):
    c = G.components(coauthors(s, d), "a", "b")
    sep = mentions(s, d).groupBy("year").agg(F.min("author").alias("a"), F.max("author").alias("b"))
    j = sep.join(c.select(F.col("id").alias("a"), F.col("component").alias("k1")), "a", "left").join(c.select(F.col("id").alias("b"), F.col("component").alias("k2")), "b", "left")
    return j.select("a", "b", F.coalesce(F.col("k1") == F.col("k2"), F.lit(False)).alias("violated"))


@q("select a, b, w from coauthors")
def g16_coauthor_projection(s, d):
    return coauthors(s, d)


@q("""select author, round(sum(case when n > 1 then 1.0 / (n - 1) * (n - 1) else 0 end), 6) strength, (select count(*) from coauthors c where c.a = m.author) + (select count(*) from coauthors c where c.b = m.author) neighbours from mentions m group by author""")
def g17_fractional_strength(s, d):
    strength = mentions(s, d).groupBy("author").agg(F.round(F.sum(F.when(F.col("n") > 1, 1.0).otherwise(0.0)), 6).alias("strength"))
    c = coauthors(s, d).select(F.explode(F.array("a", "b")).alias("author")).groupBy("author").agg(F.count("*").alias("neighbours"))
    return strength.join(c, "author", "left").na.fill(0, ["neighbours"])


@q("select author from mentions group by 1 having bool_or(n = 1 or pos = 1 or pos = n) or count(distinct work_id) > 1")
def g18_trim(s, d):
    m = mentions(s, d).groupBy("author").agg(F.bool_or((F.col("n") == 1) | (F.col("pos") == 1) | (F.col("pos") == F.col("n"))).alias("edge"), F.countDistinct("work_id").alias("k"))
    return m.where("edge or k > 1").select("author")


@q("select author, cast(sum(w) as bigint) degree from (select a author, w from coauthors union all select b, w from coauthors) group by 1")
def g19_weighted_degree(s, d):
    return coauthors(s, d).select(F.explode(F.array("a", "b")).alias("author"), "w").groupBy("author").agg(F.sum("w").alias("degree"))


@q()
def g20_betweenness(s, d):
    return G.betweenness(coauthors(s, d), "a", "b", 400, "w")


@q()
def g21_communities(s, d):
    return G.communities(coauthors(s, d), "a", "b", "w")


@q("""with home as (select author, arg_min(comm, (-c, comm)) comm from (select author, comm, count(*) c from mentions where comm is not null group by 1, 2) group by 1) select comm, count(*) people, min(author) first_person from home group by 1""")
def g22_community_assignment(s, d):
    home = O.mode_by(mentions(s, d).where("comm is not null"), "author", "comm")
    return home.groupBy("comm").agg(F.count("*").alias("people"), F.min("author").alias("first_person"))


@q("""with n as (select x p, list_distinct(list(y)) ns from (select a x, b y from coauthors union all select b, a from coauthors) group by 1) select c.a, c.b, round(len(list_intersect(list_filter(x.ns, lambda v: v <> c.b), list_filter(y.ns, lambda v: v <> c.a))) / greatest(1, len(list_distinct(list_concat(list_filter(x.ns, lambda v: v <> c.b), list_filter(y.ns, lambda v: v <> c.a))))), 6) jac
from coauthors c join n x on x.p = c.a join n y on y.p = c.b""")
def g23_neighbourhood_jaccard(s, d):
    c = coauthors(s, d).select("a", "b")
    both = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = both.groupBy("a").agg(F.collect_set("b").alias("ns"))
    j = c.join(n.select("a", F.col("ns").alias("n1")), "a").join(n.select(F.col("a").alias("b"), F.col("ns").alias("n2")), "b")
    x, y = F.array_remove("n1", F.col("b")), F.array_remove("n2", F.col("a"))
    return j.select("a", "b", F.round(F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y))), 6).alias("jac"))


@q(f"""with x as (select lower({sql_usable('work_id')}) work_id, count(*) n from pass2_errors where {sql_usable('work_id')} is not null group by 1) select x.work_id, n, w.work_id is not null verified, case when w.work_id is null then 'drop' when n = 1 then 'keep' else 'review' end disposition from x left join works w on w.work_id = x.work_id""")
def g24_verified_links(s, d):
    x = table(s, d, "pass2_errors").withColumn("work_id", clean_id("work_id")).where("work_id is not null").groupBy("work_id").agg(F.count("*").alias("n"))
    j = x.join(works(s, d).select("work_id", F.lit(True).alias("ok")), "work_id", "left")
    return j.select("work_id", "n", F.coalesce("ok", F.lit(False)).alias("verified"), F.when(F.col("ok").isNull(), "drop").when(F.col("n") == 1, "keep").otherwise("review").alias("disposition"))


@q("""with dg as (select v, count(*) n from (select a v from coauthors union all select b from coauthors) group by 1 order by n desc, v limit 150) select a, b, w from coauthors where a in (select v from dg) and b in (select v from dg)""")
def g25_top_subgraph(s, d):
    c = coauthors(s, d)
    top = c.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(150)
    return c.join(top.select(F.col("v").alias("a")), "a", "left_semi").join(top.select(F.col("v").alias("b")), "b", "left_semi").select("a", "b", "w")


@q("""with t as (select distinct l_orderkey o, l_partkey p from lineitem) select x.o u, y.o v, count(*) shared from t x join t y on x.p = y.p and x.o < y.o group by 1, 2 having count(*) >= 2""")
def g26_work_projection(s, d):
    """Pairs of works that share at least two people; a person on many works is the only source of pairs, so the size follows the people's counts."""
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("p")).distinct()
    pairs = t.join(t.withColumnRenamed("u", "v"), "p").where("u < v").groupBy("u", "v").agg(F.count("*").alias("shared"))
    return pairs.where("shared >= 2")


@q("select author, arg_min(comm, (-c, comm)) comm from (select author, comm, count(*) c from mentions where comm is not null group by 1, 2) group by 1")
def g27_modal_community(s, d):
    return O.mode_by(mentions(s, d).where("comm is not null"), "author", "comm")


@q("""with recursive r as (select id, 0 k from papers where core and year <= 1977 union select e.dst, r.k + 1 from r join edges e on e.src = r.id where r.k < 3) select id, cast(min(k) as int) pass from r group by 1""")
def g28_saturation(s, d):
    return G.saturate(papers(s, d).where("core and year <= 1977").select("id"), edges(s, d), 3)


# --- nested data


@q("""select event_id, cast(json_extract(props, '$.k') as bigint) k, ts from events""")
def n1_json_record(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"), "ts")


@q("select event_id, coalesce(json_extract_string('{\"data\":[' || props || ']}', '$.data[0].k'), json_extract_string(props, '$.k')) k from events")
def n2_unwrap(s, d):
    wrapped = F.concat(F.lit('{"data":['), "props", F.lit("]}"))
    return table(s, d, "events").select("event_id", F.coalesce(F.get_json_object(wrapped, "$.data[0].k"), F.get_json_object("props", "$.k")).alias("k"))


@q("select work_id, title as text from works where title is not null")
def n3_inverted_index(s, d):
    """Titles to word positions, and back to text."""
    w = works(s, d).where("title is not null").select("work_id", F.posexplode(F.split("title", " ")).alias("p", "word"))
    index = w.groupBy("work_id", "word").agg(F.collect_list("p").alias("at")).groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("work_id", O.text_of_index(F.col("index")).alias("text"))


@q("select seed_row, 'https://doi.org/' || doi || ' https://example.org/' || doi urls from seeds where doi is not null")
def n4_candidate_urls(s, d):
    u = F.array(F.concat(F.lit("https://doi.org/"), "doi"), F.concat(F.lit("https://example.org/"), "doi"), F.concat(F.lit("https://doi.org/"), "doi"))
    return seeds(s, d).where("doi is not null").select("seed_row", F.array_join(F.array_distinct(F.array_compact(u)), " ").alias("urls"))


@q("""with x as (select work_id, unnest(string_split(authors, '; ')) a, unnest(range(0, len(string_split(authors, '; ')))) p from works where authors is not null), y as (select work_id, split_part(a, ' ', 1) g, min(p) p from x group by 1, 2) select work_id, string_agg(g, ';' order by p) given from y group by 1""")
def n5_ordered_distinct(s, d):
    given = F.transform(F.split("authors", "; "), lambda a: F.substring_index(a, " ", 1))
    return works(s, d).where("authors is not null").select("work_id", F.array_join(F.array_distinct(given), ";").alias("given"))


@q("select venue, count(*) n, string_agg(work_id, ',' order by work_id) ids from works where venue is not null group by 1")
def n6_grouped_view(s, d):
    x = works(s, d).where("venue is not null").groupBy("venue").agg(F.struct(F.count("*").alias("n"), F.array_sort(F.collect_list("work_id")).alias("ids")).alias("v"))
    return x.select("venue", "v.n", F.array_join("v.ids", ",").alias("ids"))


@q("""select seed_row, concat_ws(';', case when decision is null or decision not in ('core_relevant','adjacent_relevant','role_bridge','uncertain','out_of_scope') then 'decision' end, case when confidence is null or confidence < 0 or confidence > 1 then 'confidence' end, case when decision = 'core_relevant' and core_gate is null then 'gate' end) problems from seeds""")
def n7_validate(s, d):
    dec = F.col("decision")
    ok = F.coalesce(dec.isin("core_relevant", "adjacent_relevant", "role_bridge", "uncertain", "out_of_scope"), F.lit(False))
    from evidentia.functions.rules import all_matches

    bad = all_matches([("decision", ~ok), ("confidence", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))), ("gate", (dec == "core_relevant") & F.col("core_gate").isNull())])
    return seeds(s, d).select("seed_row", F.array_join(bad, ";").alias("problems"))


@q(r"""select doc_id, array_to_string(regexp_extract_all('<a href="/p/' || doc_id || '.pdf">x</a><a href="#top">y</a>' || coalesce(text,''), 'href="([^"#][^"]*\.pdf)"', 1), ' ') links from documents""")
def n8_href(s, d):
    page = F.concat(F.lit('<a href="/p/'), F.col("doc_id").cast("string"), F.lit('.pdf">x</a><a href="#top">y</a>'), F.coalesce("text", F.lit("")))
    return table(s, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.regexp_extract_all(page, F.lit(r'href="([^"#][^"]*\.pdf)"'), F.lit(1))), " ").alias("links"))


@q("select distinct work_id, trim(m) member from (select work_id, unnest(string_split(members, ';')) m from works where members is not null)")
def n9_link_list(s, d):
    js = F.to_json(F.struct(F.lit("members").alias("name"), F.transform(F.split("members", ";"), lambda m: F.struct(F.trim(m).alias("id"))).alias("links")))
    x = works(s, d).where("members is not null").select("work_id", F.from_json(js, "name string, links array<struct<id: string>>").alias("j"))
    return x.where("j.name = 'members'").select("work_id", F.inline("j.links")).select("work_id", F.col("id").alias("member")).distinct()


@q(f"""with x as (select lower({sql_usable('doi')}) doi, regexp_matches(lower(coalesce(title,'')), '^(correction|erratum)') corr, regexp_matches(lower(coalesce(title,'')), '^retract') retr from web_search_queue) select doi, bool_or(corr) corrected, bool_or(retr) retracted, count(*) n from x where doi is not null group by 1""")
def n10_notices(s, d):
    t = F.lower(F.coalesce("title", F.lit("")))
    x = table(s, d, "web_search_queue").select(F.lower(usable("doi")).alias("doi"), F.when(t.rlike("^(correction|erratum)"), "correction").when(t.rlike("^retract"), "retraction").alias("kind")).where("doi is not null")
    g = x.groupBy("doi").agg(F.collect_set("kind").alias("k"), F.count("*").alias("n"))
    return g.select("doi", F.array_contains("k", "correction").alias("corrected"), F.array_contains("k", "retraction").alias("retracted"), "n")


# --- sources, sinks, batches


@q("select n_nationkey, n_name, n_regionkey from nation")
def s1_csv_scan(s, d):
    path = files.write_csv(table(s, d, "nation"), files.scratch(s, "csv"))
    return files.read_csv(s, path, "n_nationkey int, n_name string, n_regionkey int")


@q("select coalesce(cast(seed_row as varchar), '') seed_row, coalesce(title, '') title, coalesce(venue, '') venue from manual_seed_works")
def s2_text_scan(s, d):
    t = table(s, d, "manual_seed_works").select("seed_row", "title", "venue")
    return files.read_text_csv(s, files.write_csv(t, files.scratch(s, "csv")), ["seed_row", "title", "venue"])


@q()
def s3_optional_scan(s, d):
    t = table(s, d, "region")
    empty = files.read_optional(s, files.scratch(s, "missing"), StructType.fromDDL("r_regionkey int, r_name string, note string"))
    return files.ensure_columns(t, {"note": "string"}).unionByName(empty)


@q("select l_orderkey, l_returnflag from lineitem")
def s4_pruned_scan(s, d):
    return files.require_columns(table(s, d, "lineitem"), ["l_orderkey"]).select("l_orderkey", "l_returnflag")


@q("select r_regionkey, r_name from region")
def s5_json_scan(s, d):
    path = files.write_json(table(s, d, "region"), files.scratch(s, "json"))
    return s.read.schema("r_regionkey int, r_name string").json(path)


@q("select user_id, arg_max(event_type, event_id) event_type, max(event_id) event_id from events group by 1")
def s6_jsonl_last_wins(s, d):
    t = table(s, d, "events").select("user_id", "event_type", "event_id")
    path = files.scratch(s, "jsonl")
    lines = t.select(F.to_json(F.struct("user_id", "event_type", "event_id")).alias("value"))
    lines.unionByName(s.createDataFrame([("{broken",), ("",)], "value string")).write.text(path)
    return files.read_jsonl(s, path, "user_id bigint, event_type string, event_id bigint", "user_id", "event_id")


@q("""with u as (select work_id, human d, 2 p, decision_no o from reviews where work_id is not null union all select work_id, decision, 1, seed_row from seeds where work_id is not null) select work_id, arg_max(d, (p, o)) d from u where d is not null group by 1""")
def s7_shard_union(s, d):
    a = seeds(s, d).select("work_id", F.col("decision").alias("d"), F.col("seed_row").alias("o"))
    b = reviews(s, d).select("work_id", F.col("human").alias("d"), F.col("decision_no").alias("o"))
    ok = "work_id is not null and d is not null"
    return files.union_shards([a.where(ok), b.where(ok)], "work_id", "o").select("work_id", "d")


@q("select work_id, array_to_string(list_sort(string_split(authors, '; ')), ';') authors from works where authors is not null")
def s11_csv_sink(s, d):
    w = works(s, d).where("authors is not null").select("work_id", F.split("authors", "; ").alias("authors"))
    return files.read_csv(s, files.write_csv(w, files.scratch(s, "csv")), "work_id string, authors string")


@q()
def s12_json_sink(s, d):
    w = works(s, d).groupBy("venue").agg(F.struct(F.count("*").alias("n"), F.max("cites").alias("most")).alias("stats"))
    path = files.write_json(w, files.scratch(s, "json"))
    return s.read.schema("venue string, stats struct<n: bigint, most: int>").json(path).select("venue", "stats.n", "stats.most")


@q()
def s13_manifest(s, d):
    return files.manifest(s, files.write_csv(table(s, d, "nation").coalesce(1), files.scratch(s, "csv"))).where("name like '%.csv'").select("bytes", "sha256")


@q("select seed_row, cast((row_number() over (order by seed_row) - 1) // 30 as int) shard from seeds")
def s14_shards(s, d):
    return files.shards_of(seeds(s, d).select("seed_row"), "seed_row", 30)


# --- sampling, streaming, state


@q("""with r as (select decision, seed_row, row_number() over (partition by decision order by md5('7|' || seed_row), seed_row) k, count(*) over (partition by decision) n from seeds) select decision, seed_row from r where k <= greatest(1, cast(round(n * 0.1) as int))""")
def x1_stratified_sample(s, d):
    return sampling.stratified(seeds(s, d).select("decision", "seed_row"), "decision", "seed_row", 0.1, 7)


@q("""select decision_no, coalesce(human = 'out_of_scope', false) and cast(('0x' || substr(md5('3|' || decision_no), 1, 8)) as bigint) % 5 = 0 audit from reviews""")
def x2_exclusion_audit(s, d):
    return sampling.audit(reviews(s, d).select("decision_no", "human"), F.col("human") == "out_of_scope", "decision_no", 5, 3).select("decision_no", "audit")


@q("select user_id, arg_max(event_type, (ts, event_id)) event_type, max(event_id) filter (where true) is not null known, count(*) seen from events group by 1")
def x4_progress_stream(s, d):
    path = files.write_json(table(s, d, "events").select("user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")), files.scratch(s, "log"))
    got = progress.latest_per_key(s, path, "user_id bigint, event_type string, event_id bigint, at string", "user_id", ["at", "event_id"])
    return got.select("user_id", "event_type", F.lit(True).alias("known"), "seen")


@q(f"select work_id from works where work_id not in (select lower({sql_usable('work_id')}) from pass2_errors where error is null and {sql_usable('work_id')} is not null)")
def x5_resume(s, d):
    done = table(s, d, "pass2_errors").where("error is null").select(clean_id("work_id").alias("work_id")).where("work_id is not null").distinct()
    return works(s, d).select("work_id").join(done, "work_id", "left_anti")


@q()
def x6_stage_guard(s, d):
    """A stage's output with a fingerprint of its input and settings; a second run with the same fingerprint reads it back."""
    t = table(s, d, "nation")
    mark = F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.bit_xor(F.xxhash64(*t.columns)).cast("string"), F.lit("stage=1")), 256)
    path = files.scratch(s, "stage")
    t.withColumn("mark", F.lit(t.agg(mark).first()[0])).write.parquet(path)
    now = t.agg(mark).first()[0]
    return s.read.parquet(path).where(F.col("mark") == now).select("n_nationkey", "n_name")


@q("select time_bucket(interval 1 day, ts) as start, event_type, count(*) n from events group by 1, 2")
def x7_event_windows(s, d):
    path = files.write_json(table(s, d, "events").select("event_type", "ts"), files.scratch(s, "log"))
    return progress.windowed_counts(s, path, "event_type string, ts timestamp", "ts", "event_type", "1 day", "365 days")

