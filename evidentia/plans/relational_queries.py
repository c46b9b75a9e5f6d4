"""Predicates, joins, aggregates, windows, sorting and set operations of the evidence-map pipelines, one query each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.common import clean_id, table, usable
from evidentia.functions import rules as R
from evidentia.functions import scalars as S
from evidentia.operators import relational as O
from evidentia.plans.base import Registry, edges, mentions, papers, reviews, seeds, sql_usable, works

REG = Registry()
q = REG.query
QUERIES, ORACLES = REG.queries, REG.oracles
_NT = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
INCLUSIVE = ("core_relevant", "adjacent_relevant", "role_bridge")


# --- predicates


@q("select decision_no, trim(coalesce(note,'')) <> '' has_note, trim(coalesce(agent_decision,'')) <> '' has_agent from human_review_decisions")
def pr1_non_empty(s, d):
    return table(s, d, "human_review_decisions").select("decision_no", S.non_empty("note").alias("has_note"), S.non_empty("agent_decision").alias("has_agent"))


@q(f"select seed_row, decision from seeds where decision in {INCLUSIVE}")
def pr2_membership(s, d):
    return seeds(s, d).where(F.col("decision").isin(*INCLUSIVE)).select("seed_row", "decision")


_BUCKET = [("core_recent", "decision = 'core_relevant' and year >= 2015"), ("core_old", "decision = 'core_relevant'"), ("bridge", "decision = 'role_bridge'"), ("dated", "year is not null")]


@q(f"select seed_row, {R.sql_first(_BUCKET, chr(39) + 'other' + chr(39))} bucket from seeds")
def pr7_priority_bucket(s, d):
    dec = F.col("decision")
    rules = [("core_recent", (dec == "core_relevant") & (F.col("year") >= 2015)), ("core_old", dec == "core_relevant"), ("bridge", dec == "role_bridge"), ("dated", F.col("year").isNotNull())]
    return seeds(s, d).select("seed_row", R.first_match(rules, "other").alias("bucket"))


@q("select comm, case when bool_or(source_group = 'core_audit') then 'core_audit' when bool_or(source_group = 'unresolved') then 'unresolved' else 'role_bridge' end grp from works where comm is not null group by 1")
def pr8_group_precedence(s, d):
    has = lambda v: F.bool_or(F.col("source_group") == v)
    return works(s, d).where("comm is not null").groupBy("comm").agg(F.when(has("core_audit"), "core_audit").when(has("unresolved"), "unresolved").otherwise("role_bridge").alias("grp"))


@q("""with t as (select work_id, bool_and(decision <> 'out_of_scope') ok from seeds where work_id is not null group by 1)
select coalesce(t.ok, true) is_paper, count(*) n, (select count(*) from works) total from works w left join t on t.work_id = w.work_id group by 1""")
def pr9_record_partition(s, d):
    t = seeds(s, d).where("work_id is not null").groupBy("work_id").agg(F.bool_and(F.col("decision") != "out_of_scope").alias("ok"))
    w = works(s, d).select("work_id").join(t, "work_id", "left").groupBy(F.coalesce("ok", F.lit(True)).alias("is_paper")).agg(F.count("*").alias("n"))
    return w.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # two rows


@q("""with dropped as (select work_id from reviews where human = 'out_of_scope'), rescued as (select w.work_id from works w join seeds s on s.doi = w.doi where w.doi is not null), base as (select work_id from works)
select work_id from (select work_id from base except select work_id from dropped) union select work_id from rescued""")
def pr10_working_set(s, d):
    w = works(s, d)
    drop = reviews(s, d).where("human = 'out_of_scope'").select("work_id")
    rescued = w.where("doi is not null").join(seeds(s, d).select("doi").distinct(), "doi", "left_semi").select("work_id")
    return O.working_set(w.select("work_id"), drop, rescued)


@q("""select work_id, comm is not null graph, comm is not null and doi is not null integrated, comm is null and (coalesce(cites,0) >= 100 or (source_group = 'core_audit' and coalesce(cites,0) >= 50)) rescue from works""")
def pr11_layer_flags(s, d):
    c, graph = F.coalesce("cites", F.lit(0)), F.col("comm").isNotNull()
    rescue = ~graph & ((c >= 100) | (F.col("source_group").eqNullSafe("core_audit") & (c >= 50)))
    return works(s, d).select("work_id", graph.alias("graph"), (graph & F.col("doi").isNotNull()).alias("integrated"), rescue.alias("rescue"))


_FILLED = ["title", "authors", "venue", "doi", "types", "abstract"]


@q(" union all ".join(f"select '{c}' col, cast(count({c}) as bigint) n, round(100.0 * count({c}) / count(*), 1) pct from works" for c in _FILLED))
def pr12_filled_stats(s, d):
    return O.filled(works(s, d), _FILLED)


# --- joins


@q("select w.work_id, coalesce(s.title, w.title) title, s.decision from works w left join (select work_id, min(title) title, min(decision) decision from seeds where work_id is not null group by 1) s on s.work_id = w.work_id")
def j1_left_join_coalesce(s, d):
    side = seeds(s, d).where("work_id is not null").groupBy("work_id").agg(F.min("title").alias("title"), F.min("decision").alias("decision"))
    return O.left_coalesce(works(s, d).select("work_id", "title"), side, "work_id", ["title"])


@q("select l.l_orderkey, l.l_linenumber, l.l_partkey, p.p_brand from lineitem l left join part p on p.p_partkey = l.l_partkey")
def j2_many_to_one(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return O.many_to_one(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), part, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


@q("""with m as (select work_id, arg_max(human, decision_no) last, arg_min(human, decision_no) first from reviews where work_id is not null and human is not null group by 1)
select w.work_id, coalesce(m.last, 'none') last, coalesce(m.first, 'none') first from works w left join m on m.work_id = w.work_id""")
def j3_dictionary_lookup(s, d):
    r = reviews(s, d).where("work_id is not null and human is not null")
    both = O.lookup(r, "work_id", "human", "decision_no", "last", "last").join(O.lookup(r, "work_id", "human", "decision_no", "first", "first"), "work_id")
    return works(s, d).select("work_id").join(both, "work_id", "left").na.fill("none", ["last", "first"])


@q("""with a as (select work_id, min(human) h from reviews where work_id is not null group by 1), b as (select lower(trim(work_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))) work_id, min(decision) dec from exploration_disconnected group by 1)
select a.work_id, a.h, b.dec from a join b on a.work_id = b.work_id""")
def j4_inner_two_runs(s, d):
    a = reviews(s, d).where("work_id is not null").groupBy("work_id").agg(F.min("human").alias("h"))
    b = table(s, d, "exploration_disconnected").withColumn("work_id", clean_id("work_id")).groupBy("work_id").agg(F.min("decision").alias("dec"))
    return a.join(b, "work_id")


@q("select work_id, 'in' side from works where work_id in (select work_id from reviews where work_id is not null) union all select work_id, 'out' from works where work_id not in (select work_id from reviews where work_id is not null)")
def j5_semi_anti(s, d):
    w, r = works(s, d).select("work_id"), reviews(s, d).select("work_id")
    return w.join(r, "work_id", "left_semi").withColumn("side", F.lit("in")).unionByName(w.join(r, "work_id", "left_anti").withColumn("side", F.lit("out")))


@q("select distinct a.brand u, b.brand v from edges e join papers a on a.id = e.src join papers b on b.id = e.dst where a.brand <> b.brand")
def j6_edge_remap(s, d):
    return O.remap_edges(edges(s, d), papers(s, d).select("id", F.col("brand").alias("to")))


@q("select x.work_id a, y.work_id b, x.title from works x join works y on x.title = y.title and x.year = y.year and x.work_id < y.work_id")
def j7_block_pairs(s, d):
    w = works(s, d).where("title is not null and year is not null")
    return O.block_pairs(w.select("work_id", "title", "year"), ["title", "year"], "work_id").select("a", "b", "title")


@q(f"""with t as (select work_id, year, {_NT.format('title')} nt, lower(string_split(trim(string_split(authors,';')[1]), ' ')[-1]) sn from works where title is not null),
k as (select 't' || nt b, * from t union all select 's' || sn, * from t where sn is not null), n as (select b from k group by b having count(*) between 2 and 150),
tok as (select work_id, list_distinct(list_filter(string_split(nt, ' '), lambda w: w not in {S.STOP})) w from t)
select distinct x.work_id a, y.work_id b from k x join n on n.b = x.b join k y on y.b = x.b and x.work_id < y.work_id and (x.year is null or y.year is null or abs(x.year - y.year) <= 5) join tok p on p.work_id = x.work_id join tok q on q.work_id = y.work_id where len(list_intersect(p.w, q.w)) >= 3""")
def j8_blocked_similarity(s, d):
    w = works(s, d).where("title is not null")
    surname = F.lower(F.element_at(F.split(F.trim(F.split("authors", ";")[0]), " "), -1))
    t = w.select("work_id", "year", S.title_tokens("title").alias("w"), F.array(F.concat(F.lit("t"), S.normalize_title("title")), F.concat(F.lit("s"), surname)).alias("keys"))
    return O.blocked_pairs(t, "keys", "work_id", "w", "year", shared=3, gap=5, most=150)


@q("select a.seed_row, b.seed_row other from seeds a join seeds b on a.title = b.title and a.seed_row < b.seed_row and (a.year is null or b.year is null or abs(a.year - b.year) <= 2)")
def j9_year_gap(s, d):
    a = seeds(s, d).select("seed_row", "title", "year")
    b = a.select(F.col("seed_row").alias("other"), "title", F.col("year").alias("y2"))
    return a.join(b, "title").where("seed_row < other").where(O.within(F.col("year"), F.col("y2"), 2)).select("seed_row", "other")


@q("""with m as (select author, min(year) y1, max(year) y2, string_split(author, ' ')[-1] g from mentions group by author) select a.author a, b.author b from m a join m b on a.g = b.g and a.author < b.author and not (coalesce(a.y2 < b.y1, false) or coalesce(b.y2 < a.y1, false))""")
def j10_interval_overlap(s, d):
    m = mentions(s, d).groupBy("author").agg(F.min("year").alias("y1"), F.max("year").alias("y2")).withColumn("g", F.element_at(F.split("author", " "), -1))
    a, b = m.select(F.col("author").alias("a"), "g", F.col("y1").alias("a1"), F.col("y2").alias("a2")), m.select(F.col("author").alias("b"), "g", F.col("y1").alias("b1"), F.col("y2").alias("b2"))
    return a.join(b, "g").where("a < b").where(O.overlaps(*[F.col(c) for c in ("a1", "a2", "b1", "b2")])).select("a", "b")


_ERAS = [("early", 0, 1999), ("middle", 2000, 2012), ("recent", 2013, 2020)]


@q("select work_id, case when year <= 1999 then 'early' when year <= 2012 then 'middle' else 'recent' end era from works where year is not null")
def j11_range_lookup(s, d):
    return O.era_join(works(s, d).where("year is not null").select("work_id", "year"), "year", _ERAS).select("work_id", "era")


@q(f"""with w as (select work_id, doi, {_NT.format('title')} nt from works), byd as (select doi, min(work_id) w from w where doi is not null group by 1), byt as (select nt, min(work_id) w from w where nt is not null group by 1)
select s.seed_row, coalesce(a.work_id, b.w, c.w) hit, case when a.work_id is not null then 'id' when b.w is not null then 'doi' when c.w is not null then 'title' end how
from seeds s left join works a on a.work_id = s.work_id left join byd b on b.doi = s.doi left join byt c on c.nt = {_NT.format('s.title')}""")
def j12_fallback_join(s, d):
    w = works(s, d).select("work_id", "doi", S.normalize_title("title").alias("nt"))
    x = seeds(s, d).select("seed_row", "work_id", "doi", S.normalize_title("title").alias("nt"))
    return O.fallback_join(x, w, [("id", "work_id"), ("doi", "doi"), ("title", "nt")], "work_id").select("seed_row", "hit", "how")


@q()
def j13_fuzzy_title(s, d):
    a = seeds(s, d).where("title is not null").select("seed_row", S.normalize_title("title").alias("t"), "year", F.col("doi").alias("d1"))
    b = works(s, d).where("title is not null").select("work_id", S.normalize_title("title").alias("t2"), F.col("year").alias("y2"), F.col("doi").alias("d2"))
    return O.fuzzy_titles(a, b, 0.92, 1, ends=0)


@q(f"""with w as (select work_id, {_NT.format('title')} t from works where title is not null), x as (select distinct {_NT.format('title')} t from human_review_decisions where {sql_usable('title')} is not null)
select distinct x.t title, w.work_id from x join w on substr(x.t, 1, 32) = substr(w.t, 1, 32) where length(x.t) >= 32 and length(w.t) >= 32 and (starts_with(w.t, x.t) or starts_with(x.t, w.t))""")
def j14_title_prefix(s, d):
    w = works(s, d).where("title is not null").select("work_id", S.normalize_title("title").alias("t"))
    x = table(s, d, "human_review_decisions").where(usable("title").isNotNull()).select(S.normalize_title("title").alias("title")).distinct()
    return O.prefix_join(x, "title", w, "t", 32).select("title", "work_id").distinct()


@q("""with n as (select title, count(*) n, min(work_id) w, string_agg(work_id, ';' order by work_id) ids from works where title is not null group by 1)
select s.seed_row, case when n = 1 then w end hit, case when n > 1 then ids end ambiguous from seeds s left join n on n.title = s.title""")
def j15_unique_or_ambiguous(s, d):
    return O.unique_match(seeds(s, d).select("seed_row", "title"), works(s, d).where("title is not null").select("title", "work_id"), "title", "work_id").select("seed_row", "hit", "ambiguous")


@q("""with f as (select n_nationkey, lower(substr(n_name, 1, 6)) frag from nation), c as (select c_custkey, lower(c_name) n from customer)
select f.n_nationkey, (select min(doc_id) from documents t where contains(lower(t.text), f.frag)) first_doc from f""")
def j16_first_containing(s, d):
    frag = table(s, d, "nation").select("n_nationkey", F.lower(F.substring("n_name", 1, 6)).alias("frag"))
    return O.first_containing(frag, "frag", table(s, d, "documents"), "text", "doc_id").select("n_nationkey", F.col("first").alias("first_doc"))


@q(f"""with l as (select distinct {_NT.format('last_author')} k, run_no from label_ultra_core_ranked) select m.author, string_agg(distinct cast(l.run_no as varchar), ';' order by cast(l.run_no as varchar)) runs from (select distinct author from mentions) m left join l on l.k = {_NT.format('m.author')} group by 1""")
def j17_name_join_collect(s, d):
    runs = table(s, d, "label_ultra_core_ranked").select(S.normalize_title("last_author").alias("k"), F.col("run_no").cast("string").alias("r")).distinct().groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("r")), ";").alias("runs"))
    return mentions(s, d).select("author").distinct().withColumn("k", S.normalize_title("author")).join(runs, "k", "left").select("author", "runs")


# --- aggregates


@q("select venue, count(*) n from works group by 1")
def a1_value_counts(s, d):
    return works(s, d).groupBy("venue").agg(F.count("*").alias("n"))


@q("select comm, count(*) n, cast(sum(case when doi is not null then 1 else 0 end) as bigint) with_doi, count(distinct venue) venues, min(year) y1, max(year) y2, arg_min(title, work_id) first_title from works group by 1")
def a2_multi_aggregate(s, d):
    return works(s, d).groupBy("comm").agg(F.count("*").alias("n"), F.sum(F.col("doi").isNotNull().cast("int")).alias("with_doi"), F.countDistinct("venue").alias("venues"), F.min("year").alias("y1"), F.max("year").alias("y2"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("work_id"))).alias("first_title"))


@q("select count(distinct author) authors, count(distinct work_id) as works, count(distinct year) as years from mentions")
def a3_distinct_counts(s, d):
    return O.distinct_counts(mentions(s, d), {"author": "authors", "work_id": "works", "year": "years"})


@q("select venue, array_to_string(list_sort(list_distinct(flatten(list(string_split(members, ';'))))), ';') ids from works where members is not null group by 1")
def a4_set_union(s, d):
    return works(s, d).where("members is not null").select("venue", F.explode(F.split("members", ";")).alias("m")).groupBy("venue").agg(F.array_join(F.array_sort(F.collect_set("m")), ";").alias("ids"))


@q("select trim(t) token, count(*) n from (select unnest(regexp_split_to_array(types, '[;,]')) t from works where types is not null) where trim(t) <> '' group by 1")
def a5_token_counts(s, d):
    t = works(s, d).where("types is not null").select(F.explode(F.transform(F.split("types", "[;,]"), lambda v: F.trim(v))).alias("token"))
    return t.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


@q("select coalesce(agent, 'All') agent, coalesce(human, 'All') human, count(*) n from (select coalesce(agent,'-') agent, coalesce(human,'-') human from reviews) group by cube(agent, human)")
def a6_crosstab(s, d):
    return O.crosstab(reviews(s, d).na.fill("-", ["agent", "human"]), "agent", "human")


_DECS = ["core_relevant", "adjacent_relevant", "role_bridge", "uncertain", "out_of_scope"]


@q("select reviewer, " + ", ".join(f"count(*) filter (where human = '{x}') {x}" for x in _DECS) + " from reviews group by 1")
def a7_unstack(s, d):
    return reviews(s, d).groupBy("reviewer").pivot("human", _DECS).agg(F.count(F.lit(1))).na.fill(0, _DECS)


@q("select comm, round(quantile_cont(cites, 0.5), 4) p50, round(quantile_cont(cites, 0.9), 4) p90, round(quantile_cont(cites, 0.99), 4) p99 from works where cites is not null group by 1")
def a8_quantiles(s, d):
    p = F.percentile("cites", F.array(*map(F.lit, (0.5, 0.9, 0.99))))
    return works(s, d).where("cites is not null").groupBy("comm").agg(p.alias("p")).select("comm", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


@q("select venue, round(median(cites), 3) med, round(avg(cites), 3) mean, max(cites) most from works where cites is not null group by 1")
def a9_median_mean_max(s, d):
    return works(s, d).where("cites is not null").groupBy("venue").agg(F.round(F.median("cites"), 3).alias("med"), F.round(F.avg("cites"), 3).alias("mean"), F.max("cites").alias("most"))


@q("with r as (select *, row_number() over (partition by venue order by doi is not null desc, abstract is not null desc, coalesce(cites,-1) desc, work_id) k from works) select venue, work_id, cites from r where k = 1")
def a10_best_row(s, d):
    return O.best_row(works(s, d), ["venue"], [F.col("doi").isNotNull().desc(), F.col("abstract").isNotNull().desc(), F.coalesce("cites", F.lit(-1)).desc(), F.col("work_id").asc()]).select("venue", "work_id", "cites")


@q("select venue, arg_max(title, (length(title), title)) longest from works where title is not null group by 1")
def a11_longest_string(s, d):
    return works(s, d).where("title is not null").groupBy("venue").agg(F.max_by("title", F.struct(F.length("title"), "title")).alias("longest"))


@q("select title, max(cites) most, cast(sum(cites) as bigint) total from works group by 1")
def a12_sum_and_max(s, d):
    return works(s, d).groupBy("title").agg(F.max("cites").alias("most"), F.sum("cites").alias("total"))


@q("""with v as (select ln(1 + cites) l, cites from works where cites is not null), z as (select quantile_cont(l, 0.25) q1, quantile_cont(l, 0.75) q3, quantile_cont(cites, 0.95) p95 from v)
select round(greatest(ceil(exp(q3 + 1.5 * (q3 - q1)) - 1), p95), 4) as cut from z""")
def a13_outlier_cut(s, d):
    return O.outlier_cut(works(s, d).where("cites is not null"), "cites")


@q("select author, round(sum(1.0 / n), 6) credit, round(sum(case when n > 1 then 1.0 / (n - 1) else 0 end), 6) strength from mentions group by 1")
def a14_fractional_credit(s, d):
    return mentions(s, d).groupBy("author").agg(F.round(F.sum(1.0 / F.col("n")), 6).alias("credit"), F.round(F.sum(F.when(F.col("n") > 1, 1.0 / (F.col("n") - 1)).otherwise(0.0)), 6).alias("strength"))


@q("""with p as (select author, arg_min(comm, (-c, comm)) comm from (select author, comm, count(*) c from mentions where comm is not null group by 1, 2) group by 1),
v as (select m.work_id, p.comm, sum(case when m.n = 1 then 3 when m.pos = 1 then 3 when m.pos = m.n then 2 else 1 end) w from mentions m join p on p.author = m.author group by 1, 2)
select work_id, arg_min(comm, (-w, comm)) comm from v group by 1""")
def a15_weighted_vote(s, d):
    m = mentions(s, d)
    home = O.mode_by(m.where("comm is not null"), "author", "comm")
    w = F.when(F.col("n") == 1, 3).when(F.col("pos") == 1, 3).when(F.col("pos") == F.col("n"), 2).otherwise(1)
    votes = m.select("work_id", "author", w.alias("w")).join(home, "author").groupBy("work_id", "comm").agg(F.sum("w").alias("w"))
    return votes.groupBy("work_id").agg(F.min_by("comm", F.struct(-F.col("w"), "comm")).alias("comm"))


@q("""with r as (select comm, author, row_number() over (partition by comm order by count(*) desc, author) k from mentions where comm is not null group by comm, author) select comm, string_agg(author, ' / ' order by k) label from r where k <= 2 group by 1""")
def a16_top_two_label(s, d):
    c = mentions(s, d).where("comm is not null").groupBy("comm", "author").agg(F.count("*").alias("c"))
    return O.top_n(c, ["comm"], [F.desc("c"), F.asc("author")], 2).groupBy("comm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "author"))), lambda x: x["author"]), " / ").alias("label"))


@q("select t, (select count(*) from works where cites >= t) n from (select unnest([1, 2, 5, 10, 50, 100, 1000]) t)")
def a17_threshold_curve(s, d):
    return O.threshold_curve(works(s, d), "cites", [1, 2, 5, 10, 50, 100, 1000])


@q("""with f as (select trim(t) facet, case when year <= 1999 then 'early' when year <= 2012 then 'middle' else 'recent' end era, cites, work_id from (select work_id, cites, year, unnest(regexp_split_to_array(types, '[;,]')) t from works where types is not null and year is not null))
select facet, era, count(*) n, count(*) filter (where cites >= 10) cited, arg_min(work_id, (-coalesce(cites, -1), work_id)) exemplar from f where facet <> '' group by 1, 2""")
def a18_facet_era_cells(s, d):
    w = works(s, d).where("types is not null and year is not null").select("work_id", "cites", "year", F.explode(F.transform(F.split("types", "[;,]"), lambda v: F.trim(v))).alias("facet")).where("facet <> ''")
    x = O.era_join(w, "year", _ERAS)
    return x.groupBy("facet", "era").agg(F.count("*").alias("n"), F.count_if(F.col("cites") >= 10).alias("cited"), F.min_by("work_id", F.struct(-F.coalesce("cites", F.lit(-1)), "work_id")).alias("exemplar"))


@q("""with x as (select agent a, human b from reviews where agent is not null and human is not null), n as (select count(*) n, count(*) filter (where a = b) o from x),
pa as (select a k, count(*) c from x group by 1), pb as (select b k, count(*) c from x group by 1), e as (select coalesce(sum(cast(pa.c as double) * pb.c), 0) s from pa join pb on pa.k = pb.k)
select n.n, round(o / n, 6) agreement, case when s / (n * n) = 1 then null else round((o / n - s / (cast(n as double) * n)) / (1 - s / (cast(n as double) * n)), 6) end kappa from n, e""")
def a19_kappa(s, d):
    return O.kappa(reviews(s, d).where("agent is not null and human is not null"), "agent", "human")


@q("""select case when confidence < 0.5 then 0.0 when confidence < 0.7 then 0.5 when confidence < 0.85 then 0.7 when confidence < 0.95 then 0.85 else 0.95 end lo, count(*) n, count(*) filter (where decision = 'core_relevant') hits from seeds where confidence is not null group by 1""")
def a20_calibration_bins(s, d):
    return O.bins(seeds(s, d).where("confidence is not null"), "confidence", [0.0, 0.5, 0.7, 0.85, 0.95]).groupBy("lo").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "core_relevant").alias("hits"))


@q("""with a as (select distinct agent k, work_id from reviews where agent is not null and work_id is not null), b as (select distinct human k, work_id from reviews where human is not null and work_id is not null), u as (select coalesce(a.k, b.k) k, a.k is not null ina, b.k is not null inb from a full join b on a.k = b.k and a.work_id = b.work_id)
select k, count(*) filter (where ina) a, count(*) filter (where inb) b, count(*) filter (where ina and inb) both_n, round(count(*) filter (where ina and inb) / count(*), 6) jac from u group by 1""")
def a21_label_overlap(s, d):
    r = reviews(s, d).where("work_id is not null")
    side = lambda c: r.where(F.col(c).isNotNull()).select(F.col(c).alias("k"), "work_id").distinct()
    return O.overlap_by(side("agent"), side("human"), "k", "work_id")


@q("""select l_partkey part, count(distinct s_nationkey) clusters, count(distinct l_suppkey) members, count(distinct s_nationkey) >= 2 k2, count(distinct s_nationkey) >= 3 k3 from lineitem join supplier on s_suppkey = l_suppkey group by 1""")
def a22_convergence(s, d):
    x = table(s, d, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey").distinct()
    x = x.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return x.groupBy("part").agg(F.countDistinct("s_nationkey").alias("clusters"), F.count("*").alias("members")).withColumn("k2", F.col("clusters") >= 2).withColumn("k3", F.col("clusters") >= 3)


@q("select round(avg(n), 4) mean, round(median(n), 4) med, max(n) most from (select work_id, count(*) n from mentions group by 1)")
def a23_mention_stats(s, d):
    return mentions(s, d).groupBy("work_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 4).alias("mean"), F.round(F.median("n"), 4).alias("med"), F.max("n").alias("most"))


@q("""with u as (select 'doi' as role, source_group, cites from works where doi is not null union all select 'abstract', source_group, cites from works where abstract is not null union all select 'recent', source_group, cites from works where year >= 2015)
select role, source_group, count(*) n, round(avg(cites), 4) mean from u group by 1, 2""")
def a24_role_origin_grid(s, d):
    flags = F.array_compact(F.array(F.when(F.col("doi").isNotNull(), "doi"), F.when(F.col("abstract").isNotNull(), "abstract"), F.when(F.col("year") >= 2015, "recent")))
    return works(s, d).select(F.explode(flags).alias("role"), "source_group", "cites").groupBy("role", "source_group").agg(F.count("*").alias("n"), F.round(F.avg("cites"), 4).alias("mean"))


@q("select cast(year // 10 * 10 as int) as decade, count(*) n from works where year is not null group by 1")
def a25_decades(s, d):
    return works(s, d).where("year is not null").groupBy((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@q("select source_group, venue, grouping(source_group) + grouping(venue) lvl, count(*) n from works group by grouping sets ((source_group, venue), (source_group), ())")
def a26_rollup(s, d):
    lvl = (F.grouping("source_group") + F.grouping("venue")).cast("bigint")
    return works(s, d).rollup("source_group", "venue").agg(lvl.alias("lvl"), F.count("*").alias("n"))


# --- windows


@q("select work_id, case when count(*) over () = 1 then 1.0 else (row_number() over (order by cites, work_id) - 1) / (count(*) over () - 1) end pr from works where cites is not null")
def w1_percentile_rank(s, d):
    return O.percentile_rank(works(s, d).where("cites is not null").select("work_id", "cites"), "cites", "work_id").select("work_id", F.col("pr"))


@q("select work_id, round((rank() over (order by cites) + (count(*) over (partition by cites) - 1) / 2.0) / count(*) over (), 9) r from works where cites is not null")
def w2_average_rank(s, d):
    return O.average_rank(works(s, d).where("cites is not null").select("work_id", "cites"), "cites").select("work_id", F.round("r", 9).alias("r"))


@q("select work_id, cast(round(round(100 * (rank() over (partition by year order by cites) + (count(*) over (partition by year, cites) - 1) / 2.0) / count(*) over (partition by year), 6)) as int) r from works where cites is not null and year is not null")
def w3_rank_in_year(s, d):
    w = works(s, d).where("cites is not null and year is not null").select("work_id", "year", "cites")
    return O.average_rank(w, "cites", "year").select("work_id", F.round(F.round(100 * F.col("r"), 6)).cast("int").alias("r"))


@q("select work_id, cast(row_number() over (partition by year // 10 order by cites desc, work_id) as int) k from works where cites is not null and year is not null")
def w4_quota_rank(s, d):
    w = works(s, d).where("cites is not null and year is not null").select("work_id", "cites", "year")
    return O.rank_within(w, F.floor(F.col("year") / 10), [F.desc("cites"), F.asc("work_id")]).select("work_id", F.col("rank").cast("int").alias("k"))


@q("with m as (select year, median(cites) med from works where cites is not null and year is not null group by 1) select work_id, round((cites + 1) / (med + 1), 6) res from works w join m on m.year = w.year where cites is not null")
def w5_median_residual(s, d):
    w = works(s, d).where("cites is not null and year is not null").select("work_id", "year", "cites")
    med = w.groupBy("year").agg(F.median("cites").alias("med"))
    return w.join(med, "year").select("work_id", F.round((F.col("cites") + 1) / (F.col("med") + 1), 6).alias("res"))


@q("select work_id, cast(row_number() over (order by cites desc nulls last, year desc nulls last, work_id) as bigint) k from works")
def w6_ordinal(s, d):
    return O.global_rank(works(s, d).select("work_id", "cites", "year"), [F.desc_nulls_last("cites"), F.desc_nulls_last("year"), F.asc("work_id")]).select("work_id", F.col("rank").alias("k"))


@q("select work_id, pos, case when n = 1 then 'single' when pos = 1 then 'first' when pos = n then 'last' else 'middle' end slot from mentions")
def w7_author_slot(s, d):
    return mentions(s, d).select("work_id", "pos", O.slot(F.col("pos"), F.col("n")).alias("slot"))


@q()
def w8_year_cohorts(s, d):
    return O.cohorts(works(s, d).where("year is not null"), "year", 8)


@q("""with r as (select src, dst, row_number() over (partition by src order by p.cites desc, dst) k from edges join papers p on p.id = dst) select src, string_agg(cast(dst as varchar), ';' order by k) top from r where k <= 8 group by 1""")
def w9_capped_neighbours(s, d):
    e = edges(s, d).join(papers(s, d).select(F.col("id").alias("dst"), "cites"), "dst")
    return O.top_n(e, ["src"], [F.desc("cites"), F.asc("dst")], 8).groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"].cast("string")), ";").alias("top"))


# --- sort and top-k


@q("select seed_row, decision, confidence, row_number() over (order by confidence desc nulls last, seed_row) place from seeds")
def t1_mixed_sort(s, d):
    x = seeds(s, d).select("seed_row", "decision", "confidence")
    return O.global_rank(x, [F.desc_nulls_last("confidence"), F.asc("seed_row")]).withColumnRenamed("rank", "place")


@q("select work_id, cites from works order by cites desc nulls last, work_id limit 100")
def t2_head(s, d):
    return works(s, d).select("work_id", "cites").orderBy(F.desc_nulls_last("cites"), "work_id").limit(100)


@q("""with p as (select author, count(*) n, sum(cites) c from mentions group by 1), a as (select author from p order by n desc, author limit 100), b as (select author from p order by c desc nulls last, author limit 100) select author, author in (select author from a) by_works, author in (select author from b) by_cites from (select author from a union select author from b)""")
def t3_two_orders(s, d):
    p = mentions(s, d).groupBy("author").agg(F.count("*").alias("n"), F.sum("cites").alias("c"))
    a = p.orderBy(F.desc("n"), "author").limit(100).select("author", F.lit(True).alias("by_works"))
    b = p.orderBy(F.desc_nulls_last("c"), "author").limit(100).select("author", F.lit(True).alias("by_cites"))
    return a.join(b, "author", "full_outer").na.fill(False)


@q("select error, count(*) n from pass2_errors where error is not null group by 1 order by n desc, error limit 10")
def t4_most_common(s, d):
    return table(s, d, "pass2_errors").where("error is not null").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(10)


@q("""select seed_row, cast(case decision when 'core_relevant' then 0 when 'adjacent_relevant' then 1 when 'role_bridge' then 2 else 3 end as int) ord, row_number() over (order by ord, seed_row) place from seeds""")
def t5_custom_order(s, d):
    ord_ = F.when(F.col("decision") == "core_relevant", 0).when(F.col("decision") == "adjacent_relevant", 1).when(F.col("decision") == "role_bridge", 2).otherwise(3)
    return O.global_rank(seeds(s, d).select("seed_row", ord_.alias("ord")), [F.asc("ord"), F.asc("seed_row")]).withColumnRenamed("rank", "place")


# --- set operations


@q(f"""with u as (select work_id, title, 1 pri from works union all select work_id, title, 2 from seeds where work_id is not null), r as (select *, row_number() over (partition by work_id order by pri, title nulls last) k from u) select work_id, title from r where k = 1""")
def u1_union_first_wins(s, d):
    return O.union_first([works(s, d).select("work_id", "title"), seeds(s, d).where("work_id is not null").select("work_id", "title")], "work_id", [F.asc_nulls_last("title")])


@q("""with s as (select work_id, min(venue) venue, min(title) title, min(year) as year from seeds where work_id is not null group by 1) select coalesce(w.work_id, s.work_id) work_id, coalesce(w.venue, s.venue) venue, coalesce(s.title, w.title) title, coalesce(w.year, s.year) as year from works w full join s on s.work_id = w.work_id""")
def u2_backfill(s, d):
    side = seeds(s, d).where("work_id is not null").groupBy("work_id").agg(F.min("venue").alias("venue"), F.min("title").alias("title"), F.min("year").alias("year"))
    return O.backfill(works(s, d).select("work_id", "venue", "title", "year"), side, "work_id", prefer=["title"])


@q("""select seed_row from seeds s where not exists (select 1 from works w where w.work_id = s.work_id) and not exists (select 1 from works w where w.doi = s.doi)""")
def u3_append_new(s, d):
    w = works(s, d)
    return seeds(s, d).select("seed_row", "work_id", "doi").join(w.select("work_id"), "work_id", "left_anti").join(w.where("doi is not null").select("doi").distinct(), "doi", "left_anti").select("seed_row")


@q("select decision_no, coalesce(human, agent) decision, human is not null and human is distinct from agent changed from reviews")
def u4_human_overlay(s, d):
    return reviews(s, d).select("decision_no", F.coalesce("human", "agent").alias("decision"), (F.col("human").isNotNull() & ~F.col("human").eqNullSafe(F.col("agent"))).alias("changed"))


@q("""with o as (select work_id, min(venue) venue, min(title) title from seeds where work_id is not null group by 1) select w.work_id, coalesce(o.venue, w.venue) venue, coalesce(o.title, w.title) title from works w left join o on o.work_id = w.work_id""")
def u5_field_overlay(s, d):
    o = seeds(s, d).where("work_id is not null").groupBy("work_id").agg(F.min("venue").alias("venue"), F.min("title").alias("title"))
    return O.overlay(works(s, d).select("work_id", "venue", "title"), o, "work_id")


@q("""with a as (select distinct work_id k from seeds where work_id is not null), b as (select distinct work_id k from reviews where work_id is not null) select count(a.k) a, count(b.k) b, count(*) filter (where a.k is not null and b.k is not null) both_n, count(*) u, round(count(*) filter (where a.k is not null and b.k is not null) / count(*), 6) jac from a full join b on a.k = b.k""")
def u6_set_compare(s, d):
    return O.set_compare(seeds(s, d).select(F.col("work_id").alias("k")), reviews(s, d).select(F.col("work_id").alias("k")))


@q("""with c as (select work_id, venue from works where cites >= 100), ch as (select work_id, venue from (select work_id, venue, row_number() over (partition by venue order by cites desc nulls last, work_id) k from works where venue is not null) where k = 1)
select work_id, string_agg(why, ';' order by why) why from (select distinct work_id, 'core' why from c union select work_id, 'cell:' || venue from ch) group by 1""")
def u7_core_and_champions(s, d):
    w = works(s, d)
    core = w.where("cites >= 100").select("work_id", F.lit("core").alias("why"))
    best = O.best_row(w.where("venue is not null"), ["venue"], [F.desc_nulls_last("cites"), F.asc("work_id")]).select("work_id", F.concat(F.lit("cell:"), "venue").alias("why"))
    return core.unionByName(best).groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set("why")), ";").alias("why"))


@q(f"""with u as (select coalesce('doi:' || doi, 't:' || {_NT.format('title')}) k, 'seed' route, year from seeds union all select coalesce('doi:' || doi, 't:' || {_NT.format('title')}), 'work', year from works)
select k, string_agg(distinct route, ';' order by route) routes, min(year) as year from u where k is not null group by 1""")
def u8_multi_route_merge(s, d):
    key = F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("t:"), S.normalize_title("title")))
    side = lambda x, r: x.select(key.alias("k"), F.lit(r).alias("route"), "year")
    return side(seeds(s, d), "seed").unionByName(side(works(s, d), "work")).where("k is not null").groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("route")), ";").alias("routes"), F.min("year").alias("year"))


@q("select distinct l_partkey src, l_suppkey dst, l_returnflag kind from lineitem")
def u9_edge_dedupe(s, d):
    return table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind")).distinct()


@q(f"""select user_id, arg_min(event_type, (ts, event_id)) first_type, string_agg(distinct event_type, ';' order by event_type) types from events group by 1""")
def u10_store_upsert(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("types"))


@q("select work_id, count(distinct human) n, case when count(distinct human) > 1 then 'conflict' else 'ok' end status from reviews where work_id is not null group by 1")
def u11_conflicts(s, d):
    return reviews(s, d).where("work_id is not null").groupBy("work_id").agg(F.countDistinct("human").alias("n")).withColumn("status", F.when(F.col("n") > 1, "conflict").otherwise("ok"))


@q("""with e as (select lower(trim(work_id, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))) work_id, max(case when error is null then source end) ok_source, max(source) any_source from pass2_errors group by 1) select w.work_id, coalesce(w.doi, e.ok_source, e.any_source) best, case when w.doi is not null then 'doi' when e.ok_source is not null then 'clean' when e.any_source is not null then 'any' end route from works w left join e on e.work_id = w.work_id""")
def u12_source_fallback(s, d):
    e = table(s, d, "pass2_errors").withColumn("work_id", clean_id("work_id")).where("work_id is not null").groupBy("work_id").agg(F.max(F.when(F.col("error").isNull(), F.col("source"))).alias("clean"), F.max("source").alias("any"))
    return O.coalesce_sources(works(s, d).select("work_id", "doi").join(e, "work_id", "left"), ["doi", "clean", "any"], "best", "route").select("work_id", "best", "route")
