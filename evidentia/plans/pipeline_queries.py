"""Smaller transforms and whole pipelines composed of the operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.common import clean_id, table, usable
from evidentia.functions import rules as R
from evidentia.functions import scalars as S
from evidentia.operators import graph as G
from evidentia.operators import labelling as L
from evidentia.operators import relational as O
from evidentia.operators import sampling
from evidentia.plans import vocabulary as V
from evidentia.plans.base import Registry, coauthors, edges, mentions, papers, reviews, seeds, sql_usable, works
from evidentia.plans.scalar_queries import _LINE, RECORD_SQL

REG = Registry()
q = REG.query
QUERIES, ORACLES = REG.queries, REG.oracles
_NT = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_SLOT = "case when n = 1 then 'single' when pos = 1 then 'first' when pos = n then 'last' else 'middle' end"


def _slot():
    return O.slot(F.col("pos"), F.col("n"))


# --- smaller transforms


@q(f"select work_id, author, pos, n, {_SLOT} slot from mentions")
def r1_mentions(s, d):
    return mentions(s, d).select("work_id", "author", "pos", "n", _slot().alias("slot"))


@q(f"select count(distinct work_id) works, count(*) filter (where {_SLOT} = 'middle') middle, count(*) filter (where {_SLOT} in ('first', 'last')) ends, count(distinct author) people from mentions where n >= 5")
def r2_consortium_stats(s, d):
    m = mentions(s, d).where("n >= 5").withColumn("slot", _slot())
    return m.agg(F.countDistinct("work_id").alias("works"), F.count_if(F.col("slot") == "middle").alias("middle"), F.count_if(F.col("slot").isin("first", "last")).alias("ends"), F.countDistinct("author").alias("people"))


@q("with ok as (select author from mentions group by 1 having bool_or(n = 1 or pos = 1 or pos = n)) select work_id, author, case when n = 1 or pos = 1 then 3 when pos = n then 2 else 1 end weight from mentions where author in (select author from ok)")
def r3_credited_people(s, d):
    m = mentions(s, d)
    ok = m.groupBy("author").agg(F.bool_or(_slot() != "middle").alias("ok")).where("ok").select("author")
    weight = F.when((F.col("n") == 1) | (F.col("pos") == 1), 3).when(F.col("pos") == F.col("n"), 2).otherwise(1)
    return m.join(ok, "author", "left_semi").select("work_id", "author", weight.alias("weight"))


@q("select comm, count(*) works, round(median(cites), 4) med, count(doi) with_doi, count(distinct venue) venues from works where comm is not null group by 1")
def r4_community_summary(s, d):
    return works(s, d).where("comm is not null").groupBy("comm").agg(F.count("*").alias("works"), F.round(F.median("cites"), 4).alias("med"), F.count("doi").alias("with_doi"), F.countDistinct("venue").alias("venues"))


@q("with a as (select lower(last_author) k, min(work_id) person from label_ultra_core_ranked where last_author is not null group by 1) select distinct m.author, coalesce(a.person, 'person:' || lower(m.author)) person from mentions m left join a on a.k = lower(m.author)")
def r5_alias_map(s, d):
    a = table(s, d, "label_ultra_core_ranked").where("last_author is not null").groupBy(F.lower("last_author").alias("k")).agg(F.min("work_id").alias("person"))
    return mentions(s, d).select("author").distinct().withColumn("k", F.lower("author")).join(a, "k", "left").select("author", F.coalesce("person", F.concat(F.lit("person:"), "k")).alias("person"))


@q("select distinct coalesce(trim(a), 'unknown') lead, scale from (select unnest(string_split(coalesce(authors, 'unknown'), ';')) a, scale from seeds)")
def r6_explode_leads(s, d):
    return seeds(s, d).select(F.explode(F.split(F.coalesce("authors", F.lit("unknown")), ";")).alias("a"), "scale").select(F.trim("a").alias("lead"), "scale").distinct()


@q(f"""with recursive l as (select lower({sql_usable('preprint_wid')}) a, lower({sql_usable('published_wid')}) b from exploration_duplicates_expanded where jaccard >= 0.9), e as (select a x, b y from l where a <> b union select b, a from l where a <> b), r as (select distinct x s, x t from e union select r.s, e.y from r join e on e.x = r.t) select s id, min(t) component from r group by 1""")
def r7_manual_links(s, d):
    x = table(s, d, "exploration_duplicates_expanded").where("jaccard >= 0.9").select(clean_id("preprint_wid").alias("a"), clean_id("published_wid").alias("b"))
    return G.components(x.where("a <> b"), "a", "b")


@q(f"select k, bool_or(keep) keep, min(seed_row) first_row, count(*) n from (select coalesce('doi:' || doi, 'id:' || work_id, 't:' || {_NT.format('title')}) k, decision = 'core_relevant' keep, seed_row from seeds) group by 1")
def r8_canonical_keys(s, d):
    key = F.coalesce(F.concat(F.lit("doi:"), "doi"), F.concat(F.lit("id:"), "work_id"), F.concat(F.lit("t:"), S.normalize_title("title")))
    return seeds(s, d).groupBy(key.alias("k")).agg(F.bool_or(F.col("decision") == "core_relevant").alias("keep"), F.min("seed_row").alias("first_row"), F.count("*").alias("n"))


@q("select work_id, count(distinct human) n, string_agg(distinct human, ';' order by human) decisions from reviews where work_id is not null group by 1 having count(distinct human) > 1")
def r9_ingest_conflicts(s, d):
    g = reviews(s, d).where("work_id is not null").groupBy("work_id").agg(F.countDistinct("human").alias("n"), F.array_join(F.array_sort(F.collect_set("human")), ";").alias("decisions"))
    return g.where("n > 1")


@q("select seed_row, 'Title: ' || coalesce(title, '') || ' (' || coalesce(cast(year as varchar), 'n.d.') || ')' prompt, sha256('Title: ' || coalesce(title, '') || ' (' || coalesce(cast(year as varchar), 'n.d.') || ')') fp from seeds where abstract is not null")
def r10_export_frame(s, d):
    p = F.format_string("Title: %s (%s)", F.coalesce("title", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")))
    return seeds(s, d).where("abstract is not null").select("seed_row", p.alias("prompt"), F.sha2(p, 256).alias("fp"))


@q("select k, arg_max(author, (length(author), author)) longest, count(distinct author) variants, min(year) y1, max(year) y2 from (select lower(string_split(author, ' ')[-1]) k, author, year from mentions) group by 1")
def r11_name_metadata(s, d):
    k = F.lower(F.element_at(F.split("author", " "), -1))
    return mentions(s, d).groupBy(k.alias("k")).agg(F.max_by("author", F.struct(F.length("author"), "author")).alias("longest"), F.countDistinct("author").alias("variants"), F.min("year").alias("y1"), F.max("year").alias("y2"))


@q("with u as (select work_id, abstract, 1 p from works union all select work_id, abstract, 2 from seeds where work_id is not null) select work_id, arg_max(abstract, (p, abstract)) last_wins, arg_min(abstract, (p, abstract)) first_wins from u where abstract is not null group by 1")
def r12_field_precedence(s, d):
    u = works(s, d).select("work_id", "abstract", F.lit(1).alias("p")).unionByName(seeds(s, d).where("work_id is not null").select("work_id", "abstract", F.lit(2).alias("p"))).where("abstract is not null")
    return u.groupBy("work_id").agg(F.max_by("abstract", F.struct("p", "abstract")).alias("last_wins"), F.min_by("abstract", F.struct("p", "abstract")).alias("first_wins"))


_CODES = {"mouse": "mammal", "beetle": "insect", "songbird": "bird", "zebrafish": "fish", "fly": "insect", "locusts": "insect"}


@q("with c(code, grp) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _CODES.items()) + ") select w.work_id, min(c.grp) grp from works w left join c on c.code = regexp_extract(lower(w.title), '(mouse|beetle|songbird|zebrafish|fly|locusts)', 1) group by 1")
def r13_code_map(s, d):
    code = F.regexp_extract(F.lower("title"), "(" + "|".join(_CODES) + ")", 1)
    return works(s, d).select("work_id", F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])[code].alias("grp"))


@q("select coalesce(work_id, 'seed_' || seed_row) work_id, title, 'manual_seed' source_group, coalesce(year, 0) as year from seeds union all select work_id, title, source_group, coalesce(year, 0) from works")
def r14_seed_defaults(s, d):
    a = seeds(s, d).select(F.coalesce("work_id", F.concat(F.lit("seed_"), F.col("seed_row").cast("string"))).alias("work_id"), "title", F.lit("manual_seed").alias("source_group"), F.coalesce("year", F.lit(0)).alias("year"))
    return a.unionByName(works(s, d).select("work_id", "title", "source_group", F.coalesce("year", F.lit(0)).alias("year")))


@q(f"""with st as (select w.work_id, w.work_id in (select work_id from reviews where human is not null and work_id is not null) decided, w.work_id in (select lower({sql_usable('work_id')}) from exploration_disconnected where {sql_usable('work_id')} is not null) claimed from works w) select case when decided then 'decided' when claimed then 'claimed' else 'open' end status, count(*) n from st group by 1""")
def r15_queue_status(s, d):
    w = works(s, d).select("work_id")
    dec = reviews(s, d).where("human is not null").select("work_id", F.lit(True).alias("decided")).distinct()
    cl = table(s, d, "exploration_disconnected").select(clean_id("work_id").alias("work_id"), F.lit(True).alias("claimed")).distinct()
    st = w.join(dec, "work_id", "left").join(cl, "work_id", "left")
    return st.groupBy(F.when(F.col("decided"), "decided").when(F.col("claimed"), "claimed").otherwise("open").alias("status")).agg(F.count("*").alias("n"))


@q("select work_id, coalesce('https://doi.org/' || doi, 'venue:' || venue, 'none') link from works")
def r16_link_choice(s, d):
    return works(s, d).select("work_id", F.coalesce(F.concat(F.lit("https://doi.org/"), "doi"), F.concat(F.lit("venue:"), "venue"), F.lit("none")).alias("link"))


@q("with s as (select work_id, min(title) title, min(venue) venue, string_agg(distinct cast(seed_row as varchar), '|' order by cast(seed_row as varchar)) rws from seeds where work_id is not null group by 1) select w.work_id, coalesce(s.title, w.title) title, coalesce(s.venue, w.venue) venue, s.rws from works w left join s on s.work_id = w.work_id")
def r17_catalog_row(s, d):
    side = seeds(s, d).where("work_id is not null").groupBy("work_id").agg(F.min("title").alias("title"), F.min("venue").alias("venue"), F.array_join(F.array_sort(F.collect_set(F.col("seed_row").cast("string"))), "|").alias("rws"))
    return O.left_coalesce(works(s, d).select("work_id", "title", "venue"), side, "work_id", ["title", "venue"])


@q("select doc_id, case when text is null or length(text) < 100 then 'title' when length(text) < 400 then 'abstract' else 'full' end source_kind, length(coalesce(text, '')) >= 400 trusted from documents")
def r18_text_fallback(s, d):
    n = F.length(F.coalesce("text", F.lit("")))
    return table(s, d, "documents").select("doc_id", F.when(n < 100, "title").when(n < 400, "abstract").otherwise("full").alias("source_kind"), (n >= 400).alias("trusted"))


@q(f"""with a as (select lower({sql_usable('work_id')}) k, min({sql_usable('title')}) t from human_review_decisions group by 1), b as (select lower({sql_usable('work_id')}) k, min({sql_usable('title')}) t from exploration_disconnected group by 1), u as (select k, t, 1 p from a where k is not null and t is not null union all select k, t, 2 from b where k is not null and t is not null) select k, arg_min(t, p) t, cast(min(p) as int) p from u group by 1""")
def r19_first_source(s, d):
    side = lambda n, p: table(s, d, n).select(clean_id("work_id").alias("k"), usable("title").alias("t")).where("k is not null and t is not null").groupBy("k").agg(F.min("t").alias("t")).withColumn("p", F.lit(p))
    return side("human_review_decisions", 1).unionByName(side("exploration_disconnected", 2)).groupBy("k").agg(F.min_by("t", "p").alias("t"), F.min("p").alias("p"))


@q("select seed_row, regexp_replace(cast(pmid as varchar), '\\.0$', '') pmid, rtrim(regexp_replace(doi, 'v[0-9]+$', ''), '0') trimmed from manual_seed_works")
def r20_identifier_variants(s, d):
    return table(s, d, "manual_seed_works").select("seed_row", F.regexp_replace(F.col("pmid").cast("string"), r"\.0$", "").alias("pmid"), F.rtrim(F.regexp_replace("doi", "v[0-9]+$", ""), F.lit("0")).alias("trimmed"))


@q("with l as (select work_id, arg_max(human, decision_no) human from reviews where work_id is not null and human is not null group by 1) select work_id, human, human = 'out_of_scope' excluded from l")
def r21_decision_index(s, d):
    r = O.lookup(reviews(s, d).where("work_id is not null and human is not null"), "work_id", "human", "decision_no", "last", "human")
    return r.withColumn("excluded", F.col("human") == "out_of_scope")


@q("select distinct k from (select work_id k from works union all select doi from works where doi is not null union all select trim(m) from (select unnest(string_split(members, ';')) m from works where members is not null))")
def r22_corpus_ids(s, d):
    keys = F.array_compact(F.concat(F.array("work_id", "doi"), F.coalesce(F.transform(F.split("members", ";"), lambda m: F.trim(m)), F.array().cast("array<string>"))))
    return works(s, d).select(F.explode(keys).alias("k")).distinct()


@q("""with p as (select a.author a, b.author b, count(distinct x.c) shared from (select distinct author, lower(string_split(author, ' ')[-1]) k from mentions) a join (select distinct author, lower(string_split(author, ' ')[-1]) k from mentions) b on a.k = b.k and a.author < b.author
left join (select a v, b c from coauthors union all select b, a from coauthors) x on x.v = a.author and exists (select 1 from coauthors z where (z.a = b.author and z.b = x.c) or (z.b = b.author and z.a = x.c)) group by 1, 2)
select a, b, shared, case when shared >= 2 then 'probable' when shared >= 1 then 'possible' else 'ambiguous' end cls from p""")
def r23_pair_classes(s, d):
    names = mentions(s, d).select("author").distinct().withColumn("k", F.lower(F.element_at(F.split("author", " "), -1)))
    c = coauthors(s, d).select("a", "b")
    near = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = O.block_pairs(names, ["k"], "author")
    both = pairs.join(near.select("a", F.col("b").alias("c")), "a").join(near.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).groupBy("a", "b").agg(F.countDistinct("c").alias("shared"))
    j = pairs.select("a", "b").join(both, ["a", "b"], "left").na.fill(0, ["shared"])
    return j.select("a", "b", "shared", R.first_match([("probable", F.col("shared") >= 2), ("possible", F.col("shared") >= 1)], "ambiguous").alias("cls"))


@q("select w.work_id, s.decision, s.seed_row from works w join seeds s on s.work_id = w.work_id where s.decision in ('core_relevant', 'role_bridge')")
def r24_decision_overlay(s, d):
    return works(s, d).select("work_id").join(seeds(s, d).where("decision in ('core_relevant', 'role_bridge')").select("work_id", "decision", "seed_row"), "work_id")


@q("select work_id, case when starts_with(lower(venue), 'journal') or starts_with(lower(venue), 'annals') then 'journal' when contains(lower(venue), 'proceedings') then 'proceedings' when venue is null then 'none' else 'other' end family from works")
def r25_venue_family(s, d):
    v = F.lower("venue")
    return works(s, d).select("work_id", R.first_match([("journal", v.startswith("journal") | v.startswith("annals")), ("proceedings", v.contains("proceedings")), ("none", F.col("venue").isNull())], "other").alias("family"))


@q("with r as (select work_id, min(human) h from reviews where work_id is not null group by 1) select coalesce(r.h, w.source_group) status, count(*) n from works w left join r on r.work_id = w.work_id group by 1")
def r26_patched_status(s, d):
    r = reviews(s, d).where("work_id is not null").groupBy("work_id").agg(F.min("human").alias("h"))
    return works(s, d).join(r, "work_id", "left").groupBy(F.coalesce("h", "source_group").alias("status")).agg(F.count("*").alias("n"))


@q("select work_id, trim(string_split(authors, ';')[-1]) last_author, cast(len(string_split(authors, ';')) as int) n from works where authors is not null")
def r27_last_author(s, d):
    a = F.split("authors", ";")
    return works(s, d).where("authors is not null").select("work_id", F.trim(F.element_at(a, -1)).alias("last_author"), F.size(a).alias("n"))


@q("select row_no, cast(json_extract_string(replace(citation_link_strength, '''', '\"'), '$.weak') as int) weak, cast(json_extract_string(replace(citation_link_strength, '''', '\"'), '$.moderate') as int) moderate from corpus_integrated_communities where starts_with(citation_link_strength, '{')")
def r28_dict_cell(s, d):
    m = F.from_json(F.replace("citation_link_strength", F.lit("'"), F.lit('"')), "map<string,int>")
    return table(s, d, "corpus_integrated_communities").where(F.col("citation_link_strength").startswith("{")).select("row_no", m["weak"].alias("weak"), m["moderate"].alias("moderate"))


@q("select seed_row, case when year between 1800 and 2100 then year end as year, cast((case when title is not null then 1 else 0 end) | (case when doi is not null then 2 else 0 end) | (case when abstract is not null then 4 else 0 end) as int) mask from seeds")
def r29_year_and_bits(s, d):
    return seeds(s, d).select("seed_row", S.year_of("year").alias("year"), S.bits([F.col(c).isNotNull() for c in ("title", "doi", "abstract")]).alias("mask"))


@q("select work_id, cast((row_number() over (order by work_id) - 1) // 200 as int) batch from works where doi is not null")
def r30_id_batches(s, d):
    from evidentia.sources.files import shards_of

    return shards_of(works(s, d).where("doi is not null").select("work_id"), "work_id", 200).withColumnRenamed("shard", "batch")


# --- pipelines


@q(f"""with recursive t as (select work_id, doi, {_NT.format('title')} nt, lower(string_split(trim(string_split(authors, ';')[1]), ' ')[-1]) fa, year, cites from works),
l as (select min(work_id) over (partition by doi) a, work_id b from t where doi is not null union all select x.work_id, y.work_id from t x join t y on x.nt = y.nt and x.fa = y.fa and x.work_id < y.work_id and abs(x.year - y.year) <= 2 where length(x.nt) >= 25),
e as (select a x, b y from l where a <> b union select b, a from l where a <> b), r as (select distinct x s, x t from e union select r.s, e.y from r join e on e.x = r.t), g as (select s id, min(t) grp from r group by 1),
k as (select t.*, coalesce(g.grp, t.work_id) grp from t left join g on g.id = t.work_id)
select grp, arg_min(work_id, (case when doi is null then 1 else 0 end, -coalesce(cites, -1), work_id)) kept, count(*) n from k group by 1""")
def q1_dedupe(s, d):
    first = F.lower(F.element_at(F.split(F.trim(F.split("authors", ";")[0]), " "), -1))
    t = works(s, d).select("work_id", "doi", "year", "cites", S.normalize_title("title").alias("nt"), first.alias("fa"))
    lead = t.where("doi is not null").groupBy("doi").agg(F.min("work_id").alias("a"))
    by_doi = t.join(lead, "doi").select("a", F.col("work_id").alias("b"))
    x = t.where("length(nt) >= 25 and fa is not null")
    y = x.select("nt", "fa", F.col("work_id").alias("b"), F.col("year").alias("y2"))
    by_title = x.join(y, ["nt", "fa"]).where("work_id < b and abs(year - y2) <= 2").select(F.col("work_id").alias("a"), "b")
    g = G.components(by_doi.unionByName(by_title).where("a <> b"), "a", "b")
    k = t.join(g.select(F.col("id").alias("work_id"), "component"), "work_id", "left").withColumn("grp", F.coalesce("component", "work_id"))
    order = F.struct(F.when(F.col("doi").isNull(), 1).otherwise(0).alias("o"), (-F.coalesce("cites", F.lit(-1))).alias("c"), "work_id")
    return k.groupBy("grp").agg(F.min_by("work_id", order).alias("kept"), F.count("*").alias("n"))


_SCORE = "3.0 * least(1, indeg / 30.0) + 1.0 * least(1, outdeg / 50.0) + 1.5 * case when cites >= 1400 then 1 else 0 end"


@q(f"""with g as (select p.*, (select count(*) from edges e where e.dst = p.id) indeg, (select count(*) from edges e where e.src = p.id) outdeg from papers p), x as (select id, round({_SCORE}, 6) score from g)
select id, score, case when score >= 3.0 then 'core_candidate' when score >= 1.5 then 'supported' else 'peripheral' end tier from x""")
def q2_rank_papers(s, d):
    e = edges(s, d)
    i, o = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("indeg")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outdeg"))
    x = papers(s, d).join(i, "id", "left").join(o, "id", "left").na.fill(0, ["indeg", "outdeg"])
    score = F.round(3.0 * F.least(F.lit(1.0), F.col("indeg") / 30.0) + F.least(F.lit(1.0), F.col("outdeg") / 50.0) + 1.5 * F.when(F.col("cites") >= 1400, 1).otherwise(0), 6)
    x = x.select("id", score.alias("score"))
    return x.withColumn("tier", R.first_match([("core_candidate", F.col("score") >= 3.0), ("supported", F.col("score") >= 1.5)], "peripheral"))


_PEOPLE = f"select author, count(distinct work_id) works, min(year) first_year, max(year) last_year, count(*) filter (where {_SLOT} = 'first') firsts, count(*) filter (where {_SLOT} = 'last') lasts, count(*) filter (where {_SLOT} = 'middle') middles, cast(sum(cites) as bigint) cites from mentions group by 1"


def people(m):
    slot = _slot()
    return m.groupBy("author").agg(F.countDistinct("work_id").alias("works"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), *[F.count_if(slot == k).alias(f"{k}s") for k in ("first", "last", "middle")], F.sum("cites").alias("cites"))


@q(_PEOPLE)
def q3_people_map(s, d):
    return people(mentions(s, d))


@q("""with n as (select src id, count(distinct dst) k from edges where dst in (select id from papers where core) group by 1) select p.id, coalesce(k, 0) refs, case when core then 'direct' when coalesce(k, 0) >= 8 and not contains(lower(ptype), 'large') then 'inherited' when coalesce(k, 0) >= 4 then 'adjacent' else 'other' end bucket from papers p left join n on n.id = p.id""")
def q4_scope_cleanup(s, d):
    p = papers(s, d)
    n = edges(s, d).join(p.where("core").select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("refs"))
    x = p.join(n, "id", "left").na.fill(0, ["refs"])
    return x.select("id", "refs", R.first_match([("direct", F.col("core")), ("inherited", (F.col("refs") >= 8) & ~F.lower("ptype").contains("large")), ("adjacent", F.col("refs") >= 4)], "other").alias("bucket"))


@q("""with n as (select author, min(year) y1, max(year) y2, lower(string_split(author, ' ')[-1]) sn, substr(lower(author), 1, 1) i from mentions group by author) select x.author a, y.author b, not (coalesce(x.y2 < y.y1, false) or coalesce(y.y2 < x.y1, false)) overlap from n x join n y on x.sn = y.sn and x.i = y.i and x.author < y.author""")
def q5_person_candidates(s, d):
    n = mentions(s, d).groupBy("author").agg(F.min("year").alias("y1"), F.max("year").alias("y2")).withColumn("sn", F.lower(F.element_at(F.split("author", " "), -1))).withColumn("i", F.substring(F.lower("author"), 1, 1))
    y = n.select(F.col("author").alias("b"), "sn", "i", F.col("y1").alias("b1"), F.col("y2").alias("b2"))
    return n.join(y, ["sn", "i"]).where("author < b").select(F.col("author").alias("a"), "b", O.overlaps(F.col("y1"), F.col("y2"), F.col("b1"), F.col("b2")).alias("overlap"))


@q("""with x as (select p.id, p.ptype, count(*) filter (where c.core) to_core, count(*) n from papers p join edges e on e.src = p.id join papers c on c.id = e.dst where not p.core group by 1, 2) select id, to_core, case when to_core >= 6 then 'recover' when to_core >= 3 and contains(lower(ptype), 'a') then 'review' else 'leave' end act from x""")
def q6_bridge_triage(s, d):
    p = papers(s, d)
    x = p.where("not core").select("id", "ptype").join(edges(s, d).withColumnRenamed("src", "id"), "id").join(p.select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").groupBy("id", "ptype").agg(F.count_if("c").alias("to_core"))
    return x.select("id", "to_core", R.first_match([("recover", F.col("to_core") >= 6), ("review", (F.col("to_core") >= 3) & F.lower("ptype").contains("a"))], "leave").alias("act"))


@q("""with k as (select case when core then 'core' when year >= 2015 then 'recent' else 'old' end cat from papers) select cat, count(*) n, (select count(*) from papers) total from k group by 1""")
def q7_accounting(s, d):
    k = papers(s, d).groupBy(R.first_match([("core", F.col("core")), ("recent", F.col("year") >= 2015)], "old").alias("cat")).agg(F.count("*").alias("n"))
    total = papers(s, d).count()
    parts = F.sum("n").over(Window.partitionBy(F.lit(0)))  # three rows
    return k.select("cat", "n", F.when(parts == total, F.lit(total)).otherwise(F.raise_error(F.lit("parts do not add up")).cast("bigint")).alias("total"))


@q(f"""with recursive l as (select distinct lower({sql_usable('preprint_wid')}) a, lower({sql_usable('published_wid')}) b from exploration_duplicates_expanded where {sql_usable('preprint_wid')} is not null and {sql_usable('published_wid')} is not null), e as (select a x, b y from l where a <> b union select b, a from l where a <> b), r as (select distinct x s, x t from e union select r.s, e.y from r join e on e.x = r.t), g as (select s id, min(t) grp from r group by 1)
select grp, 'work_' || substr(sha256(string_agg(id, '|' order by id)), 1, 16) work_id, count(*) versions, max(w.cites) most, cast(sum(w.cites) as bigint) total from g left join works w on w.work_id = g.id group by 1""")
def q8_work_reconciliation(s, d):
    x = table(s, d, "exploration_duplicates_expanded").select(clean_id("preprint_wid").alias("a"), clean_id("published_wid").alias("b")).where("a <> b")
    g = G.components(x, "a", "b").join(works(s, d).select(F.col("work_id").alias("id"), "cites"), "id", "left")
    new = F.concat(F.lit("work_"), F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "|"), 256), 1, 16))
    return g.groupBy(F.col("component").alias("grp")).agg(new.alias("work_id"), F.count("*").alias("versions"), F.max("cites").alias("most"), F.sum("cites").alias("total"))


@q(f"""with {RECORD_SQL}, one as (select work_id, min(record_type) record_type, arg_min(reasons, record_type) reasons from typed where src = 'register' group by 1),
j as (select s.decision, coalesce(o.record_type, 'unclassified') record_type, coalesce(o.reasons, '') reasons from seeds s left join one o on o.work_id = s.work_id)
select decision, record_type, case when record_type in ('research_paper', 'unclassified') then 'paper' else 'non_paper' end part, count(*) n, count(*) filter (where reasons <> '') queued from j group by 1, 2, 3""")
def q9_record_types(s, d):
    typed = L.record_types(works(s, d).select("work_id", "title", "types", "abstract"), "title", "types", "abstract", V.RECORDS)
    x = L.partition(seeds(s, d).select("seed_row", "work_id", "decision"), typed, "work_id")
    return x.groupBy("decision", "record_type", "part").agg(F.count("*").alias("n"), F.count_if(F.col("reasons") != "").alias("queued"))


@q("""select seed_row, case when decision = 'core_relevant' and confidence < 0.6 then 'core_noise_audit' when decision = 'uncertain' then 'uncertain' when confidence < 0.5 then 'low_confidence' end reason from seeds""")
def q10_annotate(s, d):
    dec, conf = F.col("decision"), F.col("confidence")
    rules = [("low_confidence", conf < 0.5), ("uncertain", dec == "uncertain"), ("core_noise_audit", (dec == "core_relevant") & (conf < 0.6))]
    return seeds(s, d).select("seed_row", R.last_match(rules).alias("reason"))


@q("select cast(year // 10 * 10 as int) as decade, source_group, count(*) n, round(quantile_cont(cites, 0.9), 4) p90, count(distinct venue) venues from works where year is not null group by 1, 2")
def q11_checkpoint_summary(s, d):
    dec = (F.floor(F.col("year") / 10) * 10).cast("int")
    return works(s, d).where("year is not null").groupBy(dec.alias("decade"), "source_group").agg(F.count("*").alias("n"), F.round(F.percentile("cites", F.lit(0.9)), 4).alias("p90"), F.countDistinct("venue").alias("venues"))


@q("""with recursive n as (select distinct author, lower(string_split(author, ' ')[-1]) || '|' || substr(lower(author), 1, 1) k from mentions), c as (select a v, b c from coauthors union all select b, a from coauthors),
l as (select distinct x.author a, y.author b from n x join n y on x.k = y.k and x.author < y.author join c p on p.v = x.author join c q on q.v = y.author and q.c = p.c), e as (select a x, b y from l union select b, a from l), r as (select distinct x s, x t from e union select r.s, e.y from r join e on e.x = r.t), g as (select s id, min(t) grp from r group by 1) select n.author, coalesce(g.grp, n.author) person from n left join g on g.id = n.author""")
def q12_people_reconcile(s, d):
    n = mentions(s, d).select("author").distinct().withColumn("k", F.concat(F.lower(F.element_at(F.split("author", " "), -1)), F.lit("|"), F.substring(F.lower("author"), 1, 1)))
    c = coauthors(s, d).select("a", "b")
    near = c.unionByName(c.select(F.col("b").alias("a"), F.col("a").alias("b")))
    p = O.block_pairs(n, ["k"], "author").select("a", "b")
    l = p.join(near.select("a", F.col("b").alias("c")), "a").join(near.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b").distinct()
    g = G.components(l, "a", "b")
    return n.join(g.select(F.col("id").alias("author"), "component"), "author", "left").select("author", F.coalesce("component", "author").alias("person"))


@q(f"""with p as ({_PEOPLE[:-len(' group by 1')]} group by 1), c as (select v, count(*) k from (select a v from coauthors union all select b from coauthors) group by 1) select p.author, p.works, p.last_year - p.first_year span, coalesce(c.k, 0) coauthors_n, p.works > (select quantile_cont(works, 0.95) from p) outlier from p left join c on c.v = p.author""")
def q13_people_matrix(s, d):
    p = people(mentions(s, d))
    k = coauthors(s, d).select(F.explode(F.array("a", "b")).alias("author")).groupBy("author").agg(F.count("*").alias("coauthors_n"))
    edge = p.agg(F.percentile("works", F.lit(0.95))).first()[0]
    x = p.join(k, "author", "left").na.fill(0, ["coauthors_n"])
    return x.select("author", "works", (F.col("last_year") - F.col("first_year")).alias("span"), "coauthors_n", (F.col("works") > F.lit(edge)).alias("outlier"))


@q("""with g as (select p.id, p.brand, (select count(*) from edges e where e.dst = p.id) i, (select count(*) from edges e where e.src = p.id) o from papers p), x as (select brand, case when i >= 50 then 'hub' when i = 0 and o = 0 then 'isolate' when i = 0 then 'only_out' when o = 0 then 'only_in' else 'broker' end as role, i, o from g) select brand, role, count(*) n, round(median(i), 4) med_in, round(median(o), 4) med_out from x group by 1, 2""")
def q14_roles_by_community(s, d):
    e = edges(s, d)
    i, o = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i")), e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    x = papers(s, d).select("id", "brand").join(i, "id", "left").join(o, "id", "left").na.fill(0)
    return x.groupBy("brand", S.citation_role(F.col("i"), F.col("o")).alias("role")).agg(F.count("*").alias("n"), F.round(F.median("i"), 4).alias("med_in"), F.round(F.median("o"), 4).alias("med_out"))


_LAYERS = {"full": "true", "matched": "comm is not null", "integrated": "comm is not null and doi is not null", "rescue": "comm is null and coalesce(cites, 0) >= 50", "prime": "coalesce(cites, 0) >= 100"}


@q(" union all ".join(f"select '{n}' layer, count(*) n, round(avg(cites), 4) mean, count(distinct comm) comms from works where {c}" for n, c in _LAYERS.items()))
def q15_layer_views(s, d):
    """All five layers in one pass over the works: each row is counted in every layer it is in."""
    w = works(s, d).select("comm", "cites", F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in _LAYERS.items()])).alias("l"))
    got = w.select(F.explode("l").alias("layer"), "comm", "cites").groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg("cites"), 4).alias("mean"), F.countDistinct("comm").alias("comms"))
    names = w.sparkSession.createDataFrame([(n,) for n in _LAYERS], "layer string")
    return names.join(got, "layer", "left").na.fill(0, ["n", "comms"])


@q("""with m as (select author, work_id, cites, n, pos from mentions where comm is not null), t as (select author, count(distinct work_id) works, cast(sum(cites) as bigint) cites from m group by 1 having bool_or(n = 1 or pos = 1 or pos = n) or count(distinct work_id) > 1), k as (select *, row_number() over (order by works desc, cites desc nulls last, author) r from t) select author, works, cites, cast(r as int) r from k where r <= 100""")
def q16_people_tables(s, d):
    m = mentions(s, d).where("comm is not null")
    t = m.groupBy("author").agg(F.countDistinct("work_id").alias("works"), F.sum("cites").alias("cites"), F.bool_or(_slot() != "middle").alias("edge")).where("edge or works > 1")
    top = t.orderBy(F.desc("works"), F.desc_nulls_last("cites"), "author").limit(100)
    return top.select("author", "works", "cites", F.row_number().over(Window.orderBy(F.desc("works"), F.desc_nulls_last("cites"), "author")).alias("r"))


@q("""with x as (select work_id, year, cites / greatest(0.5, 2026 - year) rate from works where year >= 2018 and cites is not null), p as (select year, quantile_cont(rate, 0.9) p90 from x group by 1) select x.work_id from x join p on p.year = x.year where x.rate >= p.p90 and x.rate >= 1""")
def q17_emergent_core(s, d):
    x = works(s, d).where("year >= 2018 and cites is not null").select("work_id", "year", S.cites_per_year(F.col("cites"), F.col("year"), 2026, "clipped").alias("rate"))
    p = x.groupBy("year").agg(F.percentile("rate", F.lit(0.9)).alias("p90"))
    return x.join(p, "year").where("rate >= p90 and rate >= 1").select("work_id")


@q("""select case when decision = 'core_relevant' and coalesce(cites, 0) >= 10 then 'ultra' when decision = 'core_relevant' then 'core' when year <= 2005 and coalesce(cites, 0) < 2 then 'drop' else 'contextual' end layer, count(*) n, round(avg(confidence), 4) conf from seeds group by 1""")
def q18_tier_overlay(s, d):
    dec, c = F.col("decision") == "core_relevant", F.coalesce("cites", F.lit(0))
    layer = R.first_match([("ultra", dec & (c >= 10)), ("core", dec), ("drop", (F.col("year") <= 2005) & (c < 2))], "contextual")
    return seeds(s, d).groupBy(layer.alias("layer")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("conf"))


def _first(df, key, order):
    return O.best_row(df, [key], order)


@q("""with f as (select *, row_number() over (partition by work_id order by decision_no) k from reviews where work_id is not null) select agent, human, count(*) n, count(*) filter (where 'core_relevant' in (agent, human) and 'out_of_scope' in (agent, human)) high_stakes from f where k = 1 and agent is not null and human is not null group by 1, 2""")
def q19_run_comparison(s, d):
    f = _first(reviews(s, d).where("work_id is not null"), "work_id", [F.asc("decision_no")]).where("agent is not null and human is not null")
    core, out = (F.col("agent") == "core_relevant") | (F.col("human") == "core_relevant"), (F.col("agent") == "out_of_scope") | (F.col("human") == "out_of_scope")
    return f.groupBy("agent", "human").agg(F.count("*").alias("n"), F.count_if(core & out).alias("high_stakes"))


@q("""with f as (select *, row_number() over (partition by work_id order by decision_no desc) k from reviews where work_id is not null) select coalesce(agent, '-') agent, coalesce(human, '-') human, count(*) n from f where k = 1 group by 1, 2""")
def q20_keep_last_comparison(s, d):
    f = _first(reviews(s, d).where("work_id is not null"), "work_id", [F.desc("decision_no")])
    return f.groupBy(F.coalesce("agent", F.lit("-")).alias("agent"), F.coalesce("human", F.lit("-")).alias("human")).agg(F.count("*").alias("n"))


@q(f"""with m as (select lower({sql_usable('preprint_wid')}) old, min(lower({sql_usable('published_wid')})) new from exploration_duplicates_expanded where {sql_usable('preprint_wid')} is not null and {sql_usable('published_wid')} is not null group by 1), x as (select coalesce(m.new, r.work_id) work_id, r.human, r.decision_no from reviews r left join m on m.old = r.work_id where r.work_id is not null) select work_id, arg_max(human, decision_no) human, count(*) n from x group by 1""")
def q21_decision_remap(s, d):
    m = table(s, d, "exploration_duplicates_expanded").select(clean_id("preprint_wid").alias("work_id"), clean_id("published_wid").alias("new")).where("work_id is not null and new is not null").groupBy("work_id").agg(F.min("new").alias("new"))
    x = reviews(s, d).where("work_id is not null").join(m, "work_id", "left").withColumn("work_id", F.coalesce("new", "work_id"))
    return x.groupBy("work_id").agg(F.max_by("human", F.when(F.col("human").isNotNull(), F.col("decision_no"))).alias("human"), F.count("*").alias("n"))


@q("""with x as (select work_id, year, cites, cast(row_number() over (partition by year // 10 order by cites desc, work_id) as int) k, (rank() over (partition by year order by cites) + (count(*) over (partition by year, cites) - 1) / 2.0) / count(*) over (partition by year) p from works where year is not null and cites is not null), m as (select year, median(cites) med from x group by 1)
select work_id, k, round(p, 6) p, round((cites + 1) / (med + 1), 6) res from x join m on m.year = x.year""")
def q22_filter_measures(s, d):
    w = works(s, d).where("year is not null and cites is not null").select("work_id", "year", "cites")
    med = w.groupBy("year").agg(F.median("cites").alias("med"))
    x = O.average_rank(O.rank_within(w, F.floor(F.col("year") / 10), [F.desc("cites"), F.asc("work_id")]), "cites", "year").join(med, "year")
    return x.select("work_id", F.col("rank").cast("int").alias("k"), F.round("r", 6).alias("p"), F.round((F.col("cites") + 1) / (F.col("med") + 1), 6).alias("res"))


@q(f"""with x as (select {_LINE.format("coalesce(title, '') || ' ' || coalesce(abstract, '')")} t from works) select 'imaging' stage, count(*) n from x where contains(t, ' electron microscopy ') or contains(t, ' imaging ') having count(*) > 0
union all select 'tracing', count(*) from x where contains(t, ' tracing ') or contains(t, ' segmentation ') having count(*) > 0 union all select 'checking', count(*) from x where contains(t, ' annotations ') or contains(t, ' proofreaders ') having count(*) > 0
union all select 'analysis', count(*) from x where contains(t, ' motifs ') or contains(t, ' models ') or contains(t, ' wiring ') having count(*) > 0""")
def q23_labelling(s, d):
    t = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    x = works(s, d).select(L.wordline(t).alias("t")).select(F.explode(L.tags(F.col("t"), V.STAGES)).alias("stage"))
    return x.groupBy("stage").agg(F.count("*").alias("n"))


@q("""with w as (select *, case when year <= 1999 then 'early' when year <= 2012 then 'middle' else 'recent' end era from works where year is not null and venue is not null), ch as (select venue, era, work_id from (select *, row_number() over (partition by venue, era order by cites desc nulls last, work_id) k from w) where k = 1)
select work_id, string_agg(venue || '/' || era, ';' order by venue || '/' || era) cells from ch group by 1""")
def q24_stratum_union(s, d):
    w = O.era_join(works(s, d).where("year is not null and venue is not null"), "year", [("early", 0, 1999), ("middle", 2000, 2012), ("recent", 2013, 2020)])
    best = O.best_row(w, ["venue", "era"], [F.desc_nulls_last("cites"), F.asc("work_id")])
    return best.groupBy("work_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "venue", "era"))), ";").alias("cells"))


@q("""with x as (select distinct l_partkey k, s_nationkey cluster from lineitem join supplier on s_suppkey = l_suppkey), c as (select k, count(*) clusters from x group by 1) select t, (select count(*) from c where clusters >= t) n from (select unnest([1, 2, 3, 4]) t)""")
def q25_convergence_diagnostics(s, d):
    sup = table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    c = table(s, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_suppkey").distinct().join(sup, "l_suppkey").groupBy("k").agg(F.countDistinct("s_nationkey").alias("clusters"))
    return O.threshold_curve(c, "clusters", [1, 2, 3, 4])


@q("""with a as (select distinct doi from seeds where doi is not null), b as (select distinct doi from works where doi is not null) select coalesce(a.doi, b.doi) doi, case when b.doi is null then 'only_pool' when a.doi is null then 'only_corpus' else 'both' end side from a full join b on a.doi = b.doi""")
def q26_pool_diff(s, d):
    a = seeds(s, d).where("doi is not null").select("doi", F.lit(1).alias("a")).distinct()
    b = works(s, d).where("doi is not null").select("doi", F.lit(1).alias("b")).distinct()
    return a.join(b, "doi", "full_outer").select("doi", F.when(F.col("b").isNull(), "only_pool").when(F.col("a").isNull(), "only_corpus").otherwise("both").alias("side"))


@q(f"""with byd as (select doi, min(abstract) a from works where doi is not null and abstract is not null group by 1), byt as (select {_NT.format('title')} nt, min(abstract) a from works where title is not null and abstract is not null group by 1)
select s.seed_row, case when s.abstract is not null then 'own' when d.a is not null then 'doi' when t.a is not null then 'title' else 'missing' end source_of, md5(coalesce(s.abstract, d.a, t.a)) fp from seeds s left join byd d on d.doi = s.doi left join byt t on t.nt = {_NT.format('s.title')}""")
def q27_abstract_fill(s, d):
    w = works(s, d).where("abstract is not null")
    by_doi = w.where("doi is not null").groupBy("doi").agg(F.min("abstract").alias("a1"))
    by_title = w.where("title is not null").groupBy(S.normalize_title("title").alias("nt")).agg(F.min("abstract").alias("a2"))
    x = seeds(s, d).withColumn("nt", S.normalize_title("title")).join(by_doi, "doi", "left").join(by_title, "nt", "left")
    kind = F.when(F.col("abstract").isNotNull(), "own").when(F.col("a1").isNotNull(), "doi").when(F.col("a2").isNotNull(), "title").otherwise("missing")
    return x.select("seed_row", kind.alias("source_of"), F.md5(F.coalesce("abstract", "a1", "a2")).alias("fp"))


@q(f"""with e as (select lower({sql_usable('work_id')}) work_id, count(*) tries, count(*) filter (where error is null) ok from pass2_errors where {sql_usable('work_id')} is not null group by 1) select case when e.ok > 0 then 'resolved' when e.tries > 0 then 'failed' when w.doi is not null then 'linked' else 'none' end status, count(*) n from works w left join e on e.work_id = w.work_id group by 1""")
def q28_catalog_status(s, d):
    e = table(s, d, "pass2_errors").select(clean_id("work_id").alias("work_id"), "error").where("work_id is not null").groupBy("work_id").agg(F.count("*").alias("tries"), F.count_if(F.col("error").isNull()).alias("ok"))
    x = works(s, d).select("work_id", "doi").join(e, "work_id", "left")
    return x.groupBy(R.first_match([("resolved", F.col("ok") > 0), ("failed", F.col("tries") > 0), ("linked", F.col("doi").isNotNull())], "none").alias("status")).agg(F.count("*").alias("n"))


@q()
def q29_title_scores(s, d):
    t = table(s, d, "exploration_disconnected").select(clean_id("work_id").alias("work_id"), usable("title").alias("a")).where("work_id is not null and a is not null").distinct()
    x = t.join(works(s, d).select("work_id", F.col("title").alias("b")), "work_id").where("b is not null")
    return x.select("work_id", F.round(S.similarity_ratio(F.lower("a"), F.lower("b")), 6).alias("score"))


@q("""with c as (select work_id, venue, doi, cites from works where cites >= 20) select venue, count(*) n, string_agg(work_id, ',' order by cites desc, work_id) ids, count(doi) dois from c where venue is not null group by 1""")
def q30_visible_export(s, d):
    c = works(s, d).where("cites >= 20 and venue is not null")
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cites")).alias("c"), "work_id"))), lambda x: x["work_id"])
    return c.groupBy("venue").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("ids"), F.count("doi").alias("dois"))


@q("select year, count(*) n, count(abstract) abstracts, count(*) filter (where contains(lower(coalesce(title,'')), 'atlas')) atlas from works group by 1")
def q31_qc_summary(s, d):
    return works(s, d).groupBy("year").agg(F.count("*").alias("n"), F.count("abstract").alias("abstracts"), F.count_if(F.lower(F.coalesce("title", F.lit(""))).contains("atlas")).alias("atlas"))


@q("select kind, k, count(*) n from (select 'decision' kind, decision k from seeds union all select 'gate', core_gate from seeds union all select 'scale', scale from seeds) group by 1, 2")
def q32_coverage(s, d):
    parts = F.array(*[F.struct(F.lit(a).alias("kind"), F.col(b).alias("k")) for a, b in (("decision", "decision"), ("gate", "core_gate"), ("scale", "scale"))])
    return seeds(s, d).select(F.inline(parts)).groupBy("kind", "k").agg(F.count("*").alias("n"))


_BRIDGE = {"sleep": "sleep|anaesthesia", "methods": "segmentation|reconstruction|atlas"}


@q(" union all ".join(f"select '{n}' bridge, work_id from works where regexp_matches(lower(title), '{p}')" for n, p in _BRIDGE.items()))
def q33_bridges(s, d):
    hits = R.all_matches(R.patterns(F.lower("title"), _BRIDGE))
    return works(s, d).select(F.explode(hits).alias("bridge"), "work_id")


@q(f"""with x as (select {_LINE.format('title')} t, cast(year // 10 * 10 as int) dec from works) select case when contains(t, ' mouse ') or contains(t, ' mice ') then 'mouse' when contains(t, ' zebrafish ') then 'fish'
when contains(t, ' locusts ') or contains(t, ' beetle ') or contains(t, ' fly ') then 'insect' when contains(t, ' songbird ') then 'bird' else 'none' end organism, dec, count(*) n from x group by 1, 2""")
def q34_registry_chart(s, d):
    org = L.one_tag(L.wordline("title"), V.ORGANISMS, default="none")
    return works(s, d).groupBy(org.alias("organism"), (F.floor(F.col("year") / 10) * 10).cast("int").alias("dec")).agg(F.count("*").alias("n"))


@q("""with dn as (select distinct work_id from reviews where human is not null and work_id is not null), op as (select work_id from works where abstract is not null and work_id not in (select work_id from dn)) select work_id, cast((row_number() over (order by work_id) - 1) // 100 as int) pack from op""")
def q35_open_packs(s, d):
    from evidentia.sources.files import shards_of

    done = reviews(s, d).where("human is not null and work_id is not null").select("work_id").distinct()
    return shards_of(works(s, d).where("abstract is not null").select("work_id").join(done, "work_id", "left_anti"), "work_id", 100).withColumnRenamed("shard", "pack")


@q("select author, 'https://example.org/?q=' || replace(author, ' ', '+') url, '' decision from mentions where n = 1 group by 1")
def q36_review_sheet(s, d):
    return mentions(s, d).where("n = 1").select("author").distinct().select("author", F.concat(F.lit("https://example.org/?q="), F.replace("author", F.lit(" "), F.lit("+"))).alias("url"), F.lit("").alias("decision"))


@q("""with r as (select source_group, work_id, row_number() over (partition by source_group order by md5('11|' || work_id), work_id) k, count(*) over (partition by source_group) n from works), g as (select work_id from works where cites >= 500), p as (select work_id from r where k <= greatest(1, cast(round(n * 0.02) as int))) select work_id, case when work_id in (select work_id from g) then 'golden' else 'stratum' end why from (select work_id from g union select work_id from p)""")
def q37_pilot_sample(s, d):
    w = works(s, d)
    golden = w.where("cites >= 500").select("work_id", F.lit("golden").alias("why"))
    part = sampling.stratified(w.select("source_group", "work_id"), "source_group", "work_id", 0.02, 11).select("work_id", F.lit("stratum").alias("why"))
    return O.union_first([golden, part], "work_id", [F.asc("why")])


@q("select work_id, count(distinct human) > 1 flipped, count(*) n from reviews where work_id is not null and human is not null group by 1 having count(*) > 1")
def q38_flips(s, d):
    g = reviews(s, d).where("work_id is not null and human is not null").groupBy("work_id").agg((F.countDistinct("human") > 1).alias("flipped"), F.count("*").alias("n"))
    return g.where("n > 1")


@q(f"""select s.seed_row, case when s.doi is null then 'no_doi' when w.doi is null then 'not_found' when {_NT.format('s.title')} = w.nt then 'match' else 'title_differs' end status from seeds s left join (select doi, min({_NT.format('title')}) nt from works where doi is not null group by 1) w on w.doi = s.doi""")
def q39_identifier_check(s, d):
    w = works(s, d).where("doi is not null").groupBy("doi").agg(F.min(S.normalize_title("title")).alias("nt"), F.lit(True).alias("hit"))
    x = seeds(s, d).join(w, "doi", "left")
    return x.select("seed_row", R.first_match([("no_doi", F.col("doi").isNull()), ("not_found", F.col("hit").isNull()), ("match", S.normalize_title("title") == F.col("nt"))], "title_differs").alias("status"))


_ATTEMPT = [("resolved", "error is null"), ("throttled", "regexp_matches(error, '429')"), ("failed", "true")]


@q(f"select error_no, {R.sql_first(_ATTEMPT)} outcome from pass2_errors")
def q40_attempt_outcome(s, d):
    e = F.col("error")
    return table(s, d, "pass2_errors").select("error_no", R.first_match([("resolved", e.isNull()), ("throttled", e.rlike("429")), ("failed", F.lit(True))]).alias("outcome"))


@q(r"""with x as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda v: v <> '') p from documents where text is not null) select doc_id, md5(p[1]) first_part, md5(p[-1]) last_part, cast(len(p) as int) n from x where len(p) > 0""")
def q41_sentence_fields(s, d):
    x = table(s, d, "documents").where("text is not null").select("doc_id", S.sentences_of("text").alias("p")).where(F.size("p") > 0)
    return x.select("doc_id", F.md5(F.col("p")[0]).alias("first_part"), F.md5(F.element_at("p", -1)).alias("last_part"), F.size("p").alias("n"))


@q("select work_id, cites, year, cast(row_number() over (order by cites desc nulls last, year desc nulls last, work_id) as bigint) r from works where source_group = 'core_audit'")
def q42_ranked_lists(s, d):
    w = works(s, d).where("source_group = 'core_audit'").select("work_id", "cites", "year")
    return O.global_rank(w, [F.desc_nulls_last("cites"), F.desc_nulls_last("year"), F.asc("work_id")]).withColumnRenamed("rank", "r")
