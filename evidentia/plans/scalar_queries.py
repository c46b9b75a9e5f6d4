"""One query per scalar function and rule set, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.common import table, usable
from evidentia.functions import rules as R
from evidentia.functions import scalars as S
from evidentia.operators import labelling as L
from evidentia.operators.relational import overlaps
from evidentia.plans import vocabulary as V
from evidentia.plans.base import Registry, mentions, papers, reviews, seeds, sql_usable, works

REG = Registry()
q = REG.query
QUERIES, ORACLES = REG.queries, REG.oracles
_FOLD = f"translate(lower({{0}}), '{S.MARKED}', '{S.FOLDED}')"
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(" + _FOLD + ", '[^a-z ]', ' ', 'g'), ' +'), lambda x: x <> '')"
_NT = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_DOI = "regexp_replace(regexp_replace(lower(trim({0})), '^((https?://)?(dx\\.|www\\.)?doi\\.org/|doi:\\s*)+', ''), '/+$', '')"
_LC = "list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(coalesce({0},'')), '^\\[|\\]$', '', 'g'), '[;|,]'), lambda v: trim(regexp_replace(trim(v), '^[\"'']|[\"'']$', '', 'g'))), lambda v: lower(v) not in ('','nan','none','null'))"


@q(f"""select seed_row, regexp_replace(lower(trim(doi)), '^(https://doi\\.org/|http://doi\\.org/|doi:)', '') core, regexp_replace(lower(trim(doi)), '^https?://(dx\\.|www\\.)?doi\\.org/', '') resolver, {_DOI.format('doi')} as "full" from manual_seed_works""")
def f1_normalize_doi(s, d):
    return table(s, d, "manual_seed_works").select("seed_row", *[S.normalize_doi("doi", v).alias(v) for v in ("core", "resolver", "full")])


@q(f"select work_id, {_NT.format('title')} t from works")
def f2_normalize_title(s, d):
    return works(s, d).select("work_id", S.normalize_title("title").alias("t"))


@q(f"select distinct last_author, trim(regexp_replace({_FOLD.format('last_author')}, '[^a-z0-9]+', ' ', 'g')) folded from label_ultra_core_ranked")
def f3_norm_text(s, d):
    return table(s, d, "label_ultra_core_ranked").select("last_author", S.norm_text("last_author").alias("folded")).distinct()


@q("select distinct title, trim(regexp_replace(regexp_replace(translate(title, '‘’“”–—−', '''''\"\"---'), '^\\s*(title|article|abstract|research article)\\s*[:\\-]\\s*', '', 'i'), '\\s+', ' ', 'g')) plain from web_search_queue")
def f4_plain_title(s, d):
    return table(s, d, "web_search_queue").select("title", S.plain_title("title").alias("plain")).distinct()


@q(f"select work_id, array_to_string(list_filter(string_split({_NT.format('title')}, ' '), lambda w: w <> '' and w not in {S.STOP}), ' ') tokens from works")
def f5_title_tokens(s, d):
    return works(s, d).select("work_id", F.array_join(S.title_tokens("title"), " ").alias("tokens"))


@q(f"""select distinct author, array_to_string(list_sort(list_distinct(list_filter([w[-1], case when len(w) > 2 then w[-2] || ' ' || w[-1] end], lambda x: x is not null and x <> ''))), ',') s
from (select author, list_filter(regexp_split_to_array(regexp_replace({_FOLD.format('author')}, '[^a-z ]', '', 'g'), ' +'), lambda x: x <> '') w from mentions)""")
def f6_surname_set(s, d):
    return mentions(s, d).select("author", F.array_join(S.surnames_of(F.array("author")), ",").alias("s")).distinct()


@q("""select distinct authors, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(authors, '[;|]'), lambda a: trim(a)), lambda a: a <> ''),
lambda a: case when contains(a, ',') then trim(trim(string_split(a, ',')[2]) || ' ' || trim(string_split(a, ',')[1])) else a end), ';') people from manual_seed_works where authors is not null""")
def f7_parse_authors(s, d):
    return table(s, d, "manual_seed_works").where("authors is not null").select("authors", F.array_join(S.authors_of("authors"), ";").alias("people")).distinct()


@q(f"""select distinct author, w[-1] || '|' || array_to_string(list_transform(w[:-2], lambda x: substr(x, 1, 1)), '') all_initials, w[-1] || '|' || array_to_string(list_transform(list_filter(w[:-2], lambda x: length(x) > 1), lambda x: substr(x, 1, 1)), '') full_names
from (select author, {_WORDS.format('author')} w from mentions)""")
def f8_norm_author(s, d):
    a = F.col("author")
    return mentions(s, d).select("author", S.norm_author(a).alias("all_initials"), S.norm_author(a, False).alias("full_names")).distinct()


@q(f"""select distinct author, case when len(w) >= 3 then array_to_string(list_concat(list_concat(w[1:1], list_filter(w[2:-2], lambda x: length(x) > 1)), w[-1:]), ' ') else array_to_string(w, ' ') end block
from (select author, {_WORDS.format('author')} w from mentions)""")
def f9_name_block(s, d):
    return mentions(s, d).select("author", S.name_block(F.col("author")).alias("block")).distinct()


@q(f"""with x as (select seed_row, {_LC.format('roles')} a, {_LC.format('publication_types')} b, {_LC.format('decision')} c from manual_seed_works), y as (select seed_row, list_distinct(a) a, list_distinct(list_concat(a, c)) b from x)
select seed_row, round(case when len(list_distinct(list_concat(a, b))) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) zero, round(case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6) one from y""")
def f10_jaccard(s, d):
    a = S.list_cell("roles")
    x = table(s, d, "manual_seed_works").select("seed_row", a.alias("a"), F.concat(a, S.list_cell("decision")).alias("b"))
    return x.select("seed_row", F.round(S.jaccard(F.col("a"), F.col("b"), 0.0), 6).alias("zero"), F.round(S.jaccard(F.col("a"), F.col("b"), 1.0), 6).alias("one"))


@q()
def f11_similarity_ratio(s, d):
    t = table(s, d, "human_review_decisions").select(usable("title").alias("a")).where("a is not null").distinct()
    pairs = t.withColumn("b", F.regexp_replace("a", r"\w+$", ""))
    return pairs.select("a", F.round(S.similarity_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@q(f"""select work_id, ({' or '.join(f"starts_with(coalesce(doi,''), '{p}')" for p in S.PREPRINT_DOI)} or contains(lower(coalesce(types,'')), 'preprint') or regexp_matches(lower(coalesce(venue,'')), '{S.PREPRINT_VENUE}')) preprint from works""")
def f12_is_preprint(s, d):
    return works(s, d).select("work_id", S.is_preprint(F.col("doi"), F.col("types"), F.col("venue")).alias("preprint"))


@q("""select n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') fp from nation""")
def f13_fingerprint(s, d):
    return table(s, d, "nation").select("n_nationkey", S.fingerprint("n_name", "n_regionkey", "n_nationkey").alias("fp"))


@q(f"""with x as (select work_id, rtrim(substr(regexp_replace(regexp_replace({_FOLD.format('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60)) stem from works where title is not null),
y as (select *, row_number() over (partition by stem order by work_id) k from x) select work_id, case when k > 1 then stem || '-' || k else stem end stem from y""")
def f14_unique_slug(s, d):
    from pyspark.sql import Window

    x = works(s, d).where("title is not null").select("work_id", S.slug("title").alias("stem"))
    k = F.row_number().over(Window.partitionBy("stem").orderBy("work_id"))
    return x.select("work_id", F.when(k > 1, F.concat("stem", F.lit("-"), k.cast("string"))).otherwise(F.col("stem")).alias("stem"))


@q(r"""select seed_row, array_to_string(list_transform(regexp_extract_all(lower('see ' || coalesce(doi, '') || ', and 10.1234/x.' || seed_row || '.'), '(10\.\d{4,9}/[^\s"<>]+)', 1), lambda x: regexp_replace(x, '[.,;:)\]]+$', '')), ' ') found from manual_seed_works""")
def f15_dois_in_text(s, d):
    text = F.concat(F.lit("see "), F.coalesce("doi", F.lit("")), F.lit(", and 10.1234/x."), F.col("seed_row").cast("string"), F.lit("."))
    return table(s, d, "manual_seed_works").select("seed_row", F.array_join(S.dois_in(text), " ").alias("found"))


@q(f"""select work_id, 'https://doi.org/' || {_DOI.format('doi')} url, case when contains(doi, 'doi.org') then 'resolver' when starts_with(doi, '10.') then 'bare' else 'other' end kind from works where doi is not null""")
def f16_urls(s, d):
    doi = F.col("doi")
    kind = F.when(doi.contains("doi.org"), "resolver").when(doi.startswith("10."), "bare").otherwise("other")
    return works(s, d).where("doi is not null").select("work_id", F.concat(F.lit("https://doi.org/"), S.normalize_doi("doi")).alias("url"), kind.alias("kind"))


@q("""with x as (select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) t from documents)
select doc_id, md5(case when length(t) >= 40 and not regexp_matches(lower(t), '^(no abstract|abstract not available|n/a)') then t end) clean from x""")
def f17_clean_abstract(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(S.clean_abstract("text")).alias("clean"))


@q(r"""with x as (select doc_id, split_part(text, 'References', 1) body from documents where text is not null), y as (select *, string_split(lower(body), 'discussion')[-1] rest, contains(lower(body), 'discussion') has from x),
z as (select doc_id, substr(body, 1, 5000) front, case when has then substr(body, length(body) - length(rest) - 9, 4500) when length(body) > 8000 then right(body, 3500) else '' end tail from y)
select doc_id, md5(substr(case when tail <> '' and not contains(front, tail) then front || '|' || tail else front end, 1, 12000)) chosen from z""")
def f18_section_select(s, d):
    """The front of a text, and what follows the last heading Discussion before the references or else the end of a long text, where the front lacks it."""
    x = table(s, d, "documents").where("text is not null").select("doc_id", F.substring_index("text", "References", 1).alias("body"))
    x = x.withColumn("rest", F.length(F.substring_index(F.lower("body"), "discussion", -1))).withColumn("size", F.length("body"))
    tail = F.when(F.lower("body").contains("discussion"), F.substring("body", F.col("size") - F.col("rest") - 9, F.lit(4500))).when(F.col("size") > 8000, F.substring("body", F.col("size") - 3499, F.lit(3500))).otherwise("")
    x = x.select("doc_id", F.substring("body", 1, 5000).alias("front"), tail.alias("tail"))
    both = F.when((F.col("tail") != "") & ~F.contains("front", F.col("tail")), F.concat("front", F.lit("|"), "tail")).otherwise(F.col("front"))
    return x.select("doc_id", F.md5(F.substring(both, 1, 12000)).alias("chosen"))


@q(r"""select doc_id, cast(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) as int) n from documents where text is not null""")
def f19_sentences(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(S.sentences_of("text")).alias("n"))


@q("select work_id, round(ln(1 + cites) / sqrt(greatest(1, 2026 - year + 1)), 6) signal from works where year is not null and cites is not null")
def f20_age_normalized(s, d):
    return works(s, d).where("year is not null and cites is not null").select("work_id", F.round(S.age_normalized(F.col("cites"), F.col("year"), 2026), 6).alias("signal"))


@q("select work_id, round(cites / greatest(1, 2026 - year + 1), 6) inclusive, round(cites / greatest(0.5, 2026 - year), 6) clipped from works where year is not null and cites is not null")
def f21_cites_per_year(s, d):
    w = works(s, d).where("year is not null and cites is not null")
    return w.select("work_id", *[F.round(S.cites_per_year(F.col("cites"), F.col("year"), 2026, v), 6).alias(v) for v in ("inclusive", "clipped")])


@q("""with g as (select id, (select count(*) from edges e where e.dst = p.id) i, (select count(*) from edges e where e.src = p.id) o from papers p)
select id, case when i >= 50 then 'hub' when i = 0 and o = 0 then 'isolate' when i = 0 then 'only_out' when o = 0 then 'only_in' else 'broker' end as role,
case when i + o <= 2 and i = 0 then 'weak_unlinked' when i + o <= 2 then 'weak' when i + o <= 9 then 'moderate' else 'strong' end strength, case when i = 0 and o = 0 then null when i = 0 then cast(o as double) else round(o / i, 3) end asym from g""")
def f22_citation_roles(s, d):
    from evidentia.plans.base import edges

    g = edges(s, d)
    i = g.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    o = g.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    x = papers(s, d).select("id").join(i, "id", "left").join(o, "id", "left").na.fill(0)
    return x.select("id", S.citation_role(F.col("i"), F.col("o")).alias("role"), S.link_strength(F.col("i"), F.col("o")).alias("strength"), S.asymmetry(F.col("i"), F.col("o")).alias("asym"))


_LANDMARK = r"(whole[- ]brain|petascale|first (complete )?connectome|wiring diagram of|complete connectome|^an atlas|^a map)"


@q(f"select seed_row, coalesce(decision = 'core_relevant' and (cites >= 5 or (regexp_matches(coalesce(title,''), '(?i){_LANDMARK}') and cites >= 3)), false) ultra from seeds")
def f23_ultra_core(s, d):
    mark = F.coalesce("title", F.lit("")).rlike("(?i)" + _LANDMARK)
    return seeds(s, d).select("seed_row", F.coalesce((F.col("decision") == "core_relevant") & ((F.col("cites") >= 5) | (mark & (F.col("cites") >= 3))), F.lit(False)).alias("ultra"))


_STUDENT = r"(review|survey|primer|introduction|tutorial|tool|software|open[- ]source|perspective|guide|course|training)"
_LABELS = [("field_defining", "decision = 'core_relevant' and cites >= 5"), ("core_methods", "decision = 'core_relevant' and core_gate = 'connectomics_pipeline_tool'"), ("key_for_students", f"regexp_matches(coalesce(title,''), '(?i){_STUDENT}') or (decision = 'adjacent_relevant' and confidence >= 0.85)")]
_TIER = [("core_high_confidence", "decision = 'core_relevant' and confidence >= 0.85"), ("core_review", "decision = 'core_relevant'"), ("adjacent", "decision = 'adjacent_relevant'"), ("role_bridge", "decision = 'role_bridge'")]


@q(f"select seed_row, {R.sql_all(_LABELS)} labels, {R.sql_first(_TIER)} tier from seeds")
def f24_labels_and_tier(s, d):
    student = F.coalesce("title", F.lit("")).rlike("(?i)" + _STUDENT)
    core, conf = F.col("decision") == "core_relevant", F.col("confidence") >= 0.85
    labels = R.all_matches([("field_defining", core & (F.col("cites") >= 5)), ("core_methods", core & (F.col("core_gate") == "connectomics_pipeline_tool")), ("key_for_students", student | ((F.col("decision") == "adjacent_relevant") & conf))])
    tier = R.first_match([("core_high_confidence", core & conf), ("core_review", core), ("adjacent", F.col("decision") == "adjacent_relevant"), ("role_bridge", F.col("decision") == "role_bridge")])
    return seeds(s, d).select("seed_row", F.array_join(labels, ";").alias("labels"), tier.alias("tier"))


@q("""select seed_row, case when year is not null and year <= 2005 and coalesce(cites,0) < 2 then (case when coalesce(cites,0) >= 1 then 'hidden_gem' else 'drop' end) when coalesce(cites,0) >= 10 then 'core' else 'contextual' end layer,
case when year is null or year >= 2021 then 'young' when year <= 2005 then 'old' else 'middle' end age from seeds""")
def f25_layered_overlay(s, d):
    c, y = F.coalesce("cites", F.lit(0)), F.col("year")
    old = y.isNotNull() & (y <= 2005)
    layer = R.first_match([("hidden_gem", old & (c < 2) & (c >= 1)), ("drop", old & (c < 2)), ("core", c >= 10)], "contextual")
    return seeds(s, d).select("seed_row", layer.alias("layer"), R.first_match([("young", y.isNull() | (y >= 2021)), ("old", y <= 2005)], "middle").alias("age"))


@q("""select id, case when year <= 2005 then 'history' when year <= 2018 then 'contemporary' else 'sota' end period, case when year <= 2005 and cites < 1200 then 'history_below_bar' when year <= 2005 then 'history_milestone' when cites >= 1500 then 'keep' else 'below_bar' end why from papers""")
def f26_period_rule(s, d):
    y, c = F.col("year"), F.col("cites")
    return papers(s, d).select("id", R.first_match([("history", y <= 2005), ("contemporary", y <= 2018)], "sota").alias("period"), R.first_match([("history_below_bar", (y <= 2005) & (c < 1200)), ("history_milestone", y <= 2005), ("keep", c >= 1500)], "below_bar").alias("why"))


_LINE = "' ' || trim(regexp_replace(replace(lower(coalesce({0}, '')), ':', ' : '), '[^\\p{{L}}\\p{{N}}:]+', ' ', 'g')) || ' '"
#: Record types in SQL, written out by hand beside the operator.
RECORD_SQL = f"""src as (select 'register' as src, work_id, title, types, abstract from works union all select distinct 'queue', lower({sql_usable('work_id')}), title, null, null from web_search_queue),
c as (select *, regexp_replace({_LINE.format('title')}, '[0-9]+', '#', 'g') t, list_filter(list_transform(regexp_split_to_array(coalesce(types, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '' and lower(x) <> 'nan') k from src),
h as (select *, case when starts_with(t, ' review for ') or starts_with(t, ' referee report ') or starts_with(t, ' decision letter ') or starts_with(t, ' author response ') then 'referee'
 when starts_with(t, ' erratum ') or starts_with(t, ' corrigendum ') or starts_with(t, ' correction to ') or starts_with(t, ' correction : ') then 'mended' when starts_with(t, ' retraction ') or starts_with(t, ' retracted ') or starts_with(t, ' withdrawn ') then 'taken_back'
 when starts_with(t, ' editorial ') or starts_with(t, ' comment on ') or starts_with(t, ' commentary ') or starts_with(t, ' reply to ') then 'opinion' when starts_with(t, ' chapter # ') then 'numbered' end as rule,
 case when list_contains(k, 'Editorial') then 'Editorial' when list_contains(k, 'Book') and not list_contains(k, 'JournalArticle') then 'Book' when list_contains(k, 'Dataset') and not list_contains(k, 'JournalArticle') and not list_contains(k, 'Conference') then 'Dataset' end code0,
 list_contains(k, 'LettersAndComments') weak, list_contains(k, 'Review') or list_contains(k, 'CaseReport') or list_contains(k, 'Study') research from c),
m as (select *, case rule when 'referee' then 'peer_review_report' when 'mended' then 'erratum_correction' when 'taken_back' then 'retraction' when 'opinion' then 'editorial_commentary' when 'numbered' then 'book_or_chapter' end kind,
 case code0 when 'Editorial' then 'editorial_commentary' when 'Book' then 'book_or_chapter' when 'Dataset' then 'dataset_or_software' end says0 from h),
v as (select *, code0 is not null and research and kind is distinct from says0 veto from m),
r as (select *, coalesce(kind, case when not veto then says0 end, 'research_paper') record_type, case when rule is null then concat_ws(';', case when contains(t, ' survey ') then 'survey' end, case when contains(t, ' project ') then 'named_project' end) else '' end watch,
 case when not veto then says0 end says from v),
f as (select *, veto or coalesce(kind <> says, false) or (record_type <> 'research_paper' and research) conflict, coalesce(kind = says, false) or (weak and coalesce(kind = 'editorial_commentary', false)) agree from r),
l as (select *, greatest(0, case when rule is not null then case when agree or rule in ('referee', 'mended', 'taken_back') then 2 else 1 end when record_type <> 'research_paper' then 1 when weak or veto or watch <> '' then 1 else 2 end
 - case when record_type <> 'research_paper' and conflict then 1 else 0 end - case when rule is not null and len(k) = 0 then 1 else 0 end) lvl from f),
typed as (select src, work_id, title, record_type, case lvl when 2 then 'high' when 1 then 'medium' else 'low' end confidence, rule title_rule, case when not veto then code0 end code, case when veto then code0 end vetoed, conflict, watch,
 concat_ws(';', case when record_type <> 'research_paper' and lvl < 2 then 'unconfirmed' end, case when record_type <> 'research_paper' and conflict then 'conflict' end,
 case when record_type <> 'research_paper' and length(trim(coalesce(abstract, ''))) >= 600 then 'long_abstract' end, case when record_type = 'research_paper' and veto then 'vetoed_code' end, case when record_type = 'research_paper' and weak then 'weak_code' end, case when watch <> '' then 'watch' end) reasons from l)"""


@q(f"with {RECORD_SQL} select * from typed")
def f27_record_type(s, d):
    queue = table(s, d, "web_search_queue").select(F.lit("queue").alias("src"), F.lower(usable("work_id")).alias("work_id"), "title", F.lit(None).cast("string").alias("types"), F.lit(None).cast("string").alias("abstract")).distinct()
    both = works(s, d).select(F.lit("register").alias("src"), "work_id", "title", "types", "abstract").unionByName(queue)
    return L.record_types(both, "title", "types", "abstract", V.RECORDS).drop("types", "abstract")


@q(f"""with x as (select work_id, {_LINE.format("coalesce(title, '') || ' ' || coalesce(abstract, '')")} t from works),
y as (select *, concat_ws(';', case when contains(t, ' sparse tracing ') then 'sparse_tracing' end, case when contains(t, ' automated segmentation ') then 'automated_segmentation' end, case when contains(t, ' graph based ') then 'graph_view' end) own from x)
select work_id, concat_ws(';', case when contains(t, ' electron microscopy ') or contains(t, ' imaging ') then 'imaging' end, case when contains(t, ' tracing ') or contains(t, ' segmentation ') then 'tracing' end, case when contains(t, ' annotations ') or contains(t, ' proofreaders ') then 'checking' end,
case when contains(t, ' motifs ') or contains(t, ' models ') or contains(t, ' wiring ') then 'analysis' end) stages,
case when own <> '' then own else concat_ws(';', case when contains(t, ' electron microscopy ') then 'microscopy' end, case when contains(t, ' volumes ') or contains(t, ' dataset ') then 'volume_data' end) end methods,
case when contains(t, ' mushroom body ') or contains(t, ' mushroom bodies ') then 'insect' when contains(t, ' lateral line ') then 'fish' when contains(t, ' mouse ') or contains(t, ' mice ') then 'mouse' when contains(t, ' zebrafish ') then 'fish'
when contains(t, ' locusts ') or contains(t, ' beetle ') or contains(t, ' fly ') then 'insect' when contains(t, ' songbird ') then 'bird' end organism from y""")
def f28_tags(s, d):
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    w, t = works(s, d).select("work_id", L.wordline(text).alias("t")), F.col("t")
    owner = R.first_match([(o, L.holds(t, V.STRUCTURES[n])) for n, o in V.OWNERS.items()])
    return w.select("work_id", F.array_join(L.tags(t, V.STAGES), ";").alias("stages"), F.array_join(L.tags_or(t, V.METHODS, V.GENERAL_METHODS), ";").alias("methods"), L.one_tag(t, V.ORGANISMS, owner).alias("organism"))


@q(f"""with x as (select doc_id, {_LINE.format('text')} t from documents) select doc_id,
(contains(t, ' training course ') or contains(t, ' training courses ') or contains(t, ' curriculum ') or contains(t, ' workshop ') or contains(t, ' tutorial ') or contains(t, ' summer school ') or contains(t, ' students '))
and not (contains(t, ' neural network ') or contains(t, ' neural networks ') or contains(t, ' deep learning ') or contains(t, ' classifier ') or contains(t, ' trained network ') or contains(t, ' training data ')) people_training from x""")
def f29_training_veto(s, d):
    x = table(s, d, "documents").select("doc_id", L.wordline("text").alias("t"))
    return x.select("doc_id", (L.holds(F.col("t"), V.TRAINING) & ~L.holds(F.col("t"), V.MACHINES)).alias("people_training"))


@q("""select seed_row, case when decision is distinct from 'core_relevant' then null when core_gate is not null then core_gate when regexp_matches(coalesce(title,''), '(?i)reconstruct|segmentation|proofread') then 'em_or_synaptic_reconstruction' else 'analysis_on_wiring_graph' end gate from seeds""")
def f30_core_gate(s, d):
    not_core = ~F.col("decision").eqNullSafe("core_relevant")
    by_title = F.when(F.coalesce("title", F.lit("")).rlike("(?i)reconstruct|segmentation|proofread"), "em_or_synaptic_reconstruction").otherwise("analysis_on_wiring_graph")
    return seeds(s, d).select("seed_row", F.when(not_core, None).otherwise(F.coalesce("core_gate", by_title)).alias("gate"))


@q("""with n as (select author, lower(string_split(author, ' ')[-1]) sn, substr(lower(author), 1, 1) i, min(year) y1, max(year) y2, count(*) k from mentions group by author) select x.author a, y.author b,
case when coalesce(x.y2 < y.y1, false) or coalesce(y.y2 < x.y1, false) then 'collision' when x.k >= 2 and y.k >= 2 then 'probable' when x.k >= 2 or y.k >= 2 then 'possible' else 'ambiguous' end cls from n x join n y on x.sn = y.sn and x.i = y.i and x.author < y.author""")
def f31_pair_class(s, d):
    n = mentions(s, d).groupBy("author").agg(F.min("year").alias("y1"), F.max("year").alias("y2"), F.count("*").alias("k")).withColumn("sn", F.lower(F.element_at(F.split("author", " "), -1))).withColumn("i", F.substring(F.lower("author"), 1, 1))
    y = n.select(F.col("author").alias("b"), "sn", "i", F.col("y1").alias("b1"), F.col("y2").alias("b2"), F.col("k").alias("k2"))
    many, other = F.col("k") >= 2, F.col("k2") >= 2
    apart = ~overlaps(*[F.col(c) for c in ("y1", "y2", "b1", "b2")])
    return n.join(y, ["sn", "i"]).where("author < b").select(F.col("author").alias("a"), "b", R.first_match([("collision", apart), ("probable", many & other), ("possible", many | other)], "ambiguous").alias("cls"))


@q("""select decision_no, case when agent = human then 0 when agent is null or human is null then 1 when 'core_relevant' in (agent, human) and 'out_of_scope' in (agent, human) then 5 when 'core_relevant' in (agent, human) then 4 when 'out_of_scope' in (agent, human) then 3 else 2 end stake from reviews""")
def f32_stake_tier(s, d):
    a, h = F.col("agent"), F.col("human")
    has = lambda v: (a == v) | (h == v)
    return reviews(s, d).select("decision_no", F.when(a == h, 0).when(a.isNull() | h.isNull(), 1).when(has("core_relevant") & has("out_of_scope"), 5).when(has("core_relevant"), 4).when(has("out_of_scope"), 3).otherwise(2).alias("stake"))


@q(f"select seed_row, array_to_string({_LC.format('roles')}, '~') items from manual_seed_works")
def f33_list_cell(s, d):
    return table(s, d, "manual_seed_works").select("seed_row", F.array_join(S.list_cell("roles"), "~").alias("items"))


@q("""with x as (select doc_id, coalesce(regexp_matches(text, 'neuron'), false) a, coalesce(regexp_matches(text, 'mouse|mice'), false) b, coalesce(regexp_matches(text, 'fruit fl'), false) c from documents)
select doc_id, cast(case when a then 1 else 0 end | case when b then 2 else 0 end | case when c then 4 else 0 end as int) mask, b is_mouse from x""")
def f34_bitmask(s, d):
    t = F.col("text")
    x = table(s, d, "documents").select("doc_id", S.bits([t.contains("neuron"), t.rlike("mouse|mice"), t.contains("fruit fl")]).alias("mask"))
    return x.select("doc_id", "mask", S.bit(F.col("mask"), 1).alias("is_mouse"))


@q(r"with x as (select work_id, trim(regexp_replace(title, '[ \t\n\r\f\v]+', ' ', 'g')) t from works) select work_id, case when length(t) > 40 then rtrim(substr(t, 1, 39)) || '…' else t end short from x")
def f35_ellipsis(s, d):
    return works(s, d).select("work_id", S.ellipsis("title", 40).alias("short"))


@q(f"""select s.seed_row, contains({_NT.format('w.title')}, {_NT.format('s.title')}) or contains({_NT.format('s.title')}, {_NT.format('w.title')}) title_ok, abs(s.year - w.year) <= 1 year_ok, contains(lower(w.venue), lower(s.venue)) venue_ok from seeds s join works w on s.work_id = w.work_id""")
def f36_consistency(s, d):
    a, b = seeds(s, d).select("seed_row", "work_id", "title", "year", "venue"), works(s, d).select("work_id", F.col("title").alias("t2"), F.col("year").alias("y2"), F.col("venue").alias("v2"))
    x, y = S.normalize_title("title"), S.normalize_title("t2")
    return a.join(b, "work_id").select("seed_row", (y.contains(x) | x.contains(y)).alias("title_ok"), (F.abs(F.col("year") - F.col("y2")) <= 1).alias("year_ok"), F.lower("v2").contains(F.lower("venue")).alias("venue_ok"))


@q("""with l as (select distinct last_author a from label_ultra_core_ranked), x as (select work_id, list_transform(string_split(authors, ';'), lambda v: trim(v)) p from works where authors is not null),
f as (select work_id, exists (select 1 from l where l.a = p[1]) first, exists (select 1 from l where l.a = p[-1]) last from x) select work_id, case when first or last then 'interest_1' else 'none' end tag from f""")
def f37_interest_tag(s, d):
    people = table(s, d, "label_ultra_core_ranked").select(F.col("last_author").alias("author")).distinct()
    ends = mentions(s, d).where("pos = 1 or pos = n").join(people.withColumn("hit", F.lit(True)), "author", "left")
    return ends.groupBy("work_id").agg(F.when(F.coalesce(F.bool_or("hit"), F.lit(False)), "interest_1").otherwise("none").alias("tag"))


_SCOPE = {"direct": ["connectome", "wiring", "synaptic", "circuit"], "resolution": ["electron microscopy", "synaptic", "nanoscale"], "network": ["graph", "motif", "network"], "macro": ["mri", "tractography"]}


@q(f"with x as (select work_id, lower(coalesce(title,'') || ' ' || coalesce(abstract,'')) t from works) select work_id, {', '.join('array_to_string(list_sort(list_filter(' + str(v) + ', lambda w: contains(t, w))), chr(59)) ' + k for k, v in _SCOPE.items())} from x")
def pr4_term_hits(s, d):
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    w = works(s, d).select("work_id", t.alias("t"))
    hits = lambda terms: F.array_join(F.array_sort(F.filter(F.array(*map(F.lit, terms)), lambda x: F.contains(F.col("t"), x))), ";")
    return w.select("work_id", *[hits(v).alias(k) for k, v in _SCOPE.items()])


_ANY = {k: "(" + " or ".join(f"contains(t, '{w}')" for w in v) + ")" for k, v in _SCOPE.items()}
_REASONS = [("direct_resolution", f"{_ANY['direct']} and {_ANY['resolution']}"), ("network_direct", f"{_ANY['direct']} and {_ANY['network']}")]


@q(f"with x as (select work_id, lower(coalesce(title,'') || ' ' || coalesce(abstract,'')) t from works), y as (select *, {R.sql_all(_REASONS)} reasons from x) select work_id, reasons, reasons <> '' keep, {_ANY['macro']} and reasons = '' blocked from y")
def pr5_classify_scope(s, d):
    t = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit(""))))
    has = {k: F.arrays_overlap(F.array(F.lit(True)), F.array(*[t.contains(w) for w in v])) for k, v in _SCOPE.items()}
    w = works(s, d).select("work_id", *[h.alias(k) for k, h in has.items()])
    reasons = F.array_join(R.all_matches([("direct_resolution", F.col("direct") & F.col("resolution")), ("network_direct", F.col("direct") & F.col("network"))]), ";")
    return w.select("work_id", reasons.alias("reasons"), (reasons != "").alias("keep"), (F.col("macro") & (reasons == "")).alias("blocked"))


@q("with x as (select work_id, lower(coalesce(title,'')) t from works) select work_id, concat_ws(';', 'base', case when contains(t, 'graph') then 'network_science' end, case when contains(t, 'atlas') or contains(t, 'dataset') then 'infrastructure' end) axes from x")
def pr6_inferred_axes(s, d):
    t = F.lower(F.coalesce("title", F.lit("")))
    more = R.all_matches([("network_science", t.contains("graph")), ("infrastructure", t.contains("atlas") | t.contains("dataset"))])
    return works(s, d).select("work_id", F.array_join(F.array_union(F.array(F.lit("base")), more), ";").alias("axes"))


_FLAGS = {"f_map": "atlas|map", "f_segment": "segmentation", "f_scale": r"\d+ specimens"}


@q("select work_id, " + ", ".join(f"regexp_matches(coalesce(title,''), '(?i){p}') {n}" for n, p in _FLAGS.items()) + ", regexp_matches(coalesce(title,''), '(?i)" + "|".join(_FLAGS.values()) + "') any_flag from works")
def pr3_regex_flags(s, d):
    flags = R.patterns(F.col("title"), _FLAGS)
    any_ = F.lit(False)
    for _, w in flags:
        any_ = any_ | w
    return works(s, d).select("work_id", *[w.alias(n) for n, w in flags], any_.alias("any_flag"))
