import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import scalars as S
from evidentia.operators import graph as G
from evidentia.operators import relational as O
from evidentia.operators.sampling import stratified
from evidentia.sources import files
from evidentia.streaming import progress


def edges(spark, rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint")


def cores(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core, left = {}, {v: set(n) for v, n in near.items()}
    k = 0
    while left:
        low = [v for v, n in left.items() if len(n) <= k]
        if not low:
            k += 1
        for v in low:
            core[v] = k
            for u in left.pop(v):
                if u in left:
                    left[u].discard(v)
    return core


def test_core_numbers(spark):
    r = random.Random(3)
    pairs = [(r.randint(0, 40), r.randint(0, 40)) for _ in range(180)]
    got = {x.id: x.core for x in G.core_numbers(edges(spark, pairs)).collect()}
    assert got == cores(pairs)


def test_in_core_numbers(spark):
    r = random.Random(5)
    pairs = {(a, b) for a, b in ((r.randint(0, 25), r.randint(0, 25)) for _ in range(160)) if a != b}
    want, alive, k = dict.fromkeys(range(26), 0), set(range(26)), 1
    while alive:
        while True:
            gone = {v for v in alive if sum(1 for a, b in pairs if b == v and a in alive) < k}
            if not gone:
                break
            alive -= gone
        for v in alive:
            want[v] = k
        k += 1
    nodes = spark.range(26).select("id")
    assert {x.id: x.core for x in G.in_core_numbers(nodes, edges(spark, list(pairs))).collect()} == want


def test_components_and_empty(spark):
    got = {r.id: r.component for r in G.components(edges(spark, [(1, 2), (2, 3), (9, 8), (3, 1), (5, 5)]), "src", "dst").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5}
    assert G.components(edges(spark, []), "src", "dst").count() == 0
    chain = [(i, i + 1) for i in range(200)]
    assert {r.component for r in G.components(edges(spark, chain), "src", "dst").collect()} == {0}


def test_seed_links_of_the_example(spark):
    e = spark.createDataFrame([("S1", "A"), ("B", "S1"), ("S2", "A"), ("B", "S2")], "src string, dst string")
    got = {r.id: r.direct for r in G.seed_support(e, spark.createDataFrame([("S1",), ("S2",)], "id string")).collect()}
    assert got["A"] == 2 and got["B"] == 2


def test_page_rank_sums_to_one(spark):
    nodes = spark.range(5).select("id")
    rank = G.page_rank(nodes, edges(spark, [(0, 1), (1, 2), (2, 0), (3, 0)]), 30, tol=1e-9)
    assert abs(rank.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert G.page_rank(spark.range(0).select("id"), edges(spark, []), 3).count() == 0


def test_kappa_of_the_examples(spark):
    def k(a, b):
        return O.kappa(spark.createDataFrame(list(zip(a, b)), "a string, b string"), "a", "b").first()

    r = k("ccco", "ccoo")
    assert (r.agreement, r.kappa) == (0.75, 0.5)
    assert k("co", "oc").kappa == -1.0
    assert k("ccc", "ccc").kappa is None


def test_many_to_one_fails_on_repeats(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeats"):
        O.many_to_one(left, right, "k").collect()


def test_global_rank_is_a_permutation(spark):
    df = spark.range(997).select(((F.col("id") * 37) % 101).alias("v"), "id")
    got = O.global_rank(df, [F.asc("v"), F.asc("id")]).orderBy("v", "id").collect()
    assert [r["rank"] for r in got] == list(range(1, 998))


def test_average_rank(spark):
    df = spark.createDataFrame([(1,), (1,), (3,), (4,)], "v int")
    assert sorted(r.r for r in O.average_rank(df, "v").collect()) == [0.375, 0.375, 0.75, 1.0]


def test_cohorts_merge_sparse_years(spark):
    rows = [(y,) for y, n in ((2000, 3), (2001, 6), (2002, 9), (2003, 2)) for _ in range(n)]
    got = {r.year: r.cohort for r in O.cohorts(spark.createDataFrame(rows, "y int"), "y", 8).collect()}
    assert got == {2000: 0, 2001: 0, 2002: 1, 2003: 1}


def test_scalars(spark):
    df = spark.createDataFrame([("DOI: https://doi.org/10.1/AB/", "Ångström-Müller, Ørsted", "x" * 100_000, None)], "d string, t string, l string, e string")
    r = df.select(S.normalize_doi("d").alias("d"), S.norm_text("t").alias("t"), F.length(S.ellipsis("l", 10)).alias("l"), S.normalize_title("e").alias("e"), S.list_cell("e").alias("i"), S.year_of(F.lit("1700")).alias("y")).first()
    assert r.d == "10.1/ab" and r.t == "angstrom muller orsted" and r.l == 10 and r.e is None and r.i == [] and r.y is None


def test_jaccard_of_empty_sets(spark):
    e = F.array().cast("array<string>")
    r = spark.range(1).select(S.jaccard(e, e, 0.0).alias("a"), S.jaccard(e, e, 1.0).alias("b")).first()
    assert (r.a, r.b) == (0.0, 1.0)


def test_stratified_sample_is_stable(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("g"))
    a = {r.id for r in stratified(df, "g", "id", 0.1, 7).collect()}
    assert a == {r.id for r in stratified(df.repartition(7), "g", "id", 0.1, 7).collect()} and len(a) == 9


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', None), (2, "", ["y", "x"])], "i int, t string, l array<string>")
    path = files.write_csv(df, f"file://{tmp_path}/csv")
    got = {r.i: (r.t, r.l) for r in files.read_csv(spark, path, "i int, t string, l string").collect()}
    assert got[1][0] == 'a "b"\nc' and got[2][1] == "x;y"
    empty = files.read_optional(spark, f"file://{tmp_path}/none", df.schema)
    assert empty.count() == 0 and "z" in files.ensure_columns(empty, {"z": "int"}).columns
    with pytest.raises(ValueError, match="missing columns: q"):
        files.require_columns(df, ["q"])
    assert files.manifest(spark, path).where("name like '%.csv'").count() >= 1


def test_stream_resumes_to_the_last_record(spark, tmp_path):
    for n, lines in enumerate((['{"k":1,"v":"a","t":1}', "{bad"], ['{"k":1,"v":"b","t":2}', '{"k":2,"v":"c","t":1}'])):
        (tmp_path / f"{n}.json").write_text("\n".join(lines))
    got = {r.k: r.v for r in progress.latest_per_key(spark, f"file://{tmp_path}", "k int, v string, t int", "k", ["t"]).collect()}
    assert got == {1: "b", 2: "c"}


def test_cut_refuses_a_cluster_without_shared_folder(spark, monkeypatch):
    from evidentia import common

    class Fake:
        class sparkContext:
            master = "spark://x"

            @staticmethod
            def getConf():
                return {}

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Fake)


def test_fuzzy_titles_by_brute_force(spark):
    import difflib

    r = random.Random(5)
    words = ["wiring", "retina", "mice", "layer", "cortex", "motifs", "12", "13", "nucleus", "of the"]
    titles = []
    for k in range(120):
        t = "comparative anatomy of the " + " ".join(r.choice(words) for _ in range(4)) + f" {''.join(r.choice('bdaeiko') for _ in range(6))}"
        titles += [t, "".join(c for c in t if r.random() > 0.04), t + r.choice([" a", " as", " map"]), "a " + t]
    titles += ["a" * 18 + "bcdef", "a" * 18 + "bcdefghij", ""]  # 4 letters of 50 left over: just 0.92
    left = [(k, t, r.choice([None, 2000, 2001, 2003]), None) for k, t in enumerate(titles[::2] + [titles[-2]])]
    right = [(f"w{k}", t, r.choice([None, 2000, 2002, 2004]), None) for k, t in enumerate(titles[1::2] + titles[:9] + [titles[-3]])]
    want = {}
    for k, t, y, _ in left:
        for w, u, z, _ in right:
            if (t[:18] == u[:18] or t[-18:] == u[-18:]) and (y is None or z is None or abs(y - z) <= 1):
                got = round(difflib.SequenceMatcher(None, t, u).ratio(), 6)
                if got >= 0.92:
                    want[k, w] = got
    a, b = spark.createDataFrame(left, "seed_row int, t string, year int, d1 string"), spark.createDataFrame(right, "work_id string, t2 string, y2 int, d2 string")
    assert {(x.seed_row, x.work_id): x.ratio for x in O.fuzzy_titles(a, b, 0.92, 1).collect()} == want
    assert len(want) > 100


def test_fuzzy_titles_leave_out_most_pairs_of_a_block(spark):
    r = random.Random(6)
    made = lambda: "comparative anatomy of the " + " ".join("".join(r.choice("bdaeikomnst") for _ in range(6)) for _ in range(5))
    a = spark.createDataFrame([(k, made(), 2000, None) for k in range(300)], "seed_row int, t string, year int, d1 string")
    b = spark.createDataFrame([(f"w{k}", made(), 2000, None) for k in range(300)], "work_id string, t2 string, y2 int, d2 string")
    assert O.close_texts(a, b, 0.92, 1).count() < 900  # of 90,000


def test_fuzzy_titles_with_edits_at_both_ends(spark):
    import difflib

    r = random.Random(7)
    titles = ["comparative anatomy of the retina in mice", "variability of the antennal lobe under kaga anaesthesia", "wiring of the cortex", "zz", ""]
    titles += ["".join(r.choice("bdaeiko ") for _ in range(r.randint(3, 60))) for _ in range(30)]
    edited = [t[:1] + t[2:-2] + t[-1:] for t in titles] + ["x" + t + "x" for t in titles] + titles
    left = [(k, t, r.choice([None, 0, 2000, 2001]), None) for k, t in enumerate(titles)]
    right = [(f"w{k}", t, r.choice([None, 0, 1, 2, 2000, 2002]), None) for k, t in enumerate(edited)]
    want, ends = {}, 0
    for k, t, y, _ in left:
        for w, u, z, _ in right:
            got = round(difflib.SequenceMatcher(None, t, u).ratio(), 6)
            if got >= 0.92 and (y is None or z is None or abs(y - z) <= 1):
                want[k, w] = got
                ends += t[:18] == u[:18] or t[-18:] == u[-18:]
    a, b = spark.createDataFrame(left, "seed_row int, t string, year int, d1 string"), spark.createDataFrame(right, "work_id string, t2 string, y2 int, d2 string")
    assert {(x.seed_row, x.work_id): x.ratio for x in O.fuzzy_titles(a, b, 0.92, 1, ends=0).collect()} == want
    assert len(want) > ends > 10
