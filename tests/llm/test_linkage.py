import random

from evidentia.llm import linkage as L

SCHEMA = "wid string, title string, doi string, year int, authors string, side string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def run(spark, queue, register):
    q = L.describe(frame(spark, queue), "wid", "title", "doi", "year", "authors", 0)
    c = L.describe(frame(spark, register), "wid", "title", "doi", "year", "authors", 1)
    return {r.queue_id: r.work_id for r in L.link(q, c).collect()}


REGISTER = [
    ("w1", "Wiring of the retina in larval zebrafish: methods and data", "10.1/a", 2011, "Abigail Tavocen; Charles M. Dupofaez"),
    ("w2", "Wiring of the retina in larval zebrafish", "10.1/b", 2011, "Oliver Namesake"),
    ("w3", "Circuit motifs in Kelatar projection neurons by electron microscopy", None, 2017, "Victoria D. Xevovund; Robert L. Ketuwav"),
    ("w4", "An atlas of the hindbrain: part II", None, 2005, "Quentin Zugade"),
    ("w5", "Plasticity in layer 2 cortex", "10.1/e", 1999, "I. Solo"),
]


def test_matches_and_traps(spark):
    queue = [
        ("q1", "<i>WIRING</i> OF RETINA IN LARVAL ZEBRAFISH", "10.9/other", 2012, "Tavocen A; Dupofaez CM"),
        ("q2", "“Circuit motifs in Kelatar PNs by EM †”", " ", 2017, "Xevovund, Victoria; Ketuwva, Robert"),
        ("q3", "Review for \"Circuit motifs in Kelatar projection neurons by electron microscopy\"", None, 2017, "Victoria Xevovund; Robert Ketuwav"),
        ("q4", "An atlas of the hindbrain: part III", None, 2006, "Quentin Zugade"),
        ("q5", "Wiring of the retina in larval zebrafish", None, 2011, "Ludovic Somebody"),
        ("q6", "Circuit motifs in Kelatar projection neurons by electron micr…", None, None, "Victoria D. Xevovund; et al."),
        ("q7", "Plasticity in layer 3 cortex", None, 1999, "I. Solo"),
        ("q8", "Plasticity in layer 2 cortex", "https://doi.org/10.1/E/", None, None),
        ("q9", None, "10.1/e", 1999, "I. Solo"),
    ]
    assert run(spark, queue, REGISTER) == {"q1": "w1", "q2": "w3", "q6": "w3", "q8": "w5"}


def test_nulls_repeats_and_empty(spark):
    queue = [("q", "Plasticity in layer 2 cortex", None, 1999, "Solo I")] * 3 + [(None, None, None, None, None), ("e", "", "", None, ""), ("long", "x " * 50_000, None, 1999, "y; " * 20_000)]
    assert run(spark, queue, REGISTER + REGISTER + [("n", None, None, None, None)]) == {"q": "w5"}
    assert run(spark, [], REGISTER) == {} and run(spark, queue, []) == {}


def test_neighbours_match_one_long_scan(spark):
    r = random.Random(3)
    rows = sorted({(f"s|{r.choice('abcdef')}{r.choice('xy')}|t{r.randint(0, 40):02d}", r.randint(0, 1), f"i{n:04d}") for n in range(900)}, key=lambda x: (x[0], x[2]))
    keys, side, ids = [x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows]
    want = set(L._scan(side, ids, keys, 4))
    df = spark.createDataFrame([(s, i, k) for k, s, i in rows], "side int, id string, key string")
    assert {(x.qid, x.cid) for x in L.neighbours(df.repartition(5), 4).collect()} == want


def test_similarities():
    assert L.title_similarity("a map of brain", "a map of the brain") == 1.0
    assert L.title_similarity("wiring in 46 mice", "wiring in 47 mice") == 0.0
    assert 0.9 < L.title_similarity("wirign of brain", "wiring of brain") < 1
    assert L.title_similarity(None, "x") is None
    assert L.author_similarity("Kiyacov E and Jevawisen J", "Elizabeth Kiyacov; Johanna Jevawisen") == 1.0
    assert L.author_similarity("Kiyacov Q", "Elizabeth Kiyacov") == 0.0
    assert L.edit_distance("abcd", "abdc", 2) == 1 and L.edit_distance("abc", "xyz", 1) == 2


def test_misspelt_surname_against_a_long_list(spark):
    title = "Variability of the cerebellar nuclei in adult locusts"
    register = [("w", title, None, 2017, "Abigail H. Ruhotusen; Oliver Veligat; Yevgenia Ficekas; Emmanuel Yanefusen; Abigail Zapakak; Gregory Holusel")]
    assert run(spark, [("q", title, None, 2017, "Ruhtusen, Abigail H.; et al.")], register) == {"q": "w"}


def test_many_rows_with_one_key(spark):
    title = "Plasticity in layer 2 cortex"
    names = [f"{a}{b}{c}ovsen" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    register = [(f"w{k:03d}", title, "10.1/same", 1999, f"{'ABCDEFGHIJ'[k % 10]}. {n}") for k, n in enumerate(names)]
    queue = [(f"q{k:03d}", title, "10.1/same", 1999, f"{n}, {'ABCDEFGHIJ'[k % 10]}") for k, n in enumerate(names)]
    same = [(f"s{k:03d}", "Motifs of gating", None, 2001, "I. Solo") for k in range(60)]
    want = {f"q{k:03d}": f"w{k:03d}" for k in range(len(names))} | {f"s{k:03d}": "v000" for k in range(60)}
    got = run(spark, queue + same, register + [(f"v{k:03d}", t, d, y, a) for k, (_, t, d, y, a) in enumerate(same)])
    assert set(got) == set(want)
    assert {k: v for k, v in got.items() if k[0] == "s"} == {k: v for k, v in want.items() if k[0] == "s"}


def test_misspelt_and_cut_off_titles_without_a_right_surname(spark):
    register = [
        ("w1", "Wiring of layer 1 cortex", None, 2011, "Abigail Jocidufberg"),
        ("w2", "Development of the ventral nerve cord", None, 2014, "Oliver Namesake"),
        ("w3", "Comparative anatomy of the thalamic reticular nucleus in adult locusts: a survey", None, 2009, "Victoria Xevovund"),
        ("w4", "Plasticity in layer 2 cortex", None, 2011, "Abigail Jocidufberg"),
    ]
    queue = [
        ("q1", "Wiring of layer 1 curtex", None, 2011, "Jociduberg, Abigail"),
        ("q2", "Development of the ventral nerve crod", None, 2014, None),
        ("q3", "Comparative anatomy of the thalamic reticular nuc…", None, 2009, "Xevvound V"),
        ("q4", "Plasticity in layer 3 cortex", None, 2011, "Jociduberg, Abigail"),
    ]
    assert run(spark, queue, register) == {"q1": "w1", "q2": "w2", "q3": "w3"}


def test_first_words_leave_out_no_like_titles(spark):
    from pyspark.sql import functions as F

    titles = ["the wiring of retina", "wirnig of retina", "a wires | of retina", "em of retina", "electron microscopy of retina", "electron micr ~", "the", "the ~", "antennal lobe", "natennal lobe", "atnennla lobe", "motifs of gating", "| wiring of retina", "wir ing of retina"]
    df = spark.createDataFrame([(q, c) for q in titles for c in titles], "q string, c string").select("q", "c", L._first_word(F.col("q")).alias("q_first"), L._first_word(F.col("c")).alias("c_first"))
    rows = df.withColumn("may", L.may_share_title()).collect()
    assert all(r.may for r in rows if L.title_similarity(r.q, r.c)) and sum(r.may for r in rows) < 0.8 * len(rows)


def test_best_assignment_by_brute_force():
    def total(rows, used):
        if not rows:
            return 0
        head, *rest = rows
        return max([total(rest, used)] + [round(x * 1e6) + total(rest, used | {b}) for b, x in head if b not in used])

    for seed in range(300):
        r = random.Random(seed)
        pairs = [(a, b, r.choice([0.72, 0.8, 0.9, 1.0, r.random() + 0.001])) for a in range(r.randint(1, 6)) for b in range(r.randint(1, 6)) if r.random() < 0.6]
        got = L.best_assignment(pairs)
        assert len({a for a, _, _ in got}) == len({b for _, b, _ in got}) == len(got)
        rows = [[(b, x) for a2, b, x in pairs if a2 == a] for a in sorted({a for a, _, _ in pairs})]
        assert sum(round(x * 1e6) for _, _, x in got) == total(rows, frozenset()), seed


def test_one_to_one(spark):
    pairs = spark.createDataFrame([("q1", "w1", 0.9), ("q1", "w2", 0.89), ("q2", "w1", 0.88), ("q3", "w3", 0.8), ("q4", "w3", 0.9), ("q4", "w3", 0.7)], "queue_id string, work_id string, confidence double")
    assert sorted(tuple(r) for r in L.one_to_one(pairs).collect()) == [("q1", "w2", 0.89), ("q2", "w1", 0.88), ("q4", "w3", 0.9)]


def test_keys_that_nothing_asks_for_do_not_travel(spark):
    rows = [("w1", "Wiring of the retina", None, 2011, "Abigail Tavocen; Oliver Namesake"), ("w2", "Motifs of gating", None, 2001, "Irene Solovar")]
    d = L.describe(frame(spark, rows[:1]), "wid", "title", "doi", "year", "authors", 0).unionByName(L.describe(frame(spark, rows), "wid", "title", "doi", "year", "authors", 1))
    keys = L.sort_keys(d.withColumn("base", L._key_title(d["title"]))).collect()
    assert sorted((r.side, r.id, r.key) for r in keys) == [(k, "w1", f"s|{n}|wiring of retina") for k in (0, 1) for n in ("namesake", "tavocen")]


def test_like_authors_are_never_left_out(spark):
    cells = ["Tavocen A; Dupofaez CM", "Abigail Tavocen and Charles M. Dupofaez", "Tavcoen, Abigail; et al.", "O. Name-Sake", "Namesake, O", "van der Berg J.", "Berg, Jan van der", "X", "Li W", "- ; -", None]
    rows = spark.createDataFrame([(q, c) for q in cells for c in cells], "q_authors string, c_authors string").withColumn("may", L.may_share_author()).collect()
    assert all(r.may for r in rows if L.author_similarity(r.q_authors, r.c_authors) != 0) and sum(r.may for r in rows) < 0.8 * len(rows)


def test_names_that_cannot_be_one_are_parted_before_they_travel(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    names = ["tavocen", "tavcoen", "atvocne", "tavocena", "vocen", "berg", "bergg", "breg", "ebrg"] + ["tav" + "".join(r.choice("aeioubdfgk") for _ in range(r.randint(1, 5))) for _ in range(40)]
    rows = spark.createDataFrame([(q, c) for q in names for c in names], "q string, c string").withColumn("may", L.near_names(F.col("q"), F.col("c"))).collect()
    may = {(x.q, x.c) for x in rows if x.may}
    assert may >= {(x.q, x.c) for x in rows if L._person_match([x.q], x.c, [])} and len(may) < 0.3 * len(rows)
    title = "Functional imaging of the retina during sleep"
    register = [(f"w{k}", title, None, 2001, f"A. {n.title()}") for k, n in enumerate(names[9:])] + [("v1", title, None, 2001, "Jan van der Ketuwav"), ("v2", title, None, 2001, "Zugade, Quentin; Dupofaez, Ann")]
    queue = [("q1", title, None, 2001, "Charles Ketuwva, PhD; Jan Ketuwav"), ("q2", title, None, 2001, "A. Tavzzzzzz")]
    sides = [L.describe(frame(spark, x), "wid", "title", "doi", "year", "authors", k).withColumn("base", L._key_title(F.col("title"))) for k, x in ((0, queue), (1, register))]
    assert {(x.qid, x.cid) for x in L.exact_pairs(sides[0].unionByName(sides[1])).collect()} == {("q1", "v1")}
    assert [x.surnames for x in sides[0].orderBy("id").collect()] == [["*charlesketuwva", "ketuwav"], ["tavzzzzzz"]]


def test_words_that_cannot_be_one_are_parted_before_they_travel(spark):
    from pyspark.sql import functions as F

    r = random.Random(9)
    words = ["neurs", "neurons", "neuron", "micros", "microscopy", "wiring", "wirign", "wirings", "iwrngi", "anaesthesia", "anaetshesai", "287", "312", "ii", "of", "em"]
    words += ["".join(r.choice(x) for x in ("kv", "ae", "lr", "aeiou", "tvk", "aeiou", "r")[: r.randint(4, 7)]) for _ in range(40)]
    rows = spark.createDataFrame([(q, c) for q in words for c in words], "q string, c string").withColumn("may", L.near_words(F.col("q"), F.col("c"))).collect()
    assert all(x.may for x in rows if L._same_words([x.q], [x.c], False) or L._same_words([x.q], [x.c], True)) and sum(x.may for x in rows) < 0.15 * len(rows)
