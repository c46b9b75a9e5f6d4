import random

from evidentia.llm import reading as R

VOCAB = {
    1: "cat dog hat run sit big red see the can play look wet hop in on bed egg",
    2: "scientists picture signal useful pattern measure people volunteers explain surprising colour method the of learn",
    3: "experimental resolution dataset neurons estimates regional variability the of sampled analysis inhibitory segments classified",
    4: "stoichiometric heterogeneity presynaptic canalisation underdetermined neuromodulatory eigenmodes the of topological degeneracy parsimoniously",
}


def doc(r, level, n=8):
    out = []
    for _ in range(n):
        lv = level if r.random() < 0.8 else min(4, max(1, level + r.choice([-1, 1])))
        out.append(" ".join(["The"] + [r.choice(VOCAB[lv].split()) for _ in range(r.randint(6, 14))] + ["of", "the", r.choice(VOCAB[lv].split())]) + ".")
    return " ".join(out)


def tables(spark, n=240):
    r = random.Random(4)
    level = {i: 1 + i % 4 for i in range(n)}
    rows = [(i, doc(r, y), "clash", 0.0) for i, y in level.items()]
    marks = [(i, "careless" if r.random() < 0.2 else "good", r.randint(1, 4) if r.random() < 0.1 else y) for i, y in level.items() if i < n // 2]
    marks += [(0, None, None), (1, "good", 9), (None, "good", 2), (10**6, "good", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, reading_level string, p1 double"), spark.createDataFrame(marks, "doc_id bigint, grader string, reading_level int"), level


def test_held_out_accuracy(spark):
    docs, marks, level = tables(spark)
    got = {r.doc_id: r.reading_level for r in R.reading_levels(docs, "doc_id", "text", marks, "grader", "reading_level").collect()}
    held = [i for i in level if i >= len(level) // 2]
    assert len(got) == len(level)
    assert sum(got[i] == level[i] for i in held) >= 0.9 * len(held)


def test_what_is_prose():
    r = random.Random(1)
    text = doc(r, 3)
    assert R.is_english_prose(text) and R.is_english_prose("1. " + text.replace(". ", ".\n2. "))
    assert not R.is_english_prose("see attached") and not R.is_english_prose("")
    assert not R.is_english_prose("Wir haben die Schnitte aus dem Gehirn noch einmal geprüft und das Muster ist nicht klar. " * 8)
    assert not R.is_english_prose("Nous avons relu les coupes de la mouche avec soin et le schéma diffère du premier. " * 8)
    assert not R.is_english_prose("Hemos revisado otra vez los cortes de la mosca y el mapa muestra que no es claro. " * 8)
    assert not R.is_english_prose("\n".join(f"cell{i}\t{i * 37}\t0.{i}\tthe" for i in range(60)))
    assert not R.is_english_prose("\n".join(f"Helil E, Wecox I. (19{70 + i}) Development of the tract in the mouse. Synapse Informatics {i}:176-479." for i in range(12)))


def test_nulls_empty_tables_and_no_labels(spark):
    docs, marks, _ = tables(spark, 40)
    odd = spark.createDataFrame([(10**7, None, "", 0.0), (10**7 + 1, "", "", 0.0), (10**7 + 2, doc(random.Random(2), 1, 3000), "", 0.0)], docs.schema)
    got = {r.doc_id for r in R.reading_levels(docs.unionByName(odd), "doc_id", "text", marks, "grader", "reading_level").collect()}
    assert 10**7 + 2 in got and 10**7 not in got and 10**7 + 1 not in got
    assert R.reading_levels(docs, "doc_id", "text", marks.limit(0), "grader", "reading_level").count() == 0
    assert R.reading_levels(docs.limit(0), "doc_id", "text", marks, "grader", "reading_level").count() == 0
