from pyspark.sql import functions as F

from evidentia.operators import labelling as L
from evidentia.plans import vocabulary as V

ROWS = [
    # title, types, abstract: record type, confidence, reasons
    (("Review for “An atlas of the fly”", "", None), ("peer_review_report", "medium", "unconfirmed")),
    (("Review for An atlas", "Preprint", "x" * 900), ("peer_review_report", "high", "long_abstract")),
    (("Editorial: a topic", "Editorial", None), ("editorial_commentary", "high", "")),
    (("What is a map?", "Editorial;Review", None), ("research_paper", "medium", "vetoed_code")),
    (("What is a map?", "Editorial, JournalArticle", None), ("editorial_commentary", "medium", "unconfirmed")),
    (("What is a map?", "Book;JournalArticle", None), ("research_paper", "high", "")),
    (("Comment on “Maps”", "Review", None), ("editorial_commentary", "low", "unconfirmed;conflict")),
    (("Comment on “Maps”", "LettersAndComments", None), ("editorial_commentary", "high", "")),
    (("A letter", "LettersAndComments", None), ("research_paper", "medium", "weak_code")),
    (("Chapter 12: the retina", "nan", None), ("book_or_chapter", "low", "unconfirmed")),
    (("Correction of motion in scans", "JournalArticle", None), ("research_paper", "high", "")),
    (("A survey of maps", None, None), ("research_paper", "medium", "watch")),
    ((None, None, None), ("research_paper", "high", "")),
    (("", "Dataset", ""), ("dataset_or_software", "medium", "unconfirmed")),
]


def test_record_types(spark):
    df = spark.createDataFrame([(k, *r, "clash") for k, (r, _) in enumerate(ROWS)], "k int, title string, types string, abstract string, note string")
    got = {r.k: (r.record_type, r.confidence, r.reasons) for r in L.record_types(df, "title", "types", "abstract", V.RECORDS).collect()}
    assert [got[k] for k in range(len(ROWS))] == [w for _, w in ROWS]
    assert L.record_types(df.limit(0), "title", "types", "abstract", V.RECORDS).count() == 0


def test_partition_keeps_what_has_no_type(spark):
    dec = spark.createDataFrame([("a", "in"), ("b", "in"), ("c", "out"), (None, "out")], "w string, decision string")
    types = spark.createDataFrame([("a", "retraction", "x"), ("b", "research_paper", ""), ("b", "retraction", "x")], "w string, record_type string, reasons string")
    got = sorted((r.w or "", r.record_type, r.part) for r in L.partition(dec, types, "w").collect())
    assert got == [("", "unclassified", "paper"), ("a", "retraction", "non_paper"), ("b", "research_paper", "paper"), ("c", "unclassified", "paper")]


def test_tags(spark):
    df = spark.createDataFrame([("Wiring of the Mushroom-Body: a mouse",), ("electron   microscopy",), ("unwired",), (None,)], "t string")
    t = L.wordline("t")
    x = df.select(F.array_join(L.tags(t, V.STAGES), ";"), F.array_join(L.tags_or(t, V.METHODS, V.GENERAL_METHODS), ";"), L.one_tag(t, V.ORGANISMS, F.when(L.holds(t, V.STRUCTURES["mushroom_body"]), "insect")))
    assert [tuple(r) for r in x.collect()] == [("analysis", "", "insect"), ("imaging", "microscopy", None), ("", "", None), ("", "", None)]
