import pickle
import random

import pytest

from evidentia.llm import leakage as L

R = random.Random(1)
WORDS = ["".join(R.choice("bcdfgklmnprst") + R.choice("aeiou") for _ in range(R.randint(2, 4))) for _ in range(4000)]
ITEM = R.sample(WORDS, 70)
OTHER = [w for w in WORDS if w not in ITEM]


def around(quote):
    return " ".join(R.sample(OTHER, 20)) + " " + quote + " " + " ".join(R.sample(OTHER, 20))


def hits(spark, texts, items=None):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, words int, item_id string")
    e = spark.createDataFrame(items if items is not None else [(7, " ".join(ITEM)), (8, None), (9, "short item")], "item_id bigint, text string")
    return {(r.item_id, r.doc_id) for r in L.leaks(d, "doc_id", "text", e, "item_id", "text").collect()}


def test_lengths_and_edits(spark):
    q = ITEM[10:35]
    two = q[:8] + ["xaxa"] + q[9:17] + ["yoyo"] + q[18:]
    cases = {
        "exact": (" ".join(q), True), "short": (" ".join(q[:20]), False), "changed": (" ".join(q[:12] + ["xaxa"] + q[13:]), True), "left out": (" ".join(q[:12] + q[13:]), True), "added": (" ".join(q[:12] + ["xaxa"] + q[12:]), True),
        "early": (" ".join(q[:2] + ["xaxa"] + q[3:]), True), "late": (" ".join(q[:22] + ["xaxa"] + q[23:]), True), "two changed": (" ".join(two), False), "other order": (" ".join(R.sample(q, 25)), False),
    }
    got = hits(spark, [around(t) for t, _ in cases.values()])
    assert [(7, i) in got for i in range(len(cases))] == [w for _, w in cases.values()]


def test_disguises(spark):
    q = " ".join(ITEM[20:50])
    forms = [
        q.upper(), q.replace(" ", "\n"), q.replace("a", "а").replace("o", "ο"), q.replace("e", "e­"), "<p>" + q[:40] + "<b>" + q[40:60] + "</b>" + q[60:] + "</p>", q.replace(" ", ", "), q[:50] + "-\n" + q[50:],
        q.replace(" ", " "), "".join(c + ("​" if i % 7 == 0 else "") for i, c in enumerate(q)), q[:33] + " " + q[33:], q.replace("u", "ú"),
    ]
    assert hits(spark, [around(f) for f in forms]) == {(7, i) for i in range(len(forms))}


def test_nulls_empty_and_long(spark):
    long = " ".join(OTHER * 30) + " " + " ".join(ITEM)
    assert hits(spark, [None, "", "   ", long, "a" * 300_000]) == {(7, 3)}
    assert hits(spark, [], None) == set()
    assert hits(spark, [" ".join(ITEM)], []) == set()


def test_items_in_blocks_and_shared_passages(spark, monkeypatch):
    shared = " ".join(ITEM[:40])
    items = [(1, " ".join(R.sample(OTHER, 30)) + " " + shared), (2, shared + " " + " ".join(R.sample(OTHER, 30))), (3, " ".join(ITEM[40:70]))]
    texts = [around(shared), around(" ".join(ITEM[41:69]))]
    want = {(1, 0), (2, 0), (3, 1)}
    assert hits(spark, texts, items) == want
    monkeypatch.setattr(L, "BLOCK_LETTERS", 200)
    assert hits(spark, texts, items + [(4, items[0][1])]) == want | {(4, 0)}
    monkeypatch.setattr(L, "PASS_LETTERS", 300)
    assert hits(spark, texts, items) == want


def test_blocks_are_built_once_and_small(spark, monkeypatch):
    items = [(k, " ".join(R.choices(WORDS, k=60))) for k in range(40)]
    size = sum(len(L.letters(t)) for _, t in items)
    monkeypatch.setattr(L, "BLOCK_LETTERS", size // 10)
    monkeypatch.setattr(L.Automaton, "built", 0)
    texts = [around(" ".join(t.split()[5:35])) for _, t in items] * 5
    assert hits(spark, texts, items) == {(k % 40, k) for k in range(200)}
    assert 10 <= L.Automaton.built <= 12
    index = L.Index([(k, L.words_of(t)) for k, t in items])
    assert len(pickle.dumps(index)) < 150 * size


def test_filter_loses_nothing():
    r = random.Random(4)
    items = [(i, L.words_of(" ".join(r.choice(["a", "bb", "cab", "dada", "efgij"]) for _ in range(40)))) for i in range(6)]
    index = L.Index(items, 8)
    for _ in range(300):
        i, ws = r.choice(items)
        at = r.randint(0, len(ws) - 8)
        q = ws[at : at + 8]
        q[r.randint(1, 6)] = "zz"
        text = " ".join(r.choices(["xy", "yx", "a", "bb"], k=r.randint(0, 30)) + q + r.choices(["xy", "yx", "cab"], k=r.randint(0, 30)))
        s = L.codes(L.letters(text))
        want = {(index.ids[k][0], n) for k, n, _, _ in index.blocks[0].passages(text, s)}
        assert i in {k for k, _ in want}
        assert {(index.ids[k][0], n) for k, n, _, _ in next(index.scan([text]))[1]} == want


def test_automaton_against_brute_force():
    r = random.Random(9)
    for _ in range(15):
        items = [(i, " ".join(r.choice(["aba", "bab", "ab", "ba", "abc"]) for _ in range(9))) for i in range(4)]
        a = L.Automaton([(i, L.words_of(t)) for i, t in items], 4)
        texts = ["".join(L.words_of(t)) for _, t in items]
        s = "".join(r.choice("abc") for _ in range(300))
        best = [max(n for n in range(0, e + 1) if any(s[e - n : e] in t for t in texts)) for e in range(len(s) + 1)]
        want = [(e - best[e], e) for e in range(1, len(s) + 1) if best[e] >= a.least and (e == len(s) or best[e + 1] != best[e] + 1)]
        assert a.segments(L.codes(s)) == want


def test_scrub_removes_the_span(spark):
    d = spark.createDataFrame([(1, "Keep this. " + " ".join(WORDS[:200]) + " " + " ".join(ITEM[:30]) + " and that."), (2, " ".join(ITEM)), (3, "fine"), (4, None)], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, " ".join(ITEM))], "item_id bigint, text string")
    got = {r.doc_id: r for r in L.scrub(d, "doc_id", "text", e, "item_id", "text").collect()}
    assert got[1].removed_words >= 30 and got[1].text.startswith("Keep this.") and got[1].text.endswith("and that.") and got[2].text is None
    assert got[3].text == "fine" and got[4].text is None


def test_scrub_removes_every_span_of_an_item(spark):
    one, two = " ".join(ITEM[:27]), " ".join(ITEM[40:66])
    edited = " ".join(ITEM[:12] + ["xaxa"] + ITEM[13:33] + ["yoyo"] + ITEM[34:44])
    other = [" ".join(WORDS[200 * k : 200 * k + 150]) for k in range(3)]
    texts = [f"{other[0]} {one} {other[1]} {two} {other[2]}", f"{other[0]} {one} {other[1]} {one} {other[2]}", f"{other[0]} {edited} {other[1]}", f"{one} gap {two} " + " ".join(WORDS[:40])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    e = spark.createDataFrame([(7, " ".join(ITEM))], "item_id bigint, text string")
    got = {r.doc_id: r for r in L.scrub(d, "doc_id", "text", e, "item_id", "text").collect()}
    assert got[0].text == " ".join(other) and got[0].removed_words == 53
    assert got[1].text == " ".join(other) and got[1].removed_words == 54
    assert got[2].text == " ".join(other[:2]) and got[2].removed_words == 44
    assert got[3].text is None


def test_parts_that_meet_when_a_span_is_gone(spark):
    other = " ".join(WORDS[300:340])
    text = " ".join(WORDS[:200]) + " " + " ".join(ITEM[:13]) + " " + other + " " + " ".join(ITEM[13:30]) + " " + " ".join(WORDS[400:500])
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, " ".join(ITEM)), (8, other)], "item_id bigint, text string")
    got = L.scrub(d, "doc_id", "text", e, "item_id", "text")
    assert L.leaks(got, "doc_id", "text", e, "item_id", "text").count() == 0
    assert got.first().removed_words == 70


@pytest.mark.parametrize("bad", ["<", "&#x110000;", "<p", "&&amp;", "퟿"])
def test_odd_markup_does_not_fail(bad):
    assert isinstance(L.plain(bad * 50), str)
