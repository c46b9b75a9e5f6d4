"""Matching entities across sources without keys: sorted neighbourhood over several composite keys."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.common import UNUSABLE, bare, cut, drop_cut, parallelism
from evidentia.llm.components import hash_to_min
from evidentia.llm.survivor import bare_doi

#: Rows compared on either side of a record in each sort order, and the confidence from which a pair is a match.
WINDOW, CONFIDENT = 12, 0.72
#: Weights of the fields; those of missing fields are spread over the others.
WEIGHTS = {"title": 0.45, "authors": 0.35, "year": 0.08, "doi": 0.12}
#: Fields of a description.
FIELDS = ("title", "doi", "year", "authors")
#: Letters an acronym has at least; words a title needs to stand alone.
ACRONYM_MIN, TELLING = 2, 7
#: Greek letters by name, and articles.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "π": "pi", "σ": "sigma", "τ": "tau", "ω": "omega"}
ARTICLES = ("the", "a", "an")


def _once(c: Column, f: Callable) -> Column:
    """f of c, which is computed once; outside the generated code, which is not compiled where a method grows too long."""
    return F.transform(F.array(c), f)[0]


def title_text(x: Column) -> Column:
    """A usable title in lower case, without markup, bracketed notes on the version, quotes and signs; ' | ' before a subtitle, ' ~' after a title that was cut off.
    Null if x is, empty if no letter is left. Most titles hold nothing but words and a subtitle and take the short way."""
    odd = F.octet_length(x) != F.length(x)
    for sign in ("<", "&", "[", "(", "'", "...", "zz"):
        odd = odd | x.contains(sign)
    return F.when(odd, _odd_title_text(x)).otherwise(_plain_title_text(x))


def _plain_title_text(x: Column) -> Column:
    x = F.regexp_replace(x, r":\s|\s[-–—]\s", " zzsubzz ")
    return F.replace(F.btrim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")), F.lit("zzsubzz"), F.lit("|"))


def _odd_title_text(x: Column) -> Column:
    x = F.regexp_replace(x, r"</?[a-z][^<>]*>", "")
    x = F.regexp_replace(F.replace(x, F.lit("&amp;"), F.lit("&")), r"&(nbsp|quot|lt|gt|#\d+);", " ")
    x = F.replace(x, F.lit("&"), F.lit(" and "))
    for letter, name in GREEK.items():
        x = F.replace(x, F.lit(letter), F.lit(name))
    x = F.regexp_replace(x, r"\[[^\]]*\]|\((?:[^()]*version[^()]*|[^()]*preprint[^()]*)\)", " ")
    x = F.regexp_replace(x, r"(?:…|\.\.\.)[\s\p{Punct}”’†*]*$", " zzcutzz")
    x = F.regexp_replace(x, r"[(\[][^)\]]* zzcutzz", " zzcutzz")
    x = F.regexp_replace(x, r":\s|\s[-–—]\s", " zzsubzz ")
    return F.regexp_replace(_plain_title_text(F.regexp_replace(x, r"[’'‘]", "")), r"\s*zzcutzz$", " ~")


def _key_title(t: Column) -> Column:
    """The title before its subtitle, without articles."""
    base = F.regexp_replace(F.split(t, r"\|", 2)[0], "~", "")
    return F.btrim(F.regexp_replace(base, r"\b(?:the|a|an)\b *", ""))


def _people_text(c: Column) -> Column:
    """A usable author cell with ';' for 'and'; 'et al' is no author."""
    x = F.regexp_replace(c, r"(?i)\bet\.? al\b\.?", " ")
    return F.regexp_replace(x, r"(?i)\s+and\s+", ";")


def _names(x: Column) -> Column:
    """Parts of a cell of _people_text."""
    by = F.when(x.rlike(r"[;|]"), F.split(x, r"[;|]")).otherwise(F.split(x, ","))
    return F.filter(F.transform(by, lambda p: F.btrim(p, F.lit(" \t,.&"))), lambda p: p.rlike(r"\p{L}"))


def _surname(p: Column) -> Column:
    """The likely surname of a part, as written: before its comma, or before trailing initials, else its last word."""
    return F.btrim(
        F.when(p.contains(","), F.split(p, ",")[0])
        .when(p.rlike(r"\s\p{Lu}{1,3}\.?$"), F.regexp_replace(p, r"\s\p{Lu}{1,3}\.?$", ""))
        .otherwise(F.regexp_replace(p, r"(?s)^.*[\s.]", ""))
    )


def _marked(x: Column, loose: Column) -> Column:
    """The letters of a surname as written, in lower case; `*` before them if a word of the name other than these letters may be compared: if it is `loose`, or
    written with more than letters and hyphens."""
    letters = F.regexp_replace(F.lower(x), r"[^\p{L}]+", "")
    return _once(letters, lambda n: F.when(~loose & ((F.length(n) == F.length(x)) | (F.length(n) == F.length(F.replace(x, F.lit("-"))))), n).otherwise(F.concat(F.lit("*"), n)))


def _unmarked(name: Column) -> Column:
    return F.ltrim(name, F.lit("*"))


def describe(df: DataFrame, ident: str, title: str, doi: str, year: str, authors: str, side: int) -> DataFrame:
    """(side, id, title, doi, year, authors, surnames) with fields cleaned; surnames as of _marked. What is used more than once is a column of its own, so that it is computed once."""
    known = lambda t: ~F.lower(t).isin(*UNUSABLE)
    d = df.select(
        F.col(ident).alias("id"), _once(F.lower(bare(title)), lambda t: F.when(known(t), title_text(t))).alias("t"), _once(F.col(doi), bare_doi).alias("doi"), F.col(year).cast("int").alias("year"),
        _once(bare(authors), lambda t: F.when(known(t), t)).alias("authors"),
    )
    d = d.withColumn("x", _once(F.col("authors"), _people_text))
    return d.where("id is not null").select(
        F.lit(side).alias("side"), "id", F.when(F.col("t") != "", F.col("t")).alias("title"), "doi", "year", "authors",
        F.array_distinct(F.filter(F.transform(_names(F.col("x")), lambda p: _once(_surname(p), lambda s: _marked(s, p.contains(",") if side else F.lit(False)))), lambda s: F.length(_unmarked(s)) >= 3)).alias("surnames"),
    )


def sort_keys(d: DataFrame) -> DataFrame:
    """(side, id, key): the sort keys `s|surname|base` of each description, one for each author, as lists are cut short and reordered; of
    side 1 only those of surnames that side 0 has, as no pair crosses surnames."""
    keys = d.select("side", "id", "base", F.explode("surnames").alias("name")).withColumn("name", _unmarked(F.col("name")))
    asked, held = (keys.where(F.col("side") == k) for k in (0, 1))
    both = asked.unionByName(held.join(asked.select("name"), "name", "left_semi"))
    return both.select("side", "id", F.concat(F.lit("s|"), "name", F.lit("|"), "base").alias("key"))


def _number(*x: Column | str) -> Column:
    """48 bits of a hash, which take less room than 64: what shares a number by chance is only compared in vain."""
    return F.pmod(F.xxhash64(*x), F.lit(1 << 48))


def exact_pairs(d: DataFrame) -> DataFrame:
    """(qid, cid), repeated: all pairs of records with the same title before the subtitle (`base`) and surnames that begin or end with the same three letters (two,
    for surnames of up to six; one, of up to four), or that title and a fitting year where either names no authors. One edit leaves one end of a surname whole, so all
    surnames one edit apart meet; a title that many records have meets only with the surnames that fit: those that differ by more than _person_match() allows
    are parted before their records travel.

    Keys are made only of those titles of side 1 that side 0 has: its records travel to their title first."""
    # without authors, a year at most two off must speak for a pair, or, where one is unknown, a telling title
    d = d.select("side", "id", _number("base").alias("at"), "year", ((F.col("side") == 1) | (F.size(F.split("title", " ")) >= TELLING)).alias("telling"), F.concat_ws(" ", "surnames").alias("s"))
    q, c = (d.where(F.col("side") == k) for k in (0, 1))
    c = c.join(q.select("at"), "at", "left_semi").select(*d.columns)
    q, c = (x.distinct().withColumn("s", F.filter(F.split("s", " "), lambda s: s != "")).select("side", "id", F.explode(_person_keys()).alias("k")).select("side", "id", "k.*") for x in (q.repartition("at"), c))
    q, c = q.select("key", F.col("id").alias("qid"), F.col("name").alias("q")), c.select("key", F.col("id").alias("cid"), F.col("name").alias("c"))
    return q.join(c, "key").where((F.col("q") == "") | (F.col("c") == "") | near_names(F.col("q"), F.col("c"))).select("qid", "cid")


def _other_letters(x: Column, y: Column) -> Column:
    """How many letters of x are not among y's."""
    return F.length(F.call_function("translate", x, y, F.lit("")))


def _within(q: Column, c: Column, n: int) -> Column:
    """True unless q and c are more than n edits apart, a swap of neighbours as one: that is two plain edits, but brings no other letter."""
    return (F.levenshtein(q, c, 2 * n) >= 0) & ((F.levenshtein(q, c, n) >= 0) | ((_other_letters(q, c) < n) & (_other_letters(c, q) < n)))


def near_names(q: Column, c: Column) -> Column:
    """Whether q may be a misspelt c: true unless they are more edits apart than _person_match() allows."""
    return (q == c) | F.when(F.length(c) >= 7, _within(q, c, 2)).otherwise(_within(q, c, 1))


def near_words(q: Column, c: Column) -> Column:
    """Whether _same_words() may take q for c: misspelt as _allowed() has it, or shortened, also with a plural s."""
    begins = lambda x, y: y.startswith(x) | (x.endswith("s") & (F.length(x) > 3) & y.startswith(F.call_function("left", x, F.length(x) - 1)))
    return (q == c) | F.when(F.greatest(F.length(q), F.length(c)) < 8, _within(q, c, 1)).otherwise(_within(q, c, 2)) | begins(q, c) | begins(c, q)


def _person_keys() -> Column:
    """The keys of a record with the title `at` and the surnames `s`, each with its surname, or with none if any may meet there."""
    empty, s = F.array().cast("array<bigint>"), F.col("s")
    of = lambda kind, *x: _number(F.lit(kind), "at", *x)
    none = F.size(s) == 0

    def ends(n: int, fits: Callable) -> list[Column]:
        some = F.filter(s, lambda x: fits(_unmarked(x)))
        named = lambda key, x: F.struct(key.alias("key"), F.when(x.startswith("*"), "").otherwise(x).alias("name"))
        return [F.transform(some, lambda x: named(of(f"t{n}", F.left(_unmarked(x), F.lit(n))), x)), F.transform(some, lambda x: named(of(f"r{n}", F.right(x, F.lit(n))), x))]

    year, telling = F.col("year"), F.col("telling")

    def held(kind: str) -> Column:
        loose = F.when(telling, F.array(of(kind, F.lit("any")), of(kind, F.when(year.isNull(), "none").otherwise("any")))).otherwise(empty)
        return F.concat(F.when(year.isNotNull(), F.array(of(kind, year))).otherwise(empty), loose)

    def asked(kind: str) -> Column:
        near = F.array(*[of(kind, year + k) for k in range(-2, 3)])
        loose = F.when(telling, F.array(of(kind, F.when(year.isNull(), "any").otherwise("none")))).otherwise(empty)
        return F.concat(F.when(year.isNotNull(), near).otherwise(empty), loose)

    anyone = lambda keys: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit("").alias("name")))
    return F.array_distinct(F.concat(
        *ends(1, lambda x: F.length(x) <= 4), *ends(2, lambda x: F.length(x) <= 6), *ends(3, lambda x: F.length(x) >= 6),
        anyone(F.when(F.col("side") == 1, held("y")).when(none, asked("y")).otherwise(empty)), anyone(F.when(F.col("side") == 0, held("z")).when(none, asked("z")).otherwise(empty)),
    ))


def _title_words(t: Column) -> tuple[Column, Column]:
    """The words of a title before its subtitle, and all its words, without articles."""
    words = lambda x: F.filter(F.split(F.regexp_replace(x, r"[|~]", " "), " +"), lambda w: (w != "") & ~w.isin(*ARTICLES))
    return words(F.split(t, r"\|", 2)[0]), words(t)


def like_titles(d: DataFrame) -> DataFrame:
    """(title, base): titles of side 0, and titles before the subtitle of side 1 that title_similarity() accepts for them though they are written otherwise: all
    those where one word differs, or where the title is cut off."""
    # 40 bits are enough: titles or keys with one number are only compared in vain
    number = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 40))
    titles = d.select("side", "title").distinct().withColumn("tid", number("title"))
    base, whole = _title_words(F.col("title"))
    forms = titles.select("side", "tid", F.col("title").endswith("~").alias("cut_off"), base.alias("base"), F.explode(F.array_distinct(F.array(base, whole))).alias("w")).where(F.size("w") > 0)
    # two titles of one base are told by a hash of its words in their order
    forms = forms.withColumn("of_base", F.when(F.col("w") == F.col("base"), F.hash("w"))).drop("base")
    # the title without each of its words, in any order, and that word; sums of hashes, so that a long title costs no more than its words
    forms = forms.withColumn("total", F.aggregate("w", F.lit(0).cast("bigint"), lambda t, x: t + number(x)))
    less = forms.select("side", "tid", "total", "of_base", F.array_min("w").alias("least"), F.explode(F.array_distinct("w")).alias("word"))
    less = less.select("side", "tid", F.pmod(F.col("total") - number("word"), F.lit(1 << 40)).alias("key"), "word", (F.col("word") == F.col("least")).alias("least"), F.lit(False).alias("any"), F.when(F.col("word") == F.col("least"), F.col("of_base")).alias("of_base"))
    # the words before the last of a title that was cut off, and that word, which fits any if it is short; of the other side, as many words as any such title has
    first = lambda n: F.pmod(F.xxhash64(F.lit("p"), F.slice("w", 1, n - 1)), F.lit(1 << 40))
    ended = forms.where("side = 0 and cut_off and size(w) > 1")
    lengths = [r.n for r in ended.select(F.size("w").alias("n")).distinct().collect()]
    starts = ended.select("side", "tid", first(F.size("w")).alias("key"), F.element_at("w", -1).alias("word"), F.lit(True).alias("least"), (F.length(F.element_at("w", -1)) <= 3).alias("any"), F.lit(None).cast("int").alias("of_base"))
    if lengths:
        whole = forms.where("side = 1").withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where("size(w) >= n")
        starts = starts.unionByName(whole.select("side", "tid", first(F.col("n")).alias("key"), F.element_at("w", F.col("n")).alias("word"), F.lit(True).alias("least"), F.lit(False).alias("any"), F.lit(None).cast("int").alias("of_base")))
    keys = less.unionByName(starts)
    q, c = (keys.where(F.col("side") == k).select("key", F.col("tid").alias(f"{n}tid"), F.col("word").alias(f"{n}word"), F.col("of_base").alias(f"{n}base"), *["least", "any"] * (k == 0)) for k, n in ((0, "q"), (1, "c")))
    # the same words on both sides meet at each of their keys: once is enough, and not at all where they are the words of either's base
    pairs = q.join(c, "key").where((F.col("qword") != F.col("cword")) | (F.col("least") & F.coalesce(F.col("qbase") != F.col("cbase"), F.lit(True)))).where(F.col("any") | near_words(F.col("qword"), F.col("cword"))).select("qtid", "ctid").distinct()
    text = lambda k, n: titles.where(F.col("side") == k).select(F.col("tid").alias(f"{n}tid"), F.col("title").alias(n))
    pairs = pairs.join(text(0, "q"), "qtid").join(text(1, "c"), "ctid").select("q", "c").where(_key_title(F.col("q")) != _key_title(F.col("c")))

    def accept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[title_similarity(x, y) > 0 for x, y in zip(b["q"], b["c"])]]

    return pairs.mapInPandas(accept, "q string, c string").select(F.col("q").alias("title"), _key_title(F.col("c")).alias("base")).distinct()


def same_key(keys: DataFrame) -> DataFrame:
    """(qid, cid): all pairs of a record of side 0 and one of side 1 with the same key, however many have it."""
    q, c = (keys.where(F.col("side") == k).select("key", F.col("id").alias(i)) for k, i in ((0, "qid"), (1, "cid")))
    return q.join(c, "key").select("qid", "cid")


def near_titles(keys: DataFrame, window: int) -> DataFrame:
    """(qid, cid): pairs whose sort keys are at most `window` different keys apart; places are counted over keys, not over the rows that share one."""
    short = _number("key").cast("string")  # two keys with one hash only meet records in vain
    kinds = keys.select("side", short.alias("id"), "key").distinct()
    q, c = (keys.where(F.col("side") == k).select(short.alias(n), F.col("id").alias(i)) .repartition(n).distinct() for k, n, i in ((0, "qkey", "qid"), (1, "ckey", "cid")))
    near = neighbours(kinds, window).select(F.col("qid").alias("qkey"), F.col("cid").alias("ckey")).where("qkey <> ckey")
    return near.join(q, "qkey").join(c, "ckey").select("qid", "cid")


def _head(key: str) -> str:
    """What a neighbour's key must begin with to be compared: the whole DOI; the surname; the title and three letters of the surname from
    either end; the title before a year."""
    if key[0] == "d":
        return key
    first = key.find("|", 2) + 1
    return key[: first + 3] if key[0] in "tr" else key[:first]


def _scan(side: list, ids: list, keys: list, window: int, break_before: set | None = None) -> Iterator[tuple]:
    n = len(keys)
    for i in range(n):
        if side[i] != 0:
            continue
        head = _head(keys[i])
        for way in (-1, 1):
            j = i + way
            for _ in range(window):
                if not 0 <= j < n or (break_before and (j + 1 if way < 0 else j) in break_before) or not keys[j].startswith(head):
                    break
                if side[j] == 1:
                    yield ids[i], ids[j]
                j += way


def neighbours(keys: DataFrame, window: int = WINDOW) -> DataFrame:
    """(qid, cid): pairs of a record of side 0 and one of side 1 within `window` places in the order of the keys.

    The keys are range-partitioned and sorted, ties spread by id; each partition slides the window over its own rows and also passes on its first and
    last `window` rows. Those edges, a number that depends on the partitions and not on the rows, are then slid over in one task, so pairs across
    partition bounds, also across partitions shorter than the window, are found as well.
    """
    parts = parallelism(keys.sparkSession)
    ordered = keys.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").withColumn("p", F.spark_partition_id())

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side, ids, names, n, p = [], [], [], 0, 0
        first: list = []
        done = 0  # rows before this one have looked both ways

        def rows(out: list) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["qid", "cid", "p", "at", "n", "key", "side"])

        for b in batches:
            if len(b) == 0:
                continue
            p = int(b["p"].iloc[0])
            side += b["side"].tolist()
            ids += b["id"].tolist()
            names += b["key"].tolist()
            if len(first) < window:
                first += list(zip(side, ids, names))[len(first) : window] if n == 0 else []
            n += len(b)
            # a row is settled when `window` rows follow it; keep `window` rows before the first unsettled one
            stop = max(done, len(ids) - window)
            if stop > done:
                yield rows([(q, c, None, None, None, None, None) for q, c in _scan([s if done <= x < stop else (s or 2) for x, s in enumerate(side)], ids, names, window)])
                keep = max(0, stop - window)
                done = stop - keep
                side, ids, names = side[keep:], ids[keep:], names[keep:]
        if n == 0:
            return
        yield rows([(q, c, None, None, None, None, None) for q, c in _scan([s if x >= done else (s or 2) for x, s in enumerate(side)], ids, names, window)])
        last = list(zip(side, ids, names))[-window:]
        edge = {x: r for x, r in enumerate(first)} | {n - len(last) + x: r for x, r in enumerate(last)}
        yield rows([(None, r[1], p, x, n, r[2], r[0]) for x, r in sorted(edge.items())])

    schema = "qid string, cid string, p int, at long, n long, key string, side int"
    scanned = cut(ordered.mapInPandas(local, schema))

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "at"])
        side, ids, names, breaks, was = pdf["side"].astype(int).tolist(), pdf["cid"].tolist(), pdf["key"].tolist(), set(), None
        for x, (p, at) in enumerate(zip(pdf["p"].astype(int), pdf["at"].astype(int))):
            if was and p == was[0] and at != was[1] + 1:
                breaks.add(x)
            was = (p, at)
        return pd.DataFrame(list(_scan(side, ids, names, window, breaks)), columns=["qid", "cid"])

    edges = scanned.where("qid is null").groupBy().applyInPandas(bounds, "qid string, cid string")
    return scanned.where("qid is not null").select("qid", "cid").unionByName(edges).distinct()


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours as one) between a and b, or most + 1 if there are more."""
    if a == b:
        return 0
    # an edit takes one letter from either word at most
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row[j] = v
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def _allowed(a: str, b: str) -> int:
    """Edits by which two words may be one misspelt: none in numbers, numerals and the shortest words."""
    if min(len(a), len(b)) < 3 or max(len(a), len(b)) < 4 or any(c.isdigit() for c in a + b) or set(a) <= set("ivx") or set(b) <= set("ivx"):
        return 0
    return 1 if max(len(a), len(b)) < 8 else 2


def _same_words(q: list[str], c: list[str], cut_off: bool) -> float:
    """1 for equal words, less by misspelt or shortened ones, 0 if a word differs. cut_off: q may end early, within a word."""
    i = j = 0
    cost = 0.0
    while i < len(q) and j < len(c):
        a, b = q[i], c[j]
        if a == b:
            i, j = i + 1, j + 1
            continue
        if cut_off and i == len(q) - 1 and b.startswith(a):
            return max(0.0, 1 - cost)
        if (most := _allowed(a, b)) and edit_distance(a, b, most) <= most:
            cost += 0.04
            i, j = i + 1, j + 1
            continue
        for x, y, swap in ((a, c[j:], False), (b, q[i:], True)):  # initials of the next words, or the start of a long word
            s = re.sub("s$", "", x)
            if len(s) >= ACRONYM_MIN and len(y) >= len(s) and all(w[:1] == h for w, h in zip(y, s)):
                i, j = (i + len(s), j + 1) if swap else (i + 1, j + len(s))
                cost += 0.04
                break
            if len(s) >= 3 and len(y[0]) > len(s) + 2 and y[0].startswith(s):
                i, j = i + 1, j + 1
                cost += 0.04
                break
        else:
            if i + 1 < len(q) and a + q[i + 1] == b:
                i, j, cost = i + 2, j + 1, cost + 0.04
            elif j + 1 < len(c) and b + c[j + 1] == a:
                i, j, cost = i + 1, j + 2, cost + 0.04
            else:
                return 0.0
    if i < len(q) or (j < len(c) and not cut_off):
        return 0.0
    return max(0.0, 1 - cost)


def title_similarity(q: str | None, c: str | None) -> float | None:
    """1 for the same title; above 0.7 if words are misspelt or shortened, articles dropped, the end cut off or the subtitle left out; else 0. None if either is missing."""
    if not q or not c:
        return None
    if q == c:
        return 1.0
    cut_off = q.endswith("~")
    parts = [[[w for w in p.split() if w not in ARTICLES and w != "~"] for p in t.split("|", 1)] for t in (q, c)]
    (qb, *qs), (cb, *cs) = parts
    if qb + sum(qs, []) == cb + sum(cs, []):
        return 1.0
    if cut_off:
        words = qb + sum(qs, [])
        if len(words) > 4 and len(words[-1]) <= 3:  # the rest of a word says little
            words = words[:-1]
        return 0.95 * _same_words(words, cb + sum(cs, []), True)
    if not qs and cs:
        whole = _same_words(qb, cb + cs[0], False)
        return whole or 0.85 * _same_words(qb, cb, False)
    return _same_words(qb + sum(qs, []), cb + sum(cs, []), False)


@lru_cache(maxsize=4096)
def _people(cell: str) -> tuple[list[list[str]], bool]:
    """The words of each name of a cell, initials kept as letters; and whether the list says it goes on."""
    more = bool(re.search(r"(?i)\bet\.? al\b", cell))
    x = re.sub(r"(?i)\bet\.? al\b\.?", " ", cell)
    x = re.sub(r"(?i)\s+and\s+", ";", x)
    if re.search(r"[;|]", x):
        parts = re.split(r"[;|]", x)
    else:
        parts = [p for p in x.split(",") if p.strip(" .,&")]
        # "Surname, Given" of one person
        if len(parts) == 2 and len(parts[0].split()) == 1 and not re.search(r"\w\.? +\w{3,}", parts[1].strip()):
            parts = [x]
    out = []
    for p in parts:
        words = [w for w in re.split(r"[^\w-]+|_", p) if w]
        words = [w for w in (re.sub("-", "", w) for w in words) if w]
        if words:
            out.append(words)
    return out, more


def _person_match(q: list[str], surname: str, given: list[str]) -> bool:
    """Whether the words q may be this person: the surname, up to a misspelling, and no other given name or initial."""
    for x, w in enumerate(q):
        w = w.lower()
        if len(w) >= 3 and edit_distance(w, surname, 2 if len(surname) >= 7 else 1) <= (2 if len(surname) >= 7 else 1):
            rest = [r for y, r in enumerate(q) if y != x]
            if not rest or not given:
                return True
            letters = [r[0].lower() for r in rest if len(r) > 3 or not r.isupper()] or [c.lower() for r in rest for c in r]
            return letters[0] == given[0][0].lower() or given[0][0].lower() in letters
    return False


def author_similarity(q: str | None, c: str | None) -> float | None:
    """Share of q's authors found among c's, in any order, and of c's among q's unless q is cut short by et al. None if either is missing."""
    if not q or not c:
        return None
    qs, more = _people(q)
    cs, _ = _people(c)
    if not qs or not cs:
        return None
    # c writes surnames last
    left = [(w[-1].lower(), w[:-1]) for w in cs]
    hit = 0
    for p in qs:
        k = next((k for k, (s, g) in enumerate(left) if _person_match(p, s, g)), None)
        if k is not None:
            hit += 1
            left.pop(k)
    return hit / len(qs) if more else hit / max(len(qs), len(cs))


def confidence(title: float | None, authors: float | None, year: float | None, doi: float | None, telling: bool = False) -> float:
    """Weighted mean of the known similarities; 0 unless the titles agree and so does at least one of authors, doi and year, authors first, or nothing but a
    telling title is known."""
    if not title:
        return 0.0
    if authors is not None and authors < 0.5 and not (doi == 1.0 and authors > 0):
        return 0.0
    if year is not None and year == 0 and doi != 1.0 and (authors is None or authors < 0.75):
        return 0.0
    if authors is None and doi != 1.0 and (year == 0 or (year is None and not (title == 1.0 and telling))):
        return 0.0
    known = [(WEIGHTS[k], v) for k, v in (("title", title), ("authors", authors), ("year", year), ("doi", doi)) if v is not None]
    return sum(w * v for w, v in known) / sum(w for w, _ in known)


def may_share_author() -> Column:
    """Whether author_similarity() can be above 0 for q_authors and c_authors: true unless no word of the one is within its allowance of a surname of the
    other (two swaps are four plain edits)."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"\bet\.? al\b\.?", " ")
    plain = lambda c, keep: F.replace(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{keep}-]+", " "), F.lit("-"))
    words = F.filter(F.split(plain(clean(F.col("q_authors")), ""), " "), lambda w: F.length(w) >= 3)
    parts = F.split(plain(F.regexp_replace(clean(F.col("c_authors")), r"[;|,]|\s+and\s+", ";"), ";"), ";")
    last = F.filter(F.transform(parts, lambda p: F.substring_index(F.btrim(p), " ", -1)), lambda w: w != "")
    near = lambda w, c: F.when(F.length(c) >= 7, F.levenshtein(w, c, 4)).otherwise(F.levenshtein(w, c, 2)) >= 0
    # an array of one, so that each side's words are made once a pair and not once for each name
    known = F.array(F.struct(words.alias("q"), last.alias("c")))
    may = lambda x: (F.size(x.q) == 0) | (F.size(x.c) == 0) | F.arrays_overlap(x.q, x.c) | F.exists(x.c, lambda c: F.exists(x.q, lambda w: near(w, c)))
    return F.col("q_authors").isNull() | F.col("c_authors").isNull() | F.exists(known, may)


def compare(pairs: DataFrame) -> DataFrame:
    """(qid, cid, wid, confidence, unsure) of pairs with the fields of both sides (q_*, c_*)."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                t = title_similarity(r.q_title, r.c_title)
                if not t:
                    continue
                a = author_similarity(r.q_authors, r.c_authors)
                gap = None if pd.isna(r.q_year) or pd.isna(r.c_year) else abs(int(r.q_year) - int(r.c_year))
                y = None if gap is None else (1.0, 0.8, 0.3)[gap] if gap < 3 else 0.0
                # another DOI may be another version's, or wrong: no evidence either way
                d = 1.0 if r.q_doi and r.q_doi == r.c_doi else None
                got = confidence(t, a, y, d, len(r.q_title.split()) >= TELLING)
                if got > 0:
                    out.append((r.qid, r.cid, got, a is None and d is None))
            yield pd.DataFrame(out, columns=["qid", "cid", "confidence", "unsure"])

    return pairs.mapInPandas(score, "qid string, cid string, confidence double, unsure boolean")


def _first_word(t: Column) -> Column:
    """The first word of a title that is no article; empty if there is none."""
    return F.regexp_extract(t, r"(?:^|[ |])(?!(?:the|a|an)(?:[ |]|$))([^ |~]+)", 1)


def may_share_title() -> Column:
    """Whether title_similarity() can be above 0 by the first words q_first and c_first: a shortened, joined or cut-off word begins with the same letter, and
    two swaps are four plain edits."""
    q, c = F.col("q_first"), F.col("c_first")
    return (F.left(q, F.lit(1)) == F.left(c, F.lit(1))) | (q == "") | (c == "") | (F.levenshtein(q, c, 4) >= 0)


def _digest(of: str = "", side: Column | None = None) -> Column:
    """96 bits, in 16 letters, that stand for a description, by its fields."""
    text = F.concat_ws("\x1f", (F.col("side") if side is None else side).cast("string"), *[F.coalesce(F.col(of + f).cast("string"), F.lit("")) for f in FIELDS])
    return F.base64(F.unhex(F.substring(F.sha2(text, 224), 1, 24)))


def best_assignment(pairs: list[tuple]) -> list[tuple]:
    """The pairs (a, b, weight above 0) of largest total weight in which no a and no b stands twice: shortest augmenting paths over the given pairs, in whole
    millionths, so that sums are exact."""
    near: dict = {}
    for a, b, x in sorted(pairs):
        near.setdefault(a, {})[b] = round(x * 1_000_000)
    high, low = {a: max(n.values()) for a, n in near.items()}, {b: 0 for n in near.values() for b in n}  # prices; high + low is never below a pair's weight
    of, has = {}, {}  # b: its a, and a: its b
    for start in near:
        far_a, far_b, came = {start: 0}, {}, {}
        heap: list = []
        end, free, cost, a, at = None, start, high[start], start, 0  # so far the best: `free` stays without a b
        while True:
            for b, x in near[a].items():
                d = at + high[a] + low[b] - x
                if b not in far_b or d < far_b[b]:
                    far_b[b], came[b] = d, a
                    heapq.heappush(heap, (d, b))
            while heap and far_b[heap[0][1]] < heap[0][0]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= cost:
                break
            at, b = heapq.heappop(heap)
            if b not in of:
                end, cost = b, at
                break
            a = of[b]
            far_a[a] = at
            if at + high[a] < cost:
                free, cost = a, at + high[a]
        high.update({a: high[a] - (cost - d) for a, d in far_a.items() if d < cost})
        low.update({b: low[b] + (cost - d) for b, d in far_b.items() if d < cost})
        if end is None and free != start:  # its b becomes the end of the path
            end = has.pop(free)
        while end is not None:
            a = came[end]
            of[end], has[a], end = a, end, has.get(a)
    return sorted((a, b, near[a][b] / 1_000_000) for b, a in of.items())


def one_to_one(pairs: DataFrame) -> DataFrame:
    """The rows of pairs (queue_id, work_id, confidence), no queue id and no work twice, whose confidences have the largest total. Decided group by group of
    those that pairs link; a group is one task."""
    pairs = cut(pairs.groupBy("queue_id", "work_id").agg(F.max("confidence").alias("confidence")))
    a, b = F.concat(F.lit("q"), "queue_id"), F.concat(F.lit("w"), "work_id")
    groups = hash_to_min(pairs.select(a.alias("a"), b.alias("b")), "a", "b")
    grouped = pairs.withColumn("rec_id", a).join(groups, "rec_id").select("group_id", "queue_id", "work_id", "confidence")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(best_assignment(list(zip(pdf["queue_id"], pdf["work_id"], pdf["confidence"]))), columns=["queue_id", "work_id", "confidence"])

    return grouped.groupBy("group_id").applyInPandas(decide, "queue_id string, work_id string, confidence double")


def link(queue: DataFrame, register: DataFrame, threshold: float = CONFIDENT, window: int = WINDOW, each_once: bool = False) -> DataFrame:
    """(queue id, work id, confidence): the work each queue id describes, if one is found.

    queue, register: outputs of describe (sides 0 and 1). Ids with the same description are compared once. Pairs share an exact key, also by a title
    that is like theirs, or are near in the order of the sort keys, and are compared field by field.
    Assignment: each queue id gets the work of its highest confidence, equal ones the smaller work id, which maximises the total confidence under
    at most one work per queue id. A work may be given to several queue ids, as the queue holds papers again under other ids; each_once: it may not, and
    the assignment is that of the largest total confidence over all pairs of the queue ids that have a work (one_to_one). A pair that
    rests on title and year alone counts only where no second work is as good. Missing fields are left out of the mean; a queue row without
    title, and empty tables, give no rows; repeated rows count once.
    """
    both = queue.unionByName(register).withColumn("base", _key_title(F.col("title")))
    # keys carry a short number for a description, `id`; two with one number are only compared in vain. Rows with one description meet, and are merged, where their keys do
    written = cut(both.withColumnRenamed("id", "name").withColumn("id", _number(_digest())), compression="zstd")
    both = written.where("title is not null")
    texts = both.drop("name")
    based = texts.select("side", "id", "title", "base", "year", "surnames")
    like = cut(like_titles(texts))  # read twice
    alike = based.where("side = 0").drop("base").join(like, "title").select(*based.columns)
    same_doi = same_key(texts.where("doi is not null").select("side", "id", _number("doi").alias("key")).repartition("key").distinct())
    near = exact_pairs(based.unionByName(alike)).unionByName(same_doi).unionByName(near_titles(cut(sort_keys(texts)), window)).distinct()
    side = lambda k, n: both.where(F.col("side") == k).select(F.col("id").alias(f"{n}num"), *[F.col(f).alias(f"{n}_{f}") for f in FIELDS]).repartition(f"{n}num").distinct().withColumn(f"{n}_first", _first_word(F.col(f"{n}_title")))
    near = near.select(F.col("qid").alias("qnum"), F.col("cid").alias("cnum"))
    # written once: the best match and its rivals are read from it
    near = near.join(side(0, "q"), "qnum").join(side(1, "c"), "cnum").where(may_share_title()).where(may_share_author())
    scored = cut(compare(near.withColumns({"qid": _digest("q_", F.lit(0)), "cid": _digest("c_", F.lit(1))})).where(F.col("confidence") >= threshold))
    ids = lambda side, rid, name: both.where(F.col("side") == side).select(_digest().alias(rid), F.col("name").alias(name)).join(scored.select(rid), rid, "left_semi").distinct()
    works = cut(ids(1, "cid", "work_id"))
    held = works.groupBy("cid").agg(F.min("work_id").alias("first"), F.max("work_id").alias("last"))
    pairs = cut(scored.join(ids(0, "qid", "queue_id"), "qid").join(held, "cid"))
    for done in (written, like):
        drop_cut(done)
    top = pairs.groupBy("queue_id").agg(F.max("confidence").alias("top"))
    near_top = pairs.join(top, "queue_id").where(F.col("confidence") >= F.col("top") - 0.02)
    one = near_top.groupBy("queue_id").agg(F.min_by(F.struct(F.col("first").alias("work_id"), "confidence"), F.struct((-F.col("confidence")).alias("c"), F.col("first").alias("w"))).alias("x"), (F.min("first") == F.max("last")).alias("alone"))
    one = one.select("queue_id", "x.work_id", "x.confidence", "alone")
    # a work is unsure if each of its descriptions is
    sure = pairs.where("not unsure").select("queue_id", "cid").join(works, "cid").join(one.where("not alone").select("queue_id", "work_id"), ["queue_id", "work_id"], "left_semi").select("queue_id").distinct()
    found = one.where("alone").unionByName(one.where("not alone").join(sure, "queue_id", "left_semi")).select("queue_id", "work_id", "confidence")
    if each_once:
        return one_to_one(pairs.join(works, "cid").join(found.select("queue_id"), "queue_id", "left_semi").select("queue_id", "work_id", "confidence"))
    return found
