"""Scalar column functions of the evidence-map pipelines. All stay in the JVM but for the two named at the end."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters they fold to.
MARKED = "áàâäãåāăąčćçďđéèêëēėęěğíìîïīįıłľĺñńňóòôöõøōőŕřśšşťţúùûüůūűųýÿžźżßæœðþ"
FOLDED = "aaaaaaaaacccddeeeeeeeegiiiiiiilllnnnoooooooorrsssttuuuuuuuuyyzzzsaodt"
#: Words left out of title tokens.
STOP = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with")
#: DOI prefixes and words that mark a preprint.
PREPRINT_DOI = ("10.1101/", "10.48550/", "10.21203/", "10.31234/", "10.20944/")
PREPRINT_VENUE = r"arxiv|biorxiv|medrxiv|preprint|drafts"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_empty(c: Column | str) -> Column:
    """Not null and not blank; never null itself."""
    return F.trim(F.coalesce(_c(c), F.lit(""))) != ""


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


def normalize_doi(c: Column | str, variant: str = "full") -> Column:
    """DOI in lower case without prefixes. Variants: core (three prefixes, once), resolver (also dx. and www., no doi:), full (any of them, repeated, and closing slashes). Null stays null."""
    x = F.lower(F.trim(_c(c)))
    if variant == "core":
        return F.regexp_replace(x, r"^(https://doi\.org/|http://doi\.org/|doi:)", "")
    if variant == "resolver":
        return F.regexp_replace(x, r"^https?://(dx\.|www\.)?doi\.org/", "")
    return F.regexp_replace(F.regexp_replace(x, r"^((https?://)?(dx\.|www\.)?doi\.org/|doi:\s*)+", ""), r"/+$", "")


def normalize_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", " "))


def fold(c: Column | str) -> Column:
    """Lower case, Latin marks removed."""
    return F.translate(F.lower(_c(c)), MARKED, FOLDED)


def norm_text(c: Column | str) -> Column:
    """Folded words of a-z and 0-9 with single blanks between."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def plain_title(c: Column | str) -> Column:
    """Quotes and dashes made plain, section prefixes like 'Abstract:' removed, blanks squeezed."""
    x = F.translate(_c(c), "‘’“”–—−", "''\"\"---")
    x = F.regexp_replace(x, r"(?i)^\s*(title|article|abstract|research article)\s*[:\-]\s*", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def title_tokens(c: Column | str) -> Column:
    """Words of a normalised title that are no stop words; repeated ones stay."""
    return F.filter(F.split(normalize_title(c), " "), lambda w: (w != "") & ~w.isin(*STOP))


def authors_of(c: Column | str) -> Column:
    """Names of a ';' or '|' list; 'Surname, Given' is turned round."""
    turn = lambda a: F.when(a.contains(","), F.trim(F.concat(F.trim(F.element_at(F.split(a, ","), 2)), F.lit(" "), F.trim(F.split(a, ",")[0])))).otherwise(a)
    return F.transform(F.filter(F.transform(F.split(_c(c), r"[;|]"), lambda v: F.trim(v)), lambda a: a != ""), turn)


def surnames_of(names: Column) -> Column:
    """Folded last words of names, and their last two joined where longer than two words; each once."""
    words = F.transform(names, lambda a: F.filter(F.split(F.regexp_replace(fold(a), "[^a-z ]", ""), " +"), lambda w: w != ""))
    last = F.transform(words, lambda w: F.coalesce(F.element_at(w, F.when(F.size(w) > 0, -1)), F.lit("")))
    pair = F.transform(words, lambda w: F.when(F.size(w) > 2, F.concat_ws(" ", F.slice(w, -2, 2))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(last, pair), lambda s: s.isNotNull() & (s != ""))))


def norm_author(name: Column, keep_initials: bool = True) -> Column:
    """surname|initials of a name written given first. keep_initials False leaves out given names that are single letters."""
    w = F.filter(F.split(F.regexp_replace(fold(name), "[^a-z ]", " "), " +"), lambda x: x != "")
    given = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
    if not keep_initials:
        given = F.filter(given, lambda x: F.length(x) > 1)
    return F.when(F.size(w) > 0, F.concat(F.element_at(w, -1), F.lit("|"), F.array_join(F.transform(given, lambda x: F.substring(x, 1, 1)), "")))


def name_block(name: Column) -> Column:
    """A name without single letters between its first and last word."""
    w = F.filter(F.split(F.regexp_replace(fold(name), "[^a-z ]", " "), " +"), lambda x: x != "")
    inner = F.filter(F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0))), lambda x: F.length(x) > 1)
    return F.when(F.size(w) >= 3, F.array_join(F.concat(F.slice(w, 1, 1), inner, F.slice(w, -1, 1)), " ")).otherwise(F.array_join(w, " "))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over all distinct members; `empty` where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_preprint(doi: Column, types: Column, venue: Column, arxiv: Column | None = None) -> Column:
    marks = [F.coalesce(doi, F.lit("")).startswith(p) for p in PREPRINT_DOI]
    out = F.lower(F.coalesce(types, F.lit(""))).contains("preprint") | F.lower(F.coalesce(venue, F.lit(""))).rlike(PREPRINT_VENUE)
    for m in marks:
        out = out | m
    return out | non_empty(arxiv) if arxiv is not None else out


def fingerprint(*cols: str) -> Column:
    """SHA-256 of the named fields as JSON with sorted names, nulls left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256)


def slug(c: Column | str, most: int = 60) -> Column:
    return F.rtrim(F.substring(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most))


def dois_in(c: Column | str) -> Column:
    """DOIs in a text, closing punctuation removed, each once, in order."""
    hits = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"(10\.\d{4,9}/[^\s\"<>]+)"), F.lit(1))
    return F.array_distinct(F.transform(hits, lambda d: F.regexp_replace(d, r"[.,;:)\]]+$", "")))


def clean_abstract(c: Column | str, least: int = 40) -> Column:
    """Abstract without tags and entities; null if it is short or says that there is none."""
    x = F.regexp_replace(_c(c), "<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when((F.length(x) >= least) & ~F.lower(x).rlike(r"^(no abstract|abstract not available|n/a)"), x)


def sentences_of(c: Column | str) -> Column:
    return F.filter(F.split(_c(c), r"(?<=[.!?])\s+"), lambda x: x != "")


def age_normalized(cites: Column, year: Column, now: int) -> Column:
    return F.log1p(cites.cast("double")) / F.sqrt(F.greatest(F.lit(1), F.lit(now) - year + 1).cast("double"))


def cites_per_year(cites: Column, year: Column, now: int, variant: str = "inclusive") -> Column:
    """inclusive: age is now - year + 1, at least 1; clipped: now - year, at least 0.5."""
    age = F.greatest(F.lit(1.0), (F.lit(now) - year + 1).cast("double")) if variant == "inclusive" else F.greatest(F.lit(0.5), (F.lit(now) - year).cast("double"))
    return cites / age


def citation_role(indeg: Column, outdeg: Column, hub: int = 50) -> Column:
    return F.when(indeg >= hub, "hub").when((indeg == 0) & (outdeg == 0), "isolate").when(indeg == 0, "only_out").when(outdeg == 0, "only_in").otherwise("broker")


def link_strength(indeg: Column, outdeg: Column, weak: int = 2, moderate: int = 9) -> Column:
    total = indeg + outdeg
    return F.when((total <= weak) & (indeg == 0), "weak_unlinked").when(total <= weak, "weak").when(total <= moderate, "moderate").otherwise("strong")


def asymmetry(indeg: Column, outdeg: Column) -> Column:
    return F.when((indeg <= 0) & (outdeg <= 0), F.lit(None).cast("double")).when(indeg <= 0, outdeg.cast("double")).otherwise(F.round(outdeg / indeg, 3))


def list_cell(c: Column | str) -> Column:
    """The items of a cell that holds a literal list or a separated one; an empty array for anything unusable."""
    x = F.trim(F.coalesce(_c(c), F.lit("")))
    inner = F.regexp_replace(x, r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, r"[;|,]"), lambda v: F.trim(F.regexp_replace(F.trim(v), "^[\"']|[\"']$", ""))), lambda v: ~F.lower(v).isin("", "nan", "none", "null"))


def bits(flags: list[Column]) -> Column:
    """Bit i is set where flag i holds."""
    out = F.lit(0)
    for i, f in enumerate(flags):
        out = out.bitwiseOR(F.when(F.coalesce(f, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def bit(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i)) != 0


def ellipsis(c: Column | str, n: int) -> Column:
    x = F.trim(F.regexp_replace(_c(c), r"\s+", " "))
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…"))).otherwise(x)


def year_of(c: Column | str) -> Column:
    """A year between 1800 and 2100, or null."""
    y = F.expr("null").cast("int") if c is None else _c(c).try_cast("int")
    return F.when(y.between(1800, 2100), y)


def similarity_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts, 0 if either is null. Arrow batches; only for pairs that blocking has left."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() if p is not None and q is not None else 0.0 for p, q in zip(x, y)])

    return run(a, b)


def common_letters(x: str, y: str) -> int:
    """Length of the longest common subsequence, all places of x in one number."""
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full = v = (1 << len(x)) - 1
    for c in y:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(x) - v.bit_count()


def ratio_from(a: Column, b: Column, least: float) -> Column:
    """similarity_ratio() to six places where it is at least `least`, else null. The ratio counts letters of a common subsequence, so it runs only where the longest one is long enough."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            got = None
            if p == q:
                got = 1.0
            elif 2 * common_letters(p, q) >= (least - 1e-6) * (len(p) + len(q)):
                got = round(difflib.SequenceMatcher(None, p, q).ratio(), 6)
            out.append(got if got is not None and got >= least else None)
        return pd.Series(out, dtype="float64")

    return run(a, b)


#: Letters of normalised texts, and how many of each a signature tells apart; its numbers of 60 bits for letters and for pairs of letters.
LETTERS, LEVELS, LETTER_WORDS, PAIR_WORDS = " abcdefghijklmnopqrstuvwxyz0123456789", 6, 4, 4


def signature(t: str) -> list[int]:
    """Numbers of which two texts differ in no more bits than in single letters put in or taken out (the first LETTER_WORDS), and three times as many (the others)."""
    letters = pairs = 0
    for c in set(t):
        n, at = min(t.count(c), LEVELS), LETTERS.find(c)
        if at >= 0:
            letters |= ((1 << n) - 1) << LEVELS * at
    for p in set(zip(t, t[1:])):
        pairs |= 1 << (ord(p[0]) * 31 + ord(p[1])) % (60 * PAIR_WORDS)
    return [x >> 60 * k & (1 << 60) - 1 for x, n in ((letters, LETTER_WORDS), (pairs, PAIR_WORDS)) for k in range(n)]


def signatures(c: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(signature)

    return run(c)


def nfkc(c: Column) -> Column:
    """NFKC form; plain text never leaves the JVM's answer as given."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(c)
