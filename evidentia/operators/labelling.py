"""Labels from words: phrase vocabularies, and record types from titles and publication types."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.rules import all_matches, first_match

Vocabulary = dict[str, list[str]]


def wordline(c: Column | str, numbers: str | None = None) -> Column:
    """The words of a text in lower case with one blank before, between and after; colons are words, other marks are not. numbers: what to write for
    each run of digits. Null is a line without words."""
    x = F.replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit(":"), F.lit(" : "))
    x = F.regexp_replace(x, r"[^\p{L}\p{N}:]+", " ")
    if numbers is not None:
        x = F.regexp_replace(x, r"[0-9]+", numbers)
    return F.concat(F.lit(" "), F.btrim(x), F.lit(" "))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds(line: Column, phrases: list[str]) -> Column:
    """Whether a wordline holds one of the phrases as whole words."""
    return _any([line.contains(f" {p} ") for p in phrases])


def opens(line: Column, phrases: list[str]) -> Column:
    """Whether a wordline begins with one of the phrases."""
    return _any([line.startswith(f" {p} ") for p in phrases])


def tags(line: Column, words: Vocabulary) -> Column:
    """Names of the vocabulary whose phrases the line holds, in its order."""
    return all_matches([(n, holds(line, ps)) for n, ps in words.items()])


def tags_or(line: Column, words: Vocabulary, general: Vocabulary) -> Column:
    """The tags of the line; those of the general vocabulary only where it has none."""
    return F.when(F.size(tags(line, words)) > 0, tags(line, words)).otherwise(tags(line, general))


def one_tag(line: Column, words: Vocabulary, implied: Column | None = None, default: str | None = None) -> Column:
    """The first name of the vocabulary that holds; what another label implies comes before it."""
    own = first_match([(n, holds(line, ps)) for n, ps in words.items()], default)
    return own if implied is None else F.coalesce(implied, own)


@dataclass(frozen=True)
class RecordRules:
    """What tells record types apart. openings: (rule, type, whether it is sure by itself, phrases titles begin with), in order of precedence; # stands for
    a number. codes: (publication type, record type, codes that block it), in order. hints: (publication type, record type) that are too weak to
    decide. research: publication types of research articles, which veto a code no title supports. watch: phrases that only ask for a look."""

    openings: list[tuple[str, str, bool, list[str]]]
    codes: list[tuple[str, str, list[str]]]
    hints: list[tuple[str, str]] = field(default_factory=list)
    research: list[str] = field(default_factory=list)
    watch: Vocabulary = field(default_factory=dict)
    paper: str = "research_paper"


def record_types(df: DataFrame, title: str, types: str, abstract: str, rules: RecordRules, long_abstract: int = 600) -> DataFrame:
    """df with record_type, confidence, title_rule, code, vetoed, conflict, watch and reasons (why someone should look; empty if nobody need).

    A title's opening decides before the publication types do; both together are sure. A type that only a publication type tells is vetoed by a research
    type beside it, unless the title says the same. Doubt never makes a record a non-paper: it stays a paper and is queued. Confidence counts down from 2
    (high) over contradictions and missing support. Null titles, types and abstracts say nothing. No shuffle: all of it is one projection.
    """
    line = wordline(title, numbers="#")
    cell = F.filter(F.transform(F.split(F.coalesce(types, F.lit("")), "[;,]"), F.btrim), lambda x: (x != "") & (F.lower(x) != "nan"))
    x = df.withColumn("_line", line).withColumn("_codes", cell)
    at = F.col("_line")
    has = lambda c: F.array_contains("_codes", c)
    x = x.withColumn("title_rule", first_match([(n, opens(at, ps)) for n, _, _, ps in rules.openings]))
    by = lambda k: first_match([(str(r[k]), F.col("title_rule") == r[0]) for r in rules.openings])
    x = x.withColumn("_kind", by(1)).withColumn("_sure", F.coalesce(by(2) == "True", F.lit(False)))
    x = x.withColumn("_code", first_match([(c, has(c) & ~_any([has(b) for b in blocked])) for c, _, blocked in rules.codes]))
    x = x.withColumn("_says", first_match([(k, F.col("_code") == c) for c, k, _ in rules.codes]))
    x = x.withColumn("_hint", first_match([(k, has(c)) for c, k in rules.hints]))
    research = _any([has(c) for c in rules.research])
    x = x.withColumn("_veto", F.col("_code").isNotNull() & research & ~F.col("_kind").eqNullSafe(F.col("_says")))
    x = x.withColumn("vetoed", F.when(F.col("_veto"), F.col("_code"))).withColumn("code", F.when(~F.col("_veto"), F.col("_code")))
    x = x.withColumn("_says", F.when(~F.col("_veto"), F.col("_says"))).withColumn("record_type", F.coalesce("_kind", "_says", F.lit(rules.paper)))
    x = x.withColumn("watch", F.when(F.col("title_rule").isNull(), F.array_join(tags(at, rules.watch), ";")).otherwise(""))
    paper = F.col("record_type") == rules.paper
    agree = (F.coalesce(F.col("_kind") == F.col("_says"), F.lit(False))) | (F.coalesce(F.col("_kind") == F.col("_hint"), F.lit(False)))
    x = x.withColumn("conflict", F.col("_veto") | F.coalesce(F.col("_kind") != F.col("_says"), F.lit(False)) | (~paper & research))
    doubt = F.col("_hint").isNotNull() | F.col("_veto") | (F.col("watch") != "")
    start = F.when(F.col("title_rule").isNotNull(), F.when(agree | F.col("_sure"), 2).otherwise(1)).when(~paper, 1).otherwise(F.when(doubt, 1).otherwise(2))
    off = F.when(~paper & F.col("conflict"), 1).otherwise(0) + F.when(F.col("title_rule").isNotNull() & (F.size("_codes") == 0), 1).otherwise(0)
    x = x.withColumn("_level", F.greatest(start - off, F.lit(0)))
    x = x.withColumn("confidence", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("_level") + 1))
    size = F.length(F.btrim(F.coalesce(abstract, F.lit(""))))
    why = [
        ("unconfirmed", ~paper & (F.col("_level") < 2)), ("conflict", ~paper & F.col("conflict")), ("long_abstract", ~paper & (size >= long_abstract)),
        ("vetoed_code", paper & F.col("_veto")), ("weak_code", paper & F.col("_hint").isNotNull()), ("watch", F.col("watch") != ""),
    ]
    x = x.withColumn("reasons", F.array_join(all_matches(why), ";"))
    return x.drop("_line", "_codes", "_kind", "_sure", "_code", "_says", "_hint", "_veto", "_level")


def partition(decisions: DataFrame, types: DataFrame, key: str, paper: str = "research_paper") -> DataFrame:
    """decisions with record_type, reasons and part, `paper` or `non_paper`. A decision whose record has no type is a paper: only recorded evidence takes
    one out. types: (key, record_type, reasons), one row each; the first record type by name counts where it is not."""
    one = types.groupBy(key).agg(F.min_by(F.struct("record_type", "reasons"), "record_type").alias("_t"))
    x = decisions.join(one, key, "left").withColumn("record_type", F.coalesce("_t.record_type", F.lit("unclassified"))).withColumn("reasons", F.coalesce("_t.reasons", F.lit("")))
    return x.withColumn("part", F.when(F.col("record_type").isin(paper, "unclassified"), "paper").otherwise("non_paper")).drop("_t")
