"""Several values packed in one field: infer the delimiters of each source, then split with position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.common import bare, cut, drop_cut, usable

#: Separator candidates with the score each has before any evidence.
CANDIDATES = {";": 0.7, "|": 0.7, "\t": 0.7, "\n": 0.7, "\uff1b": 0.7, "\uff5c": 0.7, "\uff0c": 0.6, "\u3001": 0.6, "\u2022": 0.6, ",": 0.6, "\u00b7": 0.3, "/": 0.2, "&": 0.2, "+": 0.2, "~": 0.2, "#": 0.2, " ": 0.0}
#: Smoothed score from which a candidate separates values.
ACCEPT = 0.5

_PAIR = r"^[\"'\x03\x04]?([^\"'\x03\x04:=()]*?)[\"']?\s*[:=(]\s*[\"']?(-?\d+)[\"']?\s*\)?$"
_D, _S = "\x03", "\x04"


def _let(c: Column, f) -> Column:
    """f of c with c evaluated once, however often f names it: nested expressions stay small."""
    return F.transform(F.array(c), f)[0]


def _inner(c: Column) -> Column:
    """The cell without one enclosing pair of brackets, escapes replaced by marks: \\" by 01, \\' by 02."""
    c = _let(bare(c), lambda v: F.when(v.rlike(r"(?s)^(\[.*\]|\{.*\})$"), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v))
    return F.replace(F.replace(c, F.lit('\\"'), F.lit("\x01")), F.lit("\\'"), F.lit("\x02"))


def _class(delims: str) -> str:
    return "".join({"\t": r"\t", "\n": r"\n\r", "|": r"\|", "&": r"\&"}.get(d, d) for d in delims)


def _marked(c: Column, delims: str) -> Column:
    """Opening quotes become 03 and 04; quotes doubled inside a value become 05 and 06."""
    at = rf"(^|[{_class(delims)}])( *)" if delims else r"(^)( *)"
    c = F.regexp_replace(c, at + '"', f"$1$2{_D}")
    c = F.regexp_replace(c, at + "'", f"$1$2{_S}")
    return F.replace(F.replace(c, F.lit('""'), F.lit("\x05")), F.lit("''"), F.lit("\x06"))


def _pieces(c: Column, delims: str) -> Column:
    """Raw pieces of a marked cell; a quoted piece keeps the delimiters inside its quotes. No group is repeated in the pattern, so long cells cost no stack."""
    if not delims:
        return F.array(c)
    k = _class(delims)
    p = rf"[{k}] *({_D}[^\"]*+\"[^{k}]*+|{_S}[^']*+'[^{k}]*+|[^{k}]*+)"
    return F.regexp_extract_all(F.concat(F.lit(delims[0]), c), F.lit(p), F.lit(1))


def _undo(x: Column, doubled: str, single: str) -> Column:
    x = F.replace(F.replace(x, F.lit("\x05"), F.lit(doubled)), F.lit("\x06"), F.lit(single))
    return F.translate(x, "\x01\x02\x03\x04", "\"'\"'")


def _value(p: Column) -> Column:
    """A piece without blanks, enclosing quotes or brackets; doubled and escaped quotes undone."""

    def of(v: Column) -> Column:
        body = v.substr(F.lit(2), F.length(v) - 2)
        open_ = bare(F.regexp_replace(_undo(v, '""', "''"), r"^[\[\]{}\s]+|[\[\]{}\s]+$", ""))
        return (
            F.when(v.startswith(_D) & v.endswith('"'), bare(_undo(body, '"', "''")))
            .when(v.startswith(_S) & v.endswith("'"), bare(_undo(body, '""', "'")))
            .otherwise(open_)
        )

    return _let(bare(p), of)


def _pair(p: Column) -> Column:
    """key=count of a piece such as 'hub': 3, hub (3) or hub=3; null for any other piece."""

    def of(v: Column) -> Column:
        key = bare(F.regexp_extract(v, _PAIR, 1))
        return F.when(v.rlike(_PAIR) & (key != ""), F.concat(key, F.lit("="), F.regexp_extract(v, _PAIR, 2)))

    return _let(bare(p), of)


def _pair_or_value(p: Column) -> Column:
    return F.coalesce(_pair(p), _value(p))


def infer_delimiters(df: DataFrame, cell: str, source: str) -> dict[str, tuple[str, bool]]:
    """For each source: its delimiters, and whether its values are key-count pairs.

    A candidate is judged in the cells where it is the only candidate outside quotes (a blank only where no other occurs).
    Piece-type regularity is the share of its pieces that also occur in the source without this candidate (whole cells, quoted
    values, pieces of other candidates; digits count alike). A usual separator (prior of ACCEPT or more) loses only what it falls
    short of the share among undivided cells, so a source whose values never recur is still split; an unusual one must earn the
    share itself. Piece-count consistency is the share of its cells whose pieces all have one type. Score: the product, averaged
    with the candidate's prior as one more cell. Distinct cells are counted first, so a cell repeated in a third of the rows is
    judged once, by weight.
    """
    marks = [c for c in CANDIDATES if c != " "]
    cells = df.select(F.col(source).alias("_s"), _inner(usable(cell)).alias("_c")).where("_c is not null").groupBy("_s", "_c").agg(F.count("*").alias("_w"))
    cells = cells.withColumn("_m", _marked(F.col("_c"), "".join(marks)))

    def only(m: Column) -> Column:
        masked = F.regexp_replace(F.regexp_replace(m, _D + '[^"]*+"', "\x07"), _S + "[^']*+'", "\x07")

        def of(k: Column) -> Column:
            present = F.array_compact(F.array(*[F.when(F.contains(k, F.lit(d)), F.lit(d)) for d in marks]))
            none = F.when(F.contains(bare(k), F.lit(" ")), F.lit(" ")).otherwise(F.lit(""))
            return _let(present, lambda p: F.when(F.size(p) == 1, p[0]).when(F.size(p) == 0, none))

        return _let(masked, of)

    cells = cells.withColumn("_d", only(F.col("_m")))
    split = F.lit(None).cast("array<string>")
    for d in ["", *CANDIDATES]:
        split = F.when(F.col("_d") == d, _pieces(F.col("_m"), d)).otherwise(split)

    def kind(s: Column) -> Column:
        return F.when(s["p"].isNotNull(), F.lit("pair")).when(s["v"].rlike(r"^-?[\d.]+$"), F.lit("number")).otherwise(F.lit("word"))

    x = F.filter(F.transform(split, lambda p: F.struct(_pair(p).alias("p"), _value(p).alias("v"))), lambda s: s["v"] != "")
    shape = lambda s: F.regexp_replace(F.coalesce(s["p"], s["v"]), r"\d+", "9")
    facts = lambda z: F.struct(F.transform(z, shape).alias("h"), F.size(F.array_distinct(F.transform(z, kind))).alias("kinds"), F.exists(z, lambda s: s["p"].isNotNull()).alias("pairs"))
    cells = cells.select("_s", "_d", "_w", _let(x, facts).alias("_f"))
    # written once: three small aggregates read it
    cells = cut(cells.select("_s", "_d", "_w", F.col("_f.h").alias("_h"), F.col("_f.kinds").alias("_kinds"), F.col("_f.pairs").alias("_pairs")).where("_d is not null"))
    # a blank's own whole cells also count as undivided values, else no value of two words could be known
    whole = cells.withColumn("_h", F.when(F.col("_d") == " ", F.array(F.array_join("_h", " "))).otherwise(F.col("_h")))
    vocabulary = whole.select("_s", F.when(F.col("_d") != " ", F.col("_d")).otherwise("").alias("_vd"), F.explode("_h").alias("_h")).groupBy("_s", "_h").agg(F.min("_vd").alias("_lo"), F.max("_vd").alias("_hi"))
    pieces = cells.select("_s", "_d", "_w", F.explode("_h").alias("_h"))
    regular = (
        pieces.groupBy("_s", "_d", "_h").agg(F.sum("_w").alias("_w")).join(vocabulary, ["_s", "_h"])
        .groupBy("_s", "_d").agg(F.sum(F.when((F.col("_lo") != F.col("_d")) | (F.col("_hi") != F.col("_d")), F.col("_w")).otherwise(0)).alias("good"), F.sum("_w").alias("all"))
    )
    consistent = cells.groupBy("_s", "_d").agg(F.sum(F.when(F.col("_kinds") <= 1, F.col("_w")).otherwise(0)).alias("same"), F.sum("_w").alias("n"), F.sum(F.when(F.col("_pairs"), F.col("_w")).otherwise(0)).alias("pairs"))
    out: dict = {}
    for r in consistent.join(regular, ["_s", "_d"], "left").collect():  # sources x candidates
        out.setdefault(r["_s"], {})[r["_d"]] = r
    drop_cut(cells)
    found = {}
    for s, by in out.items():
        keep = ""
        whole = by.get("")
        base = (whole["good"] or 0) / whole["all"] if whole and whole["all"] else 0.0
        for d, prior in CANDIDATES.items():
            r = by.get(d)
            n = r["n"] if r else 0
            share = (r["good"] or 0) / r["all"] if r and r["all"] else 0.0
            got = (1 - max(0.0, base - share) if prior >= ACCEPT else share) * (r["same"] / n) if n else 0.0
            if (got * n + prior) / (n + 1) >= ACCEPT:
                keep += d
        found[s] = (keep, sum(r["pairs"] for r in by.values()) * 2 > sum(r["n"] for r in by.values()))
    return found


def split_packed(df: DataFrame, cell: str, source: str, keep: list[str]) -> DataFrame:
    """One row (source, *keep, pos, item) per value of the packed column `cell`.

    Delimiters are inferred per value of `source`. Null, blank and unusable cells give no rows; empty pieces give none and
    take no position; repeated values keep their own positions; a source whose cells are mostly key-count pairs gives
    key=count. A null source is a source of its own. An empty table gives no rows. Columns other than those named are
    dropped. The split itself is one narrow pass.
    """
    found = infer_delimiters(df, cell, source)
    got = F.lit(None).cast("array<string>")
    text = _inner(usable(cell))
    plans: dict[tuple[str, bool], list] = {}
    for s, plan in found.items():
        plans.setdefault(plan, []).append(s)
    for (delims, pairs), names in plans.items():
        x = _pieces(_marked(text, delims), delims)
        x = F.transform(x, _pair_or_value if pairs else _value)
        s = F.col(source)
        match = s.isin(*[n for n in names if n is not None]) if any(n is not None for n in names) else F.lit(False)
        if None in names:
            match = s.isNull() | F.coalesce(match, F.lit(False))
        got = F.when(match, F.filter(x, lambda v: v != "")).otherwise(got)
    return df.select(source, *keep, F.posexplode(got).alias("_pos", "item")).select(source, *keep, (F.col("_pos") + 1).alias("pos"), "item")
