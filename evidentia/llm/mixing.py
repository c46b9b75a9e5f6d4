"""Mixing sources to target weights, measured in tokens of a public tokenizer."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.common import cut, spread

TOKENIZER = os.environ.get("EVIDENTIA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_LOADED: dict = {}


def _encoding(path: str):
    if path not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def n_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)


def source_key(c: Column | str) -> Column:
    """A source name, however spelled: lower case, blanks and hyphens as one underscore; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n"))), r"[\s\-_]+", "_")
    return F.when(x != "", x)


def rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """How often to take each source on average.

    total None: the largest mix in which every target source that has tokens reaches its share of the total exactly without passing its cap;
    the share of a source the corpus lacks is spread over the others in proportion. total given: shares of that many tokens, capped, what a
    capped source can't give being spread over the others in proportion until all are capped.
    """
    live = {s: (w, cap) for s, (w, cap) in targets.items() if tokens.get(s) and w > 0 and cap > 0}
    if not live:
        return {}
    weight = sum(w for w, _ in live.values())
    if total is None:
        total = min(cap * tokens[s] / (w / weight) for s, (w, cap) in live.items())
        return {s: min(cap, total * w / weight / tokens[s]) for s, (w, cap) in live.items()}
    got: dict[str, float] = {}
    left = float(total)
    while live:
        weight = sum(w for w, _ in live.values())
        over = [s for s, (w, cap) in live.items() if left * w / weight >= cap * tokens[s]]
        if not over:
            return got | {s: left * w / weight / tokens[s] for s, (w, _) in live.items()}
        for s in over:
            got[s] = float(live.pop(s)[1])
            left -= got[s] * tokens[s]
    return got


def mix(docs: DataFrame, targets: DataFrame, ident: str, text: str, source: str, total: float | None = None, seed: int = 17, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(copies, report). copies: (ident, source, tokens, copy_no), a row for each time a document is taken: floor(rate) times, and once more with
    the probability of the remainder, drawn by a hash of seed and id, so a rerun or a lost task gives the same rows.
    report: (source, target_share, max_repeats, docs, tokens, rate, most_copies, mixed_docs, mixed_tokens, mixed_share), a row for each source of
    the targets or the corpus; sources without a target are not taken.

    targets: (source, target_share, max_repeats), a row per source (repeated names: shares add up, the smaller cap holds); null or unusable
    numbers count as 0. Documents without source are not taken and reported under a null source; empty texts count no tokens but are taken at the
    rate of their source. Only per-source totals reach the driver, as many rows as targets has.
    """
    key = source_key(source)
    few = spread(docs.select(F.col(ident).alias("_id"), key.alias("_src"), F.col(text).alias("_t")))
    # written once: the totals, the draw and the report read the counts, not the texts again
    counted = cut(few.select("_id", "_src", n_tokens(F.col("_t"), path).alias("_n")))
    sums = counted.groupBy("_src").agg(F.count("*").alias("docs"), F.sum("_n").alias("tokens"))
    t = targets.select(source_key("source").alias("_src"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("w"), F.coalesce(F.col("max_repeats"), F.lit(0)).alias("cap"))
    t = t.where("_src is not null").groupBy("_src").agg(F.sum("w").alias("w"), F.min("cap").alias("cap"))
    have = {r["_src"]: (r["w"], r["cap"], r["tokens"] or 0) for r in t.join(sums, "_src", "left").collect()}
    rate = rates({s: x[2] for s, x in have.items()}, {s: x[:2] for s, x in have.items()}, total)
    r = F.lit(0.0)
    for s, x in sorted(rate.items()):
        r = F.when(F.col("_src") == s, F.lit(float(x))).otherwise(r)
    # 52 bits of the hash as a number in [0, 1)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_id")), 12) / F.lit(float(1 << 52))
    taken = counted.withColumn("_rate", r).withColumn("_copies", (F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int"))
    copies = taken.where("_copies > 0").select(F.col("_id").alias(ident), F.col("_src").alias("source"), F.col("_n").alias("tokens"), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy_no"))
    mixed = taken.groupBy("_src").agg(
        F.count("*").alias("docs"), F.sum("_n").alias("tokens"), F.max("_rate").alias("rate"), F.max("_copies").alias("most_copies"), F.sum("_copies").cast("bigint").alias("mixed_docs"), F.sum(F.col("_n") * F.col("_copies")).alias("mixed_tokens")
    )
    whole = mixed.agg(F.sum("mixed_tokens")).first()[0] or 0
    report = mixed.join(t, mixed["_src"].eqNullSafe(t["_src"]), "full_outer").select(
        F.coalesce(mixed["_src"], t["_src"]).alias("source"), F.col("w").alias("target_share"), F.col("cap").alias("max_repeats"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("docs", "tokens", "rate", "most_copies", "mixed_docs", "mixed_tokens")],
    )
    report = report.withColumn("mixed_share", F.col("mixed_tokens") / F.lit(float(whole)) if whole else F.lit(0.0))
    return copies, report
