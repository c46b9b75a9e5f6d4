"""Rule tables compiled to columns: first match, last match, all matches. The tables are the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    out = F.lit(default)
    for name, when in reversed(rules):
        out = F.when(when, F.lit(name)).otherwise(out)
    return out


def last_match(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    return first_match(rules[::-1], default)


def all_matches(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(w, F.lit(False)), F.lit(n)) for n, w in rules]))


def patterns(text: Column, table: dict[str, str]) -> list[tuple[str, Column]]:
    """(name, condition) of each pattern, ignoring case; null text matches nothing."""
    t = F.coalesce(text, F.lit(""))
    return [(n, t.rlike("(?is)" + p)) for n, p in table.items()]


def sql_first(rules: list[tuple[str, str]], default: str = "null") -> str:
    return "case " + " ".join(f"when {c} then '{n}'" for n, c in rules) + f" else {default} end"


def sql_all(rules: list[tuple[str, str]]) -> str:
    """The names of the rules that hold, joined by ';'."""
    return "concat_ws(';', " + ", ".join(f"case when {c} then '{n}' end" for n, c in rules) + ")"
