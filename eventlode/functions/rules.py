"""Ordered rule tables compiled into Column expressions: the first rule that fires decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """rules: (substring, result) in order, over text with a space on each side; spaces in a substring count."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    out: Column | None = None
    for part, result in rules:
        hit = padded.contains(part.lower())
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def first_pattern(text: Column, rules: list[tuple[list[str], str]], default: str | None = None) -> Column:
    """rules: (patterns, result); the patterns of a rule become one alternation, whatever case."""
    out: Column | None = None
    for patterns, result in rules:
        hit = F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, result) if out is None else out.when(hit, result)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def some_matches(text: Column, rules: list[tuple[str, str]], most: int = 2) -> Column:
    """The first few different results of all rules that fire, in rule order."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    hits = F.array(*[F.when(padded.contains(p.lower()), F.lit(r)) for p, r in rules])
    return F.slice(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())), 1, most)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value by lower-cased key; null for unknown keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(key)) if table else F.lit(None).cast("string")


def longest_key(text: Column, table: dict[str, str]) -> Column:
    """Value of the longest key that the text holds."""
    return first_match(text, sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0])))


def priority(sport: Column, performer_type: Column, venue_default: Column, from_rules: Column, compat: bool = True) -> Column:
    """Event type: sport, then performer, venue default, rules. compat lets a known performer's type override the sport's."""
    return F.coalesce(performer_type, sport, venue_default, from_rules) if compat else F.coalesce(sport, performer_type, venue_default, from_rules)
