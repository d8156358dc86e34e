"""Text predicates and normalizers as Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter terms must match a whole word, longer ones the start of a word.
WORD_START_LENGTH = 4


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once a row however often it is used: functions over arrays would else do so per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def split_param(text: str | None) -> list[str]:
    """A comma-separated parameter as its trimmed, non-empty parts."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def split_list(c: Column) -> Column:
    """The same for a column."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def like_escaped(term: str, escape: bool = False) -> str:
    """A term for LIKE: backslashes doubled always, wildcards escaped on demand."""
    term = term.replace("\\", "\\\\")
    return term.replace("%", "\\%").replace("_", "\\_") if escape else term


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)


def whole_word(c: Column, term: str, escape: bool = False) -> Column:
    t = like_escaped(term, escape)
    return any_of([c.ilike(p) for p in (t, f"{t} %", f"% {t} %", f"% {t}")])


def word_start(c: Column, term: str, escape: bool = False) -> Column:
    t = like_escaped(term, escape)
    return c.ilike(f"{t}%") | c.ilike(f"% {t}%")


def word_match(c: Column, term: str, escape: bool = False) -> Column:
    return word_start(c, term, escape) if len(term) >= WORD_START_LENGTH else whole_word(c, term, escape)


def contains_ci(c: Column, term: str, escape: bool = False) -> Column:
    return c.ilike(f"%{like_escaped(term, escape)}%")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def key_lower_strip(c: Column) -> Column:
    return F.lower(F.trim(c))


def key_lower_collapse(c: Column) -> Column:
    return F.lower(collapse_space(c))


def first_seen(c: Column) -> Column:
    return F.array_distinct(c)


def stable_id(*parts: Column, digest: str = "sha1") -> Column:
    """The first 16 hex digits of a digest of the parts, joined by bars."""
    seed = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha1(seed) if digest == "sha1" else F.md5(seed), 1, 16)


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def bare_host(url: Column) -> Column:
    """The host without a leading www. (a prefix, not a set of characters)."""
    return F.regexp_replace(F.lower(host(url)), r"^www\.", "")


def first_path_part(url: Column) -> Column:
    return F.nullif(F.split_part(F.try_parse_url(url, F.lit("PATH")), F.lit("/"), F.lit(2)), F.lit(""))


def price_of(text: Column) -> Column:
    """The first number of a price text, thousands marks dropped; no number gives null."""
    return F.regexp_replace(F.regexp_extract(text, r"(\d[\d,]*(?:\.\d{1,2})?)", 1), ",", "").try_cast("double")


def currency_of(text: Column) -> Column:
    return F.when(text.contains("$"), "USD").when(text.contains("£"), "GBP").when(text.contains("€"), "EUR")


def popularity_tenths(p: Column) -> Column:
    """0-100 to 1-10, halves to even; zero and null give null."""
    return F.when(p > 0, F.greatest(F.lit(1), F.bround(p / 10).cast("int")))


def percent(n: Column, total: Column) -> Column:
    """Whole percent, halves to even; 0 of nothing is 0."""
    return F.when(total > 0, F.bround(n * 100 / total).cast("long")).otherwise(F.lit(0).cast("long"))


def name_and_venue(name: Column, venue: Column) -> tuple[Column, Column]:
    """"A @ B" as name A, and venue B where none is known."""
    parts = F.split(name, " @ ", 2)
    two = F.size(parts) == 2
    return F.when(two, F.trim(F.get(parts, F.lit(0)))).otherwise(name), F.when(two & blank(venue), F.trim(F.get(parts, F.lit(1)))).otherwise(venue)


def versus(name: Column) -> tuple[Column, Column]:
    """Home and away of "X vs. Y"."""
    parts = F.split(name, r" vs\.? ", 2)
    two = F.size(parts) == 2
    return F.when(two, F.trim(F.get(parts, F.lit(0)))), F.when(two, F.trim(F.get(parts, F.lit(1))))


def price_or_free(text: Column) -> Column:
    """The first number, or 0 for "free"."""
    return F.coalesce(price_of(text), F.when(F.lower(text).contains("free"), 0.0))


def cents(n: Column) -> Column:
    """Hundredths as units; nothing and zero give null."""
    return F.when(n != 0, F.round(n.cast("decimal(18,4)") / 100, 2).cast("double"))


def percent_1(n: Column, total: Column) -> Column:
    """Percent with one decimal, halves away from zero in decimal arithmetic; 0 of nothing is 0."""
    return F.when(total > 0, F.round(n.cast("decimal(20,0)") * 100 / total.cast("decimal(20,0)"), 1).cast("double")).otherwise(F.lit(0.0))


#: Symbols of currencies; others are written by their code.
CURRENCY_SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "ILS": "₪", "JPY": "¥"}


def money(amount: Column, currency: Column) -> Column:
    """A whole amount with its sign, or its code, in front."""
    sign = F.create_map(*[F.lit(x) for kv in CURRENCY_SIGNS.items() for x in kv])[currency]
    return F.concat(F.coalesce(sign, F.concat(currency, F.lit(" "))), F.format_number(amount, 0))


def range_numbers(spec: Column) -> Column:
    """"7-10,15" as its sorted different numbers; parts that are neither a number nor a range are left out."""
    part = lambda p, i: F.regexp_extract(p, r"^\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?$", i)
    each = F.transform(F.split(spec, ","), lambda p: F.when((part(p, 1) != "") & (part(p, 2) == ""), F.array(part(p, 1).cast("int"))).when((part(p, 1) != "") & (part(p, 1).cast("int") <= part(p, 2).try_cast("int")), F.sequence(part(p, 1).cast("int"), part(p, 2).try_cast("int"))).otherwise(F.expr("cast(array() as array<int>)")))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def filled_line(template: Column, mark: str, line: Column) -> Column:
    """The template with the line that starts with the mark replaced, or the line added at its end."""
    has = template.rlike(rf"(?m)^{mark}.*$")
    return F.when(has, F.regexp_replace(template, F.lit(rf"(?m)^{mark}.*$"), F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))).otherwise(F.concat(template, F.lit("\n"), line))


def listed_json(values: Column) -> Column:
    """A list as JSON text; an empty one is null."""
    return F.when(F.size(values) > 0, F.to_json(values))


def json_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def place_matches(term: str, city: Column, country: Column) -> Column:
    """A term in the city, the country or "city, country"."""
    t = F.lit(term.lower().strip())
    return F.contains(F.lower(city), t) | F.contains(F.lower(country), t) | F.contains(F.lower(F.concat_ws(", ", city, country)), t)


def search_link(home: Column, away: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/results?search_query="), F.url_encode(F.concat(home, F.lit(" vs "), away, F.lit(" highlights"))))
