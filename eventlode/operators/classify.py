"""Classification by ordered rules: the first rule that matches gives the type. All compiled to Column expressions.

Rule tables are parameters; those in use are in eventlode.functions.rule_tables. A null text matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlode.functions import names
from eventlode.functions import rule_tables as R
from eventlode.functions import text as T
from eventlode.operators.dealt import left_dealt
from eventlode.operators.similarity import may_reach, may_share, seq_ratio

Keywords = list[tuple[str, list[str]]]


def _text(*parts: Column) -> Column:
    """The non-blank parts with spaces between."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def keyword_types(text: Column, rules: Keywords) -> Column:
    """The types of all rules of which the text has a keyword, in order of the rules. The rules are one constant array."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for t, ks in rules for k in ks])
    return T.once(text, lambda x: F.transform(F.filter(table, lambda r: F.contains(x, r["k"])), lambda r: r["t"]))


def first_of(types: Column, existing: Column | None = None) -> Column:
    """The first type, or the first of those that exist."""
    return F.get(types if existing is None else F.filter(types, lambda t: F.array_contains(existing, t)), F.lit(0))


def keyword_type(text: Column, rules: Keywords, existing: Column | None = None) -> Column:
    """The first of these types. Without a list of those that exist, the rules after the first that matches are not looked at."""
    if existing is not None:
        return first_of(keyword_types(text, rules), existing)
    return T.once(text, lambda x: F.coalesce(*[F.when(T.any_of([F.contains(x, F.lit(k)) for k in ks]), t) for t, ks in rules]))


def pattern(parts: list[str]) -> str:
    return "(?is)" + "|".join(f"(?:{p})" for p in parts)


def pattern_type(text: Column, rules: list[tuple]) -> Column:
    """The type (last but one of each rule's fields) of the first rule of which a pattern is found; case does not count."""
    return T.once(text, lambda x: F.coalesce(*[F.when(x.rlike(_alternatives(parts)), name) for *_, name, parts in rules]))


def _alternatives(parts: list[str]) -> str:
    """One pattern of several; where all begin at a word's edge, other places are not tried for each of them."""
    if all(p.startswith(r"\b") and r"\(" not in p and "|" not in re.sub(r"\(.*?\)", "", p) for p in parts):
        return r"(?i)\b(?:" + "|".join(f"(?:{p[2:]})" for p in parts) + ")"
    return "(?i)" + "|".join(f"(?:{p})" for p in parts)


def map_category(source: Column, foreign: Column, maps: dict[str, dict[str, str]] | None = None) -> Column:
    """The own category of a source's category; unknown sources and names give null."""
    maps = R.CATEGORY_MAPS if maps is None else maps
    return _lookup({f"{s}\0{k}": v for s, m in maps.items() for k, v in m.items()}, F.concat(source, F.lit("\0"), foreign))


def tag_type(tags: Column, rules: Keywords | None = None) -> Column:
    """A rule matches if a keyword is a tag, a word of a tag, or has a tag as a word."""
    low = F.transform(tags, F.lower)
    words = F.flatten(F.transform(low, lambda t: F.split(t, r"\s+")))
    out = None
    for name, keys in R.TAG_TYPES if rules is None else rules:
        whole = F.array(*map(F.lit, keys))
        parts = F.array(*[F.lit(w) for k in keys for w in k.split()])
        hit = F.arrays_overlap(low, whole) | F.arrays_overlap(words, whole) | F.arrays_overlap(low, parts)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def genre_type(genres: Column, rules: Keywords | None = None) -> Column:
    """By parts of genres: the first keyword that any genre has in it."""
    return keyword_type(F.array_join(F.transform(genres, F.lower), "\n"), R.GENRE_TYPES if rules is None else rules)


def genre_category(genres: Column) -> Column:
    return F.coalesce(keyword_type(F.array_join(F.transform(genres, F.lower), " "), R.GENRE_CATEGORIES), F.lit("Music"))


def existing_types(types: DataFrame, rules: list[Keywords]) -> DataFrame:
    """One row: those of the rules' types that the table of types has, as an array; bounded by the rules."""
    named = sorted({t for r in rules for t, _ in r} | set(R.CATEGORY_TYPES.values()) | {"Sports Event", "Concert", "Pop Concert"})
    return types.filter(F.col("type_name").isin(named)).agg(F.collect_set("type_name").alias("existing"))


def _with_choices(events: DataFrame, types: DataFrame) -> DataFrame:
    """The events with `_existing`, `_any` (a type of each category) and `_worded`: the first type that their words give.

    Both lists are one row, bounded by the rules and by the number of categories."""
    first = types.filter(F.col("category").isNotNull()).groupBy("category").agg(F.min_by("type_name", "type_id").alias("t"))
    any_ = first.agg(F.map_from_entries(F.collect_list(F.struct("category", "t"))).alias("_any"))
    venue = F.lower(_text(F.col("venue_name"), F.col("venue_city")))
    text = F.concat(F.lit(" "), F.lower(F.coalesce("name", F.lit(""))), F.lit(" "), F.lower(F.left(F.coalesce("description", F.lit("")), F.lit(400))), F.lit(" "))
    versus = F.when(F.contains(text, F.lit(" vs ")) | F.contains(text, F.lit(" vs. ")), F.array(F.lit("Sports Event"))).otherwise(F.expr("cast(array() as array<string>)"))
    worded = first_of(F.concat(F.coalesce(keyword_types(venue, R.VENUE_TYPES), F.expr("cast(array() as array<string>)")), versus, keyword_types(text, R.NAME_TYPES)), F.col("_existing"))
    known = existing_types(types, [R.VENUE_TYPES, R.NAME_TYPES]).withColumnRenamed("existing", "_existing")
    return events.crossJoin(F.broadcast(known)).crossJoin(F.broadcast(any_)).withColumn("_worded", worded)


def _type_of(category: Column) -> Column:
    """For rows with choices: the type by words, else the category's usual type if that exists, else any of the category."""
    usual = _lookup(R.CATEGORY_TYPES, category)
    return F.coalesce("_worded", F.when(F.array_contains("_existing", usual), usual), F.try_element_at("_any", category))


def resolve_types(events: DataFrame, types: DataFrame) -> DataFrame:
    """events: name, description, venue_name, venue_city, category. Adds type_name: by the venue's words, "vs", the name's
    and the description's words, the category's usual type, any type of the category; only types that the table `types`
    (type_id, type_name, category) has."""
    return _with_choices(events, types).withColumn("type_name", _type_of(F.col("category"))).drop("_existing", "_any", "_worded")


def longest_first(rules: Keywords) -> Keywords:
    """Rules in the order of their longest keyword, longest first; equal ones stay in order."""
    return sorted(rules, key=lambda r: -max(map(len, r[1])))


def two_pass_types(events: DataFrame, performers: DataFrame, types: DataFrame) -> DataFrame:
    """events: name, venue_name, description, artist_name. Adds type_name and how: by performer (name_key, type_name), the
    generic concert where there is an artist, keywords, or nothing, which leaves the event as it is."""
    rules = longest_first(R.KEYWORD_TYPES)
    artist = F.nullif(F.trim("artist_name"), F.lit(""))
    known = performers.join(types.select("type_name").distinct(), "type_name", "left_semi").groupBy(F.col("name_key").alias("_key")).agg(F.min("type_name").alias("_performer"))
    rows = left_dealt(events.withColumn("_key", T.key_lower_collapse(F.col("artist_name"))), known, "_key", "event_id").crossJoin(F.broadcast(existing_types(types, [rules])))
    concert = F.when(artist.isNotNull(), first_of(F.array(F.lit("Concert"), F.lit("Pop Concert")), F.col("existing")))
    words = F.lower(_text(F.col("name"), F.col("venue_name"), F.col("description")))
    # the first type of all that match decides; if it does not exist, nothing does
    by_word = F.get(F.filter(F.array(first_of(keyword_types(words, rules))), lambda t: F.array_contains("existing", t)), F.lit(0))
    how = F.when(artist.isNotNull() & F.col("_performer").isNotNull(), "performer_hit").when(concert.isNotNull(), "music_default").when(by_word.isNotNull(), "keyword_hit").otherwise("no_match")
    return rows.withColumn("how", how).withColumn("type_name", F.when(F.col("how") == "performer_hit", F.col("_performer")).when(F.col("how") == "music_default", concert).when(F.col("how") == "keyword_hit", by_word)).drop("_key", "_performer", "existing")


def refine_generic(events: DataFrame, bridge: DataFrame, types: DataFrame, generic: str = "Concert") -> DataFrame:
    """event_id, type_name: the finer type of events whose only type is the generic one; types that don't exist are left out.

    events: event_id, name, artist_name, description; bridge: event_id, type_id."""
    sole = bridge.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("type_id").alias("type_id")).filter("n = 1").join(types.filter(F.col("type_name") == generic), "type_id", "left_semi").select("event_id")
    rows = events.join(sole, "event_id", "left_semi").select("event_id", pattern_type(_text(F.col("name"), F.col("artist_name"), F.col("description")), R.REFINED_TYPES).alias("type_name"))
    return rows.join(types.select("type_name").distinct(), "type_name", "left_semi").select("event_id", "type_name")


def source_type(source: Column, text: Column) -> Column:
    """A source's only type, or for the source whose texts are in two languages the type of its patterns."""
    return F.coalesce(_lookup({k: t for k, (_, t) in R.SOURCE_TYPES.items()}, source), F.when(source == "leaan", pattern_type(text, R.LOCAL_TYPES)))


def corrected_type(text: Column) -> Column:
    """The type that corrects a wrong "symphony"; null where a pattern confirms it or none corrects."""
    return F.when(~text.rlike(pattern(R.CONFIRMED)), pattern_type(text, R.CORRECTED))


def keyword_categories(text: Column, rules: Keywords, most: int, default: str) -> Column:
    """Up to `most` different categories by keyword, in order of the rules, or the default."""
    found = F.slice(F.array_distinct(keyword_types(text, rules)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def segment_sport(name: Column, is_sports: Column) -> Column:
    """The sport of a name in a sports segment, "Sports" where it doesn't tell."""
    return F.when(is_sports, F.coalesce(keyword_type(F.lower(name), [(s, [k]) for k, s in R.SEGMENT_SPORTS]), F.lit("Sports")))


def highlights_link(home: Column, away: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/results?search_query="), F.url_encode(F.concat(F.trim(home), F.lit(" vs "), F.trim(away), F.lit(" highlights"))))


def repair_versus(events: DataFrame) -> DataFrame:
    """Rows "X vs Y" without a sport and without a sports type: sport, no artist, the sports type alone, a link where there is none.

    events: name, sport, artist_name, types (array of type names), categories (array), link. Other rows pass; adds `repaired`."""
    low = F.lower("name")
    open_ = (F.col("name").ilike("% vs %") | F.col("name").ilike("% vs. %")) & F.col("sport").isNull() & ~F.coalesce(F.array_contains("categories", "Sports"), F.lit(False))
    kinds = [(f"{s}\0{t}", [k]) for k, s, t in R.VERSUS_SPORTS]
    kind = F.split(keyword_type(low, kinds), "\0")
    sides = F.split("name", F.when(F.contains(low, F.lit(" vs. ")), r"(?i) vs\. ").otherwise("(?i) vs "), 2)
    hit = F.coalesce(open_, F.lit(False))
    return events.withColumns(
        {
            "repaired": hit,
            "link": F.when(hit & T.blank(F.col("link")), highlights_link(F.get(sides, F.lit(0)), F.get(sides, F.lit(1)))).otherwise(F.col("link")),
            "types": F.when(hit, F.array(F.coalesce(F.get(kind, F.lit(1)), F.lit("Sports Event")))).otherwise(F.col("types")),
            "sport": F.when(hit, F.get(kind, F.lit(0))).otherwise(F.col("sport")),
            "artist_name": F.when(~hit, F.col("artist_name")),
        }
    )


def repair_leagues(events: DataFrame, music_types: list[str]) -> DataFrame:
    """Rows named "LEAGUE - ...": the league's sport and type, no artist, no music or comedy types, a link where both teams are known.

    events: name, sport, artist_name, types (array), home_team, away_team, link. Labels are matched whole, so one lookup does."""
    label = F.lower(F.split_part("name", F.lit(" - "), F.lit(1)))
    has = F.contains(F.col("name"), F.lit(" - "))
    table = {k.lower(): v for k, v in R.LEAGUE_SPORTS.items()}
    sport = F.when(has, _lookup({k: s for k, (s, _) in table.items()}, label))
    kind = _lookup({k: t for k, (_, t) in table.items()}, label)
    hit = sport.isNotNull()
    kept = F.array_except("types", F.array(*map(F.lit, music_types)))
    return events.withColumns(
        {
            "repaired": hit,
            "types": F.when(hit, F.array_union(kept, F.array(kind))).otherwise(F.col("types")),
            "link": F.when(hit & T.blank(F.col("link")) & ~T.blank(F.col("home_team")) & ~T.blank(F.col("away_team")), highlights_link(F.col("home_team"), F.col("away_team"))).otherwise(F.col("link")),
            "sport": F.coalesce(sport, "sport"),
            "artist_name": F.when(~hit, F.col("artist_name")),
        }
    )


def assign_types(events: DataFrame, performers: DataFrame, types: DataFrame, compat: bool = True) -> DataFrame:
    """The priority chain: sport, performer, venue default, then the source's categories. Adds type_name.

    events: event_id, name, description, venue_name, venue_city, sport, artist_name, default_type, raw_categories (array).
    performers: name_key, type_name, category. compat: a performer overrides the sport's type, even with nothing where its
    own type is unknown; else sports events keep theirs.
    """
    known = types.groupBy(F.col("type_name").alias("_name")).agg(F.lit(True).alias("_known"))
    people = performers.groupBy("name_key").agg(F.min(F.struct("type_name", "category")).alias("_p")).join(known, F.col("_p.type_name") == F.col("_name"), "left").drop("_name")
    rows = _with_choices(left_dealt(events.withColumn("name_key", F.lower(F.trim("artist_name"))), people, "name_key", "event_id"), types)
    by_sport = F.when(F.col("sport").isNotNull(), F.coalesce(_type_of(F.col("sport")), _type_of(F.lit("Sports"))))
    own, own_category = F.col("_p.type_name"), F.col("_p.category")
    by_performer = F.when(~T.blank(own), F.when(F.col("_known"), own)).otherwise(F.when(own_category.isNotNull(), _type_of(own_category)))
    by_raw = F.get(F.filter(F.transform(F.filter("raw_categories", lambda c: c.isNotNull()), _type_of), lambda t: t.isNotNull()), F.lit(0))
    has_rule = F.col("_p").isNotNull() & (~T.blank(own) | ~T.blank(own_category))
    overrides = has_rule if compat else has_rule & F.col("sport").isNull()
    first = F.when(overrides, by_performer).otherwise(by_sport)
    return rows.withColumn("type_name", F.coalesce(first, "default_type", by_raw)).drop("name_key", "_p", "_known", "_existing", "_any", "_worded")


def from_performers(events: DataFrame, performers: DataFrame) -> DataFrame:
    """event_id, type_name: the type of the performer whose name is the artist's, by the collapsed lower-case name."""
    known = performers.filter(F.col("type_name").isNotNull()).groupBy("name_key").agg(F.min("type_name").alias("type_name"))
    return events.withColumn("name_key", T.key_lower_collapse(F.col("artist_name"))).join(known, "name_key").select("event_id", "type_name")


def breakdown(outcomes: DataFrame, by: str) -> DataFrame:
    """How many rows each rule decided."""
    return outcomes.groupBy(F.coalesce(F.col(by), F.lit("unchanged")).alias(by)).agg(F.count(F.lit(1)).alias("n"))


def leagues_of(countries: DataFrame, leagues: DataFrame) -> DataFrame:
    """country, label: the leagues that apply in a country, its own or one that names it among its extra ones.

    leagues: label, country, extra (array): a small table, exploded to one row per country before an equi-join."""
    each = leagues.select("label", F.explode(F.array_union(F.array("country"), F.coalesce("extra", F.expr("cast(array() as array<string>)")))).alias("country"))
    return countries.select("country").distinct().join(each, "country")


def at_home(df: DataFrame, series: str, teams: str, keywords: list[str], names: list[str]) -> DataFrame:
    """Matches of a country: a keyword in the series, or one of its teams playing."""
    text = F.lower(F.coalesce(F.col(series), F.lit("")))
    hit = T.any_of([F.contains(text, F.lit(k)) for k in keywords])
    return df.filter(hit | F.coalesce(F.arrays_overlap(F.transform(teams, F.lower), F.array(*map(F.lit, names))), F.lit(False)))


def longest_lookup(text: Column, table: dict[str, str]) -> Column:
    """The value of the longest key that is part of the text; equal lengths in order."""
    return keyword_type(text, [(v, [k]) for k, v in sorted(table.items(), key=lambda kv: -len(kv[0]))])


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; the others come back with the reason, for the audit."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).withColumn("kept", F.col("_r") == 1).withColumn("reason", F.when(~F.col("kept"), "duplicate in file")).drop("_r")


def cleaned_artists(events: DataFrame, venue_names: DataFrame, least: float = 0.85) -> DataFrame:
    """event_id, artist_name, reason: what a clean-up makes of artists. An artist that equals or resembles the event's name, is over
    120 characters, is a venue's name or a promoter goes; of several the first stays. Rows without an artist are left out.

    Only artists of nearly the name's length go through Python."""
    artist, name = F.trim("artist_name"), F.lower(F.trim("name"))
    known = venue_names.select(F.lower("venue_name").alias("_v")).distinct()
    rows = events.filter(artist != "").withColumn("_a", artist).withColumn("_l", F.lower("_a")).join(known, F.col("_l") == F.col("_v"), "left")
    # a condition around a Python function keeps no row from it, a null argument does
    near = F.when(may_reach(F.col("_l"), name, least) & (F.col("_l") != name) & may_share(F.col("_l"), name, least), F.col("_l"))
    like = F.coalesce(seq_ratio(near, name) > least, F.lit(False))
    first = names.first_artist(F.col("_a"))
    one = F.coalesce((first != F.col("_a")) & (F.length(first) >= 2) & ~names.is_promoter(first), F.lit(False))
    reason = F.when(F.col("_l") == name, "exact_match_event_name").when(like, "fuzzy_match_event_name").when(F.length("_a") > 120, "too_long").when(F.col("_v").isNotNull(), "matches_venue_name").when(names.is_promoter(F.col("_a")), "junk_keyword").when(one, "kept_first_of_multi")
    judged = rows.select("event_id", "_a", first.alias("_f"), reason.alias("reason"))
    return judged.select("event_id", F.when(F.col("reason").isNull(), F.col("_a")).when(F.col("reason") == "kept_first_of_multi", F.col("_f")).alias("artist_name"), "reason")
