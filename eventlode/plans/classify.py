"""Classification queries: every rule table over events whose names Spark derives from the catalog's tables.

The derived events take their words from SAMPLES by key, so that every kind of rule has something to decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.functions import rule_tables as R
from eventlode.operators import classify
from eventlode.plans.book import Book
from eventlode.sources import bind

BOOK = Book()

SAMPLES = [
    "late jazz trio", "Techno all night", "Somos Rock live", "symphony no. 5", "Lions vs. Tigers basketball", "a play on stage", "NBA - finals", "hip-hop summit", "comedy night out", "indie dance party", "Carmen opera gala", "Bears vs Wolves",
    "salsa workshop", "street food fair", "poetry slam", "Beethoven and Mozart overture", "phantom of the opera", "punk and metal", "wine tasting dinner", "city marathon 10k", "Premier League - derby", "board game meetup", "museum exhibition", "DJ set b2b",
    "book launch reading", "country music hall", "Hawks vs. Owls tennis", "country soul funk orchestra", "nothing of note", "hackathon for developers", "La Liga - clasico", "gospel choir",
]
CATEGORIES = [*R.CATEGORY_TYPES, "Unknown"]
NAMES = sorted({t for t, _ in [*R.NAME_TYPES, *R.VENUE_TYPES, *R.KEYWORD_TYPES, *R.REFINED_TYPES]} | set(R.CATEGORY_TYPES.values()) | {"Concert", "Sports Event"})
TAGS = ["progressive rock", "jazz", "deep house", "music", "folk", "opera", "sound", "hip hop", "modern", "west end", "latin pop", "choir", "rhythm", "stand-up"]


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def _keywords(text: str, rules: list[tuple[str, list[str]]]) -> str:
    rows = ", ".join("{'k': '" + k.replace("'", "''") + "', 't': '" + t.replace("'", "''") + "'}" for t, ks in rules for k in ks)
    return f"list_transform(list_filter([{rows}], lambda r: contains({text}, r.k)), lambda r: r.t)"


def _patterns(text: str, rules: list[tuple]) -> str:
    quote = lambda s: s.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{quote('|'.join(f'(?:{p})' for p in parts))}', 'i') THEN '{quote(name)}'" for *_, name, parts in rules) + " END"


def _cases(text: str, values: dict[str, str]) -> str:
    quote = lambda s: s.replace("'", "''")
    return f"CASE {text} " + " ".join(f"WHEN '{quote(k)}' THEN '{quote(v)}'" for k, v in values.items()) + " END"


_NAMED = f"""
, kinds AS (SELECT p_partkey::BIGINT AS type_id, {_list(NAMES)}[1 + p_partkey % {len(NAMES)}] AS type_name, {_list(CATEGORIES)}[1 + p_partkey % {len(CATEGORIES)}] AS category FROM part WHERE (p_partkey % {len(NAMES)}) % 3 <> 0),
acts AS (SELECT event_id, sport AS stored_sport, {_list(SAMPLES)}[1 + event_id % {len(SAMPLES)}] || ' ' || event_id AS name, CASE WHEN event_id % 5 = 0 THEN {_list(SAMPLES)}[1 + (event_id + 7) % {len(SAMPLES)}] END AS description,
  CASE WHEN event_id % 11 = 0 THEN 'Blue Jazz Club' WHEN event_id % 13 = 0 THEN 'Opera House' ELSE venue_name END AS venue_name, city_name AS venue_city, {_list(CATEGORIES)}[1 + event_id % {len(CATEGORIES)}] AS category,
  CASE WHEN event_id % 3 = 0 THEN artist_name END AS artist_name, {_list([*R.SOURCE_TYPES, "leaan", "other"])}[1 + event_id % {len(R.SOURCE_TYPES) + 2}] AS source
  FROM ev JOIN venues USING (venue_id) JOIN cities USING (city_id) LEFT JOIN artists USING (event_id))
"""


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with the names of the rules, two thirds of them, so that some rules have no type to give."""
    p = bind.table(spark, sf_dir, "part").filter((F.col("p_partkey") % len(NAMES)) % 3 != 0)
    return p.select(F.col("p_partkey").cast("long").alias("type_id"), _pick(NAMES, F.col("p_partkey")).alias("type_name"), _pick(CATEGORIES, F.col("p_partkey")).alias("category"))


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bind.catalog_events(spark, sf_dir).join(bind.venues(spark, sf_dir), "venue_id").join(bind.cities(spark, sf_dir), "city_id").join(bind.event_artists(spark, sf_dir), "event_id", "left")
    i = F.col("event_id")
    return e.select(
        "event_id",
        F.col("sport").alias("stored_sport"),
        F.concat(_pick(SAMPLES, i), F.lit(" "), i.cast("string")).alias("name"),
        F.when(i % 5 == 0, _pick(SAMPLES, i + 7)).alias("description"),
        F.when(i % 11 == 0, "Blue Jazz Club").when(i % 13 == 0, "Opera House").otherwise(F.col("venue_name")).alias("venue_name"),
        F.col("city_name").alias("venue_city"),
        _pick(CATEGORIES, i).alias("category"),
        F.when(i % 3 == 0, F.col("artist_name")).alias("artist_name"),
        _pick([*R.SOURCE_TYPES, "leaan", "other"], i).alias("source"),
    )


_RESOLVED = f"""
, t AS (SELECT *, lower(concat_ws(' ', nullif(venue_name, ''), nullif(venue_city, ''))) AS v, ' ' || lower(coalesce(name, '')) || ' ' || lower(left(coalesce(description, ''), 400)) || ' ' AS x FROM asked),
known_types AS (SELECT list(DISTINCT type_name) AS existing FROM kinds),
any_ AS (SELECT category, arg_min(type_name, type_id) AS any_type FROM kinds GROUP BY 1),
resolved AS (SELECT t.*, coalesce(list_filter(list_concat({_keywords('v', R.VENUE_TYPES)}, CASE WHEN contains(x, ' vs ') OR contains(x, ' vs. ') THEN ['Sports Event'] ELSE [] END, {_keywords('x', R.NAME_TYPES)}, [{_cases('t.category', R.CATEGORY_TYPES)}]), lambda r: r IS NOT NULL AND list_contains(existing, r))[1], any_type) AS type_name
  FROM t CROSS JOIN known_types LEFT JOIN any_ ON any_.category = t.category)
"""


@BOOK.add(f"{_NAMED.rstrip()}\n, asked AS (SELECT * FROM acts)\n{_RESOLVED.strip()}\nSELECT event_id, type_name FROM resolved")
def c02_resolve_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.resolve_types(acts(spark, sf_dir), kinds(spark, sf_dir)).select("event_id", "type_name")


_RAW = "CASE WHEN event_id % 4 = 0 THEN ['Nothing', category] WHEN event_id % 4 = 1 THEN [category] END"


@BOOK.add(f"""{_NAMED.rstrip()}
, people AS (SELECT lower(s_name) AS name_key, {_list(NAMES)}[1 + s_suppkey % {len(NAMES)}] AS type_name, 'Music' AS category FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT lower(s_name), NULL, 'Comedy' FROM supplier WHERE s_suppkey % 3 = 1),
own AS (SELECT *, CASE WHEN stored_sport IS NOT NULL THEN 'Basketball' END AS sport, CASE WHEN event_id % 6 = 0 THEN 'Murals' END AS default_type, {_RAW} AS raw_categories FROM acts),
asked AS (SELECT event_id, name, description, venue_name, venue_city, 0 AS p, sport AS category FROM own WHERE sport IS NOT NULL
  UNION ALL SELECT event_id, name, description, venue_name, venue_city, 1, 'Sports' FROM own WHERE sport IS NOT NULL
  UNION ALL SELECT event_id, name, description, venue_name, venue_city, 2, people.category FROM own JOIN people ON name_key = lower(trim(artist_name)) WHERE people.type_name IS NULL
  UNION ALL SELECT event_id, name, description, venue_name, venue_city, 2 + i, raw_categories[i] FROM own, range(1, 3) r(i) WHERE i <= len(raw_categories))
{_RESOLVED.strip()}
, best AS (SELECT event_id, arg_min(type_name, p) FILTER (WHERE p < 2) AS s, max(type_name) FILTER (WHERE p = 2) AS c, arg_min(type_name, p) FILTER (WHERE p > 2) AS r FROM resolved WHERE type_name IS NOT NULL GROUP BY 1)
SELECT own.event_id, coalesce(CASE WHEN people.name_key IS NOT NULL THEN CASE WHEN people.type_name IS NOT NULL THEN CASE WHEN people.type_name IN (SELECT type_name FROM kinds) THEN people.type_name END ELSE c END ELSE s END, default_type, r) AS type_name
FROM own LEFT JOIN people ON name_key = lower(trim(artist_name)) LEFT JOIN best USING (event_id)""")
def c01_assign_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sports, performers, venue defaults and raw categories over all derived events."""
    i = F.col("event_id")
    s = bind.table(spark, sf_dir, "supplier")
    people = s.filter("s_suppkey % 3 < 2").select(F.lower("s_name").alias("name_key"), F.when(F.col("s_suppkey") % 3 == 0, _pick(NAMES, F.col("s_suppkey"))).alias("type_name"), F.when(F.col("s_suppkey") % 3 == 0, "Music").otherwise("Comedy").alias("category"))
    own = acts(spark, sf_dir).withColumns({"sport": F.when(F.col("stored_sport").isNotNull(), "Basketball"), "default_type": F.when(i % 6 == 0, "Murals"), "raw_categories": F.when(i % 4 == 0, F.array(F.lit("Nothing"), "category")).when(i % 4 == 1, F.array("category"))})
    return classify.assign_types(own, people, kinds(spark, sf_dir)).select("event_id", "type_name")


_FOREIGN = [f"{s}|{k}" for s, m in R.CATEGORY_MAPS.items() for k in list(m)[:9]] + ["eventbrite|Other", "nobody|Music"]


@BOOK.add(f"""{_NAMED.rstrip()}
, f AS (SELECT event_id, {_list(_FOREIGN)}[1 + event_id % {len(_FOREIGN)}] AS f FROM acts)
SELECT event_id, {_cases('f', {f'{s}|{k}': v for s, m in R.CATEGORY_MAPS.items() for k, v in m.items()})} AS category FROM f""")
def c03_category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = acts(spark, sf_dir).select("event_id", F.split(_pick(_FOREIGN, F.col("event_id")), r"\|").alias("f"))
    return rows.select("event_id", classify.map_category(F.get("f", F.lit(0)), F.get("f", F.lit(1))).alias("category"))


_TAG_SQL = "CASE " + " ".join(
    f"WHEN list_has_any(low, {_list(ks)}) OR list_has_any(words, {_list(ks)}) OR list_has_any(low, {_list([w for k in ks for w in k.split()])}) THEN '{t}'" for t, ks in R.TAG_TYPES
) + " END"


@BOOK.add(f"""{_NAMED.rstrip()}
, g AS (SELECT event_id, [lower({_list(TAGS)}[1 + event_id % {len(TAGS)}]), lower({_list(TAGS)}[1 + (event_id * 3 + 1) % {len(TAGS)}])] AS low FROM acts),
h AS (SELECT *, string_split(array_to_string(low, ' '), ' ') AS words FROM g)
SELECT event_id, {_TAG_SQL} AS tag_type, {_keywords("array_to_string(low, chr(10))", R.GENRE_TYPES)}[1] AS genre_type, coalesce({_keywords("array_to_string(low, ' ')", R.GENRE_CATEGORIES)}[1], 'Music') AS genre_category FROM h""")
def c04_tag_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by tags and by genres, and the category by genres, of two tags an event."""
    i = F.col("event_id")
    rows = acts(spark, sf_dir).select("event_id", F.array(_pick(TAGS, i), _pick(TAGS, i * 3 + 1)).alias("tags"))
    return rows.select("event_id", classify.tag_type(F.col("tags")).alias("tag_type"), classify.genre_type(F.col("tags")).alias("genre_type"), classify.genre_category(F.col("tags")).alias("genre_category"))


_LONGEST = classify.longest_first(R.KEYWORD_TYPES)
_WORDS = "lower(concat_ws(' ', nullif(name, ''), nullif(venue_name, ''), nullif(description, '')))"


@BOOK.add(f"{_NAMED.rstrip()}\nSELECT event_id, {_keywords(_WORDS, _LONGEST)}[1] AS type_name FROM acts")
def c07_keyword_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.lower(F.concat_ws(" ", "name", "venue_name", "description"))
    return acts(spark, sf_dir).select("event_id", classify.keyword_type(words, _LONGEST).alias("type_name"))


@BOOK.add(f"""{_NAMED.rstrip()}
, people AS (SELECT lower(s_name) AS name_key, min({_list(NAMES)}[1 + s_suppkey % {len(NAMES)}]) AS performer FROM supplier WHERE s_suppkey % 2 = 0 AND {_list(NAMES)}[1 + s_suppkey % {len(NAMES)}] IN (SELECT type_name FROM kinds) GROUP BY 1),
k AS (SELECT a.*, performer, {_keywords(_WORDS, _LONGEST)}[1] AS w, (SELECT min(type_name) FROM kinds WHERE type_name IN ('Concert', 'Pop Concert')) AS concert FROM acts a LEFT JOIN people ON name_key = lower(trim(artist_name))),
o AS (SELECT *, CASE WHEN performer IS NOT NULL THEN 'performer_hit' WHEN nullif(trim(artist_name), '') IS NOT NULL AND concert IS NOT NULL THEN 'music_default' WHEN w IN (SELECT type_name FROM kinds) THEN 'keyword_hit' ELSE 'no_match' END AS how FROM k)
SELECT event_id, how, CASE how WHEN 'performer_hit' THEN performer WHEN 'music_default' THEN concert WHEN 'keyword_hit' THEN w END AS type_name FROM o""")
def c08_two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bind.table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0")
    people = s.select(F.lower("s_name").alias("name_key"), _pick(NAMES, F.col("s_suppkey")).alias("type_name"))
    return classify.two_pass_types(acts(spark, sf_dir), people, kinds(spark, sf_dir)).select("event_id", "how", "type_name")


_ALL = "concat_ws(' ', nullif(name, ''), nullif(artist_name, ''), nullif(description, ''))"


@BOOK.add(f"""{_NAMED.rstrip()}
, many AS (SELECT type_id, CASE WHEN type_id % 2 = 0 THEN 'Concert' ELSE type_name END AS type_name FROM kinds),
own AS (SELECT event_id, type_id FROM bridge WHERE type_id % 5 = 0),
sole AS (SELECT event_id FROM own GROUP BY 1 HAVING count(*) = 1 AND min(type_id) IN (SELECT type_id FROM many WHERE type_name = 'Concert')),
r AS (SELECT event_id, {_patterns(_ALL, R.REFINED_TYPES)} AS type_name FROM acts WHERE event_id IN (SELECT event_id FROM sole))
SELECT event_id, type_name FROM r WHERE type_name IN (SELECT type_name FROM many)""")
def c09_refine_concerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose only type is the generic one; every fifth bridge row, and half of the types generic."""
    many = kinds(spark, sf_dir).withColumn("type_name", F.when(F.col("type_id") % 2 == 0, "Concert").otherwise(F.col("type_name")))
    return classify.refine_generic(acts(spark, sf_dir), bind.event_event_types(spark, sf_dir).filter("type_id % 5 = 0"), many)


_LOCAL = "concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(venue_name, ''))"


@BOOK.add(f"""{_NAMED.rstrip()}
SELECT event_id, CASE source WHEN 'barby' THEN 'Concert' WHEN 'tel_aviv_venues' THEN 'Concert' WHEN 'cameri' THEN 'Play / Drama' WHEN 'leaan' THEN {_patterns(_LOCAL, R.LOCAL_TYPES)} END AS type_name FROM acts""")
def c10_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acts(spark, sf_dir).select("event_id", classify.source_type(F.col("source"), F.concat_ws(" ", "name", "description", "venue_name")).alias("type_name"))


@BOOK.add(f"""{_NAMED.rstrip()}
SELECT event_id, CASE WHEN NOT regexp_matches({_ALL}, '{'|'.join(f'(?:{p})' for p in R.CONFIRMED)}', 'i') THEN {_patterns(_ALL, R.CORRECTED)} END AS type_name FROM acts""")
def c11_corrected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acts(spark, sf_dir).select("event_id", classify.corrected_type(F.concat_ws(" ", "name", "artist_name", "description")).alias("type_name"))


_TYPED = "SELECT *, [CASE WHEN event_id % 2 = 0 THEN 'Rock Concert' ELSE 'Art Fairs' END] AS types, [CASE WHEN event_id % 7 = 0 THEN 'Sports' ELSE 'Music' END] AS categories, NULL::VARCHAR AS link, stored_sport AS sport FROM acts"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return acts(spark, sf_dir).withColumns({"types": F.array(F.when(i % 2 == 0, "Rock Concert").otherwise("Art Fairs")), "categories": F.array(F.when(i % 7 == 0, "Sports").otherwise("Music")), "link": F.lit(None).cast("string"), "sport": F.col("stored_sport")})


@BOOK.add(f"""{_NAMED.rstrip()}
, o AS ({_TYPED}),
h AS (SELECT *, sport IS NULL AND (name ILIKE '% vs %' OR name ILIKE '% vs. %') AND NOT list_contains(categories, 'Sports') AS hit, {_keywords('lower(name)', [(f'{s}|{t}', [k]) for k, s, t in R.VERSUS_SPORTS])}[1] AS k FROM o)
SELECT event_id, hit AS repaired, CASE WHEN hit THEN split_part(k, '|', 1) ELSE sport END AS sport, CASE WHEN hit THEN coalesce(nullif(split_part(k, '|', 2), ''), 'Sports Event') ELSE types[1] END AS type_name, CASE WHEN NOT hit THEN artist_name END AS artist_name,
  CASE WHEN hit THEN 'https://www.youtube.com/results?search_query=' || replace(regexp_replace(name, ' vs\\.? ', ' vs '), ' ', '+') || '+highlights' END AS link FROM h""")
def c12_versus_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.repair_versus(_typed(spark, sf_dir)).select("event_id", "repaired", "sport", F.get("types", F.lit(0)).alias("type_name"), "artist_name", "link")


@BOOK.add(f"""{_NAMED.rstrip()}
, o AS ({_TYPED}),
h AS (SELECT *, CASE WHEN contains(name, ' - ') THEN {_cases("lower(split_part(name, ' - ', 1))", {k.lower(): s for k, (s, _) in R.LEAGUE_SPORTS.items()})} END AS s, {_cases("lower(split_part(name, ' - ', 1))", {k.lower(): t for k, (_, t) in R.LEAGUE_SPORTS.items()})} AS t FROM o)
SELECT event_id, s IS NOT NULL AS repaired, coalesce(s, sport) AS sport, CASE WHEN s IS NULL THEN types[1] WHEN types[1] = 'Rock Concert' THEN t ELSE types[1] || ',' || t END AS type_names, CASE WHEN s IS NULL THEN artist_name END AS artist_name,
  CASE WHEN s IS NOT NULL AND event_id % 3 <> 0 THEN 'https://www.youtube.com/results?search_query=Home+%26+Co+vs+Away+' || event_id || '+highlights' END AS link FROM h""")
def c13_league_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = _typed(spark, sf_dir).withColumns({"home_team": F.when(i % 3 != 0, "Home & Co"), "away_team": F.concat(F.lit("Away "), i.cast("string"))})
    return classify.repair_leagues(rows, ["Rock Concert"]).select("event_id", "repaired", "sport", F.array_join("types", ",").alias("type_names"), "artist_name", "link")


@BOOK.add(f"""{_NAMED.rstrip()}
, x AS (SELECT *, lower(name || ' ' || coalesce(description, '')) AS t FROM acts),
g AS (SELECT *, list_distinct({_keywords('t', R.GROUP_CATEGORIES)}) AS u, {_keywords('t', R.GROUP_CATEGORIES)} AS f FROM x)
SELECT event_id, coalesce(f[1], 'Technology') AS first_group, len(u) AS n_group, {_keywords('t', R.CALENDAR_CATEGORIES)}[1] AS calendar, coalesce({_keywords('t', R.TAG_CATEGORIES)}[1], 'Music') AS tagged, {_keywords('t', R.DESCRIPTION_CATEGORIES)}[1] AS described FROM g""")
def c17_keyword_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by the keywords of four kinds of sources."""
    t = F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit(""))))
    group = classify.keyword_categories(t, R.GROUP_CATEGORIES, 2, "Technology")
    return acts(spark, sf_dir).select(
        "event_id",
        F.get(group, F.lit(0)).alias("first_group"),
        F.size(F.array_distinct(classify.keyword_types(t, R.GROUP_CATEGORIES))).cast("long").alias("n_group"),
        classify.keyword_type(t, R.CALENDAR_CATEGORIES).alias("calendar"),
        F.coalesce(classify.keyword_type(t, R.TAG_CATEGORIES), F.lit("Music")).alias("tagged"),
        classify.keyword_type(t, R.DESCRIPTION_CATEGORIES).alias("described"),
    )


@BOOK.add(f"""{_NAMED.rstrip()}
SELECT event_id, CASE WHEN stored_sport IS NOT NULL THEN coalesce({_keywords('lower(name)', [(s, [k]) for k, s in R.SEGMENT_SPORTS])}[1], 'Sports') END AS sport FROM acts""")
def c18_segment_sport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acts(spark, sf_dir).select("event_id", classify.segment_sport(F.col("name"), F.col("stored_sport").isNotNull()).alias("sport"))


@BOOK.add(f"""{_NAMED.rstrip()}
SELECT event_id, {_list(NAMES)}[1 + s_suppkey % {len(NAMES)}] AS type_name FROM acts JOIN supplier ON lower(s_name) = lower(artist_name) WHERE s_suppkey % 2 = 0""")
def c19_from_performers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bind.table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0")
    return classify.from_performers(acts(spark, sf_dir), s.select(F.lower("s_name").alias("name_key"), _pick(NAMES, F.col("s_suppkey")).alias("type_name")))


@BOOK.add(f"""{_NAMED.rstrip()}
SELECT coalesce({_patterns(_ALL, R.REFINED_TYPES)}, 'unchanged') AS type_name, count(*) AS n FROM acts GROUP BY 1""")
def a20_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each refining rule decides."""
    return classify.breakdown(acts(spark, sf_dir).select(classify.pattern_type(F.concat_ws(" ", "name", "artist_name", "description"), R.REFINED_TYPES).alias("type_name")), "type_name")


@BOOK.add("""
, lg AS (SELECT s_name AS label, s_nationkey % 5 AS c, [(s_nationkey + 1) % 5, s_nationkey % 5] AS extra FROM supplier)
SELECT DISTINCT country, label FROM (SELECT r_regionkey, r_name AS country FROM region) JOIN lg ON c = r_regionkey OR list_contains(extra, r_regionkey)""")
def p23_leagues_of_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as leagues of their nation's region, by number, and of the next one."""
    r = bind.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("country"), F.col("r_name"))
    s = bind.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("label"), (F.col("s_nationkey") % 5).alias("country"), F.array(((F.col("s_nationkey") + 1) % 5).cast("int")).alias("extra"))
    return classify.leagues_of(r, s).join(r, "country").select(F.col("r_name").alias("country"), "label")


_AREAS = {"Jazz": "cellar", "Blue Jazz": "old town", "Opera": "square", "House": "suburb"}


@BOOK.add(f"{_NAMED.rstrip()}\nSELECT event_id, CASE WHEN contains(venue_name, 'Blue Jazz') THEN 'old town' WHEN contains(venue_name, 'Opera') THEN 'square' WHEN contains(venue_name, 'House') THEN 'suburb' WHEN contains(venue_name, 'Jazz') THEN 'cellar' END AS area FROM acts")
def j14_longest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acts(spark, sf_dir).select("event_id", classify.longest_lookup(F.col("venue_name"), _AREAS).alias("area"))


@BOOK.add(f"{_NAMED.rstrip()}\nSELECT event_id FROM acts WHERE contains(lower(name), 'premier league') OR lower(venue_city) IN ('nation_3', 'nation_4')")
def c21_home_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.at_home(acts(spark, sf_dir).withColumn("teams", F.array("venue_city")), "name", "teams", ["premier league"], ["nation_3", "nation_4"]).select("event_id")


@BOOK.add(f"""{_NAMED.rstrip()}
SELECT event_id, category, row_number() OVER (PARTITION BY category, venue_city ORDER BY event_id) = 1 AS kept FROM acts""")
def w06_first_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of a category in a city is kept, the rest go to the audit."""
    return classify.first_of_each(acts(spark, sf_dir), ["category", "venue_city"], ["event_id"]).select("event_id", "category", "kept")


@BOOK.add("""
SELECT o_orderkey::BIGINT AS event_id, CASE o_orderkey % 6 WHEN 5 THEN 'Fresh ' || o_orderkey WHEN 4 THEN 'Fresh ' || o_orderkey END AS artist_name,
 ['exact_match_event_name', 'too_long', 'matches_venue_name', 'junk_keyword', 'kept_first_of_multi', NULL][1 + o_orderkey % 6] AS reason FROM orders""", catalog=False)
def c20_cleaned_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One artist of each kind in turn; the resembling kind is held by a test."""
    o, k = bind.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    fresh = F.concat(F.lit("Fresh "), k.cast("string"))
    kinds_ = [F.lit("AN EVENING OF WORDS "), F.repeat(F.lit("long "), 30), F.col("c_name"), F.lit("Acme Presents"), F.concat(fresh, F.lit(" b2b Other")), fresh]
    artist = F.get(F.array(*kinds_), (k % 6).cast("int"))
    rows = o.join(bind.table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(k.cast("long").alias("event_id"), F.lit("An evening of words").alias("name"), artist.alias("artist_name"))
    return classify.cleaned_artists(rows, bind.venues(spark, sf_dir))


GENRES = ["Deep House", "uk grime", "neo soul", "Swing revival", "delta blues", "chamber music", "italian opera", "Bluegrass gospel", "indie folk", "roots reggae", "black metal", "k-pop", "stand-up comedy", "spoken word", "vaporwave", "latin jazz", "classical piano"]


@BOOK.add(f"""
, g AS (SELECT event_id, {_list(GENRES)}[event_id % {len(GENRES)} + 1] AS first, CASE WHEN event_id % 5 <> 0 THEN {_list(GENRES)}[event_id // {len(GENRES)} % {len(GENRES)} + 1] END AS second FROM ev),
t AS (SELECT event_id, lower(concat_ws(chr(10), first, second)) AS lines, lower(concat_ws(' ', first, second)) AS line FROM g)
SELECT event_id, {_keywords("lines", R.GENRE_TYPES)}[1] AS genre_type, coalesce({_keywords("line", R.GENRE_CATEGORIES)}[1], 'Music') AS genre_category FROM t""")
def c05_genre_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and category of an artist's genres: the first rule that any of them has a word of."""
    key = F.col("event_id")
    second = F.when(key % 5 != 0, _pick(GENRES, F.floor(key / len(GENRES))))
    genres = F.array_compact(F.array(_pick(GENRES, key), second))
    return bind.catalog_events(spark, sf_dir).select("event_id", classify.genre_type(genres).alias("genre_type"), classify.genre_category(genres).alias("genre_category"))
