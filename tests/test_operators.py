"""Functions and operators on small inputs with known results."""

import datetime as dt
import gzip
import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from eventlode.functions import dates, rules
from eventlode.functions import text as T
from eventlode.operators import export, resolve, similarity, upsert
from eventlode.sources import pages, tables
from eventlode.streaming import ingest

TODAY = dt.date(2026, 5, 10)


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_word_matching(spark):
    names = ["Rock", "Rock Night", "Hard Rock Cafe", "Rocket", "A rock", "Art", "Start", "Art Fair", None, "100% art"]
    assert values(spark, names, lambda c: T.word_match(c, "rock")) == [True, True, True, True, True, False, False, False, None, False]
    assert values(spark, names, lambda c: T.word_match(c, "art")) == [False, False, False, False, False, True, False, True, None, True]
    assert values(spark, ["100% a", "100 a", "a\\b"], lambda c: T.contains_ci(c, "0%", escape=True)) == [True, False, False]
    assert values(spark, ["a\\b"], lambda c: T.contains_ci(c, "a\\b")) == [True]


def test_prices_and_currencies(spark):
    assert values(spark, ["from $1,250.50 up", "free", None, "€ 7", "£5-9"], T.price_of) == [1250.5, None, None, 7.0, 5.0]
    assert values(spark, ["$5", "£5", "5 €", "5"], T.currency_of) == ["USD", "GBP", "EUR", None]


def test_names(spark):
    df = spark.createDataFrame([("Band @ Hall", None), ("Band @ Hall", "Club"), ("Band", None), ("A vs. B", None), ("A vs B", None)], "n string, v string")
    assert [tuple(r) for r in df.select(*T.name_and_venue(F.col("n"), F.col("v"))).collect()] == [("Band", "Hall"), ("Band", "Club"), ("Band", None), ("A vs. B", None), ("A vs B", None)]
    assert [tuple(r) for r in df.select(*T.versus(F.col("n"))).collect()][3:] == [("A", "B"), ("A", "B")]


def test_percentages_and_popularity(spark):
    row = spark.range(1).select(T.percent(F.lit(1), F.lit(8)).alias("a"), T.percent(F.lit(3), F.lit(0)).alias("b"), T.popularity_tenths(F.lit(55)).alias("c"), T.popularity_tenths(F.lit(2)).alias("d"), T.popularity_tenths(F.lit(0)).alias("e")).first()
    assert tuple(row) == (12, 0, round(5.5), 1, None)


@pytest.mark.parametrize(
    ("text", "want"),
    [("2026-06-01T20:00Z", dt.date(2026, 6, 1)), ("May 1st, 2027", dt.date(2027, 5, 1)), ("12 Aug 2026", dt.date(2026, 8, 12)), ("3.7.26", dt.date(2026, 7, 3)), ("31/12/2026", dt.date(2026, 12, 31)), ("1.2", dt.date(2027, 2, 1)), ("30/02/2026", None), ("soon", None), (None, None)],
)
def test_dates(spark, text, want):
    assert values(spark, [text], lambda c: dates.any_date(c, TODAY)) == [want]


def test_clock_and_end(spark):
    assert values(spark, ["at 9:05", "25:00", "20:61", "doors 19:30!"], dates.clock) == ["09:05", None, None, "19:30"]
    df = spark.createDataFrame([(TODAY, "23:30", None), (TODAY, None, dt.date(2026, 6, 1)), (TODAY, "bad", dt.date(2026, 6, 1))], "d date, t string, e date")
    assert [tuple(r) for r in df.select(*dates.default_end(F.col("d"), F.col("t"), F.col("e"))).collect()] == [(dt.date(2026, 5, 11), "01:30"), (dt.date(2026, 6, 1), None), (dt.date(2026, 6, 1), None)]
    assert spark.range(1).select(dates.season_years(F.lit(7), F.lit(2026)).alias("a")).first().a == [2026, 2025]


def test_rules(spark):
    table = [("jazz", "Jazz"), (" art ", "Art"), ("rock", "Rock")]
    assert values(spark, ["Jazz rock", "start", "ART", None], lambda c: rules.first_match(c, table, "Other")) == ["Jazz", "Other", "Art", "Other"]
    assert values(spark, ["jazz rock art"], lambda c: rules.some_matches(c, table)) == [["Jazz", "Art"]]
    assert values(spark, ["The XYZ Tour", "none"], lambda c: rules.first_pattern(c, [(["\\bxyz\\b", "abc"], "hit")])) == ["hit", None]
    assert values(spark, ["the big hall here"], lambda c: rules.longest_key(c, {"hall": "short", "big hall": "long"})) == ["long"]
    assert values(spark, ["ROCK", "x"], lambda c: rules.lookup(c, {"rock": "Music"})) == ["Music", None]


def test_structured_pages(spark):
    ld = [{"@graph": [{"@type": "MusicEvent", "name": "A", "startDate": "2026-06-01"}, {"@type": "Place", "name": "P"}]}, {"@type": "ItemList", "itemListElement": [{"item": {"@type": "Event", "name": "B"}}]}, {"@type": "Event", "name": "old", "startDate": "2020-01-01"}]
    html = "".join(f'<script type="application/ld+json">{json.dumps(x)}</script>' for x in ld) + '<script type="application/ld+json">{bad</script>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    out = pages.ld_events(df, "html", "page_id", F.lit(TODAY)).collect()
    assert sorted((r.page_id, r.name, r.start_date) for r in out) == [(1, "A", "2026-06-01"), (1, "B", None)]


def test_offers(spark):
    offers = json.dumps({"offers": [{"price": "9", "priceCurrency": "EUR", "availability": "http://x/SoldOut"}, {"price": "12.5", "priceCurrency": "USD"}, {"lowPrice": "10", "priceCurrency": "GBP"}]})
    assert [tuple(v) if v else v for v in values(spark, [offers, '{"offers": {"price": "3", "priceCurrency": "EUR"}}', "{}"], pages.cheapest_offer)] == [(10.0, "GBP"), (3.0, "EUR"), None]


def test_page_parts(spark):
    html = '<title>Gig - Site</title><meta content="Site" property="og:site_name"><h1 class=x>Big <b>Gig</b> Night</h1><script>x</script><p>Hi&amp;<!-- c --></p>"videoId":"abcdefghijk"'
    assert values(spark, [html], pages.title) == ["Site"] and values(spark, ["<title>Gig - Site | Y</title>"], pages.title) == ["Gig"]
    assert values(spark, [html], pages.heading) == ["Big Gig Night"] and values(spark, [html], pages.video_id) == ["abcdefghijk"]
    assert values(spark, ["a &amp; b &#233;"], pages.unescaped) == ["a & b é"]
    assert values(spark, ['```json\n{"a": [1]}\n```', "none"], pages.json_in) == ['{"a": [1]}', None]
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long na\r\n me\r\nDTSTART;VALUE=DATE:20260601\r\nEND:VEVENT\r\n"
    assert [tuple(x) for x in values(spark, [ics], pages.ics_events)[0]] == [("1", "Long name", "20260601", None)]


def test_tiers(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (2, 3, "c"), (1, 1, "d")], "v int, tier int, x string")
    assert sorted(r.x for r in pages.first_tier(df, "v", "tier").collect()) == ["b", "c", "d"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Name, City\n x ,\n,\ny,Z\n".encode())
    assert [tuple(r) for r in tables.csv_table(spark, str(tmp_path / "a.csv")).collect()] == [("x", None), ("y", "Z")]
    (tmp_path / "b.json").write_text('{"items": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "c.json").write_text('[{"a": 3}]')
    assert [r.a for f in "bc" for r in tables.json_rows(spark, str(tmp_path / f"{f}.json"), "items", "struct<a:int>").collect()] == [1, 2, 3]
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        json.dump({"version": 1, "artists": [{"name": "q"}]}, f)
    assert [r.name for r in tables.bundle(spark, str(tmp_path / "d.json.gz"), "artists").collect()] == ["q"]


def test_ratio_keeps_its_direction(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), (None, "a"), ("abc", "abc")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(similarity.seq_ratio("a", "b")).collect()] == [0.25, 0.5, None, 1.0]
    assert values(spark, ["  Éa  Ñ ", None], similarity.unaccented) == ["ea n", None]


def test_greedy_clusters(spark):
    names = ["the big show", "the big show!", "another gig", "big show", "the bag show", None, ""]
    rows = [(i, 1, TODAY, n) for i, n in enumerate(names)] + [(50, None, TODAY, "the big show"), (51, 2, TODAY, "the big show")]
    df = spark.createDataFrame(rows, "id long, v int, d date, n string").repartition(3)
    got = {r.id: r.cluster for r in similarity.greedy_clusters(df, ["v", "d"], "id", "n").collect()}
    clusters, want = [], {50: 50, 51: 51}
    for i, n in enumerate(names):
        n = (n or "").lower()
        for head, members in clusters:
            if any(SequenceMatcher(None, n, m).ratio() > 0.80 for m in members):
                members.append(n)
                want[i] = head
                break
        else:
            clusters.append((i, [n]))
            want[i] = i
    assert got == want


def test_keepers_and_merges(spark):
    df = spark.createDataFrame([(1, 1, "a", None, 1), (2, 1, None, 5.0, 9), (3, 2, "", None, 1)], "id long, c int, link string, price double, p int")
    out = {r.id: (r.link, r.price, r.n_members) for r in resolve.keepers(df, "c", "id", F.col("p"), ["link", "price"]).collect()}
    assert out == {2: ("a", 5.0, 2), 3: (None, None, 1)} or out == {2: ("a", 5.0, 2), 3: ("", None, 1)}
    venues = spark.createDataFrame([(1, "x", 3), (2, "x", 5), (3, "y", 0), (4, None, 1), (5, None, 1)], "id long, k string, w int")
    merges = resolve.canonical(venues, ["k"], "id", "w")
    assert sorted(tuple(r) for r in merges.collect()) == [(1, 2), (5, 4)]
    assert sorted(r.id for r in resolve.without(venues, "id", merges).collect()) == [2, 3, 4]
    assert sorted(r.v for r in resolve.repointed(spark.createDataFrame([(1,), (3,), (5,)], "v long"), "v", merges).collect()) == [2, 3, 4]


def test_upsert_is_idempotent(spark):
    current = spark.createDataFrame([(1, None, "a"), (2, 2.0, "b")], "id long, price double, name string")
    raw = spark.createDataFrame([(1, 1, None, "z"), (2, 1, 7.0, "y"), (3, 3, 9.0, "c"), (4, None, 1.0, "n")], "ord int, id long, price double, name string")
    delta = upsert.fold_delta(raw, ["id"], "ord")
    once = upsert.upsert(current, delta, ["id"], backfill=["price"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, 7.0, "a", "updated"), (2, 2.0, "b", "same"), (3, 9.0, "c", "inserted")]
    twice = upsert.upsert(once.drop("change"), delta, ["id"], backfill=["price"])
    assert {r.change for r in twice.collect()} == {"same"}


def test_new_ids_follow_the_largest(spark):
    current = spark.createDataFrame([(10, "a", 1)], "id long, name string, city int")
    wanted = spark.createDataFrame([("a", 1), ("c", 1), ("b", 1), ("b", 1), (None, 1)], "name string, city int")
    assert sorted((r.id, r.name) for r in upsert.find_or_create(current, wanted, ["name", "city"], "id").collect()) == [(10, "a"), (11, "b"), (12, "c")]


def test_calendar_text(spark):
    df = spark.createDataFrame([(7, "A, B; C\\\n" + "x" * 80, TODAY, "19:30", "Hall"), (8, None, TODAY, None, None)], "id int, n string, d date, t string, p string")
    a, b = (r[0] for r in df.select(export.ics_entry(F.col("id"), F.col("n"), F.col("d"), F.col("t"), F.col("p"))).collect())
    assert "SUMMARY:A\\, B\\; C\\\\\\n" in a and "DTSTART:20260510T193000\r\nDTEND:20260510T213000\r\nLOCATION:Hall" in a and max(map(len, a.split("\r\n"))) <= 75
    assert "SUMMARY:Untitled Event\r\nDTSTART;VALUE=DATE:20260510\r\nEND:VEVENT" in b
    assert [r.batch for r in export.batches(spark.range(5), ["id"], 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_stream_upserts_versions(spark, tmp_path):
    folder = tmp_path / "in"
    for i, rows in enumerate([[(0, 1, None)], [(1, 1, 5.0), (2, 2, 6.0)]]):
        spark.createDataFrame(rows, "ord int, id long, price double").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("ord int, id long, price double").parquet(str(folder))
    ingest.upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["id"], "ord", ["price"]).awaitTermination()
    assert sorted(tuple(r) for r in ingest.version_of(spark, str(tmp_path / "t"), 0).select("id", "price").collect()) == [(1, 5.0), (2, 6.0)]
    assert ingest.version_of(spark, str(tmp_path / "t"), -1) is None


def test_split_lists(spark):
    assert values(spark, [" a, b ,,c", ""], T.split_list) == [["a", "b", "c"], []]
    assert T.split_param(" a, ,b") == ["a", "b"]
