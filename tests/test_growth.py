"""What a step costs: how often a value is worked out, and how rows are dealt."""

from __future__ import annotations

import datetime as dt
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from eventlode.functions import dates
from eventlode.functions import rule_tables as R
from eventlode.operators import classify, resolve, rollup, similarity, writes
from eventlode.operators.dealt import left_dealt
from eventlode.plans import ingest, registry
from eventlode.sources import nested

SF = "/root/testdata/sf0.001"
RULES = [("a", ["0"]), ("b", ["1"]), ("c", ["2"])]


def test_rules_work_their_text_out_once_a_row(spark):
    number = F.monotonically_increasing_id().cast("string")  # the next number each time it is evaluated
    row = spark.range(1).coalesce(1).select(classify.keyword_types(number, RULES).alias("all"), classify.keyword_type(number, RULES[1:]).alias("first")).head()
    assert row["all"] == ["a"] and row["first"] is None


def test_keyword_rules_keep_their_order_and_nulls(spark):
    df = spark.createDataFrame([("x2 1 0",), ("2",), ("none",), (None,)], "t string").coalesce(1)
    got = df.select(classify.keyword_types(F.col("t"), RULES).alias("all"), classify.keyword_type(F.col("t"), RULES).alias("first")).collect()
    assert [(r["all"], r["first"]) for r in got] == [(["a", "b", "c"], "a"), (["c"], "c"), ([], None), ([], None)]


def test_a_rollup_of_scattered_ids_takes_no_more_than_a_number_per_id(spark):
    ids = [-70_000, -1, *range(0, 64), *(k * 40_000 for k in range(1, 100))]
    df = spark.createDataFrame([(dt.date(2024, 1, 1 + i % 2), i) for i in ids], "day date, id long")
    daily = rollup.daily(df, "day", [], {"id": "id"})
    assert daily.count() <= len(ids) and dict(daily.dtypes)["bitmap"] == "bigint"
    assert rollup.distinct_in(daily, {"all": F.lit(True), "first": F.col("day") == F.lit(dt.date(2024, 1, 1))}, []).collect() == [("id", len(ids), sum(i % 2 == 0 for i in ids))]


def _most_in_a_task(df):
    sums = df.withColumn("_task", F.spark_partition_id()).groupBy("_task").agg(F.count(F.lit(1)).alias("n"), F.max("venue_id").alias("v"))  # the id, so that the join stays
    return max(r["n"] for r in sums.collect())


def test_rows_without_a_key_are_spread(spark):
    events = spark.range(4000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 50 == 0, F.lit(None).cast("long")).otherwise(F.col("id")).alias("venue_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("venue_name"))
    venues = spark.range(4000).select((F.col("id") + 10_000).alias("venue_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("venue_name"))
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
            spark.conf.set(k, v)
        placed = writes.orphans_placed(events, venues)
        assert _most_in_a_task(placed) < 2000  # of four tasks
        assert placed.filter("venue_id <> event_id").count() == 80 and placed.filter("venue_id = event_id + 10000").count() == 80
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "event_id long, k string")
    assert sorted(tuple(r) for r in left_dealt(odd, spark.createDataFrame([(None, 7), ("", 8)], "k string, v int"), "k", "event_id").select("event_id", "k", "v").collect()) == [(1, None, None), (2, "", 8), (3, "x", None)]


def _uses(spark, value) -> int:
    """How often the plan of the value has the number that stands for its text."""
    return spark.range(1).select(value.alias("v"))._jdf.queryExecution().optimizedPlan().toString().count("monotonically_increasing_id")


def test_patterns_work_their_text_out_once_a_row(spark):
    number = F.monotonically_increasing_id().cast("string")
    assert _uses(spark, classify.pattern_type(number, [("a", ["^5$"]), ("b", ["^1$"]), ("c", ["^2$"])])) == 1


def test_patterns_that_begin_words_find_the_same_together():
    rng = random.Random(5)
    tables = [p for rules in (R.REFINED_TYPES, R.CORRECTED, R.LOCAL_TYPES) for *_, p in rules] + [[r"\ba|b"], [r"\b\(x|y\)"], [r"\ba(b|c)d"]]
    words = ["jazz", "techno", "abd", "(x", "y)", "xb", "hip hop", "&", "Opera", "r&b & hip", "rock-n", "play", "theatre", "90s", "bass"]
    for _ in range(300):
        text = rng.choice(["", " ", "-"]).join(rng.choices(words, k=rng.randint(1, 4)))
        for parts in tables:
            assert bool(re.search(classify._alternatives(parts), text)) == any(re.search("(?i)" + p, text) for p in parts), (parts, text)


def test_only_artists_near_the_name_reach_python(spark):
    rng = random.Random(6)
    pick = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 24)))
    rows = [(a, "".join(c for c in a if rng.random() > 0.1) if rng.random() < 0.5 else pick()) for a in (pick() for _ in range(400))]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", similarity.may_share(F.col("a"), F.col("b"), 0.85)).collect()
    assert all(may for a, b, may in got if SequenceMatcher(None, a, b).ratio() > 0.85) and not all(may for *_, may in got)
    events = df.select(F.monotonically_increasing_id().alias("event_id"), F.col("b").alias("name"), F.col("a").alias("artist_name"))
    out = classify.cleaned_artists(events, df.select(F.lit("v").alias("venue_name")))
    assert "seq_ratio(CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()
    like = {r["event_id"] for r in out.filter("reason = 'fuzzy_match_event_name'").collect()}
    want = {r["event_id"] for r in events.collect() if (a := r["artist_name"].strip(" ")) and a != (n := r["name"].strip(" ")) and SequenceMatcher(None, a, n).ratio() > 0.85}
    assert like == want


def test_dates_work_their_text_out_once_a_row(spark):
    assert _uses(spark, dates.any_date(F.monotonically_increasing_id().cast("string"), dt.date(2024, 1, 1))) == 1


def test_channels_and_sides_read_their_lists_once_a_row(spark):
    n = F.monotonically_increasing_id().cast("string")
    assert _uses(spark, nested.channels(n, F.lit("[]"), F.lit("US"))) == 1
    assert _uses(spark, nested.sides(n)) == 1


@pytest.mark.parametrize("query", ["q18_dedup_job", "q19_ingest", "q19_ingest_known"])
def test_jobs_derive_their_events_once(spark, query):
    """What the steps of a job share is written once; before, each step joined the lines and orders again."""
    read = registry.queries()[query](spark, SF).inputFiles()
    assert read and not any(f.endswith(("lineitem.parquet", "orders.parquet")) for f in read)


def test_an_ingest_folds_its_records_once(spark):
    number = F.monotonically_increasing_id().cast("string")
    stored = spark.createDataFrame([(1, "s", "0", "A", "V", dt.date(2024, 1, 1), None, None, None, None)], "event_id long, source string, source_id string, name string, venue_name string, start_date date, start_time string, end_date date, end_time string, price double")
    raw = spark.range(0, 3, 1, 1).select(F.col("id").alias("arrival"), F.lit("s").alias("source"), number.alias("source_id"), F.lit("B").alias("name"), F.lit("W").alias("venue_name"), F.lit(dt.date(2024, 1, 1)).alias("start_date"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("date").alias("end_date"), F.lit(None).cast("string").alias("end_time"), F.lit(1.0).alias("price"))
    out = ingest.ingest(stored, raw)
    assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["event_id"], r["name"], r["price"]) for r in out.collect()) == [(1, "A", 1.0), (2, "B", 1.0)]


def test_only_clusters_of_several_events_are_merged(spark):
    """An event that has no duplicate passes as it is; before, all events were sorted by cluster and merged."""
    rows = [(1, 1, "Jazz night", None), (2, 1, "Jazz nights", "L2"), (3, 1, "Opera", None), (4, None, "Jazz night", "L4"), (5, 2, "Jazz night", "")]
    events = spark.createDataFrame(rows, "event_id long, venue_id long, name string, purchase_link string").selectExpr("*", "date'2024-01-01' AS start_date", "'other' AS scrape_source", "0.0D AS price", "CAST(NULL AS string) AS price_currency", "CAST(NULL AS string) AS image_url", "CAST(NULL AS string) AS start_time", "CAST(NULL AS string) AS artist_name", "'d' AS description")
    kept, counts = resolve.dedup(events)
    assert sorted((r["event_id"], r["purchase_link"]) for r in kept.collect()) == [(2, "L2"), (3, None), (4, "L4"), (5, "")]
    assert [tuple(r) for r in counts.collect()] == [(1, 1)]
    assert "Union" in kept._jdf.queryExecution().optimizedPlan().toString()
