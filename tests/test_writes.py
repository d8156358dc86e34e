"""Ingest survivors and the duplicates job against row loops; folding, files, deletes."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from eventlode.operators import export, resolve, similarity, writes

DAY = dt.date(2026, 6, 1)
WORDS = ["jazz", "night", "live", "show", "the", "big", "band", "summer", "gala", "trio"]


def _name(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))


def _ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def test_survivors_are_those_of_a_row_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hall", "club", "", None]), DAY, _name(rng).title(), i >= 60) for i in range(260)]
    kept, want = {}, set()
    for o, venue, day, name, new in rows:
        block = kept.setdefault((venue, day), [])
        if new and venue and any(_ratio(name, s) > 0.85 for s in block):
            continue
        block.append(name)
        if new:
            want.add(o)
    df = spark.createDataFrame(rows, "o long, venue string, day date, name string, new boolean").repartition(3)
    assert {r.o for r in similarity.survivors(df, ["venue", "day"], "o", "name", "new").collect()} == want


def test_a_dropped_row_drops_no_other(spark):
    stored = "abcdefghijklmnopqrst"
    a, b = "abcdefghijklmnopqrXY", "abcdefghijklmnopXYXY"
    assert _ratio(a, stored) > 0.85 >= _ratio(b, stored) and _ratio(b, a) > 0.85
    df = spark.createDataFrame([(1, "h", DAY, stored, False), (2, "h", DAY, a, True), (3, "h", DAY, b, True)], "o long, venue string, day date, name string, new boolean")
    assert [r.o for r in similarity.survivors(df, ["venue", "day"], "o", "name", "new").collect()] == [3]


EVENT = "event_id long, venue_id long, start_date date, name string, scrape_source string, price double, price_currency string, purchase_link string, image_url string, start_time string, artist_name string, description string"
FIELDS = ["purchase_link", "price", "image_url", "start_time", "artist_name", "description", "venue_id"]


def test_the_duplicates_job_is_a_row_loop(spark):
    rng = random.Random(2)
    maybe = lambda v: v if rng.random() < 0.5 else rng.choice([None, ""])
    names = [e.split() for e in EVENT.split(", ")]
    rows = []
    for i in range(150):
        price = rng.choice([None, 0.0, 5.0, 9.0])
        rows.append((i, rng.choice([1, 2, 3, None]), DAY + dt.timedelta(rng.randint(0, 2)), _name(rng), rng.choice(["ticketmaster", "bandsintown", "other", None]), price, "EUR" if price else None, maybe(f"l{i}"), maybe(f"i{i}"), maybe("20:00"), maybe(f"a{i}"), maybe("d")))
    events = [dict(zip([n for n, _ in names], r, strict=True)) for r in rows]
    blocks, kept, removed = {}, [], 0
    for e in events:
        if e["venue_id"] is None:
            kept.append(e)
        else:
            blocks.setdefault((e["venue_id"], e["start_date"]), []).append(dict(e))
    for own in blocks.values():
        clusters = []
        for e in own:
            for c in clusters:
                if any(_ratio(e["name"], m["name"]) > 0.8 for m in c):
                    c.append(e)
                    break
            else:
                clusters.append([e])
        for c in clusters:
            keeper = max(c, key=lambda e: ({"ticketmaster": 10, "bandsintown": 8}.get(e["scrape_source"] or "", 1), sum(bool(e[f]) for f in FIELDS)))
            for d in c:
                if d is not keeper:
                    removed += 1
                    for f in ("purchase_link", "image_url", "start_time", "artist_name"):
                        keeper[f] = keeper[f] or d[f] or keeper[f]
                    if not keeper["price"] and d["price"]:
                        keeper["price"], keeper["price_currency"] = d["price"], d["price_currency"]
            kept.append(keeper)
    out, counts = resolve.dedup(spark.createDataFrame(rows, EVENT).repartition(3))
    got = {r.event_id: r.asDict() for r in out.collect()}
    blank = lambda d: {k: (None if v == "" else v) for k, v in d.items()}
    assert {i: blank(d) for i, d in got.items()} == {e["event_id"]: blank(e) for e in kept}
    assert tuple(counts.first()) == (sum(len(b) > 1 for b in blocks.values()), removed)


def test_lines_fold_by_octets(spark):
    lines = ["short", "x" * 75, "x" * 76, "א" * 100, "a" + "é" * 200, None]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").orderBy("i").select(export.folded("x")).collect()]
    for line, out in zip(lines, got, strict=True):
        if line is None:
            assert out is None
            continue
        parts = out.split("\r\n ")
        assert "".join(parts) == line and all(len(p.encode()) + (i > 0) <= 75 for i, p in enumerate(parts))


def test_files_of_exports(spark, tmp_path):
    names = spark.createDataFrame([(f"n{i:03}",) for i in range(25)], "name string").repartition(3)
    export.write_batches(names, "name", ["name"], str(tmp_path / "b"), 10)
    back = spark.read.text(str(tmp_path / "b"))
    assert {(r.batch, r.value) for r in back.collect()} == {(i // 10, f"n{i:03}") for i in range(25)}
    taxonomy = spark.createDataFrame([("b", "P"), ("a", "P")], "sub_genre string, parent_genre string")
    export.write_bundle(names.withColumnRenamed("name", "normalized_name"), taxonomy, str(tmp_path / "z"))
    assert spark.read.json(str(tmp_path / "z" / "artists")).count() == 25 and spark.read.json(str(tmp_path / "z" / "meta")).first().version == 1
    for _ in range(2):
        export.log_searches(spark.createDataFrame([("q", "u" * 600)], "q string, user_agent string"), str(tmp_path / "l"), F.lit(dt.datetime(2026, 1, 1)))
    assert [len(r.user_agent) for r in spark.read.parquet(str(tmp_path / "l")).collect()] == [500, 500]
    kept, gone = export.with_audit(spark.createDataFrame([(1, None), (2, "bad")], "i int, reason string"))
    assert [r.i for r in kept.collect()] == [1] and [(r.i, r.reason) for r in gone.collect()] == [(2, "bad")]
    assert export.calendar_head("N", 6).split("\r\n")[3:] == ["X-WR-CALNAME:N", "REFRESH-INTERVAL;VALUE=DURATION:PT6H", "X-PUBLISHED-TTL:PT6H"]


def test_a_delete_needs_a_condition(spark):
    with pytest.raises(ValueError):
        writes.deletion(spark.range(3).withColumnRenamed("id", "event_id"), [])
    kept, gone, some = writes.deletion(spark.range(50).withColumnRenamed("id", "event_id"), [F.col("event_id") >= 10])
    assert kept.count() == 10 and gone.count() == 40 and some.count() == 20
