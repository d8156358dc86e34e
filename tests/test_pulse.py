"""Containment pairs, rollups, cursors and health streams against row loops."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlode.operators import contain, cursor, rollup
from eventlode.operators.bucketed import Conflict
from eventlode.streaming import health


def test_containing_pairs_are_all_pairs(spark):
    rng = random.Random(4)
    for _ in range(4):
        names = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9]))) for _ in range(60)]
        rows = [(i, rng.choice("xy"), n) for i, n in enumerate(names)] + [(90, None, "a"), (91, "x", None), (None, "x", "abc")]
        df = spark.createDataFrame(rows, "id long, g string, name string")
        want = Counter((g, i, j) for i, g, a in rows for j, h, b in rows if None not in (i, j, g, a, b) and g == h and b in a and (a != b or i < j))
        got = Counter(tuple(r) for r in contain.containing_pairs(df, F.col("id"), "g", F.col("name")).select("g", "holder", "held").collect())
        assert got == want
    assert contain.containing_pairs(df.limit(0), F.col("id"), "g", F.col("name")).count() == 0
    twice = contain.containing_pairs(spark.createDataFrame([(1, "x", "abcd"), (2, "x", "bcd"), (2, "x", "bcd"), (1, "x", "abcd")], df.schema), F.col("id"), "g", F.col("name"))
    assert [tuple(r) for r in twice.collect()] == [("x", 1, 2)] * 4


def test_containing_pairs_meet_by_gram_and_not_by_group_alone(spark):
    df = spark.createDataFrame([(i, "x", f"name {i * 7919}") for i in range(500)], "id long, g string, name string")
    plan = contain.containing_pairs(df, F.col("id"), "g", F.col("name"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rollups_count_distinct_ids_over_any_days(spark):
    rng, first = random.Random(8), dt.date(2024, 1, 1)
    rows = [(rng.choice([None, first + dt.timedelta(days=rng.randint(0, 9))]), rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 50), rng.randint(32_700, 32_800), 10**10]), rng.randint(0, 9)) for _ in range(800)]
    df = spark.createDataFrame(rows, "day date, src string, id long, venue int")
    parts = [rollup.daily(df.filter(F.col("venue") % 2 == k), "day", ["src"], {"id": "id", "venue": "venue"}) for k in (0, 1)]
    spans = {"late": (6, 10), "mid": (2, 7), "none": (20, 30)}
    on = {k: (F.col("day") >= F.lit(first + dt.timedelta(days=a))) & (F.col("day") < F.lit(first + dt.timedelta(days=b))) for k, (a, b) in spans.items()}
    together = rollup.added(*parts)
    for groups in (["src"], []):
        got = {(r["src"] if groups else 0, r["kind"]): tuple(r[k] for k in spans) for r in rollup.distinct_in(together, on, groups).collect()}
        want = {}
        for src in {r[1] if groups else 0 for r in rows}:
            for kind, at in (("id", 2), ("venue", 3)):
                own = [(r[0], r[at]) for r in rows if r[0] and r[at] is not None and (not groups or r[1] == src)]
                want[src, kind] = tuple(len({i for d, i in own if a <= (d - first).days < b}) for a, b in spans.values())
        assert got == want
    assert together.filter(F.length("bitmap") > 4096).count() == 0
    assert rollup.distinct_in(parts[0].limit(0), on, ["src"]).count() == 0


def test_a_cursor_goes_round_and_a_lost_run_is_not_repeated(spark, tmp_path):
    items = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "id long, name string")
    path = str(tmp_path / "c")
    seen = []
    for turn in range(4):
        rows = cursor.next_batch(cursor.Cursor(spark, path), items, ["id"], 3).collect()  # a new object each time, as after a restart
        assert {r.turn for r in rows} == {turn}
        seen.append([r.id for r in sorted(rows, key=lambda r: r.place)])
    assert seen == [[0, 1, 2], [3, 4, 5], [6, 0, 1], [2, 3, 4]]
    own = cursor.Cursor(spark, path)
    assert own.take(3, 7) == (4, 5)  # this worker is lost with its turn
    assert sorted(r.id for r in cursor.next_batch(own, items, ["id"], 3).collect()) == [1, 2, 3]
    assert sorted(r.id for r in cursor.next_batch(own, items, ["id"], 20).collect()) == list(range(7))
    assert cursor.next_batch(own, items.limit(0), ["id"], 3).count() == 0
    own.expire()
    assert len(own.table.versions()) == 2 and own.place()[0] == 7


def test_of_two_workers_one_gets_a_turn(spark, tmp_path):
    a, b = (cursor.Cursor(spark, str(tmp_path / "c")) for _ in range(2))
    seen = a.place(), b.place()
    assert a.take(2, 5, seen[0]) == (0, 0)
    with pytest.raises(Conflict):
        b.take(2, 5, seen[1])
    assert b.take(2, 5) == (1, 2) and a.place() == (1, 4)


def _drain(spark, folder, out, **how):
    schema = "log_id long, job_name string, detail long, started_at timestamp, events_found long"
    stream = health.source_health_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), **how)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return {(r.job_name, r.detail): (r.runs, r.zeros, r.last_run, r.last_found, r.alert) for r in health.current(spark.read.parquet(f"{out}/rows")).collect()}


def _land(spark, folder, rows):
    spark.createDataFrame(rows, "log_id long, job_name string, detail long, started_at timestamp, events_found long").coalesce(1).write.mode("append").parquet(folder)


def test_health_goes_on_after_a_restart(spark, tmp_path):
    rng, start, held = random.Random(3), dt.datetime(2024, 1, 1), []
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        rows = [(100 * part + i, rng.choice(["a", "b"]), rng.choice([0, 1, None]), start + dt.timedelta(hours=rng.randint(0, 400)), rng.choice([0, 0, 3, None])) for i in range(40)] + [(100 * part + 99, "a", 0, None, 5)]
        _land(spark, folder, rows)
        held += rows
        got = _drain(spark, folder, out)
        want = {}
        for key in {r[1:3] for r in held if r[3]}:
            last = sorted((r for r in held if r[1:3] == key and r[3]), key=lambda r: (r[3], r[0]), reverse=True)[:5]
            zeros = sum(r[4] == 0 for r in last)
            want[key] = (len(last), zeros, last[0][3], last[0][4], zeros >= 3 and any(r[4] for r in last))
        assert got == want


def test_sources_that_stay_away_are_forgotten(spark, tmp_path):
    folder, out, hour = str(tmp_path / "in"), str(tmp_path / "out"), dt.timedelta(hours=1)
    start, how = dt.datetime(2024, 1, 1), {"late": "1 hour", "retention_ms": 3600_000}
    _land(spark, folder, [(1, "a", 1, start, 4)])
    assert _drain(spark, folder, out, **how)["a", 1][0] == 1
    _land(spark, folder, [(2, "b", 1, start + 50 * hour, 4)])
    _drain(spark, folder, out, **how)
    _land(spark, folder, [(3, "a", 1, start + 60 * hour, 0)])
    got = _drain(spark, folder, out, **how)
    assert got["a", 1][:2] == (1, 1) and got["b", 1][0] == 1  # the run of 50 hours before is no longer there
