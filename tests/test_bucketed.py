"""The bucketed table: which files a write makes, replays, races and expiry."""

import random

import pytest

from eventlode.operators.bucketed import BucketTable, Conflict
from eventlode.operators.upsert import upsert

SCHEMA = "id long, name string, price double"


def _merge(current, delta):
    return upsert(current, delta, ["id"], backfill=["price"]).drop("change")


def _files(path):
    return {str(p) for p in path.rglob("*.parquet")}


def test_upserts_are_those_of_a_row_loop(spark, tmp_path):
    rng, want = random.Random(6), {}
    table = BucketTable(spark, str(tmp_path / "t"), ["id"], buckets=8)
    assert table.read() is None and table.versions() == []
    for number in range(4):
        rows = {rng.randint(0, 80): (f"n{number}", rng.choice([None, float(number)])) for _ in range(25)}
        delta = spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)
        assert table.apply(delta, _merge)
        for k, (name, price) in rows.items():
            old = want.get(k)
            want[k] = (name, price) if old is None else (old[0], price if old[1] is None else old[1])
        assert {r.id: (r.name, r.price) for r in table.read().collect()} == want
    assert table.versions() == [0, 1, 2, 3] and table.read(0).count() <= 25
    assert table.expire(keep=1) > 0 and table.versions() == [3]
    assert {r.id: (r.name, r.price) for r in table.read().collect()} == want
    assert table.expire(keep=1) == 0


def test_only_touched_buckets_are_rewritten_and_replays_change_nothing(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["id"], buckets=8)
    table.apply(spark.createDataFrame([(i, "a", None) for i in range(200)], SCHEMA), _merge, version=0)
    before = _files(tmp_path)
    assert len(before) == 8
    one = spark.createDataFrame([(7, "b", 1.0)], SCHEMA)
    assert table.apply(one, _merge, version=1)
    after = _files(tmp_path)
    assert before < after and len(after - before) == 1
    held = table.manifest()
    assert not table.apply(one, _merge, version=1) and not table.apply(one, _merge, version=0)
    assert _files(tmp_path) == after and table.manifest() == held
    assert {(r.id, r.name, r.price) for r in table.read().collect()} == {(i, "a", 1.0 if i == 7 else None) for i in range(200)}
    assert table.apply(one.limit(0), _merge) and _files(tmp_path) == after and table.read().count() == 200


def test_a_race_has_one_winner_and_an_unnamed_write_is_not_read(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["id"], buckets=4)
    rows = spark.createDataFrame([(i, "a", None) for i in range(20)], SCHEMA)
    table.apply(rows, _merge)

    def slow(current, delta):
        BucketTable(spark, str(tmp_path / "t"), ["id"]).apply(spark.createDataFrame([(100, "first", None)], SCHEMA), _merge)
        return _merge(current, delta)

    with pytest.raises(Conflict):
        table.apply(spark.createDataFrame([(101, "second", None)], SCHEMA), slow)
    assert table.read().filter("id >= 100").collect()[0].name == "first" and table.read().count() == 21
    unnamed = len(_files(tmp_path / "t" / "data"))
    assert table.expire(keep=2) == 1 and len(_files(tmp_path / "t" / "data")) == unnamed - 1 and table.read().count() == 21


def test_a_change_may_empty_a_bucket(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["id"], buckets=4)
    rows = spark.createDataFrame([(i, "a", None) for i in range(20)], SCHEMA)
    table.apply(rows, _merge)
    table.apply(rows.filter("id < 15"), lambda current, delta: current.join(delta.select("id"), "id", "left_anti"))
    assert sorted(r.id for r in table.read().collect()) == [15, 16, 17, 18, 19]
