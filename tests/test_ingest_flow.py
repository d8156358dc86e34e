"""The whole ingest against a row loop over the same rules."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from eventlode.functions import names as N
from eventlode.operators import classify, fuzzy
from eventlode.plans import ingest

DAY = dt.date(2026, 6, 1)
CITY = ingest.City(1, "Tel Aviv", "Israel", "Asia/Jerusalem")
TYPES = {"name": "string", "artist_name": "string", "artist_youtube_channel": "string", "start_date": "date", "start_time": "string", "end_date": "date", "end_time": "string", "purchase_link": "string", "price": "double", "price_currency": "string", "description": "string", "image_url": "string", "is_online": "boolean", "venue_id": "long", "venue_name": "string", "sport": "string", "home_team": "string", "away_team": "string", "tv_channels": "array<string>"}
STORED = "event_id long, source string, source_id string, " + ", ".join(f"{c} {TYPES[c]}" for c in ingest.EVENT)
PLACE = {"raw_categories": "array<string>", "venue_website_url": "string", "venue_timezone": "string", "venue_address": "string", "venue_city": "string", "venue_country": "string", "venue_lat": "double", "venue_lon": "double"}
RAW = "arrival long, source string, source_id string, " + ", ".join(f"{c} {TYPES[c]}" for c in ingest.EVENT if c != "venue_id") + ", " + ", ".join(f"{c} {t}" for c, t in PLACE.items())
VENUES = "venue_id long, venue_name string, city_id long, timezone string, website_url string, street_address string, physical_city string, physical_country string, latitude double, longitude double, default_type string"
PERFORMERS = [("Nina Rao", "nina rao", "Jazz Concert", "Music"), ("The Rocks", "the rocks", None, "Music")]
KINDS = [(1, "Jazz Concert", "Music"), (2, "Rock Concert", "Music"), (3, "Comedy Show", "Comedy"), (4, "Sports Event", "Sports"), (5, "Basketball Game", "Sports")]


def _end(date, time, end_date):
    at = dt.datetime.combine(date, dt.time(*map(int, time.split(":")))) + dt.timedelta(hours=2)
    return at.date(), at.strftime("%H:%M")


def _split(r):
    if r["name"] and " @ " in r["name"]:
        first, rest = r["name"].split(" @ ", 1)
        r["name"], r["venue_name"] = first.strip(), r["venue_name"] or rest.strip()
    if r["venue_name"] and " @ " in r["venue_name"]:
        title, place = (x.strip() for x in r["venue_name"].split(" @ ", 1))
        r["venue_name"] = place
        if title and (not r["name"] or r["name"].lower() in title.lower()):
            r["name"] = title


def _loop(stored, raw, venues, artist_of):
    events, venues = [dict(e) for e in stored], [dict(v) for v in venues]
    top, created = max((e["event_id"] for e in events), default=0), []
    for r in (dict(x) for x in sorted(raw, key=lambda x: x["arrival"])):
        _split(r)
        if r["start_date"] is None:
            continue
        old = next((e for e in events if (e["source"], e["source_id"]) == (r["source"], r["source_id"])), None)
        if old:
            if old["price"] is None and r["price"] is not None:
                old["price"], old["price_currency"] = r["price"], r["price_currency"]
            if old["start_time"] is None:
                old["start_time"] = r["start_time"]
            if old["end_time"] is None and r["end_time"] is not None:
                old["end_time"], old["end_date"] = r["end_time"], r["end_date"] or old["end_date"]
            if old["end_time"] is None and old["start_time"] is not None:
                old["end_date"], old["end_time"] = _end(old["start_date"], old["start_time"], old["end_date"])
            if r["sport"]:
                if old["sport"] != r["sport"]:
                    old["sport"], old["home_team"], old["away_team"] = r["sport"], r["home_team"], r["away_team"]
                old["name"] = r["name"]
            fills = [c for c in ("tv_channels", "artist_youtube_channel") if r[c] and not old[c] and (r["sport"] or c != "tv_channels")]
            old.update({c: r[c] for c in fills})
            continue
        if r["venue_name"] and any(SequenceMatcher(None, r["name"].lower(), e["name"].lower()).ratio() > 0.85 for e in events if (e["start_date"], e["venue_name"]) == (r["start_date"], r["venue_name"])):
            continue
        venue = None
        if r["venue_name"]:
            venue = next((v for v in venues if v["venue_name"] == r["venue_name"] and v["city_id"] == CITY.city_id), None)
            if venue:
                venue.update({c: r[f"venue_{c}"] for c in ("website_url", "timezone") if r[f"venue_{c}"] and not venue[c]})
            else:
                venue = {"venue_id": None, "venue_name": r["venue_name"], "city_id": CITY.city_id, "timezone": r["venue_timezone"] or CITY.timezone, "website_url": r["venue_website_url"], "street_address": r["venue_address"], "physical_city": r["venue_city"] or CITY.name, "physical_country": r["venue_country"] or CITY.country, "latitude": r["venue_lat"], "longitude": r["venue_lon"], "default_type": None}
                venue["venue_id"] = max((v["venue_id"] for v in venues), default=0) + 1
                venues.append(venue)
        e = {c: r.get(c) for c in ingest.EVENT}
        if e["end_time"] is None and e["start_time"] is not None:
            e["end_date"], e["end_time"] = _end(e["start_date"], e["start_time"], e["end_date"])
        e["artist_name"] = r["artist_name"] or artist_of.get(r["name"]) or next((p[0] for p in PERFORMERS if p[0].lower() == r["name"].strip().lower()), None)
        top += 1
        e |= {"event_id": top, "source": r["source"], "source_id": r["source_id"], "venue_id": venue["venue_id"] if venue else None, "tv_channels": r["tv_channels"] or []}
        events.append(e)
        created.append((top, r["name"], r["description"], r["venue_name"], r["venue_city"], r["sport"] or None, e["artist_name"], venue["default_type"] if venue else None, r["raw_categories"]))
    for e in events:
        if e["venue_id"] is None and e["venue_name"]:
            e["venue_id"] = next((v["venue_id"] for v in venues if v["venue_name"] == e["venue_name"] and v["city_id"] == CITY.city_id), None)
    return events, venues, created


def _event(rng, names, key):
    sport = "Basketball" if key % 9 == 0 else None
    name = f"Reds {key} vs Blues" if sport else rng.choice(names)
    some = lambda *x: rng.choice(x)
    return {
        "source": f"s{key % 3}", "source_id": str(key), "name": name, "artist_name": some(None, None, "", "Nina Rao", "Someone"), "artist_youtube_channel": some(None, "", "yt"), "start_date": some(DAY, DAY, DAY + dt.timedelta(1)), "start_time": some(None, "20:00", "23:30"),
        "end_date": some(None, DAY), "end_time": some(None, None, "22:15"), "purchase_link": "l", "price": some(None, 5.0, 9.0), "price_currency": some("USD", "ILS"), "description": some(None, "text"), "image_url": None, "is_online": False,
        "venue_name": some("Hall", "Hall", "Jazz Bar", "Club", "", None), "sport": sport, "home_team": "Reds" if sport else None, "away_team": "Blues" if sport else None, "tv_channels": some(None, [], ["5"]),
    }


def _names(rng):
    base = ["Big Show", "Nina Rao", "the rocks", "Jazz Trio Night", "Moss Quartet live", "Comedy Hour", "Open Mic at Noon"]
    return base + [n + rng.choice(["!", " II", "s"]) for n in base] + ["Late Set @ Club", "Solo"]


@pytest.mark.parametrize(("seed", "small"), [(1, 200), (2, 3), (3, 200)])
def test_ingest_is_that_of_a_row_loop(spark, seed, small, monkeypatch):
    monkeypatch.setattr(fuzzy.surviving, "__defaults__", (0.85, small))
    rng = random.Random(seed)
    names = _names(rng)
    venues = [{"venue_id": i, "venue_name": n, "city_id": c, "timezone": t, "website_url": u, "street_address": None, "physical_city": None, "physical_country": None, "latitude": None, "longitude": None, "default_type": d} for i, n, c, t, u, d in [(1, "Hall", 1, None, None, "Comedy Show"), (2, "Hall", 2, "X", "u", None), (3, "Far", 2, None, None, None)]]
    stored = [{**_event(rng, names, k), "event_id": 10 + k, "venue_id": rng.choice([None, 1]), "start_date": DAY} for k in range(12)]
    raw, told = [], {}  # a key keeps its name, venue and day within a batch
    for i in range(70):
        r = {**_event(rng, names, rng.randint(6, 50)), "arrival": 100 + i, "raw_categories": rng.choice([None, [], ["Music"], ["Nothing", "Comedy"]]), "venue_website_url": rng.choice([None, "", "w"]), "venue_timezone": rng.choice([None, "Z"]), "venue_address": rng.choice([None, f"a{i}"]), "venue_city": rng.choice([None, "Jaffa"]), "venue_country": None, "venue_lat": float(i), "venue_lon": None}
        if rng.random() < 0.1:
            r["start_date"] = None
        if not r["sport"] and rng.random() < 0.2 and r["venue_name"] == "Club":
            r["venue_name"] = f"Long {r['name']} Party @ Club"
        if r["source_id"] in told:
            r |= told[r["source_id"]]
        elif r["start_date"]:
            told[r["source_id"]] = {c: r[c] for c in ("name", "venue_name", "start_date")}
        raw.append(r)
    titles = [(n,) for r in raw for n in {r["name"], r["name"].split(" @ ")[0], f"Long {r['name']} Party", f"Long {r['name'].split(' @ ')[0]} Party"}]
    artist_of = {r[0]: r[1] for r in spark.createDataFrame(titles, "n string").select("n", N.artist_in_title(F.col("n"))).collect()}
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in rows], schema).repartition(3)
    performers, kinds = spark.createDataFrame(PERFORMERS, "name string, name_key string, type_name string, category string"), spark.createDataFrame(KINDS, "type_id long, type_name string, category string")
    out = ingest.ingested(frame(stored, STORED), frame(raw, RAW), frame(venues, VENUES), performers, kinds, CITY)
    events, all_venues, created = _loop(stored, raw, venues, artist_of)
    got = {r.event_id: r.asDict() for r in out.events.collect()}
    assert len(got) == len(events) and len(created) > 8
    for e in events:
        assert {c: got[e["event_id"]][c] for c in e} == e, e["event_id"]
    columns = [f.split()[0] for f in VENUES.split(", ")]
    assert sorted(tuple(str(r[c]) for c in columns) for r in out.venues.collect()) == sorted(tuple(str(v[c] if c != "website_url" else v[c]) for c in columns) for v in all_venues)
    asked = spark.createDataFrame(created, "event_id long, name string, description string, venue_name string, venue_city string, sport string, artist_name string, default_type string, raw_categories array<string>")
    want = {r.event_id: r.type_name for r in classify.assign_types(asked, performers, kinds).collect() if r.type_name}
    assert {r.event_id: r.type_name for r in out.types.collect()} == want and len(want) > 3


def test_an_empty_batch_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "s", "1", *[None] * len(ingest.EVENT))], STORED)
    none = lambda schema: spark.createDataFrame([], schema)
    out = ingest.ingested(stored, none(RAW), none(VENUES), none("name string, name_key string, type_name string, category string"), none("type_id long, type_name string, category string"), CITY)
    assert [r.event_id for r in out.events.collect()] == [1] and out.venues.count() == 0 and out.types.count() == 0
