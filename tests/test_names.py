"""Names, places and validation on known cases."""

from pyspark.sql import functions as F

from eventlode.functions import names as N
from eventlode.operators import validate
from tests.test_operators import values


def test_artists_in_titles(spark):
    titles = ["Yonatan Riklis Trio", "Ben Poole @ Railway Inn", "X presents: SingleAct", "Chick Corea Tribute", "A b2b B", None, "Plain", "What??? Band"]
    assert values(spark, titles, N.artist_in_title) == ["Yonatan Riklis", "Ben Poole", "SingleAct", None, "A b2b B", None, None, None]


def test_generic_names(spark):
    assert values(spark, ["Tickets", "buy tickets", "more - info", "ab", None, "http://x", "12/3/2026", "Jazz Night", "x | gig"], N.is_generic) == [True, True, True, True, True, True, True, False, True]


def test_events_and_artists(spark):
    got = values(spark, ["Band - Album Release Get Tickets", "Gala | Evening", "Evening with Ella", "Solo"], N.event_and_artist)
    assert [tuple(g) for g in got] == [("Album Release", "Band"), ("Evening", "Gala"), ("Evening", "Ella"), ("Solo", None)]


def test_cleaning(spark):
    assert values(spark, ["Lady GagaThe MAYHEM Ball", "Gig Mar 19 at The Library", "Gig on Mar 22"], N.clean_title) == ["Lady Gaga - The MAYHEM Ball", "Gig", "Gig"]
    assert values(spark, ['"Tia"', "*Tia*", "[SOLD OUT] *NEW* Tia (US Tour)", "a   b"], N.clean_artist) == ["Tia", "Tia", "Tia", "a b"]
    assert values(spark, ["1. FC Magdeburg", "VfL Bochum", "AC/DC", "ac milan"], N.is_club) == [True, True, False, True]
    assert values(spark, ["Live Nation", "The Entrance", "X Productions", "Open Mic"], N.is_promoter) == [True, False, True, True]
    assert values(spark, ["A b2b B", "A, B, C", "A, B", "A x B", "Alex"], N.first_artist) == ["A", "A", "A, B", "A", "Alex"]


def test_places(spark):
    at = ["Aristides Av S/N, 08028 Barcelona", "Sokak 2, 34354 Istanbul, Turkey", "37 Avenue, 15123 Marousi", "Street, City"]
    assert values(spark, at, lambda c: N.city_of_address(c, {"marousi": "Athens"})) == ["Barcelona", "Istanbul", "Athens", "City"]
    assert [tuple(v) for v in values(spark, ["Paris, France • In Person", "Online"], N.place_line)] == [("Paris", "France", False), (None, None, True)]
    df = spark.createDataFrame([("Gig", "Ann"), ("Ann live", "Ann"), ("", None), (None, "Ann")], "n string, a string")
    assert [r[0] for r in df.select(N.titled(F.col("n"), F.col("a"))).collect()] == ["Gig - Ann", "Ann live", "Untitled Event", "Ann"]


def test_classifications(spark):
    rows = [("a", "Bebop", "Swing", None, "high"), ("b", "Jazz Music", "Bebop", None, "high"), ("c", "Nope", None, None, "low"), ("d", "unknown", None, None, "high"), ("e", "Bebop", "Jazz", "Nope", "low"), ("", "Bebop", None, None, "low"), ("f", "Bebop", "Jazz", None, "LOW")]
    df = spark.createDataFrame(rows, "artist string, primary string, secondary_1 string, secondary_2 string, confidence string")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    out = {r.artist: tuple(r)[1:] for r in validate.classification(df, names("Bebop", "Swing"), names("Jazz")).collect()}
    assert out["a"] == ("Bebop", "Swing", None, "high", None, False)
    assert out["b"] == ("UNKNOWN", None, None, "low", None, True)
    assert out["f"] == ("Bebop", None, None, "low", None, True)
    assert [out[k][4] for k in ("c", "d", "e", None)] == ["primary not in taxonomy", "unknown needs low confidence", "secondary_2 not in taxonomy", "missing artist"]


def test_evidence(spark):
    df = spark.createDataFrame([("Big  Night Out", "the BIG night x"), ("Other", "page"), ("Other", "")], "n string, p string")
    assert [r[0] for r in df.select(validate.evidenced(F.col("n"), F.col("p"))).collect()] == [True, False, True]
