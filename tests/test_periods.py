"""The one period that holds a day, where the place of a day or a period is unknown."""

from datetime import date

from tallyforge.operators.intervals import period_of_day


def test_unknown_place_is_as_good_as_another(spark):
    day = date(2024, 5, 10)
    days = spark.createDataFrame([("p", day, "F1"), ("q", day, "F1"), ("r", day, None)], "person string, day date, place string")
    rows = [
        ("p", None, "early", date(2024, 5, 1)), ("p", "F2", "late", date(2024, 5, 5)),
        ("q", None, "early", date(2024, 5, 1)), ("q", "F1", "same", date(2024, 5, 5)),
        ("r", "F2", "early", date(2024, 5, 1)), ("r", None, "late", date(2024, 5, 5)),
    ]
    periods = spark.createDataFrame([(*r, date(2024, 5, 20)) for r in rows], "person string, place string, id string, first date, last date")
    got = period_of_day(days, periods, ["person"], "day", "first", "last", "place", "id")
    assert {r["person"]: r["id"] for r in got.collect()} == {"p": "early", "q": "same", "r": "early"}
