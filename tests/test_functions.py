from datetime import datetime

import pytest
from lumenfold.functions import dates, geo, scores, text
from pyspark.sql import functions as F


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'bigint' if isinstance(v, int) and not isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("value", "bad", "default", "low"),
    [
        (None, True, True, True), ("", True, True, True), ("2019", True, True, True), ("2019-06", True, True, True), ("nonsense", True, True, True),
        ("1970-01-01T00:00:00", True, True, True), ("2027-01-02T10:00:00", True, True, True), ("0001-05-05T01:01:01", True, True, True), ("9999-05-05T01:01:01", True, True, True),
        ("2019-01-01T00:00:00", False, True, True), ("2019-06-15T00:00:00", False, False, True), ("2019-06-15", False, False, True),
        ("2019-06-15T10:30:00", False, False, False), ("2019-06-15 10:30:00", False, False, False), ("2019-06-15T10:30:00+00:00", False, False, False),
    ],
)
def test_bad_dates(spark, value, bad, default, low):
    d = F.col("d")
    assert [one(spark, f(d), d=value) for f in (dates.is_bad, dates.is_default, dates.is_low_confidence)] == [bad, default, low]


@pytest.mark.parametrize(
    ("name", "day"),
    [
        ("IMG_20190615_101500.jpg", "2019-06-15"), ("2019-06-15_x.jpg", "2019-06-15"), ("2019_06_15.jpg", "2019-06-15"), ("PXL_20210101_1.jpg", "2021-01-01"), ("BURST20190615.jpg", "2019-06-15"),
        ("IMG_20190231.jpg", None), ("IMG_12345678_20190615.jpg", None), ("IMG_99999999_PXL_20190615.jpg", "2019-06-15"), ("x.jpg", None),
    ],
)
def test_filename_dates(spark, name, day):
    assert one(spark, dates.from_filename(F.col("n")), n=name) == (day and f"{day}T00:00:00")


@pytest.mark.parametrize(
    ("path", "day"),
    [("a/15 Jun 2019", "2019-06-15"), ("5 september 2018 - 9 september 2018", "2018-09-05"), ("31 Feb 2019", "2019-06-15"), ("2019-06-15", "2019-06-15"), ("x/2019_06_15 party", "2019-06-15"), ("Japan 2019", "2019-06-15"), ("misc", None), ("1985", None)],
)
def test_directory_dates(spark, path, day):
    assert one(spark, dates.from_directory(F.col("p")), p=path) == (day and f"{day}T00:00:00")


def test_other_dates(spark):
    assert one(spark, dates.from_epoch(F.col("s")), s="1560593700") == "2019-06-15T10:15:00+00:00"
    assert [one(spark, dates.from_epoch(F.col("s")), s=s) for s in ("0", "x", "-5", None)] == [None] * 4
    assert one(spark, dates.from_exif(F.col("s")), s="2019:06:15 10:15:00") == "2019-06-15T10:15:00"
    assert one(spark, dates.from_exif(F.col("s")), s="0000:00:00 00:00:00") is None
    assert one(spark, dates.lenient(F.col("s")), s="2019-06-15 10:15:00.5") == datetime(2019, 6, 15, 10, 15)
    assert one(spark, dates.repaired_directory(F.col("s")), s="2019:06:05") == "05 Jun 2019"
    assert one(spark, dates.repaired_directory(F.col("s")), s="2019:x") == "2019-x"
    assert one(spark, dates.year_or_undated(F.col("s")), s=None) == "Undated"
    assert [one(spark, dates.trip_length(F.col("n")), n=n) for n in (1, 3, 7, 13, 14)] == ["2-day trip", "4-day trip", "1-week trip", "2-week trip", "14 days"]


def test_floor_days(spark):
    rows = spark.createDataFrame([("2019-01-01 23:00:00", "2019-01-02 01:00:00"), ("2019-01-02 00:00:00", "2019-01-01 12:00:00")], "a string, b string")
    days = dates.floor_days(F.col("b").cast("timestamp_ntz"), F.col("a").cast("timestamp_ntz"))
    assert [r.d for r in rows.select(days.alias("d")).collect()] == [0, -1]


@pytest.mark.parametrize(("name", "number"), [("IMG_1234.jpg", 1234), ("dsc00123.JPG", 123), ("1234.png", 1234), ("12.jpg", None), ("abc.jpg", None), ("TRIP0042.jpg", 42), ("MVI-9999.mov", 9999)])
def test_sequence_numbers(spark, name, number):
    assert one(spark, text.sequence_number(F.col("n")), n=name) == number


def test_names(spark):
    assert one(spark, text.safe_name(F.col("n")), n=' .a<b>:c"/\\|?*. ') == "a_b__c______"
    assert one(spark, text.sidecar_target(F.col("n")), n="x.jpg.supplemental-metadata.json") == "x.jpg"
    assert one(spark, text.sidecar_target(F.col("n")), n="x.jpg.json") == "x.jpg"
    assert [one(spark, text.media_type(F.col("n")), n=n) for n in ("a/B.JPG", "c.mov", "c.txt", "noext")] == ["image", "video", "other", "other"]
    assert one(spark, text.album_name_reply(F.col("n")), n='"**Sunny   Days**"\n') == "Sunny Days"
    assert one(spark, text.album_name_reply(F.col("n")), n="abc") is None
    assert [one(spark, text.country_name(F.col("c")), c=c) for c in ("GB", "XX")] == ["United Kingdom", "XX"]
    assert [one(spark, text.country_code(F.col("c")), c=c) for c in ("uk", "Japan", "czechia", "nowhere")] == ["GB", "JP", "CZ", None]
    assert one(spark, text.hashtags(F.array(F.lit("#a"), F.lit("b")))) == "#a #b"
    assert [one(spark, text.numeric_prefix(F.col("n")), n=n) for n in ("12abc", "IMG_12", " -5x", None)] == [12, 0, -5, 0]
    assert one(spark, text.progress_bar(F.col("d"), F.col("t"), 4), d=1, t=2) == "██░░"
    assert one(spark, text.progress_bar(F.col("d"), F.col("t"), 4), d=1, t=0) == "░░░░"


@pytest.mark.parametrize(
    ("reply", "balanced", "greedy", "lazy"),
    [
        ('```json\n{"a": {"b": 1}} and {c}\n```', '{"a": {"b": 1}}', '{"a": {"b": 1}} and {c}', '{"a": {"b": 1}'),
        ("no object", None, None, None), ("", None, None, None), ("{open", None, None, None), ("x } { y }", "{ y }", "{ y }", "{ y }"),
    ],
)
def test_json_in_replies(spark, reply, balanced, greedy, lazy):
    c = F.col("t")
    assert [one(spark, f(c), t=reply) for f in (text.json_balanced, text.json_greedy, text.json_lazy)] == [balanced, greedy, lazy]


def test_geo(spark):
    lit = F.lit
    assert one(spark, geo.haversine_km(lit(51.5), lit(-0.12), lit(48.85), lit(2.35))) == pytest.approx(343, abs=2)
    assert one(spark, geo.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(180.0))) == pytest.approx(20015, abs=1)
    assert tuple(one(spark, geo.dms(lit(-12.5)))) == (12, 30, 0)
    assert one(spark, geo.off_null_island(lit(0.0005))) is None
    assert one(spark, geo.pair_off_null_island(lit(0.0), lit(5.0))) is True


@pytest.mark.parametrize(("d", "points"), [("Trip", -20), (".", -20), ("Photos from 2019", -20), ("Photos from 2019:1", -10), ("2019:01:02", 50), ("Trip: one", 50), ("2019", 0), ("", 0), (None, 0)])
def test_copy_penalty(spark, d, points):
    assert one(spark, scores.copy_penalty(F.col("d"), F.lit(False), F.lit(False), F.lit(0.0)), d=d) == points
    assert one(spark, scores.copy_penalty(F.col("d"), F.lit(True), F.lit(True), F.lit(1.5)), d=d) == points - 155


def test_ladders(spark):
    c = lambda h, s: one(spark, scores.temporal_confidence(F.lit(h), F.lit(s)))
    assert [c(0.5, False), c(6.0, True), c(6.0, False), c(24.0, True), c(24.0, False), c(24.1, True)] == ["high", "high", "medium", "medium", None, None]
    assert [one(spark, scores.similarity_confidence(F.lit(b))) for b in (4, 10, 12, 13)] == ["high", "medium", "low", None]
    assert [one(spark, scores.coverage_confidence(F.lit(s))) for s in (0.7, 0.5, 0.49)] == ["high", "medium", None]
