from datetime import date, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen.operators import temporal as T

UNIX = [("0", "auto", "1970-01-01T00:00:00Z"), ("1786998240", "auto", "2026-08-17T20:24:00Z"), ("1786998240000", "auto", "2026-08-17T20:24:00Z"), ("-1000000000", "auto", "1938-04-24T22:13:20Z"), ("1000000000", "seconds", "2001-09-09T01:46:40Z"), ("1000000000", "milliseconds", "1970-01-12T13:46:40Z"), ("1000000000", "microseconds", "1970-01-01T00:16:40Z"), ("1000000000", "nanoseconds", "1970-01-01T00:00:01Z")]


@pytest.mark.parametrize("raw,unit,iso", UNIX)
def test_unix(raw, unit, iso):
    assert T.show(T.parse(raw, "unix", unit)["epoch_ns"]) == iso


def test_unix_edges():
    assert T.parse_unix("1786998240.123456789", "seconds")["epoch_ns"] == 1786998240123456789
    r = T.parse("12345678900")
    assert r["status"] == "ambiguous" and len(r["candidates"]) >= 2
    assert T.parse_unix("8640000000000000", "milliseconds")["status"] == "instant" and T.parse_unix("8640000000000001", "milliseconds")["code"] == "out-of-range"
    r = T.parse("9500000000000000")
    assert r["unit"] == "nanoseconds" and "implausible date (year 2271)" in r["note"]


def test_iso_and_loose():
    assert T.show(T.parse("2026-08-17T16:24:00+05:45", "iso")["epoch_ns"]) == "2026-08-17T10:39:00Z"
    for raw, code in (("2026-02-30", "invalid-date"), ("2026-08-17Z", "malformed-iso"), ("2026-08-17T10:00:60", "leap-second"), ("nonsense", "malformed-iso"), ("2026-08-17T25:00", "invalid-time")):
        assert T.parse(raw, "iso")["code"] == code, raw
    assert T.parse("2026-08-17T10:00Z", "local")["code"] == "local-has-zone" and T.parse("hello")["code"] == "unsupported" and T.parse(" ")["status"] == "empty"
    assert T.parse("03/04/2026")["candidates"] == ["2026-03-04", "2026-04-03"] and T.parse("2026/08/13")["candidates"] == ["2026-08-13"] and T.parse("13-08-26")["candidates"] == ["2026-08-13"]
    assert T.show(T.parse("+275760-09-13T00:00:00Z", "iso")["epoch_ns"]) == "+275760-09-13T00:00:00Z"


SERIALS = [("1", "1900", "1900-01-01T00:00:00"), ("59", "1900", "1900-02-28T00:00:00"), ("61", "1900", "1900-03-01T00:00:00"), ("25569", "1900", "1970-01-01T00:00:00"), ("1.5", "1900", "1900-01-01T12:00:00"), ("61.25", "1900", "1900-03-01T06:00:00"), ("0", "1904", "1904-01-01T00:00:00")]


@pytest.mark.parametrize("raw,system,iso", SERIALS)
def test_serials(raw, system, iso):
    assert T.show(T.parse(raw, "excel", "auto", system)["wall_ns"], "") == iso


def test_serials_beyond_the_last_year_of_spreadsheets():
    assert [T.show(T.parse(x, "excel", "auto", "1900", None)["wall_ns"], "") for x in ("2958465", "2958466")] == ["9999-12-31T00:00:00", "+010000-01-01T00:00:00"]
    assert T.parse("2958466", "excel", "auto", "1900", 10_000)["status"] == "local" and T.parse("100025569", "excel", "auto", "1900", None)["code"] == "out-of-range"


def test_serial_errors():
    assert [T.parse(x, "excel").get("code") for x in ("0", "60", "-1", "2958466", "2958467", "x")] == ["excel-zero", "excel-phantom", "excel-negative", "out-of-range", "out-of-range", "not-numeric"]


def wall(text):
    return T.parse_iso(text)["wall_ns"]


def test_resolution():
    r = T.resolve(wall("2026-06-15T12:00"), "America/New_York")
    assert r["status"] == "unique" and T.show(r["earlier_ns"]) == "2026-06-15T16:00:00Z"
    r = T.resolve(wall("2026-11-01T01:30"), "America/New_York")
    assert (r["status"], r["shift_minutes"], T.show(r["earlier_ns"]), T.show(r["later_ns"])) == ("ambiguous", 60, "2026-11-01T05:30:00Z", "2026-11-01T06:30:00Z")
    r = T.resolve(wall("2026-04-05T01:45"), "Australia/Lord_Howe")
    assert (r["status"], r["shift_minutes"], T.offset_text(r["earlier_offset"]), T.offset_text(r["later_offset"])) == ("ambiguous", 30, "+11:00", "+10:30")
    r = T.resolve(wall("2026-03-08T02:30"), "America/New_York")
    assert (r["status"], r["shift_minutes"], T.show(r["earlier_ns"]), T.show(r["later_ns"])) == ("gap", 60, "2026-03-08T06:30:00Z", "2026-03-08T07:30:00Z")
    assert T.resolve(wall("2026-10-04T02:15"), "Australia/Lord_Howe")["shift_minutes"] == 30
    assert T.offset_text(T.resolve(wall("1870-06-01T12:00"), "America/New_York")["earlier_offset"]) == "-04:56:02"


@given(st.integers(-700_000, 700_000))
def test_calendar_arithmetic(n):
    y, m, d = T.civil(n)
    assert T.day_number(y, m, d) == n
    if -719_000 < n:
        assert date(y, m, d) == date(1970, 1, 1) + timedelta(days=n)


def test_columns(spark):
    rows = [("2026-11-01 01:30",), ("2026-03-08 02:30",), ("1786998240",), ("03/04/2026",), (None,), ("2026-02-30",)]
    df = spark.createDataFrame(rows, "raw string")
    got = {r["raw"]: r for r in T.summary(T.interpret(df, "raw", "America/New_York"), "raw").collect()}
    assert got["2026-11-01 01:30"]["instant_ns"] == 1793511000 * 10**9 and "dst-fold" in got["2026-11-01 01:30"]["finding_ids"]
    assert got["2026-03-08 02:30"]["instant_ns"] == 1772955000 * 10**9 and "dst-gap" in got["2026-03-08 02:30"]["finding_ids"]
    assert got["03/04/2026"]["summary"].endswith("2026-03-04 or 2026-04-03") and got[None]["parsed"]["status"] == "empty"
    one = spark.sql("SELECT timestamp_ntz'2027-01-01 00:00:00' AS t, timestamp_ntz'2026-07-01 12:00:00' AS u")
    f = one.select(T.calendar_facts(F.col("t")).alias("c"), T.zone_facts(F.col("u"), "America/New_York").alias("z"), T.relative(F.lit(-7300)).alias("r"), T.relative(F.lit(90000)).alias("s"), T.unix_native(F.lit("1.5"), F.lit("seconds")).alias("n"), T.epoch_seconds(F.lit(1500000000)).alias("e"), T.instant_in_zone(F.expr("timestamp_ntz'2026-11-01 01:30:00'"), "America/New_York").cast("string").alias("i")).first()
    assert (f["c"]["weekday"], f["c"]["iso_week"], f["c"]["iso_year"], f["c"]["days_in_month"]) == (5, 53, 2026, 31)
    assert (f["z"]["offset_minutes"], f["z"]["dst"], f["z"]["observes_dst"]) == (-240, True, True)
    assert (f["r"], f["s"], int(f["n"]), f["e"], f["i"]) == ("2 hours ago", "tomorrow", 1500000000, "1.5", "2026-11-01 05:30:00")
    assert T.is_zone("Europe/Berlin") and not T.is_zone("Mars/Base") and T.across_zones(one, "u", ["UTC", "Asia/Tokyo"]).count() == 2
