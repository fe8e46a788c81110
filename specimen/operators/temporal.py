"""Messy timestamps: ISO 8601, Unix numbers, spreadsheet serials and local wall times, to nanoseconds, without guessing.

Instants are exact nanoseconds (``DECIMAL(38,0)``) over plus or minus 10^8 days, far beyond Spark's timestamps.  Parsing is a
pure function behind one Arrow UDF; calendar facts, zones of resolved instants and relative phrases are native.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsre import py_trim
from ..functions.udf import arrow

NS, DAY = 10**9, 86_400 * 10**9
LIMIT = 10**8 * DAY
PER_UNIT = {"seconds": 10**9, "milliseconds": 10**6, "microseconds": 1000, "nanoseconds": 1}
SANE_YEARS = (1678, 2262)
_ISO = re.compile(r"([+-][0-9]{6}|[0-9]{4})-([0-9]{2})-([0-9]{2})(?:[Tt ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?)?(?:\s*([Zz]|[+-][0-9]{2}(?::?[0-9]{2})?))?")
_NUMBER = re.compile(r"([+-]?)([0-9]+)(?:\.([0-9]+))?")
_LOOSE = re.compile(r"([0-9]{1,4})[/.]([0-9]{1,2})[/.]([0-9]{1,4})|([0-9]{1,2})-([0-9]{1,2})-([0-9]{2,4})")


def leap(y: int) -> bool:
    return y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)


def month_days(y: int, m: int) -> int:
    return 29 if m == 2 and leap(y) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def day_number(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, any year."""
    years = y - (m <= 2)
    return years * 365 + years // 4 - years // 100 + years // 400 + (153 * ((m + 9) % 12) + 2) // 5 + d - 1 - 719_468


def civil(days: int) -> tuple[int, int, int]:
    """The date of a day number, by narrowing down the year."""
    y = 1970 + days * 400 // 146_097
    while day_number(y, 1, 1) > days:
        y -= 1
    while day_number(y + 1, 1, 1) <= days:
        y += 1
    m, rest = 1, days - day_number(y, 1, 1)
    while rest >= month_days(y, m):
        rest -= month_days(y, m)
        m += 1
    return y, m, rest + 1


def in_range(ns: int) -> bool:
    return -LIMIT <= ns <= LIMIT


def show(ns: int, suffix: str = "Z") -> str:
    """ISO text of nanoseconds since 1970, fraction without trailing zeros, years beyond four digits with a sign."""
    days, rest = divmod(ns, DAY)
    y, m, d = civil(days)
    s, frac = divmod(rest, NS)
    year = f"{y:04d}" if 0 <= y <= 9999 else f"{'-' if y < 0 else '+'}{abs(y):06d}"
    return f"{year}-{m:02d}-{d:02d}T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}" + (f".{frac:09d}".rstrip("0") if frac else "") + suffix


def _fail(code: str) -> dict:
    return {"status": "error", "code": code}


def _half_up(a: int, b: int) -> int:
    return a // b + (a % b * 2 >= b)


def parse_iso(raw: str) -> dict | None:
    """An instant (with a zone), a wall time (without), an error, or None where the text is not ISO at all."""
    m = _ISO.fullmatch(raw)
    if not m:
        return None
    y, mo, d = int(m[1]), int(m[2]), int(m[3])
    if m[6] == "60":
        return _fail("leap-second")
    if m[8] and m[4] is None:
        return _fail("malformed-iso")
    if not (1 <= mo <= 12 and 1 <= d <= month_days(y, mo)) or m[1] == "-000000":
        return _fail("invalid-date")
    h, mi, s = int(m[4] or 0), int(m[5] or 0), int(m[6] or 0)
    if h > 23 or mi > 59 or s > 59:
        return _fail("invalid-time")
    ns = day_number(y, mo, d) * DAY + (h * 3600 + mi * 60 + s) * NS + int((m[7] or "0").ljust(9, "0"))
    if not m[8]:
        return {"status": "local", "kind": "iso", "wall_ns": ns, "note": None if m[4] else "no time of day was given; 00:00:00 is used"} if in_range(ns) else _fail("out-of-range")
    offset = 0
    if m[8] not in "Zz":
        z = re.fullmatch(r"([+-])([0-9]{2}):?([0-9]{2})?", m[8])
        if int(z[2]) > 23 or int(z[3] or 0) > 59:
            return _fail("invalid-time")
        offset = (int(z[2]) * 3600 + int(z[3] or 0) * 60) * (-1 if z[1] == "-" else 1)
    ns -= offset * NS
    return {"status": "instant", "kind": "iso", "epoch_ns": ns} if in_range(ns) else _fail("out-of-range")


def parse_unix(raw: str, unit: str = "auto") -> dict:
    """A Unix number in a unit; ``auto`` goes by the number of digits and refuses where several units are plausible."""
    m = _NUMBER.fullmatch(raw)
    if not m:
        return _fail("not-numeric")
    frac = m[3] or ""
    digits = len(m[2].lstrip("0") or "0")
    value = {u: _half_up(int(m[2] + frac) * k, 10 ** len(frac)) * (-1 if m[1] == "-" else 1) for u, k in PER_UNIT.items()}
    if unit != "auto":
        return {"status": "instant", "kind": "unix", "unit": unit, "epoch_ns": value[unit]} if in_range(value[unit]) else _fail("out-of-range")
    year = {u: civil(v // DAY)[0] if in_range(v) else None for u, v in value.items()}
    sane = [u for u in PER_UNIT if year[u] is not None and SANE_YEARS[0] <= year[u] <= SANE_YEARS[1]]
    first = "seconds" if digits <= 11 else "milliseconds" if digits <= 14 else "microseconds" if digits <= 16 else "nanoseconds"
    hit = lambda u, note: {"status": "instant", "kind": "unix", "unit": u, "epoch_ns": value[u], "note": note}
    if first in sane:
        return hit(first, f"{first}, from {digits} digits")
    if len(sane) == 1:
        return hit(sane[0], "out of range" if year[first] is None else f"implausible date (year {year[first]}) as {first}")
    choices = sane or [u for u in PER_UNIT if year[u] is not None]
    if not sane and year[first] is not None:
        return hit(first, "far outside the usual years")
    if choices:
        return {"status": "ambiguous", "kind": "unix", "candidates": [show(value[u]) for u in choices]}
    return _fail("out-of-range")


def parse_serial(raw: str, system: str = "1900", last_year: int | None = 9999) -> dict:
    """A spreadsheet serial.  1900: 0 is no day, 60 is a day that never was, later ones are shifted by one.  Spreadsheets end
    with the year 9999; without a ``last_year`` the count goes on as far as all instants do."""
    m = _NUMBER.fullmatch(raw)
    if not m:
        return _fail("not-numeric")
    days, frac = int(m[2]), m[3] or ""
    if m[1] == "-":
        return _fail("excel-negative")
    if system == "1904":
        day = day_number(1904, 1, 1) + days
    elif days == 0:
        return _fail("excel-zero")
    elif days == 60:
        return _fail("excel-phantom")
    else:
        day = day_number(1899, 12, 31) + days - (days > 60)
    if day * DAY > LIMIT - DAY or (last_year is not None and day > day_number(last_year, 12, 31)):
        return _fail("out-of-range")
    time = min(DAY - 1, _half_up(int(frac or 0) * DAY, 10 ** len(frac)))
    return {"status": "local", "kind": "excel", "wall_ns": day * DAY + time}


def loose_candidates(raw: str) -> list[str]:
    """Every reading of a numeric date whose order of parts is not told."""
    m = _LOOSE.fullmatch(raw)
    if not m:
        return []
    parts = [x for x in m.groups() if x is not None]
    a, b, c = map(int, parts)
    year = 2000 + c if c < 100 else c
    tries = [(a, b, c)] if len(str(a)) == 4 else [(year, a, b), (year, b, a)]
    return [f"{y:04d}-{mo:02d}-{d:02d}" for y, mo, d in tries if 1 <= mo <= 12 and 1 <= d <= month_days(y, mo) and y <= 9999]


def parse(raw: str | None, mode: str = "auto", unit: str = "auto", system: str = "1900", last_year: int | None = 9999) -> dict:
    """status: empty, instant (``epoch_ns``), local (``wall_ns``), ambiguous (``candidates``) or error (``code``)."""
    t = py_trim(raw or "")
    if not t:
        return {"status": "empty"}
    if mode == "unix":
        return parse_unix(t, unit)
    if mode == "excel":
        return parse_serial(t, system, last_year)
    iso = parse_iso(t)
    if mode == "local":
        if iso and (m := _ISO.fullmatch(t)) and m[8]:
            return _fail("local-has-zone")
        return iso or _fail("malformed-local")
    if mode == "iso":
        return iso or _fail("malformed-iso")
    if _NUMBER.fullmatch(t):
        return parse_unix(t, unit)
    if iso:
        return iso
    found = loose_candidates(t)
    return {"status": "ambiguous", "candidates": found} if found or re.search("[0-9]", t) else _fail("unsupported")


_PARSED = "status string, kind string, unit string, epoch_ns decimal(38,0), wall_ns decimal(38,0), iso string, candidates array<string>, code string, note string"
_FIELDS = [x.split()[0] for x in _PARSED.split(", ")]


def parse_column(text: Column, mode: str = "auto", unit: str = "auto", system: str = "1900", last_year: int | None = 9999) -> Column:
    """``parse`` over a column, as a struct; ``iso`` shows the instant or the wall time."""
    from decimal import Decimal

    @arrow(_PARSED)
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for raw in s:
            r = parse(raw, mode, unit, system, last_year)
            ns = r.get("epoch_ns", r.get("wall_ns"))
            r["iso"] = None if ns is None else show(ns, "Z" if "epoch_ns" in r else "")
            for k in ("epoch_ns", "wall_ns"):
                if k in r:
                    r[k] = Decimal(r[k])
            out.append([r.get(k) for k in _FIELDS])
        return pd.DataFrame(out, columns=_FIELDS, dtype=object)

    return run(text)


def unix_native(number: Column, unit: Column) -> Column:
    """Epoch nanoseconds of a plain number in a known unit, half up, without Python: ``DECIMAL(38,0)`` or null."""
    k = F.when(unit == "seconds", F.lit(10**9)).when(unit == "milliseconds", F.lit(10**6)).when(unit == "microseconds", F.lit(1000)).when(unit == "nanoseconds", F.lit(1))
    ns = F.round(number.try_cast("decimal(29,9)") * k.cast("decimal(10,0)"), 0).cast("decimal(38,0)")
    return F.when(number.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$") & (F.abs(ns) <= F.lit(str(LIMIT)).cast("decimal(38,0)")), ns)


# -- zones ---------------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo:
    return ZoneInfo(name)


@lru_cache(maxsize=1)
def _zones() -> frozenset[str]:
    return frozenset(available_timezones())


def zones() -> list[str]:
    return sorted(_zones())


def is_zone(name: str) -> bool:
    return name in _zones()


def _offset(instant_s: int, zone: str) -> int:
    at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=instant_s)
    return int(at.astimezone(_zone(zone)).utcoffset().total_seconds())


def resolve(wall_ns: int, zone: str) -> dict:
    """The instants of a wall time in a zone: unique, ambiguous (the clock was set back) or gap (it was set forward)."""
    s, frac = divmod(wall_ns, NS)
    if not -62_135_500_000 < s < 253_402_200_000:
        return {"status": "unsupported"}
    around = {_offset(s - 86_400, zone), _offset(s + 86_400, zone)}
    local = datetime(1970, 1, 1) + timedelta(seconds=s)
    around |= {int(local.replace(tzinfo=_zone(zone), fold=f).utcoffset().total_seconds()) for f in (0, 1)}
    hits = sorted({s - o for o in around if _offset(s - o, zone) == o})
    if hits:
        first, last = hits[0], hits[-1]
        return {"status": "unique" if first == last else "ambiguous", "earlier_ns": first * NS + frac, "later_ns": last * NS + frac, "shift_minutes": (last - first) // 60, "earlier_offset": s - first, "later_offset": s - last}
    before, after = (int(local.replace(tzinfo=_zone(zone), fold=f).utcoffset().total_seconds()) for f in (0, 1))
    before, after = min(before, after), max(before, after)
    # pushed on by the old offset, or back by the new one
    return {"status": "gap", "earlier_ns": (s - after) * NS + frac, "later_ns": (s - before) * NS + frac, "shift_minutes": (after - before) // 60, "earlier_offset": before, "later_offset": after}


_RESOLVED = "status string, earlier_ns decimal(38,0), later_ns decimal(38,0), shift_minutes int, earlier_offset int, later_offset int, chosen_ns decimal(38,0)"


@arrow(_RESOLVED)
def resolve_column(wall_ns: pd.Series, zone: pd.Series) -> pd.DataFrame:
    """``resolve`` over columns; ``chosen_ns``: the earlier of two, or after a gap."""
    from decimal import Decimal

    names = [x.split()[0] for x in _RESOLVED.split(", ")]
    out = []
    for w, z in zip(wall_ns, zone, strict=True):
        r = {} if w is None or w != w or not z else resolve(int(w), z) if is_zone(z) else {"status": "unknown-zone"}
        r["chosen_ns"] = r.get("later_ns" if r.get("status") == "gap" else "earlier_ns")
        out.append([Decimal(r[k]) if k.endswith("_ns") and r.get(k) is not None else r.get(k) for k in names])
    return pd.DataFrame(out, columns=names, dtype=object)


def offset_text(seconds: int) -> str:
    sign, s = "-" if seconds < 0 else "+", abs(seconds)
    return f"{sign}{s // 3600:02d}:{s // 60 % 60:02d}" + (f":{s % 60:02d}" if s % 60 else "")


def wall_in_zone(at: Column, zone: Column | str) -> Column:
    """Native wall time (``TIMESTAMP_NTZ``) of a UTC ``TIMESTAMP_NTZ``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, at)


def instant_in_zone(wall: Column, zone: Column | str) -> Column:
    """Native UTC ``TIMESTAMP_NTZ`` of a wall time: the earlier of two, after a gap."""
    return F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), wall)


def zone_facts(at: Column, zone: Column | str) -> Column:
    """``struct(offset_minutes, dst, observes_dst)`` of a UTC time: its offset beside those of January, April, July, October."""
    minutes = lambda t: F.timestamp_diff("MINUTE", t, wall_in_zone(t, zone))
    year = F.year(at)
    probes = F.array(*[minutes(F.make_timestamp_ntz(year, F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) for m in (1, 4, 7, 10)], minutes(at))
    low, high = F.array_min(probes), F.array_max(probes)
    return F.struct(minutes(at).alias("offset_minutes"), (minutes(at) > low).alias("dst"), (high > low).alias("observes_dst"))


def across_zones(df: DataFrame, at: str, names: list[str]) -> DataFrame:
    """A row per input row and zone of a given short list."""
    out = df.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in names])))
    return out.withColumn("wall", wall_in_zone(F.col(at), F.col("zone")))


def calendar_facts(d: Column) -> Column:
    """ISO weekday, week and week-year, day of year, quarter, leap year, days in month and year."""
    y = F.year(d)
    is_leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.struct(F.extract(F.lit("DAYOFWEEK_ISO"), d).cast("int").alias("weekday"), F.dayofyear(d).alias("day_of_year"), F.weekofyear(d).alias("iso_week"), F.extract(F.lit("YEAROFWEEK"), d).cast("int").alias("iso_year"), F.quarter(d).alias("quarter"), is_leap.alias("leap_year"), F.day(F.last_day(d)).alias("days_in_month"), F.when(is_leap, 366).otherwise(365).alias("days_in_year"))


def relative(delta_seconds: Column) -> Column:
    """``3 hours ago``, ``in 2 days``, ``just now``: the largest whole unit, rounded."""
    size = F.abs(delta_seconds)
    out = F.lit("just now")
    for name, s in (("minute", 60), ("hour", 3600), ("day", 86_400), ("month", 2_592_000), ("year", 31_536_000)):
        n = F.abs(F.floor(delta_seconds / s + 0.5))
        unit = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
        phrase = F.when(delta_seconds < 0, F.concat(unit, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), unit))
        named = {"day": ("yesterday", "tomorrow"), "month": ("last month", "next month"), "year": ("last year", "next year")}.get(name)
        if named:
            phrase = F.when((n == 1) & (delta_seconds < 0), named[0]).when(n == 1, named[1]).otherwise(phrase)
        out = F.when(size >= s, phrase).otherwise(out)
    return out


def epoch_seconds(ns: Column) -> Column:
    """Exact decimal seconds without trailing zeros."""
    digits = F.abs(ns.cast("decimal(38,0)")).cast("string")  # a division would round to six places
    digits = F.lpad(digits, F.greatest(F.lit(10), F.length(digits)), F.lit("0"))
    whole, rest = F.substring(digits, F.lit(1), F.length(digits) - 9), F.regexp_replace(F.substring(digits, F.length(digits) - 8, F.lit(9)), "0+$", "")
    return F.concat(F.when(ns < 0, "-").otherwise(""), whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))


def interpret(df: DataFrame, text_col: str, zone: str = "UTC", mode: str = "auto", unit: str = "auto", system: str = "1900") -> DataFrame:
    """``df`` with ``parsed``, ``resolved`` (wall times in ``zone``), ``instant_ns``, and findings by id."""
    out = df.withColumn("parsed", parse_column(F.col(text_col), mode, unit, system)).withColumn("resolved", resolve_column(F.col("parsed.wall_ns"), F.lit(zone)))
    out = out.withColumn("instant_ns", F.coalesce("parsed.epoch_ns", "resolved.chosen_ns"))
    ids = F.array_compact(F.array(F.concat(F.lit("kind-"), F.col("parsed.status")), F.when(F.col("resolved.status") == "ambiguous", "dst-fold"), F.when(F.col("resolved.status") == "gap", "dst-gap"), F.when((F.col("parsed.kind") == "unix") & F.col("parsed.note").isNotNull(), "unit-assumed"), F.when(F.col("parsed.kind") == "excel", "excel-note"), F.when((F.col("parsed.kind") == "iso") & F.col("parsed.note").isNotNull(), "assumption"), F.when(F.col("instant_ns") % 1000 != 0, "precision"), F.when(F.col("parsed.code") == "out-of-range", "range")))
    return out.withColumn("finding_ids", ids)


def summary(df: DataFrame, text_col: str) -> DataFrame:
    """One line of plain text per interpreted row."""
    p = F.col("parsed")
    line = F.when(p["status"] == "error", F.concat(F.lit("error: "), p["code"])).when(p["status"] == "ambiguous", F.concat(F.lit("ambiguous: "), F.array_join(F.coalesce(p["candidates"], F.array().cast("array<string>")), " or "))).when(p["status"] == "empty", "empty").otherwise(F.concat_ws(" ", p["status"], p["iso"], p["note"]))
    return df.withColumn("summary", F.concat(F.col(text_col), F.lit(" -> "), line))
