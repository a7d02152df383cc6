"""Timestamps of many notations and zones to one UTC instant, inside the JVM.

An ordered cascade of anchored patterns; the first that matches the whole stamp decides, and what it names must be a
possible date and time. Stamps without a zone take the source's zone; a local time that the zone's clock showed twice
or never has no single instant and gives null.

Notations: ISO dates, ordinal dates and weeks, mail and script dates, dates with dots or slashes, each with a clock, and Unix
time. Month and weekday names are English, whole or in their usual abbreviations; a date without a clock is no instant.

Defined results: a null or blank stamp, an unknown notation, an impossible date (31 June, hour 25, second 60, 13 PM, a
weekday that is not the date's), an unknown zone or zone abbreviation, and a slash date that can be read in two ways all
give null. Digits finer than a millisecond are cut off, coarser ones filled with zeros. Nothing here depends on the
session's own time zone.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.similarity import let

# English month and weekday names, and the civil abbreviations that name one offset (minutes).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "nst": -210, "ndt": -150,
    "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780, "npt": 345,
}

#: one parsed expression instead of hundreds of literals sent one by one
_KNOWN_ZONES = ", ".join(f"'{z}'" for z in sorted(available_timezones()))
_SEP = "\u0001"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:[   ]?([AaPp])\.?[Mm]\.?)?"
# A zone may be followed by its name in brackets.
_ZONE = r"(?: ?(?:GMT|UTC)?(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5})(?: \([A-Za-z][A-Za-z0-9 /_+:.'-]*\))?)?"
_DAY = r"(?:(Mon(?:day)?|Tue(?:s|sday)?|Wed(?:nesday)?|Thu(?:r|rs|rsday)?|Fri(?:day)?|Sat(?:urday)?|Sun(?:day)?)\.?,? )?"
_MON = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"

# The cascade: kind, pattern, and the group numbers of year, month, day, weekday and of the first clock group (hour,
# minute, second, fraction, half of the day, zone follow each other). "slash" holds its three numbers as written.
_CASCADE = (
    ("iso", rf"(\d{{4}})-(\d{{2}})-(\d{{2}})[T ]{_CLOCK}{_ZONE}", (1, 2, 3, 0, 4)),
    ("week", rf"(\d{{4}})-W(\d{{2}})-(\d)[T ]{_CLOCK}{_ZONE}", (1, 2, 3, 0, 4)),
    ("yday", rf"(\d{{4}})-(\d{{3}})[T ]{_CLOCK}{_ZONE}", (1, 0, 2, 0, 3)),
    ("mail", rf"{_DAY}(\d{{1,2}}) {_MON} (\d{{4}}),? {_CLOCK}{_ZONE}", (4, 3, 2, 1, 5)),
    ("script", rf"{_DAY}{_MON} (\d{{1,2}}),? (\d{{4}}),? (?:at )?{_CLOCK}{_ZONE}", (4, 2, 3, 1, 5)),
    ("dots", rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),? {_CLOCK}{_ZONE}", (3, 2, 1, 0, 4)),
    ("year", rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}),? {_CLOCK}{_ZONE}", (1, 2, 3, 0, 4)),
    ("slash", rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),? {_CLOCK}{_ZONE}", (3, 1, 2, 0, 4)),
)
_COMPACT = rf"(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}"
_UNIX = r"(\d{10})(?:\.(\d{1,9}))?|(\d{13}|\d{16})"
_FIELDS = ("kind", "y", "m", "d", "w", "h", "mi", "s", "f", "ap", "zone")


def _canonical(stamp: Column) -> Column:
    """The stamp's fields in one order, parted by U+0001, or the stamp itself if no pattern fits.

    Each pattern rewrites the whole stamp or leaves it; a rewritten one begins with U+0001 and fits no later pattern.
    """
    join = lambda kind, parts: _SEP + _SEP.join([kind, *parts])
    c = F.trim(stamp)
    for kind, pattern, (y, m, d, w, k) in _CASCADE:
        refs = [f"${g}" if g else "" for g in (y, m, d, w)] + [f"${k + i}" for i in range(6)]
        c = F.regexp_replace(c, f"(?i)^{pattern}$", join(kind, refs))
    c = F.regexp_replace(c, f"(?i)^{_COMPACT}$", join("iso", ["$1", "$2", "$3", "", "$4", "$5", "$6", "$7", "", "$8"]))
    c = F.regexp_replace(c, f"^(?:{_UNIX})$", join("unix", ["$1$3", "", "", "", "", "", "", "$2", "", "Z"]))
    return c


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a possible date, else null."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= length)
    return F.unix_date(F.make_date(F.when(ok, y), F.when(ok, m), F.when(ok, d)))


def _position(s: Column, names: tuple[str, ...]) -> Column:
    """1-based position of a name's first three letters in ``names``, else null."""
    found = F.array_position(F.array(*map(F.lit, names)), F.lower(F.substring(s, 1, 3)))
    return F.when(found > 0, found.cast("int"))


def _zone_minutes(zone: Column) -> Column:
    """Offset of a written zone in minutes; null for an unknown one."""
    digits = F.rpad(F.regexp_replace(F.substring(zone, 2, 9), ":", ""), 4, "0")
    hh, mm = F.substring(digits, 1, 2).try_cast("int"), F.substring(digits, 3, 2).try_cast("int")
    numeric = F.when((hh <= 18) & (mm <= 59), (hh * 60 + mm) * F.when(zone.startswith("-"), -1).otherwise(1))
    names = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])
    return F.when(zone.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(names, F.lower(zone)))


def _offset_ms(utc_ms: Column, zone: Column) -> Column:
    """The zone's offset at an instant."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(utc_ms), zone)) - utc_ms


def _written(parts: Column, day_order: Column) -> Column:
    """Struct (ms, zone) of the split canonical stamp: the clock as written and the zone as written ('' for none)."""
    p = {name: F.get(parts, i + 1) for i, name in enumerate(_FIELDS)}
    numbers = F.struct(
        *[p[n].try_cast("int").alias(n) for n in ("m", "d", "h", "mi")],
        F.coalesce(p["s"].try_cast("int"), F.lit(0)).alias("s"),
        p["y"].try_cast("int").alias("y2"),
        F.when(F.length(p["y"]) <= 2, p["y"].try_cast("int") + 2000).otherwise(p["y"].try_cast("int")).alias("y"),
        F.coalesce(p["m"].try_cast("int"), _position(p["m"], MONTHS)).alias("month"),
        _position(p["w"], WEEKDAYS).alias("w"),
        F.rpad(F.substring(p["f"], 1, 3), 3, "0").try_cast("int").alias("f"),
    )
    kind, half, order = p["kind"], F.lower(p["ap"]), F.lower(F.trim(day_order))

    def slash(n: Column) -> Column:
        ymd = F.when(F.length(p["y"]) <= 2, _days(n["m"] + 2000, n["d"], n["y2"]))
        either = F.struct(_days(n["y"], n["d"], n["m"]).alias("dmy"), _days(n["y"], n["m"], n["d"]).alias("mdy"))
        alone = lambda e: F.when(e["dmy"].isNull() | e["mdy"].isNull() | (e["dmy"] == e["mdy"]), F.coalesce(e["dmy"], e["mdy"]))
        pick = lambda e: F.when(order == "dmy", e["dmy"]).when(order == "mdy", e["mdy"]).when(order == "ymd", ymd).when(order.isNull(), alone(e))
        return let(either, pick)

    def yday(n: Column) -> Column:
        jan1, next1 = _days(n["y"], F.lit(1), F.lit(1)), _days(n["y"] + 1, F.lit(1), F.lit(1))
        return F.when((n["d"] >= 1) & (jan1 + n["d"] - 1 < next1), jan1 + n["d"] - 1)

    def week(n: Column) -> Column:
        """Week 1 is the one with 4 January; the last week is the one before the next year's first."""
        monday = lambda y: _days(y, F.lit(1), F.lit(4)) - F.pmod(_days(y, F.lit(1), F.lit(4)) + 3, F.lit(7))
        at = monday(n["y"]) + (n["m"] - 1) * 7
        return F.when((n["m"] >= 1) & n["d"].between(1, 7) & (at < monday(n["y"] + 1)), at + n["d"] - 1)

    def civil(n: Column) -> Column:
        hour = F.when(half == "", F.when(n["h"] <= 23, n["h"])).when(n["h"].between(1, 12), n["h"] % 12 + F.when(half == "p", 12).otherwise(0))
        clock = F.when((n["mi"] <= 59) & (n["s"] <= 59), (hour * 60 + n["mi"]) * 60 + n["s"]).cast("long") * 1000 + n["f"]
        days = F.when(kind == "slash", slash(n)).when(kind == "yday", yday(n)).when(kind == "week", week(n)).otherwise(_days(n["y"], n["month"], n["d"]))
        right = lambda d: F.when(n["w"].isNull() | (F.pmod(d + 3, F.lit(7)) + 1 == n["w"]), d.cast("long") * 86_400_000 + clock)
        return let(days, right)

    digits, whole = F.length(p["y"]), p["y"].try_cast("long")
    micros = (whole - F.pmod(whole, F.lit(1000))) / 1000
    unix = F.when(digits == 10, whole * 1000 + F.rpad(F.substring(p["f"], 1, 3), 3, "0").try_cast("int")).when(digits == 13, whole).when(digits == 16, micros.cast("long"))
    return F.struct(F.when(kind == "unix", unix).otherwise(let(numbers, civil)).alias("ms"), p["zone"].alias("zone"))


def _resolved(local: Column, zone: Column) -> Column:
    """UTC milliseconds of a local time, null where the zone's clock showed it twice or never."""
    day = 26 * 3_600_000
    offsets = F.struct(_offset_ms(local - day, zone).alias("a"), _offset_ms(local + day, zone).alias("b"))

    def pick(o: Column) -> Column:
        a, b = local - o["a"], local - o["b"]
        hold = F.struct((_offset_ms(a, zone) == o["a"]).alias("a"), (_offset_ms(b, zone) == o["b"]).alias("b"))
        one = lambda h: F.when(o["a"] == o["b"], F.when(h["a"], a)).when(h["a"] & ~h["b"], a).when(h["b"] & ~h["a"], b)
        return let(hold, one)

    return let(offsets, pick)


def with_utc_ms(df: DataFrame, stamp: str, zone: str, day_order: str, out: str) -> DataFrame:
    """``df`` with ``out``: UTC milliseconds (bigint) of the text column ``stamp``, or null if it names no single instant.

    ``zone`` and ``day_order`` are columns with the source's zone name and its order of slash dates (``dmy``, ``mdy``,
    ``ymd``); both may be null. Without an order a slash date counts if only one of day-first and month-first is
    possible, or both are the same day. A local time is resolved with the zone's offsets a little more than a day
    before and after it, the only two that can hold: each counts if the zone has it at the instant it leads to.

    The value comes out of a generator, so that no filter above it is pushed into it and evaluates it again.
    """
    known = F.expr(f"CASE WHEN `{zone}` IN ({_KNOWN_ZONES}) THEN `{zone}` END")
    local = lambda k: F.when(k["z"].isNotNull() & k["ms"].isNotNull(), _resolved(k["ms"], k["z"]))
    zoned = lambda w: w["ms"] - _zone_minutes(w["zone"]).cast("long") * 60_000
    instant = lambda w: F.when(w["zone"] == "", let(F.struct(w["ms"].alias("ms"), known.alias("z")), local)).otherwise(zoned(w))
    value = let(F.split(_canonical(F.col(stamp)), _SEP), lambda parts: F.when(F.size(parts) > 1, let(_written(parts, F.col(day_order)), instant)))
    return df.withColumn(out, F.explode(F.array(value)))


def iso_utc(ms: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` of UTC milliseconds, whatever the session's zone."""
    day = F.floor(ms / F.lit(86_400_000).cast("decimal(20,0)")).cast("int")
    rest = F.pmod(ms, F.lit(86_400_000).cast("long")).cast("int")
    pad = lambda x, n: F.lpad(F.floor(x).cast("int").cast("string"), n, "0")
    clock = F.concat_ws(":", pad(rest / 3_600_000, 2), pad(rest % 3_600_000 / 60_000, 2), pad(rest % 60_000 / 1000, 2))
    return F.concat(F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("."), pad(rest % 1000, 3), F.lit("Z"))
