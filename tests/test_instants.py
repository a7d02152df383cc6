"""Problem 4 against zoneinfo and authored stamps."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from weftgraph.functions.timestamps import iso_utc, with_utc_ms
from weftgraph.operators.instants import message_stamp, normalise_stamps

CASES = [
    ("2024-03-31T00:03:57.314Z", None, None, "2024-03-31T00:03:57.314Z"),
    ("2024-03-31t01:36:04.298z", None, None, "2024-03-31T01:36:04.298Z"),
    ("2024-03-31T02:57:02,073271602Z", None, None, "2024-03-31T02:57:02.073Z"),
    ("2024-03-31T01:15:11+01:00", None, None, "2024-03-31T00:15:11.000Z"),
    ("2023-04-09 01:15:52 +0545", None, None, "2023-04-08T19:30:52.000Z"),
    ("2024-03-31 01:54:47+01", None, None, "2024-03-31T00:54:47.000Z"),
    ("2024-03-31 03:32:04 CEST", None, None, "2024-03-31T01:32:04.000Z"),
    ("20240331T001446Z", None, None, "2024-03-31T00:14:46.000Z"),
    ("2024-091T02:32:09Z", None, None, "2024-03-31T02:32:09.000Z"),
    ("2023-366T02:32:09Z", None, None, "none"),
    ("Sun, 31 Mar 2024 01:48:59 +0100", None, None, "2024-03-31T00:48:59.000Z"),
    ("Mon, 31 Mar 2024 01:48:59 +0100", None, None, "none"),
    ("Sun Mar 31 2024 01:10:19 GMT+0100", None, None, "2024-03-31T00:10:19.000Z"),
    ("Thu Nov 03 2022 00:00:25 GMT-0400 (EDT)", None, None, "2022-11-03T04:00:25.000Z"),
    ("4 Oct 2022 14:53 UTC", None, None, "2022-10-04T14:53:00.000Z"),
    ("March 31, 2024 1:58 AM", "Europe/London", None, "none"),
    ("October 27, 2024 1:58 AM", "Europe/London", None, "none"),
    ("October 27, 2024 12:58 AM", "Europe/London", None, "2024-10-26T23:58:00.000Z"),
    ("31.03.2024, 01:16", "UTC", "mdy", "2024-03-31T01:16:00.000Z"),
    ("10/5/24, 9:53 PM", "America/New_York", "mdy", "2024-10-06T01:53:00.000Z"),
    ("10/5/24, 9:53 PM", "America/New_York", "dmy", "2024-05-11T01:53:00.000Z"),
    ("10/5/24, 9:53 PM", "America/New_York", None, "none"),
    ("15/4/23, 12:02 AM", "UTC", None, "2023-04-15T00:02:00.000Z"),
    ("5/5/23, 12:02 AM", "UTC", None, "2023-05-05T00:02:00.000Z"),
    ("15/4/23, 13:02 PM", "UTC", None, "none"),
    ("2024/03/31, 1:01 AM", "Asia/Tokyo", "ymd", "2024-03-30T16:01:00.000Z"),
    ("2024-03-31T01:16:00", None, None, "none"),
    ("2024-03-31T01:16:00", "Mars/Olympus", None, "none"),
    ("2023-06-31 11:20:00+02:00", "UTC", None, "none"),
    ("0000-00-00 00:00:00", "UTC", None, "none"),
    ("2024-02-29T23:59:60Z", "UTC", None, "none"),
    ("1711845297.215", None, None, "2024-03-31T00:34:57.215Z"),
    ("1711843577958", None, None, "2024-03-31T00:06:17.958Z"),
    ("1711843345278910", None, None, "2024-03-31T00:02:25.278Z"),
    ("171184334527", None, None, "none"),
    ("", "UTC", None, "none"),
    ("   ", "UTC", None, "none"),
    ("yesterday 14:05", "UTC", None, "none"),
    ("x" * 200_000, "UTC", None, "none"),
    ("Mayor 5, 2024 10:00 UTC", None, None, "none"),
    ("Marble 5, 2024 10:00 UTC", None, None, "none"),
    ("5 Janitor 2024 10:00 UTC", None, None, "none"),
    ("Sunny, 31 Mar 2024 01:48:59 +0100", None, None, "none"),
    ("Sept. 5, 2024 10:00 UTC", None, None, "2024-09-05T10:00:00.000Z"),
    ("Sunday, 31 March 2024 01:48:59 +0100", None, None, "2024-03-31T00:48:59.000Z"),
    ("2024-03-31 01:48:59 (whatever)", "UTC", None, "none"),
    ("2024-W01-1T10:00Z", None, None, "2024-01-01T10:00:00.000Z"),
    ("2020-W53-7 10:00", "UTC", None, "2021-01-03T10:00:00.000Z"),
    ("2021-W53-1T10:00Z", None, None, "none"),
    ("2021-W00-1T10:00Z", None, None, "none"),
    ("2024-03-31", "UTC", None, "none"),
]


def test_authored_stamps(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, s string, z string, o string, want string")
    got = with_utc_ms(df, "s", "z", "o", "ms").select("i", "s", F.coalesce(iso_utc(F.col("ms")), F.lit("none")).alias("utc"), "want").collect()
    assert len(got) == len(CASES)
    assert [(r.s[:50], r.utc) for r in got] == [(r.s[:50], r.want) for r in got]


def test_local_times_against_zoneinfo(spark):
    """Every quarter hour around the changes of several zones: the local times that exist once, and no others."""
    rows, rng = [], random.Random(4)
    for zone in ("Europe/Berlin", "America/St_Johns", "Australia/Sydney", "Asia/Kathmandu", "America/New_York", "Australia/Lord_Howe"):
        for start in (dt.datetime(2024, 3, 9), dt.datetime(2024, 3, 30), dt.datetime(2024, 4, 6), dt.datetime(2024, 10, 5), dt.datetime(2024, 10, 26), dt.datetime(2024, 11, 2)):
            for k in range(0, 48 * 4):
                if rng.random() < 0.7:
                    rows.append((zone, start + dt.timedelta(minutes=15 * k)))
    want = {}
    for zone, t in rows:
        z, utc = ZoneInfo(zone), set()
        for fold in (0, 1):
            u = t.replace(tzinfo=z, fold=fold).astimezone(dt.timezone.utc)
            if u.astimezone(z).replace(tzinfo=None) == t:
                utc.add(u)
        want[zone, t.isoformat()] = utc.pop().strftime("%Y-%m-%dT%H:%M:%S.000Z") if len(utc) == 1 else "none"
    df = spark.createDataFrame([(z, t.isoformat(), None) for z, t in rows], "z string, s string, o string")
    got = with_utc_ms(df, "s", "z", "o", "ms").select("z", "s", F.coalesce(iso_utc(F.col("ms")), F.lit("none")).alias("utc")).collect()
    assert {(r.z, r.s): r.utc for r in got} == want


def test_rows_null_repeated_and_empty(spark):
    exports = spark.createDataFrame([(1, "UTC", None), (1, "UTC", None), (2, None, None)], "export_id int, zone_name string, day_order string")
    rows = [(1, 1, "2024-01-01T00:00:00", "NaN"), (1, 1, "2024-01-01T00:00:00", "NaN"), (2, None, "2024-01-01T00:00:00", "0"), (3, 9, None, "1711845297.2159"), (4, 1, None, None), (None, 1, "x", None)]
    df = spark.createDataFrame(rows, "row_id long, export_id int, date_raw string, date_unixtime string").withColumn("utc", F.lit("clash"))
    got = {tuple(r) for r in normalise_stamps(df, exports, "message", "row_id", message_stamp()).select("record_id", "utc").collect()}
    assert got == {(1, "2024-01-01T00:00:00.000Z"), (2, "none"), (3, "2024-03-31T00:34:57.215Z")}
    assert normalise_stamps(df.limit(0), exports, "message", "row_id", message_stamp()).count() == 0
