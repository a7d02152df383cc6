"""Conversation stamps to UTC instants (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.timestamps import iso_utc, with_utc_ms


def message_stamp(unixtime: str = "date_unixtime", raw: str = "date_raw"):
    """A message's stamp: its unix time if that is a number above 0, else the raw date."""
    number = F.trim(F.col(unixtime)).try_cast("double")
    usable = F.trim(F.col(unixtime)).rlike(r"^\d+(\.\d+)?$") & (number > 0)
    return F.when(usable, F.trim(F.col(unixtime))).otherwise(F.col(raw))


def with_instants(rows: DataFrame, exports: DataFrame, stamp: str, out: str = "utc_ms") -> DataFrame:
    """``rows`` (with ``export_id`` and the text column ``stamp``) with ``out``, UTC milliseconds or null.

    Zone and day order come from ``exports`` by ``export_id``; rows whose export is unknown or null keep null ones. The
    lookup is left to the planner, which broadcasts it only below its size threshold. A repeated export row cannot
    repeat a row of ``rows``.
    """
    lookup = exports.groupBy(F.col("export_id").alias("__x")).agg(
        F.min("zone_name").alias("__zone"), F.min("day_order").alias("__order")
    )
    joined = rows.join(lookup, rows["export_id"] == lookup["__x"], "left")
    return with_utc_ms(joined, stamp, "__zone", "__order", out).drop("__x", "__zone", "__order")


def normalise_stamps(rows: DataFrame, exports: DataFrame, kind: str, key: str, stamp) -> DataFrame:
    """(record_kind, record_id, stamp, utc): every stamped row once, ``utc`` an ISO instant or ``none``.

    Rows without a stamp or key are left out; repeated rows count once. ``stamp`` is a Column.
    """
    picked = rows.select(F.col(key).alias("record_id"), F.col("export_id"), stamp.alias("stamp"))
    picked = picked.where(F.col("stamp").isNotNull() & F.col("record_id").isNotNull()).dropDuplicates(["record_id"])
    done = with_instants(picked, exports, "stamp")
    return done.select(F.lit(kind).alias("record_kind"), F.col("record_id").cast("long").alias("record_id"), "stamp", F.coalesce(iso_utc(F.col("utc_ms")), F.lit("none")).alias("utc"))
