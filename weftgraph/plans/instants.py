"""Queries of problem 4 (timestamps)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.instants import message_stamp, normalise_stamps
from weftgraph.sources.tables import table


def _stamped(spark: SparkSession, sf_dir: str, cases_only: bool) -> DataFrame:
    exports = table(spark, sf_dir, "exports", ("export_id", "zone_name", "day_order"))
    turns = table(spark, sf_dir, "turns", ("turn_id", "export_id", "occurred_at"))
    messages = table(spark, sf_dir, "chat_messages", ("row_id", "export_id", "date_raw", "date_unixtime"))
    if cases_only:
        ten_digits = F.trim("date_unixtime").rlike(r"^\d{10}$") & (F.trim("date_unixtime").try_cast("long") > 0)
        messages = messages.where(~F.coalesce(ten_digits, F.lit(False)))
    return normalise_stamps(turns, exports, "turn", "turn_id", F.col("occurred_at")).unionByName(
        normalise_stamps(messages, exports, "message", "row_id", message_stamp())
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp of turns and messages that is not yet its UTC instant, with that instant or ``none``."""
    return _stamped(spark, sf_dir, True).where(F.col("stamp") != F.col("utc")).drop("stamp")


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp with its UTC instant, unix-second stamps and ready ones included."""
    return _stamped(spark, sf_dir, False)


QUERIES = {"p4_found": p4_found, "p4_instants": p4_instants}
ORACLES: dict[str, str] = {}
