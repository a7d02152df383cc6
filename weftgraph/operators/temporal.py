"""Valid and transaction time: states, intervals, as-of counts, trust, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL_PREFIXES = ("cv-", "pdf:tesseract", "pdf:mistral", "pdf:docling", "pdf:marker", "pdf:chandra")
#: how loud a trust state is
SEVERITY = {"ungrounded": 6, "uncertain": 5, "superseded": 4, "contradicted": 4, "tool-derived": 3, "grounded": 2, "unknown": 1}


def state_at(start: Column, end: Column, t: Column) -> Column:
    """``future``, ``superseded`` or ``active``; an unbounded side never excludes."""
    return F.when(t < start, "future").when(t >= end, "superseded").otherwise("active")


def entity_intervals(observations: DataFrame) -> DataFrame:
    """(name, start, end): from the first start to the last end; one open end keeps the entity open."""
    open_end = F.bool_or(F.col("invalid_at").isNull())
    return observations.groupBy("name").agg(F.min("valid_at").alias("start"), F.when(~open_end, F.max("invalid_at")).alias("end"))


def as_of(intervals: DataFrame, moments: DataFrame) -> DataFrame:
    """(t, active): intervals that hold at each moment, by running sums over sorted edges, without pairing the two.

    Starts count +1, ends -1; the sum up to a moment is taken from totals per slice plus the edges within its slice.
    """
    from pyspark.sql import Window as W

    edges = intervals.select(F.explode(F.array(F.struct(F.coalesce("start", F.lit("0001-01-01").cast("timestamp")).alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("e.t", "e.d").where("t IS NOT NULL")
    marks = edges.groupBy("t").agg(F.sum("d").alias("d"), F.lit(False).alias("asked")).unionByName(moments.select(F.col("t"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("asked")))
    sliced = marks.withColumn("slice", F.to_date("t"))
    totals = sliced.groupBy("slice").agg(F.sum("d").alias("sum"))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # one row per day
    base = totals.select("slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("slice").orderBy("t", F.col("asked").cast("int")).rowsBetween(W.unboundedPreceding, 0)
    run = sliced.withColumn("run", F.sum("d").over(inside)).where("asked")
    return run.join(base, "slice").select("t", (F.col("base") + F.col("run")).cast("long").alias("active"))


def first_seen(facts: DataFrame) -> DataFrame:
    return facts.groupBy("name").agg(F.min("valid_at").alias("first_seen"))


def axis_coverage(observations: DataFrame) -> DataFrame:
    """How many observations can be placed on either end, and the axis' domain (never empty)."""
    low, high = F.min("valid_at"), F.max(F.coalesce("invalid_at", "valid_at"))
    out = observations.agg(F.count(F.lit(1)).alias("n"), F.count("valid_at").alias("with_start"), F.count("invalid_at").alias("with_end"), low.alias("low"), high.alias("high"))
    return out.withColumn("high", F.when(F.col("high") <= F.col("low"), F.col("low") + F.expr("interval 1 millisecond")).otherwise(F.col("high")))


def observation_trust(invalid: Column, grounded: Column, adapter: Column) -> Column:
    tool = F.lit(False)
    for p in TOOL_PREFIXES:
        tool = tool | F.coalesce(adapter.startswith(p), F.lit(False))
    return F.when(invalid.isNotNull(), "superseded").when(~grounded, "ungrounded").when(tool, "tool-derived").when(grounded, "grounded").otherwise("unknown")


def relation_trust(faithfulness: Column, grounded: Column, resolved: Column) -> Column:
    return (
        F.when(faithfulness == "unsupported", "ungrounded").when(faithfulness == "uncertain", "uncertain").when(faithfulness == "supported", "grounded")
        .when(~grounded, "ungrounded").when(grounded, "grounded").when(~resolved, "uncertain").otherwise("unknown")
    )


def node_trust(observations: DataFrame) -> DataFrame:
    """(name, state, confidence): the loudest state, the first of equals by ``ord``; the mean of what confidence there is."""
    state = observation_trust(F.col("invalid_at"), F.col("grounded"), F.col("source_adapter"))
    loud = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    rated = observations.withColumn("state", state).withColumn("severity", F.try_element_at(loud, F.col("state")))
    return rated.groupBy("name").agg(F.max_by("state", F.struct("severity", (-F.col("ord")).alias("o"))).alias("state"), F.avg(F.coalesce("confidence", "grounding_score")).alias("confidence"))


def expired(written: Column, now: Column, ttl_hours: float, transient: Column) -> Column:
    """Transient failures are forgotten after a while; an unreadable time counts as expired."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(written)) / 3600
    return F.when(transient, F.coalesce(age > ttl_hours, F.lit(True))).otherwise(F.lit(False))


def cost_ledger(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, calls, tokens, cost): the exact price, else that of the longest key the model's name holds, else 0."""
    models = calls.select("model").distinct()
    fits = models.join(F.broadcast(prices), models["model"].contains(prices["key"]))  # a price list is a few rows
    best = fits.groupBy("model").agg(F.max_by("price", F.struct((F.col("key") == F.col("model")).alias("x"), F.length("key").alias("n"))).alias("price"))
    used = calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    return used.join(best, "model", "left").select("model", "calls", "tokens", (F.col("tokens") * F.coalesce("price", F.lit(0.0))).alias("cost"))


def within_budget(calls: DataFrame, keys: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """Calls made before the running cost of their group had passed the cap: only strictly more stops it."""
    from pyspark.sql import Window as W

    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return calls.withColumn("spent_before", F.coalesce(F.sum(cost).over(before), F.lit(0.0))).where(F.col("spent_before") <= cap)
