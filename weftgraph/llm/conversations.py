"""Message rows to ordered conversations (problem 5).

Every reply is a constraint: the message it names must exist in the conversation and come before it. The senders' clock
offsets are estimated by least squares over the reply constraints that the written times violate, until no further one
is violated, the times corrected, replies that are still early moved to what they answer, and the messages merged into
one order. A constraint that this order leaves unmet cannot be met by any: its message is missing, is the reply itself or
was numbered later. Conversations with such a constraint are rejected.

Defined results: rows repeated by row_id count once; rows without conv_id belong to no conversation; a row speaks if its
type is ``message`` and its text, pieces joined, has a visible character (white space, controls, format characters such
as the zero-width space, and unassigned code points are not visible); an empty table gives no rows; without any usable
time a message keeps its place by number, next to the message numbered before it that has a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value
from weftgraph.operators.instants import message_stamp, with_instants
from weftgraph.operators.ranks import ordered_rank
from weftgraph.session import cut

MIN_GAP_MS = 1
#: Message numbers of a block, and rows of an hour, beyond which a conversation is cut further.
NUMBERS = 4096


def joined_text(text: Column) -> Column:
    """A plain string as it is; the pieces of a JSON array of strings and objects with ``text`` joined."""
    pieces = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    piece = lambda v: F.coalesce(
        F.try_variant_get(v, "$.text", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit("")
    )
    return F.when(F.ltrim(text).startswith("["), F.coalesce(F.array_join(F.transform(pieces, piece), ""), text)).otherwise(text)


def visible(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\p{IsWhite_Space}\p{C}]"), F.lit(False))


def with_roles(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """Messages with ``duty``: by from_id, or if that is null by from_name; null for unknown ones."""
    by_id = participants.groupBy(F.col("from_id").alias("__i")).agg(F.min("duty").alias("__id_duty"))
    by_name = participants.where(F.col("display_name").isNotNull()).groupBy(F.col("display_name").alias("__n")).agg(F.min("duty").alias("__name_duty"))
    name_key = F.when(F.col("from_id").isNull(), F.col("from_name"))
    joined = messages.join(by_id, messages["from_id"] == F.col("__i"), "left").join(by_name, name_key == F.col("__n"), "left")
    return joined.withColumn("duty", F.coalesce("__id_duty", F.when(F.col("from_id").isNull(), F.col("__name_duty")))).drop("__i", "__n", "__id_duty", "__name_duty")


def speaking_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, fault) of rows (conv_id, speaks, duty): ``empty``, ``unanswered`` or null."""
    has = lambda c: F.max(F.when(c, 1).otherwise(0))
    voices = rows.groupBy("conv_id").agg(has(F.col("speaks")).alias("any"), has(F.col("speaks") & (F.col("duty") == "asker")).alias("asker"), has(F.col("speaks") & (F.col("duty") == "helper")).alias("helper"))
    return voices.select("conv_id", F.when(F.col("any") == 0, "empty").when((F.col("asker") == 0) | (F.col("helper") == 0), "unanswered").alias("fault"))


def unmet_constraints(rows: DataFrame) -> DataFrame:
    """Conversations of ``rows`` (corrected and in order) with a reply that does not stand behind an earlier message it answers.

    The order is that of the turns. A message that is missing, or was numbered later, is one that no correction of the
    clocks can put before its reply.
    """
    replies = rows.where("reply_to_id IS NOT NULL").select("conv_id", "row_id", "message_id", "reply_to_id", F.struct("corrected_ms", "message_id").alias("place"))
    targets = rows.where("message_id IS NOT NULL").groupBy(F.col("conv_id").alias("c"), F.col("message_id").alias("m")).agg(F.min(F.struct("corrected_ms", "message_id")).alias("before"))
    met = F.coalesce((F.col("m") < F.col("message_id")) & (F.col("before") < F.col("place")), F.lit(False))
    return replies.join(targets, (F.col("conv_id") == F.col("c")) & (F.col("reply_to_id") == F.col("m")), "left").where(~met).select("conv_id").distinct()


def _fitted(pairs: pd.DataFrame) -> pd.DataFrame:
    """Offsets of one conversation's senders, and which of its pairs the fit leaves with constraints not yet counted.

    Conjugate gradients on the normal equations, scaled by each sender's weight, run to the end: at most as many steps as
    there are senders, but for rounding.
    """
    n = len(pairs)
    names, index = np.unique(np.concatenate([pairs["s"].to_numpy(object), pairs["r"].to_numpy(object)]), return_inverse=True)
    i, j, w, d = index[:n], index[n:], pairs["w"].to_numpy(float), pairs["d"].fillna(0.0).to_numpy(float)
    total = lambda at, x: np.bincount(at, x, len(names))
    weight = np.maximum(total(i, w) + total(j, w), 1e-9)
    o, left = np.zeros(len(names)), total(i, w * d) - total(j, w * d)
    least, step, size = 1e-9 * np.abs(left).max(), left / weight, left @ (left / weight)
    for _ in range(10 * len(names) + 100):
        if np.abs(left).max() <= least:
            break
        pull = total(i, w * (step[i] - step[j])) - total(j, w * (step[i] - step[j]))
        if not step @ pull > 0:  # nothing but rounding is left
            break
        k = size / (step @ pull)
        o, left = o + k * step, left - k * pull
        size, before = left @ (left / weight), size
        step = left / weight + size / before * step
    apart = o[i] - o[j]
    again = bool((pairs["rest"].fillna(-np.inf).to_numpy(float) > apart + 0.5).any())
    held = pd.DataFrame({"s": pairs["s"].to_numpy(object), "r": pairs["r"].to_numpy(object), "o": np.minimum(pairs["f"].to_numpy(float), apart)})
    out = pd.concat([held, pd.DataFrame({"s": names, "r": None, "o": o})]).assign(conv_id=pairs["conv_id"].iloc[0], again=again)
    return out[["conv_id", "s", "r", "o", "again"]]


def clock_offsets(timed: DataFrame) -> DataFrame:
    """(conv_id, sender, offset_ms) by least squares over the violated reply constraints.

    Every reply says t_reply + o_reply >= t_message + o_message + 1 ms. The violated ones are summed per pair of
    senders (weight and mean violation) and the normal equations of a conversation's pairs solved. Constraints that
    the offsets violate for the first time join the others, and the conversation is fitted again until none is new.
    Only sender pairs of a conversation meet in a task, never its messages.
    """
    a = timed.where("reply_to_id < message_id AND utc_ms IS NOT NULL").select("conv_id", "reply_to_id", F.col("sender").alias("s"), F.col("utc_ms").alias("t"))
    b = timed.select(F.col("conv_id").alias("c"), F.col("message_id").alias("m"), F.col("sender").alias("r"), F.col("utc_ms").alias("u")).where("u IS NOT NULL")
    met = a.join(b, (F.col("conv_id") == F.col("c")) & (F.col("reply_to_id") == F.col("m"))).where(F.col("s") != F.col("r"))
    wants = cut(met.select("conv_id", "s", "r", (F.col("u") - F.col("t") + MIN_GAP_MS).cast("double").alias("want")))
    wants = wants.join(wants.where("want > 0").select("conv_id").distinct(), "conv_id", "left_semi").withColumn("f", F.lit(0.0))
    done = None
    while True:
        # A constraint counts once any fit so far has violated it: f is the least distance of the pair's offsets seen.
        late = F.col("want") > F.col("f")
        pairs = wants.groupBy("conv_id", "s", "r").agg(F.count(F.when(late, 1)).cast("double").alias("w"), F.avg(F.when(late, F.col("want"))).alias("d"), F.max(F.when(~late, F.col("want"))).alias("rest"), F.min("f").alias("f"))
        fitted = cut(pairs.groupBy("conv_id").applyInPandas(lambda g: _fitted(g), "conv_id string, s string, r string, o double, again boolean"))
        settled = fitted.where("r IS NULL AND NOT again")
        done = settled if done is None else done.unionByName(settled)
        if fitted.where("again").isEmpty():
            break
        floors = fitted.where("again AND r IS NOT NULL").select("conv_id", "s", "r", F.col("o").alias("f"))
        wants = cut(wants.drop("f").join(floors, ["conv_id", "s", "r"]))
    return done.select("conv_id", F.col("s").alias("sender"), F.round("o").cast("long").alias("offset_ms"))


def _number_block() -> Column:
    return F.coalesce(F.floor(F.col("message_id") / NUMBERS), F.lit((1 << 63) - 1))


def with_neighbours_times(rows: DataFrame) -> DataFrame:
    """``rows`` with null ``corrected_ms`` filled: the last known one before by message number, else the next, else 0.

    Windows run within blocks of message numbers, and what a block lacks comes from the blocks around it.
    """
    gaps = cut(rows.where("corrected_ms IS NULL").select("conv_id").distinct())
    if gaps.isEmpty():
        return rows
    some = rows.join(gaps, "conv_id", "left_semi").withColumn("__b", _number_block())
    place, known = F.struct(F.coalesce("message_id", F.lit((1 << 63) - 1)), "row_id"), F.col("corrected_ms").isNotNull()
    ends = some.groupBy("conv_id", "__b").agg(F.max_by("corrected_ms", F.when(known, place)).alias("l"), F.min_by("corrected_ms", F.when(known, place)).alias("f"))
    seen = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    blocks = W.partitionBy("conv_id")
    past = lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    around = ends.select(F.col("conv_id").alias("__c"), F.col("__b").alias("__k"), past("l", blocks.orderBy("__b")).alias("__p"), past("f", blocks.orderBy(F.desc("__b"))).alias("__n"))
    inside = W.partitionBy("conv_id", "__b")
    near = some.withColumns({"__l": seen("corrected_ms", inside.orderBy(place)), "__f": seen("corrected_ms", inside.orderBy(place.desc()))})
    joined = near.join(around, (near["conv_id"] == F.col("__c")) & (near["__b"] == F.col("__k")))
    filled = joined.withColumn("corrected_ms", F.coalesce("corrected_ms", "__l", "__p", "__f", "__n", F.lit(0))).select(*rows.columns)
    return rows.join(gaps, "conv_id", "left_anti").select(*rows.columns).unionByName(filled)


def in_reply_order(rows: DataFrame) -> DataFrame:
    """``rows`` with ``corrected_ms`` raised where no offsets could meet a reply: to the latest of what it answers.

    What a message answers, directly or through others, is found by doubling: every round looks twice as far back.
    Only conversations with such a reply take part.
    """
    values = rows.where("message_id IS NOT NULL").groupBy("conv_id", F.col("message_id").alias("n")).agg(F.max("corrected_ms").alias("v"))
    above = values.select(F.col("conv_id").alias("c"), F.col("n").alias("m"), "v")
    replies = rows.where("reply_to_id < message_id").select("conv_id", F.col("message_id").alias("n"), F.col("reply_to_id").alias("a"), "corrected_ms")
    early = cut(replies.join(above, (F.col("conv_id") == F.col("c")) & (F.col("a") == F.col("m"))).where("v > corrected_ms").select("conv_id").distinct())
    if early.isEmpty():
        return rows
    values = cut(values.join(early, "conv_id", "left_semi"))
    edges = cut(replies.join(early, "conv_id", "left_semi").select("conv_id", "n", "a").distinct())
    while not edges.isEmpty():
        above = values.select("conv_id", F.col("n").alias("a"), F.col("v").alias("u"))
        raised = edges.join(above, ["conv_id", "a"]).groupBy("conv_id", "n").agg(F.max("u").alias("u"))
        values = cut(values.join(raised, ["conv_id", "n"], "left").select("conv_id", "n", F.greatest("v", "u").alias("v")))
        edges = cut(edges.join(edges.select("conv_id", F.col("n").alias("a"), F.col("a").alias("b")), ["conv_id", "a"]).select("conv_id", "n", F.col("b").alias("a")).distinct())
    above = values.select(F.col("conv_id").alias("__c"), F.col("n").alias("__n"), F.col("v").alias("__v"))
    joined = rows.join(above, (rows["conv_id"] == F.col("__c")) & (rows["reply_to_id"] == F.col("__n")), "left")
    raised = F.when(F.col("reply_to_id") < F.col("message_id"), F.greatest("corrected_ms", "__v")).otherwise(F.col("corrected_ms"))
    return joined.withColumn("corrected_ms", raised).drop("__c", "__n", "__v")


def ordered_messages(messages: DataFrame, exports: DataFrame, participants: DataFrame) -> DataFrame:
    """Every message once with duty, sender, body, speaks, utc_ms and ``corrected_ms``, by which its conversation is ordered."""
    once = messages.where(F.col("conv_id").isNotNull()).dropDuplicates(["row_id"]).withColumn("stamp", message_stamp())
    timed = with_instants(once, exports, "stamp").withColumns({"sender": F.coalesce("from_id", "from_name", F.lit("")), "body": joined_text(F.col("text"))})
    speaks = F.coalesce((F.col("msg_type") == "message") & visible(F.col("body")), F.lit(False))
    base = cut(with_roles(timed.select("conv_id", "row_id", "message_id", "reply_to_id", "from_id", "from_name", "sender", "utc_ms", "body", speaks.alias("speaks")), participants))
    offsets = clock_offsets(base).select(F.col("conv_id").alias("__c"), F.col("sender").alias("__s"), "offset_ms")
    moved = base.join(offsets, (base["conv_id"] == F.col("__c")) & (base["sender"] == F.col("__s")), "left")
    corrected = cut(with_neighbours_times(cut(moved.withColumn("corrected_ms", F.col("utc_ms") + F.coalesce("offset_ms", F.lit(0))).drop("__c", "__s"))))
    return cut(in_reply_order(corrected))


def conversation_faults(ordered: DataFrame) -> DataFrame:
    """(conv_id, fault) of every conversation of ordered_messages(): ``empty``, ``broken``, ``unanswered`` or null.

    Broken are those with a reply constraint that the corrected order leaves unmet. Both halves are aggregated before they
    meet, so a conversation may hold any share of the rows.
    """
    unmet = unmet_constraints(ordered).select(F.col("conv_id").alias("__c"))
    joined = speaking_faults(ordered).join(unmet, F.col("conv_id") == F.col("__c"), "left")
    return joined.select("conv_id", F.when(F.col("fault") == "empty", F.col("fault")).when(F.col("__c").isNotNull(), "broken").otherwise(F.col("fault")).alias("fault"))


def rebuild(messages: DataFrame, exports: DataFrame, participants: DataFrame) -> DataFrame:
    """The turns of every sound conversation: conv_id, turn_no, row_id, role, sender, utc_ms, corrected_ms, text."""
    ordered = ordered_messages(messages, exports, participants)
    sound = conversation_faults(ordered).where(F.col("fault").isNull()).select(F.col("conv_id").alias("__k"))
    fixed = ordered.join(sound, ordered["conv_id"] == sound["__k"], "left_semi").where("speaks")
    role = F.when(F.col("duty") == "asker", "user").when(F.col("duty") == "helper", "assistant").when(F.col("duty") == "system", "system").otherwise("other")
    turns = fixed.select("conv_id", "row_id", "message_id", role.alias("role"), "sender", "utc_ms", "corrected_ms", F.col("body").alias("text"))
    order = [F.col("corrected_ms"), F.col("message_id").asc_nulls_last(), F.col("row_id")]
    placed = cut(turns.withColumn("__h", F.floor(F.col("corrected_ms") / 3_600_000)))
    # Monotone in the order: a long conversation is numbered by hours, full hours by times and message numbers.
    full = placed.groupBy("conv_id", "__h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NUMBERS).select(F.col("conv_id").alias("__c"), F.col("__h").alias("__f"))
    marked = placed.join(full, (placed["conv_id"] == F.col("__c")) & (placed["__h"] == F.col("__f")), "left")
    is_full = F.col("__f").isNotNull()
    slices = F.struct("__h", F.when(is_full, F.col("corrected_ms")).alias("t"), F.when(is_full, _number_block()).alias("k"))
    return ordered_rank(marked, ["conv_id"], order, "turn_no", slices).drop("__h", "__c", "__f")


by_value(__name__)
