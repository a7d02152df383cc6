import json

from pyspark.sql import functions as F

from weftgraph.llm.conversations import clock_offsets, conversation_faults, joined_text, ordered_messages, rebuild, visible
from weftgraph.llm.p5_queries import p5_turns
from weftgraph.sources.tables import table

SCHEMA = "row_id long, export_id int, conv_id string, message_id long, reply_to_id long, msg_type string, from_name string, from_id string, date_raw string, date_unixtime string, text string, duty string, stamp string"
PEOPLE = [("u1", "Ann", "asker"), ("u2", "Bob", "helper"), ("u3", "Sys", "system")]


def message(i, conv, number, reply=None, who="u1", text="hello", kind="message", t=None, name=None):
    return (i, 1, conv, number, reply, kind, name, who, None, str(1_700_000_000 + (t if t is not None else i)), text, "clash", None)


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(PEOPLE, "from_id string, display_name string, duty string"), spark.createDataFrame([(1, "UTC", "dmy")], "export_id int, zone_name string, day_order string")


ROWS = [
    message(1, "good", 1), message(2, "good", 2, 1, "u2"), message(2, "good", 2, 1, "u2"), message(3, "named", 1, None, None, name="Ann"), message(4, "named", 5, 1, None, name="Bob"),
    message(5, "empty", 1, None, "u1", "​ \n"), message(6, "empty", 2, 9, "u2", "hi", "service"), message(7, "broken", 1), message(8, "broken", 2, 7, "u2"), message(9, "later", 3, 4), message(10, "later", 4, None, "u2"), message(11, "self", 1, 1), message(12, "self", 2, None, "u2"),
    message(13, "alone", 1), message(14, "alone", 2, 1), message(15, "unknown", 1, None, "nobody", name="Ann"), message(16, "unknown", 2, None, "u2"), message(17, "quiet", 1), message(18, "quiet", 2, None, "u2", '[{"type": "x"}, "​"]'), message(19, None, 1),
]


def test_states(spark):
    m, people, exports = frames(spark, ROWS)
    got = {r.conv_id: r.fault for r in conversation_faults(ordered_messages(m, exports, people)).collect()}
    assert got == {"good": None, "named": None, "empty": "empty", "broken": "broken", "later": "broken", "self": "broken", "alone": "unanswered", "unknown": "unanswered", "quiet": "unanswered"}
    assert conversation_faults(ordered_messages(m.limit(0), exports, people)).count() == 0


def test_text_pieces(spark):
    texts = ['["Nobody at ", {"type": "link", "text": "Gol"}, " had"]', "[laughs] plain", "plain", '[{"type": "x"}]', '["{a}"]', "[1, 2]", "", None, "x" * 300_000, json.dumps(["​"])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r.j[:20] if r.j is not None else None, r.v) for r in df.select("i", joined_text(F.col("t")).alias("j")).withColumn("v", visible(F.col("j"))).orderBy("i").collect()]
    assert got == [("Nobody at Gol had", True), ("[laughs] plain", True), ("plain", True), ("", False), ("{a}", True), ("", False), ("", False), (None, False), ("x" * 20, True), ("​", False)]


def test_rebuilt_order_and_roles(spark):
    rows = [message(1, "c", 1, None, "u1", "q", t=100), message(2, "c", 2, 1, "u2", "a", t=50), message(3, "c", 3, None, "u1", '["q", {"text": "2"}]', t=110), message(4, "c", 4, 3, "u2", "b", t=60), message(5, "c", 5, None, "u3", "note", "service", t=60)]
    got = rebuild(*[frames(spark, rows)[i] for i in (0, 2, 1)]).orderBy("turn_no").collect()
    assert [(r.turn_no, r.role, r.text) for r in got] == [(1, "user", "q"), (2, "assistant", "a"), (3, "user", "q2"), (4, "assistant", "b")]
    assert all(a.corrected_ms <= b.corrected_ms for a, b in zip(got, got[1:]))


def test_offsets_reduce_violations(spark):
    rows = [("c", i, i - 1 if i % 2 else None, "b" if i % 2 else "a", 1000 * i - (5000 if i % 2 else 0)) for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id string, message_id long, reply_to_id long, sender string, utc_ms long")
    o = {r.sender: r.offset_ms for r in clock_offsets(df).collect()}
    assert 3000 < o["b"] - o["a"] <= 4003


def test_offsets_of_a_chain_of_senders_converge(spark):
    rows = [("c", i, i - 1 if i else None, f"s{i}", 1000 * i - 10_000 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "conv_id string, message_id long, reply_to_id long, sender string, utc_ms long")
    o = {r.sender: r.offset_ms for r in clock_offsets(df).collect()}
    assert all(abs(o[f"s{i}"] - o[f"s{i - 1}"] - 9001) <= 1 for i in range(1, 10))


def test_constraints_that_a_fit_violates_are_counted(spark):
    rows = [("c", 1, None, "a", 10_000), ("c", 2, 1, "b", 0), ("c", 3, None, "b", 20_000), ("c", 4, 3, "a", 22_000)]
    df = spark.createDataFrame(rows, "conv_id string, message_id long, reply_to_id long, sender string, utc_ms long")
    o = {r.sender: r.offset_ms for r in clock_offsets(df).collect()}
    assert abs(o["b"] - o["a"] - 6000) <= 1  # midway between what the late reply and the one that was in time ask for


def test_no_reply_before_its_message(spark):
    rows = [message(1, "c", 1, None, "u1", "q1", t=100), message(2, "c", 2, 1, "u2", "a1", t=99), message(3, "c", 3, None, "u1", "q2", t=110), message(4, "c", 4, 3, "u2", "a2", t=101), message(5, "c", 5, 4, "u2", "a3", t=90), message(6, "c", 6, 5, "u2", "a4", t=91)]
    got = {r.message_id: r for r in rebuild(*[frames(spark, rows)[i] for i in (0, 2, 1)]).collect()}
    assert all(got[i].turn_no > got[j].turn_no and got[i].corrected_ms >= got[j].corrected_ms for i, j in ((2, 1), (4, 3), (5, 4), (6, 5)))


def test_timeless_messages_keep_their_place(spark):
    timeless = lambda r: (*r[:8], "31.02.2023 10:00", None, *r[10:])
    rows = [timeless(message(1, "c", 1)), message(2, "c", 2, None, "u2", "b", t=100), timeless(message(3, "c", 3)), message(4, "c", 5000, None, "u2", "d", t=200), timeless(message(5, "c", 9999, None, "u1", "e")), message(6, "c", 10_000, None, "u2", "f", t=300)]
    got = rebuild(*[frames(spark, rows)[i] for i in (0, 2, 1)]).orderBy("turn_no").collect()
    assert [r.row_id for r in got] == [1, 2, 3, 4, 5, 6]
    base = 1_700_000_000_000
    assert [r.corrected_ms - base for r in got] == [100_000, 100_000, 100_000, 200_000, 200_000, 300_000]


def test_a_full_hour_is_numbered_in_slices(spark):
    rows = [(*message(i, "c", i, None, "u1" if i % 2 else "u2")[:8], None, None, "x", "clash", None) for i in range(1, 5001)]
    got = rebuild(*[frames(spark, rows)[i] for i in (0, 2, 1)]).orderBy("turn_no").collect()
    assert [(r.turn_no, r.row_id) for r in got] == [(i, i) for i in range(1, 5001)]


def test_a_cycle_of_senders(spark):
    """Three senders who answer each other in a ring, each clock behind the one before: no offsets meet all three."""
    rows = [message(10 * k + j + 1, "c", 10 * k + j + 1, 10 * k + j if j else None, f"u{(j % 3) + 1}", f"{k}-{j}", t=1000 * k - 7 * j) for k in range(6) for j in range(4)]
    got = {r.message_id: r.turn_no for r in rebuild(*[frames(spark, rows)[i] for i in (0, 2, 1)]).collect()}
    assert len(got) == len(rows) and all(got[r[3]] > got[r[4]] for r in rows if r[4])


def test_no_reply_before_its_message_in_the_tables(spark, sf_dir):
    turns = p5_turns(spark, sf_dir).select("conv_id", "message_id", "turn_no")
    replies = table(spark, sf_dir, "chat_messages").where("reply_to_id IS NOT NULL").select("conv_id", "message_id", "reply_to_id").distinct()
    above = turns.select("conv_id", F.col("message_id").alias("reply_to_id"), F.col("turn_no").alias("before"))
    met = turns.join(replies, ["conv_id", "message_id"]).join(above, ["conv_id", "reply_to_id"])
    assert met.count() > 0 and met.where("before >= turn_no").count() == 0
