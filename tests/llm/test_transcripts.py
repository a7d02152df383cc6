import pytest

from weftgraph.llm.transcripts import KINDS, clean_text, dirt_mask, found_dirt, intervals, speaker_label, speaker_turns

SCHEMA = "row_id long, recording_id string, start_s double, end_s double, speaker string, corrected string, parakeet string, whisper string, lang string, dirt string, who string, part int"


def kinds(text):
    return {k for i, k in enumerate(KINDS) if dirt_mask(text) >> i & 1}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("It is a sort of index.", set()), ("You know the rule for it.", set()), ("I mean the second row.", set()), ("Este informe tiene hojas.", set()), ("Um 14:30 Uhr begann der Lärm.", set()),
        ("We meet at 9:15 (see sheet 4282).", set()), ("Version 2.888.3 has a 3:1 ratio.", set()), ("Draft [2945] stays.", set()), ("The laughter died down.", set()), ("The speaker map was new.", set()),
        ("Um, we start.", {"filler"}), ("we -- uh -- start", {"filler"}), ("das ist, naja, gut", {"filler"}), ("lo que, este... pasó", {"filler"}), ("Sort of - we start", {"filler"}), ("we start, you know?", {"filler"}),
        ("We start. [00:44:02]", {"timestamp"}), ("{36:41} start", {"timestamp"}), ("[t=1841.8s] start", {"timestamp"}), ("start @9434.52", {"timestamp"}), ("00:56:19.592 --> start", {"timestamp"}), ("64m32s | start", {"timestamp"}),
        ("[laughter] we start", {"sound"}), ("-- applause -- we", {"sound"}), ("((crosstalk)) we", {"sound"}), ("*sighs* we", {"sound"}), ("we ♪ ♪ start", {"sound"}), ("(Lachen) wir", {"sound"}),
        ("SPEAKER_02: we start", {"inline_label"}), (">> 1: we start", {"inline_label"}), ("S0> we start", {"inline_label"}), ("[SPK 1] we start", {"inline_label"}), ("Speaker 2 - we start", {"inline_label"}), ("Speaker 2 said so", set()),
        ("[phone {8:07} rings] we", {"timestamp", "sound"}), ("Sort -- applause -- of... we", {"sound", "filler"}), ("Wir treffen um -- applause -- acht", {"sound"}), ("", set()), (None, set()), ("   ", set()),
    ],
)
def test_dirt(text, want):
    assert kinds(text) == want


def test_clean_text():
    assert clean_text("SPEAKER_01: Um, we -- uh -- start [00:01:02] now, you know?") == "we start now?"
    assert clean_text("It is a sort of index.") == "It is a sort of index."


def test_very_long_text():
    text = "we went on [x] um, " * 60_000
    assert kinds(text) == {"filler"}


def test_found_rows(spark, shuffled):
    rows = [
        (1, "a", 0.0, 1.0, "SPEAKER_00", "Um, so", None, None, None, "x", "y", 1), (1, "a", 0.0, 1.0, "SPEAKER_00", "Um, so", None, None, None, "x", "y", 1), (2, "a", 2.0, 1.0, None, None, None, None, None, None, None, None),
        (3, None, None, float("nan"), "SPEAKER_0", "", None, None, None, None, None, None), (4, "a", 1.0, 1.0, "SPEAKER_10", "fine", None, None, None, None, None, None), (None, "a", 1.0, 0.0, None, "um, x", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert shuffled(found_dirt(df)) == [(1, "filler"), (2, "interval"), (2, "label"), (3, "interval"), (3, "label")]
    assert found_dirt(df.limit(0)).count() == 0


def test_turns(spark):
    rows = [
        (1, "a", 0.0, 1.0, "SPEAKER_00", "Um, one", None, None, None, None, None, None), (2, "a", 1.0, 2.0, "speaker 0", "two", None, None, None, None, None, None), (3, "a", 3.0, 2.0, "S1:", None, "three", None, None, None, None, None),
        (4, "a", 3700.0, 3701.0, None, "four", None, None, None, None, None, None), (5, "a", 3702.0, 3703.0, "SPEAKER_00", "um,", None, None, None, None, None, None), (6, "a", 7300.0, 7301.0, "SPEAKER_01", "six", None, None, None, None, None, None), (6, "a", 7300.0, 7301.0, "SPEAKER_01", "six", None, None, None, None, None, None),
    ]
    got = speaker_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("turn_no").collect()
    assert [(r.turn_no, r.speaker, r.text, r.n_rows) for r in got] == [(1, "SPEAKER_00", "one two", 2), (2, "SPEAKER_01", "three four six", 3)]
    assert (got[1].start_s, got[1].end_s) == (2.0, 7301.0)
    assert speaker_turns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slices_change_nothing(spark):
    rows = [(i, "a", float(i), i + 0.5, f"SPEAKER_0{i // 7 % 3}", f"w{i}", None, None, None, None, None, None) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda d: sorted((r.turn_no, r.speaker, r.text) for r in d.collect())
    assert key(speaker_turns(df, 5)) == key(speaker_turns(df, 10_000))


@pytest.mark.parametrize(
    ("text", "want", "clean"),
    [
        ("we [inaudible 00:01:15] start", {"sound", "timestamp"}, "we start"), ("we [music, applause] start", {"sound"}, "we start"), ("we [audience breaks into loud applause] start", {"sound"}, "we start"), ("we (applause 12) start", {"sound"}, "we start"),
        ("we [the very long note of all that could be heard in the old hall at that time, with music, 2 voices and more] start", {"sound"}, "we start"), ("we ((music, applause)) start", {"sound"}, "we start"), ("we < 5 [music, applause] start", {"sound"}, "we < 5 start"),
        ("we (who all heard the music and left, see sheet 4282) start", set(), "we (who all heard the music and left, see sheet 4282) start"), ("[we start] the music, all of it [stops]", set(), "[we start] the music, all of it [stops]"),
    ],
)
def test_whole_notes(text, want, clean):
    assert kinds(text) == want
    assert clean_text(text) == clean


def test_many_open_brackets_around_noise():
    assert kinds("music, 3 < ( " * 60_000 + "[music, applause]") == {"sound"}


def test_no_fixed_distances():
    assert "inline_label" in {k for _, _, k in intervals(" " * 500 + "SPEAKER 1234: hello there")}
    assert clean_text("hello *" + "(" * 60 + "laughs" + ")" * 60 + "* again").split()[0] == "hello"
    assert {k for _, _, k in intervals("so 00:00:01.000" + " " * 300 + "--> 00:00:02.000 here")} == {"timestamp"}


def test_labels_of_many_digits(spark):
    df = spark.createDataFrame([(1, "spk 7"), (2, "Speaker_123"), (3, "S00042"), (4, "nobody"), (5, None), (6, "speaker 99999999999")], "i int, s string")
    got = [r.l for r in df.select("i", speaker_label(df["s"]).alias("l")).orderBy("i").collect()]
    assert got == ["SPEAKER_07", "SPEAKER_123", "SPEAKER_42", None, None, "SPEAKER_99999999999"]


def test_a_long_turn_comes_in_parts(spark):
    rows = [(i, "r", float(i), float(i) + 1, "SPEAKER_01" if i < 40 else "SPEAKER_02", f"w{i}.", None, None, "en") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, recording_id string, start_s double, end_s double, speaker string, corrected string, parakeet string, whisper string, lang string")
    whole = speaker_turns(df).orderBy("turn_no").collect()
    assert [(r.turn_no, r.part_no, r.n_rows) for r in whole] == [(1, 1, 40), (2, 1, 20)]
    parts = speaker_turns(df, slice_s=7, part_rows=5).orderBy("turn_no", "part_no").collect()
    assert max(r.n_rows for r in parts) <= 7 and {r.turn_no for r in parts} == {1, 2}
    for r in whole:
        assert " ".join(p.text for p in parts if p.turn_no == r.turn_no) == r.text
