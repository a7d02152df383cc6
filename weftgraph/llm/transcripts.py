"""Speech transcripts to clean speaker turns (problem 1).

One Aho-Corasick automaton finds every candidate of a row in a single pass: filler words, sound words, speaker words and
the marks that stamps and notes begin or end with. Context rules then decide each candidate (a spoken time of day is no
recording position, "a sort of index" no filler, "the laughter died down" no note). What is decided is a set of
intervals; the clean text is the row minus their union. Windows over each recording, sliced by the hour so that one long
recording is many tasks, number the speakers' turns.

Defined results: a null or blank text has no text dirt and falls back to a raw engine's text when turns are built; rows
repeated by row_id count once; a null label is dirt and takes no part in a turn's label; rows without any time come last
in row order; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.shipping import by_value
from weftgraph.session import cut

# Hesitation sounds, which are fillers anywhere, in English, German, Spanish and French.
SOUNDS_OF_HESITATION = (
    "uh", "uhh", "uhm", "umm", "ummm", "erm", "uh-huh", "mm", "mmm", "mhm", "mm-hmm", "hm", "hmm", "hmmm",
    "äh", "ähm", "öhm", "öh", "ehm", "euh", "heu",
)
# Words and phrases that are fillers only where punctuation sets them off.
FILLER_PHRASES = (
    "um", "er", "ah", "eh", "hum", "bah", "ben", "bof", "tja", "naja", "na ja", "este", "o sea", "you know", "i mean", "sort of", "kind of",
    "tu vois", "enfin bref", "sozusagen",
)
# Words of notes about noises and unheard speech.
NOISE_WORDS = (
    "applause", "applaus", "applaudissements", "aplausos", "beifall", "breath", "breathes", "breathing", "cheering", "clears throat", "coughs",
    "cough", "coughing", "cross talk", "crosstalk", "door slams", "door closes", "footsteps", "gelächter", "husten", "hustet", "inaudible", "inaudibles", "indistinct",
    "lachen", "lacht", "laughs", "laughing", "laughter", "lärm", "music", "musik", "musique", "música", "noise", "noises", "overlapping", "pause", "phone rings",
    "rauschen", "rires", "rire", "risas", "risa", "ruido", "bruit", "räuspern", "räuspert sich", "seufzt", "sighs", "sigh", "silence", "silencio", "sneezes",
    "soupir", "stille", "suspiro", "telefon klingelt", "telephone rings", "tos", "tose", "toux", "unintelligible", "unverständlich", "unclear", "whispers", "static", "blank_audio",
)
# Words for a speaker.
SPEAKER_WORDS = ("speaker", "spk", "sprecher", "sprecherin", "locuteur", "locutrice", "hablante", "orador", "interlocuteur")

#: Rows of a slice or turn beyond which it is cut further.
PART_ROWS = 4096
KINDS = ("timestamp", "filler", "sound", "inline_label")
_FILLER, _PHRASE, _NOISE, _SPEAKER, _MARK = range(5)
_MARKS = ("[", "(", "{", "<", "@", "-->", "|", "♪", ">>")

_CLOCK = r"(?:\d{1,4}:)?\d{1,4}:\d{2}(?:[.,]\d{1,3})?"
_BOXED = {a: re.compile(rf"\{a}\s*(?:t\s*=\s*\d+(?:[.,]\d+)?\s*s?|{_CLOCK})\s*\{b}") for a, b in ("[]", "()", "{}", "<>")}
_AT = re.compile(rf"@(?:\d+(?:[.,]\d+)?s?|{_CLOCK})(?![\w@])")
_ARROW = re.compile(r"(\d{1,4}:)?\d{1,2}:\d{2}[.,]\d{1,3}\s*$")
_ARROW_END = re.compile(r"-->(?:\s*(?:\d{1,4}:)?\d{1,2}:\d{2}[.,]\d{1,3})?")
_BAR = re.compile(r"(?:\d+h)?\d+m\d{1,2}s\s*$")
_NOTE_LEFT = re.compile(r"(?:[\[({<*♪]|(?<!\S)--?\s)[\[({<*♪\s]*(?:[^\W\d]+[ '_-]){0,3}$")
_NOTE_RIGHT = re.compile(r"(?:[ '_-][^\W\d]+){0,3}[\])}>*♪\s]*(?:[\])}>*♪]|\s--?(?!\S))")
_OPEN = {"[": "]", "(": ")", "{": "}", "<": ">", "*": "*", "♪": "♪", "-": "-"}
_OPENERS = re.compile(r"[\[({<*♪]|(?<!\S)--?(?=\s)")
_OPENS = {")": "(", "]": "[", "}": "{", ">": "<"}
_BRACKET = re.compile(r"[\[\](){}<>]")
_CLOCK_IN_NOTE = re.compile(rf"(?<![\w:.,]){_CLOCK}(?![\w:])")
_NOTE = re.compile(rf"(?:{_CLOCK}|[^\W_]|[\s,'’_&/-])*")
_NO_WORD = re.compile(rf"(?:{_CLOCK}|[\s,\d-])*")
_LABEL = re.compile(
    rf"\s*(?:>>+(?:\s*(?:(?:{'|'.join(SPEAKER_WORDS)})[ _-]?)?\d+\s*:)?"
    rf"|[\[(]\s*(?:{'|'.join(SPEAKER_WORDS)}|s)[ _-]?\d+\s*[\])]\s*:?"
    rf"|(?:{'|'.join(SPEAKER_WORDS)}|s)[ _-]?\d+(?:\s*\([^()]*\))?\s*(?:[:>]|[-–—](?=\s)))",
    re.IGNORECASE,
)
_SET_OFF = re.compile(r"\s*(?:[,.;:?!…]|[-–—](?=[\s,;.]|$)|[)\]]|$)")
_DASHED = re.compile(r"\s*(?:--|—)(?=[\s,;.]|$)")


_built: list[ahocorasick.Automaton] = []


def automaton() -> ahocorasick.Automaton:
    """The automaton over all words and marks, built once per process; a value is (what, length)."""
    if _built:
        return _built[0]
    found: dict[str, int] = {}
    for what, words in ((_MARK, _MARKS), (_SPEAKER, SPEAKER_WORDS), (_NOISE, NOISE_WORDS), (_PHRASE, FILLER_PHRASES), (_FILLER, SOUNDS_OF_HESITATION)):
        found |= dict.fromkeys(words, what)
    a = ahocorasick.Automaton()
    for word, what in found.items():
        a.add_word(word, (what, len(word)))
    a.make_automaton()
    _built.append(a)
    return a


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _inside_word(text: str, begin: int, end: int) -> bool:
    return (begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_"))


def _hyphenated(text: str, begin: int, end: int) -> bool:
    """Part of a compound such as uh-huh or Mm-Xy, which a shorter word must not claim."""
    return (begin > 1 and text[begin - 1] in "-'’" and text[begin - 2].isalnum()) or (end + 1 < len(text) and text[end] in "-'’" and text[end + 1].isalnum())


def _last_visible(text: str, end: int) -> int:
    """The place behind the last character before ``end`` that is no white space."""
    while end and text[end - 1].isspace():
        end -= 1
    return end


def _note_span(text: str, begin: int, end: int, opens: list[int]) -> tuple[int, int] | None:
    """The note around a noise word with up to three words on either side, if the nearest opening mark is closed behind it.

    What stands further away is a sentence, unless brackets enclose it (_boxed_note). ``opens`` are the places of marks.
    """
    right = _NOTE_RIGHT.match(text, end)
    k = bisect_left(opens, begin) - 1
    tried = ""
    while right and k >= 0 and _NOTE_LEFT.match(text, at := opens[k], begin):
        if text[at] not in tried:  # marks of one kind need one try
            while at and text[at - 1] == text[at]:
                at -= 1
            if _OPEN[text[at]] in right.group():
                return at, right.end()
            tried += text[at]
            if len(tried) == len(_OPEN):
                break
        k = bisect_left(opens, at) - 1
    return None


def _pairs(text: str) -> tuple[list[int], list[int], dict[int, int]]:
    """Where brackets stand, the opening mark of the innermost closed pair behind each (-1: none), where pairs close."""
    at, top, stack = [], [], []
    waiting = dict.fromkeys("[({<", 0)
    above, close = {-1: -1}, {}
    for m in _BRACKET.finditer(text):
        p, c = m.start(), m.group()
        if c in waiting:
            above[p] = stack[-1] if stack else -1
            stack.append(p)
            waiting[c] += 1
        elif waiting[_OPENS[c]]:  # what was opened within the pair and never closed is none
            while text[q := stack.pop()] != _OPENS[c]:
                waiting[text[q]] -= 1
            waiting[text[q]] -= 1
            close[q] = p
        at.append(p)
        top.append(stack[-1] if stack else -1)
    for q in above:  # from left to right, so that what is above is settled already
        if q not in close and q >= 0:
            above[q] = above[above[q]] if above[q] >= 0 and above[q] not in close else above[q]
    return at, [q if q in close else above[q] for q in top], close


def _boxed_note(text: str, begin: int, end: int, pairs: tuple[list[int], list[int], dict[int, int]]) -> tuple[int, int] | None:
    """The brackets around a noise word, if their whole content can be a note: words, numbers, commas and clocks.

    Round brackets hold prose too: a note in them begins or ends with the noise word, clocks aside.
    """
    at, top, close = pairs
    k = bisect_right(at, begin) - 1
    left = top[k] if k >= 0 else -1
    if left < 0 or close[left] < end:
        return None
    right = close[left]
    if not _NOTE.fullmatch(text, left + 1, right) or (text[left] == "(" and not (_NO_WORD.fullmatch(text, left + 1, begin) or _NO_WORD.fullmatch(text, end, right))):
        return None
    while left and text[left - 1] == text[left] and text[right + 1 : right + 2] == text[right]:
        left, right = left - 1, right + 1
    return left, right + 1


def _set_off(low: str, begin: int, end: int) -> bool:
    """Punctuation follows; a pair of dashes only counts with one before, else it opens another insertion."""
    return bool(_SET_OFF.match(low, end) or (_DASHED.match(low, end) and low.endswith(("--", "—"), 0, _last_visible(low, begin))))


def intervals(text: str) -> list[tuple[int, int, str]]:
    """The dirty intervals of a text as (begin, end, kind)."""
    low, out = _lowered(text), []
    label = pairs = noted = opens = None
    first = len(low) - len(low.lstrip())  # where a label could begin, alone or behind its marks
    lead = len(low) - len(low.lstrip("> \t\r\n[("))
    for last, (what, size) in automaton().iter(low):
        end = last + 1
        begin = end - size
        if what == _MARK:
            mark = low[begin:end]
            if mark in _BOXED:
                if m := _BOXED[mark].match(text, begin):
                    out.append((begin, m.end(), "timestamp"))
                elif mark in "[(" and label is None and begin == first:
                    label = _LABEL.match(text)
            elif mark == "@":
                if (begin == 0 or not text[begin - 1].isalnum()) and (m := _AT.match(text, begin)):
                    out.append((begin, m.end(), "timestamp"))
            elif mark == "-->":
                behind = _last_visible(text, begin)
                if m := _ARROW.search(text, max(0, behind - 16), behind):  # the pattern's longest match
                    out.append((m.start(), _ARROW_END.match(text, begin).end(), "timestamp"))
            elif mark == "|":
                behind = _last_visible(text, begin)
                start = behind
                while start and (text[start - 1].isdigit() or text[start - 1] in "hms"):
                    start -= 1
                if (m := _BAR.search(text, start, behind)) and (m.start() == 0 or not text[m.start() - 1].isalnum()):
                    out.append((m.start(), end, "timestamp"))
            elif mark == "♪":
                out.append((begin, end, "sound"))
            elif label is None and begin <= lead:
                label = _LABEL.match(text)
        elif _inside_word(low, begin, end):
            if what == _SPEAKER and label is None and begin <= lead:
                label = _LABEL.match(text)
        elif what == _NOISE:
            opens = opens if opens is not None else [m.start() for m in _OPENERS.finditer(text)]
            if span := _note_span(text, begin, end, opens):
                out.append((*span, "sound"))
            else:
                pairs = pairs or _pairs(text)
                if span := _boxed_note(text, begin, end, pairs):
                    if span != noted:  # a note may hold several noise words
                        out.append((*span, "sound"))
                        if _CLOCK_IN_NOTE.search(text, *span):
                            out.append((*span, "timestamp"))
                    noted = span
        elif what == _SPEAKER:
            if label is None and begin <= lead:
                label = _LABEL.match(text)
        elif not _hyphenated(low, begin, end) and (what == _FILLER or _set_off(low, begin, end)):
            out.append((begin, end, "filler"))
    if label is None and low.startswith("s", first):
        label = _LABEL.match(text)
    if label:
        out.append((0, label.end(), "inline_label"))
    return out


def dirt_mask(text: str | None) -> int:
    """Bit i is set if the text has dirt of KINDS[i]; dirt that other dirt had parted is found in the rest."""
    mask = 0
    while text and (found := intervals(text)):
        for _, _, kind in found:
            mask |= 1 << KINDS.index(kind)
        text = _without(text, found)
    return mask


_SPACES = re.compile(r"[^\S\n]{2,}")
_TIDY = ((re.compile(r"\s*(?:[-–—]{2}\s*){2,}"), " "), (re.compile(r"^[\s,;:|–—-]+|\s+$"), ""), (re.compile(r"(?:,\s*)+,"), ","), (re.compile(r"\s+([,.;:?!])"), r"\1"), (re.compile(r"([,;:])(?=[.?!])"), ""), (re.compile(r"\s{2,}"), " "))
_AFTER_FILLER = re.compile(r"\s*(?:,|\.{3}|…|[-–—]{1,2}(?=\s|$))")
_BEFORE_FILLER = re.compile(r"(?:,|[-–—]{2})\s*$")


def _without(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text minus the union of its dirty intervals, with the punctuation that set fillers off."""
    spans = []
    for begin, end, kind in found:
        if kind == "filler":
            if m := _AFTER_FILLER.match(text, end):
                end = m.end()
            behind = _last_visible(text, begin)
            if m := _BEFORE_FILLER.search(text, max(0, behind - 2), behind):
                begin = m.start()
        spans.append((begin, end))
    kept, at = [], 0
    for begin, end in sorted(spans):
        if begin > at:
            kept.append(text[at:begin])
        at = max(at, end)
    return _SPACES.sub(" ", " ".join([*kept, text[at:]])).strip()


def clean_text(text: str | None) -> str:
    """The text without dirt; every pass removes characters, so it ends."""
    dirty = False
    while text and (found := intervals(text)):
        text, dirty = _without(text, found), True
    for pattern, by in _TIDY if dirty else ():
        text = pattern.sub(by, text)
    return (text or "").strip()


def found_dirt(turns: DataFrame) -> DataFrame:
    """(row_id, dirt), once per row and kind."""
    mask = F.pandas_udf(lambda s: s.map(dirt_mask).astype("int32"), "int")
    rows = turns.where(F.col("row_id").isNotNull()).select("row_id", "speaker", "start_s", "end_s", mask(F.coalesce("corrected", F.lit(""))).alias("m"))
    timeless = F.col("start_s").isNull() | F.col("end_s").isNull() | F.isnan("start_s") | F.isnan("end_s") | (F.col("end_s") < F.col("start_s"))
    unlabelled = ~F.coalesce(F.col("speaker").rlike(r"^SPEAKER_[0-9]{2}\z"), F.lit(False))
    flags = [F.when(F.col("m").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for i, k in enumerate(KINDS)] + [F.when(unlabelled, F.lit("label")), F.when(timeless, F.lit("interval"))]
    kinds = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return rows.select("row_id", F.explode(kinds).alias("dirt")).distinct()


def speaker_label(speaker):
    """One spelling per speaker: ``SPEAKER_`` and the label's number in two digits or more; null without a number."""
    number = F.regexp_replace(F.regexp_extract(speaker, r"([0-9]+)[^0-9]*$", 1), r"^0+(?=[0-9])", "")
    return F.when(number != "", F.concat(F.lit("SPEAKER_"), F.when(F.length(number) < 2, F.concat(F.lit("0"), number)).otherwise(number)))


def speaker_turns(turns: DataFrame, slice_s: int = 3600, part_rows: int = PART_ROWS) -> DataFrame:
    """(recording_id, turn_no, part_no, speaker, start_s, end_s, text, n_rows) of every recording in time order.

    Adjacent rows of one speaker make one turn. Rows meet in slices of ``slice_s`` seconds, or of times and row numbers
    where a slice holds more than ``part_rows``; the last speaker of the slices before comes from a table with one row
    per slice, so a recording may hold any share of the rows. A turn of more than ``part_rows`` rows comes in parts, one
    for each of its slices, so that no turn is gathered whole; all others have the one part 1.
    """
    clean = F.pandas_udf(lambda s: s.map(clean_text), "string")
    blank = lambda c: F.when(F.col(c).rlike(r"[^\p{IsWhite_Space}]"), F.col(c))
    once = turns.dropDuplicates(["row_id"]).select("row_id", F.coalesce("recording_id", F.lit("")).alias("recording_id"), F.nanvl("start_s", F.lit(None).cast("double")).alias("a"), F.nanvl("end_s", F.lit(None).cast("double")).alias("b"), "speaker", F.coalesce(blank("corrected"), blank("parakeet"), blank("whisper")).alias("raw"))
    timed = once.select("row_id", "recording_id", F.least("a", "b").alias("start_s"), F.greatest("a", "b").alias("end_s"), speaker_label(F.col("speaker")).alias("speaker"), clean(F.coalesce("raw", F.lit(""))).alias("text"))
    rows = cut(timed.where("text <> ''").withColumn("hour", F.coalesce(F.floor(F.col("start_s") / slice_s), F.lit(1 << 40))))
    full = rows.groupBy(F.col("recording_id").alias("__r"), F.col("hour").alias("__h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows).drop("n")
    marked = rows.join(full, (rows["recording_id"] == F.col("__r")) & (rows["hour"] == F.col("__h")), "left")
    is_full = F.col("__h").isNotNull()
    slices = F.struct("hour", F.when(is_full, F.coalesce("start_s", F.lit(0.0))).alias("t"), F.when(is_full, F.floor(F.col("row_id") / part_rows)).alias("k"))
    rows = marked.withColumn("part", slices).drop("__r", "__h", "hour")
    order = [F.col("start_s").asc_nulls_last(), F.col("row_id").asc_nulls_last()]
    here = W.partitionBy("recording_id", "part").orderBy(*order)
    # A row without a label belongs to the speaker before it.
    filled = rows.withColumn("who", F.last("speaker", ignorenulls=True).over(here))
    ends = filled.groupBy("recording_id", "part").agg(F.max_by("who", F.struct(F.col("start_s").isNull(), "start_s", "row_id")).alias("last_who"))
    before = W.partitionBy("recording_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select("recording_id", "part", F.last("last_who", ignorenulls=True).over(before).alias("carried"))
    carried = filled.join(carry, ["recording_id", "part"]).withColumn("who", F.coalesce("who", "carried", F.lit("SPEAKER_??")))
    previous = F.coalesce(F.lag("who").over(here), F.col("carried"), F.lit(""))
    marked = carried.withColumn("new", F.when(F.col("who") != previous, 1).otherwise(0))
    counts = marked.groupBy("recording_id", "part").agg(F.sum("new").alias("n"))
    starts = counts.select("recording_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    running = here.rowsBetween(W.unboundedPreceding, 0)
    numbered = cut(marked.withColumn("k", F.sum("new").over(running)).join(starts, ["recording_id", "part"]).withColumn("turn_no", (F.col("base") + F.col("k")).cast("long")))
    long = numbered.groupBy("recording_id", "turn_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows).select(F.col("recording_id").alias("__r"), F.col("turn_no").alias("__t"))
    parted = numbered.join(long, (numbered["recording_id"] == F.col("__r")) & (numbered["turn_no"] == F.col("__t")), "left").withColumn("slice", F.when(F.col("__t").isNotNull(), F.col("part")))
    pieces = F.array_sort(F.collect_list(F.struct(F.col("start_s").isNull().alias("late"), "start_s", "row_id", "text")))
    gathered = parted.groupBy("recording_id", "turn_no", "slice").agg(F.min("who").alias("speaker"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_join(F.transform(pieces, lambda p: p["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n_rows"))
    part_no = F.row_number().over(W.partitionBy("recording_id", "turn_no").orderBy("slice"))
    return gathered.select("recording_id", "turn_no", part_no.alias("part_no"), "speaker", "start_s", "end_s", "text", "n_rows")


by_value(__name__)
