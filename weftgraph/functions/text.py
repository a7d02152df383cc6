"""Column functions over names, types and prose. All run inside the JVM; case folding and order are binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that open a sentence and are no part of a proper name.
LEADING_WORDS = ("the", "a", "an", "this", "that", "these", "those", "we", "you", "they", "it", "he", "she", "but", "and", "or", "so", "then", "if", "when", "while", "as", "in", "on", "at", "for", "to", "of")
# Glue words that a term count leaves out; pass another set where the corpus needs one.
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "any", "can", "had", "her", "was", "one", "our", "out", "his", "has", "him", "how", "its", "may",
    "new", "now", "old", "see", "two", "way", "who", "did", "get", "let", "put", "say", "she", "too", "use", "that", "this", "with", "have", "from", "they",
    "will", "would", "there", "their", "what", "about", "which", "when", "make", "like", "time", "just", "know", "into", "your", "some", "could", "them",
    "than", "then", "look", "only", "come", "over", "also", "back", "after", "work", "first", "well", "even", "want", "because", "these", "give", "most",
    "been", "were", "such", "very", "more", "much", "many", "here", "does", "each", "where", "while", "those", "being", "every", "should", "shall", "might",
    "must", "ever", "thing", "things", "really", "actually", "going", "kind", "okay", "yeah", "right", "lot", "got", "etc",
)
# The patterns of proper-noun runs and of single words.
#: Word boundaries are those of ASCII words, whatever the regex engine thinks of accents.
PROPER_NOUN = r"(?<!\w)[A-Z][A-Za-z0-9'’]+(?:\s+[A-Z][A-Za-z0-9'’]+){1,3}(?:(?<=\w)(?!\w)|(?<=\W)(?=\w))"
WORD = r"[a-z0-9](?:[a-z0-9'’_-]*[a-z0-9])?"
# Opposite words, whole-word and substring lists.
ANTONYMS = (
    ("synchronous", "asynchronous"), ("mutable", "immutable"), ("public", "private"), ("static", "dynamic"), ("enabled", "disabled"),
    ("active", "inactive"), ("online", "offline"), ("open", "closed"), ("present", "absent"), ("true", "false"),
    ("increased", "decreased"), ("joined", "left"), ("alive", "dead"), ("valid", "invalid"), ("supported", "unsupported"),
)
SUBSTRING_ANTONYMS = ANTONYMS[:4]
# Fixed value: the words that negate a statement.
NEGATION = r"\b(not|no|never|none|without|n't|cannot|can't|isn't|aren't|doesn't|didn't|won't)\b"
SEPARATOR = "␟"


def normal_name(name: Column) -> Column:
    """Lower case; runs of white space, underscores, hyphens and dashes are one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"[_\-‐-―\s ﻿]+", " "))


def digit_signature(name: Column) -> Column:
    """The digit runs of a name, joined by commas."""
    return F.array_join(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), ",")


def canonical_types(types: Column) -> Column:
    """Relation types trimmed, lower-cased, non-empty, distinct, sorted."""
    folded = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    return F.array_sort(F.array_distinct(F.filter(folded, lambda t: t.isNotNull() & (t != ""))))


def snake_type(name: Column) -> Column:
    """Lower snake case of a type name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def upper_snake(name: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))


def slug(name: Column) -> Column:
    """File-safe name of at most 80 characters; ``entity`` where nothing is left."""
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9_]+", "-"), r"^-+|-+$", ""), 1, 80)
    return F.when(base == "", "entity").otherwise(base)


def hashed_uuid(seed: Column) -> Column:
    """The first 32 hex digits of a SHA-1 in the grouping of a UUID."""
    h = F.sha1(seed)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def proper_nouns(text: Column) -> Column:
    """Runs of two to four capitalised words, without the words that merely open a sentence."""
    opener = r"(?i)^(?:(?:" + "|".join(LEADING_WORDS) + r")\s+)+"
    runs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PROPER_NOUN), F.lit(0)), lambda r: F.regexp_replace(F.regexp_replace(r, opener, ""), r"\s+", " "))
    return F.filter(runs, lambda r: r.contains(" "))


def content_words(text: Column, min_length: int = 3, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-case words of some length that are neither numbers nor stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~w.rlike(r"^\d+$") & ~w.isin(*stopwords))


def sentences(text: Column) -> Column:
    """Split behind ``.``, ``!`` or ``?`` and at line ends; blank pieces are dropped."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|[\r\n]+"), lambda t: F.trim(t))
    return F.filter(pieces, lambda p: p != "")


def verbalise(src: Column, types: Column, dst: Column) -> Column:
    """A relation as a sentence: types with blanks for underscores, joined by 'and'."""
    said = F.filter(F.transform(types, lambda t: F.trim(F.regexp_replace(t, "_", " "))), lambda t: t != "")
    return F.concat_ws(" ", src, F.concat_ws(" and ", said), dst)


def keyword_score(claim: Column, source: Column) -> Column:
    """Share of a claim's words over three characters found as substrings of the source; 1 without such words."""
    words = F.filter(F.split(F.lower(claim), r"[\s ﻿]+"), lambda w: F.length(w) > 3)
    found = F.size(F.filter(words, lambda w: F.lower(source).contains(w)))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(found / F.size(words))


def endpoints_in(span: Column, src: Column, dst: Column) -> Column:
    """A span, if there is one, names both endpoints."""
    low = F.lower(span)
    return span.isNull() | (low.contains(F.lower(src)) & low.contains(F.lower(dst)))


def verdict_yes(answer: Column) -> Column:
    return F.lower(F.trim(answer)).rlike(r"^(yes|true)|(^|\s)1(\s|$|[.,])")


def _topic_words(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), NEGATION, " ")  # every negation is over three letters or dropped below
    return F.array_distinct(F.filter(F.split(bare, r"[^a-z0-9]+"), lambda w: F.length(w) > 3))


def contradicts(a: Column, b: Column) -> Column:
    """Opposite words over a shared topic, or one of two much alike statements negated."""
    la, lb = F.lower(a), F.lower(b)
    wa, wb = _topic_words(a), _topic_words(b)
    shared = F.array_intersect(wa, wb)
    opposite = F.lit(False)
    for x, y in ANTONYMS:
        cross = (la.rlike(rf"\b{x}\b") & lb.rlike(rf"\b{y}\b")) | (la.rlike(rf"\b{y}\b") & lb.rlike(rf"\b{x}\b"))
        opposite = opposite | (cross & (F.size(F.array_except(shared, F.array(F.lit(x), F.lit(y)))) > 0))
    alike = F.coalesce(F.try_divide(F.size(shared), F.size(F.array_union(wa, wb))), F.lit(0.0)) >= 0.5
    return opposite | ((la.rlike(NEGATION) != lb.rlike(NEGATION)) & alike)


def substring_conflict(a: Column, b: Column) -> Column:
    la, lb = F.lower(a), F.lower(b)
    out = F.lit(False)
    for x, y in SUBSTRING_ANTONYMS:
        out = out | (la.contains(x) & lb.contains(y)) | (la.contains(y) & lb.contains(x))
    return out


def match_key(text: Column) -> Column:
    """The form in which extracted and gold parts are compared."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", ""))


def triple_key(s: Column, p: Column, o: Column) -> Column:
    return F.concat_ws("|", *[F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (s, p, o)])


def key_predicate(column: str, parent: str) -> str:
    """The predicate of a single-column foreign key: the column without a trailing id, else the parent table."""
    import re

    return (re.sub(r"(?i)[_-]?id$", "", column).strip() or parent).lower()


def naming_pattern(name: Column) -> Column:
    return (
        F.when(name.rlike(r"^[a-z][a-z0-9_]*$"), "snake_case").when(name.rlike(r"^[a-z][a-zA-Z0-9]*$"), "camelCase").when(name.rlike(r"^[A-Z][a-zA-Z0-9]*$"), "PascalCase").otherwise("other")
    )
