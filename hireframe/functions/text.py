"""String and array functions (F1-F7, F9, F11) as Spark expressions.

Everything here is a JVM-side expression, so it runs inside whole-stage codegen
and never leaves the executor's row stream.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original behaviour: the characters stripped
# before word tokenisation (Python's string.punctuation and string.digits).
PUNCTUATION = string.punctuation
DIGITS = string.digits

# A sentence ends at a run of . ! ? followed by whitespace (split after it).
_SENT_SPLIT = r"(?<=[.!?])[ \t\r\n]+"
# Every character at which Python's str.split() splits (fixed values), as one regex class.
_WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: str | Column) -> Column:
    """Trim spaces, tabs and newlines at both ends."""
    return F.trim(_c(col), F.lit(" \t\r\n"))


def split_sentences(col: str | Column) -> Column:
    """text -> ARRAY<STRING> of sentences (order kept, empty pieces dropped).

    A sentence ends at '.', '!' or '?' (runs allowed) followed by whitespace;
    abbreviations are not known (``operators.abbreviations`` learns and
    heeds them).  NULL text -> empty array.  One look-behind
    split on the trimmed text: no marker pass and no per-sentence lambda.
    """
    text = F.trim(F.coalesce(_c(col), F.lit("")), F.lit(" \t\r\n"))
    return F.array_remove(F.split(text, _SENT_SPLIT), F.lit(""))


# Punctuation around a word (fixed values): brackets and quotation marks before it, these and commas, colons,
# question and exclamation marks behind it.
_BEFORE = r"[(\[{\"'\u00AB\u201E\u201C\u2018]+"
_BEHIND = r"[)\]}\"'\u00BB\u201C\u201D\u2019,;:!?]+"
# Joins sentences while they are put together; a noncharacter, read as a space where a text holds it.
_SENT_MARK = "\uFFFF"


def stop_words(col: str | Column) -> Column:
    """ARRAY<STRUCT<word, stop>>: every word with a letter in lower case, without its final full stop
    (``stop`` says whether it had one) and without punctuation around it."""
    parts = F.split(F.lower(F.coalesce(_c(col), F.lit(""))), r"[ \t\r\n]+")
    bare = F.transform(parts, lambda w: F.regexp_replace(w, f"^{_BEFORE}|{_BEHIND}$", ""))
    words = F.filter(bare, lambda w: w.rlike(r"\p{L}"))
    return F.transform(words, lambda w: F.struct(F.regexp_replace(w, r"\.$", "").alias("word"), w.endswith(".").alias("stop")))


def end_word(sentence: Column) -> Column:
    """The word before a sentence's final full stop, as in :func:`stop_words`; '' if it ends otherwise."""
    return F.regexp_replace(F.regexp_extract(F.lower(sentence), r"([^ \t\r\n]+)\.$", 1), f"^{_BEFORE}", "")


def merge_sentences(pieces: Column, joins) -> Column:
    """Sentences of an array, put together with one space where ``joins`` holds for the first of two."""
    marked = F.transform(pieces, lambda s: F.concat(F.replace(s, F.lit(_SENT_MARK), F.lit(" ")),
                                                    F.when(joins(s), F.lit(" ")).otherwise(F.lit(_SENT_MARK))))
    return F.array_remove(F.split(F.rtrim(F.array_join(marked, "")), _SENT_MARK), "")


def join_sentences(arr: str | Column) -> Column:
    """sentences joined with one space."""
    return F.array_join(_c(arr), " ")


def newline_to_space(col: str | Column) -> Column:
    """every newline becomes one space."""
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def name_key(name: Column, compat: bool = False) -> Column:
    """what a lower-cased sentence must contain to mention the employer; NULL is in no sentence."""
    return name if compat else F.when(F.length(name) > 0, F.lower(name))


def contains_name(sentence: Column, name: Column, compat: bool = False) -> Column:
    """does the lower-cased sentence contain the employer name?

    Default lower-cases the name too and never matches an empty name; compat
    keeps the name as given (capitalised names never match, '' matches all).
    """
    if compat:
        return F.contains(F.lower(sentence), name)
    return (F.length(name) > 0) & F.contains(F.lower(sentence), F.lower(name))


def blind_names(desc: str | Column, name: str | Column, replacement: str = "blinded_name",
                case_insensitive: bool = False) -> Column:
    """replace the employer name in the description.

    Default is the literal, case-sensitive replace; an empty or NULL name
    leaves the text unchanged.
    """
    d, n = _c(desc), _c(name)
    if case_insensitive:
        pattern = F.concat(F.lit("(?i)\\Q"), n, F.lit("\\E"))
        replaced = F.regexp_replace(d, pattern, F.lit(replacement.replace("$", "\\$")))
    else:
        replaced = F.replace(d, n, F.lit(replacement))
    return F.when(n.isNull() | (n == F.lit("")), d).otherwise(replaced)


# The same characters as one regex class: ASCII 0x21-0x40 (punctuation and
# digits), 0x5B-0x60 and 0x7B-0x7E.
_PUNCT_DIGITS_CLASS = r"[\x21-\x40\x5B-\x60\x7B-\x7E]"


def strip_punct_digits(col: str | Column) -> Column:
    """remove ASCII punctuation and digits (one regex pass, faster than a
    per-character translate map)."""
    return F.regexp_replace(_c(col), _PUNCT_DIGITS_CLASS, "")


def word_tokens(col: str | Column) -> Column:
    """F4 + F5: strip punctuation/digits, lower-case, split on whitespace."""
    cleaned = F.lower(strip_punct_digits(F.coalesce(_c(col), F.lit(""))))
    return F.array_remove(F.split(cleaned, _WS), F.lit(""))


def truncate_tokens(arr: str | Column, n: int = 128) -> Column:
    """keep the first n tokens."""
    return F.slice(_c(arr), 1, n)


def first_tokens(col: str | Column, n: int) -> Column:
    """F4 + F5 + F11: the first n word tokens.  The text's first 4 n words are tokenised; the whole text
    only where these leave fewer than n tokens (words without a letter are none)."""
    text = F.coalesce(_c(col), F.lit(""))
    head = F.array_join(F.slice(F.split(text, _WS, 4 * n + 1), 1, 4 * n), " ")
    return F.get(F.transform(F.array(word_tokens(head)), lambda t: F.slice(
        F.when(F.size(t) >= n, t).otherwise(word_tokens(text)), 1, n)), F.lit(0))


def pad_ids(ids: str | Column, length: int | Column, pad: int = 0) -> Column:
    """truncate or right-pad an id array to exactly ``length``."""
    a = _c(ids)
    L = length if isinstance(length, Column) else F.lit(length)
    return F.concat(F.slice(a, 1, L),
                    F.array_repeat(F.lit(pad), F.greatest(L - F.size(a), F.lit(0))))
