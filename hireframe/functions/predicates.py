"""Predicate builders and small row-level rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original behaviour.
DEFAULT_TEXT = "no relevant information"
LIKE_ESCAPE = "@"


def like_pattern(p: str) -> str:
    """The LIKE pattern (without quotes) used for one name pattern."""
    return f"% {p}%"


def pattern_list(patterns) -> list[str]:
    """One pattern or several as a list; anything that is not text is refused."""
    if isinstance(patterns, str):
        return [patterns]
    wrong = [x for x in patterns if not isinstance(x, str)] if isinstance(patterns, (list, tuple)) else [patterns]
    if wrong:
        raise TypeError(f"name patterns are strings, not {type(wrong[0]).__name__}")
    return list(patterns)


def sql_pattern_formatting(patterns) -> list[str]:
    """The quoted LIKE literal of each pattern."""
    return [f"'{like_pattern(p)}'" for p in pattern_list(patterns)]


def name_match(c: Column, p: str, escape: str = LIKE_ESCAPE, anchor: str = "space") -> Column:
    """One pattern against a name.  ``anchor='space'`` (observed behaviour, Q3):
    a space must precede the pattern; ``anchor='word'`` also accepts the
    pattern at the very start of the name."""
    hit = F.ilike(c, F.lit(like_pattern(p)), F.lit(escape))
    if anchor == "word":
        return hit | F.ilike(c, F.lit(p + "%"), F.lit(escape))
    if anchor != "space":
        raise ValueError("anchor must be 'space' or 'word'")
    return hit


def like_any(col: str | Column, patterns, escape: str = LIKE_ESCAPE,
             compat: bool = False, anchor: str = "space") -> Column:
    """P5: OR of case-insensitive LIKEs of ``col`` against ``'% p%'`` patterns.

    Returns a Column (values never travel as SQL text).  ``compat=True`` keeps
    the original single-pattern behaviour: with one pattern no wildcards are
    added and ``patterns[0]`` is matched as is (the first character for a bare
    string).
    """
    c = F.col(col) if isinstance(col, str) else col
    plist = pattern_list(patterns)
    if compat and len(plist) == 1:
        return F.ilike(c, F.lit(patterns[0]), F.lit(escape))
    if not plist:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [name_match(c, p, escape, anchor) for p in plist])


def null_if_empty(col: str | Column) -> Column:
    """P9: '' -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c, F.lit(""))


def default_text(col: str | Column, text: str = DEFAULT_TEXT) -> Column:
    """P10: NULL or '' -> the default text."""
    return F.coalesce(null_if_empty(col), F.lit(text))


def label_above(label: str | Column, score: str | Column, min_score: float = 0.75) -> Column:
    """The label if score > min_score else NULL."""
    lab = F.col(label) if isinstance(label, str) else label
    sc = F.col(score) if isinstance(score, str) else score
    return F.when(sc > F.lit(min_score), lab)


def decide(prob: str | Column, threshold: float = 0.5) -> Column:
    """1 if p >= threshold else 0."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p >= F.lit(threshold)).cast("int")


def sigmoid(logit: str | Column) -> Column:
    """1 / (1 + exp(-x)); exact at both ends (0 and 1), null for null."""
    x = F.col(logit) if isinstance(logit, str) else logit
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def one_vs_rest(label: str | Column, target: str) -> Column:
    """1 if label == target else 0 (NULL label -> 0)."""
    lab = F.col(label) if isinstance(label, str) else label
    return F.coalesce((lab == F.lit(target)).cast("int"), F.lit(0))
