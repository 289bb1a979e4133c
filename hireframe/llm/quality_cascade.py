"""Quality rules as a short-circuit cascade (DataFrame operations only).

Base counts are array and regular-expression functions inside one row, so the texts are never
shuffled.  Each further rule is a boolean column "this row fails".  On a sample of the rows that pass
the base the rules are run one by one: seconds give the cost, failing rows the selectivity, and the
cascade tests the rule with most rejections per second first, then the one with most among the rows
that are left.  The order changes the time only: a row is kept when no
rule rejects it, whichever rule is asked first.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, release, saved

#: Rows aimed at by the sample on which rules are measured (it sets their order only).
SAMPLE_ROWS = 2000
#: Timed runs of a rule (the quickest counts), and the least cost a rule is given.
REPEATS = 3
LEAST_SECONDS = 1e-4
#: Words in a window of the repetition count.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """``body`` over a value computed once (a lambda variable is evaluated once per row)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words covered by word windows that are found twice or more; ``hashes``: one hash per word.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes.  Texts whose windows are
    all different (a hash set tells) stop there; else sorted (hash, position) pairs put equal
    windows side by side and the covered words are counted from the gaps between positions.
    """
    def windows(v: Column) -> Column:
        return F.when(F.size(v) >= window, F.transform(F.sequence(F.lit(1), F.size(v) - (window - 1)),
                                                       lambda i: F.xxhash64(F.slice(v, i, window)))).otherwise(
            F.array().cast("array<long>"))

    def covered(pos: Column) -> Column:
        gaps = F.zip_with(pos, F.slice(pos, 2, F.size(pos)), lambda a, b: F.coalesce(F.least(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def of_sorted(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
        return _let(F.array_sort(F.transform(twice, lambda x: x["i"])), covered)

    def of_windows(w: Column) -> Column:
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(F.sort_array(pairs), of_sorted))

    return _let(hashes, lambda v: _let(windows(v), of_windows))


def base_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    out = {
        "n_words": F.regexp_count(t, F.lit(WORD)),
        "word_chars": F.char_length(t) - F.regexp_count(t, F.lit(r"[\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": _let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))),
        "n_repeat_words": repeated_words(F.transform(words, lambda w: F.xxhash64(w))),
    }
    return {k: v.cast("long") for k, v in out.items()}


def default_rules(text: Column) -> dict[str, Column]:
    """Rule name -> "fails".  The thresholds are far from ordinary prose in any language."""
    t = F.coalesce(text, F.lit(""))
    n = F.col("n_words")
    return {
        "word_length": (F.col("word_chars") > 15 * n) | (F.col("word_chars") < 2 * n),
        "symbols": 5 * F.col("n_symbols") > n,
        "exclamations": 5 * F.regexp_count(t, F.lit("!")) > n,
        "shouting": 2 * F.regexp_count(t, F.lit(r"\p{Lu}")) > F.col("word_chars"),
        "few_letters": 2 * F.regexp_count(t, F.lit(r"\p{L}")) < F.col("word_chars"),
        "ellipsis_lines": 2 * F.regexp_count(t, F.lit(r"(?m)(\.\.\.|…)$")) > F.regexp_count(t, F.lit(r"(?m)^.*\S")),
    }


def greedy_order(seconds: dict[str, float], outcomes: dict[tuple[bool, ...], int]) -> list[dict]:
    """Rules by rejections per second among the rows that no earlier rule rejects.

    ``seconds`` names the rules with their costs; ``outcomes`` counts rows by which rules they fail, in
    the same order.  Rules that reject nothing more come last, cheapest first.
    """
    place, left, out = {k: i for i, k in enumerate(seconds)}, dict(outcomes), []
    while len(out) < len(seconds):
        rejects = {k: sum(n for fails, n in left.items() if fails[i]) for k, i in place.items()}
        best = max(place, key=lambda k: (rejects[k] / seconds[k], -seconds[k]))
        out.append({"rule": best, "seconds": seconds[best], "rejects": rejects[best]})
        left = {fails: n for fails, n in left.items() if not fails[place[best]]}
        del place[best]
    return out


def measured_order(rows: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS, seed: int = 4,
                   prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[dict]:
    """Rules with sampled cost (seconds) and rejections, in the order of ``greedy_order``.

    ``prepare`` turns sampled rows into those that reach the cascade, with the columns the rules read.
    A rule's cost is the quickest of ``REPEATS`` runs after one that warms up, less the same for an
    aggregate that only reads the columns.  A rule that is null for a row does not reject it.  Without
    any row the given order is kept.
    """
    n = rows.count()
    sample = saved(prepare(rows.sample(min(1.0, 1.5 * sample_rows / max(n, 1)), seed=seed)), "cascade-sample")
    fails = [F.coalesce(c, F.lit(False)) for c in rules.values()]
    seen = sample.groupBy(F.array(*fails).alias("fails")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not seen:
        release(sample)
        return [{"rule": k, "seconds": 0.0, "rejects": 0} for k in rules]

    def quickest(value: Column) -> float:
        took = []
        for _ in range(REPEATS + 1):
            began = time.perf_counter()
            sample.agg(value).first()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    idle = quickest(F.max(F.xxhash64(*sample.columns)))
    seconds = {k: max(quickest(F.count(F.when(c, 1))) - idle, LEAST_SECONDS) for k, c in rules.items()}
    release(sample)
    return greedy_order(seconds, {tuple(r["fails"]): r["n"] for r in seen})


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule, in ``order``, that the row fails; null if none.  Later rules are not evaluated."""
    return F.coalesce(*[F.when(rules[k], F.lit(k)) for k in order])


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=default_rules,
                   min_words: int = 20, max_repeat_pct: int = 30, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id_col, five counts, base_failed, first_failed, kept) for every row.

    Base: a text with fewer than ``min_words`` words, or more than ``max_repeat_pct`` percent
    repeated words, fails and asks no further rule.  Null and empty texts have no words and fail.
    Repeated rows and null ids are kept as they are; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    counts = base_counts(F.col("_text"))
    r = rules(F.col("_text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))

    def counted(df: DataFrame) -> DataFrame:
        return df.select(*df.columns, *[v.alias(k) for k, v in counts.items()])

    order = [x["rule"] for x in measured_order(rows.select("_text"), r, sample_rows, prepare=lambda df: counted(df).where(~failed))]
    out = counted(rows).withColumn("base_failed", failed)
    out = out.withColumn("first_failed", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(r, order)))
    return out.select(id_col, *counts, "base_failed", "first_failed", F.col("first_failed").isNull().alias("kept"))
