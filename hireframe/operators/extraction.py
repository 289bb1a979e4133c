"""Employer-description extraction.

A posting becomes an array of sentences (F1).  The name pass keeps sentences
that mention the employer; the residual text (sentences not already taken)
goes to a sentence classifier whose *top* label must be one of the targets;
both passes are appended.  Everything stays in array form inside one row —
``filter``/``transform`` lambdas — so the default extraction is a single narrow
stage with no shuffle at all.

The default sentence classifier is a cue table: a fixed list of cue words per
label, scored by counting cue tokens (a stand-in for a zero-shot model, which
needs external weights).  Any other model plugs in through ``scorer``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_name, join_sentences, name_key, split_sentences, word_tokens
from ..session import ship_code

# Fixed values of the extraction step: target labels, the fallback label and
# the excluded labels offered to the sentence classifier, in this order.
DESC_TARGETS = ["who we are", "who this is", "industry or sector"]
OTHER_LABEL = "other"
EXCLUDED_LABELS = ["address", "benefits"]

# Cue words of the default table-driven sentence classifier (our own table,
# English, German, French and Spanish).  A label's score is the number of its
# cue tokens in the sentence; no cue at all means 'other'.
CUE_WORDS = {
    "who we are": ["we", "our", "us", "wir", "unser", "unsere", "nous", "notre", "nos",
                   "nosotros", "nuestra", "nuestro"],
    "who this is": ["company", "founded", "team", "employees", "firm", "unternehmen", "firma",
                    "gegründet", "entreprise", "société", "fondée", "empresa", "fundada"],
    "industry or sector": ["industry", "sector", "manufacturing", "pharmaceutical", "bank",
                           "insurance", "branche", "industrie", "secteur", "banque",
                           "industria", "banco", "seguros"],
    "address": ["street", "road", "strasse", "straße", "rue", "avenue", "calle", "address",
                "adresse", "dirección"],
    "benefits": ["salary", "benefits", "bonus", "vacation", "lohn", "gehalt", "salaire",
                 "avantages", "salario", "beneficios"],
}


def candidate_labels(targets=None, excluding=None) -> list[str]:
    targets = list(DESC_TARGETS if targets is None else targets)
    excluding = list(EXCLUDED_LABELS if excluding is None else excluding)
    return targets + [OTHER_LABEL] + excluding


def _member_of(words: list[str]):
    return lambda t: t.isin(words)


def _disjoint(cues: dict, labels: list[str]) -> bool:
    seen: set[str] = set()
    for lab in labels:
        words = set(cues.get(lab, []))
        if words & seen:
            return False
        seen |= words
    return True


def cue_codes(tokens: Column, labels: list[str], cues: dict | None = None) -> Column | None:
    """ARRAY<INT>: the label index of every cue token, other tokens left out by one
    lookup among all cue words; None when cue lists overlap."""
    cues = CUE_WORDS if cues is None else cues
    cued = [(i, cues[lab]) for i, lab in enumerate(labels) if cues.get(lab)]
    if not cued or not _disjoint(cues, labels):
        return None
    every = sorted({w for _, words in cued for w in words})

    def code(t):
        expr = F.when(t.isin(cued[0][1]), F.lit(cued[0][0]))
        for i, words in cued[1:]:
            expr = expr.when(t.isin(words), F.lit(i))
        return expr.otherwise(F.lit(-1))
    return F.transform(F.filter(tokens, _member_of(every)), code)


def _best(counts: list[Column], labels: list[str]) -> Column:
    scored = [F.struct(c.alias("s"), F.lit(-i).alias("i"), F.lit(lab).alias("label"))
              for i, (c, lab) in enumerate(zip(counts, labels))]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def _counts_from_codes(codes: Column, K: int) -> list[Column]:
    # occurrences of code i = size - size after removing every i (built-ins only)
    return [F.size(codes) - F.size(F.array_remove(codes, F.lit(i))) for i in range(K)]


def _counts_from_tokens(toks: Column, labels: list[str], cues: dict) -> list[Column]:
    return [F.size(F.filter(toks, _member_of(cues[lab]))) if cues.get(lab) else F.lit(0) for lab in labels]


def _top(best: Column) -> Column:
    return F.when(best.getField("s") > 0, best.getField("label")).otherwise(F.lit(OTHER_LABEL))


def cue_top_label(sentence: Column, labels: list[str], cues: dict | None = None) -> Column:
    """Top label of one sentence under the cue table: most cue tokens wins,
    ties go to the earlier label, no cue -> 'other'.  (Row-level form; the
    array form used by the extractor is :func:`sentences_by_cues`.)"""
    return F.get(F.transform(F.array(word_tokens(sentence)), lambda toks: top_label_of(toks, labels, cues)), F.lit(0))


def top_label_of(toks: Column, labels: list[str], cues: dict | None = None) -> Column:
    """:func:`cue_top_label` of a sentence's tokens.  Codes and best label are bound to lambda variables,
    so they are found once and not once a label."""
    cues = CUE_WORDS if cues is None else cues
    codes = cue_codes(toks, labels, cues)
    best = F.transform(F.array(toks if codes is None else codes), lambda c: _best(
        _counts_from_tokens(c, labels, cues) if codes is None else _counts_from_codes(c, len(labels)), labels))
    return F.get(F.transform(best, _top), F.lit(0))


def sentences_by_name(sentences: Column, name: Column, compat: bool = False) -> Column:
    """M1: the sentences that mention the employer, joined with spaces."""
    return join_sentences(F.filter(sentences, lambda s: contains_name(s, name, compat)))


def residual_sentences(sentences: Column, extracted: Column | None = None,
                       found: Column | None = None) -> Column:
    """Sentences not in the (re-split) extracted text, joined and re-split.

    ``found`` is the extracted text already split.  It is bound to a lambda
    variable, so it is split once a row and not once a sentence.
    """
    found = split_sentences(extracted) if found is None else found
    kept = F.get(F.transform(F.array(found), lambda f: F.filter(sentences, lambda s: ~F.array_contains(f, s))), F.lit(0))
    return split_sentences(join_sentences(kept))


def sentences_by_cues(sentences: Column, targets=None, excluding=None, cues=None) -> Column:
    """M2 (default scorer): sentences whose top label is a target, joined.

    Layered ``transform``s so every per-sentence value is computed once:
    (sentence, cue codes) -> (sentence, best label struct) -> filter.
    """
    cues = CUE_WORDS if cues is None else cues
    labels = candidate_labels(targets, excluding)
    tset = list(DESC_TARGETS if targets is None else targets)
    first = F.transform(sentences, lambda s: F.struct(
        s.alias("s"), (cue_codes(word_tokens(s), labels, cues) if _disjoint(cues, labels)
                       else word_tokens(s)).alias("c")))
    if _disjoint(cues, labels):
        if OTHER_LABEL not in tset:                  # a sentence without cue words is 'other'
            first = F.filter(first, lambda x: F.size(x.getField("c")) > 0)
        second = F.transform(first, lambda x: F.struct(
            x.getField("s").alias("s"), _best(_counts_from_codes(x.getField("c"), len(labels)), labels).alias("b")))
    else:
        second = F.transform(first, lambda x: F.struct(
            x.getField("s").alias("s"), _best(_counts_from_tokens(x.getField("c"), labels, cues), labels).alias("b")))
    kept = F.filter(second, lambda x: _top(x.getField("b")).isin(tset))
    return join_sentences(F.transform(kept, lambda x: x.getField("s")))


def _append(d1: Column, d2: Column, compat: bool) -> Column:
    """Second pass appended to the first with one space (Q9 in compat)."""
    joined = F.concat(d1, F.lit(" "), d2)
    if compat:
        return F.when(F.length(d1) > 0, joined).otherwise(d2)
    return F.when((F.length(d1) > 0) & (F.length(d2) > 0), joined) \
        .when(F.length(d1) > 0, d1).otherwise(d2)


def _scored_pass(df: DataFrame, sent_col: str, scorer: Callable, targets) -> DataFrame:
    """M2 through an external scorer: explode, score, keep targets, regroup in order.

    The sentences alone decide the result, so they are grouped by their digest: rows of one posting with
    several employers keep their own texts, and rows with equal sentences share one group, in which
    each (position, sentence) is held once.  Rows without sentences get ''.
    """
    digest = F.sha2(F.to_json(F.struct(F.col(sent_col).alias("s"))), 256)
    work = df.withColumn("_k", F.when(F.size(sent_col) > 0, digest))
    scored = scorer(work.select("_k", F.posexplode(sent_col).alias("_pos", "sentence")))
    kept = scored.filter(F.col("top_label").isin(list(targets)))
    regrouped = kept.groupBy("_k").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("_pos", "sentence"))),
                                 lambda x: x.getField("sentence")), " ").alias("_d2"))
    return work.join(regrouped, "_k", "left").withColumn("_d2", F.coalesce(F.col("_d2"), F.lit(""))).drop("_k")


def extract_employer_description(df: DataFrame, text_col: str = "job_description",
                                 name_col: str | None = "company_name", use_cues: bool = True,
                                 targets=None, excluding=None, scorer: Callable | None = None, compat: bool = False,
                                 out: str = "employer_description") -> DataFrame:
    """M3: name pass, then the classifier pass on the residual text, appended;
    '' becomes NULL.  Adds ``out`` and ``retrieved_by`` (ARRAY of 'name'/'zsc':
    the passes that yielded text for this row)."""
    targets = list(DESC_TARGETS if targets is None else targets)
    work = df.withColumn("_sents", split_sentences(F.col(text_col)))
    if name_col is not None:
        # each sentence is tested once, with the name lower-cased once a row (bound to a lambda variable)
        name = F.col(name_col)
        told = F.transform(F.array(name_key(name, compat)), lambda n: F.transform(
            F.col("_sents"), lambda x: F.struct(x.alias("s"), F.coalesce(F.contains(F.lower(x), n), F.lit(False)).alias("hit"))))
        work = work.withColumn("_told", F.get(told, F.lit(0)))
        work = work.withColumn("_d1", join_sentences(F.filter("_told", lambda x: x.getField("hit")).getField("s")))
        # J9 for this pass: the extracted text is a sub-list of the sentences
        # chosen by a test on the sentence text, and re-splitting joined
        # sentences gives them back, so "not among the extracted sentences"
        # is exactly "fails the name test" (no re-split, no membership scan).
        resid = F.filter("_told", lambda x: ~x.getField("hit")).getField("s")
    else:
        work = work.withColumn("_d1", F.lit(""))
        resid = F.col("_sents")
    if use_cues:
        work = work.withColumn("_resid", resid)
        if scorer is None:
            work = work.withColumn("_d2", sentences_by_cues(F.col("_resid"), targets, excluding))
        else:
            work = _scored_pass(work, "_resid", scorer, targets)
        work = work.drop("_resid")
    else:
        work = work.withColumn("_d2", F.lit(""))
    desc = _append(F.coalesce(F.col("_d1"), F.lit("")), F.col("_d2"), compat)
    by = F.array_compact(F.array(F.when(F.length("_d1") > 0, F.lit("name")),
                                 F.when(F.length("_d2") > 0, F.lit("zsc"))))
    # The outputs leave through a one-row ``inline`` (a Generate node): a later
    # filter on them (e.g. dropping NULL descriptions) cannot be pushed below
    # it, so Catalyst never copies the sentence passes into that filter.
    keep = [c for c in work.columns if c not in ("_sents", "_told", "_d1", "_d2")]
    row = F.struct(F.nullif(desc, F.lit("")).alias(out), by.alias("retrieved_by"))
    return work.select(*keep, F.inline(F.array(row)))


def pandas_scorer(predict: Callable[[list[str], list[str]], list[str]], targets=None,
                  excluding=None) -> Callable[[DataFrame], DataFrame]:
    """Wrap any Python classifier ``predict(sentences, candidate_labels) -> top labels``
    as an Arrow-batched iterator pandas UDF (the model object is built once per
    worker by ``predict``'s closure, batches are scored together)."""
    labels = candidate_labels(targets, excluding)

    @F.pandas_udf("string")
    def top_label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(predict(s.fillna("").tolist(), labels), index=s.index, dtype="object")

    def score(long: DataFrame) -> DataFrame:
        ship_code(long.sparkSession)               # ``predict`` may live in this package
        return long.withColumn("top_label", top_label(F.col("sentence")))
    return score


_PY_DROP = str.maketrans("", "", __import__("string").punctuation + __import__("string").digits)


def python_cue_predict(sentences: list[str], labels: list[str]) -> list[str]:
    """The cue classifier as plain Python (a stand-in for an external model in
    :func:`pandas_scorer`); same tokens and tie rules as :func:`cue_top_label`."""
    import re
    cue_sets = {lab: set(CUE_WORDS.get(lab, [])) for lab in labels}
    out = []
    for s in sentences:
        toks = [t for t in re.split(r"[ \t\r\n\f\x0b]+", s.translate(_PY_DROP).lower()) if t]
        best, best_score = OTHER_LABEL, 0
        for lab in labels:
            sc = sum(1 for t in toks if t in cue_sets[lab])
            if sc > best_score:
                best, best_score = lab, sc
        out.append(best)
    return out
