"""Truncation by the subwords of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_after(text: str, ends: list[int], n: int) -> str:
    """``text`` up to the end of its n-th subword; ``ends`` are the subwords' ends in characters."""
    return text if len(ends) <= n else text[: max(ends[:n], default=0)]


def first_subwords(text: Column, tokenizer_path: str, n: int = 128) -> Column:
    """The text up to the end of its first ``n`` subwords, without special tokens.

    ``tokenizer_path`` names a tokenizer file that every executor can open; a task loads it once and
    encodes whole Arrow batches.  A character whose bytes the cut divides stays whole.  Null stays null,
    an empty text stays empty.
    """
    if not isinstance(n, int) or n < 0:
        raise ValueError("n must be a non-negative int")

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        for s in batches:
            known = s[s.notna()]
            codes = tokenizer.encode_batch(known.tolist(), add_special_tokens=False)
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[known.index] = [cut_after(t, [e for _, e in c.offsets], n) for t, c in zip(known, codes)]
            yield out

    return F.pandas_udf(cut, "string")(text)
