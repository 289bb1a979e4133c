"""Radix selection: cut values of a seeded hash order, without ranking or moving rows.

A split or limit needs only the hash at which the running count reaches a quota.  That value is found
digit by digit: a histogram of the next digits of the hash (one partial aggregation; at most ``BINS``
rows reach the driver, whatever the number of rows) names the bin that holds it, the next round looks
inside that bin only, and a bin of few keys is listed.  16 rows out of 10^12 take four rounds.  The
rows are then compared with the cut where they lie: no shuffle, no window, no table of offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a round's histogram, over all cuts that are looked for.
BINS = 1 << 16
#: Keys of all remaining bins together that are listed at the end.
LISTED = 1 << 14
DIGITS = 32


@dataclass(frozen=True)
class Cut:
    """The first key, in hash order, at which the running weight reaches a quota."""

    order: str      # the key's hash
    before: int     # weight of all keys before it
    upto: int       # with the key itself


class Selector:
    """Finds cuts of the order ``order_col`` (md5 hex, see ``det``) over the rows of ``df``.

    Equal hashes are one key.  ``weight_col`` weighs rows (else each counts 1); ``by`` selects inside
    groups, of which there may be at most ``n_groups`` (bounded by the caller).  Rows with a null hash are
    counted in ``nulls`` and are before no cut.
    """

    def __init__(self, df: DataFrame, order_col: str, weight_col: str | None = None, by: str | None = None, n_groups: int = 1):
        group = F.col(by) if by else F.lit(0)
        weight = F.col(weight_col).cast("bigint") if weight_col else F.lit(1).cast("bigint")
        self.rows = df.select(group.alias("_g"), F.col(order_col).alias("_o"), weight.alias("_w"))
        self.digits = self._more(n_groups)
        self.bins: dict[object, list[tuple[str, int]]] = {}
        self.nulls = 0
        for g, prefix, w in self._histogram(self.rows, self.digits):
            if prefix is None:
                self.nulls += w
            else:
                self.bins.setdefault(g, []).append((prefix, w))
        self.totals = {g: sum(w for _, w in bins) for g, bins in self.bins.items()}

    @property
    def total(self) -> int:
        return sum(self.totals.values())

    @staticmethod
    def _more(searches: int) -> int:
        return max(1, int(math.log(BINS / max(searches, 1), 16) + 1e-9))

    @staticmethod
    def _histogram(rows: DataFrame, digits: int) -> list:
        h = rows.groupBy("_g", F.substring("_o", 1, digits).alias("_p")).agg(F.sum("_w").alias("_w"))
        return [(r["_g"], r["_p"], int(r["_w"])) for r in h.orderBy("_g", "_p").collect()]

    def _inside(self, wanted: set[tuple[object, str]], digits: int) -> DataFrame:
        """The rows of the named (group, prefix) bins."""
        prefix = F.substring("_o", 1, digits)
        if len({g for g, _ in wanted}) == 1:
            g, = {g for g, _ in wanted}
            return self.rows.where(prefix.isin(sorted({p for _, p in wanted})) & (F.col("_g") == F.lit(g)))
        return self.rows.where(F.concat(prefix, F.col("_g").cast("string")).isin(sorted(f"{p}{g}" for g, p in wanted)))

    def cuts(self, quotas: list[tuple[object, int]]) -> dict[tuple[object, int], Cut | None]:
        """The cut of every (group, quota); None where the whole group weighs less than the quota.
        A quota below 1 is reached before the first key: Cut("", 0, 0)."""
        out: dict[tuple[object, int], Cut | None] = {}
        spots: dict[tuple[object, int], tuple[str, int]] = {}          # bin and the weight before it

        def place(key, bins, before) -> None:
            for prefix, w in bins:
                if before + w >= key[1]:
                    spots[key] = (prefix, before)
                    return
                before += w

        for key in set(quotas):
            g, quota = key
            if quota < 1:
                out[key] = Cut("", 0, 0)
            elif quota > self.totals.get(g, 0):
                out[key] = None
            else:
                place(key, self.bins[g], 0)
        digits = self.digits
        while spots:
            wanted = {(key[0], p) for key, (p, _) in spots.items()}
            rows = self._inside(wanted, digits).groupBy("_g", "_o").agg(F.sum("_w").alias("_w"))
            few = rows.limit(LISTED + 1).orderBy("_g", "_o").collect() if digits < DIGITS else rows.orderBy("_g", "_o").collect()
            if len(few) <= LISTED or digits >= DIGITS:
                for key, (p, before) in spots.items():
                    for r in few:
                        if r["_g"] == key[0] and r["_o"].startswith(p):
                            if before + r["_w"] >= key[1]:
                                out[key] = Cut(r["_o"], before, before + int(r["_w"]))
                                break
                            before += int(r["_w"])
                break
            bins: dict[object, list[tuple[str, int]]] = {}
            longer = min(DIGITS, digits + self._more(len(wanted)))
            for g, p, w in self._histogram(self._inside(wanted, digits), longer):
                bins.setdefault((g, p[:digits]), []).append((p, w))
            for key, (p, before) in list(spots.items()):
                place(key, bins[key[0], p], before)
            digits = longer
        return out


def within(order: Column, cut: Cut | None) -> Column:
    """Is the row at or before the cut?  Without one (the quota is not reached) every row is."""
    return order.isNotNull() if cut is None else order <= F.lit(cut.order)
