"""The most frequent keys of a table of counts, without sending more than about those to the driver."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, by_count: list, size: int) -> pd.DataFrame:
    """The ``size`` most frequent keys of ``counts`` (h: a 64-bit hash, c), ties by hash, in that order.

    ``by_count``: how many keys each count has. No more than about ``size`` rows reach the driver.
    """
    taken, least, tied = 0, 0, 0
    for c, n in sorted(by_count, reverse=True):
        if taken + n > size:
            least, tied = c, n
            break
        taken += n
    top = counts.where(F.col("c") > least).toPandas()
    need, reach = size - taken, 1.0
    while tied and need:
        # Hashes are spread evenly, so the least ones of the tied words lie below a bound known in advance.
        share = min(1.0, reach * (need + 8 * math.sqrt(need) + 64) / tied)
        edge = min(2**63 - 1, -(2**63) + int(share * 2**64))
        some = counts.where((F.col("c") == least) & (F.col("h") <= edge)).toPandas()
        if len(some) >= need or share == 1.0:
            top = pd.concat([top, some.nsmallest(need, "h")])
            break
        reach *= 2
    return top.sort_values(["c", "h"], ascending=[False, True])
