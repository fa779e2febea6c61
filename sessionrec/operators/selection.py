"""Exact selection of the value of a rank, and of the least keys, without a global sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of a pass; the driver sees a count for each.
RANGES = 64
#: Accuracy of the sketch that sets the ranges. It decides how many passes there are, not the result.
SKETCH = 2_000
#: Values of a range that are few enough to be sorted on the driver.
FEW = 10_000


def exact_quantile(rows: DataFrame, value: Column, q: float) -> float | None:
    """The least value v for which at least the share q of the values is up to v; None without values. Null values don't count.

    A pass cuts the values that are left into RANGES by a quantile sketch, counts each range exactly, and goes on with the
    one that holds the rank; it ends at a range of one value or of FEW. Counts are exact, so the rank lies inside by
    construction: a bad sketch costs passes. Tasks send counts only, whatever ties or tails there are.
    """
    left = rows.select(value.alias("v")).where("v is not null")
    n, rank, below = left.count(), 0, 0
    if n == 0:
        return None
    rank = max(1, math.ceil(n * q))
    inside, splitters = n, None
    while True:
        splitters = splitters or [*dict.fromkeys(left.agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], SKETCH)).first()[0])]
        number = F.size(F.filter(F.array(*map(F.lit, splitters)), lambda s: s < F.col("v")))
        counts = left.groupBy(number.alias("range")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("range").collect()  # RANGES rows at most
        for r in counts:
            if rank <= below + r.n:
                break
            below += r.n
        if not below < rank <= below + r.n:
            raise ValueError("the rows changed between two passes over them")
        if r.low == r.high:
            return r.low
        left = left.where((F.col("v") >= r.low) & (F.col("v") <= r.high))
        if r.n <= FEW:
            return sorted(x.v for x in left.collect())[rank - below - 1]
        # A sketch that parts nothing off gives way to ranges of equal width.
        splitters = [r.low + (r.high - r.low) * k / RANGES for k in range(RANGES)] if r.n == inside else None
        inside = r.n


def least_keys(rows: DataFrame, code: Column, key: Column, n: int, digits: int = 3) -> Column:
    """A condition that holds for the n least of distinct keys, ordered by (code, key); code: hexadecimal digits, spread evenly.

    Keys are counted by the first digits of their codes (16 ** digits counts at most). Those below the prefix that holds the n-th one are in;
    that prefix is counted by its next digits, until FEW keys are left in it. No sort and no limit: the condition is a comparison
    with one bound, so a sample of any size is a filter.
    """
    left = rows.select(code.alias("code"), key.alias("key")).distinct()
    if n <= 0:
        return F.lit(False)
    prefix, wanted = "", n
    while True:
        counts = left.groupBy(F.substring("code", 1, len(prefix) + digits).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        for r in counts:
            if wanted <= r.n:
                break
            wanted -= r.n
        else:
            return F.lit(True)  # there are fewer keys
        prefix = r.p
        left = left.where(F.col("code").startswith(prefix))
        if r.n <= FEW:
            code_at, key_at = sorted(map(tuple, left.collect()))[wanted - 1]
            return (code < code_at) | ((code == code_at) & (key <= key_at))
