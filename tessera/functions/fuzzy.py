"""Fuzzy ratios of texts that built-in functions don't have, as Arrow functions: Indel ratio and token-set ratio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one whole-number operation for each letter of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common / (lengths); 1 for two empty texts."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def set_ratio(a: str, b: str) -> float:
    """The best ratio among the sorted common words and those with each side's other words; 1 where one side's words are all the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([ratio(one, two)] + ([ratio(both, one), ratio(both, two)] if both else []))


def _over(f):
    return lambda a, b: pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    return pandas_udf(_over(ratio), "double")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return pandas_udf(_over(set_ratio), "double")(a, b)


def model_ratio(a: Column, b: Column) -> Column:
    """1 for equal models, else the Indel ratio, at least 0.9 where one holds the other; texts in any case."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    r = indel_ratio(x, y)
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), F.greatest(r, F.lit(0.9))).otherwise(r)
