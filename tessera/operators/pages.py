"""Deep pages and threshold sweeps from counts: only the range of the order that holds a page is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the first column of the order is cut into, and rows of a range that are sorted without cutting it again.
RANGES, ENOUGH = 64, 100_000


def _range(value: Column, bounds: list[float]) -> Column:
    """The number of bounds up to the value, by a tree of comparisons."""

    def at(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < bounds[mid], at(lo, mid)).otherwise(at(mid + 1, hi))

    return at(0, len(bounds))


def page(df: DataFrame, first: str, rest: list[Column], offset: int, limit: int, descending: bool = False, enough: int = ENOUGH) -> DataFrame:
    """`limit` rows from `offset` on in the order of the column `first` (a number or a time; nulls last), then of `rest`. Counts by range tell
    which ranges hold them; a range of more than `enough` rows is cut again, until its values are equal."""
    value = F.col(first).cast("double") if not dict(df.dtypes)[first].startswith("timestamp") else F.unix_micros(F.col(first).cast("timestamp")).cast("double")
    value = F.coalesce(-value if descending else value, F.lit(float("inf")))
    order = [F.col(first).desc_nulls_last() if descending else F.col(first).asc_nulls_last(), *rest]
    rows = df.withColumn("_value", value)
    while True:
        bounds = sorted({b for b in rows.approxQuantile("_value", [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)})
        counts = sorted((r["r"], r["n"], r["lo"], r["hi"]) for r in rows.groupBy(_range(F.col("_value"), bounds).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("lo"), F.max("_value").alias("hi")).collect())  # RANGES rows
        before, own = 0, []
        for r, n, lo, hi in counts:
            if before + n > offset and before < offset + limit:
                own.append((r, before, n, lo, hi))
            before += n
        if not own:
            return df.limit(0)
        rows = rows.where(F.col("_value").between(own[0][3], own[-1][4]))
        offset -= own[0][1]
        if sum(n for _, _, n, _, _ in own) <= enough or len(own) > 1 or own[0][3] == own[0][4] or len(counts) == 1:
            return rows.orderBy(*order).offset(offset).limit(limit).drop("_value")


def threshold_sweep(scored: DataFrame, score: str, hit: str, steps: int = 100, precision: float = 0.98) -> DataFrame:
    """threshold, n, accepted, rate, precision, recommended: for each hundredth what accepting scores from there on would give, from one histogram
    and its running sums. Recommended is the least threshold from which on every precision is at least `precision`."""
    bins = scored.where(F.col(score).isNotNull()).groupBy(F.least(F.floor(F.round(F.col(score) * steps, 6)), F.lit(steps)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(hit)).alias("hits"))
    every = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(bins), "bin", "left")  # a row for each step from here on
    from_here, all_rows, up = Window.orderBy(F.desc("bin")), Window.partitionBy(), Window.orderBy(F.desc("bin"))
    sums = every.select("bin", F.sum(F.coalesce("n", F.lit(0))).over(all_rows).alias("n"), F.sum(F.coalesce("n", F.lit(0))).over(from_here).alias("accepted"), F.sum(F.coalesce("hits", F.lit(0))).over(from_here).alias("hits"))
    p = F.col("hits") / F.greatest("accepted", F.lit(1))
    good = sums.withColumn("precision", F.round(p, 6)).withColumn("good", F.min((F.col("accepted") > 0) & (p >= precision) | (F.col("accepted") == 0)).over(up))
    least = F.min(F.when(F.col("good") & (F.col("accepted") > 0), F.col("bin"))).over(all_rows)
    return good.select((F.col("bin") / steps).alias("threshold"), "n", "accepted", F.round(F.col("accepted") / F.greatest("n", F.lit(1)), 6).alias("rate"), "precision", F.coalesce(F.col("bin") == least, F.lit(False)).alias("recommended"))
