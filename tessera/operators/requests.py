"""Checks of batch requests, and what a screen shows of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of a request's fields, and the per cent that a stage stands for.
SHORTEST, LONGEST, FIRST_YEAR, LAST_YEAR, VIN_SIZES = 5, 1000, 1900, 2030, (11, 17)
STAGE_PERCENT = {"extracting": 25, "transforming": 50, "ready_for_matching": 75, "matching": 90, "completed": 100, "error": 0}
SHOWN = 5


def vehicle_errors(description: Column, insurer: Column, year: Column, vin: Column) -> Column:
    """Messages about a vehicle of a request; a null text counts as empty, a year of 0 as none."""
    d = F.coalesce(description, F.lit(""))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(blank(d), "Vehicle description is required"), F.when(blank(insurer), "Insurer ID is required"),
        F.when(F.length(d) > LONGEST, f"Vehicle description too long (max {LONGEST} characters)"), F.when(F.length(d) < SHORTEST, f"Vehicle description too short (min {SHORTEST} characters)"),
        F.when((year != 0) & ~year.between(FIRST_YEAR, LAST_YEAR), F.concat(F.lit("Invalid year: "), year.cast("string"))), F.when((vin != "") & ~F.length(vin).isin(*VIN_SIZES), "VIN format appears invalid"),
    ))


def batch_errors(vehicles: DataFrame, batch: str, position: str, errors: str, most: int = 1000) -> DataFrame:
    """(batch, n, n_invalid, messages) of every batch: its size where above `most`, its first SHOWN invalid vehicles by position, and
    how many more there are. Only SHOWN rows of a batch ever meet in a task: the rank is limited before the shuffle."""
    bad = F.size(errors) > 0
    sizes = vehicles.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_invalid"))
    w = Window.partitionBy(batch).orderBy(position)
    line = F.concat(F.lit("Vehicle "), F.col(position).cast("string"), F.lit(": "), F.array_join(errors, "; "))
    first = vehicles.where(bad).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= SHOWN).select(batch, "_rank", line.alias("_line"))
    shown = first.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("_rank", "_line")))["_line"].alias("_lines"))
    size = F.when(F.col("n") > most, F.concat(F.lit("Batch size "), F.col("n").cast("string"), F.lit(f" exceeds maximum ({most})")))
    more = F.when(F.col("n_invalid") > SHOWN, F.concat(F.lit("Additional "), (F.col("n_invalid") - SHOWN).cast("string"), F.lit(" vehicles have validation errors")))
    lines = F.coalesce("_lines", F.array().cast("array<string>"))
    return sizes.join(shown, batch, "left").select(batch, "n", "n_invalid", F.array_compact(F.concat(F.array(size), lines, F.array(more))).alias("messages"))


def stage_percent(status: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in STAGE_PERCENT.items() for x in pair))
    return F.coalesce(F.try_element_at(known, status), F.lit(0))


def results_summary(results: DataFrame, run: str, confidence: str, code: str, order: list[Column] | None = None) -> DataFrame:
    """(run, n, n_codes, average): average confidence in per cent to one place, where none counts as 0, and results with a code. A sum of
    doubles depends on its order and may fall to either side of a half: with `order` a run's results are added in that order."""
    has = F.col(code).isNotNull() & (F.col(code) != "")
    if order is not None:
        results = results.withColumn("_order", F.struct(*order)).repartition(run).sortWithinPartitions(run, "_order")
    return results.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.count_if(has).alias("n_codes"), F.round(F.avg(F.coalesce(confidence, F.lit(0.0))) * 100, 1).alias("average"))


def listed(runs: DataFrame, name: str, time: str, key: str, search: str = "", status: Column | None = None, sort: str = "recent") -> DataFrame:
    """Runs whose name contains the search in any case, of a status, sorted: recent, oldest or name; ties by key."""
    out = runs.where(F.lower(name).contains(search.lower()))
    if status is not None:
        out = out.where(status)
    first = {"recent": F.desc(time), "oldest": F.asc(time), "name": F.asc(name)}[sort]
    return out.orderBy(first, key)
