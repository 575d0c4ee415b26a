"""Exact medians of groups of any size, without a buffer that grows with a group.

A group's rows are cut by pivots, which come from a sketch of a bounded size; rows between two pivots are counted, and only
those between the two that hold the wanted place are written and cut again. A round keeps about one row in PIVOTS, so the first
one, which reads the rows twice, is nearly all the work. When few rows of a group are left they are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.sources.scratch import small_or_shuffled, written

#: Rows of a group that one task sorts at most, pivots of a round, and the accuracy of the sketch, whose size goes with it.
FEW, PIVOTS, ACCURACY = 200_000, 24, 2_000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a joined with b, made of a small part of a written table, on keys of which any may be null; b has a row for each."""
    named = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    return a.join(small_or_shuffled(named), reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.lit(True))).drop(*(f"__{k}" for k in keys))


def _sorted(rows: DataFrame, wanted: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """keys, nth, v of groups of few rows."""
    placed = _same(rows, wanted.select(*on).distinct(), on).withColumn("__row", F.row_number().over(Window.partitionBy(*on).orderBy("v")) - 1)
    asked = wanted.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("nth").alias("__nth"), F.col("__at").cast("int").alias("__at"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + ([F.col("nth") == F.col("__nth")] if "nth" in on else [])
    found = placed.join(small_or_shuffled(asked), reduce(lambda x, y: x & y, same, F.col("__row") == F.col("__at")))
    return found.select(*keys, F.col("__nth").alias("nth"), "v")


def nth_values(rows: DataFrame, wanted: DataFrame, keys: list[str], few: int = FEW, pivots: int = PIVOTS) -> DataFrame:
    """keys, nth, v: the value at the place nth (from 0) of its group, for wanted(keys, nth, n), of which n is the size of
    the group; rows(keys, v) have no null values. NaN is the largest value, as in any order of Spark's."""
    wanted = written(wanted.withColumn("__at", F.col("nth")), "wanted")
    on, level, results = keys, rows, []
    while True:
        least, most = wanted.agg(F.min("n"), F.max("n")).first()
        if least is not None and least <= few:
            results.append(written(_sorted(level, wanted.where(F.col("n") <= few), keys, on), "nth"))
        if most is None or most <= few:
            return reduce(DataFrame.unionByName, results) if results else rows.select(*keys, F.lit(0).cast("long").alias("nth"), "v").limit(0)
        large = wanted.where(F.col("n") > few)
        shares = [(i + 1) / (pivots + 1) for i in range(pivots)]
        own = _same(level, large.select(*on).distinct(), on)
        cuts = written(own.groupBy(*on).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", shares, ACCURACY))).alias("__cuts")), "cuts")
        # 2 i between the cuts i - 1 and i, 2 i + 1 at the cut i: those of equal rows are never cut again
        below = reduce(lambda x, y: x + y, (F.when(F.get("__cuts", i) < F.col("v"), 1).otherwise(0) for i in range(pivots)))
        marked = _same(own, cuts, on).withColumn("__part", 2 * below + F.coalesce(F.get("__cuts", below) == F.col("v"), F.lit(False)).cast("int")).drop("__cuts")
        counts = marked.groupBy(*on, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("v").alias("__least"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*on).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        summed = written(counts.withColumn("__before", before), "parts")  # 2 PIVOTS + 1 rows a group at most
        renamed = large.withColumnsRenamed({k: f"__{k}" for k in on})
        held = (F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__n"))
        chosen = renamed.join(summed, reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on), held))
        chosen = written(chosen.select(*keys, F.col("__nth" if "nth" in on else "nth").alias("nth"), "__part", "__least", (F.col("__at") - F.col("__before")).alias("__at"), F.col("__n").alias("n")), "chosen")
        results.append(chosen.where("__part % 2 = 1").select(*keys, "nth", F.col("__least").alias("v")))
        rest = chosen.where("__part % 2 = 0")
        if "nth" in on:
            level = _same(marked, rest.select(*keys, "nth", "__part"), [*keys, "nth", "__part"]).select(*keys, "nth", "v")
        else:
            # a row goes on for each place that lies in its part, two at most
            parts = rest.groupBy(*keys, "__part").agg(F.collect_set("nth").alias("__nths"))
            level = _same(marked, parts, [*keys, "__part"]).select(*keys, F.explode("__nths").alias("nth"), "v")
        on, level = [*keys, "nth"], written(level, "level")
        wanted = rest.select(*keys, "nth", "__at", "n")


def medians(rows: DataFrame, keys: list[str], value: str, few: int = FEW, pivots: int = PIVOTS) -> DataFrame:
    """keys and median of the values that aren't null; of an even number the mean of the middle two. Groups without a value
    are left out. No keys: one group."""
    if not keys:
        return medians(rows.withColumn("__all", F.lit(0)), ["__all"], value, few, pivots).drop("__all")
    own = rows.select(*keys, F.col(value).alias("v")).where("v IS NOT NULL")
    sizes = written(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")
    middle: Column = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    found = nth_values(own, sizes.select(*keys, F.explode(middle).alias("nth"), "n"), keys, few, pivots)
    return found.groupBy(*keys).agg(F.avg(F.col("v").cast("double")).alias("median"))
