"""Exact quantiles of groups of any size, by rounds of counts instead of a sort or a buffer of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Parts that a range of values is cut into in a round.
PARTS = 1024
#: A range with so few values is read out at once.
FEW = 4096
LARGEST = 1.7976931348623157e308


def _place(x: Column, r: Column) -> Column:
    """Part of the range that x lies in. Each step is monotone in floating point too, so parts keep the order of values."""
    lo, hi = F.greatest(r["lo"], F.lit(-LARGEST)) / 2, F.least(r["hi"], F.lit(LARGEST)) / 2
    share = F.coalesce(F.try_divide(x / 2 - lo, hi - lo), F.lit(0.0))
    return F.when(x == float("-inf"), -1).when(x == float("inf"), PARTS).otherwise(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)))


def exact_quantiles(df: DataFrame, x: str, probabilities: list[float], by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, n, quantiles): number of values and their interpolated quantiles, an array in the order of ``probabilities``.

    A quantile lies at two neighbouring ranks. Each round cuts the range that a rank is known to lie in into PARTS, counts
    values by part (combined before the exchange, so a group costs at most PARTS rows a task and range), and keeps the part
    with the rank, narrowed to the smallest and largest value in it. A range of one value, or of FEW, ends the search: its
    values are counted one by one. No task holds a group's values, and rows themselves are not exchanged unless there are
    more groups than a broadcast can take. n values take about log(n / FEW) / log(PARTS) rounds and two more passes; df is
    read in each, so store it first if it is costly.

    Null and NaN values are left out; infinities are the ends. Groups without values give no row; without ``by`` there
    is one row, if there are values.
    """
    by = list(by)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by] or [F.lit(True)]
    rows = df.select(*by, F.col(x).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    size = stored(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi")).where("n > 0"), "quantile-sizes")
    at = [(F.col("n") - 1) * p for p in probabilities]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))
    todo = size.select(*by, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"))
    found = None
    while True:
        todo = stored(todo, "quantile-ranges")
        if todo.isEmpty():
            break
        ranges = todo.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi", (F.col("held") <= FEW).alias("few"))).alias("__ranges"))
        near = rows.alias("r").join(ranges.alias("q"), same("r", "q")) if by else rows.crossJoin(F.broadcast(ranges))  # one row
        near = near.select(*[F.col(f"r.{c}") for c in by], "__x", F.explode("__ranges").alias("__r")).where("__x between __r.lo and __r.hi")
        near = near.select(*by, "__x", F.col("__r.lo").alias("lo"), F.col("__r.hi").alias("hi"), F.when(F.col("__r.few"), F.col("__x")).otherwise(_place(F.col("__x"), F.col("__r")).cast("double")).alias("__part"))
        parts = near.groupBy(*by, "lo", "hi", "__part").agg(F.count("*").alias("c"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        w = Window.partitionBy(*by, "lo", "hi").orderBy("__part")  # PARTS or FEW rows
        parts = parts.withColumn("end", F.sum("c").over(w))
        met = todo.alias("t").join(parts.alias("p"), [*same("t", "p"), F.col("t.lo") == F.col("p.lo"), F.col("t.hi") == F.col("p.hi"), F.col("t.rank") - F.col("t.below") < F.col("p.end"), F.col("t.rank") - F.col("t.below") >= F.col("p.end") - F.col("p.c")])
        met = met.select(*[F.col(f"t.{c}") for c in by], "t.rank", F.col("p.low").alias("lo"), F.col("p.high").alias("hi"), (F.col("t.below") + F.col("p.end") - F.col("p.c")).alias("below"), F.col("p.c").alias("held"))
        met = stored(met, "quantile-parts")
        done = met.where("lo = hi").select(*by, "rank", F.col("lo").alias("value"))
        found = done if found is None else found.unionByName(done)
        todo = met.where("lo < hi")
    if found is None:
        return size.select(*by, "n", F.array().cast("array<double>").alias("quantiles"))
    known = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__v"))
    both = size.alias("s").join(known.alias("k"), same("s", "k"))
    value = lambda r: F.element_at("__v", r.cast("long"))
    each = [F.when(value(F.floor(a)) == value(F.ceil(a)), value(F.floor(a))).otherwise(value(F.floor(a)) * (F.ceil(a) - a) + value(F.ceil(a)) * (a - F.floor(a))) for a in at]
    return both.select(*[F.col(f"s.{c}") for c in by], "n", F.array(*each).alias("quantiles"))
