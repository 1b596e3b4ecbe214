"""Joins beyond the as-of family: frame differences, corroborated look-ups, projections and source priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_divide(n: Column, d: Column, eps: float = 1e-9) -> Column:
    """n / d, null where |d| < eps."""
    return F.when(F.abs(d) >= eps, n / d)


def frame_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two frames: change is new, exited, increased or reduced. One full join of aggregates."""
    a = before.groupBy(*keys).agg(F.sum(value).alias("before"))
    b = after.groupBy(*keys).agg(F.sum(value).alias("after"))
    joined = a.join(b, keys, "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "exited").when(F.col("after") > F.col("before"), "increased").when(F.col("after") < F.col("before"), "reduced")
    return joined.withColumn("change", change).where("change is not null")


def unique_lookup(rows: DataFrame, directory: DataFrame, on: list[str], value: str) -> DataFrame:
    """rows with value from directory where all keys agree and they name exactly one value; else null."""
    single = directory.groupBy(*on).agg(F.min(value).alias(value), F.max(value).alias("__other")).where(F.col(value) == F.col("__other")).drop("__other")
    return rows.join(single, on, "left")


def shared_items(pairs: DataFrame, left: str, item: str, sample: int = 8, by: list[str] | tuple[str, ...] = (), block: int = 1000) -> DataFrame:
    """Projection of (by, left, item) on pairs of left that share an item: (by, a, b, w, shared, truncated): how many items
    they share, the first ``sample`` of them, and whether there are more.

    All pairs are wanted, so an item of n holders makes n squared of them; what must not grow is a task. Holders of an item
    with more than ``block`` are dealt to blocks, and every two blocks of an item meet under a key of their own, so a key
    holds at most about two blocks of rows and their pairs, however many hold the item. Pairs then meet once by (a, b), in
    a window that spills. Rows with a null in any of the columns link nothing; repeated rows count once.
    """
    by = list(by)
    distinct = pairs.select(*by, left, item).dropna().distinct()
    heavy = distinct.groupBy(*by, item).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    parts = F.coalesce(F.ceil(F.col("__n") / block), F.lit(1)).cast("int")
    rows = distinct.join(heavy, [*by, item], "left").select(*by, item, F.col(left).alias("__l"), F.pmod(F.xxhash64(left), parts).cast("int").alias("__own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("__o"))
    rows = rows.select(*by, item, "__l", "__own", F.least("__own", "__o").alias("__lo"), F.greatest("__own", "__o").alias("__hi"))
    keys = [*by, item, "__lo", "__hi"]
    a, b = (rows.select(*keys, F.col("__l").alias(n), F.col("__own").alias(f"__{n}")) for n in "ab")
    linked = a.join(b, keys).where((F.col("a") < F.col("b")) & ((F.col("__lo") == F.col("__hi")) | (F.col("__a") != F.col("__b"))))
    w = Window.partitionBy(*by, "a", "b")
    first = linked.select(*by, "a", "b", item, F.count("*").over(w).alias("w"), F.row_number().over(w.orderBy(item)).alias("__k")).where(F.col("__k") <= sample)
    return first.groupBy(*by, "a", "b").agg(F.max("w").alias("w"), F.sort_array(F.collect_list(item)).alias("shared")).withColumn("truncated", F.col("w") > sample)


def by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first source that has the key, source by source."""
    parts = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = F.min("priority").over(Window.partitionBy(key))
    return out.withColumn("__best", best).where("priority = __best").drop("__best")


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join, with the counts that must be zero for a one-to-one match of equal key sets in every row."""
    ka, kb = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((a, "__a"), (b, "__b")))
    bad = ka.join(kb, keys, "full").agg(F.count_if((F.coalesce("__a", F.lit(0)) != 1) | (F.coalesce("__b", F.lit(0)) != 1)).alias("bad_keys"))
    return a.join(b, keys).crossJoin(F.broadcast(bad))  # one row


def keep_last(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row a key: the last in the given order. Order by enough columns to make it total."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
