"""Point-in-time joins by one union, one exchange on the key and one sorted pass.

Both sides are united, ordered by time, and the last row of the right side is carried to the rows of the left. No range
join is planned, and the cost is linear in both sides whatever the number of facts per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    by: list[str] | tuple[str, ...] = (),
    strict: bool = False,
    forward: bool = False,
    tolerance_days: int | None = None,
    ties: tuple[str, ...] = (),
    how: str = "left",
) -> DataFrame:
    """left with the columns of the latest right row of the same ``by`` whose time is at or before left's.

    strict: before only. forward: the earliest at or after instead. tolerance_days: matches farther away are dropped.
    ties: right columns, the largest of which (in this order) wins among equal times. how: left keeps unmatched rows,
    inner drops them, semi drops them and the right columns. A matched row is carried with its nulls.
    """
    by = list(by)
    if not by:
        return _asof_calendar(left, right, left_on, right_on, strict, forward, tolerance_days, ties, how)
    payload = [c for c in right.columns if c not in by]
    keys = [f"__k{i}" for i in range(len(by))]
    tie_type = "struct<" + ",".join(f"o{i}:{dict(right.dtypes)[c]}" for i, c in enumerate(ties)) + ">"

    def kind(df: DataFrame, names: list[str]):
        return df.select(F.struct(*names).alias("x")).schema["x"].dataType

    held = left.select(
        *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)],
        F.col(left_on).alias("__t"),
        (F.lit(None).cast(tie_type) if ties else F.lit(0)).alias("__o"),
        F.struct(*left.columns).alias("__left"),
        F.lit(None).cast(kind(right, payload)).alias("__right"),
    )
    facts = right.where(F.col(right_on).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)],
        F.col(right_on).cast(dict(left.dtypes)[left_on]).alias("__t"),
        (F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(ties)]) if ties else F.lit(0)).alias("__o"),
        F.lit(None).cast(kind(left, left.columns)).alias("__left"),
        F.struct(*payload).alias("__right"),
    )
    is_left = F.col("__left").isNotNull().cast("int")
    # among equal times facts stand before the rows they may reach, and after them if the match is strict
    time = F.col("__t").desc_nulls_last() if forward else F.col("__t").asc_nulls_first()
    order = [time, (1 - is_left if strict else is_left).asc(), *([F.col("__o").asc_nulls_first()] if ties else [])]
    window = Window.partitionBy(*keys) if by else Window.partitionBy(F.lit(0))
    match = F.last("__right", ignorenulls=True).over(window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = held.unionByName(facts).withColumn("__m", match).where(is_left == 1).select("__left.*", "__m")
    if tolerance_days is not None:
        near = F.abs(F.datediff(F.col(left_on), F.col(f"__m.{right_on}"))) <= tolerance_days
        out = out.withColumn("__m", F.when(near, F.col("__m")))
    if how in ("inner", "semi"):
        out = out.where(F.col("__m").isNotNull())
    if how == "semi":
        return out.drop("__m")
    new = [c for c in payload if c not in left.columns]
    return out.select(*left.columns, *[F.col(f"__m.{c}").alias(c) for c in new])


def _asof_calendar(left, right, left_on, right_on, strict, forward, tolerance_days, ties, how) -> DataFrame:
    """An as-of join without a key: the distinct times of both sides, a calendar, are matched in one sorted pass, and the
    rows of left are joined to that map. Of equal times on the right the one with the largest ties stands."""
    payload = [c for c in right.columns if c != right_on]
    held = F.struct(*payload) if payload else F.struct(F.lit(0).alias("__none"))
    best = F.max_by(held, F.struct(*ties)) if ties else F.first(held)
    facts = right.where(F.col(right_on).isNotNull()).groupBy(F.col(right_on).alias("__at")).agg(best.alias("__held")).withColumn("__k", F.lit(0))
    times = left.where(F.col(left_on).isNotNull()).select(F.col(left_on).alias("__t")).distinct().withColumn("__k", F.lit(0))
    found = asof_join(times, facts, "__t", "__at", by=["__k"], strict=strict, forward=forward, tolerance_days=tolerance_days, how="inner").drop("__k")
    out = left.join(found, F.col(left_on) == F.col("__t"), {"left": "left", "inner": "inner", "semi": "left_semi"}[how])
    if how == "semi":
        return out
    new = [c for c in right.columns if c not in left.columns]
    return out.select(*[left[c] for c in left.columns], *[F.col("__at").alias(c) if c == right_on else F.col(f"__held.{c}").alias(c) for c in new])


def as_of_dates(dates: DataFrame, snapshots: DataFrame, date: str = "date", snapshot: str = "snap") -> DataFrame:
    """(date, snap): the latest snapshot at or before each date, by one sorted pass over both short lists of dates."""
    left = dates.select(date).distinct()
    right = snapshots.select(F.col(date).alias(snapshot)).distinct()
    return asof_join(left, right, date, snapshot, how="inner")


def mask_to_members(panel: DataFrame, membership: DataFrame, date: str = "date", key: str = "ticker") -> DataFrame:
    """Panel rows whose key is in the latest membership snapshot at or before their date; earlier rows are dropped."""
    mapped = as_of_dates(panel, membership, date)
    members = membership.select(F.col(date).alias("snap"), key)
    return panel.join(F.broadcast(mapped), date).join(members, ["snap", key], "left_semi").drop("snap")


def sessions_of(df: DataFrame, date: str = "date") -> DataFrame:
    """(date, idx) of the distinct dates, idx from 1: a calendar, small enough for one sorted pass."""
    return df.select(date).distinct().withColumn("idx", F.row_number().over(Window.orderBy(date)))


def align_to_sessions(events: DataFrame, sessions: DataFrame, horizon: int, event_date: str = "event_date", date: str = "date") -> DataFrame:
    """Events with t_info_date (last session before), label_start_date (first at or after) and label_end_date (horizon
    sessions on). Events that leave the calendar are dropped."""
    start = asof_join(events, sessions.withColumnRenamed(date, "label_start_date"), event_date, "label_start_date", forward=True, how="inner")
    places = sessions.select(F.col("idx").alias("__i"), F.col(date).alias("__d"))
    before = F.broadcast(places.select(F.col("__i").alias("__b"), F.col("__d").alias("t_info_date")))
    after = F.broadcast(places.select(F.col("__i").alias("__a"), F.col("__d").alias("label_end_date")))
    return start.join(before, F.col("idx") - 1 == F.col("__b")).join(after, F.col("idx") + horizon == F.col("__a")).drop("__a", "__b", "idx")
