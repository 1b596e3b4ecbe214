"""Aggregates that watch panels: quantile buckets, drift, calibration, coverage, anomalies, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def bucket(x: Column, edges: Column, right_closed: bool = True) -> Column:
    """Number of inner edges below x (right-closed buckets), or at or below x (left-closed)."""
    return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when((x > e) if right_closed else (x >= e), 1).otherwise(0))


def inner_edges(df: DataFrame, x: str, n: int, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, edges): the distinct inner quantiles that cut x into n buckets, interpolated; groups may be of any size."""
    return exact_quantiles(df, x, [i / n for i in range(1, n)], by).select(*by, F.array_distinct("quantiles").alias("edges"))


def population_stability(reference: DataFrame, sample: DataFrame, x: str, n: int = 10, least: float = 1e-4, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(by, psi): the population stability index of sample against reference over reference's quantile buckets. Shares
    under ``least`` count as that."""
    by = list(by)
    edges = inner_edges(reference, x, n, by)

    def shares(df: DataFrame, name: str) -> DataFrame:
        with_edges = df.join(F.broadcast(edges), by) if by else df.crossJoin(F.broadcast(edges))  # a row per group
        counted = with_edges.groupBy(*by, bucket(F.col(x), F.col("edges")).alias("b")).agg(F.count("*").alias("c"))
        return counted.select(*by, "b", (F.col("c") / F.sum("c").over(Window.partitionBy(*by, F.lit(0)))).alias(name))  # n rows

    joined = shares(reference, "p").join(shares(sample, "q"), [*by, "b"], "full")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(least)) for c in ("p", "q"))
    return joined.groupBy(*by).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def reliability(df: DataFrame, p: str, y: str, n: int = 10) -> DataFrame:
    """Bins of predicted probability (the last one closed): size, mean prediction, observed share."""
    b = F.least(F.floor(F.col(p) * n), F.lit(n - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def variation(df: DataFrame, date: str, features: list[str], flat: float = 1e-12) -> DataFrame:
    """Per date and feature: rows, known, distinct, standard deviation and a verdict, in one pass over the unpivoted panel."""
    long = df.unpivot([date], features, "feature", "x")
    g = long.groupBy(date, "feature").agg(F.count("*").alias("n"), F.count("x").alias("known"), F.count_distinct("x").alias("distinct"), F.stddev_samp("x").alias("sd"))
    cover = F.col("known") / F.col("n")
    verdict = F.when(F.col("known") == 0, "empty").when(F.col("distinct") == 1, "constant").when(F.coalesce("sd", F.lit(0.0)) < flat, "flat").when(cover < 0.5, "sparse").otherwise("ok")
    return g.withColumn("verdict", verdict)


def micro_scores(df: DataFrame, gold: str, predicted: str) -> list[Column]:
    """Precision, recall and F1 over pairs where null means abstained; null where undefined."""
    tp = F.count_if(F.col(gold) & F.col(predicted))
    fp = F.count_if(~F.col(gold) & F.col(predicted))
    fn = F.count_if(F.col(gold) & ~F.coalesce(F.col(predicted), F.lit(False)))
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), 6).alias("f1"), F.round(F.count(predicted) / F.count("*"), 6).alias("coverage")]


def fingerprint(df: DataFrame) -> list[Column]:
    """Row count and an order-free hash of all rows as text (numbers with two digits): the sum of the first 32 bits of their
    md5, so that repeated rows count."""
    row = F.concat_ws("|", *[F.coalesce(F.format_string("%.2f", c) if t in ("double", "float") else F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes])
    return [F.count("*").alias("rows"), F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")), F.lit(0)).alias("hash")]


def murphy(df: DataFrame, p: str, y: str, by_id: str, digits: int = 4, display: int = 5) -> tuple[DataFrame, DataFrame]:
    """Two tables on forecasts p of outcomes y (0 or 1).

    The first is one row: n, brier, reliability, resolution and uncertainty over bins of equal p (so that brier = reliability -
    resolution + uncertainty holds exactly), ece over ``display`` bins of about equal size that never part equal forecasts,
    and skill, 1 - brier / uncertainty. The second has for every row (by_id, p, y) delta, by how much the resolution falls
    if that row is left out: of sums by bin, without another pass for each row.

    Forecasts count as rounded to ``digits`` decimals, so there are at most 10^digits + 1 bins, of which a task holds the
    sums. Rows with a null or NaN are left out. No rows: no rows.
    """
    rows = df.select(F.col(by_id).alias("__id"), F.round(F.col(p), digits).alias("p"), F.col(y).cast("double").alias("y")).where("p is not null and y is not null and not isnan(p) and not isnan(y)")
    bins = rows.groupBy("p").agg(F.count("*").alias("nb"), F.sum("y").alias("sb"))
    total = bins.agg(F.sum("nb").alias("n"), (F.sum("sb") / F.sum("nb")).alias("base"))
    known = bins.crossJoin(F.broadcast(total)).withColumn("o", F.col("sb") / F.col("nb"))  # one row
    w = Window.orderBy("p")  # at most 10^digits + 1 bins
    ends = known.withColumns({"__i": F.row_number().over(w), "__cum": F.sum("nb").over(w)})
    near = [F.min_by("__i", F.struct(F.abs(F.col("__cum") - F.col("n") * b / display), F.col("__i"))).alias(f"e{b}") for b in range(1, display)]
    cuts = ends.agg(*near)
    for b in range(2, display):
        cuts = cuts.withColumn(f"e{b}", F.greatest(f"e{b}", F.col(f"e{b - 1}") + 1))
    shown = ends.crossJoin(F.broadcast(cuts))  # one row
    place = sum((F.col("__i") > F.col(f"e{b}")).cast("int") for b in range(1, display))
    ece = shown.groupBy(place.alias("__b"), "n").agg(F.sum("nb").alias("m"), F.sum(F.col("p") * F.col("nb")).alias("sp"), F.sum("sb").alias("sy")).agg(F.sum(F.abs(F.col("sp") - F.col("sy")) / F.col("n")).alias("ece"))
    parts = known.agg(
        F.max("n").alias("n"), (F.sum(F.col("nb") * F.col("p") * F.col("p") - 2 * F.col("p") * F.col("sb") + F.col("sb")) / F.max("n")).alias("brier"), (F.sum(F.col("nb") * (F.col("p") - F.col("o")) ** 2) / F.max("n")).alias("reliability"),
        (F.sum(F.col("nb") * (F.col("o") - F.col("base")) ** 2) / F.max("n")).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    ).where("n > 0")
    report = parts.crossJoin(ece).withColumn("skill", 1 - F.try_divide("brier", F.col("uncertainty")))  # one row each
    share = F.col("nb") * (F.col("o") - F.col("base")) ** 2
    whole = parts.select("resolution")
    left = F.when(F.col("nb") > 1, (F.col("nb") - 1) * ((F.col("sb") - F.col("y")) / F.nullif(F.col("nb") - 1, F.lit(0)) - F.col("base")) ** 2).otherwise(0.0)
    delta = F.col("resolution") - F.try_divide(F.col("n") * F.col("resolution") - share + left, F.col("n") - 1)
    each = rows.join(known, "p").crossJoin(F.broadcast(whole)).select(F.col("__id").alias(by_id), "p", "y", delta.alias("delta"))  # one row
    return report, each


def price_anomalies(panel: DataFrame, jump: float = 0.5, stale_run: int = 5, key: str = "ticker", order: str = "date", x: str = "close") -> DataFrame:
    """(key, kind, count, detail) of the defects of each series on a panel that is dense in sessions (null: no print):
    ``nonpositive`` prints (detail: the first one's date), ``interior_gap``, all sessions without a print between the first
    and the last one, ``jump``, changes from a session to the next over ``jump`` in size (detail: the largest; a change from
    0 counts), and ``stale``, sessions in runs of ``stale_run`` or more equal prints (detail: the longest run). A clean
    series has no row. One exchange by key."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    v, prior = F.col(x), F.lag(x).over(w)
    known = v.isNotNull()
    rows = panel.select(
        key, order, v.alias("x"), F.when(prior != 0, F.abs(v / prior - 1)).when(v.isNotNull() & (v != 0) & (prior == 0), float("inf")).alias("move"), F.min(F.when(known, F.col(order))).over(whole).alias("lo"),
        F.max(F.when(known, F.col(order))).over(whole).alias("hi"), F.sum(F.when(known & (v == prior), 0).otherwise(1)).over(w).alias("run"),
    )
    runs = rows.where("x is not null").groupBy(key, "run").agg(F.count("*").alias("length")).where(F.col("length") >= stale_run).groupBy(key).agg(F.sum("length").alias("count"), F.max("length").cast("string").alias("detail"))
    gap = (F.col("x").isNull()) & F.col(order).between(F.col("lo"), F.col("hi"))
    size = F.max(F.when(F.col("move") < float("inf"), F.col("move")))
    sums = rows.groupBy(key).agg(
        F.count_if(F.col("x") <= 0).alias("n0"), F.min(F.when(F.col("x") <= 0, F.col(order))).cast("string").alias("d0"), F.count_if(gap).alias("n1"), F.count_if(F.col("move") > jump).alias("n2"), F.format_string("%.6f", F.coalesce(size, F.lit(float("inf")))).alias("d2")
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(n).alias("count"), d.cast("string").alias("detail")) for k, n, d in (("nonpositive", "n0", F.col("d0")), ("interior_gap", "n1", F.lit("")), ("jump", "n2", F.col("d2")))])
    return sums.select(key, F.explode(kinds).alias("k")).select(key, "k.*").where(F.col("count") > 0).unionByName(runs.select(key, F.lit("stale").alias("kind"), "count", "detail"))


def pressure(mentions: DataFrame, latest: Column, days: int = 30, least: int = 14) -> DataFrame:
    """(ticker, latest_mentions, velocity, crowding_z, lean, grade, n_days) over the ``days`` up to ``latest`` of mentions
    (date, ticker, mentions, sentiment): last week's against the week before, the last day against the window's mean and
    deviation, the mean sentiment, and a grade of both. Names with fewer than ``least`` days are left out."""
    age = F.datediff(latest, "date")
    week = lambda a, b: F.coalesce(F.sum(F.when((age >= a) & (age < b), F.col("mentions"))), F.lit(0))
    g = mentions.where((age >= 0) & (age < days)).groupBy("ticker").agg(
        F.max_by("mentions", "date").alias("latest_mentions"), week(0, 7).alias("cur"), week(7, 14).alias("prev"), F.avg("mentions").alias("mean"), F.stddev_samp("mentions").alias("sd"),
        F.coalesce(F.avg(F.when(~F.isnan("sentiment"), F.col("sentiment"))), F.lit(0.0)).alias("lean"), F.count("*").alias("n_days"),
    ).where(F.col("n_days") >= least)
    cur, prev = F.col("cur"), F.col("prev")
    velocity = F.when(prev <= 0, (cur > 0).cast("double")).otherwise(F.try_divide(cur - prev, prev))
    z = F.when(F.col("sd") < 1e-9, 0.0).otherwise(F.try_divide(F.col("latest_mentions") - F.col("mean"), F.col("sd")))
    g = g.withColumns({"velocity": velocity, "crowding_z": z})
    v, c = F.col("velocity"), F.col("crowding_z")
    grade = F.when((v >= 1) | (c >= 2.5), "surge").when((v >= 0.5) | (c >= 1.5), "elevated").when((v <= -0.3) & (c <= -1), "quiet").otherwise("normal")
    return g.select("ticker", "latest_mentions", "velocity", "crowding_z", "lean", grade.alias("grade"), "n_days")
