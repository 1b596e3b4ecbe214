"""Session-aware windows: returns, rolling statistics, momentum, risk and z-scores.

Frames count sessions, so panels are made dense first; every statistic has a least number of non-null values. All
functions add columns over one window specification per key, so Catalyst plans one exchange and one sort for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def dense_grid(prices: DataFrame) -> DataFrame:
    """All sessions of all tickers; sessions (a calendar, thousands of rows) are broadcast."""
    sessions = prices.select("date").distinct()
    tickers = prices.select("ticker").distinct()
    return tickers.crossJoin(F.broadcast(sessions)).join(prices, ["date", "ticker"], "left")


def by_ticker(*, key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_n(n: int, key: str = "ticker", order: str = "date") -> WindowSpec:
    return by_ticker(key=key, order=order).rowsBetween(-(n - 1), 0)


def prior_n(n: int | None, key: str = "ticker", order: str = "date") -> WindowSpec:
    return by_ticker(key=key, order=order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def at_least(x: Column | str, k: int, value: Column, w: WindowSpec) -> Column:
    """value over w where w holds k non-null x or more."""
    return F.when(F.count(x).over(w) >= k, value.over(w))


def simple_return(x: str = "close", w: WindowSpec | None = None, pad: bool = False) -> Column:
    """x / previous x - 1; with pad a gap is first filled with the last value."""
    w = w or by_ticker()
    if not pad:
        return F.col(x) / F.lag(x).over(w) - 1
    filled = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return filled / before - 1


def forward_return(h: int, x: str = "close") -> Column:
    return F.lead(x, h).over(by_ticker()) / F.col(x) - 1


def momentum(w: int, r: str = "ret", least: int | None = None) -> Column:
    return at_least(r, least or w, F.sum(r), last_n(w))


def reversal(w: int = 5, r: str = "ret", least: int | None = None) -> Column:
    return -momentum(w, r, least)


def volatility(w: int, r: str = "ret", least: int | None = None, annual: bool = False) -> Column:
    c = at_least(r, least or w, F.stddev_samp(r), last_n(w))
    return c * (252**0.5) if annual else c


def turnover(w: int = 21, v: str = "volume", least: int | None = None) -> Column:
    return at_least(v, least or w, F.avg(v), last_n(w))


def rolling_sums(df: DataFrame, w: int, key: str = "ticker", order: str = "date", **terms: Column) -> DataFrame:
    """df with, for each name, the sum of its term (null: 0) over the last w rows of the key: the difference of two running
    sums, so that the work is linear whatever the length of the frame."""
    run = by_ticker(key=key, order=order)
    total = lambda k: f"__sum_{k}"
    sums = df.withColumns({total(k): F.sum(F.coalesce(t.cast("double"), F.lit(0.0))).over(run.rowsBetween(Window.unboundedPreceding, 0)) for k, t in terms.items()})
    return sums.withColumns({k: F.col(total(k)) - F.coalesce(F.lag(total(k), w).over(run), F.lit(0.0)) for k in terms}).drop(*map(total, terms))


def with_beta(df: DataFrame, name: str, w: int, least: int, r: Column | str = "ret", m: Column | str = "mkt") -> DataFrame:
    """df with the rolling covariance of r and m over the variance of m, over rows where both are known."""
    r, m = (F.col(c) if isinstance(c, str) else c for c in (r, m))
    both = r.isNotNull() & m.isNotNull()
    terms = {"n": F.lit(1), "r": r, "m": m, "rm": r * m, "mm": m * m}
    sums = rolling_sums(df, w, **{f"__{k}": F.when(both, t) for k, t in terms.items()})
    n, sr, sm, rm, mm = (F.nullif(F.col("__n"), F.lit(0.0)) if k == "n" else F.col(f"__{k}") for k in terms)
    var = mm - sm * sm / n
    beta = F.when((n >= least) & (var > 1e-12 * mm), (rm - sr * sm / n) / var)
    return sums.withColumn(name, beta).drop(*[f"__{k}" for k in terms])


def illiquidity(w: int = 21, least: int = 1) -> Column:
    """Mean of |return| over traded value."""
    x = F.abs("ret") / F.nullif(F.col("close") * F.col("volume"), F.lit(0.0))
    return at_least(x, least, F.avg(x), last_n(w))


def complete(w: int, x: str) -> Column:
    """All of the last w rows are there, not null and positive."""
    return F.count(F.when(F.col(x) > 0, 1)).over(last_n(w)) == w


def momentum_12_1(x: str = "close") -> Column:
    """Of 12 monthly closes: the last but none over the first."""
    return F.when(complete(12, x), F.col(x) / F.lag(x, 11).over(by_ticker()) - 1)


def reversal_1m(x: str = "close") -> Column:
    return -(F.col(x) / F.lag(x).over(by_ticker()) - 1)


def rolling_rank(x: str, w: int) -> Column:
    """Percentile rank of the current value in its window, ties averaged; the window holds w known values."""
    frame = last_n(w)
    values = F.collect_list(x).over(frame)
    current = F.col(x)
    less = F.size(F.filter(values, lambda v: v < current))
    same = F.size(F.filter(values, lambda v: v == current))
    return F.when((F.count(x).over(frame) == w) & current.isNotNull(), (less + (same + 1) / 2) / w)


def gain_ratio(x: str, w: int) -> Column:
    """Sum of rises over sum of moves."""
    d = F.col(x) - F.lag(x).over(by_ticker())
    return d, w


def time_to_high(x: str, w: int) -> Column:
    """Place of the first highest value of the window, 0 to 1."""
    frame = last_n(w)
    values = F.collect_list(x).over(frame)
    return F.when(F.count(x).over(frame) == w, (F.array_position(values, F.array_max(values)) - 1) / F.lit(float(w - 1)))


def sample_skew(x: str, w: int, least: int) -> Column:
    """Bias-corrected skewness."""
    frame = last_n(w)
    n = F.count(x).over(frame)
    return F.when((n >= least) & (F.stddev_pop(x).over(frame) > 1e-12), F.skewness(x).over(frame) * F.sqrt(n * (n - 1)) / (n - 2))


def prior_z(x: str, n: int | None, least: int, key: str = "ticker", order: str = "date", clip: float | None = None) -> Column:
    """(x - mean of earlier rows) / their standard deviation; the current row is not among them."""
    frame = prior_n(n, key, order)
    sd = F.stddev_samp(x).over(frame)
    z = F.when((F.count(x).over(frame) >= least) & (sd > 1e-12), (F.col(x) - F.avg(x).over(frame)) / sd)
    return clipped(z, clip) if clip else z


def clipped(x: Column, c: float) -> Column:
    """x between -c and c; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(c)), F.lit(-c)))


def expanding_scale(x: str, least: int, key: str = "ticker", order: str = "date") -> Column:
    frame = by_ticker(key=key, order=order).rowsBetween(Window.unboundedPreceding, 0)
    sd = F.stddev_samp(x).over(frame)
    return F.when((F.count(x).over(frame) >= least) & (sd > 1e-12), F.col(x) / sd)


def end_of_month(df: DataFrame, *keys: str, date: str = "date") -> DataFrame:
    """Rows on the last date of their key and month."""
    w = Window.partitionBy(*keys, F.trunc(date, "month"))
    return df.withColumn("__last", F.max(date).over(w)).where(F.col(date) == F.col("__last")).drop("__last")


def average_rank(x: str, *by: str) -> Column:
    """Rank in its group with ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0


def others_mean(x: str, *by: str) -> Column:
    """Mean of the others of the group: (sum - x) / (n - 1); null if x is null or alone."""
    w = Window.partitionBy(*by)
    n = F.count(x).over(w)
    return F.when((n > 1) & F.col(x).isNotNull(), (F.sum(x).over(w) - F.col(x)) / (n - 1))


def run_lengths(df: DataFrame, x: str, key: str = "ticker", order: str = "date") -> DataFrame:
    """Runs of equal consecutive values: key, run number, value, first and last order, length."""
    w = by_ticker(key=key, order=order)
    changed = df.withColumn("__new", F.when(F.col(x).eqNullSafe(F.lag(x).over(w)), 0).otherwise(1))
    numbered = changed.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.first(x).alias("value"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
