"""Grouped inference: rank correlation, serial-correlation-robust means, bootstraps, costs and risk, many series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import student_p
from ..shared import stored
from .rolling import average_rank


def rank_ic(df: DataFrame, by: list[str], score: str, y: str, least: int = 5) -> DataFrame:
    """Spearman correlation with average ranks per group of at least ``least`` rows: (by, ic, n)."""
    known = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    ranked = known.withColumns({"__s": average_rank(score, *by), "__y": average_rank(y, *by)})
    return ranked.groupBy(*by).agg(F.corr("__s", "__y").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least).where(F.col("ic").isNotNull() & ~F.isnan("ic"))


#: Lags that one pass over a series can hold; 4 (n/100)^(2/9) stays below for series of up to ten million rows.
LAGS = 52


def hac(df: DataFrame, series: list[str], order: str, x: str, max_lag: int | None = None, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Mean of each series with the Newey-West standard error, t and normal p; lag = max(1, floor(4 (n/100)^(2/9))) unless
    given. Columns in ``carry``, constant in a series, come along.

    One sorted pass per series: each deviation meets those up to LAGS rows before it in the same window, so rows are
    exchanged once and nothing is joined or repeated. A series that needs more lags is an error, not a shorter sum.
    """
    w = Window.partitionBy(*series)
    by = w.orderBy(order)
    rows = df.where(F.col(x).isNotNull()).select(*series, order, *carry, F.col(x).alias("__x"), F.count("*").over(w).alias("n"), F.avg(x).over(w).alias("mean"))
    lag = F.lit(max_lag) if max_lag is not None else F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, 2 / 9)).cast("int"))
    rows = rows.withColumns({"__d": F.col("__x") - F.col("mean"), "lag": F.least(lag, F.col("n").cast("int") - 1)})
    rows = rows.withColumn("__l", F.when(F.col("lag") > LAGS, F.raise_error(F.lit(f"a series needs more than {LAGS} lags"))).otherwise(F.col("lag")))
    bound, products = LAGS if max_lag is None else max_lag, F.col("__d") * F.col("__d")
    if bound:
        past = F.reverse(F.collect_list("__d").over(by.rowsBetween(-bound, -1)))  # the latest first
        near = F.transform(F.slice(past, F.lit(1), F.greatest(F.col("__l"), F.lit(0))), lambda e, k: 2 * (1 - (k + 1) / (F.col("__l") + 1)) * e)
        products = products + F.col("__d") * F.aggregate(near, F.lit(0.0), lambda s, e: s + e)
    out = rows.withColumn("__p", products).groupBy(*series).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("lag").alias("lag"), (F.sum("__p") / F.max("n")).alias("__v"), *[F.max(c).alias(c) for c in carry])
    se = F.sqrt(F.greatest("__v", F.lit(0.0)) / F.col("n"))
    t = F.when(se > 1e-15, F.col("mean") / se)
    return out.select(*series, *carry, "n", "mean", "lag", se.alias("se"), t.alias("t"), (2 * (1 - normal_cdf(F.abs(t)))).alias("p"))


def diebold_mariano(df: DataFrame, series: list[str], date: str, dl: str, horizon: int = 1) -> DataFrame:
    """(series, n, mean, se, dm, p): equal accuracy of two forecasts, from differences of their losses. Differences of a
    date are averaged first, as they are not independent; errors are Newey-West ones with horizon - 1 lags; the statistic
    has the small-sample factor and p comes from Student's t with n - 1 degrees of freedom. Null where the error is 0."""
    means = df.where(F.col(dl).isNotNull()).groupBy(*series, date).agg(F.avg(dl).alias("__dl"))
    h = hac(means, series, date, "__dl", max(0, horizon - 1))
    n = F.col("n")
    factor = F.sqrt(F.greatest((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n, F.lit(0.0)))
    dm = F.col("t") * factor
    return h.select(*series, "n", "mean", "se", dm.alias("dm"), student_p(dm, n - 1).alias("p"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, by a rational approximation of erf (error below 1.5e-7)."""
    z = F.abs(x) / 2**0.5
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def long_short(df: DataFrame, by: str, score: str, y: str, share: float = 0.2, per_leg: int = 1) -> DataFrame:
    """Mean of the top k less mean of the bottom k by score, k = max(1, floor(n share)); dates under 2 per_leg rows dropped."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    k = F.greatest(F.lit(1), F.floor(n * F.lit(share)))
    ranked = df.withColumns({"__n": n, "__k": k, "__up": F.row_number().over(w.orderBy(F.desc(score), "ticker")), "__down": F.row_number().over(w.orderBy(F.asc(score), F.desc("ticker")))})
    long, short = F.avg(F.when(F.col("__up") <= F.col("__k"), F.col(y))), F.avg(F.when(F.col("__down") <= F.col("__k"), F.col(y)))
    return ranked.where(F.col("__n") >= 2 * per_leg).groupBy(by).agg(long.alias("long"), short.alias("short"), (long - short).alias("spread"))


def net_cost(spreads: DataFrame, traded: DataFrame, date: str, bps: float, periods: int = 12) -> DataFrame:
    """One row on a strategy's returns (date, spread) and what it trades (date, traded, as a share of its value): n, mean and
    annual Sharpe gross and net of ``bps`` for each traded unit on its own date, the mean traded, all costs in basis points,
    and the drawdown and volatility of the gross returns. Dates without trading cost nothing."""
    rows = spreads.select(date, "spread").join(traded.select(date, "traded"), date, "left").withColumn("net", F.col("spread") - F.coalesce("traded", F.lit(0.0)) * bps / 1e4)
    w = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)  # a calendar
    rows = rows.withColumn("__c", F.product(1 + F.col("spread")).over(w))
    rows = rows.withColumn("__dd", F.col("__c") / F.greatest(F.max("__c").over(w), F.lit(1.0)) - 1)
    sharpe = lambda c: F.try_divide(F.avg(c) * periods**0.5, F.stddev_samp(c))
    return rows.agg(F.count("*").alias("n"), sharpe("spread").alias("gross_sharpe"), sharpe("net").alias("net_sharpe"), F.avg("traded").alias("avg_traded"), (F.sum(F.coalesce("traded", F.lit(0.0))) * bps).alias("cost_bps"), F.min("__dd").alias("drawdown"), (F.stddev_samp("spread") * periods**0.5).alias("vol"))


def risk_summary(df: DataFrame, series: list[str], order: str, r: str, periods: int = 12) -> DataFrame:
    """Annual return and volatility, Sharpe, Sortino, drawdown, Calmar, Omega (gains over losses), value at risk and expected
    shortfall per series."""
    w = Window.partitionBy(*series).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(r).isNotNull()).withColumn("__c", F.exp(F.sum(F.log(1 + F.col(r))).over(w)))
    rows = rows.withColumn("__dd", F.col("__c") / F.greatest(F.max("__c").over(w), F.lit(1.0)) - 1)
    cut = rows.groupBy(*series).agg(F.percentile(r, F.lit(0.05)).alias("__q"))
    rows = rows.join(cut, series)
    g = rows.groupBy(*series).agg(
        F.count("*").alias("n"), F.sum(F.log(1 + F.col(r))).alias("__l"), F.stddev_samp(r).alias("__sd"), F.avg(r).alias("__m"), F.min("__dd").alias("drawdown"),
        F.sqrt(F.avg(F.least(F.col(r), F.lit(0.0)) ** 2)).alias("__down"), F.max("__q").alias("var95"), F.avg(F.when(F.col(r) <= F.col("__q"), F.col(r))).alias("cvar95"),
        F.try_divide(F.sum(F.greatest(F.col(r), F.lit(0.0))), F.sum(F.greatest(-F.col(r), F.lit(0.0)))).alias("omega"),
    )
    annual = F.exp(F.col("__l") * periods / F.col("n")) - 1
    return g.select(
        *series, "n", annual.alias("annual"), (F.col("__sd") * periods**0.5).alias("vol"), F.try_divide(F.col("__m") * periods**0.5, F.col("__sd")).alias("sharpe"),
        F.try_divide(F.col("__m") * periods**0.5, F.col("__down")).alias("sortino"), "drawdown", F.try_divide(annual, F.abs("drawdown")).alias("calmar"), "omega", "var95", "cvar95",
    )




def text_hash(*cols: Column | str) -> Column:
    """A number from 0 to 2^32 that depends on the columns as text: the same in any engine that knows md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def normal_quantile(p: str) -> str:
    """SQL text of the standard normal quantile of the expression p, by a published rational approximation (error below
    1.2e-9); null outside (0, 1)."""
    # Coefficients of the approximation, for the tails and for the middle.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)

    def horner(ks: tuple, x: str, last: str = "") -> str:
        text = f"cast({ks[0]} as double)"
        for k in ks[1:]:
            text = f"({text} * {x} + cast({k} as double))"
        return f"({text} * {x} + 1)" if last else text

    def tail(q: str) -> str:
        x = f"sqrt(-2 * ln({q}))"
        return f"({horner(c, x)} / {horner(d, x, 'one')})"

    y = f"({p} - 0.5)"
    mid = f"({horner(a, f'({y} * {y})')} * {y} / {horner(b, f'({y} * {y})', 'one')})"
    return f"(case when {p} <= 0 or {p} >= 1 then null when {p} < 0.02425 then {tail(p)} when {p} > 1 - 0.02425 then -{tail(f'(1 - {p})')} else {mid} end)"


def bootstrap_means(df: DataFrame, series: list[str], order: str, x: str, n_boot: int = 200, block: int = 6, seed: int = 7, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Moving-block bootstrap: (series, replicate, mean), and columns in ``carry``, constant in a series. Starts come from
    hashes, so replicates need no driver state.

    A series meets its draws in the task that holds it, as an array of its numbers (8 bytes a row): only the rows given are
    exchanged, and replicates stay by series, so that what is grouped by series next needs no exchange either.
    """
    rows = df.where(F.col(x).isNotNull()).dropna(subset=series).select(*series, order, *carry, F.col(x).alias("__x"))
    # in the order of ``order``: nulls first, as windows have it
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), F.col("__x").alias("x")))), lambda r: r["x"])
    held = rows.groupBy(*series).agg(*[F.first(c).alias(c) for c in carry], ordered.alias("__x")).withColumn("__n", F.size("__x"))
    draws = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("__n") / block) - 1).cast("int"))).alias("__b"))
    start = F.pmod(text_hash(F.lit(seed), *series, "replicate", "__b"), F.greatest(F.col("__n") - block + 1, F.lit(1))).cast("int")
    draws = draws.select(*series, *carry, "replicate", "__x", "__n", "__b", start.alias("__s"))
    drawn = [F.when(F.col("__b") * block + o < F.col("__n"), F.get("__x", F.least(F.col("__s") + o, F.col("__n") - 1))).otherwise(0.0) for o in range(block)]
    total = drawn[0]
    for d in drawn[1:]:
        total = total + d
    sums = draws.select(*series, *carry, "replicate", "__n", total.alias("__t")).groupBy(*series, *carry, "replicate", "__n").agg(F.sum("__t").alias("__t"))
    return sums.select(*series, *carry, "replicate", (F.col("__t") / F.col("__n")).alias("mean"))


def stratified_f1(rows: DataFrame, stratum: str, gold: str, predicted: str, key: str, n_boot: int = 1000, seed: int = 13) -> DataFrame:
    """(stratum, low, mean, high, n, warning): a row ``macro`` with the mean F1 over strata and its 95 % bootstrap interval,
    and a row per stratum with its own F1, the rows that count in it (gold or predicted), and a warning: ``undefined``
    without such rows, ``tiny`` under 30.

    Only the three counts tp, fp, fn of a stratum matter to its F1. A resample of its n rows takes place numbers 0..n-1 by
    md5; rows stand in the order of ``key``, and a place falls to the cell whose row stands there. Every row makes one draw
    of each resample, so draws arise wherever the rows are dealt to; places are looked up in a merge join, as no side is
    small and what draws come to is not known before. Counts of cells are combined before the exchange. Undefined strata
    take no part in the macro mean.
    """
    both = rows.select(F.col(stratum).alias("stratum"), F.col(gold).alias("g"), F.col(predicted).alias("p"), F.col(key).alias("k"))
    cell = F.when(F.col("g") & F.col("p"), 0).when(F.col("p"), 1).otherwise(2)
    w = Window.partitionBy("stratum")
    cells = both.where("g or p").select("stratum", cell.alias("cell"), (F.row_number().over(w.orderBy("k")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    cells = stored(cells.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "f1-cells")
    draws = cells.select("stratum", "n", F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    draws = draws.select("stratum", "rep", F.pmod(text_hash(F.lit(seed), "stratum", "rep", "j"), F.col("n")).alias("i")).hint("merge")
    f1 = 2.0 * F.count_if(F.col("cell") == 0) / (F.count("*") + F.count_if(F.col("cell") == 0))
    macro = draws.join(cells.select("stratum", "i", "cell"), ["stratum", "i"]).groupBy("stratum", "rep").agg(f1.alias("f1")).groupBy("rep").agg(F.avg("f1").alias("f1"))
    q = F.percentile("f1", F.array(F.lit(0.025), F.lit(0.975)))  # of n_boot values
    top = macro.agg(F.lit("macro").alias("stratum"), F.round(q[0], 6).alias("low"), F.round(F.avg("f1"), 6).alias("mean"), F.round(q[1], 6).alias("high"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("warning"))
    n, tp = F.count_if(F.col("g") | F.col("p")), F.count_if(F.col("g") & F.col("p"))
    own = both.groupBy("stratum").agg(F.round(F.try_divide(2.0 * tp, n + tp), 6).alias("mean"), n.alias("n"))
    warn = F.when(F.col("n") == 0, "undefined").when(F.col("n") < 30, "tiny")
    null = F.lit(None).cast("double")
    return top.unionByName(own.select("stratum", null.alias("low"), "mean", null.alias("high"), "n", warn.alias("warning")))


def spillover_index(v, horizon: int = 10, max_lag: int = 2) -> float | None:
    """Total spillover of two series (rows, 2), in percent: a vector autoregression whose lag has the least information
    criterion, its generalised forecast error variance decomposition, and the share that comes from the other series."""
    import numpy as np

    def fit(p: int, drop: int):
        y = v[drop:]
        z = np.hstack([np.ones((len(y), 1)), *(v[drop - j : len(v) - j] for j in range(1, p + 1))])
        b = np.linalg.lstsq(z, y, rcond=None)[0]
        return b, y - z @ b

    if len(v) < 10 * max_lag + 10 or not np.isfinite(v).all():
        return None
    scores = {}
    for p in range(1, max_lag + 1):
        _, e = fit(p, max_lag)  # one sample for all lags
        scores[p] = np.linalg.slogdet(e.T @ e / len(e))[1] + 2 / len(e) * (4 * p + 2)
    p = min(scores, key=scores.get)
    b, e = fit(p, p)
    cov = e.T @ e / (len(e) - 2 * p - 1)
    if np.linalg.cond(cov) > 1e12:
        return None
    steps, num, den = [np.eye(2)], np.zeros((2, 2)), np.zeros(2)
    for h in range(1, horizon):
        steps.append(sum(b[1 + 2 * (j - 1) : 1 + 2 * j].T @ steps[h - j] for j in range(1, min(p, h) + 1)))
    for a in steps:
        num += (a @ cov) ** 2 / np.diag(cov)
        den += np.diag(a @ cov @ a.T)
    share = num / den[:, None]
    share /= share.sum(axis=1, keepdims=True)
    return float(100 * (share[0, 1] + share[1, 0]) / 2)


def rolling_spillover(pairs: DataFrame, window: int = 250, step: int = 21, horizon: int = 10, ends: int = 32) -> DataFrame:
    """(x, y, i, index) for every ``step``-th row i of pairs (x, y, i, rx, ry; i counts the rows of a pair from 0): the
    spillover of the ``window`` rows up to i. Rows are dealt to groups of ``ends`` windows, and to the next groups that
    reach back to them, so a group holds at most window + ends * step rows however long the series is."""
    span = ends * step
    rows = pairs.select("*", F.explode(F.sequence(F.floor(F.col("i") / span), F.floor((F.col("i") + window - 1) / span))).alias("__g"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i")
        at, v, g = pdf["i"].to_numpy(), pdf[["rx", "ry"]].to_numpy(float), int(pdf["__g"].iloc[0])
        out = []
        for end in range(max(g * span, window - 1), (g + 1) * span):
            if end % step == 0 and at[0] <= end - window + 1 and end <= at[-1]:
                lo = int(end - window + 1 - at[0])
                value = spillover_index(v[lo : lo + window], horizon)
                out.append((pdf["x"].iloc[0], pdf["y"].iloc[0], end, None if value is None else round(value, 6)))
        return pd.DataFrame(out, columns=["x", "y", "i", "index"])

    return rows.groupBy("x", "y", "__g").applyInPandas(run, "x string, y string, i long, index double")


def half_splits(df: DataFrame, block: str, n: int, key: str = "ticker", r: str = "ret", keys: int = 4096, masks: int = 256) -> DataFrame:
    """Per way to choose half of n blocks as the inside: the key with the best mean inside, its rank outside from the top
    (place) and from the bottom (low), and the number of keys (s).

    A key is a row of its sums and counts by block. Groups of about ``keys`` keys meet groups of ``masks`` ways, and each
    meeting is one product of a 0/1 matrix and the sums: a first round finds the best inside, a second counts the keys above
    and below it outside. A meeting emits a row a way, so nothing of the size keys x ways is dealt; the best keys, a row
    for each way, are broadcast for the second round. Keys without rows inside or outside do not count for that way; of
    equal means the least key is best.
    """
    import numpy as np

    ways = np.array([m for m in range(1 << n) if m.bit_count() == n // 2])
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    sums = df.groupBy(key, F.col(block).alias("__b")).agg(F.sum(r).alias("__s"), F.count("*").alias("__n"))
    at = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("__b") == i, F.col(c))), F.lit(0)).cast("double") for i in range(n)])
    rows = stored(sums.groupBy(key).agg(at("__s").alias("s"), at("__n").alias("c")), "split-sums")
    parts = max(1, -(-rows.count() // keys))
    dealt = rows.select("*", F.pmod(F.xxhash64(key), F.lit(parts)).alias("__k"), F.explode(F.sequence(F.lit(0), F.lit(-(-len(ways) // masks) - 1))).alias("__m"))

    def means(pdf):
        own = ways[int(pdf["__m"].iloc[0]) * masks :][:masks]
        inside = (own[:, None] >> np.arange(n) & 1).astype(float)
        s, c = (np.array(pdf[x].tolist(), float).T for x in ("s", "c"))
        with np.errstate(invalid="ignore", divide="ignore"):
            return own, (inside @ s) / (inside @ c), ((1 - inside) @ s) / ((1 - inside) @ c)

    def best(pdf):
        import pandas as pd

        pdf = pdf.sort_values(key)
        own, ins, oos = means(pdf)
        ok = np.isfinite(ins) & np.isfinite(oos)
        first, line = np.where(ok, ins, -np.inf).argmax(1), np.arange(len(own))
        return pd.DataFrame({"mask": own, key: pdf[key].to_numpy()[first], "ins": ins[line, first], "oos": oos[line, first]})[ok.any(1)]

    found = dealt.groupBy("__k", "__m").applyInPandas(best, f"mask int, `{key}` {kind}, ins double, oos double")
    found = stored(found.groupBy("mask").agg(F.min_by(F.struct(key, "ins", "oos"), F.struct((-F.col("ins")).alias("i"), F.col(key).alias("k"))).alias("u")).select("mask", "u.*"), "split-best")
    chosen = spark.sparkContext.broadcast({x["mask"]: x["oos"] for x in found.select("mask", "oos").collect()})  # a row for each way

    def ranks(pdf):
        import pandas as pd

        own, ins, oos = means(pdf)
        mark = np.array([chosen.value.get(int(m), np.nan) for m in own])[:, None]
        ok = np.isfinite(ins) & np.isfinite(oos)
        return pd.DataFrame({"mask": own, "above": (ok & (oos > mark)).sum(1), "below": (ok & (oos < mark)).sum(1), "s": ok.sum(1)})

    counts = dealt.groupBy("__k", "__m").applyInPandas(ranks, "mask int, above long, below long, s long").groupBy("mask").agg((F.sum("above") + 1).alias("place"), (F.sum("below") + 1).alias("low"), F.sum("s").alias("s"))
    return found.join(counts, "mask")


def event_study(returns: DataFrame, events: DataFrame, sessions: DataFrame, before: int = 10, after: int = 20) -> DataFrame:
    """Mean cumulative abnormal return by event type and offset, with its 95 % interval; events with an incomplete window
    are dropped.

    returns: (date, ticker, ab), a row per date and ticker; events: (event_id, event_type, ticker, date on a session), a row
    per event; sessions: (date, idx).

    All events of a ticker on a session share one path: it is made once, from the rows around, and weighed by the number of
    events of each type. Returns and events go to their ticker's task in one exchange, an event as one row.
    """
    at = F.broadcast(sessions)
    rows = returns.where("ab is not null").join(at, "date").select("ticker", "idx", F.lit(False).alias("__e"), F.lit(None).cast("string").alias("event_type"), "ab")
    events = events.where("ticker is not null").join(at, "date").select("ticker", "idx", F.lit(True).alias("__e"), "event_type", F.lit(None).cast("double").alias("ab"))
    by_type = rows.unionByName(events).repartition("ticker").groupBy("ticker", "idx", "__e", "event_type").agg(F.count("*").alias("__c"), F.max("ab").alias("ab"))
    types = F.collect_list(F.when(F.col("__e"), F.struct("event_type", "__c"))).alias("__types")
    days = by_type.groupBy("ticker", "idx").agg(F.max("ab").alias("ab"), types).where("ab is not null")
    w = Window.partitionBy("ticker").orderBy("idx")
    # a ticker has a row a session at most, so a window is whole if its ends stand where they should
    days = days.withColumns({"__lo": F.lag("idx", before).over(w), "__hi": F.lead("idx", after).over(w), "__ab": F.collect_list("ab").over(w.rowsBetween(-before, after))})
    whole = days.where((F.col("__lo") == F.col("idx") - before) & (F.col("__hi") == F.col("idx") + after) & (F.size("__types") > 0))
    upto = F.aggregate("__ab", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)))
    cars = whole.select("__types", F.posexplode(upto).alias("__k", "car")).select("__k", "car", F.inline("__types"))
    x, c = F.col("car"), F.col("__c")
    g = cars.groupBy("event_type", (F.col("__k") - before).alias("offset")).agg(F.sum("__c").alias("n"), F.sum(c * x).alias("__s"), F.sum(c * x * x).alias("__q"))
    g = g.withColumn("mean", F.col("__s") / F.col("n"))
    g = g.withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("__q") - F.col("__s") * F.col("mean"), F.lit(0.0)) / (F.col("n") - 1))))
    g = g.drop("__s", "__q").withColumn("se", F.col("sd") / F.sqrt("n"))
    return g.withColumns({"low": F.col("mean") - 1.96 * F.col("se"), "high": F.col("mean") + 1.96 * F.col("se")})
