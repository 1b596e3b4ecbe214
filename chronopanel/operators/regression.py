"""Regressions on any number of factors, of many series at once, from moments that Spark sums."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inference import hac, normal_cdf
from .rolling import rolling_sums


def _solved(moments: DataFrame, k: int, least: int, tolerance: float) -> DataFrame:
    """moments (..., n, __my, __syy, __m array of k, __s array of k x k, __c array of k) with b (array), a, r2 and __inv (the
    inverse as an array of k x k). Rows are one regression each; batches of them are factored together by Cholesky."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in moments.schema)}, a double, b array<double>, r2 double, __inv array<double>"

    def run(frames):
        import numpy as np

        for f in frames:
            m, s, c = (np.array(f[x].tolist(), float).reshape(len(f), -1) for x in ("__m", "__s", "__c"))
            s = s.reshape(-1, k, k)
            scale = np.sqrt(np.maximum(np.diagonal(s, axis1=1, axis2=2), 0))
            good = (f["n"].to_numpy() >= least) & (scale > 0).all(1) if len(f) else np.zeros(0, bool)
            unit = np.where(scale > 0, scale, 1.0)
            corr = s / unit[:, :, None] / unit[:, None, :]
            good &= np.linalg.eigvalsh(np.where(good[:, None, None], corr, np.eye(k)))[:, 0] > tolerance
            lower = np.linalg.cholesky(np.where(good[:, None, None], corr, np.eye(k)))
            half = np.linalg.inv(lower)
            inv = np.swapaxes(half, 1, 2) @ half / unit[:, :, None] / unit[:, None, :]
            b = (inv @ c[:, :, None])[:, :, 0]
            a = f["__my"].to_numpy(float) - (b * m).sum(1)
            syy = f["__syy"].to_numpy(float)
            r2 = np.where(syy > 0, (b * c).sum(1) / np.where(syy > 0, syy, 1), np.nan)
            pick = lambda v: [x if g else None for x, g in zip(v, good, strict=True)]
            yield f.assign(a=pick(a.tolist()), b=pick(b.tolist()), r2=pick([None if np.isnan(x) else x for x in r2.tolist()]), __inv=pick(inv.reshape(-1, k * k).tolist()))

    return moments.mapInPandas(run, schema)


def _known(df: DataFrame, y: str, xs: list[str]) -> Column:
    ok = F.lit(True)
    for c in (y, *xs):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def fit_moments(df: DataFrame, series: list[str], y: str, xs: list[str], least: int | None = None, tolerance: float = 1e-10) -> DataFrame:
    """Least squares of y on xs and a constant, per series: (series, n, a, b, r2, __m, __inv). Moments are aggregates that
    Spark combines, centered as it goes; only k x k numbers a series reach the solver. Null a and b where there are fewer
    than ``least`` rows (default: k + 2) or the factors do not differ enough (least eigenvalue of their correlations)."""
    k = len(xs)
    pairs = {(i, j): F.covar_pop(xs[i], xs[j]) for i, j in combinations_with_replacement(range(k), 2)}
    square = F.array(*[pairs[min(i, j), max(i, j)] for i in range(k) for j in range(k)])
    moments = df.where(_known(df, y, xs)).groupBy(*series).agg(
        F.count("*").alias("n"), F.avg(y).alias("__my"), F.var_pop(y).alias("__syy"), F.array(*[F.avg(x) for x in xs]).alias("__m"), square.alias("__s"), F.array(*[F.covar_pop(x, y) for x in xs]).alias("__c")
    )
    return _solved(moments, k, k + 2 if least is None else least, tolerance).drop("__my", "__syy", "__s", "__c")


def factor_regression(df: DataFrame, series: list[str], order: str, y: str, xs: list[str], max_lag: int | None = None, least: int | None = None) -> DataFrame:
    """y on the factors xs and a constant per series, with Newey-West errors: (series, coef, value, se, t, p, n, lag, r2), a
    row for ``alpha`` and for each factor by name.

    A coefficient is its true value plus a weighted sum of the errors, so its robust variance is that of the mean of one
    series of such terms: k + 1 short series a regression go through hac(), however many regressions there are.
    """
    k = len(xs)
    fits = fit_moments(df, series, y, xs, least).where("a is not null")
    known = df.where(_known(df, y, xs)).select(*series, order, F.col(y).cast("double").alias("__y"), F.array(*[F.col(x).cast("double") for x in xs]).alias("__x"))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    rows = known.join(fits, series)
    rows = rows.withColumns({"__u": F.col("__y") - F.col("a") - dot(F.col("b"), F.col("__x")), "__d": F.zip_with("__x", "__m", lambda p, q: p - q)})
    rows = rows.withColumn("__w", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: dot(F.slice("__inv", i * k + 1, F.lit(k)), F.col("__d"))))
    terms = [F.struct(F.lit("alpha").alias("coef"), F.col("a").alias("value"), (F.col("__u") * (1 - dot(F.col("__m"), F.col("__w")))).alias("z"))]
    terms += [F.struct(F.lit(x).alias("coef"), F.col("b")[i].alias("value"), (F.col("__u") * F.col("__w")[i]).alias("z")) for i, x in enumerate(xs)]
    long = rows.select(*series, order, "r2", F.explode(F.array(*terms)).alias("__t")).select(*series, order, "r2", "__t.*")
    errors = hac(long, [*series, "coef"], order, "z", max_lag, carry=["value", "r2"])
    t = F.when(F.col("se") > 1e-300, F.col("value") / F.col("se"))
    return errors.select(*series, "coef", "value", "se", t.alias("t"), (2 * (1 - normal_cdf(F.abs(t)))).alias("p"), "n", "lag", "r2")


def rolling_exposures(df: DataFrame, y: str, xs: list[str], window: int, least: int, ends: DataFrame, key: str = "ticker", order: str = "date", tolerance: float = 1e-9) -> DataFrame:
    """(order, key, n, b): the coefficients of y on xs over the last ``window`` rows of the key, at the rows whose order is
    in ``ends``; null with fewer than ``least`` known rows or factors too alike.

    Sums of all products run through one sorted pass per key and are differences of running totals, so the work is rows
    times products whatever the window. Values are shifted by the key's first known row, so that totals stay small.
    """
    k, ok = len(xs), _known(df, y, xs)
    w = Window.partitionBy(key)
    shift = {c: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col(order))).over(w) for c in (y, *xs)}
    moved = df.withColumns({f"__v{i}": F.when(ok, F.col(c).cast("double") - shift[c]) for i, c in enumerate((*xs, y))})
    pairs = list(combinations_with_replacement(range(k + 1), 2))
    terms = {"n": F.when(ok, F.lit(1))} | {f"s{i}": F.col(f"__v{i}") for i in range(k + 1)} | {f"p{i}_{j}": F.col(f"__v{i}") * F.col(f"__v{j}") for i, j in pairs}
    sums = rolling_sums(moved, window, key, order, **{f"__{t}": c for t, c in terms.items()}).join(F.broadcast(ends), order, "left_semi")  # a calendar
    n = F.nullif(F.col("__n"), F.lit(0.0))
    cov = {(i, j): F.coalesce(F.col(f"__p{i}_{j}") / n - F.col(f"__s{i}") / n * F.col(f"__s{j}") / n, F.lit(0.0)) for i, j in pairs}
    square = F.array(*[cov[min(i, j), max(i, j)] for i in range(k) for j in range(k)])
    zero = F.array(*[F.lit(0.0)] * k)  # means are not needed
    moments = sums.select(order, key, F.col("__n").cast("long").alias("n"), F.lit(0.0).alias("__my"), F.lit(0.0).alias("__syy"), zero.alias("__m"), square.alias("__s"), F.array(*[cov[i, k] for i in range(k)]).alias("__c"))
    return _solved(moments, k, least, tolerance).select(order, key, "n", "b")


def lagged_surprises(df: DataFrame, key: str, order: str, x: str, window: int = 21, lags: int = 5, clip: float = 5.0, ends: int = 2048) -> DataFrame:
    """(key, order, residual, surprise): one-step errors of a rolling autoregression of x on its ``lags`` last values, fitted
    on the ``window`` rows before, and the same in units of the deviation of the ``window`` errors before (at least half of
    them known), clipped. Null until the window is full, and where it or the row has a gap.

    The running fits share their products: a row's vector of lags and its square enter when it comes into the window and
    leave when it goes. Rows are dealt to groups of ``ends``, each with the rows before it that its windows reach, so that a
    group is bounded however long the series; the fits of a group are solved as one batch.
    """
    kinds = dict(df.dtypes)
    by = Window.partitionBy(key).orderBy(order)
    reach = window + lags
    rows = df.select(key, order, F.col(x).cast("double").alias("__x"), (F.row_number().over(by) - 1).alias("__i"))
    rows = rows.select("*", F.explode(F.sequence(F.floor(F.col("__i") / ends), F.floor((F.col("__i") + reach) / ends))).alias("__g"))

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("__i")
        v, at = pdf["__x"].to_numpy(float), pdf["__i"].to_numpy()
        n, own, out = len(v), at >= pdf["__g"].iloc[0] * ends, np.full(len(v), np.nan)
        if n > reach:
            lagged = np.lib.stride_tricks.sliding_window_view(v, lags + 1)  # row i ends at v[i + lags]
            design, y = np.c_[np.ones(len(lagged)), lagged[:, -2::-1]], lagged[:, -1]
            known = np.isfinite(lagged).all(1)
            shift = np.where(known.any(), np.nanmean(np.where(np.isfinite(v), v, np.nan)), 0.0)
            design[:, 1:] -= shift
            target = y - shift
            d, t = np.where(known[:, None], design, 0), np.where(known, target, 0)
            both = np.einsum("ni,nj->nij", d, np.c_[d, t])
            size = lags + 1
            total = np.lib.stride_tricks.sliding_window_view(both, window, axis=0).sum(-1)[:-1]  # of the rows before each
            full = np.lib.stride_tricks.sliding_window_view(known, window).all(-1)[:-1] & known[window:]
            gram, moment = total[:, :, :size], total[:, :, size]
            beta = np.zeros((len(total), size))
            if full.any():
                beta[full] = np.einsum("nij,nj->ni", np.linalg.pinv(gram[full], rcond=1e-13, hermitian=True), moment[full])
            out[reach:] = np.where(full, target[window:] - (design[window:] * beta).sum(1), np.nan)
        return pdf[[key, order]].assign(residual=[None if np.isnan(o) else o for o in out], own=own)[own].drop(columns="own")

    found = rows.groupBy(key, "__g").applyInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, residual double")
    before = by.rowsBetween(-window, -1)
    scale = F.when(F.count("residual").over(before) >= max(lags + 2, window // 2), F.stddev_samp("residual").over(before))
    z = F.when(scale > 1e-12, F.col("residual") / scale)
    return found.select(key, order, "residual", F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))).alias("surprise"))
