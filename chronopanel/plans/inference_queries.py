"""Queries that evaluate scores: rank IC, robust means, costs, risk, event studies, multiple testing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.special import student_p_sql
from ..operators import inference as I
from ..operators import regression as G
from ..operators import rolling as R
from ..operators.asof import asof_join
from ..shared import stored
from .price_queries import labelled, returns
from .registry import query


def monthly_ic(spark, d) -> DataFrame:
    return I.rank_ic(labelled(spark, d), ["month"], "score", "y")


def erf_p(t: str) -> str:
    z = f"(abs({t}) / sqrt(2))"
    k = f"(1 / (1 + 0.3275911 * {z}))"
    return f"(1 - (1 - {k} * (0.254829592 + {k} * (-0.284496736 + {k} * (1.421413741 + {k} * (-1.453152027 + {k} * 1.061405429)))) * exp(-{z} * {z})))"


def hac_ctes(src: str, series: str, order: str, x: str, lag: str = "greatest(1, cast(floor(4 * pow(n / 100.0, 2.0 / 9)) as int))") -> dict[str, str]:
    """CTEs hs (rows), hl (series, n, mean, lag, se, t)."""
    return {
        "hs": f"select {series} as sid, {x} as x, row_number() over (partition by {series} order by {order}) as i, count(*) over (partition by {series}) as n, avg({x}) over (partition by {series}) as mean from {src} where {x} is not null",
        "hk": f"select *, least({lag}, cast(n as int) - 1) as lag from hs",
        "hl": "select sid, n, mean, lag, sqrt(greatest(v, 0) / n) as se, case when sqrt(greatest(v, 0) / n) > 1e-15 then mean / sqrt(greatest(v, 0) / n) end as t from (select a.sid, max(a.n) as n, max(a.mean) as mean, max(a.lag) as lag, sum((case when b.i = a.i then 1.0 else 2 * (1 - (b.i - a.i) / (a.lag + 1.0)) end) * (a.x - a.mean) * (b.x - b.mean)) / max(a.n) as v from hk a join hk b on a.sid = b.sid and b.i between a.i and a.i + a.lag group by 1)",
    }


@query("select month, round(ic, 6) as ic from ic where ic is not null and not isnan(ic)")
def l01_rank_ic(spark, d):
    return monthly_ic(spark, d).select("month", F.round("ic", 6).alias("ic"))


@query(f"select n, cast(lag as int) as lag, round(mean, 6) as mean, round(se, 6) as se, round(t, 5) as t, round({erf_p('t')}, 5) as p, round(mean - 1.96 * se, 6) as low, round(mean + 1.96 * se, 6) as high, abs(mean) > 1.96 * se as publishable from hl", hac_ctes("ic", "1", "month", "ic"))
def l02_ic_summary(spark, d):
    """Mean rank IC with its robust error, its 95 % interval, and whether that leaves out zero."""
    h = I.hac(monthly_ic(spark, d).withColumn("sid", F.lit(1)), ["sid"], "month", "ic")
    half = 1.96 * F.col("se")
    ends = [F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"), (F.abs("mean") > half).alias("publishable")]
    return h.select("n", "lag", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 5).alias("t"), F.round("p", 5).alias("p"), *ends)


RETS_M = "select date, ticker, close / lag(close) over (partition by ticker order by date) - 1 as ret from prices_monthly"


def monthly_returns(spark, d) -> DataFrame:
    return A.prices_monthly(spark, d).select("date", "ticker", R.simple_return().alias("ret"))


LOSS = "select ticker, date, abs(ret) - abs(ret - lagged) as dl from (select *, lag(ret) over (partition by ticker order by date) as lagged from retsm)"


DM_STAT = "(t * sqrt((n + 1 - 2 * 3 + 3 * 2 / n::double) / n))"


@query(f"select sid as ticker, n, round(mean, 6) as mean, round(se, 6) as se, round({DM_STAT}, 5) as dm, round({student_p_sql(DM_STAT, '(n - 1)')}, 5) as p from hl", {"retsm": RETS_M, "loss": LOSS} | hac_ctes("loss", "ticker", "date", "dl", "2"))
def l03_diebold_mariano(spark, d):
    """Loss of no forecast against the last return, per ticker, three steps ahead: two lags, the small-sample factor, and p
    from Student's t with n - 1 degrees of freedom."""
    r = monthly_returns(spark, d).withColumn("dl", F.abs("ret") - F.abs(F.col("ret") - F.lag("ret").over(R.by_ticker())))
    h = I.diebold_mariano(r, ["ticker"], "date", "dl", 3)
    return h.select("ticker", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("dm", 5).alias("dm"), F.round("p", 5).alias("p"))


def boot_ctes(src: str, series: str, order: str, x: str) -> dict[str, str]:
    """CTEs bx (numbered rows) and boots (sid, rep, mean): 200 replicates of blocks of 6, starts from md5."""
    start = "('0x' || substr(md5('7|' || sid || '|' || rep || '|' || b), 1, 8))::bigint % greatest(n - 6 + 1, 1)"
    return {
        "bx": f"select {series} as sid, {x} as x, row_number() over (partition by {series} order by {order}) - 1 as i, count(*) over (partition by {series}) as n from {src} where {x} is not null",
        "bs": f"select sid, n, rep, b, {start} as s from (select sid, n, rep, unnest(range(cast(ceil(n / 6) as bigint))) as b from (select distinct sid, n from bx), (select unnest(range(200)) as rep))",
        "boots": "select d.sid, d.rep, avg(x.x) as mean from (select sid, n, rep, least(s + o, n - 1) as i from bs, (select unnest(range(6)) as o) where b * 6 + o < n) d join bx x on x.sid = d.sid and x.i = d.i group by 1, 2",
    }


@query("select sid as ticker, round(avg((abs(mean - m) >= abs(m))::int), 6) as p from boots join (select ticker, avg(ret) as m from retsm group by 1) on ticker = sid group by 1", {"retsm": RETS_M} | boot_ctes("retsm", "ticker", "date", "ret"))
def l04_block_bootstrap_dm(spark, d):
    """Share of replicate means as far from the mean as the mean is from zero."""
    r = monthly_returns(spark, d).withColumn("m", F.avg("ret").over(Window.partitionBy("ticker")))
    means = I.bootstrap_means(r, ["ticker"], "date", "ret", carry=["m"])
    return means.groupBy("ticker").agg(F.round(F.avg((F.abs(F.col("mean") - F.col("m")) >= F.abs("m")).cast("int")), 6).alias("p"))


@query("select sid as ticker, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high from boots group by 1", {"retsm": RETS_M} | boot_ctes("retsm", "ticker", "date", "ret"))
def l05_bootstrap_interval(spark, d):
    means = I.bootstrap_means(monthly_returns(spark, d), ["ticker"], "date", "ret")
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy("ticker").agg(F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"))


GOLD_ROWS = "select doc_id, lang, quality = 1 as gold, case when n_chars >= 300 then source <> 'src0' end as predicted from labels join documents using (doc_id)"
STRATA = {
    "f1rows": "select lang, case when gold and predicted then 0 when predicted then 1 else 2 end as cell, doc_id from goldrows where predicted is not null and (gold or predicted)",
    "f1cells": "select lang, cell, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n from f1rows",
    "f1draws": "select lang, rep, j, ('0x' || substr(md5('13|' || lang || '|' || rep || '|' || j), 1, 8))::bigint % n as i from (select lang, any_value(n) as n from f1cells group by 1), (select unnest(range(200)) as rep), (select unnest(range((select max(n) from f1cells))) as j) where j < n",
    "f1reps": "select rep, avg(f1) as f1 from (select lang, rep, 2.0 * count(*) filter (cell = 0) / (count(*) + count(*) filter (cell = 0)) as f1 from f1draws join f1cells using (lang, i) group by 1, 2) group by 1",
}


@query("select 'macro' as stratum, round(quantile_cont(f1, 0.025), 6) as low, round(avg(f1), 6) as mean, round(quantile_cont(f1, 0.975), 6) as high, null::bigint as n, null as warning from f1reps union all select lang, null, round(2.0 * count(*) filter (gold and predicted) / nullif(count(*) filter (gold and predicted) * 2 + count(*) filter (gold <> predicted), 0), 6), null, count(*) filter (gold or predicted), case when count(*) = 0 then 'empty' when count(*) filter (gold or predicted) = 0 then 'undefined' when count(*) filter (gold or predicted) < 30 then 'tiny' end from (select lang, gold, coalesce(predicted, false) as predicted, predicted is not null as known from goldrows) where known group by lang", {"goldrows": GOLD_ROWS} | STRATA)
def l06_stratified_f1(spark, d):
    """Bootstrap of macro F1: 200 resamples of the rows of every stratum, drawn by md5, the mean of their F1 and its 95 %
    interval; per stratum its own F1 and a warning where it has no rows, no defined F1, or fewer than 30 rows that count."""
    from .aggregate_queries import gold_rows

    rows = gold_rows(spark, d).where("predicted is not null")
    return I.stratified_f1(rows, "lang", "gold", "predicted", "doc_id", 200, 13)


@query("select ticker, round(avg(((ret > 0) = (lagged > 0))::int), 6) as accuracy, round(avg((ret > 0)::int), 6) as up, round(avg(abs(ret - lagged)), 6) as mae, round(avg((ret - lagged) * (ret - lagged)), 6) as mse from (select *, lag(ret) over (partition by ticker order by date) as lagged from retsm) where lagged is not null and ret is not null group by 1", {"retsm": RETS_M})
def l07_forecast_errors(spark, d):
    r = monthly_returns(spark, d).withColumn("lagged", F.lag("ret").over(R.by_ticker())).where("lagged is not null and ret is not null")
    e = F.col("ret") - F.col("lagged")
    return r.groupBy("ticker").agg(F.round(F.avg(((F.col("ret") > 0) == (F.col("lagged") > 0)).cast("int")), 6).alias("accuracy"), F.round(F.avg((F.col("ret") > 0).cast("int")), 6).alias("up"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e * e), 6).alias("mse"))


FWDM = "select * from (select *, lead(close) over (partition by ticker order by date) / close - 1 as r from prices_monthly) where r is not null"
LEGS = "select date, avg(r) filter (up <= k) as long, avg(r) filter (down <= k) as short from (select *, greatest(1, floor(count(*) over (partition by date) * 0.2)) as k, count(*) over (partition by date) as n, row_number() over (partition by date order by close desc, ticker) as up, row_number() over (partition by date order by close, ticker desc) as down from fwdm) where n >= 2 group by 1"


def monthly_panel(spark, d) -> DataFrame:
    return A.prices_monthly(spark, d).withColumn("r", R.forward_return(1)).where("r is not null")


@query("select date, round(long, 6) as long, round(short, 6) as short, round(long - short, 6) as spread from legs", {"fwdm": FWDM, "legs": LEGS})
def l08_long_short(spark, d):
    s = I.long_short(monthly_panel(spark, d), "date", "close", "r")
    return s.select("date", *[F.round(c, 6).alias(c) for c in ("long", "short", "spread")])


WEIGHTS = "select date, ticker, case when rn <= k then 1.0 / k else 0.0 end as w from (select *, greatest(1, floor(count(*) over (partition by date) * 0.2)) as k, row_number() over (partition by date order by close desc, ticker) as rn from prices_monthly)"
TURN = "select date, sum(abs(w - coalesce(p, 0))) / 2 as turnover from (select *, lag(w) over (partition by ticker order by date) as p from (select m.date, t.ticker, coalesce(x.w, 0) as w from (select distinct date from prices_monthly) m cross join (select distinct ticker from prices_monthly) t left join weights x on x.date = m.date and x.ticker = t.ticker)) group by 1"


def turnover(spark, d) -> DataFrame:
    """One-way turnover of an equal-weight top fifth."""
    p = A.prices_monthly(spark, d)
    w = Window.partitionBy("date")
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * 0.2))
    held = p.withColumns({"k": k, "rn": F.row_number().over(w.orderBy(F.desc("close"), "ticker"))}).select("date", "ticker", F.when(F.col("rn") <= F.col("k"), 1 / F.col("k")).otherwise(0.0).alias("w"))
    full = R.dense_grid(held).withColumn("w", F.coalesce("w", F.lit(0.0)))
    change = F.abs(F.col("w") - F.coalesce(F.lag("w").over(R.by_ticker()), F.lit(0.0)))
    return full.withColumn("c", change).groupBy("date").agg((F.sum("c") / 2).alias("turnover"))


@query("select date, round(turnover, 6) as turnover, round(turnover * 10 / 10000, 8) as cost from turn", {"weights": WEIGHTS, "turn": TURN})
def l09_turnover_cost(spark, d):
    return turnover(spark, d).select("date", F.round("turnover", 6).alias("turnover"), F.round(F.col("turnover") * 10 / 10000, 8).alias("cost"))


BOTH_LEGS = "select date, ticker, case when up <= k then 1.0 / k else 0.0 end - case when down <= k then 1.0 / k else 0.0 end as w from (select *, greatest(1, floor(count(*) over (partition by date) * 0.2)) as k, row_number() over (partition by date order by close desc, ticker) as up, row_number() over (partition by date order by close, ticker desc) as down from fwdm)"
TRADED = "select date, sum(abs(w - coalesce(p, 0))) as traded from (select *, lag(w) over (partition by ticker order by date) as p from (select m.date, t.ticker, coalesce(x.w, 0) as w from (select distinct date from fwdm) m cross join (select distinct ticker from fwdm) t left join both_legs x on x.date = m.date and x.ticker = t.ticker)) group by 1"


@query("select count(*) as n, round(avg(s) * sqrt(12) / stddev_samp(s), 5) as gross_sharpe, round(avg(net) * sqrt(12) / stddev_samp(net), 5) as net_sharpe, round(avg(traded), 6) as avg_traded, round(sum(traded) * 5, 4) as cost_bps, round(min(c / greatest(m, 1) - 1), 6) as drawdown, round(stddev_samp(s) * sqrt(12), 6) as vol from (select *, max(c) over (order by date) as m from (select date, long - short as s, traded, long - short - traded * 5 / 10000 as net, product(1 + long - short) over (order by date) as c from legs join traded using (date)))", {"fwdm": FWDM, "legs": LEGS, "both_legs": BOTH_LEGS, "traded": TRADED})
def l09_net_cost(spark, d):
    """A long-short strategy by price, gross and net of five basis points on all that it trades at each rebalance."""
    p = monthly_panel(spark, d)
    w = Window.partitionBy("date")
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * 0.2))
    held = p.withColumns({"k": k, "up": F.row_number().over(w.orderBy(F.desc("close"), "ticker")), "down": F.row_number().over(w.orderBy("close", F.desc("ticker")))})
    leg = lambda c: F.when(F.col(c) <= F.col("k"), 1 / F.col("k")).otherwise(0.0)
    full = R.dense_grid(held.select("date", "ticker", (leg("up") - leg("down")).alias("w"))).withColumn("w", F.coalesce("w", F.lit(0.0)))
    traded = full.withColumn("c", F.abs(F.col("w") - F.coalesce(F.lag("w").over(R.by_ticker()), F.lit(0.0)))).groupBy("date").agg(F.sum("c").alias("traded"))
    out = I.net_cost(I.long_short(p, "date", "close", "r"), traded, "date", 5.0)
    return out.select("n", F.round("gross_sharpe", 5).alias("gross_sharpe"), F.round("net_sharpe", 5).alias("net_sharpe"), F.round("avg_traded", 6).alias("avg_traded"), F.round("cost_bps", 4).alias("cost_bps"), F.round("drawdown", 6).alias("drawdown"), F.round("vol", 6).alias("vol"))


RISK = "select ticker, date, ret, c, c / greatest(max(c) over (partition by ticker order by date), 1) - 1 as dd from (select *, exp(sum(ln(1 + ret)) over (partition by ticker order by date)) as c from retsm where ret is not null)"


@query("select ticker, n, round(exp(l * 12 / n) - 1, 6) as annual, round(sd * sqrt(12), 6) as vol, round(m * sqrt(12) / sd, 6) as sharpe, round(m * sqrt(12) / dn, 6) as sortino, round(dd, 6) as drawdown, round((exp(l * 12 / n) - 1) / abs(dd), 6) as calmar, round(omega, 6) as omega, round(q, 6) as var95, round(cv, 6) as cvar95 from (select ticker, count(*) as n, sum(ln(1 + ret)) as l, stddev_samp(ret) as sd, avg(ret) as m, min(dd) as dd, sqrt(avg(pow(least(ret, 0), 2))) as dn, max(q) as q, avg(ret) filter (ret <= q) as cv, sum(greatest(ret, 0)) / sum(greatest(-ret, 0)) as omega from risk join (select ticker, quantile_cont(ret, 0.05) as q from risk group by 1) using (ticker) group by 1)", {"retsm": RETS_M, "risk": RISK})
def l10_risk_summary(spark, d):
    s = I.risk_summary(monthly_returns(spark, d), ["ticker"], "date", "ret")
    return s.select("ticker", "n", *[F.round(c, 6).alias(c) for c in ("annual", "vol", "sharpe", "sortino", "drawdown", "calmar", "omega", "var95", "cvar95")])


def trial_hurdles() -> dict[int, float]:
    """Expected largest of n standard normals, for each number of trials."""
    import math
    from statistics import NormalDist

    z, g = NormalDist().inv_cdf, 0.5772156649015329
    return {n: 0.0 if n == 1 else (1 - g) * z(1 - 1 / n) + g * z(1 - 1 / (n * math.e)) for n in (1, 2, 5, 20)}


def cdf_sql(x: str) -> str:
    return f"(case when {x} >= 0 then 1 - {erf_p(x)} / 2 else {erf_p(x)} / 2 end)"


MOMENTS = "select *, (m3 - 3 * m * m2 + 2 * m * m * m) / pow(sp, 3) * sqrt(n * (n - 1.0)) / (n - 2) as skew, (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / pow(sp, 4) - 3 * (n - 1)) + 3 as kurtosis, m / sd as sharpe from (select ticker, count(ret) as n, avg(ret) as m, stddev_samp(ret) as sd, stddev_pop(ret) as sp, avg(ret * ret) as m2, avg(ret * ret * ret) as m3, avg(ret * ret * ret * ret) as m4 from retsm where ret is not null group by 1)"
SHARPES = "select t.*, trials, hurdle * sqrt(1.0 / (n - 1)) as expected_max, sqrt(var / (n - 1)) as se from (select *, 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe as var from moments where n >= 4 and sd >= 1e-6) t, (values " + ", ".join(f"({n}, cast({h!r} as double))" for n, h in trial_hurdles().items()) + ") h(trials, hurdle) where var > 0"
BONF = f"least(1, trials * (1 - {cdf_sql('(sharpe / se)')}))"


@query(f"select ticker, n, trials, round(sharpe, 6) as sharpe, round(skew, 5) as skew, round(kurtosis, 5) as kurtosis, round(expected_max, 6) as expected_max, round({cdf_sql('((sharpe - expected_max) / se)')}, 5) as deflated, case when sharpe > 0 then round(1 + var * 2.705543454095404 / (sharpe * sharpe), 2) end as min_track, case when sharpe > 0 then round(p, 5) end as p_bonferroni, case when sharpe > 0 then round({I.normal_quantile('(1 - p)')} * se, 4) end as haircut from (select *, {BONF} as p from sharpes)", {"retsm": RETS_M, "moments": MOMENTS, "sharpes": SHARPES})
def l11_sharpe_moments(spark, d):
    """Sharpe ratio with its moments; per number of trials: the largest to expect by chance, the deflated probability,
    and for positive ones the track record needed at 95 %, and the p-value and the ratio after a Bonferroni haircut."""
    n, s = F.col("n"), F.col("sharpe")
    g = monthly_returns(spark, d).where("ret is not null").groupBy("ticker").agg(F.count("ret").alias("n"), (F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"))
    g = g.where("n >= 4 and sd >= 1e-6").withColumns({"skew": F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2), "kurtosis": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6) + 3})
    g = g.withColumn("var", 1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s).where("var > 0").withColumn("se", F.sqrt(F.col("var") / (n - 1)))
    g = g.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("trials"), F.lit(h).alias("hurdle")) for k, h in trial_hurdles().items()])).alias("t")).withColumns({"trials": F.col("t.trials"), "expected_max": F.col("t.hurdle") * F.sqrt(1 / (n - 1))})
    g = g.withColumn("p", F.least(F.lit(1.0), F.col("trials") * (1 - I.normal_cdf(s / F.col("se"))))).withColumn("z", F.expr(I.normal_quantile("(1 - p)")))
    positive = lambda c, digits: F.when(s > 0, F.round(c, digits))
    return g.select(
        "ticker", "n", "trials", F.round(s, 6).alias("sharpe"), F.round("skew", 5).alias("skew"), F.round("kurtosis", 5).alias("kurtosis"), F.round("expected_max", 6).alias("expected_max"),
        F.round(I.normal_cdf((s - F.col("expected_max")) / F.col("se")), 5).alias("deflated"), positive(1 + F.col("var") * 2.705543454095404 / (s * s), 2).alias("min_track"), positive("p", 5).alias("p_bonferroni"), positive(F.col("z") * F.col("se"), 4).alias("haircut"),
    )


PBO_COMBOS = "select unnest([7, 11, 13, 14, 19, 21, 22, 25, 26, 28, 35, 37, 38, 41, 42, 44, 49, 50, 52, 56]) as mask"


CSCV = "select mask, ticker, sum(s) filter ((mask >> blk) & 1 = 1) / sum(n) filter ((mask >> blk) & 1 = 1) as ins, sum(s) filter ((mask >> blk) & 1 = 0) / sum(n) filter ((mask >> blk) & 1 = 0) as oos from (select ticker, blk, sum(ret) as s, count(*) as n from {0} group by 1, 2), {1} group by 1, 2"
PLACED = "select mask, ticker, row_number() over (partition by mask order by ins desc, ticker) as best, rank() over (partition by mask order by oos desc) as place, rank() over (partition by mask order by oos) as low, count(*) over (partition by mask) as s from ({0}) where ins is not null and oos is not null"
BLOCKS = {
    "b6": "select ticker, ret, cast((dense_rank() over (order by date) - 1) % 6 as int) as blk from retsm where ret is not null",
    "b16": "select r.ticker, r.ret, k.blk from retsm r join (select date, cast(ntile(16) over (order by date) - 1 as int) as blk from (select distinct date from retsm where ret is not null)) k using (date) where ret is not null",
    "combos16": "select m as mask from (select unnest(range(65536)) as m) where bit_count(m::int) = 8",
}


@query(f"select 'interleaved' as form, count(*) as splits, round(avg((place / s > 0.5)::int), 6) as pbo from ({PLACED.format(CSCV.format('b6', 'combos'))}) where best = 1 union all select 'contiguous', count(*), round(avg((ln((low / (s + 1.0)) / (1 - low / (s + 1.0))) < 0)::int), 6) from ({PLACED.format(CSCV.format('b16', 'combos16'))}) where best = 1", {"retsm": RETS_M, "combos": PBO_COMBOS} | BLOCKS)
def l12_backtest_overfit(spark, d):
    """How often the strategy that is best inside does badly outside, over all ways to choose half of the blocks: six
    interleaved ones, by its rank in the lower half; and sixteen contiguous ones (12,870 ways), by a negative logit of its relative rank."""
    r = monthly_returns(spark, d).where("ret is not null")
    dates = r.select("date").distinct().select("date", ((F.dense_rank().over(Window.orderBy("date")) - 1) % 6).alias("i"), (F.ntile(16).over(Window.orderBy("date")) - 1).alias("c"))  # a calendar
    r = r.join(F.broadcast(dates), "date")
    inter = I.half_splits(r, "i", 6).agg(F.lit("interleaved").alias("form"), F.count("*").alias("splits"), F.round(F.avg((F.col("place") / F.col("s") > 0.5).cast("int")), 6).alias("pbo"))
    share = F.col("low") / (F.col("s") + 1)
    cont = I.half_splits(r, "c", 16).agg(F.lit("contiguous").alias("form"), F.count("*").alias("splits"), F.round(F.avg((F.log(share / (1 - share)) < 0).cast("int")), 6).alias("pbo"))
    return inter.unionByName(cont)


FACTORS = "select date, ticker, ret, avg(ret) over (partition by date) as mkt, dv, avg(case when dv > 0 then ret end) over (partition by date) - avg(case when dv <= 0 then ret end) over (partition by date) as flow from (select date, ticker, close / lag(close) over (partition by ticker order by date) - 1 as ret, volume / lag(volume) over (partition by ticker order by date) - 1 as dv from {0})"
NAMES = {"mkt": "market", "dv": "volume", "flow": "flow"}


def inverse_sql(src: str, ys: str, keys: str, agg: str, xs: list[str], where: str = "") -> str:
    """Columns of least squares on three factors: covariances, the adjugate of their matrix and its determinant."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    cov = ", ".join([f"covar_pop({xs[i]}, {xs[j]}) {agg} as s{i}{j}" for i, j in pairs] + [f"covar_pop({x}, {ys}) {agg} as c{i}" for i, x in enumerate(xs)] + [f"avg({x}) {agg} as m{i}" for i, x in enumerate(xs)])
    s = lambda i, j: f"s{min(i, j)}{max(i, j)}"
    minor = lambda i, j: "({} * {} - {} * {})".format(*[s(a, b) for a, b in ((((i + 1) % 3), (j + 1) % 3), ((i + 2) % 3, (j + 2) % 3), ((i + 1) % 3, (j + 2) % 3), ((i + 2) % 3, (j + 1) % 3))])
    adj = ", ".join(f"{minor(i, j)} as a{i}{j}" for i, j in pairs)
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    beta = ", ".join("(" + " + ".join(f"{a(i, j)} * c{j}" for j in range(3)) + f") / nullif(det, 0) as b{i}" for i in range(3))
    inner = f"select {keys}, count({ys}) {agg} as n, avg({ys}) {agg} as my, var_pop({ys}) {agg} as syy, {cov} from {src} {where}"
    return f"select *, {beta} from (select *, {' + '.join(f's0{j} * {a(0, j)}' for j in range(3))} as det from (select *, {adj} from ({inner})))"


FIT = inverse_sql("fr", "ret", "ticker", "", list(NAMES), "group by 1")
REGRESSION = {
    "fr": f"select * from ({FACTORS.format('prices_monthly')}) where ret is not null and dv is not null and mkt is not null and flow is not null",
    "fb": f"select *, my - b0 * m0 - b1 * m1 - b2 * m2 as a from ({FIT}) where n >= 5 and det > 1e-10 * s00 * s11 * s22",
    "fw": "select ticker, date, ret - a - b0 * mkt - b1 * dv - b2 * flow as u, " + ", ".join(f"({' + '.join(f'a{min(i, j)}{max(i, j)} * ({x} - m{j})' for j, x in enumerate(NAMES))}) / det as w{i}" for i in range(3)) + ", m0, m1, m2 from fr join fb using (ticker)",
    "fz": "select ticker || ':alpha' as sid, date, u * (1 - m0 * w0 - m1 * w1 - m2 * w2) as z from fw" + "".join(f" union all select ticker || ':{v}', date, u * w{i} from fw" for i, v in enumerate(NAMES.values())),
}


@query(f"select b.ticker, c.coef, round(case c.coef when 'alpha' then b.a when 'market' then b.b0 when 'volume' then b.b1 else b.b2 end, 6) as value, round(h.se, 7) as se, round(case c.coef when 'alpha' then b.a when 'market' then b.b0 when 'volume' then b.b1 else b.b2 end / h.se, 4) as t, round({erf_p("(case c.coef when 'alpha' then b.a when 'market' then b.b0 when 'volume' then b.b1 else b.b2 end / h.se)")}, 5) as p, h.n, cast(h.lag as int) as lag, round((b.b0 * b.c0 + b.b1 * b.c1 + b.b2 * b.c2) / b.syy, 6) as r2 from fb b, (select unnest(['alpha', 'market', 'volume', 'flow']) as coef) c join hl h on h.sid = b.ticker || ':' || c.coef", REGRESSION | hac_ctes("fz", "sid", "date", "z"))
def l13_factor_regression(spark, d):
    """Returns on the market, the change of volume, and names with rising less names with falling volume, per ticker, with
    Newey-West errors: any number of factors by name."""
    w = Window.partitionBy("date")
    p = A.prices_monthly(spark, d).withColumns({"ret": R.simple_return(), "volume": R.simple_return("volume")}).withColumns({"market": F.avg("ret").over(w), "flow": F.avg(F.when(F.col("volume") > 0, F.col("ret"))).over(w) - F.avg(F.when(F.col("volume") <= 0, F.col("ret"))).over(w)})
    g = G.factor_regression(p, ["ticker"], "date", "ret", ["market", "volume", "flow"], least=5)
    return g.select("ticker", "coef", F.round("value", 6).alias("value"), F.round("se", 7).alias("se"), F.round("t", 4).alias("t"), F.round("p", 5).alias("p"), "n", "lag", F.round("r2", 6).alias("r2"))


EXPOSED = f"select date, ticker, ok, case when ok then ret end as r, case when ok then mkt end as f1, case when ok then vf end as f2, case when ok then flow end as f3 from (select *, ret is not null and mkt is not null and vf is not null and flow is not null as ok from (select *, avg(dv) over (partition by date) as vf from ({FACTORS.format('grid')})))"
EXPO_W = inverse_sql("exposed", "r", "date, ticker", "over w", ["f1", "f2", "f3"], "window w as (partition by ticker order by date rows between 251 preceding and current row)")


@query("select date, ticker, n, case when n >= 126 and det > 1e-7 * s00 * s11 * s22 then round(b0, 4) end as market, case when n >= 126 and det > 1e-7 * s00 * s11 * s22 then round(b1, 4) end as volume, case when n >= 126 and det > 1e-7 * s00 * s11 * s22 then round(b2, 4) end as flow, case when n >= 126 then round(c0 / s00, 4) end as market_alone from expo_w where date in (select max(date) from grid group by date_trunc('month', date))", {"exposed": EXPOSED, "expo_w": EXPO_W})
def l14_rolling_exposure(spark, d):
    """Month-end exposures to three factors together, and to the first alone, over 252 sessions, 126 of them known."""
    w = Window.partitionBy("date")
    df = A.grid(spark, d).withColumns({"ret": R.simple_return(), "dv": R.simple_return("volume")})
    df = df.withColumns({"mkt": F.avg("ret").over(w), "vf": F.avg("dv").over(w), "flow": F.avg(F.when(F.col("dv") > 0, F.col("ret"))).over(w) - F.avg(F.when(F.col("dv") <= 0, F.col("ret"))).over(w)})
    known = F.col("mkt").isNotNull() & F.col("vf").isNotNull() & F.col("flow").isNotNull()
    df = stored(df.select("date", "ticker", F.when(known, F.col("ret")).alias("ret"), "mkt", "vf", "flow"), "factor-panel")
    ends = df.select("date").distinct().groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date")).select("date")
    all3 = G.rolling_exposures(df, "ret", ["mkt", "vf", "flow"], 252, 126, ends)
    alone = G.rolling_exposures(df, "ret", ["mkt"], 252, 126, ends).select("date", "ticker", F.col("b")[0].alias("alone"))
    b = lambda i: F.round(F.col("b")[i], 4)
    return all3.join(alone, ["date", "ticker"]).select("date", "ticker", "n", b(0).alias("market"), b(1).alias("volume"), b(2).alias("flow"), F.round("alone", 4).alias("market_alone"))


@query("select round(regr_slope(ic, v), 9) as slope, round(regr_intercept(ic, v), 6) as intercept, round(regr_r2(ic, v), 6) as r2, count(*) as n from (select i.month, i.ic, f.value / 1000 as v from (select * from ic where ic is not null and not isnan(ic)) i asof join first_print f on i.month >= f.realtime_start)", {"first_print": "select realtime_start, max_by(value, ref_date) as value from (select ref_date, min(realtime_start) as realtime_start, min_by(value, realtime_start) as value from vintages group by ref_date) group by 1"})
def l15_conditional_ic(spark, d):
    first = A.vintages(spark, d).groupBy("ref_date").agg(F.min("realtime_start").alias("known"), F.min_by("value", "realtime_start").alias("value"))
    j = asof_join(monthly_ic(spark, d), first, "month", "known", ties=("ref_date",), how="inner").withColumn("v", F.col("value") / 1000)
    return j.agg(F.round(F.regr_slope("ic", "v"), 9).alias("slope"), F.round(F.regr_intercept("ic", "v"), 6).alias("intercept"), F.round(F.regr_r2("ic", "v"), 6).alias("r2"), F.count("*").alias("n"))


@query("select sid as look, n, round(mean, 6) as mean, round(mean - 1.959963984540054 / sqrt(sid / 4.0) * se, 6) as low, round(mean + 1.959963984540054 / sqrt(sid / 4.0) * se, 6) as high, equivalent, equivalent and sid = min(case when equivalent then sid end) over () as stops from (select *, mean - 1.959963984540054 / sqrt(sid / 4.0) * se > -0.2 and mean + 1.959963984540054 / sqrt(sid / 4.0) * se < 0.2 as equivalent from hl)", {"iclook": "select k as look, month, ic from (select *, row_number() over (order by month) as i, count(*) over () as n from ic where ic is not null and not isnan(ic)), (select unnest([1, 2, 3, 4]) as k) where i <= ceil(n * k / 4.0)"} | hac_ctes("iclook", "look", "month", "ic"))
def l16_group_sequential(spark, d):
    ics = monthly_ic(spark, d).withColumns({"i": F.row_number().over(Window.orderBy("month")), "all": F.count("*").over(Window.partitionBy(F.lit(0)))})  # months
    looks = ics.select("month", "ic", "i", "all", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("look")).where(F.col("i") <= F.ceil(F.col("all") * F.col("look") / 4))
    h = I.hac(looks, ["look"], "month", "ic")
    half = 1.959963984540054 / F.sqrt(F.col("look") / 4) * F.col("se")
    low, high = F.col("mean") - half, F.col("mean") + half
    h = h.withColumn("equivalent", (low > -0.2) & (high < 0.2))
    stop = F.min(F.when(F.col("equivalent"), F.col("look"))).over(Window.partitionBy(F.lit(0)))  # four looks
    return h.select("look", "n", F.round("mean", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), "equivalent", (F.col("equivalent") & (F.col("look") == stop)).alias("stops"))


STUDY = "with ms as (select date, row_number() over (order by date) as idx from (select distinct date from prices_monthly)), e as (select distinct o_orderkey as event_id, o_orderpriority as event_type, 'S' || l_suppkey as ticker, idx from orders join lineitem on l_orderkey = o_orderkey join ms on ms.date = cast(date_trunc('month', o_orderdate) as date)), r as (select ticker, idx, ret - avg(ret) over (partition by date) as ab from retsm join ms using (date) where ret is not null), c as (select e.event_type, r.idx - e.idx as off, sum(ab) over w as car, count(*) over (partition by e.event_id, e.ticker) as n from e join r on r.ticker = e.ticker and r.idx between e.idx - 10 and e.idx + 20 window w as (partition by e.event_id, e.ticker order by r.idx)) select event_type, cast(off as int) as \"offset\", count(*) as n, round(avg(car), 6) as mean, round(stddev_samp(car) / sqrt(count(*)), 6) as se, round(avg(car) - 1.96 * stddev_samp(car) / sqrt(count(*)), 6) as low, round(avg(car) + 1.96 * stddev_samp(car) / sqrt(count(*)), 6) as high from c where n = 31 group by 1, 2"


@query(STUDY, {"retsm": RETS_M})
def l17_event_study(spark, d):
    """Ten sessions before to twenty after every order of a supplier, a session being a month: the excess over the mean of
    all names, cumulated, with its interval by type of order."""
    r = monthly_returns(spark, d).where("ret is not null")
    o, li = A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    s = li.select(F.trunc("l_shipdate", "month").alias("date")).distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")))  # a calendar
    ab = r.select("date", "ticker", (F.col("ret") - F.avg("ret").over(Window.partitionBy("date"))).alias("ab"))
    pairs = o.select("o_orderkey", "o_orderpriority", F.trunc("o_orderdate", "month").alias("date")).join(li.select("l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = pairs.select("o_orderkey", "o_orderpriority", "date", "l_suppkey").distinct()  # each order's rows are together already
    e = pairs.select(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("event_id"), F.col("o_orderpriority").alias("event_type"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), "date")
    out = I.event_study(ab, e, s, 10, 20)
    return out.select("event_type", "offset", "n", *[F.round(c, 6).alias(c) for c in ("mean", "se", "low", "high")])


@query("select 'filing' as kind, ticker, filed as date, count(*) as n from facts group by all union all select 'study', ticker, event_date, count(*) from study_events group by all union all select 'macro', 'ALL', realtime_start, count(*) from vintages group by all")
def l18_event_frames(spark, d):
    a = A.facts(spark, d).select(F.lit("filing").alias("kind"), "ticker", F.col("filed").alias("date"))
    b = A.study_events(spark, d).select(F.lit("study").alias("kind"), "ticker", F.col("event_date").alias("date"))
    c = A.vintages(spark, d).select(F.lit("macro").alias("kind"), F.lit("ALL").alias("ticker"), F.col("realtime_start").alias("date"))
    return a.unionByName(b).unionByName(c).groupBy("kind", "ticker", "date").agg(F.count("*").alias("n"))


@query()
def l19_spillover(spark, d):
    """Rolling spillover of pairs of sectors' daily mean returns, over 250 sessions, every 21 sessions."""
    r = returns(spark, d).where("ret is not null").join(F.broadcast(A.sectors(spark, d)), "ticker").groupBy("date", "sector").agg(F.avg("ret").alias("r"))  # one row a ticker
    left, right = (r.select("date", F.col("sector").alias(k), F.col("r").alias(f"r{k}")) for k in "xy")
    pairs = left.join(right, "date").where("x < y")
    pairs = pairs.withColumn("i", F.row_number().over(Window.partitionBy("x", "y").orderBy("date")) - 1)
    out = I.rolling_spillover(pairs.select("x", "y", "i", "rx", "ry"))
    return out.join(pairs.select("x", "y", "i", "date"), ["x", "y", "i"]).select("x", "y", "date", "index")


SWEEP = {
    "swept": "select date, ticker, sum(ret) over w21 as momentum, -sum(ret) over w5 as reversal, avg(volume) over w21 as turnover, lead(close, 10) over w / close - 1 as y10, lead(close, 42) over w / close - 1 as y42 from rets window w as (partition by ticker order by date), w21 as (partition by ticker order by date rows between 20 preceding and current row), w5 as (partition by ticker order by date rows between 4 preceding and current row)",
    "arms": " union all ".join(f"select '{a}' as arm, {h} as h, date, {a} as x, y{h} as y from swept where {a} is not null and y{h} is not null" for a in ("momentum", "reversal", "turnover") for h in (10, 42)),
    "swic": "select arm, h, date, corr(rs, ry) as ic from (select arm, h, date, rank() over (partition by arm, h, date order by x) + (count(*) over (partition by arm, h, date, x) - 1) / 2.0 as rs, rank() over (partition by arm, h, date order by y) + (count(*) over (partition by arm, h, date, y) - 1) / 2.0 as ry from arms where date in (select max(date) from prices group by date_trunc('month', date))) group by 1, 2, 3 having count(*) >= 5",
    "swl": "select arm || ':' || h as sid, date, ic from swic where not isnan(ic)",
}


@query("select split_part(sid, ':', 1) as arm, split_part(sid, ':', 2)::int as h, n as months, round(mean, 6) as mean_ic, round(se, 6) as se, abs(mean) <= 1.96 * se as null_holds from hl", SWEEP | hac_ctes("swl", "sid", "date", "ic"))
def l20_horizon_sweep(spark, d):
    """Rank IC of every arm against returns over 10 and 42 sessions at month ends, and whether its interval holds zero: all
    arms and horizons are series of one job."""
    r = returns(spark, d)
    w = R.by_ticker()
    back = lambda k: w.rowsBetween(-k + 1, 0)
    r = r.select("date", "ticker", F.sum("ret").over(back(21)).alias("momentum"), (-F.sum("ret").over(back(5))).alias("reversal"), F.avg("volume").over(back(21)).alias("turnover"), *[(F.lead("close", h).over(w) / F.col("close") - 1).alias(f"y{h}") for h in (10, 42)])
    ends = A.prices(spark, d).groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")
    cells = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(h).alias("h"), F.col(a).alias("x"), F.col(f"y{h}").alias("y")) for a in ("momentum", "reversal", "turnover") for h in (10, 42)])
    arms = r.join(F.broadcast(ends), "date").select("date", F.explode(cells).alias("c")).select("date", "c.*")  # a calendar
    h = I.hac(I.rank_ic(arms, ["arm", "h", "date"], "x", "y"), ["arm", "h"], "date", "ic")
    return h.select("arm", "h", F.col("n").alias("months"), F.round("mean", 6).alias("mean_ic"), F.round("se", 6).alias("se"), (F.abs("mean") <= 1.96 * F.col("se")).alias("null_holds"))


@query("select n, round(mean, 6) as mean, round(se, 6) as se, mean - 1.96 * se > 0 as publish, (select round(avg((abs(b.mean - h.mean) >= abs(h.mean))::int), 6) from boots b) as p_boot from hl h", {"arms": "select month, a.ic - b.ic as d from (select date as month, corr(rs, ry) as ic from (select date, rank() over (partition by date order by close) + (count(*) over (partition by date, close) - 1) / 2.0 as rs, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0 as ry from (select date, close, lead(close, 1) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where y is not null) group by 1 having count(*) >= 5) a join (select date as month, corr(rs, ry) as ic from (select date, rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2.0 as rs, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2.0 as ry from (select date, volume, lead(close, 1) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where y is not null) group by 1 having count(*) >= 5) b using (month)"} | hac_ctes("arms", "1", "month", "d") | boot_ctes("arms", "1", "month", "d"))
def l22_ic_differential(spark, d):
    p = A.prices_monthly(spark, d).withColumn("y", R.forward_return(1))
    a, b = (I.rank_ic(p, ["date"], c, "y").select("date", F.col("ic").alias(n)) for c, n in (("close", "a"), ("volume", "b")))
    diff = a.join(b, "date").select("date", (F.col("a") - F.col("b")).alias("d"), F.lit(1).alias("sid"))
    h = I.hac(diff, ["sid"], "date", "d")
    far = I.bootstrap_means(diff, ["sid"], "date", "d").join(h.select("sid", F.col("mean").alias("m")), "sid").groupBy("sid").agg(F.round(F.avg((F.abs(F.col("mean") - F.col("m")) >= F.abs("m")).cast("int")), 6).alias("p_boot"))
    return h.join(far, "sid").select("n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), (F.col("mean") - 1.96 * F.col("se") > 0).alias("publish"), "p_boot")


@query("select bps, round(avg(turnover * bps / 10000.0), 8) as mean_cost, round(sum(turnover * bps / 10000.0), 6) as total from turn, (select unnest([0, 5, 10, 25, 50]) as bps) group by 1", {"weights": WEIGHTS, "turn": TURN})
def l23_cost_sweep(spark, d):
    t = turnover(spark, d).select("turnover", F.explode(F.array(*map(F.lit, (0, 5, 10, 25, 50)))).alias("bps"))
    cost = F.col("turnover") * F.col("bps") / 10000
    return t.groupBy("bps").agg(F.round(F.avg(cost), 8).alias("mean_cost"), F.round(F.sum(cost), 6).alias("total"))
