"""Queries on prices: returns, momentum, risk factors, ranks and z-scores over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import rolling as R
from ..operators.asof import mask_to_members
from .registry import query

W = "window {n} as (partition by ticker order by date rows between {k} preceding and current row)"


def returns(spark, d) -> DataFrame:
    return A.grid(spark, d).withColumn("ret", R.simple_return())


def with_market(spark, d) -> DataFrame:
    """Returns with the equal-weight market of their date, by a window: no self-join."""
    return returns(spark, d).withColumn("mkt", F.avg("ret").over(Window.partitionBy("date")))


def out(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("date", "ticker", *[F.round(c, 6).alias(k) for k, c in columns.items()])


def frame(n: int, name: str = "w") -> str:
    return W.format(n=name, k=n - 1)


@query("select date, ticker, round(close / lag(close) over (partition by ticker order by date) - 1, 6) as ret, round(last_value(close ignore nulls) over (partition by ticker order by date rows between unbounded preceding and current row) / last_value(close ignore nulls) over (partition by ticker order by date rows between unbounded preceding and 1 preceding) - 1, 6) as ret_padded from grid")
def e01_simple_return(spark, d):
    return out(A.grid(spark, d), ret=R.simple_return(), ret_padded=R.simple_return(pad=True))


@query("select date, ticker, round(lead(close, 5) over (partition by ticker order by date) / close - 1, 6) as y5, round(lead(close, 21) over (partition by ticker order by date) / close - 1, 6) as y21 from grid")
def e02_forward_return(spark, d):
    return out(A.grid(spark, d), y5=R.forward_return(5), y21=R.forward_return(21))


@query(f"select date, ticker, round(case when count(ret) over w5 >= 3 then sum(ret) over w5 end, 6) as mom_5, round(case when count(ret) over w10 >= 5 then sum(ret) over w10 end, 6) as mom_10, round(case when count(ret) over w21 >= 10 then sum(ret) over w21 end, 6) as mom_21, round(case when count(ret) over w42 >= 20 then sum(ret) over w42 end, 6) as mom_42, round(case when count(ret) over w5 = 5 then sum(ret) over w5 end, 6) as mom_full from rets {frame(5, 'w5')}, {frame(10, 'w10')[7:]}, {frame(21, 'w21')[7:]}, {frame(42, 'w42')[7:]}")
def e03_momentum(spark, d):
    return out(returns(spark, d), mom_5=R.momentum(5, least=3), mom_10=R.momentum(10, least=5), mom_21=R.momentum(21, least=10), mom_42=R.momentum(42, least=20), mom_full=R.momentum(5))


@query(f"select date, ticker, round(case when count(ret) over w >= 3 then -sum(ret) over w end, 6) as reversal from rets {frame(5)}")
def e04_reversal(spark, d):
    return out(returns(spark, d), reversal=R.reversal(5, least=3))


@query(f"select date, ticker, round(case when count(ret) over w >= 10 then stddev_samp(ret) over w end, 6) as vol, round(case when count(ret) over w >= 10 then stddev_samp(ret) over w * sqrt(252) end, 5) as vol_annual from rets {frame(21)}")
def e05_volatility(spark, d):
    r = returns(spark, d)
    return r.select("date", "ticker", F.round(R.volatility(21, least=10), 6).alias("vol"), F.round(R.volatility(21, least=10, annual=True), 5).alias("vol_annual"))


@query(f"select date, ticker, round(case when count(volume) over w >= 10 then avg(volume) over w end, 6) as turnover from grid {frame(21)}")
def e06_turnover(spark, d):
    return out(A.grid(spark, d), turnover=R.turnover(21, least=10))


BETA = "select *, case when ret is not null and mkt is not null then ret end as r, case when ret is not null and mkt is not null then mkt end as m from retm"


@query(f"select date, ticker, round(case when count(m) over w >= 60 then covar_samp(r, m) over w / var_samp(m) over w end, 6) as beta from both_known {frame(252)}", {"both_known": BETA})
def e07_beta(spark, d):
    return out(R.with_beta(with_market(spark, d), "b", 252, 60), beta=F.col("b"))


@query(f"select date, ticker, round(case when count(x) over w >= 1 then avg(x) over w end, 9) as illiquidity from (select *, abs(ret) / nullif(close * volume, 0) as x from rets) {frame(21)}")
def e08_illiquidity(spark, d):
    return returns(spark, d).select("date", "ticker", F.round(R.illiquidity(), 9).alias("illiquidity"))


MONTHLY = "select *, close / lag(close) over (partition by ticker order by date) - 1 as ret, lag(close, 11) over (partition by ticker order by date) as first12, count(case when close > 0 then 1 end) over w as ok from prices_monthly window w as (partition by ticker order by date rows between 11 preceding and current row)"


@query("select date, ticker, round(case when ok = 12 then close / first12 - 1 end, 6) as mom_12_1 from monthly", {"monthly": MONTHLY})
def e09_momentum_12_1(spark, d):
    return out(A.prices_monthly(spark, d), mom_12_1=R.momentum_12_1())


@query("select date, ticker, round(-ret, 6) as reversal_1m from monthly", {"monthly": MONTHLY})
def e10_reversal_1m(spark, d):
    return out(A.prices_monthly(spark, d), reversal_1m=R.reversal_1m())


@query("select date, ticker, round(case when ok = 12 and count(ret) over v = 11 and stddev_samp(ret) over v > 1e-12 then (close / first12 - 1) / stddev_samp(ret) over v end, 6) as vol_adj from monthly window v as (partition by ticker order by date rows between 10 preceding and current row)", {"monthly": MONTHLY})
def e11_vol_adjusted_momentum(spark, d):
    p = A.prices_monthly(spark, d).withColumn("ret", R.simple_return())
    sd = R.volatility(11)
    return out(p, vol_adj=F.when(sd > 1e-12, R.momentum_12_1() / sd))


@query("select p.date, p.ticker, round(case when n = 12 then (list_sum(list_transform(xs, lambda x: case when x < p.close then 1 else 0 end)) + (list_sum(list_transform(xs, lambda x: case when x = p.close then 1 else 0 end)) + 1) / 2.0) / 12 end, 6) as rank_12 from (select *, list(close) over w as xs, count(close) over w as n from prices_monthly window w as (partition by ticker order by date rows between 11 preceding and current row)) p")
def e12_rolling_rank(spark, d):
    return out(A.prices_monthly(spark, d), rank_12=R.rolling_rank("close", 12))


@query("select date, ticker, round(case when count(c) over w = 12 and sum(abs(c)) over w > 0 then sum(greatest(c, 0)) over w / sum(abs(c)) over w end, 6) as rsi_12 from (select *, close - lag(close) over (partition by ticker order by date) as c from prices_monthly) window w as (partition by ticker order by date rows between 11 preceding and current row)")
def e13_gain_ratio(spark, d):
    p = A.prices_monthly(spark, d).withColumn("c", F.col("close") - F.lag("close").over(R.by_ticker()))
    w = R.last_n(12)
    moves = F.sum(F.abs("c")).over(w)
    return out(p, rsi_12=F.when((F.count("c").over(w) == 12) & (moves > 0), F.sum(F.when(F.col("c") > 0, F.col("c")).when(F.col("c").isNotNull(), 0.0)).over(w) / moves))


@query("select date, ticker, round(case when count(c) over w = 12 then avg(case when c > 0 then 1.0 when c is not null then 0.0 end) over w end, 6) as up_share from (select *, close - lag(close) over (partition by ticker order by date) as c from prices_monthly) window w as (partition by ticker order by date rows between 11 preceding and current row)")
def e14_up_share(spark, d):
    p = A.prices_monthly(spark, d).withColumn("c", F.col("close") - F.lag("close").over(R.by_ticker()))
    return out(p, up_share=R.at_least("c", 12, F.avg(F.when(F.col("c") > 0, 1.0).when(F.col("c").isNotNull(), 0.0)), R.last_n(12)))


@query("select date, ticker, round(case when count(close) over w = 12 then (max(close) over w - min(close) over w) / close end, 6) as range_12 from prices_monthly window w as (partition by ticker order by date rows between 11 preceding and current row)")
def e15_range(spark, d):
    w = R.last_n(12)
    return out(A.prices_monthly(spark, d), range_12=F.when(F.count("close").over(w) == 12, (F.max("close").over(w) - F.min("close").over(w)) / F.col("close")))


@query("select date, ticker, round(case when n = 12 then (list_position(xs, list_max(xs)) - 1) / 11.0 end, 6) as to_high from (select *, list(close) over w as xs, count(close) over w as n from prices_monthly window w as (partition by ticker order by date rows between 11 preceding and current row))")
def e16_time_to_high(spark, d):
    return out(A.prices_monthly(spark, d), to_high=R.time_to_high("close", 12))


def down(c: str) -> Column:
    return F.when(F.col("mkt") < 0, F.col(c))


DOWN = "select *, case when mkt < 0 and ret is not null then ret end as r, case when mkt < 0 and ret is not null then mkt end as m from retm"


@query(f"select date, ticker, round(case when count(m) over w >= 30 then covar_samp(r, m) over w / var_samp(m) over w end, 6) as downside_beta from down_days {frame(252)}", {"down_days": DOWN})
def e17_downside_beta(spark, d):
    return out(R.with_beta(with_market(spark, d), "b", 252, 30, down("ret"), down("mkt")), downside_beta=F.col("b"))


def residuals(df: DataFrame, w: int = 63, least: int = 20) -> DataFrame:
    """df with resid: return less market return times the beta of the same window."""
    return R.with_beta(df, "b63", w, least).withColumn("resid", F.col("ret") - F.col("mkt") * F.col("b63"))


RESID = f"select *, ret - mkt * (case when count(m) over w >= 20 then covar_samp(r, m) over w / var_samp(m) over w end) as resid from both_known {frame(63)}"


@query(f"select date, ticker, round(case when count(resid) over w >= 20 then stddev_samp(resid) over w end, 6) as idio_vol from residual {frame(63)}", {"both_known": BETA, "residual": RESID})
def e18_idiosyncratic_volatility(spark, d):
    """One window for the beta and for the deviation of its residuals."""
    return out(residuals(with_market(spark, d)), idio_vol=R.at_least("resid", 20, F.stddev_samp("resid"), R.last_n(63)))


SKEW = "case when n >= 30 and sd > 1e-12 then (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (sd * sd * sd) * sqrt(n * (n - 1)) / (n - 2) end"


@query(f"select date, ticker, round({SKEW}, 4) as skew from (select date, ticker, count(ret) over w as n, avg(ret) over w as m1, avg(ret * ret) over w as m2, avg(ret * ret * ret) over w as m3, stddev_pop(ret) over w as sd from rets {frame(126)})")
def e19_tail_skew(spark, d):
    return returns(spark, d).select("date", "ticker", F.round(R.sample_skew("ret", 126, 30), 4).alias("skew"))


@query(f"select date, ticker, round(case when count(ret) over w >= 20 then min(ret) over w end, 6) as worst_day from rets {frame(63)}")
def e20_worst_day(spark, d):
    return out(returns(spark, d), worst_day=R.at_least("ret", 20, F.min("ret"), R.last_n(63)))


SKEW63 = SKEW.replace("n >= 30", "n >= 20")


@query(f"select date, ticker, beta, downside_beta, idio_vol, round({SKEW63}, 4) as skew, worst_day from (select date, ticker, round(case when count(m) over y >= 60 then covar_samp(r, m) over y / var_samp(m) over y end, 6) as beta, round(case when count(dm) over y >= 30 then covar_samp(dr, dm) over y / var_samp(dm) over y end, 6) as downside_beta, round(case when count(ret) over q >= 20 then min(ret) over q end, 6) as worst_day, round(case when count(resid) over q >= 20 then stddev_samp(resid) over q end, 6) as idio_vol, count(ret) over q as n, avg(ret) over q as m1, avg(ret * ret) over q as m2, avg(ret * ret * ret) over q as m3, stddev_pop(ret) over q as sd from (select *, case when m < 0 then r end as dr, case when m < 0 then m end as dm from residual) {frame(252, 'y')}, {frame(63, 'q')[7:]})", {"both_known": BETA, "residual": RESID})
def e21_risk_factors(spark, d):
    """All risk factors in one pass over one sort by ticker."""
    df = R.with_beta(with_market(spark, d), "b", 252, 60)
    df = residuals(R.with_beta(df, "db", 252, 30, down("ret"), down("mkt")))
    q = R.last_n(63)
    return df.select(
        "date", "ticker", F.round("b", 6).alias("beta"), F.round("db", 6).alias("downside_beta"), F.round(R.at_least("resid", 20, F.stddev_samp("resid"), q), 6).alias("idio_vol"),
        F.round(R.sample_skew("ret", 63, 20), 4).alias("skew"), F.round(R.at_least("ret", 20, F.min("ret"), q), 6).alias("worst_day"),
    )


PRIOR = "rows between {n} preceding and 1 preceding"


def prior_z_sql(x: str, n: str, least: int, clip: str = "") -> str:
    w = f"over (partition by ticker order by date rows between {n} preceding and 1 preceding)"
    z = f"case when count({x}) {w} >= {least} and stddev_samp({x}) {w} > 1e-12 then ({x} - avg({x}) {w}) / stddev_samp({x}) {w} end"
    return f"case when {z} > {clip} then {clip} when {z} < -{clip} then -{clip} else {z} end" if clip else z


@query(f"select date, ticker, round({prior_z_sql('close', '252', 60)}, 5) as z from grid")
def e22_past_z(spark, d):
    return A.grid(spark, d).select("date", "ticker", F.round(R.prior_z("close", 252, 60), 5).alias("z"))


@query("select date, ticker, round(case when count(ret) over w >= 60 and stddev_samp(ret) over w > 1e-12 then ret / stddev_samp(ret) over w end, 5) as scaled from rets window w as (partition by ticker order by date rows between unbounded preceding and current row)")
def e23_expanding_scale(spark, d):
    return returns(spark, d).select("date", "ticker", F.round(R.expanding_scale("ret", 60), 5).alias("scaled"))


@query(f"select date, ticker, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a is not null)::int + (b is not null)::int, 0), 5) as composite from (select date, ticker, {prior_z_sql('close', '252', 60)} as a, {prior_z_sql('volume', '252', 60)} as b from grid)")
def e24_composite(spark, d):
    z = A.grid(spark, d).select("date", "ticker", R.prior_z("close", 252, 60).alias("a"), R.prior_z("volume", 252, 60).alias("b"))
    return z.select("date", "ticker", F.round(row_mean("a", "b"), 5).alias("composite"))


def row_mean(*columns: str) -> Column:
    """Mean of the known columns of a row."""
    known = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(known > 0, sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0)) / known)


@query(f"select date, ticker, round(case when s > 5 then 5.0 when s < -5 then -5.0 else s end, 5) as surprise from (select date, ticker, case when count(raw) over p >= 12 and stddev_samp(raw) over p > 1e-12 then raw / stddev_samp(raw) over p end as s from (select date, ticker, ch - case when count(ch) over p >= 6 then avg(ch) over p end as raw from (select date, ticker, close - lag(close) over (partition by ticker order by date) as ch from prices_monthly) window p as (partition by ticker order by date rows between 12 preceding and 1 preceding)) window p as (partition by ticker order by date rows between unbounded preceding and 1 preceding))")
def e25_surprise(spark, d):
    p = A.prices_monthly(spark, d).withColumn("ch", F.col("close") - F.lag("close").over(R.by_ticker()))
    w, e = R.prior_n(12), R.prior_n(None)
    p = p.withColumn("raw", F.col("ch") - R.at_least("ch", 6, F.avg("ch"), w))
    sd = F.stddev_samp("raw").over(e)
    return p.select("date", "ticker", F.round(R.clipped(F.when((F.count("raw").over(e) >= 12) & (sd > 1e-12), F.col("raw") / sd), 5.0), 5).alias("surprise"))


@query(f"select date, ticker, round({prior_z_sql('close', 'unbounded', 2)}, 5) as z from prices_monthly")
def e26_expanding_prior_z(spark, d):
    return A.prices_monthly(spark, d).select("date", "ticker", F.round(R.prior_z("close", None, 2), 5).alias("z"))


@query(f"select date, ticker, round({prior_z_sql('ch', '60', 20, '5.0')}, 5) as z from (select date, ticker, close - lag(close) over (partition by ticker order by date) as ch from grid)")
def e27_daily_surprise(spark, d):
    g = A.grid(spark, d).withColumn("ch", F.col("close") - F.lag("close").over(R.by_ticker()))
    return g.select("date", "ticker", F.round(R.prior_z("ch", 60, 20, clip=5.0), 5).alias("z"))


@query("select date, ticker, round(case when n > 1 and ret is not null then (s - ret) / (n - 1) end, 6) as peers from (select date, ticker, ret, sum(ret) over w as s, count(ret) over w as n from rets join sectors using (ticker) window w as (partition by date, sector))")
def e29_peer_mean(spark, d):
    df = returns(spark, d).join(F.broadcast(A.sectors(spark, d)), "ticker")  # one row a ticker
    return out(df, peers=R.others_mean("ret", "date", "sector"))


@query("select date, ticker, round(case when n > 1 and m is not null then (s - m) / (n - 1) end, 6) as peer_momentum from (select date, ticker, m, sum(m) over w as s, count(m) over w as n from (select *, close / lag(close, 21) over (partition by ticker order by date) - 1 as m from grid) join sectors using (ticker) window w as (partition by date, sector))")
def e30_peer_momentum(spark, d):
    g = A.grid(spark, d).withColumn("m", F.col("close") / F.lag("close", 21).over(R.by_ticker()) - 1)
    return out(g.join(F.broadcast(A.sectors(spark, d)), "ticker"), peer_momentum=R.others_mean("m", "date", "sector"))


@query(f"select date, ticker, round(close / lag(close) over o - 1, 6) as r1, round(close / lag(close, 5) over o - 1, 6) as r5, round(close / lag(close, 21) over o - 1, 6) as r21, round(case when count(ret) over w >= 10 then stddev_pop(ret) over w end, 6) as vol, round(ret - mkt, 6) as relative from retm window o as (partition by ticker order by date), w as (partition by ticker order by date rows between 20 preceding and current row)")
def e31_market_state(spark, d):
    back = lambda k: F.col("close") / F.lag("close", k).over(R.by_ticker()) - 1
    return out(with_market(spark, d), r1=back(1), r5=back(5), r21=back(21), vol=R.at_least("ret", 10, F.stddev_pop("ret"), R.last_n(21)), relative=F.col("ret") - F.col("mkt"))


@query("select date, round(m, 6) as mkt, round(100 * exp(sum(ln(1 + coalesce(m, 0))) over (order by date)), 4) as idx from (select date, mkt as m from mkt)")
def e32_market_index(spark, d):
    """Mean return by date and its cumulated index; dates are a calendar, so one sorted pass is enough."""
    m = returns(spark, d).groupBy("date").agg(F.avg("ret").alias("mkt"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("date", F.round("mkt", 6).alias("mkt"), F.round(100 * F.exp(F.sum(F.log(1 + F.coalesce("mkt", F.lit(0.0)))).over(w)), 4).alias("idx"))


@query("select date, round(avg(s), 6) as meso from (select date, sector, avg(m) as s from (select *, close / lag(close, 21) over (partition by ticker order by date) - 1 as m from grid) join sectors using (ticker) group by date, sector) group by date")
def e33_sector_momentum(spark, d):
    g = A.grid(spark, d).withColumn("m", F.col("close") / F.lag("close", 21).over(R.by_ticker()) - 1).join(F.broadcast(A.sectors(spark, d)), "ticker")
    return g.groupBy("date", "sector").agg(F.avg("m").alias("s")).groupBy("date").agg(F.round(F.avg("s"), 6).alias("meso"))


@query("select date, ticker, round(volume / lag(volume) over w - 1, 6) as mom, round(volume / lag(volume, 12) over w - 1, 6) as yoy from prices_monthly window w as (partition by ticker order by date)")
def e34_growth(spark, d):
    return out(A.prices_monthly(spark, d), mom=R.simple_return("volume"), yoy=F.col("volume") / F.lag("volume", 12).over(R.by_ticker()) - 1)


@query(f"select date, ticker, round(case when count(close) over w >= 20 and stddev_samp(close) over w > 1e-12 then (close - avg(close) over w) / stddev_samp(close) over w end, 5) as z from prices_monthly window w as (partition by ticker order by date rows between 51 preceding and current row)")
def e37_positioning_z(spark, d):
    w = R.last_n(52)
    sd = F.stddev_samp("close").over(w)
    z = F.when((F.count("close").over(w) >= 20) & (sd > 1e-12), (F.col("close") - F.avg("close").over(w)) / sd)
    return A.prices_monthly(spark, d).select("date", "ticker", F.round(z, 5).alias("z"))


@query("select date, ticker, r as rank, lag(r) over (partition by ticker order by date) as previous, lag(r) over (partition by ticker order by date) - r as change from (select date, ticker, row_number() over (partition by date order by close desc, ticker) as r from prices_monthly)")
def e38_rank_change(spark, d):
    p = A.prices_monthly(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("close"), "ticker")).cast("long"))
    before = F.lag("rank").over(R.by_ticker())
    return p.select("date", "ticker", "rank", before.alias("previous"), (before - F.col("rank")).alias("change"))


@query("select t.ticker, string_agg(coalesce(cast(cast(round(p.close * 100) as bigint) as varchar), '-'), ' ' order by m.date) as scores, count(p.close) as known from (select distinct ticker from prices_monthly) t cross join (select distinct date from prices_monthly order by date desc limit 12) m left join prices_monthly p on p.ticker = t.ticker and p.date = m.date group by t.ticker")
def e39_month_grid(spark, d):
    """The last 12 months of each ticker as an array with gaps as nulls; twelve months are broadcast."""
    p = A.prices_monthly(spark, d)
    months = p.select("date").distinct().orderBy(F.desc("date")).limit(12)
    cells = p.select("ticker").distinct().crossJoin(F.broadcast(months)).join(p, ["ticker", "date"], "left")
    return cells.groupBy("ticker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", F.round(F.col("close") * 100).cast("long").alias("c")))), lambda x: F.coalesce(x["c"].cast("string"), F.lit("-"))), " ").alias("scores"), F.count("close").alias("known"))


@query("select date, ticker, round(total / max(total) over (partition by ticker order by date) - 1, 6) as drawdown from (select date, ticker, exp(sum(ln(1 + coalesce(r, 0))) over (partition by ticker order by date)) as total from (select date, ticker, close / lag(close) over (partition by ticker order by date) - 1 as r from prices_monthly))")
def e40_drawdown(spark, d):
    w = R.by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    p = A.prices_monthly(spark, d).withColumn("r", R.simple_return())
    p = p.withColumn("total", F.exp(F.sum(F.log(1 + F.coalesce("r", F.lit(0.0)))).over(w)))
    return out(p, drawdown=F.col("total") / F.max("total").over(w) - 1)


@query("select ticker, run, value, min(date) as first, max(date) as last, count(*) as length from (select *, sum(new) over (partition by ticker order by date) as run from (select ticker, date, floor(close / 500) as value, case when floor(close / 500) is not distinct from lag(floor(close / 500)) over (partition by ticker order by date) and row_number() over (partition by ticker order by date) > 1 then 0 else 1 end as new from prices_monthly)) group by ticker, run, value")
def e41_run_lengths(spark, d):
    p = A.prices_monthly(spark, d).withColumn("v", F.floor(F.col("close") / 500).cast("double"))
    return R.run_lengths(p, "v").withColumn("run", F.col("run").cast("long"))


@query("select date, ticker, count(ret) over p as n, round(avg(ret) over p, 6) as mean, round(case when count(ret) over p > 1 then stddev_samp(ret) over p end, 6) as sd, round(avg(case when ret > 0 then 1.0 when ret is not null then 0.0 end) over p, 6) as hits, string_agg(cast(cast(round(ret * 10000) as bigint) as varchar), ' ') filter (ret is not null) over k as recent from (select *, close / lag(close) over (partition by ticker order by date) - 1 as ret from prices_monthly) window p as (partition by ticker order by date rows between unbounded preceding and 1 preceding), k as (partition by ticker order by date rows between 3 preceding and 1 preceding)")
def e42_prior_context(spark, d):
    p = A.prices_monthly(spark, d).withColumn("ret", R.simple_return())
    e = R.prior_n(None)
    n = F.count("ret").over(e)
    recent = F.collect_list(F.round(F.col("ret") * 10000).cast("long").cast("string")).over(R.prior_n(3))
    return p.select(
        "date", "ticker", n.alias("n"), F.round(F.avg("ret").over(e), 6).alias("mean"), F.round(F.when(n > 1, F.stddev_samp("ret").over(e)), 6).alias("sd"),
        F.round(F.avg(F.when(F.col("ret") > 0, 1.0).when(F.col("ret").isNotNull(), 0.0)).over(e), 6).alias("hits"), F.when(F.size(recent) > 0, F.array_join(recent, " ")).alias("recent"),
    )


@query("select date, ticker, round(max(close) over w, 6) as high, round(min(close) over w, 6) as low, round(close / lag(close, 4) over o - 1, 6) as change_4 from prices_monthly window w as (partition by ticker order by date rows between 51 preceding and current row), o as (partition by ticker order by date) qualify row_number() over (partition by ticker order by date desc) <= 104")
def e43_high_low(spark, d):
    w = R.last_n(52)
    p = out(A.prices_monthly(spark, d), high=F.max("close").over(w), low=F.min("close").over(w), change_4=F.col("close") / F.lag("close", 4).over(R.by_ticker()) - 1)
    return p.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where("n <= 104").drop("n")


def labelled(spark, d) -> DataFrame:
    """Month-end rows of members with a momentum score and a forward label: the evaluation panel."""
    g = returns(spark, d)
    panel = g.select("date", "ticker", "close", R.forward_return(21).alias("y"), R.momentum(21, least=5).alias("score"))
    panel = mask_to_members(panel, A.membership(spark, d)).where("y is not null and score is not null")
    return R.end_of_month(panel, "ticker").withColumn("month", F.trunc("date", "month"))
