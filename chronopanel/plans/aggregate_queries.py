"""Queries that aggregate: roll-ups, top lists, drift, calibration, anomalies, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import monitor as M
from ..operators import rolling as R
from ..shared import scratch
from .price_queries import returns
from .registry import query

BOOK = "select quarter, manager, cusip, sum(value_usd) as v from holdings group by 1, 2, 3"


def book(spark, d) -> DataFrame:
    return A.holdings(spark, d).groupBy("quarter", "manager", "cusip").agg(F.sum("value_usd").alias("v"))


@query("select quarter, cusip, option_type, min(manager) as first_manager, round(sum(value_usd), 2) as value_usd, round(sum(shares), 2) as shares from holdings group by 1, 2, 3")
def d01_tranche_merge(spark, d):
    return A.holdings(spark, d).groupBy("quarter", "cusip", "option_type").agg(F.min("manager").alias("first_manager"), F.round(F.sum("value_usd"), 2).alias("value_usd"), F.round(F.sum("shares"), 2).alias("shares"))


@query("select quarter, manager, cusip, round(v, 2) as v, round(total, 2) as total, n, round(v / total, 6) as share, rank from (select *, sum(v) over (partition by quarter, manager) as total, count(*) over (partition by quarter, manager) as n, row_number() over (partition by quarter, manager order by v desc, cusip) as rank from bk) where rank <= 50", {"bk": BOOK})
def d02_manager_book(spark, d):
    """One book per manager and quarter: its total, number of positions, and the 50 largest with their weights."""
    w = Window.partitionBy("quarter", "manager")
    b = book(spark, d).withColumns({"total": F.sum("v").over(w), "n": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.desc("v"), "cusip")).cast("long")}).where("rank <= 50")
    return b.select("quarter", "manager", "cusip", F.round("v", 2).alias("v"), F.round("total", 2).alias("total"), "n", F.round(F.col("v") / F.col("total"), 6).alias("share"), "rank")


@query("select quarter, manager, round(total, 2) as total, top, rank from (select *, row_number() over (partition by quarter order by round(total, 2) desc, manager) as rank from (select quarter, manager, sum(v) as total, arg_max(cusip, {v: v, c: cusip}) as top from bk group by 1, 2)) where rank <= 5", {"bk": BOOK})
def d03_top_managers(spark, d):
    """The five largest managers of each quarter, with their largest position."""
    g = book(spark, d).groupBy("quarter", "manager").agg(F.round(F.sum("v"), 2).alias("total"), F.max_by("cusip", F.struct("v", "cusip")).alias("top"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("quarter").orderBy(F.desc("total"), "manager")).cast("long")).where("rank <= 5")


@query("select l_suppkey, min(l_linenumber) as line from (select l_suppkey, l_linenumber, count(*) as n, max(count(*)) over (partition by l_suppkey) as most from lineitem group by 1, 2) where n = most group by 1")
def d04_mode(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.mode("l_linenumber", True).alias("line"))


@query("select strftime(date, '%Y%m') as month, round(avg(close), 6) as mean, count(close) as n from grid where close is not null group by 1")
def d05_monthly_mean(spark, d):
    return A.prices(spark, d).groupBy(F.date_format("date", "yyyyMM").alias("month")).agg(F.round(F.avg("close"), 6).alias("mean"), F.count("close").alias("n"))


@query("select date_trunc('month', date)::date as month, round(avg(mkt), 8) as mkt from mkt group by 1")
def d06_month_resample(spark, d):
    return returns(spark, d).groupBy("date").agg(F.avg("ret").alias("mkt")).groupBy(F.trunc("date", "month").alias("month")).agg(F.round(F.avg("mkt"), 8).alias("mkt"))


@query("select sector, ticker, date_trunc('month', date)::date as month, max(date) as date, round(max_by(close, date), 6) as close from prices join sectors using (ticker) group by 1, 2, 3")
def d07_month_end_sample(spark, d):
    p = A.prices(spark, d).join(F.broadcast(A.sectors(spark, d)), "ticker")
    return p.groupBy("sector", "ticker", F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"), F.round(F.max_by("close", "date"), 6).alias("close"))


@query("select isoyear(date) * 100 + weekofyear(date) as week, ticker, max(date) as date, round(max_by(close, date), 6) as close from prices group by 1, 2")
def d08_week_last(spark, d):
    week = F.expr("extract(YEAROFWEEK from date) * 100 + weekofyear(date)").cast("long")
    return A.prices(spark, d).groupBy(week.alias("week"), "ticker").agg(F.max("date").alias("date"), F.round(F.max_by("close", "date"), 6).alias("close"))


@query("select ticker, count(*) filter (direction = 'buy') as buys, count(*) filter (direction = 'sell') as sells, count(distinct member) as members from member_trades group by 1")
def d09_conditional_counts(spark, d):
    return A.member_trades(spark, d).groupBy("ticker").agg(F.count_if(F.col("direction") == "buy").alias("buys"), F.count_if(F.col("direction") == "sell").alias("sells"), F.count_distinct("member").alias("members"))


@query("select ticker, count(*) as n from member_trades group by 1 order by n desc, ticker limit 10")
def d10_top_frequency(spark, d):
    return A.member_trades(spark, d).groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(10)


@query("select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2")
def d11_category_counts(spark, d):
    return A.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("select coalesce(nullif(trim(lang), ''), 'Unclassified') as sector, count(*) as n, round(avg(n_chars), 4) as mean, string_agg(distinct source, ',' order by source) as regions from documents group by 1 having count(*) >= 3")
def d12_sector_rollup(spark, d):
    sector = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("Unclassified"))
    return A.table(spark, d, "documents").groupBy(sector.alias("sector")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("regions")).where("n >= 3")


@query("select date, round(sd, 6) as sd, round(spread, 6) as spread, round(avg(sd) over (order by date rows between 11 preceding and current row), 6) as sd_12, case when sd > avg(sd) over (order by date rows between 11 preceding and current row) then 'high' else 'low' end as state from (select date, stddev_samp(close) as sd, quantile_cont(close, 0.9) - quantile_cont(close, 0.1) as spread from prices_monthly group by 1)")
def d13_dispersion(spark, d):
    p = F.percentile("close", F.array(F.lit(0.1), F.lit(0.9)))
    m = A.prices_monthly(spark, d).groupBy("date").agg(F.stddev_samp("close").alias("sd"), (p[1] - p[0]).alias("spread"))
    year = F.avg("sd").over(Window.orderBy("date").rowsBetween(-11, 0))  # months
    return m.select("date", F.round("sd", 6).alias("sd"), F.round("spread", 6).alias("spread"), F.round(year, 6).alias("sd_12"), F.when(F.col("sd") > year, "high").otherwise("low").alias("state"))


FIFTHS = "select date, ticker, close, r, ntile from (select p.*, lead(close) over (partition by ticker order by date) / close - 1 as r, 0 as ntile from prices_monthly p) where r is not null"


TENTHS = "select f.date, cast(len(list_filter(e.q, lambda x: f.close > x)) as int) as bucket, count(*) as n, avg(r) as m from fwdm f join (select date, quantile_cont(close, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from fwdm group by 1 having count(*) >= 30) e using (date) group by 1, 2"


@query("select date, bucket, n, round(m, 6) as mean_return, round(max(case when bucket = 9 then m end) over (partition by date) - max(case when bucket = 0 then m end) over (partition by date), 6) as top_less_bottom from tenths", {"fwdm": FIFTHS, "tenths": TENTHS})
def d14_quantile_returns(spark, d):
    """Mean forward return by tenth of each date with 30 names or more, and that of the top less the bottom tenth."""
    p = A.prices_monthly(spark, d).withColumn("r", R.forward_return(1)).where("r is not null")
    edges = M.inner_edges(p, "close", 10, ["date"]).join(p.groupBy("date").agg(F.count("*").alias("k")).where("k >= 30").select("date"), "date")
    g = p.join(edges, "date").groupBy("date", M.bucket(F.col("close"), F.col("edges")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("r").alias("m"))
    of = lambda k: F.max(F.when(F.col("bucket") == k, F.col("m"))).over(Window.partitionBy("date"))
    return g.select("date", "bucket", "n", F.round("m", 6).alias("mean_return"), F.round(of(9) - of(0), 6).alias("top_less_bottom"))


@query("select date, round(avg(r) filter (k <= 5), 6) as picks, round(avg(r), 6) as everyone, avg(r) filter (k <= 5) > avg(r) as hit from (select *, row_number() over (partition by date order by close desc, ticker) as k from fwdm) group by 1", {"fwdm": FIFTHS})
def d15_picks_backtest(spark, d):
    p = A.prices_monthly(spark, d).withColumn("r", R.forward_return(1)).where("r is not null")
    p = p.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("close"), "ticker")))
    picks = F.avg(F.when(F.col("k") <= 5, F.col("r")))
    return p.groupBy("date").agg(F.round(picks, 6).alias("picks"), F.round(F.avg("r"), 6).alias("everyone"), (picks > F.avg("r")).alias("hit"))


PSI = "with e as (select quantile_cont(close, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from prices_monthly where date < date '1999-01-01'), b as (select date < date '1999-01-01' as old, len(list_filter(q, lambda x: close > x)) as b from prices_monthly, e), s as (select old, b, count(*) / sum(count(*)) over (partition by old) as s from b group by 1, 2), j as (select greatest(coalesce(max(s) filter (old), 0), 0.0001) as p, greatest(coalesce(max(s) filter (not old), 0), 0.0001) as q from s group by b) select round(sum((p - q) * ln(p / q)), 6) as psi from j"


@query(PSI)
def d16_population_stability(spark, d):
    p = A.prices_monthly(spark, d)
    return M.population_stability(p.where("date < '1999-01-01'"), p.where("date >= '1999-01-01'"), "close").select(F.round("psi", 6).alias("psi"))


DRIFT = {
    "pairs": "select *, dense_rank() over (partition by region order by month desc) <= 12 as recent from (select case when right(ticker, 1) < '5' then 'a' else 'b' end as region, date as month, ticker, close / lag(close) over (partition by ticker order by date) - 1 as score, lead(close) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where score is not null and y is not null",
    "pedges": "select region, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from pairs where not recent group by 1",
    "pshare": "select region, recent, b, count(*) / sum(count(*)) over (partition by region, recent) as s from (select p.region, recent, len(list_filter(q, lambda x: score > x)) as b from pairs p join pedges using (region)) group by 1, 2, 3",
    "ppsi": "select region, sum((p - q) * ln(p / q)) as psi from (select region, b, greatest(coalesce(max(s) filter (not recent), 0), 0.0001) as p, greatest(coalesce(max(s) filter (recent), 0), 0.0001) as q from pshare group by 1, 2) group by 1",
    "pic": "select region, recent, avg(ic) as ic from (select region, recent, month, corr(rs, ry) as ic from (select *, rank() over (partition by region, month order by score) + (count(*) over (partition by region, month, score) - 1) / 2.0 as rs, rank() over (partition by region, month order by y) + (count(*) over (partition by region, month, y) - 1) / 2.0 as ry from pairs) group by 1, 2, 3 having count(*) >= 10) where not isnan(ic) group by 1, 2",
}


@query("select region, count(*) filter (not recent) as n_history, count(*) filter (recent) as n_recent, round(any_value(psi), 4) as psi, case when any_value(psi) < 0.1 then 'stable' when any_value(psi) < 0.25 then 'moderate' else 'significant' end as regime, round(max(i.ic), 4) as ic_history, round(max(j.ic), 4) as ic_recent, round(avg((y > 0)::int), 4) as base_rate, round(avg((y > 0)::int) filter (recent), 4) as base_rate_recent from pairs p join ppsi using (region) left join (select region, ic from pic where not recent) i using (region) left join (select region, ic from pic where recent) j using (region) group by region", DRIFT)
def d17_drift_summary(spark, d):
    """Per region: drift of the scores of its last 12 months against the months before, rank IC and base rate of both."""
    from ..operators import inference as I

    side = F.when(F.substring("ticker", -1, 1) < "5", "a").otherwise("b")
    p = A.prices_monthly(spark, d).select(side.alias("region"), F.col("date").alias("month"), R.simple_return().alias("score"), R.forward_return(1).alias("y")).where("score is not null and y is not null")
    months = p.select("region", "month").distinct().withColumn("recent", F.dense_rank().over(Window.partitionBy("region").orderBy(F.desc("month"))) <= 12)  # a calendar
    p = p.join(F.broadcast(months), ["region", "month"])
    psi = M.population_stability(p.where("not recent"), p.where("recent"), "score", by=["region"])
    ic = I.rank_ic(p, ["region", "month"], "score", "y", least=10).join(F.broadcast(months), ["region", "month"])
    when = lambda c, v: F.avg(F.when(c, v))
    ics = ic.groupBy("region").agg(F.round(when(~F.col("recent"), F.col("ic")), 4).alias("ic_history"), F.round(when(F.col("recent"), F.col("ic")), 4).alias("ic_recent"))
    up = (F.col("y") > 0).cast("int")
    g = p.groupBy("region").agg(F.count_if(~F.col("recent")).alias("n_history"), F.count_if("recent").alias("n_recent"), F.round(F.avg(up), 4).alias("base_rate"), F.round(when(F.col("recent"), up), 4).alias("base_rate_recent"))
    regime = F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("significant")
    return g.join(psi, "region").join(ics, "region", "left").withColumns({"regime": regime, "psi": F.round("psi", 4)})


def calibration_rows(spark, d) -> DataFrame:
    """A probability from text length against labelled quality."""
    docs = A.table(spark, d, "documents").select("doc_id", "n_chars")
    p = F.col("n_chars") / (F.col("n_chars") + 500.0)
    return A.table(spark, d, "labels").join(docs, "doc_id").select(p.alias("p"), F.col("quality").cast("double").alias("y"))


CAL = "select n_chars / (n_chars + 500.0) as p, cast(quality as double) as y from labels join documents using (doc_id)"


@query("select bin, n, round(predicted, 6) as predicted, round(observed, 6) as observed, round(sum(n * abs(predicted - observed)) over () / sum(n) over (), 6) as ece, round(brier, 6) as brier from (select cast(least(floor(p * 10), 9) as int) as bin, count(*) as n, avg(p) as predicted, avg(y) as observed from cal group by 1), (select avg((p - y) * (p - y)) as brier from cal)", {"cal": CAL})
def d18_reliability(spark, d):
    rows = calibration_rows(spark, d)
    bins = M.reliability(rows, "p", "y")
    w = Window.partitionBy(F.lit(0))  # ten bins
    brier = rows.agg(F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))
    ece = F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("observed"))).over(w) / F.sum("n").over(w)
    return bins.withColumn("ece", F.round(ece, 6)).crossJoin(brier).select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"), "ece", F.round("brier", 6).alias("brier"))


GOLD = "select lang, quality = 1 as gold, case when n_chars >= 300 then source <> 'src0' end as predicted from labels join documents using (doc_id)"
SCORES = "count(*) filter (gold and predicted) as tp, count(*) filter (not gold and predicted) as fp, count(*) filter (gold and not coalesce(predicted, false)) as fn"
ROUNDED = "tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2.0 * tp / nullif(2.0 * tp + fp + fn, 0), 6) as f1, round(cov, 6) as coverage"


def gold_rows(spark, d) -> DataFrame:
    docs = A.table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return A.table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("gold"), F.when(F.col("n_chars") >= 300, F.col("source") != "src0").alias("predicted"))


@query(f"select {ROUNDED} from (select {SCORES}, count(predicted) / count(*) as cov from gold)", {"gold": GOLD})
def d19_micro_scores(spark, d):
    rows = gold_rows(spark, d)
    return rows.agg(*M.micro_scores(rows, "gold", "predicted"))


@query(f"select *, round(avg(f1) over (), 4) as macro_f1, coalesce((select string_agg(lang, ',' order by lang) from strata where f1 is null), '') as omitted from strata", {"gold": GOLD, "strata": f"select lang, {ROUNDED} from (select lang, {SCORES}, count(predicted) / count(*) as cov from gold group by 1)"})
def d20_scores_by_stratum(spark, d):
    rows = gold_rows(spark, d)
    strata = rows.groupBy("lang").agg(*M.micro_scores(rows, "gold", "predicted"))
    every = Window.partitionBy(F.lit(0))  # a row per stratum
    omitted = F.array_join(F.sort_array(F.collect_list(F.when(F.col("f1").isNull(), F.col("lang"))).over(every)), ",")
    return strata.withColumns({"macro_f1": F.round(F.avg("f1").over(every), 4), "omitted": omitted})


@query("select round(min(j), 6) as worst, min_by(month, j) as month, round(avg(j), 6) as mean, avg(j) >= 0.5 as agrees from (select month, count(*) filter (a is not null and b is not null) / count(*) as j from (select coalesce(m.date, p.date) as month, m.ticker as a, p.ticker as b from membership m full join (select distinct date_trunc('month', date)::date as date, ticker from prices where volume > 30) p on p.date = m.date and p.ticker = m.ticker) group by 1)")
def d21_jaccard_verdict(spark, d):
    p = A.prices(spark, d).where("volume > 30").select(F.trunc("date", "month").alias("date"), "ticker").distinct().withColumn("b", F.lit(1))
    j = A.membership(spark, d).withColumn("a", F.lit(1)).join(p, ["date", "ticker"], "full").groupBy("date").agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("j"))
    return j.agg(F.round(F.min("j"), 6).alias("worst"), F.min_by("date", F.struct("j", "date")).alias("month"), F.round(F.avg("j"), 6).alias("mean"), (F.avg("j") >= 0.5).alias("agrees"))


COARSE = "select t.ticker, m.date, floor(p.close / 100) * 100 as x from (select distinct ticker from prices_monthly) t cross join (select distinct date from prices_monthly) m left join prices_monthly p on p.ticker = t.ticker and p.date = m.date where m.date not in (select date from prices_monthly group by date having date_part('month', date) = 5) or t.ticker like '%1'"
ANOM = {
    "coarse": COARSE,
    "moved": "select *, case when lag(x) over w <> 0 then abs(x / lag(x) over w - 1) when x <> 0 and lag(x) over w = 0 then 'inf'::double end as move, min(case when x is not null then date end) over (partition by ticker) as lo, max(case when x is not null then date end) over (partition by ticker) as hi, case when x = lag(x) over w then 0 else 1 end as new from (select t.ticker, m.date, c.x from (select distinct ticker from coarse) t cross join (select distinct date from coarse) m left join coarse c on c.ticker = t.ticker and c.date = m.date) window w as (partition by ticker order by date)",
    "stale": "select ticker, 'stale' as kind, sum(n)::bigint as count, max(n)::varchar as detail from (select ticker, run, count(x) as n from (select *, sum(new) over (partition by ticker order by date) as run from moved) group by 1, 2) where n >= 3 group by 1",
    "anom": "select ticker, 'nonpositive' as kind, count(*) as count, min(date)::varchar as detail from moved where x <= 0 group by 1 union all select ticker, 'interior_gap', count(*), '' from moved where x is null and date between lo and hi group by 1 union all select ticker, 'jump', count(*) filter (move > 0.1), printf('%.6f', coalesce(max(move) filter (move < 'inf'::double), 'inf'::double)) from moved group by 1 having count(*) filter (move > 0.1) > 0 union all select * from stale",
}


def anomalies(spark, d) -> DataFrame:
    """Defects of monthly prices in steps of a hundred, most of whose Mays are taken out."""
    p = A.prices_monthly(spark, d).select("date", "ticker", (F.floor(F.col("close") / 100) * 100).cast("double").alias("close")).where((F.month("date") != 5) | F.col("ticker").like("%1"))
    return M.price_anomalies(R.dense_grid(p), 0.1, 3)


@query("select * from anom", ANOM)
def d22_price_anomalies(spark, d):
    return anomalies(spark, d)


@query("select kind, sum(count)::bigint as n, count(distinct ticker) as tickers from anom group by 1", ANOM)
def d23_anomaly_summary(spark, d):
    return anomalies(spark, d).groupBy("kind").agg(F.sum("count").alias("n"), F.count_distinct("ticker").alias("tickers"))


VARIATION = "select date, feature, count(*) as n, count(x) as known, count(distinct x) as distinct_x, stddev_samp(x) as sd from (select date, 'close' as feature, close as x from prices_monthly union all select date, 'volume', volume from prices_monthly union all select date, 'lots', case when volume > 300 then 1.0 end from prices_monthly) group by 1, 2"
VERDICT = "case when known = 0 then 'empty' when distinct_x = 1 then 'constant' when coalesce(sd, 0) < 1e-12 then 'flat' when known / n < 0.5 then 'sparse' else 'ok' end"


def feature_panel(spark, d) -> DataFrame:
    return A.prices_monthly(spark, d).withColumn("lots", F.when(F.col("volume") > 300, 1.0))


@query(f"select date, feature, n, known, distinct_x as \"distinct\", round(sd, 6) as sd, {VERDICT} as verdict from variation", {"variation": VARIATION})
def d24_variation(spark, d):
    return M.variation(feature_panel(spark, d), "date", ["close", "volume", "lots"]).withColumn("sd", F.round("sd", 6))


@query(f"select feature, count(*) filter (v = 'ok') as passed, count(*) filter (v <> 'ok') as failed, count(*) filter (v <> 'ok') = 0 as keep from (select feature, {VERDICT} as v from variation) group by 1", {"variation": VARIATION})
def d25_variation_gate(spark, d):
    v = M.variation(feature_panel(spark, d), "date", ["close", "volume", "lots"])
    failed = F.count_if(F.col("verdict") != "ok")
    return v.groupBy("feature").agg(F.count_if(F.col("verdict") == "ok").alias("passed"), failed.alias("failed"), (failed == 0).alias("keep"))


@query("select round(count(close) / count(*), 6) as close, round(count(volume) / count(*), 6) as volume from grid")
def d26_coverage(spark, d):
    g = A.grid(spark, d)
    return g.agg(*[F.round(F.count(c) / F.count("*"), 6).alias(c) for c in ("close", "volume")])


@query("select sector, round(avg(z), 6) as mean_z, round(avg(least(abs(z), 3)), 6) as mean_abs_z, case when avg(z) > 0 then 'up' else 'down' end as direction from (select date, sector, (close - avg(close) over d) / stddev_samp(close) over d as z from (select date, replace(ticker, 'S', 'N') as ticker, close from prices_monthly) join sectors using (ticker) window d as (partition by date)) where z is not null group by 1")
def d27_theme_summary(spark, d):
    p = A.prices_monthly(spark, d).withColumn("ticker", F.regexp_replace("ticker", "^S", "N")).join(F.broadcast(A.sectors(spark, d)), "ticker")
    w = Window.partitionBy("date")
    p = p.withColumn("z", (F.col("close") - F.avg("close").over(w)) / F.stddev_samp("close").over(w)).where("z is not null")
    return p.groupBy("sector").agg(F.round(F.avg("z"), 6).alias("mean_z"), F.round(F.avg(F.least(F.abs("z"), F.lit(3.0))), 6).alias("mean_abs_z"), F.when(F.avg("z") > 0, "up").otherwise("down").alias("direction"))


@query("select ticker, date, round(m, 6) as mean, case when b is null then 'new' when m > b * 1.03 then 'rising' when m < b * 0.97 then 'falling' else 'steady' end as trend from (select ticker, date, close as m, avg(close) over (partition by ticker order by date rows between 6 preceding and 1 preceding) as b from prices_monthly)")
def d28_trend(spark, d):
    base = F.avg("close").over(R.prior_n(6))
    p = A.prices_monthly(spark, d).withColumn("b", base)
    trend = F.when(F.col("b").isNull(), "new").when(F.col("close") > F.col("b") * 1.03, "rising").when(F.col("close") < F.col("b") * 0.97, "falling").otherwise("steady")
    return p.select("ticker", "date", F.round("close", 6).alias("mean"), trend.alias("trend"))


NET = "select date_trunc('week', transaction_date)::date as week, ticker, sum(case when direction = 'buy' then 1 else -1 end) filter (party = 'D') as dem, sum(case when direction = 'buy' then 1 else -1 end) filter (party = 'R') as rep from member_trades group by 1, 2"


@query("select week, count(*) filter (dem <> 0 and rep <> 0) as both, round(count(*) filter (dem * rep < 0) / nullif(count(*) filter (dem <> 0 and rep <> 0), 0), 6) as opposed from net group by 1", {"net": NET})
def d29_party_opposition(spark, d):
    t = A.member_trades(spark, d).withColumn("side", F.when(F.col("direction") == "buy", 1).otherwise(-1))
    net = t.groupBy(F.to_date(F.date_trunc("week", "transaction_date")).alias("week"), "ticker").pivot("party", ["D", "R"]).agg(F.sum("side"))
    both = F.count_if((F.col("D") != 0) & (F.col("R") != 0))
    return net.groupBy("week").agg(both.alias("both"), F.round(F.try_divide(F.count_if(F.col("D") * F.col("R") < 0), both), 6).alias("opposed"))


@query("select party, ticker, count(*) filter (direction = 'buy') as buys, count(*) filter (direction = 'sell') as sells, sum(case when direction = 'buy' then 1 else -1 end)::bigint as net, count(distinct member) as members from member_trades where transaction_date >= (select max(transaction_date) - 10 from member_trades) group by 1, 2")
def d30_follow_list(spark, d):
    t = A.member_trades(spark, d)
    last = t.agg(F.max("transaction_date").alias("last"))
    t = t.crossJoin(F.broadcast(last)).where("transaction_date >= date_sub(last, 10)")  # one row
    buy = F.col("direction") == "buy"
    return t.groupBy("party", "ticker").agg(F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells"), F.sum(F.when(buy, 1).otherwise(-1)).alias("net"), F.count_distinct("member").alias("members"))


@query("select ticker, count(distinct event_id) as filings, count(distinct event_id) filter (event_type like '1%' or event_type like '2%') as urgent, max(event_date) as latest from study_events group by 1")
def d31_filer_directory(spark, d):
    e = A.study_events(spark, d).dropDuplicates(["event_id"])
    return e.groupBy("ticker").agg(F.count("*").alias("filings"), F.count_if(F.col("event_type").rlike("^[12]")).alias("urgent"), F.max("event_date").alias("latest"))


@query("select quarter, cusip, count(*) as funds, round(max(w), 6) as top_weight, string_agg(cast(manager as varchar), ',' order by manager) as held_by from (select *, v / sum(v) over (partition by quarter, manager) as w from bk) group by 1, 2 having count(*) >= 2", {"bk": BOOK})
def d32_fund_overlap(spark, d):
    b = book(spark, d).withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("quarter", "manager")))
    return b.groupBy("quarter", "cusip").agg(F.count("*").alias("funds"), F.round(F.max("w"), 6).alias("top_weight"), F.array_join(F.transform(F.sort_array(F.collect_list("manager")), lambda x: x.cast("string")), ",").alias("held_by")).where("funds >= 2")


@query("select member, string_agg(distinct direction, ',' order by direction) as roles, count(distinct ticker) as seats from member_trades group by 1")
def d33_person_rollup(spark, d):
    return A.member_trades(spark, d).groupBy("member").agg(F.array_join(F.sort_array(F.collect_set("direction")), ",").alias("roles"), F.count_distinct("ticker").alias("seats"))


@query("select ticker, date, round(latest, 6) as latest, round(z, 5) as z, round(avg(z) over (), 5) as mean_z, round(avg(abs(z)) over (), 5) as mean_abs_z from (select ticker, max(date) as date, max_by(close, date) as latest, (max_by(close, date) - avg(close)) / nullif(stddev_samp(close), 0) as z from prices_monthly group by 1)")
def d34_market_panel(spark, d):
    """Latest value of each market in deviations from its mean, and the composite of all markets."""
    latest = F.max_by("close", "date")
    g = A.prices_monthly(spark, d).groupBy("ticker").agg(F.max("date").alias("date"), latest.alias("latest"), ((latest - F.avg("close")) / F.nullif(F.stddev_samp("close"), F.lit(0.0))).alias("z"))
    whole = g.agg(F.round(F.avg("z"), 5).alias("mean_z"), F.round(F.avg(F.abs("z")), 5).alias("mean_abs_z"))
    return g.crossJoin(F.broadcast(whole)).select("ticker", "date", F.round("latest", 6).alias("latest"), F.round("z", 5).alias("z"), "mean_z", "mean_abs_z")  # one row


@query("select w.word as ticker, count(*) as mentions, round(avg(mood), 6) as sentiment, round(count(*) filter (mood > 0) / nullif(count(mood) filter (mood <> 0), 0), 6) as bull_ratio, cast(sum(score) as bigint) as score from (select distinct doc_id, n_chars % 100 as score, lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) as word from documents) w left join (select doc_id, avg(case when quality = 1 then 1.0 else -1.0 end) as mood from labels group by 1) l using (doc_id) where w.word in (select lower(unnest(string_split_regex(text, '[^A-Za-z]+'))) from benchmark) and length(w.word) >= 4 group by 1")
def d35_mention_snapshot(spark, d):
    """Words of the benchmark as tickers, posts that mention them, their mood (by label), share of bullish ones, and score."""
    words = lambda c: F.transform(F.split(c, "[^A-Za-z]+"), lambda w: F.lower(w))
    universe = A.table(spark, d, "benchmark").select(F.explode(words("text")).alias("ticker")).distinct().where(F.length("ticker") >= 4)
    posts = A.table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100).alias("score"), F.explode(F.array_distinct(words("text"))).alias("ticker")).join(universe, "ticker", "left_semi").distinct()
    mood = A.table(spark, d, "labels").groupBy("doc_id").agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(-1.0)).alias("mood"))
    m = F.col("mood")
    return posts.join(mood, "doc_id", "left").groupBy("ticker").agg(F.count("*").alias("mentions"), F.round(F.avg(m), 6).alias("sentiment"), F.round(F.try_divide(F.count_if(m > 0), F.count_if(m != 0)), 6).alias("bull_ratio"), F.sum("score").cast("long").alias("score"))


PRESSURE = "select *, case when prev <= 0 then (cur > 0)::int::double else (cur - prev) / prev::double end as velocity, case when sd < 1e-9 then 0 else (latest - mean) / sd end as z from (select ticker, arg_max(mentions, date) as latest, coalesce(sum(mentions) filter (date > last - 7), 0) as cur, coalesce(sum(mentions) filter (date <= last - 7 and date > last - 14), 0) as prev, avg(mentions) as mean, stddev_samp(mentions) as sd, coalesce(avg(sentiment), 0) as lean, count(*) as n_days from mentions, (select max(date) as last from mentions) where date > last - 30 group by 1 having count(*) >= 14)"


@query("select ticker, latest as latest_mentions, round(velocity, 4) as velocity, round(z, 4) as crowding_z, round(lean, 4) as lean, case when velocity >= 1 or z >= 2.5 then 'surge' when velocity >= 0.5 or z >= 1.5 then 'elevated' when velocity <= -0.3 and z <= -1 then 'quiet' else 'normal' end as grade, n_days from press", {"press": PRESSURE})
def d36_retail_pressure(spark, d):
    m = A.mentions(spark, d)
    m = m.crossJoin(F.broadcast(m.agg(F.max("date").alias("last"))))  # one row
    out = M.pressure(m, F.col("last"))
    return out.select("ticker", "latest_mentions", *[F.round(c, 4).alias(c) for c in ("velocity", "crowding_z", "lean")], "grade", "n_days")


@query("select 'prices' as name, count(*) as n, max(date) as as_of, true as present from prices union all select 'facts', count(*), max(filed), true from facts union all select 'mentions', count(*), max(date), true from mentions")
def d37_data_health(spark, d):
    out = None
    for name, df, c in (("prices", A.prices(spark, d), "date"), ("facts", A.facts(spark, d), "filed"), ("mentions", A.mentions(spark, d), "date")):
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max(c).alias("as_of"), (F.count("*") > 0).alias("present"))
        out = row if out is None else out.unionByName(row)
    return out


@query("select q.quarter, p.n as before, q.n as after, p.h is distinct from q.h as changed from (select quarter, count(*) as n, md5(string_agg(manager || cusip || option_type, ',' order by manager, cusip, option_type)) as h from holdings group by 1) q left join (select case when right(quarter, 1) = '4' then (left(quarter, 4)::int + 1) || 'Q1' else left(quarter, 4) || 'Q' || (right(quarter, 1)::int + 1) end as quarter, count(*) as n, md5(string_agg(manager || cusip || option_type, ',' order by manager, cusip, option_type)) as h from holdings group by 1) p using (quarter)")
def d38_change_registry(spark, d):
    from .join_queries import quarter_shift

    h = A.holdings(spark, d).select("quarter", "manager", "cusip", "option_type")
    prints = h.groupBy("quarter").agg(F.count("*").alias("after"), F.bit_xor(F.xxhash64("manager", "cusip", "option_type")).alias("h"))
    prior = prints.select(quarter_shift("quarter").alias("quarter"), F.col("after").alias("before"), F.col("h").alias("p"))
    return prints.join(prior, "quarter", "left").select("quarter", "before", "after", (~F.col("p").eqNullSafe(F.col("h"))).alias("changed"))


@query("select count(*) as attempted, count(*) filter (c is null) as failed, count(*) filter (c = 'low') as low from (select o.o_orderkey, case when count(l.l_orderkey) = 0 then null when count(l.l_orderkey) < 3 then 'low' else 'exact' end as c from (select * from orders order by o_orderdate desc, o_orderkey limit 500) o left join lineitem l on l.l_orderkey = o.o_orderkey group by 1)")
def d39_price_coverage(spark, d):
    newest = A.table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(500)
    j = newest.join(A.table(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("k"))
    return j.agg(F.count("*").alias("attempted"), F.count_if(F.col("k") == 0).alias("failed"), F.count_if((F.col("k") > 0) & (F.col("k") < 3)).alias("low"))


@query("select sector, median(n) as median_n, min(n) as min_n, max(n) as max_n from (select sector, date_trunc('month', date) as m, count(distinct ticker) as n from prices join sectors using (ticker) group by 1, 2) group by 1")
def d40_effective_breadth(spark, d):
    m = A.prices(spark, d).join(F.broadcast(A.sectors(spark, d)), "ticker").groupBy("sector", F.trunc("date", "month").alias("m")).agg(F.count_distinct("ticker").alias("n"))
    return m.groupBy("sector").agg(F.median("n").alias("median_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))


@query("select round(min(sd), 6) as low, round(median(sd), 6) as mid, round(max(sd), 6) as high, round(avg(sd * sqrt(n - 1)), 6) as ratio from (select ticker, count(ret) as n, stddev_samp(ret) as sd from rets group by 1)")
def d41_noise_floor(spark, d):
    s = returns(spark, d).groupBy("ticker").agg(F.count("ret").alias("n"), F.stddev_samp("ret").alias("sd"))
    return s.agg(F.round(F.min("sd"), 6).alias("low"), F.round(F.median("sd"), 6).alias("mid"), F.round(F.max("sd"), 6).alias("high"), F.round(F.avg(F.col("sd") * F.sqrt(F.col("n") - 1)), 6).alias("ratio"))


@query("select metric, count(*) as n, count(*) filter (date_diff('day', \"end\", filed) > 45) as late from facts group by 1")
def d42_late_filings(spark, d):
    return A.facts(spark, d).groupBy("metric").agg(F.count("*").alias("n"), F.count_if(F.datediff("filed", "end") > 45).alias("late"))


@query("select coalesce(m.date, p.date) as month, count(*) filter (p.ticker is null) as only_first, count(*) filter (m.ticker is null) as only_second, string_agg(case when p.ticker is null then m.ticker end, ',' order by m.ticker) as missing from membership m full join (select distinct date_trunc('month', date)::date as date, ticker from prices where volume > 30) p on p.date = m.date and p.ticker = m.ticker group by 1")
def d43_reconciliation(spark, d):
    p = A.prices(spark, d).where("volume > 30").select(F.trunc("date", "month").alias("date"), "ticker").distinct().withColumn("b", F.lit(1))
    j = A.membership(spark, d).withColumn("a", F.lit(1)).join(p, ["date", "ticker"], "full")
    lone = F.sort_array(F.collect_list(F.when(F.col("b").isNull(), F.col("ticker"))))
    return j.groupBy(F.col("date").alias("month")).agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.when(F.size(lone) > 0, F.array_join(lone, ",")).alias("missing"))


MURPHY = {
    "mf": "select doc_id, round(n_chars / (n_chars + 500.0), 2) as p, cast(quality as double) as y from labels join documents using (doc_id)",
    "mb": "select *, sb / nb as o, sum(nb) over () as n, sum(sb) over () / sum(nb) over () as base, row_number() over (order by p) as i, sum(nb) over (order by p) as cum from (select p, count(*) as nb, sum(y) as sb from mf group by 1)",
    "mc": "select e1, e2, e3, greatest(e4, e3 + 1) as e4 from (select e1, e2, greatest(e3, e2 + 1) as e3, e4 from (select e1, greatest(e2, e1 + 1) as e2, e3, e4 from (select " + ", ".join(f"arg_min(i, {{d: abs(cum - n * {b} / 5.0), i: i}}) as e{b}" for b in range(1, 5)) + " from mb)))",
    "me": "select sum(abs(sp - sy) / n) as ece from (select (i > e1)::int + (i > e2)::int + (i > e3)::int + (i > e4)::int as b, sum(p * nb) as sp, sum(sb) as sy, max(n) as n from mb, mc group by 1)",
    "mr": "select max(n) as n, sum(nb * (p - o) * (p - o)) / max(n) as rel, sum(nb * (o - base) * (o - base)) / max(n) as res, max(base * (1 - base)) as unc from mb",
}


def dated_forecasts(spark, d) -> DataFrame:
    docs = A.table(spark, d, "documents").select("doc_id", "n_chars")
    return A.table(spark, d, "labels").join(docs, "doc_id").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 500.0)).alias("p"), F.col("quality").cast("double").alias("y"))


@query("select n::bigint as n, round((select avg((p - y) * (p - y)) from mf), 6) as brier, round(rel, 6) as reliability, round(res, 6) as resolution, round(unc, 6) as uncertainty, round(ece, 6) as ece, round(1 - (select avg((p - y) * (p - y)) from mf) / unc, 6) as skill from mr, me", MURPHY)
def d44_murphy(spark, d):
    report, _ = M.murphy(dated_forecasts(spark, d), "p", "y", "doc_id", 2)
    return report.select("n", *[F.round(c, 6).alias(c) for c in ("brier", "reliability", "resolution", "uncertainty", "ece", "skill")])


@query("select doc_id, round(res - (n * res - nb * (o - base) * (o - base) + case when nb > 1 then (nb - 1) * ((sb - y) / (nb - 1) - base) * ((sb - y) / (nb - 1) - base) else 0 end) / (n - 1), 8) as delta from mf join (select mb.*, res from mb, mr) using (p)", MURPHY)
def d44_leave_one_out(spark, d):
    """By how much the resolution falls without each forecast."""
    _, each = M.murphy(dated_forecasts(spark, d), "p", "y", "doc_id", 2)
    return each.select("doc_id", F.round("delta", 8).alias("delta"))


@query("select min(date) as first, max(date) as last, min(n) as fewest, max(n) as most, min(n) >= 15 and max(n) <= 25 as ok from (select date, count(*) as n from membership group by 1)")
def d45_snapshot_integrity(spark, d):
    m = A.membership(spark, d).groupBy("date").agg(F.count("*").alias("n"))
    return m.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min("n").alias("fewest"), F.max("n").alias("most"), ((F.min("n") >= 15) & (F.max("n") <= 25)).alias("ok"))


THEMES = "select sector, date, avg(close) as m, row_number() over (partition by sector order by date desc) as k from (select date, replace(ticker, 'S', 'N') as ticker, close from prices_monthly) join sectors using (ticker) group by 1, 2"


@query("select sector, max(date) as as_of, round(max(m) filter (k = 1), 6) as latest, count(*) as months, string_agg(cast(cast(round(m * 100) as bigint) as varchar), ' ' order by date) filter (k <= 6) as tail, min(max(date)) over () as oldest, max(max(date)) over () as newest from themes group by sector", {"themes": THEMES})
def d46_theme_rollup(spark, d):
    """Per theme the latest cross-section mean, a tail of six, and how far the themes' freshness spreads."""
    p = A.prices_monthly(spark, d).withColumn("ticker", F.regexp_replace("ticker", "^S", "N")).join(F.broadcast(A.sectors(spark, d)), "ticker")
    m = p.groupBy("sector", "date").agg(F.avg("close").alias("m"))
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("sector").orderBy(F.desc("date"))))
    last = F.sort_array(F.collect_list(F.when(F.col("k") <= 6, F.struct("date", F.round(F.col("m") * 100).cast("long").alias("c")))))
    g = m.groupBy("sector").agg(F.max("date").alias("as_of"), F.round(F.max(F.when(F.col("k") == 1, F.col("m"))), 6).alias("latest"), F.count("*").alias("months"), F.array_join(F.transform(last, lambda x: x["c"].cast("string")), " ").alias("tail"))
    every = Window.partitionBy(F.lit(0))  # a row per theme
    return g.withColumns({"oldest": F.min("as_of").over(every), "newest": F.max("as_of").over(every)})


@query("select event_id, ts, json_keys.k as key, json_extract_string(props, '$.' || json_keys.k) as value from events, lateral (select unnest(json_keys(props)) as k) json_keys where event_type = 'purchase'")
def d47_ledger_flatten(spark, d):
    e = A.table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "ts", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", "ts", F.explode("m").alias("key", "value"))


@query("select event_id, ts, coalesce(case when event_id % 2 = 0 then event_type end, event_type || '?') as verdict, round(value, 2) as metric from events where event_type <> 'view' and event_type <> 'error'")
def d47_claim_timeline(spark, d):
    """Claims out of a mixed ledger: verdict and metric stand at different places in records of different shape."""
    path = scratch(spark, "ledger")
    e = A.table(spark, d, "events").where("event_type != 'view'").select("event_id", "ts", "event_type", F.round("value", 2).alias("v"))
    even, kind = F.col("event_id") % 2 == 0, F.when(F.col("event_type") == "error", "note").otherwise("claim")
    shaped = e.select("event_id", "ts", kind.alias("kind"), F.when(even, F.col("event_type")).alias("verdict"), F.when(~even, F.struct(F.concat("event_type", F.lit("?")).alias("verdict"), F.col("v").alias("metric"))).alias("result"), F.when(even, F.col("v")).alias("metric"))
    exact = {k: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" for k in ("timestampFormat", "timestampNTZFormat")}
    shaped.write.options(**exact).json(path)
    raw = spark.read.options(**exact).schema(f"event_id long, ts {dict(e.dtypes)['ts']}, kind string, verdict string, metric double, result struct<verdict: string, metric: double>").json(path)
    return raw.where("kind = 'claim'").select("event_id", "ts", F.coalesce("verdict", "result.verdict").alias("verdict"), F.coalesce("metric", "result.metric").alias("metric"))


@query("select user_id % 20 as study, 'h' || hour(ts) % 4 as horizon, case when day(ts) <= 15 then 'train' else 'test' end as phase, round(avg(value), 6) as result from events group by 1, 2, 3")
def d47_sweep_flatten(spark, d):
    """Sweeps as nested JSON, study to horizon to phase, flattened by exploding both maps."""
    path = scratch(spark, "sweeps")
    phase = F.when(F.dayofmonth("ts") <= 15, "train").otherwise("test")
    g = A.table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("study"), F.concat(F.lit("h"), (F.hour("ts") % 4).cast("string")).alias("horizon"), phase.alias("phase")).agg(F.round(F.avg("value"), 6).alias("result"))
    inner = g.groupBy("study", "horizon").agg(F.map_from_entries(F.collect_list(F.struct("phase", "result"))).alias("phases"))
    inner.groupBy("study").agg(F.map_from_entries(F.collect_list(F.struct("horizon", "phases"))).alias("results")).write.json(path)
    raw = spark.read.schema("study long, results map<string, map<string, double>>").json(path)
    flat = raw.select("study", F.explode("results").alias("horizon", "phases"))
    return flat.select("study", "horizon", F.explode("phases").alias("phase", "result"))


@query("select ticker, n::bigint as n, rank, (rank_before - rank) as rise from (select ticker, n, row_number() over (order by n desc, ticker) as rank, row_number() over (order by p desc, ticker) as rank_before from (select ticker, coalesce(sum(mentions) filter (date = date '2024-01-20'), 0) as n, coalesce(sum(mentions) filter (date = date '2024-01-19'), 0) as p from mentions group by 1)) where rank <= 50")
def d48_trending(spark, d):
    on = lambda day: F.coalesce(F.sum(F.when(F.col("date") == day, F.col("mentions"))), F.lit(0))
    m = A.mentions(spark, d).groupBy("ticker").agg(on("2024-01-20").alias("n"), on("2024-01-19").alias("p"))
    top = m.orderBy(F.desc("n"), "ticker").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "ticker")).cast("long"))  # 50 rows
    board = F.broadcast(top.select(F.col("ticker").alias("t"), F.col("p").alias("tp")))
    ahead = (F.col("p") > F.col("tp")) | ((F.col("p") == F.col("tp")) & (F.col("ticker") <= F.col("t")))
    before = m.crossJoin(board).groupBy("t").agg(F.count_if(ahead).alias("before"))  # each ticker is counted, none is sorted
    return top.join(before, F.col("ticker") == F.col("t")).select("ticker", "n", "rank", (F.col("before") - F.col("rank")).alias("rise"))
