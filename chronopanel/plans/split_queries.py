"""Queries on time splits, controls, baselines, calibration and assembled panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import boosting as B
from ..operators import components as C
from ..operators import monitor as M
from ..operators import rolling as R
from ..operators import splits as S
from ..operators.asof import align_to_sessions, asof_join, mask_to_members, sessions_of
from ..shared import stored
from .inference_queries import monthly_returns
from .price_queries import labelled, returns, with_market
from .registry import query

PANEL = "select *, cast(date + interval 1 month as date) as label_end from (select date, ticker, close, lead(close) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where y is not null"
FOLDS = "select b as fold, min(date) as test_start, max(date) as test_end from (select date, ntile(5) over (order by date) - 1 as b from (select distinct date from pan)) where b > 0 group by 1"
TAGGED = "select p.*, f.fold, case when date between test_start and test_end then 'test' when date < test_start and label_end <= test_start then 'train' end as role from pan p, folds f"
WF = {"pan": PANEL, "folds": FOLDS, "tagged": TAGGED}


def panel(spark, d) -> DataFrame:
    p = A.prices_monthly(spark, d).select("date", "ticker", "close", R.forward_return(1).alias("y")).where("y is not null")
    return p.withColumn("label_end", F.add_months("date", 1))


def tagged(spark, d) -> DataFrame:
    p = panel(spark, d)
    return S.tag_walk_forward(p, S.walk_forward_folds(p, "date", 4), "date", "label_end")


@query("select cast(fold as int) as fold, role, count(*) as n, min(date) as first, max(date) as last from tagged where role is not null group by 1, 2", WF)
def k01_walk_forward(spark, d):
    return tagged(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


KF = "select cast((dense_rank() over (order by date) - 1) % 4 as int) as own, * from pan"


@query("select fold, role, count(*) as n from (select own as fold, 'test' as role from kf union all select f.fold, 'train' from kf p, (select unnest([0, 1, 2, 3]) as fold) f where p.own <> f.fold and not exists (select 1 from (select distinct own, date as lo, label_end as hi from kf) t where t.own = f.fold and p.date <= t.hi + 5 and p.label_end >= t.lo)) group by 1, 2", WF | {"kf": KF})
def k02_group_kfold(spark, d):
    return S.tag_group_kfold(panel(spark, d), "date", "date", "label_end", 4, 5).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("select cast(fold as int) as fold, max(date) filter (role = 'train') as train_last, max(label_end) filter (role = 'train') as label_last, min(date) filter (role = 'test') as test_first, max(date) filter (role = 'train') < min(date) filter (role = 'test') and max(label_end) filter (role = 'train') <= min(date) filter (role = 'test') as ok from tagged group by 1", WF)
def k03_chronology(spark, d):
    return S.chronology(tagged(spark, d), "date", "label_end")


@query("select t.region, t.date as fold, count(*) filter (p.date < t.date) as train, count(*) filter (p.date = t.date) as test from (select distinct region, date from regional qualify dense_rank() over (partition by region order by date) > 60) t join regional p on p.region = t.region and p.date <= t.date group by 1, 2", WF | {"regional": "select *, case when right(ticker, 1) < '5' then 'a' else 'b' end as region from pan"})
def k04_monthly_walk_forward(spark, d):
    """Each month of a region tests on the region's months before it, from 60 on: counts from one running sum."""
    region = F.when(F.right("ticker", F.lit(1)) < "5", "a").otherwise("b")
    m = panel(spark, d).groupBy(region.alias("region"), "date").agg(F.count("*").alias("test"))
    w = Window.partitionBy("region").orderBy("date")
    m = m.withColumns({"train": F.sum("test").over(w.rowsBetween(Window.unboundedPreceding, -1)), "i": F.row_number().over(w)})
    return m.where("i > 60").select("region", F.col("date").alias("fold"), "train", "test")


@query("with s as (select max(idx) - 30 as pos from sessions), p as (select date as test_date from sessions, s where idx = pos), t as (select date as cutoff from sessions, s where idx = pos - 5) select count(*) filter (g.date <= cutoff) as train, count(*) filter (g.date = test_date) as test, count(distinct g.ticker) filter (g.date = test_date) as tickers from member_panel g, p, t")
def k05_predict_date_split(spark, d):
    s = sessions_of(A.prices(spark, d))
    at = s.agg(F.max("idx").alias("n"))
    pos = s.crossJoin(at).agg(F.max(F.when(F.col("idx") == F.col("n") - 30, F.col("date"))).alias("test_date"), F.max(F.when(F.col("idx") == F.col("n") - 35, F.col("date"))).alias("cutoff"))
    members = mask_to_members(A.grid(spark, d).select("date", "ticker"), A.membership(spark, d)).crossJoin(F.broadcast(pos))  # one row
    test = F.col("date") == F.col("test_date")
    return members.agg(F.count_if(F.col("date") <= F.col("cutoff")).alias("train"), F.count_if(test).alias("test"), F.count_distinct(F.when(test, F.col("ticker"))).alias("tickers"))


@query("select p.date, cast(len(list_filter(e.q, lambda x: p.y > x)) as int) as bin, count(*) as n from pan p join (select date, quantile_cont(y, [0.25, 0.5, 0.75]) as q from pan where date < date '2000-01-01' group by 1 union all select d.date, (select quantile_cont(y, [0.25, 0.5, 0.75]) from pan where date < date '2000-01-01') from (select distinct date from pan where date >= date '2000-01-01') d) e using (date) group by 1, 2", WF)
def k06_relevance_bins(spark, d):
    """Bins per training month; months after training use the pooled edges."""
    p = panel(spark, d)
    train = p.where("date < '2000-01-01'")
    edges = M.inner_edges(train, "y", 4, ["date"])
    pooled = M.inner_edges(train, "y", 4).withColumnRenamed("edges", "pooled")
    j = p.join(edges, "date", "left").crossJoin(F.broadcast(pooled))  # one row
    return j.groupBy("date", M.bucket(F.col("y"), F.coalesce("edges", "pooled")).alias("bin")).agg(F.count("*").alias("n"))


SHIFT = "15 + ('0x' || substr(md5('11|' || ticker), 1, 8))::bigint % 76"


@query(f"select ticker, metric, filed, cast(filed + cast({SHIFT} as int) as date) as shifted, count(*) as n from facts group by all")
def k07_lag_shift_control(spark, d):
    """Filing dates moved by 15 to 90 days, the same for all rows of a key."""
    from ..operators.inference import text_hash

    shift = (F.pmod(text_hash(F.lit(11), "ticker"), F.lit(76)) + 15).cast("int")
    return A.facts(spark, d).groupBy("ticker", "metric", "filed", F.date_add("filed", shift).alias("shifted")).agg(F.count("*").alias("n"))


FACT_KEY = "concat_ws('|', ticker, \"end\", filed, form, printf('%.2f', value))"


@query(f"select p.ticker, p.metric, p.filed, v.value from (select *, row_number() over (partition by metric, date_trunc('month', filed) order by {FACT_KEY}) as i from facts) p join (select metric, date_trunc('month', filed) as month, value, row_number() over (partition by metric, date_trunc('month', filed) order by md5('5|' || {FACT_KEY}), {FACT_KEY}) as i from facts) v on v.metric = p.metric and v.month = date_trunc('month', p.filed) and v.i = p.i")
def k08_month_placebo(spark, d):
    """Values permuted inside (metric, filing month): who filed what and when stays, the values move."""
    f = A.facts(spark, d).withColumns({"month": F.trunc("filed", "month"), "key": F.concat_ws("|", "ticker", F.col("end").cast("string"), F.col("filed").cast("string"), "form", F.format_string("%.2f", "value"))})
    return S.hash_permuted(f, "value", ["metric", "month"], ["key"], 5).select("ticker", "metric", "filed", "value")


@query("select p.date, p.ticker, round(v.close, 10) as close from (select *, row_number() over (partition by date order by ticker) as i from prices_monthly) p join (select date, close, row_number() over (partition by date order by md5('9|' || ticker), ticker) as i from prices_monthly) v using (date, i)")
def k09_cross_section_shuffle(spark, d):
    """Values permuted across the tickers of each date."""
    return S.hash_permuted(A.prices_monthly(spark, d), "close", ["date"], ["ticker"], 9).select("date", "ticker", F.round("close", 10).alias("close"))


DAILY = "select date, case when count(*) >= 12 then round(avg(close), 6) end as level from prices group by 1"


@query("select d.date, v.level from (select *, row_number() over (order by date) as i from daily where level is not null) d join (select level, row_number() over (order by md5('4|' || date), date) as i from daily where level is not null) v using (i) union all select date, null from daily where level is null", {"daily": DAILY})
def k09_date_shuffle(spark, d):
    """A series that all names share, permuted across the dates on which it is known; gaps stay where they are."""
    daily = A.prices(spark, d).groupBy("date").agg(F.when(F.count("*") >= 12, F.round(F.avg("close"), 6)).alias("level"))
    return S.known_permuted(daily, "level", [], ["date"], 4).select("date", "level")


@query("select d.vec_id, v.source, v.label from (select vec_id, row_number() over (order by vec_id) as i from embeddings) d join (select vec_id as source, label, row_number() over (order by md5('6|' || vec_id), vec_id) as i from embeddings) v using (i)")
def k09_vector_relabel(spark, d):
    """Every event gets another event's vector."""
    e = A.table(spark, d, "embeddings").select("vec_id", F.struct(F.col("vec_id").alias("source"), "label", "embedding").alias("v"))
    return S.hash_permuted(e, "v", [], ["vec_id"], 6).select("vec_id", "v.source", "v.label")


ARMS = {
    "mc": "select ticker, cast(date_trunc('month', date) as date) as month, max_by(close, date) as close from prices group by 1, 2",
    "lay": "select *, cast((dense_rank() over (order by month) - 1) % 4 as int) as own from (select ticker, month, lead(close) over (partition by ticker order by month) / close - 1 as y from mc) where y is not null",
    "fa": "select ticker, filed as known, max(value) as value from facts where metric = '1-URGENT' group by 1, 2",
    "fp": "select ticker, cast(\"end\" + case when form = '10-K' then interval 6 month else interval 4 month end as date) as known, max(value) as value from facts where metric = '1-URGENT' group by 1, 2",
    "armed": "select 'filed' as arm, l.*, f.value from lay l asof left join fa f on f.ticker = l.ticker and l.month >= f.known union all select 'period', l.*, f.value from lay l asof left join fp f on f.ticker = l.ticker and l.month >= f.known",
    "afit": "select arm, fold, regr_slope(y, ln(value)) as b, regr_intercept(y, ln(value)) as a from armed, (select unnest([0, 1, 2, 3]) as fold) where (own + 2) % 4 = fold and value > 0 group by 1, 2",
}


@query("select arm, fold, count(*) as n, round(avg(abs(y - (a + b * ln(value)))), 6) as mae, (select count(*) = 0 from (select ticker, month, count(distinct arm) as arms, count(*) as k from armed group by 1, 2) where arms <> 2 or k <> 2) as same_layout from armed join afit using (arm) where own = fold and value > 0 group by 1, 2", ARMS)
def k10_two_arms(spark, d):
    """Two arms, by filing date and by period end with a lag, out of sample on shared folds of months: a fold is predicted
    from months that are not next to any of it. The arms must hold the same rows."""
    p = A.prices(spark, d).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))
    by = R.by_ticker(order="month")
    layout = p.select("ticker", "month", (F.lead("close").over(by) / F.col("close") - 1).alias("y")).where("y is not null")
    months = layout.select("month").distinct().withColumn("own", (F.dense_rank().over(Window.orderBy("month")) - 1) % 4)  # a calendar
    layout = layout.join(F.broadcast(months), "month")
    facts = A.facts(spark, d).where("metric = '1-URGENT'")
    avail = F.add_months("end", F.when(F.col("form") == "10-K", 6).otherwise(4))
    arms = None
    for name, known in (("filed", F.col("filed")), ("period", avail)):
        f = facts.groupBy("ticker", known.alias("known")).agg(F.max("value").alias("value"))
        arm = asof_join(layout, f, "month", "known", by=["ticker"]).select(F.lit(name).alias("arm"), "ticker", "month", "own", "y", "value")
        arms = arm if arms is None else arms.unionByName(arm)
    arms = stored(arms, "arms")
    check = arms.groupBy("ticker", "month").agg(F.count_distinct("arm").alias("arms"), F.count("*").alias("k")).agg((F.count_if((F.col("arms") != 2) | (F.col("k") != 2)) == 0).alias("same_layout"))
    known = arms.where("value > 0").withColumn("x", F.log("value"))
    train = known.withColumns({"fold": (F.col("own") + 2) % 4, "role": F.lit("train")})
    tagged = train.unionByName(known.withColumns({"fold": F.col("own"), "role": F.lit("test")}))
    return S.fit_lines(tagged, "x", "y", by=["arm"]).groupBy("arm", "fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("score"))), 6).alias("mae")).crossJoin(F.broadcast(check))  # one row


@query("select t.fold, count(*) as n, round(any_value(m.b), 6) as slope, round(sqrt(avg((t.y - (m.a + m.b * ln(t.close))) * (t.y - (m.a + m.b * ln(t.close))))), 6) as rmse from tagged t join (select fold, regr_slope(y, ln(close)) as b, regr_intercept(y, ln(close)) as a from tagged where role = 'train' group by 1 having count(*) >= 10) m using (fold) where t.role = 'test' group by 1", WF)
def k11_fold_fit(spark, d):
    """A least-squares line per fold with frozen parameters: fitted by sums over the training rows, applied by a join."""
    scored = S.fit_lines(tagged(spark, d).withColumn("x", F.log("close")), "x", "y")
    return scored.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.round(F.max("slope"), 6).alias("slope"), F.round(F.sqrt(F.avg((F.col("y") - F.col("score")) ** 2)), 6).alias("rmse"))


TREE_PANEL = "select *, cast(date + interval 1 month as date) as label_end from (select date, ticker, close as x1, close / lag(close) over w - 1 as x2, close / lag(close, 3) over w - 1 as x3, volume / lag(volume) over w - 1 as x4, lead(close) over w / close - 1 as y from prices_monthly window w as (partition by ticker order by date)) where y is not null"
TREES = B.BoostingParams(trees=6, depth=2, learning_rate=0.2, bins=8, feature_fraction=1.0, bagging_fraction=1.0, stage=3)
TREE_FEATURES = ["x1", "x2", "x3", "x4"]


def boosting_sql(p: B.BoostingParams, features: list[str]) -> str:
    """The trees as a chain of tables: per level the sums by bin, the best cut of every node, and the rows' next node."""
    k = len(features)
    cuts = ", ".join(f"list_sort(list_distinct(quantile_cont({x}, [{', '.join(f'{i}/{p.bins}.0' for i in range(1, p.bins))}]))) as e{i}" for i, x in enumerate(features))
    cell = ", ".join(f"case when {x} is null then 0 else 1 + len(list_filter(e{i}, lambda e: e < {x})) end" for i, x in enumerate(features))
    known = "role = 'train' and y is not null"
    parts = [
        f"edges as materialized (select fold, {cuts}, count(*) as n from tagged where {known} group by fold)",
        f"unit as materialized (select pow(2.0, ceil(log2(max(abs(y)))) - 24) as scale from tagged where {known})",
        f"bases as materialized (select fold, round_even(sum(cast(round_even(y / scale, 0) as bigint))::double / count(*), 0) * scale as base from tagged, unit where {known} group by fold, scale)",
        f"s0 as materialized (select fold, role, date, ticker, y, [{cell}] as b, base as total from tagged join edges using (fold) join bases using (fold) where role is not null)",
    ]
    for t in range(p.trees):
        parts.append(f"n{t}_0 as materialized (select s{t}.*, 0 as node, cast(round_even((y - total) / scale, 0) as bigint) as g from s{t}, unit)")
        for d in range(p.depth):
            rows = f"(select fold, node, g, b[unnest(range(1, {k + 1}))] as b, unnest(range({k})) as f from n{t}_{d} where role = 'train')"
            parts.append(f"h{t}_{d} as materialized (select fold, node, f, b, sum(sum(g)) over w as gl, sum(count(*)) over w as nl, sum(sum(g)) over v as g, sum(count(*)) over v as n from {rows} group by fold, node, f, b window w as (partition by fold, node, f order by b), v as (partition by fold, node, f))")
            part = lambda g, c: f"pow(({g})::double * scale, 2) / ({c} + {p.reg_lambda})"
            gain = f"{part('gl', 'nl')} + {part('g - gl', 'n - nl')} - {part('g', 'n')}"
            # a cut between two filled bins is found at the lower one; bins without rows only repeat it
            parts.append(f"c{t}_{d} as materialized (select fold, node, f, b, gl, nl, g, n, gain from (select *, {gain} as gain from h{t}_{d}, unit where nl >= {p.min_child} and n - nl >= {p.min_child}) where gain > 1e-12 qualify row_number() over (partition by fold, node order by gain desc, f, b) = 1)")
            parts.append(f"n{t}_{d + 1} as materialized (select r.* replace (2 * r.node + 1 + case when c.fold is not null and r.b[c.f + 1] > c.b then 1 else 0 end as node) from n{t}_{d} r left join c{t}_{d} c on c.fold = r.fold and c.node = r.node)")
        leaf = f"select fold, node, {p.learning_rate} * (sum(g)::double * scale) / (count(*) + {p.reg_lambda}) as v from n{t}_{p.depth}, unit where role = 'train' group by fold, node, scale"
        parts.append(f"s{t + 1} as materialized (select r.fold, role, date, ticker, y, b, total + coalesce(v, 0) as total from n{t}_{p.depth} r left join ({leaf}) l on l.fold = r.fold and l.node = r.node)")
    return f"with {', '.join(parts)} select cast(fold as int) as fold, date, ticker, round(total, 6) as score, round(y, 6) as y from s{p.trees} where role = 'test'"


@query(boosting_sql(TREES, TREE_FEATURES), WF | {"pan": TREE_PANEL})
def k11_boosted_trees(spark, d):
    """Out-of-fold scores of boosted trees with frozen parameters, on returns, price and change of volume."""
    by = R.by_ticker()
    close, volume = F.col("close"), F.col("volume")
    p = A.prices_monthly(spark, d).select(
        "date", "ticker", close.alias("x1"), (close / F.lag("close").over(by) - 1).alias("x2"), (close / F.lag("close", 3).over(by) - 1).alias("x3"), (volume / F.lag("volume").over(by) - 1).alias("x4"), R.forward_return(1).alias("y")
    ).where("y is not null").withColumn("label_end", F.add_months("date", 1))
    t = stored(S.tag_walk_forward(p, S.walk_forward_folds(p, "date", 4), "date", "label_end"), "tagged")
    out = B.boosted_scores(t, TREE_FEATURES, "y", ["date", "ticker"], TREES)
    return out.select("fold", "date", "ticker", F.round("score", 6).alias("score"), F.round("y", 6).alias("y"))


WEEKS = {
    "wk": "select ticker, week, max_by(close, date) as close from (select ticker, date, close, cast(date_trunc('week', date) as date) as week from prices) group by 1, 2",
    "wp": "select * from (select ticker, week, close / lag(close) over (partition by ticker order by week) - 1 as x, lead(close) over (partition by ticker order by week) / close - 1 as y from wk) where x is not null and y is not null",
    "ws": "select week, count(*) as n, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(x * y) as xy from wp group by 1",
    "wc": "select week, sum(n) over w as n, sum(x) over w as x, sum(y) over w as y, sum(xx) over w as xx, sum(xy) over w as xy from ws window w as (order by week rows between unbounded preceding and 5 preceding)",
    "wf": "select week, n, (n * xy - x * y) / (n * xx - x * x) as b, (y - (n * xy - x * y) / (n * xx - x * x) * x) / n as a from wc where n >= 5000",
}


@query("select year(p.week) as year, count(*) as n, round(avg(abs(y - (f.a + f.b * p.x))), 6) as refit, round(avg(abs(y - (z.a + z.b * p.x))), 6) as frozen from wp p join wf f using (week), (select * from wf order by week limit 1) z group by 1", WEEKS)
def k12_frozen_vs_refit(spark, d, least: int = 5000):
    """A line fitted once, and one fitted anew each week on all weeks up to five before it (so that their labels are known),
    from 5,000 rows on. Fits are running sums over weeks: no week is read twice."""
    w = A.prices(spark, d).groupBy("ticker", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.max_by("close", "date").alias("close"))
    by = R.by_ticker(order="week")
    p = w.select("ticker", "week", (F.col("close") / F.lag("close").over(by) - 1).alias("x"), (F.lead("close").over(by) / F.col("close") - 1).alias("y")).where("x is not null and y is not null")
    sums = p.groupBy("week").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    before = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, -5)  # weeks
    c = sums.select("week", *[F.sum(k).over(before).alias(k) for k in ("n", "sx", "sy", "sxx", "sxy")]).where(f"n >= {least}")
    b = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fits = c.select("week", b.alias("b"), ((F.col("sy") - b * F.col("sx")) / F.col("n")).alias("a"))
    frozen = fits.agg(F.min_by("a", "week").alias("fa"), F.min_by("b", "week").alias("fb"))
    j = p.join(F.broadcast(fits), "week").crossJoin(F.broadcast(frozen))  # weeks, one row
    err = lambda a, b: F.round(F.avg(F.abs(F.col("y") - (F.col(a) + F.col(b) * F.col("x")))), 6)
    return j.groupBy(F.year("week").cast("long").alias("year")).agg(F.count("*").alias("n"), err("a", "b").alias("refit"), err("fa", "fb").alias("frozen"))


AR_PANEL = "select *, cast(date + interval 1 month as date) as label_end from (select date, ticker, close, close / lag(close) over (partition by ticker order by date) - 1 as ret_1, lead(close) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where y is not null"


@query("select t.fold, round(avg(abs(t.y)), 6) as zero, round(avg(abs(t.y - m.p)), 6) as mean, round(avg((t.y > 0)::int), 6) as always_up, round(avg(abs(t.y - coalesce(m.a + m.b * t.ret_1, m.p))), 6) as ar1 from tagged t join (select fold, avg(y) as p, regr_slope(y, ret_1) as b, regr_intercept(y, ret_1) as a from tagged where role = 'train' group by 1) m using (fold) where t.role = 'test' group by 1", WF | {"pan": AR_PANEL})
def k13_naive_baselines(spark, d):
    """Errors of no change, of the training mean, of a first-order autoregression (the mean where the last return is not
    known), and how often it went up."""
    p = A.prices_monthly(spark, d).select("date", "ticker", "close", R.simple_return().alias("ret_1"), R.forward_return(1).alias("y")).where("y is not null").withColumn("label_end", F.add_months("date", 1))
    t = S.tag_walk_forward(p, S.walk_forward_folds(p, "date", 4), "date", "label_end")
    m = t.where("role = 'train'").groupBy("fold").agg(F.avg("y").alias("p"), F.regr_slope("y", "ret_1").alias("b"), F.regr_intercept("y", "ret_1").alias("a"))
    j = t.where("role = 'test'").join(F.broadcast(m), "fold")  # a row per fold
    err = lambda c: F.round(F.avg(F.abs(F.col("y") - c)), 6)
    ar = F.coalesce(F.col("a") + F.col("b") * F.col("ret_1"), F.col("p"))
    return j.groupBy(F.col("fold").cast("long").alias("fold")).agg(err(F.lit(0.0)).alias("zero"), err(F.col("p")).alias("mean"), F.round(F.avg((F.col("y") > 0).cast("int")), 6).alias("always_up"), err(ar).alias("ar1"))


LIFT = "select date, avg(((ret > 0) = (lagged > 0))::int) - avg((ret > 0)::int) as lift from (select *, lag(ret) over (partition by ticker order by date) as lagged from (select date, ticker, close / lag(close) over (partition by ticker order by date) - 1 as ret from prices_monthly)) where ret is not null and lagged is not null group by 1"


def lifts(spark, d) -> DataFrame:
    r = monthly_returns(spark, d).withColumn("lagged", F.lag("ret").over(R.by_ticker())).where("ret is not null and lagged is not null")
    hit = F.avg(((F.col("ret") > 0) == (F.col("lagged") > 0)).cast("int"))
    return r.groupBy("date").agg((hit - F.avg((F.col("ret") > 0).cast("int"))).alias("lift"))


@query("select date, round(lift, 6) as lift from lift", {"lift": LIFT})
def k14_accuracy_lift(spark, d):
    return lifts(spark, d).select("date", F.round("lift", 6).alias("lift"))


@query("select round(avg(lift) filter (date < date '1999-01-01'), 6) as before, round(avg(lift) filter (date >= date '1999-01-01'), 6) as after, round(avg(lift) filter (date < date '1999-01-01') - avg(lift) filter (date >= date '1999-01-01'), 6) as gap from lift", {"lift": LIFT})
def k15_cutoff_gap(spark, d):
    old = F.avg(F.when(F.col("date") < "1999-01-01", F.col("lift")))
    new = F.avg(F.when(F.col("date") >= "1999-01-01", F.col("lift")))
    return lifts(spark, d).agg(F.round(old, 6).alias("before"), F.round(new, 6).alias("after"), F.round(old - new, 6).alias("gap"))


def platt_ctes(steps: int) -> dict[str, str]:
    """CTEs pr (rows), pf (folds), pt (training rows of folds), w0.. (coefficients after each Newton step)."""
    out = {
        "pr": "select case when right(ticker, 1) < '5' then 'a' else 'b' end as region, date as month, close / 1000 as s, (y > 0)::int as u from pan",
        "pf": "select distinct region, month as fold from pr qualify dense_rank() over (partition by region order by month desc) <= 6",
        "pt": "select f.region, f.fold, s, u from pr p join pf f on f.region = p.region and p.month < f.fold",
        "w0": "select region, fold, 0.0::double as a, 0.0::double as b from pf",
    }
    for k in range(steps):
        sums = f"select region, fold, a, b, sum(u - q) as g0, sum((u - q) * s) as g1, sum(q * (1 - q) + 1e-6) as h00, sum((q * (1 - q) + 1e-6) * s) as h01, sum((q * (1 - q) + 1e-6) * s * s) as h11 from (select t.*, w.a, w.b, 1 / (1 + exp(-(w.a + w.b * t.s))) as q from pt t join w{k} w using (region, fold)) group by 1, 2, 3, 4"
        out[f"w{k + 1}"] = f"select region, fold, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01 + 1e-9) as a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01 + 1e-9) as b from ({sums})"
    return out


@query("select p.region, p.month, any_value(w.fold) = max(any_value(w.fold)) over (partition by p.region) as latest, round(any_value(a), 5) as intercept, round(any_value(b), 5) as slope, count(*) as n, round(avg(1 / (1 + exp(-(a + b * s)))), 6) as predicted, round(avg(u), 6) as observed, round(avg((1 / (1 + exp(-(a + b * s))) - u) * (1 / (1 + exp(-(a + b * s))) - u)), 6) as brier from pr p join w5 w on w.region = p.region and w.fold = p.month group by 1, 2", WF | platt_ctes(5))
def k16_platt_calibration(spark, d):
    """Score to probability of a rise: per region, each of the last six months is calibrated on all months before it, the
    latest included. Newton steps whose sums are grouped aggregates over one stored table of training sums' rows."""
    side = F.when(F.substring("ticker", -1, 1) < "5", "a").otherwise("b")
    p = stored(panel(spark, d).select(side.alias("region"), F.col("date").alias("month"), (F.col("close") / 1000).alias("s"), (F.col("y") > 0).cast("double").alias("u")), "calibration")
    folds = p.select("region", "month").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy("region").orderBy(F.desc("month")))).where("k <= 6").select("region", F.col("month").alias("fold"))  # a calendar
    train = p.join(F.broadcast(folds), "region").where("month < fold").select("region", "fold", "s", "u")
    w = folds.withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    for _ in range(5):
        q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("s"))))
        j = train.join(F.broadcast(w), ["region", "fold"]).withColumns({"g": F.col("u") - q, "h": q * (1 - q) + 1e-6})  # a row per fold
        sums = j.groupBy("region", "fold").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.sum("g").alias("g0"), F.sum(F.col("g") * F.col("s")).alias("g1"), F.sum("h").alias("h00"), F.sum(F.col("h") * F.col("s")).alias("h01"), F.sum(F.col("h") * F.col("s") * F.col("s")).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01") + 1e-9
        step = lambda x, y, g, h: (F.col(x) * F.col(g) - F.col(y) * F.col(h)) / det
        w = stored(sums.select("region", "fold", (F.col("a") + step("h11", "h01", "g0", "g1")).alias("a"), (F.col("b") + step("h00", "h01", "g1", "g0")).alias("b")), "platt")
    prob = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("s"))))
    g = p.join(F.broadcast(w.withColumnRenamed("fold", "month")), ["region", "month"]).withColumn("p", prob).groupBy("region", "month").agg(
        F.round(F.max("a"), 5).alias("intercept"), F.round(F.max("b"), 5).alias("slope"), F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("u"), 6).alias("observed"), F.round(F.avg((F.col("p") - F.col("u")) ** 2), 6).alias("brier")
    )
    return g.withColumn("latest", F.col("month") == F.max("month").over(Window.partitionBy("region")))


K17 = "with labels21 as (select *, lead(close, 21) over (partition by ticker order by date) / close - 1 as y from grid), f as (select ticker, metric, filed, max_by(value, {s: \"end\", v: value}) as value from facts group by all), pit as (select g.date, g.ticker, k.metric, f.value from (select date, ticker from grid) g cross join (select unnest(['1-URGENT', '2-HIGH']) as metric) k asof left join f on f.ticker = g.ticker and f.metric = k.metric and g.date >= f.filed), wide as (select date, ticker, max(value) filter (metric = '1-URGENT') as urgent, max(value) filter (metric = '2-HIGH') as high from pit group by 1, 2), snaps as (select d.date, max(m.date) as snap from (select distinct date from grid) d join (select distinct date from membership) m on m.date <= d.date group by d.date) select l.date, l.ticker, round(l.close, 6) as close, round(l.y, 6) as y, round(w.urgent, 4) as urgent, round(w.high, 4) as high, round(case when abs(w.high) >= 1e-9 then w.urgent / w.high end, 6) as ratio, round(mk.mkt, 6) as mkt from labels21 l join wide w using (date, ticker) join snaps s using (date) join membership m on m.date = s.snap and m.ticker = l.ticker left join mkt mk on mk.date = l.date"


@query(K17)
def k17_selection_panel(spark, d):
    """The flagship panel: grid, label, point-in-time facts, ratios, market, membership. Facts of all metrics come in one
    as-of pass over one exchange by ticker; the market is a small table by date, so the panel is not dealt anew for it."""
    g = stored(returns(spark, d).withColumn("y", R.forward_return(21)), "returns")
    g = g.join(F.broadcast(g.groupBy("date").agg(F.avg("ret").alias("mkt"))), "date")  # a calendar
    wide = A.facts(spark, d).where(F.col("metric").isin("1-URGENT", "2-HIGH"))
    wide = wide.groupBy("ticker", "metric", "filed").agg(F.max_by("value", F.struct("end", "value")).alias("value"))
    pit = wide.groupBy("ticker", "filed").pivot("metric", ["1-URGENT", "2-HIGH"]).agg(F.max("value"))
    known = R.by_ticker(order="filed").rowsBetween(Window.unboundedPreceding, 0)
    pit = pit.select("ticker", "filed", F.last("1-URGENT", True).over(known).alias("urgent"), F.last("2-HIGH", True).over(known).alias("high"))
    full = asof_join(g, pit, "date", "filed", by=["ticker"])
    from ..operators.joins import safe_divide

    full = mask_to_members(full, A.membership(spark, d))
    return full.select(
        "date", "ticker", F.round("close", 6).alias("close"), F.round("y", 6).alias("y"), F.round("urgent", 4).alias("urgent"), F.round("high", 4).alias("high"),
        F.round(safe_divide(F.col("urgent"), F.col("high")), 6).alias("ratio"), F.round("mkt", 6).alias("mkt"),
    )


@query("select date, ticker, round(score, 6) as mom, round(close, 6) as close, round(y, 6) as y from eom")
def k18_regional_panel(spark, d):
    return labelled(spark, d).select("date", "ticker", F.round("score", 6).alias("mom"), F.round("close", 6).alias("close"), F.round("y", 6).alias("y"))


@query("select s.date, round(f.value, 4) as level, round(round(f.value, 4) - lag(round(f.value, 4)) over (order by s.date), 4) as change from sessions s asof left join (select ref_date, min(realtime_start) as realtime_start, min_by(value, realtime_start) as value from vintages group by ref_date) f on s.date > f.realtime_start")
def k19_macro_features(spark, d):
    from .join_queries import c03_strict_asof

    levels = c03_strict_asof(spark, d)
    return levels.select("date", "level", F.round(F.col("level") - F.lag("level").over(Window.orderBy("date")), 4).alias("change"))  # a calendar


@query("select e.event_id, e.event_type, b.date as t_info_date, round(r.ret, 6) as ret, round(r.mkt, 6) as mkt from (select event_id, event_type, ticker, event_date, min(s.idx) as i from study_events join sessions s on s.date >= event_date group by 1, 2, 3, 4) e join sessions b on b.idx = e.i - 1 join sessions z on z.idx = e.i + 5 join retm r on r.date = b.date and r.ticker = e.ticker where r.ret is not null")
def k20_design_matrix(spark, d):
    aligned = align_to_sessions(A.study_events(spark, d), sessions_of(A.prices(spark, d)), 5)
    state = with_market(spark, d).select(F.col("date").alias("t_info_date"), "ticker", "ret", "mkt").where("ret is not null")
    return aligned.join(state, ["t_info_date", "ticker"]).select("event_id", "event_type", "t_info_date", F.round("ret", 6).alias("ret"), F.round("mkt", 6).alias("mkt"))


KINDS = {"event_type": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "status": ("F", "O", "P"), "segment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), "side": ("debt", "credit")}
ONE_HOT = ", ".join(f"coalesce(({c} = '{v}')::int, 0) as {c}_{i}" for c, vs in KINDS.items() for i, v in enumerate(vs))


@query(f"select event_id, {ONE_HOT}, round(ln(1 + value), 6) as log_value, round(balance / 1000, 6) as balance from (select o_orderkey as event_id, o_orderpriority as event_type, o_orderstatus as status, c_mktsegment as segment, case when c_acctbal < 0 then 'debt' else 'credit' end as side, o_totalprice as value, c_acctbal as balance from orders join customer on c_custkey = o_custkey)")
def k21_event_vectors(spark, d):
    """Four enums as indicators (all 0 for a value that is not listed) and two numbers."""
    side = F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit")
    e = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = e.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"), side.alias("side"), "o_totalprice", "c_acctbal")
    hot = [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{i}") for c, vs in KINDS.items() for i, v in enumerate(vs)]
    return e.select("event_id", *hot, F.round(F.log1p("o_totalprice"), 6).alias("log_value"), F.round(F.col("c_acctbal") / 1000, 6).alias("balance"))


@query()
def k21_embedding_components(spark, d):
    """Events with a vector: label as indicators, its length, and the vector on its eight axes of largest variance."""
    e = A.table(spark, d, "embeddings")
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = C.event_vectors(e.withColumn("kind", F.col("label").cast("string")), {"kind": [str(i) for i in range(10)]}, {"size": F.round(size, 5)}, "embedding", 8)
    return out.select("vec_id", *[f"kind_{i}" for i in range(10)], "size", *[F.round(f"emb_{i}", 5).alias(f"emb_{i}") for i in range(8)])


@query("select m.date, m.ticker, round(f.value, 4) as fact, round(l.value, 4) as macro from (select distinct date, ticker from prices_m) m asof left join (select ticker, filed, max(value) as value from facts group by 1, 2) f on f.ticker = m.ticker and m.date >= f.filed left join (select d.date, v.value from (select distinct date from prices_m) d asof left join (select ref_date, min(realtime_start) as realtime_start, min_by(value, realtime_start) as value from vintages group by ref_date) v on d.date > v.realtime_start) l on l.date = m.date", {"prices_m": "select cast(date_trunc('month', date) as date) as date, ticker from prices"})
def k22_surprise_bundle(spark, d):
    from .join_queries import month_keys

    keys = month_keys(spark, d)
    f = A.facts(spark, d).groupBy("ticker", "filed").agg(F.max("value").alias("fact"))
    v = A.vintages(spark, d).groupBy("ref_date").agg(F.min("realtime_start").alias("known"), F.min_by("value", "realtime_start").alias("macro"))
    macro = asof_join(keys.select("date").distinct(), v, "date", "known", strict=True, ties=("ref_date",)).select("date", "macro")
    return asof_join(keys, f, "date", "filed", by=["ticker"]).join(F.broadcast(macro), "date", "left").select("date", "ticker", F.round("fact", 4).alias("fact"), F.round("macro", 4).alias("macro"))


@query("select coalesce(a.date, b.date) as date, coalesce(a.ticker, b.ticker) as ticker, coalesce(a.own, 0) as own, coalesce(b.peers, 0) as peers from (select landed as date, ticker, count(*) as own from le group by 1, 2) a full join (select l.landed as date, s.ticker, count(*) as peers from le l join sectors x on x.ticker = l.ticker join sectors s on s.sector = x.sector and s.ticker <> l.ticker group by 1, 2) b on a.date = b.date and a.ticker = b.ticker", {"le": "select e.event_id, e.ticker, min(s.date) as landed from study_events e join sessions s on s.date >= e.event_date group by 1, 2"})
def k23_forward_features(spark, d):
    """Own and peer shocks on the session where they land: one union and one aggregate."""
    sessions = A.prices(spark, d).select(F.col("date").alias("landed")).distinct()
    e = asof_join(A.study_events(spark, d).select("event_id", "ticker", "event_date"), sessions, "event_date", "landed", forward=True, how="inner")
    s = A.sectors(spark, d)
    peers = e.join(F.broadcast(s), "ticker").join(F.broadcast(s.withColumnRenamed("ticker", "peer")), "sector").where("peer != ticker")
    own = e.select("landed", "ticker", F.lit(1).alias("own"), F.lit(0).alias("peers"))
    other = peers.select("landed", F.col("peer").alias("ticker"), F.lit(0).alias("own"), F.lit(1).alias("peers"))
    return own.unionByName(other).groupBy(F.col("landed").alias("date"), "ticker").agg(F.sum("own").alias("own"), F.sum("peers").alias("peers"))
