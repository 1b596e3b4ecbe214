"""Queries on point-in-time joins, membership masks and other joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import joins as J
from ..operators import rolling as R
from ..operators.asof import align_to_sessions, as_of_dates, asof_join, mask_to_members, sessions_of
from .price_queries import labelled, returns
from .registry import query

MONTHS = "select distinct date, ticker from (select cast(date_trunc('month', date) as date) as date, ticker from prices)"
#: One fact for each (ticker, metric, filed): the latest period, then the largest value.
LATEST = 'select ticker, metric, filed, max_by(value, {s: "end", v: value}) as value, max("end") as "end" from facts group by ticker, metric, filed'


def month_keys(spark, d) -> DataFrame:
    return A.prices(spark, d).select(F.trunc("date", "month").alias("date"), "ticker").distinct()


def latest_facts(spark, d) -> DataFrame:
    return A.facts(spark, d).groupBy("ticker", "metric", "filed").agg(F.max_by("value", F.struct("end", "value")).alias("value"), F.max("end").alias("end"))


def pit_align(dates: DataFrame, facts: DataFrame, available: str = "filed", strict: bool = False) -> DataFrame:
    """(date, ticker, metric, value): the fact known at each date for every metric of the ticker."""
    metrics = facts.select("ticker", "metric").distinct()
    left = dates.join(metrics, "ticker")
    return asof_join(left, facts, "date", available, by=["ticker", "metric"], strict=strict, ties=("end", "value"))


PIT = "select m.date, m.ticker, k.metric, round(f.value, 4) as value from months m join (select distinct ticker, metric from facts) k using (ticker) asof left join latest f on f.ticker = m.ticker and f.metric = k.metric and m.date {op} f.filed"


@query(PIT.format(op=">="), {"months": MONTHS, "latest": LATEST})
def c01_pit_asof(spark, d):
    return pit_align(month_keys(spark, d), latest_facts(spark, d)).select("date", "ticker", "metric", F.round("value", 4).alias("value"))


LAG = 'select ticker, metric, avail, max_by(value, {s: "end", v: value}) as value from (select *, cast("end" + case when form = \'10-K\' then interval 6 month else interval 4 month end as date) as avail from facts) group by ticker, metric, avail'


@query("select m.date, m.ticker, k.metric, round(f.value, 4) as value from months m join (select distinct ticker, metric from facts) k using (ticker) asof left join lagged f on f.ticker = m.ticker and f.metric = k.metric and m.date >= f.avail", {"months": MONTHS, "lagged": LAG})
def c02_period_lag_asof(spark, d):
    avail = F.add_months("end", F.when(F.col("form") == "10-K", 6).otherwise(4))
    facts = A.facts(spark, d).withColumn("avail", avail).groupBy("ticker", "metric", "avail").agg(F.max_by("value", F.struct("end", "value")).alias("value"), F.max("end").alias("end"))
    return pit_align(month_keys(spark, d), facts, "avail").select("date", "ticker", "metric", F.round("value", 4).alias("value"))


FIRST = "select ref_date, min(realtime_start) as realtime_start, min_by(value, realtime_start) as value from vintages group by ref_date"


@query("select s.date, round(f.value, 4) as level from sessions s asof left join first_print f on s.date > f.realtime_start", {"first_print": FIRST})
def c03_strict_asof(spark, d):
    first = A.vintages(spark, d).groupBy("ref_date").agg(F.min("realtime_start").alias("realtime_start"), F.min_by("value", "realtime_start").alias("value"))
    dates = A.prices(spark, d).select("date").distinct()
    return asof_join(dates, first, "date", "realtime_start", strict=True, ties=("ref_date",)).select("date", F.round("value", 4).alias("level"))


PRIOR = 'select ticker, metric, "end", filed, max(value) as value from facts group by all'


@query('select a.ticker, a.metric, a."end", a.filed, round(a.value, 4) as value, round(f.value, 4) as prior from one a asof left join one f on f.ticker = a.ticker and f.metric = a.metric and f."end" = cast(a."end" - interval 3 month as date) and a.filed >= f.filed', {"one": PRIOR})
def c04_composite_key_asof(spark, d):
    facts = A.facts(spark, d).groupBy("ticker", "metric", "end", "filed").agg(F.max("value").alias("value"))
    left = facts.withColumn("prior_end", F.add_months("end", -3))
    right = facts.select("ticker", "metric", F.col("end").alias("prior_end"), F.col("filed").alias("known"), F.col("value").alias("prior"))
    return asof_join(left, right, "filed", "known", by=["ticker", "metric", "prior_end"]).select("ticker", "metric", "end", "filed", F.round("value", 4).alias("value"), F.round("prior", 4).alias("prior"))


@query("select a.ref_date, a.realtime_start, round(a.value - p.value, 4) as change from first_print a asof left join vintages p on p.ref_date = cast(a.ref_date - interval 1 month as date) and a.realtime_start > p.realtime_start", {"first_print": FIRST})
def c05_first_print_change(spark, d):
    v = A.vintages(spark, d)
    first = v.groupBy("ref_date").agg(F.min("realtime_start").alias("realtime_start"), F.min_by("value", "realtime_start").alias("value")).withColumn("prior_ref", F.add_months("ref_date", -1))
    known = v.select(F.col("ref_date").alias("prior_ref"), F.col("realtime_start").alias("known"), F.col("value").alias("prior"))
    out = asof_join(first, known, "realtime_start", "known", by=["prior_ref"], strict=True)
    return out.select("ref_date", "realtime_start", F.round(F.col("value") - F.col("prior"), 4).alias("change"))


@query("select g.date, g.ticker, cast(coalesce(date_diff('day', e.event_date, g.date) between 0 and 60, false) as int) as recent from (select date, ticker from prices) g asof left join (select distinct ticker, event_date from study_events) e on e.ticker = g.ticker and g.date >= e.event_date")
def c06_asof_tolerance(spark, d):
    events = A.study_events(spark, d).select("ticker", "event_date").distinct()
    out = asof_join(A.prices(spark, d).select("date", "ticker"), events, "date", "event_date", by=["ticker"], tolerance_days=60)
    return out.select("date", "ticker", F.col("event_date").isNotNull().cast("int").alias("recent"))


@query("select event_id, event_date, landed from (select e.event_id, e.event_date, min(s.date) as landed from study_events e join sessions s on s.date >= e.event_date group by 1, 2)")
def c07_forward_asof(spark, d):
    s = A.prices(spark, d).select(F.col("date").alias("landed")).distinct()
    return asof_join(A.study_events(spark, d).select("event_id", "event_date"), s, "event_date", "landed", forward=True, how="inner")


@query("select e.event_id, e.ticker, min(p.date) as trade_date, round(min_by(p.close, p.date), 6) as price from study_events e left join prices p on p.ticker = e.ticker and p.date > e.event_date group by 1, 2")
def c08_next_session_price(spark, d):
    p = A.prices(spark, d).select("ticker", F.col("date").alias("trade_date"), F.col("close").alias("price"))
    out = asof_join(A.study_events(spark, d).select("event_id", "ticker", "event_date"), p, "event_date", "trade_date", by=["ticker"], forward=True, strict=True)
    return out.select("event_id", "ticker", "trade_date", F.round("price", 6).alias("price"))


@query("select e.event_id, round(min_by(p.close, k), 6) as price, cast(min(case when p.close is not null then k end) as int) as days_back from study_events e cross join (select unnest([0, 1]) as k) left join prices p on p.ticker = e.ticker and p.date = e.event_date - cast(k as integer) group by 1 having count(p.close) > 0")
def c09_date_tolerance(spark, d):
    """Event date, else the day before: two offsets are exploded and equi-joined."""
    e = A.study_events(spark, d).select("event_id", "ticker", "event_date", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("date", F.expr("date_sub(event_date, k)"))
    return e.join(A.prices(spark, d).select("date", "ticker", "close"), ["date", "ticker"]).groupBy("event_id").agg(F.round(F.min_by("close", "k"), 6).alias("price"), F.min("k").alias("days_back"))


@query("select e.event_id, b.date as t_info_date, a.date as label_start_date, z.date as label_end_date from (select event_id, event_date, min(s.idx) as i from study_events join sessions s on s.date >= event_date group by 1, 2) e join sessions a on a.idx = e.i join sessions b on b.idx = e.i - 1 join sessions z on z.idx = e.i + 5")
def c10_event_alignment(spark, d):
    out = align_to_sessions(A.study_events(spark, d), sessions_of(A.prices(spark, d)), 5)
    return out.select("event_id", "t_info_date", "label_start_date", "label_end_date")


SNAPS = "select d.date, max(m.date) as snap from (select distinct date from prices) d join (select distinct date from membership) m on m.date <= d.date group by d.date"


@query("select p.date, p.ticker, round(p.close, 6) as close from prices p join snaps s on s.date = p.date join membership m on m.date = s.snap and m.ticker = p.ticker", {"snaps": SNAPS})
def c11_membership_mask(spark, d):
    return mask_to_members(A.prices(spark, d), A.membership(spark, d)).select("date", "ticker", F.round("close", 6).alias("close"))


@query("select p.date, p.ticker, round(p.close, 6) as close from (select date, replace(ticker, 'S', 'N') as ticker, close from prices_monthly) p where exists (select 1 from membership m where m.date = p.date and m.ticker = p.ticker)")
def c12_exact_date_members(spark, d):
    p = A.prices_monthly(spark, d).withColumn("ticker", F.regexp_replace("ticker", "^S", "N"))
    return p.join(A.membership(spark, d), ["date", "ticker"], "left_semi").select("date", "ticker", F.round("close", 6).alias("close"))


@query("select p.date, p.ticker, round(l.level, 4) as level from prices p left join (select s.date, f.value as level from sessions s asof left join first_print f on s.date > f.realtime_start) l on l.date = p.date", {"first_print": FIRST})
def c13_date_broadcast(spark, d):
    levels = c03_strict_asof(spark, d)  # one row a session
    return A.prices(spark, d).select("date", "ticker").join(F.broadcast(levels), "date", "left")


REGION = "select ticker, case when sector in ('ASIA', 'MIDDLE EAST') then 'cn' else 'us' end as region from sectors"


@query("select p.date, p.ticker, g.region, round(v.value, 4) as macro from prices_m p join (select ticker, case when sector in ('ASIA', 'MIDDLE EAST') then 'cn' else 'us' end as region from sectors) g using (ticker) left join (select 'us' as region, ref_date as date, min(value) as value from vintages group by ref_date union all select 'cn', ref_date, max(value) from vintages group by ref_date) v on v.region = g.region and v.date = p.date", {"prices_m": MONTHS})
def c14_region_macro(spark, d):
    regions = A.sectors(spark, d).select("ticker", F.when(F.col("sector").isin("ASIA", "MIDDLE EAST"), "cn").otherwise("us").alias("region"))
    v = A.vintages(spark, d).groupBy(F.col("ref_date").alias("date")).agg(F.min("value").alias("us"), F.max("value").alias("cn")).unpivot("date", ["us", "cn"], "region", "macro")
    return month_keys(spark, d).join(F.broadcast(regions), "ticker").join(v, ["region", "date"], "left").select("date", "ticker", "region", F.round("macro", 4).alias("macro"))


@query("select coalesce(a.date, b.date) as date, coalesce(a.ticker, b.ticker) as ticker, a.n_events, b.n_facts from (select event_date as date, ticker, count(*) as n_events from study_events group by 1, 2) a full join (select filed as date, ticker, count(*) as n_facts from facts group by 1, 2) b on a.date = b.date and a.ticker = b.ticker")
def c15_full_outer_assembly(spark, d):
    """Frames keyed (date, ticker) put side by side by one union and one aggregate: a single exchange for any number."""
    e = A.study_events(spark, d).select(F.col("event_date").alias("date"), "ticker", F.lit(1).alias("e"), F.lit(None).cast("int").alias("f"))
    f = A.facts(spark, d).select(F.col("filed").alias("date"), "ticker", F.lit(None).cast("int").alias("e"), F.lit(1).alias("f"))
    return e.unionByName(f).groupBy("date", "ticker").agg(F.sum("e").alias("n_events"), F.sum("f").alias("n_facts"))


@query("select count(*) as matched, 0 as bad_keys from prices")
def c16_one_to_one(spark, d):
    p = A.prices(spark, d)
    joined = J.one_to_one(p.select("date", "ticker", "close"), p.select("date", "ticker", "volume"), ["date", "ticker"])
    return joined.agg(F.count("*").alias("matched"), F.max("bad_keys").alias("bad_keys"))


def quarter_shift(q: str):
    """The quarter after a quarter named YYYYQn."""
    year, n = F.substring(q, 1, 4).cast("int"), F.substring(q, 6, 1).cast("int")
    return F.concat((year + (n == 4).cast("int")).cast("string"), F.lit("Q"), F.when(n == 4, 1).otherwise(n + 1).cast("string"))


AGG = "select quarter, manager, cusip, sum(shares) as shares from holdings group by 1, 2, 3"
NEXT = "select *, case when right(quarter, 1) = '4' then (left(quarter, 4)::int + 1) || 'Q1' else left(quarter, 4) || 'Q' || (right(quarter, 1)::int + 1) end as nq from book"


@query("select quarter, manager, cusip, round(before, 4) as before, round(after, 4) as after, change from (select coalesce(b.quarter, a.nq) as quarter, coalesce(a.manager, b.manager) as manager, coalesce(a.cusip, b.cusip) as cusip, a.shares as before, b.shares as after, case when a.shares is null then 'new' when b.shares is null then 'exited' when b.shares > a.shares then 'increased' when b.shares < a.shares then 'reduced' end as change from nxt a full join book b on a.nq = b.quarter and a.manager = b.manager and a.cusip = b.cusip) where change is not null", {"book": AGG, "nxt": NEXT})
def c17_frame_diff(spark, d):
    h = A.holdings(spark, d)
    before = h.withColumn("quarter", quarter_shift("quarter"))
    return J.frame_diff(before, h, ["quarter", "manager", "cusip"], "shares").select("quarter", "manager", "cusip", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), "change")


@query("with k as (select trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) as name, p_brand from part), o as (select name, min(p_brand) as brand from k group by name having count(distinct p_brand) = 1) select k.name, o.brand, count(*) as n from k left join o using (name) group by 1, 2")
def c18_exact_name_map(spark, d):
    """Names that one owner only has are mapped to it."""
    from ..functions.text import normal_name

    k = A.table(spark, d, "part").select(normal_name(F.col("p_name")).alias("name"), "p_brand")
    owners = k.groupBy("name").agg(F.min("p_brand").alias("brand"), F.count_distinct("p_brand").alias("owners")).where("owners = 1").drop("owners")
    return k.join(owners, "name", "left").groupBy("name", "brand").agg(F.count("*").alias("n"))


@query("select c.c_custkey, d.s_name from customer c left join (select s_nationkey, cast(round(s_acctbal / 1000) as bigint) as band, min(s_name) as s_name from supplier group by 1, 2 having count(distinct s_name) = 1) d on d.s_nationkey = c.c_nationkey and d.band = cast(round(c.c_acctbal / 1000) as bigint)")
def c19_corroborated_lookup(spark, d):
    band = lambda c: F.round(F.col(c) / 1000).cast("long")
    rows = A.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), band("c_acctbal").alias("band"))
    directory = A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), band("s_acctbal").alias("band"), "s_name")
    return J.unique_lookup(rows, directory, ["nation", "band"], "s_name").select("c_custkey", "s_name")


@query("select date, ticker, round(score, 6) as score, round(y, 6) as y, y > 0 as realized_up from eom")
def c20_score_pairs(spark, d):
    return labelled(spark, d).select("date", "ticker", F.round("score", 6).alias("score"), F.round("y", 6).alias("y"), (F.col("y") > 0).alias("realized_up"))


@query("select p.ticker, coalesce(s.sector, 'Unclassified') as sector, count(*) as n from prices_monthly p left join (select replace(ticker, 'N', 'S') as ticker, sector from sectors) s using (ticker) group by 1, 2")
def c21_dimension_default(spark, d):
    s = A.sectors(spark, d).withColumn("ticker", F.regexp_replace("ticker", "^N", "S"))
    return A.prices_monthly(spark, d).join(F.broadcast(s), "ticker", "left").groupBy("ticker", F.coalesce("sector", F.lit("Unclassified")).alias("sector")).agg(F.count("*").alias("n"))


MEND = "select ticker, date, close from (select *, max(date) over (partition by ticker, date_trunc('month', date)) as last from prices) where date = last"


@query("select g.date, g.ticker, round(m.close, 6) as exposure from grid g asof left join mend m on m.ticker = g.ticker and g.date > m.date", {"mend": MEND})
def c22_month_end_carry(spark, d):
    ends = R.end_of_month(A.prices(spark, d), "ticker").select("ticker", F.col("date").alias("as_of"), F.col("close").alias("exposure"))
    return asof_join(A.grid(spark, d).select("date", "ticker"), ends, "date", "as_of", by=["ticker"], strict=True).select("date", "ticker", F.round("exposure", 6).alias("exposure"))


SIGNS = "select * from (values ('ASIA', '1-URGENT', 1), ('EUROPE', '1-URGENT', -1), ('AMERICA', '2-HIGH', 1), ('AFRICA', '3-MEDIUM', -1), ('MIDDLE EAST', '5-LOW', 1), ('ASIA', '2-HIGH', -1)) t(sector, event_type, sign)"


@query("select e.landed as date, s.ticker, cast(sum(g.sign) as bigint) as shock from (select event_id, event_type, min(s.date) as landed from study_events join sessions s on s.date >= event_date group by 1, 2) e join signs g on g.event_type = e.event_type join sectors s on s.sector = g.sector group by 1, 2", {"signs": SIGNS})
def c23_sign_table(spark, d):
    rows = [("ASIA", "1-URGENT", 1), ("EUROPE", "1-URGENT", -1), ("AMERICA", "2-HIGH", 1), ("AFRICA", "3-MEDIUM", -1), ("MIDDLE EAST", "5-LOW", 1), ("ASIA", "2-HIGH", -1)]
    signs = spark.createDataFrame(rows, "sector string, event_type string, sign int")
    sessions = A.prices(spark, d).select(F.col("date").alias("landed")).distinct()
    landed = asof_join(A.study_events(spark, d).select("event_type", "event_date"), sessions, "event_date", "landed", forward=True, how="inner")
    return landed.join(F.broadcast(signs), "event_type").join(F.broadcast(A.sectors(spark, d)), "sector").groupBy(F.col("landed").alias("date"), "ticker").agg(F.sum("sign").alias("shock"))


@query("with x as (select distinct quarter, manager, cusip from holdings) select a.quarter, a.manager as a, b.manager as b, count(*) as w, array_to_string(list_slice(list_sort(list(a.cusip)), 1, 8), ',') as shared, count(*) > 8 as truncated from x a join x b on a.quarter = b.quarter and a.cusip = b.cusip and a.manager < b.manager group by 1, 2, 3")
def c24_shared_items(spark, d):
    return J.shared_items(A.holdings(spark, d), "manager", "cusip", by=["quarter"]).withColumn("shared", F.array_join("shared", ","))


@query("select event_id, ticker from member_trades t where not exists (select 1 from member_trades b where b.ticker = t.ticker and b.party <> t.party and b.transaction_date = t.transaction_date)")
def c25_anti_join(spark, d):
    t = A.member_trades(spark, d)
    other = t.select("ticker", "transaction_date", F.when(F.col("party") == "D", "R").otherwise("D").alias("party")).distinct()
    return t.join(other, ["ticker", "transaction_date", "party"], "left_anti").select("event_id", "ticker")


LANES = "select 'N' || c_nationkey as ticker, 'customer' as lane, cast(c_custkey as varchar) as item from customer union all select 'N' || s_nationkey, 'supplier', cast(s_suppkey as varchar) from supplier union all select ticker, 'event', cast(event_id as varchar) from study_events"


def lanes(spark, d) -> DataFrame:
    n = lambda c: F.concat(F.lit("N"), F.col(c).cast("string")).alias("ticker")
    a = A.table(spark, d, "customer").select(n("c_nationkey"), F.lit("customer").alias("lane"), F.col("c_custkey").cast("string").alias("item"))
    b = A.table(spark, d, "supplier").select(n("s_nationkey"), F.lit("supplier").alias("lane"), F.col("s_suppkey").cast("string").alias("item"))
    c = A.study_events(spark, d).select("ticker", F.lit("event").alias("lane"), F.col("event_id").cast("string").alias("item"))
    return a.unionByName(b).unionByName(c)


@query("select ticker, string_agg(distinct lane, ',' order by lane) as lanes, count(distinct lane) as n_lanes, count(distinct lane || item) as items from lanes group by ticker having count(distinct lane) >= 2", {"lanes": LANES})
def c26_lane_bridge(spark, d):
    counted = lanes(spark, d).groupBy("ticker", "lane").agg(F.count_distinct("item").alias("n"))
    return counted.groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("lanes"), F.count("*").alias("n_lanes"), F.sum("n").alias("items")).where("n_lanes >= 2")


DAILY = "select date, ticker from prices"


@query("with l as (select date_trunc('month', date)::date as month, max(date) as date from prices group by 1), dl as (select l.month, p.ticker from l join prices p using (date)) select coalesce(m.date, dl.month) as month, count(*) filter (m.ticker is not null and dl.ticker is not null) as both, count(*) as either, round(count(*) filter (m.ticker is not null and dl.ticker is not null) / count(*), 6) as jaccard from membership m full join dl on dl.month = m.date and dl.ticker = m.ticker group by 1")
def c27_monthly_daily_match(spark, d):
    p = A.prices(spark, d).withColumn("month", F.trunc("date", "month"))
    last = p.withColumn("l", F.max("date").over(Window.partitionBy("month"))).where("date = l").select("month", "ticker", F.lit(1).alias("daily"))
    m = A.membership(spark, d).select(F.col("date").alias("month"), "ticker", F.lit(1).alias("monthly"))
    both = F.count_if(F.col("daily").isNotNull() & F.col("monthly").isNotNull())
    return m.join(last, ["month", "ticker"], "full").groupBy("month").agg(both.alias("both"), F.count("*").alias("either"), F.round(both / F.count("*"), 6).alias("jaccard"))


@query("select t.ticker, coalesce(f.n, 0) as facts, coalesce(e.n, 0) as events, coalesce(p.n, 0) as sessions from sectors t left join (select ticker, count(*) as n from facts group by 1) f using (ticker) left join (select ticker, count(*) as n from study_events group by 1) e using (ticker) left join (select ticker, count(*) as n from prices group by 1) p using (ticker)")
def c28_hit_rollup(spark, d):
    hits = None
    for name, df in (("facts", A.facts(spark, d)), ("events", A.study_events(spark, d)), ("sessions", A.prices(spark, d))):
        part = df.groupBy("ticker").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
        hits = part if hits is None else hits.unionByName(part)
    wide = hits.groupBy("ticker").pivot("kind", ["facts", "events", "sessions"]).agg(F.sum("n"))
    return A.sectors(spark, d).select("ticker").join(wide, "ticker", "left").na.fill(0)


@query("select a.date, round(a.ret, 6) as strategy, round(m.mkt, 6) as factor from (select date, ret from rets where ticker = 'N1' and ret is not null) a join mkt m on m.date = a.date")
def c29_factor_join(spark, d):
    r = returns(spark, d)
    factor = r.groupBy("date").agg(F.avg("ret").alias("factor"))
    return r.where("ticker = 'N1' and ret is not null").join(factor, "date").select("date", F.round("ret", 6).alias("strategy"), F.round("factor", 6).alias("factor"))


@query("select s.date, s.snap, date_diff('day', s.snap, s.date) as age, count(*) as members, sha256(string_agg(m.ticker, ',' order by m.ticker)) as digest from snaps s join membership m on m.date = s.snap group by 1, 2", {"snaps": SNAPS})
def c30_member_manifest(spark, d):
    mapped = as_of_dates(A.prices(spark, d), A.membership(spark, d))
    sets = A.membership(spark, d).groupBy(F.col("date").alias("snap")).agg(F.count("*").alias("members"), F.sha2(F.array_join(F.sort_array(F.collect_list("ticker")), ","), 256).alias("digest"))
    return mapped.join(F.broadcast(sets), "snap").select("date", "snap", F.datediff("date", "snap").cast("long").alias("age"), "members", "digest")


@query("with a as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) as k, p_name, p_type from part), f as (select k, min(p_partkey) as id from a group by k) select a.p_partkey, f.id as resolved, len(list_intersect(string_split(a.k, ' '), string_split(trim(regexp_replace(lower(a.p_type), '[^a-z0-9]+', ' ', 'g')), ' '))) = 0 as mismatch from a join f using (k)")
def c31_identifier_resolution(spark, d):
    from ..functions.text import tokens

    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    a = A.table(spark, d, "part").select("p_partkey", key("p_name").alias("k"), key("p_type").alias("t"))
    first = a.groupBy("k").agg(F.min("p_partkey").alias("resolved"))
    return a.join(first, "k").select("p_partkey", "resolved", (~F.arrays_overlap(tokens(F.col("k")), tokens(F.col("t")))).alias("mismatch"))


@query("select ticker, priority, count(*) as n from (select *, min(priority) over (partition by ticker) as best from (select date, ticker, 0 as priority from prices_monthly where cast(substr(ticker, 2) as int) % 2 = 0 union all select date, 'S' || substr(ticker, 2), 1 from prices)) where priority = best group by 1, 2")
def c32_source_priority(spark, d):
    first = A.prices_monthly(spark, d).where(F.substring("ticker", 2, 9).cast("int") % 2 == 0).select("date", "ticker")
    second = A.prices(spark, d).select("date", F.concat(F.lit("S"), F.substring("ticker", 2, 9)).alias("ticker"))
    return J.by_priority([first, second], "ticker").groupBy("ticker", "priority").agg(F.count("*").alias("n"))
