"""Queries on projections, checks, sorts, set operations, text and scalar functions, and the entity graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as T
from ..operators import joins as J
from ..operators import rolling as R
from ..operators.asof import asof_join
from ..operators.graph import connected_components, isolated, node_table
from ..operators.sampling import stratified_sample
from .registry import query


@query("select date, ticker, round(close, 6) as close, 'n' as region from prices where date >= date '1998-01-01'")
def b01_prune_filter_tag(spark, d):
    return A.prices(spark, d).where("date >= '1998-01-01'").select("date", "ticker", F.round("close", 6).alias("close"), F.lit("n").alias("region"))


@query("select l_orderkey, l_linenumber, round(case when abs(l_discount) >= 1e-9 then l_tax / l_discount end, 6) as ratio from lineitem")
def b03_safe_divide(spark, d):
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(J.safe_divide(F.col("l_tax"), F.col("l_discount")), 6).alias("ratio"))


@query("select c_custkey, case when c_acctbal > 0 and c_nationkey > 3 then round(c_acctbal / c_nationkey, 6) end as ratio from customer")
def b04_conditional_null(spark, d):
    keep = (F.col("c_acctbal") > 0) & (F.col("c_nationkey") > 3)
    return A.table(spark, d, "customer").select("c_custkey", F.when(keep, F.round(F.col("c_acctbal") / F.col("c_nationkey"), 6)).alias("ratio"))


@query("select c_custkey, greatest(least(round(c_acctbal / 1000, 6), 5.0), -5.0) as z from customer")
def b05_clip(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", R.clipped(F.round(F.col("c_acctbal") / 1000, 6), 5.0).alias("z"))


@query("select l_orderkey, l_linenumber, case when l_linestatus = 'O' then l_quantity end as quantity, case when l_linestatus = 'O' then l_extendedprice end as price from lineitem")
def b06_suspension_mask(spark, d):
    keep = lambda c: F.when(F.col("l_linestatus") == "O", F.col(c))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", keep("l_quantity").alias("quantity"), keep("l_extendedprice").alias("price"))


@query("select o_orderkey, case when o_orderstatus is not null then (o_orderstatus <> 'O')::int end as suspended from orders")
def b07_suspension_flag(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "O").cast("int").alias("suspended"))


@query("select date, ticker, round(abs(close / lag(close) over (partition by ticker order by date) - 1) / 0.1, 6) as proximity from prices_monthly")
def b08_limit_proximity(spark, d):
    return A.prices_monthly(spark, d).select("date", "ticker", F.round(F.abs(R.simple_return()) / 0.1, 6).alias("proximity"))


@query("select count(*) as n, count(*) filter (ts is null or ts > timestamp '2024-01-20') as violations from events")
def b09_clock_gate(spark, d):
    bad = F.col("ts").isNull() | (F.col("ts") > F.lit("2024-01-20").cast("timestamp"))
    return A.table(spark, d, "events").agg(F.count("*").alias("n"), F.count_if(bad).alias("violations"))


@query("select count(*) as n, 0 as violations from (select distinct date_trunc('month', date) as m, p.ticker, metric from prices p join facts f on f.ticker = p.ticker)")
def b10_pit_boundary(spark, d):
    from .join_queries import latest_facts, month_keys

    metrics = latest_facts(spark, d).select("ticker", "metric").distinct()
    left = month_keys(spark, d).join(metrics, "ticker")
    j = asof_join(left, latest_facts(spark, d), "date", "filed", by=["ticker", "metric"])
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("filed") > F.col("date")).cast("int").alias("violations"))


@query("select k as field, count(*) as n, k in ('k', 'outcome', 'label') as forbidden from (select unnest(json_keys(props)) as k from events) group by 1")
def b11_forbidden_fields(spark, d):
    keys = A.table(spark, d, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("field"))
    return keys.groupBy("field").agg(F.count("*").alias("n")).withColumn("forbidden", F.col("field").isin("k", "outcome", "label"))


@query("select date, ticker, round(y, 6) as y from (select date, ticker, lead(close) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where date >= date '2001-06-01' or y is not null")
def b12_retain_unlabelled(spark, d):
    p = A.prices_monthly(spark, d).select("date", "ticker", F.round(R.forward_return(1), 6).alias("y"))
    return p.where("date >= '2001-06-01' or y is not null")


@query("select page_id, url from pages where url like 'https://%' and html is not null and length(html) > 0")
def b13_stream_filter(spark, d):
    return A.table(spark, d, "pages").where(F.col("url").startswith("https://") & (F.length("html") > 0)).select("page_id", "url")


@query("select date, ticker, round(y, 6) as y from (select date, ticker, close, lead(close) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where y is not null and floor(close / 500) <> 3")
def b14_valid_samples(spark, d):
    p = A.prices_monthly(spark, d).withColumn("y", R.forward_return(1)).where("y is not null and floor(close / 500) <> 3")
    return p.select("date", "ticker", F.round("y", 6).alias("y"))


@query("with c as (select (select max(date) from prices) as last, (select count(distinct ticker) from prices) as tickers, (select max(filed) from facts) as filed, (select max(date) from membership) as snap, (select count(distinct ticker) from membership) as members) select tickers, members, case when last is null then 'no_prices' when tickers < 10 then 'price_coverage' when date_diff('day', filed, last) > 400 then 'stale_facts' when date_diff('day', snap, last) > 40 then 'stale_membership' when members <> tickers then 'universe' else 'ready' end as reason from c")
def b15_readiness_gate(spark, d):
    p = A.prices(spark, d).agg(F.max("date").alias("last"), F.count_distinct("ticker").alias("tickers"))
    f = A.facts(spark, d).agg(F.max("filed").alias("filed"))
    m = A.membership(spark, d).agg(F.max("date").alias("snap"), F.count_distinct("ticker").alias("members"))
    reason = (
        F.when(F.col("last").isNull(), "no_prices").when(F.col("tickers") < 10, "price_coverage").when(F.datediff("last", "filed") > 400, "stale_facts")
        .when(F.datediff("last", "snap") > 40, "stale_membership").when(F.col("members") != F.col("tickers"), "universe").otherwise("ready")
    )
    return p.crossJoin(f).crossJoin(m).select("tickers", "members", reason.alias("reason"))  # single rows


@query("select date, ticker, side, k from (select date, ticker, 'long' as side, row_number() over (partition by date order by close desc, ticker) as k from prices_monthly union all select date, ticker, 'short', row_number() over (partition by date order by close, ticker) from prices_monthly) where k <= case when side = 'long' then 3 else 2 end")
def f01_top_k(spark, d):
    p = A.prices_monthly(spark, d).select("date", "ticker", "close")
    w = Window.partitionBy("date")
    p = p.withColumns({"long": F.row_number().over(w.orderBy(F.desc("close"), "ticker")), "short": F.row_number().over(w.orderBy("close", "ticker"))})
    return p.unpivot(["date", "ticker"], ["long", "short"], "side", "k").where("k <= case when side = 'long' then 3 else 2 end").withColumn("k", F.col("k").cast("long"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 150")
def f02_newest(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(150)


@query("select date, ticker, case when up <= k then 'long' else 'short' end as leg from (select date, ticker, greatest(1, floor(count(*) over (partition by date) * 0.2)) as k, count(*) over (partition by date) as n, row_number() over (partition by date order by close desc, ticker) as up, row_number() over (partition by date order by close, ticker desc) as down from prices_monthly) where n >= 4 and (up <= k or down <= k)")
def f03_quantile_legs(spark, d):
    w = Window.partitionBy("date")
    n = F.count("*").over(w)
    p = A.prices_monthly(spark, d).withColumns({"n": n, "k": F.greatest(F.lit(1), F.floor(n * 0.2)), "up": F.row_number().over(w.orderBy(F.desc("close"), "ticker")), "down": F.row_number().over(w.orderBy("close", F.desc("ticker")))})
    return p.where("n >= 4 and (up <= k or down <= k)").select("date", "ticker", F.when(F.col("up") <= F.col("k"), "long").otherwise("short").alias("leg"))


@query("select user_id, min_by(event_type, case event_type when 'purchase' then 1 when 'error' then 2 when 'click' then 3 else 4 end) filter (event_type in ('purchase', 'error', 'click')) as category from events group by 1")
def f04_precedence_pick(spark, d):
    ranks = spark.createDataFrame([("purchase", 1), ("error", 2), ("click", 3)], "event_type string, rank int")
    return A.table(spark, d, "events").join(F.broadcast(ranks), "event_type", "left").groupBy("user_id").agg(F.min_by("event_type", "rank").alias("category"))


@query("select ticker, metric, \"end\", filed, round(value, 2) as value from (select *, row_number() over (partition by ticker, metric, \"end\" order by filed desc, value desc) as k from facts) where k = 1")
def f05_keep_last(spark, d):
    last = J.keep_last(A.facts(spark, d), ["ticker", "metric", "end"], "filed", "value")
    return last.select("ticker", "metric", "end", "filed", F.round("value", 2).alias("value"))


RECORDS = """select 'E' || (doc_id - case when doc_id % 31 = 0 then 1 else 0 end) as event_id, lang as event_type, source as sector,
  case when doc_id % 37 = 0 then null else timestamp '2023-06-01' + interval 1 day * (doc_id % 400) end as filed, case when doc_id % 41 = 0 then 'none' else sha256(text) end as h from documents"""
GOLD_SAMPLE = {
    "records": RECORDS,
    "sorted": "select *, case when filed is null then 'missing_filed' when filed > timestamp '2024-06-01' then 'future_filed' when not regexp_full_match(h, '[0-9a-f]{64}') then 'illegal_hash' end as reason from records",
    "legal": "select distinct event_id, event_type, sector, filed, h from sorted where reason is null",
    "twice": "select event_id from legal group by 1 having count(distinct h) > 1",
    "badhash": "select distinct h from legal where event_id in (from twice) union select h from legal group by h having count(distinct event_id) > 1",
    "first_": "select event_id, h, min(event_type) as event_type, min_by(sector, event_type || '|' || sector) as sector, min(filed) as filed from legal where h not in (from badhash) group by 1, 2",
    "strata": "select *, year(filed)::int as year, row_number() over (partition by event_type, year(filed), sector order by sha256('0|' || event_id || '|' || h), event_id) as k from first_",
    "quotas": "select t.event_type, y.year, s.sector, 5 as quota from (select distinct lang as event_type from documents where lang <> 'de' union select 'xx') t, (select unnest([2022, 2023, 2024]) as year) y, (select distinct source as sector from documents) s",
}


@query("select s.event_type, s.year, s.sector, s.k, s.event_id, s.h from strata s join quotas q on q.event_type = s.event_type and q.year = s.year and q.sector = s.sector where k <= quota", GOLD_SAMPLE)
def f06_stratified_sample(spark, d):
    """A quota for each stratum of type, year and sector in hash order: a sampling operator, so its limit is the feature."""
    return sampled(spark, d)[0].select("event_type", "year", "sector", "k", "event_id", "h")


@query("select 'shortfall' as kind, q.event_type, q.year, q.sector, any_value(q.quota)::bigint as requested, count(s.event_id) as found from quotas q left join strata s on q.event_type = s.event_type and q.year = s.year and q.sector = s.sector group by 2, 3, 4 having count(s.event_id) < any_value(q.quota) union all select 'unrequested', event_type, year, sector, 0, count(*) from strata s where not exists (select 1 from quotas q where q.event_type = s.event_type and q.year = s.year and q.sector = s.sector) group by 2, 3, 4 union all select reason, null, null, null, null, count(*) from sorted where reason is not null group by 1 union all select 'event_hash_conflict', null, null, null, null, count(*) from twice having count(*) > 0 union all select 'conflicting_hash', null, null, null, null, count(*) from badhash having count(*) > 0", GOLD_SAMPLE)
def f06_sample_report(spark, d):
    """What the sample could not give: strata short of their quota, strata nobody asked for, and rejected records."""
    return sampled(spark, d)[1]


def sampled(spark, d):
    n, day = F.col("doc_id"), F.expr("interval 1 day")
    docs = A.table(spark, d, "documents")
    filed = F.when(n % 37 != 0, F.lit("2023-06-01").cast("timestamp") + (n % 400).cast("int") * day)
    event = F.concat(F.lit("E"), (n - F.when(n % 31 == 0, 1).otherwise(0)).cast("string"))
    records = docs.select(event.alias("event_id"), F.col("lang").alias("event_type"), F.col("source").alias("sector"), filed.alias("filed"), F.when(n % 41 == 0, "none").otherwise(F.sha2("text", 256)).alias("h"))
    kinds = docs.where("lang <> 'de'").select(F.col("lang").alias("event_type")).distinct().unionByName(spark.createDataFrame([("xx",)], "event_type string"))
    quotas = kinds.crossJoin(docs.select(F.col("source").alias("sector")).distinct()).select("event_type", F.explode(F.array(*map(F.lit, (2022, 2023, 2024)))).alias("year"), "sector", F.lit(5).alias("quota"))  # languages, sources
    return stratified_sample(records, quotas, F.lit("2024-06-01").cast("timestamp"))


@query("select region, count(*) as n, count(volume) as with_volume from (select 'daily' as region, volume from prices union all select 'monthly', null from prices_monthly) group by 1")
def g01_union_by_name(spark, d):
    a = A.prices(spark, d).withColumn("region", F.lit("daily"))
    b = A.prices_monthly(spark, d).drop("volume").withColumn("region", F.lit("monthly"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("region").agg(F.count("*").alias("n"), F.count("volume").alias("with_volume"))


@query("select distinct date_trunc('month', filed)::date as month from facts intersect select date from membership")
def g02_intersect(spark, d):
    return A.facts(spark, d).select(F.trunc("filed", "month").alias("month")).intersect(A.membership(spark, d).select(F.col("date").alias("month")))


@query("select date, ticker from membership except all select distinct date_trunc('month', date)::date, ticker from prices where volume > 30")
def g03_except_all(spark, d):
    p = A.prices(spark, d).where("volume > 30").select(F.trunc("date", "month").alias("date"), "ticker").distinct()
    return A.membership(spark, d).exceptAll(p)


@query("select coalesce(n.date, o.date) as date, coalesce(n.ticker, o.ticker) as ticker, round(coalesce(n.close, o.close), 6) as close from (select date, ticker, close from prices_monthly where ticker < 'S5') o full join (select date, ticker, case when volume > 300 then close * 2 end as close from prices_monthly where ticker > 'S3') n on n.date = o.date and n.ticker = o.ticker")
def g04_merge_keep_old(spark, d):
    p = A.prices_monthly(spark, d)
    old = p.where("ticker < 'S5'").select("date", "ticker", F.col("close").alias("o"))
    new = p.where("ticker > 'S3'").select("date", "ticker", F.when(F.col("volume") > 300, F.col("close") * 2).alias("n"))
    return old.join(new, ["date", "ticker"], "full").select("date", "ticker", F.round(F.coalesce("n", "o"), 6).alias("close"))


CHANGES = "select ticker, event_date as date, case when event_id % 3 = 0 then 'remove' else 'add' end as action, event_id from study_events"


@query("select m.date, t.ticker from (select distinct date_trunc('month', event_date)::date as date from study_events) m cross join (select distinct ticker from study_events) t where (select max_by(action, {d: date, i: event_id}) from changes c where c.ticker = t.ticker and c.date < m.date + interval 1 month) = 'add'", {"changes": CHANGES})
def g05_membership_rebuild(spark, d):
    """Members at month end from a change log: the last action known to each month, by one as-of pass."""
    c = A.study_events(spark, d).select("ticker", "event_date", F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add").alias("action"), "event_id")
    months = c.select(F.trunc("event_date", "month").alias("date")).distinct().crossJoin(F.broadcast(c.select("ticker").distinct())).withColumn("month_end", F.last_day("date"))
    return asof_join(months, c, "month_end", "event_date", by=["ticker"], ties=("event_id",)).where("action = 'add'").select("date", "ticker")


@query("select url, replace(replace(upper(trim(url)), '.', '-'), '/', '-') as ticker from pages")
def h01_normal_ticker(spark, d):
    return A.table(spark, d, "pages").select("url", T.normal_ticker(F.col("url")).alias("ticker"))


NAME = "regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(upper({c}), '\\s*/[A-Z]{{2,3}}/?\\s*$', ''), '[^A-Z0-9]+', ' ', 'g')), '^THE ', ''), '( (INC|CORP|CORPORATION|CO|COMPANY|LTD|LIMITED|LLC|LP|PLC|SA|NV|AG|GROUP|HOLDINGS))+$', '')"


@query(f"select p_partkey, {NAME.format(c='n')} as name from (select p_partkey, case p_partkey % 4 when 0 then 'The ' || p_name || ' Co., Inc.' when 1 then p_name || ' /DE/' when 2 then p_name || ' Group Holdings plc' else p_name end as n from part)")
def h02_issuer_name(spark, d):
    k = F.col("p_partkey") % 4
    n = F.when(k == 0, F.concat(F.lit("The "), "p_name", F.lit(" Co., Inc."))).when(k == 1, F.concat("p_name", F.lit(" /DE/"))).when(k == 2, F.concat("p_name", F.lit(" Group Holdings plc"))).otherwise(F.col("p_name"))
    return A.table(spark, d, "part").select("p_partkey", T.normal_name(n).alias("name"))


@query("select p_partkey, len(list_intersect(string_split_regex(lower(p_name), '[^a-z0-9]+'), string_split_regex(lower(p_type), '[^a-z0-9]+'))) > 0 as agree from part")
def h03_names_agree(spark, d):
    return A.table(spark, d, "part").select("p_partkey", T.names_agree(F.col("p_name"), F.col("p_type")).alias("agree"))


@query("select p_partkey, trim(regexp_replace(n, '\\s*\\(CIK \\d+\\)', '', 'g')) as name, nullif(regexp_extract(n, '\\(([A-Z]{1,5})\\)', 1), '') as ticker from (select p_partkey, p_name || ' (ABC) (CIK 000' || p_partkey || ')' as n from part)")
def h04_entity_cleanup(spark, d):
    n = F.concat("p_name", F.lit(" (ABC) (CIK 000"), F.col("p_partkey").cast("string"), F.lit(")"))
    return A.table(spark, d, "part").select("p_partkey", F.trim(F.regexp_replace(n, r"\s*\(CIK \d+\)", "")).alias("name"), F.nullif(F.regexp_extract(n, r"\(([A-Z]{1,5})\)", 1), F.lit("")).alias("ticker"))


@query("select event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?i)item\\s+(\\d\\.\\d{2})', 1))), ',') as items from (select event_id, 'Item ' || (event_id % 9) || '.0' || (event_id % 3) || ' and ITEM  2.02; item ' || (event_id % 9) || '.0' || (event_id % 3) as t from events)")
def h05_items(spark, d):
    k = F.concat((F.col("event_id") % 9).cast("string"), F.lit(".0"), (F.col("event_id") % 3).cast("string"))
    t = F.concat(F.lit("Item "), k, F.lit(" and ITEM  2.02; item "), k)
    return A.table(spark, d, "events").select("event_id", F.array_join(T.items(t), ",").alias("items"))


@query("select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' when 'P' then 'partial' else 'other' end as status from orders")
def h06_status_map(spark, d):
    names = F.create_map(*[F.lit(x) for pair in (("O", "open"), ("F", "filled"), ("P", "partial")) for x in pair])
    return A.table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("other")).alias("status"))


@query("with posts as (select doc_id, text || case when doc_id % 3 = 0 then ' $' || left(lang, 1) || ' $' || upper(lang) || ', $' || lang || 'x' else '' end as t from documents), u as (select distinct tag from (select upper(lang) as tag from documents union all select upper(left(lang, 1)) from documents union all select unnest(regexp_extract_all(text, '(?:^|[ .,])([A-Z]{2,5})(?:[ .,]|$)', 1)) from benchmark)) select upper(replace(w, '$', '')) as ticker, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(string_split_regex(t, '[^\\p{L}\\p{N}_$]+')) as w from posts) where regexp_full_match(w, '[A-Z]{2,5}|\\$[A-Za-z]{1,5}') and upper(replace(w, '$', '')) in (from u) group by 1")
def h07_cashtags(spark, d):
    """Mentions in documents, some of which get tags of their language, of a universe that is a table: languages, their
    initials, and the upper-case words of the benchmark."""
    docs = A.table(spark, d, "documents")
    tags = F.concat(F.lit(" $"), F.left("lang", F.lit(1)), F.lit(" $"), F.upper("lang"), F.lit(", $"), F.col("lang"), F.lit("x"))
    posts = docs.select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, tags).otherwise("")).alias("t"))
    bare = A.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"(?:^|[ .,])([A-Z]{2,5})(?:[ .,]|$)"), 1)).alias("ticker"))
    universe = docs.select(F.upper("lang").alias("ticker")).unionByName(docs.select(F.upper(F.left("lang", F.lit(1))).alias("ticker"))).unionByName(bare).distinct()
    words = posts.select("doc_id", F.explode(T.cashtags(F.col("t"))).alias("ticker"))
    return words.join(universe, "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("select event_id, case when event_id % 5 = 0 then '' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as seen from events")
def h08_seen_date(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("T"), F.date_format("ts", "HHmmss"), F.lit("Z")))
    return A.table(spark, d, "events").select("event_id", T.seen_date(raw).alias("seen"))


@query("select doc_id, coalesce(case lang when 'en' then 'eng' when 'de' then 'deu' end, case when source = 'src0' then 'hub' else 'web' end) as code from documents")
def h09_language_code(spark, d):
    code = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "de", "deu")
    return A.table(spark, d, "documents").select("doc_id", F.coalesce(code, F.when(F.col("source") == "src0", "hub").otherwise("web")).alias("code"))


@query("select page_id, length(t) as chars, md5(t) as digest from (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(?:script|style)\\b[^>]*>.*?</(?:script|style)>', ' ', 'gsi'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) as t from pages)")
def h10_strip_markup(spark, d):
    t = T.strip_markup(F.col("html"))
    return A.table(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


FILINGS = "select *, case when l_orderkey % 5 = 4 then null else l_quantity * 1.5 end as pct, l_quantity + 0.25 as was, l_linenumber % 2 = 0 as amended from lineitem"
# What a filing says, by kind; p, q and x stand for a percentage, the former one and a price.
SAYS = ("<percentOfClass> {p} </percentOfClass>", "Percent of class (a): {p} %", "shares representing {p}% of all", "no figure here", "Percent of class: 250%")
OFFERS = ("at a price of ${x} per share", "between ${x} and $99.00 per share", "for example, a price of ${x} per share", "about ${x} in all", "a price of $[ ] per share")


@query("select l_orderkey, l_linenumber, case when l_orderkey % 5 < 3 then pct end as pct, case l_orderkey % 5 when 0 then 'tag' when 1 then 'label' when 2 then 'narrative' else 'none' end as source, case when amended then was end as before, case when l_partkey % 5 in (0, 3) then l_suppkey * 100 + 0.5 end as price, case l_partkey % 5 when 0 then 'exact' when 3 then 'low' else 'none' end as confidence from filings", {"filings": FILINGS})
def h10_figures(spark, d):
    """Percentages and offer prices read back from the wording of filings."""
    money = lambda c: F.format_string("%.2f", c)
    fill = lambda t, **v: F.concat(*[F.lit(part) if k % 2 == 0 else v[part] for k, part in enumerate(re.split(r"[{}]", t))])
    pick = lambda k, forms, **v: F.element_at(F.array(*[fill(t, **v) for t in forms]), (F.col(k) % len(forms) + 1).cast("int"))
    li = A.table(spark, d, "lineitem")
    text = F.concat_ws(". ", pick("l_orderkey", SAYS, p=money(F.col("l_quantity") * 1.5)), F.concat(F.lit("Previously reported "), money(F.col("l_quantity") + 0.25), F.lit(" %")), pick("l_partkey", OFFERS, x=F.when(F.col("l_orderkey") % 2 == 0, F.format_number(F.col("l_suppkey") * 100 + 0.5, 2)).otherwise(money(F.col("l_suppkey") * 100 + 0.5))))
    now, source, before = T.percent_of_class(text, F.col("l_linenumber") % 2 == 0)
    price, sure = T.offer_price(text)
    return li.select("l_orderkey", "l_linenumber", now.alias("pct"), source.alias("source"), before.alias("before"), price.alias("price"), sure.alias("confidence"))


@query("select p_partkey, case when p_size <= 10 then 'small' when p_size <= 30 then 'medium' else 'large' end as sector from part")
def h11_range_table(spark, d):
    ranges = spark.createDataFrame([(0, 10, "small"), (11, 30, "medium"), (31, 999, "large")], "lo int, hi int, sector string")
    p = A.table(spark, d, "part").select("p_partkey", "p_size")
    return p.join(F.broadcast(ranges), F.col("p_size").between(F.col("lo"), F.col("hi"))).select("p_partkey", "sector")


@query("select p_partkey, cast((p_size > 10)::int + (p_size > 20)::int + (p_size > 30)::int as int) as qcut, cast((p_size >= 10)::int + (p_size >= 20)::int + (p_size >= 30)::int as int) as digitize from part")
def h12_buckets(spark, d):
    from ..operators.monitor import bucket

    edges = F.array(F.lit(10), F.lit(20), F.lit(30))
    return A.table(spark, d, "part").select("p_partkey", bucket(F.col("p_size"), edges).alias("qcut"), bucket(F.col("p_size"), edges, False).alias("digitize"))


@query("select date, ticker, cast((year(date) * 12 + month(date) - 1) * 2 + (ticker < 'S5')::int as bigint) as gid from prices_monthly")
def h13_group_id(spark, d):
    gid = (F.year("date") * 12 + F.month("date") - 1) * 2 + (F.col("ticker") < "S5").cast("int")
    return A.prices_monthly(spark, d).select("date", "ticker", gid.cast("long").alias("gid"))


@query("select date, (cast(date as timestamp) + interval 16 hour) at time zone 'America/New_York' at time zone 'UTC' as close_ts from sessions")
def h14_session_close(spark, d):
    local = F.make_timestamp(F.year("date"), F.month("date"), F.dayofmonth("date"), F.lit(16), F.lit(0), F.lit(0))
    return A.prices(spark, d).select("date").distinct().select("date", F.to_utc_timestamp(local, "America/New_York").alias("close_ts"))


@query("select event_id, case event_type when 'purchase' then 1 when 'error' then -1 end as sign, case when value > 100 then 'strong' when value > 20 then 'moderate' else 'weak' end as strength from events")
def h15_ladders(spark, d):
    sign = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1)
    return A.table(spark, d, "events").select("event_id", sign.alias("sign"), F.when(F.col("value") > 100, "strong").when(F.col("value") > 20, "moderate").otherwise("weak").alias("strength"))


@query("select date, ticker, round(ln(case when volume > 1 then volume end) * close, 4) as interaction from prices_monthly")
def h16_interactions(spark, d):
    return A.prices_monthly(spark, d).select("date", "ticker", F.round(F.log(F.when(F.col("volume") > 1, F.col("volume"))) * F.col("close"), 4).alias("interaction"))


@query("select o_orderkey, 'https://example.com/data/' || o_custkey || '/' || lpad(cast(o_orderkey as varchar), 10, '0') || '.xml' as url from orders")
def h17_url_format(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", F.format_string("https://example.com/data/%d/%010d.xml", "o_custkey", "o_orderkey").alias("url"))


@query("select p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_partkey\":' || p_partkey || ',\"p_size\":' || p_size || '}') as digest from part")
def h18_canonical_json(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.sha2(F.to_json(F.struct("p_brand", "p_partkey", "p_size")), 256).alias("digest"))


@query("select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")
def h19_json_path(spark, d):
    return A.table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


# Fixed values of this query: rank, label, pattern, abstain only.
RULES = [(1, "permissive", "apache|mit", False), (1, "copyleft", "general public|by-sa", False), (2, "other", "license|released under", False), (3, "void", "all rights reserved", True)]
WINDOWS = {"permissive": (3, 2), "other": (1, 4)}
BEFORE = "regexp_replace({1}, '(?i)(^|[^A-Za-z0-9])(no|not|never|without)([^A-Za-z0-9]+[A-Za-z0-9]+){{0,{2}}}[^A-Za-z0-9]+({0})', ' ', 'g')"
AFTER = "regexp_replace({1}, '(?i)({0})[A-Za-z0-9]*([^A-Za-z0-9]+[A-Za-z0-9]+){{0,{2}}}[^A-Za-z0-9]+(no|not|never|without)($|[^A-Za-z0-9])', ' ', 'g')"


def rule_hit_sql(pattern: str, before: int = 3, after: int = 0) -> str:
    text = BEFORE.format(pattern, "text", before - 1)
    return f"regexp_matches({AFTER.format(pattern, text, after - 1) if after else text}, '(?i)({pattern})')"




@query(f"select doc_id, case when v then 'abstain' when p and c then 'conflict' when p then 'permissive' when c then 'copyleft' when o then 'other' else 'abstain' end as label from (select doc_id, {rule_hit_sql('apache|mit', 3, 2)} as p, {rule_hit_sql('general public|by-sa')} as c, {rule_hit_sql('license|released under', 1, 4)} as o, {rule_hit_sql('all rights reserved')} as v from (select doc_id, text || case doc_id % 7 when 0 then '. Apache License? Certainly not.' when 1 then '. This is not an Apache product.' when 2 then '. Released under terms we never saw.' else '' end as text from documents))")
def h20_rule_classes(spark, d):
    """Labels of documents, some of which get a sentence with a negation before or after a hit; each rule has its own window."""
    said = F.when(F.col("doc_id") % 7 == 0, ". Apache License? Certainly not.").when(F.col("doc_id") % 7 == 1, ". This is not an Apache product.").when(F.col("doc_id") % 7 == 2, ". Released under terms we never saw.").otherwise("")
    return A.table(spark, d, "documents").select("doc_id", T.classified(F.concat("text", said), RULES, WINDOWS).alias("label"))


PERSONS = "select role, role || ' Member' || (conv_id % 7) || case when turn % 3 = 0 then ' ' || (30 + conv_id % 40) else '' end as raw, case when turn % 4 = 0 then 30 + conv_id % 40 end as age from conversations"
BARE = "trim(regexp_replace(lower(regexp_replace(raw, ' [0-9][0-9]$', '')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select name, count(*) as n, string_agg(distinct role, ',' order by role) as roles, count(*) filter (stripped) as n_stripped from (select role, stripped, trim(regexp_replace(lower(case when stripped then regexp_replace(raw, ' [0-9][0-9]$', '') else raw end), '[^a-z0-9]+', ' ', 'g')) as name from (select *, regexp_matches(raw, ' [0-9][0-9]$') and (coalesce(right(raw, 2) = age::varchar, false) or {BARE} in (select {BARE} from persons where not regexp_matches(raw, ' [0-9][0-9]$'))) as stripped from persons)) group by 1", {"persons": PERSONS})
def h21_person_rows(spark, d):
    """A bare age at the end of a name goes if that age was seen in the row or the name is known without it; then rows are
    merged by normal name."""
    c = F.col("conv_id")
    age = (30 + c % 40).cast("string")
    raw = F.concat("role", F.lit(" Member"), (c % 7).cast("string"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), age)).otherwise(""))
    p = A.table(spark, d, "conversations").select("role", raw.alias("raw"), F.when(F.col("turn") % 4 == 0, age).alias("age"))
    return T.merged_persons(p)


Z = "1.959963984540054"


@query(f"select event_type, k, n, round((k / n + {Z} * {Z} / (2 * n) - {Z} * sqrt(k / n * (1 - k / n) / n + {Z} * {Z} / (4.0 * n * n))) / (1 + {Z} * {Z} / n), 6) as low, round((k / n + {Z} * {Z} / (2 * n) + {Z} * sqrt(k / n * (1 - k / n) / n + {Z} * {Z} / (4.0 * n * n))) / (1 + {Z} * {Z} / n), 6) as high from (select event_type, count(*) filter (value > 50) as k, count(*) as n from events group by 1)")
def h22_wilson(spark, d):
    g = A.table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    low, high = T.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


EDGES = "select distinct 'c' || o_custkey as a, 's' || l_suppkey as b, l_returnflag as type from orders join lineitem on l_orderkey = o_orderkey"


def edges(spark, d) -> DataFrame:
    """Who bought from whom, by return flag."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sold = A.table(spark, d, "orders").join(A.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return sold.select(node("c", "o_custkey").alias("a"), node("s", "l_suppkey").alias("b"), F.col("l_returnflag").alias("type")).distinct()


@query("select id, count(*) as degree, string_agg(distinct type, ',' order by type) as lanes from (select a as id, type from edges union all select b, type from edges) group by 1", {"edges": EDGES})
def m01_node_table(spark, d):
    return node_table(edges(spark, d))


@query("select s.s_suppkey, coalesce('i:' || min(c.c_custkey), 's:' || s.s_name) as endpoint from (select s_suppkey, s_name, substr(s_name, 10) as k from supplier) s left join (select c_custkey, substr(c_name, 10) as k from customer) c on c.k = s.k group by s.s_suppkey, s.s_name")
def m02_identity_merge(spark, d):
    key = lambda c: F.substring(c, 10, 99)
    c = A.table(spark, d, "customer").groupBy(key("c_name").alias("k")).agg(F.min("c_custkey").alias("id"))
    s = A.table(spark, d, "supplier").select("s_suppkey", "s_name", key("s_name").alias("k"))
    return s.join(c, "k", "left").select("s_suppkey", F.coalesce(F.concat(F.lit("i:"), F.col("id").cast("string")), F.concat(F.lit("s:"), F.col("s_name"))).alias("endpoint"))


@query()
def m03_components(spark, d):
    """Components of customers and the suppliers that they returned goods to; rounds grow with the graph, so there is no SQL."""
    returned = edges(spark, d).where("type = 'R'").select("a", "b").distinct()
    return connected_components(returned).groupBy("root").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


@query("select count(*) as isolated from (select 's' || s_suppkey as id from supplier union all select 'c' || c_custkey from customer) s where id not in (select a from edges union all select b from edges)", {"edges": EDGES})
def m04_isolated(spark, d):
    """Customers and suppliers without a sale."""
    node = lambda t, p, c: A.table(spark, d, t).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("id"))
    nodes = node("supplier", "s", "s_suppkey").unionByName(node("customer", "c", "c_custkey"))
    return isolated(nodes, edges(spark, d)).agg(F.count("*").alias("isolated"))
