"""Canonical tables (prices, facts, vintages, membership, ...) from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.rolling import dense_grid


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ratio(keys: list, lines: DataFrame) -> DataFrame:
    """Average prices from whole cents, so that sums do not depend on the order of rows."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return lines.groupBy(*keys).agg((cents / (F.sum("l_quantity") * 100)).alias("close"), F.sum("l_quantity").alias("volume"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker"))
    lines = table(spark, d, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return _ratio([F.to_date("l_shipdate").alias("date"), "ticker"], lines)


def grid(spark: SparkSession, d: str) -> DataFrame:
    return dense_grid(prices(spark, d))


def prices_monthly(spark: SparkSession, d: str) -> DataFrame:
    keys = [F.trunc("l_shipdate", "month").alias("date"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker")]
    return _ratio(keys, table(spark, d, "lineitem"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("ticker"),
        F.col("o_orderpriority").alias("metric"),
        F.trunc("o_orderdate", "month").alias("end"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") * 7 % 60).cast("int")).alias("filed"),
        F.when(F.col("o_orderkey") % 4 == 0, "10-K").otherwise("10-Q").alias("form"),
        F.col("o_totalprice").alias("value"),
    )


def vintages(spark: SparkSession, d: str) -> DataFrame:
    k = F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k")
    rows = table(spark, d, "orders").select("*", k).where(F.col("o_orderkey") % 3 <= F.col("k"))
    month = F.trunc("o_orderdate", "month")
    return rows.groupBy(month.alias("ref_date"), F.date_add(F.add_months(month, 1), F.col("k") * 20).alias("realtime_start")).agg(F.avg("o_totalprice").alias("value"))


def membership(spark: SparkSession, d: str) -> DataFrame:
    months = table(spark, d, "lineitem").select(F.trunc("l_shipdate", "month").alias("date")).distinct()
    nations = table(spark, d, "nation").select("n_nationkey")
    pairs = months.crossJoin(F.broadcast(nations))  # 25 nations
    return pairs.where((F.col("n_nationkey") * 7 + F.year("date") * 12 + F.month("date")) % 5 != 0).select("date", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker")).distinct()


def sectors(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("r_name").alias("sector"))


def study_events(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("event_date"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("ticker"), F.col("o_orderpriority").alias("event_type"))


def holdings(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    quarter = F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string"))
    return joined.groupBy(quarter.alias("quarter"), (F.col("l_suppkey") % 20).alias("manager"), F.col("p_brand").alias("cusip"), F.col("p_type").alias("option_type")).agg(F.sum("l_extendedprice").alias("value_usd"), F.sum("l_quantity").alias("shares"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    mood = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker")).agg(F.count("*").alias("mentions"), F.avg(mood).alias("sentiment"))


def member_trades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("purchase", "click")).select(
        "event_id",
        F.to_date("ts").alias("transaction_date"),
        F.when(F.col("user_id") % 2 == 0, "D").otherwise("R").alias("party"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("member"),
        F.concat(F.lit("T"), (F.col("event_id") % 40).cast("string")).alias("ticker"),
        F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("direction"),
    )


#: The same tables as DuckDB text, for the oracle queries; a name may use the names before it.
CTES = {
    "prices": "select cast(l_shipdate as date) as date, 'N' || s_nationkey as ticker, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (sum(l_quantity) * 100) as close, sum(l_quantity) as volume from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2",
    "sessions": "select date, row_number() over (order by date) as idx from (select distinct date from prices)",
    "grid": "select s.date, t.ticker, p.close, p.volume from sessions s cross join (select distinct ticker from prices) t left join prices p on p.date = s.date and p.ticker = t.ticker",
    "rets": "select *, close / lag(close) over (partition by ticker order by date) - 1 as ret from grid",
    "mkt": "select date, avg(ret) as mkt from rets group by date",
    "retm": "select rets.*, mkt from rets join mkt using (date)",
    "prices_monthly": "select cast(date_trunc('month', l_shipdate) as date) as date, 'S' || l_suppkey as ticker, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (sum(l_quantity) * 100) as close, sum(l_quantity) as volume from lineitem group by 1, 2",
    "facts": "select 'N' || c_nationkey as ticker, o_orderpriority as metric, cast(date_trunc('month', o_orderdate) as date) as \"end\", cast(o_orderdate as date) + cast(o_orderkey * 7 % 60 as integer) as filed, case when o_orderkey % 4 = 0 then '10-K' else '10-Q' end as form, o_totalprice as value from orders join customer on o_custkey = c_custkey",
    "vintages": "select cast(date_trunc('month', o_orderdate) as date) as ref_date, cast(date_trunc('month', o_orderdate) + interval 1 month as date) + cast(k * 20 as integer) as realtime_start, avg(o_totalprice) as value from orders, (select unnest([0, 1, 2]) as k) where o_orderkey % 3 <= k group by 1, 2",
    "membership": "select distinct m.date, 'N' || n_nationkey as ticker from (select distinct cast(date_trunc('month', l_shipdate) as date) as date from lineitem) m, nation where (n_nationkey * 7 + year(m.date) * 12 + month(m.date)) % 5 <> 0",
    "sectors": "select 'N' || n_nationkey as ticker, r_name as sector from nation join region on n_regionkey = r_regionkey",
    "study_events": "select o_orderkey as event_id, cast(o_orderdate as date) as event_date, 'N' || c_nationkey as ticker, o_orderpriority as event_type from orders join customer on o_custkey = c_custkey",
    "holdings": "select year(l_shipdate) || 'Q' || quarter(l_shipdate) as quarter, l_suppkey % 20 as manager, p_brand as cusip, p_type as option_type, sum(l_extendedprice) as value_usd, sum(l_quantity) as shares from lineitem join part on l_partkey = p_partkey group by 1, 2, 3, 4",
    "mentions": "select cast(ts as date) as date, 'U' || user_id as ticker, count(*) as mentions, avg(case when event_type = 'purchase' then 1.0 when event_type = 'error' then -1.0 else 0.0 end) as sentiment from events group by 1, 2",
    "member_trades": "select event_id, cast(ts as date) as transaction_date, case when user_id % 2 = 0 then 'D' else 'R' end as party, 'U' || user_id as member, 'T' || (event_id % 40) as ticker, case when event_type = 'purchase' then 'buy' else 'sell' end as direction from events where event_type in ('purchase', 'click')",
    "fwd": "select *, lead(close, 21) over (partition by ticker order by date) / close - 1 as y, case when count(ret) over w >= 5 then sum(ret) over w end as score from rets window w as (partition by ticker order by date rows between 20 preceding and current row)",
    "member_panel": "select f.* from fwd f join (select d.date, max(m.date) as snap from (select distinct date from fwd) d join (select distinct date from membership) m on m.date <= d.date group by d.date) s on s.date = f.date join membership mm on mm.date = s.snap and mm.ticker = f.ticker",
    "eom": "select * from (select *, max(date) over (partition by ticker, date_trunc('month', date)) as last_date from member_panel where y is not null and score is not null) where date = last_date",
    "scored": "select distinct date_trunc('month', date)::date as month, * from eom",
    "ranked": "select month, ticker, score, y, rank() over (partition by month order by score) + (count(*) over (partition by month, score) - 1) / 2.0 as rs, rank() over (partition by month order by y) + (count(*) over (partition by month, y) - 1) / 2.0 as ry from scored",
    "ic": "select month, corr(rs, ry) as ic from ranked group by month having count(*) >= 5",
}


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """body after the canonical tables that it names, directly or through others."""
    import re

    known = CTES | (extra or {})
    need: set[str] = set()

    def add(text: str) -> None:
        for name in known:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(known[name])

    add(body)
    parts = [f"{n} as ({known[n]})" for n in known if n in need]
    if not parts:
        return body
    head = "with recursive" if body.startswith("with recursive ") else "with"
    own = body.removeprefix("with recursive ").removeprefix("with ")
    return f"{head} {', '.join(parts)}" + (f", {own}" if own != body else f" {body}")
