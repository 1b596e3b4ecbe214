"""Queries that write the given tables in a source's format to the shared folder, read them back, and stream over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import rolling as R
from ..shared import scratch
from ..sources import readers, sinks
from ..streaming import feeds
from .registry import query


@query("select date, ticker, round(close, 6) as close, year(date) as year from prices where year(date) >= 1998")
def a01_parquet_snapshot(spark, d):
    path = scratch(spark, "prices")
    A.prices(spark, d).withColumn("year", F.year("date")).repartition("year").write.partitionBy("year").parquet(path)
    return spark.read.parquet(path).where("year >= 1998").select("date", "ticker", F.round("close", 6).alias("close"), F.col("year").cast("long").alias("year"))


@query("select ref_date, realtime_start, case when day(realtime_start) = 1 then null else round(value, 6) end as value from vintages")
def a02_vintage_json(spark, d):
    path = scratch(spark, "vintages")
    v = A.vintages(spark, d)
    text = F.when(F.dayofmonth("realtime_start") == 1, ".").otherwise(F.format_string("%.12f", "value"))
    o = F.struct(F.col("ref_date").cast("string").alias("date"), F.col("realtime_start").cast("string").alias("realtime_start"), text.alias("value"))
    v.groupBy(F.year("ref_date").alias("y")).agg(F.collect_list(o).alias("observations")).select("observations").write.json(path)
    return readers.vintage_observations(spark, path, multi_line=False).select("ref_date", "realtime_start", F.round("value", 6).alias("value"))


@query("select ticker, 'm1' as metric, \"end\", filed, form, round(value, 2) as value from facts where metric = case when exists (select 1 from facts g where g.ticker = facts.ticker and g.metric = '1-URGENT' and g.form = '10-K') then '1-URGENT' else '2-HIGH' end and form = '10-K'")
def a03_company_facts(spark, d):
    path = scratch(spark, "facts")
    f = A.facts(spark, d).where("form = '10-K' and metric in ('1-URGENT', '2-HIGH')")
    row = F.struct(F.col("end").cast("string").alias("end"), F.col("value").alias("val"), F.year("end").alias("fy"), F.lit("FY").alias("fp"), "form", F.col("filed").cast("string").alias("filed"))
    by_tag = f.groupBy("ticker", "metric").agg(F.collect_list(row).alias("rows"))
    body = F.map_from_entries(F.collect_list(F.struct("metric", F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units")))))
    by_tag.groupBy("ticker").agg(F.struct(body.alias("us-gaap")).alias("facts")).write.json(path)
    return readers.company_facts(spark, path, {"m1": ["1-URGENT", "2-HIGH"]}).select("ticker", "metric", "end", "filed", "form", F.round("value", 2).alias("value"))


@query("select 'F' || chr(cast(65 + manager as int)) as fund, cusip as ticker, round(sum(value_usd), 2) as weight, round(sum(shares), 2) as shares from (select *, max(quarter) over (partition by manager) as newest from holdings) where quarter = newest group by 1, 2")
def a04_fund_csv(spark, d):
    """A file per fund and quarter, named by the quarter's last day; of each fund the newest is read."""
    path = scratch(spark, "funds")
    h = A.holdings(spark, d)
    end = F.date_format(F.last_day(F.make_date(F.left("quarter", F.lit(4)).cast("int"), 3 * F.right("quarter", F.lit(1)).cast("int"), F.lit(1))), "yyyyMMdd")
    h = h.withColumn("name", F.concat(F.lit("F"), F.chr(65 + F.col("manager")), F.lit("_"), end))
    rows = h.groupBy("name", F.col("cusip").alias("ticker")).agg(F.format_string("%.2f", F.sum("value_usd")).alias("weight"), F.format_string("%.2f", F.sum("shares")).alias("shares"))
    rows.repartition("name").write.partitionBy("name").option("header", True).csv(path)
    lines = spark.read.option("header", True).csv(path)
    newest = lines.groupBy(F.regexp_extract("name", "^([A-Z]+)_", 1).alias("fund")).agg(F.max("name").alias("name"))
    return lines.join(newest, "name").select("fund", "ticker", F.col("weight").cast("double").alias("weight"), F.col("shares").cast("double").alias("shares"))


@query("select case when manager % 2 = 0 then 'X' else 'Y' end as issuer, quarter, manager, cusip as ticker, round(shares, 2) as shares from holdings")
def a05_holdings_dialects(spark, d):
    """Half of the managers file in one layout, half in another with other names, order and separator."""
    a, b = scratch(spark, "dialect"), scratch(spark, "dialect")
    h = A.holdings(spark, d)
    number = F.format_string("%.2f", "shares")
    h.where("manager % 2 = 0").select(F.col("cusip").alias("Symbol"), number.alias("Quantity"), "quarter", "manager").write.option("header", True).csv(a)
    h.where("manager % 2 = 1").select("manager", number.alias("Shares Held"), F.col("cusip").alias("Ticker"), "quarter").write.option("header", True).option("sep", ";").csv(b)

    def layout(path: str, issuer: str, sep: str, ticker: str, shares: str) -> DataFrame:
        rows = spark.read.option("header", True).option("sep", sep).csv(path)
        return rows.select(F.lit(issuer).alias("issuer"), "quarter", F.col("manager").cast("long").alias("manager"), F.col(ticker).alias("ticker"), F.col(shares).cast("double").alias("shares"))

    return layout(a, "X", ",", "Symbol", "Quantity").unionByName(layout(b, "Y", ";", "Ticker", "Shares Held"))


@query("select o_orderpriority as form, cast(o_custkey as varchar) as cik, cast(o_orderdate as date) as filed, count(*) as n from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1, 2, 3")
def a06_crawler_index(spark, d):
    path = scratch(spark, "index")
    o = A.table(spark, d, "orders")
    o.select(F.concat_ws("   ", F.lit("Company Name"), "o_orderpriority", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd"), F.concat(F.lit("edgar/"), F.col("o_orderkey").cast("string")))).write.text(path)
    return readers.crawler_index(spark, path, ["1-URGENT", "2-HIGH"]).groupBy("form", "cik", "filed").agg(F.count("*").alias("n"))


@query("select 'M' || manager as issuer, quarter as title_class, upper(cusip) as cusip, option_type, round(value_usd, 2) as value_usd, round(shares, 2) as shares from holdings")
def a07_information_table(spark, d):
    path = scratch(spark, "infotable")
    amount = F.struct(F.format_string("%.2f", "shares").alias("sshPrnamt"), F.lit("SH").alias("sshPrnamtType"))
    A.holdings(spark, d).select(F.concat(F.lit("M"), F.col("manager").cast("string")).alias("nameOfIssuer"), F.col("quarter").alias("titleOfClass"), "cusip", F.format_string("%.2f", "value_usd").alias("value"), F.col("option_type").alias("putCall"), amount.alias("shrsOrPrnAmt")).write.format("xml").option("rowTag", "infoTable").option("rootTag", "informationTable").save(path)
    return readers.information_table(spark, path).select("issuer", "title_class", "cusip", "option_type", F.round("value_usd", 2).alias("value_usd"), F.round("shares", 2).alias("shares"))


@query("select 'C' || (l_suppkey % 5) as ticker, case when l_returnflag = 'A' then 'P' else 'S' end as code, count(*) as n, round(sum(l_quantity), 2) as shares from lineitem where l_returnflag in ('A', 'R') group by 1, 2")
def a08_insider_xml(spark, d):
    """Ownership documents as gzipped XML: plain text would take some 20 times the disk. What is exchanged are the given
    columns, once and by document; their texts are made after that."""
    path = scratch(spark, "insider")
    key, given = ("l_orderkey", "s"), ("l_returnflag", "l_shipdate", "l_quantity", "l_extendedprice")
    li = A.table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("s"), *given).repartition(*key)
    v = lambda c: F.struct(c.cast("string").alias("value"))

    def transaction(x):
        code = F.when(x["l_returnflag"] == "A", "P").when(x["l_returnflag"] == "R", "S").otherwise("M")
        return F.struct(v(F.to_date(x["l_shipdate"])).alias("transactionDate"), F.struct(code.alias("transactionCode")).alias("transactionCoding"), F.struct(v(x["l_quantity"]).alias("transactionShares"), v(x["l_extendedprice"]).alias("transactionPricePerShare")).alias("transactionAmounts"))

    doc = li.groupBy(*key).agg(F.collect_list(F.struct(*given)).alias("t")).withColumn("t", F.transform("t", transaction))
    doc.select(F.struct(F.concat(F.lit("C"), F.col("s").cast("string")).alias("issuerTradingSymbol")).alias("issuer"), F.struct(F.struct(F.col("l_orderkey").cast("string").alias("rptOwnerCik"), F.lit("n").alias("rptOwnerName")).alias("reportingOwnerId")).alias("reportingOwner"), F.struct(F.col("t").alias("nonDerivativeTransaction")).alias("nonDerivativeTable")).write.format("xml").option("rowTag", "ownershipDocument").options(rootTag="documents", indent="", compression="gzip").save(path)
    return readers.insider_transactions(spark, path).groupBy("ticker", "code").agg(F.count("*").alias("n"), F.round(F.sum("shares"), 2).alias("shares"))


@query("select date, round(mkt, 4) as mkt from (select date, round(avg(ret) * 100, 6) / 100 as mkt from rets group by 1) where mkt is not null")
def a09_factor_file(spark, d):
    path = scratch(spark, "factors")
    m = A.grid(spark, d).withColumn("ret", R.simple_return()).groupBy("date").agg(F.avg("ret").alias("m"))
    m.select(F.concat_ws(",", F.date_format("date", "yyyyMMdd"), F.coalesce(F.format_string("%.6f", F.when(F.col("m").isNotNull(), F.col("m") * 100)), F.lit("")))).where("true").write.text(path)
    return readers.factor_file(spark, path, ["mkt"]).select("date", F.round("mkt", 4).alias("mkt"))


@query("select date, ticker from membership")
def a10_membership_lists(spark, d):
    path = scratch(spark, "members")
    m = A.membership(spark, d).groupBy("date").agg(F.concat_ws(",", F.collect_list(F.lower("ticker"))).alias("tickers"))
    m.select(F.col("date").cast("string").alias("date"), "tickers").write.option("header", True).csv(path)
    return readers.membership_lists(spark, path)


@query("select event_id, event_type, round(value, 4) as value from events where event_id % 7 <> 0")
def a11_json_ledger(spark, d):
    path = scratch(spark, "ledger")
    e = A.table(spark, d, "events")
    line = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "event_type", "value")))
    e.select(line.alias("value")).write.text(path)
    return readers.ledger(spark, path, "event_id long, event_type string, value double").select("event_id", "event_type", F.round("value", 4).alias("value"))


@query("select '2024-01-31' as as_of, date, ticker, round(close, 6) as close from prices_monthly")
def a12_panel_json(spark, d):
    path = scratch(spark, "panel")
    sinks.panel_json(A.prices_monthly(spark, d).select("date", "ticker", F.when(F.col("close") > -1, F.round("close", 6)).otherwise(float("nan")).alias("close")), path, "2024-01-31")
    return spark.read.schema("as_of string, date date, ticker string, close double").json(path)


@query("select event_id, event_type from events")
def a13_cumulative_append(spark, d):
    path = scratch(spark, "cumulative")
    e = A.table(spark, d, "events").select("event_id", "event_type")
    sinks.append_new_rows(e.where("event_id % 3 < 2"), path)
    sinks.append_new_rows(e.where("event_id % 3 > 0"), path)
    return spark.read.schema(e.schema).parquet(path)


@query("with h as (select distinct manager, quarter, cusip, max(quarter) over () as newest from holdings), fresh as (select distinct manager from h where quarter = newest and manager % 2 = 0) select manager, quarter, cusip from h where (manager in (from fresh) and quarter = newest) or (manager not in (from fresh) and quarter < newest)")
def a14_replace_keys(spark, d):
    """A table of all quarters before the newest; then half of the managers are replaced by their rows of the newest."""
    path = scratch(spark, "managers")
    h = A.holdings(spark, d).select("manager", "quarter", "cusip").distinct()
    h = h.crossJoin(F.broadcast(h.agg(F.max("quarter").alias("newest"))))  # one row
    sinks.replace_keys(h.where("quarter < newest").drop("newest"), path, "manager")
    sinks.replace_keys(h.where("quarter = newest and manager % 2 = 0").drop("newest"), path, "manager")
    return spark.read.parquet(path).select(F.col("manager").cast("long").alias("manager"), "quarter", "cusip")


@query("select 'a' as config_sig, count(*) as rows from prices_monthly union all select 'b', count(*) from prices")
def a15_run_artifacts(spark, d):
    path = scratch(spark, "runs")
    for sig, df in (("a", A.prices(spark, d)), ("b", A.prices(spark, d)), ("a", A.prices_monthly(spark, d))):
        sinks.save_run(df, path, sig)
    return sinks.list_runs(spark, path)


@query("select url, 'page ' || page_id as title, '2024-01-02T03:04:05Z' as seen, 'en' as language from pages where page_id % 9 <> 0")
def a16_article_list(spark, d):
    path = scratch(spark, "articles")
    p = A.table(spark, d, "pages")
    a = F.struct(F.when(F.col("page_id") % 9 == 0, "").otherwise(F.col("url")).alias("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.lit("20240102T030405Z").alias("seendate"), F.lit("en").alias("language"))
    p.groupBy((F.col("page_id") % 20).alias("g")).agg(F.collect_list(a).alias("articles")).select("articles").write.json(path)
    return readers.article_list(spark, path, multi_line=False)


@query("select strftime(date, '%Y%m%d') as date, round(avg(close), 4) as tone, round(sum(volume), 4) as volume from prices_monthly group by 1")
def a17_timeline(spark, d):
    path = scratch(spark, "timeline")
    m = A.prices_monthly(spark, d).groupBy(F.date_format("date", "yyyyMMdd").alias("date")).agg(F.round(F.avg("close"), 4).alias("Tone"), F.round(F.sum("volume"), 4).alias("Volume"))
    long = m.unpivot("date", ["Tone", "Volume"], "series", "value").groupBy("series").agg(F.collect_list(F.struct("date", "value")).alias("data"))
    long.agg(F.collect_list(F.struct("series", "data")).alias("timeline")).write.json(path)
    return readers.timeline(spark, path, multi_line=False)


ROW_HASH = "('0x' || substr(md5({}), 1, 8))::bigint"
HELD = f"select 'prices' as name, count(*) as rows, sum({ROW_HASH.format("date || '|' || ticker || '|' || printf('%.2f', volume)")})::bigint as hash from prices union all select 'facts', count(*), sum({ROW_HASH.format("concat_ws('|', ticker, metric, " + chr(34) + "end" + chr(34) + ", filed, form, printf('%.2f', value))")})::bigint from facts"


@query(f"select * from held union all select '*', sum(rows)::bigint, sum({ROW_HASH.format("name || '|' || rows || '|' || hash")})::bigint from held", {"held": HELD})
def a18_manifest(spark, d):
    return sinks.manifest({"prices": A.prices(spark, d).select("date", "ticker", "volume"), "facts": A.facts(spark, d).select("ticker", "metric", "end", "filed", "form", "value")})


@query("select ref_date as month, round(min(value), 4) as value from vintages where month(ref_date) <> 3 group by 1")
def a19_monthly_index(spark, d):
    path = scratch(spark, "index")
    v = A.vintages(spark, d).groupBy("ref_date").agg(F.round(F.min("value"), 4).alias("v"))
    row = F.when(F.month("ref_date") == 3, F.array(F.lit("short"))).otherwise(F.array(F.concat(F.col("ref_date").cast("string"), F.lit("T00:00")), F.format_string("%.4f", "v")))
    v.groupBy(F.year("ref_date").alias("y")).agg(F.collect_list(row).alias("rows")).select("rows").write.json(path)
    return readers.monthly_index(spark, path, multi_line=False).select("month", F.round("value", 4).alias("value"))


@query("select 'A ' || c_name as member, 'S' || c_nationkey as office, 'P' as type, 2024 as year, cast(c_custkey as varchar) as document from customer where c_custkey % 4 <> 0")
def a20_filing_index(spark, d):
    path = scratch(spark, "filings")
    c = A.table(spark, d, "customer")
    c.select(F.col("c_name").alias("Last"), F.lit("A").alias("First"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("StateDst"), F.lit("P").alias("FilingType"), F.lit(2024).alias("Year"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("string")).alias("DocID")).write.format("xml").option("rowTag", "Member").option("rootTag", "Members").save(path)
    return readers.filing_index(spark, path).select("member", "office", "type", F.col("year").cast("long").alias("year"), "document")


def day_files(spark, d) -> tuple[str, object]:
    """events as files by day: what a poller would leave behind."""
    path = scratch(spark, "events")
    e = A.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    e.repartition(8, "day").sortWithinPartitions("day").drop("day").write.parquet(path)
    return path, e.drop("day").schema


@query("select event_id, ts, event_type from events where ts > timestamp '2024-01-05' and ts <= timestamp '2024-01-20'")
def i01_snapshot_ingest(spark, d):
    path, schema = day_files(spark, d)
    table, late, ck = (scratch(spark, n) for n in ("table", "late", "ck"))
    stream = feeds.file_stream(spark, path, schema, 3)
    feeds.collect_window(stream, table, late, ck, "ts", "2024-01-05", "2024-01-20")
    return spark.read.schema(schema).parquet(table).select("event_id", "ts", "event_type")


@query("select cast(ts as date) as day, event_type from events group by 1, 2")
def i02_ingest_ledger(spark, d):
    path, schema = day_files(spark, d)
    ledger, ck = scratch(spark, "ledger"), scratch(spark, "ck")
    stream = feeds.file_stream(spark, path, schema, 3).withColumn("day", F.to_date("ts"))
    feeds.ingest_ledger(stream, ledger, ck, ["day", "event_type"], "day")
    return spark.read.schema("day date, event_type string").parquet(ledger).select("day", "event_type")


@query("select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1 and date_diff('day', cast(ts as date), (select max(cast(ts as date)) from events)) < 30")
def i03_newest_wins(spark, d):
    path, schema = day_files(spark, d)
    table, ck = scratch(spark, "table"), scratch(spark, "ck")
    feeds.merge_newest(feeds.file_stream(spark, path, schema, 1), table, ck, "user_id", "ts", "event_id", keep_days=30, every=3)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return feeds.read_newest(spark, table, names, "user_id", "ts", "event_id", keep_days=30).select("user_id", "event_id", "ts")


def drained(spark, d, window: str, slide: str | None, view: str) -> DataFrame:
    """Event-time counts through the engine's state store. Each batch adds the counts that it moved; windows that the
    watermark has passed leave the state. Of a window the counts of the last batch stand."""
    path, schema = day_files(spark, d)
    out, ck = scratch(spark, "windows"), scratch(spark, "ck")
    counts = feeds.windowed_counts(feeds.file_stream(spark, path, schema, 3), "ts", "event_type", window, slide, "60 days")
    flat = counts.select(F.to_date("window.start").alias("day"), F.to_date("window.end").alias("until"), "event_type", "n")
    q = flat.writeStream.outputMode("update").foreachBatch(lambda df, i: feeds._put(df, f"{out}/{view}", i)).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    moved = spark.read.schema("day date, until date, event_type string, n long, batch long").parquet(f"{out}/{view}")
    return moved.groupBy("day", "until", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2")
def i04_tumbling_counts(spark, d):
    return drained(spark, d, "1 day", None, "tumbling").select("day", "event_type", "n")


@query("select a.until as day, a.event_type, a.n as n7, coalesce(b.n, 0) as prior7 from w7 a left join w7 b on b.event_type = a.event_type and b.until = a.until - 7", {"w7": "select u.until, event_type, count(*) as n from (select unnest(generate_series(date '2023-12-25', date '2024-02-20', interval 1 day))::date as until) u join events e on e.ts >= u.until - interval 7 day and e.ts < u.until group by 1, 2"})
def i05_velocity(spark, d):
    w = drained(spark, d, "7 days", "1 day", "sliding")
    prior = w.select(F.date_add("until", 7).alias("until"), "event_type", F.col("n").alias("p"))
    return w.join(prior, ["until", "event_type"], "left").select(F.col("until").alias("day"), "event_type", F.col("n").alias("n7"), F.coalesce("p", F.lit(0)).cast("long").alias("prior7"))


@query("select event_id from events where ts is null or ts > timestamp '2024-01-20' or ts <= timestamp '2024-01-05'")
def i06_quarantine(spark, d):
    path, schema = day_files(spark, d)
    table, late, ck = (scratch(spark, n) for n in ("table", "late", "ck"))
    feeds.collect_window(feeds.file_stream(spark, path, schema, 3), table, late, ck, "ts", "2024-01-05", "2024-01-20")
    return spark.read.schema(schema).parquet(late).select("event_id")


@query("select event_id, event_type from events where isodow(ts) <= 5")
def i07_checkpointed_resume(spark, d):
    """Daily files of business days: a collection that stops after some days, and one that finds which days are missing,
    fetches them and goes on under the same checkpoint. Every row arrives once."""
    stage, table, ck = scratch(spark, "stage"), scratch(spark, "table"), scratch(spark, "ck")
    e = A.table(spark, d, "events").select("event_id", "event_type", F.to_date("ts").alias("day"))
    first, last = e.agg(F.min("day"), F.max("day")).first()
    held = e.limit(0)
    for until in (first + (last - first) / 2, last) if first else ():
        days = feeds.missing_business_days(held, "day", str(first), str(until))
        e.join(F.broadcast(days), "day").write.mode("append").partitionBy("day").parquet(stage)  # a calendar
        feeds.append_batches(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 100).parquet(stage), table, ck)
        held = spark.read.schema(e.schema).parquet(table)
    return held.select("event_id", "event_type")


NOTICES = """select kind, event_id, arm, arrived, target_t, seal, case when kind = 'reveal' then value end as value from (
select unnest([
  {kind: 'commit', skip: event_id % 13 = 0, arm: '', arrived: ts - interval 5 day, seal: round(value, 2)},
  {kind: 'commit', skip: event_id % 11 <> 0, arm: '', arrived: ts - interval 4 day, seal: round(value, 2) + 1},
  {kind: 'commit', skip: event_id % 4 <> 0, arm: '', arrived: ts - interval 3 day, seal: round(value, 2)},
  {kind: 'reveal', skip: event_id % 7 <> 0, arm: 'a', arrived: ts - interval 1 day, seal: null},
  {kind: 'reveal', skip: false, arm: 'a', arrived: ts + interval 1 day, seal: null},
  {kind: 'reveal', skip: event_id % 3 <> 0, arm: 'b', arrived: ts + interval 2 day, seal: null},
  {kind: 'reveal', skip: event_id % 5 <> 0, arm: 'a', arrived: ts + interval 3 day, seal: null}], recursive := true), event_id, ts as target_t, value from events) where not skip"""
SEALED = "select event_id, min(arrived) as at, arg_min(seal, arrived) as seal from notices where kind = 'commit' group by 1"
JUDGED = """select n.kind, n.event_id, n.arm, n.arrived, case when n.kind = 'commit' then case when n.arrived = s.at then 'sealed' when n.seal = s.seal then 'repeated' else 'changed' end
  when s.at is null or s.at > n.arrived then 'no commit' when n.arrived < n.target_t then 'early'
  when exists (select 1 from notices o where o.event_id = n.event_id and o.kind = 'reveal' and o.arm = n.arm and o.arrived < n.arrived and o.arrived >= n.target_t and s.at <= o.arrived) then 'repeated' else 'scored' end as verdict
from notices n left join sealed s using (event_id)"""


@query("select kind, event_id, arm, arrived, verdict from judged", {"notices": NOTICES, "sealed": SEALED, "judged": JUDGED})
def i08_commit_reveal(spark, d):
    """Predictions sealed, changed, revealed too early, in time and twice, as they arrive in three polls."""
    stage, table, ck = scratch(spark, "stage"), scratch(spark, "table"), scratch(spark, "ck")
    e = A.table(spark, d, "events").select("event_id", "ts", F.round("value", 2).alias("v"), "value")
    n = F.col("event_id")
    day = lambda k: F.col("ts") + F.expr(f"interval {k} day")
    seal = lambda c: F.sha2(F.format_string("%.2f", c), 256)
    made = [
        ("commit", n % 13 != 0, "", -5, seal(F.col("v"))), ("commit", n % 11 == 0, "", -4, seal(F.col("v") + 1)), ("commit", n % 4 == 0, "", -3, seal(F.col("v"))),
        ("reveal", n % 7 == 0, "a", -1, None), ("reveal", F.lit(True), "a", 1, None), ("reveal", n % 3 == 0, "b", 2, None), ("reveal", n % 5 == 0, "a", 3, None),
    ]
    notes = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(arm).alias("arm"), day(at).alias("arrived"), (F.lit(None).cast("string") if s is None else s).alias("seal"))) for k, c, arm, at, s in made]), lambda x: x.isNotNull())
    notes = e.select(n.cast("string").alias("config"), F.timestamp_micros(F.lit(0)).alias("predict_ts"), F.col("ts").alias("target_t"), "value", F.explode(notes).alias("n")).select("n.kind", "config", "predict_ts", "target_t", "n.arm", "n.seal", "value", "n.arrived")
    notes.write.parquet(all_ := scratch(spark, "notices"))
    notes = spark.read.parquet(all_)
    names = [c.split()[0] for c in feeds.EVENTS.split(", ")]
    first, last, known = notes.agg(F.min("arrived"), F.max("arrived"), F.count("*")).first()
    cuts = [first + (last - first) * k / 3 for k in range(3)] + [last] if first else []
    buckets = max(32, known // 16_000)  # some thousand events of a poll in a call
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        notes.where(F.col("arrived").between(F.lit(lo), F.lit(hi)) if k == 0 else (F.col("arrived") > F.lit(lo)) & (F.col("arrived") <= F.lit(hi))).select(*names).write.mode("append").parquet(stage)
        verdicts = feeds.commit_reveal(spark.readStream.schema(feeds.EVENTS).parquet(stage), keep_days=30, late="1 day", buckets=buckets)
        q = verdicts.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.schema(feeds.VERDICTS).parquet(table) if cuts else spark.createDataFrame([], feeds.VERDICTS)
    return out.select("kind", F.col("config").cast("long").alias("event_id"), "arm", "arrived", "verdict")


ARM_IC = "select {run} as run, arm, date as month, corr(rs, ry) as ic from (select *, rank() over (partition by arm, date order by x) + (count(*) over (partition by arm, date, x) - 1) / 2.0 as rs, rank() over (partition by arm, date order by y) + (count(*) over (partition by arm, date, y) - 1) / 2.0 as ry from (select unnest(['a', 'b']) as arm, date, unnest([close, volume]) as x, y from (select *, lead(close, {h}) over (partition by ticker order by date) / close - 1 as y from prices_monthly) where y is not null)) group by 2, 3 having count(*) >= 5"


@query("select month, round(a, 6) as a, round(b, 6) as b, round(a - b, 6) as difference, round(avg(a - b) over (order by month), 6) as so_far from (select month, max(ic) filter (arm = 'a') as a, max(ic) filter (arm = 'b') as b from (select arm, month, min_by(ic, run) as ic from runs where not isnan(ic) group by 1, 2) group by 1) where a is not null and b is not null", {"runs": f"select * from ({ARM_IC.format(run=1, h=1)}) where month < date '1999-01-01' union all select * from ({ARM_IC.format(run=2, h=3)})"})
def i09_paired_accumulation(spark, d):
    """Rank ICs of two arms, collected run after run in a table that only grows: of a month the first run counts, whatever
    later runs find. Months known for both arms give the difference and its mean so far."""
    from ..operators import inference as I

    ledger = scratch(spark, "ics")
    p = A.prices_monthly(spark, d)
    for run, h in ((1, 1), (2, 3)):
        y = p.withColumn("y", R.forward_return(h)).where("y is not null")
        arms = y.select("date", "y", F.explode(F.array(F.struct(F.lit("a").alias("arm"), F.col("close").alias("x")), F.struct(F.lit("b").alias("arm"), F.col("volume").alias("x")))).alias("s")).select("date", "y", "s.arm", "s.x")
        ics = I.rank_ic(arms, ["arm", "date"], "x", "y").select(F.lit(run).alias("run"), "arm", F.col("date").alias("month"), "ic")
        sinks.append_new_rows(ics.where("month < '1999-01-01'") if run == 1 else ics, ledger)
    held = spark.read.schema("run int, arm string, month date, ic double").parquet(ledger)
    first = held.groupBy("arm", "month").agg(F.min_by("ic", "run").alias("ic"))
    wide = first.groupBy("month").pivot("arm", ["a", "b"]).agg(F.max("ic")).where("a is not null and b is not null")
    so_far = F.avg(F.col("a") - F.col("b")).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))  # months
    return wide.select("month", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("a") - F.col("b"), 6).alias("difference"), F.round(so_far, 6).alias("so_far"))


@query("select event_id, event_type from events where ts >= timestamp '2024-01-10'")
def i10_incremental_delta(spark, d):
    """A backfill and then only what is newer than the newest row held."""
    table = scratch(spark, "table")
    e = A.table(spark, d, "events").where("ts >= timestamp '2024-01-10'").select("event_id", "event_type", "ts")
    sinks.append_new_rows(e.where("ts < timestamp '2024-01-20'"), table)
    last = spark.read.schema(e.schema).parquet(table).agg(F.max("ts")).first()[0]
    delta = e if last is None else e.where(F.col("ts") >= F.lit(last))
    sinks.append_new_rows(delta, table)
    return spark.read.schema(e.schema).parquet(table).select("event_id", "event_type")


@query("select event_id, ticker, k from study_events, (select unnest([0, 1]) as k)")
def j05_row_exploding_udtf(spark, d):
    """A user's Python table function, run laterally over a table."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="k int")
    class Twice:
        def eval(self, _):
            yield (0,)
            yield (1,)

    spark.udtf.register("chronopanel_twice", Twice)
    A.study_events(spark, d).createOrReplaceTempView("chronopanel_study_events")
    return spark.sql("select event_id, ticker, k from chronopanel_study_events, lateral chronopanel_twice(event_id)")
