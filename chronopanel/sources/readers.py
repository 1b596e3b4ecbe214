"""Readers: JSON, CSV, text and XML files to canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vintage_observations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(ref_date, realtime_start, value) from JSON with an observations array; "." and "" are null."""
    schema = "observations array<struct<date:string, realtime_start:string, value:string>>"
    o = spark.read.schema(schema).json(path, multiLine=multi_line).select(F.explode("observations").alias("o"))
    value = F.expr("try_cast(nullif(nullif(o.value, '.'), '') as double)")
    return o.select(F.expr("try_cast(o.date as date)").alias("ref_date"), F.expr("try_cast(o.realtime_start as date)").alias("realtime_start"), value.alias("value"))


def company_facts(spark: SparkSession, path: str, tags: dict[str, list[str]]) -> DataFrame:
    """As-filed facts from nested JSON: facts -> us-gaap -> tag -> units -> rows; per metric the first tag with rows wins."""
    fact = "struct<end:string, val:double, fy:int, fp:string, form:string, filed:string>"
    schema = f"ticker string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<{fact}>>>>>"
    raw = spark.read.schema(schema).json(path)
    rows = raw.select("ticker", F.explode("facts.us-gaap").alias("tag", "body")).select("ticker", "tag", F.explode("body.units").alias("unit", "list"))
    rows = rows.select("ticker", "tag", "unit", F.explode("list").alias("f")).where("f.form in ('10-K', '10-Q') and f.fy is not null and f.fp is not null")
    ranks = spark.createDataFrame([(m, t, i) for m, ts in tags.items() for i, t in enumerate(ts)], "metric string, tag string, rank int")
    rows = rows.join(F.broadcast(ranks), "tag")
    best = rows.groupBy("ticker", "metric").agg(F.min("rank").alias("rank"))
    return rows.join(best, ["ticker", "metric", "rank"]).select("ticker", "metric", F.expr("try_cast(f.end as date)").alias("end"), F.expr("try_cast(f.filed as date)").alias("filed"), "f.form", "f.fy", "f.fp", F.col("f.val").alias("value"), "unit")


def fund_holdings(spark: SparkSession, path: str, dialects: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Newest file per fund by the name FUND_YYYYMMDD.csv: (fund, as_of, ticker, weight, shares).

    dialects: fund -> {canonical column: column in that fund's files}; others use ticker, weight, shares.
    """
    lines = spark.read.option("header", True).csv(path).withColumn("__f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    lines = lines.withColumns({"fund": F.regexp_extract("__f", r"^([A-Za-z]+)_(\d{8})", 1), "as_of": F.regexp_extract("__f", r"^([A-Za-z]+)_(\d{8})", 2)})
    newest = lines.groupBy("fund").agg(F.max("as_of").alias("__new"))
    lines = lines.join(F.broadcast(newest), "fund").where("as_of = __new")  # one row a fund

    def pick(name: str):
        c = F.col(name) if name in lines.columns else F.lit(None).cast("string")
        for fund, names in (dialects or {}).items():
            if names.get(name) in lines.columns:
                c = F.when(F.col("fund") == fund, F.col(names[name])).otherwise(c)
        return c

    number = lambda n: F.expr("try_cast(x as double)") if n is None else F.try_to_number(F.regexp_replace(pick(n), "[,%$ ]", ""), F.lit("999999999999.999999")).cast("double")
    return lines.select("fund", F.to_date("as_of", "yyyyMMdd").alias("as_of"), pick("ticker").alias("ticker"), number("weight").alias("weight"), number("shares").alias("shares"))


def crawler_index(spark: SparkSession, path: str, forms: list[str]) -> DataFrame:
    """(form, company, cik, filed, file) from an index of columns apart by two or more blanks."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s{2,}").alias("p")).where(F.size("p") >= 5)
    rows = parts.select(F.get("p", F.lit(0)).alias("company"), F.get("p", F.lit(1)).alias("form"), F.get("p", F.lit(2)).alias("cik"), F.get("p", F.lit(3)).alias("filed"), F.get("p", F.lit(4)).alias("file"))
    return rows.where(F.col("form").isin(*forms) & F.col("cik").rlike(r"^\d+$") & F.col("filed").rlike(r"^\d{8}$")).withColumn("filed", F.try_to_date("filed", "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date("filed", "yyyyMMdd"))


def information_table(spark: SparkSession, path: str) -> DataFrame:
    """Holdings of an XML information table."""
    schema = T.StructType().add("nameOfIssuer", "string").add("titleOfClass", "string").add("cusip", "string").add("value", "double").add("putCall", "string").add("shrsOrPrnAmt", T.StructType().add("sshPrnamt", "double").add("sshPrnamtType", "string"))
    rows = spark.read.format("xml").option("rowTag", "infoTable").schema(schema).load(path)
    return rows.select(F.col("nameOfIssuer").alias("issuer"), F.col("titleOfClass").alias("title_class"), F.upper("cusip").alias("cusip"), F.col("value").alias("value_usd"), F.col("shrsOrPrnAmt.sshPrnamt").alias("shares"), F.coalesce("putCall", F.lit("")).alias("option_type"))


def insider_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Buys (P) and sales (S) of an ownership XML: positive shares, price not negative, with an owner."""
    value = T.StructType().add("value", "string")
    tx = T.StructType().add("transactionDate", value).add("transactionCoding", T.StructType().add("transactionCode", "string")).add("transactionAmounts", T.StructType().add("transactionShares", value).add("transactionPricePerShare", value))
    schema = (
        T.StructType().add("issuer", T.StructType().add("issuerTradingSymbol", "string"))
        .add("reportingOwner", T.StructType().add("reportingOwnerId", T.StructType().add("rptOwnerCik", "string").add("rptOwnerName", "string")))
        .add("nonDerivativeTable", T.StructType().add("nonDerivativeTransaction", T.ArrayType(tx)))
    )
    rows = spark.read.format("xml").option("rowTag", "ownershipDocument").schema(schema).load(path)
    rows = rows.select(F.col("issuer.issuerTradingSymbol").alias("ticker"), F.col("reportingOwner.reportingOwnerId.rptOwnerCik").alias("owner"), F.explode("nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    rows = rows.select("ticker", "owner", F.col("t.transactionCoding.transactionCode").alias("code"), F.expr("try_cast(substr(t.transactionDate.value, 1, 10) as date)").alias("date"), F.expr("try_cast(t.transactionAmounts.transactionShares.value as double)").alias("shares"), F.expr("try_cast(t.transactionAmounts.transactionPricePerShare.value as double)").alias("price"))
    return rows.where("code in ('P', 'S') and shares > 0 and price >= 0 and owner is not null and owner <> ''")


def factor_file(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Daily factors keyed by an 8-digit date, percent to decimal; rows with a gap are dropped."""
    parts = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d{8}\s*,")).select(F.split("value", r"\s*,\s*").alias("p"))
    cols = [(F.expr(f"try_cast(get(p, {i + 1}) as double)") / 100).alias(n) for i, n in enumerate(names)]
    return parts.select(F.to_date(F.trim(F.get("p", F.lit(0))), "yyyyMMdd").alias("date"), *cols).dropna()


def membership_files(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker) from tab-separated files named by month (YYYY-MM...), first column; tickers normalised, distinct."""
    from ..functions.text import normal_ticker

    rows = spark.read.text(path).withColumn("__d", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2})[^/]*$", 1))
    ticker = normal_ticker(F.get(F.split("value", "\t"), F.lit(0)))
    return rows.select(F.to_date(F.concat("__d", F.lit("-01"))).alias("date"), ticker.alias("ticker")).where("ticker != ''").distinct()


def membership_lists(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker) from a CSV of a date and a comma list."""
    from ..functions.text import normal_ticker

    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.to_date("date").alias("date"), F.explode(F.split("tickers", ",")).alias("t")).select("date", normal_ticker(F.col("t")).alias("ticker")).where("ticker != ''").distinct()


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only JSON lines; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def article_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    schema = "articles array<struct<url:string, title:string, seendate:string, language:string>>"
    from ..functions.text import seen_date

    rows = spark.read.schema(schema).json(path, multiLine=multi_line).select(F.explode("articles").alias("a")).where("a.url <> ''")
    return rows.select("a.url", "a.title", seen_date(F.col("a.seendate")).alias("seen"), "a.language")


def timeline(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row a date from named series of (date, value): tone and volume."""
    schema = "timeline array<struct<series:string, data:array<struct<date:string, value:double>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=multi_line).select(F.explode("timeline").alias("t")).select("t.series", F.explode("t.data").alias("p"))
    pick = lambda s: F.max(F.when(F.lower("series").contains(s), F.col("p.value")))
    return rows.groupBy(F.substring("p.date", 1, 8).alias("date")).agg(pick("tone").alias("tone"), pick("volume").alias("volume"))


def monthly_index(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(month, value) from JSON rows [date text, value text]; short or unreadable rows are dropped."""
    rows = spark.read.schema("rows array<array<string>>").json(path, multiLine=multi_line).select(F.explode("rows").alias("r")).where(F.size("r") >= 2)
    return rows.select(F.expr("try_cast(concat(substr(r[0], 1, 7), '-01') as date)").alias("month"), F.expr("try_cast(r[1] as double)").alias("value")).dropna()


def filing_index(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType().add("Last", "string").add("First", "string").add("StateDst", "string").add("FilingType", "string").add("Year", T.IntegerType()).add("DocID", "string")
    rows = spark.read.format("xml").option("rowTag", "Member").schema(schema).load(path)
    return rows.where("DocID is not null").select(F.concat_ws(" ", "First", "Last").alias("member"), F.col("StateDst").alias("office"), F.col("FilingType").alias("type"), F.col("Year").alias("year"), F.col("DocID").alias("document"))
