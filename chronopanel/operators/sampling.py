"""A deterministic stratified sample with a report of what it could not give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def stratified_sample(records: DataFrame, quotas: DataFrame, as_of: Column, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sample and the report.

    records: (event_id, event_type, sector, filed, h), h being the sha-256 of the event's text in hex; quotas: (event_type,
    year, sector, quota). Rejected are records without a time, timed after ``as_of``, or without such a hash; then every
    hash of an event that has several, and every hash that several events have. Of what is left an (event, hash) counts
    once, with its first type, sector and time. A stratum gives its first ``quota`` records in the order of the sha-256 of
    "seed|event|hash".

    Sample: (event_type, year, sector, k, event_id, h, filed). Report: (kind, event_type, year, sector, requested, found)
    with the kinds shortfall, unrequested (both by stratum), missing_filed, future_filed, illegal_hash (records),
    event_hash_conflict (events) and conflicting_hash (hashes). Conflicts are found by two combined aggregates and anti-joins;
    a stratum's order is a window whose first rows are picked before the exchange. Empty tables give empty ones.
    """
    reason = F.when(F.col("filed").isNull(), "missing_filed").when(F.col("filed") > as_of, "future_filed").when(~F.coalesce(F.col("h").rlike("^[0-9a-f]{64}$"), F.lit(False)), "illegal_hash")
    checked = records.withColumn("reason", reason)
    legal = stored(checked.where("reason is null").select("event_id", "event_type", "sector", "filed", "h").distinct(), "legal-records")
    twice = stored(legal.groupBy("event_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("event_id"), "events-in-conflict")
    shared = legal.groupBy("h").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).where("a <> b").select("h")
    bad = stored(legal.join(twice, "event_id", "left_semi").select("h").unionByName(shared).distinct(), "hashes-in-conflict")
    kept = legal.join(bad, "h", "left_anti").groupBy("event_id", "h").agg(F.min("event_type").alias("event_type"), F.min_by("sector", F.concat_ws("|", "event_type", "sector")).alias("sector"), F.min("filed").alias("filed"))
    stratum = ["event_type", "year", "sector"]
    kept = stored(kept.withColumn("year", F.year("filed")), "sample-candidates")
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), "event_id", "h"), 256)
    asked = kept.join(quotas, stratum)
    sample = asked.withColumn("k", F.row_number().over(Window.partitionBy(*stratum).orderBy(order, "event_id")).cast("long")).where("k <= quota").select(*stratum, "k", "event_id", "h", "filed")
    sizes = kept.groupBy(*stratum).agg(F.count("*").alias("found"))
    short = quotas.join(sizes, stratum, "left").select(F.lit("shortfall").alias("kind"), *stratum, F.col("quota").cast("long").alias("requested"), F.coalesce("found", F.lit(0)).alias("found")).where("found < requested")
    extra = sizes.join(quotas, stratum, "left_anti").select(F.lit("unrequested").alias("kind"), *stratum, F.lit(0).cast("long").alias("requested"), "found")
    null = [F.lit(None).cast(t).alias(c) for c, t in (("event_type", "string"), ("year", "int"), ("sector", "string"), ("requested", "long"))]
    counted = lambda df, kind: df.agg(F.count("*").alias("found")).where("found > 0").select(F.lit(kind).alias("kind"), *null, "found")
    rejected = checked.where("reason is not null").groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("found")).select("kind", *null, "found")
    report = short.unionByName(extra).unionByName(rejected).unionByName(counted(twice, "event_hash_conflict")).unionByName(counted(bad, "conflicting_hash"))
    return sample, report
