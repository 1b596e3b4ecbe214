"""Sinks: cumulative and per-key replaced Parquet, panel JSON, run artifacts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers after ``prefix`` in the names of the folders under path."""
    fs, p = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def row_hashes(columns: list[str]) -> list[Column]:
    """Two 64-bit hashes of a whole row, in which it counts where a null stands."""
    cells = [F.col(f"`{c}`") for c in columns]
    cells += [c.isNull() for c in cells]
    return [F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)]


def append_new_rows(rows: DataFrame, path: str) -> None:
    """Append the distinct rows that the table does not hold yet; nulls compare equal. History is never rewritten."""
    spark = rows.sparkSession
    new = rows.distinct()
    if exists(spark, path):
        old = spark.read.schema(rows.schema).parquet(path)
        seen = old.select(*[h.alias(f"__s{i}") for i, h in enumerate(row_hashes(rows.columns))])
        new = new.join(seen, [h == F.col(f"__s{i}") for i, h in enumerate(row_hashes(rows.columns))], "left_anti")
    new.write.mode("append").parquet(path)


def replace_keys(rows: DataFrame, path: str, key: str) -> None:
    """Rewrite only the partitions of the keys in rows; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def panel_json(df: DataFrame, path: str, as_of: str) -> None:
    """JSON lines with an as-of stamp; NaN becomes null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(F.lit(as_of).alias("as_of"), *clean).write.mode("overwrite").json(path)


def save_run(df: DataFrame, path: str, config_sig: str) -> None:
    replace_keys(df.withColumn("config_sig", F.lit(config_sig)), path, "config_sig")


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("config_sig").agg(F.count("*").alias("rows"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, hash) of each table and one hash of them all (name *)."""
    from ..operators.monitor import fingerprint

    out = None
    for name, df in tables.items():
        row = df.agg(*fingerprint(df)).select(F.lit(name).alias("name"), "rows", "hash")
        out = row if out is None else out.unionByName(row)
    whole = out.agg(F.lit("*").alias("name"), F.sum("rows").alias("rows"), F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", "name", F.col("rows").cast("string"), F.col("hash").cast("string"))), 1, 8), 16, 10).cast("long")).alias("hash"))
    return out.unionByName(whole)
