"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, stored  # noqa: F401

#: ASCII white space: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same on pure ASCII and is faster there."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    trimmed = F.trim(c, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS))


def hash128(*cols: Column) -> Column:
    """Two differently seeded 64-bit hashes as one struct; equal only for equal input for all practical purposes."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(0x5BD1E995), *cols).alias("b"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, inside one expression."""
    return F.transform(F.array(value), body)[0]
