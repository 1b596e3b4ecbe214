"""Licence scan by canonical digest: whole texts, and whole lines of texts, against known licence texts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash128, text_of

# Short public licence notices, as (identifier, text). Whole licences are in the folder TEXTS, by identifier.
TEXTS = Path(__file__).parent / "licenses"
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)

# Endings that are spelled in two ways, as (pattern, common form).
SPELLINGS = (
    (r"licenc(e|es|ed|ing|or|ors|ee|ees)( |$)", "licens$1$2"),
    (r"(\p{L})is(e|es|ed|ing|er|ation|ations)( |$)", "$1iz$2$3"),
    (r"(\p{L})our(s|ed|able|)( |$)", "$1or$2$3"),
    (r"dgement( |$)", "dgment$1"),
)


#: Lines that name who holds a copyright, or reserve rights; not lines of a licence that happen to begin with the word.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:(?:portions )?copyright[ \t]*(?:\(c\)|©|:|[0-9<\[])[^\n]*|(?:\(c\)|©)[ \t]*[0-9<\[][^\n]*|all rights reserved\.?[ \t]*)$"
#: Where the terms of some licences end and advice on using them begins.
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, equivalent spellings, letters and digits separated by one space."""
    c = F.lower(text)
    c = F.regexp_replace(c, COPYRIGHT_LINE, " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    for pattern, common in SPELLINGS:
        c = F.regexp_replace(c, pattern, common)
    return F.trim(c)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def whole_licenses() -> list[tuple[str, str]]:
    """(identifier, text) of the whole licences: as they are, without the line that names them, and without advice after
    the terms."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        title, _, rest = text.lstrip().partition("\n\n")
        forms = [text, rest] if "\n" not in title and len(title) < 80 else [text]
        for form in forms:
            terms, end, _ = form.partition(END_OF_TERMS)
            out += [(path.stem, x) for x in ([form, terms, terms + end] if end else [form])]
    return out


def known_licenses(spark: SparkSession, known=None) -> DataFrame:
    """(license_id, digest) of the known texts, one row a digest: of notices and whole licences, or of ``known``."""
    known = [*KNOWN, *whole_licenses()] if known is None else known
    return spark.createDataFrame(list(known), "license_id string, license_text string").groupBy(digest(F.col("license_text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Match each whole text, and each whole line of it, with known licences by canonical digest.

    ``known``: (license_id, digest), as from known_licenses(); any size, Spark picks the join.

    Returns (id_col, text_digest, license_id, notice_ids, n_notice_lines): the canonical digest of the whole text, the
    licence whose digest it is (null if none), the sorted distinct licences whose digest a line has (comma-separated,
    empty if none) and the number of such lines. Null text counts as empty; a canonical form that is empty (no letters
    or digits) matches nothing. One row is given for each row of docs, repeated rows and null ids included.
    """
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).select(F.col("digest").alias("__digest"), F.col("license_id").alias("__license"))
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))
    whole = rows.select("__id", hash128(F.col("__text")).alias("__t"), digest(F.col("__text")).alias("text_digest"))
    lines = (
        rows.select("__id", hash128(F.col("__text")).alias("__t"), F.explode(F.split("__text", "\n")).alias("__line"))
        .select("__id", "__t", digest(F.col("__line")).alias("__line_digest"))
        .join(known, F.col("__line_digest") == F.col("__digest"))
        .groupBy("__id", "__t")
        .agg(F.array_join(F.sort_array(F.collect_set("__license")), ",").alias("notice_ids"), F.count("*").alias("__n"))
        .select(F.col("__id").alias("__lid"), F.col("__t").alias("__lt"), "notice_ids", "__n")
    )
    copies = whole.groupBy("__id", "__t", "text_digest").agg(F.count("*").alias("__copies"))
    joined = (
        copies.join(known, F.col("text_digest") == F.col("__digest"), "left")
        .join(lines, F.col("__id").eqNullSafe(F.col("__lid")) & (F.col("__t") == F.col("__lt")), "left")
        .withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    )
    return joined.select(
        F.col("__id").alias(id_col),
        "text_digest",
        F.col("__license").alias("license_id"),
        F.coalesce("notice_ids", F.lit("")).alias("notice_ids"),
        F.coalesce(F.expr("__n div __copies"), F.lit(0)).cast("long").alias("n_notice_lines"),
    )
