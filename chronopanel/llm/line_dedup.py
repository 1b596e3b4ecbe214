"""Corpus-wide removal of repeated lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, hash128, stored, text_of


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop every line whose key is common, except in the largest id that holds it.

    Lines are exploded and hashed; a hash found under ``min_docs`` distinct ids or more, with a key of ``min_chars`` code
    points or more, is common. Line positions to drop are gathered per row and the other lines are joined by ``\\n``.

    Returns docs with ``text_col`` replaced and ``n_lines``, ``n_dropped`` added (replacing columns of that name).
    Null or empty text is one empty line. Rows with a null id count for no document and keep no line that is common.
    Repeated rows each give a row; the same id twice counts once. An empty table gives an empty table. Other columns
    are kept, whatever their names.

    Shuffles: line hashes (by hash; counts are combined before the exchange, so a hot line costs one row per task), the
    hashes of lines against the common ones (a skewed hash is split by AQE) and the texts once by row key.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), text_of(text_col).alias("text"), hash128(F.col(id_col), F.col(text_col)).alias("row"))
    lines = (
        keyed.select("row", "id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("row", "id", "at", hash128(F.col("key")).alias("h"))
        .select("row", "id", "at", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    )
    common = lines.groupBy("a", "b").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs)
    common = stored(common.drop("n"), "common-lines")  # read back as a plain table, so that AQE can split a hot key in the join
    drops = (
        lines.join(common, ["a", "b"])
        .where(~F.col("id").eqNullSafe(F.col("keep")))
        .groupBy(F.col("row.a").alias("ra"), F.col("row.b").alias("rb"))
        .agg(F.sort_array(F.collect_set("at")).alias("drop"))
    )
    joined = keyed.select("doc", "text", F.col("row.a").alias("ra"), F.col("row.b").alias("rb")).join(drops, ["ra", "rb"], "left").withColumn("lines", F.split("text", "\n"))
    n_lines = F.size("lines")
    # the kept lines are the gaps between dropped positions: linear in the number of lines
    starts = F.concat(F.array(F.lit(-1)), F.col("drop"))
    ends = F.concat(F.col("drop"), F.array(n_lines))
    gaps = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda g: F.slice(F.col("lines"), g["s"] + 2, g["e"] - g["s"] - 1)))
    made = {
        text_col: F.when(F.col("drop").isNull(), F.col(f"doc.`{text_col}`")).otherwise(F.array_join(gaps, "\n")),
        "n_lines": n_lines.cast("long"),
        "n_dropped": F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long"),
    }
    return joined.select(*[made.pop(c).alias(c) if c in made else F.col(f"doc.`{c}`").alias(c) for c in docs.columns], *[v.alias(k) for k, v in made.items()])
