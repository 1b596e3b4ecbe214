"""Quality rules: counts per document, and a hashed n-gram likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, stored, text_of, words_of

#: Runs of letters, digits and underscores, or runs of other visible characters.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
WINDOW = 5
#: Weight of the raw corpus in the trusted multinomial, in n-grams.
PRIOR = 1000
#: Most trusted ids, each of up to some tens of bytes, that every task gets; more are joined.
MARKS = 1 << 20


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window of ``window`` words that occurs twice or more, first occurrences included.

    Windows are compared by a 64-bit hash within one text. Texts without a repeat stop at the distinct count; in the
    others windows are sorted, so the work is n log n for any text.
    """

    def positions(order: Column) -> Column:
        hashes = F.transform(order, lambda x: x["h"])
        n = F.size(order)

        def marked(hs: Column) -> Column:
            same = F.zip_with(F.slice(hs, 1, n - 1), F.slice(hs, 2, n - 1), lambda x, y: x == y)
            return let(same, lambda eq: F.zip_with(F.concat(F.array(F.lit(False)), eq), F.concat(eq, F.array(F.lit(False))), lambda x, y: x | y))

        flags = let(hashes, marked)
        return F.sort_array(F.transform(F.filter(F.zip_with(order, flags, lambda o, f: F.when(f, o["i"])), lambda i: i.isNotNull()), lambda i: i))

    def covered(at: Column) -> Column:
        n = F.size(at)
        steps = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda x, y: F.least(F.lit(window), y - x))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(window), lambda acc, s: acc + s))

    def of_hashes(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ordered, lambda o: let(positions(o), covered)))

    def windows(wh: Column) -> Column:
        n = F.size(wh)
        return F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(*[F.get(wh, i + (k - 1)) for k in range(window)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(hashed, lambda wh: let(windows(wh), of_hashes))).cast("long")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added (replacing columns
    of those names). Null and empty text: no words. Repeated rows are counted alike; a table without rows gives none."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    counted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("text"), words_of(text).alias("words"), lines.alias("lines"))
    made = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("words")),
    }
    out = counted.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in made], *[v.alias(k) for k, v in made.items()])
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def ngram_buckets(text: Column, buckets: int) -> Column:
    """Hash buckets of all unigrams and bigrams of a text's tokens."""

    def grams(tokens: Column) -> Column:
        n = F.size(tokens)
        ones = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
        twos = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(buckets)).cast("int"))
        return F.concat(ones, twos)

    return let(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), grams)


def fit_ratio(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """log of the trusted over the raw bucket probability, for each of ``buckets`` hash buckets.

    The multinomials count every n-gram of every document (raw, one added to each bucket) and of every trusted document,
    with PRIOR pseudo-counts dealt as the raw ones: without evidence the ratio is 1, so that a small trusted corpus rejects
    nothing by chance. One pass over the texts counts both. Up to MARKS trusted ids, which are counted first, go to every
    task, so texts stay where they are; beyond that documents and ids meet in a join that exchanges the texts. Only the
    bucket sums, at most ``buckets`` rows, reach the driver.
    """
    ids = stored(trusted_ids.select(F.col(trusted_ids.columns[0]).alias("trusted")).where("trusted is not null").distinct(), "trusted")
    marks = F.broadcast(ids) if ids.count() <= MARKS else ids
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(marks, F.col("id") == F.col("trusted"), "left")
    grams = rows.select(F.col("trusted").isNotNull().alias("good"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    counts = np.zeros((2, buckets))
    for r in grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("target")).collect():
        counts[:, r["bucket"]] = r["raw"], r["target"]
    raw = (counts[0] + 1) / (counts[0].sum() + buckets)
    target = (counts[1] + PRIOR * raw) / (counts[1].sum() + PRIOR)
    return np.log(target) - np.log(raw)


def llr_score(text: Column, ratio: np.ndarray) -> Column:
    """Mean log ratio per n-gram; 0 for a text without tokens."""
    weights = F.lit(np.asarray(ratio, dtype="float64"))
    total = let(ngram_buckets(text, len(ratio)), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(weights, b)) / F.size(g)))
    return total


def quality_rules(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 10_000,
    min_score: float = -0.4,
) -> DataFrame:
    """Counts, likelihood-ratio score and verdict for every document.

    ``trusted_ids``: one column of ids whose documents make the trusted target. A document is kept unless its base rules
    fail (fewer than 10 words, or over 20 % of its words in repeated 5-word windows) or its mean log ratio per n-gram is
    below ``min_score``. The verdict depends on the whole text and the whole corpus only; ties are kept.

    Returns docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr_score and kept
    (replacing columns of those names). Null and empty text have no words and fail. With no trusted documents every ratio
    is 1 and the method keeps all. Repeated rows are judged alike; an empty table gives an empty table.
    """
    ratio = fit_ratio(docs, trusted_ids, id_col, text_col, buckets)
    scored = base_counts(docs, text_col).withColumn("llr_score", llr_score(text_of(text_col), ratio))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr_score") >= min_score))
