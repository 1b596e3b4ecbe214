"""Benchmark decontamination: a BM25 index of test items with block maxima, searched with every passage of every text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .near_dedup import _lists

K1, B = 1.2, 0.75
#: Items in a block of a posting list.
BLOCK_ITEMS = 8
#: Least share of an item's own BM25 score that a passage must reach, and least share of its question and of its answer
#: that must stand in the passage in runs of GRAM words.
MIN_SCORE, MIN_OVERLAP, GRAM = 0.5, 0.7, 3
#: Bounds of one index; more items make more indexes, each searched with all passages.
INDEX_ITEMS, INDEX_WORDS = 20_000, 2_000_000
#: Words searched at a time in a task.
PART_WORDS = 1 << 17


def hashed_words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    return F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))


def last_part(text: Column) -> Column:
    """The answer of an item: its last sentence, if it has two or more; else its last third of words."""
    t = F.trim(text)
    sentence = F.regexp_extract(t, r"(?s)^.*[.!?]\s+(\S.*)$", 1)
    words = F.split(t, r"\s+")
    third = F.array_join(F.slice(words, F.size(words) - F.floor((F.size(words) - 1) / 3).cast("int"), F.size(words)), " ")
    return F.when(sentence != "", sentence).otherwise(third)


@dataclass
class Index:
    """Posting lists by term, as flat arrays: item, impact, and per block of items the largest impact."""

    ids: list
    words: list  # of each item
    answer_at: list  # where its answer starts
    terms: np.ndarray  # sorted hashes
    post_at: np.ndarray  # of each term, its first posting
    post_item: np.ndarray
    post_impact: np.ndarray
    block_at: np.ndarray  # of each term, its first block
    block_no: np.ndarray
    block_max: np.ndarray
    block_post: np.ndarray  # of each block of a term, its first posting
    term_max: np.ndarray
    longest: int

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK_ITEMS)


def build_index(items: list[tuple], n: int | None = None, mean: float | None = None, longest: int | None = None) -> Index | None:
    """Index of (id, word hashes, words of the answer[, items that hold each word]). Impacts are shares of an item's score
    for itself. n, mean, longest: number, mean and largest length of all items, of which these may be a part."""
    items = [x for x in items if len(x[1])]
    if not items:
        return None
    sizes = np.array([len(x[1]) for x in items])
    n, mean, longest = n or len(items), mean or sizes.mean(), longest or int(sizes.max())
    flat, of = np.concatenate([x[1] for x in items]), np.repeat(np.arange(len(items)), sizes)
    terms, at, term = np.unique(flat, return_index=True, return_inverse=True)
    pair, tf = np.unique(term.astype(np.int64) * len(items) + of, return_counts=True)
    t, item = pair // len(items), pair % len(items)
    here = np.bincount(t, minlength=len(terms))
    df = np.concatenate([x[3] for x in items])[at] if len(items[0]) > 3 else here
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / mean))
    impact /= np.maximum(np.bincount(item, impact, len(items)), 1e-12)[item]
    post_at = np.r_[0, np.cumsum(here)]
    new = np.r_[True, (t[1:] != t[:-1]) | (item[1:] // BLOCK_ITEMS != item[:-1] // BLOCK_ITEMS)]
    first = np.flatnonzero(new)
    block_max = np.maximum.reduceat(impact, first)
    block_at = np.searchsorted(first, post_at)
    return Index(
        [x[0] for x in items], [np.asarray(x[1]) for x in items], [len(x[1]) - x[2] for x in items], terms, post_at, item, impact,
        block_at, item[first] // BLOCK_ITEMS, block_max, np.r_[first, len(item)], np.maximum.reduceat(impact, post_at[:-1]), longest,
    )


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and positions of all of starts[i]..ends[i]-1."""
    n = ends - starts
    rows = np.repeat(np.arange(len(n)), n)
    return rows, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)


def search(index: Index, passage: np.ndarray, term: np.ndarray, n: int, least: float = MIN_SCORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all scores of ``least`` or more; input: distinct (passage, term) of n passages.

    Block maxima for many passages at a time, without WAND's moving pivot: as all items above a fixed threshold are wanted,
    terms are parted once per passage, by their largest impacts. Those whose sum stays below ``least`` can't lift an item
    alone; blocks of the lists after them are candidates. Each is bounded by the block maxima of all terms of the passage,
    only those that reach ``least`` are scored, and all others are skipped unread. This scores a superset of the blocks that
    a pivot would stop at (one that skips by the current positions of the lists can pass over more), and finds the same
    items: whatever is left out stays below the threshold.
    """
    top = index.term_max[term]
    order = np.lexsort((top, passage))
    passage, term, top = passage[order], term[order], top[order]
    run = np.cumsum(top)
    first = np.r_[True, passage[1:] != passage[:-1]] if len(passage) else np.empty(0, bool)
    before = np.repeat((run - top)[first], np.diff(np.r_[np.flatnonzero(first), len(passage)]))
    essential = run - before >= least - 1e-9
    row, at = _spread(index.block_at[term[essential]], index.block_at[term[essential] + 1])
    key = np.unique(passage[essential][row] * index.blocks + index.block_no[at])
    # shallow: bounds of those blocks from the blocks of all terms of the passage
    wanted = np.isin(passage, key // index.blocks)
    p, t = passage[wanted], term[wanted]
    row, at = _spread(index.block_at[t], index.block_at[t + 1])
    own = p[row] * index.blocks + index.block_no[at]
    slot = np.searchsorted(key, own)
    hit = (slot < len(key)) & (key[np.minimum(slot, max(len(key) - 1, 0))] == own) if len(key) else np.zeros(len(own), bool)
    bound = np.bincount(slot[hit], index.block_max[at[hit]], len(key))
    good = bound >= least - 1e-9
    # deep: score the items of blocks that can reach it
    use = hit.copy()
    use[hit] = good[slot[hit]]
    row2, post = _spread(index.block_post[at[use]], index.block_post[at[use] + 1])
    pair, where = np.unique(p[row[use]][row2] * len(index.ids) + index.post_item[post], return_inverse=True)
    score = np.bincount(where, index.post_impact[post], len(pair))
    keep = score >= least - 1e-9
    return pair[keep] // len(index.ids), pair[keep] % len(index.ids), score[keep]


def grams(w: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + len(h)].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the words of a part that stand in the passage in runs of GRAM words (of all its words if fewer)."""
    k = min(GRAM, len(part))
    if not k:
        return 1.0
    covered = np.zeros(len(part), bool)
    for i in np.flatnonzero(np.isin(grams(part, k), grams(passage, k))):
        covered[i : i + k] = True
    return float(covered.mean())


def leaks(index: Index, words: np.ndarray, at: np.ndarray) -> list[tuple]:
    """(row, item id, score, question overlap, answer overlap) of a batch of texts: values and offsets of word hashes.

    Works through parts of about PART_WORDS words: short texts together, longer ones in parts that overlap by a passage.
    """
    width = max(128, 2 * index.longest)
    size = max(PART_WORDS, 4 * width)
    best: dict = {}
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        if rows:
            ends = np.r_[0, np.cumsum([len(p) for p in parts])]
            for r, item, *found in _leaks(index, np.concatenate(parts), ends, width):
                key = rows[r], item
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), tuple(found))

    for row in range(len(at) - 1):
        lo, end = int(at[row]), int(at[row + 1])
        while True:
            hi = min(lo + size, end)
            rows.append(row)
            parts.append(words[lo:hi])
            held += hi - lo
            if held >= size:
                flush()
                rows.clear()
                parts.clear()
                held = 0
            if hi == end:
                break
            lo = hi - width
    flush()
    return [(r, index.ids[i], *v) for (r, i), v in sorted(best.items())]


def _leaks(index: Index, words: np.ndarray, at: np.ndarray, width: int) -> list[tuple]:
    step = width // 2
    sizes = np.diff(at)
    found = np.searchsorted(index.terms, words)
    found[found == len(index.terms)] = 0
    known = np.flatnonzero(index.terms[found] == words)
    row = np.searchsorted(at, known, side="right") - 1
    spot = (known - at[row]) // step
    per_row = np.maximum(1, -(-(sizes - step) // step))
    base = np.r_[0, np.cumsum(per_row)]
    # passage s covers words s * step up to s * step + width, so a word lies in two, or at the ends in one
    p = np.concatenate([base[row] + np.minimum(spot, per_row[row] - 1), (base[row] + spot - 1)[spot > 0]])
    t = np.concatenate([found[known], found[known][spot > 0]])
    key = np.unique(p * len(index.terms) + t)
    best: dict = {}
    for q, item, score in zip(*search(index, key // len(index.terms), key % len(index.terms), int(base[-1])), strict=True):
        r = int(np.searchsorted(base, q, side="right") - 1)
        lo = int(at[r] + (q - base[r]) * step)
        passage, own, cut = words[lo : min(lo + width, at[r + 1])], index.words[item], index.answer_at[item]
        asked, answered = overlap(own[:cut], passage), overlap(own[cut:], passage)
        if asked >= MIN_OVERLAP and answered >= MIN_OVERLAP:
            best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (float(score), asked, answered))
    return [(r, int(i), *v) for (r, i), v in best.items()]


def indexes(items: DataFrame, id_col: str, text_col: str):
    """Index after index over all items: bounded numbers of items and words each, with the statistics of all items."""
    hashed = items.select(F.col(id_col).alias("id"), F.filter(hashed_words(text_of(text_col)), lambda h: h != F.xxhash64(F.lit(""))).alias("w"), F.size(F.filter(F.split(F.lower(last_part(text_of(text_col))), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("a"))
    hashed = stored(hashed.where(F.size("w") > 0), "items")
    n, words, longest = hashed.agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0)), F.max(F.size("w"))).first()
    parts = max(1, -(-n // INDEX_ITEMS), -(-words // INDEX_WORDS))
    numbered = stored(hashed.withColumn("row", F.monotonically_increasing_id()), "items")
    held = numbered.select(F.explode(F.array_distinct("w")).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    frequent = numbered.select("row", F.posexplode("w").alias("at", "h")).join(held, "h").groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "df"))), lambda x: x["df"]).alias("df"))
    numbered = stored(numbered.join(frequent, "row").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))), "items")
    for k in range(parts):
        rows = numbered.where(F.col("part") == k).orderBy("id", "row").collect()
        if index := build_index([(r["id"], np.array(r["w"], np.int64), min(r["a"], len(r["w"])), np.array(r["df"])) for r in rows], n, words / max(n, 1), longest):
            yield index


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, score, question_overlap, answer_overlap) of every leaked item of every text.

    Texts are cut into passages of twice the longest item that overlap by half, so that every item-long run lies in one.
    A passage retrieves all items of which it reaches MIN_SCORE of their own score; of these, those stay of whose
    question and answer MIN_OVERLAP of the words stand in it. The best passage of a row is reported.

    One narrow map per index of at most INDEX_ITEMS items; texts are never shuffled. Null and empty texts and items
    match nothing; repeated rows give repeated results; items with equal texts are all reported. Without documents or
    items there are no rows. Items beyond INDEX_ITEMS are dealt over several indexes by row, with one set of statistics.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(F.col(id_col).alias("id"), hashed_words(text_of(text_col)).alias("w"))
    kinds = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items, item_col, item_text):
        shared = broadcast(index)

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                hits = leaks(shared.value, *_lists(batch.column(1)))
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                item_ids = pa.array([h[1] for h in hits], pa.int64() if kinds[1] == "bigint" else None)
                yield pa.RecordBatch.from_arrays([ids, item_ids, *(pa.array([h[i] for h in hits], pa.float64()) for i in (2, 3, 4))], names=[id_col, item_col, "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(texts.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a leaked item: a narrow map, whatever the ids and the names of other columns. Null
    and empty texts stay, as does everything if there are no items; repeated rows go or stay together."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    for index in indexes(items, item_col, item_text):
        shared = broadcast(index)

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                bad = {h[0] for h in leaks(shared.value, *_lists(batch.column(batch.num_columns - 1)))}
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        name = "w" + "_" * max(map(len, docs.columns))  # longer than any other, so that it can't clash
        docs = docs.select("*", hashed_words(text_of(text_col)).alias(name)).mapInArrow(run, docs.schema)
    return docs
