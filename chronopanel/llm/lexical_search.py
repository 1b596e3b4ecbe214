"""Ranked lexical search: a stated set of queries against all documents by dense blocked products of exact integers."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, stored, text_of

#: A term: a maximal run of ASCII letters, digits and anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on UTF-8 bytes: A-Z lowered, every other ASCII byte that no term holds made a blank.
BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b) in LOWER + "0123456789" else 0x20 for b in range(256))
#: Documents, queries and terms of one dense product.
DOC_TILE, ITEM_TILE, TERM_TILE = 512, 64, 2048
#: Bounds of the queries that one pass over the documents takes: rows, and (query, term) pairs.
PASS_ITEMS, PASS_PAIRS = 20_000, 2_000_000
#: Bytes of a text that are cut into terms at a time.
CHUNK = 1 << 20
#: An impact is below this, so a tile's sum of products is below this times its sum of weights.
IMPACT = 1_000_000
EXACT = 1 << 53


def term_counts(text: str | None) -> Counter:
    """Occurrences of the terms of a whole text, as UTF-8 bytes; long texts are cut at blanks, CHUNK bytes at a time."""
    data = (text or "").encode().translate(BYTES)
    if len(data) <= CHUNK:
        return Counter(data.split())
    out: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


@dataclass
class Queries:
    """The queries of one pass: their terms by number, and of each term its weight once the documents are counted."""

    rows: list  # number of each query
    ids: list
    terms: dict  # term: number
    at: np.ndarray  # of each query, where its term numbers start
    term: np.ndarray
    weight: np.ndarray | None = None
    documents: int = 0
    length: int = 0

    def tiles(self):
        """(first query, end, term tiles): each term tile lists the distinct terms of these queries that are in it, so
        few that no sum of products can reach 2**53."""
        for lo in range(0, len(self.ids), ITEM_TILE):
            hi = min(lo + ITEM_TILE, len(self.ids))
            own, parts, first, total = np.unique(self.term[self.at[lo] : self.at[hi]]), [], 0, 0
            for i, w in enumerate(self.weight[own].tolist()):
                if i - first == TERM_TILE or (total + w) * IMPACT >= EXACT:
                    parts.append(own[first:i])
                    first, total = i, 0
                total += w
            yield lo, hi, [*parts, own[first:]]


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def tile_scores(q: Queries, lo: int, hi: int, parts: list, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
    """Exact scores (query, document) of one tile of queries and n documents, whose impacts are given by (doc, term).

    Each term tile is packed into two dense float64 matrices, weights by query and impacts by document. All products and
    sums are integers below 2**53, so BLAS is exact in any order; tiles are added as 64-bit integers.
    """
    out = np.zeros((hi - lo, n), np.int64)
    owner = np.repeat(np.arange(hi - lo), np.diff(q.at[lo : hi + 1]))
    mine = q.term[q.at[lo] : q.at[hi]]
    for part in parts:
        slot = np.searchsorted(part, term)
        here = part[np.minimum(slot, len(part) - 1)] == term if len(part) else np.zeros(len(term), bool)
        if not here.any():
            continue
        used, column = np.unique(slot[here], return_inverse=True)  # terms that no document of the tile has are left out
        impacts = np.zeros((len(used), n))
        impacts[column, doc[here]] = impact[here]
        wanted = part[used]
        slot = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
        hit = wanted[slot] == mine
        weight = np.zeros((hi - lo, len(used)))
        weight[owner[hit], slot[hit]] = q.weight[mine[hit]]
        out += (weight @ impacts).astype(np.int64)
    return out


def search_tiles(q: Queries, rows, k: int):
    """(query, document id, score) of the k best documents of each query among rows (id, text): higher scores first, then
    smaller ids, null ids last. Memory: one tile of documents and k entries a query."""
    best: list[list] = [[] for _ in q.ids]
    tiles = list(q.tiles())

    def take(ids: list, counts: list) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        ids, counts = [ids[i] for i in order], [counts[i] for i in order]
        sizes = [len(c[0]) for c in counts]
        if not sum(sizes):
            return
        doc = np.repeat(np.arange(len(ids)), sizes)
        term, tf = (np.concatenate([c[i] for c in counts]) for i in (0, 1))
        m = np.repeat([c[2] for c in counts], sizes)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        for lo, hi, parts in tiles:
            score = tile_scores(q, lo, hi, parts, doc, term, impact, len(ids))
            least = np.array([-best[i][-1][0] if len(best[i]) == k else 1 for i in range(lo, hi)])
            for row in np.flatnonzero(score.max(axis=1) >= least):
                own = score[row]
                at = np.flatnonzero(own >= least[row])
                if len(at) > k:  # columns ascend by id, so a stable sort keeps the smallest ids of a tie
                    at = at[np.argsort(-own[at], kind="stable")[:k]]
                new = [(-int(own[c]), ids[c] is None, ids[c] if ids[c] is not None else 0) for c in at]
                best[lo + row] = sorted(best[lo + row] + new)[:k]

    ids, counts = [], []
    for i, text in rows:
        found = term_counts(text)
        n = found.total()
        ids.append(i)
        held = list(found.keys() & q.terms.keys())
        counts.append((np.array([q.terms[t] for t in held], np.int64), np.array([found[t] for t in held], np.int64), 10 + (90 * n * q.documents) // max(q.length, 1)))
        if len(ids) == DOC_TILE:
            take(ids, counts)
            ids, counts = [], []
    take(ids, counts)
    for i, found in enumerate(best):
        for score, null, d in found:
            yield i, None if null else d, -score


def query_blocks(items: DataFrame, id_col: str, text_col: str):
    """Queries, block after block, each of a bounded number of rows and pairs; only one block is on the driver at a time."""
    lowered = ascii_lower(text_of(text_col))
    terms = F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), 0))
    numbered = stored(items.select(F.col(id_col).alias("id"), terms.alias("terms")).withColumn("row", F.monotonically_increasing_id()).where(F.size("terms") > 0), "search-items")
    n, pairs = numbered.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-n // PASS_ITEMS), -(-pairs // PASS_PAIRS))
    for b in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()
        known = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        at = np.r_[0, np.cumsum([len(r["terms"]) for r in rows])].astype(np.int64)
        yield Queries([r["row"] for r in rows], [r["id"] for r in rows], {t.encode(): i for t, i in known.items()}, at, np.array([known[t] for r in rows for t in r["terms"]], np.int64))


def counted(docs: DataFrame, text_col: str, q: Queries) -> Queries:
    """q with the number of documents that have terms, the number of all their terms, and its terms' weights: sums that
    each task makes of its rows and Spark of the tasks; a row for each term of the queries reaches the driver."""
    held = docs.sparkSession.sparkContext.broadcast(q.terms)

    def run(batches):
        import pyarrow as pa

        known, df, n, length = held.value, Counter(), 0, 0
        for batch in batches:
            for text in batch.column(0):
                found = term_counts(text.as_py())
                df.update(found.keys() & known.keys())
                n += bool(found)
                length += found.total()
        rows = [(-1, n), (-2, length), *((known[t], c) for t, c in df.items())]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["term", "n"])

    sums = dict(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    documents = sums.get(-1, 0)
    return Queries(q.rows, q.ids, q.terms, q.at, q.term, weights(np.array([sums.get(t, 0) for t in range(len(q.terms))]), documents), documents, sums.get(-2, 0))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score) of the k best documents of every item, among those whose score is above 0.

    A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), N being the documents with terms; a document's impact of it is
    (10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L, n its terms and L those of all. The score sums w times impact
    over the distinct terms of the item. Equal scores rank by ascending id, null ids last.

    Each pass over the documents takes a bounded block of items, which is broadcast; texts are read where they lie and
    never shuffled. A task packs tiles of documents and of query terms densely, multiplies them, and keeps k documents a
    query; only these meet in a window by item, at most k rows for each task. A hot item or text makes no larger group.

    Null and empty texts have no terms: such a document is not counted and such an item has no rows. Repeated documents are
    ranked each; repeated items have each their own rows. Without documents or items there are no rows. Other columns,
    whatever their names, are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kinds = items.schema[item_col].dataType, docs.schema[id_col].dataType
    schema = f"row long, item {kinds[0].simpleString()}, doc {kinds[1].simpleString()}, score long"
    found = spark.createDataFrame([], schema)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for block in query_blocks(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(counted(docs, text_col, block))

        def run(batches, shared=shared):
            import pyarrow as pa

            q = shared.value
            rows = ((i.as_py(), t.as_py()) for b in batches for i, t in zip(b.column(0), b.column(1), strict=True))
            got = list(search_tiles(q, rows, k))
            columns = [[q.rows[g[0]] for g in got], [q.ids[g[0]] for g in got], [g[1] for g in got], [g[2] for g in got]]
            types = [pa.int64(), to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "item", "doc", "score"])

        found = found.unionByName(texts.mapInArrow(run, schema))
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


SQL = rf"""
with toks as (select r, doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as t from (select row_number() over () as r, doc_id, text from documents)),
counts as (select r, doc_id, t, count(*) as tf from toks group by all),
lengths as (select r, cast(sum(tf) as bigint) as n from counts group by r),
totals as (select count(*) as nn, cast(sum(n) as bigint) as ll from lengths),
asked as (select distinct ir, item_id, t from (select ir, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as t from (select row_number() over () as ir, item_id, text from benchmark))),
weights as (select t, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) as w from counts, totals group by t, nn),
impacts as (select c.r, c.doc_id, c.t, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll)) as v from counts c join lengths using (r), totals),
scores as (select ir, item_id, r, doc_id, cast(sum(w * v) as bigint) as score from asked join weights using (t) join impacts using (t) group by 1, 2, 3, 4 having sum(w * v) > 0)
select item_id, rank, doc_id, score from (select *, cast(row_number() over (partition by ir order by score desc, doc_id) as int) as rank from scores) where rank <= 10
"""
