"""Near-duplicate classes by Order MinHash over word shingles, verified by banded alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of, words_of
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Minima kept per sketch, sketches per text, and sketches that a pair must share outside its first bucket. Texts that
#: share 0.8 of their shingles agree in a sketch with probability 0.8^4 = 0.41: under 3 of 32 in about 1 of 80,000 pairs.
MINIMA, SKETCHES, SHARED = 4, 32, 3
#: Members and words of a block of a bucket; blocks of a bucket meet pairwise. Words of buckets that a group handles at once.
BLOCK, WORDS = 1024, 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of k words, in text order."""
    w = words.view(np.uint64) if words.dtype != np.uint64 else words
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * MIX
        h ^= h >> np.uint64(29)
    return h


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number mixed in, so that repeats differ."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.r_[True, s[1:] != s[:-1]]
    if first.all():
        return h
    starts = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    out = np.empty_like(h)
    out[order] = s + (np.arange(len(s)) - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, m, dtype=np.uint64)


def order_minhash(h: np.ndarray, minima: int = MINIMA, sketches: int = SKETCHES) -> np.ndarray:
    """Per sketch: the hash of the ``minima`` smallest labelled shingles, kept in text order."""
    a, b = seeds(sketches)
    n = len(h)
    out = np.empty(sketches, np.uint64)
    step = max(1, (1 << 21) // n)
    for lo in range(0, sketches, step):
        v = (h[None, :] ^ b[lo : lo + step, None]) * a[lo : lo + step, None]
        v ^= v >> np.uint64(32)
        v *= MIX
        at = np.argpartition(v, minima - 1, axis=1)[:, :minima] if n > minima else np.broadcast_to(np.arange(n), (len(v), n)).copy()
        at.sort(axis=1)
        key = np.full(len(v), 7, np.uint64)
        for i in range(at.shape[1]):
            key = (key ^ h[at[:, i]]) * MIX
            key ^= key >> np.uint64(31)
        out[lo : lo + step] = key + np.arange(lo, lo + len(v)).astype(np.uint64)
    return out


def aligned(x: np.ndarray, y: np.ndarray, most: int) -> int | None:
    """Length of the longest common subsequence if at most ``most`` elements stay outside it, else None.

    Furthest-reaching points on the band of diagonals from -most to most, all of a distance at once.
    """
    n = min(len(x), len(y))
    if n:
        diff = x[:n] != y[:n]
        head = int(diff.argmax()) if diff.any() else n
        x, y, n = x[head:], y[head:], n - head
    else:
        head = 0
    tail = 0
    if n:
        diff = x[::-1][:n] != y[::-1][:n]
        tail = int(diff.argmax()) if diff.any() else n
        x, y = x[: len(x) - tail], y[: len(y) - tail]
    nx, ny = len(x), len(y)
    if not nx or not ny:
        return head + tail if nx + ny <= most else None
    width = 16
    px = np.concatenate([x, np.zeros(width + most + 1, np.uint64)])
    py = np.concatenate([y, np.zeros(width + most + 1, np.uint64)])
    reach = np.full(2 * most + 3, -1, np.int64)  # x position by diagonal x - y
    mid, r = most + 1, np.arange(width)
    for d in range(most + 1):
        k = np.arange(-d, d + 1, 2)
        k = k[(k <= nx) & (k >= -ny)]
        at = np.maximum(reach[mid + k - 1] + 1, reach[mid + k + 1]) if d else np.zeros(1, np.int64)
        at = np.minimum(at, np.minimum(nx, ny + k))
        live = np.flatnonzero((at >= 0) & (at - k >= 0))
        while len(live):
            u, v = at[live], at[live] - k[live]
            same = (px[u[:, None] + r] == py[v[:, None] + r]) & (u[:, None] + r < nx) & (v[:, None] + r < ny)
            run = np.where(same.all(axis=1), width, same.argmin(axis=1))
            at[live] += run
            live = live[run == width]
        reach[mid + k] = at
        if ((at >= nx) & (at - k >= ny)).any():
            return head + tail + (nx + ny - d) // 2
    return None


def similarity(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of two texts; 0 if below ``least``.

    An alignment of A shingles scores A / (x + y - A), the order-keeping form of the Jaccard index; it reaches ``least``
    only with at most (x + y)(1 - least) / (1 + least) shingles outside, which bounds the band.
    """
    nx, ny = len(x), len(y)
    if not nx or not ny or min(nx, ny) < least * max(nx, ny):
        return 0.0
    both = len(np.intersect1d(labelled(x), labelled(y), assume_unique=True))
    if both < least * (nx + ny - both):
        return 0.0
    found = aligned(x, y, int((nx + ny) * (1 - least) / (1 + least) + 1e-9))
    score = found / (nx + ny - found) if found is not None else 0.0
    return score if score >= least - 1e-12 else 0.0


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def _lists(column):
    """Values and offsets of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ka, kb, n, sketch): a 128-bit key of the word sequence, the number of words and the sketches of each text."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), word_hashes(text_of(text_col)).alias("w"))
    rows = rows.select("id", F.xxhash64("w").alias("ka"), F.xxhash64(F.lit(77), "w").alias("kb"), "w")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values, at = _lists(batch.column(3))
            sizes = np.diff(at)
            out = [order_minhash(labelled(shingles(values[at[i] : at[i + 1]]))).view(np.int64) if sizes[i] >= SHINGLE else [] for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["id", "ka", "kb", "n", "sketch"])

    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, ka long, kb long, n long, sketch array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (id, w) are similar."""
    left = texts.select(F.col("id").alias("a"), F.col("w").alias("wa"))
    right = texts.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            (u, p), (v, q) = _lists(batch.column(2)), _lists(batch.column(3))
            keep = [similarity(shingles(u[p[i] : p[i + 1]]), shingles(v[q[i] : q[i + 1]])) > 0 for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


class _Block:
    """Texts of one bucket: which pairs are of different components, share enough sketches and are similar."""

    def __init__(self, sketches: np.ndarray, texts: list[np.ndarray], roots: np.ndarray):
        self.sketches, self.texts, self.roots = sketches, texts, roots.copy()
        self.index = None

    def _fit(self, i: int, others: np.ndarray, sk: int) -> np.ndarray:
        others = others[self.roots[others] != self.roots[i]]
        same = self.sketches[others] == self.sketches[i]
        return others[(same.sum(axis=1) >= SHARED) & (self.sketches[i][same.argmax(axis=1)] == sk)]

    def _score(self, i: int, others: np.ndarray) -> np.ndarray:
        """Jaccard index of labelled shingles of text i and others, from the places where its shingles stand."""
        if self.index is None:
            marks = [labelled(t) for t in self.texts]
            sizes = np.array([len(m) for m in marks])
            _, v = np.unique(np.concatenate(marks), return_inverse=True)
            order = np.argsort(v, kind="stable")
            self.index = np.split(v, np.cumsum(sizes)[:-1]), np.repeat(np.arange(len(marks)), sizes)[order], np.r_[0, np.cumsum(np.bincount(v))], sizes
        own, owner, at, sizes = self.index
        both = np.bincount(np.concatenate([owner[at[k] : at[k + 1]] for k in own[i]]), minlength=len(sizes))[others]
        return both / (sizes[i] + sizes[others] - both)

    def links(self, sk: int, lefts: np.ndarray, rights: np.ndarray):
        """Pairs (i, j) that link components, closest first for each i; linked components count as one from then on."""
        for i in lefts.tolist():
            others = self._fit(i, rights[rights > i] if lefts is rights else rights, sk)
            if not len(others):
                continue
            score = self._score(i, others)
            fit = np.flatnonzero(score >= SIMILARITY - 1e-12)
            for j in others[fit[np.argsort(-score[fit], kind="stable")]].tolist():
                if self.roots[j] != self.roots[i] and similarity(self.texts[i], self.texts[j]) > 0:
                    self.roots[self.roots == self.roots[j]] = self.roots[i]
                    yield i, j


def _mixed_links(located: DataFrame, buckets: DataFrame, sketches: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """Links (a, b) between components inside buckets: of all pairs of one bucket (sk) and different components (root)
    that share SHARED sketches, each looked at in its first common bucket, as many as connect what they connect.

    Members of a bucket are dealt by id into blocks of about BLOCK texts and WORDS words; blocks meet pairwise, so no task
    holds a whole bucket. Buckets of one block are handled many at a time.
    """
    blocks = F.expr(f"cast(greatest((n - 1) div {BLOCK}, words div {WORDS}) + 1 as int)")
    rows = located.select("sk", "id", "root").join(buckets.select("sk", blocks.alias("blocks")), "sk")
    total = buckets.agg(F.coalesce(F.sum(F.when(blocks == 1, F.col("words"))), F.lit(0))).first()[0]
    alone = F.pmod(F.xxhash64("sk"), F.lit(total // WORDS + 1))
    rows = rows.select("sk", "id", "root", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("id", "sk", "root", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("blocks") == 1)
    rows = rows.toDF("id", "sk", "root", "block", "x", "y", "single").withColumn("g", F.when(F.col("single"), alone).otherwise(F.xxhash64("sk", "x", "y"))).drop("single")
    rows = rows.join(sketches.select("id", "sketch"), "id").join(texts, "id")
    parts = 2 * int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(group):
        import pyarrow as pa

        column = lambda name: group.column(name).combine_chunks()
        sk, x, y, block = (column(c).to_numpy(zero_copy_only=False) for c in ("sk", "x", "y", "block"))
        s = column("sketch").flatten().to_numpy().reshape(-1, SKETCHES)
        roots = column("root").dictionary_encode().indices.to_numpy()
        words, at = _lists(column("w"))
        order = np.lexsort((block, y, x, sk))
        ends = np.flatnonzero(np.r_[(sk[order][1:] != sk[order][:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]), True]) + 1
        out = []
        for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            own = order[lo:hi]
            if (roots[own] == roots[own[0]]).all():
                continue
            texts = [shingles(words[at[i] : at[i + 1]]) for i in own]
            left = np.flatnonzero(block[own] == x[own[0]])
            right = left if x[own[0]] == y[own[0]] else np.flatnonzero(block[own] == y[own[0]])
            out += [(own[i], own[j]) for i, j in _Block(s[own], texts, roots[own]).links(sk[own[0]], left, right)]
        i, j = (pa.array([p[c] for p in out], pa.int64()) for c in (0, 1))
        return pa.table({"a": column("id").take(i), "b": column("id").take(j)})

    found = rows.repartition(parts, "g").groupBy("g").applyInArrow(run, f"a {kind}, b {kind}")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id): every document with the smallest id of its near-duplicate class.

    Two texts are linked if an alignment of their shingles of five lower-cased words scores 0.8 or more; a class is a
    component of links and of equal word sequences. Equal sequences are first folded to their smallest id. The others
    get SKETCHES order min-hash sketches; each text is verified against the center of its best bucket. In buckets
    that still hold several components, whatever their size, all pairs across components that share SHARED sketches are
    candidates: block by block they are compared by the Jaccard index of their shingles, which no alignment exceeds, then
    by alignment, until their components are linked.
    So large groups of copies cost a link per text, pairs are never written out, and no candidate is dropped.

    Ids may repeat: rows of one id belong to one class if any of their texts do. A null id gets a null class. A text
    without words is in a class of its own; a text under five words is linked to equal ones only. Tables without rows
    give none; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    all_rows = stored(sketched(docs, id_col, text_col), "sketches")
    worded = all_rows.where("n > 0")
    folded = stored(worded.groupBy("ka", "kb").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("n").alias("words")), "folded")
    sketches = folded.where(F.size("sketch") > 0).select("id", "words", "sketch")
    members = sketches.select("id", "words", F.explode("sketch").alias("sk"))
    buckets = stored(members.groupBy("sk").agg(F.count("*").alias("n"), F.sum("words").alias("words")).where("n > 1"), "buckets")
    shared = stored(members.drop("words").join(buckets, "sk").select("sk", "id", "n"), "shared")
    # the text that others are copies of meets most texts in its buckets; it becomes the center of each of them
    hubs = stored(shared.groupBy("id").agg(F.sum("n").alias("hub")), "hubs")
    ranked = shared.join(hubs, "id")
    centers = ranked.groupBy("sk").agg(F.max("hub").alias("top"), F.min_by("id", F.struct(-F.col("hub"), F.col("id"))).alias("center"))
    shared = stored(shared.join(stored(centers, "centers"), "sk"), "shared")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    texts = source.join(hubs.select("id"), "id").select("id", word_hashes(text_of("__text")).alias("w"))
    # the same id may stand on several rows: the text that was folded to it is meant
    keys = folded.select(F.col("id").alias("__id"), "ka", "kb")
    texts = texts.withColumn("ka", F.xxhash64("w")).withColumn("kb", F.xxhash64(F.lit(77), "w"))
    texts = stored(texts.dropDuplicates(["id", "ka", "kb"]).join(keys, (F.col("id") == F.col("__id")) & (texts["ka"] == keys["ka"]) & (texts["kb"] == keys["kb"])).select("id", "w"), "texts")
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))

    best = shared.where("id != center").groupBy("id").agg(F.min_by("center", F.struct(-F.col("top"), F.col("center"))).alias("center"))
    first = stored(best.select(*pair("id", "center")).distinct(), "first")
    links = stored(verified(first, texts), "links")
    roots = stored(components(links).withColumnRenamed("node", "id"), "roots-1")
    located = shared.join(roots, "id", "left").select("sk", "id", F.coalesce("root", "id").alias("root"))
    mixed = stored(located.groupBy("sk").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("sk"), "mixed")
    located = stored(located.join(mixed, "sk"), "located")
    links = links.unionByName(stored(_mixed_links(located, buckets.join(mixed, "sk"), sketches, texts, kind), "late-links"))
    final = stored(components(links), "roots")
    classes = folded.select("ka", "kb", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("ka", "kb", F.coalesce("root", "id").alias("root"))
    out = worded.select("id", "ka", "kb").join(stored(classes, "classes"), ["ka", "kb"]).groupBy("id").agg(F.min("root").alias("root"))
    ids = docs.select(F.col(id_col).alias("__id"))
    return ids.join(stored(out, "classes-by-id"), F.col("__id") == F.col("id"), "left").select(F.col("__id").alias(id_col), F.coalesce("root", "__id").alias("class_id"))
