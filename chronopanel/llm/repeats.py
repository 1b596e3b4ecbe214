"""Removal of byte strings that occur more than once in a corpus, with suffix arrays over candidate strings."""

from __future__ import annotations

import hashlib
import zlib
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored, text_of
from .grouping_sort import suffix_array

#: Bytes that make a repeat; bytes of an anchor; bytes of a block, which divides WIDTH.
WIDTH, ANCHOR, STEP = 400, 32, 40
#: Words that make a passage, and words of its anchor. Both anchors' lengths are powers of two.
PASSAGE, GRAM = 50, 8
#: Bytes handled at a time in a task (arrays stay in the cache), and symbols of one suffix array.
CHUNK, SYMBOLS = 1 << 18, 200_000
ROWS = 1000
#: Different strings of one anchor that a task may hold; anchors with more are cut into finer keys first.
GROUP = 20_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RUN = "ra long, rb long, lo int, h long, a int, n int, ca long, cb long"
KEY = ["h", "a", "n", "ca", "cb"]
IS_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])
#: Bits of the sieve that keeps texts at home which a join would drop; a row of it holds 32,768 of them (Spark's bitmaps).
SIEVE = 1 << 25


def anchors(units: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window of ``width`` units: the place of its anchor, the left-most smallest run of ``gram``; and
    the hashes of all grams. Equal windows have their anchor at the same place within them."""
    x = (units.astype(np.uint64) + np.uint64(1)) * M1
    span = 1
    while span < gram:
        x = (x[:-span] * M2) ^ (x[:-span] >> np.uint64(27)) ^ (x[span:] * M1)
        span *= 2
    x ^= x >> np.uint64(31)
    x *= M1
    low = np.uint64((1 << 24) - 1)
    y = (x & ~low) | np.arange(len(x), dtype=np.uint64)
    size, span = width - gram + 1, 1
    while span * 2 <= size:
        y = np.minimum(y[:-span], y[span:])
        span *= 2
    if size > span:
        y = np.minimum(y[: -(size - span)], y[size - span :])
    return (y & low).astype(np.int64), x


def runs(texts: list[bytes], width: int = WIDTH):
    """(text, lo, h, a, n, bytes) of runs of windows with one anchor: starts lo..lo+n-1, anchor at lo + a, its hash h."""
    part: list[tuple[int, int, bytes]] = []
    held = 0
    for i, t in enumerate(texts):
        for lo in range(0, max(len(t) - width + 1, 0), CHUNK):
            piece = t[lo : lo + CHUNK + width - 1]
            part.append((i, lo, piece))
            held += len(piece)
            if held >= CHUNK:
                yield from _runs(part, width)
                part, held = [], 0
    if part:
        yield from _runs(part, width)


def _split(at: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last + 1 start of the runs of windows with one anchor inside texts begins[j]..ends[j], and their text j."""
    change = np.r_[True, at[1:] != at[:-1]]
    valid = np.zeros(len(at) + 1, bool)
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        if e - b >= width:
            change[b] = True
            valid[b : e - width + 1] = True
    starts = np.flatnonzero(change & valid[:-1])
    owner = np.searchsorted(ends, starts, side="right")
    last = np.r_[starts[1:], 0]
    final = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) if len(starts) else []
    last[final] = ends[owner[final]] - width + 1
    return starts, last, owner


def _runs(part: list[tuple[int, int, bytes]], width: int):
    data = b"".join(p for _, _, p in part)
    at, x = anchors(np.frombuffer(data, np.uint8), ANCHOR, width)
    ends = np.cumsum([len(p) for _, _, p in part])
    begins = ends - np.array([len(p) for _, _, p in part])
    starts, last, owner = _split(at, begins, ends, width)
    h = x[at[starts]].view(np.int64)
    for s, e, o, a, k in zip(starts.tolist(), last.tolist(), owner.tolist(), (at[starts] - starts).tolist(), h.tolist(), strict=True):
        i, lo, _ = part[o]
        yield i, lo + s - int(begins[o]), k, a, e - s, data[s : e - 1 + width]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First places, places after the end, and 64-bit hashes of the words of a text: runs of anything but ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~IS_SPACE[raw]
    starts, ends = np.flatnonzero(inside & np.r_[True, ~inside[:-1]]), np.flatnonzero(inside & np.r_[~inside[1:], True]) + 1
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    lead = np.r_[0, starts] if starts[0] else starts
    place = np.arange(len(raw)) - np.repeat(lead, np.diff(np.r_[lead, len(raw)]))
    v = (raw.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)) * M1
    v ^= v >> np.uint64(29)
    v *= M2
    v[~inside] = 0
    v = np.add.reduceat(v, starts)
    return starts, ends, v ^ (v >> np.uint64(31))


def left_runs(texts: list[bytes], covers: list[list[list[int]]]) -> tuple[np.ndarray, ...]:
    """Text number, first window, anchor hash and number of windows of runs of PASSAGE-word windows with one anchor, of
    words that touch no byte of the covers [from, to). Windows are numbered by their first word in the text."""
    found, lo, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK or i == len(texts) - 1:
            found.append(_left_runs(texts[lo : i + 1], covers[lo : i + 1], lo))
            lo, held = i + 1, 0
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _left_runs(texts, covers, number: int) -> tuple[np.ndarray, ...]:
    starts, ends, hashes = word_hashes(b" ".join(texts))
    at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    first = np.searchsorted(starts, at)
    parts = []  # text, first word, last word + 1
    for i, cover in enumerate(covers):
        w, e = int(first[i]), int(first[i + 1])
        for u, v in cover:
            parts.append((i, w, int(np.searchsorted(ends, at[i] + u, "right"))))
            w = max(w, int(np.searchsorted(starts, at[i] + v)))
        parts.append((i, w, e))
    parts = np.array([p for p in parts if p[2] - p[1] >= PASSAGE], np.int64).reshape(-1, 3)
    if not len(parts):
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32))
    where, x = anchors(hashes, GRAM, PASSAGE)
    s, last, owner = _split(where, parts[:, 1], parts[:, 2], PASSAGE)
    text = parts[owner, 0]
    return text + number, (s - first[text]).astype(np.int32), x[where[s]].view(np.int64), (last - s).astype(np.int32)


def digest(data: bytes) -> tuple[int, int]:
    import xxhash

    v = xxhash.xxh3_128_digest(data)
    return int.from_bytes(v[:8], "little", signed=True), int.from_bytes(v[8:], "little", signed=True)


def repeated_starts(items: list[tuple[int, int, int, bytes]], width: int = WIDTH, step: int = STEP) -> list[list[tuple[int, int]]]:
    """Per item (h, a, n, bytes): runs of its starts 0..n-1 whose window is also a window of another item of that h.

    Items of one h are aligned at their anchor and cut into blocks of ``step`` bytes from there; a symbol is a block's
    content, place and h. A suffix array over the symbol strings brings equal block sequences together. A window is some
    bytes, width/step blocks (one fewer if it starts inside a block) and the rest: windows are equal if their sequences
    lie in one stretch of the array that shares so many symbols, and if the bytes before and after are equal.
    """
    full = width // step
    key, item_of, offset = [], [], []
    for i, (h, a, _, data) in enumerate(items):
        first = a % step
        raw = np.frombuffer(data, np.uint8)
        blocks = (len(raw) - first) // step
        body = np.ascontiguousarray(raw[first : first + blocks * step]).reshape(blocks, step // 8, 8).view(np.uint64)[:, :, 0]
        v = np.full(blocks, np.uint64(h & 0xFFFFFFFFFFFFFFFF), np.uint64) * M1 + (np.arange(blocks) - a // step).astype(np.uint64) * M2
        for c in range(step // 8):
            v = (v ^ body[:, c]) * M1
            v ^= v >> np.uint64(29)
        key.append(v)
        item_of.append(np.full(blocks + 1, i))
        offset.append(first + step * np.arange(blocks + 1))
    _, rank = np.unique(np.concatenate(key), return_inverse=True)
    text, at = [], 0
    for i, v in enumerate(key):
        text += [rank[at : at + len(v)] + len(items) + 1, [len(items) - i]]
        at += len(v)
    text = np.concatenate([*text, [0]])
    item_of, offset = np.concatenate(item_of), np.concatenate(offset)
    sa = suffix_array(text)[1:]
    spread = np.concatenate([text, np.zeros(full, text.dtype)])
    shared = {}
    for m in (full, full - 1):
        same = np.ones(len(sa) - 1, bool)
        for j in range(m):
            same &= spread[sa[1:] + j] == spread[sa[:-1] + j]
        stretch = np.cumsum(np.r_[True, ~same])
        alone = np.bincount(stretch)[stretch] == 1
        shared[m] = np.where(alone, -1, stretch)
        shared[m][sa] = shared[m].copy()
    marks = [[] for _ in items]
    # every window as (stretch, distance to its first whole block, bytes outside whole blocks)
    data = np.frombuffer(b"".join(d for _, _, _, d in items), np.uint8)
    base = np.cumsum([0, *(len(d) for _, _, _, d in items)])
    n_of = np.array([n for _, _, n, _ in items])
    rows = []
    for tail in range(step):
        m = full if tail == 0 else full - 1
        start = offset - tail
        ok = (start >= 0) & (start < n_of[item_of]) & (shared[m] >= 0)[: len(offset)]
        z = np.flatnonzero(ok)
        if not len(z):
            continue
        v = shared[m][z].astype(np.uint64) * M1 + np.uint64(tail * int(M2) & 0xFFFFFFFFFFFFFFFF)
        if tail:
            where = base[item_of[z]] + offset[z]
            for c in [*range(-tail, 0), *range(m * step, m * step + step - tail)]:
                v = (v ^ data[where + c]) * M1
                v ^= v >> np.uint64(29)
        rows.append(np.stack([v.view(np.int64), item_of[z], start[z]]))
    if rows:
        v, i, s = np.concatenate(rows, axis=1)
        _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        i, s = i[twice], s[twice]
        order = np.lexsort((s, i))
        i, s = i[order], s[order]
        if len(i):
            new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (s[1:] != s[:-1] + 1)])
            for b, e in zip(new, np.r_[new[1:], len(i)], strict=True):
                marks[i[b]].append((int(s[b]), int(s[e - 1])))
    return marks


def _resolved(contexts: DataFrame, width: int) -> DataFrame:
    """(h, a, n, ca, cb, spans): repeated starts of each context (h, a, n, ca, cb, data); whole groups of h meet in a task."""
    dealt = contexts.repartition("h").sortWithinPartitions("h")

    def run(batches):
        import pyarrow as pa

        def out(rows, items):
            spans = repeated_starts(items, width)
            keep = [(r, s) for r, s in zip(rows, spans, strict=True) if s]
            cols = [pa.array([r[c] for r, _ in keep], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            kind = pa.list_(pa.struct([("u", pa.int32()), ("v", pa.int32())]))
            return pa.RecordBatch.from_arrays([*cols, pa.array([[{"u": u, "v": v} for u, v in s] for _, s in keep], kind)], names=["h", "a", "n", "ca", "cb", "spans"])

        rows, items, seen, symbols, last = [], [], set(), 0, None
        for batch in batches:
            for h, a, n, ca, cb, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if h != last:
                    if symbols >= SYMBOLS:
                        yield out(rows, items)
                        rows, items, symbols = [], [], 0
                    seen, last = set(), h
                if (a, n, ca, cb) in seen:
                    continue
                seen.add((a, n, ca, cb))
                rows.append((h, a, n, ca, cb))
                items.append((h, a, n, data))
                symbols += (len(data) - a % STEP) // STEP + 1
        if items:
            yield out(rows, items)

    return dealt.mapInArrow(run, "h long, a int, n int, ca long, cb long, spans array<struct<u:int,v:int>>")


def _cut(contexts: DataFrame, width: int, bins: int) -> DataFrame:
    """Contexts cut into runs of at most ``bins`` starts, keyed also by all bytes that the windows of a run share."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for h, a, n, ca, cb, data in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    s = 0
                    while s < n:
                        e = min(n, s + (a - s) % bins + 1)  # anchor distances of a run fall into one bin
                        top = s - (bins - 1 - (a - s) % bins)
                        inner = data[max(top + bins - 1, s) : top + width] if top + bins - 1 < top + width else b""
                        k, _ = digest(b"%d %d " % (h, (a - s) // bins) + inner)
                        piece = data[s : e - 1 + width]
                        rows.append((k, a - s, e - s, *digest(piece), piece, h, a, n, ca, cb, s))
                        s = e
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                names = ["h", "a", "n", "ca", "cb", "data", "ph", "pa", "pn", "pca", "pcb", "off"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return contexts.select("h", "a", "n", "ca", "cb", "data").mapInArrow(run, "h long, a int, n int, ca long, cb long, data binary, ph long, pa int, pn int, pca long, pcb long, off int")


def resolve(contexts: DataFrame, width: int, group: int, bins: int = 16) -> DataFrame:
    """Repeated starts of contexts; keys with over ``group`` strings are first cut to ``bins`` starts, then to one."""
    sizes = stored(contexts.groupBy("h").agg(F.count("*").alias("k")), "group-sizes")
    small = _resolved(contexts.join(sizes.where(F.col("k") <= group).select("h"), "h").select("h", "a", "n", "ca", "cb", "data"), width)
    large = sizes.where(F.col("k") > group).select("h")
    if large.isEmpty():
        return small
    cut = stored(_cut(contexts.join(large, "h"), width, bins), "cut")
    key = ["h", "a", "n", "ca", "cb"]
    counted = cut.groupBy(*key).agg(F.count("*").alias("m"))
    full = counted.where("m > 1").select(*key, F.expr("array(named_struct('u', 0, 'v', n - 1))").alias("spans"))
    if bins > 1:
        several = counted.groupBy("h").agg(F.count("*").alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1").select("h")
        finer = resolve(stored(cut.select(*key, "data").dropDuplicates(key).join(stored(several, "several"), "h"), "finer"), width, group, 1)
        full = full.unionByName(finer)
    back = cut.drop("data").join(stored(full, "cut-spans"), key).select(F.col("ph").alias("h"), F.col("pa").alias("a"), F.col("pn").alias("n"), F.col("pca").alias("ca"), F.col("pcb").alias("cb"), F.expr("transform(spans, x -> named_struct('u', x.u + off, 'v', x.v + off))").alias("spans"))
    return small.unionByName(back.groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans")))


def sifted(rows: DataFrame, wanted: DataFrame, key: str = "ra") -> DataFrame:
    """rows whose hash ``key`` is one of wanted's, and some others: a join's rows before they are exchanged.

    A bit is set for each hash in wanted. The bits, SIEVE / 8 bytes at most whatever the input, go to all tasks.
    """
    place = F.pmod(key, F.lit(SIEVE))
    bits = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    held = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "bucket")  # SIEVE bits
    return held.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _shared_words(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """(ra, rb, n): words of what is left of documents in passages that what is left of another one holds as well.

    kept: (ra, rb, h, lo, n) with the word runs as lists, rows: (t, ra, rb). Anchor hashes are counted; the windows of
    those that two documents have are hashed, from the texts of these documents only, and compared. Texts without such an
    anchor are not exchanged. Joins are by merging at any size, as their smaller sides grow with the corpus.
    """
    left = kept.select("ra", "rb", F.explode(F.arrays_zip("h", "lo", "n")).alias("x")).select("ra", "rb", "x.h", "x.lo", "x.n")
    several = left.groupBy("h").agg(F.min("ra").alias("p"), F.max("ra").alias("q")).where("p != q").select("h")
    wanted = left.join(stored(several, "word-anchors").hint("merge"), "h").groupBy("ra", "rb").agg(F.collect_set(F.struct("lo", "n")).alias("want"))

    def windows(batches):
        import pyarrow as pa

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            row, off, found = [], [], []
            for i, (text, want) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = word_hashes(text)[2].tobytes()
                places = [k for w in want for k in range(w["lo"], w["lo"] + w["n"])]
                row += [i] * len(places)
                off += places
                found += [digest(data[8 * k : 8 * (k + PASSAGE)]) for k in places]
            taken = pa.array(row, pa.int64())
            cols = [batch.column(2).take(taken), batch.column(3).take(taken), pa.array(off, pa.int32()), *(pa.array([f[c] for f in found], pa.int64()) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays(cols, names=["ra", "rb", "k", "wa", "wb"])

    wanted = stored(wanted, "word-runs")
    texts = sifted(rows.select("t", "ra", "rb"), wanted).join(wanted.hint("merge"), ["ra", "rb"]).select("t", "want", "ra", "rb")
    hashed = stored(texts.mapInArrow(windows, "ra long, rb long, k int, wa long, wb long"), "word-windows")
    both = hashed.groupBy("wa", "wb").agg(F.min("ra").alias("p"), F.max("ra").alias("q")).where("p != q").select("wa", "wb")
    k = hashed.join(stored(both, "shared-windows").hint("merge"), ["wa", "wb"]).groupBy("ra", "rb").agg(F.sort_array(F.collect_set("k")).alias("k"))
    steps = F.zip_with(F.slice("k", 1, F.size("k") - 1), F.slice("k", 2, F.size("k") - 1), lambda x, y: F.least(F.lit(PASSAGE), y - x))
    return k.select("ra", "rb", F.aggregate(steps, F.lit(PASSAGE), lambda n, s: n + s).cast("long").alias("n"))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted disjoint [from, to) of spans [from, to) that may overlap."""
    out: list[list[int]] = []
    for u, v in sorted(spans):
        if out and u <= out[-1][1]:
            out[-1][1] = max(out[-1][1], v)
        else:
            out.append([u, v])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """Remove every byte that a ``width``-byte string covers which also starts anywhere else in the corpus.

    Each window of ``width`` bytes belongs to the run of its anchor, so equal windows have equal anchors. Anchor hashes
    are counted; runs of repeated anchors are grouped by the hash of all their bytes: runs that occur twice are repeats
    as they are, and one string of each kind goes, with the others of its anchor, through a suffix array that finds the
    windows shared by strings that differ elsewhere. Nothing is assembled per hot anchor but one string of each kind, and
    anchors with over ``group`` kinds are cut into finer ones.

    A passage of many words can have under ``width`` bytes; such passages stay, and n_shared_words counts their words: of
    the words that touch no removed byte, those in unbroken runs of PASSAGE words or more that another document holds as
    well (white space between words may differ). has_repeat says whether anything was removed or counted there.

    Returns (id_col, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words, has_repeat) and, if asked for, ``kept``
    (binary: a cut can fall into a character). Strings are judged on the input, matches don't cross rows, overlaps count,
    repeated rows and rows with one id are texts like any other (for n_shared_words, rows equal in id and text are one
    document). Null and empty text: 0 bytes. A table without rows gives none; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("t"), F.xxhash64(id_col, text_col).alias("ra"), F.xxhash64(F.lit(41), id_col, text_col).alias("rb"))

    def found(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts, ra, rb = (c.to_pylist() for c in batch.columns)
            some = runs(texts, width)
            while out := [(ra[i], rb[i], lo, h, a, n, *digest(data)) for i, lo, h, a, n, data in islice(some, 50_000)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in RUN.split(", ")])

    def packed(batches):
        import pyarrow as pa

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            z = pa.array([zlib.compress(t, 1) for t in batch.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([z, batch.column(1), batch.column(2), batch.column(3)], names=["z", "ra", "rb", "id"])

    every = stored(rows.where(F.octet_length("t") >= width).select("t", "ra", "rb").mapInArrow(found, RUN), "all-runs")
    z = rows.select("t", "ra", "rb", "id").mapInArrow(packed, f"z binary, ra long, rb long, id {kind}")
    twice = stored(every.select("h").groupBy("h").count().where("count > 1").select("h"), "anchors")
    again = stored(every.join(twice, "h"), "runs")
    kinds = stored(again.groupBy(*KEY).agg(F.count("*").alias("m"), F.min(F.struct("ra", "rb", "lo")).alias("one")), "kinds")
    mixed = stored(kinds.groupBy("h").agg(F.count("*").alias("k"), F.min("m").alias("least")).where("k > 1 and least = 1").select("h"), "mixed")
    wanted = kinds.join(mixed, "h").groupBy(F.col("one.ra").alias("ra"), F.col("one.rb").alias("rb")).agg(F.collect_list(F.struct(*KEY, F.col("one.lo").alias("lo"))).alias("want"))

    def context(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            for i in range(batch.num_rows):
                text = zlib.decompress(batch.column(0)[i].as_py())
                want = batch.column(1)[i].as_py()
                cols = [pa.array([w[c] for w in want], t) for c, t in zip(KEY, types, strict=True)]
                data = pa.array([text[w["lo"] : w["lo"] + w["n"] - 1 + width] for w in want], pa.binary())
                yield pa.RecordBatch.from_arrays([*cols, data], names=[*KEY, "data"])

    contexts = stored(z.join(wanted, ["ra", "rb"]).select("z", "want").mapInArrow(context, "h long, a int, n int, ca long, cb long, data binary"), "contexts")
    spans = resolve(contexts, width, group).unionByName(kinds.where("m > 1").select(*KEY, F.expr("array(named_struct('u', 0, 'v', n - 1))").alias("spans")))
    covers = (
        again.join(stored(spans, "spans"), KEY)
        .select("ra", "rb", F.expr("transform(spans, x -> named_struct('u', lo + x.u, 'v', lo + x.v))").alias("s"))
        .groupBy("ra", "rb")
        .agg(F.flatten(F.collect_set("s")).alias("cover"))
    )
    result = f"id {kind}, ra long, rb long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def cut(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: 5 if with_text else 4]
        names = [x.split()[0] for x in result.split(", ")]
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out, texts, spans = [], [], []
            for packed_text, cover in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(zlib.decompress(packed_text))
                spans.append(_merged([(c["u"], c["v"] + width) for c in cover or ()]))
                kept, at = [], 0
                for u, v in spans[-1]:
                    kept.append(texts[-1][at:u])
                    at = v
                kept = b"".join([*kept, texts[-1][at:]])
                out.append((len(texts[-1]), len(texts[-1]) - len(kept), len(spans[-1]), hashlib.sha256(kept).hexdigest(), kept))
            text, lo, h, n = left_runs(texts, spans)
            ends = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (h, lo, n)]
            cols = [pa.array([r[c] for r in out], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), *cols, *lists], names=[*names, "h", "lo", "n"])

    done = z.join(covers, ["ra", "rb"], "left").select("id", "z", "cover", "ra", "rb").mapInArrow(cut, result + ", h array<long>, lo array<int>, n array<int>")
    done = stored(done, "kept")
    shared = stored(_shared_words(done, rows), "shared-words")
    words = F.coalesce("n", F.lit(0))
    more = ["kept"] if with_text else []
    return done.drop("h", "lo", "n").join(shared, ["ra", "rb"], "left").select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", words.alias("n_shared_words"), ((F.col("n_removed") > 0) | (words > 0)).alias("has_repeat"), *more)
