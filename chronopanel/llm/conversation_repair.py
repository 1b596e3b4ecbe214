"""Conversation structure repair: cheapest edits to a legal order of roles, the least of equally cheap audits."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hash128, stored

#: Costs of an edit, and of every truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows in a piece of a conversation, as a power of two.
PIECE_BITS = 12
#: Nodes that are ranked together.
NODES = 1 << 19

# Legal orders are read by four states: nothing yet, after a system row, after a user row, after an assistant row.
# Complete are the first and the last. Each state has one role that may be inserted or given, and where that leads.
STATES, FAR = 4, 1 << 40
NEXT = np.array([2, 2, 3, 2])
NEEDS = ["user", "user", "assistant", "user"]
COMPLETE = np.array([0, FAR, FAR, 0])
#: Rows by letter: b blank, d duplicate, else the role's initial (o: any other), upper-case if truncated; _ is no row.
LETTERS = "_bdsuaoSUAO"
#: Edits in the order of their initials; END comes before all.
EDITS = "DIKR"
END, DELETED, INSERTED, KEPT, REROLED = range(5)
_OF = np.zeros(256, np.int64)
_OF[list(LETTERS.encode())] = np.arange(len(LETTERS))


def _row_costs() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By letter: cost of deleting and of giving the needed role; by letter and state: cost of keeping, and where it leads."""
    delete, rerole = np.full(len(LETTERS), DELETE), np.full(len(LETTERS), FAR)
    keep, to = np.full((len(LETTERS), STATES), FAR), np.zeros((len(LETTERS), STATES), int)
    for i, c in enumerate(LETTERS):
        if c not in "_bd":
            late = TRUNCATED if c.isupper() else 0
            rerole[i] = REROLE + late
            for q, roles in enumerate(("su", "u", "a", "u")):
                if c.lower() in roles:
                    keep[i, q], to[i, q] = late, "_sua".index(c.lower())
    return delete, rerole, keep, to


DELETING, RENAMING, KEEPING, KEPT_TO = _row_costs()


def _with_inserts(h: np.ndarray) -> np.ndarray:
    """Costs to the end if rows may be inserted first: two suffice, as a third comes back to a state that was left."""
    once = np.minimum(h, INSERT + h[..., NEXT])
    return np.minimum(once, INSERT + once[..., NEXT])


def packed(pieces: list[str]) -> np.ndarray:
    """Letters as numbers, one row a piece, set to the right."""
    width = max(map(len, pieces), default=0)
    return _OF[np.frombuffer("".join(p.rjust(width, "_") for p in pieces).encode(), np.uint8)].reshape(len(pieces), width)


def costs(codes: np.ndarray, ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(piece, place, state): least cost from before each row to the end of the conversation, of which ``ends`` (piece,
    state) is known after the piece. Rows may be inserted before every row, and after the last one of a conversation."""
    out = np.empty((codes.shape[0], codes.shape[1] + 1, STATES), np.int64)
    out[:, -1] = h = np.where(last[:, None], _with_inserts(ends), ends)
    for i in range(codes.shape[1] - 1, -1, -1):
        c = codes[:, i]
        row = np.minimum(DELETING[c][:, None] + h, RENAMING[c][:, None] + h[:, NEXT])
        row = np.minimum(row, KEEPING[c] + np.take_along_axis(h, KEPT_TO[c], 1))
        out[:, i] = h = np.where((c == 0)[:, None], h, np.minimum(_with_inserts(row), FAR))
    return out


def optimal_arcs(codes: np.ndarray, h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(node, edit): the node that an edit on a cheapest path leads to, or -1. Nodes are numbered by piece, place, state."""
    b, n = codes.shape
    node = np.arange(b * (n + 1) * STATES).reshape(b, n + 1, STATES)
    arcs = np.full((b, n + 1, STATES, len(EDITS) + 1), -1, np.int64)
    reach = h < FAR
    own = np.where(codes[..., None] == 0, FAR, 0)  # a place without a row has no arcs
    after, before, c = h[:, 1:], h[:, :-1], codes
    arcs[:, :-1, :, DELETED] = np.where(reach[:, :-1] & (before == own + DELETING[c][..., None] + after), node[:, 1:], -1)
    arcs[:, :-1, :, REROLED] = np.where(reach[:, :-1] & (before == own + RENAMING[c][..., None] + after[..., NEXT]), node[:, 1:][..., NEXT], -1)
    arcs[:, :-1, :, KEPT] = np.where(reach[:, :-1] & (before == own + KEEPING[c] + np.take_along_axis(after, KEPT_TO[c], 2)), np.take_along_axis(node[:, 1:], KEPT_TO[c], 2), -1)
    open_ = np.concatenate([codes != 0, last[:, None]], axis=1)[..., None]
    arcs[..., INSERTED] = np.where(open_ & reach & (h == INSERT + h[..., NEXT]), node[..., NEXT], -1)
    return arcs.reshape(-1, len(EDITS) + 1)


def least_pointers(arcs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Pointers of 1, 2, 4, ... edits along the least path from every node, and the node's rank among all by its audit.

    Ranks of audits of 2k letters are those of pairs: the rank of the first k letters and that of the k letters after
    them, found through the pointer over k edits. Doubling ends when pointers stand still, which is at the longest path.
    An edit's initial leads from a node to one node (the state fixes the role that it makes), so paths with equal audits
    are equal, and of two arcs the one with the smaller (initial, rank) begins the smaller audit whatever follows.
    """
    has = arcs >= 0
    rank = np.where(has.any(1), has.argmax(1), END)
    jump = np.where(rank == END, np.arange(len(arcs)), arcs[np.arange(len(arcs)), rank])
    pointers = [jump]
    while True:
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[jump], return_inverse=True)[1]
        further = jump[jump]
        if (further == jump).all():
            break
        pointers.append(jump := further)
    first = np.where(has, np.arange(len(EDITS) + 1) * (len(arcs) + 1) + rank[np.maximum(arcs, 0)], np.iinfo(np.int64).max)
    chosen = first.argmin(1)
    assert (np.where(has.any(1), arcs[np.arange(len(arcs)), chosen], np.arange(len(arcs))) == pointers[0]).all()
    return pointers, rank


def audits(codes: np.ndarray, ends: np.ndarray, last: np.ndarray, entry: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The least audit of each piece from its state ``entry`` on, the state that it ends in, and the cost from there."""
    h = costs(codes, ends, last)
    arcs = optimal_arcs(codes, h, last)
    pointers, _ = least_pointers(arcs)
    (b, n), steps = codes.shape, 1 << len(pointers)
    start = (np.arange(b) * (n + 1) + (codes == 0).sum(1)) * STATES + entry
    at = np.repeat(start[:, None], steps, 1)
    for k, jump in enumerate(pointers):  # the node after j edits, by the bits of j
        far = (np.arange(steps) >> k & 1) == 1
        at[:, far] = jump[at[:, far]]
    has = arcs[at] >= 0
    letter = np.where(has.any(2), has.argmax(2), END)
    text = np.frombuffer(b"." + EDITS.encode(), np.uint8)[letter]
    lines = [row.tobytes().rstrip(b".").decode() for row in text]
    return lines, at[:, -1] % STATES, h.reshape(-1, STATES)[start // STATES, entry]


def _by_length(pieces: list[str]):
    """Numbers of pieces of like length, together at most about NODES nodes."""
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    block: list[int] = []
    for i in order:
        if block and ((len(block) + 1) * (len(pieces[i]) + 1) * STATES > NODES or len(pieces[i]) > 2 * len(pieces[block[0]]) + 8):
            yield np.array(block)
            block = []
        block.append(i)
    if block:
        yield np.array(block)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults set by crc32 of "conv_id:turn" modulo 20: 0 drops the row, 1
    empties its text, 2 takes out its sentence marks, 3 repeats it, 4 makes it the user's. Nulls count as one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    rows = conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), fault.alias("fault")).where("fault != 0")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at) stored in one global order: by conversation and turn, nulls first, then role and
    text. ``at`` numbers the rows in that order. Ranges are cut anywhere, also inside a conversation."""
    keys = ["conv_id", "turn", "role", F.left(F.col("text"), F.lit(32)), F.xxhash64("text"), "at"]
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]).withColumn("at", F.monotonically_increasing_id())
    return stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "turns")


def cut_in_pieces(ordered: DataFrame) -> DataFrame:
    """(conv_id, piece, at, codes): the letters of up to 2**PIECE_BITS rows of a conversation; at is the first row's."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.left(F.col("role"), F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.trim(bare, F.lit(SPACES)) == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    key = hash128(F.col("conv_id"), F.col("role"), F.col("text"))
    narrow = ordered.select("conv_id", "at", letter.alias("letter"), key.alias("k")).select("conv_id", "at", "letter", F.col("k.a").alias("ka"), F.col("k.b").alias("kb"))
    narrow = stored(narrow, "turn-letters")
    seen = narrow.groupBy("ka", "kb").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("ka", "kb", "first")
    marked = narrow.join(seen, ["ka", "kb"], "left").select("conv_id", "at", F.when((F.col("letter") != "b") & (F.col("at") > F.col("first")), "d").otherwise(F.col("letter")).alias("letter"))
    pieces = marked.groupBy("conv_id", F.shiftright("at", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("at", "letter"))).alias("rows"))
    return stored(pieces.select("conv_id", "piece", F.col("rows")[0]["at"].alias("at"), F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("codes")), "turn-pieces")


def _bounds(pieces: DataFrame) -> DataFrame:
    """pieces with what lies around each: ``ends`` (cost from each state after it), ``entry`` (the state before it) and
    ``last``. Conversations of one piece need no look at others. In longer ones every piece is first summed up as a table
    of 4 x 4 least costs; a conversation's tables, one for 4,096 rows, give the costs after each piece from the back, and
    the states that the least paths enter in from the front."""
    several = stored(pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("__c")), "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("__c"))
    single = pieces.join(several, same, "left_anti").select("*", F.array(*[F.lit(int(x)) for x in COMPLETE]).cast("array<bigint>").alias("ends"), F.lit(0).alias("entry"), F.lit(True).alias("last"))
    long = pieces.join(several, same, "left_semi")
    kind = dict(pieces.dtypes)["conv_id"]

    def sums(frames):
        for f in frames:
            tables = [None] * len(f)
            for block in _by_length(list(f["codes"])):
                codes, no = packed([f["codes"].iloc[i] for i in block]), np.zeros(len(block), bool)
                each = [costs(codes, np.repeat(np.where(np.arange(STATES) == q, 0, FAR)[None], len(block), 0), no)[:, 0] for q in range(STATES)]
                for i, t in zip(block, np.stack(each, 2), strict=True):
                    tables[i] = t.ravel().tolist()
            yield f.drop(columns="codes").assign(costs=tables)

    def after(f):
        f = f.sort_values("piece")
        h, ends = _with_inserts(COMPLETE), []
        for t in f["costs"].iloc[::-1]:
            ends.append(np.minimum(h, FAR).tolist())
            h = np.minimum((np.array(t).reshape(STATES, STATES) + h[None]).min(1), FAR)
        ends[0] = COMPLETE.tolist()
        return f.drop(columns="costs").assign(ends=ends[::-1], last=np.arange(len(f)) == len(f) - 1)

    def exits(frames):
        for f in frames:
            out = [[0] * STATES for _ in range(len(f))]
            for block in _by_length(list(f["codes"])):
                codes, ends, last = packed([f["codes"].iloc[i] for i in block]), np.array([f["ends"].iloc[i] for i in block]), f["last"].to_numpy()[block]
                for q in range(STATES):
                    for i, e in zip(block, audits(codes, ends, last, np.full(len(block), q))[1], strict=True):
                        out[i][q] = int(e)
            yield f.assign(exits=out)

    def entries(f):
        f, state, entry = f.sort_values("piece"), 0, []
        for e in f["exits"]:
            entry.append(state)
            state = int(e[state])
        return f.drop(columns="exits").assign(entry=entry)[["conv_id", "piece", "at", "codes", "ends", "entry", "last"]]

    schema = f"conv_id {kind}, piece long, at long"
    # conversations are told apart by their least row, as a null id is one too
    tables = long.mapInPandas(sums, schema + ", costs array<bigint>")
    known = stored(tables.groupBy("conv_id").applyInPandas(after, schema + ", ends array<bigint>, last boolean").select(F.col("at"), "ends", "last"), "piece-ends")
    left = stored(long.join(known, "at").select(*pieces.columns, "ends", "last").mapInPandas(exits, f"{schema}, codes string, ends array<bigint>, last boolean, exits array<bigint>"), "piece-exits")
    return single.unionByName(left.groupBy("conv_id").applyInPandas(entries, f"{schema}, codes string, ends array<bigint>, entry int, last boolean"))


class Conversation:
    """What is known of a conversation while its pieces and rows pass by in order."""

    def __init__(self, conv_id):
        self.conv_id, self.sha, self.audit, self.counts, self.cost = conv_id, hashlib.sha256(), [], {"b": 0, "d": 0, "t": 0}, 0
        self.low = self.high = self.turn = None
        self.turns, self.illegal, self.initial, self.state, self.any = 0, 0, None, 0, False
        self.edits = iter("")

    def write(self, line: str) -> None:
        self.sha.update((("\n" if self.any else "") + line).encode())
        self.any = True

    def step(self) -> str | None:
        """Edits up to the one that takes the next row; None when the piece has no more."""
        for e in self.edits:
            if e == "D":
                return e
            if e == "I":
                self.write(NEEDS[self.state] + ":")
                self.state = int(NEXT[self.state])
            else:
                return e
        return None

    def piece(self, codes: str, audit: str, cost: int) -> None:
        self.step()  # inserts after the last row of the piece before
        self.counts["b"] += codes.count("b")
        self.counts["d"] += codes.count("d")
        self.counts["t"] += sum(map(str.isupper, codes))
        self.audit.append(audit)
        self.edits = iter(audit)
        self.cost += cost

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.turn, self.high, self.turns = turn, turn, self.turns + 1
            self.low = turn if self.low is None else self.low
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if (edit := self.step()) == "K":
            self.write(f"{role}:{text}")
            self.state = "_sua".index(role[:1])
        elif edit == "R":
            self.write(f"{NEEDS[self.state]}:{text}")
            self.state = int(NEXT[self.state])

    def facts(self) -> tuple:
        self.step()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repair_conversations(rows: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """Facts and repair of every conversation of rows (conv_id, turn, role, text), and of ``all_ids`` (conv_id), which may
    name conversations without rows.

    Rows are read by turn, nulls first, then by role and text. A row's first fault counts: blank, duplicate (its role and
    text stand in an earlier row), truncated (it does not end with a sentence mark). Edits keep a row (0), give it the role
    user or assistant (3), delete it (4; blank and duplicate rows must go) or insert an empty row of either role (3); a
    truncated row that stays costs 3 more. What is left must read as an optional system row, then pairs of user and
    assistant, or as nothing. Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the
    cheapest edits, of several the least) and repaired_sha256 (of role:text lines), as longs and strings.

    All rows are put in one global order whose ranges cut long conversations, duplicates are found by hash with a combined
    minimum, and letters of up to 4,096 rows make a piece. Costs run through a piece from the back; then nodes on cheapest
    paths are ranked by audits of 1, 2, 4, ... letters and the path is listed through the doubled pointers. Pieces of a long
    conversation are joined by their 4 x 4 tables of costs. Only the last step reads a conversation as a whole, because its
    digest and audit are one: a sorted stream that holds a row and the audit at a time.

    Null role and text are one blank (so the row is blank); rows with a null id make a conversation of their own. Repeated
    rows are duplicates. A conversation without rows has zeros, an empty audit and the digest of nothing; no rows and no
    ids give none. Other columns are not read.
    """
    kind = dict(rows.dtypes)["conv_id"]
    ordered = in_order(rows)
    bounded = _bounds(cut_in_pieces(ordered))

    def walked(frames):
        for f in frames:
            lines, paid = [""] * len(f), np.zeros(len(f), np.int64)
            for block in _by_length(list(f["codes"])):
                codes, ends = packed([f["codes"].iloc[i] for i in block]), np.array([f["ends"].iloc[i] for i in block])
                found, out, cost = audits(codes, ends, f["last"].to_numpy()[block], f["entry"].to_numpy()[block])
                paid[block] = cost - ends[np.arange(len(block)), out]
                for i, line in zip(block, found, strict=True):
                    lines[i] = line
            yield f[["conv_id", "at", "codes"]].assign(audit=lines, cost=paid)

    heads = bounded.mapInPandas(walked, f"conv_id {kind}, at long, codes string, audit string, cost long")
    none = lambda *cols: [F.lit(None).cast(t).alias(c) for c, t in cols]
    turn = dict(rows.dtypes)["turn"]
    parts = heads.select("conv_id", "at", F.lit(1).alias("kind"), *none(("turn", turn), ("role", "string")), F.col("codes").alias("text"), "audit", "cost")
    parts = parts.unionByName(ordered.select("conv_id", "at", F.lit(2).alias("kind"), "turn", "role", "text", *none(("audit", "string"), ("cost", "long"))))
    if all_ids is not None:
        parts = parts.unionByName(all_ids.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"), *none(("turn", turn), ("role", "string"), ("text", "string"), ("audit", "string"), ("cost", "long"))))
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def read(batches):
        import pyarrow as pa

        one, done, types = None, [], None

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        for batch in batches:
            types = [batch.schema.types[0], *[pa.int64()] * 6, pa.string(), pa.string()]
            for conv_id, _, k, turn_, role, text, audit, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if one is None or conv_id != one.conv_id:
                    if one is not None:
                        done.append(one.facts())
                    one = Conversation(conv_id)
                if k == 1:
                    one.piece(text, audit, cost)
                elif k == 2:
                    one.row(turn_, role, text)
            if done:
                yield made()
                done.clear()
        if one is not None:
            done.append(one.facts())
            yield made()

    return dealt.mapInArrow(read, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _sql() -> str:
    """The same by a forward pass over (cost, audit) of each state, packed in one string: nine digits, then the audit."""
    from .sql import BLANKS

    add = lambda s, n, e: f"lpad(cast(cast({s}[1:9] as bigint) + {n} as varchar), 9, '0') || {s}[10:] || '{e}'"
    best = lambda *xs: f"list_min([{', '.join(xs)}])"
    late = "case when fault = 't' then 3 else 0 end"
    may = lambda x, also="true": f"case when fault not in ('b', 'd') and {also} then {x} end"
    step = [
        add("p[1]", 4, "D"),
        best(add("p[2]", 4, "D"), may(add("p[1]", late, "K"), "initial = 's'")),
        best(add("p[3]", 4, "D"), *[may(x, also) for s in (1, 2, 4) for x, also in ((add(f"p[{s}]", late, "K"), "initial = 'u'"), (add(f"p[{s}]", f"3 + {late}", "R"), "true"))]),
        best(add("p[4]", 4, "D"), may(add("p[3]", late, "K"), "initial = 'a'"), may(add("p[3]", f"3 + {late}", "R"))),
    ]
    inserted = lambda p: f"[{p}[1], {p}[2], {best(f'{p}[3]', *[add(f'{p}[{s}]', 3, 'I') for s in (1, 2, 4)])}, {best(f'{p}[4]', add(f'{p}[3]', 3, 'I'))}]"
    twice = lambda source, cols: f"select {cols}, {inserted('p')} as p from (select {cols}, {inserted('p')} as p from ({source}))"
    table = "list_transform(range(256), lambda x: list_reduce(list_prepend(x::bigint, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    return rf"""
with recursive tab as materialized (select {table} as t),
src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
hit as (select conv_id, turn, role, text, {crc} % 20 as f from src, tab),
rows_ as (select conv_id, turn, case when f = 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when f = 3 then [0, 1] else [0] end) as copy from hit where f <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from rows_),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) as k, rtrim(text, {BLANKS}) as bare, lag(role) over (partition by conv_id order by i) as above from numbered),
marked as (select conv_id, turn, i, role, text, role[1] as initial, above, case when trim(bare, {BLANKS}) = '' then 'b' when k > 1 then 'd' when bare[-1] not in ('.', '!', '?') then 't' else '' end as fault from seen),
ids as (select distinct conv_id from conversations),
paths as (select conv_id, 0 as i, p from ({twice("select conv_id, ['000000000', null, null, null]::varchar[] as p from ids", "conv_id")})
  union all select conv_id, i, p from ({twice(f"select m.conv_id, m.i, [{', '.join(step)}] as p from paths q join marked m on m.conv_id is not distinct from q.conv_id and m.i = q.i + 1", "conv_id, i")})),
final as (select conv_id, {best("p[1]", "p[4]")} as best from paths qualify row_number() over (partition by conv_id order by i desc) = 1),
solved as (select conv_id, best[1:9]::bigint as cost, best[10:] as audit from final),
letters as (select conv_id, unnest(string_split(audit, '')) as e, unnest(range(1, len(audit) + 1)) as j from solved where audit <> ''),
placed as (select *, count(*) filter (e <> 'I') over (partition by conv_id order by j) as i, count(*) filter (e <> 'D') over (partition by conv_id order by j) as n from letters),
first_ as (select conv_id, min(j) as j from placed where e <> 'D' group by conv_id),
system as (select p.conv_id, p.e = 'K' and m.initial = 's' as s from first_ f join placed p on p.conv_id is not distinct from f.conv_id and p.j = f.j left join marked m on m.conv_id is not distinct from p.conv_id and m.i = p.i),
out_ as (select p.conv_id, p.j, case when e = 'K' then m.role when (n - case when s then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else m.text end as line
  from placed p join system y on y.conv_id is not distinct from p.conv_id left join marked m on m.conv_id is not distinct from p.conv_id and m.i = p.i where e <> 'D'),
texts as (select conv_id, sha256(string_agg(line, chr(10) order by j)) as h from out_ group by conv_id),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
  count(*) filter (above is not null and left(above, 1) || initial not in ('su', 'ua', 'au')) as illegal from marked group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, s.cost, s.audit, coalesce(h, sha256('')) as repaired_sha256
from ids i join solved s on s.conv_id is not distinct from i.conv_id left join facts f on f.conv_id is not distinct from i.conv_id left join texts t on t.conv_id is not distinct from i.conv_id
"""
