"""Byte-level BPE as a streaming transducer with bounded lookahead, and incremental decoding."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Splits text before the merges; any white space that follows a visible character starts a new piece.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT = regex.compile(r"(?<=\S)\s")
WINDOW = 1 << 16
CACHED = 300_000


def byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: itself if visible in Latin-1, else the next from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A merge list over bytes: pair ranks, token ids, and how much lookahead makes a token final."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        model = spec["model"]
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rules = [(raw(a), raw(b)) for a, b in pairs]
        self.rank = {p: i for i, p in reversed(list(enumerate(self.rules)))}
        self.bytes_of = {str(i): t for t, i in self.ids.items()} | {str(i): s.encode() for s, i in self.specials.items()}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after a token boundary beyond which more text cannot move that boundary.

        Run the merges on a text and on a longer one. They first differ at the end of the shorter, and a difference moves
        left only when a rule (a, b) joins across it in one of them: then it stands before a. The next such rule has a
        later rank, and its right part begins with that a. So the reach is the longest sum of |a| over chains of rules of
        rising rank in which each a is a left-most part of the next b; one pass over the rules finds it.
        """
        left: dict[bytes, bytes] = {}
        best: dict[bytes, int] = {}
        most = 1
        for a, b in self.rules:
            reach, part = 0, b
            while part is not None:
                reach = max(reach, best.get(part, 0))
                part = left.get(part)
            reach += len(a)
            best[a] = max(best.get(a, 0), reach)
            most = max(most, reach)
            left.setdefault(a + b, a)
        return most + max(len(a) + len(b) for a, b in self.rules)

    def merge(self, data: bytes) -> list[bytes]:
        """Tokens of a short piece: join the lowest-ranked, left-most pair until none is left."""
        rank, never = self.rank.get, len(self.rank)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank(p, never) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == never:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
        return parts


class Transducer:
    """Bytes of one piece in, tokens out as soon as they are final. Holds at most a few lookaheads of bytes."""

    def __init__(self, merges: Merges):
        self.merges, self.pending = merges, b""
        self.block = 4 * merges.lookahead

    def feed(self, data: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(data):
            room = self.block - len(self.pending)
            self.pending += data[at : at + room]
            at += room
            if len(self.pending) >= self.block:
                yield from self._stable()

    def _stable(self) -> Iterator[bytes]:
        end, limit = 0, len(self.pending) - self.merges.lookahead
        for token in self.merges.merge(self.pending):
            if end + len(token) > limit:
                break
            end += len(token)
            yield token
        self.pending = self.pending[end:]

    def finish(self) -> list[bytes]:
        rest, self.pending = self.pending, b""
        return self.merges.merge(rest) if rest else []


class Pieces(dict):
    """Ids of a piece, joined by commas; remembers short pieces, a bounded number of them."""

    def __init__(self, merges: Merges, limit: int = CACHED):
        super().__init__()
        self.merges, self.limit = merges, limit

    def __missing__(self, piece: str) -> str:
        data, ids = piece.encode("utf-8", "replace"), self.merges.ids
        if len(data) > self.merges.lookahead:
            stream = Transducer(self.merges)
            return ",".join([*(str(ids[t]) for t in stream.feed(data)), *(str(ids[t]) for t in stream.finish())])
        out = ",".join([str(ids[t]) for t in self.merges.merge(data)])
        if len(self) >= self.limit:
            self.clear()
        self[piece] = out
        return out


class Codec:
    """Encodes texts window by window and decodes id streams, in constant memory besides the text itself."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.pieces = Pieces(self.merges)
        self.split = regex.compile(PIECES).findall
        names = sorted(self.merges.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def windows(self, text: str) -> Iterator[str]:
        """Parts of a text that end where every tokenisation has a piece boundary."""
        at = 0
        while len(text) - at > WINDOW:
            m = CUT.search(text, at + WINDOW)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str) -> Iterator[str]:
        """Comma-joined ids of one window after another; none for an empty text."""
        parts = self.special.split(text) if self.special and any(s in text for s in self.merges.specials) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield str(self.merges.specials[part])
            elif part:
                for window in self.windows(part):
                    yield ",".join(map(self.pieces.__getitem__, self.split(window)))

    def decode(self, chunks: Iterable[str]) -> Iterator[str]:
        """Text of a stream of comma-joined ids. The decoder holds at most the bytes of one unfinished character."""
        machine, bytes_of = codecs.getincrementaldecoder("utf-8")("replace"), self.merges.bytes_of.__getitem__
        for chunk in chunks:
            yield machine.decode(b"".join(map(bytes_of, chunk.split(","))))
        yield machine.decode(b"", True)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the joined ids and of the decoded text."""
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()

        def counted() -> Iterator[str]:
            nonlocal n
            for chunk in self.encode(text):
                ids_sha.update(("," + chunk if n else chunk).encode())
                n += chunk.count(",") + 1
                yield chunk

        for part in self.decode(counted()):
            text_sha.update(part.encode("utf-8", "replace"))
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    def ids(self, text: str) -> list[int]:
        return [int(i) for chunk in self.encode(text) for i in chunk.split(",")]


@cache
def codec(path: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(path)


def _mapped(docs: DataFrame, path: str, text_col: str, row, added: str) -> DataFrame:
    """docs with row(codec, text) added as new last columns, in tasks."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c not in {x.split()[0] for x in added.split(", ")}]
    out = docs.select(*kept)
    extra = StructType.fromDDL(added)
    schema = StructType([*out.schema, *extra])
    arrow = to_arrow_schema(extra)
    at = kept.index(text_col)

    def run(batches):
        encoder = codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [row(encoder, t.as_py() or "") for t in part.column(at)]
                columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *arrow.names])

    return out.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of every whole text (replacing columns of those names).

    ``path``: a byte-level BPE vocabulary that every executor can read. Strings of special tokens in a text become those
    tokens. Null and empty text have no ids. A narrow map: no shuffle, and memory holds one batch of rows.
    """
    return _mapped(docs, path, text_col, lambda c, t: c.digests(t), "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with the ids of every whole text in ``ids`` and the text decoded from them in ``decoded``."""

    def row(c: Codec, text: str):
        ids = c.ids(text)
        return ids, "".join(c.decode(map(str, ids)))

    return _mapped(docs, path, text_col, row, "ids array<int>, decoded string")
