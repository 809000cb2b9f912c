"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a byte string exactly one token can end its encoding: the token whose bytes end the prefix and which
is a valid neighbour of the last token of the prefix before it. Two tokens are valid neighbours when undoing merges on
both sides of their border never shows a pair that would have been merged earlier than what stands there. Storing that
one token a prefix gives exact appends (only new prefixes are worked out), truncation for free, and re-encoding after an
edit that stops as soon as the stored tokens agree with the old ones over the longest token's length.
"""

from __future__ import annotations

import base64
import struct
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import cut, trimmed, worker_state
from tidemark.session import ship

# What a worker keeps: bounds of memory, which cost time and change nothing else.
PIECE_BYTES = 32 << 20  # of encoded pieces, old and new ones together
PIECE_OVERHEAD = 160  # of a piece, beside its own bytes and those of its ids
KEEP_KNOWN = 300_000
KEEP_LENGTHS = 50_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBPE:
    """An encoder for merge ranks; pattern cuts texts into pieces that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.number_of = [b"%d" % rank for rank in range(len(self.bytes_of))]
        self.longest = max(map(len, ranks))
        self.find = regex.compile(pattern).findall
        self._known: dict[int, bool] = {}
        self._lengths: dict[bytes, tuple[int, ...]] = {}
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            ends.setdefault(token[-3:], set()).add(len(token))
        self._ends = ends
        self._matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._matcher.add_word(token.decode("latin-1"), (len(token), rank))
        self._matcher.make_automaton()
        self._merge: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, token in enumerate(self.bytes_of):
            self._split(rank, token)

    def _split(self, rank: int, token: bytes) -> None:
        """Find the two tokens whose merge makes this one (a token that no merge makes is its own halves)."""
        self.halves[rank] = (rank, rank)
        for cut in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank and self._stands(left, right):
                self.halves[rank] = (left, right)
                self._merge[left << 32 | right] = rank
                return

    def _stands(self, left: int, right: int) -> bool:
        """Would these tokens, side by side, be left as they are by merges in order of rank?"""
        before = 1 << 62  # merges of this rank or later cannot have touched the border any more
        while True:
            if self._merge.get(left << 32 | right, before) < before:
                return False
            if left > right:  # left was made last: undo it
                inner = self.halves[left][1]
                if inner != left:
                    before, left = left, inner
                    continue
                before, inner = right + 1, self.halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                inner = self.halves[right][0]
                if inner != right:
                    before, right = right + 1, inner
                    continue
                before, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def neighbours(self, left: int, right: int) -> bool:
        key = left << 32 | right
        out = self._known.get(key)
        if out is None:
            if len(self._known) > KEEP_KNOWN:
                self._known.clear()
            out = self._known[key] = self._stands(left, right)
        return out

    def _lengths_at(self, end: bytes) -> tuple[int, ...]:
        """Lengths of the tokens that end in these (up to three) bytes, longest first."""
        out = {*self._ends.get(end, ()), *(k for k in (1, 2) if end[-k:] in self.ranks)}
        if len(self._lengths) > KEEP_LENGTHS:
            self._lengths.clear()
        return self._lengths.setdefault(end, tuple(sorted(out, reverse=True)))

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Fill last[i], the token that ends the encoding of data[:i], from len(last) on; last[0] is a filler."""
        get, known, lengths = self.ranks.get, self._known.get, self._lengths
        for i in range(len(last), (len(data) if upto is None else upto) + 1):
            end = data[i - 3 if i > 3 else 0 : i]
            for n in lengths.get(end) or self._lengths_at(end):
                t = get(data[i - n : i]) if n <= i else None
                if t is not None:
                    if n == i:
                        break
                    before = last[i - n]
                    ok = known(before << 32 | t)
                    if ok or (ok is None and self.neighbours(before, t)):
                        break
            else:
                raise ValueError(f"no token ends the first {i} bytes")
            last.append(t)
        return last

    def walk(self, last: list[int], n: int) -> list[int]:
        """The tokens of data[:n], from the table of last tokens."""
        out = []
        while n:
            out.append(last[n])
            n -= len(self.bytes_of[last[n]])
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last, known = [-1] * (len(data) + 1), self._known.get
        for end, (n, t) in self._matcher.iter(data.decode("latin-1")):  # of one end, the longest tokens come first
            i = end + 1
            if last[i] < 0:
                if n == i:
                    last[i] = t
                    continue
                before = last[i - n]
                ok = known(before << 32 | t)
                if ok or (ok is None and self.neighbours(before, t)):
                    last[i] = t
        if min(last[1:]) < 0:
            raise ValueError(f"no token ends the first {last.index(-1, 1)} bytes")
        return self.walk(last, len(data))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.encode_piece, self.find(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Appendable:
    """One piece under edit: exact appends, truncation, and replacement that re-encodes only near the edit."""

    def __init__(self, bpe: ByteBPE, data: bytes = b"") -> None:
        self.bpe, self.data, self.last, self.worked = bpe, b"", [-1], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.worked += len(more)
        self.bpe.extend(self.data, self.last)

    def truncate(self, n: int) -> None:
        self.data = self.data[:n]
        del self.last[n + 1 :]

    def replace(self, start: int, end: int, new: bytes) -> None:
        """data[start:end] becomes new. Tokens after it are kept once a longest token's length of them agree."""
        old, shift = self.last, len(new) - (end - start)
        data = self.data[:start] + new + self.data[end:]
        last, agree, i = old[: start + 1], 0, start
        while i < len(data) and agree < self.bpe.longest:
            i += 1
            self.bpe.extend(data, last, i)
            self.worked += 1
            was = i - shift
            # a token that reaches back over the edit proves nothing about what follows
            agree = agree + 1 if was > end and was < len(old) and old[was] == last[i] and i - len(self.bpe.bytes_of[last[i]]) >= start + len(new) else 0
        self.data, self.last = data, last + old[i - shift + 1 :] if i < len(data) else last

    def tokens(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.walk(self.last, len(self.data))


class _Pieces(dict):
    """Piece to its ids as little-endian int32 bytes.

    Bounded by bytes: when the newer half is full it becomes the older one, whose pieces come back as they are met again.
    """

    def __init__(self, bpe: ByteBPE) -> None:
        super().__init__()
        self.bpe, self.older, self.held = bpe, {}, 0

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            ids = self.bpe.encode_piece(piece)
            out = struct.pack(f"<{len(ids)}i", *ids)
        if len(piece) <= 64:
            self.held += PIECE_OVERHEAD + len(piece) + len(out)
            if 2 * self.held > PIECE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[piece] = out
        return out


def _pieces(spec) -> _Pieces:
    """One encoder a worker process and vocabulary."""
    path, pattern, ranks = spec.value
    return worker_state(("pieces", path, pattern), lambda: _Pieces(ByteBPE(ranks, pattern)))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *values]).astype(np.int32)))


def _spec(docs: DataFrame, ranks_path: str, pattern: str):
    ship(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast((ranks_path, pattern, read_ranks(ranks_path)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of each row: its whole text encoded, and the ids decoded again.

    With digests, decoded stays in the worker and ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 come
    in its place. Null counts as empty and gives no ids. Repeated rows are each encoded; other columns are ignored; an
    empty table gives an empty result. The vocabulary (fixed by its file) is broadcast; nothing is shuffled.
    """
    spec = _spec(docs, ranks_path, pattern)

    def work(batches):
        pieces = _pieces(spec)
        find, get, token, number = pieces.bpe.find, pieces.__getitem__, pieces.bpe.bytes_of.__getitem__, pieces.bpe.number_of.__getitem__
        for whole in trimmed(batches):
            for batch in cut(whole, "text", 1_000_000):
                ids = [np.frombuffer(b"".join(map(get, find(t))), "<i4") if t else np.empty(0, np.int32) for t in batch.column("text").to_pylist()]
                if digests:
                    pairs = [(sha256(b",".join(map(number, x))).hexdigest(), sha256(b"".join(map(token, x))).hexdigest()) for x in map(np.ndarray.tolist, ids)]
                    told = [pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())]
                else:
                    told = [pa.array([b"".join(map(token, x.tolist())) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids), *told], ["doc_id", "ids", *(("ids_sha256", "decoded_sha256") if digests else ("decoded",))])

    base = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return base.mapInArrow(work, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, ids array<int>, " + ("ids_sha256 string, decoded_sha256 string" if digests else "decoded binary"))


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of encoded, and decoded: the bytes of its ids. Null ids decode to null, unknown ids raise an error."""
    spec = _spec(encoded, ranks_path, pattern)

    def work(batches):
        token = _pieces(spec).bpe.bytes_of.__getitem__
        for batch in batches:
            back = [None if x is None else b"".join(map(token, x)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*batch.schema.names, "decoded"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return encoded.drop("decoded").mapInArrow(work, f"{names}, decoded binary")
