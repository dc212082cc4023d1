"""Byte-level BPE by a rank file: a hierarchical-bitmap queue of merge ranks, in a pass over the documents."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, alone, blocks, id_text

#: Chunks that a worker keeps with their ids; beyond it the table is emptied, which costs time and changes nothing.
KEPT_CHUNKS = 600_000
LONG_CHUNK = 256
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: White space that stands beside white space, at an end of the text, or is neither a space nor a line feed.
ODD_SPACE = re.compile(r"\s\s|^\s|\s$|[^\S \n]")
_CODECS: dict[tuple[str, str], "Codec"] = KEPT.setdefault("bpe", {})


class RankQueue:
    """Buckets of positions by rank; three levels of 64-bit words tell the lowest rank that has positions."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.top, self.mid, self.low = 0, {}, {}

    def mark(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def push(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = positions
            self.mark(rank)
        else:
            bucket += positions

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions, ascending; the rank is empty then."""
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        self.low[a] = word & (word - 1)
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return rank, sorted(self.buckets.pop(rank))


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pairs = np.full(1 << 16, -1, np.int64)  # ranks of pairs of bytes
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in _CODECS:
            _CODECS[path, pattern] = cls(path, pattern)
        return _CODECS[path, pattern]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """ids of pre-tokens: in each the lowest rank first, leftmost first, until no pair of neighbours has a rank.

        All pieces lie behind one another in one linked list of parts, without pairs across their ends, and share a
        queue; what merges in one piece does not depend on the others.
        """
        data = b"".join(pieces)
        n, ranks = len(data), self.ranks.get
        if not n:
            return [[] for _ in pieces]
        ends = np.cumsum([len(x) for x in pieces])
        raw = np.frombuffer(data, np.uint8).astype(np.int64)
        first = np.append(self.pairs[raw[:-1] << 8 | raw[1:]], -1)
        first[ends[ends > 0] - 1] = -1
        after, before, pair = list(range(1, n + 1)), list(range(-1, n)), first.tolist()  # pair: rank of the part at i with the next, or -1
        last, starts = bytearray(n + 1), bytearray(n + 1)  # last: the part that starts here ends its piece
        for e, x in zip(ends.tolist(), pieces, strict=True):
            if x:
                last[e - 1] = starts[e - len(x)] = 1
        queue = RankQueue()
        order = np.argsort(first, kind="stable")
        order = order[first[order] >= 0]
        if len(order):
            cuts = np.flatnonzero(np.diff(first[order])) + 1
            for group in np.split(order, cuts):
                queue.push(int(first[group[0]]), group.tolist())
        while queue.top:
            rank, bucket = queue.pop()
            for k, i in enumerate(bucket):
                if pair[i] != rank:  # stale
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                pair[gone] = -1
                lowest = rank
                if last[gone]:
                    last[i], pair[i] = 1, -1
                else:
                    before[end] = i
                    new = pair[i] = ranks(data[i : after[end]], -1)
                    if new >= 0:
                        queue.push(new, [i])
                        lowest = new
                if not starts[i]:
                    left = before[i]
                    new = pair[left] = ranks(data[left:end], -1)
                    if new >= 0:
                        queue.push(new, [left])
                        lowest = min(lowest, new)
                if lowest < rank:
                    if rest := bucket[k + 1 :]:
                        queue.push(rank, rest)
                    break
        out, i = [], 0
        for e in ends.tolist():
            ids = []
            while i < e:
                j = after[i]
                ids.append(ranks(data[i:j]))
                i = j
            out.append(ids)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Fill chunks and pieces for texts whose ids are not known yet."""
        cut = {c: self.split(c) for c in chunks}
        pieces, ranks = self.pieces, self.ranks.get
        if len(pieces) > KEPT_CHUNKS:
            pieces.clear()
        todo = []
        for piece in {p for c in cut.values() for p in c}.difference(pieces):
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := ranks(raw)) is not None:
                pieces[piece] = struct.pack("<I", whole)
            else:
                todo.append((piece, raw))
        for (piece, _), ids in zip(todo, self.merge([raw for _, raw in todo]), strict=True):
            pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        self.chunks.update((c, b"".join(map(pieces.__getitem__, found))) for c, found in cut.items())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of texts as little-endian 32-bit bytes.

        A text is taken apart before each single space that stands between two other characters: no match of the
        pattern reaches over such a place, so the ids of a chunk do not depend on what surrounds it.
        """
        cut = [taken_apart(x) for x in texts]
        if len(self.chunks) > KEPT_CHUNKS:
            self.chunks.clear()
        known = self.chunks
        self.learn({c for chunks in cut for c in chunks}.difference(known))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for c in {c for chunks in cut for c in chunks if len(c) > LONG_CHUNK}:
            del known[c]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def taken_apart(text: str) -> list[str]:
    parts = ODD_SPACE.search(text) and BETWEEN.split(text) or text.split(" ")
    return [parts[0], *map(" ".__add__, parts[1:])]


def encode_decode(docs: DataFrame, ranks: str, pattern: str, **cols: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (32-bit little-endian bytes): one row a row with an id.

    A null or empty text has no ids; repeated rows are encoded each. One pass without a shuffle; the rank file is
    read by each worker once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("bpe")
        codec = Codec.of(ranks, pattern)
        for batch in blocks(batches):
            ids = codec.encode_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]), pa.array(ids, pa.binary())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
            )

    return id_text(docs, **cols).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
