"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one encoding, hence one last token. Position ``i`` stores it: of the tokens that
end at ``i``, the one that may follow the stored last token before it. Appending extends the table; an edit redoes it
from the edit until the stored tokens agree with the old ones over the longest token's length.

Two tokens may stand side by side if their bytes, merged by rank, never merge across the boundary. That is
seen by undoing the merges of both sides, the latest first, and asking at each step whether the two pieces that
touch would have merged before the step that was undone.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_of

NEVER = 1 << 40
#: Pieces (of 64 characters at most) and token pairs that a Python worker remembers.
REMEMBERED = 400_000
#: Documents that are split into pieces at a time.
STEP = 256
COLUMNS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


class BytePairs:
    """Merge tables of a rank file: tokens by bytes, the two parts of each token, and the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.parts, self.pairs, self.follows = {}, {}, {}, {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                cuts = ((ranks.get(token[:i], NEVER), ranks.get(token[i:], NEVER)) for i in range(1, len(token)))
                split = next((c for c in cuts if max(c) < rank and self._stay_apart(*c)), None)
                if split is None:  # merging never makes it
                    continue
                self.parts[rank] = split
                self.pairs[split] = rank
            self.ranks[token] = rank
        self.longest = max(map(len, self.ranks))
        self.ends = {t[i:]: -1 for t in self.ranks for i in range(len(t))} | self.ranks  # what tokens end with, and the tokens
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> BytePairs:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _stay_apart(self, a: int, b: int) -> bool:
        before, pairs, parts = NEVER, self.pairs, self.parts
        while True:
            if pairs.get((a, b), NEVER) < before:
                return False
            of_a, of_b = parts.get(a), parts.get(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or of_a is not None and a > b:  # of equal ranks the left one merges first
                before, a = a, of_a[1]
            else:
                before, b = b + 1, of_b[0]

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > REMEMBERED:
                self.follows.clear()
            known = self.follows[key] = self._stay_apart(a, b)
        return known

    def extend(self, data: bytes, last: list[int]) -> Iterator[int]:
        """Appends to ``last`` until it has the last token of every prefix of ``data``; yields after each."""
        ends, follows = self.ends, self.follows
        for end in range(len(last) + 1, len(data) + 1):
            for begin in range(end - 1, -1, -1):
                token = ends.get(data[begin:end], NEVER)
                if token == NEVER:  # no token ends like this, nor any longer one
                    raise ValueError("bytes without a token")
                if token >= 0 and (not begin or (ok := follows.get(last[begin - 1] << 20 | token)) or ok is None and self.may_follow(last[begin - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a prefix without encoding")
            yield token

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        found, at, bytes_of = [], len(data), self.bytes_of
        while at:
            found.append(last[at - 1])
            at -= len(bytes_of[found[-1]])
        return found[::-1]

    def encode(self, data: bytes) -> list[int]:
        return Prefixes(self, data).tokens()

    def encode_all(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Encodes sorted pieces, each going on from the prefix that it shares with the one before."""
        before, last = b"", []
        for data in pieces:
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared:]
            for _ in self.extend(data, last):
                pass
            before = data
            yield self.tokens(data, last)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """One piece of text with the last token of each of its prefixes."""

    def __init__(self, pairs: BytePairs, data: bytes = b""):
        self.pairs, self.data, self.last = pairs, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        for _ in self.pairs.extend(self.data, self.last):
            pass

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts ``data`` for the bytes from start to end; returns how many positions were worked out again."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last, agreed = old[:start], 0
        for token in self.pairs.extend(self.data, self.last):
            done = len(self.last)
            agreed = agreed + 1 if done - 1 - shift >= end and old[done - 1 - shift] == token else 0
            if agreed >= self.pairs.longest:
                self.last += old[done - shift:]
                return done - start
        return len(self.last) - start

    def tokens(self) -> list[int]:
        return self.pairs.tokens(self.data, self.last)


def remember(pairs: BytePairs, split: list[list[str]]) -> dict[str, bytes]:
    """The ids (little-endian, 32 bits) of all pieces; those of short pieces stay for the next call."""
    known = pairs.known
    if len(known) > REMEMBERED:
        known.clear()
    new = sorted((x.encode(), x) for x in set().union(*split).difference(known))
    pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    fresh = {text: pack(ids) for (_, text), ids in zip(new, pairs.encode_all([data for data, _ in new]), strict=True)}
    known.update((x, ids) for x, ids in fresh.items() if len(x) <= 64)
    return known if all(len(x) <= 64 for x in fresh) else known | fresh


def encoded(shared, pattern: str, with_ids: bool):
    """Arrow batches (doc_id, text) -> counts and digests of ids and decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, find = shared.value, regex.compile(pattern).findall
        words = [pairs.bytes_of.get(i, b"") for i in range(max(pairs.bytes_of) + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                ids_of, texts = batch.column(0)[at : at + STEP].to_pylist(), batch.column(1)[at : at + STEP].to_pylist()
                split = [find(text) for text in texts]
                known = remember(pairs, split).__getitem__
                out = []
                for doc, pieces in zip(ids_of, split, strict=True):
                    raw = b"".join(map(known, pieces))
                    ids = np.frombuffer(raw, "<u4")
                    decoded = b"".join(map(words.__getitem__, ids.tolist()))
                    out.append((doc, len(ids), sha256(raw).hexdigest(), sha256(decoded).hexdigest(), *([ids.astype(np.int32)] if with_ids else [])))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 4 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], COLUMNS[: 4 + with_ids])

    return run


def tokenized(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    The rank file at ``path`` is read by the driver and sent out once (its size is that of the vocabulary).

    * null or empty text: no tokens, the digests of no bytes; null ids pass through; repeated rows give repeated rows.
    * an empty table gives an empty result; other columns of the input are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(BytePairs.load(path))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(encoded(shared, pattern, with_ids), schema)
