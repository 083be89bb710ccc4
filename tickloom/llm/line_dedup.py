"""Line deduplication by a sharded minimal perfect hash.

Every line long enough gets a 128-bit key hash. The distinct hashes are dealt over shards of bounded size; each
shard gets a minimal perfect hash (levels of bits, a key keeping the first bit that it alone sets) whose slots index
packed fingerprints, document counts, and for frequent lines the document that keeps them. The probes of the
documents meet one row per shard, not one row per line, and are answered by bit arithmetic on its arrays. As every line
is indexed, a probe always lands in its own slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WHITE_BYTES, rotl64, text_of
from tickloom.session import materialized

SHARD_KEYS = 32768
LEVELS = 8
SHARD_SCHEMA = """shard long, sizes array<int>, starts array<long>, words array<long>, ranks array<int>, rest array<string>, fingerprints array<long>,
  counts array<long>, hot array<long>, hot_ranks array<int>, keepers array<long>"""


def line_key(line: bytes, least: int) -> bytes | None:
    """The key of a line, or None if it has under ``least`` code points."""
    key = line.strip(WHITE_BYTES).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def line_hashes(least: int):
    """Arrow batches (doc_id, text) -> (doc_id, h1, h2), each different key of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {xxhash.xxh3_128_digest(k) for line in text.encode("utf-8", "replace").split(b"\n") if (k := line_key(line, least)) is not None}
                ids += [doc] * len(keys)
                found += keys
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "h1", "h2"])

    return run


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits each, 64 // bits to a word."""
    per = 64 // bits
    padded = np.zeros(-(-len(values) // per) * per, np.uint64)
    padded[: len(values)] = values.astype(np.uint64)
    shifted = padded.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(bits))
    return np.bitwise_or.reduce(shifted, axis=1) if len(shifted) else np.zeros(0, np.uint64)


def _bitmap(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 bits, and the number of ones before each word."""
    words = _pack(bits, 1)
    ones = np.bitwise_count(words).astype(np.int64)
    return words, np.cumsum(ones) - ones


def build_shard(rows: pd.DataFrame, frequent: int) -> pd.DataFrame:
    """One row of arrays for the keys (h1, h2, n, keep) of one shard."""
    h1, h2 = rows.h1.to_numpy(np.int64).view(np.uint64), rows.h2.to_numpy(np.int64).view(np.uint64)
    slot = np.full(len(rows), -1, np.int64)
    left, sizes, all_bits, placed = np.arange(len(rows)), [], [], 0
    for level in range(LEVELS):
        if not len(left):
            break
        m = max(64, -(-2 * len(left) // 64) * 64)
        at = ((h1[left] ^ rotl64(h2[left], 5 * level)) >> np.uint64(1)) % np.uint64(m)
        bits = np.bincount(at.astype(np.int64), minlength=m) == 1
        alone = bits[at]
        rank = np.cumsum(bits) - bits
        slot[left[alone]] = placed + rank[at[alone]]
        placed += int(bits.sum())
        left = left[~alone]
        sizes.append(m)
        all_bits.append(bits)
    slot[left] = placed + np.arange(len(left))
    words, ranks = _bitmap(np.concatenate(all_bits))
    order = np.argsort(slot)
    n = rows.n.to_numpy(np.int64)[order]
    keep = rows.keep.astype("object").where(rows.keep.notna(), None).to_numpy()[order]
    hot, hot_ranks = _bitmap(n >= frequent)
    signed = lambda x: x.view(np.int64).tolist()
    return pd.DataFrame({
        "shard": [int(rows.shard.iloc[0])], "sizes": [sizes], "starts": [(np.cumsum(sizes) - sizes).tolist()], "words": [signed(words)], "ranks": [ranks.tolist()],
        "rest": [[f"{a} {b}" for a, b in zip(signed(h1[left]), signed(h2[left]), strict=True)]],
        "fingerprints": [signed(_pack(h2[order] & np.uint64(0xFFFF), 16))], "counts": [signed(_pack(n, 32))],
        "hot": [signed(hot)], "hot_ranks": [hot_ranks.tolist()], "keepers": [[None if k is None else int(k) for k in keep[n >= frequent]]]})


def _bit(words: str, at: str) -> str:
    return f"(shiftrightunsigned(get({words}, cast({at} div 64 as int)), cast({at} % 64 as int)) & 1L)"


def _below(words: str, ranks: str, at: str) -> str:
    """Ones before the position: those of earlier words, and of the word's lower bits."""
    word, bit = f"cast({at} div 64 as int)", f"cast({at} % 64 as int)"
    lower = f"if({bit} = 0, 0L, shiftrightunsigned(-1L, 64 - {bit}))"
    return f"cast({ranks}[{word}] + bit_count({words}[{word}] & {lower}) as long)"


def bit_of() -> Column:
    """The bit that (h1, h2) owns: that of the first level in which it is set; null if it is in the list of the rest."""
    cases = []
    for level in range(LEVELS):
        by = 5 * level % 64
        turned = "h2" if not by else f"(shiftleft(h2, {by}) | shiftrightunsigned(h2, {64 - by}))"
        at = f"(get(starts, {level}) + shiftrightunsigned(h1 ^ {turned}, 1) % get(sizes, {level}))"
        cases.append(f"WHEN {_bit('words', at)} = 1 THEN {at}")
    return F.expr(f"CASE {' '.join(cases)} END")


def slot_of() -> Column:
    """The slot of that bit, or of the place in the list of the rest."""
    ones = "(ranks[size(ranks) - 1] + bit_count(words[size(words) - 1]))"
    return F.expr(f"if(at IS NULL, {ones} + array_position(rest, concat(h1, ' ', h2)) - 1, {_below('words', 'ranks', 'at')})")


def build_index(lines: DataFrame, frequent: int, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row per shard, and the number of shards, from (doc_id, h1, h2). Shards have about ``shard_keys`` keys each."""
    keys = materialized(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")), "keys")
    shards = keys.count() // shard_keys + 1
    keys = keys.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return materialized(keys.groupBy("shard").applyInPandas(lambda rows: build_shard(rows, frequent), SHARD_SCHEMA), "shards"), shards


def dropped_lines(lines: DataFrame, frequent: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, h1, h2) of the lines that the document loses."""
    index, shards = build_index(lines, frequent, shard_keys)
    met = lines.withColumn("shard", F.pmod("h1", F.lit(shards))).join(index, "shard")
    # values that are used again pass through a generator, so that they are worked out once
    met = met.withColumn("at", F.explode(F.array(bit_of()))).withColumn("slot", F.explode(F.array(slot_of())))
    mark = "shiftrightunsigned(fingerprints[cast(slot div 4 as int)], 16 * cast(slot % 4 as int)) & 65535L"
    met = met.filter(f"({mark}) = (h2 & 65535L) AND (shiftrightunsigned(counts[cast(slot div 2 as int)], 32 * cast(slot % 2 as int)) & 4294967295L) >= {frequent}")
    keeper = F.expr(f"keepers[cast({_below('hot', 'hot_ranks', 'slot')} as int)]")
    return met.filter(~keeper.eqNullSafe(F.col("doc_id"))).select("doc_id", "h1", "h2")


def rewritten(least: int):
    """Arrow batches (doc_id, text, drop) -> per document the line counts, the kept text and its SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, drop in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.encode("utf-8", "replace").split(b"\n")
                kept = lines
                if drop:
                    gone = {bytes.fromhex(x[:16])[::-1] + bytes.fromhex(x[16:])[::-1] for x in drop}
                    kept = [x for x in lines if (k := line_key(x, least)) is None or xxhash.xxh3_128_digest(k) not in gone]
                joined = b"\n".join(kept)
                out.append((doc, len(lines), len(lines) - len(kept), sha256(joined).hexdigest(), joined.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    return run


def line_dedup(docs: DataFrame, least: int = 40, frequent: int = 5, shard_keys: int = SHARD_KEYS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256, kept_text.

    Lines whose key has ``least`` code points and is in ``frequent`` documents go, except from the document with the
    largest id that holds the key.

    * null or empty text: one empty line. Rows are documents: repeated rows count as several, and as one keeper.
    * null ids sort before all others; a line held only by rows without id stays in them all.
    * an empty table gives an empty result; other columns of the input are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    lines = materialized(rows.mapInArrow(line_hashes(least), "doc_id long, h1 long, h2 long"), "lines")
    key = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("h1", "h2")])
    drops = dropped_lines(lines, frequent, shard_keys).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(key).alias("drop"))
    # texts are dealt out at every size, so that the plan of a small run tells what a large one costs
    met = rows.join(materialized(drops, "drops").hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "drop")
    return met.mapInArrow(rewritten(least), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
