"""SimHash near-deduplication by a self-join of the binary trie of the fingerprints.

Pairs of trie nodes are walked down together. A pair carries the bits in which its prefixes differ and is given
up when they exceed the budget. The upper levels are walked by Spark: a fingerprint goes to every pair of prefixes
that its own prefix belongs to, a pair with too many fingerprints goes on to its children in the next round. The
lower levels of a pair of bounded size are walked inside a task, on sorted arrays. A task returns, for each of its
fingerprints, the smallest one it is linked with, not the pairs, so groups of near copies stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import packed, text_of
from tickloom.llm.components import components
from tickloom.session import materialized

BITS = 64
BUDGET = 3
#: Fingerprints that a prefix pair of the first round is meant to hold, and how many make the pair split again.
UNIT, MOST = 1 << 16, 1 << 18
STEP_BITS = 4
#: Fingerprint comparisons that a task holds at a time.
CHUNK = 1 << 21


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; no words: 0; fewer words: one shingle of them all."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    shingles = zip(*(found[i:] for i in range(words)), strict=False) if len(found) >= words else [found]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), seed) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])

    return run


class Links:
    """Components of array positions; the smallest position stands for its component."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.of[i], self.of[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if len(i):
                np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(up := self.of[self.of], self.of):
                    self.of = up


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit at ``depth`` turns on between lo and hi, all values there sharing the bits before."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
    first = (values[lo] & ~(bit | (bit - np.uint64(1)))) | bit
    return np.clip(np.searchsorted(values, first), lo, hi)


def _compare(left: np.ndarray, right: np.ndarray, same: bool, nodes: np.ndarray, budget: int, base: int, links: Links) -> None:
    """Compares all fingerprints of the node pairs (a0, a1, b0, b1)."""
    a0, a1, b0, b1 = nodes[:4]
    sizes = (a1 - a0) * (b1 - b0)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for begin, end in _runs(starts):
        n = sizes[begin:end]
        pair = np.repeat(np.arange(begin, end), n)
        at = np.arange(n.sum()) - np.repeat(starts[begin:end] - starts[begin], n)
        width = (b1 - b0)[pair]
        i, j = a0[pair] + at // width, b0[pair] + at % width
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if same:
            near &= i < j
        links.add(i[near], j[near] + base)


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to about CHUNK."""
    begin = 0
    while begin < len(starts) - 1:
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + CHUNK, "right")) - 1)
        yield begin, end
        begin = end


def walk(left: np.ndarray, right: np.ndarray | None, depth: int, differing: int, budget: int = BUDGET) -> np.ndarray:
    """Components of two sorted arrays whose values share ``depth`` bits each, the shared parts differing in ``differing``;
    or of one array with itself. Returns, for left then right, the position of the smallest member."""
    same = right is None
    right, base = (left, 0) if same else (right, len(left))
    links = Links(len(left) if same else len(left) + len(right))
    open_ = [(depth, np.array([[0], [len(left)], [0], [len(right)], [differing]]))]
    while open_:
        depth, nodes = open_.pop()
        done = ((nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= 64) | (depth == BITS)
        if done.any():
            _compare(left, right, same, nodes[:, done], budget, base, links)
            nodes = nodes[:, ~done]
        if not nodes.shape[1]:
            continue
        a0, a1, b0, b1, d = nodes
        ma, mb = _split(left, a0, a1, depth), _split(right, b0, b1, depth)
        own = same & (a0 == b0) & (a1 == b1)
        children = np.concatenate([
            np.stack([a0, ma, b0, mb, d]), np.stack([ma, a1, mb, b1, d]), np.stack([a0, ma, mb, b1, d + 1]),
            np.stack([ma, a1, b0, mb, d + 1])[:, ~own]], axis=1)
        children = children[:, (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)]
        # deeper parts first, in pieces, so that few node pairs wait
        open_ += [(depth + 1, children[:, at : at + CHUNK // 16]) for at in range(0, children.shape[1], CHUNK // 16)]
    return links.of


def _linked(budget: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp, side = rows.fp.to_numpy(np.int64).view(np.uint64), rows.side.to_numpy()
        left, right = np.sort(fp[side == 0]), np.sort(fp[side == 1])
        same = rows.low.iloc[0] == rows.high.iloc[0]
        if same or len(left) and len(right):
            nodes = left if same else np.concatenate([left, right])
            roots = nodes[walk(left, None if same else right, int(rows.depth.iloc[0]), int(rows.differing.iloc[0]), budget)]
            moved = nodes != roots
            return pd.DataFrame({"u": nodes[moved].view(np.int64), "v": roots[moved].view(np.int64)})
        return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})

    return run


def _masks(bits: int, budget: int) -> list[int]:
    return [sum(1 << b for b in chosen) for n in range(min(bits, budget) + 1) for chosen in combinations(range(bits), n)]


def node_pairs(fps: DataFrame, bits: int, budget: int) -> DataFrame:
    """(fp, low, high, side, differing, depth): each fingerprint in every pair of ``bits``-bit prefixes it belongs to."""
    prefix = F.lit(0).cast("long") if not bits else F.shiftrightunsigned("fp", BITS - bits)
    met = fps.select("fp", prefix.alias("own"), F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(bits, budget)])).alias("mask"))
    other = F.col("own").bitwiseXOR(F.col("mask"))
    return met.select("fp", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"), (F.col("own") > other).cast("int").alias("side"),
                      F.bit_count("mask").cast("int").alias("differing"), F.lit(bits).alias("depth"))


def children_of(pairs: DataFrame, bits: int, budget: int) -> DataFrame:
    """The rows of node pairs dealt to the pairs of their children ``bits`` levels down."""
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(bits, budget)])
    depth = F.col("depth") + bits
    down = F.expr(f"shiftrightunsigned(fp, {BITS} - depth - {bits}) & {2**bits - 1}L")
    met = pairs.withColumn("own", down).withColumn("mask", F.explode(masks))
    met = met.filter(F.col("differing") + F.bit_count("mask") <= budget)
    own = F.shiftleft(F.when(F.col("side") == 0, F.col("low")).otherwise(F.col("high")), bits).bitwiseOR(F.col("own"))
    other = F.shiftleft(F.when(F.col("side") == 0, F.col("high")).otherwise(F.col("low")), bits).bitwiseOR(F.col("own").bitwiseXOR(F.col("mask")))
    return met.select("fp", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), (own > other).cast("int").alias("side"),
                      (F.col("differing") + F.bit_count("mask")).cast("int").alias("differing"), depth.cast("int").alias("depth"))


def linked(fps: DataFrame, budget: int = BUDGET, unit: int = UNIT, most: int = MOST) -> DataFrame:
    """(u, v): enough links between fingerprints (column fp, each once) to connect all that differ in ``budget`` bits."""
    bits = min(24, max(0, (fps.count() // unit).bit_length()))
    pairs, found = node_pairs(fps, bits, budget), None
    while True:
        key = ["depth", "low", "high"]
        sizes = materialized(pairs.groupBy(key).agg(F.count("*").alias("n"), F.sum("side").alias("right")).filter("n > 1 AND (low = high OR right BETWEEN 1 AND n - 1)"), "sizes")
        split = F.col("n") > most if bits + STEP_BITS <= BITS else F.lit(False)
        here = pairs.join(sizes.filter(~split).select(key), key, "left_semi").groupBy(key).applyInPandas(_linked(budget), "u long, v long")
        found = here if found is None else found.unionByName(here)
        large = sizes.filter(split)
        if large.isEmpty():
            return found
        pairs = materialized(children_of(pairs.join(large.select(key), key, "left_semi"), STEP_BITS, budget), "children")
        bits += STEP_BITS


def labelled(docs: DataFrame, budget: int, words: int, unit: int, most: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) of all rows, and (_fp, least) for each fingerprint: the smallest (none, doc_id, text_hash)
    of its component, ids before null."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = materialized(rows.mapInArrow(_fingerprints(words), "doc_id long, fp long, text_hash long"), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    fps = materialized(rows.groupBy("fp").agg(F.min(own).alias("least")), "distinct")
    roots = components(linked(fps.select("fp"), budget, unit, most))
    of = materialized(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    first = of.groupBy("root").agg(F.min("least").alias("first"))
    return rows, materialized(of.join(first, "root").select(F.col("fp").alias("_fp"), F.col("first").alias("least")), "labels")


def simhash(docs: DataFrame, budget: int = BUDGET, words: int = 3, unit: int = UNIT, most: int = MOST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable by links).

    * null or empty text, or white space only: fingerprint zero, linked like any other.
    * null ids take part; a component of null ids alone has a null component_id; repeated rows give repeated rows.
    * an empty table gives an empty result; other columns of the input are not looked at.
    """
    rows, labels = labelled(docs, budget, words, unit, most, text, doc_id)
    return rows.join(labels, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id, nulls last, then of the smallest
    hash of its text. Rows that repeat its id and text stay with it."""
    rows, labels = labelled(docs, budget, 3, UNIT, MOST, "text", "doc_id")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    goes = rows.join(labels, F.col("fp") == F.col("_fp")).filter(~own.eqNullSafe(F.col("least"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    met = docs.select(packed(docs), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return met.join(materialized(goes, "goes").hint("shuffle_merge"), same, "left_anti").select("row.*")
