"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes by rotations learned on a bounded sample (iterative quantisation: rotate, take signs,
turn the rotation towards them). A code is cut into substrings, each with an index of its values. A code within R
bits of the query has, in some substring, at most R // m differing bits (one less beyond the first R % m + 1), so
probing those values retrieves every code within R. The retrieved codes are ranked by the distance of the vectors.

Equal vectors are indexed once, with the k + 1 smallest of their different ids: no more can be among k neighbours. A list
is cut where it has k + 1 different ids, and takes an id k times at most, so that k stay when a query's own id is taken out. Queries
are sent out in blocks of bounded size, each against all rows; a query that found too few goes again with R = all bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialized

SAMPLE = 8192
SAMPLE_QUERIES = 256
ROTATIONS = 2
#: Share of the sample's true neighbours that the learned radius must hold.
WANTED = 0.985
QUERY_BLOCK = 8192
INDEX_BLOCK = 8192
SUB_BITS = 8


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of bytes, one for each substring."""
        return np.packbits((vectors - self.mean) @ self.rotation > 0, axis=1)


def learn(sample: np.ndarray, k: int, rotations: int = ROTATIONS, wanted: float = WANTED, rounds: int = 30, seed: int = 7) -> Codes:
    mean, rng, found = sample.mean(axis=0), np.random.default_rng(seed), []
    centred = sample - mean
    for _ in range(rotations):
        turn = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(centred.T @ np.sign(centred @ turn))
            turn = u @ v
        found.append(turn)
    codes = Codes(mean, np.concatenate(found, axis=1), 0)
    bits, far = codes.of(sample), []
    for i in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
        distance = np.square(sample - sample[i]).sum(axis=1)
        distance[i] = np.inf
        near = np.argsort(distance, kind="stable")[: min(k, len(sample) - 1)]
        far.append(np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1))
    far = np.concatenate(far) if far else np.zeros(0)
    codes.radius = int(np.ceil(np.quantile(far, wanted))) if len(far) else bits.shape[1] * SUB_BITS
    return codes


class Block:
    """Substring indexes over some rows: for each substring the rows sorted by its value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes, subs = codes, codes.shape[1]
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(subs)]
        self.begins = [np.searchsorted(codes[self.rows[j], j], np.arange((1 << SUB_BITS) + 1)) for j in range(subs)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most ``radius`` bits."""
        subs, seen = len(self.rows), np.zeros(len(self.codes), bool)
        for j in range(subs):
            most = radius // subs - (j > radius % subs)
            for value in (PROBES[most] ^ code[j]).tolist() if most >= 0 else ():
                seen[self.rows[j][self.begins[j][value] : self.begins[j][value + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


_ONES = np.bitwise_count(np.arange(1 << SUB_BITS, dtype=np.uint8))
#: Values of a substring with at most so many bits.
PROBES = [np.flatnonzero(n >= _ONES).astype(np.uint8) for n in range(SUB_BITS + 1)] + [np.arange(1 << SUB_BITS).astype(np.uint8)] * 64


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def shortened(order: list, first: Callable[[object], int], k: int) -> list:
    """The beginning of a list of equal-vector classes by nearness that holds k + 1 different first ids, at most k times each.

    Without the classes that start with one id, there are k others: enough for a query of that id."""
    seen: Counter = Counter()
    out = []
    for entry in order:
        own = first(entry)
        if len(seen) == k + 1:
            break
        seen[own] += 1
        if seen[own] <= k:
            out.append(entry)
    return out


def searched(shared, k: int):
    """Arrow batches (ids, vector, code) -> (q, distance, ids): the nearest rows of the partition for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, vectors, codes, radius = shared.value
        best: list = [[] for _ in numbers]
        for batch in batches:
            for at in range(0, batch.num_rows, INDEX_BLOCK):
                part = batch.slice(at, INDEX_BLOCK)
                own = _vectors(part.column(1))
                block = Block(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(own), -1))
                first = np.asarray(part.column(0).flatten())[np.asarray(part.column(0).offsets)[:-1] - part.column(0).offsets[0].as_py()]
                for q, code in enumerate(codes):
                    rows = block.within(code, radius)
                    distance = np.sqrt(np.square(own[rows] - vectors[q]).sum(axis=1))
                    nearest = shortened(np.lexsort((first[rows], distance)), lambda i, own=first[rows]: own[i], k)
                    best[q] += [(distance[i], first[rows[i]], part.column(0)[int(rows[i])].as_py()) for i in nearest]
                    best[q] = shortened(sorted(best[q]), lambda entry: entry[1], k)
        for at in range(0, len(best), 1024):
            out = [(int(n), float(d), ids) for n, found in zip(numbers[at : at + 1024], best[at : at + 1024], strict=True) for d, _, ids in found]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.list_(pa.int64())), strict=True)], ["q", "distance", "ids"])

    return run


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part: finite, not zero, with an id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found; ``is_query`` picks queries by vec_id.

    * null, zero and non-finite vectors and rows without id take no part; vectors are compared with those of their length.
    * ties go to the smaller id; fewer than k candidates are all returned; rows that repeat an id are candidates of
      their own, but never for a query of that id. An empty table gives an empty result; other columns are not looked at.
    """
    rows = materialized(usable(vectors, vec_id, embedding), "vectors")
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        own = rows if len(lengths) == 1 else materialized(rows.filter(F.size("v") == n), "vectors")
        found = _nearest(own, is_query, k, sample, query_block)
        out = found if n == lengths[0] else out.unionByName(found)
    return out


def _nearest(rows: DataFrame, is_query: Column, k: int, sample: int, query_block: int) -> DataFrame:
    """The same over vectors (vec_id, v) of one length."""
    spark, total = rows.sparkSession, rows.count()
    taken = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, total)))).limit(2 * sample)
    taken = np.array([r.v for r in taken.select("v").collect()], np.float64)
    if len(taken) < 2:
        taken = np.array([r.v for r in rows.limit(sample).collect()], np.float64)
    codes = learn(taken, k)
    coder = spark.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = coder.value.of(_vectors(batch.column(1))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in found], pa.binary())], ["ids", "v", "code"])

    few = rows.withColumns({"n": F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id")), "copy": F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))})
    few = few.filter((F.col("n") <= k + 1) & (F.col("copy") <= k))
    index = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "v")
    index = materialized(index.mapInArrow(encode, "ids array<long>, v array<double>, code binary"), "index")
    asked = rows.filter(is_query)
    blocks = asked.count() // query_block + 1
    numbered = asked.select("v").distinct().withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks))).withColumn("q", F.monotonically_increasing_id())
    numbered = materialized(numbered, "queries")
    ids, found = rows.select("vec_id").distinct().limit(k + 1).count(), []
    for b in range(blocks):
        todo, radius = numbered.filter(F.col("block") == b).select("q", "v"), codes.radius
        while True:  # at most twice: the second time for what found too few, with all bits
            block = sorted((r.q, r.v) for r in todo.collect())
            if not block:
                break
            own = np.array([v for _, v in block], np.float64)
            shared = spark.sparkContext.broadcast((np.array([q for q, _ in block]), own, codes.of(own), radius))
            part = index.mapInArrow(searched(shared, k), "q long, distance double, ids array<long>")
            each = part.select("q", "distance", F.explode("ids").alias("id"))
            each = each.withColumn("copy", F.row_number().over(Window.partitionBy("q", "id").orderBy("distance"))).filter(F.col("copy") <= k)
            different = F.sum((F.col("copy") == 1).cast("int")).over(Window.partitionBy("q").orderBy("distance", "id", "copy"))
            lists = each.withColumn("n", different).filter(F.col("n") <= k + 1).groupBy("q").agg(F.max("n").alias("ids"), F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
            lists = materialized(lists, "near")
            enough = lists.filter(F.col("ids") >= ids) if radius < codes.rotation.shape[1] else lists
            found.append(enough)
            if enough is lists:
                break
            todo, radius = todo.join(enough, "q", "left_anti"), codes.rotation.shape[1]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = found[0]
    for more in found[1:]:
        lists = lists.unionByName(more)
    of = asked.join(numbered, "v").select("vec_id", "q").join(lists, "q").withColumnRenamed("vec_id", "query_id")
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = of.select("query_id", F.posexplode(near).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.distance").alias("score"))
