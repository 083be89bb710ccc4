"""Exact deduplication with a heavy-hitter split.

Frequent digests are found by mergeable Misra-Gries summaries, counted exactly, and their winners are
broadcast, so that the copies of a hot text are resolved where they lie; all other digests take an
ordinary shuffle. The broadcast holds at most ``counters`` rows, whatever the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WHITE, packed, text_of
from tickloom.session import materialized

COUNTERS = 1024


def digest(column: str = "text"):
    """SHA-256 of the text after each run of ASCII white space became one space."""
    return F.sha2(F.regexp_replace(text_of(column), WHITE, " "), 256)


def _shrink(counts: Counter, k: int) -> Counter:
    """A Misra-Gries summary of at most ``k`` counters: subtract the (k+1)-th largest from all."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({key: n - cut for key, n in counts.items() if n > cut})


def summaries(k: int):
    """Arrow batches of digests -> one summary per partition, and its row count under a null digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            found = pc.value_counts(batch.column(0))
            counts.update(dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True)))
            counts = _shrink(counts, k)
        keys = [None, *counts]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([rows, *counts.values()], pa.int64())], ["digest", "n"])

    return run


def heavy_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest) that may be in over ``1 / (counters + 1)`` of the rows.

    The summaries undercount a digest by at most rows / (counters + 1) in total, so everything above twice that
    share is found; and as the counters sum to at most the number of rows, at most ``counters`` digests qualify.
    """
    found = rows.select("text_sha256").mapInArrow(summaries(counters), "digest string, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    found = materialized(found, "heavy")
    total = found.filter("digest is null").agg(F.sum("n")).first()[0] or 0
    return found.filter(F.col("digest").isNotNull() & (F.col("n") * F.lit(counters + 1) > F.lit(total))).select(F.col("digest").alias("text_sha256"))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    * null text: equal to the empty text; null id: sorts after every id, so it stays only in a group of null ids.
    * rows that repeat the smallest id of a group: one of them is kept.
    * an empty table gives an empty result; other columns of the input are not looked at.
    """
    rows = materialized(docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("text_sha256")), "digests")
    candidates = F.broadcast(heavy_digests(rows, counters))
    winners = materialized(
        rows.join(candidates, "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "winners")
    placed = rows.join(F.broadcast(winners), "text_sha256", "left")
    heavy = placed.filter("group_size is not null")
    # the rows with the winning id: one for each winner, unless the table repeats rows
    first = F.row_number().over(Window.partitionBy("text_sha256").orderBy("doc_id")) == 1
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    removed = heavy.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", F.lit(False))
    staying = heavy.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumn("kept", first)
    group = Window.partitionBy("text_sha256")
    rest = placed.filter("group_size is null").withColumns({
        "keep_id": F.min("doc_id").over(group), "group_size": F.count("*").over(group),
        "kept": F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())) == 1})
    return removed.select(columns).unionByName(staying.select(columns)).unionByName(rest.select(columns))


def keep_distinct(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns. Whole repeated rows collapse to one."""
    verdict = materialized(exact_dedup(docs, counters), "verdict")
    goes = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    stays = verdict.filter(F.col("kept")).select(F.col("doc_id").alias("_i"), F.col("text_sha256").alias("_s"))
    tagged = docs.select(packed(docs), "doc_id", digest().alias("sha"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))
    kept = tagged.join(goes.hint("shuffle_merge"), same, "left_anti")
    # an id that both stays and goes repeats its row: those few rows are cut to one
    repeated = materialized(goes.join(stays, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sha") == F.col("_s")), "left_semi"), "repeated")
    one = tagged.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "sha"])
    return kept.unionByName(one).select("row.*")
