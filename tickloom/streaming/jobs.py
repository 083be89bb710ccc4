"""Structured Streaming forms of the incremental steps.

Every job runs with ``availableNow`` over a file source, keeps its checkpoint in shared storage and
writes to a table, so a restart continues where the last committed batch ended.
"""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.books import signed_qty
from tickloom.session import scratch_path


def file_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 8) -> DataFrame:
    """New files of a folder as a stream; the schema comes from the files already landed."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def event_stream(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """The events table with its time as a watermarked timestamp."""
    rows = file_stream(spark, folder, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Drain the stream into a parquet table and return it."""
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/_chk").option("path", f"{root}/data").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def run_batches(stream: DataFrame, label: str, step: Callable[[DataFrame, int, str], None], mode: str = "append", watch: list | None = None) -> str:
    """Drain the stream through ``step(batch, id, root)``; steps must be idempotent per batch id. The progress of its last
    batches, with the rows in its state, is added to ``watch``."""
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_chk").foreachBatch(lambda df, i: step(df, i, f"{root}/data")).trigger(availableNow=True).start()
    q.awaitTermination()
    if watch is not None:
        watch += q.recentProgress
    return f"{root}/data"


def write_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """One partition per batch, overwritten when the batch is replayed."""
    df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def settled_bars(events: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Daily bars that appear only once the watermark has passed the end of their day."""
    w = F.window("ts", "1 day")
    return events.groupBy(w, key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
                                      F.max_by(value, "ts").alias("close")).select(F.to_date("window.start").alias("date"), key, "n", "low", "high", "close")


def rolling_bars(events: DataFrame, length: str, slide: str | None = None, start: str | None = None, key: str = "event_type", value: str = "value") -> DataFrame:
    """Tumbling or sliding bars: (window start, end, key, n, close)."""
    w = F.window("ts", length, slide, start) if slide or start else F.window("ts", length)
    return events.groupBy(w, key).agg(F.count("*").alias("n"), F.max_by(value, "ts").alias("close")).select(
        F.to_date("window.start").alias("from_date"), F.to_date("window.end").alias("to_date"), key, "n", "close")


def first_captures(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark; later ones are dropped."""
    return events.dropDuplicatesWithinWatermark(keys)


def running_positions(trades: DataFrame) -> DataFrame:
    """Shares per (book, symbol), in update mode; state is one number per position."""
    return trades.groupBy("book", "symbol").agg(F.sum(signed_qty(F.col("side"), F.col("qty"))).alias("position"))


def latest_state(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key among the batches of an update-mode table."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


CHANGES = "k string, ts timestamp, v string, sign int"
OPEN = "settled boolean, last string, ts array<timestamp>, v array<string>"


def _flags(values: list, settled: bool, last: str | None) -> list[bool]:
    """Which of consecutive values differ from the one before; the first of a key counts as a change."""
    before = [last if settled else NEVER, *values[:-1]] if values else []
    return [a is NEVER or a != b for a, b in zip(before, values, strict=True)]


NEVER = object()


def _order(row: tuple) -> tuple:
    ts, v = row
    return ts, v is not None, v or ""


def _fold_changes(watermarked: bool):
    """One key's new rows -> changes that its history gained (sign 1) and lost (sign -1).

    The state of a key is its rows from the watermark on, among which late rows may still fall, and the last value
    before them. Rows that the watermark has passed leave the state."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settled, last, at, values = state.get if state.exists else (False, None, [], [])
        held = list(zip(at, values, strict=True))
        rows = sorted([*held, *((t.to_pydatetime(), None if pd.isna(v) else v) for b in batches for t, v in zip(b["ts"], b["v"], strict=True))], key=_order)
        log = Counter()
        for sign, own in ((-1, held), (1, rows)):
            for row, changed in zip(own, _flags([v for _, v in own], settled, last), strict=True):
                log[row] += sign * changed
        mark = dt.datetime.fromtimestamp(state.getCurrentWatermarkMs() / 1000, dt.UTC).replace(tzinfo=None) if watermarked else None
        if mark is not None:
            passed = [v for t, v in rows if t < mark]
            settled, last, rows = (True, passed[-1], rows[len(passed):]) if passed else (settled, last, rows)
        state.update((settled, last, [t for t, _ in rows], [v for _, v in rows]))
        if mark is not None and rows:  # to be let go once the watermark is past the last of them
            state.setTimeoutTimestamp(int(rows[-1][0].replace(tzinfo=dt.UTC).timestamp() * 1000) + 1)
        log = {row: n for row, n in log.items() if n}
        yield pd.DataFrame({"k": [key[0]] * len(log), "ts": pd.Series([t for t, _ in log], dtype="datetime64[ns]"), "v": pd.Series([v for _, v in log], dtype=object), "sign": list(log.values())})

    return fold


def changes_only(events: DataFrame, key: str, value: str, label: str = "changes", watch: list | None = None) -> DataFrame:
    """(k, ts, v): rows whose value differs from the key's previous one, whatever the order of arrival.

    A stateful stream: a batch costs what its keys have open, not what has landed. A late row moves the changes around it
    as long as the watermark of ``ts`` has not passed it; later ones are dropped. Without a watermark all rows stay open.
    Rows of a key at one time stand by value, nulls first; a null differs from every value, and not from a null.
    """
    rows = events.select(F.col(key).cast("string").alias("k"), "ts", F.col(value).cast("string").alias("v"))
    watermarked = "spark.watermarkDelayMs" in rows.schema["ts"].metadata
    timeout = GroupStateTimeout.EventTimeTimeout if watermarked else GroupStateTimeout.NoTimeout
    log = rows.groupBy("k").applyInPandasWithState(_fold_changes(watermarked), CHANGES, OPEN, "append", timeout)
    path = run_batches(log, label, write_batch, watch=watch)
    found = rows.sparkSession.read.schema(f"{CHANGES}, batch int").parquet(path)
    return found.groupBy("k", "ts", "v").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")


SLOTS = 64


def slot(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def by_slot(df: DataFrame, key: str, label: str) -> DataFrame:
    """The table written in SLOTS partitions by a hash of its key, so that a batch reads those of its own keys."""
    path = scratch_path(df.sparkSession, label)
    dealt = df.withColumn("slot", slot(key))
    dealt.repartition("slot").write.partitionBy("slot").parquet(path)
    return df.sparkSession.read.schema(dealt.schema).parquet(path)


def restate_marks(marks: DataFrame, actions: DataFrame, batch_id: int, path: str) -> None:
    """Fold a batch of late actions (book, ex_date, cash) into the stored effects and write the marks of the books it
    touched anew, from the original marks and all effects so far. Replaying a batch changes nothing.

    Effects are stored by a hash of the book, and so are marks that come from ``by_slot``: only the slots of the books of
    the batch are read."""
    spark = marks.sparkSession
    new = actions.groupBy("book", "ex_date").agg(F.sum("cash").alias("cash")).withColumn("slot", slot("book"))
    new.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(f"{path}/effects")
    slots = [r["slot"] for r in actions.select(slot("book").alias("slot")).distinct().collect()]  # at most SLOTS
    touched = actions.select("book").distinct()
    marks = (marks if "slot" in marks.columns else marks.withColumn("slot", slot("book"))).where(F.col("slot").isin(slots))
    effects = spark.read.parquet(f"{path}/effects").where(F.col("slot").isin(slots) & (F.col("batch") <= batch_id)).join(touched, "book", "left_semi")
    days = effects.groupBy("book", F.col("ex_date").alias("date")).agg(F.sum("cash").alias("cash"))
    # marks and effects of a book in one order by date: a running sum instead of a join of every mark with every effect
    both = days.select("book", "date", "cash", F.lit(None).cast(marks.schema["nav"].dataType).alias("nav"), F.lit(False).alias("mark")).unionByName(
        marks.join(touched, "book", "left_semi").select("book", "date", F.lit(0).cast(days.schema["cash"].dataType).alias("cash"), "nav", F.lit(True).alias("mark")))
    upto = Window.partitionBy("book").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(~F.col("mark"), F.col("date"))).over(Window.partitionBy("book"))
    fixed = both.select("book", "date", "mark", (F.col("nav") + F.sum("cash").over(upto)).alias("nav"), first.alias("_f"))
    write_batch(fixed.where("mark AND date >= _f").select("book", "date", "nav"), batch_id, f"{path}/marks")


def restated(spark: SparkSession, path: str) -> DataFrame:
    """The marks in force: the newest version of each."""
    return latest_state(spark, f"{path}/marks", ["book", "date"])
