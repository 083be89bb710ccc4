"""Snapshot-dated, period and curated tables on shared storage, and their incremental writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import calendar as cal
from tickloom.session import materialized, scratch_path


def write_snapshot(df: DataFrame, root: str) -> None:
    """Rows with ``key`` and ``snapshot`` columns; only the partitions present in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key", "snapshot").parquet(root)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def latest_snapshot(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(key, snapshot): each key's newest vintage, on or before a day when one is given."""
    seen = rows if as_of is None else rows.where(F.col("snapshot") <= as_of)
    return seen.groupBy("key").agg(F.max("snapshot").alias("snapshot"))


def read_vintage(rows: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The rows of each key's newest vintage; keys with none that old are absent."""
    return rows.join(latest_snapshot(rows, as_of), ["key", "snapshot"])


def write_partition(df: DataFrame, root: str, by: list[str]) -> None:
    """Replace just the period partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


def read_partitions(spark: SparkSession, root: str, key: str | None = None, part: str | None = None) -> DataFrame:
    rows = spark.read.parquet(root)
    if key is not None:
        rows = rows.where(F.col("key") == key)
    return rows if part is None else rows.where(F.col("part") == part)


def available_keys(rows: DataFrame) -> DataFrame:
    return rows.select("key").distinct()


def scan_years(spark: SparkSession, root: str, start=None, end=None, columns: list[str] | None = None) -> DataFrame:
    """Date range over a year-partitioned table; the year bounds prune partitions before any file is opened."""
    rows = spark.read.parquet(root)
    if start is not None:
        rows = rows.where((F.col("year") >= F.year(F.lit(start).cast("date"))) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        rows = rows.where((F.col("year") <= F.year(F.lit(end).cast("date"))) & (F.col("date") <= F.lit(end).cast("date")))
    return rows.select(*columns) if columns else rows


def missing_days(stored: DataFrame, holidays: DataFrame, bounds: DataFrame) -> DataFrame:
    """Weekdays inside the bounds that are neither stored nor known holidays."""
    days = cal.business_days(bounds)
    return days.join(stored.select("date").distinct(), "date", "left_anti").join(holidays.select("date").distinct(), "date", "left_anti")


def upsert_years(root: str, incoming: DataFrame, holidays: DataFrame, bounds: DataFrame) -> DataFrame:
    """Merge incoming days into a table of years and return (year, days): the days that each rewritten year gained.

    Only weekdays inside the bounds that are neither stored nor holidays are taken, and only the years that gain a day are
    written; the files of the others stay as they are. Run again, nothing is left to add and nothing is written.
    """
    spark = incoming.sparkSession
    stored = spark.read.parquet(root)
    todo = missing_days(stored, holidays, bounds)
    new = materialized(incoming.join(todo, "date", "left_semi").withColumn("year", F.year("date")), "incoming")
    gained = materialized(new.groupBy("year").agg(F.count_distinct("date").alias("days")), "gained")
    years = [r["year"] for r in gained.select("year").collect()]  # one a year
    if years:
        kept = stored.where(F.col("year").isin(years)).select(*incoming.columns)
        write_years(materialized(kept.unionByName(new.drop("year")), "merged"), root)
    return gained


def write_years(df: DataFrame, root: str) -> None:
    """zstd parquet per year, clustered by date, symbol and series inside each file."""
    out = df.withColumn("year", F.year("date")).repartition("year", F.month("date")).sortWithinPartitions("date", "symbol", "series")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year").parquet(root)


def write_csv_by_year(df: DataFrame, root: str, date: str = "date") -> None:
    """One CSV folder per year; years that no longer occur are removed."""
    out = df.withColumn("year", F.year(date))
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").option("header", True).option("dateFormat", "yyyy-MM-dd").partitionBy("year").csv(root)


def read_csv_by_year(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(root).drop("year")


def splice(current: DataFrame, fetched: DataFrame, tol: float = 0.01, by: str = "name", value: str = "tri") -> tuple[DataFrame, DataFrame]:
    """(rows to append, refused series): the last stored day must be in the fetch and agree within ``tol``."""
    last = current.groupBy(by).agg(F.max("date").alias("_last"), F.max_by(value, "date").alias("_v"))
    rows = fetched.join(last, by)
    at = F.max(F.when(F.col("date") == F.col("_last"), F.col(value)))
    test = rows.groupBy(by, "_last", "_v").agg(at.alias("_o"))
    fine = F.col("_o").isNotNull() & (F.abs(F.col("_o") - F.col("_v")) <= tol)
    good = test.where(fine).select(by)
    refused = test.where(~fine).select(by, F.when(F.col("_o").isNull(), "no overlap day").otherwise("overlap differs").alias("reason"))
    add = rows.join(good, by, "left_semi").where(F.col("date") > F.col("_last")).select(*fetched.columns)
    return add, refused


def refresh_window(cache: DataFrame, fresh: DataFrame, answered: DataFrame, start: Column, end: Column) -> DataFrame:
    """Answered symbols replace their cached rows inside the window; one row per (symbol, ex_date, kind)."""
    old = cache.join(answered.select("symbol", F.lit(True).alias("_a")).distinct(), "symbol", "left")
    kept = old.where(~(F.coalesce("_a", F.lit(False)) & F.col("ex_date").between(start, end))).select(*cache.columns, F.lit(0).alias("_o"))
    both = kept.unionByName(fresh.select(*cache.columns, F.lit(1).alias("_o")))
    rest = [c for c in cache.columns if c not in ("symbol", "ex_date", "kind")]
    one = both.groupBy("symbol", "ex_date", "kind").agg(F.min_by(F.struct(*rest), F.struct("_o", *rest)).alias("_r"))
    return one.select("symbol", "ex_date", "kind", *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*cache.columns)


def months_to_scan(bounds: DataFrame, done: DataFrame) -> DataFrame:
    """Months from ``start`` to ``end`` not scanned yet; the last two always come again."""
    months = bounds.select(F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))).alias("m"), F.trunc("end", "month").alias("_e"))
    parts = months.select(F.date_format("m", "yyyy-MM").alias("part"), (F.col("m") >= F.add_months("_e", -1)).alias("_again"))
    return parts.join(done.select("part", F.lit(True).alias("_d")).distinct(), "part", "left").where(F.col("_again") | F.col("_d").isNull()).select("part")


def gate_trials(trials: DataFrame, registrations: DataFrame, unlocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): a trial needs a registration, and an unlock once it reaches the holdout."""
    reg = registrations.groupBy("experiment").agg(F.min("holdout_start").alias("_h"))
    free = unlocks.select("experiment", F.lit(True).alias("_u")).distinct()
    rows = trials.join(reg, "experiment", "left").join(free, "experiment", "left")
    reason = F.when(F.col("_h").isNull(), "not registered").when((F.col("data_end") >= F.col("_h")) & F.col("_u").isNull(), "touches the sealed holdout")
    judged = rows.withColumn("reason", reason)
    return judged.where("reason IS NULL").select(*trials.columns), judged.where("reason IS NOT NULL").select(*trials.columns, "reason")


def new_registrations(existing: DataFrame, incoming: DataFrame, body: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted with a hash of the body, rejected): an experiment is registered once, by the first in ``order``
    (then by hash) of a batch that names it more than once."""
    hashed = incoming.withColumn("hash", F.substring(F.sha2(F.to_json(F.struct(*sorted(body))), 256), 1, 12))
    names = existing.select("experiment", F.lit(True).alias("_known")).distinct()
    place = F.row_number().over(Window.partitionBy("experiment").orderBy(*([order] if order else []), "hash"))
    judged = hashed.withColumn("_place", place).join(names, "experiment", "left")
    fresh = F.col("_known").isNull() & (F.col("_place") == 1)
    drop = ["_place", "_known"]
    return judged.where(fresh).drop(*drop), judged.where(~fresh).drop(*drop)


def dev_slice(rows: DataFrame, holdout: Column) -> DataFrame:
    return rows.where(F.col("date") < holdout)


def file_fingerprints(spark: SparkSession, root: str, part: str) -> DataFrame:
    """(part, n, x, s): an order-free fingerprint of the files of each partition folder ``part=...`` of a folder, from their
    names, sizes and times of change; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    h = F.xxhash64("path", "length", "modificationTime")
    named = files.select(F.regexp_extract("path", f"/{part}=([^/]*)/", 1).alias("part"), h.alias("h"))
    return named.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_000_007))).alias("s"))


def rebuild_changed(spark: SparkSession, raw: str, curated: str, part: str, build: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Bring a curated table up to date with a raw one, both partitioned by ``part``, and return the rebuilt partitions.

    The fingerprints that the curated table was built from lie beside it. Only partitions whose files are other ones than
    then are built again; partitions that are gone from the raw table are not touched. The fingerprints are written last, so
    a run that broke off is made up for by the next.
    """
    now = materialized(file_fingerprints(spark, raw, part), "prints")
    beside = f"{curated.rstrip('/')}-built-from"
    before = spark.read.schema(now.schema).parquet(beside) if _exists(spark, beside) else now.limit(0)
    changed = now.join(before, now.columns, "left_anti").select("part")
    parts = sorted(r["part"] for r in changed.collect())  # one a partition folder
    if parts:
        rows = build(spark.read.parquet(raw).where(F.col(part).cast("string").isin(parts)))
        write_partition(rows, curated, [part])
        now.write.mode("overwrite").parquet(beside)
    return parts


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def save_curated(df: DataFrame, name: str, key: str = "cid", order: str = "date", buckets: int = 32) -> DataFrame:
    """Write a named table, bucketed by key and sorted by ``order``, in the shared folder, and return it.

    Windows and joins on the key find its rows together and need no exchange."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).option("path", path).saveAsTable(name)
    return read_curated(spark, name)


def read_curated(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.table(name)
    return table.select(*columns) if columns else table


def window_slice(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """The rows of a date window, both ends included."""
    return rows.where(F.col("date").between(start, end))


def scan_reference(spark: SparkSession, path: str) -> DataFrame:
    """(date, tri) of a reference index kept as CSV."""
    return spark.read.option("header", True).schema("date DATE, tri DOUBLE").csv(path)


def scan_actions(spark: SparkSession, path: str) -> DataFrame:
    """Corporate actions kept as CSV; a missing subject is the empty text."""
    rows = spark.read.option("header", True).schema("symbol STRING, series STRING, isin STRING, ex_date DATE, kind STRING, value DOUBLE, subject STRING").csv(path)
    return rows.fillna("", ["subject"])


def trial_log(lines: DataFrame, params: str, metrics: str, line: str = "value") -> dict[str, DataFrame]:
    """The records of a log of JSON lines by kind: registrations, trials with their nested params and metrics as
    columns, unlocks. Lines of another kind are left out."""
    body = f"kind string, experiment string, holdout_start date, data_end date, params struct<{params}>, metrics struct<{metrics}>"
    rows = lines.select(F.from_json(line, body).alias("r")).select("r.*")
    of = lambda kind: rows.where(F.col("kind") == kind)
    return {"registrations": of("registration").select("experiment", "holdout_start"), "unlocks": of("unlock").select("experiment").distinct(),
            "trials": of("trial").select("experiment", "data_end", "params.*", "metrics.*")}
