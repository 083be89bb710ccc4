"""Time-respecting train/test splits as tables of (split, row, role)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.temporal import asof


def walk_forward(rows: DataFrame, train: int, test: int, step: int | None = None, expanding: bool = True) -> DataFrame:
    """(fold, session_no, role) over numbered rows; the training window grows unless ``expanding=False``."""
    step = step or test
    count = rows.agg((F.max("session_no") + 1).alias("n")).where(F.col("n") >= train + test)
    folds = count.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - train - test) / step).cast("int"))).alias("fold"))
    cut = F.col("fold").cast("long") * step + train
    begin = F.lit(0).cast("long") if expanding else F.col("fold").cast("long") * step
    parts = F.array(F.struct(F.lit("train").alias("role"), F.sequence(begin, cut - 1).alias("rows")),
                    F.struct(F.lit("test").alias("role"), F.sequence(cut, cut + test - 1).alias("rows")))
    exploded = folds.select("fold", F.explode(parts).alias("p")).select("fold", "p.role", F.explode("p.rows").alias("session_no"))
    return exploded.select("fold", "session_no", "role")


def group_bounds(rows: DataFrame, k: int) -> DataFrame:
    """(g, t0, t1, reach): k contiguous groups and the furthest label end inside each. rows: (session_no, label_end)."""
    n = rows.agg(F.max("session_no") + 1).scalar()
    sized = rows.withColumn("_n", n).withColumns({"_q": F.floor(F.col("_n") / k), "_x": F.col("_n") % k})
    edge = F.col("_x") * (F.col("_q") + 1)   # the first n % k groups hold one row more
    i = F.col("session_no")
    g = F.when(i < edge, F.floor(i / (F.col("_q") + 1))).otherwise(F.col("_x") + F.floor(F.try_divide(i - edge, F.col("_q"))))
    return sized.withColumn("g", g.cast("int")).groupBy("g").agg(
        F.min("session_no").alias("t0"), F.max("session_no").alias("t1"), F.max("label_end").alias("reach"))


def with_horizon(rows: DataFrame, horizon: int) -> DataFrame:
    """Label end as a row number: ``horizon`` rows ahead, clipped to the last row."""
    last = rows.agg(F.max("session_no")).scalar()
    return rows.withColumn("label_end", F.least(F.col("session_no") + horizon, last))


def with_label_dates(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Label end as a row number, from a date of its own for each row: the last session on or before it.

    rows: (session_no, date); ends: (date, label_end). A label without an end reaches the last row; none ends before its row.
    """
    last = rows.agg(F.max("session_no")).scalar()
    wanted = rows.join(ends.select("date", F.col("label_end").alias("_until")), "date", "left")
    found = asof(wanted, rows.select(F.col("date").alias("_d"), F.col("session_no").alias("_no")), [], "_until", "_d", ["_no"])
    end = F.when(F.col("_until").isNull(), last).otherwise(F.greatest("session_no", F.coalesce("_no", F.col("session_no"))))
    return found.select("session_no", "date", end.alias("label_end"))


def combinatorial(rows: DataFrame, n_groups: int, k_test: int, embargo_pct: float = 0.01) -> DataFrame:
    """(split, session_no, role) for every choice of ``k_test`` of ``n_groups`` groups.

    A training row is purged when its label reaches into a test group, or when it lies within a test
    group's label reach plus the embargo. The group bounds are one small array, tested per row.
    """
    bounds = group_bounds(rows, n_groups).agg(F.array_sort(F.collect_list(F.struct("g", "t0", "t1", "reach"))).alias("b"))
    n = F.col("_b")[n_groups - 1]["t1"] + 1
    combos = F.array(*[
        F.struct(F.lit(i).alias("split"), F.array(*[F.lit(g) for g in c]).alias("groups"))
        for i, c in enumerate(combinations(range(n_groups), k_test))
    ])
    each = rows.withColumn("_b", bounds.scalar()).withColumn("_c", F.explode(combos))
    each = each.withColumn("_t", F.transform("_c.groups", lambda g: F.element_at("_b", g + 1))).withColumn("_e", F.bround(n * embargo_pct, 0))
    i, end, gap = F.col("session_no"), F.col("label_end"), F.col("_e")
    inside = F.exists("_t", lambda t: (i >= t["t0"]) & (i <= t["t1"]))
    leaks = F.exists("_t", lambda t: ((i < t["t0"]) & (end >= t["t0"])) | ((i > t["t1"]) & (i <= t["reach"] + gap)))
    role = F.when(inside, "test").when(leaks, "purged").otherwise("train")
    return each.select(F.col("_c.split").alias("split"), "session_no", role.alias("role"))


def purged_kfold(rows: DataFrame, k: int = 5, embargo_pct: float = 0.01) -> DataFrame:
    """Each of k contiguous folds is the test set once."""
    return combinatorial(rows, k, 1, embargo_pct)
