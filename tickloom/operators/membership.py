"""Index membership: change detection, entries and exits, overlaps and set identities.

Sets are compared row by row: every member is sent to its own snapshot and to the next one, and one
grouped maximum decides. No list is ever gathered into a single value, so a set may be of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ISIN = "^IN[A-Z0-9]{10}$"


def _against_previous(members: DataFrame, cols: list[str]) -> DataFrame:
    """(index, snapshot, cols, cur, prev): each member's presence in a snapshot and in the one before."""
    snaps = members.groupBy("index", "snapshot").agg(F.lit(1).alias("_one")).drop("_one")
    w = W.partitionBy("index").orderBy("snapshot")
    order = snaps.select("index", "snapshot", F.lead("snapshot").over(w).alias("_next"))
    rows = members.select("index", "snapshot", *cols).join(order, ["index", "snapshot"])
    both = F.array(F.struct(F.col("snapshot").alias("at"), F.lit(1).alias("cur"), F.lit(0).alias("prev")),
                   F.struct(F.col("_next").alias("at"), F.lit(0).alias("cur"), F.lit(1).alias("prev")))
    sent = rows.select("index", *cols, F.explode(both).alias("s")).where(F.col("s.at").isNotNull())
    return sent.groupBy("index", F.col("s.at").alias("snapshot"), *cols).agg(F.max("s.cur").alias("cur"), F.max("s.prev").alias("prev"))


def changed_snapshots(members: DataFrame, cols: list[str]) -> DataFrame:
    """(index, snapshot): snapshots whose membership differs from the previous one; the first counts."""
    return _against_previous(members, cols).groupBy("index", "snapshot").agg(
        F.max((F.col("cur") != F.col("prev")).cast("int")).alias("_c"), F.max("prev").alias("_has"), F.sum("cur").alias("members"),
    ).where(F.col("_c") == 1).select("index", "snapshot", "members")


def set_digests(members: DataFrame, cols: list[str]) -> DataFrame:
    """(index, snapshot, members, x, s): the size of every list and two order-free sums of the hashes of its members.

    One row stands for a list, however long; members that repeat count once."""
    h = F.xxhash64(*cols)
    once = members.select("index", "snapshot", *cols).distinct()
    return once.groupBy("index", "snapshot").agg(F.count("*").alias("members"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))


def new_versions(stored: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions (digests) to store: those of days not stored yet whose list differs from the one before them.

    Versions may be older than what is stored. A version that is not kept equals its predecessor, so each needs only the list
    right before it, stored or new; nothing else is decided anew.
    """
    known = stored.select("index", "snapshot", F.lit(True).alias("_known"))
    fresh = versions.join(known, ["index", "snapshot"], "left_anti")
    both = stored.select("index", "snapshot", "members", "x", "s", F.lit(False).alias("_new")).unionByName(
        fresh.select("index", "snapshot", "members", "x", "s", F.lit(True).alias("_new")))
    w = W.partitionBy("index").orderBy("snapshot")
    own = F.struct("members", "x", "s")
    return both.withColumn("_before", F.lag(own).over(w)).where(F.col("_new") & ~own.eqNullSafe(F.col("_before"))).select("index", "snapshot", "members", "x", "s")


def redundant_versions(stored: DataFrame) -> DataFrame:
    """(index, snapshot) of stored lists that an inserted older version made equal to the one before them."""
    own = F.struct("members", "x", "s")
    before = F.lag(own).over(W.partitionBy("index").orderBy("snapshot"))
    return stored.withColumn("_before", before).where(own.eqNullSafe(F.col("_before"))).select("index", "snapshot")


def entries_and_exits(members: DataFrame, name: str = "symbol") -> DataFrame:
    """(index, snapshot, entered, left) for every snapshot after the first."""
    rows = _against_previous(members, [name])
    agg = rows.groupBy("index", "snapshot").agg(
        F.count_if((F.col("cur") == 1) & (F.col("prev") == 0)).alias("entered"),
        F.count_if((F.col("cur") == 0) & (F.col("prev") == 1)).alias("left"), F.max("prev").alias("_has"))
    return agg.where(F.col("_has") == 1).drop("_has")


def overlap(left: DataFrame, right: DataFrame, by: list[str], name: str = "symbol") -> DataFrame:
    """(by, overlap, left_only, right_only) of two lists per key."""
    tagged = left.select(*by, name, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*by, name, F.lit(0).alias("l"), F.lit(1).alias("r")))
    one = tagged.groupBy(*by, name).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return one.groupBy(*by).agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("overlap"),
        F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"))


def holdings_against_list(held: DataFrame, official: DataFrame) -> DataFrame:
    """(book, overlap, held_not_in_index, in_index_not_held) of every book against one list.

    Only held rows are grouped; what a book lacks is the list's size minus the overlap.
    """
    listed = official.select("symbol", F.lit(1).alias("_in")).distinct()
    size = listed.agg(F.count("*")).scalar()
    own = held.select("book", "symbol").distinct().join(listed, "symbol", "left")
    agg = own.groupBy("book").agg(F.count("_in").alias("overlap"), F.count("*").alias("_n"))
    return agg.select("book", "overlap", (F.col("_n") - F.col("overlap")).alias("held_not_in_index"), (size - F.col("overlap")).alias("in_index_not_held"))


def identity(members: DataFrame, whole: str, parts: list[str], name: str = "symbol") -> DataFrame:
    """Does one set equal the union of others: (missing, extra, ok)."""
    tagged = members.where(F.col("index").isin(whole, *parts)).groupBy(name).agg(
        F.max((F.col("index") == whole).cast("int")).alias("w"), F.max(F.col("index").isin(*parts).cast("int")).alias("p"))
    return tagged.agg(F.count_if((F.col("w") == 0) & (F.col("p") == 1)).alias("missing"),
                      F.count_if((F.col("w") == 1) & (F.col("p") == 0)).alias("extra")).withColumn(
        "ok", (F.col("missing") == 0) & (F.col("extra") == 0))


def subset(members: DataFrame, part: str, whole: str, name: str = "symbol") -> DataFrame:
    """Is one set within another: (outside, ok)."""
    tagged = members.where(F.col("index").isin(part, whole)).groupBy(name).agg(
        F.max((F.col("index") == part).cast("int")).alias("p"), F.max((F.col("index") == whole).cast("int")).alias("w"))
    return tagged.agg(F.count_if((F.col("p") == 1) & (F.col("w") == 0)).alias("outside")).withColumn("ok", F.col("outside") == 0)


def candidate_union(*lists: DataFrame, name: str = "symbol") -> DataFrame:
    """Every name on any of the lists once: those of all reviews and the current members."""
    out = lists[0].select(name)
    for other in lists[1:]:
        out = out.unionByName(other.select(name))
    return out.distinct()


def validate_lists(rows: DataFrame, expected: DataFrame | dict[str, int] | None = None) -> DataFrame:
    """(index, n, ok, reason): expected size (a table (index, size) or a short dict), unique symbols, well-formed ISINs."""
    if isinstance(expected, dict):
        expected = rows.sparkSession.createDataFrame(list(expected.items()), "index string, size long") if expected else None
    per_symbol = rows.groupBy("index", "symbol").agg(F.count("*").alias("_k"), F.count_if(~F.trim("isin").rlike(ISIN)).alias("_bad"))
    agg = per_symbol.groupBy("index").agg(F.sum("_k").alias("n"), F.max("_k").alias("_dup"), F.sum("_bad").alias("_bad"))
    if expected is not None:
        agg = agg.join(expected.select("index", F.col("size").alias("_want")), "index", "left")
    want = F.col("_want") if expected is not None else F.lit(None)
    reason = (F.when(F.col("n") != want, "size").when(F.col("_dup") > 1, "duplicate symbols").when(F.col("_bad") > 0, "malformed ISINs"))
    return agg.select("index", "n", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))
