"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws the key ``-ln(u) / weight`` (the order of ``u ** (1 / weight)``, largest first), ``u`` being
a hash of its id. Within a source documents are taken in key order until the budget is reached. Keys are spread
over fixed cells, so a prefix sum runs over the cells of a source and only the one cell in which the budget
ends is sorted: no task ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WHITE, packed, text_of
from tickloom.session import materialized

CELLS = 4096
SHARES = (5, 2, 1)


def words_of(column: str = "text") -> Column:
    return F.filter(F.split(text_of(column), WHITE), lambda w: w != "")


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size in words, and the quality weight: 0.1 + 0.9 x share of different words, so that
    repetitive text is drawn late; 0.1 for a text without words."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(text).alias("words"))
    size = F.size("words").cast("long")
    share = F.when(size > 0, F.size(F.array_distinct("words")) / size).otherwise(0.0)
    return words.select("doc_id", "source", size.alias("size"), (F.lit(0.1) + F.lit(0.9) * share).alias("weight"))


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """(source, source_size, target): sources in code point order, null last, weigh ``shares`` in turn and share
    ``total_share`` of all words; none gets over ``most`` times its own, the excess goes to the others by weight.

    Sources are capped in the order of cap / weight; the level of the first that is not capped holds for all after it.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(shares)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("share", F.element_at(F.array(*[F.lit(float(x)) for x in shares]), (place + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("share"))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.lit(total_share) * F.sum("source_size").over(everything) - (F.sum("cap").over(upto) - F.col("cap"))
    weights = F.sum("share").over(everything) - (F.sum("share").over(upto) - F.col("share"))
    s = s.withColumn("level", left / weights)
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("share") * level, F.col("cap"))).alias("target"))


def mix(docs: DataFrame, total_share: float = 1.5, most: float = 2.0, shares: tuple[int, ...] = SHARES, cells: int = CELLS) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, weight.

    Whole epochs of a source come first; the rest of its budget is drawn by weight without replacement, and the
    document in which the budget ends gives only the words still wanted.

    * null text and texts without words have size 0 and give nothing; a null source is a source of its own, last.
    * null ids draw one common key; rows with equal id and size are interchangeable, so reruns agree.
    * an empty table gives an empty result.
    """
    sized = materialized(measured(docs), "sizes")
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    sized = sized.withColumn("key", -F.log(u) / F.col("weight"))
    sized = sized.withColumn("cell", F.floor(F.lit(float(cells)) * F.col("key") / (F.col("key") + 1.0)))
    plan = targets(sized, total_share, most, shares)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialized(plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "plan")
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sized.groupBy("source", "cell").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(upto) - F.col("words"))
    of = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ends = sums.withColumnRenamed("source", "_of").join(plan.select(F.col("source").alias("_plan"), "rest"), of("_of", "_plan"))
    ends = ends.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    ends = ends.select("_of", F.col("cell").alias("end_cell"), "before")
    plan = materialized(plan.join(ends, of("source", "_of"), "left").drop("_of").withColumnRenamed("source", "_plan"), "ends")
    placed = sized.join(plan, of("source", "_plan"))
    known = F.when(F.col("cell") < F.col("end_cell"), F.col("size")).otherwise(F.lit(0).cast("long"))
    inside = placed.filter(F.col("cell") == F.col("end_cell"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    inside = inside.withColumn("drawn", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), want)))
    outside = placed.filter(~F.coalesce(F.col("cell") == F.col("end_cell"), F.lit(False))).withColumn("drawn", known)
    taken = (F.col("epochs") * F.col("size") + F.col("drawn")).alias("taken")
    columns = ["doc_id", "size", "source", "source_size", "target", taken, "weight"]
    return inside.select(columns).unionByName(outside.select(columns))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken. A document is not cut: the one in
    which a source's budget ends is given whole."""
    drawn = mix(docs).filter("taken > 0").select(F.col("doc_id").alias("_id"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"), F.col("size").alias("_size"))
    drawn = drawn.groupBy("_id", "_size").agg(F.max("copies").alias("copies"))
    sized = docs.select(packed(docs), "doc_id", F.size(words_of()).cast("long").alias("size"))
    kept = sized.join(drawn.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
