"""Helpers shared by the operators: table access, text units, bounded numpy hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WHITE_BYTES = b" \t\n\x0b\x0c\r"
#: A bitmap of this many numbers tells which rows need not be shuffled.
BITMAP = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def maybe_asked(rows: DataFrame, hashed: Column, asked: DataFrame) -> DataFrame:
    """Rows whose hash may be among the hashes ``asked`` (one column), by a bitmap: what no one asks for is left out before a
    shuffle. Its size is fixed."""
    number = F.pmod(hashed, F.lit(BITMAP))
    bits = asked.toDF("n").select(F.pmod("n", F.lit(BITMAP)).alias("n")).groupBy(F.expr("bitmap_bucket_number(n)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(n))").alias("bitmap"))
    found = rows.withColumn("n", number).withColumn("bucket", F.expr("bitmap_bucket_number(n)")).join(F.broadcast(bits), "bucket")
    return found.filter("shiftright(cast(conv(hex(substring(bitmap, cast(bitmap_bit_position(n) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(n) % 8 as int)) & 1 = 1").select(*rows.columns)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rotl64(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, out of the way of working columns; ``row.*`` brings them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
