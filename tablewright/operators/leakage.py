"""Leakage between the parts of a split: test rows that training has seen, unseen categories.

Whether rows occur on the other side is an exact join on a 128-bit row hash.  Before it, the
larger side is thinned: the hashes of the smaller side set bits of a bitmap of ``2 ** BITS`` bits
(a Bloom filter with one hash), which is broadcast - its size is fixed - and rows of the larger
side whose bit is not set cannot match and are not shuffled.

Results: NULL equals NULL; repeated rows are flagged each; an empty training part flags nothing;
other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26               # of the bitmap: 8 MB at most are broadcast
BUCKET = 1 << 15        # bits of one bitmap row, as Spark's bitmap functions have it


def row_hash(columns: list[str]) -> Column:
    """MD5 of the columns' texts; a NULL differs from every text."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns]
    sizes = [F.length(p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *sizes, *parts))


def _bit(hashed: Column) -> Column:
    return F.pmod(F.xxhash64(hashed), F.lit(1 << BITS))


def bitmap(hashes: DataFrame, column: str) -> DataFrame:
    """(bucket, bits): the set bits of the column's values, at most 2 ** BITS / BUCKET rows."""
    at = _bit(F.col(column))
    return (hashes.select(F.floor(at / BUCKET).alias("bucket"), F.pmod(at, F.lit(BUCKET)).alias("place"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")))


def maybe_in(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows of ``df`` whose bit is set; the others are in no row the bitmap was made from."""
    at = _bit(F.col(column))
    place = F.pmod(at, F.lit(BUCKET)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    keyed = df.withColumn("__bucket", F.floor(at / BUCKET))
    known = bits.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    return (keyed.join(F.broadcast(known), "__bucket")
            .where(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1).drop("__bucket", "__bits"))


def leaked_rows(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """The test rows with ``in_train``: whether a training row has the same values in ``columns``."""
    keyed = test.withColumn("__row", row_hash(columns))
    seen = train.select(row_hash(columns).alias("__row"))
    found = maybe_in(seen, "__row", bitmap(keyed, "__row")).distinct().withColumn("in_train", F.lit(True))
    return keyed.join(found, "__row", "left").withColumn("in_train", F.coalesce("in_train", F.lit(False))).drop("__row")


def unseen_categories(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n): values of the test rows that no training row has, with their rows.
    An anti join of the distinct values; NULL is no category."""
    def values(df):
        listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
        return df.select(F.inline(listed)).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n"))

    return values(test).join(values(train).drop("n"), ["column_name", "value"], "left_anti")
