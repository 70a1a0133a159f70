"""Mergeable distinct counts (PROF5, opt-in): one HyperLogLog sketch a column, in one pass.

The exact profile shuffles every distinct value; a sketch of a column is a few kilobytes whatever
the number of rows, can be stored with the partition or day it was made from, and is united with
others later without reading the data again.  Estimates lie within ``error_bound`` of the exact
count with near certainty (three standard errors).

Results: nulls are not counted, as in the exact profile; an empty table gives a NULL sketch and
the estimate 0; values are compared by their text form, but integers and binary as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType

LG_K = 12


def error_bound(lg_k: int = LG_K) -> float:
    """Three standard errors of an estimate, as a share of the count."""
    return 3 * 1.04 / math.sqrt(1 << lg_k)


def distinct_sketches(df: DataFrame, columns: list[str] | None = None, by: list[str] = (), lg_k: int = LG_K) -> DataFrame:
    """(by..., column_name, sketch): one sketch for each column, or for each of the groups' rows."""
    columns = [c for c in columns or df.columns if c not in by]
    plain = (IntegerType, LongType, StringType, BinaryType)

    def value(c):
        return F.col(f"`{c}`") if isinstance(df.schema[c].dataType, plain) else F.col(f"`{c}`").cast("string")

    names = [f"__sketch_{i}" for i in range(len(columns))]
    made = df.groupBy(*[F.col(f"`{b}`") for b in by]).agg(
        *[F.hll_sketch_agg(value(c), F.lit(lg_k)).alias(n) for c, n in zip(columns, names)])
    listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(n).alias("sketch")) for c, n in zip(columns, names)])
    return made.select(*[F.col(f"`{b}`") for b in by], F.inline(listed))


def united(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """One sketch for each column (and group of ``by``) from all that were stored."""
    return sketches.groupBy(*by, "column_name").agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """The sketches' rows with ``n_distinct`` (estimate) instead of the sketch."""
    return sketches.withColumn("n_distinct", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long")).drop("sketch")
