"""Ranks within groups, of which a large one is no single task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from stridelake.operators.scratch import Scratch

LARGE = 1_000_000  # rows of a group that one task orders


def ranked(df: DataFrame, by: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``, the row number from 1 within ``by`` in the given ``order``, which has to be total for repeatable numbers.

    Where every group has up to ``LARGE`` rows, a window orders each. Otherwise rows are dealt by ranges of
    group and order, so that a large group has many parts; a row's number is that in its part and
    how many come before the part.
    """
    most = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if most <= LARGE:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint"))
    parts = max(2, -(-df.count() * 4 // LARGE))
    dealt = Scratch(df.sparkSession, "ranks").keep(df.repartitionByRange(parts, *by, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n"))
    before = before.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__part").alias("__p"), "__before")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)))
    numbered = dealt.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    both = numbered.join(before, (F.col("__part") == F.col("__p")) & same)
    return both.withColumn(out, F.col("__r") + F.col("__before")).select(*df.columns, out)
