"""Places in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.sources.tables import stored


def shuffled(df: DataFrame) -> DataFrame:
    """A table that grows with the input, as a side of a join: it is never sent whole to the driver and all tasks.

    Spark guesses the size of a derived table from its files; explodes make 20-mers and windows many times larger than that.
    """
    return df.hint("merge")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``name``, their place (from 1) by ``order``.

    The table is sorted by ranges and written; every part counts its rows, sums of the parts before (a row for each part) give the places.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stored(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), within.alias("_row")), "ranked")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_row") + 1).alias(name))
