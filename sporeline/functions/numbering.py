"""Numbers over a whole table, made where the rows lie: partition sizes are summed, rows are never sent to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sporeline.functions.storage import materialize


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``df`` with ``name`` = 1, 2, ... in the given order: sorted by range, each range numbered from the sizes of those before it."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))  # one row a partition
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    sizes = sizes.select("_part", "_low", before.alias("_before"))
    return placed.join(F.broadcast(sizes), "_part").select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_low") + 1).alias(name))
