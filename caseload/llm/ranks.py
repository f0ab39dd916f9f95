"""Gapless places in a total order within groups of any size, by a range sort and counts of its partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import stored

#: Bits of ``monotonically_increasing_id`` that number the rows of one partition.
ROW_BITS = 33


def ranked(rows: DataFrame, group: str, order: list[str], place: str = "place", size: str = "size") -> DataFrame:
    """``rows`` with their ``place`` from 0 in ``order`` within ``group`` (never null), and the ``size`` of their group.

    Rows are dealt by ranges of group and order, so a group of any size is spread over many tasks and no window spans it;
    what each range holds of a group is counted, and running sums of those counts give its offset. Rows equal in all of
    ``order`` go by their place in the stored input. ``rows`` should be cheap to read twice.
    """
    by = [group, *order, "_tie"]
    ranged = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.drop("_tie").withColumn("_seq", F.monotonically_increasing_id()))
    held = ranged.groupBy(group, F.shiftright("_seq", ROW_BITS).alias("_part")).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)  # as many rows as ranges that a group touches
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(group, "_part", "_first", before.alias("_before"), F.sum("_n").over(whole).alias(size))
    placed = ranged.withColumn("_part", F.shiftright("_seq", ROW_BITS)).join(held, [group, "_part"])
    return placed.withColumn(place, F.col("_seq") - F.col("_first") + F.col("_before")).select(*rows.columns, place, size)
