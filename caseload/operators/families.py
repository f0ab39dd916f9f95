"""Message families and the explorer's population: a parent message and its attachments, judged and scored together.

Items need ``family``, ``place`` (0: the parent), ``gold``, ``gray`` and ``p``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import scalars as S


def inherit_scores(items: DataFrame, keys: list[str]) -> DataFrame:
    """A parent takes the highest score of its family; attachments keep their own."""
    top = items.groupBy(*keys).agg(F.max("p").alias("_top"))
    return items.join(top, keys).withColumn("p_inherited", F.when(F.col("place") == 0, F.col("_top")).otherwise(F.col("p"))).drop("_top")


def family_units(items: DataFrame, keys: list[str]) -> DataFrame:
    """One unit a family: any member positive, gray only if all are, the highest score, summed length, the parent's own score."""
    return items.groupBy(*keys).agg(
        F.max("gold").alias("gold"), F.bool_and("gray").alias("gray"), F.max("p").alias("p"), F.sum("chars").alias("chars"), F.count("*").alias("n"), F.min_by("p", "place").alias("parent_p")
    )


def population(units: DataFrame, cut: float = 0.5) -> DataFrame:
    """Counts by outcome at a cut, with shares of all."""
    o = units.withColumn("bucket", S.outcome(F.when(~F.col("gray"), F.col("gold")), (F.col("p") >= cut).cast("int")))
    at = o.groupBy("question", "bucket").agg(F.count("*").alias("n"))
    return at.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("question")))


def histogram(units: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Left-closed bins of the score; the last holds 1 too."""
    return units.where("p is not null").groupBy(*keys, F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def contested(votes: DataFrame) -> DataFrame:
    """By question: decisions, positives by majority, and those on which the panel disagrees."""
    at = votes.groupBy("doc_id", "question").agg(F.sum("label").alias("yes"), F.count("*").alias("n"))
    return at.groupBy("question").agg(F.count("*").alias("n"), F.count_if(2 * F.col("yes") > F.col("n")).alias("n_pos"), F.count_if((F.col("yes") > 0) & (F.col("yes") < F.col("n"))).alias("n_contested"))


def page(items: DataFrame, order: list, size: int, number: int = 0) -> DataFrame:
    """One page of a sorted list: a bounded top-k, never a full sort on the driver."""
    return items.orderBy(*order).offset(size * number).limit(size)


def after_key(items: DataFrame, key: str, last, size: int) -> DataFrame:
    """The page after ``last``: keyset paging, which needs no offset."""
    rest = items if last is None else items.where(F.col(key) > last)
    return rest.orderBy(key).limit(size)
