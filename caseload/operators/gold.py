"""Gold answers: binding, panels, audits and the order-dependent rules that settle votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bind(units: DataFrame, labels: DataFrame, negative: int = 0) -> DataFrame:
    """Gold of each unit: a labelled document without an entry is negative, an unlabelled document has none."""
    known = labels.select("doc_id").distinct().withColumn("_known", F.lit(True))
    got = units.join(labels, ["doc_id", "question"], "left").join(known, "doc_id", "left")
    return got.withColumn("gold", F.when(F.col("_known"), F.coalesce("gold", F.lit(negative)))).drop("_known")


def panel_gold(votes: DataFrame, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Majority of a panel; gray if it is split or its mean score lies between ``low`` and ``high``. An even vote is negative."""
    at = votes.groupBy("doc_id", "question").agg(F.sum("label").cast("long").alias("yes"), F.count("*").alias("n"), F.avg("p").alias("mean_p"))
    return at.select(
        "doc_id", "question", "yes", "n", "mean_p",
        (2 * F.col("yes") > F.col("n")).cast("int").alias("gold"),
        (((F.col("yes") > 0) & (F.col("yes") < F.col("n"))) | F.col("mean_p").between(low, high)).alias("gray"),
    )


def leave_one_out(votes: DataFrame) -> DataFrame:
    """For each panel member the majority of the others; an even vote is null and gray. One pass: own vote is taken off the sums."""
    at = votes.groupBy("doc_id", "question").agg(F.sum("label").cast("long").alias("yes"), F.count("*").alias("n"), F.collect_list(F.struct("model", "label")).alias("m"))
    each = at.select("doc_id", "question", "yes", "n", F.explode("m").alias("v"))
    yes, n = F.col("yes") - F.col("v.label"), F.col("n") - 1
    gold = F.when(2 * yes > n, 1).when(2 * yes < n, 0)
    return each.select("doc_id", "question", F.col("v.model").alias("model"), gold.alias("gold"), gold.isNull().alias("gray"))


def unanimous(votes: DataFrame, members: int) -> DataFrame:
    """The label that all ``members`` agree on, else null."""
    at = votes.groupBy("doc_id", "question").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return at.select("doc_id", "question", F.when((F.col("n") == members) & (F.col("lo") == F.col("hi")), F.col("lo")).alias("label"))


def audited(planned: DataFrame, votes: DataFrame) -> DataFrame:
    """Planned gold reconciled with auditors: all of two or more against it flip it, any against it make it gray, no vote keeps it."""
    v = votes.groupBy("doc_id", "question").agg(F.sum("label").cast("long").alias("yes"), F.count("*").alias("n"))
    got = planned.join(v, ["doc_id", "question"], "left")
    against = F.coalesce(F.when(F.col("gold") == 1, F.col("n") - F.col("yes")).otherwise(F.col("yes")), F.lit(0))
    flip = (against == F.col("n")) & (F.col("n") >= 2)
    return got.select(
        "doc_id", "question",
        F.when(F.coalesce(flip, F.lit(False)), 1 - F.col("gold")).otherwise(F.col("gold")).alias("final"),
        F.coalesce((against > 0) & ~flip, F.lit(False)).alias("gray"),
        F.when(F.col("n").isNull(), "unaudited").when(flip, "flipped").when(against == 0, "confirmed").otherwise("disputed").alias("rule"),
    )


def consensus_or_plan(planned: DataFrame, votes: DataFrame, least: int = 2) -> DataFrame:
    """The panel's majority where at least ``least`` voted, else the plan."""
    v = panel_gold(votes).where(F.col("n") >= least).select("doc_id", "question", F.col("gold").alias("panel"))
    return planned.join(v, ["doc_id", "question"], "left").select("doc_id", "question", F.coalesce("panel", "gold").alias("gold"), F.col("panel").isNotNull().alias("from_panel"))


def label_maps(labels: DataFrame) -> DataFrame:
    """Wide to nested: each document's labels as a map, and its gray questions as a sorted array."""
    return labels.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("question", "gold")))).alias("labels"),
        F.array_sort(F.collect_list(F.when(F.col("gray"), F.col("question")))).alias("gray"),
    )


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in ``order``. The least row is aggregated, so a frequent key needs no window."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest)])


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in ``order`` (a later line wins)."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (*order, *rest)])


def repeated_cost(rows: DataFrame) -> DataFrame:
    """Decisions asked again: the first counts, the cost of the rest is waste. ``rows``: doc_id, question, run, cost."""
    at = rows.groupBy("doc_id", "question").agg(F.min_by("cost", "run").alias("first"), F.sum("cost").alias("s"), F.count("*").alias("n"))
    return at.groupBy("question").agg(F.count("*").alias("kept"), F.sum(F.col("n") - 1).alias("dropped"), F.sum(F.col("s") - F.col("first")).alias("wasted"))


def in_order(rows: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``, with their ``place``."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= limit)
