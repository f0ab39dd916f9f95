"""Deterministic samples: every order comes from a hash of keys, so samples come out alike on any partitioning.

A sample of a large group takes its ``k`` lowest hashes; Spark keeps ``k`` rows a task before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O


def one_in(rows: DataFrame, modulus: int, *key: Column | str) -> DataFrame:
    """About one row in ``modulus``, by the key's hash: a filter, no shuffle."""
    return rows.where(S.uniform(*key) < 1.0 / modulus)


def stratified(rows: DataFrame, strata: list[str], k: int, key: str, salt: str = "s", first: Column | None = None) -> DataFrame:
    """``k`` rows of each stratum in hash order; rows with ``first`` come before others."""
    order = [*([F.desc(first)] if first is not None else []), S.uniform(salt, F.col(key)), F.col(key)]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("place") <= k)


def proportional(rows: DataFrame, strata: list[str], share: float, key: str, salt: str = "prop") -> DataFrame:
    """The same share of each stratum, rounded to whole rows.

    The cut is found in counts by hash prefix; only rows that share the cut's prefix are ranked.
    """
    u = S.uniform(salt, F.col(key))
    keyed = rows.withColumns({"_u": u, "_b": F.floor(u * 4096)})
    at = keyed.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    up, whole = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*strata)
    cuts = at.withColumns({"_upto": F.sum("_n").over(up), "_want": F.floor(F.sum("_n").over(whole) * share + 0.5)}).where(F.col("_upto") - F.col("_n") < F.col("_want"))
    ends = cuts.select(*strata, "_b", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"), (F.col("_upto") <= F.col("_want")).alias("_all"))
    got = keyed.join(ends, [*strata, "_b"])
    part = got.where(~F.col("_all")).withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_u", key))).where(F.col("_r") <= F.col("_left")).drop("_r")
    return got.where("_all").unionByName(part).select(*rows.columns)


def balanced(rows: DataFrame, topic: str, label: str, n: int, key: str) -> DataFrame:
    """Half positives, half negatives in each topic, drawn in turns over topics until ``n``."""
    half = -(-n // 2)
    r = stratified(rows, [topic, label], half, key, "bal")
    turns = r.withColumn("turn", F.row_number().over(Window.partitionBy(label).orderBy("place", topic)))
    return turns.where(F.col("turn") <= half).drop("turn")


def round_robin(rows: DataFrame, group: str, n: int, key: str) -> DataFrame:
    """``n`` rows in turns: the first of each group, larger groups first, then the second of each, and so on."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    r = stratified(rows, [group], n, key, "rr").join(sizes, group)
    return r.orderBy("place", F.desc("_size"), group).limit(n).drop("_size")


def frequency_tiers(rows: DataFrame, name: str, top: int, middle: int) -> DataFrame:
    """Names ranked by frequency (ties by name): the first ``top``, the next ``middle``, and the tail seen once."""
    at = rows.groupBy(name).agg(F.count("*").alias("n"))
    head = at.orderBy(F.desc("n"), name).limit(top + middle)
    placed = head.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), name)))
    tier = placed.select(name, "n", F.when(F.col("place") <= top, "top").otherwise("middle").alias("tier"))
    tail = at.where("n = 1").join(head.select(name), name, "left_anti").select(name, "n", F.lit("tail").alias("tier"))
    return tier.unionByName(tail)


def group_split(rows: DataFrame, group: str, test_share: float, salt: str = "split") -> DataFrame:
    """Train and test with groups kept whole."""
    return rows.withColumn("split", F.when(S.uniform(salt, F.col(group)) < test_share, "test").otherwise("train"))


def downsample_positives(rows: DataFrame, label: str, richness: float, key: str) -> DataFrame:
    """All negatives, and so many positives (lowest hashes) that they make up ``richness`` of what is kept."""
    n = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).first()
    want = round(n["q"] * richness / (1 - richness))
    if n["p"] <= want:
        return rows
    positives = O.lowest(rows.where(F.col(label) == 1), S.uniform("pool", F.col(key)), key, want)
    return rows.where(F.col(label) == 0).unionByName(positives)


def control_size(n: int, positives: int) -> int:
    """Size of a control set: a tenth, or enough for 30 positives; 500 at most, and half of all at most."""
    richness = positives / n if n else 0
    return int(min(max(0.1 * n, 30 / richness if richness else 500), 500, n / 2))


def nearest_twin(rows: DataFrame, others: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """For each row the row of ``others`` in its group with the nearest value (ties: smaller value, then key).

    Running windows go over the distinct values of a group, whose number is that of different lengths, not of rows: they
    give the last other at or below and the first one at or above, which then meet the rows by value.
    """
    a = rows.select(group, value).distinct().withColumns({"_least": F.lit(None).cast("long"), "_most": F.lit(None).cast("long")})
    b = others.groupBy(group, value).agg(F.min(key).alias("_least"), F.max(key).alias("_most"))
    both = a.unionByName(b).groupBy(group, value).agg(F.max("_least").alias("_least"), F.max("_most").alias("_most"))
    down = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(value, F.col(c).alias("_id")))
    ends = both.select(group, value, F.last(at("_most"), ignorenulls=True).over(down).alias("_lo"), F.last(at("_least"), ignorenulls=True).over(up).alias("_hi"))
    near = rows.select(group, value, F.col(key).alias("_id")).join(ends, [group, value])
    lo, hi = F.col("_lo"), F.col("_hi")
    best = F.when(lo.isNull(), hi).when(hi.isNull(), lo).when(F.col(value) - lo[value] <= hi[value] - F.col(value), lo).otherwise(hi)
    return near.select(group, F.col("_id").alias(key), value, best["_id"].alias("twin"), F.abs(best[value] - F.col(value)).alias("gap")).where("twin is not null")
