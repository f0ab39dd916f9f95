"""Exports: dictionaries in first-seen order, positional arrays in shards, and tables that are only given out if they agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.operators import order as O
from caseload.session import stored


def positions(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Rows with their place from 0 in ``order``, which has no ties."""
    return O.running(rows, [], order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def first_seen(rows: DataFrame, column: str, pos: str = "pos") -> DataFrame:
    """(column, code): its values, null too, numbered from 0 in the order in which they are first met."""
    firsts = rows.groupBy(column).agg(F.min(pos).alias("_at"))
    return positions(firsts, ["_at"], "code").drop("_at")


def encoded(rows: DataFrame, column: str, codes: DataFrame, name: str) -> DataFrame:
    """``column`` replaced by its code."""
    held = codes.select(F.col(column).alias("_value"), F.col("code").alias(name))
    return rows.join(held, F.col(column).eqNullSafe(F.col("_value"))).drop("_value", column)


def sharded(rows: DataFrame, pos: str, columns: list[str], size: int = 10_000) -> DataFrame:
    """(shard, n, an array for each column): rows by position, ``size`` to a shard, so no array is longer."""
    entry = F.struct(pos, *columns)
    held = rows.groupBy(F.floor(F.col(pos) / size).cast("long").alias("shard")).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    return held.select("shard", F.size("_rows").cast("long").alias("n"), *[F.col("_rows")[c].alias(c) for c in columns])


def decoded(shards: DataFrame, columns: list[str], size: int = 10_000, pos: str = "pos") -> DataFrame:
    """The rows of ``sharded``."""
    rows = shards.select("shard", F.posexplode(F.arrays_zip(*columns)).alias("_i", "_row"))
    return rows.select((F.col("shard") * size + F.col("_i")).alias(pos), *[F.col("_row")[c].alias(c) for c in columns])


def differing(own: DataFrame, published: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Rows of either side whose measures aren't those of the other, or that the other lacks: keys and both sides' measures."""
    a = own.select(*keys, F.struct(*measures).alias("own"))
    b = published.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*measures).alias("published"))
    met = a.join(b, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full")
    missing = F.col("own").isNull() | F.col("published").isNull()
    unlike = reduce(Column.__or__, [~F.col("own")[m].eqNullSafe(F.col("published")[m]) for m in measures])
    return met.where(missing | unlike).select(*[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys], "own", "published")


def only_if_same(rows: DataFrame, own: DataFrame, published: DataFrame, keys: list[str], measures: list[str], shown: int = 20) -> DataFrame:
    """``rows``, if ``own`` agrees with ``published``; any action on it else fails, with the number of differing rows and the
    first ``shown`` of them by key."""
    bad = differing(own, published, keys, measures)
    first = bad.orderBy(*keys).limit(shown).agg(F.array_join(F.collect_list(F.to_json(F.struct("*"))), "; ").alias("_rows"))
    said = bad.agg(F.count("*").alias("_n")).crossJoin(first)  # one row
    message = F.concat(F.col("_n").cast("string"), F.lit(" rows differ: "), F.col("_rows"))
    return rows.crossJoin(said).where(F.when(F.col("_n") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(*rows.columns)


def curve_and_labels(sweep: DataFrame, cells: DataFrame, keys: list[str], at: float = 0.5) -> DataFrame:
    """The sweep with ``label_differs``: whether labels give other hits or false alarms than the cut ``at`` does."""
    half = sweep.where(F.abs(F.col("threshold") - at) < 1e-9).select(*keys, F.col("tp").alias("_tp"), F.col("fp").alias("_fp"))
    both = half.join(cells.select(*keys, F.col("tp").alias("_ltp"), F.col("fp").alias("_lfp")), keys)
    flags = stored(both.select(*keys, ((F.col("_tp") != F.col("_ltp")) | (F.col("_fp") != F.col("_lfp"))).alias("label_differs")))
    return sweep.join(flags, keys, "left")
