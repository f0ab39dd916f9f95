"""Combining scores: phrasings, parts, gates, windows and facets of one question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.functions import scalars as S


def planned_score(parts: Column, gate: Column) -> Column:
    """Highest over parts of the mean over each part's phrasings, times the gate. ``parts``: array of arrays of scores."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.array_max(F.transform(parts, mean)) * gate


def confidence(p: Column) -> Column:
    return F.abs(p - 0.5) * 2


def facet_score(scores: Column) -> Column:
    """Highest score of facets that answered; 0.5 if all refused."""
    return F.coalesce(F.array_max(F.filter(scores, lambda x: x.isNotNull())), F.lit(0.5))


def max_pool(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows of a document pooled to their highest score."""
    return windows.groupBy(*keys).agg(F.max("p").alias("p"), F.count("*").alias("n_windows"))


def recoded(gold: Column, miss: float, over: float, *key: Column | str) -> Column:
    """A simulated reviewer's coding: a positive is missed at rate ``miss``, a negative over-coded at rate ``over``; one draw a key."""
    u = S.uniform(*key)
    return F.when(gold == 1, F.when(u < miss, 0).otherwise(1)).otherwise(F.when(u < over, 1).otherwise(0))
