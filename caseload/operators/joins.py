"""Joins that aren't plain equi-joins: pending work, common keys, overlapping spans, terms within texts; and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet done: units without a finished row (errors don't count)."""
    return units.join(done.where("not error").select(*keys).distinct(), keys, "left_anti")


def pending_calls(units: DataFrame, done: DataFrame, call: list[str], part: str) -> DataFrame:
    """Calls to make again: those of which any part is missing."""
    return pending(units, done, [*call, part]).groupBy(*call).agg(F.count("*").alias("n_missing"))


def common_keys(runs: DataFrame, run: str, keys: list[str], n_runs: int) -> DataFrame:
    """Keys present in every run: one aggregate instead of a join for each run."""
    return runs.groupBy(*keys).agg(F.count_distinct(run).alias("k")).where(F.col("k") == n_runs).drop("k")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of half-open spans (a: start, stop; b: from, to) of one key that overlap, with their shared length.

    Spans are dealt to stretches of ``width``, so that a key with many spans is joined stretch by stretch; a pair counts in
    the first stretch both lie in.
    """
    stretch = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    left = a.where("start < stop").withColumn("_s", stretch("start", "stop"))
    right = b.where("`from` < `to`").withColumn("_s", stretch("from", "to"))
    met = left.join(right, [*keys, "_s"]).where("start < `to` and `from` < stop")
    met = met.where(F.col("_s") == F.floor(F.greatest("start", "from") / width)).drop("_s")
    return met.withColumn("shared", F.least("stop", "to") - F.greatest("start", "from"))


def label_spans(spans: DataFrame, gold: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """Spans against gold spans: positive if the overlap is half of either, gray if there is a smaller one only."""
    met = overlapping(spans, gold, keys, width)
    half = (2 * F.col("shared") >= F.col("stop") - F.col("start")) | (2 * F.col("shared") >= F.col("to") - F.col("from"))
    at = met.groupBy(*keys, "start", "stop").agg(F.bool_or(half).alias("positive"))
    out = spans.join(at, [*keys, "start", "stop"], "left")
    return out.withColumns({"label": F.coalesce(F.col("positive"), F.lit(False)).cast("int"), "gray": F.coalesce(~F.col("positive"), F.lit(False))}).drop("positive")


def words(text) -> object:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def containing(docs: DataFrame, terms: DataFrame, small: int = 10_000) -> DataFrame:
    """(doc_id, term): terms (phrases of words) that stand as whole words in a text.

    Words with their places meet the words of the terms in one equi-join; a phrase stands where all its words give the
    same start. Texts are read once and never shuffled; their words only if there are more than ``small`` words of terms. A
    term without words is in no text.
    """
    w = words(F.col("term"))
    parts = terms.select("term", F.size(w).alias("_size"), F.posexplode(w).alias("_j", "_w"))
    if parts.limit(small + 1).count() <= small:
        parts = F.broadcast(parts)
    found = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("_i", "_w")).join(parts, "_w")
    single = found.where("_size = 1").select("doc_id", "term")
    starts = found.where("_size > 1").groupBy("doc_id", "term", "_size", (F.col("_i") - F.col("_j")).alias("_start")).agg(F.count("*").alias("_n"))
    return single.unionByName(starts.where("_n = _size").select("doc_id", "term")).distinct()


def lift(found: DataFrame, labels: DataFrame) -> DataFrame:
    """How much more often each term stands in positive documents than in all: P(term | positive) / P(term)."""
    n = labels.agg(F.count("*").alias("n"), F.sum("gold").alias("pos"))
    at = found.join(labels, "doc_id").groupBy("term").agg(F.count("*").alias("k"), F.sum("gold").cast("long").alias("k_pos"))
    return at.crossJoin(F.broadcast(n)).select("term", "k", "k_pos", ((F.col("k_pos") / F.col("pos")) / (F.col("k") / F.col("n"))).alias("lift"))


def best_scores(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """Each document's highest score; 0 without any."""
    top = scores.groupBy("doc_id").agg(F.max("p").alias("p"))
    return pool.join(top, "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def union_of(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def same_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as multisets; empty if the sides are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def carried_over(new: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    """New records, and prior ones that weren't built again."""
    return new.unionByName(prior.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns))
