"""Run-to-run stability of decisions asked several times: (doc_id, question, run, label, p, gold, gray)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O


def per_decision(runs: DataFrame, n_runs: int) -> DataFrame:
    """Decisions present in every run: votes, flips, the chance that two runs differ, and the majority (ties: as in the first run)."""
    at = runs.groupBy("doc_id", "question").agg(
        F.count_distinct("run").alias("k"), F.sum("label").cast("long").alias("yes"), F.min("p").alias("lo"), F.max("p").alias("hi"),
        F.min_by("label", "run").alias("first"), F.first("gold").alias("gold"), F.first("gray").alias("gray"),
    ).where(F.col("k") == n_runs)
    yes, k = F.col("yes"), F.col("k")
    no = k - yes
    return at.select(
        "doc_id", "question", "gold", "gray", "yes", "k",
        ((yes > 0) & (no > 0)).alias("flipped"),
        (1 - (yes * (yes - 1) + no * (no - 1)) / (k * (k - 1))).alias("pairwise"),
        (F.col("hi") - F.col("lo")).alias("spread"),
        F.when(yes > no, 1).when(yes < no, 0).otherwise(F.col("first")).alias("majority"),
    )



def with_stratum(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stratum", F.when(F.col("gray"), "gray").when(F.col("gold") == 1, "pos").otherwise("neg"))


def flip_rates(decisions: DataFrame) -> DataFrame:
    """Flip measures by question, by stratum, by both, and over all: grouping sets over one pass."""
    d = with_stratum(decisions)
    level = lambda q, s: F.concat_ws("/", F.coalesce(q, F.lit("*")), F.coalesce(s, F.lit("*")))
    q, s, every = F.col("question"), F.col("stratum"), F.lit(None).cast("string")
    spreads = d.select("spread", F.explode(F.array(level(q, s), level(q, every), level(every, s), level(every, every))).alias("level"))
    ends = O.quantiles(spreads, ["level"], "spread", {"spread_p50": 0.5, "spread_p95": 0.95})
    low, high = S.wilson(F.count_if("flipped"), F.count("*"))
    out = d.groupingSets([["question", "stratum"], ["question"], ["stratum"], []], "question", "stratum").agg(
        F.count("*").alias("n"), F.count_if("flipped").alias("n_flipped"), low.alias("low"), high.alias("high"), F.avg("pairwise").alias("pairwise"),
        F.avg((F.col("spread") == 0).cast("double")).alias("identical"), 
        F.count_if(F.col("flipped") & (F.col("spread") >= 0.1)).alias("confident_flips"),
    )
    return out.withColumn("level", level(q, s)).join(ends, "level", "left").drop("level")


def document_flips(decisions: DataFrame) -> DataFrame:
    """Documents of which any decision flipped."""
    at = decisions.groupBy("doc_id").agg(F.bool_or("flipped").alias("f"))
    return at.agg(F.count("*").alias("n_docs"), F.count_if("f").alias("n_flipped"), F.avg(F.col("f").cast("double")).alias("rate"))


def reweighted(decisions: DataFrame, population: DataFrame) -> DataFrame:
    """Flip rate of a stratified sample carried to a population: stratum rates weighted by ``population`` (question, stratum, size)."""
    r = with_stratum(decisions).groupBy("question", "stratum").agg(F.avg(F.col("flipped").cast("double")).alias("rate"))
    return r.join(population, ["question", "stratum"]).groupBy("question").agg((F.sum(F.col("size") * F.col("rate")) / F.sum("size")).alias("rate"))


def range_over_runs(runs: DataFrame) -> DataFrame:
    """Lowest and highest recall and precision of the runs, by question."""
    at = runs.groupBy("question", "run").agg(F.count_if((F.col("label") == 1) & (F.col("gold") == 1)).alias("tp"), F.count_if(F.col("label") == 1).alias("flagged"), F.count_if(F.col("gold") == 1).alias("pos"))
    recall, precision = S.rate_zero(F.col("tp"), F.col("pos")), S.rate_zero(F.col("tp"), F.col("flagged"))
    return at.groupBy("question").agg(F.min(recall).alias("recall_min"), F.max(recall).alias("recall_max"), F.min(precision).alias("precision_min"), F.max(precision).alias("precision_max"))
