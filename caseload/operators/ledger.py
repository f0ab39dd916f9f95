"""Operations: latency, tokens, money, by model, vendor and document; totals by rollup, in the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O

CALL = ["model", "arm", "doc_id"]


def op_metrics(decisions: DataFrame) -> DataFrame:
    """Latency percentiles (linear), token means, money, decisions by mode, for each model and arm."""
    at = O.quantiles(decisions.where("not error"), ["model", "arm"], "latency_ms", {"p50": 0.5, "p95": 0.95})
    return decisions.groupBy("model", "arm").agg(
        F.avg("input_tokens").alias("mean_input"),
        F.avg("output_tokens").alias("mean_output"),
        F.sum("cost").alias("paid"),
        F.sum("list_cost").alias("listed"),
        (F.sum("list_cost") / F.count("*") * 1000).alias("listed_per_1k"),
        F.count_if(F.col("error")).alias("n_errors"),
        F.count_if(F.col("mode") == "batch").alias("n_batch"),
        F.count_if(F.col("mode") == "standard").alias("n_standard"),
    ).join(at, ["model", "arm"], "left")


def document_latency(decisions: DataFrame) -> DataFrame:
    """Latency of a document: its questions run side by side in the multi arm (maximum), one by one in the single (sum)."""
    at = decisions.where("not error").groupBy(*CALL).agg(F.max("latency_ms").alias("m"), F.sum("latency_ms").alias("s"))
    value = F.when(F.col("arm") == "multi", F.col("m")).otherwise(F.col("s"))
    at = at.select("model", "arm", value.alias("v"))
    ends = O.quantiles(at, ["model", "arm"], "v", {"doc_p50": 0.5, "doc_p95": 0.95})
    return at.groupBy("model", "arm").agg(F.count("*").alias("n_docs")).join(ends, ["model", "arm"], "left")


def document_costs(decisions: DataFrame) -> DataFrame:
    """Money and tokens of a document; a call's input is counted once in the multi arm and for each question in the single."""
    at = decisions.groupBy(*CALL).agg(F.sum("cost").alias("paid"), F.sum("list_cost").alias("listed"), F.max("input_tokens").alias("mx"), F.sum("input_tokens").alias("sm"))
    tokens = F.when(F.col("arm") == "multi", F.col("mx")).otherwise(F.col("sm"))
    return at.groupBy("model", "arm").agg(F.avg("paid").alias("paid_per_doc"), F.avg("listed").alias("listed_per_doc"), F.avg(tokens).alias("tokens_per_doc"), S.shown_discount(F.avg("paid"), F.avg("listed")).alias("shown_paid"))


def spend(decisions: DataFrame) -> DataFrame:
    """Money and calls by model and purpose, with totals by model and over all (nulls)."""
    purpose = F.when(F.col("mode") == "batch", "bulk").when(F.col("gray"), "contested").otherwise("plain")
    return decisions.withColumn("purpose", purpose).rollup("model", "purpose").agg(F.sum("cost").alias("paid"), F.sum("list_cost").alias("listed"), F.count("*").alias("calls"))


def coverage(decisions: DataFrame, least: float) -> DataFrame:
    """Runs whose scored documents cover at least ``least`` of all documents asked about."""
    at = decisions.groupBy("model", "arm", "doc_id").agg(F.bool_and(~F.col("error")).alias("whole"))
    return at.groupBy("model", "arm").agg(F.count("*").alias("n"), F.count_if("whole").alias("covered")).withColumn("kept", F.col("covered") >= least * F.col("n"))


def within_budget(decisions: DataFrame, limit: float) -> DataFrame:
    """Units, in order of document and question, whose running cost stays within the limit: the spending gate before a run.

    Running sums go over the documents of one model and arm dealt to 1,024 stretches of the ids' range, then within a stretch.
    """
    from pyspark.sql import Window

    keys = ["model", "arm"]
    ends = decisions.agg(F.min("doc_id").alias("lo"), (F.max("doc_id") - F.min("doc_id") + 1).alias("span"))
    whole = decisions.crossJoin(ends).withColumn("stretch", F.floor((F.col("doc_id") - F.col("lo")) / F.col("span") * 1024)).drop("lo", "span")
    parts = whole.groupBy(*keys, "stretch").agg(F.sum("list_cost").alias("s"))
    before = parts.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    reachable = before.where(F.col("before") <= limit).drop("s")
    run = Window.partitionBy(*keys, "stretch").orderBy("doc_id", "question").rowsBetween(Window.unboundedPreceding, 0)
    inside = whole.join(reachable, [*keys, "stretch"]).withColumn("running", F.col("before") + F.sum("list_cost").over(run))
    return inside.where(F.col("running") <= limit).groupBy(*keys).agg(F.count("*").alias("n_units"), F.max("running").alias("spent"))
