"""Evaluation of ranked runs: trec-style measures, and estimates from sampled judgments by inverse probability.

A run has ``topic``, ``docid`` and ``score``; judgments have ``topic``, ``docid``, ``rel`` and ``p_select``. The canonical
order is by topic, falling score, and falling docid on ties. Places come from counts by score and the start of the docid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O


def ranked(run: DataFrame, judgments: DataFrame) -> DataFrame:
    """The run in canonical order, with judgments (null: unjudged) and running counts of judged relevant and non-relevant."""
    j = judgments.select("topic", "docid", "rel", "p_select")
    score = F.coalesce("score", F.lit(-1e300))
    tiers = [F.floor(F.least(F.greatest(score, F.lit(-1.0)), F.lit(2.0)) * 256), score, F.substring("docid", 1, 3)]
    one = lambda c: F.when(c, 1).otherwise(0)
    r = run.join(j, ["topic", "docid"], "left")
    return O.placed(r, ["topic"], tiers, [F.desc("docid")], {"rels": one(F.col("rel") > 0), "nonrels": one(F.col("rel") == 0)})


def measures(run: DataFrame, judgments: DataFrame) -> DataFrame:
    """MAP, R-precision, bpref, reciprocal rank, P@5/10/100, success@1/10, judged share@10 and eleven-point precision by topic."""
    totals = judgments.groupBy("topic").agg(F.count_if(F.col("rel") > 0).alias("n_rel"), F.count_if(F.col("rel") == 0).alias("n_non"))
    r = ranked(run, judgments).join(totals, "topic")
    hit, rank, n_rel = F.col("rel") > 0, F.col("rank"), F.col("n_rel")
    precision = F.col("rels") / rank
    least = F.least(n_rel, F.col("n_non"))
    at = lambda k: (F.count_if(hit & (rank <= k)) / k).alias(f"p{k}")
    base = r.groupBy("topic").agg(
        F.first("n_rel").alias("n_rel"),
        F.count_if(hit).alias("n_ret_rel"),
        S.rate_zero(F.sum(F.when(hit, precision)), F.first("n_rel")).alias("map"),
        S.rate_zero(F.count_if(hit & (rank <= n_rel)), F.first("n_rel")).alias("r_precision"),
        S.rate_zero(F.sum(F.when(hit, 1 - F.when(least > 0, F.least(F.col("nonrels"), least) / least).otherwise(0.0))), F.first("n_rel")).alias("bpref"),
        F.coalesce(1 / F.min(F.when(hit, rank)), F.lit(0.0)).alias("recip_rank"),
        at(5), at(10), at(100),
        F.max(F.when(hit & (rank <= 1), 1).otherwise(0)).alias("success1"),
        F.max(F.when(hit & (rank <= 10), 1).otherwise(0)).alias("success10"),
        (F.count_if(F.col("rel").isNotNull() & (rank <= 10)) / 10).alias("judged10"),
    )
    levels = r.where(hit).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(10)))).where(F.col("rels") >= F.col("level") / 10 * n_rel - 1e-9)
    best = levels.groupBy("topic", "level").agg(F.max(precision).alias("ip"))
    eleven = best.groupBy("topic").agg((F.sum("ip") / 11).alias("eleven_point"))
    return base.join(eleven, "topic", "left").fillna(0.0, ["eleven_point"])


def estimates(run: DataFrame, judgments: DataFrame, depths: list[int]) -> DataFrame:
    """Estimated relevant and non-relevant documents to each depth (each judged one counts as 1 / p_select), and the
    precision, recall, F1 and Jaccard that follow. Estimated precision is capped to what was retrieved."""
    w = lambda c: F.sum(F.when(c, 1 / F.col("p_select")).otherwise(0.0))
    totals = judgments.groupBy("topic").agg(w(F.col("rel") > 0).alias("all_rel"))
    size = run.groupBy("topic").agg(F.count("*").alias("n_ret"))
    r = ranked(run, judgments).withColumn("k", F.explode(F.array(*map(F.lit, depths)))).where(F.col("rank") <= F.col("k"))
    s = r.groupBy("topic", "k").agg(w(F.col("rel") > 0).alias("rel"), w(F.col("rel") == 0).alias("non")).join(totals, "topic").join(size, "topic")
    rel, non, missed = F.col("rel"), F.col("non"), F.greatest(F.lit(0.0), F.col("all_rel") - F.col("rel"))
    precision, recall = S.rate_zero(rel, rel + non), S.rate_zero(rel, rel + missed)
    return s.select(
        "topic", "k", "rel", "non", missed.alias("missed"), precision.alias("precision"), recall.alias("recall"), S.f_measure(precision, recall).alias("f1"),
        S.rate_zero(rel, rel + non + missed).alias("jaccard"), S.rate_zero(missed, missed + non).alias("miss_share"),
        F.least(F.col("k"), F.col("n_ret")).cast("long").alias("retrieved"),
    )


def marginal_precision(estimated: DataFrame) -> DataFrame:
    """Precision between each depth and the one before it."""
    w = Window.partitionBy("topic").orderBy("k")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0.0))
    d = estimated.withColumns({"d_rel": F.col("rel") - before("rel"), "d_non": F.col("non") - before("non")})
    return d.select("topic", "k", S.rate_null(F.col("d_rel"), F.col("d_rel") + F.col("d_non")).alias("marginal"))


def stratified_estimate(run: DataFrame, judgments: DataFrame, stratum: str, depths: list[int]) -> DataFrame:
    """Estimated relevant documents to each depth from strata: share of relevant among judged times the stratum's retrieved size."""
    r = ranked(run, judgments).withColumn("k", F.explode(F.array(*map(F.lit, depths)))).where(F.col("rank") <= F.col("k"))
    s = r.groupBy("topic", "k", stratum).agg(F.count("*").alias("n"), F.count_if(F.col("rel").isNotNull()).alias("judged"), F.count_if(F.col("rel") > 0).alias("rel"))
    return s.groupBy("topic", "k").agg(F.sum(S.rate_zero(F.col("rel"), F.col("judged")) * F.col("n")).alias("est_rel"), F.sum("n").alias("n"))


def rank_area(run: DataFrame, judgments: DataFrame) -> DataFrame:
    """Area under the curve by accumulation over ranks: each non-relevant adds the relevant ones above it."""
    r = ranked(run, judgments)
    s = r.groupBy("topic").agg(F.sum(F.when(F.col("rel") == 0, F.col("rels")).otherwise(0)).alias("area"), F.count_if(F.col("rel") > 0).alias("pos"), F.count_if(F.col("rel") == 0).alias("neg"))
    return s.select("topic", S.rate_null(F.col("area"), F.col("pos") * F.col("neg")).alias("auc"))


def to_messages(run: DataFrame) -> DataFrame:
    """A run of documents as a run of messages: each message at its best document (docids part their message by a dot)."""
    m = F.substring_index("docid", ".", 1)
    return run.groupBy("topic", m.alias("message")).agg(F.max(F.struct("score", "docid")).alias("b")).select("topic", "message", F.col("b.score").alias("score"), F.col("b.docid").alias("docid"))
