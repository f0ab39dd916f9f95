"""Registered queries on reports, review simulation, streams, and relational roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import corpus as C
from caseload.operators import diversity as N
from caseload.operators import quality as Q
from caseload.operators import review as V
from caseload.plans.quality import COUNTS, HEAD, zero
from caseload.plans.registry import register
from caseload.session import scratch_dir, stored
from caseload.sources.derived import ctes, gold, predictions, table, u
from caseload.streaming import run_log as L

_F1 = zero("2 * tp", "2 * tp + fp + fn")


def _by_question(spark, sf) -> DataFrame:
    return Q.quality(predictions(spark, sf).where("gold is not null")).where("gray_mode = 'all' and question is not null")


def ranking_of_systems(cells: DataFrame) -> DataFrame:
    """Systems ranked by F1 on each question, and their mean rank."""
    w = Window.partitionBy("question").orderBy(F.desc("f1"), "model", "arm")
    return cells.withColumn("place", F.row_number().over(w)).groupBy("model", "arm").agg(F.avg("place").alias("mean_rank"), F.min("place").alias("best_rank"))


def against_base(cells: DataFrame, base_model: str) -> DataFrame:
    """Differences of F1 to a base model of the same arm and question."""
    base = cells.where(F.col("model") == base_model).select("arm", "question", F.col("f1").alias("base_f1"))
    return cells.join(base, ["arm", "question"]).select("model", "arm", "question", "f1", (F.col("f1") - F.col("base_f1")).alias("d_f1"))


def study_cube(cells: DataFrame) -> DataFrame:
    """Long form: a row for each measure of each cell; measures without a value say so."""
    long = cells.select("model", "arm", "question", "precision", "recall", "f1", "kappa").unpivot(["model", "arm", "question"], ["precision", "recall", "f1", "kappa"], "measure", "v")
    return long.withColumn("status", F.when(F.col("v").isNull(), "missing").otherwise("measured"))


_CELLS = f"{HEAD}, moded AS (SELECT * FROM judged), {COUNTS.format(keys='model, arm, question', source='moded', group='ALL')}, cells AS (SELECT *, {_F1} AS f1 FROM counted)"
register("win10_system_ranks", lambda s, sf: ranking_of_systems(_by_question(s, sf)), f"{_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY f1 DESC, model, arm) AS place FROM cells) SELECT model, arm, avg(place) AS mean_rank, min(place) AS best_rank FROM r GROUP BY ALL")
register("rpt15_against_base", lambda s, sf: against_base(_by_question(s, sf), "small"), f"{_CELLS} SELECT c.model, c.arm, c.question, c.f1, c.f1 - b.f1 AS d_f1 FROM cells c JOIN cells b ON b.model = 'small' AND b.arm = c.arm AND b.question = c.question")
register(
    "rpt2_f1_matrix",
    lambda s, sf: _by_question(s, sf).groupBy("model", "arm").pivot("question", ["quality", "toxic"]).agg(F.max("f1")).select("model", "arm", F.col("quality").alias("f1_quality"), F.col("toxic").alias("f1_toxic")),
    f"{_CELLS} SELECT model, arm, max(f1) FILTER (question = 'quality') AS f1_quality, max(f1) FILTER (question = 'toxic') AS f1_toxic FROM cells GROUP BY ALL",
)
register("agg46_study_cube", lambda s, sf: study_cube(_by_question(s, sf)).groupBy("measure", "status").agg(F.count("*").alias("n"), F.avg("v").alias("mean_v")).where("measure in ('precision', 'recall', 'f1')"),
    f"{_CELLS}, l AS (SELECT 'precision' AS measure, {zero('tp', 'tp + fp')} AS v FROM counted UNION ALL SELECT 'recall', {zero('tp', 'tp + fn')} FROM counted UNION ALL SELECT 'f1', f1 FROM cells) SELECT measure, 'measured' AS status, count(*) AS n, avg(v) AS mean_v FROM l GROUP BY ALL")
register(
    "agg44_corpus_counters",
    lambda s, sf: gold(s, sf).groupBy("question").agg(F.count("*").alias("n"), F.sum("gold").cast("long").alias("n_pos"), F.count_if("gray").alias("n_gray")),
    f"WITH {ctes()} SELECT question, count(*) AS n, sum(gold) AS n_pos, count(*) FILTER (gray) AS n_gray FROM gold GROUP BY ALL",
)
register(
    "scl24_invented_scores",
    lambda s, sf: gold(s, sf).select("doc_id", "question", S.invented_probability(F.col("gold"), 3.0, "inv", F.col("doc_id"), F.col("question")).alias("p"), S.sigmoid(F.col("gold") * 4.0 - 2).alias("sig"), S.approx_tokens(F.col("doc_id")).alias("tok")),
    f"WITH {ctes()}, w AS (SELECT *, {u(chr(39) + 'inv' + chr(39), 'doc_id', 'question')} AS u FROM gold) SELECT doc_id, question, floor(CASE WHEN gold = 1 THEN 1 - 0.98e0 * pow(u, 3.0e0) ELSE 0.98e0 * pow(u, 3.0e0) END * 1000 + 0.5e0) / 1000 AS p, 1 / (1 + exp(-(gold * 4.0e0 - 2))) AS sig, greatest(1, floor(doc_id / 4.0e0))::BIGINT AS tok FROM w",
)
register(
    "tar10_reviewer_grid",
    lambda s, sf: V.reviewer_grid(gold(s, sf), (0.0, 0.05, 0.1, 0.2), (0.0, 0.02, 0.05)),
    f"""WITH {ctes()}, g AS (SELECT * FROM (SELECT unnest([0.0e0, 0.05e0, 0.1e0, 0.2e0]) AS miss) CROSS JOIN (SELECT unnest([0.0e0, 0.02e0, 0.05e0]) AS over)), d AS (SELECT *, {u("'review'", 'doc_id', 'question')} AS u FROM gold),
    c AS (SELECT miss, "over", gold, CASE WHEN gold = 1 THEN u >= miss ELSE u < "over" END AS coded FROM d CROSS JOIN g), s AS (SELECT miss, "over", count(*) FILTER (coded AND gold = 1) AS tp, count(*) FILTER (coded) AS flagged, count(*) FILTER (gold = 1) AS pos FROM c GROUP BY ALL)
    SELECT miss, "over", tp, flagged, pos, coalesce(tp::DOUBLE / nullif(pos, 0), 0) AS recall, coalesce(tp::DOUBLE / nullif(flagged, 0), 0) AS precision FROM s""",
)


def _labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").join(gold(spark, sf).where("question = 'quality'").select("doc_id", "gold"), "doc_id")


def _tar1(spark, sf) -> DataFrame:
    rows = stored(V.features(_labelled(spark, sf), keep=("gold",)).withColumnRenamed("gold", "label"))
    out = stored(V.cross_scores(rows).select("doc_id", "label", "score"))  # read several times: scored once
    cut = V.recall_cut(out, 0.8)
    return out.select("doc_id", "label", "score", (F.col("score") >= F.lit(cut if cut is not None else 0.0)).cast("int").alias("flagged"))


register("tar5_tar1", _tar1)
register("tar6_cal", lambda s, sf: V.cal(V.features(_labelled(s, sf), keep=("gold",))))
register("smp7_clusters", lambda s, sf: V.clusters_pick(V.features(table(s, sf, "documents").select("doc_id", "text"), 1 << 12), 8))
register("smp8_diversity", lambda s, sf: N.diversity_sample(table(s, sf, "documents").select("doc_id", "text"), 50, dims=32, buckets=1 << 12))


def _streamed(make):
    def query(spark, sf) -> DataFrame:
        at = scratch_dir(spark)
        return L.drained(make(L.read_events(spark, sf, pattern="events*.parquet")), f"{at}/rows", f"{at}/state")

    return query


register("stm1_without_repeats", _streamed(lambda e: L.without_repeats(e).select("event_id", "user_id", "event_type", "value")), "SELECT event_id, user_id, event_type, value FROM events")
register("stm2_windows", _streamed(lambda e: L.by_window(e)))


def rolled_up_orders(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.rollup("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


register("rel1_rollup", rolled_up_orders, "SELECT n_name, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)")


def _channels(spark, sf) -> DataFrame:
    """Each source's accuracy by model, as channels."""
    d = predictions(spark, sf).where("arm = 'multi' and not error and gold is not null")
    right = F.avg(F.when(F.col("label") == F.col("gold"), 1.0).otherwise(0.0))
    return d.groupBy("source").pivot("model", ["small", "mid", "large"]).agg(right)


_CHANNELS = f"{HEAD}, ch AS (SELECT source, model, 100 * greatest(0, least(1, (avg((label = gold)::INT::DOUBLE) - 0.5e0) / (1.0e0 - 0.5e0))) AS v FROM ok WHERE arm = 'multi' GROUP BY ALL)"
register(
    "agg42_composite",
    lambda s, sf: C.composite(_channels(s, sf), {m: (0.5, 1.0) for m in ("small", "mid", "large")}, "source").select("source", "composite", "n_channels"),
    f"{_CHANNELS} SELECT source, avg(v) AS composite, count(*) AS n_channels FROM ch GROUP BY ALL",
)
register(
    "agg39_topic_ceiling",
    lambda s, sf: C.topic_ceiling(gold(s, sf).where("question = 'quality'").join(table(s, sf, "documents").select("doc_id", "lang"), "doc_id"), "lang"),
    "WITH t AS (SELECT lang, count(*) FILTER (quality = 1) AS a, count(*) FILTER (quality = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT sum(greatest(a, b))::DOUBLE / sum(a + b) AS ceiling, sum(a + b) AS n FROM t",
)
register(
    "agg38_recall_by_tier",
    lambda s, sf: C.recall_by_tier(predictions(s, sf).where("not error and gold is not null").select(F.col("model").alias("tier"), F.col("question").alias("kind"), (F.col("label") == F.col("gold")).alias("hit"))),
    f"{HEAD} SELECT model AS tier, question AS kind, count(*) AS n, avg((label = gold)::INT::DOUBLE) AS rate FROM ok GROUP BY GROUPING SETS ((model, question), (model), ())",
)
