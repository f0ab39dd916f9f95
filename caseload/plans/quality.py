"""Registered queries on classification quality."""

from __future__ import annotations

from caseload.functions.scalars import thresholds
from caseload.operators import quality as Q
from caseload.plans.registry import register
from caseload.sources.derived import ctes, predictions

KEYS = ["model", "arm", "question"]
JUDGED = "judged AS (SELECT * FROM predictions WHERE gold IS NOT NULL), ok AS (SELECT * FROM judged WHERE NOT error)"
MODED = "moded AS (SELECT *, 'all' AS gray_mode FROM judged UNION ALL SELECT *, 'excluded' FROM judged WHERE NOT gray)"
HEAD = f"WITH {ctes()}, {JUDGED}"

COUNTS = """counted AS (SELECT {keys},
  count(*) FILTER (NOT error AND label = 1 AND gold = 1) AS tp, count(*) FILTER (NOT error AND label = 1 AND gold = 0) AS fp,
  count(*) FILTER (NOT error AND label = 0 AND gold = 1) AS fn, count(*) FILTER (NOT error AND label = 0 AND gold = 0) AS tn,
  count(*) FILTER (error) AS n_errors, sum(CASE WHEN NOT error THEN pow(p - gold, 2) END) AS sum_sq,
  sum(CASE WHEN NOT error THEN -(gold * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - gold) * ln(1 - greatest(1e-6, least(1 - 1e-6, p)))) END) AS sum_log,
  count(*) FILTER (NOT error AND (label = 1) <> (p >= 0.5e0)) AS n_inc FROM {source} GROUP BY {group})"""


def wilson(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"({k})::DOUBLE / ({n})", "3.8416e0"
    middle, half = f"({p} + {z2} / (2 * ({n})))", f"1.96e0 * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4.0e0 * ({n}) * ({n})))"
    d = f"(1 + {z2} / ({n}))"
    return (
        f"CASE WHEN ({n}) <> 0 THEN greatest(0.0e0, {middle} / {d} - {half} / {d}) ELSE 0.0e0 END",
        f"CASE WHEN ({n}) <> 0 THEN least(1.0e0, {middle} / {d} + {half} / {d}) ELSE 1.0e0 END",
    )


def zero(k: str, n: str) -> str:
    return f"coalesce(CASE WHEN ({n}) <> 0 THEN ({k})::DOUBLE / ({n}) END, 0.0e0)"


_PL, _PH = wilson("tp", "tp + fp")
_RL, _RH = wilson("tp", "tp + fn")
_N, _POS = "(tp + fp + fn + tn)", "(tp + fn)"
_HALF = "1.96e0 * sqrt(4.0e0 * tp * (fp + fn) * (tp + fp + fn) / pow(nullif(2.0e0 * tp + fp + fn, 0), 4))"
RATES = f"""tp, fp, fn, tn, n_errors, {_N} AS n, {_POS} AS n_pos, {zero('tp + tn', _N)} AS accuracy, {zero('tp', 'tp + fp')} AS precision, {zero('tp', _POS)} AS recall,
  {zero('2 * tp', '2 * tp + fp + fn')} AS f1, {zero('tn', 'tn + fp')} AS specificity, {zero('fn', 'fn + tn')} AS elusion,
  CASE WHEN {_POS} > 0 AND {_POS} < {_N} THEN
    ((tp + tn)::DOUBLE / {_N} - ((tp + fp) * {_POS} + (fn + tn) * (fp + tn))::DOUBLE / ({_N} * {_N})) / (1 - ((tp + fp) * {_POS} + (fn + tn) * (fp + tn))::DOUBLE / ({_N} * {_N})) END AS kappa,
  CASE WHEN {_N} <> 0 THEN sum_sq / {_N} END AS brier, CASE WHEN {_POS} > 0 AND {_POS} < {_N} THEN sum_log / {_N} END AS log_loss,
  CASE WHEN {_N} <> 0 THEN n_inc::DOUBLE / {_N} END AS inconsistent,
  {_PL} AS precision_low, {_RL} AS recall_low, {_PH} AS precision_high, {_RH} AS recall_high,
  greatest(0.0e0, 2.0e0 * tp / nullif(2.0e0 * tp + fp + fn, 0) - {_HALF}) AS f1_low, least(1.0e0, 2.0e0 * tp / nullif(2.0e0 * tp + fp + fn, 0) + {_HALF}) AS f1_high"""
BY_SCORE = """grouped AS (SELECT model, arm, question, p, sum(gold) AS pos, sum(1 - gold) AS neg FROM ok GROUP BY ALL),
scores AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model, arm, question) AS all_pos, sum(neg) OVER (PARTITION BY model, arm, question) AS all_neg
  FROM grouped WINDOW w AS (PARTITION BY model, arm, question ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""
_PASSED = " + ".join(f"(p >= {t}e0)::INT" for t in thresholds(20))
_BIN = "1 + " + " + ".join(f"(p > {t}e0)::INT" for t in thresholds(10))
_GROUP = "GROUPING SETS ((model, arm, gray_mode, question), (model, arm, gray_mode))"
DOCS = "docs AS (SELECT model, arm, doc_id, max(label) AS label, max(gold) AS gold, max(p) AS p, bool_or(gray) AS gray, max(label) IS NULL AS error FROM judged GROUP BY ALL)"

register(
    "agg1_quality",
    lambda spark, sf: Q.quality(predictions(spark, sf).where("gold is not null")),
    f"{HEAD}, {MODED}, {COUNTS.format(keys='model, arm, gray_mode, question', source='moded', group=_GROUP)} SELECT model, arm, gray_mode, question, {RATES} FROM counted",
)
register(
    "agg3_macro_f1",
    lambda spark, sf: Q.macro_f1(Q.quality(predictions(spark, sf).where("gold is not null"))),
    f"{HEAD}, {MODED}, {COUNTS.format(keys='model, arm, gray_mode, question', source='moded', group='ALL')} SELECT model, arm, gray_mode, avg(CASE WHEN tp + fn > 0 THEN {zero('2 * tp', '2 * tp + fp + fn')} END) AS macro_f1 FROM counted GROUP BY ALL",
)
register(
    "agg8_calibration",
    lambda spark, sf: Q.calibration(predictions(spark, sf), KEYS),
    f"{HEAD}, bins AS (SELECT model, arm, question, {_BIN} AS bin, count(*) AS k, sum(gold) AS y, sum(p) AS s FROM ok GROUP BY ALL) SELECT model, arm, question, sum(abs(y - s)) / sum(k) AS ece, count(*) AS n_bins FROM bins GROUP BY ALL",
)
register(
    "win3_ranking",
    lambda spark, sf: Q.ranking(predictions(spark, sf), KEYS),
    f"""{HEAD}, {BY_SCORE}, f AS (SELECT *, 2.0e0 * tp / (tp + fp + all_pos) AS f1 FROM scores) SELECT model, arm, question,
    CASE WHEN first(all_pos) > 0 AND first(all_neg) > 0 THEN sum(pos * (all_neg - fp + 0.5e0 * neg)) / (first(all_pos) * first(all_neg)) END AS roc_auc,
    CASE WHEN first(all_pos) > 0 AND first(all_neg) > 0 THEN sum(pos::DOUBLE / all_pos * tp / (tp + fp)) END AS average_precision,
    CASE WHEN first(all_pos) > 0 AND first(all_neg) > 0 THEN max(f1) END AS best_f1,
    CASE WHEN first(all_pos) > 0 AND first(all_neg) > 0 THEN first(p ORDER BY f1 DESC, p) END AS best_cut FROM f GROUP BY ALL""",
)
register(
    "win1_recall_targets",
    lambda spark, sf: Q.recall_targets(predictions(spark, sf), KEYS),
    f"""{HEAD}, ranked AS (SELECT model, arm, question, p, gold, row_number() OVER w AS rank, sum(gold) OVER (w ROWS UNBOUNDED PRECEDING) AS seen,
    sum(gold) OVER (PARTITION BY model, arm, question) AS all_pos, count(*) OVER (PARTITION BY model, arm, question) AS n FROM ok WINDOW w AS (PARTITION BY model, arm, question ORDER BY p DESC, doc_id)),
    targets AS (SELECT unnest([0.5e0, 0.75e0, 0.8e0, 0.9e0, 0.95e0]) AS target)
    SELECT model, arm, question, target, p AS threshold, seen::DOUBLE / rank AS precision, seen::DOUBLE / all_pos AS recall, rank::DOUBLE / n AS review_fraction
    FROM ranked CROSS JOIN targets WHERE gold = 1 AND seen = ceil(target * all_pos - 1e-9)""",
)
register(
    "win5_sweep",
    lambda spark, sf: Q.sweep(predictions(spark, sf), KEYS),
    f"""{HEAD}, cuts AS (SELECT unnest(range(1, 20)) AS cut), t AS (SELECT model, arm, question, sum(gold) AS all_pos, count(*) AS all_n FROM ok GROUP BY ALL),
    s AS (SELECT t.*, cut, count(*) FILTER (k >= cut AND gold = 1) AS tp, count(*) FILTER (k >= cut AND gold = 0) AS fp FROM t CROSS JOIN cuts JOIN (SELECT *, {_PASSED} AS k FROM ok) o USING (model, arm, question) GROUP BY ALL)
    SELECT model, arm, question, cut / 20.0e0 AS threshold, tp, fp, CASE WHEN tp + fp <> 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN all_pos <> 0 THEN tp::DOUBLE / all_pos END AS recall,
    {zero('2 * tp', 'tp + fp + all_pos')} AS f1, (tp + fp)::DOUBLE / all_n AS share FROM s""",
)
register(
    "win7_cut_for_recall",
    lambda spark, sf: Q.cut_for_recall(Q.sweep(predictions(spark, sf), KEYS), KEYS, 0.8),
    f"""{HEAD}, cuts AS (SELECT unnest(range(1, 20)) AS cut), s AS (SELECT model, arm, question, cut, count(*) FILTER (k >= cut AND gold = 1)::DOUBLE / sum(gold) AS recall FROM cuts CROSS JOIN (SELECT *, {_PASSED} AS k FROM ok) GROUP BY ALL)
    SELECT model, arm, question, max(cut) / 20.0e0 AS threshold FROM s WHERE recall >= 0.8e0 - 1e-9 GROUP BY ALL""",
)
register(
    "agg11_documents",
    lambda spark, sf: Q.rates(Q.counts(Q.both_gray_modes(Q.by_document(predictions(spark, sf), ["model", "arm"])), ["model", "arm", "gray_mode"], [["model", "arm", "gray_mode"]])),
    f"{HEAD}, {DOCS}, moded AS (SELECT *, 'all' AS gray_mode FROM docs UNION ALL SELECT *, 'excluded' FROM docs WHERE NOT gray), {COUNTS.format(keys='model, arm, gray_mode', source='moded', group='ALL')} SELECT model, arm, gray_mode, {RATES} FROM counted",
)
register(
    "win6_document_sweep",
    lambda spark, sf: Q.sweep(Q.by_document(predictions(spark, sf).where("not gray"), ["model", "arm"]), ["model", "arm"]),
    f"""{HEAD}, d AS (SELECT model, arm, doc_id, max(gold) AS gold, max(p) AS p FROM judged WHERE NOT gray GROUP BY ALL), docs AS (SELECT * FROM d WHERE p IS NOT NULL),
    cuts AS (SELECT unnest(range(1, 20)) AS cut), t AS (SELECT model, arm, sum(gold) AS all_pos, count(*) AS all_n FROM docs GROUP BY ALL),
    s AS (SELECT t.*, cut, count(*) FILTER (k >= cut AND gold = 1) AS tp, count(*) FILTER (k >= cut AND gold = 0) AS fp FROM t CROSS JOIN cuts JOIN (SELECT *, {_PASSED} AS k FROM docs) o USING (model, arm) GROUP BY ALL)
    SELECT model, arm, cut / 20.0e0 AS threshold, tp, fp, CASE WHEN tp + fp <> 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN all_pos <> 0 THEN tp::DOUBLE / all_pos END AS recall,
    {zero('2 * tp', 'tp + fp + all_pos')} AS f1, (tp + fp)::DOUBLE / all_n AS share FROM s""",
)
register(
    "jon3_agreement",
    lambda spark, sf: Q.agreement(predictions(spark, sf)),
    f"""{HEAD}, c AS (SELECT x.arm, x.model AS model_a, y.model AS model_b, count(*) AS n, count(*) FILTER (x.label = 1 AND y.label = 1) AS tp, count(*) FILTER (x.label = 1 AND y.label = 0) AS fp,
    count(*) FILTER (x.label = 0 AND y.label = 1) AS fn, count(*) FILTER (x.label = 0 AND y.label = 0) AS tn FROM ok x JOIN ok y ON x.arm = y.arm AND x.doc_id = y.doc_id AND x.question = y.question AND x.model < y.model GROUP BY ALL),
    e AS (SELECT *, (tp + tn)::DOUBLE / n AS po, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))::DOUBLE / (n * n) AS pe FROM c)
    SELECT arm, model_a, model_b, n, CASE WHEN n < 2 THEN NULL WHEN fp + fn = 0 THEN 1.0e0 WHEN pe < 1 THEN (po - pe) / (1 - pe) END AS kappa FROM e""",
)
