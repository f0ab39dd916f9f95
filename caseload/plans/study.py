"""Registered queries on money and latency, gold building, stability and paired conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import gold as G
from caseload.operators import ledger as L
from caseload.operators import paired as P
from caseload.operators import stability as B
from caseload.plans.quality import HEAD, wilson
from caseload.plans.registry import register
from caseload.sources import derived as D
from caseload.sources.derived import REPEATS, REPEATS_CTE, ctes, predictions, u

register(
    "agg4_op_metrics",
    lambda spark, sf: L.op_metrics(predictions(spark, sf)),
    f"""WITH {ctes()} SELECT model, arm, quantile_cont(latency_ms, 0.5) FILTER (NOT error) AS p50, quantile_cont(latency_ms, 0.95) FILTER (NOT error) AS p95, avg(input_tokens) AS mean_input, avg(output_tokens) AS mean_output,
    sum(cost) AS paid, sum(list_cost) AS listed, sum(list_cost) / count(*) * 1000 AS listed_per_1k, count(*) FILTER (error) AS n_errors, count(*) FILTER (mode = 'batch') AS n_batch, count(*) FILTER (mode = 'standard') AS n_standard FROM predictions GROUP BY ALL""",
)
register(
    "agg13_document_latency",
    lambda spark, sf: L.document_latency(predictions(spark, sf)),
    f"""WITH {ctes()}, d AS (SELECT model, arm, doc_id, CASE WHEN arm = 'multi' THEN max(latency_ms) ELSE sum(latency_ms) END AS v FROM predictions WHERE NOT error GROUP BY model, arm, doc_id)
    SELECT model, arm, quantile_cont(v, 0.5) AS doc_p50, quantile_cont(v, 0.95) AS doc_p95, count(*) AS n_docs FROM d GROUP BY ALL""",
)
register(
    "agg12_document_costs",
    lambda spark, sf: L.document_costs(predictions(spark, sf)),
    f"""WITH {ctes()}, d AS (SELECT model, arm, doc_id, sum(cost) AS paid, sum(list_cost) AS listed, CASE WHEN arm = 'multi' THEN max(input_tokens) ELSE sum(input_tokens) END AS t FROM predictions GROUP BY model, arm, doc_id)
    SELECT model, arm, avg(paid) AS paid_per_doc, avg(listed) AS listed_per_doc, avg(t) AS tokens_per_doc, CASE WHEN abs(avg(paid) - avg(listed)) / avg(listed) > 0.005e0 THEN avg(paid) END AS shown_paid FROM d GROUP BY ALL""",
)
register(
    "agg17_ledger",
    lambda spark, sf: L.spend(predictions(spark, sf)),
    f"""WITH {ctes()}, r AS (SELECT *, CASE WHEN mode = 'batch' THEN 'bulk' WHEN gray THEN 'contested' ELSE 'plain' END AS purpose FROM predictions)
    SELECT model, purpose, sum(cost) AS paid, sum(list_cost) AS listed, count(*) AS calls FROM r GROUP BY ROLLUP (model, purpose)""",
)
register(
    "jon7_coverage",
    lambda spark, sf: L.coverage(predictions(spark, sf), 0.98),
    f"""WITH {ctes()}, d AS (SELECT model, arm, doc_id, bool_and(NOT error) AS whole FROM predictions GROUP BY ALL), n AS (SELECT model, arm, count(*) AS n, count(*) FILTER (whole) AS covered FROM d GROUP BY ALL)
    SELECT *, covered >= 0.98e0 * n AS kept FROM n""",
)
register(
    "udf10_budget_gate",
    lambda spark, sf: L.within_budget(predictions(spark, sf), 0.05),
    f"""WITH {ctes()}, r AS (SELECT model, arm, sum(list_cost) OVER (PARTITION BY model, arm ORDER BY doc_id, question ROWS UNBOUNDED PRECEDING) AS running FROM predictions)
    SELECT model, arm, count(*) AS n_units, max(running) AS spent FROM r WHERE running <= 0.05e0 GROUP BY ALL""",
)

VOTES = "votes AS (SELECT doc_id, question, model, label, p FROM predictions WHERE arm = 'multi' AND NOT error)"
PANEL = "panel AS (SELECT doc_id, question, sum(label) AS yes, count(*) AS n, avg(p) AS mean_p FROM votes GROUP BY ALL)"
register(
    "bld7_panel_gold",
    lambda spark, sf: G.panel_gold(D.votes(spark, sf)),
    f"WITH {ctes()}, {VOTES}, {PANEL} SELECT doc_id, question, yes, n, mean_p, (2 * yes > n)::INT AS gold, (yes > 0 AND yes < n) OR mean_p BETWEEN 0.35e0 AND 0.65e0 AS gray FROM panel",
)
register(
    "bld12_leave_one_out",
    lambda spark, sf: G.leave_one_out(D.votes(spark, sf)),
    f"""WITH {ctes()}, {VOTES}, {PANEL}, e AS (SELECT v.doc_id, v.question, v.model, yes - v.label AS y, n - 1 AS k FROM votes v JOIN panel USING (doc_id, question))
    SELECT doc_id, question, model, CASE WHEN 2 * y > k THEN 1 WHEN 2 * y < k THEN 0 END AS gold, 2 * y = k AS gray FROM e""",
)
register(
    "bld14_unanimous",
    lambda spark, sf: G.unanimous(D.votes(spark, sf), 3),
    f"WITH {ctes()}, {VOTES} SELECT doc_id, question, CASE WHEN count(*) = 3 AND min(label) = max(label) THEN min(label) END AS label FROM votes GROUP BY ALL",
)
_AGAINST = "coalesce(CASE WHEN gold = 1 THEN n - yes ELSE yes END, 0)"
register(
    "bld8_audit",
    lambda spark, sf: G.audited(D.gold(spark, sf).select("doc_id", "question", "gold"), D.votes(spark, sf)),
    f"""WITH {ctes()}, {VOTES}, {PANEL}, j AS (SELECT g.doc_id, g.question, g.gold, n, {_AGAINST} AS against FROM gold g LEFT JOIN panel USING (doc_id, question))
    SELECT doc_id, question, CASE WHEN coalesce(against = n AND n >= 2, false) THEN 1 - gold ELSE gold END AS final, coalesce(against > 0 AND NOT (against = n AND n >= 2), false) AS gray,
    CASE WHEN n IS NULL THEN 'unaudited' WHEN against = n AND n >= 2 THEN 'flipped' WHEN against = 0 THEN 'confirmed' ELSE 'disputed' END AS rule FROM j""",
)
register(
    "bld9_consensus_or_plan",
    lambda spark, sf: G.consensus_or_plan(D.gold(spark, sf).select("doc_id", "question", "gold"), D.votes(spark, sf)),
    f"WITH {ctes()}, {VOTES}, {PANEL} SELECT g.doc_id, g.question, coalesce(CASE WHEN n >= 2 THEN (2 * yes > n)::INT END, g.gold) AS gold, coalesce(n >= 2, false) AS from_panel FROM gold g LEFT JOIN panel USING (doc_id, question)",
)
register(
    "bld1_bound_gold",
    lambda spark, sf: G.bind(D.table(spark, sf, "documents").select("doc_id").withColumn("question", F.explode(F.array(*map(F.lit, D.QUESTIONS)))), D.gold(spark, sf).where("gold = 1").select("doc_id", "question", "gold")),
    f"""WITH {ctes()}, pos AS (SELECT * FROM gold WHERE gold = 1) SELECT u.doc_id, u.question, CASE WHEN u.doc_id IN (SELECT doc_id FROM pos) THEN coalesce(p.gold, 0) END AS gold FROM units u LEFT JOIN pos p USING (doc_id, question)""",
)
register(
    "bld30_repeated_cost",
    lambda spark, sf: G.repeated_cost(predictions(spark, sf).where("arm = 'multi' and not error").select("doc_id", "question", F.col("model").alias("run"), "cost")),
    f"""WITH {ctes()}, d AS (SELECT doc_id, question, first(cost ORDER BY model) AS f, sum(cost) AS s, count(*) AS n FROM predictions WHERE arm = 'multi' AND NOT error GROUP BY ALL)
    SELECT question, count(*) AS kept, sum(n - 1) AS dropped, sum(s - f) AS wasted FROM d GROUP BY ALL""",
)

RUNS = f"WITH {ctes()}, {REPEATS_CTE}"
DECIDED = f"""decided AS (SELECT doc_id, question, first(gold) AS gold, first(gray) AS gray, sum(label) AS yes, count(DISTINCT run) AS k, max(p) - min(p) AS spread, first(label ORDER BY run) AS f FROM repeats GROUP BY doc_id, question HAVING count(DISTINCT run) = {REPEATS}),
per AS (SELECT *, yes > 0 AND yes < k AS flipped, 1 - (yes * (yes - 1) + (k - yes) * (k - yes - 1))::DOUBLE / (k * (k - 1)) AS pairwise, CASE WHEN 2 * yes > k THEN 1 WHEN 2 * yes < k THEN 0 ELSE f END AS majority,
  CASE WHEN gray THEN 'gray' WHEN gold = 1 THEN 'pos' ELSE 'neg' END AS stratum FROM decided)"""
_LOW, _HIGH = wilson("count(*) FILTER (flipped)", "count(*)")
register("agg20_pairwise", lambda spark, sf: B.per_decision(D.repeats(spark, sf), REPEATS), f"{RUNS}, {DECIDED} SELECT doc_id, question, gold, gray, yes, k, flipped, pairwise, spread, majority FROM per")
register(
    "agg19_flip_rates",
    lambda spark, sf: B.flip_rates(B.per_decision(D.repeats(spark, sf), REPEATS)),
    f"""{RUNS}, {DECIDED} SELECT question, stratum, count(*) AS n, count(*) FILTER (flipped) AS n_flipped, {_LOW} AS low, {_HIGH} AS high, avg(pairwise) AS pairwise, avg((spread = 0)::INT::DOUBLE) AS identical,
    quantile_cont(spread, 0.5) AS spread_p50, quantile_cont(spread, 0.95) AS spread_p95, count(*) FILTER (flipped AND spread >= 0.1e0) AS confident_flips FROM per GROUP BY GROUPING SETS ((question, stratum), (question), (stratum), ())""",
)
register(
    "agg19_document_flips",
    lambda spark, sf: B.document_flips(B.per_decision(D.repeats(spark, sf), REPEATS)),
    f"{RUNS}, {DECIDED}, d AS (SELECT doc_id, bool_or(flipped) AS f FROM per GROUP BY ALL) SELECT count(*) AS n_docs, count(*) FILTER (f) AS n_flipped, avg(f::INT::DOUBLE) AS rate FROM d",
)


def _reweighted(spark, sf):
    runs = D.repeats(spark, sf)
    population = B.with_stratum(D.gold(spark, sf)).groupBy("question", "stratum").agg(F.count("*").alias("size"))
    return B.reweighted(B.per_decision(runs, REPEATS), population)


register(
    "agg21_reweighted_flips",
    _reweighted,
    f"""{RUNS}, {DECIDED}, size AS (SELECT question, CASE WHEN gray THEN 'gray' WHEN gold = 1 THEN 'pos' ELSE 'neg' END AS stratum, count(*) AS size FROM gold GROUP BY ALL),
    r AS (SELECT question, stratum, avg(flipped::INT::DOUBLE) AS rate FROM per GROUP BY ALL) SELECT question, sum(size * rate) / sum(size) AS rate FROM r JOIN size USING (question, stratum) GROUP BY ALL""",
)
register(
    "agg22_range_over_runs",
    lambda spark, sf: B.range_over_runs(D.repeats(spark, sf)),
    f"""{RUNS}, r AS (SELECT question, run, count(*) FILTER (label = 1 AND gold = 1)::DOUBLE AS tp, count(*) FILTER (label = 1) AS flagged, count(*) FILTER (gold = 1) AS pos FROM repeats GROUP BY ALL)
    SELECT question, min(coalesce(tp / nullif(pos, 0), 0)) AS recall_min, max(coalesce(tp / nullif(pos, 0), 0)) AS recall_max, min(coalesce(tp / nullif(flagged, 0), 0)) AS precision_min, max(coalesce(tp / nullif(flagged, 0), 0)) AS precision_max FROM r GROUP BY ALL""",
)


def pairs(spark, sf, model: str = "mid"):
    side = lambda salt: predictions(spark, sf, salt).where(f"arm = 'multi' and model = '{model}'")
    return P.pair(side("p"), side("renamed"))


def _pairs_sql(model: str = "mid") -> str:
    other = ctes("renamed")
    return f"""WITH {ctes()}, named AS (SELECT * FROM predictions WHERE arm = 'multi' AND model = '{model}' AND gold IS NOT NULL AND NOT error),
    renamed AS (WITH {other} SELECT * FROM predictions WHERE arm = 'multi' AND model = '{model}' AND gold IS NOT NULL AND NOT error),
    pairs AS (SELECT n.doc_id, n.question, n.gold, n.label AS x, r.label AS y, n.p AS px, r.p AS py FROM named n JOIN renamed r USING (doc_id, question))"""


_CELLS8 = ", ".join(f"count(*) FILTER (gold = {g} AND x = {x} AND y = {y}) AS n{g}{x}{y}" for g in (0, 1) for x in (0, 1) for y in (0, 1))
register(
    "agg27_transitions",
    lambda spark, sf: P.transitions(pairs(spark, sf), ["question"]),
    f"""{_pairs_sql()} SELECT question, {_CELLS8}, count(*) FILTER (x <> y AND x = gold) AS lost, count(*) FILTER (x <> y AND y = gold) AS gained, avg(abs(py - px)) AS mean_shift,
    quantile_cont(abs(py - px), 0.5) AS median_shift, count(*) FILTER (x <> y AND abs(px - 0.5e0) < 0.1e0) AS near_threshold FROM pairs GROUP BY ALL""",
)
register(
    "sta10_mcnemar",
    lambda spark, sf: P.with_test(P.transitions(pairs(spark, sf), ["question"])).select("question", "lost", "gained", "p_value"),
    f"""{_pairs_sql()}, c AS (SELECT question, count(*) FILTER (x <> y AND x = gold) AS lost, count(*) FILTER (x <> y AND y = gold) AS gained FROM pairs GROUP BY ALL), d AS (SELECT *, lost + gained AS d FROM c)
    SELECT question, lost, gained, least(1.0e0, 2 * list_sum(list_transform(range(0, least(lost, gained) + 1), lambda i: exp(lgamma(d + 1.0e0) - lgamma(i + 1.0e0) - lgamma(d - i + 1.0e0) - d * ln(2.0e0))))) AS p_value FROM d""",
)
register(
    "sta4_bootstrap_point",
    lambda spark, sf: P.bootstrap_deltas(P.cluster_counts(pairs(spark, sf), "doc_id"), "doc_id", 0),
    f"""{_pairs_sql()}, c AS (SELECT {', '.join(f"count(*) FILTER ({v} = {a} AND gold = {b})::DOUBLE AS {k}_{v}" for v in 'xy' for k, a, b in (('tp', 1, 1), ('fp', 1, 0), ('fn', 0, 1), ('tn', 0, 0)))} FROM pairs)
    SELECT 0 AS replicate, tp_y / (tp_y + fp_y) - tp_x / (tp_x + fp_x) AS d_precision, tp_y / (tp_y + fn_y) - tp_x / (tp_x + fn_x) AS d_recall, 2 * tp_y / (2 * tp_y + fp_y + fn_y) - 2 * tp_x / (2 * tp_x + fp_x + fn_x) AS d_f1,
    (tp_y + tn_y) / (tp_y + fp_y + fn_y + tn_y) - (tp_x + tn_x) / (tp_x + fp_x + fn_x + tn_x) AS d_accuracy FROM c""",
)


def _weighed_sql(alike: str, n: str, by: list[str], replicates: int, salt: str = "boot") -> str:
    """SQL of ``paired.drawn_weights``: CTEs that end in ``weighed``. ``alike`` is a SELECT with a count ``n``."""
    number = lambda x: repr(x) if "e" in repr(x) else repr(x) + "e0"
    drawn = " ".join(f"WHEN size = {m} THEN len(list_filter([{', '.join(map(number, P.poisson_steps(m)))}], lambda x: x <= uu))" for m in P.BLOCKS)
    rest = ", ".join(f"CASE WHEN ({n} & {b}) > 0 THEN {b} ELSE 0 END" for b in P.BLOCKS)
    return f"""alike AS ({alike}),
    blocks AS (SELECT *, unnest(list_filter([{n} - {n} % {P.LARGE}, {rest}], lambda s: s > 0)) AS size FROM alike),
    tried AS (SELECT *, {u(f"'{salt}'", 'replicate', 'size', *by)} AS uu FROM (SELECT *, unnest(range(0, {replicates + 1})) AS replicate FROM blocks)),
    placed AS (SELECT *, {S.normal_quantile_sql('uu')} AS z FROM tried),
    weighed AS (SELECT *, CASE WHEN replicate = 0 THEN size {drawn} ELSE greatest(0, floor(size + sqrt(size) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(size)) + 0.5e0))::BIGINT END AS w FROM placed)"""


def _draws_sql(clusters: str, cells: list[str], replicates: int) -> str:
    """SQL of ``paired.resampled``: CTEs that end in ``sums``. ``clusters`` is a SELECT of one row a cluster."""
    c = ", ".join(cells)
    number = lambda x: repr(x) if "e" in repr(x) else repr(x) + "e0"
    drawn = " ".join(f"WHEN size = {m} THEN len(list_filter([{', '.join(map(number, P.poisson_steps(m)))}], lambda x: x <= uu))" for m in (*P.BLOCKS, P.LARGE))
    rest = " UNION ALL ".join(f"SELECT {c}, -1 AS i, {m} AS size FROM alike WHERE (n_alike & {m}) > 0" for m in P.BLOCKS)
    return f"""alike AS (SELECT {c}, count(*) AS n_alike FROM ({clusters}) GROUP BY ALL),
    blocks AS (SELECT {c}, unnest(range(0, n_alike // 64)) AS i, 64 AS size FROM alike UNION ALL {rest}),
    tried AS (SELECT *, {u("'boot'", 'replicate', 'size', 'i', *cells)} AS uu FROM (SELECT *, unnest(range(0, {replicates + 1})) AS replicate FROM blocks)),
    weighed AS (SELECT *, CASE WHEN replicate = 0 THEN size {drawn} END AS w FROM tried), sums AS (SELECT replicate, {', '.join(f'sum({k} * w) AS {k}' for k in cells)} FROM weighed GROUP BY replicate)"""


_KINDS = (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))


def _cells_sql(suffix: str = "", where: str = "true") -> dict[str, str]:
    return {f"{k}_{v}{suffix}": f"count(*) FILTER ({v} = {a} AND gold = {b} AND {where})" for v in "xy" for k, a, b in _KINDS}


def _deltas_sql(s: str = "") -> dict[str, str]:
    def of(v: str) -> dict[str, str]:
        tp, fp, fn, tn = (f"{k}_{v}{s}" for k in ("tp", "fp", "fn", "tn"))
        return {"precision": f"{tp}::DOUBLE / nullif({tp} + {fp}, 0)", "recall": f"{tp}::DOUBLE / nullif({tp} + {fn}, 0)", "f1": f"coalesce(2.0e0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)", "accuracy": f"({tp} + {tn})::DOUBLE / nullif({tp} + {fp} + {fn} + {tn}, 0)"}

    x, y = of("x"), of("y")
    return {k: f"({y[k]} - {x[k]})" for k in x}


def _replicates_sql(cells: dict[str, str], out: dict[str, str], replicates: int, model: str = "mid") -> str:
    """A query of (replicate, measures) over the pairs of a model."""
    chosen = "SELECT doc_id, " + ", ".join(f"{e} AS {k}" for k, e in cells.items()) + " FROM pairs GROUP BY doc_id"
    return f"{_pairs_sql(model)}, {_draws_sql(chosen, list(cells), replicates)} SELECT replicate, {', '.join(f'{e} AS {k}' for k, e in out.items())} FROM sums"


def _intervals_sql(samples: str, measures: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{m}' AS measure, max({m}) FILTER (replicate = 0) AS value, quantile_cont({m}, 0.025) FILTER (replicate > 0) AS low, quantile_cont({m}, 0.975) FILTER (replicate > 0) AS high FROM samples" for m in measures)
    return f"WITH samples AS MATERIALIZED ({samples}) {each}"


_MEASURES = {f"d_{k}": e for k, e in _deltas_sql().items()}
register(
    "sta4_bootstrap",
    lambda spark, sf: P.intervals(P.bootstrap_deltas(P.cluster_counts(pairs(spark, sf), "doc_id"), "doc_id")),
    _intervals_sql(_replicates_sql(_cells_sql(), _MEASURES, 500), list(_MEASURES)),
)
_OF_MODEL = {m: _replicates_sql(_cells_sql(), _MEASURES, 200, m) for m in ("small", "large")}
register(
    "jon12_contrast",
    lambda spark, sf: P.intervals(P.contrast(*[P.bootstrap_deltas(P.cluster_counts(pairs(spark, sf, m), "doc_id"), "doc_id", 200) for m in ("small", "large")])),
    _intervals_sql(f"SELECT a.replicate, {', '.join(f'a.{m} - b.{m} AS {m}' for m in _MEASURES)} FROM ({_OF_MODEL['small']}) a JOIN ({_OF_MODEL['large']}) b USING (replicate)", list(_MEASURES)),
)
_LONG = f"{u(chr(39) + 'known' + chr(39), 'doc_id', 'question')} < 0.4e0"
register(
    "sta5_split",
    lambda spark, sf: P.intervals(P.bootstrap_split(pairs(spark, sf), "doc_id", S.uniform("known", F.col("doc_id"), F.col("question")) < 0.4, 300)),
    _intervals_sql(_replicates_sql(_cells_sql("_i", _LONG) | _cells_sql("_o", f"NOT ({_LONG})"), {f"d_{k}": f"{a} - {_deltas_sql('_o')[k]}" for k, a in _deltas_sql("_i").items()}, 300), list(_MEASURES)),
)
_CHANGED = {"k": "count(*) FILTER (x <> y)", "n": "count(*)"}
_RATE_SQL = {"rate": "k::DOUBLE / nullif(n, 0)"}
register(
    "sta1_changed_share",
    lambda spark, sf: P.intervals(P.bootstrap_rate(pairs(spark, sf), "doc_id", F.col("x") != F.col("y"))),
    _intervals_sql(_replicates_sql(_CHANGED, _RATE_SQL, 500), ["rate"]),
)
_SHARES = {m: _replicates_sql(_CHANGED, _RATE_SQL, 300, m) for m in ("small", "large")}
register(
    "sta3_changed_difference",
    lambda spark, sf: P.intervals(P.contrast(*[P.bootstrap_rate(pairs(spark, sf, m), "doc_id", F.col("x") != F.col("y"), 300) for m in ("small", "large")])),
    _intervals_sql(f"SELECT a.replicate, a.rate - b.rate AS rate FROM ({_SHARES['small']}) a JOIN ({_SHARES['large']}) b USING (replicate)", ["rate"]),
)
register(
    "win29_dose_bands",
    lambda spark, sf: P.dose_bands(pairs(spark, sf).join(D.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id"), "n_chars"),
    f"""{_pairs_sql()}, d AS (SELECT pairs.*, n_chars FROM pairs JOIN documents USING (doc_id)), c AS (SELECT quantile_cont(n_chars, 1.0e0 / 3) AS c1, quantile_cont(n_chars, 2.0e0 / 3) AS c2 FROM d)
    SELECT CASE WHEN n_chars <= c1 THEN 'low' WHEN n_chars <= c2 THEN 'middle' ELSE 'high' END AS band, count(*) AS n, avg((y = gold)::INT::DOUBLE) - avg((x = gold)::INT::DOUBLE) AS d_accuracy FROM d CROSS JOIN c GROUP BY ALL""",
)
_RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0e0 AS midrank, count(*) OVER (PARTITION BY {k}, {v})::DOUBLE AS t FROM {s})"""
register(
    "sta13_mann_whitney",
    lambda spark, sf: P.mann_whitney(predictions(spark, sf).where("not error and gold is not null"), ["model", "arm", "question"], "p", "gold"),
    f"""{HEAD}, {_RANKED.format(k='model, arm, question', v='p', s='ok')}, s AS (SELECT model, arm, question, sum(midrank) FILTER (gold = 1) AS r1, (count(*) FILTER (gold = 1))::DOUBLE AS n1, (count(*) FILTER (gold = 0))::DOUBLE AS n0, sum((t * t * t - t) / t) AS t FROM ranked GROUP BY ALL)
    SELECT model, arm, question, n1::BIGINT AS n1, n0::BIGINT AS n0, r1 - n1 * (n1 + 1) / 2 AS u, (r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - t / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM s""",
)
register(
    "sta18_spearman",
    lambda spark, sf: P.spearman(predictions(spark, sf).where("not error").select("model", "arm", "question", "p", "latency_ms"), ["model", "arm", "question"], "p", "latency_ms"),
    f"""WITH {ctes()}, o AS (SELECT * FROM predictions WHERE NOT error), r AS (SELECT model, arm, question, rank() OVER (PARTITION BY model, arm, question ORDER BY p) + (count(*) OVER (PARTITION BY model, arm, question, p) - 1) / 2.0e0 AS ra,
    rank() OVER (PARTITION BY model, arm, question ORDER BY latency_ms) + (count(*) OVER (PARTITION BY model, arm, question, latency_ms) - 1) / 2.0e0 AS rb FROM o) SELECT model, arm, question, corr(ra, rb) AS rho, count(*) AS n FROM r GROUP BY ALL""",
)


def _case_scores(spark, sf):
    d = predictions(spark, sf).where("arm = 'multi' and not error and gold is not null")
    return d.groupBy("model", "source").agg(F.avg((F.col("label") == F.col("gold")).cast("double")).alias("accuracy"))


register(
    "sta16_kendall_w",
    lambda spark, sf: P.kendall_w(_case_scores(spark, sf), "model", "source", "accuracy"),
    f"""{HEAD}, a AS (SELECT model, source, avg((label = gold)::INT::DOUBLE) AS v FROM ok WHERE arm = 'multi' GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0e0 AS mr, count(*) OVER (PARTITION BY model, v)::DOUBLE AS t FROM a),
    i AS (SELECT source, sum(mr) AS s, count(*)::DOUBLE AS m FROM r GROUP BY ALL), q AS (SELECT count(*)::DOUBLE AS n, max(m) AS m, var_pop(s) * count(*) AS ss FROM i), k AS (SELECT sum((t * t * t - t) / t) AS t FROM r)
    SELECT n::BIGINT AS n, m::BIGINT AS m, 12 * ss / (m * m * (n * n * n - n) - m * t) AS w, m * (n - 1) * 12 * ss / (m * m * (n * n * n - n) - m * t) AS chi2 FROM q CROSS JOIN k""",
)


def _latencies(spark, sf):
    return predictions(spark, sf).where("not error").select("model", "arm", "latency_ms")


def _median_intervals(spark, sf):
    m = P.bootstrap_median(_latencies(spark, sf), ["model", "arm"], "latency_ms", 400)
    drawn = F.when(F.col("replicate") > 0, F.col("median"))
    return m.groupBy("model", "arm").agg(F.max(F.when(F.col("replicate") == 0, F.col("median"))).alias("median"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"))


_MEDIAN_CELLS = """SELECT model, arm, v, sum(k)::BIGINT AS n_alike FROM (SELECT c.*, least(greatest(latency_ms, lo), hi) AS v FROM counted c JOIN (
    SELECT model, arm, min(latency_ms) AS lo, max(latency_ms) AS hi FROM counted WHERE upto >= n / 2.0e0 - 4 * sqrt(n) - 8 AND upto - k <= n / 2.0e0 + 4 * sqrt(n) + 8 GROUP BY ALL) e USING (model, arm)) GROUP BY ALL"""
register(
    "sta2_median_bootstrap",
    _median_intervals,
    f"""WITH {ctes()}, vals AS (SELECT model, arm, latency_ms, count(*) AS k FROM predictions WHERE NOT error GROUP BY ALL),
    counted AS (SELECT *, sum(k) OVER (PARTITION BY model, arm ORDER BY latency_ms) AS upto, sum(k) OVER (PARTITION BY model, arm) AS n FROM vals),
    {_weighed_sql(_MEDIAN_CELLS, 'n_alike', ['model', 'arm', 'v'], 400, 'median')}, w AS (SELECT model, arm, replicate, v, sum(w) AS w FROM weighed GROUP BY ALL),
    r AS (SELECT *, sum(w) OVER (PARTITION BY model, arm, replicate ORDER BY v) AS upto, sum(w) OVER (PARTITION BY model, arm, replicate) AS n FROM w),
    m AS (SELECT model, arm, replicate, (max(v) FILTER (upto - w <= floor((n - 1) / 2.0e0) AND floor((n - 1) / 2.0e0) < upto) + max(v) FILTER (upto - w <= ceil((n - 1) / 2.0e0) AND ceil((n - 1) / 2.0e0) < upto)) / 2 AS median FROM r GROUP BY ALL)
    SELECT model, arm, max(median) FILTER (replicate = 0) AS median, quantile_cont(median, 0.025) FILTER (replicate > 0) AS low, quantile_cont(median, 0.975) FILTER (replicate > 0) AS high FROM m GROUP BY ALL""",
)

_MW = "model, source, question"
register(
    "sta12_mann_whitney_greater",
    lambda spark, sf: P.mann_whitney_greater(predictions(spark, sf).where("not error and gold is not null and arm = 'multi'"), ["model", "source", "question"], "p", "gold"),
    f"""{HEAD}, multi AS (SELECT * FROM ok WHERE arm = 'multi'), {_RANKED.format(k=_MW, v='p', s='multi')},
    s AS (SELECT {_MW}, sum(midrank) FILTER (gold = 1) AS r1, count(*) FILTER (gold = 1) AS n1, count(*) FILTER (gold = 0) AS n0, sum((t * t * t - t) / t) AS t FROM ranked GROUP BY ALL),
    q AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0e0 AS u, n1 + n0 AS n FROM s),
    z AS (SELECT *, (u - n1 * n0 / 2.0e0 - 0.5e0) / sqrt(n1 * n0 / 12.0e0 * (n + 1 - t / (n * (n - 1.0e0)))) AS z FROM q),
    sizes AS (SELECT DISTINCT least(n1, n0) AS a, greatest(n1, n0) AS b FROM q WHERE least(n1, n0) BETWEEN 1 AND 8),
    ways AS (SELECT a, b, 0::BIGINT AS i, list_transform(range(0, a * b + 1), lambda k: CASE WHEN k = 0 THEN 1.0e0 ELSE 0.0e0 END) AS c FROM sizes
      UNION ALL SELECT a, b, i + 1, list_transform(range(0, a * b + 1), lambda k: list_sum(list_transform(range(0, k // (i + 1) + 1), lambda j: c[k - j * (i + 1) + 1] - CASE WHEN k - j * (i + 1) >= b + i + 1 THEN c[k - j * (i + 1) - b - i] ELSE 0.0e0 END))) FROM ways WHERE i < a)
    SELECT q.model, q.source, q.question, n1, n0, q.u, CASE WHEN n1 = 0 OR n0 = 0 OR q.t >= n * n * n - n THEN NULL
      WHEN q.t = 0 AND c IS NOT NULL THEN list_sum(c[round(q.u)::BIGINT + 1:]) / list_sum(c)
      ELSE 0.5e0 - z / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda k: exp(-0.5e0 * pow(z * k / 2000, 2)) * CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)) END AS p_value
    FROM z q LEFT JOIN ways w ON w.a = least(n1, n0) AND w.b = greatest(n1, n0) AND w.i = w.a""".replace("WITH ", "WITH RECURSIVE ", 1),
)


def _known(spark, sf):
    d = predictions(spark, sf).where("arm = 'single' and not error and gold is not null")
    return d.groupBy(F.col("model").alias("system"), F.col("source").alias("corpus")).agg(F.round(F.avg((F.col("label") == F.col("gold")).cast("double")), 12).alias("known"))


def _trend(spark, sf):
    scores = _case_scores(spark, sf).select(F.col("model").alias("system"), F.col("source").alias("corpus"), F.round("accuracy", 12).alias("score"))
    return P.trend(scores, _known(spark, sf), "large")


def _spearman_sql(long: str, keys: list[str], draws: int = 2000) -> str:
    """SQL of ``paired.spearman_test`` for keys of at most ``DRAWN_UP_TO`` rows; ``long`` is a relation of keys, x and y."""
    k = ", ".join(keys)
    rank = lambda v: f"rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0e0"
    return f"""r AS (SELECT {k}, {rank('x')} AS ra, {rank('y')} AS rb FROM {long}),
    o AS (SELECT {k}, count(*) AS n, corr(ra, rb) AS rho, list(ra ORDER BY ra) AS la, list(rb ORDER BY rb) AS lb, var_pop(ra) * count(*) AS va, var_pop(rb) * count(*) AS vb FROM r GROUP BY ALL),
    places AS (SELECT {k}, n, rho, la, lb, va, vb, draw, unnest(range(1, n + 1)) AS i FROM (SELECT *, unnest(range(1, {draws + 1})) AS draw FROM o WHERE n >= 3)),
    shuffled AS (SELECT *, row_number() OVER (PARTITION BY {k}, draw ORDER BY {u("'perm'", 'draw', 'i', *keys)}, lb[i]) AS j FROM places),
    c AS (SELECT {k}, draw, any_value(rho) AS rho, sum((la[j] - (n + 1) / 2.0e0) * (lb[i] - (n + 1) / 2.0e0)) / sqrt(any_value(va) * any_value(vb)) AS r FROM shuffled GROUP BY {k}, draw),
    p AS (SELECT {k}, avg((abs(r) >= abs(rho) - 1e-12)::INT::DOUBLE) AS p_value FROM c GROUP BY {k})
    SELECT {k}, n, rho, p_value FROM o JOIN p USING ({k}) WHERE n >= 3"""


_TREND = f"""{HEAD}, scores AS (SELECT model AS system, source AS corpus, round(avg((label = gold)::INT::DOUBLE), 12) AS score FROM ok WHERE arm = 'multi' GROUP BY ALL),
knows AS (SELECT model AS system, source AS corpus, round(avg((label = gold)::INT::DOUBLE), 12) AS known FROM ok WHERE arm = 'single' GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, avg(score) OVER (PARTITION BY corpus) AS mean FROM scores) JOIN knows USING (system, corpus) WHERE system <> 'large'),
long AS (SELECT system AS series, 'score' AS measure, known AS x, score AS y FROM k UNION ALL SELECT system, 'adjusted', known, round(score - mean, 12) FROM k
  UNION ALL SELECT 'lead', 'score', x, round(s - score, 12) FROM (SELECT corpus, round(avg(known), 12) AS x, avg(score) AS s FROM k GROUP BY corpus) JOIN scores USING (corpus) WHERE system = 'large')"""
register("sta23_trend", _trend, f"{_TREND}, {_spearman_sql('long', ['series', 'measure'])}")
