"""Registered queries on the library's smaller pieces: rates and intervals, tests, costs, text functions, readers and writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.functions import scalars as S
from caseload.functions import text as X
from caseload.operators import corpus as C
from caseload.operators import paired as P
from caseload.operators import quality as Q
from caseload.operators import review as V
from caseload.operators import sampling as M
from caseload.operators import windows as W
from caseload.plans.drawn import _FIELDS, _WINDOWS, _messages
from caseload.plans.quality import COUNTS, HEAD
from caseload.plans.registry import register
from caseload.plans.study import _RANKED, _case_scores
from caseload.session import scratch_dir
from caseload.sources import derived as D
from caseload.sources import files as R
from caseload.sources.derived import ctes, predictions, table, u

CELL = ["model", "arm", "question"]
_COUNTED = f"{HEAD}, {COUNTS.format(keys='model, arm, question', source='judged', group='ALL')}"


def _counted(spark, sf):
    return Q.counts(predictions(spark, sf).where("gold is not null"), CELL, [CELL]).select(*CELL, "tp", "fp", "fn", "tn")


# Rates and intervals.
def _columns(make):
    """The query of columns that ``make(tp, fp, fn, tn)`` gives for each cell."""
    return lambda s, sf: _counted(s, sf).select(*CELL, *[c.alias(k) for k, c in make(*map(F.col, Q.CELLS)).items()])


_P, _D = "(tp::DOUBLE / nullif(tp + fp, 0))", "(1 + 1.96e0 * 1.96e0 / nullif(tp + fp, 0))"
_HALF = f"1.96e0 * sqrt({_P} * (1 - {_P}) / nullif(tp + fp, 0) + 1.96e0 * 1.96e0 / (4.0e0 * nullif(tp + fp, 0) * nullif(tp + fp, 0))) / {_D}"
_MID = f"({_P} + 1.96e0 * 1.96e0 / (2.0e0 * nullif(tp + fp, 0))) / {_D}"
register(
    "scl8_unclipped_wilson",
    _columns(lambda tp, fp, fn, tn: dict(zip(("low", "high"), S.wilson(tp, tp + fp, clip=False, empty=None), strict=True))),
    f"{_COUNTED} SELECT model, arm, question, {_MID} - {_HALF} AS low, {_MID} + {_HALF} AS high FROM counted",
)
register(
    "scl12_rates_nan",
    _columns(lambda tp, fp, fn, tn: {"precision": S.rate_nan(tp, tp + fp), "recall": S.rate_nan(tp, tp + fn), "elusion": S.rate_nan(fn, fn + tn)}),
    f"{_COUNTED} SELECT model, arm, question, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 'nan'::DOUBLE) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 'nan'::DOUBLE) AS recall, coalesce(fn::DOUBLE / nullif(fn + tn, 0), 'nan'::DOUBLE) AS elusion FROM counted",
)
_S, _F1HALF = "nullif(2.0e0 * tp + fp + fn, 0)", "1.96e0 * sqrt(4.0e0 * tp * (fp + fn) * (tp + fp + fn) / pow(nullif(2.0e0 * tp + fp + fn, 0), 4))"
register(
    "scl13_f1_interval",
    _columns(lambda tp, fp, fn, tn: dict(zip(("low", "high"), S.f1_interval(tp, fp, fn), strict=True))),
    f"{_COUNTED} SELECT model, arm, question, greatest(0.0e0, 2.0e0 * tp / {_S} - {_F1HALF}) AS low, least(1.0e0, 2.0e0 * tp / {_S} + {_F1HALF}) AS high FROM counted",
)


def _rebuilt(tp, fp, fn, tn):
    rounded = F.round(S.rate_zero(tp, tp + fp), 4), F.round(S.rate_zero(tp, tp + fn), 4)
    return {f"{k}_again": c.cast("long") for k, c in S.counts_of(tp + fp + fn + tn, tp + fn, *rounded).items()}


register(
    "scl14_counts_rebuilt",
    _columns(_rebuilt),
    f"""{_COUNTED}, r AS (SELECT *, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 4) AS p, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 4) AS r FROM counted), t AS (SELECT *, round(r * (tp + fn)) AS t FROM r),
    f AS (SELECT *, CASE WHEN p > 0 THEN round(t / p - t) ELSE 0 END AS f FROM t) SELECT model, arm, question, t::BIGINT AS tp_again, f::BIGINT AS fp_again, (tp + fn - t)::BIGINT AS fn_again, (fp + tn - f)::BIGINT AS tn_again FROM f""",
)
register(
    "scl15_f_measures",
    _columns(lambda tp, fp, fn, tn: {k: S.f_measure(S.rate_zero(tp, tp + fp), S.rate_zero(tp, tp + fn), beta) for k, beta in (("f_half", 0.5), ("f_two", 2.0))}),
    f"""{_COUNTED}, r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM counted)
    SELECT model, arm, question, coalesce(1.25e0 * p * r / nullif(0.25e0 * p + r, 0), 0) AS f_half, coalesce(5 * p * r / nullif(4 * p + r, 0), 0) AS f_two FROM r""",
)
register("scl16_symmetric_accuracy", _columns(lambda tp, fp, fn, tn: {"accuracy": S.symmetric_accuracy(tp + fp, tp + fn)}), f"{_COUNTED} SELECT model, arm, question, 100.0e0 * least(tp + fp, tp + fn) / nullif(greatest(tp + fp, tp + fn), 0) AS accuracy FROM counted")
register(
    "sta15_d_prime",
    _columns(lambda tp, fp, fn, tn: {"d_prime": S.normal_quantile((tp + 0.5) / (tp + fn + 1)) - S.normal_quantile((fp + 0.5) / (fp + tn + 1))}),
    f"{_COUNTED}, r AS (SELECT *, (tp + 0.5e0) / (tp + fn + 1) AS h, (fp + 0.5e0) / (fp + tn + 1) AS a FROM counted) SELECT model, arm, question, {S.normal_quantile_sql('h')} - {S.normal_quantile_sql('a')} AS d_prime FROM r",
)

# Tests and ranks.
register(
    "sta14_sign_test",
    lambda s, sf: predictions(s, sf).where("not error and gold is not null and arm = 'multi'").groupBy("model", "source").agg(F.count_if(F.col("label") > F.col("gold")).alias("n_over"), F.count_if(F.col("label") < F.col("gold")).alias("n_under")).withColumn("p_value", P.mcnemar("n_over", "n_under")),
    f"""{HEAD}, c AS (SELECT model, source, count(*) FILTER (label > gold) AS a, count(*) FILTER (label < gold) AS b FROM ok WHERE arm = 'multi' GROUP BY ALL), d AS (SELECT *, a + b AS d FROM c)
    SELECT model, source, a AS n_over, b AS n_under, least(1.0e0, 2 * list_sum(list_transform(range(0, least(a, b) + 1), lambda i: exp(lgamma(d + 1.0e0) - lgamma(i + 1.0e0) - lgamma(d - i + 1.0e0) - d * ln(2.0e0))))) AS p_value FROM d""",
)


@F.pandas_udf(T.DoubleType())
def chi2_tails(x: pd.Series, df: pd.Series) -> pd.Series:
    """One value for each row of statistics."""
    return pd.Series([None if v != v else S.chi2_tail(float(v), int(k)) for v, k in zip(x, df, strict=True)], dtype=float)


register(
    "sta17_concordance_p",
    lambda s, sf: P.kendall_w(_case_scores(s, sf), "model", "source", "accuracy").withColumn("p_value", chi2_tails("chi2", F.col("n") - 1)).select("n", "chi2", "p_value"),
    f"""{HEAD}, a AS (SELECT model, source, avg((label = gold)::INT::DOUBLE) AS v FROM ok WHERE arm = 'multi' GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0e0 AS mr, count(*) OVER (PARTITION BY model, v)::DOUBLE AS t FROM a),
    i AS (SELECT source, sum(mr) AS s, count(*)::DOUBLE AS m FROM r GROUP BY ALL), q AS (SELECT count(*)::DOUBLE AS n, max(m) AS m, var_pop(s) * count(*) AS ss FROM i), k AS (SELECT sum((t * t * t - t) / t) AS t FROM r),
    w AS (SELECT n, m * (n - 1) * 12 * ss / (m * m * (n * n * n - n) - m * t) AS x FROM q CROSS JOIN k)
    SELECT n::BIGINT AS n, x AS chi2, 1 - x / 12000 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i = 0 THEN 0.0e0 ELSE exp(((n - 1) / 2 - 1) * ln(x * i / 4000) - x * i / 8000 - (n - 1) / 2 * ln(2.0e0) - lgamma((n - 1) / 2)) END * CASE WHEN i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) AS p_value FROM w""",
)
register(
    "win11_midranks",
    lambda s, sf: P.midranks(predictions(s, sf).where("p is not null"), ["model", "question"], "p").select("model", "question", "p", "midrank"),
    f"WITH {ctes()}, ok AS (SELECT * FROM predictions WHERE p IS NOT NULL), {_RANKED.format(k='model, question', v='p', s='ok')} SELECT DISTINCT model, question, p, midrank FROM ranked",
)


def _recall_cuts(spark, sf):
    rows = predictions(spark, sf).where("model = 'mid' and arm = 'multi' and not error and gold is not null").select("question", F.col("gold").alias("label"), F.col("p").alias("score"))
    cuts = [(q, share, V.recall_cut(rows.where(F.col("question") == q), share)) for q in D.QUESTIONS for share in (0.5, 0.8)]
    return spark.createDataFrame(cuts, "question string, share double, cut double")


register(
    "win12_recall_cuts",
    _recall_cuts,
    f"""{HEAD}, r AS (SELECT question, p, row_number() OVER (PARTITION BY question ORDER BY p DESC) AS k, count(*) OVER (PARTITION BY question) AS n FROM ok WHERE model = 'mid' AND arm = 'multi' AND gold = 1)
    SELECT question, share, p AS cut FROM r CROSS JOIN (SELECT unnest([0.5e0, 0.8e0]) AS share) WHERE k = ceil(share * n)""",
)


def _control_sizes(spark, sf):
    at = D.gold(spark, sf).groupBy("question").agg(F.count("*").alias("n"), F.sum("gold").alias("pos")).collect()  # a row a question
    return spark.createDataFrame([(r["question"], M.control_size(r["n"], r["pos"])) for r in at], "question string, size long")


register("smp10_control_sizes", _control_sizes, f"WITH {ctes()}, g AS (SELECT question, count(*) AS n, sum(gold) AS pos FROM gold GROUP BY ALL) SELECT question, floor(least(greatest(0.1e0 * n, CASE WHEN pos > 0 THEN 30.0e0 / (pos::DOUBLE / n) ELSE 500 END), 500, n / 2.0e0))::BIGINT AS size FROM g")

# Costs.
register(
    "scl1_call_costs",
    lambda s, sf: predictions(s, sf).groupBy("model", "mode").agg(*[F.round(F.sum(S.call_cost(F.col("input_tokens"), F.col("output_tokens"), cached, F.lit(0.4), F.lit(1.6), tier)), 9).alias(k) for k, cached, tier in (("listed", F.lit(0), None), ("cached", F.col("cached_tokens"), None), ("flexed", F.col("cached_tokens"), F.col("mode")))]),
    f"""WITH {ctes()}, c AS (SELECT model, mode, (input_tokens * 0.4e0 + output_tokens * 1.6e0) / 1e6 AS listed, ((input_tokens - cached_tokens) * 0.4e0 + cached_tokens * 0.04e0 + output_tokens * 1.6e0) / 1e6 AS cached FROM predictions)
    SELECT model, mode, round(sum(listed), 9) AS listed, round(sum(cached), 9) AS cached, round(sum(cached * CASE WHEN mode = 'batch' THEN 0.5e0 ELSE 1 END), 9) AS flexed FROM c GROUP BY ALL""",
)
register(
    "scl21_gpu_costs",
    lambda s, sf: predictions(s, sf).where("not error").groupBy("model", "doc_id").agg(F.sum(S.gpu_cost(F.col("latency_ms"), 1.99)).alias("dollars")),
    f"WITH {ctes()} SELECT model, doc_id, sum(latency_ms / 3.6e6 * 1.99e0) AS dollars FROM predictions WHERE NOT error GROUP BY ALL",
)

# Texts.
_EDITS = [("the ", "THE "), ("zqzqzq", "x"), ("THE t", "[t]"), ("kkkkkk", "y")]
register(
    "bld31_edited",
    lambda s, sf: table(s, sf, "documents").select("doc_id", X.edited(F.col("text"), F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in _EDITS])).alias("e")).select("doc_id", F.md5(F.col("e.text").cast("binary")).alias("text"), "e.missing"),
    """WITH a AS (SELECT doc_id, text, replace(text, 'the ', 'THE ') AS t1 FROM documents), b AS (SELECT *, replace(replace(t1, 'zqzqzq', 'x'), 'THE t', '[t]') AS t3, replace(t1, 'zqzqzq', 'x') AS t2 FROM a)
    SELECT doc_id, md5(replace(t3, 'kkkkkk', 'y')) AS text, CASE WHEN NOT contains(text, 'the ') THEN 'the ' WHEN NOT contains(t1, 'zqzqzq') THEN 'zqzqzq' WHEN NOT contains(t2, 'THE t') THEN 'THE t' WHEN NOT contains(t3, 'kkkkkk') THEN 'kkkkkk' END AS missing FROM b""",
)
register(
    "txt52_window_keys",
    lambda s, sf: W.windows(table(s, sf, "documents"), "source").select("doc_id", "place", X.window_key(F.col("prefix"), F.col("target")).alias("key")),
    f"WITH {_WINDOWS} SELECT doc_id, place, sha1(prefix || chr(31) || target) AS key FROM windows",
)
_WANTED = "SELECT DISTINCT unnest(list_transform(range(1, least(len(w), 6)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)"
register(
    "txt65_wanted_frequency",
    lambda s, sf: C.wanted_frequency(table(s, sf, "documents"), table(s, sf, "benchmark").select(F.explode(F.slice(X.ngrams(X.tokens(F.col("text")), 2), 1, 5)).alias("gram")), 2),
    f"""WITH wanted AS ({_WANTED}), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM d) SELECT gram, greatest(1, count(doc_id)) AS df FROM wanted LEFT JOIN g USING (gram) GROUP BY gram""",
)
register(
    "txt68_swapped",
    lambda s, sf: table(s, sf, "pages").select("page_id", X.swapped(F.concat(F.col("url"), F.lit(" COM Com xcom")), "com", "net").alias("url")),
    "SELECT page_id, regexp_replace(url, '\\bcom\\b', 'net', 'g') || ' NET Net xcom' AS url FROM pages",
)
_REPLY = "label string, p double"
register(
    "txt70_json_replies",
    lambda s, sf: predictions(s, sf)
    .where("model = 'mid' and arm = 'multi'")
    .withColumn("said", F.expr("CASE pmod(doc_id, 4) WHEN 0 THEN concat('```json\\n{\"label\": \"', label, '\",\\n \"p\": ', p, '}\\n```') WHEN 1 THEN concat('Sure. {\"p\": ', p, '} ok') WHEN 2 THEN 'no object' ELSE concat('{\"label\": \"', label, '\"}') END"))
    .select("doc_id", "question", X.json_reply(F.col("said"), _REPLY).alias("r"))
    .select("doc_id", "question", "r.label", "r.p"),
    f"WITH {ctes()} SELECT doc_id, question, CASE WHEN doc_id % 4 IN (0, 3) AND (doc_id % 4 = 3 OR p IS NOT NULL) THEN label::VARCHAR END AS label, CASE WHEN doc_id % 4 IN (0, 1) AND (doc_id % 4 = 1 OR label IS NOT NULL) THEN p END AS p FROM predictions WHERE model = 'mid' AND arm = 'multi'",
)

# Readers and writers: what is written is read again.
def _corpus(spark, sf):
    path = f"{scratch_dir(spark)}/corpus"
    labels = F.map_from_entries(F.array(*[F.struct(F.lit(q), F.col(q).cast("string")) for q in D.QUESTIONS]))
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.when(F.col("quality").isNotNull(), labels).alias("labels")).write.json(path)
    return R.read_corpus(spark, path).select("id", F.md5(F.col("text").cast("binary")).alias("text"), F.col("labels")["quality"].alias("quality"), F.size("gray").alias("n_gray"))


register("src1_corpus", _corpus, "SELECT d.doc_id::VARCHAR AS id, md5(text) AS text, quality::VARCHAR AS quality, 0 AS n_gray FROM documents d LEFT JOIN labels USING (doc_id)")


def _written(spark, sf):
    rows = predictions(spark, sf).where("model = 'mid'").select(F.col("doc_id").cast("string").alias("doc_id"), "question", "arm", F.col("p").alias("p_positive"), F.when(F.col("error"), "failed").alias("error"), "input_tokens")
    return rows.withColumn("p_positive", F.coalesce("p_positive", F.lit(float("nan"))))


def _predictions(spark, sf):
    path = f"{scratch_dir(spark)}/run"
    R.write_json(_written(spark, sf), path)
    return R.read_predictions(spark, path).select("doc_id", "question", "arm", "p_positive", "error", "input_tokens")


_RUN = f"WITH {ctes()}, r AS (SELECT doc_id::VARCHAR AS doc_id, question, arm, p AS p_positive, CASE WHEN error THEN 'failed' END AS error, input_tokens FROM predictions WHERE model = 'mid')"
register("src4_predictions", _predictions, f"{_RUN} SELECT * FROM r")


def _resumed(spark, sf):
    old = _written(spark, sf).where(F.col("doc_id").cast("long") % 3 > 0)
    new = _written(spark, sf).where(F.col("doc_id").cast("long") % 3 < 2).withColumns({"error": F.lit(None).cast("string"), "p_positive": F.lit(0.5)})
    out = R.append_finished(old, new, ["doc_id", "question", "arm"])
    return out.groupBy("question", "arm").agg(F.count("*").alias("n"), F.count_if(F.col("p_positive") == 0.5).alias("n_half"), F.count("error").alias("n_failed"))


register(
    "src24_resumed_run",
    _resumed,
    f"""{_RUN}, old AS (SELECT * FROM r WHERE doc_id::BIGINT % 3 > 0 AND error IS NULL), new AS (SELECT doc_id, question, arm, 0.5e0 AS p_positive, NULL AS error FROM r WHERE doc_id::BIGINT % 3 < 2 AND (doc_id, question, arm) NOT IN (SELECT (doc_id, question, arm) FROM old)),
    a AS (SELECT doc_id, question, arm, p_positive FROM old UNION ALL SELECT doc_id, question, arm, p_positive FROM new) SELECT question, arm, count(*) AS n, count(*) FILTER (p_positive = 0.5e0) AS n_half, 0::BIGINT AS n_failed FROM a GROUP BY ALL""",
)


def _lines_of(spark, rows, name):
    path = f"{scratch_dir(spark)}/{name}"
    rows.write.text(path)
    return path


def _qrels(spark, sf):
    g, docid = D.gold(spark, sf), F.concat(F.lit("d"), F.col("doc_id").cast("string"))  # a bare 0 would read as the sampled layout
    line = F.when(F.col("question") == "toxic", F.concat_ws(" ", F.lit("007"), F.lit("0"), docid, "gold", F.lit("0.25"))).otherwise(F.concat_ws("  ", F.lit("12"), docid, "gold", F.lit("f1")))
    return R.read_qrels(spark, _lines_of(spark, g.select(line.alias("value")), "qrels"))


register("src10_qrels", _qrels, f"WITH {ctes()} SELECT CASE question WHEN 'toxic' THEN '7' ELSE '12' END AS topic, 'd' || doc_id AS docid, gold::INT AS rel, CASE question WHEN 'toxic' THEN 0.25e0 ELSE 1.0e0 END AS p_select FROM gold")
register(
    "src9_topics",
    lambda s, sf: R.read_topics(s, _lines_of(s, table(s, sf, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit("   "), "n_name", F.lit(" -- of region "), F.col("n_regionkey").cast("string")).alias("value")), "topics")),
    "SELECT n_nationkey::VARCHAR AS topic, n_name AS title, 'of region ' || n_regionkey AS description FROM nation",
)


# Headers and names.
def _header_texts(spark, sf):
    rows = _messages(spark, sf).where("h is not null")
    text = F.concat_ws("\n", F.concat(F.lit("From: "), F.col("h.from")), F.concat(F.lit("To: "), F.replace("h.to", F.lit("; "), F.lit(";\n  "))), F.concat(F.lit("Subject: "), F.col("h.subject")), F.lit("\nbody"))
    return rows.select("doc_id", text.alias("text"))


register(
    "txt35_header_fields",
    lambda s, sf: C.header_fields(_header_texts(s, sf)),
    f"""WITH {_FIELDS} SELECT doc_id, 'from' AS field, "from" AS value FROM fields UNION ALL SELECT doc_id, 'to', "to" FROM fields UNION ALL SELECT doc_id, 'subject', trim(subject) FROM fields""",
)
register(
    "txt36_address_names",
    lambda s, sf: table(s, sf, "customer").select("c_custkey", F.explode(X.address_names(F.concat(F.lit('"Lee, '), F.translate("c_mktsegment", "0123456789", ""), F.lit('" <x@y.org>; bo '), F.translate("c_mktsegment", "0123456789", ""), F.lit(" (x), z@y")))).alias("name")),
    "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Lee' AS name FROM customer UNION ALL SELECT c_custkey, 'Bo ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) FROM customer",
)
