"""Registered queries on scope, manifests, drawn sets, and probes of what moves a scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import probes as B
from caseload.operators import scope as C
from caseload.plans.quality import wilson, zero
from caseload.plans.registry import register
from caseload.plans.study import _pairs_sql, pairs
from caseload.sources import derived as D
from caseload.sources.derived import ctes, predictions, table, u

MULTI = "arm = 'multi' AND model = 'mid' AND NOT error"
_PAIRS = _pairs_sql()


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _asked(spark):
    return C.subset(D.questions(spark), ["toxic"])


# Scope and binding.
register("bld2_subset", lambda s, sf: predictions(s, sf).join(C.subset(D.questions(s), ["toxic", "quality", "absent"]), "question").groupBy("question", "ordinal").agg(F.count("*").alias("n")), f"WITH {ctes()} SELECT question, CASE question WHEN 'toxic' THEN 0 ELSE 1 END AS ordinal, count(*) AS n FROM predictions GROUP BY ALL")
register("bld3_in_scope", lambda s, sf: C.in_scope(_docs(s, sf), "source", ["src0", "src3"]).select("doc_id"), "SELECT doc_id FROM documents WHERE source IS NULL OR source NOT IN ('src0', 'src3')")
register("bld4_scored_questions", lambda s, sf: C.scored_questions(predictions(s, sf), _asked(s)).groupBy("model", "arm").agg(F.count("*").alias("n"), F.sum("label").alias("flagged")), f"WITH {ctes()} SELECT model, arm, count(*) AS n, sum(label) AS flagged FROM predictions WHERE question = 'toxic' GROUP BY ALL")


def _rebound(spark, sf):
    docs = C.in_scope(_docs(spark, sf), "source", ["src0"])
    rows, calls = C.rebind(predictions(spark, sf), docs, _asked(spark), D.gold(spark, sf))
    paid = calls.groupBy("model", "arm").agg(F.count("*").alias("n_calls"), F.sum("cost").alias("paid"))
    return rows.groupBy("model", "arm").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == 1).alias("n_pos"), F.count_if("gray").alias("n_gray"), F.count_if(F.col("gold") == F.col("label")).alias("n_right")).join(paid, ["model", "arm"])


register(
    "bld5_rebound",
    _rebound,
    f"""WITH {ctes()}, c AS (SELECT * FROM predictions WHERE source IS NULL OR source <> 'src0'), t AS (SELECT model, arm, count(*) AS n_calls, sum(cost) AS paid FROM c GROUP BY ALL)
    SELECT model, arm, count(*) AS n, count(*) FILTER (gold = 1) AS n_pos, count(*) FILTER (gray) AS n_gray, count(*) FILTER (coalesce(gold, 0) = label) AS n_right, any_value(n_calls) AS n_calls, any_value(paid) AS paid
    FROM c JOIN t USING (model, arm) WHERE question = 'toxic' GROUP BY model, arm""",
)


def _aligned(spark, sf):
    before = D.gold(spark, sf).select(F.col("question").alias("topic"), "doc_id", F.when(~F.col("gray"), F.col("gold")).alias("rel"))
    after = predictions(spark, sf).where("arm = 'multi' and model = 'large' and not error and gold is not null").select(F.col("question").alias("topic"), "doc_id", F.when(~F.col("p").between(0.45, 0.55), F.col("label")).alias("rel"))
    return C.aligned_judgments(before, after)


_ALIGNED = f"""WITH {ctes()}, b AS (SELECT question AS topic, doc_id, CASE WHEN NOT gray THEN gold END AS pre, true AS bb FROM gold),
a AS (SELECT question AS topic, doc_id, CASE WHEN NOT p BETWEEN 0.45e0 AND 0.55e0 THEN label END AS post, true AS aa FROM predictions WHERE arm = 'multi' AND model = 'large' AND NOT error AND gold IS NOT NULL),
al AS (SELECT topic, doc_id, pre, post, CASE WHEN bb AND aa THEN 'both' WHEN bb THEN 'before' ELSE 'after' END AS side FROM b FULL JOIN a USING (topic, doc_id))"""
register("bld17_aligned", _aligned, f"{_ALIGNED} SELECT * FROM al")
register(
    "bld19_topic_summary",
    lambda s, sf: C.topic_summary(_aligned(s, sf), _docs(s, sf)),
    f"""{_ALIGNED} SELECT topic, count(*) AS n, count(*) FILTER (post = 1) AS n_pos, count(*) FILTER (post IS NULL) AS n_gray, count(*) FILTER (pre <> post) AS n_appealed,
    count(*) FILTER (coalesce(length(text), 0) = 0) AS n_no_text, count(*) FILTER (side <> 'both') AS n_mismatched FROM al LEFT JOIN documents USING (doc_id) GROUP BY topic""",
)
_HASHED = u("'manifest'", "doc_id")
register("bld26_finalized", lambda s, sf: C.finalized(_docs(s, sf).select("doc_id"), "doc_id", "DOC").select("doc_id", "number", "item"), f"SELECT doc_id, row_number() OVER w AS number, 'DOC-' || CASE WHEN row_number() OVER w > 99999 THEN (row_number() OVER w)::VARCHAR ELSE lpad((row_number() OVER w)::VARCHAR, 5, '0') END AS item FROM documents WINDOW w AS (ORDER BY {_HASHED}, doc_id)")
register(
    "bld27_manifest_stats",
    lambda s, sf: C.manifest_stats(_docs(s, sf), D.gold(s, sf), ["lang", "source"]),
    f"""WITH {ctes()}, pos AS (SELECT * FROM gold WHERE gold = 1 AND doc_id IN (SELECT doc_id FROM documents)), k AS (SELECT doc_id, count(*) AS k FROM pos GROUP BY ALL)
    SELECT 'question' AS field, question AS value, count(*) AS n FROM pos GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL
    UNION ALL SELECT 'labels', coalesce(k, 0)::VARCHAR, count(*) FROM documents LEFT JOIN k USING (doc_id) GROUP BY ALL""",
)
register("bld39_training_items", lambda s, sf: C.training_items(D.gold(s, sf)), f"WITH {ctes()}, t AS (SELECT *, CASE WHEN gray THEN 0.7e0 ELSE 0.97e0 END AS sure FROM gold) SELECT doc_id, question, gold AS label, CASE WHEN gold = 1 THEN 1 - sure ELSE 1 - (1 - sure) END AS target_no, CASE WHEN gold = 1 THEN sure ELSE 1 - sure END AS target_yes FROM t")

# Drawn sets.
_PILOT = u("'pilot'", "doc_id")
register(
    "smp1_least_positives",
    lambda s, sf: C.least_positives(D.gold(s, sf), _docs(s, sf), list(D.QUESTIONS), 60, 8),
    f"""WITH {ctes()}, q AS (SELECT doc_id, 'quality' AS claim FROM gold WHERE question = 'quality' AND gold = 1 ORDER BY {_PILOT}, doc_id LIMIT 8),
    t AS (SELECT doc_id, 'toxic' AS claim FROM gold WHERE question = 'toxic' AND gold = 1 AND doc_id NOT IN (SELECT doc_id FROM q) ORDER BY {_PILOT}, doc_id LIMIT 8), a AS (SELECT * FROM q UNION ALL SELECT * FROM t),
    f AS (SELECT doc_id, 'fill' AS claim, row_number() OVER (ORDER BY {_PILOT}, doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a))
    SELECT * FROM a UNION ALL SELECT doc_id, claim FROM f WHERE r + (SELECT count(*) FROM a) <= 60""",
)


def _claims(spark, sf):
    g, docs = D.gold(spark, sf), _docs(spark, sf)
    pools = [("pos:toxic", g.where("question = 'toxic' and gold = 1"), 20), ("pos:quality", g.where("question = 'quality' and gold = 1"), 20), ("hard_neg", g.where("gold = 0"), 30), ("random", docs, 30)]
    return C.first_claim(pools, docs.where("n_chars <= 3000"))


def _claim_sql(name: str, pool: str, k: int, before: list[str]) -> str:
    out = "".join(f" AND doc_id NOT IN (SELECT doc_id FROM {b})" for b in before)
    return f"""(SELECT doc_id, '{name}' AS stratum FROM (SELECT DISTINCT doc_id FROM {pool}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars <= 3000){out} ORDER BY {u("'eval'", f"'{name}'", 'doc_id')}, doc_id LIMIT {k})"""


register(
    "smp5_first_claim",
    _claims,
    f"""WITH {ctes()}, s1 AS {_claim_sql('pos:toxic', "gold WHERE question = 'toxic' AND gold = 1", 20, [])}, s2 AS {_claim_sql('pos:quality', "gold WHERE question = 'quality' AND gold = 1", 20, ['s1'])},
    s3 AS {_claim_sql('hard_neg', 'gold WHERE gold = 0', 30, ['s1', 's2'])}, s4 AS {_claim_sql('random', 'documents', 30, ['s1', 's2', 's3'])}
    SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4""",
)
register("smp6_remaining", lambda s, sf: C.remaining(_docs(s, sf), D.table(s, sf, "labels"), 12000).select("doc_id"), "SELECT doc_id FROM documents WHERE n_chars <= 12000 AND doc_id NOT IN (SELECT doc_id FROM labels)")
register(
    "smp14_keyword_strata",
    lambda s, sf: C.keyword_strata(_docs(s, sf), "tion", "ung").groupBy("stratum").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")),
    "SELECT CASE WHEN lower(text) LIKE '%tion%' THEN 'first' WHEN lower(text) LIKE '%ung%' THEN 'second' ELSE 'other' END AS stratum, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE length(trim(coalesce(text, ''))) > 0 GROUP BY ALL",
)
register(
    "smp21_examples",
    lambda s, sf: C.examples(D.gold(s, sf), _docs(s, sf), 2500),
    f"WITH {ctes()} SELECT question, gold, doc_id, n_chars FROM gold JOIN documents USING (doc_id) WHERE NOT gray AND n_chars <= 2500 QUALIFY row_number() OVER (PARTITION BY question, gold ORDER BY n_chars DESC, doc_id) = 1",
)

# Comparisons.
register(
    "jon14_against_coding",
    lambda s, sf: C.against_coding(predictions(s, sf).where("not error"), D.table(s, sf, "labels").select("doc_id", F.greatest("quality", "toxic").alias("code")), ["model", "arm"]),
    f"""WITH {ctes()}, d AS (SELECT model, arm, doc_id, max(label) AS flag, any_value(code) AS code FROM predictions JOIN (SELECT doc_id, greatest(quality, toxic) AS code FROM labels) USING (doc_id) WHERE NOT error GROUP BY ALL),
    s AS (SELECT model, arm, count(*) FILTER (flag = 1 AND code = 1) AS tp, count(*) FILTER (flag = 1 AND code = 0) AS fp, count(*) FILTER (flag = 0 AND code = 1) AS fn, count(*) FILTER (flag = 0 AND code = 0) AS tn FROM d GROUP BY ALL)
    SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, (tp + fp)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS flag_rate FROM s""",
)


def _side(spark, sf, salt):
    return predictions(spark, sf, salt).where(MULTI)


register(
    "jon16_compared",
    lambda s, sf: C.compared(_side(s, sf, "p"), _side(s, sf, "renamed"), D.gold(s, sf).where("not gray")),
    f"""WITH {ctes()}, n AS (SELECT doc_id, question, label AS x, p AS px FROM predictions WHERE {MULTI}), r AS (WITH {ctes('renamed')} SELECT doc_id, question, label AS y, p AS py FROM predictions WHERE {MULTI}),
    j AS (SELECT n.*, y, py, g.gold FROM n JOIN r USING (doc_id, question) LEFT JOIN (SELECT * FROM gold WHERE NOT gray) g USING (doc_id, question))
    SELECT question, count(gold) AS n_pairs, count(*) - count(gold) AS n_unscored, count(*) FILTER (gold IS NOT NULL AND x <> y) AS n_changed, count(*) FILTER (gold IS NOT NULL AND x <> y)::DOUBLE / nullif(count(gold), 0) AS changed_share,
    count(*) FILTER (gold IS NOT NULL AND x <> y AND abs(px - 0.5e0) < 0.1e0)::DOUBLE / nullif(count(*) FILTER (gold IS NOT NULL AND x <> y), 0) AS near_share, avg(abs(py - px)) FILTER (gold IS NOT NULL AND x <> y) AS mean_shift_changed FROM j GROUP BY question""",
)
register(
    "jon17_preferred",
    lambda s, sf: C.preferred(predictions(s, sf).where("not error"), ["single", "multi"]),
    f"WITH {ctes()} SELECT model, doc_id, question, arm, label, p FROM predictions WHERE NOT error QUALIFY row_number() OVER (PARTITION BY model, doc_id, question ORDER BY CASE arm WHEN 'single' THEN 1 ELSE 2 END) = 1",
)

# Probes.
_RATE = "avg(({0})::INT::DOUBLE)".format
register(
    "agg30_label_following",
    lambda s, sf: B.label_following(pairs(s, sf)),
    f"""{_PAIRS} SELECT gold, count(*) AS n, {_RATE('x = gold')} AS acc_original, {_RATE('y = gold')} AS followed, {_RATE('y <> gold')} AS read_edit, {_RATE('y = gold')} FILTER (x = gold) AS followed_given_right, avg(abs(py - px)) AS mean_shift
    FROM pairs GROUP BY GROUPING SETS ((gold), ())""",
)
register(
    "agg31_score_shift",
    lambda s, sf: B.score_shift(pairs(s, sf)),
    f"""{_PAIRS}, d AS (SELECT question, doc_id, abs(py - px) AS shift, (px >= 0.5e0) <> (py >= 0.5e0) AS flip FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY shift) - 1 AS i, count(*) OVER (PARTITION BY question) AS n FROM d),
    dd AS (SELECT question, count(*) AS n_docs, {_RATE('f')} AS doc_flip_rate FROM (SELECT question, doc_id, bool_or(flip) AS f FROM d GROUP BY ALL) GROUP BY ALL)
    SELECT question, any_value(n) AS n, avg(shift) AS mean_shift, quantile_cont(shift, 0.5) AS median_shift, max(shift) FILTER (i = floor(n * 0.9e0)::BIGINT) AS p90_shift, {_RATE('flip')} AS flip_rate, any_value(n_docs) AS n_docs, any_value(doc_flip_rate) AS doc_flip_rate
    FROM r JOIN dd USING (question) GROUP BY question""",
)
_SIM = u("'sim'", "doc_id")
register(
    "agg31_similarity_bands",
    lambda s, sf: B.shift_by_similarity(pairs(s, sf), S.uniform("sim", F.col("doc_id"))),
    f"""{_PAIRS} SELECT CASE WHEN {_SIM} < 0.6e0 THEN '<0.60' WHEN {_SIM} < 0.75e0 THEN '0.60-0.75' ELSE '>=0.75' END AS band, count(DISTINCT doc_id) AS n_docs, avg(abs(py - px)) AS mean_shift, {_RATE('(px >= 0.5e0) <> (py >= 0.5e0)')} AS flip_rate FROM pairs GROUP BY ALL""",
)
register(
    "agg33_text_following",
    lambda s, sf: B.text_following(pairs(s, sf).join(_docs(s, sf).select("doc_id", "lang"), "doc_id"), "lang"),
    f"""{_PAIRS}, d AS (SELECT pairs.*, lang FROM pairs JOIN documents USING (doc_id)) SELECT gold, lang, count(*) AS n, {_RATE('x = gold')} AS follow_factual, {_RATE('y = 1 - gold')} AS follow_counterfactual, {_RATE('x = gold AND y = 1 - gold')} AS follow_both,
    1 - {_RATE('y = 1 - gold')} AS knowledge_following, avg(abs(py - (1 - gold))) AS mean_distance FROM d GROUP BY GROUPING SETS ((gold), (lang), ())""",
)


def _answers(spark, sf):
    dose = F.floor(6 * S.uniform("dose", F.col("doc_id"))).cast("int")
    return _docs(spark, sf).where("text is not null").select("doc_id", F.col("text").alias("answer"), dose.alias("dose"))


_ANSWERS = f"WITH a AS (SELECT doc_id, text AS answer, floor(6 * {u(chr(39) + 'dose' + chr(39), 'doc_id')})::INT AS dose FROM documents WHERE text IS NOT NULL)"
register(
    "agg36_named_share",
    lambda s, sf: B.named_share(_answers(s, sf), "tion", "the", "dose"),
    f"""{_ANSWERS}, b AS (SELECT *, CASE WHEN dose = 0 THEN '0' WHEN dose <= 2 THEN '1-2' ELSE '3+' END AS band FROM a)
    SELECT band, count(*) AS n, count(*) FILTER (contains(lower(answer), 'tion')) AS n_named, count(*) FILTER (contains(substr(lower(answer), 1, 80), 'the')) AS n_unsure FROM b GROUP BY ROLLUP (band)""",
)
register(
    "agg36_top_guesses",
    lambda s, sf: B.top_guesses(_answers(s, sf), 6),
    f"""{_ANSWERS}, g AS (SELECT trim(split_part(split_part(substr(split_part(trim(answer), chr(10), 1), 1, 60), '.', 1), ' (', 1)) AS guess FROM a) SELECT guess, count(*) AS n FROM g GROUP BY ALL ORDER BY n DESC, guess LIMIT 6""",
)


def _metadata(spark, sf):
    v = predictions(spark, sf).where("arm = 'multi' and not error and gold is not null")
    at = v.groupBy("doc_id", "question", "gold").agg(*[F.max(F.when(F.col("model") == m, F.col("label"))).alias(c) for m, c in (("large", "whole"), ("mid", "part"), ("small", "lexical"))])
    return at.where("whole is not null and part is not null and lexical is not null")


_WL, _WH = wilson("count(*) FILTER (whole = gold)", "count(*)")
register(
    "agg41_metadata_stats",
    lambda s, sf: B.metadata_stats(_metadata(s, sf), "question"),
    f"""WITH {ctes()}, m AS (SELECT doc_id, question, gold, max(label) FILTER (model = 'large') AS whole, max(label) FILTER (model = 'mid') AS part, max(label) FILTER (model = 'small') AS lexical FROM predictions WHERE arm = 'multi' AND NOT error AND gold IS NOT NULL
      GROUP BY ALL HAVING count(DISTINCT model) = 3) SELECT question, count(*) AS n, {_RATE('whole = gold')} AS acc_whole, {_RATE('part = gold')} AS acc_part, {_RATE('lexical = gold')} AS acc_lexical, {_RATE('whole = gold')} - {_RATE('part = gold')} AS delta,
    {_WL} AS whole_low, {_WH} AS whole_high, {_RATE('whole = 1')} AS yes_whole, count(*) FILTER (whole = gold AND part <> gold) AS fixed, count(*) FILTER (part = gold AND whole <> gold) AS broken FROM m GROUP BY ROLLUP (question)""",
)


def _cell(v: str, a: int, g: int) -> str:
    return f"count(*) FILTER ({v} = {a} AND gold = {g})"


def _of(v: str) -> dict[str, str]:
    tp, fp, fn = _cell(v, 1, 1), _cell(v, 1, 0), _cell(v, 0, 1)
    return {"precision": f"{tp}::DOUBLE / nullif({tp} + {fp}, 0)", "recall": f"{tp}::DOUBLE / nullif({tp} + {fn}, 0)", "f1": zero(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), "accuracy": _RATE(f"{v} = gold")}


_AL, _AH = wilson("count(*) FILTER (x = gold)", "count(*)")
register(
    "agg64_subset_block",
    lambda s, sf: B.subset_block(pairs(s, sf), S.uniform("known", F.col("doc_id")) < 0.4),
    f"""{_PAIRS} SELECT {u(chr(39) + 'known' + chr(39), 'doc_id')} < 0.4e0 AS inside, count(*) AS n, count(*) FILTER (gold = 1) AS pos, {', '.join(f'{e} AS named_{k}' for k, e in _of('x').items())}, {', '.join(f"{_of('y')[k]} - {e} AS d_{k}" for k, e in _of('x').items())},
    {_AL} AS accuracy_low, {_AH} AS accuracy_high, count(*) FILTER (x = gold AND y <> gold) AS right_to_wrong, count(*) FILTER (x <> gold AND y = gold) AS wrong_to_right FROM pairs GROUP BY ALL""",
)
_PRICE = {m: a for m, _, a, _ in D.MODELS}
register(
    "agg66_projected_spend",
    lambda s, sf: B.projected_spend(predictions(s, sf).where("arm = 'multi' and not error"), 850, F.when(F.col("model") == "small", _PRICE["small"]).when(F.col("model") == "mid", _PRICE["mid"]).otherwise(_PRICE["large"])),
    f"""WITH {ctes()}, s AS (SELECT model, count(DISTINCT doc_id) AS calls, sum(input_tokens) AS t, sum(cost) AS paid, CASE model WHEN 'small' THEN {_PRICE['small']}e0 WHEN 'mid' THEN {_PRICE['mid']}e0 ELSE {_PRICE['large']}e0 END AS price FROM predictions WHERE arm = 'multi' AND NOT error GROUP BY model)
    SELECT model, calls, paid, 1 + calls * 850::DOUBLE / greatest(1, t) AS scale, paid + calls * 850 * price / 1e6 AS projected FROM s""",
)
register(
    "agg69_corpus_stats",
    lambda s, sf: B.corpus_stats(_docs(s, sf), "source"),
    """WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL)
    SELECT 'source' AS field, source AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'languages', NULL, count(DISTINCT lang) FROM documents UNION ALL SELECT 'median_chars', NULL, n_chars FROM r WHERE i = n // 2""",
)
