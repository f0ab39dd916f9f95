"""Registered queries on families, ranked runs, samples, joins, set operations and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import ensemble as E
from caseload.operators import families as A
from caseload.operators import gold as G
from caseload.operators import joins as J
from caseload.operators import quality as Q
from caseload.operators import retrieval as R
from caseload.operators import sampling as M
from caseload.plans.quality import HEAD
from caseload.plans.registry import register
from caseload.sources.derived import ctes, gold, predictions, table, u, votes

MID = "arm = 'multi' AND model = 'mid' AND gold IS NOT NULL AND NOT error"


# Families: conversations, whose first turn is the parent.
def items(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("family"), F.col("turn").alias("place"), F.length("text").cast("long").alias("chars"))
    key = (F.col("family"), F.col("place"))
    return c.withColumns({"gold": (S.uniform("fam", *key) < 0.2).cast("int"), "gray": S.uniform("fgray", *key) < 0.1}).withColumn("p", S.invented_probability(F.col("gold"), 2.0, "fp", *key)).withColumn("question", F.lit("any"))


_FK = ("family", "place")
ITEMS = f"""raw_items AS (SELECT conv_id AS family, turn AS place, length(text) AS chars FROM conversations),
gold_items AS (SELECT *, ({u("'fam'", *_FK)} < 0.2e0)::INT AS gold, {u("'fgray'", *_FK)} < 0.1e0 AS gray FROM raw_items),
items AS (SELECT *, 'any' AS question, floor(CASE WHEN gold = 1 THEN 1 - 0.98e0 * pow({u("'fp'", *_FK)}, 2.0e0) ELSE 0.98e0 * pow({u("'fp'", *_FK)}, 2.0e0) END * 1000 + 0.5e0) / 1000 AS p FROM gold_items)"""
UNITS = "fam AS (SELECT question, family, max(gold) AS gold, bool_and(gray) AS gray, max(p) AS p, sum(chars) AS chars, count(*) AS n, first(p ORDER BY place) AS parent_p FROM items GROUP BY question, family)"
_BUCKET = "CASE WHEN gray THEN 'open' WHEN gold = 1 AND p >= 0.5e0 THEN 'hit' WHEN gold = 1 THEN 'miss' WHEN p >= 0.5e0 THEN 'false_alarm' ELSE 'clear' END"
register("win25_inherited_scores", lambda s, sf: A.inherit_scores(items(s, sf), ["question", "family"]).select("family", "place", "p_inherited"), f"WITH {ITEMS} SELECT family, place, CASE WHEN place = 0 THEN max(p) OVER (PARTITION BY family) ELSE p END AS p_inherited FROM items")
register("win26_family_units", lambda s, sf: A.family_units(items(s, sf), ["question", "family"]), f"WITH {ITEMS}, {UNITS} SELECT * FROM fam")
register("agg48_population", lambda s, sf: A.population(A.family_units(items(s, sf), ["question", "family"])), f"WITH {ITEMS}, {UNITS}, b AS (SELECT question, {_BUCKET} AS bucket, count(*) AS n FROM fam GROUP BY ALL) SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY question) AS share FROM b")
register("agg49_histogram", lambda s, sf: A.histogram(predictions(s, sf), ["model", "arm", "question"]), f"WITH {ctes()} SELECT model, arm, question, least(9, floor(p * 10))::INT AS bin, count(*) AS n FROM predictions WHERE p IS NOT NULL GROUP BY ALL")
register(
    "agg47_contested",
    lambda s, sf: A.contested(votes(s, sf)),
    f"WITH {ctes()}, d AS (SELECT doc_id, question, sum(label) AS yes, count(*) AS n FROM predictions WHERE arm = 'multi' AND NOT error GROUP BY ALL) SELECT question, count(*) AS n, count(*) FILTER (2 * yes > n) AS n_pos, count(*) FILTER (yes > 0 AND yes < n) AS n_contested FROM d GROUP BY ALL",
)
register("win28_page", lambda s, sf: A.page(predictions(s, sf).where("arm = 'multi' and model = 'mid' and question = 'toxic' and not error").select("doc_id", "p"), [F.desc("p"), F.col("doc_id")], 200), f"WITH {ctes()} SELECT doc_id, p FROM predictions WHERE arm = 'multi' AND model = 'mid' AND question = 'toxic' AND NOT error ORDER BY p DESC, doc_id LIMIT 200")
register("src17_keyset_page", lambda s, sf: A.after_key(table(s, sf, "documents").select("doc_id", "source"), "doc_id", 99, 50), "SELECT doc_id, source FROM documents WHERE doc_id > 99 ORDER BY doc_id LIMIT 50")


# Ranked runs: a topic for each language; judgments sampled by hash.
def run_of(spark, sf):
    d = predictions(spark, sf).where("arm = 'multi' and model = 'mid' and question = 'quality' and not error")
    return d.select(F.col("lang").alias("topic"), F.format_string("%d.%d", F.floor(F.col("doc_id") / 3), F.col("doc_id") % 3).alias("docid"), F.col("p").alias("score"), F.col("source"))


def judgments_of(spark, sf):
    d = predictions(spark, sf).where("arm = 'multi' and model = 'mid' and question = 'quality' and gold is not null")
    docid = F.format_string("%d.%d", F.floor(F.col("doc_id") / 3), F.col("doc_id") % 3)
    w = S.uniform("strat", F.col("doc_id"))
    return d.select(F.col("lang").alias("topic"), docid.alias("docid"), F.col("gold").alias("rel"), F.when(w < 0.3, 0.1).when(w < 0.6, 0.25).otherwise(1.0).alias("p_select"))


_DOCID = "(doc_id // 3)::VARCHAR || '.' || (doc_id % 3)::VARCHAR"
_W = u("'strat'", "doc_id")
RUN = f"""WITH {ctes()}, q AS (SELECT *, {_DOCID} AS docid FROM predictions WHERE arm = 'multi' AND model = 'mid' AND question = 'quality'),
run AS (SELECT lang AS topic, docid, p AS score, source FROM q WHERE NOT error),
judg AS (SELECT lang AS topic, docid, gold AS rel, CASE WHEN {_W} < 0.3e0 THEN 0.1e0 WHEN {_W} < 0.6e0 THEN 0.25e0 ELSE 1.0e0 END AS p_select FROM q WHERE gold IS NOT NULL),
totals AS (SELECT topic, count(*) FILTER (rel > 0) AS n_rel, count(*) FILTER (rel = 0) AS n_non, coalesce(sum(1 / p_select) FILTER (rel > 0), 0) AS all_rel FROM judg GROUP BY ALL),
ranked AS (SELECT run.*, rel, p_select, row_number() OVER w AS rank, sum((coalesce(rel, 0) > 0)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS rels, sum((coalesce(rel, 1) = 0)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS nonrels
  FROM run LEFT JOIN judg USING (topic, docid) WINDOW w AS (PARTITION BY topic ORDER BY score DESC, docid DESC))"""
register(
    "win16_measures",
    lambda s, sf: R.measures(run_of(s, sf), judgments_of(s, sf)),
    f"""{RUN}, base AS (SELECT topic, first(n_rel) AS n_rel, count(*) FILTER (rel > 0) AS n_ret_rel, coalesce(sum(rels::DOUBLE / rank) FILTER (rel > 0) / nullif(first(n_rel), 0), 0) AS map,
    coalesce(count(*) FILTER (rel > 0 AND rank <= n_rel)::DOUBLE / nullif(first(n_rel), 0), 0) AS r_precision,
    coalesce(sum(1 - CASE WHEN least(n_rel, n_non) > 0 THEN least(nonrels, n_rel, n_non)::DOUBLE / least(n_rel, n_non) ELSE 0.0e0 END) FILTER (rel > 0) / nullif(first(n_rel), 0), 0) AS bpref,
    coalesce(1.0e0 / min(rank) FILTER (rel > 0), 0) AS recip_rank, count(*) FILTER (rel > 0 AND rank <= 5) / 5.0e0 AS p5, count(*) FILTER (rel > 0 AND rank <= 10) / 10.0e0 AS p10, count(*) FILTER (rel > 0 AND rank <= 100) / 100.0e0 AS p100,
    max((coalesce(rel, 0) > 0 AND rank <= 1)::INT) AS success1, max((coalesce(rel, 0) > 0 AND rank <= 10)::INT) AS success10, count(*) FILTER (rel IS NOT NULL AND rank <= 10) / 10.0e0 AS judged10 FROM ranked JOIN totals USING (topic) GROUP BY topic),
    lv AS (SELECT topic, level, max(rels::DOUBLE / rank) AS ip FROM ranked JOIN totals USING (topic) CROSS JOIN (SELECT unnest(range(0, 11)) AS level) WHERE rel > 0 AND rels >= level / 10.0e0 * n_rel - 1e-9 GROUP BY ALL),
    el AS (SELECT topic, sum(ip) / 11 AS eleven_point FROM lv GROUP BY ALL) SELECT base.*, coalesce(eleven_point, 0) AS eleven_point FROM base LEFT JOIN el USING (topic)""",
)
_DEPTHS = [10, 50, 200]
EST = f"""{RUN}, ks AS (SELECT unnest({_DEPTHS}) AS k), size AS (SELECT topic, count(*) AS n_ret FROM run GROUP BY ALL),
s AS (SELECT topic, k, coalesce(sum(1 / p_select) FILTER (rel > 0), 0) AS rel, coalesce(sum(1 / p_select) FILTER (rel = 0), 0) AS non FROM ranked CROSS JOIN ks WHERE rank <= k GROUP BY ALL),
e AS (SELECT s.*, greatest(0, all_rel - rel) AS missed, n_ret FROM s JOIN totals USING (topic) JOIN size USING (topic)),
pr AS (SELECT *, coalesce(rel / nullif(rel + non, 0), 0) AS precision, coalesce(rel / nullif(rel + missed, 0), 0) AS recall FROM e)"""
register(
    "win19_estimates",
    lambda s, sf: R.estimates(run_of(s, sf), judgments_of(s, sf), _DEPTHS),
    f"""{EST} SELECT topic, k, rel, non, missed, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, coalesce(rel / nullif(rel + non + missed, 0), 0) AS jaccard,
    coalesce(missed / nullif(missed + non, 0), 0) AS miss_share, least(k, n_ret) AS retrieved FROM pr""",
)
register(
    "win20_marginal_precision",
    lambda s, sf: R.marginal_precision(R.estimates(run_of(s, sf), judgments_of(s, sf), _DEPTHS)),
    f"{EST}, d AS (SELECT topic, k, rel - coalesce(lag(rel) OVER w, 0) AS dr, non - coalesce(lag(non) OVER w, 0) AS dn FROM pr WINDOW w AS (PARTITION BY topic ORDER BY k)) SELECT topic, k, dr / nullif(dr + dn, 0) AS marginal FROM d",
)
register(
    "win21_stratified_estimate",
    lambda s, sf: R.stratified_estimate(run_of(s, sf), judgments_of(s, sf), "source", _DEPTHS),
    f"""{RUN}, ks AS (SELECT unnest({_DEPTHS}) AS k), st AS (SELECT topic, k, source, count(*) AS n, count(rel) AS judged, count(*) FILTER (rel > 0) AS rel FROM ranked CROSS JOIN ks WHERE rank <= k GROUP BY ALL)
    SELECT topic, k, sum(coalesce(rel::DOUBLE / nullif(judged, 0), 0) * n) AS est_rel, sum(n) AS n FROM st GROUP BY ALL""",
)
register(
    "win23_rank_area",
    lambda s, sf: R.rank_area(run_of(s, sf), judgments_of(s, sf)),
    f"{RUN} SELECT topic, sum(rels) FILTER (rel = 0)::DOUBLE / (count(*) FILTER (rel > 0) * count(*) FILTER (rel = 0)) AS auc FROM ranked GROUP BY ALL",
)
register(
    "win24_messages",
    lambda s, sf: R.to_messages(run_of(s, sf)),
    f"{RUN} SELECT topic, split_part(docid, '.', 1) AS message, max(score) AS score, first(docid ORDER BY score DESC, docid DESC) AS docid FROM run GROUP BY topic, message",
)


# Samples.
def labelled(spark, sf):
    return predictions(spark, sf).where(MID).select("doc_id", "question", "source", "lang", "gold", "gray", "p")


LAB = f"{HEAD}, lab AS (SELECT * FROM predictions WHERE {MID})"
_KEEP = ["doc_id", "question"]
register("smp18_hash_sample", lambda s, sf: M.one_in(table(s, sf, "documents"), 16, "keep", F.col("doc_id")).select("doc_id"), f"SELECT doc_id FROM documents WHERE {u(chr(39) + 'keep' + chr(39), 'doc_id')} < 0.0625e0")
register("smp2_stratified", lambda s, sf: M.stratified(labelled(s, sf), ["question", "gold"], 25, "doc_id", first=F.col("gray")).select(*_KEEP, "place"), f"{LAB} SELECT doc_id, question, row_number() OVER w AS place FROM lab WINDOW w AS (PARTITION BY question, gold ORDER BY gray DESC, {u(chr(39) + 's' + chr(39), 'doc_id')}, doc_id) QUALIFY place <= 25")
register(
    "smp15_proportional",
    lambda s, sf: M.proportional(labelled(s, sf), ["question", "source"], 0.3, "doc_id").select(*_KEEP),
    f"{LAB} SELECT doc_id, question FROM lab QUALIFY row_number() OVER (PARTITION BY question, source ORDER BY {u(chr(39) + 'prop' + chr(39), 'doc_id')}, doc_id) <= floor(count(*) OVER (PARTITION BY question, source) * 0.3e0 + 0.5e0)",
)
register(
    "smp16_balanced",
    lambda s, sf: M.balanced(labelled(s, sf).where("question = 'toxic'"), "lang", "gold", 60, "doc_id").select("doc_id", "gold"),
    f"""{LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY lang, gold ORDER BY {u("'bal'", 'doc_id')}, doc_id) AS place FROM lab WHERE question = 'toxic')
    SELECT doc_id, gold FROM r WHERE place <= 30 QUALIFY row_number() OVER (PARTITION BY gold ORDER BY place, lang) <= 30""",
)
register(
    "smp4_round_robin",
    lambda s, sf: M.round_robin(labelled(s, sf).where("question = 'quality'"), "source", 50, "doc_id").select("doc_id", "place"),
    f"""{LAB}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {u("'rr'", 'doc_id')}, doc_id) AS place, count(*) OVER (PARTITION BY source) AS size FROM lab WHERE question = 'quality')
    SELECT doc_id, place FROM r ORDER BY place, size DESC, source LIMIT 50""",
)
register(
    "smp17_tiers",
    lambda s, sf: M.frequency_tiers(table(s, sf, "documents").select(F.explode(J.words(F.col("text"))).alias("name")), "name", 20, 50),
    """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS name FROM documents), c AS (SELECT name, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS place FROM c)
    SELECT name, n, CASE WHEN place <= 20 THEN 'top' WHEN place <= 70 THEN 'middle' ELSE 'tail' END AS tier FROM r WHERE place <= 70 OR n = 1""",
)
register("smp3_group_split", lambda s, sf: M.group_split(table(s, sf, "documents"), "source", 0.25).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_groups")), f"SELECT CASE WHEN {u(chr(39) + 'split' + chr(39), 'source')} < 0.25e0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT source) AS n_groups FROM documents GROUP BY 1")
register(
    "smp9_downsampled_pool",
    lambda s, sf: M.downsample_positives(labelled(s, sf).where("question = 'quality'"), "gold", 0.1, "doc_id").select("doc_id", "gold"),
    f"""{LAB}, q AS (SELECT * FROM lab WHERE question = 'quality'), n AS (SELECT count(*) FILTER (gold = 0) AS neg FROM q)
    SELECT doc_id, gold FROM q WHERE gold = 0 UNION ALL (SELECT doc_id, gold FROM q WHERE gold = 1 QUALIFY row_number() OVER (ORDER BY {u("'pool'", 'doc_id')}, doc_id) <= (SELECT round_even(neg * 0.1e0 / (1 - 0.1e0), 0) FROM n))""",
)


def _sides(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(gold(spark, sf).where("question = 'toxic'").select("doc_id", "gold"), "doc_id")
    return d.where("gold = 1"), d.where("gold = 0")


register(
    "smp19_nearest_twin",
    lambda s, sf: M.nearest_twin(*_sides(s, sf), "lang", "n_chars", "doc_id"),
    """WITH d AS (SELECT doc_id, lang, n_chars, toxic AS gold FROM documents JOIN labels USING (doc_id)), a AS (SELECT * FROM d WHERE gold = 1), b AS (SELECT * FROM d WHERE gold = 0),
    m AS (SELECT a.lang, a.doc_id, a.n_chars, b.doc_id AS twin, abs(a.n_chars - b.n_chars) AS gap, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(a.n_chars - b.n_chars), b.n_chars, CASE WHEN b.n_chars <= a.n_chars THEN -b.doc_id ELSE b.doc_id END) AS r FROM a JOIN b ON a.lang = b.lang)
    SELECT lang, doc_id, n_chars, twin, gap FROM m WHERE r = 1""",
)

# Joins and sets.
register("jon2_pending", lambda s, sf: J.pending_calls(predictions(s, sf).select("model", "arm", "doc_id", "question"), predictions(s, sf), ["model", "arm", "doc_id"], "question"), f"WITH {ctes()} SELECT model, arm, doc_id, count(*) AS n_missing FROM predictions WHERE error GROUP BY ALL")
register("jon4_common_keys", lambda s, sf: J.common_keys(predictions(s, sf).where("arm = 'multi' and not error"), "model", ["doc_id", "question"], 3), f"WITH {ctes()} SELECT doc_id, question FROM predictions WHERE arm = 'multi' AND NOT error GROUP BY ALL HAVING count(DISTINCT model) = 3")


def _spans(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    start = F.floor(S.uniform("a", F.col("doc_id"), F.col("k")) * F.col("n_chars")).cast("long")
    a = d.select("doc_id", start.alias("start"), (start + 1 + F.floor(400 * S.uniform("b", F.col("doc_id"), F.col("k")))).cast("long").alias("stop")).distinct()
    begin = F.floor(S.uniform("c", F.col("doc_id"), F.col("k")) * F.col("n_chars")).cast("long")
    b = d.where("k < 3").select("doc_id", begin.alias("from"), (begin + 1 + F.floor(600 * S.uniform("d", F.col("doc_id"), F.col("k")))).cast("long").alias("to"))
    return a, b


register(
    "bld22_labelled_spans",
    lambda s, sf: J.label_spans(*_spans(s, sf), ["doc_id"]),
    f"""WITH d AS (SELECT doc_id, n_chars, k FROM documents CROSS JOIN (SELECT unnest(range(0, 8)) AS k)), a0 AS (SELECT doc_id, k, floor({u("'a'", 'doc_id', 'k')} * n_chars)::BIGINT AS start FROM d),
    a AS (SELECT DISTINCT doc_id, start, (start + 1 + floor(400 * {u("'b'", 'doc_id', 'k')}))::BIGINT AS stop FROM a0), b0 AS (SELECT doc_id, k, floor({u("'c'", 'doc_id', 'k')} * n_chars)::BIGINT AS lo FROM d WHERE k < 3),
    b AS (SELECT doc_id, lo, (lo + 1 + floor(600 * {u("'d'", 'doc_id', 'k')}))::BIGINT AS hi FROM b0), m AS (SELECT a.*, least(stop, hi) - greatest(start, lo) AS shared, hi - lo AS len FROM a JOIN b ON a.doc_id = b.doc_id AND start < hi AND lo < stop),
    l AS (SELECT doc_id, start, stop, bool_or(2 * shared >= stop - start OR 2 * shared >= len) AS positive FROM m GROUP BY ALL)
    SELECT a.doc_id, a.start, a.stop, coalesce(positive, false)::INT AS label, coalesce(NOT positive, false) AS gray FROM a LEFT JOIN l USING (doc_id, start, stop)""",
)
TERMS = ["the of", "license", "all rights reserved", "with", "tion", "under the mit", "der die", "apache", "que", "thththth"]


def _found(spark, sf):
    return J.containing(table(spark, sf, "documents").select("doc_id", "text"), spark.createDataFrame([(t,) for t in TERMS], "term string"))


FOUND = f"""terms AS (SELECT unnest({TERMS}) AS term), t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM documents),
found AS (SELECT doc_id, term FROM t CROSS JOIN terms WHERE contains(t, ' ' || term || ' '))"""
register("jon10_containing", _found, f"WITH {FOUND} SELECT * FROM found")
register(
    "txt17_lift",
    lambda s, sf: J.lift(_found(s, sf), gold(s, sf).where("question = 'quality'").select("doc_id", "gold")),
    f"WITH {FOUND}, n AS (SELECT count(*) AS n, sum(quality) AS pos FROM labels), k AS (SELECT term, count(*) AS k, sum(quality) AS k_pos FROM found JOIN labels USING (doc_id) GROUP BY ALL) SELECT term, k, k_pos::BIGINT AS k_pos, (k_pos::DOUBLE / pos) / (k::DOUBLE / n) AS lift FROM k CROSS JOIN n",
)
register(
    "jon8_best_scores",
    lambda s, sf: J.best_scores(table(s, sf, "documents").select("doc_id"), predictions(s, sf).where(MID)),
    f"{LAB}, m AS (SELECT doc_id, max(p) AS p FROM lab GROUP BY ALL) SELECT d.doc_id, coalesce(p, 0) AS p FROM documents d LEFT JOIN m USING (doc_id)",
)
_FLAGGED = lambda s, sf, q: predictions(s, sf).where(f"{MID} and question = '{q}' and label = 1").select("doc_id")
register("set2_union", lambda s, sf: J.union_of([_FLAGGED(s, sf, q) for q in ("quality", "toxic")]), f"{LAB} SELECT DISTINCT doc_id FROM lab WHERE label = 1")
register("set1_intersection", lambda s, sf: _FLAGGED(s, sf, "quality").intersect(_FLAGGED(s, sf, "toxic")), f"{LAB} SELECT doc_id FROM lab WHERE label = 1 AND question = 'quality' INTERSECT SELECT doc_id FROM lab WHERE label = 1 AND question = 'toxic'")
register("set3_difference", lambda s, sf: _FLAGGED(s, sf, "quality").subtract(_FLAGGED(s, sf, "toxic")), f"{LAB} SELECT doc_id FROM lab WHERE label = 1 AND question = 'quality' EXCEPT SELECT doc_id FROM lab WHERE label = 1 AND question = 'toxic'")
register(
    "set4_key_mismatch",
    lambda s, sf: J.same_keys(predictions(s, sf).where("arm = 'multi' and model = 'mid' and not error").select("doc_id", "question"), predictions(s, sf).where("arm = 'single' and model = 'mid' and not error").select("doc_id", "question")),
    f"""WITH {ctes()}, a AS (SELECT doc_id, question FROM predictions WHERE arm = 'multi' AND model = 'mid' AND NOT error), b AS (SELECT doc_id, question FROM predictions WHERE arm = 'single' AND model = 'mid' AND NOT error)
    SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
register(
    "set6_carried_over",
    lambda s, sf: J.carried_over(predictions(s, sf).where("arm = 'multi' and model = 'mid' and lang = 'en' and question = 'toxic'").select("doc_id", "p"), predictions(s, sf).where("arm = 'single' and model = 'mid' and question = 'toxic'").select("doc_id", "p"), ["doc_id"]),
    f"WITH {ctes()}, t AS (SELECT * FROM predictions WHERE model = 'mid' AND question = 'toxic') SELECT doc_id, p FROM t WHERE arm = 'multi' AND lang = 'en' UNION ALL SELECT doc_id, p FROM t WHERE arm = 'single' AND lang IS DISTINCT FROM 'en'",
)
register(
    "bld28_near_key_dedup",
    lambda s, sf: G.keep_first(table(s, sf, "documents").select("doc_id", F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), 1, 300).alias("key")), ["key"], ["doc_id"]).select("doc_id"),
    "SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), 1, 300)",
)
register(
    "src15_latest_wins",
    lambda s, sf: G.keep_last(table(s, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]),
    "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
)
register("src28_group_limit", lambda s, sf: G.in_order(table(s, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3), "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY place <= 3")


# Ensembles: the panel's scores as phrasings and facets.
def _panel(spark, sf):
    v = predictions(spark, sf).where("arm = 'multi'")
    return v.groupBy("doc_id", "question").agg(F.max(F.when(F.col("model") == "small", F.col("p"))).alias("a"), F.max(F.when(F.col("model") == "mid", F.col("p"))).alias("b"), F.max(F.when(F.col("model") == "large", F.col("p"))).alias("c"))


_PANEL = "w AS (SELECT doc_id, question, max(p) FILTER (model = 'small') AS a, max(p) FILTER (model = 'mid') AS b, max(p) FILTER (model = 'large') AS c FROM predictions WHERE arm = 'multi' GROUP BY ALL)"
register(
    "ens1_planned_score",
    lambda s, sf: _panel(s, sf).where("a is not null and b is not null and c is not null").select("doc_id", "question", E.planned_score(F.array(F.array("a", "b"), F.array("c")), F.col("c")).alias("p")).withColumn("confidence", E.confidence(F.col("p"))),
    f"WITH {ctes()}, {_PANEL}, s AS (SELECT doc_id, question, greatest((a + b) / 2, c) * c AS p FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) SELECT *, abs(p - 0.5e0) * 2 AS confidence FROM s",
)
register("ens3_facets", lambda s, sf: _panel(s, sf).select("doc_id", "question", E.facet_score(F.array("a", "b", "c")).alias("p")), f"WITH {ctes()}, {_PANEL} SELECT doc_id, question, coalesce(greatest(a, b, c), 0.5e0) AS p FROM w")
register("ens2_max_pool", lambda s, sf: E.max_pool(predictions(s, sf).where("not error"), ["model", "arm", "doc_id"]), f"WITH {ctes()} SELECT model, arm, doc_id, max(p) AS p, count(*) AS n_windows FROM predictions WHERE NOT error GROUP BY ALL")
register(
    "ens4_recoded",
    lambda s, sf: gold(s, sf).select("doc_id", "question", E.recoded(F.col("gold"), 0.1, 0.02, "review", F.col("doc_id"), F.col("question")).alias("coded")),
    f"WITH {ctes()} SELECT doc_id, question, CASE WHEN gold = 1 THEN ({u(chr(39) + 'review' + chr(39), 'doc_id', 'question')} >= 0.1e0)::INT ELSE ({u(chr(39) + 'review' + chr(39), 'doc_id', 'question')} < 0.02e0)::INT END AS coded FROM gold",
)
register("agg16_full_review", lambda s, sf: Q.by_document(predictions(s, sf), ["model", "arm"]).groupBy("model", "arm").agg(F.count("*").alias("n_docs"), F.sum("gold").cast("long").alias("relevant"), F.sum("label").cast("long").alias("flagged"), F.count_if((F.col("gold") == 1) & (F.col("label") == 1)).alias("both")), f"{HEAD}, d AS (SELECT model, arm, doc_id, max(label) AS l, max(gold) AS g FROM judged GROUP BY ALL) SELECT model, arm, count(*) AS n_docs, sum(g) AS relevant, sum(l) AS flagged, count(*) FILTER (l = 1 AND g = 1) AS both FROM d GROUP BY ALL")
