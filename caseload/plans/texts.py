"""Registered queries on text: lexical scores, document frequencies, boilerplate, overlap, spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseload.functions import text as T
from caseload.operators import corpus as C
from caseload.plans.registry import register
from caseload.sources.derived import table

REQUEST = "Documents about the ering and thenshes license, other rights reserved with tional words"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "source")


_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def grams(n: int, source: str = _TOK) -> str:
    return f"list_transform(range(1, greatest(1, len({source}) - {n - 2})), lambda i: array_to_string(({source})[i:i + {n - 1}], ' '))"


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TERMS = f"list_filter(list_distinct(regexp_extract_all(lower('{REQUEST}'), '[a-z][a-z0-9\\-]{{3,}}')), lambda t: t NOT IN ({_STOP}))"
register(
    "txt2_lexical_score",
    lambda s, sf: docs(s, sf).select("doc_id", T.lexical_score(T.terms(F.lit(REQUEST)), F.col("text")).alias("p")),
    f"""WITH q AS (SELECT {_TERMS} AS t), h AS (SELECT doc_id, len(list_intersect(t, list_distinct({_TOK})))::DOUBLE AS h, greatest(len(t), 1) AS n FROM documents CROSS JOIN q)
    SELECT doc_id, greatest(0.001e0, least(0.999e0, 1 - exp(-(h / 4 + 2 * (h / n))))) AS p FROM h""",
)
register(
    "txt20_document_frequency",
    lambda s, sf: C.key_frequency(C.one_of_each_body(docs(s, sf)), 8).groupBy("df").agg(F.count("*").alias("n_grams")),
    f"""WITH b AS (SELECT first(text ORDER BY doc_id) AS text FROM documents GROUP BY md5(array_to_string({_TOK}, ' '))), w AS (SELECT {_TOK} AS w FROM b), g AS (SELECT unnest(list_distinct({grams(8, 'w')})) AS gram FROM w),
    d AS (SELECT gram, count(*) AS df FROM g GROUP BY ALL) SELECT df, count(*) AS n_grams FROM d GROUP BY ALL""",
)
register(
    "txt21_lexicon",
    lambda s, sf: C.lexicon(docs(s, sf)),
    f"WITH w AS (SELECT source, unnest(list_distinct({_TOK})) AS word FROM documents), c AS (SELECT source, word FROM w GROUP BY ALL HAVING count(*) >= 3) SELECT DISTINCT word FROM c",
)
register(
    "txt19_recurrence",
    lambda s, sf: C.recurrence(docs(s, sf)),
    f"""WITH w AS (SELECT doc_id, {_TOK} AS w FROM documents), g0 AS (SELECT doc_id, {grams(8, 'w')} AS gs FROM w), g AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(0, len(gs))) AS pos FROM g0),
    df AS (SELECT gram FROM g GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3), sh AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM g SEMI JOIN df USING (gram)),
    r AS (SELECT doc_id, island, count(*) AS k FROM sh GROUP BY ALL), m AS (SELECT doc_id, sum(k) AS n_shared, max(k) + 7 AS longest FROM r GROUP BY ALL)
    SELECT doc_id, len(gs) AS n_grams, coalesce(n_shared, 0) AS n_shared, coalesce(longest, 0) AS longest FROM g0 LEFT JOIN m USING (doc_id)""",
)
register(
    "txt32_unknown_words",
    lambda s, sf: C.words_unknown_everywhere(docs(s, sf)),
    f"""WITH w AS (SELECT doc_id, source, unnest(list_distinct({_TOK})) AS word FROM documents), lex AS (SELECT DISTINCT word FROM (SELECT source, word FROM w GROUP BY ALL HAVING count(*) >= 3))
    SELECT doc_id, count(*) AS n_words, count(*) FILTER (word NOT IN (SELECT word FROM lex)) AS n_unknown FROM w GROUP BY ALL""",
)
register(
    "txt34_body_keys",
    lambda s, sf: docs(s, sf).groupBy(T.body_key(F.col("text")).alias("body")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")),
    f"SELECT md5(array_to_string({_TOK}, ' ')) AS body, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
)
_ROWS = "list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 0)"
_WEAK = " + ".join(f"contains(low, '{p}')::INT" for p in ["confidential", "intended recipient", "privileged", "unauthorized", "delete", "notify the sender", "disclosure"])
_TRI = grams(3, "w")
register(
    "txt23_boilerplate_rules",
    lambda s, sf: docs(s, sf).select("doc_id", F.array_join(T.boilerplate_rules(F.col("text")), ",").alias("rules")),
    f"""WITH a AS (SELECT doc_id, text, lower(text) AS low, {_TOK} AS w, {_ROWS} AS rows FROM documents), b AS (SELECT *, {_TRI} AS tri, greatest(len(rows), 1) AS n FROM a)
    SELECT doc_id, concat_ws(',', CASE WHEN contains(low, 'all rights reserved') OR {_WEAK} >= 4 THEN 'disclaimer' END, CASE WHEN regexp_matches(low, 'unsubscribe|mailing list') THEN 'list_footer' END,
    CASE WHEN regexp_matches(low, '-----original message-----|forwarded by') THEN 'quoted_header' END, CASE WHEN regexp_matches(low, 'scanned (by|for)|virus-free') THEN 'scan_notice' END,
    CASE WHEN len(tri) >= 20 AND len(list_distinct(tri)) < 0.6e0 * len(tri) THEN 'repetitive' END,
    CASE WHEN len(rows) >= 3 AND len(list_filter(rows, lambda x: regexp_matches(x, '^\\s*[A-Za-z ]{{1,30}}:\\s')))::DOUBLE / n >= 0.6e0 THEN 'key_values' END,
    CASE WHEN len(rows) >= 2 AND len(list_filter(rows, lambda x: regexp_matches(x, '(\\s\\|\\s.*){{2,}}')))::DOUBLE / n >= 0.5e0 THEN 'tabular' END, CASE WHEN len(w) < 8 THEN 'thin' END) AS rules FROM b""",
)
register(
    "txt49_faithful",
    lambda s, sf: docs(s, sf).select("doc_id", T.faithful(F.col("text"), F.regexp_replace("text", "the", "a")).alias("keeps_all"), T.faithful(F.col("text"), F.regexp_replace("text", "7", "8")).alias("keeps_swapped")),
    """WITH n AS (SELECT doc_id, text, replace(text, 'the', 'a') AS x, replace(text, '7', '8') AS y FROM documents), f AS (SELECT doc_id, list_sort(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*')) AS a, list_sort(regexp_extract_all(x, '\\d+(?:[.,]\\d+)*')) AS b,
    list_sort(regexp_extract_all(y, '\\d+(?:[.,]\\d+)*')) AS c, length(x)::DOUBLE / greatest(length(text), 1) AS rx, length(y)::DOUBLE / greatest(length(text), 1) AS ry FROM n)
    SELECT doc_id, a = b AND rx BETWEEN 0.5e0 AND 2.0e0 AS keeps_all, a = c AND ry BETWEEN 0.5e0 AND 2.0e0 AS keeps_swapped FROM f""",
)


def _benchmark_overlap(spark, sf):
    """Benchmark passages against documents that hold one of their 8-grams: longest common subsequence and run."""
    b = table(spark, sf, "benchmark").select("item_id", T.tokens(F.col("text")).alias("a"))
    d = docs(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("b"))
    keys = b.select("item_id", F.explode(F.array_distinct(T.ngrams(F.col("a"), 8))).alias("gram"))
    held = d.select("doc_id", F.explode(F.array_distinct(T.ngrams(F.col("b"), 8))).alias("gram"))
    met = held.join(keys, "gram").select("item_id", "doc_id").distinct()
    return met.join(b, "item_id").join(d, "doc_id").select("item_id", "doc_id", T.overlap("a", "b").alias("o")).select("item_id", "doc_id", "o.*")


register("txt5_benchmark_overlap", _benchmark_overlap)
register("bld20_segments", lambda s, sf: docs(s, sf).select("doc_id", F.posexplode(T.segments("text")).alias("k", "s")).select("doc_id", "k", "s.start", "s.stop"))
register(
    "txt43_renamed",
    lambda s, sf: docs(s, sf).select("doc_id", T.renamer({"the": "lae", "and": "ond", "license": "permit"})("text").alias("text")).select("doc_id", T.count_hits(F.col("text"), ["lae", "ond", "permit"]).cast("long").alias("dose"), T.count_hits(F.col("text"), ["the", "license"]).cast("long").alias("left")),
)
register(
    "txt44_dose",
    lambda s, sf: docs(s, sf).select("doc_id", T.count_hits(F.col("text"), ["the", "and", "license"]).cast("long").alias("dose")),
    "SELECT doc_id, len(regexp_extract_all(lower(text), '\\b(the|and|license)\\b')) AS dose FROM documents",
)
register(
    "txt12_phrase_hits",
    lambda s, sf: docs(s, sf).select("doc_id", T.phrase_hit(F.col("text"), "of the").alias("hit"), T.groups_found(F.col("text"), [["license", "rights"], ["password", "akia"], ["tion"]]).alias("share")),
    """SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])of[^a-z0-9]+the($|[^a-z0-9])') AS hit,
    ((contains(lower(text), 'license') OR contains(lower(text), 'rights'))::INT + (contains(lower(text), 'password') OR contains(lower(text), 'akia'))::INT + contains(lower(text), 'tion')::INT) / 3.0e0 AS share FROM documents""",
)
register(
    "src13_tidied",
    lambda s, sf: docs(s, sf).select("doc_id", F.md5(T.tidy(T.without_headers(F.col("text"))).cast("binary")).alias("key")),
    "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^X-[A-Za-z-]+:.*\\n?', '', 'g'), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS key FROM documents",
)
