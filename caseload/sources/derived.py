"""The study's relations, derived by Spark from the given tables: questions, gold, predictions, repeats, votes.

Each has a twin in DuckDB SQL (``CTES``) that gives the same rows, as both hash the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.functions import scalars as S

QUESTIONS = ("quality", "toxic")
#: model key, power of its invented score, list prices for a million tokens.
MODELS = (("small", 1.5, 0.1, 0.4), ("mid", 2.5, 0.5, 2.0), ("large", 4.0, 2.0, 8.0))
ARMS = ("multi", "single")
REPEATS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "ordinal int, question string")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, question, gold, gray): labels by question; gray marks debatable decisions."""
    labels = table(spark, sf_dir, "labels")
    long = labels.unpivot(["doc_id"], list(QUESTIONS), "question", "gold")
    return long.withColumn("gray", S.uniform("gray", F.col("doc_id"), F.col("question")) < 0.08)


def configurations() -> Column:
    return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(power).alias("power"), F.lit(pi).alias("price_in"), F.lit(po).alias("price_out"), F.lit(arm).alias("arm")) for m, power, pi, po in MODELS for arm in ARMS])


def predictions(spark: SparkSession, sf_dir: str, salt: str = "p") -> DataFrame:
    """The fact table: a row for each (model, arm, doc_id, question), with gold bound to it.

    Errors have null p and label. Documents without labels have null gold.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    units = docs.withColumn("question", F.explode(F.array(*map(F.lit, QUESTIONS)))).join(gold(spark, sf_dir), ["doc_id", "question"], "left")
    rows = units.withColumn("c", F.explode(configurations())).select("doc_id", "question", "lang", "source", "n_chars", "gold", F.coalesce("gray", F.lit(False)).alias("gray"), "c.*")
    key = (F.col("model"), F.col("arm"), F.col("question"), F.col("doc_id"))
    p = F.floor(F.when(F.coalesce("gold", F.lit(0)) == 1, 1 - 0.98 * F.pow(S.uniform(salt, *key), "power")).otherwise(0.98 * F.pow(S.uniform(salt, *key), "power")) * 1000 + 0.5) / 1000
    error = S.uniform("err", *key) < 0.01
    tokens = S.approx_tokens(F.col("n_chars"))
    cached = F.floor(tokens * 0.25 * S.uniform("cache", *key)).cast("long")
    out = (5 + F.floor(20 * S.uniform("out", *key))).cast("long")
    rows = rows.withColumns(
        {
            "p": F.when(~error, p),
            "error": error,
            "latency_ms": F.floor(100 + 900 * S.uniform("lat", *key)).cast("double"),
            "input_tokens": tokens,
            "cached_tokens": cached,
            "output_tokens": out,
            "mode": F.when(S.uniform("mode", *key) < 0.2, "batch").otherwise("standard"),
        }
    )
    flip = S.uniform("flip", *key) < 0.01
    listed = S.call_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(0), F.col("price_in"), F.col("price_out"))
    paid = S.call_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cached_tokens"), F.col("price_in"), F.col("price_out"), F.col("mode"))
    label = F.when(flip, (F.col("p") < 0.5).cast("int")).otherwise((F.col("p") >= 0.5).cast("int"))
    return rows.withColumns({"label": label, "list_cost": listed, "cost": paid}).drop("power", "price_in", "price_out")


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, question, run, label, p, gold, gray): one model asked ``REPEATS`` times."""
    units = gold(spark, sf_dir).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    base = S.invented_probability(F.col("gold"), 2.0, "rep", F.col("question"), F.col("doc_id"))
    shake = 0.2 * (S.uniform("shake", F.col("run"), F.col("question"), F.col("doc_id")) - 0.5)
    p = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(F.abs(base - 0.5) < 0.2, shake).otherwise(0.0))) * 1000 + 0.5) / 1000
    return units.withColumn("p", p).withColumn("label", (F.col("p") >= 0.5).cast("int"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, question, model, label, p) of the multi arm, without errors: a panel of three."""
    return predictions(spark, sf_dir).where("arm = 'multi' and not error").select("doc_id", "question", "model", "label", "p")


U = "(('0x' || substr(sha1({0}), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0e0)"


def u(*key: str) -> str:
    """SQL of a hashed uniform; plain names are columns, names in quotes are texts."""
    return U.format("concat_ws('|', " + ", ".join(f"{k}::VARCHAR" if not k.startswith("'") else k for k in key) + ")")


_K = ("model", "arm", "question", "doc_id")
_BODY = f"""questions AS (SELECT * FROM (VALUES (0, 'quality'), (1, 'toxic')) t(ordinal, question)),
models AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {k}e0, {a}e0, {b}e0)" for m, k, a, b in MODELS)}) t(model, power, price_in, price_out)),
arms AS (SELECT * FROM (VALUES ('multi'), ('single')) t(arm)),
gold AS (SELECT doc_id, question, gold, {u("'gray'", "doc_id", "question")} < 0.08e0 AS gray FROM (
  SELECT doc_id, 'quality' AS question, quality AS gold FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)),
units AS (SELECT d.doc_id, q.question, d.lang, d.source, d.n_chars, g.gold, coalesce(g.gray, false) AS gray
  FROM documents d CROSS JOIN questions q LEFT JOIN gold g ON g.doc_id = d.doc_id AND g.question = q.question),
raw AS (SELECT units.*, models.*, arms.arm FROM units CROSS JOIN models CROSS JOIN arms),
scored AS (SELECT *, {u("'err'", *_K)} < 0.01e0 AS error,
  floor(CASE WHEN coalesce(gold, 0) = 1 THEN 1 - 0.98e0 * pow({u("'SALT'", *_K)}, power) ELSE 0.98e0 * pow({u("'SALT'", *_K)}, power) END * 1000 + 0.5e0) / 1000 AS p0,
  {u("'flip'", *_K)} < 0.01e0 AS flip, floor(100 + 900 * {u("'lat'", *_K)})::DOUBLE AS latency_ms,
  greatest(1, floor(n_chars / 4.0e0))::BIGINT AS input_tokens,
  (5 + floor(20 * {u("'out'", *_K)}))::BIGINT AS output_tokens,
  CASE WHEN {u("'mode'", *_K)} < 0.2e0 THEN 'batch' ELSE 'standard' END AS mode FROM raw),
pred AS (SELECT *, floor(input_tokens * 0.25e0 * {u("'cache'", *_K)})::BIGINT AS cached_tokens, CASE WHEN NOT error THEN p0 END AS p FROM scored),
predictions AS (SELECT doc_id, question, lang, source, n_chars, gold, gray, model, arm, p, error, latency_ms, input_tokens, cached_tokens, output_tokens, mode,
  CASE WHEN flip THEN (p < 0.5e0)::INT ELSE (p >= 0.5e0)::INT END AS label,
  (input_tokens * price_in + output_tokens * price_out) / 1e6 AS list_cost,
  ((input_tokens - cached_tokens) * price_in + cached_tokens * price_in * 0.1e0 + output_tokens * price_out) / 1e6 * CASE WHEN mode = 'batch' THEN 0.5e0 ELSE 1.0e0 END AS cost FROM pred)"""


def ctes(salt: str = "p") -> str:
    """The derivation in DuckDB SQL, up to ``predictions``, without the leading WITH."""
    return _BODY.replace("SALT", salt)


_BASE = f"floor(CASE WHEN gold = 1 THEN 1 - 0.98e0 * pow({u(chr(39) + 'rep' + chr(39), 'question', 'doc_id')}, 2.0e0) ELSE 0.98e0 * pow({u(chr(39) + 'rep' + chr(39), 'question', 'doc_id')}, 2.0e0) END * 1000 + 0.5e0) / 1000"
REPEATS_CTE = f"""runs AS (SELECT unnest(range(1, {REPEATS + 1})) AS run),
shaken AS (SELECT gold.*, run, {_BASE} AS base, 0.2e0 * ({u("'shake'", "run", "question", "doc_id")} - 0.5e0) AS shake FROM gold CROSS JOIN runs),
repeated AS (SELECT doc_id, question, run, gold, gray, floor(greatest(0.0e0, least(1.0e0, base + CASE WHEN abs(base - 0.5e0) < 0.2e0 THEN shake ELSE 0.0e0 END)) * 1000 + 0.5e0) / 1000 AS p FROM shaken),
repeats AS (SELECT *, (p >= 0.5e0)::INT AS label FROM repeated)"""
