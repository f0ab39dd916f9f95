"""Registered queries of the operators in this subpackage, each over its whole table, and the SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseload.llm import anisotropic, bpe, chat, ctw, jaccard, langid, licenses, merkle, mixing, quality, secrets, sharding, spelling


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.quality_rules(docs, keep=["doc_id"])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).drop("text")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(spark, docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], with_decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def listed(finds: Column) -> Column:
    """Finds as ``kind:start:end`` by start, then kind as listed."""
    by_place = F.array_sort(F.transform(finds, lambda f: F.struct(f["start"], F.array_position(F.array(*map(F.lit, secrets.KINDS)), f["kind"]).alias("k"), f["end"], f["kind"])))
    return F.concat_ws(",", F.transform(by_place, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, keep=["doc_id"])
    counts = [F.size(F.array_remove(F.transform("base_finds", lambda f: f["kind"] == kind), F.lit(False))).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base_finds")), 256).alias("base_sha256"), listed(F.concat("base_finds", "layer_finds")).alias("spans"), "n_layers")


def part(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", part(5, 1))
    return ctw.score_texts(docs, docs.where(~F.col("held_out")), keep=["doc_id", "held_out"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", part(4, 2))
    model = langid.fit(docs.where(~F.col("held_out")).select("text", "lang"))
    return langid.predict(docs.drop("lang"), model, keep=["doc_id", "held_out"])


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs, keep=["doc_id"])
    base = F.transform("phrase_places", lambda p: p["label"])
    both = F.concat(base, F.transform("blocks", lambda b: b["label"]))
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    at = F.transform("phrase_places", lambda p: p["place"])
    held = F.when(F.size("phrase_places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("phrase_places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"), joined(both).alias("labels"), held.alias("score")
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.read_back(chat.format_chats(turns.withColumn("parts", chat.typed_parts(F.col("text"))).drop("text")))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.transform("attachments", lambda a: F.concat_ws(":", a["type"], a["ref"])).alias("attachments"),
        "n_attachment_tokens",
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    fields = {c: F.col(c) for c in merkle.FIELDS}
    without = merkle.leaf_digest(fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    proofs = merkle.sealed(docs, {"tampered": F.when(part(2, 0), without)})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    digest = F.sha2(F.concat_ws("", merkle.siblings(F.col("path"))), 256)
    out = proofs.select("doc_id", "leaf", "subroot", "root", digest.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_mixing": op2_mixing,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_secret_scans": op5_secret_scans,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_language_id": op7_language_id,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_license_scans": op9_license_scans,
        "op10_chat_format": op10_chat_format,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_sharding": op13_sharding,
    }


#: crc32 as DuckDB SQL: ``crc_table``, made from the polynomial, and the crc of a column ``s`` of ``named``.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(named: str) -> str:
    return f"""(SELECT s, xor(list_reduce(list_concat([4294967295], list_transform(range(0, strlen(s)),
        lambda i: CAST('0x' || substr(hex(encode(s)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS crc FROM (SELECT DISTINCT s FROM {named}), crc_table)"""


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)),
crcs AS {crc_sql("runs")},
cut AS (SELECT CASE WHEN crc % 97 = 0 THEN substring(run, 1, CAST(crc % length(run) AS BIGINT)) || substring(run, CAST(crc % length(run) + 2 AS BIGINT)) ELSE run END AS word FROM runs JOIN crcs USING (s)),
words AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
shorter AS (SELECT word, n, length(word) AS len, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word AS word, b.word AS near FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
    UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
near AS (SELECT p.word, count(*) AS n_near, min(struct_pack(o := -w.n, f := p.near)) AS best FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.o >= 2 * w.n THEN best.f END AS form, CASE WHEN -best.o >= 2 * w.n THEN -best.o END AS form_n FROM words w LEFT JOIN near USING (word)),
led AS (SELECT word, word AS reached, form AS next FROM forms UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN forms f ON f.word = l.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, l.reached AS root FROM forms f JOIN led l ON l.word = f.word AND l.next IS NULL
"""

FIELD_SQL = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(FIELD_SQL.format(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"


def levels_sql(leaves: str, name: str) -> str:
    """``name``: (tree, level, pos, node, width) of all nodes, and ``name_run``: each run's nodes as a list."""
    return f"""{name} AS (SELECT tree, 0 AS level, i AS pos, node, count(*) OVER (PARTITION BY tree) AS width FROM {leaves}
    UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(width) + 2) // 3 FROM {name} WHERE width > 1 GROUP BY tree, level, pos // 3),
{name}_run AS (SELECT tree, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM {name} WHERE width > 1 GROUP BY tree, level, pos // 3)"""


MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
ids AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
crcs AS {crc_sql("ids")},
docs AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, {leaf_sql("text")} AS node,
    CASE WHEN crc % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} END AS tampered FROM documents JOIN crcs ON s = coalesce(CAST(doc_id AS VARCHAR), '')),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS i FROM docs),
{levels_sql("leaves", "low")},
subroots AS (SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY tree) - 1 AS i FROM low WHERE width = 1),
{levels_sql("subroots", "high")},
starts AS (SELECT l.doc_id, l.tree, l.i, l.node AS leaf, coalesce(l.tampered, l.node) AS begun, s.node AS subroot, s.i AS source_pos, h.node AS root
    FROM leaves l JOIN subroots s ON s.name = l.tree JOIN high h ON h.width = 1),
steps AS (
    SELECT l.tree, l.i, r.level AS k, l.i // CAST(pow(3, r.level) AS BIGINT) % 3 AS place, r.nodes FROM starts l JOIN low_run r ON r.tree = l.tree AND r.run = l.i // CAST(pow(3, r.level + 1) AS BIGINT)
    UNION ALL SELECT l.tree, l.i, 1000 + r.level, l.source_pos // CAST(pow(3, r.level) AS BIGINT) % 3, r.nodes FROM starts l JOIN high_run r ON r.run = l.source_pos // CAST(pow(3, r.level + 1) AS BIGINT)),
paths AS (SELECT tree, i, list(struct_pack(place := place, nodes := nodes) ORDER BY k) AS path, string_agg(list_reduce(list_concat([''], nodes[1:place], nodes[place + 2:]), lambda a, b: a || b), '' ORDER BY k) AS others FROM steps GROUP BY tree, i),
folds AS (SELECT tree, i, begun AS node, 1 AS k FROM starts
    UNION ALL SELECT f.tree, f.i, sha256(list_reduce(list_concat([''], path[f.k].nodes[1:path[f.k].place], [f.node], path[f.k].nodes[path[f.k].place + 2:]), lambda a, b: a || b)), f.k + 1
    FROM folds f JOIN paths p ON p.tree = f.tree AND p.i = f.i WHERE f.k <= len(path))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(others, '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM starts s LEFT JOIN paths p USING (tree, i) JOIN folds f ON f.tree = s.tree AND f.i = s.i AND f.k = coalesce(len(path), 0) + 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_spelling_variants": SPELLING_SQL, "op12_merkle_manifest": MERKLE_SQL}
