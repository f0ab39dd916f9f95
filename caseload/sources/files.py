"""Readers and writers: JSON lines, judgment files, e-mail folders, task sets, predictions with resume.

Schemas are explicit; paths are read by Spark alone, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "id string, text string, labels map<string,string>, gray array<string>, meta map<string,string>"
PREDICTION = (
    "doc_id string, question string, model_key string, model_resolved string, arm string, label string, p_positive double, confidence double, latency_ms double, "
    "input_tokens long, output_tokens long, cached_tokens long, cost_usd double, list_cost_usd double, pricing_mode string, gold string, gray boolean, error string, raw map<string,string>"
)
RUN_PARTS = ["corpus", "arm", "model_key", "tag"]


def read_corpus(spark: SparkSession, path: str, labelled: bool = True, limit: int | None = None) -> DataFrame:
    """Documents, one JSON object a line (only a line feed ends a line). Missing ids are numbered by place, labels and gray
    default to empty; ``labelled=False`` blanks the gold."""
    rows = spark.read.schema(DOCUMENT).option("lineSep", "\n").json(path)
    rows = rows.where("text is not null or id is not null").withColumn("pos", F.monotonically_increasing_id())
    empty_map, empty = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    rows = rows.withColumns(
        {"id": F.coalesce("id", F.col("pos").cast("string")), "labels": F.coalesce("labels", empty_map) if labelled else empty_map, "gray": F.coalesce("gray", empty), "unlabelled": F.lit(not labelled)}
    )
    return rows if limit is None else rows.orderBy("pos").limit(limit)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions; NaN scores become null; a line that isn't of the schema fails the read."""
    rows = spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)
    return rows.withColumn("p_positive", F.nanvl("p_positive", F.lit(None).cast("double")))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, or no rows if nothing is there."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def run_path(corpus: str, arm: str, model: str, variant: str | None = None, tag: str | None = None) -> str:
    """Where a run's predictions lie, below the results folder."""
    return f"{corpus}/{arm}/{model}" + (f"__{variant}" if variant else "") + (f"__{tag}" if tag else "") + ".jsonl"


def run_parts(path: Column) -> Column:
    """corpus, arm, model and rest (variant and tag) of a run's path."""
    part = lambda k: F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/]+?)(?:__([^/]+))?\.jsonl$", k)
    return F.struct(part(1).alias("corpus"), part(2).alias("arm"), part(3).alias("model"), F.nullif(part(4), F.lit("")).alias("rest"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All runs under a results folder, with the parts of their paths: one scan."""
    rows = spark.read.schema(PREDICTION).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    return rows.withColumn("run", run_parts(F.input_file_name()))


def write_predictions(rows: DataFrame, path: str) -> None:
    """Predictions by corpus, arm, model and tag; only the written parts are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_PARTS).parquet(path)


def append_finished(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A run after a resume: finished rows stay, failed ones go, new ones come."""
    kept = existing.where("error is null")
    return kept.unionByName(new.join(kept.select(*keys), keys, "left_anti"))


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines in which NaN is null."""
    doubles = {f.name: F.nanvl(f.name, F.lit(None).cast("double")) for f in rows.schema.fields if isinstance(f.dataType, T.DoubleType)}
    (rows.withColumns(doubles) if doubles else rows).write.mode("overwrite").json(path)


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines cut at spaces, with their file and place in it."""
    rows = spark.read.text(path)
    return rows.select(F.split(F.trim("value"), r"\s+").alias("f"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).where(F.length(F.get("f", 0)) > 0)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``topic docno rel [facet]``, or ``topic 0 docid judgment p_select``; leading zeros of topics go; p_select is 1 by
    default; the last line of a key wins."""
    f = F.col("f")
    sampled = (F.size(f) >= 4) & (F.get(f, 1) == "0")
    rows = split_lines(spark, path).select(
        F.regexp_replace(F.get(f, 0), "^0+(?=.)", "").alias("topic"),
        F.when(sampled, F.get(f, 2)).otherwise(F.get(f, 1)).alias("docid"),
        F.when(sampled, F.get(f, 3)).otherwise(F.get(f, 2)).cast("int").alias("rel"),
        F.when(sampled, F.coalesce(F.get(f, 4).cast("double"), F.lit(1.0))).otherwise(1.0).alias("p_select"),
        "line",
    )
    return rows.where("rel is not null").groupBy("topic", "docid").agg(F.max_by("rel", "line").alias("rel"), F.max_by("p_select", "line").alias("p_select"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``topic Q0 docid rank score run``."""
    f = F.col("f")
    return split_lines(spark, path).where(F.size(f) >= 5).select(F.get(f, 0).alias("topic"), F.get(f, 2).alias("docid"), F.get(f, 4).cast("double").alias("score"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """``num  title -- description``."""
    part = lambda k: F.regexp_extract("value", r"^(\S+)\s+(.*?) -- (.*)$", k)
    return spark.read.text(path).select(part(1).alias("topic"), part(2).alias("title"), part(3).alias("description")).where("topic != ''")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A file a message: UTF-8, or Latin-1 where it isn't; line ends unified, runs of blank lines cut."""
    from caseload.functions.text import tidy

    rows = spark.read.format("binaryFile").load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return rows.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("id"), tidy(text).alias("text"))


def read_whole(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted ids among files named by id."""
    rows = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]+)?$", 1).alias("id"), F.col("value").alias("text"))
    return rows.join(wanted.select("id").distinct(), "id", "left_semi")


def latest_fields(log: DataFrame) -> DataFrame:
    """An audit log (artifact, field, value, at) as the last value of each field, in a map."""
    last = log.groupBy("artifact", "field").agg(F.max_by("value", "at").alias("value"))
    return last.groupBy("artifact").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def key_path(doc_id: Column) -> Column:
    """The place of a text in a store that deals ids by their first four letters."""
    return F.concat_ws("/", F.substring(doc_id, 1, 1), F.substring(doc_id, 2, 1), F.substring(doc_id, 3, 1), F.substring(doc_id, 4, 1), doc_id, F.concat(doc_id, F.lit(".ocr")))


def questions_frame(spark: SparkSession, task: dict) -> DataFrame:
    """A task set's questions as rows: texts stripped, defaults filled, in order."""
    rows = [
        (k, qid, str(q.get("title", qid)).strip(), str(q.get("rfp_text", "")).strip(), str(q.get("positive_desc", "")).strip(), str(q.get("negative_desc", "")).strip(), [str(x).strip() for x in q.get("subparts") or []])
        for k, (qid, q) in enumerate(task.get("questions", {}).items())
    ]
    return spark.createDataFrame(rows, "ordinal int, question string, title string, request string, positive string, negative string, subparts array<string>")
