"""Corpus-wide text statistics: document frequencies of n-grams and words, recurrence, lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import text as T
from caseload.operators import order as O


def one_of_each_body(docs: DataFrame) -> DataFrame:
    """A document for each body (the words alone): the smallest id."""
    return docs.groupBy(T.body_key(F.col("text")).alias("body")).agg(F.min("doc_id").alias("doc_id"), F.min_by("text", "doc_id").alias("text")).select("doc_id", "text")


def gram_keys(gram: Column) -> list[Column]:
    """128 bits that stand for a gram in shuffles: two hashes of independent seeds, a fraction of its text."""
    return [F.xxhash64(gram).alias("h1"), F.xxhash64(F.lit(1), gram).alias("h2")]


def key_frequency(docs: DataFrame, n: int) -> DataFrame:
    """(h1, h2, df): in how many bodies each run of n words stands. Distinct within a document before the shuffle; few grams
    stand in several bodies of one task, so rows are dealt first and counted once."""
    grams = docs.select(F.explode(F.array_distinct(T.ngrams(T.tokens(F.col("text")), n))).alias("gram"))
    keys = grams.select(*gram_keys(F.col("gram")))
    return keys.repartition("h1", "h2").groupBy("h1", "h2").agg(F.count("*").alias("df"))


def wanted_frequency(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Document frequency of the ``wanted`` grams alone; 1 for those that stand nowhere."""
    grams = docs.select(F.explode(F.array_distinct(T.ngrams(T.tokens(F.col("text")), n))).alias("gram")).join(wanted.distinct(), "gram", "left_semi")
    return wanted.distinct().join(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram", "left").withColumn("df", F.coalesce("df", F.lit(1)))


def lexicon(docs: DataFrame, least: int = 3) -> DataFrame:
    """Words in at least ``least`` documents of any one source."""
    w = docs.select("source", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    return w.groupBy("source", "word").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("word").distinct()


def recurrence(docs: DataFrame, n: int = 8, least: int = 3) -> DataFrame:
    """For each document its n-grams, how many stand in ``least`` or more documents, and the longest stretch of words they cover."""
    keyed = docs.select("doc_id", F.posexplode(F.transform(T.ngrams(T.tokens(F.col("text")), n), lambda g: F.struct(*gram_keys(g)))).alias("at", "g"))
    g = keyed.select("doc_id", "at", "g.h1", "g.h2")
    same = Window.partitionBy("h1", "h2")  # rows are sent once; a run's documents are counted where they meet
    placed = g.withColumn("nth", F.dense_rank().over(same.orderBy("doc_id"))).withColumn("df", F.max("nth").over(same))
    shared = placed.where(F.col("df") >= least)
    island = F.col("at") - F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    runs = shared.withColumn("island", island).groupBy("doc_id", "island").agg(F.count("*").alias("k"))
    got = runs.groupBy("doc_id").agg(F.sum("k").alias("n_shared"), (F.max("k") + (n - 1)).alias("longest"))
    size = docs.select("doc_id", F.size(T.ngrams(T.tokens(F.col("text")), n)).cast("long").alias("n_grams"))
    return size.join(got, "doc_id", "left").select("doc_id", "n_grams", F.coalesce("n_shared", F.lit(0)).alias("n_shared"), F.coalesce("longest", F.lit(0)).alias("longest"))


def unknown_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """By document: distinct words, and how many of them the lexicon lacks."""
    w = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    bad = w.join(words, "word", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_unknown"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words")).join(bad, "doc_id", "left").withColumn("n_unknown", F.coalesce("n_unknown", F.lit(0)))


def words_unknown_everywhere(docs: DataFrame) -> DataFrame:
    """By document: distinct words, and how many of them stand in at most two documents of any one source.

    The same as ``unknown_words`` by the ``lexicon`` of the same documents, without a join: words are counted by source with
    the ids of two documents, so only these counts are sent, and rows of unknown words made from them. Documents without
    words are left out; rows that share an id count together.
    """
    words = F.array_distinct(T.tokens(F.col("text")))
    w = docs.select("doc_id", "source", F.explode(words).alias("word"))
    counts = w.groupBy("word", "source").agg(F.count("*").alias("k"), F.count("doc_id").alias("n_ids"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    most = F.max("k").over(Window.partitionBy("word"))  # as many rows as sources that hold a word
    unknown = counts.withColumn("most", most).where(F.col("most") < 3)
    ids = F.when(F.col("k") == 1, F.array("a")).otherwise(F.array(F.col("a"), F.when(F.col("n_ids") == 2, F.col("b"))))
    bad = unknown.select(F.explode(ids).alias("doc_id"), F.lit(0).alias("n_words"), F.lit(1).alias("n_unknown"))
    size = docs.select("doc_id", F.size(words).alias("n_words"), F.lit(0).alias("n_unknown")).where(F.col("n_words") > 0)
    return size.unionAll(bad).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_unknown").alias("n_unknown"))


def header_fields(docs: DataFrame) -> DataFrame:
    """(doc_id, field, value) of a message's header block: the lines before the first blank one, wrapped lines joined."""
    head = F.regexp_replace(F.get(F.split("text", r"\n\s*\n", 2), 0), r"\n[ \t]+", " ")
    lines = docs.select("doc_id", F.explode(F.split(head, "\n")).alias("line"))
    part = lambda k: F.regexp_extract("line", r"^(From|To|Cc|Bcc|Subject|Date):\s*(.*)$", k)
    return lines.select("doc_id", F.lower(part(1)).alias("field"), F.trim(part(2)).alias("value")).where("field != ''")


def header_names(docs: DataFrame, least: int = 2) -> DataFrame:
    """(surname, n): surnames of people in address fields, in at least ``least`` messages."""
    people = header_fields(docs).where("field in ('from', 'to', 'cc', 'bcc')").select("doc_id", F.explode(T.address_names("value")).alias("name"))
    surname = F.element_at(F.split("name", " "), -1)
    return people.select("doc_id", surname.alias("surname")).distinct().groupBy("surname").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def recall_by_tier(answers: DataFrame) -> DataFrame:
    """Answers about known entities (tier, asked, kind, hit) by tier and by kind: rates, and the rate of saying yes."""
    return answers.groupingSets([["tier", "kind"], ["tier"], []], "tier", "kind").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("rate"))


def topic_ceiling(labels: DataFrame, topic: str) -> DataFrame:
    """The accuracy that knowing the topic alone allows: the larger class of each topic."""
    at = labels.groupBy(topic).agg(F.count_if(F.col("gold") == 1).alias("a"), F.count_if(F.col("gold") == 0).alias("b"))
    return at.agg((F.sum(F.greatest("a", "b")) / F.sum(F.col("a") + F.col("b"))).alias("ceiling"), F.sum(F.col("a") + F.col("b")).alias("n"))


def composite(channels: DataFrame, bounds: dict[str, tuple[float, float]], key: str) -> DataFrame:
    """Channels placed between their floor and ceiling, averaged over those that have a value, and ranked."""
    from caseload.functions import scalars as S

    placed = [S.placed_between(F.col(c), F.lit(low), F.lit(high)) for c, (low, high) in bounds.items()]
    known = F.filter(F.array(*placed), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(known), F.lit(1)))
    out = channels.select(key, mean.alias("composite"), F.size(known).alias("n_channels"))
    score = F.coalesce("composite", F.lit(-1.0))
    return O.placed(out, [], [F.floor(score * 1024), score], [F.asc(key)], {}, "place")
