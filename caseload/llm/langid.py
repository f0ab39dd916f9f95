"""Language identification: known words by their log frequency in each language, unseen words by shorter and shorter n-grams.

Words are runs of letters, in lower case. A word of the model scores its smoothed log frequency in each language. Any
other word scores the mean of its known character n-grams (word ends marked) at the longest length at which it has a
known one, down to single letters; a word without any scores alike for all languages. Every word and n-gram counted is
known: the frequent ones go to every task, and all others of the texts are looked up in the stored counts by joins.

Defined results for odd input: null text, or text without a letter, is ``und`` with score 0; rows with null language
teach nothing; ties go to the language that comes first in sorted order; an empty training set makes every text ``und``;
repeated rows are counted and predicted each; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.rows import map_texts
from caseload.session import stored

LETTERS = regex.compile(r"\p{L}+")
LENGTHS = (4, 3, 2, 1)
#: Counts a task holds before it sends them on.
FLUSH = 400_000


def letter_words(text: bytes) -> list[str]:
    return LETTERS.findall(text.decode("utf-8", "replace").lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def counted(batches, keys, weigh) -> object:
    """Partial counts of (lang, length, unit), sent on whenever many are held."""
    held: Counter = Counter()

    def rows():
        langs, sizes, units = zip(*held, strict=True) if held else ((), (), ())
        out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(units, pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "size", "unit", "n"])
        held.clear()
        return out

    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True):
            weigh(held, *row)
            if len(held) > FLUSH:
                yield rows()
    yield rows()


def word_counts(training: DataFrame) -> DataFrame:
    """(lang, size 0, unit, n): how often each word stands in each language's documents."""

    def weigh(held, lang, text):
        for word, n in Counter(letter_words(text)).items():
            held[lang, 0, word] += n

    rows = training.where("text is not null and lang is not null").select("lang", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: counted(b, ("lang", "text"), weigh), "lang string, size int, unit string, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n"))


def gram_counts(by_word: DataFrame) -> DataFrame:
    """(lang, size, unit, n) of the words' character n-grams; each word is cut once and counts as often as it stands."""

    def weigh(held, lang, unit, n):
        for size in LENGTHS:
            for g in grams(unit, size):
                held[lang, size, g] += n

    return by_word.mapInArrow(lambda b: counted(b, ("lang", "unit", "n"), weigh), "lang string, size int, unit string, n long").groupBy("lang", "size", "unit").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of words (size 0) and n-grams, a value for each language: all in ``units``, the frequent ones in ``table``."""

    def __init__(self, langs: list[str], units: DataFrame | None, table: dict[int, dict[str, list[float]]]):
        self.langs, self.units, self.table = langs, units, table


def log_frequencies(counts: DataFrame, langs: list[str], smoothing: float) -> DataFrame:
    """(size, unit, n, v): smoothed log frequency of each unit in each language, less the mean over the languages."""
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)) for x in langs]
    wide = stored(counts.groupBy("size", "unit").agg(F.sum("n").alias("n"), F.array(*each).alias("c")))
    sums = wide.groupBy("size").agg(F.count("*").alias("k"), F.array(*[F.sum(F.col("c")[i]) for i in range(len(langs))]).alias("c")).collect()
    below = F.lit(None).cast("array<double>")
    for r in sums:
        below = F.when(F.col("size") == r["size"], F.array(*[F.lit(float(n + smoothing * r["k"])) for n in r["c"]])).otherwise(below)
    logs = wide.select("size", "unit", "n", F.zip_with("c", below, lambda n, b: F.log((n + smoothing) / b)).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / len(langs)
    return logs.withColumn("_m", mean).select("size", "unit", "n", F.transform("v", lambda x: x - F.col("_m")).alias("v"))


def frequent(units: DataFrame, most: dict[int, int]) -> dict[int, dict[str, list[float]]]:
    """Up to ``most`` units of each size, those of the highest counts."""
    step = F.floor(F.log2("n") * 16).cast("int")
    total, least = dict.fromkeys(most, 0), {}
    for r in sorted(units.groupBy(step.alias("step"), "size").agg(F.count("*").alias("k")).collect(), reverse=True):
        total[r["size"]] += r["k"]
        if total[r["size"]] <= most[r["size"]]:
            least[r["size"]] = r["step"]
    wanted = F.lit(False)
    for size, bound in least.items():
        wanted = wanted | ((F.col("size") == size) & (step >= bound))
    out: dict[int, dict[str, list[float]]] = {size: {} for size in most}
    for r in units.where(wanted).select("size", "unit", "v").collect():
        out[r["size"]][r["unit"]] = list(r["v"])
    return out


def fit(training: DataFrame, max_words: int = 20_000, max_grams: int = 20_000, smoothing: float = 0.5) -> Model:
    """Counts over all of ``training`` (text, lang). ``max_words`` words and ``max_grams`` n-grams of each length, for each
    language, go to every task; as all others are looked up, these numbers change no result."""
    by_word = stored(word_counts(training))
    langs = sorted(r["lang"] for r in by_word.select("lang").distinct().collect())
    if not langs:
        return Model([], None, {})
    units = stored(log_frequencies(by_word.unionByName(gram_counts(by_word)), langs, smoothing))
    return Model(langs, units, frequent(units, {size: (max_grams if size else max_words) * len(langs) for size in (0, *LENGTHS)}))


def added(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def looked_up(words: DataFrame, model: Model, shared) -> DataFrame:
    """(word, v) of distinct words: their own log frequencies, or those of their n-grams; none for words without any."""
    n = len(model.langs)
    sums = lambda c: F.array(*[F.sum(c[i]) for i in range(n)])
    own = model.units.where("size = 0").select(F.col("unit").alias("word"), "v")
    found = stored(words.join(own, "word", "left"))

    def cut(batches):
        table = shared.value
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                for size in LENGTHS:
                    cold, total, k = [], [0.0] * n, 0
                    for g in grams(word, size):
                        v = table[size].get(g)
                        if v is None:
                            cold.append(g)
                        else:
                            total, k = [x + y for x, y in zip(total, v, strict=True)], k + 1
                    rows.append((word, size, total, k, cold))
                    if k:
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.string())))], names=["word", "size", "s", "k", "cold"]
            )

    parts = stored(found.where("v is null").select("word").mapInArrow(cut, "word string, size int, s array<double>, k long, cold array<string>"))
    cold = parts.select("word", "size", F.explode("cold").alias("unit"))
    met = cold.join(model.units.where("size > 0").select("size", "unit", "v"), ["size", "unit"]).groupBy("word", "size").agg(sums(F.col("v")).alias("s2"), F.count("*").alias("k2"))
    none = F.array(*[F.lit(0.0)] * n)
    whole = parts.join(met, ["word", "size"], "left").select("word", "size", added(F.col("s"), F.coalesce("s2", none)).alias("s"), (F.col("k") + F.coalesce("k2", F.lit(0))).alias("k")).where("k > 0")
    back = whole.groupBy("word").agg(F.max_by(F.struct("s", "k"), "size").alias("x")).select("word", F.transform("x.s", lambda y: y / F.col("x.k")).alias("v"))
    return found.where("v is not null").unionByName(back)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language under equal priors."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    if not model.langs:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    n = len(model.langs)
    shared = docs.sparkSession.sparkContext.broadcast(model.table)

    def make():
        words = {w: i for i, w in enumerate(shared.value[0])}
        matrix = np.array(list(shared.value[0].values())).reshape(-1, n)

        def work(text: bytes | None):
            seen = Counter(letter_words(text)) if text else {}
            at, times, cold, cold_n = [], [], [], []
            for w, k in seen.items():
                i = words.get(w)
                if i is None:
                    cold.append(w)
                    cold_n.append(k)
                else:
                    at.append(i)
                    times.append(k)
            total = np.array(times, float) @ matrix[at] if at else np.zeros(n)
            return bool(seen), total.tolist(), cold, cold_n

        return work

    first = stored(map_texts(docs, make, "_any boolean, _sum array<double>, _cold array<string>, _cold_n array<int>", keep).withColumn("_row", F.monotonically_increasing_id()))
    cold = first.select("_row", F.explode(F.arrays_zip(F.col("_cold").alias("word"), F.col("_cold_n").alias("k"))).alias("x")).select("_row", "x.word", "x.k")
    vectors = looked_up(cold.select("word").distinct(), model, shared)
    more = cold.join(vectors, "word").groupBy("_row").agg(F.array(*[F.sum(F.col("k") * F.col("v")[i]) for i in range(n)]).alias("_more"))
    total = first.join(more, "_row", "left").withColumn("_t", added(F.col("_sum"), F.coalesce("_more", F.array(*[F.lit(0.0)] * n)))).withColumn("_best", F.array_max("_t"))
    sure = 1 / F.aggregate("_t", F.lit(0.0), lambda s, x: s + F.exp(F.greatest(x - F.col("_best"), F.lit(-700.0))))
    lang = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("_t", F.col("_best")).cast("int"))
    return total.select(*keep, F.when(F.col("_any"), lang).otherwise("und").alias("lang_pred"), F.when(F.col("_any"), sure).otherwise(0.0).alias("score"))
