"""Language-model scoring by context-tree weighting over bytes, and a unigram baseline over words.

Each byte is decomposed into eight binary choices; each choice has a context tree over the bytes before it, down to
``DEPTH`` of them. Every node holds a Krichevsky-Trofimov estimate from all training counts, and a node's weighted
probability mixes its own estimate, one half, with the product of its children's. With the counts fixed, the chance of
a choice is a mixture over all depths, weighted by how well each depth codes the training texts; so a byte's code
length depends on the bytes before it alone. Every context seen is kept: the trees stand in stored tables, are weighted
in groups of the contexts with the same last ``SUFFIX`` bytes (256^2 contexts each at most), and the levels above, whose
number is bounded by 256^2 contexts too, are weighted on the driver. The most frequent grams' chances go to every task;
all other grams of the texts meet theirs in a join.

Texts have A-Z in lower case; byte 0xFF, which UTF-8 never holds, stands before a text and ends it.

Defined results for odd input: null text is the empty text, which is one end; repeated rows count and are scored each;
ties in frequency go to the smaller context or word; without training documents every count is 0.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.llm.rows import map_texts
from caseload.session import stored

DEPTH = 5
END = 0xFF
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
CHUNK_BYTES = 8 << 20
#: Contexts with the same last bytes, so many, are weighted together.
SUFFIX = 3
#: Grams that are weighted at once, if one group isn't larger.
CHUNK_GRAMS = 100_000
#: Places of the table of frequent grams, as a power of two; of grams that share a place, the most frequent one has it.
SLOT_BITS = 21
#: Distinct words a task holds before it sends its counts on.
FLUSH = 400_000


def codes(text: bytes) -> np.ndarray:
    """Every byte of a text and its end, with the ``DEPTH`` bytes before it, as one number: the oldest byte highest."""
    b = np.frombuffer(bytes([END]) * DEPTH + text.translate(LOWER) + bytes([END]), np.uint8).astype(np.int64)
    n = len(b) - DEPTH
    out = b[:n].copy()
    for k in range(1, DEPTH + 1):
        out <<= 8
        out |= b[k : k + n]
    return out


def gram_counts(training: DataFrame) -> DataFrame:
    """(ctx, byte, n) over all training texts: each task counts chunk by chunk."""

    def count(batches):
        held, size = [], 0

        def out():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams >> 8), pa.array((grams & 255).astype(np.int16)), pa.array(n)], names=["ctx", "byte", "n"])

        for batch in batches:
            for text in batch.column(0):
                got = codes(text.as_py() or b"")
                held.append(got)
                size += len(got)
                if size > CHUNK_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    rows = training.select(F.col("text").cast("binary")).mapInArrow(count, "ctx long, byte smallint, n long")
    return rows.groupBy("ctx", "byte").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2, by Stirling's series after a shift of eight."""
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The estimate that the next choice is a one."""
    return (ones + 0.5) / (zeros + ones + 1)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of a node, and the share of its own estimate in it."""
    total = np.logaddexp(own, children) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


def at_depth(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys (context, choice) of the nodes so deep above or at these: the choice's number lies in the lowest byte."""
    return keys & ((1 << (8 * depth + 8)) - 1)


def grown(counts: np.ndarray, children: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weighted probability, share of the own estimate and the estimate, of nodes with these zeros and ones."""
    own, est = kt_log(counts[0], counts[1]), kt_one(counts[0], counts[1])
    return (own, np.ones(len(own)), est) if children is None else (*weighted(own, children), est)


class Deep:
    """The trees from ``DEPTH`` up to ``SUFFIX`` over whole groups of grams; a gram with a count of 0 is a node never seen."""

    def __init__(self, ctx: np.ndarray, byte: np.ndarray, n: np.ndarray):
        level = np.arange(8)
        self.bits = (byte[:, None] >> (7 - level)) & 1
        keys, up = np.unique(((ctx[:, None] << 8) | (1 << level) | (byte[:, None] >> (8 - level))).ravel(), return_inverse=True)
        each, bit = np.repeat(n, 8), self.bits.ravel()
        counts, below = np.stack([np.bincount(up, each * (1 - bit)), np.bincount(up, each * bit)]), None
        self.ups, self.levels = [up], []
        for depth in range(DEPTH, SUFFIX - 1, -1):
            below, share, est = grown(counts, below)
            self.levels.append((share, est))
            if depth > SUFFIX:
                keys, up = np.unique(at_depth(keys, depth - 1), return_inverse=True)
                self.ups.append(up)
                counts, below = np.stack([np.bincount(up, c) for c in counts]), np.bincount(up, below)
        self.keys, self.counts, self.below = keys, counts, below

    def ones(self, upper: Upper) -> np.ndarray:
        """The chance of a one at the eight choices of each gram."""
        mixed, left = upper.mixture(self.keys)
        for k in range(len(self.levels) - 1, -1, -1):
            share, est = self.levels[k]
            mixed, left = mixed + left * share * est, left * (1 - share)
            mixed, left = mixed[self.ups[k]], left[self.ups[k]]
        return mixed.reshape(-1, 8)


class Upper:
    """The levels above ``SUFFIX``, as what their estimates give and what is left to the levels below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, children: np.ndarray):
        found = []
        for depth in range(SUFFIX - 1, -1, -1):
            keys, up = np.unique(at_depth(keys, depth), return_inverse=True)
            counts, children = np.stack([np.bincount(up, c, len(keys)) for c in counts]), np.bincount(up, children, len(keys))
            children, share, est = grown(counts, children)
            found.append((keys, share, est))
        self.levels = []
        for keys, share, est in reversed(found):
            mixed, left = self.mixture(keys)
            self.levels.append((keys, mixed + left * share * est, left * (1 - share)))

    def mixture(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixture over all levels that hold a node; a node never seen leaves one half of all to its parent's estimate."""
        mixed, left = np.zeros(len(keys)), np.ones(len(keys))
        for depth, (own, m, rest) in enumerate(self.levels):
            if len(own):
                wanted = at_depth(keys, depth)
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                met = own[at] == wanted
                mixed, left = np.where(met, m[at], mixed), np.where(met, rest[at], left)
        return mixed, left


def by_suffix(grams: DataFrame, work, fields: str) -> DataFrame:
    """``work`` on whole groups of grams with the same last ``SUFFIX`` bytes of context, many small ones at a time."""
    mask = (1 << (8 * SUFFIX)) - 1

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= CHUNK_GRAMS:
                rows = pa.concat_tables(held)
                suffix = rows.column("ctx").to_numpy() & mask
                cut = int(np.searchsorted(suffix, suffix[-1]))
                if cut:
                    yield work(rows.slice(0, cut))
                held, size = [rows.slice(cut)], size - cut
        if size:
            yield work(pa.concat_tables(held))

    dealt = grams.select("ctx", "byte", "n", F.col("ctx").bitwiseAND(F.lit(mask)).alias("suffix"))
    return dealt.repartition("suffix").sortWithinPartitions("suffix").mapInArrow(run, fields)


def deep(rows: pa.Table) -> Deep:
    get = lambda c: rows.column(c).to_numpy().astype(np.int64)
    return Deep(get("ctx"), get("byte"), get("n").astype(float))


def fit_upper(grams: DataFrame) -> Upper:
    """The upper levels over all grams (ctx, byte, n); what reaches the driver is bounded by the number of two-byte contexts."""

    def sums(rows: pa.Table) -> pa.RecordBatch:
        trees = deep(rows)
        keys, up = np.unique(at_depth(trees.keys, SUFFIX - 1), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, *(np.bincount(up, c) for c in (*trees.counts, trees.below)))], names=["key", "zeros", "ones", "below"])

    got = by_suffix(grams, sums, "key long, zeros double, ones double, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    get = lambda c: got.column(c).to_numpy()
    return Upper(get("key"), np.stack([get("zeros"), get("ones")]), get("below"))


def gram_logs(grams: DataFrame, upper) -> DataFrame:
    """(code, n, p) of all grams: p is the log10 chance of the byte after its context, by all contexts seen."""

    def logs(rows: pa.Table) -> pa.RecordBatch:
        trees = deep(rows)
        ones = trees.ones(upper.value)
        p = np.log10(np.where(trees.bits == 1, ones, 1 - ones)).sum(1)
        code = rows.column("ctx").to_numpy() << 8 | rows.column("byte").to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(rows.column("n").to_numpy()), pa.array(p)], names=["code", "n", "p"])

    return by_suffix(grams, logs, "code long, n long, p double")


def slots(code: np.ndarray) -> np.ndarray:
    return (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def frequent(logs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A table by slot of up to ``most`` grams, those of the highest counts, with their log10 chances."""
    step = F.floor(F.log2("n") * 16).cast("int")
    total, least = 0, 1 << 20
    for r in sorted(logs.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True):
        total += r["k"]
        if total > most:
            break
        least = r["step"]
    got = logs.where(step >= least).toArrow()
    order = np.argsort(got.column("n").to_numpy(), kind="stable")
    code, p = got.column("code").to_numpy()[order], got.column("p").to_numpy()[order]
    keys, values = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS)
    at = slots(code)
    keys[at], values[at] = code, p
    return keys, values


def token_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all training texts."""

    def count(batches):
        held: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return got

        for batch in batches:
            for text in batch.column(0):
                held.update((text.as_py() or b"").translate(LOWER).split())
                if len(held) > FLUSH:
                    yield out()
        yield out()

    return training.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, training: DataFrame, keep: list[str], hot_grams: int = 1 << 19, hot_words: int = 30_000) -> DataFrame:
    """The ``keep`` columns of ``docs`` with n_tokens, n_known, train_tokens, base_score, score (log10 chance of the text
    under the weighted trees) and bits_per_byte.

    The ``hot_words`` most frequent words and ``hot_grams`` most frequent grams go to every task; all rarer ones meet
    their counts and chances in joins, so that these two numbers change no result.
    """
    spark = docs.sparkSession
    grams = stored(gram_counts(training))
    upper = spark.sparkContext.broadcast(fit_upper(grams))
    logs = stored(gram_logs(grams, upper))
    table = spark.sparkContext.broadcast(frequent(logs, hot_grams))
    counts = stored(token_counts(training))
    n_texts = training.count()
    words, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, distinct = total + n_texts, words + (n_texts > 0)
    below = total + 0.5 * (distinct + 1)
    hot = {bytes(r["word"]): r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(hot_words).collect()}
    shared = spark.sparkContext.broadcast(hot)

    def make():
        (keys, values), known = table.value, shared.value
        log_of = {w: math.log10((n + 0.5) / below) for w, n in known.items()}
        end = math.log10((n_texts + 0.5) / below)

        def work(text: bytes | None):
            text = text or b""
            found = text.translate(LOWER).split()
            base, n_known, rare, rare_n = end, int(n_texts > 0), [], []
            for w, n in Counter(found).items():
                got = log_of.get(w)
                if got is None:
                    rare.append(w)
                    rare_n.append(n)
                else:
                    base += n * got
                    n_known += n
            c = codes(text)
            at = slots(c)
            hit = keys[at] == c
            score = float(values[at[hit]].sum())
            missed, missed_n = np.unique(c[~hit], return_counts=True)
            return len(found) + 1, n_known, base, score, len(c), rare, rare_n, missed, missed_n.astype(np.int32)

        return work

    first = map_texts(docs, make, "n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<binary>, rare_n array<int>, missed array<long>, missed_n array<int>", keep)
    first = stored(first.withColumn("_row", F.monotonically_increasing_id()))
    rare = first.select("_row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("rare_n").alias("k"))).alias("x")).select("_row", "x.word", "x.k")
    met = rare.join(counts, "word", "left").groupBy("_row").agg(
        F.sum(F.col("k") * F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(below))).alias("_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("_known")
    )
    missed = first.select("_row", F.explode(F.arrays_zip(F.col("missed").alias("code"), F.col("missed_n").alias("k"))).alias("x")).select("_row", "x.code", "x.k")
    new = stored(missed.select("code").distinct().join(logs.select("code"), "code", "left_anti"))
    fresh = new.select(F.shiftright("code", 8).alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).cast("smallint").alias("byte"), F.lit(0).cast("long").alias("n"))
    around = grams.join(fresh.select(F.col("ctx").bitwiseAND(F.lit((1 << (8 * SUFFIX)) - 1)).alias("s")).distinct(), F.col("ctx").bitwiseAND(F.lit((1 << (8 * SUFFIX)) - 1)) == F.col("s"), "left_semi")
    unseen = gram_logs(around.unionByName(fresh), upper).where("n = 0")
    chances = logs.unionByName(unseen).select("code", "p")
    coded = missed.join(chances, "code").groupBy("_row").agg(F.sum(F.col("k") * F.col("p")).alias("_score"))
    score = F.col("score") + F.coalesce("_score", F.lit(0.0))
    return first.drop("rare", "rare_n", "missed", "missed_n").join(met, "_row", "left").join(coded, "_row", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
