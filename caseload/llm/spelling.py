"""Spelling variant grouping: words one edit apart, found in a trie of letter counts, and the form that each word leads to.

A word is a vector of counts by letter group (32 groups, by the lower five bits of the code point). The trie arranges words
by successive counts, the groups that vary most first. A search goes down with a budget of one surplus and one deficit: at
each level the candidate has as many letters of the group as the word, or one more, or one fewer. One edit changes no more
than that, so every near word is at a leaf that the search reaches; there it is verified letter by letter. Each pair is
found from one side: the shorter word, or of equally long ones that whose surplus comes first (the smaller word, if their
counts are the same).

The top of the trie is a table: cells of over ``most`` words are cut by further groups, and searches descend through joins
with the cells that exist. What is below such a cut is a subtree of at most ``most`` words; a task builds it and walks it
depth-first with the searches that reach it, at most ``searches`` at a time. Words of equal counts in all groups, if over
``most``, are dealt to blocks by hash, and every search that reaches them visits each block.

Defined results for odd input: null or empty texts have no words; a null id counts as the empty text; rows that share an id
count for themselves; ties of a form's n go to the smallest word in code-point order; an empty table gives an empty result;
other columns are never read. Words of any length are compared whole.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import stored

GROUPS = 32
#: Levels that one step of the table part descends.
STEP = 3
#: Ranges of the trie that are compared at once; width up to which words are compared as one matrix; pairs to a matrix.
LEAF, WIDE, PAIRS = 8, 48, 1 << 18
#: A run's letters: fixed by the definition of a word.
LETTERS = [*string.ascii_letters, *map(chr, range(0xC0, 0x100))]
RUN = "[a-zÀ-ÿ]+"
EVERY, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the runs of letters of whole texts, lower-cased in A-Z only; where ``EVERY`` divides the crc32 of
    ``<doc_id>:<run>``, the letter that it points at is left out."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_counts(word: Column) -> list[Column]:
    """How many letters of each group a word has."""
    of = lambda g: "".join(c for c in LETTERS if ord(c) % GROUPS == g)
    return [F.length(word) - F.length(F.translate(word, of(g), "")) for g in range(GROUPS)]


def level_order(words: DataFrame) -> list[int]:
    """Groups, those whose counts vary most first."""
    got = words.select(*[c.cast("double").alias(f"g{g}") for g, c in enumerate(letter_counts(F.col("word")))]).agg(*[F.var_pop(f"g{g}") for g in range(GROUPS)]).first()
    return sorted(range(GROUPS), key=lambda g: (-round(got[g] or 0.0, 9), g))


def descended(searches: DataFrame, depth: int) -> DataFrame:
    """Each search at every node that its budget reaches ``STEP`` levels below ``depth``, whether or not the node exists.

    ``spent``: 0 nothing yet, 1 the surplus, 2 the deficit too; a deficit is spent only after the surplus.
    """
    levels = range(depth, min(depth + STEP, GROUPS))
    moves = [(0, {})] + [(1, {i: 1}) for i in levels] + [(2, {i: 1, j: -1}) for i in levels for j in levels if i < j]
    moves = [(0, after, m) for after, m in moves] + [(1, 1, {})] + [(1, 2, {j: -1}) for j in levels] + [(2, 2, {})]

    def reached(before: int, after: int, move: dict[int, int]) -> Column:
        counts = [F.col("counts")[i] + move.get(i, 0) for i in levels]
        possible = F.col("spent") == before
        for i, d in move.items():
            possible = possible & (F.col("counts")[i] + d >= 0)
        return F.when(possible, F.struct(F.lit(after).alias("spent"), F.concat_ws(",", "cell", *counts).alias("cell")))

    nodes = F.filter(F.array(*[reached(*m) for m in moves]), lambda x: x.isNotNull())
    return searches.withColumn("to", F.explode(nodes)).withColumns({"spent": F.col("to.spent"), "cell": F.col("to.cell")}).drop("to")


def subtrees(words: DataFrame, order: list[int], most: int) -> tuple[DataFrame, DataFrame]:
    """(words, searches) with the subtree ``cell``, cut at ``depth``, to which each belongs and goes; ``blocks`` where it is dealt."""
    every = letter_counts(F.col("word"))
    held = stored(words.withColumn("counts", F.array(*[every[g] for g in order])).withColumn("cell", F.lit("")))
    asked, depth, parts, total = held.withColumn("spent", F.lit(0)), 0, [], held.count()
    largest = total
    while True:
        last = largest <= most or depth == GROUPS
        cells = held.groupBy("cell").agg(F.count("*").alias("size"))
        cells = stored(cells) if depth else cells
        done = cells if last else cells.where(F.col("size") <= most)
        extra = {"depth": F.lit(depth), "blocks": F.ceil(F.col("size") / most).cast("int")}
        parts.append((held.join(done, "cell").withColumns(extra).select("cell", "depth", "blocks", "word", "n"), asked.join(done, "cell").withColumns(extra).select("cell", "depth", "blocks", "word", "n", "spent")))
        if last:
            break
        big = cells.where(F.col("size") > most).select("cell")
        below = F.concat_ws(",", "cell", *[F.col("counts")[i] for i in range(depth, min(depth + STEP, GROUPS))])
        held, asked = held.join(big, "cell").withColumn("cell", below), descended(asked.join(big, "cell"), depth)
        depth = min(depth + STEP, GROUPS)
        largest = held.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    index, searches = parts[0]
    for more, asks in parts[1:]:
        index, searches = index.unionByName(more), searches.unionByName(asks)
    return index, searches


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether ``b``, which is as long as ``a`` or longer by one letter, is one replacement or insertion away."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


class Words:
    """Words as bytes (every letter is below 256), as count vectors in level order, and the short ones as one matrix."""

    def __init__(self, words: list[str], order: list[int]):
        self.raw = [w.encode("latin-1") for w in words]
        self.length = np.array([len(w) for w in self.raw], dtype=np.int64)
        codes = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        row = np.repeat(np.arange(len(words)), self.length)
        self.counts = np.bincount(row * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)[:, order].astype(np.int32)
        short = self.length <= WIDE
        self.letters = np.zeros((len(words), WIDE + 1), dtype=np.uint8)
        keep = short[row]
        column = np.arange(len(codes)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.letters[row[keep], column[keep]] = codes[keep]


def verified(a: Words, b: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (word i of ``a``, word j of ``b``, as long or one longer) are one edit apart."""
    out = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), PAIRS):
        x, y = i[s : s + PAIRS], j[s : s + PAIRS]
        n, m = a.length[x], b.length[y]
        left, right = a.letters[x], b.letters[y]
        same = left == right
        ok = (m == n) & ((~same).sum(1) == 1)
        lead = np.minimum(np.argmin(np.pad(same, ((0, 0), (0, 1))), axis=1), n)
        shifted = (left[:, :-1] == right[:, 1:]) | (np.arange(WIDE) >= n[:, None])
        tail = np.argmin(np.pad(shifted[:, ::-1], ((0, 0), (0, 1))), axis=1) - (WIDE - n)
        ok |= (m == n + 1) & (lead + tail >= n)
        for k in np.flatnonzero(np.maximum(n, m) > WIDE):
            ok[k] = a.length[x[k]] <= b.length[y[k]] and one_edit(a.raw[x[k]], b.raw[y[k]])
        out[s : s + PAIRS] = ok
    return out


def near_pairs(index: Words, searches: Words, spent: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(search, word) pairs whose counts differ by no more than the budget, from a depth-first walk of the trie below ``depth``."""
    rows = np.lexsort(index.counts.T[::-1])
    counts = index.counts[rows]
    stack = [(0, len(rows), depth, np.arange(len(spent)), spent)]
    while stack:
        lo, hi, level, who, used = stack.pop()
        if hi - lo <= LEAF or level == GROUPS:
            for s in range(0, len(who), max(1, PAIRS // (hi - lo))):
                q = who[s : s + max(1, PAIRS // (hi - lo))]
                more = counts[None, lo:hi, level:] - searches.counts[q, None, level:]
                left = used[s : s + len(q), None]
                over, under = more == 1, more == -1
                n_over, n_under = over.sum(2), under.sum(2)
                fits = (np.abs(more).sum(2) == n_over + n_under) & (n_over <= (left == 0)) & (n_under <= np.where(left == 0, n_over, left == 1))
                if level < GROUPS:  # a deficit only after the surplus
                    fits &= (n_over == 0) | (n_under == 0) | (over.argmax(2) < under.argmax(2))
                at = np.nonzero(fits)
                if len(at[0]):
                    yield q[at[0]], rows[lo + at[1]]
            continue
        values = counts[lo:hi, level]
        cuts = np.flatnonzero(np.diff(values)) + 1
        has = searches.counts[who, level]
        for s, e in zip([0, *cuts], [*cuts, hi - lo], strict=True):
            more = values[s] - has
            keep = (more == 0) | ((more == 1) & (used == 0)) | ((more == -1) & (used == 1))
            if keep.any():
                stack.append((lo + s, lo + e, level + 1, who[keep], used[keep] + (more[keep] != 0)))


def walked(order: list[int]):
    """The walk of one subtree: near-word counts and best near words of its words and of the searches that reached it."""

    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asked):
            return pd.DataFrame(columns=["word", "n_near", "form", "form_n"], dtype=object)
        index, searches = Words(list(held["word"]), order), Words(list(asked["word"]), order)
        found = []
        for i, j in near_pairs(index, searches, asked["spent"].to_numpy(np.int64), int(held["depth"].iloc[0])):
            ok = verified(searches, index, i, j)
            found.append((i[ok], j[ok]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
        a, b = asked.iloc[i].reset_index(drop=True), held.iloc[j].reset_index(drop=True)
        alike = (searches.counts[i] == index.counts[j]).all(1)
        once = ~alike | (a["word"] < b["word"]).to_numpy(bool)
        a, b = a[once], b[once]
        both = pd.DataFrame({"word": [*a["word"], *b["word"]], "form": [*b["word"], *a["word"]], "form_n": [*b["n"], *a["n"]]})
        if not len(both):
            return pd.DataFrame(columns=["word", "n_near", "form", "form_n"], dtype=object)
        both = both.sort_values(["word", "form_n", "form"], ascending=[True, False, True], kind="stable")
        return both.groupby("word", sort=False).agg(n_near=("form", "size"), form=("form", "first"), form_n=("form_n", "first")).reset_index().astype({"word": object, "form": object})

    return run


def near_words(words: DataFrame, most: int = 16_384, searches: int = 131_072) -> DataFrame:
    """(word, n_near, form, form_n) of each word of ``words`` (word, n; words distinct) that has near words: how many, and that
    of largest n (ties: smallest)."""
    order = level_order(words)
    index, asked = (stored(x) for x in subtrees(words, order, most))
    parts = stored(asked.groupBy("cell").agg(F.ceil(F.count("*") / searches).cast("int").alias("parts")))
    dealt = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.join(parts, "cell").withColumn("block", dealt).withColumn("part", every("parts"))
    asked = asked.join(parts.toDF("cell", "of"), "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "word"), F.col("of")).cast("int")).withColumn("block", every("blocks"))
    by = ["cell", "block", "part"]
    met = index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(walked(order), "word string, n_near long, form string, form_n long")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("order"), "form")).alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.order")).alias("form_n")
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) with the ``root`` to which following forms leads. Links are doubled until none moves on;
    as a form is at least twice as frequent as its word, that is six times at most."""
    to = stored(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        further = to.where("root != word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(to.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        to = moved.select("word", "root")
        if moved.where("went").isEmpty():
            return forms.join(to, "word")


def group_variants(docs: DataFrame, most: int = 16_384, searches: int = 131_072) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``docs`` (doc_id, text)."""
    words = stored(word_counts(docs))
    near = words.join(near_words(words, most, searches), "word", "left")
    led = F.col("form_n") >= 2 * F.col("n")
    forms = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("form")).alias("form"), F.when(led, F.col("form_n")).alias("form_n"))
    return with_roots(stored(forms))
