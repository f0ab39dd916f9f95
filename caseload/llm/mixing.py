"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Each source's share of all tokens is raised to an exponent and normalised to its weight. The exponent is bisected: it is
the largest in [0, 1] whose weights reach the target entropy (a share of that of equal weights), and if that would
repeat a source more often than ``max_repeats`` it rises until none is. A source's budget is its weight times the whole
budget; without a given budget it is the least at which every document of every source is used at least once.

A source's documents are dealt to blocks by hash, about ``block_tokens`` tokens to a block. Each pass over a source takes
its blocks in an order permuted by hash, and the documents of a block in an order permuted by hash. All passes but the
last are whole; in the last, blocks are used up to the one in which the budget ends, and that one in part. So a document
needs to know no more than its source's row: how many passes are whole, and up to which block the last one goes. Sources
may be many: their totals stay a table, and only sums over it reach the driver.

Defined results for odd input: null source is a source of its own; null text has no tokens, and a document without
tokens is used once in each whole pass; ties of the hash go by id, then by number of tokens; repeated rows are documents
of their own; columns named as a result give way to it, all others pass through; an empty table gives an empty schedule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import stored

SPACES = "\t\n\x0b\x0c\r"
#: Bisection levels whose midpoints are evaluated in one pass over the sources; levels in all.
LEVELS, DEPTH = 8, 32
#: Classes of a pass's block order, by its upper bits, in which the end of a budget is searched first.
ORDER_CLASSES = 4096


def token_count(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` a text has."""
    return F.size(F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * 5), " "), "")).cast("long")


def evaluated(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a, the sums of s^a and of s^a ln s over the shares ``s``, from which entropies follow."""
    raised = shares.select("s", F.posexplode(F.lit(exponents)).alias("i", "a")).select("i", "s", F.pow("s", "a").alias("x"))
    got = {r["i"]: (r["z"], r["l"]) for r in raised.groupBy("i").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("s")).alias("l")).collect()}
    return [got[i] for i in range(len(exponents))]


def entropy(a: float, z: float, l: float) -> float:
    """Of the weights s^a / z."""
    return math.log(z) - a * l / z


def bisected(shares: DataFrame, ok, low: float, high: float) -> float:
    """The exponent nearest to ``high`` for which ``ok(a, sums)`` holds; it holds at ``low``.

    The midpoints of the next few levels are evaluated together, so a bisection is a handful of passes over the sources.
    """
    for _ in range(DEPTH // LEVELS):
        n = 1 << LEVELS
        points = [low + (high - low) * i / n for i in range(n + 1)]
        sums = evaluated(shares, points)
        left, right = 0, n
        if ok(points[right], *sums[right]):
            return high
        while right - left > 1:
            mid = (left + right) // 2
            left, right = (mid, right) if ok(points[mid], *sums[mid]) else (left, mid)
        low, high = points[left], points[right]
    return low


def exponent_for(shares: DataFrame, target_entropy: float, max_repeats: float, budget_share: float | None) -> float:
    """For ``shares`` (column s, all positive). ``target_entropy`` as a share of the entropy of equal weights;
    ``budget_share``: the budget as a share of all tokens."""
    n, least, most = shares.agg(F.count("*"), F.min("s"), F.max("s")).first()
    goal = target_entropy * math.log(n)
    exponent = bisected(shares, lambda a, z, l: entropy(a, z, l) >= goal - 1e-12, 0.0, 1.0)

    def allowed(a: float, z: float, _: float) -> bool:
        ratio = (most / least) ** (1 - a) if budget_share is None else least ** (a - 1) / z * budget_share
        return ratio <= max_repeats + 1e-9

    return bisected(shares, allowed, 1.0, exponent)


def mixture(totals: DataFrame, target_entropy: float, max_repeats: float, budget: int | None) -> DataFrame:
    """``totals`` (source, tokens) with source_weight, and budget in tokens."""
    all_tokens = totals.agg(F.sum("tokens")).first()[0]
    if not all_tokens:
        return totals.withColumns({"source_weight": F.lit(0.0), "budget": F.lit(0).cast("long")})
    share = F.col("tokens") / all_tokens
    shares = totals.where("tokens > 0").select(share.alias("s"))
    budget_share = None if budget is None else budget / all_tokens
    a = exponent_for(shares, target_entropy, max_repeats, budget_share)
    z, most = shares.agg(F.sum(F.pow("s", F.lit(a))), F.max("s")).first()
    scale = budget_share if budget_share is not None else z * most ** (1 - a)  # the largest source is used once
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a)) / z).otherwise(0.0)
    return totals.withColumn("source_weight", weight).withColumn("budget", F.round(F.col("source_weight") * (scale * all_tokens)).cast("long"))


def order_key(seed: int, pass_no: Column, block: Column) -> Column:
    """By which a pass orders its blocks."""
    return F.xxhash64(F.lit(seed), pass_no, block)


def last_blocks(narrow: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(source, end_order, end_block, left): the block in which each source's last pass ends, and how many tokens of it are used.

    It is searched by classes of the order first, so that no source's blocks are sorted as one.
    """
    same = F.col("source").eqNullSafe(F.col("of"))
    partly = plan.where("remaining > 0").select(F.col("source").alias("of"), "blocks", "whole", "remaining")
    block = F.pmod("h", F.col("blocks"))
    sums = narrow.join(partly, same).groupBy("source", "whole", "remaining", block.alias("block")).agg(F.sum("n").alias("n"))
    sums = stored(sums.withColumn("o", order_key(seed, F.col("whole") + 1, F.col("block"))))
    upper = F.shiftright("o", 64 - ORDER_CLASSES.bit_length() + 1)
    running = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = sums.groupBy("source", "remaining", upper.alias("class")).agg(F.sum("n").alias("n")).withColumn("before", running("class"))
    ends = lambda: (F.col("before") < F.col("remaining")) & (F.col("remaining") <= F.col("before") + F.col("n"))
    at = stored(classes.where(ends()).select(F.col("source").alias("of"), "class", F.col("before").alias("earlier")))
    inside = sums.join(at, same & (upper == F.col("class"))).withColumn("before", F.col("earlier") + running("o", "block"))
    return inside.where(ends()).select("source", F.col("o").alias("end_order"), F.col("block").alias("end_block"), (F.col("remaining") - F.col("before")).alias("left"))


#: Result columns.
RESULTS = ("n_tokens", "source_weight", "pass_no", "block_order", "place")


def scheduled(docs: DataFrame, own: list[str], target_entropy: float, max_repeats: float, budget: int | None, block_tokens: int, seed: int) -> DataFrame:
    """``own`` (a struct of those columns) and the result columns for each use of a row of ``docs``."""
    tokens = token_count(F.col("text"))
    rows = docs.select(F.struct(*own).alias("own"), "source", F.col("doc_id").alias("id"), tokens.alias("n"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    narrow = stored(rows.select("source", "n", "h"))
    totals = stored(narrow.groupBy("source").agg(F.sum("n").alias("tokens")))
    some = F.col("tokens") > 0
    plan = mixture(totals, target_entropy, max_repeats, budget).select(
        "source",
        "source_weight",
        F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("tokens") / block_tokens)))).cast("long").alias("blocks"),
        F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long").alias("whole"),
        F.when(some, F.col("budget") - F.floor(F.col("budget") / F.col("tokens")) * F.col("tokens")).otherwise(0).cast("long").alias("remaining"),
    )
    plan = stored(plan)
    ends = last_blocks(narrow, plan, seed).withColumnRenamed("source", "of")
    plan = stored(plan.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "remaining")).withColumnRenamed("source", "of")
    passes = F.sequence(F.lit(1).cast("long"), F.col("whole") + F.when(F.col("end_order").isNotNull(), 1).otherwise(0))
    used = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).where((F.col("whole") > 0) | F.col("end_order").isNotNull())
    used = used.withColumn("block", F.pmod("h", F.col("blocks"))).withColumn("pass_no", F.explode(passes))
    used = used.withColumn("block_order", order_key(seed, F.col("pass_no"), F.col("block"))).withColumn("place", F.xxhash64("pass_no", "h"))
    earlier = (F.col("pass_no") <= F.col("whole")) | (F.col("block_order") < F.col("end_order")) | ((F.col("block_order") == F.col("end_order")) & (F.col("block") < F.col("end_block")))
    ending = (F.col("pass_no") > F.col("whole")) & (F.col("block") == F.col("end_block"))
    out = ["own", F.col("n").alias("n_tokens"), "source_weight", "pass_no", "block_order", "place"]
    before = Window.partitionBy("of").orderBy("place", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
    partly = used.where(ending).withColumn("spent", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("spent") < F.col("left"))
    return used.where(earlier & ~ending).select(*out).unionByName(partly.select(*out))


def mix_sources(
    docs: DataFrame, target_entropy: float = 0.97, max_repeats: float = 2.0, budget: int | None = None, block_tokens: int = 100_000, seed: int = 7
) -> DataFrame:
    """A row of ``docs`` for each use of a document, with ``n_tokens``, ``source_weight``, ``pass_no``, ``block_order`` and ``place``.

    The mixture is read in the order of source, pass_no, block_order and place. ``docs`` needs doc_id, text and source.
    Texts are joined to one row for each source, and only those of the blocks in which budgets end are shuffled for
    their order.
    """
    own = [c for c in docs.columns if c not in RESULTS]
    return scheduled(docs, own, target_entropy, max_repeats, budget, block_tokens, seed).select(*[F.col("own")[c].alias(c) for c in own], *RESULTS)


def mixed_rows(docs: DataFrame, target_entropy: float = 0.97, max_repeats: float = 2.0, budget: int | None = None, block_tokens: int = 100_000, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` uses them, with all their own columns and no others."""
    return scheduled(docs, docs.columns, target_entropy, max_repeats, budget, block_tokens, seed).select("own.*")
