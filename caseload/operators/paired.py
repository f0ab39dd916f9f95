"""Paired conditions: transitions, exact tests, and bootstraps over clusters.

Counts are additive, so a bootstrap resamples clusters' counts, never rows. A cluster's weight in a replicate is a
Poisson draw (mean 1), so n clusters with equal counts together weigh a Poisson draw of mean n. Clusters are grouped by
their counts, and each group draws from its hash, alike on any partitioning: blocks of powers of two up to 64 by inversion,
so the work of a replicate is a draw for every 64 equal clusters. Bootstraps of medians draw the largest multiple of 64
as one block, by a normal quantile with the skewness and kurtosis of the Poisson law: seven draws a value at most.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.functions import scalars as S
from caseload.operators import order as O
from caseload.session import stored

#: Sizes of the blocks in which clusters of equal counts draw their weight by inversion; medians take multiples of ``LARGE`` as one block.
BLOCKS, LARGE = (1, 2, 4, 8, 16, 32), 64


def pair(named: DataFrame, renamed: DataFrame) -> DataFrame:
    """Decisions scored in both conditions: (doc_id, question, gold, x, y, px, py)."""
    side = lambda df, v, p: df.where("not error and gold is not null").select("doc_id", "question", "gold", F.col("label").alias(v), F.col("p").alias(p))
    return side(named, "x", "px").join(side(renamed, "y", "py").drop("gold"), ["doc_id", "question"])


def transitions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The eight counts of (gold, before, after), changes, and mean shifts of the score."""
    named = {f"n{g}{x}{y}": F.count_if((F.col("gold") == g) & (F.col("x") == x) & (F.col("y") == y)) for g in (0, 1) for x in (0, 1) for y in (0, 1)}
    changed = F.col("x") != F.col("y")
    shift = F.abs(F.col("py") - F.col("px"))
    middle = O.quantiles(pairs.select(*keys, shift.alias("shift")), keys, "shift", {"median_shift": 0.5})
    return pairs.groupBy(*keys).agg(
        *[c.alias(k) for k, c in named.items()],
        F.count_if(changed & (F.col("x") == F.col("gold"))).alias("lost"),
        F.count_if(changed & (F.col("y") == F.col("gold"))).alias("gained"),
        F.avg(shift).alias("mean_shift"),
        F.count_if(changed & (F.abs(F.col("px") - 0.5) < 0.1)).alias("near_threshold"),
    ).join(middle, keys, "left")


@F.pandas_udf(T.DoubleType())
def mcnemar(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided McNemar p of discordant counts: one value for each row of counts."""
    return pd.Series([S.mcnemar_exact(int(x), int(y)) for x, y in zip(b, c, strict=True)])


def with_test(counted: DataFrame) -> DataFrame:
    return counted.withColumn("p_value", mcnemar("lost", "gained"))


def cluster_counts(pairs: DataFrame, cluster: str) -> DataFrame:
    """Cells of both conditions for each cluster."""
    cell = {f"{k}_{v}": F.count_if((F.col(v) == a) & (F.col("gold") == b)) for v in "xy" for k, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))}
    return pairs.groupBy(cluster).agg(*[c.alias(k) for k, c in cell.items()])


def poisson_steps(mean: int) -> list[float]:
    """Distribution function of a Poisson variable at 0, 1, 2 ... to beyond any 48-bit uniform."""
    total, term, steps = 0.0, math.exp(-mean), []
    for k in range(int(mean + 12 * math.sqrt(mean) + 12)):
        total += term
        steps.append(total)
        term *= mean / (k + 1)
    return steps


def inverted(size: Column, u: Column, sizes: tuple[int, ...], out: Column | None = None) -> Column:
    """A Poisson draw whose mean is ``size``, one of ``sizes``, by inversion of the uniform ``u``; else ``out``."""
    out = F.lit(0) if out is None else out
    for mean in sizes:
        drawn = F.size(F.filter(F.array(*map(F.lit, poisson_steps(mean))), lambda x: x <= u))
        out = F.when(size == mean, drawn).otherwise(out)
    return out


def poisson_weight(size: Column, u: Column, z: Column) -> Column:
    """A Poisson draw whose mean is ``size`` (1, 2, 4 to 32, or a multiple of 64), by the uniform ``u`` and its normal quantile ``z``."""
    spread = F.sqrt(size)
    out = F.greatest(F.floor(size + spread * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * spread) + 0.5), F.lit(0))
    return inverted(size, u, BLOCKS, out)


def blocks_of(n: Column) -> Column:
    """The sizes of the blocks of n: its multiple of ``LARGE`` and the powers of two that are left."""
    sizes = [(n - n % LARGE).cast("long"), *[F.when(n.bitwiseAND(b) > 0, F.lit(b).cast("long")).otherwise(F.lit(0).cast("long")) for b in BLOCKS]]
    return F.filter(F.array(*sizes), lambda s: s > 0)


def drawn_weights(alike: DataFrame, n: str, by: list[str], replicates: int, salt: str = "boot") -> DataFrame:
    """``alike`` for each replicate with ``w``, the weight of a block of its ``n``; replicate 0 weighs all as they are."""
    blocks = alike.select("*", F.explode(blocks_of(F.col(n))).alias("_size"))
    drawn = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    drawn = drawn.withColumn("_u", S.uniform(salt, F.col("replicate"), F.col("_size"), *map(F.col, by)))
    drawn = drawn.withColumn("_z", F.when(F.col("_size") >= LARGE, S.normal_quantile(F.col("_u"))))
    return drawn.withColumn("w", F.when(F.col("replicate") == 0, F.col("_size")).otherwise(poisson_weight(F.col("_size"), F.col("_u"), F.col("_z")))).drop("_size", "_u", "_z")


def resampled(clusters: DataFrame, cells: list[str], replicates: int) -> DataFrame:
    """(replicate, sums of cells): clusters drawn with replacement; replicate 0 is the data. Cells are whole numbers.

    Every draw is by inversion: of ``n`` clusters with equal cells each 64 draw together, and the powers of two that are left.
    """
    alike = clusters.groupBy(*cells).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    whole = F.transform(F.sequence(F.lit(0), F.floor(n / LARGE)), lambda i: F.struct(i.alias("i"), F.when(i < F.floor(n / LARGE), LARGE).otherwise(0).alias("size")))
    rest = F.array(*[F.struct(F.lit(-1).cast("long").alias("i"), F.when(n.bitwiseAND(b) > 0, b).otherwise(0).alias("size")) for b in BLOCKS])
    blocks = alike.select(*cells, F.explode(F.concat(whole, rest)).alias("_b")).where("_b.size > 0")
    size = F.col("_b.size")
    drawn = blocks.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    drawn = drawn.withColumn("_u", S.uniform("boot", F.col("replicate"), size, F.col("_b.i"), *map(F.col, cells)))
    drawn = drawn.withColumn("w", F.when(F.col("replicate") == 0, size).otherwise(inverted(size, F.col("_u"), (*BLOCKS, LARGE))))
    return drawn.groupBy("replicate").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in cells])


def bootstrap_median(rows: DataFrame, keys: list[str], value: str, replicates: int = 1000) -> DataFrame:
    """(keys, replicate, median): of the rows, drawn with replacement; replicate 0 is the data. Nulls are passed over.

    A replicate's median can only lie near the middle: values more than 4 sqrt(n) + 8 rows from it, over eight standard
    deviations, count as the outermost value within. So a replicate weighs some 8 sqrt(n) values of a key, not all.
    """
    at = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    at = stored(O.running(at, keys, [value], {"_upto": F.col("_k")}))
    n = at.groupBy(*keys).agg(F.max("_upto").alias("_n"))
    reach = 4 * F.sqrt("_n") + 8
    inside = (F.col("_upto") >= F.col("_n") / 2 - reach) & (F.col("_upto") - F.col("_k") <= F.col("_n") / 2 + reach)
    ends = O._with(at, n, keys).where(inside).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    near = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    alike = O._with(at, ends, keys).groupBy(*keys, near.alias("_v")).agg(F.sum("_k").alias("_n"))
    weighed = drawn_weights(alike, "_n", [*keys, "_v"], replicates, "median").groupBy(*keys, "replicate", "_v").agg(F.sum("w").alias("_w"))
    by = Window.partitionBy(*keys, "replicate")
    ran = weighed.withColumns({"_to": F.sum("_w").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(by)})
    holds = lambda i: (F.col("_to") - F.col("_w") <= i) & (i < F.col("_to"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    one = lambda i: F.max(F.when(holds(i), F.col("_v")))
    return ran.groupBy(*keys, "replicate").agg(((one(low) + one(high)) / 2).alias("median"))


def deltas(suffix: str = "") -> dict[str, Column]:
    """After minus before of each rate, from summed cells."""
    def of(v: str) -> dict[str, Column]:
        tp, fp, fn, tn = (F.col(f"{k}_{v}{suffix}") for k in ("tp", "fp", "fn", "tn"))
        return {"precision": S.rate_null(tp, tp + fp), "recall": S.rate_null(tp, tp + fn), "f1": S.f1_counts(tp, fp, fn), "accuracy": S.rate_null(tp + tn, tp + fp + fn + tn)}

    x, y = of("x"), of("y")
    return {k: y[k] - x[k] for k in x}


def bootstrap_deltas(clusters: DataFrame, cluster: str, replicates: int = 500) -> DataFrame:
    """(replicate, d_precision, d_recall, d_f1, d_accuracy): after minus before in each replicate; replicate 0 is the data."""
    s = resampled(clusters, [c for c in clusters.columns if c != cluster], replicates)
    return s.select("replicate", *[c.alias(f"d_{k}") for k, c in deltas().items()])


def bootstrap_split(pairs: DataFrame, cluster: str, inside: Column, replicates: int = 500) -> DataFrame:
    """The same draws of clusters inside and outside a subset: difference (inside less outside) of the changes of each rate."""
    sides = [cluster_counts(pairs.where(c), cluster) for c in (inside, ~inside)]
    named = [df.select(cluster, *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c != cluster]) for k, df in zip("io", sides, strict=True)]
    both = named[0].join(named[1], cluster, "full").fillna(0)
    s = resampled(both, [c for c in both.columns if c != cluster], replicates)
    a, b = deltas("_i"), deltas("_o")
    return s.select("replicate", *[(a[k] - b[k]).alias(f"d_{k}") for k in a])


def bootstrap_rate(rows: DataFrame, cluster: str, hit: Column, replicates: int = 500) -> DataFrame:
    """(replicate, rate): the share of rows with ``hit``, clusters drawn with replacement."""
    at = rows.groupBy(cluster).agg(F.count_if(hit).alias("k"), F.count("*").alias("n"))
    return resampled(at, ["k", "n"], replicates).select("replicate", S.rate_null(F.col("k"), F.col("n")).alias("rate"))


def intervals(samples: DataFrame, level: float = 0.95) -> DataFrame:
    """(measure, value, low, high) from replicates."""
    measures = [c for c in samples.columns if c != "replicate"]
    long = samples.unpivot(["replicate"], measures, "measure", "v")
    tail = (1 - level) / 2
    drawn = F.when(F.col("replicate") > 0, F.col("v"))
    return long.groupBy("measure").agg(F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("value"), F.percentile(drawn, F.lit(tail)).alias("low"), F.percentile(drawn, F.lit(1 - tail)).alias("high"))


def contrast(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of two bootstraps, replicate by replicate."""
    measures = [c for c in a.columns if c != "replicate"]
    other = b.select("replicate", *[F.col(c).alias(f"_{c}") for c in measures])
    return a.join(other, "replicate").select("replicate", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in measures])


def dose_bands(pairs: DataFrame, dose: str) -> DataFrame:
    """Change of accuracy by terciles of the dose."""
    cuts = O.quantiles(pairs, [], dose, {"c1": 1 / 3, "c2": 2 / 3})
    band = F.when(F.col(dose) <= F.col("c1"), "low").when(F.col(dose) <= F.col("c2"), "middle").otherwise("high")
    right = lambda v: (F.col(v) == F.col("gold")).cast("double")
    return pairs.crossJoin(cuts).groupBy(band.alias("band")).agg(F.count("*").alias("n"), (F.avg(right("y")) - F.avg(right("x"))).alias("d_accuracy"))


def midranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Average rank of each distinct value (1: the smallest), from counts by value."""
    at = rows.groupBy(*keys, value).agg(F.count("*").alias("_k"))
    return O.running(at, keys, [value], {"_upto": F.col("_k")}).select(*keys, value, "_k", (F.col("_upto") - (F.col("_k") - 1) / 2.0).alias("midrank"))


def mann_whitney(rows: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """U of group 1 against 0 and its z: normal approximation with ties, without continuity."""
    s = rank_sums(rows, keys, value, group)
    n1, n0 = F.col("n1"), F.col("n0")
    n = n1 + n0
    u = F.col("r1") - n1 * (n1 + 1) / 2
    variance = n1 * n0 / 12 * ((n + 1) - F.col("t") / S.nonzero(n * (n - 1)))
    return s.select(*keys, "n1", "n0", u.alias("u"), ((u - n1 * n0 / 2) / F.sqrt(S.nonzero(variance))).alias("z"))


def rank_sums(rows: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Rank sum of group 1, sizes of both groups, and the sum of t^3 - t over tied values."""
    at = rows.join(midranks(rows.select(*keys, value), keys, value), [*keys, value])
    ties = F.sum((F.pow("_k", 3) - F.col("_k")) / F.col("_k"))
    return at.groupBy(*keys).agg(F.sum(F.when(F.col(group) == 1, F.col("midrank"))).alias("r1"), F.count_if(F.col(group) == 1).alias("n1"), F.count_if(F.col(group) == 0).alias("n0"), ties.alias("t"))


@F.pandas_udf(T.DoubleType())
def greater(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
    """One-sided exact or corrected p: one value for each row of sums."""
    return pd.Series([S.mann_whitney_greater(float(x or 0), int(a), int(b), round(float(t))) for x, a, b, t in zip(u, n1, n0, ties, strict=True)], dtype=float)


def mann_whitney_greater(rows: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """U of group 1 against 0, and the one-sided p that group 1 is larger (``scalars.mann_whitney_greater``)."""
    s = rank_sums(rows, keys, value, group)
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    p = greater(F.coalesce(u, F.lit(0.0)), "n1", "n0", "t")
    return s.select(*keys, "n1", "n0", u.alias("u"), F.when(~F.isnan(p), p).alias("p_value"))


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation from midranks."""
    ra = midranks(rows.select(*keys, a), keys, a).select(*keys, a, F.col("midrank").alias("ra"))
    rb = midranks(rows.select(*keys, b), keys, b).select(*keys, b, F.col("midrank").alias("rb"))
    return rows.join(ra, [*keys, a]).join(rb, [*keys, b]).groupBy(*keys).agg(S.rate_null(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb")).alias("rho"), F.count("*").alias("n"))


#: Rows of a key up to which the permutation null is drawn; beyond, it is normal (its standard deviation, 1 / sqrt(n - 1), is exact).
DRAWN_UP_TO = 1000


def spearman_test(rows: DataFrame, keys: list[str], a: str, b: str, draws: int = 2000) -> DataFrame:
    """(keys, n, rho, p_value): rank correlation and its two-sided permutation p; null for fewer than three rows or one value.

    The null is drawn from the two lists of ranks (each midrank as often as it occurs), never from the rows: a draw orders
    one list by hashes of places. ``rows`` have no nulls in ``a`` and ``b``.
    """
    rho = stored(spearman(rows, keys, a, b).withColumnRenamed("n", "_rows"))
    few = rho.where(F.col("_rows").between(3, DRAWN_UP_TO) & F.col("rho").isNotNull())
    small = stored(rows.join(few.select(*keys), keys, "left_semi"))

    def ranks(c: str, name: str) -> DataFrame:
        entry = F.struct("midrank", F.col("_k").cast("int").alias("k"))
        return midranks(small.select(*keys, c), keys, c).groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(name))

    both = few.withColumnRenamed("_rows", "n").join(ranks(a, "ra"), keys).join(ranks(b, "rb"), keys)
    listed = lambda c: F.flatten(F.transform(c, lambda x: F.array_repeat(x["midrank"], x["k"])))
    lists = stored(both.select(*keys, "n", "rho", listed("ra").alias("ra"), listed("rb").alias("rb")))
    drawn = lists.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(S.uniform("perm", F.col("draw"), i, *map(F.col, keys)).alias("u"), F.element_at("rb", i).alias("r"))))
    middle = (F.col("n") + 1) / 2.0
    product = F.aggregate(F.zip_with("ra", order, lambda x, y: (x - middle) * (y["r"] - middle)), F.lit(0.0), lambda s, x: s + x)
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - middle) * (x - middle))
    drawn = drawn.select(*keys, "rho", (product / F.sqrt(squares("ra") * squares("rb"))).alias("r"))
    p = drawn.groupBy(*keys).agg(F.avg((F.abs("r") >= F.abs("rho") - 1e-12).cast("double")).alias("_p"))
    out = rho.join(p, keys, "left")
    wide = F.when((F.col("_rows") > DRAWN_UP_TO) & F.col("rho").isNotNull(), two_sided(F.abs("rho") * F.sqrt(F.col("_rows") - 1.0)))
    return out.select(*keys, F.col("_rows").alias("n"), F.when(F.col("_rows") >= 3, F.col("rho")).alias("rho"), F.coalesce("_p", wide).alias("p_value"))


@F.pandas_udf(T.DoubleType())
def two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal p: one value for each row of statistics."""
    return pd.Series([S.normal_two_sided(x) if x == x else None for x in z], dtype=float)


def trend(scores: DataFrame, knowledge: DataFrame, base: str) -> DataFrame:
    """(series, measure, n, rho, p_value): for each system but ``base``, its score and its score less the mean of all systems on
    the same corpus, against what it knows of the corpus; and the systems' mean lead over ``base`` against their mean knowledge.

    ``scores`` (system, corpus, score), ``knowledge`` (system, corpus, known). Series of fewer than three corpora have no row.
    """
    mean = scores.groupBy("corpus").agg(F.avg("score").alias("_mean"))
    known = scores.join(mean, "corpus").join(knowledge.where(F.col("known").isNotNull()), ["system", "corpus"]).where(F.col("system") != base)
    own = known.select(F.col("system").alias("series"), "corpus", F.col("known").alias("x"), F.explode(F.array(F.struct(F.lit("score").alias("measure"), F.col("score").alias("y")), F.struct(F.lit("adjusted").alias("measure"), F.round(F.col("score") - F.col("_mean"), 12).alias("y")))).alias("m"))
    own = own.select("series", "m.measure", "x", "m.y")
    others = known.groupBy("corpus").agg(F.round(F.avg("known"), 12).alias("x"), F.avg("score").alias("_s"))
    lead = others.join(scores.where(F.col("system") == base).select("corpus", F.col("score").alias("_b")), "corpus")
    lead = lead.select(F.lit("lead").alias("series"), F.lit("score").alias("measure"), "x", F.round(F.col("_s") - F.col("_b"), 12).alias("y"))
    return spearman_test(own.unionByName(lead), ["series", "measure"], "x", "y").where("n >= 3")


def kendall_w(scores: DataFrame, rater: str, item: str, value: str) -> DataFrame:
    """Concordance of raters over items, corrected for ties, with its chi-squared statistic (df = items - 1)."""
    r = scores.join(midranks(scores.select(rater, value), [rater], value), [rater, value])
    ties = r.select(rater, value, "_k").distinct().agg(F.sum(F.pow("_k", 3) - F.col("_k")).alias("t"))
    per_item = r.groupBy(item).agg(F.sum("midrank").alias("s"), F.count("*").alias("m"))
    w = per_item.agg(F.count("*").alias("n"), F.max("m").alias("m"), (F.var_pop("s") * F.count("*")).alias("ss")).crossJoin(ties)
    n, m = F.col("n"), F.col("m")
    value_w = 12 * F.col("ss") / (m * m * (F.pow(n, 3) - n) - m * F.col("t"))
    return w.select("n", "m", value_w.alias("w"), (m * (n - 1) * value_w).alias("chi2"))
