"""Quality rules: text statistics, and robust outliers by minimum-covariance-determinant estimates.

Only DataFrame functions run here. Each language and source has estimates of its own, whatever its size: centre and
covariance of the share of its documents that has the smallest determinant. They are regularised as in the literature on
small samples: the language's own estimate stands in as a number of further documents, so the fewer documents a group
has, the more it leans on its language; a language leans in the same way on the spread of the whole table. The search
has several starts for each group, and each runs until its determinant no longer falls; the smallest determinant wins.

Defined results for odd input: null text is the empty text (no words, so ``base_failed``); null language or source is a
group of its own; repeated rows and ids are judged row by row; a document whose group has no document that passes the
base rules is failed by them itself; other columns pass through untouched, whatever their names, but for those named as
a result; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import stored

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Each feature with the smallest standard deviation it is given, so that a constant feature has a proper scale.
FEATURES = {"f_words": 0.5, "f_word_len": 0.08, "f_symbols": 0.035, "f_dup_lines": 0.12, "f_repeats": 0.12, "f_capitals": 0.08}
P = len(FEATURES)
#: Bins of statistics for medians, and of squared distances for concentration steps.
FEATURE_BINS, DISTANCE_BINS = 512, 256


def chi2_cdf(x: float, df: int) -> float:
    """P(chi-squared <= x), for even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, df) < q else (low, mid)
    return high


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def removed(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def windows(w: Column) -> Column:
    """A hash of each three-word window of a word array."""
    return F.transform(
        F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )


def repeated_words(h: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the same text, from its windows' hashes.

    Windows are sorted by hash; equal neighbours give the places of repeated windows, and the places in order give how
    many words they cover. A text whose windows are all different, as most are, needs no sort.
    """
    nothing = F.lit(None).cast("struct<h:bigint,at:int>")
    equal = let(
        F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))),
        lambda s: F.filter(
            F.zip_with(s, F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.array(nothing)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"]))),
            lambda x: x.isNotNull(),
        ),
    )
    covered = let(
        F.sort_array(F.array_distinct(F.flatten(equal))),
        lambda d: F.aggregate(
            F.zip_with(d, F.slice(d, 2, F.greatest(F.size(d), F.lit(1))), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3))),
            F.lit(0).cast("long"),
            lambda total, x: total + x,
        ),
    )
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered)


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns as one struct ``own``, lang, source, and n_words, word_chars, n_symbols, n_capitals, n_lines,
    n_dup_lines and n_repeat_words of the text."""
    own = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("struct<>")
    t = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " " + SPACES, "")) > 0)
    first = docs.select(own.alias("own"), "lang", "source", t.alias("t"), words(t).alias("w"), lines.alias("lines"))
    second = first.select("own", "lang", "source", "t", F.size("w").cast("long").alias("n_words"), "lines", windows(F.col("w")).alias("h"))
    return second.select(
        "own",
        "lang",
        "source",
        "n_words",
        F.length(F.translate("t", " " + SPACES, "")).cast("long").alias("word_chars"),
        removed(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("h")).alias("n_repeat_words"),
        removed(F.col("t"), CAPITALS).alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """Transformed statistics: logarithms of sizes, and square roots of shares."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "f_words": F.log1p(F.col("n_words")),
        "f_word_len": F.log(chars / n),
        "f_symbols": F.sqrt(F.col("n_symbols") / chars),
        "f_dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "f_repeats": F.sqrt(F.col("n_repeat_words") / n),
        "f_capitals": F.sqrt(F.col("n_capitals") / chars),
    }


def group_key(*names: str) -> Column:
    """One text for the values of these columns, nulls told apart."""
    return F.to_json(F.struct(*names))


def cutoffs(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The smallest bin of each key up to which at least ``share`` of the rows lie. ``binned``: keys, bin, n."""
    total = Window.partitionBy(*keys)
    return (
        binned.withColumns({"upto": F.sum("n").over(total.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(total)})
        .where(F.col("upto") >= share * F.col("total"))
        .groupBy(*keys)
        .agg(F.min("bin").alias("cut"))
    )


def spread(clean: DataFrame) -> DataFrame:
    """(g, m, c): medians of each group, and squared normalised median deviations as a diagonal covariance. Counts by bin
    are shuffled, not rows."""
    long = clean.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.round(F.col(f) * FEATURE_BINS).cast("long").alias("bin")) for i, f in enumerate(FEATURES)])).alias("x"))
    binned = stored(long.groupBy("g", "x.k", "x.bin").agg(F.count("*").alias("n")))
    medians = cutoffs(binned, ["g", "k"], 0.5).withColumnRenamed("cut", "median")
    away = binned.join(medians, ["g", "k"]).groupBy("g", "k", F.abs(F.col("bin") - F.col("median")).alias("bin")).agg(F.sum("n").alias("n"))
    both = medians.join(cutoffs(away, ["g", "k"], 0.5).withColumnRenamed("cut", "mad"), ["g", "k"])
    of = lambda name, k: F.max(F.when(F.col("k") == k, F.col(name))) / FEATURE_BINS
    return both.groupBy("g").agg(
        F.array(*[of("median", i) for i in range(P)]).alias("m"),
        F.array(*[F.pow(1.4826 * of("mad", i), 2) if i == j else F.lit(0.0) for i in range(P) for j in range(P)]).alias("c"),
    )


CELLS = [(i, j) for i in range(P) for j in range(P)]


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, m, c): number, mean and covariance of each group's rows."""
    names = list(FEATURES)
    sums = [F.expr(f"avg({f}) AS m{i}") for i, f in enumerate(names)] + [F.expr(f"avg({names[i]} * {names[j]}) AS s{i}_{j}") for i, j in CELLS if j <= i]
    cells = ", ".join(f"s{max(i, j)}_{min(i, j)} - m{i} * m{j}" for i, j in CELLS)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums).select(*keys, "n", F.expr(f"array({', '.join(f'm{i}' for i in range(P))}) AS m"), F.expr(f"array({cells}) AS c"))


def inverted(models: DataFrame) -> DataFrame:
    """``models`` with ``v``, the inverse of ``c``, and ``logdet``, the logarithm of its determinant: Gauss-Jordan steps."""
    pivot, row, column = f"s.a[k * {P + 1}]", f"int(p DIV {P})", f"p % {P}"
    done = F.expr(f"""aggregate(sequence(0, {P - 1}), struct(c AS a, 0D AS logdet), (s, k) -> struct(
        transform(sequence(0, {P * P - 1}), p -> CASE
            WHEN {row} = k AND {column} = k THEN 1 / {pivot}
            WHEN {row} = k THEN s.a[p] / {pivot}
            WHEN {column} = k THEN -s.a[p] / {pivot}
            ELSE s.a[p] - s.a[{row} * {P} + k] * s.a[k * {P} + {column}] / {pivot} END) AS a,
        s.logdet + ln({pivot}) AS logdet))""")
    return models.withColumn("x", done).selectExpr("* EXCEPT (x)", "x.a AS v", "x.logdet AS logdet")


def regularised(found: DataFrame, scale: float, prior: float) -> DataFrame:
    """(keys, m, v, c, logdet) from moments and the target (tm, tc), which stands in as ``prior`` documents; each feature
    has a least variance besides. ``scale`` makes the covariance of the nearest rows one of all."""
    least = ", ".join(f"{f ** 2}D" if i == j else "0D" for i, f in enumerate(FEATURES.values()) for j in range(P))
    keys = [k for k in found.columns if k not in ("n", "m", "c", "tm", "tc")]
    mixed = found.selectExpr(*keys, "m", "c", "tm", "tc", f"{prior}D / (n + {prior}D) AS rho", "zip_with(m, tm, (x, y) -> x - y) AS off", f"array({least}) AS least")
    cell = f"c[p] * {scale}D * (1 - rho) + tc[p] * rho + off[int(p DIV {P})] * off[p % {P}] * rho * (1 - rho) + least[p]"
    return inverted(mixed.selectExpr(*keys, "zip_with(m, tm, (x, y) -> x * (1 - rho) + y * rho) AS m", f"transform(sequence(0, {P * P - 1}), p -> {cell}) AS c"))


def squared_distance() -> Column:
    """The squared Mahalanobis distance of a row's features from the model (m, v) beside them."""
    x = [f"({f} - m[{i}])" for i, f in enumerate(FEATURES)]
    return F.expr(" + ".join(f"{x[i]} * ({' + '.join([f'v[{i * P + i}] * {x[i]}', *(f'2 * v[{i * P + j}] * {x[j]}' for j in range(i))])})" for i in range(P)))


def mcd_models(clean: DataFrame, targets: DataFrame, support: float, prior: float, starts: int = 3, subset: int = 32, max_steps: int = 50, tolerance: float = 0.01) -> DataFrame:
    """(g, m, v, c, logdet): regularised minimum-covariance-determinant estimates, reweighted once.

    ``clean``: g and the features; ``targets``: (g, tm, tc). Starts are the group's medians and deviations, and the
    moments of about ``subset`` rows picked by hash for each further one. A concentration step keeps the ``support``
    share of a group's rows that lie nearest under the last estimate (to a bin of log distance: no group is gathered or
    sorted). The smallest determinant is kept; steps end when none falls by more than the share ``tolerance`` any more.
    """
    sizes = stored(clean.groupBy("g").agg(F.count("*").alias("rows")))  # its size is known, so rows needn't move to it
    scale = support / chi2_cdf(chi2_quantile(support, P), P + 2)
    first = spread(clean).join(targets, "g").withColumns({"s": F.lit(0), "n": F.lit(1e12)})
    picked = F.pmod(F.xxhash64("s", *FEATURES), F.lit(1 << 30)) * F.col("rows") < subset * float(1 << 30)
    drawn = clean.join(sizes, "g").withColumn("s", F.explode(F.lit(list(range(1, starts))))).where(picked)
    both = regularised(first, 1.0, prior).unionByName(regularised(moments(drawn, ["g", "s"]).join(targets, "g"), 1.0, prior))
    models = stored(both.select("g", "s", "m", "v", F.lit(float("inf")).alias("logdet")))
    for _ in range(max_steps):
        d = clean.join(models.select("g", "s", "m", "v"), "g").withColumn("bin", F.floor(DISTANCE_BINS * F.log(squared_distance() + 1e-6)).cast("long")).drop("m", "v")
        cut = cutoffs(d.groupBy("g", "s", "bin").agg(F.count("*").alias("n")), ["g", "s"], support)
        near = d.join(cut, ["g", "s"]).where(F.col("bin") <= F.col("cut"))
        new = regularised(moments(near, ["g", "s"]).join(targets, "g"), scale, prior).select("g", "s", F.struct("logdet", "m", "v").alias("new"))
        both = models.select("g", "s", F.struct("logdet", "m", "v").alias("old")).join(new, ["g", "s"])
        smaller = F.when(F.col("new.logdet") < F.col("old.logdet"), F.col("new")).otherwise(F.col("old"))
        models = stored(both.select("g", "s", smaller.alias("x"), "old.logdet").select("g", "s", "x.*", (F.col("logdet") - F.col("x.logdet")).alias("fall")))
        if not models.where(F.col("fall") > tolerance).limit(1).count():
            break
    best = models.groupBy("g").agg(F.min_by(F.struct("m", "v"), F.struct("logdet", "s")).alias("x")).select("g", "x.m", "x.v")
    within = 0.975 / chi2_cdf(chi2_quantile(0.975, P), P + 2)
    near = clean.join(best, "g").where(squared_distance() <= chi2_quantile(0.975, P)).drop("m", "v")
    return stored(regularised(moments(near, ["g"]).join(targets, "g"), within, prior))


def fitted(clean: DataFrame, support: float, prior: float) -> DataFrame:
    """(g, m, v): the model of each language and source. ``clean``: language, g and the features.

    A group's target is its language's estimate, and a language's the spread of the whole table.
    """
    names = list(FEATURES)
    by_language = clean.select(F.col("language").alias("g"), *names)
    whole = spread(clean.select(F.lit("").alias("g"), *names)).select(F.col("m").alias("tm"), F.col("c").alias("tc"))
    languages = mcd_models(by_language, stored(by_language.select("g").distinct().crossJoin(whole)), support, prior)  # one row of the whole table
    targets = clean.select("g", F.col("language")).distinct().join(languages.select(F.col("g").alias("language"), F.col("m").alias("tm"), F.col("c").alias("tc")), "language").drop("language")
    return mcd_models(clean.select("g", *names), stored(targets), support, prior).select("g", "m", "v")


#: Result columns.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def judged(docs: DataFrame, own: list[str], support: float, prior: float, reject_tail: float) -> DataFrame:
    """``own`` (a struct of those columns) and the result columns of each row of ``docs``."""
    stats = text_stats(docs, own).withColumn("base_failed", base_failed())
    rows = stored(stats.select("own", group_key("lang", "source").alias("g"), group_key("lang").alias("language"), *RESULTS[:6], *[f.alias(k) for k, f in features().items()]))
    clean = stored(rows.where(~F.col("base_failed")).select("g", "language", *FEATURES))
    model = fitted(clean, support, prior)
    d2 = F.when(F.col("m").isNotNull(), squared_distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(1 - reject_tail, P))
    return rows.join(model, "g", "left").withColumn("d2", d2).withColumn("kept", kept).select("own", *RESULTS)


def quality_rules(docs: DataFrame, support: float = 0.75, prior: float = 30.0, reject_tail: float = 1e-12, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, the robust distance ``d2``, and ``kept``.

    A document is rejected if the base rules fail it, or if its squared distance is beyond the ``1 - reject_tail``
    quantile of chi-squared. ``docs`` needs text, lang and source; its ``keep`` columns are returned (all by default).
    ``prior``: as how many documents a language's estimate counts in each of its groups.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    return judged(docs, own, support, prior, reject_tail).select(*[F.col("own")[c].alias(c) for c in own], *RESULTS)


def accepted(docs: DataFrame, support: float = 0.75, prior: float = 30.0, reject_tail: float = 1e-12) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their own columns and no others."""
    return judged(docs, docs.columns, support, prior, reject_tail).where("kept").select("own.*")
