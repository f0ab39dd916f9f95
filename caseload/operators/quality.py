"""Classification quality: confusion counts first, every rate from counts, in one pass over the decisions.

Decisions need ``gold`` (0, 1 or null), ``label`` and ``p`` (null on errors), ``gray`` and ``error``. Errors are counted,
never scored; null gold is no decision. Windows run over distinct scores, never over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O

CELLS = ("tp", "fp", "fn", "tn")


def both_gray_modes(decisions: DataFrame) -> DataFrame:
    """Each decision under ``gray_mode`` all, and again under excluded unless it is gray."""
    modes = F.when(F.col("gray"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("excluded")))
    return decisions.withColumn("gray_mode", F.explode(modes))


def count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def cells(label: Column, gold: Column) -> dict[str, Column]:
    return {
        "tp": count_where((label == 1) & (gold == 1)),
        "fp": count_where((label == 1) & (gold == 0)),
        "fn": count_where((label == 0) & (gold == 1)),
        "tn": count_where((label == 0) & (gold == 0)),
    }


def counts(decisions: DataFrame, keys: list[str], levels: list[list[str]]) -> DataFrame:
    """Counts and sums by each of ``levels`` (lists of ``keys``; one left out is null): grouping sets over one scan."""
    ok = (~F.col("error")) & F.col("gold").isNotNull()
    y, p = F.col("gold").cast("double"), F.col("p")
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    sums = [c.alias(k) for k, c in cells(F.when(ok, F.col("label")), F.col("gold")).items()]
    sums += [
        count_where(F.col("gold").isNotNull() & F.col("error")).alias("n_errors"),
        F.sum(F.when(ok, F.pow(p - y, 2))).alias("sum_sq"),
        F.sum(F.when(ok, -(y * F.log(bounded) + (1 - y) * F.log(1 - bounded)))).alias("sum_log"),
        count_where(ok & ((F.col("label") == 1) != (p >= 0.5))).alias("n_inconsistent"),
    ]
    return decisions.groupingSets([[F.col(k) for k in level] for level in levels], *keys).agg(*sums)


def rates(counted: DataFrame) -> DataFrame:
    """Rates of each row of cells; undefined ones follow the zero policy, statistics of one class are null."""
    tp, fp, fn, tn = map(F.col, CELLS)
    n, pos = tp + fp + fn + tn, tp + fn
    two = (pos > 0) & (pos < n)
    precision, recall = S.rate_zero(tp, tp + fp), S.rate_zero(tp, pos)
    lows, highs = zip(S.wilson(tp, tp + fp), S.wilson(tp, pos), strict=True)
    f1_low, f1_high = S.f1_interval(tp, fp, fn)
    return counted.withColumns(
        {
            "n": n,
            "n_pos": pos,
            "accuracy": S.rate_zero(tp + tn, n),
            "precision": precision,
            "recall": recall,
            "f1": S.f1_counts(tp, fp, fn),
            "specificity": S.rate_zero(tn, tn + fp),
            "elusion": S.rate_zero(fn, fn + tn),
            "kappa": F.when(two, S.kappa(tp, fp, fn, tn)),
            "brier": S.rate_null(F.col("sum_sq"), n),
            "log_loss": F.when(two, S.rate_null(F.col("sum_log"), n)),
            "inconsistent": S.rate_null(F.col("n_inconsistent"), n),
            "precision_low": lows[0],
            "recall_low": lows[1],
            "precision_high": highs[0],
            "recall_high": highs[1],
            "f1_low": f1_low,
            "f1_high": f1_high,
        }
    ).drop("sum_sq", "sum_log", "n_inconsistent")


def quality(decisions: DataFrame) -> DataFrame:
    """Quality by model, arm and question, and pooled over questions (question null), in both gray modes."""
    keys = ["model", "arm", "gray_mode", "question"]
    return rates(counts(both_gray_modes(decisions), keys, [keys, keys[:3]]))


def macro_f1(by_question: DataFrame) -> DataFrame:
    """Mean F1 over questions that have a positive."""
    return by_question.where("question is not null").groupBy("model", "arm", "gray_mode").agg(F.avg(F.when(F.col("n_pos") > 0, F.col("f1"))).alias("macro_f1"))


def calibration(decisions: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Expected calibration error over right-closed bins (the first holds 0 too). Edges are literals, as floats decide them."""
    ok = decisions.where("not error and gold is not null")
    bin_no = sum((F.when(F.col("p") > e, 1).otherwise(0) for e in S.thresholds(bins)), F.lit(1))
    by_bin = ok.groupBy(*keys, bin_no.alias("bin")).agg(F.count("*").alias("k"), F.sum("gold").alias("y"), F.sum("p").alias("s"))
    return by_bin.groupBy(*keys).agg((F.sum(F.abs(F.col("y") - F.col("s"))) / F.sum("k")).alias("ece"), F.count("*").alias("n_bins"))


def by_score(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score, with running counts from the highest score down."""
    ok = decisions.where("not error and gold is not null")
    at = ok.groupBy(*keys, "p").agg(F.sum("gold").cast("long").alias("pos"), F.sum(1 - F.col("gold")).cast("long").alias("neg"))
    down = Window.partitionBy(*keys).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return at.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "all_pos": F.sum("pos").over(whole), "all_neg": F.sum("neg").over(whole)})


def ranking(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """ROC area (ties count half), average precision (steps at distinct scores), and the best F1 with its lowest cut."""
    two = (F.first("all_pos") > 0) & (F.first("all_neg") > 0)
    s = by_score(decisions, keys).withColumn("f1", 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all_pos")))
    return s.groupBy(*keys).agg(
        F.when(two, S.rate_null(F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + 0.5 * F.col("neg"))), F.first("all_pos") * F.first("all_neg"))).alias("roc_auc"),
        F.when(two, F.sum(F.col("pos") / S.nonzero(F.col("all_pos")) * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"),
        F.when(two, F.max("f1")).alias("best_f1"),
        F.when(two, F.max(F.struct("f1", -F.col("p")))["f1"]).alias("_check"),
        F.when(two, -F.max(F.struct(F.col("f1").alias("f"), (-F.col("p")).alias("q")))["q"]).alias("best_cut"),
    ).drop("_check")


def recall_targets(decisions: DataFrame, keys: list[str], targets: tuple[float, ...] = (0.5, 0.75, 0.8, 0.9, 0.95)) -> DataFrame:
    """The first place, by falling score and then rising doc_id, at which each share of the positives is reached.

    The score at that place comes from counts by score; only rows of that one score are ranked, by ranges of their ids.
    """
    s = by_score(decisions, keys).where("all_pos > 0").withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    need = F.ceil(F.col("target") * F.col("all_pos") - 1e-9)
    crossing = s.withColumn("need", need).where((F.col("tp") >= F.col("need")) & (F.col("tp") - F.col("pos") < F.col("need")))
    at = crossing.select(*keys, "p", "target", (F.col("need") - F.col("tp") + F.col("pos")).alias("short"), (F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")).alias("before"), "need", (F.col("all_pos") + F.col("all_neg")).alias("n"), "all_pos")
    tied = decisions.where("not error and gold is not null").join(at.select(*keys, "p").distinct(), [*keys, "p"], "left_semi")
    ran = O.running(tied, [*keys, "p"], ["doc_id"], {"place": F.lit(1), "seen": F.col("gold")})
    placed = ran.where("gold = 1").select(*keys, "p", "place", "seen")
    hit = at.join(placed, [*keys, "p"]).where("seen = short")
    rank = F.col("before") + F.col("place")
    return hit.select(*keys, "target", F.col("p").alias("threshold"), (F.col("need") / rank).alias("precision"), (F.col("need") / F.col("all_pos")).alias("recall"), (rank / F.col("n")).alias("review_fraction"))


def sweep(decisions: DataFrame, keys: list[str], steps: int = 20) -> DataFrame:
    """Confusion and rates at each cut of a grid: a histogram by cut, then running sums from the top."""
    ok = decisions.where("not error and gold is not null")
    passed = sum((F.when(F.col("p") >= t, 1).otherwise(0) for t in S.thresholds(steps)), F.lit(0))
    held = ok.groupBy(*keys, passed.alias("k")).agg(F.sum("gold").cast("long").alias("pos"), F.count("*").alias("n"))
    totals = held.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    grid = totals.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    at = grid.join(held.withColumnRenamed("k", "cut"), [*keys, "cut"], "left")
    up = Window.partitionBy(*keys).orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    tp, all_flagged = F.coalesce(F.sum("pos").over(up), F.lit(0)), F.coalesce(F.sum("n").over(up), F.lit(0))
    return at.select(
        *keys,
        (F.col("cut") / steps).alias("threshold"),
        tp.alias("tp"),
        (all_flagged - tp).alias("fp"),
        S.rate_null(tp, all_flagged).alias("precision"),
        S.rate_null(tp, F.col("all_pos")).alias("recall"),
        S.f1_counts(tp, all_flagged - tp, F.col("all_pos") - tp).alias("f1"),
        S.rate_null(all_flagged, F.col("all_n")).alias("share"),
    )


def cut_for_recall(swept: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The highest cut that still meets the recall target."""
    return swept.where(F.col("recall") >= target - 1e-9).groupBy(*keys).agg(F.max("threshold").alias("threshold"))


def by_document(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """One decision a document: positive if any question is, on both sides; gray if any question is."""
    ok = decisions.where("gold is not null")
    return ok.groupBy(*keys, "doc_id").agg(F.max("label").alias("label"), F.max("gold").alias("gold"), F.max("p").alias("p"), F.bool_or("gray").alias("gray"), F.max("label").isNull().alias("error"))


def agreement(decisions: DataFrame) -> DataFrame:
    """Cohen's kappa of every two models of an arm over the decisions both have; fewer than two give null, equal labels 1.

    Each decision's labels are gathered once (as many as there are models), and pairs of them are counted.
    """
    ok = decisions.where("not error and gold is not null")
    at = ok.groupBy("arm", "doc_id", "question").agg(F.array_sort(F.collect_list(F.struct("model", "label"))).alias("m"))
    pairs = at.select("arm", F.explode(F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("a"), b["model"].alias("b"), a["label"].alias("x"), b["label"].alias("y")))))).alias("q")).select("arm", "q.*")
    c = pairs.groupBy("arm", "a", "b").agg(*[v.alias(k) for k, v in cells(F.col("x"), F.col("y")).items()])
    tp, fp, fn, tn = map(F.col, CELLS)
    n = tp + fp + fn + tn
    value = F.when(n < 2, None).when(fp + fn == 0, 1.0).otherwise(S.kappa(tp, fp, fn, tn))
    return c.select("arm", F.col("a").alias("model_a"), F.col("b").alias("model_b"), n.alias("n"), value.alias("kappa"))
