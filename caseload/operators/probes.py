"""Summaries of probes on paired decisions: does a scorer follow the text or what it knows, and what moves its score.

Pairs are those of ``paired.pair``: (doc_id, question, gold, x, y, px, py), before and after a change of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def label_following(edited: DataFrame) -> DataFrame:
    """Texts edited so that the label turns: how often the old label is kept (followed) or the edit is read, over all and by the
    old label; also given that the original was right. ``x``: call on the original, ``y``: on the edit."""
    old, edit = F.col("y") == F.col("gold"), F.col("y") != F.col("gold")
    return edited.groupingSets([["gold"], []], "gold").agg(
        F.count("*").alias("n"), share(F.col("x") == F.col("gold")).alias("acc_original"), share(old).alias("followed"), share(edit).alias("read_edit"),
        F.avg(F.when(F.col("x") == F.col("gold"), old.cast("double"))).alias("followed_given_right"), F.avg(F.abs(F.col("py") - F.col("px"))).alias("mean_shift"),
    )


def score_shift(pairs: DataFrame) -> DataFrame:
    """By question: mean and median shift, the shift at index floor(0.9 n) from 0, flips by decision and by document."""
    d = pairs.select("question", "doc_id", F.abs(F.col("py") - F.col("px")).alias("shift"), ((F.col("px") >= 0.5) != (F.col("py") >= 0.5)).alias("flip"))
    at = d.groupBy("question", "shift").agg(F.count("*").alias("k"))
    upto = O.placed(at, ["question"], [F.floor(F.col("shift") * 512), F.col("shift")], [F.asc("shift")], {"above": F.col("k")})
    n = d.groupBy("question").agg(F.count("*").alias("n"), F.avg("shift").alias("mean_shift"), share(F.col("flip")).alias("flip_rate"))
    # counted from the top, the place floor(0.9 n) from below is n - floor(0.9 n)
    place = F.col("n") - F.floor(F.col("n") * 0.9)
    p90 = upto.join(n.select("question", "n"), "question").where((F.col("above") >= place) & (F.col("above") - F.col("k") < place)).select("question", F.col("shift").alias("p90_shift"))
    docs = d.groupBy("question", "doc_id").agg(F.bool_or("flip").alias("f")).groupBy("question").agg(F.count("*").alias("n_docs"), share(F.col("f")).alias("doc_flip_rate"))
    middle = O.quantiles(d, ["question"], "shift", {"median_shift": 0.5})
    return n.join(middle, "question").join(p90, "question").join(docs, "question")


def shift_by_similarity(pairs: DataFrame, similarity: Column) -> DataFrame:
    """Shifts and flips by bands of how similar the changed text is to the original."""
    band = F.when(similarity < 0.6, "<0.60").when(similarity < 0.75, "0.60-0.75").otherwise(">=0.75")
    flip = (F.col("px") >= 0.5) != (F.col("py") >= 0.5)
    return pairs.groupBy(band.alias("band")).agg(F.count_distinct("doc_id").alias("n_docs"), F.avg(F.abs(F.col("py") - F.col("px"))).alias("mean_shift"), share(flip).alias("flip_rate"))


def text_following(pairs: DataFrame, token: str) -> DataFrame:
    """Factual texts (label gold) and counterfactual ones (label turned): how often the call follows the text, over all, by
    direction and by token, and the mean distance of the counterfactual's score from what its text says."""
    turned = 1 - F.col("gold")
    return pairs.groupingSets([["gold"], [token], []], "gold", token).agg(
        F.count("*").alias("n"), share(F.col("x") == F.col("gold")).alias("follow_factual"), share(F.col("y") == turned).alias("follow_counterfactual"),
        share((F.col("x") == F.col("gold")) & (F.col("y") == turned)).alias("follow_both"), (1 - share(F.col("y") == turned)).alias("knowledge_following"), F.avg(F.abs(F.col("py") - turned)).alias("mean_distance"),
    )


def named_share(answers: DataFrame, name: str, unsure: str, dose: str) -> DataFrame:
    """Free answers that give the hidden name, by dose (0, 1-2, 3 and more) and over all, and those that say they can't tell in
    their first 80 characters."""
    a = F.lower("answer")
    band = F.when(F.col(dose) == 0, "0").when(F.col(dose) <= 2, "1-2").otherwise("3+")
    return answers.withColumn("band", band).rollup("band").agg(F.count("*").alias("n"), F.count_if(F.contains(a, F.lit(name))).alias("n_named"), F.count_if(F.contains(F.substring(a, 1, 80), F.lit(unsure))).alias("n_unsure"))


def top_guesses(answers: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent guesses: an answer's first line, 60 characters at most, up to a full stop or a bracket."""
    line = F.substring(F.get(F.split(F.trim("answer"), "\n"), F.lit(0)), 1, 60)
    guess = F.trim(F.substring_index(F.substring_index(line, ".", 1), " (", 1))
    return answers.groupBy(guess.alias("guess")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "guess").limit(k)


def metadata_stats(rows: DataFrame, by: str) -> DataFrame:
    """Accuracy with all metadata, with the subject alone and by words (columns whole, part, lexical), over all and by ``by``, and
    where the added metadata mended or broke the call."""
    whole, part = F.col("whole") == F.col("gold"), F.col("part") == F.col("gold")
    low, high = S.wilson(F.count_if(whole), F.count("*"))
    return rows.rollup(by).agg(
        F.count("*").alias("n"), share(whole).alias("acc_whole"), share(part).alias("acc_part"), share(F.col("lexical") == F.col("gold")).alias("acc_lexical"),
        (share(whole) - share(part)).alias("delta"), low.alias("whole_low"), high.alias("whole_high"), share(F.col("whole") == 1).alias("yes_whole"),
        F.count_if(whole & ~part).alias("fixed"), F.count_if(part & ~whole).alias("broken"),
    )


def subset_block(pairs: DataFrame, inside: Column) -> DataFrame:
    """Both conditions inside and outside a subset: rates, their differences, the interval of accuracy before, and turned calls."""
    def rates(v: str) -> dict[str, Column]:
        c = lambda a, g: F.count_if((F.col(v) == a) & (F.col("gold") == g))
        return {"precision": S.rate_null(c(1, 1), c(1, 1) + c(1, 0)), "recall": S.rate_null(c(1, 1), c(1, 1) + c(0, 1)), "f1": S.f1_counts(c(1, 1), c(1, 0), c(0, 1)), "accuracy": share(F.col(v) == F.col("gold"))}

    x, y = rates("x"), rates("y")
    low, high = S.wilson(F.count_if(F.col("x") == F.col("gold")), F.count("*"))
    return pairs.groupBy(inside.alias("inside")).agg(
        F.count("*").alias("n"), F.count_if(F.col("gold") == 1).alias("pos"), *[c.alias(f"named_{k}") for k, c in x.items()], *[(y[k] - x[k]).alias(f"d_{k}") for k in x],
        low.alias("accuracy_low"), high.alias("accuracy_high"), F.count_if((F.col("x") == F.col("gold")) & (F.col("y") != F.col("gold"))).alias("right_to_wrong"), F.count_if((F.col("x") != F.col("gold")) & (F.col("y") == F.col("gold"))).alias("wrong_to_right"),
    )


def projected_spend(decisions: DataFrame, brief_tokens: int, price_in: Column) -> DataFrame:
    """What a brief of so many more tokens in each call would cost: calls (documents), paid so far, scale of input, projected."""
    calls = F.count_distinct("doc_id")
    s = decisions.groupBy("model").agg(calls.alias("calls"), F.sum("input_tokens").alias("t"), F.sum("cost").alias("paid"), F.first(price_in).alias("price"))
    extra = F.col("calls") * brief_tokens
    return s.select("model", "calls", "paid", (1 + extra / F.greatest(F.lit(1), F.col("t"))).alias("scale"), (F.col("paid") + extra * F.col("price") / 1e6).alias("projected"))


def corpus_stats(docs: DataFrame, stratum: str) -> DataFrame:
    """(field, value, n): documents by stratum, distinct languages, and the length at index floor(n / 2) of the sorted lengths."""
    by = docs.groupBy(F.col(stratum).alias("value")).agg(F.count("*").alias("n")).select(F.lit(stratum).alias("field"), "value", "n")
    langs = docs.agg(F.count_distinct("lang").alias("n")).select(F.lit("languages").alias("field"), F.lit(None).cast("string").alias("value"), "n")
    at = docs.where("n_chars is not null").groupBy("n_chars").agg(F.count("*").alias("k"))
    above = O.placed(at, [], [F.floor(F.col("n_chars") / 64)], [F.desc("n_chars")], {"above": F.col("k")}).crossJoin(at.agg(F.sum("k").alias("all")))
    place = F.col("all") - F.floor(F.col("all") / 2)
    middle = above.where((F.col("above") >= place) & (F.col("above") - F.col("k") < place)).select(F.lit("median_chars").alias("field"), F.lit(None).cast("string").alias("value"), F.col("n_chars").alias("n"))
    return by.unionByName(langs).unionByName(middle)
