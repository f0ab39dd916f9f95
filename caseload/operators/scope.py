"""What belongs to a study: questions and strata in scope, decisions bound again to gold, manifests and drawn sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O
from caseload.session import stored


def subset(questions: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted questions, numbered in the order of the argument; names that aren't questions are passed over."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("question"))
    return questions.where(F.col("question").isin(wanted)).withColumn("ordinal", (place - 1).cast("int"))


def in_scope(docs: DataFrame, stratum: str, dropped: list[str]) -> DataFrame:
    """Documents outside the dropped strata; one without a stratum stays."""
    return docs.where(F.col(stratum).isNull() | ~F.col(stratum).isin(dropped))


def scored_questions(decisions: DataFrame, questions: DataFrame) -> DataFrame:
    """Decisions on the task's questions."""
    return decisions.join(questions.select("question"), "question", "left_semi")


def rebind(decisions: DataFrame, docs: DataFrame, questions: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, calls): decisions on known documents and asked questions with gold and gray as they are now, and all calls
    on known documents, which were paid for whether or not their question is still asked. No label means negative."""
    calls = decisions.drop("gold", "gray").join(docs.select("doc_id"), "doc_id", "left_semi")
    bound = scored_questions(calls, questions).join(labels.select("doc_id", "question", "gold", "gray"), ["doc_id", "question"], "left")
    return bound.withColumns({"gold": F.coalesce("gold", F.lit(0)), "gray": F.coalesce("gray", F.lit(False))}), calls


def aligned_judgments(before: DataFrame, after: DataFrame) -> DataFrame:
    """Judgments of two rounds by (topic, doc_id), with ``side``: both, or the one round that has the key."""
    b = before.select("topic", "doc_id", F.col("rel").alias("pre"), F.lit(True).alias("_b"))
    a = after.select("topic", "doc_id", F.col("rel").alias("post"), F.lit(True).alias("_a"))
    side = F.when(F.col("_b") & F.col("_a"), "both").when(F.col("_b"), "before").otherwise("after")
    return b.join(a, ["topic", "doc_id"], "full").withColumn("side", side).drop("_a", "_b")


def topic_summary(aligned: DataFrame, texts: DataFrame) -> DataFrame:
    """By topic: judged, positive, gray (a null judgment), appealed (rounds differ), without a text, in one round only."""
    t = texts.select("doc_id", (F.length(F.coalesce("text", F.lit(""))) > 0).alias("_t"))
    n = lambda c, name: F.count_if(c).alias(name)
    return aligned.join(t, "doc_id", "left").groupBy("topic").agg(
        F.count("*").alias("n"), n(F.col("post") == 1, "n_pos"), n(F.col("post").isNull(), "n_gray"), n(F.col("pre") != F.col("post"), "n_appealed"),
        n(~F.coalesce("_t", F.lit(False)), "n_no_text"), n(F.col("side") != "both", "n_mismatched"),
    )


def finalized(rows: DataFrame, key: str, prefix: str, salt: str = "manifest") -> DataFrame:
    """Rows numbered from 1 in hash order, with ``item``: the prefix and the number in at least five digits."""
    u = S.uniform(salt, F.col(key))
    out = O.placed(rows, [], [-F.floor(u * 1024), -F.floor(u * (1 << 20))], [F.asc(u), F.asc(key)], {}, "number")
    return out.withColumn("item", F.concat(F.lit(f"{prefix}-"), F.when(F.length(F.col("number").cast("string")) >= 5, F.col("number").cast("string")).otherwise(F.lpad(F.col("number").cast("string"), 5, "0"))))


def manifest_stats(rows: DataFrame, labels: DataFrame, kinds: list[str]) -> DataFrame:
    """(field, value, n): documents by positive question, by each kind, and by how many questions they are positive on."""
    pos = labels.where("gold = 1")
    per = rows.select("doc_id").join(pos.groupBy("doc_id").agg(F.count("*").alias("k")), "doc_id", "left")
    parts = [pos.join(rows.select("doc_id"), "doc_id", "left_semi").groupBy(F.col("question").alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit("question"))]
    parts += [rows.groupBy(F.col(k).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit(k)) for k in kinds]
    parts.append(per.groupBy(F.coalesce("k", F.lit(0)).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("field", F.lit("labels")))
    return reduce(DataFrame.unionByName, parts).select("field", "value", "n")


def training_items(labels: DataFrame, clean: float = 0.97, gray: float = 0.7) -> DataFrame:
    """Targets (no, yes) of each labelled unit: sure where gold is clean, softer where it is debatable."""
    sure = F.when(F.col("gray"), gray).otherwise(clean)
    yes = F.when(F.col("gold") == 1, sure).otherwise(1 - sure)
    return labels.select("doc_id", "question", F.col("gold").alias("label"), (1 - yes).alias("target_no"), yes.alias("target_yes"))


def least_positives(labels: DataFrame, docs: DataFrame, questions: list[str], n: int, least: int, salt: str = "pilot") -> DataFrame:
    """A sample in hash order: up to ``least`` positives of each question in turn, not counting documents that are in already,
    then others until ``n``. ``claim`` is the question that took the document, or fill."""
    order = [S.uniform(salt, F.col("doc_id")), F.col("doc_id")]
    taken = None
    for q in sorted(questions):
        pool = labels.where((F.col("question") == q) & (F.col("gold") == 1)).select("doc_id")
        pool = pool if taken is None else pool.join(taken, "doc_id", "left_anti")
        got = pool.orderBy(*order).limit(least).withColumn("claim", F.lit(q))
        taken = stored(got if taken is None else taken.unionByName(got))  # else each question would double the plan
    rest = docs.select("doc_id").join(taken, "doc_id", "left_anti").orderBy(*order).limit(n).withColumn("_u", order[0])
    have = taken.agg(F.count("*").alias("_have"))
    from pyspark.sql import Window

    fill = rest.withColumn("_r", F.row_number().over(Window.orderBy("_u", "doc_id"))).crossJoin(have).where(F.col("_r") + F.col("_have") <= n)  # at most n rows
    return taken.unionByName(fill.select("doc_id", F.lit("fill").alias("claim")))


def first_claim(pools: list[tuple[str, DataFrame, int]], usable: DataFrame, salt: str = "eval") -> DataFrame:
    """Strata in order, each with up to its number of usable documents in hash order that no stratum before it claimed."""
    taken = None
    for name, pool, k in pools:
        p = pool.select("doc_id").distinct().join(usable.select("doc_id"), "doc_id", "left_semi")
        p = p if taken is None else p.join(taken, "doc_id", "left_anti")
        got = p.orderBy(S.uniform(salt, F.lit(name), F.col("doc_id")), "doc_id").limit(k).withColumn("stratum", F.lit(name))
        taken = stored(got if taken is None else taken.unionByName(got))  # else each stratum would double the plan
    return taken


def scarce_first(labels: DataFrame, docs: DataFrame, topics: list[str], per_topic: int, n: int, salt: str = "scarce") -> DataFrame:
    """(doc_id, claim): positives for topics in rising order of supply (ties: by name), so that a scarce topic's documents
    aren't used up by others, then negatives.

    Documents chosen before count for every topic that they are positive on, up to ``per_topic``. What is missing from
    ``n`` is filled with documents that are positive on no topic: half from the stratum ``hard``, the rest from ``random``.
    ``docs`` are the usable ones (doc_id, stratum). State is a stored table, so a step's plan doesn't grow.
    """
    u = lambda *k: S.uniform(salt, *k, F.col("doc_id"))
    positive = labels.where(F.col("question").isin(topics) & (F.col("gold") == 1)).select("doc_id", "question").distinct()
    positive = stored(positive.join(docs.select("doc_id"), "doc_id", "left_semi"))
    supply = {r["question"]: r["n"] for r in positive.groupBy("question").agg(F.count("*").alias("n")).collect()}  # a row a topic
    chosen = stored(docs.limit(0).select("doc_id", F.lit("").alias("claim")))
    for q in sorted(topics, key=lambda t: (supply.get(t, 0), t)):
        own = positive.where(F.col("question") == q)
        have = own.join(chosen, "doc_id", "left_semi").count()
        if per_topic > have:
            got = O.lowest(own.join(chosen, "doc_id", "left_anti"), u(F.lit(q)), "doc_id", per_topic - have)
            chosen = stored(chosen.unionByName(got.select("doc_id", F.lit(q).alias("claim"))))
    need = max(0, n - chosen.count())
    free = docs.join(positive, "doc_id", "left_anti")
    for stratum, want in (("hard", need // 2), ("random", need - need // 2)):
        got = O.lowest(free.where(F.col("stratum") == stratum), u(F.lit(stratum)), "doc_id", want)
        chosen = chosen.unionByName(got.select("doc_id", F.lit(stratum).alias("claim")))
    return chosen


def with_turns(labels: DataFrame, docs: DataFrame, group: str, n: int, salt: str = "turns") -> DataFrame:
    """(doc_id, positive): every document that is positive on any question, and negatives taken in turns from the groups until
    there are ``n``: one of each group, in hash order of groups, then a second of each, and so on.

    So a group gives as many as there are whole turns, or all it has; the last turn, if it isn't whole, stops at some group.
    Whole turns are found from the counts of groups by their size.
    """
    positive = labels.where("gold = 1").select("doc_id").distinct()
    taken = stored(docs.join(positive, "doc_id", "left_semi").select("doc_id"))
    free = stored(docs.join(positive, "doc_id", "left_anti").select("doc_id", F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g")))
    need = max(0, n - taken.count())
    sizes = stored(free.groupBy("_g").agg(F.count("*").alias("_k")))
    by_size = sizes.groupBy("_k").agg(F.count("*").alias("_m"))
    upto = O.running(by_size, [], ["_k"], {"_rows": F.col("_k") * F.col("_m"), "_groups": F.col("_m")})
    n_groups = sizes.count()
    used = F.col("_rows") + F.col("_k") * (n_groups - F.col("_groups"))  # rows given after ``_k`` whole turns
    last = upto.where(used <= need).agg(F.max(F.struct("_k", used.alias("used"), (n_groups - F.col("_groups")).alias("left"))).alias("b")).first()["b"]
    k, spent, left = (last["_k"], last["used"], last["left"]) if last else (0, 0, n_groups)
    turns, extra = (k + (need - spent) // left, (need - spent) % left) if left else (k, 0)
    more = O.lowest(sizes.where(F.col("_k") > turns), S.uniform(salt, "group", F.col("_g")), "_g", extra).select("_g", F.lit(1).alias("_one"))
    wants = sizes.join(more, "_g", "left").select("_g", (F.least(F.col("_k"), F.lit(turns)) + F.coalesce("_one", F.lit(0))).alias("want"))
    got = O.lowest_by_group(free, "_g", S.uniform(salt, F.col("doc_id")), "doc_id", wants)
    return taken.select("doc_id", F.lit(1).alias("positive")).unionByName(got.select("doc_id", F.lit(0).alias("positive")))


def remaining(docs: DataFrame, used: DataFrame, longest: int) -> DataFrame:
    """Documents that aren't used yet and aren't longer than ``longest`` characters."""
    return docs.where(F.col("n_chars") <= longest).join(used.select("doc_id"), "doc_id", "left_anti")


def keyword_strata(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Documents with a text, by the pattern they match: first, second, or other."""
    t = F.lower("text")
    return docs.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).withColumn("stratum", F.when(t.rlike(first), "first").when(t.rlike(second), "second").otherwise("other"))


def keyword_sample(docs: DataFrame, first: str, second: str, forced: DataFrame, n: int, shares: tuple[float, float] = (0.65, 0.15), salt: str = "keywords") -> DataFrame:
    """(doc_id, stratum, forced): of about ``n`` documents with a text, these shares match the first pattern or, else, the second;
    the rest match neither. Forced documents come whatever their stratum's share, and count towards it; others come in hash
    order. A stratum that is too small gives all it has."""
    rows = keyword_strata(docs, first, second).select("doc_id", "stratum")
    must = rows.join(forced.select("doc_id").distinct(), "doc_id", "left_semi")
    quota = {"first": round(n * shares[0]), "second": round(n * shares[1])}
    quota["other"] = n - sum(quota.values())
    want = reduce(lambda c, kv: F.when(F.col("stratum") == kv[0], kv[1]).otherwise(c), quota.items(), F.lit(0))
    have = must.groupBy("stratum").agg(F.count("*").alias("_have"))
    wants = rows.select("stratum").distinct().join(have, "stratum", "left").select("stratum", F.greatest(want - F.coalesce("_have", F.lit(0)), F.lit(0)).alias("want"))
    drawn = O.lowest_by_group(rows.join(must, "doc_id", "left_anti"), "stratum", S.uniform(salt, F.col("doc_id")), "doc_id", wants)
    return must.withColumn("forced", F.lit(1)).unionByName(drawn.withColumn("forced", F.lit(0)))


def examples(labels: DataFrame, docs: DataFrame, longest: int) -> DataFrame:
    """For each question its longest short positive and negative whose gold isn't debatable (ties: smaller id)."""
    at = labels.where("not gray").join(docs.where(F.col("n_chars") <= longest).select("doc_id", "n_chars"), "doc_id")
    return at.groupBy("question", "gold").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("m"))).alias("b")).select("question", "gold", (-F.col("b.m")).alias("doc_id"), F.col("b.n_chars").alias("n_chars"))


def preferred(decisions: DataFrame, arms: list[str]) -> DataFrame:
    """One decision for each model, document and question: that of the first arm in ``arms`` that has it."""
    place = F.array_position(F.array(*map(F.lit, arms)), F.col("arm"))
    keys = ["model", "doc_id", "question"]
    return decisions.where(place > 0).groupBy(*keys).agg(F.min_by(F.struct("arm", "label", "p"), place).alias("_b")).select(*keys, "_b.arm", "_b.label", "_b.p")


def against_coding(decisions: DataFrame, coded: DataFrame, by: list[str]) -> DataFrame:
    """Document-level agreement with a coding of documents (doc_id, code): a document is flagged if any question is."""
    at = decisions.where("label is not null").groupBy(*by, "doc_id").agg(F.max("label").alias("flag")).join(coded, "doc_id")
    cell = lambda f, c: F.count_if((F.col("flag") == f) & (F.col("code") == c))
    s = at.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return s.select("*", S.rate_null(tp, tp + fp).alias("precision"), S.rate_null(tp, tp + fn).alias("recall"), S.rate_null(tp + fp, tp + fp + fn + tn).alias("flag_rate"))


def compared(a: DataFrame, b: DataFrame, labels: DataFrame, within: Column | None = None) -> DataFrame:
    """Two runs (doc_id, question, label, p) on the keys that both and the gold have: by question, pairs, keys without gold,
    changed labels, and how near the threshold the changed ones were."""
    x = a.select("doc_id", "question", F.col("label").alias("x"), F.col("p").alias("px"))
    y = b.select("doc_id", "question", F.col("label").alias("y"), F.col("p").alias("py"))
    both = x.join(y, ["doc_id", "question"]).join(labels.select("doc_id", "question", "gold"), ["doc_id", "question"], "left")
    both = both if within is None else both.where(within)
    known, changed = F.col("gold").isNotNull(), F.col("x") != F.col("y")
    moved = known & changed
    n = F.count_if(moved)
    return both.groupBy("question").agg(
        F.count_if(known).alias("n_pairs"), F.count_if(~known).alias("n_unscored"), n.alias("n_changed"),
        S.rate_null(n, F.count_if(known)).alias("changed_share"), S.rate_null(F.count_if(moved & (F.abs(F.col("px") - 0.5) < 0.1)), n).alias("near_share"),
        F.avg(F.when(moved, F.abs(F.col("py") - F.col("px")))).alias("mean_shift_changed"),
    )
