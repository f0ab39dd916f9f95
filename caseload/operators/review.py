"""Technology-assisted review: features, balanced logistic regression, cut-offs, and continuous active learning.

The loop's state is a table of coded documents. Each round fits on it, ranks the rest, takes the top of it by a bounded
top-k, and writes the new state to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import itertools

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O
from caseload.operators.ensemble import recoded
from caseload.session import stored


def features(docs: DataFrame, buckets: int = 1 << 18, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, features), and the columns to ``keep``: hashed one- and two-word counts, weighted by inverse document
    frequency, of length one."""
    kept = ["doc_id", *keep]
    steps = [
        RegexTokenizer(inputCol="text", outputCol="one", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2),
        NGram(n=2, inputCol="one", outputCol="two"),
        SQLTransformer(statement=f"SELECT {', '.join(kept)}, concat(one, two) AS both FROM __THIS__"),
        HashingTF(inputCol="both", outputCol="counts", numFeatures=buckets),
    ]
    clean = docs.select(*kept, F.coalesce("text", F.lit("")).alias("text"))
    counted = stored(Pipeline(stages=steps).fit(clean).transform(clean).select(*kept, "counts"))  # texts are cut once
    weigh = [IDF(inputCol="counts", outputCol="weighted", minDocFreq=2), Normalizer(inputCol="weighted", outputCol="features")]
    return Pipeline(stages=weigh).fit(counted).transform(counted).select(*kept, "features")


def fit(training: DataFrame, label: str = "label"):
    """Logistic regression with classes of equal weight; None if there is one class only."""
    n = training.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first()
    if not n["pos"] or n["pos"] == n["n"]:
        return None
    weight = F.when(F.col(label) == 1, n["n"] / (2 * n["pos"])).otherwise(n["n"] / (2 * (n["n"] - n["pos"])))
    rows = training.withColumns({"weight": weight, "label": F.col(label).cast("double")})
    return LogisticRegression(weightCol="weight", regParam=1.0 / n["n"], standardization=False, maxIter=50).fit(rows)


def scored(model, rows: DataFrame) -> DataFrame:
    """Adds ``score``, the decision value; 0 without a model."""
    if model is None:
        return rows.withColumn("score", F.lit(0.0))
    out = model.transform(rows)
    return out.withColumn("score", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


def cross_scores(rows: DataFrame, folds: int = 3, label: str = "label") -> DataFrame:
    """Scores of each row by a model that didn't see it: folds by hash, a fit for each."""
    dealt = rows.withColumn("fold", F.floor(S.uniform("fold", F.col("doc_id")) * folds).cast("int"))
    parts = [scored(fit(dealt.where(F.col("fold") != k), label), dealt.where(F.col("fold") == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recall_cut(rows: DataFrame, recall: float = 0.8, label: str = "label") -> float | None:
    """The score of the positive at which the recall is reached: the k-th highest, k = ceil(recall * positives)."""
    positives = rows.where(F.col(label) == 1)
    n = positives.count()
    if not n:
        return None
    k = -int(-recall * n // 1)
    at = positives.groupBy("score").agg(F.count("*").alias("rank_size"))
    tiers = [F.floor(F.least(F.greatest(F.col("score"), F.lit(-1.0)), F.lit(2.0)) * 256)]
    upto = O.placed(at, [], tiers, [F.desc("score")], {"upto": F.col("rank_size")})
    return upto.where(F.col("upto") >= k).agg(F.max("score")).first()[0]


def knee_stop(curve: list[tuple[int, int]], n: int, ratio: float = 6.0, least: float = 0.1) -> bool:
    """Whether the gain curve (reviewed, found) has bent: the slope up to its knee, the point farthest from the chord, is
    ``ratio`` times the slope after it, once ``least`` of all was reviewed."""
    if len(curve) < 3 or curve[-1][0] < least * n:
        return False
    x1, y1 = curve[-1]
    if not y1:
        return False
    away = [y - y1 * x / x1 for x, y in curve[:-1]]
    i = max(range(len(away)), key=away.__getitem__)
    x, y = curve[i]
    if away[i] <= 0 or not x:
        return False
    return (y / x) / max((1 + y1 - y) / (x1 - x), 1e-12) >= ratio


def cal(feats: DataFrame, gold: DataFrame | None = None, batch: int | None = None, rounds: int | None = None, control: int = 100, miss: float = 0.0, over: float = 0.0, seed: str = "cal") -> DataFrame:
    """Continuous active learning: (round, reviewed, found, est_recall) after each batch, until the gain curve bends or all is
    reviewed (or for ``rounds``). A batch is a twentieth of the pool, 60 at least, unless given.

    ``feats`` has the column ``gold`` if that is None. A batch is stored with its features and each round's scores are stored
    without, so that a round reads the pool's features twice and sends none of them between tasks.

    A control set, drawn by hash, estimates recall: its positives that the ranking has reached. The reviewer's coding is
    one draw a document.
    """
    pool = feats if gold is None else feats.join(gold.select("doc_id", "gold"), "doc_id")
    pool = pool.withColumn("coded", recoded(F.col("gold"), miss, over, seed, F.col("doc_id")))
    pool = stored(pool.withColumn("_u", S.uniform(seed, "order", F.col("doc_id"))))
    tasks = feats.sparkSession.sparkContext.defaultParallelism
    taken = lambda ids: stored(pool.select("doc_id", "coded", "features").join(ids.select("doc_id"), "doc_id", "left_semi"))
    held = stored(pool.orderBy("_u", "doc_id").limit(control).select("doc_id", "coded", "gold"))
    n = pool.count()
    batch = batch or max(60, n // 20)
    seen = taken(stored(pool.select("doc_id", "_u").join(held, "doc_id", "left_anti").orderBy("_u", "doc_id").limit(batch)))
    curve, rows = [], []
    for number in itertools.count(1) if rounds is None else range(1, rounds + 1):
        got = seen.agg(F.count("*").alias("n"), F.sum("coded").alias("pos")).first()
        model = fit(seen.select("features", F.col("coded").alias("label")).coalesce(tasks))
        ranked = stored(scored(model, pool).select("doc_id", "coded", "score", "_u"))
        fresh = ranked.join(held, "doc_id", "left_anti").join(seen.select("doc_id"), "doc_id", "left_anti")
        top = stored(fresh.orderBy(F.desc("score"), "_u", "doc_id").limit(batch))
        lowest = top.agg(F.min("score")).first()[0]
        reach = ranked.join(held.select("doc_id"), "doc_id", "left_semi").where("coded = 1").agg(F.avg((F.col("score") >= F.lit(lowest)).cast("double"))).first()[0] if lowest is not None else 1.0
        curve.append((got["n"], int(got["pos"] or 0)))
        rows.append((number, got["n"], int(got["pos"] or 0), reach))
        if lowest is None or knee_stop(curve, n):
            break
        seen = seen.unionByName(taken(top))
    return feats.sparkSession.createDataFrame(rows, "round int, reviewed long, found long, est_recall double")


def reviewer_grid(gold: DataFrame, misses: tuple[float, ...], overs: tuple[float, ...]) -> DataFrame:
    """Recall and precision of a reviewer at each pair of error rates; all cells in one pass."""
    cells = F.array(*[F.struct(F.lit(a).alias("miss"), F.lit(b).alias("over")) for a in misses for b in overs])
    u = S.uniform("review", F.col("doc_id"), F.col("question"))
    drawn = gold.withColumn("u", u).withColumn("c", F.explode(cells)).select("gold", "u", "c.*")
    coded = F.when(F.col("gold") == 1, F.col("u") >= F.col("miss")).otherwise(F.col("u") < F.col("over"))
    at = drawn.groupBy("miss", "over").agg(F.count_if(coded & (F.col("gold") == 1)).alias("tp"), F.count_if(coded).alias("flagged"), F.count_if(F.col("gold") == 1).alias("pos"))
    return at.withColumns({"recall": S.rate_zero(F.col("tp"), F.col("pos")), "precision": S.rate_zero(F.col("tp"), F.col("flagged"))})


def nearest_cell(grid: DataFrame, miss: float, over: float) -> DataFrame:
    """The grid cell nearest to given rates."""
    return grid.orderBy(F.abs(F.col("miss") - miss) + F.abs(F.col("over") - over), "miss", "over").limit(1)


def clusters_pick(feats: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """A document for each of k clusters: the nearest to its centre (ties: smaller id)."""
    from pyspark.ml.clustering import KMeans

    feats = stored(feats)
    model = KMeans(k=k, seed=seed, maxIter=5, featuresCol="features").fit(feats)
    centres = feats.sparkSession.sparkContext.broadcast([c.tolist() for c in model.clusterCenters()])
    spread = feats.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres.value)], "prediction int, centre array<double>")
    spread = spread.withColumn("size", F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    placed = model.transform(feats).join(F.broadcast(spread), "prediction").withColumn("v", F.unwrap_udt("features"))
    at = F.coalesce("v.indices", F.sequence(F.lit(0), F.size("v.values") - 1))
    more = F.zip_with("v.values", at, lambda a, i: a * (a - 2 * F.get("centre", i)))  # only terms that a document has differ from the centre's length
    gap = F.aggregate(more, F.col("size"), lambda s, x: s + x)
    return placed.withColumn("gap", gap).groupBy("prediction").agg(F.min_by("doc_id", F.struct("gap", "doc_id")).alias("doc_id"), F.count("*").alias("size"))
