"""Review steps against plainer forms of theirs."""

import pytest
from caseload.operators import review as V
from caseload.plans import reports as R
from caseload.session import stored
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return R._labelled(spark, SF).withColumn("gold", F.when(F.pmod("doc_id", F.lit(3)) == 0, 1).otherwise(0))


@pytest.fixture(scope="module")
def feats(docs):
    return stored(V.features(docs, 1 << 10, keep=("gold",)).coalesce(1))


def test_features_keep_columns(docs, feats):
    joined = V.features(docs, 1 << 10).join(docs.select("doc_id", "gold"), "doc_id")
    rows = lambda d: sorted((r["doc_id"], r["gold"], str(r["features"])) for r in d.collect())
    assert rows(joined) == rows(feats)


def test_features_cut_texts_once(docs):
    plan = V.features(docs, 1 << 10, keep=("gold",))._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "counts" in plan


def test_rounds_read_features_without_sending_them(feats):
    plain = feats.select("doc_id", "features")
    a, b = V.cal(feats, batch=12, control=8, rounds=2), V.cal(plain, feats, batch=12, control=8, rounds=2)
    assert a.collect() == b.collect() and [r["reviewed"] for r in a.collect()] == [12, 24]


def test_picks_are_nearest_to_their_centres(feats):
    from pyspark.ml.clustering import KMeans

    got = V.clusters_pick(feats, 3)
    model = KMeans(k=3, seed=1, maxIter=5, featuresCol="features").fit(feats)
    best = {}
    for r in model.transform(feats).select("doc_id", "prediction", vector_to_array("features").alias("v")).collect():
        gap = sum((a - c) ** 2 for a, c in zip(r["v"], model.clusterCenters()[r["prediction"]], strict=True))
        best.setdefault(r["prediction"], []).append((gap, r["doc_id"]))
    assert {r["prediction"]: (r["doc_id"], r["size"]) for r in got.collect()} == {k: (min(v)[1], len(v)) for k, v in best.items()}
    assert "vector_to_array" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
