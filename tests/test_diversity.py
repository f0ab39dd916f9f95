"""Truncated SVD against numpy, and samples of one document a cluster."""

import time

import numpy as np
import pytest
from caseload.operators import diversity as V
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def sparse(spark, dense):
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[np.flatnonzero(r)]]) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, V.SPARSE).repartition(5)


def test_singular_values_equal_numpy(spark):
    rng = np.random.default_rng(1)
    dense = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 24)) + 0.05 * rng.standard_normal((60, 24))
    dense[rng.random(dense.shape) < 0.5] = 0
    dense[7] = 0
    values, right = V.truncated_svd(sparse(spark, dense), 24, 5, passes=30)
    _, want, vt = np.linalg.svd(dense)
    assert values == pytest.approx(want[:5], rel=1e-6)
    assert np.abs(np.sum(right * vt[:5].T, axis=0)) == pytest.approx(np.ones(5), abs=1e-3)
    z = {r["doc_id"]: np.array(r["z"]) for r in V.embedded(sparse(spark, dense), right).collect()}
    assert not z[7].any() and np.linalg.norm(z[3]) == pytest.approx(1)


def test_term_rows_are_of_length_one(spark):
    docs = spark.createDataFrame([(1, "red red apple"), (2, "red apple pie"), (3, None), (4, ""), (5, "unseen")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in V.term_rows(docs, 1 << 12).collect()}
    assert len(got) == 5 and not got[3]["terms"] and not got[4]["terms"] and not got[5]["terms"]
    assert sum(w * w for w in got[1]["weights"]) == pytest.approx(1)
    assert len(got[1]["terms"]) == 3  # red, apple, "red apple"


def test_as_many_documents_as_asked_for(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = V.diversity_sample(docs, 30, dims=8, buckets=512, batch=100, rounds=4).collect()
    assert len({r["doc_id"] for r in got}) == 30
    named = [r["cluster"] for r in got if r["cluster"] is not None]
    assert len(named) == len(set(named)) > 10
    assert V.diversity_sample(docs.limit(0), 5).count() == 0
    assert V.diversity_sample(docs.orderBy("doc_id").limit(3), 5, dims=2, buckets=64, rounds=1).count() == 3


def test_clusters_are_found(spark):
    words = ["alpha beta gamma delta", "one two three four", "rouge vert bleu noir"]
    docs = spark.createDataFrame([(i, words[i % 3]) for i in range(90)], "doc_id long, text string")
    got = V.diversity_sample(docs, 3, dims=3, buckets=256, batch=40, rounds=5).where(F.col("cluster").isNotNull()).collect()
    assert len({r["doc_id"] % 3 for r in got}) == len(got) and all(r["gap"] < 1e-9 for r in got)


def test_length_is_taken_once_a_document(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 6000), i -> concat('w', (i * 7 + id * i) % 9000)))").alias("text"))
    began = time.perf_counter()
    rows = V.term_rows(docs, 1 << 14).collect()
    assert time.perf_counter() - began < 40  # a sum for each entry takes minutes
    assert len(rows) == 40 and all(sum(w * w for w in r["weights"]) == pytest.approx(1) for r in rows)


def test_terms_are_counted_a_row_at_a_time(spark, monkeypatch):
    held = []
    monkeypatch.setattr(V, "stored", lambda df: held.append(df) or df)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(50))) for i in range(8)], "doc_id long, text string")
    V.term_rows(docs, 64).collect()
    assert held[0].count() == 8  # not a row for each document and term


def test_rows_that_share_an_id_count_together(spark):
    docs = spark.createDataFrame([(1, "red red apple"), (1, "apple pie"), (2, "red apple pie"), (None, "red apple"), (None, None)], "doc_id long, text string")
    got = sorted([(r["doc_id"], len(r["terms"]), sum(w * w for w in r["weights"])) for r in V.term_rows(docs, 1 << 12).collect()], key=str)
    assert [g[:2] for g in got] == [(1, 5), (1, 5), (2, 5), (None, 0), (None, 0)]  # red, apple, pie, "red apple", "apple pie"
    assert [g[2] for g in got] == pytest.approx([1, 1, 1, 0, 0])
