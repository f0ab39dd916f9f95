"""Nearest neighbours on vectors that codes can hardly tell apart, against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from caseload.llm import anisotropic
from pyspark.sql import functions as F


def rows_of(kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16))
    if kind == "tight clusters":
        v = rng.normal(size=(4, 16))[rng.integers(0, 4, 3000)] + 0.01 * v
    elif kind == "one long dimension":
        v[:, 0] *= 100
    elif kind == "a few long vectors":
        v[::300] *= 1000
    return v.astype(np.float32)


@pytest.mark.parametrize("kind", ["tight clusters", "one long dimension", "a few long vectors"])
def test_search_against_brute_force(spark, tmp_path, kind):
    v = rows_of(kind)
    pq.write_table(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(list(v), pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    got = anisotropic.search(spark.read.parquet(f"{tmp_path}/v.parquet"), F.col("vec_id") % 50 == 0).toPandas()
    scores = v[::50].astype(float) @ v.T.astype(float)
    hits = 0
    for i, query in enumerate(range(0, len(v), 50)):
        scores[i, query] = -np.inf
        hits += len(set(np.argsort(-scores[i], kind="stable")[:20]) & set(got[got["query_id"] == query]["vec_id"]))
    assert hits / (20 * len(scores)) >= 0.95
