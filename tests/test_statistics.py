"""Bootstraps of medians, exact rank tests and permutation nulls against enumeration."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from caseload.functions import scalars as S
from caseload.operators import order as O
from caseload.operators import paired as P
from pyspark.sql import functions as F


def test_counts_of_u_by_enumeration():
    for n1, n0 in [(1, 1), (2, 3), (3, 4), (4, 4), (5, 2)]:
        u = Counter()
        for ranks in itertools.combinations(range(1, n1 + n0 + 1), n1):
            u[sum(ranks) - n1 * (n1 + 1) // 2] += 1
        assert S.mann_whitney_counts(n1, n0) == [u[k] for k in range(n1 * n0 + 1)]


def test_one_sided_p_of_u():
    assert S.mann_whitney_greater(9, 3, 3, 0) == pytest.approx(1 / 20)  # tabulated: all three above
    assert S.mann_whitney_greater(0, 3, 3, 0) == 1
    assert S.mann_whitney_greater(60, 8, 8, 0) == pytest.approx(0.0009, abs=1e-4)
    assert S.mann_whitney_greater(3, 0, 4, 0) is None and S.mann_whitney_greater(8, 4, 4, 8**3 - 8) is None
    exact = S.mann_whitney_greater(250, 20, 20, 0, exact_up_to=20)
    assert S.mann_whitney_greater(250, 20, 20, 0) == pytest.approx(exact, abs=2e-3)


def test_one_sided_p_from_rows(spark):
    rows = [("a", x, 1) for x in (5.0, 6.0, 7.0)] + [("a", x, 0) for x in (1.0, 2.0, 3.0)] + [("b", 1.0, 1), ("b", 1.0, 0)] + [("c", 2.0, 1)]
    got = {r["k"]: r for r in P.mann_whitney_greater(spark.createDataFrame(rows, "k string, v double, g int"), ["k"], "v", "g").collect()}
    assert got["a"]["p_value"] == pytest.approx(0.05) and got["b"]["p_value"] is None and got["c"]["p_value"] is None


def test_normal_quantile(spark):
    u = [1e-9, 0.001, 0.02, 0.1, 0.5, 0.7, 0.98, 0.9999]
    got = spark.createDataFrame([(x,) for x in u], "u double").select(S.normal_quantile(F.col("u")).alias("z")).collect()
    assert [r["z"] for r in got] == pytest.approx([S.inverse_normal(x) for x in u], abs=1e-7)


def test_weights_are_poisson(spark):
    alike = spark.createDataFrame([(n,) for n in (1, 3, 100, 640_000)], "n long")
    rows = P.drawn_weights(alike, "n", ["n"], 3000).groupBy("n", "replicate").agg(F.sum("w").alias("w"), F.count("*").alias("blocks"))
    at = rows.where("replicate > 0").groupBy("n").agg(F.avg("w").alias("mean"), F.var_pop("w").alias("var"), F.max("blocks").alias("blocks")).collect()
    for r in at:
        assert r["mean"] == pytest.approx(r["n"], rel=0.07) and r["var"] == pytest.approx(r["n"], rel=0.12)
        assert r["blocks"] <= 7  # whatever the number of equal clusters
    assert {r["n"]: r["w"] for r in rows.where("replicate = 0").collect()} == {n: n for n in (1, 3, 100, 640_000)}


def test_median_bootstrap(spark):
    rng = np.random.default_rng(4)
    values = np.round(rng.lognormal(3, 1, 4000), 2)
    rows = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 4.0), ("c", None)], "k string, v double")
    got = P.bootstrap_median(rows, ["k"], "v", 600).toPandas()
    assert set(got["k"]) == {"a", "b"}
    assert got[(got["k"] == "b") & (got["replicate"] == 0)]["median"].item() == 2.5
    a = got[got["k"] == "a"]
    assert a[a["replicate"] == 0]["median"].item() == pytest.approx(np.median(values))
    want = np.median(values[rng.integers(0, 4000, (2000, 4000))], axis=1)
    assert a[a["replicate"] > 0]["median"].std() == pytest.approx(want.std(), rel=0.15)


def rank(v):
    return [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]


def test_permutation_p_equals_enumeration(spark):
    draw = random.Random(2)
    data = {k: ([draw.randrange(6) for _ in range(7)], [draw.randrange(9) for _ in range(7)]) for k in "abc"}
    data["flat"], data["two"] = ([1, 2, 3], [4, 4, 4]), ([1, 2], [2, 1])
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, (xs, ys) in data.items() for x, y in zip(xs, ys, strict=True)], "k string, x double, y double")
    got = {r["k"]: r for r in P.spearman_test(rows, ["k"], "x", "y", 4000).collect()}
    for k in "abc":
        xs, ys = (np.array(rank(v)) for v in data[k])
        rho = np.corrcoef(xs, ys)[0, 1]
        all_rho = [np.corrcoef(xs, p)[0, 1] for p in itertools.permutations(ys)]
        p = np.mean([abs(r) >= abs(rho) - 1e-12 for r in all_rho])
        assert got[k]["rho"] == pytest.approx(rho) and got[k]["p_value"] == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / 4000) + 1e-9)
    assert got["flat"]["p_value"] is None and got["two"]["rho"] is None and got["two"]["p_value"] is None


def test_permutation_p_of_many_rows_is_normal(spark):
    n = P.DRAWN_UP_TO + 500
    draw = random.Random(9)
    rows = spark.createDataFrame([(1, draw.random(), draw.random()) for _ in range(n)], "k int, x double, y double")
    r = P.spearman_test(rows, ["k"], "x", "y").first()
    assert r["n"] == n and r["p_value"] == pytest.approx(math.erfc(abs(r["rho"]) * math.sqrt((n - 1) / 2)), abs=1e-9)


def test_running_sums_by_ranges(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"), F.lit(2).alias("c"))
    got = O.running(rows.repartition(6), ["k"], ["v"], {"upto": F.col("c")}).collect()
    assert len(got) == 500 and all(r["upto"] == 2 * (r["v"] // 2 + 1) for r in got)


def test_equal_clusters_draw_by_inversion(spark):
    n, replicates = 1000, 3000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("doc"))
    got = P.resampled(rows.groupBy("doc").agg(F.sum("k").alias("k")), ["k"], replicates).toPandas().set_index("replicate")["k"]
    steps = {m: P.poisson_steps(m) for m in (64, 32, 8)}  # 1000 = 15 * 64 + 32 + 8
    draw = lambda r, size, i: sum(x <= int(hashlib.sha1(f"boot|{r}|{size}|{i}|1".encode()).hexdigest()[:12], 16) / 2**48 for x in steps[size])
    for r in (1, 7, replicates):
        assert got[r] == sum(draw(r, 64, i) for i in range(15)) + draw(r, 32, -1) + draw(r, 8, -1)
    assert got[0] == n and got[1:].var() == pytest.approx(n, rel=0.12)
