"""Hand-computed cases, properties, and operators that SQL doesn't check."""

import json
import math
import random

import pytest
from caseload.functions import scalars as S
from caseload.functions import text as T
from caseload.operators import gold as G
from caseload.operators import joins as J
from caseload.operators import paired as P
from caseload.operators import quality as Q
from caseload.operators import retrieval as R
from caseload.operators import review as V
from caseload.operators import sampling as M
from caseload.sources import files
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def decisions(spark, rows):
    return spark.createDataFrame([("m", "a", "q", i, g, label, p, gray, p is None) for i, (g, label, p, gray) in enumerate(rows)], "model string, arm string, question string, doc_id long, gold int, label int, p double, gray boolean, error boolean")


def test_one_of_each_cell(spark):
    r = Q.quality(decisions(spark, [(1, 1, 0.9, False), (0, 1, 0.8, False), (1, 0, 0.2, False), (0, 0, 0.1, False)])).where("question is null and gray_mode = 'all'").first()
    assert (r["precision"], r["recall"], r["f1"], r["elusion"], r["kappa"]) == (0.5, 0.5, 0.5, 0.5, 0.0)


def test_one_class_gives_null_statistics(spark):
    d = decisions(spark, [(1, 1, 0.9, False), (1, 0, 0.4, True)])
    r = Q.quality(d).where("question is not null and gray_mode = 'all'").first()
    assert r["kappa"] is None and r["log_loss"] is None and r["brier"] == pytest.approx((0.01 + 0.36) / 2)
    assert Q.ranking(d, ["model"]).first()["roc_auc"] is None


def test_errors_are_counted_and_never_scored(spark):
    r = Q.quality(decisions(spark, [(1, None, None, False), (0, 0, 0.1, False)])).where("question is null and gray_mode = 'all'").first()
    assert (r["n_errors"], r["n"], r["precision"]) == (1, 1, 0.0)


def test_bin_edges_belong_to_the_left_bin(spark):
    r = Q.calibration(decisions(spark, [(0, 0, p, False) for p in (0.0, 0.1, 0.3, 0.7)]), ["model"]).first()
    assert r["n_bins"] == 3 and r["ece"] == pytest.approx(1.1 / 4)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=40))
def test_areas_equal_brute_force(spark, rows):
    if len({g for g, _ in rows}) < 2:
        return
    r = Q.ranking(decisions(spark, [(g, int(p > 3), p / 6, False) for g, p in rows]), ["model"]).first()
    pos, neg = [p for g, p in rows if g], [p for g, p in rows if not g]
    assert r["roc_auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    best = max(2 * sum(p >= t for p in pos) / (sum(p >= t for p in pos) + sum(p >= t for p in neg) + len(pos)) for _, t in rows)
    assert r["best_f1"] == pytest.approx(best)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(0, 40))
def test_exact_test_is_symmetric(b, c):
    assert S.mcnemar_exact(b, c) == pytest.approx(S.mcnemar_exact(c, b)) and 0 < S.mcnemar_exact(b, c) <= 1


def test_known_values():
    assert S.mcnemar_exact(0, 0) == 1 and S.mcnemar_exact(5, 0) == 0.0625
    assert S.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and S.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.d_prime(50, 100, 50, 100) == 0 and S.d_prime(90, 100, 10, 100) > 2


def test_wilson_at_the_ends(spark):
    low, high = S.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (0, 10), (10, 10)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert tuple(got[0]) == (0, 1) and got[1]["l"] == 0 and got[2]["h"] == pytest.approx(1)


def test_estimates_follow_from_known_counts(spark):
    run = spark.createDataFrame([("t", "a", 3.0), ("t", "b", 2.0)], "topic string, docid string, score double")
    judged = spark.createDataFrame([("t", "a", 1, 1 / 2069.8989), ("t", "b", 0, 1 / 138.9120), ("t", "c", 1, 1 / 384.2424)], "topic string, docid string, rel int, p_select double")
    r = R.estimates(run, judged, [2]).first()
    assert (round(r["precision"], 4), round(r["recall"], 4), round(r["jaccard"], 4), round(r["miss_share"], 4)) == (0.9371, 0.8434, 0.7982, 0.7345)


def test_alignment_equals_dynamic_programming():
    rng = random.Random(2)
    assert T.longest_common_subsequence(list("abcd"), list("bdc")) == 2 and T.longest_common_run(list("abcd"), list("bdc")) == 1
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert T.longest_common_subsequence(a, b) == table[-1][-1]


def test_segments_cover_the_text_in_order():
    text = "\n\n".join(["A short one.", "x" * 50, "Sentence one. " * 200, "tail"])
    spans = T.cut_segments(text)
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False)) and spans[-1][1] == len(text)
    assert max(b - a for a, b in spans) <= 1200


def test_names_replies_and_edits(spark):
    assert T.names_in('"Doe, Jane" <jd@x.com>, bob SMITH; carol (x)') == ["Jane Doe", "Bob Smith", "Carol"]
    df = spark.createDataFrame([("I'm sorry, I cannot reproduce copyrighted text", "Yes, it is"), ("Dear all", "no.")], "a string, b string")
    got = df.select(T.refusal(F.col("a")).alias("r"), T.yes_no(F.col("b")).alias("y")).collect()
    assert [(r["r"], r["y"]) for r in got] == [("policy", 1), (None, 0)]
    edits = F.array(F.struct(F.lit("b").alias("old"), F.lit("c").alias("new")), F.struct(F.lit("zz").alias("old"), F.lit("y").alias("new")))
    r = spark.createDataFrame([("a b b",)], "t string").select(T.edited(F.col("t"), edits).alias("e")).first()["e"]
    assert (r["text"], r["missing"]) == ("a c c", "zz")
    assert df.select(T.renamer({"all": "both"})("a").alias("t")).collect()[1]["t"] == "Dear both"


def test_span_labels_on_the_half(spark):
    spans = spark.createDataFrame([(1, 0, 10), (1, 100, 110), (1, 200, 210)], "doc_id long, start long, stop long")
    gold = spark.createDataFrame([(1, 5, 30), (1, 106, 130)], "doc_id long, `from` long, `to` long")
    got = {r["start"]: (r["label"], r["gray"]) for r in J.label_spans(spans, gold, ["doc_id"], 7).collect()}
    assert got == {0: (1, False), 100: (0, True), 200: (0, False)}


def test_bootstrap_covers_the_value(spark):
    rows = [(i, i % 2, i % 2 if i % 5 else 1 - i % 2, i % 2 if i % 7 else 1 - i % 2, 0.5, 0.5, "q") for i in range(300)]
    pairs = spark.createDataFrame(rows, "doc_id long, gold int, x int, y int, px double, py double, question string")
    for r in P.intervals(P.bootstrap_deltas(P.cluster_counts(pairs, "doc_id"), "doc_id", 200)).collect():
        assert r["low"] <= r["value"] <= r["high"] and r["high"] - r["low"] < 0.3


def test_votes_and_first_rows(spark):
    v = spark.createDataFrame([(1, "q", "a", 1, 0.9), (1, "q", "b", 0, 0.1), (1, "q", "c", 1, 0.8)], "doc_id long, question string, model string, label int, p double")
    assert {r["model"]: (r["gold"], r["gray"]) for r in G.leave_one_out(v).collect()} == {"a": (None, True), "b": (1, False), "c": (None, True)}
    assert G.keep_first(v.select("question", "model", "p"), ["question"], ["model"]).first()["p"] == 0.9


def test_nearest_twin(spark):
    a = spark.createDataFrame([("g", 10, 1), ("g", 100, 2), ("h", 5, 3)], "g string, v int, id long")
    b = spark.createDataFrame([("g", 9, 11), ("g", 12, 12), ("g", 70, 13)], "g string, v int, id long")
    assert {r["id"]: (r["twin"], r["gap"]) for r in M.nearest_twin(a, b, "g", "v", "id").collect()} == {1: (11, 1), 2: (13, 30)}


def test_knee_needs_a_bend_and_effort():
    assert not V.knee_stop([(10, 8), (20, 16), (30, 24)], 1000)
    assert V.knee_stop([(100, 90), (200, 100), (900, 101)], 1000) and not V.knee_stop([(10, 9), (20, 10), (90, 10)], 1000)
    assert V.cal.__doc__ and math.isclose(M.control_size(1000, 100), 300)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(x) + "\n" for x in [{"id": "a", "text": "x y", "labels": {"q": "yes"}}, {"text": "z"}]), encoding="utf-8")
    got = files.read_corpus(spark, str(tmp_path / "c.jsonl")).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["x y", "z"] and got[0]["labels"] == {"q": "yes"} and got[1]["gray"] == []
    (tmp_path / "q.txt").write_text("007 0 d1 1 0.5\n007 0 d1 0 0.25\n7 d2 2 f\n")
    assert sorted(tuple(r) for r in files.read_qrels(spark, str(tmp_path / "q.txt")).collect()) == [("7", "d1", 0, 0.25), ("7", "d2", 2, 1.0)]
    path = files.run_path("trec", "multi", "mid", tag="rep2")
    r = spark.createDataFrame([(path,)], "p string").select(files.run_parts(F.col("p")).alias("x")).first()["x"]
    assert tuple(r) == ("trec", "multi", "mid", "rep2")
    assert files.read_or_empty(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "m1.txt").write_bytes(b"caf\xe9\r\n\r\n\r\n\r\nx")
    (tmp_path / "mail" / "m2.txt").write_bytes("café".encode())
    assert {r["id"]: r["text"] for r in files.read_messages(spark, str(tmp_path / "mail")).collect()} == {"m1": "café\n\nx", "m2": "café"}


def test_message_headers(spark):
    from caseload.operators import corpus as C

    rows = [(1, "From: Doe, Jane <j@x>\nTo: Bob Smith,\n Ann Lee\nX-SDOC: 1\n\nTo: not a header"), (2, "From: Jane Doe\nSubject: hi\n\nbody"), (3, "no header")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["field"]): r["value"] for r in C.header_fields(df).collect()}
    assert got == {(1, "from"): "Doe, Jane <j@x>", (1, "to"): "Bob Smith, Ann Lee", (2, "from"): "Jane Doe", (2, "subject"): "hi"}
    assert {r["surname"]: r["n"] for r in C.header_names(df, 1).collect()}["Smith"] == 1


def test_mcnemar_is_exact_at_every_size():
    import math

    from caseload.functions.scalars import mcnemar_exact

    for b, c in ((0, 0), (0, 9), (3, 8), (5, 5), (900, 1101), (1500, 1501), (2400, 2700)):
        n = b + c
        want = min(1.0, 2 * (sum(math.comb(n, i) for i in range(min(b, c) + 1)) * 10**40 // 2**n) / 10**40) if n else 1.0
        assert abs(mcnemar_exact(b, c) - want) <= 1e-9 * max(want, 1e-30)
    assert 0 < mcnemar_exact(1_000_000, 1_003_000) < 0.05


def test_quantiles_both_ways_and_places(spark):
    from caseload.operators import order as O

    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("v"))
    shares = {"a": 0.0, "b": 0.37, "c": 1.0}
    few, many = (sorted(map(tuple, O.quantiles(rows, ["g"], "v", shares, small=n).collect())) for n in (10**6, 0))
    assert [tuple(round(x, 9) for x in r) for r in few] == [tuple(round(x, 9) for x in r) for r in many]
    got = O.placed(rows.withColumn("i", F.monotonically_increasing_id()), ["g"], [F.floor(F.col("v") / 10), F.col("v")], [F.asc("i")], {"s": F.col("v")}).collect()
    for g in range(3):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["v"], r["i"]))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine[-1]["s"] == sum(r["v"] for r in mine)
    low = O.lowest(rows.select("v").distinct(), F.col("v") / 101, "v", 10, cells=4)
    assert sorted(r[0] for r in low.collect()) == list(map(float, range(10)))
