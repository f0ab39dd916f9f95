"""Samples with shared quotas and pools of windows, against plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from caseload.operators import order as O
from caseload.operators import scope as C
from caseload.operators import windows as W
from pyspark.sql import functions as F


def u(*key):
    return int(hashlib.sha1("|".join(map(str, key)).encode()).hexdigest()[:12], 16) / 16**12


def labels_of(spark, n, topics, seed=1):
    draw = random.Random(seed)
    rows = [(i, t, int(draw.random() < 0.02 * (k + 1))) for i in range(n) for k, t in enumerate(topics)]
    return rows, spark.createDataFrame(rows, "doc_id long, question string, gold int")


def test_scarce_topics_choose_first(spark):
    topics = ["d", "c", "b", "a"]
    rows, labels = labels_of(spark, 900, topics)
    docs = [(i, "hard" if i % 3 == 0 else "random") for i in range(880)]
    got = C.scarce_first(labels, spark.createDataFrame(docs, "doc_id long, stratum string"), topics, 15, 100)
    pos = defaultdict(set)
    for i, t, g in rows:
        if g and i < 880:
            pos[t].add(i)
    chosen = {}
    for t in sorted(topics, key=lambda t: (len(pos[t]), t)):
        have = len(pos[t] & set(chosen))
        for i in sorted(pos[t] - set(chosen), key=lambda i: (u("scarce", t, i), i))[: max(0, 15 - have)]:
            chosen[i] = t
    need, free = 100 - len(chosen), [d for d in docs if not any(d[0] in p for p in pos.values())]
    for stratum, want in (("hard", need // 2), ("random", need - need // 2)):
        chosen |= {i: stratum for i, s in sorted((d for d in free if d[1] == stratum), key=lambda d: (u("scarce", stratum, d[0]), d[0]))[:want]}
    assert {r["doc_id"]: r["claim"] for r in got.collect()} == chosen and got.count() == 100


def scans(df):
    return df._jdf.queryExecution().analyzed().toString().count("Relation")


def test_plans_do_not_grow_with_questions(spark):
    sizes = {}
    for k in (2, 6):
        topics = [f"q{i}" for i in range(k)]
        _, labels = labels_of(spark, 60, topics)
        docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("hard").alias("stratum"))
        sizes[k] = (scans(C.least_positives(labels, docs, topics, 20, 2)), scans(C.scarce_first(labels, docs, topics, 2, 20)), scans(C.first_claim([(t, labels.where(F.col("question") == t), 3) for t in topics], docs)))
    assert sizes[2] == sizes[6]


@pytest.mark.parametrize("n", [0, 5, 40, 41, 60, 500])
def test_turns_over_groups(spark, n):
    draw = random.Random(3)
    docs = [(i, draw.choice("aaaaabbbcd") if i % 17 else None) for i in range(120)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 8)], "doc_id long, gold int")
    got = C.with_turns(labels, spark.createDataFrame(docs, "doc_id long, g string"), "g", n)
    free = defaultdict(list)
    for i, g in docs:
        if not (i < 40 and i % 8 == 0):
            free[g or ""].append(i)
    turns = [(k, u("turns", "group", g), g, i) for g, ids in free.items() for k, i in enumerate(sorted(ids, key=lambda i: (u("turns", i), i)))]
    want = {i for *_, i in sorted(turns)[: max(0, n - 5)]}
    assert {r["doc_id"] for r in got.where("positive = 0").collect()} == want and got.where("positive = 1").count() == 5


def test_lowest_by_group_with_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 5).cast("string"))).alias("g"), "id")
    wants = spark.createDataFrame([("hot", 700), ("g0", 3), ("g1", 0), ("g2", 10_000)], "g string, want int")
    got = O.lowest_by_group(rows, "g", F.pmod(F.xxhash64("id"), F.lit(50)) / 50.0, "id", wants, cells=8)
    assert Counter(r["g"] for r in got.collect()) == {"hot": 700, "g0": 3, "g2": 100}


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 8))) for _ in range(n))


def test_windows(spark):
    body = prose(1, 400)
    texts = {1: body, 2: f"From: a\nSubject: b\n\n{body}", 3: f"{body}\nOn Monday, Ann Lee wrote:\nrest", 4: prose(2, 60), 5: None, 6: "", 7: "x" * 3000, 8: f"[12:00] chat\n\n{body}", 9: f"> {body}", 10: prose(3, 165) + "-" * 4000}
    docs = spark.createDataFrame([(i, "c", t) for i, t in texts.items()] + [(1, "c", body)], "doc_id long, source string, text string")
    got = defaultdict(dict)
    for r in W.windows(docs, "source").collect():
        got[r["doc_id"]][r["cut"]] = r
    assert set(got) == {1, 2, 3, 8}
    for i in got:
        for cut, r in got[i].items():
            near = max(250, min(int(len(body) * cut), 1200))
            at = body.rfind(" ", 0, near)
            assert r["prefix"] == body[:at] and body[at + 1 :].startswith(r["target"]) and len(r["target"].split()) == 60
    assert got[2][0.45]["head"] == "From: a\nSubject: b" and got[8][0.45]["head"] == "[12:00] chat" and got[1][0.45]["head"] == ""


def test_pool_takes_the_first_passing_window(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], prose(i, 300)) for i in range(60)], "doc_id long, source string, text string")
    found = W.windows(docs, "source")
    passes = F.when(F.col("doc_id") % 3 > 0, F.col("place") >= F.col("doc_id") % 3)  # null for every third document
    existing = found.where("place = 1 and doc_id < 8").select("corpus", "doc_id", "cut")
    for parts in (1, 7):
        got = W.pool(found.repartition(parts), existing, passes, 9).collect()
        old = {r["doc_id"]: r["passed"] for r in got if not r["replacement"]}
        assert old == {i: i % 3 == 1 for i in range(8)}
        for k, c in enumerate("ab"):
            have = sum(ok for i, ok in old.items() if i % 2 == k)
            free = sorted((i for i in range(8, 60) if i % 2 == k and i % 3), key=lambda i: (u("windows", i), i))
            new = {r["doc_id"]: r["cut"] for r in got if r["replacement"] and r["corpus"] == c}
            assert new == {i: W.CUTS[i % 3] for i in free[: 9 - have]}


def test_keyword_sample_forces_documents(spark):
    docs = [(i, "a ship came" if i % 10 < 6 else "by train" if i % 10 < 8 else "on foot" if i % 10 < 9 else " ") for i in range(200)]
    forced = [0, 6, 16, 26, 36, 46, 9]
    got = C.keyword_sample(spark.createDataFrame(docs, "doc_id long, text string"), "ship", "train", spark.createDataFrame([(i,) for i in forced], "doc_id long"), 20).collect()
    assert Counter(r["stratum"] for r in got) == {"first": 13, "second": 5, "other": 4}  # five are forced where three are due
    assert {r["doc_id"] for r in got if r["forced"]} == set(forced) - {9}
