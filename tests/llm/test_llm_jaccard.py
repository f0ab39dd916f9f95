"""The n-gram Jaccard join against all pairs of a small table."""

import random
import re

import numpy as np
import pytest
from caseload.llm import jaccard


def brute(rows, size=5, percent=80):
    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            shared = len(x & y)
            if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(x), find(i)) for i, x in sets}


def answer(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df).collect()}


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert answer(spark, rows) == brute(rows)


def test_edited_copies_and_odd_texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(12)]
    for n in [1, 2, 3, 5, 6, 7, 9, 12, 20, 45, 90, 200]:
        for _ in range(4):
            words = [rng.choice(vocabulary) for _ in range(n)]
            for edits in [0, 0, 1, 1, 2, 3, n // 40, n // 30, n // 20]:
                copy = list(words)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                if rng.random() < 0.3:
                    copy = copy[: len(copy) - len(copy) // 8] + (passage if rng.random() < 0.5 else [])
                rows.append((len(rows) * 3, rng.choice([" ", "\t", " \n"]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    rows += [(9001, None), (9002, ""), (9003, "  \n"), (9004, "one"), (9005, "ONE"), (9006, "one two"), (9007, " one")]
    assert answer(spark, rows) == brute(rows)


def test_chain_of_links_and_shared_ids(spark):
    words = [f"v{i}" for i in range(300)]
    rows = [(50 - k, " ".join(words[k * 12 : k * 12 + 120])) for k in range(14)]
    assert answer(spark, rows) == brute(rows)
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(same).where("doc_id is not null").collect()) == [(1, 1), (1, 1), (2, 1)]
    assert jaccard.jaccard_join(same.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    first, second = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, first), (1, second), (2, first), (3, second + " end"), (4, None), (4, "x"), (5, second), (1, first)]
    df = spark.createDataFrame([(i, t, k, {"m": k}) for k, (i, t) in enumerate(rows)], "doc_id long, text string, h long, set_a map<string,int>")
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df).collect()) == [(1, 26, 1)] * 3 + [(2, 26, 1), (3, 27, 1), (4, 0, 4), (4, 1, 4), (5, 26, 1)]
    left = jaccard.first_of_each(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == sorted([(1, first), (1, second), (4, ""), (4, "x")])


def test_equals_brute_force_over_rows_with_repeated_ids(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    rows = []
    for _ in range(60):
        parts = rng.choice(base).split()
        if rng.random() < 0.6:
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((rng.randrange(25), " ".join(parts)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    found = brute([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, (_, c) in found.items():
        least[c] = min(least.get(c, 99), rows[k][0])
    assert got == sorted((rows[k][0], n, least[c]) for k, (n, c) in found.items())
    kept = jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept == len({c for _, c in found.values()})


@pytest.mark.parametrize("n", [1, 2, 4, 8, 9, 10, 19, 37, 60, 150, 400])
def test_similar_sets_share_a_signature(n):
    rng = np.random.default_rng(n)
    for _ in range(150):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(rng.integers(0, n + 1))
        add = int(rng.integers(0, n // 4 + 1))
        y = np.unique(np.concatenate([x[rng.permutation(len(x))[drop:]], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if not len(y) or 100 * shared < 80 * (len(x) + len(y) - shared):
            continue
        met, popular = 0, rng.integers(0, 1 << 63, jaccard.CELLS >> 6).astype(np.uint64)
        for b in set(jaccard.bands_for(len(x), 0.8)) & set(jaccard.bands_for(len(y), 0.8)):
            left = []
            (ex, sx, ax, rx), (ey, sy, ay, ry) = (jaccard.signatures(s, b, 0.8) for s in (x, y))
            common = np.intersect1d(ex, ey)
            for sigs, sizes, spare in ((ex, sx, rx), (ey, sy, ry)):
                hit = np.isin(sigs, common)
                left.append(set(sigs[hit][jaccard.costly_first(sigs[hit], sizes[hit], popular)[spare:]].tolist()))
            met += bool(set(ax.tolist()) & set(ay.tolist())) or bool(left[0] & left[1])
        assert met
        a, b = jaccard.sketch(x), jaccard.sketch(y)
        for _ in range(8):
            a, b = (a[: len(a) // 2] ^ a[len(a) // 2 :] if len(a) > len(b) else a), (b[: len(b) // 2] ^ b[len(b) // 2 :] if len(b) > len(a) else b)
        assert sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)) <= len(x) + len(y) - 2 * shared
