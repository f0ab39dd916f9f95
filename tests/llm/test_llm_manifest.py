"""Spelling variants, Merkle manifests and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from caseload.llm import merkle, queries, sharding, spelling
from caseload.llm.ranks import ranked
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, source string, lang string, n_chars long, text string"


# Spelling variants.


def brute_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_near(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    return {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}


def brute_groups(docs):
    n = brute_words(docs)
    near, forms, out = brute_near(n), {}, {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (n[w], len(near[w]), forms[w], n[forms[w]] if forms[w] else None, root)
    return out


def grouped(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.fixture(scope="module")
def spelled():
    draw = random.Random(5)
    base = ["señor", "letter", "kitten", "aaaaa", "abcabc", "Ärgerlich", "x" * 60, "×÷abc", "banana"]
    docs = []
    for i in range(40):
        said = []
        for w in base:
            for _ in range(draw.randrange(3)):
                k = draw.randrange(len(w) + 1)
                said.append(draw.choice([w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + draw.choice("aeß") + w[k:], w[:k] + "e" + w[k + 1 :]]))
        docs.append((i, " ".join(said)))
    return [*docs, (1, docs[1][1]), (None, "letter letter letter"), (50, None), (51, ""), (52, "...")]


@pytest.mark.parametrize(("most", "searches"), [(16_384, 131_072), (7, 5), (1, 1)])
def test_variants_equal_brute_force_at_any_cut(spark, spelled, most, searches):
    docs = spark.createDataFrame(spelled, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "cell": F.lit(0)})
    got = grouped(spelling.group_variants(docs, most, searches))
    assert got == brute_groups(spelled) and len(got) > 10


def test_query_of_variants_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert grouped(queries.op11_spelling_variants(spark, SF)) == brute_groups(docs)


def test_no_words_give_no_groups(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "one two")], "doc_id long, text string")).count() == 0


def test_verification_agrees_with_one_edit():
    draw = random.Random(3)
    words = ["".join(draw.choice("ab") for _ in range(draw.choice([1, 2, 5, 6, 47, 48, 49, 50]))) for _ in range(150)]
    words += [w[:3] + "b" + w[3:] for w in words[:60]] + [w[:2] + "a" + w[3:] for w in words[:60]]
    held = spelling.Words(words, list(range(spelling.GROUPS)))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    got = spelling.verified(held, held, i, j)
    for a, b, ok in zip(i, j, got, strict=True):
        x, y = words[a], words[b]
        assert ok == (len(y) - len(x) in (0, 1) and x != y and spelling.one_edit(x.encode(), y.encode())), (x, y)


# Merkle manifests.


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(nodes):
    """Root, and for each leaf its siblings, left to right, from the leaf up."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for leaf, i in enumerate(at):
            proofs[leaf] += [x for k, x in enumerate(runs[i // 3]) if k != i % 3]
        nodes, at = [sha(*r) for r in runs], [i // 3 for i in at]
    return nodes[0], proofs


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:  # doc_id, source, lang, n_chars, text
        by[r[1]].append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    root, above = brute_tree([trees[s][0] for s in order])
    return root, sorted(
        ((r[0], leaf, trees[s][0], sha(*proof, *above[k])) for k, s in enumerate(order) for (_, _, leaf, r), proof in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True)),
        key=str,
    )


def manifest(df):
    proof = F.sha2(F.concat_ws("", merkle.siblings(F.col("path"))), 256)
    got = df.select("doc_id", "leaf", "subroot", proof.alias("proof"), "root", merkle.folded(F.col("leaf"), F.col("path")).alias("folded")).collect()
    assert all(r["folded"] == r["root"] for r in got) and len({r["root"] for r in got}) <= 1
    return (got[0]["root"] if got else None), sorted((tuple(r)[:4] for r in got), key=str)


def odd_rows(n):
    draw = random.Random(n)
    rows = [(draw.choice([i, i, None, 7]), draw.choice([None, "", "a", "ä", "zz", "Z"]), draw.choice([None, "de"]), i, draw.choice([None, "", "x\ny", "ß" * i])) for i in range(n)]
    return rows + rows[:3]


@pytest.mark.parametrize("height", [7, 2, 1])
def test_manifest_equals_brute_force(spark, height):
    rows = odd_rows(120)
    docs = spark.createDataFrame(rows, DOC).withColumns({"node": F.lit(1), "place": F.lit("x"), "path": F.lit(0)})
    docs = docs.select(*merkle.FIELDS, "node", "place", "path").repartition(7)
    root, want = brute_manifest(rows)
    assert manifest(merkle.sealed(docs, height=height)) == (root, want)


def test_manifest_of_one_and_of_none(spark):
    one = [(5, "s", None, 3, "abc")]
    assert manifest(merkle.sealed(spark.createDataFrame(one, DOC))) == (brute_leaf(one[0]), [(5, brute_leaf(one[0]), brute_leaf(one[0]), sha())])
    assert merkle.sealed(spark.createDataFrame([], DOC)).count() == 0


def test_only_tampered_documents_fail(spark):
    got = queries.op12_merkle_manifest(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (texts[r["doc_id"]] or "")
        assert r["verified"] is not touched
    assert 0 < sum(not r["verified"] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 82])
def test_positions_are_the_order_of_completion(n):
    top = merkle.height_of(n)
    log = merkle.appended([str(i) for i in range(n)], top)
    nodes, at = [str(i) for i in range(n)], {}
    for level in range(top + 1):
        for i, x in enumerate(nodes):
            at[merkle.position(level, i, n, top)] = x
        nodes = [sha(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    assert [at[k] for k in range(len(at))] == log


@pytest.mark.parametrize("height", [7, 2])
def test_append_log_is_gapless_at_any_block_size(spark, height):
    rows = [(i, "a" if i % 3 else None, "de", i, f"text {i}") for i in range(130)]
    got = defaultdict(dict)
    for r in merkle.append_log(spark.createDataFrame(rows, DOC), height).collect():
        assert r["position"] not in got[r["source"]]
        got[r["source"]][r["position"]] = r["digest"]
    for source in (None, "a"):
        leaves = [brute_leaf(r) for r in rows if r[1] == source]
        assert [got[source][k] for k in range(len(got[source]))] == merkle.appended(leaves, merkle.height_of(len(leaves)))


# Sharding.


def brute_shards(spark, rows, shards, slack, replicas, fits, seed=11):
    """One arrival after the other, batch by batch, over the operator's own ring and batches."""
    arcs = sharding.ring(spark, shards, replicas, seed)
    held = sharding.measured(rows.withColumn("k", F.col("doc_id")), ["doc_id"], arcs, "k", 16, seed)
    order = {r["arc"]: r["shard_order"] for r in arcs.collect()}
    waiting = [(r["batch"], r["arc"], r["size"], r["doc_id"]) for r in held.collect()]
    cap = sum(w[2] for w in waiting) / shards * (1 + slack)
    load, placed = [0] * shards, {}
    for opening in range(fits + 1):
        closed, again = set(), []
        for batch in sorted({w[0] for w in waiting}):
            pending = [w for w in waiting if w[0] == batch]
            while pending:  # who is turned away tries the next shard with the same batch
                want = defaultdict(list)
                for w in pending:
                    s = next((s for s in order[w[1]] if s not in closed), None)
                    again.append(w) if s is None else want[s].append(w)
                full = {s for s, ws in want.items() if opening < fits and load[s] and load[s] + sum(w[2] for w in ws) > cap}
                if not full:
                    for s, ws in want.items():
                        load[s] += sum(w[2] for w in ws)
                        placed |= {w[3]: s for w in ws}
                        if opening == fits and load[s] >= cap:
                            closed.add(s)
                    break
                closed |= full
                again = [w for w in again if w not in pending]
        waiting = again
        if not waiting:
            return placed
    return placed


def shard_docs(spark, n=300):
    draw = random.Random(8)
    return spark.createDataFrame([(i, "x" * int(draw.paretovariate(0.9))) for i in range(n)], "doc_id long, text string")


@pytest.mark.parametrize("fits", [0, 3])
def test_shards_equal_one_arrival_after_the_other(spark, fits):
    docs = shard_docs(spark)
    got = {r["doc_id"]: r["shard"] for r in sharding.assigned(docs, 7, slack=0.01, replicas=16, fits=fits).collect()}
    assert got == brute_shards(spark, docs, 7, 0.01, 16, fits) and len(got) == 300


def test_shards_are_even_and_slots_gapless(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op13_sharding(spark, SF).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    by = defaultdict(list)
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) and r["grown_shard"] is None
        by[r["shard"]].append(r)
    assert len(got) == len(texts) and set(by) <= set(range(40))
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    mean = sum(r["size"] for r in got) / 40
    assert max(sum(r["size"] for r in rs) for rs in by.values()) <= max(1.2 * mean, max(r["size"] for r in got))


def test_a_shard_more_moves_few_rows(spark):
    docs = spark.createDataFrame([(i, "y" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    at = [{r["doc_id"]: r["shard"] for r in sharding.assigned(docs, n, slack=0.05).collect()} for n in (10, 11)]
    moved = sum(at[0][k] != at[1][k] for k in at[0])
    assert moved < 0.25 * len(at[0])  # a new shard's share is 1 / 11
    loads = Counter(at[1].values())
    assert set(loads) == set(range(11))


def test_sharding_of_odd_rows_and_hot_keys(spark):
    rows = [(None, None), (None, "a"), (1, ""), (1, None), (2, "same"), (2, "same")] + [(9, "hot text")] * 600 + [(i, "z" * 30) for i in range(10, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("mine"), "batch": F.lit(1), "arc": F.lit(2), "size": F.lit("s")})
    got = sharding.shard_rows(docs, 5).collect()
    assert len(got) == len(rows)
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) / (sum(loads.values()) / 5) < 1.02  # a third of all bytes has one key
    assert sharding.shard_rows(docs.limit(0), 5).count() == 0


def test_ranks_are_gapless_whatever_the_partitions(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    for parts in (1, 9):
        got = defaultdict(list)
        for r in ranked(rows.repartition(parts), "g", ["v"]).collect():
            got[r["g"]].append((r["place"], r["v"], r["size"]))
        for rs in got.values():
            rs.sort()
            assert [r[0] for r in rs] == list(range(len(rs))) and [r[1] for r in rs] == sorted(r[1] for r in rs) and {r[2] for r in rs} == {len(rs)}
