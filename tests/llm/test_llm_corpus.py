"""Language-model scoring, nearest neighbours, mixing and the pipeline against brute force."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from caseload.llm import anisotropic, bpe, ctw, mixing, queries, secrets
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_ctw(training, text):
    """log10 chance of a text: context trees of nested dicts, all contexts kept."""
    counts = Counter()

    def choices(raw):
        b = bytes([255] * ctw.DEPTH) + raw + bytes([255])
        for i in range(ctw.DEPTH, len(b)):
            for bit in range(8):
                yield (1 << bit) | (b[i] >> (8 - bit)), (b[i] >> (7 - bit)) & 1, b[i - ctw.DEPTH : i]

    for t in training:
        for node, one, ctx in choices(lower(t).encode()):
            for d in range(ctw.DEPTH + 1):
                counts[node, ctx[ctw.DEPTH - d :], one] += 1
    contexts = {(node, ctx) for node, ctx, _ in counts}
    children = {}
    for node, ctx in contexts:
        if ctx:
            children.setdefault((node, ctx[1:]), []).append(ctx)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def own(node, ctx):
        return kt(counts[node, ctx, 0], counts[node, ctx, 1])

    known = {}

    def weighted(node, ctx):
        if (node, ctx) not in known:
            if len(ctx) == ctw.DEPTH:
                known[node, ctx] = own(node, ctx)
            else:
                known[node, ctx] = np.logaddexp(own(node, ctx), sum(weighted(node, c) for c in children.get((node, ctx), []))) - math.log(2)
        return known[node, ctx]

    total = 0.0
    for node, one, ctx in choices(lower(text).encode()):
        p = None
        for d in range(ctw.DEPTH, -1, -1):
            here = ctx[ctw.DEPTH - d :]
            a, b = counts[node, here, 0], counts[node, here, 1]
            est = (b + 0.5) / (a + b + 1)
            if p is None:
                p = est
            else:
                share = math.exp(own(node, here) - math.log(2) - weighted(node, here))
                p = share * est + (1 - share) * p
        total += math.log10(p if one else 1 - p)
    return total


def test_ctw_equals_brute_force(spark):
    training = ["the cat sat on the mat", "The dog, the log", "été à la", "", None]
    texts = ["the cat", "zebra 99", "été", "", None, "the"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = ctw.score_texts(docs, spark.createDataFrame([(t,) for t in training], "text string"), ["doc_id"]).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        assert r["score"] == pytest.approx(brute_ctw(training, text), abs=1e-3)


def test_ctw_keeps_every_context_of_a_larger_corpus(spark):
    rng = np.random.default_rng(5)
    training = ["".join(chr(97 + k) for k in rng.integers(0, 12, 3000)) for _ in range(4)]
    texts = [training[0][:60], "zebra 99", training[1][7:40] + "q", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(t,) for t in training], "text string")
    want = [brute_ctw(training, t) for t in texts]
    for hot in (1 << 19, 50):
        got = ctw.score_texts(docs, known, ["doc_id"], hot_grams=hot).orderBy("doc_id").collect()
        for r, w in zip(got, want, strict=True):
            assert r["score"] == pytest.approx(w, abs=1e-3)


def test_base_scores_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows}
    words = {r["doc_id"]: [*re.findall("[^\x20\x09-\x0d]+", lower(r["text"])), None] for r in rows}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, below = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for got in (queries.op6_lm_scoring(spark, SF), ctw.score_texts(docs.withColumn("held_out", queries.part(5, 1)), docs.where(~queries.part(5, 1)), ["doc_id", "held_out"], hot_words=10)):
        for r in got.collect():
            ws = words[r["doc_id"]]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), total)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / below) for w in ws))


def test_trees_beat_the_baseline_on_held_out_texts(spark):
    r = queries.op6_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.avg("bits_per_byte").alias("bits")).first()
    assert r["s"] > r["b"] and r["bits"] < 3.2


def brute_nearest(ids, vectors, k=20):
    out = {}
    for i, q in zip(ids, vectors, strict=True):
        if i % 20 == 0:
            s = vectors @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(ids[j], s[j]) for j in order]
    return out


def test_nearest_neighbours_reach_recall(spark):
    for sf, least in (("/root/testdata/sf0.01", 0.95), ("/root/testdata/sf0.1", 0.9)):
        rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
        ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
        want, got = brute_nearest(ids, vectors), {}
        for r in queries.op8_nearest_neighbours(spark, sf).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert got.keys() == want.keys()
        hits = [len({v for v, _ in want[q]} & {v for v, _ in got[q].values()}) / len(want[q]) for q in want]
        assert np.mean(hits) >= least
        at = {i: v for i, v in zip(ids, vectors, strict=True)}
        for q, found in got.items():
            assert sorted(found) == list(range(1, len(want[q]) + 1))
            assert all(s == pytest.approx(at[q] @ at[v], abs=1e-12) for v, s in found.values())


def test_nearest_neighbours_odd_input(spark):
    odd = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0]), (20, [float("inf"), 0.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in anisotropic.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 7), (0, 2, 8), (0, 3, 1)]
    assert anisotropic.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_exponent(shares, target, most, budget_share=None):
    """The largest exponent whose weights reach the entropy, lifted until no source is repeated too often; by small steps."""
    def weights(a):
        raised = [s**a for s in shares]
        return [x / sum(raised) for x in raised]

    def passes(a):
        ratio = [w / s for w, s in zip(weights(a), shares, strict=True)]
        return max(ratio) * (budget_share if budget_share is not None else 1 / min(ratio))

    steps = [i / 20_000 for i in range(20_001)]
    a = max(x for x in steps if -sum(w * math.log(w) for w in weights(x)) >= target * math.log(len(shares)) - 1e-12)
    a = min((x for x in steps if x >= a and passes(x) <= most + 1e-9), default=1.0)
    return a, weights(a)


def test_mixture_equals_brute_force(spark):
    totals = [("a", 600), ("b", 100), ("c", 50), (None, 10), ("empty", 0)]
    df = spark.createDataFrame(totals, "source string, tokens long")
    shares = [t / 760 for _, t in totals[:4]]
    for target, most, budget in ((0.5, 1e9, None), (0.9, 1e9, None), (0.99, 1e9, None), (0.9, 3.0, None), (1.0, 2.0, None), (0.9, 1e9, 380), (0.99, 1.5, 380)):
        plan = {r["source"]: r for r in mixing.mixture(df, target, most, budget).collect()}
        a, w = brute_exponent(shares, target, most, None if budget is None else budget / 760)
        assert [plan[s]["source_weight"] for s, _ in totals[:4]] == pytest.approx(w, abs=2e-4)
        scale = budget if budget is not None else max(t / x for (_, t), x in zip(totals, w, strict=False))
        assert [plan[s]["budget"] for s, _ in totals[:4]] == pytest.approx([x * scale for x in w], abs=1.2)
        assert plan["empty"]["budget"] == 0 == plan["empty"]["source_weight"]
    assert mixing.mixture(df.where("tokens = 0"), 0.9, 2.0, None).first()["budget"] == 0


def test_schedule_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    for budget in (None, 20_000, 1_500_000):
        got = {(r["doc_id"], r["pass_no"]): r for r in mixing.mix_sources(docs, budget=budget, block_tokens=2_000, max_repeats=9.0).collect()}
        rows = docs.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h")).collect()
        totals = Counter()
        for r in rows:
            totals[r["source"]] += r["n"]
        plan = {r["source"]: r["budget"] for r in mixing.mixture(spark.createDataFrame(list(totals.items()), "source string, tokens long"), 0.97, 9.0, budget).collect()}
        pairs = [(p, b) for p in range(1, 12) for b in range(256)]
        key = {(r["p"], r["b"]): r["o"] for r in spark.createDataFrame(pairs, "p long, b long").withColumn("o", F.xxhash64(F.lit(7), "p", "b")).collect()}
        place = {(r["h"], r["p"]): r["o"] for r in spark.createDataFrame([(r["h"], p) for r in rows for p in range(1, 12)], "h long, p long").withColumn("o", F.xxhash64("p", "h")).collect()}
        want = {}
        for s, total in totals.items():
            blocks = 1 << math.ceil(math.log2(max(1, total / 2_000)))
            left, p = plan[s], 0
            while left > 0:
                p += 1
                order = sorted((key[p, r["h"] % blocks], r["h"] % blocks, place[r["h"], p], r["doc_id"], r["n"]) for r in rows if r["source"] == s)
                for o, _, at, i, n in order:
                    if left > 0:
                        want[i, p] = (o, at, n)
                    left -= n
        assert {k: (r["block_order"], r["place"], r["n_tokens"]) for k, r in got.items()} == want


def test_mixing_uses_every_document_once_or_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    uses = Counter(r["doc_id"] for r in mixing.mix_sources(docs, target_entropy=1.0, block_tokens=5_000).select("doc_id").collect())
    assert uses.keys() == {r["doc_id"] for r in docs.select("doc_id").collect()} and max(uses.values()) == 2


def test_mixing_odd_input(spark):
    rows = [(1, "a b", None), (1, "a b", None), (2, None, "x"), (3, "", "x"), (None, "c d e", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = df.withColumns({c: F.lit("clash") for c in ("place", "own", "of", "h", "n", "blocks", "Whole", "block")})
    again = mixing.mixed_rows(clash)
    assert again.columns == clash.columns and again.where("place = 'clash' and Whole = 'clash'").count() == 5
    got = mixing.mix_sources(clash)
    assert Counter(r["doc_id"] for r in got.collect()).keys() == {1, 2, 3, None}
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram jaccard join", "secret scans", "mixing sources to target weights", "byte-level bpe"]
    kept = stages["quality rules"](spark, docs, sf).cache()
    judged = {r["doc_id"] for r in queries.op1_quality_rules(spark, sf).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == judged and kept.columns == docs.columns
    single = stages["n-gram jaccard join"](spark, kept, sf).cache()
    from test_llm_jaccard import brute

    want = {c for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in kept.collect()]).items()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)
    masked = stages["secret scans"](spark, single, sf).cache()
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in masked.collect():
        if not secrets.base_finds(before[r["doc_id"]]) and r["text"] != before[r["doc_id"]]:
            assert secrets.scan(before[r["doc_id"]])[1]
        assert secrets.base_finds(r["text"]) == [] and r["n_chars"] == len(r["text"])
    mixed = stages["mixing sources to target weights"](spark, masked, sf).cache()
    assert {r["doc_id"] for r in mixed.collect()} == want and mixed.columns == docs.columns
    import public_tokenizers

    last = stages["byte-level bpe"](spark, mixed, sf)
    encoder = bpe.TreeEncoder(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert all(r["round_trip"] and r["ids"] == encoder.encode(texts[r["doc_id"]]).tolist() for r in last.collect())


def test_pipeline_and_queries_on_odd_tables(spark, tmp_path):
    good = "the quick brown fox jumps over a lazy dog while " * 2 + " ".join(f"word{i} tail{i * 7 % 31}" for i in range(60))
    rows = [(1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, None, "en", "s", None), (3, "", None, None, 0), (None, good + " x", None, "s", 5), (4, "a\x00b é " * 900, "fr", None, 9), (5, good + " end", "en", "t", 3)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in got} == {1, None} and all(r["round_trip"] for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    for sf in ("odd", "none"):
        vectors = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, None), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (3, [2.0, 1.0])]
        spark.createDataFrame(vectors if sf == "odd" else [], "vec_id long, embedding array<float>").withColumns({"cell": F.lit(1), "code": F.lit("x")}).write.parquet(f"{tmp_path}/{sf}/embeddings.parquet")
        said = [(1, 0, None, None), (1, 0, "user", "![](a.png)"), (1, 0, "user", "![](a.png)"), (None, None, "assistant", "x"), (2, 1, "assistant", "<\\|" * 900)]
        spark.createDataFrame(said if sf == "odd" else [], "conv_id long, turn long, role string, text string").withColumns({"i": F.lit(1), "own": F.lit("x")}).write.parquet(f"{tmp_path}/{sf}/conversations.parquet")
    for name, query in queries.queries().items():
        none, odd = query(spark, f"{tmp_path}/none").count(), query(spark, f"{tmp_path}/odd").count()
        assert none == (name == "op10_chat_format")
        assert odd == {"op8_nearest_neighbours": 1, "op10_chat_format": 4}.get(name, len(rows)) or (name == "op2_mixing" and odd >= len(rows))


def test_pipeline_with_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())
    clash = docs.withColumns({c: F.lit("7") for c in ("g", "kept", "h", "set_a", "_hit", "place", "own", "n_words", "__text", "block")})
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
    step = clash
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == clash.columns
