"""Steps that are costly for a row are done once a row, and long rows aren't sent for joins."""

import re

from caseload.functions import boilerplate as B
from caseload.functions import text as T
from caseload.plans import catalog, registry  # noqa: F401
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pool_cuts_windows_once(spark):
    assert "regexp" not in plan(registry.queries()["smp28_window_pool"](spark, SF)).lower()


def test_run_counts_are_sent_as_keys(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i" if i < 3 else "b c d e f g h i j") for i in range(5)] + [(9, None)], "doc_id long, text string")
    windows = spark.createDataFrame([(1, "x a b c d e f g h", "b c d e f g h i j k"), (2, "short", None)], "w long, prefix string, target string")
    held = B.with_run_counts(windows, docs, ["w"])
    # "x a .. g" and "d .. k" stand in no document, and are left out
    assert {r["w"]: (r["after"], r["before"]) for r in held.collect()} == {1: ([5, 2], [3]), 2: ([], [])}
    assert "LeftSemi" not in plan(held) and "xxhash64" in plan(held)


def test_guarded_phrases_find_what_plain_ones_find(spark):
    for phrases in (v for k, v in vars(B).items() if isinstance(v, list) and k not in ("REASONS", "LIST_WORDS")):
        plain = re.compile("(?i)(" + "|".join(re.sub(" ", r"\\s+", p) for p in phrases) + ")", re.ASCII)
        said = [re.sub(r"\([^()]*\)\?|\[(.)[^]]*\]\??|(\w)\?|\\\S+|\{.*?\}", lambda m: m[1] or m[2] or "", p) for p in phrases]
        guarded = re.compile(B.any_phrase(phrases), re.ASCII)
        for t in [x + y + z for x in ("", "so I ", "x") for y in [*said, *(p.upper() for p in said), *phrases, "if you", "copyright 2001", "--- original"] for z in ("", " of all")]:
            assert bool(plain.search(t)) == bool(guarded.search(t)), t


def test_boilerplate_rules_cut_words_once(spark):
    words = [f"w{i}" for i in range(12)]
    texts = [None, "", "a b", " ".join(words), " ".join(words[:11] * 2), " ".join(words[:10] + words[:9] + words[:2]), " ".join(words[:10] * 2 + ["x", "y"]), " ".join(words * 2) + " -----Original Message----- Scanned for", "a | b | c\nd | e\nf |g |h"]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.boilerplate_rules(F.col("text")).alias("rules"))
    assert plan(got).count("regexp_extract_all") == 1
    for r in got.collect():
        w = re.findall("[a-z0-9]+", (texts[r["id"]] or "").lower())
        grams = list(zip(w, w[1:], w[2:], strict=False))
        assert ("repetitive" in r["rules"]) == (len(grams) >= 20 and len(set(grams)) < 0.6 * len(grams)), w
    rules = {r["id"]: r["rules"] for r in got.collect()}
    assert "quoted_header" in rules[7] and "scan_notice" in rules[7] and "tabular" not in rules[8] and "repetitive" in rules[4]
