"""Runs of words travel as keys of fixed size, and each once."""

from caseload.operators import corpus as C
from caseload.plans import catalog, registry  # noqa: F401
from pyspark.sql import functions as F


def exchanged(df):
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("\n") if "Exchange hashpartitioning" in line]


def test_recurrence_sends_each_run_once(spark):
    same = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, same), (2, same + " m"), (3, "x " + same), (4, "a b c d e f g h"), (5, "q r s t u v w x"), (6, None)], "doc_id long, text string")
    got = C.recurrence(docs)
    rows = {r["doc_id"]: (r["n_shared"], r["longest"]) for r in got.collect()}
    assert rows == {1: (5, 12), 2: (5, 12), 3: (5, 12), 4: (1, 8), 5: (0, 0), 6: (0, 0)}
    assert sum("hashpartitioning(gram" in line for line in exchanged(got)) == 0 and sum("h1" in line for line in exchanged(got)) == 1


def test_frequencies_by_key(spark):
    docs = spark.createDataFrame([(1, "a b c d a b c"), (2, "b c d"), (3, None)], "doc_id long, text string")
    got = C.key_frequency(docs, 3)
    assert sorted(r["df"] for r in got.collect()) == [1, 1, 1, 2]  # abc, cda, dab; bcd
    assert not any("hashpartitioning(gram" in line for line in exchanged(got))
    assert got.groupBy("df").agg(F.count("*").alias("n")).count() == 2


def test_unknown_words_need_no_join(spark, tmp_path):
    rows = [(1, "a b c", "s"), (2, "A b", "s"), (3, "a x", "s"), (4, "b", "t"), (4, "b y y", "t"), (None, "x z", None), (None, "z q", None), (5, None, "s"), (6, "--", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["txt32_unknown_words"](spark, str(tmp_path))
    # only "a" stands in three documents of one source
    assert {r["doc_id"]: (r["n_words"], r["n_unknown"]) for r in got.collect()} == {1: (3, 2), 2: (2, 1), 3: (2, 1), 4: (3, 3), None: (4, 4)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
