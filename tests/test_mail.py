"""Header blocks: both layouts, wrapped lines, repeated and foreign fields."""

import pytest
from caseload.functions import mail as M
from pyspark.sql import functions as F

PLAIN = "From: Ann Lee\nSent: 1 May\n  2001\nTo: a@x; b@x;\n\tc@x\nX-SDOC: 77\nnot of a field\nSubject: RE: Pipe\n line\nTo: d@x\n\nBody From: nobody"
SCANNED = "From:\nTo:\nSent:\nSubject:\n\nAnn Lee\n\n"
CASES = {
    "plain": (PLAIN, ("1 May 2001", "Ann Lee", "a@x; b@x; c@x d@x", None, "RE: Pipe line")),
    "returns": (PLAIN.replace("\n", "\r\n"), ("1 May 2001", "Ann Lee", "a@x; b@x; c@x d@x", None, "RE: Pipe line")),
    "scanned": ("From:\nTo:\nSent:\nSubject:\n\nAnn Lee\n  bob@x \n3 May\nSome   topic\n\nbody", ("3 May", "Ann Lee", "bob@x", None, "Some topic")),
    "scanned, values missing": (SCANNED, None),
    "entities": ("From: A &lt;a@x&gt; &amp;lt;\nSubject: q&quot;q&#39;", (None, "A <a@x> &lt;", None, None, "q\"q'")),
    "no sender": ("Subject: abc\n\nFrom: x", None),
    "short subject": ("From: a\nSubject: FW: re: ab", None),
    "no header": ("just text", None),
    "empty": ("", None),
    "null": (None, None),
    "copies": ("CC: c@x\nBCC: d@x\nFrom: a\nSubject: abc\nImportance: high", (None, "a", None, "c@x", "abc")),
}


def test_headers(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "k string, text string")
    got = {r["k"]: r["h"] for r in docs.select("k", M.parsed_header(F.col("text")).alias("h")).collect()}
    for k, (_, want) in CASES.items():
        assert (tuple(got[k]) if got[k] else None) == want, k


def test_headers_need_no_python(spark):
    plan = spark.createDataFrame([("a",)], "text string").select(M.parsed_header(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("Scan ExistingRDD", "") and "ArrowEval" not in plan


@pytest.mark.parametrize(("value", "want"), [("a, b ,, c", "a; b; c"), ("a, x; b", "a, x; b"), ("1;2;3;4;5;6;7;8", "1; 2; 3; 4; 5; 6 (+2 more)"), ("", "")])
def test_trimmed_addresses(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(M.trimmed_addresses(F.col("v"))).first()[0] == want


def test_written_again(spark):
    docs = spark.createDataFrame([(PLAIN,), ("nothing",)], "text string").withColumn("h", M.parsed_header(F.col("text")))
    rows = docs.select(M.header_block(F.col("h"), True).alias("a"), M.header_block(F.col("h"), False).alias("b")).collect()
    assert rows[0]["a"] == "Date: 1 May 2001\nFrom: Ann Lee\nTo: a@x; b@x; c@x d@x\nSubject: RE: Pipe line"
    assert rows[0]["b"] == "Date: 1 May 2001\nSubject: RE: Pipe line" and rows[1]["a"] is None


def test_near_keys(spark):
    rows = [("Re: Big  News", "From: a b\nTo: c@x\nhello\n there"), ("big news", "From: someone else\nTo: c@x hello there"), ("fw: re: x", "subject: only this"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, x string").select(M.near_key(F.col("t"), F.col("x"))).collect()]
    assert got == ["big news| to: c@x hello there", "big news| to: c@x hello there", "re: x|", "|"]


@pytest.mark.parametrize(("number", "want"), [("ABC-0012345", "ABC"), (" AB_CD_00012345", "AB_CD"), ("AB12345678", "AB"), ("X9-77-1", "X9"), ("AB_-1", "AB"), ("", None), (None, None)])
def test_production_prefixes(spark, number, want):
    assert spark.createDataFrame([(number,)], "n string").select(M.production_prefix(F.col("n"))).first()[0] == want


@pytest.mark.parametrize("name", ["txt41_headers", "txt42_header_blocks"])
def test_made_messages_equal_their_sql_for_odd_texts(spark, tmp_path, name):
    import duckdb
    from caseload.plans import catalog, registry  # noqa: F401

    texts = [("É.", 2), ("12 34", 5), ("", 0), ("A.", 2), ("ab", 2), ("Von der\n\nSee", 12), ("No size here", None), ("É", None), (None, 4)]
    rows = [(45 * i + j, t, "fr", "src1", n) for i, (t, n) in enumerate(texts) for j in range(45)]  # each text in each layout
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in c.description]
    order = lambda data: sorted(data, key=str)
    assert order(c.fetchall()) == order(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select(*columns).collect())
