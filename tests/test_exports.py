"""Positional exports, asserting plans, numbered lines and archives: round trips."""

import bz2
import io
import random
import tarfile
import zipfile

import pytest
from caseload.operators import export as X
from caseload.sources import archives as A
from caseload.sources import lines as L
from pyspark.sql import functions as F


def test_shards_decode_to_the_rows(spark):
    draw = random.Random(4)
    data = [(i, draw.choice(["x", "y", None, "z"]), draw.random() if i % 7 else None) for i in range(500)]
    rows = spark.createDataFrame(data, "k long, family string, p double").repartition(5)
    placed = X.positions(rows, ["k"])
    codes = X.first_seen(placed, "family")
    order = list(dict.fromkeys(f for _, f, _ in data))
    assert {r["family"]: r["code"] for r in codes.collect()} == {f: i for i, f in enumerate(order)}
    shards = X.sharded(X.encoded(placed, "family", codes, "f"), "pos", ["k", "f", "p"], 64)
    assert [r["n"] for r in shards.orderBy("shard").collect()] == [64] * 7 + [52]
    back = X.decoded(shards, ["k", "f", "p"], 64).orderBy("pos").collect()
    assert [(r["pos"], r["k"], order[r["f"]], r["p"]) for r in back] == [(i, k, f, p) for i, (k, f, p) in enumerate(data)]


def test_rows_come_only_if_tables_agree(spark):
    rows = spark.range(5)
    own = spark.createDataFrame([("a", None, 1.0), ("b", 1, 2.0), ("c", 2, None)], "m string, q int, v double")
    assert X.only_if_same(rows, own, own.repartition(3), ["m", "q"], ["v"]).count() == 5
    off = own.withColumn("v", F.when(F.col("m") == "b", 2.5).otherwise(F.col("v"))).where("m != 'c'")
    with pytest.raises(Exception, match=r"2 rows differ.*\"m\":\"b\".*2\.0.*2\.5.*\"m\":\"c\""):
        X.only_if_same(rows, own, off, ["m", "q"], ["v"]).collect()
    with pytest.raises(Exception, match="1 rows differ"):
        X.only_if_same(rows, own.where("m = 'a'"), own.where("m != 'c'"), ["m", "q"], ["v"]).write.format("noop").mode("overwrite").save()


@pytest.fixture
def text_files(tmp_path):
    draw = random.Random(6)
    lines = [",".join(str(draw.random()) for _ in range(draw.randrange(1, 9))) for _ in range(700)]
    for k, part in enumerate((lines[:300], lines[300:301], lines[301:])):
        (tmp_path / f"part-{k}.csv").write_text("".join(x + ("\r\n" if k else "\n") for x in part))
    return str(tmp_path), lines


@pytest.mark.parametrize("split", ["256", "3k", "128m"])
def test_lines_are_numbered_alike_at_any_split(spark, text_files, split):
    path, lines = text_files
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = L.numbered_lines(spark, path)
        assert [(r["number"], r["line"]) for r in got.orderBy("number").collect()] == list(enumerate(lines))
        windows = L.row_windows(got, rows=14, windows=20).orderBy("first_row").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(windows) == 20 and len({w["first_row"] for w in windows}) == 20
    for w in windows:
        assert w["last_row"] == w["first_row"] + 13
        assert w["text"] == "\n".join([lines[0], *lines[w["first_row"] : w["last_row"] + 1]])


def test_sections(spark):
    lines = ["license", "*** START OF IT ***", "preface", "", "No. 1", "a", "b", "", "No. 2", "", "*** END OF IT", "No. 3"]
    df = spark.createDataFrame(list(enumerate(lines)), "number long, line string").repartition(3)
    got = L.sections(df, r"^No\. \d+$", r"^\*\*\* START", r"^\*\*\* END").orderBy("section").collect()
    assert [(r["heading"], r["text"], r["n_lines"]) for r in got] == [(None, "preface", 2), ("No. 1", "a\nb", 3), ("No. 2", "", 1)]
    assert L.sections(df, "^No").count() == 4


def test_archives_round_trip(spark, tmp_path):
    texts = {f"d{i}": f"text of {i} é\n" * i for i in range(30)}
    with tarfile.open(tmp_path / "a.tar.bz2", "w:bz2") as t:
        for name, text in [*list(texts.items())[:20], ("note", "x")]:
            data = text.encode()
            info = tarfile.TarInfo(f"deep/{name}" + (".md" if name == "note" else ".txt"))
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in list(texts.items())[20:]:
            z.writestr(f"x/{name}.txt", text)
    rows = A.read_archives(spark, str(tmp_path))
    assert {r["doc_id"]: r["text"] for r in rows.collect()} == texts and rows.rdd.getNumPartitions() == 2
    some = A.read_archives(spark, str(tmp_path), ["d3", "d25", "none"])
    assert {r["doc_id"]: r["archive"] for r in some.collect()} == {"d3": "a.tar.bz2", "d25": "b.zip"}


def test_only_wanted_members_are_decoded(tmp_path):
    data = random.Random(1).randbytes(1 << 20)
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for name in ("w1", "other", "w2", "late"):
            info = tarfile.TarInfo(f"{name}.txt")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    packed = bz2.compress((tmp_path / "a.tar").read_bytes())
    (tmp_path / "cut.tar.bz2").write_bytes(packed[: int(len(packed) * 0.93)])  # the last member is broken off
    assert [k for k, _ in A.members(str(tmp_path / "cut.tar.bz2"), ".txt", {"w1", "w2"})] == ["w1", "w2"]
    with pytest.raises((EOFError, tarfile.ReadError)):
        list(A.members(str(tmp_path / "cut.tar.bz2"), ".txt", {"w1", "late"}))
    reader = A.ArchiveReader({"path": str(tmp_path / "a.tar")})
    list(reader.pushFilters([A.In(("doc_id",), ("w1", "w2")), A.EqualTo(("doc_id",), "w2"), A.EqualTo(("text",), "x")]))
    assert reader.wanted == {"w2"}
