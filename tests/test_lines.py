"""Row windows send no lines to every task, whatever the planner takes for small."""

from caseload.sources import lines as L


def test_row_windows_broadcast_starts_only(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(3001).selectExpr("concat(id, ',x') AS value").coalesce(1).write.text(path)
    got = L.row_windows(L.numbered_lines(spark, path), rows=5, windows=7)
    for r in got.collect():
        assert r["text"].split("\n") == ["0,x"] + [f"{k},x" for k in range(r["first_row"], r["last_row"] + 1)] and r["last_row"] - r["first_row"] == 4
    assert got.count() == 7
    assert "BuildLeft" not in got._jdf.queryExecution().executedPlan().toString()
