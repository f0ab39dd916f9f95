"""Files of lines with global line numbers, whatever the splits, and what is cut from them: row windows and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.operators import order as O
from caseload.session import stored


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, line): lines from 0, by file name and place in the file, as if all were read by one task.

    Each split's lines are counted; a split's first number is the count of all splits before it.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"))
    held = stored(lines)
    splits = held.groupBy("file", "start").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bare = F.regexp_replace("value", "\r$", "")
    return held.join(F.broadcast(splits), ["file", "start"]).select((F.col("before") + F.col("seq") - F.col("first")).alias("number"), bare.alias("line"))


def row_windows(lines: DataFrame, rows: int = 14, windows: int = 20, salt: str = "rows") -> DataFrame:
    """(first_row, last_row, text): windows of consecutive rows below a header line, each begun by the header; rows from 1.

    Starts are those with the lowest hashes; windows may overlap. Each window names its rows (``windows`` x ``rows`` in all),
    which go to every task, so no line is sent to find its windows. A window that would need the last row isn't drawn.
    """
    body = lines.where("number > 0").select((F.col("number") - 1).alias("i"), "line")
    header = lines.where("number = 0").select(F.col("line").alias("header"))
    n = body.count()
    starts = O.lowest(body.where(F.col("i") < n - rows).select("i"), S.uniform(salt, F.col("i")), "i", windows).select(F.col("i").alias("start"))
    named = starts.withColumn("i", F.explode(F.sequence(F.col("start"), F.col("start") + (rows - 1))))
    held = body.join(F.broadcast(named), "i").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("r"))  # ``rows`` to a group
    text = F.concat_ws("\n", "header", F.array_join(F.transform("r", lambda r: r["line"]), "\n"))
    return held.crossJoin(F.broadcast(header)).select((F.col("start") + 1).alias("first_row"), (F.col("start") + rows).alias("last_row"), text.alias("text"))  # one header


def sections(lines: DataFrame, heading: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """(section, heading, n_lines, text): lines between headings (a pattern), white space at both ends removed; section 0 is what
    comes before the first heading. ``begin`` and ``end`` are patterns of the lines between which the work itself lies."""
    found = lines.agg(F.min(F.when(F.col("line").rlike(begin), F.col("number")) if begin else F.lit(None)).alias("a"), F.min(F.when(F.col("line").rlike(end), F.col("number")) if end else F.lit(None)).alias("b")).first()
    own = lines.where(F.col("number") > (-1 if found["a"] is None else found["a"]))
    own = own if found["b"] is None else own.where(F.col("number") < found["b"])
    is_head = F.col("line").rlike(heading)
    placed = O.running(own, [], ["number"], {"section": is_head.cast("long")})
    entry = F.struct("number", "line")
    got = placed.groupBy("section").agg(F.max(F.when(is_head, F.col("line"))).alias("heading"), F.array_sort(F.collect_list(F.when(~is_head, entry))).alias("r"))  # a section's lines
    text = F.regexp_replace(F.array_join(F.transform("r", lambda r: r["line"]), "\n"), r"^\s+|\s+$", "")
    return got.select("section", "heading", F.size("r").cast("long").alias("n_lines"), text.alias("text"))
