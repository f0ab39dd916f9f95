"""Windows of documents for completion tests: where a text is handed off, what follows, and pools that pass filters.

Rejection sampling without a loop: every document's windows, at all hand-off points, are judged at once; a document keeps
its first that passes; and hashes order the documents, of which each corpus takes as many as it still needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.functions.text import let
from caseload.operators import order as O

#: Hand-off points in the order in which they are tried, and least sizes of a window.
CUTS = (0.45, 0.6, 0.3, 0.75)
LEAST_CHARS, LEAST_WORDS, TARGET_WORDS = 700, 160, 60
SHORTEST_CUT, CUT_FROM, CUT_TO = 200, 250, 1200
#: A word, a header's field, and what begins a quoted or forwarded message.
WORD = r"[A-Za-z0-9][A-Za-z0-9'\-.]*"
TARGET = r"^(?:[^A-Za-z0-9]*+[A-Za-z0-9][A-Za-z0-9'\-.]*+){%d}"
HEADER = r"(?m)^(From|To|Sent|Date|Cc|Subject)\s*:"
QUOTED = r"(?m)^(\s*-{3,}\s*(Original Message|Forwarded|Original Appointment)|\s*(From|Sent|To|Subject):\s|_{5,}|>|On .{5,120} wrote:|\s*-{5,}\s*$|\s*\*{5,})"


def parts(text: Column) -> Column:
    """struct(head, body): a header block, or text that begins with a bracket, is split off at the first blank line."""

    def split(p: Column) -> Column:
        head = F.get(p, 0)
        has = (F.size(p) > 1) & (head.rlike(HEADER) | head.startswith("["))
        bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
        return F.struct(F.when(has, bare(head)).otherwise("").alias("head"), F.when(has, bare(F.get(p, 1))).otherwise(bare(text)).alias("body"))

    return let(F.split(text, "\n\n", 2), split)


def own_part(body: Column) -> Column:
    """A body up to the first quoted or forwarded message."""
    return F.regexp_replace(F.get(F.split(body, QUOTED, 2), 0), r"\s+$", "")


def window_at(region: Column, share: float) -> Column:
    """struct(prefix, target) at about this share of a region, between 250 and 1200 characters in, at a blank; else null."""
    near = F.least(F.greatest(F.floor(F.length(region) * F.lit(share)), F.lit(CUT_FROM)), F.lit(CUT_TO)).cast("int")

    def at(cut: Column) -> Column:
        prefix = F.regexp_replace(F.substring(region, F.lit(1), cut), r"\s+$", "")
        rest = F.regexp_replace(F.substring(region, cut + 1, F.length(region)), r"^\s+", "")
        held = let(F.regexp_extract(rest, TARGET % TARGET_WORDS, 0), lambda target: F.when(target != "", F.struct(prefix.alias("prefix"), target.alias("target"))))
        return F.when(cut >= SHORTEST_CUT, held)

    blank = F.length(F.regexp_extract(F.substring(region, F.lit(1), near), r"(?s)^.* ", 0)) - 1
    return let(blank, at)


def windows(docs: DataFrame, corpus: str) -> DataFrame:
    """(corpus, doc_id, place, cut, head, prefix, target): a row for each hand-off point of each document that allows one.

    A document needs 700 characters and 160 words of its own, and 60 words after the cut. Null texts have none; of rows that
    share an id the one with the smallest text counts.
    """
    one = docs.groupBy("doc_id").agg(F.min(F.struct(F.coalesce(F.col(corpus).cast("string"), F.lit("")).alias("corpus"), "text")).alias("d")).select("doc_id", "d.corpus", "d.text")
    each = lambda region: F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("cut"), window_at(region, c).alias("w")) for i, c in enumerate(CUTS)])
    enough = lambda region: (F.length(region) >= LEAST_CHARS) & (F.regexp_count(region, F.lit(WORD)) >= LEAST_WORDS)
    cut = lambda p: let(own_part(p["body"]), lambda region: F.when(enough(region), F.struct(p["head"].alias("head"), each(region).alias("each"))))
    held = one.where(F.col("text").isNotNull()).select("corpus", "doc_id", F.explode(F.array(let(parts(F.col("text")), cut))).alias("h"))  # each part is made once
    rows = held.where("h is not null").select("corpus", "doc_id", "h.head", F.explode("h.each").alias("e"))
    return rows.where("e.w is not null").select("corpus", "doc_id", "e.place", "e.cut", "head", "e.w.prefix", "e.w.target")


def pool(found: DataFrame, existing: DataFrame, passes: Column, n: int, salt: str = "windows") -> DataFrame:
    """(corpus, doc_id, cut, replacement, passed): existing windows (corpus, doc_id, cut), which all stay, and replacements, so
    that each corpus has ``n`` that pass, if there are so many.

    ``found``: ``windows``, read several times, so stored with what ``passes``, the filter, needs. A replacement is a document without an existing window,
    at its first hand-off point that passes; documents are taken in hash order.
    """
    judged = found.withColumn("passed", F.coalesce(passes, F.lit(False)))
    kept = existing.join(judged.select("corpus", "doc_id", "cut", "passed"), ["corpus", "doc_id", "cut"], "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    first = judged.where("passed").join(existing.select("doc_id"), "doc_id", "left_anti").groupBy("corpus", "doc_id").agg(F.min_by("cut", "place").alias("cut"))
    have = kept.groupBy("corpus").agg(F.count_if("passed").alias("have"))
    wants = first.select("corpus").distinct().join(have, "corpus", "left").select("corpus", F.greatest(F.lit(n) - F.coalesce("have", F.lit(0)), F.lit(0)).alias("want"))
    drawn = O.lowest_by_group(first, "corpus", S.uniform(salt, F.col("doc_id")), "doc_id", wants)
    return kept.select("corpus", "doc_id", "cut", F.lit(0).alias("replacement"), "passed").unionByName(drawn.select("corpus", "doc_id", "cut", F.lit(1).alias("replacement"), F.lit(True).alias("passed")))
