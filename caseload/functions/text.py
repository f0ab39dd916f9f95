"""Text expressions: tokens, lexical scores, replies, excerpts and line-level boilerplate rules, all as columns.

Functions that need offsets or alignment (longest common subsequence, segments) are pandas UDFs at the end.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no topic.
STOP_WORDS = ["about", "after", "also", "been", "document", "documents", "from", "have", "into", "that", "their", "there", "these", "this", "which", "will", "with"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct content terms of a request."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9\-]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def lexical_score(asked: Column, text: Column) -> Column:
    """A keyword scorer: saturating in the hits and in the share of the asked terms that occur."""
    hits = F.size(F.array_intersect(asked, F.array_distinct(tokens(text)))).cast("double")
    share = hits / F.greatest(F.size(asked), F.lit(1))
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), 1 - F.exp(-(hits / 4 + 2 * share))))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once (a column named inside a lambda is computed for each element)."""
    return F.get(F.transform(F.array(value), body), 0)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, as texts; none in a shorter text."""
    places = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return let(words, lambda w: F.transform(places(w), lambda i: F.array_join(F.slice(w, i, n), " ")))


def refusal(reply: Column) -> Column:
    """kind of refusal at a reply's start: policy, unable, unknown, or null. Only the first 30 words count."""
    head = F.array_join(F.slice(F.split(F.lower(F.trim(reply)), r"\s+"), 1, 30), " ")
    start = head.rlike(r"^(i('m| am)? (sorry|unable|not able)|i can(no|')t|i won't|sorry|unfortunately)")
    return (
        F.when(start & head.rlike(r"(copyright|policy|verbatim|reproduce)"), "policy")
        .when(start & head.rlike(r"(access|unable|able to|can'?t|cannot)"), "unable")
        .when(head.rlike(r"^(i )?(do not|don't) (know|recall|have)"), "unknown")
    )


def yes_no(reply: Column) -> Column:
    """1, 0 or null from a free reply."""
    t = F.lower(F.trim(reply))
    return F.when(t.rlike(r"^\W*yes\b"), 1).when(t.rlike(r"^\W*no\b"), 0)


def relevance(reply: Column) -> Column:
    t = F.lower(reply)
    return F.when(t.rlike(r"not[ -]?(relevant|responsive)|irrelevant|non-?responsive"), 0).when(t.rlike(r"relevant|responsive"), 1)


def json_reply(reply: Column, schema: str) -> Column:
    """The object in a reply, fenced or bare, read by ``schema``; null if there is none."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema)


def groups_found(text: Column, groups: list[list[str]]) -> Column:
    """Share of keyword groups of which any word occurs."""
    low = F.lower(text)
    hit = [F.greatest(*[F.contains(low, F.lit(w)).cast("int") for w in g], F.lit(0)) for g in groups]
    return sum(hit[1:], hit[0]) / len(groups)


def phrase_hit(text: Column, phrase: str) -> Column:
    """Whether a phrase stands as whole words."""
    inner = r"[^a-z0-9]+".join(re.escape(w) for w in re.findall("[a-z0-9]+", phrase.lower()))
    return F.lower(text).rlike(f"(^|[^a-z0-9]){inner}($|[^a-z0-9])")


def body_key(text: Column) -> Column:
    """A key of the words alone."""
    return F.md5(F.array_join(tokens(text), " ").cast("binary"))


def window_key(prefix: Column, target: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", prefix, target).cast("binary"))


def without_headers(text: Column) -> Column:
    """Lines of a production's own header fields removed."""
    return F.regexp_replace(text, r"(?m)^X-[A-Za-z-]+:.*\n?", "")


def tidy(text: Column) -> Column:
    """Line ends unified, runs of three or more cut to two."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n")


def plain_markdown(text: Column) -> Column:
    """Markdown fences, emphasis and headings removed."""
    t = F.regexp_replace(text, r"(?m)^```.*\n?", "")
    t = F.regexp_replace(t, r"(\*\*|__)(.+?)(\*\*|__)", "$2")
    return F.trim(F.regexp_replace(t, r"(?m)^#{1,6}\s+", ""))


def swapped(text: Column, old: str, new: str) -> Column:
    """A word replaced as a whole word, in the case shape it stands in: capital, lower, upper."""
    t = F.regexp_replace(text, rf"\b{re.escape(old.upper())}\b", new.upper())
    t = F.regexp_replace(t, rf"\b{re.escape(old.capitalize())}\b", new.capitalize())
    return F.regexp_replace(t, rf"\b{re.escape(old.lower())}\b", new.lower())


def count_hits(text: Column, words: list[str]) -> Column:
    """How often any of the words stands as a whole word."""
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(map(re.escape, words)) + r")\b"), F.lit(0)))


def edited(text: Column, edits: Column) -> Column:
    """Ordered replacements (array of struct old, new), and the first that found nothing."""
    start = F.struct(text.alias("text"), F.lit(None).cast("string").alias("missing"))
    step = lambda acc, e: F.struct(F.replace(acc["text"], e["old"], e["new"]).alias("text"), F.coalesce(acc["missing"], F.when(~F.contains(acc["text"], e["old"]), e["old"])).alias("missing"))
    return F.aggregate(edits, start, step)


def numbers(text: Column) -> Column:
    """A text's numbers, sorted, with repeats."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0)))


def faithful(old: Column, new: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """Whether a paraphrase keeps all numbers, as often as they stood, and a similar length."""
    ratio = F.length(new) / F.greatest(F.length(old), F.lit(1))
    return (numbers(old) == numbers(new)) & ratio.between(low, high)


def lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)


def boilerplate_rules(text: Column) -> Column:
    """The names of the rules that a text meets, in order; empty for none.

    disclaimer: one strong phrase or four weak ones. list_footer, quoted_header, scan_notice: a phrase. repetitive: few
    distinct trigrams. key_values and tabular: most lines are of that form. thin: hardly any words.
    """
    made = F.struct(F.lower(text).alias("low"), tokens(text).alias("w"), lines(text).alias("rows"))
    return let(made, lambda x: _rules_met(x["low"], x["w"], x["rows"]))


def repetitive(w: Column, least: int = 20, share: float = 0.6) -> Column:
    """Whether a text's words ``w`` have ``least`` or more trigrams, and of those fewer than ``share`` are distinct.

    Clashes only lower the number of distinct hashes, so trigrams are written out only where even that number is small.
    """
    n = F.size(w) - 2
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    few = lambda grams: F.size(F.array_distinct(grams)) < share * n
    return F.when(n >= least, F.when(few(hashes), few(ngrams(w, 3))).otherwise(False)).otherwise(False)


def _rules_met(low: Column, w: Column, rows: Column) -> Column:
    has = lambda *phrases: reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in phrases])
    n_lines = F.greatest(F.size(rows), F.lit(1))
    weak = ["confidential", "intended recipient", "privileged", "unauthorized", "delete", "notify the sender", "disclosure"]
    weak_hits = sum((F.contains(low, F.lit(p)).cast("int") for p in weak[1:]), F.contains(low, F.lit(weak[0])).cast("int"))
    share = lambda pattern: F.size(F.filter(rows, lambda x: x.rlike(pattern))) / n_lines
    rules = {
        "disclaimer": has("all rights reserved") | (weak_hits >= 4),
        "list_footer": has("unsubscribe", "mailing list"),
        "quoted_header": has("-----original message-----", "forwarded by"),
        "scan_notice": has("scanned by", "scanned for", "virus-free"),
        "repetitive": repetitive(w),
        "key_values": (F.size(rows) >= 3) & (share(r"^\s*[A-Za-z ]{1,30}:\s") >= 0.6),
        "tabular": (F.size(rows) >= 2) & (share(r"\s\|\s.*\s\|\s") >= 0.5),
        "thin": F.size(w) < 8,
    }
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))


def longest_common_subsequence(a: list[str], b: list[str]) -> int:
    """Bit-parallel: one machine word operation for each element of ``a`` on a number with a bit for each of ``b``."""
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        m = at.get(x, 0)
        row = ((row + (row & m)) | (row & ~m)) & full
    return len(b) - row.bit_count()


def longest_common_run(a: list[str], b: list[str]) -> int:
    best, before = 0, {}
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    for x in a:
        now = {j: before.get(j - 1, 0) + 1 for j in where.get(x, ())}
        best = max([best, *now.values()])
        before = now
    return best


@F.pandas_udf(T.StructType([T.StructField("lcs", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("f", T.DoubleType())]))
def overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Longest common subsequence and run of two word arrays, and the subsequence's F measure."""
    rows = []
    for x, y in zip(a, b, strict=True):
        x, y = list(x if x is not None else []), list(y if y is not None else [])
        lcs = longest_common_subsequence(x, y)
        rows.append((lcs, longest_common_run(x, y), 2 * lcs / (len(x) + len(y)) if x or y else 0.0))
    return pd.DataFrame(rows, columns=["lcs", "run", "f"])


def cut_segments(text: str, shortest: int = 80, longest: int = 1200) -> list[tuple[int, int]]:
    """Paragraph spans: blank lines part them, short ones join the next, long ones are cut after a sentence."""
    spans, start = [], 0
    for m in [*re.finditer(r"\n\s*\n", text), None]:
        stop = m.start() if m else len(text)
        if stop - start >= shortest or m is None:
            while stop - start > longest:
                ends = [e.end() for e in re.finditer(r"[.;:]\s", text[start : start + longest]) if e.end() > 0.4 * longest]
                cut = start + (ends[-1] if ends else longest)
                spans.append((start, cut))
                start = cut
            if text[start:stop].strip():
                spans.append((start, stop))
            start = m.end() if m else stop
    return spans


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
def segments(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "stop": b} for a, b in cut_segments(t or "")])


def names_in(field: str) -> list[str]:
    """Names of an address field: quotes and angles respected, surnames turned to the end."""
    parts, depth, quoted, now = [], 0, False, ""
    for c in field or "":
        if c == '"':
            quoted = not quoted
        elif c in "<(":
            depth += 1
        elif c in ">)":
            depth = max(0, depth - 1)
        elif c in ",;" and not quoted and not depth and not (c == "," and "@" not in now and " " not in now.strip()):
            parts.append(now)
            now = ""
            continue
        now += c
    out = []
    for p in [*parts, now]:
        name = re.sub(r"<.*?>|\(.*?\)|\S+@\S+|[\"']", " ", p).strip()
        if "," in name:
            last, first = name.split(",", 1)
            name = f"{first.strip()} {last.strip()}"
        name = " ".join(w.capitalize() for w in name.split())
        if re.fullmatch(r"[A-Za-z.\- ]{3,60}", name):
            out.append(name)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def address_names(field: pd.Series) -> pd.Series:
    return field.map(names_in)


def renamer(mapping: dict[str, str]):
    """A pandas UDF that replaces names by a mapping: longest first, whole words, keeping the case shape."""
    pattern = re.compile(r"\b(" + "|".join(re.escape(k) for k in sorted(mapping, key=len, reverse=True)) + r")\b", re.IGNORECASE) if mapping else None
    low = {k.lower(): v for k, v in mapping.items()}

    def put(m: re.Match) -> str:
        old, new = m[0], low[m[0].lower()]
        return new.upper() if old.isupper() else new.lower() if old.islower() else new

    @F.pandas_udf(T.StringType())
    def rename(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None or pattern is None else pattern.sub(put, t))

    return rename
