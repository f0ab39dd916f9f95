"""Header blocks of messages, also scanned ones, as column expressions.

A header is read line by line by a fold that holds the field it is in. Two layouts occur: fields with their values on the
same line, going on over further lines; and, in scanned mail, the names of all fields first, each on a line of its own,
then a blank line and the values in the same order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseload.functions.text import let

#: Fields that are read, other names for them, and entities that are written out.
FIELD_LINE = r"^(From|Sent|Date|To|Cc|CC|Bcc|BCC|Subject|Attach(?:ments?)?|Importance)\s*:\s*(.*)$"
OTHER_FIELD = r"^[A-Za-z][A-Za-z0-9-]{0,24}\s*:"
SAME_FIELD = {"sent": "date"}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
ANSWER_PREFIX = r"(?i)^\s*((re|fw|fwd|aw|tr)\s*:\s*)+"
FIELDS = ("date", "from", "to", "cc", "subject")
SHORTEST_SUBJECT = 3


def plain_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def folded_lines(block: Column) -> Column:
    """struct(at, names, values) of a header block's lines: fields in the order of their first line, values joined by blanks.

    A known field's line opens it, again if it occurred before; any other field's line closes the one before; other lines
    belong to the open field.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("values"))

    def state(at: Column, names: Column, values: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), names.alias("names"), values.alias("values"))

    def joined(values: Column, at: Column, more: Column) -> Column:
        return F.transform(values, lambda v, i: F.when(i + 1 == at, F.trim(F.concat(v, F.lit(" "), more))).otherwise(v))

    def step(s: Column, line: Column) -> Column:
        bare = stripped(line)
        name = F.lower(F.regexp_extract(bare, FIELD_LINE, 1))
        name = reduce(lambda c, kv: F.when(name == kv[0], kv[1]).otherwise(c), SAME_FIELD.items(), name)
        value = stripped(F.regexp_extract(bare, FIELD_LINE, 2))
        known = F.array_position(s["names"], name)
        opened = state(F.size(s["names"]) + 1, F.array_append(s["names"], name), F.array_append(s["values"], value))
        again = state(known, s["names"], joined(s["values"], known, value))
        closed = state(F.lit(0), s["names"], s["values"])
        wrapped = state(s["at"], s["names"], joined(s["values"], s["at"], bare))
        return F.when(name != "", F.when(known > 0, again).otherwise(opened)).when(line.rlike(OTHER_FIELD), closed).when(s["at"] > 0, wrapped).otherwise(s)

    return F.aggregate(F.split(block, "\n"), start, step)


def parsed_header(text: Column) -> Column:
    """struct(date, from, to, cc, subject) of a message, or null unless it has a sender, and a subject of three characters or
    more besides answer prefixes. Missing fields are null; of entities only the common ones are written out; null text is null."""
    parts = F.split(plain_newlines(text), "\n\n", 2)

    def read(p: Column) -> Column:
        return let(folded_lines(F.get(p, 0)), lambda s: let(listed(s, F.get(p, 1)), picked))

    def listed(s: Column, rest: Column) -> Column:
        """The fields with their values, those of a scanned layout from the paragraph after the block."""
        paragraph = F.get(F.split(F.coalesce(rest, F.lit("")), "\n\n", 2), 0)
        below = F.filter(F.transform(F.split(paragraph, "\n"), stripped), lambda v: v != "")
        scanned = ~F.exists(s["values"], lambda v: v != "")
        values = F.when(scanned, F.transform(s["values"], lambda v, i: F.coalesce(F.get(below, i), v))).otherwise(s["values"])
        return F.struct(s["names"].alias("names"), values.alias("values"))

    def picked(s: Column) -> Column:
        def field(name: str) -> Column:
            value = F.get(s["values"], F.array_position(s["names"], name).cast("int") - 1)
            value = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), value)
            return F.when(F.array_contains(s["names"], name), stripped(F.regexp_replace(value, r"\s+", " ")))

        asked = stripped(F.regexp_replace(F.coalesce(field("subject"), F.lit("")), ANSWER_PREFIX, ""))
        whole = (F.coalesce(field("from"), F.lit("")) != "") & (F.length(asked) >= SHORTEST_SUBJECT)
        return F.when(whole, F.struct(*[field(f).alias(f) for f in FIELDS]))

    return F.when(text.isNotNull(), let(parts, read))


def trimmed_addresses(value: Column, most: int = 6) -> Column:
    """Addresses, separated by semicolons if there are any, else by commas: the first ``most``, and how many more there are."""
    parts = F.when(F.contains(value, F.lit(";")), F.split(value, ";")).otherwise(F.split(value, ","))
    kept = F.filter(F.transform(parts, stripped), lambda a: a != "")
    return let(kept, lambda a: F.concat(F.array_join(F.slice(a, 1, most), "; "), F.when(F.size(a) > most, F.concat(F.lit(" (+"), (F.size(a) - most).cast("string"), F.lit(" more)"))).otherwise("")))


def header_block(meta: Column, people: bool) -> Column:
    """A parsed header written again: date and subject, with ``people`` sender and recipients too; empty fields are left out."""
    line = lambda name, value: F.when(F.coalesce(meta[value], F.lit("")) != "", F.concat(F.lit(f"{name}: "), meta[value]))
    to = lambda name, value: F.when(F.coalesce(meta[value], F.lit("")) != "", F.concat(F.lit(f"{name}: "), trimmed_addresses(meta[value])))
    named = [line("From", "from"), to("To", "to"), to("Cc", "cc")] if people else []
    return F.when(meta.isNotNull(), F.concat_ws("\n", line("Date", "date"), *named, line("Subject", "subject")))


#: What a near-duplicate key reads of a text, and keeps of it.
KEY_READ, KEY_KEPT = 600, 300


def near_key(title: Column, text: Column) -> Column:
    """A key that near copies of a message share: the title without one answer prefix, and the text's beginning without its
    first header field, both in lower case with single blanks. Nulls are empty."""
    blanks = lambda c: F.regexp_replace(c, r"\s+", " ")
    subject = blanks(stripped(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"^(re|fw|fwd)\s*:\s*", "")))
    field = r"(subject|from|date|to|cc|sent):"
    body = F.regexp_replace(blanks(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, KEY_READ))), rf"^{field}.*?(?=\s{field}|$)", "")
    return F.concat_ws("|", subject, F.substring(body, 1, KEY_KEPT))


def production_prefix(number: Column) -> Column:
    """The production that a page number with a prefix belongs to: letters before five digits or more, else what comes before
    the first hyphen; null for an empty number."""
    letters = F.regexp_extract(stripped(number), r"^([A-Za-z][A-Za-z_-]*?)[-_]?\d{5,}", 1)
    return F.when(number != "", F.regexp_replace(F.when(letters != "", letters).otherwise(F.get(F.split(number, "-"), 0)), "[-_]+$", ""))
