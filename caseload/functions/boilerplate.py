"""Why a window (the text before a hand-off, and what follows it) is no test of memory: fourteen rules, as column expressions.

Seven rules hold for messages only; the others look at layout, repetition, garbled words, and how often a window's runs of
words stand elsewhere. ``known`` is a column of words that count as words (null: every word does).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseload.functions.text import let, ngrams, tokens
from caseload.operators.corpus import gram_keys, key_frequency

#: Names of the rules, in the order in which they are listed.
REASONS = ["disclaimer", "signature", "quoted_header", "list_footer", "auto_message", "scan_notice", "production_stamp", "repetitive", "key_value_list", "tabular", "ocr_garbage", "thin_prefix", "corpus_template", "duplicate"]
#: Thresholds of the rules.
TAIL, NEAR_TAIL, RUN, COPIED_WORDS = 300, 400, 8, 12
GARBAGE_AFTER, GARBAGE_BEFORE, LEAST_WORDS = 0.20, 0.30, 40
TEMPLATE_SHARE, TEMPLATE_RUN, WHOLE, TEMPLATE_OTHERS, DUPLICATE_OTHERS = 0.25, 8, 0.8, 2, 4
#: Phrases, each of words with any white space between them; a bar parts spellings.
DISCLAIMER = ["intended recipient", "notify the sender", "delete (this|the) (e-?mail|message|communication|transmission)", "confidentiality notice", "legally privileged", "attorney[- ]client (privilege|communication)", "if you have received this",
              "unauthori[sz]ed (review|use|disclosure|dissemination|distribution|copying|forwarding)", "strictly prohibited", "destroy all copies", "sole use of the", "intended (solely|only) for the", "information (contained )?in this (e-?mail|message|communication)",
              "may contain (confidential|privileged|proprietary)", "privileged (and|or) confidential", "confidential (and|or) (legally )?privileged", "does not accept (any )?liability", "exempt from disclosure", "consider the environment", "for the addressee only"]
DISCLAIMER_WORDS = ["confidential", "privileged", "prohibited", "unauthori[sz]ed", "disclos", "dissemination", "distribution", "copying", "the sender", "addressee", "proprietary", "liability", "virus", "attachments?", "recipient"]
FOOTER = ["unsubscribe", "to be removed from", "to stop receiving", "opt[- ]?out", "you (are|were) receiving this", "update your (preferences|profile|subscription)", "this (e-?mail|message|newsletter) (was|is) sent (to|by|from)", "no longer wish to receive", "mailing list", "manage your (subscriptions?|account)"]
FOOTER_WORDS = ["all rights reserved", "copyright (©|\\(c\\)|\\d{4})", "privacy (policy|statement)", "terms (of (use|service)|and conditions)", "click here", "visit our (web ?site)", "for more information", "to learn more", "free shipping", "special offer", "limited time", "shop now"]
BOUNCE = ["auto(matic|mated)?[- ]?(reply|response|generated|notification)", "automatically generated", "delivery (has )?failed", "undeliverable", "delivery (status )?notification", "mailer-daemon", "do not reply to this", "this is an automated", "message could not be delivered", "read receipt", "mail delivery (subsystem|failure)", "returned mail"]
AWAY = ["out of (the )?office", "away from the office", "has been (tentatively )?(accepted|declined)"]
SCANNED = ["scanned (for viruses|by)", "virus[- ]?(free|scan|check)", "anti-?virus", "has been scanned", "free from (viruses|malware)", "believed to be (clean|free of)", "no virus found"]
STAMP = ["subject to (a )?protective order", "highly confidential", "produced (pursuant|in response) to", "bates (no|number|stamp)"]
FORWARDED = ["-{3,}\\s*(original|forwarded|begin forwarded)", "begin forwarded message", "forwarded by"]
HEADER_LINE = r"(?m)^\s*>*\s*\**(From|Sent|To|Cc|CC|Bcc|Subject|Date|Importance|Attachments?|Reply-To)\**\s*:"
EMPTY_HEADER = r"(?m)^[ \t]*(From|Sent|To|Cc|CC|Bcc|Subject|Date|Importance|Attachments?)[ \t]*:[ \t]*$"
QUOTE_MARK, WROTE = r"(?m)^\s*>", r"(?im)^on\s.{5,160}?\bwrote:\s*$"
CONTACT = r"(?i)(\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b|[\w.+-]+@[\w-]+\.[\w.-]+|(https?://|www\.)\S+|\b(fax|tel|phone|cell|mobile|direct|office|voice|pager)\b)"
ADDRESS = r"(\b[A-Z]{2}\s+\d{5}(-\d{4})?\b|^\s*\d{1,6}\s+[A-Z][\w. ]{0,40}\b(Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Suite|Floor|Way|Place|Court|Parkway|Plaza|Highway)\b|^\s*P\.?\s?O\.?\s*Box\b)"
CLOSING = r"(?im)^\s*((best|kind|warm) regards|regards|sincerely|thanks|thank you|cheers|best|respectfully|many thanks)[,.!]?\s*$"
SENT_FROM = r"(?i)sent\s+(from|via)\s+my\s+\w+"
KEY_VALUE, FILE_NAME = r"^\s*[A-Za-z][\w /&().'#*-]{0,40}\s*[:=]\s*\S", r"(?i)\.(pdf|docx?|xlsx?|pptx?|msg|zip|jpe?g|png|gif|txt|csv|rtf|html?|tiff?)\b"
NAME_ITEM, NUMBER_CELL = r"\b[A-Z][a-zA-Z'-]+,\s?[A-Z][a-zA-Z'-]+\s*;", r"(\(\d[\d,]*(\.\d+)?\)|\d+(\.\d+)?%|\d{1,3}(,\d{3})+(\.\d+)?|\$\d[\d,]*(\.\d+)?|\d+\.\d+)"
#: Tokens of so many letters and no digit, and those that have no vowel or a run of five consonants.
LETTERS = r"(?<![a-z0-9])[a-z]{%d,}+(?!\d)"
GARBLED = r"(?<![a-z0-9])(?:[bcdfghjklmnpqrstvwxz]{3,}+(?![a-z0-9])|(?=[a-z]{6,}+(?!\d))[a-z]*?[bcdfghjklmnpqrstvwxz]{5}[a-z]*+)"
LIST_WORDS = ["the", "a", "i", "we", "it", "this", "in", "on", "if", "to", "and", "for", "of", "as", "at", "by", "or", "is", "are", "you", "he", "she", "they"]


def any_phrase(phrases: list[str]) -> str:
    """A pattern of all phrases. Phrases are tried only where one of their first letters is followed by one of their second
    letters, and so on up to four letters."""
    by: dict[int, list[str]] = {}
    for p in phrases:
        by.setdefault(len(re.match(r"(?:[a-z](?![?*+{])){0,4}", p)[0]), []).append(p)
    ahead = lambda n, ps: "(?=" + "".join(f"[{''.join(sorted({p[i] for p in ps}))}]" for i in range(n)) + ")" if n and not any("|" in re.sub(r"\(.*?\)", "", p) for p in ps) else ""
    return "(?i)(?:" + "|".join(ahead(n, ps) + "(?:" + "|".join(re.sub(" ", r"\\s+", p) for p in ps) + ")" for n, ps in sorted(by.items())) + ")"


def how_many(text: Column, phrases: list[str]) -> Column:
    """Of how many of the phrases the text has one; most texts have none, and are searched once."""
    each = reduce(Column.__add__, [text.rlike(any_phrase([p])).cast("int") for p in phrases])
    return F.when(text.rlike(any_phrase(phrases)), each).otherwise(0)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def tail(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.lit(1), F.length(text) - n + 1), F.lit(n))


def full_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))


def n_words(line: Column) -> Column:
    return count(line, r"\S+")


def body(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\n\n")), F.get(F.split(text, "\n\n", 2), 1)).otherwise(text)


def contact_line(line: Column) -> Column:
    return (n_words(line) <= 10) & line.rlike(CONTACT)


def address_line(line: Column) -> Column:
    return (n_words(line) <= 10) & line.rlike(ADDRESS)


def bad_word(word: Column, known: Column) -> Column:
    """A word without a vowel, or with a run of five consonants, that isn't known; or any longer word that isn't known."""
    garbled = (F.length(word) >= 3) & (~word.rlike("[aeiouy]") | ((F.length(word) >= 6) & word.rlike("[bcdfghjklmnpqrstvwxz]{5,}")))
    unknown = F.when(known.isNull(), F.lit(False)).otherwise(~F.array_contains(known, word))
    return F.when(garbled, known.isNull() | unknown).otherwise((F.length(word) >= 4) & unknown)


def letters_only(text: Column) -> Column:
    """Those tokens that have no digit."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS % 1), F.lit(0))


def n_garbled(text: Column) -> Column:
    """How many ``bad_word``s a text has where every word is known."""
    return count(F.lower(text), GARBLED)


def garbage(text: Column, known: Column) -> Column:
    """Share of bad words among those of three letters or more; 0 for fewer than eight."""
    rate = lambda bad, n: F.when(n < 8, F.lit(0.0)).otherwise(bad / n)
    held = F.filter(letters_only(text), lambda w: F.length(w) >= 3)
    asked = let(held, lambda ws: rate(F.size(F.filter(ws, lambda w: bad_word(w, known))), F.size(ws)))
    return F.when(known.isNull(), let(count(F.lower(text), LETTERS % 3), lambda n: rate(n_garbled(text), n))).otherwise(asked)


def content_words(prefix: Column, known: Column) -> Column:
    """Words of lines that are no header, signature or short key and value."""
    said = F.filter(full_lines(body(prefix)), lambda x: ~(x.rlike(HEADER_LINE) | contact_line(x) | address_line(x) | (x.rlike(KEY_VALUE) & (n_words(x) <= 6))))
    asked = lambda t: F.size(F.filter(letters_only(t), lambda w: ~bad_word(w, known)))
    return let(F.array_join(said, "\n"), lambda t: F.when(known.isNull(), count(F.lower(t), LETTERS % 1) - n_garbled(t)).otherwise(asked(t)))


def longest_run(flags: Column) -> Column:
    """The longest stretch of trues."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    step = lambda s, f: let(F.when(f, s["now"] + 1).otherwise(0), lambda k: F.struct(k.alias("now"), F.greatest(s["best"], k).alias("best")))
    return F.aggregate(flags, start, step)["best"]


def share(flags: Column) -> Column:
    return let(flags, lambda fs: F.when(F.size(fs) > 0, F.size(F.filter(fs, lambda f: f)) / F.size(fs)).otherwise(0.0))


def signature(prefix: Column, target: Column) -> Column:
    before = F.filter(F.slice(F.reverse(full_lines(tail(prefix, TAIL))), 1, 4), contact_line)
    after = full_lines(target)
    contacts, addresses = F.size(F.filter(after, contact_line)), F.size(F.filter(after, lambda x: address_line(x) & ~contact_line(x)))
    closes = F.regexp_instr(target, F.lit(CLOSING))
    early = (closes > 0) & (closes - 1 < F.length(target) / 2)
    return (
        target.rlike(SENT_FROM) | (contacts >= 3) | ((contacts >= 2) & (early | (addresses > 0) | (F.size(before) > 0)))
        | ((contacts >= 1) & early & (addresses > 0)) | ((F.size(before) >= 2) & (contacts + addresses >= 1))
    )


def quoted_header(prefix: Column, target: Column) -> Column:
    forwarded = lambda t: t.rlike(any_phrase(FORWARDED)) | t.rlike(WROTE) | t.rlike(r"(?m)^_{5,}\s*$")
    near = tail(prefix, TAIL)
    return (count(target, HEADER_LINE) >= 2) | forwarded(target) | (count(target, QUOTE_MARK) >= 3) | (count(near, HEADER_LINE) >= 2) | forwarded(near)


def repetitive(prefix: Column, target: Column) -> Column:
    """Half of the target's runs of three words repeat, or it can be copied from the prefix: six tenths of its runs of eight
    words, or twelve words on end."""
    repeats = lambda words: let(ngrams(words, 3), lambda t: F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1)) < 0.5)
    spaced = lambda words: F.concat(F.lit(" "), words, F.lit(" "))
    copied = lambda words: let(spaced(F.array_join(tokens(prefix), " ")), lambda held: F.transform(ngrams(words, RUN), lambda g: F.contains(held, g) & F.contains(held, spaced(g))))
    much = lambda f: F.exists(f, lambda x: x) & ((share(f) >= 0.6) | (longest_run(f) >= COPIED_WORDS - RUN + 1))
    return let(tokens(target), lambda words: ((F.size(words) >= 12) & repeats(words)) | let(copied(words), much))


def key_value_list(prefix: Column, target: Column) -> Column:
    after = full_lines(target)
    around = F.concat(F.reverse(F.slice(F.reverse(full_lines(tail(prefix, TAIL))), 1, 4)), after)
    firsts = F.transform(F.filter(after, lambda x: (n_words(x) <= 12) & x.rlike(r"^\s*[A-Za-z][\w.-]*:?(\s|$)")), lambda x: F.lower(F.regexp_extract(x, r"^\s*(\S+)", 1)))
    most = lambda fs: F.aggregate(fs, F.lit(0), lambda s, w: F.greatest(s, F.when(F.array_contains(F.array(*map(F.lit, LIST_WORDS)), F.rtrim(w, F.lit(":"))), 0).otherwise(F.size(F.filter(fs, lambda v: v == w)))))
    listed = share(F.transform(after, lambda x: x.rlike(KEY_VALUE) & (n_words(x) <= 12)))
    most_listed = lambda n: let(listed, lambda k: (k >= 0.6) & (k * n >= 2.999))
    return (count(F.array_join(around, "\n"), FILE_NAME) >= 3) | let(F.size(after), lambda n: (n >= 3) & (most_listed(n) | let(firsts, lambda f: let(most(f), lambda k: (k >= 3) & (k >= 0.5 * n)))))


def tabular(target: Column) -> Column:
    rows = full_lines(target)
    cells = share(F.transform(rows, lambda x: count(x, NUMBER_CELL) >= 3))
    short, numeric = share(F.transform(rows, lambda x: n_words(x) <= 4)), share(F.transform(rows, lambda x: x.rlike(r"\d")))
    return (count(target, NAME_ITEM) >= 6) | ((F.size(rows) >= 5) & (cells >= 0.4)) | ((F.size(rows) >= 8) & (short >= 0.6) & (numeric >= 0.4))


def thin_prefix(prefix: Column, known: Column) -> Column:
    return let(content_words(prefix, known), lambda n: (n < LEAST_WORDS) | ((count(prefix, EMPTY_HEADER) >= 3) & (n < 1.25 * LEAST_WORDS)))


def elsewhere(counts: Column, others: int) -> Column:
    """Which runs stand in so many other documents; ``counts``: documents that each run stands in."""
    return F.transform(counts, lambda c: c - 1 >= others)


def window_reasons(prefix: Column, target: Column, message: Column | bool = True, known: Column | None = None, after: Column | None = None, before: Column | None = None) -> Column:
    """The rules that a window meets, in order; empty for none. Null texts are empty.

    ``after`` and ``before``: in how many documents each run of eight words of the target, and of the prefix's last 400
    characters, stands; without them the last two rules don't apply.
    """
    message = message if isinstance(message, Column) else F.lit(message)
    known = F.lit(None).cast("array<string>") if known is None else known
    made = F.struct(F.coalesce(prefix, F.lit("")).alias("p"), F.coalesce(target, F.lit("")).alias("t"), message.alias("m"), known.alias("k"))
    plain = F.array().cast("array<bigint>")
    after, before = (plain if c is None else c for c in (after, before))

    def met(x: Column) -> Column:
        p, t, k, near = x["p"], x["t"], x["k"], tail(x["p"], TAIL)
        away = F.substring(body(p), 1, 300).rlike(any_phrase(AWAY)) | F.substring(t, 1, 150).rlike(any_phrase(AWAY))
        template = (share(elsewhere(after, TEMPLATE_OTHERS)) >= TEMPLATE_SHARE) | (longest_run(elsewhere(after, TEMPLATE_OTHERS)) >= TEMPLATE_RUN)
        whole = lambda n: (share(elsewhere(after, n)) >= WHOLE) & (share(elsewhere(before, n)) >= WHOLE)
        rules = {
            "disclaimer": x["m"] & (t.rlike(any_phrase(DISCLAIMER)) | let(how_many(t, DISCLAIMER_WORDS), lambda n: (n >= 4) | ((n >= 1) & near.rlike(any_phrase(DISCLAIMER))))),
            "signature": x["m"] & signature(p, t),
            "quoted_header": x["m"] & quoted_header(p, t),
            "list_footer": x["m"] & (t.rlike(any_phrase(FOOTER)) | (how_many(t, FOOTER_WORDS) >= 2)),
            "auto_message": x["m"] & (t.rlike(any_phrase(BOUNCE)) | p.rlike(any_phrase(BOUNCE)) | (away & (content_words(p, k) < 2 * LEAST_WORDS))),
            "scan_notice": x["m"] & (t.rlike(any_phrase(SCANNED)) | near.rlike(any_phrase(SCANNED))),
            "production_stamp": t.rlike(any_phrase(STAMP)),
            "repetitive": repetitive(p, t),
            "key_value_list": key_value_list(p, t),
            "tabular": tabular(t),
            "ocr_garbage": (garbage(t, k) >= GARBAGE_AFTER) | (garbage(near, k) >= GARBAGE_BEFORE),
            "thin_prefix": x["m"] & thin_prefix(p, k),
            "corpus_template": template & ~whole(TEMPLATE_OTHERS),
            "duplicate": whole(DUPLICATE_OTHERS),
        }
        return F.array_compact(F.array(*[F.when(rules[r], F.lit(r)) for r in REASONS]))

    return let(made, met)


def with_run_counts(windows: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """``windows`` (keys, prefix, target) with ``after`` and ``before``: for each run of eight words of the target, and of the
    prefix's last 400 characters, in how many documents it stands, if in any.

    Runs are sent as 128-bit keys. Most stand in one document: only the others' counts are sent back to the windows.
    """
    sides = {"after": F.col("target"), "before": tail(F.col("prefix"), NEAR_TAIL)}
    parts = F.array(*[F.struct(F.lit(n).alias("side"), ngrams(tokens(c), RUN).alias("g")) for n, c in sides.items()])
    asked = windows.select(*keys, F.explode(parts).alias("s")).select(*keys, "s.side", F.posexplode("s.g").alias("i", "gram")).select(*keys, "side", "i", *gram_keys(F.col("gram")))
    met = asked.join(key_frequency(docs, RUN), ["h1", "h2"], "left").withColumn("df", F.coalesce("df", F.lit(0))).where("df <> 1")
    entry = lambda n: F.when(F.col("side") == n, F.struct("i", "df"))
    listed = met.groupBy(*keys).agg(*[F.map_from_entries(F.collect_list(entry(n))).alias(n) for n in sides])  # a window's runs
    size = lambda c: F.size(tokens(c)) - (RUN - 1)
    every = lambda c: let(size(c), lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>")))
    counts = lambda n, c: F.filter(F.transform(every(c), lambda i: F.coalesce(F.try_element_at(n, i), F.lit(1).cast("long"))), lambda k: k > 0)
    filled = {n: F.coalesce(counts(F.col(n), c), F.array().cast("array<bigint>")) for n, c in sides.items()}
    return windows.join(listed, keys, "left").withColumns(filled)
