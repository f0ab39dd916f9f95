"""Chat formatting of typed content parts. Only DataFrame functions run here.

A turn holds parts, each of a type. Each type has a visitor that gives its flat form: text is escaped and stands as it
is; image, audio and document parts become an ordered placeholder, with the attachment's reference recorded and the
tokens it expands to counted. ``typed_parts`` reads parts from a text with inline attachments; such an attachment keeps
its source, so reading back restores the text. A conversation is its turns in order of ``turn`` (ties: role, then parts), each

    <|turn|>role<|body|>parts<|end|>

with a line break after it. Inside texts and roles a backslash follows each ``<``, so that no control string (they begin
with ``<|``) can occur there, within a part or across two; taking it away restores the text.

Running sums over a conversation's turns give each its place and the number of its first attachment, so work grows with
the turns and not with their square. A conversation becomes one row, which is what the format is; turns without a
conversation id are never gathered.

Defined results for odd input: null text is the empty text; null roles are empty roles; each turn without a conversation
id is a conversation of its own; repeated rows are repeated turns; an unknown part type is read as a document; an empty
table gives an empty result; only conv_id, turn, role and parts are read, so further columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens that one attachment expands to: image patches, audio frames a second, tokens a page.
EXPANSION = {"image": 256, "audio": 50, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"
#: Inline attachments: an image in markup, or a link to a file whose ending says what it is.
FILES = {"audio": "mp3|wav|ogg|flac|m4a", "document": "pdf|docx?|pptx?|xlsx?|odt|epub"}
INLINE = r"!\[[^\[\]\n]*\]\([^()\s]+\)|\[[^\[\]\n]*\]\([^()\s]+\.(?:%s)\)" % "|".join(FILES.values())
PLACEHOLDER = r"<\|(?:%s):[0-9]+\|>" % "|".join(EXPANSION)


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<\\"))


def unescaped(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(1).alias("units"))).cast(PARTS)


def typed_parts(text: Column) -> Column:
    """The parts of a text with inline attachments, whose ``text`` is their source."""
    text = F.coalesce(text, F.lit(""))
    one = lambda type_, t, ref: F.struct(type_.alias("type"), t.alias("text"), ref.alias("ref"), F.lit(1).alias("units"))
    plain = lambda t: one(F.lit("text"), t, F.lit(None).cast("string"))
    sort = lambda x: F.when(F.substring(x, 1, 1) == "!", F.lit("image")).when(F.rlike(x, F.lit(r"\.(?:%s)\)$" % FILES["audio"])), F.lit("audio")).otherwise(F.lit("document"))
    split = F.zip_with(
        F.split(text, INLINE, -1),
        F.regexp_extract_all(text, F.lit(f"({INLINE})"), F.lit(1)),
        lambda t, x: F.array(F.when(t != "", plain(t)), F.when(x.isNotNull(), one(sort(x), x, F.regexp_extract(x, r"\(([^()]*)\)$", 1)))),
    )
    whole = F.filter(F.flatten(split), lambda p: p.isNotNull())
    return F.when(F.contains(text, F.lit("](")), whole).otherwise(F.array(plain(text))).cast(PARTS)


def kind(part: Column) -> Column:
    known = part["type"].isin("text", *EXPANSION)
    return F.when(known, part["type"]).otherwise(F.lit("document"))


def visited(part: Column, number: Column) -> Column:
    """A part's flat form."""
    return F.when(kind(part) == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(part), F.lit(":"), number.cast("string"), F.lit("|>")))


def expansion(part: Column) -> Column:
    units = F.coalesce(part["units"], F.lit(1)).cast("long")
    out = F.lit(0).cast("long")
    for name, tokens in EXPANSION.items():
        out = F.when(kind(part) == name, units * tokens).otherwise(out)
    return out


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, parts).

    ``formatted``: the text. ``mask``: start and length of each stretch under the loss, the flat bodies of turns whose
    role is in ``loss_roles``, in code points, and ``at`` and ``bytes``, the same in bytes of UTF-8. ``attachments``:
    number, type, reference, tokens and source of each attachment in order. ``n_turns``, ``n_attachment_tokens``.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select("conv_id", own.alias("own"), "turn", role.alias("role"), parts.alias("parts"))
    attached = F.filter("parts", lambda p: kind(p) != "text")
    rows = rows.withColumn("attached", F.transform(attached, lambda p: F.struct(kind(p).alias("type"), p["ref"].alias("ref"), expansion(p).alias("tokens"), p["text"].alias("source"))))
    order = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumns({"i": F.row_number().over(order), "numbers": F.coalesce(F.sum(F.size("attached")).over(before), F.lit(0))})
    inside = lambda k: F.when(F.size("attached") == 0, F.lit(0)).otherwise(F.size(F.filter(F.slice("parts", 1, k), lambda p: kind(p) != "text")))
    laid = numbered.select(
        "conv_id",
        "own",
        "i",
        "attached",
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(BODY)).alias("head"),
        F.concat_ws("", F.transform("parts", lambda p, k: visited(p, F.col("numbers") + inside(k) + 1))).alias("body"),
        F.col("role").isin(*loss_roles).alias("loss"),
    )
    sums = Window.partitionBy("conv_id", "own").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    tail = len(END) + 1
    starts = {
        name: F.coalesce(F.sum(of("head") + of("body") + tail).over(sums), F.lit(0)) + of("head")
        for name, of in (("start", F.length), ("at", F.octet_length))
    }
    placed = laid.withColumns(starts).withColumns({"length": F.length("body").cast("long"), "bytes": F.octet_length("body").cast("long")})
    turn = F.struct("i", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "attached", "loss", F.struct("start", "length", "at", "bytes").alias("span"))
    whole = placed.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    flat = whole.withColumn("attached", F.flatten("turns.attached"))
    return flat.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", "turns.piece").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["span"]).alias("mask"),
        F.transform("attached", lambda a, i: F.struct((i + 1).alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), a["source"].alias("source"))).alias("attachments"),
        F.aggregate("attached", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("n_attachment_tokens"),
    )


def expanded(text: Column) -> Column:
    """Formatted text with the placeholders of attachments that have a source replaced by it, escaped."""
    known = lambda x: F.get(F.col("attachments"), F.regexp_extract(x, "([0-9]+)", 1).cast("int") - 1)["source"]
    pieces = F.zip_with(F.split(text, PLACEHOLDER, -1), F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), F.lit(1)), lambda t, x: F.concat(t, F.coalesce(escaped(known(x)), x, F.lit(""))))
    return F.when(F.size("attachments") == 0, text).otherwise(F.concat_ws("", pieces))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text`` to what ``format_chats`` returns, from the text, its mask and its attachments."""
    pieces = F.split(expanded(F.col("formatted")), r"<\|turn\|>")
    turns = F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda b: F.struct(
            unescaped(F.substring_index(b, BODY, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(b, END, 1), BODY, -1)).alias("text"),
        ),
    )
    # Bytes are cut out without a walk over the text before them.
    raw = F.transform(F.array(F.col("formatted").cast("binary")), lambda whole: F.transform("mask", lambda m: F.substring(whole, (m["at"] + 1).cast("int"), m["bytes"].cast("int")).cast("string")))[0]
    loss = F.concat_ws("", F.transform(raw, lambda body: unescaped(expanded(body))))
    return formatted.withColumns({"turns": turns, "loss_text": loss})
