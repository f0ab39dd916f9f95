"""Secret scans: base patterns over the text and over every layer that can be unwrapped from it.

A worklist holds layers. A layer is scanned, then its URL escapes, Unicode escapes, base64 runs (at each of the four
alignments) and compressed contents are unwrapped into further layers, until none is new (a layer is known by its bytes
and where they come from, which ends cycles). A layer is bytes, UTF-8 or not; each knows the span of the original text it
stands for, so a find in any layer gets a span there. All bytes of decompressed contents stand for the same stretch, that
of the compressed ones. An escape that stands for no character stays as it is.

Compressed contents are gzip, zlib with any window, zstandard, bzip2, xz, lzma, the members of zip archives, and raw deflate
where a decoded layer begins with it.

Contents of any size are read whole, in windows of ``WINDOW`` bytes that overlap by ``OVERLAP``; no more is held at a time
for each depth of nesting. As finds of one kind in such contents have one span, a find is lost to no cut between windows;
escapes, a base64 run or compressed contents that go on beyond a window are read on by inflating what lies around them
once more. What goes on from the window before was read with that one.

Defined results for odd input: null text is the empty text, with no finds; repeated rows and ids are scanned row by
row; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import gzip
import hashlib
import lzma
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from caseload.llm.rows import map_texts

KINDS = ("assign", "access", "hex")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
#: What may hold a further layer.
URL_ESCAPE = re.compile(r"%[0-9A-Fa-f]{2}")
SPACE = re.compile(r"[ \t-\r]")
UNICODE_ESCAPE = re.compile(r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
#: The same over line breaks; each line is also a run of its own.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
NO_BASE64 = re.compile(r"[^A-Za-z0-9+/_-]+")
#: Where compressed contents may begin: a deflate method byte and a check byte without a preset dictionary, or a magic number.
ZLIB_HEADERS = [bytes([method, check]) for method in range(0x08, 0x80, 0x10) for check in range(256) if (method * 256 + check) % 31 == 0 and not check & 0x20]
MAGIC = {"gzip": b"\x1f\x8b\x08", "zstandard": b"\x28\xb5\x2f\xfd", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "lzma": b"\x5d\x00\x00", "zip": b"PK\x03\x04"}
PACKED = re.compile("|".join(re.escape(m.decode("latin-1")) for m in [*MAGIC.values(), *ZLIB_HEADERS]))
#: In the original text only what can be text.
PLAIN_PACKED = re.compile(r"x[\x01\x5e]")
#: The fixed part of a zip member's header, and its methods.
ZIP_HEADER, ZIP_METHODS = struct.Struct("<4s5H3L2H"), {8: "raw", 12: "bzip2", 14: "zip lzma", 95: "xz"}
#: How much of what looks like raw deflate has to be readable if it breaks off in an error.
LEAST_RAW = 1024
#: Decoded bytes that are held at once, by how many windows overlap, and the pieces that decoders are fed.
WINDOW, OVERLAP, PIECE = 16 << 20, 1 << 20, 1 << 16


def base_finds(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in one layer."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """Bytes with the span of the original text that each of them stands for, or one span for all; ``text`` has a
    character for each byte. ``rest`` gives the bytes that follow, where this is a window of something longer; ``begun``
    says that it isn't the first window, ``decoded`` that its first byte is where an encoding began."""

    __slots__ = ("begun", "data", "decoded", "ends", "rest", "starts", "text")

    def __init__(self, data: bytes, starts, ends, rest=None, begun=False, decoded=False):
        self.data, self.starts, self.ends, self.text, self.rest = data, starts, ends, data.decode("latin-1"), rest
        self.begun, self.decoded = begun, decoded

    def uniform(self) -> bool:
        return isinstance(self.starts, int)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (self.starts, self.ends) if self.uniform() else (int(self.starts[start:end].min()), int(self.ends[start:end].max()))

    def key(self) -> bytes:
        where = f"{self.starts}:{self.ends}".encode() if self.uniform() else self.starts.tobytes() + self.ends.tobytes()
        return hashlib.sha256(b"%d:" % len(self.data) + self.data + where).digest()


def whole(text: str) -> Layer:
    """The original text as a layer: each byte stands for its character."""
    data = text.encode("utf-8", "surrogatepass")
    at = (np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1).astype(np.int32)
    return Layer(data, at, at + np.int32(1))


def replaced(layer: Layer, start: int, end: int, escape: re.Pattern, meaning) -> Layer | None:
    """The stretch with its escapes replaced; those without a meaning stay. None if nothing was replaced."""
    out, starts, ends, i = [], [], [], start
    for m in escape.finditer(layer.text, start, end):
        got = meaning(m)
        if got is None:
            continue
        out += [layer.data[i : m.start()], got]
        if not layer.uniform():
            low, high = layer.span(*m.span())
            starts += [layer.starts[i : m.start()], np.full(len(got), low, np.int32)]
            ends += [layer.ends[i : m.start()], np.full(len(got), high, np.int32)]
        i = m.end()
    if not out:
        return None
    data = b"".join([*out, layer.data[i:end]])
    if layer.uniform():
        return Layer(data, layer.starts, layer.ends, decoded=True)
    return Layer(data, np.concatenate([*starts, layer.starts[i:end]]), np.concatenate([*ends, layer.ends[i:end]]), decoded=True)


#: No escape is longer.
LONGEST_ESCAPE = 16


def unescaped(pieces, escape: re.Pattern, meaning):
    """Chunks of a token with its escapes replaced, read until a space."""
    held = ""
    for piece in pieces:
        held += piece.decode("latin-1")
        gap = SPACE.search(held)
        held = held[: gap.start()] if gap else held
        out, i, safe = [], 0, len(held) if gap else len(held) - LONGEST_ESCAPE
        for m in escape.finditer(held):
            if m.start() >= safe:
                break
            if (got := meaning(m)) is not None:
                out += [held[i : m.start()].encode("latin-1"), got]
                i = m.end()
        cut = max(i, safe)
        yield b"".join([*out, held[i:cut].encode("latin-1")])
        held = held[cut:]
        if gap:
            return
    out, i = [], 0
    for m in escape.finditer(held):
        if (got := meaning(m)) is not None:
            out += [held[i : m.start()].encode("latin-1"), got]
            i = m.end()
    yield b"".join([*out, held[i:].encode("latin-1")])


def url_byte(m: re.Match) -> bytes:
    return bytes([int(m[0][1:], 16)])


def escaped(m: re.Match) -> bytes | None:
    """The escape's bytes in UTF-8; a code under 256 is one byte, as binary contents are escaped so."""
    if m[1]:
        return chr(0x10000 + ((int(m[1], 16) & 0x3FF) << 10) + (int(m[2], 16) & 0x3FF)).encode()
    code = int(m[6]) if m[6] else int(m[3] or m[4] or m[5], 16)
    if code < 256:
        return bytes([code])
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code).encode()


class Inflated:
    """Chunks of the compressed contents that ``pieces`` begin with; none if they aren't such.

    Members that follow each other are read as one; contents that break off are read up to there. ``took``: bytes read.
    ``raw``: they are raw deflate, which has no mark of its own.
    """

    def __init__(self, pieces, raw: bool = False):
        self.pieces, self.took, self.raw, self.failed = iter(pieces), 0, raw, False

    def __iter__(self):
        first = self.filled(next(self.pieces, b""), ZIP_HEADER.size)
        kind = "raw" if self.raw else next((k for k, m in MAGIC.items() if first.startswith(m)), "zlib")
        if kind == "zip":
            kind, first = self.zip_member(first)
        if kind == "zstandard":
            yield from self.zstandard(first)
        elif kind == "zip lzma":
            yield from self.zip_lzma(first)
        elif kind:
            boxes = {"bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "lzma": lzma.LZMADecompressor, "raw": lambda: zlib.decompressobj(-15)}
            mark = {"zlib": first[:1], "raw": None, "lzma": None}.get(kind, MAGIC.get(kind, b"")[:2])
            yield from self.members(first, boxes.get(kind, lambda: zlib.decompressobj(47)), mark)

    def filled(self, held: bytes, size: int) -> bytes:
        """``held`` with so many further pieces that it has ``size`` bytes, if there are any."""
        while len(held) < size and (more := next(self.pieces, None)) is not None:
            held += more
        return held

    def zip_member(self, first: bytes) -> tuple[str | None, bytes]:
        """How a member is packed (None: not at all, or in a way unknown), and its contents' first bytes."""
        if len(first) < ZIP_HEADER.size:
            return None, b""
        head = ZIP_HEADER.unpack(first[: ZIP_HEADER.size])
        skip = ZIP_HEADER.size + head[9] + head[10]
        first = self.filled(first, skip + 1)
        self.took += min(skip, len(first))
        return ZIP_METHODS.get(head[3]), first[skip:]

    def zip_lzma(self, first: bytes):
        first = self.filled(first, 9)
        if len(first) < 9 or first[4] >= 225:
            return
        rest, lc = divmod(first[4], 9)
        pb, lp = divmod(rest, 5)
        if lc + lp > 4:
            return
        size = int.from_bytes(first[5:9], "little")
        options = [{"id": lzma.FILTER_LZMA1, "lc": lc, "lp": lp, "pb": pb, "dict_size": min(max(size, 4096), 1 << 26)}]
        self.took += 9
        yield from self.members(first[9:], lambda: lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=options), None)

    def zstandard(self, first: bytes):
        import zstandard

        feed = Feed(first, self.pieces)
        try:
            reader = zstandard.ZstdDecompressor().stream_reader(feed, read_across_frames=True)
            while got := reader.read(PIECE):
                self.took = feed.took
                yield got
        except zstandard.ZstdError:
            pass

    def members(self, piece: bytes, make, mark: bytes | None):
        """Chunks of one member after the other; ``mark``: what a further one begins with (None: there is no further one)."""
        box, deflate = make(), hasattr(make(), "unconsumed_tail")
        while piece:
            before = box.copy() if deflate else None
            try:
                got = box.decompress(piece, PIECE)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, MemoryError):
                self.failed = True
                for i in range(len(piece) if deflate else 0):  # up to the error, byte by byte
                    try:
                        got = before.decompress(piece[i : i + 1])
                    except zlib.error:
                        break
                    if got:
                        yield got
                self.took += len(piece)
                return
            if got:
                yield got
            while not deflate and not box.eof and not box.needs_input:  # the rest of what this piece holds
                try:
                    got = box.decompress(b"", PIECE)
                except (OSError, lzma.LZMAError, EOFError):
                    self.failed = True
                    return
                yield got
            rest = box.unused_data if box.eof else box.unconsumed_tail if deflate else b""
            self.took += len(piece) - len(rest)
            if box.eof:
                if mark is None:
                    return
                rest = self.filled(rest, len(mark))
                if rest[: len(mark)] != mark:
                    return
                box = make()
            piece = rest or next(self.pieces, b"")


class Feed:
    """Pieces as a file."""

    def __init__(self, first: bytes, pieces):
        self.held, self.pieces, self.took = first, pieces, 0

    def read(self, size: int = -1) -> bytes:
        if not self.held:
            self.held = next(self.pieces, b"")
        size = len(self.held) if size < 0 else size
        out, self.held = self.held[:size], self.held[size:]
        self.took += len(out)
        return out


def debased(pieces, skip: int):
    """Chunks of a base64 run, without its first ``skip`` characters, read until something else than it or a line break."""
    held, skipped = b"", 0
    for piece in pieces:
        end = OTHER_THAN_BASE64.search(piece)
        run = (piece[: end.start()] if end else piece).translate(PLAIN_BASE64, b"\r\n \t")
        cut = min(skip - skipped, len(run))
        skipped += cut
        held += run[cut:]
        whole_ones = len(held) - len(held) % 4
        yield base64.b64decode(held[:whole_ones])
        held = held[whole_ones:]
        if end:
            break
    held = held[: len(held) - (len(held) % 4 == 1)]
    yield base64.b64decode(held + b"=" * (-len(held) % 4))


PLAIN_BASE64 = bytes.maketrans(b"-_", b"+/")
OTHER_THAN_BASE64 = re.compile(rb"[^A-Za-z0-9+/_\r\n \t-]")


def windows(chunks, low: int, high: int, again):
    """Layers of ``chunks``, WINDOW bytes each, that overlap. ``again()`` gives the chunks once more, for what goes beyond."""
    held, size, offset = [], 0, 0

    def after(end: int):
        def rest():
            at = 0
            for chunk in again():
                if at + len(chunk) > end:
                    yield chunk[max(0, end - at) :]
                at += len(chunk)

        return rest

    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size >= WINDOW + OVERLAP:
            data = b"".join(held)
            yield Layer(data[:WINDOW], low, high, after(offset + WINDOW), begun=offset > 0, decoded=offset == 0)
            offset += WINDOW - OVERLAP
            held, size = [data[WINDOW - OVERLAP :]], size - WINDOW + OVERLAP
    yield Layer(b"".join(held), low, high, begun=offset > 0, decoded=offset == 0)


def sliced(layer: Layer, start: int):
    """The layer's bytes from ``start`` on, and those that follow it, in pieces."""
    for i in range(start, len(layer.data), PIECE):
        yield layer.data[i : i + PIECE]
    if layer.rest:
        yield from layer.rest()


def from_base64(layer: Layer, start: int, end: int, skip: int) -> Layer | None:
    """A run, decoded from its character ``skip`` on."""
    run = layer.data[start:end].translate(PLAIN_BASE64, b"=\r\n \t")[skip:]
    run = run[: len(run) - (len(run) % 4 == 1)]
    try:
        data = base64.b64decode(run + b"=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None
    if layer.uniform():
        return Layer(data, layer.starts, layer.ends, decoded=True)
    at = np.concatenate([np.arange(a, b, dtype=np.int32) for a, b in pieces(layer.text, start, end)])[skip:]
    i = np.arange(len(data), dtype=np.int32)
    return Layer(data, layer.starts[at[i * 4 // 3]], layer.ends[at[((i + 1) * 4 - 1) // 3]], decoded=True)


def pieces(text: str, start: int, end: int):
    """The spans of a run's lines, without breaks and padding."""
    for m in NO_BASE64.finditer(text, start, end):
        yield start, m.start()
        start = m.end()
    yield start, end


def tokens_with(escape: re.Pattern, text: str, whole_end: bool):
    """The spans between spaces that hold an escape, each once; with ``whole_end`` the last span too, whatever it holds."""
    done = 0
    for m in escape.finditer(text):
        if m.start() >= done:
            start = m.start()
            while start > done and text[start - 1] not in " \t\n\v\f\r":
                start -= 1
            gap = SPACE.search(text, m.end())
            done = gap.start() if gap else len(text)
            yield start, done
    if whole_end and done < len(text):
        start = max(done, 1 + max(text.rfind(c) for c in " \t\n\v\f\r"))
        if start < len(text):
            yield start, len(text)


def of_escapes(layer: Layer, escape: re.Pattern, meaning):
    """Each token's layer. One that goes on beyond the window is read on, if it has an escape anywhere."""
    for start, end in tokens_with(escape, layer.text, layer.rest is not None):
        if layer.begun and start == 0:
            continue  # read with the window before
        if layer.rest and end == len(layer.text):
            again = lambda at=start: unescaped(sliced(layer, at), escape, meaning)
            if any_escape(sliced(layer, start), escape):
                yield from windows(again(), *layer.span(start, end), again)
        elif (got := replaced(layer, start, end, escape, meaning)) is not None:
            yield got


def any_escape(pieces, escape: re.Pattern) -> bool:
    """Whether a token, up to its space, has an escape."""
    held = ""
    for piece in pieces:
        held += piece.decode("latin-1")
        gap = SPACE.search(held)
        if escape.search(held, 0, gap.start() if gap else len(held)):
            return True
        if gap:
            return False
        held = held[-LONGEST_ESCAPE:]
    return False


def unwrapped(layer: Layer):
    """Each layer that this one holds."""
    text = layer.text
    if "%" in text or layer.rest:
        yield from of_escapes(layer, URL_ESCAPE, url_byte)
    if "\\" in text or "&#" in text or layer.rest:
        yield from of_escapes(layer, UNICODE_ESCAPE, escaped)
    for runs in (BASE64_RUN, BASE64_LINES):
        for m in runs.finditer(text):
            if layer.begun and m.start() == 0:
                continue
            for skip in range(4):
                if layer.rest and m.end() == len(text):
                    again = lambda at=m.start(), skip=skip: debased(sliced(layer, at), skip)
                    yield from windows(again(), *layer.span(*m.span()), again)
                elif (got := from_base64(layer, *m.span(), skip)) is not None:
                    yield got
    if layer.decoded and not PACKED.match(text):
        yield from inflated(layer, 0, raw=True)
    done = 0
    for m in (PACKED if layer.decoded or layer.uniform() else PLAIN_PACKED).finditer(text):
        if m.start() >= done:
            end = yield from inflated(layer, m.start())
            done = end if len(m[0]) > 2 and end < len(text) else done


def inflated(layer: Layer, start: int, raw: bool = False):
    """The layers of the compressed contents that begin at ``start``; returns where they end. What looks like raw deflate
    counts only if it ends without an error or has ``LEAST_RAW`` bytes."""
    again = lambda: Inflated(sliced(layer, start), raw)
    first, held, size = again(), [], 0
    chunks = iter(first)
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size > WINDOW:
            break
    if not size or (raw and first.failed and size < LEAST_RAW):
        return start
    if size > WINDOW:
        for _ in chunks:  # read to the end, for the stretch that the contents stand for
            pass
        held = again()
    end = min(start + first.took, len(layer.text))
    yield from windows(held, *layer.span(start, max(end, start + 1)), again)
    return end


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Finds in the text itself, further finds in its layers, and the number of layers."""
    base = base_finds(text)
    if not ("%" in text or "\\" in text or "&#" in text or BASE64_RUN.search(text) or PLAIN_PACKED.search(text)):
        return base, [], 0
    todo, seen, found = [unwrapped(whole(text))], set(), set()
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
        elif layer.data and (key := layer.key()) not in seen:
            seen.add(key)
            todo.append(unwrapped(layer))
            found.update((kind, *layer.span(a, b)) for kind, a, b in base_finds(layer.text))
    return base, sorted(found - set(base), key=place), len(seen)


def place(find: tuple[str, int, int]) -> tuple[int, int, int]:
    return find[1], KINDS.index(find[0]), find[2]


def listed(finds: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(finds, key=place))


FINDS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``base_finds`` and ``layer_finds`` (kind, start, end in code points, end exclusive), and ``n_layers``."""

    def make():
        def work(text: bytes | None):
            base, more, layers = scan((text or b"").decode("utf-8", "replace"))
            return [dict(zip(("kind", "start", "end"), x, strict=True)) for x in sorted(base, key=place)], [dict(zip(("kind", "start", "end"), x, strict=True)) for x in more], layers

        return work

    return map_texts(docs, make, f"base_finds {FINDS}, layer_finds {FINDS}, n_layers int", keep)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every find, in the text or in a layer, replaced by ``mask``; overlapping finds become one. Null stays null."""

    def make():
        def work(text: bytes | None):
            if text is None:
                return (None,)
            original = text.decode("utf-8", "replace")
            base, more, _ = scan(original)
            out, at = [], 0
            for start, end in sorted((a, b) for _, a, b in [*base, *more]):
                if start >= at:
                    out += [original[at:start], mask]
                at = max(at, end)
            return ("".join([*out, original[at:]]),)

        return work

    order = docs.columns
    return map_texts(docs, make, "text string").select(*order)


def packed(text: str) -> str:
    """Gzip and base64 of a text: what a nested layer may look like. For tests and examples."""
    return base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()
