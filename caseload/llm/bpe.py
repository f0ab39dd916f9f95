"""Byte-level BPE by a reduction tree.

A text is halved at places where the split pattern surely breaks, down to leaves; their id lists are concatenated up
the tree. A match of the pattern (a piece) that is no token itself is halved by bytes. Two encoded halves are joined
by encoding a window of tokens around the seam again; the window grows until the tokens outside it provably stay: a
token list is the encoding of its bytes exactly if every two neighbours are the encoding of their own bytes, so it is
enough that both seams of the window hold.

Defined results for odd input: a null text has no ids and decodes to no bytes; bytes that aren't UTF-8 are read as
U+FFFD, as the reference library does; ties can't occur, as ranks are unique; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from itertools import pairwise

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from caseload.llm.rows import map_texts

#: Bytes of a piece that is merged directly, and characters of a text that is split directly.
LEAF_BYTES, LEAF_CHARS = 32, 4096
#: Pieces remembered in each task since its last full cache, and as many from before.
CACHE = 200_000
#: Bytes whose merges are found by scanning all pairs, which is faster than a heap for few; the rank of no pair.
SCANNED, NONE = 64, 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank by token, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class OddBlank(Exception):
    """A blank beside another space: the text around it is split as a whole."""


class TreeEncoder:
    """Encodes and decodes by a fixed rank table; remembers pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.stays: dict[tuple[int, int], bool] = {}
        self.pieces, self.old_pieces = {}, {}
        self.chunks, self.old_chunks = {}, {}

    def merged(self, data: bytes) -> list[int]:
        """The plain merges: the lowest rank first, the leftmost of equals."""
        if len(data) > SCANNED:
            return self.merged_by_heap(data)
        ranks, rank = self.ranks, self.ranks.get
        cuts = list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], NONE) for i in cuts[:-2]]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            del pairs[i], cuts[i + 1]
            if i < len(pairs):
                pairs[i] = rank(data[cuts[i] : cuts[i + 2]], NONE)
            if i:
                pairs[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], NONE)
        return [ranks[data[a:b]] for a, b in pairwise(cuts)]

    def merged_by_heap(self, data: bytes) -> list[int]:
        n, ranks = len(data), self.ranks
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = ends[i] if alive[i] else n
            if j >= n or ranks.get(data[i : ends[j]]) != rank:
                continue
            ends[i], alive[j] = ends[j], False
            after = ends[i]
            if after < n:
                before[after] = i
                if (r := ranks.get(data[i : ends[after]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (left := before[i]) >= 0 and (r := ranks.get(data[left : ends[i]])) is not None:
                heapq.heappush(heap, (r, left))
        return [ranks[data[i : ends[i]]] for i in range(n) if alive[i]]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether ``[a, b]`` is the encoding of its bytes."""
        known = self.stays.get((a, b))
        if known is None:
            if len(self.stays) > CACHE:
                self.stays.clear()
            known = self.stays[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both halves' bytes together."""
        if not left or not right:
            return left + right
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            window = self.merged(self.decoded(a) + self.decoded(b))
            if (width >= len(left) or self.neighbours(left[-width - 1], window[0])) and (width >= len(right) or self.neighbours(window[-1], right[width])):
                return left[:-width] + window + right[width:]
            width *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> bytes:
        """A piece's ids as packed 32-bit numbers; a piece that is a token is that token."""
        known = self.pieces.get(text) or self.old_pieces.get(text)
        if known is None:
            data = text.encode()
            rank = self.ranks.get(data)
            known = array("i", [rank] if rank is not None else self.tree(data)).tobytes()
        if len(self.pieces) > CACHE:
            self.old_pieces = self.pieces.copy()
            self.pieces.clear()
        if len(text) < 256:
            self.pieces[text] = known
        return known

    def packed(self, text: str) -> bytes:
        """A text's ids as packed 32-bit numbers. Halves meet before a blank that follows no space: the pattern always breaks there."""
        if len(text) > LEAF_CHARS:
            half = len(text) // 2
            for at in range(half, len(text)):
                if text[at] == " " and not text[at - 1].isspace():
                    return self.packed(text[:at]) + self.packed(text[at:])
        first, *rest = text.split(" ")
        known, chunk = self.chunks, self.chunk
        try:
            if first and (first[-1].isspace() or not rest):
                raise OddBlank
            return b"".join([self.pieced(first), *[known.get(x) or chunk(x) for x in rest]])
        except OddBlank:
            return self.pieced(text)

    def pieced(self, text: str) -> bytes:
        known, piece = self.pieces, self.piece
        return b"".join([known.get(x) or piece(x) for x in self.split(text)])

    def chunk(self, text: str) -> bytes:
        """The ids of a blank and what follows it up to the next blank. The pattern breaks at both ends, unless spaces meet there."""
        if not text or text[0].isspace() or text[-1].isspace():
            raise OddBlank
        known = self.old_chunks.get(text)
        if known is None:
            known = self.piece(" " + text) if text.isascii() and text.isalpha() else self.pieced(" " + text)
        if len(self.chunks) > CACHE:
            self.old_chunks = self.chunks.copy()
            self.chunks.clear()
        if len(text) < 256:
            self.chunks[text] = known
        return known

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.int32)

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        """Halves decoded and concatenated up the tree."""
        if len(ids) <= LEAF_CHARS:
            return self.decoded(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None, with_decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` of each whole text, and on request ``decoded``, the bytes that these ids stand for.

    The rank file is read on the driver (a vocabulary of fixed size) and sent to the executors.
    """
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        encoder = TreeEncoder(shared.value, pattern)

        def work(text: bytes | None):
            ids = encoder.encode((text or b"").decode("utf-8", "replace"))
            return (ids, encoder.decode(ids.tolist())) if with_decoded else (ids,)

        return work

    return map_texts(docs, make, "ids array<int>" + ", decoded binary" * with_decoded, keep)


def decode(spark: SparkSession, encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the id list in column ``ids``; null ids decode to no bytes."""
    import pyarrow as pa
    from pyspark.sql import types as T

    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    keep = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        encoder = TreeEncoder(shared.value, pattern)
        for batch in batches:
            got = [encoder.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*keep, "decoded"])

    source = encoded.select(*keep)
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("decoded", T.BinaryType())]))
