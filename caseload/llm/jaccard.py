"""N-gram Jaccard join by universe partitions and the pigeonhole principle.

Rows are sets of word shingles. Rows of one set become one node first, whatever their ids. For two sets with a Jaccard similarity of
at least ``threshold`` the symmetric difference is at most H = (1-t)/(1+t) (|x|+|y|). Sets are dealt to bands by size,
and for each band the universe of shingles is partitioned by hash into segments. A segment is either exact (it can
absorb no difference) or has its one-deletion neighbourhood indexed (it absorbs one). If the tolerances plus one add up
to more than H, two similar sets agree on a segment; with some to spare, each set may leave as many exact segments
out, and it leaves out those that cost most: first the popular ones in the whole table, then the smallest. (Among the
segments on which two sets agree, the last in that order is left out by neither, so agreement is still found. A set
that meets others in no more segments than it may leave out has no partner.) How many segments get neighbourhoods is chosen for each band by a cost estimate
of index rows and of chance candidates.

Sets that agree on a segment meet in a bucket. Each member is compared with the bucket's first one. After that only
pairs of different components matter, and one of the two lies outside the first member's component: such members are
compared with the rest of the bucket. So groups of near copies need no pair of all members, and no link between
components is lost. Parity sketches rule out most candidate pairs exactly; each other one is verified on the whole sets.

Defined results for odd input: null or empty text is an empty set, linked with nothing; a text with fewer words than a
shingle is one shingle; rows that share a doc_id are judged by their own texts, each a member of what its text is linked
to; null ids are never linked and have a null component; ties can't occur, as the smallest id names a component; an
empty table gives an empty result; further columns, whatever their names, are passed on by ``first_of_each``.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload.llm.rows import map_texts, unused
from caseload.session import stored

#: A-Z in lower case, and each byte that parts words as a blank.
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
#: Sizes of one band differ by this factor at most; chance that a segment's element is shared by two unlike sets, and
#: the worth of one chance candidate in index rows, for the cost estimate; share of segments that may be left out.
BAND, SHARED, CANDIDATE, SPARE = 1.25, 0.1, 2_000.0, 0.1
#: Cells of the bitmaps that let rows through before a shuffle: 16 MB, whatever the input. A signature counts as popular
#: from so many documents on.
CELLS, POPULAR = 1 << 27, 6
#: Cells of a parity sketch for each element, at least (a power of two). The more there are, the fewer differences fall
#: in one cell and cancel out, so the fewer pairs below the threshold pass; a sketch of 4 is half a byte to one a shingle.
ROOM = 4
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles: polynomial hashes of byte ranges, from running sums over the whole text.

    Each byte value stands for a fixed 64-bit number, so a range's hash is a polynomial over 64-bit numbers in an odd
    base, shifted to start at 0 by the base's inverse, and scrambled.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, size: int):
        self.size, self.value = size, mixed(np.arange(1, 257, dtype=np.uint64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grown(self, n: int) -> None:
        """Powers of the base and of its inverse, up to n."""
        m = 1 << max(12, n.bit_length())
        for name, base in (("powers", self.BASE), ("inverses", pow(self.BASE, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct shingles of a text, as 64-bit hashes."""
        joined = np.frombuffer(text.translate(LOWER) if text else b"", np.uint8)
        blank = joined == 32
        extra = blank.copy()
        extra[1:] &= blank[:-1]  # a blank after a blank, and one at the start
        if extra.any():
            joined = joined[~extra]
        if len(joined) and joined[-1] == 32:
            joined = joined[:-1]
        if not len(joined):
            return np.empty(0, np.uint64)
        if len(joined) > len(self.powers):
            self.grown(len(joined))
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(self.value[joined] * self.powers[: len(joined)], out=sums[1:])
        ends = np.append(np.flatnonzero(joined == 32), len(joined))
        n = min(self.size, len(ends))
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends) - n + 1]
        out = mixed((sums[ends[n - 1 :]] - sums[starts]) * self.inverses[starts])
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def folded(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def band_of(n: int) -> int:
    return math.floor(math.log(n) / math.log(BAND) + 1e-9)


@lru_cache(maxsize=None)
def band_sizes(b: int) -> tuple[int, int]:
    """The smallest and largest size in a band."""
    low = next(n for n in range(max(1, math.floor(BAND**b) - 1), 1 << 62) if band_of(n) >= b)
    high = next(n for n in range(math.ceil(BAND ** (b + 1)) + 1, 0, -1) if band_of(n) <= b)
    return low, high


@lru_cache(maxsize=None)
def plan(b: int, threshold: float) -> tuple[int, int, int]:
    """For a band: exact segments, segments with neighbourhoods, and exact segments each set leaves out."""
    low, high = band_sizes(b)
    most = difference(high, math.floor(high / threshold + 1e-9), threshold)
    size = (low + high) / 2
    best = None
    for deep in range((most + 1) // 2 + 1):
        needed = most + 1 - 2 * deep
        spare = math.ceil(SPARE * needed) if needed else 0
        exact = needed + spare
        each = size / (exact + 2 * deep)  # a segment with a neighbourhood gets a double share of the universe
        cost = needed + deep * (2 * each + 1) + CANDIDATE * (needed * SHARED ** max(each, 0.5) + deep * (1 + 2 * each) * SHARED ** max(2 * each - 1, 0.5))
        if best is None or cost < best[0]:
            best = cost, exact, deep, spare
    return best[1:]


def difference(x: int, y: int, threshold: float) -> int:
    """The largest symmetric difference of two sets of these sizes at the threshold."""
    return math.floor((1 - threshold) / (1 + threshold) * (x + y) + 1e-9)


#: An odd multiplier for each band.
BAND_KEYS = [int(x) | 1 for x in mixed(np.arange(64, dtype=np.uint64))]


@lru_cache(maxsize=None)
def names(b: int, n: int) -> np.ndarray:
    """A number for each segment of a band."""
    return mixed(np.arange(n, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(b))


def signatures(s: np.ndarray, b: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a set is indexed by in a band: signatures of its exact segments and their sizes, those of its neighbourhoods,
    and how many more exact ones it may leave out. Empty segments are left out first, as nothing is more frequent."""
    exact, deep, spare = plan(b, threshold)
    # Shingles are scrambled already; a product's upper half deals them anew for each band.
    segment = ((s * np.uint64(BAND_KEYS[b % 64]) >> np.uint64(32)) * np.uint64(exact + 2 * deep) >> np.uint64(32)).astype(np.int64)
    if deep:
        segment = np.where(segment < exact, segment, exact + (segment - exact) // 2)
    n = exact + deep
    total = np.zeros(n, np.uint64)
    np.add.at(total, segment, s)
    name = names(b, n)
    whole = mixed(total ^ name)
    sizes = np.bincount(segment, minlength=n)[:exact]
    empty = np.flatnonzero(sizes == 0)[:spare]
    out = whole[:exact]
    if len(empty):
        out, sizes = np.delete(out, empty), np.delete(sizes, empty)
    around = whole[exact:]
    if deep:
        inside = segment >= exact
        around = np.concatenate([around, mixed((total[segment[inside]] - s[inside]) ^ name[segment[inside]])])
    return out, sizes, around, spare - len(empty)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = values & np.uint64(CELLS - 1)
    return (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1


def costly_first(sigs: np.ndarray, sizes: np.ndarray, popular: np.ndarray) -> np.ndarray:
    """An order of segments that any two sets share: popular ones, then small ones, then by signature."""
    return np.lexsort((sigs, sizes, ~in_bitmap(popular, sigs)))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of how many elements fall in each of at least ``ROOM`` len(s) cells (a power of two, 64 or more), as words.

    Two sets' sketches differ in no more cells than the sets differ in elements; folding halves keeps that.
    """
    cells = max(64, ROOM << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def bands_for(n: int, threshold: float) -> range:
    """The bands in which a set of n elements meets its partners: its own, and those of smaller partners."""
    return range(band_of(max(1, math.ceil(threshold * n - 1e-9))), band_of(n) + 1)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sketch): the size of each set, 128 bits that stand for it, and its parities."""

    def make():
        shingles = Shingler(size)

        def work(text: bytes | None):
            s = shingles(text)
            return (len(s), *folded(s), sketch(s)) if len(s) else (0, None, None, None)

        return work

    return map_texts(docs, make, "n_shingles long, set_a long, set_b long, sketch array<long>", keep=["doc_id"])


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(text, h) of the rows that can be linked; ``h`` is a hash of the id."""
    return docs.where("doc_id is not null and text is not null").select(F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id").alias("h"))


def lead_key() -> Column:
    """Of a node: 64 bits of its set and of the smallest id that has it."""
    return F.col("set_a").bitwiseXOR(F.xxhash64("class_id"))


def index_rows(docs: DataFrame, size: int, threshold: float, leads, bitmaps=None) -> DataFrame:
    """(sig, set_a, set_b): every signature of every distinct set. Rows whose id and set are not in the bitmap ``leads``
    (broadcast) are copies of an indexed row. With ``bitmaps`` (broadcast: signatures that several sets have, and popular
    ones) only what is in the first, without the costliest that each set may leave out."""

    def packed(parts):
        sigs = np.concatenate([p[0] for p in parts])
        times = [len(p[0]) for p in parts]
        sets = [pa.array(np.repeat(np.array([p[k] for p in parts], np.int64), times)) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), *sets], names=["sig", "set_a", "set_b"])

    def run(batches):
        shingles = Shingler(size)
        first = leads.value
        met, popular = (None, None) if bitmaps is None else bitmaps.value
        for batch in batches:
            parts, held = [], 0
            for text, h in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = shingles(text.as_py())
                if not len(s):
                    continue
                set_a, set_b = folded(s)
                if not in_bitmap(first, np.array([set_a ^ h], np.int64).view(np.uint64))[0]:
                    continue
                for b in bands_for(len(s), threshold):
                    exact, sizes, around, spare = signatures(s, b, threshold)
                    if met is not None:
                        hit = in_bitmap(met, exact)
                        exact, around = exact[hit], around[in_bitmap(met, around)]
                        exact = exact[costly_first(exact, sizes[hit], popular)[spare:]] if len(exact) > spare else exact[:0]
                    for sigs in (exact, around):
                        if len(sigs):
                            parts.append((sigs, set_a, set_b))
                            held += len(sigs)
                if held > 300_000:
                    yield packed(parts)
                    parts, held = [], 0
            if held:
                yield packed(parts)

    return keyed_texts(docs).mapInArrow(run, "sig long, set_a long, set_b long")


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of ``CELLS`` cells, of which those that a value falls in are set. Its size is fixed; values that share
    a cell only let through rows that a later join drops."""
    cell = F.col(column).bitwiseAND(F.lit(CELLS - 1))
    packed = values.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(CELLS >> 6, np.uint64)
    out[packed.column("at").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return out


#: Pairs that are verified beside one copy of their common side.
BESIDE = 512


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets reach the threshold; counted on the whole sets.

    The side that stands in more pairs is sent once for each ``BESIDE`` of them, and the others pass by it in a sorted
    stream, so a hub's text is neither repeated for each pair nor bound to one task.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("times"))
    ids = stored(ids.join(nodes.select("node", "class_id", "set_a", "set_b"), "node"))
    wanted = pairs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("class_id").alias("h")), "h"))

    def among(batches):
        shingles, bits = Shingler(size), wanted.value
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits, batch.column(1).to_numpy().view(np.uint64))))
            found = [folded(shingles(text.as_py())) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=["text", "h", "set_a", "set_b"])

    texts = keyed_texts(docs).mapInArrow(among, "text binary, h long, set_a long, set_b long")
    texts = texts.join(ids.select("node", "set_a", "set_b", F.xxhash64("class_id").alias("h")), ["set_a", "set_b", "h"])
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]))
    times = ids.select("node", "times")
    sided = pairs.join(times.withColumnsRenamed({"node": "a", "times": "ta"}), "a").join(times.withColumnsRenamed({"node": "b", "times": "tb"}), "b")
    more, less = F.when(F.col("ta") >= F.col("tb"), F.struct(F.col("a").alias("n"), F.col("ta").alias("t"), F.col("b").alias("o"))), F.struct(F.col("b").alias("n"), F.col("tb").alias("t"), F.col("a").alias("o"))
    sided = sided.select(F.coalesce(more, less).alias("x")).select(F.col("x.n").alias("hub"), F.col("x.o").alias("other"), F.pmod(F.xxhash64("x.o"), F.ceil(F.col("x.t") / BESIDE)).alias("salt"))
    sided = stored(sided)
    first = sided.select("hub", "salt").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("other"), "text")
    rest = sided.join(texts.withColumnRenamed("node", "other"), "other").select("hub", "salt", "other", "text")
    rows = first.unionByName(rest).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("other"))
    percent = round(threshold * 100)

    def run(batches):
        shingles, x = Shingler(size), np.empty(0, np.uint64)
        for batch in batches:
            hubs, others, keep = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for hub, other, text in zip(hubs, others, batch.column(3), strict=True):
                y = shingles(text.as_py())
                if other is None:
                    x = y
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append((min(hub, other), max(hub, other)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in keep], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b). Each round hangs nodes under the smallest
    neighbour and points them at its own smallest, so that chains shorten by half; no group is gathered."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        # Larger neighbours and the node itself are pointed at the smallest neighbour (large star), then smaller ones (small star).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = stored(small)
        same = after.join(now, ["u", "v"], "left_anti").limit(1).count() == 0 and now.join(after, ["u", "v"], "left_anti").limit(1).count() == 0
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def buckets(docs: DataFrame, nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """(sig, node, n, class_id): the nodes that meet under a signature which they don't leave out."""
    context = docs.sparkSession.sparkContext
    leads = context.broadcast(bitmap(nodes.select(lead_key().alias("h")), "h"))
    met = stored(index_rows(docs, size, threshold, leads).groupBy("sig").agg(F.count("*").alias("c")).where("c > 1"))
    bitmaps = context.broadcast((bitmap(met, "sig"), bitmap(met.where(F.col("c") >= POPULAR), "sig")))
    rows = index_rows(docs, size, threshold, leads, bitmaps).join(nodes.select("set_a", "set_b", "node", "n", "class_id"), ["set_a", "set_b"])
    return stored(rows.groupBy("sig", "node").agg(F.first("n").alias("n"), F.first("class_id").alias("class_id")))


def near_enough(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sketches don't rule the threshold out. ``nodes``: node, n, sketch."""
    side = lambda v: nodes.select(F.col("node").alias(v), F.col("n").alias(f"n_{v}"), F.col("sketch").alias(f"s_{v}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda u, v: u.bitwiseXOR(v))
    x, y = F.col("s_a"), F.col("s_b")
    # Sizes of a pair are within the threshold's ratio, so one sketch is at most twice as long.
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v)).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v)
    most = F.floor((1 - threshold) / (1 + threshold) * (F.col("n_a") + F.col("n_b")) + 1e-9)
    return both.where(apart <= most).select("a", "b")


def linked(docs: DataFrame, nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """(node, component) of the ``nodes`` (node, class_id, set_a, set_b, n, sketch) that are linked."""
    rows = buckets(docs, nodes, size, threshold)
    percent = round(threshold * 100)
    close = lambda x, y: (F.col(x) * percent <= F.col(y) * 100) & (F.col(y) * percent <= F.col(x) * 100)
    # A bucket's first member is the one with the smallest id, as originals come before their copies more often than not.
    place = F.struct("class_id", "node")
    hubs = rows.groupBy("sig").agg(F.min_by("node", place).alias("hub"), F.min_by("n", place).alias("hub_n"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = rows.join(hubs, "sig").where((F.col("node") != F.col("hub")) & close("n", "hub_n"))
    first = stored(met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    edges = stored(verified(stored(near_enough(first, nodes, threshold)), docs, nodes, size, threshold))
    parts = stored(components(edges))
    # What is left: pairs of different components in one bucket, neither of them its first member. One of the two lies
    # outside the first member's component.
    named = stored(rows.join(hubs.select("sig"), "sig", "left_semi").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
    spread = named.groupBy("sig").agg(F.min_by("node", place).alias("hub"), F.min_by("component", place).alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo < hi and c > 2").select("sig", "hub", "main", "c")
    inner = named.join(spread, "sig").where("node != hub").drop("hub", "class_id").join(nodes.select("node", "sketch"), "node")
    second = stored(apart_but_near(inner, threshold).distinct())
    if second.limit(1).count() == 0:
        return parts
    more = stored(verified(second, docs, nodes, size, threshold))
    return components(edges.unionByName(more)) if more.limit(1).count() else parts


#: Members of a bucket that one task compares at a time.
BLOCK = 2048


def apart_but_near(inner: DataFrame, threshold: float) -> DataFrame:
    """(a, b): members of one bucket in different components whose sizes and sketches don't rule the threshold out.

    ``inner``: sig, node, n, component, main (its bucket's first component), c (its size), sketch. Rows are sorted by
    bucket and compared in a running pass; a bucket of more than ``BLOCK`` members is dealt to blocks, and pairs of
    blocks go to tasks of their own. Pairs that a sketch rules out never become rows.
    """
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = inner.withColumns({"k": blocks, "at": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    spots = F.sequence(F.lit(0), F.col("k") - 1)
    pairs_of = F.when(F.col("k") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.array_union(F.transform(spots, lambda j: F.struct(F.col("at").alias("i"), j.alias("j"))), F.transform(spots, lambda i: F.struct(i.alias("i"), F.col("at").alias("j"))))
    )
    rows = dealt.withColumn("x", F.explode(pairs_of)).select("sig", "x.i", "x.j", "at", "node", "n", "component", "main", "sketch")
    rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    share = (1 - threshold) / (1 + threshold)
    percent = round(threshold * 100)

    def shorter(sketches: np.ndarray) -> np.ndarray:
        """Sketches of half the cells."""
        half = sketches.shape[-1] // 2
        return sketches[..., :half] ^ sketches[..., half:]

    def compared(key, members, found):
        _, i, j = key
        groups = {}
        for y in members:
            if y[5] == j:
                groups.setdefault(len(y[4]), []).append(y)
        right = {}
        for words, ys in groups.items():
            sketches = np.stack([y[4] for y in ys])
            right[words] = (*(np.array([y[k] for y in ys], np.int64) for k in range(4)), sketches, shorter(sketches) if words > 1 else None)
        for x in members:
            if x[5] != i or x[2] == x[3]:
                continue
            words = len(x[4])
            for w in (words // 2, words, 2 * words):  # sizes within the threshold's ratio: one sketch is at most twice as long
                if w not in right:
                    continue
                node, n, component, main, sketches, halves = right[w]
                mine, theirs = (x[4], sketches) if w == words else (shorter(x[4]), sketches) if w < words else (x[4], halves)
                ok = (component != x[2]) & ((component == main) | (node > x[0])) & (x[1] * percent <= n * 100) & (n * percent <= x[1] * 100)
                ok &= np.bitwise_count(theirs ^ mine).sum(1) <= np.floor(share * (x[1] + n) + 1e-9)
                found.update((min(x[0], y), max(x[0], y)) for y in node[ok].tolist())

    def out(found):
        got = sorted(found)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in got], pa.int64()), pa.array([p[1] for p in got], pa.int64())], names=["a", "b"])

    def run(batches):
        last, members, found = None, [], set()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            words = batch.column(8)
            for r, (sig, i, j, at, node, n, component, main) in enumerate(zip(*columns, strict=True)):
                if (sig, i, j) != last:
                    if len(members) > 1:
                        compared(last, members, found)
                    last, members = (sig, i, j), []
                members.append((node, n, component, main, words[r].values.to_numpy().view(np.uint64), at))
            if len(found) > 100_000:
                yield out(found)
        if len(members) > 1:
            compared(last, members, found)
        yield out(found)

    return rows.mapInArrow(run, "a long, b long")


def in_components(docs: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows (doc_id, n_shingles, set_a, set_b), and (set_a, set_b, class_id, component) of the nodes."""
    sets = stored(shingle_sets(docs, size))
    usable = sets.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()))  # written once, so ids stay
    parts = linked(docs, nodes, size, threshold)
    return sets, stored(nodes.join(parts, "node", "left").select("set_a", "set_b", "class_id", F.coalesce("component", "node").alias("component")))


def jaccard_join(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): the size of each row's set, the smallest id linked to it over any
    chain of links, and the smallest id with the very same set. ``docs`` needs doc_id and text."""
    sets, nodes = in_components(docs, size, threshold)
    named = nodes.join(nodes.groupBy("component").agg(F.min("class_id").alias("component_id")), "component").select("set_a", "set_b", "class_id", "component_id")
    known = F.col("doc_id").isNotNull()  # a set without words is null and meets nothing
    return sets.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left").select(
        "doc_id", "n_shingles", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id")
    )


def first_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row with the smallest id stays.

    Of several such rows the one whose text and then other columns come first by hash and as JSON stays. Rows without id,
    and rows with an empty set, stay. Texts are shuffled only for ids of which a row goes (and those that share a bitmap
    cell with one).
    """
    sets, nodes = in_components(docs, size, threshold)
    leads = stored(nodes.groupBy("component").agg(F.min(F.struct("class_id", "set_a", "set_b")).alias("x")).select(F.col("x.class_id").alias("doc_id"), "x.set_a", "x.set_b", F.lit(True).alias("lead")))
    rows = sets.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id", "set_a", "set_b").agg(F.count("*").alias("c"))
    hit = rows.join(leads, ["doc_id", "set_a", "set_b"], "left").where("lead is null or c > 1")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(hit.select(F.xxhash64("doc_id").alias("h")), "h"))
    h, a, b = unused(docs.columns, "h", "set_a", "set_b")
    names = [*docs.columns, a, b]

    def flags(batches):
        shingles, bits = Shingler(size), wanted.value
        for batch in batches:
            at = batch.num_columns - 2
            got = in_bitmap(bits, batch.column(at).to_numpy().view(np.uint64))
            found = [folded(s) if met and len(s := shingles(text.as_py())) else (None, None) for met, text in zip(got, batch.column(at + 1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))], names=names)

    hashed = docs.select("*", F.xxhash64("doc_id").alias(h), F.col("text").cast("binary").alias(a))
    marked = hashed.mapInArrow(flags, T.StructType([*docs.schema.fields, T.StructField(a, T.LongType()), T.StructField(b, T.LongType())]))
    free = F.col("doc_id").isNull() | F.col(a).isNull()
    sure = marked.where(free).drop(a, b)
    checked = marked.where(~free).join(leads.select("doc_id", F.col("set_a").alias(a), F.col("set_b").alias(b)), ["doc_id", a, b], "left_semi")
    whole = F.struct(*docs.columns)
    one = checked.groupBy("doc_id", a, b).agg(F.min_by(whole, F.struct(F.xxhash64("text"), F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))).alias(h))
    return sure.unionByName(one.select(f"{h}.*"))
