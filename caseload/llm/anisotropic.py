"""Nearest neighbours by inner product: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

Vectors are cut into pairs of dimensions, each coded by one of 16 centres. The quantisation loss weighs the part of the
residual that is parallel to the vector more than the rest, as that is what changes large inner products; codes are
chosen by coordinate descent under that loss, and centres solve its normal equations. A scan adds up, for each query,
byte-wide table entries for the four-bit codes of a block's vectors; the best by that estimate are scored again on the
original vectors. An exact check follows: an estimate misses a product by no more than the rounding of its table entries
and the query's length times what the codes leave of the vector, and every vector that can so reach the block's ``k``-th
best is scored too. So a block gives its true nearest, also where codes can't tell its vectors apart.

Every vector is indexed. Vectors lie in coarse cells, larger cells in several blocks of bounded size. A query visits the
cells whose centres have the largest inner products with it; how many is found by calibration: a fixed number of
queries is searched exactly, and enough cells are visited for the wanted share of their neighbours. So the number follows
the data: few cells where vectors cluster, about half of them where they don't. Cells are visited in rounds, each four
times as many as before, and a round passes on only what beats the ``k``-th best found so far: the rows that leave the
scans are a few times ``k`` for each query, however many vectors and blocks there are. Vectors are sent once a round.

Defined results for odd input: vectors that are null, zero, hold null or non-finite components, or have another length
than most, take no part, and neither do rows without id; a query never finds a row with its own id; of several query rows
with one id the smallest vector asks; equal scores go to the smaller id; repeated rows are candidates each; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload.session import stored

CENTRES, WIDTH = 16, 2
#: Coarse cells at most: their centres are broadcast. Larger tables have more blocks in each cell.
MAX_CELLS = 1024


class Quantiser:
    """Centres fitted to a sample, and the codes that they give a vector."""

    def __init__(self, sample: np.ndarray, threshold: float = 0.2, rounds: int = 4, seed: int = 1):
        self.dim = sample.shape[1]
        self.parts = (self.dim + WIDTH - 1) // WIDTH
        self.weight = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        x, unit = self.split(sample)
        rng = np.random.default_rng(seed)
        pick = rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)
        self.centres = x[pick].transpose(1, 0, 2).copy()  # part, centre, WIDTH
        for _ in range(rounds):
            code = self.codes(sample)
            residual = x - self.chosen(code)
            along = (residual * unit).sum(2)
            whole = along.sum(1)
            for m in range(self.parts):
                a = np.eye(WIDTH) + (self.weight - 1) * unit[:, m, :, None] * unit[:, m, None, :]
                right = (a @ x[:, m, :, None])[..., 0] + (self.weight - 1) * unit[:, m] * (whole - along[:, m])[:, None]
                left_sum, right_sum = np.zeros((CENTRES, WIDTH, WIDTH)), np.zeros((CENTRES, WIDTH))
                np.add.at(left_sum, code[:, m], a)
                np.add.at(right_sum, code[:, m], right)
                used = np.bincount(code[:, m], minlength=CENTRES) > 0
                self.centres[m, used] = np.linalg.solve(left_sum[used] + 1e-9 * np.eye(WIDTH), right_sum[used][..., None])[..., 0]
                residual[:, m] = x[:, m] - self.centres[m][code[:, m]]
                whole += (residual[:, m] * unit[:, m]).sum(1) - along[:, m]
                along[:, m] = (residual[:, m] * unit[:, m]).sum(1)

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and their directions, cut into parts."""
        v = np.zeros((len(vectors), self.parts * WIDTH))
        v[:, : self.dim] = vectors
        v = v.reshape(len(v), self.parts, WIDTH)
        return v, v / np.sqrt((v * v).sum((1, 2), keepdims=True))

    def chosen(self, code: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.parts)[None], code]

    def codes(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres."""
        x, unit = self.split(vectors)
        code = np.empty(x.shape[:2], np.int64)
        for m in range(self.parts):
            code[:, m] = ((x[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1)
        whole = ((x - self.chosen(code)) * unit).sum((1, 2))
        rows = np.arange(len(x))
        for _ in range(sweeps):
            for m in range(self.parts):
                off = x[:, m, None] - self.centres[m]
                along = (off * unit[:, m, None]).sum(2)
                rest = whole - along[rows, code[:, m]]
                code[:, m] = ((off * off).sum(2) + (self.weight - 1) * (rest[:, None] + along) ** 2).argmin(1)
                whole = rest + along[rows, code[:, m]]
        return code

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        code = self.codes(vectors).astype(np.uint8)
        if self.parts % 2:
            code = np.pad(code, ((0, 0), (0, 1)))
        return code[:, ::2] << 4 | code[:, 1::2]

    def unpacked(self, packed: np.ndarray) -> np.ndarray:
        """Codes by part, from two to a byte."""
        return np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, : self.parts].T

    def left(self, code: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """How far each vector lies from what its codes (by part) stand for."""
        x, _ = self.split(vectors)
        return np.sqrt(((x - self.chosen(code.T)) ** 2).sum((1, 2)))

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each part and query, what each code adds to the inner product, as a byte; a query's tables have one scale.
        Besides, that scale and what the tables leave out, for each query."""
        q, _ = self.split(queries)
        one = np.einsum("qmw,mcw->mqc", q, self.centres)
        least = one.min(2, keepdims=True)
        one -= least
        scale = np.maximum(one.max((0, 2)), 1e-30) / 255
        return np.rint(one / scale[None, :, None]).astype(np.uint8), scale, least.sum((0, 2))


class Cells:
    """Centres of coarse cells, by a few rounds of k-means over a sample."""

    def __init__(self, sample: np.ndarray, n: int, rounds: int = 8, seed: int = 1):
        self.centres = sample[np.random.default_rng(seed).choice(len(sample), n, replace=False)].copy()
        for _ in range(rounds):
            of = self.cell(sample)
            for c in np.unique(of):
                self.centres[c] = sample[of == c].mean(0)

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector."""
        half = (self.centres**2).sum(1) / 2
        parts = [(vectors[i : i + 4096] @ self.centres.T - half).argmax(1) for i in range(0, len(vectors), 4096)]
        return np.concatenate([np.empty(0, np.int64), *parts])

    def order(self, queries: np.ndarray) -> np.ndarray:
        """Cells by falling inner product of query and centre."""
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column, of lists of one length, as a matrix."""
    joined = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = joined.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(joined), -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: (vec_id, embedding)."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)))
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == (usual["d"] if usual else 0))


def fit(rows: DataFrame, n: int, sample: int, cell_rows: int) -> tuple[Quantiser, Cells]:
    """Quantiser and cells fitted to the ``sample`` rows whose ids hash lowest; that bound holds for any table."""
    got = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column("embedding"))
    return Quantiser(got[:8192]), Cells(got, max(1, min(MAX_CELLS, n // cell_rows, len(got) // 16)))


def probes_for(index: DataFrame, queries: DataFrame, cells: Cells, k: int, recall: float, asked: int) -> int:
    """How many cells hold the ``recall`` share of the ``k`` nearest of ``asked`` queries, which are searched exactly."""
    few = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(asked).toArrow()
    ids, vectors = few.column("vec_id").to_numpy(), matrix(few.column("embedding"))

    def nearest(batches):
        best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            at, cell, here = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            scores = vectors @ here.T
            for i in range(len(ids)):
                scores[i, at == ids[i]] = -np.inf
                top = np.argpartition(-scores[i], min(k, len(at) - 1))[:k]
                top = top[at[top] != ids[i]]
                score, where = np.concatenate([best[i][0], scores[i][top]]), np.concatenate([best[i][1], cell[top]])
                keep = np.argsort(-score, kind="stable")[:k]
                best[i] = score[keep], where[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(ids)), [len(b[0]) for b in best]), pa.int32()), pa.array(np.concatenate([np.empty(0), *(b[0] for b in best)])), pa.array(np.concatenate([np.empty(0, np.int64), *(b[1] for b in best)]), pa.int32())],
            names=["i", "score", "cell"],
        )

    rows = index.select("vec_id", "cell", "embedding").mapInArrow(nearest, "i int, score double, cell int")
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "cell"))
    found = rows.withColumn("place", place).where(F.col("place") <= k).select("i", "cell").toArrow()
    if not found.num_rows:
        return 1
    visit = np.argsort(cells.order(vectors), axis=1)[found.column("i").to_numpy(), found.column("cell").to_numpy()]
    return int(np.sort(visit)[int(np.ceil(recall * len(visit))) - 1]) + 1


def scanned(quantiser: Quantiser, k: int, rerank: int):
    """A pass over blocks, each of vectors followed by queries: (query_id, vec_id, score) of what beats a query's floor."""

    def best(ids, code, vectors, left, norms, q_ids, queries, floors):
        out, every = [], np.arange(len(ids))
        for start in range(0, len(q_ids), 64):
            part = slice(start, start + 64)
            q, own = queries[part], q_ids[part]
            tables, scale, base = quantiser.tables(q)
            estimate = np.zeros((tables.shape[1], len(ids)), np.uint16 if len(code) * 255 < 1 << 16 else np.uint32)
            for m in range(len(code)):
                estimate += np.take(tables[m], code[m], axis=1)
            long = np.sqrt((q * q).sum(1))
            slack = 1e-12 * long * norms.max()
            floor = floors[part].astype(np.float64)
            if rerank < len(ids):  # the best estimates give a floor that all others have to reach
                top = np.argpartition(estimate, len(ids) - rerank, axis=1)[:, len(ids) - rerank :]
                exact = np.einsum("qd,qrd->qr", q, vectors[top])
                exact[own[:, None] == ids[top]] = -np.inf
                if rerank >= k:
                    floor = np.maximum(floor, np.partition(exact, rerank - k, axis=1)[:, rerank - k])
            reach = (base + scale * len(code) / 2)[:, None] + scale[:, None] * estimate + long[:, None] * left
            able = np.flatnonzero((reach >= (floor - slack)[:, None]).any(0)) if rerank < len(ids) else every
            near = q @ vectors[able].T
            near[own[:, None] == ids[able]] = -np.inf
            if k < len(able):
                floor = np.maximum(floor, np.partition(near, len(able) - k, axis=1)[:, len(able) - k])
            at, of = np.nonzero((near >= (floor - slack)[:, None]) & (near > -np.inf))
            of = able[of]
            score = np.concatenate([np.empty(0), *(np.einsum("rd,rd->r", q[at[i : i + 16384]], vectors[of[i : i + 16384]]) for i in range(0, len(at), 16384))])
            beats = score >= floors[part][at]
            at, of, score = at[beats], of[beats], score[beats]
            order = np.lexsort((ids[of], -score, at))
            at, of, score = at[order], of[order], score[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            out.append((own[at[keep]], ids[of[keep]], score[keep]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["query_id", "vec_id", "score"])

    def run(batches):
        at, held, block = None, [], None
        for batch in batches:
            cell, sub, floor = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            asks = ~np.isnan(floor)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                if end == start:
                    continue
                part = batch.slice(start, end - start)
                if (cell[start], sub[start]) != at:
                    at, held, block = (cell[start], sub[start]), [], None
                if not asks[start]:
                    held.append(part)
                elif held:
                    if block is None:
                        whole = pa.Table.from_batches(held).sort_by("vec_id").combine_chunks()
                        packed = np.frombuffer(b"".join(whole.column("code").to_pylist()), np.uint8).reshape(whole.num_rows, -1)
                        code, vectors = quantiser.unpacked(packed), matrix(whole.column("embedding"))
                        block = whole.column("vec_id").to_numpy(), code, vectors, quantiser.left(code, vectors), np.sqrt((vectors * vectors).sum(1))
                    yield best(*block, part.column(3).to_numpy(), matrix(part.column(4)), floor[start:end])

    return run


def search(vectors: DataFrame, is_query, k: int = 20, cell_rows: int = 1024, rerank: int = 64, recall: float = 0.97, asked: int = 128, sample: int = 32_768) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) with ``is_query``, the nearest ``k``
    found among all other rows.

    ``cell_rows``: vectors of a cell; ``rerank``: estimates of each block that are scored first; ``recall``: share of
    the neighbours of ``asked`` queries that must lie in the visited cells; ``sample``: rows that cells are fitted to.
    """
    rows = usable(vectors)
    n = rows.count()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    quantiser, cells = fit(rows, n, sample, cell_rows)
    kind = rows.schema["embedding"].dataType.simpleString()

    def encode(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                v = matrix(part.column(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.cell(v), pa.int32()), pa.array([c.tobytes() for c in quantiser.packed(v)], pa.binary())], names=["vec_id", "embedding", "cell", "code"])

    index = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(encode, f"vec_id long, embedding {kind}, cell int, code binary"))
    queries = stored(index.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    if not queries.limit(1).count():
        return empty
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}
    parts = F.element_at(F.lit([max(1, -(-sizes.get(c, 0) // (4 * cell_rows))) for c in range(len(cells.centres))]), F.col("cell") + 1)
    probes = probes_for(index, queries, cells, k, recall, asked)
    dealt = index.withColumn("sub", F.pmod(F.xxhash64("vec_id"), parts)).select("cell", "sub", F.lit(float("nan")).alias("floor"), "vec_id", "embedding", "code")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, low, high = None, 0, min(2, probes)
    while low < probes:

        def visits(batches, low=low, high=high):
            for batch in batches:
                to = cells.order(matrix(batch.column(1)))[:, low:high]
                at = pa.array(np.repeat(np.arange(batch.num_rows), to.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(to.ravel(), pa.int32())], names=["vec_id", "embedding", "floor", "cell"])

        floors = queries.withColumn("floor", F.lit(float("-inf")))
        if found is not None:
            least = found.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= k).select(F.col("query_id").alias("vec_id"), "s")
            floors = queries.join(least, "vec_id", "left").select("vec_id", "embedding", F.coalesce("s", F.lit(float("-inf"))).alias("floor"))
        asking = floors.select("vec_id", "embedding", "floor").mapInArrow(visits, f"vec_id long, embedding {kind}, floor double, cell int")
        asking = asking.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).select("cell", "sub", "floor", "vec_id", "embedding", F.lit(None).cast("binary").alias("code"))
        blocks = dealt.unionByName(asking).repartition("cell", "sub").sortWithinPartitions("cell", "sub", F.desc(F.isnan("floor")))
        new = blocks.mapInArrow(scanned(quantiser, k, rerank), "query_id long, vec_id long, score double")
        both = new if found is None else found.unionByName(new)
        found = stored(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        low, high = high, min(4 * high, probes)
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
