"""Diverse samples: a truncated SVD of a sparse term matrix, and k-means on it with one document for each cluster.

The matrix stays a table, a row of (terms, weights) a document. What goes through the driver is of fixed size: the basis
(terms x dimensions), sums of products with it, and cluster centres; no document's row or embedding does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseload.functions import scalars as S
from caseload.functions.text import let
from caseload.operators import order as O
from caseload.session import stored

SPARSE = "doc_id long, terms array<int>, weights array<double>"
COUNTED = "doc_id long, terms array<int>, counts array<long>"
#: Documents whose products are held at once.
ROWS = 2048


def term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct terms of each row, in order, and how often each stands there."""
    for batch in batches:
        got = [np.unique(np.asarray(t, np.int32), return_counts=True) for t in batch["terms"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "terms": [t for t, _ in got], "counts": [k for _, k in got]})


def one_row_an_id(counts: DataFrame) -> DataFrame | None:
    """Rows that share an id, or have none, as one, with the counts of all of them; None if there are none such. Only their
    counts are sent."""
    shared = stored(counts.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id is null").select(F.col("doc_id").alias("id")))
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    if not shared.count():
        return None
    each = counts.join(shared, same, "left_semi").select("doc_id", F.explode(F.arrays_zip("terms", "counts")).alias("e")).select("doc_id", "e.terms", "e.counts")
    at = each.groupBy("doc_id", "terms").agg(F.sum("counts").alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("terms", "n"))).alias("es"))
    return stored(counts.join(shared, same, "left_anti").unionByName(at.select("doc_id", F.col("es.terms").alias("terms"), F.col("es.n").alias("counts"))))


def term_rows(docs: DataFrame, buckets: int = 1 << 14, min_docs: int = 2) -> DataFrame:
    """(doc_id, terms, weights): hashed words and word pairs, 1 + ln(count) times inverse document frequency, of length one.

    A document of no term in ``min_docs`` documents has empty arrays; null text is empty.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    pairs = lambda ws: F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    keys = let(words, lambda ws: F.transform(F.concat(ws, pairs(ws)), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")))
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    dealt = docs if docs.rdd.getNumPartitions() >= tasks else docs.repartition(tasks)  # a table of few files is small
    counts = stored(dealt.select("doc_id", keys.alias("terms")).mapInPandas(term_counts, COUNTED))
    merged = one_row_an_id(counts)
    n = docs.count()

    def met(total: np.ndarray, batch: pd.DataFrame) -> None:
        total[:, 0] += np.bincount(np.concatenate([np.empty(0, np.int64), *batch["terms"]]).astype(np.int64), minlength=buckets)

    df = summed(counts if merged is None else merged, 1, met, buckets)[:, 0]
    idf = np.where(df >= min_docs, np.log((1.0 + n) / (1.0 + df)) + 1, 0.0)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms, weights = [], []
            for t, k in zip(batch["terms"], batch["counts"], strict=True):
                held = idf[t] > 0
                v = (1 + np.log(k[held])) * idf[t[held]]
                terms.append(t[held])
                weights.append(v / np.sqrt(v @ v) if len(v) else v)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "terms": terms, "weights": weights})

    if merged is None:
        return counts.mapInPandas(weigh, SPARSE)
    none = lambda t: F.array().cast(t)
    rows = docs.select("doc_id").join(merged.mapInPandas(weigh, SPARSE), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("terms", none("array<int>")).alias("terms"), F.coalesce("weights", none("array<double>")).alias("weights"))


def products(rows: pd.DataFrame, basis: np.ndarray) -> np.ndarray:
    """Each row's product with the basis."""
    sizes = rows["terms"].map(len).to_numpy()
    out = np.zeros((len(rows), basis.shape[1]))
    if sizes.sum():
        terms, weights = np.concatenate(list(rows["terms"])), np.concatenate(list(rows["weights"]))
        some = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        out[some] = np.add.reduceat(basis[terms] * weights[:, None], starts, axis=0)
    return out


def summed(rows: DataFrame, width: int, add: Callable[[np.ndarray, pd.DataFrame], None], height: int) -> np.ndarray:
    """A height x width sum over all rows: each task adds up its own, then rows of the sum are added by place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((height, width))
        for batch in batches:
            for s in range(0, len(batch), ROWS):
                add(total, batch.iloc[s : s + ROWS])
        at = np.flatnonzero(total.any(1))
        yield pd.DataFrame({"place": at.astype(np.int32), "part": pd.Series(list(total[at]), dtype=object)})

    parts = rows.mapInPandas(run, "place int, part array<double>")
    sums = parts.groupBy("place").agg(*[F.sum(F.col("part")[j]).alias(f"s{j}") for j in range(width)])
    out = np.zeros((height, width))
    for r in sums.collect():  # height x width numbers, whatever the number of documents
        out[r[0]] = r[1:]
    return out


def truncated_svd(rows: DataFrame, terms: int, dims: int, passes: int = 4, extra: int = 8, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors as columns) of the matrix, by randomised subspace iteration: each pass is one
    aggregate over all rows."""
    width = min(dims + extra, terms)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]

    def onto_terms(total: np.ndarray, batch: pd.DataFrame) -> None:
        y = products(batch, basis)
        for k, (t, w) in enumerate(zip(batch["terms"], batch["weights"], strict=True)):
            if len(t):
                total[t] += np.outer(w, y[k])  # a row's terms are distinct

    def inner(total: np.ndarray, batch: pd.DataFrame) -> None:
        y = products(batch, basis)
        total += y.T @ y

    for _ in range(passes):
        basis = np.linalg.qr(summed(rows, width, onto_terms, terms))[0]
    squares, turn = np.linalg.eigh(summed(rows, width, inner, width))
    best = np.argsort(squares)[::-1][:dims]
    return np.sqrt(np.maximum(squares[best], 0)), basis @ turn[:, best]


def embedded(rows: DataFrame, right: np.ndarray) -> DataFrame:
    """(doc_id, z): each row on the right vectors, of length one; zeros stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), ROWS):
                part = batch.iloc[s : s + ROWS]
                y = products(part, right)
                size = np.linalg.norm(y, axis=1, keepdims=True)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "z": list(y / np.where(size > 0, size, 1))})

    return rows.mapInPandas(run, "doc_id long, z array<double>")


def nearest_centre(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` with their ``cluster`` (ties: the first) and ``gap``, the squared distance to its centre."""
    squares = (centres**2).sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), ROWS):
                part = batch.iloc[s : s + ROWS].reset_index(drop=True)
                z = np.stack(part["z"].to_list())
                far = squares[None, :] - 2 * z @ centres.T
                best = far.argmin(1)
                gap = ((z - centres[best]) ** 2).sum(1)
                yield part.assign(cluster=best.astype(np.int32), gap=gap)

    return points.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields) + ", cluster int, gap double")


def means(placed: DataFrame, dims: int) -> dict[int, tuple[int, np.ndarray]]:
    """Size and sum of each cluster's points."""
    got = placed.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("z")[j]).alias(f"z{j}") for j in range(dims)])
    return {r["cluster"]: (r["n"], np.array(r[2:])) for r in got.collect()}  # a row a cluster


def mini_batch_centres(points: DataFrame, k: int, dims: int, batch: int, rounds: int, seed: str) -> np.ndarray:
    """Centres by mini-batches: hashes deal points to batches of about ``batch``; a centre moves towards the mean of its new
    points by their share of all that it has met. It starts as the mean of a k-th of the first batch, dealt by hash."""
    n = points.count()
    deals = max(1, -(-n // max(batch, 3 * k)))
    dealt = stored(points.withColumn("deal", F.floor(S.uniform(seed, "deal", F.col("doc_id")) * deals).cast("int")).repartition("deal"))
    first = dealt.where("deal = 0").withColumn("cluster", F.floor(S.uniform(seed, "start", F.col("doc_id")) * k).cast("int"))
    centres, met = np.random.default_rng(len(seed)).standard_normal((k, dims)), np.zeros(k)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    for c, (size, total) in means(first, dims).items():
        centres[c] = total / max(np.linalg.norm(total), 1e-12) if size else centres[c]
    for r in range(rounds):
        for c, (size, total) in means(nearest_centre(dealt.where(F.col("deal") == r % deals), centres), dims).items():
            met[c] += size
            centres[c] += (total - size * centres[c]) / met[c]
    return centres


def diversity_sample(docs: DataFrame, n: int, dims: int = 100, buckets: int = 1 << 14, batch: int = 4096, rounds: int = 10, seed: str = "diverse") -> DataFrame:
    """(doc_id, cluster, gap): ``n`` documents (all, if fewer), each nearest to the centre of one of ``n`` clusters (ties:
    smaller id); where clusters are empty, further documents by hash, whose cluster and gap are null."""
    rows = stored(term_rows(docs, buckets))
    n = min(n, rows.count())
    if not n:
        return rows.select("doc_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("gap"))
    dims = min(dims, buckets - 1)
    _, right = truncated_svd(rows, buckets, dims)
    points = stored(embedded(rows, right))
    placed = nearest_centre(points, mini_batch_centres(points, n, dims, batch, rounds, seed))
    picked = stored(placed.groupBy("cluster").agg(F.min(F.struct("gap", "doc_id")).alias("best")).select("best.doc_id", "cluster", "best.gap"))
    empty = n - picked.count()
    if not empty:
        return picked
    rest = points.select("doc_id").join(picked, "doc_id", "left_anti")
    drawn = O.lowest(rest, S.uniform(seed, "refill", F.col("doc_id")), "doc_id", empty)
    return picked.unionByName(drawn.select("doc_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("gap")))
