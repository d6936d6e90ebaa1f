"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Fit (on the driver, from at most ``SAMPLE`` vectors, those with the smallest hash of their id): coarse centroids by
k-means, as many as the square root of the number of rows (``MAX_CELLS`` at most), how far each cell's vectors spread around
its centroid, and one codebook per slice of the dimensions for the residuals.

A vector of a cell with centroid c reaches an inner product with q of about q.c + z |q| s, where s is the cell's spread along a direction; cells are
ranked and chosen by that bound, so vectors of any length are found. ``z`` is fitted: the least that would find ``TARGET`` of the sample's
true neighbours.

Index: every vector gets its cell and its codes; the table is written to the shared folder.

Search: cells are packed into blocks of about ``BLOCK`` rows, a cell that outgrows a block is split over several. Rows go to their block
once; queries go to the blocks of the cells that they probe and stream past the rows there. A task computes asymmetric distances from
tables (query slices against codebooks). The quantisation error of a vector turns a query's product by about |query| |error| / sqrt(d); every row
that can be among the best within ``margin`` times that is scored exactly, in double precision, on the original
vectors: however many near copies a vector has, none is cut off by a fixed number. Ties go to the smaller vec_id. Queries search twice:

1. in their best cells, as many as hold ``SEED_ROWS`` times k rows; the k-th best score found is their bar;
2. in every cell whose bound reaches the bar. A query without k rows has no bar and searches all cells.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length
than most of the sample, with which there is no product, and rows without vec_id. Rows that repeat a vec_id are rows of their own: each is a
query, and a candidate for the others. Fewer candidates than asked for are all returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, shuffle_width, stored

SAMPLE = 16_384
MAX_CELLS = 1024
BLOCK = 8192
SEED_ROWS = 4
TARGET = 0.98
INDEX = "row long, vec_id long, cell int, codes binary, error float, raw binary, asked boolean"


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, x[:, d], minlength=len(centres)) for d in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=len(centres))])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)


@dataclass
class Index:
    """Coarse centroids (cells, d), their spreads (cells), codebooks (slices, codes, d / slices) and z of the bound."""

    centroids: np.ndarray
    spreads: np.ndarray
    books: np.ndarray
    z: float

    @classmethod
    def fit(cls, x: np.ndarray, k: int = 20, target: float = TARGET, cells: int | None = None) -> Index:
        n, d = x.shape
        slices = max(s for s in range(1, min(16, d) + 1) if d % s == 0)
        centroids = kmeans(x, max(1, min(cells or round(math.sqrt(n)), n // 8 or 1)))
        own = nearest(x, centroids)
        residual = x - centroids[own]
        count = np.bincount(own, minlength=len(centroids))
        square = np.bincount(own, (residual * residual).sum(axis=1), minlength=len(centroids))
        # Cells with few samples lean on the spread of all.
        spreads = np.sqrt((square + 4 * square.sum() / n) / (count + 4) / d)
        books = np.stack([_padded(kmeans(part[:8192], 256), 256) for part in np.split(residual, slices, axis=1)])
        asked = np.arange(0, n, max(1, n // 256))
        score = x[asked] @ x.T
        score[np.arange(len(asked)), asked] = -np.inf
        top = np.argsort(-score, axis=1)[:, : min(k, n - 1)]
        z = 0.0
        if top.shape[1]:
            bar = np.take_along_axis(score, top[:, -1:], axis=1)
            need = (bar - np.take_along_axis(x[asked] @ centroids.T, own[top], axis=1)) / (np.linalg.norm(x[asked], axis=1)[:, None] * spreads[own[top]] + 1e-12)
            z = max(0.0, float(np.quantile(need, target)))
        return cls(centroids.astype(np.float32), spreads.astype(np.float32), books.astype(np.float32), z)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, cells): about the largest product that a vector of the cell reaches."""
        return q @ self.centroids.T + self.z * np.linalg.norm(q, axis=1)[:, None] * self.spreads

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes and length of the quantisation error of each vector."""
        cell = nearest(x, self.centroids)
        residual = x - self.centroids[cell]
        parts = np.split(residual, len(self.books), axis=1)
        codes = [nearest(p, b) for p, b in zip(parts, self.books, strict=True)]
        error = residual - np.concatenate([b[c] for b, c in zip(self.books, codes, strict=True)], axis=1)
        return cell, np.stack(codes, axis=1).astype(np.uint8), np.sqrt((error * error).sum(axis=1))

    def distances(self, q: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products (queries, rows): the centroid's part and a table entry per slice."""
        out = (q @ self.centroids.T)[:, cell]
        for part, book, code in zip(np.split(q, len(self.books), axis=1), self.books, codes.T, strict=True):
            out += (part @ book.T)[:, code]
        return out


def _padded(centres: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([centres, np.repeat(centres[:1], n - len(centres), axis=0)]) if len(centres) < n else centres


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of float) of the rows that take part."""
    e = F.col("embedding")
    sound = e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("vector"))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float32) for v in vectors])


def _raws(raws, dims: int) -> np.ndarray:
    """Vectors as they were given: floats of four or of eight bytes."""
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dims else np.float64) for r in raws])


def build_index(vectors: DataFrame, asked: Column, k: int = 20, sample: int = SAMPLE, target: float = TARGET) -> tuple[Index | None, DataFrame | None]:
    """The fitted index and its table: row (a number), vec_id, cell, codes, error, raw (the vector's floats or doubles as bytes), asked."""
    rows = usable(vectors).withColumn("asked", F.coalesce(asked, F.lit(False)))
    picked = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(sample).collect()
    if not picked:
        return None, None
    size = Counter(len(r["vector"]) for r in picked).most_common(1)[0][0]
    rows = rows.where(F.size("vector") == size)
    index = Index.fit(_matrix([r["vector"] for r in picked if len(r["vector"]) == size]).astype(np.float64), k, target, min(MAX_CELLS, round(math.sqrt(rows.count()))))
    shared = rows.sparkSession.sparkContext.broadcast(index)  # of bounded size: MAX_CELLS centroids and 256 codes a slice

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["vector"])
                cell, codes, error = shared.value.encode(x)
                yield pd.DataFrame({"row": batch["row"], "vec_id": batch["vec_id"], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes], "error": error.astype(np.float32), "raw": [np.asarray(v, kind).tobytes() for v in batch["vector"]], "asked": batch["asked"]})

    kind = np.float32 if rows.schema["vector"].dataType.elementType == T.FloatType() else np.float64
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return index, stored(numbered.mapInPandas(run, INDEX), "ann-index")


def _blocks(counts: dict[int, int], cells: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell; small cells share a block."""
    first, number, at, room = np.zeros(cells, np.int32), np.ones(cells, np.int32), 0, block
    for cell in range(cells):
        n = counts.get(cell, 0)
        if n > room and room < block:
            at, room = at + 1, block
        first[cell], number[cell] = at, max(1, math.ceil(n / block))
        at, room = (at + int(number[cell]), block) if number[cell] > 1 else (at, room - n)
    return first, number


def _mixed(row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (row.astype(np.int64) * np.int64(-7046029254386353131) >> np.int64(20)) & np.int64(0x7FFFFFFF)


def scan(shared, table: DataFrame, asked: DataFrame, k: int, margin: float, seeds: bool) -> DataFrame:
    """The ``k`` best rows of each query in each block that it probes: query, query_id, row, vec_id, score.

    ``shared``: broadcast index, first block and number of blocks of each cell, and its rows. ``asked``: row, vec_id, raw, and bar unless ``seeds``.
    """
    schema = "block int, query boolean, row long, vec_id long, cell int, codes binary, error float, raw binary, bar double"

    def probed(index: Index, q: np.ndarray, bar: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bound = index.bounds(q)
        if not seeds:
            return bound >= bar[:, None]
        order = np.argsort(-bound, axis=1)
        before = np.cumsum(rows[order], axis=1) - rows[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, before < SEED_ROWS * k + 1, axis=1)
        return out

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, first, number, rows = shared.value
        for batch in batches:
            for i in range(0, len(batch), 512):
                own = batch.iloc[i : i + 512]
                bar = own["bar"].to_numpy(float)
                at, cells = np.nonzero(probed(index, _raws(own["raw"], index.centroids.shape[1]).astype(np.float32), bar, rows))
                at, step = np.repeat(at, number[cells]), np.concatenate([np.arange(n) for n in number[cells]]) if len(cells) else at
                pairs = np.unique(np.stack([at, np.repeat(first[cells], number[cells]) + step], axis=1), axis=0)
                picked = own.iloc[pairs[:, 0]]
                yield pd.DataFrame({"block": pairs[:, 1].astype(np.int32), "query": True, "row": picked["row"].to_numpy(), "vec_id": picked["vec_id"].to_numpy(), "cell": np.int32(0), "codes": None, "error": np.float32(0), "raw": picked["raw"].to_numpy(), "bar": bar[pairs[:, 0]]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, first, number, _ = shared.value
        for batch in batches:
            cell = batch["cell"].to_numpy()
            yield pd.DataFrame({"block": (first[cell] + _mixed(batch["row"].to_numpy()) % number[cell]).astype(np.int32), "query": False, "row": batch["row"], "vec_id": batch["vec_id"], "cell": cell, "codes": batch["codes"], "error": batch["error"], "raw": batch["raw"], "bar": 0.0})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a block come first and are held; its queries stream past them."""
        index, block, held, block_rows = shared.value[0], None, [], None
        for batch in batches:
            ids = batch["block"].to_numpy()
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(ids)) + 1):
                if not len(part):
                    continue
                own = batch.iloc[part]
                if ids[part[0]] != block:
                    block, held, block_rows = ids[part[0]], [], None
                is_query = own["query"].to_numpy(bool)
                if not is_query.all():
                    held.append(own[~is_query])
                if is_query.any() and held:
                    block_rows = block_rows or Block(index, pd.concat(held), margin)
                    asked = own[is_query]
                    for i in range(0, len(asked), 256):
                        yield block_rows.best(asked.iloc[i : i + 256], k)

    rows = table.mapInPandas(deal, schema).unionByName(asked.mapInPandas(send, schema))
    dealt = rows.repartition(max(shuffle_width(table.sparkSession), 1), "block").sortWithinPartitions("block", "query")
    return dealt.mapInPandas(compare, "query long, query_id long, row long, vec_id long, score double")


class Block:
    """Rows of one block, which queries are compared with."""

    def __init__(self, index: Index, rows: pd.DataFrame, margin: float):
        rows = rows.sort_values(["vec_id", "row"])
        self.index, self.row, self.ids, self.cell = index, rows["row"].to_numpy(), rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
        self.error = rows["error"].to_numpy(np.float32) * np.float32(margin / math.sqrt(index.centroids.shape[1]))
        self.codes = np.stack([np.frombuffer(c, np.uint8) for c in rows["codes"]])
        self.vectors = _raws(rows["raw"], index.centroids.shape[1]).astype(np.float64)

    def best(self, asked: pd.DataFrame, k: int) -> pd.DataFrame:
        exact = _raws(asked["raw"], self.index.centroids.shape[1]).astype(np.float64)
        q = exact.astype(np.float32)
        near = self.index.distances(q, self.cell, self.codes)
        near[asked["row"].to_numpy()[:, None] == self.row[None, :]] = -np.inf
        slack = self.error[None, :] * np.sqrt((q * q).sum(axis=1, keepdims=True))
        sure = near - slack
        least = np.partition(sure, max(len(self.ids) - k, 0), axis=1)[:, max(len(self.ids) - k, 0)]
        least = np.maximum(least, asked["bar"].to_numpy(np.float64)) if len(asked) else least
        open_ = (near + slack >= least[:, None]) & (near > -np.inf)
        out = []
        for j, (query, query_id) in enumerate(zip(asked["row"], asked["vec_id"], strict=True)):
            found = np.flatnonzero(open_[j])
            score = (self.vectors[found] * exact[j]).sum(axis=1)
            top = np.lexsort((self.ids[found], -score))[:k]
            out.append((np.full(len(top), query), np.full(len(top), query_id), self.row[found][top], self.ids[found][top], score[top]))
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(["query", "query_id", "row", "vec_id", "score"])})


def search(index: Index | None, table: DataFrame | None, k: int = 20, margin: float = 2.5, block: int | None = None, spark=None) -> DataFrame:
    """The ``k`` nearest found of each row of the index that is asked for: query_id, rank, vec_id, score."""
    if index is None or table is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # One row for each cell, of which there are MAX_CELLS at most.
    counts = {r["cell"]: r["count"] for r in table.groupBy("cell").count().collect()}
    block = block or max(256, min(BLOCK, sum(counts.values()) // (4 * shuffle_width(table.sparkSession))))
    first, number = _blocks(counts, len(index.centroids), block)
    shared = table.sparkSession.sparkContext.broadcast((index, first, number, np.array([counts.get(c, 0) for c in range(len(index.centroids))])))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    rows, asked = table.select("row", "vec_id", "cell", "codes", "error", "raw"), table.where("asked").select("row", "vec_id", "raw")
    first_pass = stored(scan(shared, rows, asked.withColumn("bar", F.lit(float("-inf"))), k, margin, True), "ann-first")
    bars = first_pass.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("bar"))
    barred = stored(asked.join(bounded(stored(bars, "ann-bars")), "row", "left").fillna(float("-inf"), ["bar"]), "ann-queries")
    found = first_pass.unionByName(scan(shared, rows, barred, k, margin, False)).dropDuplicates(["query", "row"])
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest of every row whose vec_id is divisible by ``every``, among all other rows."""
    index, table = build_index(vectors, F.col("vec_id") % every == 0, k)
    return search(index, table, k, spark=vectors.sparkSession)
