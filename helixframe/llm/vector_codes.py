"""Vector codes: product quantisation in whole numbers, with a kd-tree for each codebook.

Components become floor(256 * x); vectors are cut in ``PARTS`` equal parts, and each part position has a codebook. Every round broadcasts one
kd-tree for each codebook; tasks find the nearest entry of their vectors' parts by branch and bound and return, for each entry, the
count and the sums of what fell to it (whole numbers, at most a row for each part and entry and task). Spark adds these up, and each
entry becomes its parts' mean, rounded down. A search enters a box whose bound equals the best distance so far, so of equally near
entries the one with the lowest index is found.

Only codebooks and trees are on the driver: ``PARTS`` times ``ENTRIES`` entries, whatever the number of vectors.

Edge cases: rows take no part if their vector is null or holds a null or non-finite component; shorter vectors, and lengths that are no multiple
of ``PARTS``, are filled up with zeros behind; components are held within +-2^28 (values of about a million), so that no distance leaves 64
bits; with fewer than ``ENTRIES`` vectors there are so many entries; of rows with one vec_id each counts, ordered by their vectors; null
vec_ids come last; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF, BLOCK = 8, 16_384
LIMIT = 1 << 28


@dataclass
class Node:
    """Entries within a box; ``entries`` (ascending) at a leaf, else two nodes on either side of ``split``."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    axis: int = 0
    split: int = 0
    left: Node | None = None
    right: Node | None = None


class Tree:
    """A kd-tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._built(np.arange(len(entries)))

    def _built(self, ids: np.ndarray) -> Node:
        points = self.entries[ids]
        node = Node(points.min(0), points.max(0))
        wide = node.high - node.low
        if len(ids) <= LEAF or not wide.any():
            node.entries = ids
            return node
        node.axis = int(wide.argmax())
        values = np.unique(points[:, node.axis])
        middle = np.sort(points[:, node.axis])[len(ids) // 2]
        node.split = int(middle if middle > values[0] else values[1])
        below = points[:, node.axis] < node.split
        node.left, node.right = self._built(ids[below]), self._built(ids[~below])
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, the lowest of several; squared distance) of each row of ``x``."""
        best, entry = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))

        def visit(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            own = x[rows]
            away = np.maximum(np.maximum(node.low - own, own - node.high), 0)
            near = (away * away).sum(1) <= best[rows]
            rows, own = rows[near], own[near]
            if not len(rows):
                return
            if node.entries is not None:
                apart = own[:, None, :] - self.entries[node.entries]
                distance = (apart * apart).sum(2)
                at = distance.argmin(1)
                least, found = distance[np.arange(len(rows)), at], node.entries[at]
                better = (least < best[rows]) | (least == best[rows]) & (found < entry[rows])
                best[rows[better]], entry[rows[better]] = least[better], found[better]
                return
            below = own[:, node.axis] < node.split
            visit(node.left, rows[below])
            visit(node.right, rows[~below])
            visit(node.right, rows[below])
            visit(node.left, rows[~below])

        visit(self.root, np.arange(len(x)))
        return entry, best


def whole(values: np.ndarray) -> np.ndarray:
    """Components as whole numbers."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` whole components, zeros behind those that a vector has."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = whole(vectors.flatten().to_numpy(zero_copy_only=False))
    return out


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows that take part."""
    return vectors.where(F.col("embedding").isNotNull()).where(F.forall("embedding", _finite)).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))


def _coded(batch: pa.RecordBatch, trees: list[Tree], dims: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, components by part, entries by part, distances by part) of each block of a batch."""
    column = batch.column("vector")
    for i in range(0, len(column), BLOCK):
        block = column[i : i + BLOCK]
        x = _matrix(block, dims).reshape(len(block), PARTS, -1)
        found = [tree.nearest(x[:, p]) for p, tree in enumerate(trees)]
        yield i, i + len(block), x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, component) after one round; entries that no part is nearest to stay."""
    parts, entries, width = books.shape
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, _, x, entry, _ in _coded(batch, trees.value, parts * width):
                for p in range(parts):
                    np.add.at(counts[p], entry[:, p], 1)
                    np.add.at(sums[p], entry[:, p], x[:, p])
        p, e = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (p, e, counts[p, e], *sums[p, e].T)], ["part", "entry", "n", *names])

    made = rows.select("vector").mapInArrow(run, ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
    out = books.copy()
    for row in made.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).collect():  # a row for each entry
        out[row["part"], row["entry"]] = [row[c] // row["n"] for c in names]
    trees.unpersist()
    return out


def trained(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks of the ``kept`` rows, None if there are none; the first vectors are the first entries."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    dims = PARTS * max(1, -(-longest // PARTS))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    seeds = _matrix(pa.array([r[0] for r in first], pa.list_(pa.float64())), dims).reshape(len(first), PARTS, -1)
    books = seeds.transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = updated(rows, books)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (an entry for each part) and error (squared distance) of the ``kept`` rows."""
    trees = rows.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    dims = books.shape[0] * books.shape[2]
    label = rows.schema["label"].dataType.simpleString()
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, entry, distance in _coded(batch, trees.value, dims):
                codes = pa.ListArray.from_arrays(np.arange(0, entry.size + 1, PARTS, dtype=np.int32), pa.array(entry.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i:j], batch.column("label")[i:j], codes, pa.array(distance.sum(1))], ["vec_id", "label", "codes", "error"])

    return rows.mapInArrow(run, f"vec_id {kind}, label {label}, codes array<int>, error long")


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for, in the scale of the original components."""
    return books[np.arange(len(books)), codes].reshape(len(codes), -1) / SCALE


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, codes and error of every vector that takes part, stored; the codebooks)."""
    rows = kept(vectors)
    books = trained(rows)
    if books is None:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).where("false"), None
    return stored(coded(rows, books), "vector-codes"), books


def digest(codes: DataFrame, books: np.ndarray | None) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256."""
    labels = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    text = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    both = codes.join(bounded(labels), F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", text.alias("code"), "error", "label_error", F.lit(book_digest(books) if books is not None else "").alias("codebooks_sha256"))


def _assigned(book: str) -> str:
    """SQL of the nearest entry of every part, the lowest of several."""
    distance = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"SELECT r, part, x, min(k) // 64 AS d, min(k) % 64 AS entry FROM (SELECT r, p.part, p.x, cast({distance} AS bigint) * 64 + b.entry AS k FROM p JOIN {book} b USING (part)) y GROUP BY ALL"


def _moved(book: str, assigned: str) -> str:
    """SQL of a codebook after a round."""
    mean = ", ".join(f"cast(floor(sum(x[{i}]) / count(*)) AS bigint)" for i in range(1, 5))
    return f"SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT part, entry, [{mean}] AS x FROM {assigned} GROUP BY ALL) m USING (part, entry)"


ORACLE = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, q[part * 4 + 1:part * 4 + 4] AS x FROM (SELECT r, q, unnest(range(0, 16)) AS part FROM v) y),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_moved("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_moved("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, cast(sum(d) AS bigint) AS error FROM a2 GROUP BY r),
j AS (SELECT vec_id, label, code, error FROM e JOIN v USING (r)),
l AS (SELECT label, cast(sum(error) AS bigint) AS label_error FROM j GROUP BY label),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM j JOIN l ON j.label IS NOT DISTINCT FROM l.label, s
"""
