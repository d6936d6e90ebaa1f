"""Best-fit packing of token sequences, planned on a histogram of lengths.

The plan never sees documents. Piece lengths are counted, best-fit-decreasing runs over the counts
(at most ``capacity`` distinct lengths, however large the corpus), and yields patterns: a list of
lengths that fill one sequence and how many sequences repeat it. Every piece then gets its rank
within its length, and takes its planned slot by a join on length and rank. Only the histogram reaches the driver.

Edge cases: a null text counts as empty and still gives its end-of-document id; an empty table gives
no rows; repeated rows are packed each on its own (ties in rank broken by doc_id, piece and row order
of the materialised table); other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored, tokenizer_path
from .tokens import encoded_slices

CAPACITY = 2048
END_ID = 0
#: Slots of one length that one row of the plan unrolls at once, and pieces of one bucket of ranks.
RUN = 1 << 16
BUCKET = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full pieces, a shorter one first."""
    head = n % capacity
    cuts = [(0, head)] if head else []
    return cuts + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document; ``keep_ids`` adds the ids themselves as little-endian bytes."""
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ids, counts in (x for batch in batches for x in encoded_slices(path, batch)):
            rows, at = [], 0
            for doc_id, n in zip(part["doc_id"], counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                for piece, (start, length) in enumerate(cut(len(own), capacity)):
                    raw = own[start : start + length].tobytes()
                    rows.append((doc_id, piece, start, length, zlib.crc32(raw), *[raw] * keep_ids))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, PIECES + ", ids binary" * keep_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit-decreasing over counts: [(lengths in one sequence, number of such sequences)].

    Lengths are placed from the longest. Open bins are kept as counts by the room they have left; all
    pieces of a length go to the fullest bins that still take them, whole groups at a time.
    """
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(left: int, content: tuple[int, ...], n: int) -> None:
        if left not in room or not room[left]:
            insort(rooms, left)
        room[left][content] = room[left].get(content, 0) + n

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(todo, each)
                if full:
                    put(capacity - each * length, (length,) * each, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            left = rooms[i]
            content, n = next(iter(room[left].items()))
            each = min(left // length, todo)
            used = min(n, todo // each)
            if used == n:
                del room[left][content]
                if not room[left]:
                    rooms.pop(i)
            else:
                room[left][content] = n - used
            put(left - each * length, content + (length,) * each, used)
            todo -= used * each
    return [(list(content), n) for left in rooms for content, n in room[left].items()]


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """The plan as runs of ranks: ranks [lo, lo + n) of a length take ``offset`` in the sequences from ``first``: (length, lo, n, first, offset)."""
    runs, taken, first = [], Counter(), 0
    for content, n in patterns:
        offset = 0
        for length in content:
            runs.append((length, taken[length], n, first, offset))
            taken[length] += n
            offset += length
        first += n
    return runs


def planned(spark: SparkSession, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """One row per planned slot: length, rank, sequence_id and offset. Runs are unrolled in two steps, so a long one is made by many tasks."""
    table = spark.createDataFrame(runs, "length long, lo long, n long, first long, offset long")
    cut = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("k")).repartition(shuffle_width(spark), "length", "lo", "k")
    inside = F.sequence(F.col("k") * RUN, F.least("n", (F.col("k") + 1) * RUN) - 1)
    return cut.select("length", "lo", "first", "offset", F.explode(inside).alias("i")).select("length", (F.col("lo") + F.col("i")).alias("rank"), (F.col("first") + F.col("i")).alias("sequence_id"), "offset")


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add ``rank``, 0-based and gapless within each length.

    One length may hold most pieces, so ranks are taken within (length, bucket of the document) and moved
    by the number of pieces in earlier buckets; that table has at most ``capacity * buckets`` rows.
    """
    split = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = split.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return split.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("bucket", "own", "before")


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with the sequence and offset that the plan gives them."""
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = max(shuffle_width(spark), sum(histogram.values()) // BUCKET)
    # Both sides have one row for each piece, spread over (length, rank).
    placed = ranked(pieces, buckets).join(planned(spark, slots(plan(histogram, capacity))), ["length", "rank"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Number of sequences, ids and share of filled places."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(
        F.count("*").alias("sequences"), F.sum("n").alias("ids"), (F.sum("n") / (F.count("*") * F.lit(capacity))).alias("filled")
    )
