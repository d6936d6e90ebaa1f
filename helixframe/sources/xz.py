"""Text files in xz, read by their blocks.

The index at the end of a file's streams says where each block lies and how long it is. Blocks decompress independently, so each is a row and a task of its own
can take it; only byte ranges of a file are ever read. A block's lines are those that begin in it: what stands before its first line
break belongs to the block before, which reads on into the next blocks up to there.

Files written as one block (what ``xz`` does with one thread) are one task, as a stream.
"""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that are read and decompressed at once.
STEP = 1 << 20
HEADER = FOOTER = 12
LINES = 50_000


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, lowest first, and where it ends."""
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def blocks(read, size: int) -> list[tuple[int, int]]:
    """(place, bytes without padding and check's rest) of the blocks of all streams of a file; ``read(place, bytes)`` reads it."""
    found: list[tuple[int, int]] = []
    end = size
    while end > 0:
        while end > 0 and read(end - 4, 4) == b"\0\0\0\0":  # padding between streams
            end -= 4
        if end <= 0:
            break
        footer = read(end - FOOTER, FOOTER)
        if footer[-2:] != b"YZ":
            raise ValueError("not an xz file")
        index_size = (int.from_bytes(footer[4:8], "little") + 1) * 4
        index = read(end - FOOTER - index_size, index_size)
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            bare, at = _number(index, at)
            _, at = _number(index, at)
            sizes.append(bare)
        place = end - FOOTER - index_size - sum(-(-s // 4) * 4 for s in sizes)
        own = []
        for s in sizes:
            own.append((place, s))
            place += -(-s // 4) * 4
        found = own + found
        end = (own[0][0] if own else end - FOOTER - index_size) - HEADER
    return found


def decompressed(read, place: int, size: int) -> Iterator[bytes]:
    """A block's bytes, in pieces."""
    head = read(place, (read(place, 1)[0] + 1) * 4)
    flags, at = head[1], 2
    for bit in (0x40, 0x80):
        if flags & bit:
            _, at = _number(head, at)
    filters = []
    for _ in range((flags & 3) + 1):
        kind, at = _number(head, at)
        length, at = _number(head, at)
        filters.append(lzma._decode_filter_properties(kind, head[at : at + length]))
        at += length
    engine = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters)
    at, stop = place + len(head), place + size
    while at < stop and not engine.eof:
        data = read(at, min(STEP, stop - at))
        at += len(data)
        out = engine.decompress(data, STEP)
        while out or not (engine.needs_input or engine.eof):
            yield out
            out = engine.decompress(b"", STEP) if not (engine.needs_input or engine.eof) else b""


def _reader(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    file = fs.open_input_file(name)

    def read(place: int, size: int) -> bytes:
        return file.read_at(size, place)

    return read, file.size()


def owned_lines(read, places: list[tuple[int, int]], k: int) -> Iterator[bytes]:
    """The lines that begin in block ``k``."""
    held, skip = b"", k > 0
    for data in decompressed(read, *places[k]):
        held += data
        if skip:
            at = held.find(b"\n")
            if at < 0:
                held = held[-1:]
                continue
            held, skip = held[at + 1 :], False
        *lines, held = held.split(b"\n")
        yield from lines
    if skip:
        return  # all of it belongs to an earlier line
    # A line that ends exactly with a block leaves nothing to read on for, unless what follows continues it: only its break says so.
    for later in range(k + 1, len(places)):
        for data in decompressed(read, *places[later]):
            at = data.find(b"\n")
            if at >= 0:
                yield held + data[:at]
                return
            held += data
    if held:
        yield held


def xz_lines(spark: SparkSession, path: str, glob: str = "*.xz") -> DataFrame:
    """file, n (from 0, within the file) and value of every line of the xz files that match."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                places = blocks(*_reader(name))
                yield pd.DataFrame({"file": name, "block": range(len(places))})

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, block in zip(batch["file"], batch["block"], strict=True):
                read, size = _reader(name)
                held: list[str] = []
                done = 0
                for line in owned_lines(read, blocks(read, size), block):
                    held.append(line.decode("ascii", "replace"))
                    if len(held) == LINES:
                        yield pd.DataFrame({"file": name, "block": block, "i": range(done, done + len(held)), "value": held})
                        done, held = done + len(held), []
                if held:
                    yield pd.DataFrame({"file": name, "block": block, "i": range(done, done + len(held)), "value": held})

    # A row for each block, dealt out before any is read.
    each = found.select("path").mapInPandas(listed, "file string, block int").repartition("file", "block")
    rows = each.mapInPandas(lines, "file string, block int, i long, value string")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy("file").orderBy("block")) - F.col("count")
    return rows.join(counts.select("file", "block", before.alias("before")), ["file", "block"]).select("file", (F.col("i") + F.col("before")).alias("n"), "value")
