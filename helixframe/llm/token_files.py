"""Token-id shards with a minimal perfect hash index over document keys.

A shard file holds, little-endian and each part 8-byte aligned:

    magic "TIDSHRD1" | header length (u32) | header (JSON: counts, widths, place of every part)
    payload     ids of all documents of the shard, end id included, u16 if the vocabulary allows, else u32
    directory   doc_id (i64), start in the shard (u64), number of ids (u32), in order
    index       levels of a minimal perfect hash: bit arrays (u64 words) with their popcount prefix (i64),
                then, by hash value, a fingerprint of the key (u32) and the entry's number in the directory (u32)

The hash is built level by level: every key left sets a bit at its hash of that level, keys that share
a bit go to the next level; the rank of a key's bit among all set bits is its value, so n keys get 0..n-1.
A lookup hashes the key, ranks one bit and compares one fingerprint: constant time, a few reads of some bytes, no search and no key
stored in the index; a key that was never stored is told by its fingerprint, and by the directory's doc_id.

Documents are written in ascending doc_id order (null first), so shards are ranges of doc_id. Ranges are as many as the
bytes of the texts ask for; a task writes a shard whenever it holds ``SHARD_IDS`` ids, so its memory is bounded, and
rows of one doc_id may be dealt to several tasks and shards. A shard is
written under a new name and counts only once the task's manifest row has
been stored; an attempt on a lost executor leaves a file that no manifest names. Files go to the shared
folder of ``spark.checkpoint.dir``.

Edge cases: null text counts as empty (one end id); rows that repeat a doc_id stand one after another and
a lookup returns them all; any 64-bit doc_id works, and none is null's; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_width, stored, tokenizer_path
from .tokens import encoded_slices, encoder

MAGIC = b"TIDSHRD1"
END_ID = 1
#: Bytes of text for each range of doc_id, and ids at which a task closes a shard.
RANGE_BYTES = 32 << 20
SHARD_IDS = 8 << 20
MANIFEST = "path string, named boolean, lo long, hi long, n_docs long, n_ids long"
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def hashed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key, another one at each level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (hashed(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.rank, total = [], 0
        for words in levels:
            ones = np.cumsum(np.bitwise_count(words).astype(np.int64))
            self.rank.append(total + np.concatenate([[0], ones[:-1]]))
            total += int(ones[-1])

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        levels, left, level = [], keys, 0
        while len(left):
            words = max(1, int(np.ceil(len(left) * spread / 64)))
            bit = (hashed(left, level) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(bit, minlength=words * 64)[bit] == 1
            flags = np.zeros(words * 64, np.uint8)
            flags[bit[alone]] = 1
            levels.append(np.packbits(flags, bitorder="little").view("<u8"))
            left = left[~alone]
            level += 1
        return cls(levels)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 where no level has its bit."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            bit = (hashed(keys[todo], level) % np.uint64(len(words) * 64)).astype(np.int64)
            word, shift = words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            out[todo[hit]] = self.rank[level][bit[hit] >> 6] + np.bitwise_count(below)
            todo = todo[~hit]
        return out


def _open(path: str, mode: str):
    """A file of the shared folder: local or mounted paths directly, other schemes by Arrow's file systems."""
    if urlparse(path).scheme in ("", "file"):
        return open(urlparse(path).path, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)


def write_shard(path: str, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> None:
    """One shard; keys in ascending order, ids of all documents one after another."""
    distinct, first = np.unique(keys, return_index=True)
    index = PerfectHash.build(distinct)
    value = index.lookup(distinct)
    prints, entry = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[value], entry[value] = fingerprints(distinct), first
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    starts = np.cumsum(counts) - counts
    parts = {"payload": (ids, width), "keys": (keys, "<i8"), "starts": (starts, "<u8"), "counts": (counts, "<u4"), "prints": (prints, "<u4"), "entry": (entry, "<u4")}
    for i, (words, rank) in enumerate(zip(index.levels, index.rank, strict=True)):
        parts |= {f"level{i}": (words, "<u8"), f"rank{i}": (rank, "<i8")}
    places, at = {}, 0
    for name, (data, kind) in parts.items():
        places[name] = [at, len(data), kind]
        at += (len(data) * np.dtype(kind).itemsize + 7) & ~7
    head = json.dumps({"parts": places, "levels": len(index.levels)}).encode()
    head += b" " * (-(len(head) + 12) % 8)
    with _open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<I", len(head)) + head)
        for data, kind in parts.values():
            raw = np.ascontiguousarray(data, kind).tobytes()
            f.write(raw + b"\0" * (-len(raw) % 8))


class Shard:
    """Reads one shard by key; nothing but the header is read before it is asked for."""

    def __init__(self, path: str):
        self.file = _open(path, "rb")
        magic, size = self.file.read(8), struct.unpack("<I", self.file.read(4))[0]
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        head = json.loads(self.file.read(size))
        self.places, self.base, self.n_levels = head["parts"], 12 + size, head["levels"]
        self.n_docs = self.places["keys"][1]

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def part(self, name: str, lo: int = 0, n: int | None = None) -> np.ndarray:
        at, size, kind = self.places[name]
        wide = np.dtype(kind).itemsize
        self.file.seek(self.base + at + lo * wide)
        return np.frombuffer(self.file.read((size - lo if n is None else n) * wide), kind)

    def find(self, key: int) -> int:
        """The first directory entry of a key, -1 if the shard lacks it: a word and its rank per level, a fingerprint, an entry, a doc_id."""
        one = np.array([key], np.int64)
        for level in range(self.n_levels):
            bit = int(hashed(one, level)[0] % np.uint64(self.places[f"level{level}"][1] * 64))
            word = int(self.part(f"level{level}", bit >> 6, 1)[0])
            if word >> (bit & 63) & 1:
                value = int(self.part(f"rank{level}", bit >> 6, 1)[0]) + (word & ((1 << (bit & 63)) - 1)).bit_count()
                if self.part("prints", value, 1)[0] != fingerprints(one)[0]:
                    return -1
                entry = int(self.part("entry", value, 1)[0])
                return entry if self.part("keys", entry, 1)[0] == key else -1
        return -1

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document stored under a key."""
        entry, found = self.find(key), []
        while 0 <= entry < self.n_docs and self.part("keys", entry, 1)[0] == key:
            start, n = int(self.part("starts", entry, 1)[0]), int(self.part("counts", entry, 1)[0])
            found.append(self.part("payload", start, n).astype("<u4"))
            entry += 1
        return found

    def places_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first directory entry, number of entries) of many distinct keys at once, through the index; (-1, 0) of keys that the shard lacks."""
        index = PerfectHash.__new__(PerfectHash)
        index.levels, index.rank = ([self.part(f"{x}{i}") for i in range(self.n_levels)] for x in ("level", "rank"))
        value = index.lookup(keys)
        safe, stored = np.maximum(value, 0), self.part("keys")
        entry = self.part("entry")[safe].astype(np.int64)
        known = (value >= 0) & (self.part("prints")[safe] == fingerprints(keys)) & (stored[entry] == keys)
        return np.where(known, entry, -1), np.where(known, np.searchsorted(stored, keys, side="right") - entry, 0)


def write_token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, folder: str | None = None, ranges: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Tokenise and write shards; the manifest, one row per shard.

    One shuffle deals the texts by ranges of doc_id (nulls first) and, within one, of the hash of the text; a range is sorted and encoded by one task.
    """
    spark = docs.sparkSession
    path = tokenizer_path(tokenizer)
    folder = folder or scratch_path(spark, "token-files")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        vocabulary = max(encoder(path).tokenizer.get_vocab_size(), end_id + 1)
        keys, counts, flat, held = [], [], [], 0

        def close(named: bool) -> pd.DataFrame:
            name = f"{folder}/shard-{uuid.uuid4().hex}.bin"
            k, c, f = np.concatenate(keys), np.concatenate(counts), np.concatenate(flat)
            write_shard(name, k, c, f, vocabulary)
            for x in (keys, counts, flat):
                x.clear()
            return pd.DataFrame({"path": [name], "named": [named], "lo": [k[0]], "hi": [k[-1]], "n_docs": [len(k)], "n_ids": [len(f)]})

        last = False
        for part, ids, n in (x for batch in batches for _, same in batch.groupby("named") for x in encoded_slices(path, same)):
            named = bool(part["named"].iloc[0])
            if keys and (held >= shard_ids or named != last):
                yield close(last)
                held = 0
            last = named
            flat.append(np.insert(ids, np.cumsum(n), end_id).astype(np.uint16 if vocabulary <= 1 << 16 else np.uint32))
            counts.append(n + 1)
            keys.append(part["key"].to_numpy(np.int64))
            held += len(flat[-1])
        if keys:
            yield close(last)

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    named = F.col("doc_id").isNotNull()
    order = ["named", "key", "h", "i"]
    ordered = docs.select(named.alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"), "text")
    ordered = ordered.repartitionByRange(ranges or max(shuffle_width(spark), int(size // RANGE_BYTES)), *order).sortWithinPartitions(*order)
    return stored(ordered.select("named", "key", "text").mapInPandas(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files in order: doc_id, start among all ids, n_tokens and ids_crc32, each read from where the index says.

    Only the manifest (a row per shard) passes through the driver, to number the first id of each shard.
    """
    spark = manifest.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: (r["named"], r["lo"], r["hi"], r["path"]))
    first, rows = 0, []
    for r in shards:
        rows.append((r["path"], r["named"], first))
        first += r["n_ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, named, at in zip(batch["path"], batch["named"], batch["first"], strict=True):
                with Shard(path) as shard:
                    keys = np.unique(shard.part("keys"))
                    entry, n = shard.places_of(keys)
                    entries = np.repeat(entry, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start, counts = shard.part("starts")[entries].astype(np.int64), shard.part("counts")[entries].astype(np.int64)
                    raw = memoryview(shard.part("payload").astype("<u4").tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array(np.repeat(keys, n), "Int64") if named else pd.array([None] * len(entries), "Int64"),
                    "start": at + start,
                    "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * (a + c)]) for a, c in zip(start.tolist(), counts.tolist(), strict=True)],
                })

    listed = spark.createDataFrame(rows, "path string, named boolean, first long")
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keyed access: the ids of each doc_id in ``wanted``. A bisection of the manifest finds the shards that may hold a key, one probe of its index each its place.

    The manifest, 16 bytes and a path for each shard, is sent to the tasks.
    """
    spark = manifest.sparkSession
    shards = sorted((r["lo"], r["hi"], r["path"]) for r in manifest.where("named").collect())
    shared = spark.sparkContext.broadcast(([s[0] for s in shards], np.maximum.accumulate([s[1] for s in shards]).tolist() if shards else [], shards))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        los, his, shards = shared.value
        for batch in batches:
            found = []
            for key in batch["doc_id"].dropna().astype("int64").tolist():
                for k in range(bisect_left(his, key), bisect_right(los, key)):
                    if shards[k][1] >= key:
                        found.append((shards[k][2], key))
            yield pd.DataFrame(found, columns=["path", "doc_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, asked in batch.groupby("path"):
                with Shard(path) as shard:
                    for key in asked["doc_id"].tolist():
                        for ids in shard.get(key):
                            yield pd.DataFrame({"doc_id": [key], "ids": [ids.tolist()]})

    routed = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).mapInPandas(route, "path string, doc_id long")
    return routed.repartition(shuffle_width(spark), "path").sortWithinPartitions("path", "doc_id").mapInPandas(run, "doc_id long, ids array<long>")
