"""Exact removal of repeated substrings: every byte inside a string of ``length`` bytes that starts anywhere else too.

The strings that decide are compared by merging Burrows-Wheeler transforms of shards by iterative interleave
refinement: each shard's suffixes are sorted once, and an interleave of the shards, first one after the other, is refined by a stable distribution on the
transforms' characters; suffixes of different shards are never sorted together. After h rounds it is ordered by the first h characters; a boundary that appears
in round h is a common prefix of h - 1. Suffixes that no boundary parts in the last round form the repeated intervals.

Only strings that can repeat enter the merge. The texts are sampled by content:

* An *anchor* is the place of the least hash among ``WINDOW`` neighbouring 8-byte grams. A string of ``length`` bytes
  fixes all anchors well inside it, so equal strings have the same first anchor at the same offset. Every string start
  thus belongs to one anchor, the first that lies at least ``WINDOW - 1`` bytes behind it.
* The *core* of an anchor are the bytes that all its strings share (all but ``WINDOW - 1`` of them), its *block* the bytes
  that they cover together. An anchor with its strings is an *entry*.

1. Entries whose core is unique hold no repeated string; a count of core names finds the others. Names only select here.
2. Entries of one block are copies: all their strings repeat. Blocks are named by 128 bits.
3. A core with several blocks is open: its distinct blocks go to the merge, copies as one with their number. Starts with
   few bytes before the core and starts with few behind it are merged apart (``parts``): for each part the core grows by the bytes
   that all its strings share, and is one character of the merge, compared byte by byte. So a core that stands in very
   many texts is split by the bytes around it, and equal strings are counted before they are gathered.
4. The repeated ranges of each text are collected and cut.

Edge cases: null texts are empty; texts shorter than ``length`` keep all bytes; rows that repeat a text (or a doc_id)
repeat every string of it; overlapping places of one document count as elsewhere; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, freed, stored
from .simhash import by_key

LENGTH = 200
WINDOW = 64  # no more: a number of starts takes six bits
GRAM = 8
#: Bytes of text that are sampled at once; bounds the memory of the vectorised steps.
CHUNK = 1 << 21
#: Strings in one merge, small cores together, and shards whose transforms are merged.
MERGE, SHARDS = 4096, 4
#: Starts with fewer bytes before (or behind) the core are merged apart: all others are told apart by so many bytes there.
EDGE = 4

_RNG = np.random.default_rng(200)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CACHE: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _CACHE.get(name)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        have = _CACHE[name] = np.cumprod(grown, dtype=np.uint64)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Sampled:
    """Texts laid one after another, with their anchors and the names of cores and blocks.

    Per entry (an anchor that has strings): ``lo``, the first string start; ``count``, how many starts; ``at``, the anchor;
    ``owner``, the number of its text.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.size = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.size)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.raw)
        none = np.zeros(0, np.int64)
        self.at, self.lo, self.count, self.owner, self.core = none, none, none, none, none.view(np.uint64)
        if n < length:
            return
        grams = np.ndarray((n - GRAM + 1,), "<u8", self.raw.tobytes(), strides=(1,)).astype(np.uint64)
        with np.errstate(over="ignore"):
            grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
        low = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < WINDOW:
            low = np.minimum(low[: -(WINDOW - span)], low[WINDOW - span :])
        # A window of grams that runs over the end of its text counts for none.
        inside = np.ones(n + 1, bool)
        reach = WINDOW - 1 + GRAM - 1
        for e, s in zip(self.ends.tolist(), self.size.tolist(), strict=True):
            inside[max(e - reach, e - s) : e] = False
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[inside[: len(low)]]
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        owner = np.searchsorted(self.ends, at, side="right")
        first, last = self.ends[owner] - self.size[owner], self.ends[owner] - length
        before = np.concatenate([[-1], at[:-1]])
        same = np.concatenate([[False], owner[1:] == owner[:-1]])
        lo = np.where(same, np.maximum(before - WINDOW + 2, first), first)
        hi = np.minimum(at - WINDOW + 1, last)
        keep = hi >= lo
        self.at, self.lo, self.count, self.owner = at[keep], lo[keep], (hi - lo + 1)[keep], owner[keep]
        with np.errstate(over="ignore"):
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[self.raw] * _powers("up", _BASE, n)[:n], dtype=np.uint64)])
            a, b = self.at - WINDOW + 1, self.at + length - 2 * (WINDOW - 1)
            self.core = _mix((prefix[b] - prefix[a]) * _powers("down", _INVERSE, n + 1)[a] + (b - a).astype(np.uint64))

    def blocks(self) -> np.ndarray:
        """128-bit names of the entries' blocks, as two columns."""
        from xxhash import xxh3_128_digest

        raw = memoryview(self.raw)
        ends = (self.lo + self.count - 1 + self.length).tolist()
        named = (xxh3_128_digest(raw[a:b], seed) for a, b, seed in zip(self.lo.tolist(), ends, (self.at - self.lo).tolist(), strict=True))
        return np.frombuffer(b"".join(named), "<i8").reshape(-1, 2)


def sampled_chunks(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[np.ndarray, Sampled]]:
    """(numbers of the rows, their texts); chunks hold about CHUNK bytes, a long text more."""
    for batch in batches:
        texts, rows = list(map(bytes, batch["raw"])), batch["row"].to_numpy(np.int64)
        cuts = np.cumsum([len(t) for t in texts]) // CHUNK
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cuts)) + 1):
            if len(part):
                yield rows[part], Sampled([texts[i] for i in part], length)


def parts(window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of the number of bytes before the core, short ones at both ends."""
    edge, half = min(EDGE, window // 2), window // 2
    near = [(0, edge - 1), (edge, half - 1)] if edge < half else [(0, half - 1)]
    return near + [(window - 1 - b, window - 1 - a) for a, b in reversed(near)]


def part_strings(raw: bytes, lo: int, count: int, at: int, length: int) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """(part, first start, rounds, left, core, right) of an entry's strings, part by part."""
    core = at - WINDOW + 1
    stop, most = core + length - WINDOW + 1, core - lo
    least = most - count + 1
    for k, (a, b) in enumerate(parts()):
        high, low = min(b, most), max(a, least)
        if low <= high:
            inner, outer = core - a, stop + WINDOW - 1 - b
            yield k, core - high, b - a + 1, raw[core - high : inner], raw[inner:outer], raw[outer : stop + WINDOW - 1 - low]


def shard_transform(character: np.ndarray, begin: np.ndarray, sentinel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, Burrows-Wheeler transform) of one shard's strings, which lie end to end.

    Every string's sentinel is a character of its own, less than all others and the less the earlier its string. Suffixes are sorted by
    doubling: by their first character, then by ranks of the first and the second half of twice as many, until no two are equal. The transform's
    character of a string's first suffix is its own sentinel, 0.
    """
    n = len(character)
    rank = character.astype(np.int64) + len(begin)
    rank[sentinel] = np.arange(len(begin))
    width = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - width] = rank[width:] + 1
        key = rank * (int(behind.max(initial=0)) + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        width *= 2
        if new[-1] == n - 1 or width >= 2 * n:
            break
    front = np.concatenate([[0], character[:-1]])
    front[begin] = 0
    return order, front[order]


def merged_repeats(strings: list[bytes], left: np.ndarray, cores: np.ndarray, shards: np.ndarray, starts: np.ndarray, rounds: int, copies: np.ndarray) -> np.ndarray:
    """For each string, a bit mask of its first ``starts`` places whose ``rounds`` characters occur at another place too, or have copies.

    A string is given without its core, which stands behind ``left`` bytes and is one character of its own. Each shard's transform is built once. The
    interleave says, for each place of the merged transform, which shard's next suffix stands there; at first all of one shard's, then the next's. A round
    takes the characters of all transforms in that order and distributes the shards by them, stably; sentinels keep the first places, in order of
    their shards. After round h the interleave is ordered by h characters; a boundary that appears in it is a common prefix of h - 1.
    """
    order = np.argsort(shards, kind="stable")
    size = np.array([len(strings[i]) + 2 for i in order])
    ends = np.cumsum(size)
    begin, sentinel, n = ends - size, ends - 1, int(ends[-1])
    text = np.frombuffer(b"".join(strings[i][: left[i]] + b"\0" + strings[i][left[i] :] + b"\0" for i in order), np.uint8)
    character = text.astype(np.uint16) + 1
    character[begin + left[order]] = 257 + np.unique(cores, return_inverse=True)[1][order]
    character[sentinel] = 0
    cuts = [0, *(np.flatnonzero(np.diff(shards[order])) + 1).tolist(), len(order)]
    suffixes, transforms, counts, own = [], [], [], []
    for i, j in zip(cuts, cuts[1:], strict=False):
        first, stop = int(begin[i]), int(ends[j - 1])
        places, transform = shard_transform(character[first:stop], begin[i:j] - first, sentinel[i:j] - first)
        suffixes.append(places + first)
        transforms.append(transform)
        counts.append(stop - first)
        own.append(j - i)
    total = len(order)
    interleave = np.repeat(np.arange(len(counts), dtype=np.uint8), counts)
    heads = np.repeat(np.arange(len(counts), dtype=np.uint8), own)

    # ``block`` numbers the parts of the interleave in its own order: suffixes of a part agree on their first h characters.
    block = np.zeros(n, np.int32)
    new = np.empty(n, bool)
    for _ in range(rounds):
        c = np.empty(n, np.uint16)
        for k, transform in enumerate(transforms):
            c[interleave == k] = transform
        move = np.argsort(c, kind="stable")
        interleave, c, old = interleave[move], c[move], block[move]
        interleave[:total] = heads
        new[0] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        new[1:] |= old[1:] != old[:-1]
        new |= c == 0
        block = np.cumsum(new, dtype=np.int32)
    suffix = np.empty(n, np.int64)
    for k, places in enumerate(suffixes):
        suffix[interleave == k] = places
    repeated = np.empty(n, bool)
    weight = np.repeat(copies[order], size)
    repeated[suffix] = (np.bincount(block, weight[suffix]) > 1)[block]
    masks = np.zeros(len(strings), np.uint64)
    for i, at in zip(order, begin.tolist(), strict=True):
        k = int(starts[i])
        masks[i] = np.packbits(np.concatenate([repeated[at : at + k], np.zeros(64 - k, bool)]), bitorder="little").view("<u8")[0]
    return masks


def _first() -> Column:
    return F.shiftright("at", 13).cast("int")


def repeated_ranges(texts: DataFrame, length: int) -> DataFrame:
    """row, first and stop of the repeated strings of ``texts`` (row, raw), and ``merged``, whether the merge found them; ranges may overlap."""

    def core_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, s in sampled_chunks(batches, length):
            yield pd.DataFrame({"core": s.core.view(np.int64)})

    def entry_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, s in sampled_chunks(batches, length):
            if len(s.at):
                names, begin = s.blocks(), (s.ends - s.size)[s.owner]
                where = (s.lo - begin) << 13 | (s.at - s.lo) << 6 | s.count - 1
                yield pd.DataFrame({"core": s.core.view(np.int64), "b1": names[:, 0], "b2": names[:, 1], "row": rows[s.owner], "at": where})

    cores = texts.mapInPandas(core_names, "core long").groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    # ``at`` packs the first start, the anchor behind it and the number of starts less one: both of these are below 2 * WINDOW and WINDOW.
    entries = texts.mapInPandas(entry_rows, "core long, b1 long, b2 long, row long, at long")
    # Cores and blocks that repeat grow with the input, so these joins are shuffled; a core or block of very many entries is split as a skewed join is.
    cores = freed(stored(cores, "cores"))
    met = freed(stored(entries.join(cores, "core", "left_semi"), "entries"), cores)
    block = ["core", "b1", "b2"]
    blocks = freed(stored(met.groupBy(*block).agg(F.count("*").alias("n")), "blocks"))
    open_cores = blocks.groupBy("core").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("core", F.lit(True).alias("is_open"))
    known = blocks.join(bounded(freed(stored(open_cores, "open-cores"))), "core", "left").where("n > 1 OR is_open")
    met = freed(stored(met.join(known, block), "entries-known"), met, blocks)
    whole = met.where("n > 1").select("row", _first().alias("first"), (_first() + F.col("at").bitwiseAND(F.lit(63)) + length).alias("stop"), F.lit(False).alias("merged"))
    opened = met.where("is_open").select(*block, "row", "at")
    one = opened.groupBy(*block).agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("e"))
    asked = one.select(F.col("e.row").alias("row"), F.struct("e.at", F.least("n", F.lit(2)).alias("copies")).alias("e")).groupBy("row").agg(F.collect_list("e").alias("entries"))
    asked = freed(stored(asked, "open-entries"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        names = ["row", "part", "first", "rounds", "left", "core", "right"]
        for batch in batches:
            found = []
            for row, raw, entries in zip(batch["row"], batch["raw"], batch["entries"], strict=True):
                raw = bytes(raw)
                for e in entries:
                    lo = e["at"] >> 13
                    for x in part_strings(raw, lo, (e["at"] & 63) + 1, lo + (e["at"] >> 6 & 127), length):
                        found.append((row, *x, e["copies"], *np.frombuffer(xxh3_128_digest(b"%d %d %d " % (x[0], len(x[3]), len(x[4])) + x[3] + x[4] + x[5]), "<i8"), int(np.frombuffer(xxh3_128_digest(x[4], x[0]), "<i8")[0])))
            if found:
                yield pd.DataFrame(found, columns=[*names, "copies", "s1", "s2", "place"])

    strings = freed(stored(texts.join(bounded(asked), "row").select("row", "raw", "entries").mapInPandas(send, "row long, part int, first int, rounds int, left binary, core binary, right binary, copies long, s1 long, s2 long, place long"), "open-strings"), asked)
    distinct = strings.groupBy("s1", "s2").agg(*[F.first(c).alias(c) for c in ("place", "part", "rounds", "left", "core", "right")], F.sum("copies").alias("copies"))

    def merge(x: dict[str, np.ndarray]) -> pd.DataFrame | None:
        out = []
        for k in np.unique(x["part"]):
            own = np.flatnonzero(x["part"] == k)
            left = np.array([len(b) for b in x["left"][own]])
            rounds = int(x["rounds"][own[0]])
            both = [bytes(a) + bytes(b) for a, b in zip(x["left"][own], x["right"][own], strict=True)]
            starts = np.array([len(b) for b in both]) + 2 - rounds
            core = pd.factorize(pd.Series(list(map(bytes, x["core"][own]))))[0]
            masks = merged_repeats(both, left, core, x["s1"][own] & SHARDS - 1, starts, rounds, np.minimum(x["copies"][own], 2))
            string, start = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            out.append(pd.DataFrame({"s1": x["s1"][own][string], "s2": x["s2"][own][string], "start": start.astype(np.int32)}))
        return pd.concat(out)

    hits = freed(stored(by_key(distinct, ["place"], merge, "s1 long, s2 long, start int", at_once=MERGE), "repeated-starts"))
    found = strings.select("row", "first", "s1", "s2").join(bounded(hits), ["s1", "s2"]).select("row", (F.col("first") + F.col("start")).alias("first"))
    return whole.unionByName(found.select("row", "first", (F.col("first") + length).alias("stop"), F.lit(True).alias("merged")))


def runs_of(ranges: np.ndarray) -> np.ndarray:
    """Ranges (first << 32 | stop) in order, where those that overlap or touch are one."""
    ranges = np.sort(ranges)
    first, reach = ranges >> 32, np.maximum.accumulate(ranges & 0xFFFFFFFF)
    opens = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return first[opens] << 32 | reach[np.append(opens[1:], len(ranges)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document."""
    if length < 3 * WINDOW + GRAM - 3:
        raise ValueError(f"strings need {3 * WINDOW + GRAM - 3} bytes at least")
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8").alias("raw"))
    texts = stored(texts, "suffix-texts")
    ranges = repeated_ranges(texts.select("row", "raw"), length).select("row", F.shiftleft(F.col("first").cast("long"), 32).bitwiseOR(F.col("stop").cast("long")).alias("range"))

    def joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ranges=[runs_of(np.asarray(r, np.int64)) for r in batch["ranges"]])

    # A text has no more ranges than bytes, and far fewer when those that overlap or touch are one. So few may be broadcast, and then no text moves.
    ranges = ranges.groupBy("row").agg(F.collect_list("range").alias("ranges")).mapInPandas(joined_up, "row long, ranges array<long>")
    ranges = freed(stored(ranges, "repeated-ranges"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, raw, ranges in zip(batch["doc_id"], batch["raw"], batch["ranges"], strict=True):
                raw, n_removed, runs = bytes(raw), 0, 0
                size = len(raw)
                if ranges is not None:
                    ranges = np.asarray(ranges, np.int64)
                    change = np.bincount(ranges >> 32, minlength=size + 1) - np.bincount(ranges & 0xFFFFFFFF, minlength=size + 1)
                    gone = np.cumsum(change[:-1]) > 0
                    n_removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((doc_id, size, n_removed, runs, hashlib.sha256(raw).hexdigest(), raw))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    joined = texts.join(bounded(ranges), "row", "left").select("doc_id", "raw", "ranges")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(found: DataFrame) -> DataFrame:
    return found.drop("kept")
