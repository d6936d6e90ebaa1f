"""Column functions on DNA strings, and k-mers as whole numbers of two bits for each base."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 20
BASES = "ACGT"
_NUMBER = np.full(256, 4, np.int8)
_NUMBER[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(4)


def revcomp(seq: Column) -> Column:
    """Reverse complement; anything but A, C, G, T becomes N."""
    return F.translate(F.reverse(F.regexp_replace(seq, "[^ACGT]", "N")), "ACGT", "TGCA")


def has_n(seq: Column) -> Column:
    return seq.contains("N")


def piece(seq: Column, start: Column, size: Column) -> Column:
    """``size`` bases from 1-based ``start``, cut by bytes: the cost does not grow with the place, as it does when characters are counted."""
    return F.substring(seq.cast("binary"), start.cast("int"), size.cast("int")).cast("string")


def windows(df: DataFrame, keep: list[str], size: int, step: int = 1, last: Column | None = None) -> DataFrame:
    """One row per window of ``seq``: ``keep``, ``i`` (0-based place) and ``win``.

    ``last``: the largest place; by default the last window that fits. Rows too short give no window.
    """
    fits = F.length("seq") - size
    end = fits if last is None else F.least(fits, last)
    starts = F.sequence(F.lit(0), end, F.lit(step))
    return df.where(end >= 0).select(*keep, "seq", F.explode(starts).alias("i")).select(*keep, "i", piece(F.col("seq"), F.col("i") + 1, F.lit(size)).alias("win"))


def _joined(one: np.ndarray, k: int) -> np.ndarray:
    """Codes of all runs of ``k`` digits of two bits: runs of a power of two are put together from halves."""
    runs, size, out, have = one, 1, None, 0
    while True:
        if k & size:
            n = len(one) - have - size + 1
            if n <= 0:
                return np.zeros(0, np.int64)
            # What is there is followed by the next run of this size.
            out = runs[:n] if out is None else out[:n] << 2 * size | runs[have : have + n]
            have += size
        if 2 * size > k:
            return out
        runs, size = runs[: max(0, len(runs) - size)] << 2 * size | runs[size:], 2 * size


def packed(seqs: pa.Array, k: int = K) -> pa.Array:
    """For each sequence the codes of its k-mers in order; null where one holds something else than A, C, G, T."""
    number, starts, lengths = _bases(seqs)
    counts = np.maximum(lengths - k + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], counts)
    odd = np.concatenate([[0], np.cumsum(number > 3)])
    codes = _joined(np.where(number > 3, 0, number).astype(np.int64), k)
    values = pa.array(codes[at] if len(at) else at, pa.int64(), mask=odd[at + k] > odd[at])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


@F.arrow_udf(T.ArrayType(T.LongType()))
def kmer_codes(seqs: pa.Array) -> pa.Array:
    """Codes of all 20-mers of each sequence."""
    return packed(seqs)


def packed_least(seqs: pa.Array, k: int = K) -> pa.Array:
    """For each sequence its k-mers in order: the smaller code of both strands << 1, and 1 if that is the reverse complement's. Null as in ``packed``, and where both are equal."""
    number, starts, lengths = _bases(seqs)
    counts = np.maximum(lengths - k + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], counts)
    odd = np.concatenate([[0], np.cumsum(number > 3)])
    ahead = np.where(number > 3, 0, number).astype(np.int64)
    codes, turns = _joined(ahead, k), _joined(3 - ahead[::-1], k)[::-1]
    least = np.minimum(codes, turns) << 1 | (turns < codes)
    none = (odd[at + k] > odd[at]) | (codes[at] == turns[at]) if len(at) else np.zeros(0, bool)
    values = pa.array(least[at] if len(at) else at, pa.int64(), mask=none)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


@F.arrow_udf(T.ArrayType(T.LongType()))
def least_codes(seqs: pa.Array) -> pa.Array:
    """The 20-mers of each sequence as ``packed_least`` gives them."""
    return packed_least(seqs)


def packed_ends(seqs: pa.Array, margins: tuple[int, ...]) -> pa.Array:
    """For each margin the codes of the k-mers at that distance from a sequence's start and from its end; null where ``packed`` has none."""
    number, starts, lengths = _bases(seqs)
    odd = np.concatenate([[0], np.cumsum(number > 3)])
    codes = _joined(np.where(number > 3, 0, number).astype(np.int64), K)
    at = np.stack([x for m in margins for x in (starts + m, starts + lengths - K - m)], axis=1)
    fits = (at >= starts[:, None]) & (at + K <= (starts + lengths)[:, None])
    at = np.where(fits, at, 0)
    none = ~fits | (odd[np.minimum(at + K, len(number))] > odd[at])
    values = codes[at] if len(codes) else np.zeros(at.shape, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), pa.array(values.ravel(), pa.int64(), mask=none.ravel()))


def end_codes(seq: Column, margins: tuple[int, ...]) -> Column:
    """The codes of ``packed_ends``: of the start and of the end at the first margin, then at the next."""
    return F.arrow_udf(lambda seqs: packed_ends(seqs, margins), T.ArrayType(T.LongType()))(seq)


def _bases(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of all bases, 4 for anything else; first places; lengths) of sequences laid end to end."""
    seqs = seqs.cast(pa.large_binary())
    offsets = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _NUMBER[data], offsets[:-1] - offsets[0], np.diff(offsets)


#: A run of neighbouring k-mers is cut where the least of their ``CORE``-mers changes, so reads over one place are cut alike.
CORE = 11
RUN = K - CORE + 1


#: A run with the least ``CORE``-mer (mixed) of its k-mers, by which all runs that may hold one k-mer meet, and the place of its first k-mer in the sequence.
RUN_AT = T.ArrayType(T.StructType([T.StructField("run", T.LongType()), T.StructField("core", T.IntegerType()), T.StructField("i", T.IntegerType())]))


def packed_runs(seqs: pa.Array, both: pa.Array, cores: bool = False) -> pa.Array:
    """For each sequence its runs of 1 to ``RUN`` neighbouring k-mers, each k-mer in one run: bases << 5 | both << 4 | number of k-mers less one.

    Runs with ``both`` stand for their reverse complement too and are given as the smaller of the two. K-mers that hold something else than A, C, G, T are in none.
    ``cores``: as ``RUN_AT``.
    """
    number, first, lengths = _bases(seqs)
    counts = np.maximum(lengths - K + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], counts)
    odd = np.concatenate([[0], np.cumsum(number > 3)])
    plain = odd[at + K] == odd[at]
    at, row = at[plain], row[plain]
    if not len(at):
        kind = pa.struct([("run", pa.int64()), ("core", pa.int32()), ("i", pa.int32())]) if cores else pa.int64()
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(counts) + 1), pa.int32()), pa.array([], kind))
    ahead = np.where(number > 3, 0, number).astype(np.int64)
    back = 3 - ahead[::-1]
    codes, turns = _joined(ahead, K), _joined(back, K)[::-1]
    core = np.minimum(_joined(ahead, CORE), _joined(back, CORE)[::-1]).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = core * np.uint64(0x9E3779B97F4A7C15)
    least = (mixed & ~np.uint64(0xFFFFFFFF)) | np.arange(len(core), dtype=np.uint64)
    span = 1
    while span * 2 <= RUN:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < RUN:
        least = np.minimum(least[: -(RUN - span)], least[RUN - span :])
    own = least[at]
    opens = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])]))
    size = np.diff(np.append(opens, len(at)))
    a, b, more = at[opens], at[opens + size - 1], 2 * (size - 1)
    mask = (np.int64(1) << more) - 1
    run, turned_run = codes[a] << more | codes[b] & mask, turns[b] << more | turns[a] & mask
    paired = both.to_numpy(zero_copy_only=False).astype(bool)[row[opens]]
    values = np.where(paired, np.minimum(run, turned_run), run) << 5 | paired.astype(np.int64) << 4 | size - 1
    stops = pa.array(np.searchsorted(row[opens], np.arange(len(counts) + 1)), pa.int32())
    runs = pa.array(values, pa.int64())
    if cores:
        core = (own[opens] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        runs = pa.StructArray.from_arrays([runs, pa.array(core), pa.array((a - first[row[opens]]).astype(np.int32))], ["run", "core", "i"])
    return pa.ListArray.from_arrays(stops, runs)


@F.arrow_udf(T.ArrayType(T.LongType()))
def kmer_runs(seqs: pa.Array, both: pa.Array) -> pa.Array:
    """Runs of neighbouring 20-mers of each sequence, see ``packed_runs``."""
    return packed_runs(seqs, both)


def run_codes(run: Column) -> Column:
    """The codes of a run's 20-mers."""
    more = run.bitwiseAND(F.lit(15)).cast("int")
    bases = F.shiftright(run, 5)
    # Cut in the array and not by a lambda, which would be interpreted row by row.
    codes = F.array(*[F.shiftright(bases, 2 * i).bitwiseAND(F.lit((1 << 2 * K) - 1)) for i in range(RUN)])
    return F.slice(codes, F.lit(1), more + 1)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def mismatches(one: pa.Array, two: pa.Array) -> pa.Array:
    """0-based places where two sequences of one length differ."""
    one, two = one.cast(pa.large_binary()), two.cast(pa.large_binary())
    sides = []
    for x in (one, two):
        offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
        sides.append((offsets, np.frombuffer(x.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]))
    (offsets, a), (_, b) = sides
    at = np.flatnonzero(a != b)
    ends = np.searchsorted(at, offsets - offsets[0])
    row = np.repeat(np.arange(len(one)), np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at - (offsets - offsets[0])[row], pa.int32()))


#: First byte of a packed read that holds something else than A, C, G, T: its text follows. Else the first byte is the number of bases in the last byte.
ODD = ord("x")
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)


def _flat(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of texts or byte strings; null is empty."""
    parts = parts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    return offsets - offsets[0], np.frombuffer(parts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def _built(kind: pa.DataType, offsets: np.ndarray, data: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(offsets) - 1, [valid, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _squeezed(bases: np.ndarray) -> np.ndarray:
    """Four numbers of two bits to a byte, row by row; the last byte ends with zeros."""
    wide = np.zeros((len(bases), -(-bases.shape[1] // 4) * 4), np.uint8)
    wide[:, : bases.shape[1]] = bases
    return wide[:, 0::4] << 6 | wide[:, 1::4] << 4 | wide[:, 2::4] << 2 | wide[:, 3::4]


def packed_reads(seqs: pa.Array, turn: np.ndarray | None = None, least: bool = False, own: bool = False) -> pa.Array:
    """Sequences of A, C, G, T as two bits for each base behind a byte that tells how many the last byte holds; others as ``ODD`` and their text.

    ``turn``: the rows to reverse and complement. ``least``: the smaller of both strands. ``own``: null where the sequence is the greater one.
    """
    offsets, data = _flat(seqs)
    number, sizes = _NUMBER[data].astype(np.uint8), np.diff(offsets)
    odd = np.diff(np.concatenate([[0], np.cumsum(number > 3)])[offsets]) > 0
    out_sizes = 1 + np.where(odd, sizes, -(-sizes // 4))
    out_at = np.concatenate([[0], np.cumsum(out_sizes)])
    out, missing = np.empty(out_at[-1], np.uint8), np.zeros(len(sizes), bool)
    for size in np.unique(sizes[~odd]):
        rows = np.flatnonzero(~odd & (sizes == size))
        bases = number[offsets[rows][:, None] + np.arange(size)]
        if size and (turn is not None or least or own):
            back = 3 - bases[:, ::-1]
            if turn is None:
                first, each = (bases != back).argmax(axis=1), np.arange(len(rows))
                greater = bases[each, first] > back[each, first]
                missing[rows] = greater & own
            bases = np.where((greater if turn is None else turn[rows])[:, None], back, bases)
        whole = np.concatenate([np.full((len(rows), 1), (size - 1) % 4 + 1, np.uint8), _squeezed(bases)], axis=1)
        out[out_at[rows][:, None] + np.arange(whole.shape[1])] = whole
    for i in np.flatnonzero(odd):
        out[out_at[i]] = ODD
        out[out_at[i] + 1 : out_at[i + 1]] = data[offsets[i] : offsets[i + 1]]
    return _built(pa.binary(), out_at, out, missing if own else None)


def unpacked_reads(packs: pa.Array, strands: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts, ends of each read's texts, whether a read differs from its reverse complement). ``strands``: the other strand follows, if it is another read of A, C, G, T."""
    offsets, data = _flat(packs)
    stored = np.diff(offsets)
    tag = data[offsets[:-1]]
    odd = tag == ODD
    sizes = np.where(odd, stored - 1, 4 * stored - 8 + tag.astype(np.int64))
    groups, paired = [], np.zeros(len(sizes), bool)
    for size in np.unique(sizes[~odd]):
        rows = np.flatnonzero(~odd & (sizes == size))
        whole = data[offsets[rows][:, None] + 1 + np.arange(-(-size // 4))]
        bases = np.stack([whole >> 6, whole >> 4 & 3, whole >> 2 & 3, whole & 3], axis=2).reshape(len(rows), -1)[:, :size]
        back = 3 - bases[:, ::-1]
        paired[rows] = (bases != back).any(axis=1)
        groups.append((rows, bases, back))
    counts = 1 + (paired & strands)
    ends = np.concatenate([[0], np.cumsum(counts)])
    text_at = np.concatenate([[0], np.cumsum(np.repeat(sizes, counts))])
    out = np.empty(text_at[-1], np.uint8)
    for rows, bases, back in groups:
        out[text_at[ends[rows]][:, None] + np.arange(bases.shape[1])] = _LETTERS[bases]
        if strands:
            two = paired[rows]
            out[text_at[ends[rows[two]] + 1][:, None] + np.arange(bases.shape[1])] = _LETTERS[back[two]]
    for i in np.flatnonzero(odd):
        out[text_at[ends[i]] : text_at[ends[i] + 1]] = data[offsets[i] + 1 : offsets[i + 1]]
    return _built(pa.string(), text_at, out), ends, paired


@F.arrow_udf(T.BinaryType())
def least_pack(seqs: pa.Array) -> pa.Array:
    """The smaller strand of each sequence, packed."""
    return packed_reads(seqs, least=True)


@F.arrow_udf(T.BinaryType())
def own_pack(seqs: pa.Array) -> pa.Array:
    """Each sequence, packed, null if its reverse complement is smaller."""
    return packed_reads(seqs, own=True)


@F.arrow_udf(T.BooleanType())
def same_bases(packs: pa.Array, texts: pa.Array, ahead: pa.Array) -> pa.Array:
    """Whether a packed read is a text, or its reverse complement where not ``ahead``."""
    return pc.fill_null(pc.equal(packs, packed_reads(texts, turn=~ahead.fill_null(True).to_numpy(zero_copy_only=False).astype(bool))), False)


@F.arrow_udf(T.ArrayType(T.StringType()))
def strands(packs: pa.Array) -> pa.Array:
    """The read of each pack and, if it is another, its reverse complement."""
    texts, ends, _ = unpacked_reads(packs, strands=True)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts)


def _turned(codes: np.ndarray, k: int = K) -> np.ndarray:
    """``turned`` of an array."""
    x = codes.astype(np.uint64) ^ np.uint64((1 << 2 * k) - 1)
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = (x >> np.uint64(shift)) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(shift)
    return (x >> np.uint64(64 - 2 * k)).astype(np.int64)


def pack_ends(pack: Column, margins: tuple[int, ...]) -> Column:
    """The codes of ``packed_ends`` of a packed read, each with that of its reverse complement behind it; then, if the read's reverse complement is another read, of that."""

    def run(packs: pa.Array) -> pa.Array:
        texts, ends, _ = unpacked_reads(packs, strands=True)
        codes = packed_ends(texts, margins).flatten()
        none, own = codes.is_null().to_numpy(zero_copy_only=False), codes.fill_null(0).to_numpy()
        both = pa.array(np.stack([own, _turned(own)], axis=1).ravel(), pa.int64(), mask=np.repeat(none, 2))
        return pa.ListArray.from_arrays(pa.array(4 * len(margins) * ends, pa.int32()), both)

    return F.arrow_udf(run, T.ArrayType(T.LongType()))(pack)


@F.arrow_udf(T.StringType())
def pack_text(packs: pa.Array, turn: pa.Array) -> pa.Array:
    """The text of each packed read, or of its reverse complement where ``turn``; reads with other letters are never turned."""
    texts, _, _ = unpacked_reads(packs)
    (offsets, data), flags = _flat(texts), turn.to_numpy(zero_copy_only=False).astype(bool)
    out, sizes = data.copy(), np.diff(offsets)
    for size in np.unique(sizes[flags]):
        at = offsets[:-1][flags & (sizes == size)][:, None] + np.arange(size)
        out[at] = _LETTERS[3 - _NUMBER[data[at][:, ::-1]]]
    return _built(pa.string(), offsets, out)


#: What a base (or another letter) adds to a name, and the odd number whose powers tell its place; powers of the other number undo them.
_WORTH = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_OTHER = np.array([3, 2, 1, 0, 4])


def _names(number: np.ndarray, size: int) -> np.ndarray:
    """The names of all windows of ``size`` bases of rows of base numbers: the smaller one of both strands' sums of bases times powers of their places, modulo 2^64.

    Sums from a row's start tell every window by one subtraction, so the work does not grow with ``size``.
    """
    n = number.shape[1]
    up, down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_STEP, _BACK))
    none, out = np.zeros((len(number), 1), np.uint64), []
    for worth, power, undo in ((_WORTH, up, down[: n - size + 1]), (_WORTH[_OTHER], down, up[size - 1 :])):
        sums = np.concatenate([none, np.cumsum(worth[number] * power, axis=1, dtype=np.uint64)], axis=1)
        out.append((sums[:, size:] - sums[:, : n - size + 1]) * undo)
    return np.minimum(*out).view(np.int64)


def named_windows(seqs: pa.Array, size: int | None = None) -> pa.Array:
    """For each sequence the names of its windows of ``size`` bases in order, or of the whole; equal texts and reverse complements have equal names.

    Different ones nearly always have different names, which is for the caller to check.
    """
    offsets, data = _flat(seqs)
    number, widths = _NUMBER[data], np.diff(offsets)
    counts = np.minimum(widths, 1) if size is None else np.maximum(widths - size + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(ends[-1], np.int64)
    for width in np.unique(widths[counts > 0]):
        rows = np.flatnonzero(widths == width)
        for part in np.split(rows, range(512, len(rows), 512)):
            names = _names(number[offsets[part][:, None] + np.arange(width)], size or int(width))
            out[ends[part][:, None] + np.arange(names.shape[1])] = names
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def window_names(seq: Column, size: int) -> Column:
    """The names of all windows of ``size`` bases, see ``named_windows``."""
    return F.arrow_udf(lambda seqs: named_windows(seqs, size), T.ArrayType(T.LongType()))(seq)


@F.arrow_udf(T.LongType())
def read_name(seqs: pa.Array) -> pa.Array:
    """The name of each sequence as a whole, see ``named_windows``; 0 of an empty one."""
    found = named_windows(seqs)
    whole = np.zeros(len(seqs), np.int64)
    whole[np.diff(found.offsets.to_numpy()) > 0] = found.values.to_numpy()
    return pa.array(whole)


def _runs_of_packs(packs: pa.Array, cores: bool = False) -> pa.Array:
    texts, _, paired = unpacked_reads(packs)
    texts = pc.if_else(pc.match_substring(texts, "N"), "", texts)
    return packed_runs(texts, pa.array(paired), cores)


@F.arrow_udf(T.ArrayType(T.LongType()))
def pack_runs(packs: pa.Array) -> pa.Array:
    """Runs of neighbouring 20-mers of each packed read, which stands for both strands; none of reads with N."""
    return _runs_of_packs(packs)


@F.arrow_udf(RUN_AT)
def pack_runs_at(packs: pa.Array) -> pa.Array:
    """The runs of ``pack_runs`` with their cores."""
    return _runs_of_packs(packs, True)


@F.arrow_udf(RUN_AT)
def runs_at(seqs: pa.Array) -> pa.Array:
    """The runs of one strand of each sequence with their cores and places."""
    return packed_runs(seqs, pa.array(np.zeros(len(seqs), bool)), True)


def pack_size(pack: Column) -> Column:
    """The number of bases of a packed read of A, C, G, T; null for others."""
    tag = F.conv(F.hex(F.substring(pack, 1, 1)), 16, 10).cast("int")
    return F.when(tag <= 4, 4 * F.octet_length(pack) - 8 + tag)


def read_size(pack: Column) -> Column:
    """The number of letters of a packed read of any letters."""
    return F.coalesce(pack_size(pack), F.length(F.substring(pack, F.lit(2), F.octet_length(pack)).cast("string")))


def first_code(pack: Column) -> Column:
    """The code of a packed read's first 20-mer: its first five bytes."""
    return F.conv(F.hex(F.substring(pack, 2, K // 4)), 16, 10).cast("long")


def turned(code: Column, k: int = K) -> Column:
    """The code of the reverse complement: bases swap places by halves of ever smaller size, and A and T, C and G are each other's complement."""
    x = code.bitwiseXOR(F.lit((1 << 2 * k) - 1 if k < 32 else -1))
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftright(x, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), shift))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def spelled(code: Column, k: int = K) -> Column:
    """The bases of a code: four at a time from a table, the rest one by one."""
    four = F.array(*[F.lit("".join(p)) for p in product(BASES, repeat=4)])
    one = F.array(*map(F.lit, BASES))
    digit = lambda at, size: F.shiftright(code, 2 * (k - at - size)).bitwiseAND(F.lit(4**size - 1)).cast("int")
    parts = [F.get(four, digit(i, 4)) for i in range(0, k - k % 4, 4)] + [F.get(one, digit(i, 1)) for i in range(k - k % 4, k)]
    return reduce(F.concat, parts)


def with_text(df: DataFrame, code: str, text: str, k: int = K) -> DataFrame:
    """Put the bases in place of a column of codes."""
    return df.select(*[spelled(F.col(c), k).alias(text) if c == code else F.col(c) for c in df.columns])


def chr_key(chr_: Column) -> Column:
    """Sort key of chromosome names: numbers padded to three places."""
    return F.when(chr_.rlike("^[0-9]+$") & (F.length(chr_) < 3), F.lpad(chr_, 3, "0")).otherwise(chr_)


def plain_chr(name: Column) -> Column:
    """Name of a sequence: first word, without ">" and a leading "chr"; numbers lose leading zeros."""
    word = F.regexp_replace(F.regexp_extract(name, r"^>?\s*(\S*)", 1), r"(?i)^chr", "")
    return F.when(word.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.regexp_replace(word, "^0+", ""), F.lit("")), F.lit("0"))).otherwise(word)
