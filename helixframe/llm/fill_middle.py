"""Fill-in-the-middle: texts cut in prefix, middle and suffix and put together with sentinels, reversibly.

A table-driven automaton over bytes reads every text once. Its state holds how many UTF-8 continuation bytes are due, how much
of a sentinel has been read and, for line units, whether a line begins; a transition emits one unit, one sentinel, both or neither. The
first pass sums what is emitted, the second goes back to the one lane of ``LANE`` bytes that holds a cut and stops at its unit.

Texts are read in lanes side by side. Each state follows from the last few bytes (three for UTF-8, a sentinel's length, one for a
line's begin), so a lane that starts so many bytes early is in the right state when its own bytes begin; a text's first lane starts at the text.

Python sees texts only to count and locate; Spark cuts the bytes, joins the pieces and rebuilds the text. Each task holds
one Arrow batch.

Edge cases: null text counts as empty; empty texts, texts that hold a sentinel and the share that is left as it is are plain, with
null counts of prefix and middle; a null doc_id has no digits; repeated rows are each transformed alike; empty tables give no rows; extra columns
are kept, but for those named like a result; bytes that are not UTF-8 are units of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Bytes that a lane reads, and about how many of a batch are read at once.
LANE, BLOCK = 256, 4 << 20
#: What a transition holds, from the lowest bit: the next state, whether a unit begins, whether a sentinel ends.
UNIT, HIT, MASK = 16, 32, (1 << 16) - 1
RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass(frozen=True)
class Machine:
    """The transition table (states x 256) and how many bytes decide a state."""

    table: np.ndarray
    reach: int


def _due(byte: int) -> int:
    """Continuation bytes behind a first byte."""
    return 1 if 0xC0 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF8 else 0


def machine(sentinels: tuple[str, ...], unit: str = "char") -> Machine:
    """The automaton for units of code points ("char") or lines ("line") and these sentinels."""
    names = [s.encode() for s in sentinels]
    texts = {n[:i] for n in names for i in range(len(n) + 1)} | {b""}
    # What is known of a sentinel is the longest end of the text that begins one.
    longest = lambda seen: next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in texts)
    ids, todo, rows = {(0, b"", True): 0}, [(0, b"", True)], []
    while todo:
        due, seen, fresh = todo.pop(0)
        row = np.zeros(256, np.int64)
        for byte in range(256):
            inside = due > 0 and 0x80 <= byte < 0xC0
            begins = not inside and (unit == "char" or fresh)
            now = seen + bytes([byte])
            state = (due - 1 if inside else _due(byte), longest(now), unit == "line" and byte == 10)
            if state not in ids:
                ids[state] = len(ids)
                todo.append(state)
            row[byte] = ids[state] | begins << UNIT | any(now.endswith(n) for n in names) << HIT
        rows.append(row)
    if len(rows) > 256:
        raise ValueError("the sentinels are too long")
    return Machine(np.concatenate(rows), max(3, *map(len, names)))


@dataclass
class Scan:
    """Units and sentinels of the texts that lie end to end in ``data`` between ``offsets``."""

    machine: Machine
    data: np.ndarray
    offsets: np.ndarray
    units: np.ndarray = field(init=False)
    hits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        lengths = np.diff(self.offsets)
        lanes = -(-lengths // LANE)
        self.first = np.concatenate([[0], np.cumsum(lanes)])
        text = np.repeat(np.arange(len(lengths)), lanes)
        k = np.arange(len(text)) - self.first[text]
        self.start = self.offsets[text] + k * LANE
        self.size = np.minimum(LANE, self.offsets[text + 1] - self.start)
        self.state = np.zeros(len(text), np.int64)
        later, table, reach = np.flatnonzero(k), self.machine.table, self.machine.reach
        for t in range(-reach, 0):
            self.state[later] = table[self.state[later] << 8 | self.data[self.start[later] + t]] & MASK
        emitted = self._emitted()
        self.before = np.concatenate([[0], np.cumsum(emitted >> UNIT & MASK)])
        hits = np.concatenate([[0], np.cumsum(emitted >> HIT)])
        self.units, self.hits = np.diff(self.before[self.first]), np.diff(hits[self.first])

    def _emitted(self) -> np.ndarray:
        """What each lane's transitions emit in all; the states in the low bits add up to less than a unit's bit."""
        order = np.argsort(-self.size, kind="stable")
        at, state, size = self.start[order], self.state[order], self.size[order]
        sums = np.zeros(len(at), np.int64)
        for t, live in enumerate(np.searchsorted(-size, -np.arange(LANE))):
            move = self.machine.table[state[:live] << 8 | self.data[at[:live] + t]]
            sums[:live] += move
            state[:live] = move & MASK
        out = np.empty_like(sums)
        out[order] = sums
        return out

    def locate(self, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Bytes of each text before its given unit (all, if it has no more units)."""
        found = np.diff(self.offsets)[text]
        open_ = np.flatnonzero(unit < self.units[text])
        goal = self.before[self.first[text[open_]]] + unit[open_]
        lane = np.searchsorted(self.before[1:], goal, side="right")
        rest, at, state = goal - self.before[lane], self.start[lane], self.state[lane]
        for _ in range(LANE):
            move = self.machine.table[state << 8 | self.data[at]]
            begins = move >> UNIT & 1
            here = (begins == 1) & (rest == 0)
            found[open_[here]] = at[here] - self.offsets[text[open_[here]]]
            left = ~here
            open_, rest, at, state = open_[left], (rest - begins)[left], at[left] + 1, (move & MASK)[left]
            if not len(open_):
                break
        return found


def _blocks(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` bytes; a longer text is a block of its own."""
    cuts = [0]
    while cuts[-1] < len(offsets) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + BLOCK, side="right")) - 1))
    return list(zip(cuts, cuts[1:], strict=False))


def cuts(texts: pa.Array, one: np.ndarray, two: np.ndarray, automaton: Machine) -> pa.StructArray:
    """n, hits, and of both cuts (numbers modulo n + 1, smaller first) the units and bytes before them."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out: list[tuple[np.ndarray, ...]] = []
    for i, j in _blocks(offsets):
        scan = Scan(automaton, data, offsets[i : j + 1])
        at = [one[i:j] % (scan.units + 1), two[i:j] % (scan.units + 1)]
        first, second, every = np.minimum(*at), np.maximum(*at), np.arange(j - i)
        out.append((scan.units, scan.hits, first, second, scan.locate(every, first), scan.locate(every, second)))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "hits", "first", "second", "first_bytes", "second_bytes"])


def _checked(sentinels: tuple[str, str, str]) -> None:
    """A sentinel must not begin where another ends, else text and sentinels could be read in two ways."""
    parts = [(s, t) for s in sentinels for t in sentinels]
    if not all(sentinels) or len(set(sentinels)) < 3 or any(s != t and s in t for s, t in parts) or any(s[i:] == t[: len(s) - i] for s, t in parts for i in range(1, len(s))):
        raise ValueError("sentinels must be distinct and must not overlap")


def hashed(doc_id: Column, seed: str, k: int) -> Column:
    """The k-th group of eight hex digits of the id's digest, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"), rate: int = 90, spm_rate: int = 20, seed: str = "1", unit: str = "char") -> DataFrame:
    """The documents with n (units), form, prefix_chars, middle_chars (units) and output.

    ``rate`` percent of the documents are transformed, ``spm_rate`` percent of these with the suffix in front. Two hashes of the id place
    the cuts, two more choose the form.
    """
    _checked(sentinels)
    automaton = machine(sentinels, unit)
    found, text = free_name("found", docs.columns), free_name("whole", docs.columns)

    @F.arrow_udf("n long, hits long, first long, second long, first_bytes long, second_bytes long")
    def located(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        return cuts(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False), automaton)

    h = [hashed(F.col("doc_id"), seed, k) for k in range(4)]
    rows = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn(found, located(F.col(text), h[0], h[1]))
    at = lambda name: F.col(f"{found}.{name}")
    plain = (at("n") == 0) | (at("hits") > 0) | (F.pmod(h[2], F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm_rate, "spm").otherwise("psm")
    raw, a, b = F.col(text).cast("binary"), at("first_bytes").cast("int"), at("second_bytes").cast("int")
    piece = lambda start, size: F.substring(raw, start, size).cast("string")
    prefix, middle, suffix = piece(F.lit(1), a), piece(a + 1, b - a), piece(b + 1, F.octet_length(F.col(text)) - b)
    p, s, m = map(F.lit, sentinels)
    formed = rows.withColumn(free_name("formed", docs.columns), form)
    form = F.col(formed.columns[-1])
    output = F.when(form == "plain", F.col(text)).when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT]
    return formed.select(
        *kept, at("n").alias("n"), form.alias("form"), F.when(form != "plain", at("first")).alias("prefix_chars"), F.when(form != "plain", at("second") - at("first")).alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text from an output and its form alone."""
    parts = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), 4)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def digest(formed: DataFrame) -> DataFrame:
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
