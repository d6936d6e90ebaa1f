"""Token ids of whole texts, one tokenizer call per distinct pre-token.

A BPE tokenizer encodes every pre-token (a word with its leading space, a run of digits, ...)
independently of its neighbours. Corpora repeat their pre-tokens, so a batch of texts is cut into
pre-tokens with vectorised numpy operations on code points, the distinct ones are encoded once by
the ``tokenizers`` library, and all texts are assembled from that table. The table lives as long as
the Python worker and is emptied when it exceeds ``MAX_CACHED`` pre-tokens.

Texts holding a special token's string, or a character that changes its class when lower-cased, are
encoded whole by the library. The result equals ``Tokenizer.encode(text, add_special_tokens=False)``
in every case; the tests compare the two.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

MAX_CACHED = 1_500_000
#: Code points handled at once; bounds the memory of the vectorised steps.
CHUNK_CHARS = 500_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def _contraction_ends(cp: np.ndarray, start: np.ndarray, fold: bool) -> np.ndarray:
    """Length of the contraction ('s 't 'm 'd 're 've 'll) at each start that is an apostrophe, else 0."""
    padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
    a, b = padded[start + 1], padded[start + 2]
    if fold:
        a = np.where((a >= 65) & (a <= 90), a + 32, a)
        b = np.where((b >= 65) & (b <= 90), b + 32, b)
    one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    return np.where(one, 2, np.where(two, 3, 0))


def split_points(cp: np.ndarray, text_ends: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens of texts concatenated in ``cp``.

    ``spaced``: a space joins the run behind it, white space is kept and numbers form runs; otherwise
    white space is dropped and every number stands alone.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes()[cp]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    if not spaced:
        first |= kind == NUMBER
    opens = text_ends[:-1][text_ends[:-1] < n]
    first[opens] = True
    text_start = np.zeros(n + 1, bool)
    text_start[opens] = True
    text_start[0] = True
    text_start[n] = True
    if spaced:
        # The last character of a white-space run before a word: a space opens the word, anything else stands alone.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:n])
        blank = cp[last] == 32
        first[last] = True
        first[last[blank] + 1] = False
    # A contraction needs its apostrophe at the start of a pre-token and splits the letters behind it.
    quotes = np.flatnonzero((cp == 39) & first)
    if len(quotes):
        whole = quotes + 2 <= n
        quotes = quotes[whole]
        size = _contraction_ends(cp, quotes, fold=not spaced)
        owner = np.searchsorted(text_ends, quotes, side="right")
        size = np.where(quotes + size <= text_ends[owner], size, np.where(quotes + 2 <= text_ends[owner], _short(cp, quotes, not spaced), 0))
        hit = size > 0
        at, size = quotes[hit], size[hit]
        first[at + 1] = False
        two = at[size == 3]
        first[two + 2] = False
        ends = at + size
        ends = ends[ends < n]
        first[ends] = True
        if spaced:
            # " 's": the space was taken by the run it opens, so such an apostrophe is no start and never gets here.
            glued = ends[(cp[ends] == 32) & ~text_start[ends]]
            glued = glued[glued + 1 < n]
            keep = (kind[glued + 1] != SPACE) & ~text_start[glued + 1]
            first[glued[keep] + 1] = False
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    if not spaced:
        real = kind[starts] != SPACE
        starts, ends = starts[real], ends[real]
    return starts, ends


def _short(cp: np.ndarray, quotes: np.ndarray, fold: bool) -> np.ndarray:
    nxt = cp[np.minimum(quotes + 1, len(cp) - 1)]
    if fold:
        nxt = np.where((nxt >= 65) & (nxt <= 90), nxt + 32, nxt)
    return np.where(np.isin(nxt, np.frombuffer("stmd".encode("utf-32-le"), np.uint32)), 2, 0)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(which: int, n: int) -> np.ndarray:
    have = _POWERS[which]
    if len(have) < n:
        grown = np.full(max(n, 2 * len(have), 1024), _BASES[which], np.uint64)
        grown[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[which] = np.cumprod(grown, dtype=np.uint64)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def piece_keys(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each pre-token's content; equal contents get equal keys."""
    long = np.repeat(starts, ends - starts) if len(starts) else starts
    offset = np.concatenate([[0], np.cumsum(ends - starts)[:-1]]) if len(starts) else starts
    if len(starts) and (ends[:-1] == starts[1:]).all():
        values, place = cp[starts[0] : ends[-1]], np.arange(starts[0], ends[-1]) - long
    else:
        place = np.arange(len(long)) - np.repeat(offset, ends - starts)
        values = cp[long + place]
    with np.errstate(over="ignore"):
        wide = _mix((values.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        wide *= _powers(0, int(place.max()) + 1 if len(place) else 1)[place]
        return _mix(np.add.reduceat(wide, offset) + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)


class Encoder:
    """Encodes lists of texts to one flat id array with a count per text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.spaced = kind == "ByteLevel"
        self.fold = self.tokenizer.normalizer is not None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.recent: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _find(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, place in ``ids``, number of ids) of each key, from the large table and the recent small ones."""
        known = np.zeros(len(distinct), bool)
        at, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int32)
        for keys, places, sizes in [(self.keys, self.at, self.size), *self.recent]:
            if len(keys):
                slot = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[slot] == distinct
                known |= hit
                at[hit], size[hit] = places[slot[hit]], sizes[slot[hit]]
        return known, at, size

    def _settle(self) -> None:
        """Merge the small tables into the large one."""
        keys, at, size = (np.concatenate(x) for x in zip((self.keys, self.at, self.size), *self.recent, strict=True))
        order = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size, self.recent = keys[order], at[order], size[order], []

    def _whole(self, text: str) -> bool:
        if self.fold:
            low = text.lower() if "<|" in text else ""
            return "İ" in text or bool(low) and any(s.lower() in low for s in self.special)
        return "<|" in text and any(s in text for s in self.special)

    def _learn(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        """Encode pre-tokens that the table lacks."""
        blob = cp.astype("<u4").tobytes()
        words = [blob[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]
        sizes, flat = [], []
        for i in range(0, len(words), 20_000):
            done = self.tokenizer.encode(words[i : i + 20_000], is_pretokenized=True, add_special_tokens=False)
            owner = np.array(done.word_ids, np.int64)
            flat.append(np.array(done.ids, np.uint32))
            sizes.append(np.bincount(owner, minlength=len(words[i : i + 20_000])))
        size = np.concatenate(sizes).astype(np.int32)
        ids = np.concatenate(flat)
        at = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.recent.append((keys, at, size))
        if len(self.recent) >= 8:
            self._settle()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); null counts as empty."""
        flat, counts, group, size = [], [], [], 0
        for text in texts:
            text = text or ""
            if self._whole(text):
                self._flush(group, flat, counts)
                group, size = [], 0
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                flat.append(ids)
                counts.append(np.array([len(ids)], np.int64))
                continue
            if self.fold and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            group.append(text)
            size += len(text)
            if size >= CHUNK_CHARS:
                self._flush(group, flat, counts)
                group, size = [], 0
        self._flush(group, flat, counts)
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))

    def _flush(self, group: list[str], flat: list, counts: list) -> None:
        if not group:
            return
        text_ends = np.cumsum([len(t) for t in group])
        cp = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = split_points(cp, text_ends, self.spaced)
        if not len(starts):
            counts.append(np.zeros(len(group), np.int64))
            return
        keys = piece_keys(cp, starts, ends)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MAX_CACHED:
            self._clear()
        known, at, size = self._find(distinct)
        if not known.all():
            i = where[~known]
            self._learn(cp, starts[i], ends[i], distinct[~known])
            known, at, size = self._find(distinct)
        at, size = at[back], size[back].astype(np.int64)
        stop = np.cumsum(size)
        out = np.arange(stop[-1]) + np.repeat(at - (stop - size), size)
        flat.append(self.ids[out])
        owner = np.searchsorted(text_ends, starts, side="right")
        counts.append(np.bincount(owner, weights=size, minlength=len(group)).astype(np.int64))


#: Texts encoded at once by the operators; their ids are held together.
SLICE = 256


def encoded_slices(path: str, batch) -> Iterator[tuple]:
    """(part of a pandas batch with a column text, ids of its texts, number of ids of each)."""
    for i in range(0, len(batch), SLICE):
        part = batch.iloc[i : i + SLICE]
        yield part, *encoder(path).encode(part["text"].where(part["text"].notna(), None).tolist())


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)
