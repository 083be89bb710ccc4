"""Near-duplicate passages by compact windows.

The units of a text are its five-word shingles. Under one hash function, the windows of ``size`` units with the same
smallest unit form one interval: that of a node of the Cartesian tree over the unit hashes whose span holds a window.
So a text has about 2 n / size such compact windows for each function, and windows of two texts with a common smallest
unit meet in one group. Each member of a group is linked with the group's first document and with the one before it,
never with all. The same windows, cut wherever an interval of the first three functions ends, form cells: the windows of
a cell share the smallest units of these functions. Cells with the same smallest units at the same distances and the same
units between them meet as well; there each is linked with the farthest reaching one that begins before it, which
connects all that overlap, so equal passages are connected also where their frequent units are shared with many other
contents. The intervals of a pair on one diagonal are joined over the functions; the stretches on which enough functions (or one cell)
agree are verified on the units themselves, window by window: windows with a similarity of at least ``least`` that
follow each other are one span.

What a group's first and previous member leave open is tried in a second pass (``rest``), which joins the classes of the
first. Two windows of 46 different units with a similarity of 0.8 share at least 41, so at most five are missing; a changed, added
or left out word costs four or five, so the common units stand in at most two stretches, and the longer one is an equal run
of at least 20 units. Of each run of 20 units a shingle of 11 (then, where it is found in several classes, one of 16) is
taken by the same compact windows; of the places that share it, all pairs from different classes with different units
around are compared, in blocks. Windows of any kind, also with repeated units or moved pieces, meet there too if two functions
agree on them (``agreeing``): all members of a pair of groups that are in different classes, wherever the places stand, except
where both smallest units are found in more than CLASSES classes. Pairs are verified on every diagonal.

Keys that are frequent in a 64th of the documents need no group of their own. Intervals of one function are dealt to
buckets of documents, and are linked within them and with the key's first member in that 64th. Cells are linked with the
first member in it for each of their starts; the starts that none of it covers form a group each.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WHITE_BYTES, maybe_asked, mix64, text_of
from tickloom.llm.components import components
from tickloom.llm.packed import buckets_for, packed, schema, unpacked
from tickloom.session import materialized, shuffles_released

WORDS, PASSAGE = 5, 50
FUNCTIONS, ENOUGH, LEAST = 5, 2, 0.8
#: In the lowest bits of a key, in place of a function: the key of a cell; and how many functions agree in one.
CELL, CELL_FUNCTIONS = 7, 3
#: A key is frequent if it is among the MOST keys with at least HOT windows in one of SAMPLE parts of the documents.
SAMPLE, HOT, MOST, BUCKETS = 64, 64, 1000, 64
#: Agreements on two smallest units that are both found in more classes than this are left to the equal runs.
CLASSES = 256
#: Units of the shingles that stand for a run of equal units, in the first and the second look at it.
GRAMS = (11, 16)
#: Places that are compared with each other at a time, counters of their units, and pairs that are verified at a time.
BLOCK, COUNTERS, PAIRS = 1024, 512, 1024
#: Windows that are verified at a time.
SLICE = 512
#: Characters that are hashed at a time; positions must fit into POSITION bits.
CHUNK, POSITION = 1 << 20, 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Bytes with A-Z lower-cased and white space as a space.
_PLAIN = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(WHITE_BYTES, b" " * len(WHITE_BYTES))), np.uint8)


@functools.cache
def _table(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; those of a usual chunk are kept."""
    return _table(base, 2 * CHUNK)[:n] if n <= 2 * CHUNK else _table.__wrapped__(base, n)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def units(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts (A-Z lower-cased, white space as one space), and how many each has."""
    found = [t.encode("utf-8", "replace") for t in texts]
    data = _PLAIN[np.frombuffer(b" ".join([*found, b""]), np.uint8)]
    letter = data != 32
    held = letter.copy()
    held[1:] |= letter[:-1]  # a space ends a word, further ones go
    upto = np.cumsum([len(f) + 1 for f in found], dtype=np.int64)
    counts = np.diff(np.searchsorted(np.flatnonzero(held & ~letter), upto), prepend=0)
    data = data[held]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # sums of code x base^position: a stretch is the difference of two sums, moved to position 0
    sums = _sums(_CODE[data] * _powers(_BASE, len(data)))
    ends = np.flatnonzero(data == 32)
    begins = np.concatenate([[0], ends[:-1] + 1])
    own = np.maximum(counts - words + 1, 0)
    first = np.repeat(np.cumsum(counts) - counts, own) + _places(own)
    start, end = begins[first], ends[first + words - 1]
    return mix64((sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start]), own


def _bits(size: int) -> int:
    """Bits of a distance within a window."""
    return int(size).bit_length()


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def compact_windows(values: np.ndarray, sizes: np.ndarray, size: int, function: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: text number, key, place of the smallest unit, and how far before it the windows start
    (least, most). The key has the function in its lowest three bits."""
    hashed = mix64(values ^ mix64(np.uint64(function + 1) * _CODE[:1])[0])
    at = np.arange(len(values), dtype=np.uint64)
    low = (hashed & ~np.uint64((1 << POSITION) - 1)) | at  # smallest hash, then leftmost
    reach = 1
    while reach * 2 <= size:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    if reach < size:
        low = np.minimum(low[: len(low) - (size - reach)], low[size - reach:])
    where = (low & np.uint64((1 << POSITION) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(text[: len(where)] == text[size - 1:])
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    where = where[inside]
    new = np.concatenate([[True], (where[1:] != where[:-1])])
    first, last = inside[new], inside[np.concatenate([new[1:], [True]])]
    c = where[new]
    key = (mix64(hashed[c]) & ~np.uint64(7)) | np.uint64(function)
    begin = (np.cumsum(sizes) - sizes)[text[c]]
    return text[c], key.view(np.int64), c - begin, c - last, c - first


def cells(values: np.ndarray, sizes: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """From the compact windows of some functions, the stretches of windows in which none of them changes: text number,
    key, place of the smallest unit under the first function, and how far before it the windows start (least, most)."""
    begin = np.cumsum(sizes) - sizes
    text, _, c, least, most = found[0]
    runs = most - least + 1
    start, text = np.repeat(c + begin[text] - most, runs) + _places(runs), np.repeat(text, runs)
    new, low, high, key, origin = np.zeros(len(start), bool), None, None, np.uint64(0), None
    for own, _, c, least, most in found:
        runs = most - least + 1
        new[np.cumsum(runs) - runs] = True
        where = np.repeat(c + begin[own], runs)
        origin = where if origin is None else origin
        low, high = (where, where) if low is None else (np.minimum(low, where), np.maximum(high, where))
        key = mix64(key * _BASE + values[where] + (where - origin).view(np.uint64))
    sums = _sums(mix64(values))
    key = mix64(key[new] ^ mix64(sums[high[new] + 1] - sums[low[new]])) & ~np.uint64(7) | np.uint64(CELL)
    first, last, c = start[new], start[np.concatenate([new[1:], [True]])], origin[new]
    return text[new], key.view(np.int64), c - begin[text[new]], c - last, c - first


def _chunks(texts: list[str]) -> Iterator[slice]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t)
    yield slice(begin, len(texts))


class Frequent:
    """The frequent keys, sorted, and the first hit (doc, at) for each of them and each start: of intervals of one function
    the first column alone is used, of cells that of -start. ``seen``: windows in the sample."""

    def __init__(self, found: list[tuple[int, int, int, int]], size: int, seen: int = 0):
        self.bits, self.seen = _bits(size), seen
        self.keys = np.array(sorted({key for key, *_ in found}), np.int64)
        self.hits = np.array([(doc, at) for *_, doc, at in found], np.int64).reshape(-1, 2)
        self.of = np.full((len(self.keys), size), -1, np.int64)
        for i, (key, before, *_) in enumerate(found):
            self.of[np.searchsorted(self.keys, key), before] = i

    def dealt(self, key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows (key, doc, at, hit or -1) in place of rows (key, doc, at)."""
        none = np.full(len(key), -1, np.int64)
        if not len(self.keys) or not len(key):
            return [(key, doc, at, none)]
        index = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        frequent = self.keys[index] == key
        out = [(key[~frequent], doc[~frequent], at[~frequent], none[~frequent])]
        key, doc, at, index = key[frequent], doc[frequent], at[frequent], index[frequent]
        number = mix64(doc.astype(np.int64).view(np.uint64))
        if len(key) and key[0] & 7 != CELL:
            return [*out, (_part_of(key, number % np.uint64(BUCKETS)), doc, at, self.of[index, 0])]
        bits, mask = self.bits, (1 << self.bits) - 1
        least, most = at >> bits & mask, at & mask
        row = np.repeat(np.arange(len(key)), most - least + 1)
        before = least[row] + _places(most - least + 1)
        hit = self.of[index[row], before]
        met = hit >= 0
        pairs = np.unique(np.stack([row[met], hit[met]]), axis=1)
        # a row with a hit has nothing to meet: its key is its own
        own = _part_of(key, mix64(number + at.view(np.uint64)))
        out.append((own[pairs[0]], doc[pairs[0]], at[pairs[0]], pairs[1]))
        row, before = row[~met], before[~met]
        c = at[row] >> 2 * bits
        return [*out, (_part_of(key[row], before.view(np.uint64)), doc[row], c << 2 * bits | before << bits | before, np.full(len(row), -1, np.int64))]


def _part_of(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A key for each part of a key; the lowest bits stay."""
    key = key.view(np.uint64)
    return (mix64((key & ~np.uint64(7)) ^ mix64((part + np.uint64(1)) * _BASE)) & ~np.uint64(7) | (key & np.uint64(7))).view(np.int64)


WINDOWS = "key long, doc long, at long"


def _top(bits: int) -> int:
    """The bits of ``at`` from this one on are a number of its own."""
    return POSITION + 2 * bits


def _windows(size: int, functions: int, frequent: Frequent):
    """(doc, text) -> (key, doc, at): ``at`` is the place of the smallest unit, then least and most in a few bits each; above them
    comes the number of the hit of a frequent key, from 1 on. """

    bits = _bits(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for part in _chunks(texts):
                values, sizes = units(texts[part])
                if len(values) < size:
                    continue
                found = [compact_windows(values, sizes, size, function) for function in range(functions)]
                for text, key, c, least, most in [*found, cells(values, sizes, found[:CELL_FUNCTIONS])]:
                    for keys, doc, at, hit in frequent.dealt(key, ids[part][text], c << 2 * bits | least << bits | most):
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(doc), pa.array(hit + 1 << _top(bits) | at)], ["key", "doc", "at"])

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, asked = [(begin, size)]) -> (doc, begin, size, units as 32-bit values)."""
    for batch in batches:
        ids, texts, asked = np.asarray(batch.column(0)), batch.column(1).to_pylist(), batch.column(2)
        for part in _chunks(texts):
            values, sizes = units(texts[part])
            values, lists = values.astype(np.uint32), asked.slice(part.start, part.stop - part.start)
            begin, size = (np.asarray(c, np.int64) for c in lists.flatten().flatten())
            of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            # another text of this id may be shorter
            held = np.clip(sizes[of] - begin, 0, size)
            at = (np.cumsum(sizes) - sizes)[of] + begin
            for cut in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(held) // CHUNK)) + 1):
                ends = np.concatenate([[0], np.cumsum(4 * held[cut])]).astype(np.int32)
                found = values[np.repeat(at[cut], held[cut]) + _places(held[cut])]
                cols = [pa.array(ids[part][of[cut]]), pa.array(begin[cut].astype(np.int32)), pa.array(size[cut].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(found)])]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "begin", "size", "units"])


def similarities(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Jaccard similarity of each pair of aligned windows: without repeated units by the starts between which a common unit
    is in both windows, else by counts that move along with the windows."""
    if np.array_equal(a, b):
        return np.ones(len(a) - size + 1)
    order, other = np.sort(a), np.sort(b)
    if not (order[1:] == order[:-1]).any() and not (other[1:] == other[:-1]).any():
        _, at, place = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        first, last = np.maximum(np.maximum(at, place) - size + 1, 0), np.minimum(np.minimum(at, place), len(a) - size)
        met = first <= last
        turn = np.bincount(first[met], minlength=len(a) - size + 2) - np.bincount(last[met] + 1, minlength=len(a) - size + 2)
        common = np.cumsum(turn)[:-1]
        return common / (2 * size - common)
    left, right = a.tolist(), b.tolist()
    counts: dict[int, list[int]] = {}
    both = either = 0
    out = np.empty(len(left) - size + 1)
    for i in range(len(left)):
        for side, values in enumerate((left, right)):
            own = counts.setdefault(values[i], [0, 0])
            own[side] += 1
            if own[side] == 1:
                either, both = (either, both + 1) if own[1 - side] else (either + 1, both)
            if i >= size:
                gone = counts[values[i - size]]
                gone[side] -= 1
                if not gone[side]:
                    either, both = (either, both - 1) if gone[1 - side] else (either - 1, both)
        if i >= size - 1:
            out[i - size + 1] = both / either
    return out


def best_window(a: np.ndarray, b: np.ndarray, size: int, least: float) -> tuple[int, float]:
    """Offset and Jaccard similarity of the likest pair of aligned windows."""
    found = similarities(a, b, size)
    return int(np.argmax(found)), float(found.max())


def _open(base: np.ndarray, lo: np.ndarray, hi: np.ndarray, total: int) -> np.ndarray:
    """How many of the intervals hold each slot."""
    return np.cumsum(np.bincount(base + lo, minlength=total) - np.bincount(base + hi + 1, minlength=total))


def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, least: float) -> tuple[np.ndarray, ...]:
    """Of pairs of stretches with n units each, laid end to end: the runs of neighbouring starts whose windows are alike, as
    pair, first start, number of starts and least similarity. See ``similarities``, which takes one pair."""
    n = np.asarray(n, np.int64)
    begin, slots = np.cumsum(n) - n, n - size + 2  # a slot for each start, and one that ends the pair
    base = np.cumsum(slots) - slots
    row, place = np.repeat(np.arange(len(n)), n), _places(n)
    same = np.bincount(row[a != b], minlength=len(n)) == 0
    open_ = np.flatnonzero(~same[row])
    bits, total = int(n.max(initial=1)).bit_length(), int(slots.sum())
    sides, sums = [], []
    for x in (a, b):
        packed = np.sort((row[open_].astype(np.uint64) << np.uint64(32) | x[open_]) << np.uint64(bits) | place[open_].astype(np.uint64))
        unit, at = packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        of = (unit >> np.uint64(32)).astype(np.int64)
        # the starts whose windows hold a unit at this place, and not before it
        before = np.where(np.concatenate([[False], unit[1:] == unit[:-1]])[: len(unit)], np.concatenate([[0], at[:-1] + 1])[: len(unit)], 0)
        lo, hi = np.maximum(before, at - size + 1), np.minimum(at, n[of] - size)
        sides.append((unit[lo <= hi], lo[lo <= hi], hi[lo <= hi]))
        sums.append(_open(base[of[lo <= hi]], lo[lo <= hi], hi[lo <= hi], total))
    (left, lo, hi), (right, low, high) = sides
    first, upto = np.searchsorted(left, right), np.searchsorted(left, right, side="right")
    of = (right >> np.uint64(32)).astype(np.int64)
    # texts of a few units that repeat all the time are taken one by one
    many = np.bincount(of, weights=upto - first, minlength=len(n)) > 64 * n
    times = np.where(many[of], 0, upto - first)
    index = np.repeat(first, times) + _places(times)
    lo, hi, of = np.maximum(lo[index], np.repeat(low, times)), np.minimum(hi[index], np.repeat(high, times)), np.repeat(of, times)
    common = _open(base[of[lo <= hi]], lo[lo <= hi], hi[lo <= hi], total)
    slot = np.repeat(np.arange(len(n)), slots)
    out = common / np.maximum(sums[0] + sums[1] - common, 1)
    out[same[slot]] = 1.0
    for k in np.flatnonzero(many):
        out[base[k] : base[k] + n[k] - size + 1] = similarities(a[begin[k] : begin[k] + n[k]], b[begin[k] : begin[k] + n[k]], size)
    good = out >= least
    good[base + slots - 1] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[False], good]).astype(np.int8)))
    if not len(edges):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
    start, end = edges[::2], edges[1::2]
    return slot[start], start - base[slot[start]], end - start, np.minimum.reduceat(out, edges)[::2]


def _held(values: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of stretches with n units each, laid end to end: stretch and value (as one number, rising), and the starts from and up to which
    a window holds the unit at this place, and not before it; and the different units of each window, in n + 1 slots a stretch."""
    bits = int(n.max(initial=1)).bit_length()
    packed = np.sort((np.repeat(np.arange(len(n)), n).astype(np.uint64) << np.uint64(32) | values) << np.uint64(bits) | _places(n).astype(np.uint64))
    unit, at = packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    of = (unit >> np.uint64(32)).astype(np.int64)
    before = np.where(_changes([unit]), 0, np.concatenate([[0], at[:-1] + 1])[: len(at)])
    lo, hi = np.maximum(before, at - size + 1), np.minimum(at, n[of] - size)
    unit, of, lo, hi = (x[lo <= hi] for x in (unit, of, lo, hi))
    return unit, of, lo, hi, _open((np.cumsum(n + 1) - n - 1)[of], lo, hi, int((n + 1).sum()))


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, size: int, least: float) -> np.ndarray:
    """The pairs of stretches with n and m units (``size`` at least), laid end to end, of which each has a window with enough units in common
    with the whole of the other: only these can have windows that are alike."""
    sides = [_held(a, n, size), _held(b, m, size)]
    good = np.ones(len(n), bool)
    for (unit, of, lo, hi, kinds), other, k in ((sides[0], sides[1], n), (sides[1], sides[0], m)):
        base = np.cumsum(k + 1) - k - 1
        at = np.minimum(np.searchsorted(other[0], unit), max(0, len(other[0]) - 1))
        also = other[0][at] == unit if len(other[0]) else np.zeros(len(unit), bool)
        common = _open(base[of[also]], lo[also], hi[also], len(kinds))
        # the other window has at least the common units
        met = common >= least * kinds
        met[_places(k + 1) > np.repeat(k - size, k + 1)] = False
        good &= np.add.reduceat(met, base) > 0
    return np.flatnonzero(good)


def likest(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, size: int, least: float) -> tuple[np.ndarray, ...]:
    """Of pairs of stretches as in ``possible``: pair, and the starts in both of its likest windows, on any diagonal, if they are alike."""
    sides = [_held(a, n, size), _held(b, m, size)]
    out = []
    for part in np.split(np.arange(len(n)), range(64, len(n), 64)):
        if not len(part):
            continue
        number = np.full(len(n), -1)
        number[part] = np.arange(len(part))
        (left, of, lo, hi, _), (right, with_, low, high, _) = ([x[number[s[1]] >= 0] for x in s[:4]] + [s[4]] for s in sides)
        wide, high_ = int((n[part] - size).max()) + 2, int((m[part] - size).max()) + 2
        first, upto = np.searchsorted(left, right), np.searchsorted(left, right, side="right")
        one, two = np.repeat(first, upto - first) + _places(upto - first), np.repeat(np.arange(len(right)), upto - first)
        turn = np.zeros(len(part) * wide * high_, np.int64)
        for row, sign in ((lo[one], 1), (hi[one] + 1, -1)):
            for column, other in ((low[two], 1), (high[two] + 1, -1)):
                turn += sign * other * np.bincount((number[of[one]] * wide + row) * high_ + column, minlength=len(turn))
        common = turn.reshape(len(part), wide, high_).cumsum(1).cumsum(2)
        kinds = []
        for side, k, w in ((sides[0], n, wide), (sides[1], m, high_)):
            at = (np.cumsum(k + 1) - k - 1)[part][:, None] + np.minimum(np.arange(w), (k[part] - size + 1)[:, None])
            kinds.append(np.where(np.arange(w) <= (k[part] - size)[:, None], side[4][at], 1 << 20))
        either = np.maximum(kinds[0][:, :, None] + kinds[1][:, None, :] - common, 1)
        found = (common / either).reshape(len(part), -1)
        at = found.argmax(axis=1)
        met = found[np.arange(len(part)), at] >= least
        out.append((part[met], at[met] // high_, at[met] % high_))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


FOUND = "doc_id long, start_word int, other_id long, other_start int, starts int, similarity double"
FOUND_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
FOUND_NAMES = ["doc_id", "start_word", "other_id", "other_start", "starts", "similarity"]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit values of a binary column, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    return data.view(np.uint32) if data.ctypes.data % 4 == 0 else data.copy().view(np.uint32), np.diff(offsets) // 4


def _verified(size: int, least: float):
    """Runs of neighbouring starts whose windows are alike: first start in both texts, number of starts, least similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PAIRS) for whole in batches for at in range(0, whole.num_rows, PAIRS)):
            doc, begin, other, start = (np.asarray(batch.column(i)) for i in range(4))
            (a, n), (b, _) = _flat(batch.column(4)), _flat(batch.column(5))
            pair, at, starts, similarity = alike(a, b, n, size, least)
            cols = (doc[pair], begin[pair] + at, other[pair], start[pair] + at, starts, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, FOUND_TYPES, strict=True)], FOUND_NAMES)

    return run


def _whole(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Sorted rows, dealt anew so that no group (equal values in the first columns) is cut. What is held is a batch and a group."""
    held: list[pa.RecordBatch] = []
    last: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(by)]
        new = _changes(keys)
        new[0] = bool(held) and last != [k[0] for k in keys]
        last = [k[-1] for k in keys]
        if new.any():
            cut = int(np.flatnonzero(new)[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows begin a group."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _tried(size: int, enough: int):
    """WINDOWS (the hit apart, as other and other_at) in the order of their groups -> (doc, other, shift, starts = lo, then hi - lo and weight in 16 and 8 bits): what each
    window is linked with, the greater document first. A group may go on in the next batch: the windows of it that later ones
    can meet (its first, the last of the document before, the farthest reaching, the last) are put before that batch."""
    bits, mask = _bits(size), (1 << _bits(size)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(kept[0])
            key, doc, at = (np.concatenate([k, np.asarray(batch.column(i))]) for i, k in enumerate(kept))
            row, cell = np.arange(len(key)), key & 7 == CELL
            new = _changes([key])
            first = np.maximum.accumulate(np.where(new, row, 0))
            turn = np.concatenate([[False], doc[1:] != doc[:-1]]) & ~new
            before = np.maximum.accumulate(np.where(turn, row - 1, -1))
            # of the cells that begin before: the one that reaches farthest, of the smallest document; a later group ranks higher
            far = row.copy()
            several = np.flatnonzero(cell & ~(new & np.append(new[1:], True)))
            order = np.lexsort((at[several], ~doc[several], -(at[several] >> bits & mask), first[several]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            far[several] = several[order[np.maximum.accumulate(rank)]]
            kept = [c[np.unique([far[-1], row[-1]] if cell[-1] else [first[-1], max(first[-1], before[-1]), row[-1]])] for c in (key, doc, at)]
            # a window is tried once with each (doc, at)
            one = np.where(cell, np.concatenate([[0], far[:-1]]), first)
            two = np.where(cell, one, np.maximum(before, first))
            hit = n + np.flatnonzero(np.asarray(batch.column(3).is_valid()))
            to, to_at = (np.asarray(batch.column(i).fill_null(0))[hit - n] for i in (3, 4))
            fresh = new[hit] | np.all([(doc[o[hit]] != to) | (at[o[hit]] != to_at) for o in (one, two)], axis=0)
            ones = np.flatnonzero(~new)
            twos = np.flatnonzero(~new & ((doc[one] != doc[two]) | (at[one] != at[two])))
            own = np.concatenate([ones, twos, hit[fresh]])
            other, other_at = (np.concatenate([c[one[ones]], c[two[twos]], t[fresh]]) for c, t in ((doc, to), (at, to_at)))
            least, most = np.maximum(at[own] >> bits & mask, other_at >> bits & mask), np.minimum(at[own] & mask, other_at & mask)
            good = (own >= n) & (doc[own] != other) & (least <= most)
            own, other, other_at, least, most = (x[good] for x in (own, other, other_at, least, most))
            turned, shift = doc[own] < other, (at[own] >> 2 * bits) - (other_at >> 2 * bits)
            c = np.where(turned, other_at, at[own]) >> 2 * bits
            starts = (c - most << 24) + (most - least << 8) + np.where(cell[own], enough, 1)
            cols = (np.maximum(doc[own], other), np.minimum(doc[own], other), np.where(turned, -shift, shift).astype(np.int32), starts)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["doc", "other", "shift", "starts"])

    return run


def _met(size: int, enough: int, frequent: Frequent):
    """``_tried`` for WINDOWS as they come."""
    top = _top(_bits(size))

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, at = batch.columns
            at = np.asarray(at)
            hit = (at >> top) - 1
            other = frequent.hits[hit] if len(frequent.hits) else np.zeros((len(hit), 2), np.int64)
            yield pa.RecordBatch.from_arrays([key, doc, pa.array(at & (1 << top) - 1), *(pa.array(other[:, i], mask=hit < 0) for i in (0, 1))], ["key", "doc", "at", "other", "other_at"])

    return lambda batches: _tried(size, enough)(apart(batches))


def _agreeing(size: int, enough: int):
    """(doc, other, shift, starts) in the order of the first three, of which a batch has all rows or none -> the stretches of windows on which
    enough functions agree, as long as they reach, in slices of at most SLICE windows.

    The intervals of one function do not overlap, so the sum of open weights is the number of functions; the cells, in
    which all agree, weigh enough by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            doc, other, shift, starts = (np.asarray(c) for c in rows.columns)
            new = _changes([doc, other, shift])
            lo, weight = starts >> 24, starts & 255
            hi = lo + (starts >> 8 & 65535)
            group = np.cumsum(new) - 1
            at = np.concatenate([lo, hi + 1])
            of = np.concatenate([group, group])
            turn = np.concatenate([weight, -weight])
            order = np.lexsort((at, of))
            at, of, open_ = at[order], of[order], np.cumsum(turn[order])
            # between two events of a group: a stretch of starts with the same functions
            live = np.flatnonzero((of[1:] == of[:-1]) & (at[1:] > at[:-1]) & (open_[:-1] >= enough))
            begin, end, of = at[live], at[live + 1], of[live]
            alone = np.ones(len(live) + 1, bool)
            alone[1:-1] = (of[1:] != of[:-1]) | (begin[1:] != end[:-1])
            begin, end, of = begin[alone[:-1]], end[alone[1:]], of[alone[:-1]]
            slices = -(-(end - begin) // SLICE)
            own, at = np.flatnonzero(new)[np.repeat(of, slices)], np.repeat(begin, slices) + SLICE * _places(slices)
            width = np.minimum(SLICE, np.repeat(end, slices) - at)
            cols = (doc[own], at.astype(np.int32), other[own], (at - shift[own]).astype(np.int32), (width - 1 + size).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc", "begin", "other", "start", "size"])

    return run


def spans(good: DataFrame, passage: int) -> DataFrame:
    """Runs of starts that touch on a diagonal become one row, with all its words."""
    good = good.withColumn("shift", F.col("start_word") - F.col("other_start")).withColumn("end", F.col("start_word") + F.col("starts"))
    line = Window.partitionBy("doc_id", "other_id", "shift").orderBy("start_word", "end")
    upto = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    good = good.withColumn("new", F.coalesce(F.col("start_word") > upto, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    good = good.groupBy("doc_id", "other_id", "shift", "span").agg(F.min("start_word").alias("start_word"), F.max("end").alias("end"), F.min("similarity").alias("similarity"))
    return good.select("doc_id", "start_word", "other_id", (F.col("start_word") - F.col("shift")).alias("other_start"), (F.col("end") - F.col("start_word") + F.lit(passage - 1)).cast("int").alias("n_words"), "similarity")


def _at(size: int) -> tuple[Callable[[str], Column], ...]:
    """The parts of ``at``: place, least, most."""
    bits, mask = _bits(size), F.lit((1 << _bits(size)) - 1)
    return (lambda at: F.shiftright(at, 2 * bits).cast("int"), lambda at: F.shiftright(at, bits).bitwiseAND(mask).cast("int"), lambda at: F.col(at).bitwiseAND(mask).cast("int"))


def _frequent(rows: DataFrame, size: int, functions: int) -> Frequent:
    """The at most MOST frequent keys in one part of the documents, with at most ``size`` hits for each."""
    part = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    part = materialized(part.mapInArrow(_windows(size, functions, Frequent([], size)), WINDOWS), "part")
    most = min(MOST, (1 << max(0, 62 - _top(_bits(size)))) // size)  # their hits have numbers in ``at``
    keys = part.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(most).select("key")
    cell = F.col("key").bitwiseAND(F.lit(7)) == CELL
    _, least, most = _at(size)
    before = F.explode(F.when(cell, F.sequence(least("at"), most("at"))).otherwise(F.array(F.lit(0))))
    hits = part.join(F.broadcast(keys), "key").select("key", before.alias("before"), "doc", "at").groupBy("key", "before").agg(F.min(F.struct("doc", "at")).alias("hit"))
    return Frequent([tuple(r) for r in hits.select("key", "before", "hit.doc", "hit.at").collect()], size, part.count())


def _number(*columns: np.ndarray) -> np.ndarray:
    """A hash of the columns of numbers."""
    out = np.uint64(0)
    for c in columns:
        out = mix64((out ^ c.astype(np.int64).view(np.uint64)) * _BASE)
    return out >> np.uint64(16)


def _key_number(key: np.ndarray, *_: np.ndarray) -> np.ndarray:
    return _number(key)


def _pair_number(doc: np.ndarray, other: np.ndarray, shift: np.ndarray, _: np.ndarray) -> np.ndarray:
    return _number(doc, other, shift)


def _by_pair(doc: np.ndarray, other: np.ndarray, shift: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((shift, other, doc))
    return [c[order] for c in (doc, other, shift, starts)]


def _alone(key: np.ndarray) -> np.ndarray:
    """Where sorted keys stand once."""
    new = _changes([key])
    return new & np.append(new[1:], True)


def _by_group(size: int):
    """Windows in the order of their groups: cells stand by their first start, intervals of one function by their document. Windows
    that meet no other one and have no hit are left out."""
    mask, top = (1 << _bits(size)) - 1, _top(_bits(size))

    def arranged(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(key)
        order = order[~_alone(key[order]) | (at[order] >> top > 0)]
        key, doc, at = key[order], doc[order], at[order]
        order = np.lexsort((at, doc, np.where(key & 7 == CELL, -(at & mask), doc), key))
        return [key[order], doc[order], at[order]]

    return arranged


def links(rows: DataFrame, size: int, functions: int, enough: int, frequent: Frequent | None = None) -> DataFrame:
    """(doc, begin, other, start, size): all stretches to verify, in slices."""
    frequent = frequent or _frequent(rows, size, functions)
    buckets = buckets_for(SAMPLE * frequent.seen)
    windows = rows.mapInArrow(packed(_windows(size, functions, frequent), _key_number, buckets), schema(3))
    met = unpacked(["key", "doc", "at"], [np.int64] * 3, _by_group(size), _met(size, enough, frequent))
    met = windows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(packed(met, _pair_number, buckets), schema(4))
    agreeing = unpacked(["doc", "other", "shift", "starts"], [np.int64, np.int64, np.int32, np.int64], _by_pair, _agreeing(size, enough))
    return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(agreeing, "doc long, begin int, other long, start int, size int")


def _texts_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (doc, text) with what is asked of them (doc once). Most texts of which nothing is asked are left out before the shuffle."""
    close = maybe_asked(rows, F.xxhash64("doc"), asked.select(F.xxhash64("doc")))
    return close.select("doc", "text").join(asked.withColumnRenamed("doc", "_doc").hint("shuffle_merge"), F.col("doc") == F.col("_doc")).drop("_doc")


def shared_run(size: int, least: float, words: int = WORDS) -> int:
    """Units of the longest equal run that two windows of this similarity share at least."""
    missing = int(size * (1 - least) / (1 + least))
    return (size - missing) // (missing // (words - 1) + 1)


def grams(values: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stretches of n units of texts laid end to end, and how many each text has."""
    sums = _sums(mix64(values) * _powers(_BASE, len(values)))
    own = np.maximum(sizes - n + 1, 0)
    first = np.repeat(np.cumsum(sizes) - sizes, own) + _places(own)
    return mix64((sums[first + n] - sums[first]) * _powers(_INVERSE, len(values))[first]), own


def _seeds(run_units: int, gram: int, hot: np.ndarray):
    """(doc, text) -> (key, doc, at): the grams that stand for the runs of a text, as in ``_windows``; the place of a hot key in ``hot``,
    from 1 on, is the number above, and the row's own key is no one else's."""
    reach = run_units - gram + 1
    bits = _bits(reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for part in _chunks(texts):
                values, sizes = units(texts[part])
                if len(values) < run_units:
                    continue
                text, key, c, least, most = compact_windows(*grams(values, sizes, gram), reach, 0)
                doc, at = ids[part][text], c << 2 * bits | least << bits | most
                if len(hot):
                    number = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    met = hot[number] == key
                    key = np.where(met, _part_of(key, mix64(doc.astype(np.int64).view(np.uint64)) + at.view(np.uint64)), key)
                    at = np.where(met, number + 1, 0) << _top(bits) | at
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(at)], ["key", "doc", "at"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc, at, hot) in the order of key -> (key, doc, at): rows with a hot key, or whose key is found in several documents.
    The rows of the last key of a batch wait for a second document; once it is met, two of them stand before the next batch."""

    def rows(cols: list[np.ndarray], chosen: np.ndarray) -> pa.RecordBatch:
        key, doc, at, hot, known = (c[chosen] for c in cols)
        return pa.RecordBatch.from_arrays([pa.array(np.where(known, hot, key)), pa.array(doc), pa.array(at)], ["key", "doc", "at"])

    kept, stand = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool)], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        hot = batch.column(3)
        own = [*(np.asarray(batch.column(i)) for i in range(3)), np.asarray(hot.fill_null(0)), np.asarray(hot.is_valid())]
        cols = [np.concatenate(c) for c in zip(kept, own, strict=True)]
        new = _changes(cols[:1])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        others = np.flatnonzero(cols[1] != cols[1][first[group]])
        several = np.zeros(len(first), bool)
        several[group[others]] = True
        good = several[group] | cols[4]
        good[:stand] = False
        if several[-1]:
            kept, stand = [c[[first[-1], others[-1]]] for c in cols], 2
        else:
            good[first[-1]:] = False
            kept, stand = [c[first[-1]:] for c in cols], 0
        yield rows(cols, good)
    if not stand:
        yield rows(kept, kept[4])


def _by_key(bits: int):
    """Seeds in the order of their keys; those that meet no other one and have no hot key are left out."""

    def arranged(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(key)
        order = order[~_alone(key[order]) | (at[order] >> _top(bits) > 0)]
        return [c[order] for c in (key, doc, at)]

    return arranged


def _several(bits: int, hot: np.ndarray):
    """``_shared`` for rows as they come from ``_seeds``."""
    top = _top(bits)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, at = batch.columns
            at = np.asarray(at)
            number = (at >> top) - 1
            keys = hot[number] if len(hot) else np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([key, doc, pa.array(at & (1 << top) - 1), pa.array(keys, mask=number < 0)], ["key", "doc", "at", "hot"])

    return lambda batches: _shared(apart(batches))


def _around(size: int, run_units: int, first: int, gram: int):
    """(doc, class, text, ats of open seeds, (run, at) of agreeing windows) -> (run, class, doc, place, before, units): the second grams of
    the open runs, with the units of all windows that hold one, and the agreeing windows."""
    reach, own = run_units - gram + 1, run_units - first + 1
    bits, mask = _bits(own), (1 << _bits(own)) - 1
    place_of, wide = 2 * _bits(size), (1 << _bits(size)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, texts, asked, told = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), batch.column(4)
            for part in _chunks(texts):
                values, sizes = units(texts[part])
                begins, slots = np.cumsum(sizes) - sizes, sizes + 2
                base = np.cumsum(slots) - slots
                lists = asked.slice(part.start, part.stop - part.start)
                at, of = np.asarray(lists.flatten(), np.int64), np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                # open starts before each start; another text of this id may be shorter
                turn = np.bincount(base[of] + np.minimum((at >> 2 * bits) - (at & mask), sizes[of]), minlength=slots.sum())
                turn -= np.bincount(base[of] + np.minimum((at >> 2 * bits) - (at >> bits & mask) + 1, sizes[of] + 1), minlength=slots.sum())
                upto = np.concatenate([[0], np.cumsum(np.cumsum(turn) > 0)])
                key, n = grams(values, sizes, gram)
                text, _, place, least, most = compact_windows(key, n, reach, 0)
                met = upto[base[text] + place - least + 1] > upto[base[text] + place - most]
                text, place = text[met], place[met]
                key = key[(np.cumsum(n) - n)[text] + place].view(np.int64)
                begin, end = np.maximum(place + gram - size, 0), np.minimum(place + size, sizes[text])
                lists = told.slice(part.start, part.stop - part.start)
                runs, at = (np.asarray(c, np.int64) for c in lists.flatten().flatten())
                of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
                from_, upto = (at >> place_of) - (at & wide), (at >> place_of) - (at >> place_of // 2 & wide) + size
                held = upto <= sizes[of]
                text, place, key, begin, end = (np.concatenate([c, o[held]]) for c, o in ((text, of), (place, at >> place_of), (key, runs), (begin, from_), (end, upto)))
                held, short = end - begin, values.astype(np.uint32)
                for cut in np.split(np.arange(len(text)), range(CHUNK // size, len(text), CHUNK // size)):
                    ends = np.concatenate([[0], np.cumsum(4 * held[cut])]).astype(np.int32)
                    found = short[np.repeat((begins[text] + begin)[cut], held[cut]) + _places(held[cut])]
                    cols = [pa.array(key[cut]), pa.array(classes[part][text[cut]]), pa.array(ids[part][text[cut]]), pa.array(place[cut].astype(np.int32)), pa.array((place - begin)[cut].astype(np.int32)),
                            pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(found)])]
                    yield pa.RecordBatch.from_arrays(cols, ["run", "class", "doc", "place", "before", "units"])

    return run


def _intervals(size: int, functions: int):
    """(doc, class, text) -> (key, doc, class, at): the compact windows, as in ``_windows``."""
    bits = _bits(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            for part in _chunks(texts):
                values, sizes = units(texts[part])
                if len(values) < size:
                    continue
                for function in range(functions):
                    text, key, c, least, most = compact_windows(values, sizes, size, function)
                    cols = (key, ids[part][text], classes[part][text], c << 2 * bits | least << bits | most)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "doc", "class", "at"])

    return run


def _of_classes(size: int):
    """(key, doc, class, at) -> the rows whose key is found in several classes; a bit above ``at`` is set if these are more than CLASSES."""
    top = _top(_bits(size))

    def arranged(key: np.ndarray, doc: np.ndarray, class_: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(key)
        order = order[~_alone(key[order])]
        key, class_ = key[order], class_[order]
        inner = np.lexsort((class_, key))
        order, key, class_ = order[inner], key[inner], class_[inner]
        new = _changes([key])
        group = np.cumsum(new) - 1
        classes = np.bincount(group, weights=_changes([key, class_])) if len(key) else np.zeros(0)
        several = np.flatnonzero(classes[group] > 1)
        often = (classes[group[several]] > CLASSES).astype(np.int64)
        order = order[several]
        return [key[several], doc[order], class_[several], at[order] | often << top]

    return arranged


def _agreements(size: int):
    """(key, doc, class, at), of which a batch has all rows of a document or none -> (run, doc, class, at): for every two functions, the windows
    on which a pair of their smallest units stands: its key, and the windows by the place of the first. Not both units are in more than
    CLASSES classes."""
    bits, mask = _bits(size), (1 << _bits(size)) - 1
    top = _top(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, class_, at = (np.asarray(c) for c in batch.columns)
            often, at = at >> top > 0, at & (1 << top) - 1
            c = at >> 2 * bits
            lo, hi = c - (at & mask), c - (at >> bits & mask)
            code = (np.unique(doc, return_inverse=True)[1] << POSITION + 2) + lo + size
            order = np.argsort(code)
            key, doc, class_, c, lo, hi, code, often = (x[order] for x in (key, doc, class_, c, lo, hi, code, often))
            sides = [np.flatnonzero(key & 7 == f) for f in range(CELL)]
            for f, left in enumerate(sides):
                for right in sides[f + 1 :]:
                    # an interval has at most ``size`` starts
                    low, high = np.searchsorted(code[right], code[left] - size), np.searchsorted(code[right], code[left] + (hi - lo)[left], side="right")
                    one = np.repeat(left, high - low)
                    two = right[np.repeat(low, high - low) + _places(high - low)]
                    met = (hi[two] >= lo[one]) & (doc[one] == doc[two]) & ~(often[one] & often[two])
                    one, two = one[met], two[met]
                    least, most = c[one] - np.minimum(hi[one], hi[two]), c[one] - np.maximum(lo[one], lo[two])
                    cols = (_number(key[one], key[two]).view(np.int64), doc[one], class_[one], c[one] << 2 * bits | least << bits | most)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["run", "doc", "class", "at"])

    return run


def agreeing(rows: DataFrame, root: DataFrame, size: int, functions: int, buckets: int) -> DataFrame:
    """(run, doc, class, at): where two functions have smallest units that windows of several classes have. Two windows on which enough
    functions (two at least) agree share such a run, wherever their places are, as all pairs of functions are looked at."""
    names, four = ["key", "doc", "class", "at"], [np.int64] * 4

    def dealt(rows: DataFrame, made, number) -> DataFrame:
        return rows.mapInArrow(packed(made, number, buckets), schema(4)).repartition("bucket").sortWithinPartitions("bucket")

    known = rows.join(root.withColumnRenamed("doc", "_doc").hint("shuffle_merge"), F.col("doc") == F.col("_doc"), "left").select("doc", F.coalesce("root", "doc").alias("class"), "text")
    found = dealt(known, _intervals(size, functions), _key_number)
    found = dealt(found, unpacked(names, four, _of_classes(size), lambda batches: batches), lambda _, doc, *__: _number(doc))
    found = dealt(found, unpacked(names, four, lambda *c: list(c), _agreements(size)), _key_number)
    met = found.mapInArrow(unpacked(names, four, _of_classes(size), lambda batches: batches), "run long, doc long, class long, at long")
    return met.withColumn("at", F.col("at").bitwiseAND(F.lit((1 << _top(_bits(size))) - 1)))


def _kinds(values: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches with n units each, laid end to end: stretch and value of each of its different units, and the smallest number
    of different units in a window of each stretch (in all, if there is none)."""
    bits = int(n.max(initial=1)).bit_length()
    row, place = np.repeat(np.arange(len(n)), n), _places(n)
    packed = np.sort((row.astype(np.uint64) << np.uint64(32) | values) << np.uint64(bits) | place.astype(np.uint64))
    unit, at = packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    new, of = _changes([unit]), (unit >> np.uint64(32)).astype(np.int64)
    # a unit counts in the starts after its last place before
    before = np.where(new, 0, np.concatenate([[0], at[:-1] + 1])[: len(at)])
    most = np.maximum(n - size, 0)
    lo, hi = np.maximum(before, at - size + 1), np.minimum(at, most[of])
    lo = np.where((n[of] < size), before, lo)
    held, slots = lo <= hi, most + 2
    base = np.cumsum(slots) - slots
    different = _open(base[of[held]], lo[held], hi[held], int(slots.sum()))
    different[base + slots - 1] = size
    return of[new], (unit[new] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.minimum.reduceat(different, base) if len(n) else n


def _compared(size: int, least: float):
    """The places of blocks, or of two blocks each (half 0 and 1), in the order of (run, i, j): all pairs from different classes, verified.
    Pairs whose units cannot have enough in common are left out first: the product of their counters is at least the number
    of common units, and is that number where a block has no more shared units than counters; units of one place alone have
    none. Small blocks share a call, and pairs are verified when enough are found."""
    share = least / (1 + least)

    def counters(values: np.ndarray, n: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place and counter of each different unit that several places of a block have, counters of each block, and ``fewest``."""
        of, unit, fewest = _kinds(values, n, size)
        unit |= block[of] << 32
        order = np.argsort(unit)
        new = _changes([unit[order]])
        first = np.flatnonzero(new)
        several = np.diff(first, append=len(unit)) > 1
        units_of = np.bincount(unit[order[first[several]]] >> 32, minlength=block[-1] + 1)
        number = np.empty(len(unit), np.int64)
        number[order] = np.where(several, np.cumsum(several) - 1, -1)[np.cumsum(new) - 1]
        shared = number >= 0
        of, number = of[shared], number[shared]
        return of, (number - (np.cumsum(units_of) - units_of)[block[of]]) % COUNTERS, np.clip(units_of, 1, COUNTERS), fewest

    def near(rows: slice, counts: np.ndarray, fewest: np.ndarray, class_: np.ndarray, half: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        one, two = (np.arange(len(counts)),) * 2 if alone else (np.flatnonzero(half[rows] == 0), np.flatnonzero(half[rows] == 1))
        fewest, class_ = fewest[rows], class_[rows]
        product = counts @ counts.T if alone else counts[one] @ counts[two].T
        met = product >= (fewest[one][:, None] + fewest[two]) * share - 1e-3
        met &= class_[one][:, None] != class_[two]
        i, j = np.nonzero(np.triu(met) if alone else met)
        return one[i] + rows.start, two[j] + rows.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, 3):
            class_, doc, place, before, half, alone = (np.asarray(table[c]) for c in ("class", "doc", "place", "before", "half", "alone"))
            values, n = _flat(table["units"].chunk(0))
            n, before = n.astype(np.int64), before.astype(np.int64)
            begin = np.cumsum(n) - n
            new = _changes([np.asarray(table[c]) for c in ("run", "i", "j")])
            edges = np.append(np.flatnonzero(new), len(n))
            of, slot, width, fewest = counters(values, n, np.cumsum(new) - 1)
            upto = np.searchsorted(of, np.arange(len(n) + 1))

            def verified(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                # the greater document comes first; of equal ones, the place that stands first
                i, j = np.where(doc[i] > doc[j], i, j), np.where(doc[i] > doc[j], j, i)
                aligned = np.zeros(len(i), bool)

                def along(k: np.ndarray, shift: np.ndarray) -> Iterator[pa.RecordBatch]:
                    """The pairs k, with the second place moved by a shift against the first one."""
                    one, two = i[k], j[k]
                    back, on = np.minimum(before[one], before[two] + shift), np.minimum(n[one] - before[one], n[two] - before[two] - shift)
                    wide = np.flatnonzero(back + on >= size)
                    for part in np.split(wide, range(PAIRS, len(wide), PAIRS)):
                        if len(part):
                            wides = back[part] + on[part]
                            firsts = (begin[one[part]] + before[one[part]] - back[part], begin[two[part]] + before[two[part]] + shift[part] - back[part])
                            both = (values[np.repeat(at, wides) + _places(wides)] for at in firsts)
                            pair, at, starts, similarity = alike(*both, wides, size, least)
                            pair = part[pair]
                            aligned[k[pair]] = True
                            cols = (doc[one[pair]], place[one[pair]] - back[pair] + at, doc[two[pair]], place[two[pair]] + shift[pair] - back[pair] + at, starts, similarity)
                            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, FOUND_TYPES, strict=True)], FOUND_NAMES)

                def sides(k: np.ndarray) -> Iterator[np.ndarray]:
                    return (values[np.repeat(begin[x[k]], n[x[k]]) + _places(n[x[k]])] for x in (i, j))

                wide = np.flatnonzero((n[i] >= size) & (n[j] >= size))
                for k in np.split(wide, range(PAIRS, len(wide), PAIRS)):
                    if not len(k):
                        continue
                    k = k[possible(*sides(k), n[i[k]], n[j[k]], size, least)]
                    yield from along(k, np.zeros(len(k), np.int64))
                    # pairs that are not alike there may be so on another diagonal
                    k = k[~aligned[k]]
                    if len(k):
                        p, x, y = likest(*sides(k), n[i[k]], n[j[k]], size, least)
                        p = k[p]
                        yield from along(p, (y - before[j[p]]) - (x - before[i[p]]))

            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b, wide in zip(edges.tolist(), edges[1:].tolist(), width.tolist()):
                held = slice(upto[a], upto[b])
                counts = np.bincount((of[held] - a) * wide + slot[held], minlength=(b - a) * wide).reshape(-1, wide)
                found.append(near(slice(a, b), counts.astype(np.float32), fewest, class_, half, alone[a]))
                if sum(len(i) for i, _ in found[-64:]) >= PAIRS or b == len(n):
                    yield from verified(*(np.concatenate(k) for k in zip(*found)))
                    found = []

    return run


def rest(rows: DataFrame, good: DataFrame, size: int, least: float, functions: int, buckets: int) -> DataFrame:
    """Verified windows (as FOUND) between documents that the spans in ``good`` leave in different classes."""
    run_units = shared_run(size, least)
    first, second = (min(g, run_units) for g in GRAMS)
    bits = _bits(run_units - first + 1)
    most = min(MOST, 1 << max(0, 62 - _top(bits)))
    part = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).mapInArrow(_seeds(run_units, first, np.zeros(0, np.int64)), WINDOWS)
    part = materialized(part, "part")
    often = part.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(most)
    hot = np.array(sorted(r[0] for r in often.select("key").collect()), np.int64)
    seeds = rows.mapInArrow(packed(_seeds(run_units, first, hot), _key_number, buckets_for(SAMPLE * part.count())), schema(3))
    shared = unpacked(["key", "doc", "at"], [np.int64] * 3, _by_key(bits), _several(bits, hot))
    shared = seeds.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, WINDOWS)
    root = components(good.select(F.col("doc_id").alias("u"), F.col("other_id").alias("v"))).withColumnRenamed("node", "doc")
    shared = materialized(shared.join(root, "doc", "left").select("key", "doc", "at", F.coalesce("root", "doc").alias("class")), "shared")
    runs = agreeing(rows, root, size, functions, buckets).select("doc", "class", F.lit(None).cast("long").alias("at"), F.struct("run", F.col("at").alias("windows")).alias("run"))
    asked = _mixed(shared, "key").select("doc", "class", "at", F.lit(None).cast("struct<run: long, windows: long>").alias("run")).unionByName(runs)
    asked = materialized(asked.groupBy("doc", "class").agg(F.collect_set("at").alias("ats"), F.collect_set("run").alias("runs")), "open")
    around = _texts_of(rows, asked).select("doc", "class", "text", "ats", "runs").mapInArrow(_around(size, run_units, first, second), "run long, class long, doc long, place int, before int, units binary")
    around = materialized(around, "around")
    # equal units around are one place of a class
    places = _mixed(around, "run").groupBy("run", "class", "before", "units").agg(F.min(F.struct("doc", "place")).alias("m")).select("run", "class", "before", "units", "m.doc", "m.place")
    places = materialized(places, "places")
    # a class with many places has blocks of its own, which do not meet each other
    sizes = places.groupBy("run", "class").agg(F.count("*").alias("n")).withColumn("large", F.col("n") >= BLOCK // 2).withColumn("of", F.when(F.col("large"), F.col("class")).otherwise(0))
    sizes = sizes.groupBy("run", "large", "of").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).withColumn("number", F.explode(F.sequence(F.lit(1), "blocks")))
    blocks = sizes.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("large", "of", "number"))).alias("blocks"))
    own = F.filter("blocks", lambda b: b["large"] & (b["of"] == F.col("class")))
    dealt = places.join(blocks, "run").withColumn("mine", own).withColumn("large", F.size("mine") > 0).withColumn("mine", F.when(F.col("large"), F.col("mine")).otherwise(F.filter("blocks", lambda b: ~b["large"])))
    dealt = dealt.withColumn("own", F.get("mine", F.pmod(F.xxhash64("doc", "place"), F.size("mine")).cast("int")))
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("large"), F.array_except("blocks", "mine")).otherwise(F.col("blocks"))))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "half": F.when(F.col("own") <= F.col("other"), 0).otherwise(1), "alone": F.col("own") == F.col("other")})
    # numbers in place of the structs: blocks of a run by their order
    order = {k: F.array_position("blocks", F.col(k)).cast("int") for k in ("i", "j")}
    dealt = dealt.withColumns(order).select("run", "i", "j", "half", "alone", "class", "doc", "place", "before", "units")
    return dealt.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j", "doc", "place").mapInArrow(_compared(size, least), FOUND)


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key is found in several classes."""
    several = rows.groupBy(key).agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a < b").select(key)
    return rows.join(several, key)


def passages(docs: DataFrame, passage: int = PASSAGE, functions: int = FUNCTIONS, enough: int = ENOUGH, least: float = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start_word, other_id, other_start, n_words, similarity: spans in which each window of ``passage``
    words is alike, both ways round, as far as the two documents were tried; ``similarity`` is that of the least like
    window. Documents that share a passage are connected by such rows, though not each with each.

    * null, empty and short texts have no passages; rows without id are left out, as a pair could not name them; rows that
      repeat an id count as one document, passages within a document are not looked for.
    * an empty table gives an empty result; other columns of the input are not looked at.
    """
    size = passage - WORDS + 1
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), text_of(text).alias("text")).filter("doc is not null")
    with shuffles_released(docs.sparkSession):
        frequent = _frequent(rows, size, functions)
        found = materialized(links(rows, size, functions, enough, frequent), "links")
        asked = found.select("doc", "begin", "size").unionByName(found.select(F.col("other").alias("doc"), F.col("start").alias("begin"), "size"))
        asked = materialized(asked.groupBy("doc").agg(F.collect_set(F.struct("begin", "size")).alias("asked")), "asked")
        held = _texts_of(rows, asked).select("doc", "text", "asked")
        held = materialized(held.mapInArrow(_stretches, "doc long, begin int, size int, units binary"), "stretches")
        other = held.select(F.col("doc").alias("other"), F.col("begin").alias("start"), "size", F.col("units").alias("theirs"))
        met = found.join(held, ["doc", "begin", "size"]).join(other, ["other", "start", "size"]).filter(F.length("units") == F.length("theirs")).filter(F.length("units") >= 4 * size)
        good = met.select("doc", "begin", "other", "start", "units", "theirs").mapInArrow(_verified(size, least), FOUND)
        good = materialized(spans(good, passage), "verified")
        good = good.unionByName(materialized(spans(rest(rows, good, size, least, functions, buckets_for(SAMPLE * frequent.seen)), passage), "rest"))
    back = good.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start_word"), F.col("doc_id").alias("other_id"), F.col("start_word").alias("other_start"), "n_words", "similarity")
    return good.unionByName(back)
