"""Texts cut where no token can cross, with a bounded memory of what the cuts give.

Running prose repeats its words, so a tokenizer that is asked once per
distinct word does a small part of the work.  A cut is made only before a
space that follows a visible character; what a library returns for the whole
text is then the concatenation of what it returns for the cuts.

Cuts are found, hashed and looked up in arrays over the UTF-8 buffer of a
record batch; only cuts that are not remembered become Python strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
#: A random number for every byte at every place of a block of 64 bytes.
_BLOCK = 64
_PLACED = np.random.default_rng(20240229).integers(0, 1 << 64, _BLOCK * 256, np.uint64)
#: Bytes after which a space starts a cut: visible ASCII ...
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: ... and the second byte of a two-byte character from U+00C0 (none is white space).
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they are.

    Spans must not be empty and must ascend without overlap.  Bytes are
    tabulated by their place in a block and the blocks of a span are mixed
    before they are added, so no arrangement of bytes cancels out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    per = (stops - starts + _BLOCK - 1) // _BLOCK
    if (per == 1).all():
        first, number, begins, ends = None, np.uint64(1), starts, stops
    else:
        first = np.cumsum(per) - per
        number = np.arange(int(per.sum())) - np.repeat(first, per)
        begins = np.repeat(starts, per) + number * _BLOCK
        ends = np.minimum(begins + _BLOCK, np.repeat(stops, per))
        number = number.astype(np.uint64) + np.uint64(1)
    low, high = int(starts[0]), int(stops[-1])
    place = np.arange(low, high, dtype=np.int32) - np.repeat(begins.astype(np.int32), np.diff(np.append(begins, high)))
    # bytes between spans have no place; what they are given is not summed
    terms = _PLACED[(place & (_BLOCK - 1)) << 8 | data[low:high]]
    edges = np.empty(2 * len(begins), np.int64)
    edges[0::2], edges[1::2] = begins - low, ends - low
    sums = mix(np.add.reduceat(terms, edges[:-1])[0::2] + number * _M)
    if first is not None:
        sums = np.add.reduceat(sums, first)
    return mix(sums + (stops - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all spans, one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def cut_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts start, and the index of each nonempty document's first cut."""
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = np.flatnonzero(data[1:] == 0x20) + 1
    before = data[spaces - 1]
    safe = _VISIBLE[before]
    wide = np.flatnonzero(before >= 0x80)
    safe[wide] = _LEAD[data[np.maximum(spaces[wide] - 2, 0)]]
    mark = np.zeros(len(data), bool)
    mark[spaces[safe]] = True
    mark[first] = True
    starts = np.flatnonzero(mark)
    return starts, np.searchsorted(starts, first)


#: ASCII letters (1), and visible ASCII other than letters, apostrophe and "<" (2).
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[0x27, 0x3C]] = 0
#: Second bytes of the letters among U+00C0 to U+00FF.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def run_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``cut_starts``, with more cuts, where the pre-tokenizer of byte-level BPE always cuts as well.

    It does between a run of Latin letters and one of other visible ASCII, and
    around a line feed that stands alone between the two.  An apostrophe may
    start a contraction and "<" a special token, so neither has a run, and
    a cut that has a "<" in it is not cut further.
    """
    starts, firsts = cut_starts(data, offsets)
    if len(data) < 2:
        return starts, firsts
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = 1
    mark = np.zeros(len(data), bool)
    mark[1:] = kind[1:] + kind[:-1] == 3  # one of each kind
    line = np.flatnonzero(data[1:-1] == 0x0A) + 1
    line = line[(kind[line - 1] > 0) & (kind[line + 1] > 0)]
    mark[line] = mark[line + 1] = True
    special = np.unique(np.searchsorted(starts, np.flatnonzero(data == 0x3C), "right") - 1)
    for a, b in zip(starts[special].tolist(), np.append(starts, len(data))[special + 1].tolist(), strict=True):
        mark[a:b] = False
    first = starts[firsts]
    mark[starts] = True
    starts = np.flatnonzero(mark)
    return starts, np.searchsorted(starts, first)


class CutTable:
    """Values of cuts by open addressing, emptied of what isn't used when full.

    ``value(list of strings, list of booleans)`` gives an array for each cut,
    or all of them as one array and their lengths;
    the booleans tell which are the first of their text.  A cut is looked up
    by a 64-bit hash, its first eight bytes and its length, and all its bytes
    are compared with those of the entry.  One whose hash belongs to another
    cut is asked for by itself, so results never depend on what is remembered.
    """

    def __init__(self, value: Callable[[list[str], list[bool]], Iterable[np.ndarray]], dtype, capacity: int = 1_200_000, marked: bool = False, starts: Callable = cut_starts):
        self.value, self.dtype, self.capacity, self.marked, self.starts = value, np.dtype(dtype), capacity, marked, starts
        self._clear()

    def _clear(self) -> None:
        self.bits = max(10, (2 * self.capacity - 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.key = np.zeros(1024, np.uint64)
        self.head = np.zeros(1024, np.uint64)
        self.size = np.zeros(1024, np.uint32)
        self.at = np.zeros(1025, np.int64)
        self.hit = np.zeros(1024, bool)
        self.pool = np.zeros(4096, self.dtype)
        self.bytes_at = np.zeros(1025, np.int64)
        self.bytes = np.zeros(8192, np.uint8)
        self.n = 0

    def _find(self, keys: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        shift, mask = np.uint64(64 - self.bits), (1 << self.bits) - 1
        slots = (keys >> shift).astype(np.int64)
        found = self.slot[slots]
        ok = found < 0
        ok |= (self.key[found] == keys) & (self.head[found] == heads) & (self.size[found] == sizes)
        open_ = np.flatnonzero(~ok)
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            entry = self.slot[slots[open_]]
            found[open_] = entry
            ok = (entry < 0) | ((self.key[entry] == keys[open_]) & (self.head[entry] == heads[open_]) & (self.size[entry] == sizes[open_]))
            open_ = open_[~ok]
        return found

    def _place(self, entries: np.ndarray) -> None:
        shift, mask = np.uint64(64 - self.bits), (1 << self.bits) - 1
        slots = (self.key[entries] >> shift).astype(np.int64)
        left = np.arange(len(entries))
        while len(left):
            free = left[self.slot[slots[left]] < 0]
            self.slot[slots[free]] = entries[free]  # of several for one slot the last stays
            lost = self.slot[slots[left]] != entries[left]
            left = left[lost]
            slots[left] = (slots[left] + 1) & mask

    def _room(self, more: int, values: int, raw: int) -> None:
        n = self.n + more
        needs = {"key": n, "head": n, "size": n, "hit": n, "at": n + 1, "bytes_at": n + 1, "pool": int(self.at[self.n]) + values, "bytes": int(self.bytes_at[self.n]) + raw + 8}
        for name, need in needs.items():
            old = getattr(self, name)
            if len(old) < need:
                new = np.zeros(max(need, len(old) * 3 // 2), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _add(self, keys, heads, sizes, raw: bytes, found: np.ndarray, lengths: np.ndarray, *, place: bool = True) -> None:
        """New entries; ``raw`` holds their bytes and ``found`` their values one after another."""
        self._room(len(keys), int(lengths.sum()), len(raw))
        a, b = self.n, self.n + len(keys)
        if 2 * b > 1 << self.bits:  # one request may bring more cuts than the capacity
            self.bits = (2 * b - 1).bit_length()
            self.slot = np.full(1 << self.bits, -1, np.int32)
            self._place(np.arange(a, dtype=np.int32))
        self.key[a:b], self.head[a:b], self.size[a:b], self.hit[a:b] = keys, heads, sizes, False
        self.at[a + 1 : b + 1] = self.at[a] + np.cumsum(lengths)
        self.bytes_at[a + 1 : b + 1] = self.bytes_at[a] + np.cumsum(sizes, dtype=np.int64)
        self.bytes[self.bytes_at[a] : self.bytes_at[b]] = np.frombuffer(raw, np.uint8)
        self.pool[self.at[a] : self.at[b]] = found
        self.n = b
        if place:
            self._place(np.arange(a, b, dtype=np.int32))

    def _evict(self) -> None:
        keep = np.flatnonzero(self.hit[: self.n])
        if len(keep) > self.capacity // 2:
            keep = keep[:0]
        key, head, size = self.key[keep], self.head[keep], self.size[keep]
        lengths = self.at[keep + 1] - self.at[keep]
        found, raw = self.pool[_spans(self.at[keep], lengths)], self.bytes[_spans(self.bytes_at[keep], size)].tobytes()
        self._clear()
        self._add(key, head, size, raw, found, lengths)

    def _unlike(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Indices of the cuts that aren't their entry byte for byte (or have none); heads and lengths agree."""
        long_ = np.flatnonzero((sizes > 8) & (entries >= 0))
        size, per = sizes[long_].astype(np.int64), (sizes[long_].astype(np.int64) - 1) // 8
        number = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        # eight bytes at a time, the last eight to the end of the cut
        step = np.minimum(8 * (number + 1), np.repeat(size - 8, per))
        held = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))
        differ = words[np.repeat(starts[long_], per) + step] != held[np.repeat(self.bytes_at[entries[long_]], per) + step]
        bad = np.zeros(len(starts), bool)
        bad[np.repeat(long_, per)[differ]] = True
        return np.flatnonzero(bad | (entries < 0))

    def lookup(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of all cuts; and for each document its first cut's index and the one past its last."""
        starts, firsts = self.starts(data, offsets)
        stops = np.append(starts[1:], len(data)) if len(starts) else starts
        keys = span_hashes(data, starts, stops)
        sizes = (stops - starts).astype(np.uint32)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        words = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        heads = words[starts]
        short = np.minimum(sizes, 8).astype(np.uint64)
        heads = np.where(short < 8, heads & ((np.uint64(1) << (short * np.uint64(8))) - np.uint64(1)), heads)
        is_first = np.zeros(len(starts), bool)
        is_first[firsts] = True
        if self.marked:
            keys = np.where(is_first, keys ^ _M, keys)

        def ask(which: np.ndarray, place: bool) -> None:
            raw = data[_spans(starts[which], sizes[which])].tobytes()
            ends = np.cumsum(sizes[which], dtype=np.int64)
            cuts = [raw[a:b].decode() for a, b in zip((ends - sizes[which]).tolist(), ends.tolist(), strict=True)]
            found = self.value(cuts, is_first[which].tolist())
            if not isinstance(found, tuple):
                found = [np.asarray(v, self.dtype) for v in found]
                found = np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
            self._add(keys[which], heads[which], sizes[which], raw, *found, place=place)

        entries = self._find(keys, heads, sizes)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            _, one = np.unique(keys[missing], return_index=True)
            if self.n + len(one) > self.capacity:
                self._evict()
                entries = self._find(keys, heads, sizes)
                missing = np.flatnonzero(entries < 0)
                _, one = np.unique(keys[missing], return_index=True)
            known = np.ones(len(entries), bool)
            known[missing] = False
            self.hit[entries[known]] = True
            ask(missing[one], True)
            entries[missing] = self._find(keys[missing], heads[missing], sizes[missing])
        else:
            self.hit[entries] = True
        unlike = self._unlike(words, starts, sizes, entries)
        if len(unlike):  # their hash is another cut's; such an entry is never found again
            at = self.n
            ask(unlike, False)
            entries[unlike] = np.arange(at, self.n)
        left = np.searchsorted(starts, offsets[:-1], "left")
        right = np.searchsorted(starts, offsets[1:], "left")
        return entries, left, right

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all documents one after another, and the n + 1 offsets into them."""
        entries, left, right = self.lookup(data, offsets)
        begins = self.at[entries]
        lengths = self.at[entries + 1] - begins
        ends = np.concatenate(([0], np.cumsum(lengths)))
        where = _spans(begins, lengths)
        bounds = np.concatenate((ends[left], ends[right[-1:]])) if len(left) else np.zeros(1, np.int64)
        return self.pool[where], bounds


class Memo:
    """Remembers the values of keys in two generations of bounded size.

    ``fill`` gets the unknown keys of a request as a list and returns their
    values.  When the young generation is full it becomes the old one; a key
    found there moves back.
    """

    def __init__(self, fill: Callable[[list[str]], Iterable], capacity: int):
        self.fill, self.capacity = fill, capacity
        self.young: dict = {}
        self.old: dict = {}

    def need(self, keys: set[str]) -> dict:
        """A dict that has all the keys, valid until the next call."""
        missing = keys.difference(self.young)
        if missing:
            if len(self.young) + len(missing) > self.capacity:
                self.old, self.young = self.young, {}
                missing = keys
            old, young = self.old, self.young
            ask = []
            for key in missing:
                value = old.get(key)
                if value is None:
                    ask.append(key)
                else:
                    young[key] = value
            if ask:
                young.update(zip(ask, self.fill(ask), strict=True))
        return self.young
