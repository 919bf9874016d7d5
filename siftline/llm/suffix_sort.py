"""Deep-shallow ordering of suffixes, for suffixes that count up to a fixed length.

Shallow: multikey quicksort.  Every open segment of suffixes takes a pivot
character and is split three ways, into less, equal and greater; the equal
part goes on with the next character.  A character is eight bytes, and all
segments are split in the same array operation.  Deep: segments that are
still equal at the shallow depth are ordered by blind tries, which look at
branching bits only and compare each suffix with one other.
"""

from __future__ import annotations

import numpy as np

STEP = 8


class Text:
    """Bytes that can be read as big-endian characters of eight bytes at any place."""

    def __init__(self, data: np.ndarray, length: int):
        self.data = np.concatenate((data, np.zeros(length + STEP, np.uint8)))
        self.words = np.ndarray((len(self.data) - STEP + 1,), ">u8", self.data, strides=(1,))
        self.raw = self.data.tobytes()

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.words[places].astype(np.uint64)


def multikey(text: Text, starts: np.ndarray, buckets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, segment): suffixes sorted by bucket and first ``depth`` bytes, and a number equal for ties.

    ``buckets`` are ascending integers that come before the first character.
    """
    n = len(starts)
    order = np.arange(n)
    segment = np.concatenate(([0], np.cumsum(buckets[1:] != buckets[:-1]))) if n else order  # by place in the order
    first = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), segment[1:] != segment[:-1])))
    # open segments: [begin, begin + size) at a depth
    size = np.diff(np.append(first, n))
    begin, size = first[size > 1], size[size > 1]
    deep = np.zeros(len(begin), np.int64)
    ends = []
    while len(begin):
        total = int(size.sum())
        of = np.repeat(np.arange(len(begin)), size)
        base = np.cumsum(size) - size
        place = np.arange(total) - base[of] + begin[of]
        member = order[place]
        key = text.at(starts[member] + deep[of])
        picks = np.sort(np.stack([key[base], key[base + size // 2], key[base + size - 1]]), 0)[1]
        pivot = picks[of]
        side = (key > pivot).astype(np.int8) - (key < pivot).astype(np.int8) + 1
        count = np.stack([np.bincount(of[side == s], minlength=len(begin)) for s in (0, 1, 2)])
        moved = np.argsort(of * 3 + side, kind="stable")
        order[place] = member[moved]
        starts_at = begin + np.concatenate((np.zeros((1, len(begin)), np.int64), np.cumsum(count, 0)[:2]))
        new_begin, new_size = starts_at.ravel(), count.ravel()
        new_deep = np.concatenate((deep, deep + STEP, deep))
        equal = np.concatenate((np.zeros(len(begin), bool), np.ones(len(begin), bool), np.zeros(len(begin), bool)))
        tied = equal & (new_deep >= depth) & (new_size > 1)
        ends.append(np.stack([new_begin[tied], new_size[tied]]))
        live = (new_size > 1) & ~tied
        begin, size, deep = new_begin[live], new_size[live], new_deep[live]
    segment = np.arange(n)
    if ends:
        b, s = np.concatenate(ends, 1)
        within = np.repeat(b, s)
        where = np.repeat(b - (np.cumsum(s) - s), s) + np.arange(s.sum())
        segment[where] = within
    return order, segment


def blind_trie(keys: list[int]) -> tuple[list[int], list[bool]]:
    """(order, equal to the one before) of integers of one width, by a blind trie.

    An inner node is [bit, left, right] and holds no other part of a key; a
    leaf lists the equal keys.  Higher bits branch nearer to the root.
    """
    root: list = [keys[0], [0]]  # a leaf: [key, members]
    for i, key in enumerate(keys[1:], 1):
        node = root
        while len(node) == 3:
            node = node[2] if key >> node[0] & 1 else node[1]
        bit = (key ^ node[0]).bit_length() - 1
        if bit < 0:
            node[1].append(i)
            continue
        above, node = None, root
        while len(node) == 3 and node[0] > bit:
            above = node, (2 if key >> node[0] & 1 else 1)
            node = above[0][above[1]]
        leaf = [key, [i]]
        inner = [bit, node, leaf] if key >> bit & 1 else [bit, leaf, node]
        if above is None:
            root = inner
        else:
            above[0][above[1]] = inner
    order, same, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 3:
            stack += [node[2], node[1]]
        else:
            order += node[1]
            same += [False] + [True] * (len(node[1]) - 1)
    return order, same


def repeated(data: np.ndarray, starts: np.ndarray, buckets: np.ndarray, length: int, depth: int = 32) -> np.ndarray:
    """Which suffixes equal another of their bucket in the first ``length`` bytes.

    Suffixes are put in order; one repeats if its neighbour has them in common.
    """
    text = Text(data, length)
    by_bucket = np.argsort(buckets, kind="stable")
    starts_, buckets_ = starts[by_bucket], buckets[by_bucket]
    order, segment = multikey(text, starts_, buckets_, min(depth, length))
    flag = np.zeros(len(starts), bool)
    tied = np.flatnonzero(np.append(segment[1:] == segment[:-1], False))
    if len(tied):
        heads = np.unique(segment[tied])
        sizes = np.bincount(segment)[heads]
        pairs = heads[sizes == 2]
        for at in range(0, len(pairs), 1 << 14):  # a trie of two leaves is one comparison
            a, b = starts_[order[pairs[at : at + (1 << 14)]]], starts_[order[pairs[at : at + (1 << 14)] + 1]]
            same = np.ones(len(a), bool)
            for k in range(0, length - STEP + 1, STEP):
                left = np.flatnonzero(same)
                same[left] = text.words[a[left] + k] == text.words[b[left] + k]
            same &= text.words[a + length - STEP] == text.words[b + length - STEP]
            both = pairs[at : at + (1 << 14)][same]
            flag[by_bucket[order[both]]] = True
            flag[by_bucket[order[both + 1]]] = True
        raw = text.raw
        for head, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            members = order[head : head + size]
            keys = [int.from_bytes(raw[s : s + length], "big") for s in starts_[members].tolist()]
            rank, same = blind_trie(keys)
            ranked = members[rank]
            equal = np.array(same)
            either = equal | np.append(equal[1:], False)
            flag[by_bucket[ranked[either]]] = True
    return flag
