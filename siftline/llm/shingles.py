"""Word shingles of whole texts, hashed in arrays over a UTF-8 buffer.

Words are maximal runs of bytes other than space and \\x09 to \\x0D, with A-Z
lower-cased.  A document's shingles are its windows of ``width`` words; with
fewer words the whole sequence is its one shingle; without words it has none.
"""

from __future__ import annotations

import numpy as np

from siftline.llm.segments import mix, span_hashes

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all words, and the index of each word's document."""
    inside = ~_GAP[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    starts[bounds] = inside[bounds]
    stops[bounds - 1] = inside[bounds - 1]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash) of all distinct shingles, sorted by both."""
    lowered = _LOWER[data]
    starts, stops, doc = word_spans(lowered, offsets)
    words = span_hashes(lowered, starts, stops)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))

    def rolled(k: int) -> np.ndarray:
        """The hash of the k words from each word on, while there are so many."""
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
        return out

    docs, hashes = [], []
    if len(words) >= width:
        whole = doc[: len(words) - width + 1] == doc[width - 1 :]
        docs.append(doc[: len(words) - width + 1][whole])
        hashes.append(rolled(width)[whole])
    for k in range(1, width):  # texts of k words
        few = np.flatnonzero(counts == k)
        if len(few):
            docs.append(few)
            hashes.append(rolled(k)[first[few]])
    docs, hashes = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[keep], hashes[keep]
