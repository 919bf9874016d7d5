"""Readers of the public vocabulary files; every path is a parameter."""

from __future__ import annotations

import base64
import re
from functools import cache
from itertools import chain

import numpy as np

from siftline.llm.segments import CutTable, run_starts


def public(name: str) -> str:
    """The path of a file of the public tokenizers, where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 token, blank, rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


# Runs of Latin letters, and runs of ASCII other than letters, apostrophe and
# "<".  The pre-tokenizer of byte-level BPE always cuts between two such runs
# (an apostrophe may start a contraction, "<" a special token, and a space
# leads the next run).
_CUTS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[\\x21-\\x26\\x28-\\x3b\\x3d-\\x40\\x5b-\\x60\\x7b-\\x7e]+|\\n(?=[!-~À-ÖØ-öø-ÿ])")


def runs_of(text: str) -> list[str]:
    """The runs of a text if it is nothing but such runs, else the text as it is."""
    cuts = _CUTS.findall(text)
    return cuts if sum(map(len, cuts)) == len(text) else [text]


class TokenizerIds:
    """Ids of whole texts by a tokenizers .json file, as unsigned integers.

    The library itself encodes each distinct run of letters or punctuation
    once while it is remembered; cuts are only made where its pre-tokenizer
    cuts as well.  That holds for byte-level ones whose added tokens start
    with "<" and have no white space; any other encodes whole texts.
    """

    def __init__(self, path: str, capacity: int = 1_000_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        parts = json.loads(self.library.to_str())
        before = parts["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        added = all(x["content"].startswith("<") and not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in parts["added_tokens"])
        self.whole = not (plain and added and parts["normalizer"] is None)
        self.table = CutTable(self._encode, self.dtype, capacity, starts=run_starts)

    def _encode(self, texts: list[str], _first: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each document of a UTF-8 buffer."""
        if self.whole:
            raw, at = data.tobytes(), offsets.tolist()
            ids, lengths = self._encode([raw[a:b].decode() for a, b in zip(at, at[1:], strict=False)])
            bounds = np.concatenate(([0], np.cumsum(lengths)))
        else:
            ids, bounds = self.table(data, offsets)
        bounds = bounds.tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


@cache
def tokenizer_ids(path: str) -> TokenizerIds:
    """One of each in a Python worker."""
    return TokenizerIds(path)
