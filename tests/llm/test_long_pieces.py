"""Pieces of many rows: random letters, repeated words, single letters; ids equal the library's."""

import random
import time

import numpy as np
import pytest
import tiktoken

from siftline.llm import bpe
from siftline.llm.vocab import pretoken_pattern, public

RND = random.Random(1)
CASES = {
    "random letters": "".join(RND.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)),
    "frequent letters": "".join(RND.choices("eeeeetttaaooinshrdlu", k=40_000)),
    "two letters": "".join(RND.choices("ab", k=20_000)),
    "one letter": "a" * 20_001,
    "a word of three": "abc" * 9_000,
    "a word of seven": "x" + "abcdefg" * 6_000 + "q",
    "pieces of words": "".join(RND.choice(["the", "ing", "and", "tion", "qu", "xyz"]) for _ in range(9_000)),
    "han": "".join(RND.choices("的一是在不了有和人这", k=9_000)),
    "just above a row": "z" * (bpe.ROW + 1),
    "digits of no space": "".join(RND.choices("éèêßñ", k=5_000)),
}


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBpe(public("byte_bpe_multi_50k.tiktoken"), pretoken_pattern())


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("x", pat_str=pretoken_pattern(), mergeable_ranks=own.ranks, special_tokens={})


@pytest.mark.parametrize("name", sorted(CASES))
def test_equals_the_library(own, library, name):
    data = np.frombuffer(CASES[name].encode(), np.uint8)
    (ids,) = own.encode(data, np.array([0, len(data)]))
    assert ids.tolist() == library.encode_ordinary(CASES[name])
    assert own.decode(ids) == data.tobytes()


@pytest.mark.parametrize("row", [4, 8, 16])
def test_short_rows(own, library, monkeypatch, row):
    monkeypatch.setattr(bpe, "ROW", row)
    for text in CASES.values():
        raw = text[:600].encode()
        assert own.encode_bytes([raw])[0].tolist() == library._core_bpe.encode_single_piece(raw)


def test_a_megabyte_of_letters_in_seconds(own, library):
    raw = "".join(RND.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)).encode()
    began = time.monotonic()
    ids = own.encode_bytes([raw])[0]
    assert time.monotonic() - began < 30
    assert ids.tolist() == library._core_bpe.encode_single_piece(raw)


@pytest.mark.parametrize("name", sorted(CASES))
def test_a_piece_as_one_row(own, library, name):
    raw = CASES[name].encode()
    assert own._wide(raw).tolist() == library._core_bpe.encode_single_piece(raw)


@pytest.mark.parametrize("seed", range(40))
def test_rows_of_any_vocabulary(seed):
    """Vocabularies in which a merged token may make a pair of less rank: equal to merging one pair after another."""
    rnd = random.Random(seed)
    tokens = [b"a", b"b", b"c"] + sorted({bytes(rnd.choices(b"abc", k=rnd.randrange(2, 6))) for _ in range(40)}, key=lambda _: rnd.random())
    own = object.__new__(bpe.ByteBpe)
    own.ranks = {t: i for i, t in enumerate(tokens)}
    own.table = bpe.PairTable(own.ranks)
    own.single = np.full(256, -1, np.int32)
    for b in b"abc":
        own.single[b] = own.ranks[bytes([b])]
    for _ in range(30):
        raw = bytes(rnd.choices(b"abc", k=rnd.randrange(1, 60)))
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            ranks = [own.ranks.get(x + y, 1 << 30) for x, y in zip(parts, parts[1:], strict=False)]
            if not ranks or min(ranks) == 1 << 30:
                break
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [own.ranks[p] for p in parts]
        assert own._wide(raw).tolist() == want
        assert own._matrix([raw], len(raw))[0].tolist() == want


@pytest.mark.parametrize("word", ["a", "ab", "abcdefg", "hello", "xyzzyqwertzuiop"])
def test_a_megabyte_of_a_repeated_word_in_seconds(own, library, word):
    raw = (word * (1_000_000 // len(word))).encode()
    began = time.monotonic()
    ids = own.encode_bytes([raw])[0]
    assert time.monotonic() - began < 10
    assert ids.tolist() == library._core_bpe.encode_single_piece(raw)
