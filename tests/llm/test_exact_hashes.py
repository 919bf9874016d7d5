"""Texts of a regular build, and hashes that are made to collide: results stay those of the libraries and of brute force."""

import hashlib

import numpy as np
import pytest

from siftline.llm import bpe, ngram_join, segments, suffix_dedup, token_counts
from siftline.llm.vocab import TokenizerIds, pretoken_pattern, public
from tests.llm.test_duplicates import removed


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.fixture(scope="module")
def texts():
    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    tail = " and ten more plain words that follow after it here"
    return ["abababab" + one, "abababab" + two, one + tail, two + tail, "x " + one, "x " + two, "", None, "word " * 30]


@pytest.fixture(params=["as it is", "all hashes equal", "few hashes"])
def hashes(request, monkeypatch):
    whole = segments.span_hashes
    if request.param == "all hashes equal":
        monkeypatch.setattr(segments, "span_hashes", lambda d, a, b: np.full(len(a), 7, np.uint64))
    elif request.param == "few hashes":
        monkeypatch.setattr(segments, "span_hashes", lambda d, a, b: whole(d, a, b) & np.uint64(3 << 60))


def buffer(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum(list(map(len, raw)))))


def test_tables_equal_the_libraries(texts, hashes):
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    texts = [*texts, "two words alike in eight bytes: abcdefghijk abcdefghijl abcdefghijk", "abcdefghijl"]
    data, offsets = buffer(texts)
    path = public("byte_bpe_multi_50k.tiktoken")
    own = bpe.ByteBpe(path, pretoken_pattern())
    library = tiktoken.Encoding("x", pat_str=pretoken_pattern(), mergeable_ranks=own.ranks, special_tokens={})
    json = TokenizerIds(public("byte_bpe_50k.json"))
    counter = token_counts.PieceCounter(public("piece_bpe_32k.model"))
    tokenizer = Tokenizer.from_file(public("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public("piece_bpe_32k.model"))
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in own.encode(data, offsets)] == [library.encode_ordinary(t or "") for t in texts]
        assert [x.tolist() for x in json(data, offsets)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counter(data, offsets).tolist() == [len(pieces.encode(t or "")) for t in texts]


def test_eviction_keeps_bytes_and_values():
    asked = []

    def value(cuts, first):
        asked.extend(cuts)
        return [np.frombuffer(c.encode()[::-1], np.uint8) for c in cuts]

    table = segments.CutTable(value, np.uint8, capacity=40)
    for k in range(30):
        texts = [f"common-{j} other{k}-{j} word" for j in range(9)]
        data, offsets = buffer(texts)
        values, bounds = table(data, offsets)
        for i, t in enumerate(texts):
            cuts = [c if j == 0 else " " + c for j, c in enumerate(t.split(" "))]
            assert values[bounds[i] : bounds[i + 1]].tobytes() == b"".join(c.encode()[::-1] for c in cuts)
    assert len(asked) < 30 * 20


def test_span_hashes_do_not_depend_on_the_place():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 100, 5000).astype(np.uint8)
    edges = np.unique(rnd.integers(0, 5000, 90))
    starts, stops = edges[:-1:2], edges[1::2][: len(edges[:-1:2])]
    whole = segments.span_hashes(data, starts, stops)
    for h, a, b in zip(whole, starts, stops, strict=True):
        assert segments.span_hashes(data[a:b], np.array([0]), np.array([b - a]))[0] == h
    long_ = np.frombuffer((thue_morse(4096) + thue_morse(4096, "b", "a")).encode(), np.uint8)
    for n in (8, 64, 128, 1024, 4096):
        x, y = segments.span_hashes(long_, np.array([0, 4096]), np.array([n, 4096 + n]))
        assert x != y
    a, b = suffix_dedup.overlapping_hashes(long_, np.array([0, 4096]), np.array([256, 4096 + 256]))
    assert a != b


def test_joins_tell_regular_texts_apart(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()}
    assert got[0] == (1, 0) and got[1] == (1, 1) and got[4] == (1, 4) and got[5] == (1, 5)
    assert got[2][1] == 2 and got[3][1] == 2  # all shingles but one are the same
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_digests(df).collect()}
    assert found == dict(zip(range(len(texts)), removed(texts), strict=True))


def test_round_trip_of_regular_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = bpe.round_trip(df, public("byte_bpe_multi_50k.tiktoken")).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
