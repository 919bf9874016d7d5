"""Token operators against the libraries themselves."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from siftline.llm import bpe, packing, segments, token_counts, token_files, vocab
from siftline.llm.arrow import utf8_buffer

PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "ﬁ", "<|endoftext|>", "<", "1", "9", ".", ",", "▁", "　", "\xa0", "​", "\x85", "漢", "字", "ß", "the", " The", "\x00", "🙂", "é", "\x1c", "\r\n", "'ll", "<s>"]


def fuzz(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)] + ["a" * 3000, "ab " * 700, "", "x" * 700 + "y"]


def buffer(texts):
    return utf8_buffer(pa.array(texts, pa.string()))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.public("byte_bpe_50k.json"))


def test_ids_equal_the_library(tokenizer):
    texts = fuzz(3000)
    found = vocab.TokenizerIds(vocab.public("byte_bpe_50k.json"), capacity=500)(*buffer(texts))
    assert [x.tolist() for x in found] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_runs_are_cut_where_the_library_cuts(tokenizer):
    rnd = random.Random(9)
    parts = ["a", "Ab", "é", "×", "÷", "Àÿ", "ž", "'", "'s", "'ll", "<", "<|endoftext|>", "|>", ".", ",,", "7", "12", "\n", "\n\n", "\r\n", " ", "  ", "\t", "$", "漢", "\xa0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(6000)]
    found = vocab.TokenizerIds(vocab.public("byte_bpe_50k.json"), capacity=300)(*buffer(texts))
    assert [x.tolist() for x in found] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    data, offsets = buffer(["one,two\nthree 4.5six's <|endoftext|>x,y"])
    starts, first = segments.run_starts(data, offsets)
    pieces = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert pieces == ["one", ",", "two", "\n", "three", " 4.5", "six's", " <|endoftext|>x,y"] and first.tolist() == [0]


def test_another_pre_tokenizer_encodes_whole_texts(tokenizer, tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_str(tokenizer.to_str())
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
    other.save(str(tmp_path / "other.json"))
    texts = fuzz(300, 4) + ["one,two three.four"]
    ids = vocab.TokenizerIds(str(tmp_path / "other.json"))
    assert ids.whole and not vocab.TokenizerIds(vocab.public("byte_bpe_50k.json")).whole
    assert [x.tolist() for x in ids(*buffer(texts))] == [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]


def test_piece_counts_equal_the_library():
    import sentencepiece

    path = vocab.public("piece_bpe_32k.model")
    texts = fuzz(3000, 2)
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    assert token_counts.PieceCounter(path, capacity=500)(*buffer(texts)).tolist() == want


def test_bpe_equals_the_library_and_decodes():
    import tiktoken

    own = bpe.ByteBpe(vocab.public("byte_bpe_multi_50k.tiktoken"), vocab.pretoken_pattern(), capacity=500)
    library = tiktoken.Encoding("own", pat_str=vocab.pretoken_pattern(), mergeable_ranks=own.ranks, special_tokens={})
    texts = fuzz(3000, 3) + ["z" * 5000, "abc" * 900]
    found = own.encode(*buffer(texts))
    assert [x.tolist() for x in found] == [library.encode_ordinary(t) for t in texts]
    assert all(own.decode(x) == t.encode() for x, t in zip(found, texts, strict=True))


ROWS = [(3, "the cat  sat", "x"), (None, "no id", None), (1, None, None), (2, "", "y"), (3, "the cat  sat", "x"), (7, "word " * 3000, None)]


def rows(spark, some=None):
    return spark.createDataFrame(ROWS if some is None else some, "doc_id long, text string, n_tokens string")


def test_round_trip_of_nulls_repeats_and_clashing_columns(spark):
    path = vocab.public("byte_bpe_multi_50k.tiktoken")
    got = bpe.round_trip(rows(spark), path).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next((t or "") for d, t, _ in ROWS if d == r.doc_id)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    both = bpe.decode(bpe.encode(rows(spark), path), path).collect()
    assert sorted(bytes(r.decoded).decode() for r in both) == sorted(t or "" for _, t, _ in ROWS)
    assert bpe.round_trip(rows(spark, []), path).count() == 0


def test_counts_replace_a_clashing_column(spark):
    got = token_counts.count_tokens(rows(spark), vocab.public("piece_bpe_32k.model")).collect()
    assert len(got) == len(ROWS)
    assert {r.n_tokens for r in got if r.text is None or r.text == ""} == {0}
    json = token_counts.count_tokens(rows(spark), vocab.public("byte_bpe_50k.json")).collect()
    assert all(r.n_tokens > 0 for r in json if r.text)


def test_token_files_round_trip(spark, tokenizer):
    got = token_files.token_file_digests(rows(spark), vocab.public("byte_bpe_50k.json")).collect()
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc, text, _ in ordered:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_file_digests(rows(spark, []), vocab.public("byte_bpe_50k.json")).count() == 0


def test_packing_holds_every_id_once(spark, tokenizer):
    got = packing.pack(rows(spark), vocab.public("byte_bpe_50k.json")).collect()
    ids = {t or "": [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in ROWS}
    of = {d: t or "" for d, t, _ in ROWS}
    held = {}
    for r in got:
        piece = ids[of[r.doc_id]][r.start : r.start + r.length]
        assert r.length == len(piece) <= 1024 and r.doc_tokens == len(ids[of[r.doc_id]])
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(len(ids[t or ""]) for _, t, _ in ROWS)
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_differencing_gives_near_equal_groups():
    assert sorted(map(sorted, packing.differencing([8, 7, 6, 5, 4], 2))) == [[0, 2], [1, 3, 4]] or max(sum([8, 7, 6, 5, 4][i] for i in g) for g in packing.differencing([8, 7, 6, 5, 4], 2)) <= 16
    rnd = random.Random(5)
    for k in (1, 2, 5, 20):
        sizes = [rnd.randint(1, 1023) for _ in range(60)]
        groups = packing.differencing(sizes, k)
        assert len(groups) == k and sorted(i for g in groups for i in g) == list(range(60))
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert max(sums) - min(sums) <= 1023
    assert packing.windows_of([], 10) == []
    assert all(sum([600, 600, 600][i] for i in g) <= 1024 for g in packing.windows_of([600, 600, 600], 1024))
