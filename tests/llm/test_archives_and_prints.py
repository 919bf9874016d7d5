"""Archives of other writers; fingerprints of long texts, null and repeated ids, by brute force."""

import gzip
import hashlib
import io
import random

import pytest

from siftline.llm import fingerprints, warc


def foreign(kind, block, *, head=(), record="<urn:uuid:1>"):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", "WARC-Date: 2020-01-01T00:00:00Z", *head, f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"


def test_records_of_other_writers():
    sha256 = "sha256:" + hashlib.sha256(b"x").hexdigest()
    archive = b"".join([
        foreign("warcinfo", b"software: some crawler\r\n"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        foreign("response", CHUNKED, head=["WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{warc.digest(b'hello world')}"]),
        foreign("response", b"HTTP/1.1 200 OK\r\nX: y\r\n  folded\r\n\r\nbody", head=[f"WARC-Block-Digest: {sha256}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'body').hexdigest()}"]),
        foreign("response", b"HTTP/1.1 204 No Content\r\n\r\n"),
        foreign("response", b"dns answer", head=["Content-Type: text/dns"]),
        foreign("revisit", b"", head=["WARC-Refers-To: <urn:uuid:1>"]),
        foreign("metadata", b"a: b"),
        warc.record(5, "http://b/", b"own"),
        warc.record(4, None, b"own", 5, revisit=True),
    ])
    got = list(warc.read_records(io.BytesIO(archive)))
    assert [(r["type"], r["payload"], r["payload_bytes"], r["page_id"], r["refers_to"]) for r in got] == [
        ("response", b"hello world", 11, None, None), ("response", b"body", 4, None, None), ("response", b"", 0, None, None),
        ("revisit", None, None, None, None), ("response", b"own", 3, 5, None), ("revisit", None, 3, 4, 5),
    ]
    assert got[0]["url"] == "http://a/" and got[2]["payload_digest"] == warc.digest(b"") and got[0]["record_id"] == "<urn:uuid:1>"


@pytest.mark.parametrize("raw", [
    foreign("response", CHUNKED, head=["WARC-Payload-Digest: sha1:" + "A" * 32]),
    foreign("metadata", b"a: b", head=["WARC-Block-Digest: sha1:" + "A" * 32]),
    foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody"),
    gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"),
    gzip.compress(b"WARC/1.0\r\nContent-Length: 30\r\n\r\nabc\r\n\r\n"),
    gzip.compress(b"no record"),
])
def test_broken_records_raise(raw):
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw)))


def test_many_copies_take_the_other_join(spark, monkeypatch):
    monkeypatch.setattr(warc, "KEEPERS", 4)
    rows = [(i, "u", f"<p>{i % 7}</p>") for i in range(40)] + [(None, "v", "<p>1</p>"), (None, None, "lone"), (50, "w", None), (51, "w", ""), (39, "again", "<p>4</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = [tuple(r) for r in warc.archive_digests(df).collect()]
    want = []
    for i, _, h in rows:
        h = h or ""
        keeper = max((r[0] for r in rows if (r[2] or "") == h and r[0] is not None), default=None)
        revisit = keeper is not None and i != keeper
        want.append((i, len(h), warc.digest(h.encode()), "revisit" if revisit else "response", keeper if revisit else None))
    assert sorted(got, key=str) == sorted(want, key=str)


def spans_of(text):
    return {text[i : i + fingerprints.SPAN] for i in range(len(text) - fingerprints.SPAN + 1)}


def test_blocks_change_nothing(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abcé😀 ") for _ in range(n)) for n in (0, 1, 23, 24, 25, 63, 64, 65, 500, 3000)] + ["a" * 700]
    whole = [fingerprints.Prefixes(t) for t in texts]
    prints = [p.fingerprint() for p in whole]
    monkeypatch.setattr(fingerprints, "BLOCK", 64)
    fingerprints._powers.cache_clear()
    cut = [fingerprints.Prefixes(t) for t in texts]
    assert [p.span(0, p.n) for p in cut] == [p.span(0, p.n) for p in whole]
    for text, p, q, print_ in zip(texts, whole, cut, prints, strict=True):
        assert [s.tolist() for s in p.sums] == [s.tolist() for s in q.sums]
        assert q.fingerprint().split(".")[:4] == print_.split(".")[:4]
        if len(text) > 600:
            i, j = 17, 401
            k = 0
            while j + k < len(text) and text[i + k] == text[j + k]:
                k += 1
            assert q.common_extension(i, q, j) == k
    monkeypatch.undo()
    fingerprints._powers.cache_clear()


def test_likeness_by_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        a = "".join(rnd.choice("abcdefghij ") for _ in range(rnd.randint(1, 900)))
        cut = rnd.randint(0, len(a))
        b = a[:cut] + "".join(rnd.choice("klmnopqr") for _ in range(len(a) - cut))
        near = fingerprints.likeness(fingerprints.Prefixes(a).fingerprint(), fingerprints.Prefixes(b).fingerprint())
        shared = cut / len(a)
        x, y = spans_of(a), spans_of(b)
        resemblance = len(x & y) / max(1, len(x | y))
        # a rung of the ladder is at most 2**(1/4) from the next; the least hashes are a sample
        assert 0 <= near <= 1 and near >= shared / 2**0.25 - 3 / len(a) - 1e-9
        assert near <= max(shared, resemblance + 0.35) + 1e-9


def test_null_and_repeated_ids(spark):
    rnd = random.Random(7)
    text = lambda: "".join(rnd.choice("abc de") for _ in range(rnd.randint(0, 90)))
    rows = [(i % 9 if i % 4 else None, text() if i % 6 else None) for i in range(40)]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        want.append((d, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        by_text.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
