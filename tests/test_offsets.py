"""The offset index against a scan of the bytes; look-ups that read only what is sought."""

import random

import pytest

from siftline.sources import offsets


def lines(seed: int, n: int) -> list[bytes]:
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        kind = rnd.randrange(12)
        body = "".join(rnd.choices("abc é漢\r😀", k=rnd.randrange(60)))
        out.append((b"", b"no tab", b"\tleading\tx\ty", f"D{i}\tthree\tfields".encode(), f"D{i}\tu\tt\tb\tfive".encode())[kind] if kind < 5 else f"D{rnd.randrange(n)}\tu{i}\tt\t{body}".encode() + b"\xff" * (kind == 5))
    return out


def scan(files: list) -> dict:
    """docid -> (file, offset, line), the last line of an id, files in order of name."""
    out = {}
    for path in sorted(files):
        at = 0
        for line in path.open("rb"):
            tab = line.find(b"\t")
            if at == 0 and line.startswith(b"\xef\xbb\xbf"):
                tab -= 3
            if tab > 0:
                out[line[line.startswith(b"\xef\xbb\xbf") * 3 :].split(b"\t")[0].decode()] = (path.name, at + 3 * line.startswith(b"\xef\xbb\xbf"), line)
            at += len(line)
    return out


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_offsets_and_documents_equal_a_scan(spark, tmp_path, small_splits):
    files = []
    for k, (n, end, start) in enumerate([(120, b"\n", b""), (80, b"", b"\xef\xbb\xbf"), (1, b"", b""), (40, b"\n\n", b"")]):
        path = tmp_path / f"part {k}.tsv"
        path.write_bytes(start + b"\n".join(lines(k, n)) + end)
        files.append(path)
    want = scan(files)
    index = offsets.build_index(spark, [str(f) for f in files], str(tmp_path / "index"))
    got = {r.docid: (r.file.rsplit("/", 1)[1].replace("%20", " "), r.offset, r.size) for r in index.collect()}
    assert {d: x[:2] for d, x in got.items()} == {d: x[:2] for d, x in want.items()}
    assert all(got[d][2] in (len(x[2]), len(x[2]) + 1, len(x[2]) - 3, len(x[2]) - 2) for d, x in want.items())

    def rows(ids):
        asked = spark.createDataFrame([(d, 1) for d in [*ids, "D-none", None, *ids[:3]]], "docid string, body int")
        return sorted(tuple(r) for r in offsets.fetch(index, asked).select("docid", "url", "title", "body").collect())

    for ids in (sorted(want)[:20], sorted(want)):
        whole = [x[2].removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace").rstrip("\n").split("\t") for d, x in want.items() if d in ids]
        assert rows(ids) == sorted(tuple(p) for p in whole if len(p) == 4)
    assert rows([]) == []


def test_a_look_up_reaches_the_scan_and_many_ids_are_joined(spark, tmp_path, monkeypatch):
    path = tmp_path / "d.tsv"
    path.write_text("".join(f"D{i}\tu\tt\tbody {i}\n" for i in range(3000)))
    index = offsets.build_index(spark, str(path), str(tmp_path / "index"))
    asked = spark.createDataFrame([("D7",), ("D2999",)], "docid string")
    plan = offsets.found_in(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(docid,D2999),EqualTo(docid,D7))]" in plan and "Join" not in plan
    found = offsets.fetch(index, asked)
    assert {(r.docid, r.body) for r in found.collect()} == {("D7", "body 7"), ("D2999", "body 2999")}
    assert found.agg({"n_bytes": "sum"}).first()[0] < 40
    monkeypatch.setattr(offsets, "FEW", 1)
    assert {r.docid for r in offsets.fetch(index, asked).collect()} == {"D7", "D2999"}


def test_no_lines_and_compressed_files(spark, tmp_path):
    import gzip

    (tmp_path / "empty.tsv").write_bytes(b"")
    index = offsets.build_index(spark, str(tmp_path / "empty.tsv"), str(tmp_path / "index"))
    assert index.count() == 0 and offsets.fetch(index, spark.createDataFrame([("D1",)], "docid string")).count() == 0
    (tmp_path / "z.tsv.gz").write_bytes(gzip.compress(b"D1\tu\tt\tb\n" * 50))
    with pytest.raises(Exception, match="lines and size differ"):
        offsets.line_offsets(spark, str(tmp_path / "z.tsv.gz")).collect()
