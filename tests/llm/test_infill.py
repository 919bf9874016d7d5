"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import pytest

from siftline.llm import infill


def brute(i, text, how):
    text = text or ""
    h = hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in (how.prefix, how.suffix, how.middle)) or h3 % 100 >= how.rate:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < how.spm:
        return n, "spm", len(p), len(m), how.suffix + s + how.prefix + p + how.middle + m
    return n, "psm", len(p), len(m), how.prefix + p + how.suffix + s + how.middle + m


TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc\nd", "é😀\n日本\r\nx y\u0085z\n\ttab", "<P> is a mark\nso plain", "x<S>", "<M>", "<P\n<S\n<M\n>", "<\n<\nP>\nS>", "nul\x00in\nside\x00\n",
    "".join(f"line {i}\n" for i in range(20_000)), "w" * 3_000_000, "'quoted' \\ back\n" * 7, "a\nb\nc\nd",
]


@pytest.mark.parametrize("how", [infill.Infill(), infill.Infill(seed=3, rate=60, spm=20, prefix="[pre]", suffix="{suf}", middle="(mid)")])
def test_equals_brute_force(spark, how):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc", "y"), (5, "a\nb\nc", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    made = infill.fill_in_middle(df, how)
    got = sorted([tuple(r) for r in made.collect()], key=repr)
    assert got == sorted([(i, *brute(i, t, how)) for i, t, _ in rows], key=repr)
    back = sorted([tuple(r) for r in infill.restored(made, how).collect()], key=repr)
    assert back == sorted([(i, t or "") for i, t, _ in rows], key=repr)
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in infill.infill_digests(df, how).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert digests == {(i, sha(brute(i, t, how)[-1]), sha(t or "")) for i, t, _ in rows}
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_empty_table_and_names(spark):
    df = spark.createDataFrame([], "key string, body string, output int, id int")
    assert infill.fill_in_middle(df, id_col="id", text_col="body").collect() == []
    assert infill.infill_digests(df, id_col="id", text_col="body").columns[0] == "doc_id"


def test_marks_must_not_overlap():
    for marks in ({"prefix": "aba"}, {"prefix": "<S>"}, {"middle": ""}, {"prefix": "x<S"}, {"prefix": ">P<"}):
        with pytest.raises(ValueError):
            infill.Infill(**marks)
