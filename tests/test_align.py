"""align_fragments against brute force: every benchmark text with every document."""

import re
import unicodedata
from pathlib import Path

import pytest

from siftline.plans.catalog import QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(s):
    return unicodedata.normalize("NFKD", s or "").encode("ascii", "ignore").decode().lower()


def tokens(s):
    return re.findall(r"[a-z0-9]+", plain(s))


def shingles(t):
    return {tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else {tuple(t)} if t else set()


def units(body):
    return [u for u in (x.strip(" ") for x in re.sub(r"([.!?]) ", "\\1\n", body or "").split("\n")) if u]


def fragments(s):
    return [p for p in (x.strip() for x in re.split(r"\[\s*\.\.\.\s*\]", s or "")) if len(p) >= 8]


def one(frags, grams, plains):
    ids, n = set(), 0
    for f in frags:
        t = tokens(f)
        if len(t) < 6:
            continue
        g = shingles(t)
        ranked = sorted(((i, g & u) for i, u in enumerate(grams) if g & u), key=lambda x: -len(x[1]))
        if not ranked:
            head = [i for i, p in enumerate(plains) if plain(f)[:80] in p][:1]
            ids, n = ids | set(head), n + len(head)
            continue
        got, chosen = set(), set()
        for i, common in ranked:
            if common - got:
                got, chosen = got | common, chosen | {i}
                if len(got) / len(g) >= 0.5:
                    break
        mine = {i for i, common in ranked if len(common) / len(grams[i]) >= 0.5} | (chosen if len(got) / len(g) >= 0.5 else set())
        ids, n = ids | mine, n + bool(mine)
    return sorted(ids), len(frags), n


def brute(items, docs):
    out = {}
    for d, body in docs:
        us = units(body)
        grams, plains = [shingles(tokens(u)) for u in us], [plain(u) for u in us]
        for i, s in items:
            if (row := one(fragments(s), grams, plains))[2]:
                out[i, d] = row
    return out


def aligned(spark, sf):
    rows = QUERIES["align_fragments"](spark, str(sf)).collect()
    assert len({(r.item_id, r.doc_id) for r in rows}) == len(rows)
    return {(r.item_id, r.doc_id): (r.unit_ids, r.n_fragments, r.n_matched) for r in rows}


def test_fixture(spark, tmp_path):
    filler = [f"filler{i} word{i} thing{i} other{i} more{i} last{i}." for i in range(60)]
    a, b = "alpha beta gamma delta epsilon zeta eta theta.", "one two three four five six seven eight nine."
    long_ = " ".join(c * 30 for c in "pqrstu")
    items = [(1, a), (2, f"{a} [...] tiny bit [...] {b}"), (3, long_), (4, "nothing of this kind is anywhere in there"), (5, "Élan naïve café señor über façade plus."), (6, f"{a} {b} one more run of ten words that nobody has")]
    docs = [
        (1, " ".join([*filler[:45], a, *filler[45:], b])),  # past the fifth unit
        (2, a),  # fewer than five units
        (3, f"x. y{long_}z goes on. {long_}"),  # shares its shingle in one unit only
        (4, f"x. y{long_}z goes on."),  # no shingle: found by its start
        (5, "elan naive cafe senor uber facade plus. z."),
        (6, "alpha beta gamma delta epsilon other words come after these so that it is not strong"),
        (7, ""),
        (8, None),
    ]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = aligned(spark, tmp_path)
    assert got == brute(items, docs)
    assert got[1, 1] == ([45], 1, 1) and got[2, 1] == ([45, 61], 3, 2) and got[1, 2] == ([0], 1, 1) and got[3, 4] == ([1], 1, 1)
    assert not any(item == 4 or doc in (7, 8) for item, doc in got)


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_tables(spark):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(key, "text").collect()]
    want = brute(read("benchmark", "item_id"), read("documents", "doc_id"))
    assert want and aligned(spark, DATA) == want


def test_strings_in_texts_equal_brute_force(spark):
    import random

    from siftline.operators.heads import containing

    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab \u00e9\U0001f600") for _ in range(n))
    texts = [None, "", *(word(r.randint(0, 60)) for _ in range(80)), "ab" * 50_000]
    strings = sorted({word(r.randint(1, 5)) for _ in range(60)} | {"ab" * 20, "zzz"})
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    heads = spark.createDataFrame([(h,) for h in strings + strings[:9] + ["", None]], "head string")
    want = sorted((k, h) for k, t in enumerate(texts) for h in strings if t and h in t)
    for most in (1000, 7):
        assert sorted((x.k, x.head) for x in containing(df, "text", heads, "head", most).collect()) == want
    assert containing(df, "text", heads.limit(0), "head").collect() == []


def test_plan_has_no_nested_loop(spark):
    if not DATA.exists():
        pytest.skip("the tables are not here")
    plan = QUERIES["align_fragments"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
