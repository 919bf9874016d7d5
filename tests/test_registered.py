"""parse_label_json and split_block_lines against plain Python."""

import hashlib
import json
import re

from siftline.plans.catalog import QUERIES


def test_parse_label_json(spark, tmp_path):
    ks = [7, 60, 3, 0, 49, 12, 5, 50, 1, 2, 33, 8, 9, 10, 11]
    spark.createDataFrame([(i, json.dumps({"k": k})) for i, k in enumerate(ks)], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.ids, r.status) for r in QUERIES["parse_label_json"](spark, str(tmp_path)).collect()}
    want = {}
    for i, k in enumerate(ks):
        raw = (f'{{"relevant_unit_ids": [{k}, 3, 1]}}', f"[{k}, {k}]", "[]", f'"{k}"', f"[{k}")[i % 5]
        if i % 7 == 0:
            want[i] = (None, "error:truncated")
            continue
        try:
            x = json.loads(raw)
        except json.JSONDecodeError:
            want[i] = (None, "error:invalid_json")
            continue
        x = x.get("relevant_unit_ids") if isinstance(x, dict) else x
        want[i] = (",".join(map(str, sorted({j for j in x if 0 <= j < 50}))), "ok") if isinstance(x, list) else (None, "error:schema_shape")
    assert got == want


def test_split_block_lines(spark, tmp_path):
    long_ = "\n".join(f"row {i} | a, b" for i in range(150))
    one = "word " * 700
    texts = ["short\ntext", long_, one + "\n" + long_, "", None, "x\n" * 500, "x\n" * 501]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_parts, r.digest) for r in QUERIES["split_block_lines"](spark, str(tmp_path)).collect()}
    n = lambda s: len(re.findall(r"\w+|[^\w\s]", s))
    for i, s in enumerate(texts):
        s = (s or "").strip()
        parts, held = [], []
        for line in s.split("\n") if n(s) > 500 else []:
            if held and sum(map(n, held)) + n(line) > 400:
                parts.append("\n".join(held))
                held = []
            held.append(line)
        parts = [*parts, "\n".join(held)] if held else [s] if s else []
        assert got[i] == (len(parts), hashlib.sha1("\0".join(parts).encode()).hexdigest())
    assert got[1][0] == 3 and got[2][0] > 3 and got[5][0] == 1 and got[6][0] == 2
