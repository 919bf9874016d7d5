"""Labels of tokens by their units: in a row, across tables, and the query."""

import random

from pyspark.sql import functions as F

from siftline.operators import compression, windows
from siftline.plans import catalog, catalog_stages  # noqa: F401


def brute(points, units, relevant):
    def label(a, b):
        for i, (c, d) in enumerate(units):
            if None not in (a, b, c, d) and c <= (a + b) // 2 < d:
                return i, int(relevant[i])
        return -1, -100

    return [label(a, b) for a, b in points]


def cases():
    r = random.Random(5)
    out = [([], [], []), ([(0, 4), (None, 3), (2, None)], [], []), ([(0, 0), (3, 3), (9, 9), (1, None)], [(3, 3), (0, 3), (4, None), (None, 9), (3, 4)], [True, False, True, True, True]), ([(65530, 65540), (140000, 140001)], [(0, 140001)], [True])]
    for _ in range(60):
        cuts = sorted(r.sample(range(60), 2 * r.randrange(8)))
        units = list(zip(cuts[::2], cuts[1::2], strict=True)) + [(x, x) for x in r.sample(range(60), r.randrange(3))]
        r.shuffle(units)
        points = [(a, a + r.randrange(6)) for a in (r.randrange(64) for _ in range(r.randrange(30)))]
        out.append((points, units, [r.random() < 0.5 for _ in units]))
    return out


def test_in_rows_and_across_tables_equal_brute_force(spark):
    want = [brute(*c) for c in cases()]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases())], "id int, points array<struct<start: long, end: long>>, units array<struct<start: long, end: long>>, relevant array<boolean>").repartition(3)
    labels = df.withColumn("labels", windows.span_labels(F.col("points"), F.col("units"), F.col("relevant")))
    assert {r.id: r.labels for r in labels.collect()} == {i: [x for _, x in w] for i, w in enumerate(want)}
    tokens = df.select("id", F.posexplode("points").alias("k", "p")).select("id", "k", F.col("p.start").alias("start"), F.col("p.end").alias("stop"))
    units = df.select("id", F.posexplode("units").alias("unit_id", "u"), "relevant").select("id", "unit_id", F.col("u.start").alias("unit_start"), F.col("u.end").alias("unit_end"), F.col("relevant")[F.col("unit_id")].alias("relevant"))
    got = compression.token_labels(tokens, units, "id")
    assert got.columns == ["id", "k", "start", "stop", "unit_id", "label"]
    assert sorted((r.id, r.k, r.unit_id, r.label) for r in got.collect()) == [(i, k, *x) for i, w in enumerate(want) for k, x in enumerate(w)]
    assert got._jdf.queryExecution().toString().count("Join") == 0


def test_null_arrays_and_keys(spark):
    span = "array<struct<start: long, end: long>>"
    df = spark.createDataFrame([(0, None, None, None), (1, [(0, 2)], None, None), (2, None, [(0, 2)], [True]), (3, [(0, 2)], [(0, 2)], [None])], f"id int, p {span}, u {span}, r array<boolean>")
    got = {r.id: r.x for r in df.select("id", windows.span_labels(F.col("p"), F.col("u"), F.col("r")).alias("x")).collect()}
    assert got == {0: [], 1: [-100], 2: [], 3: [-100]}
    tokens = spark.createDataFrame([(None, 0, 0, 2), (1, 0, 0, 2)], "id int, k int, start int, stop int")
    units = spark.createDataFrame([(None, 0, 0, 2, True), (1, 0, 0, 2, True)], "id int, unit_id int, unit_start int, unit_end int, relevant boolean")
    assert {r.id: (r.unit_id, r.label) for r in compression.token_labels(tokens, units, "id").collect()} == {None: (-1, -100), 1: (0, 1)}


def test_query_shuffles_counts_alone(spark, tmp_path):
    texts = {1: "One two. Three four five! Six", 2: "a  b. c", 3: "", 4: None, None: "x y. z", 5: " . ".join(["w w w"] * 40)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.QUERIES["label_expansion"](spark, str(tmp_path))
    got = {r.doc_id: (r.positive, r.negative, r.outside) for r in df.collect()}
    want = {}
    for key, s in texts.items():
        units = [u.strip(" ") for u in (s or "").replace(". ", ".\n").replace("! ", "!\n").split("\n")]
        words = [(i, w) for i, u in enumerate(u for u in units if u) for w in u.split(" ")]
        want[key] = (0, 0, max(1, len(words))) if key is None or not words else (sum(i % 3 == 0 for i, _ in words), sum(i % 3 != 0 for i, _ in words), 0)
    # an empty word in a unit lies between two spaces, which is inside of the unit
    assert got == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    # no row for a word, nothing looked up
    assert not any(x in plan for x in ("Join", "Window", "Generate"))
