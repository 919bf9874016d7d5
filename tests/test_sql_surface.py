"""The registered functions against the column functions, and the table functions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import ids, segment, sql, text
from siftline.operators import compression

LETTERS = "aB9 .!?\n\t'\\\"éÅßﬁ½Ⅷ漢😀ſ_-"


@pytest.fixture
def rows(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choices(LETTERS, k=rnd.randrange(80))) for _ in range(300)] + ["", None, " ", "no. One", "it's \\n"]
    return sql.register(sql.register(spark)).createDataFrame([(i, s, rnd.choice(texts)) for i, s in enumerate(texts)], "id int, text string, query string")


def test_functions_equal_the_column_functions(rows):
    own = compression.lexical_scores(rows.withColumn("units", text.sentences(F.col("text"))))
    own = own.withColumn("kept", F.filter(F.transform("scores", lambda s, i: F.when(s >= 0.4, i).otherwise(-1)), lambda i: i >= 0))
    own = own.select("id", text.plain(F.col("text")), text.tokens(F.col("text")), text.count_tokens(F.col("text")), "units", "scores", "kept", ids.render(F.col("units"), F.col("kept")), ids.ratio(F.col("units"), F.col("kept")))
    query = """WITH u AS (SELECT *, sift_sentences(text) AS units, array_distinct(sift_tokens(query)) AS words FROM {rows}),
    s AS (SELECT *, sift_scores(words, sift_tokens_each(units)) AS scores FROM u), k AS (SELECT *, sift_kept(scores, 0.4D) AS kept FROM s)
    SELECT id, sift_plain(text), sift_tokens(text), sift_token_count(text), units, scores, kept, sift_render(units, kept), sift_ratio(units, kept) FROM k"""
    got = rows.sparkSession.sql(query, rows=rows)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, own.collect()), key=lambda r: r[0])


def test_segment_gives_the_units_as_rows(rows):
    got = rows.sparkSession.sql("SELECT r.id, s.* FROM {rows} r, LATERAL sift_segment(r.text) s", rows=rows).collect()
    want = {(r.id, i, u) for r in rows.collect() for i, u in enumerate(segment.units(r.text))}
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_budget_passes_over_what_does_not_fit(rows):
    rnd = random.Random(3)
    items = [(rnd.randrange(5), i, rnd.choice([None, 0, 1, 5, 9, 30]), "x") for i in range(200)]
    rows.sparkSession.createDataFrame(items, "g int, i int, cost int, other string").createOrReplaceTempView("items_of_test")
    got = rows.sparkSession.sql("SELECT * FROM sift_budget(TABLE (items_of_test) PARTITION BY (g) ORDER BY (i DESC), 40)").collect()
    want = set()
    for g in range(5):
        used = 0
        for item in sorted((x for x in items if x[0] == g), key=lambda x: -x[1]):
            if used + (item[2] or 0) <= 40:
                used += item[2] or 0
                want.add(item)
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert rows.sparkSession.sql("SELECT * FROM sift_budget(TABLE (SELECT * FROM items_of_test WHERE g > 9) PARTITION BY (g), 40)").count() == 0
    assert rows.sparkSession.sql("SELECT * FROM sift_budget(TABLE (items_of_test) PARTITION BY (g), CAST(NULL AS INT))").count() == 0
    with pytest.raises(Exception, match="column named cost"):
        rows.sparkSession.sql("SELECT * FROM sift_budget(TABLE (SELECT g FROM items_of_test), 40)").count()
