"""Quality rules on DataFrame functions alone.

Base rules count words, symbols, repeated lines and repeated three-word
windows.  A document that passes them is kept by its hashed n-gram
log-likelihood ratio: single words and word pairs fall into BUCKETS buckets;
a multinomial over the buckets is estimated for trusted documents and one for
the whole raw corpus; a document's score is the mean over its n-grams of the
log ratio of the two, and it is kept if the score is not below a fixed
threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: At most so many trusted documents are read, those with the least hash of their id.
TRUSTED = 20_000
THRESHOLD = -0.15
WORDS, REPEATED = 50, 50

_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09 to \\x0D."""
    return F.array_remove(F.split(text, _SPACE), "")


def hashes_of(words: str) -> Column:
    """The hash of every word; longer n-grams hash these."""
    return F.expr(f"transform({words}, w -> xxhash64(w))")


def free_prefix(df: DataFrame) -> str:
    """What no column of ``df`` begins with."""
    out = "_q"
    while any(c.lower().startswith(out) for c in df.columns):
        out = "_" + out
    return out


def _repeats(df: DataFrame, p: str) -> DataFrame:
    """Adds n_repeat_words from the hashes: words in three-word windows that occur twice or more.

    Windows are hashed.  Where any repeats they are sorted by hash and
    position; equal neighbours repeat.  The union of the windows is summed
    over their sorted positions.  Each step is a column of its own so that no
    lambda computes an array again for every element.
    """
    h, w, s, at = f"{p}_hashes", f"{p}_windows", f"{p}_sorted", f"{p}_at"
    df = df.withColumn(w, F.expr(f"CASE WHEN size({h}) < 3 THEN array() ELSE transform(sequence(0, size({h}) - 3), i -> xxhash64({h}[i], {h}[i + 1], {h}[i + 2])) END"))
    df = df.withColumn(s, F.expr(f"CASE WHEN size(array_distinct({w})) < size({w}) THEN sort_array(transform({w}, (x, i) -> struct(x AS x, i AS i))) ELSE array() END"))
    df = df.withColumn(
        at,
        F.expr(
            f"sort_array(transform(filter({s}, (y, j) -> (j > 0 AND y.x = get({s}, j - 1).x) OR (j + 1 < size({s}) AND y.x = get({s}, j + 1).x)), y -> y.i))"
        ),
    )
    return df.withColumn(
        "n_repeat_words",
        F.expr(f"CASE WHEN size({at}) = 0 THEN 0L WHEN size({at}) = 1 THEN 3L ELSE 3L + aggregate(sequence(1, size({at}) - 1), 0L, (n, j) -> n + least(3L, {at}[j] - {at}[j - 1])) END"),
    ).drop(w, s, at)


def base_rules(df: DataFrame, text_col: str = "text", *, hashes: str | None = None) -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    A null text has no words.  Columns named as a result are replaced, all
    others stay; ``hashes`` names a column for the hashes of the words, if
    they are wanted.  Rows are neither dropped nor moved.
    """
    p = free_prefix(df)
    t, w, l = f"{p}_text", f"{p}_words", f"{p}_lines"
    df = df.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(w, words_of(F.col(t)))
    df = df.withColumn(f"{p}_hashes", hashes_of(w))
    df = df.withColumn(l, F.expr(rf"filter(split({t}, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumn("n_words", F.size(w).cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size(l) - F.size(F.array_distinct(l))).cast("long"))
    df = _repeats(df, p)
    failed = (F.col("n_words") < WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    df = df.withColumnRenamed(f"{p}_hashes", hashes) if hashes else df.drop(f"{p}_hashes")
    return df.drop(t, w, l)


def grams(hashes: str, buckets: int = BUCKETS) -> Column:
    """The buckets of all single words and all pairs of neighbours, as an array."""
    return F.expr(
        f"concat(transform({hashes}, h -> int(pmod(h, {buckets}))), "
        f"CASE WHEN size({hashes}) < 2 THEN array() ELSE transform(sequence(0, size({hashes}) - 2), i -> int(pmod(xxhash64({hashes}[i], {hashes}[i + 1]), {buckets}))) END)"
    )


def log_ratios(df: DataFrame, labels: DataFrame, *, trusted: int = TRUSTED, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The log ratio of every bucket, an array as a scalar subquery.

    The raw multinomial is counted over all rows; the target over at most
    ``trusted`` rows whose label is quality 1 and toxic 0.  One is added to
    every bucket of either.  Without trusted rows the ratio is 0 everywhere.
    """
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted).withColumn("_good", F.lit(True))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    marked = rows.join(F.broadcast(chosen), "doc_id", "left")
    counted = (
        marked.select(words_of(F.col("text")).alias("_w"), F.expr("int(ifnull(_good, false))").alias("_good"))
        .select(hashes_of("_w").alias("_h"), "_good")
        .select(F.explode(grams("_h", buckets)).alias("bucket"), "_good")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("_good").cast("long").alias("good"))
    )
    weight = (
        f"CASE WHEN good > 0 THEN transform(sequence(0, {buckets - 1}), b -> ln((ifnull(counts[b].good, 0) + 1D) / (good + {buckets})) - ln((ifnull(counts[b].raw, 0) + 1D) / (raw + {buckets}))) "
        f"ELSE array_repeat(0D, {buckets}) END AS w"
    )
    # counts by bucket as an array of fixed size, in the order of the buckets
    filled = (
        df.sparkSession.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(counted, "bucket", "left")
        .agg(
            F.sum("raw").alias("raw"),
            F.sum("good").alias("good"),
            F.expr("transform(array_sort(collect_list(struct(bucket, raw, good))), x -> struct(x.raw AS raw, x.good AS good)) AS counts"),
        )
    )
    return filled.selectExpr(weight).scalar()


def score(df: DataFrame, ratios: Column, hashes: str, out: str = "llr") -> DataFrame:
    """Adds the mean log ratio of the n-grams, 0 where there is none."""
    p = free_prefix(df)
    df = df.withColumn(f"{p}_grams", grams(hashes)).withColumn(f"{p}_ratios", ratios)
    mean = F.expr(f"CASE WHEN size({p}_grams) = 0 THEN 0D ELSE aggregate({p}_grams, 0D, (s, b) -> s + {p}_ratios[b]) / size({p}_grams) END")
    return df.withColumn(out, mean).drop(f"{p}_grams", f"{p}_ratios")


def judge(df: DataFrame, labels: DataFrame, *, corpus: DataFrame | None = None, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row with the base counts, base_failed, llr and kept.

    Statistics are of ``corpus`` (all rows of ``df`` if none).  Null and empty
    texts fail the base rules.  Repeated rows are each judged, columns of
    ``df`` named as a result are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    ratios = log_ratios(corpus if corpus is not None else df, labels, id_col=id_col, text_col=text_col)
    rows = df.drop(*names)
    hashes = f"{free_prefix(rows)}_of_words"
    out = score(base_rules(rows, text_col, hashes=hashes), ratios, hashes)
    # A filter on kept must not be pushed below: the steps would be written into it,
    # and arrays computed anew for each element.  The id is never negative; an
    # expression that isn't deterministic is left where it is.
    stays = F.monotonically_increasing_id() >= 0
    return out.withColumn("kept", stays & ~F.col("base_failed") & (F.col("llr") >= threshold)).drop(hashes)
