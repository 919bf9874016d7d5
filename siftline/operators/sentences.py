"""Sentence ends by what a corpus tells of its abbreviations, without marked text.

Spark counts, for each word of a language, how often it is written with a period
behind it and how often without.  A word that nearly always has one, is short, and
may have periods inside, is an abbreviation (the log-likelihood ratio of Kiss and
Strunk, 2006, with their factors).  A second count finds words that begin
sentences: those that follow a period which no abbreviation explains far more often
than chance would have it.  Numbers are one word; where they have a period more often
than words do, they are ordinals.
Texts are then cut in an Arrow function that gets both lists.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.segment import prose, units
from siftline.sources.shared import kept, small

# what runs in workers goes along by value: they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Ratios from which a word is an abbreviation, and one that begins sentences.
ABBREVIATION, STARTER = 0.3, 30.0
#: Words of both lists that are sent to tasks at most; more is an error.
MOST = 1_000_000

OPENERS, CLOSERS = "\"'(\\[{«»“”‘’„¿¡", "\"')\\]}»«”’“"
_END = re.compile(rf"[.!?…]+[{CLOSERS}]*(?=\s)")
_FRONT = re.compile(rf"[{OPENERS}]+")


def core(word: Column) -> Column:
    """A word without quotes, brackets and commas around; a number is #."""
    bare = F.regexp_replace(F.regexp_replace(word, rf"^[{OPENERS}]+", ""), rf"[{CLOSERS},;:]+$", "")
    return F.regexp_replace(bare, r"^\d+(?=\.?$)", "#")


def word_counts(df: DataFrame, by: str, text: str) -> DataFrame:
    """(by, raw, n): what stands between white space, as it is written, and how often."""
    return df.select(F.col(by).alias("by"), F.explode(F.split(F.col(text), r"\s+")).alias("raw")).filter("raw != ''").groupBy("by", "raw").agg(F.count(F.lit(1)).alias("n"))


def ratio(n: str, total: str, p0: str, p1: str) -> str:
    """-2 log of the likelihood of n of total by chance p0, over that by chance p1."""
    return f"-2 * (({n}) * ln(({p0}) / ({p1})) + (({total}) - ({n})) * ln((1 - ({p0})) / (1 - ({p1}))))"


def abbreviations(df: DataFrame, by: str, text: str, least: float = ABBREVIATION, counted: DataFrame | None = None) -> DataFrame:
    """(by, word, n, dotted, score): lower-case words with their counts, with and without period behind; those of at least ``least``.

    Counts are over all rows and are added up in tasks first, as words are
    written (``counted``, if they are known); only distinct ones are looked at.  Null texts have no words; a null
    language is one of its own.
    """
    words = (word_counts(df, by, text) if counted is None else counted).select("by", core(F.col("raw")).alias("w"), "n").filter("w != ''")
    words = words.select("by", F.lower(F.regexp_replace("w", r"\.$", "")).alias("word"), "n", F.when(F.col("w").endswith("."), F.col("n")).otherwise(0).alias("dot"))
    counts = words.groupBy("by", "word").agg(F.sum("n").alias("n"), F.sum("dot").alias("dotted"))
    totals = counts.groupBy(F.col("by").alias("tby")).agg(F.sum("n").alias("all_n"), F.sum("dotted").alias("all_dotted"))
    rows = counts.filter((F.col("dotted") > 0) & F.col("word").rlike(r"^(#|[\p{L}.]*\p{L}[\p{L}.]*)$")).join(totals, F.col("by").eqNullSafe(F.col("tby")))
    chance = "greatest(least(all_dotted / all_n, 0.98D), 1e-9D)"
    inner = "length(regexp_replace(word, '[^.]', ''))"
    letters = f"(length(word) - {inner})"
    score = f"({ratio('dotted', 'n', chance, '0.99D')}) * exp(-{letters}) * ({inner} + 1) * pow({letters}, dotted - n)"
    # numbers have no one spelling: they count as dotted where that is more often so than chance has it
    share = "greatest(least(dotted / n, 1 - 1e-9D), 1e-9D)"
    number = f"CASE WHEN dotted / n > {chance} THEN ({ratio('dotted', 'n', chance, share)}) / {STARTER} * {least} ELSE 0D END"
    return rows.withColumn("score", F.expr(f"CASE WHEN word = '#' THEN {number} ELSE {score} END")).filter(F.col("score") >= least).select(F.col("by").alias(by), "word", "n", "dotted", "score")


def starters(df: DataFrame, by: str, text: str, known: DataFrame, least: float = STARTER, counted: DataFrame | None = None) -> DataFrame:
    """(by, word, n, after, score): lower-case words that follow a sentence's end more often than chance has it.

    An end is a period behind a word that isn't one of the ``known``
    abbreviations, or an exclamation or question mark; the word that follows
    must begin with a capital letter.  Only pairs whose first word may end a sentence
    are counted.
    """
    marks = [*".!?…", *CLOSERS.replace("\\", "")]
    ws = df.select(F.col(by).alias("by"), F.split(F.col(text), r"\s+").alias("ws")).filter(F.size("ws") > 1)
    pairs = ws.select("by", F.explode(F.arrays_zip(F.slice("ws", 1, F.size("ws") - 1).alias("a"), F.slice("ws", 2, F.size("ws") - 1).alias("b"))).alias("x"))
    pairs = pairs.select("by", "x.a", "x.b").filter(F.substring("a", -1, 1).isin(*marks)).groupBy("by", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    bare = lambda c: F.regexp_replace(core(F.col(c)), r"[.!?…]+$", "")
    pairs = pairs.filter(core(F.col("a")).rlike(r"[.!?…]$")).select("by", F.lower(bare("a")).alias("front"), F.lower(bare("b")).alias("word"), core(F.col("b")).rlike(r"^\p{Lu}").alias("upper"), "n")
    listed = known.select(F.col(by).alias("kby"), F.col("word").alias("kword"))
    ends_ = pairs.join(small(listed), F.col("by").eqNullSafe(F.col("kby")) & (F.col("front") == F.col("kword")), "left_anti")
    after = ends_.groupBy(F.col("by").alias("aby"), F.col("word").alias("aword")).agg(F.sum(F.when(F.col("upper"), F.col("n")).otherwise(0)).alias("after"), F.sum("n").alias("ends"))
    after = kept(after, "after")  # read twice
    all_ends = after.groupBy(F.col("aby").alias("eby")).agg(F.sum("ends").alias("all_ends"))
    words = (word_counts(df, by, text) if counted is None else counted).select("by", F.lower(bare("raw")).alias("word"), "n").filter("word != ''").groupBy("by", "word").agg(F.sum("n").alias("n"))
    all_n = words.groupBy(F.col("by").alias("tby")).agg(F.sum("n").alias("all_n"))
    rows = words.join(after.filter("after > 0"), F.col("by").eqNullSafe(F.col("aby")) & (F.col("word") == F.col("aword"))).filter(F.col("word").rlike(r"^\p{L}+$"))
    rows = rows.join(all_ends, F.col("by").eqNullSafe(F.col("eby"))).join(all_n, F.col("by").eqNullSafe(F.col("tby")))
    # among the places behind an end: the word's share there against its share everywhere
    p0, p1 = "least(n / all_n, 0.999D)", "least(after / all_ends, 0.9999D)"
    return rows.filter("after / all_ends > n / all_n").withColumn("score", F.expr(ratio("after", "all_ends", p0, p1))).filter(F.col("score") >= least).select(F.col("by").alias(by), "word", "n", "after", "score")


def ends(text: str, short: set[str], first: set[str]) -> list[int]:
    """The places in a text, white space made single, behind which sentences end (not that of its own end)."""
    out = []
    for mark in _END.finditer(text):
        at = mark.end()
        front = _FRONT.match(text, at + 1)
        begin = front.end() if front else at + 1
        if begin >= len(text) or text[begin].islower():
            continue
        if text[mark.start()] == "." and mark.group().rstrip(CLOSERS) == ".":
            word = text[text.rfind(" ", 0, mark.start()) + 1 : mark.start()]
            word = _FRONT.sub("", word, count=1) if _FRONT.match(word) else word
            plain = "#" if word.isdigit() else word.lower()
            known = plain in short or (len(word) == 1 and word.isupper())
            if known:
                stop = text.find(" ", begin)
                following = text[begin : stop if stop >= 0 else len(text)].rstrip(".,;:!?…" + CLOSERS).lower()
                if following not in first:
                    continue
        out.append(at)
    return out


def cut(text: str, short: set[str], first: set[str]) -> list[str]:
    """The sentences of a text, white space made single."""
    text = " ".join(text.split())
    places = [0, *ends(text, short, first), len(text)]
    return [s for a, b in zip(places, places[1:], strict=False) if (s := text[a:b].strip())]


def listed(words: DataFrame, by: str) -> dict:
    """A list of words by language, on the driver: what tasks get."""
    if (n := words.count()) > MOST:
        raise ValueError(f"{n} words are more than the {MOST} that are sent to tasks")
    out: dict = {}
    for key, word in words.select(by, "word").collect():
        out.setdefault(key, set()).add(word)
    return out


def sentences(df: DataFrame, by: str, text: str, short: DataFrame, first: DataFrame, out: str = "sentences", markdown: bool = False) -> DataFrame:
    """Rows with the sentences of their text, by the abbreviations and first words of their language.

    With ``markdown`` the text is cut into blocks first, as ``segment`` does, and
    only paragraphs, quotes and HTML into sentences.
    """
    session = df.sparkSession.sparkContext
    lists = session.broadcast((listed(short, by), listed(first, by)))  # MOST words each at most

    @F.pandas_udf("array<string>")
    def run(languages: pd.Series, texts: pd.Series) -> pd.Series:
        a, b = lists.value
        none: set = set()

        def parts(k, t):
            own = lambda x: cut(x, a.get(k, none), b.get(k, none))
            return units(t, lambda x: prose(x, own)) if markdown else own(t)

        return pd.Series([parts(k, t) if t else [] for k, t in zip(languages.where(languages.notna(), None), texts, strict=True)], index=texts.index, dtype=object)

    return df.withColumn(out, run(F.col(by).cast("string"), F.col(text)))


def learned_sentences(df: DataFrame, by: str, text: str, out: str = "sentences") -> DataFrame:
    """Both lists learned from the rows themselves, and the rows cut by them."""
    df = df.withColumn(by, F.col(by).cast("string"))
    counted = kept(word_counts(df, by, text), "words")
    short = kept(abbreviations(df, by, text, counted=counted), "abbreviations")
    first = kept(starters(df, by, text, short, counted=counted), "starters")
    return sentences(df, by, text, short, first, out)
