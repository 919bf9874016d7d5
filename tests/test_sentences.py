"""Learned sentence ends: recall and precision on marked text in four languages, and the counts against plain Python."""

import math
import random
import re

import pytest

from siftline.operators import sentences as s

# Marked fixtures: parts of sentences (words between bars are drawn), a sentence a line; abbreviations inside and at the end.
WORDS = {
    "en": ("Dr. Mr. Prof. e.g. etc. approx. No. vs.", "garden river market letter winter doctor bridge answer", "The We It They In But This"),
    "de": ("Dr. Hr. z.B. usw. ca. Nr. bzw. u.a.", "Garten Fluss Markt Brief Winter Arzt Brücke Antwort", "Der Wir Es Sie In Aber Das"),
    "fr": ("M. Mme. p.ex. etc. env. av. Dr. cf.", "jardin fleuve marché lettre hiver docteur pont réponse", "Le Nous Il Elle Dans Mais Ce"),
    "es": ("Sr. Sra. p.ej. etc. aprox. Dr. núm. pág.", "jardín río mercado carta invierno médico puente respuesta", "El Nosotros Ella Ellos En Pero Este"),
}
NAMES = "Weber Adams Moreau Alonso Keller Osborne Lambert Ortega".split()


def sentence(r, lang, more):
    abbreviations, nouns, firsts = (x.split() for x in WORDS[lang])
    words = [r.choice(firsts)]
    for _ in range(r.randint(3, 9)):
        kind = r.random()
        if kind < 0.12:
            words += [r.choice(abbreviations), r.choice([*NAMES, more])]
        elif kind < 0.2 and lang == "de":
            words += [f"{r.randint(1, 31)}.", r.choice(["Oktober", "Mai", "Juni"])]
        elif kind < 0.25:
            words += [f"{r.choice('ABJK')}.", r.choice(NAMES)]
        elif kind < 0.3:
            words.append(f"{r.randint(2, 99)}")
        elif kind < 0.35:
            words.append(f"{r.randint(1, 9)}.{r.randint(1, 99)}")
        else:
            words.append(r.choice(nouns))
    if r.random() < 0.1 and len(words) > 2:
        words[2] = f'({words[2]}"'
    last = r.choice([*nouns, more])
    return " ".join([*words, last]) + r.choice([".", ".", ".", ".", "!", "?", '."', ".)"])


def corpus(lang, seed, n, more):
    r = random.Random(f"{lang}{seed}")
    return [[sentence(r, lang, more) for _ in range(r.randint(1, 30))] for _ in range(n)]


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(lang, " ".join(d)) for lang in WORDS for d in corpus(lang, 1, 80, "Haus")] + [(None, "no language here."), ("en", None), ("en", ""), ("zz", "one. Two")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    short = s.abbreviations(df, "lang", "text")
    return rows, df, short, s.starters(df, "lang", "text", short)


def test_recall_and_precision(spark, learned):
    _, _, short, first = learned
    rows, want = [], {}
    for lang in WORDS:
        for k, d in enumerate(corpus(lang, 2, 40, "Berg")):  # drawn anew, with a word never seen
            rows.append((f"{lang}{k}", lang, "  ".join(d).replace(" ", "\n", 1)))
            want[rows[-1][0]] = d
    df = spark.createDataFrame(rows, "k string, lang string, text string").repartition(3)
    found = {r.k: r.sentences for r in s.sentences(df, "lang", "text", short, first).collect()}
    for lang in WORDS:
        marked = {(k, len(" ".join(d[: i + 1]))) for k, d in want.items() if k[:2] == lang for i in range(len(d) - 1)}
        got = {(k, len(" ".join(d[: i + 1]))) for k, d in found.items() if k[:2] == lang for i in range(len(d) - 1)}
        recall, precision = len(got & marked) / len(marked), len(got & marked) / len(got)
        print(lang, round(recall, 4), round(precision, 4))
        assert recall >= 0.97 and precision >= 0.97, (lang, recall, precision)
        pattern = {(k, m.start()) for k, _, t in rows if k[:2] == lang for m in re.finditer(r"(?<=[.!?]) ", " ".join(t.split()))}
        assert len(pattern & marked) / len(pattern) < precision - 0.05, "what a pattern alone does"


def test_counts_equal_brute_force(learned):
    rows, _, short, _ = learned
    counts, total, dots = {}, {}, {}
    for lang, text in rows:
        for w in (text or "").split():
            w = re.sub(r"^\d+(?=\.?$)", "#", re.sub(rf"[{s.CLOSERS},;:]+$", "", re.sub(rf"^[{s.OPENERS}]+", "", w)))
            if w:
                key = (lang, re.sub(r"\.$", "", w).lower())
                n, d = counts.get(key, (0, 0))
                counts[key] = n + 1, d + w.endswith(".")
                total[lang], dots[lang] = total.get(lang, 0) + 1, dots.get(lang, 0) + w.endswith(".")
    want = {}
    for (lang, w), (n, d) in counts.items():
        if d and re.fullmatch(r"#|[^\W\d_.]*(?:\.?[^\W\d_]+)+\.*", w):
            p, inner = max(min(dots[lang] / total[lang], 0.98), 1e-9), w.count(".")
            score = -2 * (d * math.log(p / 0.99) + (n - d) * math.log((1 - p) / (1 - 0.99)))
            if w == "#":
                x = min(d / n, 1 - 1e-9)
                score = -2 * (d * math.log(p / x) + (n - d) * math.log((1 - p) / (1 - x))) / s.STARTER * s.ABBREVIATION if d / n > p else 0
                if score >= s.ABBREVIATION:
                    want[lang, w] = (n, d, pytest.approx(score, rel=1e-9))
                continue
            score *= math.exp(-(len(w) - inner)) * (inner + 1) * float(len(w) - inner) ** (d - n)
            if score >= s.ABBREVIATION:
                want[lang, w] = (n, d, pytest.approx(score, rel=1e-9))
    assert {(r.lang, r.word): (r.n, r.dotted, r.score) for r in short.collect()} == want
    assert {"dr", "z.b", "#"} <= {w for k, w in want if k == "de"} and "#" not in {w for k, w in want if k == "en"}


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, "en", None), (2, "en", ""), (3, None, "Alpha betas. Gamma deltas."), (4, "en", "word " * 200_000), (5, "en", "." * 1000 + " X"), (6, "en", "a.b. c? D!E. f")], "k int, lang string, text string")
    got = {r.k: r.sentences for r in s.learned_sentences(df, "lang", "text").collect()}
    assert got[1] == [] and got[2] == [] and got[3] == ["Alpha betas.", "Gamma deltas."] and len(got[4]) == 1 and got[5] == ["." * 1000, "X"] and got[6] == ["a.b. c?", "D!E. f"]
    assert s.learned_sentences(df.limit(0), "lang", "text").collect() == []


def test_markdown_with_learned_ends(spark, learned):
    _, _, short, first = learned
    text = "# Dr. Weber. No prose\n\nWe met Dr. Weber at the river. They saw the garden.\n- Dr. A. One. Two\n  more\n\n> We go. It\nends."
    df = spark.createDataFrame([("en", text)], "lang string, text string")
    got = s.sentences(df, "lang", "text", short, first, markdown=True).first().sentences
    assert got == ["# Dr. Weber. No prose", "We met Dr. Weber at the river.", "They saw the garden.", "- Dr. A. One. Two\n  more", "We go.", "It ends."]
