"""Text functions as columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page furniture that is cut out of scraped bodies.
CHROME = (
    r"\[\s*edit\s*\]",
    r"\[\s*hide\s*\]",
    r"Contents\s*\[\s*hide\s*\]",
    r"From\s+Wikipedia,\s+the\s+free\s+encyclopedia",
    r"navigation\s+search",
    r"Jump\s+to:?\s+navigation",
    r"Retrieved\s+(\d{1,2}\s+\w+\s+\d{4}|on\s+\d{4}-\d{2}-\d{2})",
    r"All\s+rights\s+reserved\.?",
    r"Click\s+here",
    r"Privacy\s+Policy",
    r"Skip\s+to\s+(content|main)",
)
CHROME_PATTERN = "(?i)(" + "|".join(CHROME) + ")"
#: URL parts whose pages are never taken.
EXCLUDED_HOSTS = ("reddit.com", "facebook.com", "twitter.com", "x.com/", "youtube.com", "tiktok.com", "instagram.com", "linkedin.com")


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of a character in ASCII: pairs of single characters, and longer ones."""
    one, many = {}, {}
    for point in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= point < 0xE000:
            left = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
            if left:
                (one if len(left) == 1 else many)[chr(point)] = left
    return "".join(one), "".join(one.values()), many


@cache
def _ranges() -> str:
    """A pattern of few ranges that hold all characters of longer ASCII (and others): a class of single ones is slow."""
    points = sorted(map(ord, _folding()[2]))
    cuts = [0, *(i for i in range(1, len(points)) if points[i] - points[i - 1] > 8), len(points)]
    return "[" + "".join(f"\\x{{{points[a]:x}}}-\\x{{{points[b - 1]:x}}}" for a, b in zip(cuts, cuts[1:], strict=False)) + "]"


def folding() -> tuple[str, str, dict[str, str], str]:
    """What ``plain`` folds by: characters, what each becomes, those that become several, and a pattern that finds these."""
    return *_folding(), _ranges()


def strip(text: Column) -> Column:
    """Without white space at either end (trim alone takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_tags(html: Column) -> Column:
    """Without markup: tags go, white space at the ends too."""
    return strip(F.regexp_replace(html, "<[^>]+>", ""))


def strip_chrome(text: Column) -> Column:
    """Page furniture becomes a space, three or more line ends become two."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), CHROME_PATTERN, " ")
    return strip(F.regexp_replace(cut, "\\n{3,}", "\n\n"))


def plain(text: Column) -> Column:
    """Lower case of what compatibility decomposition leaves in ASCII (so straße is strae, ﬁ is fi)."""
    text = F.coalesce(text, F.lit(""))
    source, target, many = _folding()
    # ligatures and the like are rare: texts without one are translated character by character only
    several = F.map_from_arrays(F.split(F.lit("\n".join(many)), "\n"), F.split(F.lit("\n".join(many.values())), "\n"))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    wide = F.when(text.rlike(_ranges()), spelled).otherwise(text)
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(wide, source, target), r"[^\x00-\x7F]", "")).otherwise(text))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the plain text."""
    return F.regexp_extract_all(plain(text), F.lit("([a-z0-9]+)"), F.lit(1))


def sentences(text: Column) -> Column:
    """Units of prose: cut at line ends and after . ! ? before a space; blank ones dropped."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?]) ", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda u: F.trim(u)), lambda u: u != "")


def count_tokens(text: Column) -> Column:
    """The default token counter: words and single marks (no claim to any model's tokenizer)."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"))


def fragments(highlight: Column, least: int = 8) -> Column:
    """The parts between [...] marks, trimmed, of at least so many characters."""
    parts = F.transform(F.split(highlight, r"\[\s*\.\.\.\s*\]"), strip)
    return F.filter(parts, lambda x: F.length(x) >= least)


def chunks(content: Column) -> Column:
    """The parts between literal [...], trimmed, distinct in order of first appearance."""
    parts = F.transform(F.split(content, r"\[\.\.\.\]"), strip)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def shingles(words: Column, n: int = 5) -> Column:
    """Distinct n-grams as strings; fewer words are one shingle, none give none."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(hashes: str, n: int = 5) -> Column:
    """The windows of n words (fewer words: one, none: none) as structs of hash and place, from a column of the words' hashes."""
    window = ", ".join(f"{hashes}[i + {k}]" for k in range(n))
    short = f"aggregate({hashes}, bigint(size({hashes})), (s, x) -> xxhash64(s, x))"
    return F.expr(f"CASE WHEN size({hashes}) >= {n} THEN transform(sequence(0, size({hashes}) - {n}), i -> struct(xxhash64({window}) AS h, i AS i)) WHEN size({hashes}) > 0 THEN array(struct({short} AS h, 0 AS i)) ELSE array() END")


def excluded(url: Column) -> Column:
    """Whether the lower-cased URL contains an excluded part (a part, not a host: netflix.com/ has x.com/)."""
    low = F.lower(F.coalesce(url, F.lit("")))
    hit = F.lit(False)
    for part in EXCLUDED_HOSTS:
        hit = hit | F.contains(low, F.lit(part))
    return hit


def fraction(key: Column) -> Column:
    """A number in [0, 1) that follows from the key alone: the first 32 bits of its SHA-1."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / 4294967296.0
