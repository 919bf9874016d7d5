"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces; each language has a probability
for each piece.  The likelihood of a run of letters is the sum over all ways
to cut it into pieces of the product of their probabilities, found by the
forward algorithm; a text's is the product over its runs.  The probabilities
are fitted by expectation maximisation with the same sums.

The vocabulary is never trained.  What is fitted: a bounded sample of labelled
documents, SAMPLE of each language, those with the least hash of their id.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.arrow import map_arrow, text_slices
from siftline.llm.segments import CutTable, mix
from siftline.llm.vocab import read_ranks

SAMPLE = 300
#: Runs of more bytes are summed place by place, not many runs of a length at once; the sums are the same.
LONG = 256
_WORDS = re.compile(r"[^\W\d_]+")  # letters, and numbers that aren't digits, such as \u00bd
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs(text: str) -> list[bytes]:
    """The lower-cased runs of letters (category L), each with a space in front."""
    found = _WORDS.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = [part for run in found for part in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split(" ")) if part]
    return [b" " + run.encode() for run in found]


@dataclass
class Pieces:
    """The pieces of a vocabulary as a sorted table of the hashes of all their prefixes."""

    prefixes: np.ndarray
    piece: np.ndarray  # the piece that a prefix is, or the number of pieces
    size: int

    @classmethod
    def of(cls, tokens) -> Pieces:
        kept = sorted({t for t in tokens if t} | {bytes([b]) for b in range(256)})
        hashes, found = [], []
        rows, value = np.arange(len(kept)), np.zeros(len(kept), np.uint64)
        lengths = np.array(list(map(len, kept)))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(kept), np.uint8)
        for k in range(int(lengths.max())):
            rows = rows[lengths[rows] > k]
            value[rows] = longer(value[rows], raw[ends[rows] - lengths[rows] + k])
            hashes.append(value[rows].copy())
            found.append(np.where(lengths[rows] == k + 1, rows, len(kept)))
        hashes, found = np.concatenate(hashes), np.concatenate(found)
        order = np.lexsort((found, hashes))  # where a prefix is a piece, that comes first
        prefixes, first = np.unique(hashes[order], return_index=True)
        return cls(prefixes, found[order][first], len(kept))

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are of a prefix, and their piece (the number of pieces where they are none)."""
        at = np.minimum(np.searchsorted(self.prefixes, values), len(self.prefixes) - 1)
        known = self.prefixes[at] == values
        return known, np.where(known, self.piece[at], self.size)


def longer(values: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The hash of a string that goes on with a byte."""
    return mix(values * _STEP + byte.astype(np.uint64) + np.uint64(1))


def lattice(pieces: Pieces, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, words, their piece) for all spans that are pieces; words: a row of bytes each, of one length."""
    count, n = words.shape
    spans = []
    for start in range(n):
        rows, values = np.arange(count), np.zeros(count, np.uint64)
        for stop in range(start + 1, n + 1):
            values = longer(values, words[rows, stop - 1])
            known, piece = pieces.find(values)
            rows, values, piece = rows[known], values[known], piece[known]
            if not len(rows):
                break
            whole = piece < pieces.size
            if whole.any():
                spans.append((start, stop, rows[whole], piece[whole]))
    return spans


def chain(pieces: Pieces, word: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place of one word where its pieces from there end, and which they are."""
    raw = np.frombuffer(word, np.uint8)
    starts, values = np.arange(len(raw)), np.zeros(len(raw), np.uint64)
    begins, ends, found = [], [], []
    length = 0
    while len(starts):
        inside = starts + length < len(raw)
        starts, values = starts[inside], values[inside]
        values = longer(values, raw[starts + length])
        known, piece = pieces.find(values)
        starts, values, piece = starts[known], values[known], piece[known]
        length += 1
        whole = piece < pieces.size
        begins.append(starts[whole])
        ends.append(starts[whole] + length)
        found.append(piece[whole])
    begins, ends, found = np.concatenate(begins), np.concatenate(ends), np.concatenate(found)
    order = np.argsort(begins, kind="stable")
    cuts = np.searchsorted(begins[order], np.arange(1, len(raw)))
    return list(zip(np.split(ends[order], cuts), np.split(found[order], cuts), strict=True))


def by_length(words: list[bytes], most: int = 20_000):
    """(indices, matrix of bytes) for words of equal length up to LONG, in blocks."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths[lengths <= LONG]):
        members = np.flatnonzero(lengths == n)
        for at in range(0, len(members), most):
            part = members[at : at + most]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)


def forward(spans, count: int, n: int, logs: np.ndarray) -> np.ndarray:
    """alpha[j]: the log of the sum over segmentations of the first j bytes; [n + 1, words, languages]."""
    alpha = np.full((n + 1, count, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for start, stop, rows, piece in spans:  # ascending starts: alpha[start] is complete
        alpha[stop, rows] = np.logaddexp(alpha[stop, rows], alpha[start, rows] + logs[piece])
    return alpha


def forward_long(edges, logs: np.ndarray) -> np.ndarray:
    """forward of one word."""
    alpha = np.full((len(edges) + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for start, (stops, piece) in enumerate(edges):  # no two pieces from a place have one end
        alpha[stops] = np.logaddexp(alpha[stops], alpha[start] + logs[piece])
    return alpha


def fit(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = 3, smoothing: float = 0.05) -> np.ndarray:
    """Log probabilities of pieces [pieces, languages] from word counts [words, languages].

    Starts from how often each piece is a substring; every round replaces that
    by its expected use over all segmentations.
    """
    size, languages = pieces.size, counts.shape[1]
    blocks = [(part, matrix.shape[1], lattice(pieces, matrix)) for part, matrix in by_length(words)]
    lone = [(i, chain(pieces, w)) for i, w in enumerate(words) if len(w) > LONG]
    expected = np.zeros((size, languages))

    def add(found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        if found:
            piece, used = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            for k in range(languages):
                expected[:, k] += np.bincount(piece, used[:, k], size)

    for part, _, spans in blocks:
        add([(piece, counts[part[rows]]) for _, _, rows, piece in spans])
    for i, edges in lone:
        piece = np.concatenate([e[1] for e in edges])
        add([(piece, np.broadcast_to(counts[i], (len(piece), languages)))])
    for _ in range(rounds):
        logs = _normal(expected, smoothing)
        expected = np.zeros((size, languages))
        for part, n, spans in blocks:
            alpha = forward(spans, len(part), n, logs)
            beta = np.full_like(alpha, -np.inf)
            beta[n] = 0
            for start, stop, rows, piece in reversed(spans):
                beta[start, rows] = np.logaddexp(beta[start, rows], beta[stop, rows] + logs[piece])
            add([(piece, np.exp(alpha[start, rows] + logs[piece] + beta[stop, rows] - alpha[n, rows]) * counts[part[rows]]) for start, stop, rows, piece in spans])
        for i, edges in lone:
            alpha = forward_long(edges, logs)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for start in range(len(edges) - 1, -1, -1):
                stops, piece = edges[start]
                beta[start] = np.logaddexp.reduce(beta[stops] + logs[piece], 0)
            add([(piece, np.exp(alpha[start] + logs[piece] + beta[stops] - alpha[-1]) * counts[i]) for start, (stops, piece) in enumerate(edges)])
    return _normal(expected, smoothing)


def _normal(expected: np.ndarray, smoothing: float) -> np.ndarray:
    kept = expected + smoothing
    return np.log(kept / kept.sum(0))


def letters_of(words: list[bytes]) -> np.ndarray:
    return np.array([len(w.decode().lstrip(" ")) for w in words], np.float64)


@dataclass
class Model:
    """Languages, pieces and probabilities; scores texts of a UTF-8 buffer."""

    languages: list[str]
    pieces: Pieces
    logs: np.ndarray
    typical: np.ndarray | None = None  # log-likelihood of a letter in what was learned, by language
    key: str = ""
    table: CutTable | None = field(default=None, repr=False)

    def __post_init__(self):
        self.key = self.key or hashlib.sha1(repr(self.languages).encode() + self.pieces.prefixes.tobytes() + self.logs.tobytes()).hexdigest()

    def log_likelihoods(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for part, matrix in by_length(words):
            n = matrix.shape[1]
            out[part] = forward(lattice(self.pieces, matrix), len(part), n, self.logs)[n]
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = forward_long(chain(self.pieces, word), self.logs)[-1]
        return out

    def _cuts(self, cuts: list[str], _first: list[bool]) -> list[np.ndarray]:
        """For each cut the log-likelihoods of its letters and their number."""
        found = list(map(runs, cuts))
        words = list(dict.fromkeys(w for f in found for w in f))
        at = {w: i for i, w in enumerate(words)}
        rows = np.concatenate((self.log_likelihoods(words), letters_of(words)[:, None]), 1)
        none = np.zeros(len(self.languages) + 1)
        return [rows[at[f[0]]] if len(f) == 1 else sum((rows[at[w]] for w in f), none) for f in found]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document the index of its language (-1: no letter), the score, and how likely its letters are.

        The score is the language's share of the likelihoods of all languages.
        The last is the log-likelihood of a letter in relation to that of what
        was learned of the language: about 1 for its own prose, more for what
        is less like it.
        """
        width = len(self.languages) + 1
        if self.table is None:
            self.table = CutTable(self._cuts, np.float64, 400_000)
        values, bounds = self.table(data, offsets)
        sums = np.zeros((len(bounds) - 1, width))
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(filled):
            sums[filled] = np.add.reduceat(values.reshape(-1, width), bounds[filled] // width, 0)
        letters, logs = sums[:, -1], sums[:, :-1]
        if width == 1:
            return np.full(len(sums), -1), np.zeros(len(sums)), np.zeros(len(sums))
        best = logs.argmax(1)
        odds = np.exp(logs - logs.max(1)[:, None])
        score = odds.max(1) / odds.sum(1)
        strange = logs.max(1) / np.maximum(letters, 1) / (self.typical[best] if self.typical is not None else -1.0)
        some = letters > 0
        return np.where(some, best, -1), np.where(some, score, 0.0), np.where(some, strange, 0.0)


def train(df: DataFrame, path: str, *, learn: str | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of the rows with text, language and id for which ``learn`` holds.

    Reads ids and languages of all rows, and the texts of at most ``sample``
    rows a language (a row whose id repeats counts once for each).  Rows are
    taken in the order of a hash of their id, equal hashes in that of the id;
    rows with null text, language or id are not learned from, and an empty
    table gives a model of no language.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("id is not null and text is not null and lang is not null")
    if learn:
        rows = rows.filter(learn)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).select("id").distinct()
    # bounded: so many ids for each language
    taken = rows.join(F.broadcast(chosen), "id", "left_semi")

    def words(batches):
        for batch in batches:
            count: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                count.update((lang, w) for w in runs(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.binary()), pa.array(list(count.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    found = map_arrow(taken.select("lang", "text"), words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in found})
    names = {lang: k for k, lang in enumerate(languages)}
    ordered = sorted({bytes(r["word"]) for r in found})
    at = {w: i for i, w in enumerate(ordered)}
    counts = np.zeros((len(ordered), len(languages)))
    for r in found:
        counts[at[bytes(r["word"])], names[r["lang"]]] += r["n"]
    pieces = Pieces.of(read_ranks(path))
    if not ordered:
        return Model(languages, pieces, np.zeros((pieces.size, 0)))
    model = Model(languages, pieces, fit(pieces, ordered, counts))
    likely = model.log_likelihoods(ordered)
    model.typical = (likely * counts).sum(0) / np.maximum(1, letters_of(ordered) @ counts)
    return model


_held: dict[str, Model] = {}


def predict(df: DataFrame, model: Model, *, text_col: str = "text", out: str = "lang_pred", score: str = "score", strange: str | None = None) -> DataFrame:
    """Every row with the language of its whole text and a score from 0 to 1.

    ``und`` and 0 where the text is null or has no letter, or no language was
    learned.  ``strange`` names a column for how unlikely the letters are (see
    Model).  Ties go to the first language in alphabetical order.  Columns
    with the names of the results are replaced; no other column but the text
    is looked at; rows stay where they are.
    """
    more = [strange] if strange else []
    kept = df.drop(out, score, *more)
    schema = kept.withColumns({out: F.lit(""), score: F.lit(0.0), **{c: F.lit(0.0) for c in more}}).schema
    shared = df.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary

    def run(batches):
        own = shared.value
        if own.key not in _held:
            _held.clear()
            _held[own.key] = own
        own = _held[own.key]
        names = np.array([*own.languages, "und"], object)
        for batch, data, offsets in text_slices(batches, text_col):
            best, *scores = own(data, offsets)
            scores = [pa.array(x, pa.float64()) for x in scores[: 1 + len(more)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), *scores], names=[*batch.schema.names, out, score, *more])

    return map_arrow(kept, run, schema)
