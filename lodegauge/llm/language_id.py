"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces of the products of their probabilities, which the forward algorithm gives without
listing segmentations; a text is its words. Probabilities are fitted by expectation maximisation over word counts: the
forward and backward sums give each piece's expected count. The prediction is the language of greatest probability, the
score its posterior under equal priors.

Words are runs of letters in lower case (bytes of non-ASCII characters count as letters), of any length; the sum is over
all segmentations of the whole word.

Fitting reads a bounded, documented sample of labelled rows: about ``sample`` documents a language, drawn by a hash of
the key, one for each key, and all of their words (those of more than FIT_CHARS characters in parts, for fitting only).
Each round's expected counts are summed on the executors, and the driver holds languages x vocabulary numbers. Scoring
reads every whole text, in one scan without an exchange; the model is a broadcast of languages x vocabulary numbers.

Nulls: a null text, or one without a letter, gets ``und`` and score 0. Rows with a null language or key are not learnt
from. With nothing to learn from, every row gets ``und``. Repeated rows get the same result, and rows that share a key
are learnt from once (the least language and text); ties go to the first language in code-point order; extra columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegauge.llm import bytewords as bw
from lodegauge.llm.pieces import PLAIN, Lattice, Vocabulary, distinct, marked, vocabulary
from lodegauge.sources import scratch

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS = 1500
ROUNDS = 6
#: Smoothing of expected counts, and the factor a byte that keeps products in range.
SMOOTHING, BYTE_FACTOR = 0.05, np.exp(2.5)
#: Longer words are fitted in parts of so many characters.
FIT_CHARS = 256
#: Partitions of the words that are fitted, and the parts of one in which counts are summed (so that their order does
#: not matter).
FIT_PARTS, ONE = 16, 1 << 20
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def fold_of(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def training_words(docs: DataFrame, sample: int) -> DataFrame:
    """lang, word, n of the sample: rows whose fold is not 2."""
    rows = docs.select(F.col("doc_id").cast("long"), "lang", "text").where("doc_id is not null and lang is not null and text is not null").where(fold_of(F.col("doc_id")) != 2)
    # one row a language
    share = scratch.lookup(scratch.written(rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")), "shares"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11).cast("double") / float(1 << 53)
    drawn = rows.join(share, "lang").where(u < F.col("share")).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.*")
    letters = F.lower(F.regexp_replace("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", " "))
    words = drawn.select("lang", F.explode(F.split(letters, " ")).alias("word")).where("word <> ''")
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


def expected(words: list[tuple[str, int]], vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """The expected count of each piece in words and their counts, given the pieces' probabilities."""
    parts = [(w[i : i + FIT_CHARS].encode(), i, n) for w, n in words for i in range(0, len(w), FIT_CHARS)]
    raw = [b if i else b" " + b for b, i, _ in parts]
    n, size = np.array([c for *_, c in parts], float), np.array([len(r) for r in raw])
    buf, end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
    hashes, w, out = bw.Hashes(buf), p * BYTE_FACTOR**vocab.lengths, np.zeros(vocab.size)
    for plain in (True, False):
        own = np.flatnonzero((size <= PLAIN) == plain)
        if not len(own):
            continue
        lattice = Lattice(vocab, buf, hashes, (end - size)[own], end[own])
        unit = np.searchsorted(lattice.first, lattice.src, side="right") - 1
        if plain:
            a, b = lattice.forward(w), lattice.backward(w)
            flow = a[lattice.src] * w[lattice.piece] * b[lattice.dst] / a[lattice.last[unit]]
        else:
            (a, x), (b, y), last = lattice.scaled(w), lattice.scaled(w, back=True), lattice.last[unit]
            power = x[lattice.src] + y[lattice.dst] - x[last]
            flow = np.ldexp(a[lattice.src] * w[lattice.piece] * b[lattice.dst] / a[last], np.clip(power, -2000, 2000).astype(np.int32))
        out += np.bincount(lattice.piece, weights=flow * n[own][unit], minlength=vocab.size)
    return out


def score_words(vocab: Vocabulary, weight: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (distinct words, languages), and which of these each word is. A word's slice begins with the
    space before it."""
    hashes = bw.Hashes(buf)
    s, e, which = distinct(hashes.of(start, end), start, end)
    out = np.zeros((len(s), weight.shape[1]))
    for plain in (True, False):
        own = np.flatnonzero((e - s <= PLAIN) == plain)
        if not len(own):
            continue
        lattice = Lattice(vocab, buf, hashes, s[own], e[own])
        if plain:
            out[own] = np.log(np.maximum(lattice.forward(weight)[lattice.last], 1e-300))
        else:
            a, power = lattice.scaled(weight)
            out[own] = np.log(a[lattice.last]) + power[lattice.last] * np.log(2.0)
    out -= np.log(BYTE_FACTOR) * (e - s)[:, None]
    return out, which


class Scorer:
    """The most probable language of each text of a batch, and its posterior."""

    def __init__(self, probabilities: np.ndarray, languages: list[str]):
        self.vocab = vocabulary(VOCABULARY)
        self.weight = probabilities * (BYTE_FACTOR ** self.vocab.lengths)[:, None]
        self.languages = languages

    def best(self, text: pa.Array, letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, m = len(text), len(self.languages)
        if not m:
            return ["und"] * n, np.zeros(n)
        low = pa.RecordBatch.from_arrays([pc.utf8_lower(text.cast(pa.large_string()))], names=["text"])
        logs = np.zeros((n, m))
        for x, y, buf, off in bw.blocks(low, 0):
            buf, off = marked(np.where(bw.LETTER[buf], buf, 0x20).astype(np.uint8), off)
            s, e, row = bw.spans(buf, off, bw.LETTER)
            if not len(s):
                continue
            log, which = score_words(self.vocab, self.weight, buf, s - 1, e)
            for i in range(m):
                logs[x:y, i] = np.bincount(row, weights=log[which, i], minlength=y - x)
        best = logs.argmax(1)
        sure = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        return [self.languages[i] if k else "und" for i, k in zip(best, letter)], np.where(letter, sure, 0.0)


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model, languages: list[str]) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. model: a broadcast of probabilities (pieces, languages)."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, languages)
        for b in batches:
            named, sure = scorer.best(b.column(1), np.array(b.column(3).to_pylist(), bool))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(named, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold_of(F.col("doc_id").cast("long")) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text"), held.alias("held_out"), _has_letter(F.col("text")).alias("letter")).mapInArrow(scored, SCHEMA)


def keep_identified(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE_DOCS) -> DataFrame:
    """The rows whose language is predicted with a posterior of at least ``least``, in the columns they came with; rows
    without a letter go. Without labelled rows to learn from, rows with a letter stay."""
    model, languages = train(docs, sample)
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, languages)
        for b in batches:
            letter = np.array(b.column(len(names)).to_pylist(), bool)
            _, sure = scorer.best(b.column(names.index("text")), letter)
            stays = letter & (sure >= least) if languages else letter
            yield b.select(range(len(names))).filter(pa.array(stays, pa.bool_()))

    return docs.select(*[F.col(f"`{c}`") for c in names], _has_letter(F.col("text")).alias("__letter")).mapInArrow(kept, docs.schema)


def train(docs: DataFrame, sample: int = SAMPLE_DOCS):
    """(broadcast model, languages in code-point order)."""
    context = docs.sparkSession.sparkContext
    with scratch.scope():
        words = training_words(docs, sample).repartition(FIT_PARTS, "lang", "word").sortWithinPartitions("lang", "word")
        words = scratch.written(words, "words")
        languages = sorted(r[0] for r in words.select("lang").distinct().collect())
        size = vocabulary(VOCABULARY).size
        p = np.full((size, len(languages)), 1.0 / size)
        for _ in range(ROUNDS if languages else 0):
            p = _fitted(words, languages, context.broadcast(p))
    return context.broadcast(p), languages


def _fitted(words: DataFrame, languages: list[str], model) -> np.ndarray:
    """The probabilities after one more round."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, got = vocabulary(VOCABULARY), np.zeros(model.value.shape)
        for b in batches:
            by: dict[str, list[tuple[str, int]]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                by.setdefault(lang, []).append((word, n))
            for lang, some in by.items():
                k = languages.index(lang)
                got[:, k] += np.round(expected(some, vocab, model.value[:, k]) * ONE)
        piece, lang = np.nonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(got[piece, lang].astype(np.int64))], names=["lang", "piece", "n"])

    # at most one row for each language and piece
    found = words.select("lang", "word", "n").mapInArrow(count, "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    p = np.full(model.value.shape, SMOOTHING)
    p[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += found.column("n").to_numpy() / ONE
    return p / p.sum(0)


def identify(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the labelled rows of docs and predict every row."""
    model, languages = train(docs, sample)
    return predict(docs, model, languages)
