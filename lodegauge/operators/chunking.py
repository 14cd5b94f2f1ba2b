"""Chunking strategies: (docid, text) to (docid, chunk_id, start, end, text), without leaving the row.

Texts are normalized to the offset space first; chunk texts are exact slices of it. Empty and null texts give no chunks.
Chunks are made in one Arrow pass over the texts, linear in their length, whatever the number of strategies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegauge.functions.text import SMALL, normalized, plain_text, small

#: A sentence with its end marks and closers, or what is left at the end; pieces tile the text.
SENTENCE = r"""[^.!?]*[.!?]+["')\]]*|[^.!?]+$"""
#: A token with the space before it; tokens tile a normalized text.
TOKEN = r" ?(?:[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_ ])"


def _normal(docs: DataFrame) -> DataFrame:
    return normalized(docs.select(F.col("docid").cast("string").alias("docid"), F.col("text").cast("string").alias("text")))


#: (number, start, end) of a text's chunks.
Spans = Iterable[tuple[int, int, int]]


@dataclass(frozen=True)
class Strategy:
    """Chunks that a function of the normalized text gives, as a function of a DataFrame (docid, text); ``make`` makes that function,
    once a task."""

    prefix: str
    make: Callable[[], Callable[[str], Spans]]

    def __call__(self, docs: DataFrame) -> DataFrame:
        return _chunked(docs, {"": self}).drop("strategy")


def _chunked(docs: DataFrame, strategies: dict[str, Strategy], texts: bool = True) -> DataFrame:
    """docid, chunk_id, start, end, text, strategy of all strategies, in one pass: a text is read and normalized once. Without
    ``texts`` chunks have offsets only."""
    names = ["docid", "chunk_id", "start", "end", *(["text"] if texts else []), "strategy"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *([pa.string()] if texts else []), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [(name, s.prefix, s.make()) for name, s in strategies.items()]
        held: list[list] = [[] for _ in types]
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types)], names=names)

        for b in small(batches):
            for docid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = plain_text(text or "")
                if not text:
                    continue
                for name, prefix, spans in makers:
                    before = f"{prefix}-{docid}-"
                    for i, start, end in spans(text):
                        row = (docid, None if docid is None else f"{before}{i:04d}", start, end, *([text[start:end]] if texts else []), name)
                        for column, value in zip(held, row):
                            column.append(value)
                        size += 64 + (end - start if texts else 0)
                        if size > SMALL:
                            yield out()
                            held, size = [[] for _ in types], 0
        if held[0]:
            yield out()

    given = docs.select(F.col("docid").cast("string").alias("docid"), F.col("text").cast("string").alias("text"))
    schema = "docid string, chunk_id string, start long, end long, " + ("text string, " if texts else "") + "strategy string"
    return given.mapInArrow(run, schema)


def window_spans(size: int, step: int) -> Callable[[str], Spans]:
    def spans(text: str) -> Spans:
        n, number = len(text), 0
        for start in range(0, min(-(-max(n - size, 0) // step), (n - 1) // step) * step + 1, step):
            if text[start : start + size].strip(" "):
                yield number, start, min(start + size, n)
                number += 1

    return spans


def char_windows(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` characters, each starting size - overlap after the last; the last one reaches the end. An
    overlap of size or more gives no rows. Blank windows are skipped and not numbered."""
    if size <= overlap:
        return _chunked(docs, {}).drop("strategy")
    return Strategy(f"CHARWIN{size}OV{overlap}", partial(window_spans, size, size - overlap))(docs)


def char_blocks(docs: DataFrame, size: int = 1000) -> DataFrame:
    """Windows without overlap, under the names of windows."""
    return char_windows(docs, size, 0)


def sentence_spans() -> Callable[[str], Spans]:
    find = re.compile(SENTENCE).finditer

    def spans(text: str) -> Spans:
        for i, m in enumerate(find(text)):
            piece = m[0].lstrip(" ")
            if piece:
                yield i, m.end() - len(piece), m.end() - len(piece) + len(piece.rstrip(" "))

    return spans


def sentences(docs: DataFrame) -> DataFrame:
    """Sentences by end marks; blank pieces are skipped, but numbered."""
    return Strategy("SENT", sentence_spans)(docs)


def tokenizer_windows(docs: DataFrame, make_tokenizer: Callable[[], Callable[[str], list[tuple[int, int]]]], size: int = 512, stride: int = 128) -> DataFrame:
    """Windows of ``size`` tokens, one every ``stride``, of a tokenizer that gives the characters (start, end) of a whole
    text's tokens, without special ones. Blank windows are skipped and not numbered; the one that reaches the last token
    is the last."""

    def make():
        offsets = make_tokenizer()

        def spans(text: str) -> Spans:
            at, number = offsets(text), 0
            for i in range(0, len(at), stride):
                start, end = at[i][0], at[min(i + size, len(at)) - 1][1]
                if text[start:end].strip():
                    yield number, start, end
                    number += 1
                if i + size >= len(at):
                    return

        return spans

    return Strategy(f"TOKWIN{size}S{stride}", make)(docs)


def public_tokenizer(name: str = "byte_bpe_50k.json") -> Callable[[], Callable[[str], list[tuple[int, int]]]]:
    """A maker for tokenizer_windows() of a public vocabulary file."""

    def make():
        import public_tokenizers
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(public_tokenizers.path(name))
        return lambda text: known.encode(text, add_special_tokens=False).offsets

    return make


def packed_sentences(docs: DataFrame, size: int = 512) -> DataFrame:
    """Recursive splitting: whole sentences are packed into chunks of up to ``size`` tokens; a sentence of more tokens is
    split between tokens, into parts of ``size``. Chunks don't overlap and leave out nothing but spaces between them."""

    def make():
        import regex

        tokens, pieces = regex.compile(TOKEN), sentence_spans()

        def spans(text: str) -> Spans:
            number, held, start, end = 0, 0, 0, 0
            for _, s, e in pieces(text):
                at = [m.span() for m in tokens.finditer(text, s, e)]
                if held and held + len(at) > size:
                    yield number, start, end
                    number, held = number + 1, 0
                while len(at) > size:
                    yield number, s, at[size - 1][1]
                    number, at = number + 1, at[size:]
                    s = at[0][0] + (text[at[0][0]] == " ")
                if at:
                    start, end, held = (start if held else s), e, held + len(at)
            if held:
                yield number, start, end

        return spans

    return Strategy(f"RTS{size}", make)(docs)


def token_spans(size: int, stride: int) -> Callable[[str], Spans]:
    """Offsets are needed at window borders only, so tokens are matched by blocks of the greatest common divisor of size and
    stride."""
    import regex

    block = math.gcd(size, stride)
    plain = TOKEN.replace(r"\p{L}\p{N}\p{M}", "A-Za-z0-9").replace("]+", "]++")
    ascii_blocks, ascii_token = re.compile(f"(?>{plain}){{1,{block}}}+"), re.compile(plain)
    blocks, token = regex.compile(f"(?>{TOKEN.replace(']+', ']++')}){{1,{block}}}+"), regex.compile(TOKEN)

    def spans(text: str) -> Spans:
        simple = text.isascii()
        at = [0, *(m.end() for m in (ascii_blocks if simple else blocks).finditer(text))]
        n = (len(at) - 2) * block + sum(1 for _ in (ascii_token if simple else token).finditer(text, at[-2]))
        for w in range(min(-(-max(n - size, 0) // stride), (n - 1) // stride) + 1):
            first = at[w * stride // block]
            yield w, first + (text[first] == " "), at[min(-(-(w * stride + size) // block), len(at) - 1)]

    return spans


def token_windows(docs: DataFrame, size: int = 512, stride: int = 128) -> DataFrame:
    """Windows of ``size`` tokens, one every ``stride``; the one that reaches the last token is the last."""
    return Strategy(f"TOKWIN{size}S{stride}", partial(token_spans, size, stride))(docs)


#: Strategies by name; a strategy is any function of a DataFrame (docid, text).
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "TOKWIN512_S128": Strategy("TOKWIN512S128", partial(token_spans, 512, 128)),
    "SENT": Strategy("SENT", sentence_spans),
    "CHARWIN500_OV50": Strategy("CHARWIN500OV50", partial(window_spans, 500, 450)),
    "CHARBLOCK1000_NOV0": Strategy("CHARWIN1000OV0", partial(window_spans, 1000, 1000)),
}


def chunk_all(docs: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]] | None = None, texts: bool = True) -> DataFrame:
    """All strategies in one frame with a strategy column; those that are a Strategy share one pass. Without ``texts`` chunks have no
    text, for callers that need offsets only."""
    given = strategies or STRATEGIES
    shared = {k: f for k, f in given.items() if isinstance(f, Strategy)}
    out = _chunked(docs, shared, texts) if shared else None
    for name in given.keys() - shared.keys():
        one = given[name](docs).withColumn("strategy", F.lit(name))
        one = one if texts else one.drop("text")
        out = one if out is None else out.unionByName(one)
    return out


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, documents and mean length by strategy."""
    return chunks.groupBy("strategy").agg(F.count("*").alias("chunks"), F.countDistinct("docid").alias("docs"), F.round(F.avg(F.length("text") if "text" in chunks.columns else F.col("end") - F.col("start")), 6).alias("mean_length"))
