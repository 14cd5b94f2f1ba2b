"""Sampled segmentations over a piece lattice by forward filtering and backward sampling; lossless decoding.

The forward pass sums the weights of all segmentations up to each place; going back from the end, each piece is drawn
with probability proportional to the sum before it times its own weight, which samples a segmentation in proportion to
the product of its weights. Text splits into units that no piece crosses, so a unit's sums are computed once for all its
occurrences in a block, and all occurrences go back together, a step at a time. Each draw is a hash of the row's key,
the unit's place in the row and the step, compared in whole numbers (32 bits), so results depend on the row alone and
not on how rows are batched or dealt.

Weights: the vocabulary's ranks as a Zipf law, ``(id + 2) ** -exponent``, raised to ``alpha``; a large alpha approaches
the best segmentation, 0 makes all equally likely. Units may have any length; nothing is cut.

Nulls: a null text has no pieces and null ids; an empty text has none and empty ids. Null keys draw alike, and rows that
share key and text get the same pieces. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegauge.llm import bytewords as bw
from lodegauge.llm.pieces import PLAIN, Lattice, Vocabulary, distinct, marked, vocabulary

U = np.uint64
VOCABULARY = "piece_bpe_32k.model"
EXPONENT = 1.0
SCHEMA = "doc_id long, n_pieces long, ids array<int>, lossless boolean"


def weights(vocab: Vocabulary, alpha: float, exponent: float = EXPONENT) -> np.ndarray:
    """Weights with a factor a byte that keeps sums in range; byte pieces weigh the least."""
    rank = np.arange(vocab.size) + 2.0
    w = (rank / 2.0) ** (-exponent * alpha)
    w[vocab.byte_ids] = w.min()
    return w * np.exp(1.5 * alpha) ** vocab.lengths


def units(vocab: Vocabulary, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of the units of marked texts: they tile every row."""
    begins = (buf & 0xC0) != 0x80
    new = np.zeros(len(buf), bool)
    new[1:] = vocab.cut[buf[:-1], buf[1:]] & begins[1:]
    new[off[:-1]] = True
    start = np.flatnonzero(new)
    end = np.concatenate([start[1:], [len(buf)]])
    return start, end, np.searchsorted(off, start, side="right") - 1


def _edges(lattice: Lattice, weight: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in order of their target: source, piece, and a key, the target and the share of the edges before it among
    those of the target, in 2**32 parts, which marks where an edge's part begins."""
    order = np.argsort(lattice.dst, kind="stable")
    src, dst, piece = lattice.src[order], lattice.dst[order], lattice.piece[order]
    head = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(dst)]])))
    if plain:
        mass = lattice.forward(weight)[src] * weight[piece]
    else:
        a, power = lattice.scaled(weight)
        mass = np.ldexp(a[src] * weight[piece], np.maximum(power[src] - np.maximum.reduceat(power[src], head)[run], -2000).astype(np.int32))
    # sums within a target on their own, so that they depend on nothing else in the block
    place = np.arange(len(dst)) - head[run] if len(dst) else np.zeros(0, np.int64)
    below = np.zeros(len(dst))
    for k in range(1, int(place.max(initial=0)) + 1):
        at = np.flatnonzero(place == k)
        below[at] = below[at - 1] + mass[at - 1]
    tail = np.concatenate([head[1:], [len(dst)]]).astype(np.int64) - 1
    full = below[tail] + mass[tail]
    part = np.minimum(np.floor(below / full[run] * (1 << 32)), (1 << 32) - 1).astype(np.int64)
    return src, piece, (dst << 32) | part


def sample_block(vocab: Vocabulary, weight: np.ndarray, buf: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all rows of a block of marked texts, and their number by row. seeds: a number for each row."""
    n = len(off) - 1
    start, end, row = units(vocab, buf, off)
    hashes = bw.Hashes(buf)
    nth = np.arange(len(start)) - np.searchsorted(row, row)
    state = bw.mix(seeds[row] + nth.astype(U) * U(0x9E3779B97F4A7C15))
    drawn, by_place = [], np.zeros(len(start), np.int64)
    for plain in (True, False):
        own = np.flatnonzero((end - start <= PLAIN) == plain)
        if not len(own):
            continue
        s, e, which = distinct(hashes.of(start[own], end[own]), start[own], end[own])
        lattice = Lattice(vocab, buf, hashes, s, e)
        src, piece, key = _edges(lattice, weight, plain)
        # all occurrences go back a step at a time, in order of their unit, which keeps the search near
        by_unit = np.argsort(which, kind="stable")
        node, goal = lattice.last[which[by_unit]], lattice.first[which[by_unit]]
        own = own[by_unit]
        mine, alive, turn = state[own], np.arange(len(own)), 0
        while len(alive):
            r = (bw.mix(mine[alive] + U(turn * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> U(32)).astype(np.int64)
            edge = np.searchsorted(key, (node[alive] << 32) | r, side="right") - 1
            drawn.append((own[alive], piece[edge], turn))
            by_place[own[alive]] += 1
            node[alive] = src[edge]
            alive = alive[node[alive] > goal[alive]]
            turn += 1
    ends = np.cumsum(by_place)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for who, pieces, turn in drawn:
        out[ends[who] - 1 - turn] = pieces
    return out, np.bincount(row, weights=by_place, minlength=n).astype(np.int64)


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """The text of a row's pieces."""
    return b"".join(vocab.bytes[i] for i in ids)[1:].decode("utf-8", errors="surrogateescape")


def encode(docs: DataFrame, alpha: float = 0.5, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_pieces, ids, and lossless: whether the pieces' bytes give the text back. One scan, no
    exchange."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(VOCABULARY)
        weight = weights(vocab, alpha)
        spelling = pa.array(vocab.bytes, pa.large_binary())
        for b in batches:
            known = np.array(b.column(1).is_valid().to_pylist(), bool)
            keys = np.array([(k if k is not None else -(1 << 62)) & 0xFFFFFFFFFFFFFFFF for k in b.column(0).to_pylist()], U)
            seeds = bw.mix(keys + U(seed) * U(0xA24BAED4963EE407))
            for x, y, raw, raw_off in bw.blocks(b, 1):
                buf, off = marked(raw, raw_off)
                # empty texts have no pieces, not even a mark
                full = np.diff(raw_off) > 0
                keep = np.ones(len(buf), bool)
                keep[off[:-1][~full]] = False
                buf = buf[keep]
                off = np.concatenate([[0], np.cumsum(np.where(full, np.diff(off), 0))]).astype(np.int64)
                n = np.zeros(y - x, np.int64)
                ids = np.zeros(0, np.int32)
                if len(buf):
                    some = np.flatnonzero(full)
                    ids, n[some] = sample_block(vocab, weight, buf, np.concatenate([off[:-1][some], [off[-1]]]), seeds[x:y][some])
                ends = np.concatenate([[0], np.cumsum(n)])
                # decode: the spellings in order are one buffer, row by row as long as the text with its mark
                spelt = spelling.take(pa.array(ids))
                text = np.frombuffer(spelt.buffers()[2], np.uint8, int(vocab.lengths[ids].sum())) if len(ids) else np.zeros(0, np.uint8)
                back = np.concatenate([[0], np.cumsum(vocab.lengths[ids])])[ends]
                if len(text) == len(buf):
                    wrong = np.concatenate([[0], np.cumsum(text != buf)])
                    same = (back[:-1] == off[:-1]) & (back[1:] == off[1:]) & (wrong[off[1:]] == wrong[off[:-1]])
                else:
                    same = np.array([text[p:q].tobytes() == buf[u:v].tobytes() for p, q, u, v in zip(back[:-1], back[1:], off[:-1], off[1:])], bool)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(~known[x:y]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(n), lists, pa.array(same)], names=["doc_id", "n_pieces", "ids", "lossless"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(encoded, SCHEMA)
