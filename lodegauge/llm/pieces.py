"""Lattices of vocabulary pieces over many units of text at once, in NumPy.

A unit is a slice of bytes that no piece crosses the ends of. Its nodes are byte positions, its edges the pieces found
there; a character that is no piece by itself is spelt by the vocabulary's byte pieces. The word mark of the vocabulary
stands for the space, one to one, so a mark that occurs in a text itself is spelt by bytes and decoding stays lossless.

Sums over segmentations are plain numbers for units of up to PLAIN bytes, whose weights carry a factor a byte that keeps
them in range, and numbers with an exponent of their own at every node beyond, so that no unit is too long for them. A
unit's lattice is held whole, some 200 bytes of memory a byte. Empty units have one node and no edge.
"""

from __future__ import annotations

import functools

import numpy as np

from lodegauge.llm import bytewords as bw

U = np.uint64
MARK = "▁"
_SLOTS = 1 << 20
#: Bytes of the longest units whose sums need no exponents.
PLAIN = 64
NOTHING, BEGINNING = -1, -2


class Vocabulary:
    """The pieces of a SentencePiece .model file as bytes, found by the hash of a slice."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.bytes: list[bytes] = []
        self.byte_ids = np.full(256, -1, np.int64)
        plain = []
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(p.replace(MARK, " ").encode())
                plain.append(i)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary spells no unknown characters by bytes")
        self.plain = np.array(plain)
        self.lengths = np.array([len(b) for b in self.bytes])
        self.longest = int(self.lengths.max())
        pieces = [self.bytes[i] for i in plain]
        # every beginning of a piece, with the piece that it is itself, or BEGINNING
        known = {p[:n]: BEGINNING for p in pieces for n in range(1, len(p))} | dict(zip(pieces, plain))
        buf = np.frombuffer(b"".join(known), np.uint8)
        sizes = np.array([len(p) for p in known])
        hashes = bw.Hashes(buf).of(np.cumsum(sizes) - sizes, np.cumsum(sizes))
        self._keys, self._ids = np.zeros(_SLOTS, U), np.full(_SLOTS, NOTHING, np.int64)
        for h, i in zip(hashes.tolist(), known.values()):
            at = h >> 44
            while self._ids[at] != NOTHING:
                at = (at + 1) % _SLOTS
            self._keys[at], self._ids[at] = h, i
        #: cut[a, b]: no piece has byte b right after byte a
        self.cut = np.ones((256, 256), bool)
        for p in pieces:
            x = np.frombuffer(p, np.uint8)
            self.cut[x[:-1], x[1:]] = False

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, BEGINNING, or NOTHING."""
        at = (hashes >> U(44)).astype(np.int64)
        out = self._ids[at]
        todo = np.flatnonzero((self._keys[at] != hashes) & (out != NOTHING))
        while len(todo):
            at[todo] = (at[todo] + 1) % _SLOTS
            out[todo] = self._ids[at[todo]]
            todo = todo[(self._keys[at[todo]] != hashes[todo]) & (out[todo] != NOTHING)]
        return out


@functools.cache
def vocabulary(name: str) -> Vocabulary:
    """The vocabulary of a public tokenizer, made once a process."""
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


class Lattice:
    """Edges (source node, target node, piece) of units [start, end) of a buffer; node = first[unit] + byte offset.
    Edges are in order of their target's offset, so a forward pass goes through them level by level."""

    def __init__(self, vocab: Vocabulary, buf: np.ndarray, hashes: bw.Hashes, start: np.ndarray, end: np.ndarray):
        size = end - start
        self.first = np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int64)
        self.last = self.first[1:] - 1
        self.nodes = int(self.first[-1])
        unit = np.repeat(np.arange(len(size)), size)
        offset = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
        place = start[unit] + offset
        begins = (buf[place] & 0xC0) != 0x80
        begins |= offset == 0
        node = self.first[unit] + offset
        left = size[unit] - offset
        # a place where the unit ends or the next character begins
        closes = np.ones(len(unit) + 1, bool)
        closes[:-1] = begins
        at = np.flatnonzero(begins)
        src, dst, piece, level = [], [], [], []
        whole = np.zeros(len(unit), bool)  # characters that are pieces
        for n in range(1, vocab.longest + 1):
            at = at[left[at] >= n]
            found = vocab.find(hashes.of(place[at], place[at] + n))
            alive = found != NOTHING
            at, found = at[alive], found[alive]
            if not len(at):
                break
            hit = (found >= 0) & ((left[at] == n) | closes[at + n])
            ok = at[hit]
            src.append(node[ok])
            dst.append(node[ok] + n)
            piece.append(found[hit])
            level.append(offset[ok] + n)
            if n <= 4:
                inner = np.ones(len(ok), bool)
                for j in range(1, n):
                    inner &= ~begins[ok + j]
                whole[ok[inner]] = True
        # characters that are no piece: their bytes
        char = np.maximum.accumulate(np.where(begins, np.arange(len(unit)), 0)) if len(unit) else np.zeros(0, np.int64)
        spelt = np.flatnonzero(~whole[char])
        src.append(node[spelt])
        dst.append(node[spelt] + 1)
        piece.append(vocab.byte_ids[buf[place[spelt]]])
        level.append(offset[spelt] + 1)
        src, dst, piece, level = map(np.concatenate, (src, dst, piece, level))
        order = np.argsort(level * (self.nodes + 1) + dst, kind="stable")
        self.src, self.dst, self.piece, level = src[order], dst[order], piece[order], level[order]
        self.levels = np.concatenate([np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])), [len(level)]]) if len(level) else np.zeros(1, np.int64)

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """The sum over all segmentations up to each node of their products of weights; weight is (pieces,) or
        (pieces, models). For units of up to PLAIN bytes."""
        a = np.zeros((self.nodes, *weight.shape[1:]))
        a[self.first[:-1]] = 1.0
        for s, e in zip(self.levels[:-1], self.levels[1:]):
            got = a[self.src[s:e]] * weight[self.piece[s:e]]
            d = self.dst[s:e]
            new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            a[d[new]] = np.add.reduceat(got, new, axis=0)
        return a

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """The sum over all segmentations from each node to its unit's end. For units of up to PLAIN bytes."""
        b = np.zeros((self.nodes, *weight.shape[1:]))
        b[self.last] = 1.0
        for s, e in zip(self.levels[-2::-1], self.levels[:0:-1]):
            np.add.at(b, self.src[s:e], b[self.dst[s:e]] * weight[self.piece[s:e]])
        return b

    def scaled(self, weight: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The sums of units of any length, up to each node or (back) from each node to its unit's end, as numbers and
        powers of two: number * 2 ** power. Nodes that no segmentation reaches are 0."""
        a, power = np.zeros((self.nodes, *weight.shape[1:])), np.zeros((self.nodes, *weight.shape[1:]), np.int64)
        a[self.last if back else self.first[:-1]] = 1.0
        source, target, piece, cuts = self.src, self.dst, self.piece, self.levels
        if back:  # edges by their source, from the last one to the first
            unit = np.searchsorted(self.first, self.src, side="right") - 1
            left = self.last[unit] - self.src
            order = np.argsort(left * (self.nodes + 1) + self.src, kind="stable")
            source, target, piece, left = self.dst[order], self.src[order], self.piece[order], left[order]
            cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])), [len(left)]]) if len(left) else np.zeros(1, np.int64)
        for s, e in zip(cuts[:-1], cuts[1:]):
            x, d = source[s:e], target[s:e]
            new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            run = np.repeat(np.arange(len(new)), np.diff(np.concatenate([new, [len(d)]])))
            high = np.maximum.reduceat(np.where(a[x] > 0, power[x], -(1 << 60)), new, axis=0)
            got = np.ldexp(a[x] * weight[piece[s:e]], np.maximum(power[x] - high[run], -2000).astype(np.int32))
            a[d[new]], shift = np.frexp(np.add.reduceat(got, new, axis=0))
            power[d[new]] = high + shift
        return a, power


def marked(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space put before each."""
    n = len(off) - 1
    out = np.full(len(buf) + n, 0x20, np.uint8)
    at = off + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[at[:-1]] = False
    out[keep] = buf
    return out, at


def distinct(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and end of one slice of each hash, and which of these each slice equals."""
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    return start[one], end[one], which
