"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair merges.

For byte-level BPE the encoding of a prefix is fixed by its last token: if t is that token, the rest is the encoding of
the prefix without t, and the pair (last token before, t) must itself be stable under the merges. Exactly one token
fits at each position, so ``count[i] = count[i - len(t)] + 1`` fills a table of counts for every prefix in one pass; the
tokens that end at a position come from one automaton, so runs without a break cost no more a byte than words do.
Tables of distinct pre-tokens are kept, and a text's table is put together from them. Truncation ("longest prefix within
a budget") and budget questions are lookups in that table; nothing is encoded again.

Nulls: a null text counts as empty. Empty texts have 0 bytes and 0 tokens, and a table of one 0. Repeated rows give
repeated results; extra columns are ignored; a null doc_id is carried through. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pre-tokenization pattern of byte-level BPE vocabularies (fixed value).
PATTERN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
SPACES = regex.compile(r"\s+")
#: Contractions of the pattern whose first two characters are two pre-tokens when the third is cut off (fixed values).
SHORTENED = ("'re", "'ve", "'ll")
#: Distinct pre-tokens whose tables a worker keeps; beyond it the memory is emptied, which changes speed only.
KEPT = 400_000
#: Pre-tokens of more characters than this are counted without being kept.
LONGEST_KEPT = 64
#: Pairs of tokens that a worker remembers as stable or not; beyond it the memory is emptied, too.
PAIRS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables for one vocabulary file (the .json form)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda piece: bytes(alphabet[c] for c in piece)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        pieces = {raw(p) for p in spec["model"]["vocab"] if all(c in alphabet for c in p)}
        #: Pieces that their own merges reach; no other can end an encoding.
        self.tokens = sorted(p for p in pieces if len(self._merge(p)) == 1)
        self.ends = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.split_special = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        #: Tokens of a pre-token, and of each of its prefixes.
        self.total: dict[str, int] = {}
        self.tables: dict[str, np.ndarray] = {}
        self.pairs: dict[int, bool] = {}
        self.spine = functools.lru_cache(maxsize=200_000)(self._spine)

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """The pieces at one edge of a token (side 1: its end, 0: its start), from the whole down to a byte, each with
        the rank of the merge that forms it and of the merge that takes it up (never: 1 << 60)."""
        out, taken = [], 1 << 60
        while True:
            if len(token) == 1:
                return [*out, (token, -1, taken)]
            pair = self._last_merge(token)
            rank = self.rank[pair]
            out.append((token, rank, taken))
            token, taken = pair[side], rank

    def _last_merge(self, token: bytes) -> tuple[bytes, bytes]:
        """The merge that completes a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            _, i = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _stable(self, left: bytes, right: bytes) -> bool:
        """Whether the merges turn left + right into just these two tokens: no merge across the border has its turn
        while both of its pieces stand there. Of equal merges the leftmost goes first."""
        for a, made_a, taken_a in self.spine(left, 1):
            for b, made_b, taken_b in self.spine(right, 0):
                rank = self.rank.get((a, b))
                if rank is not None and made_a < rank < taken_a and made_b < rank <= taken_b:
                    return False
        return True

    def _merge(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens, by number, stay as they are next to each other."""
        pair = left << 20 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._stable(self.tokens[left], self.tokens[right])
        return known

    def table(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1], ..., word: the prefix dynamic programme."""
        count, last, stable = [0], [-1], self.stable
        for end, (size, token) in self.ends.iter(word.decode("latin-1")):
            start = end + 1 - size
            if len(count) == end + 1 and (start == 0 or stable(last[start], token)):
                count.append(count[start] + 1)
                last.append(token)
        return count

    def word_table(self, word: str) -> np.ndarray:
        """Token counts of the pre-token's prefixes, by characters."""
        table = self.tables.get(word)
        if table is None:
            raw = word.encode("utf-8")
            table = np.array(self.table(raw), np.int32)
            if len(raw) > len(word):  # only whole characters
                ends = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                table = table[np.append(ends, len(raw))]
            if len(word) <= LONGEST_KEPT:
                if len(self.tables) >= KEPT:
                    self.tables.clear()
                    self.total.clear()
                self.tables[word] = table
                self.total[word] = int(table[-1])
        return table

    def word_total(self, word: str) -> int:
        """The last entry of the pre-token's table. A table made for that alone isn't kept, its last entry is."""
        n = self.total.get(word)
        if n is None:
            n = self.table(word.encode("utf-8"))[-1]
            if len(word) <= LONGEST_KEPT:
                if len(self.total) >= KEPT:
                    self.total.clear()
                self.total[word] = n
        return n

    def parts(self, text: str) -> list[str | None]:
        """The text between special strings, with None for each special string."""
        if self.split_special is None:
            return [text]
        out: list[str | None] = []
        at = 0
        for m in self.split_special.finditer(text):
            out += [text[at : m.start()], None]
            at = m.end()
        return [*out, text[at:]]

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        known, n = self.total, 0
        special = any(s in text for s in self.special)
        for part in self.parts(text) if special else [text]:
            if part is None:
                n += 1
                continue
            words = PATTERN.findall(part)
            try:
                n += sum(map(known.__getitem__, words))
            except KeyError:
                n += sum(map(self.word_total, words))
        return n

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text, put together from the tables of its pre-tokens.

        A pre-token that is cut short is the same prefix of it, but for three cases: white space at the end of a prefix
        is one pre-token up to there (inside a text its last character goes with what follows), a contraction of three
        characters falls apart when its last one is cut off, and a special string that is cut is ordinary text, joined
        to what stands before it.
        """
        out = np.zeros(len(text) + 1, np.int32)
        total, at, words, spaces = 0, 0, [], []
        for part in self.parts(text):
            if part is None:
                end = self.split_special.match(text, at).end()
                # where the cut string can join: at white space that ends the part before, or at its last pre-token
                begin, before = words[-1] if words else (at, total)
                if spaces and spaces[-1][1] == at:
                    begin, before = spaces[-1][0], int(out[spaces[-1][0]]) if spaces[-1][2] else spaces[-1][3]
                for cut in range(at + 1, end):
                    out[cut] = before + sum(map(self.word_total, PATTERN.findall(text[begin:cut])))
                total, at = total + 1, end
                out[at] = total
                continue
            first, words = total, []
            for m in PATTERN.finditer(part):
                s, w = at + m.start(), m[0]
                table = self.word_table(w)
                out[s + 1 : s + len(table)] = table[1:] + total
                if w in SHORTENED:
                    out[s + 2] = total + self.word_total(w[0]) + self.word_total(w[1])
                words.append((s, total))
                total += int(table[-1])
            words, spaces = words[-1:], []
            for m in SPACES.finditer(part):
                s, e = at + m.start(), at + m.end()
                base = int(out[s]) if m.start() else first
                out[s + 1 : e + 1] = self.word_table(m[0])[1:] + base
                spaces = [(s, e, m.start() > 0, first)]
            at += len(part)
        return out

    def prefix_table(self, text: str) -> PrefixTable:
        return PrefixTable(self.prefix_counts(text))


class PrefixTable:
    """Answers from the counts of every prefix of one text."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def at(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        return int(self.counts[max(0, min(chars, len(self.counts) - 1))])

    def truncate(self, budget: int) -> int:
        """The most characters c for which text[:c'] has at most ``budget`` tokens for every c' up to c."""
        over = self.counts > budget
        return max(0, int(over.argmax()) - 1) if over.any() else len(self.counts) - 1


@functools.cache
def counter(vocabulary: str) -> PrefixCounter:
    """The counter of a public tokenizer, made once a process."""
    import public_tokenizers

    return PrefixCounter(public_tokenizers.path(vocabulary))


def prefix_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row: doc_id and counts, the tokens of every prefix of its text by characters (array<int>). One scan, no
    exchange; what it returns can be stored, and asked by longest_prefix()."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for b in batches:
            for i in range(b.num_rows):  # a table is longer than its text
                counts = known.prefix_counts(b.column(1)[i].as_py() or "")
                lists = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), lists], names=["doc_id", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tables, "doc_id long, counts array<int>")


def longest_prefix(counts: Column, budget: int) -> Column:
    """Of a stored table the most characters within the budget, as PrefixTable.truncate() gives it."""
    over = F.array_position(F.transform(counts, lambda n: n > budget), True)
    return F.when(over == 0, F.size(counts) - 1).otherwise(F.greatest(over.cast("int") - 2, F.lit(0)))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). One scan, no exchange.

    vocabulary: the name of a byte-level BPE .json file among the public tokenizers; each worker opens its own copy. A
    text's count is the sum of the last entries of its pre-tokens' tables.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for b in batches:
            sizes = [known.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array([n > limit for n in sizes], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    size = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col("doc_id").cast("long"), "text", size.alias("n_bytes")).mapInArrow(counted, SCHEMA)
