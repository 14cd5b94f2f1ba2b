"""Phrase collocations by Suffix-sigma: counts of all phrases of up to max_n words from one sort of truncated suffixes.

1. One scan counts the hashes of words and of pairs of neighbours, combined a block of text at a time before they are
   exchanged. A word or pair seen fewer than ``least`` times is in no candidate nor in a part of one, so suffixes end there
   ("document splits"): a bitmap of 2**FREQUENT_BITS bits holds the hashes of the others. A rare one that shares a bit or a
   hash with a frequent one only makes a suffix longer than it need be.
2. Every word starts a suffix of its piece, cut after max_n words. Equal ones are counted a block at a time and exchanged by
   ranges of (language, first word, further words): a range holds neighbouring first words, or a part of a frequent one.
   Each range is sorted in reverse, so that all suffixes with a common prefix lie together; one stack of max_n + 1
   counters (the language's own at the bottom) sees every prefix begin and end. A prefix that a range's border cuts is given
   out by both ranges whatever its count, and summed.
3. Candidates are joined to the counts of their two parts at every cut, and to the longer candidates that hold them.

Counts are exact: suffixes are compared by their bytes, and all products are decimals. A task holds a block of text (BLOCK bytes,
or one longer text) or one batch of rows; a phrase of unlimited frequency is one row a block.

Null and empty texts have no words; a null language is ``und``; an empty table gives no rows; repeated rows count as often as they
occur. Words are whole, of any length. Only lang and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.llm import bytewords as bw
from lodegauge.sources import scratch

#: Bytes of text whose suffixes are counted together.
BLOCK = 1 << 20
#: Bits of the bitmap of frequent words and pairs: 16 MB.
FREQUENT_BITS = 27

#: Bytes that end a piece, and bytes of words.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~PUNCTUATION
WORD[[0x20, 0x09]] = False


def escaped(b: bytes) -> bytes:
    """Without NUL bytes, which separate words in keys."""
    return b.replace(b"\1", b"\1\1").replace(b"\0", b"\1\2") if b"\0" in b or b"\1" in b else b


def plain(b: bytes) -> bytes:
    """What escaped() was given."""
    return b"\1".join(p.replace(b"\1\2", b"\0") for p in b.split(b"\1\1")) if b"\1" in b else b


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(language, bytes, row offsets) of blocks of a batch's texts in lower case."""
    langs = pc.fill_null(batch.column(0), "und")
    for lang in langs.unique():
        rows = batch.filter(pc.equal(langs, lang))
        for _, _, buf, off in bw.blocks(rows, 1, BLOCK):
            low = bw.LOWER[buf]
            if (low < 2).any():  # NUL or what escapes it
                parts = [escaped(low[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                low, off = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
            yield escaped(lang.as_py().encode()), low, off


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=off[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[start : start + size] of each, which may overlap."""
    before = np.cumsum(size) - size
    return _binary(data[np.arange(int(size.sum())) + np.repeat(start - before, size)], size)


def _counted(values: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    seen = pc.value_counts(values)
    yield from ((seen.field("values").slice(a, 1 << 16).cast(pa.binary()), seen.field("counts").slice(a, 1 << 16)) for a in range(0, len(seen), 1 << 16))


def _words(lang: bytes, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, end and hash of a language's words, the word after each one's piece, and the hashes of each word with the
    next one of its piece (that of a last word means nothing)."""
    start, end, row = bw.spans(buf, off, WORD)
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang, digest_size=8).digest(), "little"))
    h = bw.mix(bw.Hashes(buf).of(start, end) ^ seed)
    pair = h.copy()
    pair[:-1] = bw.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    ends = np.cumsum(PUNCTUATION[buf])
    last = np.ones(len(start), bool)
    last[:-1] = (row[1:] != row[:-1]) | (ends[start[1:]] != ends[end[:-1] - 1])
    return start, end, h, np.flatnonzero(last)[np.cumsum(last) - last] + 1, pair


def hash_counts(docs: DataFrame) -> DataFrame:
    """h and n: the hashes of words and of pairs of neighbours, with their occurrences, combined by blocks of text. What
    shares a hash is counted together, so n is never too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, buf, off in _by_language(batch):
                start, _, h, stop, pair = _words(lang, buf, off)
                h, n = np.unique(np.concatenate([h, pair[np.arange(len(start)) + 1 < stop]]), return_counts=True)
                for a in range(0, len(h), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], names=["h", "n"])
        bw.release()

    return docs.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_bits(counts: DataFrame, least: int) -> np.ndarray:
    """The bitmap (bytes, lowest bit first) of hashes with at least ``least`` occurrences: 2**FREQUENT_BITS bits, whatever the corpus."""
    bit = F.shiftrightunsigned("h", 64 - FREQUENT_BITS)
    bits = counts.where(F.col("n") >= least).select(F.shiftrightunsigned(bit, 15).alias("part"), bit.bitwiseAND(32767).alias("at"))
    parts = bits.groupBy("part").agg(F.bitmap_construct_agg("at").alias("held")).collect()
    out = np.zeros((1 << FREQUENT_BITS) // 8, np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["held"]), np.uint8)
    return out


def suffixes(docs: DataFrame, frequent: np.ndarray, max_n: int) -> DataFrame:
    """key (language, then up to max_n words, by NUL) and n of the suffixes, combined by blocks of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held(h: np.ndarray) -> np.ndarray:
            bit = (h >> np.uint64(64 - FREQUENT_BITS)).astype(np.int64)
            return (frequent[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            for lang, buf, off in _by_language(batch):
                start, end, h, stop, pair = _words(lang, buf, off)
                many, size = len(start), end - start
                if not many:
                    continue
                at = np.arange(many)
                # each suffix ends before its first rare word, or before the second word of its first rare pair
                rare = np.append(np.flatnonzero(~held(h)), many)
                alone = np.append(np.flatnonzero(~held(pair)), many)
                stop = np.minimum(np.minimum(stop, at + max_n), np.minimum(rare[np.searchsorted(rare, at)], alone[np.searchsorted(alone, at)] + 1))
                # every word after a NUL, so that a suffix is one slice
                data = np.zeros(int(size.sum()) + many, np.uint8)
                before = np.cumsum(size + 1) - size
                data[np.arange(int(size.sum())) + np.repeat(at, size) + 1] = buf[WORD[buf]]
                long = np.where(stop > at, before[stop - 1] + size[stop - 1] - before + 1, 0)
                for tails, n in _counted(_slices(data, before - 1, long)):
                    keys = pc.binary_join_element_wise(pa.scalar(lang, pa.binary()), tails, pa.scalar(b"", pa.binary()))
                    yield pa.RecordBatch.from_arrays([keys, n.cast(pa.int64())], names=["key", "n"])
        bw.release()

    return docs.mapInArrow(run, "key binary, n long")


def _shared(made: bw.Hashes, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of equal bytes from a and from b on, up to size."""
    out, todo, at = size.copy(), np.flatnonzero(size > 0), 0
    while len(todo):
        x = made.eight[a[todo] + at] ^ made.eight[b[todo] + at]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        out[todo[differ]] = np.minimum(size[todo[differ]], at + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        at += 8
        todo = todo[~differ & (size[todo] > at)]
    return out


class PrefixStack:
    """Counts of all prefixes of keys that come in reverse order: one counter for each open prefix."""

    def __init__(self, max_n: int, least: int):
        self.least, self.last = least, None
        self.open, self.first = [0] * (max_n + 1), [True] * (max_n + 1)
        self.out: list[tuple[bytes, int]] = []

    def _close(self, k: int, whole: bool = True) -> None:
        """The open prefix of k words ends; it is given out if it is frequent, or if the border of the range may cut it."""
        if self.open[k] and (self.open[k] >= self.least or self.first[k] or not whole):
            self.out.append((b"\0".join(self.last.split(b"\0")[: k + 1]), self.open[k]))
        if self.open[k]:
            self.first[k] = False
        self.open[k] = 0

    def take(self, keys: pa.Array, n: np.ndarray) -> None:
        """The next keys, with their counts."""
        joined = pa.concat_arrays([pa.array([self.last or b""], pa.large_binary()), keys.cast(pa.large_binary())])
        _, offs, data = joined.buffers()
        off = np.frombuffer(offs, np.int64, len(joined) + 1)
        buf = np.frombuffer(data, np.uint8)[: off[-1]]
        size, depth = np.diff(off), len(self.open)
        # the length of each key's prefix of k words, -1 if it has fewer
        gap = np.flatnonzero(buf == 0)
        of = np.searchsorted(off, gap, side="right") - 1
        ends = np.full((len(joined), depth), -1, np.int64)
        ends[of, np.arange(len(gap)) - np.searchsorted(gap, off[:-1])[of]] = gap - off[of]
        ends[np.arange(len(joined)), np.bincount(of, minlength=len(joined))] = size
        made = bw.Hashes(buf)
        shared = _shared(made, off[1:-1], off[:-2], np.minimum(size[1:], size[:-1]))
        for k in range(depth):
            here, before = ends[1:, k], ends[:-1, k]
            there = np.flatnonzero(here >= 0)
            same = (here == before) & (shared >= here)
            if self.last is None:
                same[0] = False
            if not (len(there) and there[0] == 0 and same[0]):
                self._close(k)
            if not len(there):
                self.first[k] = False
                continue
            begins = np.flatnonzero(~same[there])
            if not (len(begins) and begins[0] == 0):
                begins = np.append(0, begins)
            sums = np.add.reduceat(n[there], begins)
            if there[0] == 0 and same[0]:
                sums[0] += self.open[k]
            # only the run of the very first key may have been cut before it
            cut = self.first[k] and there[0] == 0
            full = sums[:-1] if there[-1] == len(n) - 1 else sums
            for j in np.flatnonzero((full >= self.least) | (np.arange(len(full)) == 0) & cut).tolist():
                at = there[begins[j]] + 1
                self.out.append((buf[off[at] : off[at] + ends[at, k]].tobytes(), int(full[j])))
            self.open[k] = int(sums[-1]) if len(full) < len(sums) else 0
            self.first[k] = bool(cut and len(full) == 0)
        self.last = keys[len(keys) - 1].as_py()

    def end(self) -> None:
        """The range ends: what is open may go on in the next one."""
        for k in range(len(self.open)):
            self._close(k, whole=False)


def phrase_counts(docs: DataFrame, max_n: int = 4, least: int = 30) -> DataFrame:
    """lang, words (array; none: all words of the language), f: every phrase of up to max_n words, found inside pieces,
    that occurs ``least`` times or more. docs: text, lang. The scan of words is written and deleted at the session's end."""
    given = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    frequent = frequent_bits(hash_counts(given), least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = PrefixStack(max_n, least)

        def out() -> pa.RecordBatch:
            parts = [[plain(p).decode("utf-8", "surrogatepass") for p in key.split(b"\0")] for key, _ in stack.out]
            arrays = [pa.array([p[0] for p in parts], pa.string()), pa.array([p[1:] for p in parts], pa.list_(pa.string())), pa.array([n for _, n in stack.out], pa.int64())]
            stack.out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "words", "f"])

        for batch in batches:
            if batch.num_rows:
                stack.take(batch.column(0), batch.column(1).to_numpy())
            if len(stack.out) > 10_000:
                yield out()
        stack.end()
        yield out()

    # written, as ranges are laid out by a first look at the rows
    rows = scratch.written(suffixes(given, frequent, max_n), "suffixes").repartitionByRange("key").sortWithinPartitions(F.desc("key"))
    whole = rows.mapInArrow(run, "lang string, words array<string>, f long").groupBy("lang", "words").agg(F.sum("f").alias("f"))
    return whole.where((F.col("f") >= least) | (F.size("words") == 0))


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def _wide(c: Column) -> Column:
    """A number whose products do not pass what can be held."""
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, top: int = 2000, scale: int = 2_000_000, absorbed: int = 80) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a (its occurrences), l and r (those of its parts at the cut that
    scores lowest, the first of such), n (words of the language), score = scale * a div (l + r).

    Candidates have 2 to max_n words and a >= least. One that lies inside a longer candidate which has at least ``absorbed``
    percent of its occurrences goes. Order: score and a descending, then phrase by bytes."""
    counts = scratch.written(phrase_counts(docs, max_n, least).withColumn("phrase", _phrase(F.col("words"))), "phrases")
    total = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    of = counts.where(F.size("words") > 0).select("lang", "phrase", "f")
    found = counts.where(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    k = F.col("k")
    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _phrase(F.slice("words", F.lit(1), k)).alias("first"), _phrase(F.slice("words", k + 1, F.size("words") - k)).alias("rest")
    )
    cuts = cuts.join(of.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(of.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.withColumn("score", F.expr(f"CAST({scale} AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.*")
    size, inner = F.size("words"), F.sequence(F.lit(2), F.size("words") - 1)
    places = F.flatten(F.transform(inner, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _phrase(F.slice("words", i, m)))))
    longer = found.where(size > 2).select("lang", F.col("a").alias("f"), F.explode(F.array_distinct(places)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("f").isNull() | (_wide(F.col("f")) * 100 < _wide(F.col("a")) * absorbed))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = r"""WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS p FROM documents)
), gram AS (
  SELECT lang, w[i:i + k - 1] AS words FROM piece, unnest(range(1, 5)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i)
), f AS (
  SELECT lang, words, array_to_string(words, ' ') AS phrase, count(*)::HUGEINT AS f FROM gram GROUP BY lang, words
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(words) = 1 GROUP BY lang
), candidate AS (
  SELECT lang, words, phrase, f AS a FROM f WHERE len(words) > 1 AND f >= 30
), cut AS (
  SELECT c.lang, c.words, c.phrase, c.a, k, x.f AS l, y.f AS r, (2000000 * c.a) // (x.f + y.f) AS score
  FROM candidate c, unnest(range(1, len(c.words))) AS s(k) JOIN f x ON x.lang = c.lang AND x.words = c.words[1:k] JOIN f y ON y.lang = c.lang AND y.words = c.words[k + 1:]
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), inner_part AS (
  SELECT lang, words[i:i + m - 1] AS words, a FROM candidate, unnest(range(2, len(words))) AS s(m), unnest(range(1, len(words) - m + 2)) AS t(i)
), longest AS (
  SELECT lang, words, max(a) AS f FROM inner_part GROUP BY lang, words)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM lowest LEFT JOIN longest USING (lang, words) JOIN total USING (lang) WHERE f IS NULL OR 100 * f < 80 * a QUALIFY rank <= 2000"""
