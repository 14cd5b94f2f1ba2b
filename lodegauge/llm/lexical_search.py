"""Ranked lexical search: the k best documents of each item by a sum of integer term scores, through inverted treaps.

Three steps:

1. One scan of the texts keeps, for each document, its number of terms and the asked terms it holds with their counts, as a
   written narrow table; whole texts are never exchanged. The numbers of documents and terms and the documents of each
   asked term are summed from it.
2. Each task takes its documents in blocks of up to BLOCK_POSTINGS postings (one document at least). In a block every term
   has a treap: a search tree over documents in order of doc_id that is a heap over impacts (ties in a drawn order, so that
   it is not deep). All items descend their terms' treaps together: an interval of documents keeps, for each term, the
   node of the greatest impact inside it, and goes if the weighted sum of these maxima cannot enter the item's k best.
   Intervals are halved; one document's sum is its exact score. The k best of a task carry on from block to block.
3. The tasks' best are merged, first within shares of the documents, then by item.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case only. Items are searched in
blocks of about ITEM_BYTES of text, so what tasks hold of them is bounded but for one longer item.

Null and empty texts have no terms and are counted nowhere; items without a term, or whose terms no document holds, have
no rows, nor has an empty table. Equal scores go to smaller doc_ids, null ones first. Repeated rows of documents are
documents of their own; repeated rows of items count once, and different texts under one item_id are ranked by themselves.
Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.llm import bytewords as bw
from lodegauge.sources import scratch

#: Postings of a block, some 60 bytes each while its treaps are made.
BLOCK_POSTINGS = 1 << 20
#: Bytes of items that are searched at once.
ITEM_BYTES = 4 << 20
#: Intervals that descend at once.
CHUNK = 1 << 13
#: Numbers that stand for a null doc_id inside a task; smaller than any other.
NULL_ID = -(1 << 63)

MEMBER = bw.LETTER.copy()
MEMBER[0x30:0x3A] = True
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Asked:
    """The terms of a block of items: their bytes, hashes in order, and each item's terms with their repeats."""

    def __init__(self, texts: list[str]):
        counted = [Counter(t.lower() for t in _TERM.findall(text.encode("utf-8", "surrogatepass"))) for text in texts]
        terms = sorted({t for c in counted for t in c})
        size = np.array([len(t) for t in terms], np.int64)
        end = np.cumsum(size)
        buf = np.frombuffer(b"".join(terms), np.uint8) if terms else np.zeros(0, np.uint8)
        made = bw.Hashes(buf)
        h = made.of(end - size, end)
        order = np.argsort(h)
        self.hashes, self.size, self.start, self.eight = h[order], size[order], (end - size)[order], made.bytes
        number = {terms[i]: k for k, i in enumerate(order.tolist())}
        self.items = [{number[t]: n for t, n in c.items()} for c in counted]

    def __len__(self) -> int:
        return len(self.hashes)

    def found(self, made: bw.Hashes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the terms that slices are, -1 for others; hashes are checked on the bytes."""
        h = made.of(start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        hit = np.flatnonzero((self.hashes[at] == h) & (self.size[at] == end - start))
        known = np.ndarray((len(self.eight) - 7,), "<u8", self.eight, strides=(1,))
        same, left, k = np.ones(len(hit), bool), (end - start)[hit], 0
        while (some := np.flatnonzero(left > k)).size:
            mask = bw._FIRST[np.minimum(left[some] - k, 8)]
            same[some] &= (made.eight[start[hit[some]] + k] & mask) == (known[self.start[at[hit[some]]] + k] & mask)
            k += 8
        out = np.full(len(h), -1, np.int64)
        out[hit[same]] = at[hit[same]]
        return out


def postings(docs: DataFrame, asked: Asked) -> DataFrame:
    """doc_id, n (terms of the document), terms and tf (the asked ones it holds), of documents with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, off in bw.blocks(batch, 1, 1 << 21):
                start, end, row = bw.spans(buf, off, MEMBER)
                n = np.bincount(row, minlength=b - a)
                term = asked.found(bw.Hashes(bw.LOWER[buf]), start, end) if len(start) else start
                key, tf = np.unique(row[term >= 0] * len(asked) + term[term >= 0], return_counts=True)
                holds = np.flatnonzero(n)
                cut = pa.array(np.searchsorted(key, np.append(holds, b - a) * len(asked)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(v.astype(np.int32))) for v in (key % len(asked), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(holds)), pa.array(n[holds].astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def treaps(first: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right (-1: none) and roots of the treaps over runs impact[first[t]:first[t + 1]], which are in search order;
    one pass with a stack. An empty run has the root -1."""
    left, right = np.full(len(impact) + 1, -1, np.int32), np.full(len(impact) + 1, -1, np.int32)
    roots, drawn = np.full(len(first) - 1, -1, np.int32), np.random.default_rng(7).permutation(len(impact))
    high = (impact.astype(np.int64) << 31 | drawn).tolist()
    lefts, rights = left.tolist(), right.tolist()
    for t in np.flatnonzero(np.diff(first)).tolist():
        stack: list[int] = []
        for i in range(first[t], first[t + 1]):
            x, last = high[i], -1
            while stack and high[stack[-1]] < x:
                last = stack.pop()
            lefts[i] = last
            if stack:
                rights[stack[-1]] = i
            stack.append(i)
        roots[t] = stack[0]
    return np.array(lefts, np.int32), np.array(rights, np.int32), roots


class Best:
    """The k best (score, doc_id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        none = np.zeros(0, np.int64)
        self.item, self.score, self.doc = none, none, none
        #: What a document must beat: the k-th score and its doc_id; a score of 1 and any doc_id while there are fewer.
        self.least, self.last = np.ones(items, np.int64), np.full(items, np.iinfo(np.int64).max)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.k
        self.item, self.score, self.doc = item[kept], score[order][kept], doc[order][kept]
        kth = np.flatnonzero(rank[kept] == self.k - 1)
        self.least[self.item[kth]], self.last[self.item[kth]] = self.score[kth], self.doc[kth]


def search_block(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Add to best the best documents of a block: postings (doc, term, impact), doc a place in ids, which ascend; terms and
    weights of each item, padded by weight 0. The number of intervals that were looked at."""
    order = np.lexsort((doc, term))
    doc, impact = np.append(doc[order], -1).astype(np.int32), np.append(impact[order], 0)
    first = np.searchsorted(term[order], np.arange(int(terms.max(initial=0)) + 2))
    left, right, roots = treaps(first, impact[:-1])

    def inside(node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first node from each one downwards whose document is in [lo, hi): the greatest impact there."""
        flat, lo, hi = node.ravel(), np.repeat(lo, node.shape[1]), np.repeat(hi, node.shape[1])
        todo = np.flatnonzero(flat >= 0)
        while len(todo):
            at = flat[todo]
            x = doc[at]
            low, high = x < lo[todo], x >= hi[todo]
            todo = todo[out := low | high]
            flat[todo] = np.where(low[out], right[at[out]], left[at[out]])
            todo = todo[flat[todo] >= 0]
        return flat.reshape(node.shape)

    def bounds(item: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", impact[node], weights[item])

    def alive(item: np.ndarray, lo: np.ndarray, bound: np.ndarray) -> np.ndarray:
        least = best.least[item]
        return (bound > least) | ((bound == least) & (ids[lo] < best.last[item]))

    items = np.arange(len(terms))
    node = np.where(weights > 0, roots[terms], -1)
    held = [(items, np.zeros(len(items), np.int32), np.full(len(items), len(ids), np.int32), node, bounds(items, node))]
    seen = 0
    while held:
        item, lo, hi, node, bound = held.pop()
        if len(item) > CHUNK:
            held.append(tuple(x[:-CHUNK] for x in (item, lo, hi, node, bound)))
            item, lo, hi, node, bound = (x[-CHUNK:] for x in (item, lo, hi, node, bound))
        ok = alive(item, lo, bound)
        one = ok & (hi - lo == 1)
        if one.any():
            best.add(item[one], bound[one], ids[lo[one]])
        ok &= ~one
        item, lo, hi, node = item[ok], lo[ok], hi[ok], node[ok]
        if not len(item):
            continue
        seen += len(item)
        middle = (lo + hi) // 2
        node = np.concatenate([inside(node.copy(), lo, middle), inside(node, middle, hi)])
        item, lo, hi = np.tile(item, 2), np.concatenate([lo, middle]), np.concatenate([middle, hi])
        bound = bounds(item, node)
        ok = np.flatnonzero(alive(item, lo, bound))
        ok = ok[np.argsort(bound[ok], kind="stable")]  # the most promising at the end, where the next ones are taken
        held.append((item[ok], lo[ok], hi[ok], node[ok], bound[ok]))
    return seen


def _searched(held: DataFrame, asked: Asked, weight: dict[int, int], documents: int, total: int, k: int) -> DataFrame:
    """Each task's k best: item (its number), doc_id, score."""
    wide = max(len(x) for x in asked.items)
    terms, weights = np.zeros((len(asked.items), wide), np.int64), np.zeros((len(asked.items), wide), np.int64)
    for i, counts in enumerate(asked.items):
        terms[i, : len(counts)], weights[i, : len(counts)] = list(counts), [n * weight.get(t, 0) for t, n in counts.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, parts, size = Best(len(terms), k), [], 0

        def block() -> None:
            ids = np.concatenate([p[0] for p in parts])
            n, many = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            term, tf = np.concatenate([p[3] for p in parts]).astype(np.int64), np.concatenate([p[4] for p in parts]).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            norm = 75 + 25 * n * documents // total
            row = np.repeat(np.arange(len(ids)), many)
            search_block(place[row], term, 1_000_000_000 * tf // (1000 * tf + 12 * norm[row]), ids[order], terms, weights, best)

        for batch in batches:
            step = max(1, batch.num_rows * BLOCK_POSTINGS // max(1, len(batch.column(2).flatten())) // 4)
            for a in range(0, batch.num_rows, step):
                b = batch.slice(a, step)
                term, tf = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                parts.append((b.column(0).fill_null(NULL_ID).to_numpy(), b.column(1).to_numpy(), b.column(2).value_lengths().to_numpy(), term, tf))
                size += len(term)
                if size >= BLOCK_POSTINGS:
                    block()
                    parts, size = [], 0
        if size:
            block()
        bw.release()
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.doc == NULL_ID), pa.array(best.score)], names=["item", "doc_id", "score"])

    return held.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): each item's k best of all documents with a score above 0.

    docs: doc_id, text; items: item_id, text. The documents' narrow table is kept in the shared folder until the driver's
    JVM ends."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    given = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    given = scratch.written(given, "items")
    blocks = max(1, -(-(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    out = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # about ITEM_BYTES
        asked = Asked([r["text"] for r in rows])
        if not len(asked):
            continue
        held = scratch.written(postings(docs, asked), "postings")
        documents, total = held.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        df = held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row an asked term
        weight = {r["term"]: math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1))) for r in df}
        found = _searched(held, asked, weight, documents, total, k)
        found = _ranked(found, ["item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], k).drop("rank")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind.simpleString()}")
        out = out.unionByName(_ranked(found, ["item"], k).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOW.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""WITH held AS (
  SELECT doc_id, t, len(t)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM held
), item AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
), posting AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM held) WHERE term IN (SELECT term FROM item) GROUP BY ALL
), weight AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, total GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM posting JOIN weight USING (term) JOIN item USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20"""
