"""N-gram Jaccard self-join through count-vector R-trees.

A document is its set of distinct word shingles. Tokens (shingles) are hashed into groups, and a document becomes a
point: its number of tokens in each group. The overlap of two sets is at most the sum over groups of the smaller count,
and for boxes the sum of the smaller upper corners. An R-tree over the points, bulk-loaded by halving along the widest
axis, is joined with itself from the root down: pairs of nodes whose bound cannot reach the threshold go with all that
is below them. What survives is verified on the shingles themselves, not on their hashes.

One tree over a whole corpus would visit nearly all leaves, so points are first dealt to many small trees without losing
a pair. Two sets of at most S tokens with Jaccard p/100 differ in at most T = 2 S (100 - p) / (100 + p) tokens. With
T + 1 + s groups, at least s + 1 groups have no difference; the two documents hold the same tokens there, and could meet
in the tree of any such group and content. S is bounded per size class; a document enters every class in which a partner
of its could be the larger one. A document leaves out its s least telling groups, in an order that depends on a group's
content alone: by tokens that are not common, then by tokens. Of the s + 1 groups that agree the last in that order is
left out by neither document, since it would have to be among s groups with s others of the s + 1 before it. So no pair
is lost, and passages that many documents share seldom bring strangers together. Which tokens are common, and which
groups' contents are (hot ones), is estimated on a bounded sample; a poor estimate costs time and changes no result.

Equal sets are one node, named by their digest, so copies meet nowhere. Up to PAIRED nodes that share a group's content
are bounded pair by pair, by points of as many groups as their size asks for, so that strangers who share a passage part
again. More of them are tied to the least one (those of a hot content to a node of the sample that holds it, known
beforehand, so that hot contents are never gathered); ties that close no ring in their partition are kept, no more than
there are nodes, and pairs that they connect need no bound. The connected components of ties and pairs are the clusters. A cluster of up to CELL nodes and CELL_TOKENS tokens is joined as one R-tree in one task,
which verifies pairs of parts that are not yet connected, emits a link for each that connects two, and passes over boxes
that lie in one part. In larger clusters
every node is first tried against the one that it shares most contents with, then against the least of its contents'
holders across components; what is still apart is joined tree by tree, cut into cells of bounded size, and only pairs
across components are bounded and verified. Every link between different components is found; nothing is capped.

Nulls: a null or wordless text has an empty set and is linked with nothing. A row with a null doc_id can't name a
component and takes the one of its set, or none if no row with a doc_id has that set. Rows that share a doc_id are judged
each by its own text. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.llm import bytewords as bw
from lodegauge.llm.components import components
from lodegauge.sources import scratch

U = np.uint64
#: Groups of the points of large clusters' trees; of clusters that are joined in memory the least and most (more for
#: longer texts, whose counts would not tell them apart), and the numbers that all of a cluster's points may hold.
GROUPS, FINE_GROUPS, POINTS = 64, (256, 4096), 1 << 23
#: Hashed tokens that are kept at a time while a cluster's pairs are verified.
KEPT_TOKENS = 1 << 20
#: Ratio of neighbouring size classes.
RATIO = 1.4
#: Share of spare groups.
SPARE = 0.3
#: Members of a tree, or of a cluster, that one task joins; tokens of such a cluster.
CELL, CELL_TOKENS = 1 << 14, 1 << 23
#: Documents of the sample for common tokens, the documents of it that make a token common, and how many are kept.
SAMPLE_DOCS, COMMON_DOCS, COMMON_MOST = 6000, 6, 200_000
#: Documents of the sample that share a group's content and make it a hot one.
HOT_DOCS = 60
#: Nodes that share a content and are bounded pair by pair; tokens of a group of their points, and the least groups.
PAIRED, GROUP_TOKENS, LEAST_GROUPS = 8, 8, 64
#: Rows that a task holds while it pairs them.
HELD = 1 << 20
#: Points of a leaf; children of an inner node.
LEAF, FAN = 16, 8
#: Pairs of boxes that are bounded together.
STRIP = 4096
#: Sets that a task remembers having named; beyond it some are named again, which costs rows and changes nothing.
SEEN = 200_000


def size_classes(pct: int, largest: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, groups, spares) by class."""
    out, low = [], 1
    while low <= largest:
        high = max(low, math.floor(low * RATIO) - 1)
        needed = 2 * high * (100 - pct) // (100 + pct) + 1
        spares = math.ceil(SPARE * needed) if needed > 1 else 0
        out.append((low, high, needed + spares, spares))
        low = high + 1
    return out


class Common:
    """Whether tokens are among the common ones."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.sort(tokens)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.tokens >> U(44)).astype(np.int64)] = True

    def rare(self, s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), np.int64)
        at = np.flatnonzero(self.maybe[(s >> U(44)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.tokens, s[at]), len(self.tokens) - 1)
            out[at[self.tokens[place] == s[at]]] = 0
        return out


def shingle_hashes(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of every row, and where each row's begin. Shorter rows have one, of all words."""
    low = bw.LOWER[buf]
    s, e, row = bw.spans(low, off, bw.NOT_SPACE)
    w = bw.Hashes(low).of(s, e)
    n = len(off) - 1
    words = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64)

    def chain(at: np.ndarray, length: int) -> np.ndarray:
        h = bw.mix(w[at] + U(length))
        for j in range(1, length):
            h = bw.mix(h * U(0xA0761D6478BD642F) + w[at + j])
        return h

    full = np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
    hashes, rows = [chain(full, k)], [row[full]]
    for length in range(1, k):
        short = np.flatnonzero(words == length)
        hashes.append(chain(first[short], length))
        rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return h[order], np.searchsorted(r[order], np.arange(n + 1))


def row_sets(batch: pa.RecordBatch, column: int, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for a, b, buf, off in bw.blocks(batch, column):
        h, at = shingle_hashes(buf, off, k)
        for i in range(b - a):
            yield np.unique(h[at[i] : at[i + 1]])


def signatures(s: np.ndarray, pct: int, classes: list[tuple[int, int, int, int]], common: Common) -> np.ndarray:
    """One number for each class and group that the set enters: equal for sets that agree in the group."""
    n, out = len(s), []
    spread = bw.mix(s * U(0x9E6C63D0876A9A35) + U(1))
    telling = common.rare(s) * (1 << 24) + 1
    c = next(i for i, x in enumerate(classes) if x[1] >= n)
    while 100 * n >= pct * classes[c][0]:
        _, _, groups, spares = classes[c]
        g = (s % U(groups)).astype(np.int64)
        order = np.argsort(g, kind="stable")
        sorted_g = g[order]
        at = np.flatnonzero(np.concatenate([[True], sorted_g[1:] != sorted_g[:-1]]))
        content, weight = np.zeros(groups, U), np.zeros(groups, np.int64)
        content[sorted_g[at]] = np.add.reduceat(spread[order], at)
        weight[sorted_g[at]] = np.add.reduceat(telling[order], at)
        kept = np.argsort(weight, kind="stable")[spares:]
        out.append(bw.mix(content[kept] + bw.mix(kept.astype(U) * U(1 << 20) + U(c + 1))))
        c += 1
    return np.concatenate(out).view(np.int64)


def may_link(overlap, total, pct: int):
    """Whether an overlap (or a bound on it) of two sets with ``total`` tokens together reaches pct % of the union."""
    return overlap * (100 + pct) >= pct * total


class Tree:
    """An R-tree over points: levels from the leaves to the root, each box with its upper corner and range of sizes."""

    def __init__(self, n: np.ndarray, vec: np.ndarray, points: np.ndarray):
        order, todo = [], [points]
        while todo:  # halve along the widest axis, sizes being one, at whole leaves
            part = todo.pop()
            if len(part) <= LEAF:
                order.append(part)
                continue
            spread = vec[part].max(0) - vec[part].min(0)
            axis = n[part] if np.ptp(n[part]) >= spread.max() else vec[part, int(spread.argmax())]
            half = (len(part) // 2 + LEAF - 1) // LEAF * LEAF
            cut = np.argpartition(axis, half) if half < len(part) else np.arange(len(part))
            todo += [part[cut[half:]], part[cut[:half]]] if half < len(part) else [part[:LEAF], part[LEAF:]]
        self.points = np.concatenate(order)
        #: leaf i holds points[ends[i] : ends[i + 1]]
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in order])]).astype(np.int64)
        at = self.ends[:-1]
        level = (np.maximum.reduceat(vec[self.points], at, axis=0), np.minimum.reduceat(n[self.points], at), np.maximum.reduceat(n[self.points], at))
        self.levels = [level]
        while len(level[1]) > 1:
            at = np.arange(0, len(level[1]), FAN)
            level = (np.maximum.reduceat(level[0], at, axis=0), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at))
            self.levels.append(level)


    def labels(self, level: int, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest component of the points below each box of a level."""
        own, at = comp[self.points], self.ends[:-1][:: FAN**level]
        return np.minimum.reduceat(own, at), np.maximum.reduceat(own, at)

    def leaf(self, i: int) -> np.ndarray:
        return self.points[self.ends[i] : self.ends[i + 1]]


def _children(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[np.ndarray, np.ndarray]:
    """Every child of a with every child of b, of pairs of inner nodes whose lower levels have na and nb boxes."""
    i, j = np.divmod(np.arange(FAN * FAN), FAN)
    x, y = (a[:, None] * FAN + i).ravel(), (b[:, None] * FAN + j).ravel()
    real = (x < na) & (y < nb)
    return x[real], y[real]


def tree_join(n: np.ndarray, vec: np.ndarray, pct: int, p: Tree, q: Tree | None = None, comp: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """R-tree join of two trees, or of one with itself: arrays of pairs of points whose bound reaches the threshold. A
    self-join gives each pair once, in either order. comp: components of the points, which may grow meanwhile; what lies
    in one component is passed over, boxes and all."""
    alone, q = q is None, p if q is None else q
    levels = max(len(p.levels), len(q.levels))
    # a tree of fewer levels waits at its root
    of = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    todo = [(levels - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, a, b = todo.pop()
        if len(a) > STRIP:
            todo += [(k, a[STRIP:], b[STRIP:])]
            a, b = a[:STRIP], b[:STRIP]
        x, y = of(p, k), of(q, k)
        fits = (100 * y[2][b] >= pct * x[1][a]) & (100 * x[2][a] >= pct * y[1][b])
        if alone:
            fits &= a <= b
        if comp is not None:
            low, high = p.labels(min(k, len(p.levels) - 1), comp)
            others = (low, high) if alone else q.labels(min(k, len(q.levels) - 1), comp)
            fits &= (low[a] != high[a]) | (others[0][b] != others[1][b]) | (low[a] != others[0][b])
        a, b = a[fits], b[fits]
        fits = may_link(np.minimum(x[0][a], y[0][b]).sum(1, dtype=np.int64), x[1][a] + y[1][b], pct)
        a, b = a[fits], b[fits]
        if k and len(a):
            wait_p, wait_q = k > len(p.levels) - 1, k > len(q.levels) - 1
            na, nb = len(of(p, k - 1)[1]), len(of(q, k - 1)[1])
            if wait_p or wait_q:  # only the taller tree goes down
                i = np.arange(FAN)
                c = np.repeat(a, FAN) if wait_p else (a[:, None] * FAN + i).ravel()
                d = np.repeat(b, FAN) if wait_q else (b[:, None] * FAN + i).ravel()
                real = (c < na) & (d < nb)
                todo.append((k - 1, c[real], d[real]))
            else:
                todo.append((k - 1, *_children(a, b, na, nb)))
        elif not k:
            for i, j in zip(a.tolist(), b.tolist()):
                mine, theirs = p.leaf(i), q.leaf(j)
                same = alone and i == j
                if comp is not None:
                    own, its = comp[mine], comp[theirs]
                    apart = own[:, None] != its
                    if not apart.any():
                        continue
                overlap = np.minimum(vec[mine][:, None, :], vec[theirs][None, :, :]).sum(2, dtype=np.int64)
                near = may_link(overlap, n[mine][:, None] + n[theirs][None, :], pct)
                if comp is not None:
                    near &= apart
                if same:
                    near &= np.arange(len(mine))[:, None] < np.arange(len(theirs))
                u, v = np.nonzero(near)
                if len(u):
                    yield mine[u], theirs[v]


def tree_pairs(n: np.ndarray, vec: np.ndarray, pct: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of two sets of points whose bound reaches the threshold."""
    got = list(tree_join(n, vec, pct, Tree(n, vec, left), Tree(n, vec, right))) if len(left) and len(right) else []
    none = np.zeros(0, np.int64)
    return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else (none, none)


def counts(s: np.ndarray, groups: int) -> np.ndarray:
    """A set's point: its number of tokens in each group."""
    return np.bincount((bw.mix(s) % U(groups)).astype(np.int64), minlength=groups).astype(np.int32)


def shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    words = text.lower().split()  # both know ASCII only
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(k))))


def linked(s: np.ndarray, t: np.ndarray, a: bytes, b: bytes, k: int, pct: int) -> bool:
    """Whether two texts link: their hashed sets first, then, where these do, their shingles."""
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    if not may_link(int((t[at] == s).sum()), len(s) + len(t), pct):
        return False
    x, y = shingles(a, k), shingles(b, k)
    return bool(may_link(len(x & y), len(x) + len(y), pct))


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as signed numbers."""
    if not len(s):
        return 0, 0
    sums = np.array([np.add.reduce(bw.mix(s + U(0x1F83D9ABFB41BD6B))), np.add.reduce(bw.mix(s ^ U(0x5BE0CD19137E2179)))], U)
    return tuple(sums.view(np.int64).tolist())


def _node(digest: tuple[int, int], clashes: frozenset[int]) -> int:
    """The node of a set: half its digest, without the last bit, or the other half where two sets agree in the first."""
    return (digest[1] if (digest[0] & ~1) in clashes else digest[0]) & ~1


def sketch(s: np.ndarray) -> bytes:
    """A set's point, with a power of two of groups that grows with the set: a mark of the type, and the counts."""
    if not len(s):
        return b""
    groups = max(LEAST_GROUPS, 1 << max(0, (len(s) - 1) // GROUP_TOKENS).bit_length())
    c = counts(s, groups)
    return b"1" + c.astype(np.uint8).tobytes() if c.max() < 256 else b"4" + c.tobytes()


def unsketched(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if raw[:1] == b"1" else np.int32, offset=1).astype(np.int64)


def sketch_bound(a: bytes, b: bytes) -> int:
    """The most tokens that two sets can share. Groups are numbers modulo a power of two, so the finer point folds."""
    x, y = unsketched(a), unsketched(b)
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(0), y.reshape(-1, n).sum(0)).sum())


def _summaries(k: int) -> Callable:
    def f(batches):
        for b in batches:
            got = [(len(s), *_digest(s), sketch(s)) for s in row_sets(b, 1, k)]
            columns = zip(*got) if got else ((), (), (), ())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(columns, types))], names=["doc_id", "n", "s1", "s2", "vec"])

    return f


def _sample(texts: DataFrame) -> DataFrame:
    """About SAMPLE_DOCS texts, drawn by a hash of the key; one for each key."""
    share = SAMPLE_DOCS / max(1, texts.count())
    u = F.shiftrightunsigned(F.xxhash64(F.lit("shingles"), "doc_id"), 11).cast("double") / float(1 << 53)
    return texts.where(u < share).groupBy("doc_id").agg(F.min("text").alias("text"))


def common_tokens(sample: DataFrame, k: int) -> np.ndarray:
    """The commonest tokens of a sample of documents; COMMON_MOST at most."""

    def tokens(batches):
        for b in batches:
            sets = list(row_sets(b, 1, k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())], names=["token"])

    counted = sample.mapInArrow(tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_DOCS)
    return np.array([r["token"] for r in counted.orderBy(F.desc("n"), "token").limit(COMMON_MOST).collect()], np.int64).view(U)


class Named:
    """The (sig, node) of sets, each set named once, by the first row that has it, as far as this task's memory goes. A
    signature's last bit is 0. leaders: the hot signatures, as sorted numbers, and a node of each; these are given as the
    leader with last bit 1, once a leader."""

    def __init__(self, pct: int, common: np.ndarray, clashes: frozenset[int], leaders: tuple[np.ndarray, np.ndarray] | None = None):
        self.pct, self.classes, self.common, self.clashes, self.leaders = pct, size_classes(pct), Common(common), clashes, leaders
        self.seen: set[int] = set()

    def of(self, s: np.ndarray) -> tuple[np.ndarray, int] | None:
        if not len(s) or (node := _node(_digest(s), self.clashes)) in self.seen:
            return None
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(node)
        sigs = signatures(s, self.pct, self.classes, self.common) & ~1
        if self.leaders is not None and len(self.leaders[0]):
            known, lead = self.leaders
            at = np.minimum(np.searchsorted(known, sigs), len(known) - 1)
            hot = known[at] == sigs
            if hot.any():
                sigs = np.concatenate([sigs[~hot], np.unique(lead[at[hot]]) | 1])
        return sigs, node


def _signed(k: int, make: Callable[[], Named], column: int = 1) -> Callable:
    def f(batches):
        named = make()

        def rows(out, nodes):
            node = np.repeat(np.array(nodes, np.int64), [len(x) for x in out])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(node)], names=["sig", "node"])

        for b in batches:
            out, nodes, n = [], [], 0
            for s in row_sets(b, column, k):
                if (got := named.of(s)) is None:
                    continue
                out.append(got[0])
                nodes.append(got[1])
                n += len(got[0])
                if n > 1 << 18:
                    yield rows(out, nodes)
                    out, nodes, n = [], [], 0
            if out:
                yield rows(out, nodes)

    return f


def meetings(key: np.ndarray, sig: np.ndarray, node: np.ndarray) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Of rows in order of their key and node: the ends of ties that close no ring, and the ends of pairs to be bounded
    that these ties don't connect. A row whose sig has last bit 1 knows its leader."""
    led = (sig & 1) == 1
    hot_u, hot_v = node[led], sig[led] - 1
    key, node = key[~led], node[~led]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([at, [len(key)]])).astype(np.int64)
    first = np.repeat(node[at], size) if len(at) else node
    big = np.repeat(size > PAIRED, size) & (node != first)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    us, vs = [], []
    for u, v in zip(np.concatenate([hot_u, node[big]]).tolist(), np.concatenate([hot_v, first[big]]).tolist()):
        p, q = root(u), root(v)
        if p != q:
            up[max(p, q)] = min(p, q)
            us.append(u)
            vs.append(v)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, PAIRED + 1):
        of = at[size == n]
        for i in range(n):
            for j in range(i):
                left.append(node[of + i])
                right.append(node[of + j])
    x, y = np.concatenate(left), np.concatenate(right)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)] & (x != y)
    x, y = x[new], y[new]
    if up and len(x):
        known, which = np.unique(np.concatenate([x, y]), return_inverse=True)
        tied = np.array([root(i) if i in up else i for i in known.tolist()], np.int64)[which]
        apart = tied[: len(x)] != tied[len(x) :]
        x, y = x[apart], y[apart]
    return us, vs, x, y


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, sure) of rows (key, sig, node) in order: sure ties, and pairs that wait for their bound."""
    held = [np.zeros(0, np.int64)] * 3

    def out(rows):
        us, vs, x, y = meetings(*rows)
        u, v = np.concatenate([np.array(us, np.int64), x]), np.concatenate([np.array(vs, np.int64), y])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.arange(len(u)) < len(us))], names=["u", "v", "sure"])

    for b in batches:
        held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
        if len(held[0]) > HELD:
            # the last key may go on: of a large group its first rows stand for it
            last = len(held[0]) - int((held[0][::-1] != held[0][-1]).argmax()) if held[0][0] != held[0][-1] else 0
            yield out(held)
            held = [h[last : last + PAIRED + 1] for h in held]
    yield out(held)


def _within(pct: int) -> Callable:
    """Of rows (u, v, n_u, n_v, vec_u, vec_v) those whose points may link."""

    def f(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("n_u", "n_v", "vec_u", "vec_v")))
            keep = [100 * min(m, n) >= pct * max(m, n) and bool(may_link(sketch_bound(x, y), m + n, pct)) for m, n, x, y in rows]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("u", "v")], names=["u", "v"])

    return f


def _ties(signed: DataFrame, points: DataFrame, pct: int) -> DataFrame:
    """(u, v) that connect, at least, all nodes that link. points: node, n, vec, once or more."""
    led = F.col("sig").bitwiseAND(1) == 1
    # rows that know their leader are spread by their node
    order = Window.partitionBy("key").orderBy("node")
    rows = signed.withColumn("key", F.when(led, F.col("node")).otherwise(F.col("sig")))
    rows = rows.select("key", "sig", "node", F.lag("node").over(order).alias("before"), F.lead("node").over(order).alias("after"))
    some = rows.where(led | F.col("before").isNotNull() | F.col("after").isNotNull()).select("key", "sig", "node")
    met = scratch.written(some.mapInArrow(_met, "u long, v long, sure boolean"), "met")
    pairs = scratch.written(met.where("not sure").select("u", "v").distinct(), "pairs")
    ends = scratch.written(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "ends")
    known = points.join(scratch.lookup(ends), "node").groupBy("node").agg(F.first("n").alias("n"), F.first("vec").alias("vec"))
    known = scratch.written(known, "points")
    side = lambda c: known.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("vec").alias(f"vec_{c}"))
    near = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "vec_u", "vec_v").mapInArrow(_within(pct), "u long, v long")
    return scratch.written(met.where("sure").select("u", "v").union(near), "ties")


def _found(k: int, clashes: frozenset[int], columns: tuple[str, ...]) -> Callable:
    """Of rows (text, node, ...) those whose text has that node, once each as far as this task's memory goes."""

    def f(batches):
        seen: set[int] = set()
        for b in batches:
            keep = []
            for s, node in zip(row_sets(b, 0, k), b.column(1).to_pylist()):
                keep.append(node not in seen and node == _node(_digest(s), clashes))
                if keep[-1]:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
            yield b.select(list(columns)).filter(pa.array(keep, pa.bool_()))

    return f


class Tokens:
    """The hashed sets of some texts, made when they are asked for; the last KEPT_TOKENS tokens are kept."""

    def __init__(self, texts: list[bytes], k: int):
        self.texts, self.k, self.held, self.size = texts, k, OrderedDict(), 0

    def every(self) -> Iterator[np.ndarray]:
        return row_sets(pa.RecordBatch.from_arrays([pa.array(self.texts, pa.large_binary())], names=["text"]), 0, self.k)

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.held:
            self.held.move_to_end(i)
            return self.held[i]
        h, _ = shingle_hashes(np.frombuffer(self.texts[i], np.uint8), np.array([0, len(self.texts[i])]), self.k)
        self.held[i] = np.unique(h)
        self.size += len(self.held[i])
        while self.size > KEPT_TOKENS and len(self.held) > 1:
            self.size -= len(self.held.popitem(last=False)[1])
        return self.held[i]


def cluster_links(nodes: list[int], texts: list[bytes], k: int, pct: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among a cluster's documents. Pairs of a leaf come first, as they are the
    nearest; the join from the root then passes over boxes of one component, so that copies by the thousand are not tried
    in pairs. Texts and points are held, and few hashed sets at a time."""
    sets = Tokens(texts, k)
    longest = max(len(t) for t in texts)  # some 60 bytes of text a group
    groups = min(max(FINE_GROUPS[0], min(1 << (longest // 60).bit_length(), FINE_GROUPS[1])), max(FINE_GROUPS[0], POINTS // len(texts)))
    n, vec = np.zeros(len(texts), np.int64), np.zeros((len(texts), groups), np.int32)
    for i, s in enumerate(sets.every()):
        n[i], vec[i] = len(s), counts(s, groups)
    tree, comp, out = Tree(n, vec, np.arange(len(texts))), np.arange(len(texts)), []

    def tried(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            if comp[x] != comp[y] and linked(sets[x], sets[y], texts[x], texts[y], k, pct):
                comp[comp == max(comp[x], comp[y])] = min(comp[x], comp[y])
                out.append((nodes[x], nodes[y]))

    if len(tree.levels) > 1:
        for i in range(len(tree.ends) - 1):
            for a, b in tree_join(n, vec, pct, Tree(n, vec, tree.leaf(i))):
                tried(a, b)
    for a, b in tree_join(n, vec, pct, tree, comp=comp):
        tried(a, b)
    return out


def _clusters(k: int, pct: int) -> Callable:
    """Links of clusters whose rows (cluster, node, text) come together, in order of their node."""

    def f(batches):
        cluster, nodes, texts = None, [], []

        def out():
            got = cluster_links(nodes, texts, k, pct) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for b in batches:
            for c, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if c != cluster:
                    yield out()
                    cluster, nodes, texts = c, [], []
                if node not in nodes[-1:]:
                    nodes.append(node)
                    texts.append(text.as_py().encode())
        yield out()
        bw.release()

    return f


def _hubs(k: int, pct: int) -> Callable:
    """Links of rows (hub, chunk, node, text) that come sorted with the hub itself first."""

    def f(batches):
        hub, held, raw = None, None, b""
        for b in batches:
            u, v = [], []
            for h, c, node, s, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), row_sets(b, 4, k), b.column(4)):
                text = text.as_py().encode()
                if node == h:
                    hub, held, raw = (h, c), s, text
                elif hub == (h, c) and linked(s, held, text, raw, k, pct):
                    u.append(node)
                    v.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return f


def _verified(pairs: DataFrame, bodies: DataFrame, k: int, pct: int) -> DataFrame:
    """The links (u, v) among distinct pairs (x, hub): the texts of up to CELL partners go with a copy of the hub's."""
    sizes = scratch.written(pairs.groupBy("hub").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks")), "hubs")
    dealt = pairs.join(scratch.lookup(sizes), "hub").select("hub", F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int").alias("chunk"), F.col("x").alias("node"))
    own = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("hub").alias("node"))
    rows = dealt.union(own).join(bodies, "node").select("hub", "chunk", (F.col("node") != F.col("hub")).alias("other"), "node", "text")
    rows = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "other")
    return scratch.written(rows.mapInArrow(_hubs(k, pct), "u long, v long"), "links")


def _points(k: int) -> Callable:
    def f(batches):
        for b in batches:
            sets = list(row_sets(b, 1, k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([counts(s, GROUPS).tobytes() for s in sets], pa.binary())], names=["node", "n", "vec"]
            )

    return f


def _cells(pct: int) -> Callable:
    """Join the trees' cells, which come sorted: rows (sig, i, j, side, node, comp, n, vec). Cell (i, j) holds chunk i
    and, when j differs, chunk j. Emits pairs (x, hub) across components."""

    def joined(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n, vec, comp, node = rows["n"], rows["vec"], rows["comp"], rows["node"]
        left, right = np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1)
        if not len(left) or (rows["i"][0] != rows["j"][0] and not len(right)):
            return
        for a, b in tree_join(n, vec, pct, Tree(n, vec, left), Tree(n, vec, right) if len(right) else None, comp):
            x, y = node[a], node[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["x", "hub"])

    def f(batches):
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "i", "j", "side", "node", "comp", "n")}
            now["vec"] = np.frombuffer(b"".join(b.column("vec").to_pylist()), np.int32).reshape(-1, GROUPS)
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            new = np.concatenate([[True], (now["sig"][1:] != now["sig"][:-1]) | (now["i"][1:] != now["i"][:-1]) | (now["j"][1:] != now["j"][:-1])])
            at = np.flatnonzero(new)
            for s, e in zip(at[:-1], at[1:]):
                yield from joined({c: v[s:e] for c, v in now.items()})
            held = {c: v[at[-1] :] for c, v in now.items()}
        if held is not None:
            yield from joined(held)

    return f


def _open(trees: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, node, comp, members, least, its) of the trees whose nodes lie in several components, of trees with the same
    nodes one. least: the tree's least node; its: that one's component."""
    comp = scratch.written(components(links), "near")
    named = trees.join(comp, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("comp"))
    kinds = named.groupBy("sig").agg(
        F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("node", "comp")).alias("first"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("b"),
    ).where("lo <> hi")
    one = kinds.groupBy("members", "a", "b").agg(F.min("sig").alias("sig"), F.first("first").alias("first"))
    some = scratch.written(one.select("sig", "members", F.col("first.node").alias("least"), F.col("first.comp").alias("its")), "open")
    return scratch.written(named.join(scratch.lookup(some), "sig"), "apart")


def _cell_pairs(apart: DataFrame, points: DataFrame, pct: int) -> DataFrame:
    """Pairs (x, hub) across components that the trees' joins leave."""
    chunks = F.ceil(F.col("members") / CELL).cast("int")
    rows = apart.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    # rows are dealt before they are repeated, as those of a large tree come together
    cells = rows.repartition("sig", "node").withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
        "sig", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        F.when(F.col("chunk") > F.col("other"), 1).otherwise(0).alias("side"), "node", "comp",
    )
    full = cells.join(points, "node").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return full.select("sig", "i", "j", "side", "node", "comp", "n", "vec").mapInArrow(_cells(pct), "x long, hub long").distinct()


def _large_links(large: DataFrame, texts: DataFrame, ties: DataFrame, k: int, pct: int, common, clashes: frozenset[int]) -> DataFrame:
    """Links that connect what is connected among the nodes of large clusters. large: node, doc_id."""
    held = texts.join(scratch.lookup(large), "doc_id").select("text", "node").mapInArrow(_found(k, clashes, ("node", "text")), "node long, text string")
    bodies = scratch.written(held.dropDuplicates(["node"]), "bodies")
    own = ties.join(large.select(F.col("node").alias("u")), "u", "left_semi").groupBy("u", "v").agg(F.count("*").alias("n"))
    nearest = own.groupBy(F.col("u").alias("x")).agg(F.max_by("v", F.struct("n", "v")).alias("hub"))
    links = _verified(scratch.written(nearest, "pairs"), bodies, k, pct)
    trees = scratch.written(bodies.mapInArrow(_signed(k, lambda: Named(pct, common.value, clashes)), "sig long, node long"), "trees")
    apart = _open(trees, links)
    star = apart.where("comp <> its").select(F.col("node").alias("x"), F.col("least").alias("hub")).distinct()
    links = scratch.written(links.union(_verified(scratch.written(star, "pairs"), bodies, k, pct)), "links")
    apart = _open(trees, links)
    points = scratch.written(bodies.mapInArrow(_points(k), "node long, n long, vec binary"), "points")
    return links.union(_verified(scratch.written(_cell_pairs(apart, points, pct), "pairs"), bodies, k, pct))


def _members(ties: DataFrame, reps: DataFrame) -> DataFrame:
    """node, cluster, doc_id (of a row that has it) and whether the cluster is small, for every node that met another."""
    coarse = scratch.written(components(ties), "coarse")
    ends = coarse.select("node", "component").union(coarse.select("component", "component").distinct())
    named = scratch.written(ends.join(reps, "node").select("node", F.col("component").alias("cluster"), F.col("rep").alias("doc_id"), "n"), "clusters")
    large = named.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("t")).where(f"m > {CELL} or t > {CELL_TOKENS}").select("cluster", F.lit(True).alias("large"))
    large = scratch.lookup(scratch.written(large, "large"))
    return scratch.written(named.join(large, "cluster", "left").select("node", "cluster", "doc_id", F.col("large").isNull().alias("small")), "members")


def _links(texts: DataFrame, points: DataFrame, reps: DataFrame, k: int, pct: int, clashes: frozenset[int]) -> DataFrame:
    """Links (u, v) of nodes that connect what is connected."""
    context = texts.sparkSession.sparkContext
    known = texts.where("doc_id is not null")
    sample = scratch.written(_sample(known), "sample")
    common = context.broadcast(common_tokens(sample, k))
    plain = lambda: Named(pct, common.value, clashes)
    shared = sample.mapInArrow(_signed(k, plain), "sig long, node long").groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where(F.col("n") >= HOT_DOCS)
    hot = sorted((r["sig"], r["lead"]) for r in shared.collect())  # at most the sample's signatures / HOT_DOCS
    leaders = context.broadcast((np.array([h[0] for h in hot], np.int64), np.array([h[1] for h in hot], np.int64)))
    signed = known.mapInArrow(_signed(k, lambda: Named(pct, common.value, clashes, leaders.value)), "sig long, node long")
    ties = _ties(signed, points, pct)
    members = _members(ties, reps)
    small = known.join(scratch.lookup(members.where("small").select("doc_id", "node", "cluster")), "doc_id").select("text", "node", "cluster")
    near = small.mapInArrow(_found(k, clashes, ("cluster", "node", "text")), "cluster long, node long, text string")
    links = scratch.written(near.repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(_clusters(k, pct), "u long, v long"), "links")
    large = members.where("not small").select("node", "doc_id")
    if large.limit(1).count():
        links = links.union(_large_links(scratch.written(large, "far"), known, ties, k, pct, common, clashes))
    return links


def _grouped(texts: DataFrame, k: int, pct: int) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(doc_id, n, s1, s2, vec) of every row; (n, s1, s2, node, root, rep, component) of every set that is not empty and has
    copies or links: root is the same for sets that links connect, component the least doc_id among these."""
    sets = scratch.written(texts.mapInArrow(_summaries(k), "doc_id long, n long, s1 long, s2 long, vec binary"), "sets")
    half = F.col("s1").bitwiseAND(~1)
    reps = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = scratch.written(reps.withColumn("half", half), "sets")
    # sets that agree in half their digest: none but for chance, one in 2**64 pairs
    clashes = frozenset(r["half"] for r in reps.groupBy("half").count().where("count > 1").select("half").collect())
    if clashes:
        half = F.when(half.isin(list(clashes)), F.col("s2").bitwiseAND(~1)).otherwise(half)
    reps = reps.drop("half").withColumn("node", half)
    points = sets.where("n > 0").select(half.alias("node"), "n", "vec")
    with scratch.scope() as keep:
        keep(found := components(_links(texts, points, reps, k, pct, clashes)))
    ends = scratch.written(found.union(found.select("component", "component").distinct()).join(reps.select("node", "rep"), "node"), "ends")
    least = scratch.written(ends.groupBy("component").agg(F.min("rep").alias("its")), "least")
    its = scratch.written(ends.join(least, "component").select("node", F.col("component").alias("root"), "its"), "its")
    groups = reps.join(its, "node", "left").where("copies > 1 or its is not null").select(
        "n", "s1", "s2", "node", F.coalesce("root", "node").alias("root"), "rep", F.coalesce("its", "rep").alias("component")
    )
    return sets, scratch.written(groups, "groups"), clashes


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def jaccard_components(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    sets, groups, _ = _grouped(_texts(docs), k, pct)
    named = scratch.lookup(groups.select("n", "s1", "s2", "component"))
    return sets.join(named, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _marked(k: int, names: list[str]) -> Callable:
    """Rows with n, s1, s2 of their text, which is the last column and goes."""

    def f(batches):
        for b in batches:
            got = [(len(s), *_digest(s)) for s in row_sets(b, len(names) + 1, k)]
            columns = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) + 1], *(pa.array(x, pa.int64()) for x in columns)], names=[*names, "__id", "__n", "__s1", "__s2"])

    return f


def one_of_each(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """One row of each group of equal or linked texts, in the columns docs came with: of the rows with the group's least
    doc_id one (of several texts under it, the one of the least node). Texts without a word all stay, as do texts linked
    with nothing. Rows are told apart by doc_id, and only where that does not suffice (it is null or repeated) by their
    text once more; rows with a null doc_id stand for a group only where it has no other."""
    sets, groups, _ = _grouped(_texts(docs), k, pct)
    best = scratch.written(groups.where("rep = component").groupBy("root").agg(F.min("node").alias("best")), "best")
    ruled = groups.join(scratch.lookup(best), "root", "left").select("n", "s1", "s2", "rep", (F.col("component").isNull() | (F.col("node") == F.col("best"))).alias("stays"))
    ruled = scratch.lookup(scratch.written(ruled, "ruled"))
    rows = sets.join(ruled, ["n", "s1", "s2"]).select("doc_id", "n", "s1", "s2", (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("stays"))
    rows = scratch.written(rows, "rows")
    dropped = scratch.written(rows.where("not stays and doc_id is not null").select("doc_id").distinct(), "dropped")
    many = F.count("*").alias("rows")
    shared = sets.join(scratch.lookup(dropped), "doc_id", "left_semi").groupBy("doc_id").agg(many).where("rows > 1").select("doc_id")
    again = rows.where("stays").groupBy("doc_id", "n", "s1", "s2").agg(many).where("rows > 1").select("doc_id")
    unsure = scratch.written(shared.union(again).union(rows.where("doc_id is null").select("doc_id")).distinct(), "unsure")
    key = F.col("doc_id").cast("long")
    gone = scratch.written(dropped.union(unsure).distinct().select(F.col("doc_id").alias("__gone")), "gone")
    if not unsure.limit(1).count():
        taken = {c.lower() for c in docs.columns}
        free = next(f"__gone{i}" for i in range(len(taken) + 1) if f"__gone{i}" not in taken)
        return docs.join(scratch.lookup(gone.withColumnRenamed("__gone", free)), key == F.col(free), "left_anti")
    known, names = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(known, names)], key.alias("__id"), F.col("text").cast("string").alias("__text"))
    clear = plain.join(scratch.lookup(gone), F.col("__id").eqNullSafe(F.col("__gone")), "left_anti").select(*names)
    doubtful = plain.join(scratch.lookup(unsure.select(F.col("doc_id").alias("__gone"))), F.col("__id").eqNullSafe(F.col("__gone")), "left_semi")
    schema = doubtful.drop("__text").schema.add("__n", "long").add("__s1", "long").add("__s2", "long")
    named = ruled.select(F.col("n").alias("__n"), F.col("s1").alias("__s1"), F.col("s2").alias("__s2"), "rep", "stays")
    told = scratch.written(doubtful.mapInArrow(_marked(k, names), schema).join(named, ["__n", "__s1", "__s2"], "left"), "told")
    firsts = told.where("stays and __id <=> rep").dropDuplicates(["__id", "__n", "__s1", "__s2"])
    out = clear.union(told.where("stays is null").select(*names)).union(firsts.select(*names))
    return out.select(*[F.col(n).alias(c) for c, n in zip(known, names)])
