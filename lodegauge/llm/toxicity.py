"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters fire or stay silent on a document: words of a fixed lexicon; words and word beginnings of 4 to 6 bytes, found at
least once, twice or three times, that come with toxic labels far beyond chance; and patterns (shouting, exclamation,
address). The label model is generative: hidden kinds of documents (as the insults of two languages hardly meet, toxic
ones are of several), and for each kind a forest over the voters, so that a voter's firing depends on the kind and on
the one voter that it is tied to. The forest is the heaviest one by the mutual information of voters within the kinds,
and ties need evidence beyond chance; that is how correlations enter, and how ten spellings of one sign come to count
about once. Rates, ties and kinds are fitted by expectation maximisation from the voters' agreements alone, beginning
with signs that fire together; labels decide only which signs are voters and which of the kinds are called toxic. The posteriors are the targets of a logistic regression over the
voters and the groups (ties taken together) that fire, and only that linear model scores documents.

Labels are learnt from rows whose fold (crc32 of the key as text, modulo 4) is not 2, a bounded sample of about
``sample`` labelled documents drawn by a hash of the key, one row for each key (the least text; toxic if any label says
so). Every sign with enough evidence is a voter. Every document is scored on its whole text in one scan without an
exchange.

Nulls: null and empty texts fire no voter and get the score of silence. Rows with a null key, label or text are not
learnt from. Without labels of both kinds every score is 0. Equal texts get equal scores. Extra columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegauge.llm import bytewords as bw
from lodegauge.llm.language_id import fold_of
from lodegauge.sources import scratch

U = np.uint64
#: Common insults in four languages (fixed values).
LEXICON = (
    "idiot idiots stupid moron morons loser losers trash scum worthless pathetic disgusting clown dumb fool jerk liar garbage vermin filth "
    "imbécile crétin débile ordure salaud dummkopf trottel abschaum widerlich wertlos imbécil estúpido basura escoria asqueroso inútil"
).split()
PATTERNS = ("shouting", "exclaiming", "addressing")
ADDRESS = ("you", "your", "du", "dein", "tu", "vous", "usted")
SAMPLE = 8000
#: Signs count up to this often.
TIMES = 3
#: A candidate becomes a voter with this many toxic documents, this share of toxic among those it occurs in, and so
#: little chance, over all candidates, that any of them gets there by labels dealt at random.
LEAST_TOXIC, LEAST_SHARE, CHANCE = 5, 0.8, 0.05
THRESHOLD = 0.3
#: A tie between voters needs this much evidence (twice the log-likelihood that it adds).
TIE = 20.0
#: Documents on which signs that go together must fire to be a kind of their own.
KIND = 10
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_KIND = {"word": 0, 4: 1, 5: 2, 6: 3}


def _lower(column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pc.utf8_lower(column.cast(pa.large_string()))], names=["text"])


def signs(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of every word and word beginning of lower-case texts; then the words of each row and whether it
    addresses someone."""
    s, e, row = bw.spans(buf, off, bw.LETTER)
    h = bw.Hashes(buf)
    out, rows = [_of_kind(h.of(s, e), "word")], [row]
    for n in (4, 5, 6):
        long = np.flatnonzero(e - s >= n)
        out.append(_of_kind(h.of(s[long], s[long] + n), n))
        rows.append(row[long])
    n = len(off) - 1
    address = np.isin(out[0], word_hashes(ADDRESS))
    return np.concatenate(out), np.concatenate(rows), np.bincount(row, minlength=n), np.bincount(row[address], minlength=n) > 0


def _of_kind(h: np.ndarray, kind) -> np.ndarray:
    return bw.mix(h + U(_KIND[kind]))


def word_hashes(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw])
    return _of_kind(bw.Hashes(buf).of(end - np.array([len(r) for r in raw]), end), "word")


def times(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sign, row, how often), each pair of sign and row once."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[at], row[at], np.diff(np.concatenate([at, [len(h)]]))


class Voters:
    """Which voters fire on each row of a batch. A voter is a sign and the number of times it must occur; the patterns
    come last."""

    def __init__(self, hashes: np.ndarray, least: np.ndarray):
        self.order = np.lexsort((least, hashes))
        self.sorted, self.least = hashes[self.order], least[self.order]
        self.n = len(hashes) + len(PATTERNS)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> U(48)).astype(np.int64)] = True

    def fire(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, voter), each pair once."""
        low, raw = _lower(column), pa.RecordBatch.from_arrays([column], names=["text"])
        rows, voters = [], []
        for x, y, buf, off in bw.blocks(low, 0):
            h, r, _, address = signs(buf, off)
            some = np.flatnonzero(self.maybe[(h >> U(48)).astype(np.int64)])
            known = some[np.isin(h[some], self.sorted)]
            sign, r, n = times(h[known], r[known])
            at = np.searchsorted(self.sorted, sign)
            for k in range(TIMES):  # a sign has up to TIMES voters, side by side
                here = np.minimum(at + k, len(self.sorted) - 1)
                hit = (at + k < len(self.sorted)) & (self.sorted[here] == sign) & (self.least[here] <= n)
                rows.append(r[hit] + x)
                voters.append(self.order[here[hit]])
            who = np.flatnonzero(address)
            rows.append(who + x)
            voters.append(np.full(len(who), self.n - 1))
        for x, y, buf, off in bw.blocks(raw, 0):
            capitals = np.concatenate([[0], np.cumsum((buf >= 0x41) & (buf <= 0x5A))])[off]
            letters = np.concatenate([[0], np.cumsum(bw.LETTER[buf])])[off]
            marks = np.concatenate([[0], np.cumsum(buf == 0x21)])[off]
            for k, fires in ((3, 2 * np.diff(capitals) > np.diff(letters)), (2, 20 * np.diff(marks) > np.diff(letters))):
                who = np.flatnonzero(fires & (np.diff(letters) > 0))
                rows.append(who + x)
                voters.append(np.full(len(who), self.n - k))
        none = np.zeros(0, np.int64)
        return (np.concatenate(rows), np.concatenate(voters)) if rows else (none, none)


class LabelModel:
    """Hidden kinds of documents (share[s] of each) and, given the kind, a forest of voters: parent[j] is the voter that j
    is tied to, or -1. rate[j, v, s] is the probability that j fires when its parent's vote is v (0 for roots). toxic:
    which kinds are the class toxic."""

    def __init__(self, share: np.ndarray, parent: np.ndarray, rate: np.ndarray, toxic: np.ndarray | None = None):
        self.share, self.parent, self.rate = share, parent, rate
        self.toxic = np.arange(len(share)) > 0 if toxic is None else toxic

    def joint(self, f: np.ndarray) -> np.ndarray:
        """log P(votes, kind) of each row, for all kinds."""
        out = np.tile(np.log(self.share), (len(f), 1))
        tied = np.where(self.parent[None, :] >= 0, f[:, self.parent], 0).astype(np.int64)
        for s in range(len(self.share)):
            fires = self.rate[np.arange(f.shape[1])[None, :], tied, s]
            out[:, s] += np.log(np.where(f > 0, fires, 1 - fires)).sum(1)
        return out

    def likelihood(self, f: np.ndarray) -> float:
        return float(np.logaddexp.reduce(self.joint(f), axis=1).sum())

    def kinds(self, f: np.ndarray) -> np.ndarray:
        """Posterior of each kind by row."""
        j = self.joint(f)
        return np.exp(j - np.logaddexp.reduce(j, axis=1)[:, None])

    def posterior(self, f: np.ndarray) -> np.ndarray:
        """Posterior of toxic by row."""
        return self.kinds(f)[:, self.toxic].sum(1)

    def groups(self) -> np.ndarray:
        """The tree of each voter, by number."""
        root = np.arange(len(self.parent))
        while (up := np.where(self.parent[root] >= 0, self.parent[root], root)).tolist() != root.tolist():
            root = up
        return np.unique(root, return_inverse=True)[1]


def forest(f: np.ndarray, r: np.ndarray, tie: float = TIE) -> np.ndarray:
    """The parents of the heaviest forest by the mutual information of voters within the kinds (r: posteriors of kinds by
    row); ties that add less than ``tie`` to twice the log-likelihood are left out."""
    m = f.shape[1]
    gain = np.zeros((m, m))
    for s in range(r.shape[1]):
        both, n = (f * r[:, s : s + 1]).T @ f, max(float(r[:, s].sum()), 1e-9)
        one = np.diag(both)
        cells = ((both, one[:, None] * one[None, :]), (one[:, None] - both, one[:, None] * (n - one)[None, :]), (one[None, :] - both, (n - one)[:, None] * one[None, :]), (n - one[:, None] - one[None, :] + both, (n - one)[:, None] * (n - one)[None, :]))
        for x, apart in cells:
            x = np.maximum(x, 0)
            gain += 2 * x * np.log(np.where((x > 1e-9) & (apart > 1e-12), x * n / np.maximum(apart, 1e-12), 1.0))
    parent, near, weight, todo = np.full(m, -1), np.full(m, -1), np.full(m, tie), np.ones(m, bool)
    for _ in range(m):  # Prim's, from the first voter that is left where no tie is
        j = int(np.where(todo, weight, -np.inf).argmax())
        todo[j] = False
        parent[j] = near[j]
        closer = todo & (gain[j] > weight)
        weight[closer], near[closer] = gain[j][closer], j
    return parent


def refit(f: np.ndarray, r: np.ndarray, parent: np.ndarray) -> LabelModel:
    """The most likely model, a little smoothed, given the posteriors of the kinds and the ties."""
    m, kinds = f.shape[1], r.shape[1]
    rate, up = np.zeros((m, 2, kinds)), np.where(parent >= 0, parent, 0)
    for s in range(kinds):
        n, one = r[:, s].sum(), r[:, s] @ f
        fired = np.where(parent >= 0, one[up], 0.0)
        together = np.where(parent >= 0, (f * f[:, up] * r[:, s : s + 1]).sum(0), 0.0)
        alone = (one + 0.5) / (n + 1.0)
        # smoothed towards the voter's own rate, so that a parent that hardly ever fires says nothing
        rate[:, 1, s] = (together + alone) / (fired + 1.0)
        rate[:, 0, s] = (one - together + alone) / (n - fired + 1.0)
    return LabelModel((r.sum(0) + 1) / (len(r) + kinds), parent, np.clip(rate, 1e-6, 1 - 1e-6))


def label_model(f: np.ndarray, start: np.ndarray, rounds: int = 30, settle: int = 8) -> LabelModel:
    """Fit by expectation maximisation on a 0/1 matrix of votes, beginning with the kinds ``start`` (a number a row). The
    ties are found anew for ``settle`` rounds and kept from there."""
    kinds = int(start.max(initial=0)) + 1
    r, parent = 0.99 * np.eye(kinds)[start] + 0.01 / kinds, None
    for turn in range(rounds):
        if parent is None or turn < settle:
            parent = forest(f, r)
        model = refit(f, r, parent)
        r, before = model.kinds(f), r
        if turn >= settle and np.abs(r - before).max() < 1e-5:
            break
    return model


def first_kinds(f: np.ndarray, signs: int) -> np.ndarray:
    """Kinds to begin with, from agreements alone: 0 where no sign (one of the first voters) fires; signs that fire
    together more often than by chance are of one kind, and a row is of the kind that most of its signs are."""
    g = f[:, :signs]
    n, one = len(g), g.sum(0)
    both = g.T @ g
    near = (both >= 3) & (both * n > 3 * one[:, None] * one[None, :])
    kind = np.arange(signs)
    while (least := np.where(near, kind[None, :], signs).min(1, initial=signs)).tolist() != kind.tolist():
        least = np.minimum(least, kind)
        if (least == kind).all():
            break
        kind = least
    seen = [k for k in np.unique(kind) if g[:, kind == k].any(1).sum() >= KIND]
    number = {k: i + 1 for i, k in enumerate(seen)}
    number = np.array([number.get(k, len(seen) + 1) for k in kind])
    votes = np.stack([g[:, number == i].sum(1) for i in range(1, len(seen) + 2)], 1)
    return np.unique(np.where(votes.any(1), votes.argmax(1) + 1, 0), return_inverse=True)[1] if len(g) else np.zeros(0, np.int64)


def by_group(f: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The greatest value of each group's voters."""
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0]))
    return np.maximum.reduceat(f[:, order], starts, axis=1)


def features(fired: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Voters, groups with a voter that fires, and a constant."""
    return np.concatenate([fired, by_group(fired, group), np.ones((len(fired), 1))], axis=1)


def fit_linear(x: np.ndarray, q: np.ndarray, rounds: int = 30, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - q) + shrink * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-6)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sign, least, toxic): for each document and sign, once for every number of times up to which it occurs."""
    for b in batches:
        toxic = np.array(b.column(1).to_pylist(), np.int64)
        for x, _, buf, off in bw.blocks(_lower(b.column(0)), 0):
            h, r, _, _ = signs(buf, off)
            sign, row, n = times(h, r)
            reach = [np.flatnonzero(n >= k) for k in range(1, TIMES + 1)]
            at, least = np.concatenate(reach), np.repeat(np.arange(1, TIMES + 1), [len(k) for k in reach])
            yield pa.RecordBatch.from_arrays([pa.array(sign[at].view(np.int64)), pa.array(least), pa.array(toxic[row[at] + x])], names=["sign", "least", "toxic"])


class Model:
    """The voters, the linear classifier over them and their groups, and the label model that it was taught by."""

    def __init__(self, hashes: np.ndarray, least: np.ndarray, group: np.ndarray, linear: np.ndarray, labels: LabelModel):
        self.hashes, self.least, self.group, self.linear, self.labels = hashes, least, group, linear, labels


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of the sample."""
    key = F.col("doc_id").cast("long")
    marks = labels.select(key.alias("doc_id"), "toxic").where("doc_id is not null and toxic in (0, 1)").where(fold_of(F.col("doc_id")) != 2)
    share = sample / max(1, marks.count())
    u = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "doc_id"), 11).cast("double") / float(1 << 53)
    # about ``sample`` rows, whose known size decides the join
    drawn = scratch.written(marks.where(u < share).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")), "labelled")
    rows = docs.select(key.alias("doc_id"), "text").where("text is not null").join(drawn, "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def beyond_chance(bad: np.ndarray, n: np.ndarray, base: float, candidates: int) -> np.ndarray:
    """Whether so many toxic documents among n are too unlikely at the base rate, over all candidates: the exact binomial
    tail P(X >= bad) against CHANCE / candidates."""
    out = np.zeros(len(bad), bool)
    known: dict[tuple[int, int], bool] = {}
    for i, (k, m) in enumerate(zip(bad.tolist(), n.tolist())):
        if (k, m) not in known:
            tail = sum(math.exp(math.lgamma(m + 1) - math.lgamma(x + 1) - math.lgamma(m - x + 1) + x * math.log(base) + (m - x) * math.log(1 - base)) for x in range(k, m + 1))
            known[k, m] = tail * candidates <= CHANCE
        out[i] = known[k, m]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    with scratch.scope():
        return _trained(scratch.written(learning_rows(docs, labels, sample), "learning"))


def _trained(rows: DataFrame) -> Model | None:
    size = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    if not size["bad"] or size["bad"] == size["n"]:
        return None
    counted = rows.mapInArrow(_candidates, "sign long, least long, toxic long").groupBy("sign", "least").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    counted = scratch.written(counted, "candidates")
    good = counted.where((F.col("bad") >= LEAST_TOXIC) & (F.col("bad") >= LEAST_SHARE * F.col("n")))
    picked = good.orderBy("sign", "least").collect()  # each has LEAST_TOXIC documents of the sample's toxic ones
    enough = beyond_chance(np.array([r["bad"] for r in picked], np.int64), np.array([r["n"] for r in picked], np.int64), size["bad"] / size["n"], counted.count())
    picked = [r for r, ok in zip(picked, enough) if ok]
    lexicon = word_hashes(LEXICON)
    found, often = np.array([r["sign"] for r in picked], np.int64).view(U), np.array([r["least"] for r in picked], np.int64)
    new = ~(np.isin(found, lexicon) & (often == 1))
    hashes, least = np.concatenate([lexicon, found[new]]), np.concatenate([np.ones(len(lexicon), np.int64), often[new]])
    n = len(hashes) + len(PATTERNS)

    def fire(batches):
        voters = Voters(hashes, least)
        for b in batches:
            fired = np.zeros((b.num_rows, n), bool)
            fired[voters.fire(b.column(0))] = True
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.packbits(fired, axis=1)], pa.binary()), b.column(1)], names=["fired", "toxic"])

    # equal rows are counted where they are, as most fire nothing; at most about ``sample`` rows come back
    kinds = rows.mapInArrow(fire, "fired binary, toxic long").groupBy("fired", "toxic").agg(F.count("*").alias("n")).collect()
    kinds = sorted((bytes(r["fired"]), r["toxic"], r["n"]) for r in kinds)
    often = [k[2] for k in kinds]
    toxic = np.repeat(np.array([k[1] for k in kinds], bool), often)
    fired = np.repeat(np.stack([np.unpackbits(np.frombuffer(k[0], np.uint8), count=n) for k in kinds]).astype(np.float64), often, axis=0)
    model = label_model(fired, first_kinds(fired, len(hashes)))
    # the labels name the kinds
    r = model.kinds(fired)
    model.toxic = 2 * r[toxic].sum(0) > r.sum(0)
    q = model.posterior(fired)
    group = model.groups()
    return Model(hashes, least, group, fit_linear(features(fired, group), q), model)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(model.hashes, model.least) if model else None
        for b in batches:
            p = np.zeros(b.num_rows)
            for x in range(0, b.num_rows if model else 0, 1024):
                text = b.column(1).slice(x, 1024)
                fired = np.zeros((len(text), voters.n))
                fired[voters.fire(text)] = 1.0
                p[x : x + 1024] = 1.0 / (1.0 + np.exp(-np.clip(features(fired, model.group) @ model.linear, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    held = F.coalesce(fold_of(F.col("doc_id").cast("long")) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text", held.alias("held_out")).mapInArrow(scored, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the labelled rows and score every row."""
    return score(docs, train(docs, labels, sample))
