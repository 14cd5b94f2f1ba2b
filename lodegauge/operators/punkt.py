"""Sentence boundaries learnt from the corpus itself, without labels, after Kiss and Strunk (2006).

A full stop ends a sentence unless its word is an abbreviation, an initial or an ordinal number; those are decided by what
follows. What is an abbreviation, what begins sentences, and which words belong together across a full stop are likelihood
ratios over counts.

``pairs`` is the only scan: it counts tokens with their predecessors, by kind, type and case of the first letter, combined
before they are exchanged. All statistics are sums of that table (``fit``), and whether a full stop ends a sentence depends on
nothing but its pair, so the pairs of a corpus are decided once (``decide``). ``sentences`` then cuts each text in one linear
pass. It holds the pairs that do not end a sentence if they are counted to have at most HELD_BYTES; beyond that, doubtful
full stops are joined to them as narrow rows, and only places come back.

Languages (``lang``, null being one of its own) are learnt apart. Texts are in the offset space: tokens are what single
spaces separate. Null and empty texts have no sentences, an empty table no statistics.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegauge.functions.text import CURLY, PLAIN, SPACE_SQL, small
from lodegauge.sources import scratch

#: Fixed values of the method: the scores from which a type is an abbreviation, a sentence starter, a collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Marks that may stand before and after a word (fixed values).
OPENERS, CLOSERS = r"""["'(\[{«“‘]""", r"""["')\]}»”’]"""
#: Bytes of undoing pairs that a task may hold, at 64 and its characters each.
HELD_BYTES = 16 << 20

#: Bytes of text whose tokens are counted together.
BLOCK = 8 << 20

NUMBER = r"^-?[.,]?[0-9][0-9,.\-]*$"
_KEY = ["lang", "kind", "type", "next_type", "next_case"]


def _features(t: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """kind (none, period, ellipsis, mark), type (lower case, without marks at the end; # for numbers) and case of the first letter
    (u, l, p for a mark, - for what is none of these) of tokens."""
    core = pc.replace_substring_regex(pc.replace_substring_regex(t, f"^{OPENERS}+", ""), f"{CLOSERS}+$", "")
    has = lambda x, pattern: pc.match_substring_regex(x, pattern)
    kind = pc.if_else(has(core, "[!?]$"), "mark", pc.if_else(has(core, r"(?:\.\.|…)$"), "ellipsis", pc.if_else(pc.ends_with(core, "."), "period", "none")))
    word = pc.utf8_lower(pc.replace_substring_regex(core, "[.!?…,;:]+$", ""))
    case = pc.if_else(has(core, r"^\p{Lu}"), "u", pc.if_else(has(core, r"^\p{Ll}"), "l", pc.if_else(has(core, "^[;:,.!?]"), "p", "-")))
    return kind, pc.if_else(has(word, NUMBER), "#", word), case


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.where("text is not null").select(F.col("docid").cast("string").alias("docid"), lang.alias("lang"), F.col("text").cast("string").alias("text"))


def _normal(batch: pa.RecordBatch, column: int) -> pa.RecordBatch:
    """The batch with its texts as normalize_offsets() gives them; rows without any go."""
    text = batch.column(column)
    for a, b in zip(CURLY, PLAIN):
        text = pc.replace_substring(text, a, b)
    text = pc.utf8_trim(pc.replace_substring_regex(text, f"[{SPACE_SQL}]+", " "), " ")
    return batch.set_column(column, batch.schema.names[column], text).filter(pc.greater(pc.binary_length(text), 0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the rows of pairs(), a block of text at a time: equal tokens after equal ends are counted before they
    are looked at."""
    names = [*_KEY, "next_kind"]
    for batch in (_normal(b, 1) for b in small(batches)):
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK, side="right")))
            lists = pc.split_pattern(batch.column(1).slice(at, upto - at), " ")
            b, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            first = np.append(True, row[1:] != row[:-1])
            a = pc.if_else(pa.array(first), pa.scalar(None, pa.string()), pa.concat_arrays([b.slice(0, 1), b.slice(0, len(b) - 1)]))
            a = pc.if_else(pc.match_substring_regex(a, rf"[.!?…]{CLOSERS}*$"), a, "")
            raw = pa.table({"lang": batch.column(0).slice(at, upto - at).take(pa.array(row)), "a": a, "b": b})
            raw = raw.group_by(["lang", "a", "b"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            kind, word, _ = _features(raw["a"])
            ended = pc.is_in(kind, pa.array(["period", "ellipsis"]))
            next_kind, next_type, next_case = _features(raw["b"])
            rows = [raw["lang"], pc.fill_null(kind, "start"), pc.if_else(pc.fill_null(ended, False), word, ""), next_type, next_case, next_kind]
            told = pa.table([*rows, raw["count_all"]], names=[*names, "n"]).group_by(names, use_threads=False).aggregate([("n", "sum")])
            for some in told.select([*names, "n_sum"]).rename_columns([*names, "n"]).combine_chunks().to_batches(1 << 16):
                yield some
            at = upto


def pairs(docs: DataFrame) -> DataFrame:
    """lang, kind and type of a token (kind start, type '' before the first one; type only where a full stop or ellipsis
    ends it), next_type, next_case, next_kind of the token after it, n. Every token is once the next one."""
    names = [*_KEY, "next_kind"]
    raw = _texts(docs).select("lang", "text").mapInArrow(_counted, ", ".join(f"{n} string" for n in names) + ", n long")
    return raw.groupBy(*names).agg(F.sum("n").alias("n"))


def likelihood_ratio(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Dunning's ratio of two events that occur a and b times among total, both times together."""

    def term(k: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(p)).otherwise(0.0)

    p, p1, p2 = b / total, both / a, (b - both) / F.when(total > a, total - a)
    apart = term(both, p) + term(a - both, 1 - p) + term(b - both, p) + term(total - a - b + both, 1 - p)
    joint = term(both, p1) + term(a - both, 1 - p1) + term(b - both, p2) + term(total - a - b + both, 1 - p2)
    return -2 * (apart - joint)


def abbreviation_scores(counted: DataFrame) -> DataFrame:
    """lang, type, with_period, occurrences, score of all types with a letter that a full stop follows. counted: pairs()."""
    types = counted.groupBy("lang", F.col("next_type").alias("type")).agg(
        F.sum(F.when(F.col("next_kind") == "period", F.col("n")).otherwise(0)).alias("with_period"), F.sum("n").alias("occurrences")
    )
    all_ = counted.groupBy("lang").agg(F.sum(F.when(F.col("next_kind") == "period", F.col("n")).otherwise(0)).alias("stops"), F.sum("n").alias("tokens"))
    w, c = F.col("with_period"), F.col("occurrences")
    p = F.least(F.col("stops") / F.col("tokens"), F.lit(1 - 1e-9))
    dots = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    size = F.length("type") - dots
    chance, always = w * F.log(p) + (c - w) * F.log(1 - p), w * F.log(F.lit(0.99)) + (c - w) * F.log(F.lit(0.01))
    # short words, with inner full stops, seldom without the last one
    score = -2 * (chance - always) * F.exp(-size) * (dots + 1) * F.pow(size.cast("double"), -(c - w).cast("double"))
    return types.where((w > 0) & (F.col("type") != "#") & F.col("type").rlike(r"\p{L}")).join(all_, "lang").select("lang", "type", "with_period", "occurrences", score.alias("score"))


@dataclass
class Model:
    """What a corpus teaches, as written tables: abbreviations and starters (lang, type), collocations (lang, type,
    next_type), cases (lang, type, and whether it was seen in lower case, in upper case, in upper case inside a sentence, in lower
    case at the beginning of one)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame


def _settled(counted: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """pairs with ``abbr`` and ``breaks``: whether the first pass, which knows abbreviations only, ends a sentence there."""
    known = abbreviations.select("lang", "type", F.lit("period").alias("kind"), F.lit(True).alias("abbr"))
    out = counted.join(known, ["lang", "type", "kind"], "left").withColumn("abbr", F.coalesce("abbr", F.lit(False)))
    return out.withColumn("breaks", (F.col("kind") == "mark") | ((F.col("kind") == "period") & ~F.col("abbr")))


def starter_scores(settled: DataFrame) -> DataFrame:
    """lang, type, at_start (times after a break), occurrences, score of types that begin sentences more often than they
    would by chance."""
    types = settled.groupBy("lang", F.col("next_type").alias("type")).agg(F.sum(F.when(F.col("breaks"), F.col("n")).otherwise(0)).alias("at_start"), F.sum("n").alias("occurrences"))
    all_ = settled.groupBy("lang").agg(F.sum(F.when(F.col("breaks"), F.col("n")).otherwise(0)).alias("breaks"), F.sum("n").alias("tokens"))
    k, c, b, n = F.col("at_start"), F.col("occurrences"), F.col("breaks"), F.col("tokens")
    more = types.join(all_, "lang").where((k > 0) & F.col("type").rlike(r"\p{L}") & (n * k > c * b))
    return more.select("lang", "type", "at_start", "occurrences", likelihood_ratio(b, c, k, n).alias("score"))


def collocation_scores(counted: DataFrame) -> DataFrame:
    """lang, type, next_type, together, score of words after numbers and initials with a full stop that follow them more
    than once and more often than by chance."""
    types = counted.groupBy("lang", "next_type").agg(F.sum("n").alias("b"))
    stopped = counted.where("kind = 'period'").groupBy("lang", "type", "next_type").agg(F.sum("n").alias("together")).where(F.col("type").rlike(r"^(?:#|\p{L})$") & F.col("next_type").rlike(r"\p{L}") & (F.col("together") > 1))
    first = types.select("lang", F.col("next_type").alias("type"), F.col("b").alias("a"))
    n = counted.groupBy("lang").agg(F.sum("n").alias("tokens"))
    found = stopped.join(first, ["lang", "type"]).join(types, ["lang", "next_type"]).join(n, "lang").where("tokens * together > a * b AND together <= a")
    return found.select("lang", "type", "next_type", "together", likelihood_ratio(F.col("a"), F.col("b"), F.col("together"), F.col("tokens")).alias("score"))


def fit(docs: DataFrame) -> Model:
    """docs: docid, text and perhaps lang. The tables are kept in the shared folder."""
    return taught(scratch.written(pairs(docs), "pairs"))


def taught(counted: DataFrame) -> Model:
    """The model of pairs() as written."""
    abbreviations = scratch.written(abbreviation_scores(counted).where(F.col("score") >= ABBREVIATION).select("lang", "type"), "abbreviations")
    settled = scratch.written(_settled(counted, abbreviations), "settled")
    inside = (~F.col("breaks")) & (F.col("kind") == "none")
    upper, lower, begins = F.col("next_case") == "u", F.col("next_case") == "l", F.col("breaks") | (F.col("kind") == "start")
    cases = settled.groupBy("lang", F.col("next_type").alias("type")).agg(F.max(lower).alias("lower"), F.max(upper).alias("upper"), F.max(upper & inside).alias("upper_inside"), F.max(lower & begins).alias("lower_begins"))
    return Model(
        abbreviations,
        scratch.written(starter_scores(settled).where(F.col("score") >= STARTER).select("lang", "type"), "starters"),
        scratch.written(collocation_scores(counted).where(F.col("score") >= COLLOCATION).select("lang", "type", "next_type"), "collocations"),
        scratch.written(cases, "cases"),
    )


def decide(counted: DataFrame, model: Model) -> DataFrame:
    """The doubtful pairs of ``counted`` with ``breaks``: whether a sentence ends between the two tokens. Doubtful are ellipses,
    and full stops after abbreviations, initials and numbers; all others end one."""
    initial, number, stop = F.col("type").rlike(r"^\p{L}$"), F.col("type") == "#", F.col("kind") == "period"
    asked = _settled(counted.where("kind IN ('period', 'ellipsis')"), model.abbreviations).where(F.col("abbr") | initial | number | ~stop)
    rows = asked.select(*_KEY, "abbr").distinct()
    rows = rows.join(model.starters.select("lang", F.col("type").alias("next_type"), F.lit(True).alias("starter")), ["lang", "next_type"], "left")
    rows = rows.join(model.collocations.withColumn("together", F.lit(True)), ["lang", "type", "next_type"], "left")
    rows = rows.join(model.cases.withColumnRenamed("type", "next_type"), ["lang", "next_type"], "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    upper, lower = F.col("next_case") == "u", F.col("next_case") == "l"
    begins = upper & flag("lower") & ~flag("upper_inside")
    goes_on = (F.col("next_case") == "p") | (lower & (flag("upper") | ~flag("lower_begins")))
    breaks = (
        F.when(stop & (initial | number) & flag("together"), False)
        .when((F.col("abbr") | ~stop) & ~initial, begins | (upper & flag("starter")))
        .when(goes_on | (initial & upper & ~flag("lower")), False)
        .otherwise(~F.col("abbr"))
    )
    return rows.select(*_KEY, breaks.alias("breaks"))


_END = re.compile(rf"[.!?…]{CLOSERS}*(?= )")
_FIRST, _LAST, _MARKS, _NUMBER = re.compile(f"^{OPENERS}+"), re.compile(f"{CLOSERS}+$"), re.compile("[.!?…,;:]+$"), re.compile(NUMBER)


def _typed(token: str) -> tuple[str, str]:
    """A token's core and type, as _features() tells them."""
    core = _LAST.sub("", _FIRST.sub("", token))
    word = _MARKS.sub("", core).lower()
    return core, "#" if _NUMBER.match(word) else word


def ends(text: str, doubted: Callable[[str, str], bool]) -> Iterator[tuple[int, tuple[str, ...] | None]]:
    """The places after tokens that may end a sentence and are not the last, with kind, type, next_type, next_case of
    their pair if doubted(kind, type); None where the sentence ends in any case."""
    for m in _END.finditer(text):
        core, word = _typed(text[text.rfind(" ", 0, m.start()) + 1 : m.end()])
        if core.endswith(("!", "?")):
            yield m.end(), None
        elif core.endswith((".", "…")):
            kind = "ellipsis" if core.endswith(("..", "…")) else "period"
            if not doubted(kind, word):
                yield m.end(), None
                continue
            after = text.find(" ", m.end() + 1)
            core_, word_ = _typed(text[m.end() + 1 : after if after >= 0 else len(text)])
            category = unicodedata.category(core_[0]) if core_ else ""
            case = {"Lu": "u", "Ll": "l"}.get(category) or ("p" if core_ and core_[0] in ";:,.!?" else "-")
            yield m.end(), (kind, word, word_, case)


def _cut(cuts: Callable[[str, str, list | None], Iterator[int]]):
    """Rows (docid, lang, text[, held]) to sentences, which end at cuts(lang, text, held) and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in (_normal(x, 2) for x in small(batches)):
            rows: list[tuple] = []
            size = 0
            for k in range(b.num_rows):
                docid, lang, text = (b.column(i)[k].as_py() for i in range(3))
                start = 0
                for number, place in enumerate([*cuts(lang, text, b.column(3)[k].as_py() if b.num_columns > 3 else None), len(text)]):
                    rows.append((docid, None if docid is None else f"PUNKT-{docid}-{number:04d}", start, place, text[start:place]))
                    size += place - start + 64
                    start = place + 1
                if size > 1 << 22 or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["docid", "chunk_id", "start", "end", "text"])
                    rows, size = [], 0

    return run


_SCHEMA = "docid string, chunk_id string, start long, end long, text string"


def sentences(docs: DataFrame, model: Model | None = None, held_bytes: int = HELD_BYTES) -> DataFrame:
    """docid, chunk_id, start, end, text: sentences without the spaces between them; they leave out nothing else. The
    model is learnt from docs if none is given."""
    texts, counted = _texts(docs), scratch.written(pairs(docs), "pairs")
    undone = scratch.written(decide(counted, model or taught(counted)).where("not breaks").drop("breaks"), "undone")
    size = undone.agg(F.sum(64 + F.octet_length("lang") + F.octet_length("type") + F.octet_length("next_type"))).first()[0] or 0
    if size <= held_bytes:
        known = frozenset(tuple(r) for r in undone.collect())
        firsts = frozenset(k[:3] for k in known)

        def cuts(lang: str, text: str, held: list | None) -> Iterator[int]:  # noqa: ARG001
            return (place for place, pair in ends(text, lambda kind, word: (lang, kind, word) in firsts) if not pair or (lang, *pair) not in known)

        return texts.mapInArrow(_cut(cuts), _SCHEMA)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "h", "place", "kind", "type", "next_type", "next_case"]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
        for b in (_normal(x, 2) for x in small(batches)):
            for k in range(b.num_rows):
                lang, text, h = (b.column(i)[k].as_py() for i in (1, 2, 3))
                rows = [(lang, h, place, *pair) for place, pair in ends(text, lambda *_: True) if pair]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    keyed = texts.withColumn("h", F.xxhash64("docid", "lang", "text"))
    found = keyed.mapInArrow(places, "lang string, h long, place long, kind string, type string, next_type string, next_case string").join(undone, _KEY, "left_semi")
    found = found.groupBy("h").agg(F.collect_set("place").alias("held"))

    def left(lang: str, text: str, held: list | None) -> Iterator[int]:  # noqa: ARG001
        inside = set(held or ())
        return (place for place, _ in ends(text, lambda *_: False) if place not in inside)

    return keyed.join(found, "h", "left").select("docid", "lang", "text", "held").mapInArrow(_cut(left), _SCHEMA)
