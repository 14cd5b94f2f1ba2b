"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each rule is a ratio of a document's counts, and rejects above a cutoff. Cutoffs come from labelled holdouts, by fixed
sequences: for every stratum (language), the labelled bad documents alone lay out a sequence of steps, each a rule and a
cutoff of a fixed grid. Rules come in order of the bad documents they can reject, cutoffs from lenient to strict, and
those that reject no more bad documents than the one before are left out. The labelled good documents, which had no say
in that, then test it: at each step, those rejected by any step so far are counted, and the exact binomial tail
P(X <= false rejections | n, risk) says how unlikely so few would be if the true false-rejection rate of all these rules
together were above the risk. Steps are certified while the tail is at most delta divided by the number of strata; the
first one that fails ends its stratum's sequence, so there is nothing to divide by within it. Strata whose good documents are
too few to pass even alone take no share of delta, as their numbers say nothing of outcomes. With probability 1 - delta, every stratum's rules together stay below the risk. Without a false rejection that takes
log(strata / delta) / -log(1 - risk) labelled good documents: 149 for one stratum, 217 for four. A stratum with fewer, or
without bad documents that a rule rejects, has no rule. What follows a step that fails is not tried.

Base rules (before the verdict): fewer than ``min_words`` words, or more than 20 % of words in repeated 5-word windows.

Nulls: a null text has no words and fails the base rules. A null language is a stratum of its own. Documents without
words are never judged by ratios. Rows without labels, and labels without documents, do not calibrate. The bound needs
labels that are drawn apart, so equal texts of a stratum, however often they or their labels are repeated, count once, as
good if any of their labels says so. Extra columns are ignored. Empty tables give empty results; without labels only the
base rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.sources import scratch

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5
#: Total false-rejection rate allowed in a stratum, over all rules; probability that any promise fails.
RISK, DELTA = 0.02, 0.05
#: Candidate cutoffs by rule, from lenient to strict.
GRID = {
    "symbols": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15),
    "capitals": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2),
    "exclaims": (0.75, 0.5, 0.35, 0.25, 0.15),
    "dup_lines": (0.75, 0.5, 0.35, 0.25, 0.15),
    "repeats": (0.75, 0.5, 0.35, 0.25, 0.15),
}


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def window_hashes(words: Column) -> Column:
    """64-bit hashes of all windows of WINDOW words, in order."""
    last = F.size(words) - WINDOW
    return F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]),
    )


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, even where lambdas refer to it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, first occurrences included, without leaving the row: windows sorted
    by hash, those with an equal neighbour, and the length of the union of their places. Costly, so it is asked for
    only where two windows agree."""
    pair = lambda h, i: F.struct(h.alias("h"), i.alias("i"))

    def places(at: Column) -> Column:
        n = F.size(at)
        same = lambda x, k: ((k > 0) & (F.get(at, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(at, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(F.filter(at, same), lambda x: x["i"]))

    def union(p: Column) -> Column:
        # each place covers up to the next one, WINDOW words at most; the last covers WINDOW
        step = lambda a, k: F.least(F.coalesce(F.get(p, k + 1) - a, F.lit(WINDOW)), F.lit(WINDOW))
        return F.aggregate(F.transform(p, step), F.lit(0), lambda total, x: total + x)

    return let(let(F.sort_array(F.transform(hashes, pair)), places), union)


def counts(docs: DataFrame, row: str | None = None, min_words: int = 10) -> DataFrame:
    """doc_id, lang and the counts of every row, in one pass over the text without an exchange. row: also keep the row
    itself, as a struct of that name."""
    text = F.coalesce("text", F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)] if row else []
    with_words = docs.select(F.col("doc_id").cast("long"), F.col("lang"), text.alias("text"), *kept).withColumn("words", word_array(F.col("text")))
    with_hashes = with_words.withColumn("hashes", window_hashes(F.col("words")))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeats = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), repeated_words(F.col("hashes"))).otherwise(0)
    long = lambda c: c.cast("long")
    keep = [row] if row else []
    got = with_hashes.select(
        "doc_id", "lang", *keep,
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        F.struct(long(F.size(lines)).alias("lines"), long(F.size(F.array_distinct(lines))).alias("kinds")).alias("l"),
        long(repeats).alias("n_repeat_words"),
        long(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("n_capitals"),
        long(F.regexp_count("text", F.lit("!"))).alias("n_exclaims"),
        F.md5("text").alias("text_key"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return got.select(
        "doc_id", "lang", *keep, "n_words", "word_chars", "n_symbols", (F.col("l.lines") - F.col("l.kinds")).alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), F.col("l.lines").alias("n_lines"), "n_capitals", "n_exclaims", "text_key",
    )


def ratios() -> dict[str, Column]:
    """The rules' values; null (never rejected) where there is nothing to divide by."""
    by = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return {
        "symbols": by("n_symbols", "n_words"),
        "capitals": by("n_capitals", "word_chars"),
        "exclaims": by("n_exclaims", "n_words"),
        "dup_lines": by("n_dup_lines", "n_lines"),
        "repeats": by("n_repeat_words", "n_words"),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly: terms by recurrence, in logs so that nothing underflows.

    For k >= n * p the tail is over one third and never certifies; 1 is returned without summing.
    """
    log_odds = F.log(F.lit(p)) - F.log(F.lit(1 - p))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))

    def step(s, i):
        term = s["term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + log_odds
        high, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.exp(F.aggregate(steps, start, step, lambda s: s["sum"])))


def calibrate(features: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """lang, rule, cutoff for the rules that reject anything. Labelled rows are first reduced to one per stratum and text
    (text_key; counts without it are told apart by doc_id), then to one per stratum for the sequences, and to one per stratum and
    step for their tests, with partial sums before each exchange."""
    value, key = ratios(), "text_key" if "text_key" in features.columns else "doc_id"
    judged = features.where(~F.col("base_failed")).select("doc_id", "lang", F.col(key).alias("text"), *[v.alias(k) for k, v in value.items()])
    told = judged.join(labels.select(F.col("doc_id").cast("long"), F.col("quality")).where("quality in (0, 1)"), "doc_id")
    marked = scratch.written(told.groupBy("lang", "text").agg(F.max("quality").alias("quality"), *[F.max(k).alias(k) for k in value]), "labelled")
    cells = [(rule, r, i, c) for r, (rule, grid) in enumerate(GRID.items()) for i, c in enumerate(grid)]
    sums = [F.count_if(F.coalesce(F.col(rule) > c, F.lit(False)) & (F.col("quality") == 0)).alias(f"{rule}_{i}") for rule, _, i, c in cells]
    totals = marked.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), *sums)
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(r).alias("r"), F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"), F.col(f"{rule}_{i}").alias("right")) for rule, r, i, c in cells])
    able = F.col("good") * F.lit(math.log1p(-risk)) <= math.log(delta)
    strata = totals.withColumn("strata", F.greatest(F.count_if(able).over(Window.partitionBy()), F.lit(1)))
    flat = strata.select("lang", "good", "strata", F.explode(each).alias("c")).select("lang", "good", "strata", "c.*")
    of_rule = Window.partitionBy("lang", "r")
    more = flat.withColumn("most", F.max("right").over(of_rule)).withColumn("before", F.lag("right", 1, 0).over(of_rule.orderBy("i"))).where("right > before")
    steps = more.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("most"), "r", "i")))
    steps = scratch.written(steps.select("lang", "good", "strata", "rule", "r", "cutoff", "place"), "steps")
    paths = scratch.written(steps.groupBy(F.col("lang").alias("stratum")).agg(F.collect_list(F.struct("place", "r", "cutoff")).alias("path")), "paths")
    values = F.array(*[F.col(rule) for rule in GRID])
    hit = F.filter("path", lambda x: F.get(values, x["r"]) > x["cutoff"])
    first = marked.where("quality = 1").join(paths, F.col("lang").eqNullSafe(F.col("stratum"))).select("stratum", F.array_min(F.transform(hit, lambda x: x["place"])).alias("at"))
    lost = first.where("at is not null").groupBy("stratum", "at").agg(F.count("*").alias("lost"))
    so_far = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tested = steps.join(lost, F.col("lang").eqNullSafe(F.col("stratum")) & (F.col("place") == F.col("at")), "left").withColumn("wrong", F.sum(F.coalesce("lost", F.lit(0))).over(so_far))
    passed = binomial_tail(F.col("wrong"), F.col("good"), risk) <= F.lit(delta) / F.col("strata")
    certified = tested.withColumn("passed", passed).withColumn("certified", F.min("passed").over(so_far)).where("certified")
    return certified.groupBy("lang", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge_with(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """features with kept: false where the base rules fail or any certified cutoff of the row's stratum is passed. The
    cutoffs are written first, so that the join broadcasts them by their known size (a row a stratum)."""
    wide = scratch.written(
        cutoffs.groupBy(F.col("lang").alias("stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in GRID]),
        "cutoffs",
    )
    joined = features.join(wide, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    rejected = F.lit(False)
    for rule, v in ratios().items():
        rejected = rejected | F.coalesce(v > F.col(f"cut_{rule}"), F.lit(False))
    return joined.withColumn("kept", ~(F.col("base_failed") | rejected)).drop("stratum", *[f"cut_{r}" for r in GRID])


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per row: doc_id, the counts, base_failed and kept. The text is read once; its counts are written to the shared
    folder, calibrate from there, and are judged from there."""
    features = scratch.written(counts(docs), "quality")
    return judge_with(features, calibrate(features, labels, risk, delta)).select(*COLUMNS)


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that the rules keep, in the columns they came with. The texts are read and counted once: the counts
    are written beside the rows, cutoffs come from the counts' columns alone, and each row is judged by its own counts, so
    that no text is exchanged and rows that share a key are judged one by one."""
    counted = scratch.written(counts(docs, "row"), "counted")
    cutoffs = calibrate(counted.drop("row"), labels, risk, delta)
    return judge_with(counted, cutoffs).where("kept").select("row.*")


def _oracle() -> str:
    """DuckDB SQL for quality_rules(): the same counts by positions and joins, sequences by row numbers, and tails by
    log-gamma terms."""
    value = {"symbols": "n_symbols / nullif(n_words, 0)", "capitals": "n_capitals / nullif(word_chars, 0)", "exclaims": "n_exclaims / nullif(n_words, 0)",
             "dup_lines": "n_dup_lines / nullif(n_lines, 0)", "repeats": "n_repeat_words / nullif(n_words, 0)"}
    grid = ", ".join(f"('{rule}', {r}, {i}, {c}::DOUBLE)" for r, (rule, g) in enumerate(GRID.items()) for i, c in enumerate(g))
    rules = " UNION ALL ".join(f"SELECT k, doc_id, lang, base_failed, text_key, '{r}' AS rule, {v} AS v FROM c" for r, v in value.items())
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT k, i, list_slice(words, i, i + {WINDOW - 1}) AS g FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)
), twice AS (
  SELECT k, unnest(spots) AS i FROM (SELECT k, list(i) AS spots FROM windows GROUP BY k, g HAVING count(*) > 1)
), covered AS (
  SELECT k, count(DISTINCT i + j) AS n FROM twice, unnest(range({WINDOW})) AS o(j) GROUP BY k
), lines AS (
  SELECT k, count(*) AS n, count(DISTINCT line) AS kinds FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), c0 AS (
  SELECT w.k, doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n - lines.kinds, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
         md5(text) AS text_key, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '!')) AS n_exclaims
  FROM w LEFT JOIN lines USING (k) LEFT JOIN covered USING (k)
), c AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c0
), v AS ({rules}),
grid AS (SELECT * FROM (VALUES {grid}) AS g(rule, r, i, cutoff)),
marked AS (
  SELECT lang, rule, text_key, max(v) AS v, max(quality) AS quality FROM v JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1) GROUP BY ALL
), strata AS (
  SELECT *, greatest(count(*) FILTER (good * ln(1 - {RISK}) <= ln({DELTA})) OVER (), 1) AS strata FROM (SELECT lang, count(*) FILTER (quality = 1 AND rule = 'symbols') AS good FROM marked GROUP BY lang)
), cells AS (
  SELECT lang, g.rule, r, i, cutoff, count(*) FILTER (quality = 0 AND v > cutoff) AS bad FROM marked JOIN grid g USING (rule) GROUP BY ALL
), gains AS (
  SELECT *, max(bad) OVER (PARTITION BY lang, r) AS most FROM cells
  QUALIFY bad > lag(bad, 1, 0) OVER (PARTITION BY lang, r ORDER BY i)
), steps AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY most DESC, r, i) AS place FROM gains
), losses AS (
  SELECT lang, place, count(*) AS lost FROM (
    SELECT m.lang, m.text_key, min(s.place) AS place FROM marked m JOIN steps s ON s.rule = m.rule AND s.lang IS NOT DISTINCT FROM m.lang AND m.v > s.cutoff
    WHERE m.quality = 1 GROUP BY m.lang, m.text_key) GROUP BY ALL
), tests AS (
  SELECT s.lang, s.rule, s.cutoff, s.place, t.good, t.strata,
         (SELECT coalesce(sum(lost), 0) FROM losses l WHERE l.lang IS NOT DISTINCT FROM s.lang AND l.place <= s.place)::BIGINT AS wrong
  FROM steps s JOIN strata t ON s.lang IS NOT DISTINCT FROM t.lang
), passed AS (
  SELECT *, CASE WHEN wrong >= good * {RISK} THEN 1 ELSE list_sum(list_transform(range(0, wrong + 1),
           lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({RISK}) + (good - i) * ln(1 - {RISK})))) END <= {DELTA} / strata AS ok
  FROM tests
), cuts AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM passed p
  WHERE NOT EXISTS (SELECT 1 FROM passed q WHERE q.lang IS NOT DISTINCT FROM p.lang AND q.place <= p.place AND NOT q.ok) GROUP BY ALL
), rejected AS (
  SELECT DISTINCT v.k FROM v JOIN cuts ON v.rule = cuts.rule AND v.lang IS NOT DISTINCT FROM cuts.lang WHERE v.v > cuts.cutoff
)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR EXISTS (SELECT 1 FROM rejected r WHERE r.k = c.k)) AS kept
FROM c
"""


ORACLE = _oracle()
