"""Queries over the corpus as a whole: what it teaches, and what of one table occurs in another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegauge.operators import annotate, containment, encoder, punkt, spans
from lodegauge.sources import scratch


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    docs = scratch.spread(spark.read.parquet(f"{sf}/documents.parquet"))
    return docs.select(F.col("doc_id").cast("string").alias("docid"), "lang", "text")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """Likelihoods of abbreviations, sentence starters and collocations, but for those next to nothing."""
    counted = scratch.written(punkt.pairs(_spoken(spark, sf)), "pairs")
    abbreviations = punkt.abbreviation_scores(counted)
    settled = punkt._settled(counted, scratch.written(abbreviations.where(F.col("score") >= punkt.ABBREVIATION).select("lang", "type"), "abbreviations"))
    parts = [("abbreviation", abbreviations, F.lit(""), "with_period"), ("starter", punkt.starter_scores(settled), F.lit(""), "at_start"), ("collocation", punkt.collocation_scores(counted), F.col("next_type"), "together")]
    out = None
    for name, rows, second, n in parts:
        one = rows.where("score >= 0.001").select(F.lit(name).alias("what"), "lang", "type", second.alias("next_type"), F.col(n).alias("n"), F.round("score", 3).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


_RATIO = """-2 * ((k * ln(b / t) + CASE WHEN a > k THEN (a - k) * ln(1 - b / t) ELSE 0 END + CASE WHEN b > k THEN (b - k) * ln(b / t) ELSE 0 END + CASE WHEN t - a - b + k > 0 THEN (t - a - b + k) * ln(1 - b / t) ELSE 0 END)
    - (k * ln(k / a) + CASE WHEN a > k THEN (a - k) * ln(1 - k / a) ELSE 0 END + CASE WHEN b > k THEN (b - k) * ln((b - k) / (t - a)) ELSE 0 END + CASE WHEN t - a - b + k > 0 THEN (t - a - b + k) * ln(1 - (b - k) / (t - a)) ELSE 0 END))"""


def punkt_sql(normal: str) -> str:
    """pairs_at (every token with its predecessor), abbreviation, starter, collocation scores, decided (breaks of doubtful pairs)."""
    return rf"""{normal}, cores AS (
  SELECT docid, lang, i, t, regexp_replace(regexp_replace(t, '^["''(\[{{«“‘]+', ''), '["'')\]}}»”’]+$', '') AS core FROM (
    SELECT n.docid, coalesce(d.lang, '') AS lang, unnest(string_split(n.text, ' ')) AS t, generate_subscripts(string_split(n.text, ' '), 1) AS i FROM normal n JOIN documents d USING (doc_id) WHERE n > 0)
), worded AS (
  SELECT *, lower(regexp_replace(core, '[.!?…,;:]+$', '')) AS w, CASE WHEN regexp_matches(core, '[!?]$') THEN 'mark' WHEN regexp_matches(core, '(\.\.|…)$') THEN 'ellipsis' WHEN ends_with(core, '.') THEN 'period' ELSE 'none' END AS k,
    CASE WHEN regexp_matches(core, '^\p{{Lu}}') THEN 'u' WHEN regexp_matches(core, '^\p{{Ll}}') THEN 'l' WHEN regexp_matches(core, '^[;:,.!?]') THEN 'p' ELSE '-' END AS next_case FROM cores
), named AS (
  SELECT *, CASE WHEN regexp_matches(w, '{punkt.NUMBER}') THEN '#' ELSE w END AS next_type FROM worded
), pairs_at AS (
  SELECT docid, i, t, lang, coalesce(lag(k) OVER o, 'start') AS kind, CASE WHEN lag(k) OVER o IN ('period', 'ellipsis') THEN lag(next_type) OVER o ELSE '' END AS type, next_type, next_case, k AS next_kind
  FROM named WINDOW o AS (PARTITION BY docid ORDER BY i)
), counted AS (
  SELECT lang, kind, type, next_type, next_case, next_kind, count(*) AS n FROM pairs_at GROUP BY ALL
), total AS (
  SELECT lang, sum(n)::DOUBLE AS tokens, coalesce(sum(n) FILTER (next_kind = 'period'), 0)::DOUBLE AS stops FROM counted GROUP BY lang
), word AS (
  SELECT lang, next_type AS type, sum(n)::DOUBLE AS c, coalesce(sum(n) FILTER (next_kind = 'period'), 0)::DOUBLE AS w FROM counted GROUP BY ALL
), abbreviation AS (
  SELECT lang, type, w, -2 * ((w * ln(p) + (c - w) * ln(1 - p)) - (w * ln(0.99::DOUBLE) + (c - w) * ln(0.01::DOUBLE))) * exp(-size) * (dots + 1) * pow(size::DOUBLE, -(c - w)) AS score
  FROM (SELECT *, least(stops / tokens, 1 - 1e-9) AS p, length(type) - length(replace(type, '.', '')) AS dots, length(replace(type, '.', '')) AS size FROM word JOIN total USING (lang) WHERE w > 0 AND type <> '#' AND regexp_matches(type, '\p{{L}}'))
), settled AS (
  SELECT c.*, a.type IS NOT NULL AS abbr, kind = 'mark' OR (kind = 'period' AND a.type IS NULL) AS breaks FROM counted c LEFT JOIN (SELECT * FROM abbreviation WHERE score >= {punkt.ABBREVIATION}) a ON a.lang = c.lang AND a.type = c.type AND c.kind = 'period'
), starter AS (
  SELECT lang, type, k, {_RATIO} AS score FROM (
    SELECT lang, next_type AS type, coalesce(sum(n) FILTER (breaks), 0)::DOUBLE AS k, sum(n)::DOUBLE AS b FROM settled GROUP BY ALL) JOIN (SELECT lang, coalesce(sum(n) FILTER (breaks), 0)::DOUBLE AS a, sum(n)::DOUBLE AS t FROM settled GROUP BY lang) USING (lang)
  WHERE k > 0 AND regexp_matches(type, '\p{{L}}') AND t * k > a * b
), collocation AS (
  SELECT lang, type, next_type, k, {_RATIO} AS score FROM (
    SELECT s.lang, s.type, s.next_type, s.k, x.c AS a, y.c AS b, tokens AS t FROM (SELECT lang, type, next_type, sum(n)::DOUBLE AS k FROM counted WHERE kind = 'period' GROUP BY ALL) s
    JOIN word x ON x.lang = s.lang AND x.type = s.type JOIN word y ON y.lang = s.lang AND y.type = s.next_type JOIN total ON total.lang = s.lang)
  WHERE k > 1 AND k <= a AND regexp_matches(type, '^(#|\p{{L}})$') AND regexp_matches(next_type, '\p{{L}}') AND t * k > a * b
)"""


_DECIDED = rf"""cases AS (
  SELECT lang, next_type, bool_or(next_case = 'l') AS lower_, bool_or(next_case = 'u') AS upper_, bool_or(next_case = 'u' AND NOT breaks AND kind = 'none') AS upper_inside, bool_or(next_case = 'l' AND (breaks OR kind = 'start')) AS lower_begins FROM settled GROUP BY ALL
), flagged AS (
  SELECT DISTINCT s.lang, kind, s.type, s.next_type, next_case, abbr, st.type IS NOT NULL AS starter, co.type IS NOT NULL AS together,
    regexp_matches(s.type, '^\p{{L}}$') AS initial, s.type = '#' AS number, next_case = 'u' AND lower_ AND NOT upper_inside AS begins, next_case = 'p' OR (next_case = 'l' AND (upper_ OR NOT lower_begins)) AS goes_on, next_case = 'u' AND NOT lower_ AS only_upper
  FROM settled s JOIN cases USING (lang, next_type)
  LEFT JOIN (SELECT * FROM starter WHERE score >= {punkt.STARTER}) st ON st.lang = s.lang AND st.type = s.next_type
  LEFT JOIN (SELECT * FROM collocation WHERE score >= {punkt.COLLOCATION}) co ON co.lang = s.lang AND co.type = s.type AND co.next_type = s.next_type WHERE kind IN ('period', 'ellipsis')
), decided AS (
  SELECT lang, kind, type, next_type, next_case, CASE WHEN kind = 'period' AND NOT abbr AND NOT initial AND NOT number THEN true WHEN kind = 'period' AND (initial OR number) AND together THEN false
    WHEN (abbr OR kind = 'ellipsis') AND NOT initial THEN begins OR (next_case = 'u' AND starter) WHEN goes_on OR (initial AND only_upper) THEN false ELSE NOT abbr END AS breaks FROM flagged
), numbered AS (
  SELECT docid, i, t, sum(length(t) + 1) OVER o - 1 AS e, sum(CASE WHEN kind = 'mark' OR coalesce(breaks, false) THEN 1 ELSE 0 END) OVER o AS s
  FROM pairs_at LEFT JOIN decided USING (lang, kind, type, next_type, next_case) WINDOW o AS (PARTITION BY docid ORDER BY i))
SELECT docid, 'PUNKT-' || docid || '-' || printf('%04d', s::BIGINT) AS chunk_id, min(e - length(t))::BIGINT AS start, max(e)::BIGINT AS "end", string_agg(t, ' ' ORDER BY i) AS text FROM numbered GROUP BY docid, s"""


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    """Where the passages of benchmark occur in documents."""
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("passage_id"), "text")
    return containment.occurrences(asked, _spoken(spark, sf)).withColumnRenamed("passage_id", "item_id")


def _fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' vectors by an encoder that is fitted on them."""
    rows = encoder.counted(_spoken(spark, sf).select("docid", "text"))
    return encoder.vectors(rows, encoder.fit_counted(rows))


def _kept_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and the answers of two annotators, all replies by way of a store: the second one's prompts are the first one's. Texts are
    read where they lie; of each step, only what it gives and the store stay."""
    docs, store = _spoken(spark, sf).select("docid", "text"), scratch.new_path(spark, "replies")

    def step(rows: Callable[[], DataFrame], label: str) -> DataFrame:
        with scratch.released(spark), scratch.scope() as keep:
            out = scratch.written(rows(), label)
            keep(out)
        return out

    q = step(lambda: annotate.generate_questions(docs, store=store), "questions")
    both = [step(lambda name=name: annotate.annotate(q, docs, name, store=store), "annotations") for name in ("sme1", "sme2")]
    return spans.merge_spans(spans.with_order(both, ["sme1", "sme2"]), docs).select("qid", "docid", "start", "end", "logic")


#: Characters between documents that are laid end to end.
_APART = 1 << 24


def _laid_out(spark: SparkSession, sf: str) -> DataFrame:
    """All spans of a language's documents as those of one question, the documents end to end."""
    from lodegauge.plans import contract as c

    lang = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("docid"), F.coalesce("lang", F.lit("")).alias("lang"))
    found = c.derived_spans(spark, sf).join(lang, "docid")
    far = F.col("docid").cast("long") * _APART
    return found.withColumn("start", F.col("start") + far).withColumn("end", F.col("end") + far).withColumn("qid", F.lit("q")).withColumn("docid", F.col("lang")).drop("lang")


def _hot_merge(spark: SparkSession, sf: str) -> DataFrame:
    return spans._fold(_laid_out(spark, sf), split=_APART).where("not clash").select("docid", "start", "end", "logic", F.col("by").alias("contributors"))


def add(register: Callable) -> None:
    """Register the queries of this module."""
    from lodegauge.plans import contract as c

    taught = punkt_sql(c.NORMAL_SQL)
    register("punkt_scores", _scores, f"""WITH {taught}
SELECT 'abbreviation' AS what, lang, type, '' AS next_type, w::BIGINT AS n, round(score, 3) AS score FROM abbreviation WHERE score >= 0.001
UNION ALL SELECT 'starter', lang, type, '', k::BIGINT, round(score, 3) FROM starter WHERE score >= 0.001
UNION ALL SELECT 'collocation', lang, type, next_type, k::BIGINT, round(score, 3) FROM collocation WHERE score >= 0.001""")
    register("chunk_punkt", lambda s, d: punkt.sentences(_spoken(s, d)), f"WITH {taught}, {_DECIDED}")
    register("annotate_from_store", _kept_replies, c.GENERATED_SQL)
    register("embed_fitted", _fitted)
    register("find_passages", _passages, f"""WITH {c.NORMAL_SQL}, asked AS (
  SELECT item_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(trim(translate(text, '’‘”“—–', '''''""--'), ' '), '[{c.S}]*(?:\\.\\.\\.|…|\\.\\.)$', ''), '[{c.S}]+', ' ', 'g'), ' '), '^[,."'' ]+', ''), '[,."'' ]+$', '') AS v FROM benchmark
), forms AS (
  SELECT item_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS variant FROM (
    SELECT item_id, list_filter([v, CASE WHEN contains(v, '_') THEN replace(v, '_', ' ') END, CASE WHEN contains(v, '_') THEN replace(v, '_', '') END], lambda x: x <> '') AS vs FROM asked)
), held AS (
  SELECT item_id, docid, text, variant, lower(v) AS v FROM forms JOIN normal ON contains(lower(text), lower(v)) QUALIFY variant = min(variant) OVER (PARTITION BY item_id, docid)
), found AS (
  SELECT *, unnest(list_filter(range(1, length(text) - length(v) + 2), lambda i: substring(lower(text), i, length(v)) = v)) AS place FROM held
), snapped AS (
  SELECT *, place - 1 - length(regexp_extract(substring(text, 1, place - 1), '[^ ]*$')) AS s, place - 1 + length(v) + length(regexp_extract(substring(text, place + length(v)), '^[^ ]*')) AS e FROM found)
SELECT item_id, docid, variant::INT AS variant, row_number() OVER (PARTITION BY item_id, docid ORDER BY place) AS occurrence, s::BIGINT AS start, e::BIGINT AS "end", substring(text, s + 1, e - s) AS span_text FROM snapped""")
    register("merge_hot_question", _hot_merge, c.MERGE_SQL + f""" SELECT coalesce(any_value(d.lang), '') AS docid, arg_max(f.start, f.i) + f.docid::BIGINT * {_APART} AS start, arg_max(f."end", f.i) + f.docid::BIGINT * {_APART} AS "end", any_value(f.logic) AS logic, string_agg(o.sme_id, '+' ORDER BY f.i) AS contributors
FROM fold f JOIN o ON o.qid = f.qid AND o.docid = f.docid AND o.i = f.i JOIN documents d ON d.doc_id = f.docid::BIGINT GROUP BY f.qid, f.docid, f.gid""")
