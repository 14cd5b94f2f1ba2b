"""The registered queries of the retrieval-evaluation operators and the SQL they are held against.

Inputs are derived from the driver tables: documents as they are; spans at arithmetic places of each document, two
annotators by parity; queries, chunks and relevance from the embeddings and their labels.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegauge.functions import text as tx
from lodegauge.operators import alignment, annotate, checks, chunking, documents, metrics, retrieval, spans
from lodegauge.plans import corpus, transport
from lodegauge.sources import scratch

S = tx.SPACE_SQL
#: Spans a document.
PER_DOC = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return scratch.spread(table(spark, sf, "documents")).select(F.col("doc_id").cast("string").alias("docid"), "text", "doc_id")


def normal(spark: SparkSession, sf: str) -> DataFrame:
    return tx.normalized(docs(spark, sf).select("docid", "doc_id", "text")).withColumn("n", F.length("text"))


def derived_spans(spark: SparkSession, sf: str) -> DataFrame:
    """PER_DOC spans a document that has any text: qid, docid, start, end, text, logic, group, sme_id, src_ord."""
    d = normal(spark, sf).where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(PER_DOC - 1))).alias("k"))
    base = (F.col("doc_id") * 37 + F.floor(F.col("k") / 2) * 53) % F.greatest(F.col("n") - 60, F.lit(1))
    start = F.least(base + F.when(F.col("k") % 2 == 1, (F.col("doc_id") + F.col("k")) % 9).otherwise(0), F.col("n") - 1).cast("long")
    size = (20 + (F.col("doc_id") * 7 + F.col("k") * 11) % 41).cast("long")
    logic = F.when(F.col("doc_id") % 5 == 0, F.element_at(F.array(F.lit("COMPLETE_SPAN"), F.lit("AND"), F.lit("OR")), (F.col("k") % 3 + 1).cast("int"))).otherwise(F.lit("AND"))
    return d.select(
        F.concat(F.lit("q_"), "docid").alias("qid"), "docid", start.alias("start"), F.least(start + size, F.col("n").cast("long")).alias("end"),
        F.trim(tx.text_slice(F.col("text"), start, F.least(start + size, F.col("n").cast("long")))).alias("text"), logic.alias("logic"), F.lit("g1").alias("group"),
        F.when(F.col("k") % 2 == 0, "sme1").otherwise("sme2").alias("sme_id"), F.col("k").cast("long").alias("src_ord"),
    )


def _spans_once(spark: SparkSession, sf: str) -> DataFrame:
    """derived_spans(), written: what reads them more than once does not derive them from the texts again."""
    return scratch.written(derived_spans(spark, sf), "spans")


NORMAL_SQL = f"""normal AS (
  SELECT doc_id, doc_id::VARCHAR AS docid, text, length(text) AS n FROM (
    SELECT doc_id, trim(regexp_replace(translate(text, '’‘”“—–', '''''""--'), '[{S}]+', ' ', 'g'), ' ') AS text FROM documents))"""
SPANS_SQL = f"""raw_spans AS (
  SELECT *, least(((doc_id * 37 + (k // 2) * 53) % greatest(n - 60, 1)) + CASE WHEN k % 2 = 1 THEN (doc_id + k) % 9 ELSE 0 END, n - 1)::BIGINT AS start,
         (20 + (doc_id * 7 + k * 11) % 41)::BIGINT AS size
  FROM normal, unnest(range({PER_DOC})) AS u(k) WHERE n > 0
), spans AS (
  SELECT 'q_' || docid AS qid, docid, start, least(start + size, n)::BIGINT AS "end",
         trim(substring(text, start + 1, least(start + size, n) - start), ' ') AS text,
         CASE WHEN doc_id % 5 = 0 THEN ['COMPLETE_SPAN', 'AND', 'OR'][(k % 3 + 1)::BIGINT] ELSE 'AND' END AS logic,
         CASE WHEN k % 2 = 0 THEN 'sme1' ELSE 'sme2' END AS sme_id, k AS src_ord
  FROM raw_spans)"""


def windows_sql(size: int, over: int) -> str:
    step = size - over
    return f"""SELECT docid, 'CHARWIN{size}OV{over}-' || docid || '-' || printf('%04d', i) AS chunk_id, (i * {step})::BIGINT AS start,
       least(i * {step} + {size}, n)::BIGINT AS "end", substring(text, i * {step} + 1, {size}) AS text
FROM normal, unnest(range(0, greatest(ceil((n - {size}) / {step}::DOUBLE), 0)::BIGINT + 1)) AS u(i) WHERE n > 0"""


SENT_SQL = r"""SELECT docid, 'SENT-' || docid || '-' || printf('%04d', i - 1) AS chunk_id, start, (start + length(s))::BIGINT AS "end", s AS text FROM (
  SELECT docid, i, trim(p, ' ') AS s,
         (sum(length(p)) OVER (PARTITION BY docid ORDER BY i) - length(p) + length(p) - length(ltrim(p, ' ')))::BIGINT AS start
  FROM (SELECT docid, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
    SELECT docid, regexp_extract_all(text, '[^.!?]*[.!?]+["'')\]]*|[^.!?]+$') AS ps FROM normal WHERE n > 0))) WHERE s <> ''"""

TOKENS_SQL = r"""SELECT docid, 'TOKWIN512S128-' || docid || '-' || printf('%04d', w) AS chunk_id, start, "end", substring(text, start + 1, "end" - start) AS text FROM (
  SELECT docid, any_value(text) AS text, w, min(place - length(ltrim(t, ' ')))::BIGINT AS start, max(place)::BIGINT AS "end" FROM (
    SELECT docid, text, t, i, m, sum(length(t)) OVER (PARTITION BY docid ORDER BY i) AS place
    FROM (SELECT docid, text, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS i, len(ts) AS m FROM (
      SELECT docid, text, regexp_extract_all(text, ' ?(?:[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_ ])') AS ts FROM normal WHERE n > 0)))
  , unnest(range(greatest((i - 384) // 128, 0), least(i // 128, greatest(ceil((m - 512) / 128.0), 0)::BIGINT) + 1)) AS u(w)
  GROUP BY docid, w)"""

PAIRS_SQL = """pairs AS (
  SELECT s.qid, s.docid, c.chunk_id, c.strategy, s.src_ord, s.logic,
         (least(s."end", c."end") - greatest(s.start, c.start)) / (s."end" - s.start)::DOUBLE AS cov_span,
         (least(s."end", c."end") - greatest(s.start, c.start)) / (c."end" - c.start)::DOUBLE AS cov_chunk
  FROM spans s JOIN chunks c ON s.docid = c.docid AND s.start < c."end" AND c.start < s."end" WHERE s.start < s."end")"""
CHUNKS_SQL = f"""chunks AS (
  SELECT *, 'CHARWIN500_OV50' AS strategy FROM ({windows_sql(500, 50)})
  UNION ALL SELECT *, 'CHARBLOCK1000_NOV0' FROM ({windows_sql(1000, 0)})
  UNION ALL SELECT *, 'SENT' FROM ({SENT_SQL})
  UNION ALL SELECT *, 'TOKWIN512_S128' FROM ({TOKENS_SQL}))"""

TOP_SQL = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
scored AS (
  SELECT 'q' || q.vec_id AS qid, c.vec_id::VARCHAR AS chunk_id, round(list_inner_product(q.e, c.e), 8) AS score, q.label = c.label AS same
  FROM unit q JOIN unit c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), run AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id DESC) AS rank FROM scored QUALIFY rank <= 20
), judged AS (
  SELECT run.qid, chunk_id, row_number() OVER (PARTITION BY run.qid ORDER BY score::FLOAT DESC, chunk_id DESC) AS rank, same::INT AS hit, num_rel
  FROM run JOIN (SELECT qid, count(*) AS num_rel FROM scored WHERE same GROUP BY qid) USING (qid)
), found AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS found FROM judged),
per_query AS (
  SELECT qid, sum(CASE WHEN hit = 1 THEN found / rank::DOUBLE ELSE 0 END) / max(num_rel) AS map,
         sum(CASE WHEN rank <= 10 THEN hit / log2(rank + 1) ELSE 0 END)
           / max((SELECT sum(1 / log2(i + 1)) FROM range(1, 11) AS r(i) WHERE i <= num_rel)) AS ndcg_cut_10,
         sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) / 5.0::DOUBLE AS P_5, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) / 10.0::DOUBLE AS P_10,
         sum(hit)::DOUBLE / max(num_rel) AS recall_100, sum(CASE WHEN rank <= 20 THEN hit ELSE 0 END)::DOUBLE / max(num_rel) AS recall_20,
         count(*) AS num_ret, max(num_rel) AS num_rel, sum(hit) AS num_rel_ret, coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rank END), 0) AS recip_rank
  FROM found GROUP BY qid)"""


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", "embedding")


def _asked(vectors: DataFrame) -> DataFrame:
    """The queries: every vector whose id is divisible by 20."""
    return vectors.where("vec_id % 20 = 0").withColumn("qid", F.concat(F.lit("q"), "vec_id"))


def topk(spark: SparkSession, sf: str) -> DataFrame:
    """Each query's 20 best of all vectors but its own: one more is retrieved, as a query finds itself."""
    v = _vectors(spark, sf)
    c = v.where("vec_id is not null").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    others = retrieval.retrieve(_asked(v).select("qid", "embedding"), c, 21).where(F.col("qid") != F.concat(F.lit("q"), "chunk_id"))
    return others.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 20")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """What metrics.judged() gives for the run and judgments that hold all other vectors of a query's label relevant.
    Those pairs grow with the square of the table, so relevant vectors are counted by label, and rows of the run are
    judged by the two labels."""
    v = _vectors(spark, sf)
    counted = v.where("label is not null").groupBy("label").agg((F.count("*") - 1).alias("num_rel")).where("num_rel > 0")
    gains = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least("num_rel", F.lit(10))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    asked = _asked(v).select("qid", "label").join(scratch.lookup(scratch.written(counted, "relevant")), "label").select("qid", F.col("label").alias("asked"), "num_rel", gains.alias("ideal"))
    rows = topk(spark, sf).join(asked, "qid").join(v.select(F.col("vec_id").cast("string").alias("chunk_id"), "label"), "chunk_id")
    order = Window.partitionBy("qid").orderBy(F.desc(F.col("score").cast("float")), F.desc("chunk_id"))
    same = F.coalesce(F.col("label") == F.col("asked"), F.lit(False)).cast("int")
    return rows.select(F.lit("dense").alias("strategy"), "qid", "chunk_id", F.row_number().over(order).alias("rank"), same.alias("rel"), "num_rel", "ideal")


def per_query(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.measured(_judged(spark, sf))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All strategies' chunks by their offsets; what is aligned or counted needs no texts."""
    return chunking.chunk_all(docs(spark, sf), texts=False)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.overlapping_pairs(derived_spans(spark, sf), _chunks(spark, sf), 4096)


def _measures(*names: str):
    def q(spark, sf):
        return per_query(spark, sf).select("qid", *[F.round(n, 6).alias(n) if not n.startswith("num") else F.col(n).cast("long") for n in names])

    return q, f"WITH {TOP_SQL} SELECT qid, {', '.join(f'round({n}, 6) AS {n}' if not n.startswith('num') else f'{n}::BIGINT AS {n}' for n in names)} FROM per_query"


def _located(spark: SparkSession, sf: str, snap: bool) -> DataFrame:
    """A snippet cut from each document, dressed up, and found again."""
    d = normal(spark, sf).where("n > 0")
    cut = F.substring("text", (F.col("doc_id") * 13 % F.greatest(F.col("n") - 60, F.lit(1))).cast("int") + 1, F.lit(40))
    dressed = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('"'), cut, F.lit('"...'))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("  "), F.translate(cut, ascii_lowercase, ascii_uppercase))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("_"), F.trim(cut), F.lit("_"))).otherwise(cut)
    rows = d.select("docid", F.col("text").alias("doc_text"), dressed.alias("snippet"))
    return spans.locate_span(rows, snap=snap).select("docid", "start", "end", "span_text")


def _locating(snap: bool, keep: str) -> str:
    """From dressed (snippet and the document's text): found, snapped (``keep``, text, s, e)."""
    before = f"length(regexp_extract(substring(text, 1, place - 1), '[^{S}]*$'))" if snap else "0"
    after = f"length(regexp_extract(substring(text, place + m), '^[^{S}]*'))" if snap else "0"
    return f"""core0 AS (
  SELECT *, trim(regexp_replace(regexp_replace(trim(snippet, ' '), '[{S}]*(?:\\.\\.\\.|…|\\.\\.)$', ''), '[{S}]+', ' ', 'g'), ' ') AS k FROM dressed
), core AS (
  SELECT *, regexp_replace(regexp_replace(k, '^[,."'' ]+', ''), '[,."'' ]+$', '') AS v FROM core0
), forms AS (
  SELECT *, list_filter([v, CASE WHEN contains(v, '_') THEN replace(v, '_', ' ') END, CASE WHEN contains(v, '_') THEN replace(v, '_', '') END,
     CASE WHEN length(v) > 2 AND starts_with(v, '_') AND ends_with(v, '_') AND NOT starts_with(v, '__') THEN substring(v, 2, length(v) - 2) END],
     lambda x: x IS NOT NULL AND x <> '') AS vs FROM core
), hits AS (
  SELECT *, list_filter(list_transform(vs, lambda x: {{'place': strpos(lower(text), lower(x)), 'm': length(x)}}), lambda h: h['place'] > 0)[1] AS h FROM forms
), found AS (SELECT {keep}, text, h['place'] AS place, h['m'] AS m FROM hits
), snapped AS (SELECT {keep}, text, (place - 1 - {before})::BIGINT AS s, (place - 1 + m + {after})::BIGINT AS e FROM found)"""


def _located_sql(snap: bool) -> str:
    return f"""WITH {NORMAL_SQL}, cut AS (
  SELECT *, substring(text, (doc_id * 13 % greatest(n - 60, 1)) + 1, 40) AS c FROM normal WHERE n > 0
), dressed AS (
  SELECT *, CASE doc_id % 4 WHEN 0 THEN '"' || c || '"...' WHEN 1 THEN '  ' || translate(c, '{ascii_lowercase}', '{ascii_uppercase}') WHEN 2 THEN '_' || trim(c, ' ') || '_' ELSE c END AS snippet FROM cut
), {_locating(snap, "docid")}
SELECT docid, s AS start, e AS "end", nullif(trim(substring(text, s + 1, e - s), ' '), '') AS span_text FROM snapped"""


#: The offline generator's questions and answers, located and merged: up to two distinct spans a question.
GENERATED_SQL = f"""WITH {NORMAL_SQL}, sent AS (
  SELECT docid, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (
    SELECT doc_id::VARCHAR AS docid, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]'), lambda x: regexp_replace(regexp_replace(x, '^[{S}]+', ''), '[{S}]+$', '')), lambda x: x <> '') AS p FROM documents)
), asked AS (
  SELECT DISTINCT docid, question, 'q_' || substring(sha256(docid || chr(1) || question), 1, 8) AS qid, split_part(question, chr(10), 1) AS wanted
  FROM (SELECT docid, 'What is said by: ' || substring(s, 1, 60) || '?' AS question FROM sent WHERE i <= 6)
), told AS (
  SELECT a.docid, a.qid, a.question, x.s, x.i FROM asked a JOIN sent x ON x.docid = a.docid AND contains(a.wanted, substring(x.s, 1, 20))
), replies AS (
  SELECT docid, qid, s, row_number() OVER w AS r, count(*) OVER (PARTITION BY docid, qid, question) AS n FROM told WINDOW w AS (PARTITION BY docid, qid, question ORDER BY i)
  UNION ALL SELECT a.docid, a.qid, x.s, 1, 1 FROM asked a JOIN sent x ON x.docid = a.docid AND x.i = 1 WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.docid = a.docid AND t.question = a.question)
), dressed AS (
  SELECT qid, docid, CASE WHEN replies.n = 1 THEN 'COMPLETE_SPAN' ELSE 'OR' END AS logic, s AS snippet, normal.text FROM replies JOIN normal USING (docid) WHERE r <= 2
), {_locating(True, "qid, docid, logic")}, spans AS (
  SELECT DISTINCT qid, docid, logic, s AS start, e AS "end" FROM snapped WHERE trim(substring(text, s + 1, e - s), ' ') <> ''
), placed AS (
  SELECT *, row_number() OVER w AS i, lead(start) OVER w AS s2, lead("end") OVER w AS e2, lag(start) OVER w AS s0, lag("end") OVER w AS e0 FROM spans WINDOW w AS (PARTITION BY qid, docid ORDER BY start, "end")
), near AS (
  SELECT *, coalesce(s2 IS NOT NULL AND least("end", e2) > greatest(start, s2) AND 2 * (least("end", e2) - greatest(start, s2)) >= greatest("end", e2) - least(start, s2), false) AS grows,
         coalesce(s0 IS NOT NULL AND least("end", e0) > greatest(start, s0) AND 2 * (least("end", e0) - greatest(start, s0)) >= greatest("end", e0) - least(start, s0), false) AS goes FROM placed)
SELECT qid, docid, start, CASE WHEN grows THEN greatest("end", e2) ELSE "end" END AS "end", logic FROM near WHERE NOT goes"""


MERGE_SQL = f"""WITH RECURSIVE {NORMAL_SQL}, {SPANS_SQL}, o AS (
  SELECT *, row_number() OVER (PARTITION BY qid, docid ORDER BY start, "end", src_ord) AS i FROM spans WHERE start < "end"
), fold AS (
  SELECT qid, docid, i, start, "end", logic, 1 AS gid, false AS clash, start AS ps, "end" AS pe, logic AS pl, start AS cs, "end" AS ce, logic AS cl FROM o WHERE i = 1
  UNION ALL
  SELECT qid, docid, i, CASE WHEN near AND same THEN least(fs, s) ELSE s END, CASE WHEN near AND same THEN greatest(fe, e) ELSE e END, l,
         CASE WHEN near AND same THEN gid ELSE gid + 1 END, near AND NOT same, fs, fe, fl, s, e, l
  FROM (SELECT o.qid, o.docid, o.i, f.start AS fs, f."end" AS fe, f.logic AS fl, o.start AS s, o."end" AS e, o.logic AS l, f.gid,
               f.logic = o.logic AS same,
               least(f."end", o."end") > greatest(f.start, o.start)
                 AND 2 * (least(f."end", o."end") - greatest(f.start, o.start)) >= greatest(f."end", o."end") - least(f.start, o.start) AS near
        FROM fold f JOIN o ON f.qid = o.qid AND f.docid = o.docid AND o.i = f.i + 1)
)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def marked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with typographic characters put in, so that cleaning has something to do."""
    return docs(spark, sf).withColumn("text", F.concat(F.lit("“Café” — ‘a’ – b… •™﻿ \t c\r\n"), "text"))


MARKED_SQL = """marked AS (SELECT doc_id, doc_id::VARCHAR AS docid, '“Cafe' || chr(769) || '” — ‘a’ – b…' || chr(160) || '•™' || chr(65279) || ' ' || chr(9) || ' c' || chr(13) || chr(10) || text AS text FROM documents)"""

register("normalize_offsets", lambda s, d: marked(s, d).select("docid", tx.normalize_offsets(F.col("text")).alias("text")),
         f"""WITH {MARKED_SQL} SELECT docid, trim(regexp_replace(translate(text, '’‘”“—–', '''''""--'), '[{S}]+', ' ', 'g'), ' ') AS text FROM marked""")
register("normalize_corpus", lambda s, d: marked(s, d).select("docid", tx.normalize_corpus(F.col("text")).alias("text")),
         f"""WITH {MARKED_SQL} SELECT docid, replace(replace(regexp_replace(replace(replace(replace(replace(translate(nfc_normalize(text), '“”‘’–•' || chr(160), '""' || '''''' || '-* '),
             '™', ''), chr(65279), ''), '—', ' -- '), '…', '...'), '[ \t]+', ' ', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM marked""")


def _sectioned(spark, sf):
    d = docs(spark, sf)
    book = F.concat(F.lit("front matter\nCHAPTER I. One\n"), "text", F.lit("\nCHAPTER II.\n  Two\n"), "text", F.lit("\nTHE END\nback matter"))
    return documents.split_sections(documents.extract_main_text(d.select("doc_id", book.alias("text"))), keep=("doc_id",))


register("split_sections", _sectioned, f"""
SELECT doc_id, 'doc:ch01' AS docid, 'CHAPTER I. One' AS title, regexp_replace(regexp_replace(text, '^[{S}]+', ''), '[{S}]+$', '') AS text FROM documents
UNION ALL SELECT doc_id, 'doc:ch02', 'CHAPTER II.' || chr(10) || '  Two', regexp_replace(regexp_replace(text, '^[{S}]+', ''), '[{S}]+$', '') FROM documents""")
register("unicode_scan", lambda s, d: documents.unicode_scan(docs(s, d), names=False).select("codepoint", "ch", "n", "more"), r"""
SELECT unicode(ch)::BIGINT AS codepoint, ch, count(*)::BIGINT AS n, greatest(count(*) - 3, 0)::BIGINT AS more
FROM (SELECT unnest(string_split(nfc_normalize(text), '')) AS ch FROM documents) WHERE regexp_matches(ch, '[^\n\t\x20-\x7e]') GROUP BY ch""")
register("unicode_examples", lambda s, d: documents.unicode_scan(docs(s, d), names=False).select("codepoint", F.array_join("examples", "|").alias("examples")), r"""
SELECT unicode(ch)::BIGINT AS codepoint, string_agg(replace(replace(substring(text, (greatest(i - 20, 0) + 1)::BIGINT, (20 + least(i, 20))::BIGINT), chr(10), '\n'), chr(9), '\t'), '|' ORDER BY docid, i) AS examples FROM (
  SELECT docid, text, ch, i FROM (SELECT doc_id::VARCHAR AS docid, nfc_normalize(text) AS text, unnest(string_split(nfc_normalize(text), '')) AS ch, generate_subscripts(string_split(nfc_normalize(text), ''), 1) - 1 AS i FROM documents)
  WHERE regexp_matches(ch, '[^\n\t\x20-\x7e]') QUALIFY row_number() OVER (PARTITION BY ch ORDER BY docid, i) <= 3) GROUP BY ch""")
register("chunk_charwin", lambda s, d: chunking.char_windows(docs(s, d), 500, 50), f"WITH {NORMAL_SQL} {windows_sql(500, 50)}")
register("chunk_charblock", lambda s, d: chunking.char_blocks(docs(s, d), 1000), f"WITH {NORMAL_SQL} {windows_sql(1000, 0)}")
register("chunk_sentences", lambda s, d: chunking.sentences(docs(s, d)), f"WITH {NORMAL_SQL} {SENT_SQL}")
register("chunk_tokens", lambda s, d: chunking.token_windows(docs(s, d), 512, 128), f"WITH {NORMAL_SQL} {TOKENS_SQL}")
register("chunk_stats", lambda s, d: chunking.chunk_stats(_chunks(s, d)),
         f"WITH {NORMAL_SQL}, {CHUNKS_SQL} SELECT strategy, count(*) AS chunks, count(DISTINCT docid) AS docs, round(avg(length(text)), 6) AS mean_length FROM chunks GROUP BY strategy")
register("chunk_tokenizer", lambda s, d: chunking.tokenizer_windows(docs(s, d), chunking.public_tokenizer(), 512, 128))
register("chunk_packed", lambda s, d: chunking.packed_sentences(docs(s, d), 512))
register("locate_span", lambda s, d: _located(s, d, False), _located_sql(False))
register("locate_span_snap", lambda s, d: _located(s, d, True), _located_sql(True))
register("iou_pairs", lambda s, d: spans.iou_pairs(derived_spans(s, d)), f"""WITH {NORMAL_SQL}, {SPANS_SQL}, p AS (
  SELECT qid, docid, start, "end", lead(start) OVER w AS start_2, lead("end") OVER w AS end_2 FROM spans WINDOW w AS (PARTITION BY qid, docid ORDER BY start, "end", src_ord))
SELECT *, round(greatest(least("end", end_2) - greatest(start, start_2), 0) / (greatest("end", end_2) - least(start, start_2))::DOUBLE, 6) AS iou FROM p WHERE start_2 IS NOT NULL""")
register("merge_spans", lambda s, d: spans.merge_spans(_spans_once(s, d), docs(s, d)).select("qid", "docid", "start", "end", "text", "logic"),
         MERGE_SQL + """ SELECT f.qid, f.docid, f.start, f."end", trim(substring(n.text, f.start + 1, f."end" - f.start), ' ') AS text, f.logic
FROM fold f JOIN normal n ON f.docid = n.docid QUALIFY row_number() OVER (PARTITION BY f.qid, f.docid, f.gid ORDER BY f.i DESC) = 1""")
register("merge_contributors", lambda s, d: spans.merge_spans(_spans_once(s, d), docs(s, d)).select("qid", "docid", "start", "end", "contributors"),
         MERGE_SQL + """ SELECT f.qid, f.docid, arg_max(f.start, f.i) AS start, arg_max(f."end", f.i) AS "end", string_agg(o.sme_id, '+' ORDER BY f.i) AS contributors
FROM fold f JOIN o ON o.qid = f.qid AND o.docid = f.docid AND o.i = f.i GROUP BY f.qid, f.docid, f.gid""")
register("merge_without_document", lambda s, d: spans.merge_spans(_spans_once(s, d), docs(s, d).where("doc_id % 13 <> 0")).where("sme_id is not null").select("qid", "docid", "start", "end", "text", "logic", "sme_id"),
         f"""WITH {NORMAL_SQL}, {SPANS_SQL} SELECT qid, docid, start, "end", text, logic, sme_id FROM spans WHERE docid::BIGINT % 13 = 0""")
register("merge_conflicts", lambda s, d: spans.merge_conflicts(derived_spans(s, d)).select("qid", "docid", "start_1", "end_1", "logic_1", "start_2", "end_2", "logic_2", "iou"),
         MERGE_SQL + """ SELECT qid, docid, ps AS start_1, pe AS end_1, pl AS logic_1, cs AS start_2, ce AS end_2, cl AS logic_2,
round((least(pe, ce) - greatest(ps, cs)) / (greatest(pe, ce) - least(ps, cs))::DOUBLE, 4) AS iou FROM fold WHERE clash""")
T, C = 0.85, 0.05
register("align_qrels", lambda s, d: alignment.align(derived_spans(s, d), _chunks(s, d), T, C, 4096).select("strategy", "qid", "chunk_id", "rel"),
         f"WITH {NORMAL_SQL}, {SPANS_SQL}, {CHUNKS_SQL}, {PAIRS_SQL} SELECT DISTINCT strategy, qid, chunk_id, 1 AS rel FROM pairs WHERE cov_span >= {T} AND cov_chunk >= {C}")


def _windows_judged(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align_char_windows(derived_spans(spark, sf), normal(spark, sf).select("docid", "n"), 500, 50, T, C).select("qid", "chunk_id", "rel")


register("align_qrels_arithmetic", _windows_judged,
         f"WITH {NORMAL_SQL}, {SPANS_SQL}, {CHUNKS_SQL}, {PAIRS_SQL} SELECT DISTINCT qid, chunk_id, 1 AS rel FROM pairs WHERE strategy = 'CHARWIN500_OV50' AND cov_span >= {T} AND cov_chunk >= {C}")
register("align_counts", lambda s, d: alignment.align_counts(derived_spans(s, d), _chunks(s, d), T, C, 4096),
         f"WITH {NORMAL_SQL}, {SPANS_SQL}, {CHUNKS_SQL}, {PAIRS_SQL} SELECT strategy, count(*) AS alignments, count(DISTINCT (qid, chunk_id)) AS judgments, count(DISTINCT qid) AS queries FROM pairs WHERE cov_span >= {T} AND cov_chunk >= {C} GROUP BY strategy")
_grid = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a in alignment.SPAN_GRID for b in alignment.CHUNK_GRID)
GRID_SQL = f"""WITH {NORMAL_SQL}, {SPANS_SQL}, {CHUNKS_SQL}, {PAIRS_SQL}, g AS (
  SELECT t_span, t_chunk, count(cov_span) AS n, coalesce(avg(cov_span), 0) AS a, coalesce(avg(cov_chunk), 0) AS b
  FROM (VALUES {_grid}) AS v(t_span, t_chunk) LEFT JOIN pairs ON cov_span >= t_span AND cov_chunk >= t_chunk GROUP BY ALL
), grid AS (
  SELECT t_span, t_chunk, n, round(a, 9) AS avg_span, round(b, 9) AS avg_chunk, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 9) AS f FROM g)"""
register("threshold_grid", lambda s, d: alignment.threshold_grid(_pairs(s, d)), GRID_SQL + " SELECT * FROM grid")
register("threshold_best", lambda s, d: alignment.threshold_best(alignment.threshold_grid(_pairs(s, d))), GRID_SQL + " SELECT * FROM grid ORDER BY f DESC, n DESC, t_span, t_chunk LIMIT 1")
register("topk_cosine", lambda s, d: topk(s, d).select("qid", "chunk_id", "rank", F.round("score", 6).alias("score")), f"WITH {TOP_SQL} SELECT qid, chunk_id, rank::INT AS rank, round(score, 6) AS score FROM run")
for _name, _cols in {"eval_map": ("map",), "eval_ndcg10": ("ndcg_cut_10",), "eval_precision": ("P_5", "P_10"), "eval_recall": ("recall_20", "recall_100"), "eval_mrr": ("recip_rank",), "eval_counts": ("num_ret", "num_rel", "num_rel_ret")}.items():
    register(_name, *_measures(*_cols))
register("eval_summary", lambda s, d: metrics.summed(per_query(s, d)),
         f"WITH {TOP_SQL} SELECT 'dense' AS strategy, {', '.join(f'sum({m})::BIGINT AS {m}' if m.startswith('num') else f'round(avg({m}), 4) AS {m}' for m in metrics.MEASURES)} FROM per_query")


def _ags(spark, sf):
    """Spans aligned to char windows; the run ranks each document's windows by a hash."""
    sp = derived_spans(spark, sf)
    ch = chunking.char_windows(docs(spark, sf)).withColumn("strategy", F.lit("w"))
    hits = alignment.aligned_pairs(sp.withColumn("span_no", F.col("src_ord")), ch, T, C, 4096)
    keys = ["qid", "docid", "group", "logic", "span_no"]
    every = sp.where("start < `end`").select("qid", "docid", "group", "logic", F.col("src_ord").alias("span_no")).join(hits.select(*keys, "chunk_id"), keys, "left").withColumn("strategy", F.lit("w"))
    run = ch.select("strategy", F.concat(F.lit("q_"), "docid").alias("qid"), "chunk_id", (F.col("start") * 7919 % 1009).cast("double").alias("score"))
    return metrics.ags_at_k(run, every, 3).select("qid", "success")


register("ags_at_k", _ags, f"""WITH {NORMAL_SQL}, {SPANS_SQL}, chunks AS (SELECT *, 'w' AS strategy FROM ({windows_sql(500, 50)})), {PAIRS_SQL}, top AS (
  SELECT chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY docid ORDER BY ((start * 7919) % 1009)::FLOAT DESC, chunk_id DESC) <= 3
), covered AS (
  SELECT s.qid, s.src_ord, any_value(s.logic) AS logic, coalesce(bool_or(top.chunk_id IS NOT NULL), false) AS ok
  FROM spans s LEFT JOIN (SELECT * FROM pairs WHERE cov_span >= {T} AND cov_chunk >= {C}) p ON p.qid = s.qid AND p.src_ord = s.src_ord LEFT JOIN top ON top.chunk_id = p.chunk_id
  GROUP BY s.qid, s.src_ord)
SELECT qid, CASE WHEN max(logic) = 'AND' THEN bool_and(ok) ELSE bool_or(ok) END AS success FROM covered GROUP BY qid""")


def _bad_spans(spark, sf):
    s = derived_spans(spark, sf)
    num = F.col("docid").cast("long")
    return s.where((num % 11 != 0)).withColumn("end", F.when(num % 7 == 0, F.col("end") + 100000).otherwise(F.col("end"))).withColumn("text", F.when(num % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))


def _check_spans(spark, sf):
    q = derived_spans(spark, sf).select("qid", "docid").distinct()
    there = docs(spark, sf).where("doc_id % 13 <> 0")
    return checks.check_annotations(q, _bad_spans(spark, sf), there, "sme").groupBy("qid", "docid", "code").agg(F.count("*").alias("n"))


register("check_spans", _check_spans, f"""WITH {NORMAL_SQL}, {SPANS_SQL}, bad AS (
  SELECT qid, docid, docid::BIGINT AS num, start, CASE WHEN docid::BIGINT % 7 = 0 THEN "end" + 100000 ELSE "end" END AS "end", CASE WHEN docid::BIGINT % 5 = 0 THEN text || 'x' ELSE text END AS text FROM spans WHERE docid::BIGINT % 11 <> 0
), codes AS (
  SELECT DISTINCT qid, docid, 'sme:NO_SPAN_FOR_QUESTION' AS code FROM spans WHERE docid::BIGINT % 11 = 0
  UNION ALL SELECT DISTINCT qid, docid, 'DOC_NOT_FOUND' FROM bad WHERE num % 13 = 0
  UNION ALL SELECT b.qid, b.docid, CASE WHEN NOT (0 <= b.start AND b.start <= b."end" AND b."end" <= n.n) THEN 'sme:INVALID_OFFSETS'
      WHEN trim(substring(n.text, b.start + 1, b."end" - b.start), ' ') <> b.text THEN 'sme:TEXT_MISMATCH' END FROM bad b JOIN normal n USING (docid) WHERE num % 13 <> 0)
SELECT qid, docid, code, count(*) AS n FROM codes WHERE code IS NOT NULL GROUP BY ALL""")


def _check_chunks(spark, sf):
    c = chunking.char_windows(docs(spark, sf)).withColumnRenamed("docid", "original_doc_id")
    num = F.col("original_doc_id").cast("long")
    bad = c.withColumn("text", F.when(num % 3 == 0, F.concat("text", F.lit("x"))).when(num % 5 == 0, F.lit(None)).otherwise(F.col("text"))).withColumn("end", F.when(num % 7 == 0, F.col("end") + 100000).otherwise(F.col("end")))
    return checks.check_chunks(bad, docs(spark, sf).where("doc_id % 13 <> 0")).groupBy("docid", "code").agg(F.count("*").alias("n"))


register("check_chunks", _check_chunks, f"""WITH {NORMAL_SQL}, c AS ({windows_sql(500, 50)}), k AS (
  SELECT docid, docid::BIGINT AS num FROM c)
SELECT docid, CASE WHEN num % 3 <> 0 AND num % 5 = 0 THEN 'MISSING_FIELDS:text' WHEN num % 13 = 0 THEN 'DOC_NOT_FOUND' WHEN num % 7 = 0 THEN 'INVALID_OFFSETS' WHEN num % 3 = 0 THEN 'TEXT_MISMATCH' END AS code, count(*) AS n
FROM k WHERE num % 13 = 0 OR num % 7 = 0 OR num % 3 = 0 OR num % 5 = 0 GROUP BY ALL""")


def _q(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("qid"), F.col("source").alias("docid"), F.col("text").alias("question"))


def _a(spark, sf):
    logic = F.element_at(F.array(F.lit("COMPLETE_SPAN"), F.lit("AND"), F.lit("OR")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("qid"), logic.alias("logic"), F.col("doc_id").alias("src_ord"), "quality")


register("coverage_summary", lambda s, d: checks.coverage_summary(_q(s, d), _a(s, d).where("quality = 1"), _a(s, d).where("src_ord % 2 = 0")), """
WITH f AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS a, doc_id IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0) AS b FROM documents)
SELECT count(*) AS questions, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_1, count(*) FILTER (b AND NOT a) AS only_2, count(*) FILTER (NOT a AND NOT b) AS neither FROM f""")
DIST_SQL = """dist AS (SELECT d.source AS docid, d.doc_id::VARCHAR AS qid, CASE WHEN length(d.text) <= 100 THEN d.text ELSE substring(d.text, 1, 100) || '...' END AS question,
  count(l.doc_id)::BIGINT AS spans, coalesce(any_value(CASE WHEN l.doc_id IS NOT NULL THEN ['COMPLETE_SPAN', 'AND', 'OR'][l.doc_id % 3 + 1] END), 'N/A') AS logic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id, d.source, d.text)"""
register("distribution", lambda s, d: checks.distribution(_q(s, d), _a(s, d)), f"WITH {DIST_SQL} SELECT * FROM dist")
register("distribution_totals", lambda s, d: checks.distribution_totals(checks.distribution(_q(s, d), _a(s, d))),
         f"WITH {DIST_SQL} SELECT docid, count(*) AS questions, sum(spans)::BIGINT AS spans, count(*) FILTER (spans = 0) AS without FROM dist GROUP BY ROLLUP (docid)")
register("logic_counts", lambda s, d: checks.logic_counts(_a(s, d).where("logic <> 'OR'")), """
SELECT v.logic, count(l.doc_id)::BIGINT AS n FROM (VALUES ('COMPLETE_SPAN'), ('AND'), ('OR')) AS v(logic)
LEFT JOIN labels l ON ['COMPLETE_SPAN', 'AND', 'OR'][l.doc_id % 3 + 1] = v.logic AND v.logic <> 'OR' GROUP BY v.logic""")
register("anti_missing", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
register("semi_covered", lambda s, d: table(s, d, "documents").join(table(s, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")


def _sets(spark, sf):
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels")
    a, b = lab.where("quality = 1").select("doc_id"), lab.where("doc_id % 2 = 0").select("doc_id")
    parts = {"both": a.intersect(b), "only_1": a.subtract(b), "only_2": b.subtract(a), "neither": d.subtract(a.union(b).distinct())}
    out = None
    for k, v in parts.items():
        one = v.withColumn("part", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


register("set_ops", _sets, """WITH a AS (SELECT doc_id FROM labels WHERE quality = 1), b AS (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)
SELECT doc_id, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT doc_id, 'only_1' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT doc_id, 'only_2' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT doc_id, 'neither' FROM (SELECT doc_id FROM documents EXCEPT (SELECT * FROM a UNION SELECT * FROM b))""")


def _run_lines(spark, sf):
    e = table(spark, sf, "embeddings")
    score = F.when(F.col("vec_id") % 9 == 0, F.lit("x")).otherwise((F.col("vec_id") % 100).cast("string"))
    rest = F.when(F.col("vec_id") % 7 == 0, F.lit("run extra")).otherwise(F.lit("run"))
    return e.select(F.lit("s").alias("strategy"), F.col("vec_id").alias("line_no"), F.concat_ws(" \t ", F.concat(F.lit("q"), F.col("vec_id") % 10), F.lit("Q0"), F.concat(F.lit("c"), F.col("vec_id") % 30), F.lit("1"), score, rest).alias("value"))


register("parse_run_lines", lambda s, d: metrics.parse_run(_run_lines(s, d)).select("qid", "chunk_id", "score"), """
SELECT 'q' || vec_id % 10 AS qid, 'c' || vec_id % 30 AS chunk_id, arg_max((vec_id % 100)::DOUBLE, vec_id) AS score FROM embeddings WHERE vec_id % 9 <> 0 AND vec_id % 7 <> 0 GROUP BY 1, 2""")
register("last_wins", lambda s, d: metrics.parse_qrels(_run_lines(s, d).withColumn("value", F.concat_ws("\t", F.concat(F.lit("q"), F.col("line_no") % 10), F.lit("0"), F.concat(F.lit("c"), F.col("line_no") % 30), (F.col("line_no") % 4).cast("string")))).select("qid", "chunk_id", "rel"),
         "SELECT 'q' || vec_id % 10 AS qid, 'c' || vec_id % 30 AS chunk_id, arg_max((vec_id % 4)::INT, vec_id) AS rel FROM embeddings GROUP BY 1, 2")


def _replies(spark, sf):
    c = table(spark, sf, "conversations")
    said = F.col("text")
    answers = F.when(F.col("turn") % 3 == 0, F.array(said)).when(F.col("turn") % 3 == 1, F.array(said, F.lit("  "), F.lit("two"))).otherwise(F.array(F.lit(" ")))
    logic = F.when(F.col("conv_id") % 4 == 0, "AND").when(F.col("conv_id") % 4 == 1, "BAD")
    body = F.to_json(F.struct(answers.alias("answers"), logic.alias("logic")))
    reply = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return c.select("conv_id", "turn", reply.alias("reply"))


register("parse_llm_json", lambda s, d: annotate.parse_answers(_replies(s, d)).select("conv_id", "turn", F.array_join("answers", "|").alias("answers"), "logic"), f"""
WITH a AS (SELECT conv_id, turn, list_filter(list_transform(CASE turn % 3 WHEN 0 THEN [text] WHEN 1 THEN [text, '  ', 'two'] ELSE [' '] END,
    lambda x: regexp_replace(regexp_replace(x, '^[{S}]+', ''), '[{S}]+$', '')), lambda x: x IS NOT NULL AND x <> '') AS answers, CASE conv_id % 4 WHEN 0 THEN 'AND' WHEN 1 THEN 'BAD' END AS logic FROM conversations)
SELECT conv_id, turn, array_to_string(answers, '|') AS answers, CASE WHEN logic = 'AND' THEN 'AND' WHEN len(answers) = 1 THEN 'COMPLETE_SPAN' ELSE 'OR' END AS logic FROM a WHERE len(answers) > 0""")
register("head_tail_sample", lambda s, d: checks.sample_rows(chunking.char_windows(docs(s, d)), "docid", "start", 2, 2, 0).select("docid", "chunk_id"), f"""
WITH {NORMAL_SQL}, c AS ({windows_sql(500, 50)}) SELECT docid, chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY docid ORDER BY start) <= 2 OR row_number() OVER (PARTITION BY docid ORDER BY start DESC) <= 2""")
register("random_sample", lambda s, d: checks.sample_rows(chunking.char_windows(docs(s, d)), "docid", "start", 1, 1, 2, seed=7).select("docid", "chunk_id"), f"""
WITH {NORMAL_SQL}, c AS ({windows_sql(500, 50)}), m AS (SELECT docid, chunk_id, start, row_number() OVER (PARTITION BY docid ORDER BY start) = 1 OR row_number() OVER (PARTITION BY docid ORDER BY start DESC) = 1 AS ends FROM c)
SELECT docid, chunk_id FROM m QUALIFY ends OR row_number() OVER (PARTITION BY docid, ends ORDER BY md5('7:' || start), start) <= 2""")


def _metadata(spark, sf):
    from lodegauge.operators.metadata import table_metadata

    rows = []
    for t in ("documents", "labels", "lineitem"):
        m = table_metadata(table(spark, sf, t), t)
        rows += [(t, m["number_of_rows"], m["number_of_columns"], c["name"], c["type"]) for c in m["columns"]]
    return spark.createDataFrame(rows, "table string, number_of_rows long, number_of_columns long, name string, type string")


register("table_metadata", _metadata, """SELECT "table", number_of_rows, number_of_columns, name, type FROM (
""" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS number_of_rows, (count(*) OVER ())::BIGINT AS number_of_columns, column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int64' WHEN 'DOUBLE' THEN 'float64' WHEN 'FLOAT' THEN 'float64' WHEN 'BOOLEAN' THEN 'bool' ELSE 'object' END AS type FROM information_schema.columns WHERE table_name = '{t}'" for t in ("documents", "labels", "lineitem")) + ")")


def _embedded(spark, sf):
    got = retrieval.embed(docs(spark, sf).select("docid", "text"))
    return got.select("docid", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


register("embed_texts", _embedded, "SELECT doc_id::VARCHAR AS docid, 256::BIGINT AS dim, CASE WHEN regexp_matches(text, '[^ \\t-\\r]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents")


def _annotated(spark, sf):
    """Questions and answers by the offline generator, located and merged."""
    from lodegauge.sources import scratch

    d = docs(spark, sf).select("docid", "text")
    q = scratch.written(annotate.generate_questions(d), "questions")
    a = scratch.written(annotate.annotate(q, d, "sme1"), "annotations")
    b = scratch.written(annotate.annotate(q, d, "sme2"), "annotations")
    return spans.merge_spans(spans.with_order([a, b], ["sme1", "sme2"]), d).select("qid", "docid", "start", "end", "logic")


register("generate_and_annotate", _annotated, GENERATED_SQL)


def _event_windows(spark, sf):
    from lodegauge.streaming.pipelines import event_counts

    return event_counts(table(spark, sf, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "value")


register("event_windows", _event_windows, "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
transport.add(register)
corpus.add(register)
