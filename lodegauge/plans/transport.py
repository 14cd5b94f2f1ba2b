"""Queries that go through files and streams: what a sink writes, a reader reads back, held against SQL on the tables.

Folders are new ones under the shared root, deleted when the driver's JVM ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegauge.operators import chunking, metadata, metrics, retrieval, spans
from lodegauge.sources import exact, readers, schemas, scratch, sinks
from lodegauge.streaming import merging, pipelines


def _chunks_back(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Manifests of all char strategies by strategy, compressed, read as JSON Lines."""
    path = scratch.new_path(spark, "chunks")
    some = {k: chunking.STRATEGIES[k] for k in ("CHARWIN500_OV50", "CHARBLOCK1000_NOV0", "SENT")}
    sinks.chunk_manifests(chunking.chunk_all(docs, some), path, "gzip")
    back = readers.json_lines(spark, path, schemas.CHUNK + ", strategy string")
    return back.select("strategy", F.col("original_doc_id").alias("docid"), "chunk_id", "start", "end", "text", F.col("_corrupt_record").isNotNull().alias("corrupt"))


def _qrels_back(spark: SparkSession, judged: DataFrame) -> DataFrame:
    """Judgments as a text file a strategy, read by their names."""
    path = scratch.new_path(spark, "qrels")
    line = F.concat_ws("\t", "qid", F.lit("0"), "chunk_id", F.col("rel").cast("string"))
    sinks.export_strategy_files(judged.withColumn("value", line), path, "qrels", ["qid", "chunk_id"])
    return readers.qrels(spark, path).select("strategy", "qid", "chunk_id", "rel")


def _runs_back(spark: SparkSession, run: DataFrame) -> DataFrame:
    """A run in two files of one strategy, the second with other scores: the first by name counts."""
    path = scratch.new_path(spark, "runs")
    for name, scale in (("a", 1.0), ("b", 2.0)):
        rows = retrieval.as_run(run.withColumn("score", F.col("score") * scale), name)
        line = F.concat_ws("\t", "qid", "q0", "chunk_id", F.col("rank").cast("string"), F.format_string("%.8f", "score"), "run_name")
        sinks.export_strategy_files(rows.withColumn("strategy", F.lit("dense")).withColumn("value", line), path, f"run_{name}", ["qid", "rank"])
    left_out = ",".join(sorted(r["file"] for r in readers.ambiguous_runs(spark, path).collect()))  # a row a file
    return readers.runs(spark, path).select("strategy", "qid", "chunk_id", F.round("score", 6).alias("score"), F.lit(left_out).alias("left_out"))


def _documents_back(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A JSON file a document, with a colon in its name, read as documents."""
    path = scratch.new_path(spark, "documents")
    sinks.export_documents(docs.select(F.concat(F.lit("doc:"), "docid").alias("docid"), F.lit(None).cast("string").alias("title"), "text"), path)
    return readers.json_documents(spark, path)


#: Rows of a JSON array, about.
_ROWS = 100_000


def _annotations_back(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Annotations as JSON arrays by annotator, read as JSON. As an array is one task's work on both ways, an annotator's rows are dealt by
    question to as many numbered files as keep each at about _ROWS rows."""
    path = scratch.new_path(spark, "annotations")
    found = scratch.written(found, "annotated")
    most = found.groupBy("sme_id").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // _ROWS))
    part = F.pmod(F.xxhash64("qid"), F.lit(parts))
    value = F.to_json(F.struct("qid", "docid", "start", "end", "text", "logic"))
    exact.write(found, path, F.concat("sme_id", F.lit("."), part.cast("string"), F.lit(".json")), value, "array", F.struct("qid", "src_ord"))
    rows = readers.json_array(spark, path, "qid string, docid string, start long, `end` long, text string, logic string")
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.\d+\.json$", 1).alias("sme_id"), "qid", "docid", "start", "end", "text", "logic")


def _errors_by_line(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents as JSON Lines, a file a source, some lines cut off and some left empty; what is no JSON, by its line."""
    path = scratch.new_path(spark, "lines")
    whole = F.to_json(F.struct(F.col("docid").alias("chunk_id"), "text"))
    value = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"chunk_id": "'), "docid")).when(F.col("doc_id") % 11 == 0, "").otherwise(whole)
    exact.write(docs, path, F.concat(F.coalesce("source", F.lit("none")), F.lit(".jsonl")), value, "lines", F.col("doc_id"))
    rows = readers.json_lines_checked(spark, path, "chunk_id string, text string")
    return rows.select("file", "line_no", "chunk_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"), F.col("_corrupt_record").alias("broken"))


def _written_lines_back(spark: SparkSession, run: DataFrame) -> DataFrame:
    """The run as Spark writes it, in sorted lines by strategy, parsed again."""
    path = scratch.new_path(spark, "lines")
    sinks.runs(retrieval.as_run(run, "dense").withColumn("strategy", F.lit("dense")), path)
    lines = spark.read.schema("value string, strategy string").text(path).withColumn("line_no", F.monotonically_increasing_id())
    return metrics.parse_run(lines).select("strategy", "qid", "chunk_id", F.round("score", 6).alias("score"))


def _csv_back(spark: SparkSession, table: DataFrame) -> DataFrame:
    path = scratch.new_path(spark, "csv")
    table.write.option("header", True).csv(path)
    return readers.csv_table(spark, path)


def _json_sheet(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Metadata of tables written as JSON and read as any JSON is."""
    rows = []
    for name, df in tables.items():
        path = scratch.new_path(spark, "json")
        sinks.json_rows(df, path)
        sheet = metadata.json_metadata(spark.read.json(path), name)
        rows += [(name, sheet["number_of_records"], c["name"], c["type"], c["description"]) for c in sheet["columns"]]
    return spark.createDataFrame(rows, "table string, number_of_records long, name string, type string, description string")


def _streamed_chunks(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents that arrive in a folder, chunked as a stream."""
    source, out = scratch.new_path(spark, "arriving"), scratch.new_path(spark, "streamed")
    docs.select("docid", "text").repartition(6).write.parquet(source)
    stream = pipelines.document_stream(spark, source, "docid string, text string", files_per_trigger=2)
    pipelines.run_once(chunking.char_windows(stream), None, scratch.new_path(spark, "progress"), out)
    return spark.read.parquet(out)


def _streamed_alignment(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """Documents that arrive, aligned with spans that are there."""
    source, out = scratch.new_path(spark, "arriving"), scratch.new_path(spark, "streamed")
    docs.select("docid", "text").repartition(4).write.parquet(source)
    stream = pipelines.document_stream(spark, source, "docid string, text string", files_per_trigger=2)
    pairs = pipelines.aligned_stream(stream, scratch.written(found, "spans"), t_span=0.85, t_chunk=0.05)
    pipelines.run_once(pairs.select("qid", "chunk_id"), None, scratch.new_path(spark, "progress"), out)
    return spark.read.schema("qid string, chunk_id string").parquet(out).distinct()


def _streamed_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Events that arrive in a folder hour by hour, counted by window; windows close two hours behind the newest event."""
    source, out = scratch.new_path(spark, "arriving"), scratch.new_path(spark, "counts")
    ordered = scratch.written(events.repartitionByRange(4, "ts").withColumn("part", F.spark_partition_id()), "events")
    for i in range(4):
        ordered.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = pipelines.event_counts(stream, late="2 hours").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "value")
    pipelines.run_updates(counts, scratch.new_path(spark, "progress"), out)
    return pipelines.latest(spark, out, "start string, event_type string, n long, value double", ["start", "event_type"])


#: Seconds that questions stay open, that rows may come late (ten years, as files come in no order), and within which
#: later ones are told.
_HOLD, _LATE, _GRACE = 600, 10 * 365 * 86400, 5 * 365 * 86400


def _streamed_merge(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Annotators' spans that arrive in files; a mark of time that closes all questions; some spans once more, too late.
    The stream is stopped and started again in between."""
    source, progress, out = (scratch.new_path(spark, n) for n in ("arriving", "progress", "merged"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("docid").cast("long") * 60 + F.col("src_ord"))
    spans_ = scratch.written(found.select("qid", "docid", "start", "end", "logic", "group", "sme_id", "src_ord", at.alias("at")), "spans")
    mark = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spans_.schema.fields if f.name != "at"], F.lit("2036-01-01").cast("timestamp").alias("at"))
    late = spans_.where("CAST(docid AS LONG) % 13 = 0 AND src_ord = 7")
    for rows in (spans_.repartition(4), mark.coalesce(1), late.coalesce(1)):
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(spans_.schema).option("maxFilesPerTrigger", 2).parquet(source)
        merging.run(merging.merged(stream, _LATE, _HOLD, _GRACE), progress, out)
    return spark.read.schema(merging.OUTPUT).parquet(out)


def add(register: Callable) -> None:
    """Register the queries of this module."""
    from lodegauge.plans import contract as c

    plain = "CASE data_type WHEN 'BIGINT' THEN 'int' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' END"
    run_sql = f"WITH {c.TOP_SQL} SELECT 'dense' AS strategy, qid, chunk_id, round(score, 6) AS score"
    register("roundtrip_chunks", lambda s, d: _chunks_back(s, c.docs(s, d)), f"""WITH {c.NORMAL_SQL}, {c.CHUNKS_SQL}
SELECT strategy, docid, chunk_id, start, "end", text, false AS corrupt FROM chunks WHERE strategy <> 'TOKWIN512_S128'""")
    register("roundtrip_qrels", lambda s, d: _qrels_back(s, c._windows_judged(s, d).withColumn("strategy", F.lit("CHARWIN500_OV50"))),
             f"WITH {c.NORMAL_SQL}, {c.SPANS_SQL}, {c.CHUNKS_SQL}, {c.PAIRS_SQL} SELECT DISTINCT strategy, qid, chunk_id, 1 AS rel FROM pairs WHERE strategy = 'CHARWIN500_OV50' AND cov_span >= {c.T} AND cov_chunk >= {c.C}")
    register("roundtrip_runs", lambda s, d: _runs_back(s, c.topk(s, d)), f"{run_sql}, 'run_b_dense.txt' AS left_out FROM run")
    register("roundtrip_documents", lambda s, d: _documents_back(s, c.docs(s, d)), "SELECT 'doc:' || doc_id AS docid, NULL::VARCHAR AS title, text FROM documents")
    register("roundtrip_annotations", lambda s, d: _annotations_back(s, c.derived_spans(s, d)), f"""WITH {c.NORMAL_SQL}, {c.SPANS_SQL}
SELECT sme_id, qid, docid, start, "end", text, logic FROM spans""")
    register("jsonl_errors", lambda s, d: _errors_by_line(s, scratch.spread(c.table(s, d, "documents")).withColumn("docid", F.col("doc_id").cast("string"))), """
WITH l AS (SELECT *, coalesce(source, 'none') || '.jsonl' AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line_no FROM documents)
SELECT file, line_no, CASE WHEN doc_id % 7 <> 0 THEN doc_id::VARCHAR END AS chunk_id, CASE WHEN doc_id % 7 <> 0 THEN coalesce(length(text), 0) ELSE 0 END::BIGINT AS length, CASE WHEN doc_id % 7 = 0 THEN '{"chunk_id": "' || doc_id END AS broken
FROM l WHERE doc_id % 7 = 0 OR doc_id % 11 <> 0""")
    register("roundtrip_lines", lambda s, d: _written_lines_back(s, c.topk(s, d)), f"{run_sql} FROM run")
    register("roundtrip_csv", lambda s, d: _csv_back(s, c.table(s, d, "labels")).select(*[F.col(x).cast("long").alias(x) for x in ("doc_id", "quality", "toxic")]),
             "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
    register("json_metadata", lambda s, d: _json_sheet(s, {t: c.table(s, d, t) for t in ("labels", "customer")}),
             " UNION ALL ".join(f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {t}) AS number_of_records, column_name AS name, {plain} AS type, 'Description of ' || column_name AS description
FROM information_schema.columns WHERE table_name = '{t}'""" for t in ("labels", "customer")))
    register("stream_chunks", lambda s, d: _streamed_chunks(s, c.docs(s, d)), f"WITH {c.NORMAL_SQL} {c.windows_sql(500, 50)}")
    register("stream_alignment", lambda s, d: _streamed_alignment(s, c.docs(s, d), c.derived_spans(s, d)),
             f"WITH {c.NORMAL_SQL}, {c.SPANS_SQL}, {c.CHUNKS_SQL}, {c.PAIRS_SQL} SELECT DISTINCT qid, chunk_id FROM pairs WHERE strategy = 'CHARWIN500_OV50' AND cov_span >= {c.T} AND cov_chunk >= {c.C}")
    register("stream_events", lambda s, d: _streamed_events(s, c.table(s, d, "events")),
             "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
    register("stream_merge", lambda s, d: _streamed_merge(s, c.derived_spans(s, d)), c.MERGE_SQL + """ SELECT f.qid, f.docid, arg_max(f.start, f.i) AS start, arg_max(f."end", f.i) AS "end", any_value(f.logic) AS logic, 'g1' AS "group", string_agg(o.sme_id, '+' ORDER BY f.i) AS contributors, false AS late
FROM fold f JOIN o ON o.qid = f.qid AND o.docid = f.docid AND o.i = f.i GROUP BY f.qid, f.docid, f.gid
UNION ALL SELECT qid, docid, start, "end", logic, 'g1', sme_id, true FROM spans WHERE start < "end" AND docid::BIGINT % 13 = 0 AND src_ord = 7""")
    register("union_annotators", lambda s, d: _united(c.derived_spans(s, d)), f"""WITH {c.NORMAL_SQL}, {c.SPANS_SQL}
SELECT qid, src_ord AS k, CASE WHEN sme_id = 'sme1' THEN 0 ELSE 1 END AS file, CASE WHEN sme_id = 'sme1' THEN 'first' ELSE 'sme2' END AS sme_id FROM spans""")
    register("topk_docid", lambda s, d: _with_docid(c._vectors(s, d)), """WITH unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT 'q' || q.vec_id AS qid, 'd' || c.label AS docid, c.vec_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, c.e), 8) DESC, c.vec_id::VARCHAR DESC)::INT AS rank
FROM unit q, unit c WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""")


def _united(found: DataFrame) -> DataFrame:
    """Two annotators' rows in one frame; the first has no id of its own."""
    first = found.where("sme_id = 'sme1'").withColumn("sme_id", F.lit(None).cast("string")).withColumnRenamed("src_ord", "k")
    second = found.where("sme_id = 'sme2'").withColumnRenamed("src_ord", "k")
    return spans.with_order([first, second], ["first", "second"]).select("qid", "k", F.col("src_ord.k").alias("file"), "sme_id")


def _with_docid(vectors: DataFrame) -> DataFrame:
    queries = vectors.where("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("qid"), "embedding")
    chunks = vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), "label").alias("docid"), "embedding")
    return retrieval.retrieve(queries, chunks, 5, docid="docid").select("qid", "docid", "chunk_id", "rank")
