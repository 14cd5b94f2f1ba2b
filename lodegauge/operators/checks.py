"""Checks of annotations and chunks, coverage and distribution reports. Each returns rows; nothing is printed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.functions.text import normalize_offsets, text_slice
from lodegauge.sources.schemas import LOGIC

#: Fields of a chunk; the codes below and the lines of the report are those of the formats (fixed values).
CHUNK_FIELDS = ("original_doc_id", "chunk_id", "start", "end", "text")


def _texts(docs: DataFrame) -> DataFrame:
    """docs: with load_error where the reader kept what could not be read."""
    error = F.col("load_error") if "load_error" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("docid").cast("string").alias("docid"), error.alias("error"), (text != "").alias("has_text"), normalize_offsets(text).alias("norm"), F.lit(True).alias("there"))


def check_annotations(questions: DataFrame, annotations: DataFrame, docs: DataFrame, annotator: str) -> DataFrame:
    """Violations (qid, docid, code) of one annotator. A question's own docid counts, not the annotation's; codes about
    the document come once a question, codes about spans once a span."""
    q = questions.where("docid is not null").select("qid", "docid").distinct()
    spanless = q.join(annotations.select("qid"), "qid", "left_anti").select("qid", "docid", F.lit(f"{annotator}:NO_SPAN_FOR_QUESTION").alias("code"))
    covered = q.join(annotations.select("qid").distinct(), "qid", "left_semi").join(_texts(docs), "docid", "left")
    by_doc = covered.select("qid", "docid", F.when(F.col("there").isNull(), "DOC_NOT_FOUND").when(F.col("error").isNotNull(), F.concat(F.lit("DOC_LOAD_OR_NORMALIZE_ERROR: "), "error")).when(~F.col("has_text"), "DOC_EMPTY_OR_NO_TEXT_FIELD").alias("code")).where("code is not null")
    sound = covered.where("there and has_text")
    a = annotations.select("qid", "start", "end", F.col("text").alias("told"))
    inside = F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.length("norm")), F.lit(False))
    cut = F.trim(text_slice(F.col("norm"), F.col("start"), F.col("end")))
    code = F.when(~inside, f"{annotator}:INVALID_OFFSETS").when(~cut.eqNullSafe(F.col("told")), f"{annotator}:TEXT_MISMATCH")
    by_span = sound.join(a, "qid").select("qid", "docid", code.alias("code")).where("code is not null")
    return spanless.unionByName(by_doc).unionByName(by_span)


def file_violation(path: str, error: str | None = None) -> tuple[str, str, str]:
    """The row for a file that is missing or can't be read."""
    return ("GLOBAL", path, "ANNOTATION_FILE_NOT_FOUND" if error is None else f"ANNOTATION_FILE_LOAD_ERROR: {error}")


def coverage_summary(questions: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Questions covered by both annotators, one of them, or neither."""
    mark = lambda d, c: d.select("qid").distinct().withColumn(c, F.lit(True))
    q = questions.select("qid").distinct().join(mark(first, "a"), "qid", "left").join(mark(second, "b"), "qid", "left")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return q.agg(
        F.count("*").alias("questions"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_1"), F.count_if(~a & b).alias("only_2"), F.count_if(~a & ~b).alias("neither")
    )


def check_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Violations (chunk_id, docid, code) of a manifest, over all of its rows: MISSING_FIELDS, DOC_NOT_FOUND,
    INVALID_OFFSETS, TEXT_MISMATCH (exact, nothing stripped); INVALID_JSON where a _corrupt_record column says so. Chunks
    go to their documents by offsets and the digest of their text, which stays where it is."""
    missing = F.concat_ws(",", *[F.when(F.col(f"`{f}`").isNull(), f) for f in CHUNK_FIELDS])
    bad = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in chunks.columns else F.lit(False)
    rows = chunks.select("chunk_id", "original_doc_id", "start", "end", F.sha2("text", 256).alias("told"), missing.alias("missing"), bad.alias("bad"))
    joined = rows.join(_texts(docs), F.col("original_doc_id") == F.col("docid"), "left")
    inside = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.length("norm"))
    code = (
        F.when(F.col("bad"), "INVALID_JSON").when(F.col("missing") != "", F.concat(F.lit("MISSING_FIELDS:"), "missing")).when(F.col("there").isNull(), "DOC_NOT_FOUND")
        .when(~inside, "INVALID_OFFSETS").when(F.sha2(text_slice(F.col("norm"), F.col("start"), F.col("end")), 256) != F.col("told"), "TEXT_MISMATCH")
    )
    return joined.select("chunk_id", F.col("original_doc_id").alias("docid"), code.alias("code")).where("code is not null")


def sample_rows(rows: DataFrame, by: str, order: str, first: int = 2, last: int = 2, random: int = 5, seed: int = 0) -> DataFrame:
    """The first and last rows of each group in order, and a seeded sample of the others."""
    up, down = Window.partitionBy(by).orderBy(order), Window.partitionBy(by).orderBy(F.desc(order))
    out = rows.withColumn("__u", F.row_number().over(up)).withColumn("__d", F.row_number().over(down))
    ends = (F.col("__u") <= first) | (F.col("__d") <= last)
    dice = Window.partitionBy(by, "__end").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string"))), order)
    out = out.withColumn("__end", ends).withColumn("__r", F.row_number().over(dice))
    return out.where(F.col("__end") | (F.col("__r") <= random)).drop("__u", "__d", "__end", "__r")


def distribution(questions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per question: docid, qid, question (100 characters and ... beyond), spans, logic of its first span or N/A.
    annotations: with src_ord, the place in the file."""
    a = annotations.groupBy("qid").agg(F.count("*").alias("spans"), F.min_by("logic", "src_ord").alias("logic"))
    short = F.when(F.length("question") <= 100, F.col("question")).otherwise(F.concat(F.substring("question", 1, 100), F.lit("...")))
    return questions.join(a, "qid", "left").select("docid", "qid", short.alias("question"), F.coalesce("spans", F.lit(0)).cast("long").alias("spans"), F.coalesce("logic", F.lit("N/A")).alias("logic"))


def distribution_totals(rows: DataFrame) -> DataFrame:
    """Questions, spans and spanless questions by document and in all (docid null)."""
    return rows.rollup("docid").agg(F.count("*").alias("questions"), F.sum("spans").cast("long").alias("spans"), F.count_if(F.col("spans") == 0).alias("without"))


def logic_counts(annotations: DataFrame) -> DataFrame:
    """Spans by logic type; the three types always appear."""
    domain = annotations.sparkSession.createDataFrame([(x,) for x in LOGIC], "logic string")
    return F.broadcast(domain).join(annotations.groupBy("logic").agg(F.count("*").alias("n")), "logic", "left").select("logic", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution_report(questions: DataFrame, annotations: DataFrame, title: str = "Output Distribution Analysis") -> str:
    """The Markdown report. questions: with a place column src_ord. For corpora of a size to be read by people."""
    rows = distribution(questions, annotations).join(questions.select("qid", F.col("src_ord").alias("place")), "qid").orderBy("docid", "place").collect()
    totals = {r["docid"]: r for r in distribution_totals(distribution(questions, annotations)).collect()}
    counts = {r["logic"]: r["n"] for r in logic_counts(annotations).collect()}
    out, doc = [f"# {title}\n"], object()
    for i, r in enumerate(rows):
        if r["docid"] != doc:
            doc = r["docid"]
            out += [f"## Chapter `{doc}`", f"- **Total questions:** {totals[doc]['questions']}\n"]
        out += [f"### QID: `{r['qid']}`", f"- **Question:** {r['question']}", f"- **# spans:** {r['spans']}", f"- **Logic type:** {r['logic']}\n"]
        if i + 1 == len(rows) or rows[i + 1]["docid"] != doc:
            out.append(f"**Total spans in {doc}:** {totals[doc]['spans']}\n\n")
    whole = totals.get(None)
    n, spans, without = (whole["questions"], whole["spans"], whole["without"]) if whole else (0, 0, 0)
    out += ["---", "## Overall Summary", f"- **Total valid questions processed:** {n}", f"- **Total valid spans associated:** {spans}", f"- **Questions without spans:** {without}\n", "### Spans by logic type"]
    out += [f"- **{x}**: {counts[x]}" for x in LOGIC]
    out += ["", f"> **Assertion:** {'Every question here has at least one span.' if not without else f'{without} questions here have no span.'}\n"]
    return "\n".join(out)
