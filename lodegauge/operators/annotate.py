"""Question and answer generation around an injected generator, and the validation of its replies.

A generator is made once a worker and maps prompts to reply texts. Replies are a non-deterministic source, so callers
write them down (lodegauge.sources.scratch) before using them twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegauge.functions.text import let, normalized, small, strip
from lodegauge.operators import replies
from lodegauge.operators.spans import located
from lodegauge.sources.schemas import ANSWERS_REPLY, LOGIC, QUESTIONS_REPLY

Generator = Callable[[list[str]], list[str]]


def offline_generator() -> Generator:
    """A deterministic stand-in: asks about, and answers with, sentences of the document in the prompt. Those of the last document are
    held, as the prompts of a document come one after the other."""
    last, found = None, []

    def told(text: str) -> list[tuple[str, str]]:
        nonlocal last, found
        if text != last:
            # what follows the last mark is no sentence, and would be tried from each of its characters
            whole = text[: max(map(text.rfind, ".!?")) + 1]
            last, found = text, [(s[:20], s) for s in map(str.strip, re.findall(r"[^.!?]+[.!?]", whole)) if s]
        return found

    def reply(prompt: str) -> str:
        sentences = told(prompt.partition("\nDocument:\n")[2])
        if "\nQuestion: " in prompt:
            wanted = prompt.partition("\nQuestion: ")[2].partition("\n")[0]
            hits = [s for first, s in sentences if first in wanted] or [s for _, s in sentences[:1]]
            return json.dumps({"answers": hits[:2], "logic": "COMPLETE_SPAN" if len(hits) == 1 else "OR"})
        return json.dumps({"questions": [f"What is said by: {s[:60]}?" for _, s in sentences[:6]]})

    return lambda prompts: [reply(p) for p in prompts]


def question_prompt(title: Column, docid: Column, text: Column, low: int = 6, high: int = 10) -> Column:
    ask = f'Write {low} to {high} questions that the document answers. Reply with one JSON object: {{"questions": ["..."]}}.'
    return F.concat(F.lit(ask + "\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nId: "), docid, F.lit("\nDocument:\n"), F.coalesce(text, F.lit("")))


def answer_prompt(question: Column, docid: Column, text: Column) -> Column:
    ask = (
        "Copy from the document the exact passages that answer the question. Say whether one passage answers it (COMPLETE_SPAN), any of "
        'several (OR), or only all of them (AND). Reply with one JSON object: {"answers": ["..."], "logic": "..."}.'
    )
    return F.concat(F.lit(ask + "\nId: "), docid, F.lit("\nQuestion: "), question, F.lit("\nDocument:\n"), F.coalesce(text, F.lit("")))


def ask(rows: DataFrame, make_generator: Callable[[], Generator], prompt: str = "prompt") -> DataFrame:
    """rows with reply and error in place of the prompt; a failing batch gives null replies, and the reason as error.
    failures() counts these."""
    kept = [c for c in rows.columns if c != prompt]
    schema = rows.drop(prompt).schema.add("reply", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        generate = make_generator()
        for b in small(batches):
            error = None
            try:
                told = pa.array(generate(b.column(len(kept)).to_pylist()), pa.string())
                if len(told) != b.num_rows:
                    raise ValueError(f"{len(told)} replies to {b.num_rows} prompts")
            except Exception as e:  # noqa: BLE001  a generator's failure is its rows' null reply and error
                told, error = pa.nulls(b.num_rows, pa.string()), f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], told, pa.array([error] * b.num_rows, pa.string())], names=[*kept, "reply", "error"])

    return rows.select(*kept, prompt).mapInArrow(run, schema)


def failures(told: DataFrame) -> DataFrame:
    """error and n, of what ask() could not get replies for."""
    return told.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


def unfenced(reply: Column) -> Column:
    """A reply without code fences around it; one that begins and ends as an object is left as it is."""
    bare = F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.when(reply.startswith("{") & reply.endswith("}"), reply).otherwise(bare)


def parse_questions(told: DataFrame) -> DataFrame:
    """docid, reply to qid, question, docid, group: non-blank strings of a JSON object's list ``questions``. qid is a
    hash of document and question, so runs agree."""
    q = F.from_json("reply", QUESTIONS_REPLY)["questions"]
    rows = told.select("docid", F.explode(q).alias("question")).where(F.col("question").isNotNull() & (strip(F.col("question")) != ""))
    qid = F.concat(F.lit("q_"), F.substring(F.sha2(F.concat_ws("\u0001", "docid", "question"), 256), 1, 8))
    return rows.select(qid.alias("qid"), "question", "docid", F.lit("g1").alias("group"))


def parse_answers(told: DataFrame, fences: bool = True) -> DataFrame:
    """reply to answers and logic: blank answers go, an unknown logic becomes COMPLETE_SPAN for one answer and OR for
    others; rows without answers go."""
    text = unfenced(F.col("reply")) if fences else F.col("reply")
    answers = lambda r: F.filter(F.transform(r["answers"], strip), lambda a: a.isNotNull() & (a != ""))
    # exploded, as the planner would parse a column expression again for each filter and projection that it moves beneath it
    parsed = let(F.from_json(text, ANSWERS_REPLY), lambda r: F.struct(answers(r).alias("answers"), r["logic"].alias("logic")))
    r = told.select("*", F.explode(F.array(parsed)).alias("__r")).withColumn("answers", F.col("__r.answers"))
    logic = F.when(F.col("__r.logic").isin(*LOGIC), F.col("__r.logic")).when(F.size("answers") == 1, "COMPLETE_SPAN").otherwise("OR")
    return r.withColumn("logic", logic).where(F.coalesce(F.size("answers"), F.lit(0)) > 0).drop("__r", "reply", "error")


def generate_questions(docs: DataFrame, make_generator: Callable[[], Generator] = offline_generator, store: str | None = None) -> DataFrame:
    """With a store (a folder), prompts that it holds replies to are not asked again."""
    prompts = docs.select("docid", question_prompt(F.col("title") if "title" in docs.columns else F.lit(""), F.col("docid"), F.col("text")).alias("prompt"))
    return parse_questions(ask(prompts, make_generator) if store is None else replies.ask(prompts, make_generator, store))


def _kept_answers(asked: DataFrame, docs: DataFrame, make_generator: Callable[[], Generator], store: str) -> DataFrame:
    """What the store has on the questions asked. A document's text is in the prompts of all its questions: it is read for its digest, and
    sent once, to those that are to be asked."""
    texts = docs.withColumn("__text", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    head = answer_prompt(F.col("question"), F.col("docid"), F.lit(""))
    rows = asked.join(texts.select("docid", "__text"), "docid").withColumn("parts", F.concat(head, F.col("__text")))

    def prompts(rows: DataFrame, shares: int) -> DataFrame:
        by = ["docid", "__text"]
        both = rows.repartition(shares, *by).join(texts.repartition(shares, *by), by)
        return both.withColumn("prompt", answer_prompt(F.col("question"), F.col("docid"), F.col("text")))

    return replies.ask_parts(rows, make_generator, store, prompts)


def annotate(questions: DataFrame, docs: DataFrame, sme_id: str, make_generator: Callable[[], Generator] = offline_generator, fences: bool = True, store: str | None = None) -> DataFrame:
    """One annotator's spans: qid, docid, start, end, text, logic, group, sme_id. Questions whose document is missing
    and answers that can't be located go. With a store (a folder), prompts that it holds replies to are not asked again."""
    asked = questions.select("qid", "docid", F.coalesce("group", F.lit("g1")).alias("group"), "question")
    if store is None:
        prompt = answer_prompt(F.col("question"), F.col("docid"), F.col("text"))
        told = ask(asked.join(docs.select("docid", "text"), "docid").select("qid", "docid", "group", prompt.alias("prompt")), make_generator)
    else:
        told = _kept_answers(asked, docs.select("docid", "text"), make_generator, store)
    answers = parse_answers(told, fences).select("qid", "docid", "group", "logic", F.explode("answers").alias("snippet"))
    texts = normalized(docs.select("docid", F.col("text").cast("string").alias("doc_text")), "doc_text")
    hits = located(answers, texts).where("span_text is not null")
    return hits.select("qid", "docid", "start", "end", F.col("span_text").alias("text"), "logic", "group", F.lit(sme_id).alias("sme_id"))
