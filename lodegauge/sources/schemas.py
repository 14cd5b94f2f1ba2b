"""Explicit schemas of every dataset; nothing is inferred."""

from __future__ import annotations

DOCUMENT = "docid string, title string, text string"
QUESTION = "qid string, question string, docid string, `group` string"
ANNOTATION = "qid string, docid string, start int, `end` int, text string, logic string, `group` string, sme_id string"
CHUNK = "original_doc_id string, chunk_id string, start int, `end` int, text string"
QREL = "qid string, iter string, chunk_id string, rel int"
RUN = "qid string, q0 string, chunk_id string, rank int, score double, run_name string"
RETRIEVAL = "qid string, docid string, chunk_id string, rank int, score double"
EMBEDDING = "chunk_id string, docid string, embedding array<float>"
QUESTIONS_REPLY = "questions array<string>"
ANSWERS_REPLY = "answers array<string>, logic string"
VIOLATION = "qid string, docid string, code string"

#: Allowed logic values (fixed values).
LOGIC = ("COMPLETE_SPAN", "AND", "OR")
