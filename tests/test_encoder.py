"""Fitted vectors against NumPy's decomposition of the whole matrix, and what they retrieve."""

import random

import numpy as np
import pytest

from lodegauge.operators import encoder, retrieval

TOPICS = ["river water boat fish bridge shore", "bread oven flour baker yeast salt", "star moon orbit planet comet sky", "court judge law trial jury appeal"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(str(i), " ".join(rng.choices(TOPICS[i % 4].split(), k=rng.randrange(5, 30)) + rng.choices("the of and to".split(), k=6)), i % 4) for i in range(200)]
    rows += [("null", None, -1), ("empty", "", -1), ("blank", " \n\t", -1), rows[0], ("long", "River " * 5000, 0)]
    return rows, spark.createDataFrame(rows, "docid string, text string, topic int").repartition(3).cache()


def dense(texts, buckets):
    m = np.zeros((len(texts), buckets))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            m[i, encoder.bucket(w, buckets)] += 1
    m = m[m.sum(axis=1) > 0]
    idf = np.log((1 + len(m)) / (1 + (m > 0).sum(axis=0))) + 1
    w = np.where(m > 0, 1 + np.log(np.maximum(m, 1)), 0) * idf
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def test_vectors_are_those_of_a_whole_decomposition(docs):
    rows, df = docs
    w = dense([r[1] for r in rows], 512)
    u, s, vt = np.linalg.svd(w, full_matrices=False)
    sign = np.where(vt[np.arange(4), np.abs(vt[:4]).argmax(axis=1)] < 0, -1, 1)
    want = (u[:, :4] * s[:4] * sign) / np.linalg.norm(u[:, :4] * s[:4], axis=1, keepdims=True)
    fitted = encoder.fit(df, dim=4, buckets=512, more=8, passes=6)
    assert fitted.values == pytest.approx(s[:4], rel=1e-6)
    got = fitted()([r[1] for r in rows if r[1] and r[1].strip()])
    assert np.abs(got - want).max() < 1e-4
    assert not fitted()(["", " "]).any()


def test_vectors_retrieve_their_topic(docs):
    rows, df = docs
    vectors = retrieval.embed(df.where("topic >= 0").dropDuplicates(["docid"]), encoder.fit(df, dim=8, buckets=1024))
    asked = vectors.where(vectors.docid.isin([str(i) for i in range(20)])).withColumnRenamed("docid", "qid")
    topic = {r[0]: r[2] for r in rows}
    found = retrieval.retrieve(asked.select("qid", "embedding"), vectors.selectExpr("docid as chunk_id", "embedding"), 10).collect()
    recall = sum(topic[r["qid"]] == topic[r["chunk_id"]] for r in found) / len(found)
    assert len(found) == 200 and recall > 0.95


def test_empty_corpus(docs):
    fitted = encoder.fit(docs[1].where("false"), dim=4, buckets=64)
    assert fitted.directions.shape == (64, 4) and not fitted()(["river"]).any()


def test_rows_counted_once_give_the_texts_vectors(spark, docs):
    rows, df = docs
    counted = encoder.counted(df, buckets=512)
    assert counted.columns == ["docid", "topic", encoder.BUCKET, encoder.N]
    fitted = encoder.fit_counted(counted, dim=4, buckets=512)
    got = sorted((r["docid"], r["topic"], list(r["embedding"])) for r in encoder.vectors(counted, fitted).collect())
    want = sorted((d, k, v.tolist()) for (d, _, k), v in zip(rows, fitted()([t or "" for _, t, _ in rows])))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.abs(np.array([g[2] for g in got]) - np.array([w[2] for w in want])).max() < 1e-6


def test_what_is_exchanged_does_not_grow_with_splits(spark):
    """As many partial sums as cores, however many splits the rows have."""
    df = spark.createDataFrame([(f"w{i} v{i % 7} v{i % 5}",) for i in range(400)], "text string").repartition(40)
    tasks = spark.sparkContext.accumulator(0)

    def partial(batches):
        tasks.add(1)
        return np.full((8, 1), float(sum(b.num_rows for b in batches)))

    counted = encoder.counted(df, buckets=64)
    assert encoder._summed(counted, partial, (8, 1)).ravel().tolist() == [400.0] * 8
    assert tasks.value <= spark.sparkContext.defaultParallelism
