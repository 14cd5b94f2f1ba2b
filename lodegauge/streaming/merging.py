"""Annotators' spans merged as they arrive, question by question.

The spans of a (qid, docid) are kept until no more are due: until event time has gone ``hold`` beyond the last of them. Then they
are folded as merge_spans() folds them, given out, and forgotten; state holds open questions only. A stream that is started again goes
on from its checkpoint.

Each call of the state store and each answer takes a message between Python and the JVM, some milliseconds a question. So questions
are dealt to ``SLOTS`` slots by their hash, and a slot's questions share their messages: one list of spans and one timer, the earliest
time at which one of them may be due. When it comes, the slot's spans are read, questions that are due go, and the others stay.

Event time follows the newest row, ``late`` behind it. A row that is older than that comes too late: its question may be closed. It is
given out by itself, marked, and merged with nothing. The watermark that Spark is told lies ``grace`` further back, as Spark
drops what is older than that and only counts it (numRowsDroppedByWatermark).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodegauge.operators.spans import Fold

#: Groups of questions that share their state (part of a checkpoint: a stream goes on with the number it began with).
SLOTS = 4096
#: Spans in a message to the state store.
SENT = 4096
_SPAN = StructType([StructField(n, LongType() if n in ("start", "end", "src_ord", "at_ms") else StringType()) for n in ("qid", "docid", "start", "end", "src_ord", "logic", "grp", "who", "at_ms")])
_TIMES = StructType([StructField("timer", LongType())])
OUTPUT = "qid string, docid string, start long, `end` long, logic string, `group` string, contributors string, late boolean"


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, in two partitions a core at most: each starts a Python worker and a
    store for every batch. A stream that goes on keeps the number of its checkpoint."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class MergeSpans(StatefulProcessor):
    """Times are milliseconds."""

    def __init__(self, hold: int, grace: int):
        self.hold, self.grace = hold, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", _SPAN)
        self.times = handle.getValueState("times", _TIMES)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ARG002
        reached, fresh, newest = timerValues.getCurrentWatermarkInMs() + self.grace, [], {}
        for r in rows:
            if r["start"] is None:  # a mark of time
                continue
            question, at = (r["qid"], r["docid"]), r["at_ms"]
            if at < reached:
                yield Row(qid=question[0], docid=question[1], start=r["start"], end=r["end"], logic=r["logic"], group=r["grp"], contributors=r["who"], late=True)
                continue
            fresh.append(tuple(r[n] for n in _SPAN.names))
            newest[question] = max(newest.get(question, at), at)
            if len(fresh) == SENT:
                self.spans.appendList(fresh)
                fresh = []
        if fresh:
            self.spans.appendList(fresh)
        if newest:
            self._wake(min(newest.values()) + self.hold - self.grace)

    def _wake(self, timer: int) -> None:
        """Look at this slot at that time, or before."""
        set_ = self.times.get()[0] if self.times.exists() else None
        if set_ is None or timer < set_:
            if set_ is not None:
                self.handle.deleteTimer(set_)
            self.handle.registerTimer(timer)
            self.times.update((timer,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ARG002
        questions: dict[tuple, list[tuple]] = {}
        for s in self.spans.get():
            questions.setdefault(tuple(s[:2]), []).append(tuple(s))
        kept, due = [], timerValues.getCurrentWatermarkInMs() - self.hold + self.grace
        for (qid, docid), rows in questions.items():
            if max(s[8] for s in rows) > due:
                kept.append(rows)
                continue
            fold = Fold()
            rows.sort(key=lambda s: (s[2], s[3], s[4] is not None, s[4] or 0, s[5] or "", s[6], s[7]))
            for _, _, start, end, _, logic, grp, who, _ in [*rows, (None,) * 9]:
                for clash, span, _, by in fold.end() if start is None else fold.take(start, end, logic, grp, who):
                    if not clash:
                        yield Row(qid=qid, docid=docid, start=span[0], end=span[1], logic=span[2], group=span[3], contributors=by, late=False)
        self.times.clear()
        if len(kept) < len(questions):
            self.spans.clear()
            left = [s for rows in kept for s in rows]
            for at in range(0, len(left), SENT):
                self.spans.appendList(left[at : at + SENT])
        if kept:
            self._wake(min(max(s[8] for s in rows) for rows in kept) + self.hold - self.grace)

    def close(self) -> None:
        pass


def merged(spans: DataFrame, late: int, hold: int, grace: int = 365 * 86400) -> DataFrame:
    """OUTPUT rows of a stream of spans: qid, docid, start, end, logic, group, sme_id, src_ord (long), at (event time); times in
    seconds. Rows without a start are marks of time, which close questions that are due. Spans without a length go, as in
    merge_spans()."""
    rows = spans.where("start is null or start < `end`").withWatermark("at", f"{late + grace} seconds").select(
        F.col("qid").cast("string").alias("qid"), F.col("docid").cast("string").alias("docid"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        F.col("src_ord").cast("long").alias("src_ord"), F.col("logic").cast("string").alias("logic"), F.coalesce("group", F.lit("g1")).alias("grp"), F.coalesce("sme_id", F.lit("")).alias("who"),
        "at", F.unix_millis("at").alias("at_ms"),
    ).withColumn("slot", F.pmod(F.xxhash64("qid", "docid"), F.lit(SLOTS)))
    processor = MergeSpans(hold * 1000, grace * 1000)
    return rows.groupBy("slot").transformWithState(statefulProcessor=processor, outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")


def run(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Process what is there, add the rows to the table under ``path``, and stop."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
