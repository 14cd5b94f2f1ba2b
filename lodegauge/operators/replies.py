"""Replies that are kept: a generator is asked each prompt once, whatever fails or runs again.

The store is a folder of small Parquet files under the digest of (generator's name, prompt): digest, reply, error. Prompts that
it holds are left out by an anti-join, equal ones are asked once. A task writes what it was told every ``flush`` prompts, under names
of its share of the prompts, so a second attempt of a lost task reads what the first one wrote and goes on from there; at most the
prompts of one unwritten flush are asked again. A batch that fails is asked prompt by prompt, each up to ``attempts`` times; those
that still fail are kept with their error (quarantined), and asked again only on demand.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegauge.functions.text import small
from lodegauge.sources import exact, scratch

#: Prompts of a task's share, about.
SHARE = 4096
#: Bytes of a digest in a broadcast table, about.
_DIGEST_BYTES = 128
SCHEMA = "digest string, reply string, error string"
_ARROW = pa.schema([("digest", pa.string()), ("reply", pa.string()), ("error", pa.string())])


def stored(spark: SparkSession, store: str) -> DataFrame:
    """digest, reply, error: one row a prompt, with its reply if it ever had one."""
    files, root = exact.store(store)
    files.create_dir(root, recursive=True)
    rows = spark.read.schema(SCHEMA).parquet(store)
    return rows.groupBy("digest").agg(F.max("reply").alias("reply"), F.max("error").alias("error")).withColumn("error", F.when(F.col("reply").isNull(), F.col("error")))


def _told(generate: Callable[[list[str]], list[str]], prompts: list[str], attempts: int) -> list[tuple[str | None, str | None]]:
    """(reply, error) of each prompt."""
    try:
        got = generate(prompts)
        if len(got) == len(prompts):
            return [(r, None if r is not None else "no reply") for r in got]
        raise ValueError(f"{len(got)} replies to {len(prompts)} prompts")
    except Exception as e:  # noqa: BLE001  a generator's failure is its prompts' error
        if len(prompts) == 1 and attempts <= 1:
            return [(None, f"{type(e).__name__}: {e}")]
    if len(prompts) == 1:
        return _told(generate, prompts, attempts - 1)
    return [x for p in prompts for x in _told(generate, [p], attempts)]


def _by_digest(prompts: DataFrame, unseen: DataFrame, n: int, shares: int) -> DataFrame:
    """The prompts (digest, prompt) of the n digests that are unseen, dealt by digest. Prompts are exchanged once: after they are
    chosen if the digests are few, else together with them."""
    if n * _DIGEST_BYTES <= scratch.LOOKUP_BYTES:
        return prompts.join(F.broadcast(unseen), "digest", "left_semi").select("digest", "prompt").repartition(shares, "digest")
    # not a semi-join, which the planner would move beneath the exchange, and exchange its sides besides
    return prompts.repartition(shares, "digest").join(unseen.repartition(shares, "digest"), "digest").select("digest", "prompt")


def _fill(deal: Callable[[DataFrame, int, int], DataFrame], unseen: DataFrame, make_generator: Callable, store: str, batch: int, flush: int, attempts: int) -> int:
    """Ask and write the prompts whose digests are unseen; the number of prompts asked. deal gives them (digest, prompt) for their
    digests, their number and that of shares; a task takes a share, which is the same whenever it runs, and a share's files become one when
    it is done."""
    told = unseen.agg(F.hex(F.bit_xor(F.xxhash64("digest"))).alias("x"), F.count("*").alias("n")).first()
    run_name = told["x"]
    if run_name is None:
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = exact.store(store)
        mine = f"part-{run_name}-{TaskContext.get().partitionId()}-"
        there = [name for name in exact.names(store) if name.startswith(mine)]
        known = {d for name in there for d in pq.read_table(f"{root}/{name}", columns=["digest"], filesystem=files).column(0).to_pylist()}
        generate, held, asked = make_generator(), [], 0

        def put(rows: pa.Table) -> None:
            name = f"{mine}{uuid.uuid4().hex}.parquet"
            pq.write_table(rows, f"{root}/_{name}", filesystem=files)
            files.move(f"{root}/_{name}", f"{root}/{name}")
            there.append(name)

        def write() -> None:
            put(pa.table([pa.array(c, pa.string()) for c in zip(*held)], schema=_ARROW))
            held.clear()

        for b in small(batches):
            todo = []
            for d, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if d not in known:
                    known.add(d)
                    todo.append((d, p))
            for at in range(0, len(todo), batch):
                some = todo[at : at + batch]
                held += [(d, *x) for (d, _), x in zip(some, _told(generate, [p for _, p in some], attempts))]
                asked += len(some)
                if len(held) >= flush:
                    write()
        if held:
            write()
        if len(there) > 1:  # a crash in between leaves rows twice, which stored() takes for one
            parts = list(there)
            put(pa.concat_tables([pq.read_table(f"{root}/{name}", filesystem=files, schema=_ARROW) for name in parts]))
            for name in parts:
                files.delete_file(f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], names=["n"])

    shares = max(1, unseen.sparkSession.sparkContext.defaultParallelism, -(-told["n"] // SHARE))
    return deal(unseen, told["n"], shares).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _answered(keyed: DataFrame, deal: Callable[[DataFrame, int, int], DataFrame], make_generator: Callable, store: str, batch: int, flush: int, attempts: int, again: bool) -> DataFrame:
    """keyed with reply and error in place of __digest, from the store, after what it does not hold is asked."""
    spark = keyed.sparkSession
    known = stored(spark, store).where("reply is not null" if again else "true").select("digest")
    unseen = keyed.where("__digest is not null").select(F.col("__digest").alias("digest")).distinct()
    unseen = scratch.written(unseen.join(known, "digest", "left_anti"), "unseen")
    _fill(deal, unseen, make_generator, store, batch, flush, attempts)
    told = stored(spark, store).withColumnRenamed("digest", "__digest")
    return keyed.join(told, "__digest", "left").drop("__digest")


def ask(rows: DataFrame, make_generator: Callable, store: str, name: str = "", prompt: str = "prompt", batch: int = 16, flush: int = 256, attempts: int = 3, again: bool = False) -> DataFrame:
    """rows with reply and error in place of the prompt, as annotate.ask() gives them, from the store; what it does not hold
    is asked first. again: ask quarantined prompts once more. A null prompt has neither reply nor error. Prompts, which may hold whole
    documents, are made again from rows when they are asked, and never written; what is written and compared are their digests."""
    digest = F.sha2(F.concat(F.lit(name + "\u0001"), F.col(prompt)), 256)
    with scratch.released(rows.sparkSession):
        keyed = scratch.written(rows.withColumn("__digest", digest).drop(prompt), "prompts")
        made = rows.select(digest.alias("digest"), F.col(prompt).alias("prompt"))
        return _answered(keyed, lambda unseen, n, shares: _by_digest(made, unseen, n, shares), make_generator, store, batch, flush, attempts, again)


def ask_parts(rows: DataFrame, make_generator: Callable, store: str, prompts: Callable[[DataFrame, int], DataFrame], name: str = "", parts: str = "parts", batch: int = 16, flush: int = 256, attempts: int = 3, again: bool = False) -> DataFrame:
    """ask() where many prompts hold one long text, so that prompts are neither exchanged nor made for rows that have a reply. The column
    ``parts`` stands for the prompt, with long texts by their digests: rows have equal prompts if it is equal. prompts gives the rows that are
    to be asked (without parts) a column ``prompt``, by a join with the texts that deals them to a number of shares, equal prompts to one."""
    digest = F.sha2(F.concat(F.lit(name + "\u0002"), F.col(parts)), 256)

    def deal(unseen: DataFrame, n: int, shares: int) -> DataFrame:  # noqa: ARG001
        asked = keyed.join(unseen.withColumnRenamed("digest", "__digest"), "__digest", "left_semi")
        return prompts(asked, shares).select(F.col("__digest").alias("digest"), "prompt")

    with scratch.released(rows.sparkSession):
        keyed = scratch.written(rows.withColumn("__digest", digest).drop(parts), "prompts")
        return _answered(keyed, deal, make_generator, store, batch, flush, attempts, again)
