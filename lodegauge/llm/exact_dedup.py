"""Exact deduplication as a stateful stream, in built-in functions only.

``ingest`` follows a folder of Parquet files as a stream. Its keyed state lives on disk (RocksDB, with changelogs in the
checkpoint) and never expires: under the digest of a text (SHA-256 of its UTF-8, A-Z in lower case) it keeps the identifier and
the place (file and row) of the row that stays, which is the one with the largest doc_id, and how many rows came. Rows of one
text are combined before they are exchanged, so a text that a third of all rows repeat is one row a task. A stream that is
started again goes on from its checkpoint.

``resolve`` reads the state and gives every row its group:

* A digest that one row has needs nothing else.
* Rows of the others (hits) are written once with their texts. A bitmap of 2**HIT_BITS bits, whatever the corpus, keeps most
  other rows out of that; those that pass drop out at the join with the state.
* The bytes of hits are compared in full: a digest's least and greatest text are equal, or it holds different texts. Such
  digests are grouped by their texts instead of the digest.

Null texts are empty ones, and equal to them. Of rows that share the largest doc_id, the one in the last place (file by name,
then row) stays; null doc_ids come before all others, so keep_id is null only if all of a group's are. An empty table gives
no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegauge.sources import scratch

#: Bits of the bitmap of digests with more than one row, 64 in a row of a broadcast table: 16 MB at most.
HIT_BITS = 24
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # no megabytes of empty files a partition
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, ascii_uppercase, ascii_lowercase))


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _placed(docs: DataFrame, digest) -> DataFrame:
    return docs.select("doc_id", digest(F.col("text")).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "text")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    found = spark.read.parquet(path)
    schema = f"doc_id {found.schema['doc_id'].dataType.simpleString()}, text string"
    return spark.read.schema(schema).parquet(path), schema


def ingest(spark: SparkSession, path: str, checkpoint: str, bytes_per_trigger: int = 256 << 30, files_per_trigger: int | None = None, digest=digest_of) -> None:
    """Take what is new under ``path`` (a folder of Parquet files, or a pattern) into the state under ``checkpoint``."""
    _, schema = _read(spark, path)
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else source.option("maxBytesPerTrigger", bytes_per_trigger)
    state = _placed(source.parquet(path), digest).groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        # a query keeps the settings that it starts with
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def held(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """The state: digest, keep_id, file, row, n. None before the first batch."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return None
    state = spark.read.format("statestore").load(checkpoint)
    stays = F.col("value")[state.schema["value"].dataType.names[0]]
    return state.select(F.col("key.digest").alias("digest"), stays["doc_id"].alias("keep_id"), stays["file"].alias("file"), stays["row"].alias("row"), F.col("value.count").alias("n"))


def _grouped(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """rows: doc_id, digest, file, row; groups: keep_id, keep_file, keep_row, n."""
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    return rows.join(groups, on).select("doc_id", "keep_id", F.col("n").alias("group_size"), stays.alias("kept"), F.col("digest").alias("text_sha256"))


def resolve(spark: SparkSession, path: str, checkpoint: str, digest=digest_of) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row that was taken in."""
    docs, _ = _read(spark, path)
    state = held(spark, checkpoint)
    if state is None:
        return _placed(docs, digest).where("false").select("doc_id", F.col("doc_id").alias("keep_id"), F.col("row").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    state = scratch.written(state, "state")
    single = state.where("n = 1").select(F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    groups = state.where("n > 1").select("digest", "keep_id", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), "n")
    bit = F.xxhash64("digest").bitwiseAND((1 << HIT_BITS) - 1)
    bits = groups.select(bit.alias("bit")).groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
    rows = _placed(docs, digest).withColumn("bit", bit).withColumn("word", F.shiftrightunsigned("bit", 6)).join(F.broadcast(bits), "word")
    hits = scratch.written(rows.where(F.expr("getbit(bits, CAST(bit & 63 AS INT)) = 1")).select("doc_id", "digest", "file", "row", normalised(F.col("text")).alias("text")), "hits")
    compared = hits.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    mixed = scratch.written(compared.where("a <> b").select("digest"), "mixed")
    narrow = hits.select("doc_id", "digest", "file", "row")
    if mixed.isEmpty():
        return single.unionByName(_grouped(narrow, groups, ["digest"]))
    told = _grouped(narrow, groups.join(mixed, "digest", "left_anti"), ["digest"])
    apart = hits.join(mixed, "digest")
    exact = apart.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("x"), F.count("*").alias("n"))
    exact = exact.select("digest", "text", F.col("x.doc_id").alias("keep_id"), F.col("x.file").alias("keep_file"), F.col("x.row").alias("keep_row"), "n")
    return single.unionByName(told).unionByName(_grouped(apart, exact, ["digest", "text"]))


def dedup(spark: SparkSession, path: str) -> DataFrame:
    """All of a folder at once, with a new state."""
    checkpoint = scratch.new_path(spark, "dedup")
    ingest(spark, path, checkpoint)
    return resolve(spark, path, checkpoint)


ORACLE = """WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)"""
