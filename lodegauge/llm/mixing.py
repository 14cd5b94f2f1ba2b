"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source; a source's target is its weighted share of the total, cut at a multiple of its own size,
with the excess reshared by weight among the rest until nothing is above. That fixed point is a water level L with
target = min(cap, L * weight), found exactly from running sums over sources ordered by cap / weight. The repetition rate
of a source is target / size; each document is taken floor(rate) times, plus once more when a hash of its key falls
below the fraction (a seeded Bernoulli draw). Runs over the same rows agree.

Nulls: a null text has size 0; a null source is a source of its own, placed last; a null key is a key. Sources of size 0
have target 0. Rows that repeat a key draw by their text and source and by their number among equal rows besides. Extra columns, of
whatever name, are kept by ``mix_documents`` and ignored by ``mixing_report``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.sources import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content() -> Column:
    """What tells rows that share a key apart."""
    return F.md5(F.concat(F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("|"), F.col("source").cast("string")), F.lit(""))))


def draw(key: Column, seed: str, place: Column | None = None) -> Column:
    """A number in [0, 1) that depends on the key, the seed and the place (where it is not null) alone: 52 bits of a
    digest."""
    more = F.lit("") if place is None else F.coalesce(F.concat(F.lit(":"), place.cast("string")), F.lit(""))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")), more))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each new name, the sum of a column over the rows before in the given order (unique per row), and
    ``place``, their number. Ranges are summed by themselves and offset by the totals of those before, a row a range."""
    part = scratch.written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = part.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sofar = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    offsets = totals.select("__part", sofar("__n", earlier).alias("__at"), *[sofar(f"__{n}", earlier).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = part.withColumn("place", sofar(F.lit(1), within)).select("*", *[sofar(c, within).alias(n) for n, c in sums.items()])
    joined = own.join(scratch.lookup(scratch.written(offsets, "offsets")), "__part")
    return joined.select(*df.columns, (F.col("place") + F.col("__at")).alias("place"), *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def source_targets(sizes: DataFrame, budget: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, target, rate for a frame of (source, size). One row a source after partial sums."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(by_source, [F.col("source").asc_nulls_last()], {})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    w = ranked.select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("cap"))
    w = running(w, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], {"capped": "cap", "taken": "weight"})
    w = scratch.written(w, "levels")
    whole = w.agg((F.sum("source_size") * F.lit(float(budget))).alias("total"), F.sum("weight").alias("weights")).first()
    if whole["total"] is None:
        return w.select("source", "source_size", F.lit(0.0).alias("target"), F.lit(0.0).alias("rate"))
    level = (F.lit(whole["total"]) - F.col("capped")) / (F.lit(whole["weights"]) - F.col("taken"))
    # the first source that the level leaves uncapped fixes the level of all; none: every source stops at its cap
    water = w.where(level <= F.col("cap") / F.col("weight")).agg(F.min(F.struct("place", level.alias("level"))).alias("first")).first()["first"]
    target = F.col("cap") if water is None else F.least("cap", F.lit(water["level"]) * F.col("weight"))
    return w.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def _repeated(sizes: DataFrame) -> DataFrame | None:
    """Keys of several rows (__key), or None where there are none."""
    found = scratch.written(sizes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__key"), F.lit(True).alias("__again")), "repeated")
    return scratch.lookup(found) if found.limit(1).count() else None


def _placed(rows: DataFrame, key: Column, content: Column, repeated: DataFrame | None) -> tuple[DataFrame, Column | None]:
    """rows, and what those of repeated keys draw by besides: their content and their number among equal ones. Numbers
    come from the rows' own partitions, offset by the counts of those before, so no key is gathered in one task."""
    if repeated is None:
        return rows, None
    known = rows.withColumn("__at", F.monotonically_increasing_id()).join(repeated, key.eqNullSafe(F.col("__key")), "left").drop("__key")
    kind, none = ["__kind", "__piece"], F.lit(None).cast("string")
    many = known.where("__again").withColumn("__kind", F.xxhash64(key, content)).withColumn("__piece", F.shiftright("__at", 33))
    many = scratch.written(many.withColumn("__nth", F.row_number().over(Window.partitionBy(*kind).orderBy("__at"))), "many")
    before = Window.partitionBy("__kind").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = many.groupBy(*kind).agg(F.count("*").alias("__n")).select(*kind, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__more"))
    numbered = many.join(scratch.lookup(scratch.written(offsets, "offsets")), kind)
    place = F.concat_ws(":", content, (F.col("__nth") + F.col("__more")).cast("string"))
    both = known.where("__again is null").select(*[F.col(f"`{c}`") for c in rows.columns], none.alias("__place"))
    return both.union(numbered.select(*[F.col(f"`{c}`") for c in rows.columns], place.alias("__place"))), F.col("__place")


def mixing_report(
    docs: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix"
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    sizes = scratch.written(docs.select(F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size"), content().alias("content")), "sizes")
    t = scratch.written(source_targets(sizes, budget, cap, weights).withColumnRenamed("source", "its_source"), "targets")
    rows, place = _placed(sizes, F.col("doc_id"), F.col("content"), _repeated(sizes))
    # joined by size known from the written table: broadcast while it is small
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("its_source")), "left")
    whole = F.floor("rate")
    copies = F.coalesce(whole + (draw(F.col("doc_id"), seed, place) < F.col("rate") - whole).cast("long"), F.lit(0)).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mix_documents(
    docs: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix"
) -> DataFrame:
    """The documents of the mix: each row repeated as often as it is taken, in the columns it came with. Columns go under names
    of this function's own meanwhile, so that theirs do not matter."""
    known, names = docs.columns, [f"__c{i}" for i in range(len(docs.columns))]
    sizes = scratch.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = scratch.written(source_targets(sizes, budget, cap, weights), "targets").select(F.col("source").alias("__mix_source"), F.col("rate").alias("__mix_rate"))
    own = [F.col("doc_id").cast("long").alias("__id"), F.col("source").alias("__source"), content().alias("__content")]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(known, names)], *own)
    rows, place = _placed(plain, F.col("__id"), F.col("__content"), _repeated(sizes))
    joined = rows.join(targets, F.col("__source").eqNullSafe(F.col("__mix_source")), "left")
    whole = F.floor("__mix_rate")
    copies = (whole + (draw(F.col("__id"), seed, place) < F.col("__mix_rate") - whole).cast("long")).cast("int")
    copy = F.explode(F.array_repeat(F.lit(0), F.coalesce(copies, F.lit(0))))
    return joined.select(*names, copy.alias("__mix_copy")).select(*[F.col(n).alias(c) for c, n in zip(known, names)])


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN ':' || md5(coalesce(text, '') || coalesce('|' || source, '')) || ':' || row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) ELSE '' END AS place
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS weight
  FROM sizes GROUP BY source
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM by_source
), targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM levels WHERE level <= cap / weight) * weight, cap)) AS target
  FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       (s.size * (floor(r.rate)
         + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null') || s.place), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
                     < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""
