"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral, scaled to the
source's target, is the cumulative token demand; inverting that at a document's offset in
its source's shuffled stream gives the document's training position, and the documents
are range-sorted by position. DataFrame operations alone, but that the schedules of very many sources are asked for in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TOKEN_PATTERN, out_schema, saved, table

#: Targets of up to so many sources, a short row each, are worked out on the driver; of more by aggregates over a table of them.
MAX_SOURCES = 1_000_000
#: The plan of so many sources, a short row each, is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Hash buckets of a source, a power of 16: running sums are made within buckets, so no task sorts a whole source.
BUCKET_DIGITS = 3


def targets(sizes: list[int], weights: list[float], cap: float = 3) -> list[float]:
    """Shares by weight of the sum of sizes, at most ``cap`` times each size; the excess is reshared by weight."""
    total, fixed = sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(cap * s for s, f in zip(sizes, fixed, strict=True) if f)
        free = sum(w for w, f in zip(weights, fixed, strict=True) if not f)
        share = [cap * s if f else left * w / free for s, w, f in zip(sizes, weights, fixed, strict=True)]
        over = [i for i, (s, t) in enumerate(zip(sizes, share, strict=True)) if not fixed[i] and t > cap * s]
        if not over:
            return [float(t) for t in share]
        for i in over:
            fixed[i] = True


def ramp(rank: int) -> tuple[float, float]:
    """The default schedules: the first of three sources comes more and more often, the second evenly, the third less."""
    return ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))[rank % 3]


def position(share: Column, start: Column, end: Column) -> Column:
    """The time t at which a linear schedule from ``start`` to ``end`` has met this share of its demand."""
    # the integral start*t + (end - start)*t*t/2 equals share*(start + end)/2
    slope = end - start
    root = F.sqrt(F.greatest(start * start + slope * (start + end) * share, F.lit(0.0)))
    return F.when(slope == 0, share).otherwise((root - start) / slope)


PLAN = "_rl_source string, source_size long, target double, _rl_start double, _rl_end double"


def plan_of_many(totals: DataFrame, source_col: str, weights: tuple[float, ...], cap: float, schedule: Callable[[int], tuple[float, float]]) -> DataFrame:
    """``PLAN`` of a row for each of ``totals`` (source, size), as ``targets`` has it, with nothing but sums on the driver.

    Sources are numbered by their place in a range sort. A source is at its cap where the water level, what is left over
    the weights that are free, times its weight is more; the level only rises, so each round is one aggregate.
    """
    place = F.monotonically_increasing_id()  # partition and place in it
    ordered = totals.repartitionByRange(F.col(source_col).asc_nulls_last()).sortWithinPartitions(F.col(source_col).asc_nulls_last())
    ordered = saved(ordered.select(F.col(source_col).alias("_rl_source"), F.col("size").alias("source_size"), F.shiftright(place, 33).alias("part"), (place % (1 << 33)).alias("at")), "sources")
    starts, n = {}, 0
    for row in ordered.groupBy("part").count().orderBy("part").collect():  # a row for each partition
        starts[row["part"]], n = n, n + row["count"]
    offsets = ordered.sparkSession.createDataFrame(list(starts.items()), "part long, start long")
    ranked = ordered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("start") + F.col("at"))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    ranked = saved(ranked.select("_rl_source", "source_size", "rank", weight.alias("w")), "ranked")
    most = cap * F.col("source_size")
    total, free = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    left, full, before = total, 0, None
    while free and full != before:
        before, level = full, F.lit(float(left)) * F.col("w") / F.lit(float(free))
        over = level > most
        full, fixed, free = ranked.agg(F.count_if(over), F.sum(F.when(over, most).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        left = total - fixed
    target = F.least(level, most.cast("double")) if free else most.cast("double")
    schema = out_schema(PLAN)

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [tuple(map(float, schedule(i))) for i in batch.column("rank").to_pylist()]
            start, end = ([p[k] for p in pairs] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_rl_source", "source_size", "target")), pa.array(start, pa.float64()), pa.array(end, pa.float64())], schema=schema)

    return saved(ranked.select("_rl_source", "source_size", target.alias("target"), "rank").mapInArrow(times, PLAN), "plan")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, schedule: Callable[[int], tuple[float, float]] = ramp, carry: bool = False) -> DataFrame:
    """A row per document: id, source, size, source_size, target, taken, positions (array of double), range-sorted.

    Sources in order of code point, null last, get ``weights`` in turn. A source whose target is r times its size gives
    floor(r) whole passes and the first documents of one more, in the order of their ids' MD5; the document at which
    the demand ends gives its first words alone, so a source's taken words are its target rounded down. ``positions``
    has a training position in 0..1 for each pass that takes part of the document; rows are sorted by the first, and
    documents not taken stand last. Texts without tokens, null ones too, have size 0 and nothing is taken of them. Rows
    with equal or null ids are taken row by row. Empty tables give no rows. ``carry`` keeps the other columns of docs,
    those of equal names replaced.

    Texts are read once for sizes; sums run within hash buckets of a source, then over the buckets' totals.
    """
    spark = docs.sparkSession
    made = {"size", "source_size", "target", "taken", "positions"}
    rest = [c for c in docs.columns if carry and c not in made | {id_col, source_col}]
    name = F.col(id_col).cast("string")
    digest = F.md5(F.coalesce(name, F.lit("")))
    sized = docs.select(id_col, F.col(source_col).cast("string").alias(source_col), *rest, F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long").alias("size"), digest.alias("_rl_md5"))
    sized = saved(sized, "sizes")
    totals = saved(sized.groupBy(source_col).agg(F.sum("size").alias("size")), "totals")
    n = totals.count()
    if n > MAX_SOURCES:
        plan = plan_of_many(totals, source_col, weights, cap, schedule)
    else:
        rows = totals.orderBy(F.col(source_col).asc_nulls_last()).collect()  # at most MAX_SOURCES
        sizes = [r["size"] for r in rows]
        shares = targets(sizes, [weights[i % len(weights)] for i in range(n)], cap) if n else []
        plan = spark.createDataFrame([(r[source_col], s, t, *map(float, schedule(i))) for i, (r, s, t) in enumerate(zip(rows, sizes, shares, strict=True))], PLAN)
    plan = F.broadcast(plan) if n <= BROADCAST_SOURCES else plan
    # one key for source and bucket, never null: the join and the running sum then share one shuffle
    source_key = F.coalesce(F.concat(F.lit("="), source_col), F.lit(""))
    bucketed = sized.withColumn("_rl_key", F.concat(F.substring("_rl_md5", 1, BUCKET_DIGITS), source_key))
    sums = bucketed.groupBy("_rl_key", F.col(source_col).alias("_rl_s")).agg(F.sum("size").alias("_rl_sum"))
    before = sums.select("_rl_key", (F.sum("_rl_sum").over(Window.partitionBy("_rl_s").orderBy("_rl_key")) - F.col("_rl_sum")).alias("_rl_before"))
    inside = Window.partitionBy("_rl_key").orderBy("_rl_md5", id_col, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = bucketed.join(before, "_rl_key").join(plan, F.col(source_col).eqNullSafe(F.col("_rl_source")))
    offset = F.col("_rl_before") + F.sum("size").over(inside) - F.col("size")
    full = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    placed = joined.withColumn("_rl_offset", offset).withColumn("_rl_full", full)
    left = F.floor("target").cast("long") - F.col("_rl_full") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least("size", left - F.col("_rl_offset"))).cast("long")
    placed = placed.withColumn("_rl_part", part).withColumn("taken", F.col("_rl_full") * F.col("size") + F.col("_rl_part"))
    passes = F.col("_rl_full") + (F.col("_rl_part") > 0).cast("long")
    share = lambda i: (F.col("_rl_offset") + i * F.col("source_size")) / F.greatest("target", F.lit(1.0))
    positions = F.when((F.col("taken") > 0), F.transform(F.sequence(F.lit(0), passes.cast("int") - 1), lambda i: position(F.least(share(i), F.lit(1.0)), F.col("_rl_start"), F.col("_rl_end")))).otherwise(F.array().cast("array<double>"))
    out = placed.withColumn("positions", positions).select(id_col, source_col, *rest, "size", "source_size", "target", "taken", "positions")
    first = F.get("positions", F.lit(0))
    return out.repartitionByRange(first.asc_nulls_last(), F.col(id_col)).sortWithinPartitions(first.asc_nulls_last(), F.col(id_col))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS m FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS n FROM s),
r AS (
  SELECT 0 AS step, source, source_size, w, false AS fixed, (SELECT n FROM total)::DOUBLE AS rest, (SELECT sum(w) FROM s)::DOUBLE AS free FROM s
  UNION ALL
  SELECT step, source, source_size, w, fixed,
         (SELECT n FROM total) - sum(CASE WHEN fixed THEN 3 * source_size ELSE 0 END) OVER (),
         sum(CASE WHEN fixed THEN 0 ELSE w END) OVER ()
  FROM (SELECT step + 1 AS step, source, source_size, w, fixed OR rest * w / free > 3 * source_size AS fixed FROM r) WHERE step <= 40),
goal AS (SELECT source, source_size, CASE WHEN fixed THEN 3.0 * source_size ELSE rest * w / free END::DOUBLE AS target FROM r WHERE step = 40),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS t,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY m, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS o
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN t // source_size ELSE 0 END AS n FROM p)
SELECT doc_id, size, source_size, target, (n * size + greatest(0, least(size, t - n * source_size - o)))::BIGINT AS taken FROM f
"""
