"""Per-base depth, depth runs and coverage summary."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions import cigar
from readloom.functions.region import Region, in_region, record_filter
from readloom.schema import UNMAPPED

#: Depth is swept within tiles of so many bases: no task holds a contig.
TILE = 1 << 14


def counted(reads: DataFrame, region: Region | None, flag_exclude: int = 0, min_mapq: int = 0) -> DataFrame:
    """The records that count: mapped, overlapping and past the filter."""
    out = reads.where(F.col("flag").bitwiseAND(F.lit(UNMAPPED)) == 0)
    if region:
        out = out.where(in_region(region))
    keep = record_filter(flag_exclude, min_mapq)
    return out if keep is None else out.where(keep)


def _stretches(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that a CIGAR covers, from the read's position on; adjoining ones are joined."""
    found = re.findall(cigar.PART, text)
    lengths = np.array([int(n) for n, _ in found], np.int64)
    ends = np.cumsum(lengths * np.array([op in cigar.CONSUME for _, op in found], np.int64))
    cover = np.array([op in cigar.COVER for _, op in found], bool)
    end, start = ends[cover], (ends - lengths)[cover]
    joins = start[1:] == end[:-1]
    return start[np.append(True, ~joins)[: len(start)]], end[np.append(~joins, True)[: len(end)]]


@lru_cache(maxsize=1 << 14)
def _short(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``_stretches`` of short texts, which recur."""
    return _stretches(text)


def covered(reads: DataFrame) -> DataFrame:
    """(ref, s, e) for each covered stretch of reads (ref, pos, cigar), in time linear in the CIGAR: the reads of long
    sequencers have thousands of operations, over which an array that grows in a column expression is quadratic."""
    schema = pa.schema([("ref", pa.string()), ("s", pa.int64()), ("e", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = np.zeros(0, np.int64)
            found = [(_short if len(c) <= 64 else _stretches)(c) for c in batch.column("cigar").to_pylist()]
            counts = np.array([len(a) for a, _ in found], np.int64)
            rows = np.repeat(np.arange(len(found)), counts)
            at = batch.column("pos").to_numpy(zero_copy_only=False)[rows]
            s, e = (np.concatenate([none, *(x[k] for x in found)]) + at for k in (0, 1))
            refs = batch.column("ref").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([refs, pa.array(s), pa.array(e)], schema=schema)

    known = reads.where("pos IS NOT NULL AND cigar IS NOT NULL")
    return known.select("ref", F.col("pos").cast("long").alias("pos"), "cigar").mapInArrow(run, "ref string, s long, e long")


def depth_runs(reads: DataFrame, region: Region | None = None, flag_exclude: int = 0, min_mapq: int = 0) -> DataFrame:
    """(ref, start, end, depth) for stretches of equal depth above 0, cut at tile borders.

    A covered block gives an opening and a closing event in each tile it meets. Events are summed by position before
    they are shuffled, and a running sum within the tile is the depth: work follows reads, not bases.
    """
    found = covered(counted(reads, region, flag_exclude, min_mapq))
    low, high = F.col("s"), F.col("e")
    if region:
        low, high = F.greatest(low, F.lit(region.start).cast("long")), F.least(high, F.lit(region.end).cast("long"))
    clipped = found.select("ref", low.alias("s"), high.alias("e")).where("s < e")
    tiles = clipped.withColumn("tile", F.explode(F.sequence(F.floor(F.col("s") / TILE), F.floor((F.col("e") - 1) / TILE))))
    s, e = F.greatest("s", F.col("tile") * TILE), F.least("e", (F.col("tile") + 1) * TILE)
    events = tiles.select("ref", "tile", F.inline(F.array(F.struct(s.alias("pos"), F.lit(1).cast("long").alias("step")), F.struct(e.alias("pos"), F.lit(-1).cast("long").alias("step")))))
    summed = events.groupBy("ref", "tile", "pos").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("ref", "tile").orderBy("pos")
    swept = summed.select("ref", F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), F.sum("step").over(order).alias("depth"))
    return swept.where("depth > 0")


def depth(reads: DataFrame, region: Region, flag_exclude: int = 0, min_mapq: int = 0, all_positions: bool = False) -> DataFrame:
    """(ref, pos, depth), pos from 0; positions without depth only on request."""
    runs = depth_runs(reads, region, flag_exclude, min_mapq)
    found = runs.select("ref", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "depth")
    if not all_positions:
        return found
    every = reads.sparkSession.range(region.start, region.end).select(F.lit(region.ref).alias("ref"), F.col("id").alias("pos"))
    return every.join(found.select("pos", "depth"), "pos", "left").select("ref", "pos", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def summary(reads: DataFrame, region: Region, flag_exclude: int = 0, min_mapq: int = 0) -> DataFrame:
    """One row: bases, records, covered_bases, total_depth, mean_depth over all bases of the region."""
    bases = region.end - region.start
    width = F.col("end") - F.col("start")
    sums = depth_runs(reads, region, flag_exclude, min_mapq).agg(F.coalesce(F.sum(width), F.lit(0)).cast("long").alias("covered_bases"), F.coalesce(F.sum(width * F.col("depth")), F.lit(0)).cast("long").alias("total_depth"))
    records = counted(reads, region, flag_exclude, min_mapq).agg(F.count("*").alias("records"))
    return records.join(F.broadcast(sums)).select(F.lit(region.ref).alias("reference"), F.lit(region.start + 1).cast("long").alias("start"), F.lit(region.end).cast("long").alias("end"), F.lit(bases).cast("long").alias("bases"), "records", "covered_bases", "total_depth", (F.col("total_depth") / bases if bases else F.lit(None).cast("double")).alias("mean_depth"))


def depth_tsv(found: DataFrame) -> DataFrame:
    """Text lines: reference, position from 1, depth."""
    return found.select(F.concat_ws("\t", "ref", (F.col("pos") + 1).cast("string"), F.col("depth").cast("string")).alias("value"))
