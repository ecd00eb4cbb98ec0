"""Greedy chunk packing, the chunk index, and interval lookups."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from readloom.functions.records import record_bytes
from readloom.functions.region import Region, overlaps
from readloom.schema import ReadsError, project


def positive(name: str, text: str) -> int:
    """A whole number above 0 from a setting's text."""
    if not text.isascii() or not text.isdigit() or int(text) == 0 or int(text) >= 1 << 63:
        raise ReadsError(f"{name} must be a positive integer")
    return int(text)


@dataclass(frozen=True)
class Policy:
    """Bounds of a chunk: sizes in estimated plain bytes, records, bases."""

    target_bytes: int = 256 * 1024
    max_bytes: int = 512 * 1024
    max_records: int = 4096
    max_span: int = 1_000_000

    def __post_init__(self) -> None:
        for name in ("target_bytes", "max_bytes", "max_records", "max_span"):
            if getattr(self, name) <= 0:
                raise ReadsError(f"chunk policy {name} must be positive")
        if self.target_bytes > self.max_bytes:
            raise ReadsError("chunk policy target_bytes must not exceed max_bytes")

    @classmethod
    def from_settings(cls, settings: Mapping[str, str]) -> Policy:
        """The policy with what the environment, or another mapping, overrides: READLOOM_CHUNK_TARGET_BYTES and so on."""
        names = {f.name: f"READLOOM_CHUNK_{f.name.upper()}" for f in fields(cls)}
        return cls(**{k: positive(v, settings[v]) for k, v in names.items() if v in settings})


CHUNKS = "ref string, chunk_id long, start_pos long, end_pos long, record_count long, bytes long"


def pack(reads: DataFrame, policy: Policy = Policy(), order: tuple[str, ...] = ("pos", "qname"), first: str | None = None) -> DataFrame:
    """``CHUNKS`` of coordinate-sorted reads, numbered within each contig; on request with ``first``, that column's value in a chunk's first record.

    A chunk ends before a record that would pass a maximum and after one that reaches the target. That is one ordered
    pass over a contig; it sees four narrow columns, streams, and holds one chunk's state, so a long contig costs time and no memory.
    """
    made = T.StructType([*T.StructType.fromDDL(CHUNKS).fields, *([T.StructField("first", reads.schema[first].dataType)] if first else [])])
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref, number, chunk = None, 0, None
        for batch in batches:
            done: list[tuple] = []
            for name, start, end, size, *mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != ref:
                    if chunk:
                        done.append((ref, number, *chunk))
                    ref, number, chunk = name, 0, None
                if chunk:
                    low, high = min(chunk[0], start), max(chunk[1], end)
                    if chunk[2] == policy.max_records or chunk[3] + size > policy.max_bytes or high - low > policy.max_span:
                        done.append((ref, number, *chunk))
                        number, chunk = number + 1, None
                chunk = [min(chunk[0], start), max(chunk[1], end), chunk[2] + 1, chunk[3] + size, *chunk[4:]] if chunk else [start, end, 1, size, *mark]
                if chunk[3] >= policy.target_bytes:
                    done.append((ref, number, *chunk))
                    number, chunk = number + 1, None
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in done], schema)
        if chunk:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (ref, number, *chunk), strict=True))], schema)

    narrow = reads.select("ref", F.col("pos").cast("long"), F.col("end_pos").cast("long"), record_bytes().alias("size"), *(c for c in order if c not in ("ref", "pos")), *([F.col(first).alias("_first")] if first else []))
    ordered = narrow.repartition("ref").sortWithinPartitions("ref", *order)
    return ordered.select("ref", "pos", "end_pos", "size", *(["_first"] if first else [])).mapInArrow(run, made)


def cuts(chunks: DataFrame, n: int) -> list[tuple[str, int]]:
    """(ref, bin) where each of up to ``n`` ranges of ``chunks`` (ref, _bin) but the first begins, of about as many chunks each."""
    dealt = chunks.select("ref", "_bin").repartitionByRange(n, "ref", "_bin")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("ref", "_bin")).alias("first")).select("first.*").collect()  # a row a range
    return sorted(tuple(r) for r in firsts)[1:]


def range_number(bounds: list[tuple[str, int]], low: int = 0) -> Column:
    """How many of ``bounds`` (sorted) are not above the row's (ref, _bin): a binary search."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    ref, at = bounds[mid]
    below = (F.col("ref") < ref) | ((F.col("ref") == ref) & (F.col("_bin") < at))
    return F.when(below, range_number(bounds[:mid], low)).otherwise(range_number(bounds[mid + 1 :], low + mid + 1))


def assign(reads: DataFrame, chunks: DataFrame, tie: str = "qname", bin_size: int = 1 << 8) -> DataFrame:
    """``reads`` with the ``chunk_id`` of their chunk, from ``pack(..., first=tie)`` over the same reads.

    A chunk is entered in the bins from its first record to the next chunk's, and sorted among the reads of each: a read is of the
    last chunk entered before it, so work follows reads however many chunks a bin has. Rows come in ranges of contig and
    position, sorted by (ref, pos, tie) within each. The ranges are taken from the chunks, so reads are made and moved once.
    """
    w = Window.partitionBy("ref").orderBy("chunk_id")
    bins = F.sequence(F.floor(F.col("start_pos") / bin_size), F.floor(F.coalesce(F.lead("start_pos").over(w), F.col("end_pos")) / bin_size))
    spans = chunks.select("ref", "chunk_id", F.col("start_pos").alias("_at"), F.col("first").alias(tie), bins.alias("_bins"))
    entered = spans.select("ref", "chunk_id", "_at", tie, F.explode("_bins").alias("_bin"), F.lit(0).alias("_read"))
    own = chunks.select("ref", F.floor(F.col("start_pos") / bin_size).alias("_bin"))
    bounds = cuts(own, int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.col("pos").cast("long")
    rows = reads.withColumns({"_at": at, "_bin": F.floor(at / bin_size), "_read": F.lit(1)}).unionByName(entered, allowMissingColumns=True)
    dealt = rows.withColumn("_range", range_number(bounds)).repartitionById(len(bounds) + 1, F.col("_range"))
    before = Window.partitionBy("ref", "_bin", "_range").orderBy("_at", tie, "_read").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("chunk_id", F.last("chunk_id", ignorenulls=True).over(before)).where("_read = 1").select(*reads.columns, "chunk_id")


def intervals(chunks: DataFrame) -> DataFrame:
    """The chunk index as an interval index: what a chunk covers, where its plain bytes begin, and its length."""
    w = Window.partitionBy("ref").orderBy("chunk_id")
    return chunks.select("ref", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), (F.sum("bytes").over(w) - F.col("bytes")).alias("chunk_offset"), F.col("bytes").alias("column_index_offset"))


def read_chunk(reads: DataFrame, ref: str, chunk_id: int, columns: list[str] | None = None) -> DataFrame:
    """One chunk's reads, the named columns; of a dataset only its files of that contig and those columns are read."""
    return project(reads.where((F.col("ref") == ref) & (F.col("chunk_id") == chunk_id)), columns)


def query_region_chunks(reads: DataFrame, chunks: DataFrame, region: Region) -> DataFrame:
    """All reads of each chunk that overlaps the region, whether or not they do."""
    return reads.join(query_chunks(chunks, region).select("ref", "chunk_id"), ["ref", "chunk_id"], "left_semi")


def query_chunks(chunks: DataFrame, region: Region) -> DataFrame:
    if region.start >= region.end:
        raise ReadsError("chunk query requires start < end")
    return chunks.where((F.col("ref") == region.ref) & overlaps(F.col("start_pos"), F.col("end_pos"), region.start, region.end))


def chunk_summary(chunks: DataFrame) -> DataFrame:
    span = F.col("end_pos") - F.col("start_pos")
    measured = (("records", F.col("record_count")), ("span", span), ("bytes", F.col("bytes")))
    return chunks.agg(F.count("*").alias("chunks"), F.sum("record_count").alias("total_records"), *(f(c).alias(f"{k}_{n}") for n, c in measured for k, f in (("min", F.min), ("max", F.max), ("avg", F.avg))))


def overlap_join(left: DataFrame, regions: DataFrame, bin_size: int = 1 << 14, left_end: str = "end_pos") -> DataFrame:
    """Pairs of ``left`` (ref, pos, end) and ``regions`` (region_id, region_ref, region_start, region_end) that overlap.

    Either side is entered in the bins it meets and joined on contig and bin; a pair is kept in the first bin that both meet, so
    each comes once and no nested loop is planned, however many regions there are.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size)))
    a = left.withColumn("_bin", bins("pos", left_end))
    b = regions.where("region_start < region_end").withColumn("_region_bin", bins("region_start", "region_end"))
    met = a.join(b, (F.col("ref") == F.col("region_ref")) & (F.col("_bin") == F.col("_region_bin")))
    once = F.col("_bin") == F.floor(F.greatest("pos", "region_start") / bin_size)
    return met.where(once & overlaps(F.col("pos"), F.col(left_end), F.col("region_start"), F.col("region_end"))).drop("_bin", "_region_bin")
