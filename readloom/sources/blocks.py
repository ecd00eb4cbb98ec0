"""The row format: blocks of SAM lines with their bounds, as a DataFrame and as bytes of a file."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from readloom.functions import cigar, records
from readloom.functions.region import Region, flag_excludes, overlaps
from readloom.schema import UNMAPPED, ReadsError

#: Fixed values of the file: magic, version, header (version, references, blocks, place of the index), index entry.
MAGIC, VERSION, HEADER, ENTRY = b"AXF0", 1, "<IIQQ", "<IiiIQQ"
BLOCKS = "ref_id int, start_pos int, end_pos int, record_count int, payload binary"


def row_blocks(reads: DataFrame, order: tuple[str, ...] = ("pos", "qname"), span: int | None = None) -> DataFrame:
    """(ref, start_pos, end_pos, record_count, payload) of mapped reads: a block a contig, or one for each ``span`` bases of it.

    A block is one value, so a contig of many reads needs a span, and a span of very many reads ``streamed_blocks``.
    """
    line = F.struct(*order, F.concat(records.sam_line(), F.lit("\n")).alias("_line"))
    part = [F.floor(F.col("pos") / span).alias("_part")] if span else []
    found = reads.where(flag_excludes(UNMAPPED) & (F.col("pos") >= 0)).groupBy("ref", *part)
    out = found.agg(F.min("pos").alias("start_pos"), F.max("end_pos").cast("int").alias("end_pos"), F.count("*").cast("int").alias("record_count"), F.array_sort(F.collect_list(line)).alias("_lines"))
    return out.select("ref", "start_pos", "end_pos", "record_count", F.array_join("_lines._line", "").cast("binary").alias("payload"))


def streamed_blocks(reads: DataFrame, span: int, order: tuple[str, ...] = ("pos", "qname"), most: int = 4096) -> DataFrame:
    """As ``row_blocks`` with a span, but a block ends after ``most`` records, and ``number`` counts those of a span: rows are sorted and streamed, and a task holds one block."""
    made = T.StructType.fromDDL("ref string, start_pos int, end_pos int, record_count int, payload binary, number long")
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lines, low, high, number = None, [], 0, 0, 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"ref": key[0], "start_pos": low, "end_pos": high, "record_count": len(lines), "payload": b"".join(lines), "number": number}], schema)

        for batch in batches:
            for ref, part, pos, end, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lines and (len(lines) == most or key != (ref, part)):
                    yield block()
                    lines = []
                if not lines:
                    number = number + 1 if key == (ref, part) else 0
                    key, low, high = (ref, part), pos, end
                low, high = min(low, pos), max(high, end)
                lines.append(line)
        if lines:
            yield block()

    line = F.concat(records.sam_line(), F.lit("\n")).cast("binary").alias("_line")
    mapped = reads.where(flag_excludes(UNMAPPED) & (F.col("pos") >= 0)).select("ref", F.floor(F.col("pos") / span).alias("_part"), F.col("pos").cast("int"), F.col("end_pos").cast("int"), line, *(c for c in order if c != "pos"))
    ordered = mapped.repartition("ref", "_part").sortWithinPartitions("ref", "_part", *order)
    return ordered.select("ref", "_part", "pos", "end_pos", "_line").mapInArrow(run, made)


def light_fields(line: str) -> tuple:
    """The first fields of a SAM line, unread but for the position: contig, position (0-based), CIGAR (``*`` where it is missing)."""
    f = F.split(line, "\t", 8)
    short = F.raise_error(F.lit("SAM line has fewer than 6 fields"))
    pos = F.get(f, F.lit(3)).try_cast("int") - 1
    return F.when(F.size(f) < 6, short).otherwise(F.get(f, F.lit(2))), F.coalesce(pos, F.raise_error(F.lit("invalid SAM POS"))), F.coalesce(F.get(f, F.lit(5)), F.lit("*"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """(ref, block, number, line_number, sam_line) of the payloads; ``number`` orders blocks of one begin."""
    lines = F.posexplode(F.split(F.rtrim(F.col("payload").cast("string"), F.lit("\n")), "\n")).alias("line_number", "sam_line")
    number = F.col("number") if "number" in blocks.columns else F.lit(0).alias("number")
    return blocks.where("record_count > 0").select("ref", F.col("start_pos").alias("block"), number, lines)


def query_blocks(blocks: DataFrame, region: Region) -> DataFrame:
    """Blocks that overlap the region; payloads of others are not touched."""
    if region.start >= region.end:
        raise ReadsError("block query requires start < end")
    return blocks.where((F.col("ref") == region.ref) & overlaps(F.col("start_pos"), F.col("end_pos"), region.start, region.end))


def view_blocks(blocks: DataFrame, region: Region) -> DataFrame:
    """The lines of reads that overlap the region, by their text."""
    ref, pos, ops = light_fields("sam_line")
    lines = block_lines(query_blocks(blocks, region)).select("*", ref.alias("_ref"), pos.alias("_pos"), (pos + cigar.reference_span(ops)).alias("_end"))
    found = lines.where((F.col("_ref") == region.ref) & overlaps(F.col("_pos"), F.col("_end"), region.start, region.end))
    return found.orderBy("block", "number", "line_number").select("sam_line")


def by_end(blocks: DataFrame) -> DataFrame:
    """Blocks numbered within a contig by their end, as a binary search needs them."""
    return blocks.withColumn("end_rank", F.row_number().over(Window.partitionBy("ref").orderBy("end_pos", "start_pos")))


def check(contigs: list[tuple[str, int]], blocks: Iterable[tuple]) -> None:
    for ref_id, start, end, count, payload in blocks:
        if not 0 <= ref_id < len(contigs):
            raise ReadsError("a block's contig is not in the header")
        if start < 0 or start >= end:
            raise ReadsError("block requires 0 <= start < end")
        if payload.count(b"\n") != count:
            raise ReadsError("a block's record count differs from its lines")


def pack_blocks(contigs: list[tuple[str, int]], blocks: list[tuple]) -> bytes:
    """A file of contigs (name, length) and blocks (``BLOCKS``)."""
    check(contigs, blocks)
    names = b"".join(struct.pack("<H", len(n.encode())) + n.encode() + struct.pack("<I", length) for n, length in contigs)
    at = len(MAGIC) + struct.calcsize(HEADER) + len(names)
    index = []
    for ref_id, start, end, count, payload in blocks:
        index.append(struct.pack(ENTRY, ref_id, start, end, count, at, len(payload)))
        at += len(payload)
    return b"".join([MAGIC, struct.pack(HEADER, VERSION, len(contigs), len(blocks), at), names, *(b[4] for b in blocks), *index])


def parse_blocks(data: bytes) -> tuple[list[tuple[str, int]], list[tuple]]:
    """Contigs and blocks of a file, these by contig, start and end."""
    if data[:4] != MAGIC:
        raise ReadsError("invalid block file magic")
    try:
        version, n_refs, n_blocks, index = struct.unpack_from(HEADER, data, 4)
        if version != VERSION:
            raise ReadsError("unsupported block file version")
        at, contigs = 4 + struct.calcsize(HEADER), []
        for _ in range(n_refs):
            (size,) = struct.unpack_from("<H", data, at)
            contigs.append((data[at + 2 : at + 2 + size].decode(), *struct.unpack_from("<I", data, at + 2 + size)))
            at += 6 + size
        if not at <= index <= len(data):
            raise ReadsError("the index of the block file is out of place")
        entries = [struct.unpack_from(ENTRY, data, index + k * struct.calcsize(ENTRY)) for k in range(n_blocks)]
    except struct.error:
        raise ReadsError("truncated block file") from None
    if index + n_blocks * struct.calcsize(ENTRY) != len(data):
        raise ReadsError("unexpected trailing bytes in block file")
    if any(not start <= place <= place + size <= index for *_, place, size in entries for start in (at,)):
        raise ReadsError("a payload is out of place")
    blocks = sorted((*e[:4], data[e[4] : e[4] + e[5]]) for e in entries)
    check(contigs, blocks)
    return contigs, blocks
