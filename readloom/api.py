"""The commands: open, view, stats, coverage, pileup, convert, index, export."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import cigar, records
from readloom.functions.region import in_region, parse_region, record_filter
from readloom.operators import chunking, depth
from readloom.operators.stats import stats, stats_tsv  # noqa: F401
from readloom.schema import ReadsError, project
from readloom.sources import blocks
from readloom.sources.files import assert_valid, contigs_of, convert, export_bam, export_sam, file_bytes, find_bam_index, index_bam, open_dataset, read_bam, read_bam_region, read_bam_split, read_sam, require_contig, sniff_path  # noqa: F401


def open_reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a SAM, BAM or block file or a dataset, told by content, with ``end_pos``; of files also with their order, ``ord``."""
    kind = sniff_path(spark, path)
    if kind == "DATASET":
        return open_dataset(spark, path)
    if kind == "ROWS":
        contigs, found = blocks.parse_blocks(file_bytes(spark, path))
        rows = spark.createDataFrame([(contigs[b[0]][0], *b[1:]) for b in found], "ref string, start_pos int, end_pos int, record_count int, payload binary")
        place = F.struct(F.lit(path).alias("file"), F.col("block").cast("long").alias("start"), F.col("line_number").cast("long").alias("row"))
        reads = records.parse_sam(blocks.block_lines(rows).select(F.col("sam_line").alias("value"), place.alias("ord")), carry=("ord",))
    else:
        reads = read_bam(spark, path) if kind == "BAM" else read_sam(spark, path)
    return reads.withColumn("end_pos", F.col("pos") + cigar.reference_span(F.col("cigar")))


def query_region(reads: DataFrame, region: str, columns: list[str] | None = None, flag_exclude: int = 0, min_mapq: int = 0, contigs: DataFrame | None = None) -> DataFrame:
    """Reads that overlap the region. With the list of ``contigs`` an unknown one is an error, else it has no reads."""
    if contigs is not None:
        require_contig(contigs, parse_region(region))
    found = reads.where(in_region(parse_region(region)))
    keep = record_filter(flag_exclude, min_mapq)
    return project(found if keep is None else found.where(keep), columns)


def view(reads: DataFrame, region: str, flag_exclude: int = 0, min_mapq: int = 0, contigs: DataFrame | None = None) -> DataFrame:
    """SAM lines (sam_line) in coordinate order, ties as in the input where ``ord`` tells it."""
    found = query_region(reads, region, None, flag_exclude, min_mapq, contigs)
    return found.orderBy("pos", "ord" if "ord" in reads.columns else "qname").select(records.sam_line().alias("sam_line"))


def view_path(spark: SparkSession, path: str, region: str, flag_exclude: int = 0, min_mapq: int = 0) -> DataFrame:
    """``view`` of a file or dataset; a contig that it doesn't list is an error."""
    if sniff_path(spark, path) == "BAM" and find_bam_index(spark, path):
        return view(read_bam_region(spark, path, parse_region(region)), region, flag_exclude, min_mapq)
    return view(open_reads(spark, path), region, flag_exclude, min_mapq, contigs_of(spark, path))


def pileup(reads: DataFrame, region: str, flag_exclude: int = 0, min_mapq: int = 0, all_positions: bool = False) -> DataFrame:
    return depth.depth(reads, parse_region(region), flag_exclude, min_mapq, all_positions).orderBy("pos")


def coverage(reads: DataFrame, region: str, flag_exclude: int = 0, min_mapq: int = 0) -> DataFrame:
    return depth.summary(reads, parse_region(region), flag_exclude, min_mapq)


#: Columns and types of the table readers.
TABLE_TYPES = {"flag": "uint16", "pos": "int32", "mapq": "uint8", "mate_pos": "int32", "template_length": "int32"}
BAM_COLUMNS = ("qname", "flag", "ref", "pos", "end_pos", "mapq", "template_length")


def bam_columns(reads: DataFrame, region: str, flag_exclude: int = 0, min_mapq: int = 0) -> DataFrame:
    return query_region(reads, region, list(BAM_COLUMNS), flag_exclude, min_mapq)


def to_dataframe(reads: DataFrame, columns: list[str] | None = None):
    """A pandas table of the reads, numbers in their smallest types: for results that fit the driver."""
    table = project(reads, columns).toPandas()
    return table.astype({c: t for c, t in TABLE_TYPES.items() if c in table.columns})


def column_array(reads: DataFrame, name: str):
    """A numeric column as a numpy array."""
    if name not in TABLE_TYPES:
        raise ReadsError(f"not a numeric column: {name}")
    return reads.select(name).toPandas()[name].to_numpy(TABLE_TYPES[name])


def coverage_to_series(depths: DataFrame, name: str = "depth"):
    """A pandas series of depths by 0-based position."""
    return depths.orderBy("pos").toPandas().set_index("pos")["depth"].astype("uint32").rename_axis("position").rename(name)


def iterate(reads: DataFrame):
    """Rows one after another, a partition at a time on the driver."""
    return reads.toLocalIterator(prefetchPartitions=True)


def depth_text(depths: DataFrame) -> DataFrame:
    """Lines of contig, 1-based position and depth."""
    return depths.select(F.concat_ws("\t", "ref", (F.col("pos") + 1).cast("string"), F.col("depth").cast("string")).alias("line"))


def coverage_text(summary: DataFrame) -> DataFrame:
    """(ord, line) of a coverage summary: name, tab, value; the mean with six significant digits of its binary value."""
    names = ("reference", "start", "end", "bases", "records", "covered_bases", "total_depth", "mean_depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [f"{n}\t{row[n]:g}" if n == "mean_depth" else f"{n}\t{row[n]}" for row in batch.to_pylist() for n in names if row[n] is not None]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.string())], names=["ord", "line"])

    return summary.select(*names).mapInArrow(run, "ord int, line string")


def build_index(reads: DataFrame, policy: chunking.Policy = chunking.Policy()) -> DataFrame:
    return chunking.pack(reads, policy)
