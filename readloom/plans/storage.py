"""Registered queries over storage: chunks, column bodies, row blocks, files and datasets, each with its SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom import api
from readloom.functions import records
from readloom.functions.region import in_region, record_filter
from readloom.operators import chunking, codec_bytes, codecs, depth
from readloom.plans.queries import CHOICE, FASTA, FIELDS, HEAD, HIT, KEEP, MAPQ, MASK, ORACLES, PACK, POLICY, QUERIES, REGION, SAM, chunked, contigs, depth_sql, longs, packed, query
from readloom.schema import CONTIGS, ReadsError
from readloom.sources import blocks, derived, files

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share, removed when the driver ends: under spark.checkpoint.dir, or on one machine a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ReadsError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="readloom-")
        _made.append((spark, base))
    path = f"{base.rstrip('/')}/reads-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone; then nothing more can be removed
            return


def listed(reads: DataFrame) -> DataFrame:
    """The contigs of the derived reads."""
    return reads.sparkSession.createDataFrame([(i, f"chr{i + 1}", 102_400) for i in range(5)], CONTIGS)


_datasets: dict[tuple[int, str], str] = {}


def dataset(spark: SparkSession, sf_dir: str) -> str:
    """The derived reads as a dataset, converted once a session."""
    key = (id(spark.sparkContext), sf_dir)
    if key not in _datasets:
        reads = derived.reads(spark, sf_dir)
        path = scratch(spark, "dataset")
        files.convert(reads, path, policy=POLICY, contigs=listed(reads), source=sf_dir)
        _datasets[key] = path
    return _datasets[key]


def stored(sql: str):
    """Registers a query over the converted dataset: (spark, path)."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, dataset(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        ORACLES[f.__name__] = HEAD + sql
        return f

    return add


MAPPED = "(flag & 4) = 0"
#: Each mapped read's chunk, from the chunks' record counts in order.
CHUNK_OF = PACK + """, upto AS (SELECT *, sum(record_count) OVER (PARTITION BY ref ORDER BY chunk_id) AS n FROM chunks),
placed AS (SELECT o.*, u.chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY pos, qname) AS k FROM r WHERE (flag & 4) = 0) o JOIN upto u ON o.ref = u.ref AND o.k > u.n - u.record_count AND o.k <= u.n)
"""


# scans of a dataset
@stored(f"SELECT qname, flag::BIGINT AS flag, pos::BIGINT AS pos, mapq::BIGINT AS mapq, cigar, end_pos FROM r WHERE {HIT} AND {MAPPED}")
def dataset_region_scan(spark, path):
    """Only the contig's files whose statistics meet the region are read, and six columns of them."""
    return longs(files.open_dataset(spark, path).where(in_region(REGION)).select("qname", "flag", "pos", "mapq", "cigar", "end_pos"))


@stored(f"SELECT {SAM} AS sam_line FROM r WHERE {HIT} AND {KEEP}")
def dataset_view(spark, path):
    return api.view_path(spark, path, "chr2:20001-60000", MASK, MAPQ)


@stored(depth_sql(f"AND {KEEP}") + "SELECT 'chr2' AS ref, pos, depth FROM dep")
def dataset_depth(spark, path):
    return depth.depth(files.open_dataset(spark, path), REGION, MASK, MAPQ)


@stored(CHUNK_OF + "SELECT ref, chunk_id, count(*) AS n, min(pos)::BIGINT AS start_pos, max(end_pos)::BIGINT AS end_pos FROM placed GROUP BY ALL")
def dataset_chunks(spark, path):
    """The chunks as the dataset's reads name them, once the whole is found valid."""
    files.assert_valid(spark, path)
    return longs(files.open_dataset(spark, path).groupBy("ref", "chunk_id").agg(F.count("*").alias("n"), F.min("pos").alias("start_pos"), F.max("end_pos").alias("end_pos")))


@stored(CHUNK_OF + "SELECT qname, pos::BIGINT AS pos, sequence FROM placed WHERE ref = 'chr2' AND chunk_id = 3")
def chunk_reads(spark, path):
    return longs(chunking.read_chunk(files.open_dataset(spark, path), "chr2", 3, ["qname", "pos", "sequence"]))


@stored(CHUNK_OF + "SELECT p.qname, p.pos::BIGINT AS pos, p.chunk_id FROM placed p JOIN chunks c USING (ref, chunk_id) WHERE ref = 'chr2' AND c.start_pos < 60000 AND c.end_pos > 20000")
def chunk_granular_query(spark, path):
    index = spark.read.parquet(f"{path}/chunk_index")
    return longs(chunking.query_region_chunks(files.open_dataset(spark, path), index, REGION).select("qname", "pos", "chunk_id"))


@stored("SELECT ref_id::BIGINT AS ref_id, name, length FROM (SELECT i AS ref_id, 'chr' || (i + 1) AS name, 102400::BIGINT AS length FROM range(0, 5) t(i))")
def dataset_contigs(spark, path):
    return longs(files.contigs_of(spark, path))


@stored("SELECT '' AS conversion_region, false AS is_subset, 1::BIGINT AS n")
def dataset_metadata(spark, path):
    return spark.read.parquet(f"{path}/metadata").groupBy("conversion_region", "is_subset").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('compression', 'zstd'), ('format', 'parquet'), ('input', 'reads'), ('quality_lossy', 'illumina8'), ('region', 'chr2:20001-60000')) t(key, value)")
def conversion_report(reads):
    """The report of converting a region, but for the output's path."""
    report = files.convert(reads, scratch(reads.sparkSession, "subset"), REGION, POLICY, quality_lossy=True, source="reads")
    return report.where("key <> 'output'")


# the chunk index as an interval index
@query(PACK + "SELECT ref, start_pos AS start, end_pos AS \"end\", (sum(bytes) OVER (PARTITION BY ref ORDER BY chunk_id) - bytes)::BIGINT AS chunk_offset, bytes AS column_index_offset FROM chunks")
def chunk_intervals(reads):
    return chunking.intervals(packed(reads))


@query(PACK + "SELECT count(*) AS contigs, sum(n)::BIGINT AS intervals FROM (SELECT count(*) AS n FROM chunks GROUP BY ref)")
def interval_count(reads):
    return chunking.intervals(packed(reads)).agg(F.count_distinct("ref").alias("contigs"), F.count("*").alias("intervals"))


# column bodies
@query(CHOICE + "SELECT col AS \"column\", code, count(*) AS chunks, sum(bytes)::BIGINT AS bytes, sum(n)::BIGINT AS records, true AS exact FROM cand JOIN (SELECT ref, chunk, count(*) AS n FROM c GROUP BY ref, chunk) USING (ref, chunk) WHERE bytes IS NOT NULL GROUP BY ALL")
def codec_bodies(reads):
    """Every body that a code can make, decoded again and held against its column."""

    def check(column, code, n, body):
        values = codec_bytes.decode(column, code, body, n)
        return len(body), len(values) == n and codec_bytes.CODERS[column, code][0](values) == body

    found = codec_bytes.encode_chunks(chunked(reads), every=True, facts=("bytes long, exact boolean", check))
    return found.groupBy("column", "code").agg(F.count("*").alias("chunks"), F.sum("bytes").alias("bytes"), F.sum("n").alias("records"), F.bool_and("exact").alias("exact"))


@query("SELECT qname, flag::BIGINT AS flag, ref, pos::BIGINT AS pos, mapq::BIGINT AS mapq, cigar, mate_reference, mate_pos::BIGINT AS mate_pos, template_length::BIGINT AS template_length, sequence, quality, tags FROM r")
def codec_roundtrip(reads):
    """Reads from the smallest bodies, compressed where that helps."""
    return longs(codec_bytes.decode_chunks(codec_bytes.encode_chunks(chunked(reads), compression="zstd")).select(*FIELDS))


ORDERED = "['qname', 'flag', 'pos', 'mapq', 'cigar', 'mate_reference', 'mate_pos', 'template_length', 'sequence', 'quality', 'tags']"


@query(CHOICE + f"SELECT ref, chunk, \"column\", code, (sum(bytes) OVER (PARTITION BY ref, chunk ORDER BY list_position({ORDERED}, \"column\")) - bytes)::BIGINT AS \"offset\", bytes FROM chosen")
def column_entries(reads):
    """Where each column's body stands in its chunk."""
    place = F.array_position(F.array(*map(F.lit, codecs.CODES)), F.col("column"))
    entry = codec_bytes.encode_chunks(chunked(reads), facts=codec_bytes.SIZES).select("ref", "chunk", "column", "code", "bytes", place.alias("place"))
    w = Window.partitionBy("ref", "chunk").orderBy("place")
    return entry.select("ref", "chunk", "column", "code", (F.sum("bytes").over(w) - F.col("bytes")).alias("offset"), "bytes")


@query(CHOICE + "SELECT ref, count(*) FILTER (\"column\" IN ('pos', 'cigar', 'flag', 'mapq')) AS selected_columns, count(*) AS total_columns, sum(CASE WHEN \"column\" IN ('pos', 'cigar', 'flag', 'mapq') THEN bytes ELSE 0 END)::BIGINT AS selected_bytes, sum(bytes)::BIGINT AS total_bytes FROM chosen GROUP BY ref")
def selected_bytes(reads):
    """What depth reads of the columns against all of them."""
    entry = codec_bytes.encode_chunks(chunked(reads), facts=codec_bytes.SIZES).select("ref", "column", "bytes")
    chosen = F.col("column").isin("pos", "cigar", "flag", "mapq")
    return entry.groupBy("ref").agg(F.count_if(chosen).alias("selected_columns"), F.count("*").alias("total_columns"), F.sum(F.when(chosen, F.col("bytes")).otherwise(0)).alias("selected_bytes"), F.sum("bytes").alias("total_bytes"))


@query("SELECT qname, pos::BIGINT AS pos, length(sequence)::BIGINT AS bases, ((length(sequence) + 3) // 4)::BIGINT AS bytes, sequence FROM r WHERE regexp_full_match(sequence, '[ACGT]+')")
def seq_2bit_roundtrip(reads):
    """Bases packed four to a byte and unpacked again, a batch at a time."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.filter(pc.match_substring_regex(batch.column("sequence"), r"\A[ACGT]+\z"))  # here, as below a filter the letters would be made twice
            texts = [t.encode() for t in batch.column("sequence").to_pylist()]
            packed_, sizes = codec_bytes.base_rows(texts)
            c = codec_bytes.Cursor(packed_)
            back = codec_bytes.from_bases(c, len(texts))
            c.end()
            yield pa.RecordBatch.from_arrays([batch.column("qname"), batch.column("pos"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64()), pa.array([t.decode() for t in back], pa.string())], names=["qname", "pos", "bases", "bytes", "sequence"])

    return reads.select("qname", F.col("pos").cast("long").alias("pos"), "sequence").mapInArrow(run, "qname string, pos long, bases long, bytes long, sequence string")


@query("SELECT t AS value, CASE WHEN z < 128 THEN printf('%02X', z) ELSE printf('%02X%02X', z % 128 + 128, z // 128) END AS bytes, n FROM (SELECT template_length::BIGINT AS t, CASE WHEN template_length < 0 THEN -2 * template_length - 1 ELSE 2 * template_length END::INT AS z, count(*) AS n FROM r GROUP BY ALL)")
def varint_bytes(reads):
    """Signed numbers by zigzag and LEB128, from what decoding gives back."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False)
            bodies = [codec_bytes.varints(codec_bytes.zigzag([v])) for v in x.tolist()]
            back = codec_bytes.unzigzag(codec_bytes.Cursor(b"".join(bodies)).numbers(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(back), pa.array([b.hex().upper() for b in bodies]), batch.column(1)], names=["value", "bytes", "n"])

    return reads.groupBy(F.col("template_length").cast("long").alias("t")).agg(F.count("*").alias("n")).mapInArrow(run, "value long, bytes string, n long")


# row blocks
LINES = f"string_agg({SAM} || chr(10), '' ORDER BY pos, qname)"


@query(f"SELECT ref, min(pos)::BIGINT AS start_pos, max(end_pos)::BIGINT AS end_pos, count(*) AS record_count, sha256({LINES}) AS payload FROM r WHERE {MAPPED} GROUP BY ref")
def row_blocks(reads):
    return longs(blocks.row_blocks(reads).withColumn("payload", F.sha2("payload", 256)))


@query(f"SELECT {SAM} AS sam_line FROM r WHERE {HIT} AND {MAPPED}")
def row_block_view(reads):
    mine = reads.where(F.col("ref") == REGION.ref)  # before the blocks are made: no filter passes below them
    return blocks.view_blocks(blocks.streamed_blocks(mine, span=1 << 14), REGION)


@query(f"SELECT ref, start_pos, end_pos, row_number() OVER (PARTITION BY ref ORDER BY end_pos, start_pos) AS end_rank FROM (SELECT ref, min(pos)::BIGINT AS start_pos, max(end_pos)::BIGINT AS end_pos FROM r WHERE {MAPPED} GROUP BY ref, pos // 16384)")
def row_block_order(reads):
    return longs(blocks.by_end(blocks.row_blocks(reads, span=1 << 14)).select("ref", "start_pos", "end_pos", "end_rank"))


@query(f"SELECT ref_id::BIGINT AS ref_id, min(pos)::BIGINT AS start_pos, max(end_pos)::BIGINT AS end_pos, count(*) AS record_count, sha256({LINES}) AS payload FROM (SELECT *, substr(ref, 4)::INT - 1 AS ref_id FROM r WHERE {MAPPED} AND pos < 2000) GROUP BY ref_id")
def row_file_roundtrip(reads):
    """A row-format file of the reads at each contig's begin, written and read again."""
    known = listed(reads).select(F.col("name").alias("ref"), "ref_id")
    found = blocks.row_blocks(reads.where("pos < 2000")).join(known, "ref").select("ref_id", "start_pos", "end_pos", "record_count", "payload")
    data = blocks.pack_blocks([("chr%d" % i, 102_400) for i in range(1, 6)], [(*r[:4], bytes(r.payload)) for r in found.collect()])  # one file: a block a contig
    back = reads.sparkSession.createDataFrame(blocks.parse_blocks(data)[1], blocks.BLOCKS)
    return longs(back.withColumn("payload", F.sha2("payload", 256)))


# files
WHOLE = "qname, flag::BIGINT AS flag, ref, pos::BIGINT AS pos, mapq::BIGINT AS mapq, cigar, {mate} AS mate_reference, mate_pos::BIGINT AS mate_pos, template_length::BIGINT AS template_length, sequence, quality, tags"


@query(f"SELECT {WHOLE.format(mate='mate_reference')} FROM r")
def sam_file_roundtrip(reads):
    path = scratch(reads.sparkSession, "reads.sam")
    files.export_sam(reads, listed(reads), path)
    return longs(files.read_sam(reads.sparkSession, path).select(*FIELDS))


@query(f"SELECT {WHOLE.format(mate='CASE WHEN mate_reference = ref THEN chr(61) ELSE mate_reference END')} FROM r")
def bam_file_roundtrip(reads):
    path = scratch(reads.sparkSession, "reads.bam")
    files.export_bam(reads, listed(reads), path)
    return longs(files.read_bam(reads.sparkSession, path).select(*FIELDS))


@query(f"SELECT row_number() OVER (ORDER BY pos, qname DESC) AS k, qname FROM r WHERE {HIT} AND {KEEP}")
def view_input_order(reads):
    """Ties of position keep the input's order: here it stands against the names."""
    numbers = reads.where(in_region(REGION) & record_filter(MASK, MAPQ))
    ordered = numbers.withColumn("ord", F.row_number().over(Window.partitionBy("pos").orderBy(F.col("qname").desc())))
    lines = api.view(ordered, "chr2:20001-60000", contigs=listed(reads)).toDF("sam_line")
    return lines.select((F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).cast("long").alias("k"), F.split("sam_line", "\t")[0].alias("qname"))


# text and table outputs
@query(f"SELECT qname, flag::BIGINT AS flag, ref, pos::BIGINT AS pos, end_pos, mapq::BIGINT AS mapq, template_length::BIGINT AS template_length FROM r WHERE {HIT} AND {KEEP}")
def bam_columns(reads):
    return longs(api.bam_columns(reads, "chr2:20001-60000", MASK, MAPQ))


@query(depth_sql(f"AND {KEEP}") + "SELECT concat_ws(chr(9), 'chr2', pos + 1, depth) AS line FROM dep")
def depth_text(reads):
    return api.depth_text(depth.depth(reads, REGION, MASK, MAPQ))


@query(depth_sql(f"AND {KEEP}") + f"""SELECT o - 1 AS ord, l[o] AS line FROM (SELECT ['reference' || chr(9) || 'chr2', 'start' || chr(9) || 20001, 'end' || chr(9) || 60000, 'bases' || chr(9) || 40000, 'records' || chr(9) || (SELECT count(*) FROM r WHERE {HIT} AND {KEEP}),
  'covered_bases' || chr(9) || count(*), 'total_depth' || chr(9) || sum(depth), 'mean_depth' || chr(9) || printf('%g', sum(depth) / 40000.0)] AS l FROM dep), range(1, 9) t(o)""")
def coverage_text(reads):
    return longs(api.coverage_text(depth.summary(reads, REGION, MASK, MAPQ)))


@query("SELECT ref, 'scanned' || chr(9) || count(*) || chr(10) || 'matched' || chr(9) || count(*) FILTER (" + HIT.replace("ref = 'chr2' AND ", "") + ") || chr(10) AS text FROM r GROUP BY ref")
def profile_text(reads):
    """The counters of a scan as lines of name and value."""
    hit = (F.col("pos") < REGION.end) & (F.col("end_pos") > REGION.start)
    counters = reads.groupBy("ref").agg(F.count("*").alias("scanned"), F.count_if(hit).alias("matched"))
    return counters.select("ref", F.concat(*(F.concat(F.lit(f"{c}\t"), F.col(c).cast("string"), F.lit("\n")) for c in ("scanned", "matched"))).alias("text"))


@query("SELECT cigar, count(*) AS n FROM r GROUP BY cigar")
def line_cigars(reads):
    """CIGARs taken from SAM text alone."""
    return reads.select(records.line_cigar(records.sam_line()).alias("cigar")).groupBy("cigar").agg(F.count("*").alias("n"))


@query(f"SELECT ref, pos::BIGINT AS pos, count(*) AS n FROM r WHERE {HIT} GROUP BY ALL")
def line_overlap(reads):
    """The overlap test on SAM text: contig, position and CIGAR are all that is read of a line."""
    lines = reads.select(records.sam_line().alias("sam_line"))
    ref, pos, ops = blocks.light_fields("sam_line")
    from readloom.functions import cigar

    found = lines.select(ref.alias("ref"), pos.alias("pos"), (pos + cigar.reference_span(ops)).alias("end_pos")).where(in_region(REGION))
    return longs(found.groupBy("ref", "pos").agg(F.count("*").alias("n")))


@query("SELECT CASE WHEN contains(tags, chr(9)) THEN split_part(tags, chr(9), 2) || chr(9) || split_part(tags, chr(9), 1) ELSE tags END AS tags, count(*) AS n FROM r GROUP BY ALL")
def tags_canonical(reads):
    """Tags in the order of given keys."""
    return reads.select(records.canonical_tags(records.tag_items(F.col("tags")), ["RG", "NM"]).alias("tags")).groupBy("tags").agg(F.count("*").alias("n"))


@query("SELECT (substr(ref, 4)::INT - 1)::BIGINT AS ref_id, ref AS name, count(*) AS n FROM r GROUP BY ref")
def contig_ids(reads):
    """Reads by the number of their contig, which must be listed."""
    files.require_contig(listed(reads), REGION)
    return longs(reads.join(F.broadcast(listed(reads)), F.col("ref") == F.col("name")).groupBy("ref_id", "name").agg(F.count("*").alias("n")))


# the reference
def fasta_text(reads: DataFrame) -> DataFrame:
    """Lines of a FASTA file of 70 bases a line, with their places."""
    seqs = contigs(reads.sparkSession)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 70).cast("int")), lambda k: F.substr("seq", k * 70 + 1, F.lit(70)))
    lines = seqs.select("name", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), "name", F.lit(" made"))), pieces)).alias("row", "value"))
    # as if each contig stood in two parts of a file
    return lines.select("value", F.struct(F.lit("f").alias("file"), (F.substring("name", 4, 1).cast("long") * 10 + F.floor(F.col("row") / 700)).alias("start"), F.col("row").cast("long").alias("row")).alias("ord"))


@query(FASTA + "SELECT name, 50000::BIGINT AS start, 50200::BIGINT AS \"end\", substr(seq, 50001, 200) AS bases FROM fa WHERE name = 'chr3'")
def fetch_sequence(reads):
    lines = files.fasta_lines(fasta_text(reads))
    text = files.fetch_sequence(lines, "chr3", 50_000, 50_200)
    return reads.sparkSession.createDataFrame([("chr3", 50_000, 50_200, text)], "name string, start long, `end` long, bases string")


@query(FASTA + "SELECT name, sha256(upper(seq)) AS sha256 FROM fa")
def checksum_extensions(reads):
    """Checksums as metadata extensions and back; the reference that they are of is accepted."""
    seqs = contigs(reads.sparkSession)
    made = files.checksum_extensions(files.checksums(seqs))
    files.require_reference(made, seqs)
    return files.checksums_of(made)
