"""SAM, BAM, FASTA and index files as DataFrames; the columnar dataset that queries read."""

from __future__ import annotations

import gzip
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from readloom.functions import cigar, records
from readloom.functions.region import Region, in_region, flag_excludes
from readloom.operators import chunking
from readloom.schema import CONTIGS, READS, UNMAPPED, ReadsError

#: Letters of the BAM encodings of operations and bases, and widths of typed tags.
BAM_OPS, BAM_BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
TAG_WIDTHS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
SIDECAR_MAGIC = b"AXI1\0"


#: Where a record stands in its files: ties of position keep this order.
ORD = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()), T.StructField("row", T.LongType())])


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads with ``ord``, the place of their line."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return records.parse_sam(spark.read.text(path).select("value", place.alias("ord")), carry=("ord",))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """The contigs of the header, numbered in its order."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ")).collect()  # a line for each contig
    fields = [dict(x.split(":", 1) for x in r.value.split("\t")[1:]) for r in lines]
    return spark.createDataFrame([(i, f["SN"], int(f["LN"])) for i, f in enumerate(fields)], CONTIGS)


def _tags(data: bytes, at: int, end: int) -> str:
    out = []
    while at < end:
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            text, at = f"A:{chr(data[at])}", at + 1
        elif kind in "ZH":
            stop = data.index(0, at)
            text, at = f"{kind}:{data[at:stop].decode()}", stop + 1
        elif kind == "B":
            item, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{TAG_WIDTHS[item][1]}", data, at + 5)
            text, at = f"B:{item}" + "".join(f",{v:g}" if item == "f" else f",{v}" for v in values), at + 5 + n * struct.calcsize(TAG_WIDTHS[item])
        else:
            value = struct.unpack_from(TAG_WIDTHS[kind], data, at)[0]
            text, at = (f"f:{value:g}" if kind == "f" else f"i:{value}"), at + struct.calcsize(TAG_WIDTHS[kind])
        out.append(f"{key}:{text}")
    return "\t".join(out)


class Bgzf:
    """Reads a BGZF file from a virtual offset (place of a block, and place in its plain bytes)."""

    def __init__(self, file: BinaryIO, offset: int = 0):
        self.file, self.at, self.next, self.plain, self.used = file, 0, offset >> 16, b"", 0
        file.seek(self.next)
        if offset & 0xFFFF:
            self.block()
            self.used = offset & 0xFFFF

    def block(self) -> bool:
        head = self.file.read(12)
        if not head:
            return False
        if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
            raise ReadsError("not a BGZF block")
        extra = self.file.read(struct.unpack("<H", head[10:])[0])
        at = 0
        while extra[at : at + 2] != b"BC":
            if at >= len(extra):
                raise ReadsError("not a BGZF block")
            at += 4 + struct.unpack_from("<H", extra, at + 2)[0]
        size = struct.unpack_from("<H", extra, at + 4)[0] + 1
        body = self.file.read(size - 12 - len(extra))
        if len(body) < size - 12 - len(extra):
            raise ReadsError("truncated BAM file")
        self.at, self.next, self.plain, self.used = self.next, self.next + size, zlib.decompress(body[:-8], -15), 0
        return True

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.used == len(self.plain) and not self.block():
                break
            part = self.plain[self.used : self.used + n]
            out.append(part)
            self.used += len(part)
            n -= len(part)
        return b"".join(out)

    def tell(self) -> int:
        return self.next << 16 if self.used == len(self.plain) else self.at << 16 | self.used


def decode_bam(file: BinaryIO) -> tuple[list[tuple[str, int]], Iterator[tuple]]:
    """Contigs, and rows of ``READS``, of a BAM file that is read as a stream (BGZF blocks are gzip members)."""
    plain = gzip.GzipFile(fileobj=file)
    contigs = bam_header(plain)
    return contigs, bam_rows(plain, contigs)


def _taker(plain) -> Callable[[int], bytes]:
    def take(n: int) -> bytes:
        data = plain.read(n)
        if len(data) < n:
            raise ReadsError("truncated BAM file")
        return data

    return take


def bam_header(plain) -> list[tuple[str, int]]:
    take = _taker(plain)
    number = lambda: struct.unpack("<i", take(4))[0]
    if plain.read(4) != b"BAM\x01":
        raise ReadsError("invalid BAM magic")
    take(number())
    return [(take(number())[:-1].decode(), number()) for _ in range(number())]


def bam_rows(plain, contigs: list[tuple[str, int]], end: int | None = None) -> Iterator[tuple]:
    """Rows of ``READS``, of a ``Bgzf`` up to the virtual offset ``end``."""
    take = _taker(plain)
    name = lambda i: contigs[i][0] if i >= 0 else "*"

    def rows() -> Iterator[tuple]:
        while (end is None or plain.tell() < end) and (head := plain.read(4)):
            if len(head) < 4:
                raise ReadsError("truncated BAM record")
            data = take(struct.unpack("<i", head)[0])
            ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mate, mate_pos, length = struct.unpack_from("<iiBBHHHiiii", data)
            p = 32
            qname, p = data[p : p + l_name - 1].decode(), p + l_name
            ops, p = struct.unpack_from(f"<{n_ops}I", data, p), p + 4 * n_ops
            packed, p = data[p : p + (l_seq + 1) // 2], p + (l_seq + 1) // 2
            seq = "".join(BAM_BASES[b >> 4] + BAM_BASES[b & 15] for b in packed)[:l_seq] or "*"
            qual, p = data[p : p + l_seq], p + l_seq
            text = "*" if not qual or qual[0] == 0xFF else bytes(q + 33 for q in qual).decode("latin-1")
            tags = _tags(data, p, len(data))
            if n_ops == 2 and ops[0] == l_seq << 4 | 4 and "CG:B:I," in tags:  # more operations than the record can count
                items = tags.split("\t")
                whole = next(t for t in items if t.startswith("CG:B:I,"))
                ops, tags = [int(x) for x in whole[7:].split(",")], "\t".join(t for t in items if t is not whole)
            mate_name = "*" if mate < 0 else "=" if mate == ref else name(mate)
            yield qname, flag, name(ref), pos, mapq, "".join(f"{o >> 4}{BAM_OPS[o & 15]}" for o in ops) or "*", mate_name, mate_pos, length, seq, text, tags

    return rows()


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system: a bare one is of the cluster's default."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).makeQualified(p).toString()


def _first_file(spark: SparkSession, path: str) -> str:
    found = spark.read.format("binaryFile").load(path).select("path").head()
    if found is None:
        raise ReadsError(f"no file at {path}")
    return found[0]


def file_head(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    """The first bytes of the first file under a path."""
    store, name = _store(_first_file(spark, path))
    with store.open_input_stream(name, compression=None) as file:
        return file.read(size)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of BAM files, a file to a task, as streams of bounded memory: for ingest; queries run on the dataset that ``convert`` writes."""
    made = T.StructType([*READS.fields, T.StructField("ord", ORD)])
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, name = _store(uri)
                at = 0
                with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as file:
                    rows = decode_bam(file)[1]
                    while held := [(*r, {"file": uri, "start": 0, "row": at + i}) for i, r in enumerate(islice(rows, 10_000))]:
                        at += len(held)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, made)


def read_bam_ranges(spark: SparkSession, path: str, contigs: list[tuple[str, int]], ranges: list[tuple[int, int | None]]) -> DataFrame:
    """Reads of one BAM file between virtual offsets, a range to a task; ``ord`` goes by the file."""
    made = T.StructType([*READS.fields, T.StructField("ord", ORD)])
    schema, uri = to_arrow_schema(made), _first_file(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name = _store(uri)
        for batch in batches:
            for begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(name) as file:
                    rows, at = bam_rows(Bgzf(file, begin), contigs, end), 0
                    while held := [(*r, {"file": uri, "start": begin, "row": at + i}) for i, r in enumerate(islice(rows, 10_000))]:
                        at += len(held)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    table = spark.createDataFrame(ranges, "begin long, end long")
    return table.repartitionByRange(max(1, len(ranges)), "begin").mapInArrow(run, made)


def bam_start(spark: SparkSession, path: str) -> tuple[list[tuple[str, int]], int]:
    """Contigs of a BAM file, and the virtual offset of its first record."""
    store, name = _store(_first_file(spark, path))
    with store.open_input_file(name) as file:
        plain = Bgzf(file)
        return bam_header(plain), plain.tell()


def read_bam_split(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """All reads of one BAM file by many tasks: cut where the index beside it says that records begin."""
    found = find_bam_index(spark, path)
    if found is None:
        raise ReadsError(f"no index beside {path}")
    contigs, first = bam_start(spark, path)
    cuts = [first]
    for begin in sorted(c[2] for c in parse_index(file_bytes(spark, found)).chunks):
        if (begin >> 16) - (cuts[-1] >> 16) >= split_bytes:
            cuts.append(begin)
    return read_bam_ranges(spark, path, contigs, list(zip(cuts, [*cuts[1:], None], strict=True)))


def read_bam_region(spark: SparkSession, path: str, region: Region) -> DataFrame:
    """Reads of a BAM file that overlap a region, with ``end_pos``: only what the index beside it names is read.

    Chunks of the bins that meet the region are joined where they touch, each range to a task. No index, and a contig that
    the header lacks, are errors.
    """
    found = find_bam_index(spark, path)
    if found is None:
        raise ReadsError(f"no index beside {path}")
    contigs, _ = bam_start(spark, path)
    names = [c[0] for c in contigs]
    if region.ref not in names:
        raise ReadsError(f"unknown contig: {region.ref}")
    index = parse_index(file_bytes(spark, found))
    ref, bins = names.index(region.ref), set()
    for level in range(index.depth + 1):
        shift, base = index.min_shift + 3 * (index.depth - level), records.level_offset(level)
        bins |= set(range(base + (region.start >> shift), base + (region.end - 1 >> shift) + 1))
    least = max((at for r, i, at in index.linear if r == ref and i <= region.start >> 14), default=0)  # no record before it reaches the region
    ranges: list[list[int]] = []
    for begin, end in sorted((b, e) for r, k, b, e in index.chunks if r == ref and k in bins and e > least):
        if ranges and begin <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], end)
        else:
            ranges.append([begin, end])
    reads = read_bam_ranges(spark, path, contigs, [tuple(r) for r in ranges])
    return reads.withColumn("end_pos", F.col("pos") + cigar.reference_span(F.col("cigar"))).where(in_region(region))


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """The contigs of the header, numbered in its order."""
    store, name = _store(_first_file(spark, path))
    with store.open_input_stream(name, compression=None) as file:
        contigs = decode_bam(file)[0]
    return spark.createDataFrame([(i, *c) for i, c in enumerate(contigs)], CONTIGS)


def contigs_of(spark: SparkSession, path: str) -> DataFrame:
    """The contigs of a SAM or BAM file or a dataset."""
    kind = sniff_path(spark, path)
    return bam_contigs(spark, path) if kind == "BAM" else sam_contigs(spark, path) if kind == "SAM" else spark.read.parquet(f"{path}/contigs")


def require_contig(contigs: DataFrame, region: Region) -> int:
    """The contig's number; an unknown contig is an error."""
    row = contigs.where(F.col("name") == region.ref).head()
    if row is None:
        raise ReadsError(f"unknown contig: {region.ref}")
    return row.ref_id


def find_bam_index(spark: SparkSession, path: str) -> str | None:
    """The index beside a BAM file: name.bam.csi, name.bam.bai, name.csi, name.bai, the first there is."""
    folder, dot, _ = path.rpartition(".")
    names = [f"{path}.csi", f"{path}.bai", *([f"{folder}.csi", f"{folder}.bai"] if dot and "/" not in path[len(folder) :] else [])]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return next((n for n in names if at(n).getFileSystem(conf).exists(at(n))), None)


def file_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def index_bam(spark: SparkSession, path: str, out: str) -> int:
    """Writes the interval index of the index beside a BAM file to ``out``; returns the number of intervals."""
    found = find_bam_index(spark, path)
    if found is None:
        raise ReadsError(f"no index beside {path}")
    index = parse_index(file_bytes(spark, found))
    rows = [tuple(r) for r in project_index(spark, index).collect()]  # as the index itself, which the driver holds
    store, name = _store(qualified(spark, out))
    with store.open_output_stream(name, compression=None) as file:
        file.write(pack_sidecar(rows, index.n_ref))
    return len(rows)


def _packed_tags(text: str) -> bytes:
    out = []
    for item in text.split("\t") if text else ():
        key, kind, value = item[:2].encode(), item[3], item[5:]
        if kind == "i":
            out.append(key + (b"i" + struct.pack("<i", int(value)) if int(value) < 2**31 else b"I" + struct.pack("<I", int(value))))
        elif kind == "f":
            out.append(key + b"f" + struct.pack("<f", float(value)))
        elif kind == "A":
            out.append(key + b"A" + value.encode())
        elif kind in "ZH":
            out.append(key + kind.encode() + value.encode() + b"\0")
        elif kind == "B":
            sub, *values = value.split(",")
            out.append(key + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{TAG_WIDTHS[sub][1]}", len(values), *(map(float if sub == "f" else int, values))))
        else:
            raise ReadsError(f"unknown SAM tag type {kind}")
    return b"".join(out)


def encode_bam(row: dict, ids: dict[str, int]) -> bytes:
    """The BAM record of a row of ``READS`` with ``end_pos`` and ``bin``."""
    if row["ref"] not in ids:
        raise ReadsError(f"contig is not in the header: {row['ref']}")
    ref, mate = ids[row["ref"]], row["mate_reference"]
    if mate not in ids and mate != "=":
        raise ReadsError(f"a mate's contig is not in the header: {mate}")
    mate_id = ref if mate == "=" else ids[mate]
    name = row["qname"].encode() + b"\0"
    if len(name) > 255:
        raise ReadsError("read name is too long for BAM")
    text, tags = "" if row["cigar"] == "*" else row["cigar"], _packed_tags(row["tags"])
    ops = [int(n) << 4 | BAM_OPS.index(op) for n, op in re.findall(cigar.PART, text)]
    seq = "" if row["sequence"] == "*" else row["sequence"].upper()
    if len(ops) > 0xFFFF:  # counts are 16 bits wide: a stand-in of two operations, all of them in a tag
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, row["end_pos"] - row["pos"] << 4 | 3]
    half = [max(0, BAM_BASES.find(c)) if c in BAM_BASES else 15 for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(half[::2], half[1::2], strict=True))
    qual = b"\xff" * len(seq) if row["quality"] == "*" else bytes(ord(c) - 33 for c in row["quality"])
    if len(qual) != len(seq):
        raise ReadsError("sequence and quality differ in length")
    head = struct.pack("<iiBBHHHiiii", ref, row["pos"], len(name), row["mapq"], row["bin"] & 0xFFFF, len(ops), row["flag"], len(seq), mate_id, row["mate_pos"], row["template_length"])
    body = head + name + struct.pack(f"<{len(ops)}I", *ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def bgzf_block(plain: bytes) -> bytes:
    """A gzip member that states its own size; that of no bytes marks the end of a file."""
    tool = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = tool.compress(plain) + tool.flush()
    head = struct.pack("<4BIBBH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(data) + 25)
    return head + data + struct.pack("<II", zlib.crc32(plain), len(plain))


def export_bam(reads: DataFrame, contigs: DataFrame, path: str) -> int:
    """BAM files in coordinate order under ``path``, each whole, one for a range of positions; returns the number of records.

    ``reads`` has ``end_pos``; ``contigs`` is the header's list. Reads without a contig come last. A file gets its name once
    it is complete, so a repeated task leaves no damaged one.
    """
    listed = contigs.orderBy("ref_id").collect()  # the header: a row for each contig
    ids = {r.name: i for i, r in enumerate(listed)} | {"*": -1}
    text = ("@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{r.name}\tLN:{r.length}\n" for r in listed)).encode()
    header = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(listed))
    header += b"".join(struct.pack("<i", len(r.name.encode()) + 1) + r.name.encode() + struct.pack("<xi", r.length) for r in listed)
    uri = qualified(reads.sparkSession, path)
    names = contigs.select(F.col("name").alias("ref"), F.col("ref_id").alias("_rl_ref"))
    order = [F.col("_rl_ref").asc_nulls_last(), F.col("pos"), F.col("ord" if "ord" in reads.columns else "qname"), F.col("flag")]
    ready = reads.join(names, "ref", "left").withColumn("bin", records.bin_of(F.col("pos"), F.greatest("end_pos", F.col("pos") + 1)))
    ordered = ready.repartitionByRange(*order).sortWithinPartitions(*order).select(*READS.fieldNames(), "end_pos", "bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(uri)
        store.create_dir(folder, recursive=True)
        part = f"part-{TaskContext.get().partitionId():05d}"
        n, held, size = 0, f"{folder}/_{part}-{uuid.uuid4().hex}", 0xFF00
        with store.open_output_stream(held, compression=None) as out:
            waiting = bytearray(header)
            for batch in batches:
                for row in batch.to_pylist():
                    waiting += encode_bam(row, ids)
                    n += 1
                    while len(waiting) >= size:
                        out.write(bgzf_block(bytes(waiting[:size])))
                        del waiting[:size]
            if waiting:
                out.write(bgzf_block(bytes(waiting)))
            out.write(bgzf_block(b""))
        store.move(held, f"{folder}/{part}.bam")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return ordered.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def fasta_lines(lines: DataFrame) -> DataFrame:
    """(name, start, bases) of each line of sequence: where it begins in its contig. ``lines`` has value and ``ord`` (file, start, row).

    Headers, a row for each contig, go to the driver; lines are placed by sums within a part of the file, then over the parts,
    so no task holds a contig.
    """
    place = F.struct("ord.file", "ord.start", "ord.row")
    heads = sorted(((*r.at, r.name) for r in lines.where(F.col("value").startswith(">")).select(place.alias("at"), F.regexp_extract("value", r"^>(\S+)", 1).alias("name")).collect()))
    spans = [(i, *h, *(heads[i + 1][:3] if i + 1 < len(heads) else (None, None, None))) for i, h in enumerate(heads)]
    table = lines.sparkSession.createDataFrame(spans, "contig int, f string, s long, r long, name string, f2 string, s2 long, r2 long")
    low, high = F.struct(F.col("f").alias("file"), F.col("s").alias("start"), F.col("r").alias("row")), F.struct(F.col("f2").alias("file"), F.col("s2").alias("start"), F.col("r2").alias("row"))
    body = lines.where(~F.col("value").startswith(">")).select("ord", F.regexp_replace("value", r"\s", "").alias("bases"))
    met = body.join(F.broadcast(table.withColumn("low", low).withColumn("high", high)), (F.col("ord") > F.col("low")) & (F.col("f2").isNull() | (F.col("ord") < F.col("high"))))
    part = ["contig", "ord.file", "ord.start"]
    sizes = met.groupBy("contig", "name", F.col("ord.file").alias("file"), F.col("ord.start").alias("part")).agg(F.sum(F.length("bases")).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("contig").orderBy("file", "part")) - F.col("size")).select(F.col("contig").alias("_c"), F.col("file").alias("_f"), F.col("part").alias("_p"), "before")
    inside = F.sum(F.length("bases")).over(Window.partitionBy(*part).orderBy("ord.row")) - F.length("bases")
    placed = met.withColumn("inside", inside).join(before, (F.col("contig") == F.col("_c")) & (F.col("ord.file") == F.col("_f")) & (F.col("ord.start") == F.col("_p")))
    return placed.select("name", (F.col("before") + F.col("inside")).alias("start"), "bases")


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return fasta_lines(spark.read.text(path).select("value", place.alias("ord")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of each contig: a contig is one value here, so for whole genomes use the lines."""
    parts = F.array_sort(F.collect_list(F.struct("start", "bases")))
    return read_fasta_lines(spark, path).groupBy("name").agg(F.array_join(F.transform(parts, lambda p: p["bases"]), "").alias("seq"))


def fetch_sequence(lines: DataFrame, name: str, start: int, end: int) -> str:
    """Bases [start, end) of a contig, from the lines that hold them; an unknown contig or a place outside it is an error."""
    mine = lines.where(F.col("name") == name)
    rows = mine.where((F.col("start") < end) & (F.col("start") + F.length("bases") > start)).orderBy("start").collect()  # as many bases as are asked for
    if not rows and mine.isEmpty():
        raise ReadsError(f"unknown contig: {name}")
    text = "".join(r.bases for r in rows)
    if not 0 <= start < end or not rows or len(text) < end - rows[0].start:
        raise ReadsError("sequence range is outside the contig")
    return text[start - rows[0].start : end - rows[0].start]


def checksums(contigs: DataFrame) -> DataFrame:
    return contigs.select("name", F.length("seq").cast("long").alias("length"), F.sha2(F.upper("seq"), 256).alias("sha256"))


def validate_reference(expected: DataFrame, contigs: DataFrame) -> None:
    """An error that names the first contig whose checksum differs; contigs unknown to either side are skipped."""
    found = checksums(contigs).withColumnRenamed("sha256", "actual").drop("length")
    bad = expected.join(found, "name").where("sha256 <> actual").orderBy("name").select("name").head()
    if bad:
        raise ReadsError(f"reference checksum mismatch for {bad.name}")


class _Bytes:
    def __init__(self, data: bytes, what: str):
        self.data, self.at, self.what = data, 0, what

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise ReadsError(f"truncated {self.what} file")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out

    def count(self, label: str) -> int:
        (n,) = self.take("<i")
        if n < 0:
            raise ReadsError(f"negative {self.what} {label}")
        return n


@dataclass
class BinIndex:
    """Rows (ref_id, bin_id, begin, end) of a BAI or CSI index, and what stands beside them."""

    min_shift: int
    depth: int
    n_ref: int
    chunks: list[tuple[int, int, int, int]]
    linear: list[tuple[int, int, int]]
    unplaced: int | None


def parse_index(data: bytes) -> BinIndex:
    """BAI, or CSI plain or compressed."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    kind = {b"BAI\x01": "BAI", b"CSI\x01": "CSI"}.get(data[:4])
    if not kind:
        raise ReadsError("invalid BAM index magic")
    r = _Bytes(data, kind)
    r.take("<4s")
    min_shift, depth = (14, 5) if kind == "BAI" else (r.count("min_shift"), r.count("depth"))
    if kind == "CSI":
        r.take(f"<{r.count('aux length')}s")
    n_ref, chunks, linear = r.count("reference count"), [], []
    for ref in range(n_ref):
        for _ in range(r.count("bin count")):
            (bin_id,) = r.take("<I") if kind == "BAI" else r.take("<IQ")[:1]
            chunks += [(ref, bin_id, *r.take("<QQ")) for _ in range(r.count("chunk count"))]
        if kind == "BAI":
            linear += [(ref, i, *r.take("<Q")) for i in range(r.count("linear index interval count"))]
    unplaced = r.take("<Q")[0] if r.at < len(data) else None
    if r.at != len(data):
        raise ReadsError(f"unexpected trailing bytes in {kind} file")
    return BinIndex(min_shift, depth, n_ref, chunks, linear, unplaced)


INTERVALS = "ref_id int, start long, end long, chunk_offset long, column_index_offset long"


def project_index(spark: SparkSession, index: BinIndex) -> DataFrame:
    """``INTERVALS`` of the regular bins, sorted."""
    bad = next((c for c in index.chunks if c[2] >= c[3]), None)
    if bad:
        raise ReadsError("BAM index chunk requires begin < end")
    chunks = spark.createDataFrame(index.chunks, "ref_id int, bin_id long, begin long, end long")
    start, end = records.bin_interval(F.col("bin_id"), index.min_shift, index.depth)
    regular = chunks.where(F.col("bin_id") != records.metadata_bin(index.depth))
    return regular.select("ref_id", start.alias("start"), end.alias("end"), F.col("begin").alias("chunk_offset"), F.col("end").alias("column_index_offset")).orderBy("ref_id", "start", "end", "chunk_offset")


def pack_sidecar(rows: list[tuple[int, int, int, int, int]], n_ref: int) -> bytes:
    out = SIDECAR_MAGIC + struct.pack("<I", n_ref)
    for ref in range(n_ref):
        mine = sorted(r[1:] for r in rows if r[0] == ref)
        if any(s >= e for s, e, *_ in mine):
            raise ReadsError("index interval requires start < end")
        out += struct.pack("<I", len(mine)) + b"".join(struct.pack("<IIQQ", *r) for r in mine)
    return out + struct.pack("<I", zlib.crc32(out))


def parse_sidecar(data: bytes) -> list[tuple[int, int, int, int, int]]:
    if len(data) < len(SIDECAR_MAGIC) + 8:
        raise ReadsError("truncated index file")
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ReadsError("index CRC mismatch")
    r = _Bytes(data[:-4], "index")
    if r.take("<5s")[0] != SIDECAR_MAGIC:
        raise ReadsError("invalid index magic")
    out = [(ref, *r.take("<IIQQ")) for ref in range(r.take("<I")[0]) for _ in range(r.take("<I")[0])]
    if r.at != len(r.data):
        raise ReadsError("unexpected trailing bytes in index file")
    return sorted(out)


#: Numbers of the metadata's extensions.
CHECKSUM_KEY, REFERENCE_KEY = 1, 2
EXTENSIONS = "key_id int, flags int, value binary"


def checksum_extensions(sums: DataFrame) -> DataFrame:
    """``EXTENSIONS`` of checksums (name, sha256): the name and the 32 bytes, required of readers."""
    name = F.col("name").cast("binary")
    return sums.select(F.lit(CHECKSUM_KEY).alias("key_id"), F.lit(1).alias("flags"), F.concat(F.unhex(F.lpad(F.hex(F.octet_length(name)), 4, "0")), name, F.unhex("sha256")).alias("value"))


def checksums_of(extensions: DataFrame) -> DataFrame:
    """(name, sha256) of the checksum extensions; an unknown extension that is required is an error."""
    size = F.conv(F.hex(F.substring("value", 1, 2)), 16, 10).cast("int")
    known = F.col("key_id").isin(CHECKSUM_KEY, REFERENCE_KEY)
    sane = extensions.where(F.when(known | (F.col("flags") == 0), known).otherwise(F.raise_error(F.lit("unknown required metadata extension"))))
    body = sane.where(F.col("key_id") == CHECKSUM_KEY)
    return body.select(F.substr("value", F.lit(3), size).cast("string").alias("name"), F.lower(F.hex(F.substr("value", size + 3))).alias("sha256"))


def require_reference(extensions: DataFrame, contigs: DataFrame | None) -> None:
    """Data coded against a reference needs one, and the right one."""
    sums = checksums_of(extensions)
    if contigs is None:
        if not sums.isEmpty():
            raise ReadsError("a reference is required to read this data")
        return
    validate_reference(sums, contigs)


def convert(reads: DataFrame, path: str, region: Region | None = None, policy: chunking.Policy = chunking.Policy(), compression: str = "zstd", quality_lossy: bool = False, contigs: DataFrame | None = None, source: str = "", reference: DataFrame | None = None) -> DataFrame:
    """Writes the dataset: reads by contig and position with ``end_pos`` and ``chunk_id``, the chunk index, contigs and
    metadata (with the checksums of a ``reference``); returns the report, a row (key, value) for each setting.

    Mapped records with a position are kept; ties of position keep their input order where ``ord`` tells it. Range-sorting by contig and position spreads a large contig over many files, whose statistics let scans skip them.
    """
    out = reads.withColumn("end_pos", F.col("pos") + cigar.reference_span(F.col("cigar")))
    out = out.where(flag_excludes(UNMAPPED) & (F.col("pos") >= 0))
    if region:
        out = out.where(in_region(region))
    if quality_lossy:
        out = out.withColumn("quality", records.bin_quality(F.col("quality")))
    spark, tie = reads.sparkSession, "ord" if "ord" in reads.columns else "qname"
    chunking.pack(out, policy, ("pos", tie), first=tie).write.parquet(f"{path}/chunk_index")
    placed = chunking.assign(out, spark.read.parquet(f"{path}/chunk_index"), tie)  # in ranges, sorted
    placed.write.partitionBy("ref").option("compression", compression).parquet(f"{path}/reads")
    if contigs is None:
        found = spark.read.parquet(f"{path}/chunk_index").groupBy("ref").agg(F.max("end_pos").alias("length")).orderBy("ref").collect()  # a row for each contig
        contigs = spark.createDataFrame([(i, r.ref, r.length) for i, r in enumerate(found)], CONTIGS)
    contigs.write.parquet(f"{path}/contigs")
    text = f"{region.ref}:{region.start + 1}-{region.end}" if region else ""
    spark.createDataFrame([(source, text, region is not None)], "source_path string, conversion_region string, is_subset boolean").write.parquet(f"{path}/metadata")
    extensions = checksum_extensions(checksums(reference)) if reference is not None else spark.createDataFrame([], EXTENSIONS)
    extensions.write.parquet(f"{path}/extensions")
    rows = [("input", source), ("output", path), *([("region", text)] if region else []), ("format", "parquet"), ("quality_lossy", "illumina8" if quality_lossy else "none"), ("compression", compression)]
    return spark.createDataFrame(rows, "key string, value string")


def assert_valid(spark: SparkSession, path: str) -> None:
    """An error where a dataset's reads and chunk index don't fit: bounds, counts, order of chunks, contigs."""
    index, reads = spark.read.parquet(f"{path}/chunk_index"), open_dataset(spark, path)
    have = reads.groupBy("ref", "chunk_id").agg(F.min("pos").cast("long").alias("a"), F.max("end_pos").cast("long").alias("b"), F.count("*").alias("n"))
    same = (F.col("a") == F.col("start_pos")) & (F.col("b") == F.col("end_pos")) & (F.col("n") == F.col("record_count"))
    if not index.join(have, ["ref", "chunk_id"], "full").where(~F.coalesce(same, F.lit(False))).isEmpty():
        raise ReadsError("the chunk index doesn't fit the reads")
    w = Window.partitionBy("ref").orderBy("chunk_id")
    if not index.withColumn("k", F.row_number().over(w) - 1).withColumn("p", F.lag("start_pos").over(w)).where("k <> chunk_id OR p > start_pos OR start_pos < 0 OR start_pos >= end_pos").isEmpty():
        raise ReadsError("chunks are out of order")
    if not index.join(spark.read.parquet(f"{path}/contigs"), F.col("ref") == F.col("name"), "left_anti").isEmpty():
        raise ReadsError("a chunk's contig is not listed")


def open_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/reads")


def sniff(head: bytes) -> str:
    """The format that a file's first bytes show: BAM (compressed, with its magic inside), ROWS (the block file), PARQUET or SAM text."""
    if head[:4] == b"CRAM":
        raise ReadsError("CRAM needs an outside decoder: convert it to SAM or BAM first")
    if head[:2] == b"\x1f\x8b":
        if zlib.decompressobj(31).decompress(head, 4) == b"BAM\x01":
            return "BAM"
        raise ReadsError("a compressed file that is not a BAM file")
    return {b"AXF0": "ROWS", b"PAR1": "PARQUET"}.get(head[:4], "SAM")


def sniff_path(spark: SparkSession, path: str) -> str:
    """The format of a file by its content, DATASET for a folder that ``convert`` wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return "DATASET" if store.exists(at(path, "reads")) else sniff(file_head(spark, path))


def export_sam(reads: DataFrame, contigs: DataFrame, path: str) -> None:
    """SAM text in coordinate order, header first."""
    tie = reads.schema["ord" if "ord" in reads.columns else "qname"].dataType
    header = contigs.select(F.lit(0).alias("k"), F.col("ref_id").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(None).cast(tie).alias("c"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    top = reads.sparkSession.createDataFrame([(-1, 0, 0, None, "@HD\tVN:1.6\tSO:coordinate")], f"k int, a long, b long, c {tie.simpleString()}, value string")
    names = contigs.select(F.col("name").alias("ref"), F.col("ref_id").cast("long").alias("a"))
    body = reads.join(names, "ref", "left").withColumn("a", F.when(F.col("a").isNotNull() | (F.col("ref") == "*"), F.col("a")).otherwise(F.raise_error(F.concat(F.lit("a read on a contig that the header lacks: "), F.coalesce("ref", F.lit("null"))))))
    body = body.select(F.lit(1).alias("k"), "a", F.col("pos").cast("long").alias("b"), F.col("ord" if "ord" in reads.columns else "qname").alias("c"), records.sam_line().alias("value"))
    top.unionByName(header).unionByName(body).orderBy("k", F.col("a").asc_nulls_last(), "b", "c").select("value").write.text(path)
