import gzip
import struct
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F

from readloom import api
from readloom.functions import cigar, records
from readloom.functions.region import Region, parse_region
from readloom.operators import chunking, codec_bytes, refdelta
from readloom.schema import ReadsError
from readloom.sources import blocks, files

SAM = """@HD\tVN:1.6\tSO:coordinate
@SQ\tSN:chrToy\tLN:1000
read001\t0\tchrToy\t101\t60\t10M\t*\t0\t0\tACGTACGTAA\tFFFFFFFFFF\tNM:i:0
read002\t16\tchrToy\t151\t50\t5M1I4M\t*\t0\t0\tTTTTACGGGA\tFFFFFFFFFF\tNM:i:1
read003\t4\t*\t0\t0\t*\t*\t0\t0\tGATTACA\tFFFFFFF
"""


@pytest.fixture
def toy(spark, tmp_path):
    (tmp_path / "toy.sam").write_text(SAM)
    return api.open_reads(spark, str(tmp_path / "toy.sam"))


def test_view_gives_the_lines(toy):
    assert [r.sam_line for r in api.view(toy, "chrToy:1-250").collect()] == SAM.splitlines()[2:4]
    assert [r.sam_line[:7] for r in api.view(toy, "chrToy:1-250", flag_exclude=16).collect()] == ["read001"]
    assert [r.sam_line[:7] for r in api.view(toy, "chrToy:1-250", min_mapq=55).collect()] == ["read001"]


def test_depth_and_summary(toy):
    got = [(r.pos + 1, r.depth) for r in api.pileup(toy, "chrToy:101-160").collect()]
    assert got == [(p, 1) for p in [*range(101, 111), *range(151, 160)]]
    every = api.pileup(toy, "chrToy:101-160", all_positions=True).collect()
    assert len(every) == 60 and every[-1].depth == 0
    row = api.coverage(toy, "chrToy:101-160").first()
    assert (row.bases, row.records, row.covered_bases, row.total_depth) == (60, 2, 19, 19)


def test_stats_text(toy):
    assert api.stats_tsv(toy) == ["metric\tvalue", "records.total\t3", "records.mapped\t2", "records.unmapped\t1", "mapq.0\t1", "mapq.50\t1", "mapq.60\t1", "flag.0\t1", "flag.4\t1", "flag.16\t1"]


@pytest.mark.parametrize(("text", "error"), [("chr1", "ref:start-end"), ("c:0-5", "start must be positive"), ("c:5-4", "start must be <= end"), ("c:x-4", "invalid start"), ("c:1-99999999999", "end is too large")])
def test_bad_regions(text, error):
    with pytest.raises(ReadsError, match=error):
        parse_region(text)
    assert parse_region("chr1:1-10") == Region("chr1", 0, 10)


def model(pos, text):
    at, blocks, n = pos, [], ""
    for c in text:
        if c.isdigit():
            n += c
            continue
        if c in "M=X":
            blocks.append((at, at + int(n)))
        at += int(n) * (c in "MDN=X")
        n = ""
    return max(1, at - pos), blocks


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.lists(st.tuples(st.integers(1, 50), st.sampled_from("MIDNSHP=X")), min_size=1, max_size=8)), min_size=1, max_size=20))
def test_cigar_model(spark, rows):
    data = [(p, "".join(f"{n}{o}" for n, o in ops)) for p, ops in rows]
    df = spark.createDataFrame(data, "pos int, cigar string")
    for r in df.select("pos", "cigar", cigar.reference_span(F.col("cigar")).alias("span"), cigar.blocks(F.col("pos"), F.col("cigar")).alias("b")).collect():
        assert (r.span, [(x.start, x.end) for x in r.b]) == model(r.pos, r.cigar)


def test_depth_of_long_cigars(spark):
    rows = [("c", 10 * i, "7M1I3M1D" * 5000, 0, 60) for i in range(20)] + [("c", 5, "*", 0, 60), ("c", 5, "3S", 0, 60), ("c", None, "3M", 0, 60)]
    reads = spark.createDataFrame(rows, "ref string, pos int, cigar string, flag int, mapq int").withColumn("end_pos", F.col("pos") + 55_000)
    got = {r.pos: r.depth for r in api.pileup(reads, "c:1-400").collect()}
    want = {p: n for p in range(400) if (n := sum(p >= q and (p - q) % 11 < 10 for _, q, c, *_ in rows[:20]))}
    assert got == want


def test_bad_cigar(spark):
    for text, error in (("0M", "invalid CIGAR string"), ("5", "invalid CIGAR string"), ("5Q", "invalid CIGAR operation")):
        with pytest.raises(Exception, match=error):
            spark.createDataFrame([(text,)], "c string").select(cigar.reference_span(F.col("c"))).collect()


def test_quality_bins(spark):
    df = spark.createDataFrame([("!&07?I????",), ("*",)], "q string")
    assert [r[0] for r in df.select(records.bin_quality(F.col("q"))).collect()] == ["!'07BIBBBB"[:0] + "".join(chr(33 + next(s for h, s in records.BINS if ord(c) - 33 <= h)) for c in "!&07?I????"), "*"]


def test_bins(spark):
    s, e = records.bin_interval(F.col("id"))
    rows = spark.createDataFrame([(4681,), (4682,), (0,)], "id long").select(s, e).collect()
    assert [tuple(r) for r in rows] == [(0, 16384), (16384, 32768), (0, 2**29)]
    assert records.metadata_bin() == 37450


def test_chunk_rules(spark):
    rows = [("chr1", i * 10, i * 10 + 5, f"q{i}") for i in range(10)] + [("chr2", 0, 5, "z")]
    df = spark.createDataFrame(rows, "ref string, pos int, end_pos int, qname string").select("*", *(F.lit("").alias(c) for c in ("cigar", "mate_reference", "sequence", "quality", "tags")))
    count = lambda **k: sorted((r.ref, r.chunk_id, r.record_count) for r in chunking.pack(df, chunking.Policy(**k)).collect())
    assert count(max_records=4) == [("chr1", 0, 4), ("chr1", 1, 4), ("chr1", 2, 2), ("chr2", 0, 1)]
    assert count(max_span=25) == [("chr1", 0, 3), ("chr1", 1, 3), ("chr1", 2, 3), ("chr1", 3, 1), ("chr2", 0, 1)]
    with pytest.raises(ReadsError, match="must not exceed"):
        chunking.Policy(target_bytes=10, max_bytes=5)


@settings(max_examples=50, deadline=None)
@given(st.text("ACGT", min_size=40, max_size=40), st.text("ACGTN", max_size=60))
def test_reference_delta_round_trip(seq, ref):
    parts = [(5, "S"), (10, "M"), (3, "I"), (4, "D"), (12, "="), (2, "N"), (10, "X")]
    at, clips, insertions = refdelta.walk(parts, seq, ref)
    assert refdelta.rebuild(parts, ref, at, np.frombuffer(seq.encode(), np.uint8)[at], clips, insertions) == seq


def test_bam(spark, tmp_path):
    name = b"r1\0"
    body = struct.pack("<iiBBHHHiiii", 0, 100, len(name), 60, 4681, 1, 0, 4, -1, -1, 0) + name + struct.pack("<I", 4 << 4) + bytes([0x12, 0x48]) + bytes([30] * 4) + b"NMC\x02" + b"RGZg1\0"
    data = b"BAM\x01" + struct.pack("<ii", 0, 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(data))
    row = api.open_reads(spark, str(tmp_path / "a.bam")).first()
    assert (row.qname, row.ref, row.pos, row.cigar, row.sequence, row.quality, row.tags, row.end_pos) == ("r1", "chr1", 100, "4M", "ACGT", "????", "NM:i:2\tRG:Z:g1", 104)


def test_bam_export_round_trip(spark, tmp_path):
    many = "1M1I" * 40_000  # more operations than a BAM record counts
    rows = [
        "a\t0\tc2\t5\t60\t4M\t=\t9\t-3\tACGTN\t!~FF#\tNM:i:-2\tXI:i:4000000000\tXF:f:0.5\tXA:A:q\tXB:B:s,1,-2\tRG:Z:g 1".replace("4M", "5M"),
        f"b\t16\tc1\t20001\t0\t{many}\tc2\t1\t0\t{'AC' * 40_000}\t*",
        "c\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*",
        "d\t0\tc1\t7\t1\t3M\t*\t0\t0\tACG\tFFF",
    ]
    (tmp_path / "x.sam").write_text("@SQ\tSN:c1\tLN:30000\n@SQ\tSN:c2\tLN:900\n" + "\n".join(rows) + "\n")
    reads, contigs = api.open_reads(spark, str(tmp_path / "x.sam")), files.sam_contigs(spark, str(tmp_path / "x.sam"))
    assert files.export_bam(reads, contigs, str(tmp_path / "out")) == 4
    written = sorted((tmp_path / "out").glob("*.bam"))
    assert written[0].read_bytes().endswith(bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"))
    names = [r[0] for p in written for r in files.decode_bam(p.open("rb"))[1]]
    assert names == ["d", "b", "a", "c"]
    back = files.read_bam(spark, str(tmp_path / "out" / "*.bam"))
    assert sorted(r[0] for r in back.select(records.sam_line()).collect()) == sorted(rows)


def test_indexes(spark):
    bai = b"BAI\x01" + struct.pack("<i", 1) + struct.pack("<i", 2) + struct.pack("<IiQQ", 4681, 1, 5, 9) + struct.pack("<IiQQ", 37450, 1, 1, 2) + struct.pack("<iQ", 1, 7)
    rows = [tuple(r) for r in files.project_index(spark, files.parse_index(bai)).collect()]
    assert rows == [(0, 0, 16384, 5, 9)]
    packed = files.pack_sidecar(rows, 1)
    assert files.parse_sidecar(packed) == rows
    with pytest.raises(ReadsError, match="CRC"):
        files.parse_sidecar(packed[:-1] + b"x")
    with pytest.raises(ReadsError, match="truncated"):
        files.parse_index(bai[:-2])


def test_dataset_round_trip(spark, toy, tmp_path):
    files.convert(toy, str(tmp_path / "d"))
    back = files.open_dataset(spark, str(tmp_path / "d"))
    assert [r.sam_line for r in api.view(back, "chrToy:1-250").collect()] == SAM.splitlines()[2:4]
    plan = back.where((F.col("ref") == "chrToy") & (F.col("pos") < 100))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "LessThan(pos,100)" in plan
    files.export_sam(back, files.sam_contigs(spark, str(tmp_path / "toy.sam")), str(tmp_path / "out"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == "\n".join(SAM.splitlines()[:4])


def test_fasta(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a x\nACgt\nAC\n>b\nTT\n")
    contigs = files.read_fasta(spark, str(tmp_path / "r.fa"))
    assert sorted(map(tuple, contigs.collect())) == [("a", "ACgtAC"), ("b", "TT")]
    files.validate_reference(files.checksums(contigs), contigs)
    with pytest.raises(ReadsError, match="a"):
        files.validate_reference(spark.createDataFrame([("a", "00")], "name string, sha256 string"), contigs)


def test_refdelta_of_reads_beyond_a_window(spark):
    rng = np.random.RandomState(8)
    genome = "".join(rng.choice(list("ACGT"), 200_000))
    spliced, long = genome[100:130] + genome[70_130:70_200], genome[20_000:120_000]
    changed = spliced[:50] + ("A" if spliced[50] != "A" else "C") + spliced[51:]
    rows = [("a", "c", 100, 70_200, "30M70000N70M", changed), ("a", "c", 100, 70_200, "30M70000N70M", changed), ("b", "c", 20_000, 120_000, "100000M", long), ("d", "c", 5, 15, "10M", genome[5:15])]
    rows += [("e", "c", 150_000, 230_000, "80000M", genome[150_000:] + "A" * 30_000), ("f", "gone", 0, 70_000, "10M69980N10M", "ACGT" * 5)]
    reads = spark.createDataFrame(rows, "qname string, ref string, pos int, end_pos int, cigar string, sequence string")
    windows = refdelta.tiles(spark.createDataFrame([("c", genome)], "name string, seq string"))
    delta = refdelta.encode(reads, windows)
    assert sorted((r.qname, len(r.mismatches)) for r in delta.collect()) == [("a", 1), ("a", 1), ("b", 0), ("d", 0), ("e", 30_000), ("f", 20)]
    assert sorted((r.qname, r.sequence) for r in refdelta.decode(delta, windows).collect()) == sorted((r[0], r[5]) for r in rows)


def test_export_sam_keeps_reads_without_contig(spark, toy, tmp_path):
    contigs = files.sam_contigs(spark, str(tmp_path / "toy.sam"))
    stray = toy.limit(1).withColumn("ref", F.lit("*")).withColumn("qname", F.lit("stray"))
    files.export_sam(toy.where("ref <> '*'").unionByName(stray), contigs, str(tmp_path / "all"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "all")).collect()]
    assert lines[-1].startswith("stray\t") and sum(not x.startswith("@") for x in lines) == toy.where("ref <> '*'").count() + 1
    with pytest.raises(Exception, match="header lacks"):
        files.export_sam(stray.withColumn("ref", F.lit("gone")), contigs, str(tmp_path / "none"))


def test_chunk_reads_and_validity(spark, toy, tmp_path):
    path = str(tmp_path / "d")
    report = {r.key: r.value for r in files.convert(toy, path, policy=chunking.Policy(target_bytes=1, max_bytes=1000), contigs=files.contigs_of(spark, str(tmp_path / "toy.sam")), source="toy").collect()}
    assert report == {"input": "toy", "output": path, "format": "parquet", "quality_lossy": "none", "compression": "zstd"}
    reads = api.open_reads(spark, path)
    assert [r.qname for r in chunking.read_chunk(reads, "chrToy", 1, ["qname"]).collect()] == ["read002"]
    files.assert_valid(spark, path)
    plan = reads.where((F.col("ref") == "chrToy") & (F.col("pos") < 120)).select("pos")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ref" in plan and "LessThan(pos,120)" in plan
    spark.read.parquet(f"{path}/chunk_index").withColumn("record_count", F.col("record_count") + 1).write.parquet(f"{path}/other")
    import shutil

    shutil.rmtree(f"{path}/chunk_index")
    shutil.move(f"{path}/other", f"{path}/chunk_index")
    with pytest.raises(ReadsError, match="doesn't fit"):
        files.assert_valid(spark, path)


def test_unknown_contig_is_an_error(spark, toy, tmp_path):
    assert api.view_path(spark, str(tmp_path / "toy.sam"), "chrToy:1-250").count() == 2
    with pytest.raises(ReadsError, match="unknown contig: nope"):
        api.view_path(spark, str(tmp_path / "toy.sam"), "nope:1-250")


def test_ties_keep_the_order_of_the_file(spark, tmp_path):
    lines = [f"{name}\t0\tc\t5\t1\t2M\t*\t0\t0\tAC\tFF" for name in ("z", "a", "m", "b")]
    (tmp_path / "t.sam").write_text("@SQ\tSN:c\tLN:50\n" + "\n".join(lines) + "\n")
    reads = api.open_reads(spark, str(tmp_path / "t.sam"))
    assert [r.sam_line[0] for r in api.view(reads, "c:1-50").collect()] == list("zamb")
    files.convert(reads, str(tmp_path / "d"))
    again = api.open_reads(spark, str(tmp_path / "d"))
    assert [r.sam_line[0] for r in api.view(again, "c:1-50").collect()] == list("zamb")
    files.export_sam(again, files.contigs_of(spark, str(tmp_path / "t.sam")), str(tmp_path / "out.sam"))
    files.export_bam(again, files.contigs_of(spark, str(tmp_path / "t.sam")), str(tmp_path / "out.bam"))
    for out in ("out.sam", "out.bam"):
        assert [r.sam_line[0] for r in api.view(api.open_reads(spark, str(tmp_path / out)), "c:1-50").collect()] == list("zamb")
    assert [tuple(r) for r in files.contigs_of(spark, str(tmp_path / "out.bam")).collect()] == [(0, "c", 50)]


def test_mates_on_unlisted_contigs_are_an_error(spark, toy, tmp_path):
    odd = toy.where("ref = 'chrToy'").withColumn("mate_reference", F.lit("c7"))
    with pytest.raises(Exception, match="mate's contig is not in the header"):
        files.export_bam(odd, files.contigs_of(spark, str(tmp_path / "toy.sam")), str(tmp_path / "x.bam"))


def test_row_file(spark, toy, tmp_path):
    found = blocks.row_blocks(toy).collect()
    data = blocks.pack_blocks([("chrToy", 1000)], [(0, r.start_pos, r.end_pos, r.record_count, bytes(r.payload)) for r in found])
    (tmp_path / "toy.rows").write_bytes(data)
    reads = api.open_reads(spark, str(tmp_path / "toy.rows"))
    assert [r.sam_line for r in api.view(reads, "chrToy:1-250").collect()] == SAM.splitlines()[2:4]
    for bad, error in ((b"XXXX" + data[4:], "magic"), (data[:20], "truncated"), (data + b"x", "trailing")):
        with pytest.raises(ReadsError, match=error):
            blocks.parse_blocks(bad)
    with pytest.raises(ReadsError, match="record count"):
        blocks.pack_blocks([("c", 9)], [(0, 0, 5, 2, b"one\n")])


def test_index_beside_a_bam_file(spark, tmp_path):
    bam = tmp_path / "x.bam"
    assert files.find_bam_index(spark, str(bam)) is None
    bai = b"BAI\x01" + struct.pack("<iiIiQQi", 1, 1, 4681, 1, 10, 20, 0)
    (tmp_path / "x.bai").write_bytes(bai)
    assert files.find_bam_index(spark, str(bam)).endswith("x.bai")
    (tmp_path / "x.bam.bai").write_bytes(bai)
    csi = gzip.compress(b"CSI\x01" + struct.pack("<iiiiiIQiQQ", 14, 5, 0, 1, 1, 4682, 0, 1, 30, 40))
    assert files.find_bam_index(spark, str(bam)).endswith("x.bam.bai")
    assert files.index_bam(spark, str(bam), str(tmp_path / "x.idx")) == 1
    assert files.parse_sidecar((tmp_path / "x.idx").read_bytes()) == [(0, 0, 16384, 10, 20)]
    (tmp_path / "x.bam.csi").write_bytes(csi)
    assert files.index_bam(spark, str(bam), str(tmp_path / "x.idx")) == 1
    assert files.parse_sidecar((tmp_path / "x.idx").read_bytes()) == [(0, 16384, 32768, 30, 40)]


def test_tables(spark, toy):
    table = api.to_dataframe(api.query_region(toy, "chrToy:1-250"), ["qname", "flag", "pos", "mapq"])
    assert [str(t) for t in table.dtypes][1:] == ["uint16", "int32", "uint8"] and list(table.pos) == [100, 150]
    assert api.column_array(toy.where("pos >= 0"), "mapq").tolist() == [60, 50]
    with pytest.raises(ReadsError, match="not a numeric column"):
        api.column_array(toy, "qname")
    series = api.coverage_to_series(api.pileup(toy, "chrToy:101-103"))
    assert list(series.index) == [100, 101, 102] and series.dtype == "uint32" and series.index.name == "position"
    assert [r.qname for r in api.iterate(toy.select("qname"))] == ["read001", "read002", "read003"]


def test_policy_from_settings():
    assert chunking.Policy.from_settings({"READLOOM_CHUNK_MAX_RECORDS": "7", "OTHER": "x"}).max_records == 7
    for text in ("0", "-1", "x", "", "1.5"):
        with pytest.raises(ReadsError, match="positive integer"):
            chunking.Policy.from_settings({"READLOOM_CHUNK_MAX_SPAN": text})


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.integers(-(2**63), 2**63 - 1), max_size=50))
@settings(max_examples=50, deadline=None)
def test_varints(numbers, signed):
    assert codec_bytes.Cursor(codec_bytes.varints(numbers)).numbers(len(numbers)).tolist() == numbers
    assert codec_bytes.unzigzag(codec_bytes.Cursor(codec_bytes.varints(codec_bytes.zigzag(signed))).numbers(len(signed))).tolist() == signed


@given(st.lists(st.binary(max_size=30).filter(lambda b: b"\t" not in b), min_size=1, max_size=20))
@settings(max_examples=50, deadline=None)
def test_text_codes(texts):
    for column in ("qname", "cigar", "quality", "sequence"):
        for code, body in codec_bytes.bodies_of(column, texts):
            assert codec_bytes.decode(column, code, body, len(texts)) == texts
            packed = codec_bytes.envelope(code, body)
            assert codec_bytes.decode(column, "compressed", packed, len(texts)) == texts
            with pytest.raises(Exception):  # noqa: B017 - a cut body never decodes
                codec_bytes.decode(column, code, body[:-1], len(texts))


@pytest.mark.parametrize(("tags", "can"), [([b"NM:i:0\tHP:i:1", b"NM:i:-5"], True), ([b"", b"RG:Z:a", b"NM:i:3"], True), ([b"NM:i:0\tHP:i:1", b"HP:i:1\tNM:i:0"], False), ([b"X0:i:1", b"X0:Z:1"], False), ([b"NM:i:007"], False), ([b"", b""], True)])
def test_tag_streams(tags, can):
    body = codec_bytes.tag_streams(tags)
    assert (body is not None) == can
    if can:
        assert codec_bytes.decode("tags", "tags_per_stream", body, len(tags)) == tags


def test_positions_that_do_not_ascend_stay_plain():
    (code, body), *_ = codec_bytes.bodies_of("pos", [5, 3, 9])
    assert code == "raw" and codec_bytes.decode("pos", code, body, 3) == [5, 3, 9]


def test_required_reference(spark):
    seqs = spark.createDataFrame([("c", "acgt")], "name string, seq string")
    made = files.checksum_extensions(files.checksums(seqs))
    files.require_reference(made, seqs)
    with pytest.raises(ReadsError, match="reference is required"):
        files.require_reference(made, None)
    with pytest.raises(ReadsError, match="checksum mismatch for c"):
        files.require_reference(made, seqs.withColumn("seq", F.lit("acga")))
    with pytest.raises(Exception, match="unknown required metadata"):
        files.checksums_of(spark.createDataFrame([(99, 1, b"x")], files.EXTENSIONS)).collect()
    assert files.checksums_of(spark.createDataFrame([(99, 0, b"x")], files.EXTENSIONS)).count() == 0


def test_fasta_lines(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">one first\nACGT\nacgt\nAC\n>two\nTTTT\n")
    lines = files.read_fasta_lines(spark, str(tmp_path / "r.fa"))
    assert files.fetch_sequence(lines, "one", 2, 9) == "GTacgtA" and files.fetch_sequence(lines, "two", 0, 4) == "TTTT"
    for name, start, end, error in (("one", 5, 11, "outside"), ("one", 4, 4, "outside"), ("no", 0, 1, "unknown contig")):
        with pytest.raises(ReadsError, match=error):
            files.fetch_sequence(lines, name, start, end)
    assert {r.name: r.seq for r in files.read_fasta(spark, str(tmp_path / "r.fa")).collect()} == {"one": "ACGTacgtAC", "two": "TTTT"}


def bai_of(path):
    """An index of a BAM file by its own records: a bin's neighbouring records are one chunk."""
    with open(path, "rb") as file:
        plain = files.Bgzf(file)
        contigs = files.bam_header(plain)
        bins, linear, n = [{} for _ in contigs], [{} for _ in contigs], 0
        while True:
            begin = plain.tell()
            head = plain.read(4)
            if not head:
                break
            data = plain.read(struct.unpack("<i", head)[0])
            ref, pos, _, _, bin_id = struct.unpack_from("<iiBBH", data)
            end = plain.tell()
            if ref < 0:
                continue
            n += 1
            chunks = bins[ref].setdefault(bin_id, [])
            if chunks and chunks[-1][1] == begin:
                chunks[-1][1] = end
            else:
                chunks.append([begin, end])
            linear[ref].setdefault(pos >> 14, begin)
    out = b"BAI\x01" + struct.pack("<i", len(contigs))
    for mine, _ in zip(bins, linear, strict=True):
        out += struct.pack("<i", len(mine))
        for bin_id, chunks in sorted(mine.items()):
            out += struct.pack("<Ii", bin_id, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<i", 0)
    return out


def test_bam_by_its_index(spark, tmp_path):
    from readloom.sources import derived

    reads = derived.reads(spark, "/root/testdata/sf0.001")
    contigs = spark.createDataFrame([(i, f"chr{i + 1}", 102_400) for i in range(5)], "ref_id int, name string, length long")
    files.export_bam(reads.coalesce(1), contigs, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("*.bam"))
    for part in parts:
        part.with_suffix(".bam.bai").write_bytes(bai_of(part))
        whole = files.read_bam(spark, str(part))
        for size in (1 << 10, 1 << 30):
            split = files.read_bam_split(spark, str(part), size)
            assert split.select(*files.READS.fieldNames()).exceptAll(whole.select(*files.READS.fieldNames())).count() == 0 and split.count() == whole.count()
        assert files.read_bam_split(spark, str(part), 1 << 10).rdd.getNumPartitions() > 1
        held = [tuple(r) for r in files.contigs_of(spark, str(part)).collect()]
        assert held == [(i, f"chr{i + 1}", 102_400) for i in range(5)]
        for text in ("chr2:20001-60000", "chr1:1-10", "chr3:16384-16386"):
            want = api.query_region(api.open_reads(spark, str(part)), text).select("qname", "pos", "end_pos").collect()
            got = files.read_bam_region(spark, str(part), parse_region(text)).select("qname", "pos", "end_pos").collect()
            assert sorted(got) == sorted(want)
        assert [r.sam_line for r in api.view_path(spark, str(part), "chr2:20001-60000").collect()] == [r.sam_line for r in api.view(api.open_reads(spark, str(part)), "chr2:20001-60000").collect()]
    with pytest.raises(ReadsError, match="unknown contig"):
        api.view_path(spark, str(parts[0]), "nope:1-2")
    with pytest.raises(ReadsError, match="no index"):
        (tmp_path / "bare.bam").write_bytes(parts[0].read_bytes())
        files.read_bam_region(spark, str(tmp_path / "bare.bam"), parse_region("chr1:1-2"))


def test_chunks_of_crowded_positions(spark, tmp_path):
    rows = [(f"r{i:05d}", 0, f"c{i % 2}", i // 400, 60, "10M", "*", -1, 0, "ACGTACGTAC", "FFFFFFFFFF", "") for i in range(8_000)]
    reads = spark.createDataFrame(rows, "qname string, flag int, ref string, pos int, mapq int, cigar string, mate_reference string, mate_pos int, template_length int, sequence string, quality string, tags string")
    files.convert(reads, str(tmp_path / "d"), policy=chunking.Policy(max_records=3))
    files.assert_valid(spark, str(tmp_path / "d"))
    got = files.open_dataset(spark, str(tmp_path / "d"))
    assert {(r.ref, r.qname): r.chunk_id for r in got.collect()} == {(f"c{i % 2}", f"r{i:05d}"): i // 2 // 3 for i in range(8_000)}
    for part in (tmp_path / "d" / "reads").rglob("*.parquet"):
        names = [r.qname for r in spark.read.parquet(str(part)).collect()]
        assert names == sorted(names)
    # no pair of a read and a chunk of its bin is formed: there were 13,000 chunks to a bin in 36 million reads
    placed = chunking.assign(reads.withColumn("end_pos", F.col("pos") + 10), spark.read.parquet(str(tmp_path / "d" / "chunk_index")).withColumn("first", F.lit("")))
    assert "Join" not in placed._jdf.queryExecution().executedPlan().toString()


def test_codes_of_many_rows_at_once(monkeypatch):
    monkeypatch.setattr(codec_bytes, "ROWS", 7)
    texts = [b"ACGT" * (i % 50) + b"GAT"[: 1 + i % 3] for i in range(40)]
    body, taken = codec_bytes.base_rows(texts)
    assert taken.tolist() == [(len(t) + 3) // 4 for t in texts]
    assert body == b"".join(codec_bytes.varints([len(t)]) + codec_bytes.packed_bits(np.array([b"ACGT".index(x) for x in t]), 2) for t in texts)
    assert codec_bytes.from_bases(codec_bytes.Cursor(body), 40) == texts
    for window in (64, 1 << 20):
        monkeypatch.setattr(codec_bytes, "WINDOW", window)
        runs = [b"F" * (1 + i * 9 % 300) + b"#" * (i % 4) + b",F" * (i % 7) for i in range(40)]
        assert codec_bytes.from_quality_runs(codec_bytes.Cursor(codec_bytes.quality_runs(runs)), 40) == runs


def test_facts_of_bodies_need_no_bodies(spark, toy):
    """Every chunk is encoded once, whatever is summed over it, and its bodies stay in the task."""
    from readloom.operators import codecs

    chunked = toy.withColumn("chunk", F.lit(0))
    sizes = codec_bytes.encode_chunks(chunked, facts=codec_bytes.SIZES)
    whole = codec_bytes.encode_chunks(chunked).withColumn("bytes", F.octet_length("body").cast("long")).drop("body")
    assert sorted(sizes.collect()) == sorted(whole.collect())
    summary = codecs.payload_summary(sizes)
    assert summary._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert abs(sum(r.percent for r in summary.collect()) - 100) < 1e-9


def test_bodies_stay_in_their_task(spark, monkeypatch):
    from readloom.plans import storage

    found = storage.QUERIES["codec_bodies"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "body" not in plan


def test_blocks_of_crowded_spans(spark):
    rows = [(f"r{i:04d}", 0, "c", i // 300, 60, "10M", "*", -1, 0, "ACGTACGTAC", "FFFFFFFFFF", "", i // 300 + 10) for i in range(3_000)]
    reads = spark.createDataFrame(rows, "qname string, flag int, ref string, pos int, mapq int, cigar string, mate_reference string, mate_pos int, template_length int, sequence string, quality string, tags string, end_pos int")
    made = blocks.streamed_blocks(reads, span=1 << 14, most=100)
    assert sorted((r.start_pos, r.end_pos, r.record_count) for r in made.collect()) == sorted((p, p + 10, 100) for p in range(10) for _ in range(3))
    region = Region("c", 4, 6)
    assert [r.sam_line for r in blocks.view_blocks(made, region).collect()] == [r.sam_line for r in blocks.view_blocks(blocks.row_blocks(reads, span=1 << 14), region).collect()]


def test_row_block_view_gathers_no_span(spark):
    from readloom.plans import storage

    plan = storage.QUERIES["row_block_view"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
