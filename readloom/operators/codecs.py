"""What each column of a chunk would take under each column code, and the choice among them.

Parquet picks its encodings itself; this is the analysis: sizes by aggregation, never the bytes.
``keys`` are the columns that name a chunk; within a chunk records go by ``order``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from readloom.functions import cigar
from readloom.functions.records import bit_width, tag_items, varint_size, zigzag

KEYS = ("ref", "chunk")
ORDER = ("pos", "qname")
#: Order of preference: a later code must be strictly smaller.
CODES = {
    "qname": ("raw", "qname_dict"), "flag": ("raw", "flag_bitpack"), "pos": ("pos_delta",), "mapq": ("raw", "mapq_rle"),
    "cigar": ("raw", "cigar_token", "cigar_dict"), "mate_reference": ("raw",), "mate_pos": ("raw",), "template_length": ("raw",),
    "sequence": ("raw", "seq_2bit"), "quality": ("raw", "qual_rle", "qual_pack"), "tags": ("raw", "tags_per_stream"),
}


def _long(c: Column) -> Column:
    return c.cast("long")


def string_bytes(name: str) -> Column:
    return F.sum(4 + F.octet_length(name))


def ordered(keys=KEYS, order=ORDER) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def pos_delta(reads: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """(keys, n, delta_sum, bytes): the first position and the steps after it."""
    step = F.col("pos") - F.coalesce(F.lag("pos").over(ordered(keys, order)), F.lit(0))
    return reads.select(*keys, step.alias("step")).groupBy(*keys).agg(F.count("*").alias("n"), _long(F.sum("step")).alias("last_pos"), _long(F.sum(varint_size(F.col("step")))).alias("bytes"))


def mapq_runs(reads: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """(keys, runs, longest, bytes) of equal mapping qualities in order."""
    w = ordered(keys, order)
    new = F.coalesce((F.col("mapq") != F.lag("mapq").over(w)).cast("int"), F.lit(1))
    island = reads.select(*keys, *order, "mapq", new.alias("new")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = island.groupBy(*keys, "run").agg(F.count("*").alias("length"))
    return lengths.groupBy(*keys).agg(F.count("*").alias("runs"), F.max("length").alias("longest"), _long(F.sum(varint_size(F.col("length")) + 1)).alias("bytes"))


def flag_width(reads: DataFrame, keys=KEYS) -> DataFrame:
    w = bit_width(F.max("flag"))
    return reads.groupBy(*keys).agg(F.count("*").alias("n"), w.alias("bits"), _long(1 + F.ceil(F.count("*") * w / 8)).alias("bytes"))


def prefix_length(a: Column, b: Column) -> Column:
    """Characters that two strings share from the start."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, n))


def dictionary(reads: DataFrame, column: str, keys=KEYS, front_coded: bool = False) -> DataFrame:
    """(keys, n, entries, shared, bytes) of a sorted dictionary, its entries front-coded on request, and references to it."""
    w = Window.partitionBy(*keys).orderBy(column)
    counted = reads.groupBy(*keys, column).agg(F.count("*").alias("uses"))
    shared = F.coalesce(prefix_length(F.lag(column).over(w), F.col(column)), F.lit(0)) if front_coded else F.lit(0)
    entry = counted.select(*keys, "uses", F.octet_length(column).alias("size"), shared.alias("shared"), (F.row_number().over(w) - 1).alias("rank"))
    rest = F.col("size") - F.col("shared")
    head = F.when(F.col("rank") > 0, varint_size(F.col("shared"))).otherwise(0) if front_coded else F.lit(0)
    cost = head + varint_size(rest) + rest + F.col("uses") * varint_size(F.col("rank"))
    return entry.groupBy(*keys).agg(F.sum("uses").alias("n"), F.count("*").alias("entries"), _long(F.sum("shared")).alias("shared"), _long(varint_size(F.count("*")) + F.sum(cost)).alias("bytes"))


def token_bytes(cigar_text: Column) -> Column:
    """Bytes of one CIGAR as counted tokens; null where it has none or a length with a leading zero."""
    parts = cigar.tokens(cigar_text)
    size = varint_size(F.size(parts)) + F.aggregate(parts, F.lit(0).cast("long"), lambda a, t: a + varint_size(t["len"]) + 1)
    return F.when(cigar_text.rlike("^([1-9][0-9]*[MIDNSHP=X])++$"), size)


def all_or_null(value: Column) -> Column:
    """The sum, or null where any value is."""
    return F.when(F.count(value) == F.count("*"), _long(F.sum(value)))


def quality_facts(reads: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, size, n_runs, rle, low, high) for each text: its runs, their bytes, and bit masks of its characters
    below and above 64. A batch's bytes are one numpy array. Missing qualities give nulls but for the masks."""
    k = list(keys)
    schema = T.StructType([*(reads.schema[c] for c in k), *T.StructType.fromDDL("size long, n_runs long, rle long, low long, high long").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            raw = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(sizes) - sizes
            first = np.zeros(len(raw), bool)
            first[1:] = raw[1:] != raw[:-1]
            full = np.flatnonzero(sizes)
            first[starts[full]] = True
            at = np.flatnonzero(first)
            lengths = np.diff(np.append(at, len(raw)))
            row = full[np.searchsorted(starts[full], at, side="right") - 1] if len(full) else at
            cost = 1 + np.maximum(1, -(-(np.frexp(lengths.astype(np.float64))[1]) // 7))
            one = np.uint64(1)
            masks = [np.zeros(len(texts), np.uint64) for _ in range(2)]
            for high in (0, 1):
                bits = np.where(raw >> 6 == high, one << (raw & 63).astype(np.uint64), np.uint64(0))
                if len(full):
                    masks[high][full] = np.bitwise_or.reduceat(bits, starts[full])
            missing = np.array([t in (b"", b"*") for t in texts], bool)
            made = [pa.array(sizes), pa.array(np.bincount(row, minlength=len(texts)), mask=missing), pa.array(np.bincount(row, cost, len(texts)).astype(np.int64), mask=missing), *(pa.array(m.view(np.int64)) for m in masks)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in k), *made], names=names)

    return reads.select(*k, F.col("quality").cast("binary").alias("_text")).mapInArrow(run, schema)


def quality_codes(reads: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, n, alphabet, bits, runs, rle_bytes, pack_bytes): one aggregation over ``quality_facts``.

    The bits that a text takes packed depend on its chunk's alphabet, so whole sizes are summed for each width."""
    widths = range(8)
    packed = [F.sum(varint_size(F.col("size")) + F.ceil(F.col("size") * w / 8)).alias(f"p{w}") for w in widths]
    n = F.count("*")
    summed = quality_facts(reads, keys).groupBy(*keys).agg(n.alias("n"), F.count("rle").alias("concrete"), (F.bit_count(F.bit_or("low")) + F.bit_count(F.bit_or("high"))).cast("long").alias("alphabet"), F.sum("n_runs").alias("runs"), all_or_null(varint_size(F.col("size")) + F.col("rle")).alias("rle_bytes"), *packed)
    bits = F.when(F.col("alphabet") <= 1, 0).otherwise(bit_width(F.col("alphabet") - 1)).cast("long")
    body = F.element_at(F.array(*(f"p{w}" for w in widths)), (bits + 1).cast("int"))
    return summed.select(*keys, "n", "alphabet", bits.alias("bits"), "runs", "rle_bytes", _long(F.when((F.col("concrete") == F.col("n")) & (F.col("alphabet") <= 128), body + varint_size(F.col("alphabet")) + F.col("alphabet"))).alias("pack_bytes"))


def sequence_2bit(reads: DataFrame, keys=KEYS) -> DataFrame:
    size = F.when(F.col("sequence").rlike("^[ACGT]+$"), varint_size(F.length("sequence")) + F.ceil(F.length("sequence") / 4))
    return reads.groupBy(*keys).agg(F.count("*").alias("n"), F.count(size).alias("packable"), _long(F.sum(size)).alias("packable_bytes"), all_or_null(size).alias("bytes"))


def tag_streams(reads: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, n, n_keys, bytes) of one stream for each tag key; bytes null where a key changes its type."""
    value = F.when(F.col("t.type") == "i", varint_size(zigzag(F.col("t.value").try_cast("long")))).otherwise(varint_size(F.length("t.value")) + F.length("t.value"))
    counts = reads.groupBy(*keys).agg(F.count("*").alias("n"))
    per = reads.select(*keys, F.explode(tag_items(F.col("tags"))).alias("t")).groupBy(*keys, F.col("t.key").alias("key")).agg(F.count("*").alias("present"), F.count_distinct("t.type").alias("types"), F.sum(value).alias("values"))
    stream = F.when(F.col("types") == 1, 4 + F.when(F.col("present") == F.col("n"), 0).otherwise(F.ceil(F.col("n") / 8)) + varint_size(F.col("present")) + F.col("values"))
    summed = per.join(counts, list(keys)).groupBy(*keys, "n").agg(F.count("*").alias("n_keys"), all_or_null(stream).alias("streams"))
    out = counts.join(summed.drop("n"), list(keys), "left").withColumn("n_keys", F.coalesce("n_keys", F.lit(0)))
    return out.select(*keys, "n", F.col("n_keys").cast("long").alias("n_keys"), _long(F.when(F.col("n_keys") == 0, 1).otherwise(varint_size(F.col("n_keys")) + F.col("streams"))).alias("bytes"))


def candidates(reads: DataFrame, keys=KEYS, order=ORDER) -> DataFrame:
    """(keys, column, code, rank, bytes) of every code that can hold the column."""
    k = list(keys)

    def rows(df: DataFrame, *made: tuple[str, str, Column]) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("column"), F.lit(code).alias("code"), F.lit(CODES[c].index(code)).alias("rank"), _long(size).alias("bytes")) for c, code, size in made]
        return df.select(*k, F.inline(F.array(*cells))).where("bytes IS NOT NULL")

    texts = ("qname", "cigar", "mate_reference", "sequence", "quality", "tags")
    plain = reads.groupBy(*k).agg(F.count("*").alias("n"), bit_width(F.max("flag")).alias("w"), *(string_bytes(c).alias(c) for c in texts), all_or_null(token_bytes(F.col("cigar"))).alias("tokens"))
    n = F.col("n")
    parts = [
        rows(plain, *((c, "raw", F.col(c)) for c in texts), ("flag", "raw", 2 * n), ("flag", "flag_bitpack", 1 + F.ceil(n * F.col("w") / 8)), ("mapq", "raw", n), ("mate_pos", "raw", 4 * n), ("template_length", "raw", 4 * n), ("cigar", "cigar_token", F.col("tokens"))),
        rows(pos_delta(reads, keys, order), ("pos", "pos_delta", F.col("bytes"))),
        rows(mapq_runs(reads, keys, order), ("mapq", "mapq_rle", F.col("bytes"))),
        rows(dictionary(reads, "qname", keys, True), ("qname", "qname_dict", F.col("bytes"))),
        rows(dictionary(reads, "cigar", keys), ("cigar", "cigar_dict", F.col("bytes"))),
        rows(sequence_2bit(reads, keys), ("sequence", "seq_2bit", F.col("bytes"))),
        rows(quality_codes(reads, keys), ("quality", "qual_rle", F.col("rle_bytes")), ("quality", "qual_pack", F.col("pack_bytes"))),
        rows(tag_streams(reads, keys), ("tags", "tags_per_stream", F.col("bytes"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def choose(found: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, column, code, bytes): the smallest; of equals the one preferred."""
    best = found.groupBy(*keys, "column").agg(F.min(F.struct("bytes", "rank", "code")).alias("best"))
    return best.select(*keys, "column", "best.code", "best.bytes")


def distribution(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("column", "code").agg(F.count("*").alias("chunks"))


def payload_summary(chosen: DataFrame) -> DataFrame:
    """(column, total_bytes, chunks, codes, avg_bytes, percent) with the share of all columns."""
    per = chosen.groupBy("column").agg(F.sum("bytes").alias("total_bytes"), F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.avg("bytes").alias("avg_bytes"))
    whole = F.sum("total_bytes").over(Window.partitionBy())  # over a row for each column: a join with the sum would encode all chunks twice
    return per.select("column", "total_bytes", "chunks", "codes", "avg_bytes", (100 * F.col("total_bytes") / whole).alias("percent"))
