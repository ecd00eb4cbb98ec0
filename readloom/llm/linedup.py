"""Line deduplication with two Bloom filters.

The first pass puts the hash of every candidate line into a once-seen filter and, where
it is met again, into a twice-seen filter. Partitions hand their filters over as sparse
blocks (sorted 16-bit positions), which are merged block by block while they stream; only the twice-seen
filter, of a fixed size, reaches the driver and the executors. In the second pass lines
that miss it are certain to be unique; only the others are shuffled, as 16-byte digests,
to be counted exactly and to find the document that keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rows, code_points, out_schema, rows_of, saved, table, text_bytes

BLOCK_BITS = 16
BLOCKS = "block int, twice boolean, positions binary"


def key_of(line: bytes, min_chars: int) -> bytes | None:
    """The key under which a line is compared, or None for lines that are too short."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and code_points(key) < min_chars):
        return None
    return key


def positions(digests: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """``hashes`` bit positions in each key's block of 2**16 bits; the block is taken from other bits of the digest."""
    block = (digests >> np.uint64(64 - bits + BLOCK_BITS)) << np.uint64(BLOCK_BITS)
    return np.stack([block | ((digests >> np.uint64(BLOCK_BITS * i)) & np.uint64((1 << BLOCK_BITS) - 1)) for i in range(hashes)])


def twice_seen(docs: DataFrame, text_col: str, *, min_chars: int = 20, bits: int = 27, hashes: int = 2) -> np.ndarray:
    """The twice-seen filter as packed bits: 2**bits bits whatever the input, 16 MB at 27 bits.

    Too many lines for the filter make more of them suspects and never change a result.
    """
    schema = out_schema(BLOCKS)

    def blocks_of(found: np.ndarray, twice: bool, out: Rows) -> Iterator[pa.RecordBatch]:
        where, starts = np.unique(found >> np.uint64(BLOCK_BITS), return_index=True)
        for block, part in zip(where.tolist(), np.split(found, starts[1:]), strict=False):
            data = (part & np.uint64(0xFFFF)).astype("<u2").tobytes()
            if out.add((block, twice, data), len(data)):
                yield out.batch()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.empty(0, np.uint64), np.empty(0, np.uint64)
        pending: list[int] = []

        def fold(once: np.ndarray, again: np.ndarray, pending: list[int]) -> tuple[np.ndarray, np.ndarray]:
            new, counts = np.unique(np.array(pending, np.uint64), return_counts=True)
            met = new[(counts > 1) | np.isin(new, once, assume_unique=True)]
            return np.union1d(once, new), np.union1d(again, met)

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for (text,) in rows_of(batch, "text"):
                pending += {digest(k) for line in text.split(b"\n") if (k := key_of(line, min_chars)) is not None}
                if len(pending) >= 500_000:
                    once, again = fold(once, again, pending)
                    pending = []
        once, again = fold(once, again, pending)
        out = Rows(schema, 4 << 20)
        for keys, twice in ((once, False), (again, True)):
            if len(keys):
                yield from blocks_of(np.unique(positions(keys, bits, hashes)), twice, out)
        yield from out.rest()

    merged_schema = out_schema("block int, filter binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = None, Rows(merged_schema, 4 << 20)
        once = again = np.zeros(0, bool)
        for batch in batches:
            for block, twice, data in rows_of(batch, "block", "twice", "positions"):
                if block != current:
                    if current is not None and again.any() and out.add((current, np.packbits(again).tobytes()), again.size // 8):
                        yield out.batch()
                    current, once, again = block, np.zeros(1 << BLOCK_BITS, bool), np.zeros(1 << BLOCK_BITS, bool)
                at = np.frombuffer(data, "<u2")
                if twice:
                    again[at] = True
                else:
                    again[at[once[at]]] = True
                    once[at] = True
        if current is not None and again.any():
            out.add((current, np.packbits(again).tobytes()))
        yield from out.rest()

    sparse = docs.select(text_bytes(text_col).alias("text")).mapInArrow(collect, BLOCKS)
    merged = sparse.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(merge, "block int, filter binary")
    packed = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (BLOCK_BITS - 3)
    for row in merged.collect():  # at most 2**bits bits
        packed[row.block * width : (row.block + 1) * width] = np.frombuffer(row.filter, np.uint8)
    return packed


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, bits: int = 27, hashes: int = 2, prefix: str = "") -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, plus ``n_lines`` (before) and ``n_dropped`` (long).

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of ``min_chars`` code points
    or more that stand in ``min_docs`` documents or more keep their lines only in the largest id that holds them, there
    all of them. Null and empty texts have one empty line; a null text stays null. Rows with equal ids count as one
    document and are treated alike; rows with a null id keep all lines and count for no key. Columns named n_lines or
    n_dropped are replaced; all others pass through.
    ``prefix`` goes before the names of the new columns, for tables that have columns of these names.
    """
    spark = docs.sparkSession
    n_lines, n_dropped = f"{prefix}n_lines", f"{prefix}n_dropped"
    docs = docs.drop(n_lines, n_dropped)
    counted = docs.where(F.col(id_col).isNotNull())
    suspects = spark.sparkContext.broadcast(twice_seen(counted, text_col, min_chars=min_chars, bits=bits, hashes=hashes))

    def digests_of(text: bytes) -> list[tuple[bytes, bytes | None]]:
        return [(line, xxhash.xxh3_128_digest(k) if (k := key_of(line, min_chars)) is not None else None) for line in text.split(b"\n")]

    marked_type = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField("_rl_suspects", T.ArrayType(T.BinaryType()))])

    names, marked_names, final_names = docs.columns, [*docs.columns, n_lines, "_rl_suspects"], [*docs.columns, n_lines, n_dropped]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = suspects.value
        for batch in batches:
            keys: list[bytes] = []
            ends, lines = [], []
            for doc, text in rows_of(batch, id_col, "_rl_text"):
                parts = text.split(b"\n")
                lines.append(len(parts))
                if doc is not None:
                    keys += {k for line in parts if (k := key_of(line, min_chars)) is not None}
                ends.append(len(keys))
            found = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            hit = np.ones(len(keys), bool)
            for at in positions(found, bits, hashes):
                hit &= (packed[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            kept = np.flatnonzero(hit)
            offsets = np.searchsorted(kept, np.array([0, *ends]))
            digests = pa.array([xxhash.xxh3_128_digest(keys[i]) for i in kept.tolist()], pa.binary())
            arrays = [batch.column(n) for n in names]
            arrays += [pa.array(lines, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), digests)]
            yield pa.RecordBatch.from_arrays(arrays, names=marked_names)

    marked = saved(docs.withColumn("_rl_text", text_bytes(text_col)).mapInArrow(mark, marked_type), "marked-lines")
    held = marked.select(F.col(id_col).alias("_rl_id"), F.explode("_rl_suspects").alias("_rl_key")).distinct()
    repeated = held.groupBy("_rl_key").agg(F.count("*").alias("n"), F.max("_rl_id").alias("_rl_keeper")).where(F.col("n") >= min_docs)
    drops = held.join(repeated, "_rl_key").where("_rl_id <> _rl_keeper").groupBy("_rl_id").agg(F.collect_set("_rl_key").alias("_rl_drop"))

    clean = marked.where(F.size("_rl_suspects") == 0).select(*docs.columns, n_lines, F.lit(0).cast("long").alias(n_dropped))
    touched = marked.where(F.size("_rl_suspects") > 0).join(drops, F.col(id_col) == F.col("_rl_id"), "left").withColumn("_rl_text", text_bytes(text_col))
    final_type = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for text, drop in rows_of(batch, "_rl_text", "_rl_drop"):
                if drop:
                    gone = set(drop)
                    lines = digests_of(text)
                    kept = [line for line, digest in lines if digest not in gone]
                    texts.append(b"\n".join(kept))
                    dropped.append(len(lines) - len(kept))
                else:
                    texts.append(text)
                    dropped.append(0)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            arrays = [new if n == text_col else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(n_lines), pa.array(dropped, pa.int64())], names=final_names)

    return clean.unionByName(touched.select(*docs.columns, n_lines, "_rl_drop", "_rl_text").mapInArrow(cut, final_type))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(text_bytes("text"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key AND length(k.key) >= 20)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
