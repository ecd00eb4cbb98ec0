"""Sequences as differences from a reference."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from readloom.functions import cigar
from readloom.schema import ReadsError

#: The reference is joined in windows: a tile's bases and so many more, the longest stretch that one window serves.
TILE, REACH = 1 << 14, 1 << 16
FACTS = "mismatches array<struct<at:int,base:string>>, soft_clips string, insertions array<string>"


def tiles(contigs: DataFrame, tile: int = TILE, reach: int = REACH) -> DataFrame:
    """(ref, tile, window) of contigs (name, seq), upper-cased: rows of bounded size whatever the genome.

    Windows are bytes, of which a slice costs its own length; a slice of text walks the text.
    """
    n = F.greatest(F.lit(0), F.ceil(F.length("seq") / tile).cast("int") - 1)
    upper = contigs.select(F.col("name").alias("ref"), F.upper("seq").cast("binary").alias("bases"), n.alias("n"))
    return upper.select("ref", "bases", F.explode(F.sequence(F.lit(0), "n")).alias("tile")).select("ref", F.col("tile").cast("long").alias("tile"), F.substr("bases", F.col("tile") * tile + 1, F.lit(tile + reach)).alias("window"))


def with_reference(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads with ``ref_bases``, what the reference has under them; N where it ends or is unknown.

    Reads that span more than a window's reach enter every tile they meet, and their bases are gathered.
    """
    span = F.col("end_pos") - F.col("pos")
    long = F.coalesce(span > REACH, F.lit(False))
    slice_of = lambda start, n: F.substr(F.coalesce("window", F.lit(b"")), (start - F.col("tile") * TILE + 1).cast("int"), n.cast("int")).cast("string")
    at = reads.where(~long).withColumn("tile", F.floor(F.col("pos") / TILE))
    near = at.join(windows, ["ref", "tile"], "left").withColumn("ref_bases", slice_of(F.col("pos"), span)).select(*reads.columns, "ref_bases")
    met = F.sequence(F.floor(F.col("pos") / TILE), F.floor((F.col("end_pos") - 1) / TILE))
    row = F.struct(*reads.columns).alias("row")
    pieces = reads.where(long).select("ref", "pos", "end_pos", row, F.monotonically_increasing_id().alias("read"), met.alias("met")).withColumn("tile", F.explode("met"))
    start, stop = F.greatest("pos", F.col("tile") * TILE), F.least("end_pos", (F.col("tile") + 1) * TILE)
    found = pieces.join(windows, ["ref", "tile"], "left").select("read", "row", "tile", slice_of(start, stop - start).alias("bases"))
    whole = found.groupBy("read").agg(F.first("row").alias("row"), F.array_sort(F.collect_list(F.struct("tile", "bases"))).alias("parts"))
    return near.unionByName(whole.select("row.*", F.array_join("parts.bases", "").alias("ref_bases")))


def walk(parts: Sequence[tuple[int, str]], sequence: str, ref_bases: str) -> tuple[np.ndarray, str, list[str]]:
    """Query offsets of mismatches, soft-clipped bases, insertions."""
    mismatches, clips, insertions, q, r = [np.zeros(0, np.int32)], [], [], 0, 0
    query, under = np.frombuffer(sequence.encode(), np.uint8), np.frombuffer(ref_bases.encode(), np.uint8)
    for n, op in parts:
        if op in cigar.COVER + "IS" and q + n > len(sequence):
            raise ReadsError("the CIGAR is longer than the sequence")
        if op in cigar.COVER:
            have = under[r : r + n]
            if len(have) < n:
                have = np.append(have, np.full(n - len(have), ord("N"), np.uint8))
            mismatches.append((np.flatnonzero(query[q : q + n] != have) + q).astype(np.int32))
        elif op == "I":
            insertions.append(sequence[q : q + n])
        elif op == "S":
            clips.append(sequence[q : q + n])
        r += n * (op in cigar.CONSUME)
        q += n * (op in cigar.COVER + "IS")
    return np.concatenate(mismatches), "".join(clips), insertions


def rebuild(parts: Sequence[tuple[int, str]], ref_bases: str, at: np.ndarray, bases: np.ndarray, clips: str, insertions: list[str]) -> str:
    """The sequence that ``walk`` has taken apart, from the mismatches' offsets and bases."""
    out, r, c, i = [], 0, 0, 0
    for n, op in parts:
        if op in cigar.COVER:
            out.append(ref_bases[r : r + n].ljust(n, "N"))
        elif op == "I":
            out.append(insertions[i])
            i += 1
        elif op == "S":
            out.append(clips[c : c + n])
            c += n
        r += n * (op in cigar.CONSUME)
    made = np.frombuffer("".join(out).encode(), np.uint8).copy()
    made[at] = bases
    return made.tobytes().decode()


@lru_cache(maxsize=1 << 16)
def _parts(text: str) -> tuple[tuple[int, str], ...]:
    return tuple((int(n), op) for n, op in re.findall(cigar.PART, text))


def _mapped(frame: DataFrame, made, drop: tuple[str, ...], ddl: str) -> DataFrame:
    """Adds columns that ``made`` gives for an Arrow batch, and leaves some out."""
    added = T.StructType.fromDDL(ddl)
    schema = T.StructType([*(f for f in frame.schema.fields if f.name not in drop), *added.fields])
    names, new = [n for n in frame.columns if n not in drop], added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made(batch)], names=[*names, *new])

    return frame.mapInArrow(run, schema)


def encode(reads: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads without their sequence but with ``FACTS``, for reads with a concrete CIGAR and a sequence of ACGT."""
    able = reads.where(F.col("sequence").rlike("^[ACGT]+$") & ~cigar.absent(F.col("cigar")))
    arrow = to_arrow_schema(T.StructType.fromDDL(FACTS))

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        at, bases, ends, clips, insertions = [], [], [0], [], []
        for text, sequence, under in zip(*(batch.column(n).to_pylist() for n in ("cigar", "sequence", "ref_bases")), strict=True):
            offsets, soft, extra = walk(_parts(text), sequence, under)
            at.append(offsets)
            bases.append(np.frombuffer(sequence.encode(), np.uint8)[offsets])
            ends.append(ends[-1] + len(offsets))
            clips.append(soft)
            insertions.append(extra)
        n, flat = ends[-1], np.concatenate([np.zeros(0, np.uint8), *bases])
        base = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(n + 1, dtype=np.int32)), pa.py_buffer(flat))
        item = arrow.field("mismatches").type.value_type
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *at]), pa.int32()), base], fields=list(item))
        offsets = pa.array(ends, pa.int32())
        return [pa.ListArray.from_arrays(offsets, pairs, type=arrow.field("mismatches").type), pa.array(clips, pa.string()), pa.array(insertions, arrow.field("insertions").type)]

    return _mapped(with_reference(able, windows), made, ("sequence", "ref_bases"), FACTS)


def decode(delta: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads with their sequence again."""

    def made(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column("mismatches")
        ends = lists.offsets.to_numpy()
        pairs = lists.values  # offsets count from its start, also where the batch is a slice
        at, base = pairs.field("at").to_numpy(), np.frombuffer("".join(pairs.field("base").to_pylist()).encode(), np.uint8)
        rows = zip(*(batch.column(n).to_pylist() for n in ("cigar", "ref_bases", "soft_clips", "insertions")), strict=True)
        return [pa.array([rebuild(_parts(text), under, at[a:b], base[a:b], clips, extra) for (text, under, clips, extra), a, b in zip(rows, ends, ends[1:], strict=False)], pa.string())]

    return _mapped(with_reference(delta, windows), made, ("ref_bases", "mismatches", "soft_clips", "insertions"), "sequence string")
