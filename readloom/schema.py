"""The fixed schema of reads, and errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class ReadsError(ValueError):
    """Any failure that the caller can mend; the text says what is wrong."""


#: Positions are 0-based; mate_pos is -1 where there is none; tags are TAB-joined.
READS = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name in ("flag", "pos", "mapq", "mate_pos", "template_length") else T.StringType())
        for name in ("qname", "flag", "ref", "pos", "mapq", "cigar", "mate_reference", "mate_pos", "template_length", "sequence", "quality", "tags")
    ]
)
CONTIGS = T.StructType([T.StructField("ref_id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("length", T.LongType())])

#: FLAG bits.
UNMAPPED, REVERSE, SECONDARY, DUPLICATE = 4, 16, 256, 1024


def project(reads: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The named columns in the given order, all without names; unknown names are an error."""
    if columns is None:
        return reads
    unknown = [c for c in columns if c not in reads.columns]
    if unknown:
        raise ReadsError(f"unknown columns: {', '.join(unknown)}")
    return reads.select(*columns)
