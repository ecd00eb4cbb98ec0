"""CIGAR algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations in the order of their codes; those that consume the reference, and those that cover it.
OPS, CONSUME, COVER = "MIDNSHP=X", "MDN=X", "M=X"
PART = "([0-9]+)([MIDNSHP=X])"
INT_MAX = 2**31 - 1


def absent(cigar: Column) -> Column:
    return (cigar == "") | (cigar == "*")


def tokens(cigar: Column) -> Column:
    """array<struct<len:bigint,op:string>>; empty for ``*``."""
    lengths = F.regexp_extract_all(cigar, F.lit(PART), F.lit(1))
    return F.zip_with(lengths, F.regexp_extract_all(cigar, F.lit(PART), F.lit(2)), lambda n, op: F.struct(n.cast("long").alias("len"), op.alias("op")))


def op_code(op: Column) -> Column:
    return F.instr(F.lit(OPS), op) - 1


def _sum(parts: Column, ops: str) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, t: a + F.when(F.lit(ops).contains(t["op"]), t["len"]).otherwise(F.lit(0).cast("long")))


def reference_span(cigar: Column) -> Column:
    """Reference bases from the first to the last, at least 1; 1 for an absent CIGAR. Malformed text is an error."""
    parts = tokens(cigar)
    span = _sum(parts, CONSUME)
    # possessive repeats: matched in a loop, where others recurse and overflow the stack on long texts
    checked = (
        F.when(~cigar.rlike("^(0*[1-9][0-9]*[A-Za-z=])++$"), F.raise_error(F.lit("invalid CIGAR string")))
        .when(~cigar.rlike(f"^([0-9]+[{OPS}])++$"), F.raise_error(F.lit("invalid CIGAR operation")))
        .when(F.exists(parts, lambda t: t["len"] > INT_MAX), F.raise_error(F.lit("CIGAR operation length is too large")))
        .when(span > INT_MAX, F.raise_error(F.lit("CIGAR reference span is too large")))
        .otherwise(F.greatest(span, F.lit(1).cast("long")))
    )
    return F.when(absent(cigar), F.lit(1).cast("long")).otherwise(checked)


def blocks(pos: Column, cigar: Column) -> Column:
    """array<struct<start,end>> of the stretches that cover reference bases. One pass carries the position along.

    The array is copied as it grows: for reads of thousands of operations use ``operators.depth.covered``.
    """
    step = lambda acc, t: F.struct(
        (acc["at"] + F.when(F.lit(CONSUME).contains(t["op"]), t["len"]).otherwise(F.lit(0).cast("long"))).alias("at"),
        F.when(F.lit(COVER).contains(t["op"]), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + t["len"]).alias("end"))))).otherwise(acc["found"]).alias("found"),
    )
    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("found"))
    return F.aggregate(tokens(cigar), start, step, lambda acc: acc["found"])
