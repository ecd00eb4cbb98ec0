"""SAM text to columns and back, tags, qualities, codes and bins: column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of Illumina's eight quality bins: the highest quality of a bin, and what stands for it.
BINS = ((1, 0), (9, 6), (19, 15), (24, 22), (29, 27), (34, 33), (39, 37), (93, 40))


def _number(field: Column, label: str, low: int, high: int) -> Column:
    value = field.try_cast("long")
    sane = field.rlike("^-?[0-9]+$") & value.between(low, high)
    return F.when(field.isNull() | F.coalesce(sane, F.lit(False)), value).otherwise(F.raise_error(F.lit(f"invalid SAM {label}"))).cast("int")


def parse_sam(lines: DataFrame, line_col: str = "value", headers: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Reads from SAM lines, header lines left out. Mapped records must have a position.

    ``headers=False`` is for lines known to be records: a filter would be pushed below the expression that makes them, which would then run twice.
    """
    f = F.split(F.rtrim(line_col, F.lit("\r\n")), "\t", -1)
    header = F.col(line_col).startswith("@") | (F.col(line_col) == "") if headers else F.lit(False)
    # later filters may be pushed below this one, so a header line must be harmless in every expression
    body = lines.where(~header).select(F.when(header, F.lit(None)).when(F.size(f) < 11, F.raise_error(F.lit("SAM record has fewer than 11 fields"))).otherwise(f).alias("f"), *carry)
    at = lambda i: F.get("f", F.lit(i))
    pos, mate = _number(at(3), "POS", -(2**31), 2**31 - 1), _number(at(7), "PNEXT", -(2**31), 2**31 - 1)
    flag = _number(at(1), "FLAG", 0, 65535)
    return body.select(
        at(0).alias("qname"), flag.alias("flag"), at(2).alias("ref"),
        F.when((pos <= 0) & (flag.bitwiseAND(F.lit(4)) == 0), F.raise_error(F.lit("SAM POS must be positive for mapped records"))).otherwise(pos - 1).cast("int").alias("pos"),
        _number(at(4), "MAPQ", 0, 255).alias("mapq"), at(5).alias("cigar"), at(6).alias("mate_reference"),
        F.when(mate < 0, F.raise_error(F.lit("SAM PNEXT must be non-negative"))).otherwise(mate - 1).cast("int").alias("mate_pos"),
        _number(at(8), "TLEN", -(2**31), 2**31 - 1).alias("template_length"), at(9).alias("sequence"), at(10).alias("quality"),
        F.array_join(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), "\t").alias("tags"), *carry,
    )


def sam_line() -> Column:
    """The SAM text of a row, without line end."""
    return F.concat_ws(
        "\t", "qname", F.col("flag").cast("string"), "ref", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", "mate_reference",
        F.when(F.col("mate_pos") < 0, F.lit(0)).otherwise(F.col("mate_pos") + 1).cast("string"), F.col("template_length").cast("string"), "sequence", "quality", F.nullif(F.col("tags"), F.lit("")),
    )


def tag_items(tags: Column) -> Column:
    """array<struct<key,type,value>> in order; none for empty tags, an error for malformed ones."""
    item = lambda t: F.when((F.length(t) < 5) | (F.substring(t, 3, 1) != ":") | (F.substring(t, 5, 1) != ":"), F.raise_error(F.lit("malformed SAM tag"))).otherwise(
        F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 4, 1).alias("type"), F.substr(t, F.lit(6)).alias("value")))
    return F.when(tags == "", F.array().cast("array<struct<key:string,type:string,value:string>>")).otherwise(F.transform(F.split(tags, "\t"), item))


def tag_text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda t: F.concat_ws(":", t["key"], t["type"], t["value"])), "\t")


def canonical_tags(items: Column, keys: list[str]) -> Column:
    """The tags' text in the order of ``keys``, other keys after these in their own order."""
    place = lambda t: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, keys)), t["key"]), F.lit(0)), F.lit(len(keys) + 1))
    placed = F.transform(items, lambda t, i: F.struct(place(t).alias("place"), i.alias("i"), t.alias("t")))
    return tag_text(F.transform(F.array_sort(placed), lambda x: x["t"]))


def line_cigar(line: Column) -> Column:
    """The CIGAR field of SAM text, ``*`` where it is missing."""
    return F.coalesce(F.get(F.split(line, "\t", 7), F.lit(5)), F.lit("*"))


def bin_quality(quality: Column) -> Column:
    """Illumina's eight bins. A missing quality (``*``) stays."""
    low, chars, to = 0, "", ""
    for high, stands in BINS:
        chars += "".join(chr(33 + q) for q in range(low, high + 1))
        to += chr(33 + stands) * (high + 1 - low)
        low = high + 1
    return F.when(quality == "*", quality).otherwise(F.translate(quality, chars, to))


def zigzag(x: Column) -> Column:
    x = x.cast("long")
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def varint_size(x: Column) -> Column:
    """Bytes of an unsigned LEB128 number: seven bits each."""
    return F.greatest(F.lit(1), F.ceil(bit_width(x) / 7)).cast("long")


def bit_width(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("long")


def record_bytes() -> Column:
    """Estimated plain size: 15 fixed bytes, and four and the length for each of six strings."""
    return sum((F.octet_length(c) for c in ("qname", "cigar", "mate_reference", "sequence", "quality", "tags")), F.lit(15 + 6 * 4)).cast("long")


def level_offset(level: int) -> int:
    """The first bin of a level of the binning scheme: a level has eight times the bins of the one above."""
    return (8**level - 1) // 7


def metadata_bin(depth: int = 5) -> int:
    return level_offset(depth + 1) + 1


def bin_interval(bin_id: Column, min_shift: int = 14, depth: int = 5) -> tuple[Column, Column]:
    """Start and end that a bin covers; an error outside the regular bins."""
    start = end = F.raise_error(F.lit("BAM index bin id is outside the regular bin hierarchy")).cast("long")
    for level in range(depth, -1, -1):
        here = (bin_id >= level_offset(level)) & (bin_id < level_offset(level + 1))
        span = 1 << (min_shift + 3 * (depth - level))
        first = (bin_id.cast("long") - level_offset(level)) * span
        start, end = F.when(here, first).otherwise(start), F.when(here, first + span).otherwise(end)
    return start, end


def bin_of(start: Column, end: Column, min_shift: int = 14, depth: int = 5) -> Column:
    """The smallest bin that holds [start, end)."""
    out = F.lit(0).cast("long")
    for level in range(1, depth + 1):
        shift = min_shift + 3 * (depth - level)
        a, b = F.shiftright(start.cast("long"), shift), F.shiftright((end - 1).cast("long"), shift)
        out = F.when(a == b, a + level_offset(level)).otherwise(out)
    return out
