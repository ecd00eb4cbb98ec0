"""Regions and record filters as predicates that Catalyst can push down."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.schema import ReadsError

INT_MAX = 2**31 - 1


@dataclass(frozen=True)
class Region:
    """Half-open and 0-based."""

    ref: str
    start: int
    end: int


def _positive(text: str, label: str) -> int:
    if not re.fullmatch("[0-9]+", text, re.A):
        raise ReadsError(f"invalid {label}")
    value = int(text)
    if value > INT_MAX:
        raise ReadsError(f"{label} is too large")
    if value == 0:
        raise ReadsError(f"{label} must be positive")
    return value


def parse_region(text: str) -> Region:
    """``ref:start-end``, closed and from 1. The first colon ends the name."""
    m = re.fullmatch(r"([^:]+):([^-]+)-(.+)", text, re.S)
    if not m:
        raise ReadsError("region must use ref:start-end")
    start, end = _positive(m[2], "start"), _positive(m[3], "end")
    if start > end:
        raise ReadsError("region start must be <= end")
    return Region(m[1], start - 1, end)


def parse_region_last_colon(text: str) -> Region:
    """The lenient form of the table readers: the last colon ends the name; order and sign aren't checked."""
    m = re.fullmatch(r"(.*):([^:-]*)-([^:]*)", text, re.S)
    try:
        return Region(m[1], int(m[2]) - 1, int(m[3]))
    except (TypeError, ValueError):
        raise ReadsError(f"invalid region: {text}") from None


def overlaps(start: Column, end: Column, low: int | Column, high: int | Column) -> Column:
    return (start < high) & (end > low)


def flag_excludes(mask: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(mask)) == 0


def record_filter(flag_exclude: int = 0, min_mapq: int = 0) -> Column | None:
    """None where nothing is filtered, so that plans hold no idle predicate."""
    if not 0 <= flag_exclude <= 0xFFFF or not 0 <= min_mapq <= 0xFF:
        raise ReadsError("flag_exclude must fit 16 bits and min_mapq 8 bits")
    parts = [flag_excludes(flag_exclude)] * bool(flag_exclude) + [F.col("mapq") >= min_mapq] * bool(min_mapq)
    return reduce(and_, parts) if parts else None


def in_region(region: Region) -> Column:
    """Needs ``end_pos``; ref and pos, and a stored end_pos, are pushed to the scan."""
    return (F.col("ref") == region.ref) & overlaps(F.col("pos"), F.col("end_pos"), region.start, region.end)
