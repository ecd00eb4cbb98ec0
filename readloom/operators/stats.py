"""Whole-file statistics in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.schema import UNMAPPED

#: Order of the sections of the text form.
SECTIONS = ("records", "mapq", "flag", "insert_size")


def histogram(reads: DataFrame, key: Column, keep: Column | None = None) -> DataFrame:
    chosen = reads if keep is None else reads.where(keep)
    return chosen.groupBy(key.cast("long").alias("key")).agg(F.count("*").alias("value"))


def totals(reads: DataFrame) -> DataFrame:
    mapped = F.col("flag").bitwiseAND(F.lit(UNMAPPED)) == 0
    return reads.agg(F.count("*").alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"))


def stats(reads: DataFrame) -> DataFrame:
    """(section, key, value): each row gives its four facts, which one partial and one final aggregation count."""
    unmapped = F.col("flag").bitwiseAND(F.lit(UNMAPPED)) != 0
    fact = lambda section, key: F.struct(F.lit(section).alias("section"), key.cast("long").alias("key"))
    facts = F.array(fact("records", unmapped.cast("int")), fact("mapq", F.col("mapq")), fact("flag", F.col("flag")), fact("insert_size", F.nullif("template_length", F.lit(0))))
    return reads.select(F.inline(facts)).where((F.col("section") != "insert_size") | F.col("key").isNotNull()).groupBy("section", "key").agg(F.count("*").alias("value"))


def stats_tsv(reads: DataFrame) -> list[str]:
    """The lines of the text form; one for each distinct value, so the driver may hold them."""
    rows = {(r.section, r.key): r.value for r in stats(reads).collect()}
    mapped, unmapped = rows.pop(("records", 0), 0), rows.pop(("records", 1), 0)
    lines = ["metric\tvalue", f"records.total\t{mapped + unmapped}", f"records.mapped\t{mapped}", f"records.unmapped\t{unmapped}"]
    return lines + [f"{s}.{k}\t{v}" for (s, k), v in sorted(rows.items(), key=lambda x: (SECTIONS.index(x[0][0]), x[0][1]))]
