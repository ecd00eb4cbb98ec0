"""A reads relation made of an order table, by arithmetic that every SQL engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import cigar

#: CIGARs by line number.
CIGARS = ("100M", "5S60M2D30M", "40M3I57M", "30M1000N70M", "2H50=1X49=", "*", "10S80M1P5M5S")
HEX, BASES, QUALITIES = "0123456789abcdef", "ACGTACGTACGTACGT", "#-27:<?BDFFFFIII"


def _letters(salt: str, alphabet: str) -> str:
    whole = " || ".join(f"md5(qname || '{salt}{k}')" for k in range(4))
    return f"CASE WHEN l_linenumber = 6 THEN '*' ELSE substring(translate({whole}, '{HEX}', '{alphabet}'), 1, CASE WHEN l_linenumber = 2 THEN 95 ELSE 100 END) END"


_CIGAR = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CIGARS, 1)) + " END"
_COLUMNS = f"""qname,
  cast(CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 1024 ELSE 0 END
     + CASE WHEN l_linenumber >= 6 THEN 256 ELSE 0 END + CASE WHEN l_orderkey % 40 = 0 THEN 4 ELSE 0 END AS int) AS flag,
  'chr' || cast(l_suppkey % 5 + 1 AS varchar(20)) AS ref,
  cast((l_partkey * 37 + l_orderkey * 11 + l_linenumber * 3) % 100000 AS int) AS pos,
  cast((cast(l_quantity AS int) * 7 + l_linenumber) % 61 AS int) AS mapq,
  {_CIGAR} AS cigar,
  CASE WHEN l_orderkey % 7 = 0 THEN '*' WHEN l_suppkey % 2 = 0 THEN '=' ELSE 'chr' || cast(l_partkey % 5 + 1 AS varchar(20)) END AS mate_reference,
  cast(CASE WHEN l_orderkey % 7 = 0 THEN -1 ELSE (l_partkey * 5 + l_linenumber) % 1000 END AS int) AS mate_pos,
  cast((l_orderkey * 13 + l_linenumber * 7) % 801 - 400 AS int) AS template_length,
  {_letters('', BASES)} AS sequence,
  {_letters('q', QUALITIES)} AS quality,
  CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber % 2 = 0 THEN 'NM:i:' || cast(l_partkey % 7 - 3 AS varchar(20))
       ELSE 'NM:i:' || cast(l_partkey % 7 AS varchar(20)) || {{tab}} || 'RG:Z:g' || cast(l_suppkey % 3 AS varchar(20)) END AS tags"""
_NAMED = "SELECT *, 'r' || cast(l_orderkey AS varchar(20)) || '.' || cast(l_linenumber AS varchar(20)) || '.' || cast(l_partkey AS varchar(20)) || '.' || cast(l_suppkey AS varchar(20)) AS qname FROM {source}"

#: The same relation for DuckDB, to stand at the head of a query.
SQL = f"""WITH reads0 AS (SELECT {_COLUMNS.format(tab='chr(9)')} FROM ({_NAMED.format(source='lineitem')})),
reads AS (
  SELECT *, pos + greatest(1, list_sum([CASE WHEN t[2] IN ('M','D','N','=','X') THEN t[1]::BIGINT ELSE 0 END
    FOR t IN list_zip(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2))]) ) AS end_raw,
  FROM reads0),
r AS (SELECT * EXCLUDE (end_raw), coalesce(end_raw, pos + 1)::BIGINT AS end_pos FROM reads)
"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with ``end_pos``; columns that a query doesn't use are never computed."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cores = spark.sparkContext.defaultParallelism
    if items._jdf.queryExecution().toRdd().getNumPartitions() < cores:  # a small file of one row group would keep one core busy
        items = items.repartition(cores)
    named = "'r' || cast(l_orderkey AS string) || '.' || cast(l_linenumber AS string) || '.' || cast(l_partkey AS string) || '.' || cast(l_suppkey AS string)"
    columns = _COLUMNS.format(tab="char(9)").replace("varchar(20)", "string")
    made = items.withColumn("qname", F.expr(named))
    parts = [x for x in _split(columns)]
    return made.selectExpr(*parts).withColumn("end_pos", F.col("pos") + cigar.reference_span(F.col("cigar")))


def _split(columns: str) -> list[str]:
    """Cuts a select list at commas outside brackets and quotes."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(columns):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(columns[at:i].strip())
                at = i + 1
    return [*out, columns[at:].strip()]
