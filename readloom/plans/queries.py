"""Registered queries over the derived reads relation, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from readloom.functions import cigar, records
from readloom.functions.region import flag_excludes, in_region, parse_region, record_filter
from readloom.operators import chunking, codec_bytes, codecs, depth, refdelta, stats
from readloom.schema import DUPLICATE, UNMAPPED, project
from readloom.sources import derived

REGION = parse_region("chr2:20001-60000")
MASK, MAPQ = UNMAPPED + DUPLICATE, 20
CHUNK = 1 << 14
POLICY = chunking.Policy(target_bytes=24_000, max_bytes=25_000, max_records=90, max_span=1_500)
QUERIES: dict = {}
ORACLES: dict = {}
HEAD = derived.SQL
HIT = "ref = 'chr2' AND pos < 60000 AND end_pos > 20000"
KEEP = "(flag & 1028) = 0 AND mapq >= 20"
TOKENS = "list_zip(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1), regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2))"
CHUNKED = ", c AS (SELECT *, pos // 16384 AS chunk FROM r) "


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(derived.reads(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        ORACLES[f.__name__] = HEAD + sql
        return f

    return add


def longs(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def varint(x: str) -> str:
    return f"((length(bin(({x})::BIGINT)) + 6) // 7)"


def chunked(reads: DataFrame) -> DataFrame:
    return reads.withColumn("chunk", F.floor(F.col("pos") / CHUNK))


@query(f"SELECT qname, flag::BIGINT AS flag, pos::BIGINT AS pos, mapq::BIGINT AS mapq, cigar, end_pos FROM r WHERE {HIT}")
def region_scan(reads):
    return longs(reads.where(in_region(REGION)).select("qname", "flag", "pos", "mapq", "cigar", "end_pos"))


@query(f"SELECT qname, flag::BIGINT AS flag, pos::BIGINT AS pos, mapq::BIGINT AS mapq, template_length::BIGINT AS template_length FROM r WHERE {HIT} AND {KEEP}")
def region_scan_filtered(reads):
    return longs(reads.where(in_region(REGION) & record_filter(MASK, MAPQ)).select("qname", "flag", "pos", "mapq", "template_length"))


SAM = "concat_ws(chr(9), qname, flag, ref, pos + 1, mapq, cigar, mate_reference, CASE WHEN mate_pos < 0 THEN 0 ELSE mate_pos + 1 END, template_length, sequence, quality, nullif(tags, ''))"


@query(f"SELECT {SAM} AS sam_line FROM r WHERE {HIT} AND {KEEP}")
def view_sam_text(reads):
    return reads.where(in_region(REGION) & record_filter(MASK, MAPQ)).orderBy("pos", "qname").select(records.sam_line().alias("sam_line"))


@query("SELECT ref, count(*) AS n FROM r WHERE (flag & 1028) = 0 GROUP BY ref")
def flag_exclude(reads):
    return reads.where(flag_excludes(MASK)).groupBy("ref").agg(F.count("*").alias("n"))


@query("SELECT ref, count(*) AS n FROM r WHERE mapq >= 20 GROUP BY ref")
def min_mapq(reads):
    return reads.where(record_filter(0, MAPQ)).groupBy("ref").agg(F.count("*").alias("n"))


@query("SELECT cigar, (end_pos - pos)::BIGINT AS span, count(*) AS n FROM r GROUP BY ALL")
def cigar_span(reads):
    return reads.groupBy("cigar", cigar.reference_span(F.col("cigar")).alias("span")).agg(F.count("*").alias("n"))


@query(f"SELECT t[2] AS op, (instr('MIDNSHP=X', t[2]) - 1)::BIGINT AS code, count(*) AS n, sum(t[1]::BIGINT)::BIGINT AS bases FROM (SELECT unnest({TOKENS}) AS t FROM r) GROUP BY ALL")
def cigar_tokens(reads):
    t = reads.select(F.explode(cigar.tokens(F.col("cigar"))).alias("t"))
    return longs(t.groupBy("t.op", cigar.op_code(F.col("t.op")).alias("code")).agg(F.count("*").alias("n"), F.sum("t.len").alias("bases")))


BLOCKS = f"""
, tok AS (SELECT *, {TOKENS} AS ts FROM r),
prt AS (SELECT * EXCLUDE (ts), ts[i][2] AS op, ts[i][1]::BIGINT AS len, i,
        pos + coalesce(list_sum([CASE WHEN x[2] IN ('M','D','N','=','X') THEN x[1]::BIGINT ELSE 0 END FOR x IN ts[1:i - 1]]), 0) AS s,
        coalesce(list_sum([CASE WHEN x[2] IN ('M','I','S','=','X') THEN x[1]::BIGINT ELSE 0 END FOR x IN ts[1:i - 1]]), 0) AS q
        FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM tok)),
blk AS (SELECT *, s AS b0, s + len AS b1 FROM prt WHERE op IN ('M','=','X'))
"""


@query(BLOCKS + "SELECT qname, pos::BIGINT AS pos, b0::BIGINT AS block_start, b1::BIGINT AS block_end FROM blk")
def cigar_blocks(reads):
    return longs(reads.select("qname", "pos", F.explode(cigar.blocks(F.col("pos"), F.col("cigar"))).alias("b")).select("qname", "pos", F.col("b.start").alias("block_start"), F.col("b.end").alias("block_end")))


def depth_sql(extra: str) -> str:
    return f"{BLOCKS}, dep AS (SELECT p AS pos, count(*) AS depth FROM (SELECT unnest(range(greatest(b0, 20000)::BIGINT, least(b1, 60000)::BIGINT)) AS p FROM blk WHERE {HIT} AND (flag & 4) = 0 {extra}) GROUP BY p) "


@query(depth_sql("") + "SELECT 'chr2' AS ref, pos, depth FROM dep")
def depth_region(reads):
    return depth.depth(reads, REGION)


@query(depth_sql(f"AND {KEEP}") + "SELECT 'chr2' AS ref, g AS pos, coalesce(depth, 0) AS depth FROM range(20000, 60000) t(g) LEFT JOIN dep ON g = pos")
def depth_all_positions(reads):
    return depth.depth(reads, REGION, MASK, MAPQ, all_positions=True)


@query(depth_sql(f"AND {KEEP}") + "SELECT 'chr2' AS ref, pos, depth FROM dep")
def depth_filtered(reads):
    return depth.depth(reads, REGION, MASK, MAPQ)


@query(depth_sql(f"AND {KEEP}") + f"SELECT 'chr2' AS reference, 20001::BIGINT AS start, 60000::BIGINT AS \"end\", 40000::BIGINT AS bases, (SELECT count(*) FROM r WHERE {HIT} AND {KEEP}) AS records, count(*) AS covered_bases, sum(depth)::BIGINT AS total_depth, sum(depth)::BIGINT / 40000.0::DOUBLE AS mean_depth FROM dep")
def depth_summary(reads):
    return depth.summary(reads, REGION, MASK, MAPQ)


@query("SELECT count(*) AS total, count(*) FILTER ((flag & 4) = 0) AS mapped, count(*) FILTER ((flag & 4) <> 0) AS unmapped FROM r")
def stats_totals(reads):
    return stats.totals(reads)


@query("SELECT mapq::BIGINT AS key, count(*) AS value FROM r GROUP BY mapq")
def stats_mapq_hist(reads):
    return stats.histogram(reads, F.col("mapq"))


@query("SELECT flag::BIGINT AS key, count(*) AS value FROM r GROUP BY flag")
def stats_flag_hist(reads):
    return stats.histogram(reads, F.col("flag"))


@query("SELECT template_length::BIGINT AS key, count(*) AS value FROM r WHERE template_length <> 0 GROUP BY template_length")
def stats_tlen_hist(reads):
    return stats.histogram(reads, F.col("template_length"), F.col("template_length") != 0)


@query("SELECT 'records' AS section, CASE WHEN (flag & 4) <> 0 THEN 1 ELSE 0 END::BIGINT AS key, count(*) AS value FROM r GROUP BY ALL UNION ALL SELECT 'mapq', mapq, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'flag', flag, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'insert_size', template_length, count(*) FROM r WHERE template_length <> 0 GROUP BY ALL")
def stats_all(reads):
    return stats.stats(reads)


@query("SELECT ref, min(pos)::BIGINT AS start_pos, max(end_pos)::BIGINT AS end_pos, count(*) AS record_count FROM r WHERE (flag & 4) = 0 GROUP BY ref")
def block_bounds_per_contig(reads):
    return longs(reads.where(flag_excludes(UNMAPPED)).groupBy("ref").agg(F.min("pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("record_count")))


PACK = """
, m AS (SELECT ref, {{'s': pos::BIGINT, 'e': end_pos::BIGINT, 'b': (39 + strlen(qname) + strlen(cigar) + strlen(mate_reference) + strlen(sequence) + strlen(quality) + strlen(tags))::BIGINT}} AS x, pos, qname FROM r WHERE (flag & 4) = 0),
packed AS (
  SELECT ref, list_reduce(list({{'id': 0::BIGINT, 's': x.s, 'e': x.e, 'n': 1::BIGINT, 'b': x.b, 'done': [{{'id': -1::BIGINT, 's': 0::BIGINT, 'e': 0::BIGINT, 'n': 0::BIGINT, 'b': 0::BIGINT}}]}} ORDER BY pos, qname),
    lambda a, y: CASE WHEN a.b >= {target} OR a.n + 1 > {records} OR a.b + y.b > {most} OR greatest(a.e, y.e) - least(a.s, y.s) > {span}
      THEN {{'id': a.id + 1, 's': y.s, 'e': y.e, 'n': 1::BIGINT, 'b': y.b, 'done': list_append(a.done, {{'id': a.id, 's': a.s, 'e': a.e, 'n': a.n, 'b': a.b}})}}
      ELSE {{'id': a.id, 's': least(a.s, y.s), 'e': greatest(a.e, y.e), 'n': a.n + 1, 'b': a.b + y.b, 'done': a.done}} END) AS z
  FROM m GROUP BY ref),
chunks AS (
  SELECT ref, d.id AS chunk_id, d.s AS start_pos, d.e AS end_pos, d.n AS record_count, d.b AS bytes
  FROM (SELECT ref, unnest(list_append(z.done, {{'id': z.id, 's': z.s, 'e': z.e, 'n': z.n, 'b': z.b}})) AS d FROM packed) WHERE d.id >= 0)
""".format(target=POLICY.target_bytes, most=POLICY.max_bytes, records=POLICY.max_records, span=POLICY.max_span)


def packed(reads: DataFrame) -> DataFrame:
    return chunking.pack(reads.where(flag_excludes(UNMAPPED)), POLICY)


@query(PACK + "SELECT * FROM chunks")
def chunk_pack(reads):
    return packed(reads)


@query(PACK + "SELECT ref, chunk_id, start_pos, end_pos, end_pos - start_pos AS span, record_count, (sum(bytes) OVER (PARTITION BY ref ORDER BY chunk_id) - bytes)::BIGINT AS plain_offset, bytes AS plain_length FROM chunks")
def chunk_index(reads):
    w = Window.partitionBy("ref").orderBy("chunk_id")
    return packed(reads).select("ref", "chunk_id", "start_pos", "end_pos", (F.col("end_pos") - F.col("start_pos")).alias("span"), "record_count", (F.sum("bytes").over(w) - F.col("bytes")).alias("plain_offset"), F.col("bytes").alias("plain_length"))


@query(PACK + "SELECT ref, chunk_id, start_pos, end_pos, record_count FROM chunks WHERE ref = 'chr2' AND start_pos < 60000 AND end_pos > 20000")
def chunk_query(reads):
    return chunking.query_chunks(packed(reads), REGION).select("ref", "chunk_id", "start_pos", "end_pos", "record_count")


@query(PACK + "SELECT count(*) AS chunks, sum(record_count)::BIGINT AS total_records, min(record_count) AS min_records, max(record_count) AS max_records, avg(record_count) AS avg_records, min(end_pos - start_pos) AS min_span, max(end_pos - start_pos) AS max_span, avg(end_pos - start_pos) AS avg_span, min(bytes) AS min_bytes, max(bytes) AS max_bytes, avg(bytes) AS avg_bytes FROM chunks")
def chunk_summary(reads):
    return chunking.chunk_summary(packed(reads))


@query("SELECT ref, (pos // 16384 * 16384)::BIGINT AS start, (pos // 16384 * 16384 + 16384)::BIGINT AS \"end\", min(pos)::BIGINT AS chunk_offset, max(end_pos)::BIGINT AS column_index_offset FROM r WHERE ref = 'chr2' AND pos // 16384 * 16384 < 60000 AND pos // 16384 * 16384 + 16384 > 20000 GROUP BY ALL")
def interval_index_query(reads):
    start = F.floor(F.col("pos") / CHUNK) * CHUNK
    index = reads.groupBy("ref", start.alias("start"), (start + CHUNK).alias("end")).agg(F.min("pos").alias("chunk_offset"), F.max("end_pos").alias("column_index_offset"))
    return longs(index.where((F.col("ref") == REGION.ref) & (F.col("start") < REGION.end) & (F.col("end") > REGION.start)).orderBy("start", "end", "chunk_offset"))


@query("SELECT g AS region_id, count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM r JOIN (SELECT g, 'chr' || (g % 5 + 1) AS rr, g * 997 % 90000 AS a, g * 997 % 90000 + 500 + g * 131 % 20000 AS b FROM range(0, 200) t(g)) ON ref = rr AND pos < b AND end_pos > a GROUP BY g")
def overlap_join_regions(reads):
    g = F.col("id")
    start = g * 997 % 90000
    regions = reads.sparkSession.range(200).select(g.alias("region_id"), F.concat(F.lit("chr"), (g % 5 + 1).cast("string")).alias("region_ref"), start.alias("region_start"), (start + 500 + g * 131 % 20000).alias("region_end"))
    return chunking.overlap_join(reads.select("ref", "pos", "end_pos"), regions).groupBy("region_id").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query(CHUNKED + f"SELECT ref, chunk::BIGINT AS chunk, count(*) AS n, sum(d)::BIGINT AS last_pos, sum({varint('d')})::BIGINT AS bytes FROM (SELECT ref, chunk, pos - coalesce(lag(pos) OVER (PARTITION BY ref, chunk ORDER BY pos, qname), 0) AS d FROM c) GROUP BY ref, chunk")
def pos_delta(reads):
    return codecs.pos_delta(chunked(reads))


RUNS = CHUNKED + f"""
, f AS (SELECT ref, chunk, pos, qname, coalesce((mapq <> lag(mapq) OVER (PARTITION BY ref, chunk ORDER BY pos, qname))::INT, 1) AS new FROM c),
i AS (SELECT ref, chunk, sum(new) OVER (PARTITION BY ref, chunk ORDER BY pos, qname ROWS UNBOUNDED PRECEDING) AS run FROM f),
l AS (SELECT ref, chunk, run, count(*) AS length FROM i GROUP BY ALL),
runs AS (SELECT ref, chunk::BIGINT AS chunk, count(*) AS runs, max(length) AS longest, sum({varint('length')} + 1)::BIGINT AS bytes FROM l GROUP BY ref, chunk)
"""


@query(RUNS + "SELECT * FROM runs")
def mapq_runs(reads):
    return codecs.mapq_runs(chunked(reads))


WIDTH = "CASE WHEN max(flag) = 0 THEN 0 ELSE length(bin(max(flag)::BIGINT)) END"


@query(CHUNKED + f"SELECT ref, chunk::BIGINT AS chunk, count(*) AS n, {WIDTH}::BIGINT AS bits, (1 + ceil(count(*) * ({WIDTH}) / 8.0))::BIGINT AS bytes FROM c GROUP BY ref, chunk")
def flag_bit_width(reads):
    return codecs.flag_width(chunked(reads))


def dictionary_sql(column: str, front: bool) -> str:
    shared = f"coalesce(list_sum(list_transform(range(1, least(length(prev), length({column})) + 1), lambda k: (prev[1:k] = {column}[1:k])::INT)), 0)" if front else "0"
    head = f"CASE WHEN k > 0 THEN {varint('shared')} ELSE 0 END" if front else "0"
    return CHUNKED + f"""
, u AS (SELECT ref, chunk, {column}, count(*) AS uses FROM c GROUP BY ALL),
o AS (SELECT *, lag({column}) OVER w AS prev, row_number() OVER w - 1 AS k FROM u WINDOW w AS (PARTITION BY ref, chunk ORDER BY {column})),
s AS (SELECT ref, chunk, uses, k, strlen({column}) AS size, {shared}::BIGINT AS shared FROM o),
dict AS (SELECT ref, chunk::BIGINT AS chunk, sum(uses)::BIGINT AS n, count(*) AS entries, sum(shared)::BIGINT AS shared,
         ({varint('count(*)')} + sum({head} + {varint('size - shared')} + size - shared + uses * {varint('k')}))::BIGINT AS bytes FROM s GROUP BY ref, chunk)
"""


@query(dictionary_sql("qname", True) + "SELECT * FROM dict")
def qname_front_coding(reads):
    return codecs.dictionary(chunked(reads), "qname", front_coded=True)


@query(dictionary_sql("cigar", False) + "SELECT * FROM dict")
def cigar_dictionary(reads):
    return codecs.dictionary(chunked(reads), "cigar")


@query(CHUNKED + "SELECT ref, chunk::BIGINT AS chunk, count(DISTINCT ch) AS alphabet, string_agg(DISTINCT ch, '' ORDER BY ch) AS letters FROM (SELECT ref, chunk, unnest(string_split(quality, '')) AS ch FROM c WHERE quality <> '*') WHERE ch <> '' GROUP BY ref, chunk")
def qual_alphabet(reads):
    letters = chunked(reads).where("quality <> '*'").select("ref", "chunk", F.explode(F.array_distinct(F.split("quality", ""))).alias("ch")).where("ch <> ''")
    return letters.groupBy("ref", "chunk").agg(F.count_distinct("ch").alias("alphabet"), F.array_join(F.array_sort(F.collect_set("ch")), "").alias("letters"))


QRUNS = "(1 + list_sum(list_transform(range(2, length(quality) + 1), lambda k: (quality[k] <> quality[k - 1])::INT)))"


@query(CHUNKED + f"SELECT ref, chunk::BIGINT AS chunk, count(*) AS n, sum({QRUNS})::BIGINT AS runs FROM c WHERE quality <> '*' GROUP BY ref, chunk")
def qual_rle_runs(reads):
    return codecs.quality_facts(chunked(reads).where("quality <> '*'")).groupBy("ref", "chunk").agg(F.count("*").alias("n"), F.sum("n_runs").alias("runs"))


def _bins() -> tuple[str, str]:
    chars = to = ""
    low = 0
    for high, stands in records.BINS:
        chars += "".join(chr(33 + q) for q in range(low, high + 1))
        to += chr(33 + stands) * (high + 1 - low)
        low = high + 1
    return chars.replace("'", "''"), to.replace("'", "''")


@query(f"SELECT qname, pos::BIGINT AS pos, CASE WHEN quality = '*' THEN quality ELSE translate(quality, '{_bins()[0]}', '{_bins()[1]}') END AS binned FROM r")
def qual_illumina8(reads):
    return longs(reads.select("qname", "pos", records.bin_quality(F.col("quality")).alias("binned")))


SEQ2 = f"CASE WHEN regexp_full_match(sequence, '[ACGT]+') THEN {varint('length(sequence)')} + ceil(length(sequence) / 4.0) END"


@query(CHUNKED + f"SELECT ref, chunk::BIGINT AS chunk, count(*) AS n, count({SEQ2}) AS packable, sum({SEQ2})::BIGINT AS packable_bytes, CASE WHEN count({SEQ2}) = count(*) THEN sum({SEQ2})::BIGINT END AS bytes FROM c GROUP BY ref, chunk")
def seq_2bit_size(reads):
    return codecs.sequence_2bit(chunked(reads))


TAGS = ", tg AS (SELECT ref, pos // 16384 AS chunk, qname, t[1:2] AS key, t[4:4] AS type, t[6:] AS val FROM (SELECT *, unnest(string_split(tags, chr(9))) AS t FROM r WHERE tags <> ''))"


@query(TAGS + "SELECT qname, key, type, val AS value FROM tg")
def tag_parse(reads):
    return reads.select("qname", F.explode(records.tag_items(F.col("tags"))).alias("t")).select("qname", "t.key", "t.type", "t.value")


@query(TAGS + "SELECT ref, key, type, count(*) AS present, (SELECT count(*) FROM r WHERE r.ref = tg.ref) AS n FROM tg GROUP BY ref, key, type")
def tag_presence(reads):
    per = reads.select("ref", F.explode(records.tag_items(F.col("tags"))).alias("t")).groupBy("ref", "t.key", "t.type").agg(F.count("*").alias("present"))
    return per.join(reads.groupBy("ref").agg(F.count("*").alias("n")), "ref")


STREAMS = CHUNKED.replace("c AS", "c1 AS") + TAGS + f"""
, n AS (SELECT ref, chunk, count(*) AS n FROM c1 GROUP BY ALL),
z AS (SELECT ref, chunk, key, count(*) AS present, count(DISTINCT type) AS types, sum(CASE WHEN type = 'i' THEN {varint("CASE WHEN val::BIGINT >= 0 THEN 2 * val::BIGINT ELSE -2 * val::BIGINT - 1 END")} ELSE {varint('strlen(val)')} + strlen(val) END)
      AS vals FROM (SELECT ref, chunk, key, type, val FROM tg) GROUP BY ref, chunk, key),
streams AS (SELECT n.ref, n.chunk::BIGINT AS chunk, any_value(n.n) AS n, count(key) AS n_keys,
  (CASE WHEN count(key) = 0 THEN 1 ELSE {varint('count(key)')} + sum(4 + CASE WHEN present = n.n THEN 0 ELSE ceil(n.n / 8.0) END + {varint('present')} + vals) END)::BIGINT AS bytes
  FROM n LEFT JOIN z ON n.ref = z.ref AND n.chunk = z.chunk GROUP BY n.ref, n.chunk)
""".replace("sum(CASE WHEN type = 'i' THEN ((length(bin((CASE WHEN val::BIGINT", "sum(CASE WHEN type = 'i' THEN ((length(bin((CASE WHEN try_cast(val AS BIGINT)").replace("2 * val::BIGINT", "2 * try_cast(val AS BIGINT)")


@query(STREAMS + "SELECT * FROM streams")
def tag_streams(reads):
    return codecs.tag_streams(chunked(reads))


ZZ = "CASE WHEN template_length >= 0 THEN 2 * template_length::BIGINT ELSE -2 * template_length::BIGINT - 1 END"


@query(f"SELECT template_length::BIGINT AS x, ({ZZ})::BIGINT AS zigzag, {varint(ZZ)}::BIGINT AS bytes, count(*) AS n FROM r GROUP BY ALL")
def zigzag_varint_size(reads):
    z = records.zigzag(F.col("template_length"))
    return longs(reads.groupBy(F.col("template_length").alias("x")).agg(F.count("*").alias("n")).select("x", records.zigzag(F.col("x")).alias("zigzag"), records.varint_size(records.zigzag(F.col("x"))).alias("bytes"), "n"))


def _choice_sql() -> str:
    token = f"CASE WHEN regexp_full_match(cigar, '([1-9][0-9]*[MIDNSHP=X])+') THEN {varint(f'len({TOKENS})')} + list_sum([{varint('x[1]::BIGINT')} + 1 FOR x IN {TOKENS}]) END"
    strings = " UNION ALL ".join(f"SELECT ref, chunk, '{c}' AS col, 'raw' AS code, 0 AS k, sum(4 + strlen({c}))::BIGINT AS bytes FROM c GROUP BY ref, chunk" for c in ("qname", "cigar", "mate_reference", "sequence", "quality", "tags"))
    fixed = " UNION ALL ".join(f"SELECT ref, chunk, '{c}', 'raw', 0, {w} * count(*) FROM c GROUP BY ref, chunk" for c, w in (("flag", 2), ("mapq", 1), ("mate_pos", 4), ("template_length", 4)))
    part = lambda sql, name, alias: sql.replace(CHUNKED, "").replace(f"{name} AS (", f"{alias} AS (")
    qname = dictionary_sql("qname", True).replace(CHUNKED, "")
    for old in ("u", "o", "s", "dict"):
        qname = qname.replace(f"{old} AS (", f"q_{old} AS (").replace(f"FROM {old} ", f"FROM q_{old} ").replace(f"FROM {old})", f"FROM q_{old})")
    cig = dictionary_sql("cigar", False).replace(CHUNKED, "")
    for old in ("u", "o", "s", "dict"):
        cig = cig.replace(f"{old} AS (", f"g_{old} AS (").replace(f"FROM {old} ", f"FROM g_{old} ").replace(f"FROM {old})", f"FROM g_{old})")
    runs = RUNS.replace(CHUNKED, "")
    streams = STREAMS.replace(CHUNKED.replace("c AS", "c1 AS"), "").replace("FROM c1", "FROM c")
    # one row per run of equal qualities in each text
    quality = f"""
, ql AS (SELECT row_number() OVER () AS id, ref, chunk, quality FROM c),
qc AS (SELECT id, ref, chunk, quality, unnest(range(1, length(quality) + 1)) AS k FROM ql WHERE quality NOT IN ('', '*')),
qf AS (SELECT id, ref, chunk, quality[k] AS ch, k, sum((k = 1 OR quality[k] <> quality[k - 1])::INT) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM qc),
qr AS (SELECT id, run, count(*) AS length FROM qf GROUP BY ALL),
qs AS (SELECT id, sum({varint('length')} + 1) AS rle FROM qr GROUP BY id),
qa AS (SELECT ref, chunk, count(DISTINCT ch) AS a FROM (SELECT ref, chunk, unnest(string_split(quality, '')) AS ch FROM ql) WHERE ch <> '' GROUP BY ref, chunk),
qq AS (SELECT ql.ref, ql.chunk, count(*) AS n, count(rle) AS ok, sum({varint('length(quality)')} + rle) AS rle_bytes,
       any_value(a) AS a, sum({varint('length(quality)')} + ceil(length(quality) * (CASE WHEN a <= 1 THEN 0 ELSE length(bin((a - 1)::BIGINT)) END) / 8.0)) FILTER (rle IS NOT NULL) AS body
       FROM ql LEFT JOIN qs USING (id) JOIN qa ON ql.ref = qa.ref AND ql.chunk = qa.chunk GROUP BY ql.ref, ql.chunk)"""
    return CHUNKED + qname + cig + runs + streams + quality + f"""
, cand AS ({strings} UNION ALL {fixed}
  UNION ALL SELECT ref, chunk, 'flag', 'flag_bitpack', 1, (1 + ceil(count(*) * ({WIDTH}) / 8.0))::BIGINT FROM c GROUP BY ref, chunk
  UNION ALL SELECT ref, chunk, 'pos', 'pos_delta', 0, sum({varint('d')})::BIGINT FROM (SELECT ref, chunk, pos - coalesce(lag(pos) OVER (PARTITION BY ref, chunk ORDER BY pos, qname), 0) AS d FROM c) GROUP BY ref, chunk
  UNION ALL SELECT ref, chunk, 'mapq', 'mapq_rle', 1, bytes FROM runs
  UNION ALL SELECT ref, chunk, 'cigar', 'cigar_token', 1, CASE WHEN count({token}) = count(*) THEN sum({token})::BIGINT END FROM c GROUP BY ref, chunk
  UNION ALL SELECT ref, chunk, 'cigar', 'cigar_dict', 2, bytes FROM g_dict
  UNION ALL SELECT ref, chunk, 'qname', 'qname_dict', 1, bytes FROM q_dict
  UNION ALL SELECT ref, chunk, 'sequence', 'seq_2bit', 1, CASE WHEN count({SEQ2}) = count(*) THEN sum({SEQ2})::BIGINT END FROM c GROUP BY ref, chunk
  UNION ALL SELECT ref, chunk, 'quality', 'qual_rle', 1, CASE WHEN ok = n THEN rle_bytes::BIGINT END FROM qq
  UNION ALL SELECT ref, chunk, 'quality', 'qual_pack', 2, CASE WHEN ok = n AND a <= 128 THEN (body + {varint('a')} + a)::BIGINT END FROM qq
  UNION ALL SELECT ref, chunk, 'tags', 'tags_per_stream', 1, bytes FROM streams),
chosen AS (SELECT ref, chunk::BIGINT AS chunk, col AS "column", code, bytes FROM cand WHERE bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref, chunk, col ORDER BY bytes, k) = 1)
"""


CHOICE = _choice_sql()


def _concrete(reads: DataFrame) -> DataFrame:
    """The smallest bodies' sizes: all columns of a chunk are encoded in one pass over one shuffle."""
    return codec_bytes.encode_chunks(chunked(reads), facts=codec_bytes.SIZES).select("ref", "chunk", "column", "code", "bytes")


@query(CHOICE + "SELECT * FROM chosen")
def codec_choice(reads):
    return _concrete(reads)


@query(CHOICE + 'SELECT "column", code, count(*) AS chunks FROM chosen GROUP BY ALL')
def codec_distribution(reads):
    return codecs.distribution(_concrete(reads))


@query(CHOICE + """SELECT "column", sum(bytes)::BIGINT AS total_bytes, count(*) AS chunks, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, avg(bytes) AS avg_bytes, 100 * sum(bytes) / (SELECT sum(bytes) FROM chosen) AS percent FROM chosen GROUP BY "column" """)
def payload_summary(reads):
    return codecs.payload_summary(_concrete(reads))


def contigs(spark: SparkSession) -> DataFrame:
    """Five contigs of 102,400 bases, some of them soft-masked, made by hashing."""
    names = spark.range(1, 6).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("name"))
    piece = lambda k: F.translate(F.md5(F.concat("name", F.lit(":"), k.cast("string"))), derived.HEX, "ACGTacgtACGTACGT")
    return names.select("name", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3199)), piece), "").alias("seq"))


FASTA = ", fa AS (SELECT name, string_agg(translate(md5(name || ':' || k), '0123456789abcdef', 'ACGTacgtACGTACGT'), '' ORDER BY k) AS seq FROM (SELECT 'chr' || i AS name FROM range(1, 6) t(i)), range(0, 3200) u(k) GROUP BY name)"


@query(FASTA + "SELECT name, length(seq)::BIGINT AS length, sha256(upper(seq)) AS sha256 FROM fa")
def contig_sha256(reads):
    return longs(contigs(reads.sparkSession).select("name", F.length("seq").alias("length"), F.sha2(F.upper("seq"), 256).alias("sha256")))


DELTA = BLOCKS + FASTA + """, able AS (SELECT * FROM prt WHERE regexp_full_match(sequence, '[ACGT]+') AND cigar <> '*'),
mm AS (SELECT ref, count(*) AS mismatches, sum(q + k)::BIGINT AS offset_sum FROM (SELECT ref, q, s, len, sequence, upper(substr(seq, (s + 1)::BIGINT, len)) AS under, unnest(range(0, len)) AS k FROM able JOIN fa ON ref = name WHERE op IN ('M', '=', 'X'))
  WHERE substr(sequence, (q + k + 1)::BIGINT, 1) <> substr(under, (k + 1)::BIGINT, 1) GROUP BY ref),
rest AS (SELECT ref, sum(CASE WHEN op = 'S' THEN len ELSE 0 END)::BIGINT AS soft_clipped, count(*) FILTER (op = 'I') AS insertions, sum(CASE WHEN op = 'I' THEN len ELSE 0 END)::BIGINT AS inserted, count(*) FILTER (i = 1) AS n FROM able GROUP BY ref)
"""


@query(DELTA + "SELECT rest.ref, n, mismatches, offset_sum, soft_clipped, insertions, inserted FROM rest JOIN mm USING (ref)")
def refdelta_facts(reads):
    delta = refdelta.encode(reads.select("ref", "pos", "end_pos", "cigar", "sequence"), refdelta.tiles(contigs(reads.sparkSession)))
    add = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return delta.groupBy("ref").agg(F.count("*").alias("n"), F.sum(F.size("mismatches")).alias("mismatches"), F.sum(add("mismatches", lambda m: m["at"])).alias("offset_sum"), F.sum(F.length("soft_clips")).cast("long").alias("soft_clipped"), F.sum(F.size("insertions")).alias("insertions"), F.sum(add("insertions", lambda s: F.length(s))).alias("inserted"))


@query("SELECT qname, pos::BIGINT AS pos, sequence FROM r WHERE regexp_full_match(sequence, '[ACGT]+') AND cigar <> '*'")
def refdelta_roundtrip(reads):
    windows = refdelta.tiles(contigs(reads.sparkSession))
    delta = refdelta.encode(reads.select("qname", "ref", "pos", "end_pos", "cigar", "sequence"), windows)
    return longs(refdelta.decode(delta, windows).select("qname", "pos", "sequence"))


@query("SELECT b AS bin_id, CASE WHEN b = 0 THEN 0 WHEN b < 9 THEN (b - 1) * 67108864 WHEN b < 73 THEN (b - 9) * 8388608 WHEN b < 585 THEN (b - 73) * 1048576 WHEN b < 4681 THEN (b - 585) * 131072 ELSE (b - 4681) * 16384 END::BIGINT AS start, CASE WHEN b = 0 THEN 536870912 WHEN b < 9 THEN b * 67108864 WHEN b < 73 THEN (b - 8) * 8388608 WHEN b < 585 THEN (b - 72) * 1048576 WHEN b < 4681 THEN (b - 584) * 131072 ELSE (b - 4680) * 16384 END::BIGINT AS \"end\" FROM range(0, 37449) t(b)")
def bin_interval(reads):
    start, end = records.bin_interval(F.col("id"))
    return reads.sparkSession.range(37449).select(F.col("id").alias("bin_id"), start.alias("start"), end.alias("end"))


@query("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN pos >> 14 = (end_pos - 1) >> 14 THEN 4681 + (pos >> 14) WHEN pos >> 17 = (end_pos - 1) >> 17 THEN 585 + (pos >> 17) WHEN pos >> 20 = (end_pos - 1) >> 20 THEN 73 + (pos >> 20) WHEN pos >> 23 = (end_pos - 1) >> 23 THEN 9 + (pos >> 23) WHEN pos >> 26 = (end_pos - 1) >> 26 THEN 1 + (pos >> 26) ELSE 0 END::BIGINT AS bin FROM r) GROUP BY bin")
def reg2bin(reads):
    return reads.groupBy(records.bin_of(F.col("pos"), F.col("end_pos")).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT ref, count(*) AS runs, avg(v) AS average, median(v)::DOUBLE AS median, max(v) FILTER (k = ceil(0.95 * n)) AS p95, min(v) AS min, max(v) AS max, count(*) FILTER (v > 2 * m) AS outliers FROM (SELECT ref, (end_pos - pos)::BIGINT AS v, row_number() OVER (PARTITION BY ref ORDER BY end_pos - pos) AS k, count(*) OVER (PARTITION BY ref) AS n, median(end_pos - pos) OVER (PARTITION BY ref) AS m FROM r) GROUP BY ref")
def bench_summary_p95(reads):
    """Runs, mean, median, the value at rank ceil(0.95 n), extremes, and values over twice the median: by counts of distinct values, so no contig is sorted in one task."""
    counts = reads.groupBy("ref", (F.col("end_pos") - F.col("pos")).cast("long").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("ref")
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    mid = ranked.groupBy("ref").agg(((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2).alias("median"), at(F.ceil(F.col("n") * 95 / 100)).alias("p95"))
    rest = ranked.join(mid, "ref").groupBy("ref", "median", "p95")
    return rest.agg(F.sum("c").alias("runs"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("average"), F.min("v").alias("min"), F.max("v").alias("max"), F.coalesce(F.sum(F.when(F.col("v") > 2 * F.col("median"), F.col("c"))), F.lit(0)).alias("outliers"))


@query("SELECT CASE WHEN mate_pos < 0 THEN 0 ELSE mate_pos + 1 END::BIGINT AS pnext, mate_pos::BIGINT AS mate_pos, count(*) AS n FROM r GROUP BY ALL")
def mate_position_roundtrip(reads):
    back = records.parse_sam(reads.select(records.sam_line().alias("value")), headers=False)
    pnext = F.split(records.sam_line(), "\t")[7].cast("long")
    return longs(back.groupBy(pnext.alias("pnext"), "mate_pos").agg(F.count("*").alias("n")))


FIELDS = ("qname", "flag", "ref", "pos", "mapq", "cigar", "mate_reference", "mate_pos", "template_length", "sequence", "quality", "tags")


@query("SELECT qname, flag::BIGINT AS flag, ref, pos::BIGINT AS pos, mapq::BIGINT AS mapq, cigar, mate_reference, mate_pos::BIGINT AS mate_pos, template_length::BIGINT AS template_length, sequence, quality, tags FROM r")
def sam_parse_roundtrip(reads):
    return longs(records.parse_sam(reads.select(records.sam_line().alias("value")), headers=False).select(*FIELDS))


@query("SELECT qname, pos::BIGINT AS pos, cigar FROM r")
def read_projection(reads):
    return longs(project(reads, ["qname", "pos", "cigar"]))


@query("SELECT ref, count(*) AS scanned, count(*) FILTER (" + HIT.replace("ref = 'chr2' AND ", "") + ") AS matched, count(*) FILTER (" + HIT.replace("ref = 'chr2' AND ", "") + f" AND {KEEP}) AS kept FROM r GROUP BY ref")
def view_counters(reads):
    """Records scanned, overlapping and kept, in one aggregation."""
    hit = (F.col("pos") < REGION.end) & (F.col("end_pos") > REGION.start)
    return reads.groupBy("ref").agg(F.count("*").alias("scanned"), F.count_if(hit).alias("matched"), F.count_if(hit & record_filter(MASK, MAPQ)).alias("kept"))
