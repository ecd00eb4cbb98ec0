"""Benchmark decontamination by training suffix arrays.

The documents of a partition form shards of bounded size. A shard is one sequence of word ids; its suffixes are sorted
into a suffix array, in which every window of every test suffix is found by binary search. Runs of windows on one diagonal join to the
longest verbatim matches with their places in document and item. Words that no item has end a match, so
suffixes that begin with too few words of the test vocabulary are left out of the array: no search could end at them.

Items are read in blocks of bounded bytes, each broadcast; more items make more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import out_schema, table, text_bytes, words

MATCH = "struct<item_id:long,doc_word:long,item_word:long,length:long>"
ADDED = f"n_words long, n_hit long, items array<long>, matches array<{MATCH}>"


class Block:
    """Windows of some items, once each, and where the items have them: arrays, of about 60 bytes for each word of the items."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        sequences = []
        for _, text in items:
            found = words(text)
            sequences.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found), np.int32, len(found)))
        counts = np.array([len(s) for s in sequences], np.int64)
        fit = np.where(counts > 0, np.maximum(1, counts - window + 1), 0)
        begins = np.cumsum(counts) - counts
        every = np.concatenate([*sequences, np.zeros(window, np.int32)])
        item = np.repeat(np.arange(len(items)), fit)
        word = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit)
        length = np.minimum(counts[item], window)
        rows = np.lib.stride_tricks.sliding_window_view(every, window)[begins[item] + word]
        rows = np.where(np.arange(window) < length[:, None], rows, np.int32(0))
        order = np.lexsort((word, item, *(rows[:, k] for k in reversed(range(window)))))
        rows, length, self.item, self.item_word = rows[order], length[order], item[order], word[order]
        first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
        self.windows, self.lengths = rows[first], length[first]
        self.starts = np.append(first, len(rows))


def suffix_array(tokens: np.ndarray, shortest: int, depth: int) -> np.ndarray:
    """Positions at which ``shortest`` words of the vocabulary (ids above 0) stand, sorted by the next ``depth`` ids.

    ``tokens`` ends with ``depth`` zeros."""
    n = len(tokens) - depth
    stops = np.flatnonzero(tokens == 0)
    run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    at = np.flatnonzero(run >= shortest)
    columns = []
    for j in range(0, depth, 2):
        left = tokens[at + j].astype(np.int64) << 32
        columns.append(left | tokens[at + j + 1] if j + 1 < depth else left)
    return at[np.lexsort(columns[::-1])]


def search(tokens: np.ndarray, suffixes: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of the suffix array that begin with each window: binary search for all windows side by side."""
    depth = windows.shape[1]
    mask = np.arange(depth) < lengths[:, None]
    rows = np.arange(len(windows))

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(suffixes), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = suffixes[np.minimum(mid, len(suffixes) - 1)]
            gap = np.where(mask, tokens[at[:, None] + np.arange(depth)] - windows, 0)
            sign = gap[rows, (gap != 0).argmax(axis=1)]
            right = open_ & ((sign < 0) | (after & (sign == 0)))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)
        return low

    if not len(suffixes) or not len(windows):
        return np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    return bound(False), bound(True)


def matches(texts: list[np.ndarray], block: Block) -> np.ndarray:
    """Longest verbatim matches in a shard as rows (document, item, word of the document, word of the item, length)."""
    depth = block.windows.shape[1]
    if not len(block.windows):
        return np.zeros((0, 5), np.int64)
    zero = np.zeros(1, np.int32)
    tokens = np.concatenate([x for t in texts for x in (t, zero)] + [np.zeros(depth, np.int32)])
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    suffixes = suffix_array(tokens, int(block.lengths.min()), depth)
    low, high = search(tokens, suffixes, block.windows, block.lengths)
    spread = lambda starts, counts: np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    window = np.repeat(np.arange(len(low)), high - low)
    place = suffixes[spread(low, high - low)]
    uses = block.starts[window + 1] - block.starts[window]
    entry = spread(block.starts[window], uses)
    place, length = np.repeat(place, uses), np.repeat(block.lengths[window], uses)
    item, item_word = block.item[entry], block.item_word[entry]
    order = np.lexsort((place, place - item_word, item))
    place, length, item, item_word = place[order], length[order], item[order], item_word[order]
    if not len(place):
        return np.zeros((0, 5), np.int64)
    new = np.append(True, (item[1:] != item[:-1]) | (place[1:] != place[:-1] + 1) | (item_word[1:] != item_word[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    document = np.searchsorted(begins, place[first], side="right") - 1
    out = np.stack([document, item[first], place[first] - begins[document], item_word[first], place[last] - place[first] + length[last]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks of about ``block_bytes``, one at a time on the driver."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        chosen = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield sorted(((r.id, bytes(r.text)) for r in chosen.collect()), key=lambda x: (x[0] is not None, x))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_words: int = 2_000_000, block_bytes: int = 16 << 20, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside occurrences of a window), ``items`` (sorted ids of items with
    occurring windows) and ``matches`` (longest verbatim matches: item, word of the document, word of the item, length).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Null and
    empty texts have no words. Items with a null id make hits but stand in no list of ids; repeated items count once.
    Columns of docs named as the new ones are replaced, all others pass through; ``prefix`` goes before the new names. Empty tables are allowed on either
    side. No shuffle: each partition is searched where it is, in shards of ``shard_words`` words or one document.
    """
    added = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in T.StructType.fromDDL(ADDED)])
    new = added.fieldNames()
    docs = docs.drop(*new)
    names = docs.columns
    sc = docs.sparkSession.sparkContext
    schema = T.StructType([*docs.schema.fields, *added.fields])
    arrow = out_schema(ADDED)

    def search_block(block, first: bool):
        def annotate(held: list[pa.RecordBatch], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = matches(texts, block.value)
            ids = block.value.ids
            by_doc = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
            k = 0
            for batch in held:
                columns: list[list] = [[], [], [], []]
                old = [[]] * batch.num_rows if first else batch.column(new[-1]).to_pylist()
                for row in range(batch.num_rows):
                    mine = found[by_doc[k] : by_doc[k + 1]]
                    rows = old[row] + [{"item_id": ids[i], "doc_word": int(p), "item_word": int(q), "length": int(n)} for _, i, p, q, n in mine.tolist()]
                    hit = 0
                    if rows:
                        change = np.zeros(len(texts[k]) + 1, np.int64)
                        at = np.array([(r["doc_word"], r["doc_word"] + r["length"]) for r in rows])
                        np.add.at(change, at[:, 0], 1)
                        np.add.at(change, at[:, 1], -1)
                        hit = int((np.cumsum(change) > 0).sum())
                    for column, value in zip(columns, (len(texts[k]), hit, sorted({r["item_id"] for r in rows} - {None}), rows), strict=True):
                        column.append(value)
                    k += 1
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True))], names=[*names, *new])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = block.value.vocabulary.get
            held, texts, size = [], [], 0
            for batch in batches:
                held.append(batch)
                for text in batch.column("_rl_text").to_pylist():
                    found = words(text)
                    texts.append(np.fromiter(map(get, found, repeat(0)), np.int32, len(found)))
                    size += len(found)
                if size >= shard_words:
                    yield from annotate(held, texts)
                    held, texts, size = [], [], 0
            if held:
                yield from annotate(held, texts)

        return run

    out = docs
    for k, items in enumerate(blocks_of(benchmark, item_col, item_text_col, block_bytes)):
        out = out.withColumn("_rl_text", text_bytes(text_col)).mapInArrow(search_block(sc.broadcast(Block(items, window)), k == 0), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of an item. All columns, of whatever name, stay as they are; rows that
    are repeated or without an id are judged one by one; null and empty texts stay, and so do all rows where there are no items."""
    return find_leaks(docs, benchmark, prefix="_rl_", **options).where("_rl_n_hit = 0").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN win x ON p.n = x.n AND p.s = x.s),
n_hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""
