"""Katz backoff language model of trigrams: Good-Turing discounts, exactly normalised backoff weights, partitioned tables.

    P(w | g h) = f(g h) d3(c) c(g h w) / c(g h)  where g h w was seen c times in training, else a(g h) P(w | h)
    P(w | h)   = f(h) d2(c) c(h w) / c(h)        where h w was seen c times,               else a(h) P(w)
    P(w)       = (c(w) + 0.1) / (n + 0.1 (v + 1))

with d from Good and Turing and a(..) such that the probabilities of each context sum to one over the training words,
the end and one unknown word; a context that was never seen has a = 1. A text begins with two begins and ends with one end.

Each trigram lies in the partition of its middle word. There its context g h, its suffix h w, the counts of h as a context
and as a word, and thus all weights are at hand; only the counts of w are asked of the partitions where w is the middle
word. So the occurrences of trigrams are shuffled once, distinct within a chunk of documents, with the documents that hold
them, and serve both for counting and for scoring; what returns is a sum for each document. Frequent middle words are
split by g over several partitions, which then add up their counts of h w. A trigram that many documents of a chunk hold
is sent without them and its value comes back instead, so no partition gathers the documents of a frequent trigram.

The most frequent words, a bounded number, have short numbers, which changes no score. All other words are known by
63-bit hashes, trigrams by 64-bit ones.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import out_schema, table, text_bytes

#: Numbers of the begin and the end; frequent words follow.
BEGIN, END, WORDS = 0, 1, 2
#: Set in the hashes of words, which keeps them apart from numbers.
TOP = np.uint64(1 << 63)
#: Discounts apply to counts up to this one.
GOOD_TURING = 5
#: Longer words never have numbers, which bounds what is broadcast.
LONGEST = 64
SCORES = "id long, n_tokens long, n_known long, base_score double, score double"


def in_training(id_col: str) -> Column:
    """Whether a row belongs to the training part; rows with a null id do."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 != 0, F.lit(True))


def discounts(ones: Iterable[int]) -> np.ndarray:
    """d[0..GOOD_TURING + 1] from the numbers of n-grams seen 0, 1, 2 ... times; the last stands for all larger counts and is 1.

    Where Good and Turing's estimate is not between 0 and 1, as in small tables, 0.5 is taken off the count.
    """
    k, n = GOOD_TURING, [float(x) for x in ones]
    out = np.ones(k + 2)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, GOOD_TURING + 2), minlength=GOOD_TURING + 3)[: GOOD_TURING + 2]


@dataclass
class Model:
    """What every task knows: frequent words, how they are split, and once they are counted their counts and weights."""

    numbers: dict[bytes, int]
    cells: np.ndarray  # over how many partitions' cells each numbered word is split
    buckets: int
    count: np.ndarray | None = None  # training counts of the numbered words; of the begin as a context
    n: int = 0  # training tokens
    v: int = 0  # distinct training tokens
    d2: np.ndarray | None = None
    d3: np.ndarray | None = None
    factor: np.ndarray | None = None  # of split words
    backoff: np.ndarray | None = None

    def lower(self, c: np.ndarray | int) -> np.ndarray:
        """P(w) of words of these counts."""
        return (c + 0.1) / (self.n + 0.1 * (self.v + 1))

    def split(self, h: np.ndarray) -> np.ndarray:
        """How many cells a middle word has."""
        return np.where(h < TOP, self.cells[np.where(h < TOP, h, BEGIN).astype(np.int64)], 1)

    def spot(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A hash of the cell of trigrams, from which the partition follows."""
        many = self.split(h)
        cell = np.where(many > 1, (scramble(g) >> np.uint64(20)) % many.astype(np.uint64), np.uint64(0))
        return scramble(mix(h, cell))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + b


def bucket_of(spots: np.ndarray, buckets: int) -> np.ndarray:
    """Partitions in the order of the spots."""
    return ((spots >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def weights(c: np.ndarray, high: np.ndarray, low: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """f and a of contexts seen ``c`` times, from sums over the words seen after them: of d(c) c / c(context) and of the shorter model."""
    factor = np.where(1 - high < 1e-9, c / (c + 1), 1.0)  # no count was discounted: one more observation makes room
    return np.where(c > 0, factor, 1.0), np.where(c > 0, (1 - high * factor) / np.maximum(1 - low, least), 1.0)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, in the order of the keys, and the group of each place; numbers of 32 bits keep them small."""
    order = np.argsort(keys, kind="stable").astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    del ordered
    group = np.empty_like(order)
    group[order] = np.cumsum(new, dtype=order.dtype) - 1
    return order[new], group


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class Ids(dict):
    """Numbers of frequent words, hashes of all others."""

    def __missing__(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) | 1 << 63

    def of(self, text: bytes) -> np.ndarray:
        """Ids of two begins, the tokens and the end."""
        tokens = tokens_of(text)
        out = np.empty(len(tokens) + 3, np.uint64)
        out[:2], out[-1] = BEGIN, END
        out[2:-1] = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        return out


def pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, as many are small."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(plain.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def frequent_words(docs: DataFrame, hot: int) -> tuple[list[tuple[bytes, int]], int]:
    """About the ``hot`` most frequent words with about their counts, and the number of tokens. Each task hands on its most frequent ones."""
    ddl = "word binary, n long"
    schema = out_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens = tokens_of(text)
                n += len(tokens) + 1
                counts.update(tokens)
                if len(counts) > 1_000_000:
                    counts = Counter(dict(counts.most_common(2 * hot)))
        top = [(w, c) for w, c in counts.most_common(2 * hot) if len(w) <= LONGEST and c > 1]
        words, times = zip(*top, (None, n), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], schema=schema)

    found = docs.select("text").mapInArrow(run, ddl).groupBy("word").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.col("word").isNotNull(), F.col("n").desc(), "word").limit(hot + 1).collect()  # a bounded number; the total comes first
    return [(bytes(r.word), r.n) for r in rows if r.word is not None], sum(r.n for r in rows if r.word is None)


def trigrams(rows: Iterable, model: Model, part: int, chunk_tokens: int, shared: int) -> Iterator[tuple[int, tuple]]:
    """(partition, piece) of each chunk's distinct trigrams with the documents that hold them, and the chunk's documents."""
    names = Ids(model.numbers)
    ids, training, texts, size, chunk = [], [], [], 0, part << 32

    def flush() -> Iterator[tuple[int, tuple]]:
        lengths = np.array([len(t) for t in texts])
        every, doc = np.concatenate(texts), np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
        starts = np.ones(len(every), bool)
        ends = np.cumsum(lengths)
        starts[ends - 1] = starts[ends - 2] = False
        at = np.flatnonzero(starts)
        g, h, w, doc = every[at], every[at + 1], every[at + 2], doc[at]
        spot = model.spot(g, h)
        order = np.lexsort((w, g, spot))  # documents stay in order
        g, h, w, doc, spot = g[order], h[order], w[order], doc[order], spot[order]
        new = np.append(True, (spot[1:] != spot[:-1]) | (g[1:] != g[:-1]) | (w[1:] != w[:-1]) | (h[1:] != h[:-1]))
        first = np.flatnonzero(new)
        seen = np.add.reduceat(np.array(training)[doc].astype(np.uint32), first, dtype=np.uint32)
        owner = np.flatnonzero(new | np.append(True, doc[1:] != doc[:-1]))
        times = np.diff(np.append(owner, len(doc))).astype(np.uint32)
        holders = np.diff(np.append(np.flatnonzero(new[owner]), len(owner))).astype(np.uint32)
        owner = doc[owner]
        cuts = np.searchsorted(bucket_of(spot[first], model.buckets), np.arange(model.buckets + 1))
        ends = np.append(0, np.cumsum(holders, dtype=np.int64))
        kept = {}
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            mine = slice(cuts[b], cuts[b + 1])
            f, runs = first[mine], holders[mine]
            change = np.flatnonzero(np.append(True, h[f][1:] != h[f][:-1]))
            many = np.repeat(runs > shared, runs)
            who, n = owner[ends[cuts[b]] : ends[cuts[b + 1]]], times[ends[cuts[b]] : ends[cuts[b + 1]]]
            if many.any():
                kept[b] = pack(runs[runs > shared]), pack(who[many]), pack(n[many])
            body = (pack(h[f][change]), pack(np.diff(np.append(change, len(f))).astype(np.uint32)), pack(g[f]), pack(w[f]), pack(seen[mine]), pack(runs), pack(who[~many]), pack(n[~many]))
            yield b, ("trigrams", chunk, *body)
        mask = np.array([i is None for i in ids])
        yield chunk % model.buckets, ("documents", chunk, np.array([i or 0 for i in ids], np.int64), mask, lengths - 2, kept)

    for key, text, learn in rows:
        ids.append(key)
        training.append(learn)
        texts.append(names.of(bytes(text)))
        size += len(texts[-1])
        if size >= chunk_tokens:
            yield from flush()
            ids, training, texts, size, chunk = [], [], [], 0, chunk + 1
    if ids:
        yield from flush()


def by_bucket(rows: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int, dict[str, list[tuple]]]]:
    """The rows of each bucket by their kind. A partition holds one bucket where there are as many partitions as buckets."""
    found: dict[int, dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    for bucket, row in rows:
        found[bucket][row[0]].append(row[1:])
    for bucket in sorted(found):
        yield bucket, found.pop(bucket)


class Shelf:
    """The distinct trigrams of a bucket with their training counts (0 for those in texts that are only scored)."""

    def __init__(self, model: Model, pieces: list[tuple]):
        self.m, parts = model, []
        self.pieces = sorted(pieces)
        for _, h, runs, g, w, seen, *_ in self.pieces:
            parts.append((unpack(g, np.uint64), np.repeat(unpack(h, np.uint64), unpack(runs, np.uint32)), unpack(w, np.uint64), unpack(seen, np.uint32)))
        g, h, w, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.sizes = [len(p[0]) for p in parts]
        del parts
        first, self.row = groups(mix(mix(g, h), w))
        self.c = np.bincount(self.row, seen, len(first)).astype(np.int64)
        g, h, w = g[first], h[first], w[first]
        self.g, self.h, self.w = g, h, w
        del seen, first
        at, self.word = groups(h)
        self.words = h[at]
        self.heads = np.bincount(self.word, self.c).astype(np.int64)
        at, self.pair = groups(mix(h, w))
        self.pairs = np.bincount(self.pair, self.c).astype(np.int64)
        self.pair_h, self.pair_w, self.pair_word = self.h[at], self.w[at], self.word[at]
        self.pair_split = np.flatnonzero(model.split(self.pair_h) > 1)

    def rare_last(self) -> tuple[np.ndarray, np.ndarray]:
        """The words without numbers that are last in a trigram, and the buckets where they are counted."""
        rare = np.unique(self.pair_w[self.pair_w >= TOP])
        return rare, bucket_of(self.m.spot(rare, rare), self.m.buckets)

    def split_homes(self) -> np.ndarray:
        """Where counts of the pairs of split words are added up: with the last word's count, where it has no number."""
        h, w = self.pair_h[self.pair_split], self.pair_w[self.pair_split]
        return bucket_of(np.where(w >= TOP, self.m.spot(w, w), scramble(mix(h, w))), self.m.buckets)

    def asks(self, bucket: int) -> Iterator[tuple[int, tuple]]:
        rare, home = self.rare_last()
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(self.m.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            yield b, ("ask", bucket, pack(rare[order[cuts[b] : cuts[b + 1]]]))
        home = self.split_homes()
        for b in np.unique(home).tolist():
            mine = self.pair_split[home == b]
            yield b, ("pairs", bucket, pack(self.pair_h[mine]), pack(self.pair_w[mine]), pack(self.pairs[mine]))
        mine = (self.words >= TOP) & (self.heads > 0)
        yield bucket, ("own", pack(self.words[mine]), pack(self.heads[mine]))
        hot = (self.words < TOP) & (self.heads > 0)
        whole = np.ones(len(self.pairs), bool)
        whole[self.pair_split] = False
        ends = self.c[self.w == END].sum()
        facts = counts_of_counts(self.c), counts_of_counts(self.pairs[whole]), int(mine.sum()), int(self.heads[self.words != BEGIN].sum() + ends), int(ends)
        yield bucket, ("facts", facts, self.words[hot].astype(np.int64), self.heads[hot])

    def weigh(self, counts: list[tuple], totals: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each trigram: log P(w | g h), log of the base estimate of its middle word, and whether this is known."""
        m = self.m
        rare, home = self.rare_last()
        known = np.zeros(len(rare), np.int64)
        for b, c in counts:
            known[home == b] = unpack(c, np.int64)
        last = np.where(self.pair_w < TOP, m.count[np.where(self.pair_w < TOP, self.pair_w, END).astype(np.int64)], 0)
        last[self.pair_w >= TOP] = known[np.searchsorted(rare, self.pair_w[self.pair_w >= TOP])]
        home = self.split_homes()
        for b, c in totals:
            self.pairs[self.pair_split[home == b]] = unpack(c, np.int64)
        hot = self.words < TOP
        number = np.where(hot, self.words, BEGIN).astype(np.int64)
        heads = np.where(hot, m.count[number], self.heads)
        p1 = m.lower(last)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(self.pairs > 0, m.d2[np.minimum(self.pairs, GOOD_TURING + 1)] * self.pairs / heads[self.pair_word], 0.0)
        factor, back = weights(heads, np.bincount(self.pair_word, ratio, len(heads)), np.bincount(self.pair_word, p1 * (self.pairs > 0), len(heads)), m.lower(0))
        split = hot & (m.cells[number] > 1)
        factor[split], back[split] = m.factor[number[split]], m.backoff[number[split]]
        p2 = np.where(self.pairs > 0, factor[self.pair_word] * ratio, back[self.pair_word] * p1)
        context = groups(mix(self.g, self.h))[1]
        times = np.bincount(context, self.c)
        del ratio, p1, last, known, rare
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(self.c > 0, m.d3[np.minimum(self.c, GOOD_TURING + 1)] * self.c / times[context], 0.0)
        p2 = p2[self.pair]
        self.g = self.w = self.pair = None  # most of the memory, not needed again
        factor, back = weights(times, np.bincount(context, ratio), np.bincount(context, p2 * (self.c > 0)), 1e-300)
        score = np.log10(np.where(self.c > 0, factor[context] * ratio, back[context] * p2))
        begin = self.words == BEGIN
        base, there = np.where(begin, 0.0, np.log10(m.lower(heads))), np.where(begin, 0, heads > 0)
        return score, base[self.word], there[self.word].astype(np.int64)

    def sums(self, bucket: int, counts: list[tuple], totals: list[tuple], shared: int) -> Iterator[tuple[int, tuple]]:
        """(chunk, sums by document), and the values of trigrams that came without documents."""
        values, at = self.weigh(counts, totals), 0
        for piece, size in zip(self.pieces, self.sizes, strict=True):
            chunk, runs, who, n = piece[0], *(unpack(x, np.uint32) for x in piece[6:])
            row = self.row[at : at + size]
            at += size
            many = runs > shared
            if many.any():
                yield chunk, ("values", bucket, *(x[row[many]] for x in values))
            if len(who):
                docs, inverse = np.unique(who, return_inverse=True)
                which = np.repeat(row[~many], runs[~many])
                yield chunk, ("sums", docs, *(np.bincount(inverse, x[which] * n) for x in values))


def replies(model: Model, bucket: int, rows: dict[str, list[tuple]]) -> Iterator[tuple[int, tuple]]:
    """Counts of the words that are asked for, counts of the pairs of split words over all their cells, and sums of these pairs."""
    parts = [(unpack(w, np.uint64), unpack(c, np.int64)) for w, c in rows["own"]] + [(np.array([~np.uint64(0)]), np.zeros(1, np.int64))]
    names, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(names)
    names, times = names[order], times[order]

    def count(words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, words)
        return np.where(names[at] == words, times[at], 0)

    for source, words in rows["ask"]:
        yield source, ("counts", bucket, pack(count(unpack(words, np.uint64))))
    if rows["pairs"]:
        sources = sorted(rows["pairs"])
        h, w, c = (np.concatenate(x) for x in zip(*((unpack(a, np.uint64), unpack(b, np.uint64), unpack(n, np.int64)) for _, a, b, n in sources), strict=True))
        _, first, at = np.unique(mix(h, w), return_index=True, return_inverse=True)
        total = np.bincount(at, c).astype(np.int64)
        start = 0
        for source, a, _, _ in sources:
            size = len(unpack(a, np.uint64))
            yield source, ("totals", bucket, pack(total[at[start : start + size]]))
            start += size
        h, w = h[first][total > 0].astype(np.int64), w[first][total > 0]
        total = total[total > 0]
        last = np.where(w < TOP, model.count[np.where(w < TOP, w, END).astype(np.int64)], count(w))
        for word in np.unique(h).tolist():
            mine = h == word
            classes = np.bincount(np.minimum(total[mine], GOOD_TURING + 1), total[mine], GOOD_TURING + 2)
            yield bucket, ("split", word, counts_of_counts(total[mine]), classes, float(model.lower(last[mine]).sum()))


def add_up(rows: Iterable[tuple[int, tuple]], end: tuple[float, float, int]) -> Iterator[tuple]:
    """Rows of ``SCORES`` from the sums of each chunk."""
    for _, found in by_bucket(rows):
        ids, mask, tokens, kept = found["documents"][0]
        total = [np.zeros(len(ids)), np.full(len(ids), end[0]), np.full(len(ids), float(end[1]))]
        for docs, *sums in found["sums"]:
            for x, s in zip(total, sums, strict=True):
                x[docs] += s
        for bucket, *values in found["values"]:
            runs, who, n = (unpack(x, np.uint32) for x in kept[bucket])
            for x, v in zip(total, values, strict=True):
                np.add.at(x, who, np.repeat(v, runs) * n)
        score, base, known = total
        for i in range(len(ids)):
            yield None if mask[i] else int(ids[i]), int(tokens[i]), int(known[i]), float(base[i]), float(score[i])


def fit_and_sum(docs: DataFrame, model: Model, *, chunk_tokens: int, shared: int):
    """The fitted model, and an RDD of (chunk, sums) over one shuffle of the trigrams."""
    sc = docs.sparkSession.sparkContext
    buckets = model.buckets
    same = int  # partitions by bucket: the shuffles below share it, so they meet without another one
    first = sc.broadcast(model)
    work = docs.rdd.mapPartitionsWithIndex(lambda k, rows: trigrams(rows, first.value, k, chunk_tokens, shared)).partitionBy(buckets, same)

    def ask(rows):
        for bucket, kinds in by_bucket(rows):
            if kinds["trigrams"]:
                yield from Shelf(first.value, kinds["trigrams"]).asks(bucket)

    asked = work.mapPartitions(ask).partitionBy(buckets, same)
    size = len(model.cells)

    def facts(rows):
        ones3, ones2, rare, n, ends, count = 0, 0, 0, 0, 0, np.zeros(size, np.int64)
        for _, row in rows:
            if row[0] == "facts":
                (o3, o2, v, tokens, last), words, c = row[1:]
                ones3, ones2, rare, n, ends = ones3 + o3, ones2 + o2, rare + v, n + tokens, ends + last
                count[words] += c
        yield ones3, ones2, rare, n, ends, count

    ones3, ones2, rare, n, ends, count = asked.mapPartitions(facts).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
    count[END] = ends
    model.count, model.n, model.v = count, int(n), int(rare + (count[WORDS:] > 0).sum() + (ends > 0))
    counted = sc.broadcast(model)

    def reply(rows):
        for bucket, kinds in by_bucket(rows):
            yield from replies(counted.value, bucket, kinds)

    told = asked.mapPartitions(reply).partitionBy(buckets, same)
    model.factor, model.backoff = np.ones(size), np.ones(size)
    split: dict[int, list] = {}
    if (model.cells > 1).any():
        add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
        found = told.filter(lambda row: row[1][0] == "split").map(lambda row: (row[1][1], list(row[1][2:]))).reduceByKey(add)
        split = dict(found.collect())  # a row for each split word
    none = np.zeros(GOOD_TURING + 2, np.int64)
    ones2 = ones2 + sum((x[0] for x in split.values()), none)
    model.d2, model.d3 = discounts(ones2 + none), discounts(ones3 + none)
    for word, (_, classes, low) in split.items():
        c = model.count[word : word + 1]
        factor, backoff = weights(c, np.array([(model.d2 * classes).sum() / c[0]]), np.array([low]), model.lower(0))
        model.factor[word], model.backoff[word] = factor[0], backoff[0]
    fitted = sc.broadcast(model)

    def score(rows):
        for bucket, kinds in by_bucket(rows):
            for row in kinds["documents"]:
                yield row[0], ("documents", *row[1:])
            if kinds["trigrams"]:
                yield from Shelf(fitted.value, kinds["trigrams"]).sums(bucket, kinds["counts"], kinds["totals"], shared)

    return model, work.union(told).mapPartitions(score)


def score_documents(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", hot: int = 32_000, bucket_tokens: int = 2_000_000, chunk_tokens: int = 1_000_000, shared: int = 64) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, train_tokens) for each row; the model is learnt from the rows of ``training``.

    Scores are log10 probabilities of whole texts, the end included. Null and empty texts are the end alone. Null and
    repeated ids are scored row by row; without training rows every word is unknown. ``hot``, ``shared`` (documents of a
    chunk that go along with a trigram) and the sizes of buckets and chunks change no score. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), training.alias("learn"))
    words, n = frequent_words(rows, hot)
    buckets = max(16, -(-n // bucket_tokens))
    cells = np.array([1, 1, *(-(-4 * c // bucket_tokens) for _, c in words)], np.int64)
    model = Model({w: i for i, (w, _) in enumerate(words, WORDS)}, cells, buckets)
    model, sums = fit_and_sum(rows, model, chunk_tokens=chunk_tokens, shared=shared)
    end = float(np.log10(model.lower(int(model.count[END]))))
    found = sums.partitionBy(buckets).mapPartitions(lambda rows, end=(end, model.count[END] > 0): add_up(rows, end))
    return spark.createDataFrame(found, SCORES, verifySchema=False).withColumn("train_tokens", F.lit(model.n).cast("long"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(docs, in_training("doc_id")).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (~in_training("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
