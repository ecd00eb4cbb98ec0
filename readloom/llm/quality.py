"""Quality classifier by compression.

Two raw-content Zstandard dictionaries are made of good and bad labelled text. A text is cut
into blocks; each block is compressed once with either dictionary. The difference of the two
sums of sizes, over the length of the text, says which kind of text the document resembles (over a compressed
size it would be noise where a text repeats itself);
a logistic curve fitted to labelled documents that are in neither dictionary makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, out_schema, rows_of, saved, table, text_bytes

#: Texts are compressed in blocks of so many bytes: in longer ones a text's own repeats would hide the dictionary.
BLOCK = 1024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    intercept: float
    slope: float

    def compressors(self) -> tuple:
        """Compressors with the good and with the bad dictionary."""
        made = []
        for data in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
            if words:
                words.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False))
        return tuple(made)

    def difference(self, text: bytes, compressors: tuple) -> float:
        """(size with the bad dictionary - size with the good one) / length; 0 for an empty text."""
        if not text:
            return 0.0
        good, bad = (sum(len(c.compress(text[at : at + BLOCK])) for at in range(0, len(text), BLOCK)) for c in compressors)
        return (bad - good) / len(text)

    def score(self, difference: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope by Newton's method; either class counts half. No slope below 0 and none without both classes."""
    if not len(y) or y.min() == y.max():
        return (0.0 if not len(y) else 2.0 * (2 * float(y[0]) - 1)), 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    scale = float(x.std()) or 1.0
    a = np.stack([np.ones_like(x), x / scale], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1] / scale))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def spread(text: bytes, most: int, piece: int = 256) -> bytes:
    """At most ``most`` bytes of a text, in pieces spread evenly from its begin to its end."""
    if len(text) <= most:
        return text
    n = max(1, most // piece)
    last = len(text) - min(piece, most)
    return b"\n".join(text[at : at + piece] for at in (last * i // max(1, n - 1) for i in range(n)))[:most]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, dictionary_bytes: int = 1_000_000) -> Model:
    """Fits on ``per_class`` labelled documents of either class, those of the smallest MD5 of the id, outside the fold.

    The sample is bounded by its rows whatever the input: its ids are chosen from ``labels`` alone and broadcast to find the
    texts. About two thirds go to the dictionaries: each text gives an equal share of ``dictionary_bytes`` in pieces spread
    over the whole of it, as a dictionary is of bounded size. The curve is fitted on the other third, whole texts, scored as
    documents are. Only the dictionaries and a number for each text of the curve reach the driver. Of rows with equal
    ids the smallest text is taken, of ids with two labels the better one. A class without documents leaves its dictionary
    empty and every score neutral.
    """
    order = F.md5(F.col(id_col).cast("string"))
    usable = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("quality").cast("int").alias("_rl_good"))
    chosen = [usable.where(F.col("_rl_good") == k).withColumn("_rl_order", order).orderBy("_rl_order").limit(per_class) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])  # at most 2 * per_class rows
    found = docs.select(id_col, text_bytes(text_col).alias("_rl_text")).join(F.broadcast(ids), id_col)
    found = found.groupBy("_rl_order", "_rl_good").agg(F.min("_rl_text").alias("text"))
    sample = saved(found.select(F.col("_rl_good").alias("good"), F.col("_rl_order").alias("name"), "text", (F.crc32("_rl_order") % 3 == 2).alias("curve")), "labelled")
    numbers = {r.good: r.n for r in sample.where("NOT curve").groupBy("good").agg(F.count("*").alias("n")).collect()}
    parts_schema = out_schema("good int, name string, part binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(parts_schema, 1 << 20)
        for batch in batches:
            for good, name, text in rows_of(batch, "good", "name", "text"):
                if out.add((good, name, spread(text, max(64, dictionary_bytes // numbers[good]))), len(text)):
                    yield out.batch()
        yield from out.rest()

    parts = sorted(sample.where("NOT curve").select("good", "name", "text").mapInArrow(cut, "good int, name string, part binary").collect())  # bounded as the sample and the dictionaries are
    content = [b"\n".join(bytes(r.part) for r in parts if r.good == k)[:dictionary_bytes] for k in (0, 1)]
    raw = Model(content[1], content[0], 0.0, 0.0)
    shipped = docs.sparkSession.sparkContext.broadcast(raw)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        tools = model.compressors()
        for batch in batches:
            found = [model.difference(t, tools) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(found, pa.float64())], names=["good", "x"])

    points = sorted((r.good, r.x) for r in sample.where("curve").select("good", "text").mapInArrow(differences, "good int, x double").collect())
    intercept, slope = logistic(np.array([x for _, x in points]), np.array([k for k, _ in points], float))
    return Model(raw.good, raw.bad, intercept, slope)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability that the text is good: whole texts, only the text counts.

    Null and empty texts get the score of difference 0. All other columns pass through (one named ``score_col`` is
    replaced). No shuffle; the model is of bounded size.
    """
    docs = docs.drop(score_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped.value
        tools = fitted.compressors()
        for batch in batches:
            scores = [fitted.score(fitted.difference(t, tools)) for t in batch.column("_rl_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, score_col])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.withColumn("_rl_text", text_bytes(text_col)).mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
