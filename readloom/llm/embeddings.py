"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of a label are packed into tiles. For two tiles the products of the int8 codes are computed at once; with each
vector's exact quantisation error e and code length c,

    |x.y - (code x).(code y)| <= c(x) e(y) + e(x)

so only pairs whose bound reaches the threshold can be links, and those alone are computed again from the full vectors in double precision.
Pairs of tiles travel as codes, an eighth of the vectors; full vectors follow only where a pair of tiles holds such a pair.
Tiles whose projections lie too far apart for any link are never paired. A pair of tiles hands on counts and a star forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, out_schema, rows_of, saved, table
from .components import components

PROJECTIONS = 4
VECTORS = "id long, label string, dim int, digest binary, place double, vector binary"
TILES = "label string, dim int, tile long, n int, ids binary, copies binary, vectors binary, codes binary, bounds binary, low array<double>, high array<double>"
#: The tiles of a label are paired in so many tasks, as a label may hold most tiles.
DEAL = 16
FOUND = "id long, links long, root long"


def directions(dim: int) -> np.ndarray:
    """Fixed orthonormal directions."""
    q, _ = np.linalg.qr(np.random.RandomState(dim).standard_normal((dim, min(dim, PROJECTIONS))))
    return q


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def prepare(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``VECTORS``: full vectors in double precision. Where a vector or label can link with nothing, dim is null."""
    schema = out_schema(VECTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, axes = Rows(schema, 8 << 20), {}
        for batch in batches:
            for key, label, vector in rows_of(batch, "id", "label", "vector"):
                row = (key, label, None, None, None, None)
                if label is not None and vector and None not in vector:
                    x = np.array(vector, np.float64) + 0.0  # no negative zero
                    if np.isfinite(x).all() and x.any():
                        if len(x) not in axes:
                            axes[len(x)] = directions(len(x))
                        place = float((unit(x[None]) @ axes[len(x)])[0, 0])
                        row = (key, label, len(x), xxhash.xxh3_128_digest(x.tobytes()), place, x.tobytes())
                if out.add(row, len(row[-1] or b"")):
                    yield out.batch()
        yield from out.rest()

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vector")).mapInArrow(run, VECTORS)


def pack(reps: DataFrame, size: int) -> DataFrame:
    """Tiles of at most ``size`` vectors of one label and dimension, neighbours along the first direction together."""
    schema = out_schema(TILES)

    def tile(rows: list[tuple], number: int) -> tuple:
        label, dim = rows[0][1], rows[0][2]
        x = np.frombuffer(b"".join(r[4] for r in rows), np.float64).reshape(len(rows), dim)
        u = unit(x)
        at = u @ directions(dim)
        q, *bounds = codes(u)
        return label, dim, number, len(rows), np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[3] for r in rows], np.int64).tobytes(), x.tobytes(), q.tobytes(), np.stack(bounds).tobytes(), at.min(axis=0).tolist(), at.max(axis=0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], TaskContext.get().partitionId() << 32
        out = Rows(schema, 4 << 20)
        for batch in batches:
            for row in rows_of(batch, "id", "label", "dim", "copies", "vector"):
                if held and (len(held) == size or held[0][1:3] != row[1:3]):
                    due = out.add(tile(held, number), 9 * len(held) * held[0][2])
                    held, number = [], number + 1
                    if due:
                        yield out.batch()
                held.append(row)
        if held:
            out.add(tile(held, number))
        yield from out.rest()

    order = ["label", "dim", "place", "id"]
    return reps.select("id", "label", "dim", "copies", "vector", "place").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, TILES)


def codes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales, lengths of what the codes stand for, and lengths of what they leave out."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(np.einsum("ij,ij->i", back, back)), np.sqrt(np.einsum("ij,ij->i", u - back, u - back))


def candidates(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b), unit vectors, whose cosine may reach the threshold."""
    return np.nonzero(reaches(codes(a), codes(b), threshold))


def reaches(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Whether the bound of each pair, as ``codes`` gives them, reaches the threshold."""
    qa, sa, ca, ea = a
    qb, sb, _, eb = b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of products stay exact whole numbers
    product = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64)
    product *= sa[:, None]
    product *= sb
    product += ca[:, None] * eb
    product += (ea + 1e-9)[:, None]  # and what doubles round off
    return product >= threshold


def tile_links(ids_a, copies_a, a, ids_b, copies_b, b, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links to other vectors counted with copies, smallest id of its component among these links)."""
    i, j = candidates(unit(a), unit(b), threshold)
    if same:
        i, j = i[i < j], j[i < j]
    keep = []
    for at in range(0, len(i), 100_000):
        x, y = a[i[at : at + 100_000]], b[j[at : at + 100_000]]
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        keep.append(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= threshold)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    i, j = i[keep], j[keep]
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    copies = copies_a if same else np.concatenate([copies_a, copies_b])
    j = j if same else j + len(ids_a)
    links = np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
    root = ids.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            break
    hit = links > 0
    return ids[hit], links[hit], root[hit]


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile: int = 2048) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Only vectors of equal label and dimension are compared. Null labels, and vectors that are null, empty, zero or hold
    null or non-finite components, link with nothing. Rows with equal labels and vectors are one vector with copies
    until the end. A null id gets no component and counts as kept; repeated ids keep their rows. Other columns are
    ignored; an empty table gives no rows.
    """
    known = saved(prepare(vectors, id_col, vec_col, label_col), "vectors")
    same = ["label", "dim", "digest"]
    groups = known.where("dim IS NOT NULL AND id IS NOT NULL").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    groups = saved(groups, "groups")
    reps = known.join(groups.select(F.col("rep").alias("id"), *same, "copies"), ["id", *same]).dropDuplicates(same)
    tiles = saved(pack(reps, tile), "tiles")
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    deal = F.pmod(F.xxhash64("tile"), F.lit(DEAL)).cast("int")
    left = tiles.select("label", "dim", F.col("tile").alias("ta"), F.col("low").alias("la"), F.col("high").alias("ha"), deal.alias("deal"))
    right = tiles.select("label", "dim", F.col("tile").alias("tb"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("deal"))
    close = F.forall(F.arrays_zip("la", "ha", "lb", "hb"), lambda z: (z["la"] <= z["hb"] + reach) & (z["lb"] <= z["ha"] + reach))
    paired = left.join(right, ["label", "dim", "deal"]).where(F.col("ta") <= F.col("tb")).where(close).select("ta", "tb")
    coded = lambda s: tiles.select(F.col("tile").alias(f"t{s}"), F.col("dim").alias(f"d{s}"), F.col("codes").alias(f"q{s}"), F.col("bounds").alias(f"b{s}"))
    met_schema = out_schema("ta long, tb long")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of tiles in which a pair may reach the threshold."""
        for batch in batches:
            out = Rows(met_schema)
            for ta, tb, dim, qa, ba, qb, bb in rows_of(batch, "ta", "tb", "da", "qa", "ba", "qb", "bb"):
                a, b = ((np.frombuffer(q, np.int8).reshape(-1, dim), *np.frombuffer(x, np.float64).reshape(3, -1)) for q, x in ((qa, ba), (qb, bb)))
                hit = reaches(a, b, threshold)
                if (np.triu(hit, 1) if ta == tb else hit).any():
                    out.add((ta, tb))
            yield from out.rest()

    paired = saved(paired.join(coded("a"), "ta").join(coded("b"), "tb").mapInArrow(meet, "ta long, tb long"), "pairs")
    body = lambda s: tiles.select(F.col("tile").alias(f"t{s}"), F.col("dim").alias(f"d{s}"), F.col("ids").alias(f"i{s}"), F.col("copies").alias(f"c{s}"), F.col("vectors").alias(f"v{s}"))
    work = paired.join(body("a"), "ta").join(body("b"), "tb")
    schema = out_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in ("ta", "tb", "da", "ia", "ca", "va", "ib", "cb", "vb")}
                longs = lambda n: np.frombuffer(r[n], np.int64)  # noqa: B023, E731
                grid = lambda n: np.frombuffer(r[n], np.float64).reshape(-1, r["da"])  # noqa: B023, E731
                ids, links, root = tile_links(longs("ia"), longs("ca"), grid("va"), longs("ib"), longs("cb"), grid("vb"), threshold, r["ta"] == r["tb"])
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], schema=schema)

    found = saved(work.mapInArrow(run, FOUND), "links")
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    facts = groups.join(links, "rep", "left").join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
    apart = known.where("dim IS NULL").select("id", *same)  # null keys would all meet in one task
    out = known.where("dim IS NOT NULL").select("id", *same).join(facts, same, "left")
    out = out.unionByName(apart, allowMissingColumns=True)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    n = F.when(F.col("id").isNotNull(), F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).otherwise(0)
    return out.select("id", n.cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return near_vectors(vectors).withColumnRenamed("id", "vec_id")


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id)::BIGINT AS n_links,
       least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
       vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept
FROM embeddings
"""
