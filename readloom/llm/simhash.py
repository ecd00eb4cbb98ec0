"""SimHash near-duplicates by a grid join on segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of 16 segments of 4 bits. The
Manhattan distance of two embeddings is at most the Hamming distance, so fingerprints
within 2 bits lie within 2 in the grid and share at least one cell when each is entered in its own
cell and in all cells one step away. The cells are joined by one shuffle, and each pair
that meets is verified on the fingerprints themselves.

A cell with more than a few fingerprints (a crowd of near copies) is not paired: its
fingerprints are entered under every fingerprint within one bit of themselves. All that
meet under such a key are within 2 bits of each other, so a star to the smallest of them
keeps the same components with work in proportion to their number, whatever the crowd.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import out_schema, rows_of, saved, table, text_bytes
from .components import components

SEED = 42
SEGMENTS, SEGMENT_BITS = 16, 4
#: Fingerprints of a cell that are compared with each other; fuller cells take the other way.
CROWD = 32


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, from bit 0: eight bytes are added at a time."""
    out = np.zeros(64, np.int64)
    ones = np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255):  # a byte holds 255
        part = hashes[at : at + 255]
        lanes = np.array([((part >> np.uint64(k)) & ones).sum(dtype=np.uint64) for k in range(8)], "<u8")
        out += lanes.view(np.uint8).reshape(8, 8).T.reshape(64)
    return out


def bit_majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``counts`` hashes (all at least 1): bits set in over half of the run."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.zeros(len(counts), np.uint64)
    fewest = np.flatnonzero(counts <= 255)
    ones = np.uint64(0x0101010101010101)
    if len(fewest):
        # runs that fit a byte: eight sums of all runs at once
        for k in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(k)) & ones, starts)[fewest]
            for byte in range(8):
                many = (lanes >> np.uint64(8 * byte)) & np.uint64(255)
                out[fewest] |= (2 * many > counts[fewest].astype(np.uint64)).astype(np.uint64) << np.uint64(8 * byte + k)
    for i in np.flatnonzero(counts > 255):
        set_bits = 2 * bit_sums(hashes[starts[i] : starts[i] + counts[i]]) > counts[i]
        out[i] = np.packbits(set_bits, bitorder="little").view("<u8")[0]
    return out


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of every run of ``width`` tokens, or of the whole sequence where it is shorter; nothing without tokens."""
    tokens = text.lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return [digest(joined, SEED)]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - width + 1].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fingerprint as signed long) for each row, and the string columns to ``carry``. Texts without tokens, null ones too, have fingerprint 0."""
    ddl = ", ".join(["id long", "fp long", *(f"{c} string" for c in carry)])
    schema = out_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            n = batch.num_rows
            fps = np.zeros(n, np.uint64)
            hashes: list[int] = []
            rows: list[int] = []
            counts: list[int] = []

            def settle(fps=fps, hashes=hashes, rows=rows, counts=counts) -> None:
                if rows:
                    fps[rows] = bit_majorities(np.array(hashes, np.uint64), np.array(counts))
                    hashes.clear(), rows.clear(), counts.clear()

            for i, (text,) in enumerate(rows_of(batch, "text")):
                if found := shingle_hashes(text, width):
                    hashes += found
                    rows.append(i)
                    counts.append(len(found))
                    if len(hashes) > 500_000:
                        settle()
            settle()
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps.view(np.int64)), *(batch.column(c) for c in carry)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), *carry).mapInArrow(run, ddl)


def grid_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every grid cell within one step of each fingerprint's embedding."""
    shifts = np.arange(0, 64, SEGMENT_BITS, dtype=np.uint64)
    counts = np.bitwise_count((fps[:, None] >> shifts) & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.uint64)
    own = (counts << shifts).sum(axis=1, dtype=np.uint64)
    step = np.uint64(1) << shifts
    up, down = own[:, None] + step, own[:, None] - step
    rows = np.arange(len(fps))
    wide = np.broadcast_to(rows[:, None], up.shape)
    can_up, can_down = counts < SEGMENT_BITS, counts > 0
    return np.concatenate([rows, wide[can_up], wide[can_down]]), np.concatenate([own, up[can_up], down[can_down]])


LINKS = "a long, b long, fp long"


def near_links(reps: DataFrame, *, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) over the ids of ``reps`` (rep, fp; fingerprints distinct) with the components of all links within
    ``distance`` (at most 2) bits: each link itself where a cell is not crowded, else stars."""
    if not 0 <= distance <= 2:
        raise ValueError("the grid covers distances up to 2")
    cells_ddl = "cell long, fp long, rep long"
    cells_schema, links_schema = out_schema(cells_ddl), out_schema(LINKS)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, ids = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("rep").to_numpy(zero_copy_only=False)
            rows, cells = grid_cells(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(fps[rows]), pa.array(ids[rows])], schema=cells_schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell. A crowded cell gives its rows (b null), any other its verified pairs."""
        held = np.zeros((0, 3), np.int64)  # of the last cell so far: all rows, or crowd + 1 of them once it is crowded
        crowded = None

        def emit(rows: np.ndarray) -> pa.RecordBatch | None:
            cell = rows[:, 0]
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sizes = np.diff(np.append(starts, len(rows)))
            size = np.repeat(sizes, sizes)
            many = size > crowd
            few = rows[(size > 1) & ~many]
            left, right = [], []
            for lag in range(1, int(sizes[sizes <= crowd].max(initial=1))):
                near = (few[lag:, 0] == few[:-lag, 0]) & (np.bitwise_count((few[lag:, 1] ^ few[:-lag, 1]).view(np.uint64)) <= distance)
                left.append(few[:-lag][near, 2])
                right.append(few[lag:][near, 2])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            k, c = pairs.shape[1], int(many.sum())
            if not k + c:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([pairs[0], rows[many, 2]])), pa.array(np.concatenate([pairs[1], np.zeros(c, np.int64)]), mask=np.arange(k + c) >= k), pa.array(np.concatenate([np.zeros(k, np.int64), rows[many, 1]]))], schema=links_schema)

        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "fp", "rep")], axis=1)
            if not len(rows):
                continue
            if crowded is not None:  # goes on with a cell already known to be crowded
                more = rows[:, 0] == crowded
                if more.any() and (out := emit_rows(rows[more], links_schema)):
                    yield out
                rows = rows[~more]
                if not len(rows):
                    continue
                crowded = None
            rows = np.concatenate([held, rows])
            last = rows[:, 0] == rows[-1, 0]
            if int(last.sum()) > crowd:
                crowded, held = int(rows[-1, 0]), np.zeros((0, 3), np.int64)
            else:
                held, rows = rows[last], rows[~last]
            if len(rows) and (out := emit(rows)):
                yield out
        if len(held) and (out := emit(held)):
            yield out

    def emit_rows(rows: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 2]), pa.nulls(len(rows), pa.int64()), pa.array(rows[:, 1])], schema=schema)

    cells = reps.select("rep", "fp").mapInArrow(enter, cells_ddl)
    met = saved(cells.repartition(F.col("cell")).sortWithinPartitions("cell", "fp").mapInArrow(meet, LINKS), "met")
    pairs = met.where("b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v"))

    crowds = met.where("b IS NULL").select(F.col("a").alias("rep"), "fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    # under a fingerprint within one bit all are within 2 bits of each other; with one bit left out, within that one bit
    cleared = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(F.col("fp").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))).alias("fp"), i.alias("bit")))
    whole = F.transform(F.concat(F.array("fp"), flips) if distance == 2 else F.array("fp"), lambda x: F.struct(x.alias("fp"), F.lit(-1).alias("bit")))
    keys = crowds.select("rep", F.explode(cleared if distance == 1 else whole).alias("key"))
    stars = keys.groupBy("key").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1")
    return pairs.unionByName(keys.join(stars, "key").where("rep <> v").select(F.col("rep").alias("u"), "v"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """(id, fp, component) for each row: component is the smallest id reachable over fingerprints within ``distance``.

    Rows of equal fingerprints, among them all without tokens, are grouped before any comparison. A null id gets a
    fingerprint but is nobody's component; where no row of a group has an id, the component is null. Repeated ids keep
    their rows. Other columns are ignored; an empty table gives no rows.
    """
    known = saved(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    return join_groups(known, saved(components_of(known, distance), "groups"), "fp").select("id", "fp", "component")


def components_of(known: DataFrame, distance: int) -> DataFrame:
    """(fp, component, n: its rows) of each fingerprint of ``known`` (id, fp)."""
    reps = known.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    linked = components(near_links(reps.where("rep IS NOT NULL"), distance=distance))
    return reps.join(linked, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"), "n")


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``groups`` (key, n: its rows, component).

    Keys with over one in 10,000 of all rows, of which there are fewer than 10,000, are broadcast: no task gets the rows of a hot key.
    """
    share = rows.count() / 10_000
    hot, cold = F.broadcast(groups.where(F.col("n") > share).drop("n")), groups.where(F.col("n") <= share).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def in_components(known: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """(component, id, md5) of ``known`` (key, id, md5); ``linked`` (key, component) leaves out keys that are their own component."""
    groups = known.groupBy(key).agg(F.count("*").alias("n")).join(linked, key, "left").withColumn("component", F.coalesce("component", key))
    return join_groups(known.select(key, "id", "md5"), saved(groups, "groups"), key)


def dedup_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, then of the smallest MD5 of the text.

    Rows are told apart by id and text, so a repeated id loses only those of its rows that are near copies of another.
    Of rows equal in both, the one with the smallest hash of its columns stays. Rows with null ids stay; null texts
    count as empty ones, which are copies of each other. Other columns pass through; an empty table gives no rows.
    """
    digest = F.md5(text_bytes(text_col))
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), digest.alias("md5"), F.col(text_col).alias("text"))
    known = saved(fingerprints(named, id_col="id", text_col="text", width=width, carry=("md5",)), "fingerprints")
    prints = known.select("fp", F.col("fp").alias("rep")).distinct()  # groups go by fingerprints, as ids may repeat
    linked = components(near_links(prints, distance=distance)).withColumnRenamed("node", "fp")
    return keep_first(docs, in_components(known, linked, "fp"), id_col, digest)


def keep_first(docs: DataFrame, rows: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """``docs`` with one row of each component of ``rows`` (component, id, md5)."""
    rows = rows.groupBy("component", "id", "md5").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("id", "md5")).alias("first")).select("first.*", F.lit(True).alias("stays"))
    told = rows.join(first, ["id", "md5"], "left")  # not by component, which may hold a third of all rows
    rows = saved(told.select(F.col("id").alias("_rl_id"), F.col("md5").alias("_rl_md5"), F.coalesce("stays", F.lit(False)).alias("stays"), "n"), "members")
    same = [F.col(id_col).cast("long") == F.col("_rl_id"), digest == F.col("_rl_md5")]
    kept = docs.join(rows.where("NOT stays").select("_rl_id", "_rl_md5"), same, "left_anti")
    again = rows.where("stays AND n > 1").select("_rl_id", "_rl_md5")
    if again.isEmpty():
        return kept
    order = Window.partitionBy("_rl_id", "_rl_md5").orderBy(F.xxhash64(*docs.columns))
    one = kept.join(again, same).withColumn("_rl_row", F.row_number().over(order)).where("_rl_row = 1").select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(one)


#: Fingerprints of similar texts have eight words of 64 bits: texts as alike as 0.8 differ in 15 of 100 bits.
WORDS = 8
PRINTS = [f"f{k}" for k in range(WORDS)]
SKETCH = f"id long, md5 string, {', '.join(f'{p} long' for p in PRINTS)}, parts array<long>"


def bit_limits(similarity: float) -> tuple[int, int]:
    """The bits expected to differ in texts of this Jaccard similarity, less two deviations and plus three."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 64 * WORDS
    deviation = math.sqrt(n * p * (1 - p))
    return math.floor(n * p - 2 * deviation), math.floor(n * p + 3 * deviation)


def sketches(docs: DataFrame, *, width: int, parts: int, least: int) -> DataFrame:
    """``SKETCH`` of (id, md5, text): a fingerprint of all shingles, and one of each of ``parts`` samples of them.

    A sample is the ``least`` shingles that come first under as many orders of their hashes, so that texts of similarity J have
    one in common with probability J ** least. A text without tokens has fingerprint 0 and no samples.
    """
    schema = out_schema(SKETCH)
    rng = np.random.RandomState(SEED)
    odd = lambda n: rng.randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    seeds, orders = odd(WORDS), odd(parts * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words, samples = np.zeros((n, WORDS), np.uint64), np.zeros((n, parts), np.uint64)
            hashes: list[int] = []
            rows: list[int] = []
            counts: list[int] = []

            def settle(words=words, samples=samples, hashes=hashes, rows=rows, counts=counts) -> None:
                if not rows:
                    return
                h, sizes = np.array(hashes, np.uint64), np.array(counts)
                starts = np.cumsum(sizes) - sizes
                for k in range(WORDS):
                    mixed = (h ^ (h >> np.uint64(29))) * seeds[k]
                    words[rows, k] = bit_majorities(mixed ^ (mixed >> np.uint64(32)), sizes)
                for k in range(parts):
                    part = np.full(len(rows), k + 1, np.uint64)
                    for order in orders[k * least : (k + 1) * least]:
                        mixed = h * order
                        mixed ^= mixed >> np.uint64(32)
                        part = (part ^ (part >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(mixed, starts)
                    samples[rows, k] = part
                hashes.clear(), rows.clear(), counts.clear()

            for i, (text,) in enumerate(rows_of(batch, "text")):
                if found := set(shingle_hashes(text, width)):
                    hashes += found
                    rows.append(i)
                    counts.append(len(found))
                    if len(hashes) > 500_000:
                        settle()
            filled = np.zeros(n, bool)
            filled[rows] = True
            settle()
            filled |= words.any(axis=1)
            sizes = np.where(filled, parts, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(samples[filled].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("md5"), *(pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(WORDS)), lists], schema=schema)

    return docs.select("id", "md5", text_bytes("text").alias("text")).mapInArrow(run, SKETCH)


def nearest_tree(prints: np.ndarray, sure: int, limit: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) that span the components of links within ``limit`` bits, and their bits: in each pair of tiles the nearest first.

    A few fingerprints are first compared with all and linked with those within ``sure`` bits; tiles whose fingerprints are then
    one component are not compared, so a crowd of near copies takes work in proportion to its number.
    """
    n = len(prints)
    root = list(range(n))
    found: list[tuple[int, int, int]] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(pairs: Iterable[tuple[int, int, int]]) -> None:
        for bits, a, b in pairs:
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append((a, b, bits))

    leader = 0
    for _ in range(8):
        bits = np.bitwise_count(prints ^ prints[leader]).sum(axis=1)
        near = np.flatnonzero(bits <= sure)
        join(zip(bits[near].tolist(), [leader] * len(near), near.tolist(), strict=True))
        leader = next((x for x in range(leader + 1, n) if root[x] == x), n)
        if leader == n:
            break
    flat = np.array([find(x) for x in range(n)])  # of some time before: what was one then is still one
    for i in range(0, n, tile):
        for j in range(i, n, tile):
            if (flat[i : i + tile] == flat[i]).all() and (flat[j : j + tile] == flat[i]).all():
                continue
            for k in (i, j):
                flat[k : k + tile] = [find(x) for x in range(k, min(k + tile, n))]
            ours, theirs = flat[i : i + tile], flat[j : j + tile]
            bits = np.bitwise_count(prints[i : i + tile, None] ^ prints[None, j : j + tile]).sum(axis=2)
            a, b = np.nonzero((bits <= limit) & (ours[:, None] != theirs))
            order = np.argsort(bits[a, b], kind="stable")
            a, b = a[order], b[order]
            join(zip(bits[a, b].tolist(), (a + i).tolist(), (b + j).tolist(), strict=True))
    return tuple(np.array(column, np.int64) for column in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def similar_links(nodes: DataFrame, sure: int, limit: int) -> DataFrame:
    """Edges (u, v, sure) that span the links of ``nodes`` (node, f0.., parts) that share a part's fingerprint and whose whole
    ones are within ``limit`` bits: a tree for each component of each group, sure where within ``sure`` bits.

    Parts are first counted by node alone; fingerprints travel only for nodes that share a part with another.
    """
    links = out_schema("u long, v long, sure boolean")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(rows: np.ndarray) -> pa.RecordBatch | None:
            edges = []
            starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            ends = np.append(starts[1:], len(rows))
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                u, v, bits = nearest_tree(rows[a:b, 2:].view(np.uint64), sure, limit)
                u, v = rows[a + u, 1], rows[a + v, 1]
                edges.append(np.stack([np.maximum(u, v), np.minimum(u, v), bits <= sure]))
            if not edges or not sum(e.shape[1] for e in edges):
                return None
            u, v, near = np.unique(np.concatenate(edges, axis=1), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(near.astype(bool))], schema=links)

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + WORDS)], axis=1)
            if not len(rows):
                continue
            last = rows[:, 0] == rows[-1, 0]
            if last.all() and (not held or held[0][0, 0] == rows[0, 0]):
                held.append(rows)
                continue
            ready = np.concatenate([*held, rows[~last]])
            held = [rows[last]]
            if len(ready) and (out := settle(ready)):
                yield out
        if held and (out := settle(np.concatenate(held))):
            yield out

    entries = nodes.select(F.explode("parts").alias("part"), "node").repartition("part")
    shared = entries.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
    meeting = entries.join(shared, "part").join(nodes.select("node", *PRINTS), "node").select("part", "node", *PRINTS)
    return meeting.repartition("part").sortWithinPartitions("part", "node").mapInArrow(meet, "u long, v long, sure boolean").distinct()


def grid_links(nodes: DataFrame, sure: int, limit: int) -> DataFrame:
    """Edges as of ``similar_links`` between ``nodes`` whose first 64 bits meet in the grid of bit counts within 2 bits, verified on all bits.

    Nodes of equal first bits meet the smallest of them.
    """
    reps = saved(nodes.groupBy("f0").agg(F.min("node").alias("rep")), "reps")
    near = near_links(reps.select("rep", F.col("f0").alias("fp")))
    same = nodes.join(reps, "f0").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    pairs = near.unionByName(same).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    a, b = (nodes.select(F.col("node").alias(n), *(F.col(p).alias(f"{n}_{p}") for p in PRINTS)) for n in ("u", "v"))
    bits = sum((F.bit_count(F.col(f"u_{p}").bitwiseXOR(F.col(f"v_{p}"))) for p in PRINTS[1:]), F.bit_count(F.col("u_f0").bitwiseXOR(F.col("v_f0"))))
    return pairs.join(a, "u").join(b, "v").select("u", "v", bits.alias("bits")).where(F.col("bits") <= limit).select("u", "v", (F.col("bits") <= sure).alias("sure"))


def alike(pairs: DataFrame, texts: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose ``texts`` (node, text) have sets of shingles as alike as ``similarity``, exactly."""
    links = out_schema("u long, v long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(rows_of(batch, "a", "b")):
                x, y = set(shingle_hashes(a, width)), set(shingle_hashes(b, width))
                common = len(x & y)
                if common >= similarity * (len(x) + len(y) - common):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(kept, pa.int64())), batch.column("v").take(pa.array(kept, pa.int64()))], schema=links)

    first, second = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("u", "a"), ("v", "b")))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def dedup_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, parts: int = 14, least: int = 5) -> DataFrame:
    """``docs`` with one row of each group of similar texts: of shingles of ``width`` words, sets as alike as ``similarity``.

    Candidates are texts whose fingerprints of 64 bits meet in the grid of bit counts (``near_links``). Those of texts as alike as 0.8
    differ in 15 of 100 bits, where the grid tells them from no others, so texts that share the fingerprint of one of ``parts``
    samples of their shingles are candidates too. The fingerprints of all shingles, of 512 bits, are then compared. Pairs within the lower of ``bit_limits`` are similar (an error for one pair in forty
    just below ``similarity``), those beyond the upper are not; of those between, the nearest that link two components
    are compared by their whole texts. At 0.8 a pair is a candidate with probability 0.996 and within the upper limit with
    0.998. Which row stays, nulls and ties: as in ``dedup_documents``.
    """
    digest = F.md5(text_bytes(text_col))
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), digest.alias("md5"), F.col(text_col).alias("text"))
    known = saved(sketches(named, width=width, parts=parts, least=least).withColumn("node", F.xxhash64(*PRINTS)), "sketches")
    nodes = saved(known.groupBy("node", *PRINTS).agg(F.min("parts").alias("parts"), F.min(F.struct("id", "md5")).alias("one")), "nodes")
    limits = bit_limits(similarity)
    found = grid_links(nodes, *limits).unionByName(similar_links(nodes, *limits))
    links = saved(found.groupBy("u", "v").agg(F.max("sure").alias("sure")), "links")
    open_pairs = links.where("NOT sure").select("u", "v")
    asked = open_pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    owners = nodes.select("node", "one.*").join(asked, "node", "left_semi")  # of the table: below an aggregate the join would deal out all rows
    texts = saved(named.join(saved(owners, "owners"), ["id", "md5"]).select("node", text_bytes("text").alias("text")).dropDuplicates(["node"]), "asked")
    edges = links.where("sure").select("u", "v").unionByName(alike(open_pairs, texts, width=width, similarity=similarity))
    linked = components(edges)
    return keep_first(docs, in_components(known, linked, "node"), id_col, digest)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
