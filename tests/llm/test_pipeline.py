"""The pipeline against plain Python, and its stages on odd tables."""

import hashlib
import math
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from pyspark.sql import functions as F
from readloom.llm import quality
from readloom.llm.common import words

SF = "/root/testdata/sf0.001"


def good(rows, model):
    """Scores by the fitted model, computed one text at a time."""
    tools = model.compressors()

    def score(text):
        data = (text or "").encode()
        sizes = [sum(len(t.compress(data[k : k + 1024])) for k in range(0, len(data), 1024)) for t in tools]
        x = (sizes[1] - sizes[0]) / len(data) if data else 0.0
        return 1 / (1 + math.exp(-(model.intercept + model.slope * x)))

    return [r for r in rows if score(r["text"]) >= 0.5]


def without_repeated_lines(rows):
    key = lambda line: line.encode().strip().lower().decode()
    holders = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r["doc_id"])
    stays = lambda line, i: len(holders.get(key(line), ())) < 3 or i == max(holders[key(line)])
    return [{**r, "text": "\n".join(x for x in r["text"].split("\n") if stays(x, r["doc_id"])) if r["text"] is not None else None} for r in rows]


def holds_one_of_each_group(rows, kept):
    """Whether no two kept texts are as alike as 0.9, and every text that went was like another."""
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}

    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    stay = sorted(kept)
    assert not [(a, b) for i, a in enumerate(stay) for b in stay[:i] if alike(a, b) >= 0.9]
    exact = [i for i in sets if any(j < i and sets[i] == sets[j] for j in sets)]
    assert exact and not set(exact) & kept
    return all(max(alike(i, j) for j in sets if j != i) >= 0.6 for i in sets.keys() - kept)


def without_leaks(rows, items):
    windows = set()
    for t in items:
        w = words((t or "").encode())
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    holds = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    return [r for r in rows if not holds(words((r["text"] or "").encode()))]


def mixed(rows):
    """(doc_id, size, source size, target, taken) of each row."""
    size = lambda r: len((r["text"] or "").encode().split())
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes, weight = {s: sum(size(r) for r in rows if r["source"] == s) for s in names}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: float(3 * sizes[s]) if s in capped else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        passes, left = divmod(math.floor(target[s]), sizes[s]) if sizes[s] else (0, 0)
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
            part = max(0, min(size(r), left))
            left -= part
            out.append((r["doc_id"], size(r), sizes[s], target[s], passes * size(r) + part))
    return sorted(out)


def test_run_against_plain_python(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    lines = without_repeated_lines(good(rows, quality.train(docs, labels)))
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in lines], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, SF).collect()}
    assert holds_one_of_each_group(lines, kept)
    want = without_leaks([r for r in lines if r["doc_id"] in kept], items)
    assert 0 < len(want) < len(rows)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.text, r.source, r.lang) for r in got) == sorted((r["doc_id"], r["text"], r["source"], r["lang"]) for r in want)
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == mixed(want)
    assert all(len(r.positions) == math.ceil(r.taken / r.size) for r in got if r.taken)


LINE = "a line that three documents hold"
ODD = [
    (1, f"{LINE}\nown words of the first", "s", 1), (2, f"{LINE}\nquite other words here", None, 2), (3, f"{LINE}\nthird of them all", "t", 3), (3, "another text of a repeated id", "t", 4), (4, None, "s", 5), (5, "", "s", 6),
    (None, "a text without an id", "s", 7), (None, None, None, 8), (6, "long " * 50_000, "s", 9), (7, "long " * 50_000, "s", 10), (8, "one two three four five six seven eight nine ten eleven", "t", 11), (8, "one two three four five six seven eight nine ten eleven", "t", 11),
]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, columns named as the operators name theirs, empty tables."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string, n_lines int")
    names = ("n_dropped", "items", "matches", "n_words", "n_hit", "fp", "component", "score", "size", "id", "md5", "stays")
    docs = docs.select("*", *(F.lit("mine").alias(n) for n in names), F.lit(0).cast("short").alias("n_chars"))
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").limit(0).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    want = [  # (id, text) after each stage; without labels all documents stay
        [(i, t) for i, t, *_ in ODD],
        [(i, t if not t or i == 3 else t.replace(f"{LINE}\n", "")) for i, t, *_ in ODD],
    ]
    gone = {(5, ""), (7, "long " * 50_000)}
    once = list(dict.fromkeys(x for x in want[1] if x not in gone))
    want += [once, [x for x in once if x[0] != 8]]
    for (_, stage), expected in zip(corpus_pipeline.STAGES, [*want, want[-1]], strict=True):
        out = stage(spark, docs, sf)
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(expected, key=str)
        if stage is not corpus_pipeline.mix_sources:
            assert out.schema.names == docs.schema.names and {r.items for r in out.collect()} == {"mine"}
            assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            assert sorted(r.n_lines for r in out.collect())[0] == 1
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = out.select(*docs.columns)


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = {r.doc_id: r.predicted for r in quality.op10_quality(spark, sf).where("held_out").collect()}
    seen = [i for i in got if i in labels]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got)
    assert sum(got[i] == labels[i] for i in seen) / len(seen) > 0.85
