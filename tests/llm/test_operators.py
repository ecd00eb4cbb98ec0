"""The operators against brute force on small tables with nulls, ties, empty and long texts and odd columns."""

import hashlib
import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F

from readloom.llm import chat, decontaminate, embeddings, katz, license, linedup, mixture, quality, simhash, warc
from readloom.llm.common import new_path, words

LONG = "a line that is long enough to count"
TEXTS = [
    (1, f"{LONG}\nown one\n{LONG} "), (2, f"  {LONG.upper()}\nown two"), (3, f"{LONG}\nown three"), (4, ""), (5, None), (6, "x"), (7, "één twee drie " * 3000),
    (8, "één twee drie " * 3000), (9, "\t\n \r"), (10, "one two three four five six seven eight nine ten eleven twelve"), (None, f"{LONG}"), (11, "a\x0bb\x0cc \x1cd"), (6, "x"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("s").alias("source"), F.lit(0).alias("n_chars"), F.lit("clash").alias("label"), F.lit(1).alias("component"))


def test_warc(spark):
    pages = [(1, "u1", "p" * 200), (2, None, "p" * 200), (3, "u\r\n3", "short"), (4, "u4", "short"), (5, "u5", None), (2, "u2", "p" * 200), (6, "u6", "é\r\n\r\nWARC/1.1" * 30), (None, "n", "p" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_archives(df, new_path(spark, "t"), frame_bytes=300)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(index).collect()), key=str)
    want = []
    for i, _, html in pages:
        p = (html or "").encode()
        again = i == 2
        want.append((i or 0, "revisit" if again else "response", 1 if again else None, len(p), hashlib.sha256(p).hexdigest()))
    assert got == sorted(want, key=str)
    for r in index.collect():
        assert warc.read_record(r.archive, r.frame, r.offset)[0] == r.page_id
    assert warc.read_archives(warc.write_archives(df.limit(0), new_path(spark, "t"))).count() == 0


def test_line_dedup(spark):
    got = {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linedup.dedup_lines(docs(spark)).collect()}
    assert {(1, "own one", 3, 2), (2, "own two", 2, 1), (3, f"{LONG}\nown three", 2, 0), (5, None, 1, 0), (4, "", 1, 0), (None, LONG, 1, 0)} <= got
    assert linedup.dedup_lines(docs(spark)).count() == len(TEXTS)
    # a filter far too small makes suspects and changes nothing
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linedup.dedup_lines(docs(spark), bits=16).collect()} == got
    assert linedup.dedup_lines(docs(spark).limit(0)).count() == 0


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_fingerprints(spark):
    got = sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs(spark)).collect()), key=str)
    assert sorted((i, f) for i, f, _ in got if i) == sorted((i, fingerprint(t)) for i, t in TEXTS if i)
    assert {i: c for i, _, c in got}[8] == 7 and {i: c for i, _, c in got}[9] == 4
    kept = simhash.dedup_documents(docs(spark))
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted({c for i, _, c in got if i})


def test_simhash_keeps_other_texts_of_a_repeated_id(spark):
    other = "totally different words that no other text holds anywhere"
    rows = [(1, "a b c d e f"), (6, "a b c d e f"), (6, other), (6, other), (7, other), (None, other), (8, None), (9, "")]
    kept = simhash.dedup_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f"), (6, other), (None, other), (8, None)], key=str)
    assert simhash.dedup_documents(docs(spark).limit(0)).count() == 0 and simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_nearest_tree():
    rng = np.random.RandomState(8)
    for tile, sure in ((4, 1), (512, 1), (4, -1), (512, 0)):
        base = rng.randint(0, 2**62, (6, 4)).astype(np.uint64)
        prints = base[rng.randint(0, 6, 90)]
        prints[np.arange(90), rng.randint(0, 4, 90)] ^= np.uint64(1) << rng.randint(0, 64, 90).astype(np.uint64)
        root = list(range(90))
        for _ in range(90):
            for i in range(90):
                for j in range(90):
                    if sum(bin(int(x)).count("1") for x in prints[i] ^ prints[j]) <= 1:
                        root[i] = root[j] = min(root[i], root[j])
        a, b, bits = simhash.nearest_tree(prints, sure, 1, tile)
        assert all(sum(bin(int(x)).count("1") for x in prints[i] ^ prints[j]) == d <= 1 for i, j, d in zip(a, b, bits, strict=True))
        got = list(range(90))
        for _ in range(90):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                got[i] = got[j] = min(got[i], got[j])
        assert got == root and len(a) == 90 - len(set(root))


def test_similar_texts(spark):
    rng = np.random.RandomState(9)
    rows, pairs = [], []
    for k in range(60):
        words_ = [f"w{int(x)}" for x in rng.randint(0, 5000, 300)]
        near = list(words_)
        for at in rng.randint(0, 300, 1 + k % 5):
            near[at] = "changed"
        far = list(words_)
        for at in rng.randint(0, 300, 60):
            far[at] = "other"
        rows += [(3 * k, " ".join(words_)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    sets = {i: {tuple(t.split()[x : x + 5]) for x in range(296)} for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "a b"), (1003, "a b"), (1004, "b a"), (3, rows[3][1]), (3, "another text of this id that is long enough to have shingles")]
    got = [r.doc_id for r in simhash.dedup_similar(docs(spark, rows)).collect()]
    near = [3 * k + 1 for k in range(60) if alike(3 * k, 3 * k + 1) >= 0.8]
    assert len(near) > 40 and len(set(near) & set(got)) <= 0.05 * len(near)
    assert {3 * k for k in range(60)} | {3 * k + 2 for k in range(60)} <= set(got)
    assert got.count(3) == 2 and got.count(None) == 1 and {1000, 1002, 1004} <= set(got) and not {1001, 1003} & set(got)
    assert simhash.dedup_similar(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("crowd,distance", [(1, 2), (3, 2), (32, 2), (1, 1), (32, 1), (1, 0)])
def test_simhash_links(spark, crowd, distance):
    rng = np.random.RandomState(crowd)
    fps = set()
    for base in rng.randint(0, 2**62, 12):
        x = int(base)
        for _ in range(25):  # chains of one to three flips
            for b in rng.randint(0, 64, rng.randint(1, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    rows = [(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(sorted(fps))]
    found = dict(simhash.components(simhash.near_links(spark.createDataFrame(rows, "rep long, fp long"), crowd=crowd, distance=distance)).collect())
    root = list(range(len(rows)))
    for _ in rows:
        before = list(root)
        for i, a in enumerate(sorted(fps)):
            for j, b in enumerate(sorted(fps)):
                if bin(a ^ b).count("1") <= distance:
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    assert [found.get(i, i) for i in range(len(rows))] == root


def test_embeddings(spark):
    rng = np.random.RandomState(0)
    base = rng.standard_normal((6, 8))
    rows = [(i, [float(v) for v in base[i % 6] + 0.08 * rng.standard_normal(8)], i % 2) for i in range(60)]
    rows += [(60, rows[0][1], 0), (61, rows[0][1], 0), (62, None, 0), (63, [0.0] * 8, 0), (64, [float("nan")] * 8, 0), (65, [None] * 8, 0), (66, rows[0][1], None), (67, [1.0], 0), (68, [2.0], 0), (69, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit(0))
    fine = {i: np.array(v) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: k for i, _, k in rows}
    near = {i: {j for j in fine if j != i and label[i] == label[j] and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / math.sqrt((fine[i] @ fine[i]) * (fine[j] @ fine[j])) >= 0.98} for i in fine}
    for tile in (3, 2048):
        got = {r.id: r for r in embeddings.near_vectors(df, tile=tile).collect()}
        for i, _, _ in rows:
            seen, todo = {i}, [i]
            while todo:
                for j in near.get(todo.pop(), ()):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near.get(i, ())), min(seen), i == min(seen))


def test_error_bound_is_rigorous():
    rng = np.random.RandomState(1)
    a, b = (embeddings.unit(rng.standard_normal((200, 24)) * rng.lognormal(0, 2, 24)) for _ in range(2))
    for threshold in (0.3, 0.6, 0.9):
        want = set(zip(*np.nonzero(a @ b.T >= threshold), strict=True))
        assert want <= set(zip(*embeddings.candidates(a, b, threshold), strict=True))


def test_license(spark):
    texts = [(1, "Released under the MIT License. MIT-license"), (2, "Relesed under the MIT Licence."), (3, "licensed under the apach license, version 2.0!"), (4, None), (5, "général public license"), (6, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in license.scan_licenses(docs(spark, texts)).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (7, 2, 3, 5, ["mit"], 1.0)
    assert got[2].n_base == 0 and got[2].labels == ["mit"] and 0 < got[2].score < 1 and (got[2].matches[0].first_word, got[2].matches[0].last_word) == (0, 4)
    assert got[3].labels == ["apache"] and got[4].n_words == 0 and got[4].score == 0 and got[5].n_base == 0 and got[6].labels == ["cc-by-nc"]


def test_fuzzy_finds_every_bounded_edit():
    notice = license.Notice("mit", "released under the mit license", 3)  # no word of it must stand exactly
    scanner, rng = license.Scanner({}, [notice]), np.random.RandomState(2)
    for _ in range(200):
        text = list(notice.text)
        for _ in range(notice.edits):
            at = rng.randint(len(text))
            text[at : at + 1] = [["q"], [], [text[at], "q"]][rng.randint(3)]
        assert scanner.scan(("foo bar " * 5 + "".join(text) + " baz").encode())[4:6][1], "".join(text)


@pytest.mark.parametrize("text,labels", [("small rights reserved", []), ("firewall rights reserved", []), ("mall rights reserved", []), ("all rights reservd", ["all-rights-reserved"]), ("licensed under cc by nd 4 0", ["cc-by-nd"]),
                                         ("Licenced under CC BY-NC 4.0", ["cc-by-nc"]), ("licensed under cc by nc sa 3.0", ["cc-by-nc-sa"]), ("licensed under cc by 4.0", ["cc-by"]), ("released under the mitt license", [])])
def test_license_words_that_tell_notices_apart(text, labels):
    got = license.Scanner({}, license.NOTICES).scan(text.encode())
    assert sorted({x["label"] for x in got[5]}) == labels


def test_license_seeds_lose_nothing():
    """Windows around the seeds find what the same patterns find in whole texts."""
    scanner, rng = license.Scanner({}, license.NOTICES), np.random.RandomState(6)
    for _ in range(60):
        text = []
        for _ in range(6):
            notice = list(license.NOTICES[rng.randint(len(license.NOTICES))].text)
            for _ in range(rng.randint(0, 6)):
                at = rng.randint(len(notice))
                notice[at : at + 1] = [["é"], [], [notice[at], "q"]][rng.randint(3)]
            text += ["".join(notice), *rng.choice(["license", "under", "the", "cc", "rights", "été"], rng.randint(0, 5))]
        data = b" " + b" ".join(words(" ".join(text).encode())) + b" "
        plain, want = data.decode(), []
        for notice, pattern in scanner.notices:
            for m in pattern.finditer(plain):
                if set(notice.exact) <= set(m[0].split(" ")):
                    first = plain[: m.start() + len(m[0]) - len(m[0].lstrip(" ")) + 1].count(" ") - 1
                    want.append((notice.label, first, first + len(m[0].split()) - 1, sum(m.fuzzy_counts), 1 - sum(m.fuzzy_counts) / len(notice.text)))
        assert scanner.fuzzy(data, license.word_counter(data)) == license.best_of(want)


def test_license_base_columns_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    sql = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM read_parquet('{}/documents.parquet')),
    p AS (SELECT * FROM (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) t(s, label)),
    hit AS (SELECT doc_id, label, i - 1 AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), p WHERE w[i : i + len(s) - 1] = s)
    SELECT d.doc_id, len(w), count(k), min(k), max(k), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id, len(w)
    """
    got = license.op3_license_scan(spark, sf).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got), key=str) == sorted(duckdb.sql(sql.format(sf)).fetchall(), key=str)


def test_mixture(spark):
    rows = [(i, "w " * (1 + i % 7), "abcd"[min(3, i % 10)] if i % 11 else None) for i in range(300)] + [(None, "w w", "a"), (5, "w", "a"), (900, "", "z"), (901, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixture.mix(df).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == math.floor(mine[0].target) and mine[0].target <= 3 * mine[0].source_size
    assert all(r.taken <= 3 * r.size for r in got) and all(0 <= p <= 1 + 1e-9 for r in got for p in r.positions)
    firsts = [r.positions[0] for r in got if r.positions]
    assert firsts == sorted(firsts)
    assert mixture.targets([10, 1000, 5], [5, 2, 1]) == [30.0, 970.0, 15.0]
    assert mixture.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [1, 3])
def test_mixture_of_very_many_sources(spark, monkeypatch, cap):
    rows = [(i, "w " * (1 + i % 9 * (i % 13 == 0) * 40), f"s{i * 7919 % 101}" if i % 50 else None) for i in range(700)] + [(900, "", "empty"), (None, "w", "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(mixture.mix(df, cap=cap).collect(), key=str)
    monkeypatch.setattr(mixture, "MAX_SOURCES", 3)
    got = sorted(mixture.mix(df, cap=cap).collect(), key=str)
    assert len({r.target / max(1, r.source_size) for r in got}) > 1 or cap == 1
    for g, w in zip(got, want, strict=True):
        assert (g.doc_id, g.source, g.size, g.source_size, g.taken) == (w.doc_id, w.source, w.size, w.source_size, w.taken)
        assert g.target == pytest.approx(w.target) and g.positions == pytest.approx(w.positions)
    assert mixture.mix(df.limit(0)).count() == 0


def test_chat(spark):
    odd = ["</turn>", "###", "\\", "\\l", "### a\nb</turn>\n", "", None, "é" * 50, "x" * 100_000]
    rows = [(c, t, r, odd[(c + t) % len(odd)]) for c in range(12) for t, r in enumerate(["user", "assistant", "sys#\nt<em", None, "assistant"])] + [(3, 0, "user", "again"), (3, 0, "user", "again"), (None, None, "assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t if t is not None else -1, (r or "").encode(), (x or "").encode()) for c, t, r, x in rows if c == conv))
        loss = b"".join(x for _, r, x in mine if r == b"assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, r, x in mine)).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss.decode()), hashlib.sha256(loss).hexdigest())


def test_decontaminate(spark):
    items = [(100, "two three four five six seven eight nine ten eleven"), (101, "X"), (102, None), (103, "!!"), (None, "twelve"), (100, "two three four five six seven eight nine ten eleven"), (104, "drie één twee drie één twee drie één twee drie één twee")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = words((t or "").encode())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for i, t in TEXTS:
        w, hit, found = words((t or "").encode()), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), sorted(found - {None})))
    for options in ({}, {"block_bytes": 20}, {"shard_words": 1}):
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_leaks(docs(spark), bench, **options).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    clash = docs(spark).select("doc_id", "text", F.lit("mine").alias("items"), F.lit("m").alias("matches"), F.lit(-1).alias("n_words"), F.lit(-2).alias("n_hit"))
    clean = decontaminate.decontaminate(clash, bench).collect()
    assert {tuple(r)[2:] for r in clean} == {("mine", "m", -1, -2)} and sorted(str(r.doc_id) for r in clean) == sorted(str(w[0]) for w in want if not w[2])
    longest = decontaminate.find_leaks(docs(spark), bench).where("doc_id = 10").first().matches
    assert [(m.item_id, m.doc_word, m.item_word, m.length) for m in longest if m.item_id == 100] == [(100, 1, 0, 10)] * 2 or [(m.item_id, m.length) for m in longest if m.item_id] == [(100, 10)]
    assert decontaminate.find_leaks(docs(spark), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def katz_scores(texts, train):
    """log10 P of each text by a trigram model over all words of ``train``, in plain Python: the recursion as it is defined."""
    split = lambda t: ["begin", "begin", *(t or "").encode().lower().split(), "end"]
    words, pairs, threes = Counter(), Counter(), Counter()
    for t in train:
        s = split(t)
        words.update(s[2:])
        pairs.update(zip(s[1:], s[2:], strict=False))
        threes.update(zip(s, s[1:], s[2:], strict=False))
    n, v = words.total(), len(words)
    lower = lambda w: (words[w] + 0.1) / (n + 0.1 * (v + 1))

    def level(grams, shorter):
        """P(w | context) over the n-grams, backing off to ``shorter``."""
        ones = Counter(grams.values())
        d, times = katz.discounts([ones[r] for r in range(7)]), Counter()
        for (*h, _), c in grams.items():
            times[tuple(h)] += c
        high, low, factor = Counter(), Counter(), {}
        for (*h, w), c in grams.items():
            h = tuple(h)
            high[h] += d[min(c, 6)] * c / times[h]
            low[h] += shorter(h[1:], w)
        for h in high:
            factor[h] = times[h] / (times[h] + 1) if 1 - high[h] < 1e-9 else 1.0

        def p(h, w):
            if c := grams[(*h, w)]:
                return factor[h] * d[min(c, 6)] * c / times[h]
            return shorter(h[1:], w) * ((1 - factor[h] * high[h]) / (1 - low[h]) if h in factor else 1.0)

        for h in [*high, ("unknown",) * len(h)]:
            assert abs(sum(p(h, w) for w in words) + p(h, "unknown") - 1) < 1e-9
        return p

    p3 = level(threes, level(pairs, lambda _, w: lower(w)))
    return [sum(math.log10(p3((g, h), w)) for g, h, w in zip(s, s[1:], s[2:], strict=False)) for s in map(split, texts)]


@pytest.mark.parametrize("options", [{"hot": 0}, {"hot": 12, "shared": 1, "bucket_tokens": 400}, {}])
def test_katz_scores_over_all_words(spark, options):
    rng = np.random.RandomState(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) if x < 300)) for i in range(100)]
    rows += [(500, None), (501, ""), (502, "rare pair " + "x" * 90), (503, "Rare pair " + "x" * 90), (504, "pair rare"), (502, "rare pair"), (505, "new unknown w1"), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("learn", F.lit("clash")).withColumn("id", F.lit(0))
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    split = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for t in train for w in split(t))
    n, v = counts.total(), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t))
    want = sorted(((i or 0, len(split(t)), sum(counts[w] > 0 for w in split(t)), n, base(t), s) for (i, t), s in zip(rows, katz_scores([t for _, t in rows], train), strict=True)))
    got = sorted((r.id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score_documents(df, katz.in_training("doc_id"), chunk_tokens=500, **options).collect())
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=0, atol=1e-9)


def test_katz_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_documents(df, katz.in_training("doc_id")).count() == 0
    untrained = katz.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (untrained.n_tokens, untrained.n_known, untrained.train_tokens) == (3, 0, 0)


def test_discounts():
    d = katz.discounts([0, 100, 40, 20, 12, 8, 5])
    assert (d[1:6] > 0).all() and (d[1:6] < 1).all() and d[6] == 1


def test_quality(spark):
    rng = np.random.RandomState(4)
    good = [" ".join(rng.choice(["river", "house", "garden", "walks", "under", "light"], 60)) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "click", "win###", "xx%%"], 60)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(df, quality.train(df, labels)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 120) for i in held]) > 0.95 and got[1000] == got[1001] and 0 <= got[1000] <= 1
    assert {r.score for r in quality.score(df, quality.train(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels)).count() == 0
    # the curve by hand, on whole texts; a long text gives pieces of its end too
    model = quality.train(df, labels)
    tools = model.compressors()
    assert got[7] == pytest.approx(1 / (1 + math.exp(-(model.intercept + model.slope * model.difference(good[7].encode(), tools)))))
    assert quality.spread(b"a" * 5000 + b"z" * 256, 1024).endswith(b"z" * 200) and quality.spread(b"ab", 64) == b"ab"


def test_quality_learns_from_ends_of_texts(spark):
    """Texts that differ only far behind their begin."""
    rows = [(i, "same words again " * 400 + ("river house garden " if i % 2 else "click win xx ") * 400) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_similar_texts_meet_in_the_grid(spark):
    """The grid alone links near copies, where no sample of shingles is shared."""
    words = [f"w{i}" for i in range(400)]
    texts = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: " ".join(words[::-1])}
    rows = spark.createDataFrame([(i, str(i), t) for i, t in texts.items()], "id long, md5 string, text string")
    nodes = simhash.sketches(rows, width=5, parts=14, least=5).withColumn("node", F.col("id"))
    apart = nodes.withColumn("parts", F.array(F.col("id")))
    assert simhash.similar_links(apart, *simhash.bit_limits(0.8)).count() == 0
    same = apart.withColumn("f0", F.when(F.col("id") == 2, F.lit(nodes.where("id = 1").first().f0).bitwiseXOR(F.lit(3))).otherwise(F.col("f0")))
    assert [tuple(r) for r in simhash.grid_links(same, *simhash.bit_limits(0.8)).collect()] == [(2, 1, True)]
