"""License scan: exact phrases and fuzzy short notices.

A notice of which a text holds a copy with at most k edits has one of its k + 1 pieces
unchanged (pigeonhole), so an exact search for the pieces finds every candidate. The
regex library's bounded-error matching then runs over the surroundings of the seeds
alone, verifies the edits and gives the span.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, out_schema, rows_of, table, text_bytes, words

#: Phrases of the exact search and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # lower-case words, single spaces
    edits: int  # characters inserted, deleted or substituted
    exact: tuple[str, ...] = ()  # words that tell this notice from others: they must stand without an edit


#: Well-known short notices, as lower-case words. About one edit for ten characters is allowed.
NOTICES = (
    Notice("mit", "released under the mit license", 3, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 8),
    Notice("apache", "licensed under the apache license version 2 0", 4, ("2",)),
    Notice("gpl", "licensed under the gnu general public license version 2", 5, ("gnu",)),
    Notice("gpl", "licensed under the gnu general public license version 3", 5, ("gnu",)),
    Notice("lgpl", "gnu lesser general public license", 3, ("gnu", "lesser")),
    Notice("agpl", "gnu affero general public license", 3, ("gnu", "affero")),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    Notice("mpl", "subject to the terms of the mozilla public license", 4, ("mozilla",)),
    Notice("all-rights-reserved", "all rights reserved", 1, ("all",)),
    *(
        Notice("cc-" + kind.replace(" ", "-"), f"licensed under cc {kind} {version}", 2, ("cc", *kind.split()))
        for kind in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
        for version in ("3 0", "4 0")
    ),
)

SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches array<struct<label:string,first_word:long,last_word:long,edits:int>>, score double"


def pieces(notice: Notice) -> list[tuple[int, bytes]]:
    """``edits + 1`` adjoining pieces of the notice, with their offsets."""
    data, n = notice.text.encode(), notice.edits + 1
    cuts = [len(data) * i // n for i in range(n + 1)]
    return [(a, data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def places(data: bytes, needle: bytes) -> Iterator[int]:
    at = data.find(needle)
    while at >= 0:
        yield at
        at = data.find(needle, at + 1)


def word_counter(data: bytes) -> Callable[[int], int]:
    """How many spaces stand before a place. They are looked up once a text that has matches, so many matches in a long text cost no pass each."""
    spaces = None

    def count(end: int) -> int:
        nonlocal spaces
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        return int(np.searchsorted(spaces, end))

    return count


def best_of(found: list[tuple]) -> list[tuple]:
    """Of matches that share words the one with the highest likeness, in order of place."""
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[4], x[1], x[2], x[0])):
        at = bisect.bisect_left(kept, x[1], key=lambda k: k[1])
        if (at == 0 or kept[at - 1][2] < x[1]) and (at == len(kept) or x[2] < kept[at][1]):
            kept.insert(at, x)
    return kept


class Scanner:
    """Scans whole texts for exact phrases and fuzzy notices. The pieces of all notices are sought in one pass."""

    def __init__(self, phrases: dict[str, str], notices: Sequence[Notice]):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        # whole words, after and before the spaces between them
        self.notices = [(n, regex.compile(f"(?e)(?<= )(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?= )")) for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece.decode("latin-1"), []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        if seeds:
            self.seeds.make_automaton()

    def windows(self, data: bytes) -> dict[int, list[tuple[int, int]]]:
        """Where a copy of each notice that holds one of its pieces can lie, overlaps joined."""
        found: dict[int, list[tuple[int, int]]] = {}
        if not len(self.seeds):
            return found
        for end, (size, uses) in self.seeds.iter(data.decode("latin-1")):  # a character is a byte
            for k, offset in uses:
                notice = self.notices[k][0]
                start = end + 1 - size - offset
                window = max(0, start - notice.edits - 1), min(len(data), start + len(notice.text) + notice.edits + 1)
                mine = found.setdefault(k, [])
                # places come in order of their ends, so windows of one notice come almost in order
                while mine and window[0] <= mine[-1][1] and mine[-1][0] <= window[1]:
                    a, b = mine.pop()
                    window = min(a, window[0]), max(b, window[1])
                mine.append(window)
        return found

    def fuzzy(self, data: bytes, word: Callable[[int], int]) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, edits, likeness) of every verified notice, in order of place."""
        found = []
        for k, windows in sorted(self.windows(data).items()):
            notice, pattern = self.notices[k]
            for a, b in windows:
                while a < b and data[a] & 0xC0 == 0x80:  # windows are cut between characters
                    a += 1
                while b < len(data) and data[b] & 0xC0 == 0x80:
                    b += 1
                window = data[a:b].decode("utf-8", "surrogateescape")
                start, at = a, 0  # in bytes and in characters: counted on from match to match
                for m in pattern.finditer(window):
                    edits = sum(m.fuzzy_counts)
                    start += len(window[at : m.start()].encode("utf-8", "surrogateescape"))
                    at = m.start()
                    if not set(notice.exact) <= set(m[0].split(" ")):
                        continue
                    # a match may begin or end on the space between two words
                    begin = start + len(m[0]) - len(m[0].lstrip(" "))
                    end = begin + len(m[0].strip(" ").encode("utf-8", "surrogateescape"))
                    first = word(begin + 1) - 1
                    last = word(max(end, begin + 1)) - 1
                    found.append((notice.label, first, max(first, last), edits, 1 - edits / len(notice.text)))
        return best_of(found)

    def scan(self, text: bytes) -> tuple:
        """The columns of ``SCAN``."""
        tokens = words(text)
        data = b" " + b" ".join(tokens) + b" "
        starts, labels = [], set()
        word = word_counter(data)
        for phrase, label in self.phrases:
            at = [word(p) for p in places(data, phrase)]
            if at:
                starts += at
                labels.add(label)
        near = self.fuzzy(data, word) if tokens else []
        score = max([1.0 if starts else 0.0, *(x[4] for x in near)])
        return len(tokens), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels), [{"label": x[0], "first_word": x[1], "last_word": x[2], "edits": x[3]} for x in near], score


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """A row per document: its id, ``SCAN``, and ``labels`` (array of the exact and the fuzzy labels, sorted).

    Null and empty texts have no words, no labels and score 0. ``score`` is 1 with an exact phrase, else the likeness
    (1 - edits / length) of the best notice, 0 without one. Ids may repeat or be null; other columns are ignored; an
    empty table gives no rows. No shuffle.
    """
    ddl = f"{id_col} {docs.select(id_col).schema[0].dataType.simpleString()}, {SCAN}"
    schema = out_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, out = Scanner(phrases, notices), Rows(schema)
        for batch in batches:
            for key, text in rows_of(batch, id_col, "_rl_text"):
                if out.add((key, *scanner.scan(text))):
                    yield out.batch()
        yield from out.rest()

    found = docs.select(id_col, text_bytes(text_col).alias("_rl_text")).mapInArrow(run, ddl)
    return found.withColumn("labels", F.array_sort(F.array_distinct(F.concat("base_labels", F.col("matches.label")))))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
