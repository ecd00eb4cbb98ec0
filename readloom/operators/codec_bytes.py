"""Column codes as bytes, both ways: a chunk's columns are encoded in every code that can hold them, and the smallest stays.

All columns of a chunk are encoded in one pass over reads that are shuffled and sorted once. A chunk is bounded by the policy
that packed it, and a task holds one chunk, compressed, and one of its columns at a time.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from readloom.functions import cigar
from readloom.operators.codecs import CODES, KEYS, ORDER
from readloom.schema import READS, ReadsError

#: Letters of operations and bases in the order of their codes, and the numbers of the codes in an envelope.
OPS, BASES = "MIDNSHP=X", b"ACGT"
CODE_IDS = {"raw": 0, "pos_delta": 1, "flag_bitpack": 2, "mapq_rle": 3, "seq_2bit": 4, "cigar_token": 5, "qual_rle": 6, "qual_pack": 7, "qname_dict": 9, "tags_per_stream": 10, "cigar_dict": 11}
ZSTD = 1
WIDTHS = {"flag": "<u2", "mapq": "u1", "pos": "<i4", "mate_pos": "<i4", "template_length": "<i4"}


def varints(values: Sequence[int] | np.ndarray) -> bytes:
    """Unsigned LEB128 numbers one after another."""
    left = np.asarray(values, np.uint64)
    sizes = np.ones(len(left), np.int64)
    for k in range(1, 10):
        sizes += left >> np.uint64(7 * k) > 0
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        at = sizes > k
        more = (sizes[at] > k + 1).astype(np.uint64) << np.uint64(7)
        out[starts[at] + k] = (left[at] >> np.uint64(7 * k) & np.uint64(127) | more).astype(np.uint8)
    return out.tobytes()


_SHORT = [bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7]) for n in range(1 << 14)]


def varint(n: int) -> bytes:
    """One unsigned LEB128 number."""
    return _SHORT[n] if n < 1 << 14 else varints([n])


def zigzag(values: Sequence[int] | np.ndarray) -> np.ndarray:
    x = np.asarray(values, np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64)
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


class Cursor:
    """Reads a body from its begin; what is left at the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ReadsError("truncated column")
        self.at += n
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        if self.at + n > len(self.data):
            raise ReadsError("truncated column")
        self.at += n

    def number(self) -> int:
        if self.at < len(self.data) and (byte := self.data[self.at]) < 128:
            self.at += 1
            return byte
        value = shift = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7
            if shift > 63:
                raise ReadsError("number is too long")

    def numbers(self, n: int) -> np.ndarray:
        rest = np.frombuffer(self.data, np.uint8, offset=self.at)
        ends = np.flatnonzero(rest < 128)[:n]
        if len(ends) < n:
            raise ReadsError("truncated column")
        size = int(ends[-1]) + 1 if n else 0
        starts = np.append(0, ends[:-1] + 1).astype(np.int64) if n else ends
        place = np.arange(size) - np.repeat(starts, ends - starts + 1)
        parts = (rest[:size] & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
        self.at += size
        return np.bitwise_or.reduceat(parts, starts) if n else np.zeros(0, np.uint64)

    def end(self) -> None:
        if self.at != len(self.data):
            raise ReadsError("unexpected bytes after a column")


def packed_bits(codes: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits, low bits first."""
    return np.packbits((codes[:, None] >> np.arange(width)) & 1, bitorder="little").tobytes()


def unpacked_bits(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.int64) << np.arange(width)).sum(axis=1)


#: Rows that are packed or unpacked at once, and bytes that are searched for the ends of rows of runs.
ROWS, WINDOW = 1 << 14, 1 << 20


def by_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, its rows) for each size above 0."""
    order = np.argsort(sizes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(rows) and sizes[rows[0]]:
            yield int(sizes[rows[0]]), rows


def packed_rows(codes: np.ndarray, sizes: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """For each row its size, then its next ``size`` of ``codes`` in ``width`` bits, low bits first, from a whole byte on; and the
    bytes that each row's codes take."""
    places = np.cumsum(sizes) - sizes
    taken = (sizes * width + 7) // 8
    heads = np.ones(len(sizes), np.int64)
    for k in range(1, 10):
        heads += sizes >> 7 * k > 0
    starts = np.cumsum(heads + taken) - taken
    out = np.zeros(int((heads + taken).sum()), np.uint8)
    for k in range(int(heads.max(initial=0))):
        at = heads > k
        more = (heads[at] > k + 1).astype(np.int64) << 7
        out[(starts - heads)[at] + k] = sizes[at] >> 7 * k & 127 | more
    for size, rows in by_size(sizes):
        mine = codes[places[rows][:, None] + np.arange(size)]
        bits = np.packbits((mine[:, :, None] >> np.arange(width, dtype=np.uint8) & 1).reshape(len(rows), -1), axis=1, bitorder="little")
        out[starts[rows][:, None] + np.arange(bits.shape[1])] = bits
    return out.tobytes(), taken


def unpacked_rows(c: Cursor, n: int, width: int, letters: np.ndarray) -> list[bytes]:
    """The rows that ``packed_rows`` packed, as ``letters``."""
    data, out = np.frombuffer(c.data, np.uint8), []
    for first in range(0, n, ROWS):
        starts, counts = [], []
        for _ in range(min(ROWS, n - first)):
            counts.append(size := c.number())
            starts.append(c.at)
            c.skip(-(-size * width // 8))
        begin, sizes = np.array(starts, np.int64), np.array(counts, np.int64)
        ends = np.cumsum(sizes)
        codes = np.zeros(int(ends[-1]), np.uint8)
        for size, rows in by_size(sizes):
            bits = np.unpackbits(data[begin[rows][:, None] + np.arange(-(-size * width // 8))], axis=1, count=size * width, bitorder="little")
            codes[(ends - sizes)[rows][:, None] + np.arange(size)] = (bits.reshape(len(rows), size, width) << np.arange(width, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        out += cut(letters[codes].tobytes(), ends)
    return out


def cut(data: bytes, ends: np.ndarray) -> list[bytes]:
    stops = ends.tolist()
    return [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, sizes) of so many texts at once."""
    for first in range(0, len(texts), ROWS):
        part = texts[first : first + ROWS]
        yield np.frombuffer(b"".join(part), np.uint8), np.fromiter(map(len, part), np.int64, len(part))


def raw_strings(texts: list[bytes]) -> bytes:
    out = io.BytesIO()
    for first in range(0, len(texts), ROWS):
        out.write(b"".join([len(t).to_bytes(4, "little") + t for t in texts[first : first + ROWS]]))
    return out.getvalue()


def from_raw_strings(c: Cursor, n: int) -> list[bytes]:
    data, at, last, out = c.data, c.at, len(c.data), []
    for _ in range(n):
        start = at + 4
        at = start + int.from_bytes(data[at:start], "little")
        if at > last or start > last:
            raise ReadsError("truncated column")
        out.append(data[start:at])
    c.at = at
    return out


def raw_numbers(name: str) -> tuple[Callable, Callable]:
    kind = np.dtype(WIDTHS[name])
    return lambda x: np.asarray(x).astype(kind).tobytes(), lambda c, n: np.frombuffer(c.take(n * kind.itemsize), kind).tolist()


def steps(positions: list[int]) -> bytes | None:
    x = np.asarray(positions, np.int64)
    d = np.diff(x, prepend=0)
    return None if (d < 0).any() else varints(d)


def flags(x: list[int]) -> bytes:
    width = max(x).bit_length()
    return bytes([width]) + packed_bits(np.asarray(x, np.int64), width)


def from_flags(c: Cursor, n: int) -> list[int]:
    width = c.take(1)[0]
    return unpacked_bits(c.take(-(-n * width // 8)), n, width).tolist() if width else [0] * n


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return np.diff(np.append(first, len(x))), x[first]


def runs(x: np.ndarray) -> bytes:
    """(length, value byte) of each run."""
    lengths, values = runs_of(x)
    if lengths.max(initial=0) < 128:
        return np.stack([lengths.astype(np.uint8), values.astype(np.uint8)], axis=1).tobytes()
    return b"".join([varint(n) + _SHORT[v] if v < 128 else varint(n) + bytes([v]) for n, v in zip(lengths.tolist(), values.tolist(), strict=True)])


def from_runs(c: Cursor, n: int) -> bytes:
    out, size = [], 0
    while size < n:
        length = c.number()
        out.append(c.take(1) * length)
        size += length
    if size != n:
        raise ReadsError("runs don't fit their column")
    return b"".join(out)


_BASE_CODES = np.full(256, 255, np.uint8)
_BASE_CODES[list(BASES)] = np.arange(4)


def base_rows(texts: list[bytes]) -> tuple[bytes, np.ndarray] | None:
    """The body of ``bases``, and the bytes that each text's bases take in it."""
    out, taken = [], []
    for text, sizes in blocks(texts):
        codes = _BASE_CODES[text]
        if not sizes.all() or (codes == 255).any():
            return None
        body, size = packed_rows(codes, sizes, 2)
        out.append(body)
        taken.append(size)
    return b"".join(out), np.concatenate(taken) if taken else np.zeros(0, np.int64)


def bases(texts: list[bytes]) -> bytes | None:
    found = base_rows(texts)
    return found and found[0]


def from_bases(c: Cursor, n: int) -> list[bytes]:
    return unpacked_rows(c, n, 2, np.frombuffer(BASES, np.uint8))


def operations(texts: list[bytes]) -> bytes | None:
    made: dict[bytes, bytes] = {}
    for t in texts:
        if t not in made:
            if not re.fullmatch(b"(?:[1-9][0-9]*[MIDNSHP=X])+", t):
                return None
            parts = re.findall(cigar.PART, t.decode())
            made[t] = varint(len(parts)) + b"".join(varint(int(n)) + bytes([OPS.index(op)]) for n, op in parts)
    return b"".join([made[t] for t in texts])


def from_operations(c: Cursor, n: int) -> list[bytes]:
    return ["".join(f"{c.number()}{OPS[c.take(1)[0]]}" for _ in range(c.number())).encode() for _ in range(n)]


def quality_runs(texts: list[bytes]) -> bytes | None:
    if any(t in (b"", b"*") for t in texts):
        return None
    out = []
    for text, sizes in blocks(texts):
        ends = np.cumsum(sizes)
        new = np.append(True, text[1:] != text[:-1])
        new[(ends - sizes)] = True
        at = np.flatnonzero(new)
        lengths = np.diff(np.append(at, len(text)))
        if lengths.max() < 128:
            pairs = cut(np.stack([lengths.astype(np.uint8), text[at]], axis=1).tobytes(), 2 * np.searchsorted(at, ends))
        else:
            pairs = [runs(np.frombuffer(t, np.uint8)) for t in cut(text.tobytes(), ends)]
        out += [x for n, p in zip(sizes.tolist(), pairs, strict=True) for x in (varint(n), p)]
    return b"".join(out)


def short_runs(c: Cursor, n: int) -> list[bytes]:
    """Of ``n`` rows of runs as many as have only runs below 128 and end within a window of bytes; the cursor moves past them."""
    data = np.frombuffer(c.data, np.uint8)[c.at : c.at + WINDOW]
    sums = [np.append(0, np.cumsum(data[k::2], dtype=np.int64)) for k in (0, 1)]
    base, starts, stops = c.at, [], []
    while len(starts) < n and c.at < base + len(data) - 10:
        held, size = c.at, c.number()
        at = c.at - base
        mine, k = sums[at & 1], at >> 1
        end = int(np.searchsorted(mine, mine[k] + size)) if at < len(data) else len(mine)
        if end >= len(mine) or mine[end] != mine[k] + size or (at & 1) + 2 * end > len(data):
            c.at = held
            break
        starts.append(at)
        stops.append((at & 1) + 2 * end)
        c.at = base + stops[-1]
    if not starts:
        return []
    begin, end = np.array(starts), np.array(stops)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    pairs = data[np.cumsum(inside[:-1], dtype=np.int8) > 0].reshape(-1, 2)
    counts = np.cumsum(end - begin) // 2
    long = np.flatnonzero(pairs[:, 0] > 127)
    if len(long):  # a longer run: its row and those after it are read number by number
        whole = int(np.searchsorted(counts, long[0], side="right"))
        c.at = base + stops[whole - 1] if whole else base
        pairs, counts = pairs[: counts[whole - 1] if whole else 0], counts[:whole]
    ends = np.append(0, np.cumsum(pairs[:, 0], dtype=np.int64))[counts]
    return cut(np.repeat(pairs[:, 1], pairs[:, 0]).tobytes(), ends) if len(counts) else []


def from_quality_runs(c: Cursor, n: int) -> list[bytes]:
    out: list[bytes] = []
    while len(out) < n:
        out += short_runs(c, n - len(out)) or [from_runs(c, c.number())]
    return out


def quality_pack(texts: list[bytes]) -> bytes | None:
    if any(t in (b"", b"*") for t in texts):
        return None
    found = np.zeros(256, np.int64)
    for text, _ in blocks(texts):
        found += np.bincount(text, minlength=256)
    alphabet = np.flatnonzero(found).astype(np.uint8)
    if len(alphabet) > 128:
        return None
    width, codes = (len(alphabet) - 1).bit_length(), np.zeros(256, np.uint8)
    codes[alphabet] = np.arange(len(alphabet))
    rows = [packed_rows(codes[text], sizes, width)[0] if width else varints(sizes) for text, sizes in blocks(texts)]
    return b"".join([varint(len(alphabet)), alphabet.tobytes(), *rows])


def from_quality_pack(c: Cursor, n: int) -> list[bytes]:
    alphabet = np.frombuffer(c.take(c.number()), np.uint8)
    width = (len(alphabet) - 1).bit_length()
    return unpacked_rows(c, n, width, alphabet) if width else [alphabet.tobytes() * c.number() for _ in range(n)]


def shared_starts(entries: list[bytes]) -> list[int]:
    """Bytes that each entry shares with the one before, from its start; 0 for the first."""
    out = [0][: len(entries)]
    for first in range(1, len(entries), ROWS):
        part = entries[first - 1 : first + ROWS]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        if (most := int(sizes.max())) > 256:
            out += [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(part, part[1:], strict=False)]
            continue
        table = np.array(part, f"S{most + 1}").view(np.uint8).reshape(len(part), most + 1)
        other = table[1:] != table[:-1]
        other[:, most] = True
        out += np.minimum(other.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1])).tolist()
    return out


def names_dictionary(texts: list[bytes]) -> bytes:
    """Sorted entries, each by what it shares with the one before, then a reference for each record."""
    entries = sorted(set(texts))
    out = [varint(len(entries))]
    for i, (t, shared) in enumerate(zip(entries, shared_starts(entries), strict=True)):
        if i:
            out.append(varint(shared))
        out += varint(len(t) - shared), t[shared:]
    rank = {t: i for i, t in enumerate(entries)}
    return b"".join(out) + varints([rank[t] for t in texts])


def from_names_dictionary(c: Cursor, n: int) -> list[bytes]:
    entries: list[bytes] = []
    for i in range(c.number()):
        shared = c.number() if i else 0
        entries.append((entries[-1][:shared] if i else b"") + c.take(c.number()))
    return [entries[k] for k in c.numbers(n).tolist()]


def dictionary(texts: list[bytes]) -> bytes:
    entries = sorted(set(texts))
    rank = {t: i for i, t in enumerate(entries)}
    return varint(len(entries)) + b"".join([varint(len(t)) + t for t in entries]) + varints([rank[t] for t in texts])


def from_dictionary(c: Cursor, n: int) -> list[bytes]:
    entries = [c.take(c.number()) for _ in range(c.number())]
    return [entries[k] for k in c.numbers(n).tolist()]


def tag_streams(texts: list[bytes]) -> bytes | None:
    """A stream for each key, in the order in which keys come first; none where a key changes its type or its place."""
    known: dict[bytes, list] = {}
    for x in texts:
        if x not in known:
            known[x] = [(t[:2], t[3:4], t[5:]) for t in x.split(b"\t")] if x else []
    split = [known[x] for x in texts]
    kinds: dict[bytes, bytes] = {}
    for items in split:
        for key, kind, _ in items:
            if kinds.setdefault(key, kind) != kind:
                return None
    place = {key: i for i, key in enumerate(kinds)}
    head, bodies = [varints([len(kinds)]), *(k + v for k, v in kinds.items())], []
    present, values = np.zeros((len(kinds), len(texts)), np.uint8), [[] for _ in kinds]
    for r, items in enumerate(split):
        order = [place[key] for key, _, _ in items]
        if any(b <= a for a, b in zip(order, order[1:], strict=False)):
            return None
        for k, (_, _, value) in zip(order, items, strict=True):
            present[k, r] = 1
            values[k].append(value)
    for key, kind in kinds.items():
        mine = values[place[key]]
        whole = len(mine) == len(texts)
        head.append(bytes([whole]) + (b"" if whole else np.packbits(present[place[key]], bitorder="little").tobytes()))
        bodies.append(varints([len(mine)]))
        if kind == b"i":
            if any(not re.fullmatch(b"-?[0-9]+", v) or str(int(v)).encode() != v for v in set(mine)):
                return None
            bodies.append(varints(zigzag([int(v) for v in mine])))
        else:
            bodies += [varint(len(v)) + v for v in mine]
    return b"".join(head + bodies)


def from_tag_streams(c: Cursor, n: int) -> list[bytes]:
    keys = [(c.take(2), c.take(1)) for _ in range(c.number())]
    present = []
    for _ in keys:
        whole = c.take(1)[0]
        present.append(np.ones(n, np.uint8) if whole else np.unpackbits(np.frombuffer(c.take(-(-n // 8)), np.uint8), count=n, bitorder="little"))
    out: list[list[bytes]] = [[] for _ in range(n)]
    for (key, kind), there in zip(keys, present, strict=True):
        count = c.number()
        values = [b"%d" % v for v in unzigzag(c.numbers(count)).tolist()] if kind == b"i" else [c.take(c.number()) for _ in range(count)]
        for r, v in zip(np.flatnonzero(there).tolist(), values, strict=True):
            out[r].append(key + b":" + kind + b":" + v)
    return [b"\t".join(x) for x in out]


#: (encode, decode) of each column's codes. An encoder gives None for what its code can't hold.
CODERS: dict[tuple[str, str], tuple[Callable, Callable]] = {
    **{(c, "raw"): (raw_strings, from_raw_strings) for c in ("qname", "cigar", "mate_reference", "sequence", "quality", "tags")},
    **{(c, "raw"): raw_numbers(c) for c in WIDTHS},
    ("pos", "pos_delta"): (steps, lambda c, n: np.cumsum(c.numbers(n).astype(np.int64)).tolist()),
    ("flag", "flag_bitpack"): (flags, from_flags),
    ("mapq", "mapq_rle"): (lambda x: runs(np.asarray(x)), lambda c, n: list(from_runs(c, n))),
    ("sequence", "seq_2bit"): (bases, from_bases),
    ("cigar", "cigar_token"): (operations, from_operations),
    ("cigar", "cigar_dict"): (dictionary, from_dictionary),
    ("quality", "qual_rle"): (quality_runs, from_quality_runs),
    ("quality", "qual_pack"): (quality_pack, from_quality_pack),
    ("qname", "qname_dict"): (names_dictionary, from_names_dictionary),
    ("tags", "tags_per_stream"): (tag_streams, from_tag_streams),
}


def envelope(code: str, body: bytes) -> bytes:
    """A body compressed by Zstandard: base code, compression, plain size, packed size, bytes."""
    data = zstandard.ZstdCompressor(level=1).compress(body)
    return varints([CODE_IDS[code], ZSTD, len(body), len(data)]) + data


def from_envelope(data: bytes) -> tuple[str, bytes]:
    c = Cursor(data)
    code, kind, plain, size = (c.number() for _ in range(4))
    if kind != ZSTD or code not in CODE_IDS.values():
        raise ReadsError("unknown compression of a column")
    body = zstandard.ZstdDecompressor().decompress(c.take(size), max_output_size=plain)
    c.end()
    if len(body) != plain:
        raise ReadsError("a compressed column has another size than stated")
    return next(k for k, v in CODE_IDS.items() if v == code), body


def decode(column: str, code: str, body: bytes, n: int) -> list:
    if code == "compressed":
        code, body = from_envelope(body)
    c = Cursor(body)
    out = CODERS[column, code][1](c, n)
    c.end()
    return out


def bodies_of(column: str, values: list) -> Iterator[tuple[str, bytes]]:
    """(code, body) of every code that can hold the column."""
    return ((code, body) for code, _, body in bodies_from(column, lambda: values))


def bodies_from(column: str, values: Callable[[], list]) -> Iterator[tuple[str, int, bytes]]:
    """(code, n, body) of every code that can hold the column; plain positions only where they don't ascend. ``values`` gives the
    column, again for each code, so it isn't held beside what is done with a body."""
    can = False
    for code in CODES[column]:
        found = values()
        n, body = len(found), CODERS[column, code][0](found)
        del found
        if body is not None:
            can = True
            yield code, n, body
    if not can:
        found = values()
        yield "raw", len(found), CODERS[column, "raw"][0](found)


class Held:
    """A chunk's columns while its batches come in: compressed once they are many."""

    def __init__(self) -> None:
        self.open: list[pa.RecordBatch] = []
        self.shut: dict[str, list[pa.Buffer]] = {c: [] for c in CODES}
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.open.append(batch)
        self.rows += batch.num_rows
        if self.rows >= ROWS:
            table = pa.Table.from_batches(self.open).combine_chunks()
            for c in CODES:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([table.schema.field(c)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(table.select([c]))
                self.shut[c].append(sink.getvalue())
            self.open, self.rows = [], 0

    def column(self, name: str) -> list:
        out = []
        for buffer in self.shut[name]:
            out += pa.ipc.open_stream(buffer).read_all().column(0).to_pylist()
        for batch in self.open:
            out += batch.column(name).to_pylist()
        return out


BODIES = T.StructType([T.StructField("column", T.StringType()), T.StructField("code", T.StringType()), T.StructField("n", T.LongType()), T.StructField("body", T.BinaryType())])
#: ``facts`` that are the bodies' sizes alone.
SIZES = ("bytes long", lambda column, code, n, body: (len(body),))
#: Bytes of bodies that leave Python at once.
SENT = 1 << 24


def encode_chunks(reads: DataFrame, keys: tuple[str, ...] = KEYS, order: tuple[str, ...] = ORDER, *, every: bool = False, compression: str | None = None, facts: tuple[str, Callable] | None = None) -> DataFrame:
    """(keys, column, code, n, body) of each chunk's columns: the smallest body, of equals the one preferred, or ``every`` one.

    With ``compression`` zstd a body is put in an envelope where that is smaller. With ``facts``, columns and a function of column,
    code, n and body, what it gives comes in place of the body, which then needn't leave the task.
    """
    told = T.StructType.fromDDL(facts[0]).fields if facts else BODIES.fields[-1:]
    schema = T.StructType([*(reads.schema[k] for k in keys), *BODIES.fields[:-1], *told])
    arrow, width = to_arrow_schema(schema), len(keys)

    def encoded(key: tuple, chunk: Held) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for column in CODES:
            found = bodies_from(column, lambda c=column: chunk.column(c))
            for code, n, body in found if every else [min(found, key=lambda x: len(x[2]))]:
                if compression == "zstd":
                    code, body = min((code, body), ("compressed", envelope(code, body)), key=lambda x: len(x[1]))
                rows.append((*key, column, code, n, *(facts[1](column, code, n, body) if facts else [body])))
                size += 0 if facts else len(body)
                if size > SENT:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, Held()
        for batch in batches:
            names = list(zip(*(batch.column(i).to_pylist() for i in range(width)), strict=True))
            at = 0
            while at < len(names):
                end = next((i for i in range(at, len(names)) if names[i] != names[at]), len(names))
                if names[at] != key:
                    if key is not None:
                        yield from encoded(key, held)
                    key, held = names[at], Held()
                held.add(batch.slice(at, end - at))
                at = end
        if key is not None:
            yield from encoded(key, held)

    texts = [F.col(f.name).cast("binary").alias(f.name) if isinstance(f.dataType, T.StringType) and f.name in CODES else F.col(f.name) for f in reads.schema if f.name in (*keys, *CODES)]
    wanted = [*keys, *(c for c in CODES if c not in keys)]
    ordered = reads.repartition(*keys).sortWithinPartitions(*keys, *order).select(*texts).select(*wanted)
    return ordered.mapInArrow(run, schema)


def decode_chunks(bodies: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The reads of encoded chunks: keys and the columns, records of a chunk in order. A missing or repeated column is an error."""
    fields = [READS[c] for c in CODES]
    schema = T.StructType([*(bodies.schema[k] for k in keys), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, {}

        def chunk() -> pa.RecordBatch:
            if set(found) != set(CODES) or len({len(v) for v in found.values()}) != 1:
                raise ReadsError("a chunk's columns don't fit together")
            n = len(found["pos"])
            texts = lambda c: [x.decode() if isinstance(x, bytes) else x for x in found[c]]
            columns = [[k] * n for k in key] + [texts(c) for c in CODES]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                *name, column, code, n, body = row
                if tuple(name) != key:
                    if found:
                        yield chunk()
                    key, found = tuple(name), {}
                if column in found:
                    raise ReadsError(f"duplicate column {column}")
                found[column] = decode(column, code, body, n)
        if found:
            yield chunk()

    return bodies.select(*keys, *BODIES.fieldNames()).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
