"""Texts as NumPy arrays: words, rolling hashes and content-defined anchors of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space; a word is a longest run of other bytes.
SPACES = b"\t\n\x0b\x0c\r "
WORD = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20260)).integers(0, 2**64, 256, dtype=np.uint64)
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; nulls are empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]] if len(at) else whole[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of the first word of each row."""
    n = len(data)
    space = _IS_SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        if size > 1 << 23:  # one very long row; not kept
            return out[0], out[1]
        have = _powers[base] = (out[0], out[1])
    return have


class Rolling:
    """Polynomial hashes modulo 2**64 of any range of a sequence of spread 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = _table(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: spread values of its bytes with their places, added up.

    Bytes are spread together with their places, so no two texts can be built
    from patterns of bytes alone that meet, as with polynomials modulo 2**64.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    data, begin = data[starts[0] : ends[-1]], starts - starts[0]
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(begin, np.diff(np.append(begin, len(data)))).astype(np.uint64)
    values = mix(byte_values(data) + place * np.uint64(BASE_A))
    values[_IS_SPACE[data]] = 0
    return mix(np.add.reduceat(values, begin) + (ends - starts).astype(np.uint64) * np.uint64(BASE_B))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchored_runs(values: np.ndarray, rows: np.ndarray, gram: int, window: int) -> dict[str, np.ndarray]:
    """Runs of consecutive windows that share an anchor.

    ``values`` holds the units of all rows, row r from ``rows[r]`` to
    ``rows[r + 1]``. The anchor of a window is its ``gram`` of least hash, the
    leftmost on ties, so equal windows have equal anchors at equal places.
    Gives per run: row, first window (from the row's start), number of
    windows, the anchor's hash, and a hash of all units that the run covers
    together with the anchor's place in it.
    """
    counts = np.maximum(rows[1:] - rows[:-1] - window + 1, 0)
    total = int(counts.sum())
    names = ("row", "first", "width", "anchor", "content")
    if not total:
        return {n: np.zeros(0, np.uint64 if n in ("anchor", "content") else np.int64) for n in names}
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + rows[:-1][row]
    one = Rolling(values, BASE_A)
    at = np.arange(len(values) - gram + 1)
    grams = mix(one.of(at, at + gram))
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (sliding_min(key, window - gram + 1)[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    width = np.diff(np.append(head, total))
    begin, place = start[head], anchor[head]
    end = begin + width - 1 + window
    content = mix(Rolling(values, BASE_B).of(begin, end) ^ mix(((place - begin) << 32 | (end - begin)).astype(np.uint64)))
    return {"row": row[head], "first": begin - rows[:-1][row[head]], "width": width, "anchor": grams[place], "content": content}
