"""Sets of row numbers in compressed blocks, with AND, OR, AND-NOT and counts on the compressed form.

A set is cut into blocks of 65,536 numbers. A block is whichever is smallest: its numbers in order (two bytes each), its
runs (four bytes each), or 65,536 bits. So a set takes memory by what is in it, not by the rows there are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

SIZE = 1 << 16
#: The forms of a block, by the number that stands for them in bytes.
ROWS, RUNS, BITS = 0, 1, 2
_DTYPE = {ROWS: np.uint16, RUNS: np.uint16, BITS: np.uint64}

Block = tuple[int, np.ndarray]


def _runs_of(rows: np.ndarray) -> np.ndarray:
    """First and last number of every run of some ordered numbers."""
    wide = rows.astype(np.int32)
    cuts = np.flatnonzero(np.diff(wide) != 1)
    return np.stack([rows[np.concatenate([[0], cuts + 1])], rows[np.concatenate([cuts, [len(rows) - 1]])]], axis=1)


def _expanded(runs: np.ndarray) -> np.ndarray:
    first, last = runs[:, 0].astype(np.int64), runs[:, 1].astype(np.int64)
    sizes = last - first + 1
    return (np.arange(sizes.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)).astype(np.uint16)


def numbers(b: Block) -> np.ndarray:
    """The numbers of a block in order."""
    kind, a = b
    if kind == ROWS:
        return a
    return _expanded(a) if kind == RUNS else np.flatnonzero(np.unpackbits(a.view(np.uint8), bitorder="little")).astype(np.uint16)


def _bits(b: Block) -> np.ndarray:
    kind, a = b
    if kind == BITS:
        return a
    flags = np.zeros(SIZE, bool)
    if kind == ROWS:
        flags[a] = True
    else:
        steps = np.zeros(SIZE + 1, np.int8)
        steps[a[:, 0]] += 1
        steps[a[:, 1].astype(np.int32) + 1] -= 1
        flags = np.cumsum(steps[:SIZE], dtype=np.int8) > 0
    return np.packbits(flags, bitorder="little").view(np.uint64)


def size(b: Block) -> int:
    kind, a = b
    if kind == ROWS:
        return len(a)
    return int((a[:, 1].astype(np.int64) - a[:, 0] + 1).sum()) if kind == RUNS else int(np.bitwise_count(a).sum())


def _from_rows(rows: np.ndarray) -> Block | None:
    n = len(rows)
    if not n:
        return None
    if n > 2 and int(rows[-1]) - int(rows[0]) == n - 1:
        return RUNS, np.array([[rows[0], rows[-1]]], np.uint16)
    runs = 1 + int(np.count_nonzero(np.diff(rows.astype(np.int32)) != 1)) if n > 8 else n
    if 2 * runs < n and 4 * runs < 8192:
        return RUNS, _runs_of(rows)
    return (ROWS, rows) if n <= 4096 else (BITS, _bits((ROWS, rows)))


def _from_runs(runs: np.ndarray) -> Block | None:
    if not len(runs):
        return None
    n = size((RUNS, runs))
    if 2 * n <= 4 * len(runs):
        return ROWS, _expanded(runs)
    return (RUNS, runs) if 4 * len(runs) < 8192 else _from_bits(_bits((RUNS, runs)))


def _from_bits(bits: np.ndarray) -> Block | None:
    n = int(np.bitwise_count(bits).sum())
    return (BITS, bits) if n > 4096 and n < SIZE else _from_rows(numbers((BITS, bits)))


def _holds(b: Block, rows: np.ndarray) -> np.ndarray:
    """Which of some numbers are in a block."""
    kind, a = b
    if kind == ROWS:
        return a[np.minimum(np.searchsorted(a, rows), len(a) - 1)] == rows
    if kind == RUNS:
        at = np.searchsorted(a[:, 0], rows, side="right") - 1
        return (at >= 0) & (rows <= a[np.maximum(at, 0), 1])
    return (a[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1) == 1


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two lists of runs have in common."""
    low, high = np.searchsorted(b[:, 1], a[:, 0]), np.searchsorted(b[:, 0], a[:, 1], side="right")
    n = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(a)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
    return np.stack([np.maximum(a[i, 0], b[j, 0]), np.minimum(a[i, 1], b[j, 1])], axis=1)


def _merged(runs: np.ndarray) -> np.ndarray:
    """Runs in any order as ordered ones that don't touch."""
    wide = runs[np.argsort(runs[:, 0], kind="stable")].astype(np.int32)
    upto = np.maximum.accumulate(wide[:, 1])
    starts = np.concatenate([[True], wide[1:, 0] > upto[:-1] + 1])
    ends = np.concatenate([np.flatnonzero(starts)[1:] - 1, [len(wide) - 1]])
    return np.stack([wide[starts, 0], upto[ends]], axis=1).astype(np.uint16)


def _as_runs(b: Block) -> np.ndarray:
    return b[1] if b[0] == RUNS else np.stack([b[1], b[1]], axis=1)


def _and(a: Block, b: Block) -> Block | None:
    if ROWS in (a[0], b[0]):
        if b[0] == ROWS and (a[0] != ROWS or len(b[1]) < len(a[1])):
            a, b = b, a
        return _from_rows(a[1][_holds(b, a[1])])
    if a[0] == b[0] == RUNS:
        return _from_runs(_meet(a[1], b[1]))
    return _from_bits(_bits(a) & _bits(b))


def _or(a: Block, b: Block) -> Block | None:
    if BITS in (a[0], b[0]):
        return _from_bits(_bits(a) | _bits(b))
    if a[0] == b[0] == ROWS:
        return _from_rows(np.union1d(a[1], b[1]))
    return _from_runs(_merged(np.concatenate([_as_runs(a), _as_runs(b)])))


def _less(a: Block, b: Block) -> Block | None:
    if a[0] == ROWS:
        return _from_rows(a[1][~_holds(b, a[1])])
    if BITS in (a[0], b[0]):
        return _from_bits(_bits(a) & ~_bits(b))
    taken = _as_runs(b).astype(np.int32)
    edges = np.stack([np.concatenate([[0], taken[:, 1] + 1]), np.concatenate([taken[:, 0] - 1, [SIZE - 1]])], axis=1)
    return _from_runs(_meet(a[1].astype(np.int32), edges[edges[:, 0] <= edges[:, 1]]).astype(np.uint16))


def _common(a: Block, b: Block) -> int:
    if ROWS in (a[0], b[0]):
        if b[0] == ROWS and (a[0] != ROWS or len(b[1]) < len(a[1])):
            a, b = b, a
        return int(np.count_nonzero(_holds(b, a[1])))
    if a[0] == b[0] == RUNS:
        return size((RUNS, _meet(a[1], b[1])))
    return int(np.bitwise_count(_bits(a) & _bits(b)).sum())


class Bitmap:
    """An immutable set of numbers from 0 to 2 ** 32 - 1."""

    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, Block]) -> None:
        self.blocks = blocks

    @classmethod
    def of(cls, rows: Iterable[int] | np.ndarray) -> Bitmap:
        """Of numbers in any order, repeated ones once."""
        rows = np.asarray(rows if isinstance(rows, np.ndarray) else list(rows), np.int64)
        if len(rows) > 1 and not (np.diff(rows) > 0).all():
            rows = np.unique(rows)
        if not len(rows):
            return cls({})
        if rows[0] < 0 or rows[-1] >= 1 << 32:
            raise ValueError("numbers must be from 0 to 2 ** 32 - 1")
        high = rows >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(h[0]) >> 16: _from_rows((h & 0xFFFF).astype(np.uint16)) for h in np.split(rows, cuts)})

    @classmethod
    def span(cls, n: int) -> Bitmap:
        """The numbers below n."""
        full = {h: (RUNS, np.array([[0, SIZE - 1]], np.uint16)) for h in range(n >> 16)}
        rest = _from_runs(np.array([[0, (n & 0xFFFF) - 1]], np.uint16)) if n & 0xFFFF else None
        return cls(full | ({n >> 16: rest} if rest else {}))

    def __and__(self, other: Bitmap) -> Bitmap:
        made = {h: _and(self.blocks[h], other.blocks[h]) for h in self.blocks.keys() & other.blocks.keys()}
        return Bitmap({h: b for h, b in made.items() if b})

    def __or__(self, other: Bitmap) -> Bitmap:
        made = {h: _or(b, other.blocks[h]) if h in other.blocks else b for h, b in self.blocks.items()}
        return Bitmap({**other.blocks, **made})

    def __sub__(self, other: Bitmap) -> Bitmap:
        made = {h: _less(b, other.blocks[h]) if h in other.blocks else b for h, b in self.blocks.items()}
        return Bitmap({h: b for h, b in made.items() if b})

    def __len__(self) -> int:
        return sum(map(size, self.blocks.values()))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Bitmap) and np.array_equal(self.rows(), other.rows())

    __hash__ = None

    def common(self, other: Bitmap) -> int:
        """How many numbers both have."""
        return sum(_common(self.blocks[h], other.blocks[h]) for h in self.blocks.keys() & other.blocks.keys())

    def rows(self) -> np.ndarray:
        """The numbers in order."""
        parts = [numbers(self.blocks[h]).astype(np.int64) + (h << 16) for h in sorted(self.blocks)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for _, a in self.blocks.values())

    def dumps(self) -> bytes:
        """Number of blocks; of each its place, form and bytes (4, 1 and 4 bytes, little-endian), then its content."""
        out = [struct.pack("<I", len(self.blocks))]
        for h in sorted(self.blocks):
            kind, a = self.blocks[h]
            out += [struct.pack("<IBI", h, kind, a.nbytes), a.tobytes()]
        return b"".join(out)

    @classmethod
    def loads(cls, raw: bytes) -> Bitmap:
        (n,), at, blocks = struct.unpack_from("<I", raw), 4, {}
        for _ in range(n):
            h, kind, length = struct.unpack_from("<IBI", raw, at)
            a = np.frombuffer(raw, _DTYPE[kind], length // np.dtype(_DTYPE[kind]).itemsize, at + 9)
            blocks[h] = (kind, a.reshape(-1, 2) if kind == RUNS else a)
            at += 9 + length
        return cls(blocks)


def union(sets: Iterable[Bitmap]) -> Bitmap:
    out = Bitmap({})
    for s in sets:
        out = out | s
    return out
