"""Words, lines and their hashes for whole batches of texts, as numpy arrays over the Arrow buffer.

Used inside ``mapInArrow``: a batch is cut into slices of about a million bytes (a longer text is a
slice of its own), so memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE_BYTES = b" \t\n\v\f\r"

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

WORD = np.ones(256, np.uint8)
WORD[list(SPACE_BYTES)] = 0

LINE = np.ones(256, np.uint8)
LINE[ord("\n")] = 0


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets of the rows) of each slice; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, held[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of one kind other than 0: their starts, their ends, and each text's first run."""
    kind = kinds[data]
    cut = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1]) if len(data) > 1 else None
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    held = kind[edges[:-1]] != 0
    starts, ends = edges[:-1][held], edges[1:][held]
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over the whole (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(name: str, base: int, size: int) -> np.ndarray:
    if len(_powers[name]) < size:
        steps = np.full(max(size, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        made = np.cumprod(steps)
        if size > 2 * SLICE_BYTES:
            return made  # a very long text: not kept
        _powers[name] = made
    return _powers[name]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from one prefix sum over the slice."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _P, len(data))[: len(data)], out=prefix[1:])
    down = _power("down", _P_INVERSE, len(data) + 1)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of n neighbouring values; as many as fit."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        factor = (pow(_P, k + 1, 1 << 64) + 2 * salt * (k + 1)) % (1 << 64)
        out += h[k : k + size] * np.uint64(factor)
    return mix(out)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring indices; 0 for empty texts."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def text_of(first: np.ndarray) -> np.ndarray:
    """The text that each of the spans is in."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a value stands elsewhere in its text too, and whether it stands earlier in it."""
    key = mix(h + mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    held = key[order]
    same = held[1:] == held[:-1]
    anywhere, earlier = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order[1:]] = same
    anywhere[order[1:]] |= same
    anywhere[order[:-1]] |= same
    return anywhere, earlier
