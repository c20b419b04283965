"""Vectorised views of Arrow text columns: one byte buffer a batch, words and their hashes.

All work is on bytes of UTF-8. A batch is cut into pieces of about PIECE_BYTES, so temporary arrays
stay small however many or long the texts are; a text longer than a piece is cut at white space and
its pieces carry the number of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 4096)
        for key, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, piece starts with the end as last, number of the text of each piece).

    Every piece of a text ends with one space that is not part of it, and one space stands before the
    first, so no word crosses two pieces.
    """
    limit = limit or PIECE_BYTES
    data, at = utf8_parts(column)
    cuts, owner = [], []
    for i in range(len(at) - 1):
        lo, hi = int(at[i]), int(at[i + 1])
        while hi - lo > limit:
            space = np.flatnonzero(IS_SPACE[data[lo : lo + limit]])
            end = lo + int(space[-1]) + 1 if len(space) else _word_end(data, lo + limit, hi)
            cuts.append((lo, end))
            owner.append(i)
            lo = end
        cuts.append((lo, hi))
        owner.append(i)
    group: list[int] = []
    size = 0
    for k, (lo, hi) in enumerate(cuts):
        if group and size + hi - lo > limit:
            yield _joined(data, [cuts[g] for g in group]) + (np.array([owner[g] for g in group]),)
            group, size = [], 0
        group.append(k)
        size += hi - lo
    if group:
        yield _joined(data, [cuts[g] for g in group]) + (np.array([owner[g] for g in group]),)


def _word_end(data: np.ndarray, lo: int, hi: int) -> int:
    space = np.flatnonzero(IS_SPACE[data[lo:hi]])
    return lo + int(space[0]) if len(space) else hi


def _joined(data: np.ndarray, cuts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([hi - lo for lo, hi in cuts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    out = np.full(int(starts[-1]), 32, np.uint8)
    for (lo, hi), s in zip(cuts, starts, strict=False):
        out[s : s + hi - lo] = data[lo:hi]
    return out, starts


def words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that begins and ends with a space."""
    space = IS_SPACE[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edge[0::2], edge[1::2]


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = _power_table(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buffer] * up[: len(buffer)], dtype=np.uint64, out=total[1:])
    own = (total[ends] - total[starts]) * down[starts]
    return mix64(own + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
