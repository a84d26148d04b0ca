"""Arrays packed into binary columns, for exchanges in which a row would be too small a unit.

A block is a bounded share of the documents. In an exchange each block sends one row to each of the parts that it has
entries for, with its entries as packed arrays; a part's rows are merged with numpy in one task, and the answers go back
to the blocks in the order in which they were asked.
"""

from __future__ import annotations

import numpy as np
import zstandard

KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes, bytes of equal weight side by side, compressed."""
    values = np.asarray(values)
    most = int(values.max(initial=0))
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    planes = np.ascontiguousarray(values.astype(KINDS[size]).view(np.uint8).reshape(-1, size).T)
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(KINDS[size]).ravel().astype(np.uint64)


def spread(values: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values (the finaliser of splitmix64)."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_by(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, positions) of each part that occurs, positions ascending."""
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(np.diff(part[order], prepend=-1))
    return [(int(part[o[0]]), o) for o in np.split(order, at[1:])] if len(order) else []


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting."""
    values = np.sort(values)
    return values[np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))] if len(values) else values


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values, and for each value the place of its equal among them."""
    order = np.argsort(values)
    sorted_ = values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.cumsum(fresh) - 1
    return sorted_[fresh], place
