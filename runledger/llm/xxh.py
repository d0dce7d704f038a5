"""XXH64 of many short byte ranges at once, in numpy (for word shingles)."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the XXH64 specification.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer ranges are few; the xxhash library takes them one by one.
_LONGEST = 96


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _lane(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotated(acc + word * _P2, 31) * _P1


def _of_length(size: int, at: np.ndarray, eight: np.ndarray, four: np.ndarray, one: np.ndarray, seed: np.uint64) -> np.ndarray:
    done = 0
    if size >= 32:
        lanes = [np.full(len(at), x) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while size - done >= 32:
            lanes = [_lane(v, eight[at + (done + 8 * k)]) for k, v in enumerate(lanes)]
            done += 32
        h = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
        for v in lanes:
            h = (h ^ _lane(np.zeros_like(v), v)) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5)
    h = h + np.uint64(size)
    while size - done >= 8:
        h = _rotated(h ^ _lane(np.zeros_like(h), eight[at + done]), 27) * _P1 + _P4
        done += 8
    if size - done >= 4:
        h = _rotated(h ^ (four[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
        done += 4
    while done < size:
        h = _rotated(h ^ (one[at + done].astype(np.uint64) * _P5), 11) * _P1
        done += 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def xxh64_ranges(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[starts[i]:ends[i]] for every i, unsigned."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = data + b"\0" * 8
    one = np.frombuffer(padded, np.uint8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 5,), "<u4", padded, strides=(1,))
    sizes = ends - starts
    order = np.argsort(np.minimum(sizes, _LONGEST + 1).astype(np.uint8), kind="stable")
    ordered = np.minimum(sizes[order], _LONGEST + 1)
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    with np.errstate(over="ignore"):
        for part in np.split(order, cuts):
            size = int(sizes[part[0]])
            if size > _LONGEST:
                out[part] = [xxhash.xxh64_intdigest(data[a:z], seed) for a, z in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
            else:
                out[part] = _of_length(size, starts[part], eight, four, one, np.uint64(seed))
    return out
