"""CRC-32 of many byte runs at once, and of their concatenations, from the CRCs of the parts."""

import zlib

import numpy as np

#: Runs longer than this go through zlib one by one; shifts of so many bytes have a table each.
SHORT = 64


def _bytewise() -> np.ndarray:
    """The register after one zero byte, by its low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


STEP = _bytewise()


def _zero(c: np.ndarray) -> np.ndarray:
    return STEP[c & 255] ^ (c >> np.uint32(8))


def _apply(tables: np.ndarray, at, c: np.ndarray) -> np.ndarray:
    """tables[at] is linear: its value is the exclusive or over the four bytes of c."""
    out = tables[at, 0, c & 255]
    for j in (1, 2, 3):
        out ^= tables[at, j, c >> np.uint32(8 * j) & 255]
    return out


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables for 0 to SHORT - 1 zero bytes, and for SHORT times 1, 2, 4, ... of them."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    small = [one]
    for _ in range(SHORT):
        small.append(_zero(small[-1]))
    large = [small.pop()]
    for _ in range(25):
        large.append(np.stack([_apply(large[-1][None], 0, row) for row in large[-1]]))
    return np.stack(small), np.stack(large)


SMALL, LARGE = _shifts()


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a CRC contributes to that of its bytes followed by n more: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    out = _apply(SMALL, n & (SHORT - 1), c)
    more, k = n // SHORT, 0
    while more.any():
        at = np.flatnonzero(more & 1)
        out[at] = _apply(LARGE, k, out[at])
        more, k = more >> 1, k + 1
    return out


def crc32s(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each raw[start:end], of uint8 raw; byte k of all runs that have one is taken at once."""
    size = end - start
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    size, start_ = size[order], start[order]
    c = np.full(len(size), 0xFFFFFFFF, np.uint32)
    longer = np.searchsorted(-size, -np.arange(SHORT + 1))  # runs of more than k bytes come first
    for k in range(SHORT):
        n = longer[k]
        if not n:
            break
        c[:n] = STEP[(c[:n] ^ raw[start_[:n] + k]) & 255] ^ (c[:n] >> np.uint32(8))
    c ^= np.uint32(0xFFFFFFFF)
    for k in range(longer[SHORT]):
        c[k] = zlib.crc32(raw[start_[k]:start_[k] + size[k]])
    out = np.empty_like(c)
    out[order] = c
    return out
